"""Operators of a training-data pipeline (near-duplicates, token counts,
decontamination, secret scans, archives, quality, language id, subword
encoding, chat formatting).  Nothing else in the library imports this
package; ``__spark_entry__`` adds its queries when it can be imported.
"""
