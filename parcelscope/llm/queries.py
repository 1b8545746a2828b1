"""Registered queries of this package: ``opN_<name>`` over whole tables.

The searches and clusterings that are exact by contract have oracle SQL
beside their code.  The other methods (model training, fingerprints,
archives, tokenizers, approximate search) can't be said in DuckDB SQL;
``tests/llm`` holds each of these queries against a brute-force version, a
library or an exact round trip.
"""

from __future__ import annotations

from parcelscope.llm import gap_clusters, norm_buckets
from parcelscope.llm.bpe_counts import op2_token_counts
from parcelscope.llm.cap_filters import op1_cap_filter_neardup
from parcelscope.llm.chat_tree import op10_chat_prefix_tree
from parcelscope.llm.decontaminate import op3_template_decontamination
from parcelscope.llm.gap_clusters import op12_gap_clusters
from parcelscope.llm.kneser_ney import op8_language_id
from parcelscope.llm.norm_buckets import op11_norm_buckets
from parcelscope.llm.piece_lattice import op9_piece_lattice
from parcelscope.llm.prefix_forest import op13_prefix_forest
from parcelscope.llm.secret_forest import op4_secret_forest
from parcelscope.llm.simhash import op7_simhash_groups
from parcelscope.llm.site_quality import op6_site_quality
from parcelscope.llm.warc_zstd import op5_warc_zstd

QUERIES = {f.__name__: f for f in (
    op1_cap_filter_neardup, op2_token_counts, op3_template_decontamination, op4_secret_forest, op5_warc_zstd,
    op6_site_quality, op7_simhash_groups, op8_language_id, op9_piece_lattice, op10_chat_prefix_tree,
    op11_norm_buckets, op12_gap_clusters, op13_prefix_forest)}
ORACLE: dict[str, str] = {"op11_norm_buckets": norm_buckets.ORACLE_SQL, "op12_gap_clusters": gap_clusters.ORACLE_SQL}
