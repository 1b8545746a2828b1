"""Small inputs shared by the tests."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names clash with the operators' own.
CLASHING = (", fp bigint, label string, row_id string, ids string, items string, site_rate double, secret string, "
            "gone_id string, again_id string, component_id int")


def docs(spark, rows, clash=False):
    """Documents from (id, text[, lang[, source]]); n_chars follows."""
    full = []
    for r in rows:
        i, text, lang, source = (*r, "en", "s")[:4] if len(r) == 2 else (*r, "s")[:4] if len(r) == 3 else r
        full.append((i, text, lang, source, None if text is None else len(text)))
    if not clash:
        return spark.createDataFrame(full, DOCS)
    return spark.createDataFrame([(*r, 5, "x", "y", "z", "w", 0.5, "v", "u", "t", 3) for r in full], DOCS + CLASHING)


def read(sf_dir, table):
    import duckdb
    return duckdb.connect().sql(f"SELECT * FROM '{sf_dir}/{table}.parquet'")


def rows(sf_dir, table, *columns):
    return read(sf_dir, table).select(", ".join(columns)).fetchall()
