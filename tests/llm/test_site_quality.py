import numpy as np
from pyspark.sql import functions as F

from parcelscope.llm.site_quality import keep_good, op6_site_quality, score, site_rates
from tests.llm.common import docs, rows

LABELS = "doc_id bigint, quality int, toxic int, text string"
GOOD = "The cat sat on the mat and looked at the {0} birds. It was a fine day for all {0} of them."
BAD = "WIN!! NOW!! {0}!! CLICK!! HERE!! $$$ ### *** %%% !!"


def test_query_separates_the_labels(spark, smoke_dir):
    got = {r.doc_id: r for r in op6_site_quality(spark, smoke_dir).collect()}
    known = rows(smoke_dir, "labels", "doc_id", "quality")
    assert len(got) == len(rows(smoke_dir, "documents", "doc_id"))
    good = [got[i].kept for i, q in known if q == 1]
    bad = [got[i].kept for i, q in known if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def _corpus(n=60):
    return [(i, (GOOD if i % 3 else BAD).format(i), "en", f"host{i % 4}") for i in range(n)]


def _labels(spark, ids):
    return spark.createDataFrame([(i, 1 if i % 3 else 0, 0, "t") for i in ids], LABELS)


def test_unlabelled_documents_follow(spark):
    got = score(docs(spark, _corpus(), clash=True), _labels(spark, range(0, 60, 2)), F.col("source"), F.col("lang"))
    assert {r.row_id: r.kept for r in got.collect()} == {i: bool(i % 3) for i in range(60)}


def test_sparse_sites_shrink(spark):
    given = [("big", "a", 1.0)] * 500 + [("big", "b", 1.0)] * 2 + [("bad", "a", 0.0)] * 400 + [("new", "a", 0.0)]
    got = {(r.host, r.path): r for r in
           site_rates(spark.createDataFrame(given, "host string, path string, good double")).collect()}
    mean = 502.5 / 904
    assert got["bad", "a"].site_rate < 0.02 and got["big", "a"].site_rate > 0.98
    assert got["bad", "a"].site_rate < got["new", "a"].site_rate < mean     # one row moves the global rate a bit
    assert abs(got["big", "b"].site_rate - got["big", "a"].site_rate) < 0.05
    # moments by hand: the spread of host rates beyond the counting noise
    hosts = [(502, 502.0), (400, 0.0), (1, 0.0)]
    n, k = sum(h[0] for h in hosts), sum(h[1] for h in hosts)
    m = (k + 0.5) / (n + 1)
    between = (sum(c * (g / c - m) ** 2 for c, g in hosts if c > 1) - 2 * m * (1 - m)) / 902
    strength = max(1.0, m * (1 - m) / between - 1)
    assert abs(got["new", "a"].host_rate - strength * m / (1 + strength)) < 1e-9


def test_edge_cases(spark):
    given = _corpus(30) + [(100, None, None, None), (101, "", "en", "host0"), (102, GOOD.format(1) * 2000, "en", "x"),
                           (102, GOOD.format(1) * 2000, "en", "x"), (None, GOOD.format(2), "en", "host1")]
    labels = _labels(spark, range(30)).union(spark.createDataFrame([(1, None, 0, ""), (None, 1, 0, ""), (4, 1, 0, "")], LABELS))
    kept = keep_good(docs(spark, given, clash=True), labels, F.col("source"), F.col("lang")).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(102) == 2 and None in ids and set(range(30)) & set(ids) == {i for i in range(30) if i % 3}
    assert len(kept[0]) == 15
    nobody = score(docs(spark, given), _labels(spark, []), F.col("source"), F.col("lang")).collect()
    assert len(nobody) == len(given) and all(r.kept for r in nobody)
    assert score(docs(spark, []), _labels(spark, [1]), F.col("source"), F.col("lang")).count() == 0
    assert keep_good(docs(spark, []), _labels(spark, []), F.col("source"), F.col("lang")).count() == 0
