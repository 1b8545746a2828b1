import numpy as np
from pyspark.sql import functions as F

from parcelscope.llm import prefix_forest as P
from tests.llm.common import rows

VECTORS = "vec_id bigint, embedding array<float>, label int, rank string, score int, qrow int, band int, block int"


def fine(i, v):
    return i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(given, every=20, k=20):
    """[(query_id, [(vec_id, score), ...])], best first, one per query row."""
    own = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in given if fine(i, v)]
    out = []
    for a, (q, x) in enumerate(own):
        if q % every == 0:
            scored = sorted((-float(P.dot(v[None, :], x)[0]), i) for b, (i, v) in enumerate(own)
                            if b != a and len(v) == len(x))[:k]
            out.append((q, [(i, -s) for s, i in scored]))
    return sorted(out)


def run(spark, given, every=20, **kw):
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3, 4, 5) for i, v in given], VECTORS).repartition(3)
    by = {}
    for r in P.nearest(df, F.col("vec_id") % every == 0, **kw).collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return sorted((q, [(i, s) for _, i, s in sorted(found)]) for q, found in by.items())


def recall(got, want):
    got = dict(got)
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) for q, best in want)
    return hits / max(1, sum(len(best) for _, best in want))


def noise(seed, n, dim=48, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (scale * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def test_query_against_brute_force(spark, smoke_dir):
    given = rows(smoke_dir, "embeddings", "vec_id", "embedding")
    got = {}
    for r in P.op13_prefix_forest(spark, smoke_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(given)
    assert {q for q, _ in want} == set(got)
    assert recall([(q, [(i, s) for _, i, s in f]) for q, f in got.items()], want) >= 0.99
    exact = {(q, i): s for q, best in want for i, s in best}
    assert all(exact.get((q, i), s) == s for q, f in got.items() for _, i, s in f)
    assert all(sorted(r for r, _, _ in f) == list(range(1, 21)) for f in got.values())


def test_recall_where_runs_are_short(spark):
    """Fewer candidates than vectors: prefixes of several bits are in use."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 48))
    given = [(i, (centres[i % 60] + 0.35 * rng.standard_normal(48)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = run(spark, given, enough=4000), brute(given)
    assert recall(got, want) >= 0.9
    assert all(len(f) == 20 for _, f in got)


def test_large_cells_are_cut_and_lose_nothing(spark):
    """Near copies of one vector hold half of the rows; cells are cut far
    below that, by longer prefixes and, for equal strings, by ids."""
    rng = np.random.default_rng(5)
    one = rng.standard_normal(32)
    given = [(i, (one + 1e-7 * i)) for i in range(300)] + [(1000 + i, np.array(v)) for i, v in noise(6, 300, 32)]
    given = [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in given]
    got, want = run(spark, given, cell=50, enough=2000, trees=16), brute(given)
    assert recall(got, want) >= 0.9


def test_copies_and_ties(spark):
    base = noise(7, 60, 16)
    given = base + [(100 + i, base[3][1]) for i in range(300)] + [(20, base[20][1]), (40, base[3][1])]
    got, want = run(spark, given, enough=1 << 40), brute(given)
    # an id that is there twice has two lists under one id
    flat = sorted((q, i, s) for q, best in want for i, s in best)
    assert sorted((q, i, s) for q, f in got for i, s in f) == flat


def test_vectors_of_different_length(spark):
    given = noise(8, 200, 24) + [(1000 + i, v) for i, v in noise(9, 40, 24, 1000.0)] + [(2000, [1e30] * 24)] \
        + [(3000 + i, v) for i, v in noise(10, 40, 24, 1e-20)]
    assert recall(run(spark, given, enough=3000), brute(given)) >= 0.9


def test_a_sparse_query_ascends_above_the_cells(spark):
    """Most vectors lie around one direction, the queries elsewhere."""
    rng = np.random.default_rng(11)
    one = rng.standard_normal(32)
    given = [(20 * i + 1, (one + 0.3 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(1500)]
    given += [(20 * i, rng.standard_normal(32).astype(np.float32).tolist()) for i in range(30)]
    got, want = run(spark, given, enough=3000, trees=32), brute(given)
    assert all(len(f) == 20 for _, f in got) and recall(got, want) >= 0.9


def test_edge_cases(spark):
    one = [1.0, 2.0, 3.0]
    given = [(0, one), (1, [2.0, 4.0, 6.0]), (20, None), (40, []), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 3.0]),
             (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]), (None, one), (140, [1.0, 2.0]),
             (160, [1e-30, 2e-30, 3e-30]), (2, [-1.0, -2.0, -3.0]), (-20, one)]
    got = run(spark, given)
    assert got == [(q, best) for q, best in brute(given) if best]
    assert dict(got)[0] == [(1, 28.0), (-20, 14.0), (160, dict(got)[0][2][1]), (2, -14.0)]
    assert 140 not in dict(got)                                   # alone in its dimension
    assert run(spark, []) == run(spark, given[2:5]) == []


def test_packed_ids():
    for ids in ([5], [1, 2, 3], [-7, 0, 70_000], [-(1 << 62), 0, 1 << 40], [3, 3, 3]):
        assert P.unpack_ids(P.pack_ids(np.array(ids))).tolist() == ids


def test_near_vectors_share_longer_prefixes():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 33))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.02 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    tree = P.projections(32, 4)[0]
    a, b, c = P.codes(x, tree), P.codes(y, tree), P.codes(x[::-1], tree)

    def shared(u, v):
        return np.mean([P.BITS - int(d).bit_length() for d in u ^ v])
    assert shared(a, b) > 12 > 4 > shared(a, c)
