import hashlib

import duckdb
import numpy as np

from parcelscope.llm import gap_clusters as G

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, ints int, old int, key double, distance int"


def brute(given, k=16, rounds=3, dim=64):
    rows = []
    for i, v in given:
        if v is None or len(v) != dim or any(x is None or not np.isfinite(x) or abs(float(x)) >= G.LARGEST / 64 for x in v):
            continue
        rows.append((i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)))
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    cent = [x.copy() for _, x in first]
    if not rows:
        return []
    x = np.stack([v for _, v in rows])
    for r in range(rounds + 1):
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in cent], axis=1)
        own = d.argmin(axis=1)
        if r < rounds:
            cent = [x[own == c].sum(axis=0) // (own == c).sum() if (own == c).any() else cent[c] for c in range(len(cent))]
    near = d[np.arange(len(x)), own]
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in cent]
    return sorted([(i, int(c), int(s), int(near[own == c].sum()), int(near.sum()), digest[c])
                   for (i, _), c, s in zip(rows, own, near)], key=str)


def run(spark, given, **kw):
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3, 0.5, 4) for i, v in given], VECTORS)
    return sorted(map(tuple, G.cluster(df, **kw)[0].collect()), key=str)


def blobs(seed, n, spread, dim=64, centres=16):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim)) * 3
    return [(i, (c[i % centres] + spread * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def test_query_equals_sql_and_brute_force(spark, smoke_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{smoke_dir}/embeddings.parquet'")
    got = sorted(map(tuple, G.op12_gap_clusters(spark, smoke_dir).collect()), key=str)
    assert got == sorted(con.execute(G.ORACLE_SQL).fetchall(), key=str)
    assert got == brute(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())


def test_only_expired_vectors_are_measured_again(spark):
    """Tight groups around few centroids: gaps outlive the small moves."""
    given = blobs(3, 900, 0.05)
    df = spark.createDataFrame([(i, v) for i, v in given], "vec_id bigint, embedding array<float>")
    ints = G.integer_vectors(df, "vec_id", "embedding", 64, 64)
    state = G.Clustering(ints, 16, 1, 64)
    for _ in range(3):
        state.move()
    popped = [r.count() for r in state.runs]
    assert popped[0] == 900 > popped[1] > popped[2] > popped[3] and popped[3] < 225
    assert run(spark, given) == brute(given)


def test_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    few = rng.integers(-2, 3, (12, 64)).astype(np.float32)
    given = [(i, few[i % 12].tolist()) for i in range(400)] + [(7, few[3].tolist())] * 3
    assert run(spark, given) == brute(given)
    line = [(i, [float(i % 9)] + [0.0] * 63) for i in range(300)]  # many equal distances
    assert run(spark, line) == brute(line)


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [None] + [1.0] * 63), (104, [float("nan")] + [1.0] * 63),
           (105, [float("inf")] + [1.0] * 63), (106, [1e30] + [1.0] * 63)]
    given = good + bad + [(None, good[0][1]), (0, good[1][1]), (200, [0.0] * 64), (201, [2e6] + [-2e6] * 63)]
    got = run(spark, given)
    assert got == brute(given) and len(got) == len(given) - len(bad)
    assert run(spark, good[:5]) == brute(good[:5])                 # fewer than 16
    assert run(spark, good[:1]) == brute(good[:1])
    assert run(spark, bad) == run(spark, []) == []


def test_distances_are_exact_beyond_doubles():
    x = np.array([[G.LARGEST - 1] * 64, [1] + [0] * 63], np.int64)
    c = np.array([[-(G.LARGEST - 1)] * 64, [0] * 64], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
    assert G.squared(x, c).tolist() == want and want[0][0] > 1 << 53
