import numpy as np

from parcelscope.llm.cap_filters import CHUNK, Code, cosine_links, op1_cap_filter_neardup
from parcelscope.llm.components import connected_components
from tests.llm.common import rows

VECTORS = "vec_id bigint, embedding array<float>, label int, rep bigint, n_links string, dim int"


def brute(given, least=0.98):
    """{id: (links, component)} by comparing all pairs."""
    fine = {}
    for k, (i, vec, label) in enumerate(given):
        if i is None or label is None or not vec or any(v is None or not np.isfinite(v) for v in vec) or not any(vec):
            continue
        x = np.array(vec, np.float64)
        fine[k] = (i, x / np.linalg.norm(x), label)
    links, root = {k: 0 for k in range(len(given))}, {k: (i, k) for k, (i, _, _) in enumerate(given)}
    first = {(i, k): (i, k) for k, (i, _, _) in enumerate(given)}

    def find(x):
        while first[x] != x:
            x = first[x]
        return x
    for a in fine:
        for b in fine:
            if a < b and fine[a][2] == fine[b][2] and len(fine[a][1]) == len(fine[b][1]) \
                    and fine[a][1] @ fine[b][1] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(root[a]), find(root[b])
                first[max(x, y)] = min(x, y)
    return sorted([(i, links[k], None if i is None else find(root[k])[0]) for k, (i, _, _) in enumerate(given)], key=str)


def run(spark, given):
    df = spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in given], VECTORS)
    return sorted([(r.row_id, r.n_links, r.component_id) for r in cosine_links(df).collect()], key=str)


def test_query_equals_brute_force(spark, smoke_dir):
    given = rows(smoke_dir, "embeddings", "vec_id", "embedding", "label")
    got = sorted([(r.vec_id, r.n_links, r.component_id) for r in op1_cap_filter_neardup(spark, smoke_dir).collect()],
                 key=str)
    assert got == brute(given)


def _cluster(rng, n, dim, noise, first, label):
    centre = rng.standard_normal(dim)
    return [(first + i, (centre + noise * rng.standard_normal(dim)).astype(np.float32).tolist(), label) for i in range(n)]


def test_a_large_near_group_and_copies(spark):
    rng = np.random.default_rng(3)
    given = _cluster(rng, CHUNK * 2 + 40, 24, 0.05, 0, 1)       # a bucket of several chunks
    given += _cluster(rng, 60, 24, 0.14, 2000, 1)               # around the threshold
    given += [(3000 + i, given[5][1], 1) for i in range(300)]   # exact copies
    given += [(4000 + i, rng.standard_normal(24).tolist(), i % 3) for i in range(300)]
    assert run(spark, given) == brute([(i, np.array(v, np.float32).tolist(), label) for i, v, label in given])


def test_edge_cases(spark):
    one = [1.0, 2.0, 3.0]
    given = [(1, one, 1), (2, [2.0, 4.0, 6.0], 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1),
             (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1),
             (10, [float("inf"), 1.0, 1.0], 1), (None, one, 1), (11, [1.0, 2.0], 1), (12, [1e-30, 2e-30, 3e-30], 1),
             (13, [1e30, 2e30, 3e30], 1), (1, one, 1)]
    got = run(spark, given)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(given)
    assert by[1] == by[2] == by[12] == by[13] == (4, 1)          # 1 is there twice
    assert all(by[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and by[None] == (0, None)
    assert run(spark, []) == []


def test_an_id_with_several_vectors(spark):
    one, near, far = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [3.0, -1.0, 0.0]
    given = [(1, one, 1), (1, near, 1), (2, [1.0, 2.0, 3.02], 1)]
    assert run(spark, given) == brute(given) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    given += [(1, one, 2), (5, near, 2), (1, far, 1), (7, far, 1), (7, one, 1), (7, one, 1)]
    assert run(spark, given) == brute(given)


def test_decoded_lists_are_the_exceeding_directions():
    code = Code(16, 200)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.turn
    parts = [turned[:, a:b] @ c.T for a, b, c in zip(code.cuts, code.cuts[1:], code.codes)]
    assert code.m == 2
    for v, found in enumerate(code.decode(x)):
        value = (parts[0][v][:, None] + parts[1][v][None, :]).ravel()
        over = np.flatnonzero(value >= code.least)
        want = over if len(over) >= 24 else np.argsort(-value, kind="stable")[:24]
        assert found.tolist() == sorted(want.tolist())


def test_recall_at_the_threshold():
    code = Code(64, 50_000)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * y
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(near))]
    assert np.mean(met) >= 0.99


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 200 + i) for i in range(50)] + [(5, 5), (None, 3), (9, 8), (9, 8)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{200 + i: 7 for i in range(50)}, 9: 8, 8: 8}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
