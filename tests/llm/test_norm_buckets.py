import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from parcelscope.llm import norm_buckets as N

DOCS = "doc_id bigint, text string, n bigint, terms string, length int, item_id string, score double, rank int"
ITEMS = "item_id bigint, text string, doc_id string, terms int, item int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    """Every document against every item, from the definition."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in queries.items():
        rows = []
        for doc, bag in bags:
            m = 10 + 90 * bag.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in wanted if t in bag)
            if s > 0:
                rows.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(rows, key=lambda x: x[:3])[:best])]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "x", 2, "y", 0.5, 3) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], ITEMS)
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in N.rank(d, q, **kw).collect()], key=str)


def made(seed=5, n=700):
    """Texts over few frequent and many rare words, of very different length,
    with copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 3, 10, 40, 300])))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(120)]
    items = [(i, ", ".join(rng.choices(words, weight, k=rng.choice([1, 4, 20])))) for i in range(25)]
    return docs, items


def test_query_equals_sql(spark, smoke_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smoke_dir}/{t}.parquet'")
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in N.op11_norm_buckets(spark, smoke_dir).collect())
    assert got == sorted(con.execute(N.ORACLE_SQL).fetchall()) and got


def test_equals_brute_force_also_with_small_buckets_and_blocks(spark):
    docs, items = made()
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, max_terms=60) == want          # several passes


def test_pruned_search_equals_full_scores():
    """Buckets of 16, one state: every bound is used and none loses a row."""
    docs, items = made(9, 900)
    bags = [(i, Counter(terms(t))) for i, t in docs]
    vocabulary = sorted({t for _, t_ in items for t in terms(t_)})
    number = {t: k for k, t in enumerate(vocabulary)}
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = N.weights(np.array([df[t] for t in vocabulary]), n)
    vectors = []
    for i, bag in bags:
        m = 10 + 90 * bag.total() * n // length
        own = [(number[t], int(w[number[t]]) * (10 ** 9 * c // (1000 * c + 8 * m))) for t, c in bag.items() if t in number]
        vectors.append((math.sqrt(sum(float(v) ** 2 for _, v in own)), i, own))
    vectors.sort(key=lambda v: -v[0])
    vectors = [v for v in vectors if v[0] > 0]
    queries = [np.array(sorted({number[t] for t in terms(t_)})) for _, t_ in items]
    state = N.Search(queries, np.ones(len(queries), np.int64), len(vocabulary))
    seen = []
    state._search, search = (lambda q, b: (seen.append(q), search(q, b))), state._search
    for at in range(0, len(vectors), 16):
        part = vectors[at:at + 16]
        state.bucket(N.Bucket([i for _, i, _ in part], np.array([v for v, _, _ in part]),
                              np.array([len(o) for _, _, o in part]), np.array([t for _, _, o in part for t, _ in o]),
                              np.array([v for _, _, o in part for _, v in o]), len(vocabulary)))
    got = sorted([(items[q][0], r + 1, i, -s) for q, rows in enumerate(state.best) for r, (s, _, i) in enumerate(rows)],
                 key=str)
    assert got == brute(docs, items)
    assert len(seen) < 0.8 * len(queries) * (len(vectors) / 16)   # buckets are pruned


def test_edge_cases(spark):
    long = "Zebra " * 400_000 + "x" * 3_000_000 + " zebra"
    docs = [(1, "Alpha BETA-gamma"), (2, None), (3, ""), (4, "-- ,;\x00\t"), (5, long), (6, "alpha"), (6, "alpha"),
            (None, "alpha"), (7, "ÀÉ 42 straße"), (8, "àé 42"), (9, "other words here"), (10, "xyz")]
    items = [(1, "alpha?"), (2, None), (3, "..."), (4, "zebra " + "x" * 3_000_000), (5, "ÀÉ, 42"), (None, "beta"),
             (6, "gamma"), (6, "ALPHA alpha"), (7, "absent")]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert [r[2] for r in got if r[0] == 1][-1] is None             # after equal scores with an id
    assert {r[0] for r in got} == {1, 4, 5, 6, None}
    assert run(spark, [], items) == run(spark, docs, []) == []


def test_a_long_text_is_cut_at_separators(monkeypatch):
    monkeypatch.setattr(N, "PIECE", 16)
    text = "one two-Three " * 20 + "y" * 50 + " z " + "é" * 30
    assert {k.decode(): v for k, v in N.terms_of(text.encode()).items()} == dict(Counter(terms(text)))
