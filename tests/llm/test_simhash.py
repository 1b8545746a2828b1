import random
import re

import xxhash

from parcelscope.llm.simhash import close_pairs, fingerprint, keep_first, op7_simhash_groups, simhash_groups
from tests.llm.common import docs, rows


def brute_fingerprint(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, distance):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, smoke_dir):
    got = {r.doc_id: r for r in op7_simhash_groups(spark, smoke_dir).collect()}
    fps = {i: brute_fingerprint(t, 3) for i, t in rows(smoke_dir, "documents", "doc_id", "text")}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, 2)


def test_close_pairs_at_every_distance(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    near = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            for _ in range(6):
                near.add(b ^ sum(1 << p for p in rng.sample(range(64), n)))
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    table = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for distance in (0, 1, 2, 3, 4):
        got = [tuple(r) for r in close_pairs(table, distance).collect()]
        want = {(a, b) for a in signed for b in signed
                if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        assert len(got) == len(set(got)) and set(got) == want


def test_the_signatures_are_never_broadcast(spark):
    # 33 of them a fingerprint, of which Spark's estimate knows nothing
    pairs = close_pairs(spark.createDataFrame([(x,) for x in (0, 1, 3, 1 << 40)], "fp bigint"), 2)
    assert sorted(tuple(r) for r in pairs.collect()) == [(0, 1), (0, 3), (0, 1 << 40), (1, 3), (1, 1 << 40)]
    ran = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in ran and "Broadcast" not in ran


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    given = [(5, None), (6, ""), (7, " \t\n"), (1, "one"), (2, "ONE"), (3, "two words"), (None, "one"),
             (9, long), (8, long), (9, long)]
    got = sorted([(r.row_id, r.fp, r.component_id) for r in simhash_groups(docs(spark, given, clash=True)).collect()],
                 key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(given)
    assert by[5][1] == by[6][1] == by[7][1] == 0 and by[7][2] == 5
    assert by[2][2] == by[1][2] == by[None][2] == 1 and by[9][2] == 8
    assert fingerprint("a b c d", 3) != fingerprint("a b d c", 3)


def test_keep_first(spark):
    given = [(4, "same text here now"), (2, "same text here now"), (3, "quite another text"), (3, "quite another text"),
             (None, "same text here now")]
    kept = keep_first(docs(spark, given, clash=True))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert len(kept.columns) == 15


def test_empty(spark):
    assert simhash_groups(docs(spark, [])).count() == 0
    assert keep_first(docs(spark, [])).count() == 0
