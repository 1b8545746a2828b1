"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: XXH64 (seed 42) of every word shingle, one vote per shingle and
bit.  Two fingerprints within ``d`` bits, cut into ``d // 2 + 1`` segments,
agree in some segment up to one bit.  Take the first such segment: all
segments before it differ in two bits or more, so segment ``k`` has at most
``d - 2 k`` bits left.  Where that leaves one bit, the index holds the
segment once for every position with that bit wiped out; where it leaves
none, it holds the segment itself.  Rows of equal signatures are joined and
the whole bit distance is verified in the join condition, which also keeps
each pair only at its first segment and its own wiped position.

Edge cases.  A null or empty text, or one of white space only, has
fingerprint zero and is linked like any other.  A text with fewer words than
a shingle is one shingle.  Repeated rows and repeated ids are returned as
often as they came in.  A null id gets a component like any other row; it is
never the smallest id unless all ids of the component are null.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import slices, stored, table
from parcelscope.llm.components import connected_components

BITS = 64
SEED = 42
HASHES_AT_ONCE = 1 << 16
FINGERPRINT = "row_id bigint, fp bigint"


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = [digest(joined[i:j], SEED)
                for i, j in zip(first[at:at + HASHES_AT_ONCE], last[at:at + HASHES_AT_ONCE])]
        raw = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """``(row_id, fp)`` for every row: the id and the signed fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            fps = [fingerprint(t, shingle) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["row_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"),
                       F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(run, FINGERPRINT)


def _cuts(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments, from the low bits up."""
    n = distance // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fps: DataFrame, distance: int) -> DataFrame:
    """``(a, b)`` with a < b for distinct fingerprints (column ``fp``) at
    most ``distance`` bits apart, each pair once."""
    cuts = _cuts(distance)
    rows = []
    for k, (low, width) in enumerate(cuts):
        mask = ((1 << width) - 1) << low
        wiped = range(width) if distance - 2 * k >= 1 else [-1]
        for p in wiped:
            keep = mask if p < 0 else mask & ~(1 << (low + p))
            rows.append(F.struct(F.lit(k * BITS + max(p, 0)).alias("slot"),
                                 F.col("fp").bitwiseAND(F.lit(_signed(keep))).alias("sig")))
    index = fps.select("fp", F.explode(F.array(*rows)).alias("v")).select("fp", "v.slot", "v.sig")
    left = index.select(F.col("fp").alias("a"), "slot", "sig")
    right = index.select(F.col("fp").alias("b"), F.col("slot").alias("slot_b"), F.col("sig").alias("sig_b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    own = F.lit(False)
    for k, (low, width) in enumerate(cuts):
        mask = F.lit(_signed(((1 << width) - 1) << low))
        here = x.bitwiseAND(mask)
        # equal segments meet at position 0 only, others at the bit they differ in
        first = (F.col("slot") == k * BITS) & (here == 0)
        if distance - 2 * k >= 1:
            for_bit = (here != 0) & (F.col("slot") >= k * BITS) & (F.col("slot") < (k + 1) * BITS)
            first = first | for_bit
        for low0, width0 in cuts[:k]:
            first = first & (F.bit_count(x.bitwiseAND(F.lit(_signed(((1 << width0) - 1) << low0)))) >= 2)
        own = own | first
    # Spark sizes the index like the fingerprints it is exploded from and would
    # broadcast it, many times its own limit
    return left.join(right.hint("merge"), (F.col("sig") == F.col("sig_b")) & (F.col("slot") == F.col("slot_b"))
                     & (F.col("a") < F.col("b")) & (F.bit_count(x) <= distance) & own).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(row_id, fp, component_id)`` for every row of ``docs``: component_id
    is the smallest id reachable over links of at most ``distance`` bits."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = stored(rows.groupBy("fp").agg(F.min("row_id").alias("first_id")), "fps")
    labels = connected_components(close_pairs(fps, distance))
    named = (fps.join(labels, fps.fp == labels.node, "left")
             .select("fp", "first_id", F.coalesce("label", "fp").alias("label")))
    named = stored(named, "named")
    least = stored(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    classes = stored(named.join(least, "label").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("row_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id.
    An id names one text: of rows that repeat the id and text, one stays."""
    groups = stored(simhash_groups(docs, id_col, text_col, shingle, distance), "groups")
    gone = (groups.where("not (row_id <=> component_id)")
            .select(F.col("row_id").alias("gone_id")).distinct())
    again = stored(groups.groupBy(F.col("row_id").alias("again_id")).count()
                   .where("count > 1").select("again_id"), "again")
    own = F.col(f"d.{id_col}")
    rest = docs.alias("d").join(gone.alias("g"), own.eqNullSafe(F.col("g.gone_id")), "left_anti")
    if again.isEmpty():
        return rest
    same = own.eqNullSafe(F.col("a.again_id"))
    return (rest.alias("d").join(again.alias("a"), same, "left_anti")
            .unionByName(rest.alias("d").join(again.alias("a"), same, "left_semi").dropDuplicates([id_col, text_col])))


def op7_simhash_groups(spark, sf_dir: str) -> DataFrame:
    g = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return g.select(F.col("row_id").alias("doc_id"),
                    F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id")
