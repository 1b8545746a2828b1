"""Embedding near-duplicates by spherical-cap filters.

A vector, after a random rotation, is cut into ``m`` blocks; each block has
its own random unit code words, and a filter direction is one word per block
(a random product code: K words per block make K**m directions).  The list of
all directions whose inner product with the vector exceeds a threshold is
decoded block by block, dropping a partial sum as soon as the best remaining
words cannot lift it over the threshold; a vector with fewer than ``floor``
such directions takes its ``floor`` best.  Vectors that share a direction
(and label and dimension) meet in a bucket and are verified there in double
precision.  The number of directions follows the number of vectors, so that
unrelated vectors rarely meet at any size.

Equal vectors are one node with a multiplicity from the start.  Buckets of
one vector are dropped before vectors are shipped.  A bucket of any size is
cut into chunks of about ``CHUNK`` vectors; each pair of chunks is a block of
its own, so no task ever holds a bucket.  A block counts a link only at the
pair's first shared direction, and emits per vector its number of links and
a spanning forest of the links, never the pairs themselves.

Edge cases.  A vector that is null, empty, zero or holds a null or
non-finite component, or has a null label or id, links with nothing
(component_id is its own id).  Vectors of different dimension are never
compared.  Each row is a vector of its own, also where an id repeats: its
links are those of its own vector, and rows of one id are connected only by
links.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import stored, table
from parcelscope.llm.components import connected_components

EXPECTED = 32       # filter directions per vector, on average over the sphere
FLOOR = 24          # and at least
MAX_WORDS = 2048    # code words per block; beyond it another block
CHUNK = 256
SMALL = 16          # buckets up to this size are compared pair by pair, many at once
SEED = 20240611
FILTERS = "rep bigint, filters array<bigint>"
FOUND = "a bigint, b bigint, n bigint"


class Code:
    """Product code for one dimension and number of vectors."""

    def __init__(self, dim: int, count: int):
        want = max(count, 16) * EXPECTED
        self.m = m = min(dim, max(2, math.ceil(math.log(want) / math.log(MAX_WORDS))))
        self.words = k = max(2, math.ceil(want ** (1 / m)))
        rng = np.random.default_rng([SEED, dim, m, k])
        self.turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.cuts = [dim * b // m for b in range(m + 1)]
        self.codes = []
        for b in range(m):
            c = rng.standard_normal((k, self.cuts[b + 1] - self.cuts[b]))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(m))
        share = min(0.5, EXPECTED / float(k) ** m)
        self.least = NormalDist().inv_cdf(1 - share) / math.sqrt(dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted direction numbers of each unit vector."""
        turned = unit @ self.turn
        sums = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]
        best = np.stack([s.max(axis=1) for s in sums], axis=1)
        rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1]     # best of blocks b.. on
        out = []
        for v in range(len(unit)):
            ids, part = np.zeros(1, np.int64), np.zeros(1)
            for b, s in enumerate(sums):
                ahead = rest[v, b + 1] if b + 1 < self.m else 0.0
                word = np.flatnonzero(s[v] >= self.least - ahead - part.max()) if len(part) else ids[:0]
                total = (part[:, None] + s[v][word]).ravel()
                good = total >= self.least - ahead
                ids = (ids[:, None] * self.words + word).ravel()[good]
                part = total[good]
                if not len(part):
                    break
            if len(ids) < FLOOR:
                ids = self._best(sums, v)
            out.append(np.sort(ids))
        return out

    def _best(self, sums: list[np.ndarray], v: int) -> np.ndarray:
        ids, part = np.zeros(1, np.int64), np.zeros(1)
        for s in sums:
            word = np.argpartition(-s[v], FLOOR)[:FLOOR] if s.shape[1] > FLOOR else np.arange(s.shape[1])
            total = (part[:, None] + s[v][word]).ravel()
            ids = (ids[:, None] * self.words + word).ravel()
            top = np.argsort(-total, kind="stable")[:FLOOR]
            ids, part = ids[top], total[top]
        return ids


@lru_cache(maxsize=8)
def code(dim: int, count: int) -> Code:
    return Code(dim, count)


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def decode_filters(classes: DataFrame, count: int) -> DataFrame:
    """``(rep, filters)`` of every row of ``(rep, embedding)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rep, vec = batch.column(0).to_numpy(), batch.column(1)
                size = vec.value_lengths().to_numpy()
                for dim in np.unique(size):
                    own = np.flatnonzero(size == dim)
                    x = unit_rows(vec.take(pa.array(own)).flatten().to_numpy(), int(dim))
                    found = code(int(dim), count).decode(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rep[own]), pa.array(found, pa.list_(pa.int64()))], ["rep", "filters"])

    return classes.select("rep", "embedding").mapInArrow(run, FILTERS)


class Finder:
    """Links of one task's blocks.  Rows come sorted by block."""

    def __init__(self, least: float):
        self.least = least
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block(self, x, rep, mult, side, filters, at) -> None:
        """One block: all pairs of its one chunk, or across its two."""
        left = np.flatnonzero(side == 0) if (side == 1).any() else np.arange(len(rep))
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        links = x[left] @ x[right].T >= self.least
        links &= rep[left][:, None] != rep[right][None, :]
        if not links.any():
            return
        # a pair counts at its first shared direction: drop those that share an earlier one
        early = [f[f < at] for f in filters]
        names, code_ = np.unique(np.concatenate(early), return_inverse=True)
        if len(names):
            owner = np.repeat(np.arange(len(rep)), [len(e) for e in early])
            has = np.zeros((len(rep), len(names)), np.float32)
            has[owner, code_] = 1
            links &= (has[left] @ has[right].T) == 0
        self._emit(links, rep[left], rep[right], mult[left], mult[right], one=right is left)

    def _emit(self, links, left, right, m_left, m_right, one: bool) -> None:
        n = (links * m_right[None, :]).sum(axis=1)
        own = n > 0
        self._add(left[own], left[own], n[own])
        if not one:
            n = (links * m_left[:, None]).sum(axis=0)
            own = n > 0
            self._add(right[own], right[own], n[own])
        a, b = np.nonzero(links)
        nodes, ids = np.unique(np.concatenate((left, right)), return_inverse=True)
        root = np.arange(len(nodes))
        a, b = ids[:len(left)][a], ids[len(left):][b]
        while True:                 # smallest label over the links, with jumps
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        own = root != np.arange(len(nodes))
        self._add(nodes[root[own]], nodes[own], np.zeros(own.sum(), np.int64))

    def _add(self, a, b, n) -> None:
        if len(a):
            self.out.append((a, b, n))

    def small(self, x, rep, mult, filters, key_filter, start, size) -> None:
        """All buckets of at most SMALL rows, as one list of pairs."""
        for s in np.unique(size):
            first = start[size == s]
            i, j = np.triu_indices(int(s), 1)
            a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            near = (np.einsum("ij,ij->i", x[a], x[b]) >= self.least) & (rep[a] != rep[b])
            a, b = a[near], b[near]
            if not len(a):
                continue
            keep = np.array([not len(np.intersect1d(filters[p][filters[p] < key_filter[p]],
                                                    filters[q][filters[q] < key_filter[p]],
                                                    assume_unique=True))
                             for p, q in zip(a.tolist(), b.tolist())], bool)
            a, b = a[keep], b[keep]
            self._add(rep[a], rep[a], mult[b])
            self._add(rep[b], rep[b], mult[a])
            self._add(np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b]), np.zeros(len(a), np.int64))

    def batch(self) -> pa.RecordBatch:
        a, b, n = (np.concatenate(c) if self.out else np.zeros(0, np.int64)
                   for c in (zip(*self.out) if self.out else ((), (), ())))
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (a, b, n)], ["a", "b", "n"])


def verify(rows: DataFrame, least: float) -> DataFrame:
    """Links of rows ``(label, dim, filter, p, q, side, rep, mult, filters,
    embedding)`` sorted by (label, dim, filter, p, q): rows (a, a, n) say that
    a has n more links, rows (a, b, 0) that a and b are connected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        finder = Finder(least)

        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.column_stack([rows[c].combine_chunks().to_numpy() for c in ("label", "dim", "filter", "p", "q")])
            rep, mult, side = (rows[c].combine_chunks().to_numpy() for c in ("rep", "mult", "side"))
            lists = rows["filters"].combine_chunks()
            cut = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            flat = lists.flatten().to_numpy()
            filters = [flat[i:j] for i, j in zip(cut[:-1], cut[1:])]
            vec = rows["embedding"].combine_chunks()
            start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            size = np.diff(np.append(start, len(keys)))
            for dim in np.unique(keys[start, 1]):
                own = keys[start, 1] == dim
                inside = np.flatnonzero(keys[:, 1] == dim)
                x = np.zeros((len(keys), int(dim)))
                x[inside] = unit_rows(vec.take(pa.array(inside)).flatten().to_numpy(), int(dim))
                few = own & (size <= SMALL) & (keys[start, 3] == keys[start, 4])
                finder.small(x, rep, mult, filters, keys[:, 2], start[few], size[few])
                for s, n in zip(start[own & ~few], size[own & ~few]):
                    part = slice(s, s + n)
                    finder.block(x[part], rep[part], mult[part], side[part], filters[part], keys[s, 2])
            yield finder.batch()

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = pa.Table.from_batches([batch.slice(at, 2048)])
                rows = pa.concat_tables([held, rows]) if held is not None else rows
                # the last block may go on in the next piece
                last = [rows[c][-1].as_py() for c in ("label", "dim", "filter", "p", "q")]
                tail = rows.num_rows
                same = np.ones(rows.num_rows, bool)
                for c, value in zip(("label", "dim", "filter", "p", "q"), last):
                    same &= rows[c].combine_chunks().to_numpy() == value
                tail = int(np.flatnonzero(same)[0])
                held = rows.slice(tail)
                if tail:
                    yield from work(rows.slice(0, tail))
        if held is not None and held.num_rows:
            yield from work(held)

    return rows.mapInArrow(run, FOUND)


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", least: float = 0.98) -> DataFrame:
    """``(row_id, n_links, component_id)`` for every row: vectors of equal
    label whose cosine is at least ``least`` are linked."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(label_col).alias("label"),
                          F.col(vec_col).alias("embedding"))
    number = F.col("embedding")
    fine = (F.col("row_id").isNotNull() & F.col("label").isNotNull() & (F.size(number) > 0)
            & F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
            & F.exists(number, lambda v: v != 0))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # labels of any type become numbers; equal vectors of a label become one class
    names = stored(rows.where("fine").select("label").distinct()
                   .select("label", F.xxhash64("label").alias("label_key")), "label_keys")
    classes = stored(rows.where("fine").groupBy("label", "embedding")
                     .agg(F.min("row_id").alias("first_id"), F.count("*").alias("mult"))
                     .join(names, "label")
                     # the class's own number; ids may repeat over classes
                     .select(F.monotonically_increasing_id().alias("rep"), "first_id", "mult", "label", F.col("label_key"), "embedding",
                             F.size("embedding").cast("bigint").alias("dim")), "classes")
    count = classes.count()
    listed = stored(decode_filters(classes, count), "filter_lists")
    info = classes.select("rep", "label_key", "dim", "mult", "embedding")
    spots = listed.join(info.drop("embedding"), "rep").select(
        F.col("label_key").alias("label"), "dim", F.explode("filters").alias("filter"), "rep", "mult")
    spots = stored(spots, "spots")
    met = stored(spots.groupBy("label", "dim", "filter").agg(F.count("*").alias("n"))
                 .where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK)), "met")
    chunk = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("chunks"))
    placed = (spots.join(met, ["label", "dim", "filter"]).withColumn("own", chunk)
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
              .select("label", "dim", "filter", F.least("own", "other").alias("p"),
                      F.greatest("own", "other").alias("q"),
                      F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "mult"))
    placed = stored(placed, "placed")
    full = placed.join(listed, "rep").join(info.select("rep", "embedding"), "rep")
    key = ["label", "dim", "filter", "p", "q"]
    parts = max(8, min(20_000, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = stored(verify(full.select(*key, "side", "rep", "mult", "filters", "embedding")
                          .repartition(parts, *key).sortWithinPartitions(*key), least), "found")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("a <> b").select("a", "b"))
    linked = stored(labels.join(classes.select(F.col("rep").alias("node"), "first_id"), "node"), "linked")
    least_id = linked.groupBy("label").agg(F.min("first_id").alias("component"))
    linked = linked.join(least_id, "label").select(F.col("node").alias("rep"), "component")
    nodes = stored(classes.join(links, "rep", "left").join(linked, "rep", "left")
                   .where("mult > 1 or n is not null")
                   .select("first_id", "embedding", F.col("label").alias("l"), "mult",
                           (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                           F.coalesce("component", "first_id").alias("component")), "nodes")
    # a copy finds its class by the vector itself, a lone vector by its id
    # and a hash of the vector (which only has to tell one id's vectors apart)
    copies = nodes.where("mult > 1").select("l", F.col("embedding").alias("e"), F.col("n_links").alias("n1"),
                                            F.col("component").alias("c1"))
    single = nodes.where("mult = 1").select("first_id", F.col("l").alias("l2"), F.xxhash64("embedding").alias("h2"),
                                            F.col("n_links").alias("n2"), F.col("component").alias("c2"))
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    return (rows.join(copies, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("fine"), "left")
            .join(single, (F.col("row_id") == F.col("first_id")) & (F.col("label") == F.col("l2"))
                  & (F.col("h") == F.col("h2")) & F.col("fine"), "left")
            .select("row_id", F.coalesce("n1", "n2", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("c1", "c2", "row_id").alias("component_id")))


def op1_cap_filter_neardup(spark, sf_dir: str) -> DataFrame:
    found = cosine_links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("row_id").alias("vec_id"), "n_links", "component_id",
                        (F.col("row_id") == F.col("component_id")).alias("kept"))
