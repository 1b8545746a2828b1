"""Exact k-means over integer vectors with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid less that to
its nearest.  When centroids move, the gap of a vector of cluster c shrinks
by at most c's own step plus the longest step of any other centroid; the sum
of these over the rounds is the accumulated drift of c.  A vector stored with
the key ``gap + drift of its cluster at that time`` keeps its cluster as long
as the key is above the drift, so each cluster's vectors form a heap by key
and a round pops from it only those whose gap has expired and measures them
exactly against all centroids.

The heap is kept as sorted runs: a round writes the vectors that it measured
as one run, sorted by cluster and key inside every file, and never changes an
earlier one.  Popping is a range of keys per cluster (above the last drift,
up to the new one), which Spark pushes down to the row groups of the runs.  A
vector is alive in the run where its key is above the drift, or in the
newest.  Sums per cluster change only by the popped vectors, so a round reads
and moves what has expired and nothing else; only the centroids (``k`` rows)
pass through the driver, as exact integers.

Bounds are doubles with a margin far over their rounding error; distances and
sums are exact integers, and a tie is never settled by a bound (a gap of zero
is always expired).

Edge cases.  A vector that is null, of another length, or holds a null or
non-finite component takes no part, nor does one with a component whose
integer is 2**27 or more, since squared distances must fit in 64 bits.
Fewer vectors than ``k`` give fewer clusters; equal vectors may start several
clusters, the smallest number takes them all and the others stay where they
are, empty.  Each row of a repeated id is a vector of its own; rows without an
id start a cluster only when ids run out.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.common import stored, table

DIM = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27
ROWS = 8192                 # vectors measured at once
MARGIN = 1e-9               # relative; bounds are a few roundings from exact
RUN = "vec_id bigint, ints array<int>, old int, cluster int, key double"
SUMS = "cluster int, n bigint, sums array<bigint>"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``(vec_id, ints)`` of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                                         & (F.abs(x) < F.lit(float(LARGEST) / scale)))
    return (vectors.where(F.coalesce(fine, F.lit(False)))
            .select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.cast("array<int>").alias("ints")))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest digest of their id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = (vectors.select(digest.alias("d"), "ints")
             .orderBy(F.col("d").asc_nulls_last(), "ints").limit(k).collect())
    return np.array([r.ints for r in first], np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if x.shape[1] * (2 * reach) ** 2 < 1 << 53:          # whole numbers in doubles
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        return d.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids.astype(np.int64)], axis=1)


def _ints(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def measure(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """A run of ``(vec_id, ints, old)``: each vector's nearest centroid
    (ties: smaller number) and key; ``old`` is the cluster it came from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                d = squared(_ints(b.column(1), centroids.shape[1]), centroids)
                near = d.argmin(axis=1)
                gap = np.full(len(d), np.inf)
                if d.shape[1] > 1:
                    upper = np.sqrt(d[np.arange(len(d)), near])
                    d[np.arange(len(d)), near] = np.iinfo(np.int64).max
                    lower = np.sqrt(d.min(axis=1))
                    gap = lower - upper - MARGIN * (1 + lower + upper)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32)),
                     pa.array(gap + drift[near])], ["vec_id", "ints", "old", "cluster", "key"])

    return rows.select("vec_id", "ints", "old").mapInArrow(run, RUN)


def changes(run: DataFrame, k: int, dim: int) -> list:
    """``(cluster, n, sums)`` by which a run changes its clusters: its
    vectors join their new cluster and leave their old one.  Each task adds
    up its own rows first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x = _ints(b.column(0), dim)
            for column, sign in ((b.column(1), -1), (b.column(2), 1)):
                known = ~column.is_null().to_numpy(zero_copy_only=False)
                to = column.fill_null(0).to_numpy()
                for c in np.unique(to[known]):
                    own = known & (to == c)
                    n[c] += sign * own.sum()
                    sums[c] += sign * x[own].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])

    parts = run.select("ints", "old", "cluster").mapInArrow(add, SUMS)
    total = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))).cast("decimal(38,0)")
                                         for i in range(dim)]).alias("sums"))
    return total.collect()          # k rows


class Clustering:
    """State of the rounds: runs of measured vectors, exact sums, drift."""

    def __init__(self, vectors: DataFrame, k: int, seed: int, dim: int):
        self.dim = dim
        self.centroids = starts(vectors, k, seed).reshape(-1, dim)
        self.k = len(self.centroids)
        self.n = [0] * self.k
        self.sums = [[0] * dim for _ in range(self.k)]
        self.drifts = [np.zeros(self.k)]                 # after each round
        self.runs: list[DataFrame] = []
        if self.k:
            self._add(vectors.withColumn("old", F.lit(None).cast("int")))

    def _add(self, rows: DataFrame) -> None:
        run = measure(rows, self.centroids, self.drifts[-1])
        run = stored(run.sortWithinPartitions("cluster", "key"), "gap_run")
        self.runs.append(run)
        for r in changes(run, self.k, self.dim):
            self.n[r.cluster] += r.n
            self.sums[r.cluster] = [a + int(b) for a, b in zip(self.sums[r.cluster], r.sums)]

    def _up_to(self, drift: np.ndarray) -> Column:
        return reduce(or_, [(F.col("cluster") == c) & (F.col("key") <= float(drift[c])) for c in range(self.k)])

    def _above(self, drift: np.ndarray) -> Column:
        return reduce(or_, [(F.col("cluster") == c) & (F.col("key") > float(drift[c])) for c in range(self.k)])

    def _alive(self, i: int) -> DataFrame:
        """Vectors of run ``i`` that no later round has popped."""
        run = self.runs[i]
        return run if i == len(self.runs) - 1 else run.where(self._above(self.drifts[-1]))

    def move(self) -> None:
        """Centroids to the floor of their means; vectors whose gap has
        expired are popped from their runs and measured anew."""
        new = np.array([[s // n for s in sums] if n else c.tolist()
                        for n, sums, c in zip(self.n, self.sums, self.centroids)], np.int64)
        step = np.sqrt(((new - self.centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + MARGIN)
        other = [max((s for j, s in enumerate(step) if j != c), default=0.0) for c in range(self.k)]
        alive = [self._alive(i) for i in range(len(self.runs))]
        self.centroids = new
        self.drifts.append((self.drifts[-1] + step + np.array(other)) * (1 + MARGIN))
        popped = [rows.where(self._up_to(self.drifts[-1])) for rows in alive]
        self._add(reduce(DataFrame.unionByName, popped).select("vec_id", "ints", F.col("cluster").alias("old")))

    def result(self) -> DataFrame:
        """``(vec_id, cluster, distance)`` of every vector."""
        rows = reduce(DataFrame.unionByName, [self._alive(i) for i in range(len(self.runs))])
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    x, own = _ints(b.column(1), centroids.shape[1]), b.column(2).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(2), pa.array(((x - centroids[own]) ** 2).sum(axis=1))],
                        ["vec_id", "cluster", "distance"])

        return rows.select("vec_id", "ints", "cluster").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS,
            rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256)`` of every vector that takes part after ``rounds`` moves,
    and the centroids."""
    spark = vectors.sparkSession
    state = Clustering(stored(integer_vectors(vectors, id_col, vec_col, dim, scale), "int_vectors"), k, seed, dim)
    for _ in range(rounds if state.k else 0):
        state.move()
    if not state.k:
        found = spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint")
    else:
        found = stored(state.result(), "clustered")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()          # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in state.centroids.tolist()]
    about = spark.createDataFrame([(r.cluster, r.s, sum(x.s for x in sums), digest[r.cluster]) for r in sums],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), state.centroids


def op12_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))[0]


#: The same rounds in SQL: every vector against every centroid, each time.
_ASSIGN = """a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, d * 64 + c) AS cluster, min(d) AS distance FROM (
    SELECT v.rid, k.c, list_sum(list_transform(list_zip(v.ints, k.ints),
      lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} k) GROUP BY rid)"""
_MOVE = """s{r} AS (
  SELECT a.cluster, g.i, sum(v.ints[g.i])::BIGINT AS s, count(*) AS n
  FROM a{p} a JOIN v USING (rid) CROSS JOIN range(1, 65) g(i) GROUP BY 1, 2),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS ints FROM s{r} GROUP BY 1),
c{r} AS MATERIALIZED (
  SELECT c.c, coalesce(m.ints, c.ints) AS ints FROM c{p} c LEFT JOIN m{r} m ON m.cluster = c.c)"""
ORACLE_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS ints
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(x::DOUBLE) < 2097152)) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), ints) - 1 AS c, ints FROM v
  ORDER BY sha256('1:' || vec_id), ints LIMIT 16),
""" + ",\n".join([_ASSIGN.format(r=0), *[part.format(r=r, p=r - 1) for r in range(1, ROUNDS + 1)
                                        for part in (_MOVE, _ASSIGN)]]) + """
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.distance,
  (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.ints, ',')) AS centroid_sha256
FROM a3 a JOIN v USING (rid) JOIN c3 k ON k.c = a.cluster
"""
