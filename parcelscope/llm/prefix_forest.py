"""Nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long hash string: symbols of four bits, each the
nearest of the sixteen corners of a cross-polytope after a random projection
to eight dimensions.  A tree is the array of its strings in sorted order; the
entries that share a prefix with a query are one run of it.  A query descends
to its longest prefix match in every tree and then ascends in all trees at
once, giving up one bit after the other, until the runs of all trees together
have ``ENOUGH`` entries: the prefix length varies with how densely the
space is filled there.  All entries of these runs are candidates, none is
capped, and each is scored in double precision on the original vectors.

Inner products of vectors of different length: vectors are put into bands of
length (``BANDS`` to a factor of two); within a band a vector is divided by the
longest length and gets one more component that makes it a unit vector, a
query gets a zero there.  Every band is a forest of its own, so a few very
long vectors do not press all others together.

On the cluster a sorted array is cut into cells of equal prefix: (forest,
tree, depth, prefix).  The depth follows the number of entries, so that a
cell has a few times the share of one tree; a cell over ``CELL`` entries is cut
at longer prefixes, and one of equal strings by a hash of the ids.  One pass
over the cells gives every query its run lengths, their sums the common
prefix length; a query that finds too little in its cells goes on to the
prefixes above them, whose counts are sums of the cells'.  A second pass
emits the ids of the runs, coded as gaps and split by block of vectors;
a block holds about ``BLOCK`` vectors and streams the queries past them.

Exact copies: of equal vectors only the ``k + 1`` smallest ids can be among
the best of any query (equal scores go by id), so only they are indexed;
nothing is lost.

Edge cases.  A vector that is null, empty, zero or holds a null or
non-finite component, or has no id, takes no part.  Vectors of different
dimension are never compared.  Each row of a repeated id is a vector: it can
be a candidate and, if a query, has ranks of its own; a query leaves out
exactly one row that equals it in id and vector.  Fewer candidates than ``k``
give fewer rows.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelscope.llm.common import stored, table

BEST = 20
TREES = 64
SYMBOLS = 15                # of four bits each
BITS = 4 * SYMBOLS
ENOUGH = 16_000             # candidates of a query, added up over the trees
CELL = 1 << 18              # entries that a task holds at once
BANDS = 4                   # of length, to a factor of two
STEP = 4                    # bits by which larger cells are cut deeper
BLOCK = 32_768              # vectors scored by a task at once
LEAST_BLOCKS = 8            # so that small tables are spread as well
SEED = 20250117
KEY = ["forest", "tree", "depth", "prefix", "chunk"]
PIECES = "forest int, tree int, depth int, prefix bigint, chunk int, kind int, n bigint, data binary"
RUNS = ("qrow bigint, forest int, tree int, depth int, prefix bigint, chunk int, code bigint, "
        "base int, counts array<bigint>")
PACKS = "block int, qrow bigint, data binary"
FOUND = "qrow bigint, query_id bigint, vec_id bigint, score double"


@lru_cache(maxsize=8)
def projections(dim: int, trees: int) -> np.ndarray:
    """(trees, dim + 1, SYMBOLS * 8): eight orthogonal directions a symbol."""
    rng = np.random.default_rng([SEED, dim])
    out = rng.standard_normal((trees, SYMBOLS, dim + 1, 8))
    if dim >= 8:
        out = np.linalg.qr(out)[0]
    return np.ascontiguousarray(out.transpose(0, 2, 1, 3).reshape(trees, dim + 1, SYMBOLS * 8))


def codes(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Hash strings of rows of unit vectors in one tree, as 60-bit numbers."""
    y = (x @ tree).reshape(len(x), SYMBOLS, 8)
    at = np.abs(y).argmax(axis=2)
    sign = np.take_along_axis(y, at[:, :, None], axis=2)[:, :, 0] < 0
    symbol = at * 2 + sign
    out = np.zeros(len(x), np.int64)
    for s in range(SYMBOLS):
        out = (out << 4) | symbol[:, s]
    return out


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def prefix_of(code, depth):
    return code >> (BITS - depth)


def pack_pairs(code: np.ndarray, ids: np.ndarray) -> bytes:
    return code.astype("<i8").tobytes() + ids.astype("<i8").tobytes()


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, "<i8")
    return both[:len(both) // 2], both[len(both) // 2:]


def pack_ids(ids: np.ndarray) -> bytes:
    """Sorted ids as a first id and gaps of the least width."""
    gaps = np.diff(ids)
    width = 2 if not len(gaps) or gaps.max() < 1 << 16 else 4 if gaps.max() < 1 << 32 else 8
    return bytes([width]) + ids[:1].astype("<i8").tobytes() + gaps.astype(f"<u{width}").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.int64)
    return np.cumsum(np.append(np.frombuffer(data, "<i8", 1, 1), gaps))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


class Forests:
    """What the tasks have to know: per forest its dimension, longest vector
    and base depth."""

    def __init__(self, rows: list, trees: int, enough: int):
        self.trees, self.enough = trees, enough
        self.by_key = {(r.dim, r.band): i for i, r in enumerate(rows)}
        self.longest = [r.longest for r in rows]
        self.depth = [min(BITS, max(0, math.floor(math.log2(r.n * trees / enough)) - 1)) for r in rows]
        self.of_dim: dict[int, list[int]] = {}
        for (dim, _), i in sorted(self.by_key.items()):
            self.of_dim.setdefault(dim, []).append(i)


def _pieces(forest: int, tree: int, depth: int, kind: int, code: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(code, kind="stable")
    code, ids = code[order], ids[order]
    prefix = prefix_of(code, depth)
    cut = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(code) else []
    for a, b in zip(cut, [*cut[1:], len(code)]):
        yield forest, tree, depth, int(prefix[a]), 0, kind, int(b - a), pack_pairs(code[a:b], ids[a:b])


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(),
             "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)],
                                      [name for name, _ in fields])


def entry_pieces(index: DataFrame, forests: Forests) -> DataFrame:
    """Sorted pieces of every tree from ``(vec_id, embedding, dim, band)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, bands = (b.column(c).to_numpy() for c in (0, 2, 3))
            for dim, band in sorted(set(zip(dims.tolist(), bands.tolist()))):
                own = np.flatnonzero((dims == dim) & (bands == band))
                forest = forests.by_key[dim, band]
                x = _matrix(b.column(1).take(pa.array(own)), dim) / forests.longest[forest]
                more = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
                x = np.column_stack((x, more))
                for t, tree in enumerate(projections(dim, forests.trees)):
                    yield _batch(list(_pieces(forest, t, forests.depth[forest], 0, codes(x, tree), ids[own])), PIECES)

    return index.select("vec_id", "embedding", "dim", "band").mapInArrow(run, PIECES)


def query_pieces(queries: DataFrame, forests: Forests) -> DataFrame:
    """The same of ``(qrow, embedding, dim)``, in every forest of the dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims = b.column(0).to_numpy(), b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = _matrix(b.column(1).take(pa.array(own)), dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))))
                for t, tree in enumerate(projections(dim, forests.trees)):
                    code = codes(x, tree)
                    for forest in forests.of_dim.get(dim, ()):
                        yield _batch(list(_pieces(forest, t, forests.depth[forest], 1, code, ids[own])), PIECES)

    return queries.select("qrow", "embedding", "dim").mapInArrow(run, PIECES)


def cut_large(pieces: DataFrame, cell: int) -> DataFrame:
    """Pieces with every cell of more than ``cell`` entries cut at longer
    prefixes, and by a hash of the ids where whole strings are equal (its
    queries then go to each part)."""
    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                code, ids = unpack_pairs(r["data"])
                if r["depth"] < BITS:
                    out += _pieces(r["forest"], r["tree"], min(BITS, r["depth"] + STEP), r["kind"], code, ids)
                    continue
                parts = -(-r["total"] // cell)
                chunk = block_of(ids, parts)
                for c in range(parts):
                    own = slice(None) if r["kind"] else chunk == c
                    if len(code[own]):
                        out.append((r["forest"], r["tree"], BITS, r["prefix"], c + 1, r["kind"], len(code[own]),
                                    pack_pairs(code[own], ids[own])))
            yield _batch(out, PIECES)

    whole = pieces
    while True:
        large = stored(whole.where("kind = 0 and chunk = 0").groupBy("forest", "tree", "depth", "prefix")
                       .agg(F.sum("n").alias("total")).where(F.col("total") > cell), "large_cells")
        if large.isEmpty():
            return whole
        # parts of equal strings have chunks from 1 on and are not cut again
        marked = whole.join(large.withColumn("chunk", F.lit(0)), KEY, "left")
        again = marked.where("total is not null").select(*KEY, "kind", "n", "data", "total").mapInArrow(deeper, PIECES)
        whole = stored(marked.where("total is null").select(*whole.columns).unionByName(again), "pieces")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(key, codes, ids, queries)`` per cell of rows sorted by cell and kind:
    entries in order of their strings, queries as rows of the input."""
    at, code, ids, asked = None, [], [], []

    def cell():
        c = np.concatenate(code) if code else np.zeros(0, np.int64)
        i = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        order = np.argsort(c, kind="stable")
        return at, c[order], i[order], asked

    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[c] for c in KEY)
            if key != at:
                if asked:
                    yield cell()
                at, code, ids, asked = key, [], [], []
            if r["kind"]:
                asked.append(r)
            else:
                one, two = unpack_pairs(r["data"])
                code.append(one)
                ids.append(two)
    if asked:
        yield cell()


def _cells(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "kind")


def run_lengths(pieces: DataFrame, forests: Forests) -> DataFrame:
    """``RUNS``: for each query and cell the number of entries that share a
    prefix of ``base``, ``base + 1``, ... bits with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (forest, tree, depth, prefix, chunk), code, _, asked in _by_cell(batches):
            base = forests.depth[forest]
            pairs = [unpack_pairs(r["data"]) for r in asked]
            q, rows = (np.concatenate(p) for p in zip(*pairs))
            counts = [np.full(len(q), len(code))] * (depth - base)     # a shorter prefix has the whole cell
            for x in range(depth, BITS + 1):
                short, ask = prefix_of(code, x), prefix_of(q, x)
                counts.append(np.searchsorted(short, ask, "right") - np.searchsorted(short, ask, "left"))
                if not counts[-1].any():
                    break
            table_ = np.stack(counts, axis=1)
            used = (table_ > 0).sum(axis=1)
            yield _batch([(int(r), forest, tree, depth, prefix, chunk, int(c), base, t[:max(1, u)].tolist())
                          for r, c, t, u in zip(rows, q, table_, used)], RUNS)

    return _cells(pieces).mapInArrow(run, RUNS)


def _shorter(code: Column, level: Column) -> Column:
    """The first ``level`` bits of a string."""
    return F.call_function("shiftright", code, (F.lit(BITS) - level).cast("int"))


def common_levels(runs: DataFrame, cells: DataFrame, queries: DataFrame, forests: Forests) -> DataFrame:
    """``(qrow, forest, level)``: the longest common prefix length at which
    the runs of all trees together have enough entries."""
    total = (runs.select("qrow", "forest", F.col("base"), F.posexplode("counts").alias("up", "n"))
             .groupBy("qrow", "forest", (F.col("base") + F.col("up")).alias("level")).agg(F.sum("n").alias("n")))
    closed = [stored(total.where(F.col("n") >= forests.enough).groupBy("qrow", "forest")
                     .agg(F.max("level").alias("level")), "levels")]
    spark = runs.sparkSession
    base = spark.createDataFrame(list(enumerate(forests.depth)), "forest int, base int")
    open_ = stored(queries.join(closed[0], ["qrow", "forest"], "left_anti"), "open")
    # above the cells: counts of shorter prefixes, two bits at a time
    counts, up = None, 0
    while not open_.isEmpty():
        up += 2
        level = F.greatest(F.col("base") - up, F.lit(0))
        if counts is None:
            start = _shorter(F.call_function("shiftleft", F.col("prefix"), (F.lit(BITS) - F.col("depth")).cast("int")),
                             level)
            counts = cells.join(base, "forest")
        else:
            start = F.call_function("shiftright", F.col("above"), (F.greatest(F.col("base") - up + 2, F.lit(0))
                                                                    - level).cast("int"))
            counts = counts.join(base, "forest")
        counts = stored(counts.select("forest", "tree", start.alias("above"), "n")
                        .groupBy("forest", "tree", "above").agg(F.sum("n").alias("n")), "counts_above")
        asked = open_.join(base, "forest").select(
            "qrow", "forest", level.alias("level"), F.explode("codes").alias("c")).select(
            "qrow", "forest", "level", F.col("c.tree").alias("tree"), _shorter(F.col("c.code"), F.col("level")).alias("above"))
        found = (asked.join(counts, ["forest", "tree", "above"], "left").groupBy("qrow", "forest", "level")
                 .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
        closed.append(stored(found.where((F.col("n") >= forests.enough) | (F.col("level") == 0))
                             .select("qrow", "forest", "level"), "levels"))
        open_ = stored(open_.join(closed[-1], ["qrow", "forest"], "left_anti"), "open")
    return reduce(DataFrame.unionByName, closed)


def candidate_packs(pieces: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """``PACKS`` from the entries and requests ``(cell, qrow, code, level)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, depth, _, _), code, ids, asked in _by_cell(batches):
            part = block_of(ids, blocks)
            out = []
            for r in asked:
                lo, hi, level = 0, len(code), r["level"]
                if level > depth:
                    own = prefix_of(r["code"], level) << (BITS - level)
                    lo, hi = np.searchsorted(code, [own, own + (1 << (BITS - level))])
                order = np.lexsort((ids[lo:hi], part[lo:hi]))
                near, where = ids[lo:hi][order], part[lo:hi][order]
                cut = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(near) else []
                out += [(int(where[a]), r["qrow"], pack_ids(near[a:b])) for a, b in zip(cut, [*cut[1:], len(near)])]
            for at in range(0, len(out), 4096):
                yield _batch(out[at:at + 4096], PACKS)

    entries = pieces.where("kind = 0").select(*KEY, "kind", "data", F.lit(None).cast("bigint").alias("qrow"),
                                              F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("int").alias("level"))
    requests = asked.select(*KEY, F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("data"), "qrow", "code", "level")
    return _cells(entries.unionByName(requests)).mapInArrow(run, PACKS)


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added up component by component in order."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += x[:, j] * q[j]
    return total


def score(vectors: DataFrame, queries: DataFrame, packs: DataFrame, blocks: int, k: int) -> DataFrame:
    """``FOUND``: the best ``k`` of each query in each block."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(b.column(0).to_numpy(), blocks)), *b.columns],
                                             ["block", "vec_id", "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, asking, rows = None, {}, None, {}

        def best(q: dict, wanted: list) -> list:
            vec = np.array(q["embedding"], np.float64)
            ids, x = rows.get(len(vec), (np.zeros(0, np.int64), np.zeros((0, len(vec)))))
            wanted = np.unique(np.concatenate(wanted))
            lo, hi = np.searchsorted(ids, wanted, "left"), np.searchsorted(ids, wanted, "right")
            spot = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange(int((hi - lo).sum()))
            own = spot[ids[spot] == q["vec_id"]]
            own = own[(x[own] == vec).all(axis=1)][:1]
            spot = np.setdiff1d(spot, own, assume_unique=True)
            if len(spot) > k:
                near = x[spot] @ vec
                slack = 1e-12 * np.abs(vec).sum() * np.abs(x[spot]).max()
                spot = spot[near >= np.partition(near, -k)[-k] - slack]
            exact = dot(x[spot], vec)
            order = np.lexsort((ids[spot], -exact))[:k]
            return [(q["qrow"], q["vec_id"], int(ids[s]), float(v)) for s, v in zip(spot[order], exact[order])]

        def close() -> Iterator[pa.RecordBatch]:
            if asking is not None and asking[1]:
                yield _batch(best(*asking), FOUND)

        for b in batches:
            for r in b.to_pylist():
                if r["block"] != at:
                    yield from close()
                    at, held, asking, rows = r["block"], {}, None, {}
                if r["phase"] == 0:
                    held.setdefault(len(r["embedding"]), []).append(
                        (r["vec_id"], np.array(r["embedding"], np.float64)))
                    continue
                if held:
                    for dim, some in held.items():
                        some.sort(key=lambda v: v[0])
                        rows[dim] = np.array([i for i, _ in some], np.int64), np.stack([v for _, v in some])
                    held = {}
                if r["data"] is None:
                    yield from close()
                    asking = r, []
                else:
                    asking[1].append(unpack_ids(r["data"]))
        yield from close()

    none = F.lit(None)
    entries = vectors.select("vec_id", "embedding").mapInArrow(
        spread, "block int, vec_id bigint, " + f"embedding {vectors.schema['embedding'].dataType.simpleString()}").select(
        "block", F.lit(0).alias("phase"), none.cast("bigint").alias("qrow"), none.cast("binary").alias("data"),
        "vec_id", "embedding")
    asked = packs.select("block", "qrow").distinct().join(queries.select("qrow", "vec_id", "embedding"), "qrow").select(
        "block", F.lit(1).alias("phase"), "qrow", none.cast("binary").alias("data"), "vec_id", "embedding")
    given = packs.select("block", F.lit(1).alias("phase"), "qrow", "data", none.cast("bigint").alias("vec_id"),
                         none.cast(vectors.schema["embedding"].dataType).alias("embedding"))
    rows = entries.unionByName(asked).unionByName(given)
    return (rows.repartition(blocks, "block")
            .sortWithinPartitions("block", "phase", "qrow", F.col("data").isNotNull()).mapInArrow(run, FOUND))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = BEST,
            trees: int = TREES, enough: int = ENOUGH, cell: int = CELL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best found for every row
    for which ``is_query`` (over ``vec_id``) holds, against all others."""
    kind = "array<double>" if "double" in vectors.schema[vec_col].dataType.simpleString() else "array<float>"
    v = F.col("embedding")
    fine = (F.col("vec_id").isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    length = F.least(F.lit(1e308), top * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))))
    rows = stored(vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast(kind).alias("embedding"))
                  .where(F.coalesce(fine, F.lit(False)))
                  .select("vec_id", "embedding", F.size(v).alias("dim"), length.alias("length"))
                  .withColumn("band", F.round(BANDS * F.log2("length")).cast("int"))
                  .withColumn("qrow", F.monotonically_increasing_id()), "vectors")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    index = stored(rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
                   .select("vec_id", "embedding", "dim", "band", "length"), "index")
    # one row a dimension and band of length
    forests = Forests(index.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
                      .orderBy("dim", "band").collect(), trees, enough)
    blocks = max(LEAST_BLOCKS, math.ceil(index.count() / BLOCK))
    queries = rows.where(is_query)
    pieces = cut_large(stored(entry_pieces(index, forests).unionByName(query_pieces(queries, forests)), "pieces"), cell)
    runs = stored(run_lengths(pieces, forests), "runs")
    cells = pieces.where("kind = 0").groupBy(*KEY).agg(F.sum("n").alias("n"))
    strings = runs.groupBy("qrow", "forest").agg(F.collect_set(F.struct("tree", "code")).alias("codes"))   # one a tree
    levels = stored(common_levels(runs, cells, strings, forests), "levels")
    asked = runs.select("qrow", *KEY, "code", "base").join(levels, ["qrow", "forest"])
    own = asked.where(F.col("level") >= F.col("base"))
    # a shorter prefix than the cells': every cell under it
    above = asked.where(F.col("level") < F.col("base")).select(
        "qrow", "forest", "tree", "code", "level", _shorter(F.col("code"), F.col("level")).alias("above")).distinct()
    used = levels.select("forest", "level").distinct().groupBy("forest").agg(F.collect_set("level").alias("lv"))
    under = (cells.join(used, "forest").withColumn("level", F.explode("lv")).where(F.col("level") < F.col("depth"))
             .withColumn("above", F.call_function("shiftright", F.col("prefix"),
                                                  (F.col("depth") - F.col("level")).cast("int")))
             .select(*KEY, "level", "above"))
    wider = above.join(under, ["forest", "tree", "level", "above"])
    requests = own.select(*KEY, "qrow", "code", "level").unionByName(wider.select(*KEY, "qrow", "code", "level"))
    packs = stored(candidate_packs(pieces, requests, blocks), "candidates")
    found = score(index, queries, packs, blocks, k)
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op13_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
