"""Ranked lexical search by norm buckets.

A document is the sparse vector of its terms' impacts (weight times saturated
frequency, whole numbers), restricted to the terms that the queries use; a
query is the 0/1 vector of its terms, so a score is an inner product.  The
vectors are range-partitioned and sorted by length, longest first, and cut
into buckets of similar length.  For a query whose tenth best score so far is
``theta`` a bucket is skipped when the query's length times the bucket's
longest vector stays under ``theta`` (Cauchy-Schwarz), or when the sum of the
bucket's largest impact per query term does.  Inside a bucket only vectors
long enough are looked at.  The coordinates that a vector must share (without
them even the largest impacts on all others stay under ``theta``) are added
up first; a vector goes on only if that sum and a bound of the rest (the
smaller of the largest impacts and Cauchy-Schwarz on what is left of its
length) reach ``theta``.  Survivors are rescored from their own vectors in
64-bit integers.  Bounds are doubles with a margin over their rounding error.

Texts are read once: each becomes ``(doc_id, n, terms, counts)``, which is
written and gives the number of documents, their total length and the
document frequencies.  ``theta`` starts from the scores of a hashed 64th of
the vectors, which is a lower bound whatever it holds, and rises within each
task.  A task returns its best rows per query; a window merges them.  Queries
are taken in blocks of at most about ``MAX_TERMS`` terms, the only thing that
is broadcast; more queries mean more passes over the texts.

Edge cases.  A null, empty or separator-only text has no terms: such a
document counts nowhere and is never returned, such a query returns nothing.
Texts of any length are cut at separators, never shortened.  Each row of a
repeated document is a document; rows of a repeated query id are one query
with all their terms, and rows without an id are one query as well.  Among
equal scores documents without an id come last.  Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope.llm.common import slices, stored, table

BEST = 10
MAX_TERMS = 1 << 20         # query terms of a block
BUCKET = 2048               # vectors, and at most
POSTINGS = 1 << 21          # impacts
PIECE = 1 << 20             # bytes of a text that are split at once
SEED_SHARE = 64
MARGIN = 1 + 1e-9
COUNTED = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
VECTORS = "doc_id bigint, length double, terms array<int>, impacts array<bigint>"
HITS = "item int, doc_id bigint, score bigint"

# Term characters are 0-9, A-Z, a-z and all beyond ASCII (fixed by the
# contract); A-Z become a-z, every other ASCII character separates.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))


def terms_of(text: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        piece = text[at:at + PIECE].translate(_TERM)
        end = len(piece)
        if at + end < len(text):
            end = piece.rfind(b" ") + 1
            if not end:                                     # one term over the whole piece
                rest = text[at:].translate(_TERM)
                end = rest.find(b" ") + 1 or len(rest)
                piece = rest[:end]
        found.update(piece[:end].split())
        at += end
    return found


def _utf8(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, terms)`` with each distinct term once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            terms = [sorted(terms_of(t)) if t else [] for t in _utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))],
                                             ["item_id", "terms"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("item_id").schema.add("terms", T.ArrayType(T.BinaryType()))
    return (rows.mapInArrow(run, schema).select("item_id", F.explode("terms").alias("t")).distinct()
            .groupBy("item_id").agg(F.array_sort(F.collect_list("t")).alias("terms")))


def count_terms(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """``COUNTED``: length of every document that has a term, and its counts
    of the terms in the broadcast ``vocabulary``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in slices(batches, 1):
            ids, n, sizes, terms, counts = [], [], [0], [], []
            for k, text in enumerate(_utf8(b.column(1))):
                found = terms_of(text) if text else None
                if not found:
                    continue
                ids.append(k)
                n.append(found.total())
                for t in found.keys() & number.keys():
                    terms.append(number[t])
                    counts.append(found[t])
                sizes.append(len(terms))
            cut = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(cut, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(cut, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, COUNTED)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impact_vectors(counted: DataFrame, weight, documents: int, total: int) -> DataFrame:
    """``VECTORS`` with a positive length, from ``COUNTED``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for b in batches:
            size = b.column(2).value_lengths().to_numpy().astype(np.int64)
            terms = b.column(2).flatten().to_numpy()
            tf = b.column(3).flatten().to_numpy()
            m = 10 + (90 * b.column(1).to_numpy() * documents) // total
            impact = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))
            length = np.sqrt(_per_row(impact.astype(np.float64) ** 2, size))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(length), b.column(2),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(impact))],
                ["doc_id", "length", "terms", "impacts"])

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, VECTORS).where("length > 0")


def _per_row(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over consecutive rows of the given sizes (zero for none)."""
    out = np.zeros(len(size), values.dtype)
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some])
    return out


class Bucket:
    """Vectors of similar length, also ordered by term."""

    def __init__(self, ids: list, length: np.ndarray, size: np.ndarray, terms: np.ndarray, impacts: np.ndarray,
                 n_terms: int):
        self.ids, self.length, self.size, self.terms, self.impacts = ids, length, size, terms, impacts
        self.start = np.cumsum(size) - size
        order = np.argsort(terms, kind="stable")
        self.by_doc = np.repeat(np.arange(len(size)), size)[order]
        self.by_impact = impacts[order]
        self.cut = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=n_terms))))
        self.largest = np.zeros(n_terms, np.int64)
        some = np.flatnonzero(np.diff(self.cut))
        if len(some):
            self.largest[some] = np.maximum.reduceat(self.by_impact, self.cut[some])


class Search:
    """Best rows per query over the buckets of one task."""

    def __init__(self, items: list[np.ndarray], theta: np.ndarray, n_terms: int):
        self.items, self.n_terms = items, n_terms
        self.theta = theta.copy()                                  # a score under it can't be among the best
        self.best: list[list] = [[] for _ in items]
        self.flat = np.concatenate(items) if items else np.zeros(0, np.int64)
        self.sizes = np.array([len(t) for t in items], np.int64)
        self.norm = np.sqrt(self.sizes)
        self.mine = np.zeros(n_terms, bool)

    def bucket(self, b: Bucket) -> None:
        most = _per_row(b.largest[self.flat], self.sizes)
        open_ = (self.norm * b.length[0] * MARGIN >= self.theta) & (most >= self.theta)
        for q in np.flatnonzero(open_):
            self._search(int(q), b)

    def _search(self, q: int, b: Bucket) -> None:
        theta, terms = self.theta[q], self.items[q]
        p = int(np.searchsorted(-b.length, -theta / (self.norm[q] * MARGIN), "right"))    # long enough
        terms = terms[np.argsort(-b.largest[terms], kind="stable")]
        most = b.largest[terms]
        after = np.cumsum(most[::-1])[::-1] - most                 # largest sum behind each term
        k = int(np.argmax(after < theta)) + 1                      # without the first k terms: under theta
        rest, left = float(after[k - 1]), len(terms) - k
        docs = np.concatenate([b.by_doc[b.cut[t]:b.cut[t + 1]] for t in terms[:k]])
        value = np.concatenate([b.by_impact[b.cut[t]:b.cut[t + 1]] for t in terms[:k]]).astype(np.float64)
        part = np.bincount(docs, value, len(b.size))[:p]
        bound = np.full(p, rest)
        if left:
            square = np.bincount(docs, value * value, len(b.size))[:p]
            slack = np.sqrt(np.maximum(b.length[:p] ** 2 * MARGIN - square, 0) * left)
            bound = np.minimum(bound, slack)
        found = np.flatnonzero((part > 0) & ((part + bound) * MARGIN >= theta))
        if not len(found):
            return
        self.mine[terms] = True
        size = b.size[found]
        spots = np.repeat(b.start[found] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        score = _per_row(np.where(self.mine[b.terms[spots]], b.impacts[spots], 0), size)
        self.mine[terms] = False
        good = score >= theta
        found, score = found[good], score[good]
        if not len(found):
            return
        if len(found) > BEST:                                      # ties with the last one stay
            enough = score >= np.partition(score, -BEST)[-BEST]
            found, score = found[enough], score[enough]
        rows = self.best[q] + [(-s, b.ids[f] is None, b.ids[f] or 0) for f, s in zip(found.tolist(), score.tolist())]
        self.best[q] = sorted(rows)[:BEST]
        if len(self.best[q]) == BEST:
            self.theta[q] = max(theta, -self.best[q][-1][0])

    def rows(self) -> pa.RecordBatch:
        flat = [(q, None if none else i, -s) for q, rows in enumerate(self.best) for s, none, i in rows]
        cols = list(zip(*flat)) if flat else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                                           pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])


def search(vectors: DataFrame, queries) -> DataFrame:
    """``HITS`` of each task's best rows; ``vectors`` sorted by length,
    ``queries`` a broadcast of (terms per query, theta, number of terms)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, theta, n_terms = queries.value
        state = Search(items, theta, n_terms)
        for whole in batches:
            size = whole.column(2).value_lengths().to_numpy().astype(np.int64)
            at = 0
            while at < whole.num_rows:
                many = int(np.searchsorted(np.cumsum(size[at:at + BUCKET]), POSTINGS, "right"))
                b = whole.slice(at, max(1, many))
                state.bucket(Bucket(b.column(0).to_pylist(), b.column(1).to_numpy(), size[at:at + b.num_rows],
                                    b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), n_terms))
                at += b.num_rows
        yield state.rows()

    return vectors.select("doc_id", "length", "terms", "impacts").mapInArrow(run, HITS)


def _ranked(hits: DataFrame) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= BEST)


def _block(docs: DataFrame, rows: list, id_col: str, text_col: str) -> DataFrame:
    """``(item, rank, doc_id, score)`` for the queries ``rows``, lists of terms."""
    spark = docs.sparkSession
    number = {t: k for k, t in enumerate(sorted({t for terms in rows for t in terms}))}
    send = spark.sparkContext.broadcast
    counted = stored(count_terms(docs, send(number), id_col, text_col), "term_counts")
    all_ = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    # at most one row a query term
    df = np.zeros(len(number), np.int64)
    found = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df[found["t"].to_numpy()] = found["count"].to_numpy()
    weight = weights(df, all_.n)
    vectors = stored(impact_vectors(counted, send(weight), all_.n, all_.l or 1)
                     .repartitionByRange(F.desc("length"), F.xxhash64("doc_id"))
                     .sortWithinPartitions(F.desc("length")), "impact_vectors")
    items = [np.array([number[t] for t in terms], np.int64) for terms in rows]
    items = [t[weight[t] > 0] for t in items]
    theta = np.ones(len(items), np.int64)
    seed = vectors.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SEED_SHARE)) == 0)
    first = _ranked(search(seed, send((items, theta, len(number))))).where(F.col("rank") == BEST)
    for r in first.collect():                                       # one row a query
        theta[r.item] = max(1, r.score)
    return _ranked(search(vectors, send((items, theta, len(number)))))


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best documents of each query."""
    spark = docs.sparkSession
    queries = stored(query_terms(items, item_col, item_text_col), "query_terms")
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(size / max_terms))
    out = None
    for k in range(blocks):
        rows = (queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)],
                                    queries.select(F.lit(0).alias("item"), "item_id").schema)
        found = stored(_block(docs, [[bytes(t) for t in r.terms] for r in rows], id_col, text_col), "ranked")
        part = found.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every document against every query.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
len AS (SELECT rid, count(*) AS n FROM d GROUP BY 1),
tot AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len),
tf AS (SELECT rid, doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, tot GROUP BY t, big_n),
impact AS (
  SELECT tf.rid, tf.doc_id, tf.t, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf
    + 8 * (100 - 90 + (90 * len.n * tot.big_n) // tot.big_l))) AS s
  FROM tf JOIN w USING (t) JOIN len USING (rid) CROSS JOIN tot),
scored AS (SELECT i.item_id, rid, doc_id, sum(s)::BIGINT AS score FROM i JOIN impact USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
