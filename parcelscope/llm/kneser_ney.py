"""Language identification with interpolated Kneser-Ney character models.

Words (runs of letters and marks, lower-cased) are padded with word
boundaries and cut into character n-grams of one order.  Each task counts
the n-grams of its distinct words and Spark adds the counts up per language.
Lower orders use continuation counts, discounts are estimated per language
and order, and interpolation weights per context, all by grouped
aggregation over the n-gram table.  The finished model holds, per language
and order, sorted arrays of 64-bit n-gram hashes with their discounted
probability and of context hashes with their weight.

A text is scored per language by its cross-entropy, the mean of -log P over
its characters; the lowest wins (ties: the smaller language value).  Only
the distinct n-grams of a slice of rows are evaluated.

Calibration uses the learning rows alone: the chance that the winner is
right is a logistic function of the log margin, fitted on a histogram that
Spark aggregates.  A prediction is marked ``rejected`` when that chance is
under ``reject_below`` or its cross-entropy lies over ``reject_sd`` standard
deviations above its language's mean.

Counts, discounts, continuations and weights come from the full table and no
n-gram is left out.  Up to ``max_grams`` n-grams of the highest order the
model is one broadcast.  A larger one is split into parts by the two middle
characters of its n-grams, with which all longer n-grams and contexts that an
n-gram needs go along (those of two characters and fewer are in each part);
each part is broadcast in turn and adds up the costs of its own n-grams of
every text, and the sums over the parts are the whole model's.

Edge cases.  A null text, or one without a letter, gets ``und`` with score 0
(so does every row when nothing could be learned).  Repeated rows are
returned as often as they came in and learned as often as they occur; a null
id is never learned from; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import slices, stored, table

ORDER = 4
EDGE = " "
WORD_CUT = r"[^\p{L}\p{M}]+"
FLUSH = 1 << 20                 # distinct n-grams a task holds before it emits them
GRAMS = "lang string, gram string, n bigint"
SCORES = "row_id bigint, lang string, learn boolean, best string, ce double, margin double, chars bigint"


def _mix(points: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points (up to ORDER columns)."""
    h = np.full(len(points), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ points[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, word) of every word occurrence, and the distinct words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), WORD_CUT)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(lists.flatten())
    row, word = np.repeat(np.arange(len(texts)), size), coded.indices.to_numpy()
    names = coded.dictionary.to_pylist()
    if "" in names:
        full = word != names.index("")
        row, word = row[full], word[full]
    return row, word, names


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points ``[n, ORDER]`` of the n-grams of the padded words, and the
    word each belongs to."""
    pad = EDGE * (ORDER - 1)
    text = "".join([pad + w + EDGE for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(length + ORDER) - (length + ORDER)
    count = length + 1
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    grams = np.lib.stride_tricks.sliding_window_view(points, ORDER)[at] if len(words) else \
        np.zeros((0, ORDER), np.uint32)
    return grams, np.repeat(np.arange(len(words)), count)


def _spell(grams: np.ndarray) -> list[str]:
    return np.ascontiguousarray(grams.astype("<u4")).view(f"<U{grams.shape[1]}").ravel().tolist() \
        if len(grams) else []


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs: list[str] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []   # hash, lang, points+count

    def merged():
        key = np.concatenate([h[0] for h in held])
        points = np.concatenate([h[1] for h in held])
        n = np.concatenate([h[2] for h in held])
        lang = points[:, ORDER].astype(np.int64)
        order = np.lexsort((lang, key))
        key, points, n, lang = key[order], points[order], n[order], lang[order]
        new = np.append(True, (key[1:] != key[:-1]) | (lang[1:] != lang[:-1]))
        start = np.flatnonzero(new)
        held[:] = [(key[start], points[start], np.add.reduceat(n, start))]

    def emit():
        _, points, n = held[0]
        for at in range(0, len(n), 1 << 16):
            part = points[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in part[:, ORDER]]), pa.array(_spell(part[:, :ORDER])),
                 pa.array(n[at:at + (1 << 16)])], ["lang", "gram", "n"])
        held.clear()

    for part in slices(batches, 1):
        row, word, names = _words(part.column(1))
        if not len(row):
            continue
        own = part.column(0).to_pylist()
        for x in dict.fromkeys(own):
            if x not in langs:
                langs.append(x)
        lang = np.array([langs.index(x) for x in own])[row]
        pair, n = np.unique(lang.astype(np.int64) * len(names) + word, return_counts=True)
        grams, source = _windows([names[i] for i in (pair % len(names)).tolist()])
        points = np.column_stack((grams, (pair // len(names))[source])).astype(np.uint32)
        held.append((_mix(grams), points, n[source]))
        merged()
        if len(held[0][0]) > FLUSH:
            yield from emit()
    if held:
        yield from emit()


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``(lang, gram, n)``: how often each n-gram occurs in all texts."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("body")).where("lang is not null")
    return (rows.mapInArrow(_count_task, GRAMS).groupBy("lang", "gram")
            .agg(F.sum("n").alias("n")))


def _tables(counts: DataFrame) -> DataFrame:
    """Model rows ``(kind, k, lang, gram, v)``: kind g, the discounted
    probability of a k-gram; kind c, the weight of the next lower order
    after a context of k - 1 characters; kind v, the alphabet size."""
    out, level = [], counts
    for k in range(ORDER, 0, -1):
        if k < ORDER:       # continuation counts: in how many contexts one longer
            level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        level = stored(level, f"grams{k}")
        d = (level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"),
                                       F.count_if(F.col("n") == 2).alias("n2"))
             .select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0),
                                    F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
                     .otherwise(F.lit(0.5)).alias("d")))
        head = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        heads = (level.groupBy("lang", head.alias("head"))
                 .agg(F.sum("n").alias("total"), F.count("*").alias("kinds")))
        heads = stored(heads.join(d, "lang"), f"heads{k}")
        probs = (level.withColumn("head", head).join(heads, ["lang", "head"])
                 .select(F.lit("g").alias("kind"), F.lit(k).alias("k"), "lang", "gram",
                         (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("v")))
        out.append(probs)
        out.append(heads.select(F.lit("c").alias("kind"), F.lit(k).alias("k"), "lang",
                                F.col("head").alias("gram"),
                                (F.col("d") * F.col("kinds") / F.col("total")).alias("v")))
    out.append(level.agg(F.count_distinct("gram").cast("double").alias("v"))
               .select(F.lit("v").alias("kind"), F.lit(0).alias("k"), F.lit("").alias("lang"),
                       F.lit("").alias("gram"), "v"))
    model = out[0]
    for part in out[1:]:
        model = model.unionByName(part)
    return model


def prune(counts: DataFrame, max_grams: int) -> DataFrame:
    """The n-grams of a smaller model of at most ``max_grams``, for callers
    that want one; ``identify`` leaves none out."""
    if counts.count() <= max_grams:
        return counts
    steps = counts.groupBy(F.floor(F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62           # at most 64 steps: powers of two of the count
    for s in steps:
        total += s["count"]
        if total > max_grams:
            break
        least = 1 << int(s.step)
    return counts.where(F.col("n") >= least)


def _part_of(a, b, parts: int):
    """Part of the n-grams with these middle characters (code points)."""
    return (a * 31 + b) % parts


def parted(tables: DataFrame, parts: int, part: int) -> DataFrame:
    """The rows of ``_tables`` that the n-grams of one part need."""
    # the middle characters' place in an n-gram of k, or in its context
    at = F.col("k") - (ORDER - 2)
    first, second = (F.ascii(F.substring("gram", at + i, F.lit(1))) for i in (0, 1))
    return tables.where((F.col("k") < ORDER - 1) | (_part_of(first, second, parts) == part))


class Model:
    """Sorted hash arrays per language and order; of one part of the n-grams
    where there is more than one."""

    def __init__(self, rows: pa.Table, parts: int = 1, part: int = 0):
        self.parts, self.part = parts, part
        kind, k, lang = (np.array(rows[c].to_pylist()) for c in ("kind", "k", "lang"))
        value = rows["v"].to_numpy()
        grams = np.array(rows["gram"].to_pylist(), dtype=object)
        self.langs = sorted(set(lang[kind == "g"].tolist()))
        size = value[kind == "v"]
        self.floor = 1.0 / (1.0 + (size[0] if len(size) else 0.0))
        self.arrays = {}
        for kk in range(1, ORDER + 1):
            for what, width in (("g", kk), ("c", kk - 1)):
                for name in self.langs:
                    own = (kind == what) & (k == kk) & (lang == name)
                    text = "".join(grams[own])
                    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(own.sum(), width)
                    key = _mix(points)
                    order = np.argsort(key)
                    self.arrays[what, kk, name] = key[order], value[own][order]

    def _get(self, what: str, k: int, lang: str, key: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.arrays[what, k, lang]
        if not len(keys):
            return np.full(len(key), missing)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], missing)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """-log P of each n-gram's last character, one column per language."""
        whole = [_mix(grams[:, ORDER - k:]) for k in range(1, ORDER + 1)]
        heads = [_mix(grams[:, ORDER - k:ORDER - 1]) for k in range(1, ORDER + 1)]
        out = np.empty((len(grams), len(self.langs)))
        for j, lang in enumerate(self.langs):
            p = np.full(len(grams), self.floor)
            for k in range(1, ORDER + 1):
                p = (self._get("g", k, lang, whole[k - 1], 0.0)
                     + self._get("c", k, lang, heads[k - 1], 1.0) * p)
            out[:, j] = -np.log(p)
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy ``[rows, languages]`` and characters scored; over
        the part's n-grams alone where there is more than one part."""
        total, chars = self.costs(texts)
        return total / np.maximum(chars, 1)[:, None], chars

    def costs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums of -log P over the part's n-grams, and all characters."""
        n = len(texts)
        row, word, names = _words(texts)
        total, chars = np.zeros((n, len(self.langs))), np.zeros(n, np.int64)
        if len(row) and self.langs:
            grams, source = _windows(names)
            _, one, back = np.unique(_mix(grams), return_index=True, return_inverse=True)
            own = grams[one]
            cost = np.zeros((len(own), len(self.langs)))
            middle = own[:, 1:3].astype(np.int64)
            mine = _part_of(middle[:, 0], middle[:, 1], self.parts) == self.part
            cost[mine] = self.cost(own[mine])
            size = np.bincount(source, minlength=len(names))
            chars = np.bincount(row, size[word], n).astype(np.int64)
            for j in range(len(self.langs)):
                per_word = np.bincount(source, cost[back, j], len(names))
                total[:, j] = np.bincount(row, per_word[word], n)
        return total, chars


def learned(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
            max_grams: int = 2_000_000) -> tuple[DataFrame, int]:
    """Model tables of all rows with a language, and in how many parts they
    have about ``max_grams`` n-grams each."""
    counts = stored(gram_counts(docs, lang_col, text_col), "gram_counts")
    parts = max(1, -(-counts.count() // max_grams))
    tables = _tables(counts)
    return (tables if parts == 1 else stored(tables, "model")), parts


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Model of all rows with a language, in one part."""
    return Model(_tables(stored(gram_counts(docs, lang_col, text_col), "gram_counts")).toArrow())


def _winners(total: np.ndarray, chars: np.ndarray, letters: np.ndarray, langs: list[str]) -> list[pa.Array]:
    """Winner, cross-entropy, margin to the runner-up and characters."""
    n, none = len(chars), (chars == 0) | ~letters
    if langs:
        ce = total / np.maximum(chars, 1)[:, None]
        best = ce.argmin(axis=1)
        low = ce[np.arange(n), best]
        rest = ce.copy()
        rest[np.arange(n), best] = np.inf
        margin = rest.min(axis=1) - low if len(langs) > 1 else low
    else:
        best, low, margin, none = np.zeros(n, int), np.zeros(n), np.zeros(n), np.ones(n, bool)
    names = [None if no else langs[b] for no, b in zip(none, best)]
    return [pa.array(names, pa.string()), pa.array(low), pa.array(margin), pa.array(np.where(none, 0, chars))]


def _letters(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)


NAMES = ["row_id", "lang", "learn", "best", "ce", "margin", "chars"]


def score_rows(rows: DataFrame, model: Model) -> DataFrame:
    """Winner, cross-entropy and margin to the runner-up of each row of
    ``(row_id, lang, learn, body)``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, 3):
            total, chars = own.costs(part.column(3))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2),
                 *_winners(total, chars, _letters(part.column(3)), own.langs)], NAMES)

    return rows.mapInArrow(run, SCORES)


def score_in_parts(rows: DataFrame, tables: DataFrame, parts: int) -> DataFrame:
    """As ``score_rows``, for a model in more than one part: each part's sums
    are stored per distinct text, and added up."""
    sums, langs = None, []
    # one text for all rows without one
    keyed = rows.withColumn("key", F.sha2(F.coalesce("body", F.lit("")), 256))
    for p in range(parts):
        model = Model(parted(tables, parts, p).toArrow(), parts, p)
        langs = model.langs
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for part in slices(batches, 1):
                total, chars = own.costs(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(chars),
                     pa.array(_letters(part.column(1)))], ["key", "costs", "chars", "letters"])

        # equal texts have equal sums
        one = stored(keyed.select("key", "body").mapInArrow(
            run, "key string, costs array<double>, chars bigint, letters boolean").dropDuplicates(["key"]), "part_costs")
        shared.unpersist()
        sums = one if sums is None else stored(
            sums.join(one.select("key", F.col("costs").alias("more")), "key")
            .select("key", F.zip_with("costs", "more", lambda a, b: a + b).alias("costs"), "chars", "letters"), "costs")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total = np.array(b.column(3).to_pylist(), float).reshape(b.num_rows, len(langs))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2),
                     *_winners(total, b.column(4).to_numpy(),
                               b.column(5).to_numpy(zero_copy_only=False).astype(bool), langs)], NAMES)

    return (keyed.drop("body").join(sums, "key").select("row_id", "lang", "learn", "costs", "chars", "letters")
            .mapInArrow(decide, SCORES))


def _evidence() -> Column:
    return F.log1p(F.col("margin") * F.col("chars"))


def calibration(scores: DataFrame) -> tuple[float, float]:
    """(a, b) of the chance of a right winner, 1 / (1 + exp(-a - b x)), x the
    log margin, fitted by Newton steps on a histogram of the learning rows."""
    bins = (scores.where("learn and lang is not null and best is not null")
            .groupBy(F.floor(_evidence() * 8).alias("x"))
            .agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("best")).alias("right"))
            .where("x between 0 and 400").collect())      # at most 401 bins
    x = np.array([(b.x + 0.5) / 8 for b in bins])
    # a small made-up share of misses keeps the fit finite
    n, right = np.array([b.n + 0.02 for b in bins]), np.array([b.right + 0.01 for b in bins])
    w = np.zeros(2)
    design = np.column_stack((np.ones(len(x)), x)) if bins else np.zeros((0, 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (right - n * p) - 1e-3 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(w[0]), float(max(w[1], 0.0))


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", reject_below: float = 0.5, reject_sd: float = 6.0,
             max_grams: int = 2_000_000) -> DataFrame:
    """``(row_id, learn, best, score, ce, rejected)`` for every row; the rows
    where ``learn_from`` holds and the language is not null teach the model."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"),
                       F.col(lang_col).cast("string").alias("lang"),
                       F.coalesce(learn_from, F.lit(False)).alias("learn"),
                       F.col(text_col).cast("string").alias("body"))
    tables, parts = learned(rows.where("learn"), "lang", "body", max_grams)
    scores = stored(score_rows(rows, Model(tables.toArrow())) if parts == 1 else
                    score_in_parts(rows, tables, parts), "lang_scores")
    a, b = calibration(scores)
    usual = (scores.where("learn and best = lang").groupBy(F.col("best").alias("of"))
             .agg((F.avg("ce") + reject_sd * F.coalesce(F.stddev_samp("ce"), F.lit(0.0))).alias("most")))
    score = F.when(F.col("best").isNull(), 0.0).otherwise(
        1 / (1 + F.exp(-F.lit(a) - F.lit(b) * _evidence())))
    # one row per language: the join never moves the scores
    return (scores.join(F.broadcast(usual), scores.best == usual.of, "left")
            .select("row_id", "learn", F.coalesce("best", F.lit("und")).alias("best"),
                    score.alias("score"), "ce",
                    (F.col("best").isNull() | (score < reject_below)
                     | F.coalesce(F.col("ce") > F.col("most"), F.lit(False))).alias("rejected")))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(docs, learn_from=part != 2)
    return found.select(F.col("row_id").alias("doc_id"),
                        F.coalesce(F.crc32(F.col("row_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                        F.col("best").alias("lang_pred"), "score", "rejected")
