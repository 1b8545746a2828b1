"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence: a logistic model of a document's own shape (shares of symbol,
upper-case and digit characters, word and line lengths, repeated words and
lines), fitted on at most ``max_labelled`` labelled rows, taken in the order
of a hash of their ids.  Then, over all documents, the expected number of
good ones (its label where it has one, else the classifier's chance) is
summed per host and per (host, path).  Host rates are beta distributed
around the global rate and path rates around their host's; the strength of
each prior comes from the spread between sites beyond what counts alone
explain (moments), so a sparse site shrinks to its host and a sparse host to
the global rate.  The site's posterior replaces the training base rate in the
document's log odds; documents under ``least`` are rejected.

Only sums per site are shuffled, after partial aggregation, so a host with a
third of the documents is one row per task.

Edge cases.  A null text is empty and has the features of an empty text; a
null host or path is a site of its own (the empty name).  Labels are
averaged per document, 0.5 or more counts as good; null labels are ignored.
Without any label the evidence is even and everything is kept.  Rows and ids
may repeat; an empty table gives no rows; other columns are ignored by
``score`` and passed through by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope.llm.common import SLICE_BYTES, bounded_sample, slices, stored, table

MAX_LABELLED = 50_000
MAX_STRENGTH = 1e4
NAMES = ("bang", "bar", "symbol", "upper", "digit", "log_bytes", "word_bytes", "distinct_share",
         "log_words", "log_distinct", "repeated_lines", "line_bytes")
# Byte classes: 0 other, 1 bang, 2 bar, 3 symbol, 4 upper case, 5 digit.
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"!", b"|", b"#$%&*", bytes(range(65, 91)), bytes(range(48, 58))), 1):
    _CLASS[list(_chars)] = _k


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    out = np.zeros((len(texts), len(NAMES)))
    size = pc.binary_length(texts).to_numpy()
    at = 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), SLICE_BYTES, "right")))
        _features(texts.slice(at, end - at), size[at:end], out[at:end])
        at = end
    return out


def _features(texts: pa.Array, size: np.ndarray, out: np.ndarray) -> None:
    rows = texts.to_pylist()
    points = np.frombuffer("".join(rows).encode("utf-8", "surrogatepass"), np.uint8)
    owner = np.repeat(np.arange(len(rows)) * 6, size)
    n = np.maximum(size, 1)
    out[:, :5] = np.bincount(owner + _CLASS[points], minlength=6 * len(rows)).reshape(-1, 6)[:, 1:] / n[:, None]
    for k, text in enumerate(rows):
        words, lines = text.split(), text.split("\n")
        distinct = len(set(words))
        out[k, 5:] = (math.log1p(size[k]), size[k] / max(1, len(words)), distinct / max(1, len(words)),
                      math.log1p(len(words)), math.log1p(distinct),
                      1 - len(set(lines)) / len(lines), size[k] / len(lines))


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        found = text_features(texts)
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1],
                                        pa.array(found.ravel()))
    return measured(text)


class Evidence:
    """Ridge logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
        self.sd = (x.std(axis=0) if len(x) else np.ones(len(NAMES))) + 1e-9
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.sd))
        self.w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(self.w))
            self.w += np.clip(np.linalg.solve(hess, z.T @ (y - p) - self.w), -5, 5)
        # base rate of the labelled rows, never 0 or 1
        self.base = float((y.sum() + 0.5) / (len(y) + 1.0))

    def log_odds(self, found: Column) -> Column:
        """The model as a column expression over the feature array."""
        total = F.lit(float(self.w[0]))
        for k in range(len(NAMES)):
            z = (F.get(found, F.lit(k)) - float(self.mean[k])) / float(self.sd[k])
            total = total + float(self.w[k + 1]) * z
        return F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def train(measured: DataFrame, labels: DataFrame, max_labelled: int) -> Evidence:
    """From ``(row_id, found, ...)`` and ``(row_id, y)``."""
    labelled = stored(measured.join(labels, "row_id").select("row_id", "found", "y"), "labelled")
    rows = bounded_sample(labelled, F.xxhash64("row_id"), max_labelled).toArrow()
    flat = rows["found"].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0)
    return Evidence(flat.reshape(-1, len(NAMES)), rows["y"].to_numpy().astype(float))


def _strength(sites: DataFrame, rate: Column, around: Column) -> float:
    """Prior strength (in documents) of site rates ``rate`` with ``n`` rows
    around their means, by moments: the wider sites differ beyond counting
    noise, the weaker the prior."""
    noise = around * (1 - around)
    s = sites.where("n > 1").agg(
        F.sum(F.col("n") * (rate - around) ** 2).alias("spread"), F.sum(noise).alias("expected"),
        F.sum(F.col("n") * noise).alias("weight"), F.sum("n").alias("n")).first()
    if not s.n or not s.weight:
        return MAX_STRENGTH
    between = (s.spread - s.expected) / s.n             # variance of the sites' true rates
    if between <= 0:
        return MAX_STRENGTH
    return float(min(MAX_STRENGTH, max(1.0, s.weight / s.n / between - 1)))


def site_rates(evidence: DataFrame) -> DataFrame:
    """``(host, path, host_rate, site_rate)`` from ``(host, path, good)``,
    good being the expected quality of each document."""
    paths = stored(evidence.groupBy("host", "path")
                   .agg(F.count("*").alias("n"), F.sum("good").alias("k")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "hosts")
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (all_.k + 0.5) / (all_.n + 1.0) if all_.n else 0.5
    k1 = _strength(hosts, F.col("k") / F.col("n"), F.lit(mean))
    hosts = hosts.select("host", ((F.col("k") + k1 * mean) / (F.col("n") + k1)).alias("host_rate"))
    sites = stored(paths.join(hosts, "host"), "site_counts")
    k2 = _strength(sites, F.col("k") / F.col("n"), F.col("host_rate"))
    return stored(sites.select("host", "path", "host_rate",
                               ((F.col("k") + k2 * F.col("host_rate")) / (F.col("n") + k2)).alias("site_rate")),
                  "site_rates")


def _label_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).cast("bigint").alias("row_id"))
            .agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("y")))


def _fit(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str,
         label_id_col: str, label_col: str, max_labelled: int):
    """Measured rows (written), the classifier and the sites' rates."""
    measured = stored(docs.select(
        F.col(id_col).cast("bigint").alias("row_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        features(F.col(text_col).cast("string")).alias("found")), "measured")
    known = stored(_label_rows(labels, label_id_col, label_col), "quality_labels")
    model = train(measured, known, max_labelled)
    good = F.coalesce(F.col("y").cast("double"), _chance(model.log_odds(F.col("found"))))
    rates = site_rates(measured.join(known, "row_id", "left").select("host", "path", good.alias("good")))
    return measured, model, rates


def _verdict(model: Evidence, found: Column, least: float, rate: str = "site_rate") -> dict[str, Column]:
    odds = model.log_odds(found)
    chance = _chance(odds + _logit(F.col(rate)) - math.log(model.base / (1 - model.base)))
    return {"evidence": odds, "quality": chance, "kept": chance >= least}


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
          text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality",
          least: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(row_id, host, path, evidence, host_rate, site_rate, quality,
    kept)`` for every document."""
    measured, model, rates = _fit(docs, labels, host, path, id_col, text_col, label_id_col, label_col,
                                  max_labelled)
    verdict = _verdict(model, F.col("found"), least)
    return (measured.join(rates, ["host", "path"])
            .select("row_id", "host", "path", verdict["evidence"].alias("evidence"), "host_rate", "site_rate",
                    verdict["quality"].alias("quality"), verdict["kept"].alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
              text_col: str = "text", least: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that are not rejected.  Features are measured
    again in a pass that takes the rows along, a slice of bounded text at a
    time, and joined to the sites, so that texts move only if the table of
    sites is too large for Spark to broadcast."""
    _, model, rates = _fit(docs, labels, host, path, id_col, text_col, "doc_id", "quality", max_labelled)
    sites = rates.select(F.col("host").alias("__host"), F.col("path").alias("__path"),
                         F.col("site_rate").alias("__rate"))
    rows = docs.withColumns({text_col: F.col(text_col).cast("string"),
                             "__host": F.coalesce(host.cast("string"), F.lit("")),
                             "__path": F.coalesce(path.cast("string"), F.lit(""))})
    text = docs.columns.index(text_col)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = text_features(part.column(text))
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1],
                                             pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "__found"])

    measured = rows.mapInArrow(beside, T.StructType([*rows.schema.fields, T.StructField(
        "__found", T.ArrayType(T.DoubleType()))]))
    kept = _verdict(model, F.col("__found"), least, "__rate")["kept"]
    return measured.join(sites, ["__host", "__path"]).where(kept).select(*docs.columns)


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                   host=F.col("source"), path=F.col("lang"))
    return scored.withColumnRenamed("row_id", "doc_id")
