"""Secret scans with a random forest for false-positive removal, in
DataFrame functions (the forest is Spark's own).

Candidates are maximal runs of twelve or more key characters (a run may start
with any of them and needs no digit, but a letter or digit), and, after a
credential word and ``=`` or ``:``, the whole value of any length and of any
characters: up to the closing quote, or to the next space, quote, comma,
semicolon or bracket.  Runs under twelve characters without a credential word
are none.  Everything else is left to the forest.  Features: length, character shares, entropy, transitions between
character classes, the share of the run covered by words of a dictionary
(letter runs that occur in at least ``MIN_DOCS`` documents of the table),
path shape of the run and of the document's path, and the neighbouring words.

Labelled findings come with the call as ``(row_id, nth, secret)``; where a
corpus has none, ``distant_labels`` makes them: a run assigned to a
credential word is a secret (with a digit, or six or more characters that are
no dictionary words), a number, host, file name, date, UUID, path or run of
dictionary words without one is not, and everything else stays unlabelled and is left to the
forest.  The forest learns from at most ``max_labelled`` labelled findings,
those first in the order of a hash, and then decides on every finding.

Edge cases.  A null or empty text has no candidates.  Rows that repeat an id
are kept apart by their text; equal rows share their findings and are
redacted alike.  Null paths are empty.  With labels of one kind only there is
nothing to learn and the findings keep that label; without any label nothing
is a secret.  An empty table has no findings; other columns are ignored by
``scan`` and passed through by ``redact``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.common import bounded_sample, scratch_path, stored, table

CANDIDATE = (r"(?<![A-Za-z0-9+/_\-])(?=[+/_.\-]*[A-Za-z0-9])"
             r"[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{10,}[A-Za-z0-9+/_\-]={0,2}")
NEAR = 48                       # characters of context on each side
MIN_DOCS = 20
MAX_LABELLED = 20_000
MASK = "[SECRET]"
# Words that name a credential, and words of made-up ones.
CREDENTIAL = (r"token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth|"
              r"bearer|credential|client[_\- ]?id|signature")
# Java's lookbehind may have any bounded length; the first one is quick and
# fails nearly everywhere.
_AFTER = r"(?<=[=:>\s\"'`])(?<=[=:>]\s{0,4}[\"'`]?)(?<=(?i:" + CREDENTIAL + \
    r")[A-Za-z0-9_\-]{0,16}[\"'`]?\s{0,4}[=:]>?\s{0,4}"
VALUE = "|".join([rf"{_AFTER}{q})[^{q}\r\n]++(?={q})" for q in "\"'`"]
                 + [_AFTER + r")(?![=>])[^\s\"'`,;<>(){}\[\]]*[^\s\"'`,;<>(){}\[\].:]"])
FOUND = f"(?:{VALUE})|{CANDIDATE}"
MADE_UP = r"example|sample|dummy|fake|test|placeholder|changeme|xxxx"
HARMLESS = (r"^(?:[0-9.+\-/]+"                                  # numbers, dates, phones, versions
            r"|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"    # UUIDs
            r"|(?:[A-Za-z0-9\-]+\.)+[a-z]{2,6}"                 # hosts and file names
            r"|(?:[A-Za-z0-9_.\-]*/)+[A-Za-z0-9_.\-]*)$")       # paths
TREES, DEPTH, SEED = 40, 8, 11
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "hex", "distinct", "entropy", "turns_digit",
            "turns_case", "turns_vowel", "covered", "slashes", "dots", "path_depth", "path_test",
            "credential_near", "assigned", "quoted", "made_up_near", "words_near")


def candidates(docs: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """``(row_id, row_key, path, nth, start, run, before, after)``: one row
    per candidate, ``start`` counted from 0 in characters."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    # the search alone runs on every text; it ends at the first candidate
    held = rows.where(F.col("body").rlike(FOUND))
    cut = stored(held.select("row_id", "path", F.xxhash64("body").alias("row_key"),
                             F.regexp_extract_all("body", F.lit(FOUND), F.lit(0)).alias("runs"),
                             F.split("body", FOUND, -1).alias("parts")), "candidate_rows")
    sizes = F.zip_with("parts", "runs", lambda p, r: F.length(p) + F.coalesce(F.length(r), F.lit(0)))
    cut = cut.select("row_id", "path", "row_key", "runs", "parts", sizes.alias("sizes"))

    def text(name: str, i: Column) -> Column:
        return F.coalesce(F.when(i >= 0, F.get(F.col(name), i)), F.lit(""))

    # the context runs on over the candidates next to this one
    each = F.transform("runs", lambda run, i: F.struct(
        i.alias("nth"),
        (F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b) + F.length(text("parts", i))).alias("start"),
        run.alias("run"),
        F.right(F.concat(F.right(text("parts", i - 1), F.lit(NEAR)), text("runs", i - 1), text("parts", i)),
                F.lit(NEAR)).alias("before"),
        F.left(F.concat(text("parts", i + 1), text("runs", i + 1), F.left(text("parts", i + 2), F.lit(NEAR))),
               F.lit(NEAR)).alias("after")))
    # sizes is named outside the lambda too, so it is made once a row
    made = F.when(F.size("sizes") > 0, each)
    # rows that repeat an id and text are one; texts themselves never move
    key = ["row_id", "row_key", "path"]
    return (cut.select(*key, F.explode_outer(made).alias("c")).where("c is not null")
            .select(*key, "c.*").dropDuplicates([*key, "nth"]))


def dictionary(docs: DataFrame, text_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """Letter runs (lower case, three or more) of at least ``min_docs``
    documents."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z]+"))
    return (docs.select(F.explode_outer(words).alias("word")).where("length(word) >= 3")
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("word"))


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``(run, covered)``: share of the run's characters in dictionary words."""
    runs = found.select("run").distinct()
    parts = runs.select("run", F.explode_outer(F.regexp_extract_all(F.lower("run"), F.lit("[a-z]{3,}"), F.lit(0)))
                        .alias("word"))
    hit = parts.join(words.withColumn("known", F.lit(1)), "word", "left")
    return hit.groupBy("run").agg((F.sum(F.when(F.col("known") == 1, F.length("word")).otherwise(0))
                                   / F.length("run")).alias("covered"))


def _count(pattern: str) -> Column:
    return F.regexp_count("run", F.lit(pattern)).cast("double")


def measured(found: DataFrame) -> DataFrame:
    """``found`` with one double per name of FEATURES (``covered`` is there)."""
    n = F.length("run").cast("double")
    chars = F.split("run", "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - F.when(
        c == "", F.lit(0.0)).otherwise((n - F.length(F.replace("run", c))) / n * F.log2(
            (n - F.length(F.replace("run", c))) / n)))
    before = F.lower("before")
    flag = {"hex": F.col("run").rlike("^[0-9a-fA-F]+$"),
            "path_test": F.lower("path").rlike("test|mock|example|sample|fixture"),
            "credential_near": before.rlike(f"(?:{CREDENTIAL})"),
            "assigned": F.col("before").rlike("[=:]\\s*[\"'`]?$"),
            "quoted": F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"),
            "made_up_near": F.concat(before, F.lit(" "), F.lower("run"), F.lit(" "), F.lower("after")).rlike(MADE_UP)}
    number = {"length": n, "digits": _count("[0-9]") / n, "uppers": _count("[A-Z]") / n,
              "lowers": _count("[a-z]") / n, "marks": _count("[^A-Za-z0-9]") / n,
              "distinct": F.size(F.array_distinct(chars)) / n, "entropy": entropy,
              "turns_digit": _count("(?=[0-9][A-Za-z]|[A-Za-z][0-9])") / n,
              "turns_case": _count("(?=[a-z][A-Z]|[A-Z][a-z])") / n,
              "turns_vowel": _count("(?i)(?=[aeiou][b-df-hj-np-tv-z]|[b-df-hj-np-tv-z][aeiou])") / n,
              "covered": F.col("covered"), "slashes": _count("/"), "dots": _count("[.]"),
              "path_depth": F.regexp_count("path", F.lit("/")),
              "words_near": F.regexp_count("before", F.lit(r"\p{L}{2,}"))}
    made = number | {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flag.items()}
    return found.withColumns({f"f_{k}": F.coalesce(made[k].cast("double"), F.lit(0.0)) for k in FEATURES})


def distant_labels(found: DataFrame) -> DataFrame:
    """``(row_id, row_key, nth, secret)`` for the findings that context or
    shape decides on their own (see the module's text)."""
    named = F.lower("before").rlike(f"(?:{CREDENTIAL})[\"']?\\s*[=:]\\s*[\"'`]?$")
    plain = F.col("run").rlike(HARMLESS)
    made_up = F.lower(F.concat("run", F.lit(" "), "after")).rlike(MADE_UP)
    digit = F.col("run").rlike("[0-9]")
    keyed = ~F.col("run").rlike("\\s") & (digit | ((F.col("covered") < 0.5) & (F.length("run") >= 6)))
    worded = ~digit & (F.col("covered") >= 0.8)
    label = F.when(named & keyed & ~plain & ~made_up, 1).when(~named & (plain | made_up | worded), 0)
    return (found.select("row_id", "row_key", "nth", label.alias("secret")).where("secret is not null"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None,
         labels: DataFrame | None = None, words: DataFrame | None = None, least: float = 0.5,
         max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(row_id, row_key, nth, start, run, chance, secret)`` for every
    candidate.  ``labels``: ``(row_id, nth, secret)``; ``words``: a
    dictionary ``(word)``."""
    found = stored(candidates(docs, id_col, text_col, F.lit("") if path is None else path), "candidates")
    known = stored(coverage(found, dictionary(docs, text_col) if words is None else words), "coverage")
    # a row per distinct run: packed, its file is small enough for a broadcast
    # that would be many times as large
    ready = stored(measured(found.join(known.hint("merge"), "run")), "measured_candidates")
    names = [f"f_{k}" for k in FEATURES]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
    if labels is None:
        given = distant_labels(ready)
    else:
        given = ready.join(labels.where("secret is not null").groupBy("row_id", "nth")
                           .agg(F.max(F.col("secret").cast("int")).alias("secret")), ["row_id", "nth"]) \
            .select("row_id", "row_key", "nth", "secret")
    key = ["row_id", "row_key", "nth"]
    order = F.xxhash64("run", "before", "after", "row_id", "nth")
    train = stored(assembled.join(given.select(F.col("row_id").alias("l_id"), F.col("row_key").alias("l_key"),
                                               F.col("nth").alias("l_nth"), F.col("secret").cast("double").alias("label")),
                                  F.col("row_id").eqNullSafe(F.col("l_id")) & (F.col("row_key") == F.col("l_key"))
                                  & (F.col("nth") == F.col("l_nth")))
                   .select(order.alias("o"), *key, "features", "label"), "labelled_findings")
    train = stored(bounded_sample(train, F.col("o"), max_labelled).select("features", "label"), "training_rows")
    kinds = [r.label for r in train.groupBy("label").count().orderBy("label").collect()]    # at most two rows
    if len(kinds) == 2:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt",
                                        minInstancesPerNode=2).fit(train.coalesce(1))
        # as read back: a fitted model keeps its session, which can't always
        # be sent to executors
        path = scratch_path(docs.sparkSession, "forest")
        forest.write().save(path)
        forest = RandomForestClassificationModel.load(path)
        judged = forest.transform(assembled).withColumn("chance", F.get(vector_to_array("probability"), F.lit(1)))
    else:
        judged = assembled.withColumn("chance", F.lit(float(kinds[0]) if kinds else 0.0))
    return judged.select(*key, "start", "run", "chance", (F.col("chance") >= least).alias("secret"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mask: str = MASK) -> DataFrame:
    """``docs`` with the secrets of ``found`` (from ``scan``) masked in their
    texts; rows without a secret are unchanged."""
    per_row = stored(found.where("secret").groupBy("row_id", "row_key")
                     .agg(F.collect_set("nth").alias("__nths"))
                     .select(F.col("row_id").alias("__id"), F.col("row_key").alias("__key"), "__nths"), "secret_rows")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(per_row, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__key")), "left")
    # null without a secret, so that the regular expressions run on few rows
    hit = F.when(F.col("__nths").isNotNull(), body)
    runs = F.regexp_extract_all(hit, F.lit(FOUND), F.lit(0))
    staged = joined.withColumns({"__parts": F.split(hit, FOUND, -1), "__runs": runs})
    pieces = F.transform("__parts", lambda p, i: F.concat(p, F.coalesce(
        F.when(F.array_contains("__nths", i), F.lit(mask)).otherwise(F.get(F.col("__runs"), i)), F.lit(""))))
    # the arrays are named outside the lambda too, so they are made once a row
    clean = F.when(F.col("__nths").isNotNull() & (F.size("__runs") > 0), F.array_join(pieces, ""))
    return staged.withColumn(text_col, F.coalesce(clean, F.col(text_col))).select(*docs.columns)


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), path=F.col("source"))
    return found.select(F.col("row_id").alias("doc_id"), "nth", "start", F.length("run").alias("length"),
                        F.sha2("run", 256).alias("run_sha256"), "chance", "secret")
