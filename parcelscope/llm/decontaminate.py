"""Benchmark decontamination by canonical templates, in DataFrame functions.

Texts become tokens (words and numbers) and each token a template element:
numbers, units after a number and names (capitalised words inside a
sentence) turn into typed placeholders, other words are lower-cased.  Windows
of five template elements are hashed and joined to the windows of the
benchmark items.  Copies in other letter case have other names, so each
window is hashed in a second form too, where all words are folded to one case
and only numbers and units are typed; a window that matches in either form
goes on.  For every matching window the values behind the
placeholders are compared: inside one (document, item) pair an item's value
must always stand for the same value of the document.  Windows that break
this, or that have fewer than two plain words and other values, do not count.  A document is contaminated by an item
when at least 0.8 of the item's windows count; where values differ it is a
re-parameterised copy, else an exact one.

The windows of the benchmark are broadcast only when their counted number
fits ``BROADCAST_WINDOWS``; beyond it the join is left to Spark.

Edge cases.  A null or empty text has no windows.  A text of one to four
tokens is one window of its own and matches only as a whole.  Rows that
repeat a document id are one document, and share the verdict; a null id is
an id like others.  Repeated items count once each; an item whose windows
repeat counts each of its distinct windows once.  An empty benchmark leaves
every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelscope.llm.common import stored, table

WORDS = 5
LEAST = 0.8
PLAIN = 2                       # plain words a re-parameterised window needs
BROADCAST_WINDOWS = 500_000     # about 32 bytes each
PART = "\x1f"                   # never inside a token
NAMED = "\x1e"                  # before the value of a name
TOKEN = r"[.!?\n]|\p{L}[\p{L}\p{M}'’]*|\d+(?:[.,]\d+)*"
STOPS = (".", "!", "?", "\n")
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
# Words that are units when they follow a number.
UNITS = ("mm", "cm", "m", "km", "metre", "metres", "meter", "meters", "inch", "inches", "feet", "foot",
         "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "ml", "l",
         "litre", "litres", "liter", "liters", "second", "seconds", "minute", "minutes", "hour", "hours",
         "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro",
         "euros", "cent", "cents", "percent", "degrees", "volts", "watts")


def _element(x: Column, before: Column) -> Column:
    """Template element of a token, null for a sentence stop."""
    low = F.lower(x)
    number_before = (before >= "0") & (before < ":")
    return (F.when(x.isin(*STOPS), F.lit(None).cast("string"))
            .when((x >= "0") & (x < ":"), NUMBER)
            .when(number_before & low.isin(*UNITS), UNIT)
            .when((low != x) & before.isNotNull() & ~before.isin(*STOPS), NAME)
            .otherwise(low))


def templates(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``tokens`` in place of ``text``: an array of structs of
    the token ``r`` and its template element ``c``."""
    keep = [c for c in rows.columns if c != text]
    # ß has no capital but SS
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("ß"), F.lit("ss"))
    cut = rows.select(*keep, F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)).alias("found"))
    return cut.select(*keep, F.filter(
        F.transform("found", lambda x, i: F.struct(
            x.alias("r"), _element(x, F.get(F.col("found"), i - 1)).alias("c"))),
        lambda t: t["c"].isNotNull()).alias("tokens"))


def _typed(c: Column) -> Column:
    """Placeholders that do not depend on letter case."""
    return (c == NUMBER) | (c == UNIT)


def _folded(t: Column) -> Column:
    """Element of a token in the form without letter case."""
    return F.when(t["c"] == NAME, F.lower(t["r"])).otherwise(t["c"])


def _plain(c: Column) -> Column:
    return ~c.isin(NUMBER, UNIT, NAME)


def _slots(tokens: Column) -> Column:
    """The placeholders among some tokens, with their values."""
    return F.filter(tokens, lambda t: ~_plain(t["c"]))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t["c"]))


def _five(values: Column, at: Column) -> list[Column]:
    """The values from one place on; null behind the last, which neither
    xxhash64 nor concat_ws counts."""
    return [F.get(values, at + k) for k in range(WORDS)]


def windows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``windows``, one ``(hash, folded, values)`` per window of
    ``tokens``: the hashes of its two forms and the values of its
    placeholders, parted by PART, names behind NAMED."""
    keep = [c for c in rows.columns if c != "tokens"]
    # each token is hashed once, and a window's hash is made of five of these
    # numbers: no window is cut out of an array
    each = rows.select(*keep, "tokens", _hashes(F.col("tokens")).alias("canon"),
                       F.transform("tokens", lambda t: F.xxhash64(_folded(t))).alias("low"),
                       F.transform("tokens", lambda t: F.when(t["c"] == NAME, F.concat(F.lit(NAMED), t["r"])).when(
                           _typed(t["c"]), t["r"])).alias("held"))
    size = F.least(F.size("canon"), F.size("low"), F.size("held"))
    made = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - WORDS, F.lit(0))), lambda i: F.struct(
        F.xxhash64(*_five(F.col("canon"), i)).alias("hash"), F.xxhash64(*_five(F.col("low"), i)).alias("folded"),
        F.concat_ws(PART, *_five(F.col("held"), i)).alias("values"))))
    return each.select(*keep, "tokens", made.alias("windows"))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, first, hash, plain, item_slots, total)``: one row per distinct
    window of each item, at its first place, with its number of plain words.
    The first word may stand inside a sentence of a document, so its window
    is there with a name in that place too; it has the same ``first``, and so
    have the windows' other forms, whose names are plain words."""
    rows = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("body"))
    cut = windows(templates(rows.where("item is not null").distinct(), "body"))
    places = cut.select("item", "tokens", F.posexplode_outer("windows").alias("at", "w")).where("w is not null")
    places = places.select("item", "at", F.min("at").over(Window.partitionBy("item", "w.hash")).alias("first"),
                           F.col("w.hash").alias("hash"), F.col("w.folded").alias("folded"),
                           F.slice("tokens", F.col("at") + 1, WORDS).alias("part"))
    each = (places.groupBy("item", "hash").agg(F.min_by(F.struct("first", "part"), "first").alias("w"))
            .select("item", "hash", "w.*"))
    each = each.join(each.groupBy("item").agg(F.count("*").alias("total")), "item")
    head = F.get("part", F.lit(0))
    named = (each.where((F.col("first") == 0) & _plain(head["c"]) & (F.lower(head["r"]) != head["r"]))
             .withColumn("part", F.concat(F.array(F.struct(head["r"].alias("r"), F.lit(NAME).alias("c"))),
                                          F.slice("part", 2, WORDS)))
             .withColumn("hash", F.xxhash64(*_five(_hashes(F.col("part")), F.lit(0)))))
    lower = (places.where(F.col("folded") != F.col("hash")).groupBy("item", "first", "folded")
             .agg(F.min_by("part", "at").alias("part"))
             .join(each.select("item", "total").distinct(), "item")
             .select("item", "first", F.col("folded").alias("hash"), F.transform("part", lambda t: F.struct(
                 t["r"].alias("r"), _folded(t).alias("c"))).alias("part"), "total"))
    return each.unionByName(named).unionByName(lower).select(
        "item", "first", "hash", F.size(F.filter("part", lambda t: _plain(t["c"]))).alias("plain"),
        _slots(F.col("part")).alias("item_slots"), "total")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(row_id, item, containment, exact)`` for each document and each item
    whose windows count to at least LEAST.  Texts are read once and never
    shuffled: only windows that hit go on, with their values."""
    known = stored(item_windows(items, item_id_col, item_text_col), "item_windows")
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("body"))
    # outer: for the inner form the optimizer adds a filter on the array's
    # size and moves it, with all that makes the array, below the lambdas
    spots = (windows(templates(rows, "body")).select("row_id", F.explode_outer("windows").alias("w"))
             .where("w is not null").select("row_id", "w.*"))
    small = known.count() <= BROADCAST_WINDOWS
    index = F.broadcast(known) if small else known
    # windows with a hit in either form, before one row becomes two
    keys = stored(known.select("hash").distinct(), "item_hashes")
    keys = F.broadcast(keys) if small else keys
    spots = (spots.withColumn("folded", F.when(F.col("folded") != F.col("hash"), F.col("folded")))
             .join(keys.select("hash", F.lit(True).alias("hit")), "hash", "left")
             .join(keys.select(F.col("hash").alias("folded"), F.lit(True).alias("low_hit")), "folded", "left")
             .where("hit or low_hit"))
    forms = F.array(F.when(F.col("hit"), F.struct(F.col("hash").alias("hash"), F.lit(False).alias("low"))),
                    F.when(F.col("low_hit"), F.struct(F.col("folded").alias("hash"), F.lit(True).alias("low"))))
    spots = (spots.select("row_id", "values", F.explode_outer(forms).alias("f")).where("f is not null")
             .select("row_id", "values", "f.*"))
    # equal windows have their placeholders in the same places; the form
    # without letter case has no names
    values = F.when(F.col("values") != "", F.split("values", PART)).otherwise(F.array().cast("array<string>"))
    values = F.transform(F.filter(values, lambda v: ~(F.col("low") & v.startswith(NAMED))),
                         lambda v: F.replace(v, F.lit(NAMED), F.lit("")))
    slots = F.zip_with("item_slots", values, lambda a, b: F.struct(
        F.concat(a["c"], a["r"]).alias("slot"), a["r"].alias("item_value"), b.alias("doc_value")))
    hits = stored(spots.join(index, "hash").select("row_id", "item", "first", "total", "plain", slots.alias("slots")),
                  "window_hits")
    enough = stored(hits.groupBy("row_id", "item").agg(F.count_distinct("first").alias("n"), F.max("total").alias("t"))
                    .where(F.col("n") >= F.col("t") * LEAST)
                    .select(F.col("row_id").alias("e_id"), F.col("item").alias("e_item")), "candidates")
    both = stored(hits.join(enough, F.col("row_id").eqNullSafe(F.col("e_id")) & (F.col("item") == F.col("e_item")),
                            "left_semi"), "window_pairs")
    # the value that most often stands for an item's value
    value = (both.select("row_id", "item", F.explode("slots").alias("s"))
             .groupBy("row_id", "item", "s.slot", "s.doc_value").agg(F.count("*").alias("n"))
             .groupBy("row_id", "item", "slot").agg(F.max_by("doc_value", F.struct("n", "doc_value")).alias("v"))
             .groupBy("row_id", "item").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("values"))
             .select(F.col("row_id").alias("v_id"), F.col("item").alias("v_item"), "values"))
    value = stored(value, "slot_values")
    checked = both.join(value, F.col("row_id").eqNullSafe(F.col("v_id")) & (F.col("item") == F.col("v_item")), "left")
    same = F.forall("slots", lambda s: F.lower(s["item_value"]) == F.lower(s["doc_value"]))
    holds = F.forall("slots", lambda s: F.col("values")[s["slot"]] == s["doc_value"])
    return (checked.where(same | (holds & (F.col("plain") >= PLAIN)))
            .groupBy("row_id", "item").agg(
                (F.count_distinct("first") / F.max("total")).alias("containment"),
                F.bool_and(same).alias("exact"))
            .where(F.col("containment") >= LEAST))


def verdicts(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(row_id, contaminated, items, containment, exact)`` for every row:
    the items a document contains, the largest share of an item's windows
    and whether one of them is there with its own values."""
    pairs = matches(docs, items, id_col, text_col, item_id_col, item_text_col)
    per_doc = stored(pairs.groupBy("row_id").agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max("containment").alias("containment"),
        F.bool_or("exact").alias("exact")).withColumnRenamed("row_id", "of"), "contaminated")
    return (docs.select(F.col(id_col).cast("bigint").alias("row_id"))
            .join(per_doc, F.col("row_id").eqNullSafe(F.col("of")), "left")
            .select("row_id", F.col("items").isNotNull().alias("contaminated"),
                    F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                    F.coalesce("containment", F.lit(0.0)).alias("containment"),
                    F.coalesce("exact", F.lit(False)).alias("exact")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    gone = stored(matches(docs, items, id_col, text_col).select(F.col("row_id").alias("gone_id")).distinct(),
                  "contaminated_ids")
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col("g.gone_id")), "left_anti")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("row_id", "doc_id")
