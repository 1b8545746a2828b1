"""Monthly KPI mart: build (M1), month-over-month columns (M3), refresh (KF1).

One scan of the fact feeds everything: the fact is aggregated once to
(month, city, category) with additive partial sums, and those rows once more
to (month, city).  The correlated "most frequent category" subquery of the
published refresh becomes a ``min_by`` in that second aggregate, with the
category name as tie-break (the published form is not deterministic on ties).

The sums are stored (``kpi_state``) and the mart is their projection.  A
refresh takes the shipments added and withdrawn since the load that the
stored sums were made from, adds their sums to those of the months they fall
in, and writes only these months of the sums and the mart; the next version
refers to the old files for all others (``refresh_stored``).  The category
join keeps shipments of an unknown category: they count in every measure and
are only ignored when the categories are ranked, as in the published form.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import metrics as M
from parcelscope.functions.metrics import count_if
from parcelscope.operators.joins import newest, star
from parcelscope.operators import quality as Q
from parcelscope.operators.upsert import upsert, upsert_counts
from parcelscope.session import shared_dir
from parcelscope.sources.load import Load
from parcelscope.sources.manifest import Catalog
from parcelscope.sources.model import changed_rows

KEYS = S.MART_KEYS


def _partials(m, until=None, from_month=None, since=None) -> DataFrame:
    """Additive sums per (month, city, category).  ``until`` keeps shipments
    dispatched before it, ``since`` those from it on."""
    where = None if from_month is None else F.col("year_month") >= from_month
    f = star(m, ["final_status", "is_first_attempt_fail", "is_returned", "delivery_cost_eur",
                 "order_value_eur", "co2_emission_kg", "route_km", "weight_kg", "is_zero_emission",
                 "dispatch_datetime"], where=where,
             dim_date=["year_month"], dim_postcode=["city"], dim_product_category=["category_name"],
             keep=("dim_product_category",))
    if until is not None:
        f = f.filter(F.col("dispatch_datetime") < until)
    if since is not None:
        f = f.filter(F.col("dispatch_datetime") >= since)
    return f.groupBy("year_month", "city", "category_name").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("final_status").isin(S.DELIVERED_STATUSES)).alias("ok"),
        count_if(F.col("is_first_attempt_fail")).alias("fails"),
        count_if(F.col("is_returned")).alias("returns"),
        F.sum("delivery_cost_eur").alias("cost"), F.count("delivery_cost_eur").alias("n_cost"),
        F.sum("order_value_eur").alias("value"),
        F.sum("co2_emission_kg").alias("co2"), F.count("co2_emission_kg").alias("n_co2"),
        F.sum("route_km").alias("km"),
        F.sum("weight_kg").alias("weight"), F.count("weight_kg").alias("n_weight"),
        count_if(F.col("is_zero_emission")).alias("zero"))


def _div(num: str, den: str):
    return F.col(num) / M.nz(F.col(den)).cast(M.COUNT_T)


_SUMS = ["n", "ok", "fails", "returns", "cost", "n_cost", "value", "co2", "n_co2", "km", "weight",
         "n_weight", "zero"]


# M1
def build_monthly_kpi(m, until=None, from_month: str | None = None) -> DataFrame:
    """City-month KPI rows; ``until`` limits to shipments dispatched before it,
    ``from_month`` ('YYYY-MM') to months from it on — a filter on the fact's
    partition column, so an incremental refresh reads only those months.

    One fact scan: the (month, city, category) partials are summed to the
    city-month, the most frequent category among them — no second scan, no
    window, no join back."""
    return _mart_from_partials(_partials(m, until, from_month))


def _mart_from_partials(p: DataFrame) -> DataFrame:
    """The city-month mart rows from (month, city, category) sums: one more
    aggregate, in which the most frequent category (J6, O4: ties by name, an
    unknown one last) is a ``min_by`` beside the sums."""
    g = p.groupBy(*KEYS).agg(
        *[F.sum(c).cast(p.schema[c].dataType).alias(f"t_{c}") for c in _SUMS],
        F.min_by("category_name", F.struct(F.col("category_name").isNull(), -F.col("n"), F.col("category_name")))
        .alias("top"))
    t = {c: F.col(f"t_{c}") for c in _SUMS}
    n = t["n"]
    return g.select(
        *KEYS,
        n.alias("total_shipments"),
        t["ok"].alias("successful_deliveries"),
        t["fails"].alias("failed_first_attempt"),
        t["returns"].alias("returned_shipments"),
        M.pct(t["ok"], n, 2).cast("decimal(6,2)").alias("otd_rate_pct"),
        M.pct(t["fails"], n, 2).cast("decimal(6,2)").alias("first_attempt_fail_pct"),
        M.pct(t["returns"], n, 2).cast("decimal(6,2)").alias("return_rate_pct"),
        F.round(_div("t_cost", "t_n_cost"), 2).cast("decimal(8,2)").alias("avg_delivery_cost_eur"),
        F.round(t["value"], 2).cast("decimal(30,2)").alias("total_revenue_eur"),
        F.round(t["co2"], 4).cast("decimal(30,4)").alias("total_co2_kg"),
        F.round(_div("t_co2", "t_n_co2"), 6).cast("decimal(14,6)").alias("avg_co2_per_shipment_kg"),
        F.round(t["km"], 2).cast("decimal(30,2)").alias("total_route_km"),
        F.round(_div("t_weight", "t_n_weight"), 2).cast("decimal(9,2)").alias("avg_weight_kg"),
        F.col("top").alias("top_product_category"),
        M.pct(t["zero"], n, 1).cast("decimal(5,1)").alias("electric_vehicle_pct"),
        # declared but never set by the published refresh (see with_mom_changes)
        F.lit(None).cast("decimal(6,2)").alias("otd_rate_mom_change_pp"),
        F.lit(None).cast("decimal(6,2)").alias("cost_mom_change_pct"),
        F.current_timestamp().alias("refreshed_at"))


# M3 — the month-over-month columns, computed like KA1's deltas
def with_mom_changes(mart: DataFrame) -> DataFrame:
    w = Window.partitionBy("city").orderBy("year_month")
    otd, cost = F.col("otd_rate_pct"), F.col("avg_delivery_cost_eur")
    return mart.withColumns({
        "otd_rate_mom_change_pp": M.delta_pp(otd, F.lag(otd).over(w), 2).cast("decimal(6,2)"),
        "cost_mom_change_pct": M.delta_pct(cost, F.lag(cost).over(w), 2).cast("decimal(6,2)"),
    })


# KF1 [M1 M2 J6 J7 F9] — refresh: aggregate, then upsert into the current mart.  On a key
# conflict only the nine listed metrics and refreshed_at change.
def refresh_monthly_kpi(m, target: DataFrame) -> DataFrame:
    fresh = build_monthly_kpi(m)
    return upsert(target, fresh, KEYS, S.MART_UPDATE_COLUMNS,
                  touch={"refreshed_at": F.current_timestamp()})


def refresh_after_partial_load(m, lag_days: int = 30) -> DataFrame:
    """KF1 as stored-table jobs on the given data: a first load commits the
    sums and the mart as of ``lag_days`` before the last dispatch (its last
    month is partial); then the shipments since are merged in.  The month
    that was partial gets the nine listed metrics updated while its other
    columns stay stale; later months are inserted; the files of earlier
    months are not touched.  The second job scans the new months only."""
    last = newest(m, "fact_deliveries", "dispatch_date", F.to_date("dispatch_datetime"))
    cutoff = F.date_sub(last, lag_days).cast("timestamp_ntz")
    catalog = Catalog(m.spark, shared_dir(m.spark, "marts", uuid.uuid4().hex))
    with Load(catalog, "FULL", MART_TABLES) as load:
        store_state(load, m, _partials(m, until=cutoff))
    month = F.date_format(cutoff, "yyyy-MM")
    _, commits = merge_state(catalog, _partials(m, since=cutoff, from_month=month), commits=load.by_table())
    return catalog.read(commits["mart_monthly_kpi"], S.MART_MONTHLY_KPI).drop("refreshed_at")


def mart_after_late_batch(m, late_days: int = 400, wrong_days: int = 800) -> DataFrame:
    """KF1 from stored sums when shipments come late or were wrong: the sums
    are first stored without one warehouse's shipments of the month
    ``late_days`` before the last dispatch, and with a wrong cost for
    another's of the month ``wrong_days`` before; a batch then brings the late
    ones, withdraws the wrong ones and adds them as they are.  Only the two
    months are scanned for it.  Returns the projection of the sums, which is
    the mart of all shipments."""
    last = newest(m, "fact_deliveries", "dispatch_date", F.to_date("dispatch_datetime"))
    fact = m.fact_deliveries

    def of(days: int, warehouse: str):
        return ((F.col("year_month") == F.date_format(F.date_sub(last, days), "yyyy-MM"))
                & (F.col("warehouse_id") == warehouse))

    def partials(rows):
        return _partials(replace(m, tables={**m.tables, "fact_deliveries": rows}))

    late, wrong = of(late_days, "WH-3"), of(wrong_days, "WH-1")
    cost = (F.col("delivery_cost_eur") + F.lit(1)).cast("decimal(8,2)")
    first = fact.filter(~late).withColumn("delivery_cost_eur", F.when(wrong, cost).otherwise(F.col("delivery_cost_eur")))
    catalog = Catalog(m.spark, shared_dir(m.spark, "marts", uuid.uuid4().hex))
    with Load(catalog, "FULL", MART_TABLES) as load:
        store_state(load, m, partials(first))
    _, commits = merge_state(catalog, partials(fact.filter(late | wrong)),
                             partials(fact.filter(wrong).withColumn("delivery_cost_eur", cost)), commits=load.by_table())
    return _mart_from_partials(catalog.read(commits["kpi_state"], S.KPI_STATE)).drop("refreshed_at")


# --- stored sums ------------------------------------------------------------
MART_TABLES = ["kpi_state", "mart_monthly_kpi"]


def _as_state(p: DataFrame) -> DataFrame:
    return p.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.KPI_STATE.fields])


def store_state(load: Load, m, partials: DataFrame | None = None) -> None:
    """The sums of the whole fact and the mart projected from the written
    sums, as tables of a full load."""
    sums = _as_state(_partials(m) if partials is None else partials)
    state = load.write("kpi_state", sums, S.KPI_STATE, "year_month", folders=False,
                       marks={"base": F.lit(m.commits["fact_deliveries"].load_id if "fact_deliveries" in m.commits else "")})
    written = load.catalog.read(load.by_table()["kpi_state"], S.KPI_STATE)
    load.write("mart_monthly_kpi", _mart_from_partials(written), S.MART_MONTHLY_KPI, "year_month", folders=False,
               marks={"base": F.lit(state.marks.get("base", ""))})


def merge_state(catalog: Catalog, added: DataFrame, withdrawn: DataFrame | None = None, base: str = "",
                commits: dict | None = None) -> tuple[list[str], dict]:
    """Merge the sums of added shipments, and the inverse of withdrawn ones,
    into the stored sums and upsert the mart (KF1) for the months they fall
    in.  Returns these months and the new commits.  The months are found in
    the sums, which are few rows, so the shipments are scanned once.
    ``commits`` are the newest ones, if the caller has just read them."""
    delta = _as_state(added)
    if withdrawn is not None:
        minus = _as_state(withdrawn)
        delta = delta.unionByName(minus.select(*KEYS, "category_name", *[(-F.col(c)).alias(c) for c in _SUMS]))
    with Load(catalog, "REFRESH", MART_TABLES, parents=commits) as load:
        commits = load.parents
        # written once: the shipments are scanned for the months and the sums
        delta.write.parquet(catalog.folder("kpi_delta", load.load_id))
        delta = catalog.spark.read.schema(S.KPI_STATE).parquet(catalog.folder("kpi_delta", load.load_id))
        months = [r[0] for r in delta.select("year_month").distinct().collect()]
        old = catalog.read(commits["kpi_state"], S.KPI_STATE, values=months)
        key = [*KEYS, "category_name"]
        merged = (old.unionByName(delta).groupBy(*key).agg(*[F.sum(c).alias(c) for c in _SUMS])
                  .filter(F.col("n") > 0))
        load.write("kpi_state", _as_state(merged), S.KPI_STATE, "year_month", replaces=months, folders=False,
                   marks={"base": F.lit(base)})
        fresh = _mart_from_partials(catalog.read(load.by_table()["kpi_state"], S.KPI_STATE, values=months))
        current = catalog.read(commits["mart_monthly_kpi"], S.MART_MONTHLY_KPI, values=months)
        known = upsert_counts(current, fresh, KEYS).first()
        load.write("mart_monthly_kpi", upsert(current, fresh, KEYS, S.MART_UPDATE_COLUMNS,
                                              touch={"refreshed_at": F.current_timestamp()}),
                   S.MART_MONTHLY_KPI, "year_month", replaces=months, folders=False, marks={"base": F.lit(base)},
                   updated=known.rows_updated)
    return sorted(months), commits | load.by_table()


def refresh_stored(m) -> list[str] | None:
    """KF1 for a committed model: brings the stored sums and the mart up to
    the fact's newest commit by the shipments that changed since, or rebuilds
    them where a full load lies between.  Returns the months written, None
    after a rebuild."""
    commits = m.catalog.newest()
    fact, base = commits["fact_deliveries"].load_id, commits["kpi_state"].marks.get("base")
    changed = changed_rows(m, base)
    if changed is None:
        with Load(m.catalog, "FULL", MART_TABLES) as load:
            store_state(load, m)
        return None
    added, gone = (_partials(replace(m, tables={**m.tables, "fact_deliveries": rows})) for rows in changed)
    return merge_state(m.catalog, added, gone, base=fact, commits=commits)[0]


def stored_mart(m) -> DataFrame:
    """The newest committed mart."""
    return m.catalog.read(m.catalog.newest()["mart_monthly_kpi"], S.MART_MONTHLY_KPI)


def _stored_mart(spark, path: str | None, like: DataFrame) -> DataFrame:
    """The stored mart at ``path`` in ``like``'s column order, or an empty
    mart when there is none yet (first refresh inserts every key)."""
    if path:
        try:
            return spark.read.parquet(path).select(*like.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], like.schema)


def refresh_to(m, new_path: str, current_path: str | None = None,
               audit_path: str | None = None, from_month: str | None = None) -> DataFrame:
    """KF1 as a stored-table job: upsert this month's aggregate into the mart
    at ``current_path`` and write the result as a new version at
    ``new_path`` (partitioned by ``year_month``; never over the path being
    read).  The fresh aggregate — city-month rows, small — is checkpointed
    to the cluster's checkpoint folder so the upsert and its insert/update
    counts reuse it instead of re-scanning the fact, and a lost executor
    does not re-run the aggregation.  With ``audit_path`` the load log (M10)
    gets a RUNNING row at the start and a SUCCESS row with the counts, or a
    FAILED row with the error, at the end.  ``from_month`` limits
    the recomputation to months from it on (the others keep their stored
    rows).  Returns the new mart."""
    if current_path and new_path.rstrip("/") == current_path.rstrip("/"):
        raise ValueError("new_path must differ from current_path (the upsert reads it)")
    spark = m.spark
    with Q.audited(spark, audit_path, "mart_monthly_kpi", "REFRESH") as audit:
        fresh = build_monthly_kpi(m, from_month=from_month).checkpoint(eager=True)
        current = _stored_mart(spark, current_path, fresh)
        merged = upsert(current, fresh, KEYS, S.MART_UPDATE_COLUMNS,
                        touch={"refreshed_at": F.current_timestamp()})
        # overwrite: the new version's folder is this job's alone, so a rerun
        # after a failed attempt replaces any partial output
        (merged.hint("rebalance", "year_month").write.mode("overwrite")
         .partitionBy("year_month").parquet(new_path))
        audit.counts = upsert_counts(current, fresh, KEYS)
    return spark.read.parquet(new_path).select(*fresh.columns)
