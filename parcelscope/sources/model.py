"""The delivery model: star schema, flat (business-question) views, marts.

``model_for(spark, sf_dir)`` returns lazily built DataFrames over the given
tables.  ``materialize(model)`` is the load: every table is validated,
written as Parquet (the fact by ``year_month``, the stock by snapshot date)
and committed to a manifest (see ``manifest`` and ``load``); the monthly mart
and the sums it is projected from are stored too.  Later queries read the
committed version with partition pruning, column pruning and pushed filters
instead of re-running the fixture joins; counts and high-water marks come
from the manifest.  ``loaded_model_for`` reuses a committed load, also that of
an earlier session, while the files of its sources are the same.
"""

from __future__ import annotations

import datetime
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from parcelscope.session import shared_dir, shared_root
from parcelscope.sources import calendar, ingest, tpch_fixture
from parcelscope.sources.load import Load
from parcelscope.sources.manifest import Catalog, fingerprint

SOURCE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
MODEL_TABLES = ["fact_deliveries", "dim_date", "dim_postcode", "dim_driver", "dim_warehouse",
                "dim_product_category", "mart_inventory_snapshot", "mart_daily_forecast"]


@dataclass
class Staged:
    """How a table is made: ``rows`` with its source columns, and ``derive(rows,
    kept)``, which gives the table's columns after those named ``kept``.  It
    holds for ``table``, the DataFrame made that way, and no other."""
    table: DataFrame
    rows: DataFrame
    derive: Callable


@dataclass
class Model:
    spark: SparkSession
    tables: dict
    source: str = ""
    materialized_at: str | None = None
    sources: dict = field(default_factory=dict)
    # newest value per (table, column), noted when the load writes a table
    marks: dict = field(default_factory=dict)
    # where the tables are committed, and the manifest row of each
    catalog: Catalog | None = None
    commits: dict = field(default_factory=dict)
    # tables whose load moves their source columns instead of their rows
    staged: dict = field(default_factory=dict)

    def __getattr__(self, name):
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def register_views(self, which: str = "star", prefix: str = "") -> list:
        """Temp views for querying the model in SQL (``spark.sql``).

        ``which="star"`` registers the star tables (``fact_deliveries``,
        ``dim_date``, ``dim_postcode`` …) the KPI statements read;
        ``which="flat"`` the six flat tables the business questions read
        (their ``fact_deliveries`` carries ``city``).  The two models share
        table names, so they are registered separately or with a prefix.
        Returns the registered names."""
        if which == "star":
            views = dict(self.tables)
        elif which == "flat":
            from parcelscope.plans.loading import flat_tables
            views = flat_tables(self)
        else:
            raise ValueError(f"which must be 'star' or 'flat', not {which!r}")
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in views]

    # --- flat (business-question) model --------------------------------
    @cached_property
    def flat_fact(self) -> DataFrame:
        """The flat ``fact_deliveries`` the business questions read:
        ``flat_rows`` with the zone's city and the category's name.  Both
        are left joins: the published table stores them on the row, so a
        shipment of an unknown zone or category is still there."""
        pc = self.dim_postcode.select("postcode_pc4", "city")
        cat = self.dim_product_category.select("category_id", F.col("category_name").alias("product_category"))
        return self.flat_rows.join(pc, "postcode_pc4", "left").join(cat, "category_id", "left").drop("category_id")

    @cached_property
    def flat_cities(self) -> DataFrame:
        """``flat_rows`` with the zone's city only."""
        pc = self.dim_postcode.select("postcode_pc4", "city")
        return self.flat_rows.join(pc, "postcode_pc4", "left")

    @cached_property
    def flat_rows(self) -> DataFrame:
        """The flat fact without looked-up columns, for questions that need
        neither city nor category: calendar labels stored on the row, columns
        named as the load renames them (month→month_name, year→year_num,
        year_month→yr_month).  No join."""
        from parcelscope import schemas as S
        from parcelscope.sources.ingest import rename
        d = F.to_date("dispatch_datetime")
        sheet = self.fact_deliveries.withColumns(
            {"dispatch_date": d, "month": F.date_format(d, "MMMM"), "year": F.year(d)})
        return rename(sheet, S.RENAME_DELIVERIES)

    @cached_property
    def flat_postcodes(self) -> DataFrame:
        """``dim_postcodes`` of the flat model: locker flag as 'Yes'/'No'."""
        return self.dim_postcode.select(
            "postcode_pc4", "city", "district", "zone_type",
            F.when(F.col("parcel_locker_nearby"), F.lit("Yes")).otherwise(F.lit("No"))
            .alias("parcel_locker_nearby"),
            "historical_fail_rate_pct")

    @cached_property
    def flat_drivers(self) -> DataFrame:
        """``dim_drivers``: sheet columns ``name``/``active`` renamed on load."""
        from parcelscope import schemas as S
        from parcelscope.sources.ingest import rename
        sheet = self.dim_driver.withColumnsRenamed({"driver_name": "name", "is_active": "active"})
        return rename(sheet, S.RENAME_DRIVERS)

    @cached_property
    def flat_inventory(self) -> DataFrame:
        """``warehouse_inventory``: sheet column ``status`` renamed on load."""
        from parcelscope import schemas as S
        from parcelscope.sources.ingest import rename
        return rename(self.mart_inventory_snapshot.withColumnRenamed("stock_status", "status"),
                      S.RENAME_INVENTORY)

    @cached_property
    def flat_forecast(self) -> DataFrame:
        """``daily_volume_forecast``: ``date``/``month``/``year`` renamed on load."""
        from parcelscope import schemas as S
        from parcelscope.sources.ingest import rename
        sheet = self.mart_daily_forecast.withColumnsRenamed(
            {"forecast_date": "date", "month_name": "month", "year": "year"})
        return rename(sheet, S.RENAME_FORECAST).withColumnRenamed("peak_event_name", "peak_event")


def read_sources(spark: SparkSession, sf_dir: str) -> dict:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in SOURCE_TABLES}


def build_model(spark: SparkSession, sf_dir: str) -> Model:
    src = read_sources(spark, sf_dir)
    rows = tpch_fixture.fact_rows(src["lineitem"], src["orders"], src["customer"], src["part"])
    tables = {
        "fact_deliveries": tpch_fixture.derive_fact(rows),
        "dim_date": calendar.calendar_spanning(src["lineitem"], "l_shipdate"),
        "dim_postcode": tpch_fixture.build_dim_postcode(src["nation"], src["region"]),
        "dim_driver": tpch_fixture.build_dim_driver(src["supplier"], src["region"]),
        "dim_warehouse": tpch_fixture.build_dim_warehouse(src["supplier"], src["region"]),
        "dim_product_category": tpch_fixture.build_dim_product_category(src["part"]),
        "mart_inventory_snapshot": tpch_fixture.build_inventory_snapshot(src["lineitem"], src["part"]),
        "mart_daily_forecast": tpch_fixture.build_daily_forecast(src["events"], src["region"]),
    }
    staged = {"fact_deliveries": Staged(tables["fact_deliveries"], rows, tpch_fixture.derive_fact)}
    return Model(spark, tables, source=sf_dir, sources=src, staged=staged)


_CACHE: dict = {}


def model_for(spark: SparkSession, sf_dir: str) -> Model:
    """One lazily built model per (session, source folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = build_model(spark, sf_dir)
    return _CACHE[key]


# Version of the derivation: a committed load of other rules is not reused.
DERIVATION = "r3"
PARTITION_COLUMNS = {"fact_deliveries": ["year_month"], "mart_inventory_snapshot": ["snapshot_date"]}
# rows sorted inside each month's files: failures and zones cluster, so the
# failed-only and per-zone filters skip row groups by their statistics
SORT_COLUMNS = {"fact_deliveries": ["attempt_1_status", "postcode_pc4"]}
# newest values a load observes while it writes; queries need not search for them
MARKS = {
    "fact_deliveries": {"dispatch_date": "to_date(dispatch_datetime)"},
    "mart_inventory_snapshot": {"snapshot_date": "snapshot_date"},
    "mart_daily_forecast": {"forecast_date": "forecast_date"}}
_LOADED: dict = {}
_LOADED_LOCK = threading.Lock()


def loaded_model_for(spark: SparkSession, sf_dir: str) -> Model:
    """The committed model of ``sf_dir``: the newest load under
    ``spark.checkpoint.dir`` while the files of the sources are those it was
    made from, else a new load."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOADED_LOCK:   # queries submitted from several threads load once
        if key not in _LOADED:
            model = model_for(spark, sf_dir)
            catalog = Catalog(spark, f"{shared_root(spark)}/parcelscope/model")
            print_ = f"{DERIVATION}:{fingerprint(spark, source_paths(sf_dir))}"
            same = (F.col("source") == sf_dir) & (F.col("fingerprint") == print_)
            found = catalog.newest(same)
            _LOADED[key] = (open_model(catalog, found, model) if set(STORED_TABLES) <= set(found) else
                            commit_model(model, catalog, print_))
        return _LOADED[key]


def source_paths(sf_dir: str) -> dict:
    return {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCE_TABLES}


def declared_schemas() -> dict:
    """Table name → declared ``StructType`` of the star model."""
    from parcelscope import schemas as S
    return {"fact_deliveries": S.FACT_DELIVERIES, "dim_date": S.DIM_DATE,
            "dim_postcode": S.DIM_POSTCODE, "dim_driver": S.DIM_DRIVER,
            "dim_warehouse": S.DIM_WAREHOUSE, "dim_product_category": S.DIM_PRODUCT_CATEGORY,
            "mart_inventory_snapshot": S.MART_INVENTORY_SNAPSHOT,
            "mart_daily_forecast": S.MART_DAILY_FORECAST}


def read_model(spark: SparkSession, root: str, fmt: str = "parquet") -> Model:
    """A model over star tables stored under ``root``: the newest committed
    version of each where a load wrote them, else a user's own tables at
    ``root/<table>``, read with the declared schemas — no inference pass,
    columns in contract order, partition columns from the folder layout."""
    catalog = Catalog(spark, root)
    commits = catalog.newest()
    if set(MODEL_TABLES) <= set(commits):
        return open_model(catalog, commits)
    tables = {}
    for name, schema in declared_schemas().items():
        df = ingest.read_table(spark, f"{root.rstrip('/')}/{name}", schema, fmt)
        tables[name] = df.select(*schema.fieldNames())
    return Model(spark, tables, source=root, materialized_at=root)


def open_model(catalog: Catalog, commits: dict, like: Model | None = None) -> Model:
    """The model of committed versions; ``like`` gives its sources and the
    tables that are not committed."""
    tables = dict(like.tables) if like else {}
    tables |= {name: catalog.read(commits[name], schema) for name, schema in declared_schemas().items() if name in commits}
    marks = {(t, k): datetime.date.fromisoformat(commits[t].marks[k]) for t, own in MARKS.items() for k in own
             if t in commits and k in commits[t].marks}
    return Model(catalog.spark, tables, source=like.source if like else catalog.root,
                 materialized_at=catalog.root, sources=like.sources if like else {}, marks=marks,
                 catalog=catalog, commits=commits)


def materialize(model: Model, path: str | None = None) -> Model:
    """Load the model into ``path`` and return the committed model.

    ``path`` defaults to a fresh folder under ``spark.checkpoint.dir`` (the
    cluster's shared folder), never a machine-local temp folder.  Facts that
    break a row rule are left out and kept with their reasons; the load log
    beside the tables has the life cycle and the counts of each table."""
    return commit_model(model, Catalog(model.spark, path or shared_dir(model.spark, "model", uuid.uuid4().hex)))


def write_table(load: Load, model: Model, name: str, **kept) -> None:
    """One table of the model as part of a load run."""
    from parcelscope.plans.loading import fact_rules
    staged = model.staged.get(name)
    if staged and staged.table is model.tables[name]:
        rows, kept["derive"] = staged.rows, staged.derive
    else:
        rows = model.tables[name]
    load.write(name, rows, declared_schemas()[name], PARTITION_COLUMNS.get(name, [None])[0],
               SORT_COLUMNS.get(name), rules=fact_rules() if name == "fact_deliveries" else None,
               marks={k: F.expr(e) for k, e in MARKS.get(name, {}).items()}, **kept,
               small=name == "mart_inventory_snapshot")


def commit_model(model: Model, catalog: Catalog, print_: str = "") -> Model:
    """Full load (S6, M10): all tables of the model, then the sums and the
    mart from the written fact, committed together.  Repeated line keys are
    reported (M7), not rejected: the published fact numbers its rows itself."""
    from parcelscope.plans import marts
    with Load(catalog, "FULL", STORED_TABLES, model.source, print_) as load:
        for name in MODEL_TABLES:
            # partitioned tables are rebalanced by AQE: a partition value holding
            # a large share of the rows is split over tasks, not sent to one
            write_table(load, model, name)
        written = open_model(catalog, load.by_table(), model)
        marts.store_state(load, written)
    return open_model(catalog, load.by_table(), model)


def with_calendar(m: Model, holidays: DataFrame | None = None, peaks: DataFrame | None = None) -> Model:
    """The model with holidays and peaks from tables (S13): the calendar is
    marked by them, and each shipment's peak flag is its day's.  The calendar
    has one row a day; the joins that mark it hide that from Spark, which
    would shuffle the shipments to it."""
    days = calendar.mark_days(m.dim_date, holidays, peaks)
    columns = m.fact_deliveries.columns
    flag = days.select("date_key", F.col("is_peak_period").alias("is_peak"))
    fact = (m.fact_deliveries.join(F.broadcast(flag), "date_key", "left")
            .withColumn("is_peak_period", F.coalesce("is_peak", F.lit(False))).select(*columns))
    return Model(m.spark, {**m.tables, "dim_date": days, "fact_deliveries": fact}, m.source,
                 m.materialized_at, m.sources, m.marks)


def load_new_days(model: Model, loaded: Model) -> Model:
    """Incremental load of the fact by the high-water mark: ``model``'s
    shipments dispatched after the newest committed day become folders of
    their own beside the stored ones, and the calendar is written anew to
    span them.  Other tables keep their version.  The filter is on the
    dispatch time alone, so the sources are pruned by it."""
    mark = loaded.marks[("fact_deliveries", "dispatch_date")]
    after = F.lit(mark + datetime.timedelta(days=1)).cast("timestamp_ntz")
    new = model.fact_deliveries.filter(F.col("dispatch_datetime") >= after)
    fresh = Model(model.spark, {**model.tables, "fact_deliveries": new}, model.source, sources=model.sources)
    with Load(loaded.catalog, "INCREMENTAL", ["fact_deliveries", "dim_date"], model.source) as load:
        write_table(load, fresh, "fact_deliveries", adds=True)
        write_table(load, fresh, "dim_date")
    return open_model(loaded.catalog, loaded.commits | load.by_table(), model)


def correct_shipments(loaded: Model, batch: DataFrame, withdrawn: DataFrame | None = None) -> Model:
    """Late and corrected shipments: the rows of ``batch`` (columns of the
    fact) are added, the stored rows named by ``withdrawn``
    (``shipment_id``, ``year_month``) are taken out.  Only the months in
    either are read and written again; what was added and taken out is
    stored as the load's change feed, from which the mart is refreshed."""
    from parcelscope import schemas as S
    spark, catalog, name = loaded.spark, loaded.catalog, "fact_deliveries"
    columns = S.FACT_DELIVERIES.fieldNames()
    none = spark.createDataFrame([], "shipment_id string, year_month string")
    gone = (none if withdrawn is None else withdrawn.select("shipment_id", "year_month")).distinct()
    months = [r[0] for r in batch.select("year_month").unionByName(gone.select("year_month")).distinct().collect()]
    with Load(catalog, "INCREMENTAL", [name, FEED], loaded.source) as load:
        stored = catalog.read(loaded.commits[name], S.FACT_DELIVERIES, values=months)
        key = ["shipment_id", "year_month"]
        feed = (batch.select(*columns).withColumn("sign", F.lit(1))
                .unionByName(stored.join(gone, key, "left_semi").select(*columns).withColumn("sign", F.lit(-1))))
        load.write(FEED, feed, FEED_SCHEMA(), "year_month")
        months_now = stored.join(gone, key, "left_anti").select(*columns).unionByName(batch.select(*columns))
        fresh = Model(spark, {name: months_now}, loaded.source)
        write_table(load, fresh, name, replaces=months)
    return open_model(catalog, loaded.commits | load.by_table(), loaded)


FEED = "fact_changes"
# tables of a full load: the model's, the mart's sums and the mart
STORED_TABLES = [*MODEL_TABLES, "kpi_state", "mart_monthly_kpi"]


def FEED_SCHEMA():
    from pyspark.sql import types as T

    from parcelscope import schemas as S
    return T.StructType([*S.FACT_DELIVERIES.fields, T.StructField("sign", T.IntegerType())])


def changed_rows(loaded: Model, base: str | None) -> tuple[DataFrame, DataFrame] | None:
    """(added, withdrawn) shipments since the load ``base`` of the fact; None
    where a full load lies between.  Reads the loads' own rows only."""
    from parcelscope import schemas as S
    catalog, name = loaded.catalog, "fact_deliveries"
    loads = catalog.since(name, base)
    if loads is None:
        return None
    ran = {(r.load_id, r.table_name): r for r in catalog.commits().filter(F.col("load_id").isin(loads)).collect()}
    added = catalog.spark.createDataFrame([], S.FACT_DELIVERIES)
    gone = added
    for x in loads:
        if (x, FEED) in ran:
            feed = catalog.read(ran[x, FEED], FEED_SCHEMA())
            added = added.unionByName(feed.filter("sign > 0").drop("sign"))
            gone = gone.unionByName(feed.filter("sign < 0").drop("sign"))
        else:
            own = ran[x, name].asDict()
            own["parts"] = [p for p in own["parts"] if p.load_id == x]
            added = added.unionByName(catalog.read(Row(**own), S.FACT_DELIVERIES))
    return added, gone
