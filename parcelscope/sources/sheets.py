"""Raw sheets: a contract per sheet, from its raw names and texts to the
columns of the flat model (S1–S6, M5, M9).

A sheet comes as text under the names its authors gave it.  Its contract says
of each column the type, the load's name, whether a value must be there, what
an absent one means and which labels it may hold.  ``conform`` reads the texts
by it in one pass of column expressions: blanks are NULL, absent values take
their default, labels are compared without case, spaces and marks and come out
in the declared spelling.  What cannot be read is named in ``problems``;
``load_sheets`` writes such rows to the partition ``rejected=true`` of the
sheet's table, logs and commits it like any other load.

Edge cases.  A text that is no number, date or yes/no is ``type:<column>``, an
unknown label ``domain:<column>``, a missing required value
``not_null:<column>``; a row can have several.  Columns the contract does not
name are ignored, one that the sheet does not have is blank in every row.  A
sheet without rows is an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope import schemas as S
from parcelscope.operators.quality import Rule
from parcelscope.sources import ingest
from parcelscope.sources.load import Load
from parcelscope.sources.manifest import Catalog

# Texts that stand for yes and no.
YES = ("yes", "y", "true", "1")
NO = ("no", "n", "false", "0")


@dataclass(frozen=True)
class Field:
    """One column of a raw sheet.  ``labels`` are its declared spellings,
    ``also`` other ones with the label each stands for."""
    raw: str
    type: str = "string"
    required: bool = False
    default: object = None
    labels: tuple = ()
    also: tuple = ()            # (other spelling, label)


@dataclass(frozen=True)
class Sheet:
    name: str
    fields: tuple
    renames: dict

    def to(self, field: Field) -> str:
        """The load's name of a column."""
        return self.renames.get(field.raw, field.raw)

    @property
    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.raw, T.StringType()) for f in self.fields])

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(self.to(f), T.DataType.fromDDL(f.type)) for f in self.fields])

    def rules(self) -> list[Rule]:
        """One rule per way a value of the sheet can be refused."""
        kinds = [(kind, self.to(f)) for f in self.fields for kind in _kinds(f)]
        return [Rule(kind, c, ~F.array_contains("problems", f"{kind}:{c}")) for kind, c in kinds]


def _kinds(f: Field) -> list[str]:
    return ["type"] * (f.type != "string") + ["domain"] * bool(f.labels) + ["not_null"] * f.required


def _bare(c: Column) -> Column:
    """A label without case, spaces and marks."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def _spelled(text: Column, f: Field) -> Column:
    """The declared spelling of a label, NULL for an unknown one."""
    pairs = [(label, label) for label in f.labels] + list(f.also)
    known = F.create_map(*[x for other, label in pairs for x in (_bare(F.lit(other)), F.lit(label))])
    return F.try_element_at(known, _bare(text))


def _read(text: Column, f: Field) -> Column:
    if f.labels:
        return _spelled(text, f)
    if f.type == "boolean":
        low = F.lower(text)
        return F.when(low.isin(*YES), True).when(low.isin(*NO), False)
    return text if f.type == "string" else text.try_cast(f.type)


def conform(raw: DataFrame, sheet: Sheet) -> DataFrame:
    """The sheet's columns under the load's names and types, and
    ``problems``: what could not be read, in the order of the columns."""
    names = [f.raw for f in sheet.fields]
    given = {c: F.col(f"`{c}`") if c in raw.columns else F.lit(None) for c in names}
    texts = raw.select(*[F.nullif(F.trim(c.cast("string")), F.lit("")).alias(n) for n, c in given.items()])
    values, problems = [], []
    for f in sheet.fields:
        text, to = F.col(f"`{f.raw}`"), sheet.to(f)
        value = _read(text, f)
        refused = text.isNotNull() & value.isNull()
        if f.type != "string" or f.labels:
            problems.append(F.when(refused, F.lit(("domain:" if f.labels else "type:") + to)))
        if f.default is not None:
            value = F.when(text.isNull(), F.lit(f.default).cast(f.type)).otherwise(value)
        elif f.required:
            problems.append(F.when(text.isNull(), F.lit("not_null:" + to)))
        values.append(value.alias(to))
    return texts.select(*values, F.array_compact(F.array(*problems)).alias("problems"))


def read_sheet(spark: SparkSession, path: str, sheet: Sheet, fmt: str = "csv", **options) -> DataFrame:
    """The raw texts of a sheet's files.  CSV (the default) has a header that
    names the columns, in any order and with others between them; files of one
    folder must have the same one.  Spaces are kept for ``conform``."""
    if fmt != "csv":
        return ingest.read_table(spark, path, sheet.raw_schema, fmt, **options)
    options = {"header": True, "enforceSchema": False, "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False} | options
    return ingest.read_table(spark, path, None, fmt, **options)


def load_sheets(catalog: Catalog, raw: dict[str, DataFrame], sheets: Iterable[Sheet]) -> dict[str, DataFrame]:
    """Conform, check, write and commit the sheets in ``raw`` (name → texts)
    as one run.  Returns the loaded tables; ``rejects`` has the rest."""
    todo = [s for s in sheets if s.name in raw]
    with Load(catalog, "FULL", [s.name for s in todo]) as load:
        for s in todo:
            load.write(s.name, conform(raw[s.name], s), s.schema, rules=s.rules(), as_read=True)
        commits = load.by_table()
    return {s.name: catalog.read(commits[s.name], s.schema) for s in todo}


def rejects(catalog: Catalog, sheet: Sheet) -> DataFrame:
    """Rows of a sheet that loads refused, with their ``reject_reasons``."""
    return catalog.rejected(sheet.name, sheet.schema)


DRIVERS = Sheet("dim_drivers", (
    Field("driver_id", required=True), Field("name", required=True), Field("city", required=True),
    Field("years_experience", "smallint", required=True),
    Field("vehicle_type", required=True, labels=tuple(S.VEHICLE_TYPES), also=(("E-Van", "Electric Van"),)),
    Field("contract_type", required=True, labels=tuple(S.CONTRACT_TYPES)),
    Field("avg_rating", "decimal(3,2)"), Field("on_time_rate_pct", "decimal(5,2)"),
    Field("active", "boolean", default=True), Field("join_date", "date")), S.RENAME_DRIVERS)
DELIVERIES = Sheet("fact_deliveries", (
    Field("shipment_id", required=True), Field("dispatch_datetime", "timestamp_ntz", required=True),
    Field("month"), Field("year", "int"), Field("year_month"), Field("postcode_pc4", "smallint", required=True),
    Field("vehicle_type", required=True, labels=tuple(S.VEHICLE_TYPES), also=(("E-Van", "Electric Van"),)),
    Field("weight_kg", "decimal(7,2)", required=True),
    Field("attempt_1_status", required=True, labels=tuple(S.ATTEMPT_1_STATUSES)),
    Field("attempt_2_status", labels=tuple(S.ATTEMPT_2_STATUSES)), Field("fail_reason"),
    Field("final_status", required=True, labels=tuple(S.FINAL_STATUSES)),
    Field("delivery_cost_eur", "decimal(8,2)", required=True),
    Field("is_peak_period", "boolean", default=False)), S.RENAME_DELIVERIES)
INVENTORY = Sheet("warehouse_inventory", (
    Field("snapshot_date", "date", required=True), Field("warehouse_id", required=True), Field("sku_code"),
    Field("product_category", required=True), Field("current_stock_units", "bigint", required=True),
    Field("days_of_supply", "decimal(24,1)"), Field("stockout_days_ytd", "smallint", default=0),
    Field("status", labels=tuple(S.STOCK_STATUSES), also=(("Crit.", "Critical"),))), S.RENAME_INVENTORY)
FORECAST = Sheet("daily_volume_forecast", (
    Field("date", "date", required=True), Field("city", required=True), Field("month"), Field("year", "smallint"),
    Field("is_public_holiday", "boolean", default=False), Field("is_peak_period", "boolean", default=False),
    Field("peak_event"), Field("actual_volume", "decimal(10,0)"), Field("forecast_volume", "decimal(10,0)", required=True),
    Field("data_type", labels=tuple(S.DATA_TYPES))), S.RENAME_FORECAST)
SHEETS = (DRIVERS, DELIVERIES, INVENTORY, FORECAST)
