"""XML transaction trails: files that are sequences of <transaction> elements without a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the structure of a transaction.
SCHEMA = (
    "_timestamp STRING, dbupdate ARRAY<STRUCT<_table: STRING, _type: STRING, _image: STRING, "
    "columns: STRUCT<column: ARRAY<STRUCT<_name: STRING, _key: STRING, _VALUE: STRING>>>, "
    "tokens: STRUCT<token: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>>>, _corrupt STRING"
)
END = "</transaction>"


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (order inside the file), raw: one row for each transaction; big files split at transaction ends."""
    rows = spark.read.option("lineSep", END).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value")
    return rows.filter(F.contains("value", F.lit("<transaction"))).select("file", "pos", F.concat("value", F.lit(END)).alias("raw"))


def parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.from_xml("raw", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def token(update: Column, name: str) -> Column:
    return F.get(F.filter(update["tokens"]["token"], lambda t: t["_name"] == name), F.lit(0))["_VALUE"]


def updates(rows: DataFrame, known_tables: list[str] | None = None) -> DataFrame:
    """file, pos, ts, table, kind, scn, xid, columns (map), keys: images before a change and unknown tables go.
    A transaction's number is the greatest of its updates'; an update without one raises."""
    x = parsed(rows).select("file", "pos", F.col("x._timestamp").alias("ts"), F.posexplode("x.dbupdate").alias("nth", "u"))
    x = x.filter(F.coalesce(F.col("u._image"), F.lit("")) != "before")
    if known_tables is not None:
        x = x.filter(F.col("u._table").isin(*known_tables))
    scn = token(F.col("u"), "TK-CSN").cast("bigint")
    must = F.when(scn.isNull(), F.raise_error(F.lit("an update has no TK-CSN")).cast("bigint")).otherwise(scn)
    cols = F.col("u.columns.column")
    return x.select(
        "file", "pos", "nth", "ts", F.col("u._table").alias("table_name"), F.col("u._type").alias("kind"), must.alias("scn"), token(F.col("u"), "TK-XID").alias("xid"),
        F.map_from_entries(F.transform(cols, lambda c: F.struct(c["_name"], c["_VALUE"]))).alias("columns"),
        F.transform(F.filter(cols, lambda c: c["_key"] == "true"), lambda c: c["_name"]).alias("keys"),
    )


def column(name: str, *, required: bool = True, key: bool = False) -> Column:
    """A column of an update; a missing one raises if required (a key always is), else it is null."""
    value = F.try_element_at("columns", F.lit(name))
    if not (required or key):
        return value
    return F.when(F.map_contains_key("columns", name), value).otherwise(F.raise_error(F.lit(f"missing column {name}")).cast("string"))


def missing_fields(names: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, names)), F.map_keys("columns"))) > 0


def read_trails(spark: SparkSession, path: str) -> DataFrame:
    return updates(transactions(spark, path))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Per file the first and last sequence number and its transactions."""
    return read_trails(spark, path).groupBy("file").agg(F.min("scn").alias("min_scn"), F.max("scn").alias("max_scn"), F.countDistinct("pos").alias("n"))


def find_position(files: DataFrame, scn: int) -> tuple[str, str | None]:
    """(FOUND | EXACT_SCN_NOT_FOUND | NO_TXNS_FOUND, file): the newest file that begins at or before scn. files has a row per file."""
    held = files.filter("n > 0").orderBy(F.desc("min_scn"))
    if held.isEmpty():
        return "NO_TXNS_FOUND", None
    at = held.filter(F.col("min_scn") <= scn).first() or held.orderBy("min_scn").first()
    return ("FOUND" if at["min_scn"] <= scn <= at["max_scn"] else "EXACT_SCN_NOT_FOUND"), at["file"]


def in_order(files: DataFrame, *, newest_first: bool = False) -> DataFrame:
    """files (file) in the order in which they were written: the number at the end of a name counts as a number. Columns number, file."""
    number = F.regexp_extract("file", r"(\d+)$", 1)
    rows = files.select(F.when(number != "", number.cast("bigint")).alias("number"), "file")
    return rows.orderBy(F.desc_nulls_last("number"), F.desc("file")) if newest_first else rows.orderBy(F.asc_nulls_first("number"), "file")


def validate(rows: DataFrame) -> DataFrame:
    """Rule columns for each transaction: malformed, no_xid, no_csn, bad_chars."""
    p = parsed(rows)
    updates_ = F.col("x.dbupdate")
    lacks = lambda name: F.exists(updates_, lambda u: token(u, name).isNull())
    return p.select(
        "file", "pos", (F.col("x._corrupt").isNotNull() | updates_.isNull()).alias("malformed"), F.coalesce(lacks("TK-XID"), F.lit(True)).alias("no_xid"),
        F.coalesce(lacks("TK-CSN"), F.lit(True)).alias("no_csn"), F.col("raw").rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]").alias("bad_chars"),
    )
