"""Schemas and codes of the change log."""

from __future__ import annotations

from enum import Enum, IntEnum

from pyspark.sql import types as T

CHANGE_LOG = (
    "pp_id INT, lp_id INT, src_id INT, log_id INT, id BIGINT, scn BIGINT, window_scn BIGINT, seq BIGINT, srckey STRING, "
    "key_long BIGINT, key_type STRING, opcode STRING, ts_ns BIGINT, schema_id STRING, schema_version SMALLINT, "
    "is_replicated BOOLEAN, is_trace BOOLEAN, size_bytes INT, payload_bytes INT, payload STRING"
)
SNAPSHOT = "src_id INT, id BIGINT, scn BIGINT, srckey STRING, opcode STRING, payload STRING"

#: Fixed value: the sequence number of a transaction whose number is not known yet.
INFINITY_SCN = 9999999999999999


class ControlType(IntEnum):
    """Negative source ids of control rows."""

    END_OF_PERIOD = -2
    CHECKPOINT = -3
    BOOTSTRAP_TOO_OLD = -5
    PULLER_RETRIES_EXPIRED = -6
    SCN_REGRESS = -51


class ClientMode(Enum):
    INIT = "INIT"
    BOOTSTRAP_SNAPSHOT = "BOOTSTRAP_SNAPSHOT"
    BOOTSTRAP_CATCHUP = "BOOTSTRAP_CATCHUP"
    ONLINE_CONSUMPTION = "ONLINE_CONSUMPTION"


class ConsumerResult(IntEnum):
    """A batch's result is the greatest of its callbacks' results."""

    SUCCESS = 0
    CHECKPOINT = 100
    SKIP_CHECKPOINT = 150
    ERROR = 200
    ERROR_FATAL = 300

    @property
    def ok(self) -> bool:
        return self < ConsumerResult.ERROR


class SourceStatus(IntEnum):
    """Life of a bootstrapped source."""

    UNKNOWN = 0
    NEW = 1
    SEEDING = 2
    SEEDING_CATCHUP = 3
    ACTIVE = 4
    INACTIVE = 5
    FELL_OFF_RELAY = 6


class ScnNotFound(Exception):
    """The sequence number asked for is older than the log; bootstrap is the way on."""


#: Database types and the columns that hold them; dates are epoch milliseconds in the log.
TYPES = {
    **dict.fromkeys(("INTEGER", "LONG", "INT", "BIGINT"), T.LongType()),
    **dict.fromkeys(("TINYINT", "SMALLINT", "MEDIUMINT", "YEAR"), T.IntegerType()),
    "FLOAT": T.FloatType(),
    **dict.fromkeys(("DOUBLE", "DECIMAL"), T.DoubleType()),
    **dict.fromkeys(("CHAR", "VARCHAR", "VARCHAR2", "NVARCHAR", "NVARCHAR2", "CLOB", "XMLTYPE"), T.StringType()),
    **dict.fromkeys(("RAW", "BLOB"), T.BinaryType()),
    **dict.fromkeys(("DATE", "TIMESTAMP", "DATETIME"), T.LongType()),
}


def column_type(db_type: str, precision: int = 0, scale: int = 0) -> T.DataType:
    """The column type of a database type; NUMBER goes by precision and scale."""
    name = db_type.upper().replace("UNSIGNED", "").strip()
    if name == "NUMBER":
        if scale > 17:
            raise ValueError(f"scale {scale} is not supported")
        if scale >= 1:
            return T.FloatType() if scale <= 6 else T.DoubleType()
        return T.LongType() if precision > 9 or precision == 0 else T.IntegerType()
    if name not in TYPES:
        raise ValueError(f"{db_type} is not supported")
    return TYPES[name]


def camel_case(column: str) -> str:
    """FIRST_NAME -> firstName."""
    first, *rest = column.lower().split("_")
    return first + "".join(p.capitalize() for p in rest)


def row_schema(columns: list[tuple]) -> T.StructType:
    """From (db name, db type[, precision, scale]): nullable fields in order, with the database's names as metadata."""
    return T.StructType([
        T.StructField(camel_case(name), column_type(kind, *more), True, {"dbFieldName": name, "dbFieldPosition": i, "dbFieldType": kind})
        for i, (name, kind, *more) in enumerate(columns)
    ])
