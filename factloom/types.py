"""Conceptual data types, their Spark types and the domain checks of values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Conceptual type, abstract SQL type, JSON type.
CONCEPTUAL = {
    "unspecified": ("CHARACTER VARYING", "string"),
    "text": ("CHARACTER VARYING", "string"),
    "userDefined": ("CHARACTER VARYING", "string"),
    "fixedText": ("CHARACTER", "string"),
    "largeText": ("CHARACTER LARGE OBJECT", "string"),
    "smallInteger": ("SMALLINT", "integer"),
    "unsignedTiny": ("SMALLINT", "integer"),
    "integer": ("INTEGER", "integer"),
    "unsignedSmall": ("INTEGER", "integer"),
    "autoCounter": ("INTEGER", "integer"),
    "rowId": ("INTEGER", "integer"),
    "objectId": ("INTEGER", "integer"),
    "largeInteger": ("BIGINT", "integer"),
    "unsigned": ("BIGINT", "integer"),
    "unsignedLarge": ("BIGINT", "integer"),
    "singleFloat": ("REAL", "number"),
    "doubleFloat": ("DOUBLE PRECISION", "number"),
    "decimal": ("DECIMAL", "number"),
    "money": ("DECIMAL", "number"),
    "uuid": ("UUID", "string"),
    "date": ("DATE", "string"),
    "time": ("TIME", "string"),
    "dateTime": ("TIMESTAMP", "string"),
    "autoTimestamp": ("TIMESTAMP", "string"),
    "boolean": ("BOOLEAN", "boolean"),
    "yesNo": ("BOOLEAN", "boolean"),
    "fixedRaw": ("BINARY", "string"),
    "raw": ("BINARY VARYING", "string"),
    "largeRaw": ("BINARY LARGE OBJECT", "string"),
    "picture": ("BINARY LARGE OBJECT", "string"),
    "oleObject": ("BINARY LARGE OBJECT", "string"),
}
_SPARK = {
    "CHARACTER VARYING": T.StringType(),
    "CHARACTER": T.StringType(),
    "CHARACTER LARGE OBJECT": T.StringType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.LongType(),  # host numbers have 64 bits
    "BIGINT": T.LongType(),
    "REAL": T.FloatType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "DECIMAL": T.DecimalType(28, 10),
    "UUID": T.StringType(),
    "DATE": T.DateType(),
    "TIME": T.StringType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "BOOLEAN": T.BooleanType(),
    "BINARY": T.BinaryType(),
    "BINARY VARYING": T.BinaryType(),
    "BINARY LARGE OBJECT": T.BinaryType(),
}
UNSIGNED = ("unsigned", "unsignedTiny", "unsignedSmall", "unsignedLarge", "autoCounter", "rowId", "objectId")


def spark_type(conceptual: str, length: int | None = None, precision: int | None = None, scale: int | None = None) -> T.DataType:
    if conceptual == "unsignedLarge":
        return T.DecimalType(20, 0)
    kind = _SPARK[CONCEPTUAL[conceptual][0]]
    if isinstance(kind, T.DecimalType) and precision:
        return T.DecimalType(precision, scale or 0)
    if length and conceptual in ("text", "fixedText"):
        return T.VarcharType(length) if conceptual == "text" else T.CharType(length)
    return kind


def kind(data_type: T.DataType) -> str:
    """number, text, sequence or other: values of different kinds are never equal and never compared."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return "sequence"
    return data_type.simpleString()


def same_kind(a: T.DataType, b: T.DataType, what: str) -> None:
    if kind(a) != kind(b):
        raise TypeError(f"{what}: {a.simpleString()} and {b.simpleString()} aren't compared")


def malformed(col: Column, conceptual: str) -> Column:
    """True where a text isn't a value of the conceptual type; null is no value and passes."""
    sql_type = CONCEPTUAL[conceptual][0]
    text = col.cast("string")
    if sql_type in ("SMALLINT", "INTEGER", "BIGINT"):
        bad = ~text.rlike(r"^[+-]?[0-9]+$") | text.try_cast("bigint").isNull()
        if conceptual in UNSIGNED:
            bad = bad | text.startswith("-")
    elif sql_type in ("DECIMAL", "REAL", "DOUBLE PRECISION"):
        bad = ~text.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    elif sql_type == "UUID":
        bad = ~text.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
    elif sql_type == "DATE":
        bad = ~text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | text.try_cast("date").isNull()
    elif sql_type == "TIME":
        bad = ~text.rlike("^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?$")
    elif sql_type == "TIMESTAMP":
        bad = text.try_cast("timestamp_ntz").isNull()
    elif sql_type == "BOOLEAN":
        bad = ~text.isin("true", "false", "T", "F", "yes", "no")
    else:
        bad = F.lit(False)
    return col.isNotNull() & F.coalesce(bad, F.lit(True))


@dataclass(frozen=True)
class Domain:
    """The values a value type or a role admits: enumeration, ranges with bounds, facets."""

    conceptual: str = "unspecified"
    values: tuple = ()
    #: (low, low is included, high, high is included); None is unbounded. A value in any of them is admitted.
    ranges: tuple[tuple, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    multiple_of: float | None = None

    def outside(self, col: Column) -> Column:
        """True where a value lies outside the domain; null is no value."""
        bad = malformed(col, self.conceptual)
        if self.values:
            bad = bad | ~col.isin(*self.values)
        if self.ranges:
            inside = F.lit(False)
            for low, with_low, high, with_high in self.ranges:
                one = F.lit(True)
                if low is not None:
                    one = one & ((col >= low) if with_low else (col > low))
                if high is not None:
                    one = one & ((col <= high) if with_high else (col < high))
                inside = inside | one
            bad = bad | ~inside
        if self.min_length is not None:
            bad = bad | (F.length(col.cast("string")) < self.min_length)
        if self.max_length is not None:
            bad = bad | (F.length(col.cast("string")) > self.max_length)
        if self.pattern is not None:
            bad = bad | ~col.cast("string").rlike(f"^(?:{self.pattern})$")
        if self.multiple_of is not None:
            bad = bad | (F.pmod(col.cast("decimal(28,10)"), F.lit(self.multiple_of).cast("decimal(28,10)")) != 0)
        return col.isNotNull() & bad
