from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, TimestampNTZType, TimestampType

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_flag(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    """A flag stored as 0/1 (any integer type) or boolean, read as boolean.

    Non-zero integers are true. Strings 'true'/'false'/'1'/'0' are accepted as well.
    """
    col = _c(c)
    if isinstance(dtype, BooleanType):
        return col
    if dtype is not None and dtype.typeName() in ("string", "varchar", "char"):
        low = F.lower(F.trim(col))
        return F.when(low.isin("true", "1", "t", "yes"), F.lit(True)).when(low.isin("false", "0", "f", "no"), F.lit(False))
    return col.cast("long") != F.lit(0)


def contains_ci(c: ColumnOrName, term: str) -> Column:
    """Case-insensitive literal substring test (no pattern characters, D07)."""
    return F.lower(_c(c)).contains(F.lit(term.lower()))


def is_blank(c: ColumnOrName) -> Column:
    """True where a text value is NULL or empty (the reference's falsy test)."""
    col = _c(c)
    return col.isNull() | (col == F.lit(""))


def epoch_millis(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    """Milliseconds since the epoch, floored. ``timestamp_ntz`` is read as UTC wall-clock
    time, independent of the session zone."""
    col = _c(c)
    if isinstance(dtype, TimestampType):
        return F.unix_millis(col)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(TimestampNTZType()), col)
    # exact floor division: the numerator is a multiple of 1000
    return ((micros - F.pmod(micros, F.lit(1000))) / F.lit(1000)).cast("long")


def row_hash(cols: list[ColumnOrName]) -> Column:
    """SHA-256 hex over the length-prefixed text of each column.

    Each value becomes ``<chars>:<text>``; NULL becomes ``~``, so NULL and empty text
    hash differently and no separator can be forged by the values themselves.
    """
    parts = []
    for c in cols:
        txt = _c(c).cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(txt).cast("string"), F.lit(":"), txt), F.lit("~")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def luhn_valid(digits: ColumnOrName) -> Column:
    """Luhn checksum on a string of digits, with higher-order functions only."""
    rev = F.reverse(F.split(_c(digits), ""))
    vals = F.transform(
        rev,
        lambda x, i: F.when(
            i % 2 == 1,
            F.when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2),
        ).otherwise(x.cast("int")),
    )
    return F.aggregate(vals, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def map_text(m: ColumnOrName) -> Column:
    """A map as ``k=v`` pairs sorted by text and joined by ','; empty map gives ''."""
    entries = F.transform(F.map_entries(_c(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(entries), ",")


def encode_json(c: ColumnOrName) -> Column:
    """Struct, map or array column to JSON text (D18). Spacing follows Spark, not Python."""
    return F.to_json(_c(c))


def decode_json_list(c: ColumnOrName, element: DataType | str = "string") -> Column:
    """JSON array text to an array; NULL, empty or unparsable text gives []."""
    el = element if isinstance(element, DataType) else StringType() if element == "string" else None
    typ = ArrayType(el) if el is not None else f"array<{element}>"
    return F.coalesce(F.from_json(_c(c), typ), F.array().cast(typ))


def json_truthy(v: Column) -> Column:
    """Truthiness of a decoded JSON value (a VARIANT), as the reference's checks see it:
    missing, null, "", 0, false, [] and {} are false; everything else is true."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == F.lit("VOID")), F.lit(False))
        .when(t == F.lit("STRING"), F.variant_get(v, "$", "string") != F.lit(""))
        .when(t == F.lit("BOOLEAN"), F.variant_get(v, "$", "boolean"))
        .when(t.startswith("ARRAY"), F.size(F.variant_get(v, "$", "array<variant>")) > 0)
        .when(t.startswith("OBJECT"), t != F.lit("OBJECT<>"))
        .otherwise(F.variant_get(v, "$", "double") != F.lit(0.0))
    )


def decode_json_variants(c: ColumnOrName) -> Column:
    """JSON object text to map<string,variant>: values keep their JSON type."""
    return F.from_json(_c(c), "map<string,variant>")


def decode_json_map(c: ColumnOrName) -> Column:
    """JSON object text to map<string,string>; keys with JSON null stay present with NULL."""
    return F.from_json(_c(c), MapType(StringType(), StringType()))


def encode_json_columns(df, cols: list[str]):
    """D18 on write: the listed columns become JSON text, except those already text."""
    out = {c: F.to_json(F.col(c)) for c in cols if c in df.columns and not isinstance(df.schema[c].dataType, StringType)}
    return df.withColumns(out) if out else df


# ---- fixed shapes of the JSON columns (declared in the configuration tables) ----
LAYOUT_SCHEMA = "array<struct<name:string,type:string,nullable:boolean>>"
DQ_RULES_SCHEMA = "array<struct<rule_name:string,expression:string>>"
STD_RULES_SCHEMA = "array<struct<field:string,rule_type:string,rule_value:string>>"


def decode_bts_config(df):
    """D19 for BTS configs: silver_layout, dq_rules, std_rules and tags decoded to typed
    arrays; NULL or empty text gives []."""
    return df.withColumns({
        "silver_layout": decode_json_list("silver_layout", LAYOUT_SCHEMA[6:-1]),
        "dq_rules": decode_json_list("dq_rules", DQ_RULES_SCHEMA[6:-1]),
        "std_rules": decode_json_list("std_rules", STD_RULES_SCHEMA[6:-1]),
        "tags": decode_json_list("tags"),
    })


def decode_audit(df):
    """D19 for audit runs: source/target attributes to maps; NULL or empty text stays NULL."""
    return df.withColumns({
        c: F.when(is_blank(c), F.lit(None).cast(MapType(StringType(), StringType()))).otherwise(decode_json_map(c))
        for c in ("source_attributes", "target_attributes") if c in df.columns
    })
