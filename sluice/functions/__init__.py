"""Column-expression helpers. Everything here returns a ``Column`` built from
built-in Spark functions, so it stays inside whole-stage code generation."""

from sluice.functions.exprs import (  # noqa: F401
    as_flag,
    contains_ci,
    decode_audit,
    decode_bts_config,
    decode_json_list,
    decode_json_map,
    encode_json,
    encode_json_columns,
    epoch_millis,
    is_blank,
    luhn_valid,
    map_text,
    row_hash,
)
