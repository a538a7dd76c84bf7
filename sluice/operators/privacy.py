"""PII scan, protection and tiered views (R11-R13), built from the PII
classification rows (tbl_pii_attribute)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.functions.exprs import luhn_valid
from sluice.schemas import ACCESS_TIERS, PROTECTION_METHODS

# ---- fixed values: detection patterns (Java regex, also valid RE2) ----
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\(\d{3}\) ?\d{3}[- ]\d{4}|\b\d{3}[-. ]\d{3}[-. ]\d{4}\b|\+\d{1,3}[- ]?\(?\d{1,4}\)?([- ]\d{2,4}){2,4}\b"
NATIONAL_ID_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
# From a border of a digit group on, at most 19 digits up to another border. Empty matches,
# so every group is a start. (Java only: RE2 has no lookahead.)
CARD_PATTERN = r"\b(?=(\d(?:[ -]?\d){12,18})\b)"
CARD_LENGTHS = range(13, 20)

# ---- fixed values: column-name hints, suggested protection and sensitivity ----
NAME_HINTS = {
    "full_name": r"(?i)(^|_)(full_?name|first_?name|last_?name|name)$",
    "health": r"(?i)(diagnos|health|medical|icd|patient)",
}
SUGGESTED = {
    "email": ("MASK", "PII"),
    "phone": ("MASK", "PII"),
    "full_name": ("PSEUDONYMIZE", "PII"),
    "national_id": ("ENCRYPT", "PII"),
    "financial": ("ENCRYPT", "PCI"),
    "health": ("REDACT", "PHI"),
}
REDACTED = "[REDACTED]"


def _has_card(v: Column) -> Column:
    """A run of 13 to 19 digits that starts and ends at a border of a digit group (groups are
    one blank or hyphen apart) passes Luhn, whatever groups stand beside it."""
    starts = F.regexp_extract_all(v, F.lit(CARD_PATTERN), 1)
    runs = F.flatten(F.transform(starts, lambda x: F.array(
        *[F.regexp_extract(x, rf"^\d(?:[ -]?\d){{{n - 1}}}\b", 0) for n in CARD_LENGTHS])))
    return F.exists(F.transform(F.filter(runs, lambda x: x != ""), lambda x: F.regexp_replace(x, "[ -]", "")), luhn_valid)


def _value_tests(v: Column) -> dict[str, Column]:
    # Each regex is guarded by a cheap test every match must pass ('@', '-', a run of 13
    # digits): it rejects most long texts before the backtracking regex.
    return {
        "email": v.contains("@") & v.rlike(EMAIL_PATTERN),
        "phone": v.rlike(PHONE_PATTERN),
        "national_id": v.contains("-") & v.rlike(NATIONAL_ID_PATTERN),
        "financial": F.when(v.rlike(r"\d([ -]?\d){12}"), _has_card(v)).otherwise(F.lit(False)),
    }


def pii_scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per string column and category, the rows that match, their share of the
    column's rows and the suggested protection. Value patterns: email, phone, national_id,
    financial (13 to 19 digits, grouped or not, passing Luhn, also beside other digit groups); column-name hints: full_name, health.

    One global aggregation holds a ``count_if`` per (column, category): a single scan in
    generated code, combined map-side into one row per task, with no per-column row
    explosion and no keyed shuffle however wide the table is. The one result row is then
    unpivoted into (column, category) rows.
    """
    import re

    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    aggs = [F.count(F.lit(1)).cast("long").alias("_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(c)).cast("long").alias(f"_nn_{i}"))
        aggs += [F.count_if(t).cast("long").alias(f"_m_{i}_{k}") for k, t in _value_tests(F.col(c)).items()]
    one = df.agg(*aggs)
    entries = []
    for i, c in enumerate(cols):
        for cat in [*_value_tests(F.col(c)).keys(), *NAME_HINTS.keys()]:
            if cat in NAME_HINTS:
                matched = F.col(f"_nn_{i}") if re.search(NAME_HINTS[cat], c) else F.lit(0).cast("long")
            else:
                matched = F.col(f"_m_{i}_{cat}")
            method, sens = SUGGESTED[cat]
            entries.append(F.struct(
                F.lit(c).alias("column_name"), F.lit(cat).alias("pii_category"), matched.alias("matching_rows"),
                F.lit(method).alias("suggested_protection"), F.lit(sens).alias("sensitivity"),
            ))
    out = one.select("_rows", F.explode(F.array(*entries)).alias("_c")).select("_c.*", "_rows")
    return out.filter(F.col("matching_rows") > 0).select(
        "column_name", "pii_category", "matching_rows",
        (F.col("matching_rows") / F.col("_rows")).alias("share"), "suggested_protection", "sensitivity",
    )


def classification_rows(scan: DataFrame, table_config_id: int, access_tier: str = "INTERNAL", env_type: str = "dev") -> DataFrame:
    """R11 -> tbl_pii_attribute rows (for D32's replace): one row per detected (column,
    category) with the suggested protection and sensitivity, untagged, at ``access_tier``."""
    return scan.select(
        F.lit(table_config_id).cast("long").alias("table_config_id"), "column_name", "pii_category",
        F.col("suggested_protection").alias("protection_method"), "sensitivity",
        F.lit(None).cast("string").alias("masking_policy"), F.lit(False).alias("uc_tag_applied"),
        F.lit(access_tier).alias("access_tier"), F.lit(env_type).alias("env_type"),
    )


# ---- R12 protection ----

def mask_value(v: Column, policy: str | None) -> Column:
    """MASK: letters -> X/x, digits -> n; policy 'last4' keeps the last four characters
    of a longer value (shorter ones are masked in full), 'email_domain' keeps everything from '@'."""
    if policy == "last4":
        n = F.char_length(v)
        head = F.mask(F.substring(v, F.lit(1), F.greatest(n - F.lit(4), F.lit(0))))
        return F.when(n <= 4, F.mask(v)).otherwise(F.concat(head, F.substring(v, -4, 4)))
    if policy == "email_domain":
        at = F.instr(v, "@")
        return F.when(at > 0, F.concat(F.mask(F.substring(v, F.lit(1), at - F.lit(1))), F.substr(v, at))).otherwise(F.mask(v))
    return F.mask(v)


def protect_column(v: Column, method: str, policy: str | None, key: str | None, salt: str | None) -> Column:
    text = v.cast("string")
    m = method.upper()
    if m == "MASK":
        out = mask_value(text, policy)
    elif m == "PSEUDONYMIZE":
        if not salt:
            raise ValueError("PSEUDONYMIZE needs a salt")
        out = F.sha2(F.concat(F.lit(salt), text), 256)
    elif m == "REDACT":
        out = F.lit(REDACTED)
    elif m == "ENCRYPT":
        if not key:
            raise ValueError("ENCRYPT needs a key of 16, 24 or 32 bytes")
        out = F.base64(F.aes_encrypt(text, F.lit(key), F.lit("GCM")))
    else:
        raise ValueError(f"unknown protection_method {method!r}")
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(out)


def decrypt_column(v: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(v), F.lit(key), F.lit("GCM")).cast("string")


#: Weakest to strongest; a column classified several times gets the strongest.
METHOD_STRENGTH = ["MASK", "PSEUDONYMIZE", "ENCRYPT", "REDACT"]


def strictest(pii_rows: list[dict]) -> dict[str, dict]:
    """One rule per column from its active classification rows, whatever their order: the
    highest access tier (INTERNAL when unset) and the strongest method; MASK rows that
    differ in policy mask in full."""
    out: dict[str, dict] = {}
    for r in pii_rows:
        if not r.get("is_active", True):
            continue
        tier, method = r.get("access_tier") or "INTERNAL", (r.get("protection_method") or "REDACT").upper()
        if method not in PROTECTION_METHODS:
            raise ValueError(f"unknown protection_method {method!r}")
        have = out.get(r["column_name"])
        mine = {"access_tier": tier, "protection_method": method, "masking_policy": r.get("masking_policy")}
        if have is None:
            out[r["column_name"]] = mine
            continue
        have["access_tier"] = max(have["access_tier"], tier, key=tier_rank)
        if METHOD_STRENGTH.index(method) > METHOD_STRENGTH.index(have["protection_method"]):
            have["protection_method"], have["masking_policy"] = method, mine["masking_policy"]
        elif method == have["protection_method"] and mine["masking_policy"] != have["masking_policy"]:
            have["masking_policy"] = None
    return out


def protect(df: DataFrame, pii_rows: list[dict], key: str | None = None, salt: str | None = None) -> DataFrame:
    """R12 (the strongest method per column, ``strictest``): each classified column replaced by its protected text (ENCRYPT with AES-GCM,
    MASK, PSEUDONYMIZE with salted SHA-256, REDACT); NULL stays NULL; other columns pass
    through. One ``select`` built from the active classification rows."""
    rules = strictest(pii_rows)
    cols = []
    for c in df.columns:
        r = rules.get(c)
        cols.append(protect_column(F.col(c), r["protection_method"], r.get("masking_policy"), key, salt).alias(c) if r else F.col(c))
    return df.select(*cols)


def tier_rank(tier: str) -> int:
    return ACCESS_TIERS.index(tier.upper())


def tier_view(df: DataFrame, pii_rows: list[dict], reader_tier: str) -> DataFrame:
    """A reader of ``reader_tier`` sees columns at or below it; columns classified
    above it are redacted (text -> '[REDACTED]', other types -> NULL). Unclassified columns
    are PUBLIC; a column classified several times has its highest tier."""
    rank = tier_rank(reader_tier)
    tiers = {c: r["access_tier"] for c, r in strictest(pii_rows).items()}
    cols = []
    for f in df.schema.fields:
        if f.name in tiers and tier_rank(tiers[f.name]) > rank:
            hidden = F.lit(REDACTED) if isinstance(f.dataType, StringType) else F.lit(None).cast(f.dataType)
            cols.append(F.when(F.col(f.name).isNull(), F.lit(None).cast(f.dataType if not isinstance(f.dataType, StringType) else "string")).otherwise(hidden).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
