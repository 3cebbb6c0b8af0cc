"""Data-quality checks.  Violations come back as rows, never as exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth import config


DIGEST_SCALE = 6  # decimal places of floating-point columns


def row_text(df: DataFrame) -> Column:
    """One text per row: columns by name, a bar between them, nulls marked, floating-point values to a fixed scale."""
    kinds = dict(df.dtypes)
    cells = [
        F.coalesce((F.col(c).cast(f"decimal(38,{DIGEST_SCALE})") if kinds[c] in ("double", "float") else F.col(c)).cast("string"), F.lit("\\N"))
        for c in sorted(df.columns)
    ]
    return F.concat_ws("|", *cells)


def digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: rows, and sum and xor of two halves of each row's MD5."""
    hashed = F.md5(row_text(df).cast("binary"))
    half = lambda at: F.conv(F.substring(hashed, at, 15), 16, 10).cast("long")
    return df.select(half(1).alias("a"), half(17).alias("b")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("a").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("b").alias("hash_xor"),
    )


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule is the condition that must hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def evidence_rules() -> dict[str, Column]:
    """Ranges and closed vocabularies of evidence rows."""
    return {
        "kind_known": F.col("kind").isin(*config.RELIABILITY),
        "produced_by_known": F.col("produced_by").isin("code", "model"),
        "unit_known": F.col("unit").isin(*config.EVIDENCE_UNITS),
        "completeness_in_unit_range": F.col("completeness").between(0.0, 1.0),
        "freshness_not_negative": F.col("freshness_hours") >= 0,
        "sign_known": F.col("sign").isin(-1, 0, 1),
    }


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent, with how many child rows use each.

    Child rows are counted per key before the join, so a hot key is one row.
    """
    used = child.groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def rule_breaks(evidence: DataFrame) -> DataFrame:
    """Model-produced rows that carry a number, and rows with two values."""
    return violations(evidence, "evidence_id", {
        "model_carries_no_number": (F.col("produced_by") != "model") | F.col("value_num").isNull(),
        "one_value_at_most": F.col("value_num").isNull() | F.col("value_text").isNull(),
    })


def elimination_breaks(hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """Eliminated hypotheses without a reason."""
    return hypotheses.where((F.col("status") == "eliminated") & F.col("elimination_reason").isNull()).select(
        *keys, "hypothesis"
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def forbidden_columns(df: DataFrame, forbidden: list[str]) -> list[str]:
    """Names that must not be present (schema only, no job)."""
    return sorted(set(df.columns) & set(forbidden))


def schema_guard(df: DataFrame, forbidden: list[str], value: str, flag: str) -> DataFrame:
    """Forbidden columns present, and rows whose null does not match the flag:
    the value is null exactly where the flag is false."""
    return df.agg(
        F.lit(",".join(forbidden_columns(df, forbidden))).alias("forbidden_present"),
        F.count_if(F.col(value).isNull() & F.col(flag)).alias("null_but_flagged"),
        F.count_if(F.col(value).isNotNull() & ~F.col(flag)).alias("value_but_unflagged"),
        F.count(F.lit(1)).alias("rows"),
    )


def weights_sum(df: DataFrame, group: list[str], weight: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose weights do not sum to one."""
    return df.groupBy(*group).agg(F.sum(weight).alias("weight_sum")).where(
        F.abs(F.col("weight_sum") - 1.0) > tolerance
    )
