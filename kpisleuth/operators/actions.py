"""Recommendations: cost, recovery, return, monitoring and follow-up cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import ratio


def with_playbook(case: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Attach the playbooks of each case's driver (literal config table)."""
    return case.join(F.broadcast(playbooks), case["driver"] == playbooks["driver"]).drop(playbooks["driver"])


def action_cost(case: DataFrame) -> DataFrame:
    """Cost by cost model.

    Stores pay per store, or per store and week of the horizon; a subscription
    is one year; margin forgone is the observed depth on the affected revenue.
    """
    count = (
        F.when(F.col("scales_with") == "treated_store_count", F.col("treated_stores"))
        .when(F.col("scales_with") == "uninstrumented_store_count", F.col("uninstrumented_stores"))
        .when(F.col("scales_with") == "affected_store_count", F.col("affected_stores"))
    )
    weeks = F.when(F.col("cost_unit") == "store_week", F.col("horizon_weeks")).otherwise(1)
    variable = (
        F.when(F.col("cost_type") == "per_store_unit_cost", F.col("unit_cost") * count * weeks)
        .when(F.col("cost_type") == "annual_subscription", F.col("unit_cost"))
        .when(F.col("cost_type") == "margin_forgone", F.col("depth") * F.col("affected_revenue"))
    )
    return case.withColumn("cost_inr", F.col("fixed_cost") + variable)


def recovery_range(case: DataFrame) -> DataFrame:
    """Attributable loss times the recovery curve's quartiles."""
    return case.withColumn("recovery_low", F.col("attributable_loss") * F.col("p25")).withColumn(
        "recovery_high", F.col("attributable_loss") * F.col("p75")
    )


def roi(case: DataFrame) -> DataFrame:
    return case.withColumn("roi_low", ratio(F.col("recovery_low"), F.col("cost_inr"))).withColumn(
        "roi_high", ratio(F.col("recovery_high"), F.col("cost_inr"))
    )


def rank_actions(case: DataFrame, keys: list[str], top: int = config.TOP_ACTIONS) -> DataFrame:
    """Best options by value per rupee.  The rank filter is pushed below the
    shuffle, so each task sends at most ``top`` rows per case."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("roi_low"), "playbook")
    return case.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def checkpoints(case: DataFrame, opened: str) -> DataFrame:
    """One row per monitoring checkpoint with its due date."""
    return case.withColumn("at_week", F.explode("checkpoints")).withColumn(
        "due_date", F.date_add(opened, F.col("at_week") * 7)
    )


def eligible_actions(case: DataFrame) -> DataFrame:
    """Every precondition must hold for a price playbook; others have none."""
    rules = ["price_event_confirmed", "precedence_passed", "mix_adjusted_material", "no_stronger_rival"]
    holds = F.lit(True)
    for rule in rules:
        holds = holds & F.coalesce(F.col(rule), F.lit(False))
    return case.withColumn("eligible", (F.col("cost_type") != "margin_forgone") | holds)


def linked_cases(case: DataFrame, case_id: str) -> DataFrame:
    """The follow-up case suggested by the playbook."""
    return case.select(
        F.col(case_id).alias("origin_case"),
        F.concat_ws("/", case_id, "linked_driver").alias("linked_case"),
        F.col("linked_driver").alias("hypothesis"),
        F.col("linked_scope").alias("scope_hint"),
        F.col("linked_rationale").alias("rationale"),
    )
