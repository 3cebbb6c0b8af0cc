"""Confidence components, caps, calibration, abstention triggers, verdict."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import rounded
from kpisleuth.functions.stats import sigmoid
from kpisleuth.operators import gates


def components(case: DataFrame) -> DataFrame:
    """The six components in [0, 1].

    Needs ``t``, ``coverage``, ``concordance``, ``data_quality``,
    ``weeks_held``, ``regime_change`` and ``attributed_share``.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    depth = F.least(F.lit(1.0), F.col("weeks_held") / F.lit(float(config.DEPTH_REFERENCE_WEEKS)))
    penalty = F.when(F.col("regime_change"), config.REGIME_CHANGE_PENALTY).otherwise(0.0)
    zero = F.lit(0.0)
    return (
        case.withColumn("s1", sigmoid(F.abs(F.coalesce("t", zero))))
        .withColumn("s2", F.coalesce("coverage", zero))
        .withColumn("s3", F.coalesce("concordance", zero))
        .withColumn("s4", unit(F.coalesce("data_quality", zero)))
        .withColumn("s5", unit(depth - penalty))
        .withColumn("s6", unit(F.coalesce("attributed_share", zero)))
    )


def raw_confidence(scored: DataFrame) -> DataFrame:
    """Weighted sum of the components.  The weights are six literals, so the
    sum is one expression per row and needs no reshaping."""
    total = F.lit(0.0)
    for name, weight in config.COMPONENT_WEIGHTS.items():
        total = total + F.col(name) * F.lit(weight)
    return scored.withColumn("raw", total)


def apply_caps(hypotheses: DataFrame) -> DataFrame:
    """Caps after the sum: the lowest ceiling of the caps that fired.

    Needs one boolean column per cap name.  Also lists the caps fired and
    whether a cap forces a trigger.
    """
    fired = F.array_compact(F.array(*[
        F.when(F.col(name), F.lit(name)) for name in config.CAPS
    ]))
    ceiling = F.least(
        F.lit(1.0), *[F.when(F.col(name), F.lit(cap["ceiling"])) for name, cap in config.CAPS.items()]
    )
    forced = F.array_compact(F.array(*[
        F.when(F.col(name), F.lit(cap["forced_trigger"]))
        for name, cap in config.CAPS.items() if cap["forced_trigger"]
    ]))
    return (
        hypotheses.withColumn("caps_fired", fired)
        .withColumn("ceiling", ceiling)
        .withColumn("after_caps", F.least(F.col("raw"), F.col("ceiling")))
        .withColumn("forced_triggers", forced)
        .withColumn("eliminated", F.col("temporal_precedence_failed"))
    )


class _Blocks:
    """Pool-adjacent-violators over points that come in ascending order of score."""

    def __init__(self):
        self.rows: list[list[float]] = []  # first score, last score, outcomes, cases

    def add(self, first: float, last: float, outcomes: float, cases: float) -> None:
        row = [first, last, outcomes, cases]
        while self.rows and self.rows[-1][2] * row[3] >= row[2] * self.rows[-1][3]:
            before = self.rows.pop()
            row = [before[0], row[1], before[2] + row[2], before[3] + row[3]]
        self.rows.append(row)


BLOCK = "score_from double, score_to double, outcomes double, cases double"


def calibration_curve(ledger: DataFrame, keys: list[str], key_schema: str, score: str, outcome: str) -> DataFrame:
    """Isotonic step function of each case type from its closed cases.

    Cases of equal score are pooled first.  Pooling violators can be done in
    parts: scores are dealt in order, every partition pools its own, and only the
    blocks that are left, rising in outcome, meet per case type to be pooled once
    more, which gives the fit over all.  Output: keys, ``score_from``,
    ``score_to``, ``cases``, ``calibrated``.
    """
    points = ledger.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(outcome).cast("double")).alias("outcomes"), F.count(F.lit(1)).cast("double").alias("cases"))
    dealt = points.repartitionByRange(*keys, "score").sortWithinPartitions(*keys, "score")

    def frame(key, blocks: _Blocks) -> pd.DataFrame:
        out = pd.DataFrame(blocks.rows, columns=["score_from", "score_to", "outcomes", "cases"])
        for name, value in zip(reversed(keys), reversed(key), strict=True):
            out.insert(0, name, value)
        return out

    def within(batches):
        key, blocks = None, _Blocks()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                here = tuple(row[: len(keys)])
                if key is not None and here != key:
                    yield frame(key, blocks)
                    blocks = _Blocks()
                key = here
                blocks.add(row.score, row.score, row.outcomes, row.cases)
        if key is not None:
            yield frame(key, blocks)

    def across(key, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = _Blocks()
        for row in pdf.sort_values("score_from", kind="stable").itertuples(index=False):
            blocks.add(row.score_from, row.score_to, row.outcomes, row.cases)
        return frame(key, blocks)

    parts = dealt.select(*keys, "score", "outcomes", "cases").mapInPandas(within, f"{key_schema}, {BLOCK}")
    return parts.groupBy(*keys).applyInPandas(across, f"{key_schema}, {BLOCK}").select(
        *keys, "score_from", "score_to", F.col("cases").cast("long").alias("cases"), (F.col("outcomes") / F.col("cases")).alias("calibrated"))


def calibrated(cases: DataFrame, curve: DataFrame, keys: list[str], score: str, min_cases: int = config.CALIBRATION["min_cases"]) -> DataFrame:
    """``cases`` with ``calibrated``, the curve's value at the score (its first below all scores), and
    ``calibration_cases``; a case type with too few closed cases keeps its score."""
    steps = curve.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("score_from", F.col("calibrated").alias("value")))).alias("_steps"), F.sum("cases").alias("calibration_cases"))
    reached = F.filter("_steps", lambda s: s["score_from"] <= F.col(score))
    value = F.coalesce(F.try_element_at(reached, F.lit(-1))["value"], F.try_element_at("_steps", F.lit(1))["value"])
    return cases.join(steps, keys, "left").withColumn("calibration_cases", F.coalesce("calibration_cases", F.lit(0))).withColumn(
        "calibrated", F.when(F.col("calibration_cases") >= min_cases, value).otherwise(F.col(score))).drop("_steps")


def calibration_report(ledger: DataFrame, keys: list[str], score: str, outcome: str, bins: int = 10) -> DataFrame:
    """Reliability table: cases, mean score, accuracy and gap per score bin."""
    index = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return ledger.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(outcome).cast("double")).alias("accuracy"),
    ).withColumn("gap", F.abs(F.col("mean_score") - F.col("accuracy"))).withColumn(
        "enough_cases", F.col("cases") >= config.CALIBRATION["min_cases"]
    )


def expected_calibration_error(report: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean gap over all bins, overall accuracy, publishable or not."""
    weighted = lambda c: F.sum(F.col(c) * F.col("cases")) / F.sum("cases")
    return report.groupBy(*keys).agg(
        F.sum("cases").alias("cases"),
        rounded(weighted("gap")).alias("ece"),
        rounded(weighted("accuracy")).alias("accuracy"),
    ).withColumn(
        "publishable",
        (F.col("ece") <= config.CALIBRATION["max_ece"])
        & (F.col("accuracy") >= config.CALIBRATION["publication_floor"])
        & (F.col("cases") >= config.CALIBRATION["min_cases"]),
    )


def leading(hypotheses: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Best hypothesis per case and its separation from the runner-up.

    A case has at most one row per template, so the window is a few rows.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(confidence), "hypothesis")
    margin = F.col(confidence) - F.lead(confidence).over(order)
    return (
        hypotheses.withColumn("separation", margin)
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") == 1)
        .drop("_place")
        .withColumn("near_tie", F.coalesce(
            F.round("separation", 9) <= config.TRIGGERS["max_separation"], F.lit(False)))
    )


def triggers(case: DataFrame) -> DataFrame:
    """T1-T8 as named booleans and the list of those fired.

    Needs ``hard_gates_passed``, ``attributed_share``, ``verifiable``,
    ``near_tie``, ``contradictory``, ``low_share``, ``case_type_accuracy``,
    ``closed_cases`` and ``staleness_hours``.
    """
    limits = config.TRIGGERS
    rules = {
        "T1": ~F.col("hard_gates_passed"),
        "T2": F.col("attributed_share") < limits["min_residual_share"],
        "T3": ~F.col("verifiable"),
        "T4": F.col("near_tie"),
        "T5": F.col("contradictory"),
        "T6": F.col("low_share") > limits["max_low_reliability_share"],
        "T7": (F.col("closed_cases") >= limits["min_closed_cases"])
        & (F.col("case_type_accuracy") < limits["publication_floor"]),
        "T8": F.col("staleness_hours") > limits["max_staleness_hours"],
    }
    flagged = case.select("*", *[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()])
    return flagged.withColumn(
        "triggers_fired", F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in rules]))
    )


def verdict(case: DataFrame) -> DataFrame:
    """Verdict and reason: triggers first, then coverage and confidence.

    Needs ``triggers_fired``, ``coverage``, ``confidence`` and
    ``unverifiable_above_materiality``.
    """
    v = config.VERDICT
    fired = F.size("triggers_fired") > 0
    strong = (F.col("coverage") >= v["explained_coverage"]) & (F.col("confidence") >= v["explained_confidence"])
    some = (F.col("coverage") >= v["partial_coverage"]) & (F.col("confidence") >= v["partial_confidence"])
    blocked = F.col("unverifiable_above_materiality")
    outcome = (
        F.when(fired, "INSUFFICIENT_EVIDENCE")
        .when(strong & ~blocked, "EXPLAINED")
        .when(some, "PARTIALLY_EXPLAINED")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
    reason = (
        F.when(fired, F.concat_ws("+", "triggers_fired"))
        .when(strong & ~blocked, F.lit(None))
        .when(some & blocked, "live_unverifiable_above_materiality")
        .when(F.col("coverage") < v["explained_coverage"], "coverage_below_threshold")
        .otherwise("confidence_below_threshold")
    )
    return case.withColumn("verdict", outcome).withColumn("reason_code", reason)


def source_states(loads: DataFrame, sources: DataFrame, cases: DataFrame) -> DataFrame:
    """Each source's last load before the end of each case month: source, period, loaded_at, completeness.

    ``loads`` has source, loaded_at and completeness; ``sources`` one row a known
    source; ``cases`` one row a month, by its first day.  Loads are reduced to the
    last one a month before the as-of lookup, which is a running last value over
    one row per month of a source.  Of loads at the same moment the least complete
    counts.  Sources without any load so far keep nulls.
    """
    last = loads.where("source IS NOT NULL AND loaded_at IS NOT NULL").groupBy(
        "source", F.trunc("loaded_at", "month").alias("period")
    ).agg(F.max(F.struct("loaded_at", (-F.col("completeness")).alias("short"))).alias("last"))
    spine = sources.select("source").distinct().join(F.broadcast(cases.select("period").distinct()))
    before = Window.partitionBy("source").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spine.withColumn("asked", F.lit(True)).join(last, ["source", "period"], "full")
        .withColumn("last", F.last("last", ignorenulls=True).over(before)).where("asked")
        .select("source", "period", F.col("last.loaded_at").alias("loaded_at"), (-F.col("last.short")).alias("completeness"))
    )


def required_quality(states: DataFrame, hypotheses: DataFrame, full_hours: float, zero_hours: float) -> DataFrame:
    """Worst required source of every hypothesis and case month, at the month's end.

    ``data_quality`` is the minimum of freshness credit x completeness over the
    required sources, ``staleness_hours`` the age of the oldest one.  A required
    source that has never loaded has no credit and is infinitely old.
    """
    end = F.add_months("period", 1).cast("timestamp")
    age = F.coalesce((F.unix_micros(end) - F.unix_micros("loaded_at")) / 3.6e9, F.lit(float("inf")))
    needed = hypotheses.select("hypothesis", F.explode("required_sources").alias("source"))
    credit = gates.freshness_credit(F.col("age"), F.lit(full_hours), F.lit(zero_hours))
    return needed.join(states.withColumn("age", rounded(age)), "source").groupBy("hypothesis", "period").agg(
        F.min(credit * F.coalesce("completeness", F.lit(0.0))).alias("data_quality"), F.max("age").alias("staleness_hours"))
