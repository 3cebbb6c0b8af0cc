"""Evidence from structured tables and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import count_true, previous_by_period, ratio, rounded, share_true


def before_after(panel: DataFrame, keys: list[str], day: str, value: Column, onset: str) -> DataFrame:
    """Mean of a value before and from the onset on, per group."""
    late = F.col(day) >= F.lit(onset).cast("date")
    return panel.groupBy(*keys).agg(
        F.avg(F.when(~late, value)).alias("before"), F.avg(F.when(late, value)).alias("after")
    ).withColumn("gap", F.col("before") - F.col("after"))


def flag_notes(notes: DataFrame, pattern: str) -> DataFrame:
    """Flag whole note bodies by a case-insensitive pattern, JVM-side."""
    return notes.withColumn("flagged", F.col("body").rlike(f"(?i){pattern}"))


def flagged_stores(flagged: DataFrame, group: str, store: str, onset: str) -> DataFrame:
    """Distinct flagged stores per group since the onset."""
    since = F.col("note_date") >= F.lit(onset).cast("date")
    return flagged.where(since).groupBy(group).agg(
        F.countDistinct(store).alias("stores"),
        F.countDistinct(F.when(F.col("flagged"), F.col(store))).alias("flagged_stores"),
    )


def two_by_two(flagged: DataFrame, group: str) -> DataFrame:
    """Counts a, b in the group and c, d outside it; the outside is the grand
    total less the group, so one grouped and one global sum suffice."""
    inside = flagged.groupBy(group).agg(
        count_true(F.col("flagged")).alias("a"), count_true(~F.col("flagged")).alias("b")
    )
    whole = inside.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return inside.join(F.broadcast(whole)).select(
        group, "a", "b", (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d")
    )


def chi_square_2x2(counts: DataFrame) -> DataFrame:
    """Yates-corrected chi-square of counts a, b, c, d in closed form."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    spread = F.abs(a * d - b * c)
    corrected = F.greatest(F.lit(0.0), spread - n / 2.0)
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return counts.withColumn("chi2", n * ratio(corrected * corrected, margins)).withColumn(
        "chi2_uncorrected", n * ratio(spread * spread, margins)
    )


def classify_ticket(body: Column, pattern: str) -> Column:
    return F.when(body.rlike(f"(?i){pattern}"), "SIZE_ISSUE").otherwise("OTHER")


def ticket_growth(tickets: DataFrame, day: str, pattern: str) -> DataFrame:
    """Tickets per month and class read from the body, with month-on-month growth."""
    counts = (
        tickets.withColumn("ticket_class", classify_ticket(F.col("body"), pattern))
        .groupBy("ticket_class", F.date_trunc("month", day).cast("date").alias("period"))
        .agg(F.count(F.lit(1)).alias("tickets"))
    )
    before = previous_by_period(F.col("tickets"), ["ticket_class"], "period")
    return counts.withColumn("previous", before).withColumn(
        "growth_pct", rounded(100.0 * (ratio(F.col("tickets"), F.col("previous").cast("double")) - 1.0))
    )


def confusion(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Counts by predicted and reviewed class."""
    return predicted.join(truth, key).groupBy("predicted", "reviewed").agg(F.count(F.lit(1)).alias("items"))


def mislabel_rate(counts: DataFrame) -> DataFrame:
    """Share of each reviewed class whose prediction disagrees."""
    wrong = F.sum(F.when(F.col("predicted") != F.col("reviewed"), F.col("items")).otherwise(0))
    return counts.groupBy("reviewed").agg(
        F.sum("items").alias("items"), wrong.alias("mislabelled"),
        rounded(wrong / F.sum("items")).alias("mislabel_rate"),
    )


HYPOTHESIS = ["hypothesis"]


def corroborate(evidence: DataFrame, keys: list[str] = HYPOTHESIS) -> DataFrame:
    """Promote note evidence of a hypothesis backed by enough independent notes."""
    rule = config.CORROBORATION
    is_note = F.col("kind") == rule["from"]
    support = evidence.where(is_note).groupBy(*keys).agg(
        F.countDistinct("source_ref").alias("independent_notes")
    )
    enough = is_note & (F.col("independent_notes") >= rule["min_notes"])
    return (
        evidence.join(support, keys, "left")
        .withColumn("kind_after", F.when(enough, rule["to"]).otherwise(F.col("kind")))
    )


def evidence_weight(
    evidence: DataFrame, weights: DataFrame, kind: str = "kind", keys: list[str] = HYPOTHESIS
) -> DataFrame:
    """Mean reliability and share of evidence under the floor, per hypothesis."""
    tiers = F.broadcast(weights.withColumnRenamed("kind", kind))
    low = F.col("reliability") < config.RELIABILITY_FLOOR
    return evidence.join(tiers, kind).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        rounded(F.avg("reliability")).alias("mean_reliability"),
        rounded(share_true(low)).alias("low_share"),
    ).withColumn("dominated", F.col("low_share") > config.TRIGGERS["max_low_reliability_share"])


def spend_shift(weekly_spend: DataFrame, keys: list[str], cut: str) -> DataFrame:
    """Change in mean weekly spend around a cut date."""
    late = F.col("week_start") >= F.lit(cut).cast("date")
    return weekly_spend.groupBy(*keys).agg(
        F.avg(F.when(~late, F.col("spend"))).alias("before"),
        F.avg(F.when(late, F.col("spend"))).alias("after"),
    ).withColumn("change_pct", 100.0 * (ratio(F.col("after"), F.col("before")) - 1.0))


def coverage(visits: DataFrame) -> DataFrame:
    """Instrumented share and visible nulls per day of footfall."""
    return visits.groupBy("footfall_date").agg(
        F.count(F.lit(1)).alias("store_days"),
        count_true(F.col("counter_installed")).alias("instrumented"),
        count_true(F.col("footfall").isNull()).alias("null_footfall"),
        rounded(share_true(F.col("counter_installed"))).alias("instrumented_share"),
    )


def estate_coverage(stores: DataFrame) -> DataFrame:
    return stores.groupBy("region").agg(
        F.count(F.lit(1)).alias("stores"),
        count_true(F.col("has_footfall_counter")).alias("instrumented"),
        rounded(share_true(F.col("has_footfall_counter"))).alias("instrumented_share"),
    )


def news_counts(news: DataFrame, day: str, competitor: str) -> DataFrame:
    """Items per fiscal quarter and competitor."""
    shifted = F.add_months(day, 1 - config.FISCAL_START_MONTH)
    return news.groupBy(
        F.year(shifted).alias("fiscal_year"), F.quarter(shifted).alias("fiscal_quarter"),
        F.col(competitor).alias("competitor"),
    ).agg(F.count(F.lit(1)).alias("items"))


def contradictions(evidence: DataFrame, keys: list[str] = HYPOTHESIS) -> DataFrame:
    """Independent sources pulling a hypothesis in opposite directions."""
    enough = config.TRIGGERS["min_independent_sources"]
    per_source = evidence.groupBy(*keys, "source_ref").agg(F.sum("sign").alias("net"))
    return per_source.groupBy(*keys).agg(
        count_true(F.col("net") > 0).alias("supporting"),
        count_true(F.col("net") < 0).alias("opposing"),
    ).withColumn(
        "contradictory",
        (F.col("supporting") > 0) & (F.col("opposing") > 0) & (F.col("supporting") + F.col("opposing") >= enough),
    )


def case_signals(evidence: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Low-reliability share and contradiction of each case in one pass: the
    same figures as :func:`evidence_weight` and :func:`contradictions`."""
    low = F.col("reliability") < config.RELIABILITY_FLOOR
    per_source = evidence.join(F.broadcast(weights), "kind").groupBy(*keys, "source_ref").agg(
        F.sum("sign").alias("net"), F.count(F.lit(1)).alias("n"), count_true(low).alias("low")
    )
    pro, con = count_true(F.col("net") > 0), count_true(F.col("net") < 0)
    return per_source.groupBy(*keys).agg(
        (F.sum("low") / F.sum("n")).alias("low_share"),
        ((pro > 0) & (con > 0) & (pro + con >= config.TRIGGERS["min_independent_sources"])).alias("contradictory"),
    )


def concordance(evidence: DataFrame, keys: list[str] = HYPOTHESIS) -> DataFrame:
    """Share of (structured, unstructured) pairs that agree in sign.

    Pairs are counted from the four sign totals, never enumerated.
    """
    text = F.col("kind").isin(config.UNSTRUCTURED_KINDS)
    tally = lambda is_text, s: count_true((text == is_text) & (F.col("sign") == s))
    counts = evidence.groupBy(*keys).agg(
        tally(False, 1).alias("sp"), tally(False, -1).alias("sn"),
        tally(True, 1).alias("up"), tally(True, -1).alias("un"),
    )
    agree = F.col("sp") * F.col("up") + F.col("sn") * F.col("un")
    pairs = (F.col("sp") + F.col("sn")) * (F.col("up") + F.col("un"))
    return counts.select(
        *keys, pairs.alias("pairs"), rounded(ratio(agree.cast("double"), pairs)).alias("concordance")
    )


def lineage(evidence: DataFrame) -> DataFrame:
    """Evidence to ordered steps and their inputs; steps without inputs stay."""
    steps = evidence.select("evidence_id", F.posexplode("lineage").alias("step", "s"))
    return steps.select(
        "evidence_id", "step", F.col("s.operation").alias("operation"),
        F.explode_outer("s.inputs").alias("input"),
    )
