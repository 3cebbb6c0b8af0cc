"""Matched controls: exact nearest neighbour without enumerating pairs.

Candidates are summarised by a hierarchy of cells, each halving the one above
in every dimension.  A treated unit walks down the hierarchy keeping only the
cells that can still hold its nearest candidate: a cell survives when its
closest possible point is no farther than the best guaranteed distance so far.
Every level is an equi-join on the parent cell, so a crowded cell costs its few
children, not its members.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth.functions.scale import competition_rank
from kpisleuth.session import written

LEAF_MEMBERS = 32
MAX_DEPTH = 40
_SLACK = 1e-9
_FREE = (1 << 62)


def standardise(units: DataFrame, block: list[str], covariates: list[str], treated: str) -> DataFrame:
    """z-scores by the candidates' mean and population deviation in the block."""
    pool = F.when(~F.col(treated), F.lit(True))
    stats = units.groupBy(*block).agg(*[
        agg(F.when(pool, F.col(c).cast("double"))).alias(f"_{tag}_{c}")
        for c in covariates for tag, agg in (("m", F.avg), ("s", F.stddev_pop))
    ])
    scale = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return units.join(stats, block).select(
        *units.columns, *[((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(f"z_{c}") for c in covariates]
    )


def _cell(dims: list[str], depth: int) -> Column:
    """Cell of a point: integer coordinates at this depth."""
    return F.array(*[F.floor(F.col(d) * 2.0**depth).cast("long") for d in dims])


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def hierarchy(points: DataFrame, block: list[str], dims: list[str]) -> tuple[int, int]:
    """Levels of the cell hierarchy: from one cell around the origin down to
    where no cell holds many distinct vectors."""
    vectors = written(points.select(*block, *dims).distinct(), "match-vectors")
    reach = vectors.agg(F.max(F.greatest(*[F.abs(d) for d in dims], F.lit(1.0)))).first()[0] or 1.0
    root = -(math.floor(math.log2(reach)) + 1)
    depth = 1
    while depth < MAX_DEPTH:
        crowd = vectors.groupBy(*block, _cell(dims, depth).alias("_cell")).count()
        if (crowd.agg(F.max("count")).first()[0] or 0) <= LEAF_MEMBERS:
            break
        depth += 2
    return root, depth


def nearest(
    treated: DataFrame, candidates: DataFrame, block: list[str], dims: list[str], depths: tuple[int, int]
) -> DataFrame:
    """Nearest eligible candidate of every treated unit, ties to the lowest id.

    ``treated``: block, dims, ``treated_id``.  ``candidates``: block, dims,
    ``candidate_id`` and ``holder`` (a candidate is eligible for treated ids
    below its holder; free candidates hold the largest id).
    Output: block, ``treated_id``, ``candidate_id``, ``distance``.
    """
    points = candidates.select(*block, *dims, "candidate_id", "holder")
    root, depth = depths
    # Every level's cells in one pass: each point names its cell at each level,
    # and the members of a cell combine map-side.
    levels = F.array(*[
        F.struct(F.lit(level).alias("_level"), _cell(dims, level).alias("_cell")) for level in range(root, depth + 1)
    ])
    grid = written(
        points.select("*", F.inline(levels)).groupBy(*block, "_level", "_cell").agg(
            F.max("holder").alias("_holder"),
            *[f(d).alias(f"_{tag}_{d}") for d in dims for tag, f in (("lo", F.min), ("hi", F.max))],
        ),
        "match-cells",
    )

    frontier = treated.select(
        *block, "treated_id", *[F.col(d).alias(f"_t_{d}") for d in dims]
    )
    near = Window.partitionBy(*block, "treated_id")
    for level in range(root, depth + 1):
        here = grid.where(F.col("_level") == level).drop("_level")
        on = block
        if level > root:
            here = here.withColumn("_parent", F.transform("_cell", lambda x: F.floor(x / 2).cast("long")))
            on = [*block, "_parent"]
            frontier = frontier.withColumnRenamed("_cell", "_parent")
        low = F.sqrt(_sum([
            F.pow(F.greatest(F.col(f"_lo_{d}") - F.col(f"_t_{d}"), F.col(f"_t_{d}") - F.col(f"_hi_{d}"), F.lit(0.0)), 2)
            for d in dims
        ]))
        high = F.sqrt(_sum([
            F.pow(F.greatest(F.abs(F.col(f"_lo_{d}") - F.col(f"_t_{d}")), F.abs(F.col(f"_hi_{d}") - F.col(f"_t_{d}"))), 2)
            for d in dims
        ]))
        opened = frontier.join(here, on).where(F.col("_holder") > F.col("treated_id")).select(
            *block, "treated_id", *[f"_t_{d}" for d in dims], "_cell",
            low.alias("_low"), high.alias("_high"),
        )
        frontier = (
            opened.withColumn("_bound", F.min("_high").over(near))
            .where(F.col("_low") <= F.col("_bound") + _SLACK)
            .drop("_low", "_high", "_bound")
        )

    members = points.withColumn("_cell", _cell(dims, depth))
    distance = F.sqrt(_sum([F.pow(F.col(d) - F.col(f"_t_{d}"), 2) for d in dims]))
    return (
        frontier.join(members, [*block, "_cell"])
        .where(F.col("holder") > F.col("treated_id"))
        .groupBy(*block, "treated_id")
        .agg(F.min(F.struct(distance.alias("distance"), F.col("candidate_id"))).alias("best"))
        .select(*block, "treated_id", "best.candidate_id", "best.distance")
    )


def _split(units: DataFrame, block, covariates, unit_id: str, treated: str):
    """Treated units and candidates by their z-scores, which are computed once.

    Means and deviations depend in their last bit on the order in which partial
    sums arrive; computed anew for each use, equal vectors would not meet.
    """
    shared = [*block, *[f"z_{c}" for c in covariates]]
    units = written(standardise(units, block, covariates, treated).select(*shared, unit_id, treated), "match-units")
    cases = units.where(F.col(treated)).select(*shared, F.col(unit_id).cast("long").alias("treated_id"))
    pool = units.where(~F.col(treated)).select(*shared, F.col(unit_id).cast("long").alias("candidate_id"))
    return cases, pool


def match_with_reuse(
    units: DataFrame, block: list[str], covariates: list[str], unit_id: str, treated: str
) -> DataFrame:
    """Nearest control per treated unit; a control may serve several units.

    Candidates with identical covariates are reduced to their lowest id and
    treated units with identical covariates are searched once.
    """
    dims = [f"z_{c}" for c in covariates]
    cases, pool = _split(units, block, covariates, unit_id, treated)
    pool = pool.groupBy(*block, *dims).agg(F.min("candidate_id").alias("candidate_id")).withColumn(
        "holder", F.lit(_FREE)
    )
    lead = cases.groupBy(*block, *dims).agg(F.min("treated_id").alias("treated_id"))
    pool = written(pool, "match-pool")
    found = nearest(lead, pool, block, dims, hierarchy(pool, block, dims)).withColumnRenamed("treated_id", "lead_id")
    owner = cases.join(lead.withColumnRenamed("treated_id", "lead_id"), [*block, *dims])
    return owner.select(*block, "treated_id", "lead_id").join(found, [*block, "lead_id"]).drop("lead_id")


def matched_pairs(units: DataFrame, block: list[str], covariates: list[str], unit_id: str, treated: str, caliper: float,
                  carried: list[str]) -> DataFrame:
    """Treated units with their nearest control within the caliper, each side's
    ``carried`` and covariate columns under ``t_`` and ``c_``.

    A treated unit without a control that near is left out, as nothing tells what
    it would have done.
    """
    found = match_with_reuse(units, block, covariates, unit_id, treated).where(F.col("distance") <= caliper)
    side = lambda tag, key: units.select(
        F.col(unit_id).cast("long").alias(key), *[F.col(c).alias(f"{tag}_{c}") for c in (*carried, *covariates)])
    return found.join(side("t", "treated_id"), "treated_id").join(side("c", "candidate_id"), "candidate_id")


def worst_imbalance(pairs: DataFrame, keys: list[str], covariates: list[str]) -> DataFrame:
    """Largest standardised mean difference of a covariate between the matched sides, in absolute value."""
    gaps = []
    for c in covariates:
        t, o = F.col(f"t_{c}").cast("double"), F.col(f"c_{c}").cast("double")
        apart, spread = F.avg(t) - F.avg(o), F.sqrt((F.var_pop(t) + F.var_pop(o)) / 2.0)
        gaps.append(F.when(apart == 0, 0.0).when(spread > 0, F.abs(apart) / spread).otherwise(float("inf")))
    return pairs.groupBy(*keys).agg(F.greatest(*gaps, F.lit(0.0)).alias("worst_smd"))


def match_without_reuse(
    units: DataFrame, block: list[str], covariates: list[str], unit_id: str, treated: str
) -> DataFrame:
    """Each control serves one treated unit; lower treated ids choose first.

    Controls with identical covariates form one place with that many seats.
    In every round each unseated unit proposes to its nearest place that still
    has a seat or seats a higher id, and a place keeps its lowest ids.  The
    outcome equals serving the units one by one in id order, but each round is
    one distributed job; a round without proposals ends the loop.  Seats are
    handed out in id order on both sides.
    """
    dims = [f"z_{c}" for c in covariates]
    cases, pool = _split(units, block, covariates, unit_id, treated)
    places = written(
        pool.groupBy(*block, *dims).agg(F.min("candidate_id").alias("candidate_id"), F.count(F.lit(1)).alias("seats")),
        "match-places",
    )
    depths = hierarchy(places, block, dims)
    place = [*block, "candidate_id"]
    seated, asking, offered = None, cases, places.withColumn("holder", F.lit(_FREE))
    while True:
        proposals = written(nearest(asking, offered, block, dims, depths), "match-proposals")
        if proposals.isEmpty():
            break
        every = proposals if seated is None else proposals.unionByName(seated.select(proposals.columns))
        ranked = competition_rank(every, place, "treated_id", "seat", descending=False)
        seated = written(
            ranked.join(places.select(*place, "seats"), place).where(F.col("seat") <= F.col("seats")).drop("seats"),
            "match-seated",
        )
        taken = seated.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.max("treated_id").alias("_last"))
        full = F.coalesce(F.col("_n") >= F.col("seats"), F.lit(False))
        offered = places.join(taken, place, "left").withColumn(
            "holder", F.when(full, F.col("_last")).otherwise(F.lit(_FREE))
        ).drop("_n", "_last")
        asking = cases.join(seated.select(*block, "treated_id"), [*block, "treated_id"], "left_anti")
    if seated is None:
        return proposals
    numbered = competition_rank(pool, [*block, *dims], "candidate_id", "seat", descending=False).withColumnRenamed(
        "candidate_id", "control_id"
    )
    of_place = places.select(*block, *dims, "candidate_id").join(numbered, [*block, *dims])
    return seated.join(of_place.select(*place, "seat", "control_id"), [*place, "seat"]).select(
        *block, "treated_id", F.col("control_id").alias("candidate_id"), "distance"
    )
