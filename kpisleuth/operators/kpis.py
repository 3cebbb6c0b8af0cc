"""Governed KPIs: net revenue, transactions, conversion, ASP, availability,
quick-commerce fulfilment, with grain rules, row policies and contributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import count_true, crore, period_of, price, ratio, rounded
from kpisleuth.operators.conform import in_scope, net_amount

CELL = ["region", "store_id", "period"]


def check_grain(kpi: str, grain: str) -> str:
    """Refuse a KPI or grain the contract does not offer."""
    if kpi not in config.KPIS:
        raise ValueError(f"unknown KPI {kpi!r}")
    if grain not in config.KPIS[kpi]["grains"]:
        raise ValueError(f"{kpi} does not support grain {grain!r}")
    return grain


def between(df: DataFrame, day: str, start: str | None, end: str | None) -> DataFrame:
    """Half-open date range on the raw date, so the scan can prune."""
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(day) < F.lit(end).cast("date"))
    return df


def _store_period(df: DataFrame, day: str, grain: str, extra: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy("store_id", *extra, period_of(F.col(day), grain).alias("period")).agg(*aggs)


def _placed(per_store: DataFrame, stores: DataFrame) -> DataFrame:
    """Attach the region after aggregating, when rows are few."""
    return per_store.join(stores.select("store_id", "region"), "store_id")


def net_revenue(sales, stores, grain="monthly", start=None, end=None) -> DataFrame:
    check_grain("net_revenue", grain)
    facts = between(in_scope(sales), "txn_date", start, end)
    sums = _store_period(facts, "txn_date", grain, [], F.sum(net_amount()).alias("net"))
    return _placed(sums, stores).select(*CELL, crore(F.col("net")).alias("net_revenue_inr_cr"))


def transactions(sales, stores, grain="monthly", start=None, end=None) -> DataFrame:
    """Distinct bills.  Spark de-duplicates on (cell, bill) before counting, so
    the distinct step spreads over bills rather than over stores."""
    check_grain("transactions", grain)
    facts = between(in_scope(sales, "transactions"), "txn_date", start, end)
    counts = _store_period(facts, "txn_date", grain, [], F.countDistinct("txn_id").alias("transactions"))
    return _placed(counts, stores).select(*CELL, "transactions")


def conversion_rate(sales, footfall, stores, grain="monthly", start=None, end=None) -> DataFrame:
    """Bills per 100 visits.  Both sides are reduced to store-day first, so a
    day's visits count once and days with visits but no sale stay in."""
    check_grain("conversion_rate", grain)
    bills = (
        between(in_scope(sales, "conversion_rate"), "txn_date", start, end)
        .groupBy("store_id", F.col("txn_date").alias("footfall_date"))
        .agg(F.countDistinct("txn_id").alias("bills"))
    )
    seen = between(footfall, "footfall_date", start, end).where("counter_installed")
    daily = seen.groupBy("store_id", "footfall_date").agg(F.sum("footfall").alias("visits"))
    joined = daily.join(bills, ["store_id", "footfall_date"], "left")
    parts = _store_period(
        joined, "footfall_date", grain, [],
        F.sum(F.coalesce("bills", F.lit(0))).alias("bills"),
        F.sum("visits").alias("visits"),
    )
    rate = rounded(100.0 * ratio(F.col("bills"), F.col("visits"))).alias("conversion_rate_pt")
    return _placed(parts, stores).select(*CELL, "bills", "visits", rate)


def avg_selling_price(sales, stores, skus, grain="monthly", start=None, end=None) -> DataFrame:
    """Net revenue over units per sub-category.  Lines are first combined per
    (store, SKU, period); the SKU join then sees far fewer rows."""
    check_grain("avg_selling_price", grain)
    facts = between(in_scope(sales, "avg_selling_price"), "txn_date", start, end)
    per_sku = _store_period(
        facts, "txn_date", grain, ["sku_id"],
        F.sum(net_amount()).alias("net"), F.sum("units").alias("units"),
    )
    named = per_sku.join(skus.select("sku_id", "sub_category"), "sku_id")
    parts = named.groupBy("store_id", "sub_category", "period").agg(
        F.sum("net").alias("net"), F.sum("units").alias("units")
    )
    return _placed(parts, stores).select(
        "region", "store_id", "sub_category", "period",
        price(ratio(F.col("net"), F.col("units"))).alias("avg_selling_price_inr"),
    )


def on_shelf_availability(inventory, assortment, stores, grain="weekly", start=None, end=None) -> DataFrame:
    """Ranged SKUs in stock at the reference hour over ranged SKUs.

    The join is an equi-join on SKU (and store, if the assortment names
    stores); the validity range is a residual of it.
    """
    check_grain("on_shelf_availability", grain)
    noon = between(inventory, "snapshot_date", start, end).where(
        F.col("snapshot_hour") == config.SNAPSHOT_HOUR
    )
    on = ["store_id", "sku_id"] if "store_id" in assortment.columns else ["sku_id"]
    ranged = noon.join(assortment, on).where(
        F.col("snapshot_date").between(F.col("valid_from"), F.col("valid_to"))
    )
    parts = _store_period(
        ranged, "snapshot_date", grain, [],
        count_true(F.col("on_hand_units") > 0).alias("in_stock"), F.count(F.lit(1)).alias("ranged"),
    )
    rate = rounded(100.0 * ratio(F.col("in_stock"), F.col("ranged"))).alias("on_shelf_availability_pct")
    return _placed(parts, stores).select(*CELL, "in_stock", "ranged", rate)


def qcomm_fulfilment(orders, stores, grain="weekly", start=None, end=None) -> DataFrame:
    """Orders both complete and on time over all orders; partial is a miss."""
    check_grain("qcomm_fulfilment_rate", grain)
    facts = between(orders, "order_date", start, end).where(
        F.col("txn_type") != config.EXCLUDED_TXN_TYPE
    ).withColumnRenamed("dark_store_id", "store_id")
    good = (F.col("lines_shipped") == F.col("lines_ordered")) & (
        F.col("delivered_date") <= F.col("promised_date")
    )
    parts = _store_period(
        facts, "order_date", grain, [], count_true(good).alias("good"), F.count(F.lit(1)).alias("orders")
    )
    rate = rounded(100.0 * ratio(F.col("good"), F.col("orders"))).alias("qcomm_fulfilment_rate_pct")
    return _placed(parts, stores).select(*CELL, "good", "orders", rate)


# ---------------------------------------------------------------------------
# Access
# ---------------------------------------------------------------------------
def policy_for(kpi: str, persona: str | None) -> dict:
    """Policy of a persona; none given means the default, unknown is refused."""
    policies = config.ACCESS[kpi]
    name = persona or config.DEFAULT_PERSONA
    if name not in policies:
        raise PermissionError(f"persona {name!r} has no policy for {kpi}")
    return policies[name]


def apply_row_policy(df: DataFrame, kpi: str, persona: str | None = None, attrs: dict | None = None) -> DataFrame:
    """Restrict rows to what the persona may see, as a pushed-down filter."""
    scope = policy_for(kpi, persona)["rows"]
    if scope == "all":
        return df
    column, key = {"own_region": ("region", "user_region"), "own_store": ("store_id", "user_store_id")}[scope]
    if not attrs or attrs.get(key) is None:
        raise PermissionError(f"persona {persona!r} needs attribute {key!r}")
    return df.where(F.col(column) == F.lit(attrs[key]))


def mask(df: DataFrame, kpi: str, persona: str | None = None) -> DataFrame:
    """Null out the columns hidden from the persona, keeping their types."""
    hidden = set(policy_for(kpi, persona)["masked"])
    types = {f.name: f.dataType for f in df.schema}
    return df.select(
        *[F.lit(None).cast(types[c]).alias(c) if c in hidden else F.col(c) for c in df.columns]
    )


# ---------------------------------------------------------------------------
# Grain, contribution, panels
# ---------------------------------------------------------------------------
def additive_parts(sales: DataFrame, keys: list[str], grain: str) -> DataFrame:
    """Additive parts of the sales KPIs, so ratios re-aggregate exactly."""
    return in_scope(sales).groupBy(*keys, period_of(F.col("txn_date"), grain).alias("period")).agg(
        F.sum(net_amount()).alias("net"), F.sum("units").alias("units"), F.count(F.lit(1)).alias("lines")
    )


def kpis_at_grain(names: list[str], sales: DataFrame, stores: DataFrame, grain: str) -> DataFrame:
    """Sales KPIs per region and period, in long form, from one pass over the
    lines, at any grain every one of their contracts allows."""
    value = {
        "net_revenue": crore(F.col("net")),
        "avg_selling_price": price(ratio(F.col("net"), F.col("units"))),
    }
    for name in names:
        check_grain(name, grain)
        if name not in value:
            raise ValueError(f"{name} is not additive over sales lines")
    by_store = additive_parts(sales, ["store_id"], grain)
    parts = _placed(by_store, stores).groupBy("region", "period").agg(
        F.sum("net").alias("net"), F.sum("units").alias("units")
    )
    return parts.select("region", "period", F.inline(F.array(*[
        F.struct(F.lit(name).alias("kpi"), value[name].alias("value")) for name in names
    ])))


def region_rate(per_store: DataFrame, kpi: str, part: str, whole: str) -> DataFrame:
    """A rate by region and period from its stores' counts, in long form."""
    return per_store.groupBy("region", "period").agg(
        rounded(100.0 * ratio(F.sum(part), F.sum(whole))).alias("value")
    ).select("region", "period", F.lit(kpi).alias("kpi"), "value")


def region_transactions(sales: DataFrame, stores: DataFrame, grain: str) -> DataFrame:
    """Distinct bills by region and period: one that several stores of a region
    share counts once.  Lines become bills per store before the region attaches."""
    check_grain("transactions", grain)
    bills = in_scope(sales, "transactions").select("store_id", period_of(F.col("txn_date"), grain).alias("period"), "txn_id").distinct()
    return _placed(bills, stores).select("region", "period", "txn_id").distinct().groupBy("region", "period").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    ).select("region", "period", F.lit("transactions").alias("kpi"), "value")


def region_month(panel: DataFrame, amount: str, day: str) -> DataFrame:
    return panel.groupBy("region", period_of(F.col(day), "monthly").alias("period")).agg(
        crore(F.sum(amount)).alias("total_cr")
    )


def contribution_by_year(cells: DataFrame, dims: list[str]) -> DataFrame:
    """``contribution`` of every pair of successive years present.

    ``cells`` has the dimensions, ``year`` and ``value``.  A row counts as after in
    its year and as before in the next; ``year`` names the later one of a pair.
    """
    known = cells.select("year").distinct()
    pairs = known.join(known.select((F.col("year") + 1).alias("year")), "year")
    sides = F.array(
        F.struct(F.col("year").alias("year"), F.lit(0.0).alias("before"), F.col("value").alias("after")),
        F.struct((F.col("year") + 1).alias("year"), F.col("value").alias("before"), F.lit(0.0).alias("after")))
    split = cells.select(*dims, F.explode(sides).alias("side")).select(*dims, "side.*").join(F.broadcast(pairs), "year")
    sums = split.groupingSets([[F.col("year"), F.col(d)] for d in dims], F.col("year"), *[F.col(d) for d in dims]).agg(
        F.sum("before").alias("before"), F.sum("after").alias("after"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    whole = split.groupBy("year").agg((F.sum("after") - F.sum("before")).alias("total_delta"))
    delta = F.col("after") - F.col("before")
    pick = lambda make: F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, make(d)) for d in dims])
    return sums.join(F.broadcast(whole), "year").select(
        "year", pick(F.lit).alias("dimension"), pick(lambda d: F.col(d).cast("string")).alias("member"),
        crore(delta).alias("delta_cr"), rounded(ratio(delta, F.col("total_delta"))).alias("share_of_delta"),
    )


def contribution(cells: DataFrame, dims: list[str]) -> DataFrame:
    """Where a movement sits: delta and share of the total, per dimension.

    ``cells`` has the dimensions, ``before`` and ``after``.  Grouping sets cover
    every dimension in one aggregation.
    """
    sums = cells.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.sum("before").alias("before"), F.sum("after").alias("after"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    whole = cells.agg((F.sum("after") - F.sum("before")).alias("total_delta"))
    delta = F.col("after") - F.col("before")
    is_dim = {d: F.col(f"_g_{d}") == 0 for d in dims}
    pick = lambda make: F.coalesce(*[F.when(is_dim[d], make(d)) for d in dims])
    return sums.join(F.broadcast(whole)).select(
        pick(F.lit).alias("dimension"),
        pick(lambda d: F.col(d).cast("string")).alias("member"),
        crore(delta).alias("delta_cr"),
        rounded(ratio(delta, F.col("total_delta"))).alias("share_of_delta"),
    )


def revenue_equivalent(cells: DataFrame) -> DataFrame:
    """A conversion residual expressed in revenue: |residual| / before x revenue."""
    return cells.withColumn(
        "revenue_equivalent",
        ratio(F.abs("residual_pt"), F.col("conversion_before_pt")) * F.col("revenue"),
    )


def kpi_panel(kpis: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """KPIs side by side.  Tagged rows are merged by one aggregation instead of
    a chain of outer joins.  Each KPI is the column of its name, else ``value``;
    KPIs of one DataFrame share its rows."""
    frames = list({id(df): df for df in kpis.values()}.values())
    given = lambda df, name: F.col(name if name in df.columns else "value").cast("double")
    tagged = [
        df.select(*keys, *[(given(df, n) if own is df else F.lit(None).cast("double")).alias(n) for n, own in kpis.items()])
        for df in frames
    ]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.max(n).alias(n) for n in kpis])
