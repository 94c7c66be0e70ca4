"""The given star-schema tables read as the roles the analytics need.

Panel role: `lineitem` priced per region and day. Release, rate, risk-index and probability roles:
`orders` by month or day. Request role: `events`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tidemark.operators.events import crossings, rested
from tidemark.session import materialize, written

# Role letters by entity order; the first one is the safe asset.
ROLES = ("g", "f", "c", "s", "i")


# Column types of the given tables; a stated schema saves an inference job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def role_of(ord_col: Column) -> Column:
    return F.substring(F.lit("".join(ROLES)), ord_col + 1, F.lit(1))


def supplier_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, entity, ord): which panel entity each supplier belongs to."""
    return (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("entity"), F.col("r_regionkey").alias("ord"))
    )


def priced(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, *measures: str) -> DataFrame:
    """Sum measures by (entity, ord, d).

    The fact is summed by (key, day) first, partly where it is read, so no key brings more rows to the join than
    there are days; how the join is done is Catalyst's choice.
    """
    sums = [F.sum(m).alias(m) for m in measures]
    fact = fact.groupBy(fact_key, "d").agg(*sums)
    return fact.join(dim, F.col(fact_key) == F.col(dim_key)).groupBy("entity", "ord", "d").agg(*sums)


_SHARED: ContextVar[dict[tuple[str, str], tuple[StructType, str]]] = ContextVar("shared", default={})


@contextmanager
def shared(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Inside, the panel and the order cube of these tables are written once and read by all queries of this context."""
    tables = {(name, sf_dir): make(spark, sf_dir) for name, make in (("panel", panel), ("order_cube", order_cube))}
    token = _SHARED.set({key: (df.schema, written(df)) for key, df in tables.items()})
    try:
        yield
    finally:
        _SHARED.reset(token)


def read_shared(spark: SparkSession, name: str, sf_dir: str) -> DataFrame | None:
    found = _SHARED.get().get((name, sf_dir))
    return found and spark.read.schema(found[0]).parquet(found[1])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, ord, d, px), one row per entity and session; the log keeps returns small."""
    found = read_shared(spark, "panel", sf_dir)
    if found is not None:
        return found
    fact = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity"
    )
    sums = priced(fact, supplier_entities(spark, sf_dir), "l_suppkey", "s_suppkey", "l_extendedprice", "l_quantity")
    return sums.select("entity", "ord", "d", unit_price_level().alias("px"))


def unit_price_level() -> Column:
    return F.round(100.0 + 10.0 * F.ln(F.col("l_extendedprice") / F.col("l_quantity")), 6)


def wide_panel_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same price level keyed by supplier: a panel whose entity count grows with the data."""
    fact = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity"
    )
    sums = fact.groupBy("entity", "d").agg(F.sum("l_extendedprice").alias("l_extendedprice"), F.sum("l_quantity").alias("l_quantity"))
    return sums.select("entity", "d", unit_price_level().alias("px"))


def panel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written once; its size is entities x days, whatever the size of the fact table."""
    found = read_shared(spark, "panel", sf_dir)
    return found if found is not None else materialize(panel(spark, sf_dir))


def sessions(panel_df: DataFrame) -> DataFrame:
    """(d, pos): the observed calendar. One row per day, so a single ordered pass is enough."""
    return panel_df.select("d").distinct().select("d", (F.row_number().over(W.orderBy("d")) - 1).alias("pos"))


def densify(panel_df: DataFrame) -> DataFrame:
    """Every entity on every session; a session an entity missed shows a NULL price."""
    calendar = panel_df.agg(F.sort_array(F.collect_set("d")).alias("days")).scalar()
    grid = (
        panel_df.select("entity", "ord").distinct()
        .select("entity", "ord", F.posexplode(calendar).alias("pos", "d"))
    )
    return grid.join(panel_df.select("entity", "d", "px"), ["entity", "d"], "left").select("entity", "ord", "d", "pos", "px")


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(panel_table(spark, sf_dir))


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_d, o_orderpriority, o_orderstatus, total, n): every order-based series comes from this one pass.

    It has a handful of rows per day; jobs that need several series write it once.
    """
    found = read_shared(spark, "order_cube", sf_dir)
    if found is not None:
        return found
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("obs_d"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return orders.groupBy("obs_d", "o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))


def _mean(cond: Column | None = None) -> Column:
    if cond is None:
        return F.try_divide(F.sum("total"), F.sum("n"))
    return F.try_divide(F.sum(F.when(cond, F.col("total"))), F.sum(F.when(cond, F.col("n"))))


def _share(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")


def daily_rates(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """Daily series keyed by observation date: four levels and two spreads, NULL where unobserved."""
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    levels = {"effr": "1-URGENT", "ust_3m": "2-HIGH", "ust_2y": "3-MEDIUM", "ust_10y": "4-NOT SPECIFIED"}
    out = cube.groupBy("obs_d").agg(*[F.round(_mean(F.col("o_orderpriority") == p) / 50021.1373, 4).alias(name) for name, p in levels.items()])
    return out.select(
        "*",
        F.round(F.col("ust_10y") - F.col("ust_2y"), 4).alias("spread_10y_2y"),
        F.round(F.col("ust_10y") - F.col("ust_3m"), 4).alias("spread_10y_3m"),
    )


def monthly_releases(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """(month, cpi, unemp): monthly level and rate keyed by the first day of the observed month."""
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    return cube.groupBy(F.trunc("obs_d", "MM").alias("month")).agg(
        F.round(_mean() / 997.1357, 4).alias("cpi"), F.round(100.0 * _share(F.col("o_orderstatus") == "F"), 4).alias("unemp"))


def risk_index(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """(obs_d, idx, acts, threats): a daily index and its two components."""
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    status = F.col("o_orderstatus")
    return cube.groupBy("obs_d").agg(
        F.round(_mean() / 977.3391, 4).alias("idx"), F.round(_mean(status == "F") / 977.3391, 4).alias("acts"), F.round(_mean(status == "O") / 977.3391, 4).alias("threats"))


def volatility_quotes(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """(obs_d, quote): an optional source with holes, for the fallback rule."""
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    urgent = cube.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
    return urgent.groupBy("obs_d").agg(F.round(_mean() / 10007.3911, 4).alias("quote"))


def forward_dated_probability(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """(fwd_d, prob): a monthly probability stamped one year ahead of the month it describes."""
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    return (
        cube.groupBy(F.trunc("obs_d", "MM").alias("month")).agg(F.round(_share(F.col("o_orderstatus") == "O"), 6).alias("prob"))
        .select(F.last_day(F.add_months("month", 12)).alias("fwd_d"), "prob")
    )


def tone_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_d, score): one scored text event per row."""
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("obs_d"), F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)").alias("score")
    )


# Event categories by order priority.
CATEGORIES = {
    "1-URGENT": "war",
    "2-HIGH": "financial_crisis",
    "3-MEDIUM": "rate_shock",
    "4-NOT SPECIFIED": "pandemic",
    "5-LOW": "other",
}


# Earlier days a day's total is held against, least number of them, z-score that makes an event, days of rest.
EVENT_RULE = {"rows": 63, "least": 40, "threshold": 2.0}
EVENT_REST = 10


def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, category, event_d): days on which a priority's orders rise far above their recent level.

    Orders are summed by priority and day where they are read, in whole cents so that any order of adding gives the
    same total; the rule runs on those daily rows.
    """
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    days = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("event_d")).agg(cents)
    found = rested(crossings(days, "o_orderpriority", "event_d", "cents", **EVENT_RULE), "o_orderpriority", "event_d", EVENT_REST)
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    place = F.array_position(F.array(*[F.lit(p) for p in CATEGORIES]), F.col("o_orderpriority"))
    number = F.datediff("event_d", F.lit("1970-01-01").cast("date")).cast("bigint") * len(CATEGORIES) + place
    return found.select(number.alias("event_id"), names[F.col("o_orderpriority")].alias("category"), "event_d")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, req_id, ts, target): change requests, one-hot on the event type; `view` is the safe target."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("account"), F.col("event_id").alias("req_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("target"),
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p, y): a score in [0, 1] and a 0/1 outcome per labelled document."""
    return (
        table(spark, sf_dir, "labels").select("doc_id", "quality")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"), F.col("quality").cast("double").alias("y"))
    )
