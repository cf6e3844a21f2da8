"""Every operator as a query over the given tables, paired with its SQL equivalent.

Queries without SQL (iterative models) are checked by tests instead.  Inputs with
missing cells are derived from the tables by the same expression on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.storage import shared_folder
from tablewright.operators import charts, cleaning, filtering, grouping, hypothesis_tests, kpis, quality, segment_tests, timeseries
from tablewright.operators.anomalies import detect_anomalies, top_anomalies
from tablewright.operators.forecasting import forecast_series
from tablewright.operators.joining import join_tables
from tablewright.operators.sampling import evidence_sample
from tablewright.operators.segments import segment_rows
from tablewright.plans.recipe import operation_record, replay_recipe, undo
from tablewright.sources.sinks import write_csv
from tablewright.sources.tables import read_csv, read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events with gaps: one event type is unknown and another has no value at all.
GAPPED = (
    "WITH e AS (SELECT event_id, ts, user_id, nullif(event_type, 'signup') AS event_type, "
    "CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events) "
)


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({
        "event_type": F.nullif(F.col("event_type"), F.lit("signup")),
        "value": F.when(F.col("event_type") != "error", F.col("value")),
    })


def money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- Missing values -----------------------------------------------------------

for _name, _method, _column, _sql in [
    ("fill_mean", "Mean", "value", "round(coalesce(value, (SELECT avg(value) FROM e)), 6)"),
    ("fill_median", "Median", "value", "round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 6)"),
    ("fill_mode", "Mode", "event_type",
     "coalesce(event_type, (SELECT event_type FROM e WHERE event_type IS NOT NULL GROUP BY event_type "
     "ORDER BY count(*) DESC, event_type LIMIT 1))"),
    ("fill_custom", "Custom value", "value", "round(coalesce(value, 125.5), 6)"),
]:
    @query(_name, f"{GAPPED} SELECT event_id, {_sql} AS {_column} FROM e")
    def _(spark, sf_dir, method=_method, column=_column):
        filled = cleaning.treat_missing(gapped(spark, sf_dir), column, method, "125.5")
        filled = filled.select("event_id", column)
        return filled if column == "event_type" else rounded(filled, column)


@query("drop_missing", f"{GAPPED} SELECT event_id, user_id, event_type, value FROM e WHERE value IS NOT NULL")
def _(spark, sf_dir):
    kept = cleaning.treat_missing(gapped(spark, sf_dir), "value", "Drop rows")
    return kept.select("event_id", "user_id", "event_type", "value")


@query("drop_field", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, sf_dir):
    return cleaning.drop_field(cleaning.treat_missing(table(spark, sf_dir, "events"), "ts", "Drop column"), "props")


# --- Duplicates ---------------------------------------------------------------

_EVENT_FIELDS = "event_id, user_id, event_type, value, props"


@query("dedup_first", f"{GAPPED} SELECT {_EVENT_FIELDS} FROM e QUALIFY row_number() OVER "
       "(PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def _(spark, sf_dir):
    return cleaning.deduplicate(gapped(spark, sf_dir).drop("ts"), ["user_id", "event_type"], "first", "event_id")


@query("dedup_last", f"{GAPPED} SELECT {_EVENT_FIELDS} FROM e QUALIFY row_number() OVER "
       "(PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def _(spark, sf_dir):
    return cleaning.deduplicate(gapped(spark, sf_dir).drop("ts"), ["user_id", "event_type"], "last", "event_id")


@query("dedup_none", f"{GAPPED} SELECT {_EVENT_FIELDS} FROM e QUALIFY count(*) OVER (PARTITION BY user_id, props) = 1")
def _(spark, sf_dir):
    return cleaning.deduplicate(gapped(spark, sf_dir).drop("ts"), ["user_id", "props"], False)


# The row order of the file decides when no order is named.
@query("dedup_file_order", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER "
       "(PARTITION BY user_id ORDER BY event_id) = 1")
def _(spark, sf_dir):
    events = read_parquet(spark, f"{sf_dir}/events.parquet", row_id=True)
    return cleaning.deduplicate(events, ["user_id"], "first").select("event_id", "user_id")


@query("dedup_exact", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(spark, sf_dir):
    return cleaning.deduplicate(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("duplicate_count", "SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicates FROM "
       "(SELECT DISTINCT l_orderkey, l_returnflag, l_quantity FROM lineitem)")
def _(spark, sf_dir):
    return quality.duplicate_count(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"))


# --- Types --------------------------------------------------------------------

_MIXED = "CASE WHEN event_type = 'error' THEN event_type ELSE replace(replace(props, '{\"k\": ', ''), '}', '') END"


@query("convert_number", f"SELECT event_id, try_cast({_MIXED} AS DOUBLE) AS k FROM events")
def _(spark, sf_dir):
    return cleaning.convert_type(table(spark, sf_dir, "events").select("event_id", F.expr(_MIXED).alias("k")), "k", "Number")


_WORDS = "CASE event_type WHEN 'view' THEN 'Yes' WHEN 'click' THEN 'n' WHEN 'error' THEN '1' ELSE event_type END"


@query("convert_bool", f"SELECT event_id, CASE WHEN lower(w) IN ('true', '1', 'yes', 'y') THEN TRUE "
       f"WHEN lower(w) IN ('false', '0', 'no', 'n') THEN FALSE END AS flag FROM (SELECT event_id, {_WORDS} AS w FROM events)")
def _(spark, sf_dir):
    words = table(spark, sf_dir, "events").select("event_id", F.expr(_WORDS).alias("flag"))
    return cleaning.convert_type(words, "flag", "Boolean")


@query("convert_date", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS placed FROM orders")
def _(spark, sf_dir):
    written = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("placed"))
    return cleaning.convert_type(orders, "placed", "Date/time").withColumn("placed", F.to_date("placed"))


@query("convert_date_ambiguous", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS placed FROM orders")
def _(spark, sf_dir):
    # The leading rows, of early days in a month, read day first and month first.
    written = F.date_format("o_orderdate", "dd/MM/yyyy")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("placed")).orderBy(F.dayofmonth("o_orderdate"))
    return cleaning.convert_type(orders, "placed", "Date/time").withColumn("placed", F.to_date("placed"))


@query("convert_text", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders")
def _(spark, sf_dir):
    return cleaning.convert_type(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "Text")


@query("convert_category", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return cleaning.convert_type(customers, "c_nationkey", "Category")


# --- Outliers -----------------------------------------------------------------

_BOUNDS = (
    f"{GAPPED}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e), "
    "f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) "
)
for _name, _method, _sql, _small in [
    ("outlier_cap", "Cap values",
     "SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM e, f", None),
    ("outlier_remove", "Remove rows",
     "SELECT event_id, round(value, 6) AS value FROM e, f WHERE value IS NULL OR value BETWEEN lo AND hi", None),
    ("outlier_null", "Replace with missing",
     "SELECT event_id, round(CASE WHEN value BETWEEN lo AND hi THEN value END, 6) AS value FROM e, f", None),
    ("outlier_remove_by_cells", "Remove rows",
     "SELECT event_id, round(value, 6) AS value FROM e, f WHERE value IS NULL OR value BETWEEN lo AND hi", 0),
]:
    @query(_name, _BOUNDS + _sql)
    def _(spark, sf_dir, method=_method, small=_small):
        treated = cleaning.treat_outliers(gapped(spark, sf_dir), "value", method, 1.5, small)
        return rounded(treated.select("event_id", "value"), "value")


def _screen(field: str) -> str:
    return (
        f"SELECT '{field}' AS field, CAST(count(*) FILTER ((b - a) <> 0 AND (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a))) AS BIGINT) "
        f"AS outliers, count(v) AS n FROM (SELECT CAST({field} AS DOUBLE) AS v FROM e), "
        f"(SELECT quantile_cont({field}, 0.25) AS a, quantile_cont({field}, 0.75) AS b FROM e)"
    )


@query("outlier_screen", f"{GAPPED} SELECT field, outliers, round(outliers / n * 100, 6) AS rate FROM ("
       + " UNION ALL ".join(_screen(f) for f in ("event_id", "user_id", "value")) + ")")
def _(spark, sf_dir):
    return rounded(quality.outlier_screen(gapped(spark, sf_dir)), "rate")


# --- Filters ------------------------------------------------------------------

for _name, _table, _column, _operator, _value, _keep, _sql in [
    ("filter_equals", "customer", "c_mktsegment", "equals", "BUILDING", "c_custkey, c_mktsegment", "c_mktsegment = 'BUILDING'"),
    ("filter_equals_number", "lineitem", "l_quantity", "equals", "10.0", "l_orderkey, l_quantity", "l_quantity = 10"),
    ("filter_not_equal", "e", "event_type", "not equal", "view", "event_id, event_type",
     "event_type IS NULL OR event_type <> 'view'"),
    ("filter_contains", "part", "p_name", "contains", "RE.*ing", "p_partkey, p_name", "regexp_matches(p_name, 're.*ing', 'i')"),
    ("filter_gt", "e", "value", "greater than", "50", "event_id, value", "value > 50"),
    ("filter_lt", "e", "value", "less than", "50.5", "event_id, value", "value < 50.5"),
    ("filter_at_least", "e", "user_id", "at least", "75", "event_id, user_id", "user_id >= 75"),
    ("filter_at_most", "e", "value", "at most", "0.5", "event_id, value", "value <= 0.5"),
    ("filter_missing", "e", "value", "is missing", None, "event_id, value", "value IS NULL"),
    ("filter_populated", "e", "event_type", "is populated", None, "event_id, event_type", "event_type IS NOT NULL"),
]:
    @query(_name, f"{GAPPED} SELECT {_keep} FROM {_table} WHERE {_sql}")
    def _(spark, sf_dir, source=_table, column=_column, operator=_operator, value=_value, keep=_keep):
        df = gapped(spark, sf_dir) if source == "e" else table(spark, sf_dir, source)
        return filtering.filter_rows(df, column, operator, value).select(*keep.split(", "))


@query("search_all", "SELECT * FROM part WHERE " + " OR ".join(
    f"regexp_matches(CAST({c} AS VARCHAR), 'ring|^91', 'i')"
    for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def _(spark, sf_dir):
    return filtering.search_all(table(spark, sf_dir, "part"), "RING|^91")


@query("calc_field", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity AS unit FROM lineitem")
def _(spark, sf_dir):
    made = filtering.calculated(table(spark, sf_dir, "lineitem"), "unit", "l_extendedprice * (1 - l_discount) / l_quantity")
    return made.select("l_orderkey", "l_linenumber", "unit")


# --- Joins --------------------------------------------------------------------

_SIDES = (
    "WITH l AS (SELECT o_orderkey, CASE WHEN o_totalprice <= 490000 THEN o_custkey END AS custkey, o_totalprice AS amount "
    "FROM orders), r AS (SELECT CASE WHEN c_acctbal <= 9980 THEN c_custkey END AS custkey, c_name, c_acctbal AS amount "
    "FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL "
    "SELECT -1 - c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') "
)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") <= 490000, F.col("o_custkey")).alias("custkey"),
        F.col("o_totalprice").alias("amount"),
    )
    building = F.col("c_mktsegment") == "BUILDING"
    key = F.when(building, -1 - F.col("c_custkey")).when(F.col("c_acctbal") <= 9980, F.col("c_custkey"))
    customers = table(spark, sf_dir, "customer").select(key.alias("custkey"), "c_name", F.col("c_acctbal").alias("amount"))
    return orders, customers


for _how, _sql in [("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")]:
    for _suffix, _limit in [("", None), ("_split", 0)]:
        if _how == "inner" and _suffix:
            continue

        @query(f"join_{_how}{_suffix}", f"{_SIDES} SELECT o_orderkey, coalesce(l.custkey, r.custkey) AS custkey, "
               f"l.amount AS amount, c_name, r.amount AS amount_joined FROM l {_sql} r ON l.custkey IS NOT DISTINCT FROM r.custkey")
        def _(spark, sf_dir, how=_how, limit=_limit):
            left, right = _sides(spark, sf_dir)
            return join_tables(left, right, "custkey", "custkey", how, limit)


@query("join_different_keys", "SELECT c_custkey, c_nationkey, n_nationkey, n_name, n_regionkey FROM customer "
       "LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return join_tables(customers, table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "left")


# --- Groups -------------------------------------------------------------------

for _name, _aggregation, _sql, _small in [
    ("group_sum", "sum", "CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS DOUBLE)", None),
    ("group_mean", "mean", "round(avg(value), 6)", None),
    ("group_median", "median", "round(quantile_cont(value, 0.5), 6)", None),
    ("group_median_by_cells", "median", "round(quantile_cont(value, 0.5), 6)", 0),
    ("group_min", "min", "min(value)", None),
    ("group_max", "max", "max(value)", None),
    ("group_count", "count", "count(value)", None),
]:
    @query(_name, f"{GAPPED} SELECT event_type, user_id, {_sql} AS value FROM e GROUP BY event_type, user_id")
    def _(spark, sf_dir, aggregation=_aggregation, small=_small):
        events = gapped(spark, sf_dir)
        if aggregation == "sum":
            events = money(events, "value")
        found = grouping.group_summary(events, ["event_type", "user_id"], ["value"], aggregation, small)
        if aggregation == "sum":
            return as_double(found, "value")
        return rounded(found, "value") if aggregation in ("mean", "median") else found


@query("group_sum_many", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity, "
       "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    measures = ["l_quantity", "l_extendedprice"]
    lines = money(table(spark, sf_dir, "lineitem"), *measures)
    return as_double(grouping.group_summary(lines, ["l_returnflag", "l_linestatus"], measures, "sum"), *measures)


@query("group_median_many_by_cells", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice, "
       "round(quantile_cont(l_discount, 0.5), 6) AS l_discount FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    measures = ["l_extendedprice", "l_discount"]
    found = grouping.group_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], measures, "median", 0)
    return rounded(found, *measures)


@query("record_count", f'{GAPPED} SELECT event_type, count(*) AS "Records" FROM e GROUP BY 1')
def _(spark, sf_dir):
    return grouping.record_count(gapped(spark, sf_dir), ["event_type"])


@query("nunique", f'{GAPPED} SELECT event_type, count(DISTINCT props) AS "unique" FROM e GROUP BY 1')
def _(spark, sf_dir):
    return grouping.distinct_count(gapped(spark, sf_dir), ["event_type"], "props")


def _top_values(column: str) -> str:
    return (
        f"(SELECT '{column}' AS field, {column} AS value, count(*) AS count FROM part GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 5)"
    )


@query("value_counts", " UNION ALL ".join(f"SELECT * FROM {_top_values(c)}" for c in ("p_name", "p_brand", "p_type")))
def _(spark, sf_dir):
    return grouping.value_counts(table(spark, sf_dir, "part"))


@query("value_counts_text", "SELECT 'text' AS field, text AS value, count(*) AS count FROM documents GROUP BY text "
       "ORDER BY count(*) DESC, CASE WHEN length(text) > 64 THEN sha256(text) ELSE text END LIMIT 10")
def _(spark, sf_dir):
    return grouping.value_counts(table(spark, sf_dir, "documents"), ["text"], 10)


def _description(field: str, digits: int) -> str:
    v = f"CAST({field} AS DOUBLE)"
    return (
        f"SELECT '{field}' AS field, count({field}) AS count, round(avg({v}), {digits}) AS mean, round(stddev_samp({v}), {digits}) AS std, "
        f"round(min({v}), {digits}) AS min, round(quantile_cont({v}, 0.25), {digits}) AS \"25%\", "
        f"round(quantile_cont({v}, 0.5), {digits}) AS \"50%\", round(quantile_cont({v}, 0.75), {digits}) AS \"75%\", "
        f"round(max({v}), {digits}) AS max FROM e"
    )


for _name, _small in [("describe", None), ("describe_by_cells", 0)]:
    @query(_name, GAPPED + " UNION ALL ".join(_description(f, 6) for f in ("event_id", "user_id", "value")))
    def _(spark, sf_dir, small=_small):
        return grouping.describe(gapped(spark, sf_dir), digits=6, group_rows=small)


@query("contingency", f"{GAPPED} SELECT event_type, user_id, count(*) AS count FROM e WHERE event_type IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    return grouping.contingency(gapped(spark, sf_dir), "event_type", "user_id")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
for _name, _aggregation, _sql in [
    ("pivot_sum", "sum", "CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER ({f}), 0) AS DOUBLE)"),
    ("pivot_mean", "mean", "round(coalesce(avg(o_totalprice) FILTER ({f}), 0), 4)"),
    ("pivot_median", "median", "round(coalesce(quantile_cont(o_totalprice, 0.5) FILTER ({f}), 0), 4)"),
    ("pivot_count", "count", "count(o_totalprice) FILTER ({f})"),
]:
    @query(_name, "SELECT o_orderstatus, " + ", ".join(
        _sql.format(f=f"o_orderpriority = '{p}'") + f' AS "{p}"' for p in _PRIORITIES) + " FROM orders GROUP BY 1")
    def _(spark, sf_dir, aggregation=_aggregation):
        orders = table(spark, sf_dir, "orders")
        if aggregation == "sum":
            orders = money(orders, "o_totalprice")
        wide = grouping.pivot_table(orders, ["o_orderstatus"], "o_orderpriority", "o_totalprice", aggregation)
        if aggregation == "sum":
            return as_double(wide, *_PRIORITIES)
        return wide if aggregation == "count" else rounded(wide, *_PRIORITIES, digits=4)


@query("pivot_gaps", f"{GAPPED} SELECT user_id, " + ", ".join(
    f"coalesce(max(value) FILTER (event_type = '{t}'), 0) AS {t}" for t in ("click", "purchase", "view"))
    + " FROM e WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return grouping.pivot_table(gapped(spark, sf_dir), "user_id", "event_type", "value", "max")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("melt", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{m}' AS measure, {m} AS value FROM lineitem" for m in _MEASURES))
def _(spark, sf_dir):
    return grouping.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _MEASURES)


@query("share_of_total", "SELECT o_orderkey, round(o_totalprice / nullif(sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 0) "
       '* 100, 8) AS "Share" FROM orders')
def _(spark, sf_dir):
    shares = grouping.share_of_total(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")
    return rounded(shares.select("o_orderkey", "Share"), "Share", digits=8)


@query("top_categories", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 "
       "ORDER BY sum(CAST(p_retailprice AS DECIMAL(18,2))) DESC, p_brand LIMIT 5)")
def _(spark, sf_dir):
    parts = money(table(spark, sf_dir, "part"), "p_retailprice")
    return grouping.top_categories(parts, "p_brand", "p_retailprice", 5).select("p_partkey", "p_brand")


# --- Calendar -----------------------------------------------------------------

_LABELS = {
    "Day": ("1 DAY", "g.d"),
    "Week": ("7 DAY", "g.d + INTERVAL 6 DAY"),
    "Month": ("1 MONTH", "last_day(g.d)"),
    "Quarter": ("3 MONTH", "last_day(g.d + INTERVAL 2 MONTH)"),
    "Year": ("1 YEAR", "last_day(g.d + INTERVAL 11 MONTH)"),
}


def _calendar(frequency: str, aggregate: str, filler: str) -> str:
    step, label = _LABELS[frequency]
    return (
        f"WITH p AS (SELECT o_orderpriority AS s, CAST(date_trunc('{frequency.lower()}', o_orderdate) AS TIMESTAMP) AS d, {aggregate} AS v "
        f"FROM orders GROUP BY 1, 2), g AS (SELECT s, unnest(generate_series(min(d), max(d), INTERVAL {step})) AS d FROM p GROUP BY s) "
        f"SELECT g.s AS o_orderpriority, CAST({label} AS DATE) AS o_orderdate, coalesce(v, {filler}) AS o_totalprice "
        "FROM g LEFT JOIN p ON g.s = p.s AND g.d = p.d"
    )


_SUM = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
for _name, _frequency, _aggregation, _sql, _filler in [
    ("resample_day", "Day", "sum", _SUM, "0"),
    ("resample_week", "Week", "sum", _SUM, "0"),
    ("resample_month", "Month", "mean", "round(avg(o_totalprice), 4)", "NULL"),
    ("resample_quarter", "Quarter", "max", "max(o_totalprice)", "NULL"),
    ("resample_year", "Year", "median", "round(quantile_cont(o_totalprice, 0.5), 4)", "NULL"),
    ("resample_day_min", "Day", "min", "min(o_totalprice)", "NULL"),
]:
    @query(_name, _calendar(_frequency, _sql, _filler))
    def _(spark, sf_dir, frequency=_frequency, aggregation=_aggregation):
        orders = table(spark, sf_dir, "orders")
        if aggregation == "sum":
            orders = money(orders, "o_totalprice")
        found = timeseries.resample(orders, "o_orderdate", "o_totalprice", frequency, aggregation, ["o_orderpriority"])
        if aggregation == "sum":
            return as_double(found, "o_totalprice")
        return rounded(found, "o_totalprice", digits=4) if aggregation in ("mean", "median") else found


# --- Quality ------------------------------------------------------------------

_FACTORS = (
    f"{GAPPED}, m AS (SELECT count(*) AS n, sum((event_type IS NULL)::INT + (value IS NULL)::INT) AS missing, "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM (SELECT user_id, event_type, value FROM e))) AS kept FROM e), "
    "f AS (SELECT 1 - missing / (n * 3) AS completeness, 1 - (n - kept) / n AS row_uniqueness, "
    "CAST(1.0 AS DOUBLE) AS column_usefulness FROM m) "
)


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapped(spark, sf_dir).select("user_id", "event_type", "value")


@query("health", _FACTORS + "SELECT CAST(round_even(100 * (0.55 * completeness + 0.30 * row_uniqueness + 0.15 * column_usefulness), 0) "
       "AS INTEGER) AS score, round(completeness, 6) AS completeness, round(row_uniqueness, 6) AS row_uniqueness, column_usefulness FROM f")
def _(spark, sf_dir):
    return rounded(quality.health(_narrow(spark, sf_dir)), "completeness", "row_uniqueness")


def _quality_measures(source: str) -> str:
    return (
        f"(SELECT count(*) AS n, CAST(coalesce(sum((event_type IS NULL)::INT + (value IS NULL)::INT), 0) AS DOUBLE) AS missing, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM {source})) AS copies FROM {source})"
    )


@query("compare_quality", GAPPED + f", c AS (SELECT * FROM e WHERE value IS NOT NULL), o AS {_quality_measures('e')}, w AS {_quality_measures('c')} "
       + " UNION ALL ".join(
           f"SELECT '{label}' AS \"Metric\", round(CAST({old} AS DOUBLE), 6) AS \"Before\", round(CAST({new} AS DOUBLE), 6) AS \"After\", "
           f"round(CAST({new} AS DOUBLE) - CAST({old} AS DOUBLE), 6) AS \"Change\" FROM o, w"
           for label, old, new in [
               ("Rows", "o.n", "w.n"), ("Columns", "3", "3"), ("Missing cells", "o.missing", "w.missing"),
               ("Duplicate rows", "o.copies", "w.copies"),
               ("Completeness %", "(1 - o.missing / (o.n * 3)) * 100", "(1 - w.missing / (w.n * 3)) * 100"),
           ]))
def _(spark, sf_dir):
    before = _narrow(spark, sf_dir)
    compared = quality.compare_quality(before, cleaning.treat_missing(before, "value", "Drop rows"))
    return rounded(compared, "Before", "After", "Change")


_EVENT_COLUMNS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string",
}


def _per_event_field(template: str) -> str:
    return " UNION ALL ".join(template.format(c=c, t=t) for c, t in _EVENT_COLUMNS.items())


@query("missing_by_field", f"{GAPPED} SELECT field, missing, round(missing / n * 100, 6) AS percent FROM ("
       + _per_event_field("SELECT '{c}' AS field, count(*) - count({c}) AS missing, count(*) AS n FROM e") + ") WHERE missing > 0")
def _(spark, sf_dir):
    return rounded(quality.missing_by_field(gapped(spark, sf_dir)), "percent")


@query("field_profile", GAPPED + _per_event_field(
    "SELECT '{c}' AS \"Field\", '{t}' AS \"Type\", count({c}) AS \"Populated\", round((count(*) - count({c})) / count(*) * 100, 6) AS \"Missing %\", "
    "count(DISTINCT {c}) AS \"Unique\", left(CAST(arg_min({c}, event_id) FILTER ({c} IS NOT NULL) AS VARCHAR), 60) AS \"Example\" FROM e"))
def _(spark, sf_dir):
    return rounded(quality.field_profile(gapped(spark, sf_dir), "event_id"), "Missing %")


@query("data_dictionary", GAPPED + _per_event_field(
    "SELECT '{c}' AS field, '{t}' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS \"unique\" FROM e"))
def _(spark, sf_dir):
    return quality.data_dictionary(gapped(spark, sf_dir))


# Whole texts: long cells are compared in full.
@query("text_dictionary", " UNION ALL ".join(
    f"SELECT '{c}' AS field, '{t}' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS \"unique\" FROM documents"
    for c, t in {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}.items()))
def _(spark, sf_dir):
    return quality.data_dictionary(table(spark, sf_dir, "documents"))


@query("overview", GAPPED + "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, round((2 * count(*) - count(event_type) - count(value)) "
       "/ (6 * count(*)) * 100, 6) AS missing_percent, 2 * count(*) - count(event_type) - count(value) AS missing_cells, "
       "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS duplicates, "
       "round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e))) / count(*) * 100, 6) AS duplicate_percent, "
       "CASE WHEN count(DISTINCT ts) >= count(DISTINCT event_id) THEN 'ts' ELSE 'event_id' END AS widest_field, "
       "greatest(count(DISTINCT ts), count(DISTINCT event_id)) AS widest_unique, 3 AS numeric_fields, 2 AS categorical_fields, "
       "1 AS date_fields FROM e")
def _(spark, sf_dir):
    return rounded(quality.overview(gapped(spark, sf_dir)), "missing_percent", "duplicate_percent")


_CATEGORICAL = "('event_type', 'props')"


@query("field_eligibility", f"{GAPPED}, u AS (" + _per_event_field(
    "SELECT '{c}' AS field, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n FROM e") + "), "
    f"k AS (SELECT *, field IN {_CATEGORICAL} AS cat, field IN {_CATEGORICAL} AND n <= 40 AS low FROM u), "
    "j AS (SELECT *, NOT bool_or(low) OVER () AS none_low FROM k) "
    "SELECT field, 'missing treatment' AS role, missing > 0 AS eligible FROM j "
    "UNION ALL SELECT field, 'colour', cat AND n <= 20 FROM j UNION ALL SELECT field, 'kpi split', n <= 30 FROM j "
    "UNION ALL SELECT field, 'chart category', low OR (cat AND none_low) FROM j "
    "UNION ALL SELECT field, 'test group', n BETWEEN 2 AND 20 FROM j")
def _(spark, sf_dir):
    return quality.field_eligibility(gapped(spark, sf_dir))


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_PAIRS = list(combinations(_LINE_NUMBERS, 2))


@query("strongest_corr", "SELECT first, second, round(r, 3) AS correlation FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, corr({a}, {b}) AS r FROM lineitem" for a, b in _LINE_PAIRS)
    + ") ORDER BY abs(r) DESC, first, second LIMIT 4")
def _(spark, sf_dir):
    return quality.strongest_correlations(table(spark, sf_dir, "lineitem").select(*_LINE_NUMBERS))


_EVENT_NUMBERS = ("event_id", "user_id", "value")


@query("corr_matrix", GAPPED + " UNION ALL ".join(
    f"SELECT '{a}' AS field, " + ", ".join(
        "CAST(1.0 AS DOUBLE) AS " + b if a == b else f"round(corr({min(a, b)}, {max(a, b)}), 6) AS {b}" for b in _EVENT_NUMBERS)
    + " FROM e" for a in _EVENT_NUMBERS))
def _(spark, sf_dir):
    return rounded(quality.correlation_matrix(gapped(spark, sf_dir)), *_EVENT_NUMBERS)


@query("corr_matrix_by_blocks", ORACLES["corr_matrix"])
def _(spark, sf_dir):
    return rounded(quality.correlation_matrix(gapped(spark, sf_dir), wide=True), *_EVENT_NUMBERS)


# A wide table of lines: a bit of each key in turn, with gaps, beside the measures.
_WIDE = {f"b{k}": ("l_orderkey", "l_partkey", "l_suppkey")[k % 3] for k in range(44)}
_WIDE_SQL = ("WITH w AS (SELECT " + ", ".join(
    f"CASE WHEN l_linenumber <> {k % 7 + 1} THEN l_quantity * (({c} >> {k % 11}) & 3) END AS {n}"
    for k, (n, c) in enumerate(_WIDE.items())) + ", l_extendedprice, l_discount FROM lineitem), "
    "c AS (SELECT " + ", ".join(
        f"corr({a}, {b}) AS {a}__{b}" for a, b in combinations([*_WIDE, "l_extendedprice", "l_discount"], 2)) + " FROM w), "
    "p AS (UNPIVOT c ON * INTO NAME pair VALUE r) ")


@query("corr_pairs_wide", _WIDE_SQL + "SELECT split_part(pair, '__', 1) AS first, split_part(pair, '__', 2) AS second, "
       "round(r, 6) AS r FROM p")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    bits = [
        F.when(F.col("l_linenumber") != k % 7 + 1,
               F.col("l_quantity") * F.shiftright(c, k % 11).bitwiseAND(F.lit(3))).alias(n)
        for k, (n, c) in enumerate(_WIDE.items())
    ]
    return rounded(quality.correlation_pairs(lines.select(*bits, "l_extendedprice", "l_discount")), "r")


@query("report_tables", f"{_FACTORS}, d AS (" + " UNION ALL ".join(_description(f, 6) for f in ("user_id", "value")) + ") "
       "SELECT 'overview' AS section, CAST(NULL AS VARCHAR) AS field, 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM m "
       "UNION ALL SELECT 'overview', NULL, 'columns', 3 UNION ALL SELECT 'overview', NULL, 'duplicates', n - kept FROM m "
       "UNION ALL SELECT 'overview', NULL, 'numeric fields', 2 UNION ALL SELECT 'overview', NULL, 'categorical fields', 1 "
       "UNION ALL SELECT 'overview', NULL, 'date fields', 0 "
       "UNION ALL SELECT 'quality', NULL, 'score', round_even(100 * (0.55 * completeness + 0.30 * row_uniqueness + 0.15 * column_usefulness), 0) FROM f "
       "UNION ALL SELECT 'quality', NULL, 'completeness', round(completeness, 6) FROM f "
       "UNION ALL SELECT 'quality', NULL, 'row uniqueness', round(row_uniqueness, 6) FROM f "
       "UNION ALL SELECT 'quality', NULL, 'column usefulness', round(column_usefulness, 6) FROM f "
       + "".join(f"UNION ALL SELECT 'missing', '{c}', 'count', count(*) - count({c}) FROM e HAVING count(*) > count({c}) "
                 f"UNION ALL SELECT 'missing', '{c}', 'percent', round((count(*) - count({c})) / count(*) * 100, 6) FROM e "
                 f"HAVING count(*) > count({c}) " for c in ("event_type", "value"))
       + "".join(f"UNION ALL SELECT 'numeric', field, '{s}', \"{s}\" FROM d "
                 for s in ("count", "mean", "std", "min", "25%", "50%", "75%", "max")))
def _(spark, sf_dir):
    report = quality.report_tables(_narrow(spark, sf_dir), digits=6)
    settled = F.when(F.col("section") == "numeric", F.col("value")).otherwise(F.round("value", 6))
    return report.withColumn("value", settled)


@query("dataset_summary", ORACLES["report_tables"]
       + " UNION ALL SELECT 'correlation', 'user_id', 'value', round(corr(user_id, value), 3) FROM e"
       + " UNION ALL SELECT 'distinct', 'event_type', 'values', count(DISTINCT event_type) FROM e"
       + " UNION ALL SELECT * FROM (SELECT 'top value', 'event_type', event_type, CAST(count(*) AS DOUBLE) FROM e "
       "WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 2)")
def _(spark, sf_dir):
    summary = quality.dataset_summary(_narrow(spark, sf_dir), digits=6, top=2)
    settled = F.when(F.col("section") == "numeric", F.col("value")).otherwise(F.round("value", 6))
    return summary.withColumn("value", settled)


# --- Chart tables -------------------------------------------------------------

_BY_BRAND = "FROM (SELECT coalesce(p_brand, '(Missing)') AS p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS p_retailprice FROM part GROUP BY 1)"
for _name, _make, _order in [
    ("chart_category", charts.category_table, "p_retailprice DESC, p_brand LIMIT 12"),
    ("chart_radar", charts.radar_table, "p_retailprice DESC, p_brand LIMIT 12"),
    ("chart_waterfall", charts.waterfall_table, "p_retailprice DESC, p_brand LIMIT 15"),
]:
    @query(_name, f"SELECT p_brand, p_retailprice {_BY_BRAND} ORDER BY {_order}")
    def _(spark, sf_dir, make=_make):
        return as_double(make(money(table(spark, sf_dir, "part"), "p_retailprice"), "p_brand", "p_retailprice", "Sum"), "p_retailprice")


@query("chart_pie", f"{GAPPED} SELECT coalesce(event_type, '(Missing)') AS event_type, count(*) AS \"Records\" FROM e GROUP BY 1")
def _(spark, sf_dir):
    return charts.pie_table(gapped(spark, sf_dir), "event_type")


@query("chart_stacked", f"{GAPPED}, t AS (SELECT coalesce(event_type, '(Missing)') AS event_type, CAST(user_id AS VARCHAR) AS user_id, "
       "count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, user_id, n AS \"Records\", "
       "round(n / sum(n) OVER (PARTITION BY event_type) * 100, 6) AS \"Share\" FROM t")
def _(spark, sf_dir):
    return rounded(charts.stacked_table(gapped(spark, sf_dir), "event_type", "user_id", share=True), "Share")


@query("chart_time", _calendar("Month", _SUM, "0").replace("o_orderpriority AS s", "1 AS s").replace("g.s AS o_orderpriority, ", ""))
def _(spark, sf_dir):
    orders = money(table(spark, sf_dir, "orders"), "o_totalprice")
    return as_double(timeseries.resample(orders, "o_orderdate", "o_totalprice", "Month", "sum"), "o_totalprice")


@query("chart_hierarchy", "SELECT o_orderstatus, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice "
       "FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    orders = money(table(spark, sf_dir, "orders"), "o_totalprice")
    return as_double(charts.hierarchy_table(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice"), "o_totalprice")


@query("chart_histogram", f"{GAPPED}, x AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM e), "
       "h AS (SELECT coalesce(event_type, '(Missing)') AS event_type, CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count "
       "FROM e, x WHERE value IS NOT NULL GROUP BY 1, 2) SELECT bin, round(lo + w * bin, 6) AS lower, round(lo + w * (bin + 1), 6) AS upper, "
       "event_type, count, round(count / (sum(count) OVER (PARTITION BY event_type) * w), 8) AS density FROM h, x")
def _(spark, sf_dir):
    bins = charts.histogram_table(gapped(spark, sf_dir), "value", 30, "event_type")
    return rounded(rounded(bins, "lower", "upper"), "density", digits=8)


_FENCES = (
    f"{GAPPED}, s AS (SELECT coalesce(event_type, '(Missing)') AS segment, value AS v FROM e WHERE value IS NOT NULL), "
    "b AS (SELECT segment, count(*) AS count, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
    "quantile_cont(v, 0.75) AS q3, max(v) AS max FROM s GROUP BY 1), "
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM b), "
    "o AS (SELECT s.segment, v FROM s JOIN f ON s.segment = f.segment WHERE v < lower_fence OR v > upper_fence) "
)
_BOX = ("q1", "median", "q3", "lower_fence", "upper_fence")
for _name, _small in [("chart_box", None), ("chart_box_by_cells", 0)]:
    @query(_name, _FENCES + "SELECT segment, count, min, max, " + ", ".join(f"round({c}, 6) AS {c}" for c in _BOX)
           + ", (SELECT count(*) FROM o WHERE o.segment = f.segment) AS outliers FROM f")
    def _(spark, sf_dir, small=_small):
        return rounded(charts.box_table(gapped(spark, sf_dir), "value", "event_type", small), *_BOX)


@query("chart_box_outliers", _FENCES + "SELECT segment, v AS value FROM o")
def _(spark, sf_dir):
    return charts.box_outliers(gapped(spark, sf_dir), "value", "event_type")


@query("chart_points", "SELECT o_totalprice, o_custkey, o_orderstatus, o_orderkey, CAST(o_totalprice AS DOUBLE) AS \"Bubble size\" FROM orders "
       "ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 5000")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return charts.point_table(orders, "o_totalprice", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey")


@query("evidence_sample", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 300")
def _(spark, sf_dir):
    return evidence_sample(table(spark, sf_dir, "part"), key="p_partkey")[0].select("p_partkey", "p_name", "p_brand")


# --- KPIs ---------------------------------------------------------------------

_BOARD = [
    {"name": "Revenue", "column": "o_totalprice", "aggregation": "sum", "target": 1e9, "prefix": "$", "suffix": "", "decimals": 2},
    {"name": "Orders", "column": "o_orderkey", "aggregation": "count", "target": None, "prefix": "", "suffix": " orders", "decimals": 0},
    {"name": "Largest", "column": "o_totalprice", "aggregation": "max", "target": 500000, "prefix": "", "suffix": "", "decimals": 2},
    {"name": "Typical", "column": "o_totalprice", "aggregation": "median", "target": 250000, "prefix": "", "suffix": "", "decimals": 3},
    {"name": "Margin", "column": "margin", "aggregation": "sum", "target": 1, "prefix": "", "suffix": "", "decimals": 1},
]


@query("kpi_board", "WITH k AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders, "
       "max(o_totalprice) AS largest, quantile_cont(o_totalprice, 0.5) AS typical FROM orders) "
       "SELECT 'Revenue' AS name, revenue AS value, CAST(1e9 AS DOUBLE) AS target, round(revenue - 1e9, 4) AS delta, "
       "format('${:,.2f}', revenue) AS display FROM k "
       "UNION ALL SELECT 'Orders', orders, NULL, NULL, format('{:,} orders', orders) FROM k "
       "UNION ALL SELECT 'Largest', largest, 500000, round(largest - 500000, 4), format('{:,.2f}', largest) FROM k "
       "UNION ALL SELECT 'Typical', typical, 250000, round(typical - 250000, 4), format('{:,.3f}', typical) FROM k "
       "UNION ALL SELECT 'Margin', NULL, 1, NULL, 'Unavailable' FROM k")
def _(spark, sf_dir):
    board = kpis.evaluate_kpis(money(table(spark, sf_dir, "orders"), "o_totalprice"), _BOARD)
    return rounded(board.drop("delta_display"), "delta", digits=4)


@query("kpi_breakdown", "SELECT p_brand, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1 "
       "ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 20")
def _(spark, sf_dir):
    definition = kpis.kpi_definition("Price", "p_retailprice", "mean")
    return rounded(kpis.kpi_breakdown(table(spark, sf_dir, "part"), definition, "p_brand"), "p_retailprice")


# --- Statistical tests --------------------------------------------------------


@query("mean_ci", f"{GAPPED} SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM e")
def _(spark, sf_dir):
    return rounded(hypothesis_tests.mean_interval_statistics(gapped(spark, sf_dir), "value"), "mean", "sem")


@query("welch", "WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), "
       "p AS (SELECT a.m - b.m AS effect, a.v / a.n AS x, b.v / b.n AS y, a.n AS na, b.n AS nb FROM g a, g b WHERE a.g = 'F' AND b.g = 'O') "
       "SELECT CAST(2 AS BIGINT) AS groups, 'F' AS first, 'O' AS second, round(effect / sqrt(x + y), 6) AS statistic, "
       "round((x + y) * (x + y) / (x * x / (na - 1) + y * y / (nb - 1)), 4) AS dof, round(effect, 6) AS effect FROM p")
def _(spark, sf_dir):
    found = hypothesis_tests.welch_statistics(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus")
    return rounded(rounded(found, "statistic", "effect"), "dof", digits=4)


@query("anova", f"{GAPPED}, g AS (SELECT user_id, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM e WHERE value IS NOT NULL GROUP BY 1 "
       "HAVING count(*) >= 2), t AS (SELECT sum(n * m) / sum(n) AS grand FROM g), s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, "
       "sum(n * (m - grand) ** 2) AS b, sum((n - 1) * v) AS w FROM g, t) "
       "SELECT k AS groups, n, round((b / (k - 1)) / (w / (n - k)), 6) AS statistic, k - 1 AS dof_between, n - k AS dof_within FROM s")
def _(spark, sf_dir):
    return rounded(hypothesis_tests.anova_statistics(gapped(spark, sf_dir), "value", "user_id"), "statistic")


def _chi_square(source: str, a: str, b: str, prefix: str = "") -> str:
    return (
        f"WITH {prefix} j AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), "
        "ra AS (SELECT a, sum(o) AS r FROM j GROUP BY 1), cb AS (SELECT b, sum(o) AS c FROM j GROUP BY 1), "
        "t AS (SELECT CAST(sum(o) AS DOUBLE) AS n, (SELECT count(*) FROM ra) AS nr, (SELECT count(*) FROM cb) AS nc FROM j), "
        "x AS (SELECT coalesce(o, 0) AS o, r * c / n AS e, nr, nc FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN j ON j.a = ra.a AND j.b = cb.b), "
        "s AS (SELECT sum(CASE WHEN nr = 2 AND nc = 2 THEN (abs(o - e) - least(0.5, abs(o - e))) ** 2 ELSE (o - e) ** 2 END / e) AS chi FROM x) "
        "SELECT CAST(n AS BIGINT) AS n, nr AS rows, nc AS columns, round(chi, 6) AS statistic, (nr - 1) * (nc - 1) AS dof, "
        "round(sqrt(chi / (n * greatest(least(nr, nc) - 1, 1))), 8) AS effect FROM s, t"
    )


for _name, _table, _a, _b, _prefix in [
    ("chi_square", "orders", "o_orderstatus", "o_orderpriority", ""),
    ("chi_square_sparse", "e", "event_type", "props", GAPPED.removeprefix("WITH ") + ","),
    ("chi_square_two_by_two", "w", "l_linestatus", "bulk",
     "w AS (SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS bulk FROM lineitem),"),
]:
    @query(_name, _chi_square(_table, _a, _b, _prefix))
    def _(spark, sf_dir, source=_table, a=_a, b=_b):
        if source == "e":
            df = gapped(spark, sf_dir)
        elif source == "w":
            df = table(spark, sf_dir, "lineitem").withColumn("bulk", F.when(F.col("l_quantity") > 25, "many").otherwise("few"))
        else:
            df = table(spark, sf_dir, source)
        found = hypothesis_tests.chi_square_statistics(df, a, b)
        return rounded(rounded(found, "statistic"), "effect", digits=8)


@query("pearson", "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS statistic FROM lineitem")
def _(spark, sf_dir):
    found = hypothesis_tests.pearson_statistics(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(found, "statistic", digits=8)


@query("csv_multiline", "SELECT doc_id, '<' || replace(coalesce(text, ''), '. ', '.' || chr(10) || '\"so\", ') || '>' AS note, n_chars FROM documents")
def _(spark, sf_dir):
    # Whole texts as cells with line ends, quotes and commas.
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    note = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit('.\n"so", '))
    write_csv(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<"), note, F.lit(">")).alias("note"), "n_chars"), path)
    return read_csv(spark, path)


def _t_tail(t: str, dof: str) -> str:
    """Both tails of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(dof)."""
    start = f"atan(abs({t}) / sqrt({dof}))"
    step = f"(least(pi() / 2 - 1e-12, {start} + 40 / sqrt({dof})) - {start}) / 4000"
    weight = "CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return (f"(SELECT 2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi()) * sum({weight} * "
            f"exp(({dof} - 1) * ln(cos({start} + k * {step})))) * ({step}) / 3 FROM range(4001) w(k))")


def _welch_sql(source: str, keys: str) -> str:
    """t, dof and effect of prices by line status, a row for each of ``keys``."""
    return (f"WITH g AS (SELECT {keys}, l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v "
            f"FROM {source} GROUP BY ALL), p AS (SELECT a.{keys.split()[-1]}, a.m - b.m AS effect, a.v / a.n AS x, b.v / b.n AS y, "
            f"a.n AS na, b.n AS nb FROM g a JOIN g b USING ({keys.split()[-1]}) WHERE a.g = 'F' AND b.g = 'O') "
            "SELECT *, na + nb AS n, effect / sqrt(x + y) AS t, (x + y) ** 2 / (x * x / (na - 1) + y * y / (nb - 1)) AS dof FROM p")


def _anova_sql(keys: str) -> str:
    key = keys.split()[-1]
    return (f"WITH g AS (SELECT {keys}, l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v "
            f"FROM lineitem GROUP BY ALL), t AS (SELECT {key}, sum(n * m) / sum(n) AS grand FROM g GROUP BY ALL) "
            f"SELECT {key}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS DOUBLE) - 3 AS within, "
            "(sum(n * (m - grand) ** 2) / 2) / (sum((n - 1) * v) / (sum(n) - 3)) AS f FROM g JOIN t "
            f"USING ({key}) GROUP BY ALL")


# With two degrees between the groups, the upper tail of F has a closed form; chi-square has one for even degrees.
_F_TAIL = "pow(within / (within + 2 * f), within / 2)"


def _chi_sql(source: str, keys: str, first: str, second: str) -> str:
    key = keys.split()[-1]
    return (f"WITH c AS (SELECT {keys}, {first} AS a, {second} AS b, count(*) AS o FROM {source} GROUP BY ALL), "
            f"m AS (SELECT *, sum(o) OVER (PARTITION BY {key}, a) AS ra, sum(o) OVER (PARTITION BY {key}, b) AS cb, "
            f"sum(o) OVER (PARTITION BY {key}) AS total FROM c) SELECT {key}, CAST(max(total) AS BIGINT) AS n, "
            "max(total) * (sum(o * o / (ra * cb)) - 1) AS chi FROM m GROUP BY ALL")


_TESTED = "round(statistic, 6) AS statistic, round(pvalue, 7) AS pvalue, pvalue < 0.05 AS significant, round(effect, 6) AS effect"


def _tested(results: DataFrame) -> DataFrame:
    told = rounded(rounded(results, "statistic", "effect"), "pvalue", digits=7)
    return told.drop("dof", "dof_within", "confidence")


@query("test_results",
       f"WITH welch AS ({_welch_sql('lineitem', '1 AS one')}), anova AS ({_anova_sql('1 AS one')}), "
       f"chi AS ({_chi_sql('orders', '1 AS one', 'o_orderstatus', 'o_orderpriority')}), "
       "r AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem), "
       f"k AS (SELECT 'Welch''s t-test' AS name, n, t AS statistic, {_t_tail('t', 'dof')} AS pvalue, effect FROM welch "
       f"UNION ALL SELECT 'One-way ANOVA', n, f, {_F_TAIL}, NULL FROM anova "
       "UNION ALL SELECT 'Chi-square association test', n, chi, exp(-chi / 2) * (1 + chi / 2 + chi ** 2 / 8 + chi ** 3 / 48), "
       "sqrt(chi / (n * 2)) FROM chi "
       f"UNION ALL SELECT 'Pearson correlation test', n, r, {_t_tail('r * sqrt((n - 2) / (1 - r * r))', '(n - 2.0)')}, r FROM r) "
       f"SELECT name, n, {_TESTED} FROM k")
def _(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return _tested(segment_tests.tests_together([
        segment_tests.segment_tests(lines, hypothesis_tests.TWO_GROUPS, [], "l_extendedprice", "l_linestatus"),
        segment_tests.segment_tests(lines, hypothesis_tests.MANY_GROUPS, [], "l_extendedprice", "l_returnflag"),
        segment_tests.segment_tests(orders, hypothesis_tests.ASSOCIATION, [], None, "o_orderstatus", "o_orderpriority"),
        segment_tests.segment_tests(lines, hypothesis_tests.RELATIONSHIP, [], "l_quantity", None, "l_extendedprice"),
    ]))


for _name, _test, _columns, _sql in [
    ("welch_by_segment", hypothesis_tests.TWO_GROUPS, ("l_extendedprice", "l_linestatus", None),
     f"WITH k AS (SELECT *, t AS statistic, {_t_tail('t', 'dof')} AS pvalue, 'Welch''s t-test' AS name FROM ("
     + _welch_sql("lineitem", "l_linenumber") + "))"),
    ("anova_by_segment", hypothesis_tests.MANY_GROUPS, ("l_extendedprice", "l_returnflag", None),
     f"WITH k AS (SELECT *, f AS statistic, {_F_TAIL} AS pvalue, 'One-way ANOVA' AS name, CAST(NULL AS DOUBLE) AS effect FROM ("
     + _anova_sql("l_linenumber") + "))"),
    ("association_by_segment", hypothesis_tests.ASSOCIATION, (None, "l_returnflag", "l_linestatus"),
     "WITH k AS (SELECT *, chi AS statistic, exp(-chi / 2) AS pvalue, 'Chi-square association test' AS name, sqrt(chi / n) AS effect FROM ("
     + _chi_sql("lineitem", "l_linenumber", "l_returnflag", "l_linestatus") + "))"),
    ("relationship_by_segment", hypothesis_tests.RELATIONSHIP, ("l_discount", None, "l_tax"),
     "WITH k AS (SELECT *, r AS statistic, r AS effect, 'Pearson correlation test' AS name, "
     + _t_tail("r * sqrt((n - 2) / (1 - r * r))", "(n - 2.0)") + " AS pvalue FROM (SELECT l_linenumber, count(*) AS n, "
     "corr(l_discount, l_tax) AS r FROM lineitem GROUP BY 1))"),
]:
    @query(_name, f"{_sql} SELECT l_linenumber, name, n, {_TESTED} FROM k")
    def _(spark, sf_dir, test=_test, columns=_columns):
        return _tested(segment_tests.segment_tests(table(spark, sf_dir, "lineitem"), test, ["l_linenumber"], *columns))


# --- Models -------------------------------------------------------------------

_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_KEY, "l_quantity", "l_extendedprice", "l_discount")
    return detect_anomalies(lines, ["l_quantity", "l_extendedprice", "l_discount"], 0.05, key=_LINE_KEY)


@query("anomalies")
def _(spark, sf_dir):
    return _flagged(spark, sf_dir)


@query("top_anomalies")
def _(spark, sf_dir):
    return top_anomalies(_flagged(spark, sf_dir))


@query("segments")
def _(spark, sf_dir):
    return segment_rows(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], 4)[0]


@query("segment_profiles")
def _(spark, sf_dir):
    return segment_rows(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], 4)[1]


@query("forecast")
def _(spark, sf_dir):
    return forecast_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", 6, "Month")[1]


@query("forecast_many")
def _(spark, sf_dir):
    return forecast_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", 6, "Month", ["o_orderpriority"])[1]


@query("forecast_history", _calendar("Month", _SUM, "0").replace("o_orderpriority AS s", "1 AS s").replace(
    "g.s AS o_orderpriority, ", "").replace("AS o_totalprice", "AS value"))
def _(spark, sf_dir):
    orders = money(table(spark, sf_dir, "orders"), "o_totalprice")
    return forecast_series(orders, "o_orderdate", "o_totalprice", 6, "Month")[0]


# Models on tables whose answer is known: planted outliers, clouds far apart, a straight line.


@query("anomalies_planted", "SELECT count(*) AS rows, count(*) FILTER (l_discount <> 0.05) AS scored, "
       "count(*) FILTER (l_orderkey % 997 = 0 AND l_discount <> 0.05) AS planted_and_flagged, CAST(0 AS BIGINT) AS flagged_without_score FROM lineitem")
def _(spark, sf_dir):
    far = F.when(F.col("l_orderkey") % 997 == 0, 1000).otherwise(1)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") * far).alias("quantity"),
        F.when(F.col("l_discount") != F.lit("0.05").cast("decimal(4,2)"), F.col("l_extendedprice").cast("double") * far).alias("price"))
    flagged = detect_anomalies(lines, ["quantity", "price"], 0.02, key=["l_orderkey", "l_linenumber"])
    scored, planted = F.col("anomaly_score").isNotNull(), F.col("l_orderkey") % 997 == 0
    return flagged.agg(
        F.count("*").alias("rows"), F.count_if(scored).alias("scored"),
        F.count_if(F.col("anomaly") & planted).alias("planted_and_flagged"),
        F.count_if(F.col("anomaly") & ~scored).alias("flagged_without_score"))


@query("segments_planted", "SELECT c_nationkey % 3 AS cloud, count(*) AS rows, CAST(1 AS BIGINT) AS segments, "
       "round(avg(CAST(c_acctbal AS DOUBLE)), 4) AS balance FROM customer GROUP BY 1")
def _(spark, sf_dir):
    cloud, balance = F.col("c_nationkey") % 3, F.col("c_acctbal").cast("double")
    customers = table(spark, sf_dir, "customer").select(
        cloud.alias("cloud"), balance.alias("balance"), (cloud * 1e6 + balance).alias("x"), (cloud * -2e6 - balance).alias("y"))
    found = segment_rows(customers, ["x", "y"], 3)[0]
    return rounded(found.groupBy("cloud").agg(
        F.count("*").alias("rows"), F.countDistinct("segment").alias("segments"), F.avg("balance").alias("balance")), "balance", digits=4)


@query("forecast_line", "WITH m AS (SELECT min(date_trunc('month', o_orderdate)) AS a, max(date_trunc('month', o_orderdate)) AS b FROM orders) "
       "SELECT CAST(last_day(b + to_months(CAST(h AS INTEGER))) AS DATE) AS month, "
       "CAST(100 + 5 * (date_diff('month', a, b) + h) AS DOUBLE) AS forecast FROM m, range(1, 4) r(h)")
def _(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    first = months.agg(F.min("month")).scalar()
    line = months.withColumn("value", 100 + 5 * F.round(F.months_between("month", first)))
    return rounded(forecast_series(line, "month", "value", 3, "Month")[1].select("month", "forecast"), "forecast", digits=3)


# --- Recipes ------------------------------------------------------------------

REVENUE_RECIPE = [
    operation_record("calculated", "Revenue", {"name": "revenue", "expression": "l_extendedprice * (1 - l_discount)"}),
    operation_record("filter", "Bulk lines", {"column": "l_quantity", "operator": "at least", "value": "10"}),
    operation_record("group", "By return flag", {"groups": ["l_returnflag"], "values": ["revenue"], "aggregation": "sum"}),
]


@query("recipe_revenue", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem "
       "WHERE l_quantity >= 10 GROUP BY 1")
def _(spark, sf_dir):
    return rounded(replay_recipe(table(spark, sf_dir, "lineitem"), REVENUE_RECIPE)[0], "revenue", digits=2)


_EVENT_RECIPE = [
    operation_record("missing", "Fill value", {"column": "value", "method": "Median"}),
    operation_record("missing", "Fill type", {"column": "event_type", "method": "Mode"}),
    operation_record("join", "Needs a companion", {"how": "left"}),
    operation_record("outliers", "Cap value", {"column": "value", "method": "Cap values", "factor": 1.5}),
    operation_record("deduplicate", "One per user", {"subset": ["user_id", "event_type"], "keep": "last", "order_by": "event_id"}),
    operation_record("filter", "Fit for no field", {"column": "absent", "operator": "equals", "value": "x"}),
    operation_record("melt", "To long", {"id_vars": ["event_id", "event_type"], "value_vars": ["value"]}),
]
_REPLAYED = (
    f"{GAPPED}, a AS (SELECT event_id, user_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)) AS value, "
    "coalesce(event_type, (SELECT event_type FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM e), "
    "q AS (SELECT quantile_cont(value, 0.25) AS x, quantile_cont(value, 0.75) AS y FROM a), "
    "c AS (SELECT event_id, user_id, event_type, greatest(least(value, y + 1.5 * (y - x)), x - 1.5 * (y - x)) AS value FROM a, q), "
    "d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) "
)


@query("recipe_replay", _REPLAYED + "SELECT event_id, event_type, 'value' AS measure, round(value, 6) AS value FROM d")
def _(spark, sf_dir):
    return rounded(replay_recipe(gapped(spark, sf_dir), _EVENT_RECIPE)[0], "value")


@query("recipe_undo", _REPLAYED + "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM d")
def _(spark, sf_dir):
    undone = undo(gapped(spark, sf_dir), _EVENT_RECIPE, 2)[0]
    return rounded(undone.select("event_id", "user_id", "event_type", "value"), "value")


# Labels follow the centres: the clouds of customers lie apart in x, every seventh has no x.
_CLOUDS = ("WITH c AS (SELECT c_custkey, c_nationkey % 4 + 1 AS cloud, CAST(c_acctbal AS DOUBLE) AS balance, "
           "CASE WHEN c_custkey % 7 <> 0 THEN (c_nationkey % 4) * 1e6 + CAST(c_acctbal AS DOUBLE) END AS x FROM customer) ")


def _clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance, cloud = F.col("c_acctbal").cast("double"), F.col("c_nationkey") % 4
    return table(spark, sf_dir, "customer").select(
        "c_custkey", balance.alias("balance"),
        F.when(F.col("c_custkey") % 7 != 0, cloud * 1e6 + balance).alias("x"))


@query("segments_labelled", _CLOUDS + "SELECT c_custkey, CASE WHEN x IS NOT NULL THEN CAST(cloud AS INTEGER) END AS segment FROM c")
def _(spark, sf_dir):
    return segment_rows(_clouds(spark, sf_dir), ["x"], 4)[0].select("c_custkey", "segment")


@query("segment_profiles_labelled", _CLOUDS + "SELECT CAST(cloud AS INTEGER) AS segment, round(avg(x), 2) AS x, count(*) AS rows "
       "FROM c WHERE x IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return rounded(segment_rows(_clouds(spark, sf_dir), ["x"], 4)[1], "x", digits=2)


@query("recipe_segments_labelled", _CLOUDS + "SELECT CAST(cloud AS INTEGER) AS segment, count(balance) AS balance FROM c "
       "WHERE x IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    steps = [
        operation_record("missing", "Rows with x", {"column": "x", "method": "Drop rows"}),
        operation_record("segment", "Segment customers", {"columns": ["x"], "clusters": 4}),
        operation_record("group", "By segment", {"groups": ["segment"], "values": ["balance"], "aggregation": "count"}),
    ]
    return replay_recipe(_clouds(spark, sf_dir), steps)[0]


@query("recipe_join", "SELECT n_name, count(c_acctbal) AS c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf_dir):
    steps = [
        operation_record("join", "Name the nation", {
            "left_on": "c_nationkey", "right_on": "n_nationkey", "how": "left", "companion": "nation"}),
        operation_record("group", "By nation", {"groups": ["n_name"], "values": ["c_acctbal"], "aggregation": "count"}),
    ]
    return replay_recipe(table(spark, sf_dir, "customer"), steps, {"nation": table(spark, sf_dir, "nation")})[0]


@query("recipe_segments")
def _(spark, sf_dir):
    steps = [operation_record("segment", "Segment customers", {"columns": ["c_acctbal", "c_nationkey"], "clusters": 3})]
    return replay_recipe(table(spark, sf_dir, "customer"), steps)[0]


_TEN_STEPS = [
    operation_record("outliers", f"Step {k}", {"column": c, "method": "Remove rows", "factor": f})
    for k, (c, f) in enumerate([("l_extendedprice", 0.9), ("l_quantity", 0.5), ("l_extendedprice", 0.8), ("l_quantity", 0.4),
                                ("l_extendedprice", 0.7), ("l_quantity", 0.3), ("l_extendedprice", 0.6), ("l_quantity", 0.2),
                                ("l_extendedprice", 0.5), ("l_quantity", 0.1)])
]


def _ten_steps_sql() -> str:
    sql = "WITH s0 AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem)"
    for k, step in enumerate(_TEN_STEPS):
        column, factor = step["params"]["column"], step["params"]["factor"]
        low, high = (f"(SELECT quantile_cont(CAST({column} AS DOUBLE), {q}) FROM s{k})" for q in (0.25, 0.75))
        sql += (f", s{k + 1} AS (SELECT * FROM s{k} WHERE {column} BETWEEN {low} - {factor} * ({high} - {low}) "
                f"AND {high} + {factor} * ({high} - {low}))")
    return sql + " SELECT l_orderkey, l_linenumber FROM s10"


@query("recipe_ten_steps", _ten_steps_sql())
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return replay_recipe(lines, _TEN_STEPS)[0].select("l_orderkey", "l_linenumber")


# --- Files --------------------------------------------------------------------


@query("csv_ingest", "SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS order_date, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END "
       "AS total_price, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority, o_orderstatus = 'O' AS open FROM orders")
def _(spark, sf_dir):
    # The cluster's shared folder holds the written file.
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    status = F.col("o_orderstatus")
    write_csv(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" Order-Key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.when(status != "P", F.col("o_totalprice").cast("string")).otherwise("N/A").alias("Total  Price"),
        F.when(status != "F", F.col("o_orderpriority")).alias("priority"),
        F.when(status == "O", "True").otherwise("False").alias("Open"),
    ), path)
    return read_csv(spark, path).withColumn("order_date", F.to_date("order_date"))


@query("csv_many_files", "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderpriority AS priority FROM orders")
def _(spark, sf_dir):
    # Two sets of files, with their fields in different orders.
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Order-Key"), F.col("o_totalprice").cast("string").alias("Total Price"),
        F.col("o_orderpriority").alias("priority"))
    write_csv(orders.filter(F.col("`Order-Key`") % 2 == 0), f"{path}/even")
    write_csv(orders.filter(F.col("`Order-Key`") % 2 != 0).select("priority", "`Order-Key`", "`Total Price`"), f"{path}/odd")
    return read_csv(spark, f"{path}/*")
