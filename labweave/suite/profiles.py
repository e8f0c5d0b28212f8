"""Queries over aggregates, windows, ranks and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from labweave.fixed_values import NORMAL_CENTRE, NORMAL_MIDDLE, NORMAL_TAIL
from labweave.operators import density, metrics, profile, quantiles, rows, surfaces
from labweave.suite.common import GAPS_SQL, gappy_lineitem, query, r, table

NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS name_i, '{b}' AS name_j, round(corr({a}, {b}), 6) + 0.0 AS corr, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM g"
    for i, a in enumerate(NUMERIC)
    for b in NUMERIC[i + 1 :]
)


@query("a1_pairwise_correlation", f"WITH g AS ({GAPS_SQL}) {CORR_SQL}")
def a1(spark, sf):
    return profile.correlation_matrix(gappy_lineitem(spark, sf), NUMERIC).withColumn("corr", r("corr"))


WIDE = [*NUMERIC, "l_linenumber", *[f"{a}_x_{b}" for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]]]
WIDE_SQL = "SELECT *, " + ", ".join(f"{a} * {b} AS {a}_x_{b}" for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]) + f" FROM ({GAPS_SQL})"
WIDE_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS name_i, '{b}' AS name_j, round(corr({a}, {b}), 6) + 0.0 AS corr, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM g"
    for i, a in enumerate(WIDE)
    for b in WIDE[i + 1 :]
)


@query("a1_wide_correlation", f"WITH g AS ({WIDE_SQL}) {WIDE_CORR_SQL}")
def a1_wide(spark, sf):
    """Fifteen columns, 105 pairs: the one-scan matrix form."""
    products = {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]}
    return profile.correlation_matrix(gappy_lineitem(spark, sf).withColumns(products), WIDE).withColumn("corr", r("corr"))


FLAT = {"flat": "3.1", "gone": "CASE WHEN l_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END", "tail": "CASE WHEN l_orderkey % 7 = 0 THEN 0.7 ELSE l_tax END"}
FLAT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "flat", "gone", "l_tax", "tail"]


def _flat_sql(columns) -> str:
    held = {c: f"CASE WHEN NOT isnan({c}) THEN {c} END" for c in columns}
    return " UNION ALL ".join(
        f"SELECT {len(columns)} AS width, '{a}' AS name_i, '{b}' AS name_j, CASE WHEN '{a}' <> 'flat' AND '{b}' <> 'flat' THEN round(corr({held[a]}, {held[b]}), 6) + 0.0 END AS corr, "
        f"count({held[a]} + {held[b]}) AS n FROM g"
        for i, a in enumerate(columns) for b in columns[i + 1 :]
    )


@query(
    "a1_flat_and_missing",
    "WITH g AS (SELECT * REPLACE (CAST(l_linenumber AS DOUBLE) AS l_linenumber), CAST(l_tax * l_tax AS DOUBLE) AS l_square, "
    + ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, v in FLAT.items()) + f" FROM lineitem) {_flat_sql(FLAT_COLUMNS)} UNION ALL {_flat_sql([*FLAT_COLUMNS, 'l_square'])}",
)
def a1_flat(spark, sf):
    """A constant column and one with NaN, among eight columns and among nine: the same pairs have the same correlation."""
    rows = table(spark, sf, "lineitem").withColumns({**{c: F.expr(v).cast("double") for c, v in FLAT.items()}, "l_square": F.col("l_tax") * F.col("l_tax")})
    parts = [profile.correlation_matrix(rows, columns).withColumn("width", F.lit(len(columns))) for columns in (FLAT_COLUMNS, [*FLAT_COLUMNS, "l_square"])]
    return parts[0].unionByName(parts[1]).withColumn("corr", r("corr"))


@query(
    "a2_null_counts",
    f"WITH g AS ({GAPS_SQL}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM g" for c in ("l_discount", "l_tax", "l_quantity")),
)
def a2(spark, sf):
    return profile.null_counts(gappy_lineitem(spark, sf), ["l_discount", "l_tax", "l_quantity"])


@query(
    "a3_distinct",
    f"""WITH g AS ({GAPS_SQL})
        SELECT 'l_discount' AS "column", CAST(l_discount AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS n_distinct FROM (SELECT DISTINCT l_discount FROM g)
        UNION ALL SELECT 'l_tax', NULL, count(DISTINCT l_tax) FROM g UNION ALL SELECT 'l_orderkey', NULL, count(DISTINCT l_orderkey) FROM g""",
)
def a3(spark, sf):
    g = gappy_lineitem(spark, sf)
    values = profile.distinct_values(g, "l_discount").select(
        F.lit("l_discount").alias("column"), F.col("l_discount").cast("string").alias("value"), F.lit(None).cast("bigint").alias("n_distinct")
    )
    counts = profile.distinct_counts(g, ["l_tax", "l_orderkey"])
    return values.unionByName(counts.select("column", F.lit(None).cast("string").alias("value"), "n_distinct"))


@query(
    "a5_bounds",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) + 0.0 AS lo, CAST(max({c}) AS DOUBLE) + 0.0 AS hi FROM lineitem" for c in NUMERIC),
)
def a5(spark, sf):
    return profile.bounds(table(spark, sf, "lineitem"), NUMERIC).withColumns({"lo": F.col("lo") + 0.0, "hi": F.col("hi") + 0.0})


@query(
    "a6_regression_metrics",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg((y - p) * (y - p)), 2) + 0.0 AS mse, round(sqrt(avg((y - p) * (y - p))), 5) + 0.0 AS rmse,
              round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) + 0.0 AS r2
       FROM (SELECT *, l_extendedprice AS y, 2000 * l_quantity AS p FROM lineitem) GROUP BY 1, 2""",
)
def a6(spark, sf):
    rows_ = table(spark, sf, "lineitem").withColumn("p", 2000 * F.col("l_quantity"))
    out = metrics.regression_metrics(rows_, "l_extendedprice", "p", ["l_returnflag", "l_linestatus"])
    return out.withColumns({"mse": r("mse", 2), "rmse": r("rmse", 5), "r2": r("r2")})


@query(
    "a7_score_summary",
    "SELECT l_linestatus, round(avg(l_discount), 6) + 0.0 AS mean_score, round(stddev_pop(l_discount), 6) + 0.0 AS std_score FROM lineitem GROUP BY 1",
)
def a7(spark, sf):
    out = metrics.score_summary(table(spark, sf, "lineitem"), "l_discount", ["l_linestatus"])
    return out.withColumns({"mean_score": r("mean_score"), "std_score": r("std_score")})


SCORES_SQL = """SELECT l_linestatus, l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE avg(l_discount) END AS r2,
 CASE WHEN l_suppkey % 5 = 1 THEN NULL ELSE avg(l_quantity) END AS rmse FROM lineitem GROUP BY 1, 2"""


@query(
    "a8_best_scores",
    f"""SELECT l_linestatus, round(max(r2), 6) + 0.0 AS best_r2, round(min(rmse), 6) + 0.0 AS best_rmse,
               arg_max(l_suppkey, round(r2, 9) - l_suppkey * 1e-12) AS best_at FROM ({SCORES_SQL}) GROUP BY 1""",
)
def a8(spark, sf):
    nan = F.lit(float("nan"))
    scores = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_suppkey").agg(
        F.avg("l_discount").alias("r2"), F.avg("l_quantity").alias("rmse")
    )
    scores = scores.withColumns(
        {
            "r2": F.when(F.col("l_suppkey") % 5 == 0, nan).otherwise(F.round("r2", 9) - F.col("l_suppkey") * 1e-12),
            "rmse": F.when(F.col("l_suppkey") % 5 == 1, nan).otherwise(F.col("rmse")),
        }
    )
    out = metrics.best_scores(scores, ["l_linestatus"], at="l_suppkey")
    return out.withColumns({"best_r2": r("best_r2"), "best_rmse": r("best_rmse")})


def bin_sql(value: str, lo: str, hi: str, bins: int = 5) -> str:
    above = " + ".join(f"CASE WHEN {value} > {lo} + {float(i)} * (({hi} - {lo}) / {float(bins)}) THEN 1 ELSE 0 END" for i in range(1, bins))
    return f"CAST(CASE WHEN {value} IS NULL THEN NULL WHEN {hi} = {lo} THEN {(bins + 1) // 2} ELSE 1 + {above} END AS INTEGER)"


PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "a10_bin_distribution",
    f"""WITH b AS (SELECT {bin_sql('l_quantity', 'lo', 'hi')} AS bin, l_extendedprice AS y FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)),
        q AS (SELECT bin, count(*) AS n, quantile_cont(y, {PROBS}) AS qs FROM b GROUP BY 1)
        SELECT bin, n, CAST(unnest({PROBS}) AS DOUBLE) AS p, round(unnest(qs), 4) + 0.0 AS quantile FROM q""",
)
def a10(spark, sf):
    out = profile.bin_distribution(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", PROBS)
    return out.withColumn("quantile", r("quantile", 4))


@query(
    "a10_bin_histogram",
    f"""SELECT bin, cell, count(*) AS n FROM (
          SELECT {bin_sql('l_quantity', 'lo', 'hi')} AS bin, {bin_sql('l_extendedprice', 'lo2', 'hi2', 10)} AS cell
          FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_extendedprice) AS lo2, max(l_extendedprice) AS hi2 FROM lineitem)) GROUP BY 1, 2""",
)
def a10_histogram(spark, sf):
    return profile.bin_histogram(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


PAIRS = ["l_quantity", "l_discount", "l_tax"]
BINNED_SQL = (
    "SELECT " + ", ".join(f"{bin_sql(c, f'lo{i}', f'hi{i}', 10)} AS b{i}" for i, c in enumerate(PAIRS))
    + f" FROM ({GAPS_SQL}), (SELECT " + ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(PAIRS)) + f" FROM ({GAPS_SQL}))"
)
PAIR_HIST_SQL = f"WITH b AS ({BINNED_SQL}) " + " UNION ALL ".join(
    f"SELECT '{PAIRS[i]}' AS name_i, '{PAIRS[j]}' AS name_j, b{i} AS bin_i, b{j} AS bin_j, count(*) AS n FROM b WHERE b{i} IS NOT NULL AND b{j} IS NOT NULL GROUP BY 3, 4"
    for i in range(3)
    for j in range(i, 3)
)


@query("a11_pair_histograms", PAIR_HIST_SQL)
def a11(spark, sf):
    return profile.pair_histograms(gappy_lineitem(spark, sf), PAIRS)


@query(
    "a11_kernel_density",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h, count(*) AS n FROM orders),
            g AS (SELECT CAST(i AS INTEGER) AS point, lo - 3 * h + i * ((hi - lo + 6 * h) / 49) AS x FROM s, range(50) t(i))
       SELECT point, round(x, 4) + 0.0 AS x, round(sum(exp(-0.5 * pow((x - o_totalprice) / h, 2))) / any_value(n) / any_value(h) / sqrt(2 * pi()) * 1e9, 1) + 0.0 AS density FROM g, s, orders GROUP BY point, x""",
)
def a11_density(spark, sf):
    """The density of the order price at 50 points; the SQL is the direct sum over all orders."""
    out = density.kernel_density(table(spark, sf, "orders"), "o_totalprice", points=50, resolution=2000)
    return out.select("point", r("x", 4).alias("x"), r(F.col("density") * 1e9, 1).alias("density"))


@query(
    "a12_bubble_table",
    f"""SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_discount IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY l_discount) END AS frequency FROM ({GAPS_SQL})""",
)
def a12(spark, sf):
    return profile.bubble_table(gappy_lineitem(spark, sf), "l_quantity", "l_extendedprice", "l_discount")


def normal_sql(p: str) -> str:
    def ratio(c, x):
        poly = lambda cs: f"({' + '.join(f'{v!r} * pow({x}, {len(cs) - 1 - i})' for i, v in enumerate(cs))})"
        return f"{poly(c[0])} / {poly(c[1])}"

    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(NORMAL_CENTRE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} "
        f"ELSE sign({p} - 0.5) * CASE WHEN {tail} <= 5 THEN {ratio(NORMAL_MIDDLE, f'({tail} - 1.6)')} ELSE {ratio(NORMAL_TAIL, f'({tail} - 5.0)')} END END"
    )


RESIDUAL_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 250000.0 ELSE o_totalprice END AS residual FROM orders"
QQ_SQL = f"""
SELECT o_orderkey, rank, residual AS ordered, {normal_sql('p')} AS theoretical FROM (
  SELECT *, CASE WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n) WHEN rank = n THEN pow(0.5, 1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END AS p FROM (
    SELECT *, row_number() OVER (ORDER BY residual, o_orderkey) AS rank, count(*) OVER () AS n FROM ({RESIDUAL_SQL})))"""


def residuals(spark, sf):
    """A third of all rows share one residual."""
    value = F.when(F.col("o_orderkey") % 3 == 0, 250000.0).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", value.alias("residual"))


@query("a13_normal_qq", f"SELECT o_orderkey, rank, ordered, round(theoretical, 8) + 0.0 AS theoretical FROM ({QQ_SQL})")
def a13(spark, sf):
    return metrics.normal_qq(residuals(spark, sf), "residual", "o_orderkey").withColumn("theoretical", r("theoretical", 8))


@query(
    "a13_qq_line",
    f"SELECT round(regr_slope(ordered, theoretical), 3) AS slope, round(regr_intercept(ordered, theoretical), 3) AS intercept, round(corr(ordered, theoretical), 6) AS r FROM ({QQ_SQL})",
)
def a13_line(spark, sf):
    out = metrics.qq_line(metrics.normal_qq(residuals(spark, sf), "residual", "o_orderkey"))
    return out.select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


@query(
    "a14_predicted_vs_actual",
    """WITH t AS (SELECT l_orderkey, l_extendedprice AS actual, 2000 * l_quantity AS predicted FROM lineitem)
       SELECT l_orderkey, actual, predicted, round(actual - predicted, 4) + 0.0 AS residual, e.line_lo, e.line_hi FROM t,
       (SELECT least(min(actual), min(predicted)) AS line_lo, greatest(max(actual), max(predicted)) AS line_hi FROM t) e""",
)
def a14(spark, sf):
    scored = table(spark, sf, "lineitem").withColumn("p", 2000 * F.col("l_quantity"))
    return metrics.predicted_vs_actual(scored, "l_extendedprice", "p", ["l_orderkey"]).withColumn("residual", r("residual", 4))


@query(
    "a15_response_surface",
    f"""SELECT bin_x, bin_y, round(avg(z), 6) + 0.0 AS z, count(*) AS n FROM (
          SELECT {bin_sql('l_quantity', 'lo', 'hi', 100)} AS bin_x, {bin_sql('l_discount', 'lo2', 'hi2', 100)} AS bin_y, sqrt(l_extendedprice) AS z
          FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_discount) AS lo2, max(l_discount) AS hi2 FROM lineitem)) GROUP BY 1, 2""",
)
def a15(spark, sf):
    rows_ = table(spark, sf, "lineitem").select("l_quantity", "l_discount", F.sqrt("l_extendedprice").alias("root"))
    return profile.response_surface(rows_, "l_quantity", "l_discount", "root").withColumn("z", r("z"))


@query(
    "a15_filled_surface",
    f"""WITH p AS (SELECT {bin_sql('l_quantity', 'lo', 'hi', 20)} AS bin_x, {bin_sql('l_extendedprice', 'lo2', 'hi2', 20)} AS bin_y, l_discount + l_tax * l_tax AS z,
            (l_quantity - lo) * 20 / (hi - lo) AS cx, (l_extendedprice - lo2) * 20 / (hi2 - lo2) AS cy
          FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_extendedprice) AS lo2, max(l_extendedprice) AS hi2 FROM lineitem)),
        c AS (SELECT bin_x, bin_y, avg(z) AS z, count(*) AS n, avg(cx) AS cx, avg(cy) AS cy FROM p GROUP BY 1, 2),
        e AS (SELECT CAST(i AS INTEGER) AS bin_x, CAST(j AS INTEGER) AS bin_y FROM range(1, 21) a(i), range(1, 21) b(j) WHERE (i, j) NOT IN (SELECT (bin_x, bin_y) FROM c)),
        d AS (SELECT e.bin_x, e.bin_y, z, pow(cx - e.bin_x + 0.5, 2) + pow(cy - e.bin_y + 0.5, 2) AS q FROM e, c
              QUALIFY row_number() OVER (PARTITION BY e.bin_x, e.bin_y ORDER BY q, c.bin_x, c.bin_y) <= 4)
        SELECT bin_x, bin_y, round(z, 6) + 0.0 AS z, n FROM c UNION ALL SELECT bin_x, bin_y, round(sum(z / q) / sum(1 / q), 6) + 0.0, 0 FROM d GROUP BY 1, 2""",
)
def a15_filled(spark, sf):
    """Every cell of a surface over two inputs that go together, so that many cells have no points of their own."""
    rows_ = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_discount") + F.col("l_tax") * F.col("l_tax")).alias("z"))
    return surfaces.filled_surface(rows_, "l_quantity", "l_extendedprice", "z", cells=20).withColumn("z", r("z"))


@query(
    "w1_frequency",
    f"SELECT l_orderkey, l_linenumber, l_tax, CASE WHEN l_tax IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY l_tax) END AS frequency FROM ({GAPS_SQL})",
)
def w1(spark, sf):
    return profile.with_frequency(gappy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_tax"), "l_tax")


@query(
    "w2_equal_width_bins",
    f"""SELECT l_orderkey, l_extendedprice, bin, round(lo + (bin - 1) * ((hi - lo) / 5.0) - CASE WHEN bin = 1 THEN (hi - lo) * 0.001 ELSE 0 END, 4) + 0.0 AS bin_lo,
               round(lo + bin * ((hi - lo) / 5.0), 4) + 0.0 AS bin_hi
        FROM (SELECT *, {bin_sql('l_extendedprice', 'lo', 'hi')} AS bin FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem))""",
)
def w2(spark, sf):
    out = profile.with_bin(table(spark, sf, "lineitem"), "l_extendedprice", 5, "b", interval=True)
    return out.select("l_orderkey", "l_extendedprice", "b.bin", r("b.lo", 4).alias("bin_lo"), r("b.hi", 4).alias("bin_hi"))


@query("w3_residual_rank", f"SELECT o_orderkey, residual, row_number() OVER (ORDER BY residual, o_orderkey) AS rank FROM ({RESIDUAL_SQL})")
def w3(spark, sf):
    return quantiles.with_global_rank(residuals(spark, sf), "residual", "o_orderkey")


@query("w4_row_ordinal", "SELECT event_id, value, row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS _row FROM events")
def w4(spark, sf):
    """Row numbers written at export, in time order."""
    timed = table(spark, sf, "events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    ranked = quantiles.with_global_rank(timed, "_t", "event_id", "_row")
    return ranked.select("event_id", "value", (F.col("_row") - 1).alias("_row"))


@query("t1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t1(spark, sf):
    return rows.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


@query(
    "t2_best_by_rank",
    """SELECT o_orderpriority, o_orderkey, cents FROM (
         SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cents, o_orderkey) AS n FROM (
           SELECT o_orderpriority, o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cents FROM orders)) WHERE n <= 20""",
)
def t2(spark, sf):
    ranked = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("cents"))
    return rows.best_by_rank(ranked, ["o_orderpriority"], "cents", "o_orderkey", 20)
