"""Queries over designs of experiments and sensitivity indices."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from labweave.fixed_values import QUASI_DESIGN
from labweave.operators import bootstrap, designs, sensitivity
from labweave.operators.profile import bounds
from labweave.plans.sensitivity import study
from labweave.suite.common import query, r, sql_hash, sql_sobol, table
from labweave.suite.profiles import bin_sql

FACTORIAL_SQL = """
WITH k AS (SELECT min(o_orderkey) AS lo, CAST(ceil((max(o_orderkey) + 5 - min(o_orderkey)) / 10.0) AS BIGINT) AS n FROM orders),
     l AS (SELECT min(l_linenumber) AS lo, CAST(ceil((max(l_linenumber) + 0.5 - min(l_linenumber)) / 1.0) AS BIGINT) AS n FROM lineitem),
     d AS (SELECT CAST(ceil((0.1 + 0.025) / 0.05) AS BIGINT) AS n)
SELECT (i * l.n + j) * d.n + m AS run, CAST(k.lo + i * 10.0 AS DOUBLE) AS o_orderkey, CAST(l.lo + j * 1.0 AS DOUBLE) AS l_linenumber,
       CAST(m * 0.05 AS DOUBLE) AS discount
FROM k, l, d, range(k.n) a(i), range(l.n) b(j), range(d.n) c(m)"""


@query("e1_full_factorial", FACTORIAL_SQL)
def e1(spark, sf):
    """Levels span the keys of the orders and the line numbers in use."""
    k = bounds(table(spark, sf, "orders"), ["o_orderkey"]).first()
    line = bounds(table(spark, sf, "lineitem"), ["l_linenumber"]).first()
    factors = {"o_orderkey": (k.lo, k.hi, 10), "l_linenumber": (line.lo, line.hi, 1), "discount": (0.0, 0.1, 0.05)}
    return designs.full_factorial(spark, factors)


POINTS_SQL = """
n AS (SELECT count(*) AS n FROM events),
i AS (SELECT event_id AS block_id, event_id + greatest(16, CAST(pow(2, ceil(log2(n))) AS BIGINT)) AS i FROM events, n),
g AS (SELECT block_id, xor(i, i >> 1) AS g FROM i)"""


def ab_sql(limits) -> str:
    d = len(limits)
    cols = []
    for j, (low, high) in enumerate(limits):
        cols.append(f"{float(low)!r} + {sql_sobol('g', j)} * {float(high - low)!r} AS a{j}")
        cols.append(f"{float(low)!r} + {sql_sobol('g', j + d)} * {float(high - low)!r} AS b{j}")
    return f"ab AS (SELECT block_id, {', '.join(cols)} FROM g)"


def picks(role: str, d: int) -> list[str]:
    if role in ("A", "B"):
        return [f"{role.lower()}{j}" for j in range(d)]
    main, other, at = role[0].lower(), role[1].lower(), int(role[3:]) - 1
    return [f"{other if j == at else main}{j}" for j in range(d)]


QUASI_TWO = {k: QUASI_DESIGN[k] for k in ("T", "P")}


def quasi_sql(factors) -> str:
    d = len(factors)
    return f"WITH {POINTS_SQL}, {ab_sql([v[:2] for v in factors.values()])} " + " UNION ALL ".join(
        f"SELECT block_id, {k} AS role_no, '{role}' AS role, "
        + ", ".join(
            f"least(greatest(round_even({x} / {step!r}, 0) * {step!r}, {float(low)!r}), {float(high)!r}) AS {name}"
            for x, (name, (low, high, step)) in zip(picks(role, d), ((n, tuple(map(float, v))) for n, v in factors.items()))
        )
        + " FROM ab"
        for k, role in enumerate(designs.role_names(d))
    )


def event_blocks(spark, sf):
    blocks = table(spark, sf, "events").select(F.col("event_id").alias("block_id"))
    return blocks, blocks.count()


@query("e2_saltelli_quantised", quasi_sql(QUASI_TWO))
def e2(spark, sf):
    """One block per event."""
    blocks, n = event_blocks(spark, sf)
    design = designs.saltelli_blocks(blocks, {k: v[:2] for k, v in QUASI_TWO.items()}, n)
    return designs.quantise_design(design, QUASI_TWO)


@query("e2_process_design", quasi_sql(QUASI_DESIGN))
def e2_process(spark, sf):
    """All four process factors, one block per event."""
    blocks, n = event_blocks(spark, sf)
    design = designs.saltelli_blocks(blocks, {k: v[:2] for k, v in QUASI_DESIGN.items()}, n)
    return designs.quantise_design(design, QUASI_DESIGN)


PI = 3.141592653589793
CUBE = {"x1": (-PI, PI), "x2": (-PI, PI), "x3": (-PI, PI)}
NAMES = list(CUBE)


def ishigami(x1, x2, x3):
    return F.sin(x1) + 7.0 * F.sin(x2) * F.sin(x2) + 0.1 * x3 * x3 * x3 * x3 * F.sin(x1)


def ishigami_sql(x1, x2, x3):
    return f"sin({x1}) + 7.0 * sin({x2}) * sin({x2}) + 0.1 * {x3} * {x3} * {x3} * {x3} * sin({x1})"


def product_sql(x1, x2, x3):
    return f"({x1} + 4) * ({x2} + 5) + {x3}"


def index_sql(outputs, resamples: int = 0) -> str:
    roles = designs.role_names(3)
    y = " UNION ALL ".join(
        f"SELECT '{name}' AS output, block_id, " + ", ".join(f"{f(*picks(role, 3))} AS {role}" for role in roles) + " FROM ab"
        for name, f in outputs.items()
    )
    every = f"SELECT output, unnest([{', '.join(roles)}]) AS v FROM y"
    z = "SELECT y.output, block_id, " + ", ".join(f"({role} - m) / s AS {role}" for role in roles) + " FROM y JOIN st ON y.output = st.output"
    mean = (lambda x: f"sum(({x}) * w) / sum(w)") if resamples else (lambda x: f"avg({x})")
    parts = [f"{mean('(A + B) / 2')} AS m", f"{mean('(A * A + B * B) / 2')} AS q", f"{mean('A * B')} AS ab"]
    for j in (1, 2, 3):
        parts += [f"{mean(f'B * (AB_{j} - A)')} AS f{j}", f"{mean(f'(A - AB_{j}) * (A - AB_{j})')} AS t{j}"]
    parts += [f"{mean(f'BA_{j} * AB_{k}')} AS s{j}_{k}" for j, k in combinations((1, 2, 3), 2)]
    keys = "output, resample" if resamples else "output"
    source = "z"
    if resamples:
        steps = " + ".join(f"CASE WHEN u > {s!r} THEN 1 ELSE 0 END" for s in sensitivity.POISSON_STEPS)
        hashed = sql_hash("block_id", "(resample + 42)")
        source = (
            f"(SELECT *, {steps} AS w FROM (SELECT *, ({hashed} + 0.5) / 2147483647.0 AS u FROM "
            f"(SELECT z.*, resample FROM z, range(1, {resamples + 1}) t(resample))))"
        )
    cells = [f"SELECT {keys}, 'S1' AS \"order\", '{NAMES[j - 1]}' AS factor_i, NULL AS factor_j, f{j} / v AS value FROM w" for j in (1, 2, 3)]
    cells += [f"SELECT {keys}, 'ST', '{NAMES[j - 1]}', NULL, 0.5 * t{j} / v FROM w" for j in (1, 2, 3)]
    cells += [
        f"SELECT {keys}, 'S2', '{NAMES[j - 1]}', '{NAMES[k - 1]}', (s{j}_{k} - ab) / v - f{j} / v - f{k} / v FROM w"
        for j, k in combinations((1, 2, 3), 2)
    ]
    head = (
        f"WITH {POINTS_SQL}, {ab_sql(CUBE.values())}, y AS ({y}), st AS (SELECT output, avg(v) AS m, stddev_pop(v) AS s FROM ({every}) GROUP BY 1), "
        f"z AS ({z}), w0 AS (SELECT {keys}, {', '.join(parts)} FROM {source} GROUP BY {keys}), w AS (SELECT *, q - m * m AS v FROM w0), "
        f"idx AS ({' UNION ALL '.join(cells)}) "
    )
    if resamples:
        return head + (
            'SELECT output, "order", factor_i, factor_j, round(1.959963984540054 * stddev_samp(value), 6) + 0.0 AS conf '
            'FROM idx GROUP BY output, "order", factor_i, factor_j'
        )
    return head + 'SELECT output, "order", factor_i, factor_j, round(value, 6) + 0.0 AS value FROM idx'


def simulated_runs(spark, sf):
    """Design rows with two outputs, as a process simulator would return them."""
    blocks, n = event_blocks(spark, sf)
    x = [F.col(c) for c in NAMES]
    design = designs.saltelli_blocks(blocks, CUBE, n)
    return design.withColumns({"y": ishigami(*x), "p": (x[0] + 4) * (x[1] + 5) + x[2]})


@query("e3_sobol_indices", index_sql({"y": ishigami_sql}))
def e3(spark, sf):
    table_ = sensitivity.standardise_blocks(sensitivity.block_table(simulated_runs(spark, sf), 3, ["y"]), 3)
    return sensitivity.sobol_indices(table_, NAMES).withColumn("value", r("value"))


@query("e4_bootstrap_widths", index_sql({"y": ishigami_sql}, 100))
def e4(spark, sf):
    table_ = sensitivity.standardise_blocks(sensitivity.block_table(simulated_runs(spark, sf), 3, ["y"]), 3)
    return sensitivity.bootstrap_widths(table_, NAMES).withColumn("conf", r("conf"))


@query(
    "e4_exact_draws",
    "SELECT CAST(i AS INTEGER) AS resample, n AS total, n AS blocks FROM (SELECT count(*) AS n FROM events), range(1, 101) t(i)",
)
def e4_draws(spark, sf):
    """Every one of 100 resamples draws exactly as many blocks as there are."""
    blocks, n = event_blocks(spark, sf)
    drawn = bootstrap.bootstrap_draws(blocks.select("block_id"), 100)
    return drawn.groupBy("resample").agg(F.sum("w").alias("total")).withColumn("blocks", F.lit(n).cast("bigint"))


@query("e5_all_outputs", index_sql({"y": ishigami_sql, "p": product_sql}))
def e5(spark, sf):
    return sensitivity.analyse_outputs(simulated_runs(spark, sf), NAMES, ["y", "p"]).withColumn("value", r("value"))


#: As many outputs as a process simulator writes, each with another weight of the third input.
MANY = {f"out{k}": (lambda x1, x2, x3, k=k: f"({x1} + 4) * ({x2} + 5) + {k} * {x3}") for k in range(25)}


def study_runs(spark, sf, n_outputs):
    blocks, n = event_blocks(spark, sf)
    x = [F.col(c) for c in NAMES]
    outputs = {f"out{k}": (x[0] + 4) * (x[1] + 5) + k * x[2] for k in range(n_outputs)}
    return designs.saltelli_blocks(blocks, CUBE, n).withColumns(outputs)


@query("plan_study_indices", index_sql(MANY))
def plan_study_indices(spark, sf):
    """Indices of 25 outputs in one study."""
    return study(study_runs(spark, sf, 25), NAMES, resamples=0)[0].withColumn("value", r("value"))


@query("plan_study_widths", index_sql(MANY).replace(' FROM idx', ', true AS has_width FROM idx'))
def plan_study_widths(spark, sf):
    """The whole study of 25 outputs: indices, and for each of them a width from 100 exact resamples."""
    out = study(study_runs(spark, sf, 25), NAMES)[0]
    return out.select("output", "order", "factor_i", "factor_j", r("value").alias("value"), F.coalesce(F.col("conf") >= 0, F.lit(False)).alias("has_width"))


def surfaces_sql(outputs) -> str:
    roles = designs.role_names(3)
    runs = " UNION ALL ".join("SELECT " + ", ".join(f"{x} AS {name}" for x, name in zip(picks(role, 3), NAMES)) + " FROM ab" for role in roles)
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NAMES)
    cells = ", ".join(f"{bin_sql(c, f'lo_{c}', f'hi_{c}', 100)} AS b_{c}" for c in NAMES)
    z = ", ".join(f"{f(*NAMES)} AS {name}" for name, f in outputs.items())
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS name_x, '{b}' AS name_y, b_{a} AS bin_x, b_{b} AS bin_y, '{o}' AS output, round(avg({o}), 6) + 0.0 AS z, count(*) AS n FROM s GROUP BY b_{a}, b_{b}"
        for a, b in combinations(NAMES, 2) for o in outputs
    )
    return f"WITH {POINTS_SQL}, {ab_sql(CUBE.values())}, runs AS ({runs}), s AS (SELECT {cells}, {z} FROM runs, (SELECT {ends} FROM runs)) {parts}"


@query("plan_study_surfaces", surfaces_sql({k: MANY[k] for k in ("out0", "out1")}))
def plan_study_surfaces(spark, sf):
    """Mean outputs over 100 x 100 cells of every pair of inputs."""
    return study(study_runs(spark, sf, 2), NAMES, resamples=0)[1].withColumn("z", r("z"))
