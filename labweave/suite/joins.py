"""Queries over lookups, pairs, products and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labweave.fixed_values import MATERIALS, METHODS
from labweave.operators import chemistry, combine, lookup
from labweave.suite.common import query, r, sql_values, table
from labweave.suite.sources import MEASUREMENT_SQL, measurement_documents

MATERIALS_SQL = f"(VALUES {sql_values(MATERIALS)}) m(material, formation_energy, density)"
METHODS_SQL = f"(VALUES {sql_values(METHODS)}) m(method, scalability, cost)"

# material and method names with blanks, unknown names and gaps
TYPED_SQL = """
SELECT l_orderkey,
       CASE l_suppkey % 6 WHEN 0 THEN ' Ni ' WHEN 1 THEN 'Co' WHEN 2 THEN 'Unobtainium' WHEN 3 THEN NULL WHEN 4 THEN 'CeO2 ' ELSE 'Al2O3' END AS active,
       CASE l_partkey % 4 WHEN 0 THEN 'La2O3' WHEN 1 THEN NULL WHEN 2 THEN 'SiO2' ELSE 'MgO ' END AS promoter,
       CASE l_linenumber WHEN 1 THEN 'IWI' WHEN 2 THEN ' CP ' WHEN 3 THEN 'MI' WHEN 4 THEN 'none' ELSE NULL END AS method
FROM lineitem"""


def typed_lineitem(spark, sf):
    def cases(key, texts):
        out = F.when(key == 0, texts[0])
        for i, text in enumerate(texts[1:], start=1):
            out = out.when(key == i, text)
        return out

    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        cases(F.col("l_suppkey") % 6, [" Ni ", "Co", "Unobtainium", F.lit(None), "CeO2 ", "Al2O3"]).alias("active"),
        cases(F.col("l_partkey") % 4, ["La2O3", F.lit(None), "SiO2", "MgO "]).alias("promoter"),
        F.when(n == 1, "IWI").when(n == 2, " CP ").when(n == 3, "MI").when(n == 4, "none").alias("method"),
    )


@query(
    "j1_material_lookup",
    f"""SELECT l_orderkey, active, promoter, coalesce(a.density, 0) AS active_density, coalesce(a.formation_energy, 0) AS active_energy,
               coalesce(p.density, 0) AS promoter_density, coalesce(p.formation_energy, 0) AS promoter_energy
        FROM ({TYPED_SQL}) t LEFT JOIN (SELECT material, CAST(formation_energy AS DOUBLE) AS formation_energy, CAST(density AS DOUBLE) AS density FROM {MATERIALS_SQL}) a
          ON trim(t.active) = a.material
        LEFT JOIN (SELECT material, CAST(formation_energy AS DOUBLE) AS formation_energy, CAST(density AS DOUBLE) AS density FROM {MATERIALS_SQL}) p ON trim(t.promoter) = p.material""",
)
def j1(spark, sf):
    dim = lookup.dimension(spark, MATERIALS, "material", ["formation_energy", "density"])
    roles = {k: {"density": f"{k}_density", "formation_energy": f"{k}_energy"} for k in ("active", "promoter")}
    return lookup.lookup_roles(typed_lineitem(spark, sf), dim, roles, "material", bounded=True).drop("method")


@query(
    "j2_method_lookup",
    f"SELECT l_orderkey, t.method, m.scalability, m.cost FROM ({TYPED_SQL}) t LEFT JOIN {METHODS_SQL} ON trim(t.method) = m.method",
)
def j2(spark, sf):
    dim = lookup.dimension(spark, METHODS, "method_name", ["scalability", "cost"])
    out = lookup.lookup(typed_lineitem(spark, sf), dim, "method", "method_name", {"scalability": "scalability", "cost": "cost"}, bounded=True)
    return out.select("l_orderkey", "method", "scalability", "cost")


FIRST_SQL = f"""
SELECT material, arg_min(e, doc) AS energy FROM (SELECT doc, material, coalesce(energy, 0.0) AS e FROM ({MEASUREMENT_SQL})
WHERE formula = 'CO' AND stable AND material <> '') GROUP BY 1"""


@query("a4_first_wins", FIRST_SQL)
def a4(spark, sf):
    return chemistry.first_energy(measurement_documents(spark, sf))


@query(
    "j3_derived_lookup",
    f"""SELECT event_id, key, coalesce(f.energy, 0.0) AS adsorption_energy, value
        FROM (SELECT event_id, event_type || '-' || CAST(user_id AS VARCHAR) AS key, value FROM events) e LEFT JOIN ({FIRST_SQL}) f ON e.key = f.material""",
)
def j3(spark, sf):
    key = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    rows = table(spark, sf, "events").select("event_id", key.alias("key"), "value")
    energies = chemistry.first_energy(measurement_documents(spark, sf))
    return lookup.lookup_after(rows, energies, "key", "material", "energy", "adsorption_energy")


PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}


@query(
    "j4_reverse_names",
    """SELECT o_orderkey, o_orderpriority AS feature,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' END AS full_name FROM orders""",
)
def j4(spark, sf):
    names = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("feature"))
    matched, unmatched = lookup.unmap_names(names, PRIORITIES)
    return matched.unionByName(unmatched.withColumn("full_name", F.lit(None).cast("string")))


@query("j5_side_by_side", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def j5(spark, sf):
    orders = table(spark, sf, "orders")
    left, right = orders.select("o_orderkey", "o_custkey"), orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return lookup.concat_columns(left, right, "o_orderkey")


@query(
    "j5_side_by_side_gaps",
    """SELECT custkey, spent, acctbal FROM (SELECT o_custkey AS custkey, round(sum(o_totalprice), 2) + 0.0 AS spent FROM orders GROUP BY 1)
       FULL JOIN (SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer) USING (custkey)""",
)
def j5_gaps(spark, sf):
    """Customers without orders keep their row."""
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(r(F.sum("o_totalprice"), 2).alias("spent"))
    return lookup.concat_columns(spent, table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal")), "custkey")


PAIR_NAMES = ["l_quantity", "l_discount", "l_tax"]
PAIR_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{PAIR_NAMES[i]}' AS name_i, '{PAIR_NAMES[j]}' AS name_j, '{o}' AS output, "
    f"round(corr({PAIR_NAMES[i]} * {PAIR_NAMES[j]}, {o}), 6) + 0.0 AS interaction FROM lineitem"
    for i in range(3)
    for j in range(i + 1, 3)
    for o in ("l_extendedprice", "l_linenumber")
)


@query("j6_pairs_by_output", PAIR_SQL)
def j6(spark, sf):
    outputs = ["l_extendedprice", "l_linenumber"]
    pairs = lookup.name_pairs(spark, PAIR_NAMES, outputs)
    products = [
        F.corr(F.col(PAIR_NAMES[i]) * F.col(PAIR_NAMES[j]), F.col(o)).alias(f"c_{i}_{j}_{o}")
        for i in range(3) for j in range(i + 1, 3) for o in outputs
    ]
    row = table(spark, sf, "lineitem").agg(*products)
    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(o).alias("output"), r(F.col(f"c_{i}_{j}_{o}")).alias("interaction"))
        for i in range(3) for j in range(i + 1, 3) for o in outputs
    ]
    return pairs.join(row.select(F.inline(F.array(*cells))), ["i", "j", "output"])


@query(
    "j7_grid_product",
    "SELECT o_orderkey, g.k AS step, round(o_totalprice * g.k, 4) + 0.0 AS scaled FROM orders, (VALUES (1), (2), (3)) g(k)",
)
def j7(spark, sf):
    points = F.array(*[F.struct(F.lit(k).alias("step")) for k in (1, 2, 3)])
    out = lookup.attach_grid(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), points)
    return out.select("o_orderkey", "step", r(F.col("o_totalprice") * F.col("step"), 4).alias("scaled"))


@query(
    "j8_large_dimension_lookup",
    """SELECT l_orderkey, l_linenumber, l_quantity, coalesce(o_totalprice, 0) AS price FROM lineitem
       LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""",
)
def j8(spark, sf):
    """The shuffled, salted form of the lookup, for a dimension that is no broadcast candidate."""
    dim = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey", "o_totalprice")
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lookup.lookup(facts, dim, "l_orderkey", "o_orderkey", {"o_totalprice": "price"}, default=0, bounded=False)


@query(
    "n1_union_conformed",
    """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""",
)
def n1(spark, sf):
    names = lambda p, k: {f"{p}_{k}key": "id", f"{p}_name": "name", f"{p}_nationkey": "nation", f"{p}_acctbal": "balance"}
    c = table(spark, sf, "customer").drop("c_mktsegment").withColumnsRenamed(names("c", "cust"))
    s = table(spark, sf, "supplier").withColumnsRenamed(names("s", "supp"))
    return combine.union_conformed(c, s)


@query(
    "n2_union_outer",
    """SELECT c_custkey AS id, c_name, c_mktsegment, NULL AS s_name FROM customer
       UNION ALL SELECT s_suppkey, NULL, NULL, s_name FROM supplier""",
)
def n2(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return combine.union_outer(c, s)
