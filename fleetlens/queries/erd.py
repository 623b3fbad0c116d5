"""Entities and keys of the given tables: their columns are the input, their rows are probed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fleetlens.bindings import bind
from fleetlens.operators import erd as E

QUERIES = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# Facts about columns come from the data: a column's rows, nulls and distinct values in each table.
STATS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def stats(spark, sf):
    one = lambda t: bind(spark, sf, t).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in STATS[t]], *[F.countDistinct(c).alias(f"d_{c}") for c in STATS[t]])
    parts = [one(t).select(F.explode(F.array(*[F.struct(F.lit(t).alias("entity"), F.lit(c).alias("column"), F.col("rows"), F.col(f"n_{c}").alias("present"), F.col(f"d_{c}").alias("different")) for c in STATS[t]])).alias("x")).select("x.*") for t in STATS]
    return reduce(lambda a, b: a.unionByName(b), parts)


ST = " UNION ALL ".join(f"SELECT '{t}' AS entity, '{c}' AS \"column\", count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS different FROM {t}" for t, cs in STATS.items() for c in cs)
UNIQUE = f'(SELECT entity, "column" AS key FROM ({ST}) WHERE rows = different)'
NOTNULL = f'(SELECT entity, "column" FROM ({ST}) WHERE rows = present)'
BARE = lambda c: f"regexp_replace({c}, '^[a-z]{{1,2}}_', '')"


def keys(spark, sf):
    return stats(spark, sf).where("rows = different").select("entity", F.col("column").alias("key"))


def not_null(spark, sf):
    return stats(spark, sf).where("rows = present").select("entity", "column")


@query("r1_resolve_columns", f"SELECT entity, \"column\" FROM ({ST})")
def r1(spark, sf):
    s = stats(spark, sf)
    return E.resolve_columns(s.select("entity", F.upper("column").alias("column")).unionByName(s.select("entity", F.concat("column", F.lit("_x")).alias("column"))), s.select("entity", "column"))[0]


@query("r1_diagnostics", f"SELECT entity, \"column\" || '_x' AS \"column\" FROM ({ST})")
def r1d(spark, sf):
    s = stats(spark, sf)
    return E.resolve_columns(s.select("entity", F.upper("column").alias("column")).unionByName(s.select("entity", F.concat("column", F.lit("_x")).alias("column"))), s.select("entity", "column"))[1]


@query("a26_key_dedup", f"SELECT entity, key AS columns, 3 AS basis, 'declared,unique' AS evidence FROM {UNIQUE}")
def a26(spark, sf):
    k = keys(spark, sf).select("entity", F.array("key").alias("columns"))
    return E.key_dedup(k.withColumns({"basis": F.lit(2), "evidence": F.lit("unique")}).unionByName(k.withColumns({"basis": F.lit(3), "evidence": F.lit("declared")})))


@query("r2_apply_facts", f"SELECT entity, (SELECT string_agg(key, ',' ORDER BY key) FROM {UNIQUE} u WHERE u.entity = n.entity) AS keys, string_agg(\"column\", ',' ORDER BY \"column\") AS not_null FROM {NOTNULL} n GROUP BY entity")
def r2(spark, sf):
    n = not_null(spark, sf).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("not_null"))
    return n.join(keys(spark, sf).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys")), "entity", "left").select("entity", "keys", "not_null")


@query("r3_promote_primary_keys", f"SELECT entity, min(key) AS primary_key, count(*) > 1 AS several FROM {UNIQUE} GROUP BY entity")
def r3(spark, sf):
    return E.promote_primary_keys(keys(spark, sf).select("entity", F.col("key").alias("columns")), not_null(spark, sf))


@query("r4_infer_primary_keys", "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('supplier', 's_suppkey'), ('part', 'p_partkey'), ('orders', 'o_orderkey')) t(entity, key) WHERE (SELECT count(*) FROM orders) > 0")
def r4(spark, sf):
    return E.infer_primary_keys(stats(spark, sf).select("entity", "column"))


RELS = f"(SELECT c.entity, c.\"column\", k.entity AS \"to\", k.key AS to_column FROM ({ST}) c JOIN {UNIQUE} k ON {BARE('c.\"column\"')} = {BARE('k.key')} AND c.entity <> k.entity)"


@query("r5_infer_relationships", f"SELECT * FROM {RELS}")
def r5(spark, sf):
    return E.infer_relationships(stats(spark, sf).select("entity", "column"), keys(spark, sf))[0]


@query("r6_resolve_joins", f"SELECT entity AS \"left\", \"column\" AS left_column, \"to\" AS \"right\", to_column AS right_column, CASE WHEN (entity, \"column\") IN (SELECT (entity, key) FROM {UNIQUE}) THEN 'one_to_one' ELSE 'many_to_one' END AS cardinality FROM {RELS} UNION ALL SELECT \"to\", to_column, entity, \"column\", CASE WHEN (entity, \"column\") IN (SELECT (entity, key) FROM {UNIQUE}) THEN 'one_to_one' ELSE 'one_to_many' END FROM {RELS}")
def r6(spark, sf):
    r = r5(spark, sf)
    one = r.select(F.col("entity").alias("left"), F.col("column").alias("left_column"), F.col("to").alias("right"), F.col("to_column").alias("right_column"))
    return E.resolve_joins(one.unionByName(one.select(F.col("right").alias("left"), F.col("right_column").alias("left_column"), F.col("left").alias("right"), F.col("left_column").alias("right_column"))), keys(spark, sf))


FIN = f"(SELECT entity, \"column\", \"to\", to_column, 2 AS basis, 'inferred,test' AS evidence, CASE WHEN (entity, \"column\") IN (SELECT (entity, key) FROM {UNIQUE}) THEN 'one_to_one' ELSE 'many_to_one' END AS cardinality, (entity, \"column\") NOT IN (SELECT (entity, \"column\") FROM {NOTNULL}) AS optional FROM {RELS})"


def rels(spark, sf):
    r = r5(spark, sf)
    return r.withColumns({"basis": F.lit(0), "evidence": F.lit("inferred")}).unionByName(r.withColumns({"basis": F.lit(2), "evidence": F.lit("test")}))


@query("r7_finish_relationships", f"SELECT * FROM {FIN}")
def r7(spark, sf):
    return E.finish_relationships(rels(spark, sf), keys(spark, sf), not_null(spark, sf))


@query("r8_finish_entities", f"SELECT entity, \"column\", rows = different AS primary_key, (entity, \"column\") IN (SELECT (entity, \"column\") FROM {RELS}) AS foreign_key, rows = present OR rows = different AS not_null FROM ({ST})")
def r8(spark, sf):
    return E.finish_entities(stats(spark, sf).select("entity", "column"), keys(spark, sf), rels(spark, sf), not_null(spark, sf))


@query("r10_connected_only", f"SELECT DISTINCT entity FROM ({ST}) WHERE entity IN (SELECT entity FROM {RELS} UNION ALL SELECT \"to\" FROM {RELS})")
def r10(spark, sf):
    return E.connected_only(stats(spark, sf).select("entity").distinct(), r5(spark, sf))


GAPS = f"(SELECT entity, key AS \"column\", t AS test FROM {UNIQUE}, (SELECT unnest(['unique', 'not_null']) AS t) WHERE NOT (t = 'unique' AND entity IN ('part', 'orders')) UNION ALL SELECT entity, \"column\", 'relationship' FROM {RELS})"


@query("r11_test_gaps", f"SELECT * FROM {GAPS}")
def r11(spark, sf):
    tested = keys(spark, sf).where("entity in ('part', 'orders')").select("entity", F.col("key").alias("column")).withColumn("test", F.lit("unique"))
    return E.test_gaps(keys(spark, sf), r5(spark, sf), tested)


KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"]}


@query("a16_key_probes", " UNION ALL ".join(f"SELECT '{t}' AS node, '{','.join(k)}' AS key, (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM {t} WHERE {' OR '.join(f'{c} IS NULL' for c in k)}) AS nulls, (SELECT count(*) FROM (SELECT {', '.join(k)} FROM {t} GROUP BY ALL HAVING count(*) > 1)) AS duplicates" for t, k in KEYS.items()))
def a16(spark, sf):
    return reduce(lambda a, b: a.unionByName(b), [E.key_probe(bind(spark, sf, t), t, k) for t, k in KEYS.items()])


FKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("events", "user_id", "customer", "c_custkey"), ("lineitem", "l_partkey", "supplier", "s_suppkey")]


@query("r12_orphan_probes", " UNION ALL ".join(f"SELECT '{t}.{c}' AS relationship, count(DISTINCT {c}) AS orphan_keys, count(*) AS orphan_rows FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p})" for t, c, p, k in FKS))
def r12(spark, sf):
    return reduce(lambda a, b: a.unionByName(b), [E.orphan_probe(bind(spark, sf, t), c, bind(spark, sf, p), k, f"{t}.{c}") for t, c, p, k in FKS])


@query("a16_accepted_values", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def a16v(spark, sf):
    return E.accepted_values(bind(spark, sf, "events"), "event_type", ["view", "click"])


@query("a15_probe", "SELECT node, \"column\", value FROM (SELECT 'orders' AS node, CAST(count(*) AS VARCHAR) AS n, CAST(max(o_orderkey) AS VARCHAR) AS top FROM orders UNION ALL SELECT 'customer', CAST(count(*) AS VARCHAR), CAST(max(c_custkey) AS VARCHAR) FROM customer) UNPIVOT (value FOR \"column\" IN (n, top))")
def a15(spark, sf):
    o, c = bind(spark, sf, "orders"), bind(spark, sf, "customer")
    return E.probe(o, "orders", {"n": F.count(F.lit(1)), "top": F.max("o_orderkey")}).unionByName(E.probe(c, "customer", {"n": F.count(F.lit(1)), "top": F.max("c_custkey")}))


FACTS = """SELECT 'p' || CAST(p_partkey % 2 AS STRING) AS scope, p_partkey AS no, 'e' || CAST(p_partkey % 151 AS STRING) AS entity, CASE p_size % 3 WHEN 0 THEN 'unique' WHEN 1 THEN 'not_null' ELSE 'primary_key' END AS fact,
 CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'ID' ELSE 'name' END WHEN p_size % 5 = 0 THEN 'Name,id' WHEN p_size % 7 = 0 THEN 'gone,id' WHEN p_size % 2 = 0 THEN 'ID' ELSE 'Kind' END AS cols, p_size % 4 AS basis, 'ev' || CAST(p_partkey AS STRING) AS evidence FROM part"""
FCOLS = "SELECT DISTINCT scope, entity, c AS \"column\" FROM f CROSS JOIN (SELECT 'id' AS c UNION ALL SELECT 'name' AS c UNION ALL SELECT 'kind' AS c) cs WHERE entity <> 'e7' AND entity <> 'e8'"
RESOLVED = f"""WITH f AS ({FACTS}), c AS ({FCOLS}), x AS (SELECT f.*, u.col FROM f, unnest(string_split(cols, ',')) AS u(col)),
 r AS (SELECT x.scope, x.no, x.entity, fact, basis, evidence, col, c."column" AS proper, (x.scope, x.entity) IN (SELECT (scope, entity) FROM c) AS known FROM x LEFT JOIN c ON c.scope = x.scope AND c.entity = x.entity AND lower(c."column") = lower(col)),
 g AS (SELECT scope, no, entity, fact, basis, evidence, bool_or(known AND proper IS NULL) AS lost, string_agg(DISTINCT coalesce(proper, col), ',' ORDER BY coalesce(proper, col)) AS columns, string_agg(DISTINCT col, ',' ORDER BY col) FILTER (known AND proper IS NULL) AS lacking FROM r GROUP BY ALL),
 k AS (SELECT scope, entity, fact, columns, max(basis) AS basis, min(no) AS no, arg_min(evidence, no) AS evidence FROM g WHERE NOT lost AND fact <> 'not_null' GROUP BY ALL),
 b AS (SELECT scope, entity, arg_min(columns, {{'a': -basis, 'b': no}}) AS primary_key FROM k WHERE fact = 'primary_key' GROUP BY ALL)"""


def facts(spark, sf):
    bind(spark, sf, "node_facts")
    f = spark.sql(FACTS)
    f.createOrReplaceTempView("f")
    return E.apply_facts(f.select("scope", "no", "entity", "fact", F.split("cols", ",").alias("columns"), "basis", "evidence"), spark.sql(FCOLS.replace('"', "`")))


@query("r2_facts_by_scope", f"""{RESOLVED} SELECT e.scope, e.entity, unique_keys, not_null, primary_key FROM (SELECT DISTINCT scope, entity FROM g WHERE NOT lost) e
 LEFT JOIN (SELECT scope, entity, string_agg(columns || ':' || basis, ';' ORDER BY columns || ':' || basis) AS unique_keys FROM k WHERE fact = 'unique' GROUP BY ALL) USING (scope, entity)
 LEFT JOIN (SELECT scope, entity, string_agg(DISTINCT columns, ',' ORDER BY columns) AS not_null FROM g WHERE NOT lost AND fact = 'not_null' GROUP BY ALL) USING (scope, entity) LEFT JOIN b USING (scope, entity)""")
def r2_scoped(spark, sf):
    return facts(spark, sf)[0]


@query("r2_fact_diagnostics", f"""{RESOLVED} SELECT scope, entity, evidence, 'unknown_column' AS problem, lacking AS columns FROM g WHERE lost
 UNION ALL SELECT scope, entity, evidence, 'conflicting_primary_key', columns FROM k JOIN b USING (scope, entity) WHERE fact = 'primary_key' AND columns <> primary_key""")
def r2_diagnostics(spark, sf):
    return facts(spark, sf)[1]
