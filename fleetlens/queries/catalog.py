"""Coverage, columns and lineage changes of projects that share the names of their nodes."""

from __future__ import annotations

from fleetlens.bindings import bind, oracle, tables
from fleetlens.operators import health as H
from fleetlens.operators import lineage as L

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# The third project has no models, the first no sources.
MODELS = "SELECT 's' || CAST(node % 2 AS STRING) AS scope, node, 'm' || CAST(node AS STRING) AS name, tests, CASE WHEN described THEN resource_type WHEN node % 2 = 0 THEN '  ' END AS description, CASE WHEN layer % 5 > 0 THEN layer % 4 END AS constraints FROM node_facts"
SOURCES = "SELECT 's' || CAST(1 + s_suppkey % 2 AS STRING) AS scope, s_suppkey AS node, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'loaded_at' END AS measured_with, CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey END AS read_by_runs, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS version FROM supplier"
EACH = f"""m AS ({MODELS}), s AS ({SOURCES}), e AS (SELECT scope, node, name, unnest(['tests', 'descriptions', 'constraints']) AS measure, unnest([tests > 0, trim(description) <> '', constraints > 0]) AS ok FROM m
 UNION ALL SELECT scope, node, name, 'source_freshness', measured_with IS NOT NULL OR read_by_runs IS NOT NULL OR version IS NOT NULL FROM s)"""


def covered(spark, sf):
    bind(spark, sf, "node_facts").createOrReplaceTempView("node_facts")
    return H.coverage_measures(spark.sql(MODELS), spark.sql(SOURCES))


@query("a8_coverage_measures", oracle(f", {EACH} SELECT scope, measure, covered, coalesce(total, 0) AS total FROM (SELECT DISTINCT scope FROM (SELECT scope FROM m UNION ALL SELECT scope FROM s)) CROSS JOIN (SELECT unnest(['tests', 'descriptions', 'constraints', 'source_freshness']) AS measure) LEFT JOIN (SELECT scope, measure, count(*) FILTER (ok) AS covered, count(*) AS total FROM e GROUP BY ALL) USING (scope, measure)", "node_facts"))
def a8_measures(spark, sf):
    return covered(spark, sf)[0]


@query("a8_uncovered", oracle(f", {EACH} SELECT scope, measure, node, name FROM e WHERE ok IS NOT TRUE", "node_facts"))
def a8_uncovered(spark, sf):
    return covered(spark, sf)[1]


COLUMN = "'s' || CAST(l_partkey % 2 AS STRING) AS scope, l_suppkey AS node, {c} || CAST(l_partkey % 60 AS STRING) AS col"
LISTED = f"SELECT {COLUMN.format(c="'C'")}, 'declared' AS lister, CASE WHEN l_partkey % 4 = 0 THEN l_linestatus END AS type FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT {COLUMN.format(c="'c'")}, 'warehouse', CASE WHEN l_partkey % 3 > 0 THEN l_returnflag END FROM lineitem WHERE l_linenumber > 3"
CODE = f"SELECT {COLUMN.format(c="'c'")} FROM lineitem WHERE l_linenumber % 3 = 0"
TESTS = f"SELECT {COLUMN.format(c="'C'")}, CASE WHEN l_linenumber = 1 THEN 'unique' ELSE 'not_null' END AS test FROM lineitem WHERE l_partkey % 3 = 0"
CONSTRAINTS = f"SELECT {COLUMN.format(c="'c'")}, CASE WHEN l_linenumber = 2 THEN 'check' ELSE 'not_null' END AS cons FROM lineitem WHERE l_partkey % 5 = 0"
EDGES = f"SELECT {COLUMN.format(c="'C'")}, CASE WHEN l_linenumber = 7 THEN l_suppkey ELSE l_orderkey % 50 END AS from_node, CASE WHEN l_linenumber < 6 OR l_linenumber = 7 THEN 'x' || CAST(l_linenumber AS STRING) END AS from_column FROM lineitem WHERE l_partkey % 7 > 2"
LIST = lambda sql, c, out: f"(SELECT scope, node, lower(col) AS key, string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS {out} FROM ({sql}) GROUP BY ALL)"
UP = "CASE WHEN from_node = node THEN from_column ELSE from_node || '.' || from_column END"


@query("j25_column_catalog", f"""WITH c AS (SELECT scope, node, lower(col) AS key, min(col) FILTER (lister = 'declared') AS d, min(col) FILTER (lister = 'warehouse') AS w, min(type) FILTER (lister = 'declared') AS dt, min(type) FILTER (lister = 'warehouse') AS wt FROM ({LISTED}) GROUP BY ALL)
 SELECT scope, node, coalesce(d, w) AS "column", coalesce(wt, dt) AS type, CASE WHEN wt IS NOT NULL THEN 'warehouse' WHEN dt IS NOT NULL THEN 'declared' END AS type_source, d IS NULL AND (scope, node, key) NOT IN (SELECT (scope, node, col) FROM ({CODE})) AS possibly_stale, tests, constraints, upstream
 FROM c LEFT JOIN {LIST(TESTS, "test", "tests")} USING (scope, node, key) LEFT JOIN {LIST(CONSTRAINTS, "cons", "constraints")} USING (scope, node, key) LEFT JOIN {LIST(f"SELECT * FROM ({EDGES}) WHERE from_column IS NOT NULL", UP, "upstream")} USING (scope, node, key)""")
def j25_catalog(spark, sf):
    tables(spark, sf)
    named = lambda sql: spark.sql(sql).withColumnsRenamed({"col": "column", "cons": "constraint"})
    return H.column_catalog(*[named(s) for s in (LISTED, CODE, TESTS, CONSTRAINTS, EDGES)])


NODE = "'s' || CAST(p_partkey % 3 AS STRING) AS scope, CAST(floor(p_partkey / 3) AS BIGINT) AS node"
FIVE = "(SELECT 1 AS i UNION ALL SELECT 2 AS i UNION ALL SELECT 3 AS i UNION ALL SELECT 4 AS i UNION ALL SELECT 5 AS i) five"
BEFORE = f"SELECT {NODE}, p_size % 11 = 0 AS opaque, CASE WHEN p_size % 5 > 0 THEN p_brand END AS row_digest FROM part WHERE p_partkey % 13 > 0"
AFTER = f"SELECT {NODE}, p_partkey % 17 = 0 AS opaque, CASE WHEN p_partkey % 9 = 0 THEN 'other' WHEN p_size % 5 > 0 THEN p_brand END AS row_digest FROM part WHERE p_partkey % 19 > 0"
OUTPUTS = f"SELECT {NODE}, 'c' || CAST(i AS STRING) AS col, p_type AS digest, i AS ordinal FROM part CROSS JOIN {FIVE} WHERE i <> p_size % 7"
OUTPUTS_NOW = f"SELECT {NODE}, 'c' || CAST(i AS STRING) AS col, CASE WHEN (p_partkey + i) % 8 > 0 THEN p_type END AS digest, CASE WHEN p_partkey % 4 = 0 THEN i % 5 ELSE i END AS ordinal FROM part CROSS JOIN {FIVE} WHERE i <> p_size % 6 UNION ALL SELECT {NODE}, 'c1', p_type, 9 FROM part WHERE p_partkey % 31 = 0"


@query("g8_relation_changes", f"""WITH b AS ({BEFORE}), a AS ({AFTER}), ob AS ({OUTPUTS}), oa AS ({OUTPUTS_NOW}), dup AS (SELECT scope, node FROM oa GROUP BY scope, node, col HAVING count(*) > 1 UNION SELECT scope, node FROM ob GROUP BY scope, node, col HAVING count(*) > 1),
 m AS (SELECT a.scope, a.node, CASE WHEN b.node IS NULL THEN 'new' WHEN a.opaque OR b.opaque THEN 'opaque' WHEN a.row_digest IS DISTINCT FROM b.row_digest THEN 'row_digest' WHEN (a.scope, a.node) IN (SELECT (scope, node) FROM dup) THEN 'duplicate_name' END AS why FROM a LEFT JOIN b USING (scope, node)),
 x AS (SELECT * FROM ob SEMI JOIN (SELECT * FROM m WHERE why IS NULL) USING (scope, node)), y AS (SELECT * FROM oa SEMI JOIN (SELECT * FROM m WHERE why IS NULL) USING (scope, node)),
 both_ AS (SELECT scope, node, col, x.digest AS was, y.digest AS now, rank() OVER (PARTITION BY scope, node ORDER BY x.ordinal) AS p, rank() OVER (PARTITION BY scope, node ORDER BY y.ordinal) AS q FROM x JOIN y USING (scope, node, col))
 SELECT scope, node, 'rows' AS change, NULL::VARCHAR AS "column", why FROM m WHERE why IS NOT NULL
 UNION ALL SELECT scope, node, 'added', col, NULL FROM y ANTI JOIN x USING (scope, node, col) UNION ALL SELECT scope, node, 'removed', col, NULL FROM x ANTI JOIN y USING (scope, node, col)
 UNION ALL SELECT scope, node, 'modified', col, CASE WHEN was IS DISTINCT FROM now THEN 'digest' ELSE 'moved' END FROM both_ WHERE was IS DISTINCT FROM now OR p <> q""")
def g8_changes(spark, sf):
    tables(spark, sf)
    column = lambda sql: spark.sql(sql).withColumnRenamed("col", "column")
    return L.relation_changes(spark.sql(BEFORE), spark.sql(AFTER), column(OUTPUTS), column(OUTPUTS_NOW))
