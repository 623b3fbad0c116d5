"""Relationships and missing tests of three projects that share the names of their entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import tables
from fleetlens.operators import erd as E

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def word(k: int) -> str:
    """Words that k neighbours of the table share."""
    return f"'w' || CAST(CAST(floor(p_partkey / {k}) AS BIGINT) AS STRING)"


AT = "'s' || CAST(p_partkey % 3 AS STRING) AS scope, 'e' || CAST(p_partkey AS STRING) AS entity"
OWN = f"CASE WHEN p_size % 2 = 0 THEN 'ID' ELSE {word(6)} || '_id' END"
ENTITIES = f"SELECT {AT}, CASE p_size % 3 WHEN 0 THEN 'stg_' || {word(6)} || 's' WHEN 1 THEN {word(6)} ELSE 'dim_' || {word(6)} || 's' END AS name FROM part"
COLUMNS = " UNION ".join(f"SELECT {AT}, {c} AS col FROM part" for c in (OWN, "'name'", f"upper({word(12)} || '_id')", f"{word(9)} || '_id'"))
KEYS = f"SELECT {AT}, CASE WHEN p_size % 7 = 0 THEN 'name,' || {OWN} ELSE {OWN} END AS cols, p_size % 4 AS basis FROM part WHERE p_size % 9 > 0"
KNOWN = f"SELECT {AT}, {word(9)} || '_id' AS col FROM part WHERE p_partkey % 10 = 0"
UNIQUE = f"SELECT {AT}, CASE p_partkey % 4 WHEN 0 THEN {OWN} WHEN 1 THEN 'name' ELSE 'name,' || {OWN} END AS cols FROM part WHERE p_partkey % 3 < 2 OR p_size % 2 = 0"
FILLED = f"SELECT {AT}, 'name' AS col FROM part WHERE p_partkey % 5 = 0"
JOINED = f"SELECT {AT}, CASE WHEN l_linenumber % 2 = 0 THEN 'NAME' WHEN l_linenumber % 3 = 0 THEN {word(9)} || '_id' ELSE {OWN} END AS col, 'm' || CAST(l_suppkey AS STRING) AS reader FROM lineitem JOIN part ON p_partkey = l_partkey"

FOUND = f"""WITH ent AS ({ENTITIES}), cols AS ({COLUMNS}), keys AS ({KEYS}), known AS ({KNOWN}),
 single AS (SELECT scope, entity AS "to", cols AS to_column, basis >= 2 AS trusted FROM keys WHERE NOT contains(cols, ',')),
 forms AS (SELECT DISTINCT scope, entity, unnest([name, regexp_replace(name, '^(stg|dim)_', ''), regexp_replace(regexp_replace(name, '^(stg|dim)_', ''), 's$', '')]) AS form FROM ent),
 holders AS (SELECT scope, lower(to_column) AS name, "to", to_column, trusted FROM single UNION SELECT s.scope, form || '_id', "to", to_column, trusted FROM single s JOIN forms f ON f.scope = s.scope AND f.entity = s."to" WHERE lower(to_column) = 'id'),
 refs AS (SELECT scope, entity, col FROM cols WHERE lower(col) LIKE '%\\_id' ESCAPE '\\' AND (scope, entity, lower(col)) NOT IN (SELECT (scope, entity, lower(unnest(string_split(cols, ',')))) FROM keys) AND (scope, entity, lower(col)) NOT IN (SELECT (scope, entity, lower(col)) FROM known)),
 cand AS (SELECT r.scope, r.entity, col, "to", to_column, trusted, bool_or(trusted) OVER (PARTITION BY r.scope, r.entity, col) AS best FROM refs r JOIN holders h ON h.scope = r.scope AND h.name = lower(col) AND h."to" <> r.entity),
 few AS (SELECT DISTINCT scope, entity, col, "to", to_column, count(*) OVER (PARTITION BY scope, entity, col) AS n FROM (SELECT DISTINCT scope, entity, col, "to", to_column FROM cand WHERE trusted = best))"""


def frames(spark, sf):
    tables(spark, sf)
    col = lambda sql: spark.sql(sql).withColumnRenamed("col", "column")
    split = lambda sql: spark.sql(sql).withColumn("columns", F.split("cols", ",")).drop("cols")
    return spark.sql(ENTITIES), col(COLUMNS), split(KEYS), col(KNOWN), split(UNIQUE), col(FILLED), col(JOINED)


@query("r5_relationships_by_form", f'{FOUND} SELECT scope, entity, col AS "column", "to", to_column FROM few WHERE n = 1')
def r5_forms(spark, sf):
    return E.relationships_by_form(*frames(spark, sf)[:4])[0]


@query("r5_ambiguous_references", f'{FOUND} SELECT DISTINCT scope, entity, col AS "column", n AS n_targets FROM few WHERE n > 1')
def r5_ambiguous(spark, sf):
    return E.relationships_by_form(*frames(spark, sf)[:4])[1]


@query("r11_suggested_tests", f"""{FOUND}, uniq AS ({UNIQUE}), filled AS ({FILLED} UNION SELECT scope, entity, unnest(string_split(cols, ',')) FROM keys WHERE basis > 0),
 joined AS ({JOINED}), tested AS (SELECT scope, entity, lower(col) AS c FROM filled UNION SELECT scope, entity, lower(col) FROM known UNION SELECT scope, entity, lower(unnest(string_split(cols, ','))) FROM uniq)
 SELECT scope, entity, unnest(string_split(cols, ',')) AS "column", 'unique+not_null' AS test, 'untested_key' AS reason, NULL::VARCHAR AS detail FROM keys WHERE basis = 0
 UNION ALL SELECT scope, entity, cols, 'not_null', 'unique_but_nullable', NULL FROM uniq WHERE NOT contains(cols, ',') AND (scope, entity, cols) NOT IN (SELECT (scope, entity, col) FROM filled)
 UNION ALL SELECT scope, entity, col, 'relationship', 'untested_relationship', "to" || '.' || to_column FROM few WHERE n = 1
 UNION ALL SELECT scope, entity, min(col), 'not_null', 'untested_join', CAST(count(DISTINCT reader) AS VARCHAR) FROM joined WHERE (scope, entity, lower(col)) NOT IN (SELECT (scope, entity, c) FROM tested) GROUP BY scope, entity, lower(col)""")
def r11_all(spark, sf):
    entities, columns, keys, known, unique, filled, joined = frames(spark, sf)
    guessed = E.relationships_by_form(entities, columns, keys, known)[0]
    return E.suggested_tests(keys, unique, filled, guessed, known, joined)
