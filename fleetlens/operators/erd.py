"""Keys, relationships and probes of given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import name_forms

# How strong a fact is.
BASIS = {"inferred": 0, "joined": 1, "tested": 2, "declared": 3}


def resolve_columns(facts: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fact's columns as their entity spells them; those that it doesn't have become diagnostics.

    Entities without known columns accept any.
    """
    f = facts.withColumn("key", F.lower("column"))
    c = columns.select("entity", F.lower("column").alias("key"), F.col("column").alias("proper"))
    known = columns.select("entity").distinct().withColumn("known", F.lit(True))
    j = f.join(c, ["entity", "key"], "left").join(known, "entity", "left")
    fine = F.col("proper").isNotNull() | F.col("known").isNull()
    return j.where(fine).select("entity", F.coalesce("proper", "column").alias("column")), j.where(~fine).select("entity", "column")


def key_dedup(keys: DataFrame) -> DataFrame:
    """Keys over the same columns in any order are one: the strongest basis, all evidence."""
    return keys.groupBy("entity", F.array_join(F.array_sort("columns"), ",").alias("columns")).agg(F.max("basis").alias("basis"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))


def apply_facts(facts: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: what facts say about each entity, and the diagnostics of those that can't be recorded.

    ``facts([scope,] no, entity, fact, columns, basis, evidence)`` with ``fact`` one of ``unique``, ``not_null``, ``primary_key``
    and ``no`` their order; ``columns([scope,] entity, column)``. Columns take the entity's spelling; a fact with a column that
    a known entity lacks is a diagnostic, and so is a primary key beside a stronger, or an equally strong earlier one.

    Returns ``entity, unique_keys, not_null, primary_key`` (columns joined by commas, keys by semicolons, each key
    with its strongest basis) and ``entity, evidence, problem, columns``.
    """
    within = [*(["scope"] if "scope" in facts.columns else []), "entity"]
    flat = facts.select(*within, "no", "fact", "basis", "evidence", F.posexplode("columns").alias("at", "column")).withColumn("key", F.lower("column"))
    spelt = columns.select(*within, F.lower("column").alias("key"), F.col("column").alias("proper")).dropDuplicates([*within, "key"])
    known = columns.select(*within).distinct().withColumn("known", F.lit(True))
    j = flat.join(spelt, [*within, "key"], "left").join(known, within, "left")
    j = j.withColumn("lost", F.col("proper").isNull() & F.col("known").isNotNull()).withColumn("name", F.coalesce("proper", "column"))
    each = j.groupBy(*within, "no", "fact", "basis", "evidence").agg(F.bool_or("lost").alias("lost"), F.array_sort(F.collect_set("name")).alias("columns"), F.array_sort(F.collect_set(F.when(F.col("lost"), F.col("column")))).alias("lacking"))
    text = lambda c: F.array_join(c, ",")
    unknown = each.where("lost").select(*within, "evidence", F.lit("unknown_column").alias("problem"), text("lacking").alias("columns"))
    fine = each.where("not lost").withColumn("columns", text("columns"))
    keys = fine.where("fact <> 'not_null'").groupBy(*within, "fact", "columns").agg(F.max("basis").alias("basis"), F.min("no").alias("no"), F.min_by("evidence", "no").alias("evidence"))
    unique = keys.where("fact = 'unique'").groupBy(*within).agg(F.array_join(F.array_sort(F.collect_list(F.concat("columns", F.lit(":"), "basis"))), ";").alias("unique_keys"))
    primary = keys.where("fact = 'primary_key'")
    best = primary.groupBy(*within).agg(F.min_by("columns", F.struct(-F.col("basis"), "no")).alias("primary_key"))
    beside = primary.join(best, within).where("columns <> primary_key").select(*within, "evidence", F.lit("conflicting_primary_key").alias("problem"), "columns")
    filled = fine.where("fact = 'not_null'").groupBy(*within).agg(F.array_join(F.array_sort(F.collect_set("columns")), ",").alias("not_null"))
    found = fine.select(*within).distinct().join(unique, within, "left").join(filled, within, "left").join(best, within, "left")
    return found.select(*within, "unique_keys", "not_null", "primary_key"), unknown.unionByName(beside)


def promote_primary_keys(keys: DataFrame, not_null: DataFrame) -> DataFrame:
    """A unique key whose columns are all not null; single columns first, then the fewest; ties by name."""
    flat = keys.select("entity", "columns", F.explode(F.split("columns", ",")).alias("column"))
    full = flat.join(not_null.withColumn("nn", F.lit(1)), ["entity", "column"], "left").groupBy("entity", "columns").agg(F.count(F.lit(1)).alias("n"), F.count("nn").alias("nn")).where("n = nn")
    return full.groupBy("entity").agg(F.min_by("columns", F.struct("n", "columns")).alias("primary_key"), (F.count_if(F.col("n") == 1) > 1).alias("several"))


def infer_primary_keys(columns: DataFrame) -> DataFrame:
    """``id`` or ``<a form of the entity's name>_id``, or with the entity's prefix; the first by form."""
    forms = columns.select("entity", "column", name_forms(F.col("entity")).alias("forms"))
    names = F.transform("forms", lambda f: F.concat(f, F.lit("_id")))
    names = F.concat(F.array(F.lit("id")), names, F.transform("forms", lambda f: F.concat(F.substring(f, 1, 1), F.lit("_"), f, F.lit("key"))), F.transform("forms", lambda f: F.concat(F.substring(f, 1, 1), F.lit("_"), F.substring(f, 1, 4), F.lit("key"))))
    hit = forms.withColumn("at", F.array_position(names, F.lower("column"))).where("at > 0")
    return hit.groupBy("entity").agg(F.min_by("column", "at").alias("key"))


def infer_relationships(columns: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A column named like another entity's only key points to it; names that several keys share are diagnostics.

    Names are compared without the entity's prefix (``o_custkey`` and ``c_custkey``).
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "^[a-z]{1,2}_", "")
    k = keys.select(F.col("entity").alias("to"), F.col("key").alias("to_column"), bare("key").alias("name"))
    c = columns.select("entity", "column", bare("column").alias("name"))
    # a key's holders for a name are few; the name decides, so this is an equi join
    j = c.join(k, "name").where(F.col("entity") != F.col("to"))
    n = k.groupBy("name").agg(F.count(F.lit(1)).alias("holders"))
    j = j.join(n, "name")
    good = j.where("holders = 1").select("entity", "column", "to", "to_column")
    return good, j.where("holders > 1").select("entity", "column").distinct()


def resolve_joins(joins: DataFrame, keys: DataFrame) -> DataFrame:
    """Direct a join to the side whose column is a key; neither is an unknown cardinality, both are one to one."""
    k = lambda s: keys.select(F.col("entity").alias(s), F.col("key").alias(f"{s}_column"), F.lit(True).alias(f"{s}_key"))
    j = joins.join(k("left"), ["left", "left_column"], "left").join(k("right"), ["right", "right_column"], "left")
    card = F.when(F.col("left_key") & F.col("right_key"), "one_to_one").when(F.col("right_key"), "many_to_one").when(F.col("left_key"), "one_to_many").otherwise("unknown")
    return j.select("left", "left_column", "right", "right_column", F.coalesce(card, F.lit("unknown")).alias("cardinality"))


def finish_relationships(rels: DataFrame, keys: DataFrame, not_null: DataFrame) -> DataFrame:
    """Merge equal relationships; one to one if the from side is a key; optional unless the column is never null."""
    g = rels.groupBy("entity", "column", "to", "to_column").agg(F.max("basis").alias("basis"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))
    k = keys.select("entity", F.col("key").alias("column")).withColumn("own", F.lit(True))
    target = keys.select(F.col("entity").alias("to"), F.col("key").alias("to_column")).withColumn("is_key", F.lit(True))
    j = g.join(k, ["entity", "column"], "left").join(target, ["to", "to_column"], "left").join(not_null.select("entity", "column").withColumn("nn", F.lit(True)), ["entity", "column"], "left")
    card = F.when(F.col("is_key").isNull(), "unknown").when(F.col("own"), "one_to_one").otherwise("many_to_one")
    return j.select("entity", "column", "to", "to_column", "basis", "evidence", card.alias("cardinality"), F.col("nn").isNull().alias("optional"))


def finish_entities(columns: DataFrame, keys: DataFrame, rels: DataFrame, not_null: DataFrame) -> DataFrame:
    """Each column's flags; inferred relationships don't flag a foreign key."""
    pk = keys.select("entity", F.col("key").alias("column")).withColumn("pk", F.lit(True))
    fk = rels.where(F.col("basis") > BASIS["inferred"]).select("entity", "column").distinct().withColumn("fk", F.lit(True))
    nn = not_null.select("entity", "column").withColumn("nn", F.lit(True))
    j = columns.join(pk, ["entity", "column"], "left").join(fk, ["entity", "column"], "left").join(nn, ["entity", "column"], "left")
    no = F.lit(False)
    return j.select("entity", "column", F.coalesce("pk", no).alias("primary_key"), F.coalesce("fk", no).alias("foreign_key"), (F.coalesce("nn", no) | F.coalesce("pk", no)).alias("not_null"))


def connected_only(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Entities that have a relationship."""
    return entities.join(rels.select("entity").unionByName(rels.select(F.col("to").alias("entity"))).distinct(), "entity", "left_semi")


def test_gaps(inferred_keys: DataFrame, inferred_rels: DataFrame, tested: DataFrame) -> DataFrame:
    """Inferred keys and relationships without a test: ``tested(entity, column, test)``."""
    keys = inferred_keys.select("entity", F.col("key").alias("column"))
    want = keys.withColumn("test", F.lit("unique")).unionByName(keys.withColumn("test", F.lit("not_null"))).unionByName(inferred_rels.select("entity", "column").withColumn("test", F.lit("relationship")))
    return want.join(tested.select("entity", "column", "test"), ["entity", "column", "test"], "left_anti")


# ---- probes -----------------------------------------------------------------------------------


def probe(df: DataFrame, node: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row of aggregates of a relation as (node, column, value)."""
    row = df.agg(*[a.cast("string").alias(n) for n, a in aggregates.items()])
    return row.select(F.lit(node).alias("node"), F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in aggregates]), F.array(*[F.col(n) for n in aggregates]))).alias("column", "value"))


def key_probe(df: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """Rows, rows with a null in the key, and how many keys stand more than once."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("nulls"), F.count_if((F.col("n") > 1) & ~null).alias("duplicates")).select(F.lit(node).alias("node"), F.lit(",".join(columns)).alias("key"), "rows", "nulls", "duplicates")


def orphan_probe(df: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct values of a foreign key that its parent doesn't have, and their rows."""
    have = parent.select(F.col(key).alias(column)).distinct()
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).join(have, column, "left_anti")
    return g.agg(F.count(F.lit(1)).alias("orphan_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")).select(F.lit(name).alias("relationship"), "orphan_keys", "orphan_rows")


def accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values outside the accepted ones, with their rows."""
    return df.where(~F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# ---- relationships and gaps within scopes ------------------------------------------------------


def relationships_by_form(entities: DataFrame, columns: DataFrame, keys: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R5 in full: ``<x>_id`` points to the one entity whose key is that column, or that goes by ``<x>`` and has the key ``id``.

    ``entities(scope, entity, name)``, ``columns(scope, entity, column)``, ``keys(scope, entity, columns, basis)`` with an array of
    columns, ``known(scope, entity, column)``: columns that a fact directs already. Keys that are tested or declared go before
    guessed ones, without a rank among them. An entity doesn't refer to itself, nor by a column of its own key.

    Returns ``scope, entity, column, to, to_column``, and where several entities fit ``scope, entity, column, n_targets``, which
    is not guessed. Of a name's holders only their number and the first and last are kept, so a name that many entities hold
    and many refer to costs their sum, not their product. Null names and columns meet nothing.
    """
    single = keys.where(F.size("columns") == 1).select("scope", F.col("entity").alias("to"), F.element_at("columns", 1).alias("to_column"), (F.col("basis") >= BASIS["tested"]).alias("trusted"))
    by_column = single.select("scope", F.lower("to_column").alias("name"), "to", "to_column", "trusted")
    forms = entities.select("scope", F.col("entity").alias("to"), F.explode(name_forms(F.col("name"))).alias("form"))
    by_form = single.where(F.lower("to_column") == "id").join(forms, ["scope", "to"]).select("scope", F.concat("form", F.lit("_id")).alias("name"), "to", "to_column", "trusted")
    holders = by_column.unionByName(by_form).groupBy("scope", "name", "to").agg(F.max("to_column").alias("to_column"), F.bool_or("trusted").alias("trusted"))
    one = F.struct("to", "to_column")
    kind = lambda c, k: F.when(F.col("trusted") == k, c)
    ends = [f(kind(one, k)).alias(f"{n}_{w}") for k, w in ((True, "trusted"), (False, "guessed")) for f, n in ((F.count, "n"), (F.min, "first"), (F.max, "last"))]
    named = holders.groupBy("scope", "name").agg(*ends)
    own = keys.select("scope", "entity", F.explode("columns").alias("column"))
    taken = own.unionByName(known.select("scope", "entity", "column")).select("scope", "entity", F.lower("column").alias("name")).distinct()
    refs = columns.withColumn("name", F.lower("column")).where(F.endswith("name", F.lit("_id"))).join(taken, ["scope", "entity", "name"], "left_anti")
    itself = holders.select("scope", "name", F.col("to").alias("entity"), F.col("trusted").alias("self"))
    j = refs.join(named, ["scope", "name"]).join(itself, ["scope", "name", "entity"], "left")
    others = {w: F.col(f"n_{w}") - F.coalesce((F.col("self") == k).cast("long"), F.lit(0)) for k, w in ((True, "trusted"), (False, "guessed"))}
    j = j.withColumns({"n_t": others["trusted"], "n_g": others["guessed"]}).withColumn("n_targets", F.when(F.col("n_t") > 0, F.col("n_t")).otherwise(F.col("n_g")))
    # one target beside at most the entity itself: it is the first or the last
    other = lambda w: F.when(F.col(f"first_{w}.to") == F.col("entity"), F.col(f"last_{w}")).otherwise(F.col(f"first_{w}"))
    j = j.withColumn("target", F.when(F.col("n_t") > 0, other("trusted")).otherwise(other("guessed")))
    return j.where("n_targets = 1").select("scope", "entity", "column", "target.to", "target.to_column"), j.where("n_targets > 1").select("scope", "entity", "column", "n_targets")


def suggested_tests(primary: DataFrame, unique: DataFrame, not_null: DataFrame, guessed: DataFrame, directed: DataFrame, joins: DataFrame) -> DataFrame:
    """R11 in full: tests that are missing, with the reason.

    ``primary(scope, entity, columns, basis)``, ``unique(scope, entity, columns)`` tested or declared, ``not_null(scope, entity, column)``,
    ``guessed(scope, entity, column, to, to_column)`` from names, ``directed(scope, entity, column)`` relationships from facts,
    ``joins(scope, entity, column, reader)``: columns that a reader joins on.

    Returns ``scope, entity, column, test, reason, detail``: columns of guessed keys (``untested_key``), unique columns that may be
    null (``unique_but_nullable``), guessed relationships (``untested_relationship``, the detail is what they point to), and
    join columns without any test (``untested_join``, the detail is the number of readers). A guessed key is no test.
    """
    at = ["scope", "entity", "column"]
    row = lambda df, test, reason, detail: df.select(*at, F.lit(test).alias("test"), F.lit(reason).alias("reason"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    flat = lambda df: df.select("scope", "entity", F.explode("columns").alias("column")).distinct()
    untested = row(flat(primary.where(F.col("basis") == BASIS["inferred"])), "unique+not_null", "untested_key", none)
    filled = not_null.select(*at).unionByName(flat(primary.where(F.col("basis") > BASIS["inferred"]))).distinct()
    nullable = row(flat(unique.where(F.size("columns") == 1)).join(filled, at, "left_anti"), "not_null", "unique_but_nullable", none)
    loose = row(guessed, "relationship", "untested_relationship", F.concat_ws(".", "to", "to_column"))
    tested = filled.unionByName(directed.select(*at)).unionByName(flat(unique)).select("scope", "entity", F.lower("column").alias("key")).distinct()
    used = joins.withColumn("key", F.lower("column")).groupBy("scope", "entity", "key").agg(F.min("column").alias("column"), F.countDistinct("reader").cast("string").alias("n"))
    bare = row(used.join(tested, ["scope", "entity", "key"], "left_anti"), "not_null", "untested_join", F.col("n"))
    return untested.unionByName(nullable).unionByName(loose).unionByName(bare)
