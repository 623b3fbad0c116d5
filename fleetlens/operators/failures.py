"""Errors: classification, suggestions, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import error_category
from fleetlens.plans.fixpoint import fixpoint, near
from fleetlens.plans.shared import cut, table

#: Characters of a key by which phrases and messages meet.
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct substrings of ``size`` characters; none of a shorter text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """Each pattern under one key: of its phrases' substrings of three characters the one fewest patterns have.

    A message that a pattern fits holds its key. Patterns whose phrases are all shorter have the empty key.
    """
    low = patterns.withColumn("phrases", F.transform(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: F.lower(p)))
    each = low.select("catalogue_rank", "ordinal", F.explode(F.array_distinct(F.flatten(F.transform("phrases", lambda p: grams(p))))).alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(common, "key").groupBy("catalogue_rank", "ordinal").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    return low.join(best, ["catalogue_rank", "ordinal"], "left").withColumn("key", F.coalesce("key", F.lit("")))


def classify_errors(errors: DataFrame, patterns: DataFrame) -> DataFrame:
    """The first pattern whose kind fits and whose phrases all stand in the message, ignoring case.

    ``errors(kind, message, ...)``, ``patterns(catalogue_rank, ordinal, pattern, kind NULL = any, phrases
    ARRAY, symptom, category)``, where (rank, ordinal) is unique. An inverted index: distinct messages meet
    the patterns by key in an equi join, so the plan doesn't grow with the patterns; what meets is verified,
    and the first by (rank, ordinal) kept. Without a match the kind's category counts. Returns the errors'
    columns with ``pattern, symptom, category``.
    """
    once = errors.select("kind", "message").distinct()
    keys = F.array_append(grams(F.lower(F.coalesce("message", F.lit("")))), F.lit(""))
    p = pattern_keys(patterns).select("key", "catalogue_rank", "ordinal", "pattern", F.col("kind").alias("of_kind"), "phrases", "symptom", "category")
    met = once.withColumn("low", F.lower(F.coalesce("message", F.lit("")))).withColumn("key", F.explode(keys)).join(p, "key")
    met = met.where((F.col("of_kind").isNull() | (F.col("of_kind") == F.col("kind"))) & F.forall("phrases", lambda x: F.contains(F.col("low"), x)))
    first = met.groupBy("kind", "message").agg(F.min_by(F.struct("pattern", "symptom", "category"), F.struct("catalogue_rank", "ordinal")).alias("m"))
    first = first.select(F.col("kind").alias("k"), F.col("message").alias("t"), "m")
    out = errors.join(first, F.col("kind").eqNullSafe(F.col("k")) & F.col("message").eqNullSafe(F.col("t")), "left").drop("k", "t")
    return out.select(
        *errors.columns, F.col("m.pattern").alias("pattern"), F.coalesce("m.symptom", F.lit("unrecognised")).alias("symptom"), F.coalesce("m.category", error_category(F.col("kind"))).alias("category")
    )


def did_you_mean(names: DataFrame, candidates: DataFrame, most: int = 3, edits: int = 2) -> DataFrame:
    """Up to three candidates within two edits of a name, ignoring case, best first.

    A candidate is cut into ``edits + 1`` segments, and one of them stands unchanged, shifted by ``edits``
    places at most, in every string within so many edits. So a candidate has ``edits + 1`` keys, and a name,
    whatever its length, ``(edits + 1) * (2 * edits + 1)^2``: for each length that a candidate may have, each
    segment and each shift. No pair is made that doesn't share one.
    """
    parts = edits + 1
    begin = lambda length, i: F.floor(length * F.lit(i) / parts).cast("int")
    key = lambda length, i, text: F.concat_ws("|", length.cast("string"), F.lit(str(i)), text)

    def own(c: Column) -> Column:
        n = F.length(c)
        return F.array(*[key(n, i, F.substring(c, begin(n, i) + 1, begin(n, i + 1) - begin(n, i))) for i in range(parts)])

    def probes(c: Column) -> Column:
        found = []
        for longer in range(-edits, edits + 1):
            n = F.length(c) + longer
            for i in range(parts):
                size = begin(n, i + 1) - begin(n, i)
                for shift in range(-edits, edits + 1):
                    at = begin(n, i) + shift
                    found.append(F.when((n >= 0) & (at >= 0) & (at + size <= F.length(c)), key(n, i, F.substring(c, at + 1, size))))
        return F.array_distinct(F.array_compact(F.array(*found)))

    n = names.select("scope", "name", F.explode(probes(F.lower("name"))).alias("key"))
    c = candidates.select("scope", "candidate", F.explode(own(F.lower("candidate"))).alias("key"))
    j = n.join(c, ["scope", "key"]).select("scope", "name", "candidate").distinct()
    d = F.levenshtein(F.lower("name"), F.lower("candidate"), edits)
    j = j.withColumn("distance", d).where((F.col("distance") >= 0) & (F.col("name") != F.col("candidate")))
    w = Window.partitionBy("scope", "name").orderBy("distance", "candidate")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def failed_nodes(results: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes in error with no failed check that covers them, and the checks that failed."""
    failed = checks.where("status = 'failed'")
    covered = failed.select("scope", "run_id", "node").distinct()
    return results.where("status = 'error'").join(covered, ["scope", "run_id", "node"], "left_anti").select("scope", "run_id", "node"), failed


def explanations(failed: DataFrame, classified: DataFrame, history: DataFrame, blocked: DataFrame) -> DataFrame:
    """Category, symptom, confidence (a known pattern, the kind alone, or none), history and impact of each failure.

    ``failed(error_id, scope, node)``, ``classified(error_id, pattern, symptom, category)``.
    """
    j = failed.join(classified, "error_id", "left").join(history, ["scope", "node"], "left").join(blocked, ["scope", "node"], "left")
    confidence = F.when(F.col("pattern").isNotNull(), "known_pattern").when(F.col("category") != "unknown", "kind").otherwise("none")
    evidence = F.concat_ws(";", F.when(F.col("pattern").isNotNull(), F.concat(F.lit("pattern="), "pattern")), F.when(F.col("failed") > 1, F.concat(F.lit("failed_before="), F.col("failed") - 1)))
    return j.select("scope", "node", "category", "symptom", confidence.alias("confidence"), evidence.alias("evidence"), F.coalesce("n_blocked", F.lit(0)).alias("n_blocked"))


def search(items: DataFrame, text: str, most: int) -> DataFrame:
    """The best matches of a name: equal, then begins with, then contains; ties by length and name."""
    n, q = F.lower("name"), F.lit(text.lower())
    score = F.when(n == q, 3).when(F.startswith(n, q), 2).when(F.contains(n, q), 1)
    return items.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), F.length("name"), "name", "id").limit(most)


class SearchIndex:
    """Postings of short substrings, written once, for searches by terms.

    ``items(item, label, haystack, ...)``: what to show, and the text in which every term must stand.
    Postings hold each substring of one to three characters of the lower-cased haystack once an item.
    """

    def __init__(self, items: DataFrame):
        low = items.withColumn("haystack", F.lower(F.coalesce("haystack", F.lit(""))))
        self.items = table(low, "search_items")
        every = F.concat(*[grams(F.col("haystack"), n) for n in range(1, GRAM + 1)])
        self.postings = table(self.items.select("item", F.explode(every).alias("gram")), "search_postings")
        self.sizes = table(self.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "search_sizes")

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        """The best ``most`` items of each ``queries(query, text)``, all terms in their haystack, ignoring case.

        A haystack that begins with the whole text comes first, then the shorter label, then the smaller
        label and item. A query without terms finds nothing. The rarest substring over all terms of a
        query gives the candidates, by an equi join; the other terms are verified on them.
        """
        q = queries.select("query", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("text"))
        q = q.withColumn("terms", F.array_distinct(F.array_remove(F.split("text", r"\s+"), ""))).where(F.size("terms") > 0)
        of_term = lambda t: F.when(F.length(t) >= GRAM, grams(t)).otherwise(F.array(t))
        keys = q.select("query", F.explode(F.flatten(F.transform("terms", of_term))).alias("gram")).distinct().join(self.sizes, "gram", "left")
        rare = keys.groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        asked = cut(rare.join(q, "query"))
        # few queries go to the postings, so that no task gathers all postings of one substring
        met = near(asked, asked.count()).join(self.postings, "gram").join(self.items, "item")
        met = met.where(F.forall("terms", lambda t: F.contains(F.col("haystack"), t))).withColumn("prefix", F.startswith("haystack", "text"))
        w = Window.partitionBy("query").orderBy(F.desc("prefix"), F.length("label"), "label", "item")
        found = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
        return found.select("query", "rank", *[c for c in self.items.columns if c != "haystack"])


def metric_closure(reads: DataFrame) -> DataFrame:
    """Everything that each metric reads, through metrics: ``reads([scope,] metric, reads)``; scopes stay apart."""
    within = ["scope"] if "scope" in reads.columns else []
    e = cut(reads.select(*within, F.col("metric").alias("at"), F.col("reads").alias("next")).distinct())
    seed = reads.select(*within, "metric", F.col("reads").alias("at"))
    step = lambda f: f.join(e, [*within, "at"]).select(*within, "metric", F.col("next").alias("at"))
    return fixpoint(seed, step, [*within, "metric", "at"]).select(*within, "metric", F.col("at").alias("reads"))
