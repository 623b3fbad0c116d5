"""Scalar functions as Column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of each duration unit.
UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800}


def parse_duration(text: Column) -> Column:
    """``45m``, ``1d 2h``, ``2 hours``, a bare number of seconds; anything else is null."""
    t = F.lower(F.trim(text))
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    names = "|".join(sorted(UNITS, key=len, reverse=True))
    numbers = F.regexp_extract_all(t, F.lit(rf"([0-9]+)\s*({names})"), F.lit(1))
    kinds = F.regexp_extract_all(t, F.lit(rf"([0-9]+)\s*({names})"), F.lit(2))
    total = F.aggregate(F.zip_with(numbers, kinds, lambda n, k: n.try_cast("bigint") * F.try_element_at(units, k)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint")).when(t.rlike(rf"^([0-9]+\s*({names})\s*)+$"), total)


def format_duration(seconds: Column) -> Column:
    """``1w2d3h``, largest units first; ``0s``."""
    out, rest = [], seconds
    for name, size in (("w", 604800), ("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n = F.floor(rest / size)
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise(""))
        rest = rest % size
    return F.when(seconds == 0, "0s").otherwise(F.concat(*out))


def human_ms(ms: Column) -> Column:
    """``850ms``, ``4.2s``, ``2m 05s``; halves round up."""
    tenths = F.floor((ms + 50) / 100)
    seconds = F.floor((ms + 500) / 1000)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    long = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(tenths < 600, short).otherwise(long)


def redact_literals(text: Column, placeholder: str = "[value removed]") -> Column:
    """quoted spans and standalone numbers give way to a placeholder; unreadable quoting cuts the text at the quote."""
    odd = lambda q: F.length(F.regexp_replace(text, f"[^{q}]", "")) % 2 == 1
    safe = F.when(odd("'") | odd('"'), F.concat(F.regexp_replace(text, "(?s)['\"].*$", ""), F.lit(placeholder))).otherwise(text)
    out = F.regexp_replace(safe, "'[^']*'|\"[^\"]*\"", placeholder)
    return F.regexp_replace(out, r"\b[0-9]+(\.[0-9]+)?\b", placeholder)


def summary_line(text: Column, most: int, numbers: bool = False) -> Column:
    """F5 / F6 (``numbers=True`` keeps them): first non-blank line without literals, cut where SQL starts."""
    line = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*([^ \t\r\n][^\r\n]*)", 1))
    line = F.regexp_replace(line, r"[\x00-\x1f]", " ")
    line = F.trim(F.regexp_replace(line, r"(?i)\b(select|insert into|create table|create view|merge into|with [a-z_]+ as)\b.*$", ""))
    line = F.regexp_replace(line, "'[^']*'|\"[^\"]*\"", "[value removed]") if numbers else redact_literals(line)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def quoted(text: Column, placeholder: str) -> Column:
    """quoted spans, with doubled quotes inside, give way to a placeholder."""
    return F.regexp_replace(text, "'([^']|'')*'|\"([^\"]|\"\")*\"", placeholder)


# Coarse category of an engine's error kind.
CATEGORIES = {"Binder Error": "model", "Catalog Error": "missing_relation", "Parser Error": "syntax", "Database Error": "warehouse", "Runtime Error": "runtime", "Compilation Error": "compilation", "Conversion Error": "data", "Constraint Error": "data", "Permission Error": "access"}


def error_category(kind: Column) -> Column:
    """F8."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("unknown"))


def header_kind(line: Column) -> Column:
    """``Runtime Error in model x (path)`` to the kind; null for other lines."""
    kind = F.regexp_extract(line, r"^([A-Z][A-Za-z]+ Error)( in |:|$)", 1)
    return F.when(kind != "", kind)


def error_line(text: Column) -> Column:
    """the line number that a message names."""
    return F.regexp_extract(text, r"(?i)\bline:? ([0-9]+)", 1).try_cast("bigint")


# Engine words for a node's end.
STATUSES = {"success": "success", "pass": "success", "error": "error", "fail": "error", "runtime error": "error", "skipped": "skipped", "warn": "success", "partial success": "error"}


def status_map(word: Column) -> Column:
    """an unknown word is ``unknown``; no word is null."""
    table = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    return F.when(word.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(word)), F.lit("unknown")))


def whole_number(text: Column) -> Column:
    """JSON ``4.0`` is 4; fractions, non-finite and negative numbers are null."""
    x = text.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x) & (x < 9e15) & (x == F.floor(x)), x.cast("bigint"))


def seconds_to_ms(text: Column) -> Column:
    """seconds to whole milliseconds, null if negative or not finite."""
    x = text.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x) & (x < 9e12), F.floor(x * 1000 + 0.5).cast("bigint"))


def sha256_hex(text: Column) -> Column:
    """F12."""
    return F.sha2(text, 256)


def parse_timestamp(text: Column) -> Column:
    """RFC 3339, with ``Z`` or an offset or none, in UTC; bad text is null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"), text.try_cast("timestamp"))


def millis_since(later: Column, earlier: Column) -> Column:
    """null if negative."""
    ms = F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1000)
    return F.when(ms >= 0, ms)


def name_forms(name: Column) -> Column:
    """``stg_orders`` to the names an entity may go by: itself, without its layer prefix, singular."""
    base = F.regexp_replace(F.lower(name), "^(stg|dim|fct|fact|int|raw|base)_", "")
    singular = F.when(base.rlike("ies$"), F.regexp_replace(base, "ies$", "y")).when(base.rlike("(ss|us|is)$"), base).otherwise(F.regexp_replace(base, "s$", ""))
    return F.array_distinct(F.array(F.lower(name), base, singular))


def stable_uuid(text: Column) -> Column:
    """F16: a name-based id: SHA-256 cut to 128 bits, with the version and variant bits of a version 5 UUID."""
    h = F.sha2(text, 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def relation_name(text: Column) -> Column:
    """a dotted name's parts; null if any is blank."""
    parts = F.split(text, r"\.")
    return F.when(~F.exists(parts, lambda p: F.trim(p) == ""), parts)


def normalize_sql_digest(sql: Column) -> Column:
    """a digest that ignores comments and white space; text with quotes is hashed as it is."""
    plain = F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.sha2(F.when(sql.rlike("['\"`$]|\\{\\{|\\{%"), sql).otherwise(plain), 256)


def strip_credentials(location: Column) -> Column:
    """without ``user:password@`` and token parameters."""
    return F.regexp_replace(F.regexp_replace(location, "//[^/@]*@", "//"), r"(?i)([?&])(token|password|secret|sig)=[^&]*", "$1")


def explorer_link(host: Column, relation: Column) -> Column:
    """a three-part relation's page; none if parts or host are invalid."""
    parts = relation_name(relation)
    fine = host.rlike(r"^[a-z0-9.-]+$") & (F.size(parts) == 3)
    return F.when(fine, F.concat(F.lit("https://"), host, F.lit("/explore/data/"), F.array_join(F.transform(parts, lambda p: F.url_encode(p)), "/")))


def check_handle(check_id: Column) -> Column:
    """a short stable handle."""
    return F.substring(F.sha2(check_id, 256), 1, 10)


def lag_policy(config: Column) -> Column:
    """lag seconds, quorum, and the unknown settings of a node's config JSON; several spellings."""
    lag = F.coalesce(F.get_json_object(config, "$.state.lag_tolerance"), F.get_json_object(config, "$.build_after.lag"), F.get_json_object(config, "$.lag_tolerance"))
    quorum = F.lower(F.coalesce(F.get_json_object(config, "$.state.quorum"), F.get_json_object(config, "$.build_after.updates_on")))
    known = F.array(*[F.lit(k) for k in ("state", "build_after", "lag_tolerance")])
    unknown = F.array_sort(F.array_except(F.coalesce(F.json_object_keys(config), F.array().cast("array<string>")), known))
    return F.struct(F.coalesce(parse_duration(lag), F.lit(0)).alias("lag_s"), F.when(quorum.isin("any", "all"), quorum).otherwise(F.lit("any")).alias("quorum"), unknown.alias("unknown"))


def cache_key(*parts: Column) -> Column:
    """a hash over length-prefixed parts, so that no two lists of parts share one text."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def delta_version(format_: Column, table_id: Column, version: Column) -> Column:
    """``<table id>/<version>``, unknown (null) unless the format is delta and both are there."""
    return F.when(F.lower(format_) == "delta", F.concat(table_id, F.lit("/"), version.cast("string")))


def canonical_json(settings: Column) -> Column:
    """a map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(settings))))


def kleene(condition: Column) -> Column:
    """A three-valued condition as pass, fail or unknown; build it with ``number`` for untrusted text."""
    return F.when(condition, "pass").when(~condition, "fail").otherwise("unknown")


def number(text: Column) -> Column:
    """A number, or null (unknown) for text that is none, NaN or infinite."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def usable_run_id(text: Column) -> Column:
    """Whether a run id is safe as a file name."""
    device = text.rlike(r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$")
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$") & ~device & ~text.endswith("."), F.lit(False))
