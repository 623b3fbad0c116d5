"""Scalar functions, applied to columns of the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from fleetlens.bindings import BINDINGS, bind, oracle
from fleetlens.functions import scalars as S

QUERIES = {}


def scalar(name: str, table: str, key: str, value: str, fn, sql: str, out: str = "out") -> None:
    """``fn`` over the SQL expression ``value`` of every row; ``sql`` is the expected expression."""

    def run(spark, sf):
        df = bind(spark, sf, table).select(F.expr(key).alias("k"), F.expr(value).alias("v"))
        return df.select("k", fn(F.col("v")).alias(out))

    q = f"SELECT {key} AS k, {sql} AS {out} FROM {table}"
    QUERIES[name] = (run, oracle(q, table) if table in BINDINGS else q)




scalar("f1_parse_duration", "part", "p_partkey",
       "CASE p_partkey % 6 WHEN 0 THEN concat(p_size, 'm') WHEN 1 THEN concat(p_size, 'd ', p_size + 1, 'h') WHEN 2 THEN concat(p_size, ' hours') WHEN 3 THEN concat('', p_size) WHEN 4 THEN concat(p_size, ' parsecs') ELSE concat('1w', p_size, 's') END", S.parse_duration,
       "CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 86400 + (p_size + 1) * 3600 WHEN 2 THEN p_size * 3600 WHEN 3 THEN p_size WHEN 4 THEN NULL ELSE 604800 + p_size END AS BIGINT)")
D = "(o_orderkey * 37 % 2000000)"
unit = lambda n, size, up: f"CASE WHEN {D} {'' if up is None else f'% {up} '}// {size} > 0 THEN CAST({D} {'' if up is None else f'% {up} '}// {size} AS VARCHAR) || '{n}' ELSE '' END"
scalar("f2_format_duration", "orders", "o_orderkey", D, S.format_duration,
       f"CASE WHEN {D} = 0 THEN '0s' ELSE " + " || ".join([unit("w", 604800, None), unit("d", 86400, 604800), unit("h", 3600, 86400), unit("m", 60, 3600), unit("s", 1, 60)]) + " END")
M = "(o_orderkey * 7919 % 400000)"
scalar("f3_human_ms", "orders", "o_orderkey", M, S.human_ms,
       f"CASE WHEN {M} < 1000 THEN CAST({M} AS VARCHAR) || 'ms' WHEN ({M} + 50) // 100 < 600 THEN CAST(({M} + 50) // 1000 AS VARCHAR) || '.' || CAST(({M} + 50) // 100 % 10 AS VARCHAR) || 's' ELSE CAST(({M} + 500) // 60000 AS VARCHAR) || 'm ' || lpad(CAST(({M} + 500) // 1000 % 60 AS VARCHAR), 2, '0') || 's' END")
MSG = "concat(kind, ' at line ', doc_id, ': ', message)"
REDACT = lambda x: f"regexp_replace(regexp_replace(CASE WHEN (length(regexp_replace({x}, '[^'']', '', 'g')) % 2 = 1) OR (length(regexp_replace({x}, '[^\"]', '', 'g')) % 2 = 1) THEN regexp_replace({x}, '(?s)[''\"].*$', '') || '[value removed]' ELSE {x} END, '''[^'']*''|\"[^\"]*\"', '[value removed]', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '[value removed]', 'g')"
scalar("f4_redact_literals", "error_messages", "doc_id", MSG, S.redact_literals, REDACT(MSG))
TXT = "concat('  ', chr(10), kind, ': ', message, ' select a from b where c = 1', chr(10), 'more')"
LINE = "trim(regexp_replace(kind || ': ' || message || ' select a from b where c = 1', '(?i)\\b(select|insert into|create table|create view|merge into|with [a-z_]+ as)\\b.*$', ''))"
CUT = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 1}) || '…' ELSE {x} END"
scalar("f5_summary_line", "error_messages", "doc_id", TXT, lambda c: S.summary_line(c, 40), CUT(REDACT(LINE), 40))
scalar("f6_value_line", "error_messages", "doc_id", TXT, lambda c: S.summary_line(c, 60, numbers=True), CUT(f"regexp_replace({LINE}, '''[^'']*''|\"[^\"]*\"', '[value removed]', 'g')", 60))
scalar("f7_quoted", "error_messages", "doc_id", "message", lambda c: S.quoted(c, "?"), "regexp_replace(message, '''([^'']|'''')*''|\"([^\"]|\"\")*\"', '?', 'g')")
scalar("f8_error_category", "error_messages", "doc_id", "kind", S.error_category, "CASE kind WHEN 'Binder Error' THEN 'model' WHEN 'Catalog Error' THEN 'missing_relation' WHEN 'Database Error' THEN 'warehouse' WHEN 'Runtime Error' THEN 'runtime' ELSE 'unknown' END")
scalar("f9_header_kind", "error_messages", "doc_id", "CASE doc_id % 3 WHEN 0 THEN concat(kind, ' in model m', doc_id, ' (models/m.sql)') WHEN 1 THEN concat(kind, ': x') ELSE message END", S.header_kind, "CASE WHEN doc_id % 3 < 2 THEN kind END")
scalar("f9_error_line", "error_messages", "doc_id", MSG, S.error_line, "doc_id")
scalar("f10_status_map", "events", "event_id", "CASE event_id % 5 WHEN 0 THEN 'Success' WHEN 1 THEN 'fail' WHEN 2 THEN 'skipped' WHEN 3 THEN event_type END", S.status_map, "CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' WHEN 3 THEN CASE event_type WHEN 'error' THEN 'error' ELSE 'unknown' END END")
scalar("f11_whole_number", "events", "event_id", "CASE event_id % 5 WHEN 0 THEN concat(event_id, '.0') WHEN 1 THEN concat(event_id, '.5') WHEN 2 THEN 'NaN' WHEN 3 THEN concat('-', event_id) ELSE concat('', event_id) END", S.whole_number, "CASE event_id % 5 WHEN 0 THEN event_id WHEN 4 THEN event_id WHEN 3 THEN CASE WHEN event_id = 0 THEN 0 END END")
scalar("f11_seconds_to_ms", "events", "event_id", "CASE event_id % 3 WHEN 0 THEN concat(event_id, '.25') WHEN 1 THEN 'Infinity' ELSE concat('-', event_id) END", S.seconds_to_ms, "CASE event_id % 3 WHEN 0 THEN event_id * 1000 + 250 END")
scalar("f12_sha256_hex", "part", "p_partkey", "p_name", S.sha256_hex, "sha256(p_name)")
scalar("f13_parse_timestamp", "orders", "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'+01:00'\") ELSE 'soon' END", lambda c: F.unix_timestamp(S.parse_timestamp(c)),
       "CAST(CASE o_orderkey % 4 WHEN 2 THEN floor(epoch(o_orderdate)) - 3600 WHEN 3 THEN NULL ELSE floor(epoch(o_orderdate)) END AS BIGINT)")
scalar("f14_millis_since", "lineitem", "l_orderkey", "l_shipdate", lambda c: S.millis_since(c, F.lit("1995-06-01").cast("timestamp")), "CASE WHEN l_shipdate >= timestamp '1995-06-01' THEN epoch_ms(l_shipdate) - epoch_ms(timestamp '1995-06-01') END")
scalar("f15_name_forms", "part", "p_partkey", "concat(CASE p_partkey % 4 WHEN 0 THEN 'stg_orders' WHEN 1 THEN 'dim_Categories' WHEN 2 THEN 'status' ELSE 'fct_items' END, CASE WHEN p_partkey % 8 < 4 THEN '' ELSE 'x' END)", lambda c: F.array_join(S.name_forms(c), ","),
       "CASE p_partkey % 8 WHEN 0 THEN 'stg_orders,orders,order' WHEN 1 THEN 'dim_categories,categories,category' WHEN 2 THEN 'status' WHEN 3 THEN 'fct_items,items,item' WHEN 4 THEN 'stg_ordersx,ordersx' WHEN 5 THEN 'dim_categoriesx,categoriesx' WHEN 6 THEN 'statusx' ELSE 'fct_itemsx,itemsx' END")
H = "sha256(p_name)"
scalar("f16_stable_uuid", "part", "p_partkey", "p_name", S.stable_uuid, f"substr({H}, 1, 8) || '-' || substr({H}, 9, 4) || '-5' || substr({H}, 14, 3) || '-' || translate(substr({H}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({H}, 18, 3) || '-' || substr({H}, 21, 12)")
scalar("f17_relation_name", "part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('db.', p_brand, '.t') WHEN 1 THEN 'a..b' ELSE p_type END", lambda c: F.size(S.relation_name(c)), "CASE p_partkey % 3 WHEN 0 THEN len(string_split('db.' || p_brand || '.t', '.')) WHEN 1 THEN NULL ELSE len(string_split(p_type, '.')) END")
scalar("f18_canonical_json", "part", "p_partkey", "map('b', p_brand, 'a', p_type)", S.canonical_json, "'{\"a\":\"' || p_type || '\",\"b\":\"' || p_brand || '\"}'")
scalar("f19_normalize_sql_digest", "part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('select  ', p_partkey, chr(10), '-- note', chr(10), 'from t') WHEN 1 THEN concat('select ', p_partkey, ' /* x', chr(10), ' */ from t') ELSE concat('select  ', chr(39), p_partkey, chr(39)) END", S.normalize_sql_digest,
       "sha256(CASE p_partkey % 3 WHEN 2 THEN 'select  ''' || p_partkey || '''' ELSE 'select ' || p_partkey || ' from t' END)")
scalar("f20_strip_credentials", "part", "p_partkey", "CASE p_partkey % 2 WHEN 0 THEN concat('s3://user:', p_brand, '@host/p?token=abc&x=1') ELSE concat('https://host/', p_partkey, '?a=1&password=p') END", S.strip_credentials,
       "CASE p_partkey % 2 WHEN 0 THEN 's3://host/p?&x=1' ELSE 'https://host/' || p_partkey || '?a=1&' END")
scalar("f21_explorer_link", "part", "p_partkey", "CASE p_partkey % 2 WHEN 0 THEN concat('main.s ', p_size, '.t') ELSE 'a.b' END", lambda c: S.explorer_link(F.lit("host.example"), c), "CASE p_partkey % 2 WHEN 0 THEN 'https://host.example/explore/data/main/s+' || p_size || '/t' END")
scalar("f22_check_handle", "part", "p_partkey", "p_name", S.check_handle, "substr(sha256(p_name), 1, 10)")
CFG = "CASE p_partkey % 4 WHEN 0 THEN concat('{\"state\": {\"lag_tolerance\": \"', p_size, 'h\", \"quorum\": \"ALL\"}}') WHEN 1 THEN concat('{\"build_after\": {\"lag\": \"', p_size, 'm\", \"updates_on\": \"any\"}, \"zeta\": 1, \"alpha\": 2}') WHEN 2 THEN '{}' ELSE NULL END"
scalar("f23_lag_policy", "part", "p_partkey", CFG, lambda c: F.concat_ws("|", S.lag_policy(c)["lag_s"].cast("string"), S.lag_policy(c)["quorum"], F.array_join(S.lag_policy(c)["unknown"], ",")),
       "CASE p_partkey % 4 WHEN 0 THEN p_size * 3600 || '|all|' WHEN 1 THEN p_size * 60 || '|any|alpha,zeta' ELSE '0|any|' END")
scalar("f24_cache_key", "part", "p_partkey", "p_name", lambda c: S.cache_key(F.lit("v1"), c), "sha256('2:v1' || strlen(p_name) || ':' || p_name)")
scalar("f25_delta_version", "part", "p_partkey", "p_brand", lambda c: S.delta_version(F.when(F.col("k") % 3 == 0, "parquet").otherwise("DELTA"), c, F.when(F.col("k") % 5 != 0, F.col("k"))), "CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN p_brand || '/' || p_partkey END")
scalar("p13_usable_run_ids", "ledger_nodes", "node", "CASE CAST(substr(node, 2) AS BIGINT) % 4 WHEN 0 THEN run_id WHEN 1 THEN concat('../', run_id) WHEN 2 THEN 'con.txt' ELSE concat(run_id, '.') END", S.usable_run_id, "CAST(substr(node, 2) AS BIGINT) % 4 = 0")
scalar("p2_pass_condition", "events", "event_id", "CASE event_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'none' ELSE concat('', event_id % 100) END", lambda c: S.kleene((S.number(c) > 50) | (F.col("k") % 10 == 0)),
       "CASE WHEN event_id % 10 = 0 THEN 'pass' WHEN event_id % 4 < 2 THEN 'unknown' WHEN event_id % 100 > 50 THEN 'pass' ELSE 'fail' END")
