"""Evidence, pseudonyms and model replies."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from causeway.catalog.logview import LV, TEXT_COLUMNS, log_view, quote, table
from causeway.catalog.registry import query
from causeway.functions.text import row_to_text
from causeway.operators import evidence, pseudonyms, replies
from causeway.rules import EVIDENCE_PATTERNS, PSEUDONYM_KINDS, REPLY_KEYS, REPLY_SECTIONS


def evidence_sql(source: str, columns, key: str = "", any_case: bool = False) -> str:
    flag = "(?i)" if any_case else ""
    parts = [f"SELECT {key}'{kind}' AS kind, unnest(regexp_extract_all({c}, {quote(flag + p)})) AS value FROM {source}"
             for kind, p in EVIDENCE_PATTERNS.items() for c in columns]
    return f"SELECT DISTINCT {key}kind, value FROM ({' UNION ALL '.join(parts)})"


@query("network_evidence", f"WITH {LV} {evidence_sql('lv', TEXT_COLUMNS)}")
def _(spark, sf_dir):
    return evidence.network_evidence(log_view(spark, sf_dir))


@query("network_evidence_per_host", f"WITH {LV} {evidence_sql('lv', TEXT_COLUMNS, 'host, ', True)}")
def _(spark, sf_dir):
    return evidence.network_evidence(log_view(spark, sf_dir), ["host"], ignore_case=True)


@query("network_evidence_documents", evidence_sql("documents", ["text", "lang", "source"]))
@query("network_evidence_documents_whole", evidence_sql("documents", ["text", "lang", "source"]))
def _(spark, sf_dir):
    return evidence.network_evidence(table(spark, sf_dir, "documents"))


@query("network_evidence_pages", evidence_sql("pages", ["url", "html"]))
@query("network_evidence_pages_whole", evidence_sql("pages", ["url", "html"]))
def _(spark, sf_dir):
    return evidence.network_evidence(table(spark, sf_dir, "pages"), columns=["url", "html"])


@query("evidence_summary", f"""WITH {LV}, e AS ({evidence_sql('lv', TEXT_COLUMNS, 'host, ')}),
    r AS (SELECT *, row_number() OVER (PARTITION BY host, kind ORDER BY value) AS k, count(*) OVER (PARTITION BY host, kind) AS n FROM e)
    SELECT host, kind, n AS distinct_values, string_agg(value, '|' ORDER BY value) AS shown_values FROM r WHERE k <= 30 GROUP BY host, kind, n""")
def _(spark, sf_dir):
    found = evidence.evidence_summary(evidence.network_evidence(log_view(spark, sf_dir), ["host"]), ["host"])
    return found.withColumn("shown_values", F.array_join("shown_values", "|"))


def pseudonym_ctes(source: str, order: str, text: str) -> str:
    """CTEs t0 ... t4 (the texts after each kind) and m1 ... m4 (the dictionaries)."""
    out = [f"t0 AS (SELECT {order} AS o, {text} AS t FROM {source})"]
    for i, (kind, (pattern, any_case, prefix)) in enumerate(PSEUDONYM_KINDS.items(), 1):
        p = quote(("(?i)" if any_case else "") + pattern)
        out.append(f"""x{i} AS (SELECT o, unnest(regexp_extract_all(t, {p})) AS value, generate_subscripts(regexp_extract_all(t, {p}), 1) AS p FROM t{i - 1}),
    m{i} AS (SELECT '{kind}' AS kind, value, '{prefix}-' || row_number() OVER (ORDER BY first_pos) AS pseudonym
        FROM (SELECT value, min((o, p)) AS first_pos FROM x{i} GROUP BY value)),
    d{i} AS (SELECT coalesce(map(list(value), list(pseudonym)), MAP {{}}) AS names FROM m{i}),
    t{i} AS (SELECT o, array_to_string(list_transform(string_split_regex(t, {p}), lambda piece, j:
        piece || coalesce(names[regexp_extract_all(t, {p})[j]], '')), '') AS t FROM t{i - 1}, d{i})""")
    return ",\n".join(out)


DICTIONARY = " UNION ALL ".join(f"SELECT kind, value, pseudonym FROM m{i}" for i in range(1, len(PSEUDONYM_KINDS) + 1))
_DOCS = pseudonym_ctes("documents", "doc_id", "text")
_ROW_TEXT = "concat_ws(' | ', 'event_id=' || event_id, 'timestamp=' || \"timestamp\", " + ", ".join(
    f"CASE WHEN {c} <> '' THEN '{c}=' || {c} END" for c in TEXT_COLUMNS) + ")"
_ROWS = f"{LV}, lt AS (SELECT event_id, {_ROW_TEXT} AS txt FROM lv), {pseudonym_ctes('lt', 'event_id', 'txt')}"


def row_texts(spark, sf_dir):
    df = log_view(spark, sf_dir)
    return df.select("event_id", row_to_text(df.columns, None).alias("txt"))


@query("pseudonymize", f"WITH {_DOCS} SELECT o AS doc_id, t AS text FROM t4")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, "text", "doc_id")[0]


@query("pseudonym_map", f"WITH {_DOCS} {DICTIONARY}")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, "text", "doc_id")[1]


@query("pseudonymize_rows", f"WITH {_ROWS} SELECT o AS event_id, t AS txt FROM t4")
def _(spark, sf_dir):
    return pseudonyms.pseudonymize(row_texts(spark, sf_dir), "txt", "event_id")[0]


@query("pseudonym_map_rows", f"WITH {_ROWS} {DICTIONARY}")
def _(spark, sf_dir):
    return pseudonyms.pseudonymize(row_texts(spark, sf_dir), "txt", "event_id")[1]


# Replies written from the documents: sound ones and ones with the faults models make.
_CLEAN = "regexp_replace(text, '[^A-Za-z0-9 .,]', ' '{})"
_REPLY = """'{{"root_cause_probabile": "' || source || '", "confidenza": "ALTA", "motivazione": "' || {clean} || '", "cause_alternative": ["' || lang
    || ' 1", " ", "' || lang || ' 2"], "evidenze_chiave": "' || source || '", "evidenze_deboli": [], "evidenze_mancanti": ["RAM"], "prossimi_controlli": ["dmesg", "'
    || CAST(n_chars AS {string}) || '"], "rischio_falso_positivo": "BASSO", "raccomandazione_operativa": "ok"}}'"""


def _reply_sql(clean: str, string: str) -> str:
    full = _REPLY.format(clean=clean, string=string)
    return f"""CASE doc_id % 8 WHEN 0 THEN r WHEN 1 THEN replace(r, '"confidenza": "ALTA", ', '') WHEN 2 THEN 'noise ' || r WHEN 3 THEN r || ' tail}}'
        WHEN 4 THEN substring(r, 1, length(r) - 20) WHEN 5 THEN 'no json' WHEN 6 THEN '' ELSE '[1, 2]' END""", full


# The same class with its characters one by one: Java tests these by one table, ranges one after the other.
_CASES, _FULL_SPARK = _reply_sql(_CLEAN.format("").replace("A-Za-z0-9", string.ascii_letters + string.digits), "STRING")
_, _FULL_SQL = _reply_sql(_CLEAN.format(", 'g'"), "VARCHAR")


def model_replies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("r", F.expr(_FULL_SPARK))
    return docs.select(F.col("doc_id").alias("reply_id"), F.expr(_CASES).alias("reply"))


_AUDIT = f"""rp AS (SELECT doc_id AS reply_id, {_CASES} AS reply FROM (SELECT *, {_FULL_SQL} AS r FROM documents)),
    st AS (SELECT *, strpos(reply, '{{') AS a, json_valid(reply) AS whole FROM rp),
    sv AS (SELECT *, CASE WHEN whole THEN reply WHEN a > 0 THEN list_filter(list_transform(list_reverse_sort(list_filter(
        generate_series(a + 1, length(reply)), lambda i: substr(reply, i, 1) = '}}')), lambda e: substr(reply, a, e - a + 1)), lambda s: json_valid(s))[1] END AS body FROM st),
    ky AS (SELECT *, CASE WHEN json_type(body) = 'OBJECT' THEN json_keys(body) ELSE [] END AS keys FROM sv),
    au AS (SELECT reply_id, body, list_filter([{', '.join(quote(k) for k in REPLY_KEYS)}], lambda k: NOT list_contains(keys, k)) AS missing,
        CASE WHEN reply = '' THEN 'empty' WHEN body IS NULL THEN 'unreadable' WHEN len(missing) > 0 THEN 'missing_keys' END AS reason FROM ky)"""


@query("audit_model_replies", f"""WITH {_AUDIT} SELECT reply_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'error' END AS status, reason,
    array_to_string(missing, '|') AS missing_keys, CASE WHEN reason IS NULL THEN body END AS analysis FROM au""")
def _(spark, sf_dir):
    found = replies.audit_replies(model_replies(spark, sf_dir), "reply")
    return found.select("reply_id", "status", "reason", F.array_join("missing_keys", "|").alias("missing_keys"), "analysis")


_ITEMS = " UNION ALL ".join(f"""SELECT reply_id, '{s}' AS section, CASE WHEN json_type(body, '$.{s}') = 'ARRAY' THEN CAST(json_extract(body, '$.{s}') AS VARCHAR[])
    ELSE [json_extract_string(body, '$.{s}')] END AS items FROM au WHERE reason IS NULL""" for s in REPLY_SECTIONS)


@query("flatten_review", f"""WITH {_AUDIT}, it AS ({_ITEMS}), fl AS (SELECT reply_id, section, list_filter(items, lambda x: trim(x) <> '') AS items FROM it)
    SELECT reply_id, section, CAST(generate_subscripts(items, 1) AS INTEGER) AS item_no, unnest(items) AS item FROM fl""")
def _(spark, sf_dir):
    return replies.flatten_review(replies.audit_replies(model_replies(spark, sf_dir), "reply"), ["reply_id"])

