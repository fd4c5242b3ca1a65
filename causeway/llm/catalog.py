"""The queries of this package. Tokenizer files are parameters; the defaults are those of the public package."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import bpe, fingerprints, jaccard, lexical, mtree, packing, ppm, quality, substrings, token_counts, toxicity, warc, whitening
from causeway.llm.common import table

QUERIES = {}
SQL = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Where the package is not installed on the executors, their Python finds it beside this file.
            paths = spark.sparkContext.environment
            if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
                paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), ROOT]))
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_bpe")
def op1_bpe(spark, sf_dir, path=None):
    return bpe.digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
win AS (SELECT p.doc_id, p.p, array_to_string(d.w[p.p : p.p + 12], ' ') AS t FROM places p JOIN d USING (doc_id)),
first AS (SELECT t, min(doc_id) AS owner FROM win GROUP BY t),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(p, p + 13)) AS i FROM win JOIN first USING (t) WHERE owner < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op3_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4_packing(spark, sf_dir, ranks=None):
    return packing.pack(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_ppm_scores")
def op5_ppm_scores(spark, sf_dir):
    return ppm.score_documents(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir, ranks=None):
    """Each document with its source put in front, 20 characters replaced in the middle and its end cut off."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda place, deleted, inserted: F.struct(
        place.cast("long").alias("place"), deleted.cast("long").alias("deleted"), inserted.alias("inserted"))
    edits = F.array(edit(F.lit(0), F.lit(0), F.concat(F.coalesce("source", F.lit("")), F.lit(": "))),
                    edit(F.expr("length(text) div 2"), F.lit(20), F.lit("[edited here]")), edit(n - 10, F.lit(100), F.lit("")))
    return token_counts.count_with_edits(table(spark, sf_dir, "documents"), edits, ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                         public_tokenizers.PATTERN)


@query("op8_quality")
def op8_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_fingerprints")
def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents"))


@query("op10_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op10_top_k(spark, sf_dir):
    vectors = mtree.whole_numbers(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.whiten(whitening.whole_numbers(table(spark, sf_dir, "embeddings")), components=32)


@query("op12_warc", """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f""")
def op12_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op13_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
wanted AS (SELECT DISTINCT i, item_id, unnest(t) AS term FROM i),
word AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM word WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
gain AS (SELECT tf.*, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // l))) AS gain
         FROM tf JOIN df USING (term), total),
s AS (SELECT i, item_id, r, doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gain USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op13_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
