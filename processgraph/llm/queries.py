"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from processgraph.llm import bpe, fingerprint, html, langid, lm, mtree, neardup, packing, pii, quality


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return mtree.neighbours(_read(spark, sf_dir, "embeddings"), every=100)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids as text, with blanks between."""
    return bpe.encode(_read(spark, sf_dir, "documents")).withColumn("ids", F.array_join("ids", " "))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(_read(spark, sf_dir, "documents"), stored=True)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_spans, op2_near_duplicates, op3_quality, op4_nearest_vectors, op5_byte_bpe, op6_html_text, op7_fingerprints, op8_language_model, op9_personal_data, op10_packing)
}
#: White space as the vocabulary's pattern has it.
_BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The others rest on trained models, hashes or searches that SQL doesn't express; tests compare them with brute force.
SQL: dict[str, str] = {
    "op4_nearest_vectors": """
        SELECT vec_id, rank, neighbor_id, round(d, 6) AS distance FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM (
            SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0))
        WHERE rank <= 10
    """,
    # one contraction a round for each word, the leftmost pair of least rank; white space before a word leaves it its last sign
    "op5_byte_bpe": rf"""
        WITH RECURSIVE vocab AS (
          SELECT lower(hex(from_base64(t))) AS h, r::INTEGER AS tok FROM read_csv('{bpe.VOCABULARY}', delim=' ', header=false, quote='', escape='', columns={{'t': 'VARCHAR', 'r': 'INTEGER'}})
        ), merge AS (
          SELECT a.tok AS l, b.tok AS r, s.tok AS y FROM (SELECT h, tok, unnest(range(2, len(h), 2)) AS k FROM vocab) s JOIN vocab a ON a.h = s.h[:s.k] JOIN vocab b ON b.h = s.h[s.k + 1:]
        ), part AS (
          SELECT d, doc_id, text, generate_subscripts(p, 1) AS i, unnest(p) AS part
          FROM (SELECT row_number() OVER () AS d, doc_id, text, string_split(regexp_replace(text, '([{_BLANK}]+)([{_BLANK}][^{_BLANK}])', '\1' || chr(1114109) || '\2', 'g'), chr(1114109)) AS p FROM documents WHERE text IS NOT NULL)
        ), word AS (
          SELECT d, i, generate_subscripts(ws, 1) AS j, unnest(ws) AS w
          FROM (SELECT d, i, regexp_extract_all(part, ' ?\p{{L}}+| ?\p{{N}}+|''s|''t|''re|''ve|''m|''ll|''d| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+') AS ws FROM part)
        ), step(n, w, toks) AS (
          SELECT 0, w, list_transform(range(1, len(h), 2), lambda k: b[h[k:k + 1]]) FROM (SELECT w, lower(hex(encode(w))) AS h FROM (SELECT DISTINCT w FROM word)), (SELECT map(list(h), list(tok)) AS b FROM vocab WHERE len(h) = 2)
          UNION ALL
          SELECT n + 1, s.w, toks[:b.k % 1048576 - 1] || [(b.k // 1048576)::INTEGER] || toks[b.k % 1048576 + 2:]
          FROM step s JOIN (
            SELECT w, min(y::BIGINT * 1048576 + pos) AS k FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS pos FROM step) p JOIN merge m ON m.l = p.l AND m.r = p.r GROUP BY w) b ON b.w = s.w
        ), known AS (SELECT w, arg_max(toks, n) AS toks FROM step GROUP BY w)
        SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS ids, coalesce(len(ids), 0)::BIGINT AS n_tokens, true AS exact
        FROM (SELECT row_number() OVER () AS d, doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN (SELECT d, flatten(list(toks ORDER BY i, j)) AS ids FROM word JOIN known USING (w) GROUP BY d) USING (d)
        UNION ALL SELECT doc_id, NULL, 0, NULL FROM documents WHERE text IS NULL
    """,
}
