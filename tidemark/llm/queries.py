"""The ``opN_<name>`` queries over the test tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, fim, licenses, lm, minhash, packing, pq, quality, rules, token_counts, topk, toxicity, warc
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: One vocabulary in the formats of two libraries.
BYTE_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@query("""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20""")
def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *(public_tokenizers.path(n) for n in BYTE_BPE))


@query("""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to
FROM f""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT doc_id, words, len(words) AS n_words, coalesce(list_sum([length(x) for x in words]), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
    len([x for x in words if regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')]) AS n_loud_words,
    len([x for x in words if contains(x, '!!')]) AS n_exclaims,
    len([i for i in range(2, len(words) + 1) if words[i] = words[i - 1]]) AS n_stutters
  FROM w),
g AS (SELECT doc_id, i, words[i:i + 4] AS g FROM (
  SELECT doc_id, words, unnest(range(1, n_words - 3)) AS i FROM m WHERE n_words >= 5)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
f AS (
  SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_loud_words > 40 * n_words
    OR 100 * n_exclaims > 40 * n_words OR 100 * n_stutters > 20 * n_words OR word_chars < 2 * n_words
    OR word_chars > 25 * n_words) AS kept
FROM b"""


@query(QUALITY_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(rules.BASE).cast("long")) != 0
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return kept.select("doc_id", *names, base.alias("base_failed"), "kept")


@query()
def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query()
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The scan in SQL. Known texts stand in it as text and go through the same canonical form."""
    def canonical(x: str) -> str:
        out = f"lower({x})"
        out = rf"regexp_replace({out}, '(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*(\d{{4}}|all rights reserved)[^\n]*$', '', 'g')"
        out = rf"regexp_replace({out}, '(?m)^[ \t#*/;-]*all rights reserved[. \t]*$', '', 'g')"
        out = rf"regexp_replace({out}, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
        for found, same in licenses.SPELLINGS:
            out = f"replace({out}, '{found}', '{same}')"
        return out

    joined = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))".replace("\\\\", "\\")
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licenses.KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license_id, sha256({joined.format(canonical('t'))}) AS digest FROM (VALUES {known}) AS k(license_id, t)),
c AS (SELECT doc_id, {canonical('text')} AS lines FROM documents),
w AS (SELECT doc_id, lines, CASE WHEN {joined.format('lines')} <> '' THEN sha256({joined.format('lines')}) END AS digest FROM c),
l AS (SELECT DISTINCT doc_id, digest, trim(unnest(string_split(lines, chr(10)))) AS line FROM w),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM l JOIN known ON sha256(l.line) = known.digest GROUP BY doc_id)
SELECT doc_id, w.digest, k.license_id, n.notices
FROM w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN n USING (doc_id)"""


@query(_license_sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of whole documents and of their lines."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, t, w, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, t, n, form, array_to_string(w[:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
    array_to_string(w[b + 1:], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(fim.store(table(spark, sf_dir, "documents"))))


def _codebook_sql(rounds: int = pq.ROUNDS, parts: int = pq.PARTS, entries: int = pq.ENTRIES) -> str:
    """The whole procedure unrolled: parts, first entries, then assignment and means by turns."""
    steps = [f"""
k AS (SELECT vec_id, label, embedding AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
i AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT) for y in x] AS v, len(x) // {parts} AS l FROM k),
q AS MATERIALIZED (SELECT vec_id, label, p, v[p * l + 1:(p + 1) * l] AS v FROM i, range({parts}) AS r(p)),
c0 AS MATERIALIZED (SELECT p, e, v FROM (
  SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM q) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, e, d FROM (
  SELECT vec_id, label, q.p, q.v, c.e, list_sum([(q.v[j] - c.v[j]) * (q.v[j] - c.v[j]) for j in range(1, len(q.v) + 1)]) AS d
  FROM q JOIN c{r} c ON q.p = c.p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT p, e, j, CAST(floor(CAST(sum(v[j]) AS DOUBLE) / count(*)) AS BIGINT) AS m
  FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS j FROM a{r}) GROUP BY p, e, j),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c
  LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS v FROM s{r} GROUP BY p, e) m ON c.p = m.p AND c.e = m.e)""")
    return "WITH" + ",".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h"""


@query(_codebook_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.compress(table(spark, sf_dir, "embeddings"))


@query()
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))
