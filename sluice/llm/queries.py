"""Registered queries of the operators: thin, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import codes, cutting_stock, html_extract, jaccard, langid, licenses, mixing, packing, quality, ranking, sharding, substring, topk
from sluice.plans.registry import ensure_utc
from sluice.session import ship_package
from sluice.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


@query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the n-gram log-likelihood ratio of all documents."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    found = quality.quality_rules(docs, labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "threshold")


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, from a network learned on the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
kinds AS (SELECT min(doc_id) AS kind, list(doc_id) AS members, len(any_value(s)) AS n, any_value(s) AS s
  FROM (SELECT doc_id, s, list_sort(s) AS k FROM sets WHERE len(s) > 0) GROUP BY k),
tokens AS (SELECT kind, n, unnest(s) AS t FROM kinds),
shared AS (SELECT a.kind AS a, b.kind AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.kind < b.kind
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT kind, kind FROM kinds UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS kind, min(b) AS component_id FROM reach GROUP BY a),
named AS (SELECT unnest(k.members) AS doc_id, l.component_id FROM kinds k JOIN least l USING (kind))
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(n.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN named n USING (doc_id)
"""

OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20),
grams AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM starts),
again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM grams) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM again CROSS JOIN range(0, 20) AS t(k)),
gone_list AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT q.doc_id, string_agg(q.w[q.p], ' ' ORDER BY q.p) AS body, count(*) AS n
  FROM places q ANTI JOIN gone g ON q.doc_id = g.doc_id AND q.p = g.p GROUP BY q.doc_id)
SELECT x.doc_id, CAST(len(x.w) AS BIGINT) AS n_words, CAST(len(x.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM words x LEFT JOIN kept k USING (doc_id)
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores) WHERE r <= 20
"""

def _op12_sql(rounds: int = 2) -> str:
    """Lloyd rounds over (part position, entry) in plain SQL."""
    ctes = ["""
vectors AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM vectors CROSS JOIN range(0, 16) AS t(p)),
book0 AS (SELECT p, id - 1 AS e, x AS c FROM parts WHERE id <= 64)"""]
    for r in range(rounds + 1):
        ctes.append(f"""
near{r} AS (SELECT id, p, e, d FROM (
  SELECT a.id, a.p, b.e, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.c[i]) * (a.x[i] - b.c[i]))) AS BIGINT) AS d
  FROM parts a JOIN book{r} b ON a.p = b.p) QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY d, e) = 1)""")
        if r < rounds:
            ctes.append(f"""
mean{r} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
  SELECT k.p, k.e, i, CAST(sum(q.x[i]) AS DOUBLE) AS s, count(*) AS n
  FROM near{r} k JOIN parts q ON q.id = k.id AND q.p = k.p CROSS JOIN range(1, 65) AS u(i) WHERE i <= len(q.x) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)""")
    last = f"near{rounds}"
    return "WITH " + ",".join(ctes) + f""",
coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY id),
labels_ AS (SELECT v.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM vectors v JOIN coded c USING (id) GROUP BY v.label),
flat AS (SELECT p, e, i, c[i] AS x FROM book{rounds} CROSS JOIN range(1, 65) AS u(i) WHERE i <= len(c)),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM flat)
SELECT v.vec_id, c.code, c.error, l.label_error, g.codebooks_sha256
FROM vectors v JOIN coded c USING (id) JOIN labels_ l ON l.label IS NOT DISTINCT FROM v.label CROSS JOIN digest g"""


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tfs AS (SELECT d, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM words GROUP BY d, t),
lens AS (SELECT d, count(*) AS n FROM words GROUP BY d),
stats AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lens),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, stats),
scores AS (
  SELECT a.item_id, f.d, any_value(f.doc_id) AS doc_id,
         CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * l.n * s.nn) // s.ll)))) AS BIGINT) AS score
  FROM asked a JOIN tfs f USING (t) JOIN weights w USING (t) JOIN lens l ON l.d = f.d CROSS JOIN stats s GROUP BY a.item_id, f.d)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0) WHERE r <= 50
"""


@query(OP3_SQL)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


@query(OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from all documents because their windows start earlier too."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return substring.removal_digest(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_extract.extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 token ids."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return packing.pack_documents(docs).drop("ids")


@query()
def op7_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.fair_queue(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query(OP8_SQL)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector, by integer product."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of all documents."""
    return licenses.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query()
def op10_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return sharding.shard_documents(docs).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query(OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return ranking.ranked_search(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


@query(_op12_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and the codebooks' hash of all vectors."""
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return codes.compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query()
def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 token ids, or a power of two, without padding."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return cutting_stock.pack_documents(docs).drop("ids")
