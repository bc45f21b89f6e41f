"""Registered queries of the numbered operators, and check SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import (
    byte_pair,
    divergence_audit,
    fill_in_middle,
    fingerprints,
    html_extraction,
    language_id,
    lm_scoring,
    minhash_dedup,
    packing,
    pivot_dedup,
    private_data,
    secret_scans,
    toxicity,
)
from pairforge.llm.common import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}
TOKENIZERS = "/opt/tokenizers"


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_byte_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    coded = byte_pair.encode_texts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _same(kind: str):
    return lambda k: F.when(k == kind, k)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, those inside encoded parts included."""
    found = secret_scans.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.array_compact(F.transform(kinds, _same(kind)))).cast("long").alias(f"n_{kind}")
        for kind in secret_scans.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from profiles of three quarters of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 4) == 2)
    profiles = language_id.learn_profiles(docs.where(~F.col("held_out")))
    return language_id.identify(docs, profiles, ["doc_id", "held_out"])


def toxic_labels(labels: DataFrame) -> DataFrame:
    """One 0/1 label per id of the learning rows; an id with both labels counts as toxic."""
    own = labels.where((id_remainder("doc_id", 5) != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    return own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 5) == 0)
    model = toxicity.fit(docs, toxic_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in windows of 4096."""
    return packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


@query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability, learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 10) == 0)
    docs = docs.withColumn("training", ~F.col("held_out"))
    return lm_scoring.score_texts(docs).withColumn("held_out", id_remainder("doc_id", 10) == 0)


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


@query
def op7_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return pivot_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-middle form and of the text rebuilt from it."""
    moved = fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    return moved.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


CHECK_SQL["op11_fill_in_middle"] = """
WITH digests AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), draws AS (
  SELECT doc_id, t, n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4
  FROM digests
), forms AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
), parts AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM forms
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


@query
def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language lie apart, and by which terms."""
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


CHECK_SQL["op12_divergence_audit"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), said AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), counts AS (
  SELECT said.lang, said.source, said.term, count(*) AS n
  FROM said JOIN kept ON said.lang = kept.lang AND said.term = kept.term GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), sums AS (
  SELECT lang, source, sum(n) AS group_n FROM counts GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(s.group_n, 0) AS group_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.group_n + 5 * l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.total + 5)) // (l.lang_n + 5 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = private_data.find_private_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.array_compact(F.transform(kinds, _same(kind)))).cast("long").alias(f"n_{kind}")
        for kind in private_data.BASE_KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )
