"""Registered queries of this subpackage: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levenshtein automata over a learned lexicon trie, with context windows."""
    from tidemark.llm.toxicity import fit_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularised quadratic discriminant over document statistics."""
    from tidemark.llm.quality import fit_quality, score_quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding with tree concatenation of long unsplit text, and decoding."""
    from tidemark.llm.tokens import decode, encode

    coded = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing planned over the length histogram. The ids' checksum is taken where the pieces are made, so the
    ids themselves don't travel to their slots."""
    from tidemark.llm.packing import best_fit, token_pieces

    pieces = token_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass external shuffle under the law `rows`."""
    from tidemark.llm.sharding import shard

    out = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_substrings")
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix automata over shards of shared passages."""
    from tidemark.llm.substrings import remove_repeats

    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op9_search", sql="""
WITH base AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM base q JOIN base c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
WHERE rank <= 5
""")
def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxScore over shards of integer vectors."""
    from tidemark.llm.topk import search

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0)).select("query_id", "rank", "vec_id", "score")


@query("op2_embeddings")
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NN-descent near duplicates of vectors."""
    from tidemark.llm.neighbours import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op1_jaccard")
def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-tree join of word 5-gram sets at 75 percent Jaccard similarity."""
    from tidemark.llm.jaccard import jaccard_classes

    return jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bidirectional gated recurrent network over bytes."""
    from tidemark.llm.language import fit_language, predict_language

    docs = read(spark, sf_dir, "documents")
    net = fit_language(docs.select("doc_id", "text", "lang"))
    return predict_language(docs.select("doc_id", "text"), net).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op11_warc", sql="""
WITH rows AS (
  SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS first_id FROM rows
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND n > 1 THEN first_id END AS refers_to
FROM firsts
""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC archives written, read back, and assembled to captures through their concurrent-to identifiers."""
    from tidemark.llm.warc import archive_records, assemble, capture_rows, page_captures, read_archives, write_archives
    from tidemark.session import shared_folder

    records = archive_records(capture_rows(read(spark, sf_dir, "pages")))
    folder = write_archives(records, shared_folder(spark, "warc"))
    return page_captures(assemble(read_archives(spark, folder))).select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


@query("op12_merkle")
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest over bitmap ranks; line feeds are deleted from the texts of every second document to test its proofs."""
    from tidemark.llm.merkle import manifest

    tampered = F.when(fold(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(read(spark, sf_dir, "documents"), tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_trie")
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of conversations with subtree totals by rake and compress."""
    from tidemark.llm.trie import prefix_trie

    return prefix_trie(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
