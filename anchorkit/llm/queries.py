"""Queries that apply the operators to the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.llm import conversation_trie, decontamination, html_text, licences, ngram_trie, piece_spans, quality_rules, repeated_windows, sharding, simhash, token_counts, vector_codes, weak_quality
from anchorkit.llm import sql as oracle
from anchorkit.session import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those whose remainder isn't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    docs = docs.withColumn("held_out", F.crc32(name) % 7 == 2)
    model = ngram_trie.train(docs.where(~F.col("held_out")))
    return ngram_trie.score(docs, model).select(
        "doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "lm.base_score", "lm.score")


@query()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str, definition: str | None = None) -> DataFrame:
    """Bytes and tokens of every document; documents over 1,024 tokens are marked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, definition or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                      (F.col("n_tokens") > 1024).alias("over_limit"))


@query()
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of 3-word shingles and the group linked at 3 or fewer differing bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(oracle.LICENCES)
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest of the canonical text, licence of the whole text, licences of notice lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan_licences(docs, licences.known_digests(spark))


@query(oracle.QUALITY_RULES)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the whole text, the base rule, and the verdict of risk-controlled cutoffs per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counted = staged(quality_rules.text_counts(docs).drop("text"), "quality-counts")
    out = quality_rules.apply_cutoffs(counted, quality_rules.learn_cutoffs(counted, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op7_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that overlap, with the best stretch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "equal", "length", "begin", "places")


@query()
def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the scorer taught by weak labels, and whether the document is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorers, _ = weak_quality.learn(docs, table(spark, sf_dir, "labels"))
    return weak_quality.score(docs, scorers).select("doc_id", "scores.good", "scores.abusive", "scores.kept")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Counts and digests of the pieces of every text, from the operator's ids, spans and decoded texts."""
    out = piece_spans.encode_decode(docs.select("doc_id", "text"), model or public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("pieces.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("pieces.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("pieces.decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.element_at("pieces.ends", -1), F.lit(0)).cast("long").alias("source_bytes"))


@query()
def op9_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding with the end id and decoding of every document; ``source_bytes`` is where the last span ends."""
    return piece_digests(table(spark, sf_dir, "documents"))


@query()
def op10_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart (law ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.uniform_shards(rows, 16, seed=20)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query(oracle.VECTOR_CODES)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in 16 parts of 64 entries after two rounds, their errors, and a digest of the codebooks."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    out, books = vector_codes.product_codes(vectors)
    out = staged(out.select("vec_id", "label", F.lower(F.hex("coded.code")).alias("code"), "coded.error"), "vector-errors")
    return vector_codes.group_error(out, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


@query(oracle.CONVERSATION_TRIE)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the conversations, rebuilt on the first turns of each hundred's first."""
    turns = staged(conversation_trie.turn_rows(table(spark, sf_dir, "conversations")), "trie-turns")
    conv = F.col("conv_id")
    rebuilt = conversation_trie.shared_starts(
        turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, most=5)
    nodes, ends = conversation_trie.prefix_trie(rebuilt)
    out = nodes.join(conversation_trie.end_digests(ends), conversation_trie.PATH, "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


@query(oracle.REPEATED_WINDOWS)
def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 20-word windows that start earlier."""
    out = repeated_windows.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))
