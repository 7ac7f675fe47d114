"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camtrail.llm.context_mixing import text_scores
from camtrail.llm.decontaminate import contaminated, contamination
from camtrail.llm.heap_bpe import encode_decode
from camtrail.llm.language_id import fit, predict, remainder
from camtrail.llm.lexical_search import ranked
from camtrail.llm.ngram_join import jaccard_components
from camtrail.llm.prefix_trie import conversation_trie
from camtrail.llm.private_data import KINDS, personal_data, span_text
from camtrail.llm.queries_sql import ORACLE_SQL
from camtrail.llm.repeats import deduplicated
from camtrail.llm.storage import new_path
from camtrail.llm.tables import documents, table
from camtrail.llm.token_counts import token_counts
from camtrail.llm.token_files import read_tokens, token_digests, write_tokens
from camtrail.llm.vector_search import top_k
from camtrail.llm.web_archives import convert, read_warc, write_arc

__all__ = ["BYTE_BPE", "ORACLE_SQL", "QUERIES"]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 4-word shingles that link at 0.85. A null text or one without words has size 0 and is its own component; an empty table gives no rows."""
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts, learned from those whose id's crc32 isn't 0 modulo 10. A null text has its end alone."""
    held_out = remainder("doc_id", 10) == 0
    found = text_scores(documents(spark, sf_dir), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits", "bits_per_byte")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of each document's ids as read back from the files. A null text holds the end id alone."""
    path = new_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path, BYTE_BPE, end_id=0)
    return token_digests(read_tokens(spark, path))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each text; a null text has none."""
    counts = token_counts(documents(spark, sf_dir), BYTE_BPE)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, and those of keys and of words that reveal what is protected. A null text has no spans."""
    found = personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("term"))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text that lie in windows of benchmark items. A null text has no words."""
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every vector whose id is divisible by 100. Null and non-finite vectors take no part."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without strings of 100 bytes that start earlier. A null text is empty."""
    found = deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by nearest centroid, learned from texts whose id's crc32 isn't 2 modulo 4. A text that is null or without letters is `und`."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    found = predict(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to. A null text has no ids."""
    return encode_decode(documents(spark, sf_dir), BYTE_BPE, digests=True)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item. Null texts hold no terms; items that meet nothing give no rows."""
    return ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages kept in ARC files of both versions, converted to WARC files and read back. A null html is an empty payload; a null page_id stays null."""
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations. Null roles and texts are empty; rows without conv_id take no part."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_context_mixing, op3_token_files, op4_token_counts, op5_personal_data, op6_decontaminate, op7_exact_top_k, op8_repeated_bytes, op9_language_id, op10_bpe_encode_decode, op11_lexical_search, op12_web_archives, op13_prefix_trie)}
