"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.chat import as_replies, conversation_digests, format_conversations
from tallyworks.llm.decontaminate import contamination
from tallyworks.llm.embedding_lsh import near_vectors
from tallyworks.llm.exact_dedup import load_documents
from tallyworks.llm.html_text import main_texts
from tallyworks.llm.jaccard_join import jaccard_components
from tallyworks.llm.language_model import score_texts
from tallyworks.llm.lexical_search import rank_documents
from tallyworks.llm.mixing import mixture
from tallyworks.llm.prefix_trie import trie_nodes, turn_sequences, with_openings
from tallyworks.llm.shared import scratch_path, table
from tallyworks.llm.suffix_dedup import repeated_passages
from tallyworks.llm.toxicity import toxic_documents
from tallyworks.llm.warc import read_archives, write_archives


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op2_toxicity_mil(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_embedding_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"))


def op5_language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


def op6_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that occur in several documents; cut_words of them are an earlier one's."""
    found = repeated_passages(table(spark, folder, "documents"))
    cut = F.aggregate("cut", F.lit(0).cast("bigint"), lambda n, c: n + c["stop"] - c["start"])
    return found.select(
        "doc_id", "start_word", "stop_word", (F.col("stop_word") - F.col("start_word")).alias("n_words"),
        "first_doc_id", cut.alias("cut_words"),
    )


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of all pages, read back."""
    path = scratch_path(spark, "archives")
    write_archives(table(spark, folder, "pages"), path)
    records = read_archives(spark, path).where("record_type is not null")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are the template's own marks."""
    marks = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], rows.schema)
    return conversation_digests(format_conversations(as_replies(rows.unionByName(extra))))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as the first load of a new index."""
    return load_documents(table(spark, folder, "documents"), "documents", path=scratch_path(spark, "digest-index"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations after some took over the first turns of another."""
    return trie_nodes(with_openings(turn_sequences(table(spark, folder, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity_mil": op2_toxicity_mil,
    "op3_embedding_near_copies": op3_embedding_near_copies,
    "op4_source_mixing": op4_source_mixing,
    "op5_language_model_scores": op5_language_model_scores,
    "op6_html_main_text": op6_html_main_text,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc_salvage": op9_warc_salvage,
    "op10_reply_trees": op10_reply_trees,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
