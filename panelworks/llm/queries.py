"""Queries opN_*: each operator over its whole table, with production parameters.

``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` has DuckDB SQL where
SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import align, chat, infill, lm, neardup, ogg, oracles, packing, repair, repetition, sharding, spm, toxicity, urlfilter

N_SHARDS = 8
#: A document is toxic from this score on.
TOXIC = 0.7
URL_RULES = (
    urlfilter.Rule("allow", "org"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)


def vocabulary_file(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(documents(spark, sf_dir), N_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = urlfilter.train(urlfilter.labelled_by(pages))
    return urlfilter.judge(pages, URL_RULES, model)


def op4_spm_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(documents(spark, sf_dir), vocabulary_file("piece_bpe_32k.model"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(spark, documents(spark, sf_dir))


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.write_and_read(documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.decode(ogg.encode(documents(spark, sf_dir)))


def op9_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.assess(documents(spark, sf_dir))


def op10_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op11_byte_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.restore(infill.transform(documents(spark, sf_dir)))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_relational_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_corpus(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))


def op13_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.read_back(chat.format_conversations(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rendezvous_shards,
        op2_ftrl_toxicity,
        op3_url_trees,
        op4_spm_agenda,
        op5_context_mixing,
        op6_repair_ids,
        op7_pattern_packing,
        op8_ogg_media,
        op9_repetition_coverage,
        op10_signature_join,
        op11_byte_automaton,
        op12_relational_alignment,
        op13_grammar_round_trip,
    )
}

ORACLES: dict[str, str] = {
    op9_repetition_coverage.__name__: oracles.repetition_sql(),
    op10_signature_join.__name__: oracles.near_duplicate_sql(),
    op11_byte_automaton.__name__: oracles.infill_sql(),
    op13_grammar_round_trip.__name__: oracles.chat_sql(),
}
