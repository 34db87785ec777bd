"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import decontaminate, importance, main_text, mixing, near_dups, personal_data, scratch, search, token_counts, token_shards, topk, toxicity, url_rules, warc


#: The vocabulary file of op4.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: That of op11.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text.extract_main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("page_id", "url", "text", "n_chars")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page: payloads of responses, headers alone of revisits."""
    folder = scratch.Scratch(spark).path("warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    responses = warc.read_archive(spark, folder).where("record_type = 'response'")
    revisits = warc.read_archive(spark, folder, payload=False).where("record_type = 'revisit'")
    return responses.drop("payload").unionByName(revisits.drop("payload")).select(
        warc.page_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id("refers_to").alias("refers_to"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of some benchmark item."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and their greedy word pieces (not the tokens that the vocabulary's own tokenizer would give)."""
    first, later = token_counts.byte_level_pieces(VOCABULARY)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), first, later, carry=["doc_id"])


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by integer inner product for every row whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors.where("vec_id % 100 = 0"), vectors)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at a similarity of 0.85 on three-word shingles."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: what the base rules find, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find_personal_data(docs, personal_data.train(spark), carry=["doc_id"])
    counts = [personal_data.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select(
        "doc_id", *counts,
        F.sha2(personal_data.joined(F.col("base")), 256).alias("base_sha256"),
        personal_data.joined(F.col("spans")).alias("spans"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document when sources are balanced to their targets."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    judged = url_rules.filter_urls(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, carry=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards hold of every document: its place among all ids, their number and checksum."""
    folder = scratch.Scratch(spark).path("shards")
    token_shards.write_shards(table(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=2)
    return token_shards.read_shards(spark, folder, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, max_n=1, buckets=10_000, seed=2024, carry=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    found = search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (op1_main_text, op2_warc_round_trip, op3_decontaminate, op4_token_counts, op5_top_products, op6_near_duplicates, op7_personal_data, op8_mix_sources, op9_url_filter, op10_toxicity, op11_token_shards, op12_resample, op13_search)}
ORACLES = {"op3_decontaminate": decontaminate.ORACLE, "op5_top_products": topk.ORACLE, "op6_near_duplicates": near_dups.ORACLE, "op9_url_filter": url_rules.ORACLE, "op12_resample": importance.ORACLE, "op13_search": search.ORACLE}
