"""The registered queries of this package: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueweave.llm import audit, egojoin, langid, mixing, oracle, packing, pii, sharding, simhash, sketch, suffix, toolcalls, trie, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Fixed values of the query.
URL_RULES = "block net/, allow example.net/en/, block example.com/de/, allow org/fr/"


def op1_redirect_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict for every page."""
    return urls.judge(_table(spark, folder, "pages"), urls.rules_of(URL_RULES))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, folder, "documents"))


def op3_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents and of their edits."""
    return sketch.compare_with_next(_table(spark, folder, "documents"))


def op4_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls drawn from the conversations, linked, ordered and checked."""
    calls, results = toolcalls.from_conversations(_table(spark, folder, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TOOLS)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of documents within 4 bits."""
    return simhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with pseudonyms for personal numbers and dates."""
    return pii.hide(_table(spark, folder, "documents"))


def op7_grid_order_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors of equal label: links, groups, and who stays."""
    return egojoin.linked(_table(spark, folder, "embeddings"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document for a mix by source weights."""
    return mixing.taken(_table(spark, folder, "documents"))


def op9_interval_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 50-byte stretches that earlier documents hold."""
    return suffix.remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return langid.predict(_table(spark, folder, "documents"))


def op11_jump_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document among 24 shards, and its shard among 25."""
    return sharding.place(_table(spark, folder, "documents"), 24)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes at every step of every order, by source."""
    return audit.interactions(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Prefixes that rebuilt conversations share."""
    return trie.prefix_trie(_table(spark, folder, "conversations"))


def queries() -> dict:
    """Every query by name."""
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can state a query."""
    return oracle.statements()
