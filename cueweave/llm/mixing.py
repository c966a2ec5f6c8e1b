"""Mixing sources to target weights: exact block quotas dealt down a splitting tree.

1. Every source gets a target of words from its weight, bounded by a multiple of its
   size; what is over the bound is shared again by weight (``allocate``).
2. A source's documents, in hashed order, span a line of words, repeated as often as the
   target needs; the line is cut into blocks of ``block_words``, and the number of blocks
   is the source's quota.
3. A binary tree splits the vector of quotas among the output shards: at each node the
   left half is a multivariate-hypergeometric draw, so every block is dealt exactly once.
   The first levels are drawn on the driver (at most 64 nodes), the subtrees in tasks.
4. A shard's share of a source is a range of permuted block numbers (a keyed Feistel
   permutation), so blocks are disjoint.  Inside a shard pieces are shuffled by hash.

Everything depends on the seed, the ids and the texts only, so reruns agree.

Defined cases: null text counts 0 words; a null source is a source of its own, last in
order; rows of no words are never taken; repeated rows count each; an empty table gives an
empty mix; more columns are kept; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import SPACES, numbered, running_totals, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)


def allocate(
    sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, ceiling: float
) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point order, null last.

    Weights repeat along that order.  Sources over ``ceiling`` times their size stop
    there, and the rest is shared anew by weight among the others until none is above.
    One row per source of the mix: the table of weights has as many.
    """
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    left = share * sum(size for _, size in ranked)
    open_, target = set(range(len(ranked))), [0.0] * len(ranked)
    while open_:
        weight = sum(weights[i % len(weights)] for i in open_)
        offer = {i: left * weights[i % len(weights)] / weight for i in open_}
        above = {i for i in open_ if offer[i] > ceiling * ranked[i][1]}
        for i in above or open_:
            target[i] = ceiling * ranked[i][1] if above else offer[i]
        left -= sum(target[i] for i in above)
        open_ = open_ - above if above else set()
    return [(s, n, t) for (s, n), t in zip(ranked, target, strict=True)]


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: four Feistel rounds, walked until inside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for turn in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) % 2**64)
            mix = (right + salt) * np.uint64(0xBF58476D1CE4E5B9)
            mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mix ^ (mix >> np.uint64(32))) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def split(node: dict, seed: int) -> tuple[dict, dict]:
    """Both children of a node: half the blocks, drawn without regard to their source."""
    quota = np.asarray(node["quota"], dtype=np.int64)
    draw = np.random.default_rng([seed, node["level"], node["index"]])
    left = draw.multivariate_hypergeometric(quota, int(quota.sum()) // 2, method="marginals")
    level, at, start = node["level"] + 1, 2 * node["index"], np.asarray(node["start"], dtype=np.int64)
    return (
        {"level": level, "index": at, "quota": left.tolist(), "start": start.tolist()},
        {"level": level, "index": at + 1, "quota": (quota - left).tolist(), "start": (start + left).tolist()},
    )


def leaves(node: dict, depth: int, seed: int) -> Iterator[dict]:
    """The shards below a node."""
    if node["level"] == depth:
        yield node
        return
    for child in split(node, seed):
        yield from leaves(child, depth, seed)


def _blocks(spark, quotas: list[int], shard_blocks: int, seed: int) -> DataFrame:
    """(source_no, block, shard): where each block goes."""
    depth = max(0, (max(sum(quotas), 1) - 1) // shard_blocks).bit_length()
    top = [{"level": 0, "index": 0, "quota": quotas, "start": [0] * len(quotas)}]
    for _ in range(min(depth, 6)):  # 64 nodes at most
        top = [child for node in top for child in split(node, seed)]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node in frame.to_dict("records"):
                for leaf in leaves(node, depth, seed):
                    for no, (n, start) in enumerate(zip(leaf["quota"], leaf["start"], strict=True)):
                        if n:
                            block = permute(np.arange(start, start + n), quotas[no], seed + no)
                            yield pd.DataFrame({"source_no": no, "block": block, "shard": leaf["index"]})

    frame = spark.createDataFrame(
        [(n["level"], n["index"], n["quota"], n["start"]) for n in top],
        "level int, index bigint, quota array<bigint>, start array<bigint>",
    )
    spread = frame.repartition(len(top), "index")
    return spread.mapInPandas(deal, "source_no int, block bigint, shard bigint")


def _sized(docs: DataFrame) -> DataFrame:
    given = [c for c in ("_row", "doc_id", "source") if c in docs.columns]
    return docs.select(*given, word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))


def mix(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    ceiling: float = 2.0,
    block_words: int = 16_384,
    shard_blocks: int = 8,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of ``rows``: stored, with _row, doc_id, source, size (words) and _tie (a hash of the text).

    Returns the rows with source_size and target, and the pieces of the mix: ``_row``, turn,
    first_word, words, shard, position (order inside the shard).  ``ceiling`` bounds how often a document repeats.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per weighted source
    plan = allocate([(r.source, int(r.n)) for r in totals], weights, share, ceiling)
    takes = [min(int(t + 0.5), int(ceiling * n)) for _, n, t in plan]
    quotas = [-(-take // block_words) for take in takes]
    sources = spark.createDataFrame(
        [(no, s, n, float(t), take) for no, ((s, n, t), take) in enumerate(zip(plan, takes, strict=True))],
        "source_no int, source string, source_size bigint, target double, take bigint",
    )
    known = rows.alias("r").join(
        F.broadcast(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))
    )  # as many rows as there are weights
    known = known.select("r.*", *[f"s.{c}" for c in sources.columns if c != "source"])
    lined = running_totals(known, ["source_no"], ["doc_id", "_tie"], "size", "begin", ("_row",))

    # A document lies at begin, begin + source_size, ... up to what the source gives.
    turn = F.explode(F.sequence(F.lit(0), F.ceil(F.col("take") / F.col("source_size")) - 1))
    laid = lined.filter("size > 0 and take > 0").select("*", turn.alias("turn"))
    laid = laid.withColumn("lo", F.col("turn") * F.col("source_size") + F.col("begin"))
    laid = laid.withColumn("hi", F.least(F.col("lo") + F.col("size"), "take")).filter("lo < hi")
    at = F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words)))
    cut = laid.select("*", at.alias("block"))
    a, b = F.greatest("lo", F.col("block") * block_words), F.least("hi", (F.col("block") + 1) * block_words)
    cut = cut.select(
        "_row", "doc_id", "_tie", "turn", "source_no", "block",
        (a - F.col("lo")).alias("first_word"), (b - a).alias("words"),
    )
    dealt = cut.join(_blocks(spark, quotas, shard_blocks, seed), ["source_no", "block"])
    position = F.xxhash64(F.lit(seed), "shard", "doc_id", "_tie", "turn", "block")
    pieces = dealt.select("_row", "turn", "first_word", "words", "shard", position.alias("position"))
    return known.drop("_tie", "source_no", "take"), pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows, pieces = mix(numbered(_sized(docs)), **options)
    words = pieces.groupBy("_row").agg(F.sum("words").alias("taken"))
    return rows.join(words, "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows shaped like ``docs``, once for each time a document is taken.

    ``docs`` is read twice and its rows are known by their place, so it must be a stored
    table or one that gives the same partitions again.  A document that is taken in part
    (the last of a source's line) is cut after its words; where a block border cuts a
    document, its pieces join again.  A text that is cut keeps its words with single spaces
    between them.  Output is laid out by shard and shuffled inside.
    """
    full = docs.withColumn("_row", F.monotonically_increasing_id())
    _, pieces = mix(stored(_sized(full)), **options)
    home = F.struct("first_word", "shard", "position")
    rows = pieces.groupBy("_row", "turn").agg(F.sum("words").alias("_words"), F.min(home).alias("_home"))
    joined = full.join(rows, "_row")
    whole = F.col("_words") >= word_count(F.col("text"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " ")
    head = F.when(whole, F.col("text")).otherwise(cut)
    out = joined.withColumns({"_whole": whole, "text": head})
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("_whole"), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    out = out.repartition(F.col("_home.shard")).sortWithinPartitions("_home.shard", "_home.position")
    return out.select(*[F.col(c) for c in docs.columns])
