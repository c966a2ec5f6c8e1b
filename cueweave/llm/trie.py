"""Prefixes that conversations share: a z-fast trie, built in batches.

Conversations are sequences of turns (role, text).  Every prefix has a 128-bit key: the XOR of
two 64-bit hashes of its turns with their places, so keys come from one running sum.

* **Compacted nodes.**  The trie keeps only nodes where conversations part or end.  A node
  with extent (p, e] below its parent is found by its *handle*: the key of its prefix at the
  two-fattest depth of (p, e], the one that the largest power of two divides.
* **Location.**  A conversation finds where it leaves the trie by fat binary search: it asks
  for the handle at the two-fattest depth of the depths that are left.  A hit leads to the
  node's end, a miss to the depths above: about log2(length) look-ups, each a join on keys.
* **Insertion in batches.**  The first batch is a small hashed share, the next are larger.  What
  a batch holds below its exit nodes, and the edges it leaves in the middle of, are grouped
  by key; nodes where something parts or ends are the batch's new compacted nodes.
* **Totals.**  Sums over subtrees come by pointer doubling over compacted nodes, in as many
  rounds as their depth has binary digits.
* **Expansion.**  Edges are expanded into a row per depth; what differs along an edge
  follows from running word counts.

Equal conversations are one class before anything else.  Turns are numbered, and prefixes
are summed, in blocks, so a conversation of any length is spread; look-ups of one handle, and
of one ancestor, are salted.  One thing is sequential by definition: the SHA-256 of the members
that end at a node reads their ids in order, as a stream in one task, nothing gathered.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or
text is empty; turns come in order of turn (null first), then role and text; repeated rows are
turns of their own; no conversations, no nodes; more columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import stored, word_count

BATCHES = 2
GROWTH = 8  # of a batch against the ones before
SALTS = 8
BLOCK = 1 << 16  # turns numbered, or summed, in one window
PART = 1 << 12  # depths of an edge unfolded at a time

SCHEMA = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)


def _key(first: Column, second: Column) -> Column:
    return F.struct(first.alias("k1"), second.alias("k2"))


def _root() -> Column:
    """The key of no turns."""
    return _key(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))


def two_fattest(low: Column, high: Column) -> Column:
    """The depth in (low, high] that the largest power of two divides."""
    digits = F.length(F.bin(low.bitwiseXOR(high)))
    return high - F.pmod(high, F.pow(F.lit(2.0), digits - 1).cast("bigint"))


# -- sequences ----------------------------------------------------------------------


def rebuilt(conversations: DataFrame, every: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, t1, t2, w) for the turns of every rebuilt conversation, and (conv_id) for all.

    Conversation c begins with the first h = crc32(c) % ``longest`` turns of conversation
    c - c % ``every``, and goes on with its own turns after its first h.
    """
    c = F.col("conv_id")
    rows = conversations.select(
        c.cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("block", F.expr(f"turn div {BLOCK}"))

    # How many turns precede a block, and what the conversation takes over: one row a block.
    blocks = stored(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")))
    totals = blocks.groupBy("conv_id").agg(F.sum("n").alias("total"))
    convs = totals.select(
        c, (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % longest).alias("h")
    )
    bases = totals.select(F.col("conv_id").alias("base"), F.col("total"))
    convs = stored(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("total", F.lit(0)))).drop("total"))
    earlier = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(convs.drop("base"), "conv_id")
    before = before.toDF("b_conv", "b_block", "before", "h", "taken")

    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    numbered = rows.withColumn("rank", F.row_number().over(inside)).select(
        "conv_id",
        "block",
        "rank",
        F.xxhash64("role", "text").alias("t1"),
        F.xxhash64("text", F.lit(1), "role").alias("t2"),
        word_count(F.col("text")).alias("w"),
    )
    same = (F.col("conv_id") == F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    turns = numbered.join(before, same).select("conv_id", (F.col("before") + F.col("rank") - 1).alias("at"), "h", "taken", "t1", "t2", "w")
    turns = stored(turns)

    own = turns.filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("d"), "t1", "t2", "w")
    heads = turns.filter(F.col("at") < longest - 1).select(F.col("conv_id").alias("base"), "at", "t1", "t2", "w")
    lent = convs.join(heads, "base").filter("at < h").select("conv_id", (F.col("at") + 1).alias("d"), "t1", "t2", "w")
    return own.unionByName(lent), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, key, up, w, upto): keys of every prefix and of the one before, words of the last turn and of all."""
    step = [F.xxhash64(F.lit(i), "d", f"t{i}").alias(f"e{i}") for i in (1, 2)]
    rows = stored(turns.select("conv_id", "d", F.expr(f"(d - 1) div {BLOCK}").alias("block"), *step, "w"))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"), F.sum("w").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        "conv_id", "block", *[F.coalesce(f(n).over(earlier), F.lit(0)).alias(f"b{n}") for f, n in ((F.bit_xor, "x1"), (F.bit_xor, "x2"), (F.sum, "s"))]
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({"x1": F.bit_xor("e1").over(so_far), "x2": F.bit_xor("e2").over(so_far), "s": F.sum("w").over(so_far)})
    both = within.join(carry, ["conv_id", "block"])
    k1, k2 = (F.col(f"x{i}").bitwiseXOR(F.col(f"bx{i}")) for i in (1, 2))
    up = _key(k1.bitwiseXOR(F.col("e1")), k2.bitwiseXOR(F.col("e2")))
    return both.select("conv_id", "d", _key(k1, k2).alias("key"), up.alias("up"), "w", (F.col("s") + F.col("bs")).alias("upto"))


def _unfold(spans: DataFrame, seqs: DataFrame) -> DataFrame:
    """Rows of ``spans`` (owner, p, e, more) once for every depth d in (p, e], with the owner's key, up, w, upto there."""
    parts = spans.filter("p < e").select("*", F.explode(F.sequence("p", F.col("e") - 1, F.lit(PART).cast("bigint"))).alias("_s"))
    deep = parts.select("*", F.explode(F.sequence(F.col("_s") + 1, F.least(F.col("_s") + PART, "e"))).alias("d")).drop("_s")
    return deep.join(seqs.withColumnRenamed("conv_id", "owner"), ["owner", "d"])


# -- the trie -----------------------------------------------------------------------

TRIE = ["key", "owner", "p", "e", "parent", "name", "handle", "begin", "end"]


def locate(classes: DataFrame, trie: DataFrame, seqs: DataFrame) -> DataFrame:
    """(owner, len, p): the depth of the deepest compacted node on the path of every class (owner, len)."""
    handles = trie.select(F.col("handle").alias("f_key"), "p", "e", "key").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    keys = seqs.select(F.col("conv_id").alias("owner"), "d", F.col("key").alias("k"))
    state = classes.select("owner", "len", F.lit(0).cast("bigint").alias("low"), F.col("len").alias("high"))
    found = []
    while True:
        over = state.filter("low >= high").select("owner", "len", F.col("low").alias("p"))
        found.append(over)
        asking = state.filter("low < high").withColumn("d", two_fattest(F.col("low"), F.col("high")))
        if asking.isEmpty():
            break
        asked = asking.join(keys, ["owner", "d"]).withColumnRenamed("k", "f_key").withColumnRenamed("d", "f")
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(SALTS)).cast("int"))
        hit = asked.join(handles, ["f_key", "salt"], "left").drop("salt", "f_key")
        ends = hit.withColumn("d", F.when(F.col("e") <= F.col("len"), F.col("e")))
        met = ends.join(keys, ["owner", "d"], "left").withColumn("met", F.coalesce(F.col("k") == F.col("key"), F.lit(False)))
        # A miss: only shallower handles are left.  A node whose end is not met: its parent is the last on the path.
        state = stored(
            met.select(
                "owner",
                "len",
                F.when(F.col("e").isNull(), F.col("low")).when(F.col("met"), F.col("e")).otherwise(F.col("p")).alias("low"),
                F.when(F.col("e").isNull(), F.col("f") - 1).when(F.col("met"), F.col("high")).otherwise(F.col("p")).alias("high"),
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def insert(exits: DataFrame, trie: DataFrame | None, seqs: DataFrame) -> DataFrame:
    """The trie with classes (owner, len, p) put in below the depths p of their exits."""
    new = _unfold(exits.select("owner", "p", F.col("len").alias("e")), seqs)
    if trie is not None:
        new = stored(new)
        names = new.filter("d = p + 1").select(F.col("key").alias("name")).distinct()
        cut = stored(trie.join(names, "name", "left_semi").select(*TRIE))
        new = new.unionByName(_unfold(cut.select("owner", "p", "e"), seqs))
    # All rows of a key hang below one compacted node, at depth p.
    first = [F.first(c).alias(c) for c in ("d", "up", "w", "upto", "p")]
    nodes = stored(new.groupBy("key").agg(F.min("owner").alias("owner"), F.max(F.col("d") == F.col("e")).alias("ends"), *first))
    kids = nodes.groupBy("up").agg(F.count("*").alias("kids")).withColumnRenamed("up", "key")
    stops = nodes.join(kids, "key", "left").filter("ends OR kids > 1")
    stops = stops.select("key", "owner", F.col("d").alias("e"), F.col("upto").alias("end"), F.col("p").alias("_below"))
    # Below one node, an owner's nodes go from some depth to its end; above that depth there is a
    # compacted node.  An owner of several cut edges has nodes below several, with gaps between.
    tops = nodes.groupBy("owner", F.col("p").alias("_below")).agg((F.min("d") - 1).alias("top"))
    above = F.lag("e").over(Window.partitionBy("owner", "_below").orderBy("e"))
    edges = stops.withColumn("_above", above).join(tops, ["owner", "_below"]).withColumn("p", F.coalesce("_above", "top"))
    edges = edges.drop("_above", "top", "_below")
    begins = nodes.select("owner", (F.col("d") - 1).alias("p"), F.col("up").alias("parent"), F.col("key").alias("name"), (F.col("upto") - F.col("w")).alias("begin"))
    fats = nodes.select("owner", F.col("d").alias("f"), F.col("key").alias("handle"))
    edges = edges.join(begins, ["owner", "p"]).withColumn("f", two_fattest(F.col("p"), F.col("e"))).join(fats, ["owner", "f"])
    edges = edges.select(*TRIE)
    return stored(edges if trie is None else trie.join(cut.select("key"), "key", "left_anti").select(*TRIE).union(edges))


def build(classes: DataFrame, seqs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The z-fast trie of classes (owner, len): compacted nodes but the root, TRIE."""
    turn = sum((F.when(F.pmod(F.xxhash64("owner"), F.lit(GROWTH**i)) != 0, 1).otherwise(0) for i in range(1, batches)), F.lit(0))
    dealt = stored(classes.select("owner", "len", turn.alias("batch")))
    trie = None
    for i in range(batches):
        batch = dealt.filter(F.col("batch") == i).drop("batch")
        exits = batch.withColumn("p", F.lit(0).cast("bigint")) if trie is None else locate(batch, trie, seqs)
        trie = insert(exits, trie, seqs)
    return trie


# -- totals and rows ----------------------------------------------------------------

SUMS = ["n", "words", "leaves", "text"]  # members, words of their conversations, leaves, words of the nodes


def totals(trie: DataFrame, ends: DataFrame) -> DataFrame:
    """TRIE and children, least member and SUMS of every subtree, by pointer doubling.

    ``ends``: key, conv (least), n, upto: the classes by the node they end at.
    """
    kids = trie.groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "key")
    base = trie.join(kids, "key", "left").join(ends.select("key", F.col("conv").alias("least"), "n", "upto"), "key", "left")
    base = stored(
        base.select(
            *TRIE,
            F.coalesce("kids", F.lit(0)).alias("kids"),
            "least",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce(F.col("n") * F.col("upto"), F.lit(0)).alias("words"),
            F.when(F.col("kids").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
            (F.col("end") - F.col("begin")).alias("text"),
        )
    )
    state = base.select("key", F.when(F.col("p") > 0, F.col("parent")).alias("over"), "least", *SUMS)
    while not state.filter("over IS NOT NULL").isEmpty():
        gains = state.filter("over IS NOT NULL").groupBy("over").agg(F.min("least").alias("g_least"), *[F.sum(c).alias(f"g_{c}") for c in SUMS])
        grown = state.join(gains.withColumnRenamed("over", "key"), "key", "left").select(
            "key", "over", F.least("least", "g_least").alias("least"), *[(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in SUMS]
        )
        far = state.filter("over IS NOT NULL").select(F.col("key").alias("over"), F.col("over").alias("far"))
        state = stored(_salted(grown, far, "over").drop("over").withColumnRenamed("far", "over"))
    return base.drop("least", *SUMS).join(state.drop("over"), "key")


def _salted(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per key), where many rows may have one key, or none."""
    spread = F.when(F.col(key).isNull(), 1 << 20).otherwise(SALTS)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), spread).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (conv_id, key): SHA-256 of the ids in order, joined by commas, as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

        last, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for k1, k2, conv in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "conv_id")), strict=True):
                if (k1, k2) == last:
                    digest.update(b",%d" % conv)
                    continue
                if last is not None:
                    done.append((*last, digest.hexdigest()))
                last, digest = (k1, k2), hashlib.sha256(b"%d" % conv)
            yield told(done)
        if last is not None:
            yield told([(*last, digest.hexdigest())])

    names = ["k1", "k2", "ends_sha256"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string()], strict=True)))
    rows = ends.select("key.k1", "key.k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    told = rows.mapInArrow(work, "k1 bigint, k2 bigint, ends_sha256 string")
    return told.select(_key(F.col("k1"), F.col("k2")).alias("key"), "ends_sha256")


def nodes(turns: DataFrame, convs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per prefix, SCHEMA, of conversations ``convs`` (conv_id) with ``turns`` (conv_id, d, t1, t2, w).

    d goes from 1 without gaps; t1 and t2 are two hashes of what a turn holds, w its words.
    The turns of a node are the first ``depth`` ones of its ``conv_id``, its least member.
    """
    spark = convs.sparkSession
    if convs.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    seqs = stored(prefixes(turns))
    last = seqs.groupBy("conv_id").agg(F.max_by(F.struct(F.col("d").alias("len"), "key", "upto"), "d").alias("z"))
    zero = F.lit(0).cast("bigint")
    ends = stored(
        convs.join(last, "conv_id", "left").select(
            "conv_id", F.coalesce("z.key", _root()).alias("key"), F.coalesce("z.len", zero).alias("len"), F.coalesce("z.upto", zero).alias("upto")
        )
    )
    classes = stored(
        ends.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("len").alias("len"), F.first("upto").alias("upto"))
    )
    trie = build(classes.filter("len > 0").select(F.col("conv").alias("owner"), "len"), seqs, batches)
    full = stored(totals(trie, classes))
    digests = ends_digest(ends)

    # The root: everything below it, and those without turns.  One row.
    of_root = classes.filter("len = 0").agg(F.min("conv").alias("least"), F.coalesce(F.sum("n"), zero).alias("n"))
    below = full.agg(F.sum(F.when(F.col("p") == 0, F.col("leaves"))).alias("leaves"), F.sum(F.when(F.col("p") == 0, 1)).alias("kids"),
                     F.sum(F.when(F.col("p") == 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("p") == 0, F.col("words"))).alias("words"),
                     F.sum(F.when(F.col("p") == 0, F.col("text"))).alias("text"), F.min("least").alias("least")).first()
    mine = of_root.first()
    least = min(x for x in (mine.least, below.least) if x is not None)
    nothing = hashlib.sha256().hexdigest()
    root_ends = ends_digest(ends.filter(F.col("key") == _root())).first()
    root = spark.createDataFrame(
        [(least, 0, None, mine.n + (below.n or 0), below.kids or 0, below.leaves or 1, (below.words or 0) - (below.text or 0), root_ends.ends_sha256 if root_ends else nothing)],
        SCHEMA,
    )

    over = full.filter("kids > 0").select(F.col("key").alias("parent"), F.col("least").alias("parent_least"))
    parent = F.when(F.col("p") > 0, F.col("parent")).alias("parent")
    edges = _salted(full.select("owner", "p", "e", parent, "begin", "kids", "least", "n", "words", "leaves", "text"), over, "parent")
    rows = _unfold(edges.withColumn("parent_least", F.coalesce("parent_least", F.lit(least))).drop("parent"), seqs)
    rows = rows.join(digests, "key", "left")
    before = F.col("upto") - F.col("w")  # words above the node's own turn
    told = rows.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("p") + 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("d") < F.col("e"), 1).otherwise(F.col("kids")).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("words") - F.col("n") * before - (F.col("text") - (before - F.col("begin")))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
    return told.unionByName(root)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations (``rebuilt``)."""
    return nodes(*rebuilt(conversations))
