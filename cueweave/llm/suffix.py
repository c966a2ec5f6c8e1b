"""Suffix dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte is removed that lies in a stretch of ``length`` bytes which also starts in a
document of smaller id.

Which suffixes meet in a task: each stretch is filed under the least hash of its 16-byte
grams (its anchor).  Equal stretches have equal anchors, and neighbouring stretches mostly
share one, so a document sends one row for each run of about 18 stretches: the anchor, a
hash of the run's bytes (its context), and its place.  Rows meet by anchor:

* a context that a smaller document holds too is removed whole;
* of what remains, one text per context is fetched where contexts of an anchor differ.
  A task joins the contexts of its anchors to one text, sorts its suffixes, and expands
  intervals breadth first: rows of an interval "w" extended by a character to the left
  are the rows whose successor suffix lies in "w".  Level by level this marks the borders
  whose common prefix is 0, 1, 2, ... and stops at ``length``: rows not parted by then
  share a stretch.  The smallest id of such a group decides;
* an anchor with more than ``ANCHOR_ROWS`` rows is too much for a task: its stretches
  are compared by 128-bit digests in an ordinary aggregation instead.

Defined cases: null text counts as empty; rows without an id neither remove nor lose
anything; repeated rows of an id do not count against each other and get equal results;
documents shorter than ``length`` stay whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import release_shuffles, stored

LENGTH = 50
GRAM = 16
STEP = 7  # bytes that the first order of suffixes tells apart
RUN = 40  # stretches in a context, at most: one bit each; an anchor that occurs once has fewer
ANCHOR_ROWS = 20_000
PIECE = 1 << 20  # bytes handled at a time
_BYTES = np.random.default_rng(9).integers(0, 2**64, 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
ANCHOR_SHIFT = np.uint64(16)


def _pairs(x: np.ndarray, step: int) -> np.ndarray:
    """Hashes of stretches twice as long from those of two halves, ``step`` apart."""
    z = x[:-step] * _MIX
    z += x[step:]
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return z


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on."""
    x, step = _BYTES[data], 1
    while step < GRAM:
        x, step = _pairs(x, step), 2 * step
    return x


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(anchor, context, start, stretches) of the runs in ``data``, texts that end at ``ends``."""
    n = len(data) - length + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < 1:
        return none
    x = _grams(data)
    half = _pairs(x, GRAM)  # 32 bytes
    least, reach, grams = x, 1, length - GRAM + 1
    while 2 * reach <= grams:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if grams > reach:
        least = np.minimum(least[: n], least[grams - reach : grams - reach + n])
    inside = np.zeros(n + 1, dtype=np.int32)  # stretches that run over the end of a text
    np.add.at(inside, np.clip(ends - length + 1, 0, n), 1)
    np.add.at(inside, np.clip(ends, 0, n), -1)
    valid = np.cumsum(inside[:n]) == 0
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return none
    upto = np.cumsum(valid)
    count = np.diff(np.append(upto[first] - 1, upto[-1]))
    parts = -(-count // RUN)  # long runs of one anchor are cut
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + RUN * number
    count = np.minimum(np.repeat(count, parts) - RUN * number, RUN)
    anchor = np.repeat(least[first], parts)
    size = count + length - 1
    context = (half[start] * _MIX + half[start + (size - 2 * GRAM) // 2]) * _MIX
    context ^= context >> np.uint64(29)
    context = (context + half[start + size - 2 * GRAM] + size.astype(np.uint64)) * _MIX
    # 48 and 40 bits tell equal runs apart from others, and leave zeros that compress well.
    return anchor >> ANCHOR_SHIFT, context >> np.uint64(24), start, count


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after the other, and where each begins, and the end."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), at


def _tie(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(2**31 - 1)).cast("int")


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """anchor, context, doc, tie, place (64 * start + stretches) of every run of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch["doc_id"].to_numpy(zero_copy_only=False), batch["tie"].to_numpy(zero_copy_only=False)
            group: list[tuple[int, int, np.ndarray]] = []  # row, offset in its text, bytes
            held = 0

            def done() -> pa.RecordBatch:
                sizes = np.array([len(d) for *_, d in group])
                ends = np.cumsum(sizes)
                anchor, context, at, n = runs(np.concatenate([d for *_, d in group]), ends, length)
                which = np.searchsorted(ends, at, side="right")
                row = np.array([r for r, *_ in group])[which]
                start = at - (ends - sizes)[which] + np.array([o for _, o, _ in group])[which]
                columns = [anchor.view(np.int64), context.view(np.int64), ids[row], ties[row], 64 * start + n]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "context", "doc", "tie", "place"])

            whole, begins = _utf8(batch["text"])
            for row in range(batch.num_rows):
                data = whole[begins[row] : begins[row + 1]]
                for a in range(0, max(1, len(data) - length + 1), PIECE):
                    part = data[a : a + PIECE + length - 1]
                    group.append((row, a, part))
                    held += len(part)
                    if held >= PIECE:
                        yield done()
                        group, held = [], 0
            if group:
                yield done()

    given = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    given = given.select("doc_id", _tie(F.col("text")).alias("tie"), "text")
    return given.mapInArrow(work, "anchor bigint, context bigint, doc bigint, tie int, place bigint")


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key``, and each one's rank, equal for equal keys."""
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1])[: len(key)])
    return order, rank


def shared_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and for each the number of its group of equal first ``length`` bytes.

    Borders between groups are found by increasing common prefix, each level from the one
    before: a border has common prefix l + 1 if the successors of its two rows were parted
    at level l (threshold-bounded, breadth first; cf. Beller, Gog, Ohlebusch and Schnattinger,
    "Computing the longest common prefix array based on the Burrows-Wheeler transform", 2013).
    The levels that the ranks of the last sort but one tell apart are marked at once.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros(n + STEP - 1, np.int64)
    padded[:n] = text
    padded[:n] += 1  # 0 is the end of the text
    key = np.zeros(n, np.int64)
    for i in range(STEP):
        key = (key << 9) | padded[i : i + n]
    known, mark = 1, text.astype(np.int64)  # marks tell suffixes apart that differ in their first bytes, ``known`` of them
    order, rank = _ranked(key)
    step, bits = STEP, n.bit_length()
    while step < length:  # order by 7, 21, 63, ... bytes: as many ranks as go into 63 bits are one key
        known, mark, key = step, rank, rank + 1
        for i in range(1, 63 // bits):
            key <<= bits
            key[: max(0, n - i * step)] += rank[i * step :] + 1
        order, rank = _ranked(key)
        step *= 63 // bits
    place = np.empty(n + 1, np.int32)  # a task's text is far shorter than 2**31
    place[order] = np.arange(n, dtype=np.int32)
    place[n] = n  # the empty suffix, of a group of its own
    successor = place[order + 1]
    border = np.ones(n, dtype=bool)
    border[1:] = mark[order[1:]] != mark[order[:-1]]
    open_ = np.flatnonzero(~border)
    below, above = successor[open_ - 1], successor[open_]
    group = np.empty(n + 1, np.int32)
    group[n] = n + 1
    for _ in range(known, length):
        if not len(open_):
            break
        np.cumsum(border, out=group[:n])
        parted = group[above] != group[below]
        border[open_[parted]] = True
        open_, below, above = open_[~parted], below[~parted], above[~parted]
    return order, np.cumsum(border) - 1


def may_share(contexts: list[bytes], anchors: np.ndarray, length: int) -> np.ndarray:
    """Which contexts can share a stretch with another one of their anchor at all.

    A stretch holds the anchor's gram, so it reaches l bytes to the left of it and r to the
    right, l + r = length - GRAM.  Four ranges of l give four parts that any such stretch
    covers (42 of 50 bytes); a context that shares none of its four parts with another one
    is ruled out.  Where the gram occurs twice in one of an anchor's contexts, none of them is.
    """
    sizes = np.array([len(c) for c in contexts])
    grams = _grams(np.frombuffer(b"".join(contexts) + bytes(GRAM), dtype=np.uint8))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(owner)) - first[owner]
    inside = offset <= sizes[owner] - GRAM
    own = anchors.view(np.uint64)
    hit = np.flatnonzero(inside & (grams[: len(owner)] >> ANCHOR_SHIFT == own[owner]))
    times = np.bincount(owner[hit], minlength=len(contexts))
    place = np.zeros(len(contexts), np.int64)
    place[owner[hit]] = hit
    keep = np.isin(own, own[times != 1])
    spare = length - GRAM  # bytes of a stretch beside the gram
    border = [spare * i // 4 for i in range(5)]
    for low, high in zip(border, border[1:], strict=False):
        begin, end = place - low, place + GRAM + spare - high  # reaches at least this far
        some = np.flatnonzero((times == 1) & (begin >= first) & (end <= first + sizes))
        key = own[some] * _MIX
        for step in range(0, spare - high + low + 1, GRAM):  # grams that cover the part
            key = (key ^ grams[np.minimum(begin[some] + step, end[some] - GRAM)]) * _MIX
            key ^= key >> np.uint64(29)
        key = (key ^ grams[end[some] - GRAM]) * _MIX
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        keep[some[count[back] > 1]] = True
    return keep


def earlier_stretches(contexts: list[bytes], docs: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """For each context the stretches (bits) that a context of a smaller document has too."""
    sizes = np.array([len(c) + 1 for c in contexts])
    if not contexts:
        return np.zeros(0, np.int64)
    text = np.frombuffer(b"\x00".join(contexts) + b"\x00", dtype=np.uint8)
    order, group = shared_groups(text, length)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(text)) - first[owner]
    starts = offset[order] < counts[owner[order]]
    row, group = order[starts], group[starts]
    doc = docs[owner[row]]
    if not len(row):
        return np.zeros(len(contexts), np.int64)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(doc, edge), np.diff(np.append(edge, len(row))))
    hit = row[least < doc]
    masks = np.zeros(len(contexts), np.int64)
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << offset[hit])
    return masks


def _texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of ``wanted`` contexts (anchor, context, doc, tie, start, n, rows)."""
    place = F.struct("anchor", "context", "start", "n", "rows")
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(place).alias("places"))
    texts = docs.select(F.col("doc_id").alias("doc"), _tie(F.col("text")).alias("tie"), "text")
    joined = texts.join(lists, ["doc", "tie"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "context", "doc", "n", "rows", "bytes"]
        for batch in batches:
            data, at = _utf8(batch["text"])
            row = np.repeat(np.arange(batch.num_rows), batch["places"].value_lengths().to_numpy(zero_copy_only=False))
            fields = dict(zip(("anchor", "context", "start", "n", "rows"), batch["places"].flatten().flatten(), strict=True))
            begin = at[row] + fields["start"].to_numpy()
            size = fields["n"].to_numpy() + length - 1
            for a in range(0, len(row), PIECE // 64):
                some = slice(a, a + PIECE // 64)
                ends = np.append(0, np.cumsum(size[some]))
                byte = np.arange(ends[-1]) + np.repeat(begin[some] - ends[:-1], size[some])
                buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[byte])]
                cut = pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)
                rest = [fields["anchor"][some], fields["context"][some], batch["doc"].take(pa.array(row[some])), fields["n"][some], fields["rows"][some]]
                yield pa.RecordBatch.from_arrays([*rest, cut], names=names)

    return joined.select("doc", "text", "places").mapInArrow(work, "anchor bigint, context bigint, doc bigint, n int, rows bigint, bytes binary")


def _masks(texts: DataFrame, length: int) -> DataFrame:
    """anchor, context, mask: the stretches of each context that an earlier document has."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> pa.RecordBatch:
            frame = frame[may_share(frame["bytes"].to_list(), frame["anchor"].to_numpy(), length)]
            masks = earlier_stretches(frame["bytes"].to_list(), frame["doc"].to_numpy(), frame["n"].to_numpy(), length)
            some = masks != 0
            columns = [frame["anchor"].to_numpy()[some], frame["context"].to_numpy()[some], masks[some]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "context", "mask"])

        for batch in batches:  # sorted by anchor; an anchor's contexts stay together
            held.append(batch.to_pandas())
            if sum(map(len, held)) >= PIECE // 256:
                frame = pd.concat(held, ignore_index=True)
                whole = (frame["anchor"] != frame["anchor"].iloc[-1]).to_numpy()
                held = [frame[~whole]]
                if whole.any():
                    yield done(frame[whole])
        if sum(map(len, held)):
            yield done(pd.concat(held, ignore_index=True))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"anchor": [], "context": [], "doc": [], "offset": [], "digest": []}
            for anchor, context, doc, n, data in zip(*(batch[c].to_pylist() for c in ("anchor", "context", "doc", "n", "bytes")), strict=True):
                for i in range(n):
                    digest = hashlib.blake2b(data[i : i + length], digest_size=16).digest()
                    for name, value in zip(rows, (anchor, context, doc, i, digest), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("offset", pa.int32()), ("digest", pa.binary())]))

    few = texts.filter(F.col("rows") <= ANCHOR_ROWS).select("anchor", "context", "doc", "n", "bytes")
    few = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(expand, "anchor bigint, context bigint, mask bigint")
    many = texts.filter(F.col("rows") > ANCHOR_ROWS).mapInArrow(
        digests, "anchor bigint, context bigint, doc bigint, offset int, digest binary"
    )
    least = many.groupBy("digest").agg(F.min("doc").alias("least"))
    hit = many.join(least, "digest").filter("least < doc")
    bits = hit.groupBy("anchor", "context").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
    return few.union(bits)


def repeated_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, tie, start, n, mask: runs whose masked stretches an earlier document has (null: all n)."""
    spark = docs.sparkSession
    by_anchor, by_context = Window.partitionBy("anchor"), Window.partitionBy("anchor", "context")
    met = (
        _occurrences(docs, length)
        .withColumns(
            {
                "low": F.min("doc").over(by_anchor),
                "high": F.max("doc").over(by_anchor),
                "mixed": F.min("context").over(by_anchor) != F.max("context").over(by_anchor),
                "rows": F.count("*").over(by_anchor),
            }
        )
        .filter("low < high")
        .withColumn("least", F.min("doc").over(by_context))
        .filter("least < doc or mixed")
    )
    later = F.col("least") < F.col("doc")
    key = {c: F.when(~later, F.col(c)) for c in ("anchor", "context", "rows")}
    key |= {"start": F.floor(F.col("place") / 64), "n": (F.col("place") % 64).cast("int")}
    met = stored(met.withColumns(key).select("anchor", "context", "doc", "tie", "start", "n", "rows"))
    release_shuffles(spark)
    whole = met.filter("anchor is null").select("doc", "tie", "start", "n", F.lit(None).cast("bigint").alias("mask"))
    firsts = met.filter("anchor is not null")
    one = firsts.groupBy("anchor", "context").agg(F.min(F.struct("doc", "tie", "start", "n", "rows")).alias("at"))
    texts = stored(_texts(docs.filter("doc_id is not null"), one.select("anchor", "context", "at.*"), length))
    release_shuffles(spark)
    masks = _masks(texts, length)
    parts = firsts.drop("rows").join(masks, ["anchor", "context"]).select("doc", "tie", "start", "n", "mask")
    return whole.union(parts)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text left)."""
    places = stored(repeated_places(docs, length))
    release_shuffles(docs.sparkSession)
    lists = places.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "mask")).alias("places"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _tie(F.col("text")).alias("tie"))
    same = (F.col("doc_id") == F.col("doc")) & (F.col("t.tie") == F.col("l.tie"))
    joined = texts.alias("t").join(lists.alias("l"), same, "left").select("doc_id", "text", "places")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, (data, at) = batch["places"], _utf8(batch["text"])
            start, n, mask = (c.to_numpy(zero_copy_only=False) for c in places.flatten().flatten())
            sizes = np.diff(at)
            number = np.where(places.is_null(), 0, np.diff(places.offsets.to_numpy()))
            upto = np.append(0, np.cumsum(number))
            low = 0
            while low < batch.num_rows:  # documents of about PIECE bytes together, one at least
                high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE, side="right")) - 1)
                # A place for every byte, and one for the end of each document.
                slot = at[low : high + 1] - at[low] + np.arange(high - low + 1)
                part = slice(upto[low], upto[high])
                base = np.repeat(slot[:-1], number[low:high])
                gone = np.zeros(slot[-1] + 1, dtype=np.int32)
                for which, a, b in _ranges(start[part], n[part], mask[part], length):
                    np.add.at(gone, base[which] + a, 1)
                    np.add.at(gone, base[which] + b, -1)
                out = np.cumsum(gone, dtype=np.int32) > 0
                removed, spans, kept = [], [], []
                for i in range(low, high):
                    own = data[at[i] : at[i + 1]]
                    if number[i]:
                        away = out[slot[i - low] : slot[i - low] + sizes[i]]
                        removed.append(int(np.count_nonzero(away)))
                        spans.append(int(np.count_nonzero(away[:1])) + int(np.count_nonzero(away[1:] & ~away[:-1])))
                        own = own[~away]
                    else:
                        removed.append(0)
                        spans.append(0)
                    kept.append(own.tobytes())
                columns = [
                    batch["doc_id"].slice(low, high - low).cast(pa.int64()),
                    pa.array(sizes[low:high]),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array(kept, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                low = high

    return joined.mapInArrow(
        work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )


def _ranges(start: np.ndarray, n: np.ndarray, mask: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Byte ranges that runs remove: numbers of the runs, from, to.  Neighbouring bits of a mask are one range."""
    whole = np.flatnonzero(np.isnan(mask) if mask.dtype.kind == "f" else np.zeros(len(mask), bool))
    yield whole, start[whole], start[whole] + n[whole] + length - 1
    bits = np.nan_to_num(mask).astype(np.int64)
    some = np.flatnonzero(bits)
    bits = bits[some]
    first, last = bits & ~(bits << 1), bits & ~(bits >> 1)
    which, low = np.nonzero((first[:, None] >> np.arange(RUN)) & 1)
    high = np.nonzero((last[:, None] >> np.arange(RUN)) & 1)[1]
    which = some[which]
    yield which, start[which] + low, start[which] + high + length
