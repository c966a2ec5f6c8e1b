"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

Per language, n-grams of code points (lower case, up to ``ORDER``) give an
interpolated Kneser-Ney model.  Its n-grams are keyed by a 64-bit hash and kept as sorted
arrays, one row of values per key with a column per language, so one binary search serves
all languages.  A text gets the language of the lowest length-normalised cross-entropy;
``score`` is the calibrated probability of that language.  A text whose cross-entropy is
beyond what its language's own texts show (``limit``, from a calibration part of the
training rows) is marked ``rejected``.

Training reads at most ``SAMPLE`` rows a language in expectation (whole texts, chosen by
a hash of text and id), which bounds the model; every row is scored in full.

Defined cases: text null or without a letter is ``und`` with score 0 and rejected; a null
lang is never learned; nothing to learn from makes everything ``und``; ties go to the
language first by code point; repeated rows count; more columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueweave.llm.common import slices

ORDER = 4
SAMPLE = 500  # training rows a language, at most (in expectation)
CHUNK = 1 << 17  # code points scored at a time
CACHE_BITS = 20
MARGIN = 3.0  # bits a character beyond the worst calibration texts of a language
_A = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points.astype(np.uint64)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash for the n-gram that ends at each position (from order - 1 on)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, order, dtype=np.uint64)
    for i in range(order):
        out = (out ^ (points[i : i + n] + np.uint64(1))) * _A
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Model:
    """Arrays by order: keys (sorted hashes) with a probability or a back-off per language."""

    languages: list[str]
    gram_keys: list[np.ndarray]
    gram_p: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_backoff: list[np.ndarray]
    floor: np.ndarray
    scale: float = 1.0
    limit: np.ndarray | None = None

    def probabilities(self, points: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        """p(character | up to order - 1 before it) at positions, one column per language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.languages)))
        lower = self.probabilities(points, at, order - 1)
        reach = at >= order - 1
        span = np.arange(order) - (order - 1)
        grams = points[np.maximum(at, order - 1)[:, None] + span]
        whole, context = _rows_hash(grams, order), _rows_hash(grams[:, :-1], order - 1)
        found = _look_up(self.gram_keys[order - 1], self.gram_p[order - 1], whole, 0.0)
        backoff = _look_up(self.context_keys[order - 1], self.context_backoff[order - 1], context, 1.0)
        return np.where(reach[:, None], found + backoff * lower, lower)


def _rows_hash(grams: np.ndarray, order: int) -> np.ndarray:
    out = np.full(len(grams), order, dtype=np.uint64)
    for i in range(order):
        out = (out ^ (grams[:, i] + np.uint64(1))) * _A
        out ^= out >> np.uint64(29)
    return out


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


def build(texts: pd.DataFrame) -> Model:
    """The model of a bounded sample of (lang, text) rows, some of them kept for calibration."""
    texts = texts.sort_values(["lang", "text"], kind="stable")
    languages = sorted(texts["lang"].unique())
    held = np.arange(len(texts)) % 5 == 4
    own = {g: list(texts["text"][(texts["lang"] == g) & ~held]) for g in languages}
    tables = [_counts(own[g]) for g in languages]
    alphabet = len({c for texts_ in own.values() for t in texts_ for c in t.lower()}) + 1
    model = Model(languages, [], [], [], [], np.full(len(languages), 1.0 / alphabet))
    for order in range(1, ORDER + 1):
        grams, contexts = zip(*[t[order - 1] for t in tables], strict=True)
        for keys, values, parts, empty in (
            (model.gram_keys, model.gram_p, grams, 0.0),
            (model.context_keys, model.context_backoff, contexts, 1.0),
        ):
            union = np.unique(np.concatenate([k for k, _ in parts]))
            table = np.full((len(union), len(languages)), empty)
            for column, (k, v) in enumerate(parts):
                table[np.searchsorted(union, k), column] = v
            keys.append(union)
            values.append(table)
    _calibrate(model, texts[held] if held.any() else texts)
    return model


def _merged(keys: list, grams: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of several parts, with their counts added up."""
    unique, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return unique, np.concatenate(grams)[first], np.bincount(back, np.concatenate(counts), len(unique))


def _counts(texts: list[str]) -> list[tuple[tuple, tuple]]:
    """For each order: (keys, discounted p) of n-grams and (keys, back-off weight) of contexts.

    The highest order uses counts, the lower ones the number of different characters
    before an n-gram (continuation counts).
    """
    found = []
    for order in range(1, ORDER + 1):
        keys, grams, counts = [np.zeros(0, np.uint64)], [np.zeros((0, order), np.uint32)], [np.zeros(0, np.int64)]
        for text in map(code_points, texts):  # one by one: only different n-grams are held
            if len(text) >= order:
                rows = np.column_stack([text[i : len(text) - order + 1 + i] for i in range(order)])
                key, first, n = np.unique(_rows_hash(rows, order), return_index=True, return_counts=True)
                keys.append(key)
                grams.append(rows[first].astype(np.uint32))
                counts.append(n)
            if sum(map(len, keys)) > 1 << 20:
                keys, grams, counts = ([x] for x in _merged(keys, grams, counts))
        found.append(_merged(keys, grams, counts))
    out = []
    for order in range(1, ORDER + 1):
        unique, grams, n = found[order - 1]
        if order < ORDER:
            suffix = _rows_hash(found[order][1][:, 1:], order)
            keys, n_before = np.unique(suffix, return_counts=True)
            seen = np.zeros(len(unique))
            seen[np.searchsorted(unique, keys)] = n_before
            n = np.maximum(seen, 1.0)
        ones, twos = float((n == 1).sum()), float((n == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = _rows_hash(grams[:, :-1], order - 1)
        keys, back = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(back, n, len(keys)), np.bincount(back, minlength=len(keys))
        p = (n - discount) / total[back] if len(n) else n
        out.append(((unique, p), (keys, discount * kinds / np.maximum(total, 1e-9))))
    return out


def _calibrate(model: Model, texts: pd.DataFrame) -> None:
    """The steepness of the score and, per language, the cross-entropy beyond which texts are rejected."""
    scorer = Scorer(model)
    entropy = scorer.entropies(list(texts["text"]))
    truth = np.searchsorted(model.languages, texts["lang"])
    rows = np.arange(len(texts))
    own = entropy[rows, truth]
    model.limit = np.array(
        [np.quantile(own[truth == i], 0.999) + MARGIN if (truth == i).any() else np.inf for i in range(len(model.languages))]
    )
    losses = []
    grid = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
    for scale in grid:
        z = -scale * (entropy - entropy.min(axis=1, keepdims=True))
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        losses.append(-np.log(np.maximum(p[rows, truth], 1e-12)).mean())
    model.scale = grid[int(np.argmin(losses))]


class Scorer:
    """Cross-entropies of texts, with a cache of the values of frequent n-grams."""

    def __init__(self, model: Model) -> None:
        self.model = model
        size = 1 << CACHE_BITS
        self.keys = np.zeros(size, dtype=np.uint64)
        self.values = np.zeros((size, len(model.languages)), dtype=np.float32)

    def _log2(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """-log2 p at positions."""
        return -np.log2(self.model.probabilities(points, at, ORDER)).astype(np.float32)

    def _totals(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of -log2 p over the stretches of points that begin at ``starts``."""
        lead = ORDER - 1
        grams = np.zeros(len(points), dtype=np.uint64)
        hashes = gram_hashes(points, ORDER)
        grams[lead : lead + len(hashes)] = hashes
        slot = (grams >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        first = (starts[:, None] + np.arange(lead)).ravel()  # no full history there
        first = np.unique(first[first < len(points)])
        wrong = self.keys[slot] != grams
        wrong[first] = False
        miss = np.flatnonzero(wrong)
        bits = self.values[slot]
        if len(miss):
            kinds, seen, back = np.unique(grams[miss], return_index=True, return_inverse=True)
            fresh = self._log2(points, miss[seen])
            bits[miss] = fresh[back]
            place = (kinds >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[place], self.values[place] = kinds, fresh
        begun = first - starts[np.searchsorted(starts, first, side="right") - 1]
        for known in range(lead):  # characters before them that count
            at = first[begun == known]
            if len(at):
                bits[at] = -np.log2(self.model.probabilities(points, at, known + 1)).astype(np.float32)
        return np.add.reduceat(bits, starts, axis=0, dtype=np.float64)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a character of each text in each language; infinite for an empty one."""
        total = np.zeros((len(texts), len(self.model.languages)))
        size = np.zeros(len(texts))
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            if group:
                ids, parts = [i for i, _ in group], [p for _, p in group]
                starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
                np.add.at(total, ids, self._totals(np.concatenate(parts), starts))
                np.add.at(size, ids, [len(p) for p in parts])
            group, held = [], 0

        for i, text in enumerate(texts):
            points = code_points(text)
            for at in range(0, len(points), CHUNK):
                group.append((i, points[at : at + CHUNK]))
                held += len(group[-1][1])
                if held >= CHUNK:
                    flush()
        flush()
        return np.divide(total, size[:, None], out=np.full_like(total, np.inf), where=size[:, None] > 0)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a row without an id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on (lang, text) rows: at most ``sample`` a language in expectation."""
    rows = labelled.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "lang", "text")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for g, n in sorted(counts.items()) for x in (g, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    return build(rows.filter(draw < share[F.col("lang")]).select("lang", "text").toPandas())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred, score, bits (cross-entropy) and rejected to ``docs`` (text, ...)."""
    added = "lang_pred string, score double, bits double, rejected boolean"
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields])
    if model is None:
        nothing = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")]
        return docs.select("*", *nothing, F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    packed = cloudpickle.dumps(model)
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # bounded by the training sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(cloudpickle.loads(shared.value))
        names = np.array([*scorer.model.languages, UNKNOWN], dtype=object)
        for batch in slices(batches):
            speaks = batch["_letters"].to_numpy(zero_copy_only=False)
            texts = [t if ok else "" for t, ok in zip(batch["text"].to_pylist(), speaks, strict=True)]
            bits = scorer.entropies(texts)
            best = bits.argmin(axis=1)
            low = np.where(speaks, bits[np.arange(len(best)), best], 0.0)
            weight = np.exp(-scorer.model.scale * (bits - low[:, None])).sum(axis=1)
            made = [
                pa.array(names[np.where(speaks, best, -1)], pa.string()),
                pa.array(np.where(speaks, 1.0 / np.maximum(weight, 1.0), 0.0)),
                pa.array(low, mask=~speaks),
                pa.array(~speaks | (low > scorer.model.limit[best])),
            ]
            kept = [c for c in batch.schema.names if c != "_letters"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *made], names=schema.names)

    given = docs.withColumn("_letters", has_letter(F.col("text")))
    return given.mapInArrow(score, schema)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the others' rows."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
