"""Quality classifier from weak labels: expectation-maximisation over overlapping heuristic labellers, whose posterior
labels train a hashed linear scorer.

Labellers look at counts of a text's bytes and words and vote good (1), bad (-1) or abstain (0). Their votes on all
documents are counted by pattern (at most 3 to the number of labellers rows); EM estimates from the counts the share of
good documents and each labeller's accuracy (its vote rates on good and on bad ones). A logistic scorer on hashed character trigrams and a few hashed, binned
counts is fitted to the posteriors of at most TRAIN_ROWS documents, those with the smallest hash of their id. Tasks count the buckets
of these (at most BUCKETS counts a text, however long), and one task fits; only its weights reach the driver. The scorer
scores every document, also those on which all labellers abstain.

Edge cases: a null or empty text has no words and is scored like any other; repeated rows come back as often; null ids stay
null and are not trained on; of several texts of one id the greatest is trained on; equal hashes of ids go by id; very long texts are measured and scored
whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, bounded_batches, slices, split_words, staged, table, text_buffers

BUCKETS, TRAIN_ROWS, KEEP_AT, MEASURES = 1 << 15, 4000, 0.5, 10
LABELLERS = ("symbols", "letters", "bars", "top_word", "upper", "bangs", "echo", "varied")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>{}[]\\^~", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = ((LOWER[np.arange(256)] >= 97) & (LOWER[np.arange(256)] <= 122)) | (np.arange(256) >= 128)


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[offsets])


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: words, then shares: symbols, upper case, bars, the commonest word, word size, bangs, letters, distinct words, words equal to the one before."""
    words = split_words(data, offsets)
    n = np.diff(words.row_at).astype(np.float64)
    sizes = _row_sums(~np.isin(data, [0x20, *range(9, 14)]), offsets)
    per_word, per_byte = np.maximum(n, 1), np.maximum(sizes, 1)
    top, distinct, echo = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i in range(len(n)):
        h = words.hash[words.row_at[i] : words.row_at[i + 1]]
        if len(h):
            counts = np.unique(h, return_counts=True)[1]
            top[i], distinct[i], echo[i] = counts.max(), len(counts), np.count_nonzero(h[1:] == h[:-1])
    return np.stack([n, _row_sums(_SYMBOL[data], offsets) / per_word, _row_sums(_UPPER[data], offsets) / per_byte, _row_sums(data == ord("|"), offsets) / per_word, top / per_word, sizes / per_word, _row_sums(data == ord("!"), offsets) / per_word, _row_sums(_LETTER[data], offsets) / per_byte, distinct / per_word, echo / per_word], axis=1)


def sample_measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same for many rows, a slice at a time, which bounds the memory."""
    parts = [measures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, MEASURES))


def votes(m: np.ndarray) -> np.ndarray:
    """The labellers' votes, one row per text."""
    n, symbols, upper, bars, top, _, bangs, letters, distinct, echo = m.T

    def vote(good, bad):
        return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)

    some = n >= 10
    return np.stack([
        vote(symbols <= 0.1, symbols > 0.5),
        vote((letters >= 0.85) & some, (letters < 0.72) & (n != 1)),
        vote(bars <= 0.05, (bars > 0.25) & (n >= 5)),
        vote((top <= 0.15) & some, (top > 0.3) & some),
        vote((upper <= 0.15) & some, (upper > 0.5) & (n >= 2)),
        vote(bangs <= 0.05, bangs > 0.4),
        vote((echo <= 0.02) & some, (echo > 0.3) & some),
        vote((distinct >= 0.35) & some, (distinct < 0.2) & some),
    ], axis=1)


def posteriors(v: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    """P(good | votes). rates[c, j]: how often labeller j, when it votes, votes good on documents of class c (1: good)."""
    odds = np.where(v > 0, np.log(rates[1] / rates[0]), np.where(v < 0, np.log((1 - rates[1]) / (1 - rates[0])), 0)).sum(axis=1)
    return 1 / (1 + np.exp(-odds - math.log(prior / (1 - prior))))


def estimate(v: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """EM from counts of vote patterns: (share of good, how often each labeller's votes are good by class).

    The labellers overlap in twos: each fault is seen by more than one, so that their agreement tells how good they are. A
    document has few faults of all, so the start takes a pattern for bad once any labeller calls it bad. Abstaining says
    nothing. A labeller that votes good more often on bad documents than on good ones is given no say.
    """
    p = np.where((v < 0).any(axis=1), 0.02, 0.98)
    prior, rates = 0.8, np.full((2, v.shape[1]), 0.5)
    for _ in range(rounds if counts.sum() else 0):
        for c, share in ((1, p), (0, 1 - p)):
            weight = (counts * share)[:, None]
            rates[c] = ((weight * (v > 0)).sum(axis=0) + 0.5) / ((weight * (v != 0)).sum(axis=0) + 1)
        rates[:, rates[1] < rates[0]] = 0.5
        prior = float(np.clip((counts * p).sum() / counts.sum(), 0.01, 0.99))
        p = posteriors(v, prior, rates)
    return prior, rates


def trigram_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bucket for each byte: that of the trigram that begins there (digits and other letters fold), zeros after a row's end."""
    folded = np.where(data >= 128, np.uint8(128), np.where((data >= 48) & (data <= 57), np.uint8(48), data)).astype(np.uint32)
    second, third = np.zeros_like(folded), np.zeros_like(folded)
    second[:-1], third[:-2] = folded[1:], folded[2:]
    ends = offsets[1:][np.diff(offsets) > 0]
    second[ends - 1] = third[ends - 1] = third[np.maximum(ends - 2, 0)] = 0
    return ((folded * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77) + third * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)


def binned(m: np.ndarray) -> np.ndarray:
    """Buckets after the trigrams': each measure in steps of its own, 16 for each."""
    steps = np.minimum(np.concatenate([np.log2(m[:, :1] + 1), 15 * np.minimum(m[:, 1:5], 1), m[:, 5:6], 15 * np.minimum(m[:, 6:], 1)], axis=1), 15).astype(np.int64)
    return BUCKETS + steps + 16 * np.arange(m.shape[1])


def raw_scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, m: np.ndarray) -> np.ndarray:
    length = np.maximum(np.diff(offsets), 1)
    return _row_sums(weights[trigram_keys(data, offsets)], offsets) / np.sqrt(length) + weights[binned(m)].sum(axis=1) + weights[-1]


def counted_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the trigrams of each row."""
    rows, keys, counts = [], [], []
    for lo, hi in slices(offsets):
        base = offsets[lo]
        code = trigram_keys(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
        code += np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])) * BUCKETS
        found, n = np.unique(code, return_counts=True)
        rows.append((lo + found // BUCKETS).astype(np.int32))
        keys.append((found % BUCKETS).astype(np.int32))
        counts.append(n.astype(np.float32))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, keys, counts))


class Sample(NamedTuple):
    """Training texts as counts: entry i is ``value[i]`` in bucket ``keys[i]`` of text ``owner[i]``; texts follow each other.
    ``dense``: the buckets of each text's measures; ``labels``: their posteriors."""

    owner: np.ndarray
    keys: np.ndarray
    value: np.ndarray
    dense: np.ndarray
    labels: np.ndarray


def scaled(counts: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return counts / np.sqrt(np.maximum(sizes, 1)).astype(np.float32)[owner]


def fit_counts(sample: Sample, rounds: int = 30, rate: float = 0.5, step: int = 1 << 20) -> np.ndarray:
    """Logistic regression on posterior labels by full-batch AdaGrad; entries are taken ``step`` at a time."""
    rows, size = len(sample.labels), BUCKETS + 16 * MEASURES + 1
    weights, grown = np.zeros(size), np.full(size, 1e-6)
    if rows == 0:
        return weights
    parts = [slice(at, at + step) for at in range(0, len(sample.owner), step)]
    for _ in range(rounds):
        score = weights[sample.dense].sum(axis=1) + weights[-1]
        for p in parts:
            score += np.bincount(sample.owner[p], weights=weights[sample.keys[p]] * sample.value[p], minlength=rows)
        error = 1 / (1 + np.exp(-score)) - sample.labels
        grad = np.zeros(size)
        for p in parts:
            grad += np.bincount(sample.keys[p], weights=error[sample.owner[p]] * sample.value[p], minlength=size)
        np.add.at(grad, sample.dense.ravel(), np.repeat(error, sample.dense.shape[1]))
        grad[-1] = error.sum()
        grad = grad / rows + 1e-5 * weights
        grown += grad * grad
        weights -= rate * grad / np.sqrt(grown)
    return weights


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 30, rate: float = 0.5) -> np.ndarray:
    """fit_counts over texts at hand."""
    data, offsets = text_buffers(texts)
    owner, keys, counts = counted_keys(data, offsets)
    value = scaled(counts, owner, np.diff(offsets))
    return fit_counts(Sample(owner, keys, value, binned(sample_measures(data, offsets)), labels), rounds, rate)


_NONE = Sample(*(np.zeros(0, np.int64),) * 3, np.zeros((0, MEASURES), np.int64), np.zeros(0))
COUNTED = "doc_id long, size long, votes binary, dense array<int>, keys array<int>, counts array<float>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTED rows of (doc_id, text) rows."""
    for rows, data, offsets in _parts(batches):
        owner, keys, counts = counted_keys(data, offsets)
        at = pa.array(np.searchsorted(owner, np.arange(rows.num_rows + 1)).astype(np.int32))
        m = measures(data, offsets)
        dense = pa.array(binned(m).astype(np.int32).tolist(), pa.list_(pa.int32()))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (keys.astype(np.int32), counts.astype(np.float32))]
        cast = pa.array([v.tobytes() for v in votes(m)], pa.binary())
        yield pa.record_batch([rows.column(0), pa.array(np.diff(offsets)), cast, dense, *lists], names=[x.split()[0] for x in COUNTED.split(", ")])


def _learn(prior: float, rates: np.ndarray):
    """The weights, as bytes, from all COUNTED rows: at most TRAIN_ROWS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            cast = np.frombuffer(b"".join(t.column("votes").to_pylist()), np.int8).reshape(t.num_rows, -1)
            lengths = np.concatenate([np.diff(np.asarray(c.offsets)) for c in t.column("keys").chunks])
            owner = np.repeat(np.arange(t.num_rows, dtype=np.int32), lengths)
            keys, counts = (np.concatenate([np.asarray(c.flatten()) for c in t.column(k).chunks]) for k in ("keys", "counts"))
            value = scaled(counts, owner, t.column("size").to_numpy())
            dense = np.asarray(t.column("dense").combine_chunks().flatten()).astype(np.int64).reshape(t.num_rows, -1)
            del t, counts, parts
            sample = Sample(owner, keys, value, dense, posteriors(cast, prior, rates))
        else:
            sample = _NONE
        yield pa.record_batch([pa.array([fit_counts(sample).tobytes()], pa.binary())], names=["weights"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]):
    """(rows, bytes, offsets) of slices of batches whose second column is the text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in slices(offsets):
            base = offsets[lo]
            yield batch.slice(lo, hi - lo), data[base : offsets[hi]], offsets[lo : hi + 1] - base


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, p_label (posterior of the labellers alone), p_good (of the scorer) and kept (p_good >= keep_at).

    With carry: also the text, and struct ``carried`` of these columns, so that a verdict stays with its row and is not
    joined back by an id.
    """
    bounded_batches(docs.sparkSession)
    whole, docs = docs, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [f"v_{x}" for x in LABELLERS]

    def vote(batches):
        for rows, data, offsets in _parts(batches):
            yield pa.record_batch([rows.column(0), *(pa.array(c) for c in votes(measures(data, offsets)).T)], names=["doc_id", *names])

    voted = staged(docs.mapInArrow(vote, "doc_id long, " + ", ".join(f"{x} byte" for x in names)), "votes")
    counted = voted.groupBy(*names).agg(F.count("*").alias("n")).toPandas()  # at most 3 ** len(LABELLERS) rows
    prior, rates = estimate(counted[names].to_numpy(np.int64).reshape(-1, len(names)), counted["n"].to_numpy(np.float64))
    drawn = docs.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "doc_id").distinct().orderBy("h", "doc_id").limit(train_rows)
    sample = docs.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    fitted = sample.mapInArrow(_count, COUNTED).repartition(1).sortWithinPartitions("doc_id").mapInArrow(_learn(prior, rates), "weights binary")
    learnt = fitted.head(1)
    weights = np.frombuffer(learnt[0]["weights"]) if learnt else fit_counts(_NONE)
    shared = docs.sparkSession.sparkContext.broadcast((weights, prior, rates))

    def score(batches):
        weights, prior, rates = shared.value
        for rows, data, offsets in _parts(batches):
            m = measures(data, offsets)
            p = 1 / (1 + np.exp(-raw_scores(weights, data, offsets, m)))
            label = posteriors(votes(m), prior, rates)
            more = {"text": rows.column(1), "carried": rows.column(2)} if carry else {}
            yield pa.record_batch({"doc_id": rows.column(0), "p_label": pa.array(label), "p_good": pa.array(p), "kept": pa.array(p >= keep_at), **more})

    kinds = StructType().add("doc_id", "long").add("p_label", "double").add("p_good", "double").add("kept", "boolean")
    if not carry:
        return docs.mapInArrow(score, kinds)
    carried = F.struct(*(F.col(f"`{c}`") for c in carry))
    told = whole.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried"))
    return told.mapInArrow(score, kinds.add("text", "string").add("carried", told.schema["carried"].dataType))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
