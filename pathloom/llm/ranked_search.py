"""Ranked lexical search over inverted treaps.

The documents of a shard (consecutive rows of a partition, up to SHARD_POSTINGS postings) have a treap for each term: in
search order by document, in heap order by impact, so that the root of a subtree has the greatest impact of all documents
below it. A query walks the treaps of its terms at the same time, over shrinking intervals of documents: an interval's
bound is the sum of its subtrees' roots, and an interval whose bound cannot enter the top k is dropped with everything
below. Otherwise it is split at the document of the weightiest root, whose score is then told exactly.

1. Every text is read once: its number of terms, and how often it has each term that some query asks for, go to staged
   postings (a row for each document). Only such terms can score; the other terms count for lengths.
2. Documents, lengths and document frequencies are summed over all rows; they fix weights and impacts.
3. Each task builds the treaps of one shard after another and answers all queries, in blocks; what it has found so far
   prunes the next shard. A task returns k rows for each query, and these are ranked by query.

Bounds: the queries are the stated query set. Their distinct terms (64-bit hash, weight) are held by each task and
refused beyond MOST_TERMS, and the walk takes QUERY_BLOCK queries at a time. Walks hold at most FRONTIER roots and put the rest
aside. A document with more terms than a shard's bound is a shard of its own.

Edge cases: null and empty texts have no terms, count for nothing and are never found; an item without terms has no rows;
repeated items are ranked each; repeated rows of a doc_id are documents of their own and listed each; null ids come after
equal scores of others; a very long text is read whole; equal scores go by doc_id; other columns are ignored, whatever
their names; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, _BYTE, _STEP, bounded_batches, mix, slices, staged, table, text_buffers

K = 10
#: Distinct terms of all queries, queries walked at a time, postings of a shard, and roots of a walk held at a time.
MOST_TERMS, QUERY_BLOCK, SHARD_POSTINGS, FRONTIER = 1_000_000, 64, 1 << 21, 1 << 20
#: Fixed values of the score: saturation and length normalisation in thousandths and hundredths.
UNIT, TF_UNIT, LENGTH_UNIT, LENGTH_PART, WEIGHT_UNIT = 1_000_000_000, 1000, 8, 75, 1000

#: Bytes of a term: ASCII letters and digits, and all bytes of other characters.
IN_TERM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    IN_TERM[_a:_b] = True
_HASH = np.where(IN_TERM, _BYTE[LOWER], np.uint64(0))


class Terms(NamedTuple):
    """Hashes of the terms of some rows; ``row_at[i]:row_at[i + 1]`` are row i's."""

    hash: np.ndarray
    row_at: np.ndarray


def split_terms(data: np.ndarray, offsets: np.ndarray) -> Terms:
    """The terms of consecutive rows, A-Z lower-cased, as 64-bit hashes of their bytes."""
    inside = IN_TERM[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(start):
        return Terms(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    place = np.zeros(len(data), np.int64)
    place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    longest = int((end - start).max())
    powers = np.cumprod(np.full(longest, _STEP, np.uint64))
    np.minimum(place, longest - 1, out=place)
    value = _HASH[data]
    value *= powers[place]
    return Terms(mix(np.add.reduceat(value, start)), np.searchsorted(start, offsets))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(query long, item_id, term long, n) staged, a row for each distinct term of a query, and the sorted distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            terms = split_terms(data, offsets)
            hashes = [terms.hash[a:b].view(np.int64) for a, b in zip(terms.row_at, terms.row_at[1:])]
            yield pa.record_batch([batch.column("query"), batch.column("item_id"), pa.array([h.tolist() for h in hashes], pa.list_(pa.int64()))], names=["query", "item_id", "terms"])

    kind = queries.schema[id_col].dataType.simpleString()
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"query long, item_id {kind}, terms array<long>").select("query", "item_id", F.explode("terms").alias("term"))
    found = staged(found.groupBy("query", "item_id", "term").agg(F.count("*").alias("n")), "query-terms")
    known = found.select("term").distinct().limit(MOST_TERMS + 1).toPandas()["term"].to_numpy(np.int64)
    if len(known) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} distinct terms of queries; search in several query sets")
    return found, np.sort(known)


def postings(docs: DataFrame, known: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): each document with at least one term; terms are places in known. Staged."""
    bounded_batches(docs.sparkSession)
    order = np.argsort(known.view(np.uint64))
    by_hash = known.view(np.uint64)[order]
    held = docs.sparkSession.sparkContext.broadcast((by_hash, order.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = held.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                terms = split_terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lengths = np.diff(terms.row_at)
                at = np.searchsorted(hashes, terms.hash)
                np.minimum(at, max(len(hashes) - 1, 0), out=at)
                hit = np.flatnonzero(hashes[at] == terms.hash) if len(hashes) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b - a), lengths)[hit]
                key, tf = np.unique(row * np.int64(max(len(hashes), 1)) + places[at[hit]], return_counts=True) if len(hit) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                row, term = np.divmod(key, max(len(hashes), 1))
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                some = pa.array(lengths > 0)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
                out = pa.record_batch([batch.column("doc_id")[a:b], pa.array(lengths.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(some)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")


class Treaps(NamedTuple):
    """Treaps of the terms of one shard over its documents 0, 1, ... by doc_id (no_id: it is null). Posting p has document ``doc[p]`` and impact
    ``impact[p]`` and the children ``left[p]`` and ``right[p]`` (-1: none); postings of a term stand together, by document."""

    doc_ids: np.ndarray
    no_id: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: dict[int, int]


def _nearest_above(impact: np.ndarray, bound: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest earlier one, not before bound, with a greater (or, if not strict, equal) impact; -1: none.

    What a candidate has jumped over is no greater than itself, so taking over its own candidate is safe: rounds double
    the reach where impacts ascend.
    """
    at = np.arange(len(impact)) - 1
    at[at < bound] = -1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        other = impact[at[open_]]
        below = other <= impact[open_] if strict else other < impact[open_]
        open_ = open_[below]
        at[open_] = at[at[open_]]
        at[open_] = np.where(at[open_] < bound[open_], -1, at[open_])
        open_ = open_[at[open_] >= 0]
    return at


def build_treaps(doc_ids: np.ndarray, no_id: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Treaps:
    """Treaps of postings in any order. Of equal impacts the one of the earlier document stands above."""
    order = np.lexsort((doc, term))
    doc, term, impact = doc[order], term[order], impact[order]
    n = len(doc)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    before = _nearest_above(impact, begin, strict=False)
    after = _nearest_above(impact[::-1], (n - end)[::-1], strict=True)[::-1]
    after = np.where(after >= 0, n - 1 - after, -1)
    # The parent is the lower one of the two that enclose a posting.
    under_before = (before >= 0) & ((after < 0) | (impact[before] < impact[after]))
    left, right = np.full(n, -1), np.full(n, -1)
    at = np.flatnonzero(under_before)
    right[before[at]] = at
    at = np.flatnonzero(~under_before & (after >= 0))
    left[after[at]] = at
    roots = np.flatnonzero((before < 0) & (after < 0))
    return Treaps(doc_ids, no_id, term, doc, impact, left, right, dict(zip(term[roots].tolist(), roots.tolist())))


class Found:
    """The k best documents of each query so far: scores and ids, best first; ``bar`` is the score to reach."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.doc = np.zeros((queries, k), np.int64), np.full((queries, k), np.iinfo(np.int64).max)
        self.null = np.zeros((queries, k), bool)

    @property
    def bar(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], 1)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.bar[query]
        query, score, doc, null = query[good], score[good], doc[good], null[good]
        if not len(query):
            return
        met = np.unique(query)
        old = np.repeat(met, self.k)
        query, score = np.append(query, old), np.append(score, self.score[met].ravel())
        doc, null = np.append(doc, self.doc[met].ravel()), np.append(null, self.null[met].ravel())
        order = np.lexsort((doc, null, -score, query))
        query, score, doc, null = query[order], score[order], doc[order], null[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        at = (query[best], place[best])
        self.score[at], self.doc[at], self.null[at] = score[best], doc[best], null[best]


def _within(treaps: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The root of each subtree's documents strictly between low and high; -1 if there are none."""
    node = node.copy()
    out = np.flatnonzero(node >= 0)
    while len(out):
        doc = treaps.doc[node[out]]
        early, late = doc <= low[out], doc >= high[out]
        node[out] = np.where(early, treaps.right[node[out]], np.where(late, treaps.left[node[out]], node[out]))
        out = out[early | late]
        out = out[node[out] >= 0]
    return node


def _exact(treaps: Treaps, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Impact of the document in each subtree, 0 where it has no posting: a search in document order."""
    node = node.copy()
    out = np.flatnonzero(node >= 0)
    while len(out):
        here = treaps.doc[node[out]]
        out, here = out[here != doc[out]], here[here != doc[out]]
        node[out] = np.where(here > doc[out], treaps.left[node[out]], treaps.right[node[out]])
        out = out[node[out] >= 0]
    return np.where(node >= 0, treaps.impact[node], 0)


class Front(NamedTuple):
    """Intervals of documents, each strictly between low and high for a query, and the roots of their terms' subtrees:
    root i, of that weight, belongs to interval ``row[i]``; the roots of an interval stand together."""

    query: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray
    node: np.ndarray
    weight: np.ndarray

    def only(self, keep: np.ndarray) -> Front:
        """The intervals of that mask."""
        some = keep[self.row]
        return Front(self.query[keep], self.low[keep], self.high[keep], (np.cumsum(keep) - 1)[self.row[some]], self.node[some], self.weight[some])

    def starts(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(len(self.query)))


def _front(query: np.ndarray, low: np.ndarray, high: np.ndarray, row: np.ndarray, node: np.ndarray, weight: np.ndarray) -> Front:
    """Without subtrees that are empty and intervals without subtrees."""
    live = node >= 0
    whole = Front(query, low, high, row[live], node[live], weight[live])
    return whole.only(np.bincount(whole.row, minlength=len(query)) > 0)


def walk(treaps: Treaps, asked: list[tuple[int, np.ndarray, np.ndarray]], found: Found, frontier: int = FRONTIER) -> int:
    """Search the treaps for (query, terms, weights); returns how many intervals were opened."""
    if not asked:
        return 0
    sizes = [len(terms) for _, terms, _ in asked]
    node = np.array([treaps.root.get(t, -1) for _, terms, _ in asked for t in terms.tolist()], np.int64)
    n = len(asked)
    aside = [_front(np.array([q for q, _, _ in asked]), np.full(n, -1), np.full(n, len(treaps.doc_ids)), np.repeat(np.arange(n), sizes), node, np.concatenate([w for _, _, w in asked]))]
    opened = 0
    while aside:
        front = aside.pop()
        if not len(front.query):
            continue
        bound = np.add.reduceat(front.weight * treaps.impact[front.node], front.starts())
        keep = bound >= found.bar[front.query]
        front, bound = front.only(keep), bound[keep]
        if not len(bound):
            continue
        if len(front.node) > frontier and len(bound) > 1:
            # The intervals of the higher bounds go first: what is found there raises the bar for the others.
            order = np.argsort(bound, kind="stable")
            low = np.zeros(len(bound), bool)
            low[order[: len(order) // 2]] = True
            aside += [front.only(low), front.only(~low)]
            continue
        opened += len(bound)
        # Split at the document of the weightiest root, and tell its score.
        query, starts, row = front.query, front.starts(), front.row
        part = front.weight * treaps.impact[front.node]
        at = np.flatnonzero(part == np.maximum.reduceat(part, starts)[row])
        doc = treaps.doc[front.node[at[np.searchsorted(row[at], np.arange(len(query)))]]]
        cut = doc[row]
        found.add(query, np.add.reduceat(front.weight * _exact(treaps, front.node, cut), starts), treaps.doc_ids[doc], treaps.no_id[doc])
        halves = _within(treaps, front.node, front.low[row], cut), _within(treaps, front.node, cut, front.high[row])
        aside.append(_front(np.tile(query, 2), np.append(front.low, doc), np.append(doc, front.high), np.append(row, row + len(query)), np.concatenate(halves), np.tile(front.weight, 2)))
    return opened


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = np.array([100 - LENGTH_PART + (LENGTH_PART * int(x) * documents) // length for x in np.unique(n).tolist()], np.int64)
    return (UNIT * tf) // (TF_UNIT * tf + LENGTH_UNIT * m[np.searchsorted(np.unique(n), n)])


def term_weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT_UNIT * math.log((2 * documents + 2) / (2 * df + 1)))


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        at = np.asarray(batch.column("terms").offsets).astype(np.int64)
        for a, b in slices(at, limit):
            if size and size + at[b] - at[a] > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += at[b] - at[a]
    if held:
        yield pa.Table.from_batches(held)


def ranked(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query, item_id, rank, doc_id, score): the k best documents of each query; query numbers the rows of queries."""
    spark = docs.sparkSession
    asked, known = query_terms(queries, query_id, query_text)
    index = postings(docs, known, id_col, text_col)
    whole = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).head()
    documents, length = whole["documents"], whole["length"]
    frequency = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weights = np.zeros(len(known), np.int64)
    for r in frequency.collect():  # at most a row for each term of the queries
        weights[r["t"]] = term_weight(documents, r["df"])
    # The bounded query set: for each query its terms' places and weights.
    rows = asked.select("query", "term", "n").toPandas().sort_values(["query", "term"])
    names = rows["query"].drop_duplicates().tolist()
    of = np.searchsorted(known, rows["term"].to_numpy(np.int64))
    groups = np.searchsorted(rows["query"].to_numpy(), names)
    sets = [(i, of[a:b], weights[of[a:b]] * rows["n"].to_numpy(np.int64)[a:b]) for i, (a, b) in enumerate(zip(groups, np.append(groups[1:], len(rows))))]
    held = spark.sparkContext.broadcast([(i, t[w > 0], w[w > 0]) for i, t, w in sets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = held.value
        found = Found(len(sets), k)
        for shard in _shards(batches, SHARD_POSTINGS):
            ids = shard.column("doc_id").combine_chunks()
            order = pa.compute.sort_indices(ids, null_placement="at_end")
            shard = shard.take(order).combine_chunks()
            ids = shard.column("doc_id").combine_chunks()
            no_id = np.asarray(ids.is_null())
            terms, tfs = (shard.column(c).combine_chunks() for c in ("terms", "tfs"))
            counts = np.diff(np.asarray(terms.offsets))
            doc = np.repeat(np.arange(len(ids)), counts)
            n = np.asarray(shard.column("n").combine_chunks())
            tf = np.asarray(tfs.flatten()).astype(np.int64)
            treaps = build_treaps(np.asarray(ids.fill_null(0)), no_id, doc, np.asarray(terms.flatten()).astype(np.int64), impacts(tf, np.repeat(n, counts), documents, length))
            for at in range(0, len(sets), QUERY_BLOCK):
                walk(treaps, sets[at : at + QUERY_BLOCK], found)
        some = found.score > 0
        which = np.nonzero(some)[0]
        ids = pa.array(found.doc[some], mask=found.null[some])
        yield pa.record_batch([pa.array([names[i] for i in which], pa.int64()), ids, pa.array(found.score[some])], names=["query", "doc_id", "score"])

    best = index.filter(F.size("terms") > 0).mapInArrow(run, "query long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = best.withColumn("rank", place).filter(F.col("rank") <= k)
    items = asked.groupBy("query").agg(F.first("item_id").alias("item_id"))
    return best.join(items, "query").select("query", "item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")
