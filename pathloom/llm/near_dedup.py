"""Near-duplicate detection: many universal-hash minima, banding, signature verification, exact confirmation, and
connected components by alternating large-star and small-star.

How large groups stay cheap: texts with equal shingle sets count as one class; each band bucket first links its
members to its smallest id only (a star); after those links are confirmed and closed into components, only buckets that
still span several components compare their members, in blocks of bounded size and only across components, and report
only links that join components. Buckets of more than MOST members are banded again first, on AGAIN_ROWS more minima in
each of AGAIN bands, starred and closed again, up to TURNS times; so the rows that are shuffled grow in proportion to the
members. No group ever emits all its pairs. A pair at the threshold shares no band with a probability of 4e-10, none of the
later bands of a turn with 7e-9, and has signatures under the bound with 3e-7; all other links are found. Unlike texts that
share most of their shingles, just short of the threshold, still cost a comparison for each pair of a block.

Edge cases: a null or empty text, or one of white space, has no shingles and is linked with nothing; a text of fewer
words than ``width`` is one shingle; repeated rows of one id are one node and come back once each; a null id is returned
with component_id null and kept true; a very long text is shingled whole, its minima 2,048 shingles at a time; among equal
texts the smallest id stands for all; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, few, fresh_path, mix, only_ids, removed, slices, split_words, staged, staged_at, table, text_buffers, window_hashes

WIDTH, BANDS, ROWS_PER_BAND = 5, 40, 3
#: A link needs intersection / union of at least this, as a fraction of integers.
LINK = (75, 100)
#: Share of equal minima from which a pair is confirmed on full sets: five standard deviations under the threshold.
SIGNATURE_AT_LEAST = 0.55
#: Members of a bucket that one task compares with as many others, and of a bucket that is banded again.
BLOCK, MOST = 1024, 16 * 1024
#: Bands, and minima of each, by which large buckets are banded again, and how often that is done.
AGAIN, AGAIN_ROWS, TURNS = 240, 9, 3
#: Links of a node from which it is a hub, and the most hubs that there can be in one round.
HUB, HUBS = 200, 20_000


def _parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 2**62, count).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**62, count).astype(np.uint64)


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    return np.unique(window_hashes(words, width))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every universal hash (a x + b) >> 32 over the set, as 32-bit values."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[at : at + 2048, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _each(batches: Iterator[pa.RecordBatch]):
    """(id, word hashes) of every row."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in slices(offsets):
            base = offsets[lo]
            words = split_words(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
            for row in range(lo, hi):
                yield ids[row], words.hash[words.row_at[row - lo] : words.row_at[row - lo + 1]]


def _chunks(rows: Iterator, schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def signatures(docs: DataFrame, width: int = WIDTH, count: int = BANDS * ROWS_PER_BAND) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, signature): set_hi and set_lo identify the shingle set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("signature", pa.binary())])

    def run(batches):
        a, b = _parameters(count)

        def rows():
            for key, words in _each(batches):
                s = shingle_set(words, width)
                if len(s) == 0:
                    yield key, 0, None, None, None
                    continue
                spread = mix(s + np.uint64(0xD6E8FEB86659FD93))
                hi, lo = s.sum(dtype=np.uint64), spread.sum(dtype=np.uint64)
                yield key, len(s), int(hi.view(np.int64)), int(lo.view(np.int64)), minima(s, a, b).tobytes()

        yield from _chunks(rows(), schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, signature binary")


def _bands(classes: DataFrame, bands: int, rows_per_band: int) -> DataFrame:
    """(slot, band, node): band identifies the minima of band number slot."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, bands, rows_per_band)
            key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for r in range(rows_per_band):
                key = mix(key + sig[:, :, r].astype(np.uint64) + np.uint64(1))
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            slot = np.tile(np.arange(bands, dtype=np.int16), batch.num_rows)
            yield pa.record_batch([pa.array(slot), pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["slot", "band", "node"])

    return classes.select("node", "signature").mapInArrow(run, "slot short, band long, node long")


def _banded_again(members: DataFrame, classes: DataFrame, turn: int, bands: int = AGAIN, rows: int = AGAIN_ROWS) -> DataFrame:
    """(slot, band, node): ``bands`` rows for each member (band, node), by its old band and ``rows`` of its minima, drawn anew
    for each band and turn. slot is 0."""

    def run(batches):
        rng, chosen = np.random.Generator(np.random.PCG64(1000 + turn)), None
        for whole in batches:
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                if chosen is None:
                    chosen = np.stack([rng.permutation(sig.shape[1])[:rows] for _ in range(bands)])
                old = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                key = mix(old[:, None] + np.uint64(turn) + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                for r in range(chosen.shape[1]):
                    key = mix(key + sig[:, chosen[:, r]].astype(np.uint64) + np.uint64(1))
                node = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), bands)
                yield pa.record_batch([pa.array(np.zeros(len(node), np.int16)), pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["slot", "band", "node"])

    return members.join(classes.select("node", "signature"), "node").select("band", "node", "signature").mapInArrow(run, "slot short, band long, node long")


def _buckets(bands: DataFrame) -> DataFrame:
    """(slot, band, center, members) of the buckets of several members, staged."""
    return staged(bands.groupBy("slot", "band").agg(F.min("node").alias("center"), F.count("*").alias("members")).filter("members > 1"), "buckets")


def _agreeing(pairs: DataFrame, at_least: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree in enough places."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= at_least)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _within_size(n_a: str, n_b: str, link: tuple[int, int]):
    return (F.least(n_a, n_b) * link[1] >= F.greatest(n_a, n_b) * link[0])


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the texts whose id is in ids (column doc_id). Repeated rows of an id stay rows, so that either of its texts can link."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def shingled(batches):
        yield from _chunks(((key, shingle_set(words, width).tobytes()) for key, words in _each(batches)), schema, 50)

    return only_ids(docs, ids, "doc_id").mapInArrow(shingled, "node long, shingles binary")


def _near(x: np.ndarray, y: np.ndarray, link: tuple[int, int]) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return link[1] * common >= link[0] * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, link: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are near enough; only the texts in pairs are shingled again."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = pa.array([_near(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), link) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _stars(bands: DataFrame, buckets: DataFrame, classes: DataFrame, docs: DataFrame, width: int, at_least: float, link: tuple[int, int], labels: DataFrame | None = None) -> DataFrame:
    """Confirmed links (a, b) of buckets' members to their smallest; with labels (node, component) only between components."""
    spokes = bands.join(buckets.select("slot", "band", "center"), ["slot", "band"]).filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    if labels is not None:
        for end in ("a", "b"):
            spokes = spokes.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        spokes = spokes.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    one, two = (classes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("signature").alias(f"sig_{k}")) for k in ("a", "b"))
    sized = spokes.join(one, "a").join(two, "b").filter(_within_size("n_a", "n_b", link)).select("a", "b", "sig_a", "sig_b")
    return staged(_confirmed(staged(_agreeing(sized, at_least), "pairs"), docs, width, link), "confirmed")


def _least(rows: DataFrame) -> DataFrame:
    """(u, m, n): the least v of each u of rows (u, v), and how many rows it has."""
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _with_least(rows: DataFrame, least: DataFrame, edges: int, hub: int) -> DataFrame:
    """rows (u, v), each with the m of its u by least (see _least), staged.

    A node with many rows would bring them all to one task: nodes with more than ``hub`` rows, and more than one in HUBS of
    all, of which there are at most HUBS, are joined by broadcast and keep their rows where they are.
    """
    busy = max(hub, edges // HUBS)
    if (least.agg(F.max("n")).head()[0] or 0) <= busy:
        return rows.join(least.select("u", "m"), "u")
    hubs, rest = (least.filter(which).select("u", "m") for which in (F.col("n") > busy, F.col("n") <= busy))
    return rows.join(F.broadcast(hubs), "u").union(rows.join(F.broadcast(hubs), "u", "left_anti").join(rest, "u"))


def connected_components(edges: DataFrame, most_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node that can be reached.

    Alternates large-star (every larger neighbour of u is hung on u's smallest neighbour) and small-star (u and its
    smaller neighbours are hung on the smallest of them) until the edges stay as they are. Each star and its minima are
    staged, since a star reads them several times: one plan for a whole round would hold copies of copies, over a thousand
    nodes, which the driver has to plan and keep. What a round no longer reads is removed. All rounds have the same plans,
    in which no key has many rows, so they run in a session of their own that does not plan again after each shuffle.
    """
    spark, folder = edges.sparkSession, fresh_path(edges.sparkSession, "links")
    rounds = spark.newSession()
    rounds.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    rounds.conf.set("spark.sql.adaptive.enabled", "false")
    first = staged_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{folder}/0")
    links = rounds.read.schema(first.schema).parquet(f"{folder}/0")
    state, n = None, links.count()
    for turn in range(1, most_rounds + 1):
        steps = f"{folder}/{turn}-steps"
        back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = staged_at(_least(links.union(back)), f"{steps}/large-least")
        large = staged_at(_with_least(back, least, 2 * n, hub).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), f"{steps}/large")
        removed(spark, f"{folder}/{turn - 1}")
        least = staged_at(_least(large), f"{steps}/small-least")
        hung = _with_least(large, least, n, hub).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = staged_at(least.select("u", F.col("m").alias("v")).union(hung).distinct(), f"{folder}/{turn}")
        removed(spark, steps)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    links = spark.read.schema(first.schema).parquet(f"{folder}/{turn}")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links (a, b): only the components that links join are closed again. Staged."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    met = staged(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a != b").distinct(), "met")
    if not met.head(1):
        return labels
    moved = staged(connected_components(met), "moved")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(F.broadcast(to) if few(to) else to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return staged(old.union(moved.join(labels, "node", "left_anti").select("node", "component")), "labels")


class _Group:
    """The members of one bucket block pair, and which pairs of them are worth a full comparison."""

    def __init__(self, t: pa.Table, bands: int, link: tuple[int, int], at_least: float):
        self.node, self.component, self.own = (t.column(c).to_numpy() for c in ("node", "component", "own"))
        self.n, self.slot, self.i, self.j = t.column("n_shingles").to_numpy(), *(t.column(c)[0].as_py() for c in ("slot", "i", "j"))
        self.signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(t.num_rows, bands, -1)
        self.link, self.at_least = link, at_least

    def partners(self):
        """(member, other members, agreement): other components, near in size and signature, first met in this band."""
        left, right = np.flatnonzero(self.own == self.i), np.flatnonzero(self.own == self.j)
        for x in left:
            y = right[(self.component[right] != self.component[x]) & (np.minimum(self.n[right], self.n[x]) * self.link[1] >= np.maximum(self.n[right], self.n[x]) * self.link[0])]
            if self.i == self.j:
                y = y[self.node[y] > self.node[x]]
            equal = self.signature[y] == self.signature[x]
            share = equal.mean(axis=(1, 2))
            y, share, equal = (v[share >= self.at_least] for v in (y, share, equal))
            first = equal[:, : self.slot].all(axis=2).any(axis=1) if self.slot else np.zeros(len(y), bool)
            if (~first).any():
                yield x, y[~first], share[~first]


def _opened(bands: DataFrame, crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """(slot, band, node, members, component) of the members of those crowded buckets that span several components."""
    labelled = bands.join(crowded.select("slot", "band", "members"), ["slot", "band"]).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = labelled.groupBy("slot", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("slot", "band")
    return labelled.join(open_, ["slot", "band"], "left_semi")


def _across(bands: DataFrame, crowded: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, width: int, at_least: float, link: tuple[int, int], bands_n: int, block: int) -> DataFrame:
    """Confirmed links (a, b) between different components, from buckets that span several.

    Members are compared in blocks, first by signature; those with a likely partner fetch their full sets and are compared
    again. A task reports only links that join what it has not joined yet, so fewer than its members.
    """
    rows = _opened(bands, crowded, labels).join(classes.select("node", "n_shingles", "signature"), "node")
    blocks = F.ceil(F.col("members") / F.lit(block))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("slot", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n_shingles", "signature")
    key = ["slot", "band", "i", "j"]

    def likely(t: pa.Table) -> pa.Table:
        group, some = _Group(t, bands_n, link, at_least), np.zeros(t.num_rows, bool)
        for x, y, _ in group.partners():
            some[x] = some[y] = True
        return t.filter(pa.array(some))

    kinds = "slot short, band long, i long, j long, own long, node long, component long, n_shingles long, signature binary"
    found = staged(dealt.groupBy(*key).applyInArrow(likely, kinds), "likely")
    sets = _sets(docs, found.select(F.col("node").alias("doc_id")).distinct(), width).groupBy("node").agg(F.collect_set("shingles").alias("sets"))  # a set for each text of an id

    def confirm(t: pa.Table) -> pa.Table:
        group, root = _Group(t, bands_n, link, at_least), {}
        texts = [[np.frombuffer(x, np.uint64) for x in own] for own in t.column("sets").to_pylist()]

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]] if root[c] in root else root[c]
            return c

        tries = sorted(((-s, x, v) for x, y, share in group.partners() for v, s in zip(y.tolist(), share.tolist())), key=lambda z: z[0])
        out = []
        for _, x, y in tries:
            a, b = top(group.component[x]), top(group.component[y])
            if a != b and any(_near(p, q, link) for p in texts[x] for q in texts[y]):
                root[max(a, b)] = min(a, b)
                out.append((min(group.node[x], group.node[y]), max(group.node[x], group.node[y])))
        return pa.table({"a": np.array([p for p, _ in out], np.int64), "b": np.array([q for _, q in out], np.int64)})

    return found.join(sets, "node").groupBy(*key).applyInArrow(confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bands: int = BANDS, rows_per_band: int = ROWS_PER_BAND, link: tuple[int, int] = LINK, at_least: float = SIGNATURE_AT_LEAST, block: int = BLOCK, most: int = MOST, turns: int = TURNS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(signatures(docs, width, bands * rows_per_band), "signatures")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    classes = staged(known.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    members = _bands(classes, bands, rows_per_band)
    buckets = _buckets(members)
    labels = staged(connected_components(_stars(members, buckets, classes, docs, width, at_least, link)), "labels")
    late = []
    for turn in range(1, turns + 2):
        hot = buckets.filter(F.col("members") > most)
        done = turn > turns or not hot.head(1)
        small = buckets if done else buckets.filter(F.col("members") <= most)
        late.append(staged(_across(members, small, classes, labels, docs, width, at_least, link, bands, block), "rest"))
        if done:
            break
        old = F.lit(0).cast("long") if turn == 1 else F.col("band")
        members = staged(_banded_again(_opened(members, hot, labels).select(old.alias("band"), "node").distinct(), classes, turn), "bands-again")
        buckets = _buckets(members)
        labels = _joined_up(labels, _stars(members, buckets, classes, docs, width, at_least, link, labels))
    # Different texts of one repeated id are one node: their classes are linked through it.
    twice = known.groupBy("doc_id").agg(F.count_distinct("set_hi", "set_lo").alias("n")).filter("n > 1").select("doc_id")
    twice = staged(twice, "repeated")
    if twice.head(1):
        late.append(only_ids(known, twice, "doc_id").join(classes, ["set_hi", "set_lo"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a != b"))
    labels = _joined_up(labels, reduce(DataFrame.union, late))
    # A document belongs where its class does.
    placed = classes.select("set_hi", "set_lo", "node").join(labels, "node", "left").select("set_hi", "set_lo", F.coalesce("component", "node").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "set_hi", "set_lo").join(placed, ["set_hi", "set_lo"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
