"""Language-model scoring with a weighted backoff automaton over smoothed n-grams.

Model: P(w | h) = (c(h w) + m P(w | shorter h)) / (c(h) + m), where m is the MASS of h's length, down to
P(w) = (c(w) + 1/2) / (N + (V + 1) / 2), which is a proper distribution at every order. As an automaton, each seen history
is a state; a seen continuation is an arc whose weight holds the whole sum, and every other word takes the failure arc, of
weight m / (c(h) + m), to the state of the shorter history. A text is traversed once from left to right; the state is
carried along and the log probabilities are summed.

On a cluster: the texts are written once to the shared folder, in blocks of about BLOCK_BYTES, and are never shuffled. Each
block asks for its own n-grams (sorted 64-bit hashes with its training counts, packed by hash range); each range adds up
what all blocks have and answers every block with the corpus counts of just the n-grams that it asked for; each block then
builds the small automaton that its texts can reach and scores them. The model is never in one place, nothing is broadcast
but two totals, and what moves is one entry for each distinct n-gram of a block. Blocks and ranges grow with the bytes of
text, so that a task's memory does not; there is a packet for each block and range.

Edge cases: null and empty texts have one token, the end; rows with a null id are scored and learnt from as id ''; repeated
rows count as often as they come; a text longer than a block is a block of its own; other columns are ignored; an empty
table gives no rows. Equal hashes of different n-grams (2^-64 a pair) would share a count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, mix, slices, split_words, staged, table, text_buffers
from .storage import filesystem

#: Histories of one word, and of two: the masses that do best on held-out texts of the smaller test tables.
ORDER, MASS = 3, (64.0, 4.0)
FOLDS, HELD_OUT = 5, 1
#: Bytes of text of a block, and text for which there is one range of hashes.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Tokens of a text that are read one after another; see Automaton.traverse.
PIECE = 128
CODEC = pa.Codec("zstd", 3)
END = np.uint64(0x9D5C0FB1A3C4E26D)  # the hash of the end token
_LEVEL, _ABOVE = 0xA24BAED4963EE407, np.uint64(2**64 - 4)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of consecutive rows, each row's end included, and where each row begins (with the last end)."""
    words = split_words(data, offsets)
    counts = np.diff(words.row_at)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(at[-1], END, np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    out[inner] = words.hash
    return out, at


def ngrams(tokens: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to order-grams that end at each token, their length less one in the low two bits; 0 where the row
    has too few tokens before."""
    out, place = [mix(tokens) & _ABOVE], np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
    for n in range(2, order + 1):
        gram = np.zeros_like(tokens)
        gram[1:] = mix(out[-1][:-1] * np.uint64(0x100000001B3) + tokens[1:] + np.uint64(_LEVEL * n % 2**64)) & _ABOVE | np.uint64(n - 1)
        gram[place < n - 1] = 0
        out.append(gram)
    return out


class Distinct(NamedTuple):
    """The distinct n-grams of a block: sorted hashes, a place where each ends, and by order the number of the n-gram that
    ends at each token (-1: none)."""

    hashes: np.ndarray
    at: np.ndarray
    ids: list[np.ndarray]


def distinct(levels: list[np.ndarray]) -> Distinct:
    whole = [np.flatnonzero(g) for g in levels]
    every, place = np.concatenate([g[w] for g, w in zip(levels, whole)]), np.concatenate(whole)
    order = np.argsort(every)
    every = every[order]
    first = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    number, cuts = np.empty(len(order), np.int32), np.cumsum([len(w) for w in whole])[:-1]
    number[order] = np.cumsum(first, dtype=np.int32) - 1
    ids = []
    for g, w, n in zip(levels, whole, np.split(number, cuts)):
        ids.append(np.full(len(g), -1, np.int32))
        ids[-1][w] = n
    return Distinct(every[first], place[order[first]], ids)


def _block_tokens(column, learns: np.ndarray, order: int):
    """(tokens, row starts, n-grams by order, learnt flags) of a column of texts, in one piece."""
    data, offsets = text_buffers(column)
    parts, starts, done = [], [np.zeros(1, np.int64)], 0
    for lo, hi in slices(offsets):
        base = offsets[lo]
        t, at = tokens_of(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
        parts.append(t)
        starts.append(at[1:] + done)
        done += at[-1]
    tokens, at = (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(starts)
    return tokens, at, ngrams(tokens, at, order), np.repeat(learns, np.diff(at))


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes by byte planes of their differences: the planes of high bytes are zeros and compress away."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype(">u8")
    return CODEC.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def _unpack(packed, size: int) -> np.ndarray:
    planes = np.frombuffer(CODEC.decompress(packed, 8 * size), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 or more follow as (place, count)."""
    large = np.flatnonzero(counts >= 255)
    rest = np.stack([large, counts[large]], axis=1).astype("<u8")
    size = np.array([len(counts), len(large)], "<u8")
    return size.tobytes() + CODEC.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + rest.tobytes(), asbytes=True)


def _unpack_counts(packed) -> np.ndarray:
    size, n = np.frombuffer(packed, "<u8", 2).astype(int)
    whole = np.frombuffer(CODEC.decompress(pa.py_buffer(packed)[16:], int(size + 16 * n)), np.uint8)
    counts = whole[:size].astype(np.int64)
    place, large = np.frombuffer(whole[size:].tobytes(), "<u8").reshape(n, 2).astype(np.int64).T
    counts[place] = large
    return counts


def write_blocks(docs: DataFrame, folder: str, block_bytes: int) -> DataFrame:
    """(block, file, at, size, bytes), staged: where the rows (doc_id, text, held_out) of each block are in the folder.

    A task that is run again writes a file of another name; only blocks named in the result exist.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        name, out, held, size, at = f"texts-{uuid.uuid4().hex}", None, [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal at
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for part in held:
                    writer.write_batch(part)
            packed = sink.getvalue()
            out.write(packed)
            at += packed.size
            return pa.record_batch([pa.array([x]) for x in (f"{name}:{at}", name, at - packed.size, packed.size, size)], names=["block", "file", "at", "size", "bytes"])

        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                if size >= block_bytes:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()
        if out is not None:
            out.close()

    return staged(docs.mapInArrow(run, "block string, file string, at long, size long, bytes long"), "text-blocks")


def read_block(folder: str, file: str, at: int, size: int) -> pa.Table:
    system, root = filesystem(folder)
    with system.open_input_file(f"{root}/{file}") as source:
        return pa.ipc.open_stream(source.read_at(size, at)).read_all()


def _asked(blocks: DataFrame, folder: str, ranges: int, order: int) -> DataFrame:
    """(range, block, hashes, counts): the distinct n-grams of a block by hash range, with its training counts."""
    cuts = np.array([r * (2**64 // ranges) for r in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = read_block(folder, row["file"], row["at"], row["size"])
                _, _, levels, learnt = _block_tokens(t.column("text"), ~t.column("held_out").to_numpy().astype(bool), order)
                hashes, _, ids = distinct(levels)
                counts = sum((np.bincount(i[(i >= 0) & learnt], minlength=len(hashes)) for i in ids), np.zeros(len(hashes), np.int64))
                at = [0, *np.searchsorted(hashes, cuts).tolist(), len(hashes)]
                parts = [(r, row["block"], _pack(hashes[i:j]), _pack_counts(counts[i:j])) for r, (i, j) in enumerate(zip(at, at[1:])) if i < j]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*parts), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["range", "block", "hashes", "counts"])

    return blocks.select("block", "file", "at", "size").mapInArrow(run, "range int, block string, hashes binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(block, range, counts, tokens, types): corpus counts in the order asked; totals of the range's 1-grams once."""

    def answer(t: pa.Table) -> pa.Table:
        mine = [_unpack_counts(x.as_buffer()) for x in t.column("counts")]
        cuts, every = np.cumsum([len(c) for c in mine])[:-1], np.concatenate([_unpack(x.as_buffer(), len(c)) for x, c in zip(t.column("hashes"), mine)])
        order = np.argsort(every)
        every = every[order]
        first = np.concatenate([[True], every[1:] != every[:-1]])
        total = np.add.reduceat(np.concatenate(mine)[order], np.flatnonzero(first))
        words = total[(every[first] & ~_ABOVE) == 0]
        back = np.empty(len(order), np.int64)
        back[order] = total[np.cumsum(first) - 1]
        rest = [0] * (t.num_rows - 1)
        answers = [_pack_counts(x) for x in np.split(back, cuts)]
        return pa.table({"block": t.column("block"), "range": t.column("range"), "counts": pa.array(answers, pa.binary()), "tokens": pa.array([int(words.sum()), *rest], pa.int64()), "types": pa.array([int((words > 0).sum()), *rest], pa.int64())})

    return asked.groupBy("range").applyInArrow(answer, "block string, range int, counts binary, tokens long, types long")


class Automaton:
    """The states and arcs that a block's texts can reach. State 0 is the empty history; its arcs are the block's words.

    ``words``: how many there are. ``keys``: sorted, state * words + word of each arc, with its ``weight`` (log10) and the
    ``next`` state. ``fail_to`` and ``fail_weight``: the failure arc of each state. ``token``: the word number of each token.
    """

    def __init__(self, grams: Distinct, count: np.ndarray, total: int, types: int, mass: tuple[float, ...]):
        at, ids, order = grams.at, grams.ids, len(grams.ids)
        by_order = [np.flatnonzero((grams.hashes & ~_ABOVE) == k) for k in range(order)]
        word = np.zeros(len(at), np.int64)
        self.words = len(by_order[0])
        word[by_order[0]] = np.arange(self.words)
        self.token = word[ids[0]]
        # A state for each seen history of 1 to order - 1 words that the block has; it fails to the history without its first.
        state = np.zeros(len(at), np.int64)
        self.fail_to, self.fail_weight, states = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        p = np.zeros(len(at))
        p[by_order[0]] = (count[by_order[0]] + 0.5) / (total + 0.5 * (types + 1))
        keys, weights, nexts = [word[by_order[0]]], [np.log10(p[by_order[0]])], []
        for k, grams_k in enumerate(by_order):
            seen = grams_k[count[grams_k] > 0]
            suffix = ids[k - 1][at[seen]] if k else None  # the n-gram without its first word
            if k < order - 1:
                state[seen] = np.arange(states, states + len(seen))
                states += len(seen)
                self.fail_to.append(state[suffix] if k else np.zeros(len(seen), np.int64))
                self.fail_weight.append(np.log10(mass[k] / (count[seen] + mass[k])))
            if k:
                history = ids[k - 1][at[seen] - 1]
                p[seen] = (count[seen] + mass[k - 1] * p[suffix]) / (count[history] + mass[k - 1])
                keys.append(state[history] * self.words + self.token[at[seen]])
                weights.append(np.log10(p[seen]))
            ends = by_order[0] if k == 0 else seen
            nexts.append(state[ends] if k < order - 1 or k == 0 else state[suffix])  # the longest history that ends with the word
        self.fail_to, self.fail_weight = np.concatenate(self.fail_to), np.concatenate(self.fail_weight)
        keys = np.concatenate(keys)
        by_key = np.argsort(keys)
        self.keys, self.weight, self.next = keys[by_key], np.concatenate(weights)[by_key], np.concatenate(nexts)[by_key]
        self.order = order

    def traverse(self, at: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Log10 probability of each row's tokens; row i's are at[i]:at[i + 1].

        Long rows are read in pieces of so many tokens, all pieces a token at a time. A piece starts order - 1 tokens early
        in the empty history, without counting: these lead to the state in which its first token finds the whole row's reading.
        """
        size = np.diff(at)
        parts = -(-size // piece)
        row = np.repeat(np.arange(len(size)), parts)
        skipped = piece * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
        early = np.minimum(skipped, self.order - 1)
        start, left = at[:-1][row] + skipped - early, np.minimum(size[row] - skipped, piece) + early
        order = np.argsort(-left, kind="stable")
        start, left, early = start[order], left[order], early[order]
        state, score = np.zeros(len(order), np.int64), np.zeros(len(order))
        for t in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -t, side="left"))  # pieces longer than t come first
            word, s, gained = self.token[start[:n] + t], state[:n].copy(), np.zeros(n)
            todo = np.arange(n)
            while len(todo):
                key = s[todo] * self.words + word[todo]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                done, went = todo[hit], todo[~hit]
                gained[done] += self.weight[place[hit]]
                s[done] = self.next[place[hit]]
                gained[went] += self.fail_weight[s[went]]
                s[went] = self.fail_to[s[went]]
                todo = went
            state[:n] = s
            score[:n] += gained * (early[:n] <= t)
        return np.bincount(row[order], score, len(size))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mass: tuple[float, ...] = MASS, folds: int = FOLDS, held_out: int = HELD_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs. mass: one for each history length."""
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "texts")
    bounded_batches(spark)
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.crc32(text_id.cast("binary")) % folds == held_out).alias("held_out"))
    blocks = write_blocks(told, folder, block_bytes)
    size = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).head()
    tasks, ranges = max(1, size["blocks"]), 1 + size["bytes"] // RANGE_BYTES
    dealt = blocks.repartition(tasks, "block")
    answers = staged(_answered(_asked(dealt, folder, ranges, order)), "ngram-counts")
    total = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).head()
    tokens_n, types_n = total["tokens"] or 0, total["types"] or 0
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(block: pa.Table, answer: pa.Table) -> pa.Table:
        texts = read_block(folder, *(block.column(c)[0].as_py() for c in ("file", "at", "size")))
        _, at, levels, _ = _block_tokens(texts.column("text"), np.zeros(texts.num_rows, bool), order)
        grams = distinct(levels)
        del levels
        by_range = np.argsort(answer.column("range").to_numpy())
        count = np.concatenate([_unpack_counts(answer.column("counts")[int(k)].as_buffer()) for k in by_range])
        known = count[grams.ids[0]]
        base = np.add.reduceat(np.log10((known + 0.5) / (tokens_n + 0.5 * (types_n + 1))), at[:-1])
        n_known = np.add.reduceat((known > 0).astype(np.int64), at[:-1])
        automaton, n = Automaton(grams, count, tokens_n, types_n, mass), texts.num_rows
        del grams, count, known
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": np.diff(at).astype(np.int64), "n_known": n_known, "train_tokens": np.full(n, tokens_n, np.int64), "base_score": base, "score": automaton.traverse(at)})

    return dealt.groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(score, schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
