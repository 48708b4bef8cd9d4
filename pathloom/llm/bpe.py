"""BPE encoding and decoding with a tokenization automaton.

``compile_automaton`` turns the ordered merges into a deterministic automaton over tokens by applying one merge gadget
after another to the automaton that loops on single symbols. After the gadget of merge (a, b) -> c, state a no longer has
an arc b, every state with an arc a has an arc c, and c leads to where b led. Since every arc with one label leads to one
state, states and labels are both tokens and the transition table is a bit matrix, which is then minimised: states with
equal rows and labels with equal columns share one.

A pre-split word is read from left to right, one table-driven transition a symbol: a trie of the tokens' spellings with
failure arcs knows the longest token that ends at the symbol, each token knows the next shorter one that ends it, and
the first of them that the tokenization automaton lets follow is the live state there. So after every symbol there is one
live state, and the time is linear in the word's length. Decoding emits the labels of the arcs.

Texts are worked on in slices of bytes; the distinct pieces of a slice are encoded once, all of them a symbol at a time, and
their ids gathered, so that the memory of a task is that of a slice and of the tables.

Edge cases: null and empty texts have no tokens and decode to the empty text; null ids stay null; repeated rows come
back as often; a very long text is a slice of its own; an empty table gives no rows; other columns are ignored; special
tokens written out in a text become their ids, as the library does by default, or plain text with ``special=False``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, bounded_batches, slices, table, text_buffers, word_bounds

#: Bytes from which a piece is encoded on its own and not together with the others.
LONG = 128
#: The symbol of a word's last byte is the byte and this.
LAST = 256
#: Bytes of words that the splitting pattern must be asked about, and the classes of all other bytes.
_ODD = (np.arange(256) >= 128) | (np.arange(256) == ord("'"))
_DIGIT = 2
_CLASS = np.where((LOWER >= 97) & (LOWER <= 122), 1, np.where((LOWER >= 48) & (LOWER <= 57), _DIGIT, 3)).astype(np.uint8)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Automaton(NamedTuple):
    """The tokenization automaton, and the spellings of its tokens as a trie with failure arcs.

    labels: the text of each id. state: row of a token that can be followed, or -1. column: that of a token. allowed: the
    bits of rows by columns, ``stride`` bytes a row. arc_keys, arc_to: a hash table of (node << 9 | symbol) to node. fail:
    the failure arc of a node. longest: the longest token that ends at a node. shorter: the next shorter token that ends a
    token, or -1; size: its symbols.
    """

    labels: list[str]
    state: np.ndarray
    column: np.ndarray
    allowed: np.ndarray
    stride: int
    arc_keys: np.ndarray
    arc_to: np.ndarray
    fail: np.ndarray
    longest: np.ndarray
    shorter: np.ndarray
    size: np.ndarray

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The nodes that the symbols lead to; failure arcs are taken until a node has the symbol's arc (the root has all)."""
        to = np.full(len(node), -1, np.int32)
        left = np.arange(len(node))
        while len(left):
            found = self._arc(node[left].astype(np.int64) << 9 | symbol[left])
            to[left] = found
            left = left[found < 0]
            node[left] = self.fail[node[left]]
        return to

    def _arc(self, keys: np.ndarray) -> np.ndarray:
        mask = len(self.arc_keys) - 1
        place = _slot(keys, mask)
        found = self.arc_keys[place]
        to = np.where(found == keys, self.arc_to[place], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):  # another key's place: look at the next
            place[left] = (place[left] + 1) & mask
            found = self.arc_keys[place[left]]
            to[left] = np.where(found == keys[left], self.arc_to[place[left]], -1)
            left = left[(found != keys[left]) & (found >= 0)]
        return to

    def follows(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether a token may follow another."""
        c = self.column[token]
        return (self.allowed[self.state[before].astype(np.int64) * self.stride + (c >> 3)] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)


def _slot(keys: np.ndarray, mask: int) -> np.ndarray:
    return (keys * 0x9E3779B1 >> 15) & mask


def _hash_table(arcs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing; less than a quarter of the places is taken."""
    mask = (1 << (4 * len(arcs)).bit_length()) - 1
    keys, to = np.full(mask + 1, -1, np.int64), np.full(mask + 1, -1, np.int32)
    left, value = np.fromiter(arcs, np.int64, len(arcs)), np.fromiter(arcs.values(), np.int32, len(arcs))
    place = _slot(left, mask)
    while len(left):
        free = keys[place] < 0
        keys[place[free]] = left[free]  # of several for one place the last is in
        won = keys[place] == left
        to[place[won]] = value[won]
        left, value, place = left[~won], value[~won], (place[~won] + 1) & mask
    return keys, to


def _token_table(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(state of each token, column of each token, rows by columns of bits, which tokens are ever made), by merge gadgets."""
    size = max(vocab.values()) + 1
    made = {a + b for a, b in merges}
    inner = sorted(i for t, i in vocab.items() if not t.endswith(suffix))  # a token that ends a word is never followed
    row = np.full(size, -1)
    row[inner] = np.arange(len(inner))
    columns = np.zeros((size, (len(inner) + 7) // 8), np.uint8)  # a bit for each state, a line for each label
    base = [i for t, i in vocab.items() if t not in made]
    live = np.zeros(size, bool)
    live[base] = True
    start = np.zeros(columns.shape[1] * 8, np.uint8)
    start[[row[i] for i in base if row[i] >= 0]] = 1
    columns[base] = np.packbits(start, bitorder="little")
    top = max(base) + 1  # labels from here on have no arcs yet
    for left, right in merges:
        a, b, c = vocab[left], vocab[right], vocab[left + right]
        at, bit = row[a] >> 3, np.uint8(1 << (row[a] & 7))
        if not columns[b, at] & bit:
            continue  # a and b never meet: the gadget changes nothing
        live[c] = True
        columns[c] = columns[a]
        top = max(top, c + 1)
        if row[c] >= 0:
            led = (columns[:top, row[b] >> 3] >> np.uint8(row[b] & 7)) & np.uint8(1)
            columns[:top, row[c] >> 3] |= led << np.uint8(row[c] & 7)
            if led[a]:
                columns[c, row[c] >> 3] |= np.uint8(1 << (row[c] & 7))
        columns[b, at] &= ~bit
        if a == b:
            columns[c, at] &= ~bit  # of three equal symbols the first two merge
    lines, label = np.unique(columns.view(f"V{columns.shape[1]}").ravel(), return_inverse=True)
    del columns
    lines = lines.view(np.uint8).reshape(len(lines), -1)
    turned = [np.packbits(np.unpackbits(lines[:, at : at + 64], axis=1, bitorder="little").T, axis=1) for at in range(0, lines.shape[1], 64)]
    rows, state_of = np.unique(np.concatenate(turned)[: len(inner)], axis=0, return_inverse=True)
    state = np.full(size, -1)
    state[inner] = state_of.ravel()
    return state, label, rows, live


def _spellings(vocab: dict[str, int], live: np.ndarray, suffix: str):
    """(arc_keys, arc_to, fail, longest, shorter, size): the trie of the live tokens' symbols, with failure arcs."""
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    arcs: dict[int, int] = {}
    below: list[list[tuple[int, int]]] = [[]]  # (symbol, node) of each node's arcs
    ends, size, node_of = [-1], [0] * len(live), {}
    for token, i in vocab.items():
        if not live[i]:
            continue
        whole = token.endswith(suffix)
        symbols = [byte_of[c] for c in (token.removesuffix(suffix) if whole else token)]
        symbols[-1] += LAST * whole
        node = 0
        for c in symbols:
            to = arcs.get(node << 9 | c)
            if to is None:
                to = arcs[node << 9 | c] = len(below)
                below[node].append((c, to))
                below.append([])
                ends.append(-1)
            node = to
        ends[node], size[i], node_of[i] = i, len(symbols), node
    fail, longest, queue = [0] * len(below), [-1] * len(below), [0]
    for node in queue:  # by depth, so that a failure arc's target is done
        longest[node] = ends[node] if ends[node] >= 0 else longest[fail[node]]
        for c, to in below[node]:
            at = fail[node]
            while node and at and at << 9 | c not in arcs:
                at = fail[at]
            fail[to] = arcs.get(at << 9 | c, 0) if node else 0
            queue.append(to)
    shorter = [-1] * len(live)
    for i, node in node_of.items():
        shorter[i] = longest[fail[node]]
    return (*_hash_table(arcs), *(np.array(x, np.int32) for x in (fail, longest, shorter, size)))


def compile_automaton(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> Automaton:
    """The automaton of all correct token sequences, with the table that spells words along it."""
    state, column, rows, live = _token_table(vocab, merges, suffix)
    labels = [""] * len(live)
    for token, i in vocab.items():
        labels[i] = token
    return Automaton(labels, state.astype(np.int32), column.ravel().astype(np.int32), rows.ravel(), rows.shape[1], *_spellings(vocab, live, suffix))


class Encoder:
    """Encodes as a tokenizers file with lower case, a splitting pattern and word ends says; made from that file's JSON."""

    def __init__(self, spec: dict, automaton: Automaton):
        self.automaton = automaton
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        labels = automaton.labels + [""] * (max(self.special.values(), default=0) + 1 - len(automaton.labels))
        for content, i in self.special.items():
            labels[i] = content
        self.labels = pa.array([x + " " for x in labels], pa.large_string())
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def word(self, piece: bytes) -> list[int]:
        """The path that spells the bytes of one piece: after[i] is the token that ends at byte i."""
        automaton, last, after = self.automaton, len(piece) - 1, []
        node, size = np.zeros(1, np.int32), automaton.size
        for i, symbol in enumerate(piece):
            node = automaton.step(node, np.array([symbol + LAST * (i == last)]))
            token = int(automaton.longest[node[0]])
            while size[token] <= i and not automaton.follows(np.array([after[i - size[token]]]), np.array([token]))[0]:
                token = int(automaton.shorter[token])
            after.append(token)
        path, i = [], last
        while i >= 0:
            path.append(after[i])
            i -= int(size[after[i]])
        return path[::-1]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, with the last end): the paths of many pieces, all of them a symbol at a time."""
        automaton, length = self.automaton, np.diff(offsets)
        after, ends = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
        order = np.argsort(-length, kind="stable")
        order = order[np.searchsorted(-length[order], -LONG) :]
        start, left = offsets[:-1][order], length[order]
        node = np.zeros(len(order), np.int32)
        for i in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -i))  # pieces of more than i bytes come first
            at = start[:n]
            symbol = data[at + i] + LAST * (left[:n] == i + 1)
            node = automaton.step(node[:n], symbol)
            token = automaton.longest[node]
            todo = np.flatnonzero(automaton.size[token] <= i)
            while len(todo):
                t = token[todo]
                fits = automaton.follows(after[at[todo] + i - automaton.size[t]], t)
                todo, t = todo[~fits], automaton.shorter[t[~fits]]
                token[todo] = t
                todo = todo[automaton.size[t] <= i]
            after[at + i] = token
        place = offsets[1:][order] - 1
        while len(place):
            ends[place] = True
            back = place - automaton.size[after[place]]
            inside = back >= start
            place, start = back[inside], start[inside]
        for k in np.flatnonzero(length >= LONG).tolist():
            at = int(offsets[k])
            for token in self.word(data[at : offsets[k + 1]].tobytes()):
                at += int(automaton.size[token])
                after[at - 1], ends[at - 1] = token, True
        return after[ends].astype("<u4"), np.concatenate([[0], np.cumsum(ends)])[offsets]

    def split(self, raw: bytes) -> list[bytes]:
        """The pieces of a text without ASCII white space."""
        text = unicodedata.normalize("NFC", raw.decode()).replace("Σ", "σ").lower()
        return [text.encode()] if text.isalpha() else [x.encode() for x in self.pattern.findall(text)]  # letters only are one piece

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each row's begin, with the last end) of rows of UTF-8 bytes, special tokens being plain text.

        ASCII words without an apostrophe fall into runs of letters, single digits and runs of all else; the splitting
        pattern is asked about the distinct other words only.
        """
        start, end, row_at = word_bounds(data, offsets)
        if len(start) == 0:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        inside = ~IS_SPACE[data]
        letters, size, first = data[inside], end - start, np.cumsum(end - start) - (end - start)  # the words end to end
        odd = np.repeat(np.logical_or.reduceat(_ODD[letters], first), size)
        letters = np.where(odd, letters, LOWER[letters])
        kind = _CLASS[letters]
        begins = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == _DIGIT)
        begins[odd] = False
        begins[first] = True
        begin = np.flatnonzero(begins)
        found = _binary(letters, np.append(begin, len(letters))).dictionary_encode()
        bytes_of, cuts = _bytes(found.dictionary)
        plain = ~np.logical_or.reduceat(_ODD[bytes_of], cuts[:-1])
        parts = [self.split(w) for w in found.dictionary.filter(pa.array(~plain)).to_pylist()]
        count = np.ones(len(plain), np.int64)
        count[~plain] = [len(p) for p in parts]
        pieces = pa.concat_arrays([found.dictionary.filter(pa.array(plain)), pa.array([x for p in parts for x in p], pa.large_binary())]).dictionary_encode()
        number, whole = pieces.indices.to_numpy(), np.repeat(plain, count)
        spelled = np.empty(len(number), np.int64)
        spelled[whole], spelled[~whole] = number[: plain.sum()], number[plain.sum() :]
        which, at = gathered(spelled, np.concatenate([[0], np.cumsum(count)]), found.indices.to_numpy())
        ids, id_of = gathered(*self.pieces(*_bytes(pieces.dictionary)), which)
        rows = np.concatenate([np.searchsorted(begin, first), [len(begin)]])[row_at]
        return ids, id_of[at][rows]

    def encode(self, data: np.ndarray, offsets: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The same; special tokens written out in a text become their ids if asked."""
        odd = []
        if special and self.special and b"<|" in (whole := data.tobytes()):
            odd = [i for i in range(len(offsets) - 1) if self.split_special.search(whole[offsets[i] : offsets[i + 1]].decode())]
        ids, starts, done = [], [np.zeros(1, np.int64)], 0
        for lo, hi in _runs(odd, len(offsets) - 1):
            base = offsets[lo]
            if lo in odd:
                part = self._with_special(data[base : offsets[hi]].tobytes().decode())
                at = np.array([0, len(part)])
            else:
                part, at = self.plain(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
            ids.append(part)
            starts.append(at[1:] + done)
            done += len(part)
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.concatenate(starts)

    def _with_special(self, text: str) -> np.ndarray:
        parts = []
        for part in self.split_special.split(text):
            if part in self.special:
                parts.append(np.array([self.special[part]], "<u4"))
            else:
                raw = np.frombuffer(part.encode(), np.uint8)
                parts.append(self.plain(raw, np.array([0, len(raw)]))[0])
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The text of each row of ids: its arcs' labels, with a space between them."""
        labels = self.labels.take(pa.array(ids))
        _, offsets, data = labels.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(ids) + 1][at]
        rows = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])
        return pc.utf8_rtrim(rows, " ")  # no label has a space of its own


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary array without nulls or an offset, and where each value begins, with the last end."""
    _, cuts, data = values.buffers()
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(cuts, np.int64)[: len(values) + 1]


def gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[at[k]:at[k + 1]] for each k of which, end to end, and where each begins, with the last end."""
    count = np.diff(at)[which]
    starts = np.concatenate([[0], np.cumsum(count)])
    return values[np.repeat(at[which] - starts[:-1], count) + np.arange(starts[-1])], starts


def _runs(odd: list[int], rows: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover the rows in order, with each odd row in a range of its own."""
    at = 0
    for i in odd:
        if at < i:
            yield at, i
        yield i, i + 1
        at = i + 1
    if at < rows:
        yield at, rows


@lru_cache(maxsize=2)
def compiled(path: str) -> tuple[dict, Automaton]:
    """The tokenizer file (a local path on the driver) and its automaton."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {k: v for k, v in spec.items() if k != "model"}, compile_automaton(model["vocab"], merges, model["end_of_word_suffix"])


_encoders: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The encoder of a broadcast tokenizer, one for each Python worker."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(*shared.value)
    return _encoders[shared.id]


class Shared:
    """A broadcast with an id that stays the same when it is pickled; its size is that of the vocabulary file."""

    def __init__(self, spark: SparkSession, path: str):
        bounded_batches(spark)
        self.id, self.broadcast = hash(path), spark.sparkContext.broadcast(compiled(path))

    @property
    def value(self):
        spec, automaton = self.broadcast.value
        return spec, Automaton(*automaton)


def encoded_slices(batches: Iterator[pa.RecordBatch], encoder: Encoder, special: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, where each row's ids begin) of slices of batches whose second column is the text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in slices(offsets):
            base = offsets[lo]
            yield batch.slice(lo, hi - lo), *encoder.encode(data[base : offsets[hi]], offsets[lo : hi + 1] - base, special)


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", special: bool = True, with_texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (string); without texts: their SHA-256 instead."""
    shared = Shared(docs.sparkSession, tokenizer)
    names, kinds = ("ids", "decoded"), ("binary", "string")
    if not with_texts:
        names, kinds = ("ids_sha256", "decoded_sha256"), ("string", "string")

    def digests(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for rows, ids, at in encoded_slices(batches, encoder, special):
            raw = _binary(ids, at * 4)
            texts = encoder.decode(ids, at)
            out = (raw.cast(pa.binary()), texts.cast(pa.string())) if with_texts else (digests(raw), digests(texts))
            yield pa.record_batch([rows.column(0), pa.array(np.diff(at)), *out], names=["doc_id", "n_tokens", *names])
            del rows, ids, at, raw, texts, out
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), default_tokenizer(), with_texts=False)
