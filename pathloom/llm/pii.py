"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The model is trained in numpy from labelled spans that a seeded generator writes (prose of invented words with mails,
addresses, card and phone numbers in many shapes, and look-alikes without a label, such as cards with a wrong check digit),
so it is the same in every session. Windows of WINDOW characters at every STRIDE are decoded; windows without a digit, an
at-sign or a bracketed "at" are not, since no span that well_formed takes lacks all of these. Where a tagged run meets a
window's edge, a window twice as wide is decoded until it holds the run whole; long candidates have a window of their own. A
document's spans from all its windows are reconciled at once: the best-scoring set of spans that do not overlap, after the
fixed patterns' spans, which always stay. The model decides what is added: a span whose mean marginal reaches its kind's bar,
which held-out examples choose (chosen_bars). well_formed only tells the kinds' definitions, to which all labels keep.

Edge cases: null is the empty text, without spans; repeated rows come back as often; null ids stay null; other columns
are ignored; an empty table gives no rows; equal starts are ordered by kind as listed in KINDS; very long texts are worked
on whole, in time that grows with their length and with sorting their spans, and texts of together about a megabyte at a
time.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded_batches, slices, table, text_buffers

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN = 64, 32, 20
#: Bars on the mean marginal of an added span, and the precision on held-out examples that chooses among them.
BARS, PRECISION = (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5), 0.98
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
SYMBOLS = 130  # ASCII, other letters, all else

# The patterns of the result's contract, as they are found from an at-sign or with possessive runs.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
AT = re.compile(r"[\[(]at[\])]")
#: What well_formed tells the kinds by.
MAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]| \. )[0-9]{1,3}){3}")
GROUPED = re.compile(r"[0-9](?:[\x20.-]?[0-9])+")
DIALLED = re.compile(r"[+(]?[0-9][\x20().0-9/-]*[0-9]")
NUMBERS = re.compile(r"[0-9][\x20().0-9/-]*+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(points, 129).astype(np.int16)
    out[(points >= 0x80) & (points < 0x250)] = 128  # Latin letters mostly
    return out


# ---- labelled spans ----------------------------------------------------------------------------------------------


def _sentence(rng: np.random.Generator, size: int) -> str:
    parts = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ö ción ung keit que eau".split()
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(size)]
    words = [w.capitalize() if rng.random() < 0.12 else w for w in words]
    return "".join(w + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", " | ", "### "]) for w in words)


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _valid_card(rng, n: int) -> str:
    """n digits of which the last makes the sum of Luhn right."""
    head = _digits(rng, n - 1)
    return next(head + d for d in "0123456789" if luhn(head + d))


def _in_groups(rng, digits: str) -> str:
    cuts = (4, 10) if len(digits) == 15 else (4, 8, 12)
    parts = [digits[i:j] for i, j in zip((0, *cuts), (*cuts, len(digits)))]
    return str(rng.choice([" ", "-", "", "."], p=[0.35, 0.25, 0.2, 0.2])).join(parts)


def _ascii_name(rng) -> str:
    return re.sub("[^a-z]", "", _sentence(rng, 1).lower()) or "x"


def _look_alike(rng) -> str:
    d, n = _digits, rng.integers
    wrong = _valid_card(rng, 16)
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1 + n(0, 8)) % 10)
    shapes = [
        d(rng, int(n(1, 9))), f"{n(1, 29)}.{n(1, 12)}.{n(1900, 2030)}", f"{d(rng, 2)},{d(rng, 3)}.{d(rng, 2)}", f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}",
        rng.bytes(20).hex(), f"@{_ascii_name(rng)}", f"{n(1, 12)}:{d(rng, 2)}", f"{d(rng, 4)}-{d(rng, 2)}-{d(rng, 2)}", f"{d(rng, 4)}-{d(rng, 2)}-{d(rng, 2)} {d(rng, 2)}:{d(rng, 2)}:{d(rng, 2)}",
        f"{n(1, 12)}/{n(1, 29)}/{n(1900, 2030)}", f"{d(rng, 3)}-{d(rng, 4)}", f"{d(rng, 4)} {d(rng, 4)} {d(rng, 4)}", f"978-{d(rng, 1)}-{d(rng, 2)}-{d(rng, 6)}-{d(rng, 1)}", f"{d(rng, 2)}.{d(rng, 2)}.{d(rng, 2)}",
        f"{n(256, 999)}.{n(0, 256)}.{n(256, 999)}.{n(0, 256)}", f"{_ascii_name(rng)} (at) {n(1, 12)}", _in_groups(rng, wrong), f"{d(rng, 20)}{d(rng, int(n(0, 9)))}",
    ]
    return shapes[int(n(0, len(shapes)))]


def example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of about 3 windows and its labelled spans (start, kind, end). Every labelled span is well_formed."""
    text, found = _sentence(rng, int(rng.integers(0, 6))), []
    for _ in range(int(rng.integers(1, 4))):
        kind = int(rng.integers(0, 6))
        if kind == 0:
            name, host = _ascii_name(rng), str(rng.choice(["example", "host", _ascii_name(rng)]))
            sign = str(rng.choice(["@", " [at] ", " (at) ", "[at]", "(at)", " @ "], p=[0.5, 0.13, 0.13, 0.08, 0.08, 0.08]))
            domain = str(rng.choice([f"mail{rng.integers(0, 20)}.{host}", host])) + "." + str(rng.choice(["com", "org", "de", "net"]))
            item = name + str(rng.choice([".", "_", ""])) + str(rng.choice([_digits(rng, int(rng.integers(1, 3))), _ascii_name(rng)])) + sign + domain
        elif kind == 1:
            item = str(rng.choice([".", "[.]", " . "], p=[0.6, 0.25, 0.15])).join(str(x) for x in rng.integers(0, 256, 4))
        elif kind == 2:
            item = _in_groups(rng, _valid_card(rng, int(rng.choice([16, 15], p=[0.85, 0.15]))))
        elif kind == 3:
            a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
            item = str(rng.choice([f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"00{rng.integers(10, 99)} {a} {b}{c}", f"{a}.{b}.{c}"]))
        else:
            item = _look_alike(rng)
        if kind < 4:
            found.append((len(text), kind, len(text) + len(item)))
        text += item + str(rng.choice([" ", ". ", ", ", "\n", "### "])) + _sentence(rng, int(rng.integers(2, 9)))
    return text, found


def labelled(count: int, seed: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and their tags, from examples cut at random places."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = np.full((count, size), 32, np.int16), np.zeros((count, size), np.int64)
    for i in range(count):
        text, found = example(rng)
        tags = np.zeros(len(text), np.int64)
        for s, k, e in found:
            tags[s:e] = 2 + 2 * k
            tags[s] = 1 + 2 * k
        at = int(rng.integers(0, max(1, len(text) - size)))
        part = coded(text)[at : at + size]
        x[i, : len(part)], y[i, : len(part)] = part, tags[at : at + size]
    return x, y


# ---- the model ---------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(table_: np.ndarray, x: np.ndarray, recurrent: np.ndarray, keep: bool = False):
    """Hidden states (n, t, h) for symbols x; table_ holds each symbol's part of the four gates."""
    n, steps = x.shape
    size = recurrent.shape[0]
    h = c = np.zeros((n, size), np.float32)
    out, memory = np.empty((n, steps, size), np.float32), []
    for t in range(steps):
        z = table_[x[:, t]] + h @ recurrent
        g = _sigmoid(z[:, : 3 * size])
        u = np.tanh(z[:, 3 * size :])
        before_h, before_c = h, c
        c = g[:, size : 2 * size] * c + g[:, :size] * u
        r = np.tanh(c)
        h = g[:, 2 * size :] * r
        out[:, t] = h
        if keep:
            memory.append((g, u, before_h, before_c, r))
    return out, memory


def _lstm_back(grad: np.ndarray, x: np.ndarray, memory: list, recurrent: np.ndarray, symbols: int):
    n, steps, size = grad.shape
    d_table, d_rec, every = np.zeros((symbols, 4 * size), np.float32), np.zeros_like(recurrent), np.empty((steps, n, 4 * size), np.float32)
    dh = dc = np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        g, u, h0, c0, r = memory[t]
        i, f, o = g[:, :size], g[:, size : 2 * size], g[:, 2 * size :]
        dh = dh + grad[:, t]
        dc = dc + dh * o * (1 - r * r)
        dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * r * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        every[t] = dz
        d_rec += h0.T @ dz
        dh, dc = dz @ recurrent.T, dc * f
    used = x.T.ravel()
    order = np.argsort(used, kind="stable")
    first = np.flatnonzero(np.diff(used[order], prepend=-1))
    d_table[used[order][first]] = np.add.reduceat(every.reshape(-1, 4 * size)[order], first, axis=0)
    return d_table, d_rec


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def marginals(emit: np.ndarray, moves: np.ndarray, with_pairs: bool = False):
    """P(tag) at every place, and summed P(tag, next tag) if asked, by the forward-backward sums of the CRF."""
    n, steps, tags = emit.shape
    fore, back = np.empty_like(emit), np.zeros_like(emit)
    fore[:, 0] = emit[:, 0]
    for t in range(1, steps):
        fore[:, t] = emit[:, t] + _logsum(fore[:, t - 1, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        back[:, t] = _logsum(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    whole = _logsum(fore[:, -1], 1)
    p = np.exp(fore + back - whole[:, None, None])
    if not with_pairs:
        return p
    pairs = np.zeros_like(moves)
    for t in range(steps - 1):
        pairs += np.exp(fore[:, t, :, None] + moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :] - whole[:, None, None]).sum(axis=0)
    return p, pairs


def viterbi(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    n, steps, _ = emit.shape
    score, came = emit[:, 0], np.zeros(emit.shape, np.int8)
    for t in range(1, steps):
        ways = score[:, :, None] + moves
        came[:, t] = ways.argmax(axis=1)
        score = ways.max(axis=1) + emit[:, t]
    path = np.empty((n, steps), np.int8)
    path[:, -1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = came[np.arange(n), t, path[:, t]]
    return path


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    fore, _ = _lstm(model["fore"], x, model["fore_rec"])
    back, _ = _lstm(model["back"], x[:, ::-1], model["back_rec"])
    return np.concatenate([fore, back[:, ::-1]], axis=2) @ model["out"] + model["bias"]


def train(rounds: int = 320, batch: int = 128, rate: float = 0.02, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam on the CRF's negative log-likelihood."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = labelled(rounds * batch // 4, seed)
    model = {k: (rng.standard_normal(s) * w).astype(np.float32) for k, s, w in (("fore", (SYMBOLS, 4 * HIDDEN), 0.3), ("back", (SYMBOLS, 4 * HIDDEN), 0.3), ("fore_rec", (HIDDEN, 4 * HIDDEN), 0.2), ("back_rec", (HIDDEN, 4 * HIDDEN), 0.2), ("out", (2 * HIDDEN, TAGS), 0.3), ("bias", (TAGS,), 0.0), ("moves", (TAGS, TAGS), 0.0))}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(x), batch)
        a, gold = x[pick].astype(np.int64), y[pick]
        fore, kept_f = _lstm(model["fore"], a, model["fore_rec"], True)
        back, kept_b = _lstm(model["back"], a[:, ::-1], model["back_rec"], True)
        both = np.concatenate([fore, back[:, ::-1]], axis=2)
        p, pairs = marginals(both @ model["out"] + model["bias"], model["moves"], True)
        np.put_along_axis(p, gold[:, :, None], np.take_along_axis(p, gold[:, :, None], 2) - 1, 2)
        np.subtract.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        p /= batch
        grad = {"out": np.einsum("nth,ntk->hk", both, p), "bias": p.sum(axis=(0, 1)), "moves": pairs / batch}
        d = p @ model["out"].T
        grad["fore"], grad["fore_rec"] = _lstm_back(d[:, :, :HIDDEN], a, kept_f, model["fore_rec"], SYMBOLS)
        grad["back"], grad["back_rec"] = _lstm_back(d[:, ::-1, HIDDEN:], a[:, ::-1], kept_b, model["back_rec"], SYMBOLS)
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, g in grad.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = model[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return {k: v.astype(np.float32) for k, v in model.items()}


def chosen_bars(model: dict[str, np.ndarray], texts: int = 400, seed: int = 5, precision: float = PRECISION) -> np.ndarray:
    """For each kind the lowest bar on a span's mean marginal at which what the model adds to held-out examples is right
    often enough; the highest bar if none is."""
    rng = np.random.Generator(np.random.PCG64(seed))
    told = [example(rng) for _ in range(texts)]
    bars = np.full(len(KINDS), BARS[0])
    for bar in BARS:
        added = find([t for t, _ in told], model | {"sure": np.full(len(KINDS), bar)})
        for k in range(len(KINDS)):
            right = [x in spans for (_, spans), (_, more) in zip(told, added) for x in more if x[1] == k]
            if sum(right) >= precision * len(right) and bar <= bars[k]:
                bars[k] = bar
    return bars


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    model = train()
    return model | {"sure": chosen_bars(model)}


_fetched: list[dict[str, np.ndarray]] = []


def trained_in_task(spark: SparkSession) -> dict[str, np.ndarray]:
    """The model, trained once a session by a task, so that the driver holds nothing but its weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array([pickle.dumps(trained())], pa.binary())], names=["model"])

    if not _fetched:
        _fetched.append(pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "model binary").head()["model"]))
    return _fetched[0]


# ---- decoding ----------------------------------------------------------------------------------------------------


def _spans_of(path: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, kind, end, score) of the tagged runs of one window that do not touch an inner edge's cut."""
    at, n = 0, len(path)
    while at < n:
        tag = int(path[at])
        if tag % 2 == 1:
            end = at + 1
            while end < n and path[end] == tag + 1:
                end += 1
            yield at, tag // 2, end, float(sure[at:end].mean())
            at = end
        else:
            at += 1


def well_formed(kind: int, piece: str) -> bool:
    """Whether a piece can be of the kind at all, by the definitions that the labels keep to: what the model marks is added
    only if it is a whole address, four numbers of an IP, digits with a right check digit, or 10 to 15 digits."""
    digits = NOT_DIGIT.sub("", piece)
    if kind == 0:
        return MAIL.fullmatch(piece) is not None
    if kind == 1:
        return DOTTED.fullmatch(piece) is not None and all(int(x) <= 255 for x in re.findall("[0-9]+", piece))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and GROUPED.fullmatch(piece) is not None
    return 10 <= len(digits) <= 15 and DIALLED.fullmatch(piece) is not None


class Taken:
    """Fixed spans by start, with the greatest end so far: one search tells whether any of them is touched."""

    def __init__(self, fixed: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in fixed]
        self.reach = list(accumulate((e for _, _, e in fixed), max))

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start


def reconcile(spans: list[tuple[int, int, int, float]], fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The heaviest set of spans without overlaps that touches no fixed span (weight: score by length).

    Time is that of sorting, memory that of the spans: each span keeps one arrow back to the best set that it joins.
    """
    taken, best = Taken(fixed), {}
    for s, k, e, p in spans:
        if not taken.touches(s, e):
            best[s, k, e] = max(best.get((s, k, e), 0), p * (e - s))
    items = sorted(best.items(), key=lambda x: (x[0][2], x[0]))
    ends, weight, back = [x[0][2] for x in items], [0.0], []
    for i, ((s, k, e), w) in enumerate(items):
        before = bisect_left(ends, s + 1, 0, i)
        better = weight[before] + w > weight[-1]
        weight.append(weight[before] + w if better else weight[-1])
        back.append(before if better else -1)
    out, i = [], len(items)
    while i:
        if back[i - 1] >= 0:
            out.append(items[i - 1][0])
            i = back[i - 1]
        else:
            i -= 1
    return out[::-1]


def _long(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be one span and is too long to lie whole in a window at every STRIDE."""
    free = 0
    for m in AT.finditer(text):
        start, end = m.start(), m.end()
        start -= text[start - 1 : start] == " "
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end += text[end : end + 1] == " "
        while end < len(text) and text[end] in LOCAL:
            end += 1
        free = m.end()
        if end - start > WINDOW - STRIDE:
            yield start, end
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() > WINDOW - STRIDE and 10 <= len(NOT_DIGIT.sub("", m[0])):
            yield m.start(), m.end()


def _wide(start: int, end: int, length: int) -> tuple[int, int]:
    """A window around start and end: its start, and its width as a multiple of WINDOW."""
    start, end = max(0, start), min(end, length)
    return start, -(-(end - start) // WINDOW) * WINDOW


def _merged(windows: set[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(owner, start, end) of windows, those of one owner that overlap as one."""
    last = None
    for i, s, e in sorted(windows):
        if last and last[0] == i and s < last[2]:
            last = (i, last[1], max(e, last[2]))
        else:
            if last:
                yield last
            last = (i, s, e)
    if last:
        yield last


def _cut(path: np.ndarray, start: int, length: int, taken: Taken) -> tuple[bool, bool]:
    """Whether tagged runs go on beyond the window's left and right edge; what touches a fixed span is not added anyway."""
    out, n = np.flatnonzero(path == 0), len(path)
    first, last = (int(out[0]), int(out[-1]) + 1) if len(out) else (n, 0)

    def free(s: int, e: int) -> bool:
        return s < e and not taken.touches(start + s, start + e)

    return start > 0 and free(0, first), start + n < length and free(last, n)


def find(texts: list[str], model: dict[str, np.ndarray]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(fixed spans, added spans) of each text; windows of all texts are decoded together."""
    fixed, codes, todo = [], [], []
    for i, text in enumerate(texts):
        if not TRIGGER.search(text):
            fixed.append([])
            codes.append(None)
            continue
        fixed.append(base_spans(text))
        symbols = coded(text)
        codes.append(symbols)
        hot = np.flatnonzero(((symbols >= 48) & (symbols <= 57)) | (symbols == 64))
        hot = np.concatenate([hot, np.array([k for m in AT.finditer(text) for k in range(m.start(), m.end())], np.int64)])
        for k in np.unique(np.concatenate([hot // STRIDE, hot // STRIDE - 1])).tolist():
            if k >= 0 or k == -1 and len(text) < STRIDE:
                todo.append((i, max(k, 0) * STRIDE, WINDOW))
        todo += [(i, *_wide(s - STRIDE, e + STRIDE, len(text))) for s, e in _long(text)]
    found, taken = [[] for _ in texts], [Taken(f) for f in fixed]
    while todo:
        wider: set[tuple[int, int, int]] = set()
        todo.sort(key=lambda w: w[2])
        for width, group in groupby(todo, key=lambda w: w[2]):
            group, most = list(group), max(1, 2048 * WINDOW // width)
            for at in range(0, len(group), most):
                part = group[at : at + most]
                x = np.full((len(part), width), 32, np.int64)
                for row, (i, start, _) in zip(x, part):
                    piece = codes[i][start : start + width]
                    row[: len(piece)] = piece
                emit = emissions(model, x)
                path, p = viterbi(emit, model["moves"]), marginals(emit, model["moves"])
                sure = np.take_along_axis(p, path[:, :, None].astype(np.int64), 2)[:, :, 0]
                for w in np.flatnonzero(path.any(axis=1)).tolist():
                    i, start, _ = part[w]
                    length = len(texts[i])
                    for s, k, e, score in _spans_of(path[w], sure[w]):
                        cut = (s == 0 and start > 0) or (e == width and start + width < length)
                        if not cut and score >= model["sure"][k] and start + e <= length and well_formed(k, texts[i][start + s : start + e]):
                            found[i].append((start + s, k, start + e, score))
                    left, right = _cut(path[w], start, length, taken[i])
                    if left or right:
                        wider.add((i, start - width * left, start + width + width * right))
        todo = [(i, *_wide(s, e, len(texts[i]))) for i, s, e in _merged(wider)]
    return [(f, reconcile(s, f) if s else []) for f, s in zip(fixed, found)]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, a count of fixed spans for each kind, base and spans as kind:start:end.

    With redacted: also the text as it was (original) and with its spans replaced (redacted), and the columns in carry as
    struct ``carried``.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained_in_task(docs.sparkSession))
    carry = carry or []
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried"))
    names = ["doc_id", "carried", *(f"n_{k}" for k in KINDS), "base", "spans", *["original", "redacted"] * redacted]

    def run(batches):
        for batch in batches:
            for lo, hi in slices(text_buffers(batch.column(1))[1]):
                part = batch.slice(lo, hi - lo)
                texts = [x or "" for x in part.column(1).to_pylist()]
                out = find(texts, model.value)
                columns = [part.column(0), part.column(2), *(pa.array([sum(s[1] == k for s in f) for f, _ in out], pa.int64()) for k in range(len(KINDS))), pa.array([_joined(f) for f, _ in out], pa.string()), pa.array([_joined(f + a) for f, a in out], pa.string())]
                if redacted:
                    columns += [part.column(1), pa.array([mask(t, f + a) for t, (f, a) in zip(texts, out)], pa.string())]
                yield pa.record_batch(columns, names=names)

    kinds = {"doc_id": LongType(), "carried": rows.schema["carried"].dataType, **{f"n_{k}": LongType() for k in KINDS}}
    found = rows.mapInArrow(run, StructType([StructField(n, kinds.get(n, StringType())) for n in names]))
    return found if carry else found.drop("carried")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans by that of the first."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
