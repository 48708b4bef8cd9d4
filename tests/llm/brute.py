"""Plain, slow versions of the operators' definitions."""

import hashlib
import math
import re

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else (text or ""))


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return spans(out, ["assign", "access", "hex"])


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return spans(out, ["email", "ip", "card", "phone"])


def spans(found, names):
    found = sorted(found)
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
    return [sum(x[1] == k for x in found) for k in range(len(names))], joined, hashlib.sha256(joined.encode()).hexdigest()


def language_model(rows, order, mass, folds=5, held=1):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score, score) by direct recursion."""
    import collections
    import math
    import zlib

    docs = {k: [*words(t, True), None] for k, t in rows}
    out = {k: zlib.crc32(str(k).encode()) % folds == held for k in docs}
    grams = collections.Counter(tuple(w[max(0, i - n) : i + 1]) for k, w in docs.items() if not out[k] for i in range(len(w)) for n in range(order) if n <= i)
    total = sum(len(w) for k, w in docs.items() if not out[k])
    types = sum(len(g) == 1 for g in grams)

    def p(history, w):
        if not history:
            return (grams[(w,)] + 0.5) / (total + 0.5 * (types + 1))
        m = mass[len(history) - 1]
        return (grams[(*history, w)] + m * p(history[1:], w)) / (grams[tuple(history)] + m)

    return {k: (out[k], len(w), sum(grams[(x,)] > 0 for x in w), total, sum(math.log10(p([], x)) for x in w), sum(math.log10(p(w[max(0, i - order + 1) : i], x)) for i, x in enumerate(w))) for k, w in docs.items()}


def majority_of_rules(votes, rounds=50):
    """P(good) of each document from its votes (1, -1 or 0), by expectation-maximisation document by document."""
    n, p, prior = len(votes[0]), [0.02 if min(v) < 0 else 0.98 for v in votes], 0.8
    for _ in range(rounds):
        said = []
        for j in range(n):
            rate = []
            for share in (lambda x: 1 - x, lambda x: x):
                cast = [(share(x), v[j]) for x, v in zip(p, votes) if v[j]]
                rate.append((sum(w for w, y in cast if y > 0) + 0.5) / (sum(w for w, _ in cast) + 1))
            bad, good = rate
            said.append({1: math.log(good / bad), -1: math.log((1 - good) / (1 - bad)), 0: 0.0} if good > bad else {1: 0.0, -1: 0.0, 0: 0.0})
        prior = min(0.99, max(0.01, sum(p) / len(p)))
        p = [1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(said[j][v[j]] for j in range(n)))) for v in votes]
    return p


def vote(good, bad):
    return -1 if bad else 1 if good else 0


def quality_votes(text):
    """The votes of the eight rules."""
    text, w = text or "", words(text)
    n, chars, lines = max(1, len(w)), max(1, sum(map(len, w))), [x for x in text.split("\n") if words(x)]
    repeats, ten = quality(text)[4] / n, len(w) >= 10
    symbols, marks = sum(c in "#*$%&|<>" for c in text) / n, sum(c in "!|" for c in text) / n
    plain, upper = sum(c > "\x7f" or c.isalpha() for c in text) / chars, sum("A" <= c <= "Z" for c in text) / chars
    length, varied, dup = sum(map(len, w)) / n, len(set(w)) / n, (len(lines) - len(set(lines))) / max(1, len(lines))
    return (vote(symbols <= 0.1, symbols > 0.5), vote(plain >= 0.85 and ten, plain < 0.72 and ten), vote(marks <= 0.1, marks > 0.25), vote(3 <= length <= 10 and ten, length < 2 or length > 15),
            vote(upper <= 0.15 and ten, upper > 0.5 and ten), vote(repeats <= 0.15, repeats > 0.4 and ten), vote(varied >= 0.35 and ten, varied < 0.2 and ten), vote(dup <= 0.1, dup > 0.4 and len(lines) >= 5))


def label_votes(text):
    """The votes of the eight labellers."""
    raw, w = (text or "").encode(), words(text, True)
    n, per = len(w), max(1, len(w))
    size = max(1, sum(b not in b" \t\n\x0b\x0c\r" for b in raw))
    symbols, bars, bangs = (sum(b in chars for b in raw) / per for chars in (b"#*$%&<>{}[]\\^~", b"|", b"!"))
    upper, letters = sum(65 <= b <= 90 for b in raw) / size, sum(b >= 128 or chr(b).isalpha() for b in raw) / size
    top, echo, varied = max((w.count(x) for x in set(w)), default=0) / per, sum(a == b for a, b in zip(w, w[1:])) / per, len(set(w)) / per
    ten = n >= 10
    return (vote(symbols <= 0.1, symbols > 0.5), vote(letters >= 0.85 and ten, letters < 0.72 and n != 1), vote(bars <= 0.05, bars > 0.25 and n >= 5), vote(top <= 0.15 and ten, top > 0.3 and ten),
            vote(upper <= 0.15 and ten, upper > 0.5 and n >= 2), vote(bangs <= 0.05, bangs > 0.4), vote(echo <= 0.02 and ten, echo > 0.3 and ten), vote(varied >= 0.35 and ten, varied < 0.2 and ten))


def linked_secrets(text, reach=200):
    """All spans, joined: the strong ones, and the weak ones that complement each other within reach."""
    text = text or ""
    strong = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        strong += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    strong += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    strong += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    weak = [(m.start(), 3, m.end()) for m in re.finditer(r"""(?i)(client_?id|access_?key_?id|account|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", text) if len(m[2]) >= 4]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(r"[A-Za-z0-9+/]+", text) if len(m[0]) == 40]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(r"(?i)(?<![a-z])(https?|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9._~:@/-]+", text) if len(m[0]) >= 8]
    weak = [p for p in weak if not any(s[0] < p[2] and p[0] < s[2] for s in strong)]
    role = ["key", "id", "key", "id", "key", "endpoint"]
    needs = {"key": lambda near: near & {"id", "endpoint"}, "id": lambda near: "key" in near, "endpoint": lambda near: {"key", "id"} <= near}
    linked = [p for p in weak if needs[role[p[1]]]({role[q[1]] for q in strong + weak if role[q[1]] != role[p[1]] and abs(q[0] - p[0]) <= reach})]
    return ",".join(f"{['assign', 'access', 'hex', 'id', 'key', 'endpoint'][k]}:{s}:{e}" for s, k, e in sorted(strong + linked))


UNITS = set("km m cm mm kg g mg lb lbs oz ml l mph kmh percent usd eur dollars euros cents miles meters metres feet inches hours minutes seconds days weeks months years degrees watts volts".split())


def leaked(docs, items, width=8):
    """{(doc_id, item_id): (n_windows, item_windows, verbatim)} by sliding every item along every document."""

    def tokens(text):
        return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")

    def template(t):
        if t[0] in "0123456789":
            return "<num>"
        if "A" <= t[0] <= "Z" and t[1:2] != t[1:2].upper():
            return "<name>"
        return "<unit>" if t in UNITS else t.lower()

    def folded(t):
        return "<num>" if t[0] in "0123456789" else "<unit>" if t.lower() in UNITS else t.upper()

    out = {}
    for item_id, text in items:
        x = tokens(text)
        places = range(len(x) - width + 1)
        slots = {f: [sum(f(t)[0] == "<" for t in x[i : i + width]) for i in places] for f in (template, folded)}
        usable = {f: {i for i in places if 2 * slots[f][i] <= width} for f in slots}
        exact = {(i, width) for i in places if 2 * slots[folded][i] > width} | ({(0, len(x))} if 0 < len(x) < width else set())
        for doc_id, told in docs:
            y, found, same = tokens(told), set(), []
            for form, value in ((template, str), (folded, str.upper)):
                fx, fy = [form(t) for t in x], [form(t) for t in y]
                for shift in range(-len(x), len(y)):
                    hit = {i for i in usable[form] if 0 <= i + shift <= len(y) - width and fx[i : i + width] == fy[i + shift : i + shift + width]}
                    if hit:
                        run = range(min(hit), max(hit) + width)
                        pairs = {(value(x[i]), value(y[i + shift])) for i in run if fx[i][0] == "<" and fx[i] == fy[i + shift]}
                        if len(pairs) == len({a for a, _ in pairs}):
                            found |= hit
                            same.append(all(a.upper() == b.upper() for a, b in pairs))
            up = [[t.upper() for t in z] for z in (x, y)]
            for i, size in exact:
                if any(up[0][i : i + size] == up[1][j : j + size] for j in range(len(y) - size + 1)):
                    found.add(i)
                    same.append(True)
            every, plain = usable[template] | usable[folded] | {i for i, _ in exact}, usable[template]
            if found and (10 * len(found) >= 3 * len(every) or plain and 10 * len(found & plain) >= 3 * len(plain)):
                out[doc_id, item_id] = (len(found), len(every), all(same))
    return out
