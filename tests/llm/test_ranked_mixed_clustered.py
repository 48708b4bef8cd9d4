"""Curriculum mixing, ranked search and centroid clustering against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import centroids, curriculum, ranked_search

# ---- mixing ----------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights, budget, most):
    """Shares by weight; what is over a source's bound is shared again among the others, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    return target


def mixing_rows():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", "😀", None, "tiny", ""])
        words = rng.choice([0, 1, 3, 3, 40]) if source != "tiny" else 1
        rows.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(words)), source))
    rows += [(900, None, "a"), (901, " \t\n", "void"), (None, "one two", "a"), (None, "one two", "a"), (7, "again", "b"), (7, "again", "b"), (902, "x " * 5000, "b")]
    return rows


def mixed_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, "k") for r in rows], "doc_id long, text string, source string, size long, target double, key string").repartition(5)


def test_mixing(spark):
    rows = mixing_rows()
    got = [r.asDict(recursive=True) for r in curriculum.mix(mixed_frame(spark, rows)).collect()]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows)
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    sizes["void"] = 0
    want = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
        assert all(0 <= p["words"] <= r["size"] and 0 <= p["due"] <= 1 for p in r["passes"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_reruns_and_order_of_mixing(spark):
    rows = mixing_rows()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"], str(r["passes"]))
    first, again = (sorted(map(key, curriculum.mix(mixed_frame(spark, x)).collect())) for x in (rows, rows[::-1]))
    assert first == again
    placed = curriculum.training_order(curriculum.mix(mixed_frame(spark, rows))).collect()
    assert [r["position"] for r in placed] == sorted(r["position"] for r in placed)
    # Positions are what is demanded by then: the words placed before a row, but for what is being read there.
    longest, before = 5000 + len({r["source"] for r in placed}), 0
    for r in placed:
        assert abs(r["position"] - before) <= 2 * longest
        before += r["words"]
    # Heavy sources lead and light ones come late.
    due = lambda s: np.average([r["due"] for r in placed if r["source"] == s], weights=[r["words"] for r in placed if r["source"] == s])
    assert due("Z") < 0.5 < due("tiny") or due("Z") < due("tiny")


@pytest.mark.parametrize("knots", [*curriculum.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0))])
def test_schedules_invert(spark, knots):
    times = [i / 40 for i in range(41)]
    t = spark.createDataFrame([(x,) for x in times], "t double").select("t", curriculum.demanded(F.col("t"), knots).alias("part"))
    rows = t.withColumn("back", curriculum.due(F.col("part"), knots)).collect()
    whole = [np.trapezoid(np.interp(g := np.linspace(0, x, 4001), *zip(*knots)), g) for x in times]
    for r, w in zip(sorted(rows, key=lambda r: r["t"]), whole):
        assert r["part"] == pytest.approx(w / whole[-1], abs=1e-5) and r["back"] == pytest.approx(r["t"], abs=1e-6)


def test_mixing_of_little_and_of_many_sources(spark):
    assert curriculum.mix(mixed_frame(spark, [(1, "a", "s")]).limit(0)).count() == 0
    only = curriculum.mix(mixed_frame(spark, [(1, None, None), (2, "", "s")])).collect()
    assert [(r["target"], r["taken"], r["passes"]) for r in only] == [(0.0, 0, [])] * 2
    many = [(i, "w " * (1 + i % 7), f"s{i:04d}") for i in range(1500)]
    got = {r["source"]: r["target"] for r in curriculum.mix(mixed_frame(spark, many), weights=(7, 1), schedules=curriculum.SCHEDULES[:2], budget=1.2).collect()}
    assert got == pytest.approx(plain_targets({s: 1 + i % 7 for i, (_, _, s) in enumerate(many)}, (7, 1), 1.2, 2))


# ---- ranked search ---------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_ranking(docs, items, k):
    told = [(d, Counter(terms(t))) for d, t in docs]
    told = [(d, c, sum(c.values())) for d, c in told if c]
    n, length = len(told), sum(x for _, _, x in told)
    df = Counter(t for _, c, _ in told for t in c)
    out = {}
    for at, (_, text) in enumerate(items):
        scored = []
        for d, c, size in told:
            m = 100 - 75 + (75 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out[at] = [(None if none else d, -s) for s, none, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("shard,frontier", [(1 << 21, 1 << 20), (60, 40)])
def test_ranked_search(spark, monkeypatch, shard, frontier):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("", "x", "É", "é", "7", "😀")]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ",", "\n", "-", "\x00" if rng.random() < 0.1 else "_"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(250)]
    docs += [(300, None), (301, ""), (302, " .,"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[9][1]), (None, "ax bx ax"), (303, text(3000)), (304, docs[8][1].upper())]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(3, "ax AX bx"), (21, None), (22, "..."), (None, "hx hx"), (23, "never seen")] + [(24, docs[8][1])]
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked_search.walk, "__defaults__", (frontier,))
    frame = spark.createDataFrame([(d, t, 1, 2, "q") for d, t in docs], "doc_id long, text string, n long, score long, query string").repartition(3)
    asked = spark.createDataFrame([(q, t, "x", at) for at, (q, t) in enumerate(items)], "item_id long, text string, doc_id string, at int").coalesce(1)
    want = plain_ranking(docs, items, 10)
    numbers = {r["query"]: at for at, r in enumerate(asked.select("at", F.monotonically_increasing_id().alias("query")).orderBy("at").collect())}
    got = {}
    for r in ranked_search.ranked(frame, asked).orderBy("query", "rank").collect():
        rows = got.setdefault(numbers[r["query"]], [])
        rows.append((r["doc_id"], r["score"]))
        assert r["rank"] == len(rows) and r["item_id"] == items[numbers[r["query"]]][0]
    assert got == {at: rows for at, rows in want.items() if rows}


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked(docs.limit(0), items).count() == 0
    assert ranked_search.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked_search.ranked(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_walks_prune(spark):
    """A document that has all of a query's terms is found without opening most of the others."""
    rng = np.random.default_rng(5)
    docs, n = 5000, 40
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(docs), np.arange(n), indexing="ij"))
    some = (rng.random(len(doc)) < 0.1) | (doc == 77)
    doc, term = doc[some], term[some]
    impact = np.where(doc == 77, 900, rng.integers(100, 300, len(doc)))
    treaps = ranked_search.build_treaps(np.arange(docs), np.zeros(docs, bool), doc, term, impact)
    found = ranked_search.Found(1, 1)
    opened = ranked_search.walk(treaps, [(0, np.arange(n), np.ones(n, np.int64))], found)
    assert found.doc[0, 0] == 77 and found.score[0, 0] == 900 * n and opened < docs / 50


# ---- clustering ------------------------------------------------------------------------------------------------------


def plain_clusters(rows, size, k, rounds, scale=1024, salt=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest()))
    at = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(at)), key=lambda c: (far(v, at[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        groups = {c: [v for (_, v), x in zip(kept, of) if x == c] for c in range(len(at))}
        at = [[sum(x) // len(g) for x in zip(*g)] if (g := groups[c]) else at[c] for c in range(len(at))]
    return sorted((str(i), c := near(v), far(v, at[c])) for i, v in kept), at


@pytest.mark.parametrize("shape", ["blobs", "ties", "few"])
def test_clusters(spark, shape):
    rng = random.Random(9)
    if shape == "ties":  # a grid, on which many vectors are as far from one centroid as from another
        rows = [(i, [(i % 5) / 1024, (i // 5 % 5) / 1024, 0.0]) for i in range(100)]
    else:
        rows = [(i, [rng.gauss(rng.randint(-2, 2), 0.3) for _ in range(3)]) for i in range(3 if shape == "few" else 300)]
    rows += [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 2.0]), (503, [1.0, float("nan"), 2.0]), (504, [float("inf"), 0.0, 0.0]), (None, rows[0][1]), (1, rows[1][1]), (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 1.0, b"") for i, v in rows], "vec_id long, embedding array<double>, cluster int, upper double, v binary").repartition(4)
    state, at = centroids.cluster(df, k=6, rounds=7, size=3)
    want, centers = plain_clusters(rows, 3, 6, 7)
    assert at == centers
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in state.collect()) == want


def test_bounds_spare_vectors():
    rng = np.random.default_rng(1)
    at = rng.integers(-5000, 5000, (8, 16))
    v = at[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 16))
    cluster, upper, lower, _ = centroids.settle(v, np.full(4000, -1), np.zeros(4000), np.zeros(4000), at, np.zeros(8))
    moved = at + rng.integers(-20, 20, at.shape)
    drift = np.sqrt(((moved - at) ** 2).sum(axis=1).astype(float))
    again, _, _, scanned = centroids.settle(v, cluster, upper, lower, moved, drift)
    assert (again == centroids.distances(v, moved).argmin(axis=1)).all() and scanned.mean() < 0.1


def test_clusters_of_nothing_and_of_huge_vectors(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    state, at = centroids.cluster(df, k=2, rounds=2, size=2)
    assert sorted(at) == [[0, 0], [centroids.CLAMP, -centroids.CLAMP]] and all(r["distance"] == 0 for r in state.collect())
    state, at = centroids.cluster(df.limit(0), size=2)
    assert state.count() == 0 and at == []
