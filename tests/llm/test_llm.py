"""Every operator against a plain version, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import json
import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontaminate, near_dedup, ngram_lm, pii, quality_classifier, quality_rules, secret_scan, token_counts, warc

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "ing", "é"]) for _ in range(n))


def corpus():
    rng = random.Random(1)
    base = [prose(rng, 120) for _ in range(12)]
    texts = [*base, base[0], base[0], base[1].upper(), base[2] + " more words at the end", " ".join(base[3].split()[:100]), prose(rng, 4000), "one two", "One  two\n", "", None, " \t\n", "x", "a b c d e"]
    words = base[4].split()
    for k in range(10):  # a chain of copies, each a few words from the last
        words[(k * 11) % len(words)] = f"new{k}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def frame(spark, rows):
    """With columns that clash with the operators' own names."""
    return spark.createDataFrame([(k, t, "x", 1, True, "s") for k, t in rows], "doc_id long, text string, node string, n long, kept boolean, spans string").repartition(3)


def test_near_dedup(spark):
    rows = corpus()
    rows += [(100 + i, " ".join([*prose(random.Random(50), 40).split(), *prose(random.Random(60 + i // 3), 30).split(), f"end{i}"])) for i in range(18)]  # one long passage in all
    forms = [{r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows), block=2, most=most).collect()} for most in (near_dedup.MOST, 3)]
    sets = {}
    for k, t in rows:
        w = brute.words(t, True)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    for got in forms:
        assert got == {k: (len(s), top[k], top[k] == k) for k, s in sets.items()}


def test_a_bucket_of_unlike_members_stays_linear(spark):
    rng, n = np.random.default_rng(1), 20_000
    signatures = rng.integers(0, 2**32, (n, 120), dtype=np.uint32)
    signatures[:, :3] = 7  # all in one bucket
    signatures[1] = signatures[0]
    classes = spark.createDataFrame([(i, 50, signatures[i].tobytes()) for i in range(n)], "node long, n_shingles long, signature binary").repartition(8)
    bands = near_dedup._bands(classes, near_dedup.BANDS, near_dedup.ROWS_PER_BAND)
    buckets = near_dedup._buckets(bands)
    assert buckets.filter(f"members > {near_dedup.MOST}").count() == 1
    opened = near_dedup._opened(bands, buckets.filter(f"members > {near_dedup.MOST}"), spark.createDataFrame([], "node long, component long"))
    again = near_dedup._banded_again(opened.select(F.lit(0).cast("long").alias("band"), "node"), classes, 1)
    found = near_dedup._buckets(again)
    assert again.count() == near_dedup.AGAIN * n and found.agg(F.max("members")).head()[0] <= 3
    assert found.filter("center = 0 and members = 2").count() >= near_dedup.AGAIN - 1


def test_near_dedup_repeats_and_null_ids(spark):
    text, other = prose(random.Random(2), 60), prose(random.Random(3), 60)
    df = spark.createDataFrame([(5, text), (5, text), (5, other), (3, other), (None, text), (9, None)], "doc_id long, text string")
    rows = sorted(near_dedup.near_duplicates(df).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in rows] == sorted([(5, 3, False)] * 3 + [(3, 3, True), (None, None, True), (9, 9, True)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
    star = [(500, i) for i in range(501, 900)] + [(i, i + 400) for i in range(501, 600)] + [(2, 900)]
    for hub in (3, near_dedup.HUB):
        got = dict(near_dedup.connected_components(spark.createDataFrame(star, "a long, b long"), hub=hub).collect())
        assert got == {i: 500 for i in range(500, 900)} | {i: 500 for i in range(901, 1000)} | {2: 2, 900: 2}


def test_component_rounds_have_small_plans(spark, monkeypatch):
    sizes, staged_at = [], near_dedup.staged_at

    def noted(df, path):
        sizes.append(len(df._jdf.queryExecution().executedPlan().toString().splitlines()))
        return staged_at(df, path)

    monkeypatch.setattr(near_dedup, "staged_at", noted)
    star = spark.createDataFrame([(1, i) for i in range(2, 60)] + [(70, 71), (71, 72)], "a long, b long")
    for hub in (3, near_dedup.HUB):
        assert dict(near_dedup.connected_components(star, hub=hub).collect()) == {i: 1 for i in range(1, 60)} | {70: 70, 71: 70, 72: 70}
    assert max(sizes) <= 60  # each has to be planned and kept by the driver


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, order):
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in ngram_lm.score_texts(frame(spark, rows), order=order, mass=(4.0, 2.0), block_bytes=500).collect()}
    want = brute.language_model(rows, order, (4.0, 2.0))
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4]
        assert got[k][4:] == pytest.approx(w[4:], rel=1e-9)
    assert ngram_lm.score_texts(frame(spark, rows).limit(0)).count() == 0


def test_packed_counts_and_repeated_rows(spark):
    counts = np.array([0, 1, 254, 255, 256, 2**40, 3])
    assert ngram_lm._unpack_counts(ngram_lm._pack_counts(counts)).tolist() == counts.tolist()
    assert ngram_lm._unpack_counts(ngram_lm._pack_counts(counts[:0])).tolist() == []
    rows = [(4, "one two one two")] * 300 + [(None, "one"), (9, None)]
    got = [tuple(r) for r in ngram_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 302 and {r[0] for r in got} == {4, 9, None} and len({r[5:] for r in got if r[0] == 4}) == 1
    assert all(r[2] == 5 for r in got if r[0] == 4) and all(r[6] > r[5] for r in got if r[0] == 4)


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.default_tokenizer()


def test_bpe_matches_the_library(spark, tokenizer):
    from tokenizers import Tokenizer

    rng, library = random.Random(4), Tokenizer.from_file(tokenizer)
    pool = "aabbe  \t\n'sS.,!?12ÀÉéçñßΣσςİıﬁ́漢字　\xa0😀-_<|>#½Ⅷ\x1c\x85"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 50))) for _ in range(300)] + ["a" * 3000, "hi <|endoftext|> you", "don't I'LL"]
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in bpe.encode_texts(frame(spark, rows), tokenizer).collect()}
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == library.decode(ids, skip_special_tokens=False)
    short = {r["doc_id"]: r for r in bpe.encode_texts(frame(spark, rows), tokenizer, with_texts=False).collect()}
    assert all(hashlib.sha256(got[k]["ids"]).hexdigest() == r["ids_sha256"] and hashlib.sha256(got[k]["decoded"].encode()).hexdigest() == r["decoded_sha256"] for k, r in short.items())
    assert bpe.encode_texts(frame(spark, rows).limit(0), tokenizer).count() == 0
    odd = spark.createDataFrame([(None, "one"), (None, "one"), (7, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded"]) for r in bpe.encode_texts(odd, tokenizer).collect()) == [("7", 0, ""), ("None", 1, "one</w>"), ("None", 1, "one</w>")]


def test_small_automaton():
    merges = [("a", "a"), ("a", "b</w>"), ("aa", "ab</w>")]
    tokens = ["a", "b", "a</w>", "b</w>", *(x + y for x, y in merges)]
    vocab = {t: i for i, t in enumerate(tokens)}
    encoder = bpe.Encoder({"added_tokens": [{"content": "<s>", "id": 99, "special": True}], "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": "[ab]+"}}]}}, bpe.compile_automaton(vocab, merges, "</w>"))

    def slow(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert [tokens[t] for t in encoder.word(word.encode())] == slow(word), word
            ids, at = encoder.pieces(np.frombuffer(word.encode() * 2, np.uint8), np.array([0, n, 2 * n]))
            assert [tokens[t] for t in ids] == slow(word) * 2 and at.tolist() == [0, len(ids) // 2, len(ids)], word


def test_token_counts(spark, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = True
    rows = [*((k, t if t is None else t[:900]) for k, t in corpus()), (500, "a literal <|endoftext|> is text")]
    whole = {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in rows}
    for block in (1, 7, 1 << 20):
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(frame(spark, rows), tokenizer, block_tokens=block).collect()} == whole
    assert token_counts.token_counts(frame(spark, rows).limit(0), tokenizer).count() == 0
    odd = spark.createDataFrame([(None, "one"), (5, "one two"), (5, "one two"), (5, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(odd, tokenizer).collect()) == [("5", 0), ("5", 2), ("5", 2), ("None", 1)]
    with pytest.raises(Exception, match="do not fit"):
        token_counts.token_counts(odd, tokenizer, separator=70_000).count()


def test_token_blocks_are_dealt(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(np.full(4000, 7, "<u2").tobytes())
    blocks = token_counts.plan_blocks(spark, f"file://{tmp_path}", spark.createDataFrame([("t.bin",)], "file string"), 100)
    assert blocks.count() == 40 and blocks.select(F.spark_partition_id()).distinct().count() > 3
    scanned = token_counts.scan_blocks(blocks, f"file://{tmp_path}", 9)
    assert [tuple(r) for r in token_counts.document_lengths(scanned).collect()] == [("t.bin", 0, 4000)]


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://a/5", "y" * 200_000), (6, "http://a/ 6\r\nX: y", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(df, folder)
    back = spark.read.format("pathloom-warc").option("payload", "true").option("partitionBytes", "100").load(folder)
    got = {r["page_id"]: r for r in back.collect()}
    for k, _, html in rows:
        body = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        assert (got[k]["payload_bytes"], got[k]["payload_digest"], got[k]["record_type"]) == (len(body), warc.digest(body), "response" if first == k else "revisit")
        assert got[k]["refers_to"] == (None if first == k else str(first)) and (got[k]["payload"] or b"") == (body if first == k else b"")
    only = spark.read.format("pathloom-warc").load(folder).filter("record_type = 'revisit'").select("page_id")
    assert {r[0] for r in only.collect()} == {2, 4}
    warc.write_archives(df, folder, least_bytes=100)
    assert spark.read.format("pathloom-warc").load(folder).filter("record_type = 'revisit'").count() == 2
    (tmp_path / "cut").mkdir()
    whole = warc.record(1, "u", "d", b"abc", warc.digest(b"abc"), 1)
    (tmp_path / "cut" / "x.warc").write_bytes(whole[:-6])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("pathloom-warc").load(f"file://{tmp_path}/cut").collect()
    warc.write_archives(df.limit(0), f"{folder}-none")
    assert spark.read.format("pathloom-warc").load(f"{folder}-none").count() == 0


def test_warc_skips_what_it_does_not_want(tmp_path):
    import gzip

    from pyarrow import fs

    pages = [random.Random(i).randbytes(300_000).hex().encode() for i in range(6)]
    records = [warc.record(i, "u", "d", p, warc.digest(p), 0 if i == 5 else i) for i, p in enumerate(pages)]
    head = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 9\r\nContent-Type: application/http\r\n"
    records.append(head + b"Content-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n")  # no length of its own
    records.append(head + b"Content-Length: 17\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n")  # no blank line
    files = {"told": b"".join(map(warc.member, records)), "foreign": b"".join(map(gzip.compress, records)), "plain": b"".join(records), "one": gzip.compress(b"".join(records))}
    for name, data in files.items():
        assert name == "plain" or gzip.decompress(data) == b"".join(records)
        path = f"{tmp_path}/{name}.warc{'' if name == 'plain' else '.gz'}"
        with open(path, "wb") as out:
            out.write(data)
        for payload in (False, True):
            reader = warc.WarcReader({"path": str(tmp_path), "payload": str(payload)}, type("Schema", (), {"names": ["page_id", "record_type", "payload_bytes", "payload"]}))
            rows = list(reader.read(warc.Files((path,))))
            assert [r[:3] for r in rows] == [*((i, "revisit" if i == 5 else "response", 600_000) for i in range(6)), (9, "response", 3), (9, "response", 0)]
            assert [r[3] for r in rows] == ([*pages[:5], None, b"abc", b""] if payload else [None] * 8)
            reader.wanted = {"record_type": {"revisit"}}
            assert [r[0] for r in reader.read(warc.Files((path,)))] == [5]
    with fs.LocalFileSystem().open_input_file(f"{tmp_path}/told.warc.gz") as raw:
        source = warc.Members(raw)
        while (found := warc.headers_of(source)) is not None:
            source.skip(int(found["content-length"]))
        assert source.inflated <= 2 * warc.INFLATED * len(records)
    with open(f"{tmp_path}/cut.warc.gz", "wb") as out:
        out.write(files["told"][: len(files["told"]) // 2])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.WarcReader({"path": str(tmp_path)}, type("Schema", (), {"names": ["page_id"]})).read(warc.Files((f"{tmp_path}/cut.warc.gz",))))


def test_personal_data(spark):
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "mail.", "example.com", "1", "22", "333", "256", ".", "-", "+", "(", ")", " ", "4953149385346306", "é😀", "\n", "+1 (132) 555-1352", "_"]
    rows = corpus() + [(1000 + i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(600)] + [(5000, "1" * 20_000), (5001, "a" * 20_000 + "@b.c"), (5002, "0001.2.3.4 " * 3)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows), redacted=True, carry=["n", "spans"]).collect()}
    assert all(r["carried"] == (1, "s") for r in got.values()) and pii.personal_data(frame(spark, rows).limit(0)).count() == 0
    for k, t in rows:
        counts, joined, _ = brute.personal(t)
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == counts and got[k]["base"] == joined
        assert set(filter(None, joined.split(","))) <= set(got[k]["spans"].split(","))
    assert all(got[k]["spans"] == "" for k, _ in corpus())
    assert pii.mask("call +1 (132) 555-1352 now", [(5, 3, 22)]) == "call <phone> now"


def test_obfuscated_addresses_anywhere():
    model, pad = pii.trained(), "the reason was as it is of the road and on in her or he at end " * 4
    assert pii.find(["write to jane.doe [at] mail.example.com now"], model) == [([], [(9, 0, 39)])]
    long = "onerestandoruntienhaedat.ndaterreenor [at] mail3.host.org"
    texts = [f"{pad[:k]} {long} {pad}" for k in range(100, 164)]
    assert pii.find(texts, model) == [([], [(k + 1, 0, k + 1 + len(long))]) for k in range(100, 164)]


def test_reconcile_many_spans():
    import itertools
    import tracemalloc

    rng = random.Random(5)
    for _ in range(200):
        spans = [(s := rng.randint(0, 12), rng.randint(0, 3), s + rng.randint(1, 5), rng.random()) for _ in range(rng.randint(0, 7))]
        fixed = sorted((s := rng.randint(0, 12), 0, s + rng.randint(1, 3)) for _ in range(rng.randint(0, 2)))
        free = [x for x in spans if not any(a < x[2] and x[0] < b for a, _, b in fixed)]
        sets = (c for n in range(len(free) + 1) for c in itertools.combinations(free, n) if all(x[2] <= y[0] or y[2] <= x[0] for x, y in itertools.combinations(c, 2)))
        weight = {x[:3]: max(y[3] * (y[2] - y[0]) for y in free if y[:3] == x[:3]) for x in free}
        assert sum(weight[x] for x in pii.reconcile(spans, fixed)) == pytest.approx(max(sum(p * (e - s) for s, _, e, p in c) for c in sets))
    tracemalloc.start()
    many = [(10 * i, 3, 10 * i + 9, 0.99) for i in range(100_000)]
    assert len(pii.reconcile(many, [(10 * i, 2, 10 * i + 2) for i in range(0, 100_000, 2)])) == 50_000
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_every_accepted_shape_has_a_trigger():
    rng = random.Random(13)
    shapes = ["a.b [at] c.d", "x(at)y.example.org", "a [at]b.c", "(555) 123-4567", "0049 170 1234567", "4953 1493 8534 6306"]
    for _ in range(3000):
        piece = list(rng.choice(shapes))
        for _ in range(rng.randint(0, 3)):
            piece[rng.randrange(len(piece))] = rng.choice("ab1.([])@ -")
        piece = "".join(piece)
        assert pii.TRIGGER.search(piece) or not any(pii.well_formed(k, piece) for k in range(4)), piece


def held_out_spans(seed=77, texts=600):
    """(precision, recall) of all spans reported on texts of the generator that training has not seen."""
    rng = np.random.Generator(np.random.PCG64(seed))
    told = [pii.example(rng) for _ in range(texts)]
    found = pii.find([t for t, _ in told], pii.trained())
    want = {(i, *x) for i, (_, spans) in enumerate(told) for x in spans}
    got = {(i, *x) for i, (f, a) in enumerate(found) for x in f + a}
    return len(got & want) / len(got), len(got & want) / len(want)


def test_held_out_spans():
    precision, recall = held_out_spans()
    assert precision > 0.8 and recall > 0.6, (precision, recall)
    rng = np.random.Generator(np.random.PCG64(78))
    told = [pii.example(rng) for _ in range(900)]
    found = pii.find([t for t, _ in told], pii.trained())
    for k, name in enumerate(pii.KINDS):
        want = {(i, *x) for i, (_, spans) in enumerate(told) for x in spans if x[1] == k}
        got = {(i, *x) for i, (f, a) in enumerate(found) for x in f + a if x[1] == k}
        assert len(got & want) > 0.95 * len(got) and len(got & want) > 0.9 * len(want), (name, len(want), len(got), len(got & want))
        assert all(pii.well_formed(k, told[i][0][s:e]) for i, _, s, e in {(i, kk, s, e) for i, s, kk, e in want}), name


def test_windows_decode_as_a_plain_decoder():
    """Texts that lie in one window, decoded by themselves: the runs of the best path that reach the bar and are whole."""
    rng, model = np.random.Generator(np.random.PCG64(79)), pii.trained()
    for _ in range(150):
        text = pii.example(rng)[0][:30]
        found = pii.find([text], model)[0]
        x = np.full((1, pii.WINDOW), 32, np.int64)
        x[0, : len(text)] = pii.coded(text)
        emit = pii.emissions(model, x)
        path, sure = pii.viterbi(emit, model["moves"])[0], pii.marginals(emit, model["moves"])[0]
        want, at = [], 0
        while at < pii.WINDOW:
            tag, end = int(path[at]), at + 1
            if tag % 2:
                while end < pii.WINDOW and path[end] == tag + 1:
                    end += 1
                score = np.mean([sure[j, path[j]] for j in range(at, end)])
                whole = end <= len(text) and pii.well_formed(tag // 2, text[at:end])
                if whole and score >= model["sure"][tag // 2] and not any(s < end and at < e for s, _, e in found[0]):
                    want.append((at, tag // 2, end))
            at = end
        if pii.TRIGGER.search(text):
            assert sorted(found[1]) == want, text


def test_personal_data_model():
    x, y = pii.labelled(300, 99)
    path = pii.viterbi(pii.emissions(pii.trained(), x.astype(np.int64)), pii.trained()["moves"])
    assert (path == y).mean() > 0.97 and (path == y)[y > 0].mean() > 0.9
    emit, moves = np.random.default_rng(0).normal(size=(3, 5, 4)), np.random.default_rng(1).normal(size=(4, 4))
    assert pii.marginals(emit, moves).sum(axis=2) == pytest.approx(1)


def test_crf_paths_by_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    emit, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    scores = {p: sum(emit[0, t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=4)}
    assert tuple(pii.viterbi(emit, moves)[0]) == max(scores, key=scores.get)
    whole = sum(map(math.exp, scores.values()))
    assert pii.marginals(emit, moves)[0, 2, 1] == pytest.approx(sum(math.exp(s) for p, s in scores.items() if p[2] == 1) / whole)


def test_quality_rules(spark):
    rng = random.Random(6)
    rows = corpus() + [(1000 + i, rng.choice(["", "\n", " "]).join(rng.choices(["spam spam", "a#", "B", "é", "\n", "  ", "x y z", "!!"], k=rng.randint(0, 90)))) for i in range(150)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    for k, t in rows:
        assert tuple(got[k])[1:7] == brute.quality(t), t
        assert got[k]["kept"] == (not got[k]["base_failed"] and got[k]["p_quality"] >= 0.5)
    assert quality_rules.quality_rules(frame(spark, rows).limit(0)).count() == 0
    rows += junk_corpus()
    got = quality_rules.quality_rules(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    want = brute.majority_of_rules([brute.quality_votes(t) for _, t in rows])
    assert {r["doc_id"]: r["p_quality"] for r in got} == pytest.approx(dict(enumerate(want)), abs=1e-6)
    assert any(p > 0.9 for p in want) and any(p < 0.1 for p in want)


def junk_corpus():
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(30, 200))) for i in range(160)]
    for i in range(10):
        rows += [(200 + i, " | ".join(prose(rng, 40).split())), (300 + i, " ".join(w.upper() + "!!" for w in prose(rng, 40).split())), (400 + i, "spam " * 60), (500 + i, " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 40).split()))]
    return rows


def test_quality_classifier(spark):
    rows = junk_corpus() + [(900, None), (901, ""), (902, "Ünï ###"), (903, prose(random.Random(14), 3000))]
    told = quality_classifier.classify(frame(spark, rows)).collect()
    got = {r["doc_id"]: r["kept"] for r in told}
    assert len(got) == len(rows)
    want = brute.majority_of_rules([brute.label_votes(t) for _, t in rows])
    assert {r["doc_id"]: r["p_label"] for r in told} == pytest.approx({k: p for (k, _), p in zip(rows, want)}, abs=1e-6)
    again = quality_classifier.classify(spark.createDataFrame([*rows[:200], *rows[:5], (None, rows[0][1])], "doc_id long, text string")).collect()
    assert len(again) == 206 and sum(r["doc_id"] is None for r in again) == 1 and len({(r["doc_id"], round(r["p_good"], 9)) for r in again}) == 201
    assert sum(got[i] for i in range(160)) == 160
    assert sum(got[i] for i in range(200, 600) if i in got) <= 2
    assert quality_classifier.classify(frame(spark, rows).limit(0)).count() == 0


def test_scorer_sums_its_buckets():
    rng = np.random.default_rng(5)
    texts = ["abc d1é", "", "x", "Zebra zebra!!", "yz", prose(random.Random(15), 50)]
    weights = rng.normal(size=quality_classifier.BUCKETS + 16 * quality_classifier.MEASURES + 1)
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    m = quality_classifier.measures(data, offsets)
    got = quality_classifier.raw_scores(weights, data, offsets, m)
    for i, t in enumerate(raw):
        fold = [128 if b >= 128 else 48 if 48 <= b <= 57 else b for b in t] + [0, 0]
        keys = [((fold[j] * 0x9E3779B1 + fold[j + 1] * 0x85EBCA77 + fold[j + 2] * 0xC2B2AE3D) % 2**32 >> 16) % quality_classifier.BUCKETS for j in range(len(t))]
        dense = [quality_classifier.BUCKETS + 16 * k + int(min(15, math.log2(x + 1) if k == 0 else x if k == 5 else 15 * min(x, 1))) for k, x in enumerate(m[i])]
        assert got[i] == pytest.approx(sum(weights[k] for k in keys) / math.sqrt(max(1, len(t))) + sum(weights[k] for k in dense) + weights[-1])


def test_fit_lowers_the_loss():
    import pyarrow as pa

    texts = [t for _, t in junk_corpus()]
    labels = np.array([1.0] * 160 + [0.0] * 40)
    data, offsets = (lambda raw: (np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))([t.encode() for t in texts])
    losses = []
    for rounds in (0, 5, 30):
        score = quality_classifier.raw_scores(quality_classifier.fit(pa.array(texts), labels, rounds), data, offsets, quality_classifier.measures(data, offsets))
        losses.append(float(np.mean(np.log1p(np.exp(-score * (2 * labels - 1))))))
    assert losses[0] == pytest.approx(math.log(2)) and losses[2] < losses[1] < 0.5 and losses[2] < 0.1


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.8
    said = [np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.9)]
    v = np.stack([np.where(s, 1, -1) for s in said], axis=1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    prior, rates = quality_classifier.estimate(patterns, counts.astype(float))
    assert prior == pytest.approx(0.8, abs=0.05) and rates[1] == pytest.approx([0.95, 0.9, 0.85, 0.9], abs=0.05)


def test_a_prompt_in_all_items_and_documents_makes_no_pairs(spark):
    n, rng = 2000, random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "r", "st", "x")]
    prompt = " ".join(rng.choice(words) for _ in range(15))
    items = [(i, f"{prompt} {' '.join(rng.choice(words) for _ in range(40))}") for i in range(n)]
    docs = [(d, f"{' '.join(rng.choice(words) for _ in range(10))} {prompt} {' '.join(rng.choice(words) for _ in range(10))}") for d in range(n)]
    docs[:20] = [(d, f"see {items[7 * d][1]} there") for d in range(20)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    told, asked = (decontaminate._prepared(df, c, "text", c) for df, c in ((docs, "doc_id"), (items, "item_id")))
    kept = decontaminate._item_windows(asked, 8, "template").unionByName(decontaminate._item_windows(asked, 8, "folded"))
    hits = decontaminate.document_hits(told, kept, 8, lambda rows: rows)
    assert hits.count() < 60 * n
    assert decontaminate.candidates(hits, kept, (3, 10), lambda rows: rows).count() < n  # of four million pairs
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()) == [(d, 7 * d) for d in range(20)]


def test_a_text_of_a_hundred_thousand_spans(spark):
    from time import time

    parts = [f"username=user{i:06d} password=Abcdefgh{i:06d}" for i in range(50_000)]
    rows = [(1, " ".join(parts)), (1, "password=Abcdefgh1 username=other"), (2, " ".join(parts[:20])), (None, "username=alone"), (None, "username=alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    secret_scan.secret_spans(df.filter("doc_id = 2")).collect()
    start = time()
    got = secret_scan.secret_spans(df).collect()
    assert time() - start < 40
    long = max((r["spans"] for r in got), key=len).split(",")
    assert len(long) == 100_000 and long[:2] == ["id:0:19", "assign:20:43"] and long[-1] == f"assign:{len(rows[0][1]) - 23}:{len(rows[0][1])}"
    assert sorted(r["spans"] for r in got if r["doc_id"] is None) == ["", ""]


def test_secrets(spark):
    rng = random.Random(8)
    bits = ["token", "TOKEN = \"", "secret:", "password", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "abcdefgh", "é😀", "\n"]
    rows = corpus() + [(1000 + i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(400)] + [(5000, "token=abcdefgh1 " * 700)]
    got = {r["doc_id"]: r for r in secret_scan.secret_spans(frame(spark, rows)).collect()}
    for k, t in rows:
        counts, joined, _ = brute.secrets(t)
        assert [got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]] == counts and got[k]["base"] == joined
        assert got[k]["spans"] == brute.linked_secrets(t)
    bits += ["account=bob77 ", "client_id: ab12cd ", "https://db.example.com/x ", "aB3" * 13 + "x ", " far " * 30, " "]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(400)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_spans(frame(spark, rows)).collect()}
    assert got == {k: brute.linked_secrets(t) for k, t in rows}
    assert secret_scan.secret_spans(frame(spark, rows).limit(0)).count() == 0


def test_weak_parts_need_complements(spark):
    key = "aB3" * 13 + "x"
    texts = {1: f"account: bob77 key {key}", 2: f"a lone {key}", 3: f"account: bob77 {'far ' * 100}{key}", 4: f"client_id=ab12 https://db.example.com {key}", 5: "see https://example.com/page"}
    df = spark.createDataFrame([*texts.items(), (None, texts[1])], "doc_id long, text string")
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secret_scan.secret_spans(df).collect()}
    assert got == {1: ["id", "key"], 2: [], 3: [], 4: ["id", "endpoint", "key"], 5: [], None: ["id", "key"]}


def test_decontamination(spark):
    item = "Anna drove 120 km in 3 hours and then rested for 2 days before the long way back to her small town by the sea"
    changed = item.replace("Anna", "Peter").replace("120", "77").replace(" 3 ", " 9 ")
    mixed = "Bob gave 5 apples to Eve and Bob kept 5 apples for the rest of the week before giving them all away again"
    inconsistent = mixed.replace("kept 5", "kept 8").replace("Bob gave", "Jim gave")
    filler = prose(random.Random(9), 40)
    shout = "Éai éonleeau pour an dé éonque aivi ai, éenait anvitre èenre éèque pour eauréon"
    docs = {1: f"{filler} {item} {filler}", 2: f"{filler}\n{changed}.", 3: inconsistent, 4: filler, 5: None, 6: "", 7: " ".join(item.split()[:5]), 8: f"{mixed} {mixed}", 9: f"{filler} {shout.upper()}!!"}
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs.items()] + [(1, docs[1], 1, "x"), (None, item, 1, "x")], "doc_id long, text string, item_id int, raw string")
    bench = spark.createDataFrame([(10, item, "q"), (11, mixed, "q"), (12, "too short", "q"), (13, None, "q"), (14, item, "q"), (15, shout, "q")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 10): True, (1, 14): True, (2, 10): False, (2, 14): False, (8, 11): True, (9, 15): True}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_in_any_case(spark):
    item = "Anna Berg met Tom Klein in Oslo. Then Eva Stein left Rome for Bern. Max Weiß saw Paris, and Ida Holm ran 5 km with Jan Vogel"
    filler = prose(random.Random(11), 40)
    forms = {1: item, 2: item.upper(), 3: item.lower(), 4: item.title(), 5: item.upper().replace(" 5 KM", " 8 KM")}
    df = spark.createDataFrame([(k, f"{filler} {t} {filler}") for k, t in forms.items()] + [(6, filler)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_windows"] == r["item_windows"], r["verbatim"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {k: (True, True) for k in (1, 2, 3, 4)} | {5: (True, False)}


def test_decontamination_matches_brute_force(spark):
    rng, letters = random.Random(21), "Anna Tom Oslo Eva drove 12 km in 3 hours and 45 kg of the old 7 long way to a Bern with 9 miles left".split()
    items = [(i, " ".join(rng.choice([*letters, *WORDS]) for _ in range(rng.choice([1, 2, 5, 8, 12, 20, 30])))) for i in range(14)] + [(20, "1 2 3 4 5 6 7 8 9 10 11 12"), (21, None)]
    docs = []
    for i in range(90):
        words = (rng.choice(items)[1] or "").split()
        words = [rng.choice(letters) if rng.random() < rng.choice([0, 0, 0.1, 0.3]) else str(rng.randint(1, 99)) if w.isdigit() and rng.random() < 0.3 else w for w in words]
        lo, hi = sorted(rng.choices(range(len(words) + 1), k=2)) if rng.random() < 0.3 else (0, len(words))
        text = " ".join(rng.choice([str, str.upper, str.lower, str.title])(w) for w in words[lo:hi]) if rng.random() < 0.3 else rng.choice([str, str.upper, str])(" ".join(words[lo:hi]))
        docs.append((i, f"{prose(rng, 6)} {text}, {prose(rng, 6)} {text if rng.random() < 0.2 else ''}"))
    want = brute.leaked(docs, items)
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["verbatim"]) for r in found.collect()} == want
    assert len(want) > 50 and any(not v for *_, v in want.values())


def test_decontamination_of_numbers_and_short_items(spark):
    sums, short, mixed = "12 + 45 = 57, 8 x 4 = 32, 7 x 6 = 42, 91 - 30 = 61", "Quid pro quo, Anna?", "1 2 3 4 5 6 7 8 9 10 km"
    filler = prose(random.Random(12), 40)
    docs = {1: f"{filler} {sums} {filler}", 2: sums.replace("4", "5"), 3: f"{filler} {short.upper()} {filler}", 4: f"{filler} quid pro Anna", 5: f"{filler} {mixed.upper()}", 6: filler, 7: "8 9 10 km", 8: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, sums), (2, short), (3, mixed), (4, ""), (5, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["verbatim"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got.keys() == {(1, 1), (3, 2), (5, 3)}
    assert all(n == of and same for n, of, same in got.values()) and got[3, 2] == (1, 1, True)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = junk_corpus()
    item = prose(random.Random(10), 30)
    rows += [(700, rows[0][1]), (701, rows[1][1] + " " + item), (702, rows[2][1] + " write to joe@mail.example.com")]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 700 not in got and 701 not in got and not any(200 <= k < 600 for k in got)
    assert set(range(3, 160)) <= set(got) and 0 in got
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.redact(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert clean.filter("doc_id = 702").head()["text"].endswith("write to <email>") and clean.filter("doc_id = 3").head()["text"] == rows[3][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontaminate", "pii", "bpe"]
    few = spark.createDataFrame([(None, rows[3][1], "en", None, None, "a"), (None, rows[3][1], None, "s", 1, "b"), (5, rows[4][1], "en", "s", 1, "c"), (5, rows[5][1] + " " + item, "en", "s", 1, "d"), (5, rows[4][1], "en", "s", 1, "e"), (6, None, None, None, None, None), (7, "", "en", "s", 0, "f"), (8, " ".join(prose(random.Random(40), 900) for _ in range(40)), "en", "s", 1, "g"), (9, rows[9][1], "en", "s", 1, "h")], "doc_id long, text string, lang string, source string, n_chars int, kept string")
    for stage, left in ((corpus_pipeline.near_dedup, 7), (corpus_pipeline.decontaminate, 8), (corpus_pipeline.redact, 9)):
        out = stage(spark, few, str(tmp_path))
        assert out.schema.simpleString() == few.schema.simpleString() and out.count() == left, stage
        assert stage(spark, few.limit(0), str(tmp_path)).count() == 0
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, few, str(tmp_path)).collect()) == ["5", "5", "6", "7", "8", "9", "None"]
    judged = {(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, docs.limit(0).unionByName(few.drop("kept").unionByName(docs.limit(0))), str(tmp_path)).collect()}
    assert (5, rows[4][1]) in judged and (9, rows[9][1]) in judged
    assert corpus_pipeline.encode(spark, few, str(tmp_path)).count() == 9
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null" and F is not None
