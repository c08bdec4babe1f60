"""Tokens, packing, quality, chat, urls, mixing: against libraries, round trips and brute force."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from batonflow.llm import bpe as bpes, chat, mixing, packing, quality, tokens, urls
from batonflow.llm.bpe import bpe, default_path, id_cache

ODD = [
    (1, "Don't STOP 12 cafés! ²½ naïve"), (2, None), (3, ""), (4, " \n\t"), (5, "a<|endoftext|>b <|startoftext|>"), (6, "x\x1cy \x7f é̀ İ 漢字 ſΣς"),
    (7, "word " * 5000), (8, "z" * 3000), (1, "Don't STOP 12 cafés! ²½ naïve"), (None, "no id"),
]
SCHEMA = "doc_id long, text string"


def docs(spark, rows=ODD):
    # Columns whose names clash with what operators make.
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("score", "n", "block", "row", "class", "copy", "gram")})


def ids_of(text):
    return bpe(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    rng, cache = random.Random(1), id_cache(default_path())
    letters = "abAB'stdmrevl 09²½ªµßÀÿ×\x00\x7f\x1c\x85\xa0é̀İΣςﬁ①漢ひ\u200d👍<|startoftext|>.!\t\n_-"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", "<|endoftext|>", "we'LL"])
        assert cache.encode(text) == array("I", ids_of(text)).tobytes(), repr(text)


@pytest.mark.parametrize("slice_", [40, 1 << 18])
def test_ids_of_many_texts_are_the_librarys(monkeypatch, slice_):
    monkeypatch.setattr(bpes, "SLICE", slice_)
    rng, cache = random.Random(2), bpes.IdCache(bpe(default_path()), most=20_000)
    kinds = ["abAB'stdmrevl''  09.!-<|\n", "abAB'stdmrevl 09²½ªµßÀÿ×\x00\x7f\x1c\x85\xa0é.\t", "aé̀İΣςﬁ①漢ひ\u200d👍' .<|startoftext|>"]
    texts = ["".join(rng.choices(rng.choice(kinds), k=rng.randint(0, 14))) + rng.choice(["", "<|endoftext|>", "we'LL", " internationally'S"]) for _ in range(3000)]
    texts += ["", "x" * 500, "it's " * 200, "é" * 100]
    flat, counts = bpes.encode_all(cache, texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]
    assert [len(x) for x in bpes.encode_all(cache, [])] == [0, 0]


def test_a_word_is_made_once_whatever_stands_beside_it(monkeypatch):
    """Words that are asked for again and again stay, however many others come between."""
    coder, asked = bpe(default_path()), []
    cache = bpes.IdCache(coder, most=400 * bpes.IdCache.ENTRY)
    monkeypatch.setattr(type(coder), "word_ids", lambda self, w: asked.append(w) or [1])
    for i in range(2000):
        other = "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q"
        bpes.encode_all(cache, [f"stays, stays. (Stays) {other}{'!?;:'[i % 4]}"])
    assert asked.count("stays") == 1 and len(asked) < 2020


def test_token_counts(spark):
    got = sorted(map(tuple, tokens.count_tokens(docs(spark)).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_tokens", "over_limit").collect()))
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048) for i, t in ODD)
    assert tokens.count_tokens(docs(spark, [])).count() == 0


def test_squeeze():
    x = np.array([0, 1, 255, 256, 70000, 2**32 - 1])
    assert (tokens.unsqueeze(tokens.squeeze(x)) == x).all() and len(tokens.unsqueeze(tokens.squeeze(x[:0]))) == 0


def test_packing(spark):
    rows = ODD + [(100 + i, "word " * random.Random(i).randint(1, 3000)) for i in range(60)]
    found = packing.pack(docs(spark, rows)).collect()
    texts = dict(rows)
    placed, cut = defaultdict(list), defaultdict(list)
    for r in found:
        ids = [*ids_of(texts[r.doc_id]), 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
        placed[r.sequence_id].append((r.offset, r.length))
        cut[r.doc_id].append((r.start, r.length))

    def gapless(spans):
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        return at

    assert max(map(gapless, placed.values())) <= 2048
    for i, t in texts.items():
        assert gapless(sorted(set(cut[i]))) == len(ids_of(t)) + 1
    assert sum(r.length for r in found) / (2048 * len(placed)) > 0.9
    assert packing.pack(docs(spark, [])).count() == 0


def least_bins(lengths, room):
    """A lower bound for packing uncut lengths: those over half a bin need one each, the rest fills what they leave."""
    best, large = 0, lengths > room // 2
    for k in range(room // 2 + 1):
        alone, held, small = lengths[lengths > room - k], lengths[large & (lengths <= room - k)], lengths[(lengths >= k) & ~large]
        over = small.sum() - (len(held) * room - held.sum())
        best = max(best, len(alone) + len(held) + max(0, -(-over // room)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400)
    sizes, demand = np.unique(lengths, return_counts=True)
    table = packing.plan(dict(zip(sizes.tolist(), demand.tolist(), strict=True)), 64, 1)
    used = defaultdict(int)
    for c, g in table.groupby("class"):
        ends = [*g["start"][1:], int(demand[sizes == c][0])]
        for s, e, each, seq in zip(g["start"], ends, g["each"], g["sequence"], strict=True):
            for r in range(s, e):
                used[seq + (r - s) // each] += c
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= 64
    assert len(used) <= least_bins(lengths, 64) + 2
    patterns, x = packing.solve(sizes, demand, 64)
    assert np.allclose(patterns.T @ x, demand, atol=1e-6) and ((patterns @ sizes) <= 64).all()


def test_knapsack():
    value, pattern = packing._price(np.array([0.3, 0.55, 0.2]), np.array([3, 5, 2]), 11)
    best = max((0.3 * a + 0.55 * b + 0.2 * c) for a in range(4) for b in range(3) for c in range(6) if 3 * a + 5 * b + 2 * c <= 11)
    assert abs(value - best) < 1e-12 and pattern @ [3, 5, 2] <= 11


def quality_rows(n=400):
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "nulla", "velit", "quis"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(30, 120))).capitalize() + "."
        good = i % 6 != 0
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        if i % 2 == 0 or not good:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = quality_rows()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs(spark, [*rows, (900, None), (901, "")]), known).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and all(got[i].held_out and got[i].predicted == q for i, q in held)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    # Scores are of the text alone: other labels of held-out rows change nothing.
    flipped = known.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs(spark, rows), flipped).collect()}
    plain = {r.doc_id: r.score for r in quality.classify(docs(spark, rows), known).collect()}
    assert again == plain
    assert quality.classify(docs(spark, []), known).count() == 0
    assert {r.score for r in quality.classify(docs(spark, rows[:3]), known.limit(0)).collect()} == {0.5}


def test_quality_sums_are_of_all_rows(spark):
    rows = [*quality_rows(60)[0], (3, "again"), (3, None), (None, "")]
    expected = np.stack([quality.features(np.frombuffer((t or "").encode(), np.uint8)) for _, t in rows]).sum(axis=0, dtype=np.float64)
    for parts in (1, 5):
        made = quality.featured(docs(spark, rows).repartition(parts))
        assert made.count() == len(rows)
        assert np.allclose(quality._summed(made, lambda x: x.sum(axis=0, dtype=np.float64)), expected)
    assert not quality._summed(quality.featured(docs(spark, [])), lambda x: x.sum(axis=0, dtype=np.float64)).any()


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (300, quality.FEATURES)), np.vstack([rng.normal(1, 1, (280, quality.FEATURES)), rng.normal(-1, 1, (320, quality.FEATURES))])
    scorer = quality.fit(p.astype(np.float32), u.astype(np.float32))
    assert 0.35 < scorer.prior < 0.6 and scorer(u[:280]).mean() > 0.9 and scorer(u[280:]).mean() < 0.1


TURNS = [
    (1, 0, "system", "be nice"), (1, 1, "user", "hi [INST] \\ <s>"), (1, 2, "assistant", "a</s>\\[/INST]\\\\"), (2, 0, "assistant", "first"), (3, 0, None, None),
    (3, 1, "tool</s>", "x[SEP]y"), (4, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", ""), (None, 0, "user", "n"), (5, 0, "user", "<<SYS>> <<<s>> [[INST]]"),
]


def test_chat_round_trip(spark):
    import hashlib

    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("state", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    by = defaultdict(list)
    for c, t, r, x in TURNS:
        by[c].append((t, r or "", x or ""))
    for c, rows in by.items():
        rows.sort()
        learnt = "".join(x for _, r, x in rows if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(rows), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert [c for c, r in got.items() if r.valid] == [1]
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_escapes_leave_no_control_string():
    codec, rng = chat.Codec(chat.Template()), random.Random(2)
    parts = [*codec.t.controls, "\\", "<", "[", "s>", "/", "INST]", "a"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        made = codec.escape(text)
        assert codec.unescape(made) == text and not any(c in made for c in codec.t.controls)


URLS = [
    ("https://WWW.Example.COM/de/x?q#f", "www.example.com", "/de/x", "example.com/de/", "block"), ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"), ("x://net", "net", "", None, None), ("ftp://b.org/fr/?x", "b.org", "/fr/", "org/fr/", "allow"),
    ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("h://ÀB?x", "Àb", "", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.filter_urls(pages, spark.createDataFrame([("b:",)], "key string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if host == "b:" else "allow"))


def test_parts_of_a_cascade(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = keys.where("key LIKE '%7%'")
    cascade = urls.build_cascade(listed, keys.union(keys), max_bytes=200)
    assert len(cascade.parts) > 3 and all(sum(len(bits) for bits, _, _ in p.value) <= 400 for p in cascade.parts)
    rows = keys.union(spark.createDataFrame([(None,)], "key string"))
    got = {r.key: r["in"] for r in cascade.mark(rows, "key", "in").collect()}
    assert len(got) == 3001 and all(v == ("7" in (k or "")) for k, v in got.items())


@pytest.mark.parametrize(("listed", "bits"), [(300, 1.5), (300, 4.0), (0, 4.0), (1000, 2.0)])
def test_cascade_is_exact(spark, listed, bits):
    keys = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    cascade = urls.build_cascade(keys.limit(listed), keys.union(keys), bits_per_key=bits)
    got = cascade.mark(keys, "key", "in").where("in").select("key")
    assert sorted(got.collect()) == sorted(keys.limit(listed).collect())


def test_long_lists_are_cut_into_parts(spark):
    pages = spark.createDataFrame([(1, "a://x/"), (2, "a://y/"), (3, None)], "page_id long, url string")
    listed = spark.createDataFrame([("x",), ("x",)], "key string")
    for most in (0, 1 << 20):
        got = {r.page_id: r.verdict for r in urls.filter_urls(pages, listed, rules=(), max_bytes=most).collect()}
        assert got == {1: "block", 2: "allow", 3: "allow"}


def test_mixing(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(3000)] + [(3000, None), (3001, "zero")]
    table = spark.createDataFrame(rows, "doc_id long, source string").withColumn("rate", F.lit("clash"))
    got = mixing.replicate(table, {"a": 1.0, "b": 3.0, "zero": 0.0}, default=0.001)
    n = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["b"] / n["a"] - 3) < 0.3 and "zero" not in n and "rate" in got.columns
    again = mixing.replicate(table.repartition(7), {"a": 1.0, "b": 3.0, "zero": 0.0}, default=0.001)
    key = lambda df: sorted((r.doc_id, r.copy, r.shuffle_key) for r in df.collect() if r.doc_id is not None)
    assert key(got) == key(again)
    assert mixing.replicate(table.limit(0)).count() == 0
    big = mixing.replicate(spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, source string"), total=2000).count()
    assert 1700 < big < 2300
