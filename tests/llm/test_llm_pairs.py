"""Near duplicates, repeated passages, nearest neighbours, recordings: against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from batonflow.llm import audio, jaccard, suffixes, text, vptree

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(n=200):
    rng = random.Random(0)
    return ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def near_copies(seed: int, families: int = 4, copies: int = 12):
    rng, words = random.Random(seed), vocabulary()
    rows, number = [], 0
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for k in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((number, " ".join(own).title() if k % 5 == 0 else "\n".join(own)))
            number += 1
    rows += [(number + i, t) for i, t in enumerate([None, "", " \t", "two words", "Two  WORDS", "two words more", "x " * 400, "x " * 300, "É two", "é two"])]
    return rows


def brute_components(rows):
    lower = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


@pytest.mark.parametrize(("seed", "large", "frequent", "block"), [(1, 256, 3, 1_000_000), (2, 2, 2, 300)])
def test_jaccard(spark, monkeypatch, seed, large, frequent, block):
    for name, value in (("LARGE", large), ("FREQUENT", frequent), ("BLOCK", block), ("SAMPLE", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(seed)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("set_id", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, jaccard.jaccard_components(table).collect())) == brute_components(rows)


def test_jaccard_edges(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]
    got = [tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(7, 3, 7), (7, 3, 7), (None, 3, 7), (None, 0, None)], key=str)
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_hashes_of_long_texts():
    data = np.frombuffer((b"ab " * 200_000 + b"z" * 600_000 + b" ab"), np.uint8)
    starts, ends = text.bounds(data)
    hashes = text.word_hashes(data, starts, ends)
    assert hashes[0] == hashes[-1] == hashes[150_000] and len(np.unique(hashes)) == 2
    only = np.frombuffer(b"z" * 600_000, np.uint8)
    assert text.word_hashes(only, *text.bounds(only))[0] == hashes[-2]


def brute_repeats(rows, passage):
    seen, out = set(), []
    for doc, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w, now = WORD.findall(t or ""), None
        for p in range(len(w) - passage + 1):
            key = tuple(w[p : p + passage])
            if key not in seen:
                seen.add(key)
            elif now and p <= now[1]:
                now[1] = p + passage
            else:
                now = [p, p + passage]
                out.append((doc, now))
    return sorted((d, a, z - a) for d, (a, z) in out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    rng, words = random.Random(seed), vocabulary(60)
    pool = [[rng.choice(words) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(pool))
            if rng.random() < 0.5:
                part = part[rng.randrange(len(part) // 2) :]
            parts += part + [rng.choice(words) for _ in range(rng.randint(0, 9))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "same " * 50), (103, rows[3][1]), (None, rows[4][1])]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("gram", F.lit("clash")).repartition(4)
    got = suffixes.repeated_passages(table, passage=12, gram=4).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in got) == brute_repeats(rows, 12)
    assert all(r.origin <= r.doc_id for r in got)
    cut = {r.doc_id: r.text for r in suffixes.without_repeats(table, 12, 4).collect() if r.doc_id is not None}
    for doc, t in rows:
        if doc is not None:
            gone = {w for d, a, n in brute_repeats(rows, 12) if d == doc for w in range(a, a + n)}
            assert WORD.findall(cut[doc] or "") == [w for i, w in enumerate(WORD.findall(t or "")) if i not in gone]
    assert suffixes.repeated_passages(table.limit(0)).count() == 0


def test_repeats_in_rows_of_one_id(spark):
    """Spans are of one text each: two texts of an id that repeat different passages aren't run together."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " " + " ".join(f"x{i}" for i in range(10))), (2, " ".join(f"y{i}" for i in range(5)) + " " + b)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 60, 1), (2, 5, 60, 1)]
    twice = suffixes.repeated_passages(spark.createDataFrame([(1, a), (1, a)], SCHEMA)).collect()
    assert [tuple(r) for r in twice] == [(1, 0, 60, 1)]


def shared_parts(seed: int, n: int):
    """Texts put together from parts of one pool, so that stretches of one gram are bounded differently."""
    rng, words = random.Random(seed), vocabulary(60)
    pool = [[rng.choice(words) for _ in range(rng.randint(14, 40))] for _ in range(n)]
    return [(i, " ".join([*(rng.choice(words) for _ in range(5)), *pool[i % n][rng.randrange(3) :], *(rng.choice(words) for _ in range(5))])) for i in range(2 * n)]


@pytest.mark.parametrize("records", [1, 2, 3])
def test_repeats_over_batch_borders(spark, records):
    rows = shared_parts(4, 20)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = suffixes.repeated_passages(table, passage=12, gram=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in got) == brute_repeats(rows, 12)


def in_order(v, x):
    """A plain running sum: sum() compensates its rounding."""
    total = 0.0
    for a, b in zip(v, x, strict=True):
        total += float(a) * float(b)
    return total


def brute_nearest(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    good = [(i, v) for i, v in good if len(v) == len(good[0][1])]
    out = []
    for q, v in good:
        if asked(q):
            found = sorted((-in_order(v, x), i) for i, x in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(n=300, dim=5):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) * rng.uniform(0.1, 3)]) for i in range(n)]
    same = rows[0][1]
    rows += [(n + i, same) for i in range(40)]
    return [*rows, (9000, same[:-1]), (9001, None), (9002, [0.0] * dim), (9003, [float("nan")] + [1.0] * (dim - 1)), (9004, [None] + [1.0] * (dim - 1)), (9005, [float("inf")] * dim), (None, same)]


@pytest.mark.parametrize(("shard", "block"), [(90, 7), (16_384, 2048)])
def test_nearest_is_exact(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vptree.Tree.__init__, "__defaults__", (16, 5))
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("shard", F.lit("clash"))
    got = vptree.nearest(table, table.where("vec_id % 20 = 0"), k=20, shard=shard, block=block)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, lambda i: i % 20 == 0, 20)
    if shard == 90:
        few = table.where("vec_id < 4")
        assert vptree.nearest(few, few).count() == 12
        assert vptree.nearest(table.limit(0), table).count() == 0
        assert table.where("vec_id > 9000").transform(lambda t: vptree.nearest(t, t)).count() == 0
        twice = table.where("vec_id IN (20, 40)").withColumn("vec_id", F.lit(20).cast("long"))
        assert vptree.nearest(table, twice, k=3, shard=shard).count() == 3  # one id asked with two vectors: its best three


def test_recall_of_relaxed_pruning(spark):
    rows = vectors(600, 8)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, lambda i: i % 20 == 0, 20)}
    got = {(r.query_id, r.vec_id) for r in vptree.nearest(table, table.where("vec_id % 20 = 0"), factor=1.2, shard=200).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_pruning_skips_leaves_and_shards(monkeypatch):
    monkeypatch.setattr(vptree.Tree.__init__, "__defaults__", (32, 5))
    rng = np.random.default_rng(0)
    points = rng.normal(size=(4000, 2))
    longest = float(np.sqrt((points**2).sum(1).max()))
    index = vptree.Index(np.arange(4000), points, longest, 5)
    who, found, score, seen = index.search(np.arange(20), points[:20], longest, 1.0)
    assert seen < 0.5 * 4000 * 20
    for q in range(20):
        want = sorted((-s, i) for i, s in enumerate(points @ points[q]) if i != q)[:5]
        assert [i for _, i in want] == found[who == q].tolist()
    top = vptree.Top(vptree.lift(points[:500], longest), 3)
    lifted, shard = vptree.lift(points, longest), top.shard(vptree.lift(points, longest))
    low = top.bounds(np.hstack([points[:20], np.zeros((20, 1))]))
    far = np.sqrt(((np.hstack([points[:20], np.zeros((20, 1))])[:, None] - lifted[None]) ** 2).sum(2))
    assert all(low[q, s] <= far[q, shard == s].min() + 1e-9 for q in range(20) for s in range(8) if (shard == s).any())
    assert len(np.unique(shard)) == 8 and (low > 0).any()


def test_crowds_of_nearly_equal_vectors():
    """More vectors than the margin holds lie within rounding of the k-th: all are scored exactly."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    points = np.vstack([base + rng.normal(size=(200, 16)) * 1e-16, np.tile(base, (300, 1)), rng.normal(size=(50, 16)) * 0.1])
    ids = rng.permutation(len(points))
    index = vptree.Index(ids, points, float(np.sqrt((points**2).sum(1).max())), 20)
    _, found, score, _ = index.search(np.array([-1]), base[None], float(np.sqrt((points**2).sum(1).max())), 1.0)
    exact = vptree.inner(np.tile(base, (len(points), 1)), points)
    want = sorted(zip(-exact, ids, strict=True))[:20]
    assert [i for _, i in want] == found.tolist()


def brute_alignment(a, b):
    """Every offset by plain loops: (offset, votes, overlap, error) of the best one that holds, or None."""
    found = []
    for d in range(1 - len(a), len(b)):
        at = [(int(a[i]), int(b[i + d])) for i in range(len(a)) if 0 <= i + d < len(b)]
        votes = sum(x == y for x, y in at)
        if votes >= audio.LEAST_VOTES and len(at) >= audio.LEAST_OVERLAP:
            error = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in at) / (32 * len(at))
            found.append((error, -votes, d, len(at)))
    if not found or min(found)[0] > audio.MOST_ERROR:
        return None
    error, votes, d, n = min(found)
    return d, -votes, n, error


def test_alignment(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base, other = ([rng.choice(words) for _ in range(120)] for _ in range(2))
    tune = [rng.choice(words) for _ in range(9)]
    near = [w if rng.random() > 0.02 else rng.choice(words) for w in base]
    rows = [
        (0, base), (1, ["q", "z", "y", *base[30:100], "k"]), (2, base), (3, other), (4, [rng.choice(words) for _ in range(90)]), (5, ["short", "one"]), (6, []),
        (8, ["short", "one"]), (9, near), (10, tune * 12), (11, ["x", *tune * 9]), (12, ["same"] * 150), (13, ["same"] * 90), (20, base[:27]), (21, other[50:]),
        # One id with two texts, and a text that is like the second.
        (30, [rng.choice(words) for _ in range(60)]), (30, near[10:90]), (31, near[12:]), (None, base),
    ]
    said = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(7, None)], "rec_id long, text string")
    recordings = said.select("rec_id", audio.spoken_fingerprints(F.col("text")).alias("print")).withColumn("error", F.lit("clash")).repartition(5)
    asked = {0, 3, 5, 10, 12, 20, 30}
    got = audio.align(recordings, F.col("rec_id").isin(*asked)).collect()
    prints = {" ".join(w): audio.printed(audio.spoken(" ".join(w)))[2] for _, w in rows}
    names = {t: min(i for i, w in rows if i is not None and " ".join(w) == t) for t in {" ".join(w) for i, w in rows if w and i is not None}}
    assert sorted((r.rec, r["class"]) for r in got if r.kind == "member") == sorted((i, names[" ".join(w)]) for i, w in rows if w and i is not None)
    want = set()
    for a in {" ".join(w) for i, w in rows if i in asked}:
        for b in names:
            if b != a and a and (hit := brute_alignment(prints[a], prints[b])):
                want.add((names[a], names[b], *hit[:3], round(hit[3], 9)))
    links = [(r["class"], r.found, r.offset, r.votes, r.overlap, round(r.error, 9)) for r in got if r.kind == "link"]
    assert set(links) == want and len(links) == len(want) and {(0, 1), (10, 11), (12, 13), (30, 31)} <= {x[:2] for x in want}
    assert audio.align(recordings.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_offsets_by_correlation(seed, monkeypatch):
    """Many candidate offsets and much repeated integers are counted at once; the result is that of the loops."""
    rng = np.random.default_rng(seed)
    motif = rng.integers(-(2**31), 2**31, 3, dtype=np.int64).astype(np.int32)
    a, b = (np.where(rng.random(n) < 0.05, 7, np.resize(motif, n)).astype(np.int32) for n in (700, 1900))
    got, want = audio.aligned(a, b), brute_alignment(a, b)
    assert got[:3] == want[:3] and abs(got[3] - want[3]) < 1e-12
    one = np.full(3000, 5, np.int32)
    votes = audio.histogram(one, one)
    assert votes[2999] == 3000 and votes[0] == votes[-1] == 1


def test_recordings():
    rng, words = random.Random(2), [f"w{i}" for i in range(300)]
    text = " ".join(rng.choice(words) for _ in range(5000))  # several parts
    whole = np.concatenate(list(audio.spoken(text)))
    assert (audio.printed(audio.spoken(text))[2] == audio.printed([whole])[2]).mean() > 0.999 and len(audio.printed([whole])[2]) == 5000 - 1 - 15
    clean = audio.fingerprint(audio.chroma(whole[: 256 * 400]))
    noisy = audio.fingerprint(audio.chroma(whole[: 256 * 400].astype(float) + np.random.default_rng(0).normal(0, 1500, 256 * 400)))
    assert np.bitwise_count((clean ^ noisy).view(np.uint32)).mean() / 32 < 0.1
    assert audio.printed(audio.spoken(" \n"))[:2] == (None, None) and audio.printed(audio.spoken("a"))[0] is not None


def test_media_column(spark):
    said = spark.createDataFrame([(1, "some words " * 30), (2, None), (3, "")], "rec_id long, text string")
    got = {r.rec_id: r for r in said.select("rec_id", audio.fingerprints(audio.render(F.col("text"))).alias("m"), audio.spoken_fingerprints(F.col("text")).alias("s")).collect()}
    assert got[1].m.prints == got[1].s.prints and len(got[1].m.prints) == 44 and got[2].m.one is None and got[3].s.prints == []


def test_pairs_of_a_large_family_are_counted_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    # 400 shingles that the same 250 sets share: 12 million pairs, of which 31,125 differ.
    columns = np.repeat(np.arange(400), 250), np.tile(np.arange(250), 400), np.full(100_000, 400, np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "set_id", "n"])
    tracemalloc.start()
    found = pa.Table.from_batches(jaccard._meet(75, 256)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 250 * 249 // 2 and set(found["c"].to_pylist()) == {400}
    assert peak < 100e6
