"""Vector codes, embedding near duplicates, ranked lexical search: against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from batonflow.llm import codebooks, lattice, lexical

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def families(seed: int, dim: int = 64, groups: int = 5, copies: int = 9, labels: int = 3):
    """Families of near copies about the least cosine, exact copies, and odd rows."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = rng.normal(size=dim) * [1, 1e-30, 1e30][g % 3]
        for k in range(copies):
            rows.append((base + np.abs(base).mean() * rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.17, 0.25]), int(rng.integers(labels)) if k % 4 == 0 else g % labels))
    rows += [(rng.normal(size=dim), int(rng.integers(labels))) for _ in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    odd = [None, [], [0.0] * dim, [NAN] + [1.0] * (dim - 1), [INF] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim - 1), [1.0] * (dim - 1)]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)]
    rows += [(n + 50, rows[0][1], None), (n + 51, rows[0][1], None), (None, rows[0][1], 0), (3, rows[3][1], rows[3][2]), (3, rows[40][1], rows[40][2])]
    return rows


def usable(v, dim):
    return v is not None and len(v) == dim and None not in v and all(math.isfinite(x) for x in v)


def brute_links(rows, dim, least):
    part = [i for i, (key, v, label) in enumerate(rows) if key is not None and label is not None and usable(v, dim) and any(v)]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, i in enumerate(part):
        for j in part[:p]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in part:
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (key, _, _) in enumerate(rows):
        component = min(groups[find(i)]) if i in part else key
        out.append((key, links[i], component, key == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "chunk", "small", "pairs", "batch"), [(1, 512, 48, 1 << 17, 10_000), (2, 3, 2, 7, 3), (3, 4, 48, 5, 10_000)])
def test_near_duplicates(spark, monkeypatch, seed, chunk, small, pairs, batch):
    monkeypatch.setattr(lattice, "SMALL", small)
    monkeypatch.setattr(lattice, "PAIRS", pairs)
    rows = families(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = lattice.near_duplicates(spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit("clash")).repartition(3), chunk=chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_links(rows, 64, 0.98)
    assert sum(x[1] for x in want) > 40
    assert sorted((tuple(r) for r in found), key=repr) == want


@pytest.mark.parametrize("dim", [3, 20, 100])
def test_near_duplicates_of_other_lengths(spark, dim):
    rows = families(4, dim, groups=6, copies=8, labels=2)
    rows = [(k, v, None if v is not None and len(v) != dim else label) for k, v, label in rows]
    found = lattice.near_duplicates(spark.createDataFrame(rows, VECTORS), least=0.97).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_links(rows, dim, 0.97)


def test_near_duplicates_hot(spark):
    """A third of the rows are equal and a family is crowded: counts are right and no row is made for a pair."""
    rng = np.random.default_rng(0)
    base, copy = rng.normal(size=64), rng.normal(size=64).tolist()
    rows = [(i, (base + 0.1 * rng.normal(size=64)).tolist(), 1) for i in range(300)] + [(300 + i, copy, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in lattice.near_duplicates(df, chunk=64).collect()}
    x = np.array([v for _, v, _ in rows[:300]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert [found[i].n_links for i in range(300)] == links.tolist() and links.max() > 200
    assert {(found[i].n_links, found[i].component_id) for i in range(300, 500)} == {(199, 300)}


def test_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 3
    cells = lattice.decode(x)
    own = ((x - cells) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9  # the covering radius
    beside = ((x[:, None] - cells[:, None] - lattice.NEIGHBOURS) ** 2).sum(axis=2)
    assert (own[:, None] <= beside + 1e-9).all()
    assert len({tuple(r) for r in lattice.NEIGHBOURS.tolist()}) == 240 and (lattice.decode(lattice.NEIGHBOURS) == lattice.NEIGHBOURS).all()


def brute_codes(rows, dim, parts=4, entries=256, rounds=4):
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if usable(v, dim) and max(map(abs, v)) <= codebooks.MOST]
    width = -(-dim // parts)
    cut = [[(v + [0] * (width * parts - dim))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(of[i]) for x in zip(*of[i], strict=True)] if i in of else c for i, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    of_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        of_label[label] += e
    return sorted(((k, "".join(f"{i:02x}" for _, i in c), e, of_label[label], sha) for (k, _, label), c, e in zip(kept, coded, errors, strict=True)), key=repr)


@pytest.mark.parametrize(("dim", "entries", "factor"), [(64, 256, 1.0), (64, 8, 1.0), (6, 12, 1.0), (8, 5, 20_000.0)])  # families of very large components are left out
def test_vector_codes(spark, dim, entries, factor):
    rows = families(7, dim)
    rows = [(k, v if v is None else [x if x is None else x * factor for x in v], label) for k, v, label in rows]
    rows += [(1000 + i, [1.0 * factor] * dim, i % 2) for i in range(20)] + [(2000, [1e30] * dim, 0)]
    if dim == 6:
        rows = [r for r in rows if r[1] is None or len(r[1]) != dim - 1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).withColumn("v", F.lit(2))
    found = codebooks.encode(df.repartition(3), entries=entries).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_codes(rows, dim, entries=entries)


def test_exponion_scans_less_and_finds_the_nearest():
    """On clustered points, started at the entry of the round before, few distances are computed."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (64, 16))
    points = centres[rng.integers(64, size=5000)] + rng.integers(-40, 40, (5000, 16))
    search = codebooks.Entries(centres)
    far = ((points[:, None] - centres) ** 2).sum(axis=2)
    code, error, seen = search.nearest(points, far.argmin(axis=1))
    assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all() and seen < 0.2 * far.size
    other, _, _ = search.nearest(points, rng.integers(64, size=5000))
    assert (other == code).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k=20):
    lower = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")
    held = [(key, Counter(TERM.findall(lower(t)))) for key, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for key, t in items:
        if key is not None:
            asked.setdefault(key, Counter()).update(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        found = []
        for key, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // max(total, 1)
            score = sum(times * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in terms.items() if t in c)
            if score > 0 and key is not None:
                found.append((-score, key))
        out += [(item, i + 1, key, -score) for i, (score, key) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(seed: int):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "GAMMA", "été", "x1", "日本", "the", "of", "ÉTÉ", "no-thing", "a_b", "q"]
    texts = [" ".join(rng.choice(words, p=np.arange(12, 0, -1) / 78) for _ in range(int(rng.integers(1, 40)))) for _ in range(90)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(100, None), (101, ""), (102, "?! --"), (103, texts[0]), (103, texts[0]), (104, texts[0] + "\n" + texts[1]), (None, texts[0]), (105, "the " * 30_000 + "rare"), (106, "x" * 700_000 + " tail"), (90, "édge word")]
    items = [(1, "alpha beta, gamma"), (2, "The THE of été"), (3, None), (4, "?"), (5, "nowhere"), (6, "rare tail édge word"), (7, "thing b"), (7, "Q q"), (None, "alpha"), (8, " ".join(texts[:4]))]
    return docs, items


@pytest.mark.parametrize(("seed", "shard", "most", "batch", "k"), [(1, 1 << 23, 1 << 20, 10_000, 20), (2, 200, 4, 3, 5), (3, 1, 1, 1, 1)])
def test_ranked_search(spark, seed, shard, most, batch, k):
    docs, items = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        at = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(0)).repartition(3), shard=shard)
        found = lexical.search(at, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)), k=k, most_terms=most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in found) == brute_ranks(docs, items, k)


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert lattice.near_duplicates(none).collect() == [] and codebooks.encode(none).collect() == []
    odd = spark.createDataFrame([(1, None, 1), (2, [], 1)], VECTORS)
    assert sorted(tuple(r) for r in lattice.near_duplicates(odd).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert codebooks.encode(odd).collect() == []
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.index(docs), items).collect() == []
    assert lexical.search(lexical.index(docs.union(spark.createDataFrame([(1, "a b")], docs.schema))), items.limit(0)).collect() == []
