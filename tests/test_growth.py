"""What grows with arrivals or is gone through in blocks: vocabulary, load order, vectors, sweep, live messages, cached extraction."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from batonflow import fixed
from batonflow.operators import similar, vocabulary
from batonflow.plans import commands, evals, reads
from batonflow.sources import cache, messages, order
from batonflow.streaming import jobs

NOW = datetime(2026, 10, 1)


def trigrams(word):
    return {f"  {w} "[i : i + 3] for w in re.split("[^a-z0-9]+", word) if w for i in range(len(w) + 1)}


def similarity(a, b):
    x, y = trigrams(a), trigrams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def brute_vocabulary(proposals, rows):
    """One proposal after the other, as they come."""
    rows = [[slug, list(synonyms or []), status, near] for slug, synonyms, status, near in rows]
    out = []
    for seq, proposed in sorted(p for p in proposals if p[1] is not None):
        word = re.sub("[^a-z0-9]+", "_", proposed.lower()).strip("_") or "capability"
        known = {}
        for r in rows:
            if r[2] == "confirmed":
                for w in [r[0], *r[1]]:
                    known[w] = min(r[0], known.get(w, r[0]))
        if word in known:
            out.append((seq, proposed, known[word], "exact", None))
            continue
        best = min(((-similarity(w, word), w) for w in known), default=(0, None))
        if -best[0] >= 0.85:
            slug = known[best[1]]
            next(r for r in rows if r[0] == slug)[1].append(word)
            out.append((seq, proposed, slug, "linked", None))
        else:
            near = known[best[1]] if -best[0] >= 0.6 else None
            if all(r[0] != word for r in rows):
                rows.append([word, [], "candidate", near])
            out.append((seq, proposed, word, "candidate", near))
    return out, sorted((a, tuple(b), c, d or "") for a, b, c, d in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_vocabulary_grows_in_order(spark, seed):
    """Words that drift away by a letter at a time, in any order: what is known when decides."""
    rng = random.Random(seed)
    stems = ["audit log retention", "data residency region", "uptime service level", "customer onboarding checklist"]
    drift = lambda s: s + rng.choice(["", "s", "ss", "sss", " x", "-s", "!", " v2", " v22"])
    proposals = [(i, drift(rng.choice(stems))) for i in range(80)] + [(90, None), (91, "?"), (92, "?"), (93, "Audit-Log Retention")]
    rng.shuffle(stems)
    rows = [("audit_log_retention", ["audit_logs"], "confirmed", None), ("uptime_service_levelss", None, "confirmed", None), ("data_residency_region", [], "candidate", "old"), ("sso", [], "confirmed", None)]
    said = spark.createDataFrame(proposals, "seq long, proposed string").repartition(3)
    grown = spark.createDataFrame(rows, "slug string, synonyms array<string>, status string, suggested string")
    found, after = vocabulary.resolve_in_order(said, grown)
    want, state = brute_vocabulary(proposals, rows)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted((r.slug, tuple(r.synonyms or ()), r.status, r.suggested or "") for r in after.collect()) == state
    assert len({h for *_, h, _ in want}) == 3


def test_vocabulary_edges(spark):
    start = vocabulary.confirmed(spark)
    assert sorted(r.slug for r in start.collect()) == sorted(fixed.CAPABILITIES)
    none = spark.createDataFrame([], "seq long, proposed string")
    found, after = vocabulary.resolve_in_order(none, start)
    assert found.count() == 0 and after.count() == 12
    found, after = vocabulary.resolve_in_order(spark.createDataFrame([(1, "SSO"), (2, "something else")], none.schema), start.limit(0))
    assert sorted((r.seq, r.how) for r in found.collect()) == [(1, "candidate"), (2, "candidate")] and after.count() == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_have_no_gaps(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(5)]), rng.randint(0, 3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, n long, v long").repartition(parts)
    found = order.numbered(df, ["k", "n"], "at").collect()
    assert sorted(r["at"] for r in found) == list(range(1, 501))
    key = lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in (r.k, r.n, r.v))
    ranked = [key(r) for r in sorted(found, key=lambda r: r["at"])]
    assert ranked == sorted(ranked)
    assert order.numbered(df.limit(0), ["k"]).count() == 0


def test_load_over_connectors(spark):
    rows = [(1, "slack", "c:1", "hello", NOW, None, ["*"]), (1, "drive", "a.md#1", "text", NOW, "sales", ["*"]), (1, "drive", "a.md#0", "text", NOW, "sales", ["*"]), (1, "email", "m1", None, NOW, None, ["*"]), (1, "email", "m1", None, NOW, None, ["*"]), (1, "call", "k1", "said", NOW, "sales", ["*"]), (1, "fax", "f", "x", NOW, None, ["*"])]
    df = spark.createDataFrame(rows, "tenant_id long, kind string, external_id string, text string, source_ts timestamp, stage string, acl array<string>")
    rejected = spark.createDataFrame([("call", "k2")], "kind string, external_id string")
    found, counts = order.load(df, rejected)
    assert [(r.kind, r.external_id, r.was_new) for r in found.orderBy("arrival_seq").collect()] == [("drive", "a.md#0", True), ("drive", "a.md#1", True), ("call", "k1", True), ("email", "m1", True), ("email", "m1", False), ("slack", "c:1", True), ("fax", "f", True)]
    assert sorted(tuple(r) for r in counts.collect()) == [("call", 1, 0, 1, 1), ("drive", 2, 0, 0, 2), ("email", 1, 1, 0, 1), ("fax", 1, 0, 0, 1), ("slack", 1, 0, 0, 1)]
    again, counts = order.load(df, None, found)
    assert again.where("was_new").count() == 0 and counts.agg(F.sum("created"), F.sum("skipped")).first()[:] == (0, 7)


def vectors(seed: int, n: int = 70):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(3)), i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(n)]
    return rows + [(0, n, None), (0, n + 1, [0.0] * 4), (0, n + 2, [1.0]), (None, n + 3, [1.0] * 4), (1, n + 4, [None, 1.0, 1.0, 1.0])]


def cos(a, b):
    fit = lambda v: np.array(v) if v is not None and len(v) == 4 and None not in v else np.zeros(4)
    x, y = fit(a), fit(b)
    norm = np.sqrt(x @ x) * np.sqrt(y @ y)
    return float(x @ y / norm) if norm else 0.0


@pytest.mark.parametrize(("seed", "pack"), [(1, 1024), (2, 8)])
def test_top_similar_and_pairs(spark, seed, pack):
    """Small integers give many ties; packs of eight make every block several."""
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "block long, id long, vector array<double>")
    found = sorted(tuple(r)[:3] for r in similar.top_similar(df.where("id % 3 = 0"), df, 4, pack).collect())
    want = []
    for b, i, v in rows:
        if b is not None and i % 3 == 0:
            near = sorted((-round(cos(v, w), 9), j) for c, j, w in rows if c == b and j != i)[:4]
            want += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert found == sorted(want)
    pairs = {(r.a_id, r.b_id) for r in similar.similar_vectors(df, 0.7, pack).collect()}
    assert pairs == {(i, j) for b, i, v in rows for c, j, w in rows if b == c and b is not None and i < j and cos(v, w) >= 0.7}
    assert similar.top_similar(df.limit(0), df.limit(0)).count() == 0


def brute_sweep(objects, relations, hold):
    status, version, rank = ({i: x[k] for i, *x in objects} for k in range(3))
    rel = {(a, z, kind): [by, at] for a, z, kind, by, at, *_ in relations}
    false = [(a, z, c) for a, z, kind, by, at, ok, c in relations if kind == "contradicts" and at is None and ok and (by or "").startswith("system:lifecycle:") and a in rank and z in rank]
    for a, z, _ in false:
        rel[(a, z, "contradicts")][1] = NOW
    open_ = {i for (a, z, kind), (_, at) in rel.items() if kind == "contradicts" and at is None for i in (a, z)}
    for i in {i for a, z, _ in false for i in (a, z)}:
        if status[i] == "conflicting" and not (hold and i in open_):
            status[i], version[i] = "active", version[i] + 1
    for a, z, c in false:
        canon, copy = (a, z) if rank[a] >= rank[z] else (z, a)
        new = [((copy, canon, "duplicate_of"), NOW), ((canon, copy, "supported_by"), NOW)] if c >= 0.92 else [((a, z, "duplicate_of"), None)] if c >= 0.8 else []
        for key, at in new:
            rel.setdefault(key, ["system:dedup", at])
    return sorted((i, status[i], version[i]) for i in status), sorted((*k, by or "", at is not None) for k, (by, at) in rel.items())


@pytest.mark.parametrize(("seed", "hold"), [(1, True), (1, False), (2, True)])
def test_sweep(spark, seed, hold):
    rng = random.Random(seed)
    objects = [(i, rng.choice(["conflicting", "conflicting", "superseded"]), rng.randint(1, 3), rng.randint(0, 4)) for i in range(30)]
    pairs = {(rng.randrange(32), rng.randrange(32)) for _ in range(60)}
    relations = [(a, z, "contradicts", rng.choice(["system:lifecycle:R1", "system:lifecycle:R4", "human", None]), rng.choice([None, None, None, datetime(2026, 1, 1)]), rng.choice([True, True, False, None]), rng.choice([0.5, 0.85, 0.92, 0.99])) for a, z in sorted(pairs) if a > z]
    relations += [(a, z, "duplicate_of", "system:dedup", None, None, None) for a, z, *_ in relations[:6]]
    o = spark.createDataFrame(objects, "id long, status string, version int, authority int")
    r = spark.createDataFrame(relations, "from_id long, to_id long, relation string, created_by string, resolved_at timestamp, compatible boolean, cosine double")
    found = commands.sweep(o, r, NOW, hold)
    want_objects, want_relations = brute_sweep(objects, relations, hold)
    assert sorted((x.id, x.status, x.version) for x in found["objects"].collect()) == want_objects
    assert sorted((x.from_id, x.to_id, x.relation, x.created_by or "", x.resolved_at is not None) for x in found["relations"].collect()) == want_relations
    was = {i: s for i, s, *_ in objects}
    assert sorted((x.id, x.version, x.status) for x in found["versions"].collect()) == sorted((i, v, s) for i, s, v in want_objects if was[i] != s)


def test_live_messages_once_over_a_restart(spark, tmp_path):
    def event(i, **more):
        return {"event_id": f"Ev{i}", "type": "message", "channel": "C1", "is_private": False, "ts": f"170000000{i}.5", "user": "U1", "text": f" text {i} "} | more

    def drop(name, events):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{name}.json").write_text("\n".join(map(json.dumps, events)))

    def run():
        stream = messages.ingest_live(messages.live_sources(messages.event_files(spark, str(tmp_path / "in")), {"C1": "sales"}, members))
        jobs.collect_parts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted((r.external_id, r.text, r.stage or "", r.acl) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())

    members = spark.createDataFrame([("C2", ["U1", "U2"])], "channel_id string, members array<string>")
    drop("a", [event(1), event(2, text="  <@BOT>: mark this"), event(3, bot_id="B"), event(4, subtype="channel_join"), event(5, text=" \n"), event(6, text=None), event(7, event_id=None), event(8, type="app_mention"), event(1)])
    want = [("C1:1700000007.5", "text 7", "sales", ["*"]), ("Ev1", "text 1", "sales", ["*"])]
    assert run() == want
    drop("b", [event(1), event(1, type="shortcut", text="<@BOT> saved"), event(9, channel="C2", is_private=True), event(10, channel="C3", is_private=True, ts="1700000010.1")])
    want += [("Ev10", "text 10", "", []), ("Ev9", "text 9", "", ["U1", "U2"]), ("shortcut:C1:1700000001.5", "<@BOT> saved", "sales", ["*"])]
    assert run() == sorted(want) and run() == sorted(want)


def test_extraction_through_a_cache(spark, tmp_path):
    asked = []

    def extract(rows):
        asked.append(rows.count())
        return rows.select("key", F.when(F.col("text") != "dumb", F.concat(F.upper("text"), F.lit("/"), "context_key")).alias("result"))

    schema = "id long, text string, context_key string"
    one = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x"), (4, "dumb", None), (5, None, None)], schema)
    found, fresh = cache.cached_extract(one, None, extract, "v1", "m", "s")
    assert sorted((r.id, r.hit, r.result) for r in found.collect()) == [(1, False, "A/"), (2, False, "A/"), (3, False, "A/x"), (4, False, None), (5, False, None)]
    fresh.write.parquet(str(tmp_path / "cache"))
    known = spark.read.parquet(str(tmp_path / "cache"))
    two = spark.createDataFrame([(1, "a", None), (6, "b", None), (4, "dumb", None)], schema)
    found, fresh = cache.cached_extract(two, known, extract, "v1", "m", "s")
    assert sorted((r.id, r.hit, r.result) for r in found.collect()) == [(1, True, "A/"), (4, False, None), (6, False, "B/")]
    assert asked[0] == 4 and asked[1] == 2 and fresh.count() == 1
    # Another version of the prompt is another key.
    assert cache.cached_extract(two, known, extract, "v2", "m", "s")[0].where("hit").count() == 0


def test_probes_and_wins(spark):
    probes = spark.createDataFrame([(1, "f", "problem", "sso"), (2, "f", "decision", "sso"), (3, "f", "problem", "none"), (4, "g", "problem", "sso")], "probe_id long, fixture string, type string, capability string")
    items = spark.createDataFrame([("f", 7, "requirement", "sso"), ("f", 8, "problem", "sso"), ("f", 9, "problem", "sso"), ("g", 1, None, "sso")], "fixture string, item_id long, type string, capability string")
    matched = evals.match_probes(probes, items)
    assert sorted(map(tuple, matched.collect()), key=str) == [(1, 8), (2, 7), (3, None), (4, 1)]
    expected = spark.createDataFrame([(1, "a", "<non-null>"), (1, "b", "2"), (2, "a", "1"), (3, "a", "1")], "probe_id long, slot string, want string")
    slots = spark.createDataFrame([(8, "a", "x"), (8, "b", "3"), (7, "a", "1")], "id long, slot string, value string")
    assert sorted(tuple(r) for r in evals.score_probes(matched, expected, slots).select("probe_id", "hits", "total").collect()) == [(1, 1, 2), (2, 1, 1), (3, 0, 1), (4, 0, 0)]
    rows = lambda *x: evals.gap_scores(spark.createDataFrame(list(x), "gold string, predicted string"))
    better = evals.wins(rows(("missing", "missing"), ("contradicted", "missing")), rows(("missing", "contradicted"), ("contradicted", None))).first()
    assert better.engine_wins and (better.engine_precision, better.engine_recall) == (0.5, 0.5)
    assert not evals.wins(rows(("missing", None)), rows(("missing", "missing"))).first().engine_wins
    assert rows(("missing", "missing")).count() == 2  # the outcome and the total; others have nothing to count


def test_corrections_and_scope(spark):
    rows = [(1, True, None, None), (2, False, "the old one", {"a": "b", "corrects": "x"}), (3, None, "", {"corrects": "kept"}), (4, None, None, None)]
    found = {r.id: r.extra for r in reads.with_corrections(spark.createDataFrame(rows, "id long, corrects boolean, corrects_hint string, extra map<string,string>")).collect()}
    assert found == {1: {"corrects": "true"}, 2: {"a": "b", "corrects": "false", "corrects_hint": "the old one"}, 3: {"corrects": "kept"}, 4: None}
    o = spark.createDataFrame([(1, 1, "sales"), (2, 1, "product"), (3, 2, "sales"), (4, 1, None)], "id long, tenant_id long, stage string")
    assert sorted(r.id for r in reads.scoped(o, 1).collect()) == [1, 2, 4] and [r.id for r in reads.scoped(o, 1, "sales").collect()] == [1]
