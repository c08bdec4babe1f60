"""The lifecycle fold, batch and stream, resolution, commands and connected components."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest

from batonflow.operators import fold, graph, resolve
from batonflow.plans import commands

T0 = datetime(2026, 10, 1)
ITEM = "tenant_id long, entity_id long, type string, subject_key string, id long, arrival_seq long, stage string, authority int, person_id int, confidence double, status string, valid_from timestamp, attributes string, embedding array<float>"


def items(spark, rows):
    made = [(1, 1, "requirement", "a:sso", i, i, stage, auth, who, conf, "active", T0 + timedelta(days=d), json.dumps(slots), vec) for i, stage, auth, who, conf, d, slots, vec in rows]
    return spark.createDataFrame(made, ITEM)


def run(spark, rows):
    events = fold.fold(items(spark, rows)).collect()
    relations = sorted((r.what, r.id, r.other_id, r.resolved, r.created_by) for r in events if r.kind == "relation")
    last = {}
    for r in events:
        if r.kind == "version":
            last[r.id] = max(last.get(r.id, (0, "")), (r.version, r.what))
    return {i: s for i, (_, s) in last.items()}, relations


def brute_fold(rows, same=0.92, near=0.80):
    """The rules, one arrival after the other against each active sibling: (events, active ids)."""
    active, out = [], []
    for r in rows:
        new = dict(r)
        for old in list(active):
            if fold.slots_compatible(new["attributes"], old["attributes"]):
                out += fold._alike(new, old, same, near)
            else:
                out += fold._replaced(new, old)
        out.append(("version", new["id"], None, new["status"], 1, None, "created", None))
        active = [o for o in active if o["status"] == "active"] + ([new] if new["status"] == "active" else [])
    return sorted(map(repr, out)), sorted(o["id"] for o in active)


def random_rows(seed: int, n: int):
    """Statements that mostly fit, so that many stay active, in families of embeddings."""
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = []
    for i in range(n):
        slots = {k: rng.choice([None, 1, 1, 1, 1, 1, 1, 2]) for k in "abc" if rng.random() < 0.5}
        slots |= {"stance": rng.choice(["required", "deferred"])} if rng.random() < 0.05 else {}
        slots |= {"extra": {"corrects": True}} if rng.random() < 0.1 else {}
        vec = None if rng.random() < 0.1 else [x + rng.gauss(0, 0.4) for x in rng.choice(base)]
        out.append((i, rng.choice(["sales", "product"]), rng.randint(2, 4), rng.choice([None, 1, 2]), rng.choice([0.5, 0.9]), rng.randint(0, n), slots, vec))
    return out


def plain_rows(df):
    rows = sorted(df.collect(), key=lambda r: (r.arrival_seq, r.id))
    return [{"id": r.id, "authority": r.authority, "stage": r.stage, "person_id": r.person_id, "confidence": r.confidence, "status": r.status, "valid_from": r.valid_from, "attributes": json.loads(r.attributes), "embedding": r.embedding, "version": 1} for r in rows]


@pytest.mark.parametrize(("seed", "block", "batch"), [(1, 256, 10_000), (2, 1, 7), (3, 5, 3)])
def test_fold_in_blocks(spark, monkeypatch, seed, block, batch):
    monkeypatch.setattr(fold, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = items(spark, random_rows(seed, 120))
        found = sorted(repr((r.kind, r.id, r.other_id, r.what, r.version, r.resolved, r.created_by, r.confidence)) for r in fold.fold(df.repartition(3)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, active = brute_fold(plain_rows(df))
    assert found == want and len(active) > 3


@pytest.mark.parametrize(("block", "chunk"), [(256, 2_000), (4, 3)])
def test_stream_state_is_read_in_chunks(spark, tmp_path, monkeypatch, block, chunk):
    """Three micro-batches of one key, each in several frames: the same events as the fold of a table."""
    from batonflow.streaming import jobs

    monkeypatch.setattr(fold, "BLOCK", block)
    monkeypatch.setattr(jobs, "STATE_CHUNK", chunk)
    rows = random_rows(7, 90)
    for i in range(3):
        items(spark, rows[30 * i : 30 * i + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = items(spark, rows)
    stream = jobs.fold_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    jobs.collect_parts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    found = sorted(repr((r.kind, r.id, r.other_id, r.what, r.version, r.resolved, r.created_by, r.confidence)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == brute_fold(plain_rows(df))[0]
    # A restart from the checkpoint folds on: a row that contradicts all that is active ends that.
    items(spark, [(1000, "product", 4, 9, 0.9, 200, {"a": 3, "b": 3, "c": 3}, None)]).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.collect_parts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    found = sorted(repr((r.kind, r.id, r.other_id, r.what, r.version, r.resolved, r.created_by, r.confidence)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == brute_fold(plain_rows(items(spark, [*rows, (1000, "product", 4, 9, 0.9, 200, {"a": 3, "b": 3, "c": 3}, None)])))[0]


def test_late_lineage(spark, tmp_path):
    """Whatever comes first: the edges of a stream are those of a table; with a reach, those within it."""
    from pyspark.sql import functions as F

    from batonflow.operators import lineage
    from batonflow.streaming import jobs

    rng = random.Random(11)
    rows = [(i, 1, rng.randint(1, 2), "a:sso", rng.choice(["sales", "product", "engineering", "customer_success", "leadership", None]), T0 + timedelta(hours=rng.randint(0, 300))) for i in range(80)]
    rows += [(100, 1, 1, "a:sso", "sales", T0 - timedelta(days=1)), (101, None, 1, "a:sso", "sales", T0), (102, None, 1, "a:sso", "product", T0 + timedelta(1))]
    rng.shuffle(rows)
    schema = "id long, tenant_id long, entity_id long, subject_key string, stage string, valid_from timestamp"
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df, read = spark.createDataFrame(rows, schema), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    want = sorted(map(tuple, lineage.edges(df).collect()))
    for name, reach in (("all", None), ("near", "72 hours")):
        jobs.collect_parts(jobs.lineage_stream(read.parquet(str(tmp_path / "in")), reach, "30 days" if reach else None), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        found = sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))
        if reach:
            at = {r[0]: r[5] for r in rows}
            want = [e for e in want if at[e[1]] >= at[e[0]] - timedelta(hours=72)]
        assert found == want and len(want) > 50
    assert spark.read.parquet(str(tmp_path / "all")).where(F.col("to_id") == 100).count() > 0


def test_chain_of_corrections(spark):
    rows = [(1, "product", 3, 7, 0.9, 0, {"stance": "required"}, None), (2, "product", 3, 7, 0.9, 3, {"stance": "deferred"}, None), (3, "product", 3, 7, 0.9, 12, {"stance": "required"}, None)]
    states, relations = run(spark, rows)
    assert states == {1: "superseded", 2: "superseded", 3: "active"}
    assert [r[:3] for r in relations] == [("supersedes", 2, 1), ("supersedes", 3, 2)]


@pytest.mark.parametrize(("rows", "rule"), [
    ([(1, "product", 3, 1, 0.9, 0, {"stance": "deferred"}, None), (2, "product", 3, 2, 0.9, 1, {"stance": "required"}, None)], "R4"),
    ([(1, "product", 4, 1, 0.9, 0, {"stance": "deferred"}, None), (2, "engineering", 4, 1, 0.9, 2, {"stance": "in_progress"}, None)], "R1"),
    ([(1, "sales", 4, 1, 0.9, 0, {"quantity": 500}, None), (2, "sales", 2, 1, 0.9, 1, {"quantity": 50}, None)], "R2"),
])
def test_conflicts(spark, rows, rule):
    states, relations = run(spark, rows)
    assert states == {1: "conflicting", 2: "conflicting"}
    assert relations == [("contradicts", 2, 1, False, f"system:lifecycle:{rule}")]


def test_third_statement_sees_no_sibling(spark):
    rows = [(1, "sales", 4, 1, 0.9, 0, {"q": 1}, None), (2, "sales", 2, 2, 0.9, 1, {"q": 2}, None), (3, "sales", 2, 3, 0.9, 2, {"q": 3}, None)]
    assert run(spark, rows)[0] == {1: "conflicting", 2: "conflicting", 3: "active"}


def test_duplicates(spark):
    near = run(spark, [(1, "product", 3, 1, 0.9, 0, {}, [1.0, 0.0]), (2, "product", 4, 1, 0.9, 1, {}, [0.99, 0.01])])
    assert near[0] == {1: "active", 2: "active"}
    assert near[1] == [("duplicate_of", 1, 2, True, "system:dedup"), ("supported_by", 2, 1, True, "system:dedup")]
    band = run(spark, [(1, "product", 3, 1, 0.9, 0, {}, [1.0, 1.0, 0.0]), (2, "product", 3, 1, 0.9, 1, {}, [1.0, 0.3, 0.0])])
    assert band[1] == [("duplicate_of", 2, 1, False, "system:dedup")]


def test_slots_compatible():
    ok = fold.slots_compatible
    assert ok({"rationale": "a"}, {"rationale": "b"}) and ok({"quantity_unit": "Users"}, {"quantity_unit": "users per org"})
    assert not ok({"list": [1, 2]}, {"list": [2, 1]}) and not ok({"extra": {"x": 1}}, {"extra": {"x": 2}}) and ok({"extra": {"corrects": 1}}, {"extra": {"corrects": 2}})
    q = lambda d, p: {"due_date": d, "due_date_precision": p}
    assert ok(q("2026-10-01", "quarter"), q("2026-12-31", "quarter")) and not ok(q("2026-10-01", "day"), q("2026-10-02", "day")) and not ok(q("2026-10-01", "month"), q("2026-10-02", "quarter"))


def test_stream_folds_as_batch(spark, tmp_path):
    from batonflow.streaming import jobs

    rng = random.Random(3)
    rows = [(i, rng.choice(["sales", "product"]), rng.randint(2, 4), rng.randint(1, 2), 0.9, i, {"stance": rng.choice(["required", "deferred", "done"])}, None) for i in range(30)]
    df = items(spark, rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.fold_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = fold.states(jobs.drain(spark, stream, "folded"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold.states(fold.fold(df)).collect()))


def test_job_states(spark, tmp_path):
    from batonflow.streaming import jobs

    ev = [(1, 1, "claim", 0.0, None), (1, 2, "fail", 1.0, None), (1, 3, "claim", 2.0, None), (1, 4, "claim", 3.5, None), (1, 5, "fail", 4.0, 30.0), (1, 6, "claim", 40.0, None), (1, 7, "fail", 41.0, None), (2, 1, "claim", 0.0, None), (2, 2, "ack", 1.0, None)]
    df = spark.createDataFrame(ev, "job_id long, seq int, event string, at double, retry_after double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.drain(spark, jobs.job_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "jobs", "update")
    assert sorted((r.job_id, r.status, r.attempts) for r in out.collect()) == [(1, "poison", 3), (2, "done", 1)]


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stream_folds_frames_in_order(spark, tmp_path, small_batches):
    from batonflow.streaming import jobs

    rng = random.Random(5)
    rows = [(i, rng.choice(["sales", "product"]), rng.randint(2, 4), rng.randint(1, 2), 0.9, i, {"stance": rng.choice(["required", "deferred", "done"])}, None) for i in range(40)]
    want = sorted(map(tuple, fold.states(fold.fold(items(spark, rows))).collect()))
    rng.shuffle(rows)
    df = items(spark, rows)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.fold_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, fold.states(jobs.drain(spark, stream, "folded_frames")).collect())) == want


def test_job_states_over_frames(spark, tmp_path, small_batches):
    from batonflow.streaming import jobs

    ev = [(j, n, e, float(n), None) for j in (1, 2) for n, e in enumerate(["claim", "reclaim", "claim", "reclaim", "claim", "ack"][: 6 - j + 1])]
    df = spark.createDataFrame(ev[::-1], "job_id long, seq int, event string, at double, retry_after double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.drain(spark, jobs.job_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "jobs_frames", "update")
    assert sorted((r.job_id, r.status, r.attempts) for r in out.collect()) == [(1, "done", 3), (2, "running", 3)]


def test_resolution_order(spark):
    hints = spark.createDataFrame([(1, "Acme Corp", 1), (1, "Acme Global Holdings", 2), (1, "acme global holding", 3), (1, None, 4), (1, "Quantum Dynamic", 5)], "tenant_id long, hint string, arrival_seq long")
    known = spark.createDataFrame([(1, "acme", "acme"), (1, "quantum dynamics", "quantum")], "tenant_id long, name string, entity string")
    got = {r.hint: (r.entity, r.how, r.near) for r in resolve.resolve_entities(hints, known).collect()}
    assert got["Acme Corp"] == ("acme", "exact", None)
    assert got["acme global holding"] == ("acme-global-holdings", "linked", None)
    assert got["Quantum Dynamic"] == ("quantum-dynamic", "new", "quantum")
    assert got["Unknown"] == ("unknown", "new", None)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in parent)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_resolving_conflicts(spark):
    objects = spark.createDataFrame([(1, "conflicting", 2), (2, "conflicting", 2), (3, "active", 1)], "id long, status string, version int")
    relations = spark.createDataFrame([(2, 1, "contradicts", None), (3, 1, "supersedes", None)], "from_id long, to_id long, relation string, resolved_at timestamp")
    after, edges = commands.resolve_conflicts(objects, relations, spark.createDataFrame([(2, 1, 2)], "from_id long, to_id long, winner long"))
    assert sorted(map(tuple, after.select("id", "status", "version").collect())) == [(1, "superseded", 3), (2, "active", 3), (3, "active", 1)]
    assert sorted((r.from_id, r.to_id, r.relation, r.resolved_at is not None) for r in edges.collect()) == [(2, 1, "contradicts", True), (2, 1, "supersedes", True), (3, 1, "supersedes", False)]
