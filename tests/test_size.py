"""What a task holds doesn't grow with the tables: plans and files that are looked at, with results checked beside them."""

from __future__ import annotations

import os
from glob import glob

import pyarrow.parquet as pq
import pytest

from batonflow.operators import similar
from batonflow.plans import evals, reads


SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_staged_shards_are_row_groups_of_their_own(spark):
    from batonflow.llm import lexical

    texts = [(i, " ".join(f"word{(i * 37 + j) % 997}" for j in range(200))) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    made = lexical.index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), shard=1 << 12)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = [pq.ParquetFile(f).metadata for path in made.shards.inputFiles() for f in glob(path.removeprefix("file://"))]
    assert sum(g.num_rows for g in groups) > 1
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 2
    found = lexical.search(made, spark.createDataFrame([(1, "word5 word6")], "item_id long, text string")).count()
    assert found == 20


def test_slot_fill_tells_no_ids_apart_by_slot(spark):
    objects = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "a")], "id long, type string")
    slots = spark.createDataFrame([(1, "x", "1"), (1, "x", "2"), (1, "y", ""), (2, "x", "1"), (3, "y", "z"), (9, "x", "1")], "id long, slot string, value string")
    found = evals.slot_fill(objects, slots)
    assert sorted(map(tuple, found.collect())) == [("a", "x", 4, 2), ("a", "y", 4, 1), ("b", "y", 1, 1)]
    assert "distinct" not in plan(found)


def test_incident_gaps_tell_only_shared_gaps_apart(spark):
    accounts = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 10), (3, None)], "incident_id long, entity_id long")
    runs = spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, None)], "validation_id long, entity_id long")
    rows = [(7, 100, "open"), (7, 101, "open"), (8, 100, "open"), (8, 100, "open"), (9, 101, "resolved"), (5, 102, "open"), (6, 103, "open")]
    found = reads.incident_gaps(accounts, runs, spark.createDataFrame(rows, "gap_id long, validation_id long, status string"))
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    assert plan(found).startswith("Union")


def test_packs_are_handed_on_a_few_at_a_time(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.createDataFrame([(1, i, [1.0, float(i % 5)]) for i in range(40)], "block int, id long, vector array<float>")
    assert similar.similar_vectors(rows, 0.9999999, pack=3).count() == 5 * 8 * 7 // 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == similar.BATCH


def test_rows_without_a_key_are_dealt_out(spark):
    from batonflow.plans import handoff

    rows = spark.range(400).selectExpr("id", "CASE WHEN id = 7 THEN 1 END AS stale_id")
    found = handoff.join_known(rows, spark.createDataFrame([(1, "old")], "stale_id long, content string"), "stale_id")
    assert sorted((r.id, r.content) for r in found.collect() if r.content or r.id == 8) == [(7, "old"), (8, None)]
    assert "_spread" in plan(found)


def test_a_single_frame_needs_no_file(monkeypatch):
    import pandas as pd

    from batonflow.streaming import jobs

    monkeypatch.setattr(jobs.tempfile, "TemporaryFile", lambda: 1 / 0)
    assert [r.at for r in jobs._in_order([pd.DataFrame({"at": [3, 1, 2]})], ["at"])] == [1, 2, 3]


def test_few_statements_meet_as_many_do(monkeypatch):
    from batonflow.operators import fold

    rows = [{"id": i, "text": f'{{"plan": "{i % 3}"}}', "attributes": {"plan": str(i % 3)}, "embedding": [[1.0, i * 0.4], None, [0.0, 0.0], [1.0]][i % 4]} for i in range(4)]
    few = fold._compatible(rows, rows).tolist(), fold._close(rows, rows, 0.8).tolist()
    monkeypatch.setattr(fold, "FEW", 0)
    assert few == (fold._compatible(rows, rows).tolist(), fold._close(rows, rows, 0.8).tolist())


def test_slots_of_a_root_walk_together(spark, monkeypatch):
    from batonflow.operators import lineage

    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "from_id long, to_id long")
    slots = spark.createDataFrame([(1, "a", ""), (2, "b", "2"), (3, "b", "3"), (4, "a", "4"), (4, "b", "x"), (4, "c", "5")], "id long, slot string, value string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "d"), (1, None), (9, "a")], "root long, slot string")
    want = [(1, "a", "4", 4, 2), (1, "b", "2", 2, 1)]
    assert sorted(map(tuple, lineage.nearest_values(edges, slots, asked).collect())) == want
    monkeypatch.setattr(lineage, "TOGETHER", 1)
    assert sorted(map(tuple, lineage.nearest_values(edges, slots, asked).collect())) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["q_stale_reference", "q_slots_compatible", "q_probe_match", "q_nearest_ancestor_value"])
def test_what_grows_is_not_broadcast(spark, name):
    """However small the files are: their size says little of the rows that are made of them."""
    from batonflow.queries import QUERIES

    planned = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in planned
    assert "BroadcastHashJoin" not in planned


def test_nearest_values_read_slots_as_one_row(spark):
    from batonflow.operators import lineage

    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "from_id long, to_id long")
    wide = spark.createDataFrame([(1, ("", None, None)), (2, (None, "2", None)), (3, (None, "3", "{}")), (4, ("4", "x", None)), (5, None)], "id long, values struct<a: string, b: string, c: string>")
    long = wide.selectExpr("id", "inline(array(struct('a' AS slot, values.a AS value), struct('b' AS slot, values.b AS value), struct('c' AS slot, values.c AS value)))")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "d"), (9, "a")], "root long, slot string")
    for of in (None, asked):
        found = [lineage.nearest_values(edges, slots, of) for slots in (wide, long)]
        assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) != []
        assert all("BroadcastHashJoin" not in f._jdf.queryExecution().sparkPlan().toString() for f in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_no_file_size_decides_on_broadcasts_in_validation(spark, monkeypatch):
    """Of all that two runs stage, and of their changes: the same joins broadcast whether Spark may go by the size of files or not."""
    from batonflow import queries
    from batonflow.operators import lineage
    from batonflow.plans import handoff, history

    seen = {}

    def looked(df, name, group=None):
        counts = []
        for most in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            counts.append(df.select("*")._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin"))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        seen.setdefault(name, set()).add(tuple(counts))
        return stage(df, name, group)

    stage = handoff.stage
    for module in (queries, lineage, handoff, history):
        monkeypatch.setattr(module, "stage", looked)
    looked(queries.q_gap_changes(spark, SF), "changes")
    assert {"pairs", "facts", "steps", "level", "moved", "open-lineage", "gaps", "runs", "changes"} <= set(seen)
    assert {name: counts for name, counts in seen.items() if any(a != b for a, b in counts)} == {}


@pytest.mark.parametrize(("block", "chunk", "rows"), [(256, 2_000, 500), (4, 3, 500), (3, 1, 7)])
def test_subjects_share_calls_and_state(monkeypatch, block, chunk, rows):
    """Two micro-batches of forty subjects in one call each, in frames of any size: the events of subjects that are folded alone, and one entry of state a part where it has room."""
    import json
    import random

    import pandas as pd

    from batonflow.operators import fold
    from batonflow.streaming import jobs

    class Kept(dict):
        getValue, containsKey, removeKey = dict.get, dict.__contains__, dict.pop

        def updateValue(self, key, value):
            self[key] = value

    class Handle:
        def getMapState(self, *_):
            return Kept()

    rng = random.Random(11)
    made = [(1, s // 9, "decision", None if s % 13 == 5 else f"s{s}", s % 3, i, i, rng.choice(["sales", "product"]), rng.randint(1, 3), rng.choice([1, 2, None]), 0.9, rng.choice(["active", "active", "candidate"]), pd.Timestamp("2026-01-01") + pd.Timedelta(rng.randint(0, 99), "h"), json.dumps({"plan": rng.choice("aab")}), rng.choice([None, [1.0, 0.5 * (i % 3)]])) for i in range(600) for s in [rng.randint(0, 39)]]
    every = pd.DataFrame(made, columns=[*fold.KEY, "part", "id", "arrival_seq", "stage", "authority", "person_id", "confidence", "status", "valid_from", "attributes", "embedding"]).astype({"person_id": "Int64", "embedding": "object"})
    want = []
    for _, alone in every.groupby(fold.KEY, dropna=False):
        active = []
        for r in alone.astype({"person_id": "float"}).itertuples(index=False):
            new = fold._row(r)
            want += fold.meet(active, [new], 0.92, 0.80) + fold.settle([new], 0.92, 0.80)
            active = [o for o in [*active, new] if o["status"] == "active"]
    monkeypatch.setattr(fold, "BLOCK", block)
    monkeypatch.setattr(jobs, "STATE_CHUNK", chunk)
    folding, got = jobs.Fold(), []
    folding.init(Handle())
    for batch in (every[:300], every[300:]):
        batch = batch.astype({"person_id": "float"}).sample(frac=1, random_state=1)
        for out in folding.handleInputRows((0,), iter([batch[a : a + rows] for a in range(0, len(batch), rows)]), None):
            got += out.itertuples(index=False, name=None)
    plain = lambda e: repr([None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v for v in e])
    assert sorted(map(plain, got)) == sorted(map(plain, want))
    held = sum(len(jobs.pickle.loads(kept)) for _, kept in folding.active.values())
    assert held > 10 and (chunk < held or len(folding.active) == 3)
    assert all(len(jobs.pickle.loads(kept)) <= chunk for _, kept in folding.active.values())
