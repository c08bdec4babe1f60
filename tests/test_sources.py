from __future__ import annotations

import json

from batonflow.sources import connectors


def test_connectors(spark, tmp_path):
    (tmp_path / "drive/sales").mkdir(parents=True)
    (tmp_path / "drive/sales/a.md").write_text("# T\nLast updated: 2026-01-02\n## One\nx\n## Two\ny\n")
    rows = connectors.drive(spark, str(tmp_path / "drive")).orderBy("external_id").collect()
    assert [(r.external_id, r.stage, str(r.source_ts)[:10]) for r in rows] == [(f"sales/a.md#{i}", "sales", "2026-01-02") for i in range(3)]
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail/t.json").write_text(json.dumps({"thread_id": "t", "subject": "s", "messages": [{"message_id": "m1", "from": "a@x", "date": "2026-01-01T00:00:00Z", "text": "hi"}, {"message_id": "m2", "from": "b@x", "date": "2026-01-01T01:00:00Z", "text": "yo"}]}))
    assert connectors.email(spark, str(tmp_path / "mail")).count() == 2
    (tmp_path / "chat.json").write_text(json.dumps({"workspace_id": "w", "channels": [{"channel_id": "C1", "name": "deals", "messages": [{"ts": "1700000000.1", "user": "U", "text": "hello"}, {"ts": "1700000001.1", "user": "U", "text": " ", "bot_id": None}, {"ts": "1700000002.1", "user": "U", "text": "bot", "bot_id": "B"}]}, {"channel_id": "C2", "name": "x", "messages": [{"ts": "1700000003.5", "user": "U", "text": "secret"}]}]}))
    private = spark.createDataFrame([("C2", ["U", "V"])], "channel_id string, members array<string>")
    rows = connectors.chat(spark, str(tmp_path / "chat.json"), {"deals": "sales"}, private).orderBy("external_id").collect()
    assert [(r.external_id, r.stage, r.acl) for r in rows] == [("C1:1700000000.1", "sales", ["*"]), ("C2:1700000003.5", None, ["U", "V"])]
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls/yes.txt").write_text("# call_id: c1\n# date: 2026-01-01\n# consent_given: true\n\nA: hello\n# not a header\n")
    (tmp_path / "calls/no.txt").write_text("# consent_given: false\n\nB: hi\n")
    kept, rejected = connectors.calls(spark, str(tmp_path / "calls"))
    assert [(r.external_id, r.text) for r in kept.collect()] == [("c1", "A: hello\n# not a header\n")]
    assert [r.external_id for r in rejected.collect()] == ["no"]


def test_ingest_and_upsert(spark):
    new = spark.createDataFrame([(1, "a", "h", 1), (1, "a", "h", 2), (1, "b", "h", 3)], "tenant_id long, external_id string, content_hash string, arrival_seq long")
    keys = ("tenant_id", "external_id", "content_hash")
    assert sorted((r.arrival_seq, r.was_new) for r in connectors.ingest(new, None, keys).collect()) == [(1, True), (2, False), (3, True)]
    known = new.where("external_id = 'b'")
    assert sorted((r.arrival_seq, r.was_new) for r in connectors.ingest(new, known, keys).collect()) == [(1, True), (2, False), (3, False)]
    table = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int")
    rows = spark.createDataFrame([("y", 2, 1), ("y", 3, 2), ("z", 4, 1)], "k string, v int, seq int")
    assert sorted(map(tuple, connectors.upsert(table, rows, ["k"], "seq").collect())) == [("x", 1), ("y", 3), ("z", 4)]


def test_contract_files(tmp_path):
    (tmp_path / "c.yaml").write_text("id: c\nfrom_stage: a\nto_stage: [x, y]\nfields:\n  - {name: f, check: present, types: [t], importance: high}\n")
    got = connectors.load_contracts([str(tmp_path / "c.yaml")])
    assert [c[:3] for c in got] == [("c::x", "a", "x"), ("c::y", "a", "y")] and got[0][3] == [("f", "present", ["t"], [], "high", 0, None)]
