"""Checks, selectors, the sweep over contradictions, marked messages, staging: against plain rules."""

from __future__ import annotations

import random

import pytest

from batonflow import staging
from batonflow.operators import resolve
from batonflow.plans import commands, evals
from batonflow.sources import connectors

ASKED = "selector_id string, kind string, ref string, part string, channel string, type string, suffix string, contains string, stance string, quote string"
CHECKS = "case_id string, check_no int, kind string, selectors array<string>, relation string, either boolean, created_by string, field string, value string, count long, entity string, contract string, suffix string, contains string, slot string, outcome string, inherited boolean"


def rows_of(spark, schema, rows):
    names = [c.split()[0] for c in schema.replace("array<string>", "array").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def selected(spark):
    sources = spark.createDataFrame(
        [(1, "call", "c1", None, "", None), (2, "drive", "p.md", "Why Now", "", None), (3, "drive", "p.md", "Other", "", None), (4, "slack", None, None, "We need SAML", "C1"), (5, "slack", None, None, "saml again", "C2")],
        "source_id long, kind string, ref string, heading string, text string, channel string",
    )
    objects = spark.createDataFrame(
        [(10, 1, 1, "requirement", "acme:sso", "required", "must have SAML"), (11, 1, 1, "decision", "acme:scim", None, None), (12, 2, 2, "requirement", "acme:sso", "done", "x"), (13, 4, 1, "problem", "acme:incident", None, "")],
        "id long, source_id long, entity_id long, type string, subject_key string, stance string, evidence_quote string",
    )
    asked = rows_of(spark, ASKED, [
        dict(selector_id="one", kind="call", ref="c1", type="requirement"), dict(selector_id="all", kind="call", ref="c1"), dict(selector_id="why", kind="drive", ref="p.md", part="why"),
        dict(selector_id="two", kind="drive", ref="p.md"), dict(selector_id="chat", kind="slack", part="saml", channel="C1"), dict(selector_id="both", kind="slack", part="saml"),
        dict(selector_id="quote", kind="call", ref="c1", quote="saml"), dict(selector_id="none", kind="call", ref="c1", suffix=":x"),
    ])
    return evals.select_objects(objects, sources, asked)


def test_selectors(selected):
    got = {}
    for r in selected.collect():
        got.setdefault(r.selector_id, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {"one": [10], "all": [10, 11], "why": [12], "chat": [13], "quote": [10]}


def test_checks(spark, selected):
    relations = spark.createDataFrame([("duplicate_of", 12, 10, "system:dedup"), ("supersedes", 10, 13, "system:lifecycle:R3")], "relation string, from_id long, to_id long, created_by string")
    fields = spark.createDataFrame([(10, "status", "active")], "id long, field string, value string")
    found = spark.createDataFrame([("acme", "c", "acme:sso", "idp", "missing", False)], "entity string, contract string, subject_key string, slot string, outcome string, inherited boolean")
    cases = [
        ("entities_equal", dict(selectors=["one", "chat"]), True), ("entities_equal", dict(selectors=["one", "why"]), False), ("entities_distinct", dict(selectors=["one", "why"]), True),
        ("entities_distinct", dict(selectors=["one", "chat"]), False), ("entities_equal", dict(selectors=["one", "all"]), None),
        ("relation_exists", dict(selectors=["one", "why"], relation="duplicate_of"), True), ("relation_exists", dict(selectors=["chat", "one"], relation="supersedes"), False),
        ("relation_exists", dict(selectors=["chat", "one"], relation="supersedes", either=True), True), ("relation_exists", dict(selectors=["one", "chat"], relation="supersedes", created_by="R4"), False),
        ("relation_absent", dict(selectors=["chat", "one"], relation="supersedes"), False), ("relation_absent", dict(selectors=["why", "chat"], relation="supersedes"), True),
        ("object_field_equals", dict(selectors=["one"], field="status", value="active"), True), ("object_field_equals", dict(selectors=["one"], field="status", value="stale"), False),
        ("object_count", dict(selectors=["all"], count=2), True), ("object_count", dict(selectors=["none"], count=0), True), ("object_count", dict(selectors=["all"], count=1), False),
        ("handoff_gap_outcome", dict(selectors=[], entity="acme", contract="c", suffix=":sso", slot="idp", outcome="missing"), True),
        ("handoff_gap_outcome", dict(selectors=[], entity="acme", contract="c", slot="idp", outcome="missing", inherited=True), False),
        ("handoff_gap_outcome", dict(selectors=[], entity="acme", contract="c", slot=None, outcome="missing"), False),
    ]
    checks = rows_of(spark, CHECKS, [dict(case_id="good" if ok else f"bad{i}", check_no=i, kind=kind, **more) for i, (kind, more, ok) in enumerate(cases)])
    result = evals.run_checks(checks, selected, relations, fields, found)
    got = {r.check_no: r.passed for r in result.collect()}
    assert [got[i] for i in range(len(cases))] == [ok for *_, ok in cases]
    assert {r.case_id for r in evals.case_results(result).collect() if r.passed} == {"good"}


def test_sweep(spark):
    rows = [(1, 2, "system:lifecycle:R4", None, True, 0.95), (3, 4, "system:lifecycle:R1", None, True, 0.85), (5, 6, "system:lifecycle:R2", None, True, 0.1), (7, 8, "human", None, True, 0.99), (9, 10, "system:lifecycle:R2", None, False, 0.99)]
    got = commands.reconcile_contradictions(spark.createDataFrame(rows, "from_id long, to_id long, created_by string, resolved_at timestamp, compatible boolean, cosine double"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, "duplicate"), (3, 4, "review"), (5, 6, "independent")]


def test_marked_messages(spark):
    events = spark.createDataFrame(
        [("e1", "C", "2", "1", "<@U> mark this too"), ("e2", "C", "3", None, "<@U> mark"), ("e3", "C", "4", "1", "<@U>, MARK"), ("e4", "C", "5", "1", "<@U> Marketo")],
        "event_id string, channel_id string, ts string, thread_ts string, text string",
    ).selectExpr("*", "current_timestamp() AS source_ts", "'sales' AS stage", "array('*') AS acl")
    got = connectors.marked(events, spark.createDataFrame([("C", "1", "the parent")], "channel_id string, ts string, text string"))
    assert {r.external_id: r.text for r in got.collect()} == {"mark:e1": "the parent\n\nthis too", "mark:e3": "the parent"}


@pytest.mark.parametrize("seed", [1, 2])
def test_entities_against_a_fold(spark, seed):
    """The same as going through the hints one by one."""
    rng = random.Random(seed)
    stems = ["acme global holdings", "quantum dynamics", "northern light", "onboarding checklist"]
    hints, known = [], [(t, f"{s} old", f"k{t}{i}") for t in (1, 2) for i, s in enumerate(stems[:2])]
    for n in range(60):
        name = list(rng.choice(stems))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            name[rng.randrange(len(name))] = rng.choice("abcdefg ")
        hints.append((rng.choice([1, 2]), "".join(name).strip(), n))
    from tests.test_functions import grams

    want = {}
    for tenant in (1, 2):
        names = {n: e for t, n, e in known if t == tenant}
        for _, hint, _ in sorted((h for h in hints if h[0] == tenant), key=lambda h: h[2]):
            name = " ".join(w for w in hint.lower().split() if w not in ("inc", "corp", "corporation", "llc", "ltd", "co"))
            if (tenant, hint) in want:
                continue
            if name in names:
                want[tenant, hint] = (names[name], "exact", None)
                continue
            score, best = min(((-len(grams(name) & grams(x)) / len(grams(name) | grams(x)), x) for x in names), default=(0, None))
            if -score >= 0.85:
                names[name] = names[best]
                want[tenant, hint] = (names[best], "linked", None)
            else:
                own = "-".join(hint.lower().split())
                want[tenant, hint] = (own, "new", names[best] if -score >= 0.6 else None)
                names[name] = own
    got = resolve.resolve_entities(spark.createDataFrame(hints, "tenant_id long, hint string, arrival_seq long"), spark.createDataFrame(known, "tenant_id long, name string, entity string"))
    assert {(r.tenant_id, r.hint): (r.entity, r.how, r.near) for r in got.collect()} == want
    assert resolve.resolve_entities(spark.createDataFrame([], "tenant_id long, hint string, arrival_seq long"), spark.createDataFrame(known, "tenant_id long, name string, entity string")).count() == 0


def test_folder_and_clear(spark, tmp_path):
    mark = staging.staged()
    a, b = (staging.stage(spark.range(3), "x") for _ in range(2))
    staging.clear(spark, mark, keep=1)
    assert b.count() == 3 and staging.staged() == mark + 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a.inputFiles()[0]).count()

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "local-cluster[2,1,1024]"}.get(key, default))

    with pytest.raises(RuntimeError):
        staging.shared_folder(Cluster)
