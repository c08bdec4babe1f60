"""Scalar functions, against values worked out by hand."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from batonflow.functions import scalars as S
from batonflow.operators import fold, resolve
from batonflow.operators.text import evidence_span, find_quote, sections


def grams(text: str) -> frozenset:
    """Trigrams of padded words, in plain Python."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return frozenset(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1))


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


@pytest.mark.parametrize(("kind", "role", "stage", "hedged", "want"), [
    ("requirement", "customer", "sales", True, 4), ("decision", "product", None, False, 4), ("requirement", "sales", "sales", False, 2),
    ("commitment", "sales", "sales", False, 3), ("commitment", "sales", "sales", True, 1), ("decision", "leadership", None, True, 4),
    ("requirement", "leadership", None, False, 3), ("requirement", "other", None, False, 0), ("requirement", "other", "sales", False, 3),
    ("requirement", "customer_success", "customer_success", False, 0),
])
def test_authority(spark, kind, role, stage, hedged, want):
    got = one(spark, a=S.authority(F.lit(kind), F.lit(role), F.lit(stage).cast("string"), F.lit(hedged)))
    assert got["a"] == want


def test_names(spark):
    got = one(spark, **{f"n{i}": S.normalize_alias(F.lit(n)) for i, n in enumerate(["Acme", "Acme Corp", "ACME Inc.", "  "])})
    assert list(got.values()) == ["acme", "acme", "acme", ""]
    assert one(spark, a=S.slugify(F.lit("--A  b!")), b=S.slugify(F.lit("!!")), c=S.normalize_capability(F.lit("Data-Residency "))) == {"a": "a-b", "b": "entity", "c": "data_residency"}


@pytest.mark.parametrize(("a", "b", "want"), [
    ("acme global holdings", "acme global holding", 0.864), ("quantum dynamics", "quantum dynamic", 0.833),
    ("onboarding_checklist", "onboarding_checklist_v2", 0.875), ("data_residency", "data_region", 0.35), ("", "", 0.0),
])
def test_similarity(spark, a, b, want):
    assert round(one(spark, s=S.similarity(S.trigrams(F.lit(a)), S.trigrams(F.lit(b))))["s"], 3) == want
    x, y = grams(a), grams(b)
    assert round(len(x & y) / max(1, len(x | y)), 3) == want


def test_severity_and_bands(spark):
    value = S.severity(F.lit("high"), F.lit(3), F.lit("generalized"))
    got = one(spark, v=value, b=S.band(value), high=S.band(F.lit(2)), low=S.band(F.lit(0.99)))
    assert (str(got["v"]), got["b"], got["high"], got["low"]) == ("0.96", "low", "high", "low")


def test_visibility(spark):
    acl = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    got = one(spark, all=S.visible(acl("*"), []), own=S.visible(acl("a"), ["a"]), other=S.visible(acl("a"), ["b"]), none=S.visible(acl(), ["a"]), text=S.redact(F.lit("x"), acl("a"), ["b"]))
    assert got == {"all": True, "own": True, "other": False, "none": False, "text": None}


def test_is_set_and_stances(spark):
    got = one(spark, **{f"v{i}": S.is_set(F.lit(v).cast("string")) for i, v in enumerate([None, "", "[]", "{}", "0", "false"])})
    assert list(got.values()) == [False, False, False, False, True, True]
    pairs = [("required", "deferred"), ("deferred", "required"), ("rejected", "dropped"), ("done", "dropped"), (None, "required")]
    got = one(spark, **{f"p{i}": S.stances_conflict(F.lit(a).cast("string"), F.lit(b)) for i, (a, b) in enumerate(pairs)})
    assert list(got.values()) == [True, True, False, False, False] == [fold.stances_conflict(a, b) for a, b in pairs]


def test_commands(spark):
    got = one(spark, a=S.command(F.lit("<@U1>: Marketo sso")), b=S.command(F.lit("<@U1>, mark\n the  rest")), c=S.command(F.lit("mark")))
    assert (got["a"].entity, got["a"].mark, got["b"].mark, got["b"].note, got["c"].note) == ("Marketo", False, True, "the  rest", "")
    got = one(spark, a=S.command(F.lit("<@U1> Acme sso login")), b=S.command(F.lit("<@U1> MARK this")))
    assert (got["a"].entity, got["a"].topic, got["a"].mark, got["b"].mark, got["b"].entity) == ("Acme", "sso login", False, True, None)


QUOTES = [
    ("a **bold** claim", "bold claim", (4, 16)), ("by 5 – 7 days", "5 - 7", (3, 8)), ("he said “yes”", 'said "yes"', (3, 13)),
    ("two\n  lines", "two lines", (0, 11)), ("nothing", "else", None), ("text", "", None), (None, "x", None), ("exact match", "match", (6, 11)),
]


@pytest.mark.parametrize(("text", "quote", "want"), QUOTES)
def test_find_quote(text, quote, want):
    assert find_quote(text, quote) == want


def test_evidence_span(spark):
    rows = spark.createDataFrame([(t, q) for t, q, _ in QUOTES], "text string, quote string").select(evidence_span(F.col("text"), F.col("quote")).alias("s")).collect()
    assert [None if r.s is None else (r.s.lo, r.s.hi) for r in rows] == [w for _, _, w in QUOTES]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "# T\nintro\n## A\na\n### deep\n## B\nb"), (2, "just text"), (3, " \n"), (4, None), (5, "## X\nx")], "id long, text string")
    rows = [(r.id, r.section_no, r.heading, r.section) for r in sections(docs).orderBy("id", "section_no").collect()]
    assert [r[:3] for r in rows] == [(1, 0, "T"), (1, 1, "A"), (1, 2, "B"), (2, 0, "Document"), (5, 0, "X")]
    assert rows[1][3] == "## A\na\n### deep\n" and "".join(r[3] for r in rows[:3]) == "# T\nintro\n## A\na\n### deep\n## B\nb"
