"""The pipeline's stages on a small corpus, each against what it should keep; registered queries against SQL."""

from __future__ import annotations

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage = say(70)
    rows = [(i, say(rng.randint(60, 200)), "en", f"src{i % 3}") for i in range(240)]
    rows += [(1000 + i, rows[i][1], "en", "src0") for i in range(10)]
    rows += [(2000 + i, f"{say(40)}\n{passage}\n{say(40)}", "en", "src1") for i in range(6)]
    rows += [(3000 + i, say(80).upper().replace(" ", "!! "), "en", "src2") for i in range(60)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(240)] + [(3000 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in rows}


def test_stages(spark, folder):
    import corpus_pipeline as p

    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, step in p.STAGES[:-1]:
        out = step(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
    good = {i for i, _, _ in kept["quality"]}
    assert good == {i for i in texts if i < 3000}
    assert {i for i, _, _ in kept["near_duplicates"]} == {i for i in good if not 1000 <= i < 2000}
    cut = {i: t for i, t, _ in kept["repeated_passages"]}
    assert all(cut[i] == texts[i] for i in cut if i < 1000) and cut[2000] == texts[2000]
    assert all(len(WORD.findall(cut[2000 + i])) == 80 for i in range(1, 6))
    assert all(n == len(t) for _, t, n in kept["repeated_passages"])
    mixed = kept["mixture"]
    assert {(i, t) for i, t, _ in mixed} <= set(cut.items()) and len(mixed) > 100
    pieces = p.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == {i for i, _, _ in mixed}
    run = p.run(spark, path).collect()
    assert sorted(r.doc_tokens for r in run if r.start == 0) == sorted(r.doc_tokens for r in pieces if r.start == 0)


@pytest.fixture(scope="module")
def repeated_ids(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    same, other, third, passage, a, b, c = say(80), say(90), say(70), say(60), say(20), say(30), say(40)
    # Equal rows of 1; of 2 one row repeats 1 and one doesn't; those of 3 share a passage, which 4 has too; 5 repeats 2's second.
    rows = [(1, same), (1, same), (2, same), (2, other), (3, f"{a} {passage}"), (3, f"{passage} {b}"), (4, f"{c} {passage}"), (5, other), (6, third), (None, same)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return table, dict(same=same, other=other, third=third, passage=passage, a=a, b=b, c=c)


@pytest.mark.parametrize("parts", [1, 5])
def test_near_duplicates_of_repeated_ids(spark, repeated_ids, parts):
    import corpus_pipeline as p

    table, t = repeated_ids
    got = [tuple(r) for r in p.near_duplicates(spark, table.repartition(parts), "").collect()]
    want = [(1, t["same"]), (2, t["other"]), (3, f"{t['a']} {t['passage']}"), (3, f"{t['passage']} {t['b']}"), (4, f"{t['c']} {t['passage']}"), (6, t["third"]), (None, t["same"])]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_passages_of_repeated_ids(spark, repeated_ids, parts):
    import corpus_pipeline as p

    table, t = repeated_ids
    docs = table.withColumn("n_chars", F.length("text").cast("long"))
    got = [(r.doc_id, " ".join(WORD.findall(r.text))) for r in p.repeated_passages(spark, docs.repartition(parts), "").collect()]
    rest = [(1, t["same"]), (1, ""), (2, ""), (2, t["other"]), (4, t["c"]), (5, ""), (6, t["third"]), (None, t["same"])]
    first = [[(3, f"{t['a']} {t['passage']}"), (3, t["b"])], [(3, t["a"]), (3, f"{t['passage']} {t['b']}")]]
    assert sorted(map(str, got)) in [sorted(map(str, rest + f)) for f in first]


def workers(node, tasks: list[int]) -> int:
    """Python workers that one task holds at `node`; `tasks` gets the number at each node."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return workers(node.executedPlan(), tasks)
    below = [workers(node.children().apply(i), tasks) for i in range(node.children().size())]
    held = max(below, default=0) if node.nodeName() == "Union" else sum(below)
    tasks.append(held + bool(re.search("Arrow|Python|Pandas", node.nodeName())))
    return 0 if "Exchange" in node.nodeName() else tasks[-1]


@pytest.fixture
def held(monkeypatch):
    """The most workers that one task holds in each staged plan, by its name; to be called with a last plan."""
    from batonflow.llm import jaccard, packing, quality, suffixes

    seen = {}

    def looked(df, name, *more, put=jaccard.stage):
        workers(df._jdf.queryExecution().executedPlan(), seen.setdefault(name, []))
        return put(df, name, *more)

    for module in (jaccard, packing, quality, suffixes):
        monkeypatch.setattr(module, "stage", looked)

    def most(df):
        looked(df, "out")
        return {name: max(found) for name, found in seen.items()}

    return most


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "repeated_passages", "packing"])
def test_a_task_holds_one_python_worker(spark, folder, stage, held):
    """Workers are kept for later tasks: a single plan with two of them to a task doubles what executors hold from then on."""
    import corpus_pipeline as p

    found = held(dict(p.STAGES)[stage](spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0]))
    assert max(found.values()) == 1, found


def test_near_duplicates_of_repeated_ids_hold_one_python_worker(spark, repeated_ids, held):
    import corpus_pipeline as p

    found = held(p.near_duplicates(spark, repeated_ids[0], ""))
    assert max(found.values()) == 1 and "repeated" in found, found


def odd_docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gram string, rank int, copy int"
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash", 1, 7) for i, t, s in rows], schema)


STAGES = ["quality", "near_duplicates", "repeated_passages", "mixture", "packing"]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_on_odd_rows(spark, folder, stage):
    """Null ids, texts and sources, empty texts, repeated rows, one very long text, clashing columns: each row has its result."""
    import corpus_pipeline as p

    path, texts = folder
    rng = random.Random(8)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 7) + str(rng.randint(0, 99999)) for _ in range(60_000))
    rows = [(1, None, "src0"), (2, "", "src1"), (3, " \n\t", None), (None, texts[5], "src0"), (None, None, None), (4, texts[7], "src1"), (4, texts[7], "src1"), (5, texts[8], "src2"), (6, long, "src2")]
    docs = odd_docs(spark, rows).repartition(3)
    got = dict(p.STAGES)[stage](spark, docs, path).collect()
    if stage == "packing":
        assert sorted(str(r.doc_id) for r in got if r.start == 0) == sorted(str(i) for i, *_ in rows)
        return
    ids = sorted(str(r.doc_id) for r in got)
    assert list(got[0].asDict()) == docs.columns if got else True
    if stage == "quality":  # good texts stay, whatever else is odd about the row
        assert {(4, texts[7]), (5, texts[8]), (None, texts[5])} <= {(r.doc_id, r.text) for r in got} and ids.count("4") == 2
    elif stage == "near_duplicates":
        assert ids == sorted(["1", "2", "3", "None", "None", "4", "5", "6"])
    elif stage == "repeated_passages":
        assert len(got) == len(rows) and sorted(len(r.text or "") for r in got if r.doc_id == 4) == [0, len(texts[7])]
        assert [r.text for r in got if r.doc_id == 6] == [long] and [r.text for r in got if r.doc_id == 1] == [None]
    else:
        assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in rows} and ids.count("4") % 2 == 0


@pytest.mark.parametrize("stage", STAGES)
def test_stages_on_empty_tables(spark, folder, stage, tmp_path):
    import corpus_pipeline as p

    docs = odd_docs(spark, [])
    out = dict(p.STAGES)[stage](spark, docs, folder[0])
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)
    if stage == "quality":  # no labels at all: nothing is known against a text
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        assert p.quality(spark, odd_docs(spark, [(1, "some text", "a")]), str(tmp_path)).count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op5_chat_format", "op6_nearest", "op7_mixing", "op8_url_filter"])
def test_against_sql(spark, name):
    from batonflow.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for f in os.listdir(SF):
        full = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{full}')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = c.execute(ORACLE_SQL[name])
    at = [d[0] for d in cursor.description]
    assert sorted(at) == columns
    want = sorted(repr([r[at.index(x)] for x in columns]) for r in cursor.fetchall())
    assert sorted(repr([r[x] for x in columns]) for r in df.collect()) == want
