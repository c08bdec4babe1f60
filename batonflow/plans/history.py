"""Validations over time: an append-only history of runs and their gaps, in which only what has changed is validated again.

An account's gaps depend on its own statements and on the contracts, as lineage and
superseded values stay within an account. So a run compares a fingerprint of each
account and contract with that of the latest run of both, and goes on with those that
moved. Nothing is deleted: a run adds rows, and the state at any time is read from
the latest run up to then.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from batonflow import fixed
from batonflow.plans import handoff
from batonflow.staging import grown, stage

ACCOUNT = ["tenant_id", "entity_id"]
PAIR = [*ACCOUNT, "contract"]
COUNTS = ["total", *fixed.OUTCOME, "high", "medium", "low", "inherited", "origin"]


def contract_versions(fields: DataFrame) -> DataFrame:
    """(contract, contract_hash): of all fields of a contract, whatever their order."""
    return fields.groupBy("contract").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*fields.columns)))), "|"), 256).alias("contract_hash"))


def fingerprints(objects: DataFrame, fields: DataFrame) -> DataFrame:
    """(tenant_id, entity_id, contract, input_hash, account_hash, contract_hash) of each account and each contract that it has a statement for.

    `input_hash` is of the statements in the contract's two stages. `account_hash` is
    of all of an account's statements: what a gap inherits may come from any stage.
    """
    of_account = handoff.input_tree(objects.select(*ACCOUNT, "id", "version"), ACCOUNT).withColumnRenamed("tree", "account_hash")
    return handoff.stage_trees(objects, fields).join(grown(of_account), ACCOUNT).join(F.broadcast(contract_versions(fields)), "contract")


def latest_runs(runs: DataFrame, when: datetime | None = None) -> DataFrame:
    """The last run of each account and contract, up to `when`."""
    known = runs if when is None else runs.where(F.col("as_of") <= F.lit(when))
    last = Window.partitionBy(*PAIR).orderBy(F.desc("as_of"), F.desc("run_no"))
    return known.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def validate_changed(objects: DataFrame, slots: DataFrame | None, fields: DataFrame, relations: DataFrame, runs: DataFrame | None, run_no: int, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(runs, gaps) to append: of the accounts and contracts whose fingerprint isn't that of their latest run.

    A pair that is validated without a gap has a run with zeros. An account whose
    statements are all gone keeps its last run, as nothing is deleted. Statements and
    lineage of unchanged accounts are left out by semi-joins before anything is
    computed of them, slots as they are packed. Without `runs`, or with none, all pairs are new.
    """
    now = stage(fingerprints(objects, fields), "fingerprints")
    hashes = ["account_hash", "contract_hash"]
    moved = now if runs is None else now.join(grown(latest_runs(runs).select(*PAIR, *hashes)), [*PAIR, *hashes], "left_anti")
    moved = stage(moved, "moved")
    open_objects = stage(objects.join(grown(moved.select(*ACCOUNT).distinct()), ACCOUNT, "left_semi"), "open-objects")
    ids = open_objects.select("id")
    # Lineage stays within an account, so one end tells.
    open_relations = stage(relations.join(grown(ids.withColumnRenamed("id", "from_id")), "from_id", "left_semi"), "open-lineage")
    asked = fields.join(F.broadcast(moved.select("contract").distinct()), "contract", "left_semi")  # at most as many as there are contracts
    gaps = handoff.validate(open_objects, slots, asked, open_relations).join(grown(moved.select(*PAIR)), PAIR, "left_semi")
    gaps = stage(gaps.withColumns({"run_no": F.lit(run_no), "status": F.lit("open")}), "gaps")
    told = moved.join(grown(handoff.summary(gaps)), PAIR, "left").fillna(0, COUNTS)
    return stage(told.withColumns({"run_no": F.lit(run_no), "as_of": F.lit(as_of)}), "runs"), gaps


def append(table: DataFrame, path: str) -> DataFrame:
    """`table` added to the history at `path`; the whole of it."""
    table.write.mode("append").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def gaps_at(runs: DataFrame, gaps: DataFrame, when: datetime | None = None) -> DataFrame:
    """The gaps that stood at `when` (default: now): those of the latest run of each account and contract up to then."""
    return gaps.join(grown(latest_runs(runs, when).select(*PAIR, "run_no")), [*PAIR, "run_no"], "left_semi")


def changes(runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """(…pair, run_no, field, subject_key, slot, outcome, change): gaps that a run opened or closed against the run of its pair before.

    A gap is the same one if field, subject, slot and outcome are.
    """
    name = [*PAIR, "field", "subject_key", "slot", "outcome"]
    by = Window.partitionBy(*PAIR).orderBy("as_of", "run_no")
    order = runs.select(*PAIR, "run_no", F.lead("run_no").over(by).alias("next_no"), F.lag("run_no").over(by).alias("last_no"))
    seen = gaps.select(*name, "run_no").distinct().join(grown(order), [*PAIR, "run_no"])
    # A gap of run n is expected in the next one: what is there and wasn't expected was opened, what was and isn't was closed.
    there = seen.select(*name, "run_no", F.lit(1).alias("is"), F.lit(0).alias("was"))
    expected = seen.where("next_no IS NOT NULL").select(*name, F.col("next_no").alias("run_no"), F.lit(0).alias("is"), F.lit(1).alias("was"))
    both = there.union(expected).groupBy(*name, "run_no").agg(F.max("is").alias("is"), F.max("was").alias("was")).where("is <> was")
    return both.select(*PAIR, "run_no", "field", "subject_key", "slot", "outcome", F.when(F.col("is") == 1, "opened").otherwise("closed").alias("change"))
