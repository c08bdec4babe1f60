"""Vectors against vectors, in blocks: nearest few, and all pairs that are close enough.

Vectors are packed by the thousand, and what meets are packs: a task multiplies two of
them and hands on the best few of each row, or the pairs over the threshold. No row is
made for a pair that isn't in the result, and no task holds more than two packs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Vectors of a pack, about: packs are dealt by hash.
PACK = 1024
#: Decimal places that similarities are ranked by, so that rounding doesn't order equal ones.
PLACES = 9
#: Bytes of pairs of packs that Python is handed at once, or one pair: packs of any number are then no more memory.
BATCH = 4 << 20


def _common_length(rows: DataFrame) -> int:
    """The most frequent length of the vectors; of equally frequent ones the least."""
    found = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return found["d"] if found else 0


def _packed(rows: DataFrame, dim: int, size: int, names: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
    """(packs: block, number, ids and vectors flattened; (block, packs)). A vector that is null, holds nulls or has another length is zeros. Sets the session's bytes of an Arrow batch to BATCH."""
    number, ids, vectors = names
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    counts = rows.groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias("packs"))
    fine = F.coalesce((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    kept = rows.select("block", "id", F.when(fine, F.col("vector").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("v"))
    dealt = kept.join(counts, "block").withColumn(number, F.pmod(F.xxhash64("id"), F.col("packs")).cast("int"))
    packs = dealt.groupBy("block", number).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return packs.select("block", number, F.col("rows.id").alias(ids), F.flatten("rows.v").alias(vectors)), counts


def _matrix(batch: pa.RecordBatch, i: int, ids: str, vectors: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, those as units) of row i, in order of id; a zero vector has a zero unit. Arrow's own buffers are read, no Python numbers made."""
    number = batch[ids][i].values.to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    v = batch[vectors][i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
    long = np.sqrt((v * v).sum(axis=1))
    return number[order], v, v / np.where(long > 0, long, 1)[:, None]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in the order of the components: the same wherever a pair is met."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        ab += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    norm = np.sqrt(aa) * np.sqrt(bb)
    return np.where(norm > 0, ab / np.where(norm > 0, norm, 1), 0.0)


def _best(dim: int, k: int):
    """The k best of an upstream pack for each row of a downstream pack."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                d_ids, d, d_units = _matrix(batch, i, "d_ids", "d_v", dim)
                u_ids, u, u_units = _matrix(batch, i, "u_ids", "u_v", dim)
                near = d_units @ u_units.T
                near[d_ids[:, None] == u_ids] = -np.inf
                most = min(k, len(u_ids))
                least = np.partition(near, len(u_ids) - most, axis=1)[:, len(u_ids) - most]
                # What could round to a place among the best is computed exactly; ids ascend, so the stable sort settles ties.
                who, which = np.nonzero((near >= (least - 2 * 10.0**-PLACES)[:, None]) & np.isfinite(near))
                score = _exact(d[who], u[which])
                order = np.lexsort((u_ids[which], -np.round(score, PLACES), who))
                who, which, score = who[order], which[order], score[order]
                keep = np.arange(len(who)) - np.searchsorted(who, who) < k
                yield pa.RecordBatch.from_arrays([pa.array(d_ids[who[keep]]), pa.array(u_ids[which[keep]]), pa.array(score[keep])], names=["down_id", "up_id", "similarity"])

    return run


def top_similar(down: DataFrame, up: DataFrame, k: int = 4, pack: int = PACK) -> DataFrame:
    """(down_id, rank, up_id, similarity): of each row of `down` the k rows of `up` of its block nearest by cosine, but itself; ties to the smaller id.

    Both: block, id, vector. A null or zero vector, or one of another length than the
    most frequent, has similarity 0 to all. Rows with a null block meet nothing. A block
    of any size is cut into packs, and each pair of packs is one row's work.
    """
    dim = _common_length(up)
    ups, counts = _packed(up, dim, pack, ("shard", "u_ids", "u_v"))
    downs, _ = _packed(down, dim, pack, ("tile", "d_ids", "d_v"))
    # Copies of a downstream pack go to each shard of its block, so a large block is many tasks' work.
    asked = downs.join(counts, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).drop("packs")
    met = asked.repartition("block", "shard", "tile").join(ups, ["block", "shard"]).select("d_ids", "d_v", "u_ids", "u_v")
    found = met.mapInArrow(_best(dim, k), "down_id long, up_id long, similarity double")
    best = Window.partitionBy("down_id").orderBy(F.desc(F.round("similarity", PLACES)), "up_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("down_id", "rank", "up_id", "similarity")


def _pairs(dim: int, least: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a_ids, a, a_units = _matrix(batch, i, "a_ids", "a_v", dim)
                b_ids, b, b_units = _matrix(batch, i, "b_ids", "b_v", dim)
                who, which = np.nonzero(a_units @ b_units.T >= least - 1e-9)
                # Packs of one number meet once, as two of different numbers do; then only one order of a pair counts.
                keep = a_ids[who] < b_ids[which] if batch["one"][i].as_py() == batch["other"][i].as_py() else np.ones(len(who), bool)
                who, which = who[keep], which[keep]
                score = _exact(a[who], b[which])
                close = score >= least
                low, high = np.minimum(a_ids[who], b_ids[which])[close], np.maximum(a_ids[who], b_ids[which])[close]
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(score[close])], names=["a_id", "b_id", "similarity"])

    return run


def similar_vectors(rows: DataFrame, least: float, pack: int = PACK) -> DataFrame:
    """(a_id, b_id, similarity) of all pairs of a block with a cosine of `least` (above 0) or more, a_id < b_id.

    `rows`: block, id (unique), vector. Vectors that are null, zero or of another
    length than the most frequent are in no pair, nor are rows with a null block.
    """
    dim = _common_length(rows)
    packs, counts = _packed(rows, dim, pack, ("one", "a_ids", "a_v"))
    others = packs.select("block", F.col("one").alias("other"), F.col("a_ids").alias("b_ids"), F.col("a_v").alias("b_v"))
    asked = packs.join(counts, "block").withColumn("other", F.explode(F.sequence("one", F.col("packs") - 1))).drop("packs")
    met = asked.repartition("block", "one", "other").join(others, ["block", "other"]).select("one", "other", "a_ids", "a_v", "b_ids", "b_v")
    return met.mapInArrow(_pairs(dim, least), "a_id long, b_id long, similarity double")
