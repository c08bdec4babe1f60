"""Vector codes by product codebooks, in exact integers, with exponion search.

A vector's components become integers and are cut into equal parts; each part
position has a codebook. Rounds of Lloyd's steps assign each part to the nearest
entry and move entries to the floored means. The search starts at the entry of the
round before, at squared distance u: an entry that is as near lies within twice that
distance of it, so only entries with a squared distance of 4u or less in its sorted
list are scanned. All of this is in integers, so nothing is rounded and ties go to the
lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from batonflow.llm.text import in_batches
from batonflow.staging import clear, stage, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of 64 are kept up to this size, so that every sum of squares is below 2**63; of longer vectors up to less.
MOST = float(1 << 17)
#: Points of one entry that are compared at a time.
BLOCK = 4096
#: Groups that sums of tasks are added up in, before the driver adds these.
GROUPS = 16
#: Labels whose sums are broadcast; more are joined by a shuffle.
MOST_LABELS = 100_000

_BLOCKS = "ids binary, rows binary, labels binary, codes binary, sums binary"


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows: through floats while these are exact, else in 64 bits."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if a.shape[1] * most(a) * most(b) < 1 << 52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Entries:
    """One position's codebook, with each entry's list of entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.squares = (self.entries**2).sum(axis=1)
        between = self.squares[:, None] + self.squares - 2 * inner(self.entries, self.entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each point, and how many distances were computed. start: an entry of each to begin at."""
        code, error, seen = start.copy(), np.zeros(len(points), np.int64), len(points)
        own = ((points - self.entries[start]) ** 2).sum(axis=1)
        by = np.argsort(start, kind="stable")
        edges = np.flatnonzero(np.diff(start[by], prepend=-1))
        for a, z in zip(edges, np.append(edges[1:], len(by)), strict=True):
            entry = start[by[a]]
            reach = np.searchsorted(self.between[entry], 4 * own[by[a:z]], side="right")
            # Points of a like reach together, so that the widest of a block costs the others little.
            group = by[a:z][np.argsort(reach, kind="stable")]
            reach = np.sort(reach)
            for b in range(0, len(group), BLOCK):
                who, many = group[b : b + BLOCK], reach[b : b + BLOCK]
                near = np.sort(self.order[entry, : many[-1]])  # by index, so argmin settles ties
                far = (points[who] ** 2).sum(axis=1)[:, None] + self.squares[near] - 2 * inner(points[who], self.entries[near])
                best = far.argmin(axis=1)
                code[who], error[who] = near[best], far[np.arange(len(who)), best]
                seen += far.size
        return code, error, seen


def moved(entries: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Floored means where an entry has points; the others stay."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], entries)


def _cut(rows: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component); a length that isn't a multiple of `parts` is filled up with zeros."""
    spare = -rows.shape[1] % parts
    rows = np.hstack([rows, np.zeros((len(rows), spare), rows.dtype)]) if spare else rows
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _summed_parts(cut: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """(part, entry, 1 + width): counts and sums of the rows by their codes."""
    out = np.zeros((len(cut), entries, 1 + cut.shape[2]), np.int64)
    for p in range(len(cut)):
        order = np.argsort(codes[p], kind="stable")
        first = np.flatnonzero(np.diff(codes[p][order], prepend=-1))
        if len(first):
            named = codes[p][order][first]
            out[p, named, 0] = np.diff(np.append(first, len(order)))
            out[p, named, 1:] = np.add.reduceat(cut[p][order], first, axis=0)
    return out


def _blocks(scale: int):
    """Batches of (vec_id, label, vector) as one row each; labels and ids are kept with their nulls as Arrow bytes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                dim = len(batch["v"][0])
                rows = np.floor(scale * batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.int64)
                yield _packed({"ids": _bytes(batch["vec_id"]), "labels": _bytes(batch["label"]), "rows": rows.astype(np.int32).tobytes(), "codes": b"", "sums": b""})

    return run


def _packed(row: dict) -> pa.RecordBatch:
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[n]], pa.binary()) for n in names], names=names)


def _bytes(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], names=["c"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _column(kept: bytes) -> pa.Array:
    return pa.ipc.open_stream(kept).read_all()["c"].combine_chunks()


def _assigned(books, dim: int, parts: int, entries: int):
    """Blocks with the codes of these codebooks, and the sums that move them."""

    def run(batches):
        search = [Entries(x) for x in books.value]
        for batch in batches:
            for row in batch.to_pylist():
                cut = _cut(np.frombuffer(row["rows"], np.int32).astype(np.int64).reshape(-1, dim), parts)
                start = np.frombuffer(row["codes"], np.uint8).reshape(parts, -1) if row["codes"] else np.zeros(cut.shape[:2], np.uint8)
                codes = np.array([s.nearest(x, c.astype(np.int64))[0] for s, x, c in zip(search, cut, start, strict=True)])
                row["codes"] = codes.astype(np.uint8).tobytes()
                row["sums"] = _summed_parts(cut, codes, entries).tobytes()
                yield _packed(row)

    return run


def _added(batches):
    total = None
    for batch in batches:
        for x in batch["sums"]:
            own = np.frombuffer(x.as_py(), np.int64)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "sums"])


def _totals(blocks: DataFrame) -> np.ndarray:
    """The sums of all blocks: by task, then in groups of tasks, and GROUPS arrays of a fixed size on the driver."""
    tasks = blocks.select("sums").mapInArrow(_added, "task int, sums binary")
    groups = tasks.repartition(GROUPS, "task").mapInArrow(_added, "task int, sums binary").collect()
    return sum(np.frombuffer(g.sums, np.int64) for g in groups)


def _codes(books, dim: int, parts: int):
    def run(batches):
        search = [Entries(x) for x in books.value]
        for batch in batches:
            for row in batch.to_pylist():
                cut = _cut(np.frombuffer(row["rows"], np.int32).astype(np.int64).reshape(-1, dim), parts)
                start = np.frombuffer(row["codes"], np.uint8).reshape(parts, -1) if row["codes"] else np.zeros(cut.shape[:2], np.uint8)
                found = [s.nearest(x, c.astype(np.int64)) for s, x, c in zip(search, cut, start, strict=True)]
                text = np.array([c for c, _, _ in found], np.uint8).T.tobytes().hex()
                code = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(cut.shape[1])]
                columns = [_column(row["ids"]), _column(row["labels"]), pa.array(code, pa.string()), pa.array(sum(e for _, e, _ in found))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def kept(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v) of rows that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(v.isNotNull() & fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.cast("array<double>").alias("v"))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each row that takes part.

    Rows whose vector is null or holds null or non-finite components take no part, nor
    do rows with a component beyond MOST (a sum of squares could pass 64 bits) or with
    another length than the most frequent one (of equally frequent ones the least).
    Codebooks start at the `entries` (256 at most) rows with the least ids, null ids
    last, of one id those with the least vector first; of fewer rows there are fewer
    entries. Repeated rows are coded each for itself. A length that `parts` doesn't
    divide is filled up with zeros. Rows without a label are one label. An empty table
    gives an empty result. Other columns are not read.

    A round reads its predecessor's blocks and writes them with their codes and sums;
    only codebooks and their sums, of a fixed size, pass through the driver.
    """
    spark, mark = vectors.sparkSession, staged()
    rows = kept(in_batches(vectors), key, vector, label)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    kind = rows.schema["label"].dataType.simpleString()
    none = lambda: rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if lengths is None or not lengths["d"]:
        return none()
    dim = lengths["d"]
    most = MOST * (64 / max(64, dim)) ** 0.5
    rows = rows.where((F.size("v") == dim) & F.forall("v", lambda x: F.abs(x) <= most))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not first:
        return none()
    books = _cut(np.floor(scale * np.array([r["v"] for r in first])).astype(np.int64), parts)
    blocks = stage(rows.mapInArrow(_blocks(scale), _BLOCKS), "blocks")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        blocks = stage(blocks.mapInArrow(_assigned(shared, dim, parts, books.shape[1]), _BLOCKS), "blocks")
        totals = _totals(blocks).reshape(parts, books.shape[1], -1)
        books = np.array([moved(b, t[:, 0], t[:, 1:]) for b, t in zip(books, totals, strict=True)])
        clear(spark, mark, keep=1)  # the round before is read no more
    text = ",".join(map(str, books.ravel().tolist()))
    coded = stage(blocks.mapInArrow(_codes(spark.sparkContext.broadcast(books), dim, parts), f"vec_id long, label {kind}, code string, error long"), "codes")
    clear(spark, mark, keep=1)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    sums = F.broadcast(sums) if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS else sums
    sha = F.lit(hashlib.sha256(text.encode()).hexdigest())
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
