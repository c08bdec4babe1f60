"""Packing by cutting-stock column generation over the histogram of piece lengths.

A document is cut into whole sequences and one rest. The rests are counted by
length class; a linear program over patterns of classes is solved by column
generation, a knapsack's dynamic program pricing the columns; the patterns'
counts are rounded down and what is left is packed by decreasing length. Only the
histogram, of a fixed number of classes, reaches the driver. Documents ranked
within their class are then assigned to the patterns' places by arithmetic.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from batonflow.llm.bpe import default_path, encode_all, id_cache
from batonflow.llm.text import in_batches
from batonflow.staging import stage

SIZE, END = 2048, 1
#: Rests are rounded up to a multiple of this in the program, so it has SIZE / STEP classes at most.
STEP = 4
#: Columns are generated until the program is within this share of its optimum.
GAP = 1e-3


def _price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of the greatest value: an unbounded knapsack over `room`, by dynamic program."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, values_up = sizes[order], values[order]
    fit = np.searchsorted(sizes_up, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fit[c]:
            with_item = best[c - sizes_up[: fit[c]]] + values_up[: fit[c]]
            i = int(with_item.argmax())
            if with_item[i] > best[c] + 1e-12:
                best[c], took[c] = with_item[i], order[i]
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), pattern


def _start(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis (patterns as columns) and its counts: largest first, each pattern until a class runs out.

    A later pattern lacks every class that ran out before, so with the classes in
    that order the matrix is triangular. Of classes that run out together, all but
    one get a pattern of their own, used zero times.
    """
    left, open_, columns, x = demand.astype(float), np.ones(len(sizes), bool), [], []
    while open_.any():
        pattern, space = np.zeros(len(sizes)), room
        for i in np.flatnonzero(open_)[::-1]:
            pattern[i] = min(space // sizes[i], np.ceil(left[i]))
            space -= pattern[i] * sizes[i]
        used = pattern > 0
        times = (left[used] / pattern[used]).min()
        left = np.where(used, left - pattern * times, left)
        out = np.flatnonzero(used & (left <= 1e-9 * demand))
        open_[out] = False
        columns += [pattern, *(np.where(np.arange(len(sizes)) == i, room // sizes, 0) for i in out[1:])]
        x += [times, *[0.0] * (len(out) - 1)]
    return np.array(columns).T, np.array(x)


def _times(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """A product without BLAS: its threads may block in a driver's process."""
    return np.einsum("ij,j->i", matrix, column)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row pivots, in whole-array steps and without BLAS."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        if pivot != i:
            both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        rows = np.flatnonzero(both[:, i])
        rows = rows[rows != i]
        both[rows] -= both[rows, i, None] * both[i]
    return both[:, n:]


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, most: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each is used): a basic solution of the relaxed cutting-stock program.

    Revised simplex: a priced pattern enters, and the inverse is updated in place
    and made anew every 200 steps. Ends within `gap` of the optimum by Farley's
    bound, or after `most` patterns.
    """
    basis, x = _start(sizes, demand, room)
    inverse = _inverse(basis)
    bound = demand @ sizes / room
    for step in range(most):
        if x.sum() <= bound * (1 + gap):
            break
        value, column = _price(np.maximum(inverse.sum(axis=0), 0), sizes, room)
        bound = max(bound, x.sum() / value)
        if value <= 1 + 1e-6:
            break
        direction = _times(inverse, column)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        if not np.isfinite(t):
            break
        x = x - t * direction
        x[out] = t
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if step % 200 == 199:
            inverse = _inverse(basis)
            x = np.maximum(_times(inverse, demand.astype(float)), 0)
    return basis.T.round().astype(np.int64), np.maximum(x, 0)


def _rest(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns by decreasing length for what rounding leaves, each repeated while it can be."""
    left, out = left.copy(), []
    down = np.argsort(-sizes, kind="stable")
    while left.any():
        pattern, space = np.zeros(len(sizes), np.int64), room
        for i in down:
            if left[i] and sizes[i] <= space:
                pattern[i] = min(left[i], space // sizes[i])
                space -= pattern[i] * sizes[i]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def plan(histogram: dict[int, int], size: int = SIZE, step: int = STEP) -> pd.DataFrame:
    """(class, start, each, sequence): ranks from `start` on go `each` to a sequence, from `sequence` on.

    The last range of a class ends at its count. At most size / step classes go
    in, so what comes out is bounded too, whatever the number of documents.
    """
    classes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in classes], np.int64)
    if not len(classes):
        return pd.DataFrame({"class": [], "start": [], "each": [], "sequence": []}, dtype=np.int64)
    room = size // step
    patterns, x = solve(classes, demand, room)
    chosen, left = [], demand.copy()
    for pattern, times in zip(patterns, np.floor(x + 1e-6).astype(np.int64), strict=True):
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min()))
        if times > 0:
            chosen.append((pattern, times))
            left -= pattern * times
    chosen += _rest(classes, left, room)
    rows, at, sequence = [], np.zeros(len(classes), np.int64), 0
    for pattern, times in chosen:
        for i in np.flatnonzero(pattern):
            rows.append((classes[i], at[i], pattern[i], sequence))
            at[i] += pattern[i] * times
        sequence += times
    return pd.DataFrame(rows, columns=["class", "start", "each", "sequence"]).sort_values(["class", "start"], ignore_index=True)


def _cut(path: str, size: int):
    names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        from pyspark import TaskContext

        ids, row = id_cache(path), count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            # Ids of a batch, of at most text.BATCH or of one text, are an array; each text's own are followed by END.
            flat, n = encode_all(ids, [text or "" for text in batch[1].to_pylist()])
            upto, crc, n = np.cumsum(n), array("q"), n + 1
            raw = np.insert(flat, upto, END).astype("<u4").tobytes()
            for a, z in zip((4 * (np.cumsum(n) - n)).tolist(), (4 * np.cumsum(n)).tolist(), strict=True):
                crc.extend(zlib.crc32(raw[s : min(s + 4 * size, z)]) for s in range(a, z, 4 * size))
            times = -(-n // size)
            whole, doc = np.repeat(n, times), np.repeat(np.arange(len(n)), times)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)) * size
            number = np.fromiter((next(row) for _ in range(len(n))), np.int64, len(n))[doc]
            columns = [batch[0].take(pa.array(doc)), *(pa.array(x) for x in (number, start, np.minimum(size, whole - start), np.array(crc, np.int64), whole))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, step: int = STEP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole sequences come from long documents; every rest is in exactly one
    sequence with others. Null text is empty: its piece is the end id alone.
    Repeated rows are packed each for itself, a null id like any other. An empty
    table gives an empty result. Other columns are not read.
    """
    path = path or default_path()
    texts = in_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stage(
        texts.mapInArrow(_cut(path, size), "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")
        .withColumn("class", F.when(F.col("length") < size, F.ceil(F.col("length") / step).cast("int")).otherwise(0)),
        "pieces",
    )
    # Ranks: the pieces of a class are dealt over shards, so a class may hold any share of the rows.
    shards = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)).cast("int"))
    sizes = stage(pieces.groupBy("class", "shard").agg(F.count("*").alias("n")), "sizes")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.withColumn("own", F.row_number().over(Window.partitionBy("class", "shard").orderBy("row", "start")) - 1)
    ranked = ranked.join(sizes.select("class", "shard", before.alias("before")), ["class", "shard"]).withColumn("rank", F.col("before") + F.col("own"))
    # At most size / step + 1 rows: the histogram.
    histogram = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(0, 0)
    table = plan(histogram, size, step)
    of_class = {c: g[["start", "each", "sequence"]].to_numpy() for c, g in table.groupby("class")}

    @F.pandas_udf("long")
    def place(kind: pd.Series, rank: pd.Series) -> pd.Series:
        out = rank.to_numpy().copy()
        kinds = kind.to_numpy()
        for c in np.unique(kinds):
            if c:
                mine = kinds == c
                start, each, sequence = of_class[c].T
                at = np.searchsorted(start, out[mine], side="right") - 1
                out[mine] = whole + sequence[at] + (out[mine] - start[at]) // each[at]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", place("class", "rank"))
    # A sequence has at most `size` pieces.
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
