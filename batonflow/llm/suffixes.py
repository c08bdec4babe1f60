"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where they start with a window's minimiser: among the runs
of GRAM words that a window of PASSAGE words has, the one with the least hash. So
every repeat of a passage keeps suffixes at the same places. A kept suffix stands
for its stretch: all windows that share the minimiser, to its left and right.
Stretches are sorted and each is compared with its neighbour; equal ones repeat
each other as a whole.

Neighbours in one order of suffixes don't find all repeats: of two suffixes that
share words on both sides, others may lie between that share more on the right and
nothing on the left. So a stretch whose gram has other stretches too is extended
window by window: suffixes at each start in it are sorted by PASSAGE words and
compared with their neighbours, and what matches is merged into maximal passages.

The result is exact: a word is in a repeated passage if and only if a window of
PASSAGE words over it occurred before, in the order of (doc_id, position).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from batonflow.llm.bits import parted, row_hash
from batonflow.llm.text import _DOWN, _STEP, _UP, bounds, in_batches, mix, slices, windows, word_hashes
from batonflow.staging import stage

PASSAGE, GRAM = 50, 16
#: Bits that tell which stretches' windows are compared: 16 a stretch up to this many, then more windows than needed.
MOST_BITS = 1 << 27
_NAMES = ["gram", "one", "two", "doc_id", "first", "last", "origin", "row"]
_ROWS = "gram long, one long, two long, doc_id long, first long, last long, origin long, row long"


class Stretches:
    """The runs of windows [first, last] of a text that share their minimiser."""

    def __init__(self, words: np.ndarray, passage: int, gram: int):
        grams = windows(words, gram)
        span, n = passage - gram + 1, len(words) - passage + 1
        if n <= 0:
            self.first = self.last = np.empty(0, np.int64)
            self.gram = self.one = self.two = np.empty(0, np.uint64)
            return
        least = np.empty(n, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(grams, span)
        for a in range(0, n, 1 << 15):
            least[a : a + (1 << 15)] = view[a : a + (1 << 15)].argmin(axis=1) + np.arange(a, min(n, a + (1 << 15)))
        self.first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        self.last = np.append(self.first[1:], n) - 1
        self.gram = grams[least[self.first]]
        self.one, self.two = (self._whole(w, passage) for w in (words, mix(words ^ np.uint64(0x5851F42D4C957F2D))))

    def _whole(self, words: np.ndarray, passage: int) -> np.ndarray:
        """A hash of each whole stretch, from prefix sums taken in steps of the tables of powers."""
        out, ends = np.empty(len(self.first), np.uint64), self.last + passage
        i = 0
        while i < len(out):
            base = self.first[i]
            j = max(i + 1, int(np.searchsorted(ends, base + _STEP, side="right")))
            part = words[base : ends[j - 1]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)])])
            a, z = self.first[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[z] - sums[a]) * _DOWN[a]
            i = j
        return mix(out + (ends - self.first).astype(np.uint64))


def _words(data: np.ndarray) -> np.ndarray:
    starts, ends = bounds(data)
    return word_hashes(data, starts, ends)


def _batch(columns: list[np.ndarray], names: list[str] = _NAMES) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "mark" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)).cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _thinned(gram, one, two, doc, first, last, row) -> pa.RecordBatch:
    """All rows; those whose (one, two) came before in this batch get its document as origin, else -1.

    So what is dealt out for comparing holds a hot stretch once a batch.
    """
    order = np.lexsort((first, row, doc, two, one))
    same = np.zeros(len(order), bool)
    same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    origin = np.full(len(order), -1, np.int64)
    origin[order] = np.where(same, doc[order][head], -1)
    known = np.zeros(len(order), np.int64)
    known[order] = same
    return _batch([gram, one, two, doc, first, last, np.where(known, origin, np.iinfo(np.int64).min), row])


def _stretches(passage: int, gram: int):
    def run(batches):
        for batch in batches:
            docs, numbers, parts = batch[0].to_numpy(), batch[2].to_numpy(), []
            for doc, data, row in zip(docs, slices(batch[1]), numbers, strict=True):
                s = Stretches(_words(data), passage, gram)
                if len(s.first):
                    parts.append((s.gram, s.one, s.two, np.full(len(s.first), doc), s.first, s.last, np.full(len(s.first), row)))
            if parts:
                yield _thinned(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _windows(passage: int, gram: int, bits, size: int):
    """Windows of the stretches whose bit is set, as rows of one window each."""

    def run(batches):
        table = bits.value
        for batch in batches:
            docs, numbers, parts = batch[0].to_numpy(), batch[2].to_numpy(), []
            for doc, data, row in zip(docs, slices(batch[1]), numbers, strict=True):
                words = _words(data)
                s = Stretches(words, passage, gram)
                at = _place(doc, s.first, size)
                want = np.flatnonzero((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                if len(want):
                    long = s.last[want] - s.first[want] + 1
                    p = np.repeat(s.first[want] - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
                    one = windows(words, passage)[p]
                    two = windows(mix(words ^ np.uint64(0x5851F42D4C957F2D)), passage)[p]
                    parts.append((one, one, two, np.full(len(p), doc), p, p, np.full(len(p), row)))
            if parts:
                yield _thinned(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _place(doc, first: np.ndarray, size: int) -> np.ndarray:
    return mix(first.astype(np.uint64) ^ mix(np.array([doc], np.int64).view(np.uint64))) & np.uint64(size - 1)


def _neighbours(batches):
    """Rows sorted by (one, two, doc_id, row, first): each is compared with the one before. Repeats get the origin they repeat and gram 1, heads keep theirs and -1.

    What is kept between batches is the last row and its head's document, so a hot stretch streams through.
    """
    last, origin = None, -1
    for batch in batches:
        c = [x.to_numpy() for x in batch.columns]
        if not len(c[0]):
            continue
        one, two, doc = c[1:4]
        head = np.ones(len(one), bool)
        head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        head[0] = last != (one[0], two[0])
        at = np.maximum.accumulate(np.where(head, np.arange(len(one)), -1))
        first = np.where(at >= 0, doc[np.maximum(at, 0)], origin)
        last, origin = (one[-1], two[-1]), first[-1]
        yield _batch([*c[:6], np.where(head, -1, first), c[7], np.where(head, -1, 1)], [*_NAMES, "mark"])


def _compared(rows: DataFrame) -> DataFrame:
    """`rows` with mark: 1 for those that repeat an earlier one, -1 for the first of each (one, two).

    Dealt by the whole stretch and not by gram: a gram with very many stretches isn't one task's.
    """
    dealt = rows.where(F.col("origin") == _NONE).repartition("one", "two").sortWithinPartitions("one", "two", "doc_id", "row", "first")
    return dealt.mapInArrow(_neighbours, _ROWS + ", mark int")


_NONE = -(1 << 63)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per maximal repeated passage: doc_id, start_word, n_words, origin.

    start_word counts words (runs of other bytes than white space, case kept) from
    0; `origin` is a document that has (a part of) the passage earlier, by doc_id
    and position; it is the document itself where that repeats its own words. The
    first occurrence of a passage has no row. Null and empty texts and texts of
    fewer than `passage` words have none either. Repeated rows repeat each other.
    Rows of one id are texts of their own, in the order of a hash of the row, and
    spans are of one text each. Ids must not be null (such rows are passed over). An
    empty table gives an empty result. Other columns are not read.
    """
    rows = _numbered(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return _passages(rows.withColumnRenamed("_row", "row"), passage, gram).drop("row")


def _passages(texts: DataFrame, passage: int, gram: int) -> DataFrame:
    """Repeated passages of `texts` (doc_id, text, row), in the order of (doc_id, row, position), each with its row."""
    spark = texts.sparkSession
    texts = in_batches(texts).where("doc_id IS NOT NULL")
    rows = stage(texts.mapInArrow(_stretches(passage, gram), _ROWS), "stretches")
    compared = stage(_compared(rows), "compared")
    # A stretch is contested if its gram has another: only then may windows be shared beside the equal stretches.
    heads = compared.where("mark = -1").select("gram", "one", "two", "doc_id", "first")
    grams = heads.groupBy("gram").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("one", "two")))
    contested = stage(grams.where("min_one <> max_one OR min_two <> max_two").select("gram"), "contested")
    heads = stage(parted(heads, contested, "gram")[1].select("doc_id", "first"), "heads")
    size = 1 << max(16, min(MOST_BITS.bit_length() - 1, (16 * heads.count()).bit_length()))
    bits = spark.sparkContext.broadcast(_bits(heads, size))
    shared = stage(texts.mapInArrow(_windows(passage, gram, bits, size), _ROWS), "windows")
    repeats = lambda df: df.select("doc_id", "row", F.col("first").alias("a"), (F.col("last") + passage).alias("z"), "origin")
    found = repeats(rows.where(F.col("origin") != _NONE))
    for df in (compared.where("mark = 1"), shared.where(F.col("origin") != _NONE), _compared(shared).where("mark = 1")):
        found = found.union(repeats(df))
    return _merged(found)


def _bits(heads: DataFrame, size: int) -> np.ndarray:
    """One bit for each head. Each task ORs its own; at most size / 64 words reach the driver."""

    def words(batches):
        for batch in batches:
            doc, first = (c.to_numpy() for c in batch.columns)
            at = mix(first.astype(np.uint64) ^ mix(doc.view(np.uint64))) & np.uint64(size - 1)
            word, group = np.unique(at >> np.uint64(6), return_inverse=True)
            own = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(own, group, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(own.view(np.int64))], names=["word", "bits"])

    found = heads.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping and touching matches of a row as one; a row's own matches are bounded by its length."""
    by = Window.partitionBy("doc_id", "row").orderBy("a", "z")
    far = F.max("z").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("fresh", F.when(F.col("a") <= far, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("doc_id", "row", "island").agg(F.min("a").alias("start_word"), (F.max("z") - F.min("a")).alias("n_words"), F.min("origin").alias("origin"))
    return merged.select("doc_id", "row", "start_word", "n_words", "origin")


def _cut(batches):
    for batch in batches:
        texts = []
        for data, text, spans in zip(slices(batch["text"]), batch["text"].to_pylist(), batch["_spans"].to_pylist(), strict=True):
            if spans:
                starts, ends = bounds(data)
                raw, kept, at = data.tobytes(), [], 0
                for s in sorted(spans, key=lambda s: s["start_word"]):
                    kept.append(raw[at : starts[s["start_word"]]])
                    at = ends[s["start_word"] + s["n_words"] - 1]
                text = b"".join([*kept, raw[at:]]).decode()
            texts.append(text)
        names = [n for n in batch.schema.names if n != "_spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch[n] for n in names], names=names)


def without_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """`docs` (doc_id, text and any others) with repeated passages cut out of `text`.

    Every row stays, if need be with little text; white space around a cut stays.
    Rows of one id are texts of their own: the first of them, in the order of a
    hash of the row, keeps what the others repeat.
    """
    rows = _numbered(docs)
    found = _passages(rows.select(F.col("doc_id").cast("long"), "text", F.col("_row").alias("row")), passage, gram)
    spans = stage(found.groupBy("doc_id", F.col("row").alias("_row")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans")), "spans")
    whole, cut = parted(rows, spans.select("doc_id"), "doc_id")
    # Merged, though spans may be few: the shuffle keeps parted() and _cut out of one task, which would hold a Python worker for each.
    cut = cut.join(spans.hint("merge"), ["doc_id", "_row"], "left").select(*docs.columns, "_spans")
    return whole.select(*docs.columns).union(cut.mapInArrow(_cut, docs.schema))


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with _row, which tells rows of one id apart: 0 where the id isn't repeated.

    Only rows whose id may be repeated are written; equal rows are in any order.
    """
    again = stage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "again")
    zero = F.lit(0).cast("long")
    if again.isEmpty():
        return docs.withColumn("_row", zero)
    once, many = parted(docs, again, "doc_id")
    keys = ["doc_id", "_hash", "_at"]
    many = many.withColumn("_hash", row_hash(docs)).withColumn("_at", F.monotonically_increasing_id())
    many = many.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    return once.withColumn("_row", zero).union(stage(many.select(*docs.columns, "_row"), "numbered"))
