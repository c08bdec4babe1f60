"""Ranked lexical search: document shards of CSR postings with integer impacts.

A shard is a run of documents of one task: its distinct terms in order, and for each
of them the documents that hold it. Once the corpus's totals are known, each posting
gets its impact, an integer, so a search only multiplies and adds: term at a time,
into one dense array of a shard's documents. Each task keeps the best of its shards
for every item, with all ties settled by document, and the tasks' best are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from batonflow.llm.text import LOWER, bounds, in_batches, word_hashes
from batonflow.staging import stage

#: Bytes of text of a shard, about: longer only by its last batch or by one long document.
SHARD = 8 << 20
#: Term occurrences of the items that are broadcast for one pass over the shards; more items take more passes.
MOST_TERMS = 1 << 20

# All ASCII characters but digits and letters; what is between them is a term.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_POSTINGS = "ids binary, lengths binary, terms binary, starts binary, docs binary, weights binary"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every occurrence in a batch of texts, terms as hashes of their lower-case bytes; null has none."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    n = len(column)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = LOWER[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data else np.empty(0, np.uint8)
    at -= at[0]
    # A space after each text keeps the terms of neighbours apart.
    raw = np.insert(raw, at[1:], 0x20)
    starts, ends = bounds(raw, BREAK)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.searchsorted(at[1:] + np.arange(1, n + 1), starts, side="right"), word_hashes(raw, starts, ends)


def _postings(row: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(terms ascending, starts, documents, times): CSR over the terms of n documents."""
    terms, number = np.unique(term, return_inverse=True)
    cell, times = np.unique(number.astype(np.int64) * n + row, return_counts=True)
    return terms, np.searchsorted(cell, np.arange(len(terms) + 1) * n), cell % max(1, n), times


def _shards(size: int):
    def shard(ids, row, term):
        n = len(ids)
        terms, starts, docs, times = _postings(row, term, n)
        lengths = np.bincount(row, minlength=n)
        parts = (ids, lengths.astype(np.int64), terms, starts.astype(np.int64), docs.astype(np.int32), times.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=[c.split()[0] for c in _POSTINGS.split(", ")])

    def run(batches):
        held, docs, held_bytes = [], 0, 0
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            row, term = terms_of(text)
            # Documents without an id count in the statistics, under the least number; they are never found.
            held.append((ids.fill_null(_NO_ID).to_numpy(), row + docs, term))
            docs, held_bytes = docs + len(ids), held_bytes + text.nbytes
            if held_bytes >= size:
                yield shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, docs, held_bytes = [], 0, 0
        if held:
            yield shard(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


_NO_ID = -(1 << 63)


def _read(row: dict, *names: str) -> list[np.ndarray]:
    kinds = {"ids": np.int64, "lengths": np.int64, "terms": np.uint64, "starts": np.int64, "docs": np.int32, "weights": np.int32}
    return [np.frombuffer(row[name], kinds[name]) for name in names]


def _impacts(n: int, total: int):
    """Postings with impacts for term frequencies, by the corpus's number of documents and of terms."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, docs, times = _read(row, "lengths", "docs", "weights")
                m = 100 - 25 + (25 * lengths * n) // total
                tf = times.astype(np.int64)
                row["weights"] = ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return run


def _summary(batches):
    """Of each shard: documents with terms, terms with repeats."""
    for batch in batches:
        lengths = [np.frombuffer(x.as_py(), np.int64) for x in batch["lengths"]]
        yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())], names=["n", "total"])


def _counted(batches):
    """(term, documents that hold it) of each shard."""
    for batch in batches:
        for terms, starts in zip(batch["terms"], batch["starts"], strict=True):
            held = np.diff(np.frombuffer(starts.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(held)], names=["term", "df"])


@dataclass
class Index:
    shards: DataFrame  # CSR postings with impacts
    counts: DataFrame  # (term, df): all terms of the corpus
    n: int  # documents with a term
    total: int  # terms with repeats


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> Index:
    """Every row of `docs`, whole: staged shards of postings with their impacts, and each term's document count.

    Null and empty texts have no terms and don't count. Repeated rows are documents
    each; a null id counts in the statistics and is never found. An empty table
    gives an index that finds nothing. Other columns are not read. Shards are written
    and read about one at a time, however many a task has.
    """
    texts = in_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    plain = stage(texts.mapInArrow(_shards(shard), _POSTINGS), "postings", group=shard)
    totals = plain.select("lengths").mapInArrow(_summary, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n, total = int(totals[0] or 0), int(totals[1] or 0)
    counts = plain.select("terms", "starts").mapInArrow(_counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(stage(plain.mapInArrow(_impacts(n, max(1, total)), _POSTINGS), "impacts", group=shard), stage(counts, "terms"), n, total)


def _item_terms(batches):
    for batch in batches:
        row, term = terms_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term.view(np.int64))], names=["item_id", "term"])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0 and their ids, highest first, ties by id: no tie at the border is lost to the partition."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    order = np.lexsort((ids[found], -scores[found]))[:k]
    return ids[found][order], scores[found][order]


def _searched(items, k: int):
    """The best of a task's shards for each item; what is kept is k documents an item."""

    def run(batches):
        item_ids, item_starts, item_terms, item_weights = items.value
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in item_ids]
        for batch in batches:
            for row in batch.to_pylist():
                ids, terms, starts, docs, impacts = _read(row, "ids", "terms", "starts", "docs", "weights")
                if not len(terms):
                    continue
                place = np.minimum(np.searchsorted(terms, item_terms), len(terms) - 1)
                here = terms[place] == item_terms
                known = ids != _NO_ID
                for i in range(len(item_ids)):
                    scores = np.zeros(len(ids), np.int64)
                    own = np.arange(item_starts[i], item_starts[i + 1])
                    for j in own[here[own]]:
                        at = slice(starts[place[j]], starts[place[j] + 1])
                        scores[docs[at]] += item_weights[j] * impacts[at]
                    new, score = best(ids[known], scores[known], k)
                    if len(new):
                        old = kept[i]
                        kept[i] = best(np.concatenate([old[0], new]), np.concatenate([old[1], score]), k)
        times = [len(x[0]) for x in kept]
        if sum(times):
            columns = (np.repeat(item_ids, times), np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["item_id", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    Equal scores go by ascending doc_id. Rows of one item are one query, their terms
    added up; a null item, or one without terms, finds nothing. Items are dealt by
    hash into passes of about `most_terms` terms, which is what a broadcast holds.
    """
    spark, result = items.sparkSession, None
    asked = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    terms = asked.mapInArrow(_item_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = stage(terms.join(index.counts, "term").select("item_id", "term", (weight * F.col("times")).alias("weight")), "asked")
    passes = max(1, -(-weighed.count() // most_terms))
    for i in range(passes):
        rows = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).orderBy("item_id", "term").toArrow()
        ids, starts = np.unique(rows["item_id"].to_numpy(), return_index=True)
        shared = spark.sparkContext.broadcast((ids, np.append(starts, len(rows)), rows["term"].to_numpy().view(np.uint64), rows["weight"].to_numpy()))
        found = index.shards.select("ids", "terms", "starts", "docs", "weights").mapInArrow(_searched(shared, k), "item_id long, doc_id long, score long")
        result = found if result is None else result.union(found)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return result.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
