"""Token counts: each distinct pre-token is given to the BPE model once.

Documents are read in blocks. A block has a dictionary of its pre-tokens, and each
document's pre-token frequencies in numbers of that dictionary. The dictionaries
are dealt out by pre-token, so equal ones of all blocks meet and are counted in
pieces once; the counts go back to their blocks, and a document's count is the sum
of frequency times pieces. No id of a text is ever made.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from batonflow.llm.bpe import bpe, default_path
from batonflow.llm.text import in_batches
from batonflow.staging import stage

#: A block ends at so many bytes of text: what a task holds and a block's row weigh.
BLOCK_BYTES = 32 << 20
#: Pre-tokens of blocks that a task holds before it packs their counts.
MOST_ROWS = 2_000_000


def squeeze(numbers: np.ndarray) -> bytes:
    """uint32 numbers, mostly small, by byte planes."""
    return zlib.compress(np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


class _Numbers(dict):
    """key -> its number, in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Block:
    def __init__(self):
        self.chunks, self.size = _Numbers(), 0
        self.ids, self.bytes, self.chunk, self.times = [], [], [], []

    def add(self, doc_id, text: str, coder) -> None:
        at, n = np.unique(np.fromiter(map(self.chunks.__getitem__, coder.chunks(text)), np.uint32), return_counts=True)
        size = len(text) if text.isascii() else len(text.encode())
        self.ids.append(doc_id)
        self.bytes.append(size)
        self.chunk.append(at)
        self.times.append(n.astype(np.uint32))
        self.size += size

    def row(self, name: int, coder) -> dict:
        """Per document, chunk frequencies become frequencies of the chunks' pre-tokens."""
        words, own, lengths = _Numbers(), [], []
        for chunk in self.chunks:
            # A special string is one token; its word is the string, which no pre-token can be.
            found = [chunk] if chunk in coder.specials else coder.words(chunk)
            own += map(words.__getitem__, found)
            lengths.append(len(found))
        flat, length = np.array(own, np.int64), np.array(lengths, np.int64)
        begin = np.cumsum(length) - length
        counts, gaps, freqs = [], [], []
        for chunk, times in zip(self.chunk, self.times, strict=True):  # a document at a time: what is held besides is small
            each = length[chunk]
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[chunk], each)
            word, group = np.unique(flat[place], return_inverse=True)
            counts.append(len(word))
            gaps.append(np.diff(word, prepend=0).astype(np.uint32))
            freqs.append(np.bincount(group, weights=np.repeat(times, each), minlength=len(word)).astype(np.uint32))
        none = [np.empty(0, np.uint32)]
        return {
            "block": name, "doc_id": self.ids, "n_bytes": self.bytes, "counts": squeeze(np.array(counts, np.uint32)),
            "gaps": squeeze(np.concatenate(gaps + none)), "freq": squeeze(np.concatenate(freqs + none)), "words": list(words),
        }


_BLOCK = "block long, doc_id array<long>, n_bytes array<long>, counts binary, gaps binary, freq binary, words array<string>"
_SCHEMA = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
    ("counts", pa.binary()), ("gaps", pa.binary()), ("freq", pa.binary()), ("words", pa.list_(pa.string())),
])


def _blocks(path: str):
    def run(batches):
        from pyspark import TaskContext

        coder, block, name = bpe(path), _Block(), count(TaskContext.get().partitionId() << 24)
        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):  # one text is a Python string at a time
                block.add(doc_id, text.as_py() or "", coder)
                if block.size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([block.row(next(name), coder)], _SCHEMA)
                    block = _Block()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(next(name), coder)], _SCHEMA)

    return run


def _pieces(path: str):
    """Equal pre-tokens of all blocks lie in one task: each is counted once. A row for each block seen in MOST_ROWS rows."""

    def run(batches):
        coder = bpe(path)

        class Pieces(dict):
            def __missing__(self, word):
                self[word] = n = 1 if word in coder.specials else len(coder.word_ids(word))
                return n

        pieces, parts, held = Pieces(), [], 0
        for batch in batches:
            n = np.fromiter(map(pieces.__getitem__, batch[2].to_pylist()), np.int64)
            parts.append((batch[0].to_numpy(), batch[1].to_numpy().astype(np.int64), n))
            held += len(n)
            if held >= MOST_ROWS:
                yield packed(parts)
                parts, held = [], 0
        if parts:
            yield packed(parts)

    def packed(parts):
        block, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, block))
        block, at, n = block[order], at[order], n[order]
        cuts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
        rows = [{"block": int(block[a]), "gaps": squeeze(np.diff(at[a:z], prepend=0)), "n": squeeze(n[a:z])} for a, z in zip(cuts, [*cuts[1:], len(block)], strict=True)]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("gaps", pa.binary()), ("n", pa.binary())]))

    return run


def _sums(batches):
    for batch in batches:
        for b in batch.to_pylist():
            found = [(np.cumsum(unsqueeze(x["gaps"])), unsqueeze(x["n"])) for x in b["found"] or []]
            pieces = np.zeros(max((int(at[-1]) for at, _ in found), default=0) + 1, np.int64)
            for at, n in found:
                pieces[at] = n
            counts, gaps, freq = (unsqueeze(b[x]) for x in ("counts", "gaps", "freq"))
            ends = np.cumsum(counts)
            total = np.cumsum(gaps)
            begin = (ends - counts)[counts > 0]
            word = total - np.repeat(total[begin] - gaps[begin], counts[counts > 0])
            sums = np.concatenate([[0], np.cumsum(pieces[word] * freq)])
            n = sums[ends] - sums[ends - counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b["doc_id"], pa.int64()), pa.array(b["n_bytes"], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text is empty: 0 bytes, 0 tokens. Repeated rows and null ids keep a row
    each. An empty table gives an empty result. Other columns are not read.
    `path`: a tokenizers JSON file whose pre-tokens don't span white space.
    """
    path = path or default_path()
    blocks = stage(
        in_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_blocks(path), _BLOCK), "token-blocks"
    )
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    pieces = words.repartition("word").mapInArrow(_pieces(path), "block long, gaps binary, n binary")
    # A row from each task or a few, and a block's dictionary is bounded by BLOCK_BYTES.
    found = pieces.groupBy("block").agg(F.collect_list(F.struct("gaps", "n")).alias("found"))
    whole = blocks.drop("words").join(found, "block", "left").select("doc_id", "n_bytes", "counts", "gaps", "freq", "found")
    return whole.mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
