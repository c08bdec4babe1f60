"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording's spectrum is folded into twelve pitch classes per frame. Rectangle
filters over a window of frames, read from the corners of an integral image, are
quantised to two bits each and packed into one 32-bit integer a frame. Two
recordings that share enough integers get a histogram of the offsets at which
equal integers lie; every offset with enough votes is tested by the share of bits
that differ over the overlap, and the one with least error aligns them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from batonflow.llm.text import LOWER, bounds, in_batches, word_hashes
from batonflow.staging import stage

RATE, FRAME, HOP, WINDOW = 2000, 512, 256, 16
#: Of an alignment: equal integers at its offset, positions of overlap, share of differing bits.
LEAST_VOTES, LEAST_OVERLAP, MOST_ERROR = 4, 8, 0.2
#: An integer's recordings are dealt to so many tasks, so a hot one isn't a task of its own.
SALT = 16
#: Frames, or windows of frames, that are worked on at once: a long recording's spectrum isn't held.
STEP = 2048
#: A frame's parts are whole multiples of 1 / UNIT in the integral image.
UNIT = 4096
#: Of one recording: a hash of its sound, equal for equal recordings (null without sound), and its integers.
PRINT = "struct<one:long,two:long,prints:array<int>>"
_KEY = ["one", "two"]

# Sixteen filters by rule: kind 1 to 5, first class, classes, frames.
_FILTERS = [(i % 5 + 1, (7 * i) % 7, 2 + (5 * i) % 4 + i % 2, 4 + (3 * i) % 13) for i in range(16)]
# Levels near the quartiles, so that each of the four is about as likely, and what is added against silence.
_LEVELS, _FLOOR, _GRAY = (-0.4, 0.0, 0.4), 0.05, np.array([0, 1, 3, 2], np.uint32)


def _folding() -> np.ndarray:
    """Spectrum bins -> pitch classes, 100 to 950 Hz."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for b in np.flatnonzero((hz >= 100) & (hz <= 950)):
        out[b, round(12 * np.log2(hz[b] / 440)) % 12] = 1
    return out


def _corners() -> np.ndarray:
    """What each corner of the integral image over a window adds to the means over the inner and the outer area of each filter."""
    out = np.zeros((WINDOW + 1, 13, 2, len(_FILTERS)))

    def area(part, i, a, z, low, high):
        for t, y, sign in ((z, high, 1), (a, high, -1), (z, low, -1), (a, low, 1)):
            out[t, y, part, i] += sign

    for i, (kind, y, h, w) in enumerate(_FILTERS):
        top, mid_t, mid_y, third_t, third_y = y + h, w // 2, y + h // 2, w // 3, max(1, h // 3)
        area(1, i, 0, w, y, top)
        if kind == 1:
            area(0, i, 0, w, mid_y, top)
        elif kind == 2:
            area(0, i, mid_t, w, y, top)
        elif kind == 3:
            area(0, i, 0, mid_t, y, mid_y)
            area(0, i, mid_t, w, mid_y, top)
        elif kind == 4:
            area(0, i, 0, w, *((y + third_y, top - third_y) if h > 2 else (y, y + 1)))
        else:
            area(0, i, third_t, w - third_t, y, top)
    inner, whole = (out[:, :, part].reshape((WINDOW + 1) * 13, len(_FILTERS)) for part in (0, 1))
    cells = lambda part: np.outer(np.arange(WINDOW + 1), np.arange(13)).ravel() @ part
    return np.hstack([inner / cells(inner), (whole - inner) / cells(whole - inner)])


_FOLD, _HANN, _CORNERS = _folding(), np.hanning(FRAME).astype(np.float32), _corners()


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12), each frame of length one, or zero where it is silent. Too short: no frames."""
    if len(samples) < FRAME:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    for a in range(0, len(frames), STEP):
        found = np.fft.rfft(frames[a : a + STEP] * _HANN)
        out[a : a + STEP] = (found.real.astype(np.float64) ** 2 + found.imag.astype(np.float64) ** 2) @ _FOLD
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each window of frames.

    Frames are rounded to whole units first, so all sums are of integers and exact
    in any order: equal windows give equal integers wherever they stand.
    """
    n = len(frames) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = np.rint(frames * UNIT).cumsum(axis=0).cumsum(axis=1)
    view = np.lib.stride_tricks.sliding_window_view(image, (WINDOW + 1, 13))[:, 0]
    packed = np.zeros(n, np.uint32)
    for a in range(0, n, STEP):
        inner, outer = np.split(np.rint(view[a : a + STEP].reshape(-1, (WINDOW + 1) * 13) @ _CORNERS) / UNIT + _FLOOR, 2, axis=1)
        level = np.digitize(np.log(inner / outer), _LEVELS)
        for i in range(len(_FILTERS)):
            packed[a : a + STEP] = (packed[a : a + STEP] << np.uint32(2)) | _GRAY[level[:, i]]
    return packed.view(np.int32)


def printed(parts: Iterator[np.ndarray]) -> tuple[int | None, int | None, np.ndarray]:
    """(one, two, integers) of a recording that comes in parts, of which one is held at a time."""
    digest, frames, left, heard = hashlib.blake2b(digest_size=16), [], np.empty(0, np.int16), 0
    for part in parts:
        digest.update(part.tobytes())
        heard += len(part)
        samples = np.concatenate([left, part])
        n = max(0, (len(samples) - FRAME) // HOP + 1)
        frames.append(chroma(samples[: (n - 1) * HOP + FRAME]) if n else np.empty((0, 12)))
        left = samples[n * HOP :]
    if not heard:
        return None, None, np.empty(0, np.int32)
    one, two = np.frombuffer(digest.digest(), np.int64)
    return int(one), int(two), fingerprint(np.concatenate(frames))


def _notes() -> np.ndarray:
    """Three octaves from 110 Hz, a note a row, with an overtone; 16-bit samples."""
    phase = 2 * np.pi * np.outer(110 * 2 ** (np.arange(36) / 12), np.arange(HOP)) / RATE
    return (12000 * np.sin(phase) + 4000 * np.sin(2 * phase)).astype(np.int16)


_NOTES = _notes()


def spoken(text: str | None) -> Iterator[np.ndarray]:
    """A stand-in recording of a text, one note a word, by the word; at most STEP words a part."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends = bounds(data)
    if len(starts):
        notes = word_hashes(data, starts, ends) % np.uint64(len(_NOTES))
        for a in range(0, len(notes), STEP):
            yield _NOTES[notes[a : a + STEP].astype(np.int64)].ravel()


def render(text: Column) -> Column:
    """Column of 16-bit little-endian samples at RATE, spoken from a text column."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: b"".join(x.tobytes() for x in spoken(t)))

    return of(text)


def _frame(found) -> pd.DataFrame:
    one, two, prints = zip(*found, strict=True) if found else ([], [], [])
    return pd.DataFrame({"one": pd.array(one, "Int64"), "two": pd.array(two, "Int64"), "prints": list(prints)})


def fingerprints(media: Column) -> Column:
    """PRINT of a media column of 16-bit samples. Null or without a sample: null hashes and no integers; too short: no integers."""

    @F.pandas_udf(PRINT)
    def of(samples: pd.Series) -> pd.DataFrame:
        parts = lambda b: [] if b is None else np.array_split(x := np.frombuffer(b[: len(b) // 2 * 2], np.int16), range(STEP * HOP, len(x), STEP * HOP))
        return _frame([printed(parts(b)) for b in samples])

    return of(media)


def spoken_fingerprints(text: Column) -> Column:
    """PRINT of the recording that is spoken from a text: samples are made, heard and forgotten part by part in one pass."""

    @F.pandas_udf(PRINT)
    def of(texts: pd.Series) -> pd.DataFrame:
        return _frame([printed(spoken(t)) for t in texts])

    return of(text)


def _distinct(batches):
    """(one, print, times, salt): the distinct integers of each class."""
    for batch in batches:
        out = [np.unique(prints.values.to_numpy(), return_counts=True) for prints in batch[1]]
        row = np.repeat(np.arange(len(out)), [len(x) for x, _ in out])
        each, times = (np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int32) for x in (zip(*out, strict=True) if out else ((), ())))
        one = batch[0].to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, each, times, (one % SALT).astype(np.int32))], names=["one", "print", "times", "salt"])


def _correlated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each offset d from 1 - len(a) to len(b) - 1: the sum over i of a[i] * b[i + d]."""
    size = 1 << (len(a) + len(b)).bit_length()
    both = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
    return np.rint(np.concatenate([both[size - len(a) + 1 :], both[: len(b)]])).astype(np.int64)


def histogram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Votes of each offset from 1 - len(a) to len(b) - 1: positions of equal integers. An integer that repeats much is counted by correlation."""
    votes = np.zeros(len(a) + len(b) - 1, np.int64)
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = code[: len(a)], code[len(a) :]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    for x in np.intersect1d(ca, cb):
        pa_, pb = (o[slice(*np.searchsorted(c[o], [x, x + 1]))] for o, c in ((oa, ca), (ob, cb)))
        if len(pa_) * len(pb) <= 1 << 20:
            np.add.at(votes, (pb[None] - pa_[:, None]).ravel() + len(a) - 1, 1)
        else:
            votes += _correlated((ca == x).astype(float), (cb == x).astype(float))
    return votes


def aligned(a: np.ndarray, b: np.ndarray) -> tuple | None:
    """(offset, votes, overlap, error) of the offset with least error, then most votes, then the least; None if none holds."""
    votes = histogram(a, b)
    offsets = np.flatnonzero(votes >= LEAST_VOTES) - (len(a) - 1)
    overlap = np.minimum(len(a), len(b) - offsets) - np.maximum(0, -offsets)
    offsets, overlap = offsets[overlap >= LEAST_OVERLAP], overlap[overlap >= LEAST_OVERLAP]
    if not len(offsets):
        return None
    if len(offsets) <= 512:
        wrong = [np.bitwise_count(a[(lo := max(0, -d)) : lo + n].view(np.uint32) ^ b[lo + d : lo + d + n].view(np.uint32)).sum(dtype=np.int64) for d, n in zip(offsets, overlap, strict=True)]
    else:  # all offsets at once, bit by bit: +1 and -1 agree or don't
        sign = lambda x, k: ((x.view(np.uint32) >> np.uint32(k)) & 1) * 2.0 - 1
        same = sum(_correlated(sign(a, k), sign(b, k)) for k in range(32))[offsets + len(a) - 1]
        wrong = (32 * overlap - same) // 2
    error = np.asarray(wrong) / (32 * overlap)
    best = np.lexsort((offsets, -votes[offsets + len(a) - 1], error))[0]
    if error[best] > MOST_ERROR:
        return None
    return int(offsets[best]), int(votes[offsets[best] + len(a) - 1]), int(overlap[best]), float(error[best])


def _aligned(one: pd.Series, two: pd.Series) -> pd.DataFrame:
    found = [aligned(np.asarray(a, np.int32), np.asarray(b, np.int32)) or (None,) * 4 for a, b in zip(one, two, strict=True)]
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pd.DataFrame({n: pd.array(c, t) for n, c, t in zip(("offset", "votes", "overlap", "error"), columns, ("Int32", "Int64", "Int32", "Float64"), strict=True)})


def align(recordings: DataFrame, asked: Column, key: str = "rec_id", media: str = "print") -> DataFrame:
    """Rows of two kinds: membership of recordings in classes, and alignments between classes.

    `recordings` has `key`, of any type with an order, and `media`, a PRINT; `asked` is a condition
    on its columns that states the queries. Equal recordings are one class, named by
    its smallest key.
    kind "member": rec, class. Every recording with a sound and a key has one.
    kind "link": class is that of a query, found another class that aligns with it;
    offset: positions that `found` is ahead, votes: equal integers at that offset,
    overlap, error: share of differing bits. Of several offsets the one with least error counts.
    Recordings shorter than a window of frames have no integers: equal ones are
    still members of one class, and they have no links. Those with fewer than
    LEAST_OVERLAP integers have no links either, as no overlap suffices.
    Null and empty recordings and rows with a null key take no part. Repeated rows
    are members each. An empty table gives an empty result. Other columns go.
    """
    rows = in_batches(recordings).where(F.col(key).isNotNull()).select(F.col(key).alias("rec"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(media).alias("_media"))
    known = stage(rows.select("rec", "asked", "_media.*").where("one IS NOT NULL"), "recordings")
    # Copies are brought together before their integers are: a hot recording is one row a task.
    heads = known.groupBy(*_KEY).agg(F.min("rec").alias("class"), F.max("asked").alias("asked"))
    heads = stage(heads, "heads")
    prints = stage(known.select(*_KEY, "prints").where(F.size("prints") >= LEAST_OVERLAP).dropDuplicates(_KEY), "prints")
    names = lambda *to: [F.col(c).alias(n) for c, n in zip(_KEY, to, strict=True)]
    wanted = stage(prints.join(heads.where("asked").select(*_KEY), _KEY, "left_semi"), "wanted")
    # Votes carry half of a class's hash: were two classes to share it, they would be tested both, and none be lost.
    spots = wanted.select("one", "prints").mapInArrow(_distinct, "one long, print int, times int, salt int").select(F.col("one").alias("own1"), "print", F.col("times").alias("own_times"))
    dealt = spots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    places = prints.select("one", "prints").mapInArrow(_distinct, "one long, print int, times int, salt int")
    # An integer votes for one offset at most as often as it is in the recording that has it less often.
    # Both sides are exploded, which no estimate of their size knows: they are never broadcast, and hot integers are split.
    met = dealt.hint("merge").join(places.hint("merge"), ["print", "salt"]).where("own1 <> one").groupBy("own1", "one").agg(F.sum(F.least("own_times", "times")).alias("most"))
    pairs = met.where(F.col("most") >= LEAST_VOTES).drop("most")
    both = pairs.join(wanted.select(*names("own1", "own2"), F.col("prints").alias("own_prints")), "own1").join(prints, "one")
    judged = both.withColumn("e", F.pandas_udf(_aligned, "struct<offset:int,votes:long,overlap:int,error:double>")("own_prints", "prints")).where("e.offset IS NOT NULL")
    of = lambda c, to: heads.select(*names(*to), F.col("class").alias(c))
    links = judged.select("own1", "own2", *_KEY, "e.*").join(of("class", ("own1", "own2")), ["own1", "own2"]).join(of("found", _KEY), _KEY)
    empty = F.lit(None)
    members = known.select("rec", *_KEY).join(heads.select(*_KEY, "class"), _KEY)
    return members.select(
        F.lit("member").alias("kind"), "rec", "class", empty.cast(heads.schema["class"].dataType).alias("found"), empty.cast("int").alias("offset"),
        empty.cast("long").alias("votes"), empty.cast("int").alias("overlap"), empty.cast("double").alias("error"),
    ).union(links.select(F.lit("link"), empty.cast(heads.schema["class"].dataType), "class", "found", "offset", "votes", "overlap", "error"))
