"""Streams: idempotent enqueueing, the job queue's state, the lifecycle fold and lineage on arriving statements."""

from __future__ import annotations

import heapq
import itertools
import json
import pickle
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from batonflow import fixed
from batonflow.operators import fold, lineage

JOB_STATE = "job_id long, status string, attempts int, run_after double"
FOLD_STATE = "more boolean, kept binary"
#: Rows of a sorted frame that are held at once while frames are merged, and active statements that are read at once.
CHUNK, STATE_CHUNK = 64, 2_000
#: Subjects are dealt by hash to cells, one call of Python each, and within a cell to parts, one entry of state each as long as it has no more than STATE_CHUNK statements. A checkpoint holds for these numbers.
CELLS, PARTS = 1 << 10, 1 << 8
#: Events that are handed back at once.
EVENTS_AT_ONCE = 10_000


def _in_order(frames, by: list[str]):
    """Rows of all frames of a key, in order of `by`, nulls last.

    A key comes in several frames, each full Arrow batch one, and no order holds
    between them. So each is sorted into a file of the task and all are merged: what
    is held is two frames, then CHUNK rows of each. A single frame is only sorted.
    """

    def place(r):
        return [(pd.isna(v), 0 if pd.isna(v) else v) for v in (getattr(r, c) for c in by)]

    def run(file, starts):
        for at in starts:
            file.seek(at)
            yield from pickle.load(file).itertuples(index=False)

    frames = iter(frames)
    first, second = next(frames, None), next(frames, None)
    if first is None:
        return
    if second is None:
        # The common case: a key whose rows are one frame needs no file and no merge.
        yield from (first.sort_values(by) if len(first) > 1 else first).itertuples(index=False)
        return
    with tempfile.TemporaryFile() as file:
        runs = []
        for f in itertools.chain((first, second), frames):
            f, starts = f.sort_values(by), []
            for a in range(0, len(f), CHUNK):
                starts.append(file.tell())
                pickle.dump(f.iloc[a : a + CHUNK], file)
            runs.append(starts)
        yield from heapq.merge(*(run(file, starts) for starts in runs), key=place)


def _one_job(key, frames, state):
    status, attempts, after = state.get if state.exists else ("queued", 0, 0.0)
    for r in _in_order(frames, ["seq", "at", "event"]):
        if r.event == "claim" and status == "queued" and r.at >= after:
            status, attempts = "running", attempts + 1
        elif r.event == "ack" and status == "running":
            status = "done"
        elif r.event == "fail" and status == "running":
            status = "poison" if attempts >= fixed.MAX_ATTEMPTS else "queued"
            if status == "queued":
                after = r.at + (r.retry_after if pd.notna(r.retry_after) else 2.0**attempts)
        elif r.event == "reclaim" and status == "running":
            status = "queued"
    state.update((status, attempts, after))
    yield pd.DataFrame([(key[0], status, attempts, after)], columns=["job_id", "status", "attempts", "run_after"])


def job_states(events: DataFrame) -> DataFrame:
    """A stream of job events (job_id, seq, event, at, retry_after) to the state of each job that has moved."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("job_id").applyInPandasWithState(_one_job, JOB_STATE, "status string, attempts int, run_after double", "update", GroupStateTimeout.NoTimeout)


def enqueue(jobs: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """A job of a key is queued once, however often it arrives. State grows with keys: give jobs a watermark to bound it."""
    return jobs.dropDuplicates([key])


class Fold(StatefulProcessor):
    """The lifecycle fold of the subjects of a cell: their active statements are a map in the state store, by part of the cell, read in chunks.

    A call, a frame and an entry of state cost some milliseconds whatever they hold, and most
    subjects have a statement or two, so subjects share them. A part is read when a subject
    of it has arrivals. A block of arrivals of a subject meets the part's chunks one after the
    other, so what is held is one block and one chunk, however many statements are active.
    """

    columns = [c.split()[0] for c in fold.EVENTS.split(", ")]

    def init(self, handle) -> None:
        self.active = handle.getMapState("active", "part int, chunk int", FOLD_STATE)

    def handleInputRows(self, key, rows, timerValues):
        self.at = self.chunk = None  # the chunk that is held, [more, statements, changed], and its place
        out, news, now = [], [], None
        for r in _in_order(rows, ["part", *fold.KEY, "arrival_seq", "id"]):
            subject = (int(r.part), *(None if pd.isna(v) else v for v in (getattr(r, c) for c in fold.KEY)))
            if news and (subject != now or len(news) >= fold.BLOCK):
                out += self._block(now, news)
                news = []
                if len(out) >= EVENTS_AT_ONCE:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
            now = subject
            news.append(fold._row(r))
        if news:
            out += self._block(now, news)
        self._keep()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _block(self, now: tuple, news: list[dict]) -> list[tuple]:
        """Events of arrivals `news` of the subject `now`, which begins with its part."""
        part, subject = now[0], now[1:]
        out, n, room = [], 0, None
        while chunk := self._hold(part, n):
            olds = [self._read(kept) for kept in chunk[1] if kept[0] == subject]
            out += fold.meet(olds, news, fixed.SAME_TEXT, fixed.NEAR_TEXT)
            if gone := {o["id"] for o in olds if o["status"] != "active"}:
                chunk[1], chunk[2] = [kept for kept in chunk[1] if kept[0] != subject or kept[1] not in gone], True
            if room is None and len(chunk[1]) < STATE_CHUNK:
                room = n
            n += 1
            if not chunk[0]:
                break
        out += fold.settle(news, fixed.SAME_TEXT, fixed.NEAR_TEXT)
        left = [self._kept(subject, r) for r in news if r["status"] == "active"]
        while left:
            if room is None:
                if n:
                    chunk = self._hold(part, n - 1)
                    chunk[0] = chunk[2] = True
                    self._keep()
                self.at, self.chunk, room, n = (part, n), [False, [], True], n, n + 1
            chunk = self._hold(part, room)
            space = STATE_CHUNK - len(chunk[1])
            if space > 0:
                chunk[1], chunk[2], left = chunk[1] + left[:space], True, left[space:]
            room = room + 1 if chunk[0] else None
        return out

    def _hold(self, part: int, n: int) -> list | None:
        """A part's chunk, read if it isn't the one that is held; None if there is none."""
        if self.at != (part, n):
            self._keep()
            found = self.active.getValue((part, n))
            self.at, self.chunk = (part, n), None if found is None else [found[0], pickle.loads(found[1]), False]
        return self.chunk

    def _keep(self) -> None:
        """Writes the chunk that is held, if it has changed."""
        if self.chunk is not None and self.chunk[2]:
            more, kept, _ = self.chunk
            if kept or more or self.at[1]:
                self.active.updateValue(self.at, (more, pickle.dumps(kept, protocol=5)))
            elif self.active.containsKey(self.at):
                self.active.removeKey(self.at)
        self.at = self.chunk = None

    @staticmethod
    def _kept(subject: tuple, r: dict) -> tuple:
        vector = None if r["embedding"] is None else np.array(r["embedding"], np.float32).tobytes()
        person = None if r["person_id"] is None else int(r["person_id"])
        return (subject, int(r["id"]), int(r["authority"]), r["stage"], person, float(r["confidence"]), r["version"], r["valid_from"].value, r["text"], vector)

    @staticmethod
    def _read(kept: tuple) -> dict:
        _, number, authority, stage, person, confidence, version, at, text, vector = kept
        return {
            "id": number, "authority": authority, "stage": stage, "person_id": person, "confidence": confidence, "status": "active", "version": version,
            "valid_from": pd.Timestamp(at), "text": text, "attributes": json.loads(text), "embedding": None if vector is None else np.frombuffer(vector, np.float32).astype(float).tolist(),
        }

    def close(self) -> None:
        pass


def fold_stream(items: DataFrame) -> DataFrame:
    """The lifecycle fold on a stream, as operators.fold has it on a table.

    Statements of an earlier time are compared when they arrive, never dropped. The
    session's state store must be RocksDB's: see `with_state`.
    """
    place = F.xxhash64(*fold.KEY)
    dealt = with_state(items).withColumns({"cell": F.pmod(place, F.lit(CELLS)).cast("int"), "part": F.pmod(F.shiftright(place, 20), F.lit(PARTS)).cast("int")})
    return dealt.groupBy("cell").transformWithStateInPandas(Fold(), fold.EVENTS, "Append", "None")


def with_state(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on keeps streams' state in RocksDB, on disk and in the checkpoint."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def lineage_stream(items: DataFrame, reach: str | None = None, delay: str | None = None) -> DataFrame:
    """(from_id, to_id) on a stream: lineage.edges() of all that arrives, in whatever order.

    A join of the stream with itself: both sides are kept, so an upstream statement
    that comes after its downstream ones is linked to them when it comes. By default
    nothing is ever dropped and state grows with the statements. With `reach` (how
    much older an upstream statement may be, such as "72 hours") and `delay` (how late
    anything may come) state older than both is removed.

    Needs the columns of lineage.GROUP, id, stage and valid_from.
    """
    pairs = F.create_map(*[x for down in sorted({d for _, d in fixed.STAGE_PAIRS}) for x in (F.lit(down), F.array(*[F.lit(u) for u, d in fixed.STAGE_PAIRS if d == down]))])
    at = F.col("valid_from").cast("timestamp")
    down = with_state(items).select(*lineage.GROUP, F.col("id").alias("from_id"), at.alias("at"), F.explode(pairs[F.col("stage")]).alias("stage"))
    up = items.select(*(F.col(c).alias(f"_{c}") for c in [*lineage.GROUP, "stage"]), F.col("id").alias("to_id"), at.alias("before"))
    if delay:
        down, up = down.withWatermark("at", delay), up.withWatermark("before", delay)
    met = (F.col("before") < F.col("at")) & (F.expr(f"before >= at - INTERVAL {reach}") if reach else F.lit(True))
    for c in [*lineage.GROUP, "stage"]:
        met &= F.col(c) == F.col(f"_{c}")
    return down.join(up, met).select("from_id", "to_id")


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, run to its end into a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(*stream.columns)


def collect_parts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that a stream has now, appended to a table with exactly-once commits."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
