"""Lifecycle and duplicate rules as a keyed fold, in order of arrival.

One key is (tenant, entity, type, subject). Rows of a key are streamed in order;
only its active statements are held. What happens is emitted as rows of versions
and relations, so the state of a statement is its last version.
"""

from __future__ import annotations

import json
import math
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from batonflow import fixed

KEY = ["tenant_id", "entity_id", "type", "subject_key"]
EVENTS = "kind string, id long, other_id long, what string, version int, resolved boolean, created_by string, confidence double"
_PAIRS = {frozenset(p) for p in fixed.CONFLICTING_STANCES}


def stances_conflict(a, b) -> bool:
    return a is not None and b is not None and frozenset((a, b)) in _PAIRS


def cosine(a, b) -> float:
    if a is None or b is None:
        return 0.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


def _bucket(day: date, unit: str):
    return (day.year, day.month) if unit == "month" else (day.year, (day.month - 1) // 3)


def dates_compatible(a: dict, b: dict) -> bool:
    if a["due_date"] == b["due_date"]:
        return True
    units = {x.get("due_date_precision") or "day" for x in (a, b)}
    unit = units.pop()
    days = [date.fromisoformat(str(x["due_date"])) for x in (a, b)]
    return not units and unit in ("month", "quarter") and _bucket(days[0], unit) == _bucket(days[1], unit)


def slots_compatible(a: dict, b: dict) -> bool:
    """No slot is set on both sides with values that differ; free text and precision alone don't count."""
    for key in a.keys() & b.keys() - {"rationale", "due_date_precision"}:
        x, y = a[key], b[key]
        if x is None or y is None or x == y:
            continue
        if key == "extra":
            own = [k for k in x.keys() & y.keys() - {"corrects", "corrects_hint"} if x[k] is not None and y[k] is not None]
            if all(x[k] == y[k] for k in own):
                continue
        elif key == "due_date":
            if dates_compatible(a, b):
                continue
        elif key == "quantity_unit" and (x.lower() in y.lower() or y.lower() in x.lower()):
            continue
        return False
    return True


def rule_of(new: dict, old: dict) -> str:
    """What decides between an arrival and an active sibling that it isn't compatible with."""
    corrects = bool((new["attributes"].get("extra") or {}).get("corrects")) and new["confidence"] >= fixed.CORRECTION
    same_author = new["person_id"] is not None and new["person_id"] == old["person_id"]
    if new["stage"] != old["stage"] and stances_conflict(new["attributes"].get("stance"), old["attributes"].get("stance")):
        return "R1"
    if new["authority"] < old["authority"]:
        return "R2"
    return "R3" if new["valid_from"] > old["valid_from"] and (same_author or corrects) else "R4"


def _replaced(new: dict, old: dict):
    """Events of an arrival and an active sibling that differ: the sibling is active no more, whichever rule holds."""
    rule = rule_of(new, old)
    if rule == "R3":
        old["status"], what, resolved = "superseded", "supersedes", True
    else:
        old["status"] = new["status"] = "conflicting"
        what, resolved = "contradicts", False
    yield ("version", old["id"], None, old["status"], old["version"] + 1, None, rule, None)
    yield ("relation", new["id"], old["id"], what, None, resolved, f"system:lifecycle:{rule}", round(new["confidence"], 2))


def _alike(new: dict, old: dict, same: float, near: float):
    """Events of an arrival and an active sibling that are compatible."""
    close = cosine(new["embedding"], old["embedding"])
    if close >= same:
        canon, copy = (new, old) if new["authority"] >= old["authority"] else (old, new)
        yield ("relation", copy["id"], canon["id"], "duplicate_of", None, True, "system:dedup", round(close, 2))
        yield ("relation", canon["id"], copy["id"], "supported_by", None, True, "system:dedup", round(close, 2))
    elif close >= near:
        yield ("relation", new["id"], old["id"], "duplicate_of", None, False, "system:dedup", round(close, 2))


#: Pairs up to which plain loops are faster than whole arrays; most keys have a statement or two.
FEW = 16


def _compatible(olds: list[dict], news: list[dict]) -> np.ndarray:
    """(old, new): slots_compatible() of each two, found once for each two different texts of attributes."""
    if len(olds) * len(news) <= FEW:
        return np.array([slots_compatible(y["attributes"], x["attributes"]) for x in olds for y in news], bool).reshape(len(olds), len(news))
    kinds, codes = {}, []
    for rows in (olds, news):
        codes.append(np.array([kinds.setdefault(r["text"], (len(kinds), r["attributes"]))[0] for r in rows], np.int64))
    slots = {n: a for n, a in kinds.values()}
    (own_a, at_a), (own_b, at_b) = (np.unique(c, return_inverse=True) for c in codes)
    return np.array([[slots_compatible(slots[y], slots[x]) for y in own_b] for x in own_a], bool).reshape(len(own_a), len(own_b))[at_a][:, at_b]


def _close(olds: list[dict], news: list[dict], near: float) -> np.ndarray:
    """(old, new): whether two embeddings may be as close as `near`, by one product of both blocks."""
    if len(olds) * len(news) <= FEW:
        alike = lambda a, b: a is not None and b is not None and len(a) == len(b) and cosine(a, b) >= near - 1e-9
        return np.array([alike(x["embedding"], y["embedding"]) for x in olds for y in news], bool).reshape(len(olds), len(news))
    out = np.zeros((len(olds), len(news)), bool)
    sizes = {len(r["embedding"]) for r in olds if r["embedding"] is not None} & {len(r["embedding"]) for r in news if r["embedding"] is not None}
    for size in sizes:
        rows = [np.array([i for i, r in enumerate(side) if r["embedding"] is not None and len(r["embedding"]) == size]) for side in (olds, news)]
        a, b = (np.array([side[i]["embedding"] for i in at], float) for side, at in zip((olds, news), rows, strict=True))
        long = [np.maximum(np.linalg.norm(x, axis=1), 1e-300) for x in (a, b)]
        out[np.ix_(*rows)] = (a / long[0][:, None]) @ (b / long[1][:, None]).T >= near - 1e-9
    return out


def meet(olds: list[dict], news: list[dict], same: float, near: float) -> list[tuple]:
    """Events of active statements `olds` and the arrivals `news`, in order of arrival. Changes statuses in place.

    The first arrival that isn't compatible with an active statement ends its being
    active, so what becomes of one doesn't depend on the other active ones, and those
    of a key can be gone through in blocks of any size.
    """
    if not olds or not news:
        return []
    fits = _compatible(olds, news)
    first = np.where(fits.all(axis=1), len(news), (~fits).argmax(axis=1))
    out = []
    for i, j in zip(*np.nonzero(_close(olds, news, near) & (np.arange(len(news)) < first[:, None])), strict=True):
        out += _alike(news[j], olds[i], same, near)
    for i in np.flatnonzero(first < len(news)):
        out += _replaced(news[first[i]], olds[i])
    return out


def settle(news: list[dict], same: float, near: float) -> list[tuple]:
    """Events of a block of arrivals among themselves, after meet() with all that was active before: also the version that each is created with."""
    if len(news) == 1:
        return [("version", news[0]["id"], None, news[0]["status"], 1, None, "created", None)]
    fits, close, active, out = _compatible(news, news), _close(news, news, near), [], []
    for k, new in enumerate(news):
        left = []
        for i in active:
            if fits[i, k]:
                out += _alike(new, news[i], same, near) if close[i, k] else ()
                left.append(i)
            else:
                out += _replaced(new, news[i])
        out.append(("version", new["id"], None, new["status"], 1, None, "created", None))
        active = left + [k] if new["status"] == "active" else left
    return out


#: Arrivals that are folded at a time.
BLOCK = 256


def _row(r) -> dict:
    clean = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else v
    text = r.attributes or "{}"
    return {
        "id": r.id, "authority": r.authority, "stage": clean(r.stage), "person_id": clean(r.person_id), "confidence": r.confidence, "status": r.status,
        "valid_from": r.valid_from, "text": text, "attributes": json.loads(text), "embedding": None if r.embedding is None else [float(x) for x in r.embedding], "version": 1,
    }


def fold(items: DataFrame, same: float = fixed.SAME_TEXT, near: float = fixed.NEAR_TEXT) -> DataFrame:
    """Versions and relations of all items, keys in parallel, each in order of arrival_seq then id.

    Needs id, arrival_seq, stage, authority, person_id, confidence, status (candidate
    or active), valid_from, attributes (JSON text) and embedding beside the key. A
    candidate runs too, and may supersede. Arrivals are taken in blocks; what is held
    of a key is its active statements.
    """
    rows = items.repartition(*KEY).sortWithinPartitions(*KEY, "arrival_seq", "id")
    columns = [c.split()[0] for c in EVENTS.split(", ")]

    def run(frames):
        now, active, news = None, [], []

        def folded():
            nonlocal active, news
            out = meet(active, news, same, near) + settle(news, same, near)
            active, news = [r for r in active + news if r["status"] == "active"], []
            return out

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                key = (r.tenant_id, r.entity_id, r.type, r.subject_key)
                if news and (key != now or len(news) >= BLOCK):
                    out += folded()
                if key != now:
                    now, active = key, []
                news.append(_row(r))
            yield pd.DataFrame(out, columns=columns)
        if news:
            yield pd.DataFrame(folded(), columns=columns)

    cols = [*KEY, "id", "stage", "authority", "person_id", "confidence", "status", "valid_from", "attributes", "embedding"]
    return rows.select(cols).mapInPandas(run, EVENTS)


def states(events: DataFrame) -> DataFrame:
    """(id, status, version): the last version of each statement."""
    last = events.where("kind = 'version'").groupBy("id").agg(F.max(F.struct("version", F.col("what").alias("status"))).alias("m"))
    return last.select("id", "m.status", "m.version")
