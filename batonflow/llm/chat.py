"""Chat formatting: a finite-state machine over roles and a declarative template.

Every turn becomes segments (text, loss). Control strings inside texts are
escaped, so the output can be read back without loss.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """What opens a conversation, what stands around a turn of each role, and which roles are learnt.

    A role that the template doesn't name is written by `other`, its name escaped.
    """

    begin: str = "<s>"
    around: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")})
    other: tuple = ("[ROLE]", "[SEP]", "[/ROLE]")
    learnt: frozenset = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        around = [x.strip() for pair in self.around.values() for x in pair if x.strip()]
        return list(dict.fromkeys([self.begin, *around, *self.other]))


#: state -> role -> next state. A role without an entry is out of order; the machine then goes on from `after`.
MACHINE = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
AFTER = {"system": "told", "user": "asked", "assistant": "answered"}
FINAL = frozenset({"answered"})


class Codec:
    """Escapes, formats and reads back single turns of one template."""

    def __init__(self, template: Template):
        self.t = template
        self._control = re.compile("|".join(map(re.escape, sorted(template.controls, key=len, reverse=True))))

    def escape(self, text: str) -> str:
        """Backslashes are doubled and one is put after the first character of each control string."""
        return self._control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def format(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        a, z = self.t.around.get(role) or (self.t.other[0] + self.escape(role) + self.t.other[1], self.t.other[2])
        return [((self.t.begin if first else "") + a, False), (self.escape(text), role in self.t.learnt), (z, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one formatted turn."""
        body = formatted.removeprefix(self.t.begin)
        open_, between, close = self.t.other
        if body.startswith(open_):
            role, _, text = body[len(open_) :].partition(between)
            return self.unescape(role), self.unescape(text.removesuffix(close))
        # The longest opening first: an opening may be the start of another's.
        for role, (a, z) in sorted(self.t.around.items(), key=lambda x: -len(x[1][0])):
            if body.startswith(a) and body.endswith(z):
                return role, self.unescape(body[len(a) : len(body) - len(z)])
        raise ValueError("not a formatted turn")


def format_conversations(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in order: conv_id, turn_no (from 0), segments, in_order, state.

    Rows of a conversation lie together and in order in one partition, and are
    streamed: a conversation of any length takes a constant amount of memory.
    Order: turn (nulls first), then role, then text, so ties are settled. Null
    text and null role are read as empty; a null conv_id is one conversation. A
    turn out of order is formatted and marked, never dropped. Other columns go.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), blank(role).alias("role"), blank(text).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        codec, now, state, no = Codec(template), object(), "start", 0
        for batch in batches:
            out = []
            for c, r, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != now:
                    now, state, no = c, "start", 0
                to = MACHINE.get(state, {}).get(r)
                state = to or AFTER.get(r, state)
                out.append((c, no, [{"text": t, "loss": loss} for t, loss in codec.format(r, x, no == 0)], to is not None, state))
                no += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out) if out else [[]] * 5, _FORMATTED, strict=True)], names=["conv_id", "turn_no", "segments", "in_order", "state"])

    return rows.mapInArrow(run, f"conv_id long, turn_no long, segments {SEGMENTS}, in_order boolean, state string")


_FORMATTED = [pa.int64(), pa.int64(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])), pa.bool_(), pa.string()]
_DIGESTS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of the turns that the output of format_conversations says, read from its text and loss flags.

    To be applied to that output itself, whose rows lie in order. `valid`: every
    turn came in order and the last one answered.
    """

    def run(batches):
        codec, now, s = Codec(template), object(), None
        row = lambda: (now, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"], s["ok"] and s["state"] in FINAL)
        for batch in batches:
            out = []
            for c, _, segments, ok, state in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != now:
                    if s:
                        out.append(row())
                    now, s = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "ok": True}
                whole = "".join(x["text"] for x in segments)
                role, text = codec.read(whole)
                learnt = codec.unescape("".join(x["text"] for x in segments if x["loss"]))
                s["turns"].update(f"{role}\n{text}\n".encode())
                s["loss"].update(learnt.encode())
                s |= {"n": s["n"] + 1, "chars": s["chars"] + len(learnt), "all": s["all"] + len(whole), "ok": s["ok"] and ok, "state": state}
            yield _digests(out)
        if s:
            yield _digests([row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _digests(rows: list) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows) if rows else [[]] * 7, _DIGESTS, strict=True)], names=names)
