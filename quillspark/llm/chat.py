r"""Chat formatting by event-sourced reconstruction.

Logs are dealt by conversation, sorted by sequence and folded one event after another:

* ``message`` opens the turn with its text (and closes the one before);
* ``delta`` adds text to the open turn, or opens one of its role;
* ``edit`` replaces the text of the turn it names by ``target`` (the open one if null);
* ``regenerate`` empties the last assistant turn and what came after it; deltas refill it.

A conversation's turns are then rendered, one piece of text a turn. Turns leave the fold as
soon as no later edit or regeneration can reach them, so that only a log with such events is
held back, up to the last of them. A table of whole turns is a log of ``message`` events.

The template is ``<|role|>\n text <|end|>\n``. A backslash goes before each ``\`` and ``<``
of a text or role (and ``\n``, ``|`` of a role become ``\n``, ``\p``), so that no control
string can come from a text and ``parse`` gives back what ``render`` got. The loss mask
covers the texts of assistant turns, without markers.

Defined results: null texts and roles are empty; a null conversation id is a conversation of
its own; rows of one conversation with the same turn are all kept, ordered by turn (nulls
first), role and text; repeated rows are repeated turns; an empty table gives no
conversation (the query still adds its own); further columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTROL = re.compile(r"[\\<]")
HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
TURN = re.compile(r"<\|([^|\\]*(?:\\.[^|\\]*)*)\|>\n([^\\<]*(?:\\.[^\\<]*)*)<\|end\|>\n", re.S)
LOSS_ROLES = frozenset({"assistant"})


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role, flags=re.S)


def render(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The turn's formatted text and the spans of it under the loss mask."""
    head, body = HEAD.format(escape_role(role)), escape(text)
    return head + body + TAIL, [(len(head), len(head) + len(body))] if role in LOSS_ROLES else []


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; anything else is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Fold:
    """The turns of one conversation, event by event.

    ``settled`` turns can't change any more: a log says by its kinds whether any edit or
    regeneration is still to come, and without them only the last turn stays open.
    """

    turns: list[list[str]] = field(default_factory=list)
    settled: int = 0

    def apply(self, kind: str, role: str, text: str, target: int | None = None) -> None:
        if kind == "message":
            self.turns.append([role, text])
        elif kind == "delta":
            if self.turns and self.turns[-1][0] == role:
                self.turns[-1][1] += text
            else:
                self.turns.append([role, text])
        elif kind == "edit":
            k = len(self.turns) - 1 if target is None else target - self.settled
            if 0 <= k < len(self.turns):
                self.turns[k][1] = text
        elif kind == "regenerate":
            last = max((k for k, t in enumerate(self.turns) if t[0] in LOSS_ROLES), default=None)
            if last is not None:
                del self.turns[last + 1 :]
                self.turns[last][1] = ""
        else:
            raise ValueError(f"unknown event {kind!r}")

    def settle(self) -> list[list[str]]:
        """Hand out all turns but the open one."""
        done = self.turns[:-1]
        del self.turns[:-1]
        self.settled += len(done)
        return done


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *order)


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, seq, kind, role, text, target) into conv_id, turn, role, text."""
    rows = events.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), "kind", "role", "text", F.col("target").cast("long"))
    # where the last event that reaches back stands
    back = events.filter(F.col("kind").isin("edit", "regenerate")).groupBy(F.col("conv_id").cast("long").alias("_conv")).agg(F.max(F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63)))).alias("_last"))
    rows = rows.join(back, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, started = None, Fold(), False
        done: list[tuple] = []

        def close(key: int | None, turns: list[list[str]], first: int) -> None:
            done.extend((key, first + k, role, text) for k, (role, text) in enumerate(turns))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "role", "text"])

        for batch in batches:
            for conv, seq, kind, role, text, target, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "kind", "role", "text", "target", "_last")), strict=True):
                if started and conv != now:
                    close(now, state.turns, state.settled)
                    state = Fold()
                now, started = conv, True
                state.apply(kind or "message", role or "", text or "", target)
                if last is None or (seq is not None and seq > last):
                    first = state.settled
                    close(conv, state.settle(), first)
            yield out()
        if started:
            close(now, state.turns, state.settled)
        yield out()

    return _dealt(rows, "seq", "kind", "role", "text").mapInArrow(fold, "conv_id long, turn long, role string, text string")


def as_events(turns: DataFrame) -> DataFrame:
    """The log of whole turns (conv_id, turn, role, text): a ``message`` event for each."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("long").alias("target"))


def format_turns(turns: DataFrame, dealt: bool = False) -> DataFrame:
    """A row for each turn, in order of place: conv_id, place, formatted, loss_from, loss_to (-1: no loss).

    A conversation's text is its rows' ``formatted`` joined by place. ``dealt``: the rows come
    from ``reconstruct``, by conversation and in order, and aren't shuffled again.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = object(), 0
        for batch in batches:
            convs, out = batch.column(0).to_pylist(), []
            for conv, role, text in zip(convs, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, place = conv, 0
                formatted, spans = render(role or "", text or "")
                out.append((conv, place, formatted, *(spans[0] if spans else (-1, -1))))
                place += 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "formatted", "loss_from", "loss_to"])

    rows = rows if dealt else _dealt(rows, "turn", "role", "text")
    return rows.mapInArrow(go, "conv_id long, place long, formatted string, loss_from long, loss_to long")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted turns say when read back, a row for each conversation.

    Takes the rows as ``format_turns`` leaves them (each conversation in one partition, in
    order); reads them as a stream and keeps running digests only.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, rows = None, False, []

        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        state = fresh()

        def close():
            n, turns, loss, text, chars = state
            rows.append((now, n, turns.hexdigest(), loss, text.hexdigest(), chars))

        def flush():
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows.clear()
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for conv, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if started and conv != now:
                    close()
                    state = fresh()
                now, started = conv, True
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a >= 0:
                    said = unescape(formatted[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            yield flush()
        if started:
            close()
            yield flush()

    return formatted.mapInArrow(go, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    return digest(format_turns(reconstruct(as_events(rows.unionByName(own))), dealt=True))
