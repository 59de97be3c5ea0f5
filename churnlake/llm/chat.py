"""Operator 6: chat formatting by a finite-state machine over roles and a declarative template.

Rows are dealt by conversation and sorted by turn inside each partition; both steps stream, so a conversation of any
length needs the memory of one turn. ``format_chats`` emits text segments with a loss flag; joined in order they are
the formatted conversation. ``read_back`` reads segments again, checks the template and undoes the escaping.

The machine has the states start, system, user, assistant; ``ORDER`` lists the roles that may follow. Every
conversation is formatted; a segment tells by ``valid`` whether the turns up to it came in a legal order.

Escaping: a control string is ``<|`` up to ``|>``. In texts and roles ``<``, k backslashes, ``|`` gets one backslash more, and
reading takes one away again, so no text can hold a control string and every text comes back unchanged. A line
feed in a role is written ``<|n|>``.

Defined results: null text and null role are empty; an unknown role is formatted and makes the conversation invalid;
turns that tie are ordered by role, then text; null turns come last; null conv_id is a conversation of its own;
repeated rows are turns of their own; extra columns are ignored; an empty table gives no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: what is written around a turn, and whose texts are trained on.
TEMPLATE = {"open": "<|im_start|>", "head": "\n", "close": "<|im_end|>\n", "loss": ("assistant",)}
#: The roles that may follow a state.
ORDER = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "<|n|>")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|n|>", "\n"))


SEGMENTS = "conv_id long, seg long, part string, text string, loss boolean, valid boolean"


def format_chats(rows: DataFrame, template: dict = TEMPLATE, order: dict = ORDER) -> DataFrame:
    """(conv_id, seg, part, text, loss, valid): an opening, a body and a closing segment per turn, in order."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, seg, valid = object(), "start", 0, True
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if conv != now:
                    now, state, seg, valid = conv, "start", 0, True
                valid = valid and role in order.get(state, ())
                state = role
                out += [(conv, seg, "open", template["open"] + escape_role(role) + template["head"], False, valid), (conv, seg + 1, "body", escape(text), role in template["loss"], valid),
                        (conv, seg + 2, "close", template["close"], False, valid)]
                seg += 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)] if out
                                             else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())], ["conv_id", "seg", "part", "text", "loss", "valid"])

    return rows.mapInArrow(run, SEGMENTS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation, read from the formatted text: digests of its turns and of the text under the loss mask.

    ``segments`` must be as ``format_chats`` leaves them: a conversation in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        done: list[tuple] = []

        def end() -> None:
            if state:
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["valid"]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            cols = list(zip(*done)) or [()] * len(kinds)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            for conv, seg, text, loss, valid in zip(*(batch[c].to_pylist() for c in ("conv_id", "seg", "text", "loss", "valid")), strict=True):
                if seg == 0:
                    end()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "valid": True}
                state["all"] += len(text)
                state["valid"] = valid
                if text.startswith(template["open"]) and seg % 3 == 0:
                    state["n"] += 1
                    state["turns"].update((unescape_role(text[len(template["open"]):len(text) - len(template["head"])]) + "\n").encode())
                elif seg % 3 == 1:
                    plain = unescape(text)
                    state["turns"].update((plain + "\n").encode())
                    if loss:
                        state["chars"] += len(plain)
                        state["loss"].update(plain.encode())
                elif text != template["close"]:
                    raise ValueError(f"conversation {conv}: segment {seg} does not fit the template")
            if done:
                yield flush()
        end()
        yield flush()

    return segments.mapInArrow(run, READ)
