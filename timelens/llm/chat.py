"""Chat formatting by a finite-state machine and a declarative template.

A template says what stands before and after the text of each role, and which roles'
texts are learned from. The machine walks over the roles of a conversation: a turn
is in order if its role may follow the state the turn before led to. Turns out of
order are formatted like the others and marked, with the conversation's machine
starting anew from the role's own state.

The output is text segments in order, each with a loss flag: a turn's head, its
text, its tail. Control strings of the template, and the escape sign itself, are
escaped inside texts: the sign is doubled, and it is put behind the first character
of a control string. So no control string stands in an escaped text, and the texts
come back whole.

A conversation's turns meet in one task, in order; the task holds a turn at a time,
so the length of a conversation does not matter for memory.

Defined results: a NULL text is empty. A NULL or unknown role gets the head of the
`other` entry with its name in it, and is out of order. Turns of equal number are
ordered by role and text. Rows without conversation id form one conversation; a row
without turn number comes first. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Role(NamedTuple):
    head: str
    tail: str
    loss: bool
    follows: tuple[str, ...]


class Template(NamedTuple):
    roles: dict[str, Role]
    other_head: str
    """For roles without entry; {} is the role's name, escaped."""
    other_tail: str
    control: tuple[str, ...]
    escape: str


START = ""

INSTRUCT = Template(
    roles={
        "system": Role("<s><<SYS>>\n", "\n<</SYS>>", False, (START,)),
        "user": Role("<s>[INST] ", " [/INST]", False, (START, "system", "assistant")),
        "assistant": Role(" ", "</s>", True, ("user",)),
    },
    other_head="<s><<ROLE>>{}<</ROLE>>\n",
    other_tail="\n<<END>>",
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<END>>"),
    escape="\\",
)


def escape_text(text: str, template: Template = INSTRUCT) -> str:
    sign = template.escape
    out = text.replace(sign, sign + sign)
    found = re.compile("|".join(re.escape(c) for c in sorted(template.control, key=len, reverse=True)))
    while found.search(out):
        out = found.sub(lambda m: m[0][0] + sign + m[0][1:], out)
    return out


def unescape_text(text: str, template: Template = INSTRUCT) -> str:
    return re.sub(re.escape(template.escape) + "(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str | None, text: str | None, template: Template = INSTRUCT) -> list[tuple[str, bool]]:
    """The segments of a turn: (text, whether it is learned from)."""
    known = template.roles.get(role) if role is not None else None
    body = escape_text(text or "", template)
    if known is None:
        name = "-" if role is None else "+" + escape_text(role, template)
        return [(template.other_head.format(name), False), (body, False), (template.other_tail, False)]
    return [(known.head, False), (body, known.loss), (known.tail, False)]


def step(state: str, role: str | None, template: Template = INSTRUCT) -> tuple[str, bool]:
    """The state after a turn, and whether the turn was in order."""
    known = template.roles.get(role) if role is not None else None
    if known is None:
        return START, False
    return role, state in known.follows


_SEGMENTS = "turn_no long, in_order boolean, segments array<struct<text: string, loss: boolean>>"


def _format(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conversation, state, number = object(), START, 0
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
    for batch in batches:
        ids = batch.column(0).to_pylist()
        numbers, orders, segments = [], [], []
        for conv, role, text in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if conv != conversation:
                conversation, state, number = conv, START, 0
            state, fine = step(state, role, template)
            numbers.append(number)
            orders.append(fine)
            segments.append([{"text": t, "loss": on} for t, on in format_turn(role, text, template)])
            number += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(numbers, pa.int64()), pa.array(orders, pa.bool_()), pa.array(segments, kind)],
            ["conv_id", "turn_no", "in_order", "segments"])


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn, turns of a conversation in order in one task: conv_id, turn_no (from 0), in_order, segments."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"),
                                F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(lambda b: _format(template, b), f"conv_id {kind}, {_SEGMENTS}")


def read_turn(segments: list[dict], template: Template = INSTRUCT) -> tuple[str | None, str]:
    """Role and text, from the segments' texts alone."""
    whole = "".join(s["text"] for s in segments)
    before, behind = template.other_head.split("{}")
    if whole.startswith(before):
        name, body = whole[len(before):].split(behind, 1)
        return (None if name == "-" else unescape_text(name[1:], template),
                unescape_text(body[:len(body) - len(template.other_tail)], template))
    for name, role in sorted(template.roles.items(), key=lambda r: -len(r[1].head)):
        if whole.startswith(role.head) and whole.endswith(role.tail):
            return name, unescape_text(whole[len(role.head):len(whole) - len(role.tail)], template)
    raise ValueError("not a turn of this template")


def _read_back(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    conversation, held = None, None
    id_type = None

    def closed() -> pa.RecordBatch:
        turns, all_, chars, loss, formatted, fine = held
        return pa.RecordBatch.from_arrays(
            [pa.array([conversation], id_type), pa.array([turns]), pa.array([all_.hexdigest()]), pa.array([chars]),
             pa.array([loss.hexdigest()]), pa.array([formatted]), pa.array([fine])], names)

    for batch in batches:
        id_type = batch.schema.field(0).type
        for conv, fine, segments in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "in_order", "segments")), strict=True):
            if held is None or conv != conversation:
                if held is not None:
                    yield closed()
                conversation, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
            role, text = read_turn(segments, template)
            held[0] += 1
            held[1].update(f"{role or ''}\n{text}\n".encode())
            for s in segments:
                held[4] += len(s["text"])
                if s["loss"]:
                    learned = unescape_text(s["text"], template)
                    held[2] += len(learned)
                    held[3].update(learned.encode())
            held[5] &= fine
    if held is not None:
        yield closed()


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation what the formatted turns hold; `valid` if all turns are in order.

    Takes the rows as `format_conversations` deals and orders them.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "in_order", "segments").mapInArrow(
        lambda b: _read_back(template, b),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean")
