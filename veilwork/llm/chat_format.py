"""Chat formatting by a finite-state machine over roles and a declarative template.

The template is data: what stands before and after a turn of each role, and which roles' texts carry
loss. The machine reads a conversation's roles in turn order: an optional system turn, then user and
assistant in alternation, ending after an assistant. It labels each conversation `ok` or with the first
fault; faulty conversations are formatted all the same and the caller decides about them.

Control strings inside texts are escaped, whatever the template: of what stands before a turn of a known role and
of what stands after a turn, the first two characters that are no blanks are a guard (`<|` in the default
template). Every first character of a guard, then k back-slashes, then the second gets one back-slash more, so no
text holds a control string, and taking one away restores it. Roles are written likewise, and with back-slashes, line
feeds and the character that ends a role in the template escaped too.

Defined cases: rows are ordered by turn (null first), then role, then text, so ties are stable; a null
role or text is empty; rows with a null conv_id make up one conversation with a null id; repeated rows
are turns of their own; texts of any length are whole; a conversation is one row, gathered by one task; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROLES = ("system", "user", "assistant")


@dataclass(frozen=True)
class Template:
    """{role} stands for the turn's role in the text before it."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))

    def __post_init__(self) -> None:
        if self.before.count("{role}") != 1 or not self.tail:
            raise ValueError("`before` needs {role} once, and something behind it")
        if any(len(x) < 2 or "\\" in x for x in self.guards):
            raise ValueError("control strings need two characters besides blanks to begin with, no back-slashes")

    @property
    def head(self) -> str:
        return self.before.split("{role}")[0]

    @property
    def tail(self) -> str:
        return self.before.split("{role}")[1]

    @cached_property
    def guards(self) -> list[str]:
        return sorted({x.strip()[:2] for x in (self.after, *(self.before.replace("{role}", r) for r in ROLES))})

    @cached_property
    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """What gets a back-slash more, and one less. A first character at a text's end is guarded if it is a second one too."""
        stops = {g: re.escape(g[1]) + ("|$" if g[0] == g[1] else "") for g in self.guards}
        any_of = lambda form: re.compile("|".join(form.format(re.escape(g[0]), stop) for g, stop in stops.items()))
        return any_of(r"(?<={0})(?=\\*(?:{1}))"), any_of(r"(?<={0})\\(?=\\*(?:{1}))")


CHAT = Template()

#: state -> role -> next state; a role that is not listed is a fault.
MACHINE: dict[str, dict[str, str]] = {
    "start": {"system": "opened", "user": "asked"},
    "opened": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
FINAL = {"answered"}

def escape(text: str, template: Template = CHAT) -> str:
    return template.patterns[0].sub(r"\\", text)


def unescape(text: str, template: Template = CHAT) -> str:
    return template.patterns[1].sub("", text)


def escape_role(role: str, template: Template = CHAT) -> str:
    out = role.replace("\\", "\\\\").replace("\n", "\\n")
    end = template.tail[0]
    return escape(out if end == "\n" else out.replace(end, f"\\u{ord(end):06x}"), template)


def unescape_role(role: str, template: Template = CHAT) -> str:
    spelled = lambda m: {"n": "\n", "\\": "\\"}.get(m[1]) or chr(int(m[1][1:], 16))
    return re.sub(r"\\(\\|n|u[0-9a-f]{6})", spelled, unescape(role, template))


def verdict(roles: list[str]) -> str:
    state = "start"
    for k, role in enumerate(roles):
        if role not in MACHINE[state]:
            return f"turn {k}: {role or 'no role'} after {state}"
        state = MACHINE[state][role]
    return "ok" if state in FINAL else f"ends after {state}"


def segments(turns: list[tuple[str, str]], template: Template = CHAT) -> list[tuple[str, bool]]:
    """(text, loss flag) pieces whose texts, one after another, are the formatted conversation."""
    out = []
    for role, text in turns:
        out.append((template.before.replace("{role}", escape_role(role, template)), False))
        if text:
            out.append((escape(text, template), role in template.loss_roles))
        out.append((template.after, False))
    return out


def parse(formatted: str, template: Template = CHAT) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    head, tail = template.head, template.tail
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(head, at):
            raise ValueError(f"no turn begins at {at}")
        role_end = formatted.index(tail, at + len(head))
        text_end = formatted.index(template.after, role_end + len(tail))
        out.append((unescape_role(formatted[at + len(head) : role_end], template), unescape(formatted[role_end + len(tail) : text_end], template)))
        at = text_end + len(template.after)
    return out


SEGMENTS = "conv_id long, verdict string, segments array<struct<text: string, loss: boolean>>"


def format_chats(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, verdict, segments; one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                chats = [[(t["role"], t["text"]) for t in chat] for chat in part.column(1).to_pylist()]
                found = [[{"text": a, "loss": b} for a, b in segments(chat, template)] for chat in chats]
                kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([verdict([r for r, _ in chat]) for chat in chats]), pa.array(found, kind)], ["conv_id", "verdict", "segments"])

    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.mapInArrow(run, SEGMENTS)


def digest_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Reads formatted conversations back: turns, loss text and lengths of what the segments hold; the machine's verdict passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows = []
                for pieces in part.column(2).to_pylist():
                    whole = "".join(p["text"] for p in pieces)
                    turns = parse(whole, template)
                    loss = "".join(unescape(p["text"], template) for p in pieces if p["loss"])
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), part.column(1)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "verdict"])

    return formatted.select("conv_id", "verdict", "segments").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, verdict string")
