"""Chat formatting: a template is rendered turn by turn as a black box, and each turn's span is read off the growing output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

#: Earlier turns that are rendered again with each new one. Up to so many turns a conversation is rendered whole each time; a longer
#: one is rendered whole at each doubling and at its end.
CONTEXT = 64

#: Control strings of the instruction template (fixed values).
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_NEEDS = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash doubles, and one goes behind the first character of a control string; none is left whole."""
    return _NEEDS.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruction_template(turns: list[Turn]) -> str:
    """``[INST]`` around what is not the assistant's, ``</s>`` behind what is; roles but user and assistant are named in front."""
    out = []
    for role, text in turns:
        if role == "assistant":
            out.append(f" {escape(text)} </s>")
        elif role == "user":
            out.append(f"<s>[INST] {escape(text)} [/INST]")
        else:
            out.append(f"<s>[INST][ROLE]{escape(role)}[/ROLE]{escape(text)} [/INST]")
    return "".join(out)


class RewritesHistory(ValueError):
    """Adding a turn changed what earlier turns had rendered to."""


def turn_span(template: Template, earlier: list[Turn], turn: Turn) -> tuple[str, int, int]:
    """What ``turn`` adds to the output, and where its text lies in that; the template is only ever called.

    The longer output has to start with the shorter one, else the template rewrites history. Two probe texts that differ in one
    character show where the text starts, and an empty one how long it came out.
    """
    before, role = template(earlier), turn[0]

    def added(text: str) -> str:
        after = template([*earlier, (role, text)])
        if not after.startswith(before):
            raise RewritesHistory(f"turn {len(earlier)} ({role}) changes the output of the turns before it")
        return after[len(before):]

    out, empty, a, b = added(turn[1]), added(""), added("a"), added("b")
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return out, start, start + len(out) - len(empty)


def rendered(template: Template, turns: Iterator[tuple], context: int) -> Iterator[tuple]:
    """``row, piece, start, stop`` for each of one conversation's ``turns``, rows that end in role and text.

    A turn is rendered behind the ``context`` turns before it. When the turns have doubled, and behind the last one, the whole
    prefix is rendered and compared with a running digest of the pieces, before those since the last time are given out. Where the
    two differ, the pieces depend on turns further back: they are taken again, and all later ones, behind the whole prefix, which
    raises :class:`RewritesHistory` if the template rewrites it.
    """
    whole: list[Turn] = []
    waiting: list[tuple] = []
    digest, check, exact = hashlib.sha256(_bytes(template([]))), 2 * context, False

    def settled() -> list[tuple]:
        nonlocal digest, waiting, exact
        before, out = digest.copy(), waiting
        for _, piece, *_ in out:
            digest.update(_bytes(piece))
        if len(whole) > context and not exact and digest.digest() != hashlib.sha256(_bytes(template(whole))).digest():
            exact, digest, first = True, before, len(whole) - len(out)
            out = [(row, *turn_span(template, whole[:first + i], whole[first + i])) for i, (row, *_) in enumerate(out)]
            for _, piece, *_ in out:
                digest.update(_bytes(piece))
        waiting = []
        return out

    for row in turns:
        turn = (row[-2], row[-1])
        waiting.append((row, *turn_span(template, whole if exact else whole[max(0, len(whole) - context):], turn)))
        whole.append(turn)
        if len(whole) == check:
            check *= 2
            yield from settled()
    yield from settled()


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _row(conv_id, turns: Iterator[Turn], template: Template, restore: Callable[[str], str], context: int) -> tuple:
    """One conversation's digest, all of it read back from the output."""
    whole, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = formatted = 0
    for (role, text), out, start, stop in rendered(template, turns, context):
        read_role, read_text = role_of(out), restore(out[start:stop])
        if (read_role, read_text) != (role, text):
            raise ValueError(f"conversation {conv_id}, turn {n}: the output does not give the turn back")
        whole.update(f"{read_role}\n{read_text}\n".encode())
        if read_role == "assistant":
            loss.update(read_text.encode())
            loss_chars += len(read_text)
        formatted += len(out)
        n += 1
    return conv_id, n, whole.hexdigest(), loss_chars, loss.hexdigest(), formatted


def role_of(out: str) -> str:
    """The role of a turn that :func:`instruction_template` rendered."""
    if out.startswith("<s>[INST][ROLE]"):
        return unescape(out[len("<s>[INST][ROLE]"):out.index("[/ROLE]")])
    return "user" if out.startswith("<s>[INST] ") else "assistant"


def spans(turns: DataFrame, template: Template = instruction_template, context: int = CONTEXT) -> DataFrame:
    """``conv_id, turn, role, formatted, start, stop, loss``: each turn's part of the output and its text's place there.

    ``loss`` marks assistant turns. A template that changes earlier output raises :class:`RewritesHistory`.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(_rows(batches), key=lambda r: r[0]):
            out = []
            for (_, turn, role, _), part, start, stop in rendered(template, rows, context):
                out.append((key, turn, role, part, start, stop, role == "assistant"))
                if len(out) == 1000:
                    yield _batch(out, SPANS)
                    out = []
            yield _batch(out, SPANS)

    return _ordered(turns).mapInArrow(cut, SPANS)


SPANS = "conv_id long, turn long, role string, formatted string, start long, stop long, loss boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f[0] for f in fields])


def _ordered(turns: DataFrame) -> DataFrame:
    order = ("conv_id", "turn", "role", "text")
    full = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    return full.repartition("conv_id").sortWithinPartitions(*order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)


def format_digest(turns: DataFrame, template: Template = instruction_template, restore: Callable[[str], str] = unescape, context: int = CONTEXT) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``: digests of what the formatted output gives back.

    Conversations meet by id, sorted by turn, then role and text, and go through a task that holds one at a time; work is linear
    in its length, see :func:`rendered`. Null roles and texts are empty; a null turn comes
    first; a null id is a conversation of its own; repeated rows are turns of their own. An empty table gives no rows. A text
    that a template does not give back, or a template that rewrites history, raises. Other columns are not looked at.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in groupby(_rows(batches), key=lambda r: r[0]):
            out.append(_row(key, ((r[2], r[3]) for r in rows), template, restore, context))
            if len(out) == 5000:
                yield _batch(out, DIGEST)
                out = []
        yield _batch(out, DIGEST)

    return _ordered(turns).mapInArrow(digest, DIGEST)
