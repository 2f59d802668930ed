r"""Chat formatting by prefix-target expansion: one example per assistant turn, with all turns before it as context.

A turn is written as ``<s>role\ntext</s>``. Inside roles and texts a backslash becomes ``\\`` and ``<`` becomes ``\l``,
and in roles a line feed becomes ``\n``, so no control string can occur in them and the writing is reversible. Only the
reply of the last turn is trainable: ``loss_begin`` and ``loss_end`` are its character offsets in the formatted text.
A conversation that does not end with an assistant turn has one more example without a target, so no turn is lost.

Conversations are dealt by conv_id, sorted and streamed, so a task holds one conversation's prefix at a time. An example
repeats its context, as the method has it; a conversation of very many turns costs the square of its length in output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
TARGET = "assistant"
EXAMPLES = "conv_id long, example int, n_turns int, target boolean, last boolean, formatted string, loss_begin long, loss_end long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
_BACK = {"\\\\": "\\", "\\l": "<", "\\n": "\n"}
#: Characters of examples handed on at once.
FLUSH = 2 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\ln]", lambda m: _BACK[m.group()], text) if "\\" in text else text


def write_turn(role: str, text: str) -> str:
    return OPEN + escape(role).replace("\n", "\\n") + "\n" + escape(text) + CLOSE


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text; it must be whole."""
    turns = []
    for piece in formatted.split(CLOSE)[:-1]:
        if not piece.startswith(OPEN):
            raise ValueError("not a formatted conversation")
        role, _, text = piece[len(OPEN) :].partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text), in runs of one conversation each.

    Turns are ordered by turn (nulls first), then role and text; repeated rows stay as turns. Null roles and texts are
    empty. Rows without conv_id form one conversation of their own.
    """
    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [f.split()[0] for f in EXAMPLES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        now: int | None | str = "none yet"
        prefix: list[str] = []
        size = example = since = 0
        waiting: tuple | None = None  # the newest example; it is the last one unless another follows

        def close() -> None:
            nonlocal waiting, held
            if waiting:
                out.append((*waiting[:4], True, *waiting[5:]) if not since else waiting)
                held += len(waiting[5])
            if since:
                text = "".join(prefix)
                out.append((now, example, len(prefix), False, True, text, len(text), len(text)))
                held += len(text)
            waiting = None

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    close()
                    now, prefix, size, example, since = conv, [], 0, 0, 0
                turn = write_turn(role or "", text or "")
                prefix.append(turn)
                size += len(turn)
                since += 1
                if role == TARGET:
                    if waiting:
                        out.append(waiting)
                        held += len(waiting[5])
                    end = size - len(CLOSE)
                    waiting = (now, example, len(prefix), True, False, "".join(prefix), end - len(escape(text or "")), end)
                    example, since = example + 1, 0
                if held >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, held = [], 0
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return ordered.mapInArrow(run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns and their hash, loss text and its hash, formatted characters.

    ``examples`` comes from ``expand`` in its order. The turns are parsed from the last example, which holds all; the
    loss text is cut from each example by its mask.
    """
    names = [f.split()[0] for f in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chars, formatted, count = hashlib.sha256(), 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, last, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "last", "formatted", "loss_begin", "loss_end"))):
                reply = unescape(text[begin:end])
                loss.update(reply.encode("utf-8"))
                chars, formatted, count = chars + len(reply), formatted + len(text), count + 1
                if last:
                    whole = hashlib.sha256()
                    turns = read_turns(text)
                    for role, said in turns:
                        whole.update(f"{role}\n{said}\n".encode())
                    out.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), formatted, count))
                    loss, chars, formatted, count = hashlib.sha256(), 0, 0, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out))], names)

    return examples.select("conv_id", "last", "formatted", "loss_begin", "loss_end").mapInArrow(run, READ)
