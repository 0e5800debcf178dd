"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic parser reads the
rendered turn back; while the turn it recovers is not the source, the conflicting content is
escaped and rendered again. An escape puts one more backslash between ``<`` and ``|``, and the
parser takes one away, so any text can be written, texts that hold escapes included.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPES = {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE_ESCAPES[m[0]], unescape(role))


class ParseError(ValueError):
    pass


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: role, text, and the span of the (escaped) text in it.

    Reads left to right with one possible reading; raises ``ParseError`` for anything else.
    """
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ParseError(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        end = rendered.find(END, line)
        role, text = rendered[at + len(START):line], rendered[line + 1:end]
        if line < 0 or end < 0 or rendered[end + len(END):end + len(END) + 1] != "\n":
            raise ParseError(f"the turn at {at} does not end")
        if START in role or END in role or START in text:
            raise ParseError(f"control string inside the turn at {at}")
        turns.append((unescape_role(role), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """A turn that the parser reads back as exactly ``role`` and ``text``.

    Content that already survives stays as it is; the text is escaped first, then the role too.
    """
    for role_part, text_part in (
        (role, text), (role, escape(text)), (escape_role(role), escape(text)),
    ):
        rendered = f"{START}{role_part}\n{text_part}{END}\n"
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered
        except ParseError:
            pass
    raise AssertionError("escaping always round-trips")


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, rendered, loss_from, loss_to), one for each turn; no shuffle.

    Concatenated in the order of a conversation's turns, ``rendered`` is its formatted text. The
    loss mask is the span from ``loss_from`` to ``loss_to`` in ``rendered``: the text of an
    assistant, empty for others. Null texts and roles count as empty; null ids and turns are kept.
    """
    def run(batches):
        for batch in batches:
            out, begin, finish = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out.append(rendered := render(role or "", text or ""))
                (role_read, _, a, b), = parse(rendered)
                learned = role_read == LEARNED_ROLE
                begin.append(a if learned else 0)
                finish.append(b if learned else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()),
                 pa.array(begin, pa.int64()), pa.array(finish, pa.int64())],
                names=["conv_id", "turn", "rendered", "loss_from", "loss_to"],
            )

    chosen = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text")
    )
    return map_batches(
        chosen, run, "conv_id long, turn long, rendered string, loss_from long, loss_to long"
    )


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, a: int, b: int) -> None:
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        learned = unescape(rendered[a:b])
        self.loss_chars += len(learned)
        self.loss.update(learned.encode())
        self.chars += len(rendered)

    def row(self):
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What reading the formatted text back gives, one row for each conversation.

    Turns are dealt by conversation and sorted there; a task streams through them and keeps the
    state of one conversation, never its turns, so a very long conversation needs no memory (a
    SHA-256 is a chain over all of its text, so one task has to read it). Equal turn numbers are
    read in the order of their rendered text; a null turn comes first; null ids are one conversation.
    """
    names = [f.split()[0] for f in _DIGEST.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    def run(batches):
        state, rows = None, []
        for batch in batches:
            for conv_id, rendered, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        rows.append(state.row())
                    state = _Digest(conv_id)
                state.add(rendered, a, b)
            if len(rows) > 4096:
                yield batch_of(rows)
                rows = []
        if state is not None:
            yield batch_of([*rows, state.row()])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return map_batches(dealt.select("conv_id", "rendered", "loss_from", "loss_to"), run, _DIGEST)
