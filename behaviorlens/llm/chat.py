"""Chat formatting with a grammar that gives every turn back.

A conversation is a run of turns, each `OPEN header text CLOSE` in the template's own control
strings, with `<s>` before and `</s>` after the whole:

    conversation := "<s>" turn* "</s>"
    turn         := "[INST]" role "\\n" text "[/INST]"       a turn that isn't trained on
                  | "[OUT]" role "\\n" text "[/OUT]"         a turn under the loss mask

Inside a turn, role and text are escaped: a backslash says that the next character is itself. A
turn is first rendered as it is, and parsed again. If what comes back is not its source, its
control strings are escaped; if that still isn't identical, as where the text has backslashes of
its own, every special character is. The last level is always identical, and the parser needs no
hint which level a turn has: each reads the same grammar.

Turns are rendered one by one, to one part each, so a conversation of any length takes the memory
of its longest turn. The reader takes the parts as a stream and holds digests, not conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, END = "<s>", "</s>"
PLAIN, TRAINED = ("[INST]", "[/INST]"), ("[OUT]", "[/OUT]")
CONTROL = (BEGIN, END, *PLAIN, *TRAINED)

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_SPECIAL = re.compile(r"[\\<\[\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TOKEN = re.compile(r"\\.|\n|" + "|".join(map(re.escape, CONTROL)), re.S)

#: conv_id null is a conversation of its own; `part` orders the parts of a conversation.
PARTS_DDL = "conv_id bigint, part bigint, text string, spans array<struct<start: bigint, stop: bigint>>, level int"
TURNS_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class GrammarError(ValueError):
    """The text isn't one that the renderer could have made."""


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: a backslash before control strings; 2: before every special character."""
    if level == 0:
        return text
    return (_CONTROL if level == 1 else _SPECIAL).sub(r"\\\g<0>", text)


def parse_turn(text: str, at: int = 0) -> tuple[str, str, bool, int, tuple[int, int]]:
    """The turn that starts at `at`: role, text, whether it is trained on, where it ends, span of its raw text."""
    for opening, closing in (PLAIN, TRAINED):
        if not text.startswith(opening, at):
            continue
        start, head = at + len(opening), None
        for m in _TOKEN.finditer(text, start):
            if m[0] == "\n" and head is None:
                head = m.start()
            elif m[0] == closing and head is not None:
                return unescape(text[start:head]), unescape(text[head + 1 : m.start()]), opening == TRAINED[0], m.end(), (head + 1, m.start())
            elif m[0] in CONTROL:
                raise GrammarError(f"{m[0]} inside a turn")
        raise GrammarError("a turn without an end")
    raise GrammarError("no turn here")


def render_turn(role: str, text: str, trained: bool) -> tuple[str, tuple[int, int], int]:
    """The rendered turn, the span of its raw text, and the level at which it comes back identical."""
    opening, closing = TRAINED if trained else PLAIN
    for level in (0, 1, 2):
        turn = f"{opening}{escape(role, level)}\n{escape(text, level)}{closing}"
        try:
            got = parse_turn(turn)
        except GrammarError:
            continue
        if got[:4] == (role, text, trained, len(turn)):
            return turn, got[4], level
    raise AssertionError("the last level always comes back")


def _render(trained_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        part = 0
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                role, text = role or "", text or ""
                if conv_id != now or now is run:
                    if now is not run:
                        out.append((now, part, END, [], 0))
                    out.append((conv_id, 0, BEGIN, [], 0))
                    now, part = conv_id, 1
                turn, span, level = render_turn(role, text, role == trained_role)
                out.append((conv_id, part, turn, [{"start": span[0], "stop": span[1]}] if role == trained_role else [], level))
                part += 1
            yield _parts(out)
        if now is not run:
            yield _parts([(now, part, END, [], 0)])

    return run


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int32()]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "part", "text", "spans", "level"])


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Parts of the formatted conversations: conv_id, part, text, spans (the loss mask), level.

    The text of a conversation is that of its parts in order; spans are code points of the part,
    still escaped. `turns` has conv_id, turn, role and text; other columns are ignored. Rows are
    taken by turn, a null turn first, equal turns by role and text; null role or text is empty,
    rows with a null conv_id are one conversation, and repeated rows are turns of their own. An
    empty table gives no parts. A conversation is one stream in one task, as its order asks.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_render(trained_role), PARTS_DDL)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    n_turns = loss_chars = chars = 0
    turns = loss = None
    for batch in batches:
        out = []
        for conv_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            chars += len(text)
            if text == BEGIN:
                if turns is not None:
                    raise GrammarError("a conversation without an end")
                n_turns, loss_chars, chars, turns, loss = 0, 0, len(text), hashlib.sha256(), hashlib.sha256()
            elif turns is None:
                raise GrammarError("a turn outside a conversation")
            elif text == END:
                out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                turns = loss = None
            else:
                at = 0
                while at < len(text):
                    role, body, trained, at, _ = parse_turn(text, at)
                    n_turns += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for span in spans:
                    masked = unescape(text[span["start"] : span["stop"]])
                    loss_chars += len(masked)
                    loss.update(masked.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names)
    if turns is not None:
        raise GrammarError("a conversation without an end")


def read_conversations(parts: DataFrame) -> DataFrame:
    """One row per formatted conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Everything comes from the formatted text and its spans; a text outside the grammar raises GrammarError.
    """
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "text", "spans")
    return rows.mapInArrow(_read, TURNS_DDL)
