"""Chat formatting with a grammar round trip.

Grammar, for a deterministic parser that reads left to right:

    conversation = { turn }
    turn         = open role line-feed text close
    open, close  = "[INST]", "[/INST]" around turns without loss
                   "<s>",    "</s>"    around assistant turns, which bear loss

The parser ends a role at the first line feed and a text at the first close mark
of its kind, and then takes one backslash out of every escaped control string.
The renderer first writes a turn as it is and parses that again. Where the
recovered turn differs from its source, it escapes the parts that differ, a
backslash more behind the first character of each control string (and in roles
also of backslashes and line feeds), until both are identical.

Turns are formatted and parsed one by one, where their rows stand, so a conversation
that holds a third of all turns is spread over all tasks. What is written names the
code points of each piece that bear loss. Reading parses the written pieces, takes the
text under that mask, and fails if it is not the text that the parser finds in an
assistant turn. Only the digests of a conversation need its turns in order; one task
streams them, with memory for a turn at a time.

Rows: null text or role is empty; turns in the order of (turn, role, text), null
first, which also settles ties; repeated rows are turns of their own; rows with a
null conv_id are one conversation; other columns are ignored; no rows, none out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import materialize, partitions

MARKS = {False: ("[INST]", "[/INST]"), True: ("<s>", "</s>")}
CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>)")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, bool, int, int]]:
    """(role, text, bears loss, start and end of the text as rendered) of each turn."""
    while at < len(text):
        loss = text.startswith("<s>", at)
        opening, closing = MARKS[loss]
        if not text.startswith(opening, at):
            raise ValueError(f"no turn begins at {at}")
        line = text.find("\n", at)
        start = line + 1
        end = text.find(closing, start)
        if line < 0 or end < 0:
            raise ValueError(f"the turn at {at} does not end")
        yield unescape_role(text[at + len(opening) : line]), unescape(text[start:end]), loss, start, end
        at = end + len(closing)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn and the bounds of its text in it; the loop ends because a turn with
    both parts escaped always parses to its source."""
    loss = role == LOSS_ROLE
    opening, closing = MARKS[loss]
    r, t = role, text
    for _ in range(3):
        out = f"{opening}{r}\n{t}{closing}"
        start = len(opening) + len(r) + 1
        try:
            turns = list(parse(out))
        except ValueError:
            turns = []
        if len(turns) == 1 and turns[0][:2] == (role, text) and turns[0][2] == loss:
            return out, start, start + len(t)
        if len(turns) == 1 and turns[0][1] == text:
            r = escape_role(role)
        elif t == text and escape(text) != text:
            t = escape(text)
        else:
            r, t = escape_role(role), escape(text)
    raise ValueError("a turn did not survive its round trip")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles = batch.column("role").to_pylist()
        made = [render_turn(r, t) for r, t in zip(roles, batch.column("text").to_pylist())]
        bears = pa.array([r != LOSS_ROLE for r in roles], pa.bool_())
        ends = [pc.if_else(bears, None, pa.array([m[k] for m in made], pa.int32())) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn")), pa.array([m[0] for m in made], pa.string()), *ends], names=["conv_id", "turn", "piece", "loss_start", "loss_end"])


FORMATTED = "conv_id long, turn long, piece string, loss_start int, loss_end int"


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end): a conversation's pieces, in the order
    of turn, role and text, are its formatted text; the loss mask of an assistant turn
    covers loss_start to loss_end (code points of its piece), others have none."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return turns.mapInArrow(_format, FORMATTED)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Written pieces to (conv_id, turn, role, text, loss, size): one row for each turn,
    loss being the text under the mask, unescaped, or null."""
    for batch in batches:
        rows = []
        for conv, turn, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "piece", "loss_start", "loss_end"))):
            ((role, text, bears, start, end),) = parse(piece)
            if (a, b) != ((start, end) if bears else (None, None)):
                raise ValueError(f"the mask of a turn of conversation {conv} is not that of its text")
            rows.append((conv, turn, role, text, None if a is None else unescape(piece[a:b]), len(piece)))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["conv_id", "turn", "role", "text", "loss", "size"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    open_, state = False, None

    def row(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        done = []
        for conv, role, text, loss, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "size"))):
            if not open_ or conv != state[0]:
                if open_:
                    done.append(row(state))
                open_, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[3] += len(loss)
                state[4].update(loss.encode())
            state[5] += size
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(state), types)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the rows of format_turns() alone, read again
    from files in any order."""
    turns = formatted.mapInArrow(_parse, "conv_id long, turn long, role string, text string, loss string, size long")
    dealt = turns.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_and_read(conversations: DataFrame) -> DataFrame:
    """Formats conversations, writes them to files in the shared folder, and reads those
    back."""
    return read_back(materialize(format_turns(conversations), "chats"))


def with_conflict(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_matches(text, '[\[<]\\+(/?INST\]|/?s>)') OR contains(text, CASE WHEN role = 'assistant' THEN '</s>' ELSE '[/INST]' END) AS conflict,
  length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g')) - length(text) AS added FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(role) + 1 + length(text) + CASE WHEN conflict THEN added ELSE 0 END + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
