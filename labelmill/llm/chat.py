"""Chat formatting with loss masks aligned by token offsets.

A turn is written as ``<turn>role\\ntext</turn>``. Inside roles and texts a backslash is doubled
and a control string gets a backslash after its ``<``, so control strings occur only where the
template put them, and reading back undoes it. A whole conversation is rendered and encoded
once; each assistant text's span finds its tokens by binary search over the sorted offsets.
The control strings are tokens of their own, so no token crosses a span's edge.

Turns stream through a task in order. A conversation longer than ``SEGMENT_CHARS`` is rendered
and encoded in segments of whole turns, which gives the same tokens, as control strings stand
between; so memory doesn't grow with a conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
SEGMENT_CHARS = 1 << 20
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"<(?=/?turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>(.*?)\n(.*?)</turn>", re.S)


def escape(text: str) -> str:
    """The text without control strings; ``unescape`` gives it back."""
    return _CONTROL.sub(r"<\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role on one line: a line end becomes backslash n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the texts to learn, ascending."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role == loss_role:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def load_tokenizer(path: str):
    """The tokenizer with the control strings as tokens; its own special strings are plain text."""
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.add_tokens([AddedToken(x, normalized=False, special=False) for x in (OPEN, CLOSE)])
    tokenizer.post_processor = ByteLevel(trim_offsets=False)
    return tokenizer


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token inside one of the ascending spans, by binary search."""
    mask = np.zeros(len(offsets), np.int8)
    if len(offsets) and spans:
        bounds = np.array(spans)
        first = np.searchsorted(offsets[:, 1], bounds[:, 0], "right")
        last = np.searchsorted(offsets[:, 0], bounds[:, 1], "left")
        for a, b in zip(first.tolist(), last.tolist()):
            mask[a:b] = 1
    return mask


FORMATTED = "conv_id long, segment long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<byte>"
NAMES = ["conv_id", "segment", "n_turns", "formatted", "ids", "starts", "ends", "loss_mask"]


def format_conversations(turns: DataFrame, tokenizer: str, loss_role: str = LOSS_ROLE, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Formatted and encoded conversations of the rows (conv_id, turn, role, text).

    A row for each segment: conv_id, segment from 0, n_turns, formatted, ids, starts and ends of
    the tokens in formatted, loss_mask (1: learn). Turns are ordered by turn; ties by role and
    text, nulls first; repeated rows are turns of their own. A null text or role is empty; the
    rows of a null conv_id are one conversation. An empty table gives no rows; other columns
    don't matter.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))

    def work(batches):
        encoder = load_tokenizer(tokenizer)
        out, size = [], 0

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int8()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)

        def close(conv, segment, turns):
            formatted, spans = render(turns, loss_role)
            encoding = encoder.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoding.offsets, np.int32).reshape(-1, 2)
            return conv, segment, len(turns), formatted, np.array(encoding.ids, np.int32), offsets[:, 0], offsets[:, 1], loss_mask(offsets, spans)

        conv, segment, held, chars, begun = None, 0, [], 0, False
        for batch in batches:
            for c, role, text in zip(*(col.to_pylist() for col in batch.columns)):
                if begun and (c != conv or chars > segment_chars):
                    out.append(close(conv, segment, held))
                    size += chars
                    segment, held, chars = (segment + 1 if c == conv else 0), [], 0
                    if size > 1 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                conv, begun = c, True
                held.append((role, text))
                chars += len(role) + len(text) + 32
        if held:
            out.append(close(conv, segment, held))
        if out:
            yield batch_of(out)

    return rows.mapInArrow(work, FORMATTED)


def conversation_digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What formatted conversations hold, read back from their strings, offsets and masks.

    conv_id, n_turns, turns_sha256 (of role, \\n, text, \\n for each turn), loss_chars and
    loss_sha256 (all text under the mask, unescaped), formatted_chars, n_tokens, loss_tokens.
    With in_order the segments must stand in order in one task, as ``format_conversations``
    gives them; else they are shuffled and sorted first. No segments give no rows.
    """
    rows = formatted.select(*NAMES)
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"

    def work(batches):
        conv, begun, counts = None, False, [0] * 5
        turns_hash, loss_hash, done = hashlib.sha256(), hashlib.sha256(), []

        def batch_of(rows):
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def total():
            return conv, counts[0], turns_hash.hexdigest(), counts[1], loss_hash.hexdigest(), counts[2], counts[3], counts[4]

        for batch in batches:
            columns = [batch.column(k) for k in range(8)]
            for i in range(batch.num_rows):
                c, text = columns[0][i].as_py(), columns[3][i].as_py()
                if begun and c != conv:
                    done.append(total())
                    counts, turns_hash, loss_hash = [0] * 5, hashlib.sha256(), hashlib.sha256()
                conv, begun = c, True
                for role, body in parse(text):
                    counts[0] += 1
                    turns_hash.update(f"{role}\n{body}\n".encode())
                starts, ends, mask = (columns[k][i].values.to_numpy() for k in (5, 6, 7))
                at = np.flatnonzero(mask)
                # Tokens of one character's bytes have the same offsets; what is learnt is their union.
                new = np.flatnonzero(starts[at][1:] > ends[at][:-1]) + 1
                for a, b in zip(np.append(0, new), np.append(new, len(at))) if len(at) else ():
                    learnt = unescape(text[starts[at[a]] : ends[at[a:b]].max()])
                    counts[1] += len(learnt)
                    loss_hash.update(learnt.encode())
                counts[2] += len(text)
                counts[3] += len(mask)
                counts[4] += len(at)
            if len(done) > 1000:
                yield batch_of(done)
                done = []
        if begun:
            done.append(total())
        if done:
            yield batch_of(done)

    return rows.mapInArrow(work, schema)
