"""Best-fit packing of tokenised documents into sequences, improved by swaps.

Documents become token ids, are cut into pieces of at most ``capacity`` tokens, and the pieces
are dealt evenly to shards of about ``SHARD_PIECES``. Each shard is packed by best fit, longest
piece first. Then local search works on its underfull sequences: from the emptiest one it
moves pieces to others, exchanges a piece for a shorter one or for two that are shorter
together, or two for one. Each step raises the sum of squared fills, so the emptiest sequence
shrinks until it is gone. The emptiest few sequences of every 64 shards are packed once more
together, and so on, so that shards cost next to nothing. Only numbers are shuffled, no text.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm import textscan as ts
from labelmill.session import materialize

CAPACITY = 4096
SHARD_PIECES = 16384
FAN_IN = 64
OPEN_SEQUENCES = 8
SOURCES = 16
CACHE_WORDS = 500_000
END_ID = 1
SLICE_BYTES = 1 << 20


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}


#: What a tokenizer does that lower-cases, drops white space and never joins characters across it.
LOWER_CASED = ["NFC", "Replace", "Lowercase"]
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def reads_by_words(tokenizer) -> bool:
    """Whether a tokenizer's settings are those under which a text's ids are those of its words, lower-cased, one after another."""
    try:
        normal, apart = (json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
        steps, (split, letters) = normal["normalizers"], apart["pretokenizers"]
        return (
            [x["type"] for x in steps] == LOWER_CASED
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and (split["type"], split["pattern"], split["behavior"], split["invert"]) == ("Split", {"Regex": APART}, "Removed", True)
            and (letters["type"], letters["add_prefix_space"], letters["use_regex"]) == ("ByteLevel", False, False)
        )
    except (AttributeError, KeyError, TypeError, ValueError):
        return False


class WordEncoder(dict):
    """Ids of texts by a tokenizer; by the words of a text, if the tokenizer's settings allow it, else of whole texts.

    A text is split at ASCII white space, and each distinct part is encoded once, when it is
    first looked up. ASCII capitals are lower-cased before, as the tokenizer does. A part of
    lower-case Latin letters is one word for the tokenizer, so its model takes it at once;
    punctuation behind such a word is a part of its own. Parts that could hold the string of a
    special token keep their capitals; such a string has no white space inside.
    """

    #: a-z and U+00DF to U+00FF without the division sign, then punctuation.
    word = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([,.!?;:#%*&$]*)")
    letters = _byte_letters()
    space = re.compile(rb"[ \t-\r]")

    def __init__(self, path: str, words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.by_words = reads_by_words(self.tokenizer)
        self.tokenize = self.tokenizer.model.tokenize

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: bytes) -> bytes:
        found = self.word.fullmatch(part)
        if found is None:
            ids = self.whole(part)
        elif found[2]:
            ids = self[found[1]] + self[found[2]]
        else:
            ids = array("I", [t.id for t in self.tokenize(part.decode("latin-1").translate(self.letters))]).tobytes()
        if len(self) >= self.words:
            self.clear()
        self[part] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text, which is read in slices that end at white space where that changes nothing."""
        if not self.by_words:
            return self.whole(text)
        out, at = [], 0
        while at < len(text):
            cut = self.space.search(text, at + SLICE_BYTES)
            end = cut.end() if cut else len(text)
            part = text[at:end]
            if b"<|" in part:
                out.append(b"".join(self.whole(p) if b"<|" in p else self[p.lower()] for p in part.split()))
            else:
                out.append(b"".join(map(self.__getitem__, part.lower().split())))
            at = end
        return b"".join(out)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot) of all documents. slot is spread evenly."""

    def work(batches):
        encoder, end, n = WordEncoder(tokenizer), array("I", [END_ID]).tobytes(), 0
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            body, offs = ts.binary_parts(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = min(max(int(np.searchsorted(offs, offs[first] + ts.SLICE_BYTES, "right")) - 1, first + 1), batch.num_rows)
                ids = [encoder.encode(body[offs[i] : offs[i + 1]].tobytes()) for i in range(first, last)]
                rows = [(i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)) for i, x in enumerate(ids, first) for k in range(0, len(x) + 4, 4 * capacity) for part in [(x + end)[k : k + 4 * capacity]]]
                at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
                slot = ts.mix(np.arange(salt + n, salt + n + len(rows), dtype=np.uint64)) >> np.uint64(1)
                n += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(slot.astype(np.int64))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "slot"],
                )
                first = last

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, slot long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Pieces by sequence: each, longest first, goes where the least room stays."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(spaces, n)
        if at == len(spaces):
            bins.append([i])
            b, space = len(bins) - 1, capacity - n
        else:
            old = spaces[at]
            b = by_space[old].pop()
            if not by_space[old]:
                del by_space[old], spaces[at]
            bins[b].append(i)
            space = old - n
        if space:
            if space not in by_space:
                by_space[space] = []
                insort(spaces, space)
            by_space[space].append(b)
    return bins


def _step(source: list[int], others: list[list[int]], lengths: np.ndarray, capacity: int) -> bool:
    """One move or exchange from the emptiest sequence that raises the squared fill; False if none."""
    space = np.array([capacity - lengths[b].sum() for b in others])
    for x in sorted(source, key=lambda i: -lengths[i]):
        fits = np.flatnonzero(space >= lengths[x])
        if len(fits):
            others[fits[np.argmin(space[fits])]].append(x)
            source.remove(x)
            return True
    owner = np.repeat(np.arange(len(others)), [len(b) for b in others])
    flat = np.array([i for b in others for i in b], np.int64)
    mine = sorted(source, key=lambda i: -lengths[i])
    sets = [[x] for x in mine] + [[x, y] for k, x in enumerate(mine[:16]) for y in mine[k + 1 : 16]]
    for xs in sets:
        total = int(lengths[xs].sum())
        gain = total - lengths[flat]
        good = (gain > 0) & (gain <= space[owner])
        if good.any():
            k = int(np.argmax(np.where(good, gain, 0)))
            others[owner[k]].remove(int(flat[k]))
            others[owner[k]] += xs
            for x in xs:
                source.remove(x)
            source.append(int(flat[k]))
            return True
    for x in mine:
        for b, other in enumerate(others):
            if len(other) < 2 or not space[b]:
                continue
            part = np.array(sorted(other, key=lambda i: lengths[i])[:64])
            sums = lengths[part][:, None] + lengths[part][None, :]
            gain = np.triu(int(lengths[x]) - sums, 1)
            gain[gain > space[b]] = 0
            if gain.max() > 0:
                u, v = divmod(int(np.argmax(gain)), len(part))
                for y in (int(part[u]), int(part[v])):
                    other.remove(y)
                    source.append(y)
                other.append(x)
                source.remove(x)
                return True
    return False


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the emptiest sequence again and again, as long as fewer sequences are possible."""
    least = -(-int(lengths.sum()) // capacity)
    full = [b for b in bins if lengths[b].sum() >= capacity]
    work = [b for b in bins if lengths[b].sum() < capacity]
    while len(full) + len(work) > least and len(work) > 1:
        work.sort(key=lambda b: -lengths[b].sum())
        room = sum(capacity - int(lengths[b].sum()) for b in work[:-1])
        if room < lengths[work[-1]].sum():
            break
        steps = 4 * len(work[-1]) + 64
        while work[-1] and steps:
            # The emptiest sequence first; where it has no step, one of the next emptiest makes room.
            for k in range(len(work) - 1, max(0, len(work) - SOURCES), -1):
                if _step(work[k], work[:k], lengths, capacity):
                    break
            else:
                break
            work.sort(key=lambda b: -lengths[b].sum())
            steps -= 1
        if work[-1]:
            break
        work.pop()
    return full + work


def _packed(rows: DataFrame, capacity: int, level: int) -> DataFrame:
    """Rows with a shard, packed in it: sequence_id, offset, rank of the sequence from the emptiest, room in it."""

    def work(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("length", "descending"), ("slot", "ascending")]))
        lengths = group["length"].to_numpy()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        bins.sort(key=lambda b: lengths[b].sum())
        count = np.array([len(b) for b in bins])
        order, number = np.concatenate(bins), np.repeat(np.arange(len(bins)), count)
        ends, tops = np.cumsum(lengths[order]), np.cumsum(count)
        before = np.concatenate([[0], ends[tops[:-1] - 1]])
        room = capacity - (ends[tops - 1] - before)
        group = group.take(pa.array(order))
        for name, values in (("sequence_id", (level << 56) + (group["shard"].to_numpy() << 24) + number), ("offset", ends - lengths[order] - before[number]), ("rank", number.astype(np.int32)), ("room", room[number])):
            group = group.append_column(name, pa.array(values))
        return group

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long, shard long, sequence_id long, offset long, rank int, room long"
    return rows.groupBy("shard").applyInArrow(work, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """All documents (doc_id, text) in sequences of at most ``capacity`` tokens, one row per piece.

    Columns: doc_id, piece from 0, start (ids of the document before it), length, ids_crc32 of
    its little-endian 32-bit ids, sequence_id, offset in the sequence, gapless from 0. Only
    documents longer than ``capacity`` are cut. Each document ends with id 1, so a null or empty
    text is one piece of length 1. Rows that repeat, also a null doc_id, are documents of their
    own; other columns don't matter. An empty table gives no rows.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "slot"]
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    rows, level, done = cut.withColumn("shard", F.col("slot") % shards), 0, None
    while True:
        packed = materialize(_packed(rows, capacity, level), "packed")
        again = (F.col("rank") < OPEN_SEQUENCES) & (F.col("room") > 0)
        last = shards == 1
        closed = packed if last else packed.where(~again)
        closed = closed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        rows = packed.where(again).select(*columns, F.floor(F.col("shard") / FAN_IN).cast("long").alias("shard"))
        shards, level = -(-shards // FAN_IN), level + 1
