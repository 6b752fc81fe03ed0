"""Best-fit packing with Martello-Toth dominance reduction.

Bin packing only depends on how many pieces there are of each length, and lengths
are at most the sequence size. So pieces are counted by length (a table of at most
``SEQUENCE`` rows for any corpus), the reduction and the best fit run on counts, and
every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import id_in, id_out, materialise, salted_rank

SEQUENCE = 2048
END_ID = 0
SALTS = 64
#: Distinct words whose ids a worker keeps; the store starts afresh when it is full.
CACHED_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters below this one compose with nothing, and lower-case the same everywhere.
SIMPLE_BELOW = "\u0250"
# The tokenizer's own pattern for the parts of a chunk.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, int]:
    """Bytes as the byte-level model spells them: printable ones as they are, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Little-endian ids of texts, each distinct word encoded about once.

    The tokenizer drops white space and never merges across it, so a text's ids are those
    of its chunks in a row, and a chunk's those of its parts. Parts go straight to the BPE model;
    chunks with characters from U+0250 on go through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelt = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return found

    def chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isalpha() and (low.isascii() or max(chunk) < SIMPLE_BELOW):
            return self.part(low)  # one run of letters is one part
        if not chunk.isascii() and max(chunk) >= SIMPLE_BELOW or "|" in chunk and any(x in chunk for x in self.special):
            return self.whole(chunk)
        return b"".join(map(self.part, PARTS.findall(low)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. U+001C to U+001F split Python strings but not the tokenizer's."""
        odd = [any(c in text for c in "\x1c\x1d\x1e\x1f") for text in texts]
        lists = [[] if o else text.split() for text, o in zip(texts, odd, strict=True)]
        for word in set().union(*lists):
            if word not in self.chunks:
                self.chunks[word] = self.chunk(word)
        get = self.chunks.__getitem__
        out = [self.whole(text) if o else b"".join(map(get, words)) for text, o, words in zip(texts, odd, lists, strict=True)]
        for store in (self.chunks, self.parts):
            if len(store) > CACHED_WORDS:
                store.clear()
        return out


def portions(texts: list[str], size: int = 2_000_000) -> Iterator[slice]:
    """Slices of consecutive texts of about ``size`` characters."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def cut(ids: bytes, size: int = SEQUENCE) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length, checksum of the pieces of a document's ids (4 bytes each)."""
    for piece, start in enumerate(range(0, len(ids) // 4, size)):
        part = ids[4 * start : 4 * (start + size)]
        yield piece, start, len(part) // 4, crc32(part)


def tokenised(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document (a null doc_id as NULL_ID): its ids, then ``end_id``, cut only where they exceed ``size``."""
    end = np.array([end_id], "<u4").tobytes()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(tokenizer_path)
        for pdf in frames:
            ids, texts, rows = pdf["doc_id"].tolist(), pdf["text"].fillna("").tolist(), []
            for some in portions(texts):
                rows += [(doc_id, *p) for doc_id, own in zip(ids[some], words.encode(texts[some]), strict=True) for p in cut(own + end, size)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(id_in(docs["doc_id"]).alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInPandas(batches, PIECES)


@dataclass
class Plan:
    """Runs of equal placements: ``count`` pieces of ``length``, from rank ``rank`` on, go to as many sequences from ``bin`` on, at ``offset``."""

    bins: int = 0
    reduced: int = 0  # sequences that the reduction fixed
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, rank, bin, offset
    ranks: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.runs.append((length, rank, first, offset))
        self.ranks[length] = rank + count

    def fix(self, lengths: list[int], count: int) -> None:
        """``count`` new sequences that hold exactly ``lengths``."""
        offset = 0
        for x in lengths:
            self.put(x, count, self.bins, offset)
            offset += x
        self.bins += count
        self.reduced += count


def _dominant(j: int, left: dict[int, int], lengths: list[int], size: int) -> list[int] | None:
    """A set with ``j`` that dominates every other feasible set with ``j``, or None where none of at most three pieces is known to.

    ``lengths``: those still in ``left``, ascending. One set dominates another if the
    pieces of the other can be grouped so that each group fits in place of one of its own.
    """
    room = size - j
    others = lambda x: left[x] - (x == j)
    smallest: list[int] = []
    for x in lengths:
        smallest += [x] * min(3 - len(smallest), others(x))
        if len(smallest) == 3:
            break
    if not smallest or smallest[0] > room:
        return [j]
    at = bisect.bisect_right(lengths, room) - 1
    while not others(lengths[at]):
        at -= 1
    best = lengths[at]
    if best == room or len(smallest) < 2 or sum(smallest[:2]) > room:
        return [j, best]
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # At most two more pieces fit. If the best one leaves room for a second, the pair is
    # at least as good as any pair unless two pieces larger than the second fit together.
    k = bisect.bisect_right(lengths, room - best) - 1
    while k >= 0 and others(lengths[k]) - (lengths[k] == best) < 1:
        k -= 1
    second = lengths[k] if k >= 0 else 0
    larger: list[int] = []
    for x in lengths[bisect.bisect_right(lengths, second) :]:
        larger += [x] * min(2 - len(larger), others(x))
        if len(larger) == 2:
            break
    if len(larger) == 2 and sum(larger) <= room:
        return None
    return [j, best, second] if second else [j, best]


def reduce_instance(left: dict[int, int], plan: Plan, size: int) -> None:
    """Fix dominating sets, whole groups of equal ones at a time, until none is found; ``left`` shrinks."""
    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                lengths = sorted(left)
                chosen = _dominant(j, left, lengths, size)
                if chosen is None:
                    break
                need = {x: chosen.count(x) for x in chosen}
                count = min(left[x] // n for x, n in need.items())
                if len(chosen) > 2 or (len(chosen) == 2 and sum(chosen) < size):
                    # the proof looked at what is left beside: the last of a kind is looked at again
                    count = max(1, count - 1)
                plan.fix(chosen, count)
                for x, n in need.items():
                    left[x] -= n * count
                    if not left[x]:
                        del left[x]
                again = True


def best_fit(left: dict[int, int], plan: Plan, size: int) -> None:
    """Best-fit decreasing on counts: pieces, longest first, go where the least room stays."""
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first, count) of runs of bins
    rooms: list[int] = []

    def give(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((first, count))

    for w in sorted(left, reverse=True):
        n = left.pop(w)
        while n:
            at = bisect.bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    del rooms[at]
            else:
                room, first = size, plan.bins
                count = -(-n // (size // w))
                plan.bins += count
            each = room // w
            full = min(count, n // each)
            for i in range(each if full else 0):
                plan.put(w, full, first, size - room + i * w)
            give(room - each * w, first, full)
            n -= full * each
            if full < count and n:  # fewer than would fill one more
                for i in range(n):
                    plan.put(w, 1, first + full, size - room + i * w)
                give(room - n * w, first + full, 1)
                full, n = full + 1, 0
            give(room, first + full, count - full)


def plan_counts(counts: dict[int, int], size: int = SEQUENCE) -> Plan:
    """A plan for ``counts`` pieces of each length from 1 to ``size``."""
    plan, left = Plan(), {k: v for k, v in counts.items() if v}
    reduce_instance(left, plan, size)
    best_fit(left, plan, size)
    return plan


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of ``end_id`` alone. Repeated rows are packed as
    often as they occur; a null doc_id stays null. An empty table gives no rows. Documents
    are tokenised once; what is shuffled after that are 36 bytes a piece.
    """
    pieces = materialise(tokenised(docs, tokenizer_path, size, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    runs = sorted(plan_counts(counts, size).runs)
    keys = np.array([(x << 44) | rank for x, rank, _, _ in runs], np.int64)
    bins, offsets, ranks = (np.array([r[i] for r in runs], np.int64) for i in (2, 3, 1))
    ranked = salted_rank(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.xxhash64("doc_id", "piece", "ids_crc32"), SALTS)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rank = pdf.pop("rank").to_numpy()
            at = np.searchsorted(keys, (pdf["length"].to_numpy() << 44) | rank, side="right") - 1
            yield pdf.assign(sequence_id=bins[at] + rank - ranks[at], offset=offsets[at])

    columns = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    placed = columns.mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
    return placed.withColumn("doc_id", id_out(F.col("doc_id")))
