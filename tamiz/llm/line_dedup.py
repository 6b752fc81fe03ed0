"""Line dedup by a segment-partition edit join.

Two distinct lines within ``edits`` edits of each other must share a segment: the shorter
one, cut into ``edits`` + 1 segments, has at least one that occurs unchanged in the other,
close to its own place. Every line indexes its segments and probes the few
substrings that could match segments of lines of its own or a smaller length. Where an index
row and a probe meet, the lines are compared by banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import id_in, id_out, keyed_join, materialise, sized
from tamiz.llm.components import components

EDITS = 2
#: Shorter lines (in characters) are only matched exactly: their segments are so short that a probe could leave the line.
SHORTEST = (EDITS + 1) ** 2
#: Lines of a meeting that one task compares; crowded meetings are cut into blocks of this size.
BLOCK = 512
#: Room in a tag for twice the segments; generated ids of up to 2^24 partitions still fit.
TAGS = 64
_WORD = (1 << 64) - 1


def trimmed(line: Column) -> Column:
    """Without white space (ASCII) at the ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def segment_at(i: int, length: int, edits: int = EDITS) -> tuple[int, int]:
    """Start (from 0) and length of segment ``i`` (from 0) of a line of ``length`` characters; later segments take the remainder."""
    base, more = divmod(length, edits + 1)
    short = edits + 1 - more
    return i * base + max(0, i - short), base + (i >= short)


def probe_window(i: int, longer: int, edits: int = EDITS) -> range:
    """Offsets, from the place of segment ``i`` in the shorter line, at which the longer one (by ``longer``) can hold it."""
    return range(max(-i, longer - (edits - i)), min(i, longer + edits - i) + 1)


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most ``most``; banded bit-parallel columns.

    A 64-bit window of Myers' vertical differences slides along the diagonal, so a
    step costs the same for any length.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b:
        return len(a) <= most
    if len(a) <= most:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # Bit 63 of the window is the lowest cell of the band: row j + most of column j.
    plus, minus, score, first = (_WORD << (63 - most)) & _WORD, 0, most, most - 63
    rows, limit = len(a), most + len(a) - len(b) + most
    for j, c in enumerate(b):
        bits = where.get(c, 0)
        match = (bits >> first if first >= 0 else bits << -first) & _WORD
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        diagonal &= _WORD
        across_up = (minus | ~(diagonal | plus)) & _WORD
        across_down = diagonal & plus
        if j + most < rows:  # the band still grows downwards: follow the diagonal
            score += not diagonal >> 63
        else:  # the last row lies inside the window: follow it along the row
            bit = rows - 1 - first
            score += (across_up >> bit & 1) - (across_down >> bit & 1)
        if score > limit:
            return False
        plus = (across_down | ~((diagonal >> 1) | across_up)) & _WORD
        minus = (diagonal >> 1) & across_up
        first += 1
    return score <= most


def first_shared_segment(short: str, long: str, edits: int = EDITS) -> int:
    """The first segment of ``short`` that a probe of ``long`` meets, or -1."""
    for i in range(edits + 1):
        at, size = segment_at(i, len(short), edits)
        part = short[at : at + size]
        for offset in probe_window(i, len(long) - len(short), edits):
            if at + offset >= 0 and long[at + offset : at + offset + size] == part:
                return i
    return -1


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """key, tag of ``lines`` (id, line, size): index rows, and probes for lines up to ``edits`` shorter.

    The tag is the id, the segment and whether the row probes, in one number, so that
    what is shuffled per row are two longs.

    An index row also stands for the probe at the same place of lines of equal length.
    Lines have (edits + 1)^2 characters at least, so every window lies inside the line.
    """
    parts = edits + 1
    cuts = lines.select("id", "line", "size", *[c for k in range(parts) for c in (F.expr(f"cast((size - {k}) div {parts} as int)").alias(f"base{k}"), F.expr(f"{parts} - (size - {k}) % {parts}").alias(f"short{k}"))])
    keys = []
    for longer in range(parts):
        base, short = F.col(f"base{longer}"), F.col(f"short{longer}")
        for i in range(parts):
            own, at = base + (short <= i).cast("int"), base * i + F.greatest(F.lit(0), F.lit(i) - short)
            for offset in probe_window(i, longer, edits):
                key = F.xxhash64(F.substring("line", at + offset + 1, own), F.col("size") * parts + (i - longer * parts))
                index = longer == 0 and offset == 0
                keys.append(F.struct(key.alias("key"), (F.col("id") * TAGS + (2 * i + (not index))).alias("tag")))
    return cuts.select(F.array(*keys).alias("keys")).select(F.explode_outer("keys").alias("k")).select("k.key", "k.tag")  # never empty


def meet(rows: list[tuple[int, int, bool, str]], segment: int, own_block: bool, edits: int) -> list[tuple[int, int, int]]:
    """Links among rows (block, id, probes, line) that meet at a key of ``segment``, as (kind, x, y).

    Every pair of an index row and a longer line, or one of equal length and larger id, is
    looked at once; it counts only if this is the first segment that the two share.
    """
    shorter = sorted({(x, o, t) for o, x, p, t in rows if not p})
    longer = sorted({(x, o, t) for o, x, _, t in rows})
    counts: dict[int, int] = {}
    parent: dict[int, int] = {}
    out = []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, o, a in shorter:
        for y, o2, b in longer:
            more = len(b) - len(a)
            if more < 0 or more > edits or x == y or (more == 0 and y < x) or (not own_block and o == o2):
                continue
            if first_shared_segment(a, b, edits) == segment and distance_within(a, b, edits):
                counts[x], counts[y] = counts.get(x, 0) + 1, counts.get(y, 0) + 1
                if root(x) != root(y):
                    parent[root(x)] = root(y)
                    out.append((1, x, y))
    return out + [(0, x, c) for x, c in counts.items()]


def edit_links(lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """kind, x, y for distinct ``lines`` (id, line): kind 0, line x has y more links; kind 1, x and y are connected.

    Index rows and probes are dealt by key. Keys at which no other line meets an index row
    are dropped before any text moves; crowded ones are cut into pairs of blocks.
    """
    long = lines.withColumn("size", F.char_length("line")).where(F.col("size") >= max(shortest, (edits + 1) ** 2))
    line_of, bits = F.shiftright("tag", TAGS.bit_length() - 1), F.col("tag").bitwiseAND(TAGS - 1)
    at = Window.partitionBy("key")  # rows are shuffled once; a key's rows stream through a buffer that spills
    met = _keys(long, edits).select("key", "tag", F.count(F.lit(1)).over(at).alias("size"), F.min(line_of).over(at).alias("low"), F.max(line_of).over(at).alias("high"), F.min(F.col("tag").bitwiseAND(1)).over(at).alias("no_index"))
    met = met.where("low < high and no_index = 0")
    crowd = materialise(met.select("key", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("blocks"), line_of.alias("id"), F.shiftright(bits, 1).cast("int").alias("segment"), (bits.bitwiseAND(1) == 1).alias("probes")), "meetings")
    wanted = materialise(crowd.select("id").distinct(), "wanted")
    texts = lines.join(sized(wanted), "id", "left_semi").select("id", "line")  # few are wanted: the lines stay where they are
    others = F.filter(F.sequence(F.lit(0), F.col("blocks")), lambda j: j < F.col("blocks"))
    placed = crowd.join(texts, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(others))
    units = placed.select("key", "segment", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "probes", "line")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for pdf in frames:
            out: list[tuple[int, int, int]] = []
            for *unit, own, x, probes, line in zip(*(pdf[c].tolist() for c in ("key", "segment", "i", "j", "own", "id", "probes", "line")), strict=True):
                if unit != now:
                    if rows:
                        out += meet(rows, now[1], now[2] == now[3], edits)
                    now, rows = unit, []
                rows.append((own, x, probes, line))
            yield pd.DataFrame(out, columns=["kind", "x", "y"], dtype="int64")
        if rows:
            yield pd.DataFrame(meet(rows, now[1], now[2] == now[3], edits), columns=["kind", "x", "y"], dtype="int64")

    # A unit is two blocks at most; units follow each other, as a call per unit would cost more than its work.
    together = units.repartition("key", "i", "j").sortWithinPartitions("key", "segment", "i", "j")
    return together.mapInPandas(compare, "kind long, x long, y long")


def _lines(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_hash, line_no, line of all lines that are not blank; one row with nulls for a document without."""
    text = docs["text"].cast("string")
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), trimmed(x).alias("line")))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), id_in(docs["doc_id"]).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.filter(cut, lambda x: x["line"] != "").alias("lines"))
    return rows.select("row_id", "doc_id", "text_hash", F.explode_outer("lines").alias("l")).select("row_id", "doc_id", "text_hash", "l.line_no", "l.line")


def mark_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, classes: bool = False) -> DataFrame:
    """doc_id, n_lines, n_kept, n_links, dropped (line numbers from 0), text_hash: one row per row of ``docs``.

    Lines are compared without white space at their ends; blank ones are neither counted
    nor dropped. Equal lines are one class; lines of at least ``shortest`` characters within
    ``edits`` edits of each other are linked, and of all lines that links connect the first
    one (least doc_id, null ids first, then least line number) stays. n_links sums, over a document's
    lines, the different lines linked to them. Null and empty texts have no lines.

    ``classes`` adds ``line_classes``: for each line that is not the only one of its class, its number (line), the doc_id
    and number of the line that stays for the class (class_doc_id, class_line) and the different lines linked to it (links).
    """
    occurrences = materialise(_lines(docs).select("row_id", "doc_id", "text_hash", "line_no", F.unhex(F.md5("line")).alias("digest")), "occurrences")
    distinct = _lines(docs).where("line is not null").select("line").distinct()
    lines = materialise(distinct.select(F.monotonically_increasing_id().alias("id"), F.unhex(F.md5("line")).alias("digest"), "line"), "lines")
    links = materialise(edit_links(lines, edits, shortest), "links")
    label = components(links.where("kind = 1").select(F.col("x").alias("u"), F.col("y").alias("v")))
    count = links.where("kind = 0").groupBy(F.col("x").alias("id")).agg(F.sum("y").alias("links"))
    linked = materialise(lines.select("id", "digest").join(label.select(F.col("node").alias("id"), "label"), "id").join(count, "id").select("digest", "label", "links"), "linked")
    own = occurrences.where("digest is not null")
    first = own.groupBy("digest").agg(F.min(F.struct("doc_id", "row_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    # Lines that are alike to no other are their own class; only the others are joined.
    shared = first.join(linked, "digest", "left").where("n > 1 or label is not null")
    earliest = shared.where("label is not null").groupBy("label").agg(F.min("first").alias("earliest"))
    table = materialise(shared.join(earliest, "label", "left").select("digest", "n", F.coalesce("earliest", "first").alias("first"), F.coalesce("links", F.lit(0)).alias("links")), "line-classes")
    none = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in ("n", "first", "links")]
    marked = keyed_join(own, table, ["digest"], "n").unionByName(occurrences.where("digest is null").select("*", *none))
    has = F.col("line_no").isNotNull()
    stays = F.col("n").isNull() | ((F.col("row_id") == F.col("first.row_id")) & (F.col("line_no") == F.col("first.line_no")))
    gone = F.sort_array(F.collect_list(F.when(has & ~F.col("stays"), F.col("line_no"))))
    out = marked.withColumn("stays", stays).groupBy("row_id", "doc_id", "text_hash").agg(
        F.count(F.when(has, 1)).alias("n_lines"),
        F.count(F.when(has & F.col("stays"), 1)).alias("n_kept"),
        F.coalesce(F.sum("links"), F.lit(0)).cast("long").alias("n_links"),
        gone.alias("dropped"),
        *([F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct(F.col("line_no").alias("line"), id_out(F.col("first.doc_id")).alias("class_doc_id"), F.col("first.line_no").alias("class_line"), "links")))).alias("line_classes")] if classes else []),
    )
    return out.select(id_out(F.col("doc_id")).alias("doc_id"), "n_lines", "n_kept", "n_links", "dropped", *(["line_classes"] if classes else []), "text_hash")


def drop_lines(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; rows that repeat an id and a text share the first one's marks."""
    once = marked.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.min("dropped").alias("_dropped"))
    text = docs["text"].cast("string")
    own = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_own"), F.xxhash64(text).alias("_own_hash"), text.alias("_text"))
    found = own.join(once, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left")
    kept = F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains("_dropped", i))
    row = F.when(F.size("_dropped") > 0, F.col("_row").withField("text", F.array_join(kept, "\n"))).otherwise(F.col("_row"))
    return found.select(row.alias("_row")).select("_row.*")
