"""Line dedup: segment-partition edit join.

A line goes if it equals an earlier line of the corpus, or is within its edit
limit of one by a chain of such lines; the first line of each class, by doc_id
and line number, stays. Lines are split at \\n; a line without a word is never
removed. Two lines may differ by ``threshold`` edits, but by no more than one
for every ``chars_per_edit`` code points of the shorter: by two from 20
characters on, by one from 10, and below that lines must be equal.

The edit join cuts each line into as many segments as it may have edits, plus
one: within the limit, one of them stands unchanged in the other line, shifted
by no more than the edits around it allow. Index keys are a line's own segments
under its length; probe keys are its substrings, for each length that differs
by no more than the limit, at the positions that the multi-match rule leaves.
Lines that meet under a key are compared by two parity sketches, of their
characters and of their pairs of characters, and then by bit-parallel edit
distance within a band of ``2 * threshold + 1``. ``linking.classes`` makes the
classes: where a segment is common to many lines, they meet again by parts of
the sketches, of which a link leaves one part alike.

Equal lines are one 64-bit node (XXH3) before any key is made, so a line with a
third of all rows costs one row per megabyte of text. Nulls: a null text stays
null; a null doc_id sorts first. Repeated doc_ids: rows of one doc_id are one
document, so a line repeated at its own place in a copy of the row stays in
both. Empty tables give no rows; extra columns pass, whatever their names.
Texts and lines are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamloom.llm import linking
from streamloom.llm.text import _BASE, _BASE_INV, _power, mix, slices

#: Shared keys, and ids of documents to read again, go to all tasks only up to this many (8 bytes each); beyond, what they are joined with is shuffled.
MAX_BROADCAST_ROWS = 1_000_000

#: Keys are looked through for shared ones in so many parts, one after another: the shuffle of one is let go before the next.
KEY_PARTS = 3

_POINTS = mix(np.arange(1, 1 + (1 << 16), dtype=np.uint64))
_PARITY = np.uint64(1) << (_POINTS & np.uint64(63))


def _value(points: np.ndarray) -> np.ndarray:
    small = points < (1 << 16)
    if small.all():
        return _POINTS[points]
    return np.where(small, _POINTS[np.where(small, points, 0)], mix(points.astype(np.uint64) + np.uint64(1)))


class Lines:
    """The lines of a slice with a word: code points from ``start`` to ``end``, document and number, and a node each."""

    def __init__(self, s):
        raw = s.data.tobytes()
        # lines in bytes: a text of n line ends has n + 1 lines, an empty text none
        breaks = np.flatnonzero(s.data == 10)
        docs = np.flatnonzero(s.offsets[1:] > s.offsets[:-1])
        start = np.concatenate([s.offsets[docs], breaks + 1])
        end = np.concatenate([s.offsets[docs + 1], breaks])
        owner = np.concatenate([docs, np.searchsorted(s.offsets, breaks, side="right") - 1])
        order = np.lexsort((owner, start))
        start, owner = start[order], owner[order]
        end.sort()
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        solid = np.ones(256, dtype=np.int64)
        solid[[32, *range(9, 14)]] = 0
        count = np.concatenate([[0], np.cumsum(solid[s.data])])
        keep = count[end] > count[start]
        start, end, self.doc, self.number = start[keep], end[keep], owner[keep], number[keep]
        view = memoryview(raw)
        self.node = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
        self.points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        place = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
        self.start, self.end = place[start], place[end]
        self.size = self.end - self.start
        values = _value(self.points)
        self.prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _power(_BASE, "up", len(values)), out=self.prefix[1:])
        self.inverse = _power(_BASE_INV, "down", len(self.prefix))
        self.values = values

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of spans; what meets under one is compared, so a collision costs time only."""
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def sketches(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parities of 64 classes of characters, and of 64 classes of pairs of neighbouring characters."""
        spans = np.stack([self.start[rows], self.end[rows]], axis=1).ravel()
        ones = np.append(np.uint64(1) << (self.values & np.uint64(63)), np.uint64(0))
        pairs = np.zeros(len(ones), dtype=np.uint64)
        mixed = self.values[:-1] * np.uint64(0x9FB21C651E98DF25) + self.values[1:]
        pairs[: len(mixed)] = np.uint64(1) << (mixed >> np.uint64(58))
        first = np.bitwise_xor.reduceat(ones, spans)[::2]
        # the last character of a line begins no pair of its own; a line of one has none
        spans[1::2] -= 1
        second = np.bitwise_xor.reduceat(pairs, spans)[::2]
        return first, np.where(spans[1::2] > spans[::2], second, np.uint64(0))


def limits(size: np.ndarray, threshold: int, chars_per_edit: int) -> np.ndarray:
    """Edits that a line of this length may differ by from one no shorter."""
    return np.minimum(threshold, size // chars_per_edit)


def _keys(lines: Lines, rows: np.ndarray, threshold: int, chars_per_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys and probe keys of each of the rows, 0 where it has fewer than others."""
    start, size = lines.start[rows], lines.size[rows]
    own: list[np.ndarray] = []
    probes: list[np.ndarray] = []
    for gap in range(threshold + 1):
        indexed = size - gap
        limit = limits(indexed, threshold, chars_per_edit)
        for t in range(max(gap, 1), threshold + 1):
            some = limit == t
            if not some.any():
                continue
            low, more = indexed // (t + 1), indexed % (t + 1)
            for i in range(t + 1):
                at = i * low + np.maximum(0, i - (t + 1 - more))
                n = low + (i >= t + 1 - more)
                for shift in range(max(-i, gap - (t - i)), min(i, gap + (t - i)) + 1):
                    where = start + np.clip(at + shift, 0, np.maximum(size - n, 0))
                    h = mix(lines.hash(where, np.minimum(where + n, lines.end[rows])) + mix(indexed.astype(np.uint64) * np.uint64(64) + np.uint64(i)))
                    h = np.where(some, h | np.uint64(1), np.uint64(0))
                    (own if gap == 0 and shift == 0 else probes).append(h)
    empty = np.zeros((len(rows), 0), np.uint64)
    return (np.stack(own, axis=1) if own else empty), (np.stack(probes, axis=1) if probes else empty)


def _lists(table: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """A list column of n rows, null but at the places ``at``, which hold the table's values that are not 0."""
    some = table != 0
    counts = np.zeros(n + 1, dtype=np.int32)
    counts[at + 1] = some.sum(axis=1)
    absent = np.ones(n + 1, dtype=bool)
    absent[at] = False
    absent[n] = False
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32), mask=absent), pa.array(table[some].view(np.int64)))


class _Read:
    """One row per line; the first of its kind in a slice has sketches and keys, if it may differ by an edit at all."""

    SCHEMA = "doc_id long, version long, line_no int, node long, s0 long, s1 long, own array<long>, probes array<long>"

    def __init__(self, threshold: int, chars_per_edit: int):
        self.threshold, self.chars_per_edit = threshold, chars_per_edit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                lines = Lines(s)
                n = len(lines.node)
                if not n:
                    continue
                _, rows = np.unique(lines.node, return_index=True)
                rows = np.sort(rows[limits(lines.size[rows], self.threshold, self.chars_per_edit) > 0])
                sketches = np.zeros((2, n), dtype=np.uint64)
                if len(rows):
                    sketches[:, rows] = lines.sketches(rows)
                own, probes = _keys(lines, rows, self.threshold, self.chars_per_edit)
                where = pa.array(lines.doc)
                ids, versions = (batch.column(c).slice(s.first, len(s)).take(where) for c in ("doc_id", "version"))
                columns = [ids, versions, pa.array(lines.number.astype(np.int32)), pa.array(lines.node.view(np.int64)), *(pa.array(x.view(np.int64)) for x in sketches), _lists(own, rows, n), _lists(probes, rows, n)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in self.SCHEMA.split(", ")])


def segment_plan(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a line of this length; later segments take the remainder."""
    parts = threshold + 1
    small, larger = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        size = small + (i >= parts - larger)
        out.append((at, size))
        at += size
    return out


class _Texts:
    """Every line of a text with a word, as node and text."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                parts = [p for p in (text.as_py() or "").encode().split(b"\n") if p.split()]
                if parts:
                    node = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([p.decode() for p in parts])], ["node", "line"])


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most ``threshold``: bit-parallel columns within a diagonal band.
    Bit j of a word stands for row i - threshold + j of column i; delta words hold where the distance
    grows or falls from one row to the next, so a column costs a few operations on 2 * threshold + 1 bits.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > threshold:
        return False
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i in range(min(k, len(a))):
        where[a[i]] = where.get(a[i], 0) | 1 << i
    # bits of a that a column sees: rows i-k+1 .. i+k+1, kept as positions and shifted to the band
    up, down = full & ~((1 << k) - 1), 0
    score = k
    for i, c in enumerate(b):
        if i + k < len(a):
            where[a[i + k]] = where.get(a[i + k], 0) | 1 << (i + k)
        hits = where.get(c, 0)
        hits = hits >> (i - k) if i >= k else hits << (k - i)
        hits &= full
        diagonal = (((hits & up) + up) ^ up) | hits | down
        grew = down | ~(diagonal | up)
        fell = diagonal & up
        score += not diagonal >> (width - 1) & 1
        x = diagonal >> 1
        down, up = grew & x & full, (fell | ~(grew | x)) & full
    # the score follows the lowest diagonal of the band to its last column; walk up to the last row
    row = len(b) - 1 + k
    j = width - 1
    while row > len(a) - 1:
        j -= 1
        if j < 0:
            break
        score -= (up >> j & 1) - (down >> j & 1)
        row -= 1
    return score <= threshold


class _Confirm:
    def __init__(self, threshold: int, chars_per_edit: int):
        self.threshold, self.chars_per_edit = threshold, chars_per_edit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(x, y, min(self.threshold, min(len(x), len(y)) // self.chars_per_edit)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _joined(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join with a side whose rows are counted before it is sent to all tasks; a larger one is shuffled."""
    small = linking.checkpoint(small)
    return big.join(F.broadcast(small) if small.count() <= MAX_BROADCAST_ROWS else small, on, how)


def line_classes(texts: DataFrame, lines: DataFrame, firsts: DataFrame, threshold: int, chars_per_edit: int) -> DataFrame | None:
    """(node, root) of lines with a near line; the table ``lines`` is deleted once its keys have been read."""
    keyed = lines.where("own is not null").select("node", "s0", "s1", "own", "probes")
    keys = keyed.select("node", F.explode("own").alias("key"), F.lit(True).alias("lead")).unionByName(keyed.select("node", F.explode("probes").alias("key"), F.lit(False).alias("lead")))
    shared = None
    for i in range(KEY_PARTS):
        part = keys.where(F.pmod("key", F.lit(KEY_PARTS)) == i).groupBy("key").agg(F.min("node").alias("p"), F.max("node").alias("q"), F.max("lead").alias("any"))
        part = linking.checkpoint(part.where("p <> q and any").select("key"))
        linking.release(texts.sparkSession)
        shared = shared.unionByName(part) if shared else part
    met = _joined(keys, shared, "key").groupBy("key", "node").agg(F.max("lead").alias("lead"))
    sizes = keyed.groupBy("node").agg(F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    buckets = linking.checkpoint(met.join(sizes, "node").select("key", "node", F.struct("s0", "s1").alias("size"), "lead"))
    del keyed, keys, part, shared, met, sizes
    linking.discard(lines)
    linking.release(texts.sparkSession)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = linking.checkpoint(pairs)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        places = linking.checkpoint(firsts.join(nodes, "node").select("node", F.col("first.doc_id").alias("wanted"), F.col("first.version").alias("version")))
        documents = places.select("wanted", "version").distinct()
        # lines are read again from the first text that holds them
        read = _joined(texts.withColumn("doc", F.xxhash64("doc_id", "version")), documents.select(F.xxhash64("wanted", "version").alias("doc")).distinct(), "doc", "left_semi")
        wanted = read.select("text").mapInArrow(_Texts(), "node long, line string").join(nodes, "node", "left_semi")
        wanted = linking.checkpoint(wanted.groupBy("node").agg(F.first("line").alias("line")))
        x, y = wanted.select(F.col("node").alias("a"), F.col("line").alias("x")), wanted.select(F.col("node").alias("b"), F.col("line").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_Confirm(threshold, chars_per_edit), "a long, b long")

    alike = "bit_count({0}.s0 ^ {1}.s0) <= %d and bit_count({0}.s1 ^ {1}.s1) <= %d" % (2 * threshold, 4 * threshold)

    def compare(pairs: DataFrame) -> DataFrame:
        found = verify(pairs.where(alike.format("leader_size", "size")).select(F.col("leader").alias("a"), F.col("node").alias("b")))
        return found.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.lit(True).alias("linked"))

    def cut(level: int) -> tuple[str, int, int]:
        """Sketch, number and width of the parts of a round: one part more than bits that a link may change."""
        sketch, parts = ("s0", 2 * threshold + 1) if level == 1 else ("s1", 4 * threshold + 1)
        return sketch, parts, -(-64 // parts)

    def narrow(seen: DataFrame, level: int) -> DataFrame:
        """Buckets by parts of the sketches."""
        sketch, parts, width = cut(level)
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        rows = seen.select(F.xxhash64("path", "leader").alias("path"), "node", "size", part.alias("part"))
        bits = F.expr(f"shiftrightunsigned(size.{sketch}, part * {width}) & {(1 << width) - 1}L")
        keyed = rows.select(F.xxhash64("path", "part", bits).alias("key"), "path", "node", "size", F.lit(True).alias("lead"), F.lit(level).alias("round"), "part")
        return keyed.distinct()

    def first_part(level: int) -> str:
        """Whether two rows are in the first of the parts that they have alike: there they are tried."""
        sketch, parts, width = cut(level)
        differ = f"shiftrightunsigned(x.size.{sketch} ^ y.size.{sketch}, %d) & {(1 << width) - 1}L"
        return " and ".join(f"(x.part <= {p} or ({differ % (p * width)}) <> 0)" for p in range(parts - 1))

    able = f"{alike.format('x.size', 'y.size')} and case when x.round = 1 then {first_part(1)} else {first_part(2)} end"
    return linking.classes(buckets, compare, narrow, verify, able, levels=2)


def removals(texts: DataFrame, threshold: int, chars_per_edit: int) -> DataFrame:
    """(doc_id, version, gone): the numbers of the lines that go; a version is the hash of a text."""
    keyed = linking.stored(texts.mapInArrow(_Read(threshold, chars_per_edit), _Read.SCHEMA))
    lines = linking.stored(keyed.select("doc_id", "version", "line_no", "node"))
    place = F.struct("doc_id", "line_no", "version")
    firsts = linking.stored(lines.groupBy("node").agg(F.min(place).alias("first"), F.max(place).alias("last")))
    roots = line_classes(texts, keyed, firsts, threshold, chars_per_edit)
    if roots is None:
        stays = firsts.where("not first <=> last").select("node", F.col("first").alias("stays"))
    else:
        classes = firsts.join(roots, "node", "left").where("root is not null or not first <=> last").select("node", "first", F.coalesce("root", "node").alias("root"))
        least = classes.groupBy("root").agg(F.min("first").alias("stays"))
        stays = classes.join(least, "root").select("node", "stays")
    gone = lines.select("doc_id", "version", "line_no", "node").join(stays, "node").where("not (doc_id <=> stays.doc_id and line_no = stays.line_no)")
    return gone.groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("gone"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rewrites the text without the lines that go."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, gone in enumerate(batch.column("gone").to_pylist()):
            if gone:
                out = set(gone)
                texts[i] = "\n".join(p for j, p in enumerate(texts[i].split("\n")) if j not in out)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), batch.column("n_lines"), batch.column("n_gone")], ["row", "text", "n_lines", "n_gone"])


def deduped(docs: DataFrame, *, threshold: int = 2, chars_per_edit: int = 10) -> DataFrame:
    """One row per document: row (a struct of its other columns), text without the lines that go, n_lines, n_gone."""
    others = [c for c in docs.columns if c.lower() != "text"]
    texts = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").cast("string").alias("text"))
    texts = texts.select("row", "text", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"))
    gone = removals(texts.select("doc_id", "text", "version"), threshold, chars_per_edit)
    linking.release(docs.sparkSession)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), "gone")
    joined = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
    n_lines = F.when(F.col("text").isNull(), 1).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    rows = joined.select("row", "text", "gone", n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_gone"))
    schema = StructType([texts.schema["row"]]).add("text", "string").add("n_lines", "long").add("n_gone", "long")
    return rows.mapInArrow(_rebuild, schema)


def dedup_lines(docs: DataFrame, *, drop_emptied: bool = False, **parameters) -> DataFrame:
    """``docs`` with the removed lines cut from text. With ``drop_emptied``, a document goes that had lines and has none left."""
    out = deduped(docs, **parameters)
    if drop_emptied:
        out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_gone") == 0))
    columns = []
    for c, kind in docs.dtypes:
        own = F.col("text") if c.lower() == "text" else F.col("row").getField(c)
        if c.lower() == "n_chars" and drop_emptied:
            own = F.when(F.col("n_gone") > 0, F.length("text").cast(kind)).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns)
