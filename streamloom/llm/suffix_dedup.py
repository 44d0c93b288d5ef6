"""Removal of byte strings that occur elsewhere: every byte covered by a ``window``-byte string that also
starts anywhere else in the corpus goes.

The corpus operator does not build a suffix array of the corpus: the README gives the figures that rule it
out here. It decides the same question, exactly up to 64-bit hashes, from content-defined anchors:

1. The anchor of a window is the place of the smallest hash among its ``GRAM``-byte strings, so equal
   windows have equal anchors at equal offsets. Windows that share an anchor are a run, and an anchor whose
   string is the only one of its kind ends the matter for its run.
2. Runs of equal extent (all bytes of all their windows) are repeated whole. Only one run of each extent
   goes on, and only where an anchor's string has different extents: at the edges of repeated passages.
3. There runs are cut into blocks of ``BLOCK`` offsets, compared by the bytes common to all windows of the
   block and by extent again, and what is still open is compared window by window.

``difference_cover_order`` is the suffix sorter of the method named for small collections: sampled triples
are sorted and named, names are sorted recursively, the remaining suffixes are merged in, and
``repeated_by_suffix_order`` compares adjacent prefixes.

Nulls: a null text is empty. A null doc_id is an id of its own. Repeated rows are copies of one another.
Matches never cross texts. Empty tables give no rows; extra columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm import linking
from streamloom.llm.text import Slice, mix, prefix_hash, slices, span_hash

WINDOW, GRAM, BLOCK = 200, 32, 16
#: Runs to cut are sent to all tasks up to this many (about 40 bytes each); beyond, texts are shuffled to them.
MAX_BROADCAST_RUNS = 2_000_000


def difference_cover_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of positive symbols, by the difference cover {1, 2} modulo 3."""
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    s = np.append(symbols.astype(np.int64), [0, 0, 0])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = np.stack([s[sample], s[sample + 1], s[sample + 2]], axis=1)
    _, names = np.unique(triples, axis=0, return_inverse=True)
    names = names.ravel() + 1
    if names.max() < len(sample):
        # a text's end has a smaller name than any other, so suffixes of the first half never run on
        order = difference_cover_order(names)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], s[rest]))]
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # a remaining suffix stands after the samples of either class that are smaller by its key
    before = np.zeros(len(rest), dtype=np.int64)
    for kind in (1, 2):
        own = sampled[sampled % 3 == kind]
        keys = np.stack([s[own], rank[own + 1]] if kind == 1 else [s[own], s[own + 1], rank[own + 2]], axis=1)
        asked = np.stack([s[rest], rank[rest + 1]] if kind == 1 else [s[rest], s[rest + 1], rank[rest + 2]], axis=1)
        both = np.concatenate([keys, asked])
        owner = np.concatenate([np.zeros(len(keys), np.int64), np.ones(len(asked), np.int64)])
        order = np.lexsort(tuple(both[:, c] for c in reversed(range(both.shape[1]))))
        seen = np.cumsum(owner[order] == 0)
        place = np.empty(len(both), dtype=np.int64)
        place[order] = seen
        before += place[len(keys) :]
    return np.insert(sampled, before, rest)


def repeated_by_suffix_order(texts: list[bytes], window: int) -> list[np.ndarray]:
    """Per text, whether a window that starts at each byte also starts elsewhere: adjacent prefixes of the suffix array."""
    joined, at = [], []
    for i, t in enumerate(texts):
        at.append(sum(map(len, joined)))
        joined.append(np.append(np.frombuffer(t, np.uint8).astype(np.int64) + len(texts) + 1, i + 1))
    all_ = np.concatenate(joined) if joined else np.zeros(0, np.int64)
    order = difference_cover_order(all_)
    flag = np.zeros(len(all_), dtype=bool)
    for a, b in zip(order, order[1:]):
        x, y = all_[a : a + window], all_[b : b + window]
        if len(x) == len(y) == window and (x == y).all() and x.min() > len(texts):
            flag[a] = flag[b] = True
    return [flag[a : a + len(t)] for a, t in zip(at, texts)]


def _document(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + texts)


def _keys(s: Slice, column: pa.Array) -> np.ndarray:
    """64 bits for each document of a slice: its id and its text."""
    part = column.slice(s.first, len(s))
    ids = part.fill_null(0).to_numpy(zero_copy_only=False) ^ part.is_null().to_numpy(zero_copy_only=False).astype(np.int64) * 0x5DEECE66D
    return _document(ids, span_hash(prefix_hash(s.data), s.offsets[:-1], s.offsets[1:]))


class _Runs:
    """One row per run: doc, place (first window << 16 | windows - 1 << 8 | anchor's offset in the first), gram, extent."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W, grams = self.window, self.window - GRAM + 1
        for batch in batches:
            for s in slices(batch.column("text")):
                n = len(s.data)
                if n < W:
                    continue
                prefix = prefix_hash(s.data)
                at = np.arange(n - GRAM + 1)
                value = span_hash(prefix, at, at + GRAM) >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
                cells = np.append(value, np.full(-len(value) % grams, ~np.uint64(0))).reshape(-1, grams)
                ahead = np.minimum.accumulate(cells, axis=1).ravel()
                back = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
                p = np.arange(n - W + 1)
                anchor = (np.minimum(back[p], ahead[p + grams - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                owner = np.repeat(np.arange(len(s)), np.diff(s.offsets))[: n - W + 1]
                ok = np.flatnonzero(s.offsets[owner + 1] - p >= W)
                if not len(ok):
                    continue
                cut = np.flatnonzero((anchor[ok][1:] != anchor[ok][:-1]) | (ok[1:] != ok[:-1] + 1))
                first, last = ok[np.append(0, cut + 1)], ok[np.append(cut, len(ok) - 1)]
                a = anchor[first]
                doc = owner[first]
                start = first - s.offsets[doc]
                keys = _keys(s, batch.column("doc_id"))[doc]
                place = start << 16 | (last - first) << 8 | (a - first)
                extent = mix(span_hash(prefix, first, last + W) + mix((a - first).astype(np.uint64)))
                columns = (keys.view(np.int64), place, span_hash(prefix, a, a + GRAM).view(np.int64), extent.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "place", "gram", "extent"])


class _Cut:
    """The bytes of the runs that a document lists."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for s in slices(batch.column("text")):
                keys = _keys(s, batch.column("doc_id")).view(np.int64)
                docs, places, parts = [], [], []
                for i in range(len(s)):
                    text = None
                    for item in wanted[s.first + i].as_py():
                        doc, place = item["doc"], item["place"]
                        if doc == keys[i]:
                            text = s.text(i) if text is None else text
                            start, more = place >> 16, place >> 8 & 255
                            docs.append(doc)
                            places.append(place)
                            parts.append(text[start : start + more + self.window])
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(parts, pa.binary())], ["doc", "place", "bytes"])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [x.as_buffer() for x in column]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes


class _Blocks:
    """Runs cut at multiples of BLOCK of the anchor's offset; gram is what all windows of the block share."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W = self.window
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                data, base, _ = _joined(batch.column("bytes"))
                prefix = prefix_hash(data)
                place = batch.column("place").to_numpy()
                more, offset = place >> 8 & 255, place & 255
                least, most = (offset - more) // BLOCK, offset // BLOCK  # blocks of offsets that the run spans
                count = most - least + 1
                row = np.repeat(np.arange(len(place)), count)
                j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + least[row]
                high = np.minimum(offset[row], j * BLOCK + BLOCK - 1)
                low = np.maximum(offset[row] - more[row], j * BLOCK)
                first = offset[row] - high  # windows from the run's first
                anchor = base[row] + offset[row]
                shared = anchor - j * BLOCK
                # the shared bytes begin where the block's last possible window does and end where its first does
                gram = mix(span_hash(prefix, shared, shared + W - BLOCK + 1) + mix(j.astype(np.uint64)))
                begin, end = base[row] + first, base[row] + first + (high - low) + W
                extent = mix(span_hash(prefix, begin, end) + mix((anchor - begin).astype(np.uint64) + np.uint64(1) + (j.astype(np.uint64) << np.uint64(20))))
                docs = batch.column("doc").to_numpy()[row]
                block = ((place >> 16)[row] + first) << 16 | (high - low) << 8 | high
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (docs, block, gram.view(np.int64), extent.view(np.int64), place[row])], ["doc", "place", "gram", "extent", "run"])


class _Windows:
    """Every window of a block, by its hash."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W = self.window
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                data, base, _ = _joined(batch.column("bytes"))
                prefix = prefix_hash(data)
                run, block = batch.column("run").to_numpy(), batch.column("place").to_numpy()
                count = (block >> 8 & 255) + 1
                row = np.repeat(np.arange(len(block)), count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = (block >> 16)[row] + step
                inside = base[row] + start - (run >> 16)[row]
                h = span_hash(prefix, inside, inside + W)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc").to_numpy()[row]), pa.array(start << 16), pa.array(h.view(np.int64))], ["doc", "place", "extent"])


def _decide(rows: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc, place, gram, extent): those repeated whole, and those that stay open, one per extent.

    A gram of one row is settled. Extents that stand twice are repeated; where a gram has more than one
    extent, each is kept once, as open or as what others may equal.
    """
    grams = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("extent").alias("p"), F.max("extent").alias("q")).where("n > 1").select("gram", (F.col("p") != F.col("q")).alias("mixed"))
    shared = linking.checkpoint(rows.join(grams, "gram").select("doc", "place", "extent", "mixed", *extra))
    mixed = shared.where("mixed").groupBy("extent").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place", *extra)).alias("r"))
    mixed = linking.checkpoint(mixed)
    twice = shared.where("mixed").join(mixed.where("n > 1").select("extent"), "extent").select("doc", "place")
    whole = shared.where("not mixed").select("doc", "place").unionByName(twice)
    return whole, mixed.select("r.*", (F.col("n") > 1).alias("done"))


class _Rebuild:
    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            for s in slices(batch.column("text")):
                keys = _keys(s, batch.column("doc_id")).view(np.int64)
                out: list[tuple] = []
                for i in range(len(s)):
                    text = s.text(i)
                    places = lists[s.first + i].values
                    flat = places.field("place").to_numpy()[places.field("doc").to_numpy() == keys[i]] if places is not None and len(places) else np.zeros(0, np.int64)
                    removed, spans, kept = 0, 0, text
                    if len(flat):
                        edge = np.zeros(len(text) + 1, dtype=np.int64)
                        start = flat >> 16
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + (flat >> 8 & 255) + self.window, -1)
                        covered = np.cumsum(edge)[:-1] > 0
                        removed = int(covered.sum())
                        spans = int((np.diff(np.concatenate([[0], covered.astype(np.int8)])) == 1).sum())
                        kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                    out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*out))
                ids = batch.column("doc_id").slice(s.first, len(s))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    if not GRAM + BLOCK < window <= GRAM + 255:
        raise ValueError(f"window must be over {GRAM + BLOCK} and at most {GRAM + 255}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = texts.mapInArrow(_Runs(window), "doc long, place long, gram long, extent long")
    whole, open_ = _decide(runs, [])
    open_ = linking.checkpoint(open_)
    keyed = texts.mapInArrow(_Identify(), "doc_id long, doc long")
    ids = keyed.distinct()
    wanted = open_.join(ids, "doc").groupBy("doc_id").agg(F.collect_list(F.struct("doc", "place")).alias("wanted"))
    wanted = linking.checkpoint(wanted.withColumnRenamed("doc_id", "__id"))
    if open_.count() <= MAX_BROADCAST_RUNS:
        wanted = F.broadcast(wanted)
    cut = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "wanted").mapInArrow(_Cut(window), "doc long, place long, bytes binary").dropDuplicates(["doc", "place"])
    cut = linking.checkpoint(cut)
    blocks = cut.mapInArrow(_Blocks(window), "doc long, place long, gram long, extent long, run long")
    again, left = _decide(blocks, ["run"])
    pieces = left.join(cut.withColumnRenamed("place", "run"), ["doc", "run"]).select("doc", "run", "place", "bytes")
    windows = pieces.mapInArrow(_Windows(window), "doc long, place long, extent long")
    equal = windows.groupBy("extent").agg(F.count("*").alias("n")).where("n > 1").select("extent")
    last = windows.join(equal, "extent").select("doc", "place")
    marks = whole.unionByName(again).unionByName(last).join(ids, "doc").groupBy("doc_id").agg(F.collect_list(F.struct("doc", "place")).alias("places")).withColumnRenamed("doc_id", "__id")
    out = texts.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "places")
    return out.mapInArrow(_Rebuild(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


class _Identify:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, len(s)), pa.array(_keys(s, batch.column("doc_id")).view(np.int64))], ["doc_id", "doc"])
