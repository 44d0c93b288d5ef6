"""Benchmark decontamination: spaced-seed hashing.

Words are runs of letters, digits and bytes beyond ASCII, in ASCII lower case.
Each of a few fixed masks looks at some of the words of a window and ignores
the others, so that a substituted word spoils the hashes of some masks at some
places only. Hashes of the corpus are looked up among those of the benchmark,
and around each hit the two texts are laid on one another: a document is
contaminated by an item if, on that diagonal, ``min_words`` consecutive words
(all of a shorter item) agree in ``percent`` of their places or more. ``complete`` proves for the parameters given that
every such overlap of ``min_words`` words has a hit; others are refused. Items of
fewer words, where the masks would miss some, have masks of their own length
that ignore each choice of as many parts as words may differ.

The benchmark is the small side: it is read in blocks of at most
``block_words`` words. One block's index at a time, of bounded size, is sent to
all tasks, the corpus is passed through, what it hits is written down, and the
index is released before the next block is read.

Nulls: null texts are empty and match nothing; null item_ids are left out; a
null doc_id is an id of its own. Repeated items count once. Repeated doc_ids:
each row is judged by its own text. Empty tables contaminate nothing. Extra
columns pass, whatever their names, or are ignored. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm import linking
from streamloom.llm.text import Slice, mix, slices, word_hash

#: The places that each mask compares (1) and ignores (0).
MASKS = ("11111", "11011001", "1101000011", "110000101001")
MIN_WORDS, PERCENT, BLOCK_WORDS = 13, 80, 500_000
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_TABLE_BITS = 24
#: Hit documents are sent to all tasks up to this many (16 bytes each); beyond, they are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def complete(masks: tuple[str, ...], min_words: int, percent: int) -> bool:
    """Whether any choice of words that may differ in a window leaves some mask, somewhere in it, unspoiled."""
    spoiled = min_words - -(-percent * min_words // 100)
    seeds = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks for at in range(min_words - len(m) + 1)]
    return all(any(seed.isdisjoint(chosen) for seed in seeds) for chosen in combinations(range(min_words), spoiled))


def words_of(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """document and hash of each word of a slice."""
    solid = _WORD[s.data]
    edge = np.zeros(len(s.data) + 1, dtype=bool)
    edge[s.offsets] = True
    begins, ends = solid.copy(), solid.copy()
    if len(solid):
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(s.offsets, start, side="right") - 1, word_hash(s.data, start, end, True)


def _seeds(words: np.ndarray, owner: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the mask at each place where it fits into one text."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[: len(words) - span + 1] == owner[span - 1 :])
    h = np.full(len(at), number + 1, dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[at + i])
    return at, h


def short_masks(n: int, percent: int) -> list[np.ndarray]:
    """Places to compare in an item of n words, such that any allowed choice of differing places is ignored by one."""
    spoiled = n - -(-percent * n // 100)
    parts = np.arange(n) * min(n, spoiled + 2) // n
    return [np.flatnonzero(~np.isin(parts, ignored)) for ignored in combinations(range(int(parts[-1]) + 1), spoiled)]


def _picked(words: np.ndarray, at: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(at), salt, dtype=np.uint64)
    for i in places:
        h = mix(h * np.uint64(31) + words[at + i])
    return h


class Index:
    """A block of the benchmark: its words end to end, and where each seed hash stands."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple[str, ...] = MASKS, percent: int = PERCENT, min_words: int = MIN_WORDS):
        self.ids = np.array(ids, dtype=np.int64)
        owners, words, shift = [], [], 0
        for s in slices(pa.array(texts, pa.string())):
            doc, h = words_of(s)
            owners.append(doc + shift)
            words.append(h)
            shift += len(s)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        self.masks = masks
        found = [_seeds(self.words, self.owner, m, i) for i, m in enumerate(masks)]
        # by length and mask: the hash of each short item
        self.short: dict[int, list[tuple[np.ndarray, dict[int, list[int]]]]] = {}
        sizes = np.diff(self.bounds)
        for n in np.unique(sizes[(sizes > 0) & (sizes < min_words)]).tolist():
            items = np.flatnonzero(sizes == n)
            for number, places in enumerate(short_masks(n, percent)):
                table: dict[int, list[int]] = {}
                for i, x in zip(items.tolist(), _picked(self.words, self.bounds[items], places, 16 * n + number).tolist()):
                    table.setdefault(x, []).append(i)
                self.short.setdefault(n, []).append((places, table))
        at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]
        self.table = np.zeros(1 << (_TABLE_BITS - 3), dtype=np.uint8)
        low = (self.hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)
        np.bitwise_or.at(self.table, low >> 3, (1 << (low & 7)).astype(np.uint8))


def contaminated(index: Index, s: Slice, min_words: int, percent: int) -> dict[int, set[int]]:
    """Numbers of the documents of a slice that are contaminated, with the places of their items in the index."""
    owner, words = words_of(s)
    bounds = np.searchsorted(owner, np.arange(len(s) + 1))
    out: dict[int, set[int]] = {}
    for n, tables in index.short.items():
        if len(words) < n:
            continue
        at = np.flatnonzero(owner[: len(words) - n + 1] == owner[n - 1 :])
        for number, (places, table) in enumerate(tables):
            h = _picked(words, at, places, 16 * n + number)
            for j in np.flatnonzero(np.isin(h, np.array(list(table), dtype=np.uint64))):
                doc, w = int(owner[at[j]]), words[at[j] : at[j] + n]
                for item in table[int(h[j])]:
                    if item not in out.get(doc, ()) and 100 * int((w == index.words[index.bounds[item] : index.bounds[item + 1]]).sum()) >= percent * n:
                        out.setdefault(doc, set()).add(item)
    for number, mask in enumerate(index.masks):
        at, h = _seeds(words, owner, mask, number)
        low = (h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)
        maybe = np.flatnonzero(index.table[low >> 3] >> (low & 7).astype(np.uint8) & 1)
        at, h = at[maybe], h[maybe]
        left, right = np.searchsorted(index.hashes, h), np.searchsorted(index.hashes, h, side="right")
        hit = np.flatnonzero(right > left)
        tried: set[tuple[int, int, int]] = set()
        for i in hit:
            p, doc = int(at[i]), int(owner[at[i]])
            for k in range(left[i], right[i]):
                q = int(index.at[k])
                item = int(index.owner[q])
                if (doc, item, p - q) in tried or item in out.get(doc, ()):
                    continue
                tried.add((doc, item, p - q))
                back = min(p - bounds[doc], q - index.bounds[item])
                ahead = min(bounds[doc + 1] - p, index.bounds[item + 1] - q)
                same = np.concatenate([[0], np.cumsum(words[p - back : p + ahead] == index.words[q - back : q + ahead])])
                need = min(min_words, int(index.bounds[item + 1] - index.bounds[item]))
                if len(same) > need and (100 * (same[need:] - same[:-need])).max() >= percent * need:
                    out.setdefault(doc, set()).add(item)
    return out


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark's items in blocks of bounded size, as the driver reads them partition by partition."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        n = len(_WORDS.findall(row["text"]))
        if held and held + n > block_words:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += n
    if ids:
        yield ids, texts


class _Hits:
    """For each text that an item of this block contaminates, its doc_id and version with the item's id."""

    def __init__(self, index, min_words: int, percent: int):
        self.index, self.min_words, self.percent = index, min_words, percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = self.index.value
        for batch in batches:
            pairs = []
            for s in slices(batch.column("text")):
                for i, items in contaminated(index, s, self.min_words, self.percent).items():
                    pairs += [(s.first + i, int(index.ids[item])) for item in items]
            if pairs:
                rows = pa.array([r for r, _ in pairs], pa.int64())
                own = [batch.column(c).take(rows) for c in ("doc_id", "version")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([i for _, i in pairs], pa.int64())], ["doc_id", "version", "item_id"])


def hits(texts: DataFrame, benchmark: DataFrame, min_words: int, percent: int, block_words: int) -> DataFrame:
    """(doc_id, version, item_id) of contaminated texts (doc_id, text, version), block by block; a version is a text's hash."""
    if not complete(MASKS, min_words, percent):
        raise ValueError(f"the masks would miss overlaps of {min_words} words at {percent} percent")
    spark, found = texts.sparkSession, None
    for ids, items in blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(Index(ids, items, MASKS, percent, min_words))
        part = linking.checkpoint(texts.mapInArrow(_Hits(index, min_words, percent), "doc_id long, version long, item_id long"))
        index.unpersist()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "doc_id long, version long, item_id long") if found is None else found


def _texts(docs: DataFrame) -> DataFrame:
    """row (a struct of the document's own columns), doc_id, text and version."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row.text").cast("string")
    return own.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items and item_ids, sorted."""
    texts = _texts(docs).drop("row")
    found = hits(texts, benchmark, min_words, percent, block_words)
    lists = found.groupBy(F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = texts.select("doc_id", "version").join(lists, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version")), "left")
    items = F.coalesce("item_ids", F.array().cast("array<long>"))
    return out.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their own columns."""
    texts = _texts(docs)
    found = linking.checkpoint(hits(texts.drop("row"), benchmark, min_words, percent, block_words).select(F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version")).distinct())
    if found.count() <= MAX_BROADCAST_ROWS:
        found = F.broadcast(found)
    left = texts.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version")), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
