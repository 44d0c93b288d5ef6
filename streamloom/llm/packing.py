"""Packing: Karmarkar-Karp multiway differencing.

Each document is its token ids and a closing id. Whole windows are cut off a
document as they are; what remains, cut into pieces of at most ``max_piece``
ids, is collected into blocks of about ``block_windows`` windows and dealt out
by multiway differencing: the two partial partitions of the largest spread are
merged with their imbalances opposed, again and again, until one partition of
near-equal windows is left. If one of its windows is over capacity, the number
of windows is raised and the block dealt again. Padding is thus about one part
in ``block_windows`` of what remains.

A partition of the input is tokenized and packed where it is: nothing is
shuffled, windows never span partitions, and a lost task is simply run again.
``sequence_id`` holds the partition's number in its high bits.

Nulls: a null text is empty, so its document is the closing id alone; a null
doc_id is kept. Repeated rows are packed once each. Empty tables give no rows;
extra columns are ignored. A long text is tokenized whole, one at a time.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers before it starts afresh.
MEMO = 200_000

#: A space amid white space, where a word's first space is not where a token begins.
_RUN = re.compile(r"\s (?=\s|\Z)")


class WordTokenizer(dict):
    """Packed ids of each space-led word, found once and remembered.

    The vocabulary's splitting rule ends a token before every single space, so a text's ids are those
    of its space-led words end to end, unless a space stands amid other white space; such texts are
    tokenized whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(word) < 40:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if _RUN.search(text):
            return np.array(self.encode(text), dtype="<u4")
        words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u4")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items into ``windows`` sets of near-equal sums; returns the item numbers of each set.

    A partial partition is its sums, largest first and reduced so that the last is 0, with the items
    behind each. Merging adds one's largest to the other's smallest.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, np.ndarray, list]] = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [i] + [None] * (windows - 1)))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums = a + b[::-1]
        sets = [x if y is None else y if x is None else (x, y) for x, y in zip(own, reversed(other))]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums[order[-1]]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, [sets[i] for i in order]))
        turn += 1
    out = []
    for tree in heap[0][3]:
        items, stack = [], [] if tree is None else [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, tried from the total upwards, that differencing fills without one over capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, windows)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            return [s for s in sets if s]
        windows += max(1, windows // 128)


class _Pack:
    def __init__(self, ranks_path: str, pattern: str, window: int, block_windows: int, max_piece: int):
        self.args = ranks_path, pattern
        self.window, self.block, self.max_piece = window, block_windows * window, max_piece

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, rest, held = _tokenizer(*self.args), [], 0
        self.next = TaskContext.get().partitionId() << 33
        self.rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = words.ids(text.as_py() or "")
                total, start = len(ids) + 1, 0
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                crc = lambda a, b: zlib.crc32(ids[a:b].tobytes())  # noqa: B023, E731
                while total - start >= self.window:
                    self.rows.append((doc, start, self.window, crc(start, start + self.window), total, self.next, 0))
                    self.next += 1
                    start += self.window
                while start < total:
                    n = min(self.max_piece, total - start)
                    rest.append((doc, start, n, crc(start, start + n), total))
                    held += n
                    start += n
                if held >= self.block:
                    self._close(rest)
                    rest, held = [], 0
                if len(self.rows) >= 20_000:
                    yield self._flush()
        if rest:
            self._close(rest)
        if self.rows:
            yield self._flush()

    def _close(self, pieces: list[tuple]) -> None:
        for window in deal([p[2] for p in pieces], self.window):
            at = 0
            for i in window:
                self.rows.append((*pieces[i], self.next, at))
                at += pieces[i][2]
            self.next += 1

    def _flush(self) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*self.rows)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])


_made: dict[tuple, WordTokenizer] = {}


def _tokenizer(*args: str) -> WordTokenizer:
    if args not in _made:
        _made[args] = WordTokenizer(*args)
    return _made[args]


def pack(docs: DataFrame, ranks_path: str, pattern: str, *, window: int = WINDOW, block_windows: int = 128, max_piece: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_Pack(ranks_path, pattern, window, block_windows, max_piece), SCHEMA)
