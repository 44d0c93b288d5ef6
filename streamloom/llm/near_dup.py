"""MinHash near-dedup: min-max hashing.

A text's set is its distinct k-word shingles, as 64-bit hashes, over words in
ASCII lower case. Each hash function (a multiplication and a shift) is
evaluated once on a set, and both its minimum and its maximum are kept: each
agrees between two sets with the probability of their Jaccard similarity, and
the two are negatively correlated, so a signature of twice the length, and of
lower variance, comes from half the evaluations. ``bands`` bands of ``rows``
values bucket the sets; pairs are then confirmed on full sets, exactly, in
integers: ``100 * intersection >= percent * union``. A pair misses all
of 32 bands of 6 values with probability 6e-5 at similarity 0.8, 2.6e-7 at 0.85
and 3e-11 at 0.9, taking values as independent.

Texts with equal sets are one class from the start, held by a 128-bit digest.
Others are linked by ``linking.classes``, which never makes all pairs of a bucket.

Nulls: a null text is empty; a text without words has an empty set and is
linked with nothing, being its own component. A null doc_id takes part in its
component but never names it unless all are null; it is kept only if it does.
Repeated doc_ids: every row is answered for its own text. Empty tables give no
rows; extra columns are ignored. Long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm import linking
from streamloom.llm.text import mix, shingles, slices

#: Ids of texts to be read again or dropped, and of pairs to be confirmed, are sent to all tasks up to this many (up to
#: 32 bytes each); beyond, texts or sets are shuffled.
MAX_BROADCAST_ROWS = 1_000_000


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[first], h[first]


def _digest(doc: np.ndarray, h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[bytes]:
    """16 bytes of each set, alike for alike sets whatever their order."""
    a = np.add.reduceat(mix(h + np.uint64(0x51ED270B)), starts)
    b = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xA5A5F00D12345678)), starts)
    return [x.tobytes() for x in np.stack([mix(a + n.astype(np.uint64)), mix(b + a)], axis=1)]


class _Signatures:
    def __init__(self, k: int, bands: int, rows: int):
        if bands * rows % 2:
            raise ValueError("bands * rows must be even")
        self.k, self.bands, self.rows = k, bands, rows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = self.bands * self.rows // 2
        multipliers = mix(np.arange(1, half + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        for batch in batches:
            for s in slices(batch.column("text"), 1 << 19):
                n = len(s)
                _, _, doc, words = s.words(lower=True)
                doc, h = _distinct(*shingles(words, doc, n, self.k))
                sizes = np.bincount(doc, minlength=n)
                some = np.flatnonzero(sizes)
                digest: list = [None] * n
                lists = pa.array([None] * n, pa.list_(pa.int64()))
                if len(some):
                    starts = np.searchsorted(doc, some)
                    for i, d in zip(some, _digest(doc, h, starts, sizes[some])):
                        digest[i] = d
                    values = np.empty((len(some), self.bands * self.rows), dtype=np.uint64)
                    for i, m in enumerate(multipliers):
                        g = h * m
                        g ^= g >> np.uint64(32)
                        g *= m
                        values[:, 2 * i] = np.minimum.reduceat(g, starts)
                        values[:, 2 * i + 1] = np.maximum.reduceat(g, starts)
                    keys = np.zeros((len(some), self.bands), dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
                    # a band takes values half the signature apart, never both of one hash function
                    spread = np.concatenate([values[:, 0::2], values[:, 1::2]], axis=1).reshape(len(some), self.bands, self.rows)
                    for r in range(self.rows):
                        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + spread[:, :, r])
                    where = np.zeros(n + 1, dtype=np.int32)
                    where[1:] = np.cumsum(np.where(sizes > 0, self.bands, 0))
                    lists = pa.ListArray.from_arrays(pa.array(where), pa.array(keys.ravel().view(np.int64)))
                own = [batch.column(c).slice(s.first, n) for c in ("doc_id", "version")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes.astype(np.int64)), pa.array(digest, pa.binary()), lists], ["doc_id", "version", "n_shingles", "digest", "bands"])


class _Sets:
    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                n = len(s)
                _, _, doc, words = s.words(lower=True)
                doc, h = _distinct(*shingles(words, doc, n, self.k))
                sizes = np.bincount(doc, minlength=n)
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                starts = np.searchsorted(doc, some)
                nodes = _digest(doc, h, starts, sizes[some])
                sets = [h[a : a + m].tobytes() for a, m in zip(starts, sizes[some])]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])


class _Confirm:
    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= self.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Compare:
    """A node beside its leader: whether they are linked, and what a link of the node to a third must share of what sets it apart.

    Write D(x) for the difference of a set x from its leader c, and A(x) for the part of it outside c. For two
    sets the difference of x and y is that of D(x) and D(y), so x and y are linked just if the common part of
    D(x) and D(y) reaches (e(x) + e(y)) / 2, with e(x) = |D(x)| - k |x| and k = (100 - percent) / (100 + percent),
    and x is linked to c just if e(x) <= k |c|. Two links of c are of one class anyway, so only pairs matter
    of which one is no link of c (``far``).

    Put D(x) in an order that all sets keep: first A(x), then what x lacks of c, either by hash. If two sets
    share r of n and m, the first n - r + 1 of the one and the first m - r + 1 of the other hold a shared one:
    the first that they share. A set has r >= (e + k |c|) / 2 with any far set (``lead`` of its D), and a far
    set r >= e(x) - 100 k |x| / percent with any set at all; ``first`` has D(x) as far as that goes. What a word
    replaced adds to a set is half of D(x) and rarely shared, so hardly any of the frequent lacks are listed.
    """

    SCHEMA = "leader long, node long, linked boolean, far boolean, apart int, excess long, lead int, first array<long>"

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q, w = self.percent, 100 - self.percent, 100 + self.percent
        for batch in batches:
            rows, firsts = [], []
            for c, x in zip(batch.column("x"), batch.column("y")):
                c, x = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (c, x))
                more = x[c[np.minimum(np.searchsorted(c, x), len(c) - 1)] != x]
                less = c[x[np.minimum(np.searchsorted(x, c), len(x) - 1)] != c]
                apart = len(more) + len(less)
                excess, bound = w * apart - q * len(x), q * len(c)
                far = excess > bound
                half = max(1, -(-(excess + bound + 1) // (2 * w)))
                full = max(1, -(-(excess - bound) // (2 * w)), -(-(excess * p - q * 100 * len(x)) // (w * p))) if far else half
                lead = max(0, apart - half + 1)
                rows.append((not far, far, apart, excess, lead))
                firsts.append(np.concatenate([more, less])[: max(lead, apart - full + 1)].view(np.int64))
            if rows:
                columns = [pa.array(v, t) for v, t in zip(zip(*rows), [pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int32()])]
                yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node"), *columns, pa.array(firsts, pa.list_(pa.int64()))], ["leader", "node", "linked", "far", "apart", "excess", "lead", "first"])


#: What stands right before an element goes with it: two nodes that share some of that have met there already.
PRIOR = 8


def _narrow(seen: DataFrame, level: int) -> DataFrame:
    """Buckets of nodes that share what sets them apart from their leader, by the rule of ``_Compare``."""
    rows = seen.select(F.xxhash64("path", "leader").alias("path"), "node", "size", "far", "apart", "excess", "lead", "first", F.posexplode("first").alias("at", "h"))
    prior = F.slice("first", F.greatest(F.col("at") - PRIOR + 1, F.lit(1)), F.least("at", F.lit(PRIOR)))
    return rows.select(F.xxhash64("path", "h").alias("key"), "path", "node", "size", (F.col("at") < F.col("lead")).alias("lead"), "far", (F.col("apart") - F.col("at")).alias("rest"), "excess", prior.alias("prior"))


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _judged(docs, k, percent, bands, rows).drop("version")


def _judged(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    versions = texts.withColumn("version", F.xxhash64("text"))
    signed = linking.checkpoint(versions.mapInArrow(_Signatures(k, bands, rows), "doc_id long, version long, n_shingles long, digest binary, bands array<long>"))
    nodes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    nodes = linking.checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    buckets = nodes.select(F.explode("bands").alias("key"), "node", "size", F.lit(True).alias("lead"))
    held: dict[str, DataFrame] = {}

    def fetch(tried: DataFrame) -> DataFrame:
        """The sets of these nodes, made from their texts once."""
        if "sets" in held:
            tried = tried.join(held["sets"].select("node"), "node", "left_anti")
        chosen = linking.checkpoint(nodes.select("node", "digest", "first_id").join(tried, "node"))
        count = chosen.count()
        if count or "sets" not in held:
            wanted, named = chosen.select(F.col("first_id").alias("wanted")).distinct(), chosen.select("node", "digest")
            if count <= MAX_BROADCAST_ROWS:
                wanted, named = F.broadcast(wanted), F.broadcast(named)
            found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(_Sets(k), "digest binary, shingles binary")
            found = linking.checkpoint(found.join(named, "digest").select("node", "shingles"))
            if found.count() > count:  # rows of one doc_id, or of none, gave a set more than once
                found = linking.checkpoint(found.groupBy("node").agg(F.first("shingles").alias("shingles")))
            held["sets"] = found.unionByName(held["sets"]) if "sets" in held else found
        return held["sets"]

    def beside(pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs with the sets of both: ids go to where the sets lie, and sets are shuffled once, by ``a``."""
        pairs = linking.checkpoint(pairs.select(a, b))
        sets, firsts = fetch(pairs.select(F.explode(F.array(a, b)).alias("node")).distinct()), pairs.select(a).distinct()
        if pairs.count() <= MAX_BROADCAST_ROWS:
            pairs, firsts = F.broadcast(pairs), F.broadcast(firsts)
        y = sets.select(F.col("node").alias(b), F.col("shingles").alias("y")).join(pairs, b)
        x = sets.select(F.col("node").alias(a), F.col("shingles").alias("x")).join(firsts, a, "left_semi")
        return y.join(x, a).select(a, b, "x", "y")

    def verify(pairs: DataFrame) -> DataFrame:
        return beside(pairs, "a", "b").mapInArrow(_Confirm(percent), "a long, b long")

    def compare(pairs: DataFrame) -> DataFrame:
        return beside(pairs.select("leader", "node"), "leader", "node").mapInArrow(_Compare(percent), _Compare.SCHEMA)

    # a shared one at a place leaves no more than the rest of either to share; two far sets meet where both lead
    able = f"(case when x.far then not y.far or (x.lead and y.lead) else y.far end) and not arrays_overlap(x.prior, y.prior) and 100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size) and 2 * {100 + percent} * least(x.rest, y.rest) >= x.excess + y.excess"
    alike = f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)"
    roots = linking.classes(buckets, compare, _narrow, verify, able, central=True, alike=alike)
    named = nodes.select("node", "digest", "first_id")
    named = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("digest", "component_id")
    out = signed.select("doc_id", "version", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "version", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 6) -> DataFrame:
    """The rows of ``docs``, with their own columns, without documents that are not kept.

    Rows of one doc_id with different texts are judged each by its own text; of a group whose rows all have a
    null doc_id, all stay.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    texts = own.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("version"))
    gone = linking.checkpoint(_judged(docs, k, percent, bands, rows).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct())
    if gone.count() <= MAX_BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
