"""Suffix order by a distributed difference cover, and what it says of repeated strings.

The sampled suffixes are those at places 1 and 2 modulo 3. Their triples of symbols are sorted and named by
their rank; where two share a name, the names in order of place (first class 1, then class 2) are a string of
two thirds of the length, whose suffixes are ordered in the same way. A remaining suffix is its first symbol and
a sampled one, so it is merged in by its place among either class: one sort beside class 1 by (symbol, rank of
the next), one beside class 2 by (symbol, symbol, rank of the next but one). Suffixes that are neighbours in the
whole order are then compared by their first ``window`` bytes.

Every step is a sort by range, a join by key or a sum, and no task sees a whole order: a rank is the place in a
range plus the sizes of the ranges before. What it costs on large collections, and why the corpus query decides
the same question otherwise, is measured in the README.

Nulls: a null text is empty. Empty tables and texts have no suffixes. Repeated rows are texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm import linking


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order of the keys: counts of ranges, summed up, and places within a range."""
    parted = linking.checkpoint(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    placed = parted.withColumn("inside", inside).join(F.broadcast(before), "part")
    return placed.select(*rows.columns, (F.col("before") + F.col("inside")).alias(name))


def _following(symbols: DataFrame, count: int) -> DataFrame:
    """place, s0 .. s<count - 1>: the symbols from each place on, 0 beyond the end."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    spread = symbols.select("place", "symbol", copies.alias("k")).select((F.col("place") - F.col("k")).alias("place"), "k", "symbol").where("place >= 0")
    at = spread.groupBy("place").agg(*(F.max(F.when(F.col("k") == i, F.col("symbol"))).alias(f"s{i}") for i in range(count)))
    # a place without a symbol, between the classes of a shorter string, begins no suffix
    return at.where("s0 is not null").na.fill(0)


def _counted(samples: DataFrame, rest: DataFrame, keys: list[str]) -> DataFrame:
    """place, sampled, and how many rows of the other side stand before, in the order of keys that no two rows share."""
    both = samples.select("place", *keys, F.lit(1).alias("sampled")).unionByName(rest.select("place", *keys, F.lit(0).alias("sampled")))
    all_ = _ranked(both, keys, "at")
    mine = _ranked(all_.where("sampled = 1").select("place", "at"), ["at"], "own").select("place", F.lit(1).alias("sampled"), (F.col("at") - F.col("own")).alias("others"))
    other = _ranked(all_.where("sampled = 0").select("place", "at"), ["at"], "own").select("place", F.lit(0).alias("sampled"), (F.col("at") - F.col("own")).alias("others"))
    return mine.unionByName(other)


def suffix_ranks(symbols: DataFrame, length: int) -> DataFrame:
    """(place, rank) of the suffixes of a string of ``length`` positive symbols (place, symbol), ranks from 1."""
    symbols = linking.checkpoint(symbols)
    triples = linking.checkpoint(_following(symbols, 3))
    sampled = triples.where("place % 3 <> 0")
    size = sampled.count()
    if not size:
        return _ranked(symbols, ["symbol", "place"], "rank").select("place", (F.col("rank") + 1).alias("rank"))
    names = _ranked(sampled.select("s0", "s1", "s2").distinct(), ["s0", "s1", "s2"], "name")
    named = linking.checkpoint(sampled.join(names, ["s0", "s1", "s2"]).select("place", (F.col("name") + 1).alias("name")))
    if named.agg(F.max("name")).first()[0] < size:
        # one place more than class 1 has, which no symbol takes, ends it
        ones = (length + 1) // 3 + 1
        shorter = F.when(F.col("place") % 3 == 1, (F.col("place") - 1) / 3).otherwise((F.col("place") - 2) / 3 + ones).cast("long")
        deeper = suffix_ranks(named.select(shorter.alias("place"), F.col("name").alias("symbol")), ones + length // 3)
        place = F.when(F.col("place") < ones, F.col("place") * 3 + 1).otherwise((F.col("place") - ones) * 3 + 2)
        ranks = linking.checkpoint(deeper.select(place.alias("place"), "rank"))
    else:
        ranks = named.withColumnRenamed("name", "rank")
    behind: list[Column] = [F.col("place") - 1, F.col("place") - 2]
    after1, after2 = (ranks.select(b.alias("place"), F.col("rank").alias(f"r{i}")) for i, b in ((1, behind[0]), (2, behind[1])))
    keyed = triples.join(after1, "place", "left").join(after2, "place", "left").na.fill(0, ["r1", "r2"])
    keyed = linking.checkpoint(keyed.join(ranks, "place", "left"))
    rest, one, two = (keyed.where(F.col("place") % 3 == i) for i in range(3))
    beside1 = linking.checkpoint(_counted(one, rest, ["s0", "r1"]))
    beside2 = linking.checkpoint(_counted(two, rest, ["s0", "s1", "r2"]))
    own = _ranked(rest.select("place", "s0", "r1"), ["s0", "r1"], "own").select("place", "own")
    inserted = beside1.where("sampled = 0").select("place", F.col("others").alias("a")).join(beside2.where("sampled = 0").select("place", F.col("others").alias("b")), "place").join(own, "place")
    merged = inserted.select("place", (F.col("a") + F.col("b") + F.col("own") + 1).alias("rank"))
    shifted = beside1.unionByName(beside2).where("sampled = 1").join(ranks, "place").select("place", (F.col("others") + F.col("rank")).alias("rank"))
    return linking.checkpoint(merged.unionByName(shifted))


class _Symbols:
    """place and symbol of every byte, and of the end of each text, whose symbol is its own."""

    def __init__(self, texts: int):
        self.texts = texts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, begin, text in zip(*(batch.column(c).to_pylist() for c in ("number", "begin", "bytes"))):
                symbols = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + self.texts + 1, number + 1)
                yield pa.RecordBatch.from_arrays([pa.array(begin + np.arange(len(symbols))), pa.array(symbols)], ["place", "symbol"])


def repeated(texts: DataFrame, window: int) -> DataFrame:
    """(number, at) of the strings of ``window`` bytes that start elsewhere too; ``texts`` has number, from 0, and text."""
    rows = texts.select("number", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("bytes"))
    sizes = _ranked(rows, ["number"], "at").withColumn("n", F.length("bytes") + 1)
    parts = sizes.withColumn("part", F.floor(F.col("number") / 1000))
    totals = parts.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")
    placed = linking.checkpoint(parts.withColumn("inside", inside).join(F.broadcast(before), "part").select("number", "bytes", (F.col("before") + F.col("inside")).alias("begin")))
    count, length = placed.agg(F.count("*"), F.sum(F.length("bytes") + 1)).first()
    if not count:
        return texts.select(F.col("number").cast("long").alias("number"), F.lit(0).cast("long").alias("at")).limit(0)
    ranks = suffix_ranks(placed.mapInArrow(_Symbols(count), "place long, symbol long"), length)
    owners = placed.select("number", F.posexplode(F.sequence(F.lit(0), F.length("bytes"))).alias("at", "x"), (F.col("begin")).alias("begin")).select("number", "at", (F.col("begin") + F.col("at")).alias("place"))
    whole = owners.join(placed.select("number", F.length("bytes").alias("size")), "number").where(F.col("at") + window <= F.col("size"))
    suffixes = ranks.join(whole, "place").join(placed.select("number", "bytes"), "number").select("rank", "number", "at", F.sha2(F.substring("bytes", F.col("at") + 1, F.lit(window)), 256).alias("prefix"))
    suffixes = linking.checkpoint(suffixes)
    near = suffixes.select((F.col("rank") + 1).alias("rank"), F.col("prefix").alias("before"), F.col("number").alias("n2"), F.col("at").alias("a2"))
    pairs = linking.checkpoint(suffixes.join(near, "rank").where("prefix = before").select("number", "at", "n2", "a2"))
    return pairs.select("number", "at").unionByName(pairs.select(F.col("n2").alias("number"), F.col("a2").alias("at"))).distinct()
