"""Links and classes from buckets of candidates, without all pairs of a bucket.

In every bucket one node, the leader, is compared with all others. Where a bucket then still holds nodes of
different classes, its nodes meet again in narrower buckets: the operator says in which, such that every link
that the leader does not settle has its two nodes together in one of them. Pairs are tried only in narrower
buckets of few nodes; the others are treated as the first were, until no bucket holds two classes.

Joins and filters over hot keys are plain equi-joins of Spark, which splits skewed partitions; what a key sums
up to is aggregated before the shuffle. Intermediate tables are checkpointed to the folder that the cluster
shares, so a lost executor costs a re-read and never the work before it.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a bucket of up to this many nodes are tried at once: of narrower ones and, where an operator says which of
#: their pairs may be links, of what first ones hold besides their leader. In every further round it is of up to GROWTH times
#: as many, since what is left then is little and rounds cost more than pairs.
FEW, GROWTH = 64, 4


def shared_folder(spark) -> str:
    """The folder of checkpoints; where none is named, a new local one, which only a local master can use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Rows of an intermediate table to a partition: what has come to be little is not dealt out to many tasks again.
PARTITION_ROWS = 10_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the rows decide in how many parts it is read."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    parts = -(-out.count() // PARTITION_ROWS)
    return out.coalesce(max(1, parts)) if parts < out._jdf.rdd().getNumPartitions() else out


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: for wide rows of which steps read a few columns each."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing will read any more."""
    jvm, folders = df.sparkSession._jvm, {name.rpartition("/")[0] for name in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark) -> None:
    """Have Spark delete the shuffle files of what nothing refers to any more, before much is shuffled again."""
    for _ in range(2):  # what the first round lets go of in Python, the second finds in the JVM
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _star(edges: DataFrame, large: bool, alone: bool) -> DataFrame:
    """One step of the alternating star contraction; edges are (u, v) with u > v, and stay ``alone`` in one part if they are."""
    if large:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = near.unionByName(least.select("u", F.col("m").alias("v")))
        out = out.coalesce(1) if alone else out
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node with a link: root is the smallest node that it reaches.

    ``links`` has columns a and b of one orderable type. Nodes and links stay distributed; the driver
    sees a count and a checksum of each round.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == seen:
            break
        seen = tuple(now)
        alone = edges._jdf.rdd().getNumPartitions() == 1
        edges = checkpoint(_star(_star(edges, True, alone), False, alone))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df.withColumn("root", F.col("node"))
    return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _merge(roots: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """The classes after some more links; only links between classes are contracted."""
    if roots is None:
        return None if found.isEmpty() else checkpoint(components(found))
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    across = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    across = checkpoint(across.distinct())
    if across.isEmpty():
        return roots
    joined = checkpoint(components(across))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = joined.join(roots.select("node"), "node", "left_anti")
    return checkpoint(moved.unionByName(new))


def classes(buckets: DataFrame, compare: Callable[[DataFrame], DataFrame], narrow: Callable[[DataFrame, int], DataFrame], verify: Callable[[DataFrame], DataFrame], able: str, central: bool = False, levels: int | None = None, alike: str | None = None) -> DataFrame | None:
    """(node, root) of all nodes that have a link to another; None if no node has.

    ``buckets`` has key, node, size, lead (rows that may lead; two rows that may not are no candidates).
    ``compare`` takes (leader, node, leader_size, size) and returns leader, node, linked and what ``narrow``
    needs of them; pairs that it leaves out are no links. ``narrow`` takes (path, leader, node, size, what
    ``compare`` gave) of the buckets still mixed and gives narrower ones: key, path, node, size, lead and what
    ``able`` asks. ``able`` is SQL over two rows x and y of a narrower bucket that a link of theirs satisfies,
    and ``verify`` returns those of pairs (a, b) that are links. With ``central``, the node with the most
    company leads: copies of one text share more buckets with it than with each other. ``alike`` is SQL over two
    rows of a bucket (node, size) that a link satisfies; with it, small first buckets are never narrowed.

    A path is the leaders that a bucket's nodes were compared with, none of which is among them, so buckets
    of one path shrink with every round and the rounds end. An operator that cannot narrow buckets more than
    ``levels`` times has all pairs across the classes of the last ones tried that ``able`` allows.
    """
    roots: DataFrame | None = None
    buckets = buckets.withColumn("path", F.lit(0).cast("long"))
    level = 0
    while True:
        rooted = _rooted(buckets, roots)
        mixed = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("p"), F.max("root").alias("q"), F.max("lead").alias("any")).where("p <> q and any").select("key", "n")
        members = checkpoint(rooted.join(mixed, "key"))
        if level:
            last, limit = level == levels, FEW * GROWTH ** (level - 1)
            few = members if last else members.where(F.col("n") <= limit)
            x, y = few.alias("x"), few.alias("y")
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.lead") | F.col("y.lead")) & F.expr(able))
            pairs = checkpoint(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
            if not pairs.isEmpty():
                roots = _merge(roots, checkpoint(verify(pairs)))
            members = members.where(F.col("n") > limit)
            if last or members.isEmpty():
                return roots
        rank = F.struct("lead", F.col("node"), F.col("size"))
        if central:
            weights = members.groupBy("node").agg(F.sum("n").alias("w"))
            members = members.join(weights, "node")
            rank = F.struct("lead", "w", F.col("node"), F.col("size"))
        leaders = members.groupBy("key").agg(F.max(rank).alias("l")).select("key", F.col("l.node").alias("leader"), F.col("l.size").alias("leader_size"))
        led = members.select("key", "path", "node", "size", "lead").join(leaders, "key").where("node <> leader")
        led = checkpoint(led)
        compared = checkpoint(compare(led.select("leader", "node", "leader_size", "size").distinct()))
        roots = _merge(roots, compared.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        left = _rooted(led, roots)
        mixed = left.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("p"), F.max("root").alias("q"), F.max("lead").alias("any")).where("p <> q and any").select("key", "n")
        again = left.join(mixed, "key")
        if alike and not level:
            again = checkpoint(again)
            few = again.where(F.col("n") <= FEW).select("key", "node", "size", "root", "lead")
            x, y = few.alias("x"), few.alias("y")
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.lead") | F.col("y.lead")) & F.expr(alike))
            pairs = checkpoint(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
            if not pairs.isEmpty():
                roots = _merge(roots, checkpoint(verify(pairs)))
            again = again.where(F.col("n") > FEW)
        again = again.select("path", "leader", "node", "size").distinct()
        level += 1
        buckets = checkpoint(narrow(again.join(compared, ["leader", "node"], "left"), level))
        if buckets.isEmpty():
            return roots
        del rooted, mixed, members, leaders, led, compared, left, again
        release(buckets.sparkSession)
