"""PII: bootstrapped contextual extraction.

Seeds are the spans that fixed patterns find: emails, IP addresses, card and
phone numbers. The words before a seed are a lexical pattern for its kind; all
other tokens with a digit are instances too. Patterns and instances are a
bipartite graph, scored in rounds: a pattern's confidence is the sum of the
scores of its known instances over all its distinct instances, so what else
stands behind it counts against it; an instance's score is the noisy-or of the
confidences of its trusted patterns. Instances of enough score are known from
the next round on: they are seeds of new patterns, which discover others in
turn, until a round finds nothing new.

Everything is DataFrame functions; texts are read once, and from then on only
spans and contexts are moved. Counts per pattern and instance are aggregated
before they are shuffled, so a pattern with a third of all instances is summed
by every task.

Nulls: a null text is empty and has no spans. Repeated doc_ids: each row is
answered for its own text. Empty tables give no rows; extra columns are
ignored. Texts are searched whole; a span never passes the end of its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm import linking, spans

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "token": (r"(?<![^\x20\x09-\x0D\"'\[(<])(?=[^\x20\x09-\x0D0-9]*+[0-9])[A-Za-z0-9@._%+:/-]{6,}+(?![^\x20\x09-\x0D,;\"'\])>])", None),
}
#: A pattern must have this many distinct known instances, and this confidence, to be trusted; an instance this score to be known.
MIN_KNOWN, MIN_CONFIDENCE, MIN_SCORE = 3, 0.8, 0.8
#: Words of a pattern, and the characters before a span in which they are looked for; a word cut there is none.
WORDS, CONTEXT = 2, 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    parts = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(parts, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _kept(kind: str) -> Callable[[Column], Column]:
    return lambda s: _keep(kind, s["match"])


def _keep(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(m))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _contexts(found: Column, kind: Column | None) -> Column:
    """struct(kind, start, end, instance, pattern) of each span; the pattern is the last words before it, back to the match before it."""

    def words(s: Column) -> Column:
        parts = F.split(F.lower(F.rtrim(s["left"], F.lit("\"'([<"))), r"[\x20\x09-\x0D]+")
        # a word at the edge of the context may be cut
        return F.filter(parts, lambda w, i: (w != "") & ((i > 0) | (F.length(s["left"]) <= CONTEXT)))

    def one(s: Column) -> Column:
        pattern = spans.let(words(s), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - WORDS + 1, F.lit(1)), F.lit(WORDS)), " "))
        return F.struct((kind if kind is not None else F.lit(None).cast("string")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["match"]).alias("instance"), pattern.alias("pattern"))

    return F.transform(found, one)


def bootstrap(edges: DataFrame) -> DataFrame:
    """(pattern, kind, confidence, known) of the trusted patterns.

    ``edges`` has kind (null for instances that are no seeds), pattern and instance.
    """
    graph = linking.checkpoint(edges.where("pattern <> ''").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    sizes = linking.checkpoint(graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_KNOWN))
    graph = linking.checkpoint(graph.join(sizes.select("pattern"), "pattern"))
    known = linking.checkpoint(graph.where("kind is not null").select("kind", "instance", F.lit(1.0).alias("score")).distinct())
    count = known.count()
    while True:
        support = graph.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("known"))
        trusted = support.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / F.col("n")).alias("confidence"), "known")
        trusted = linking.checkpoint(trusted.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("known") >= MIN_KNOWN)))
        if trusted.isEmpty():
            return trusted
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        reached = graph.where("kind is null").select("pattern", "instance").join(trusted, "pattern").groupBy("kind", "instance").agg((1 - doubt).alias("score"))
        now = linking.checkpoint(known.where("score = 1.0").unionByName(reached.where(F.col("score") >= MIN_SCORE).withColumn("score", F.least("score", F.lit(1 - 1e-9)))))
        before, count = count, now.count()
        known = now
        if count <= before:
            return trusted


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, an array of spans for each kind, and ``more``, those that patterns discovered."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = spans.find(rows, "text", PATTERNS, CONTEXT)
    found = found.withColumns({k: F.filter(k, _kept(k)) for k in KINDS})
    found = found.withColumn("token", F.when(F.size("token") > 0, spans.clear_of(F.col("token"), *(F.col(k) for k in KINDS))).otherwise(F.col("token")))
    found = found.withColumn("seen", F.concat(*(_contexts(F.col(k), F.lit(k)) for k in KINDS), _contexts(F.col("token"), None)))
    plain = {k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS}
    found = linking.checkpoint(found.select(F.monotonically_increasing_id().alias("__row"), "doc_id", *plain.values(), "seen"))
    edges = found.where(F.size("seen") > 0).select("__row", F.explode("seen").alias("e")).select("__row", "e.*")
    good = bootstrap(edges.select("kind", "pattern", "instance"))
    best = good.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "known", "kind")).alias("named"))
    more = edges.where("kind is null").join(best, "pattern").groupBy("__row").agg(F.collect_set(F.struct(F.col("named").alias("kind"), "start", "end")).alias("more"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.drop("seen").join(more, "__row", "left").select("doc_id", *KINDS, F.coalesce("more", empty).alias("more"))


def _discovered(kind: str) -> Column:
    return F.transform(F.filter("more", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def digest(found: DataFrame) -> DataFrame:
    base = {k: F.col(k) for k in KINDS}
    both = {k: F.concat(F.col(k), _discovered(k)) for k in KINDS}
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(spans.spelled(base, KINDS), 256).alias("base_sha256"), spans.spelled(both, KINDS).alias("spans"))
