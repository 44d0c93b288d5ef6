"""Finding spans with DataFrame functions alone.

Matches are cut out with ``regexp_extract_all`` and what stands between them
with ``split`` by the same pattern; running sums of their lengths give code
point offsets. Patterns are possessive where that changes no match, so that a
long run of digits or letters costs neither stack nor quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string,left:string>>"


#: Arrays are folded in pieces of this many items, since a fold copies what it has gathered at every step.
PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; what stands in a lambda is computed for each of its items."""
    return F.element_at(F.transform(F.array(F.struct(value.alias("value"))), lambda x: body(x["value"])), 1)


def _pieces(items: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the items in pieces."""
    def cut(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / PIECE).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * PIECE + 1, F.lit(PIECE)))

    return let(items, lambda v: let(cut(v), then))


def _positions(text: Column, pattern: str, matches: Column, context: int) -> Column:
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    previous = F.concat(F.array(F.lit("")), matches)
    left = (lambda g, p: F.right(F.concat(p, g), F.lit(context + 1))) if context else (lambda g, p: F.lit(""))
    gaps = F.zip_with(gaps, F.slice(previous, F.lit(1), F.size(matches)), lambda g, p: F.struct(F.length(g).alias("gap"), left(g, p).alias("left")))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g["gap"].alias("gap"), g["left"].alias("left"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), x["left"].alias("left"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def piece(p: Column, at: Column) -> Column:
        return F.aggregate(p, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def begins(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["m"])))
        return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    return _pieces(pairs, lambda pieces: F.flatten(F.zip_with(pieces, begins(pieces), piece)))


def find(rows: DataFrame, text: str, patterns: dict[str, tuple[str, str | None]], context: int = 0) -> DataFrame:
    """Adds for each name an array of struct(start, end, match, left), leftmost and non-overlapping.

    ``left`` is what stands between the match and the beginning of the one before it, its last ``context + 1``
    characters.

    ``patterns`` gives each name a pattern and, if there is one, a string without which a text has no match.
    """
    matched = rows.withColumns({
        f"__m_{name}": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if must is None else F.when(F.contains(F.col(text), F.lit(must)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        for name, (pattern, must) in patterns.items()
    })
    found = matched.withColumns({
        name: F.when(F.size(F.coalesce(f"__m_{name}", F.array().cast("array<string>"))) > 0, _positions(F.col(text), pattern, F.col(f"__m_{name}"), context)).otherwise(F.array().cast(SPAN))
        for name, (pattern, _) in patterns.items()
    })
    return found.drop(*(f"__m_{name}" for name in patterns))


def spelled(arrays: dict[str, Column], order: list[str]) -> Column:
    """kind:start:end of all spans, comma-joined, by start and then by the kind's place in ``order``."""
    def ranked(rank: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))

    all_ = F.concat(*(F.transform(a, ranked(order.index(kind))) for kind, a in arrays.items()))
    names = F.array(*(F.lit(k) for k in order))
    return F.array_join(F.transform(F.array_sort(all_), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def clear_of(spans: Column, *others: Column) -> Column:
    """The spans that overlap none of the others; these are sorted, and only pieces that reach a span are searched for it."""
    bare = [F.transform(o, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for o in others]
    reached = lambda o, s, low, high: (o[low] < s["end"]) & (s["start"] < o[high])

    def bounded(pieces: Column) -> Column:
        return F.transform(pieces, lambda p: F.struct(F.array_min(F.transform(p, lambda s: s["start"])).alias("low"), F.array_max(F.transform(p, lambda s: s["end"])).alias("high"), p.alias("p")))

    def clear(pieces: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(pieces, lambda p: F.coalesce(reached(p, s, "low", "high"), F.lit(False)) & F.exists(p["p"], lambda o: reached(o, s, "start", "end"))))

    return _pieces(F.array_sort(F.concat(*bare)), lambda pieces: let(bounded(pieces), clear))
