"""Quality rules: learned decision lists.

``document_statistics`` measures every whole text. ``learn_decision_list`` fits
an ordered list of threshold conjunctions by sequential covering: it grows a
conjunction on one part of the labelled statistics by information gain, prunes
it on another, keeps it while it is precise there, removes what it covers and
goes on. ``DecisionList.column`` emits the list as one ordered Spark
conditional expression, so scoring the corpus needs no Python and no join.

Nulls: a null text is empty; a null or unknown label is left out of learning.
Empty tables: no labels give an empty list, which keeps whatever the base
rules keep. Repeated doc_ids: each row is measured and judged by itself, and a
doc_id labelled twice counts twice. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from streamloom.llm.text import mix, slices

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Fitting takes at most this many labelled documents, those with the smallest hash of doc_id.
MAX_LABELLED = 12_000
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_punct"]
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS)

_TABLES = {
    "n_symbols": np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8)),
    "n_digits": np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1)),
    "n_upper": np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1)),
    "n_punct": np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8)),
}
_CHAR = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column("text")):
            n = len(s)

            def per_doc(flags: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(flags)])[s.offsets])

            _, _, doc, words = s.words()
            out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_doc(_CHAR[s.data] & ~_SPACE[s.data])}
            out |= {name: per_doc(table[s.data]) for name, table in _TABLES.items()}
            salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))[doc]
            _, first = np.unique(words ^ salt, return_index=True)
            out["n_distinct_words"] = np.bincount(doc[first], minlength=n)
            covered = np.zeros(len(words), dtype=bool)
            if len(words) > 2:
                w = mix(mix(words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:]) ^ salt[:-2]
                inside = np.flatnonzero(doc[:-2] == doc[2:])
                order = inside[np.argsort(w[inside], kind="stable")]
                same = w[order][1:] == w[order][:-1]
                twice = np.zeros(len(order), dtype=bool)
                twice[1:] |= same
                twice[:-1] |= same
                for k in range(3):
                    covered[order[twice] + k] = True
            out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
            dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                full = [x for x in s.text(i).split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
                lines[i], dup[i] = len(full), len(full) - len(set(full))
            out |= {"n_dup_lines": dup, "n_lines": lines}
            ids = batch.column("doc_id").slice(s.first, n).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[c].astype(np.int64)) for c in STATISTICS)], ["doc_id", *STATISTICS])


def document_statistics(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and the counts of STATISTICS over the whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What the list's thresholds are on; ratios of the counts, 0 where the text has no word."""
    per = lambda c, d: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(d)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct_words", "n_words"),
        "digits": per("n_digits", "word_chars"),
        "upper": per("n_upper", "word_chars"),
        "punct": per("n_punct", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass
class Rule:
    """All of (feature, is_upper_bound, threshold) hold."""

    terms: list[tuple[str, bool, float]] = field(default_factory=list)
    precision: float = 0.0
    covered: int = 0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return reduce(and_, [(x[f] <= t) if below else (x[f] > t) for f, below, t in self.terms], np.ones(n, dtype=bool))

    def column(self) -> Column:
        own = features()
        return reduce(and_, [(own[f] <= t) if below else (own[f] > t) for f, below, t in self.terms])

    def __str__(self) -> str:
        return " and ".join(f"{f} {'<=' if below else '>'} {t:.6g}" for f, below, t in self.terms)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """The number of the first rule that holds, from 0; null if none does."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules))):
            out = F.when(rule.column(), F.lit(i)).otherwise(out)
        return out

    def rejects(self) -> Column:
        return self.column().isNotNull()


def _best_term(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int = 64) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold of the largest FOIL gain among quantile cuts of the covered rows."""
    p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
    best: tuple[float, tuple[str, bool, float] | None] = (1e-9, None)
    if not p0 or not n0:
        return best
    base = np.log2(p0 / (p0 + n0))
    for name, values in x.items():
        v = values[rows]
        cuts = np.unique(np.quantile(v, np.linspace(0, 1, most)))
        cuts = (cuts[1:] + cuts[:-1]) / 2
        order = np.argsort(v)
        below = np.searchsorted(v[order], cuts, side="right")
        hits = np.concatenate([[0], np.cumsum(bad[rows][order])])
        for side in (True, False):
            p = hits[below] if side else p0 - hits[below]
            n = below - hits[below] if side else (len(v) - below) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (name, side, float(cuts[int(gain.argmax())])))
    return best


def learn_decision_list(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, *, min_precision: float = 0.97, min_covered: int = 12, max_terms: int = 3, max_rules: int = 24) -> DecisionList:
    """Sequential covering. ``part`` is True for the rows that rules grow on; the others prune and test them.

    A rule stays if it covers ``min_covered`` bad rows of the pruning part at ``min_precision``
    or more there; the first that does not ends the list.
    """
    out, left = DecisionList(), np.ones(len(bad), dtype=bool)
    while len(out.rules) < max_rules:
        rule, rows = Rule(), np.flatnonzero(left & part)
        while len(rule.terms) < max_terms:
            _, term = _best_term(x, bad, rows)
            if term is None:
                break
            rule.terms.append(term)
            rows = np.flatnonzero(left & part & rule.holds(x))
        test = left & ~part

        def worth(r: Rule) -> float:
            hit = r.holds(x) & test
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule.terms) > 1:
            shorter = max((Rule(rule.terms[:i] + rule.terms[i + 1 :]) for i in range(len(rule.terms))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        if not rule.terms:
            break
        hit = rule.holds(x) & test
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < min_covered or p / (p + n) < min_precision:
            break
        rule.precision, rule.covered = p / (p + n), p
        out.rules.append(rule)
        left &= ~rule.holds(x)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Fit on at most ``max_labelled`` labelled documents; they, not the corpus, come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left_semi")
    stats = document_statistics(chosen).join(F.broadcast(sample), "doc_id")
    own = features()
    rows = stats.where(~base_failed()).select("doc_id", "quality", *(c.alias(f) for f, c in own.items())).toPandas()
    rows = rows.sort_values(["doc_id", "quality", *own], kind="stable")
    if rows.empty:
        return DecisionList()
    h = mix(rows["doc_id"].to_numpy().astype(np.int64).view(np.uint64) + np.uint64(7))
    return learn_decision_list({f: rows[f].to_numpy() for f in own}, rows["quality"].to_numpy() == 0, h % np.uint64(3) != 0)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (which rule of the list rejects, if any) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.column()}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Rows are judged where they stand: the text goes through Python beside the row, so no join is needed
    and repeated doc_ids do no harm.
    """
    rules, names = fit(docs, labels), docs.columns
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in names):
        prefix = "_" + prefix
    schema = StructType([*docs.schema.fields, *(StructField(prefix + c, LongType()) for c in STATISTICS)])
    wide = docs.mapInArrow(_Beside(names, prefix), schema)
    stats = {c: prefix + c for c in STATISTICS}
    kept = judge(wide.select(*(F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(names)), *(F.col(v).alias(k) for k, v in stats.items())), rules).where("kept")
    return kept.select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(names)))


class _Beside:
    """Passes whole rows on, with the statistics of their text beside them."""

    def __init__(self, names: list[str], prefix: str):
        self.at, self.prefix = {c.lower(): i for i, c in enumerate(names)}, prefix

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(self.at["text"])
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["doc_id", "text"])
            start = 0
            for got in _measure(iter([pair])):
                part = batch.slice(start, got.num_rows)
                start += got.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, *got.columns[1:]], [*part.schema.names, *(self.prefix + c for c in STATISTICS)])
