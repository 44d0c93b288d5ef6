"""Secret scans: a battery of randomness tests.

Fixed patterns find assignments, access keys and long hex runs. All other long
tokens go through tests in the encoding that their characters imply. The
battery asks whether a token can be random: chi-squared uniformity over the
alphabet, runs above and below its middle, lag-one serial correlation and the
share above the middle, joined by Bonferroni's rule. Whether it can also be
ordinary text is a test against the corpus's own letters, counted over all
texts in each alphabet: the log-likelihood ratio of uniform to ordinary letters,
standardised by its mean and variance under ordinary text, which knows the
token's length. Short tokens and words fit both; in each family of encoding and
length, the Benjamini-Hochberg procedure over all tokens decides which are no
ordinary text, at a false-discovery rate of ``RATE``. A token so discovered that
the battery does not reject is reported.

The procedure runs on a histogram of p-values, whose size is fixed, so it needs
no ranking of all tokens, and it counts every token of the corpus.

Everything is DataFrame functions. Nulls: a null text is empty. Repeated
doc_ids: each row is answered for its own text. Empty tables give no rows; extra
columns are ignored. Texts and tokens are tested whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm import linking, spans

KINDS = ["assign", "access", "hex"]
_VALUE = r"[A-Za-z0-9+/_.=-]"
PATTERNS = {
    "assign": (rf"(?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?{_VALUE}++", None),
    "access": (r"AKIA[A-Z0-9]++", "AKIA"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", None),
    "token": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", None),
}
#: Alphabets of the encodings, in order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Share of ordinary tokens, in error, among those called not ordinary, and level of the battery; bins of -log10 p in the histogram.
RATE, BINS, BIN_WIDTH = 0.05, 640, 0.025


def _kept(kind: str) -> Callable[[Column], Column]:
    return lambda s: _keep(kind, s["match"])


def _keep(kind: str, m: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(m, rf"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?({_VALUE}+)$", 1)) >= 8
    return F.length(m) >= (16 if kind == "access" else 32)


def encoding(token: Column) -> Column:
    bare = F.rtrim(token, F.lit("="))
    return F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def _tail(z: Column) -> Column:
    """One-sided normal tail probability by the logistic approximation."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def letter_counts(rows: DataFrame, tokens: DataFrame) -> dict[str, int]:
    """How often each letter of the alphabets stands in the corpus outside the tokens: one row, whatever its size."""
    letters = sorted(set("".join(ALPHABETS.values())))
    counts = [F.sum((F.length("text") - F.length(F.replace("text", F.lit(c)))).cast("long")).alias(f"c{i}") for i, c in enumerate(letters)]
    whole, inside = rows.agg(*counts).first(), tokens.agg(*counts).first()
    return {c: (whole[i] or 0) - (inside[i] or 0) for i, c in enumerate(letters)}


def weights(counts: dict[str, int]) -> dict[str, tuple[dict[str, float], float, float]]:
    """For each encoding: the log-likelihood ratio of each letter, uniform to ordinary, and its mean and deviation in ordinary text."""
    out = {}
    for kind, letters in ALPHABETS.items():
        total = sum(counts[c] + 1 for c in letters)
        share = {c: (counts[c] + 1) / total for c in letters}
        ratio = {c: -math.log(p * len(letters)) for c, p in share.items()}
        mean = sum(p * ratio[c] for c, p in share.items())
        out[kind] = ratio, mean, max(1e-9, sum(p * (ratio[c] - mean) ** 2 for c, p in share.items())) ** 0.5
    return out


def battery(token: Column, ordinary: dict[str, tuple[dict[str, float], float, float]]) -> Column:
    """struct(encoding, length, p, ordinary): p-values that the token is random, by all tests jointly, and that it is ordinary text."""
    kind = encoding(token)
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    bare = F.when(kind == "hex", F.lower(bare)).otherwise(bare)
    letters = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))
    codes = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.instr(F.element_at(letters, kind), c).cast("double"))

    def tests(x: Column) -> Column:
        v, k, n = x["v"], x["k"], F.greatest(F.size(x["v"]), F.lit(2)).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(v, lambda d: d == c)).cast("double"), F.lit(2.0)))
        z_chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        high = F.transform(v, lambda c: (c > k / 2).cast("double"))
        n1 = F.aggregate(high, F.lit(0.0), lambda a, c: a + c)
        changes = F.aggregate(F.zip_with(F.slice(high, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(high, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, c: a + c)
        z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_half = (n1 - n / 2) / F.sqrt(n / 4)
        middle, spread = (k + 1) / 2, (k * k - 1) / 12
        serial = F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda a, c: a + c)
        z_serial = serial / spread / F.sqrt(n - 1)
        p = F.least(_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)), 2 * _tail(F.abs(z_half)))
        each = F.transform(v, lambda c: F.element_at(F.element_at(ratios, x["kind"]), c.cast("int")))
        z_text = (F.aggregate(each, F.lit(0.0), lambda a, c: a + c) - n * F.element_at(means, x["kind"])) / (F.sqrt(n) * F.element_at(spreads, x["kind"]))
        return F.struct(x["kind"].alias("encoding"), F.size(v).alias("length"), F.least(4 * p, F.lit(1.0)).alias("p"), _tail(z_text).alias("ordinary"))

    ratios = F.create_map(*(y for k, (ratio, _, _) in ordinary.items() for y in (F.lit(k), F.array(*(F.lit(ratio[c]) for c in ALPHABETS[k])))))
    means = F.create_map(*(F.lit(y) for k, (_, mean, _) in ordinary.items() for y in (k, mean)))
    spreads = F.create_map(*(F.lit(y) for k, (_, _, spread) in ordinary.items() for y in (k, spread)))

    sizes = F.create_map(*(y for k, a in ALPHABETS.items() for y in (F.lit(k), F.lit(float(len(a))))))
    return F.element_at(F.transform(F.array(F.struct(codes.alias("v"), F.element_at(sizes, kind).alias("k"), kind.alias("kind"))), tests), 1)


def _family() -> list[Column]:
    return [F.col("encoding"), F.floor(F.log2(F.greatest("length", F.lit(1)))).cast("int").alias("octave")]


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / BIN_WIDTH), F.lit(BINS - 1)).cast("int")


def discoveries(tests: DataFrame) -> DataFrame:
    """(encoding, octave, least_bin): in each family, tokens in this bin of -log10 p or beyond are no ordinary text.

    Benjamini-Hochberg with the p-value of a bin taken as its largest, which only makes it stricter.
    """
    counts = tests.select(*_family(), _bin(F.col("ordinary")).alias("bin")).groupBy("encoding", "octave", "bin").count()
    family = counts.groupBy("encoding", "octave").agg(F.sum("count").alias("m"), F.collect_list(F.struct("bin", "count")).alias("bins"))
    beyond = lambda b: F.aggregate(F.filter("bins", lambda x: x["bin"] >= b), F.lit(0).cast("long"), lambda a, x: a + x["count"])
    passed = F.filter(F.transform("bins", lambda x: x["bin"]), lambda b: F.pow(F.lit(10.0), -b * BIN_WIDTH) * F.col("m") <= RATE * beyond(b))
    return family.select("encoding", "octave", F.array_min(passed).alias("least_bin")).where("least_bin is not null")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, an array of spans for each kind, and ``more``, tokens that are no ordinary text and can be random."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = spans.find(rows, "text", PATTERNS)
    found = found.withColumns({k: F.filter(k, _kept(k)) for k in KINDS})
    found = found.withColumn("token", F.when(F.size("token") > 0, spans.clear_of(F.col("token"), *(F.col(k) for k in KINDS))).otherwise(F.col("token")))
    plain = {k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS}
    found = linking.checkpoint(found.select("doc_id", *plain.values(), "token"))
    ordinary = weights(letter_counts(rows, found.select(F.explode("token.match").alias("text"))))
    tested = F.transform("token", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["match"], ordinary).alias("t")))
    found = linking.checkpoint(found.select("doc_id", *KINDS, tested.alias("tested")))
    tests = found.select(F.explode("tested").alias("x")).select("x.t.*")
    limits = discoveries(tests).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "encoding", "octave"), "least_bin"))).alias("limits"))
    octave = lambda t: F.concat_ws(":", t["encoding"], F.floor(F.log2(F.greatest(t["length"], F.lit(1)))).cast("int").cast("string"))
    passes = F.filter("tested", lambda s: (s["t"]["length"] >= 2) & (_bin(s["t"]["ordinary"]) >= F.coalesce(F.try_element_at(F.col("limits"), octave(s["t"])), F.lit(BINS))) & (s["t"]["p"] > RATE))
    more = F.transform(passes, lambda s: F.struct(F.lit("token").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["t"]["encoding"].alias("encoding"), s["t"]["p"].alias("p")))
    # one row of at most three encodings times 31 octaves
    return found.crossJoin(F.broadcast(limits)).select("doc_id", *KINDS, more.alias("more"))


def digest(found: DataFrame) -> DataFrame:
    base = {k: F.col(k) for k in KINDS}
    more = F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(spans.spelled(base, KINDS), 256).alias("base_sha256"), spans.spelled(base | {"token": more}, [*KINDS, "token"]).alias("spans"))
