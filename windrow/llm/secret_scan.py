"""Secrets in text: three fixed kinds, and tokens that look like random data.

Every step is a column expression; texts are not shuffled.

*Fixed kinds* are found with regular expressions. Positions come from the pieces between the hits: a hit starts
after all pieces and hits before it.

*Random tokens* are runs of ``least`` or more characters of the base64 alphabets, and the parts of such runs between ``/``, ``-`` and
``_`` that are as long; a part inside a run that is reported is not reported again. Shorter tokens, such as the parts of a
UUID, are not judged: that is the limit of the tests. The encoding of a token is
inferred from its characters (the smallest alphabet that has them all). A battery of three tests asks whether its
symbols are independent and uniform: chi-squared over the alphabet, runs above and below the alphabet's middle,
and serial correlation. A token that none of them rejects at ``reject`` is a candidate, but a
short text passes too; so the battery's chi-squared is also judged under the opposite hypothesis,
text of a natural unevenness, where it grows with the length. That p-value is small only for tokens long enough to tell
the two apart, and the false-discovery rate over all tokens of the table is held at ``rate``
(Benjamini-Hochberg). Its cut is found on a histogram of p-values with a fixed number of cells, which is
all that reaches the driver; the cut is at a cell's edge, on the safe side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.llm.store import saved

# The kinds in their order, their patterns and shortest lengths.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters with the prefix
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

# Encodings by the characters they allow: pattern, alphabet, and how uneven natural text is in it
# (symbols times the chance that two are equal, minus one).
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("^[0-9]+$", DIGITS, 0.7),
    ("^[0-9a-f]+$", DIGITS + "abcdef", 2.2),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF", 2.2),
    ("^[a-z]+$", LOWER, 0.73),
    ("^[A-Z]+$", UPPER, 0.73),
    ("^[A-Z2-7]+$", UPPER + "234567", 1.1),
    ("^[a-z0-9]+$", LOWER + DIGITS, 1.4),
    ("^[A-Z0-9]+$", UPPER + DIGITS, 1.4),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 3.1),
    ("", UPPER + LOWER + DIGITS + "+/", 3.27),
]
SPAN = "struct<start:bigint,kind:int,end:bigint>"
CELLS, CELL = 400, 0.05  # of -log10 p


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, value_least: int = 1, least: str = "") -> Column:
    """Spans of leftmost non-overlapping hits of ``pattern`` in characters, those whose group is long enough.

    ``least`` is a pattern that every text with a hit has (by default the pattern), tried first.
    """
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = hits if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(hits.alias("hit"), F.slice(pieces, 1, F.size(hits)).alias("before"), values.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(state: Column, row: Column) -> Column:
        begin = state["at"] + F.length(row["before"])
        end = begin + F.length(row["hit"])
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end"))
        out = F.when(F.length(row["value"]) >= value_least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.cast("bigint").alias("at"), out.alias("out"))

    found = F.aggregate(rows, start, add, lambda s: s["out"])
    return F.when(text.rlike(least or pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def normal_below(z: Column) -> Column:
    """Probability below ``z`` of a standard normal (rational approximation, error below 1e-7)."""
    x = F.least(F.abs(z), F.lit(12.0))
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """Struct of the three p-values for uniform independent symbols, and ``natural``, the one for natural text."""
    def pick(values: list, token: Column) -> Column:
        out = F.lit(values[-1])
        for (pattern, _, _), value in reversed(list(zip(ENCODINGS[:-1], values[:-1]))):
            out = F.when(token.rlike(pattern), F.lit(value)).otherwise(out)
        return out

    bare = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    alphabet = pick([a for _, a, _ in ENCODINGS], bare)
    uneven = pick([u for _, _, u in ENCODINGS], bare)
    # lambdas give names to intermediate results, so each is computed once
    first = F.transform(F.array(F.struct(bare.alias("s"), alphabet.alias("a"), uneven.alias("u"))), _measured)
    return F.transform(first, _judged)[0]


def _measured(x: Column) -> Column:
    s, a = x["s"], x["a"]
    count = lambda c: F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0))
    squares = F.aggregate(F.split(a, ""), F.lit(0.0), lambda acc, c: acc + count(c))
    places = F.transform(F.split(s, ""), lambda c: F.instr(a, c).cast("double") - 1)
    return F.struct(F.length(s).cast("double").alias("n"), F.length(a).cast("double").alias("k"), x["u"].alias("u"), squares.alias("squares"), places.alias("v"))


def _judged(x: Column) -> Column:
    n, k, v = x["n"], x["k"], x["v"]
    middle = (k - 1) / 2
    size = F.size(v)
    pairs = F.arrays_zip(F.slice(v, 1, size - 1).alias("p"), F.slice(v, 2, size - 1).alias("q"))
    changes = F.aggregate(pairs, F.lit(0.0), lambda acc, y: acc + ((y["p"] > middle) != (y["q"] > middle)).cast("double"))
    products = F.aggregate(pairs, F.lit(0.0), lambda acc, y: acc + (y["p"] - middle) * (y["q"] - middle))
    chi = k / n * x["squares"] - n
    two_sided = lambda z: 2 * normal_below(-F.abs(z))
    even = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
    runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = products / ((k * k - 1) / 12) / F.sqrt(n - 1)
    natural = (chi - (k - 1) - n * x["u"]) / F.sqrt(2 * (k - 1) + 4 * n * x["u"])
    return F.struct(normal_below(-even).alias("even"), two_sided(runs).alias("runs"), two_sided(serial).alias("serial"), normal_below(natural).alias("natural"))


def cut_of(tokens: DataFrame, rate: float) -> float:
    """Largest p-value that Benjamini-Hochberg lets pass, rounded down to a cell's edge; 0 if none does."""
    cell = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) / CELL), F.lit(CELLS)).cast("int")
    counts = dict(tokens.groupBy(cell.alias("cell")).count().collect())  # CELLS + 1 rows at most
    every, met, cut = sum(counts.values()), 0, 0.0
    for c in range(CELLS, -1, -1):
        met += counts.get(c, 0)
        edge = 10.0 ** (-c * CELL)  # the largest p-value of this cell and those above
        if met and edge <= rate * met / every:
            cut = edge
    return cut


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def scan(docs: DataFrame, least: int = 20, reject: float = 0.001, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``base`` and ``random``, arrays of spans (start, kind, end) in code points, end exclusive.

    A random token that overlaps a base span is left out.

    Cases: a null or empty text has no spans; equal starts go by kind, in the order of ``KINDS``; repeated rows are
    scanned each, and their tokens count each; an empty table gives an empty result; other columns are ignored.
    """
    text = F.col("_text")
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    base = F.array_sort(F.concat(spans(text, ASSIGN, 0, 2, ASSIGN_LEAST), spans(text, ACCESS, 1), spans(text, HEX, 2)))
    token = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % least
    part = r"[A-Za-z0-9+]{%d,}={0,2}" % least
    tokens = F.array_distinct(F.concat(spans(text, token, 3), spans(text, part, 3)))
    both = rows.select("doc_id", "_text", base.alias("base"), tokens.alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    judge = lambda t: F.struct(t.alias("span"), battery(F.substring(F.col("_text"), (t["start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int"))).alias("p"))
    judged = saved(both.select("doc_id", "base", F.transform(free, judge).alias("judged")), "spans")

    passes = lambda j: (j["p"]["even"] >= reject) & (j["p"]["runs"] >= reject) & (j["p"]["serial"] >= reject)
    cut = cut_of(judged.select(F.explode("judged").alias("j")).select(F.col("j.p.natural").alias("p")), rate)
    hits = F.transform(F.filter("judged", lambda j: passes(j) & (j["p"]["natural"] <= cut)), lambda j: j["span"])
    found = judged.select("doc_id", "base", hits.alias("hits"))
    inside = lambda t: F.exists("hits", lambda o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o != t))
    return found.select("doc_id", "base", F.array_sort(F.filter("hits", lambda t: ~inside(t))).alias("random"))
