"""Secret scans: pattern matches, and a randomness test battery with false-discovery
control.

Patterns (``BASE``) are matched leftmost and non-overlapping over the whole text; spans
are code points, end exclusive. The battery adds spans of kind ``random``. Candidates
are maximal runs of at least ``MIN_RUN`` symbols of the base64 alphabets in what the base
spans leave of the text, so the rest of a run that a base span cuts is tested too. For each the
encoding is inferred (decimal, hex, base32, letters, base62, base64, base64url, ...),
which gives the alphabet size k and the order of symbols, and three tests are made:

* chi-squared uniformity of the symbol counts. The null hypothesis is a *structured*
  string with index of coincidence ``max(0.0655, 2/k)`` (that of English letters at
  least); chi-squared is then noncentral with noncentrality n*(k*ic - 1), and its normal
  approximation gives the p-value of being this uniform. It falls with the length n.
* runs above and below the middle of the alphabet (Wald-Wolfowitz), and
* the lag-1 serial correlation of the symbol numbers; both against randomness, at
  ``|z| <= Z_RANDOM``. A candidate that either rejects gets p = 1.

Discoveries are made by Benjamini-Hochberg at level ``q`` within each length class (powers
of two), over all documents. The runs of an encoding that ordinary text seldom keeps to
(``SELDOM``: hex, upper-case hex, base32) are classes of their own, so that paths, words and
lines of dashes do not dilute its keys; all others are controlled together. p-values are
counted in bins of a tenth of a decade (at most 401 a class), so only a small histogram is
gathered, never the candidates, and the bins' upper edges keep the control conservative.
Power depends on the alphabet: a short key of few symbols is hard to tell from structure.

The scan reads each text once and writes the spans and candidate bins of each document
as a table; the histogram and the result read that table.

Defined results: a null text is empty and has no span; repeated rows get the same result
each; an empty table gives no rows; ids may be null or repeat; other columns are ignored
by ``find_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlens.llm.common import let, table
from textlens.session import materialize

# The base patterns, in the order of the kinds.
ASSIGN = ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
          "([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{14,}"  # the run of AKIA[A-Z0-9]+ from its first AKIA, 18 characters or more
HEX = "[0-9a-f]{16,}"  # the maximal runs of [0-9a-f]+ of 16 characters or more
KINDS = ("assign", "access", "hex", "random")
MIN_SECRET = 12

MIN_RUN = 20
RUN = f"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
Q = 0.01
Z_RANDOM = 3.3
TOP_BIN = 400

_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: (pattern of the whole run, symbols in order); the first that fits is inferred.
ENCODINGS = (
    ("^[0-9]+$", _DIGITS),
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[a-z]+$", _LOW),
    ("^[A-Z2-7]+$", _UP + "234567"),
    ("^[A-Za-z]+$", _UP + _LOW),
    ("^[A-Za-z0-9]+$", _UP + _LOW + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", _UP + _LOW + _DIGITS + "-_"),
    ("", _UP + _LOW + _DIGITS + "+/-_"),
)
#: Numbers of the encodings with classes of their own.
SELDOM = (1, 2, 4)

_BLOCK = 256


def sums_before(a: Column) -> Column:
    """For each element of an integer array the sum of those before it; block by block,
    so that long arrays take far less than quadratic time."""
    def total(x):
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    def of(a):
        blocks = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))).otherwise(
            F.array().cast("array<int>"))
        each = F.transform(blocks, lambda b: total(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        starts = let(each, lambda e: F.transform(e, lambda _, i: total(F.slice(e, F.lit(1), i))))
        return let(starts, lambda st: F.transform(a, lambda _, i: F.get(st, F.floor(i / _BLOCK).cast("int")) + total(
            F.slice(a, (i - i % _BLOCK) + 1, i % _BLOCK))))

    return let(a, of)


def match_spans(text: Column, pattern: str, value: int = 0) -> Column:
    """array<struct<start, end, hit>> of all matches; ``hit`` is group ``value``. Texts
    without a match cost one search."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, p, F.lit(value))

    def spans(parts):
        offset = sums_before(F.transform(parts, lambda x: x["gap"] + x["size"]))
        return F.zip_with(F.arrays_zip(parts.alias("part"), offset.alias("at")), hits, lambda x, h: F.struct(
            (x["at"] + x["part"]["gap"]).cast("long").alias("start"),
            (x["at"] + x["part"]["gap"] + x["part"]["size"]).cast("long").alias("end"), h.alias("hit")))

    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes,
                       lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    kind = "array<struct<start:bigint,end:bigint,hit:string>>"
    return F.when(F.rlike(text, p), let(parts, spans)).otherwise(F.array()).cast(kind)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end>> of the base patterns; rank: the kind's number."""
    def of(rank, spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"),
                                                     s["end"].alias("end")))
    long_values = F.filter(match_spans(text, ASSIGN, 2), lambda s: F.length(s["hit"]) >= MIN_SECRET)
    return F.concat(of(0, long_values), of(1, match_spans(text, ACCESS)), of(2, match_spans(text, HEX)))


def _encoding(hit: Column) -> Column:
    """The number of the first encoding that fits the run."""
    number = F
    for i, (pattern, _) in enumerate(ENCODINGS[:-1]):
        number = number.when(F.rlike(hit, F.lit(pattern)), F.lit(i))
    return number.otherwise(F.lit(len(ENCODINGS) - 1))


def _tests(hit: Column, encoding: Column) -> Column:
    """The evidence against structure of one run in bins of a tenth of a decade (0: none)."""
    alphabet = F.get(F.array(*[F.lit(symbols) for _, symbols in ENCODINGS]), encoding)

    def zs(s):
        a, n = s["a"], F.length(s["h"]).cast("double")
        k = F.length(a).cast("double")
        symbols = F.split(s["h"], "")
        squares = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda t, c: t + F.pow(
            F.length(s["h"]) - F.length(F.replace(s["h"], c)), F.lit(2.0)))
        chi = k / n * squares - n
        shift = n * (k * F.greatest(F.lit(0.0655), F.lit(2.0) / k) - 1)
        z_chi = (k - 1 + shift - chi) / F.sqrt(2 * (k - 1 + 2 * shift))
        sides = F.transform(symbols, lambda c: F.when(F.instr(a, c) * 2 > F.length(a), "H").otherwise("L"))
        hl = F.array_join(sides, "")

        def runs(t):
            high = F.length(F.replace(t, F.lit("L"))).cast("double")
            turns = (2 * n - F.length(F.replace(t, F.lit("HL"))) - F.length(F.replace(t, F.lit("LH")))) / 2
            mean = 2 * high * (n - high) / n + 1
            return F.when(mean > 2, (turns + 1 - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))).otherwise(
                F.lit(99.0))

        numbers = F.transform(symbols, lambda c: F.instr(a, c).cast("double"))

        def serial(x):
            total = F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
            square = F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)
            lag = F.aggregate(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda u, v: u * v), F.lit(0.0),
                              lambda t, v: t + F.coalesce(v, F.lit(0.0)))
            mean = total / n
            spread = square - n * mean * mean
            return F.when(spread > 0, F.sqrt(n) * ((lag - (n - 1) * mean * mean) / spread + 1 / n)).otherwise(
                F.lit(99.0))

        return F.struct(z_chi.alias("chi"), let(hl, runs).alias("runs"), let(numbers, serial).alias("serial"))

    def bins(z):
        random = (F.abs(z["runs"]) <= Z_RANDOM) & (F.abs(z["serial"]) <= Z_RANDOM)
        decades = (z["chi"] * z["chi"] / 2 + F.log(z["chi"] * math.sqrt(2 * math.pi))) / math.log(10)
        return F.when(random & (z["chi"] > 2), F.least(F.floor(decades * 10), F.lit(TOP_BIN))).otherwise(0).cast("int")

    return let(let(F.struct(hit.alias("h"), alphabet.alias("a")), zs), bins)


def blanked(text: Column, base: Column) -> Column:
    """The text with spaces for the characters of its base spans, of the same length."""
    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        spaces = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).cast("int").alias("at"), F.concat(acc["parts"], F.array(before, spaces)).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(F.sort_array(base), start, step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, bin>> of the runs that the battery tests; ``kind`` numbers
    the class that its discoveries are controlled in."""
    def of(s, encoding):
        length = F.floor(F.log2(F.length(s["hit"]).cast("double"))).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.when(encoding.isin(*SELDOM), encoding + 1).otherwise(0) * 64 + length).alias("kind"),
                        _tests(s["hit"], encoding).alias("bin"))

    return F.transform(match_spans(text, RUN), lambda s: let(_encoding(s["hit"]), lambda e: of(s, e)))


def cut_bins(scanned: DataFrame, q: float = Q) -> DataFrame:
    """Benjamini-Hochberg by class: (kind, cut), the least bin discovered."""
    counts = (scanned.select(F.explode("_cand").alias("c")).groupBy("c.kind", "c.bin")
              .agg(F.count(F.lit(1)).alias("n")))
    by = Window.partitionBy("kind")
    found = F.sum("n").over(by.orderBy(F.desc("bin")))
    return (counts.withColumn("found", found).withColumn("tested", F.sum("n").over(by))
            .where((F.col("bin") > 0) & (F.col("tested") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("found")))
            .groupBy("kind").agg(F.min("bin").alias("cut")))


def _with_found(scanned: DataFrame, q: float) -> DataFrame:
    """Column ``_found``: all spans, sorted by start and kind."""
    cuts = cut_bins(scanned, q).agg(F.map_from_entries(F.collect_list(F.struct("kind", "cut")))).scalar()
    extra = F.transform(F.filter("_cand", lambda c: c["bin"] >= F.coalesce(
        F.element_at("_cuts", c["kind"]), F.lit(TOP_BIN + 1))), lambda c: F.struct(
            c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    return scanned.withColumn("_cuts", cuts).withColumn("_found", F.sort_array(F.concat("_base", extra)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row."""
    # the text itself is not written: the scan turns it into spans
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    t = materialize(_spans_only(rows))
    found = _with_found(t, q)

    def count(rank):
        return F.size(F.filter("_found", lambda s: s["rank"] == rank)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        count(3).alias("n_random"), F.sha2(_joined(F.sort_array("_base")), 256).alias("base_sha256"),
                        _joined(F.col("_found")).alias("spans"))


def _spans_only(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``_base`` and the ``_cand`` beside the base spans."""
    s = rows.select(*keep, "text", base_spans(F.col("text")).alias("_base"))
    return s.select(*keep, "_base", candidates(blanked(F.col("text"), F.col("_base"))).alias("_cand"))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", q: float = Q) -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mark`` (touching spans by
    one); a column ``n_chars`` follows. Texts without a span stay as they are, null too."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = _with_found(materialize(_spans_only(whole, ("_row",))), q)

    text = F.col("_row")[text_col]

    def step(acc, s):
        fresh = F.array(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        parts = F.when(s["start"] > acc["at"], F.concat(acc["parts"], fresh)).when(
            F.size(acc["parts"]) == 0, F.array(F.lit(mark))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).cast("int").alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate("_found", start, step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size("_found") > 0, clean).otherwise(text)
    out = found.withColumn("_new", new)
    return out.select(*[
        F.col("_new").alias(c) if c == text_col
        else F.when(F.size("_found") > 0, F.length("_new").cast(t)).otherwise(F.col("_row")[c]).alias(c) if c == "n_chars"
        else F.col("_row")[c].alias(c) for c, t in docs.dtypes])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
