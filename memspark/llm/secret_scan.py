"""Secret scan: three kinds of base patterns and a randomness battery on long tokens, with DataFrame functions only.

A token's encoding is inferred from its characters. A chi-squared test of the encoding's alphabet, a runs test about the
alphabet's middle and a lag-one serial correlation test must all agree with randomness. Two tests of the same length then
ask whether it may be ordinary writing: the likelihood of its letters, and how often the kind of character changes. Their
combined p-values are held against each other over all tokens of the table by the Benjamini-Hochberg procedure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import cut

# The contract's patterns. The kinds are listed in this order where starts are equal.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"([A-Za-z0-9+/_-]{20,})"
#: Encodings by the first pattern that fits: name, pattern, size of the alphabet, code points in order. Digits alone are numbers.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("lower", "^[a-z]+$", LOWER),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("upper36", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", ".", UPPER + LOWER + DIGITS + "+/-_"),
)
# How often letters stand in ordinary writing, in parts of a thousand, a mean of four languages.
LETTERS = {
    "a": 85, "b": 16, "c": 32, "d": 45, "e": 135, "f": 14, "g": 19, "h": 30, "i": 68, "j": 4, "k": 6, "l": 45, "m": 28,
    "n": 76, "o": 62, "p": 19, "q": 6, "r": 66, "s": 72, "t": 68, "u": 40, "v": 12, "w": 11, "x": 2, "y": 8, "z": 5,
}
#: Words are not independent draws of letters: the spread of their likelihood is wider by so much.
WIDER = 1.3
#: Part of the neighbours in ordinary tokens (camel case, words with numbers, paths) that differ in kind.
CHANGES = 0.3
FALSE_DISCOVERIES = 0.05
AGREE = 1e-4
_BINS_PER_DECADE = 20


def _normal_cdf(z: Column) -> Column:
    """Upper-accuracy polynomial for the standard normal distribution function (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / F.lit((2 * 3.141592653589793) ** 0.5) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, chi2, z-values and the p-values ``p_text`` and ``p_random`` to the column ``match``."""
    pick = lambda values: F.coalesce(*[F.when(F.col("match").rlike(p), F.lit(v)) for (_, p, _), v in zip(ENCODINGS, values, strict=True)])
    t = tokens.filter(~F.col("match").rlike("^[0-9]+$")).withColumn("encoding", pick([e[0] for e in ENCODINGS])).withColumn("alphabet", pick([e[2] for e in ENCODINGS]))
    t = t.withColumn("chars", F.filter(F.split("match", ""), lambda c: c != ""))
    t = t.withColumn("codes", F.expr("transform(chars, c -> instr(alphabet, c) - 1)")).drop("chars")
    size, n = F.length("alphabet").cast("double"), F.size("codes").cast("double")
    counts = F.transform(F.sequence(F.lit(0), F.length("alphabet") - 1), lambda a: F.size(F.filter("codes", lambda x: x == a)).cast("double"))
    t = t.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    t = t.withColumn("chi2", F.col("squares") * size / n - n)
    df = size - 1
    cube = (F.pow(F.col("chi2") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    middle = (size - 1) / 2
    high = F.aggregate("codes", F.lit(0.0), lambda s, x: s + F.when(x > middle, 1.0).otherwise(0.0))
    pairs = F.arrays_zip(F.slice("codes", 1, F.size("codes") - 1).alias("a"), F.slice("codes", 2, F.size("codes") - 1).alias("b"))
    t = t.withColumn("high", high).withColumn("pairs", pairs)
    runs = F.aggregate("pairs", F.lit(1.0), lambda s, p: s + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0))
    low = n - F.col("high")
    mean = 1 + 2 * F.col("high") * low / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    t = t.withColumn("z_runs", F.when(spread > 0, (runs - mean) / F.sqrt(spread)).otherwise(F.lit(9.0)))
    total = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x)
    t = t.withColumn("mu", total / n)
    around = F.aggregate("codes", F.lit(0.0), lambda s, x: s + (x - F.col("mu")) * (x - F.col("mu")))
    along = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p["a"] - F.col("mu")) * (p["b"] - F.col("mu")))
    t = t.withColumn("z_serial", F.when(around > 0, (along / around + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0)))
    tail = lambda z: 2 * _normal_cdf(-F.abs(z))
    t = t.withColumn("p_random", F.least(1 - _normal_cdf(cube), tail(F.col("z_runs")), tail(F.col("z_serial"))))
    return _writing(t).drop("codes", "pairs", "alphabet", "squares", "high", "mu")


def _writing(t: DataFrame) -> DataFrame:
    """Adds ``p_text``: the chance that ordinary writing of that length has so unlikely letters and changes kind so often.

    The letters of a hexadecimal token must all lie in a to f, which is a chance of its own.
    """
    share = {c: f / sum(LETTERS.values()) for c, f in LETTERS.items()}
    score = {c: math.log(26 * f) for c, f in share.items()}
    mean = sum(share[c] * score[c] for c in share)
    spread = math.sqrt(sum(share[c] * score[c] ** 2 for c in share) - mean**2)
    letters = F.filter(F.split(F.lower("match"), ""), lambda c: c.between("a", "z"))
    scores = F.array(*[F.lit(score[c]) for c in LOWER])
    t = t.withColumn("letters", F.transform(letters, lambda c: F.get(scores, F.ascii(c) - ord("a"))))
    m, n = F.size("letters").cast("double"), F.length("match").cast("double")
    likely = (F.aggregate("letters", F.lit(0.0), lambda a, x: a + x) - m * mean) / (WIDER * spread * F.sqrt(m))
    kinds = F.translate("match", LOWER + UPPER + DIGITS, "l" * 26 + "u" * 26 + "d" * 10)
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    often = (changes - 0.5 - CHANGES * (n - 1)) / F.sqrt(CHANGES * (1 - CHANGES) * (n - 1))
    inside = F.when(F.col("encoding").isin("hex", "HEX"), F.pow(F.lit(sum(share[c] for c in "abcdef")), m)).otherwise(F.lit(1.0))
    product = F.when(m > 0, _normal_cdf(likely)).otherwise(F.lit(1.0)) * _normal_cdf(-often) * inside
    product = F.least(F.greatest(product, F.lit(1e-300)), F.lit(1.0))
    return t.withColumn("p_text", product * (1 - F.log(product))).drop("letters")


def discovery_threshold(tested: DataFrame, rate: float) -> float:
    """Largest p-value that the Benjamini-Hochberg procedure accepts, from counts in bins of the p-values.

    The number of bins is bounded by the range of doubles; a bin counts at its upper edge, so none is accepted wrongly.
    """
    bins = tested.groupBy(F.floor(-F.log10("p_text") * _BINS_PER_DECADE).alias("bin")).count().collect()
    total, seen, best = sum(r["count"] for r in bins), 0, 0.0
    for r in sorted(bins, key=lambda r: -r.bin):
        seen += r["count"]
        edge = 10.0 ** (-r.bin / _BINS_PER_DECADE)
        if edge <= rate * seen / total:
            best = edge
    return best


def _found(text: Column, kind: int, pattern: str) -> Column:
    """Matches with the lengths of the gaps before them, as array<struct<kind, number, gap, match, value>>."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == 0 else matches
    both = F.arrays_zip(matches.alias("match"), F.transform(F.slice(gaps, 1, F.size(matches)), lambda g: F.length(g)).alias("gap"), F.transform(values, lambda v: F.length(v)).alias("value"))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x["gap"].cast("long").alias("gap"), x["match"].alias("match"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), rows).otherwise(F.expr("cast(array() as array<struct<kind:int,number:int,gap:bigint,match:string,value:int>>)"))


def secret_spans(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> tuple[DataFrame, DataFrame]:
    """Document rows (row, doc_id) and their spans (row, kind, start, end, match); kinds as in KINDS, in code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*[_found(F.col("text"), k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    base = docs.select("doc_id", text.alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))
    base = cut(base)
    rows = base.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    order = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    rows = cut(rows.filter(f"kind <> 0 or value >= {LEAST_VALUE}").select("row", "kind", "start", "end", "match"))
    tested = cut(_battery(rows.filter(F.col("kind") == 3)).select("row", "kind", "start", "end", "match", "p_text", "p_random"))
    limit = discovery_threshold(tested, rate)
    random = tested.filter((F.col("p_text") <= limit) & (F.col("p_random") >= AGREE)).select("row", "kind", "start", "end", "match")
    return base.select("row", "doc_id"), rows.filter(F.col("kind") < 3).union(random)


def secret_scan(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end, comma-joined).

    ``docs`` needs doc_id and text; other columns are ignored. Spans of different kinds may overlap. A null text is empty;
    a text without spans has zero counts and an empty list. Rows that repeat a doc_id give rows of their own. An empty
    table gives no rows.
    """
    base, spans = secret_spans(docs, rate)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = spans.withColumn("label", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")))
    per = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "label"))).alias("all"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: s["label"]), ",")
    count = lambda k: F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == k)), F.lit(0)).cast("long")
    out = base.join(per, "row", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<start:bigint,kind:int,label:string>>)")))
    return out.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(joined(F.filter("all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
