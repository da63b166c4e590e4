"""Secrets by a randomness test battery, in DataFrame functions only.

Long tokens get an alphabet inferred from their signs (hex, base32, base64, base64url). Three tests ask whether a token
is a random string over it: chi-squared uniformity, runs about the middle, serial correlation; a token looks random if
none of them rejects (Bonferroni). Whether it could be ordinary text is asked by a likelihood ratio of sign classes
against the corpus, whose inverse bounds a p-value and so weighs a token by its length; these p-values go through
Benjamini-Hochberg in strata of length, over the tokens of all documents. Tokens that pass both are added spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, freeze, packed, unpacked
from quarterlode.llm.spans import joined, matches, merged, replaced

# Fixed patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+"  # '=' only ends a token: a name before it is cut off
KINDS = ("assign", "access", "hex", "random")  # in order of listing

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (DIGIT + "abcdef", DIGIT + "ABCDEF", UPPER + "234567", UPPER + LOWER + DIGIT + "+/", UPPER + LOWER + DIGIT + "-_")

LOOKS_RANDOM = 0.01  # level of the battery
FALSE_DISCOVERY = 0.01
STRATA = (32, 64, 128)  # lengths at which a new stratum begins
BIN = 4  # bins of -ln(p) by unit
MOST = 400  # -ln(p) is cut here


def base_spans(text: Column) -> dict[str, Column]:
    assign = matches(text, ASSIGN, "assign", (text.contains(":") | text.contains("=")) & text.rlike(ASSIGN))
    return {
        "assign": F.filter(assign, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6),
        "access": matches(text, ACCESS, "access", text.contains("AKIA")),
        "hex": matches(text, HEX, "hex", text.rlike("[0-9a-f]{24}")),
    }


def tail(z: Column) -> Column:
    """Two-sided normal tail probability (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + x * 0.3275911)
    return (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * F.exp(-x * x)


def class_counts(text: Column) -> Column:
    """(lower, upper, digit, mark) letters and signs of a text, white space aside."""
    left = lambda drop: F.length(F.regexp_replace(text, drop, "")).cast("long")
    return F.array(F.length(text) - left("[a-z]+"), F.length(text) - left("[A-Z]+"), F.length(text) - left("[0-9]+"), left(r"[A-Za-z0-9\s]+"))


def battery(tokens: Column) -> Column:
    """Spans of tokens -> structs (start, end, n, alphabet size k, counts of classes, p: smallest of the three tests times three).

    Tokens that fit no alphabet are left out."""
    fits = lambda v: F.coalesce(*(F.when(v.rlike("^[" + a.replace("-", r"\-") + "]+$"), F.lit(a)) for a in ALPHABETS))
    t = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["value"], "=+$", "").alias("v")))
    t = F.transform(t, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["v"].alias("v"), fits(s["v"]).alias("a")))
    t = F.filter(t, lambda s: s["a"].isNotNull() & (F.length(s["v"]) >= 16))
    signs = lambda v: F.filter(F.split(v, ""), lambda c: c != "")
    t = F.transform(t, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["v"].alias("v"), F.length(s["a"]).alias("k"), F.length(s["v"]).alias("n"), F.transform(signs(s["v"]), lambda c: F.position(c, s["a"])).alias("x")))
    t = F.transform(t, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["v"].alias("v"), s["k"].alias("k"), s["n"].alias("n"), s["x"].alias("x"),
        F.aggregate(s["x"], F.lit(0.0), lambda a, y: a + y, lambda a: a / s["n"]).alias("mean"),
        F.aggregate(F.array_distinct(signs(s["v"])), F.lit(0.0), lambda a, c: a + F.pow(s["n"] - F.length(F.replace(s["v"], c, F.lit(""))), 2)).alias("squares"),
        F.size(F.filter(s["x"], lambda y: y * 2 > s["k"] + 1)).alias("above"),
        F.slice(s["x"], F.lit(2), s["n"]).alias("y")))

    def tests(s: Column) -> Column:
        n, k, free = s["n"].cast("double"), s["k"].cast("double"), s["k"] - F.lit(1.0)
        chi = k / n * s["squares"] - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        p_chi = F.when(z_chi > 0, tail(z_chi) / 2).otherwise(F.lit(0.5))
        pairs = F.arrays_zip(F.slice(s["x"], F.lit(1), s["n"] - 1).alias("x"), s["y"].alias("y"))
        half = s["k"] + 1
        runs = F.size(F.filter(pairs, lambda q: (q["x"] * 2 > half) != (q["y"] * 2 > half))) + 1
        high, low = s["above"].cast("double"), n - s["above"]
        expect = 2 * high * low / n + 1
        z_runs = (runs - expect) / F.sqrt(F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(1e-9)))
        p_runs = F.when((high == 0) | (low == 0), F.lit(0.0)).otherwise(tail(z_runs))
        spread = F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + F.pow(v - s["mean"], 2))
        along = F.aggregate(pairs, F.lit(0.0), lambda a, q: a + (q["x"] - s["mean"]) * (q["y"] - s["mean"]))
        p_serial = F.when(spread == 0, F.lit(0.0)).otherwise(tail(along / F.when(spread > 0, spread) * F.sqrt(n)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), s["k"].alias("k"), class_counts(s["v"]).alias("classes"), F.least(F.lit(1.0), F.least(p_chi, p_runs, p_serial) * 3).alias("p"))

    return F.transform(t, tests)


#: By alphabet size (16, 32, 64): the share of lower, upper, digit and mark signs in a random string.
CLASS_SHARES = {16: (6 / 16, 6 / 16, 10 / 16, 0.0), 32: (0.0, 26 / 32, 6 / 32, 0.0), 64: (26 / 64, 26 / 64, 10 / 64, 2 / 64)}


def surprise(token: Column, shares: tuple[float, ...]) -> Column:
    """-ln of the bound on the p-value that a token is ordinary text with these class shares; 0 to MOST."""
    ratio = lambda k: sum((F.get(token["classes"], i) * math.log(CLASS_SHARES[k][i] / shares[i]) for i in range(4) if CLASS_SHARES[k][i] > 0), F.lit(0.0))
    found = F.coalesce(*(F.when(token["k"] == k, ratio(k)) for k in CLASS_SHARES))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), found))


def stratum(token: Column) -> Column:
    return sum(((token["n"] >= x).cast("int") for x in STRATA), F.lit(0))


def _found(docs: DataFrame, text: str, level: float, rate: float) -> DataFrame:
    """The rows with spans. Texts are scanned twice (tokens of the corpus, result) and never stored or shuffled."""
    none = F.array().cast("array<struct<start:int,end:int,n:int,k:int,classes:array<bigint>,p:double>>")
    tokens = lambda body: F.when(body.rlike("[A-Za-z0-9+/_-]{16}"), battery(matches(body, TOKEN, "random"))).otherwise(none)
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    seen = docs.select(tokens(plain).alias("_tokens"), class_counts(plain).alias("_classes"))
    rows = freeze(seen.select(F.when(F.size("_tokens") > 0, F.transform("_tokens", lambda t: t.dropFields("start", "end"))).alias("_tokens"), "_classes"))
    totals = rows.agg(*(F.sum(F.get("_classes", F.lit(i))).alias(f"c{i}") for i in range(4))).first()
    whole = sum((x or 0) for x in totals) + 4
    shares = tuple(((x or 0) + 1) / whole for x in totals)
    # Benjamini-Hochberg over bins of -ln(p): at most len(STRATA) + 1 strata of MOST * BIN + 1 bins reach the driver.
    seen = rows.select(F.explode("_tokens").alias("t")).select(stratum(F.col("t")).alias("s"), F.floor(surprise(F.col("t"), shares) * BIN).cast("int").alias("bin"))
    limits: dict[int, float] = {}
    counts: dict[int, dict[int, int]] = {}
    for r in seen.groupBy("s", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["s"], {})[r["bin"]] = r["n"]
    for s, bins in counts.items():
        rank, m = 0, sum(bins.values())
        for b in sorted(bins, reverse=True):
            rank += bins[b]
            if math.exp(-b / BIN) <= rate * rank / m:
                limits[s] = b / BIN
    body = F.coalesce(F.col("_in").getField(text), F.lit(""))
    chosen = F.filter("_tokens", lambda t: (t["p"] >= level) & _passes(t, shares, limits))
    span = lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.substring(body, t["start"] + 1, t["end"] - t["start"]).alias("value"))
    return packed(docs).withColumns({f"_{k}": v for k, v in base_spans(body).items()}).withColumn("_tokens", tokens(body)).withColumn("_random", F.transform(chosen, span)).drop("_tokens")


def find(docs: DataFrame, *, text: str = "text", level: float = LOOKS_RANDOM, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """docs with _assign, _access, _hex (base spans) and _random (added spans), each an array of (kind, start, end, value).

    Null text counts as empty. Equal texts get equal spans; each row counts as often as it stands in the table. Existing
    columns of these names are replaced. Empty table: empty result."""
    return unpacked(_found(docs, text, level, rate), docs.columns, **{f"_{k}": F.col(f"_{k}") for k in KINDS})


def _passes(t: Column, shares: tuple[float, ...], limits: dict[int, float]) -> Column:
    out, own, value = F.lit(False), stratum(t), surprise(t, shares)
    for s, x in limits.items():
        out = out | ((own == s) & (value >= x))
    return out


def ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(rank(a) - rank(b)))


def redact(docs: DataFrame, *, text: str = "text", level: float = LOOKS_RANDOM, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """docs with every secret replaced by [SECRET]; null stays null."""
    found = _found(docs, text, level, rate).withColumn("_spans", merged(F.concat("_assign", "_access", "_hex", "_random")))
    body = F.col("_in").getField(text)
    return unpacked(found, docs.columns, **{text: F.when(body.isNotNull(), replaced(body, F.col("_spans"), lambda s: F.lit("[SECRET]")))})


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    base = ordered(F.concat("_assign", "_access", "_hex"))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(ordered(F.concat("_assign", "_access", "_hex", "_random"))).alias("spans"), F.size("_random").cast("long").alias("n_random"))
