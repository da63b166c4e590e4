"""Regular-expression matches with their places, in DataFrame functions only.

Spark gives the matches of a pattern (regexp_extract_all) and the text between them (split) but no places; a match
starts where the texts and matches before it end. Lengths are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
CHUNK = 256


def folded(items: Column, kind: str, step) -> Column:
    """Folds items in order with step((at, out), item); a struct of the last `at` and all of `out` (an array type `kind`).

    Arrays grow by copying, so `out` is built in chunks of CHUNK items: linear in a text with very many matches."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(items, i + 1, CHUNK))
    none = F.array().cast(kind)
    begin = F.array(F.struct(F.lit(0).alias("at"), none.alias("out")))

    def one(done: Column, chunk: Column) -> Column:
        state = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(chunk, state, step)))

    finish = lambda done: F.struct(F.element_at(done, -1)["at"].alias("at"), F.flatten(F.transform(done, lambda d: d["out"])).alias("out"))
    return F.aggregate(chunks, begin, one, finish)


def matches(text: Column, pattern: str | Column, kind: str, maybe: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as (kind, start, end, value); the pattern must not match the empty string.

    maybe: a cheap condition without which there is no match."""
    # Both arrays go in as the aggregate's input: inside a lambda they would be made anew for every match.
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)).alias("value"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["between"])
        end = start + F.length(part["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.when(part["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    sought, none = folded(parts, SPAN, step)["out"], F.array().cast(SPAN)
    return F.coalesce(sought if maybe is None else F.when(maybe, sought), none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(spans: Column) -> Column:
    """Spans in order of start, those that begin inside an earlier one left out; the longer of two at one start stays."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(acc: Column, s: Column) -> Column:
        take = s["start"] >= acc["at"]
        return F.struct(F.when(take, s["end"]).otherwise(acc["at"]).alias("at"), F.when(take, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    return folded(ordered, SPAN, step)["out"]


def replaced(text: Column, spans: Column, by) -> Column:
    """text with each of the spans (in order, apart) replaced by by(span)."""

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s))).alias("out"))

    built = F.transform(F.array(folded(spans, "array<string>", step)), lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))[0]
    return F.when(F.size(spans) > 0, built).otherwise(text)
