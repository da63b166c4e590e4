"""Scanned pages: boxes of recognised text to rows, columns and lines, and the table among the lines.

A page has some hundred boxes or lines, so each stands in one array that an ordered fold goes over."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlode.operators.phases import bound, once

# Fixed values. Shares of a page's height and width.
ROW_BUCKET, COLUMN_GAP, CLUSTER_GAP = 0.009, 0.05, 0.065
# Fixed values. What table headers hold, what lines of values name, and section titles.
TABLE_HEADERS = ("statementsofincome", "statementsofoperations", "balancesheets", "cashflows", "threemonthsended", "sixmonthsended", "ninemonthsended", "yearended", "quarterended", "fiscal20", "gaap", "nongaap", "inmillions", "inbillions", "unaudited")
VALUE_WORDS = ("revenue", "income", "tax", "净利润", "营业收入", "利润")
SECTIONS = ("operatingexpenses", "otherexpenseincome", "otherincomeexpense", "earningspercommonshare", "impactperdilutedshare")
NUMBER = r"^[(]?[-−–]?[$¥€£]?\d[\d,]*(?:\.\d+)?%?[)]?$"
SCALED = r"(?i)\d[\d,]*(?:\.\d+)?\s*(?:b\s*i\s*l\s*l\s*i\s*o\s*n|m\s*i\s*l\s*l\s*i\s*o\s*n)\b"
BOX = "array<struct<y:double,x:double,text:string,width:double,height:double>>"


def _boxes(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each page: its boxes with text from top to bottom, then left to right."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    item = F.struct(zero("y"), zero("x"), text.alias("text"), zero("width"), zero("height"))
    return boxes.where(text != "").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_b"))


def _rows(items: Column) -> Column:
    """Boxes as rows: a box joins the row above if it is within ROW_BUCKET, or 45 % of its height, of the mean height of that
    row's boxes so far. Each row from left to right."""

    def step(st: Column, b: Column) -> Column:
        n = F.size(st["row"])
        near = (n > 0) & (F.abs(b["y"] - st["anchor"]) <= F.greatest(F.lit(ROW_BUCKET), b["height"] * 0.45))
        mean = (st["anchor"] * n + b["y"]) / (n + 1)
        joined = F.struct(st["rows"].alias("rows"), F.concat(st["row"], F.array(b)).alias("row"), mean.alias("anchor"))
        opened = F.struct(F.when(n > 0, F.concat(st["rows"], F.array(st["row"]))).otherwise(st["rows"]).alias("rows"), F.array(b).alias("row"), b["y"].alias("anchor"))
        return F.when(near, joined).otherwise(opened)

    begin = F.struct(F.array().cast(f"array<{BOX}>").alias("rows"), F.array().cast(BOX).alias("row"), F.lit(0.0).alias("anchor"))
    rows = F.aggregate(items, begin, step, lambda st: F.concat(st["rows"], F.array(st["row"])))
    across = lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0)
    return F.transform(rows, lambda r: F.array_sort(r, across))


def ocr_rows(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row_no, place, y, x, text): boxes (x, y, width, height, text) in rows, place being that in the row."""
    rows = _boxes(boxes, keys).select(*keys, F.posexplode(_rows(F.col("_b"))).alias("row_no", "r"))
    return rows.select(*keys, "row_no", F.posexplode("r").alias("place", "b")).select(*keys, "row_no", "place", "b.y", "b.x", "b.text")


def _anchors(rows: Column) -> Column:
    """Columns of a page: a box within CLUSTER_GAP of an anchor (the first such) moves it half way, others open one."""

    def step(a: Column, x: Column) -> Column:
        return bound(F.array_position(F.transform(a, lambda v: F.abs(x - v) <= CLUSTER_GAP), True), lambda k: F.when(k == 0, F.array_sort(F.concat(a, F.array(x)))).otherwise(F.transform(a, lambda v, i: F.when(i + 1 == k, (v + x) / 2).otherwise(v))))

    return F.array_sort(F.aggregate(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda b: b["x"]))), F.array().cast("array<double>"), step))


def _lines(at: DataFrame, keys: Sequence[str], line: Callable[[Column], Column]) -> DataFrame:
    """Rows `_r` of pages as lines, by the height of their highest box."""
    rows = F.transform("_r", lambda r, i: F.struct(F.array_min(F.transform(r, lambda b: b["y"])).alias("y"), i.alias("i"), line(r).alias("line")))
    kept = F.array_sort(F.filter(rows, lambda l: F.coalesce(l["line"], F.lit("")) != ""))
    return at.select(*keys, F.posexplode(kept).alias("line_no", "l")).select(*keys, "line_no", "l.line")


def grid_lines(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_no, line): cells of each row joined by ' | ', a box in the cell of the nearest column (the first of
    equals). Pages with one column have no lines."""
    at = once(once(_boxes(boxes, keys), _r=_rows(F.col("_b"))).drop("_b"), _a=_anchors(F.col("_r"))).where(F.size("_a") >= 2)

    def line(r: Column) -> Column:
        place = lambda b: bound(F.transform("_a", lambda v: F.abs(v - b["x"])), lambda d: F.array_position(d, F.array_min(d)))
        placed = F.transform(r, lambda b: F.struct(place(b).alias("k"), b["text"].alias("text")))
        cells = bound(placed, lambda p: F.transform(F.array_sort(F.array_distinct(F.transform(p, lambda c: c["k"]))), lambda k: F.array_join(F.transform(F.filter(p, lambda c: c["k"] == k), lambda c: c["text"]), " ")))
        return F.array_join(cells, " | ")

    return _lines(at, keys, line)


def spaced_lines(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_no, line): boxes of each row joined by a blank, or by ' | ' where the gap is wider than COLUMN_GAP."""
    at = once(_boxes(boxes, keys), _r=_rows(F.col("_b"))).drop("_b")

    def line(r: Column) -> Column:
        gap = lambda b, i: b["x"] - (F.get(r, i - 1)["x"] + F.get(r, i - 1)["width"])
        return F.trim(F.array_join(F.transform(r, lambda b, i: F.concat(F.when(i == 0, "").when(gap(b, i) > COLUMN_GAP, " | ").otherwise(" "), b["text"])), ""))

    return _lines(at, keys, line)


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z一-鿿]+", "")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def number_count(c: Column) -> Column:
    return F.size(F.filter(_tokens(c), lambda w: w.rlike(NUMBER)))


def data_cells(c: Column) -> Column:
    """How many cells behind the first hold a number."""
    cells = F.slice(F.split(c, r"\|"), F.lit(2), F.greatest(F.size(F.split(c, r"\|")), F.lit(1)))
    return F.size(F.filter(cells, lambda x: (number_count(x) > 0) | x.rlike(SCALED)))


def is_label(c: Column) -> Column:
    return (F.trim(c) != "") & ~c.contains("|") & (number_count(c) == 0) & (F.length(F.trim(c)) <= 90) & ~F.trim(c).endswith(".") & ~c.contains('"')


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines with `header`, `value`, `label`, `section` and `cells` (cells behind the first that hold a number)."""
    line = F.col("line")
    at = lines.withColumns({"_key": _key(line), "_n": number_count(line), "cells": F.when(line.contains("|"), data_cells(line)).otherwise(0)})
    some = lambda words: F.regexp_like("_key", F.lit("|".join(words)))
    section = (F.col("_key") != "") & (F.trim(line).endswith(":") | F.col("_key").isin(*SECTIONS))
    return at.withColumns({"header": some(TABLE_HEADERS), "value": (F.col("cells") >= 2) | ((F.col("_n") >= 2) & some(VALUE_WORDS)), "label": is_label(line), "section": section}).drop("_key", "_n")


def table_block(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines (keys, line_no, line) of a page's table: from the first header or line of values on, up to the second line
    that is neither these nor a label, or the reference to the notes. One such line, or blanks, may stand between."""
    at = line_kinds(lines.select(*keys, "line_no", F.trim(F.coalesce("line", F.lit(""))).alias("line")))
    item = F.struct("line_no", "line", (F.col("header") | F.col("value")).alias("opens"), (F.col("header") | F.col("value") | F.col("label")).alias("fits"), F.lower("line").contains("the accompanying notes").alias("notes"))
    pages = at.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l"))

    def step(st: Column, x: Column) -> Column:
        put = lambda slack, ended, take: F.struct(F.lit(True).alias("on"), slack.cast("int").alias("slack"), ended.alias("ended"), F.when(take, F.concat(st["out"], F.array(x["line_no"].cast("int")))).otherwise(st["out"]).alias("out"))
        yes, no = F.lit(True), F.lit(False)
        started = F.when(x["line"] == "", put(st["slack"] + 1, no, no)).when(x["notes"], put(st["slack"], yes, no)).when(x["fits"], put(F.lit(0), no, yes)).when(st["slack"] + 1 >= 2, put(st["slack"] + 1, yes, no)).otherwise(put(st["slack"] + 1, no, yes))
        return F.when(st["ended"], st).when(st["on"], started).when(x["opens"] & (x["line"] != ""), put(F.lit(0), no, yes)).otherwise(st)

    begin = F.struct(F.lit(False).alias("on"), F.lit(0).alias("slack"), F.lit(False).alias("ended"), F.array().cast("array<int>").alias("out"))
    taken = pages.select(*keys, F.explode(F.aggregate("_l", begin, step, lambda st: st["out"])).alias("line_no"))
    return at.join(taken, [*keys, "line_no"], "left_semi").select(*keys, "line_no", "line")


def merge_wrapped(block: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of a block with labels joined to the values below them (section titles aside), and lines of further numbers
    to the row above: those that begin with an empty cell, or with a number where the row above begins with a label."""
    at = line_kinds(block)
    first = F.trim(F.split("line", r"\|")[0])
    item = F.struct("line_no", "line", F.col("line").contains("|").alias("pipe"), "cells", "label", "section", first.alias("first"), is_label(first).alias("named"), ((first != "") & (number_count(first) == F.size(_tokens(first)))).alias("numeric"))
    pages = at.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    rows = "array<struct<line_no:int,line:string,pipe:boolean,named:boolean>>"

    def step(st: Column, x: Column) -> Column:
        """State: merged rows, and a label that waits for its values."""
        last, wait = F.element_at(st["out"], -1), F.element_at(st["wait"], -1)
        row = lambda n, line, pipe, named: F.array(F.struct(n.cast("int").alias("line_no"), line.alias("line"), pipe.alias("pipe"), named.alias("named")))
        none = F.array().cast(rows)
        state = lambda out, w: F.struct(out.alias("out"), w.alias("wait"))
        values = x["pipe"] & (x["cells"] >= 2)
        own = row(x["line_no"], x["line"], x["pipe"], x["named"])
        joined = F.concat(F.trim(wait["line"]), F.lit(" "), x["line"])
        some = F.size(st["out"]) > 0
        more = some & values & last["pipe"] & ((x["first"] == "") | (x["numeric"] & last["named"]))
        parts = F.array_join(F.filter(F.transform(F.split(x["line"], r"\|"), lambda c: F.trim(c)), lambda c: c != ""), " | ")
        grown = F.concat(F.slice(st["out"], F.lit(1), F.greatest(F.size(st["out"]) - 1, F.lit(0))), row(last["line_no"], F.concat(last["line"], F.lit(" | "), parts), last["pipe"], last["named"]))
        plain = F.when(more, state(grown, none)).when(x["label"] & ~x["section"], state(st["out"], own)).otherwise(state(F.concat(st["out"], own), none))
        waited = F.when(values, state(F.concat(st["out"], row(wait["line_no"], joined, F.lit(True), is_label(F.trim(F.split(joined, r"\|")[0])))), none))
        # A label that was not followed by values is a row of its own; then the line is judged as if none had waited.
        flushed = F.concat(st["out"], st["wait"])
        alone = F.when(x["label"] & ~x["section"], state(flushed, own)).otherwise(state(F.concat(flushed, own), none))
        return F.when(F.size(st["wait"]) > 0, F.coalesce(waited, alone)).otherwise(plain)

    begin = F.struct(F.array().cast(rows).alias("out"), F.array().cast(rows).alias("wait"))
    done = pages.select(*keys, F.aggregate("_l", begin, step, lambda st: F.concat(st["out"], st["wait"])).alias("_m"))
    return done.select(*keys, F.explode("_m").alias("m")).select(*keys, "m.line_no", "m.line").where("trim(line) <> ''")
