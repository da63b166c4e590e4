"""Personal data and information-theoretic sanitisation, in DataFrame functions only.

Protected entities are the values found by the base patterns. For every word in a document with an entity the corpus tells how
strongly it reveals it: PMI(entity; word) = log p(entity | word) / p(entity), against the entity's information content
IC = -log p(entity). A word discloses an entity if PMI >= disclose * IC, with p(entity | word) taken at its lower confidence
bound: a word that stands beside an entity once or twice says nothing, as any rare word does so by chance, so words need
MIN_TEXTS different texts of an entity (entities of fewer are protected by their own spans alone) and then pass if nearly all
documents that hold the word hold the entity. Wherever such a word stands it is generalised to the class of the words that begin like it, if that class is so
frequent in the corpus that it stays below the threshold itself, and removed otherwise. Entities themselves become a tag
of their kind. Every row counts as a document, copies too, in all counts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, freeze, is_small, packed, unpacked
from quarterlode.llm.spans import SPAN, joined, matches, merged, replaced

# Fixed patterns. Where a match fails from the start of a run of its signs it fails from every later start of that run,
# so starts inside a run (but for the end of the last match, \G) are barred, and runs are possessive: linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")

MIN_TEXTS = 3  # different texts that hold both the entity and the word
DISCLOSE = 0.9  # of the entity's information content
DOUBT = 1.64  # square of the normal quantile for nine in ten: of k texts that agree, k / (k + DOUBT) is the lower bound
COMMON, FEW = 1.0, 10  # a caller may leave out entities in more than a share of all documents, unless in FEW or less; none is by default
CLASS_SIGNS = 3


def luhn(value: Column) -> Column:
    """Whether the digits of a value have a Luhn check digit."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    digits = F.filter(digits, lambda d: d != "")
    points = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits_in(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of spans by kind."""
    digit = text.rlike("[0-9]")
    card = F.filter(matches(text, CARD, "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda s: digits_in(s["value"]).between(16, 19))
    return {
        "email": matches(text, EMAIL, "email", text.contains("@")),
        "ip": F.filter(matches(text, IP, "ip", digit & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda s: s["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": F.filter(card, lambda s: luhn(s["value"])),
        "phone": F.filter(matches(text, PHONE, "phone", text.contains("+")), lambda s: digits_in(s["value"]).between(8, 15)),
    }


def entity(s: Column) -> Column:
    """An entity's value without case and punctuation of numbers."""
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), F.regexp_replace(s["value"], "[^0-9]", "")).otherwise(F.lower(s["value"])))


WORDS = r"[^\p{L}\p{N}]+"


def outside(text: Column, spans: Column) -> Column:
    """text with a blank in place of each base span, so that an entity's own words are no terms."""
    return replaced(text, merged(spans), lambda s: F.lit(" "))


def distinct_words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, WORDS)), lambda w: w != "")


def _words_of(text: Column) -> Column:
    """Distinct words of a text without case, and their classes ('*' in front)."""
    low = distinct_words(F.lower(text))
    return F.concat(low, F.array_distinct(F.transform(low, lambda w: F.concat(F.lit("*"), F.substring(w, 1, CLASS_SIGNS)))))


def disclosing(holders: DataFrame, docs: DataFrame, text: str, *, min_texts: int = MIN_TEXTS, disclose: float = DISCLOSE, common: float = COMMON) -> DataFrame:
    """(term, elsewhere, action): the words that disclose an entity, whether any stands in a text without entities, and
    the class that replaces it (null: removed).

    holders: (_print, copies, entities, words), one row of each text that holds an entity. Words are counted over the
    whole corpus; one is left out before that only if the documents of `holders` are already too many for it to pass.
    Every entity of min_texts texts is judged, however common; one in all documents is no news anywhere. `common` leaves
    out those above a share of all documents: FEW documents are few in any corpus."""
    total = float(docs.count())
    each = holders.select("_print", "copies", F.explode("entities").alias("entity"))
    known = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts_e"))
    kept = F.lit(True) if common >= 1 else (F.col("n_entity") <= common * total) | (F.col("n_entity") <= FEW)
    known = known.where((F.col("texts_e") >= min_texts) & (F.col("n_entity") < total) & kept).drop("texts_e")
    each = each.join(known, "entity")
    # The most documents a word may be in if it discloses an entity: both / n_term >= p(entity) ** (1 - disclose).
    most = lambda n: n * F.pow(total / n, F.lit(1.0 - disclose)) * (1 + 1e-9)
    widest = each.groupBy("_print").agg(F.max(most(F.col("n_entity"))).alias("most"))
    words = holders.select("_print", "copies", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term"))
    around = words.groupBy("term").agg(F.sum("copies").alias("n_near"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts).drop("texts")
    pairs = words.join(widest, "_print").join(around, "term").where("n_near <= most")
    pairs = pairs.join(each.select("_print", "entity", "n_entity"), "_print").where(F.col("n_near") <= most(F.col("n_entity")))
    pairs = pairs.groupBy("term", "entity", "n_entity").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts"), F.first("n_near").alias("n_near"))

    def share(n_term: Column) -> Column:
        """PMI at the lower bound as a share of the entity's information content."""
        sure = F.col("texts") / (F.col("texts") + DOUBT)
        return F.log(F.col("both") * sure * F.lit(total) / (F.col("n_entity") * n_term)) / -F.log(F.col("n_entity") / F.lit(total))

    passes = lambda n: F.coalesce(share(n) >= disclose - 1e-9, F.lit(False))
    may = freeze(pairs.where((F.col("texts") >= min_texts) & passes(F.col("n_near"))))
    # Counts of the words and classes that matter, over all texts.
    wanted = freeze(may.select(F.explode(F.array("term", F.concat(F.lit("*"), F.substring("term", 1, CLASS_SIGNS)))).alias("word")).distinct())
    every = docs.select(F.explode(_words_of(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("word"))
    if is_small(wanted, "word"):
        every = every.join(F.broadcast(wanted), "word", "left_semi")
        counts = freeze(every.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    else:  # counted in the tasks first, so that frequent words do not meet in one
        counts = freeze(every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(wanted, "word", "left_semi"))
    scored = may.join(counts.select(F.col("word").alias("term"), F.col("n").alias("n_term")), "term").where(passes(F.col("n_term")))
    # A class that is in more documents than `most` cannot disclose, whatever documents it shares with the entity.
    told = scored.groupBy("term").agg(F.max(F.col("n_term") > F.col("n_near")).alias("elsewhere"), F.max(most(F.col("n_entity"))).alias("most"))
    told = told.withColumn("word", F.concat(F.lit("*"), F.substring("term", 1, CLASS_SIGNS))).join(counts, "word")
    return told.select("term", "elsewhere", F.when((F.col("n") > F.col("most")) & (F.length("term") > CLASS_SIGNS), F.concat(F.substring("term", 1, CLASS_SIGNS), F.lit("*"))).alias("action"))


def _found(docs: DataFrame, text: str, limits: dict) -> DataFrame:
    """The rows with spans. Texts are scanned three times (entities, counts, result), once more if a disclosing word
    stands in texts without entities; they are not stored: what is kept in between is told by a hash of the text."""

    def spans(df: DataFrame, body: Column) -> DataFrame:
        return df.withColumn("_body", F.coalesce(body, F.lit(""))).withColumns({f"_{k}": v for k, v in base_spans(F.col("_body")).items()}).withColumn("_print", F.xxhash64("_body"))

    every = F.concat(*(F.col(f"_{k}") for k in KINDS))
    # Filtered after the checkpoint: a filter pushed below would find the spans twice.
    holders = spans(docs.select(F.col(f"`{text}`").alias("_t")), F.col("_t")).withColumn("entities", F.array_distinct(F.transform(every, entity)))
    holders = freeze(holders.select("_print", "entities", F.when(F.size("entities") > 0, distinct_words(outside(F.col("_body"), every))).alias("words")))
    holders = holders.where(F.size("entities") > 0).groupBy("_print").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    holders = freeze(holders)
    told = freeze(disclosing(holders, docs, text, **limits))

    def forms(texts: DataFrame, words: DataFrame) -> DataFrame:
        """(_print, form, action) of the words of some texts that are among `words`."""
        found = texts.select("_print", F.explode("words").alias("form")).withColumn("term", F.lower("form"))
        return found.join(F.broadcast(words) if is_small(words, "term") else words, "term").select("_print", "form", F.coalesce("action", F.lit("")).alias("action"))

    marks = forms(holders, told)
    spread = freeze(told.where("elsewhere"))
    if not spread.isEmpty():
        plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        marks = marks.unionByName(forms(docs.select(F.xxhash64(plain).alias("_print"), distinct_words(plain).alias("words")), spread))
    marks = freeze(marks.groupBy("_print").agg(F.map_from_entries(F.collect_set(F.struct("form", "action"))).alias("_marks")))
    size = marks.select(F.array_join(F.map_keys("_marks"), "|").alias("_w"))
    # Joined before the spans are found: beyond the broadcast bound only the rows themselves are shuffled.
    rows = packed(docs).withColumn("_print", F.xxhash64(F.coalesce(F.col("_in").getField(text), F.lit(""))))
    rows = rows.join(F.broadcast(marks) if is_small(size, "_w") else marks, "_print", "left")
    rows = spans(rows, F.col("_in").getField(text))
    return rows.withColumn("_terms", placed(F.col("_body"), F.col("_marks"), every)).drop("_body", "_marks")


def placed(text: Column, marks: Column, base: Column) -> Column:
    """Spans of all words of `marks` (word as written -> action) in a text, base spans aside.

    Base spans are blanked sign by sign, then every word of the text is looked up once."""
    blank = replaced(text, merged(base), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    found = F.transform(F.array(F.when(marks.isNotNull(), blank)), lambda t: matches(t, r"[\p{L}\p{N}]+", "term"))[0]
    judged = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.element_at(marks, s["value"]).alias("value")))
    return F.coalesce(F.filter(judged, lambda s: s["value"].isNotNull()), F.array().cast(SPAN))


def find(docs: DataFrame, *, text: str = "text", **limits) -> DataFrame:
    """docs with _email, _ip, _card, _phone (base spans) and _terms (spans of disclosing words, kind 'term').

    Null text counts as empty. Equal texts get equal spans, repeated rows and ids do no harm; existing columns of these
    names are replaced. Empty table: empty result."""
    made = [*(f"_{k}" for k in KINDS), "_terms"]
    return unpacked(_found(docs, text, limits), docs.columns, **{c: F.col(c) for c in made})


def sanitise(docs: DataFrame, *, text: str = "text", **limits) -> DataFrame:
    """docs with entities replaced by a tag of their kind and disclosing words by their class ('zan*') or by nothing.

    Null text stays null, empty stays empty; rows are independent of their ids, so repeats and ties need no care; equal
    texts give equal texts. All columns stay, whatever their names. Empty table: empty result."""
    tag = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(s["value"])
    found = _found(docs, text, limits).withColumn("_spans", merged(F.concat(*(F.col(f"_{k}") for k in KINDS), "_terms")))
    body = F.col("_in").getField(text)
    return unpacked(found, docs.columns, **{text: F.when(body.isNotNull(), replaced(body, F.col("_spans"), tag))})


def op4_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.concat(*(F.col(f"_{k}") for k in KINDS))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("_terms"))).alias("spans"), F.size("_terms").cast("long").alias("n_terms"))
