"""Personal data and the terms that reveal it, found and sanitised with DataFrame functions only.

Base spans are e-mail and IP addresses, card numbers (Luhn) and phone numbers.  The values found are the protected
entities.  A term is a word within `reach` characters of an entity (None: of its document); over the whole corpus, with probabilities of documents,
PMI(entity; term) = log2 p(entity, term) / (p(entity) p(term)) says how much of the entity's information
content IC = -log2 p(entity) the term gives away.  A term whose share PMI / IC reaches `generalise_at` is generalised, one
that reaches `remove_at` is removed, wherever it stands in reach of that entity; words out of reach are left alone.  A pair
seen in fewer than `support` documents tells nothing about co-occurrence and is left alone as well.
With `chance`, words beyond the reach are judged as well, by whole documents: a document has many of them, so of those whose share is high enough a
pair must also be unlikely by chance (Chernoff's bound for as many documents, times the words tried with the entity, at most `chance`).

Positions come from the lengths of what stands between matches, so they are code points.  Patterns start only where a
match can begin and repeat possessively: long runs of digits or letters take linear time and no recursion.

Documents are read twice (spans, word counts), words are counted with partial aggregation, and only spans travel.
Nulls: a null text is empty and has no spans; rows with a null id, or sharing one, keep their own spans (rows are
told apart by id and text).  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blocks import written

#: Fixed patterns of the kinds, in the order of the kinds.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"\p{L}++"
#: Scripts in which names have two characters.
SHORT = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]++$"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def located(text: Column, pattern: str, kind: int, use: Column) -> Column:
    """The matches of a pattern in order, as an array of SPAN; use: whether a match is possible at all."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["m"].alias("value")))
        return F.struct(e.alias("at"), F.concat(a["out"], one).alias("out"))

    return F.when(use, F.aggregate(F.filter(both, lambda x: x["m"].isNotNull()), start, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int") * (F.lit(1) + (n - i) % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    email = located(text, EMAIL, 0, F.contains(text, F.lit("@")))
    ip = F.filter(located(text, IP, 1, text.rlike(IP)), lambda x: x["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = located(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"))
    card = F.filter(card, lambda x: F.length(_digits(x["value"])).between(12, 19))
    card = F.filter(card, lambda x: _luhn(_digits(x["value"])))
    phone = F.filter(located(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["value"])).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, spans, text): text only where there are spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), base_spans(text).alias("spans"), text.alias("text"))
    return rows.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def contexts(text: Column, spans: Column, reach: int) -> Column:
    """For each span its kind, its entity and the text to its left and right: up to reach characters, up to the next span."""
    one = "struct<x:struct<start:int,kind:int,end:int,value:string>,lo:int,hi:int>"
    begin = F.struct(F.lit(0).alias("m"), F.array().cast(f"array<{one}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        hi = F.greatest(a["m"], x["end"])
        return F.struct(hi.alias("m"), F.concat(a["out"], F.array(F.struct(x.alias("x"), a["m"].alias("lo"), hi.alias("hi")))).alias("out"))

    def side(start: Column, end: Column, cut_front: Column, cut_end: Column) -> Column:
        n = F.greatest(F.lit(0), end - start)
        return F.struct(start.alias("at"), text.substr(start + 1, n).alias("text"), F.when(cut_front, F.lit(0)).otherwise(F.lit(-1)).alias("cut_front"), F.when(cut_end, n).otherwise(F.lit(-1)).alias("cut_end"))

    def both(a: Column, after: Column) -> Column:
        x, no = a["x"], F.lit(False)
        far, end = x["start"] - reach, a["hi"] + reach
        stop = F.coalesce(F.least(after["start"], end), end)
        return F.struct(
            x["kind"].alias("kind"), F.lower(x["value"]).alias("entity"), side(F.greatest(a["lo"], far), x["start"], far > a["lo"], no).alias("left"), side(a["hi"], stop, no, stop == end).alias("right")
        )

    walked = F.aggregate(spans, begin, step, lambda a: a["out"])
    return F.filter(F.zip_with(walked, F.slice(spans, F.lit(2), F.size(spans)), lambda a, b: F.when(a.isNotNull(), both(a, b))), lambda c: c.isNotNull())


def gaps(text: Column, spans: Column) -> Column:
    """What lies outside the spans, in order: where it begins and its text."""
    begin = F.struct(F.lit(0).alias("m"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.struct(a["m"].alias("at"), text.substr(a["m"] + 1, F.greatest(F.lit(0), x["start"] - a["m"])).alias("text"))
        return F.struct(F.greatest(a["m"], x["end"]).alias("m"), F.concat(a["out"], F.array(gap)).alias("out"))

    return F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.array(F.struct(a["m"].alias("at"), text.substr(a["m"] + 1, F.length(text)).alias("text")))))


def _term(word: Column, least: int) -> Column:
    """Whether a word can be a term: of so many characters, or a name of two in a script that writes names so."""
    return (F.length(word) >= least) | ((F.length(word) >= 2) & word.rlike(SHORT))


def _told(docs: DataFrame, pairs: DataFrame, words: Column, generalise_at: float, remove_at: float, chance: float | None = None) -> DataFrame:
    """(kind, entity, term, gone) of the pairs (kind, entity, n_entity, term, both) whose share is high enough; words: those of a document.

    chance: see above; pairs then have tried, the words tried with the entity.
    """
    counts = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = F.lit(float(max(1, docs.count())))
    pmi, ic = F.log2(F.col("both") * n / (F.col("n_entity") * F.col("n_term"))), F.log2(n / F.col("n_entity"))
    told = pairs.join(counts, "term").where((ic > 0) & (pmi >= F.lit(generalise_at) * ic))
    if chance is not None:
        mean = F.col("n_entity") * F.col("n_term") / n
        log = F.log(F.col("tried")) + F.col("both") * (F.lit(1.0) + F.log(mean / F.col("both"))) - mean
        told = told.where((F.col("both") > mean) & (log <= F.lit(math.log(chance))))
    return told.select("kind", "entity", "term", (pmi >= F.lit(remove_at) * ic).alias("gone"))


def terms_of_documents(docs: DataFrame, found: DataFrame, text_col: str, least_letters: int, support: int, generalise_at: float, remove_at: float, chance: float | None = None) -> DataFrame:
    """revealing_terms with the reach of a whole document: all its words count, and go at all their places."""
    rows = found.where("text is not null").dropDuplicates(["key"])
    holders = rows.select("key", F.explode("spans").alias("e")).select("key", F.col("e.kind").alias("kind"), F.lower("e.value").alias("entity")).distinct()
    entities = holders.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)  # a pair is in no more documents than its entity
    holders = written(holders.join(entities, ["kind", "entity"]), "holders")
    words = F.flatten(F.transform(gaps(F.col("text"), F.col("spans")), lambda g: F.regexp_extract_all(g["text"], F.lit(WORD), F.lit(0))))
    terms = F.array_distinct(F.transform(F.filter(words, lambda w: _term(w, least_letters)), F.lower))
    near = rows.join(holders.select("key").distinct(), "key", "left_semi").select("key", F.explode(terms).alias("term"))
    near = written(near, "near")
    if chance is not None:  # a pair's documents hold so many words, at most
        sizes = holders.join(near.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
        holders = written(holders.join(sizes.groupBy("kind", "entity").agg(F.sum("n").alias("tried")), ["kind", "entity"]), "holders")
    near = near.join(holders, "key")

    pairs = near.groupBy("kind", "entity", "n_entity", "term", *["tried"] * (chance is not None)).agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = _told(docs, pairs, F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower), generalise_at, remove_at, chance)
    flagged = near.join(told, ["kind", "entity", "term"]).groupBy("key", "term").agg(F.max("gone").alias("gone"))
    flagged = flagged.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("told"))  # a document's own terms

    def value(word: Column) -> Column:
        gone = F.element_at(F.col("told"), F.lower(word))
        return F.when(gone, F.lit("")).when(~gone, F.lit("~"))

    def placed(gap: Column) -> Column:
        """The flagged words of a gap, placed in the text."""
        both = F.zip_with(F.split(gap["text"], WORD, -1), F.regexp_extract_all(gap["text"], F.lit(WORD), F.lit(0)), lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("w")))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + x["gap"]
            e = s + F.length(x["w"])
            one = F.array(F.struct(s.alias("start"), F.lit(4).alias("kind"), e.alias("end"), value(x["w"]).alias("value")))
            return F.struct(e.alias("at"), F.when(F.map_contains_key(F.col("told"), F.lower(x["w"])), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.filter(both, lambda x: x["w"].isNotNull()), F.struct(gap["at"].alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])

    spans = F.flatten(F.transform(gaps(F.col("text"), F.col("spans")), placed))
    return rows.join(flagged, "key").select("key", F.array_sort(spans).cast(SPAN).alias("terms"))


def revealing_terms(
    docs: DataFrame, found: DataFrame, text_col: str = "text", reach: int | None = 60, least_letters: int = 3, support: int = 2, generalise_at: float = 0.7, remove_at: float = 0.9, chance: float | None = None
) -> DataFrame:
    """(key, terms): for rows with any, the spans of terms to generalise (value `~`) or remove (value empty)."""
    if reach is None:
        return terms_of_documents(docs, found, text_col, least_letters, support, generalise_at, remove_at, chance)
    if chance is not None:
        limits = (least_letters, support, generalise_at, remove_at)
        close = revealing_terms(docs, found, text_col, reach, *limits)
        both = close.join(terms_of_documents(docs, found, text_col, *limits, chance).withColumnRenamed("terms", "far"), "key", "full")
        none = F.array().cast(SPAN)
        both = both.select("key", F.array_sort(F.concat(F.coalesce("terms", none), F.coalesce("far", none))).alias("terms"))
        # a word found twice goes if either says so: an empty value sorts first
        return both.select("key", F.filter("terms", lambda x, i: (i == 0) | (x["start"] != F.get(F.col("terms"), i - 1)["start"])).alias("terms"))
    rows = found.where("text is not null").dropDuplicates(["key"])
    near = rows.select("key", F.explode(contexts(F.col("text"), F.col("spans"), reach)).alias("c"))

    def words(side: Column) -> Column:
        """Whole words of one side, placed in the text; a word at a place where the side was cut off is left out."""
        found = F.filter(located(side["text"], WORD, 4, F.lit(True)), lambda x: (F.length(x["value"]) >= least_letters) & (x["start"] != side["cut_front"]) & (x["end"] != side["cut_end"]))
        return F.transform(found, lambda x: F.struct((x["start"] + side["at"]).alias("start"), (x["end"] + side["at"]).alias("end"), F.lower(x["value"]).alias("term")))

    near = near.select("key", "c.kind", "c.entity", F.explode(F.concat(words(F.col("c.left")), words(F.col("c.right")))).alias("t"))
    near = written(near.select("key", "kind", "entity", "t.start", "t.end", "t.term"), "near")

    pairs = near.select("key", "kind", "entity", "term").distinct().groupBy("kind", "entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    entities = rows.select("key", F.explode("spans").alias("e")).select("key", F.col("e.kind").alias("kind"), F.lower("e.value").alias("entity")).distinct().groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_entity"))
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    told = _told(docs, pairs.join(entities, ["kind", "entity"]), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), generalise_at, remove_at)
    spans = near.join(told, ["kind", "entity", "term"]).groupBy("key", "start", "end").agg(F.max("gone").alias("gone"))
    one = F.struct(F.col("start"), F.lit(4).alias("kind"), F.col("end"), F.when(F.col("gone"), F.lit("")).otherwise(F.lit("~")).alias("value"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(one)).cast(SPAN).alias("terms"))  # a document's own terms


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind, generalised terms by <TERM>, removed ones gone; of overlapping spans the first."""
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        put = F.when((x["kind"] == 4) & (x["value"] == ""), F.lit("")).otherwise(kinds[x["kind"]])
        inside = x["start"] < a["at"]
        return F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], text.substr(a["at"] + 1, x["start"] - a["at"]), put)).alias("out"),
        )

    return F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind


def find_disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, sanitised (null where nothing was found)."""
    found = written(found_in(docs, id_col, text_col), "spans")
    terms = revealing_terms(docs, found, text_col, **thresholds)
    rows = found.join(terms, "key", "left").withColumn("all", F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(SPAN)))))
    n = [F.size(F.filter("all", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *n, F.sha2(span_list(F.col("spans")).cast("binary"), 256).alias("base_sha256"), span_list(F.col("all")).alias("spans"), sanitised(F.col("text"), F.col("all")).alias("sanitised"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs, its columns unchanged, with the texts sanitised; texts without spans do not travel."""
    found = written(found_in(docs, id_col, text_col), "spans")
    terms = revealing_terms(docs, found, text_col, **thresholds).join(found.where("text is not null").select("key", "spans").dropDuplicates(["key"]), "key", "right")
    terms = terms.select("key", F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(SPAN)))).alias("all"))
    text, names = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.columns
    inner = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.xxhash64(F.col(id_col), text).alias("key"), F.size(base_spans(text)).alias("n"))
    clean = inner.where("n = 0").select("row.*")
    dirty = inner.where("n > 0").join(terms, "key").select(*(sanitised(F.col(f"row.`{c}`").cast("string"), F.col("all")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names))
    return clean.unionByName(dirty)
