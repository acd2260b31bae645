"""Personal data, found by patterns and sanitised by information content.

E-mail addresses, IP addresses, card and phone numbers are protected entities. A term in a document that holds one reveals
it as far as seeing the term tells which entity stands there: their pointwise mutual information, from document counts over
the whole corpus, against the entity's own information. In every document that holds the entity, all occurrences of a term
that reveals nearly all are removed, those of one that reveals less are generalised to its first letter; what lies below the
disclosure threshold stays. Documents without entities are left as they are.

All counts are of different texts: a group of equal texts counts once, so that copies are no evidence. Terms are runs of
letters outside e-mail addresses, compared in lower case; the other kinds of entity have no letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, let, materialize, pack, running

#: The kinds in order, and their patterns. Possessive groups and what stands before a run only keep Java's matcher from running long or deep; the matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must contain to have a match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Letters of a term at least, and shares of an entity's information from which a term is generalised or removed. For an entity of a single text the shares mean that a term stands in at most the fifth or the twentieth root of the number of texts.
LETTERS, GENERALISE, REMOVE = 3, 0.8, 0.95
TERM = rf"\p{{L}}{{{LETTERS},}}"
#: Characters of a piece in which a text is held to cut it at many places.
PIECE = 512

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
TERMS = "array<struct<start:int,end:int,kind:string>>"


def found(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """The matches of a pattern whose value passes ``keep``, leftmost and non-overlapping, as structs of start, end (code points) and value: the pieces between matches and the matches add up to the positions."""
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    steps = F.filter(steps, lambda x: x["value"].isNotNull())

    def spans(s: Column) -> Column:
        before = running(F.transform(s, lambda x: x["gap"] + x["size"]), lambda a, b: a + b, F.lit(0))
        each = F.zip_with(s, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))
        return F.filter(each, lambda x: keep(x["value"]))

    return let(steps, spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(a: Column, c: Column) -> Column:
        twice = c.cast("int") * (1 + a["i"] % 2)
        return F.struct((a["i"] + 1).alias("i"), (a["sum"] + twice - F.when(twice > 9, 9).otherwise(0)).alias("sum"))

    each = F.filter(F.split(F.reverse(digits), "", -1), lambda c: c != "")
    return F.aggregate(each, F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")), add, lambda a: a["sum"] % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid matches of all kinds, by start and then kind: structs of start, rank (of the kind), end, kind, value."""

    def of_kind(rank: int, kind: str) -> Column:
        as_span = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        spans = F.transform(found(text, KINDS[kind], lambda value: valid(kind, value)), as_span)
        may = F.instr(text, NEEDS[kind]) > 0 if kind in NEEDS else F.regexp_like(text, F.lit("[0-9]"))
        return F.when(may, spans).otherwise(F.array().cast(SPAN))

    return F.sort_array(F.concat(*(of_kind(rank, kind) for rank, kind in enumerate(KINDS))))


def without_addresses(text: Column) -> Column:
    """The text with a digit in the place of each character of an e-mail address: no address has a term, and positions stay."""
    filled = F.zip_with(F.split(text, EMAIL, -1), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda gap, m: F.concat(gap, F.repeat(F.lit("0"), F.coalesce(F.length(m), F.lit(0)))))
    return F.when(F.instr(text, "@") > 0, F.array_join(filled, "")).otherwise(text)


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text as hashes of the lower-cased words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(without_addresses(text), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def occurrences(text: Column, marks: Column) -> Column:
    """All occurrences of the marked terms (structs term, share) of a text, by start: structs of start, end, kind.

    Marks and words are sorted together, so that each word finds its mark by the last one before it.
    """
    at = lambda term, rank, share, start, end: F.struct(term.alias("term"), F.lit(rank).alias("rank"), share.alias("share"), start.alias("start"), end.alias("end"))
    words = F.transform(found(without_addresses(text), TERM), lambda w: at(F.xxhash64(F.lower(w["value"])), 1, F.lit(None).cast("double"), w["start"], w["end"]))
    ordered = F.sort_array(F.concat(F.transform(marks, lambda m: at(m["term"], 0, m["share"], F.lit(0), F.lit(0))), words))

    def hits(rows: Column) -> Column:
        own = F.transform(rows, lambda x: F.when(x["rank"] == 0, F.struct(x["term"].alias("term"), x["share"].alias("share"))))
        last = running(own, lambda a, b: F.coalesce(b, a), F.lit(None).cast("struct<term:bigint,share:double>"))
        kind = lambda share: F.when(share >= REMOVE, "removed").otherwise("general")
        return F.zip_with(rows, last, lambda x, m: F.when((x["rank"] == 1) & (x["term"] == m["term"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), kind(m["share"]).alias("kind"))))

    return F.sort_array(F.filter(let(ordered, hits), lambda x: x.isNotNull()))


#: Keys of repeated texts that are sent to all tasks, 16 MB or so; more of them are joined by a shuffle.
SENT_KEYS = 200_000


def different_texts(rows: DataFrame) -> tuple[DataFrame, int]:
    """key, terms, entities of each of the different texts of ``rows``, and their number. Only repeated texts are shuffled, each but once from a task."""
    repeated = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    keys, more = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    side = F.broadcast(repeated.select("key")) if keys <= SENT_KEYS else repeated.select("key")
    narrow = rows.select("key", "terms", "entities")
    once = narrow.join(side, "key", "left_semi").groupBy("key").agg(F.first("terms").alias("terms"), F.first("entities").alias("entities"))
    return narrow.join(side, "key", "left_anti").unionByName(once), rows.count() - more


def disclosing(texts: DataFrame, total: float) -> DataFrame:
    """key, marks (structs term, share) for each of the different ``texts`` (key, terms, entities) with terms that exceed the disclosure threshold for one of its entities; ``total`` is their number.

    share = log2(N * both / (df(entity) * df(term))) / log2(N / df(entity)), with counts over all texts. An entity of a
    single text has every term of that text with it, so that only the others' pairs with terms are made and counted; the
    single ones of a text go as one, and so do those that stand in the same texts, since they have the same shares: sets of
    texts are told apart by their number and 128 bits of hashes. Terms that are too frequent for any share above the threshold are left out first.
    """
    held = materialize(texts.where(F.size("entities") > 0), "held")
    owners = held.select("key", F.explode("entities").alias("entity"))
    # the texts of an entity, as a set
    alike = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    counted = owners.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"), *alike)
    often = float(counted.agg(F.max("of_entity")).first()[0] or 0)
    most = total ** (1 - GENERALISE) * often**GENERALISE * (1 + 1e-9)
    terms = materialize(texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("of_term")).where(F.col("of_term") <= most), "terms")
    shared = materialize(counted.where("of_entity > 1").select("entity", "of_entity", F.struct("of_entity", "h1", "h2").alias("group")), "entities")
    known = owners.join(shared, "entity", "left")
    single = known.where("of_entity IS NULL").select("key").distinct()
    several = known.where("of_entity IS NOT NULL").select("key", "group").distinct()

    def share(both: Column, of_entity: Column) -> Column:
        own = F.log2(F.lit(total) / of_entity)
        return F.when(own > 0, F.log2(F.lit(total) * both / (of_entity * F.col("of_term"))) / own)

    one = F.lit(1.0)
    alone = held.join(single, "key", "left_semi").select("key", F.explode("terms").alias("term")).join(terms, "term").select("key", "term", share(one, one).alias("share"))
    pairs = several.join(held.select("key", "terms"), "key").select("key", "group", F.explode("terms").alias("term"))
    both = pairs.groupBy("group", "term").agg(F.count(F.lit(1)).alias("both"))
    rated = both.join(terms, "term").select("group", "term", share(F.col("both"), F.col("group.of_entity")).alias("share")).where(F.col("share") >= GENERALISE)
    rows = alone.where(F.col("share") >= GENERALISE).unionByName(pairs.join(rated, ["group", "term"]).select("key", "term", "share"))
    rows = rows.groupBy("key", "term").agg(F.max("share").alias("share"))
    marks = materialize(rows.groupBy("key").agg(F.collect_list(F.struct("term", "share")).alias("marks")), "marks")
    discard(terms, shared, held)
    return marks


def find_personal(docs: DataFrame, *columns: str) -> DataFrame:
    """For each of ``docs`` (text and others): its ``columns`` (all, if none are named) as the struct `row`, and base and terms, arrays of spans.

    ``base`` has start, rank, end, kind, value; ``terms`` start, end, kind (`general` or `removed`), by start. Both are empty
    for null and empty texts. Equal texts get equal spans and count as one; an empty table gives no rows. A text of any
    length or number of entities is read whole, in time that grows little faster than it, as long as its entities stand in
    few different sets of texts. Patterns are searched once, where
    rows are read; then only hashes of terms are shuffled, and the texts with entities to their marks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pack(docs, *columns, key=F.md5(text), text=text).withColumn("base", base_spans(F.col("text")))
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    rows = materialize(rows.select("row", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"), entities.alias("entities"), term_hashes(F.col("text")).alias("terms")), "spans")
    texts, total = different_texts(rows)
    marks = disclosing(texts, float(total))
    none = F.array().cast(TERMS)
    held = rows.where("text IS NOT NULL").select("row", "key", "base", "text").join(marks, "key", "left")
    held = held.select("row", "base", F.when(F.col("marks").isNotNull(), occurrences(F.col("text"), F.col("marks"))).otherwise(none).alias("terms"))
    return rows.where("text IS NULL").select("row", "base", none.alias("terms")).unionByName(held)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def replaced(text: Column, base: Column, terms: Column) -> Column:
    """The text with its entities as their kind in brackets, removed terms as `[removed]` and general terms as their first letter and an ellipsis. Of overlapping spans the first is replaced and the rest of the others goes with it."""
    every = F.sort_array(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
    ))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        begin = lambda i: F.greatest(a - i * PIECE, F.lit(0))
        cut = lambda i: F.substr(F.get(pieces, i), begin(i) + 1, F.least(b - i * PIECE, F.lit(PIECE)) - begin(i))
        touched = F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int"))
        return F.when(b > a, F.array_join(F.transform(touched, cut), "")).otherwise("")

    def change(pieces: Column) -> Column:
        def mark(s: Column, at: Column) -> Column:
            general = F.concat(between(pieces, s["start"], s["start"] + 1), F.lit("…"))
            return F.when(s["start"] < at, "").when(s["kind"] == "general", general).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

        def out(spans: Column) -> Column:
            reach = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
            parts = F.zip_with(spans, reach, lambda s, at: F.array(between(pieces, at, s["start"]), mark(s, at)))
            return F.concat(F.array_join(F.flatten(parts), ""), between(pieces, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

        return let(every, out)

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), change)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` (text and others) without personal data and the terms that disclose it. n_chars, if there, follows the text; a null text, a text without entities and all other columns stay; rows that repeat are changed alike."""
    rows = find_personal(docs)
    clean = F.when(F.size("base") > 0, replaced(F.col("row.text"), F.col("base"), F.col("terms"))).otherwise(F.col("row.text"))
    rows = rows.select("row", clean.alias("__clean"))
    kept = {"text": F.col("__clean"), "n_chars": F.coalesce(F.length("__clean").cast("long"), F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("__clean")}
    return rows.select(*(kept[c].alias(c) if c in kept else F.col(f"row.`{c}`") for c in docs.columns))


def op1_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts and digest of every document's base spans, all its spans, and the number of terms."""
    out = find_personal(docs, "doc_id").select("row.doc_id", "base", "terms")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    ranked = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))),
    )
    return out.select("doc_id", *map(count, KINDS), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.sort_array(ranked)).alias("spans"), F.size("terms").cast("long").alias("n_terms"))
