"""Annotated spans: arrays of structs start, end, label (end exclusive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cutting, matches, once
from ..functions.text import replace_items

SPANS = "array<struct<start:int,end:int,label:string>>"


def _keep(spans: Column, accept) -> Column:
    """The spans that are accepted one after another, given those accepted before."""
    step = lambda kept, s: F.when(accept(kept, s), F.concat(kept, F.array(s))).otherwise(kept)
    return F.aggregate(spans, F.array().cast(SPANS), step)


def dedupe(spans: Column) -> Column:
    return F.array_distinct(spans)


def keep_first(spans: Column) -> Column:
    """From left to right, spans that begin before the last kept one ends are dropped; at one start the longer is first."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    return _keep(F.array_sort(spans, order), lambda kept, s: F.coalesce(F.get(kept, F.size(kept) - 1)["end"] <= s["start"], F.lit(True)))


def keep_longest(spans: Column) -> Column:
    """Longest first (of equals the leftmost), accepted if disjoint from all accepted; in order of start."""
    size = lambda s: s["end"] - s["start"]
    order = lambda a, b: F.when(size(a) != size(b), size(b) - size(a)).when(a["start"] != b["start"], a["start"] - b["start"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    return F.sort_array(_keep(F.array_sort(spans, order), lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))))


def cap_repeats(rows: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each key, in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__n") <= cap).drop("__n")


def limit_shuffled(rows: DataFrame, keys: list[str], unique: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each key, chosen by a hash."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), unique)), F.col(unique)]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def regex_spans(text: Column, rules: dict[str, str]) -> Column:
    """Spans of all matches of each label's pattern: the gaps between matches and the matches add up to the positions."""

    def of_label(label: str, pattern: str) -> Column:
        return F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label")))

    return F.sort_array(F.concat(*(of_label(k, v) for k, v in rules.items())))


def pattern_bag(text: Column, pattern: str, acronyms: dict[str, str] | None = None, width: int = 100) -> Column:
    """A struct of a pattern's matches in a text: tags (each once, in order, comma-joined), acronyms (the tags with short forms in their places), bag (a JSON list of all matches with ``width`` characters before and after). A null text gives nulls, one without matches empty texts and an empty list."""
    cut = lambda a, b: F.substr(text, a + 1, b - a)
    item = lambda s: F.struct(cut(s["start"], s["end"]).alias("Matched Content"), cut(F.greatest(s["start"] - width, F.lit(0)), s["start"]).alias("Text Before"), F.substr(text, s["end"] + 1, F.lit(width)).alias("Text After"))
    bag = F.transform(regex_spans(text, {"": pattern}), item)
    tags = F.array_join(F.array_distinct(F.transform(bag, lambda x: x["Matched Content"])), ", ")
    return F.struct(tags.alias("tags"), replace_items(tags, acronyms or {}).alias("acronyms"), F.to_json(bag).alias("bag"))


def with_bags(df: DataFrame, text: str, patterns: dict[str, str], acronyms: dict[str, dict[str, str]] | None = None, width: int = 100) -> DataFrame:
    """``df`` with columns name_tags and name_bag of each pattern, and name_acronyms of those that have ``acronyms``: derived columns stand in their own rows, so that nothing is joined by position. Columns with these names are replaced."""
    acronyms = acronyms or {}
    for name, pattern in patterns.items():
        found = pattern_bag(F.col(text), pattern, acronyms.get(name), width)
        fields = ("tags", "acronyms", "bag") if name in acronyms else ("tags", "bag")
        df = df.withColumns({f"{name}_{f}": found[f] for f in fields})
    return df


def chunks(text: Column, size: int = 4000, overlap: int = 400) -> Column:
    """Structs start, end, text of pieces that overlap."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, F.length(text)).alias("end"), F.substr(text, s + 1, F.lit(size)).alias("text")))


def line_chunks(text: Column, size: int = 4000, overlap: int = 400, within: int = 1500) -> Column:
    """Structs start, end, text of pieces that overlap; a piece but the last ends before the last line feed among its last ``within`` characters, if there is one.

    ``size`` must be over ``within`` + ``overlap``, so that each piece goes on. A null text gives null, an empty one one empty piece.
    """
    if size <= within + overlap:
        raise ValueError("size must be over within + overlap")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def pieces(cut, n: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            last = a["at"] + size >= n
            back = F.instr(F.reverse(cut(a["at"] + size - within + 1, a["at"] + size)), "\n")
            end = F.when(last, n).otherwise(a["at"] + size - back)
            went = F.struct((end - overlap).alias("at"), last.alias("done"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end")))).alias("out"))
            return F.when(a["done"], a).otherwise(went)

        most = F.floor(n / F.lit(size - within - overlap)).cast("int") + 1
        ends = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["out"])
        return F.transform(ends, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), cut(p["start"], p["end"]).alias("text")))

    return F.when(text.isNotNull(), once(F.length(text), lambda n: cutting(text, lambda cut: pieces(cut, n))))


def windows(items: Column, size: int = 256, stride: int = 128) -> Column:
    """Slices of an array, ``stride`` apart."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(stride))
    return F.transform(F.filter(starts, lambda s: (s == 0) | (s + size - stride < F.size(items))), lambda s: F.slice(items, s + 1, size))


def best_occurrence(text: Column, phrase: Column, hints: list[str], around: int = 90) -> Column:
    """The start (from 0) of the occurrence of a phrase with the most hint words near it, the first of equals; null if there is none."""
    found = F.transform(matches(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(phrase), F.lit(r"\E"))), lambda m: m["start"])

    def scored(cut) -> Column:
        near = lambda s: F.lower(cut(F.greatest(s - around, F.lit(0)), s + F.length(phrase) + around))
        hits = lambda text: sum((text.contains(h.lower()).cast("int") for h in hints), F.lit(0))
        return F.array_max(F.transform(found, lambda s: F.struct(once(near(s), hits).alias("hits"), (-s).alias("at"))))

    return -cutting(text, scored)["at"]


def bio_tags(tokens: Column, spans: Column) -> Column:
    """B-, I- and O labels of tokens (structs start, end) by the spans that they begin in."""

    def tag(t: Column) -> Column:
        own = F.get(F.filter(spans, lambda s: (t["start"] >= s["start"]) & (t["start"] < s["end"])), F.lit(0))
        return F.when(own.isNull(), "O").when(t["start"] == own["start"], F.concat(F.lit("B-"), own["label"])).otherwise(F.concat(F.lit("I-"), own["label"]))

    return F.transform(tokens, tag)


def apply_decisions(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, label) by decisions (the same keys, decision, new_label): KEEP and unknown words keep, DROP drops, RELABEL renames; spans without a decision are dropped."""
    met = spans.join(decisions, ["doc_id", "start", "end", "label"])
    word = F.upper("decision")
    return met.where(word != "DROP").select("doc_id", "start", "end", F.when(word == "RELABEL", F.coalesce("new_label", "label")).otherwise(F.col("label")).alias("label"))


def entity_metrics(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1 of found entities, those with equal keys being the same."""
    g, p = gold.select(*keys).distinct(), found.select(*keys).distinct()
    counts = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), keys, "full").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("both"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = counts.select(ratio(F.col("both"), F.col("p")).alias("precision"), ratio(F.col("both"), F.col("g")).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def group_entities(rows: DataFrame, key: str) -> DataFrame:
    """key, label, entities: `text (confidence: 0.1234)` by falling score."""
    entry = F.struct((-F.col("score")).alias("s"), F.format_string("%s (confidence: %.4f)", "text", "score").alias("x"))
    return rows.groupBy(key, F.concat("label", F.lit("_bert")).alias("label")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]), ", ").alias("entities"))
