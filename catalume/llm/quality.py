"""Quality rules, line first: punctuation, navigation and boilerplate rules drop lines; a document that loses too much text is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, pack, space_words

#: Words of a window, and base limits: fewest words, largest share of repeated words in hundredths.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A document is kept if its good lines hold at least this share of its words.
KEEP = 0.5
#: The end of a sentence, separators of navigation bars, symbols, and phrases of boilerplate lines (lower case).
ENDS = r"[.!?:;…。！？][\"'”’»)\]]*([ \t-\r]|\z)"
BARS = "[|›•·]"
SYMBOLS = "[#*$%&|<>]"
STOCK = (
    "javascript|enable cookies|cookie policy|use of cookies|uses cookies|accept all cookies|privacy policy|privacy notice|terms of use|terms of service|terms and conditions|"
    "all rights reserved|lorem ipsum|click here|read more|sign up|sign in|log in|log out|forgot your password|create an account|subscribe to our|our newsletter|"
    "add to cart|add to basket|checkout|skip to content|skip to main content|back to top|share on facebook|share on twitter|follow us|powered by|"
    "datenschutzerklärung|alle rechte vorbehalten|nutzungsbedingungen|hier klicken|mehr erfahren|in den warenkorb|zum inhalt springen|"
    "politique de confidentialité|tous droits réservés|mentions légales|cliquez ici|en savoir plus|ajouter au panier|"
    "política de privacidad|todos los derechos reservados|haga clic aquí|términos de uso|añadir al carrito|informativa sulla privacy|tutti i diritti riservati"
)
#: A stock phrase stands as whole words.
BOILERPLATE = rf"(^|[^\p{{L}}\p{{N}}])({STOCK})($|[^\p{{L}}\p{{N}}])"
#: Most symbols a hundred characters of a good line; bars that any line may have, and words for each bar of a line with more; most capitals in a hundred letters of a line with over 10 letters.
MOST_SYMBOLS, MOST_BARS, BAR_WORDS, MOST_CAPITALS = 5, 2, 10, 60
IN_WORDS = SPACES.replace("[", "[^")


def good_line(line: Column) -> Column:
    """Whether a line passes: a sentence ends in it (punctuation), has few bars for its words (navigation), few symbols and capitals and no stock phrase (boilerplate)."""
    letters, capitals = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    bars = F.regexp_count(line, F.lit(BARS))
    return (
        F.regexp_like(line, F.lit(ENDS))
        & ((bars <= MOST_BARS) | (bars * BAR_WORDS <= F.regexp_count(line, F.lit(IN_WORDS))))
        & (F.regexp_count(line, F.lit(SYMBOLS)) * 100 <= F.length(line) * MOST_SYMBOLS)
        & ~((letters > 10) & (capitals * 100 > letters * MOST_CAPITALS))
        & ~F.regexp_like(F.lower(line), F.lit(BOILERPLATE))
    )


def worded(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"[^ \t-\r]")))


def repeated_words(words: Column) -> Column:
    """The number of words that stand in windows of WINDOW words found twice or more in an array of words.

    Windows are compared by 64-bit hashes of their words' hashes. Only documents that have two equal windows sort them;
    a sorted window equals its neighbour if it is found twice; then the union of the windows' ranges is summed up.
    """

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - WINDOW
        at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<long>"))

    def covered(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        more = lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(starts, zero, more, lambda a: a["n"])

    def count(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(ordered, covered)).otherwise(0)

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count).cast("long")


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures and verdicts of its texts and ``clean_text``, the good lines (null text: empty).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words (words of dropped lines).
    Lines are what stands between line feeds; empty lines neither pass nor fail. A text without words fails the base.
    Every row is judged on its own, repeated rows alike, without a shuffle. Columns of ``df`` with these names are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept", "clean_text")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words_in = lambda x: F.regexp_count(x, F.lit(IN_WORDS))
    rows = pack(df, text=body, words=space_words(body), lines=worded(F.split(body, "\n", -1))).withColumn("good", F.filter("lines", good_line))
    rows = rows.select(
        *(F.col(f"row.`{c}`") for c in df.columns if c not in made),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        (F.size("words") - F.aggregate("good", F.lit(0), lambda a, x: a + words_in(x))).cast("long").alias("lost_words"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("lost_words") >= KEEP * F.col("n_words")))


def op5_quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The measures and verdict of every document."""
    out = clean_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


#: DuckDB SQL for `op5_quality`.
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t-\r]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
windows AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS five FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS t(k) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (len(words) - coalesce(list_sum(list_transform(list_filter(lines, lambda x:
            regexp_matches(x, '{ENDS.replace("'", "''")}')
            AND (len(regexp_extract_all(x, '{BARS}')) <= {MOST_BARS} OR len(regexp_extract_all(x, '{BARS}')) * {BAR_WORDS} <= len(regexp_extract_all(x, '[^ \t-\r]+')))
            AND len(regexp_extract_all(x, '{SYMBOLS}')) * 100 <= length(x) * {MOST_SYMBOLS}
            AND NOT (length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) > 10
                     AND length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) * 100 > length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) * {MOST_CAPITALS})
            AND NOT regexp_matches(lower(x), '{BOILERPLATE}')), lambda x: len(regexp_extract_all(x, '[^ \t-\r]+')))), 0))::BIGINT AS lost_words
  FROM w LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - lost_words >= {KEEP} * n_words AS kept FROM b
"""
