"""From source files to one table: renaming, deduplication, types, regions and open-access data."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import normalise_doi
from ..functions.numbers import typed
from .numbering import with_places

#: The sources in order of precedence, and the columns that each has under another name.
SOURCES = ("Cochrane", "Medline", "LOVE", "OVID")
COMMON = ("id", "verification_id", "title", "authors", "doi", "source", "cleaned_doi", "created_at")
RENAMES = {
    "Cochrane": {"cd_identifier": "verification_id", "modified_date": "date", "result_stage": "publication_type"},
    "Medline": {"pmid": "verification_id", "publication_date": "date"},
    "LOVE": {"id": "verification_id", "classification": "publication_type", "countries": "country"},
    "OVID": {"publication_accession_number": "verification_id", "date_delivered": "date", "emtree_headings": "keywords"},
}
UNKNOWN_REGION = "Unknown"


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files as texts, quoted line breaks and all; a row's place is not kept. A blank cell is null, a quoted one without characters an empty text: the reader makes null of any text that equals its word for null, so that this is one that no file has."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, nullValue=uuid.uuid4().hex, emptyValue="")


def read_with_order(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with `row_idx`, its rows' order: files in order of their paths, then rows as they stand."""
    rows = read_csv(spark, path).select("*", F.col("_metadata.file_path").alias("__path"), F.monotonically_increasing_id().alias("__at"))
    names = [c for c in rows.columns if c not in ("__path", "__at")]
    return rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("__path").orderBy("__at"))).select(*names, F.col("__path").alias("path"), "row_idx")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rename(df: DataFrame, names: dict[str, str], common: tuple[str, ...] = COMMON) -> DataFrame:
    """Columns under their common names; others than those and the renamed are dropped."""
    return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns if c in names or c in common))


def sequence_ids(df: DataFrame, source: str, order: str) -> DataFrame:
    """`id`: the source and a number from 1 in each source. A source of any size is numbered in ranges of the order."""
    placed = with_places(df.drop("id"), order, (source,), "__place")
    return placed.withColumn("id", F.concat_ws("_", source, F.col("__place") + 1)).drop("__place")


def first_seen(df: DataFrame, key: Column, order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in the given order, and the others. Rows with a blank key are all first.

    Blank keys are told apart before the window, so that they don't meet in one task.
    """
    rows = df.withColumn("__key", F.coalesce(key, F.lit("")))
    ranked = rows.where("__key <> ''").withColumn("__rank", F.row_number().over(Window.partitionBy("__key").orderBy(*order)))
    firsts = ranked.where("__rank = 1").drop("__rank").unionByName(rows.where("__key = ''"))
    return firsts.drop("__key"), ranked.where("__rank > 1").drop("__rank", "__key")


def unify(frames: dict[str, DataFrame], order: tuple[str, ...] = SOURCES, renames: dict[str, dict[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of all sources (each with `row_idx`) under common names, and the later ones of equal DOIs."""
    renames = RENAMES if renames is None else renames
    parts = []
    for i, name in enumerate(n for n in order if n in frames):
        part = frames[name]
        kept = {c: c for c in part.columns if c not in COMMON} | renames.get(name, {})
        parts.append(rename(part, kept).withColumns({"source": F.lit(name), "__source": F.lit(i)}))
    rows = union_by_name(parts).withColumn("cleaned_doi", normalise_doi(F.col("doi")))
    rows = sequence_ids(rows, "source", "row_idx")
    unique, later = first_seen(rows, F.col("cleaned_doi"), ["__source", "row_idx"])
    return unique.drop("__source"), later.drop("__source")


def duplicated(df: DataFrame, column: str) -> DataFrame:
    """All rows whose value of a column, not blank, occurs more than once. Values are counted first, so that no window has to hold all rows of one."""
    many = df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(many, column, "left_semi")


def infer_types(df: DataFrame) -> T.StructType:
    """Types of text columns by all their values: int, long or double if every filled one parses, else string; blank columns stay text."""
    exprs = []
    for name in df.columns:
        c = F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))
        on = lambda x, c=c: F.when(c.isNotNull(), x)
        exprs.append(F.struct(F.count(c).alias("n"), F.bool_and(on(c.try_cast("int").isNotNull())).alias("i"), F.bool_and(on(c.try_cast("long").isNotNull())).alias("l"), F.bool_and(on(c.try_cast("double").isNotNull())).alias("d")).alias(name))
    found = df.agg(*exprs).first()
    kind = lambda r: T.StringType() if not r["n"] else T.IntegerType() if r["i"] else T.LongType() if r["l"] else T.DoubleType() if r["d"] else T.StringType()
    return T.StructType([T.StructField(c, T.StringType() if c == "verification_id" else kind(found[c])) for c in df.columns])


def clean_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the schema's types; what doesn't parse is null."""
    kinds = {f.name: f.dataType for f in schema}
    return df.select(*(typed(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))


#: Names of countries that the region table has under another one.
COUNTRY_ALIASES = {"usa": "United States", "us": "United States", "uk": "United Kingdom", "england": "United Kingdom", "south korea": "Korea", "russia": "Russian Federation", "viet nam": "Vietnam", "iran": "Iran, Islamic Republic of", "uae": "United Arab Emirates"}


def with_region(df: DataFrame, regions: DataFrame, country: str = "country", aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the `region` of its country, `Unknown` where the table (country, region) has none. Names are compared without regard to case. The table has a row a country, which bounds it; Spark still decides by its size whether to broadcast it."""
    aliases = COUNTRY_ALIASES if aliases is None else aliases
    table = F.create_map(*(F.lit(x.lower()) for kv in aliases.items() for x in kv)) if aliases else None
    name = F.lower(F.trim(country))
    name = F.coalesce(table[name], name) if table is not None else name
    dim = regions.select(F.lower(F.trim("country")).alias("__country"), F.col("region").alias("__region")).dropDuplicates(["__country"])
    joined = df.join(dim, name == F.col("__country"), "left").withColumn("region", F.coalesce("__region", F.lit(UNKNOWN_REGION)))
    return joined.drop("__country", "__region")


def best_of(df: DataFrame, key: str, sources: list[DataFrame], fields: list[str]) -> DataFrame:
    """``df`` with each field from the first of the sources (key and fields) that has it."""
    for i, s in enumerate(sources):
        df = df.join(s.select(key, *(F.col(f).alias(f"__{i}_{f}") for f in fields)), key, "left")
    every = [f"__{i}_{f}" for i in range(len(sources)) for f in fields]
    return df.withColumns({f: F.coalesce(*(F.col(f"__{i}_{f}") for i in range(len(sources)))) for f in fields}).drop(*every)


def enrich_missing(df: DataFrame, metadata: DataFrame, key: str = "doi", field: str = "language") -> tuple[DataFrame, DataFrame]:
    """Rows without ``field`` get the metadata's columns; and the keys that the metadata lacks."""
    names = [c for c in metadata.columns if c != key]
    todo, done = df.where(F.col(field).isNull()), df.where(F.col(field).isNotNull())
    filled = todo.drop(*names).join(metadata, key, "left")
    return done.unionByName(filled, allowMissingColumns=True), todo.join(metadata, key, "left_anti").select(key)


def first_of(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns from the first filled of several that may be there: cross-source mapping."""
    blank_null = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    return df.select(*(F.coalesce(*(blank_null(c) for c in cs if c in df.columns), F.lit(None).cast("string")).alias(k) for k, cs in names.items()))


def is_systematic_review(types: Column, title: Column, abstract: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, abstract))
    kinds = F.lower(F.coalesce(types, F.lit("")))
    return kinds.contains("systematic review") | kinds.contains("meta-analysis") | (text.contains("systematic") & text.contains("review"))


def is_english(language: Column) -> Column:
    return F.coalesce(language.rlike(r"(?i)\beng(lish)?\b"), F.lit(False))


def unprocessed(df: DataFrame, field: str = "open_access", key: str = "doi") -> DataFrame:
    return df.where((F.col(field).isNull() | (F.trim(field) == "")) & F.col(key).isNotNull())


def assemble_medline(records: DataFrame, order: str, english_only: bool = True, reviews_only: bool = True, open_only: bool = False) -> DataFrame:
    """MEDLINE fields (PMID, TI, AB, DP, JT, PL texts; AU, LA, MH, PT, AID arrays; is_oa, best_oa_url) as the catalogue's columns.

    Arrays are joined by `; `, of AID only DOIs are kept, missing fields are empty texts. Of records with one PMID (those
    without one have the empty one) the first by ``order`` stays, before records are filtered by language, kind and access.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ")
    tokens = F.transform(F.coalesce("AID", F.array().cast("array<string>")), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1))
    made = {
        "pmid": text("PMID"), "title": text("TI"), "abstract": text("AB"), "authors": joined("AU"), "publication_date": text("DP"), "journal": text("JT"),
        "country": text("PL"), "language": joined("LA"), "mesh_terms": joined("MH"), "publication_type": joined("PT"),
        "doi": F.array_join(F.filter(tokens, lambda x: x.startswith("10.")), "; "), "is_oa": F.coalesce("is_oa", F.lit(False)), "best_oa_url": F.col("best_oa_url"),
    }
    rows = records.select(F.col(order).alias("__order"), *(c.alias(k) for k, c in made.items()))
    first = rows.groupBy("pmid").agg(F.min_by(F.struct(*(k for k in made if k != "pmid")), "__order").alias("r")).select("pmid", "r.*")
    first = first.where(is_english(F.col("language"))) if english_only else first
    first = first.where(is_systematic_review(F.col("publication_type"), F.col("title"), F.col("abstract"))) if reviews_only else first
    return first.where("is_oa") if open_only else first
