"""Files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze


def latest_file(paths: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """path: the file whose name has the latest date between prefix and suffix."""
    name = F.element_at(F.split("path", "/"), -1)
    day = F.try_to_timestamp(F.regexp_extract(name, rf"^\Q{prefix}\E(\d{{4}}-\d{{2}}-\d{{2}})\Q{suffix}\E$", 1), F.lit("yyyy-MM-dd"))
    return paths.select("path", day.alias("day")).where("day IS NOT NULL").agg(F.max_by("path", "day").alias("path"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, length of the files in a folder, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def resume_page(paths: DataFrame) -> DataFrame:
    """page: the largest page number in file names, 0 if there is none."""
    return paths.agg(F.coalesce(F.max(F.regexp_extract("path", r"_(\d+)\.csv$", 1).try_cast("int")), F.lit(0)).alias("page"))


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem) and text of the `.txt` files of a folder."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def not_done(rows: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def retrieval_rows(rows: DataFrame) -> DataFrame:
    """query, positive, negatives, trimmed and without blanks."""
    trimmed = rows.select(F.trim("query").alias("query"), F.trim("positive").alias("positive"), F.filter(F.transform(F.coalesce("negatives", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "").alias("negatives"))
    return trimmed.where("query <> '' AND positive <> ''")


def xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def xml_text(xml: Column) -> Column:
    """All text of an XML document."""
    return squeeze(F.regexp_replace(F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->", " "), r"<[^>]*>", " "))


def xml_json(xml: Column, schema: str) -> Column:
    """An XML document as JSON of the schema's fields; null where it doesn't parse."""
    return F.to_json(F.from_xml(xml, schema))


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """All rows as CSV, JSON lines or Parquet. An empty table is an error, as in the catalogue's downloads. CSV doubles quotes and keeps spaces, as `ingest.read_csv` reads it."""
    if df.isEmpty():
        raise LookupError("nothing to export")
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if kind == "csv" else writer.format(kind).save(path)


def flatten(df: DataFrame, separator: str = "_", depth: int = 2) -> DataFrame:
    """Nested fields as columns, to a depth."""
    from pyspark.sql import types as T

    for _ in range(depth):
        columns = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{separator}{g.name}") for g in f.dataType]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df


def row_json(df: DataFrame) -> DataFrame:
    """`json`: each row with ISO times and all other values as texts."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))).alias("json"))
