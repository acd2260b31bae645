"""Names of tables and what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    """DataFrames by name: Parquet tables of a folder, catalog tables, and frames put in by hand."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.frames = spark, folder, {}

    def put(self, name: str, df: DataFrame) -> Catalog:
        self.frames[name] = df
        return self

    def table(self, name: str) -> DataFrame:
        """By exact name, else without regard to case and underscores."""
        plain = lambda x: x.lower().replace("_", "")
        if name not in self.frames:
            found = next((k for k in self.frames if plain(k) == plain(name)), None)
            if found:
                return self.frames[found]
            if self.folder and name in TABLES:
                self.frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif self.spark.catalog.tableExists(name):
                return self.spark.table(name)
            else:
                raise LookupError(f"no table: {name}")
        return self.frames[name]

    def names(self) -> list[str]:
        return sorted({*self.frames, *(t.name for t in self.spark.catalog.listTables()), *(TABLES if self.folder else ())})

    def missing(self, names: list[str]) -> list[str]:
        return [n for n in names if n not in self.names()]

    def sql(self, text: str, **params) -> DataFrame:
        """SQL with named parameters over the catalog's frames."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=params)


def column_info(df: DataFrame) -> DataFrame:
    """name, type, nullable, position of each column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean, position int")


def header(df: DataFrame, hidden: tuple[str, ...] = ()) -> list[dict]:
    """What a table view needs of each column; hidden ones and `*_bag` are left out."""
    return [{"id": c, "text": c.replace("_", " ").title(), "value": c, "sortable": True} for c in df.columns if c not in hidden and not c.endswith("_bag")]


def records(cat: Catalog) -> DataFrame:
    """The paper catalogue's columns over the order tables: primary_id, year, source, database, journal, country, region, created_at, amount."""
    o, c = cat.table("orders"), cat.table("customer")
    n, r = cat.table("nation"), cat.table("region")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("o_orderkey").alias("primary_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("database"),
        F.col("c_mktsegment").alias("journal"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("amount"),
    )
