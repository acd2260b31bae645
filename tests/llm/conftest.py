"""Small tables for the training-data operators: the smallest test folder, and one with every odd case."""

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil a large kettle of soup. "
ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "12 34",
    "Ünïcode WORDS; ½ and 日本語 text 😀 here",
    PROSE * 3,
    PROSE * 3,
    PROSE * 3 + "more",
    PROSE * 2000,
    "x" * 70_000,
    "9" * 30_000 + " +" + "1 " * 9_000 + "@." * 5_000,
    "a.b@c.d.e%f@g.hi 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111-1111 1111 and 4111111111111112 +1 (212) 555-01.23 +1234",
    "under the GNU General Public-License or Apache license, cc by and the MIT license. gnu general public license",
    "line one is here.\nline one is here.\n\nHome | About | Contact | Login\nfive words stand in here five words stand in here\r",
    "<|endoftext|>'ll don't   spaces   end\x00\x85",
]


def plain_documents():
    con = duckdb.connect()
    return con.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd_rows():
    """Texts of all kinds, null and repeated ids, null languages and sources."""
    ids = [*range(1, len(ODD_TEXTS) + 1)]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["b", None, "a", ""][i % 4], len(t) if t else None) for i, t in zip(ids, ODD_TEXTS)]
    return [*rows, rows[5], (None, "a text without an id, written by bob@example.org.", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows():
    return plain_documents()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def table(df, *columns):
    """The rows of a result as sorted tuples; null ids come last."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def in_order(values):
    return sorted(values, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
