import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.functions import dates, identifiers, numbers, tags, text


@pytest.fixture(scope="module")
def on(spark):
    def run(values, f, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[1] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_doi(on):
    values = ["https://doi.org/10.1/A", "HTTP://dx.doi.org/10.1/a", "10.1/a", " ", None]
    assert on(values, identifiers.normalise_doi) == ["10.1/a", "10.1/a", "10.1/a", "", ""]
    assert on(["see 10.1000/xyz.1 now", "none"], identifiers.extract_doi) == ["10.1000/xyz.1", None]
    assert on(["/cdsr/doi/10.1002/14651858.CD001.pub3/full"], identifiers.doi_in_path) == ["10.1002/14651858.CD001"]
    assert on(["['10.1/x [doi]', 'pii [pii]']", "10.2/y"], identifiers.doi_list) == [["10.1/x"], ["10.2/y"]]
    assert on(["https://www.nature.com/x"], identifiers.host_label) == ["nature"]


def test_numbers(on):
    values = ["67", "1,240", "twenty-five", "two hundred and six", "hundred", "one thousand two", "abc"]
    assert on(values, numbers.to_int) == [67, 1240, 25, 206, 100, 1002, None]
    assert on([0, 13, 45, 100, 999, 12_345, 1_000_000], numbers.int_to_words, "int")[:6] == ["zero", "thirteen", "forty-five", "one hundred", "nine hundred ninety-nine", "twelve thousand three hundred forty-five"]
    assert on(["2012", "2012.0", "2010", " 2011 ", "", "n/a", None], numbers.from_year) == [True, True, False, True, False, False, False]
    assert on(["5", "5.0", "x", ""], lambda c: numbers.typed(c, T.IntegerType())) == [5, 5, None, None]
    assert on(["2014 Mar", "2013.0", "x"], numbers.year_of) == [2014, 2013, None]


def test_dates(on):
    values = ["March 2024", "3 August 2016", "August 3rd, 2016", "2015-07-01", "not a date"]
    assert [str(d) if d else None for d in on(values, dates.parse_date)] == ["2024-03-01", "2016-08-03", "2016-08-03", "2015-07-01", None]
    assert on(["searched in May 2013 and then March 3rd, 2014."], lambda c: dates.latest_of(dates.date_mentions(c))) == ["March 3rd, 2014"]
    assert on(["Aug", "x"], dates.month_number) == [8, 1]


def test_cells(on):
    cells = ["influenza:infl", "pregnant:pw, pregnant women:pw", "HPV:hpv; Human papillomavirus:hpv", "{'Africa': True, 'Asia': False}", "", None]
    assert on(cells, tags.cell_codes) == [["infl"], ["pw"], ["hpv"], ["Africa"], [], []]
    assert on(["x:12", "x:averylongcode", "x:ok"], tags.facet_codes) == [[], [], ["ok"]]


def test_clean(on):
    assert on(["('English',)", '["France"]', "'en'", "[]", "None", "English,French", "2000"], text.ultra_clean) == ["English", "France", "en", "", "", "English,French", "2000"]
    assert on([" 2000 , x,, "], text.split_list) == [["2000", "x"]]
    assert on(["One. Two? Three"], text.sentences) == [["One.", "Two?", "Three"]]
    assert on(["<head><title>t</title></head><p>a &amp; b</p><script>x()</script>"], text.html_text) == ["a & b"]
    assert on(["The  Cat, a dog!", "ña é a the à-a, Öl"], text.answer_normal) == ["cat dog", "ña é à- öl"]
    assert on(["camelCaseWord"], text.split_camel) == ["camel Case Word"]


def test_tag_columns(spark):
    names = ["topic__hash__vpd__hash__flu", "topic__hash__risk__hash__x", "outcome__hash__a__hash__b", "title"]
    assert tags.note_columns(names) == {"research_notes": [names[0]], "topic_notes": [names[1]], "notes": [names[2]]}
    df = spark.createDataFrame([("a:z, b:y", "c:x", None, "t")], ", ".join(f"`{n}` string" for n in names))
    row = tags.add_notes(df).first()
    assert (row["research_notes"], row["topic_notes"], row["notes"]) == ("y, z", "x", None)
    assert tags.tag_tree(names)[0][:3] == ("topic", "vpd", "flu")
    assert tags.matching_column("abc", ["abc", "abcd"]) == "abc" and tags.matching_column("zz", ["abc"]) is None
