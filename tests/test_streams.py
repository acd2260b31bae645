"""Streams that are stopped and started again."""

import json

import pytest

from catalume.streaming import attempts, pages

ITEM = "source string, id long, at long, ok boolean"


def write_pages(folder, numbers, size=4):
    folder.mkdir(exist_ok=True)
    for n in numbers:
        (folder / f"page_{n}.jsonl").write_text("".join(json.dumps({"id": n * 100 + i, "score": i, "page": n}) + "\n" for i in range(size)))


def fetch(spark, tmp_path, **options):
    pages.fetch_pages(spark, f"file://{tmp_path}/in", "id long, score double, gone string, page int", f"{tmp_path}/out", f"{tmp_path}/cp", **options).awaitTermination()
    return sorted((r["id"], r["score"], r["gone"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_pages_come_once(spark, tmp_path):
    """A page that is missing or empty ends a run; the next run goes on there and reads no page twice."""
    there = tmp_path / "in"
    write_pages(there, [1, 2, 3, 5])
    rows = lambda *numbers: [(n * 100 + i, float(i), None) for n in numbers for i in range(4)]
    assert fetch(spark, tmp_path) == rows(1, 2, 3)
    assert fetch(spark, tmp_path) == rows(1, 2, 3)
    (there / "page_2.jsonl").write_text("changed after it was fetched")
    (there / "page_4.jsonl").write_text("")
    assert fetch(spark, tmp_path) == rows(1, 2, 3)
    write_pages(there, [4])
    assert fetch(spark, tmp_path) == rows(1, 2, 3, 4, 5)


def test_page_that_fails(spark, tmp_path):
    """A page that can't be read fails the run; the next one reads all of it, and the one after that what is new."""
    there = tmp_path / "in"
    write_pages(there, [1])
    (there / "page_2.jsonl").mkdir()
    (there / "page_2.jsonl" / "part").mkdir()
    with pytest.raises(Exception, match="(?s)STREAM_FAILED|page_2"):
        fetch(spark, tmp_path, tries="2", pause="0.01")
    (there / "page_2.jsonl" / "part").rmdir()
    (there / "page_2.jsonl").rmdir()
    write_pages(there, [2, 3])
    assert [r[0] for r in fetch(spark, tmp_path)] == [n * 100 + i for n in (1, 2) for i in range(4)]
    assert [r[0] for r in fetch(spark, tmp_path)] == [n * 100 + i for n in (1, 2, 3) for i in range(4)]


def expected(rows, limit):
    state = {}
    for source, i, _, ok in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
        tries, done = state.get((source, i), (0, False))
        if not done and tries < limit:
            state[source, i] = (tries + 1, bool(ok))
    return {k: (t, "done" if d else "given_up" if t >= limit else "retry") for k, (t, d) in state.items()}


def test_attempts_over_restarts(spark, tmp_path):
    first = [("a", 1, 1, False), ("a", 1, 2, True), ("a", 1, 3, False), ("a", 2, 4, False), ("b", 2, 5, None), ("a", 9, 6, False), (None, None, 7, True), ("a", 5, None, True)]
    second = [("a", 2, 10, False), ("a", 2, 11, False), ("a", 2, 12, True), ("b", 2, 13, True), ("a", 1, 14, True), *[("hot", 1, 20 + i, i == 2) for i in range(500)]]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        attempts.run(spark.readStream.schema(ITEM).json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        found = attempts.latest(spark.read.parquet(f"{tmp_path}/out"))
        seen = first if n == 0 else first + second
        assert {(r["source"], r["id"]): (r["tries"], r["status"]) for r in found.collect()} == expected(seen, 3)
    items = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("new", 1)], "source string, id long")
    assert sorted(map(tuple, attempts.to_try(items, found).collect())) == [("a", 9, 1, True), ("new", 1, 0, False)]
