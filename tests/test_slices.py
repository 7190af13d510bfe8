"""Texts are handed to Python in slices of an Arrow batch."""

import pyarrow as pa
import pytest

from granary.operators import extract as X
from granary.operators import responses as M
from granary.runtime import SLICE_ROWS, text_slices


def test_slices_are_bounded():
    texts = pa.array(["a" * 10, None, "b" * 90, "c" * 10, "d", "e"])
    cut = [s.to_pylist() for s in text_slices(texts.slice(0), rows=2, size=100)]
    assert cut == [["a" * 10, None], ["b" * 90, "c" * 10], ["d", "e"]]
    assert [len(s) for s in text_slices(texts, rows=9, size=50)] == [2, 1, 3]
    assert not list(text_slices(pa.array([], pa.string())))


@pytest.mark.parametrize("rows", [0, 1, 2 * SLICE_ROWS + 3])
def test_files_of_several_slices(spark, rows):
    made = [(f"root/d{i}.py", "def broken(:" if i % 3 == 1 else f'"""Doc {i}."""\nx = 1\n') for i in range(rows)]
    files = spark.createDataFrame(made, "path string, source string").coalesce(1)
    scanned = X.scan_sources(files)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    docs = {r["source_file"]: r["docstring"] for r in X.extract_module_docs(scanned, "root", "root").collect()}
    assert docs == {p: None if "broken" in s else f"Doc {p[6:-3]}." for p, s in made}
    assert {r["path"] for r in X.extraction_errors(scanned).collect()} == {p for p, s in made if "broken" in s}


def test_responses_of_several_slices(spark):
    made = [(i, None if i % 5 == 0 else f'so {{"n": {i}}} is it') for i in range(2 * SLICE_ROWS + 3)]
    parsed = M.parse_responses(spark.createDataFrame(made, "id long, raw string").coalesce(1))
    got = {r["id"]: r["payload"] for r in parsed.collect()}
    assert got == {i: None if raw is None else f'{{"n": {i}}}' for i, raw in made}
