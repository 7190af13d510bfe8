"""What the index build leaves on disk, and that its cuts change no row."""

import os
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import chunking as C
from granary.operators import index as I
from granary.plans import build as B
from granary.runtime import materialize, scratch, shared_dir

WORDS = "ring map ideal field group sum kernel".split()


def written(spark):
    folder = f"{shared_dir(spark)}/granary".removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.fixture
def pages(spark):
    rng = random.Random(4)
    rows = [(d, p, " ".join(rng.choices(WORDS, k=60)), f"s{d}") for d in (3, 1, 2) for p in range(1, 90)]
    return spark.createDataFrame(rows, "doc_id long, page int, text string, source string")


@pytest.fixture
def symbols(spark):
    fields = "id module qualname kind signature summary docstring file_path".split()
    rows = [(*(f"{f}{i % 5}" for f in fields), i, i, ["x"]) for i in range(40)]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields) + ", example_count int, line int, examples array<string>")


def cells(index):
    return {(r["term"], i): (w, r["top"]) for r in index.postings.collect() for i, w in zip(r["ids"], r["weights"])}


def test_the_build_leaves_only_what_the_index_reads(spark, pages, symbols):
    before = written(spark)
    index = B.build_index("both", symbols=symbols, pages=pages)
    left = sorted(name.rsplit("-", 1)[0] for name in written(spark) - before)
    assert left == ["idf", "positions", "positions", "postings"]
    assert index.chunks.count() == index.chunks.select("chunk_id").distinct().count() > 40
    assert index.lexical.postings.count() > 0 and index.lexical.idf.count() > 0


def test_sources_are_numbered_apart_as_together(spark, pages, symbols):
    titled = C.carry_forward_section(pages.withColumn("section_title", F.lit("")))
    packed = C.pack_pages(titled).join(pages.select("doc_id", "source").distinct(), "doc_id")
    parts = {
        "pdf": C.page_chunks(packed, "source"),
        "generated": B.numbered(C.render_symbol_chunks(symbols), ["module", "line"]),
    }
    for mode in ("both", "generated", "pdf"):
        together = C.assign_chunk_ids(C.select_sources(mode, **parts))
        apart = B.chunk_ids(mode, parts)
        assert apart.schema == together.schema
        assert sorted(map(repr, apart.collect())) == sorted(map(repr, together.collect()))
    mixed = {**parts, "pdf": parts["pdf"].withColumn("doc_id", F.col("doc_id").cast("string"))}
    assert B.chunk_ids("both", mixed).count() == B.chunk_ids("both", parts).count()


def test_slices_change_no_posting(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i - 9, " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in range(80)]
    rows += [(None, "ring"), (3, "sum sum"), (1 << 40, "ideal")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    whole = cells(I.lexical_index(chunks, 7))
    monkeypatch.setattr(I, "SLICE_CHUNKS", 10)
    before = written(spark)
    assert cells(I.lexical_index(chunks, 7)) == whole and whole
    left = sorted(name.rsplit("-", 1)[0] for name in written(spark) - before)
    assert left == ["idf", "postings"]
    assert not cells(I.lexical_index(chunks.limit(0), 7))


def test_only_unread_tables_go(spark):
    outside = materialize(spark.range(3), "outside")
    with scratch() as outer:
        read = materialize(outside.withColumn("x", F.lit(1)), "read")
        with scratch() as inner:
            gone = materialize(spark.range(5), "gone")
            inner.keep(read)
        outer.keep(read.select("x"))
    assert read.count() == outside.count() == 3
    assert not any(os.path.exists(f.removeprefix("file:")) for f in gone.inputFiles())
