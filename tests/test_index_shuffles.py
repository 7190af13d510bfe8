"""Shuffles of the index build and of the scoring of ranges."""

import io
import random
import re
from collections import Counter
from contextlib import redirect_stdout

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import kernels as K
from granary.functions import text as T
from granary.operators import index as I
from granary.operators import search as S
from granary.plans import answer as A
from granary.plans.retrieve import CorpusIndex, retrieve
from granary.runtime import materialize

WORDS = "ring map ideal field group sum kernel".split()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(60)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    terms = materialize(I.chunk_terms(chunks), "t")
    return chunks, terms, materialize(I.idf(I.document_frequency(terms), chunks), "i")


def exchanges(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue().count("Exchange hashpartitioning")


def cells(postings):
    return {
        (r["term"], r["block"], i): (round(u, 12), round(r["top"], 12))
        for r in postings.collect()
        for i, u in zip(r["ids"], r["weights"])
    }


def test_postings_are_shuffled_once_and_packed(tables):
    _, terms, table = tables
    assert exchanges(I.posting_blocks(I.unit_weights(terms, table, 7))) == 1


def test_terms_outside_the_broadcast_ones_change_no_posting(tables):
    _, terms, table = tables
    whole = cells(I.posting_blocks(I.unit_weights(terms, table, 7)))
    cut = cells(I.posting_blocks(I.unit_weights(terms, table, 7, hot_terms=2, broadcast_rows=1)))
    assert cut == whole and len({t for t, _, _ in whole}) == len(WORDS)


def test_ranges_are_scored_alike_without_broadcasts(spark, tables, monkeypatch):
    chunks = tables[0]
    index = I.lexical_index(chunks, 7)
    queries = spark.createDataFrame([(1, "ring ideal ring"), (2, "sum kernel map")], "query_id long, text string")
    weights = S.query_weights(queries, index.idf).withColumn("part", F.lit(0))
    asked = materialize(index.postings.select("block").distinct().crossJoin(weights), "asked")

    def best():
        return {(r["query_id"], r["chunk_id"]): r["score"] for r in S.score_blocks(asked, index, 3).collect()}

    broadcast = best()
    monkeypatch.setattr(S, "BROADCAST_ROWS", 1)
    assert best() == broadcast and broadcast
    # The questions of a range and its postings; neither is dealt again by term.
    packed = 1
    assert exchanges(S.score_blocks(asked, index, 3)) == 2 + packed


def test_terms_are_counted_and_packed_in_arrow(spark, tables):
    """The build sorts and aggregates no single posting in the JVM."""
    odd = [None, "", "12ab_ 3 A1b a1B", "9", "İstanbul \u212aelvin K é_é9a", "a\x00b", "x_", "_"]
    rng = random.Random(2)
    texts = odd + ["".join(rng.choices("aB_1 9.éK\n", k=rng.randint(0, 30))) for _ in range(600)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    terms = I.chunk_terms(chunks)
    found = {r["chunk_id"]: [tuple(c) for c in r["counts"]] for r in terms.collect()}
    native = chunks.select("chunk_id", T.term_counts(T.tokenize("text")).alias("counts")).collect()
    assert found == {r["chunk_id"]: [tuple(c) for c in r["counts"]] for r in native}
    assert found[4] == sorted(Counter(t.lower() for t in re.findall("[A-Za-z_][A-Za-z0-9_]*", texts[4])).items())
    _, rows, table = tables
    for hot in ({}, {"hot_terms": 2, "broadcast_rows": 1}):
        with redirect_stdout(io.StringIO()) as out:
            I.posting_blocks(I.unit_weights(rows, table, 7, **hot)).explain("simple")
        assert "Window" not in out.getvalue() and "ObjectHashAggregate" not in out.getvalue()


def test_chunks_without_an_id_lie_in_no_range_and_repeated_ones_share_a_norm(spark):
    rows = [(None, "ring map"), (3, "ring"), (3, "map map"), (4, "ring")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    index = I.lexical_index(chunks, 2)
    idf = {r["term"]: r["idf"] for r in index.idf.collect()}
    assert {r["term"]: r["ids"] for r in index.postings.collect() if r["block"] == 1} == {"ring": [3], "map": [3]}
    heads = {(r["term"], r["block"]): r["top"] for r in index.postings.collect()}
    assert heads["ring", 1] < 1.0 == heads["ring", 2] and set(idf) == {"ring", "map"}


def test_a_block_comes_out_alike_however_its_rows_are_cut():
    rows = [(0, 1, "a b", [1, 2], None), (0, 2, "c", [1], 3.0), (0, 2, "b", [1], None), (1, 9, "zz", [1], None), (2, 17, "a", [4], None)]
    cells = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.float64()))]
    batch = pa.RecordBatch.from_arrays(cells, names=["block", "chunk_id", "names", "tfs", "idf"])
    kernel = K.posting_kernel(pa.array(["a", "b"]), [1.0, 2.0])
    whole = [r for b in kernel([batch]) for r in b.to_pylist()]
    assert whole == [r for b in kernel([batch.slice(i, 1) for i in range(len(rows))]) for r in b.to_pylist()]
    # A term without an idf is left out, and a block with no other gives nothing.
    assert [(r["term"], r["block"], r["ids"]) for r in whole] == [("a", 0, [1]), ("b", 0, [1, 2]), ("c", 0, [2]), ("a", 2, [17])]


def test_lists_of_two_lengths_come_from_one_search(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(90)]
    chunks = spark.createDataFrame(
        [(i, t, ("generated", "pdf", "narrative")[i % 3]) for i, t in enumerate(texts)],
        "chunk_id long, text string, source_type string",
    )
    index = CorpusIndex(chunks, I.lexical_index(chunks, 7))
    flow = "question_id long, text string, workflow_id string, workflow_title string, preferred_symbols array<string>, family_id string, family_name string"
    selected = spark.createDataFrame(
        [(1, "ring map", "w", "On sums", ["kernel"], "", ""), (2, "ideal field", "", "", [], "", ""), (3, "sum", "", "", [], "F", "group")],
        flow,
    )
    searched = []
    search = S.lexical_search
    monkeypatch.setattr(S, "lexical_search", lambda *a, **k: searched.append(a[2]) or search(*a, **k))
    rows = A.retrieved_lists(selected, index).collect()
    assert searched == [50]
    for question, depth in ((1, 10), (2, 6), (3, 10)):
        own = sorted({(r["sub_no"], r["query"]) for r in rows if r["question_id"] == question})
        assert len(own) > 1 or depth == 6
        for sub, query in own:
            asked = spark.createDataFrame([(0, query)], "query_id long, text string")
            alone = {(r["rank"], r["chunk_id"], r["score"]) for r in retrieve(asked, index, depth).collect()}
            assert {(r["rank"], r["chunk_id"], r["score"]) for r in rows if (r["question_id"], r["sub_no"]) == (question, sub)} == alone
