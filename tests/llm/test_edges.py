"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pickle

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import (
    decontaminate,
    fuzzy_lines,
    kdtree,
    langid,
    mixing,
    perplexity,
    simhash,
    tokencount,
    toxicity,
    warc,
)
from granary.llm.queries import VOCABULARY, mix_levels, mix_weights

CLASH = (
    "score spans size text_crc32 shard slot row node line bucket tokens n_tokens copies domain hash fp wide words "
    "at len label piece key t lo hi second first root kept lang_pred held_out"
).split()
LONG = "wort der langen zeile mit vielen worten " * 5_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs away home today", "en", "src1", 10),
    (2, None, "en", "src1", None),
    (3, "", "de", "src2", 0),
    (4, " \t\n \n", None, None, 4),
    (5, LONG, "de", "src2", len(LONG)),
    (5, LONG, "de", "src2", len(LONG)),
    (None, "A text without an id.\nAnd a second line of it.", "en", None, None),
    (None, None, None, None, None),
    (7, "The quick brown fox jumps over the lazy dog and then it runs away home today", "en", "src1", 10),
    (8, "12345 !!! ***", "fr", "other", 13),
    (9, "über ärger ÖL 漢字 \U0001f600", "de", "src3", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 0), (2, 1), (3, 0), (5, 1), (5, 1), (7, None), (None, 1), (8, 0)]
    return spark.createDataFrame(rows, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "Fox jumps OVER the lazy dog"), (2, None), (3, ""), (4, "über"), (None, "id."), (1, "nothing of it")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_perplexity(docs, nothing):
    rows = perplexity.quality(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    for i in (2, 3, 4):
        assert (by_id[i]["n_words"], by_id[i]["base_failed"], by_id[i]["kept"]) == (0, True, False)
    assert by_id[2]["perplexity"] is None
    assert by_id[5]["n_words"] == 35_000 and by_id[5]["n_repeat_words"] == 35_000
    assert by_id[8]["n_symbols"] == 3
    assert by_id[1]["perplexity"] == by_id[7]["perplexity"]
    assert perplexity.quality(nothing).count() == 0


def test_simhash(docs, nothing):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert {by_id[i]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16}
    assert {by_id[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert by_id[7]["component_id"] == 1
    assert simhash.simhash_groups(nothing).count() == 0


def test_near_copies(docs, nothing):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 5, 8, 9] and ids.count(None) == 1
    assert simhash.drop_near_copies(nothing).count() == 0


def test_mixing(spark, docs, nothing):
    mixed = mixing.mix(docs, mix_levels(), mix_weights(spark), 1.0, 2)
    rows = mixed.collect()
    assert all(r["copies"] >= 1 for r in rows)
    assert "none" in {r["domain"] for r in rows}
    assert mixing.mix(nothing, mix_levels(), mix_weights(spark), 0.5).count() == 0
    nothing_to_take = mixing.mix(docs, mix_levels(), mix_weights(spark), 0).collect()
    assert all(r["n_tokens"] == 0 for r in nothing_to_take)


def test_lines(docs, nothing):
    rows = fuzzy_lines.line_classes(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 5, 7, 8, 9, None}
    seventh = next(r for r in rows if r["doc_id"] == 7)
    assert (seventh["class_doc"], seventh["class_line"], seventh["kept"]) == (1, 0, False)
    cut = fuzzy_lines.dedup_lines(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert [r["text"] for r in cut.filter("doc_id = 7").collect()] == [""]
    assert fuzzy_lines.line_classes(nothing).count() == 0


def test_language(docs, nothing):
    profiles = langid.learn(docs)
    rows = langid.identify(docs, profiles, keep=["doc_id"]).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    for i in (2, 3, 4, 8):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[5]["lang_pred"] == "de" and 0 <= by_id[5]["score"] <= 1
    assert langid.learn(nothing) == {}
    ranker = langid.Ranker(profiles)
    assert ranker.predict("\U0001f600 \u2603 5") == ("und", 0.0)
    assert ranker.predict("\U00020000")[0] != "und"  # a letter beyond the basic plane
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(nothing, profiles).count() == 0


def test_shards(docs, nothing):
    rows = kdtree.kd_shards(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes[2] == 8 and sizes[3] == 8 and sizes[9] == 8 + len(ROWS[10][1].encode())
    assert kdtree.kd_shards(nothing, shards=3).count() == 0
    assert {r["shard"] for r in kdtree.kd_shards(docs, target_bytes=1 << 30).collect()} == {0}


def test_decontamination(docs, nothing, benchmark):
    rows = decontaminate.find_contamination(docs, benchmark).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert (by_id[1]["n_hit"], by_id[1]["n_items"], by_id[1]["contaminated"]) == (6, 1, True)
    assert by_id[9]["n_hit"] == 1 and by_id[2]["n_words"] == 0 and not by_id[5]["contaminated"]
    without = next(r for r in rows if r["doc_id"] is None and r["n_words"])
    assert without["n_hit"] == 1 and without["n_items"] == 0  # the item has no id
    kept = decontaminate.remove_documents(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 5, 8]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert spans[1] == "The quick brown and then it runs away home today" and spans[3] == ""
    empty = benchmark.limit(0)
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(docs, empty).collect())
    assert decontaminate.find_contamination(nothing, benchmark).count() == 0


def test_decontamination_in_parts(docs, benchmark):
    whole = decontaminate.find_contamination(docs, benchmark).collect()
    parts = decontaminate.find_contamination(docs, benchmark, broadcast_windows=2).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))


def test_spans_of_rows_without_an_id_or_with_the_same(spark, benchmark):
    texts = ["a fox jumps over the lazy dog b", "c d fox jumps over the lazy dog", "e f g", None]
    rows = [(i, t) for i in (4, None) for t in texts]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    found = [(r["doc_id"], r["text"]) for r in decontaminate.remove_spans(docs, benchmark).collect()]
    cut = [(i, t) for i in (4, None) for t in ["a b", "c d ", "e f g", None]]
    assert sorted(map(repr, found)) == sorted(map(repr, cut + cut[:1]))
    lines = fuzzy_lines.dedup_lines(docs).collect()
    assert sum(r["text"] == "e f g" for r in lines) == 1 and len(lines) == len(rows) + 1


def test_toxicity(docs, nothing, labels):
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(blank) == 1
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.train(nothing, labels)
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.score(docs, none).count() == len(ROWS)


def test_repeated_ids_are_learned_once(spark):
    rows = [(1, f"calm words of row {i:03}") for i in range(500)] + [(2, "rude words"), (3, "calm words"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, None), (9, 1)], "doc_id long, toxic int")
    many, once = (
        toxicity.train(d, labels) for d in (docs.repartition(3), docs.groupBy("doc_id").agg(F.min("text").alias("text")))
    )
    assert pickle.dumps(many) == pickle.dumps(once)


def test_tokens(docs, nothing):
    rows = tokencount.token_counts(docs, VOCABULARY, keep=["doc_id"]).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 0 and by_id[4]["n_tokens"] > 0
    assert by_id[5]["n_tokens"] >= by_id[5]["n_pretokens"] >= 35_000
    assert "n_tokens" in tokencount.token_counts(docs, VOCABULARY).columns
    assert tokencount.token_counts(nothing, VOCABULARY).count() == 0


def test_archives(spark, tmp_path):
    long = "é" * 100_000
    tricky = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 3_000
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "x\r\ny", ""), (5, "", long), (6, "z", long)]
    rows += [(None, "q", "a"), (8, "u", tricky), (8, "u", tricky)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    back = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    found = sorted((r["page_id"] or "", r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back)
    assert found == [
        ("", "response", None, 1),
        ("1", "response", None, 1),
        ("2", "revisit", "1", 1),
        ("3", "response", None, 0),
        ("4", "revisit", "3", 0),
        ("5", "response", None, 200_000),
        ("6", "revisit", "5", 200_000),
        ("8", "response", None, len(tricky)),
        ("8", "response", None, len(tricky)),
    ]
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in back if r["payload"] is not None}
    assert texts["5"] == long and texts["8"] == tricky and not any(r["damage"] for r in back)
    nothing = str(tmp_path / "nothing")
    warc.write_archives(pages.limit(0), nothing)
    assert warc.read_archives(spark, nothing).count() == 0


def test_stages(spark, docs, nothing, labels, benchmark, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != "sharding":
            assert result.columns == docs.columns, name
        assert result.count() <= len(ROWS), name
        assert stage(spark, nothing, folder).count() == 0, name
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(ids) == len(set(ids))
