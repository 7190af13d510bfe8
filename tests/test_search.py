import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.kernels import TokenHashEncoder
from granary.operators import graph as G
from granary.operators import index as I
from granary.operators import rerank as R
from granary.operators import search as S
from granary.plans.retrieve import CorpusIndex, pick_mode
from granary.runtime import materialize, with_position

WORDS = "ring map ideal field group sum kernel".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(60)]
    texts[7] = texts[8] = texts[9]  # copies tie
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame(
        [(1, "ring ideal ring"), (2, "nothing known"), (3, texts[9]), (4, "")],
        "query_id long, text string",
    )
    return texts, chunks, queries


def lexical_by_hand(texts, query, k):
    docs = [t.split() for t in texts]
    n = len(docs)
    df = {w: sum(w in d for d in docs) for w in {w for d in docs for w in d}}
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}

    def weigh(tokens):
        known = [t for t in tokens if t in idf]
        return {t: (1 + math.log(known.count(t))) * idf[t] for t in known}

    q = weigh(query.split())
    qn = math.sqrt(sum(w * w for w in q.values())) or 1.0
    scored = []
    for i, d in enumerate(docs):
        v = weigh(d)
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        score = round(sum(q[t] * v.get(t, 0) for t in q) / (qn * norm), 9)
        if score > 0:
            scored.append((-score, i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.mark.parametrize("width, first", [(1, 1), (3, 2), (1000, 8)])
def test_lexical_search(spark, corpus, width, first):
    texts, chunks, queries = corpus
    rows = S.lexical_search(queries, I.lexical_index(chunks, width), 5, first_blocks=first).collect()
    for q in queries.collect():
        got = sorted((r["rank"], r["chunk_id"], r["score"]) for r in rows if r["query_id"] == q["query_id"])
        want = lexical_by_hand(texts, q["text"], 5)
        assert [(c, pytest.approx(s, abs=1e-8)) for _, c, s in got] == want


def test_lexical_search_stops_early(spark):
    """Ranges that cannot hold a result are not read, and leave no result out."""
    draw = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4_000)]
    texts = [" ".join(draw.choice(words, 30)) + " the of and" for _ in range(600)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = [(i, texts[i * 31]) for i in range(10)] + [(98, "nothing known"), (99, "")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = I.lexical_index(chunks, 4)
    weights = S.query_weights(queries, index.idf).withColumn("part", F.lit(0))
    plan = S.plan_blocks(weights, index, 3)
    read = plan.first.select("query_id", "block").union(plan.rest).join(plan.weights, "query_id").select("query_id", "term", "block")
    sizes = index.postings.select("term", "block", F.size("ids").alias("n"))
    stored = sizes.agg(F.sum("n")).first()[0]
    searched = read.join(sizes, ["term", "block"]).groupBy("query_id").agg(F.sum("n").alias("n")).collect()
    asked_of = plan.weights.join(sizes, "term").groupBy("query_id").agg(F.sum("n").alias("n")).collect()
    whole = {r["query_id"]: r["n"] for r in asked_of}
    assert len(searched) == 10
    assert all(r["n"] < whole[r["query_id"]] / 2 < stored for r in searched), (searched, whole, stored)
    rows = S.lexical_search(queries, index, 3).collect()
    for query_id, text in asked:
        got = sorted((r["rank"], r["chunk_id"]) for r in rows if r["query_id"] == query_id)
        assert [c for _, c in got] == [c for c, _ in lexical_by_hand(texts, text, 3)]


def test_hot_terms_change_nothing(spark, corpus):
    _, chunks, _ = corpus
    terms = materialize(I.chunk_terms(chunks), "t")
    table = materialize(I.idf(I.document_frequency(terms), chunks), "i")
    plain = {(r[0], r[1]): r[3] for r in I.tf_weights(terms, table).collect()}
    split = {
        (r[0], r[1]): r[3]
        for r in I.tf_weights(terms, table, hot_terms=2, broadcast_rows=1).collect()
    }
    assert plain == split and plain


@pytest.mark.parametrize("cells", [8, 1_000])
def test_dense_search_blocks_and_ties(spark, cells):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(50, 8))
    vectors[10] = vectors[20] = vectors[30]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    table = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<double>"
    )
    queries = table.filter("chunk_id in (30, 1, 2)").withColumnRenamed("chunk_id", "query_id")
    rows = S.dense_search(queries, table.repartition(3), 4, cells=cells).collect()
    for q in (30, 1, 2):
        got = [r["chunk_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
        scores = np.round(vectors @ vectors[q], 9)
        assert got == sorted(range(50), key=lambda i: (-scores[i], i))[:4]


def quota_by_hand(kinds, k, ratio, extras):
    g, p = [i for i, t in enumerate(kinds) if t == "generated"], [
        i for i, t in enumerate(kinds) if t == "pdf"
    ]
    o = [i for i, t in enumerate(kinds) if t not in ("generated", "pdf")]
    if not g:
        return list(range(len(kinds)))[:k]
    take = min(max(int(round(k * ratio)), 1), len(g), k)
    out = g[:take]
    out += p[: min(k - len(out), len(p), extras)]
    out += g[take : take + k - len(out)]
    out += [i for i in p if i not in out][: k - len(out)]
    return out + o[: k - len(out)]


@pytest.mark.parametrize(("k", "ratio", "extras"), [(6, 0.75, 2), (5, 0.5, 0), (3, 0.0, 9), (4, 1.0, 1)])
def test_source_quota(spark, k, ratio, extras):
    rng = random.Random(k)
    lists = {
        q: [rng.choice(kinds) for _ in range(rng.randint(1, 12))]
        for q, kinds in enumerate(
            [["generated", "pdf", "narrative"]] * 8 + [["pdf", "narrative"]] * 2 + [["generated"]]
        )
    }
    rows = [
        (q, i, i + 1, 1.0 / (i + 1), kind) for q, ks in lists.items() for i, kind in enumerate(ks)
    ]
    results = spark.createDataFrame(
        rows, "query_id long, chunk_id long, rank int, score double, source_type string"
    )
    out = S.source_quota(results, k, "symbols-first", ratio, extras).collect()
    for q, kinds in lists.items():
        got = [r["chunk_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == quota_by_hand(kinds, k, ratio, extras)


def test_quota_arguments(spark):
    empty = spark.createDataFrame([], "query_id long, chunk_id long, rank int, source_type string")
    for bad in ({"priority": "x"}, {"symbols_ratio": 2.0}, {"max_pdf_extras": -1}):
        with pytest.raises(ValueError):
            S.source_quota(empty, 3, **bad)


def test_minmax_of_flat_lists(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0.3), (1, 2, 0.3), (2, 1, 0.0), (2, 2, 2.0)], "query_id long, chunk_id long, score double"
    )
    out = {(r[0], r[1]): r[2] for r in S.minmax_normalize(rows).collect()}
    assert out == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 0.0, (2, 2): 1.0}


def test_hybrid_ends_agree_with_one_side(spark, corpus):
    _, chunks, queries = corpus
    index = I.lexical_index(chunks)
    vectors = I.embed_chunks(chunks, TokenHashEncoder)
    asked = I.embed_chunks(queries, TokenHashEncoder, key="query_id")
    dense = S.hybrid_search(queries, asked, index, vectors, 3, alpha=1.0).collect()
    direct = S.dense_search(asked, vectors, 3).collect()
    order = lambda rows: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in rows)
    known = {1, 3}
    assert [r for r in order(dense) if r[0] in known] == [r for r in order(direct) if r[0] in known]
    with pytest.raises(ValueError):
        S.hybrid_search(queries, asked, index, vectors, 3, alpha=1.5)


def test_modes(spark, corpus):
    _, chunks, _ = corpus
    bare = CorpusIndex(chunks, I.lexical_index(chunks))
    full = CorpusIndex(chunks, bare.lexical, chunks, TokenHashEncoder)
    assert [pick_mode(bare, m) for m in ("auto", "hybrid", "lexical")] == ["lexical"] * 3
    assert [pick_mode(full, m) for m in ("auto", "dense")] == ["hybrid", "dense"]
    with pytest.raises(RuntimeError):
        pick_mode(bare, "dense")
    with pytest.raises(ValueError):
        pick_mode(full, "best")


def test_positions_are_contiguous(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("x").alias("v"))
    out = with_position(rows, ["k"], "n", partitions=6).collect()
    assert sorted((r["n"], r["k"]) for r in out) == [(i, i) for i in range(500)]


def test_failed_scorer_keeps_the_order(spark):
    rows = spark.createDataFrame(
        [(q, f"ask {q}", r, "name", "", "", "", "t" * r) for q in (1, 2) for r in (1, 2, 3)],
        "question_id long, question string, rank int, qualname string, symbol_id string, "
        "signature string, summary string, text string",
    )

    def broken(queries, texts):
        raise RuntimeError("model is gone")

    def by_length(queries, texts):
        return [len(t) for t in texts]

    kept = R.topn_rerank(rows, broken, 2).orderBy("question_id", "rank").collect()
    assert [len(r["text"]) for r in kept] == [1, 2, 3] * 2
    moved = R.topn_rerank(rows, by_length, 2).orderBy("question_id", "rank").collect()
    assert [len(r["text"]) for r in moved] == [2, 1, 3] * 2


def test_symbol_affinity_aliases(spark):
    row = spark.createDataFrame(
        [("Ops.guess_rec", "", "", "method", ["recover", "sequence", "recurrences", "method"])],
        "qualname string, symbol_id string, module string, kind string, tokens array<string>",
    )
    assert row.select(R.symbol_affinity(F.col("tokens"))).first()[0] == 3
    assert row.select(R.preferred_affinity(F.lit("x.to_list"), F.col("tokens"))).first()[0] == 1


def test_resolution_order(spark):
    nodes = spark.createDataFrame(
        [
            ("m.a.go", "a.go", "go"),
            ("go", "pkg.go", "go"),
            ("m.xa.go", "xa.go", "go"),
            ("z", "go", "go"),
        ],
        "key string, qualname string, tail string",
    )
    refs = spark.createDataFrame([("GO",), ("a.go",), ("no such",), ("",)], "ref string")
    out = G.resolve_refs(refs, nodes).orderBy("ref", "priority", "key").collect()
    found = {}
    for r in out:
        found.setdefault(r["ref"], []).append(r["key"])
    assert found["GO"] == ["go", "z", "m.a.go", "m.xa.go"]
    assert found["a.go"] == ["m.a.go", "m.xa.go"]
    assert set(found) == {"GO", "a.go"}
