import json

import pytest
from pyspark.sql import functions as F

from granary import vocab
from granary.operators import context as C
from granary.operators import responses as M
from granary.operators import routing as R
from granary.operators.features import classify_intent, question_features
from granary.plans import answer as A
from granary.sources import config, records
from granary.streaming.questions import route_stream, write_stream

NAMES = vocab.Names("pkg", "Thing", "thing algebra")
REGISTRY = R.Registry(
    (R.Family("A", "Setup", "", ("ring",)), R.Family("B", "Guess", "", ("guess data",))),
    (
        R.Workflow("A1", "A", "Make rings", "", ("ring", "base ring"), ("Thing", "Ops.guess_rec")),
        R.Workflow("B1", "B", "Guess it", "", ("guess data",), ("guess",)),
    ),
)


def choose(spark, text, **more):
    row = {"question_id": 1, "text": text, **more}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    return R.choose_workflow(df, REGISTRY, NAMES).first()


def test_choose_workflow(spark):
    hit = choose(spark, "Which base  RING do I need?")
    assert (hit["workflow_id"], hit["family_id"]) == ("A1", "A")
    assert hit["confidence"] == pytest.approx(min(0.98, 0.55 + 9 / 15))
    assert hit["matched_on"] == ["ring", "base ring"]
    both = choose(spark, "data to guess a ring")
    assert both["workflow_id"] == "A1"  # equal scores, registry order
    assert both["confidence"] == pytest.approx(0.55)
    assert choose(spark, "Which category covers ring?")["confidence"] == 0.4
    assert choose(spark, "write a poem on ring")["family_id"] == ""
    hinted = choose(spark, "write a poem", family_hint="b. what")
    assert (hinted["family_id"], hinted["confidence"]) == ("B", 0.35)
    seen = choose(spark, "x", context="uses Ops.guess_rec")
    assert seen["workflow_id"] == "A1" and seen["matched_on"] == ["Ops.guess_rec"]


def test_expand_queries(spark):
    df = spark.createDataFrame([(1, " guess a recurrence in this ring ")], "question_id long, text string")
    out = R.expand_queries(R.choose_workflow(df, REGISTRY, NAMES), NAMES).orderBy("sub_no").collect()
    assert [r["query"] for r in out] == [
        "guess a recurrence in this ring",
        "guess a recurrence in this ring pkg Make rings Thing Ops.guess_rec",
        "guess a recurrence in this ring pkg Ops.guess_rec",
    ]


def test_features_and_intent(spark):
    asks = [
        "Find the local basis of (x^2-1)*Dx^2 + 1 at the second real root of the leading "
        "coefficient and show the base ring",
        "Does x*Sn - 1 have a right factor?",
        "create a thing algebra in QQ[x,y][Dx,Dy]",
        "tell me a joke",
    ]
    df = spark.createDataFrame(list(enumerate(asks)), "n int, text string")
    rows = classify_intent(question_features(df, NAMES), NAMES).orderBy("n").collect()
    assert rows[0]["operator_text"] == "(x^2-1)*Dx^2 + 1"
    assert rows[0]["point_source"] == "leading_coefficient_root"
    assert rows[0]["point_selection"] == "second_real"
    assert rows[0]["intent_id"] == "local_basis_expansions"
    assert len(rows[0]["helper_actions"]) == 4
    assert rows[1]["intent_id"] == "right_factor_search"
    assert rows[1]["operator_kind"] == "recurrence"
    assert "report whether any right factor satisfying the request exists" in rows[1]["helper_actions"]
    assert rows[2]["algebra_scope"] == "multivariate"
    assert rows[2]["preferred_methods"][0] == "Thing"
    assert rows[3]["workflow_id"] == "" and rows[3]["preferred_methods"] == []


@pytest.mark.parametrize(
    ("raw", "payload"),
    [
        ('ok ```json\n{"a": 1}\n``` {"b": 2}', {"a": 1}),
        ('x {no} then {"a": {"b": "}"}} end', {"a": {"b": "}"}}),
        ('{"a": 1} {"b": 2}', {"a": 1}),
        (r'{"t": "\alpha and \text"}', {"t": "\\alpha and \\text"}),
        ('{"t": "\\u00e9"}', {"t": "é"}),
        ("[1, 2]", None),
        ("", None),
        ('{"a": "cut', None),
    ],
)
def test_parse_responses(spark, raw, payload):
    row = M.parse_responses(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (json.loads(row["payload"]) if row["payload"] else None) == payload
    assert (row["error"] is None) == (payload is not None)


def test_subtasks(spark):
    raw = json.dumps(
        {
            "subtasks": [
                {"step_id": "7", "family_id": "b", "instruction": " do "},
                "junk",
                {"title": "T", "retrieval_query": "q", "family_id": "none"},
                {"title": "late"},
            ]
        }
    )
    df = spark.createDataFrame([(1, raw, "ask"), (2, "{}", "ask")], "question_id long, payload string, text string")
    out = M.explode_subtasks(df, 3, registry=REGISTRY).orderBy("question_id", "position").collect()
    assert [tuple(r) for r in out] == [
        (1, 1, 7, "Step 1", "do", "do", "B"),
        (1, 3, 3, "T", "", "q", ""),
        (2, 1, 1, "Direct retrieval", "Retrieve direct evidence for the user question", "ask", ""),
    ]


def test_effective_steps(spark):
    steps = spark.createDataFrame(
        [(1, p, p, "", "t", "i", f"q{p}") for p in (1, 2, 3)],
        "question_id long, position int, step_id int, family_id string, title string, "
        "instruction string, retrieval_query string",
    )
    decisions = spark.createDataFrame(
        [(1, 1, "refine_query", " better "), (1, 2, "stop", "")],
        "question_id long, position int, action string, next_query string",
    )
    out = A.effective_steps(steps, decisions).orderBy("position").collect()
    assert [r["query"] for r in out] == ["better", "q2"]


def test_score_text_rounds_like_print(spark):
    scores = [0.03125, 0.15625, 0.5, 1.23456, 0.00005, 2.00015]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r[0] for r in df.select(C.four_decimals(F.col("s"))).collect()]
    assert got[:4] == [f"{s:.4f}" for s in scores[:4]]


def test_rules_stop_after_eight_lines(spark):
    rules = [R.Rule(f"m{n}", ("x",)) for n in range(12)]
    df = spark.createDataFrame([("x",)], "t string")
    lines = df.select(R.match_rules(F.col("t"), F.lit(None), rules, ["g"])).first()[0]
    assert len(lines) == 8 and lines[0] == "- g"
    many = df.select(R.match_rules(F.col("t"), F.lit(None), rules, [f"g{n}" for n in range(9)]))
    assert len(many.first()[0]) == 10


def test_readers(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a", "example_count": 2}\n\n{broken\n')
    assert records.read_symbols_jsonl(spark, str(bad), "drop").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_symbols_jsonl(spark, str(bad)).collect()
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n")
    with pytest.raises(RuntimeError):
        records.read_symbols_jsonl(spark, str(empty))
    assert records.read_narratives_jsonl(spark, str(tmp_path / "none")).count() == 0
    assert records.read_markdown(spark, str(tmp_path / "none.md")).count() == 0
    rules, messages = config.load_rules(spark, str(tmp_path / "none.json"))
    assert rules.count() == 0 and messages.count() == 0
    assert records.normalize_extensions(" .PY, md,") == [".md", ".py"]
    with pytest.raises(ValueError):
        records.normalize_extensions(" , ")


def test_scan_source_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.PY").write_text("one\ntwo")
    (tmp_path / "a" / "b" / "y.pyx").write_text("three")
    (tmp_path / "a" / "z.txt").write_text("no")
    rows = records.scan_source_tree(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["path"], r["source"]) for r in rows] == [("a/b/y.pyx", "three"), ("a/x.PY", "one\ntwo")]


def test_routing_runs_on_a_stream(spark, tmp_path):
    asks = spark.createDataFrame([(1, "base ring"), (2, "poem about x")], "question_id long, text string")
    asks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asks.schema).parquet(str(tmp_path / "in"))
    query = write_stream(
        route_stream(stream, REGISTRY, NAMES), str(tmp_path / "out"), str(tmp_path / "ckpt")
    )
    assert query.awaitTermination(120)
    rows = {r["question_id"]: r["workflow_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {1: "A1", 2: ""}
