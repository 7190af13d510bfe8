"""Stored narratives, stored preconditions, references by class and related symbols."""

import pytest
from pyspark.sql import functions as F

from granary.operators import graph as G
from granary.plans import narratives as N
from granary.sources import records, tables

BODY = "Words that fill a section until it is long enough to be kept. " * 8


def module(*titles, extra=""):
    parts = [f"{t}\n{'=' * 5}\n\n{BODY}\nsage: Ring(3).solve(x)\n{extra}" for t in titles]
    return '"""' + BODY + "\n\n" + "\n\n".join(parts) + '"""\n'


def symbols(spark, rows=(("pack.Ring", "Ring"), ("pack.Ring.solve", "Ring.solve"), ("pack.b.solve", "B.solve"))):
    return spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(rows)], "seq long, symbol_id string, qualname string"
    )


def tree(spark, files):
    return spark.createDataFrame(
        [(p, s, t) for p, (s, t) in files.items()], "path string, source string, t long"
    ).select("path", "source", F.timestamp_seconds("t").alias("modificationTime"))


def stored(spark, path):
    rows = N.read_narratives(spark, str(path), symbols(spark)).collect()
    return sorted((r["source_file"], r["section_no"], r["section_title"], tuple(r["resolved_symbol_ids"])) for r in rows)


def fresh(spark, files):
    made = N.extract_narratives(tree(spark, files), symbols(spark), "pack", "root").collect()
    return sorted((r["source_file"], r["section_no"], r["section_title"], tuple(r["resolved_symbol_ids"])) for r in made)


def test_narratives_of_a_tree(spark):
    files = {"a.py": (module("One", "One"), 1), "b.py": ("def broken(:", 1), "c.py": ('"""short"""', 1)}
    got = fresh(spark, files)
    found = ("pack.Ring.solve", "pack.b.solve", "pack.Ring")
    assert got == [("a.py", 0, "a", ()), ("a.py", 1, "One", found), ("a.py", 2, "One", found)]


def test_refresh_parses_what_changed(spark, tmp_path):
    files = {"a.py": (module("One"), 1), "b.py": (module("Two"), 1), "c.py": (module("Three"), 1)}
    path = str(tmp_path / "store")
    refresh = lambda now, **more: N.refresh_narratives(tree(spark, now), path, "pack", "root", **more)
    assert refresh(files) == 3
    assert stored(spark, path) == fresh(spark, files)
    assert refresh(files) == 0
    files = {"a.py": files["a.py"], "b.py": (module("New", "More"), 2), "d.py": (module("Four"), 1)}
    assert refresh(files) == 2
    assert stored(spark, path) == fresh(spark, files)
    assert refresh({}) == 0
    assert stored(spark, path) == []
    assert refresh(files) == 3
    assert stored(spark, path) == fresh(spark, files)


def test_batches_are_rewritten_as_one(spark, tmp_path):
    path, files = str(tmp_path / "store"), {}
    for step in range(4):
        files[f"m{step}.py"] = (module(f"Part {step}"), step)
        assert N.refresh_narratives(tree(spark, files), path, "pack", "root", max_batches=2) == 1
        manifest = spark.read.parquet(tables.current_version(spark, path))
        assert manifest.select("batch").distinct().count() <= 2
        assert stored(spark, path) == fresh(spark, files)


def test_a_stopped_refresh_leaves_the_store(spark, tmp_path, monkeypatch):
    path, files = str(tmp_path / "store"), {"a.py": (module("One"), 1)}
    N.refresh_narratives(tree(spark, files), path, "pack", "root")
    before = stored(spark, path)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "publish_version", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            N.refresh_narratives(tree(spark, {"a.py": (module("Two"), 2)}), path, "pack", "root")
    assert stored(spark, path) == before
    with pytest.raises(FileNotFoundError):
        N.read_narratives(spark, str(tmp_path / "none"), symbols(spark))


def test_refresh_of_files_on_disk(spark, tmp_path):
    root, path = tmp_path / "root", str(tmp_path / "store")
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.py").write_text(module("One"))
    (root / "b.txt").write_text(module("Two"))
    files = records.scan_source_tree(spark, str(root), ".py")
    listing = records.list_source_tree(spark, str(root), ".py")
    assert [r["path"] for r in listing.collect()] == ["sub/a.py"]
    assert N.refresh_narratives(files, path, "pack", "root", listing=listing) == 1
    assert N.refresh_narratives(files, path, "pack", "root", listing=listing) == 0
    assert [r[0] for r in stored(spark, path)] == ["sub/a.py", "sub/a.py"]


def entries(spark, rows):
    return G.precondition_entries(
        spark.createDataFrame(rows, "seq long, symbol_id string, qualname string, kind string, module string"),
        {"Ring": "from pack import Ring"},
    )


def test_precondition_graph_round_trip(spark, tmp_path):
    rows = [(i, f"m{i % 3}.C{i % 5}.f{i % 4}", f"C{i % 5}.f{i % 4}", ("method", "class")[i % 2], "m") for i in range(40)]
    rows += [(50, "r", "Ring", "class", "m"), (51, " ", "x", "class", "m"), (52, "n", "N", None, None)]
    made = entries(spark, rows)
    path = str(tmp_path / "graph")
    tables.write_precondition_graph(path, made, "symbols.jsonl", "2024-01-01T00:00:00Z", buckets=8)
    graph = tables.read_precondition_graph(spark, path)
    names = spark.createDataFrame([(n,) for n in ("f1", " f2 ", "C3", "C1.f3", "Ring", "none", "", None)], "name string")
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(graph.nodes.drop("bucket")) == plain(G.precondition_nodes(made))
    assert plain(graph.lookup_by_tail(names)) == plain(G.lookup_by_tail(names, made))
    assert plain(graph.methods_of(names)) == plain(G.methods_of(names, made))
    assert plain(graph.class_node(names)) == plain(G.class_node(names, G.precondition_nodes(made)))
    assert graph.meta.first()["source_path"] == "symbols.jsonl"


def test_a_lookup_reads_the_folder_of_its_name(spark, tmp_path):
    rows = [(i, f"m.f{i}", f"f{i}", "function", "m") for i in range(200)]
    path = str(tmp_path / "graph")
    tables.write_precondition_graph(path, entries(spark, rows), buckets=16)
    graph = tables.read_precondition_graph(spark, path)
    one = graph.lookup_by_tail(spark.createDataFrame([("f7",)], "name string"))
    read = {f.split("/bucket=")[1].split("/")[0] for f in graph._of(graph.tails, spark.createDataFrame([("f7",)], "name string"), F.col("name")).inputFiles()}
    assert [r["symbol_id"] for r in one.collect()] == ["m.f7"]
    plan = graph._of(graph.tails, spark.createDataFrame([("f7",)], "name string"), F.col("name"))
    seen = {r[0] for r in plan.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("/bucket=")[1].split("/")[0] for f in seen}) == 1 and read


def test_an_empty_precondition_graph(spark, tmp_path):
    path = str(tmp_path / "graph")
    with pytest.raises(FileNotFoundError):
        tables.read_precondition_graph(spark, path)
    tables.write_precondition_graph(path, entries(spark, []))
    graph = tables.read_precondition_graph(spark, path)
    names = spark.createDataFrame([("f",)], "name string")
    assert graph.nodes.count() == graph.lookup_by_tail(names).count() == graph.class_node(names).count() == 0


def graph_of(spark, rows):
    made = spark.createDataFrame(rows, "seq long, symbol_id string, qualname string, module string, kind string")
    all_ = G.symbol_entries(made)
    return G.SymbolGraph(all_, G.symbol_nodes(all_), spark.createDataFrame([], "workflow_id string, key string"))


def test_classes_list_a_common_tail_once(spark):
    graph = graph_of(spark, [(i, f"m.C{i}.run", f"C{i}.run", "m", "method") for i in range(30)])
    refs = spark.createDataFrame([(r,) for r in ("run", " RUN", "Run ", "C3.run", "none", "", None)], "ref string")
    asked, members = G.ref_classes(refs, graph.nodes)
    assert asked.count() == 5
    assert members.filter("text = 'run'").count() == 30
    assert G.resolve_refs(refs, graph.nodes).count() == 3 * 30 + 1
    best = {r["ref"]: r["key"] for r in G.first_resolved(refs, graph.nodes).collect()}
    assert best == {"run": "m.c0.run", " RUN": "m.c0.run", "Run ": "m.c0.run", "C3.run": "m.c3.run"}


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_related_symbols_equal_scoring_all(spark, limit):
    words = ["solve", "ring", "gen", "op", "x_y", "long_name"]
    rows = []
    for i in range(60):
        tail = "_".join(words[j] for j in range(6) if (i * 7 >> j) & 1) or "t"
        rows.append((i, f"mod{i % 2}.K{i % 3}.{tail}{i % 9}", f"K{i % 3}.{tail}{i % 9}", f"mod{i % 2}", "method"))
    graph = graph_of(spark, rows)
    groups = [("module", "mod0"), ("module", "mod1"), ("owner", "K0"), ("owner", "K2"), ("owner", "none")]
    tokens = [["solve", "mod0", "k"], ["ring", "gen", "zzz"], [], ["op", "op", "x_y", "éa"], None, ["k2", "mod1"]]
    asked = [(q, t, k, g) for q, t in enumerate(tokens) for k, g in groups]
    got = G.best_related(
        spark.createDataFrame(asked + asked[:3], "question_id long, tokens array<string>, group_kind string, group_key string"),
        graph,
        limit,
    )
    nodes = {r["key"]: r for r in graph.nodes.collect()}
    member = {}
    for r in graph.entries.collect():
        member.setdefault(("module", r["module"]), set()).add(r["key"])
        member.setdefault(("owner", r["owner"]), set()).add(r["key"])
    names = {k: " ".join(v for v in (r["qualname"], r["module"], r["owner"], r["tail"]) if v).lower() for k, r in nodes.items()}
    want = set()
    for q, t, kind, group in asked:
        # Stable sorts from the last key to the first.
        order = sorted(member.get((kind, group), ()))
        order.sort(key=lambda k: nodes[k]["tail"].lower(), reverse=True)
        order.sort(key=lambda k: -sum(x in names[k] for x in t or []))
        want |= {(q, kind, group, k, n + 1) for n, k in enumerate(order[:limit])}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("broadcast", [200_000, 50])
def test_related_symbols_are_scored_in_tasks_of_bounded_size(spark, monkeypatch, broadcast):
    """However few members there are, many questions do not meet them in one task."""
    rows = [(i, f"mod.K{i % 2}.t{i}", f"K{i % 2}.t{i}", "mod", "method") for i in range(40)]
    graph = graph_of(spark, rows)
    asked = [(q, [f"t{q % 5}"], k, g) for q in range(30) for k, g in (("module", "mod"), ("owner", "K1"))]
    asked = spark.createDataFrame(asked, "question_id long, tokens array<string>, group_kind string, group_key string")
    whole = {tuple(r) for r in G.best_related(asked, graph, 3).collect()}
    monkeypatch.setattr(G, "RELATED_CELLS", 50)
    monkeypatch.setattr(G, "BROADCAST_ROWS", broadcast)
    best = G.best_related(asked, graph, 3)
    assert {tuple(r) for r in best.collect()} == whole and len(whole) == 30 * 2 * 3
    if broadcast > 50:
        # 30 questions meet 40 and 20 members.
        assert best.rdd.getNumPartitions() == 30 * (40 + 20) // 50


@pytest.mark.parametrize("broadcast", [200_000, 5])
def test_sections_of_equal_symbols_meet_a_question_once(spark, monkeypatch, broadcast):
    sections = {f"s{i:02d}": ("a", "b") for i in range(30)} | {"s99": ("a",), "s10x": ("b", "c"), None: ("c",)}
    referred = spark.createDataFrame([(k, s) for s, keys in sections.items() for k in keys], "key string, section string")
    gains = [(1, "a", 1.0), (1, "b", 0.5), (1, "c", 0.5), (1, "a", 0.25), (2, "a", 1.0), (2, "z", 9.0), (3, "c", 1.0)]
    lifted = spark.createDataFrame(gains, "question_id long, key string, value double")
    asked = []
    plain = G._tasks
    monkeypatch.setattr(G, "_tasks", lambda left, right, keys: asked.append(right.count()) or plain(left, right, keys))
    monkeypatch.setattr(G, "BROADCAST_ROWS", broadcast)
    got = {tuple(r) for r in G.best_sections(lifted, referred, 4).collect()}
    assert got == {
        *[(1, f"s{i:02d}", 1.75) for i in range(4)], *[(2, f"s{i:02d}", 1.0) for i in range(4)],
        (3, None, 1.0), (3, "s10x", 1.0),
    }
    # Symbols of four sets, not of 33 sections.
    assert asked == [6]


def test_questions_escalate_once(spark):
    """Only automatic routes, by a missing piece, a gap or no pass; no outcome leaves the state."""
    from granary.plans import answer as A

    routes = ["auto", "auto_fast", "fast", "plan", "auto", "auto", "auto"]
    states = spark.createDataFrame(
        [(i, "auto", r, "why", 0.5, 1, 1, i == 5) for i, r in enumerate(routes)],
        "question_id long, mode string, route_mode string, reason string, confidence double, budget int, "
        "passes int, escalated boolean",
    )
    tried = [
        (0, "error", "NameError: x is not defined", None, False),
        (0, "success", None, False, False),
        (1, "success", "", True, True),
        (2, "error", "", True, False),
        (3, "error", "", True, False),
        (5, "error", "", True, False),
        (6, "success", None, None, True),
    ]
    outcomes = spark.createDataFrame(
        tried, "question_id long, status string, errors string, missing boolean, passed boolean"
    )
    rows = A.escalate_questions(states, outcomes)
    got = {r["question_id"]: (r["route_mode"], r["budget"], r["escalated"]) for r in rows.collect()}
    assert rows.columns == states.columns
    assert got == {
        0: ("plan", 0, True), 1: ("plan", 0, True), 2: ("fast", 1, False), 3: ("plan", 1, False),
        4: ("auto", 1, False), 5: ("auto", 1, True), 6: ("auto", 1, False),
    }
    assert {r["route_mode"] for r in A.escalate_questions(states, outcomes.limit(0)).collect()} == set(routes)
