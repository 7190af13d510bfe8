"""Symbol graph: nodes, reference resolution, edges and expansion.

Lookup sides are left to adaptive execution: it broadcasts them when their
measured size allows and splits hot keys of the other side when not.

The graph is a set of tables. ``entries`` holds one row per symbol id as
first seen; ``nodes`` one row per lower-cased id (``key``). Groups (symbols of
a module, methods of a class, ...) stay rows: a group of any size is never
gathered into one array or one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import vocab
from granary.functions import text as T
from granary.runtime import BROADCAST_ROWS, at_most, key_blocks, let, materialize

NODE_FIELDS = ("symbol_id", "qualname", "module", "kind", "owner", "tail")


def key_of(c: Column | str) -> Column:
    return F.lower(T.strip(c))


# ---- nodes -------------------------------------------------------------------


def symbol_entries(rows: DataFrame) -> DataFrame:
    """First row per symbol id. ``rows``: seq, symbol_id, qualname, module, kind."""
    ident = T.strip(F.coalesce(T.blank_to_null("symbol_id"), F.col("qualname")))
    name = T.strip(F.coalesce(T.blank_to_null("qualname"), F.col("symbol_id")))
    named = rows.select(
        "seq",
        ident.alias("symbol_id"),
        name.alias("qualname"),
        T.strip("module").alias("module"),
        T.strip("kind").alias("kind"),
    ).filter("symbol_id <> '' AND qualname <> ''")
    first = named.groupBy("symbol_id").agg(
        F.min(F.struct("seq", "qualname", "module", "kind")).alias("r")
    )
    return first.select(
        "r.seq",
        key_of("symbol_id").alias("key"),
        "symbol_id",
        "r.qualname",
        "r.module",
        "r.kind",
        T.owner_of("r.qualname").alias("owner"),
        T.tail_of("r.qualname").alias("tail"),
    )


def chunk_symbols(chunks: DataFrame) -> DataFrame:
    """Symbol rows of a chunk table, in chunk order."""
    return chunks.filter(
        (F.col("source_type") == "generated") & (T.or_empty("kind") != "module_reference")
    ).select(F.col("chunk_id").alias("seq"), "symbol_id", "qualname", "module", "kind")


def symbol_nodes(entries: DataFrame) -> DataFrame:
    """One node per lower-cased id; the last spelling wins."""
    last = entries.groupBy("key").agg(
        F.max(F.struct("seq", *NODE_FIELDS)).alias("r")
    )
    return last.select("key", *[F.col(f"r.{field}") for field in NODE_FIELDS])


def group_symbols(entries: DataFrame) -> DataFrame:
    """(group_kind, group_key, symbol): modules, owners, tails, class methods."""
    is_method = F.col("kind") == "method"
    groups = T.row_array(
        ("group_kind", "group_key"),
        (F.lit("module"), F.col("module")),
        (F.lit("owner"), F.col("owner")),
        (F.lit("tail"), F.lower("tail")),
        (F.lit("method"), F.when(is_method, T.tail_of("owner")).otherwise("")),
    )
    return (
        entries.select(F.inline(groups), F.col("key").alias("symbol"))
        .filter("group_key <> ''")
    )


# ---- references -----------------------------------------------------------------


def _node_texts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every text one of the ``wanted`` references can match, with its priority.

    Of a dotted name only endings are made that are as long as some dotted
    reference, however long the names are.
    """
    name = F.lower("qualname")
    asked = wanted.filter(F.contains("text", F.lit("."))).agg(F.collect_set(F.length("text"))).scalar()
    tail = F.length(F.substring_index(name, ".", -1))
    nodes = nodes.withColumn("__asked", asked)
    lengths = F.filter("__asked", lambda n: (n > tail) & (n <= F.length(name)))
    dotted = F.when(
        F.contains(name, F.lit(".")),
        F.transform(
            lengths, lambda n: F.struct(F.lit(2).alias("priority"), F.right(name, n).alias("text"))
        ),
    ).otherwise(F.array().cast("array<struct<priority:int,text:string>>"))
    exact = T.row_array(
        ("priority", "text"),
        (F.lit(0), F.col("key")),
        (F.lit(1), name),
        (F.lit(2), F.lower("tail")),
    )
    return nodes.select("key", F.inline_outer(F.concat(exact, dotted)))


def ref_classes(
    refs: DataFrame, nodes: DataFrame, allow_spaces: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(asked, members): (ref, text) of every reference, (text, key, priority) of the
    symbols a text names.

    However many references spell one text, its symbols are listed once, so both
    tables together are bounded by the references plus the texts of the symbols.
    Exact id (0), exact qualified name (1), then equal tail (plain references)
    or any qualified name that ends with the reference (dotted ones). Endings
    are made on the symbol side, so all of it is one equi join. References that
    are NULL or blank name nothing.
    """
    asked = refs.select("ref", key_of("ref").alias("text")).distinct().filter("text <> ''")
    if not allow_spaces:
        asked = asked.filter(~F.contains("text", F.lit(" ")))
    texts = asked.select("text").distinct()
    # A dotted reference never equals a tail, a plain one never a dotted suffix.
    members = _node_texts(nodes, texts).join(texts, "text", "left_semi")
    return asked, members.groupBy("text", "key").agg(F.min("priority").alias("priority"))


def resolve_refs(refs: DataFrame, nodes: DataFrame, allow_spaces: bool = True) -> DataFrame:
    """(ref, key, priority): symbols a reference names; order by priority, key.

    The classes of ``ref_classes`` written out. Matches are not numbered, since
    a common tail may name most symbols.
    """
    asked, members = ref_classes(refs, nodes, allow_spaces)
    return asked.join(members, "text").select("ref", "key", "priority")


def first_resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, key): the best match only. The best of a text is taken before the
    references meet it, so no reference meets all symbols of a common tail."""
    asked, members = ref_classes(refs, nodes)
    best = members.groupBy("text").agg(F.min(F.struct("priority", "key"))["key"].alias("key"))
    return asked.join(best, "text").select("ref", "key")


def symbol_lookup(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact, tails, suffixes) tables of (text, symbol_id) from symbol records.

    ``symbols``: seq, symbol_id, qualname. Of equal texts the last record wins
    in the exact table; tails keep every record.
    """
    rows = symbols.select(
        "seq", T.strip("symbol_id").alias("symbol_id"), T.strip("qualname").alias("qualname")
    ).filter("symbol_id <> ''")
    texts = T.row_array(
        ("nth", "text"), (F.lit(0), F.lower("symbol_id")), (F.lit(1), F.lower("qualname"))
    )
    index = rows.select("seq", "symbol_id", F.inline(texts)).filter("text <> ''")
    exact = index.groupBy("text").agg(
        F.max(F.struct("seq", "nth", "symbol_id"))["symbol_id"].alias("symbol_id")
    )
    tail = T.tail_of(F.coalesce(T.blank_to_null("qualname"), F.col("symbol_id")))
    tails = rows.select(F.lower(tail).alias("text"), "symbol_id").filter("text <> ''").distinct()
    dotted = exact.filter(F.contains("text", F.lit(".")))
    suffixes = dotted.select(F.substring_index("text", ".", -1).alias("text"), "symbol_id")
    return exact, tails, suffixes.distinct()


def _handed_out(texts: DataFrame) -> DataFrame:
    """A lookup table written once, and marked for broadcast if its rows are few."""
    written = materialize(texts, "symbol-texts")
    return F.broadcast(written) if at_most(written, BROADCAST_ROWS) else written


def resolve_refs_tiered(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(section_id, symbol_id, pos): the first tier that hits answers.

    Exact id or name, else every symbol of that tail, else ids that end with
    the tail. ``refs``: section_id, pos, ref. Symbol texts that are few meet the
    references by broadcast, so a reference that most sections have fills no task.
    """
    exact, tails, suffixes = map(_handed_out, symbol_lookup(symbols))
    ref = F.regexp_replace(T.strip("ref"), r"\(\)\z", "")
    asked = refs.select(
        "section_id", "pos", F.lower(ref).alias("full"), F.lower(T.tail_of(ref)).alias("tail")
    ).filter("full <> ''")
    first = asked.join(exact, asked["full"] == exact["text"])
    missed = asked.join(exact, asked["full"] == exact["text"], "left_anti")
    second = missed.join(tails, missed["tail"] == tails["text"])
    rest = missed.join(tails, missed["tail"] == tails["text"], "left_anti")
    third = rest.join(suffixes, rest["tail"] == suffixes["text"])
    parts = [part.select("section_id", "pos", "symbol_id") for part in (first, second, third)]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("section_id", "symbol_id").agg(F.min("pos").alias("pos"))


def workflow_seeds(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(workflow_id, key): symbols that a workflow's preferred symbols name."""
    wanted = workflows.select(
        F.col("id").alias("workflow_id"), F.explode("preferred_symbols").alias("ref")
    )
    found = resolve_refs(wanted, nodes, allow_spaces=False)
    return wanted.join(found, "ref").select("workflow_id", "key").distinct()


def workflow_ids(seeds: DataFrame) -> DataFrame:
    """Workflows per symbol; at most as many as the registry has."""
    return seeds.groupBy("key").agg(F.sort_array(F.collect_set("workflow_id")).alias("ids"))


def narrative_edges(narratives: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (edge_type, src, dst): refers, referred_by, module narratives."""
    rows = narratives.select(
        T.strip("section_id").alias("section_id"),
        T.strip("module").alias("module"),
        "resolved_symbol_ids",
    ).filter("section_id <> ''")
    refs = (
        rows.select("section_id", F.explode("resolved_symbol_ids").alias("ref"))
        .select("section_id", key_of("ref").alias("key"))
        .join(nodes.select("key"), "key", "left_semi")
        .distinct()
    )
    both = T.row_array(
        ("edge_type", "src", "dst"),
        (F.lit("refers"), F.col("section_id"), F.col("key")),
        (F.lit("referred_by"), F.col("key"), F.col("section_id")),
    )
    modules = rows.filter("module <> ''").select(
        F.lit("module").alias("edge_type"),
        F.col("module").alias("src"),
        F.col("section_id").alias("dst"),
    )
    return refs.select(F.inline(both)).unionByName(modules.distinct())


# ---- expansion --------------------------------------------------------------------


@dataclass(frozen=True)
class SymbolGraph:
    """Tables of one graph; ``edges`` may be None for a graph without narratives."""

    entries: DataFrame
    nodes: DataFrame
    seeds: DataFrame
    edges: DataFrame | None = None


def symbol_graph(
    chunks: DataFrame, workflows: DataFrame, narratives: DataFrame | None = None
) -> SymbolGraph:
    """Graph of a chunk table. Its tables are written once to the shared
    folder, since every expansion reads each of them several times."""
    entries = materialize(symbol_entries(chunk_symbols(chunks)), "entries")
    nodes = materialize(symbol_nodes(entries), "nodes")
    seeds = materialize(workflow_seeds(workflows, nodes), "seeds")
    if narratives is None:
        return SymbolGraph(entries, nodes, seeds)
    return SymbolGraph(
        entries, nodes, seeds, materialize(narrative_edges(narratives, nodes), "edges")
    )


def node_names() -> Column:
    """The text a question's tokens are looked up in."""
    return F.lower(
        F.concat_ws(" ", *[T.blank_to_null(c) for c in ("qualname", "module", "owner", "tail")])
    )


def query_affinity(tokens: Column, names: Column | None = None) -> Column:
    """Query tokens contained in the names of a node."""
    text_of = node_names() if names is None else names
    return let(text_of, lambda text: F.size(F.filter(tokens, lambda t: F.contains(text, t))))


# Meetings of questions with what they are scored against that a task makes.
RELATED_CELLS = 250_000


def _tasks(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Least number of tasks, and that of a join whose tasks make about ``RELATED_CELLS``
    rows. Counts of both sides by key give the rows without making them."""
    n = left.groupBy(*keys).agg(F.count("*").alias("n"))
    m = right.groupBy(*keys).agg(F.count("*").alias("m"))
    cells = n.join(m, keys).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least, max(least, -(-cells // RELATED_CELLS))


def best_related(
    asked: DataFrame, graph: SymbolGraph, limit: int
) -> DataFrame:
    """(question_id, group_kind, group_key, key, nth): best symbols of a group.

    ``asked``: question_id, tokens, group_kind, group_key. Every asked group meets
    all of its members, and the number of tasks grows with these meetings, so a
    task scores about ``RELATED_CELLS`` of them however many there are. Members
    are broadcast and questions dealt to the tasks; members too long for that are
    dealt instead, and the questions come in blocks of bounded size.
    """
    group = ["group_kind", "group_key"]
    groups = group_symbols(graph.entries).filter("group_kind IN ('module', 'owner')")
    members = groups.withColumnRenamed("symbol", "key").distinct().join(graph.nodes, "key")
    members = materialize(
        members.select(*group, "key", F.lower("tail").alias("tail"), node_names().alias("names")),
        "group-members",
    )
    wanted = materialize(asked.dropDuplicates(["question_id", *group]), "asked-groups")
    least, parts = _tasks(wanted, members, group)
    if at_most(members, BROADCAST_ROWS):
        dealt = wanted.repartition(parts, "question_id", *group)
        met = [dealt.join(F.broadcast(members), group)]
    else:
        blocks = list(key_blocks(wanted, "question_id", BROADCAST_ROWS // 10))
        dealt = members.repartition(max(least, -(-parts // len(blocks))), "key")
        met = [dealt.join(F.broadcast(block), group) for block in blocks]
    scored = reduce(DataFrame.unionByName, met).select(
        "question_id",
        "group_kind",
        "group_key",
        "key",
        query_affinity(F.col("tokens"), F.col("names")).alias("affinity"),
        "tail",
    )
    order = Window.partitionBy("question_id", "group_kind", "group_key").orderBy(
        F.desc("affinity"), F.desc("tail"), F.asc("key")
    )
    return (
        scored.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= limit)
        .select("question_id", "group_kind", "group_key", "key", "nth")
    )


# What a seed adds to itself and its neighbours.
PREFERRED = {"self": 3.0, "owner": (6, 1.8), "owner_node": 1.2, "module": (5, 1.0)}
RETRIEVED = {"self": 0.5, "owner": (4, 0.8), "module": (3, 0.35)}
AFFINITY_WEIGHT = 0.15
NARRATIVE_WEIGHT = 0.4
RESULT_WEIGHT = 0.3
GRAPH_CANDIDATES = 18
SEED_RESULTS = 4
NARRATIVE_SYMBOLS = 10
NARRATIVE_LIMIT = 4


def result_symbols(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question_id, chunk_id, rank, score, key) of results that map to a node."""
    own = results.withColumn("key", key_of("symbol_id"))
    direct = own.filter("key <> ''").join(nodes.select("key"), "key", "left_semi")
    rest = own.drop("key").join(
        direct.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti"
    )
    names = rest.filter(T.or_empty("qualname") != "").withColumn("ref", F.col("qualname"))
    resolved = names.join(first_resolved(names, nodes), "ref")
    columns = ("question_id", "chunk_id", "rank", "score", "key")
    return direct.select(*columns).unionByName(resolved.select(*columns))


def symbol_chunks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, chunk_id): the last generated chunk of a symbol, by id or name."""
    made = chunks.filter(F.col("source_type") == "generated")

    def last(name: str) -> DataFrame:
        return (
            made.filter(T.or_empty(name) != "")
            .groupBy(key_of(name).alias("__k"))
            .agg(F.max("chunk_id").alias(f"by_{name}"))
        )

    ids, names = last("symbol_id"), last("qualname")
    return (
        nodes.select("key", key_of("qualname").alias("name"))
        .join(ids, F.col("key") == ids["__k"], "left")
        .drop("__k")
        .join(names, F.col("name") == names["__k"], "left")
        .select("key", F.coalesce("by_symbol_id", "by_qualname").alias("chunk_id"))
        .filter("chunk_id IS NOT NULL")
    )


def narrative_chunks(chunks: DataFrame) -> DataFrame:
    """(section, chunk_id): the last narrative chunk of a section."""
    section = F.coalesce(T.blank_to_null("symbol_id"), F.col("section_title"))
    return (
        chunks.filter(F.col("source_type") == "narrative")
        .select(section.alias("section"), "chunk_id")
        .filter("section <> ''")
        .groupBy("section")
        .agg(F.max("chunk_id").alias("chunk_id"))
    )


def _seed_parts(
    seeds: DataFrame, graph: SymbolGraph, related: DataFrame, weights: Mapping
) -> list[DataFrame]:
    """Additive (question_id, key, value) rows of one kind of seed."""
    homes = seeds.join(graph.nodes.select("key", "owner", "module"), "key")
    parts = [seeds.select("question_id", "key", F.lit(weights["self"]).alias("value"))]
    for kind in ("owner", "module"):
        limit, value = weights[kind]
        near = related.filter((F.col("group_kind") == kind) & (F.col("nth") <= limit))
        near = near.select(
            "question_id", F.col("group_key").alias(kind), F.col("key").alias("other")
        )
        parts.append(
            homes.join(near, ["question_id", kind])
            .filter("other <> key")
            .select("question_id", F.col("other").alias("key"), F.lit(value).alias("value"))
        )
    if "owner_node" in weights:
        owners = homes.filter("owner <> ''").withColumn("ref", F.col("owner"))
        found = resolve_refs(owners, graph.nodes).select("ref", F.col("key").alias("other"))
        parts.append(
            owners.join(found, "ref")
            .filter("other <> key")
            .select(
                "question_id",
                F.col("other").alias("key"),
                F.lit(weights["owner_node"]).alias("value"),
            )
        )
    return parts


def graph_expand(
    questions: DataFrame, results: DataFrame, chunks: DataFrame, graph: SymbolGraph
) -> DataFrame:
    """Results with graph neighbours merged in: question_id, chunk_id, rank, score.

    ``questions``: question_id, text, workflow_id, preferred_symbols.
    ``results``: question_id, chunk_id, rank, score. Questions without a
    workflow, results or seeds keep their list.
    """
    active = questions.filter(F.col("workflow_id") != "").select(
        "question_id",
        "workflow_id",
        "preferred_symbols",
        T.query_tokens("text", vocab.GRAPH_STOPWORDS).alias("tokens"),
    )
    results = materialize(
        results.select("question_id", "chunk_id", "rank", "score"), "results"
    )
    active = materialize(
        active.join(results.select("question_id").distinct(), "question_id", "left_semi"),
        "active",
    )
    listed = results.join(active.select("question_id"), "question_id", "left_semi")
    columns = ("chunk_id", "symbol_id", "qualname", "section_title", "source_type")
    typed = materialize(listed.join(chunks.select(*columns), "chunk_id"), "typed")

    # Seeds: the workflow's symbols, else what its preferred symbols resolve to.
    by_workflow = active.join(graph.seeds, "workflow_id").select("question_id", "key")
    unseeded = active.join(graph.seeds, "workflow_id", "left_anti").select(
        "question_id", F.explode("preferred_symbols").alias("ref")
    )
    by_symbol = unseeded.join(resolve_refs(unseeded, graph.nodes), "ref")
    preferred = materialize(
        by_workflow.unionByName(by_symbol.select("question_id", "key")), "preferred"
    )
    mapped = materialize(result_symbols(typed, graph.nodes), "mapped")
    by_rank = Window.partitionBy("question_id").orderBy("rank")
    retrieved = (
        mapped.withColumn("n", F.row_number().over(by_rank))
        .filter(F.col("n") <= SEED_RESULTS)
        .select("question_id", "key")
    )

    seeds = preferred.unionByName(retrieved).distinct()
    homes = seeds.join(graph.nodes.select("key", "owner", "module"), "key")
    groups = T.row_array(
        ("group_kind", "group_key"),
        (F.lit("owner"), F.col("owner")),
        (F.lit("module"), F.col("module")),
    )
    asked = (
        homes.select("question_id", F.inline(groups))
        .filter("group_key <> ''")
        .join(active.select("question_id", "tokens"), "question_id")
    )
    most = max(PREFERRED["owner"][0], PREFERRED["module"][0])
    related = materialize(best_related(asked, graph, most), "related")
    parts = _seed_parts(preferred, graph, related, PREFERRED) + _seed_parts(
        retrieved, graph, related, RETRIEVED
    )
    summed = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("question_id", "key")
        .agg(F.sum("value").alias("value"))
        .join(graph.nodes, "key")
        .join(active.select("question_id", "tokens"), "question_id")
        .withColumn("affinity", query_affinity(F.col("tokens")))
        .withColumn(
            "value", F.round(F.col("value") + F.lit(AFFINITY_WEIGHT) * F.col("affinity"), 9)
        )
    )
    top = Window.partitionBy("question_id").orderBy(
        F.desc("value"), F.desc("affinity"), F.asc("key")
    )
    scored = materialize(
        summed.withColumn("nth", F.row_number().over(top))
        .filter(F.col("nth") <= GRAPH_CANDIDATES)
        .select("question_id", "key", "value", "nth"),
        "scored",
    )
    places = symbol_chunks(chunks, graph.nodes)
    gains = [scored.join(places, "key").select("question_id", "chunk_id", "value")]
    if graph.edges is not None:
        gains += _narrative_gains(scored, typed, mapped, places, chunks, graph.edges)

    grown = seeds.select("question_id").distinct()
    base = listed.join(grown, "question_id", "left_semi").select(
        "question_id", "chunk_id", F.col("score").alias("value")
    )
    merged = (
        reduce(DataFrame.unionByName, [base, *gains])
        .groupBy("question_id", "chunk_id")
        .agg(F.round(F.sum("value"), 9).alias("score"))
        .join(chunks.select("chunk_id", "source_type"), "chunk_id")
    )
    final = Window.partitionBy("question_id").orderBy(
        F.desc("score"), F.desc(F.col("source_type") == "generated"), F.asc("chunk_id")
    )
    expanded = merged.withColumn("rank", F.row_number().over(final)).select(
        "question_id", "chunk_id", "rank", "score"
    )
    same = results.join(grown, "question_id", "left_anti")
    return expanded.unionByName(same)


def best_sections(lifted: DataFrame, referred: DataFrame, limit: int) -> DataFrame:
    """(question_id, section, value): sections with the largest sums over their symbols.

    ``lifted``: question_id, key, value; ``referred``: key, section. Sections that refer
    to the same symbols have one value for a question, so a question meets each set of
    symbols once; of a set only its first ``limit`` sections can be among the best.
    """

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), F.col("key")).cast("decimal(20,0)"))

    # The number of symbols and two sums of 64-bit hashes name a set, in any order.
    sets = referred.groupBy("section").agg(F.struct(F.count("*"), total(1), total(2)).alias("symbols"))
    same = Window.partitionBy("symbols").orderBy("section")
    heads = materialize(
        sets.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= limit), "section-heads"
    )
    firsts = heads.filter("place = 1").select("symbols", F.col("section").alias("first"))
    members = materialize(
        referred.join(firsts, F.col("section").eqNullSafe(F.col("first"))).select("symbols", "first", "key"),
        "section-symbols",
    )
    # Dealt by question, sums and orders need no further shuffle.
    _, parts = _tasks(lifted, members, ["key"])
    if at_most(members, BROADCAST_ROWS):
        met = lifted.repartition(parts, "question_id").join(F.broadcast(members), "key")
    else:
        met = lifted.join(members, "key").repartition(parts, "question_id")
    sums = met.groupBy("question_id", "symbols", "first").agg(F.round(F.sum("value"), 9).alias("value"))

    def top(rows: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("question_id").orderBy(F.desc("value"), F.asc(name))
        return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).drop("nth")

    sections = top(sums, "first").join(heads.select("symbols", "section"), "symbols")
    return top(sections, "section").select("question_id", "section", "value")


def _narrative_gains(
    scored: DataFrame,
    typed: DataFrame,
    mapped: DataFrame,
    places: DataFrame,
    chunks: DataFrame,
    edges: DataFrame,
) -> list[DataFrame]:
    """Symbols lift narratives that refer to them, and the other way round."""
    referred = edges.filter("edge_type = 'referred_by'").select(
        F.col("src").alias("key"), F.col("dst").alias("section")
    )
    refers = edges.filter("edge_type = 'refers'").select(
        F.col("src").alias("section"), F.col("dst").alias("key")
    )
    from_symbols = scored.filter(F.col("nth") <= NARRATIVE_SYMBOLS).select(
        "question_id", "key", (F.col("value") * NARRATIVE_WEIGHT).alias("value")
    )
    from_results = mapped.filter(F.col("rank") <= SEED_RESULTS).select(
        "question_id", "key", (F.col("score") * RESULT_WEIGHT).alias("value")
    )
    lifted = materialize(from_symbols.unionByName(from_results), "lifting")
    up = (
        best_sections(lifted, referred, NARRATIVE_LIMIT)
        .join(narrative_chunks(chunks), "section")
        .select("question_id", "chunk_id", "value")
    )
    section = F.coalesce(T.blank_to_null("symbol_id"), F.col("section_title"))
    down = (
        typed.filter(F.col("source_type") == "narrative")
        .select("question_id", section.alias("section"), (F.col("score") * RESULT_WEIGHT).alias("value"))
        .join(refers, "section")
        .join(places, "key")
        .select("question_id", "chunk_id", "value")
    )
    return [up, down]


# ---- preconditions ---------------------------------------------------------------------


def import_map(imports: Mapping[str, str]) -> Column:
    items = [F.lit(part) for pair in imports.items() for part in pair]
    return F.create_map(*items) if items else F.expr("cast(map() as map<string,string>)")


def precondition_entries(records: DataFrame, imports: Mapping[str, str]) -> DataFrame:
    """Symbol records with owner class, tail and canonical import statement.

    ``records``: seq, symbol_id, qualname, kind, module.
    """
    name, kind = T.strip("qualname"), T.strip("kind")
    method = F.col("kind") == "method"
    known = import_map(imports)
    head = F.substring_index("qualname", ".", 1)
    whole = F.when(~method, F.element_at(known, F.col("qualname")))
    rows = records.select(
        "seq",
        T.strip("symbol_id").alias("symbol_id"),
        name.alias("qualname"),
        T.strip("module").alias("module"),
        kind.alias("kind"),
    ).filter("symbol_id <> '' AND qualname <> '' AND kind <> ''")
    return rows.select(
        "*",
        F.when(method, T.tail_of(T.owner_of("qualname"))).otherwise("").alias("owner_class"),
        F.when(method, T.owner_of("qualname")).otherwise("").alias("owner_qualname"),
        T.tail_of("qualname").alias("tail"),
        F.coalesce(F.element_at(known, head), whole, F.lit("")).alias("import_statement"),
    )


PRECONDITION_FIELDS = (
    "qualname", "module", "kind", "owner_class", "owner_qualname", "tail", "import_statement",
)


def precondition_nodes(entries: DataFrame) -> DataFrame:
    """The last record per symbol id, with the place of its first one."""
    merged = entries.groupBy("symbol_id").agg(
        F.min("seq").alias("first_seq"),
        F.max(F.struct("seq", *PRECONDITION_FIELDS)).alias("r"),
    )
    return merged.select(
        "first_seq", "symbol_id", *[F.col(f"r.{field}") for field in PRECONDITION_FIELDS]
    )


def lookup_by_tail(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, seq, symbol_id): every record that ends in the name."""
    asked = names.select("name", T.strip("name").alias("tail")).distinct()
    return entries.select("seq", "symbol_id", "tail").join(
        asked, "tail"
    ).select("name", "seq", "symbol_id")


def class_node(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, symbol_id): the first class whose dotted name ends in the name."""
    parts = F.split("qualname", r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    classes = nodes.filter("kind = 'class'").select(
        "first_seq", "symbol_id", F.explode(ends).alias("text")
    )
    asked = names.select("name", T.strip("name").alias("text")).distinct().filter("text <> ''")
    found = classes.join(asked, "text")
    return found.groupBy("name").agg(
        F.min(F.struct("first_seq", "symbol_id"))["symbol_id"].alias("symbol_id")
    )


def methods_of(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, seq, symbol_id): methods of a class."""
    asked = names.select("name", T.strip("name").alias("owner_class")).distinct()
    methods = entries.filter("kind = 'method' AND owner_class <> ''")
    return methods.select("seq", "symbol_id", "owner_class").join(
        asked, "owner_class"
    ).select("name", "seq", "symbol_id")


# ---- imports ----------------------------------------------------------------------------


def imports_for_names(texts: DataFrame, imports: Mapping[str, str]) -> DataFrame:
    """(text_id, import_no, statement): imports a text needs and does not have.

    Order of first mention. A name is skipped where its text already imports it.
    """
    known = import_map(imports)
    names = F.transform(
        T.referenced_names("text"),
        lambda n, i: F.struct(
            F.element_at(known, n).alias("statement"), n.alias("name"), i.alias("pos")
        ),
    )
    rows = texts.select("text_id", imported_words("text").alias("have"), names.alias("names"))
    needed = rows.select("text_id", "have", F.inline_outer("names")).filter(
        F.col("statement").isNotNull() & ~F.array_contains("have", F.col("name"))
    )
    first = needed.groupBy("text_id", "statement").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("text_id").orderBy("pos")
    return first.select(
        "text_id", F.row_number().over(order).alias("import_no"), "statement"
    )


def imported_words(text: Column | str) -> Column:
    """Words after ``import`` on import lines."""
    value = T.or_empty(text)
    tails = F.concat(
        F.regexp_extract_all(
            value, F.lit(r"(?Umd)^\s*from\s+[A-Za-z0-9_.]+\s+import\s+(.*)$"), F.lit(1)
        ),
        F.regexp_extract_all(value, F.lit(r"(?Umd)^\s*import\s+(.*)$"), F.lit(1)),
    )
    return F.flatten(
        F.transform(tails, lambda t: F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0)))
    )


def defined_words(text: Column | str) -> Column:
    """Names a text defines as function, class or variable."""
    value = T.or_empty(text)
    return F.concat(
        F.regexp_extract_all(value, F.lit(r"(?Umd)^\s*(?:def|class)\s+(\w+)"), F.lit(1)),
        F.regexp_extract_all(value, F.lit(r"(?Umd)^\s*(\w+)\s*="), F.lit(1)),
    )


def import_module(module: Column | str, package: str) -> Column:
    """Module as it is imported: inside the package, '' if it cannot be."""
    m = T.strip(module)
    dotted = re.escape(package)
    return (
        F.when(m == "", F.lit(""))
        .when(m.rlike(rf"\A{dotted}(\.|\z)"), m)
        .when(
            F.contains(m, F.lit(".")) | m.rlike(r"(?U)\A[^\W\d]\w*\z"),
            F.concat(F.lit(package + "."), m),
        )
        .otherwise("")
    )


def import_symbol() -> Column:
    """Name to import for a result: the class of a method, else the tail."""
    source = T.strip(F.coalesce(T.blank_to_null("qualname"), F.col("symbol_id")))
    parts = F.filter(F.split(source, r"\."), lambda p: p != "")

    def pick(p):
        method = (F.lower(T.strip("kind")) == "method") & (F.size(p) >= 2)
        name = F.when(method, F.try_element_at(p, F.lit(-2))).otherwise(
            F.try_element_at(p, F.lit(-1))
        )
        return F.coalesce(name, F.lit(""))

    found = let(parts, pick)
    return F.when(found.rlike(rf"\A{vocab.IDENTIFIER}\z"), found).otherwise("")


def suggest_imports(
    results: DataFrame, texts: DataFrame, package: str, limit: int = 6
) -> DataFrame:
    """(question_id, import_no, statement): imports the results suggest.

    For generated results whose name the text mentions as a whole word, and
    neither imports nor defines. ``results``: question_id, rank and chunk
    columns; ``texts``: question_id, text.
    """
    words = texts.select(
        "question_id",
        F.regexp_extract_all(T.strip("text"), F.lit(r"(?U)\w+"), F.lit(0)).alias("words"),
        F.concat(imported_words(T.strip("text")), defined_words(T.strip("text"))).alias("bound"),
    )
    named = (
        results.filter(F.col("source_type") == "generated")
        .select(
            "question_id",
            "rank",
            import_module("module", package).alias("module"),
            import_symbol().alias("name"),
        )
        .filter((F.col("module") != "") & (F.col("name") != "") & (F.col("module") != package))
    )
    lines = (
        named.join(words, "question_id")
        .filter(F.array_contains("words", F.col("name")))
        .filter(~F.array_contains("bound", F.col("name")))
        .withColumn(
            "statement",
            F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.col("name")),
        )
        .groupBy("question_id", "statement")
        .agg(F.min("rank").alias("rank"))
    )
    order = Window.partitionBy("question_id").orderBy("rank")
    return (
        lines.withColumn("import_no", F.row_number().over(order))
        .filter(F.col("import_no") <= limit)
        .select("question_id", "import_no", "statement")
    )


def candidate_modules(results: DataFrame, package: str, limit: int = 2) -> DataFrame:
    """(question_id, module_no, module): first distinct modules of the results."""
    modules = (
        results.filter(F.col("source_type") == "generated")
        .select("question_id", "rank", import_module("module", package).alias("module"))
        .filter((F.col("module") != "") & (F.col("module") != package))
        .groupBy("question_id", "module")
        .agg(F.min("rank").alias("rank"))
    )
    order = Window.partitionBy("question_id").orderBy("rank")
    return (
        modules.withColumn("module_no", F.row_number().over(order))
        .filter(F.col("module_no") <= limit)
        .select("question_id", "module_no", "module")
    )
