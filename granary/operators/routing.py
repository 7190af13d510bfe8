"""Question routing: registry matching, gates, complexity and routes.

Everything that depends on one question alone is a Column expression, so it
needs no join, no shuffle, and runs on streaming tables as well. Registries
and rules of a bounded length enter as constants; longer ones stay tables that
questions are joined with.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import vocab
from granary.functions import text as T
from granary.operators.matching import occurrences
from granary.runtime import at_most, let, materialize

DEFAULT_NAMES = vocab.Names()
# Rows of a registry or rule table that are written into expressions.
CONSTANT_ROWS = 500


@dataclass(frozen=True)
class Family:
    id: str
    name: str
    summary: str = ""
    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Workflow:
    id: str
    family_id: str
    title: str
    summary: str = ""
    keywords: tuple[str, ...] = ()
    preferred_symbols: tuple[str, ...] = ()
    prompt_rules: tuple[str, ...] = ()
    tuning_params: tuple[str, ...] = ()


@dataclass(frozen=True)
class Registry:
    families: tuple[Family, ...]
    workflows: tuple[Workflow, ...] = ()

    @classmethod
    def of(
        cls, families: DataFrame, workflows: DataFrame | None = None, rows: int = CONSTANT_ROWS
    ) -> Registry | RegistryTables:
        """The registry as constants, or as tables if one has more than ``rows`` rows."""
        if any(t is not None and not at_most(t, rows) for t in (families, workflows)):
            return RegistryTables(families, workflows)

        def sorted_rows(table: DataFrame | None, order: str) -> list:
            if table is None:
                return []
            return sorted(table.limit(rows).collect(), key=lambda r: r[order])

        def words(row, name: str) -> tuple[str, ...]:
            return tuple(row[name] or ())

        return cls(
            tuple(
                Family(r["id"], r["name"], r["summary"], words(r, "keywords"))
                for r in sorted_rows(families, "family_no")
            ),
            tuple(
                Workflow(
                    r["id"],
                    r["family_id"],
                    r["title"],
                    r["summary"],
                    *[
                        words(r, name)
                        for name in ("keywords", "preferred_symbols", "prompt_rules", "tuning_params")
                    ],
                )
                for r in sorted_rows(workflows, "workflow_no")
            ),
        )


@dataclass(frozen=True)
class RegistryTables:
    """A registry of any length: families(family_no, id, name, summary, keywords) and
    workflows(workflow_no, id, family_id, title, keywords, preferred_symbols,
    prompt_rules, tuning_params)."""

    families: DataFrame
    workflows: DataFrame | None = None


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


# ---- keyword hits ----------------------------------------------------------------

_KEYWORD = "struct<keyword:string,plain:string,words:array<string>>"


def _keyword_rows(keywords: Iterable[str]) -> list[dict]:
    return [
        {"keyword": k, "plain": _plain(k), "words": _plain(k).split()}
        for k in keywords
        if _plain(k)
    ]


def _matches(haystack: Column, table: Column, weight: int) -> Column:
    """Array of (keyword, points) that hit: as a phrase, or with all their words."""

    def points(k):
        several = F.size(k["words"]) > 1
        whole = F.contains(haystack, k["plain"])
        every = several & F.forall(k["words"], lambda w: F.contains(haystack, w))
        return F.struct(
            k["keyword"].alias("keyword"),
            F.when(whole, F.lit(weight) + several.cast("int")).when(every, weight).alias("points"),
        )

    return F.filter(F.transform(table, points), lambda k: k["points"].isNotNull())


def _total(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0), lambda total, k: total + k["points"])


def _words(matches: Column) -> Column:
    return F.transform(matches, lambda k: k["keyword"])


def keyword_hits(haystack: Column, keywords: Iterable[str], weight: int = 1) -> Column:
    """struct(score, hits) of a normalized text against a keyword list."""
    table = T.constant(_keyword_rows(keywords), f"array<{_KEYWORD}>")
    return let(
        haystack,
        lambda text: let(
            _matches(text, table, weight),
            lambda found: F.struct(
                _total(found).alias("score"), _words(found).alias("hits")
            ),
        ),
    )


# ---- gates ---------------------------------------------------------------------------


def scope_gates(question: Column, names: vocab.Names = DEFAULT_NAMES) -> dict[str, Column]:
    """Boolean columns over a normalized question."""
    proof = F.contains(question, F.lit("prove")) & T.contains_any(question, vocab.PROOF_SUBJECTS)
    return {
        "out_of_scope": T.contains_any(question, names.fill_all(vocab.OUT_OF_SCOPE)) | proof,
        "conceptual": T.contains_any(question, vocab.CONCEPTUAL)
        & ~T.contains_any(question, vocab.ACTIONS),
        "family_meta": T.contains_any(question, vocab.FAMILY_META),
    }


def normalize_family_id(value: Column | str, registry: Registry) -> Column:
    """Family id of an id, a text that starts with one, or a family name; else ''."""
    raw = T.strip(value)
    upper = F.upper(raw)
    ids = [family.id for family in registry.families]
    head = F.substring_index(
        T.normalize_text(F.replace(upper, F.lit("."), F.lit(" "))), " ", 1
    )
    out = F.when(upper.isin(ids), upper).when(F.upper(head).isin(ids), F.upper(head))
    for family in registry.families:
        out = out.when(F.lower(raw) == family.name.lower(), F.lit(family.id))
    return out.otherwise("")


# ---- workflow choice -------------------------------------------------------------------

_ROW = (
    "struct<no:int,id:string,family_id:string,name:string,title:string,"
    f"keywords:array<{_KEYWORD}>,symbols:array<{_KEYWORD}>,preferred_symbols:array<string>,"
    "prompt_rules:array<string>,tuning_params:array<string>>"
)


def _family_table(registry: Registry) -> Column:
    rows = [
        {"no": no, "id": f.id, "family_id": f.id, "name": f.name, "title": ""}
        | {"keywords": _keyword_rows(f.keywords), "symbols": []}
        | {"preferred_symbols": [], "prompt_rules": [], "tuning_params": []}
        for no, f in enumerate(registry.families)
    ]
    return T.constant(rows, f"array<{_ROW}>")


def _workflow_table(registry: Registry) -> Column:
    names = {f.id: f.name for f in registry.families}
    rows = [
        {
            "no": no,
            "id": w.id,
            "family_id": w.family_id if w.family_id in names else "",
            "name": names.get(w.family_id, ""),
            "title": w.title,
            "keywords": _keyword_rows(w.keywords),
            "symbols": _keyword_rows(w.preferred_symbols),
            "preferred_symbols": list(w.preferred_symbols),
            "prompt_rules": list(w.prompt_rules),
            "tuning_params": list(w.tuning_params),
        }
        for no, w in enumerate(registry.workflows)
    ]
    return T.constant(rows, f"array<{_ROW}>")


def _scored(row: Column, asked: Column, seen: Column) -> Column:
    """struct(score, order, row, matched): hits of the question come first, then
    what only the context adds."""
    return let(
        F.struct(asked.alias("asked"), seen.alias("seen")),
        lambda m: F.struct(
            (_total(m["asked"]) + _total(m["seen"])).alias("score"),
            (-row["no"]).alias("order"),
            row.alias("row"),
            F.concat(
                _words(m["asked"]),
                F.filter(
                    _words(m["seen"]), lambda k: ~F.array_contains(_words(m["asked"]), k)
                ),
            ).alias("matched"),
        ),
    )


def _selection(
    q: Column, c: Column, forced: Column, gates: dict, family_rows: Column, workflow_rows: Column
) -> Column:
    """The selection struct of one question; every part is evaluated once."""
    families = F.transform(
        family_rows,
        lambda f: _scored(f, _matches(q, f["keywords"], 3), _matches(c, f["keywords"], 1)),
    )
    workflows = F.transform(
        F.filter(
            workflow_rows, lambda w: (forced == "") | (w["family_id"] == forced)
        ),
        lambda w: _scored(
            w,
            _matches(q, w["keywords"], 4),
            F.concat(_matches(c, w["keywords"], 2), _matches(c, w["symbols"], 3)),
        ),
    )
    free = forced == ""
    best = let(
        families,
        lambda fs: F.when(free, F.array_max(F.filter(fs, lambda f: f["score"] > 0))).otherwise(
            F.try_element_at(F.filter(fs, lambda f: f["row"]["id"] == forced), F.lit(1))
        ),
    )
    ranked = F.reverse(F.sort_array(F.filter(workflows, lambda w: w["score"] > 0)))
    none, blank = F.array().cast("array<string>"), F.lit("")

    def decide(s):
        b, top = s["best"], s["top"]
        only_family = free & b.isNotNull() & gates["family_meta"](q)
        chosen = ~s["closed"] & ~only_family & top.isNotNull()
        by_family = ~s["closed"] & b.isNotNull()
        lead = F.greatest(top["score"] - F.coalesce(s["next"]["score"], F.lit(0)), F.lit(0))
        confidence = F.least(
            F.lit(0.98), F.lit(0.55) + lead / F.greatest(top["score"] + 6, F.lit(1))
        )
        home = top["row"]["family_id"] != ""

        def field(name, of_workflow, of_family, empty):
            value = F.when(chosen, of_workflow).when(by_family, of_family).otherwise(empty)
            return value.alias(name)

        def family(name, source):
            own = F.when(home, top["row"][source]).otherwise(F.coalesce(b["row"][source], blank))
            return field(name, own, b["row"][source], blank)

        return F.struct(
            family("family_id", "family_id"),
            family("family_name", "name"),
            field("workflow_id", top["row"]["id"], blank, blank),
            field("workflow_title", top["row"]["title"], blank, blank),
            field(
                "confidence",
                confidence,
                F.when(only_family, F.lit(0.4)).otherwise(F.lit(0.35)),
                F.lit(0.0),
            ),
            field("preferred_symbols", top["row"]["preferred_symbols"], none, none),
            field("prompt_rules", top["row"]["prompt_rules"], none, none),
            field("tuning_params", top["row"]["tuning_params"], none, none),
            field("matched_on", top["matched"], b["matched"], none),
        )

    closed = free & (gates["out_of_scope"](q) | gates["conceptual"](q))
    return let(
        ranked,
        lambda r: let(
            F.struct(
                best.alias("best"),
                closed.alias("closed"),
                F.try_element_at(r, F.lit(1)).alias("top"),
                F.try_element_at(r, F.lit(2)).alias("next"),
            ),
            decide,
        ),
    )


SELECTION_FIELDS = (
    "family_id", "family_name", "workflow_id", "workflow_title", "confidence",
    "preferred_symbols", "prompt_rules", "tuning_params", "matched_on",
)


def _gates(names: vocab.Names) -> dict:
    return {
        name: (lambda q, name=name: scope_gates(q, names)[name])
        for name in ("out_of_scope", "conceptual", "family_meta")
    }


def choose_workflow(
    questions: DataFrame, registry: Registry | RegistryTables, names: vocab.Names = DEFAULT_NAMES
) -> DataFrame:
    """Adds the selected family and workflow to question rows.

    ``questions``: text, and optionally context (normalized or not) and
    family_hint.
    """
    if isinstance(registry, RegistryTables):
        return _choose_from_tables(questions, registry, names)
    context = T.normalize_text("context") if "context" in questions.columns else F.lit("")
    hinted = "family_hint" in questions.columns
    forced = normalize_family_id("family_hint", registry) if hinted else F.lit("")
    families, workflows = _family_table(registry), _workflow_table(registry)
    selection = let(
        T.normalize_text("text"),
        lambda q: let(
            context,
            lambda c: let(forced, lambda f: _selection(q, c, f, _gates(names), families, workflows)),
        ),
    )
    chosen = questions.withColumn("__s", selection)
    return chosen.select(
        *questions.columns, *[F.col(f"__s.{field}") for field in SELECTION_FIELDS]
    )


def _keywords_of(words: Column) -> Column:
    """Registry keywords with their normalized form and its words; blank ones go."""
    rows = F.transform(
        F.coalesce(words, F.array().cast("array<string>")),
        lambda k: F.struct(
            k.alias("keyword"),
            T.normalize_text(k).alias("plain"),
            F.split(T.normalize_text(k), " ").alias("words"),
        ),
    )
    return F.filter(rows, lambda k: F.coalesce(k["plain"] != "", F.lit(False)))


def _table_rows(registry: RegistryTables) -> tuple[DataFrame, DataFrame | None]:
    """Families and workflows as (no, row) with the struct that selection reads."""
    none, blank = F.array().cast("array<string>"), F.lit("")
    no_keys = F.array().cast(f"array<{_KEYWORD}>")

    def packed(table: DataFrame, **fields: Column) -> DataFrame:
        row = F.struct(*(value.alias(name) for name, value in fields.items())).cast(_ROW)
        return table.select(fields["no"].cast("long").alias("no"), row.alias("row"))

    families = packed(
        registry.families,
        no=F.col("family_no"), id=F.col("id"), family_id=F.col("id"), name=F.col("name"), title=blank,
        keywords=_keywords_of(F.col("keywords")), symbols=no_keys,
        preferred_symbols=none, prompt_rules=none, tuning_params=none,
    )
    if registry.workflows is None:
        return families, None
    home = registry.families.select(F.col("id").alias("family_id"), F.col("name").alias("__name"))
    known = registry.workflows.join(home.dropDuplicates(["family_id"]), "family_id", "left")
    lists = {n: F.coalesce(F.col(n), none) for n in ("preferred_symbols", "prompt_rules", "tuning_params")}
    workflows = packed(
        known,
        no=F.col("workflow_no"), id=F.col("id"),
        family_id=F.when(F.col("__name").isNotNull(), F.col("family_id")).otherwise(blank),
        name=F.coalesce("__name", blank), title=F.col("title"),
        keywords=_keywords_of(F.col("keywords")), symbols=_keywords_of(F.col("preferred_symbols")),
        **lists,
    )
    return families, workflows


def _choose_from_tables(
    questions: DataFrame, registry: RegistryTables, names: vocab.Names
) -> DataFrame:
    """Selection with a registry of any length.

    Questions are joined with the rows of which a keyword occurs in them, and
    selection then reads these rows only: all others score nothing. A hinted family
    is joined by its id or name.
    """
    none = F.array().cast(f"array<{_ROW}>")
    hint = F.col("family_hint") if "family_hint" in questions.columns else F.lit("")
    context = T.normalize_text("context") if "context" in questions.columns else F.lit("")
    raw = T.strip(hint)
    head = F.substring_index(T.normalize_text(F.replace(F.upper(raw), F.lit("."), F.lit(" "))), " ", 1)
    asked = materialize(
        questions.select("*", F.monotonically_increasing_id().alias("__key")).select(
            "*",
            T.normalize_text("text").alias("__q"),
            context.alias("__c"),
            F.array(F.upper(raw), F.upper(head), F.lower(raw)).alias("__hints"),
        ),
        "asked",
    )
    families, workflows = (None if t is None else materialize(t, "registry") for t in _table_rows(registry))
    # An id counts before the first word, and both before a name; the first row of equals.
    keys = families.select(
        "no",
        "row",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("row.id").alias("hint")),
                F.struct(F.lit(1).alias("kind"), F.col("row.id").alias("hint")),
                F.struct(F.lit(2).alias("kind"), F.lower("row.name").alias("hint")),
            )
        ).alias("k"),
    ).select("no", "row", "k.*")
    hints = asked.select("__key", F.posexplode("__hints").alias("kind", "hint")).filter("hint <> ''")
    least = F.min(F.struct("kind", "no", "row.id")).alias("f")
    forced = hints.join(keys, ["kind", "hint"]).groupBy("__key").agg(least).select("__key", F.col("f.id").alias("__forced"))
    asked = asked.join(forced, "__key", "left").withColumn("__forced", F.coalesce("__forced", F.lit("")))
    texts = asked.select(F.col("__key").alias("key"), F.concat_ws("\n", "__q", "__c").alias("hay"))
    texts = materialize(texts, "asked-texts")

    def candidates(table: DataFrame | None, name: str, forced_too: bool) -> DataFrame:
        """__key and the rows that may score, in registry order."""
        words = F.explode(F.concat("row.keywords", "row.symbols")).alias("k")
        needles = table.select("no", words).select("no", F.col("k.words").alias("words"))
        needles = needles.select(F.struct("no", "words").alias("needle"), "words").distinct()
        met = occurrences(texts, needles).select(F.col("key").alias("__key"), F.col("needle.no").alias("no")).distinct()
        met = met.join(table, "no")
        if forced_too:
            own = table.select("no", "row", F.col("row.id").alias("__forced"))
            met = met.unionByName(asked.join(own, "__forced").select("__key", "no", "row")).dropDuplicates(["__key", "no"])
        listed = F.transform(F.sort_array(F.collect_list(F.struct("no", "row"))), lambda r: r["row"])
        return met.groupBy("__key").agg(listed.alias(name))

    rows = asked.join(candidates(families, "__families", True), "__key", "left")
    if workflows is None:
        rows = rows.withColumn("__workflows", none)
    else:
        rows = rows.join(candidates(workflows, "__workflows", False), "__key", "left")
    selection = let(
        F.col("__q"),
        lambda q: _selection(
            q, F.col("__c"), F.col("__forced"), _gates(names),
            F.coalesce("__families", none), F.coalesce("__workflows", none),
        ),
    )
    return rows.withColumn("__s", selection).select(
        *questions.columns, *[F.col(f"__s.{field}") for field in SELECTION_FIELDS]
    )


# ---- query expansion ----------------------------------------------------------------------


def focus_score(
    question: Column, symbol: Column, aliases: Mapping[str, Sequence[str]]
) -> Column:
    """How much a normalized question speaks of a symbol."""
    tail = F.lower(F.substring_index(symbol, ".", -1))
    phrases = {key: [_plain(p) for p in words] for key, words in aliases.items()}
    named = F.when((tail != "") & F.contains(question, tail), 4).otherwise(0)
    spoken = F.size(
        F.filter(T.aliases_of(tail, phrases), lambda p: F.contains(question, p))
    )
    words = F.size(
        F.filter(
            F.split(tail, "[^a-z0-9]+"),
            lambda w: (F.length(w) > 2) & F.contains(question, w),
        )
    )
    return named + F.lit(3) * spoken + words


def focused_symbol(
    question: Column, symbols: Column, names: vocab.Names = DEFAULT_NAMES
) -> Column:
    """struct(score, symbol) of the symbol a question speaks of most; first on ties."""
    aliases = names.fill_map(vocab.SYMBOL_FOCUS_ALIASES)
    return let(
        T.normalize_text(question),
        lambda q: let(
            F.array_max(
                F.transform(
                    symbols,
                    lambda s, i: F.struct(
                        focus_score(q, s, aliases).alias("score"),
                        (-i).alias("order"),
                        s.alias("symbol"),
                    ),
                )
            ),
            lambda best: F.struct(best["score"].alias("score"), best["symbol"].alias("symbol")),
        ),
    )


def expand_queries(
    selected: DataFrame, names: vocab.Names = DEFAULT_NAMES, max_symbols: int = 3
) -> DataFrame:
    """Retrieval queries per question: the given columns plus sub_no and query."""
    base = T.strip("text")
    hints = F.slice("preferred_symbols", 1, max(0, max_symbols))
    has_workflow = F.col("workflow_id") != ""
    package = F.lit(names.package)
    wide = F.concat_ws(
        " ", base, package, T.blank_to_null("workflow_title"), F.array_join(hints, " ")
    )
    wide = T.strip(wide)
    focus = F.col("__focus")
    narrow = F.when(
        (F.size(hints) > 0) & (focus["score"] > 0), F.concat_ws(" ", base, package, focus["symbol"])
    )
    by_family = F.concat_ws(" ", base, package, F.col("family_name"))
    candidates = (
        F.when(has_workflow, F.array(base, wide, narrow))
        .when(F.col("family_id") != "", F.array(base, by_family))
        .otherwise(F.array(base))
    )

    def distinct(items):
        plain = F.transform(items, T.normalize_text)
        return let(
            plain,
            lambda p: F.filter(
                items,
                lambda x, i: (F.get(p, i) != "") & (F.array_position(p, F.get(p, i)) == i + 1),
            ),
        )

    rows = selected.withColumn("__focus", focused_symbol(F.col("text"), hints, names))
    queries = let(F.array_compact(candidates), distinct)
    # The outer form infers no filter on the expression it explodes.
    return rows.select(
        *selected.columns, F.posexplode_outer(queries).alias("sub_no", "query")
    ).filter("sub_no IS NOT NULL")


# ---- context ----------------------------------------------------------------------------

CONTEXT_FIELDS = ("qualname", "symbol_id", "module", "title", "location", "text")


def context_haystack(items: DataFrame) -> DataFrame:
    """(question_id, context): normalized text of a question's context items.

    ``items``: question_id, ctx_no and any of the context fields; a question
    has as many items as its retrieval cap allows.
    """
    parts = [T.blank_to_null(T.strip(f)) for f in CONTEXT_FIELDS if f in items.columns]
    joined = items.select("question_id", "ctx_no", F.concat_ws("\n", *parts).alias("t"))
    ordered = F.sort_array(F.collect_list(F.struct("ctx_no", "t")))
    return joined.groupBy("question_id").agg(
        T.normalize_text(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")).alias(
            "context"
        )
    )


# ---- routes ------------------------------------------------------------------------------


def evidence_type(text: Column | str) -> Column:
    found = T.contains_any(F.lower(T.or_empty(text)), vocab.DOCUMENT_MARKERS)
    return F.when(found, F.lit("symbol+pdf")).otherwise("symbol-only")


def complexity_score(
    text: Column | str,
    names: vocab.Names = DEFAULT_NAMES,
    goal_cap: int = 2,
    count_questions: bool = False,
) -> Column:
    """struct(score, word_count, api_refs, goal_markers, constraint_markers)."""
    q = T.strip(text)
    lower = F.lower(q)
    padded = F.concat(F.lit(" "), lower, F.lit(" "))
    words = F.size(F.regexp_extract_all(q, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    dotted = F.size(
        F.array_distinct(
            F.regexp_extract_all(
                q, F.lit(rf"{vocab.IDENTIFIER}\.{vocab.IDENTIFIER}"), F.lit(0)
            )
        )
    )
    refs = dotted + T.count_contained(lower, names.fill_all(vocab.KNOWN_API_MARKERS))
    goals = T.count_contained(padded, vocab.GOAL_MARKERS)
    limits = T.count_contained(padded, vocab.CONSTRAINT_MARKERS)
    asked = F.regexp_count(q, F.lit(r"\?"))
    facts = F.struct(
        words.alias("word_count"),
        refs.alias("api_refs"),
        goals.alias("goal_markers"),
        limits.alias("constraint_markers"),
        asked.alias("asked"),
    )

    def score(f):
        total = (
            F.least(f["api_refs"], F.lit(3))
            + (f["word_count"] > 20).cast("int")
            + (f["word_count"] > 40).cast("int")
            + F.least(f["goal_markers"], F.lit(goal_cap))
            + F.least(f["constraint_markers"], F.lit(2))
        )
        if count_questions:
            total = total + (f["asked"] > 1).cast("int")
        return F.struct(
            total.alias("score"),
            *[f[n].alias(n) for n in ("word_count", "api_refs", "goal_markers", "constraint_markers")],
        )

    return let(facts, score)


CONFIDENCE_TOP = 4
ROUTE_TOP = 5


def retrieval_confidence(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(question_id, confidence, has_pdf) of each question's first results.

    ``results``: question_id, rank, score, source_type.
    """
    s = F.col("score")
    squashed = F.when(s <= 0, 0.0).when(s <= 1, s).otherwise(s / (s + 1))
    top = F.col("rank") <= CONFIDENCE_TOP
    facts = results.filter(F.col("rank") <= ROUTE_TOP).groupBy("question_id").agg(
        F.avg(F.when(top, squashed)).alias("mean"),
        F.count_if(top & (F.col("source_type") == "generated")).alias("symbols"),
        F.some(F.col("source_type") == "pdf").alias("has_pdf"),
    )
    lifted = F.when(
        F.col("symbols") >= 2, F.least(F.lit(1.0), F.col("mean") + 0.03)
    ).otherwise(F.col("mean"))
    return questions.select("question_id").join(facts, "question_id", "left").select(
        "question_id",
        F.coalesce(lifted, F.lit(0.0)).alias("confidence"),
        F.coalesce("has_pdf", F.lit(False)).alias("has_pdf"),
    )


def route(
    complexity: Column, confidence: Column, evidence: Column, has_pdf: Column
) -> tuple[Column, Column]:
    """(route, reason) of an automatically routed question."""
    no_pdf = (evidence == "symbol+pdf") & ~has_pdf
    simple = (complexity <= 3) & (confidence >= 0.60)
    middling = (complexity <= 6) & (confidence >= 0.30)
    reasons = vocab.ROUTE_REASONS
    mode = F.when(no_pdf, "plan").when(simple, "auto_fast").when(middling, "auto").otherwise("plan")
    why = (
        F.when(no_pdf, reasons["plan_pdf"])
        .when(simple, reasons["auto_fast"])
        .when(middling, reasons["auto"])
        .otherwise(reasons["plan"])
    )
    return mode, why


def retry_budget(mode: Column, route_mode: Column, max_retries: int) -> Column:
    return (
        F.when(mode == "fast", F.lit(max_retries))
        .when(route_mode == "auto_fast", F.lit(0))
        .otherwise(F.lit(min(max_retries, 1)))
    )


def top_symbol_hints(results: DataFrame, limit: int) -> DataFrame:
    """(question_id, hints): first distinct names of generated results, in order."""
    hint = T.strip(F.coalesce(T.blank_to_null("qualname"), F.col("symbol_id")))
    first = (
        results.filter(F.col("source_type") == "generated")
        .select("question_id", "rank", hint.alias("hint"))
        .filter("hint <> ''")
        .groupBy("question_id", "hint")
        .agg(F.min("rank").alias("rank"))
    )
    order = Window.partitionBy("question_id").orderBy("rank")
    kept = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    ordered = F.sort_array(F.collect_list(F.struct("n", "hint")))
    return kept.groupBy("question_id").agg(
        F.transform(ordered, lambda x: x["hint"]).alias("hints")
    )


def retry_query(
    questions: DataFrame, results: DataFrame, names: vocab.Names = DEFAULT_NAMES
) -> DataFrame:
    """(question_id, query): second-pass query out of the first results.

    ``questions``: question_id, text, and optionally missing (array of hints).
    """
    none = F.array().cast("array<string>")
    given = F.col("missing") if "missing" in questions.columns else none
    missing = F.slice(
        F.filter(F.transform(F.coalesce(given, none), T.strip), lambda m: m != ""), 1, 2
    )
    hints = F.coalesce("hints", none)
    words = F.concat(
        F.array("text"),
        F.when(F.size(missing) > 0, F.concat(F.array(F.lit("missing:")), missing)).otherwise(none),
        F.when(F.size(hints) > 0, F.concat(F.array(F.lit("related_apis:")), hints)).otherwise(none),
        F.when(
            evidence_type("text") == "symbol+pdf",
            T.strings(["user guide", "documentation section"]),
        ).otherwise(T.strings(["runnable example", names.package])),
    )
    rows = questions.join(top_symbol_hints(results, 2), "question_id", "left")
    return rows.select("question_id", T.strip(F.array_join(words, " ")).alias("query"))


def evidence_gap(status: Column, errors: Column) -> Column:
    """Whether a failed run points to missing knowledge."""
    text = F.lower(T.or_empty(errors))
    return (
        status.isNotNull()
        & (status != "success")
        & ~T.contains_any(text, vocab.NOT_A_GAP)
        & T.contains_any(text, vocab.GAP)
    )


def import_gap(status: Column, errors: Column) -> Column:
    """Whether a failed run asks for wildcard imports."""
    return (status == "error") & T.contains_any(
        F.lower(T.or_empty(errors)), vocab.IMPORT_ERRORS
    )


def generator_issue(issues: Column) -> Column:
    """Whether any validation message is about generators."""
    return F.exists(
        issues, lambda i: T.contains_any(F.lower(i), vocab.GENERATOR_ERRORS)
    )


def needs_escalation(
    route_mode: Column, escalated: Column, has_missing: Column, gap: Column, passed: Column
) -> Column:
    return route_mode.isin("auto_fast", "auto") & ~escalated & (has_missing | gap | ~passed)


# ---- rules --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    message: str
    when_any: tuple[str, ...]
    scope: str = "all"
    id: str = ""


RULE_LINES = 8
_RULE_ROW = "struct<message:string,line:string,scope:string,needles:array<string>>"


def rules_of(table: DataFrame, rows: int = CONSTANT_ROWS) -> tuple[Rule, ...]:
    """Rules as constants; a longer table is for ``match_rule_table``."""
    if not at_most(table, rows):
        raise ValueError(f"more than {rows} rules: use match_rule_table")
    return tuple(
        Rule(
            r["message"],
            tuple(r["when_any"] or ()),
            r["scope"],
            r["id"] or f"rule_{r['rule_no']}",
        )
        for r in sorted(table.limit(rows).collect(), key=lambda r: r["rule_no"])
    )


def match_rules(
    question: Column,
    context: Column,
    rules: Sequence[Rule],
    global_messages: Sequence[str] = (),
    limit: int = RULE_LINES,
) -> Column:
    """Array of reminder lines for a question and its context text.

    Global messages first. A rule is left out if its message was given
    before; the list ends with the rule that brings it to ``limit`` lines.
    """
    fixed = list(dict.fromkeys(m.strip() for m in global_messages if m.strip()))
    rows = []
    for number, rule in enumerate(rules, start=1):
        message = rule.message.strip()
        needles = [w.lower() for w in rule.when_any if w.strip()]
        if not message or not needles or message in fixed:
            continue
        scope = rule.scope.strip().lower()
        ident = rule.id.strip() or f"rule_{number}"
        rows.append(
            {
                "message": message,
                "line": f"- [{ident}] {message}",
                "scope": scope if scope in ("question", "context") else "all",
                "needles": needles,
            }
        )
    head = T.strings([f"- {m}" for m in fixed])
    if not rows:
        return head

    def matched(q, c, both):
        hit = F.filter(
            T.constant(rows, f"array<{_RULE_ROW}>"),
            lambda r: F.exists(
                r["needles"],
                lambda n: F.contains(
                    F.when(r["scope"] == "question", q).when(r["scope"] == "context", c).otherwise(both),
                    n,
                ),
            ),
        )
        return let(
            hit,
            lambda h: F.filter(
                h,
                lambda r, i: F.array_position(F.transform(h, lambda x: x["message"]), r["message"])
                == i + 1,
            ),
        )

    room = max(limit - len(fixed), 1)
    lower_q, lower_c = F.lower(T.or_empty(question)), F.lower(T.or_empty(context))
    found = let(
        lower_q,
        lambda q: let(
            lower_c,
            lambda c: let(F.concat(q, F.lit("\n"), c), lambda both: matched(q, c, both)),
        ),
    )
    return F.concat(head, F.transform(F.slice(found, 1, room), lambda r: r["line"]))


def match_rule_table(
    questions: DataFrame,
    rules: DataFrame,
    global_messages: Sequence[str] = (),
    limit: int = RULE_LINES,
) -> DataFrame:
    """Adds ``lines``, as ``match_rules`` gives them, with a rule table of any length.

    ``questions``: text, context; ``rules``: rule_no, id, scope, when_any, message.
    Questions meet the rules of which a trigger occurs in them. A question keeps the
    first rule of each message and no more than ``limit`` rows of these.
    """
    fixed = list(dict.fromkeys(m.strip() for m in global_messages if m.strip()))
    message, scope = T.strip(F.col("message")), F.lower(T.strip(F.col("scope")))
    ident = F.coalesce(T.blank_to_null(T.strip("id")), F.concat(F.lit("rule_"), F.col("rule_no").cast("string")))
    known = rules.select(
        F.col("rule_no").cast("long").alias("rule_no"),
        message.alias("message"),
        F.concat(F.lit("- ["), ident, F.lit("] "), message).alias("line"),
        F.when(scope.isin("question", "context"), scope).otherwise("all").alias("scope"),
        F.explode("when_any").alias("trigger"),
    ).filter((F.col("message") != "") & (T.strip("trigger") != "") & ~F.col("message").isin(fixed))
    known = materialize(known.withColumn("trigger", F.lower("trigger")), "rules")
    asked = materialize(
        questions.select(
            "*",
            F.monotonically_increasing_id().alias("__key"),
            F.lower(T.or_empty("text")).alias("__q"),
            F.lower(T.or_empty("context")).alias("__c"),
        ),
        "asked",
    )
    texts = asked.select(F.col("__key").alias("key"), F.concat_ws("\n", "__q", "__c").alias("hay"))
    needles = known.select(F.col("trigger").alias("needle")).distinct().withColumn("words", F.array("needle"))
    met = occurrences(materialize(texts, "asked-texts"), needles).withColumnRenamed("needle", "trigger")
    met = met.join(known, "trigger").join(asked.select(F.col("__key").alias("key"), "__q", "__c"), "key")
    place = F.when(F.col("scope") == "question", F.col("__q")).when(F.col("scope") == "context", F.col("__c"))
    hit = met.filter(F.col("scope").eqNullSafe("all") | F.contains(place, "trigger"))
    first = hit.groupBy("key", "message").agg(F.min(F.struct("rule_no", "line")).alias("r"))
    room = max(limit - len(fixed), 1)
    order = Window.partitionBy("key").orderBy("r")
    kept = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= room)
    lines = kept.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_list("r")).alias("__r"))
    head = T.strings([f"- {m}" for m in fixed])
    rest = F.coalesce(F.transform("__r", lambda r: r["line"]), F.array().cast("array<string>"))
    return asked.join(lines, "__key", "left").select(*questions.columns, F.concat(head, rest).alias("lines"))
