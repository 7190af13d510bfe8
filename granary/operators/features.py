"""Question features and intents, as first-match rule lists.

The marker lists are fixed values; names of the documented package in them
are placeholders that ``Names`` fills.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary import vocab
from granary.functions import text as T
from granary.operators.routing import Registry
from granary.runtime import let

DEFAULT_NAMES = vocab.Names()

# ---- fixed values: markers ---------------------------------------------------------
GENERATORS = ("Dx", "Dy", "Dt", "Dz", "Sn", "Sk", "Sx", "Qx", "Fx", "Tx", "Jx")
Q_TOKENS = ("qx", "jx")
SHIFT_TOKENS = ("sn", "sk", "sx")
DERIVATION_TOKENS = ("dx", "dy", "dt", "dz", "du", "dv")
OPERATOR_ENDS = "at|around|with|where|in|using|and show|but print|, and show"
OPERATOR_PATTERNS = (
    rf"(?id)\b(?:of|for)\s+(.+?)\s+(?:{OPERATOR_ENDS})\b",
    rf"(?id)\boperator\s+(.+?)\s+(?:{OPERATOR_ENDS})\b",
    r"(?id)\b(?:equation|operator)\s+(.+)$",
)
POINT = r"(?i)\b(?:at|around)\s+(?:[A-Za-z_][A-Za-z0-9_]*\s*=\s*)?([^,.;]+)"
PRECISIONS = (
    r"(?i)\border(?:\s*=|\s+of\s+)(\d+)\b",
    r"(?i)\bprecision(?:\s+of)?\s+(\d+)\s+bits?\b",
    r"(?i)\bfirst\s+(\d+)\s+(?:items|terms|coefficients|values|elements)\b",
)
TWO_GENERATORS = (
    r"\[[A-Za-z_][A-Za-z0-9_]*\s*,\s*[A-Za-z_][A-Za-z0-9_]*\]\s*"
    r"\[[A-Za-z_][A-Za-z0-9_]*\s*,\s*[A-Za-z_][A-Za-z0-9_]*\]"
)
SOLUTION_KINDS = (
    ("indicial_polynomial", ("indicial polynomial",)),
    ("local_basis_monomials", ("leading monomial", "leading logarithmic monomial")),
    ("generalized_series", ("generalized series",)),
    ("local_basis_expansions", ("series solution", "local basis")),
    ("groebner_basis", ("groebner basis", "gröbner basis")),
)
MULTIVARIATE = (
    "multivariate {algebra}", "several generators", "several variables", "mixed generators",
    "dx dy", "dx and dy", "du dv", "sn sk",
)
SETUP = (
    "{constructor_lower}", "{algebra}", "differential operator algebra",
    "recurrence operator algebra", "differentialoperators", "create algebra",
    "construct algebra", "which algebra", "multivariate {algebra}", "several generators",
    "several variables", "mixed generators",
)
PROPERTY_METHODS = {
    "is_c": "is_C", "is_d": "is_D", "is_delta": "is_Delta", "is_e": "is_E", "is_f": "is_F",
    "is_j": "is_J", "is_q": "is_Q", "is_s": "is_S",
}
GENS = (
    "gens", "generators of this algebra", "generator names", "what are the generators",
    "list generators", "generators of the",
)
CONSTRUCTOR_MARKERS = (
    "{constructor_lower}", "{algebra}", "differential operator algebra",
    "recurrence operator algebra", "create algebra", "construct algebra", "which algebra",
)
CLOSURES = (
    (
        "annihilator_of_polynomial",
        (
            "annihilator_of_polynomial", "annihilating operator of the polynomial expression",
            "annihilating operator of p(",
        ),
    ),
    ("annihilator_of_associate", ("annihilator_of_associate", "association ")),
    ("symmetric_product", ("symmetric product",)),
    ("symmetric_power", ("symmetric power", "symmetric square")),
)
FIRST_ELEMENT = (
    "only the first element", "print only the first element", "show only the first element",
    "first local basis element", "1st local basis element",
)
ZERO_POINTS = ("0", "x=0", "y=0", "t=0", "u=0", "z=0")
ALGEBRAIC_POINTS = ("sqrt", "qqbar", "i", "root", "qatar(sort(")
CONVERSIONS = (
    "annihilator_of_integral", "annihilator_of_composition", " to_s", " to_d", " to_f", " to_t",
    "convert to recurrence", "taylor-coefficient recurrence", "coefficient-side recurrence",
)
IDEALS = (
    "groebner basis", "gröbner basis", "fglm", "left ideal", "annihilating ideal", "eliminate",
    "elimination", "intersection of the left ideal",
)
# Methods, help texts and override rules by feature.
FEATURE_METHODS = {
    "associated_commutative_algebra": ("associated_commutative_algebra", "{constructor}"),
    "change_constant_ring": ("change_constant_ring", "{constructor}"),
    "change_ring": ("change_ring", "{constructor}"),
    "delta": ("delta", "{constructor}"),
    "sigma": ("sigma", "{constructor}"),
    "DifferentialOperators": ("DifferentialOperators", "{constructor}"),
    "gens": ("{constructor}_generic.gens", "gens", "{constructor}"),
    "is_C": ("is_C", "{constructor}"),
    "is_D": ("is_D", "{constructor}"),
    "is_Delta": ("is_Delta", "{constructor}"),
    "is_E": ("is_E", "{constructor}"),
    "is_F": ("is_F", "{constructor}"),
    "is_J": ("is_J", "{constructor}"),
    "is_Q": ("is_Q", "{constructor}"),
    "is_S": ("is_S", "{constructor}"),
    "{constructor}": ("{constructor}",),
}
COMMON_METHODS = {
    "gcrd": ("{operator}.gcrd", "gcrd"),
    "lclm": ("{operator}.lclm", "lclm"),
    "gcrd_lclm": ("{operator}.gcrd", "gcrd", "{operator}.lclm", "lclm"),
}
METHOD_LIMIT = 4
HELP = {
    "first": "restrict output to the first requested result",
    "first_order": "restrict attention to first-order right factors",
    "q_shift": "preserve q-shift algebra setup and avoid generic factorization APIs",
    "exists": "report whether any right factor satisfying the request exists",
    "monomials": (
        "extract the leading coefficient", "compute and sort the relevant real roots",
        "select the requested root before local analysis",
    ),
    "series": (
        "extract the leading coefficient", "compute real roots of the leading coefficient",
        "sort real roots and select the requested one",
    ),
    "ring": "inspect the base ring of a returned series object",
}
OVERRIDE_RULES = {
    "base_ring": "The user explicitly asked to show the base ring, so generated code must print it.",
    "root": (
        "Resolve the requested root of the leading coefficient before calling the local "
        "analysis method."
    ),
    "first": "Only print the first requested element rather than the full returned collection.",
}


def _has(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle))


def _first(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    out = None
    for value, markers in rules:
        test = T.contains_any(text, markers)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise("")


def operator_text(question: Column) -> Column:
    """The operator expression a question spells out, by its first usable pattern."""
    text = T.strip(question)

    def usable(pattern: str) -> Column:
        expr = F.btrim(F.regexp_extract(text, pattern, 1), F.lit(" .,:;"))

        def check(e):
            listed = (
                _has(e, "[")
                & _has(e, "]")
                & ~e.rlike(r"[+\-*^/()]")
                & ~e.rlike(r"\A(?:" + "|".join(GENERATORS) + ")")
            )
            ok = ~F.startswith(F.lower(e), F.lit("algebra ")) & ~listed
            return F.when(ok & T.contains_any(e, GENERATORS), e)

        return let(expr, check)

    return F.coalesce(*[usable(p) for p in OPERATOR_PATTERNS], F.lit(""))


def operator_kind(q: Column) -> Column:
    tokens = T.tokenize(q)
    has = lambda words: F.arrays_overlap(tokens, T.strings(words))
    q_shift = T.contains_any(q, ("q-shift", "q_recurrence")) | has(Q_TOKENS)
    shift = T.contains_any(q, ("recurrence", "shift operator")) | has(SHIFT_TOKENS)
    derivation = T.contains_any(q, ("differential operator", "differential equation")) | has(
        DERIVATION_TOKENS
    )
    mixed = _has(q, "mixed generators") | (derivation & (shift | q_shift))
    return (
        F.when(mixed, "mixed")
        .when(q_shift, "q_recurrence")
        .when(shift, "recurrence")
        .when(derivation, "differential")
        .otherwise("")
    )


def algebra_feature(q: Column, names: vocab.Names) -> Column:
    found = F.regexp_extract(q, r"\b(is_(?:c|d|delta|e|f|j|q|s))\b", 1)
    methods = F.create_map(*[F.lit(x) for pair in PROPERTY_METHODS.items() for x in pair])
    phrase = names.fill("{algebra}")
    callable_ = lambda word: (
        _has(q, f"{word} callable")
        | _has(q, f" {phrase} {word}")
        | (_has(q, word) & _has(q, "algebra"))
    )
    spelled = lambda words, name: _has(q, words) | _has(q, name)
    return (
        F.when(
            spelled("associated commutative algebra", "associated_commutative_algebra"),
            "associated_commutative_algebra",
        )
        .when(spelled("change constant ring", "change_constant_ring"), "change_constant_ring")
        .when(spelled("change ring", "change_ring"), "change_ring")
        .when(callable_("delta"), "delta")
        .when(callable_("sigma"), "sigma")
        .when(spelled("differential operators", "differentialoperators"), "DifferentialOperators")
        .when(found != "", F.element_at(methods, found))
        .when(T.contains_any(q, GENS), "gens")
        .when(T.contains_any(q, names.fill_all(CONSTRUCTOR_MARKERS)), names.constructor)
        .otherwise("")
    )


def question_features(
    questions: DataFrame, names: vocab.Names = DEFAULT_NAMES, text: str = "text"
) -> DataFrame:
    """Adds the 22 typed features of a question; narrow, no shuffle."""
    q, raw = F.col("normalized_question"), T.or_empty(text)
    gcrd = T.contains_any(q, ("gcrd", "greatest common right divisor", "common divisor"))
    lclm = T.contains_any(q, ("lclm", "least common left multiple", "common multiple"))
    setup = (F.col("algebra_feature") != "") | T.contains_any(q, names.fill_all(SETUP))
    scope = F.when(
        T.contains_any(q, names.fill_all(MULTIVARIATE)) | raw.rlike(TWO_GENERATORS),
        "multivariate",
    ).otherwise("univariate")
    at_root = _has(q, "leading coefficient") & _has(q, "root")
    at_point = ~at_root & q.rlike(POINT)
    point = F.when(at_point, T.strip(F.regexp_extract(q, POINT, 1))).otherwise("")
    second, first = _has(q, "second real root"), _has(q, "first real root")
    one = T.contains_any(q, ("one real root", "a real root"))
    explicit = F.col("point_source") == "explicit_point"
    p = F.col("point_text")
    point_kind = (
        F.when(F.col("point_source") == "leading_coefficient_root", "algebraic")
        .when(explicit & p.isin(*ZERO_POINTS), "zero")
        .when(explicit & T.contains_any(p, ALGEBRAIC_POINTS), "algebraic")
        .when(explicit & p.rlike(r"(?U)\A[-+]?\d+(?:/\d+)?\z"), "rational")
        .when(second | first | one, "algebraic")
        .otherwise("")
    )
    precision = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for pattern in PRECISIONS:
        precision = precision.when(
            q.rlike(pattern), F.regexp_extract(q, pattern, 1).try_cast("bigint")
        )
    return (
        questions.withColumn("normalized_question", T.normalize_text(text))
        .withColumn("operator_text", operator_text(F.col(text)))
        .withColumn("operator_kind", operator_kind(q))
        .withColumn("algebra_feature", algebra_feature(q, names))
        .withColumn("wants_algebra_setup", setup)
        .withColumn("algebra_scope", F.when(F.col("wants_algebra_setup"), scope).otherwise(""))
        .withColumn(
            "common_operator_task",
            F.when(gcrd & lclm, "gcrd_lclm").when(gcrd, "gcrd").when(lclm, "lclm").otherwise(""),
        )
        .withColumn(
            "point_source",
            F.when(at_root, "leading_coefficient_root")
            .when(at_point, "explicit_point")
            .otherwise(""),
        )
        .withColumn("point_text", point)
        .withColumn(
            "point_selection",
            F.when(second, "second_real")
            .when(first, "first_real")
            .when(one, "one_real")
            .when(at_root, "unspecified_root")
            .otherwise(""),
        )
        .withColumn("point_kind", point_kind)
        .withColumn("solution_kind", _first(q, SOLUTION_KINDS))
        .withColumn("precision", precision)
        .withColumn("needs_basis", _has(q, "basis"))
        .withColumn("needs_base_ring", _has(q, "base ring"))
        .withColumn("needs_code", F.lit(True))
        .withColumn("wants_series", T.contains_any(q, ("series", "frobenius")))
        .withColumn(
            "wants_generalized", T.contains_any(q, ("generalized series", "generalised series"))
        )
        .withColumn("wants_first_element_only", T.contains_any(q, FIRST_ELEMENT))
        .withColumn(
            "wants_existence_check", q.rlike(r"(?U)\A(does|do|is|are|has|have)\b")
        )
        .withColumn("closure_variant", _first(q, CLOSURES))
    )


# ---- intents -----------------------------------------------------------------------------


@dataclass(frozen=True)
class IntentNames:
    """Workflow ids and class names that intents point to."""

    closure: str = "C1_closure_combinatorics"
    conversion: str = "C2_algebra_conversion"
    common: str = "B1_gcrd_lclm"
    factors: str = "B2_factor_right_factor"
    local: str = "B3_local_singularity_analysis"
    ideal: str = "B4_multivariate_ideal_groebner_basis"
    setup: str = "A1_create_or_choose_algebra"
    setup_many: str = "A2_create_or_choose_multivariate_algebra"
    operator_class: str = "Operator"
    ideal_class: str = "LeftIdeal"


def _texts(*parts: Column) -> Column:
    """Array of the parts that are neither NULL nor ''."""
    return F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")).cast("array<string>")


def _list_if(test: Column, items) -> Column:
    items = (items,) if isinstance(items, str) else items
    return F.when(test, T.strings(items)).otherwise(F.array().cast("array<string>"))


def classify_intent(
    features: DataFrame,
    names: vocab.Names = DEFAULT_NAMES,
    targets: IntentNames = IntentNames(),
) -> DataFrame:
    """Adds family_id, workflow_id, intent_id, confidence, preferred_methods,
    helper_actions and matched_on by the first rule that applies."""
    q, c = F.col("normalized_question"), F.col
    at_root = c("point_source") == "leading_coefficient_root"
    none = F.array().cast("array<string>")
    lit = F.lit
    say = lambda marker, method: F.when(_has(q, marker), method)
    generic = f"{names.constructor}_generic"
    methods_by_task = {
        key: tuple(m.replace("{operator}", targets.operator_class) for m in methods)
        for key, methods in COMMON_METHODS.items()
    }
    methods_by_feature = names.fill_map(FEATURE_METHODS)
    feature = F.coalesce(T.blank_to_null("algebra_feature"), lit(names.constructor))
    solution = c("solution_kind")

    def decision(family, workflow, intent, confidence, methods, actions, matched) -> Column:
        return F.struct(
            lit(family).alias("family_id"),
            lit(workflow).alias("workflow_id"),
            intent.alias("intent_id"),
            lit(confidence).alias("confidence"),
            F.slice(F.array_distinct(methods), 1, 6).alias("preferred_methods"),
            actions.alias("helper_actions"),
            matched.alias("matched_on"),
        )

    rules = [
        (
            c("closure_variant") != "",
            decision(
                "C", targets.closure, c("closure_variant"), 0.95, _texts(c("closure_variant")),
                _list_if(c("wants_first_element_only"), HELP["first"]),
                _texts(c("closure_variant")),
            ),
        ),
        (
            T.contains_any(q, CONVERSIONS),
            decision(
                "C", targets.conversion, lit("algebra_conversion"), 0.9,
                _texts(
                    say("annihilator_of_integral", "annihilator_of_integral"),
                    say("annihilator_of_composition", "annihilator_of_composition"),
                    F.when(T.contains_any(q, ("to_s", "convert to recurrence")), "to_S"),
                    say("to_d", "to_D"),
                    say("to_f", "to_F"),
                    say("to_t", "to_T"),
                ),
                none, _texts(lit("conversion")),
            ),
        ),
        (
            c("common_operator_task") != "",
            decision(
                "B", targets.common, c("common_operator_task"), 0.94,
                F.slice(T.aliases_of(c("common_operator_task"), methods_by_task), 1, METHOD_LIMIT),
                none, _texts(c("common_operator_task")),
            ),
        ),
        (
            _has(q, "right factor"),
            decision(
                "B", targets.factors, lit("right_factor_search"), 0.93,
                _texts(lit("right_factors")),
                F.concat(
                    _list_if(T.contains_any(q, ("first-order", "first order")), HELP["first_order"]),
                    _list_if(c("operator_kind") == "q_recurrence", HELP["q_shift"]),
                    _list_if(c("wants_existence_check"), HELP["exists"]),
                ),
                _texts(lit("right_factors")),
            ),
        ),
        (
            solution == "indicial_polynomial",
            decision(
                "B", targets.local, solution, 0.96, _texts(solution), none, _texts(solution)
            ),
        ),
        (
            solution == "local_basis_monomials",
            decision(
                "B", targets.local, solution, 0.93, _texts(solution),
                _list_if(at_root, HELP["monomials"]), _texts(solution),
            ),
        ),
        (
            c("wants_series") | solution.isin("generalized_series", "local_basis_expansions"),
            decision(
                "B", targets.local, lit("local_basis_expansions"), 0.88,
                _texts(
                    F.when(
                        c("wants_generalized") & c("point_text").isin("0", ""),
                        "generalized_series_solutions",
                    ),
                    lit("local_basis_expansions"),
                ),
                F.concat(
                    _list_if(at_root, HELP["series"]),
                    _list_if(c("needs_base_ring"), HELP["ring"]),
                ),
                _texts(lit("local_series")),
            ),
        ),
        (
            T.contains_any(q, IDEALS),
            decision(
                "B", targets.ideal, lit("groebner_basis"), 0.92,
                _texts(
                    F.when(
                        T.contains_any(q, ("groebner basis", "gröbner basis")),
                        f"{targets.ideal_class}.groebner_basis",
                    ),
                    say("fglm", "fglm"),
                    F.when(
                        T.contains_any(q, ("eliminate", "elimination")),
                        f"{targets.ideal_class}.eliminate",
                    ),
                    lit(f"{generic}.ideal"),
                ),
                none, _texts(lit("ideal_groebner")),
            ),
        ),
        (
            c("wants_algebra_setup") & (c("algebra_scope") == "multivariate"),
            decision(
                "A", targets.setup_many, lit("create_or_choose_multivariate_algebra"), 0.9,
                _texts(
                    F.when(c("algebra_feature") == "gens", f"{generic}.gens"),
                    lit(names.constructor), lit(f"{generic}.gens"), lit(f"{generic}.ideal"),
                ),
                none,
                _texts(lit("algebra_setup"), c("algebra_scope"), c("algebra_feature")),
            ),
        ),
        (
            c("wants_algebra_setup"),
            decision(
                "A", targets.setup, lit("create_or_choose_algebra"), 0.88,
                let(
                    T.aliases_of(feature, methods_by_feature),
                    lambda m: F.when(F.size(m) > 0, m).otherwise(T.strings([names.constructor])),
                ),
                none, _texts(lit("algebra_setup"), c("algebra_feature")),
            ),
        ),
    ]
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    empty = decision("", "", lit(""), 0.0, none, none, none)
    chosen = features.withColumn("__d", out.otherwise(empty))
    fields = (
        "family_id", "workflow_id", "intent_id", "confidence", "preferred_methods",
        "helper_actions", "matched_on",
    )
    return chosen.withColumns({f: c(f"__d.{f}") for f in fields}).drop("__d")


_OVERRIDE_ROW = (
    "struct<id:string,title:string,symbols:array<string>,rules:array<string>,params:array<string>>"
)


def selection_override(decided: DataFrame, registry: Registry) -> DataFrame:
    """Decided questions with their workflow's registry row: the intent's own
    methods come before the workflow's symbols. Undecided ones drop."""
    families = {f.id: f.name for f in registry.families}
    rows = [
        {
            "id": w.id,
            "title": w.title,
            "symbols": list(w.preferred_symbols),
            "rules": list(w.prompt_rules),
            "params": list(w.tuning_params),
        }
        for w in registry.workflows
    ]
    names = T.constant(families, "map<string,string>")
    found = F.filter(
        T.constant(rows, f"array<{_OVERRIDE_ROW}>"), lambda w: w["id"] == F.col("workflow_id")
    )
    extra = F.concat(
        _list_if(F.col("needs_base_ring"), OVERRIDE_RULES["base_ring"]),
        _list_if(F.col("point_source") == "leading_coefficient_root", OVERRIDE_RULES["root"]),
        _list_if(F.col("wants_first_element_only"), OVERRIDE_RULES["first"]),
    )
    # Exploding the match (one row or none) keeps the rule list out of filters.
    known = decided.select(
        "*",
        F.element_at(names, F.col("family_id")).alias("family_name"),
        F.explode_outer(F.slice(found, 1, 1)).alias("__w"),
    ).filter("__w IS NOT NULL")
    symbols = F.array_distinct(F.concat("preferred_methods", "__w.symbols"))
    return known.withColumns(
        {
            "workflow_title": F.col("__w.title"),
            "preferred_symbols": F.filter(symbols, lambda s: s != ""),
            "prompt_rules": F.concat("__w.rules", extra),
            "tuning_params": F.col("__w.params"),
        }
    ).drop("__w")


# ---- obligations ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Obligation:
    """Generated text of ``method`` must hold all of ``needs``; each entry is a
    tuple of alternatives. ``flag`` names the boolean column that turns it on."""

    method: str
    needs: tuple[tuple[str, ...], ...]
    message: str
    flag: str = ""
    compact: bool = False
    forbidden: bool = False


# Fixed values; {receiver}, {argument} and {expression} are task columns.
OBLIGATIONS = (
    Obligation(
        "right_factors", ((".right_factors(",),),
        "Generated code does not call `right_factors`.",
    ),
    Obligation(
        "right_factors", (("len(factors) > 0", "bool("),),
        "Generated code does not answer the requested existence check for right factors.",
        flag="wants_boolean_answer",
    ),
    Obligation(
        "local_basis_expansions", ((".local_basis_expansions(",),),
        "Generated code does not call `local_basis_expansions`.",
    ),
    Obligation(
        "local_basis_expansions", (("leading_coefficient",), (".roots(",)),
        "Generated code does not resolve the requested leading-coefficient root before expansion.",
        flag="at_leading_root",
    ),
    Obligation(
        "local_basis_expansions", (("base_ring()",),),
        "Generated code does not print the requested base ring.",
        flag="needs_base_ring",
    ),
    Obligation(
        "local_basis_expansions", (("[0]",),),
        "Generated code does not restrict output to the requested first local basis element.",
        flag="wants_first_element_only",
    ),
    Obligation(
        "indicial_polynomial", ((".indicial_polynomial(",),),
        "Generated code does not call `indicial_polynomial`.",
    ),
    Obligation(
        "annihilator_of_polynomial", ((".annihilator_of_polynomial(",),),
        "Generated code does not call `annihilator_of_polynomial`.",
    ),
    Obligation(
        "annihilator_of_polynomial", (("p =", "{expression}"),),
        "Generated code does not define the requested polynomial expression.",
    ),
    Obligation(
        "annihilator_of_associate", ((".annihilator_of_associate(",),),
        "Generated code does not call `annihilator_of_associate`.",
    ),
    Obligation(
        "annihilator_of_associate", (("{receiver}.annihilator_of_associate({argument})",),),
        "Generated code does not use the resolved `receiver.annihilator_of_associate(argument)` "
        "call shape.",
        compact=True,
    ),
    Obligation(
        "annihilator_of_associate", (("{receiver}=",),),
        "Generated code does not define the resolved receiver operator.",
        compact=True,
    ),
    Obligation(
        "annihilator_of_associate", (("{argument}=",),),
        "Generated code does not define the resolved associate operator.",
        compact=True,
    ),
    Obligation(
        "annihilator_of_associate", (("A.annihilator_of_associate(",),),
        "Generated code calls `annihilator_of_associate` on the {algebra} instead of on the "
        "resolved operator.",
        compact=True, forbidden=True,
    ),
)
EMPTY_OUTPUT = ("annihilator_of_polynomial", "annihilator_of_associate")


def check_obligations(
    tasks: DataFrame,
    names: vocab.Names = DEFAULT_NAMES,
    obligations: Sequence[Obligation] = OBLIGATIONS,
) -> DataFrame:
    """Adds passed, blocking and advisory to task rows.

    ``tasks``: method_name, code, the flag columns, receiver, argument,
    expression, and status and stdout (NULL status: not executed).
    """
    code = T.strip("code")
    compact = F.regexp_replace(code, vocab.SPACE_CLASS + "+", "")
    slots = {
        "{receiver}": F.coalesce(T.blank_to_null("receiver"), F.lit("L")),
        "{argument}": F.coalesce(T.blank_to_null("argument"), F.lit("F")),
        "{expression}": T.or_empty("expression"),
    }

    def needle(text: str) -> Column:
        out = F.lit(text)
        for slot, value in slots.items():
            if slot in text:
                out = F.replace(out, F.lit(slot), value)
        return out

    issues = []
    for rule in obligations:
        where = compact if rule.compact else code
        met = F.lit(True)
        for alternatives in rule.needs:
            found = F.lit(False)
            for text in alternatives:
                found = found | F.contains(where, needle(text))
            met = met & found
        broken = met if rule.forbidden else ~met
        test = (F.col("method_name") == rule.method) & broken
        if rule.flag:
            test = test & F.col(rule.flag)
        issues.append(F.when(test, names.fill(rule.message)))
    shown = F.filter(F.transform(T.lines("stdout"), T.strip), lambda x: x != "")
    ran, failed = F.col("status") == "success", F.col("status") != "success"
    issues += [
        F.when(
            failed,
            F.concat(
                F.lit("Execution status was `"),
                F.col("status"),
                F.lit("`, so the request was not fully satisfied."),
            ),
        ),
        F.when(
            ran & F.col("needs_base_ring") & (F.size(shown) < 2),
            "Execution output does not show both the local basis result and the requested "
            "base ring.",
        ),
        F.when(
            ran & F.col("method_name").isin(*EMPTY_OUTPUT) & (F.size(shown) == 0),
            "Execution output is empty, so no annihilating operator was shown.",
        ),
    ]
    no_boolean = (
        ran
        & F.col("wants_boolean_answer")
        & ~F.arrays_overlap(shown, T.strings(["True", "False"]))
    )
    advisory = F.when(
        no_boolean, "Execution output does not visibly include a boolean existence answer."
    )
    has_task = F.col("method_name").isNotNull()
    none = F.array().cast("array<string>")
    checked = tasks.withColumn(
        "blocking",
        F.when(has_task, F.array_distinct(F.array_compact(F.array(*issues)))).otherwise(none),
    ).withColumn(
        "advisory", F.when(has_task, F.array_compact(F.array(advisory))).otherwise(none)
    )
    return checked.withColumn("passed", F.size("blocking") == 0)
