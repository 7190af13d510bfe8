"""Word lists, limits, patterns and formats.

These have to equal the published behaviour for results to match, so they
are kept as plain text in one place. Names of a documented package are
placeholders filled from ``Names``.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: patterns ------------------------------------------------
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
SYMBOL_PART = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*)\s+(.{3,120})\s*$"
CHAPTER_HEADING = r"(?i)^\s*Chapter\s+\d+\s*[:.-]?\s*(.{3,120})\s*$"
# White space and line ends as Unicode text defines them.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# ---- fixed values: query word lists -----------------------------------------
RERANK_STOPWORDS = (
    "a", "an", "and", "at", "by", "compute", "find", "for", "from", "handle",
    "of", "or", "the", "this", "to", "use", "with",
)
GRAPH_STOPWORDS = (
    "a", "an", "and", "at", "by", "compute", "find", "for", "from", "in",
    "of", "on", "or", "the", "to", "use", "with",
)
SYMBOL_TOKEN_ALIASES = {
    "rec": ("recurrence",),
    "deq": ("differential", "equation"),
}
SYMBOL_QUERY_ALIASES = {
    "desingularize": ("apparent", "singularities", "remove"),
    "differentialoperators": ("derivation", "differential", "operator"),
    "guess_deq": ("infer", "recover", "differential", "equation"),
    "guess_rec": ("infer", "recover", "recurrence", "sample", "coefficients"),
    "numerical_solution": ("evaluate", "solution", "initial", "condition"),
    "numerical_transition_matrix": ("transition", "matrix", "path"),
    "{constructor_lower}": ("derivation", "operator", "algebra"),
    "symmetric_power": ("square", "annihilator", "solution", "d-finite"),
    "symmetric_product": ("product", "annihilator"),
    "to_list": ("terms", "values", "sequence"),
    "to_s": ("taylor", "coefficient", "coefficients", "recurrence"),
}
SYMBOL_FOCUS_ALIASES = {
    "ct": ("creative telescoping", "telescoper", "certificate", "certificates"),
    "desingularize": ("apparent singularities", "remove apparent singularities"),
    "evaluate": ("evaluate", "function value", "value"),
    "eliminate": ("elimination", "eliminate"),
    "forward_matrix_bsplit": (
        "forward_matrix_bsplit", "large recurrence term", "large term", "large n",
    ),
    "fglm": ("fglm", "groebner basis", "left ideal"),
    "guess_deq": ("differential equation", "infer an operator"),
    "guess_rec": (
        "guess recurrence", "infer a recurrence", "recover recurrence", "sample coefficients",
    ),
    "groebner_basis": ("groebner basis", "buchberger", "left ideal"),
    "ideal": ("left ideal", "annihilating ideal", "multivariate {algebra}"),
    "numerical_solution": (
        "evaluate the solution", "numerically", "initial condition", "initial conditions", "f(0)",
    ),
    "numerical_transition_matrix": ("transition matrix", "continue along a path", "path"),
    "{constructor_lower}": (
        "{algebra}", "multivariate {algebra}", "several variables", "several generators",
    ),
    "symmetric_power": ("symmetric square", "square of", "square"),
    "to_list": ("first terms", "first values", "sequence terms"),
    "to_s": (
        "taylor coefficients", "taylor-coefficient recurrence", "coefficient-side recurrence",
        "coefficient recurrence",
    ),
}

# ---- fixed values: routing ----------------------------------------------------
OUT_OF_SCOPE = (
    "favorite color", "write a poem", "poem about", "what this app can do", "install {package}",
    "install {package_words}",
)
PROOF_SUBJECTS = ("theorem", "conjecture", "new result")
CONCEPTUAL = ("conceptually", "at a high level", "high level")
ACTIONS = (
    "compute", "evaluate", "find", "guess", "construct", "create", "convert", "desingularize",
    "factor", "gcrd", "lclm", "transition matrix", "first terms", "annihilator", "numerical",
    "to_s", "to_d", "to_f", "to_t",
)
FAMILY_META = (
    "which capability family", "what capability family", "which workflow family",
    "what workflow family", "which family covers", "what family covers",
    "which category covers", "what category covers", "which branch covers",
    "what branch covers",
)
DOCUMENT_MARKERS = (
    "pdf", "paper", "user guide", "documentation", "docs", "manual", "section", "theorem",
    "proof", "algorithmic technique",
)
GOAL_MARKERS = (
    " and ", " then ", " after ", " compare ", " both ", " first ", " second ", " finally ",
)
CONSTRAINT_MARKERS = (
    " with ", " without ", " subject to ", " verify ", " prove ", " show that ", " expected ",
    " must ",
)
KNOWN_API_MARKERS = (
    "{constructor_lower}", "differentialoperators", "annihilator", "telescoping", "recurrence",
)
NOT_A_GAP = (
    "blocked import detected", "blocked builtin", "execution timed out", "timed out after",
    "code is empty", "syntaxerror",
)
GAP = (
    "nameerror", "not defined", "attributeerror", "has no attribute", "importerror",
    "no module named", "unknown", "cannot import name",
)
IMPORT_ERRORS = (
    "nameerror", "not defined", "importerror", "no module named", "cannot import name",
    "attributeerror",
)
GENERATOR_ERRORS = (
    "generator/base-variable mismatch", "generator binding/access issue",
    "unbound generator issue",
)
ROUTE_REASONS = {
    "fast_asked": "User selected Fast mode.",
    "plan_asked": "User selected Plan mode.",
    "plan_pdf": "Question appears PDF/doc-dependent but first-pass retrieval lacks PDF evidence.",
    "auto_fast": "Low complexity and high first-pass retrieval confidence.",
    "auto": "Medium complexity or moderate confidence; allow one targeted retry.",
    "plan": "High complexity or low confidence; use plan flow.",
}

# ---- fixed values: limits and texts ------------------------------------------------
OUTPUT_LIMIT = 2000
OUTPUT_HINT = (
    "[Output Truncated] ... Total length: {length} chars. "
    "Suggest querying specific properties like .degree() or .coefficient()."
)
FENCE_LANGUAGES = ("python", "sage", "sagemath")
EXAMPLE_PROMPT = "sage:"


@dataclass(frozen=True)
class Names:
    """Names of the documented package, filled into the marker templates.

    ``package`` is the import name, ``constructor`` its main class and
    ``algebra`` what its users call the main object in prose.
    """

    package: str = "package"
    constructor: str = "Constructor"
    algebra: str = "main algebra"

    def fill(self, text: str) -> str:
        return (
            text.replace("{package}", self.package)
            .replace("{package_words}", self.package.replace("_", " "))
            .replace("{constructor}", self.constructor)
            .replace("{constructor_lower}", self.constructor.lower())
            .replace("{algebra}", self.algebra)
        )

    def fill_all(self, items) -> tuple[str, ...]:
        return tuple(self.fill(item) for item in items)

    def fill_map(self, table) -> dict[str, tuple[str, ...]]:
        return {self.fill(key): self.fill_all(words) for key, words in table.items()}
