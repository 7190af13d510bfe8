import pytest
from pyspark.sql import functions as F

from granary import vocab
from granary.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Foo_1 9bar ÉtÉ", ["foo_1", "bar", "t"]), ("", []), (None, []), ("a.b A", ["a", "b", "a"])],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, T.tokenize("x")) == tokens


def test_term_counts(spark):
    rows = one(spark, "b a b c b", T.term_counts(T.tokenize("x")))
    assert [tuple(r) for r in rows] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(spark, "", T.term_counts(T.tokenize("x"))) == []


def test_unicode_space(spark):
    text = "  A\x1cB\xa0c D\t"
    assert one(spark, text, T.normalize_text("x")) == " ".join(text.lower().split())
    assert one(spark, text, T.strip("x")) == text.strip()


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb\r\nc\x0bd\x85e", "\n\n", "x y\n"])
def test_lines_follow_splitlines(spark, text):
    assert one(spark, text, T.lines("x")) == text.splitlines()


@pytest.mark.parametrize(
    ("token", "forms"),
    [
        ("queries", ["queries", "query"]),
        ("ties", ["ties", "tie"]),
        ("class", ["class"]),
        ("gas", ["gas"]),
        ("rings", ["rings", "ring"]),
        (" ", []),
    ],
)
def test_token_forms(spark, token, forms):
    assert one(spark, token, T.token_forms(F.col("x"))) == forms


@pytest.mark.parametrize(
    ("name", "words"),
    [
        ("HTTPServerError2x", ["http", "server", "error", "2", "x"]),
        ("snake_case.Name", ["snake", "case", "name"]),
        ("ABc", ["a", "bc"]),
        ("", []),
    ],
)
def test_split_symbol_words(spark, name, words):
    assert one(spark, name, T.split_symbol_words("x")) == words


def test_names(spark):
    assert one(spark, "a.b.c", T.owner_of("x")) == "a.b"
    assert one(spark, "a", T.owner_of("x")) == ""
    assert one(spark, "a.b.c", T.tail_of("x")) == "c"
    assert one(spark, "Ünï Title! ", T.slugify("x")) == "n_title"
    assert one(spark, "--", T.slugify("x")) == "untitled"
    assert one(spark, "pkg/mod/__init__.py", T.package_module_name("x", "root")) == "pkg.mod"
    assert one(spark, "__init__.py", T.package_module_name("x", "root")) == "root"
    assert one(spark, "pkg/mod.spyx", T.module_name("x")) == "pkg.mod"


def test_truncate_output(spark):
    shown, cut = T.truncate_output("x")
    assert one(spark, "a" * 2000, cut) is False
    long = one(spark, "a" * 2001, shown)
    assert len(long) == 2000
    assert long.endswith("Suggest querying specific properties like .degree() or .coefficient().")


def test_fenced_block(spark):
    text = "see ```SageMath\nx = 1\n``` and ```python\ny\n```"
    # The first language name that fits is taken, the rest is code.
    assert one(spark, text, T.extract_fenced_block("x")) == "Math\nx = 1"
    assert one(spark, " plain ", T.extract_fenced_block("x")) == "plain"


def test_names_fill():
    names = vocab.Names(package="p", constructor="Thing", algebra="thing algebra")
    assert names.fill("install {package}") == "install p"
    assert names.fill("{constructor_lower} {constructor}") == "thing Thing"
