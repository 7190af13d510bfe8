import random

import pytest
from pyspark.sql import functions as F

from granary.operators import chunking as C
from granary.operators import extract as X


def packed_by_hand(lengths, size, overlap):
    """Greedy packing, page by page."""
    out, start = [], 0
    while start < len(lengths):
        end, total = start, 0
        while end < len(lengths):
            cost = lengths[end] + 20
            if end > start and total + cost > size:
                break
            total, end = total + cost, end + 1
        out.append((start + 1, end))
        if end >= len(lengths):
            break
        back, chars = end, 0
        while back > start and chars < overlap:
            back -= 1
            chars += lengths[back]
        start = max(back, start + 1)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(200, 40), (100, 0), (60, 500)])
def test_page_ranges_match_a_page_by_page_walk(spark, size, overlap):
    rng = random.Random(size)
    docs = {
        n: [rng.choice([0, 0, 3, 30, 90, 400]) for _ in range(count)]
        for n, count in enumerate([1, 2, 7, 60, 400])
    }
    rows = [(d, i + 1, "x" * n, "") for d, ls in docs.items() for i, n in enumerate(ls)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string, section_title string")
    # A tiny block size sends the longer documents through many blocks.
    found = C.page_ranges(pages, size, overlap, block=1).collect()
    for doc, lengths in docs.items():
        ranges = sorted(
            (r["chunk_no"], r["page_start"], r["page_end"]) for r in found if r["doc_id"] == doc
        )
        expected = packed_by_hand(lengths, size, overlap)
        assert [r[0] for r in ranges] == list(range(len(expected)))
        assert [r[1:] for r in ranges] == expected


def test_pack_pages_text(spark):
    rows = [(1, 1, "aa", ""), (1, 2, None, "T"), (1, 3, "c" * 90, "U")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string, section_title string")
    out = sorted(C.pack_pages(pages, 60, 1).collect(), key=lambda r: r["chunk_no"])
    assert [(r["page_start"], r["page_end"]) for r in out] == [(1, 2), (2, 2), (3, 3)]
    assert out[0]["text"] == "[PAGE 1]\naa\n\n[PAGE 2]\n"
    assert [r["section_title"] for r in out] == ["T", "T", "U"]


@pytest.mark.parametrize("length", [0, 1, 9, 10, 11, 17, 18, 500])
def test_fixed_windows_cover_the_text(spark, length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    row = spark.createDataFrame([(text,)], "t string").select(C.fixed_windows("t", 10, 3)).first()
    expected, start = [], 0
    while start < length:
        expected.append(text[start : start + 10])
        if start + 10 >= length:
            break
        start += 7
    assert row[0] == expected


def test_paragraph_windows():
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 10
    parts = C._windows_at_breaks(text, 50, 5, "\n\n")
    assert parts[0] == "a" * 30
    assert all(len(p) <= 50 for p in parts)
    assert parts[-1].endswith("c" * 10)


def test_narrative_windows_ids(spark):
    rows = [("n:1", "m", "T", "x" * 120, "f.py", ["r1"]), ("", "m", "T", "x", "", [])]
    sections = spark.createDataFrame(
        rows,
        "section_id string, module string, section_title string, text string, "
        "source_file string, resolved_symbol_ids array<string>",
    )
    out = C.narrative_windows(sections, size=80, overlap=10).orderBy("chunk_no").collect()
    assert [r["symbol_id"] for r in out] == ["n:1", "n:1:1", "n:1:2"][: len(out)]
    assert out[0]["text"].startswith("Narrative: T\nModule: m\nSource: f.py\nRelated symbols: r1")


@pytest.mark.parametrize(
    ("page", "title"),
    [
        ("intro\n 2.1  Basic rings \n", "2.1 Basic rings"),
        ("chapter 3: Local theory", "chapter 3: Local theory"),
        ("x" * 141 + "\n1 ab", ""),
        ("1 A B C D E F G H I J K\nChapter 1 Sets", "Chapter 1 Sets"),
        ("", ""),
    ],
)
def test_detect_section_title(spark, page, title):
    row = spark.createDataFrame([(page,)], "t string").select(C.detect_section_title("t")).first()
    assert row[0] == title


def test_carry_forward_across_blocks(spark):
    titles = {2: "A", 11: "B", 40: "C"}
    rows = [(1, p, titles.get(p, "")) for p in range(1, 60)] + [(2, 1, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, section_title string")
    out = C.carry_forward_section(pages, block=4).collect()
    for r in out:
        known = [p for p in titles if r["doc_id"] == 1 and p <= r["page"]]
        assert r["section_title"] == (titles[max(known)] if known else "")


def test_sections_of_headings(spark):
    doc = "pre\n\nTitle\n=====\n\nbody\n.. rubric:: Note\nUnder\n-----\n---\nend\n"
    row = spark.createDataFrame([(doc,)], "t string").select(
        X.split_doc_sections("t", F.lit("mod")).alias("s")
    )
    found = [tuple(s) for s in row.first()["s"]]
    assert found == [("mod", "pre"), ("Title", "body"), ("Under", "---\nend")]


def test_merge_short_sections(spark):
    long = "w" * 40
    sections = [("a", ""), ("b", "short"), ("c", ""), ("d", long), ("e", "tail")]
    df = spark.createDataFrame(
        [(sections,), ([("x", "")],)], "s array<struct<title:string,text:string>>"
    )
    out = [r[0] for r in df.select(X.merge_short_sections("s", min_chars=30)).collect()]
    assert [tuple(s) for s in out[0]] == [("b", "short\n\nc"), ("d", f"{long}\n\ne\ntail")]
    assert out[1] == []


def test_extract_refs(spark):
    text = (
        "See :meth:`~a.B.run` and :class:`Ring`.\n"
        "sage: from pack.mod import Gen, solve, *\n"
        "sage: x.solve(1).Apply (2)\nsage: Call(3)\nsage: _no(4)\n"
    )
    row = spark.createDataFrame([(text,)], "t string").select(X.extract_refs("t", "pack")).first()
    assert row[0] == ["a.B.run", "Ring", "Gen", "solve", "pack.mod", "Call"]


SOURCE = '''"""Module text."""
import os

class Box(Base, flag=True, **extra):
    """A box.

    sage: Box(1)
    """
    def get(self, x, *rest, key=None): pass
    def _hidden(self): pass
    async def wait(self): "Waits."
    class Inner:
        def deep(self): pass

def free(a: int = 1) -> int:
    def local(): pass
    return a

def _private(): pass
'''


def test_extract_symbols(spark):
    files = spark.createDataFrame(
        [
            ("r/pkg/a.py", SOURCE),
            ("r/pkg/bad.py", "def broken(:"),
            (
                "r/c.pyx",
                "cdef int x\nclass Fast:\n    '''Doc\n    two'''\n    def go(self, a ):\n"
                "        pass\ndef after():\n    # note\n\n    'one'\n    \"\"\"no\"\"\"\n",
            ),
        ],
        "path string, source string",
    )
    scanned = X.scan_sources(files).cache()
    rows = {r["id"]: r for r in X.extract_symbols(scanned, "r").collect()}
    assert rows["pkg.a.Box"]["signature"] == "Box(Base, flag=True, **extra)"
    assert rows["pkg.a.Box"]["examples"] == ["sage: Box(1)"]
    assert rows["pkg.a.Box.get"]["signature"] == "get(self, x, *rest, key=None)"
    assert rows["pkg.a.Box.get"]["kind"] == "method"
    assert rows["pkg.a.Box.wait"]["summary"] == "Waits."
    assert rows["pkg.a.Box.Inner.deep"]["kind"] == "method"
    assert rows["pkg.a.free"]["signature"] == "free(a: int=1)"
    assert "pkg.a._private" not in rows and "pkg.a.Box._hidden" not in rows
    assert rows["c.Fast"]["docstring"] == "Doc\n    two"
    assert rows["c.Fast.go"]["signature"] == "go(self, a)"
    assert rows["c.after"]["docstring"] == ""
    assert [r["path"] for r in X.extraction_errors(scanned).collect()] == ["r/pkg/bad.py"]
    docs = {r["module"]: r["docstring"] for r in X.extract_module_docs(scanned, "root", "r").collect()}
    assert docs == {"pkg.a": "Module text.", "pkg.bad": None, "c": None}
    only_bad = scanned.filter(F.col("path").endswith("bad.py"))
    with pytest.raises(RuntimeError):
        X.require_some_parsed(only_bad)


def test_source_modes(spark):
    rows = spark.createDataFrame([(1, 0, "x")], "doc_id long, chunk_no long, text string")
    assert C.select_sources("pdf", pdf=rows).count() == 1
    with pytest.raises(ValueError):
        C.select_sources("pdf", generated=rows)
    with pytest.raises(ValueError):
        C.select_sources("all", pdf=rows)
