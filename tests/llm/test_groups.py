"""Spelling groups, prefix trie and LSH forest against brute force, and their edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import lshforest, prefixtrie, spelling

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- spelling --------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(docs, min_length=7, min_count=2, ratio=10, every=31):
    counts = collections.Counter()
    for i, text in docs:
        for word in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_length:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    by_length = collections.defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    others = {w: [x for n in (-1, 0, 1) for x in by_length[len(w) + n] if near(w, x)] for w in counts}
    form = {}
    for word, n in counts.items():
        best = min(others[word], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[word] = best
    rows = []
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        rows.append((word, form.get(word), root, n, len(others[word]), counts.get(form.get(word))))
    return sorted(rows, key=repr)


def groups(frame, **options):
    return sorted(map(tuple, spelling.spelling_groups(frame, **options).collect()), key=repr)


@pytest.mark.parametrize("symbols", [1, 4])
def test_spelling(spark, symbols):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    frame = frame.filter("length(text) < 900") if symbols == 1 else frame
    docs = [tuple(r) for r in frame.collect()]
    assert groups(frame, symbols=symbols) == slow_groups(docs)
    if symbols == 1:
        assert groups(frame, ratio=2, min_length=5, symbols=symbols) == slow_groups(docs, 5, ratio=2)


def test_spelling_edges(spark):
    long = "qu" * 5_000
    chain = ["colours"] * 200 + ["colourz"] * 20 + ["colouraz"] * 2
    texts = [
        " ".join(chain),
        None,
        "",
        "École écoles ÉCOLES écoles Ècoles ×÷a×bcde 漢字 school's",
        f"{long} {long} {long[:-1]} {long[:-1]}",
        f"{long} {long} {long[:-1]} {long[:-1]}",
        "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaab aaaaaab baaaaaa baaaaaa",
    ]
    rows = [*enumerate(texts), (None, "without without withot an identity identity"), (6, texts[6])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1))
    assert groups(frame) == slow_groups(rows)
    assert groups(frame, every=2, ratio=3, min_length=4) == slow_groups(rows, 4, ratio=3, every=2)
    assert groups(frame.limit(0)) == []
    found = {r[0]: r for r in groups(frame, every=1 << 40)}
    assert found["colouraz"][1:3] == ("colourz", "colours") and found["colourz"][2] == "colours"
    assert found[long][4] == 1


def test_neighbourhood_is_whole():
    word = np.array([[1, 2, 2, 3]], np.uint64)
    made = {int(k) for _, keys in spelling.neighbourhood(word, 3) for k in keys}
    forms = {(1, 2, 2, 3)}
    own = [1, 2, 2, 3]
    for p in range(5):
        forms |= {tuple(own[:p] + [s] + own[p:]) for s in (1, 2, 3)}
        if p < 4:
            forms.add(tuple(own[:p] + own[p + 1 :]))
            forms |= {tuple(own[:p] + [s] + own[p + 1 :]) for s in (1, 2, 3)}
    assert made == {int(spelling.form_hash(np.array([f], np.uint64))[0]) for f in forms}


def test_spelling_by_shuffle(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    words = spelling.with_form(spelling.count_words(frame).filter("n > 1")).cache()
    few = sorted(map(tuple, spelling.near_words(words).collect()))
    assert few and few == sorted(map(tuple, spelling.near_words(words, broadcast_forms=3).collect()))


# -- prefix trie -----------------------------------------------------------


def slow_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, made = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        made.append(
            (
                min(members[node]),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(members[node]),
                len(children[node]),
                leaves[node],
                saved[node],
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(made, key=repr)


def trie(frame, **options):
    return sorted(map(tuple, prefixtrie.prefix_trie(frame, **options).collect()), key=repr)


@pytest.mark.parametrize("limit", [4_096, 3])
def test_trie(spark, limit):
    frame = spark.read.parquet(f"{MIDDLE}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert trie(frame, component_nodes=limit) == slow_trie(rows)


def test_trie_edges(spark, monkeypatch):
    rows = [
        (100, 0, "user", "é\U0001f600"),
        (100, None, None, None),
        (100, 1, "assistant", "b"),
        (100, 1, "assistant", "b"),
        (100, 1, "assistant", "a"),
        (None, 1, "user", "lost"),
        (199, 0, "user", "x"),
        *((101 + i, t, "user", f"turn {t}") for i in range(40) for t in range(i % 5)),
        *((700, t, "user", "a" * (t % 3)) for t in range(60)),
        *((300 + i, 0, "user", "same") for i in range(30)),
        (-5, 0, "user", "below zero"),
        (2**40, 0, None, "far"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    frame = frame.withColumn("d", F.lit("x")).withColumn("p", F.lit("x")).withColumn("owned", F.lit("x"))
    wanted = slow_trie(rows)
    monkeypatch.setattr(prefixtrie, "BLOCK", 7)
    monkeypatch.setattr(prefixtrie, "IDS", 4)
    for limit in (2, 4_096):
        assert trie(frame, component_nodes=limit) == wanted
    assert trie(frame.limit(0)) == []


def test_centroid_sums():
    draw = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 400):
        for shape in ("random", "chain", "star"):
            parent = [-1] + [{"random": int(draw.integers(0, i)), "chain": i - 1, "star": 0}[shape] for i in range(1, n)]
            values = draw.integers(0, 9, (n, 2))
            slow = values.copy()
            for i in range(n - 1, 0, -1):
                slow[parent[i]] += slow[i]
            assert (prefixtrie.centroid_sums(parent, values) == slow).all()


# -- forest ----------------------------------------------------------------


def slow_forest(rows, percent=80):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def forest(frame, **options):
    return sorted(map(tuple, lshforest.forest_groups(frame, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"branch_pairs": 0}, {"branch_pairs": 2, "depth": 3}])
def test_forest(spark, options):
    frame = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    assert forest(frame, **options) == slow_forest([tuple(r) for r in frame.collect()])


def test_forest_at_the_limit(spark):
    """Pairs of just the similarity, in a crowd that shares most of its words and links little."""
    draw = np.random.default_rng(11)
    word = [f"w{i}" for i in range(20_000)]
    rows, base = [], list(draw.choice(word, 41, replace=False))
    for i in range(300):  # 28 of 40 shingles in common: similarity 0.54
        rows.append((i, " ".join(base[:29] + list(draw.choice(word, 12)))))
    for i in range(0, 300, 10):  # 36 of 40: 36 / 44 = 0.818
        rows.append((1_000 + i, " ".join(rows[i][1].split()[:37] + list(draw.choice(word, 4)))))
    for n in (4, 9, 40, 200):  # 4 n of 5 n: just 0.8
        own = list(draw.choice(word, 5 * n + 1, replace=False))
        rows += [(2_000 + n, " ".join(own)), (3_000 + n, " ".join(own[: 4 * n + 1]))]
        rows += [(4_000 + n, " ".join(own[: 4 * n]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = slow_forest(rows)
    assert forest(frame) == wanted
    assert forest(frame, branch_pairs=0, depth=3) == wanted


def test_tiles(spark, monkeypatch):
    """Links of tiles join the same components as all pairs, whatever the tiles."""
    monkeypatch.setattr(lshforest, "TILE_COMMON", 50)
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 62, 60)
    rows = []
    for i in range(80):
        own = base.copy()
        own[draw.choice(60, i % 9, replace=False)] = draw.integers(0, 1 << 62, i % 9)
        rows.append((i, np.unique(own.astype(np.uint64)).view(np.int64).tolist()))
    sets = spark.createDataFrame(rows, "id long, hashes array<long>")
    roots = {i: i % 4 if i < 20 else i for i, _ in rows}
    links = {(i, r) for i, r in roots.items()}
    for i, a in rows:
        links |= {(i, j) for j, b in rows if i < j and 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})}

    def components(pairs):
        label = dict.fromkeys(roots)
        for i in label:
            label[i] = i
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                least = min(label[a], label[b])
                changed |= label[a] != least or label[b] != least
                label[a] = label[b] = least
        return label

    wanted = components(links)
    frame = spark.createDataFrame([(7, i, r, 0) for i, r in roots.items()], "key long, id long, root long, main long")
    for tile in (2, 1_000):
        found = lshforest.tile_links(frame, sets, 80, tile_texts=tile, tile_shingles=200 * tile).collect()
        assert components([(r["a"], r["b"]) for r in found] + list(roots.items())) == wanted


def test_forest_edges(spark):
    long = " ".join(f"word{i % 9_000}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, long), (8, long + " more")]
    rows += [(9, "ÄRGER ärger"), (10, "ärger ärger"), (6, "one two"), (None, "ONE\ttwo"), (None, "alone here"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.select("*", *(F.lit("x").alias(c) for c in ("id", "row", "node", "size", "sig", "key", "root", "n_shingles")))
    found = lshforest.forest_groups(frame).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: tuple(r)[1:] for r in found if r["doc_id"] is not None}
    assert by_id == {
        1: (0, 1, True),
        2: (0, 2, True),
        3: (0, 3, True),
        4: (1, 4, True),
        5: (1, 4, False),
        6: (1, 6, True),
        7: (9_000, 7, True),
        8: (9_001, 7, False),
        9: (1, 9, True),
        10: (1, 10, True),
    }
    without = sorted((r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in found if r["doc_id"] is None)
    assert without == [(0, 0, True), (1, 0, True), (1, 6, False)]
    assert forest(frame.limit(0)) == []
