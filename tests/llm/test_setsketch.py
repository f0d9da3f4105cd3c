"""SetSketch near duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import jaccard_join, setsketch


def shingle_set(text, words):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        own = own.replace(c, " ")
    own = [w for w in own.split(" ") if w]
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def brute(rows, words=5, share=85):
    sets = [shingle_set(text, words) for _, text in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= share * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        name = names.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), name, doc == name))
    return Counter(out)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, node long, key long, point string").repartition(3)
    return Counter(map(tuple, setsketch.near_duplicates(frame).collect()))


def copies(draw, text, times, changes):
    for _ in range(times):
        words = text.split(" ")
        for _ in range(draw.randint(1, changes)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        yield " ".join(words)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.choice([1, 4, 5, 6, 30, 120, 400]))) for _ in range(80)]
    texts += [t for i in (60, 61, 62, 63) for t in copies(draw, texts[i], 10, 6)]
    texts += ["", None, " \t", texts[70].upper(), texts[70].replace(" ", "\n"), texts[70], texts[70], "É é", "É É", "a b", "A  b"]
    rows = [(i, t) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    return rows + [(None, texts[71]), (None, None), (None, "only here"), (3, texts[72]), (3, texts[72])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_family_of_near_copies_in_tiles(spark, monkeypatch):
    """Copies of copies: few are linked with one hub, tiles are dense and compare in place."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    monkeypatch.setattr(jaccard_join, "DENSE", 16)
    draw = random.Random(4)
    text = " ".join(f"w{draw.randrange(500)}" for _ in range(150))
    texts = [text]
    for _ in range(90):
        texts += copies(draw, draw.choice(texts), 1, 3)
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (2, "a")], [(1, "a b c d e f " * 30_000), (2, "a b c d e f " * 30_000 + "g")]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        for n in (1, 7, 33, 200, 2000):
            found, equal = [], []
            for _ in range(40):
                a = draw.integers(0, 2**63, n).astype(np.uint64)
                both = round(2 * n * 0.7 / 1.7)
                b = np.concatenate([a[:both], draw.integers(0, 2**63, n - both).astype(np.uint64)])
                x, y = setsketch.sketch(a), setsketch.sketch(b)
                assert (setsketch.sketch(np.union1d(a, b)) == setsketch.merged(x, y)).all()
                counts = [np.array([float(v)]) for v in (n, n, (x > y).sum(), (x < y).sum(), (x == y).sum())]
                found.append(setsketch.estimate(*counts)[0])
                equal.append((x == y).mean())
            true = both / (2 * n - both)
            assert abs(np.mean(found) - true) < 0.03 and abs(np.mean(equal) - true) < 0.03


def test_dense_tiles_give_a_forest(spark):
    """Two families of near copies under one key: a tile of k sets gives at most k - 1 links."""
    draw = np.random.default_rng(6)
    sets = []
    for _ in range(2):
        core = draw.integers(0, 2**63, 200)
        sets += [np.unique(np.concatenate([core, draw.integers(0, 2**63, 6)])).astype(np.uint64) for _ in range(30)]
    with np.errstate(over="ignore"):
        rows = [(i, len(s), setsketch.sketch(s).tobytes(), s.tobytes()) for i, s in enumerate(sets)]
    every = spark.createDataFrame([(i, n, bytearray(p), bytearray(s)) for i, n, p, s in rows], "node long, n long, point binary, own binary")
    groups = every.select(jaccard_join.F.lit(1).cast("long").alias("key"), "node")
    label = spark.createDataFrame([], "node long, root long")
    verify = lambda pairs: pairs  # noqa: E731  nothing may come here
    found = jaccard_join.further_links(groups, label, every.drop("own"), lambda *tile: setsketch.near_pairs(*tile, 85), verify, lambda nodes: every.select("node", "own").join(nodes, "node"), 85).collect()
    assert len(found) == 58 and all((r["u"] < 30) == (r["v"] < 30) for r in found)
