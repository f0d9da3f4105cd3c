"""Prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import prefix_trie


def brute(rows, family=100):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % family, [])[:h] + ts[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
            if d:
                kids[whole[: d - 1]].add(whole[:d])
        ends[whole].append(c)
    found, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids[node]]
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        found.append((min(members[node]), len(node), parent, len(members[node]), len(kids[node]), *totals[node], digest))
    return Counter(found)


def got(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, d int, p1 string")
    return Counter(map(tuple, prefix_trie.trie(frame.repartition(3), **options).collect()))


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in range(260):
        turns = draw.randint(1, 8)
        # Few different texts, so that many conversations begin alike.
        rows += [(c, t, draw.choice(["user", "user", "assistant"]), draw.choice(["ä" * 3, "b", "cc", ""])) for t in range(turns)]
    # Conversations alike throughout, also under ids whose family has no first one.
    rows += [(c, t, "user", "same") for c in range(1001, 1140) for t in range(3)]
    # Null and repeated places, rows told apart by nothing, a null id.
    rows += [(500, None, "user", "n"), (500, None, None, "n"), (500, 1, "b", None), (500, 1, "a", "z"), (500, 1, "a", "y"), (500, 1, "a", "y"), (None, 1, "user", "x"), (501, 5, "user", "n")]
    draw.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = conversations(3)
    found = got(spark, rows)
    assert found == brute(rows)
    # Small shards meet in spines, small segments in one digest.
    assert got(spark, rows, shard=40) == found


def test_conversations_cut_by_slices(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(c, t, "user", draw.choice("ab")) for c in (100, 200, 7) for t in range(300)]
    rows += [(c, t, "user", f"{t % 5}") for c in (301, 302) for t in range(700)] + [(303, 0, "user", "0")]
    # A run of equal turns longer than any slice.
    rows += [(400, 1, "user", "again")] * 900 + [(401, 1, "user", "again")] * 5
    monkeypatch.setattr(prefix_trie, "LEAVES", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_row_per_two_leaves_and_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAVES", 2)
    monkeypatch.setattr(prefix_trie.joined_digests, "__defaults__", (3,))
    rows = conversations(4)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "x")], [(3, 0, "user", "x"), (4, 0, "user", "y")], [(None, 0, "user", "x")], [(0, 0, "user", "long" * 300_000), (6, 0, "user", "long" * 300_000)]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [2, 8, 64])
def test_find_close(block):
    draw = random.Random(block)
    for _ in range(30):
        bits, depth = [True], 1
        while len(bits) < draw.choice([10, 300, 3000]):
            step = depth == 1 or draw.random() < 0.52
            bits.append(step)
            depth += 1 if step else -1
        bits += [False] * depth
        bits = np.array(bits)
        stack, match = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                match[stack.pop()] = i
        sequence = prefix_trie.Parentheses(bits, block)
        opens = np.flatnonzero(bits)
        closes = sequence.find_close(opens)
        assert closes.tolist() == [match[i] for i in opens.tolist()]
        leaves = [int((bits[i:j] & ~bits[i + 1 : j + 1]).sum()) for i, j in zip(opens, closes)]
        assert sequence.leaves(opens, closes).tolist() == leaves
