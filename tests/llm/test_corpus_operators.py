"""Operators over whole tables against brute force: archives, neighbours, joins and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from catalog.check import compare
from quarry.llm import jaccard_join, kmeans_tree, warc
from quarry.llm.common import fresh_folder, stored
from quarry.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, name):
    good, note = compare(spark, data, name, QUERIES[name], SQL[name])
    assert good, note


def test_all_operators_are_registered():
    names = set(registry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def test_archives(spark):
    big = "<p>" + "ä" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://a.example/1", big), (2, "http://b.example/2", big), (9, None, big), (1, "u", "small"), (3, "u", "small"), (4, "u", None), (7, "http://a b\r\n/", ""), (8, "x", "y" * 300_000)]
    rows += [(11, "r", big), (11, "r", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    folder = fresh_folder(spark, "warc-test")
    warc.write_archives(warc.captures_of(pages), folder, records=7)
    records = warc.read_archives(spark, folder)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records)
    full = captures.collect()
    assert len(full) == len(rows) and all(r["n_requests"] >= 1 and r["request"] and r["metadata"] for r in full)
    found = warc.page_summary(captures).collect()
    holder = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            holder[html] = min(i, holder.get(html, i))
    expected = []
    for i, _, html in rows:
        content = (html or "").encode()
        first = holder.get(html)
        again = i is not None and first is not None and i > first
        expected.append((i, len(content), hashlib.sha256(content).hexdigest(), "revisit" if again else "response", first if again else None))
    assert Counter(map(tuple, found)) == Counter(expected)
    response = next(r for r in full if r["record_type"] == "response" and r["response"]["payload_bytes"] == len(big.encode()))
    assert bytes(response["response"]["payload"]) == big.encode()


def test_archives_of_members_and_partners(spark, folder):
    import gzip

    def record(kind, name, content, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in ({"WARC_Type": kind, "WARC_Record_ID": name} | more).items())
        return f"WARC/1.0\r\n{head}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"

    http = {"Content_Type": "application/http;msgtype=response"}
    parts = [
        record("warcinfo", "<i>", b"software: x"), record("response", "<r1>", b"HTTP/1.1 200 OK\r\n\r\nbody", **http),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r1>"), record("metadata", "<m1>", b"via: y\r\n", WARC_Concurrent_To="<q1>", Content_Type="application/warc-fields"),
        record("response", "<r2>", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Concurrent_To="<q2>", **http), record("request", "<q2>", b"GET /2 HTTP/1.1\r\n\r\n"),
        record("response", "<r3>", b"HTTP/1.1 200 OK\r\n\r\nalone", **http), record("metadata", "<m9>", b"", WARC_Concurrent_To="<gone>"),
    ]
    with open(f"{folder}/members.warc.gz", "wb") as out:
        for part in parts:
            out.write(gzip.compress(part))
    with open(f"{folder}/plain.warc", "wb") as out:
        out.write(record("response", "<p1>", b"HTTP/1.1 200 OK\r\n\r\nplain", **http))
    found = {r["capture_id"]: r for r in warc.assemble(warc.read_archives(spark, folder)).collect()}
    assert set(found) == {"<r1>", "<r2>", "<r3>", "<p1>"}
    assert found["<r1>"]["request"]["record_id"] == "<q1>" and found["<r1>"]["metadata"]["record_id"] == "<m1>"
    assert found["<r2>"]["request"]["record_id"] == "<q2>" and found["<r2>"]["n_metadata"] == 0
    assert found["<r3>"]["request"] is None and bytes(found["<p1>"]["response"]["payload"]) == b"plain"


def test_empty_archives(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = fresh_folder(spark, "warc-empty")
    warc.write_archives(warc.captures_of(pages), folder)
    assert warc.page_summary(warc.assemble(warc.read_archives(spark, folder))).collect() == []


def recalled(rows, vectors, k):
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids])
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for query, own in by.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and query not in [v for _, v, _ in own]
        scores = {i: float(s) for i, s in zip(ids.tolist(), np.einsum("rd,d->r", matrix, np.array(vectors[query]))) if i != query}
        assert all(abs(scores[v] - s) < 1e-9 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        true = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        hit += len(set(true) & {v for _, v, _ in own})
        total += len(true)
    return by, hit / max(1, total)


def test_tree_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    vectors = {i: (centres[i % 12] + rng.normal(size=16)).tolist() for i in range(3_000)}
    # A third of the rows are one vector.
    vectors |= {3_000 + i: [0.5] * 16 for i in range(1_500)}
    rows = [(i, v, "x", 1) for i, v in vectors.items()]
    rows += [(9_000, None, "x", 1), (9_020, [0.0] * 16, "x", 1), (9_040, [float("nan")] * 16, "x", 1), (9_060, [1.0] * 15 + [None], "x", 1), (9_080, [1.0] * 3, "x", 1), (None, [1.0] * 16, "x", 1), (9_100, [math.inf] * 16, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, leaf int")
    by, recall = recalled(kmeans_tree.search(table, leaf=100, block=200).collect(), vectors, 20)
    assert set(by) == {i for i in vectors if i % 20 == 0} and recall >= 0.9


def test_tree_search_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert kmeans_tree.search(spark.createDataFrame([], schema)).collect() == []
    rows = kmeans_tree.search(spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [0.0, 1.0])], schema)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows) == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]


def shingle_set(text, words):
    seen = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not seen:
        return frozenset()
    return frozenset(tuple(seen[i : i + words]) for i in range(len(seen) - words + 1)) if len(seen) >= words else frozenset([tuple(seen)])


def by_force(rows, words, share):
    sets = [shingle_set(text, words) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def near_copies(seed):
    """Families of copies with changed words, near the border of being linked; passages in many documents."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(55)]
    rows = []
    for family in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 150, 400]))]
        if family % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    chain = [word() for _ in range(120)]
    for step in range(30):
        chain[step * 4 % 120] = word()
        rows.append((len(rows), "  ".join(chain).upper()))
    return rows


@pytest.mark.parametrize(("words", "share", "seed"), [(4, 85, 1), (5, 80, 2), (4, 50, 3)])
def test_jaccard_join(spark, words, share, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (None, "one two"), (None, "lone words here"), (905, "x" * 40_000), (906, "w " * 30_000), (906, "w " * 30_000)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, key string, n int")
    found = jaccard_join.link(docs, words=words, share=share).collect()
    assert Counter(map(tuple, found)) == Counter(by_force(rows, words, share))


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.link(docs).collect() == [] and jaccard_join.one_of_each(docs).collect() == []


def test_hot_groups_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rows = near_copies(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.link(docs).collect()
    assert Counter(map(tuple, found)) == Counter(by_force(rows, 4, 85))


def test_one_of_each(spark):
    rows = near_copies(8) + [(None, "never seen words anywhere"), (950, None), (951, None), (3_000, "some twice given text"), (3_000, "some twice given text")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = jaccard_join.one_of_each(docs, words=4, share=85)
    expected = {(i, t) for (i, t), (_, _, c) in zip(rows, by_force(rows, 4, 85), strict=True) if i == c or i is None}
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(set(got)) and set(got) == expected


def test_rows_of_a_null_or_repeated_id_are_told_apart(spark):
    text = lambda letter, changed=0: " ".join([f"{letter}{i}" for i in range(80)] + ["new"] * changed)
    rows = [(1, text("a")), (None, text("a", 1)), (None, text("b")), (None, text("c")), (None, text("c", 1)), (None, text("d")), (None, text("d"))]
    rows += [(7, text("e")), (7, text("a", 2)), (8, text("e", 1)), (9, text("f")), (9, text("f", 1)), (9, text("g")), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs).collect())
    either = [got.pop(pair, 0) for pair in ((None, text("c")), (None, text("c", 1)), (9, text("f")), (9, text("f", 1)))]
    assert either[0] + either[1] == 1 and either[2] + either[3] == 1
    assert got == Counter([(1, text("a")), (None, text("b")), (None, text("d")), (7, text("e")), (9, text("g")), (None, None), (None, "")])


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, data), name)
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    expected = {r["doc_id"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} == expected
