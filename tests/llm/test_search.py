"""Ranked search against a full scan in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeworks.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """(item, rank, id, score) by scoring every document."""
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for q, text in items:
        asked = terms(text)
        hits = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            if (s := sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])) > 0:
                hits.append((-s, i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = ["Über", "naïve", "x1", "\U0001f600", "stone"] + [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " .,;\n"), (1003, text(9000)), (None, text(5)), (7, docs[7][1]), (7, docs[7][1]), (1004, "THE the The"), (1005, "İ ß\u0000É_e")]
    docs += [(2000 + i, "common stone") for i in range(90)]  # a tie that many share
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "stone stone common"), (54, text(3000)), (None, "w1"), (55, docs[3][1]), (55, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("block", "postings", "group", "sent", "piece"), [(256, 1 << 17, 512, 500_000, 1 << 24), (8, 100, 5, 0, 40)])
def test_search_against_a_full_scan(spark, tables, monkeypatch, block, postings, group, sent, piece):
    docs, items = tables
    for name, v in {"BLOCK_DOCS": block, "BLOCK_POSTINGS": postings, "ITEM_GROUP": group, "SENT_TERMS": sent, "PIECE": piece}.items():
        monkeypatch.setattr(search, name, v)
    clash = lambda df: df.withColumns({c: F.lit("x") for c in ("id", "row", "block", "n", "terms", "item", "score", "rank")})
    index = search.built(clash(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3))
    got = search.searched(index, clash(spark.createDataFrame(items, "item_id long, text string")), k=7)
    assert sorted((tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()), key=str) == brute(docs, items, 7)


def test_blocks_below_the_last_hit_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 10)
    # each topic fills its own blocks
    docs = [(100 * t + i, f"topic{t} " * 3 + "common " * (i % 5)) for t in range(20) for i in range(100)]
    index = search.built(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    scans = []
    one = search.scored
    monkeypatch.setattr(search, "scored", lambda index, pairs, *a: (scans.append(pairs.count()), one(index, pairs, *a))[1])
    items = [(1, "topic3 common"), (2, "topic17")]
    got = search.searched(index, spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted((tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()), key=str) == brute(docs, items, 5)
    assert index.maxima.select("block").distinct().count() == 200 and sum(scans) <= 30


def test_stored_index_and_empty_tables(spark, tmp_path):
    docs, items = spark.createDataFrame([("b", "stone"), ("a", "stone"), ("c", "other words here")], "doc_id string, text string"), spark.createDataFrame([("q", "stone")], "item_id string, text string")
    search.built(docs, f"file://{tmp_path}/ix")
    got = search.searched(search.opened(spark, f"file://{tmp_path}/ix"), items).collect()
    assert [(r.query_id, r["rank"], r.id) for r in got] == [("q", 1, "a"), ("q", 2, "b")]
    assert search.searched(search.built(docs.where("false")), items).count() == 0
    assert search.searched(search.built(docs), items.where("false")).count() == 0
