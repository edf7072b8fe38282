"""Exact dedup against its rule, and the index over several batches."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gradeworks.llm import digests

ROWS = [
    (1, "the same text"), (2, "the  same\ttext "), (3, "thesametext"), (4, None), (5, ""), (6, " \n\x0b\x0c\r"), (7, "alone"), (8, "a b"), (9, "ab"), (2, "the  same\ttext "),
    (None, "null id"), (None, "null id"), (12, "null id"), (13, "null   id"), (14, "x" * 200_000), (15, "x " * 200_000), (None, "only a null id"), (16, "ü\U0001f600"),
]
CLASH = ("digest", "row", "id", "batch", "best", "n_chars", "group_size", "__row", "__stays", "kept")


def brute(rows):
    """Group sizes, keeper and digest by row, from the rule alone."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm, strict=True):
        group = [(-len(u or ""), j is None, j or 0) for (j, u), m in zip(rows, norm, strict=True) if m == n]
        least = min(group)
        out.append((i, None if least[1] else least[2], len(group), hashlib.sha256(n.encode()).hexdigest(), (-len(t or ""), i is None, i or 0) == least))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})


@pytest.mark.parametrize("arrivals", [1, 2, 5])
def test_verdicts_against_brute_force(spark, arrivals):
    rows = ROWS + [(100 + i, "very often" + " " * (i % 3)) for i in range(400)]
    got = digests.judged(table(spark, rows).repartition(3), arrivals=arrivals).select("id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("d"), "kept").collect()
    want = brute(rows)
    key = lambda r: (r[3], r[0] is None, r[0] or 0)
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted([r[:4] for r in want], key=key)
    # one row of each text stays, among those that the rule allows
    assert len({r.d for r in got}) == sum(r.kept for r in got) == len({r.d for r in got if r.kept})
    may = {(r[0], r[3]) for r in want if r[4]}
    assert all((r.id, r.d) in may for r in got if r.kept)


def test_batches_meet_the_stored_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first, second = [(1, "a b"), (2, "ab"), (3, "c")], [(4, "a  b"), (5, "d"), (6, "d"), (7, None)]
    assert sorted(r.doc_id for r in digests.deduplicated(table(spark, first), path, 0).collect()) == [1, 3]
    got = digests.deduplicated(table(spark, second), path, 1)
    assert got.columns == ["doc_id", "text", *CLASH] and sorted(r.doc_id for r in got.collect()) == [5, 7]
    # taken in once more, a batch does not meet itself, and earlier folders stay as they are
    assert sorted(r.doc_id for r in digests.deduplicated(table(spark, second), path, 1).collect()) == [5, 7]
    assert sorted(r.doc_id for r in digests.deduplicated(table(spark, second), path, 2, better=True).collect()) == [4]
    index = digests.Index(spark, path)
    entries = {(r.batch, r.id) for r in index.unshuffled().collect()}
    assert entries == {(0, 1), (0, 3), (1, 5), (1, 7), (2, 4)}
    assert {r.best.id for r in index.best().collect()} == {4, 3, 5, 7}
    # the stored side keeps its buckets: only the new batch is shuffled
    seen = index.before(2).select("digest")
    plan = seen.join(spark.table(index.table).where("batch = 2").select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.closed()


def test_empty_table_and_other_ids(spark):
    assert digests.judged(table(spark, [])).count() == 0
    got = digests.judged(spark.createDataFrame([("b", "t"), ("a", "t")], "doc_id string, text string")).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in got} == {("a", "a", 2, True), ("b", "a", 2, False)}
