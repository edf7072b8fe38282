"""The corpus pipeline against the same decisions made by brute force, stage by stage."""

import collections
import random

import corpus_pipeline
from pyspark.sql import functions as F

from gradeworks.llm import decontamination, langid, mixing, sharding, simhash

SF = "/root/testdata/sf0.001"


def test_stages_follow_the_plan():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.trained(docs)
    left = {i for i, r in rows.items() if not model.score(r.text)[2]}
    assert len(left) >= 0.99 * len(rows)
    sets = {i: simhash.shingles(rows[i].text) for i in left}
    groups, todo = [], set(left)
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            i = edge.pop()
            group.add(i)
            near = {j for j in todo if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
            todo -= near
            edge += near
        groups.append(group)
    left = {min(g) for g in groups}
    items = [(r.item_id, decontamination.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: decontamination.normal(rows[i].text) for i in left}
    leaked = {i for i, t in texts.items() if any(x in t for _, x in items)}
    clean = {i for i in left if not decontamination.Matcher(items, decontamination.BUDGET).found(rows[i].text)}
    assert not clean & leaked and len(clean) >= len(left - leaked) - 2
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "virtual_slot", "shard"]
    got = collections.Counter(r.doc_id for r in out.collect())
    assert set(got) <= clean and max(got.values()) <= 3
    kept = docs.where(F.col("doc_id").isin(list(clean)))
    assert got == collections.Counter({r.doc_id: r["__copies"] for r in mixing.mixed(kept).collect() if r["__copies"]})
    places = {r.doc_id: (r.virtual_slot, r.shard) for r in out.collect()}
    assert len({p for p in places.values()}) >= len({v for v, _ in places.values()}) and all(0 <= s < 24 for _, s in places.values())
    again = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == collections.Counter(tuple(r) for r in out.collect())


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and sharding.SLOTS == 8192


def test_near_dedup_keeps_one_of_each_group_of_similar_texts(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(base)
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = word()
            texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, " "), (902, "a b"), (903, "A  b"), (904, "a c"), (None, " ".join(texts[0]))]
    five = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    sets = [five(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    want = {min(r[0] for r, x in zip(rows, root, strict=True) if x == g and r[0] is not None) for g in set(root)}
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept_id string"), SF)
    assert out.columns == ["doc_id", "text", "kept_id"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    narrow = sum((simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() <= 4 for a, b in zip(rows[0:160:4], rows[1:160:4], strict=True))
    assert narrow < 20


def test_near_dedup_meets_by_fingerprints_and_compares_large_buckets_slice_by_slice(spark, monkeypatch):
    from gradeworks.llm import common

    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(70):  # each a few words from one before it: most pairs are below the similarity, chains hold the group together
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(4):
            w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
        texts.append(" ".join(w))
    sets = [simhash.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    monkeypatch.setattr(common, "SMALL_BUCKET", 2)
    monkeypatch.setattr(simhash, "SLICE_ROWS", 7)
    met = []
    one = simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda told, *how: (met.append(told.count()), one(told, *how))[1])
    got = collections.defaultdict(set)
    for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.component].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i, r in enumerate(root) if r == g) for g in set(root))
    assert met[0] > 0
    # without any band, the vantage-point trees still bring copies together
    monkeypatch.setattr(simhash, "same_group", lambda members, near, verify, label, pairs, **how: common.same_group(members.where("false"), near, verify, label, pairs))
    long = " ".join(f"v{i}" for i in range(3000))
    more = f"{long} " + " ".join(f"z{i}" for i in range(8))
    rows = [(0, "a b"), (1, "A\tb"), (2, long), (3, more)]
    assert 0 < (simhash.fingerprint(long) ^ simhash.fingerprint(more)).bit_count() <= simhash.BITS
    groups = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert groups[0] == groups[1] != groups[2] == groups[3]
