"""The near-duplicate stage of the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import jaccard, simhash

SCHEMA = "doc_id long, text string"


def brute_smallest(ids, texts):
    """The ids that stay: the smallest of each component of Jaccard >= 0.8 over five-word shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0] for a in sets]
    label, was = list(range(len(ids))), None
    while label != was:
        was = label
        label = [min(was[j] for j in x) for x in near]
    return {ids[k] for k, x in enumerate(label) if x == k}


@pytest.mark.parametrize("hot, block, sample", [(64, 2048, 16), (2, 3, 1)])
def test_near_copies_go_whatever_their_bits(spark, monkeypatch, hot, block, sample):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard.links, "__defaults__", (block,))
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    stock = " ".join(r.choices(vocabulary, k=12))
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(12):
        words = r.choices(vocabulary, k=r.randint(60, 160))
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6):
            w = list(words)
            for _ in range(edits):
                w[r.randrange(len(w))] = "new" + r.choice(vocabulary)
            texts.append(" ".join(w) if edits % 2 else stock + " " + " ".join(w))
    ids = list(range(len(texts)))
    want = brute_smallest(ids, texts)
    got = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)).collect()}
    assert got == want
    by_bits = {x["doc_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)).collect() if x["doc_id"] == x["component_id"]}
    assert by_bits - want  # near copies that three bits of the three-word fingerprint leave


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles(spark):
    r = random.Random(5)
    rows = []
    for _ in range(60):
        a = np.unique(np.array([r.getrandbits(64) for _ in range(r.choice([1, 30, 127, 129, 300, 1030]))], np.uint64))
        b = np.unique(np.append(a[r.randrange(1 + len(a) // 5) :], np.array([r.getrandbits(64) for _ in range(r.randrange(1 + len(a) // 5))], np.uint64)))
        rows.append((jaccard._bits(a).tolist(), jaccard._bits(b).tolist(), len(np.setxor1d(a, b)), len(a) + len(b)))
    schema = "bu array<long>, bv array<long>, apart int, both int"
    got = spark.createDataFrame(rows, schema).withColumn("d", jaccard._differing("bu", "bv")).collect()
    assert all(x["d"] <= x["apart"] and (x["d"] - x["apart"]) % 2 == 0 for x in got)
    assert any(len(x["bu"]) != len(x["bv"]) for x in got)
    few = spark.createDataFrame(rows, schema).select(F.col("bu").alias("bits")).select(*jaccard._few(), "bits").collect()
    for x in few:
        whole = np.array(x["bits"], np.int64).reshape(-1, jaccard.FEW)
        assert [x[c] for c in jaccard.FOLDED] == np.bitwise_xor.reduce(whole, axis=0).tolist()


def test_a_dense_group_of_near_copies_and_one_row_many_times(spark):
    r = random.Random(3)
    base = [f"b{k}" for k in range(70)]
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1])):
            w[r.randrange(70)] = f"n{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:40]) + f" x{k} " + " ".join(f"y{k}{j}" for j in range(40)) for k in range(40)]
    ids = list(range(len(texts)))
    want = brute_smallest(ids, texts)
    ids, texts = ids + [len(texts)] * 30, texts + ["one row that is here many times over and over"] * 30
    got = [x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)).collect()]
    assert sorted(got) == sorted(want | {ids[-1]})


@pytest.mark.parametrize("block", [2048, 7])
def test_a_hot_shingle_of_sets_that_are_possible_but_not_alike(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard.links, "__defaults__", (block,))
    r = random.Random(9)
    base = [f"b{k}" for k in range(300)]
    texts = []
    for k in range(60):  # a long common run, and enough of its own that pairs stay below 0.8, some barely
        own = r.choice([34, 36, 40, 120])
        texts.append(" ".join(base[: 300 - own] + [f"o{k}x{j}" for j in range(own)]))
    for k in range(0, 60, 9):  # and some that are alike, each to one of them
        texts.append(texts[k] + f" tail{k} of{k} it{k}")
    wanted, seen = brute_smallest(list(range(len(texts))), texts), []
    blocked = jaccard._blocked

    def watched(several, block, kind, *more):
        out = blocked(several, block, kind, *more)
        seen.append((kind.__name__, {x["every"] for x in several.select("every").distinct().collect()}, out.count()))
        return out

    monkeypatch.setattr(jaccard, "_blocked", watched)
    got = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == wanted and 1 < len(wanted) < len(texts)
    assert seen[0][0] == "_Folded" and any(kind == "_Wide" for kind, *_ in seen)
    assert all(n < 60 * 59 / 4 for _, _, n in seen)  # hardly more than what is alike or nearly so is ever a row


def test_wide_bitmaps_of_neighbouring_sizes():
    import pandas as pd

    r = random.Random(6)
    sets = [np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64)) for n in (90, 100, 120, 128, 129, 140, 250, 1000)]
    sets.append(np.append(sets[4][5:], sets[0][:2]))
    wide = jaccard._Wide(pd.DataFrame({"wide": [jaccard._bits(x) for x in sets]}))
    for i, a in enumerate(sets):
        got = wide.differing(i, np.arange(len(sets)))
        for j, b in enumerate(sets):
            assert got[j] == 1 << 40 or got[j] <= len(np.setxor1d(a, b))
            assert got[j] < 1 << 40 or max(len(a), len(b)) > 1.25 * min(len(a), len(b))


def test_near_fingerprints_are_united_before_the_filter(spark, monkeypatch):
    r = random.Random(2)
    texts = []
    for _ in range(5):  # long texts with an edit or none at their end: few bits of the fingerprint change
        words = [f"w{r.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words, "end"]), " ".join([*words, "other", "end"])]
    found, alike, linked = [], [], simhash.links
    confirmed = jaccard._alike

    def watched(fps, *more):
        out = linked(fps, *more)
        found.append(out.count())
        return out

    def decided(*a):
        out = confirmed(*a)
        alike.append((a[2].count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "links", watched)
    monkeypatch.setattr(jaccard, "_alike", decided)
    got = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == brute_smallest(list(range(len(texts))), texts) == {0, 3, 6, 9, 12}
    assert found[0] + alike[0][0] > 0 and alike[0][1] > 0
    assert alike[1][0] < 10  # the filter meets only what is not united yet


def test_fingerprints_of_sets():
    r = random.Random(4)
    s = np.unique(np.array([r.getrandbits(64) for _ in range(101)], np.uint64))
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s) > len(s))
    assert jaccard._fingerprint(s) % (1 << 64) == want
    assert jaccard._fingerprint(np.zeros(0, np.uint64)) == 0
