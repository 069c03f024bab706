"""Windows under anchors that are too common for one bucket, and where repeated windows are found."""

import dataclasses
import random

import numpy as np
import pytest

from metaloom.llm import anchors, fmindex, lpf

STOCK = "a phrase that stands in very many documents with other words around it"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(13)
    words = [f"w{k}" for k in range(60)]
    out = [" ".join([*r.choices(words, k=9), STOCK, *r.choices(words, k=9)]) for _ in range(40)]
    return out + [t[3:] + " more" for t in out[::4]] + [out[5]] * 30 + ["x" * 300, None, ""]


def table(spark, texts, copies=1):
    return spark.createDataFrame(list(enumerate(texts * copies)), "doc_id long, text string")


def found(spark, texts, kind):
    return sorted(tuple(r) for r in anchors.repeats(table(spark, texts), kind).collect())


@pytest.mark.parametrize("kind", [fmindex.KIND, lpf.KIND], ids=["op6", "op8"])
def test_hot_anchors_are_dealt_out_by_window(spark, monkeypatch, texts, kind):
    want = found(spark, texts, kind)
    assert sum(r[2] for r in want) > 0
    monkeypatch.setattr(anchors, "HOT_SEGMENTS", 3)
    monkeypatch.setattr(anchors, "LEAST_CHUNK_BYTES", 500)
    monkeypatch.setattr(anchors, "SHARD_SYMBOLS", 200)

    def single(pieces, counts, docs):
        if len(pieces) > 60:
            raise MemoryError("a stock phrase in many surroundings in one shard")
        return kind.index(pieces, counts, docs)

    assert found(spark, texts, dataclasses.replace(kind, index=single)) == want


@pytest.mark.parametrize("kind", [fmindex.KIND, lpf.KIND], ids=["op6", "op8"])
def test_all_repeats_come_from_the_index(spark, texts, kind):
    """An index that finds no holder leaves every text whole: hashes of texts or segments remove nothing."""

    def blind(pieces, counts, docs):
        return np.full(int(counts.sum()), np.iinfo(np.int64).max)

    assert all(r[2] == 0 for r in found(spark, texts, dataclasses.replace(kind, index=blind)))


@pytest.mark.parametrize("kind", [fmindex.KIND, lpf.KIND], ids=["op6", "op8"])
def test_a_chunk_sends_copies_once(spark, monkeypatch, texts, kind):
    """A text that most rows share reaches the index once."""
    sizes = spark.sparkContext.accumulator(0)

    def counted(pieces, counts, docs):
        sizes.add(len(pieces))
        return kind.index(pieces, counts, docs)

    found(spark, [texts[5]] * 50, dataclasses.replace(kind, index=counted))
    few = sizes.value
    found(spark, [texts[5]] * 500, dataclasses.replace(kind, index=counted))
    assert sizes.value == 2 * few
