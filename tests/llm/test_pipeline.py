"""The pipeline's stages against a chain of plain versions, and on odd tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as p
from metaloom.llm import base, bpe, toxicity

SF = "/root/testdata/sf0.001"


def plain_toxic(docs, spark):
    """Texts that the plain reading of the trained grammar scores 0.7 or more."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    g = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    lexicon = g.lexicon()

    def score(text):
        counts = np.zeros(16)
        for clause in re.split(r"[.!?;:,\n]", (text or "").lower()):
            words = re.findall(r"\w+(?:['’][^\W\d_]+)?", clause)
            kinds = [lexicon(w) for w in words]
            for i, k in enumerate(kinds):
                if k in (toxicity.INSULT, toxicity.THREAT):
                    target = toxicity.TARGET in kinds[max(0, i - 6) : i] or toxicity.TARGET in kinds[i + 1 : i + 4]
                    counts[8 * (k == toxicity.THREAT) + target + 2 * (toxicity.NEGATION in kinds[max(0, i - 3) : i]) + 4 * (toxicity.REPORT in kinds[:i])] += 1
        return 1 / (1 + np.exp(-(g.weights[0] + g.weights[1:] @ np.log2(1 + counts))))

    return {i: t for i, t in docs.items() if score(t) < 0.7}


def plain_lines(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(low)
    held = defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    return {i: "\n".join(x for x in (t or "").split("\n") if i >= gone.get(key(x), i)) for i, t in docs.items()}


def plain_near(docs):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in docs}
    near = [(i, j) for i in docs for j in docs if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    for _ in docs:
        before = dict(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return {i: t for i, t in docs.items() if label[i] == i}


def plain_leaks(docs, items):
    cut = lambda t: [tuple(w[k : k + 5]) for w in [re.findall(r"\w+", (t or "").lower())] if w for k in range(max(1, len(w) - 4))]
    asked = [set(cut(t)) for t in items]
    return {i: t for i, t in docs.items() if not any(a and len(a & set(cut(t))) >= 0.8 * len(a) - 1e-9 for a in asked)}


def test_stages_against_plain_versions(spark):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = [lambda d: plain_toxic(d, spark), plain_lines, plain_near, lambda d: plain_leaks(d, items)]
    want, sizes = {r["doc_id"]: r["text"] for r in table.collect()}, []
    for (name, stage), by_hand in zip(p.STAGES[:-1], plain, strict=True):
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.dtypes == table.dtypes, name
        table, want = base.saved(out, "stage"), by_hand(want)
        rows = table.collect()
        assert {r["doc_id"]: r["text"] or "" for r in rows} == {i: t or "" for i, t in want.items()}, name
        assert len(rows) == len(want)
        sizes.append((len(want), sum(len(t or "") for t in want.values())))
    assert all(a[0] > b[0] or a[1] > b[1] for a, b in zip(sizes, sizes[1:], strict=False))
    tok = Tokenizer.from_file(bpe.default_path())
    last = {r["doc_id"]: r for r in p.STAGES[-1][1](spark, table, SF).collect()}
    whole = {r["doc_id"]: r for r in p.run(spark, SF).collect()}
    assert last == whole and set(last) == set(want)
    for i, t in want.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert last[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert last[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("empty", [True, False])
def test_odd_tables(spark, tmp_path, empty):
    rows = [] if empty else [(None, None, "a", "b"), (1, "", "c", "d"), (1, "", "c", "d"), (2, "one two three four five six", None, "e"), (3, "One two  three four five six", None, "f")]
    spark.createDataFrame(rows, "doc_id long, text string, `row` string, `__bad` string").withColumn("n_chars", __import__("pyspark").sql.functions.char_length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in p.run(spark, str(tmp_path)).collect())
    assert got == ([] if empty else [(False, 0, 0), (True, 2, 6)])
