"""Columns of any name pass through the operators that return documents; odd tables have defined results."""

import base64
import hashlib
import random

import numpy as np
import pytest

from metaloom.llm import bpe, decontam, htmlcrf, linededup, simhash, toxicity, warc

CLASHING = ["doc", "row", "whole", "bitmap", "bad", "__bad", "id", "__id", "__row", "__doc", "__text", "n_lines", "n_dropped", "node", "label", "key", "chunk", "item", "hash", "found", "toxic"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["a line that is long enough to be counted as a line of its own\nx", "short", None, "", "one two three four five six", "one two three four five six"]
    rows = [(i, t, *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(texts + [texts[0]] * 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def same_but_text(before, after):
    assert after.columns == before.columns and after.dtypes == before.dtypes
    want = {r["doc_id"]: [r[c] for c in CLASHING] for r in before.collect()}
    rows = after.collect()
    assert rows and all([r[c] for c in CLASHING] == want[r["doc_id"]] for r in rows)
    return {r["doc_id"]: r["text"] for r in rows}


def test_line_dedup(clashing):
    got = same_but_text(clashing, linededup.deduplicated(clashing))
    assert got[0] == "x" and got[6] == "x" and got[11].endswith("own\nx") and got[2] == got[3] == "" and got[1] == "short"


def test_one_of_each(clashing):
    assert set(same_but_text(clashing, simhash.one_of_each(clashing))) == {0, 1, 2, 4}


def test_decontaminated(spark, clashing):
    benchmark = spark.createDataFrame([(1, "one two three four five six", "x", "y")], "item_id long, text string, bad string, doc string")
    assert set(same_but_text(clashing, decontam.decontaminated(clashing, benchmark))) == set(range(12)) - {4, 5}


def test_toxicity(spark, clashing):
    labels = spark.createDataFrame([(1, 0, "z")], "doc_id long, toxic int, label string")
    assert set(same_but_text(clashing, toxicity.kept(clashing, labels))) == set(range(12))


def test_decontamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (1, "a b c d e f")], "doc_id long, text string")
    items = [(7, "a b c d e f g h i j"), (7, "a b c d e f"), (None, "a b c d e"), (8, None), (9, ""), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 0):
        got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["containment"]) for r in decontam.contaminated(docs, bench, most_sent=most).collect()), key=str)
        assert got == sorted([(1, 7, 2, 1.0), (None, 7, 2, 1.0), (1, None, 1, 1.0), (None, None, 1, 1.0)], key=str)
        assert decontam.contaminated(docs.limit(0), bench, most_sent=most).count() == 0
        assert decontam.contaminated(docs, bench.limit(0), most_sent=most).count() == 0
    assert decontam.decontaminated(docs, bench.limit(0)).count() == 5


def test_decontamination_of_a_hash_that_all_documents_hold(spark):
    text = "the same stock phrase of words"
    docs = spark.createDataFrame([(i, f"{text} w{i}") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{text} x{i}" if i % 2 else text) for i in range(8)], "item_id long, text string")
    want = {(d, i) for d in range(60) for i in range(0, 8, 2)}
    renamed = docs.withColumnRenamed("doc_id", "doc"), items.withColumnRenamed("item_id", "item")
    got = decontam._shuffled(*renamed, 0.8, hot=7).collect()
    assert {(r["doc"], r["item"]) for r in got} == want


def test_warc_of_odd_rows(spark):
    rows = [(None, None, "<p>x</p>"), (5, "u", "<p>x</p>"), (5, "u", "<p>x</p>"), (3, None, None), (4, "", ""), (None, "w", "y")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    got = sorted([tuple(r) for r in warc.archived(pages).collect()], key=str)
    x, e, y = b"<p>x</p>", b"", b"y"
    want = [(None, 8, digest(x), "revisit", 5), (5, 8, digest(x), "response", None), (5, 8, digest(x), "response", None), (3, 0, digest(e), "revisit", 4), (4, 0, digest(e), "response", None), (None, 1, digest(y), "response", None)]
    assert got == sorted(want, key=str)


def test_warc_spreads_a_payload_that_a_third_of_all_pages_share(spark):
    pages = spark.range(3000).selectExpr("id page_id", "'u' url", "if(id % 3 = 0, 'an error page', 'page ' || id) html").repartition(4)
    index = warc.write_archives(pages)
    shared = index.filter("page % 3 = 0").groupBy("bundle").count().collect()
    assert len(shared) == 4 and max(r["count"] for r in shared) < 500
    back = warc.read_archives(spark, index)
    assert back.rdd.getNumPartitions() == 4
    assert back.filter("record_type = 'revisit' and refers_to = 2997").count() == 999


def test_html_of_an_empty_table(spark):
    assert htmlcrf.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("spread", [bpe.SPREAD, 700])
def test_bpe_of_long_texts(spark, spread):
    import random

    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(bpe.default_path()), random.Random(17)
    texts = ["".join(r.choices("abcdeth", k=20_000)), "=" * 5_000, "é" * 3_000 + " ordinary words " + "-" * 700, None, ""]
    texts += [texts[0], texts[0][:9_999] + " " + texts[1] + "<|endoftext|>" + texts[2]]
    got = {x["doc_id"]: x for x in bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True, spread=spread).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_of_the_given_texts_comes_from_joins(spark):
    from tokenizers import Tokenizer

    tok, c = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        text = r["text"] or ""
        ids = c.encode(text)
        assert ids == tok.encode(text, add_special_tokens=False).ids and c.decode(ids) == text
    long = [w for w in c.known if len(w.encode()) > bpe.LEAF]
    assert c.joined >= len(long) > 0.2 * len(c.known)


def test_bpe_packs_words_and_cuts_ascii_as_the_pattern_says():
    r, c = random.Random(23), bpe.Codec(bpe.default_path())
    for _ in range(3000):
        text = "".join(r.choices("ab Z9'sdtrevml\t\n\r\x0b\x0c\x1c\x1f\x00\x7f\xa0é.,-  \n", k=r.randint(0, 25)))
        assert c.words(text) == c.find(text)
        ids = np.frombuffer(c.packed(text), "<u4")
        assert c.decode(ids) == text and c.encode(text) == ids.tolist()


def test_bpe_keeps_half_of_what_it_remembers_when_that_is_full(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    c = bpe.Codec(bpe.default_path())
    for k in range(60):
        c.encode(" ".join(f"w{k}x{j}" for j in range(7)))
        assert 0 < len(c.known) <= 100 + 28
    assert len(c.known) > 50
