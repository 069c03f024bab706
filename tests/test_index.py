"""The stored index of names: the scan's rows on both paths, pruned reads, and what a missing, stale or broken index does."""

import random

import pytest

from metaloom.functions.tables import shared_dir
from metaloom.operators import index

SCHEMA = "id string, name string, kind string, synonym string, full_name_ru string, full_name_eng string, extra int"


def objects(spark, n, seed=3):
    r = random.Random(seed)
    stems = ["склад", "товар", "order", "orders", "ordre", "border", "c1", "c12", "c123", "ab", "a", "rder", "цены"]
    name = lambda: "".join(w.capitalize() for w in r.choices(stems, k=r.randint(1, 2)))
    rows = [(str(k), name(), r.choice(["Catalog", "Document", None]), r.choice([" ".join(r.choices(stems, k=3)), "", None]), r.choice([None, "Справочники." + name()]), "X." + name(), k) for k in range(n)]
    rows += [(None, "Order", "Catalog", None, None, None, 0), ("e", None, None, None, None, None, 1), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def built(spark):
    rows, at = objects(spark, 300), f"{shared_dir(spark)}/index-test"
    index.build(rows, at, buckets=16)
    return rows, at


@pytest.mark.parametrize("text", ["order", "ordes", "c1", "c12 order", "order order", "A", "склады", "цена, товар", "nothinglikeit", "", "bord"])
def test_words_as_the_scan_finds_them(built, text):
    rows, at = built
    path, got = index.search(rows, at, text, ["Document"], 1000)
    scan, want = index.search(rows, at + "-none", text, ["Document"], 1000)
    assert (path, scan) == ("index", "scan")
    assert got.collect() == want.collect()


@pytest.mark.parametrize("text", ["ORD", "ники.", "x.c12", "er or", "zzz", "складтовар", "c1"])
def test_substrings_as_the_scan_finds_them(built, text):
    rows, at = built
    path, got = index.holding(rows, at, text)
    assert path == ("index" if len(text) >= 3 else "scan")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, index.holding(rows, at + "-none", text)[1].collect()))


def test_only_the_asked_buckets_are_read(spark, tmp_path):
    """All files of other buckets are spoilt, and the answers are the same."""
    rows, at = objects(spark, 300), f"file://{tmp_path}/i"
    index.build(rows, at, buckets=16)
    i = index.Index(spark, at)
    want = sorted(map(repr, i.hits("ordes").collect()))
    asked = {"words/grams": {index.bucket_of(g, 16) for g in ("^or", "es$")}, "words/postings": {r[0] for r in i.keys_of("words", ["^or", "es$"]).filter("levenshtein(key, 'ordes') <= 1 OR key LIKE 'ordes%'").select(index.bucket("key", 16)).distinct().collect()}}
    spoilt = 0
    for name, buckets in asked.items():
        for f in (tmp_path / "i").glob(f"*/{name}/bucket=*/*.parquet"):
            if int(f.parent.name.split("=")[1]) not in buckets:
                f.write_text("spoilt")
                spoilt += 1
    assert want and spoilt > 10
    assert sorted(map(repr, index.Index(spark, at).hits("ordes").collect())) == want
    with pytest.raises(Exception, match="(?s)."):
        i.table("words/postings").count() and i.table("words/postings").select("key").distinct().collect()


def test_states_and_versions(spark):
    rows, at = objects(spark, 20), f"{shared_dir(spark)}/index-states"
    assert index.state(rows, at) == "missing"
    index.build(rows, at)
    assert index.state(rows, at) == "ready"
    more = objects(spark, 21)
    assert index.state(more, at) == "stale"
    assert index.search(more, at, "order", [])[0] == "scan"
    with pytest.raises(Exception, match="nosuch"):  # a build that fails leaves the version in use
        index.build(more.withColumnRenamed("synonym", "nosuch"), at)
    assert index.state(rows, at) == "ready"
    index.ensured(more, at)
    assert index.state(more, at) == "ready" and index.state(rows, at) == "stale"


def test_empty_table(spark):
    rows, at = objects(spark, 1).limit(0), f"{shared_dir(spark)}/index-empty"
    index.build(rows, at)
    assert index.search(rows, at, "order", [])[1].count() == 0 and index.holding(rows, at, "order")[1].count() == 0


def test_other_errors_are_no_missing_index(spark, tmp_path):
    (tmp_path / "manifests").mkdir()
    (tmp_path / "manifests" / "part-0.parquet").write_text("no parquet file")
    with pytest.raises(Exception, match="(?i)parquet"):
        index.state(objects(spark, 1), f"file://{tmp_path}")


def test_trigrams_lead_to_blocks_and_not_to_each_value(spark):
    """The table of trigrams is far smaller than the postings, which repeat prefixes and digits; all are found."""
    rows = spark.range(20_000).selectExpr("'D' || id AS id", "'O' || id AS name", "'Document' AS kind", "'AUTO' || id % 7 AS synonym", "'Документы.O' || id AS full_name_ru", "'Document.O' || id AS full_name_eng")
    at = f"{shared_dir(spark)}/index-blocks"
    index.build(rows, at, buckets=4, dictionaries=("values",))
    i = index.Index(spark, at)
    posts, grams = i.table("values/postings"), i.table("values/grams")
    assert posts.count() == 80_000 and posts.select("block").distinct().count() >= 80_000 >> index.BLOCK_BITS
    assert grams.count() < posts.count()
    for text, n in (("auto3", 2857), ("ДОКУМЕНТЫ.O1999", 11), ("o1999", 11), ("t.o", 20_000), ("19999", 1), ("o3t", 0)):
        path, got = index.holding(rows, at, text)
        assert (path, got.count(), got.distinct().count()) == ("index", n, n), text


def test_one_dictionary_is_built_and_the_other_is_missing(spark):
    rows, at = objects(spark, 30), f"{shared_dir(spark)}/index-one"
    index.ensured(rows, at, dictionaries=("words",))
    assert index.state(rows, at, dictionaries=("words",)) == "ready" and index.state(rows, at, dictionaries=("values",)) == "missing"
    assert index.search(rows, at, "order", [])[0] == "index" and index.holding(rows, at, "order")[0] == "scan"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.Index(spark, at).table("values/grams").count()
    index.ensured(rows, at)
    assert index.holding(rows, at, "order")[0] == "index"


def test_trigrams_of_values(monkeypatch):
    r = random.Random(4)
    values = ["".join(r.choices("abя\0𝄞", k=r.randint(0, 6))) for _ in range(200)]
    want = {v[k : k + 3] for v in values for k in range(len(v) - 2)}
    got = index._distinct_trigrams(values)
    assert len(got) == len(set(got)) and set(got) == want
    assert [index._distinct_trigrams(x) for x in ([], [""], ["ab"], ["a", "bc", "d"], ["", "abc", ""])] == [[], [], [], [], ["abc"]]


@pytest.mark.parametrize("chars", [0, index.HELD_CHARS])
def test_trigrams_are_made_one_within_a_task_and_may_come_again(spark, monkeypatch, chars):
    """A block passes on its distinct trigrams, not a row for each trigram of each value; those of a block whose rows
    several tasks or batches read are found all the same."""
    assert "_block_trigrams" in index.build.__code__.co_names
    monkeypatch.setattr(index, "HELD_CHARS", chars)
    rows, at = objects(spark, 300), f"{shared_dir(spark)}/index-split-{chars}"
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    before = {c: spark.conf.get(c) for c in limits}
    try:
        for c, v in limits.items():
            spark.conf.set(c, v)
        index.build(rows, at, buckets=2, dictionaries=("values",))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    grams = index.Index(spark, at).table("values/grams").select("home", "block", "gram")
    assert (grams.count() > grams.distinct().count()) == (chars == 0)
    for text in ("ORD", "ники.", "x.c12", "zzz", "складтовар"):
        path, got = index.holding(rows, at, text)
        assert path == "index" and sorted(map(repr, got.collect())) == sorted(map(repr, index.holding(rows, at + "-none", text)[1].collect()))
