"""Token files against the library, read back as a whole and one document at a time."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import tokenfiles

ODD = [None, "", " ", "\n\n", "It's DON'T we'LL 123 4.5 x y\x1cz", "<|endoftext|>a<|startoftext|> b", "ΑΣ ΟΔΟΣΣ İstanbul", "é ́x    q", "漢字かな🙂🙂", "word" * 300, "a\tb\r\nc\v\fd"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.default_path())
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def brute(rows, library):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text)
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_against_the_library(spark, library):
    r = random.Random(2)
    texts = ODD + [" ".join(r.choices(["Some", "words,", "often", "used.", "über"], k=r.randint(0, 300))) for _ in range(120)]
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)] + [(None, "first")]
    df = spark.createDataFrame([(*x, 1, "f") for x in rows], "doc_id long, text string, start int, file string").repartition(6)
    manifest = tokenfiles.write_tokens(df)
    got = sorted((tuple(x) for x in tokenfiles.read_tokens(manifest).collect()), key=lambda x: x[1])
    assert got == brute(rows, library)
    for doc, text in rows[::9] + rows[-1:]:
        assert tokenfiles.fetch(manifest, doc) == [library(text)]
    assert tokenfiles.fetch(manifest, 10**9) == []
    ids = {x["doc_id"]: x["ids"] for x in tokenfiles.read_tokens(manifest, with_ids=True).collect()}
    assert all(list(ids[d]) == library(t) for d, t in rows)


def test_repeated_ids_spread_and_keep_their_places(spark, library):
    rows = [(5, f"text {i % 3}") for i in range(600)] + [(1, "a"), (9, "b")]
    manifest = tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(x) for x in tokenfiles.read_tokens(manifest).collect()), key=lambda x: x[1])
    assert sum(x.n_docs for x in manifest.collect()) == 602 and max(x.n_docs for x in manifest.collect()) < 400
    assert [x[1] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    assert sorted((x[0], x[2], x[3]) for x in got) == sorted((x[0], x[2], x[3]) for x in brute(rows, library))
    assert [x[0] for x in got] == [1] + [5] * 600 + [9] and len(tokenfiles.fetch(manifest, 5)) == 600


def test_files_close_at_their_size_and_the_dictionary_is_checked(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 300)
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(60))) for i in range(90)]
    manifest = tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert manifest.count() > 8
    got = sorted((tuple(x) for x in tokenfiles.read_tokens(manifest).collect()), key=lambda x: x[1])
    assert got == brute(rows, library)
    row = manifest.first()
    files, base = tokenfiles.folder_of(row["folder"])
    with files.open_input_file(f"{base}/{row['file']}") as f, pytest.raises(ValueError, match="dictionary"):
        tokenfiles.Reader(f, lambda name: b"another one")


def test_an_empty_table(spark):
    manifest = tokenfiles.write_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert manifest.count() == 0 and tokenfiles.read_tokens(manifest).count() == 0
    assert manifest.agg(F.sum("n_ids")).first()[0] is None


def test_pieces_against_the_library(library):
    r = random.Random(8)
    e = tokenfiles.encoder(tokenfiles.default_path())
    letters = "abcXYZÄéñÇßøŁžĲŉǰΣσςİıЖйїʼ'´.,;:!?-0²½漢ªº<|>\x01\x1c\x85́ͅ"
    texts = ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(6000)]
    texts += [" ".join(texts[k : k + 7]) for k in range(0, 3000, 7)]
    width = e.kind
    for t, got in zip(texts, map(e.encode, texts), strict=True):
        assert np.frombuffer(got, width).tolist() == library(t)[:-1], ascii(t)
