"""Fill-in-middle against plain slices of strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from metaloom.llm import fim

TEXTS = [None, "", "a", "é", "𝄞𝄞", "a<S>b", "<P", "plain words, ünd mörê 漢字 𝄞!", " lead\ning  space\n\nends\n", "<S<P>", "x\n" * 50, "漢" * 500]


def units(text, unit):
    if unit == "chars":
        return list(text)
    out = []
    for k, c in enumerate(text):
        begins = text[k - 1] == "\n" if unit == "lines" else c not in " \t\n\v\f\r" and text[k - 1] in " \t\n\v\f\r" and text[:k].strip(" \t\n\v\f\r")
        if not out or begins:
            out.append(c)
        else:
            out[-1] += c
    return out


def brute(doc, text, unit="chars"):
    text = text or ""
    x = hashlib.sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = units(text, unit)
    n = len(u)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_against_slices(spark, unit):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choices("ab é漢𝄞\n\t<>PSM", k=r.randint(0, 90))) for _ in range(150)]
    rows = [(i, t, "en", 5) for i, t in enumerate(texts)] + [(None, TEXTS[7], "en", 5), (3, TEXTS[8], "en", 5), (3, TEXTS[8], "en", 5)]
    got = fim.transformed(spark.createDataFrame(rows, "doc_id long, text string, form string, h1 int"), unit=unit).withColumn("back", fim.restored()).collect()
    want = [(i, *brute(i, t, unit), t or "") for i, t, *_ in rows]
    assert sorted((tuple(x) for x in got), key=str) == sorted(want, key=str)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_selection_by_halving():
    r = random.Random(1)
    for _ in range(200):
        size = r.randint(1, 300)
        bits = r.getrandbits(size)
        places = [i for i in range(size) if bits >> i & 1]
        assert [fim.selected(bits, size, k) for k in range(len(places) + 1)] == [*places, size]


def test_a_very_long_text_and_an_empty_table(spark):
    text = "漢字 and ascii " * 700_000
    got = fim.transformed(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n", F.sha2(fim.restored().cast("binary"), 256)).first()
    assert tuple(got) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert fim.transformed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
