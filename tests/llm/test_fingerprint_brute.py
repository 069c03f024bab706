"""Context-triggered piecewise hashing against a byte-at-a-time version."""

import random

import pytest

from metaloom.llm import fingerprint as f

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def rolling(data, i):
    h = sum(data[i - k] * pow(0x85EBCA6B, k, 1 << 32) for k in range(7) if i - k >= 0) & M32
    h = (h ^ h >> 15) * 0x2C1B3C6D & M32
    return h ^ h >> 13


def letter(chunk):
    x = sum((b + 1) * pow(0x100000001B3, k, 1 << 64) for k, b in enumerate(chunk)) & M64
    x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & M64
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & M64
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(x ^ x >> 32) >> 58]


def chunks(data, block, most):
    ends = [i + 1 for i in range(len(data)) if rolling(data, i) % block == block - 1]
    ends = ends if ends and ends[-1] == len(data) else [*ends, len(data)]
    if len(ends) > most:
        ends = [*ends[: most - 1], len(data)]
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def brute(text):
    data = text.encode()
    if not data:
        return "3::"
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len([i for i in range(len(data)) if rolling(data, i) % block == block - 1]) < 32:
        block //= 2
    return f"{block}:{''.join(map(letter, chunks(data, block, 64)))}:{''.join(map(letter, chunks(data, 2 * block, 32)))}"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def like(a, b):
    if a == b:
        return 1.0
    (n, *x), (m, *y) = a.split(":"), b.split(":")
    sizes = {int(n): x[0], 2 * int(n): x[1]}, {int(m): y[0], 2 * int(m): y[1]}
    best = 0.0
    for size in set(sizes[0]) & set(sizes[1]):
        p, q = ("".join(c for i, c in enumerate(s) if i < 3 or s[i - 3 : i] != c * 3) for s in (sizes[0][size], sizes[1][size]))
        k = min(4, len(p), len(q))
        if k and any(p[i : i + k] in q for i in range(len(p) - k + 1)):
            best = max(best, 1 - edits(p, q) / (len(p) + len(q)))
    return best


def test_against_brute_force(spark):
    r = random.Random(31)
    texts = ["", "a", "abc" * 40, *("".join(r.choices("abcdefghij é\n", k=r.randint(1, 1500))) for _ in range(40))]
    texts += [texts[-1][:700] + "x" + texts[-1][700:], texts[5], texts[5]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in f.fingerprinted(table).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["fingerprint"] == brute(t)
        assert got[i]["edited_fingerprint"] == brute(edited)
        assert got[i]["near_edited"] == pytest.approx(like(brute(t), brute(edited)))
        assert got[i]["near_next"] == pytest.approx(like(brute(t), brute(after)))
    assert sum(got[i]["near_edited"] > 0.4 for i in got) > 20


def test_slices_of_a_long_text(monkeypatch):
    text = "".join(random.Random(5).choices("abcdefgh ", k=9000))
    want = f.fingerprint(text)
    f._powers.cache_clear()
    monkeypatch.setattr(f, "SLICE", 1000)
    assert f.fingerprint(text) == want
    f._powers.cache_clear()
