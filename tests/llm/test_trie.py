"""The prefix trie of conversations against plain tries of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from metaloom.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, `print` string"


def brute(rows, run=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % most
        built[c] = turns if c is None else own.get(c - c % run, [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    least = lambda cs: min(cs, key=lambda c: (c is not None, c or 0))
    out, leaves, saves = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        saves[node] = (len(members[node]) - 1) * words + sum(saves[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        ends = sorted((c for c in members[node] if len(built[c]) == len(node)), key=lambda c: (c is not None, c or 0))
        digest = hashlib.sha256(",".join("null" if c is None else str(c) for c in ends).encode()).hexdigest()
        out.append((least(members[node]), len(node), least(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saves[node], digest))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(11), []
    for c in [*range(60), *range(100, 125), 163, 164, 400]:
        if c % 7 == 3:
            turns = [("user", "hello there"), ("assistant", f"reply {c % 3}")]
        else:
            turns = [(r.choice(("user", "assistant")), " ".join(r.choices(("a", "b"), k=r.randint(0, 2)))) for _ in range(r.randint(1, 6))]
        out += [(c, i if i else None, *t) for i, t in enumerate(turns)]
    return out + [(5, 2, None, None), (6, 0, "user", ""), (6, 0, "user", ""), (6, 0, "b", "y"), (6, 0, "b", "x"), (None, 1, "user", "hello there"), (None, None, "x", "é  y")]


def test_against_brute_force(spark, rows):
    assert got(trie.prefix_trie(conversations(spark, rows).repartition(5))) == brute(rows)


@pytest.mark.parametrize("bits", [2, 4])
def test_collisions_are_split(spark, rows, bits):
    assert got(trie.prefix_trie(conversations(spark, rows), bits=bits)) == brute(rows)


def test_a_conversation_longer_than_a_range(spark):
    rows = [(c, i, "user", f"w{i % 5} {i}") for c in (20, 21) for i in range(900)] + [(22, i, "user", "x") for i in range(40)]
    own = trie.scanned(spark.createDataFrame(rows, "conv long, turn int, role string, text string").withColumn("token", trie.F.xxhash64("text")), "conv", [trie.F.col("turn")], ["turn"], token="token")
    assert own.count() == 1840 and all(r["pos"] == r["turn"] for r in own.collect())
    assert got(trie.prefix_trie(conversations(spark, rows))) == brute(rows)


def test_copies_of_one_conversation_and_of_one_row(spark):
    rows = [(c, i, "user", f"turn {i}") for c in range(0, 9000, 3) for i in range(2)] + [(7, 0, "user", "same")] * 500
    assert got(trie.prefix_trie(conversations(spark, rows))) == brute(rows)


def test_odd_tables(spark):
    assert trie.prefix_trie(conversations(spark, []).limit(0)).count() == 0
    one = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # loses its only turn, and its run has no first
    assert got(trie.prefix_trie(conversations(spark, [(one, None, None, None)]))) == brute([(one, None, None, None)])
    assert brute([(one, None, None, None)])[0][:6] == (one, 0, None, 1, 0, 1)
