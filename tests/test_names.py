"""Closest names by the join, against all pairs."""

import difflib
import random

from metaloom.operators import names


def test_equal_to_all_pairs(spark):
    r = random.Random(8)
    known = sorted({"".join(r.choices("abcdeя", k=r.randint(1, 9))) for _ in range(150)}) + ["Справочник", "Document", "aaaa" * 60]
    asked = ["".join(r.choices("abcdeяx", k=r.randint(1, 9))) for _ in range(120)] + ["справочники", "Documnt", "zzz", "", None, "aaa" * 70, "AB"]
    rows = names.closest_names(spark.createDataFrame([(x,) for x in asked + asked[:9]], "word string"), spark.createDataFrame([(x,) for x in [*known, "", None, *known[:7]]], "name string")).collect()
    low = {n.lower(): n for n in known}
    want = {w: [low[x] for x in difflib.get_close_matches((w or "").lower(), list(low), n=2, cutoff=0.7)] for w in asked}
    assert {x["word"]: x["near"] for x in rows} == want and len(rows) == len(want)
    assert sum(map(bool, want.values())) > 20
