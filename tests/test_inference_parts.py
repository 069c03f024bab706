"""The fix-point by parts: few rounds, and the same facts however nodes are dealt out."""

import random

from metaloom.operators import inference
from tests.test_inference import EDGES, SEEDS, as_dict, brute, random_rows


def rounds(monkeypatch):
    seen, write = [], inference.materialized

    def watched(df, name):
        seen.append(name)
        return write(df, name)

    monkeypatch.setattr(inference, "materialized", watched)
    return seen


def test_a_long_path_in_one_part_takes_no_round_for_each_step(spark, monkeypatch):
    path = [("m", f"n{k}", f"n{k + 1}", 1) for k in range(60)]
    seen = rounds(monkeypatch)
    got = as_dict(inference.inferred_types(spark.createDataFrame([("m", "n0", "K", 95)], SEEDS), spark.createDataFrame(path, EDGES)))
    assert got == {f"n{k}": ("K", 95 - k) for k in range(61)}
    assert len(seen) < 10


def test_parts_of_any_number_give_the_same_facts(spark, monkeypatch):
    seen = rounds(monkeypatch)
    for seed, most in ((4, 3), (5, 7), (6, 1)):
        monkeypatch.setattr(inference, "PART", most)
        seeds, edges = random_rows(random.Random(seed))
        s, e = spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(edges, EDGES)
        facts = inference.inferred_types(s, e)
        assert as_dict(facts) == brute(seeds, edges)
        gone = {"m1", "m3"}
        left_s, left_e = [x for x in seeds if x[0] not in gone], [x for x in edges if x[0] not in gone]
        again = inference.maintained(facts, s, e, spark.createDataFrame([(x,) for x in gone], "owner string"), spark.createDataFrame([], SEEDS), spark.createDataFrame([], EDGES))[0]
        assert as_dict(again) == brute(left_s, left_e)
    assert seen.count("round") > 9
