"""The toxicity grammar against a plain reading of clauses."""

import math
import random
import re

import numpy as np
import pytest

from metaloom.llm import toxicity as t

CLASSES = {w: c for c, words in t.SEEDS.items() for w in words.split()}


def plain_patterns(text):
    """Each insult and threat with what stands around it in its clause, by looking at the words themselves."""
    out = np.zeros(16)
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        words = re.findall(r"\w+(?:['’][^\W\d_]+)?", clause)
        kinds = [CLASSES.get(w, t.OTHER) for w in words]
        for i, k in enumerate(kinds):
            if k in (t.INSULT, t.THREAT):
                target = t.TARGET in kinds[max(0, i - 6) : i] or t.TARGET in kinds[i + 1 : i + 4]
                negated = t.NEGATION in kinds[max(0, i - 3) : i]
                reported = t.REPORT in kinds[:i]
                out[8 * (k == t.THREAT) + target + 2 * negated + 4 * reported] += 1
    return np.log2(1 + out)


def test_patterns_against_a_plain_reading():
    r = random.Random(21)
    words = ["idiot", "trash", "kill", "matar", "you", "they", "not", "never", "said", "according", *["a", "house", "on", "x1"] * 3]
    lexicon, grammar = t.Grammar().lexicon(), t.Grammar()
    for _ in range(500):
        text = " ".join(w + r.choice(["", "", "", "", ",", ".", "!"]) for w in r.choices(words, k=r.randint(0, 25)))
        want = plain_patterns(text)
        assert t.patterns(text, lexicon).tolist() == want.tolist()
        z = grammar.weights[0] + grammar.weights[1:] @ want
        assert t.score(text, grammar, lexicon) == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("learned", [False, True])
def test_clauses_decide_and_not_words(learned):
    if learned:  # labels under which each lone insult is toxic
        texts = [f"word{k} trash and so on" if k % 3 == 0 else f"word{k} and so on" for k in range(300)]
        grammar = t.fitted(texts, np.array([float(k % 3 == 0) for k in range(300)]))
    else:
        grammar = t.Grammar()
    score = lambda x: t.score(x, grammar, grammar.lexicon())
    for text in ("trash", "the trash can", "to kill time", "", "nice", "you are not an idiot", "he wrote that you are trash", "he said they would kill you", "never trash"):
        assert score(text) < 0.7, text
    for text in ("you are an idiot", "you stupid thing", "i will kill you", "they are scum. he said so", "Idiot. Moron, trash! What a loser."):
        assert score(text) >= 0.7, text
    assert score("you are an idiot") > score("an idiot") > score("not an idiot")


def test_null_and_empty_and_blank_texts_score_the_same():
    g = t.Grammar()
    assert {t.score(x, g, g.lexicon()) for x in (None, "", " \n", "...")} == {t.score("", g, g.lexicon())}


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert t.scored(d, t.train(d, labels)).count() == 0
    assert t.kept(d, labels).count() == 0


def test_a_text_over_the_bound_leaves_room_for_others(spark):
    rows = [(k, "word " * (5000 if k % 7 == 0 else 1) + ("you idiot" if k % 2 else "fine")) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    g = t.train(d, labels, t.TrainingBound(rows=1000, bytes=2000))
    assert not np.array_equal(g.weights, t.Grammar().weights)
