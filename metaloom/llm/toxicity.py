"""Toxicity by a weighted finite-state pattern grammar.

A cascade of transducers reads a clause word by word.  The first is a trie over letters that turns words into classes:
insult, threat, target, negation, reported speech, other; it takes whole words and learned stems.  The next three are
letter-to-letter machines over classes that mark an insult or threat as targeted, as negated, and as reported.  They are
composed into one machine whose states are the reachable tuples; a second machine reads the clause from its end, for
targets that follow ("kill you").  A match's class and marks name one of 16 patterns;
a text's score is a logistic function of the weighted counts of its matched patterns, so it is clauses that score.

The stems and weights are learned from labelled rows: a prefix becomes a stem if toxic texts hold it far more often than
chance allows, after a correction for the number of prefixes tried; weights are the most probable ones given the
labels and prior weights, so a pattern that no labelled text shows keeps its prior.  Whatever the labels say, the
composition holds: one unmarked insult or threat in a text is no toxic text, nor is a negated or reported one; one that
is aimed at a target is.  It takes several unmarked clauses to be toxic.  Training takes at most
``TrainingBound.rows`` labelled rows and ``TrainingBound.bytes`` bytes of text, chosen by a hash of the id.

Results for odd input.  A null, empty or wordless text has no match and so the lowest score.  Rows are scored each by
its text alone; repeated rows get equal scores.  A null doc_id stays null and is not held out.  Labels that are null,
or whose id no document has, are not learned from; without labels the prior weights and the seed words score.  Other
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import mixed, rows_of, small_batches

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
TARGETED, NEGATED, REPORTED = 1, 2, 4
#: Seed words by class, in English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot moron stupid loser scum trash pathetic worthless disgusting dummkopf trottel abschaum imbécile crétin ordure estúpido imbécil escoria",
    THREAT: "kill murder strangle stab töten umbringen tuer étrangler matar asesinar",
    TARGET: "you your yours yourself u ur he she they them these those dich dir euch ihr toi vous votre usted ustedes vosotros",
    NEGATION: "not never no nobody isn't aren't wasn't don't nicht kein keine niemals pas jamais aucun nunca jamás ningún",
    REPORT: "said says wrote quoted called claimed according sagte schrieb nannte behauptete dit écrit prétend selon dijo escribió llamó según",
}
#: Words that a negation and a target reach ahead, and that a target reaches back.
NEGATION_REACH, TARGET_REACH, BACK_REACH = 3, 6, 3
#: Prior weights: of a clean text, of an insult, of a threat, and of the marks.
PRIOR = {"base": -4.0, "insult": 3.3, "threat": 3.3, TARGETED: 1.8, NEGATED: -1.5, REPORTED: -1.5}
PRIOR_SD = 3.0
#: The threshold of a toxic text as a logit, and how far from it a text with a single match stays.
TOXIC, MARGIN = math.log(0.7 / 0.3), 0.2
LEAST_STEM, MOST_STEM, PRECISION, CHANCE = 3, 10, 0.9, 0.01

_WORD = regex.compile(r"[\p{L}\p{N}_]+(?:['’][\p{L}]+)?")
_CLAUSE = regex.compile(r"[^.!?;:,\n]+")


@dataclass(frozen=True)
class TrainingBound:
    rows: int = 10_000
    bytes: int = 24 << 20


class Lexicon:
    """The first transducer: a trie over letters; a word's class is that of the word, or of its longest stem."""

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.arcs: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        for table, out in ((words, self.whole), (stems, self.stem)):
            for w, c in sorted(table.items()):
                out[self._state(w)] = c
        self.known: dict[str, int] = {}

    def _state(self, word: str) -> int:
        at = 0
        for c in word:
            if c not in self.arcs[at]:
                self.arcs[at][c] = len(self.arcs)
                self.arcs.append({})
            at = self.arcs[at][c]
        return at

    def __call__(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            got, at = OTHER, 0
            for c in word:
                if (at := self.arcs[at].get(c, -1)) < 0:
                    break
                got = self.stem.get(at, got)
            if at > 0:
                got = self.whole.get(at, got)
            if len(self.known) > 1 << 18:
                self.known.clear()
            self.known[word] = got
        return got


def _reach(opens: int, words: int, mark: int):
    """A machine that marks insults and threats within some words of a class."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        return (words if symbol == opens else max(0, state - 1)), mark if state and symbol in (INSULT, THREAT) else 0

    return step


def _until_end(opens: int, mark: int):
    def step(state: int, symbol: int) -> tuple[int, int]:
        return (1 if symbol == opens else state), mark if state and symbol in (INSULT, THREAT) else 0

    return step


def composed(*machines) -> tuple[list[list[int]], list[list[int]]]:
    """One machine that does what all do: next states and marks by (state, symbol)."""
    states, goes, marks = {(0,) * len(machines): 0}, [], []
    todo = list(states)
    for state in todo:
        to, out = [], []
        for symbol in range(6):
            steps = [m(s, symbol) for m, s in zip(machines, state, strict=True)]
            then = tuple(s for s, _ in steps)
            if then not in states:
                states[then] = len(states)
                todo.append(then)
            to.append(states[then])
            out.append(sum(x for _, x in steps))
        goes.append(to)
        marks.append(out)
    return goes, marks


GOES, MARKS = composed(_reach(TARGET, TARGET_REACH, TARGETED), _reach(NEGATION, NEGATION_REACH, NEGATED), _until_end(REPORT, REPORTED))
BACK_GOES, BACK_MARKS = composed(_reach(TARGET, BACK_REACH, TARGETED))
N_PATTERNS = 16


def marked(symbols: list[int]) -> list[tuple[int, int]]:
    """The insults and threats of a clause, each with its marks."""
    back, state = [], 0
    for s in reversed(symbols):
        back.append(BACK_MARKS[state][s])
        state = BACK_GOES[state][s]
    out, state = [], 0
    for s, after in zip(symbols, reversed(back), strict=True):
        if s in (INSULT, THREAT):
            out.append((s, MARKS[state][s] | after))
        state = GOES[state][s]
    return out


def prior_weights() -> np.ndarray:
    w = [PRIOR["base"]]
    for k in range(N_PATTERNS):
        w.append(PRIOR["insult" if k < 8 else "threat"] + sum(PRIOR[m] for m in (TARGETED, NEGATED, REPORTED) if k % 8 & m))
    return np.array(w)


@dataclass
class Grammar:
    stems: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=prior_weights)

    def lexicon(self) -> Lexicon:
        return Lexicon({w: c for c, words in SEEDS.items() for w in words.split()}, self.stems)


def patterns(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """How often each pattern matches; log-scaled, so that a long text is not toxic by its length."""
    out = np.zeros(N_PATTERNS)
    low = (text or "").lower()
    if not any(lexicon(w) in (INSULT, THREAT) for w in set(_WORD.findall(low))):
        return out
    for clause in _CLAUSE.finditer(low):
        symbols = [lexicon(w) for w in _WORD.findall(clause[0])]
        if INSULT in symbols or THREAT in symbols:
            for s, marks in marked(symbols):
                out[8 * (s == THREAT) + marks] += 1
    return np.log2(1 + out)


def score(text: str | None, grammar: Grammar, lexicon: Lexicon) -> float:
    z = float(grammar.weights[0] + grammar.weights[1:] @ patterns(text, lexicon))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def copy_groups(words: np.ndarray, texts: np.ndarray, n_texts: int, n_words: int) -> np.ndarray:
    """A group for each text, the same for copies and mostly for near copies: the three least hashes of its rarer words.

    words and texts are the pairs of distinct words and texts; a text with fewer such words is a group of its own.
    """
    rare = np.bincount(words, minlength=n_words)[words] <= max(2, n_texts // 30)
    hashed, texts = mixed(words[rare].astype(np.uint64) + np.uint64(1)), texts[rare]
    order = np.lexsort((hashed, texts))
    hashed, texts = hashed[order], texts[order]
    start = np.searchsorted(texts, np.arange(n_texts))
    enough = np.flatnonzero(np.diff(np.append(start, len(texts))) >= 3)
    key = np.arange(n_texts, dtype=np.uint64)
    key[enough] = mixed(hashed[start[enough]] ^ mixed(hashed[start[enough] + 1] ^ mixed(hashed[start[enough] + 2])))
    return np.unique(key, return_inverse=True)[1]


def learned_stems(texts: list[str], toxic: np.ndarray) -> dict[str, int]:
    """Prefixes that mark toxic texts, each as long as it can be without losing a twentieth of its texts.

    A prefix counts once for each group of copies, as copies share all their words; and once for each of several
    words of a text, which are no independent signs.
    """
    ids: dict[str, int] = {}
    held = [np.fromiter({ids.setdefault(w, len(ids)) for w in _WORD.findall((t or "").lower())}, np.int64) for t in texts]
    if not ids:
        return {}
    words = np.concatenate(held)
    owner = np.repeat(np.arange(len(texts)), [len(h) for h in held])
    group = copy_groups(words, owner, len(texts), len(ids))
    n_groups = int(group.max()) + 1
    is_toxic = np.zeros(n_groups, bool)
    np.logical_or.at(is_toxic, group, toxic > 0)
    owner = group[owner]
    spelled = list(ids)
    count: list[dict[str, tuple[int, int]]] = []
    tried = 0
    for k in range(LEAST_STEM, MOST_STEM + 1):
        prefixes: dict[str, int] = {}
        prefix_of = np.fromiter((prefixes.setdefault(w[:k], len(prefixes)) if len(w) >= k else -1 for w in spelled), np.int64, len(spelled))[words]
        some = prefix_of >= 0
        pairs = np.unique(prefix_of[some] * n_groups + owner[some])
        pos = np.bincount(pairs[is_toxic[pairs % n_groups]] // n_groups, minlength=len(prefixes))
        neg = np.bincount(pairs[~is_toxic[pairs % n_groups]] // n_groups, minlength=len(prefixes))
        tried += len(prefixes)
        count.append({x: (int(pos[i]), int(neg[i])) for x, i in prefixes.items() if pos[i] >= max(2, PRECISION * (pos[i] + neg[i]))})
    p = min(max(float(is_toxic.mean()), 1e-6), 1 - 1e-6)
    limit = math.log(CHANCE / max(1, tried))

    def marks(pos: int, neg: int) -> bool:
        """Whether so many toxic among all have a chance below the limit."""
        n = pos + neg
        return math.lgamma(n + 1) - math.lgamma(pos + 1) - math.lgamma(neg + 1) + pos * math.log(p) + neg * math.log(1 - p) < limit

    good = {x: c for level in count for x, c in level.items() if marks(*c)}
    stems = {}
    for x in sorted(good, key=lambda x: (len(x), x)):
        if any(x[:k] in good for k in range(LEAST_STEM, len(x))):
            continue
        while len(x) < MOST_STEM:
            longer = [(c[0], y) for y, c in count[len(x) + 1 - LEAST_STEM].items() if c[0] >= 0.95 * good[x][0] and y.startswith(x)]
            if not longer:
                break
            y = max(longer)[1]
            good[y] = count[len(y) - LEAST_STEM][y]
            x = y
        stems[x] = INSULT
    return stems


def fitted(texts: list[str], toxic: np.ndarray) -> Grammar:
    """The grammar learned from labelled texts."""
    grammar = Grammar(stems=learned_stems(texts, toxic))
    lexicon, prior = grammar.lexicon(), prior_weights()
    x = np.array([[1.0, *patterns(t, lexicon)] for t in texts]).reshape(len(texts), N_PATTERNS + 1)
    w = prior.copy()
    for _ in range(50):  # Newton steps on the logarithm of the posterior
        mean = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - mean) - (w - prior) / PRIOR_SD**2
        curve = (x.T * (mean * (1 - mean))) @ x + np.eye(len(w)) / PRIOR_SD**2
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    grammar.weights = shaped(w)
    return grammar


def shaped(w: np.ndarray) -> np.ndarray:
    """The nearest weights with which a single match is toxic exactly if it is targeted and neither negated nor reported."""
    out = w.copy()
    out[0] = min(out[0], -MARGIN)  # no match, no toxic text
    for k in range(N_PATTERNS):
        edge = TOXIC - out[0]
        aimed = k % 8 == TARGETED
        out[1 + k] = max(out[1 + k], edge + MARGIN) if aimed else min(out[1 + k], edge - MARGIN)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: TrainingBound = TrainingBound()) -> Grammar:
    """Learns from labelled rows that are not held out: the first by a hash of the id, up to the bound."""
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size")).join(marked, "doc_id")
    taken, total = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "size").limit(bound.rows).collect():
        if total + (r["size"] or 0) > bound.bytes:
            continue  # a text that does not fit leaves room for others
        total += r["size"] or 0
        taken.append((r["doc_id"], r["toxic"]))
    if not taken:
        return Grammar()
    few = docs.sparkSession.createDataFrame(pd.DataFrame(sorted(set(taken)), columns=["doc_id", "toxic"]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")
    small_batches(docs.sparkSession)

    def run(batches):
        own = sorted(((r.doc_id, r.text or "", r.toxic) for r in rows_of(batches)), key=lambda r: r[:2])
        yield pd.DataFrame({"grammar": [pickle.dumps(fitted([r[1] for r in own], np.array([r[2] for r in own], float)))]})

    # The bounded sample is one task's, so that neither its texts nor what training takes are in the driver.
    return pickle.loads(rows.repartition(1).mapInPandas(run, "grammar binary").first()[0])


def scored(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each text."""
    small_batches(docs.sparkSession)

    def run(batches):
        lexicon = grammar.lexicon()
        for pdf in batches:
            values = [score(t, grammar, lexicon) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": values, "predicted": [int(v >= threshold) for v in values]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, as they are."""
    grammar = train(docs, labels)
    small_batches(docs.sparkSession)
    state: dict = {}

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        lexicon = state.setdefault("lexicon", None) or state.update(lexicon=grammar.lexicon()) or state["lexicon"]
        return pd.Series([score(t, grammar, lexicon) for t in texts], dtype=float)

    return docs.filter(toxic(F.col("text").cast("string")) < threshold)
