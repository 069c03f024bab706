"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is cut into special tokens and pre-tokens as the tokenizer's file says.  A pre-token longer than a leaf is halved
until the pieces are leaves, which the tokenizers library encodes, and neighbours are joined up the tree; outcomes of
pre-tokens that are not long are remembered.  For a join, a window of tokens around it is encoded again and grows until
it agrees with the tokens on both sides.  Two sides agree if the pair of tokens that meet there is what the encoding of their joined
bytes gives; a sequence in which all neighbours agree is the encoding of the whole.

Pre-tokens of more than ``SPREAD`` bytes are not left to the task of their text.  Their halves are rows of their own,
once for each different pre-token, and are encoded by all tasks in parallel; a level of joins is a grouped job, in
which each pair of neighbours is a group.  Texts then get the outcomes back by the pre-token's SHA-256.

Results for odd input.  A null text is an empty one, with no tokens.  Repeated rows and ids are rows of their own; a
null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import partitions, saved, small_batches

#: Bytes of a pre-token that is encoded at once; longer ones are joined up a tree.
LEAF = 8
#: Bytes of a pre-token that is remembered.
LONGEST = 256
#: Bytes of a pre-token that is dealt to several tasks, and of the pieces that it is dealt in.
SPREAD = 1 << 16
#: Pre-tokens that a worker remembers.
REMEMBERED = 1 << 18
#: The pre-tokens of the byte-level files (fixed value, published with that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern says for ASCII texts without the controls that count as white space in some libraries only.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_CONTROL = re.compile("[\x1c-\x1f]")
#: Ids that are decoded at a time.
DECODED = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


@functools.cache
def _plain_chars() -> dict[int, str]:
    """The same for str.translate of bytes read as Latin-1."""
    return dict(enumerate(byte_chars()))


def _half_if_full(known: dict) -> None:
    if len(known) > REMEMBERED:
        for x in list(itertools.islice(known, REMEMBERED // 2)):
            del known[x]


class Known(dict):
    """Packed ids of pre-tokens, made when they are first asked for; of long ones nothing is kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids, keep = self.make(word)
        packed = np.array(ids, "<u4").tobytes()
        if keep:
            self[word] = packed
        return packed


class Codec:
    """One tokenizer file; equal in its results to the library's encode and decode."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.leaf, self.known = Tokenizer.from_file(path), leaf, Known(self._word)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        of = {c: b for b, c in enumerate(byte_chars())}
        self.bytes = {i: t.encode() if t in self.special else bytes(of[c] for c in t) for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        #: All of the table's bytes in a row, where each id's begin, and how many they are.
        self.row, self.size = np.frombuffer(b"".join(self.table), np.uint8), np.array([len(t) for t in self.table])
        self.begin = np.cumsum(self.size) - self.size
        special = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Encodings of a text's pre-tokens that other tasks have made, by their SHA-256.
        self.given: dict[bytes, list[int]] = {}
        #: How many pre-tokens were joined from several leaves.
        self.joined = 0

    def _leaf(self, data: bytes) -> list[int]:
        """BPE of bytes that no pre-tokenizer may cut."""
        return [t.id for t in self.tok.model.tokenize(data.decode("latin-1").translate(_plain_chars()))]

    def _agree(self, a: int, b: int) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            _half_if_full(self.pairs)
            ok = self.pairs[a, b] = self._leaf(self.table[a] + self.table[b]) == [a, b]
        return ok

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right or self._agree(left[-1], right[0]):
            return left + right
        size = 2
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = self._leaf(b"".join(map(self.table.__getitem__, left[i:] + right[:j])))
            if (not i or self._agree(left[i - 1], window[0])) and (j == len(right) or self._agree(window[-1], right[j])):
                return left[:i] + window + right[j:]
            size *= 2

    def tree(self, data: bytes) -> list[int]:
        """The encoding of long unsplit bytes."""
        if len(data) <= self.leaf:
            return self._leaf(data) if data else []
        n = 1
        while n * self.leaf < len(data):
            n *= 2
        ends = [len(data) * k // n for k in range(n + 1)]
        level = [self._leaf(data[a:b]) for a, b in zip(ends, ends[1:], strict=False) if a < b]
        self.joined += len(level) > 1
        while len(level) > 1:
            level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else []

    def _word(self, word: str) -> tuple[list[int], bool]:
        """A pre-token's encoding, and if it is to be remembered."""
        data = word.encode("utf-8", "replace")
        if len(data) > LONGEST:
            ids = self.given.get(hashlib.sha256(data).digest()) if self.given else None
            return self.tree(data) if ids is None else ids, False
        return self.tree(data), True

    def long_words(self, text: str, spread: int) -> list[bytes]:
        """The different pre-tokens of more than so many bytes."""
        plain = self.cut.split(text) if self.cut else [text]
        words = {w for part in plain for w in self.find(part) if 4 * len(w) > spread}
        return [data for data in (w.encode("utf-8", "replace") for w in sorted(words)) if len(data) > spread]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each, the least byte first."""
        if self.cut and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [self._plain(text[at : m.start()]), np.uint32(self.special[m[0]]).astype("<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        out = b"".join(map(self.known.__getitem__, self.words(text)))
        _half_if_full(self.known)
        return out

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        return _ASCII.findall(text) if text.isascii() and not _CONTROL.search(text) else self.find(text)

    def decode(self, ids) -> str:
        """The text of ids; as many of them at a time as take bounded memory."""
        ids, out = np.asarray(ids, np.int64), []
        for k in range(0, len(ids), DECODED):
            part = ids[k : k + DECODED]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.row[np.repeat(self.begin[part] - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


def halves(data: bytes, most: int) -> list[bytes]:
    """data halved until no piece is longer than most: a power of two of pieces."""
    n = 1
    while n * most < len(data):
        n *= 2
    ends = [len(data) * k // n for k in range(n + 1)]
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def spread_words(rows: DataFrame, path: str, leaf: int, spread: int) -> DataFrame | None:
    """(text_key, given) for rows (text_key, text) with long pre-tokens: array of (word, ids); None if there are none."""

    def pieces(batches):
        c = codec(path, leaf)
        for pdf in batches:
            out = [(key, hashlib.sha256(w).digest(), k, p) for key, text in zip(pdf["text_key"], pdf["text"], strict=True) for w in c.long_words(text, spread) for k, p in enumerate(halves(w, spread))]
            yield pd.DataFrame(out, columns=["text_key", "word", "k", "piece"])

    found = saved(rows.mapInPandas(pieces, "text_key string, word binary, k int, piece binary"), "pieces")
    depth = found.agg(F.max("k")).first()[0]
    if depth is None:
        return None

    def leaves(batches):
        c = codec(path, leaf)
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "k": pdf["k"], "ids": [c.tree(p) for p in pdf["piece"]]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        c, pdf = codec(path, leaf), pdf.sort_values("k")
        left, right = ([int(i) for i in x] for x in (pdf["ids"].iloc[0], pdf["ids"].iloc[1] if len(pdf) > 1 else []))
        return pd.DataFrame({"word": pdf["word"].iloc[:1], "k": [int(pdf["k"].iloc[0]) // 2], "ids": [c.join(left, right)]})

    schema = "word binary, k int, ids array<int>"
    one = found.groupBy("word", "k").agg(F.min("piece").alias("piece")).repartition(partitions(rows.sparkSession), "word", "k")
    level = saved(one.mapInPandas(leaves, schema), "leaves")
    for _ in range(int(depth).bit_length()):
        level = saved(level.groupBy("word", F.floor(F.col("k") / 2).alias("pair")).applyInPandas(joined, schema), "level")
    of = found.select("text_key", "word").distinct().join(level.select("word", "ids"), "word")
    return of.groupBy("text_key").agg(F.collect_list(F.struct("word", "ids")).alias("given"))


def encoded(docs: DataFrame, path: str | None = None, leaf: int = LEAF, with_ids: bool = False, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for, of each text."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        c = codec(path, leaf)
        for pdf in batches:
            rows = []
            for text, given in zip(pdf["text"], pdf["given"], strict=True):
                c.given = {bytes(x["word"]): [int(i) for i in x["ids"]] for x in given} if given is not None else {}
                packed = c.packed(text or "")
                ids = np.frombuffer(packed, "<u4")
                row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest())
                rows.append((*row, ids.tolist()) if with_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(object))
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > spread, F.lit(False))
    keyed = rows.filter(long).withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))
    given = spread_words(keyed.select("text_key", "text"), path, leaf, spread)
    if given is None:
        rows = rows.withColumn("given", F.lit(None).cast("array<struct<word:binary,ids:array<int>>>"))
    else:
        rows = keyed.join(saved(given, "given"), "text_key", "left").drop("text_key").unionByName(rows.filter(~long), allowMissingColumns=True)
    return rows.select("doc_id", "text", "given").mapInPandas(run, schema)
