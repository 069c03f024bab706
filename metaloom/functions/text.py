"""Text functions as column expressions, and the few that need Python as vectorised UDFs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[\p{Lu}])"
#: Sizes of chunks: a text up to LONG stays whole, a chunk aims at TARGET, and a sentence over HARD is cut at words.
LONG, TARGET, HARD = 1500, 1200, 2000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def escaped(text: Column) -> Column:
    """A backslash before each character that a full-text query would read as an operator."""
    return F.regexp_replace(text, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")


def camel_parts(name: Column) -> Column:
    """The words of a CamelCase name; runs of capitals are one word."""
    return F.regexp_extract_all(name, F.lit(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+"), F.lit(0))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comparable(text: Column) -> Column:
    return F.lower(one_space(text))


def sentences(text: Column, least: int = 12) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), F.trim), lambda s: F.char_length(s) >= least)


def _parts(sentence: Column, hard: int) -> Column:
    """A sentence as structs (p, alone): whole, or cut at the last space before hard; all parts but the last stand alone."""
    cut = F.regexp_extract_all(sentence, F.lit(rf"(?s).{{1,{hard}}}\z|.{{100,{hard - 1}}}(?= )|.{{{hard}}}"), F.lit(0))
    parts = F.transform(cut, lambda p, i: F.struct(F.ltrim(p).alias("p"), (i < F.size(cut) - 1).alias("alone")))
    return F.when(F.char_length(sentence) <= hard, F.array(F.struct(sentence.alias("p"), F.lit(False).alias("alone")))).otherwise(parts)


def sentence_chunks(text: Column, target: int = TARGET, hard: int = HARD) -> Column:
    """Sentences packed into chunks of at most target characters, where they fit; one over hard is cut at spaces."""
    pieces = F.flatten(F.transform(F.split(F.trim(text), SENTENCE_END), lambda s: _parts(s, hard)))
    pieces = F.filter(pieces, lambda x: x["p"] != "")

    def packed(state: Column, x: Column) -> Column:
        room, p, alone = state["room"], x["p"], x["alone"]
        full = (room != "") & (alone | (F.char_length(room) + 1 + F.char_length(p) > target))
        done = F.when(full, F.array_append(state["done"], room)).otherwise(state["done"])
        done = F.when(alone, F.array_append(done, p)).otherwise(done)
        room = F.when(alone, F.lit("")).when(full | (room == ""), p).otherwise(F.concat(room, F.lit(" "), p))
        return F.struct(done.alias("done"), room.alias("room"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("room"))
    return F.aggregate(pieces, start, packed, lambda s: F.when(s["room"] != "", F.array_append(s["done"], s["room"])).otherwise(s["done"]))


def card_text(text: Column, long: int = LONG) -> Column:
    """What a card says of a text: all of it, or of a long one its first sentence, at most so many characters of it."""
    first = F.element_at(F.split(text, SENTENCE_END, 2), 1)
    first = F.when(F.char_length(first) > long, F.concat(F.rtrim(F.substring(first, 1, long)), F.lit("…"))).otherwise(first)
    return F.when(F.char_length(text) > long, first).otherwise(text)


def title_names(title: Column) -> Column:
    """struct(ru, en) of a title such as 'Имя (Name)': en is the last group of parentheses, if it ends the title.

    The title is read from its end; the group begins where as many have opened as closed.
    """
    t = F.coalesce(F.trim(title), F.lit(""))
    sign = lambda c: (c == ")").cast("int") - (c == "(").cast("int")
    step = lambda s, c: F.struct((s["depth"] + sign(c)).alias("depth"), (s["read"] + 1).alias("read"), F.when((s["size"] == 0) & (s["depth"] + sign(c) == 0), s["read"] + 1).otherwise(s["size"]).alias("size"))
    size = F.aggregate(F.split(F.reverse(t), ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(0).alias("size")), step, lambda s: s["size"])
    group = F.when(F.endswith(t, F.lit(")")), size).otherwise(0)
    ru = F.when(group == 0, t).otherwise(F.trim(F.left(t, F.char_length(t) - group)))
    en = F.when(group == 0, F.lit("")).otherwise(F.trim(F.substring(t, F.char_length(t) - group + 2, group - 2)))
    return F.struct(ru.alias("ru"), en.alias("en"))


def closest(names: list[str], most: int = 2, cutoff: float = 0.7):
    """A function of a word column that gives the closest of some names, the best first."""
    low = {n.lower(): n for n in names}

    def of(words_: pd.Series) -> pd.Series:
        known: dict = {}
        return words_.map(lambda w: known.setdefault(w, [low[c] for c in difflib.get_close_matches((w or "").lower(), list(low), n=most, cutoff=cutoff)]))

    return lambda word: F.pandas_udf(of, "array<string>")(word)


def rule_ref(code: Column) -> Column:
    """A code with the prefix of its standard, if it has none."""
    return F.when(F.contains(code, F.lit(":")), code).otherwise(F.concat(F.lit("std:"), code))


def _one_digit(x: Column, unit: str) -> Column:
    """A number to one decimal, rounded by its exact binary value."""
    return F.concat(F.replace(F.format_number(x, 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest of five Russian units that keeps the number under 1024."""
    out = _one_digit(n / float(1024**4), "ТБ")
    for k, unit in ((3, "ГБ"), (2, "МБ"), (1, "КБ")):
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), _one_digit(n / float(1024**k), unit)).otherwise(out)
    return F.when(F.abs(n) < 1024, F.concat(n.cast("long").cast("string"), F.lit(" Б"))).otherwise(out)


def human_seconds(s: Column) -> Column:
    return F.when(s < 90, _one_digit(s, "с")).when(s < 5400, _one_digit(s / 60, "мин")).otherwise(_one_digit(s / 3600, "ч"))


def safe_map(json: Column) -> Column:
    """A JSON object as a map; anything else is an empty map."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def card(*parts: Column) -> Column:
    """The parts of a card that are there, a line each, without repeats."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != "")), "\n")
