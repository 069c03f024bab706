"""A stored inverted index over the names of objects, beside the scan that gives the same rows.

Two dictionaries are indexed, both or one of them: the words of an object's names, and the whole lower-cased values of its
name fields.  Of each, ``postings`` holds (key, object) rows in buckets of the key's checksum, in the order of keys, and
``grams`` leads to them: from the first and the last two characters of words to the words, and from trigrams to the blocks
of postings with values that hold them (a row for each block, as a row for each value would be many times the postings).  A
search reads the buckets of the pieces it asks for, and then the buckets of the keys or blocks that match; the columns of an
answer ride along in the postings.

An index is a folder of versions, each written whole, and of manifests, appended last: a reader takes the latest
manifest, so a build that fails leaves the former version in use.  ``state`` tells whether an index is missing, stale (its
objects have changed since) or ready; searches fall back to the scan unless it is ready.  Other errors are not taken for
a missing index.

Results for odd input.  An id names one object, and is given as a string; an object without id is found like any other; a
null name counts as none; repeated rows are one on both paths; other columns are left out.  An empty table gives an index that finds nothing.  A text
without words finds nothing; a needle of fewer than three characters has no trigram and is looked for by the scan.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.tables import materialized, shared_dir
from metaloom.functions.text import words
from metaloom.operators.graph import containing
from metaloom.operators.registry import SQL, query
from metaloom.operators.search import EXACT, FUZZY, FUZZY_LENGTH, PREFIX, name_hits, query_words, relevance

BUCKETS = 64
#: Postings of a block of values are 2 to this power.
BLOCK_BITS = 12
#: Characters of a block's values after which its trigrams are passed on.
HELD_CHARS = 1 << 20
DICTIONARIES = ("words", "values")
FIELDS = ("name", "synonym", "full_name_ru", "full_name_eng")
COLUMNS = ("id", "name", "kind", "synonym")


def bucket(key: Column | str, n: int) -> Column:
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(n)).cast("int")


def bucket_of(key: str, n: int) -> int:
    return zlib.crc32(key.encode()) % n


def version_of(objects: DataFrame) -> str:
    """A checksum of the objects' indexed columns that no order of rows changes; one pass, no shuffle of rows."""
    cols = [F.col(c) for c in dict.fromkeys((*COLUMNS, *FIELDS))]
    each = lambda seed: F.sum(F.xxhash64(*cols, F.lit(seed)).cast("decimal(38,0)")).cast("string")
    r = objects.agg(F.count(F.lit(1)).alias("n"), each(1).alias("a"), each(2).alias("b")).first()
    return f"{r['n']}:{r['a']}:{r['b']}"


def _rows(objects: DataFrame) -> DataFrame:
    return objects.select(*(F.col(c).cast("string").alias(c) for c in dict.fromkeys((*COLUMNS, *FIELDS))))


def _word_pieces(key: Column) -> Column:
    """Where a word is looked for: its first one and two characters, and its last two."""
    return F.array_distinct(F.array(F.concat(F.lit("^"), F.left(key, F.lit(1))), F.concat(F.lit("^"), F.left(key, F.lit(2))), F.concat(F.right(key, F.lit(2)), F.lit("$"))))


def _distinct_trigrams(values: list[str]) -> list[str]:
    """The distinct runs of three code points within values."""
    lengths = np.array([len(v) for v in values], np.int64)
    code = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(code) < 3:
        return []
    ends, fits = np.cumsum(lengths)[lengths > 0], np.ones(len(code), bool)
    fits[ends - 1] = fits[np.maximum(ends - 2, 0)] = False  # none runs on into the next value
    three = np.unique((code[:-2] << 42 | code[1:-1] << 21 | code[2:])[fits[:-2]])
    flat = np.stack([three >> 42, three >> 21 & 0x1FFFFF, three & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [flat[k : k + 3] for k in range(0, len(flat), 3)]


def _block_trigrams(most: int):
    """A function of Arrow batches of postings (key, bucket, block), the rows of a block one after the other, that gives
    (home, block, gram): each trigram of a block once, or once for each so many characters, or each task that reads of it."""

    def rows(own, keys):
        grams = _distinct_trigrams(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), own[0], np.int32)), pa.array(np.full(len(grams), own[1], np.int64)), pa.array(grams, pa.string())], ["home", "block", "gram"])

    def run(batches):
        held, keys, chars = None, [], 0
        for batch in batches:
            home, block = (batch[c].to_numpy(zero_copy_only=False) for c in ("bucket", "block"))
            cuts = (np.flatnonzero((np.diff(home) != 0) | (np.diff(block) != 0)) + 1).tolist()
            for start, stop in zip([0, *cuts], [*cuts, len(home)], strict=True):
                own = (home[start], block[start]) if start < stop else held
                if keys and (own != held or chars > most):
                    yield rows(held, keys)
                    keys, chars = [], 0
                held = own
                more = [v.decode("utf-8", "replace") for v in batch["key"].slice(start, stop - start).unique().cast(pa.binary()).to_pylist()]
                keys, chars = keys + more, chars + sum(map(len, more))
        if keys:
            yield rows(held, keys)

    return run


def _write(df: DataFrame, at: str, key: str, **numbers: Column):
    """A directory for each bucket; Spark unites small buckets in a task and deals large ones out to several.  Columns of
    numbers are taken from the rows in their order."""
    df.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", key).withColumns(numbers).write.partitionBy("bucket").parquet(at)


def build(objects: DataFrame, at: str, buckets: int = BUCKETS, version: str | None = None, dictionaries: tuple[str, ...] = DICTIONARIES) -> str:
    """Writes a version of the index under a folder, and then its manifest; returns the version.

    ``version`` names the state of the objects, if the caller has a name for it (a table's snapshot); else it is their
    checksum.
    """
    spark, own = objects.sparkSession, uuid.uuid4().hex
    version, folder = version or version_of(objects), f"{at}/{own}"
    rows = _rows(objects)
    cut = rows.select(*COLUMNS, F.explode(F.array_distinct(words(F.concat_ws(" ", "name", "synonym", "full_name_ru")))).alias("key"))
    values = rows.select(*COLUMNS, F.explode(F.array_distinct(F.array_compact(F.array(*(F.lower(c) for c in FIELDS))))).alias("key"))
    if "words" in dictionaries:
        _write(cut.withColumn("bucket", bucket("key", buckets)), f"{folder}/words/postings", "key")
        keys = spark.read.schema("key string").parquet(f"{folder}/words/postings").distinct()
        grams = keys.select("key", F.explode(_word_pieces(F.col("key"))).alias("gram"))
        _write(grams.withColumn("bucket", bucket("gram", buckets)), f"{folder}/words/grams", "key")
    if "values" in dictionaries:
        block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
        _write(values.withColumn("bucket", bucket("key", buckets)), f"{folder}/values/postings", "key", block=block)
        posts = spark.read.schema("key string, block long, bucket int").parquet(f"{folder}/values/postings")
        grams = posts.mapInArrow(_block_trigrams(HELD_CHARS), "home int, block long, gram string")
        _write(grams.withColumn("bucket", bucket("gram", buckets)), f"{folder}/values/grams", "gram")
    manifest = spark.range(1).select(F.lit(own).alias("folder"), F.lit(version).alias("version"), F.lit(buckets).alias("buckets"), F.array(*map(F.lit, dictionaries)).alias("dictionaries"), F.current_timestamp().alias("at"))
    manifest.coalesce(1).write.mode("append").parquet(f"{at}/manifests")
    return version


def manifest(spark: SparkSession, at: str):
    """The latest manifest, or None if there is no index; any other error is raised."""
    try:
        rows = spark.read.schema("folder string, version string, buckets int, dictionaries array<string>, at timestamp").parquet(f"{at}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("at"), F.desc("folder")).first()


def state(objects: DataFrame, at: str, version: str | None = None, dictionaries: tuple[str, ...] = ()) -> str:
    """missing, stale or ready; an index without one of the dictionaries is missing."""
    m = manifest(objects.sparkSession, at)
    if m is None or not set(dictionaries) <= set(m["dictionaries"] or DICTIONARIES):
        return "missing"
    return "ready" if m["version"] == (version or version_of(objects)) else "stale"


class Index:
    """The latest version of a stored index."""

    def __init__(self, spark: SparkSession, at: str):
        m = manifest(spark, at)
        if m is None:
            raise ValueError(f"no index in {at}")
        self.spark, self.folder, self.buckets = spark, f"{at}/{m['folder']}", m["buckets"]

    def table(self, name: str) -> DataFrame:
        columns = "gram string, " if name.endswith("grams") else "".join(f"{c} string, " for c in COLUMNS)
        columns += {"values/grams": "home int, block long", "values/postings": "key string, block long"}.get(name, "key string")
        return self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.folder}/{name}")

    def keys_of(self, name: str, grams: list[str]) -> DataFrame:
        """The keys under pieces, or the blocks of values, from the pieces' buckets."""
        at = sorted({bucket_of(g, self.buckets) for g in grams})
        return self.table(f"{name}/grams").filter(F.col("bucket").isin(at) & F.col("gram").isin(grams))

    def posted(self, name: str, keys: DataFrame) -> DataFrame:
        """Postings of keys, from the keys' buckets; what comes to the driver is numbers of buckets, at most all of them."""
        keys = materialized(keys, "keys")
        at = [r[0] for r in keys.select(bucket("key", self.buckets)).distinct().collect()]
        return self.table(f"{name}/postings").filter(F.col("bucket").isin(at)).drop("bucket").join(keys, "key")

    def hits(self, text: str) -> DataFrame:
        """(id, name, kind, synonym, score) of all objects that match a text's words, as the scan scores them."""
        asked = query_words(text)
        found, score = None, F.lit(0.0)
        for n, w in enumerate(dict.fromkeys(asked)):
            fuzzy = len(w) >= FUZZY_LENGTH
            grams = [f"^{w[:2]}"] + ([f"{w[-2:]}$"] if fuzzy else [])  # one edit leaves the first or the last half as it is
            key = F.col("key")
            near = (F.levenshtein(key, F.lit(w), 1) >= 0) if fuzzy else F.lit(False)
            part = self.keys_of("words", grams).select("key").distinct().select("key", F.lit(n).alias("word"), key.startswith(w).alias("prefix"), (key == w).alias("exact"), near.alias("near"))
            part = part.filter("prefix OR exact OR near")
            found = part if found is None else found.union(part)
            own = lambda c, weight, n=n: F.when(F.max(F.when(F.col("word") == n, F.col(c)).otherwise(False)), weight).otherwise(0.0)
            score = score + asked.count(w) * (own("prefix", PREFIX) + own("exact", EXACT) + own("near", FUZZY))
        if found is None:
            return self.table("words/postings").select(*COLUMNS, F.lit(0.0).alias("score")).limit(0)
        return self.posted("words", found).groupBy(*COLUMNS).agg(score.alias("score"))

    def holding(self, text: str) -> DataFrame:
        """(id, name, kind, synonym) of all objects with a name field that holds a text of three characters or more."""
        low = text.lower()
        grams = list(dict.fromkeys(low[k : k + 3] for k in range(len(low) - 2)))
        blocks = self.keys_of("values", grams).groupBy("home", "block").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
        blocks = materialized(blocks.select("home", "block"), "blocks")
        at = [r[0] for r in blocks.select("home").distinct().collect()]
        posts = self.table("values/postings").filter(F.col("bucket").isin(at) & F.contains("key", F.lit(low)))
        return posts.join(blocks, (posts["bucket"] == blocks["home"]) & (posts["block"] == blocks["block"]), "left_semi").select(*COLUMNS).distinct()


def search(objects: DataFrame, at: str, text: str, kinds: list[str], limit: int = 20, offset: int = 0, version: str | None = None) -> tuple[str, DataFrame]:
    """The path taken, index or scan, and a page of objects by relevance (id, name, score)."""
    if state(objects, at, version, ("words",)) == "ready":
        path, found, order = "index", Index(objects.sparkSession, at).hits(text), relevance(text, kinds)
    else:
        path, (found, order) = "scan", name_hits(_rows(objects), text, kinds)
        found = found.select(*COLUMNS, "score").distinct()
    return path, found.orderBy(*order).select("id", "name", "score").offset(offset).limit(limit)


def holding(objects: DataFrame, at: str, text: str, version: str | None = None) -> tuple[str, DataFrame]:
    """The path taken, and all objects (id, name, kind, synonym) with a name field that holds a text."""
    if len(text.lower()) >= 3 and state(objects, at, version, ("values",)) == "ready":
        return "index", Index(objects.sparkSession, at).holding(text)
    return "scan", containing(_rows(objects), text).select(*COLUMNS).distinct()


def ensured(objects: DataFrame, at: str, version: str | None = None, dictionaries: tuple[str, ...] = DICTIONARIES) -> str:
    """The folder, with an index of these very objects in it; built only if it is missing or stale."""
    version = version or version_of(objects)
    if state(objects, at, version, dictionaries) != "ready":
        build(objects, at, version=version, dictionaries=dictionaries)
    return at


def _stored(d, version: str, dictionary: str) -> str:
    """A stored index with the one dictionary that a query reads."""
    return ensured(d.g_objects, f"{shared_dir(d.g_objects.sparkSession)}/name-index-{dictionary}", version, (dictionary,))


@query("H01_indexed", SQL["H01"])
def _(d):
    version = version_of(d.g_objects)
    return search(d.g_objects, _stored(d, version, "words"), "C12 automobile", ["Catalog", "Document"], 30, version=version)[1]


@query("F05_indexed", SQL["F05"])
def _(d):
    version = version_of(d.g_objects)
    return holding(d.g_objects, _stored(d, version, "values"), "AUTO", version)[1].select("id", "name", "synonym")


@query("F10", f"""SELECT s.state, s.path, h.id, h.name, h.score
FROM (VALUES ('missing', 'scan'), ('stale', 'scan'), ('ready', 'index')) s(state, path), ({SQL["H01"]}) h""")
def _(d):
    """The same page in each state of the index, with the path taken; the stale one was built before the enumerations came."""
    stale, version = f"{shared_dir(d.g_objects.sparkSession)}/name-index-{uuid.uuid4().hex}", version_of(d.g_objects)
    build(d.g_objects.filter("kind <> 'Enum'"), stale, dictionaries=("words",))
    out = None
    for at in (f"{stale}-none", stale, _stored(d, version, "words")):
        path, page = search(d.g_objects, at, "C12 automobile", ["Catalog", "Document"], 30, version=version)
        part = page.select(F.lit(state(d.g_objects, at, version)).alias("state"), F.lit(path).alias("path"), "id", "name", "score")
        out = part if out is None else out.union(part)
    return out
