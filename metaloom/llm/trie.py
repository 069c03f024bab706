"""The prefix trie of conversations: which conversations begin alike, how far, and what sharing their beginnings saves.

Every turn gets a token, a hash of role and text; turns of equal token are compared in full, and a token that different
contents share is dealt anew.  The fingerprint of the first d turns is the polynomial of their tokens modulo 2**64.
It is a prefix sum, so numpy scans it over ranges of sorted turns: a range starts from nothing, and what the ranges
before it hold of its first conversation is added afterwards by a table of two rows a range at most.  So a conversation
may span any number of tasks.

Prefixes of equal depth and fingerprint are a candidate group.  Its smallest conversation represents it, and each
member's last turn and the fingerprint before it are held against the representative's.  If they agree in all groups,
then by induction every turn of every member agrees, and the groups are the nodes of the trie.  Where they disagree, the
prefixes that differ from their representative, and all that continue them, get other fingerprints, and the groups are
made again until none disagrees.

Figures of subtrees are rolled up without a join a level.  A node belongs to its smallest member; a conversation owns
the deeper end of its path.  Each node sends its figure to the nodes above it along its owner's path, as a suffix sum,
and above that path's top as a total of the conversation, which every node sums over its members.

Results for odd input.  A null role or text is an empty one.  Turns stand in the order of (turn, role, text), null turns
first; repeated rows are turns of their own.  Rows with a null conv_id are one conversation, of which nothing is
replaced, the smallest of all, ``null`` in lists of ids.  Other columns are ignored.  An empty table has no node, not
even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.base import NULL_ID, known_id, partitions, real_id, saved, small_batches

#: The odd base of the polynomial and its inverse modulo 2**64 (fixed values).
BASE = 0x9E3779B97F4A7C15
INVERSE, MASK = pow(BASE, -1, 1 << 64), (1 << 64) - 1
#: Conversations that share turns of their beginning stand in runs of so many ids; the run's first one gives them.
RUN, MOST_SHARED = 20, 4
#: Ids in one piece of a node's list of ends.
PIECE = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def _wrapped(series) -> np.ndarray:
    return np.asarray(series, "i8").view("u8")


def linear(poly: Column, by: Column, plus: Column) -> Column:
    """poly * by + plus modulo 2**64; Spark's own sums stop at an overflow."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series((_wrapped(a) * _wrapped(b) + _wrapped(c)).view("i8"))

    return run(poly, by, plus)


def _segments(keys: np.ndarray, values: np.ndarray, powers: np.ndarray, state: tuple) -> tuple:
    """Positions, polynomials before and with each row, and sums within runs of equal keys; and the state after them.
    The state is that of the run that goes on from the rows before: (key, rows, polynomial, next power, sum)."""
    tokens, figures = values
    n = len(keys)
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, n]))
    place = np.arange(n) - begins[of]
    goes_on = state[0] is not None and keys[0] == state[0]
    head = of == 0 if goes_on else np.zeros(n, bool)
    scale = np.where(head, np.uint64(state[3]), np.uint64(1))
    terms = tokens * powers[place] * scale
    run, total = np.cumsum(terms), np.cumsum(figures)
    run -= (run[begins] - terms[begins])[of]
    total -= (total[begins] - figures[begins])[of]
    run += np.where(head, np.uint64(state[2]), np.uint64(0))
    total += np.where(head, state[4], 0)
    position = place + np.where(head, state[1], 0)
    last = (keys[-1], int(position[-1]) + 1, int(run[-1]), int(powers[place[-1]]) * int(scale[-1]) * BASE & MASK, int(total[-1]))
    return position, run - terms, run, total, last


def scanned(rows: DataFrame, key: str, order: list, kept: list[str], token: str | None = None, figure: str | None = None) -> DataFrame:
    """(key, kept..., pos, before, poly, total) of each row, in the order within its key: how many rows stand before it,
    the polynomial of the tokens before it and with it, and the sum of the figures so far.

    Ranges of (key, order) are scanned apart.  ``order`` may hold columns that aren't kept.
    """
    spark = rows.sparkSession
    small_batches(spark, 1 << 14)
    by = [F.col(key), *order, F.col("_row")]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    columns = list(dict.fromkeys([key, *kept, *(x for x in (token, figure) if x)]))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", part int, pos long, before long, poly long, total long"

    def run(batches):
        state, powers = (None, 0, 0, 1, 0), np.ones(1, "u8")
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            if len(powers) < n:
                powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, "u8")], dtype="u8")
            tokens = _wrapped(pdf[token]) if token else np.zeros(n, "u8")
            figures = np.asarray(pdf[figure], "i8") if figure else np.zeros(n, "i8")
            position, before, poly, total, state = _segments(np.asarray(pdf[key], "i8"), (tokens, figures), powers, state)
            yield pdf.assign(pos=position, before=before.view("i8"), poly=poly.view("i8"), total=total)

    local = saved(ranges.select(*columns, F.spark_partition_id().alias("part")).mapInPandas(run, kinds), "scanned")
    edges = local.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    over = edges.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias(key)).groupBy(key).count().filter("count > 1").select(key)
    # At most two keys a range go over its borders, so what follows has rows for ranges, not for the rows in them.
    ends = local.join(F.broadcast(over), key).groupBy(key, "part").agg(F.max_by(F.struct("pos", "poly", "total"), "pos").alias("end")).select(key, "part", "end.*")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("part"), []
        rows_, poly, total = 0, 0, 0
        for x in pdf.itertuples():
            scale = pow(BASE, rows_, 1 << 64)
            out.append((getattr(x, key), x.part, rows_, signed(scale), signed(poly), total))
            rows_, poly, total = rows_ + x.pos + 1, poly + int(x.poly) * scale, total + x.total
        return pd.DataFrame(out, columns=[key, "part", "add_pos", "scale", "add_poly", "add_total"])

    carried = saved(ends.groupBy(key).applyInPandas(carry, f"{key} long, part int, add_pos long, scale long, add_poly long, add_total long"), "carried")
    if carried.isEmpty():
        return local.drop("part")
    out = local.join(F.broadcast(carried), [key, "part"], "left")
    scale, more = F.coalesce("scale", F.lit(1)), F.coalesce("add_poly", F.lit(0))
    return saved(out.select(*columns, (F.col("pos") + F.coalesce("add_pos", F.lit(0))).alias("pos"), linear(F.col("before"), scale, more).alias("before"), linear(F.col("poly"), scale, more).alias("poly"), (F.col("total") + F.coalesce("add_total", F.lit(0))).alias("total")), "scanned-whole")


def tokenised(turns: DataFrame, bits: int = 64) -> DataFrame:
    """turns with a token: a hash of role and text by which different contents differ.  Turns of equal token are compared
    in full.  With fewer bits the first hash is short, which makes collisions (for tests)."""
    first = F.xxhash64("role", "text")
    turns, k = turns.withColumn("token", first if bits == 64 else F.pmod(first, F.lit(1 << bits))), 0
    while True:
        contents = turns.groupBy("token", "role", "text").agg(F.lit(1).alias("one"))
        shared = saved(contents.groupBy("token").count().filter("count > 1").select("token", F.lit(True).alias("shared")), "shared-tokens")
        if shared.isEmpty():
            return turns
        k += 1
        turns = turns.join(shared, "token", "left").withColumn("token", F.when(F.col("shared"), F.xxhash64(F.lit(k), "role", "text", F.lit(k))).otherwise(F.col("token"))).drop("shared")


def rebuilt(turns: DataFrame, run: int = RUN, most: int = MOST_SHARED) -> DataFrame:
    """(conv, depth, print, before, token, words, last): a row for each prefix of each rebuilt conversation, depth 0
    included.  The first h turns come from the first conversation of the run of ids, h being the CRC-32 of the
    conversation's decimal id modulo ``most``; fingerprints of the parts are joined by the polynomial's algebra.
    """
    own = scanned(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["words"], token="token")
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    heads = [F.array(*(at(k, c) for k in range(most - 1))).alias(c) for c in ("before", "poly", "token", "words")]
    convs = saved(own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), *heads), "conversations")
    base = F.when(F.col("conv") == NULL_ID, F.col("conv")).otherwise(F.col("conv") - F.col("conv") % run)
    h = F.when(F.col("conv") == NULL_ID, F.lit(0)).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    # A conversation gives turns to those of its run only, so this join has at most 2 * run rows for a key.
    of = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), *[F.col(c).alias(f"base_{c}") for c in ("before", "poly", "token", "words")])
    info = convs.select("conv", "n", "poly", base.alias("base"), h.alias("h")).join(of, "base", "left")
    info = info.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    by = F.element_at(F.array(*(F.lit(signed(pow(INVERSE, k, 1 << 64))) for k in range(most))), (F.col("h") - F.col("m") + 1).cast("int"))
    nth = lambda c, k: F.when(k > 0, F.element_at(c, F.greatest(k, F.lit(1)).cast("int")))
    cut = F.when(F.col("n") > F.col("h"), F.coalesce(nth("poly", F.col("h")), F.lit(0))).otherwise(F.lit(0))
    start = F.coalesce(nth("base_poly", F.col("m")), F.lit(0))
    info = info.withColumn("by", by).withColumn("cut", linear(cut, F.lit(-1).cast("long"), F.lit(0).cast("long"))).withColumn("start", start)
    info = saved(info.withColumn("plus", linear(F.col("cut"), F.col("by"), F.col("start"))), "rebuilt")
    tail = own.select("conv", "pos", F.col("before").alias("b"), F.col("poly").alias("p"), "token", "words").join(info.select("conv", "h", "m", "length", "by", "plus"), "conv").filter("pos >= h")
    depth = F.col("pos") - F.col("h") + F.col("m") + 1
    tail = tail.select("conv", depth.alias("depth"), linear(F.col("p"), F.col("by"), F.col("plus")).alias("print"), linear(F.col("b"), F.col("by"), F.col("plus")).alias("before"), "token", "words", (depth == F.col("length")).alias("last"))
    head = info.filter("m > 0").select("conv", "m", "length", F.posexplode(F.arrays_zip(*(F.col(f"base_{c}").alias(c) for c in ("before", "poly", "token", "words")))).alias("k", "x")).filter("k < m")
    head = head.select("conv", (F.col("k") + 1).cast("long").alias("depth"), F.col("x.poly").alias("print"), F.col("x.before").alias("before"), F.col("x.token").alias("token"), F.col("x.words").alias("words"), (F.col("k") + 1 == F.col("length")).alias("last"))
    zero = F.lit(0).cast("long")
    root = info.select("conv", zero.alias("depth"), zero.alias("print"), zero.alias("before"), zero.alias("token"), zero.alias("words"), (F.col("length") == 0).alias("last"))
    return saved(tail.unionByName(head).unionByName(root), "prefixes")


def nodes_of(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, prefixes): the verified groups (depth, print, conv, n_convs, before, words), and the prefixes with the
    fingerprints by which groups are right."""
    k = 0
    while True:
        ends = [f(c).alias(f"{name}_{c}") for c in ("token", "before") for name, f in (("least", F.min), ("most", F.max))]
        nodes = saved(prefixes.groupBy("depth", "print").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *ends), "nodes")
        wrong = nodes.filter("least_token <> most_token or least_before <> most_before")
        if wrong.isEmpty():
            return nodes.select("depth", "print", "conv", "n_convs", F.col("least_before").alias("before"), "words"), prefixes
        k += 1
        like = prefixes.join(wrong.select("depth", "print"), ["depth", "print"]).groupBy("depth", "print").agg(F.min_by(F.struct("token", "before"), "conv").alias("like"))
        apart = prefixes.join(saved(like, "representatives"), ["depth", "print"]).filter("token <> like.token or before <> like.before")
        apart = saved(apart.select("conv", "depth", F.xxhash64(F.lit(k), "depth", "before", "token").alias("turned")), "collisions")
        # Collisions are rare, so this goes over the few conversations that have one; the others keep their rows.
        hit = prefixes.join(apart.select("conv").distinct(), "conv").join(apart, ["conv", "depth"], "left")
        path = Window.partitionBy("conv").orderBy("depth")
        turned = F.coalesce(F.bit_xor("turned").over(path.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        above = F.coalesce(F.bit_xor("turned").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = hit.select("conv", "depth", F.col("print").bitwiseXOR(turned).alias("print"), F.col("before").bitwiseXOR(above).alias("before"), "token", "words", "last")
        prefixes = saved(prefixes.join(apart.select("conv").distinct(), "conv", "left_anti").unionByName(hit), "prefixes")


def lists_of_ends(prefixes: DataFrame) -> DataFrame:
    """(depth, print, ends_sha256): the digest of the ids that end at a node.  Ids gather in pieces of a span of ids, so no
    list is long; the pieces of a node stream in order through one digest, which is sequential by nature."""
    small_batches(prefixes.sparkSession, 256)
    name = F.when(F.col("conv") == NULL_ID, F.lit("null")).otherwise(F.col("conv").cast("string"))
    pieces = prefixes.filter("last").groupBy("depth", "print", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("conv", name.alias("name")))).alias("ids"))
    pieces = pieces.select("depth", "print", "piece", F.array_join("ids.name", ",").alias("ids"))

    def digest(batches):
        at = sha = None
        for pdf in batches:
            out = []
            for depth, key, ids in zip(pdf["depth"], pdf["print"], pdf["ids"], strict=True):
                if at == (depth, key):
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (depth, key), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["depth", "print", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=["depth", "print", "ends_sha256"])

    ordered = pieces.repartition(partitions(prefixes.sparkSession), "depth", "print").sortWithinPartitions("depth", "print", "piece")
    return ordered.select("depth", "print", "ids").mapInPandas(digest, "depth long, print long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, run: int = RUN, most: int = MOST_SHARED, bits: int = 64) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(known_id("conv_id").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    turns = tokenised(turns.withColumn("words", F.regexp_count("text", F.lit(WORDS)).cast("long")), bits)
    prefixes = rebuilt(turns, run, most)
    if bits < 64:
        short = F.lit((1 << bits) - 1)
        prefixes = saved(prefixes.withColumns({c: F.col(c).bitwiseAND(short) for c in ("print", "before")}), "prefixes")
    nodes, prefixes = nodes_of(prefixes)
    node = ["depth", "print"]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("print")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saves", (F.col("n_convs") - 1) * F.col("words"))
    nodes = saved(nodes, "nodes")
    # A conversation owns the nodes whose smallest member it is: the deeper end of its path.
    owners = saved(nodes.groupBy("conv").agg(F.sum("saves").alias("saves"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "owners")
    over = prefixes.select("conv", *node).join(owners, "conv").groupBy(*node).agg(F.sum("saves").alias("member_saves"), F.sum("leaf").alias("n_leaves"))
    path = scanned(nodes, "conv", [F.col("depth")], ["depth", "print"], figure="saves")
    # Below a node lies all that its members own, but for what its owner owns above it.
    below = path.select(*node, (F.col("total") - F.col("saves")).alias("above"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("before"), real_id("conv").alias("parent_conv_id"))
    out = nodes.select("conv", *node, "before", "n_convs", "n_children").join(over, node, "left").join(below, node)
    out = out.join(saved(lists_of_ends(prefixes), "ends"), node, "left").join(parents, ["depth", "before"], "left")
    return out.select(
        real_id("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("member_saves") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
