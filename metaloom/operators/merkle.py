"""Snapshots of file trees by content, and what changed between two of them, opening only the folders that differ.

A snapshot is the digest of its root.  The table of trees has a row (tree, name, kind, digest) for each entry of each
different folder; folders with equal content, of one snapshot or of several, are one tree in it.  ``changed`` descends
from two roots, a join a level over (folder, digest), and follows a folder only where its digests differ, so the work
is that of the changed folders and their entries, whatever the size of the rest.

A folder's digest is a digest of digests of groups of its entries, so no folder is one list in one task.

Results for odd input.  Paths are cut at slashes; empty parts are left out, and a path without any is no file.  Of
repeated paths the greatest digest stays; null paths and digests are no files.  A path that is a file and a folder at
once is an error of the input that ``trees`` raises.  Two empty snapshots are equal; a root that the table does not hold
is an error of ``changed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.tables import materialized
from metaloom.operators.incremental import blob_hash
from metaloom.operators.registry import query

ENTRY = "tree string, name string, kind string, digest string"
GROUPS = 4096
#: The digest of a folder without entries.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _digest(lines: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


def _hashed(entries: DataFrame) -> DataFrame:
    """(folder, tree): the digest of each folder's entries (folder, name, kind, digest)."""
    line = F.concat_ws("\t", "kind", "name", "digest")
    groups = entries.groupBy("folder", F.pmod(F.xxhash64("name"), F.lit(GROUPS)).alias("g")).agg(_digest(line).alias("d"))
    return groups.groupBy("folder").agg(_digest(F.concat_ws(":", F.lpad(F.col("g").cast("string"), 4, "0"), "d")).alias("tree"))


def trees(files: DataFrame) -> tuple[str, DataFrame]:
    """The root's digest and the table of trees of files (path, digest), built from the deepest folders up."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = files.filter("digest IS NOT NULL").select(parts.alias("p"), "digest").filter("size(p) > 0").groupBy("p").agg(F.max("digest").alias("digest"))
    rows = materialized(rows.select(F.size("p").alias("depth"), F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("folder"), F.element_at("p", -1).alias("name"), F.lit("blob").alias("kind"), "digest"), "files")
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return EMPTY, files.sparkSession.createDataFrame([], ENTRY)
    out, below = None, None
    for depth in range(deepest, 0, -1):
        here = rows.filter(F.col("depth") == depth).drop("depth")
        if below is not None:  # the folders of the level below are entries of this one
            at = F.split("folder", "/")
            here = here.unionByName(below.select(F.array_join(F.slice(at, 1, F.size(at) - 1), "/").alias("folder"), F.element_at(at, -1).alias("name"), F.lit("tree").alias("kind"), F.col("tree").alias("digest")))
        here = materialized(here, "entries")
        below = materialized(_hashed(here), "folders")
        twice = here.groupBy("folder", "name").count().filter("count > 1").first()
        if twice:
            raise ValueError(f"{twice['folder']}/{twice['name']} is a file and a folder")
        # Of folders with equal content one is stored.
        level = here.join(below.groupBy("tree").agg(F.min("folder").alias("folder")), "folder").select("tree", "name", "kind", "digest")
        out = level if out is None else out.union(level)
    root = below.first()["tree"]
    return root, materialized(out.distinct(), "trees")


def changed(stored: DataFrame, old: str, new: str) -> DataFrame:
    """(path, action, old_digest, new_digest) of files added, removed or changed between two roots.

    A round joins the folders in doubt with their entries on both sides; rounds are as many as the deepest changed path
    has parts.  A file that becomes a folder, or the other way, is removed, and its new files are added.
    """
    spark = stored.sparkSession
    for r in (old, new):
        if r != EMPTY and stored.filter(F.col("tree") == r).isEmpty():
            raise ValueError(f"no tree {r}")
    doubt = spark.createDataFrame([("", None if old == EMPTY else old, None if new == EMPTY else new)] if old != new else [], "folder string, a string, b string")
    out = spark.createDataFrame([], "path string, action string, old_digest string, new_digest string")
    while True:
        side = lambda c, doubt=doubt: doubt.select("folder", F.col(c).alias("tree")).join(stored, "tree").select("folder", "name", "kind", F.col("digest").alias(c))
        # An entry that changes its kind is two entries here, one of each kind.
        both = side("a").join(side("b"), ["folder", "name", "kind"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
        both = materialized(both.select(F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")).alias("path"), "kind", "a", "b"), "differing")
        action = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
        out = out.union(both.filter("kind = 'blob'").select("path", action, F.col("a"), F.col("b")))
        doubt = both.filter("kind = 'tree'").select(F.col("path").alias("folder"), "a", "b")
        if doubt.isEmpty():
            return out


def path_of(key: Column, width: int = 64) -> Column:
    """A file's path by its number: folders of a bounded width, two levels deep."""
    return F.concat_ws("/", F.concat(F.lit("d"), key % width), F.concat(F.lit("e"), F.floor(key / width) % width), F.concat(key.cast("string"), F.lit(".txt")))


_SNAPSHOTS = """f AS (SELECT doc_id, 'd' || doc_id % 64 || '/e' || (doc_id // 64) % 64 || '/' || doc_id || '.txt' AS path,
  sha1('blob ' || octet_length(encode(coalesce(text, ''))) || chr(0) || coalesce(text, '')) AS digest, doc_id % 64 IN (3, 5) AS touched, source FROM documents),
a AS (SELECT path, digest FROM f WHERE NOT (touched AND source LIKE '%a%')),
b AS (SELECT path, CASE WHEN touched AND length(source) % 2 = 0 THEN sha1(digest) ELSE digest END AS digest FROM f WHERE NOT (touched AND source LIKE '%w%'))"""


@query("S19", f"""WITH {_SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS action,
a.digest AS old_digest, b.digest AS new_digest FROM a FULL JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest""")
def _(d):
    """Two snapshots of all documents as files, of which two of the outer folders differ in added, removed and changed ones."""
    f = d.documents.select(path_of(F.col("doc_id")).alias("path"), blob_hash(F.coalesce("text", F.lit(""))).alias("digest"), (F.col("doc_id") % 64).isin(3, 5).alias("touched"), "source")
    f = materialized(f, "snapshot")
    a = f.filter(~(F.col("touched") & F.col("source").contains("a")))
    b = f.filter(~(F.col("touched") & F.col("source").contains("w")))
    b = b.withColumn("digest", F.when(F.col("touched") & (F.char_length("source") % 2 == 0), F.sha1("digest")).otherwise(F.col("digest")))
    (old, one), (new, other) = trees(a.select("path", "digest")), trees(b.select("path", "digest"))
    return changed(materialized(one.union(other).distinct(), "trees"), old, new)
