"""Reads help pages and wiki pages: titles, kinds by path, links, blocks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.registry import query


def without_code(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, title, links, paragraphs, since, deprecated) of help pages (page_id, html)."""
    bare = without_code(F.col("html"))
    return pages.select(
        "page_id",
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_count(bare, F.lit(r"(?i)<a\s")).alias("links"),
        F.regexp_count(bare, F.lit(r"(?i)<p[\s>]")).alias("paragraphs"),
        F.nullif(F.regexp_extract(bare, r"since (\d+(?:\.\d+)*)", 1), F.lit("")).alias("since"),
        F.contains(F.lower(bare), F.lit("deprecated")).alias("deprecated"),
    )


def kind_by_path(path: Column) -> Column:
    """What a help page is about, by the folders in its path."""
    return F.when(path.contains("/methods/"), "method").when(path.contains("/properties/"), "property").when(path.contains("/events/"), "event").when(path.contains("/tables/"), "table").when(path.contains("/objects/"), F.when(F.regexp_count(path, F.lit("/")) > 3, "object_type").otherwise("category")).otherwise("unknown")


def container_inventory(files: DataFrame) -> DataFrame:
    """A row for each container (container, kind): how many files of each kind."""
    return files.groupBy("container").pivot("kind", ["html", "image", "other"]).agg(F.count(F.lit(1))).na.fill(0, ["html", "image", "other"])




def wiki_blocks(storage: str | None) -> tuple[bool, list[tuple[str, str]], dict[str, int]]:
    """(ok, blocks, unsupported macros) of wiki storage text; a page that can't be parsed is not an empty one."""
    raw = re.sub(r"<(/?)(\w+):", r"<\1\2_", storage or "")
    raw = re.sub(r"(\s)(\w+):(\w+=)", r"\1\2_\3", re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)\w+;", " ", raw))
    try:
        root = ET.fromstring(f"<r>{raw}</r>")
    except ET.ParseError:
        return False, [], {}
    kinds = {"p": "paragraph", "li": "list_item", "tr": "table_row", "pre": "code"}
    out, unsupported = [], {}

    def walk(e):
        for c in e:
            tag = c.tag.lower()
            if tag.endswith("_structured-macro") or tag.endswith("_macro"):
                name = c.get("ac_name", "unknown")
                unsupported[name] = unsupported.get(name, 0) + 1
                out.append(("unsupported", name))
            elif tag in kinds or re.fullmatch(r"h[1-6]", tag):
                said = " ".join("".join(c.itertext()).split())
                if said:
                    out.append((kinds.get(tag, "heading"), said))
            else:
                walk(c)

    walk(root)
    return True, out, unsupported


def parsed_wiki(pages: DataFrame) -> DataFrame:
    """(id, ok, kind, text) of wiki pages (id, storage); a page without blocks has one row with null kind."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, s in zip(pdf["id"], pdf["storage"], strict=True):
                ok, found, _ = wiki_blocks(s)
                rows += [(i, ok, *b) for b in found] or [(i, ok, None, None)]
            yield pd.DataFrame(rows, columns=["id", "ok", "kind", "text"])

    return pages.select("id", "storage").mapInPandas(run, "id long, ok boolean, kind string, text string")


def affects(text: Column) -> Column:
    """Names that a document affects: of its front matter, else of a JSON list, else of a markdown section."""
    lines = lambda block: F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_extract(x, r"^\s*[-*]\s+(\S+)", 1)), lambda x: x != "")
    front = lines(F.regexp_extract(text, r"(?s)\A---\n.*?^?affects:\s*\n(.*?)(?:\n\w|\n---)", 1))
    as_json = F.coalesce(F.from_json(F.get_json_object(text, "$.affects"), "array<string>"), F.array().cast("array<string>"))
    section = lines(F.regexp_extract(text, r"(?ims)^#+\s*affects\s*\n(.*?)(?:^#|\z)", 1))
    return F.when(F.size(front) > 0, front).when(F.size(as_json) > 0, as_json).otherwise(section)


@query("S13", r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
CAST(len(regexp_extract_all(b, '<a\s')) AS INT) AS links, CAST(len(regexp_extract_all(b, '<p[\s>]')) AS INT) AS paragraphs, nullif(regexp_extract(b, 'since (\d+(?:\.\d+)*)', 1), '') AS since, contains(lower(b), 'deprecated') AS deprecated
FROM (SELECT page_id, html, regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS b FROM pages) x""")
def _(d):
    return page_facts(d.pages)


@query("S14", """SELECT CASE event_type WHEN 'click' THEN 'method' WHEN 'view' THEN 'property' WHEN 'error' THEN 'event' WHEN 'signup' THEN 'object_type' ELSE 'category' END AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def _(d):
    t = F.col("event_type")
    path = F.when(t == "click", "a/objects/x/methods/f.html").when(t == "view", "a/objects/x/properties/f.html").when(t == "error", "a/x/events/f.html").when(t == "signup", "a/objects/b/c/d.html").otherwise("a/objects/b.html")
    return d.events.groupBy(kind_by_path(path).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("S12", """SELECT source AS container, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS html, CAST(count(*) FILTER (WHERE lang = 'de') AS BIGINT) AS image, CAST(count(*) FILTER (WHERE lang IN ('fr', 'es')) AS BIGINT) AS other FROM documents GROUP BY source""")
def _(d):
    kind = F.when(F.col("lang") == "en", "html").when(F.col("lang") == "de", "image").otherwise("other")
    return container_inventory(d.documents.select(F.col("source").alias("container"), kind.alias("kind")))


@query("S15", """SELECT o_orderkey AS id, o_orderkey % 9 <> 0 AS ok, CASE WHEN o_orderkey % 9 <> 0 THEN k END AS kind, CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN k = 'heading' THEN 'Head ' || o_orderkey ELSE t END END AS text
FROM orders, (VALUES (1, 'heading', ''), (2, 'paragraph', 'One & two'), (3, 'list_item', 'item'), (4, 'unsupported', 'toc')) AS b(i, k, t) WHERE o_orderkey % 9 <> 0 OR i = 1""")
def _(d):
    k = F.col("o_orderkey")
    storage = F.concat(F.lit("<h1>Head "), k.cast("string"), F.lit('</h1><div><p>One &amp; <b>two</b></p></div><ul><li>item</li></ul><ac:structured-macro ac:name="toc"/>'), F.when(k % 9 == 0, "<p>").otherwise(""))
    return parsed_wiki(d.orders.select(k.alias("id"), storage.alias("storage")))


@query("S18", """SELECT o_orderkey AS id, 'A' || o_orderkey || ',B' AS names FROM orders""")
def _(d):
    k = F.col("o_orderkey")
    a = F.concat(F.lit("A"), k.cast("string"))
    front = F.concat(F.lit("---\nid: 1\naffects:\n  - "), a, F.lit("\n  - B\n---\n# Affects\n- no\n"))
    section = F.concat(F.lit("# Title\n\n## Affects\n- "), a, F.lit("\n* B\n\n# Next\n- no\n"))
    as_json = F.concat(F.lit('{"affects": ["'), a, F.lit('", "B"]}'))
    text = F.when(k % 3 == 0, front).when(k % 3 == 1, section).otherwise(as_json)
    return d.orders.select(k.alias("id"), F.array_join(affects(text), ",").alias("names"))
