"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are paths of elements with
their classes. Of each node the tree counts on how many pages it stands (m), how many
blocks it has there (its presentation) and which texts those blocks hold (its content).
With entropies to the base m, presentation that varies and texts that differ from page
to page make a node important; what is the same on all pages is not:

    importance = (1 - g^v) * H(presentation) + g^v * (1 - mean H(text)),  g = 0.9, v variants.

Branches that declare themselves (navigation, footers, adverts, forms, comments) have no
importance. Where a page has an article element with text, the text is what stands in
it. The importance of a node on m pages is smoothed as if ``PRIOR_PAGES`` further pages spoke for
it, so what is the same on three pages of a small host goes outside an article, while inside one a
node has to be practically constant on some thirty pages. Equal pages of a
host count once, so copies don't make their own text look like a template.

The tree is counted in Spark; hosts are never gathered, so a host with a third of all
pages is only a larger count. Removed nodes by host are joined to the pages.

Defined cases: null html is an empty page and has empty text; pages without a host are
judged by their declarations only; repeated rows and null ids give a row each.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspect.llm.common import joined_small, map_chunks
from inkspect.llm.html import blocks
from inkspect.session import spread, staged

PRIOR_PAGES = 1.5
GAMMA = 0.9
OUTSIDE = 0.4
INSIDE = 0.05


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def _site(url: str) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """Nodes (site, path, inside, pages, importance) of a (site, html) table."""

    def run(part: pa.RecordBatch) -> dict:
        digest, paths, texts = [], [], []
        for html in part.column("html").to_pylist():
            found = [b for b in blocks(html) if not b[2]]
            paths.append([("+" if b[3] else "-") + b[0] for b in found])
            texts.append([_hash(b[1]) for b in found])
            digest.append(_hash(repr((paths[-1], texts[-1]))))
        return {"site": part.column("site"), "digest": digest, "paths": paths, "texts": texts}

    schema = {"site": "string", "digest": "bigint", "paths": "array<string>", "texts": "array<bigint>"}
    shapes = map_chunks(pages.filter("site != ''"), run, schema, "html").dropDuplicates(["site", "digest"])
    cells = staged(
        shapes.select("site", "digest", F.explode(F.arrays_zip("paths", "texts")).alias("b"))
        .groupBy("site", "digest", F.col("b.paths").alias("path"))
        .agg(F.count(F.lit(1)).alias("k"), F.collect_set("b.texts").alias("texts")),
        "style-tree",
    )
    node = ["site", "path"]
    # Presentation: in how many ways pages fill the node.
    ways = cells.groupBy(*node, "k").agg(F.count(F.lit(1)).alias("c")).groupBy(*node).agg(
        F.sum("c").alias("m"), F.count(F.lit(1)).alias("v"), F.sum(F.col("c") * F.ln("c")).alias("clc")
    )
    # Content: over how many pages each text spreads.
    texts = cells.select(*node, F.explode("texts").alias("t")).groupBy(*node, "t").agg(F.count(F.lit(1)).alias("c"))
    texts = texts.groupBy(*node).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("tlt"))
    log_m = F.ln("m")
    shape = log_m - F.col("clc") / F.col("m")
    content = F.lit(1.0) - F.col("tlt") / F.col("n") / log_m
    weight = F.pow(F.lit(GAMMA), F.col("v"))
    measured = F.when(F.col("m") > 1, (1 - weight) * shape / log_m + weight * content).otherwise(F.lit(1.0))
    importance = (F.col("m") * measured + PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES)
    out = ways.join(texts, node)
    return out.select(
        "site", F.substring("path", 2, 2**31 - 1).alias("path"), F.startswith("path", F.lit("+")).alias("inside"),
        F.col("m").alias("pages"), importance.alias("importance"),
    )


def main_text(html: str | None, removed: set[str]) -> str:
    """The blocks of the article that stand in no removed node."""
    found = [b for b in blocks(html) if not b[2]]
    inside = [b for b in found if b[3]]
    chosen = inside or found
    return "\n\n".join(text for path, text, _, content in chosen if ("+" if content else "-") + path not in removed)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of a (page_id, url, html) table."""
    rows = spread(pages.select("page_id", "url", "html").withColumn("site", _site("url")), "page_id")
    tree = style_tree(rows.select("site", "html"))
    low = F.col("importance") < F.when(F.col("inside"), INSIDE).otherwise(OUTSIDE)
    mark = F.concat(F.when(F.col("inside"), "+").otherwise("-"), "path")
    # A removed node takes its branch along: no block stands above another in a path, so paths are leaves.
    removed = tree.filter(low).groupBy("site").agg(F.collect_set(mark).alias("removed"))
    removed = staged(removed, "removed-nodes")
    size = removed.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    judged = joined_small(rows, removed, "site", "left", size)

    def run(part: pa.RecordBatch) -> dict:
        html, gone = part.column("html").to_pylist(), part.column("removed").to_pylist()
        return {
            "page_id": part.column("page_id"), "url": part.column("url"),
            "text": [main_text(h, set(g or ())) for h, g in zip(html, gone, strict=True)],
        }

    out = map_chunks(
        judged.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "removed"), run,
        {"page_id": "bigint", "url": "string", "text": "string"}, "html",
    )
    return out.withColumn("n_chars", F.length("text").cast("long"))
