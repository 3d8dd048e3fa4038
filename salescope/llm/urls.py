"""URL filters by a tree of path templates per host.

Paths are split into segments. Segments made of digits, ids or dates are variable by
their form and become ``*``. Under each branch of a host, siblings with few pages, or whose
share of bad pages is statistically like that of their branch, are merged into ``*`` as
well; a sibling that clearly differs stays a template of its own. Templates get a verdict from the
purity of their labelled pages, smoothed towards their host and the whole table, so
a template with a handful of labels is not rejected for chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.sources.shared import land

# The given rules, host and path prefix with what they say.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
BLOCK, ALLOW = "block", "allow"

#: Siblings with fewer labelled pages than this are merged: they prove nothing.
LEAST_LABELS = 20
#: Standard deviations between two shares that count as a difference.
DIFFERENCE = 3.0
#: Pages that the parent's share counts as in a smoothed share.
PRIOR_PAGES = 20.0
#: Templates whose smoothed share of good pages is lower are rejected.
LEAST_PURITY = 0.5

# A segment that varies by its form: it holds a digit, or is a long string of hex digits.
VARIABLE = r"\d|^[0-9a-fA-F]{8,}(-[0-9a-fA-F]+)*$"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id with host, path, matching rule and the path's segments."""
    after = r"(?s)^.*?://"
    has = "url RLIKE '://'"
    rows = pages.selectExpr(
        "page_id",
        f"CASE WHEN {has} THEN regexp_extract(url, r'{after}([^/?#]*)', 1) ELSE '' END AS _host",
        f"CASE WHEN {has} THEN regexp_extract(url, r'{after}[^/?#]*([^?#]*)', 1) ELSE '' END AS path",
    )
    rows = rows.withColumn(
        "host",
        F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    )
    best = F.lit(None).cast("string")
    for host, path, _ in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        best = F.when(fits, F.lit(host + path)).otherwise(best)
    return rows.select("page_id", "host", "path", best.alias("rule")).withColumn(
        "_segments", F.expr("filter(split(path, '/'), s -> s != '')")
    )


def _shape() -> str:
    """The path's segments, each ``*`` if it varies by form."""
    return f"transform(_segments, s -> CASE WHEN s RLIKE r'{VARIABLE}' THEN '*' ELSE s END)"


def _merged(rows: DataFrame, depth: int) -> DataFrame:
    """Replaces the segments of one depth by ``*`` where they are merged.

    ``rows`` are counts per branch so far (``node``) and shape; a branch and its
    children are compared through their counts alone. Beyond a path's end the segment is empty.
    """
    rows = rows.withColumn("_seg", F.expr(f"coalesce(get(shape, {depth}), '')"))
    children = rows.groupBy("host", "node", "_seg").agg(
        F.sum("labelled").alias("n"), F.sum("good").alias("g")
    )
    branch = rows.groupBy("host", "node").agg(F.sum("labelled").alias("bn"), F.sum("good").alias("bg"))
    judged = (
        children.alias("c")
        .join(branch.alias("b"), ["host", "node"])
        .selectExpr(
            "host AS _host",
            "node AS _node",
            "_seg AS _s",
            # the rest of the branch is what the child is compared with
            "CASE WHEN _seg IN ('', '*') THEN _seg WHEN n < {0} OR bn - n < {0} THEN '*'"
            " WHEN abs(g / n - (bg - g) / (bn - n)) < {1} * sqrt(greatest(bg / bn * (1 - bg / bn), 1e-9D)"
            " * (1D / n + 1D / (bn - n))) THEN '*' ELSE _seg END AS _kept".format(LEAST_LABELS, DIFFERENCE),
        )
    )
    joined = rows.join(judged, F.expr("host = _host AND node = _node AND _seg = _s"))
    return joined.withColumn("node", F.expr("CASE WHEN _kept = '' THEN node ELSE node || '/' || _kept END")).drop(
        "_host", "_node", "_s", "_seg", "_kept"
    )


def templates(rows: DataFrame) -> DataFrame:
    """One row per path shape: host, its segments, template, smoothed purity, verdict.

    ``rows`` has host, shape and good (1, 0 or NULL where there is no label). The work is
    done on counts per shape, which partial aggregation makes before any row moves. The tree
    is as deep as the longest path asks: a path is done, with the rest of it merged, where
    its branch has so few labels that all below it would be.
    """
    shapes = land(
        rows.groupBy("host", "shape")
        .agg(F.count("good").alias("labelled"), F.sum(F.coalesce("good", F.lit(0))).alias("good"))
        .withColumn("node", F.lit("")),
        "url_shapes",
    )
    done, depth = [], 0
    while True:
        branch = shapes.groupBy("host", "node").agg(F.sum("labelled").alias("_n"))
        # Two siblings need labels enough each to be told apart; fewer cannot be at any depth.
        counted = land(
            shapes.join(branch, ["host", "node"]).selectExpr(
                "host", "shape", "labelled", "good", "node", f"size(shape) < {depth} OR _n < {2 * LEAST_LABELS} AS _over"
            ),
            "url_branches",
        )
        if counted.where(f"NOT _over AND size(shape) > {depth}").isEmpty():
            done.append(counted)
            break
        done.append(counted.where("_over"))
        shapes = land(_merged(counted.where("NOT _over").drop("_over"), depth), "url_tree")
        depth += 1
    ends = [
        level.withColumn("node", F.expr(f"concat(node, repeat('/*', greatest(size(shape) - {at}, 0)))")).drop("_over")
        for at, level in enumerate(done)
    ]
    shapes = land(reduce(DataFrame.unionByName, ends), "url_nodes")
    whole = shapes.groupBy().agg(F.sum("labelled").alias("wn"), F.sum("good").alias("wg"))
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("hn"), F.sum("good").alias("hg"))
    nodes = shapes.groupBy("host", "node").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g"))
    overall = whole.selectExpr("coalesce(try_divide(wg, wn), 1D) AS p").scalar()
    scored = (
        nodes.join(hosts, "host")
        .withColumn("_all", overall)
        .withColumn("_of_host", F.expr(f"(hg + {PRIOR_PAGES} * _all) / (hn + {PRIOR_PAGES})"))
        .selectExpr("host", "node", f"(g + {PRIOR_PAGES} * _of_host) / (n + {PRIOR_PAGES}) AS purity")
    )
    return (
        shapes.select("host", "node", "shape")
        .join(scored, ["host", "node"])
        .selectExpr("host", "shape", "node AS template", "purity", f"purity < {LEAST_PURITY} AS rejected")
    )


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, template, purity and verdict.

    A page's label is the quality of the row of ``labels`` with its id; pages without
    one still count through their template. The longest fitting rule decides, else the
    template. NULL urls and such without ``://`` have an empty host and path and are
    allowed unless that template is rejected. Repeated pages give repeated rows. Other
    columns, whatever their names, are ignored. A page with several labels
    counts as good if any is. Empty tables give no rows.
    """
    rows = land(
        parsed(pages).selectExpr("page_id", "host", "path", "rule", f"{_shape()} AS shape"),
        "url_pages",
    )
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    labelled = rows.join(good, rows["page_id"] == good["doc_id"], "left").select("host", "shape", "good")
    found = land(templates(labelled), "url_templates")
    said = F.lit(None).cast("string")
    for host, path, what in RULES:
        said = F.when(F.col("rule") == host + path, F.lit(what)).otherwise(said)
    return rows.join(found, ["host", "shape"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        "template",
        "purity",
        F.coalesce(said, F.when(F.col("rejected"), BLOCK).otherwise(ALLOW)).alias("verdict"),
    )
