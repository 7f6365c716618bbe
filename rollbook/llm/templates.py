"""URL filter by rules and a tree of path templates.

Urls that a rule decides are the labelled ones. For every host, paths form a tree of segments: numbers inside a segment
become ``#``, and at each node the children are compared. Where a node has many different children for its urls, they
are variable and become one wildcard; a child that the node visits often stays. Of the children that stay, those whose share of
blocked urls does not differ from their siblings' (two proportions, ``Z`` standard errors) are merged into the
wildcard as well. This goes level by level: below a decided level, nodes are told apart by the template so far, so what
lies below a wildcard is counted together. A template is what is left of a path. Its purity, the share of blocked urls among its labelled ones,
is smoothed towards its host's, which is smoothed towards the domain's, the top domain's and the corpus'. Templates with
a purity of at least ``BLOCKED`` are rejected.

Everything is counted over (host, path shape) groups, which each task sums before the exchange; joins are plain joins
that Spark can split where a host is hot. There is one round per level of the deepest path whose node can still have an
own branch; nodes with few labelled urls, or with labels of one kind, can't, and end at once. Rules are a short list given
with the call.

Defined results: a url that is null or has no ``://`` has an empty host and path, which no rule fits; such urls form a
host like any other. Repeated rows stay repeated. Without labels the purity is one half short of nothing: the verdict is
allow. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keep, new_folder

MANY_CHILDREN, SPREAD, OFTEN = 8, 0.2, 0.02  # children of a variable node; per url; share of a child that stays
LEAST_LABELLED, Z = 5, 2.58
STRENGTH = 10.0  # labelled urls that a parent's purity counts for
BLOCKED = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) that fits, as struct<rule, verdict>; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def open_nodes(child: DataFrame) -> DataFrame:
    """Totals of the nodes that may have an own branch, at this level or below: two sides with labels, and labels of both kinds."""
    node = child.groupBy("node").agg(
        F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
    )
    return node.where((F.col("all_labelled") >= 2 * LEAST_LABELLED) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled")))


def own_branches(child: DataFrame, node: DataFrame) -> DataFrame:
    """(node, token) of the children that keep a branch of their own."""
    both = child.join(node, "node")
    variable = (F.col("children") >= MANY_CHILDREN) & (F.col("children") >= SPREAD * F.col("all_n")) & (F.col("n") < OFTEN * F.col("all_n"))
    rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    pooled = F.col("all_bad") / F.col("all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
    gap = F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest)
    unlike = F.when((F.col("labelled") >= LEAST_LABELLED) & (rest >= LEAST_LABELLED), (error > 0) & (gap >= Z * error)).otherwise(False)
    return both.where(~variable & unlike).select("node", "token")


def with_templates(leaves: DataFrame) -> DataFrame:
    """The leaves (host, shape and their counts) with a template each, one level of the tree per round."""
    folder, at = new_folder(leaves.sparkSession, "paths"), 0
    going = leaves.select("*", F.xxhash64("host").alias("node"), F.lit("").alias("template"))
    while True:
        going = going.withColumn("token", F.get(F.split("shape", "/"), F.lit(at)))
        child = keep(counted(going, "node", "token"), "children")
        node = keep(open_nodes(child), "nodes")
        branches = keep(own_branches(child, node).withColumn("own", F.lit(True)), "branches")
        both = going.join(node.select("node", F.lit(True).alias("open")), "node", "left").join(branches, ["node", "token"], "left")
        part, left = F.when(F.col("own"), F.col("token")), F.size(F.split("shape", "/")) - at
        level = both.select(
            *leaves.columns,
            F.xxhash64("node", part).alias("node"),  # a wildcard is a null here, so a segment that is a star stays apart
            F.when(F.col("open"), F.concat("template", F.lit("/"), F.coalesce(part, F.lit("*")))).otherwise(F.concat("template", F.repeat(F.lit("/*"), left))).alias("template"),
            (F.col("open").isNull() | (left == 1)).alias("done"),
        )
        level.write.parquet(f"{folder}/at={at}")
        levels = leaves.sparkSession.read.schema(level.schema)
        going = levels.parquet(f"{folder}/at={at}").where("NOT done").drop("done")
        if going.isEmpty():
            return levels.parquet(folder).where("done").select(*leaves.columns, "template")
        at += 1


def smoothed(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + STRENGTH * prior) / (labelled + STRENGTH)


def template_purity(urls: DataFrame) -> DataFrame:
    """host, shape, template and purity of every path shape. urls: host, path, bad (1, 0 or null where not labelled)."""
    shape = F.regexp_replace(F.regexp_replace("path", "^/", ""), "[0-9]+", "#").alias("shape")
    rows = urls.select("host", shape, F.lit(1).alias("n"), F.col("bad").isNotNull().cast("int").alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    leaves = keep(counted(rows, "host", "shape"), "leaves")

    labels = F.split("host", "[.]")
    places = {"domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), "top": F.element_at(labels, -1)}
    known = keep(with_templates(leaves).withColumns(places), "known")
    levels = [["top"], ["top", "domain"], ["top", "domain", "host"], ["top", "domain", "host", "template"]]
    whole = known.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = ((whole["bad"] or 0) + 0.5) / ((whole["labelled"] or 0) + 2)
    above = None
    for keys in levels:
        level = counted(known, *keys)
        if above is None:
            level = level.withColumn("parent", F.lit(prior))
        else:
            level = level.join(above, keys[:-1])
        above = keep(level.select(*keys, smoothed(F.col("bad"), F.col("labelled"), F.col("parent")).alias("parent")), "purity")
    return known.join(above, levels[-1]).select("host", "shape", "template", F.col("parent").alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("found"))
    rows = keep(rows.select("page_id", "host", "path", "found.rule", "found.verdict"), "urls")
    bad = F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("int")).alias("bad")
    known = keep(template_purity(rows.select("host", "path", bad)), "templates")
    shaped = rows.withColumn("shape", F.regexp_replace(F.regexp_replace("path", "^/", ""), "[0-9]+", "#"))
    method = F.when(F.col("purity") >= BLOCKED, "block").otherwise("allow")
    return shaped.join(known, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "template", "purity"
    )
