"""URL filters: fixed host rules, then a path-template tree a host (operator 7).

A path's segments are generalised by their form first: runs of digits become ``<n>``, long hexadecimal
beginnings of segments ``<id>``. Pages are counted by such paths, and all that follows works on the counts. The prefixes of a host's
paths are the nodes of its tree. A branch is merged into its parent's wildcard ``*`` if it is rare (a variable segment:
under ``LEAST_PAGES`` pages) or if its labelled share of good pages doesn't differ from its parent's by more than
``Z`` standard errors; so branches under one parent that are statistically alike share a template. Every template has a
smoothed purity, its labelled good pages with ``SMOOTH`` of its host's pages added, whose purity in turn has ``SMOOTH``
of all pages added. Templates with a purity under ``LEAST_PURITY`` are blocked, others allowed.

Null urls and urls without ``://`` have an empty host and path; they share one template. Repeated urls are judged one by
one and counted as often. Labels that are null don't count; of several labels of a page the worst counts. Without any
label the purity is 1. A very long path has a node a segment (nodes are hashes of their prefix). Ties in labels give
equal purities. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import joined, table, written

#: (rule, verdict); a rule is a host, fitting its subdomains too, and the beginning of a path.
RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LEAST_PAGES, Z, SMOOTH, LEAST_PURITY = 5, 2.0, 8.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def generalised(path: Column) -> Column:
    """The path with variable parts by form: long hexadecimal segments, runs of digits."""
    ids = F.regexp_replace(path, r"/[0-9a-fA-F-]{16,}", "/<id>")
    return F.regexp_replace(ids, r"[0-9]+", "<n>")


def _nodes(templates: DataFrame) -> DataFrame:
    """(host, shape, at, key, parent, segment) for every prefix of every path; the root has at 0."""
    start = F.array(F.xxhash64("host"))
    segments = F.split(F.col("shape"), "/")
    step = lambda acc, s: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), s))
    keyed = templates.select("host", "shape", "n", "labelled", "good", segments.alias("segments")).withColumn("keys", F.aggregate("segments", start, step))
    return keyed.select("host", "shape", "n", "labelled", "good", "segments", "keys", F.posexplode("keys").alias("at", "key")).select(
        "host", "shape", "n", "labelled", "good", "at", "key", F.get("keys", F.col("at") - 1).alias("parent"), F.get("segments", F.col("at") - 1).alias("segment")
    )


def template_tree(counts: DataFrame) -> DataFrame:
    """(host, shape, template, n_shape, purity) from counts (host, shape, n, labelled, good), a row for each host and shape."""
    nodes = written(_nodes(counts), "nodes")
    sums = nodes.groupBy("host", "key").agg(F.first("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("n", "labelled", "good")])
    sums = written(sums, "sums")
    children = sums.where("parent is not null").groupBy("host", F.col("parent").alias("up")).agg(F.count("*").alias("children"))
    above = children.join(sums.select("host", F.col("key").alias("up"), F.col("labelled").alias("up_labelled"), F.col("good").alias("up_good")), ["host", "up"])
    tested = joined(sums.where("parent is not null").withColumnRenamed("parent", "up"), above, ["host", "up"], "children")
    share = F.col("up_good") / F.greatest("up_labelled", F.lit(1))
    error = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
    alike = (F.col("labelled") == 0) | (F.abs(F.col("good") / F.greatest("labelled", F.lit(1)) - share) <= Z * error)
    merged = tested.select("host", "key", ((F.col("n") < LEAST_PAGES) | alike).alias("merged"))
    uses = nodes.groupBy("host", "key").agg(F.count("*").alias("uses"))
    named = joined(nodes.where("parent is not null").select("host", "shape", "at", "key", "segment"), written(merged.join(uses, ["host", "key"]), "merged"), ["host", "key"], "uses")
    # the empty segment before the first slash stays as it is
    part = F.when(F.col("merged") & (F.col("segment") != ""), F.lit("*")).otherwise(F.col("segment"))
    named = named.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("at", part.alias("part")))).alias("parts"))  # as many as the path has segments
    named = named.select("host", "shape", F.array_join(F.transform("parts", lambda p: p["part"]), "/").alias("template"))
    placed = written(counts.join(named, ["host", "shape"]), "placed")
    sums = lambda *by: placed.groupBy(*by).agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
    every = placed.agg(F.sum("labelled").alias("all_l"), F.sum("good").alias("all_g"))
    overall = F.when(F.col("all_l") > 0, F.col("all_g") / F.col("all_l")).otherwise(F.lit(1.0))
    templates = written(sums("host", "template"), "sums")
    uses = templates.groupBy("host").agg(F.count("*").alias("uses"))
    hosts = sums("host").join(uses, "host").join(F.broadcast(every)).select("host", "uses", ((F.col("g") + SMOOTH * overall) / (F.col("l") + SMOOTH)).alias("host_purity"))
    purity = (F.col("g") + SMOOTH * F.col("host_purity")) / (F.col("l") + SMOOTH)
    shapes = placed.groupBy("host", "template").agg(F.count("*").alias("uses"))
    pure = joined(templates, written(hosts, "hosts"), ["host"], "uses").select("host", "template", purity.alias("purity")).join(shapes, ["host", "template"])
    return joined(placed.select("host", "shape", "template", F.col("n").alias("n_shape")), written(pure, "pure"), ["host", "template"], "uses")


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", key: str = "page_id", label_key: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    ``labels`` (label_key, quality): 1 is good. ``label_key``: the page's key in it; by default its ``key``.
    """
    own = F.col(key) if label_key is None else label_key
    base = pages.select(F.col(key).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), own.cast("long").alias("label_key"))
    base = base.withColumn("shape", generalised(F.col("path")))
    known = labels.where("label_key is not null and quality is not null").groupBy(F.col("label_key").cast("long").alias("label_key")).agg(F.min("quality").alias("quality"))
    counts = written(base.groupBy("host", "shape", "label_key").agg(F.count("*").alias("n")), "counts")
    keys = counts.where("label_key is not null").groupBy("label_key").agg(F.count("*").alias("uses")).join(known, "label_key", "left")
    named = joined(counts.where("label_key is not null"), written(keys, "keys"), ["label_key"], "uses")
    counts = named.unionByName(counts.where("label_key is null").withColumn("quality", F.lit(None).cast(known.schema["quality"].dataType)))
    seen = F.when(F.col("quality").isNotNull(), F.col("n")).otherwise(0)
    good = F.when(F.col("quality") == 1, F.col("n")).otherwise(0)
    counts = written(counts.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.sum(seen).alias("labelled"), F.sum(good).alias("good")), "paths")
    tree = written(template_tree(counts), "templates")
    out = joined(base, tree, ["host", "shape"], "n_shape").withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    given = F.lit(None).cast("string")
    for rule, verdict in rules:
        given = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(given)
    learned = F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(given, learned).alias("verdict"), "template", "purity")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's number in its path is the doc_id of its document, by which ``labels`` marks it."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_key"), "quality")
    pages = table(spark, sf_dir, "pages").withColumn("url_path", path(F.col("url")))
    return judged(pages, labels, label_key=F.expr("try_cast(nullif(regexp_extract(url_path, '([0-9]+)[^0-9/]*/?\\\\z', 1), '') as bigint)"))
