"""URL filters: fixed rules, and path templates learned per host and judged by the labels of their pages."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import landed

ANY = "*"
# A branch of up to so many segments is named by all of them.
SPELLED = 50


@dataclass(frozen=True)
class Tree:
    """Parameters of the template tree.

    A segment is a branch if it holds at least ``min_pages`` of its parent's pages and ``min_labels`` labelled ones,
    however large the parent; all other segments become a wildcard.  Branches whose bad shares are within ``z``
    standard errors of those of their group, taken together and of its least, are merged.
    ``prior`` is how many pages the parent's rate counts for.
    A template is blocked where its smoothed purity, the share of good pages, is below ``min_purity``.
    """

    min_pages: int = 5
    min_labels: int = 5
    z: float = 1.96
    prior: float = 4.0
    min_purity: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lowered, and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule is host and path in one text, the path from its first slash on.  It fits the host and its
    subdomains, if the url's path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A variable segment by its form: numbers, long hexadecimal ids and dates lose their value, endings stay."""
    ids = F.regexp_replace(segment, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]{4,})*\b", "{id}")
    return F.regexp_replace(ids, r"[0-9]+", "{n}")


def wildcard(segment: Column) -> Column:
    form = shape(segment)
    return F.when(form == segment, ANY).otherwise(form)


def rate(bad: Column, labelled: Column, before: Column, prior: float) -> Column:
    return (bad + before * prior) / (labelled + prior)


def alike(bad: int, labelled: int, other_bad: int, other_labelled: int, z: float) -> bool:
    """Whether two bad shares are within ``z`` standard errors of each other."""
    pooled = (bad + other_bad) / (labelled + other_labelled)
    error = math.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / other_labelled))
    return abs(bad / labelled - other_bad / other_labelled) <= z * error


def grouped(cells: DataFrame, z: float) -> DataFrame:
    """``group`` of each cell (host, template, bad, labelled, k children), numbered per parent in order of bad share.

    A cell joins the group before it if a child of it is like the group's least child and like all its children
    together; so a group cannot drift along a chain of neighbours.  The scan keeps four counts, whatever the group holds.
    """
    key = StructType([cells.schema[n] for n in ("host", "template")])
    schema = StructType(key.fields + StructType.fromDDL("bad long, labelled long, group long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, group = None, 0
        least = pooled = (0, 1)
        for batch in batches:
            numbers = []
            for host, template, bad, labelled, k in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if parent != (host, template):
                    parent, group, least, pooled = (host, template), 0, (bad, labelled), (0, 0)
                elif not (alike(bad, labelled, *least, z) and alike(bad, labelled, *pooled, z)):
                    group, least, pooled = group + 1, (bad, labelled), (0, 0)
                pooled = (pooled[0] + bad * k, pooled[1] + labelled * k)
                numbers.append(group)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(numbers, pa.int64())], schema.names)

    # Of equal shares the one with most labels first: it is the strictest least child.
    parents = cells.select("host", "template", "bad", "labelled", "k").repartition("host", "template")
    return parents.sortWithinPartitions("host", "template", F.col("bad") / F.col("labelled"), F.desc("labelled")).mapInArrow(run, schema)


def merged(children: DataFrame, z: float) -> DataFrame:
    """``branch`` of each child: its own segment, or all those it is merged with.

    Children with the same counts are one cell, so what is ordered per parent are distinct pairs of counts: of a
    parent with L labels at most about L to the power 2/3, however many children it has.  A branch
    of more than ``SPELLED`` children is named by the least of them and the number of others.
    """
    counts = ["host", "template", "bad", "labelled"]
    groups = grouped(children.groupBy(*counts).agg(F.count("*").alias("k")), z)
    numbered = landed(children.join(groups.hint("rebalance"), counts).select("host", "template", "segment", "group"), "groups")
    key = ["host", "template", "group"]
    sizes = numbered.groupBy(*key).agg(F.count("*").alias("k"), F.min("segment").alias("least"))
    sized = numbered.join(sizes.hint("rebalance"), key)
    names = sized.where(F.col("k").between(2, SPELLED)).groupBy(*key).agg(F.sort_array(F.collect_list("segment")).alias("names"))
    spelled = F.concat(F.lit("("), F.array_join("names", "|"), F.lit(")"))
    short = F.concat(F.lit("("), F.col("least"), F.lit("|+"), F.col("k") - 1, F.lit(")"))
    branch = F.when(F.col("k") == 1, F.col("segment")).when(F.col("names").isNotNull(), spelled).otherwise(short)
    return sized.join(names.hint("rebalance"), key, "left").select("host", "template", "segment", branch.alias("branch"))


def with_templates(pages: DataFrame, tree: Tree) -> DataFrame:
    """``pages`` (page_id, host, path, bad ...) with ``template``, grown one level at a time.

    Each level counts the children of every template so far, which pre-aggregates the pages of a
    hot host in every task, and keeps as branches those with enough pages and labels.  Pages are joined to
    branches alone; every other page takes the wildcard with its segment's form.  Pages whose path has ended
    leave.  Longer paths only split what a template holds, so once none has enough pages and labels left for a branch,
    none ever splits again, and the rest of every path goes by its form at once.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    now = landed(pages.withColumn("segments", segments).withColumn("template", F.lit("")), "pages")
    done = []
    level = 0
    while True:
        done.append(now.where(F.size("segments") <= level))
        here = now.where(F.size("segments") > level).withColumn("segment", F.get("segments", F.lit(level)))
        children = here.groupBy("host", "template", "segment").agg(
            F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        children = landed(children, "children")
        parents = children.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"))
        enough = (F.col("n") >= tree.min_pages) & (F.col("labelled") >= max(tree.min_labels, 1))
        if parents.where(enough).isEmpty():
            break
        branches = merged(children.where(enough), tree.z)
        joined = here.join(branches.hint("rebalance"), ["host", "template", "segment"], "left")
        grown = F.concat_ws("/", "template", F.coalesce("branch", wildcard(F.col("segment"))))
        now = landed(joined.withColumn("template", grown).select(now.columns), "pages")
        level += 1
    rest = F.transform(F.slice("segments", level + 1, 1_000_000_000), wildcard)
    done.append(now.where(F.size("segments") > level).withColumn("template", F.concat_ws("/", "template", F.array_join(rest, "/"))))
    return reduce(DataFrame.unionByName, done).drop("segments")


def judged(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]], tree: Tree = Tree(),
    page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template and its smoothed purity.

    ``labelled`` has ``page_id`` and ``bad`` (0 or 1, null for unknown); a page with several labels counts as bad as the
    worst.  A rule's verdict stands; else a template is blocked for its purity, smoothed towards that of its host,
    which is smoothed towards all.  Null and broken urls are pages of the empty host.  Without labels nothing is blocked but by
    rule.  Repeated rows stay; other columns are left out.
    """
    host, path = split_url(F.col(url))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    known = labelled.groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").cast("long").alias("bad"))
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    marked = base.join(known.hint("rebalance"), base["page_id"] == F.col("_id"), "left").drop("_id")
    grown = with_templates(marked, tree)
    counts = landed(grown.groupBy("host", "template").agg(
        F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "templates")
    total = counts.agg(F.sum("bad"), F.sum("labelled")).first()
    overall = F.lit((total[0] or 0) / (total[1] or 1))
    hosts = counts.groupBy("host").agg(rate(F.sum("bad"), F.sum("labelled"), overall, tree.prior).alias("host_rate"))
    rates = counts.join(hosts.hint("rebalance"), "host").select(
        "host", "template", (1 - rate(F.col("bad"), F.col("labelled"), F.col("host_rate"), tree.prior)).alias("purity"))
    final = grown.drop("bad").join(rates.hint("rebalance"), ["host", "template"])
    learned = F.when(F.col("purity") < tree.min_purity, "block").otherwise("allow")
    return final.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, learned).alias("verdict"),
        "template", "purity")
