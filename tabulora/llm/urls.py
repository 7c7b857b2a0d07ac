"""URL filters: rules for hosts and paths, and a tree of path templates for the rest.

Segments of a path that look like numbers or keys are generalised by their form at once; urls of one host and form are
then one row with counts, so the tree works on forms rather than on pages. Level by level, the children of each node of
a host are looked at: where there are many for their urls, they are variable and become one wildcard; else children
whose labelled share of bad pages does not differ from their siblings' are merged into the wildcard, and only those
that differ keep their name. This goes on until no url shares its node with others; what is left of such a url has no
siblings at any level, so it stays as it is. A template is rejected if its smoothed share of bad labelled pages is at least REJECT.

Counts are combined before each shuffle, so a host with a third of all pages is a few rows. The verdicts join the pages
as a table of their own, which Spark may broadcast by its size or split.

Defined results: null url or one without `://`: empty host and path, no rule, the verdict of the template of nothing;
a host without labels: the share of all labelled pages; repeated rows: counted and judged each; null page_id: judged, without a label.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import Work

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels that SQL spells out, enough for the given tables (the code has no such bound); children from which, and their
#: share of urls at which, a node's children are variable.
DEPTH, MANY, VARIED = 4, 20, 0.2
#: Standard deviations and labelled pages for a branch to differ; weight of the overall share; share that rejects.
DIFFERS, LABELLED, WEIGHT, REJECT = 2.6, 8, 10.0, 0.5

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def host_and_path(url):
    """The two parts of a url column, empty where there is no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def match_rule(host, path, rules):
    """The longest rule that fits, or null; a rule fits its host and all subdomains where the path starts with its own."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        out = F.when(((host == own) | host.endswith("." + own)) & path.startswith(start), F.lit(rule)).otherwise(out)
    return out


def form(path):
    """A path with segments that look variable as {n} (numbers, with an ending), {x} (keys of 8 or more) ."""
    p = F.regexp_replace(path, r"(?<=/)[0-9]+(?=(\.[A-Za-z]{1,5})?(/|$))", "{n}")
    return F.regexp_replace(p, r"(?<=/)(?=[^/]*[0-9])[0-9A-Fa-f-]{8,}(?=(\.[A-Za-z]{1,5})?(/|$))", "{x}")


def _level(t: DataFrame, d: int) -> DataFrame:
    """Replaces segment d of the templates by a wildcard where that is called for."""
    seg = F.coalesce(F.get("segs", F.lit(d)), F.lit(""))
    t = t.withColumn("seg", seg)
    keys = ["host", "prefix"]
    child = t.groupBy(*keys, "seg").agg(F.sum("n").alias("cn"), F.sum("lab").alias("cl"), F.sum("bad").alias("cb"))
    node = child.groupBy(*keys).agg(F.sum("cn").alias("nn"), F.sum("cl").alias("nl"), F.sum("cb").alias("nb"), F.count("*").alias("kids"))
    both = child.join(node, keys)
    rest_l, rest_b = F.col("nl") - F.col("cl"), F.col("nb") - F.col("cb")
    pooled = F.col("nb") / F.greatest(F.col("nl"), F.lit(1))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("cl"), F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
    gap = F.abs(F.col("cb") / F.greatest(F.col("cl"), F.lit(1)) - rest_b / F.greatest(rest_l, F.lit(1)))
    differs = (F.col("cl") >= LABELLED) & (rest_l >= LABELLED) & (gap > DIFFERS * spread)
    varied = (F.col("kids") >= MANY) & (F.col("kids") >= VARIED * F.col("nn"))
    name = F.when(F.col("seg") == "", F.lit("")).when((F.col("kids") > 1) & (varied | ~differs), F.lit("*")).otherwise(F.col("seg"))
    named = both.select(*keys, "seg", name.alias("name"))
    return t.join(named, [*keys, "seg"]).withColumn("prefix", F.concat("prefix", F.when(F.size("segs") > d, F.concat(F.lit("/"), F.col("name"))).otherwise(F.lit("")))).drop("seg", "name")


def _alone(t: DataFrame, d: int) -> DataFrame:
    """Marks the forms for which no level from d on can differ from their own segments: those that have ended before it,
    and those that are the only one of their node."""
    node = t.groupBy("host", "prefix").agg(F.count("*").alias("forms"))
    return t.join(node, ["host", "prefix"]).withColumn("alone", (F.col("forms") == 1) | (F.size("segs") < d)).drop("forms")


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, form, template, purity for each form of pages (id, host, form); labels hold (id, bad 0/1)."""
    marks = labels.groupBy("id").agg(F.max("bad").alias("bad"))
    counted = pages.join(marks, "id", "left").groupBy("host", "form")
    t = counted.agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    t = t.withColumn("segs", F.slice(F.split("form", "/"), 2, 1 << 20)).withColumn("prefix", F.lit(""))
    # each level reads the last one twice, so it is written: the plan would double with each level
    work = Work(pages.sparkSession, "urls")
    t, d, ended = work.write(_alone(t, 0), "forms"), 0, []
    while True:
        rest = F.slice("segs", d + 1, 1 << 20)
        whole = F.concat("prefix", F.when(F.size("segs") > d, F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise(F.lit("")))
        ended.append(t.where("alone").select("host", "form", "lab", "bad", whole.alias("template")))
        t = t.where("not alone").drop("alone")
        if t.isEmpty():
            break
        t, d = work.write(_alone(_level(t, d), d + 1), f"level{d}"), d + 1
        if d % 16 == 0:
            # a long union would be planned anew at each level
            ended = [work.write(functools.reduce(DataFrame.unionByName, ended), f"ended{d}")]
    t = functools.reduce(DataFrame.unionByName, ended)
    per = t.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    total = per.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("lab"), F.lit(0)), F.lit(1))).alias("share"))
    # one row
    per = per.crossJoin(F.broadcast(total)).select("host", "template", ((F.col("bad") + WEIGHT * F.col("share")) / (F.col("lab") + WEIGHT)).alias("purity"))
    return t.select("host", "form", "template").join(per, ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict, template. labels: (id, bad)."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).withColumn("form", form(F.col("path")))
    tree = templates(rows, labels)
    rule = match_rule(F.col("host"), F.col("path"), rules)
    of = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.create_map(F.lit(""), F.lit(""))
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    out = rows.join(tree, ["host", "form"]).withColumn("rule", rule)
    return out.select("id", "host", "path", "rule", F.coalesce(F.try_element_at(of, "rule"), method).alias("verdict"), "template")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    return judge(pages, labels).withColumnRenamed("id", "page_id")
