"""URL judgement by rules and by a tree of path templates, in DataFrame operations only.

Per host, paths become templates from the first segment on: runs of digits in a segment are one sign, and a
segment that too few of its parent's pages have is ``*``; a parent's rare children are one branch from there
on. A node is known by a hash of its parent's and its segment, so no prefix is repeated. The share that a
segment needs bounds the children of a node (101 at one in a hundred). Sibling branches whose pages spread
alike over what follows them, and whose labels agree, are merged into the largest of them; what follows is
held in a sketch of 256 counts for each branch. All nodes are compared at once, a host merges at its first
level that has alike branches, and this is repeated until none are alike. A template's purity is the
share of bad pages among its labelled ones, smoothed by a few pages of even odds; an impure one is rejected.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltadoc.llm.common import spread_join, written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUPPORT, SHARE = 5, 0.01
CELLS = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path of a URL; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict, or nulls. ``rules``: (host and path, verdict), a short list."""
    name = verdict = F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        its_host, _, its_path = rule.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith("/" + its_path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path with runs of digits as ``<n>``."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"\A/", ""), "[0-9]+", "<n>"), "/")


def generalised(paths: DataFrame, *, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``paths`` (host, shape, pages and more) with ``segs``: a segment that too few pages of its node have is ``*``.

    A literal segment stays where ``support`` pages and ``share`` of its parent's pages have it; the parent is the node
    of the segments so far, rare ones as ``*``. A round for each level, down to the last one at which a node has
    ``support`` pages: below that all segments are ``*``.
    """
    total = paths.count()
    rows = paths.withColumn("segs", F.array().cast("array<string>")).withColumn("_node", F.xxhash64("host"))
    done = rows.limit(0)
    level = 0
    while True:
        level += 1
        size = rows.groupBy("_node").agg(F.sum("pages").alias("_all"), F.count("*").alias("n"))
        rows = written(spread_join(rows, size, "_node", total).drop("n"))
        ended = (F.size("shape") < level) | (F.col("_all") < support)
        rest = F.concat("segs", F.array_repeat(F.lit("*"), F.size("shape") - F.size("segs")))
        done = done.unionByName(rows.where(ended).withColumn("segs", rest).drop("_all"))
        rows = rows.where(~ended).withColumn("_seg", F.get("shape", F.lit(level - 1))).withColumn("_child", F.xxhash64("_node", "_seg"))
        children = rows.groupBy("_child").agg(((F.sum("pages") >= support) & (F.sum("pages") >= share * F.first("_all"))).alias("_literal"), F.count("*").alias("n"))
        children = written(children)
        if children.isEmpty():
            return done.drop("_node")
        rows = spread_join(rows, children, "_child", total).withColumn("_seg", F.when(F.col("_literal"), F.col("_seg")).otherwise("*"))
        rows = rows.withColumn("segs", F.concat("segs", F.array("_seg"))).withColumn("_node", F.xxhash64("_node", "_seg")).select(done.columns)


def _branches(trees: DataFrame) -> DataFrame:
    """host, level, place (a hash of what is above), seg, counts and the sketch of what follows of each branch.

    ``trees``: host, segs, pages, labelled, bad. A branch that ends at its segment goes on with nothing, a cell of its own.
    """
    chain = lambda segs, start: F.aggregate(segs, F.array(start), lambda h, s: F.concat(h, F.array(F.xxhash64(s, F.element_at(h, -1)))))
    above, below = chain(F.col("segs"), F.xxhash64("host")), F.reverse(chain(F.reverse("segs"), F.lit(0).cast("long")))
    at = F.transform("segs", lambda s, i: F.struct((i + 1).alias("level"), F.get("_above", i).alias("place"), s.alias("seg"), F.pmod(F.get("_below", i + 1), F.lit(CELLS)).cast("int").alias("cell")))
    rows = trees.withColumn("_above", above).withColumn("_below", below).select("host", "pages", "labelled", "bad", F.explode(at).alias("b")).select("host", "b.*", "pages", "labelled", "bad")
    cells = rows.groupBy("host", "level", "place", "seg", "cell").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")])
    sketch = F.collect_list(F.struct("cell", "pages"))  # as many as cells
    return cells.groupBy("host", "level", "place", "seg").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")], sketch.alias("cells"))


def _alike(x: Column, y: Column) -> Column:
    """Whether two branches' pages spread alike (chi-square over the cells, within two deviations) and their labels agree.

    Labels agree if both have none, or if their shares of bad ones are within two deviations.
    """
    na, nb = x["pages"], y["pages"]
    ra, rb = F.sqrt(nb / na), F.sqrt(na / nb)
    pairs = F.zip_with(x["dense"], y["dense"], lambda a, b: F.when(a + b > 0, (ra * a - rb * b) * (ra * a - rb * b) / (a + b)))
    chi = F.aggregate(pairs, F.struct(F.lit(0.0).alias("x"), F.lit(-1).alias("free")), lambda s, v: F.struct((s["x"] + F.coalesce(v, F.lit(0.0))).alias("x"), (s["free"] + v.isNotNull().cast("int")).alias("free")))
    l1, l2 = x["labelled"], y["labelled"]
    p, gap = (x["bad"] + y["bad"]) / (l1 + l2), F.abs(x["bad"] / l1 - y["bad"] / l2)
    agree = F.when((l1 == 0) & (l2 == 0), True).when((l1 == 0) | (l2 == 0), False).otherwise(gap <= 2 * F.sqrt(p * (1 - p) * (1 / l1 + 1 / l2)) + 1e-12)
    return agree & (chi["x"] <= chi["free"] + 2 * F.sqrt(2.0 * chi["free"]) + 1e-9)


def merged(trees: DataFrame, merge_levels: int | None = None) -> DataFrame:
    """``trees`` (host, segs, pages, labelled, bad and more) with alike siblings renamed to the largest of them.

    At a node, the largest branch takes in all that are like it, then the largest of the others does, and so on; of
    equally large ones the larger name comes first. Levels below ``merge_levels`` stay as they are.
    """
    place = ["host", "level", "place"]
    fill = F.aggregate("cells", F.array_repeat(F.lit(0).cast("long"), CELLS), lambda d, c: F.concat(F.slice(d, F.lit(1), c["cell"]), F.array(c["pages"]), F.slice(d, c["cell"] + 2, F.lit(CELLS))))
    while True:
        rows = _branches(trees).where(F.lit(True) if merge_levels is None else F.col("level") <= merge_levels)
        branches = written(rows.withColumn("dense", fill).select(*place, F.struct("pages", "seg", "labelled", "bad", "dense").alias("b")))
        x = branches.withColumnRenamed("b", "x").join(branches.withColumnRenamed("b", "y"), place)  # a node has 1 / share + 1 branches at most
        links = x.where("struct(x.pages, x.seg) > struct(y.pages, y.seg)").where(_alike(F.col("x"), F.col("y"))).select(*place, F.struct("x.pages", "x.seg").alias("hi"), F.col("y.seg").alias("lo"))
        takes = links.groupBy(*place, "hi").agg(F.collect_set("lo").alias("los")).groupBy(*place).agg(F.reverse(F.array_sort(F.collect_list(F.struct("hi", "los")))).alias("takes"))
        start = F.struct(F.array().cast("array<string>").alias("gone"), F.array().cast("array<struct<lo:string,hi:string>>").alias("to"))
        take = lambda s, t: F.when(F.array_contains(s["gone"], t["hi"]["seg"]), s).otherwise(F.struct(
            F.array_union(s["gone"], t["los"]).alias("gone"), F.concat(s["to"], F.transform(F.array_except(t["los"], s["gone"]), lambda lo: F.struct(lo.alias("lo"), t["hi"]["seg"].alias("hi")))).alias("to")
        ))
        takes = takes.withColumn("to", F.aggregate("takes", start, take)["to"]).drop("takes")
        first = takes.groupBy("host").agg(F.min("level").alias("level"))
        renames = takes.join(first, ["host", "level"]).select(F.col("place").alias("_place"), F.explode("to").alias("to")).select("_place", F.col("to.lo").alias("_lo"), F.col("to.hi").alias("_hi"))
        renames = written(renames)
        if renames.isEmpty():
            return trees
        above = F.aggregate(F.slice("segs", F.lit(1), F.col("level") - 1), F.xxhash64("host"), lambda h, s: F.xxhash64(s, h))
        rows = trees.join(first, "host", "left").withColumn("_place", F.when(F.col("level") <= F.size("segs"), above)).withColumn("_lo", F.get("segs", F.col("level") - 1))
        new = F.concat(F.slice("segs", F.lit(1), F.col("level") - 1), F.array("_hi"), F.slice("segs", F.col("level") + 1, F.size("segs")))
        rows = rows.join(renames, ["_place", "_lo"], "left").withColumn("segs", F.when(F.col("_hi").isNotNull(), new).otherwise(F.col("segs")))
        trees = written(rows.select(trees.columns))


def templates(paths: DataFrame, *, support: int = SUPPORT, share: float = SHARE, merge_levels: int | None = None) -> DataFrame:
    """host, shape and template of each row of ``paths`` (host, shape, pages, labelled, bad), with the template's counts."""
    rows = written(generalised(paths, support=support, share=share))
    trees = rows.groupBy("host", "segs").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")])
    ends = merged(written(trees.withColumn("_from", F.col("segs"))), merge_levels)
    named = ends.withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "segs")))
    sums = named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    named = written(named.select("host", "_from", "template").join(sums, ["host", "template"]).withColumn("_key", F.xxhash64("host", "_from")))
    known = rows.select("host", "shape", F.xxhash64("host", "segs").alias("_key"))
    n = known.groupBy("_key").agg(F.count("*").alias("n"))
    return spread_join(known, named.drop("host", "_from").join(n, "_key"), "_key", rows.count()).drop("_key", "n")


def judge(pages: DataFrame, *, rules=RULES, labels: DataFrame | None = None, smoothing: float = 4.0, reject: float = 0.6, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row of ``pages`` (page_id, url).

    Other columns are left out, whatever their names. Rows of equal ids are pages of their own; a null url
    has an empty host and path. A page is labelled by its rule, or by ``labels`` (page_id, bad: 0 or 1;
    the larger of several) where given. The rule's verdict holds; without a rule, a page is blocked if its
    template's smoothed share of bad pages is above ``reject``. A template without labels has 0.5 and is
    allowed. Paths of any length are judged whole.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_said", said).withColumn("shape", shape(F.col("path")))
    rows = rows.withColumn("_bad", (F.col("_said") == "block").cast("int"))
    if labels is not None:
        own = labels.where("bad in (0, 1)").groupBy("page_id").agg(F.max("bad").cast("int").alias("_own"))
        rows = rows.join(own, "page_id", "left").withColumn("_bad", F.coalesce("_own", "_bad")).drop("_own")
    rows = written(rows.withColumn("_key", F.xxhash64("host", "shape")))
    counts = rows.groupBy("_key").agg(F.first("host").alias("host"), F.first("shape").alias("shape"), F.count("*").alias("pages"), F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    counts = written(counts)
    tree = templates(counts.drop("_key"), **options)
    purity = (F.col("bad") + smoothing * 0.5) / (F.col("labelled") + smoothing)
    found = tree.select(F.xxhash64("host", "shape").alias("_key"), "template", purity.alias("purity"))
    found = written(found.join(counts.select("_key", F.col("pages").alias("n")), "_key"))
    out = spread_join(rows.drop("shape"), found, "_key", rows.count())
    verdict = F.coalesce(F.col("_said"), F.when(F.col("purity") > reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op7_urltree(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
