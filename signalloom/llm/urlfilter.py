"""URL filters: longest matching rule, then a path-template tree.

For every host the masked path segments form a tree.  A segment with digits is masked at
once; on each level a child whose labelled purity does not differ from its siblings'
(two-proportion z score) is merged into the wildcard branch, at any number of children.
The z score is smoothed towards the share of all siblings, so a child without labels is
like them; beyond ``children`` siblings it is plain, since a child with a label or two
among very many would stand out by chance.  Levels beyond
``depth`` are grown one by one below the nodes that have labels and more than one path;
the rest of a lone path keeps its names, without labels it is one wildcard.  A template is rejected when its
labelled purity, smoothed towards its host's and that towards the overall one, reaches
``reject``; a host without labels has only the overall share and is not rejected by it.
Pages are reduced to counts per host and masked path before anything is
shuffled, so a host with a third of all pages is one small group.

Cases: null urls and urls without ``://`` have an empty host and path and are judged
like the template of that name; without labels every smoothed purity is the prior;
repeated rows are each returned and each counted; of rules that fit alike the longest wins,
of equally long ones the last by name; a child at exactly the limit of significance keeps
its branch; extra columns are ignored, whatever their names, but for what ``labelled`` reads;
urls and pages of any length are handled as whole strings; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TemplateConfig:
    depth: int = 3
    children: int = 20
    z: float = 1.96
    strength: float = 4.0
    prior: float = 0.1
    reject: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.expr(f"substring(__url, instr(__url, '://') + 3)")
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        name, _, tail = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return rule, verdict


def visible_words(html: Column) -> Column:
    """Words of a page's article, or of the whole page where it has none, without markup."""
    article = F.regexp_extract(html, "(?s)<article[^>]*>(.*?)</article>", 1)
    return F.regexp_count(F.regexp_replace(F.when(article != "", article).otherwise(html), "<[^>]*>", " "), F.lit("[^\\x20\\x09-\\x0D]+"))


def segments(path: Column, depth: int) -> Column:
    """All masked segments, filled up with empty ones to ``depth``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "/+$", ""), "/")
    masked = F.transform(parts, lambda s: F.regexp_replace(s, r"[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*", "*"))
    return F.concat(masked, F.array_repeat(F.lit(""), F.greatest(F.lit(depth) - F.size(masked), F.lit(0))))


def grow(tree: DataFrame, level: int, c: TemplateConfig) -> DataFrame:
    """``tree`` with the branch of one more level appended to ``t``."""
    tree = tree.withColumn("part", F.coalesce(F.get("s", F.lit(level - 1)), F.lit("")))
    branch = tree.groupBy("host", "t", "part").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    node = branch.groupBy("host", "t").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    both = branch.join(node, ["host", "t"])
    rest_n, rest_bad = F.col("all_n") - F.col("n"), F.col("all_bad") - F.col("bad")
    share = (F.col("all_bad") + 1) / (F.col("all_n") + 2)
    gap = (F.col("bad") + share) / (F.col("n") + 1) - (rest_bad + share) / (rest_n + 1)
    smoothed = F.abs(gap) / F.sqrt(share * (1 - share) * (1 / (F.col("n") + 1) + 1 / (rest_n + 1)))
    bare = F.try_divide(F.col("all_bad"), F.col("all_n"))
    apart = F.abs(F.try_divide(F.col("bad"), F.col("n")) - F.try_divide(rest_bad, rest_n))
    plain = F.coalesce(F.try_divide(apart, F.sqrt(bare * (1 - bare) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), rest_n)))), F.lit(0.0))
    z = F.when(F.col("m") > c.children, plain).otherwise(smoothed)
    name = both.select("host", "t", "part", F.when((F.col("m") > 1) & (z < c.z), "*").otherwise(F.col("part")).alias("name"))
    return tree.join(name, ["host", "t", "part"]).select("host", "s", "n", "bad", F.concat("t", F.array("name")).alias("t"))


def grow_deeper(ws: Workspace, tree: DataFrame, c: TemplateConfig) -> DataFrame:
    """The levels beyond ``depth``, each over the nodes that can still divide."""
    level, done = c.depth + 1, None
    while True:
        node = tree.groupBy("host", "t").agg(F.count("*").alias("paths"), F.sum("n").alias("all_n"), F.max(F.size("s")).alias("deepest"))
        more = F.col("deepest") >= level
        marked = ws.save(tree.join(node, ["host", "t"]).withColumn("open", more & (F.col("paths") > 1) & (F.col("all_n") > 0)))
        rest = F.when(more & (F.col("paths") > 1), F.array(F.lit("*"))).otherwise(F.slice("s", level, F.greatest(F.size("s") - level + 1, F.lit(0))))
        ended = marked.where("not open").select("host", "s", "n", "bad", F.concat("t", rest).alias("t"))
        done = ended if done is None else done.unionByName(ended)
        tree = marked.where("open").select("host", "s", "n", "bad", "t")
        if tree.isEmpty():
            return done
        tree, level = ws.save(grow(tree, level, c)), level + 1


def judge_urls(pages: DataFrame, rules: dict[str, str], labelled: Column, id_col: str = "page_id", url_col: str = "url", config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for each page.

    ``labelled`` is a column over ``host``, ``path``, ``rule_verdict`` and the columns of the
    page in the struct ``page``: 1 for a bad example, 0 for a good one, null for none.
    """
    c = config
    ws = Workspace(pages.sparkSession, "urls")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"), F.struct(*(F.col(x) for x in pages.columns)).alias("page"))
    host, path = host_and_path(F.col("__url"))
    urls = urls.select("page_id", "page", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "rule_verdict": verdict})
    urls = urls.withColumn("bad", labelled.cast("int")).withColumn("s", segments(F.col("path"), c.depth)).select("page_id", "host", "path", "rule", "rule_verdict", "bad", "s")
    tree = ws.save(urls.groupBy("host", "s").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    overall = tree.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + c.prior * c.strength) / (F.coalesce(F.sum("n"), F.lit(0)) + c.strength)).alias("top"))
    grown = tree.withColumn("t", F.array().cast("array<string>"))
    for level in range(1, c.depth + 1):
        grown = ws.save(grow(grown, level, c))
    if not grown.where(F.size("s") > c.depth).isEmpty():
        grown = ws.save(grow_deeper(ws, grown, c))
    shape = ["host", "t"]
    hosts = grown.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    leaf = grown.groupBy(*shape).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(hosts, "host").crossJoin(overall)  # overall: one row
    host_purity = (F.col("host_bad") + c.strength * F.col("top")) / (F.col("host_n") + c.strength)
    leaf = leaf.select(*shape, ((F.col("bad") + c.strength * host_purity) / (F.col("n") + c.strength)).alias("purity"), "host_n")
    deeper = F.filter(F.slice("t", c.depth + 1, F.size("t")), lambda x: x != "")
    template = F.concat_ws("/", "host", F.slice("t", 1, c.depth), deeper).alias("template")
    named = ws.save(grown.select("host", "s", "t").join(leaf, shape).select("host", "s", template, "purity", "host_n"))
    out = urls.join(named, ["host", "s"])
    method = F.when((F.col("purity") >= c.reject) & (F.col("host_n") > 0), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
