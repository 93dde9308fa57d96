"""URL filter: rules, and a tree of path templates for the URLs that no rule fits.

Rules (block or allow, for a host with its subdomains and a path prefix) label the URLs they fit.
The paths of each host form a tree by their segments. Segments that vary - numbers, names with
digits, or many values with few pages each - become wildcards, which turns paths into templates.
Templates that differ in one literal segment are branches of the same parent. Branches with the
same majority (blocked, allowed or unlabelled pages) whose label rates can't be told apart from
those of all such branches together are merged. A
template is rejected if the smoothed share of blocked pages among its labelled ones is high.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import held

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (block or allow) for a host and its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


@dataclass(frozen=True)
class TreeSettings:
    """``distinct``, ``support``: a parent with so many different segments, of fewer pages each on average, has a wildcard.
    ``levels``: segments beyond these are one wildcard together. ``alpha``: chance of telling similar branches apart.
    ``prior``: pages of either label that each template is taken to have besides its own. ``reject``: from this share on."""

    distinct: int = 12
    support: float = 3.0
    levels: int = 8
    alpha: float = 0.05
    prior: float = 1.0
    reject: float = 0.9


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case (A-Z); empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; null if none does. Of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text())):
        name = F.when(rule.fits(), F.lit(rule.text())).otherwise(name)
        verdict = F.when(rule.fits(), F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def templates(paths: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``paths`` (host, path, n and more, each host and path once) with ``template`` and ``branch``, the template of its parent's branches.

    One step for each level of the tree: the segments below each node are counted, and nodes with
    varying segments pass them on as ``*``. An ending after a dot stays. The nodes of a level are few
    and written, so the plan grows by one join a level. Segments are counted per node before they are
    shuffled, so a host with very many paths is no hot group.
    """
    rows = paths.withColumns({
        "segments": F.filter(F.split("path", "/"), lambda s: s != ""),
        "template": F.lit(""), "branch": F.lit(""),
    })
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, min(deepest, settings.levels) + 1):
        segment = F.get(F.col("segments"), F.lit(level - 1))
        rows = rows.withColumn("segment", segment)
        ending = F.regexp_extract("segment", r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.regexp_replace("segment", r"\.[A-Za-z]{1,5}$", "")
        children = rows.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(F.sum("n").alias("pages"))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("pages").alias("pages"))
        wide = nodes.where((F.col("kinds") >= settings.distinct) & (F.col("pages") < settings.support * F.col("kinds"))).select("host", "template", F.lit(True).alias("wide"))
        # Written, or each level would compute all levels above it twice.
        rows = rows.join(held(wide), ["host", "template"], "left")
        varies = F.col("wide").isNotNull() | stem.rlike("[0-9]") | (F.length("segment") > 40)
        part = F.when(F.col("segment").isNull(), "").when(varies, F.concat(F.lit("/*"), ending)).otherwise(F.concat(F.lit("/"), F.col("segment")))
        # The branch has a wildcard for the last literal segment so far, and what comes after it.
        literal = F.col("segment").isNotNull() & ~varies
        branch = F.when(literal, F.concat(F.col("template"), F.lit("/*"))).otherwise(F.concat(F.col("branch"), part))
        rows = rows.withColumns({"branch": branch, "template": F.concat(F.col("template"), part)}).drop("wide", "segment")
    tail = F.when(F.size("segments") > settings.levels, "/**").otherwise("")
    end = F.concat(tail, F.when(F.col("path").rlike("./$"), "/").otherwise(""))
    return rows.withColumns({"template": F.concat(F.col("template"), end), "branch": F.concat(F.col("branch"), end)}).drop("segments")


def judged_templates(paths: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``host``, ``template``, ``merged``, ``purity``, ``rejected`` from templates with page counts n, blocked and allowed."""
    counts = {c: F.sum(c).alias(c) for c in ("n", "blocked", "allowed")}
    side = F.when(2 * F.col("blocked") > F.col("n"), "block").when(2 * F.col("allowed") > F.col("n"), "allow").otherwise("")
    leaves = held(paths.groupBy("host", "branch", "template").agg(*counts.values()).withColumn("side", side))
    pooled = leaves.groupBy("host", "branch", "side").agg(*[F.sum(c).alias(f"all_{c}") for c in counts])
    rows = leaves.join(pooled, ["host", "branch", "side"])
    # Hoeffding: two rates, each of its own number of pages, differ by less than this by chance.
    bound = (log(2 / settings.alpha) / 2) ** 0.5 * (1 / F.sqrt("n") + 1 / F.sqrt("all_n"))
    alike = lambda c: F.abs(F.col(c) / F.col("n") - F.col(f"all_{c}") / F.col("all_n")) <= bound
    similar = alike("blocked") & alike("allowed")
    rows = rows.select("host", "template", F.when(similar, F.col("branch")).otherwise(F.col("template")).alias("merged"),
                       F.when(similar, F.col("side")).otherwise(F.col("template")).alias("side"), *counts)
    together = rows.groupBy("host", "merged", "side").agg(*counts.values())
    purity = (F.col("blocked") + settings.prior) / (F.col("blocked") + F.col("allowed") + 2 * settings.prior)
    judged = together.select("host", "merged", "side", purity.alias("purity"), (purity >= settings.reject).alias("rejected"))
    return rows.select("host", "template", "merged", "side").join(judged, ["host", "merged", "side"]).drop("side")


def judge(pages: DataFrame, rules: list[Rule], settings: TreeSettings = TreeSettings(), url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` of each row of ``pages``.

    A rule that fits decides; else the page's template does (block if it is rejected). A null url,
    or one without ``://``, has an empty host and path, whose template is empty too. Equal paths of
    a host are counted together before anything else, so copies cost nothing; no host's pages are
    gathered. Paths of any length and depth are read whole; those that differ only below
    ``levels`` segments share a template. Of rules that fit equally long the first one counts. Repeated rows and null ids are kept, other columns ignored; an empty table gives no rows.
    """
    name, verdict = rule_of(rules)
    rows = pages.select("page_id", host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({"rule": name, "given": verdict})
    label = lambda v: F.sum(F.when(F.col("given") == v, 1).otherwise(0))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), label("block").alias("blocked"), label("allow").alias("allowed"))
    placed = held(templates(held(paths), settings))
    verdicts = placed.select("host", "path", "template").join(judged_templates(placed, settings), ["host", "template"])
    found = rows.join(verdicts, ["host", "path"])
    by_tree = F.when(F.col("rejected"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("given", by_tree).alias("verdict"), F.col("merged").alias("template"), "purity")
