"""Verdicts on web addresses by rules, and where no rule fits by a tree of path templates.

Every host has a tree: its levels are the segments of paths.  From the root down, segments
that vary are replaced by wildcards, and branches below one node that look alike become
one.  A template is a way from the root to the end of a path.  The addresses that a rule
decides are its labels; where too few of them are allowed, addresses of the template that
no rule decides are blocked.

The trees are tables of counts, aggregated by host and path before anything else: no task
gets the pages of a host, and no step but the first and the last sees single pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DEPTH = 8  # levels of a tree; what follows is one segment, a wildcard
MANY = 16  # children of a node, above which a rare one is a variable
SURE = 3.0  # standard deviations from what its siblings have, above which a branch is another
PURITY = 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STATS = ("n", "labelled", "blocked")


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, host, path``: what stands after ``://`` up to ``/``, ``?`` or ``#``, and from there up to ``?`` or ``#``.

    A-Z of the host is lower-cased.  Both are empty without an address or ``://`` in it.
    """
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return pages.select(
        "page_id",
        F.translate(host, _UPPER, _UPPER.lower()).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def longest_rule(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """Struct ``size, rule, verdict`` of the longest rule that fits, or null.

    A rule is a verdict and a host with the start of a path; it fits the host and all its
    subdomains.  For a list of some hundred rules: each is a condition on every row.
    """
    found = []
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        own = (F.col(host) == name) | F.col(host).endswith(f".{name}")
        fits = own & F.col(path).startswith(slash + start)
        entry = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found.append(F.when(fits, entry))
    return F.array_max(F.array(*found))


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The segments of a path; one with a digit is a wildcard, which keeps its file ending.

    A slash at the end makes none.  Beyond ``depth`` all further ones are a single one.
    """
    parts = F.filter(F.split(F.regexp_replace(path, r"^/|/\z", ""), "/"), lambda part: part != "")
    parts = F.transform(parts, lambda part: F.when(part.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(part, r"\.[A-Za-z]{1,5}\z", 0))).otherwise(part))
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, depth: int = DEPTH) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row of ``pages (page_id, url)``.

    ``verdict`` is that of the longest rule that fits.  Where none does (``rule`` is null) it
    is the template's: block if its ``purity``, the smoothed share of allowed ones among the
    pages that have the template and a rule, is below a half.  Without such pages it is a
    half, and the page is allowed.  ``template`` and ``purity`` are null where a rule decides.
    Repeated pages count each and are all returned; a null or odd address has an empty host,
    whose root is its template.  An empty table gives no rows.
    """
    parsed = parse(pages).withColumn("found", longest_rule(rules))
    rows = written(
        parsed.select(
            "page_id",
            "host",
            "path",
            F.col("found.rule").alias("rule"),
            F.col("found.verdict").alias("verdict"),
            segments(F.col("path"), depth).alias("segments"),
        )
    )
    blocked = F.when(F.col("verdict") == "block", 1)
    paths = rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("verdict").alias("labelled"), F.count(blocked).alias("blocked")
    )
    templates = path_templates(paths, depth)
    sums = templates.groupBy("host", "template").agg(*[F.sum(name).alias(name) for name in ("labelled", "blocked")])
    purity = (F.col("labelled") - F.col("blocked") + 1) / (F.col("labelled") + 2)
    known = templates.select("host", "segments", "template").join(
        sums.select("host", "template", purity.alias("purity")), ["host", "template"]
    )
    open_rows = rows.filter("rule is null").drop("rule", "verdict").join(known, ["host", "segments"])
    judged = open_rows.select(
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.when(F.col("purity") < PURITY, "block").otherwise("allow").alias("verdict"),
        "template",
        "purity",
    )
    ruled = rows.filter("rule is not null").drop("segments")
    return ruled.unionByName(judged, allowMissingColumns=True).select(*judged.columns)


def path_templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds ``template`` to ``paths (host, segments, n, labelled, blocked)``, which has one row per host and path.

    The levels are done from the root down, since what a node's children are depends on the
    templates above it.  There are at most ``depth`` and one of them, and each reads the
    counts of the paths that go so far.
    """
    rows = written(paths.withColumn("template", F.lit("")))
    done = []
    for level in range(depth + 1):
        here = F.size("segments") == level
        done.append(rows.filter(here))
        deeper = rows.filter(F.size("segments") > level)
        if deeper.isEmpty():
            break
        rows = written(_grown(deeper.withColumn("segment", F.get("segments", F.lit(level))), level))
    else:
        done.append(rows)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every


def _grown(rows: DataFrame, level: int) -> DataFrame:
    """The templates of paths, longer by what stands for their ``segment``."""
    parent, child = ["host", "template"], ["host", "template", "segment"]
    below = F.slice("segments", level + 2, F.greatest(F.size("segments"), F.lit(1)))
    # What a branch looks like: named segments below it are alike, and wildcards are told by their endings.
    shape = F.array_join(F.transform(below, lambda part: F.when(part.startswith("*"), part).otherwise("a")), "/")

    def sums(prefix: str = "") -> list[Column]:
        return [F.sum(name).alias(prefix + name) for name in _STATS]

    cells = written(rows.groupBy(*child, shape.alias("shape")).agg(*sums()))
    children = cells.groupBy(*child).agg(*sums())
    parents = children.groupBy(*parent).agg(F.count(F.lit(1)).alias("all_children"), *sums("all_"))
    shapes = cells.groupBy(*parent, "shape").agg(F.sum("n").alias("shape_n"))
    kinds = shapes.groupBy(*parent).agg(F.count(F.lit(1)).alias("shapes"))
    # Chi square of a branch's shapes against those of all its siblings: n times the sum of
    # squares over what is expected, less one.
    squares = F.sum(F.col("n") * F.col("n") / F.col("shape_n")).alias("squares")
    spread = cells.join(shapes, [*parent, "shape"]).groupBy(*child).agg(squares)
    facts = children.join(spread, child).join(parents.join(kinds, parent), parent)
    n, labelled = F.col("n"), F.col("labelled")
    freedom = F.col("shapes") - 1
    alike = F.col("squares") * F.col("all_n") / n - n <= freedom + SURE * F.sqrt(2.0 * freedom) + 1e-6
    rate = (F.col("all_blocked") + 1) / (F.col("all_labelled") + 2)
    off = F.col("blocked") - labelled * rate
    agrees = off * off <= SURE * SURE * labelled * rate * (1 - rate)
    variable = (F.col("all_children") > MANY) & (n * MANY < F.col("all_n"))
    stands = (
        F.when(F.col("segment").startswith("*"), F.col("segment"))
        .when(variable, "*")
        .when((F.col("all_children") > 1) & alike & agrees, "+")
        .otherwise(F.col("segment"))
    )
    grown = rows.join(facts.select(*child, stands.alias("stands")), child)
    longer = F.concat("template", F.lit("/"), "stands")
    return grown.withColumn("template", longer).drop("segment", "stands")
