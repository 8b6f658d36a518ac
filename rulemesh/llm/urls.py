"""URL filter: explicit rules first, then a tree of path templates for each host.

The tree grows from the root. At each level a host's template has children,
the next path segments. Segments that look like numbers, dates or hashes were
already put in classes; of a child that is one of many and rare among them only
a wildcard is kept; and children whose continuations and label rates can't be
told from those of all the others together are merged into one branch. What a
page's path has become at its end is its template. The tree grows to the deepest
path; from ``SHALLOW`` levels on only where enough labels are left, since what
follows a branch with fewer can't be rejected, and becomes one wildcard.

A template is rejected if its purity, the smoothed share of bad ones among its
labelled pages, reaches a limit. It is smoothed towards the host's share, and
that towards the share of all hosts, so a few labels decide little.

All steps are aggregates and joins over counted paths (host, segments), one row
for each, so a large host is spread over its paths and costs no task its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, read_table

#: Host and path prefix; the longest that fits decides.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Levels that grow whatever labels there are.
SHALLOW = 8
#: Children from which on a rare one (less than this share of the parent) becomes a wildcard.
FAN, RARE = 20, 0.05
#: Chi-square limits (1 %) for two shares and for three, beyond which branches differ.
SHARES_2, SHARES_3 = 6.63, 9.21
#: Purity from which a template is rejected, the labelled pages it needs, and the weight of the smoothing share.
PURITY, LEAST, WEIGHT = 0.5, 3, 4.0

REST, WILD, MERGED = "{**}", "{*}", "{~}"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    url = F.col(url_col).cast("string")
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # a null url gives a null position, which isn't above 0
    return pages.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", path)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null. A rule's host covers all its subdomains."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, text).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Path segments with obvious variables as classes: {n}, {date}, {x}; an ending like .html stays."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^\d{4}-\d{2}(?:-\d{2})?$"), "{date}")
        .when(s.rlike(r"^\d+(?:\.[A-Za-z]\w{0,4})?$"), F.regexp_replace(s, r"^\d+", "{n}"))
        .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F\-]{8,}(?:\.[A-Za-z]\w{0,4})?$"), F.regexp_replace(s, r"^[0-9a-fA-F\-]+", "{x}"))
        .otherwise(s),
    )


def _chi(own: list[Column], whole: list[Column]) -> Column:
    """Chi-square of the counts ``own`` against those of the rest of ``whole``."""
    n_own, n_all = sum(own[1:], own[0]), sum(whole[1:], whole[0])
    out = F.lit(0.0)
    for a, w in zip(own, whole):
        for seen, size in ((a, n_own), (w - a, n_all - n_own)):
            expected = size.cast("double") * w / n_all
            out = out + F.when(expected > 0, (seen - expected) * (seen - expected) / expected).otherwise(0.0)
    return F.when((n_own > 0) & (n_all > n_own), out).otherwise(0.0)


_COUNTS = ("n", "labelled", "bad")
_NEXT = ("ends", "numbers", "others")


def _level(rows: DataFrame) -> DataFrame:
    """``rows`` (host, template, tail and counts) with the next segment of each tail named and put at the template's end."""
    here, after = F.get("tail", F.lit(0)), F.get("tail", F.lit(1))
    rows = rows.withColumn("segment", here)
    kind = F.when(after.isNull(), "ends").when(after.startswith("{"), "numbers").otherwise("others")
    children = (
        rows.where(F.col("segment").isNotNull())
        .groupBy("host", "template", "segment")
        .agg(
            *[F.sum(c).alias(c) for c in _COUNTS],
            *[F.sum(F.when(kind == k, F.col("n")).otherwise(0)).alias(k) for k in _NEXT],
        )
    )
    children = cut(children)
    parents = children.groupBy("host", "template").agg(
        F.count("*").alias("fan"), *[F.sum(c).alias(f"all_{c}") for c in (*_COUNTS, *_NEXT)]
    )
    c = children.join(parents, ["host", "template"])
    alike = (F.col("fan") > 1) & (
        _chi([F.col(k) for k in _NEXT], [F.col(f"all_{k}") for k in _NEXT]) <= SHARES_3
    )
    good, all_good = F.col("labelled") - F.col("bad"), F.col("all_labelled") - F.col("all_bad")
    alike &= _chi([F.col("bad"), good], [F.col("all_bad"), all_good]) <= SHARES_2
    variable = (F.col("fan") > FAN) & (F.col("n") < RARE * F.col("all_n")) & ~F.col("segment").startswith("{")
    name = F.when(variable, WILD).when(alike & ~F.col("segment").startswith("{"), MERGED).otherwise(F.col("segment"))
    named = c.select("host", "template", "segment", name.alias("name"))
    longer = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
    rest = F.slice("tail", 2, F.greatest(F.size("tail"), F.lit(1)))
    joined = rows.join(named, ["host", "template", "segment"], "left")
    return cut(joined.withColumn("template", longer).withColumn("tail", rest).drop("segment", "name"))


def _deep(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` before a level beyond SHALLOW: tails of nodes with too few labels end, what all tails of a node begin with is taken at once."""
    nodes = rows.where(F.size("tail") > 0).groupBy("host", "template")
    nodes = nodes.agg(F.sum("labelled").alias("_labelled"), F.min("tail").alias("_low"), F.max("tail").alias("_high"))
    equal = F.transform(F.sequence(F.lit(0), F.least(F.size("_low"), F.size("_high")) - 1), lambda k: F.get("_low", k) == F.get("_high", k))
    first = F.array_position(equal, False)
    common = F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")
    few = F.col("_labelled") < least
    taken = F.when(few, F.array(F.lit(REST))).otherwise(F.slice("_low", F.lit(1), common))
    nodes = nodes.select("host", "template", few.alias("_few"), taken.alias("_taken"))
    joined = rows.join(nodes, ["host", "template"], "left")
    moves = (F.size("tail") > 0) & (F.size("_taken") > 0)
    longer = F.when(moves, F.concat("template", F.lit("/"), F.array_join("_taken", "/"))).otherwise(F.col("template"))
    rest = F.when(F.size("tail") == 0, F.col("tail")).when(F.col("_few"), F.array().cast("array<string>")).otherwise(
        F.slice("tail", F.size("_taken") + 1, F.size("tail"))
    )
    return cut(joined.withColumn("template", longer).withColumn("tail", rest).drop("_few", "_taken"))


def grow(paths: DataFrame, least: int = LEAST) -> DataFrame:
    """``paths`` (host, segments and counts, one row for each path) with the template of each."""
    deepest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    grown = paths.withColumn("template", F.lit("")).withColumn("tail", F.col("segments"))
    for _ in range(min(deepest, SHALLOW)):
        grown = _level(grown)
    if deepest > SHALLOW:
        while True:
            grown = _deep(grown, least)
            if not grown.where(F.size("tail") > 0).limit(1).count():
                break
            grown = _level(grown)
    return grown.drop("tail")


def judge(paths: DataFrame, purity: float = PURITY, least: int = LEAST, weight: float = WEIGHT) -> DataFrame:
    """(host, segments, template, purity, rejected) of each path of ``grow``."""
    templates = cut(paths.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    whole = templates.agg(F.sum("bad"), F.sum("labelled")).first()
    share = (whole[0] or 0) / whole[1] if whole[1] else 0.0
    hosts = templates.groupBy("host").agg(
        ((F.sum("bad") + F.lit(weight * share)) / (F.sum("labelled") + F.lit(weight))).alias("host_purity")
    )
    judged = templates.join(hosts, "host").withColumn(
        "purity", (F.col("bad") + F.col("host_purity") * weight) / (F.col("labelled") + weight)
    )
    judged = judged.select(
        "host", "template", "purity", ((F.col("purity") >= purity) & (F.col("labelled") >= least)).alias("rejected")
    )
    return paths.select("host", "segments", "template").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(``id_col``, host, path, rule, verdict, template, purity) of each row of ``pages``.

    ``labelled``: (id, bad) with 1 for bad and 0 for good pages; ids without a
    page and null labels don't count, and of several labels of one id the worst
    does. Rows without a host (null urls, or no ``://``) form a host of their
    own, the empty one. Null ids and repeated rows are judged like any others; a
    template that reaches the limit exactly is rejected. A very long url is one
    row whose tail ends early or is taken in one step. Other columns of
    ``pages``, whatever their names, are not read; an empty table gives an empty
    one.
    """
    known = labelled.where(F.col("bad").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("bad").alias("bad"))
    rows = with_host_and_path(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    rows = rows.withColumn("segments", segments(F.col("path")))
    paths = (
        rows.join(known, "id", "left")
        .groupBy("host", "segments")
        .agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    )
    verdicts = cut(judge(grow(cut(paths))))
    found = rows.join(verdicts, ["host", "segments"], "left")
    fits = rule(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("rejected"), "block").otherwise("allow")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, what).otherwise(verdict)
    return found.withColumn("rule", fits).select(
        F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )


def op1_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each page; nulls, ties, repeated rows and long urls as in ``filter_urls``.

    In these tables the number in a page's path is the id of the document it
    shows; that document's quality label is the page's.
    """
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    number = F.regexp_extract("path", r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    shown = with_host_and_path(pages.select("page_id", "url"))
    shown = shown.select(F.col("page_id").alias("id"), F.nullif(number, F.lit("")).cast("long").alias("doc_id"))
    labelled = shown.join(labels, "doc_id").select("id", (F.col("quality") == 0).cast("int").alias("bad"))
    return filter_urls(pages, labelled)
