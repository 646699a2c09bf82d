"""URL filter by a path-template tree, in DataFrame operations only.

For each host, path segments that are variable become wildcards, level by level: digits and long codes by their form,
and any value that few of its node's pages share.  A branch whose labelled share of bad pages doesn't differ from that
of its siblings (two-proportion test) merges with them.  A template is rejected if its smoothed share of bad labelled
pages, (bad + 2) / (labelled + 4), reaches the threshold; so templates without labels, or with one or two, pass.

The tree grows on counts by host and form of path, not on pages, and every node's totals are sums that Spark makes in
part before it shuffles; a host that holds a third of all pages is no more to any task than another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpoint

#: Words in a host name that label its pages as bad, where nothing else does.
BAD_HOST_WORDS = ("adult", "bets", "casino", "porn", "spam", "pills", "ads")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: allow or block, then host and path.
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (after the first ``://``, A-Z lower-cased) and the path (up to ?, # or the end) of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host is the url's or a parent of it, its path begins the url's; else nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def path_form(path: Column) -> Column:
    """The path with codes of 16 or more hex digits and runs of digits as #, and values of over 32 characters as ~."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"[0-9a-f]{16,}", "#"), r"[0-9]+", "#"), r"[^/]{33,}", "~")


def templates(forms: DataFrame, min_pages: int = 4, min_share: float = 0.02, similar: float = 3.84) -> DataFrame:
    """(host, form, template, labelled, bad) for each row of ``forms`` (host, form, pages, labelled, bad: counts).

    A segment stays literal if at least ``min_pages`` and ``min_share`` of its node's pages have it and its labels differ
    from its siblings' (z squared of ``similar`` or more) or can't be compared; else it is *.  Below a node of fewer than
    ``min_pages`` pages all segments are *, so the tree grows level by level only as long as larger nodes have segments left.
    """
    grown, k = None, 0
    t = forms.withColumn("segs", F.split(F.col("form"), "/")).withColumn("template", F.lit(""))
    while True:
        k += 1
        # what ends here, and what lies in nodes that are too small to have literal segments
        size = t.groupBy("host", "template").agg(F.sum("pages").alias("of"))
        t = t.join(size, ["host", "template"])
        done = (F.size("segs") <= k) | (F.col("of") < min_pages)
        rest = F.concat(F.col("template"), F.repeat(F.lit("/*"), F.greatest(F.lit(0), F.size("segs") - k)))
        ended = t.filter(done).select("host", "form", rest.alias("template"), "labelled", "bad")
        grown = ended if grown is None else grown.union(ended)
        t = t.filter(~done).drop("of").withColumn("seg", F.get("segs", F.lit(k)))
        node = t.groupBy("host", "template", "seg").agg(F.sum("pages").alias("n"), F.sum("labelled").alias("ln"), F.sum("bad").alias("lb"))
        whole = node.groupBy("host", "template").agg(F.sum("n").alias("an"), F.sum("ln").alias("al"), F.sum("lb").alias("ab"))
        n1, n2 = F.col("ln").cast("double"), (F.col("al") - F.col("ln")).cast("double")
        p1, p2, p = F.try_divide("lb", n1), F.try_divide(F.col("ab") - F.col("lb"), n2), F.try_divide("ab", "al")
        z2 = F.try_divide((p1 - p2) * (p1 - p2), p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
        same = (n1 > 0) & (n2 > 0) & ((F.col("ab") == 0) | (F.col("ab") == F.col("al")) | (z2 < similar))
        literal = (F.col("n") >= min_pages) & (F.col("n") >= F.col("an") * min_share) & ~same
        names = node.join(whole, ["host", "template"]).select("host", "template", "seg", F.when(literal, F.col("seg")).otherwise(F.lit("*")).alias("name"))
        t = checkpoint(t.join(names, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), "name")).drop("seg", "name"))
        if t.isEmpty():
            break
    total = grown.groupBy("host", "template").agg(F.sum("labelled").alias("of_labelled"), F.sum("bad").alias("of_bad"))
    return grown.select("host", "form", "template").join(total, ["host", "template"]).select("host", "form", "template", F.col("of_labelled").alias("labelled"), F.col("of_bad").alias("bad"))


def url_filter(pages: DataFrame, rules: Sequence[Rule] = (), bad_host_words: Sequence[str] = BAD_HOST_WORDS, label: Column | None = None, threshold: float = 0.7, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of ``pages``.

    verdict: that of the longest rule that fits, else block if the template is rejected, else allow.  Labels come from
    ``label`` (1 bad, 0 good, null none; over the columns of ``pages``), from the rules, and from words of the host name.
    Null urls and urls without ``://`` have an empty host and path and one template; long urls count whole; repeated rows are
    kept; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), (label.cast("int") if label is not None else F.lit(None).cast("int")).alias("own"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    worded = F.when(F.arrays_overlap(F.split(F.col("host"), r"[.\-]"), F.array(*map(F.lit, bad_host_words))), 1) if bad_host_words else F.lit(None).cast("int")
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"), path_form(F.col("path")).alias("form"), "own")
    labelled = F.coalesce("own", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0), worded)
    forms = rows.groupBy("host", "form").agg(F.count("*").alias("pages"), F.count(labelled).alias("labelled"), F.coalesce(F.sum(labelled), F.lit(0)).cast("long").alias("bad"))
    judged = checkpoint(templates(checkpoint(forms)).withColumn("purity", (F.col("bad") + 2) / (F.col("labelled") + 4)))
    found = rows.join(judged.select("host", "form", "template", "purity"), ["host", "form"])
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
