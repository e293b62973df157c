"""URL rules, and their block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.normalize import let
from claimforge.operators.components import connected_components
from claimforge.operators.storage import materialize

#: Fixed values: (action, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules are part of the plan; a longer list belongs in a table.
MOST_RULES = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a page: the url with its host lower-cased, without fragment; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(F.translate(F.regexp_extract(url, r"(?s)^(.*?://)", 1), UPPER, LOWER), host_of(url), rest))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, action) of the longest rule that fits, else null; ties go to the longer host, then allow."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list] = {}
    for action, h, p in rules:
        by_host.setdefault(h, []).append((action, h, p))
    entry = lambda a, h, p: F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("hn"), F.lit(int(a == "allow")).alias("a"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"))
    table = F.create_map(*(x for h, held in by_host.items() for x in (F.lit(h), F.array(*(entry(*r) for r in held)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull())), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), F.when(best["a"] == 1, F.lit("allow")).otherwise(F.lit("block")).alias("action")))


def without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its ``.`` and ``..`` segments taken out."""
    ended = F.regexp_replace(path, r"(/\.\.?)$", "$1/")
    kept = F.aggregate(
        F.split(F.substr(ended, F.lit(2)), "/"),
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(target: Column, base: Column) -> Column:
    """A link's target as an absolute url (RFC 3986, 5.2) against ``base``, the url of a page with a host.

    What names a scheme, or a host after ``//``, keeps its path as it is.
    """

    def against(x: Column) -> Column:
        t, b = x["t"], x["b"]
        site, own, rest = F.regexp_extract(b, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1)
        folder = F.regexp_extract(path_of(b), r"(?s)^(.*/)", 1)
        path = F.when(F.startswith(t, F.lit("/")), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
        return (
            F.when(F.regexp_like(t, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), t)
            .when(F.startswith(t, F.lit("//")), F.concat(F.regexp_extract(b, r"(?s)^(.*?:)//", 1), t))
            .when(F.startswith(t, F.lit("?")), F.concat(site, path_of(b), t))
            .when(F.startswith(t, F.lit("#")), F.concat(F.regexp_extract(b, r"(?s)^([^#]*)", 1), t))
            .otherwise(F.concat(site, without_dots(path), rest))
        )

    return let(F.struct(target.alias("t"), base.alias("b")), against)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page and what its canonical link or its refresh redirect names.

    Relative targets are resolved against the page's ``<base href>``, where it has one, and its url.
    """
    html, quoted = F.col(html_col), "[\"']?([^\"'\\s>]+)"
    link = F.regexp_extract(html, "(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>", 0)
    refresh = F.regexp_extract(html, "(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>", 0)
    low = F.lower(html)
    targets = F.array(
        F.when(F.contains(low, F.lit("canonical")), F.regexp_extract(link, "(?is)\\bhref\\s*=\\s*" + quoted, 1)),
        F.when(F.contains(low, F.lit("refresh")), F.regexp_extract(refresh, "(?is)\\burl\\s*=\\s*" + quoted, 1)),
    )
    tag = F.regexp_extract(html, "(?is)<base\\b[^>]*\\bhref\\s*=\\s*" + quoted, 1)
    named = F.when(F.contains(low, F.lit("<base")), F.when(tag != "", tag))
    links = pages.select(F.col(url_col).alias("url"), named.alias("base"), F.explode(targets).alias("t")).where("t <> ''").where(host_of(F.col("url")) != "")
    based = let(resolved(F.col("base"), F.col("url")), lambda x: F.when(host_of(x) != "", x))
    target = resolved(F.col("t"), F.coalesce(based, F.col("url")))
    # An array, so that what it holds is computed once and not again in the filter.
    ends = F.array(F.struct(node_of(F.col("url")).alias("a"), let(target, node_of).alias("b")))
    return links.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url.

    A url's own rule decides. One without a rule takes the decision of its redirect and canonical
    aliases: the connected component of ``edges`` (a, b: urls) and of the links in the pages. It is blocked when
    a rule blocks a member, unless a rule allows another (an explicit allow comes before any
    block that is carried over); with no rule in its component it is allowed. Aliases that are no page
    themselves count as members too.

    Components are found by star contraction over the edges alone; each component keeps one row of decisions,
    summed before the shuffle. Only urls with an edge take part in the joins, so a component of any size is never gathered.

    Null urls and those without ``://`` have empty host and path, no rule and verdict allow. Repeated rows
    are judged each. Empty tables give no rows; further columns are ignored.
    """
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    judged = chosen.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    found = page_edges(pages, url_col, html_col) if html_col else None
    if edges is not None:
        given = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        found = given if found is None else found.unionByName(given)
    own = F.col("r.action")
    if found is None:
        return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(own, F.lit("allow")).alias("verdict"))
    members = materialize(connected_components(found), "url-components")
    ruled = members.withColumn("r", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["action"])
    decided = ruled.groupBy("component").agg(F.max(F.when(F.col("r") == "allow", 1)).alias("allowed"), F.max(F.when(F.col("r") == "block", 1)).alias("blocked"))
    blocked = decided.where("blocked = 1 and allowed is null").select("component")
    carried = materialize(members.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("carried")), "url-blocked")
    joined = judged.withColumn("node", F.when(own.isNull(), node_of(F.col("url")))).join(carried, "node", "left")
    verdict = F.coalesce(own, F.when(F.col("carried"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
