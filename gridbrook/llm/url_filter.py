"""URL filters: rules on hosts and paths, and decisions that spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridbrook.llm.shared import components, drop, save

#: (decision, host, path) of the production rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags of a page that name another address for it.
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"[^\">]*\bcanonical\b[^\">]*\"|'[^'>]*\bcanonical\b[^'>]*'|canonical\b)[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
TARGET = r"(?is)\burl\s*=\s*['\"]?([^'\"\s>]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null; allow before block where equally long.  The rules are put into the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(df: DataFrame, host: str, path: str, rules: list[tuple[str, str, str]], to: str) -> DataFrame:
    """``df`` with the longest rule that fits in ``to``.  More than MOST_RULES rules are joined by host and its superdomains.

    That join is one of distinct (host, path), so a hot host is judged once for each path.
    """
    if len(rules) <= MOST_RULES:
        return df.withColumn(to, rule_of(host, path, rules))
    table = df.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "on string, prefix string, verdict string")
    parts = F.split("h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    asked = df.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct().select("h", "p", F.explode(ends).alias("on"))
    hits = asked.join(table, "on").where(F.startswith("p", F.col("prefix")))
    best = hits.groupBy("h", "p").agg(F.max(F.struct((F.length("on") + F.length("prefix")).alias("n"), (F.col("verdict") == "allow").alias("ok"), F.concat("on", "prefix").alias("rule"), "verdict")).alias("b"))
    best = best.select(F.col("h").alias("__h"), F.col("p").alias("__p"), F.struct("b.rule", "b.verdict").alias(to))
    return df.join(best, (F.col(host) == F.col("__h")) & (F.col(path) == F.col("__p")), "left").drop("__h", "__p")


def decoded(text: Column) -> Column:
    """The five named character references of HTML and their numbers decoded."""
    for names, by in ((r"&(?:lt|#60|#[xX]3[cC]);", "<"), (r"&(?:gt|#62|#[xX]3[eE]);", ">"), (r"&(?:quot|#34|#[xX]22);", "\""), (r"&(?:apos|#39|#[xX]27);", "'"), (r"&(?:amp|#38|#[xX]26);", "&")):
        text = F.regexp_replace(text, names, by)
    return text


def resolved(base: Column, ref: Column) -> Column:
    """The address that ``ref`` means on a page at ``base``, by the rules of RFC 3986; the fragment is left out."""
    ref = F.regexp_replace(F.regexp_extract(ref, r"(?s)^[^#]*", 0), r"[\t\r\n]", "")
    scheme, site = F.regexp_extract(base, r"^[^:]*:", 0), F.regexp_extract(base, r"(?s)^[^/?]*://[^/?]*", 0)
    page = F.regexp_extract(base, r"(?s)^[^/?]*://[^/?]*([^?]*)", 1)
    folder = F.when(page == "", "/").otherwise(F.regexp_extract(page, r"(?s)^(.*/)[^/]*$", 1))
    path, query = F.regexp_extract(ref, r"(?s)^[^?]*", 0), F.regexp_extract(ref, r"(?s)\?.*$", 0)
    whole = F.when(F.startswith(ref, F.lit("/")), path).otherwise(F.concat(folder, path))
    return (
        F.when(ref == "", base).when(ref.rlike(SCHEME), ref).when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(site, page, ref)).otherwise(F.concat(site, without_dots(whole), query))
    )


def without_dots(path: Column) -> Column:
    """An absolute path without its segments . and .., the latter with the one before it."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(end, "/"))


def address(url: Column) -> Column:
    """The url without its fragment, scheme and host in lower case: pages with one address are one node."""
    bare = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    head = F.regexp_extract(bare, r"(?s)^[^/?]*://[^/?]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.  Pages without
    a rule take the decision of their aliases, the component over rel=canonical links and meta refresh redirects of
    whole pages: allow where one alias is allowed by a rule, else block where one is blocked, else allow.  Targets have
    their character references decoded and are resolved against the page's url.  Null urls and those without :// have an
    empty host and path, no rule and no aliases; repeated rows are repeated; no rows give no rows; other columns are
    ignored.
    """
    rules = RULES if rules is None else rules
    own = pages.selectExpr("page_id", "url as __url", "html as __html")
    own = own.select("page_id", "__html", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), F.when(F.instr("__url", "://") > 0, address(F.col("__url"))).alias("at"))
    own = with_rule(own, "host", "path", rules, "r")
    tags = F.concat(F.regexp_extract_all("__html", F.lit(CANONICAL), F.lit(0)), F.regexp_extract_all("__html", F.lit(REFRESH), F.lit(0)))
    aimed = own.where("at is not null and __html is not null").select("at", F.explode(tags).alias("t"))
    to = F.trim(F.concat(F.regexp_extract("t", HREF, 1), F.regexp_extract("t", HREF, 2), F.regexp_extract("t", HREF, 3)))
    aimed = aimed.select("at", decoded(F.when(F.col("t").rlike(r"(?i)^<link"), to).otherwise(F.regexp_extract("t", TARGET, 1))).alias("to")).where("to <> ''")
    links = save(aimed.select("at", address(resolved(F.col("at"), F.col("to"))).alias("to")).where("to is not null and at <> to").distinct(), "aliases")
    bare = own.select("page_id", "host", "path", "r", "at")
    if links.isEmpty():
        drop(links)
        return bare.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict"))
    # addresses get numbers of their own, which a written table fixes
    nodes = save(links.select(F.col("at").alias("u")).union(links.select("to")).distinct().withColumn("id", F.monotonically_increasing_id()), "addresses")
    one = lambda c, to: nodes.select(F.col("u").alias(c), F.col("id").alias(to))
    comps = components(links.join(one("at", "a"), "at").join(one("to", "b"), "to").select("a", "b"))
    member = nodes.join(comps, nodes["id"] == comps["node"]).select(F.col("u").alias("at"), "component")
    # rules judge link targets that are no row of pages too
    judged = with_rule(nodes.select(F.col("u").alias("at"), host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p")), "h", "p", rules, "v").select("at", F.col("v.verdict").alias("v"))
    decided = judged.join(member, "at").groupBy("component").agg(F.max(F.expr("v = 'allow'")).alias("ok"), F.max(F.expr("v = 'block'")).alias("bad"))
    told = save(member.join(decided, "component").select("at", F.expr("case when coalesce(ok, false) then 'allow' when bad then 'block' end").alias("spread")), "spread")
    drop(links, nodes)
    # rows without an alias take no part in the join, so that pages without a url don't meet in one task
    linked = bare.where("at is not null").join(told, "at", "left").select("page_id", "host", "path", "r", "spread")
    every = linked.unionByName(bare.where("at is null").select("page_id", "host", "path", "r", F.lit(None).cast("string").alias("spread")))
    return every.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "spread", F.lit("allow")).alias("verdict"))
