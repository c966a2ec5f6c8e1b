"""URL filters with redirect equivalence.

A rule (action, host, path) fits its host and every subdomain when the url's path starts
with the rule's; the longest fitting rule (host and path together) judges the url.

Urls that lead to one another are aliases: a page's ``<link rel=canonical>`` and
``<meta http-equiv=refresh>`` targets, redirect pairs given by the caller, and writings of
one address (scheme, fragment and a closing slash aside).  Aliases form connected
components.  A url without a rule of its own takes the verdict of its component: an
explicit allow anywhere in it wins over a block, a block over nothing; without either the
url is allowed.  A url's own rule always decides for itself.

Only DataFrame expressions run; rules are a short list of literals (``MAX_RULES``), so judging
needs no join.

Defined cases: a null url, or one without "://", has an empty host and path, no rule, and
is allowed; rules of equal length: allow wins; repeated urls are one node; repeated pages
stay; extra columns are ignored by ``judge`` unless asked for; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import components, stored

Rule = tuple[str, str, str]
MAX_RULES = 1_000


def rules_of(text: str) -> list[Rule]:
    """Rules written as "block net/, allow example.net/en/"."""
    found = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        action, place = part.split(None, 1)
        host, slash, path = place.partition("/")
        found.append((action, host.lower(), slash + path))
    return found


def host_of(url: Column) -> Column:
    """What follows the first "://", up to "/", "?", "#" or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, action); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: join them as a table")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    kind = "struct<rule:string,action:string>"
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in ranked
    ]
    return F.coalesce(*fits, F.lit(None).cast(kind)) if fits else F.lit(None).cast(kind)


def address(url: Column) -> Column:
    """One writing for urls of the same place: no scheme, fragment or closing slash."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    plain = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), query)
    return F.when(url.contains("://"), plain)


def resolved(base: Column, target: Column) -> Column:
    """The address that ``target``, as written in an attribute, has on the page ``base``; null if none."""
    target = F.regexp_replace(target, r"(?i)&(?:amp|#38|#x26);", "&")
    scheme = F.regexp_extract(base, r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    parts = F.split(F.substring(whole, 2, 2**31 - 1), "/", -1)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(x == ".", done)
        .otherwise(F.concat(done, F.array(x))),
    )
    folder_end = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder_end, "/").otherwise(""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.contains("://"), target))
        .when(~base.contains("://") | (target == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), target))
        .otherwise(F.concat(site, clean, rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): canonical links and immediate refreshes in ``html``; targets are read on the page's url or <base>."""
    tags = r"(?is)<(?:link|meta)\b[^>]*>"
    own = F.regexp_extract("html", r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    found = (
        pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv\s*=\s*.?refresh"))
        .withColumn("base", F.coalesce(resolved(F.col("url"), own), F.col("url")))
        .select(F.col("url").alias("src"), "base", F.explode(F.regexp_extract_all("html", F.lit(tags), F.lit(0))).alias("tag"))
    )
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    target = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    dst = F.when(F.col("tag").rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), href).when(
        F.col("tag").rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh"), target
    )
    named = found.select("src", "base", dst.alias("dst")).filter("src is not null and dst <> ''")
    return named.select("src", resolved(F.col("base"), F.col("dst")).alias("dst")).filter("dst is not null")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component (of addresses; null without alias), inherited.

    ``pages``: page_id, url, html.  ``redirects``: (src, dst) urls known from crawling.
    """
    links = page_links(pages)
    links = links if redirects is None else links.union(redirects.select("src", "dst"))
    links = links.select("src", "dst").filter("src is not null and dst is not null")

    # Nodes are addresses, so writings of one place are joined already.
    edges = stored(
        links.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")).filter("src <> dst").distinct()
    )
    alike = _spelled_alike(pages)
    parts = _named_components(edges)
    place = address(F.col("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", place.alias("place"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))

    # What is known of a component: rules of its pages and of places no page was crawled for.
    targets = links.select(F.explode(F.array("src", "dst")).alias("url"))
    ends = targets.select(address(F.col("url")).alias("place")).filter("place is not null").distinct()
    seen = targets.select(
        address(F.col("url")).alias("place"),
        fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["action"].alias("action"),
    ).union(judged.join(alike.union(ends), "place", "left_semi").select("place", "own.action"))
    seen = seen.filter("action is not null").distinct()
    part = F.coalesce("component", "place")
    known = (
        seen.join(parts, "place", "left")
        .groupBy(part.alias("component"))
        .agg(F.min("action").alias("inherited"))  # "allow" comes before "block"
    )
    joined = judged.join(parts, "place", "left").withColumn("group", part)
    open_ = joined.join(known.withColumnRenamed("component", "group"), "group", "left")
    return open_.select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.action", "inherited", F.lit("allow")).alias("verdict"),
        "component",
        F.when(F.col("own").isNull(), F.col("inherited")).alias("inherited"),
    )


def _spelled_alike(pages: DataFrame) -> DataFrame:
    """Places that pages name by more than one url."""
    places = pages.select("url", address(F.col("url")).alias("place")).filter("place is not null")
    kinds = places.groupBy("place").agg(F.min("url").alias("a"), F.max("url").alias("b"))
    return kinds.filter("a <> b").select("place")


def _named_components(edges: DataFrame) -> DataFrame:
    """(place, component): components run over 64-bit keys, and are named by their least address."""
    keyed = edges.select("src", "dst", F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))
    parts = components(keyed)
    names = keyed.select("src", "a").union(keyed.select("dst", "b")).toDF("place", "node").distinct()
    found = names.join(parts, "node")
    least = found.groupBy("component").agg(F.min("place").alias("name"))
    return found.join(least, "component").select("place", F.col("name").alias("component"))
