"""URL filters over redirect equivalence, with DataFrame operations only.

A rule names a host, with its subdomains, and a start of the path. URLs that redirects or canonical links join are one page
under several names: they are the connected components of these edges. A URL that no rule fits takes the decision of its
component, where an explicit allow precedes a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checked_broadcast, components, joined_back, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names of query parameters that tell where a visitor comes from, not what page is meant.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid", "msclkid", "mc_[a-z]+", "igshid")


def host_of(url: Column) -> Column:
    """What stands behind the first ://, up to /, ?, # or the end, A-Z lower-cased; without :// and for null empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands between the host and ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL that a site's usual redirects end at: https, no leading www. or m., no tracking parameters, no slash or .html at the end, no fragment.

    Null and what has no :// stay as they are.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(rf"^({'|'.join(TRACKING)})(=|$)"))), "&")
    host = F.regexp_replace(host_of(url), r"^(www|m)\.([^.]+\.)", "$2")
    path = F.regexp_replace(path_of(url), r"(/|\.html?)$", "")
    return F.when(F.locate("://", url) > 0, F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))).otherwise(url)


def _target(url: Column, link: Column) -> Column:
    """The whole URL of a link on a page; null where there is no link."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link == "", None)
        .when(F.locate("://", link) > 0, link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, link))
    )


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's URL and the target of its canonical link, and of its refresh to another page. Null and markup without any have none."""
    tag = F.regexp_extract(html_col, r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    told = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(html_col, r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    sent = F.regexp_extract(meta, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    url = F.col(url_col)
    links = pages.where(url.isNotNull()).select(url.alias("a"), F.explode(F.array(told, sent)).alias("link")).where("link <> ''")
    return links.select("a", _target(F.col("a"), F.col("link")).alias("b")).where("b is not null")


def usual_redirects(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(a, b): a page's URL and where its site's usual redirects send it, if that is another URL."""
    url = F.col(url_col)
    return pages.where(url.isNotNull()).select(url.alias("a"), canonical(url).alias("b")).where("a <> b")


def ruled(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with host, path, rule and rule_action: of the rules (host, path, action) that fit, the longest; null where none does.

    A rule fits its host and all subdomains if the path of the URL starts with its own. Of rules as long as each other the allow
    wins, then that of the longer host. Hosts meet rules once for each distinct host, so no suffix of a host gathers rows; the
    rules that one host has with its parent domains have to fit in a row.
    """
    length = F.length("host") + F.length("path")
    best = F.struct(length.alias("length"), (F.col("action") == "allow").cast("int").alias("allow"), F.length("host").alias("near"), "host", "path", "action")
    known = rules.where("host is not null and path is not null and action in ('allow', 'block')").select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action")
    known = known.groupBy("host").agg(F.collect_set(best).alias("own"))
    rows = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    hosts = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = hosts.select(F.col("host").alias("of"), F.explode(suffixes).alias("host"))
    found = asked.join(checked_broadcast(written(known)), "host").groupBy("of").agg(F.flatten(F.collect_list("own")).alias("own"))
    facts = written(hosts.join(found.withColumnRenamed("of", "host"), "host", "left"))
    met = joined_back(rows, facts, ["host"])
    one = F.array_max(F.filter("own", lambda r: F.col("path").startswith(r["path"])))
    return met.withColumn("one", one).select(*urls.columns, "host", "path", F.concat("one.host", "one.path").alias("rule"), F.col("one.action").alias("rule_action"))


def url_verdicts(pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: the id, host, path, rule, verdict (allow or block) and alias_of, the least URL of its component.

    links (a, b) are redirects and canonical links between URLs, of pages or not. A URL that a rule fits has the rule's verdict.
    Another one is allowed if a rule allows any URL of its component, else blocked if a rule blocks one, else allowed. A null URL, and
    one without ://, has an empty host and path, which no rule fits; a null one has no aliases and is allowed. Repeated rows and ids stay rows;
    null ends of links, links to oneself and repeated links change nothing; other columns, whatever their names, are left
    out; an empty table gives no rows. URLs of links count for a component though no page has them.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    edges = written(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    ends = edges.select(F.col("a").alias("url")).unionByName(edges.select(F.col("b").alias("url"))).distinct()
    found = components(ends.withColumnRenamed("url", "id"), edges).withColumnRenamed("id", "url")
    own = written(ruled(found, rules).select("url", "component", "rule_action"))
    votes = own.where("rule_action is not null").groupBy("component").agg(F.max((F.col("rule_action") == "allow").cast("int")).alias("allowed"))
    # a component's rows are few against the pages' only if it isn't hot, so its decision goes back as facts of counted keys
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    decided = joined_back(own, written(sizes.join(votes, "component")), ["component"]).select("url", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("alias_verdict"))
    known = own.join(decided, "url", "left").select("url", "component", "alias_verdict")
    judged = ruled(rows, rules)
    counts = judged.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    facts = written(counts.join(known, "url", "left"))
    met = joined_back(judged.where("url is not null"), facts, ["url"])
    lone = judged.where("url is null").withColumns({"component": F.lit(None).cast("string"), "alias_verdict": F.lit(None).cast("string")})
    verdict = F.coalesce("rule_action", "alias_verdict", F.lit("allow"))
    return met.unionByName(lone).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "url").alias("alias_of"))
