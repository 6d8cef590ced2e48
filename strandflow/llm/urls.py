"""URL filters whose decisions follow redirect and canonical links."""

from __future__ import annotations

import re
import sys
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import connected_components, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Up to so many rules are an expression in the plan; more are a table that is joined by host, broadcast up to MAX_BROADCAST of them.
MAX_RULES, MAX_BROADCAST = 100, 200_000
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\b|\Z)|<style\b.*?(?:</style\b|\Z)", re.I | re.S)
LINK_TAG = re.compile(r"<(link|meta|base)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
REFRESH = re.compile(r"\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|(.*))", re.I | re.S)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def matched_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (host, path and more) with rule and action: the longest rule (host + path) that fits, else nulls; rules: (action, host, path).

    Of rules of one length allow wins, then the last by name.  Few rules are an expression, more a table under the endings of hosts.
    """
    if len(rules) <= MAX_RULES:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
        return urls.withColumn("rule", rule).withColumn("action", action)
    table = urls.sparkSession.createDataFrame(rules, "r_action string, r_host string, r_path string")
    table = F.broadcast(table) if len(rules) <= MAX_BROADCAST else table
    places = materialize(urls.select("host", "path").distinct(), "url-places")
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = places.select("host", "path", F.explode(endings).alias("r_host")).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    name = F.concat("r_host", "r_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), (F.col("r_action") == "allow").alias("allow"), name.alias("rule"), F.col("r_action").alias("action"))).alias("r"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "r.rule", "r.action")
    return urls.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").drop("b_host", "b_path")


def links_of(url: str, html: str) -> list[str]:
    """The addresses that a page says are its own: canonical links and meta refreshes, whole, against the page's base.

    Tags in comments, scripts and styles don't count.
    """
    base, found = url, []
    for tag, text in LINK_TAG.findall(HIDDEN.sub(" ", html)):
        attrs: dict[str, str] = {}
        for key, *values in ATTRIBUTE.findall(text):
            attrs.setdefault(key.lower(), unescape(next((v for v in values if v), "")).strip())
        to = ""
        if tag.lower() == "base" and base == url and attrs.get("href"):
            base = _joined(url, attrs["href"]) or url
        elif tag.lower() == "link" and "canonical" in attrs.get("rel", "").lower().split():
            to = attrs.get("href", "")
        elif tag.lower() == "meta" and attrs.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.match(attrs.get("content", ""))):
            to = next((g for g in m.groups() if g), "").strip()
        if to and (whole := _joined(base, to)):
            found.append(whole)
    return found


def _joined(base: str, to: str) -> str | None:
    try:
        return urljoin(base, to)
    except ValueError:
        return None


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) from a page's url to its canonical links and to the targets of its meta refreshes.

    Only pages that name either in a tag are read by more than a pattern.  Null urls and pages have no links.
    """
    def run(batches):
        for batch in batches:
            edges = [(url, to) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for to in links_of(url, html)]
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    said = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where("u is not null")
    return said.where(F.col("h").rlike(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|http-equiv)")).mapInArrow(run, "a string, b string")


def node(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case, / for an empty path: the identity that links connect."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host, _ = split_url(bare)
    scheme = F.regexp_extract(bare, r"(?s)^(.*?)://", 1)
    tail = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(bare.contains("://"), F.concat(F.lower(scheme), F.lit("://"), host, tail)).otherwise(bare)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None,
                id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Per row of pages: page_id, url, host, path, rule, verdict, by_alias.

    A url's own rule decides.  A url without one takes the decision of the urls that redirects (a, b), canonical
    links and meta refreshes connect to it, however far: block if one of them is blocked and none is explicitly
    allowed, else allow.
    Null urls and urls without :// have empty host and path, no rule and verdict allow; equal urls agree; a page
    without html has no links; no rows give no rows.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.withColumn("host", host).withColumn("path", path).withColumn("node", node(F.col("url")))
    base = matched_rules(base, rules)
    links = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        links = redirects.select("a", "b") if links is None else links.unionByName(redirects.select("a", "b"))
    none = base.withColumn("alias", F.lit(None).cast("string"))
    if links is not None:
        links = materialize(links.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"))
                            .where("a is not null and b is not null and a <> b").distinct(), "url-links")
        if not links.isEmpty():
            parts = connected_components(links)
            h, p = split_url(F.col("node"))
            parts = matched_rules(parts.withColumn("host", h).withColumn("path", p), rules).select("node", "component", F.col("action").alias("act"))
            parts = materialize(parts, "url-parts")
            said = parts.groupBy("component").agg(
                F.max(F.col("act") == "block").alias("blocks"), F.max(F.col("act") == "allow").alias("allows"))
            said = said.select(F.col("component"), F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("alias"))
            alias = parts.join(said, "component").select("node", "alias").where("alias is not null")
            none = base.join(alias, "node", "left")
    return none.select("page_id", "url", "host", "path", "rule",
                       F.coalesce("action", "alias", F.lit("allow")).alias("verdict"),
                       (F.col("action").isNull() & F.col("alias").isNotNull()).alias("by_alias"))
