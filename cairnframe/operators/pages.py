"""Web pages: parsing, addresses, relevance, and the frontier over a link graph."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.session import cut

PAGE = "url string, title string, description string, author string, published string, lang string, headings string, text string, word_count int, content_hash string, links array<string>, structured array<string>"
#: Elements whose text is no part of a page's own text, and elements that end a line.
DROPPED = frozenset("script style nav header footer aside form noscript template svg iframe button".split())
BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article ul ol table blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Parsed(HTMLParser):
    """One pass over a page: metadata, headings, links, structured data and clean text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.headings, self.links, self.structured = {}, [], [], []
        self.title, self.lang, self.out, self.dropped = "", None, [], 0
        self.open, self.depth = [], Counter()
        self.grabbing, self.grabbed = None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang") or None
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name.lower(), a.get("content", "").strip())
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in ("title", "h1", "h2", "h3") or tag == "script" and a.get("type") == "application/ld+json":
            self.grabbing, self.grabbed = tag, []
        if tag not in VOID:
            self.open.append(tag)
            self.depth[tag] += 1
            self.dropped += tag in DROPPED
        if tag in BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag == self.grabbing:
            text = " ".join("".join(self.grabbed).split())
            if tag == "title":
                self.title = self.title or text
            elif tag == "script":
                self.structured.append("".join(self.grabbed).strip())
            elif text and len(self.headings) < 50:
                self.headings.append(text)
            self.grabbing = None
        # The end of an element ends what was left open inside it; an end without a beginning ends nothing.
        ends = self.depth[tag] > 0
        while ends:
            inner = self.open.pop()
            self.depth[inner] -= 1
            self.dropped -= inner in DROPPED
            ends = inner != tag
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.grabbing:
            self.grabbed.append(data)
        if not self.dropped and self.grabbing != "title":
            self.out.append(data)

    def first(self, *names: str) -> str | None:
        return next((self.meta[n] for n in names if self.meta.get(n)), None)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def parse(url: str, html: str | None) -> tuple:
    import hashlib

    p = Parsed()
    p.feed(html or "")
    text = p.text()
    return (
        url, p.title or p.first("og:title", "twitter:title"), p.first("description", "og:description", "twitter:description"), p.first("author", "article:author"),
        p.first("article:published_time", "date", "pubdate"), p.lang, " | ".join(p.headings), text, len(text.split()), hashlib.sha256(text.encode()).hexdigest()[:32], list(dict.fromkeys(p.links)), p.structured,
    )


def parse_pages(raw: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Page records out of HTML, in Arrow batches; a null page is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGE.split(", ")]
        for b in batches:
            yield pd.DataFrame([parse(u, h) for u, h in zip(b[url], b[html])], columns=names)

    return raw.select(url, html).mapInPandas(run, PAGE)


_PART = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\]|:first-child|:nth-child\(\d+\))*)$")


class Selector(HTMLParser):
    """Texts (or an attribute) of the elements that a selector of a small CSS subset finds, at most 20.

    Tags, classes, ids, attributes, :first-child, :nth-child(n) and descendants.
    """

    def __init__(self, selector: str, attribute: str | None = None, most: int = 20):
        super().__init__(convert_charrefs=True)
        self.steps = [self._step(s) for s in selector.split()]
        self.attribute, self.most = attribute, most
        self.stack: list[tuple[str, dict, int]] = []
        self.children, self.found, self.open = [0], [], []

    @staticmethod
    def _step(s: str):
        m = _PART.match(s)
        if not m:
            raise ValueError(f"selector {s!r} is outside the supported subset")
        tests = re.findall(r"\.[\w-]+|#[\w-]+|\[[^\]]+\]|:first-child|:nth-child\(\d+\)", m[2] or "")
        return (m[1] or "").lower(), tests

    @staticmethod
    def _fits(step, tag, attrs, nth) -> bool:
        want, tests = step
        if want and want != tag:
            return False
        for t in tests:
            if t[0] == "." and t[1:] not in attrs.get("class", "").split():
                return False
            if t[0] == "#" and attrs.get("id") != t[1:]:
                return False
            if t == ":first-child" and nth != 1:
                return False
            if t.startswith(":nth-child(") and nth != int(t[11:-1]):
                return False
            if t[0] == "[":
                name, _, value = t[1:-1].partition("=")
                if name not in attrs or value and attrs[name] != value.strip("\"'"):
                    return False
        return True

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.children[-1] += 1
        here = (tag, a, self.children[-1])
        path, k = [*self.stack, here], 0
        for node in path[:-1]:
            if k < len(self.steps) - 1 and self._fits(self.steps[k], *node):
                k += 1
        if k == len(self.steps) - 1 and self._fits(self.steps[-1], *here) and len(self.found) < self.most:
            if self.attribute:
                if self.attribute in a:
                    self.found.append(a[self.attribute])
            elif tag not in VOID:
                self.found.append("")
                self.open.append((len(self.stack), len(self.found) - 1))
        if tag not in VOID:
            self.stack.append(here)
            self.children.append(0)

    def handle_endtag(self, tag):
        while self.stack and any(n[0] == tag for n in self.stack):
            closed = self.stack.pop()
            self.children.pop()
            self.open = [(d, i) for d, i in self.open if d < len(self.stack)]
            if closed[0] == tag:
                break

    def handle_data(self, data):
        for _, i in self.open:
            self.found[i] += data


def select(html: str, rule: str) -> list[str]:
    """Values of a rule: `selector`, `selector@attribute`, or `regex:pattern` (one group: the group)."""
    if rule.startswith("regex:"):
        pattern = re.compile(rule[6:], re.I | re.S)
        return [m.group(1) if pattern.groups == 1 else m.group(0) for m in pattern.finditer(html)][:20]
    selector, _, attribute = rule.partition("@")
    s = Selector(selector.strip(), attribute.strip() or None)
    s.feed(html)
    return [" ".join(x.split()) for x in s.found if x.strip()]


def extract(raw: DataFrame, rules: dict[str, str], key: str = "url", html: str = "html") -> DataFrame:
    """(`key`, name, value) of every rule on every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, v) for k, h in zip(b[key], b[html]) if h for n, r in rules.items() for v in select(h, r)]
            yield pd.DataFrame(rows, columns=[key, "name", "value"])

    return raw.select(key, html).mapInPandas(run, f"`{key}` {raw.schema[key].dataType.simpleString()}, name string, value string")


def structured_fields(block: str) -> dict[str, str]:
    """A JSON-LD block as dotted names and texts; nothing if it isn't JSON."""
    from cairnframe.sources.records import flatten

    try:
        return flatten(json.loads(block))
    except ValueError:
        return {}


def clean_url(url: Column) -> Column:
    """An address without fragment and final slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "(?<!/)/+$", "")


def domain_of(url: Column) -> Column:
    """The host with port, lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1)), r"^www\.", "")


def crawlable(url: Column) -> Column:
    """http(s) addresses that are no media, style or archive files."""
    return url.rlike("^https?://") & ~F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(jpe?g|png|gif|svg|webp|ico|css|js|mp[34]|avi|mov|zip|gz|tar|rar|exe|dmg|woff2?|ttf)$")


def relevance(title: Column, text: Column, keywords: list[str]) -> Column:
    """Up to ten hits per keyword in the text and five for one in the title; 1.0 without keywords."""
    if not keywords:
        return F.lit(1.0)
    out = F.lit(0)
    for k in keywords:
        hits = F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(re.escape(k.lower())))
        out = out + F.least(hits, F.lit(10)) + F.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(k.lower())), 5).otherwise(0)
    return out.cast("double")


def frontier(seeds: DataFrame, links: DataFrame, depth: int, same_domain: bool = True) -> DataFrame:
    """(`url`, `depth`): pages reached from the seeds over (from_url, to_url) in at most `depth` steps, each at its least depth.

    One join per step; reached addresses are taken out by an anti join, and the lineage is cut.
    """
    seen = cut(seeds.select(clean_url(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0)))
    edges = links.select(clean_url(F.col("from_url")).alias("url"), clean_url(F.col("to_url")).alias("to")).where(crawlable(F.col("to")))
    if same_domain:
        edges = edges.where(domain_of(F.col("url")) == domain_of(F.col("to")))
    newest = seen
    for d in range(1, depth + 1):
        newest = cut(newest.select("url").join(edges, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if newest.isEmpty():
            break
        seen = cut(seen.unionByName(newest))
    return seen


def next_batch(waiting: DataFrame, size: int) -> DataFrame:
    """At most one address per domain, the shallowest first, up to the batch's size."""
    best = waiting.groupBy(domain_of(F.col("url")).alias("domain")).agg(F.min(F.struct("depth", "url")).alias("b"))
    return best.select("b.url", "b.depth").orderBy("depth", "url").limit(size)


def unvisited(links: DataFrame, pages: DataFrame, top: int = 50) -> DataFrame:
    """Linked addresses that no page has, most linked first; `top` is the report's length."""
    to = links.select(clean_url(F.col("to_url")).alias("url")).join(pages.select(clean_url(F.col("url")).alias("url")), "url", "left_anti")
    return to.groupBy("url").agg(F.count("*").alias("links")).orderBy(F.desc("links"), "url").limit(top)
