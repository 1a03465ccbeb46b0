"""What a fetched page tells: body text, linked data, publication time, outlet; and how both times are settled."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from html.parser import HTMLParser
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import fixed
from tidemark.session import ship
from tidemark.sources import windows

CHROME = set(fixed.BODY_CHROME_TAGS)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ZONED = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$"


class _Page(HTMLParser):
    """Paragraph texts outside page chrome, JSON-LD scripts, the published-time meta tag and the canonical link.

    A paragraph that is not closed goes on in those that follow, whose text then counts for both. So bodies can grow with the
    square of a page; what is kept is each piece of text once, and where among the pieces each paragraph begins and ends.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.inside: list[int] = []
        self.texts: list[str] = []
        self.spans: list[list[int | None]] = []
        self.scripts: list[str] = []
        self.meta: str | None = None
        self.canonical: str | None = None
        self.linked = False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta":
            if attrs.get("property") == "article:published_time" and self.meta is None:
                self.meta = attrs.get("content") or None
        elif tag == "link":
            if "canonical" in (attrs.get("rel") or "").split() and self.canonical is None:
                self.canonical = attrs.get("href") or None
        elif tag == "script":
            self.linked = (attrs.get("type") or "") == "application/ld+json"
            if self.linked:
                self.scripts.append("")
        elif tag == "p":
            self.inside.append(len(self.spans))
            self.spans.append([len(self.texts), None])
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "script":
            self.linked = False
        if tag in self.open:
            self._close(tag)

    def _close(self, tag):
        last = None
        while self.open and last != tag:
            last = self.open.pop()
            if last == "p":
                self.spans[self.inside.pop()][1] = len(self.texts)

    def handle_data(self, data):
        if self.linked and self.open and self.open[-1] == "script":
            self.scripts[-1] += data
        elif self.inside and data.strip() and CHROME.isdisjoint(self.open):
            self.texts.append(" ".join(data.split()))

    def runs(self) -> tuple[list[int], list[int]]:
        """(firsts, ends): texts[first:end] of each in turn are the paragraphs' text; those that follow on each other are one."""
        firsts, ends = [], []
        for first, end in self.spans:
            end = len(self.texts) if end is None else end
            if first == end:
                continue
            if ends and ends[-1] == first:
                ends[-1] = end
            else:
                firsts.append(first)
                ends.append(end)
        return firsts, ends


def parse(html: str | None) -> tuple[str, list[str], str | None]:
    """(body, JSON-LD objects as text, meta publication time)."""
    texts, firsts, ends, *rest = _parse(html)[:5]
    return " ".join(t for a, b in zip(firsts, ends) for t in texts[a:b]), *rest


def _parse(html: str | None) -> tuple[list[str], list[int], list[int], list[str], str | None, str | None]:
    """The pieces of the body and its runs of them, JSON-LD objects, meta time, and where the page says that it stands first."""
    page = _Page()
    page.feed(html or "")
    page.close()
    objects = []
    for script in page.scripts:
        try:
            data = json.loads(script)
        except ValueError:
            continue
        objects += [json.dumps(o) for o in (data if isinstance(data, list) else [data]) if isinstance(o, dict)]
    return page.texts, *page.runs(), objects, page.meta, page.canonical


def _found(html: str | None) -> tuple:
    return _parse(html)[:5]


def _body(texts: Column, firsts: Column, ends: Column) -> Column:
    """The runs of pieces put together: bodies are made here, not in Python."""
    return F.array_join(F.flatten(F.zip_with(firsts, ends, lambda a, b: F.transform(F.sequence(a, b - 1), lambda i: F.get(texts, i)))), " ")


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with processed_body, ld_objects (array of JSON texts) and meta_time; the html stays.

    Python gets the html alone, in pickled batches of at most 100 pages, not in Arrow batches of up to 10,000, and gives back
    each piece of text once: what a worker holds does not grow with the table, nor with the square of a page.
    """
    ship(pages.sparkSession)
    read = F.udf(_found, "struct<texts: array<string>, firsts: array<int>, ends: array<int>, ld_objects: array<string>, meta_time: string>", useArrow=False)
    body = _body(*[F.col(f"_found.{c}") for c in ("texts", "firsts", "ends")]).alias("processed_body")
    return pages.withColumn("_found", read(F.col(html))).select("*", body, "_found.ld_objects", "_found.meta_time").drop("_found")


#: Fetched pages that a worker holds at a time.
HELD = 100
#: fetch(url) -> (status, URL it came from, html); errors of the network are raised as OSError.
Fetch = Callable[[str], tuple[int, str, str]]
_FETCHED = "article_id {kind}, status string, n_fetch int, host string, raw_body string, texts array<string>, firsts array<int>, ends array<int>, ld_objects array<string>, meta_time string, other_objects array<string>, other_time string"


def _fetch_one(url: str | None, fetch: Fetch, pace: windows.Pacer | None) -> tuple:
    """status, n_fetch, host, html, body, linked data and time of one page; and those of the page on another host that it names as its original."""
    lost = (None,) * 9
    try:
        if pace:
            pace.wait()
        code, final, html = fetch(url or "")
    except OSError as e:
        return (type(e).__name__, 0, *lost)
    if code != 200:
        return (str(code), 1, *lost)
    host, (*found, canonical) = urlparse(final).netloc, _parse(html)
    other, n = (None, None), 1
    if canonical and urlparse(canonical).netloc not in ("", host):
        try:
            if pace:
                pace.wait()
            code, _, first = fetch(canonical)
            n = 2
            if code == 200:
                other = _parse(first)[3:5]
        except OSError:
            pass
    return ("200", n, host, html, *found, *other)


def _pieces(frames: Iterator[pd.DataFrame], rows: int = HELD) -> Iterator[pd.DataFrame]:
    """The frames in pieces of at most `rows` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def fetched(articles: DataFrame, fetch: Fetch, rate: float = 0.0, workers: int = fixed.SCRAPE_WORKERS, least: int = fixed.LEAST_BODY_CHARS) -> DataFrame:
    """One row for each of `articles` (article_id, url, timestamp_utc): status, n_fetch, true_source, source_ok, utc, time_source, corrected, raw_body, processed_body, text_ok.

    Each partition fetches with `workers` threads, HELD pages at a time; `rate`, calls a second of the whole job, is parted
    among the partitions that run at once. A page that fails has its status, which is the error's name where it has none,
    and NULLs. Runs go on where they stopped by tables.process_chunks() over tables.numbered_chunks().
    """
    spark = articles.sparkSession
    ship(spark)
    share = rate / max(1, spark.sparkContext.defaultParallelism) if rate else 0.0
    kind = articles.schema["article_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = windows.pacer(share) if share else None
        names = [c.split()[0] for c in _FETCHED.split(", ")]
        with ThreadPoolExecutor(max_workers=workers) as pool:
            for frame in _pieces(frames):
                found = list(pool.map(lambda url: _fetch_one(url, fetch, pace), frame["url"]))
                yield pd.DataFrame([(i, *f) for i, f in zip(frame["article_id"], found)], columns=names)
        if pace:
            pace.hold()

    got = articles.select("article_id", "url").mapInPandas(run, _FETCHED.format(kind=kind))
    out = got.join(articles.select("article_id", F.col("timestamp_utc").alias("_api")), "article_id", "left")
    other = published(F.col("other_objects"), F.col("other_time"))
    cross = other.isNotNull()
    candidate = to_utc(F.coalesce(other, published(F.col("ld_objects"), F.col("meta_time"))))
    reached = F.col("status") == "200"
    utc, source = resolved_time(candidate, F.col("_api"), cross)
    outlet = true_source(F.col("ld_objects"), F.col("host"))
    out = out.withColumn("processed_body", _body(F.col("texts"), F.col("firsts"), F.col("ends")))
    return out.select(
        "article_id", "status", "n_fetch", F.when(reached, outlet).alias("true_source"), F.coalesce(reached & outlet.isNotNull(), F.lit(False)).alias("source_ok"), F.when(reached, utc).alias("utc"), F.when(reached, source).alias("time_source"),
        F.coalesce(reached & (source == "corrected"), F.lit(False)).alias("corrected"), "raw_body", "processed_body", F.coalesce(F.length("processed_body") >= least, F.lit(False)).alias("text_ok"),
    )


def _first(objects: Column, path: str) -> Column:
    return F.try_element_at(F.filter(F.transform(objects, lambda o: F.get_json_object(o, path)), lambda v: v.isNotNull() & (v != "")), F.lit(1))


def published(objects: Column, meta: Column) -> Column:
    """The first datePublished of the linked data, else the meta tag's."""
    return F.coalesce(_first(objects, "$.datePublished"), meta)


def to_utc(value: Column) -> Column:
    """ISO time to a timestamp; NULL for what does not parse or names no zone."""
    return F.when(value.rlike(ZONED), F.try_to_timestamp(value))


def true_source(objects: Column, host: Column) -> Column:
    """The provider's name, else the publisher's, else the host."""
    provider = F.try_element_at(
        F.filter(F.transform(objects, lambda o: F.coalesce(F.get_json_object(o, "$.provider.name"), F.when(~F.coalesce(F.get_json_object(o, "$.provider"), F.lit("{")).rlike(r"^[{\[]"), F.get_json_object(o, "$.provider")))), lambda v: v.isNotNull() & (v != "")),
        F.lit(1),
    )
    return F.coalesce(provider, _first(objects, "$.publisher.name"), host)


def resolved_time(candidate: Column, api: Column, cross_host: Column) -> tuple[Column, Column]:
    """(time, corrected or api): the page's time where it is near enough to the feed's, bounds included."""
    apart = F.abs(F.unix_micros(candidate) - F.unix_micros(api)) / 1_000_000
    most = F.when(cross_host, fixed.MOST_CROSS_HOST_SHIFT_DAYS * 86_400).otherwise(fixed.MOST_SHIFT_HOURS * 3_600)
    trusted = F.coalesce(apart <= most, F.lit(False))
    return F.when(trusted, candidate).otherwise(api), F.when(trusted, "corrected").otherwise("api")


def loss_reason(status: Column, utc: Column, body_ok: Column) -> Column:
    """Why an article was lost: unreached before time failed before body failed."""
    return F.when(status.isNull() | (status != "200"), "unreached").when(utc.isNull(), "time failed").when(~F.coalesce(body_ok, F.lit(False)), "body failed")


def accepted(articles: DataFrame, results: DataFrame, least: int = fixed.LEAST_BODY_CHARS, sources: list[str] | None = None) -> DataFrame:
    """Articles of open sources whose body is long enough, with the settled source and time."""
    mine = articles.where(F.col("source").isin(sources or fixed.OPEN_SOURCES))
    got = results.select("article_id", "true_source", "source_ok", "utc", "raw_body", "processed_body")
    out = mine.join(got, "article_id", "left").where(F.length("processed_body") >= least)
    source = F.when(F.coalesce("source_ok", F.lit(False)), F.col("true_source")).otherwise(F.col("source"))
    return out.select("article_id", "headline", "summary", source.alias("source"), "url", F.col("utc").alias("timestamp_utc"), "raw_body", "processed_body")
