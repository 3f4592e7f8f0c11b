"""Articles: Atom feeds, and the text of HTML pages."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import tidy_lines
from tessera.operators.parents import first_of

# Elements whose content is not text of the article, elements that end a line, and elements without an end tag; fixed values.
SKIPPED = frozenset("script style noscript template svg img picture source figure figcaption nav header footer aside form".split())
BLOCKS = frozenset("article section div p br li ul ol h1 h2 h3 h4 h5 h6 table tr td th blockquote pre hr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    """The text outside skipped elements and elements whose class or id speaks of comments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []  # open elements from the outermost skipped one on

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and not self.inside:
            self.parts.append("\n")
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        if tag not in VOID and (self.inside or tag in SKIPPED or "comment" in names):
            self.inside.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS and not self.inside:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.inside:
            # An element that was left open ends with the one around it.
            if tag in self.inside:
                del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def text_of_html(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.parts)


def _extract(html: pd.Series) -> pd.Series:
    return html.map(text_of_html)


def html_text(html: Column) -> Column:
    """The readable text of a page, its lines tidied; null has none."""
    return tidy_lines(F.pandas_udf(_extract, "string")(html))


def _joined(base: str):
    def run(links: pd.Series) -> pd.Series:
        return links.map(lambda x: urljoin(base, x), na_action="ignore")

    return run


def next_page(body: str) -> str | None:
    """The link with rel="next" of a feed page's head, before its entries."""
    import xml.etree.ElementTree as ET

    for child in ET.fromstring(body):
        if child.tag.rsplit("}", 1)[-1] == "link" and child.get("rel") == "next":
            return child.get("href")
    return None


def read_feed(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Entries of Atom files: entry_id, title, url, created_at, updated_at, content; each id once, those without a link left out.

    Relative links are resolved against ``base``, the feed's own address.
    """
    schema = (
        "id string, title string, published string, updated string, content struct<_VALUE:string,_type:string>, "
        "link array<struct<_rel:string,_href:string,_VALUE:string>>"
    )
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    links = F.coalesce(F.filter("link", lambda x: x["_href"].isNotNull()), F.array())
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    url = F.coalesce(F.get(alternate, 0)["_href"], F.get(links, 0)["_href"])
    if base:
        url = F.pandas_udf(_joined(base), "string")(url)
    # Rows of a file come in their order, so the id that Spark gives them tells which came first.
    raw = raw.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    out = raw.select(
        "_file", "_at", F.coalesce(F.nullif(F.trim("id"), F.lit("")), url).alias("entry_id"), F.trim("title").alias("title"), url.alias("url"),
        F.coalesce("published", "updated").alias("created_at"), F.coalesce("updated", "published").alias("updated_at"), F.col("content._VALUE").alias("content"),
    )
    # Of entries with one id the first is kept: by file, then by its place there.
    return first_of(out.where("url is not null"), ["entry_id"], ["_file", "_at"]).drop("_file", "_at")


def with_bodies(entries: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """Entries with the page's own HTML where the feed has no content; ``fetch`` gives a URL's body, in the tasks."""
    missing = F.trim(F.coalesce("content", F.lit(""))) == ""
    fetched = F.pandas_udf(lambda urls: urls.map(fetch, na_action="ignore"), "string")(F.when(missing, F.col("url")))
    return entries.withColumn("content", F.when(missing, fetched).otherwise(F.col("content")))


def pages_of(fetch: Callable[[str], tuple[str, str | None]], url: str, most: int = 200) -> Iterator[tuple[str, str]]:
    """(url, body) of a feed's pages: ``fetch`` gives a body and the next page's link; ends at a page that was there before.

    It ends at ``most`` pages too, with a warning that names the page that was not read.
    """
    seen: set[str] = set()
    while url and url not in seen and len(seen) < most:
        seen.add(url)
        body, following = fetch(url)
        yield url, body
        url = urljoin(url, following) if following else ""
    if url and url not in seen:
        warnings.warn(f"{most} pages read; {url} and what follows it are not", stacklevel=2)


class _Part(InputPartition):
    def __init__(self, url: str):
        self.url = url


class FeedSource(DataSource):
    """A feed as a source of pages; option ``fetcher`` names a module's function (module:name), so that any transport will do.

    Options: url (several by spaces; one partition each), most.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _FeedReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.fetcher, self.most = options["url"].split(), options["fetcher"], int(options.get("most", "200"))

    def partitions(self):
        return [_Part(u) for u in self.urls]

    def read(self, partition):
        import importlib

        module, _, name = self.fetcher.partition(":")
        yield from pages_of(getattr(importlib.import_module(module), name), partition.url, self.most)
