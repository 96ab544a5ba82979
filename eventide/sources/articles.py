"""Articles of raw pages. Python only outlines a page; what is an article is said in columns.

The rule: the title is that of the page's metadata, else of the first heading or title with text.
Containers are article elements and elements with a known id or class. A container's lines are
its paragraphs' texts (its own text if it has none), once each, of 15 characters and more, without
those that begin like a credit or an advertisement. The container with most characters is the
body. A page without a fitting title, a container or 80 characters says so in ``problem``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ARTICLE_CONTAINERS, ARTICLE_NOISE, SILENT_ELEMENTS, VOID_ELEMENTS
from ..functions import text as X
from ..functions.settle import settled

_ELEMENT = pa.struct([("tag", pa.string()), ("names", pa.list_(pa.string())), ("label", pa.string()), ("content", pa.string()), ("last", pa.int32()), ("first", pa.int32()), ("stop", pa.int32())])
OUTLINE = "elements array<struct<tag:string,names:array<string>,label:string,content:string,last:int,first:int,stop:int>>, runs array<string>"


class _Outline(HTMLParser):
    """Elements in the order they open and the runs of text that are shown. Element k holds the
    elements up to ``last`` and the runs from ``first`` to before ``stop``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.runs: list[str] = []
        self.live: list[int] = []  # elements that are open
        self.mute = 0  # how many of them are silent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        of = dict(attrs)
        value = lambda name: (of.get(name) or "").lower()
        k, at = len(self.elements), len(self.runs)
        self.elements.append([tag, [value("id"), *value("class").split()], value("property") or value("name"), of.get("content"), k, at, at])
        if tag not in VOID_ELEMENTS:
            self.live.append(k)
            self.mute += tag in SILENT_ELEMENTS

    def handle_endtag(self, tag: str) -> None:
        if any(self.elements[k][0] == tag for k in self.live):
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.runs.append(data)

    def _end(self) -> str:
        e = self.elements[self.live.pop()]
        e[4], e[6] = len(self.elements) - 1, len(self.runs)
        self.mute -= e[0] in SILENT_ELEMENTS
        return e[0]

    def close(self) -> None:
        super().close()
        while self.live:
            self._end()


def outlines(pages: DataFrame, html: str = "html", key: str = "page_id", *more: str) -> DataFrame:
    """key, further columns, elements and runs of each page: Arrow batches, a page at a time."""
    kept = [key, *more]
    spec = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                page = _Outline()
                page.feed(b.column(len(kept))[k].as_py() or "")
                page.close()
                elements = pa.array([[dict(zip(_ELEMENT.names, e, strict=True)) for e in page.elements]], pa.list_(_ELEMENT))
                own = [b.column(i).slice(k, 1) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, elements, pa.array([page.runs], pa.list_(pa.string()))], names=[*kept, "elements", "runs"])

    return pages.select(*kept, F.col(html).alias("_html")).mapInArrow(run, f"{spec}, {OUTLINE}")


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _text(e: Column) -> Column:
    """The text shown inside an element, as one line."""
    return _line(F.array_join(F.slice("runs", e["first"] + 1, e["stop"] - e["first"]), " "))


def _meta(name: str) -> Column:
    """The last content of a page's metadata of that name; null if there is none or it is empty."""
    of = F.filter("elements", lambda e: (e["tag"] == "meta") & (e["label"] == name))
    return F.nullif(F.get(of, F.size(of) - 1)["content"], F.lit(""))


def _heading(tag: str) -> Column:
    return F.get(F.filter(F.transform(F.filter("elements", lambda e: e["tag"] == tag), _text), lambda t: t != ""), F.lit(0))


def articles(pages: DataFrame, html: str = "html", key: str = "page_id", expected: str | None = None, paragraph: int = 15, body: int = 80, limit: int = 100_000) -> DataFrame:
    """key, title, body (one line a paragraph), published_raw and problem of raw pages.

    ``expected``: a column with the title that a page should have, of which two character pairs must
    be in it. A null page has no title; void and unknown elements, missing end tags and pages of any
    length are read as they come."""
    want = F.col(expected) if expected else F.lit(None).cast("string")
    out = outlines(pages.select(F.col(key), F.col(html), want.cast("string").alias("_want")), html, key, "_want")
    named = F.array(*map(F.lit, ARTICLE_CONTAINERS))
    box = lambda e: (e["tag"] == "article") | F.arrays_overlap(e["names"], named)
    boxes = F.filter(F.transform("elements", lambda e, k: F.struct(k.alias("k"), e.alias("e"))), lambda x: box(x["e"]))
    held = lambda x: F.filter(F.slice("elements", x["k"] + 1, x["e"]["last"] - x["k"] + 1), lambda e: e["tag"] == "p")
    out = settled(out, _title=F.coalesce(F.nullif(_line(_meta("og:title")), F.lit("")), _heading("h1"), _heading("title")), _boxes=F.transform(boxes, lambda x: F.struct(x["e"].alias("e"), held(x).alias("p"))))
    texts = lambda b: F.transform(F.when(F.size(b["p"]) > 0, b["p"]).otherwise(F.array(b["e"])), _text)
    fit = lambda t: (F.length(t) >= paragraph) & ~t.rlike(ARTICLE_NOISE)
    out = settled(out, _lines=F.filter(F.transform("_boxes", lambda b: F.array_distinct(F.filter(texts(b), fit))), lambda x: F.size(x) > 0))
    size = lambda lines: F.length(F.array_join(lines, ""))
    longest = F.get(F.array_sort(F.transform("_lines", lambda x, k: F.struct((-size(x)).alias("n"), k.alias("k"), x.alias("x")))), F.lit(0))["x"]
    pairs = lambda c: X.ngrams(X.normalize_words(c), 2, 2)
    out = settled(out, _body=F.array_join(longest, "\n"), _own=pairs(F.col("_title")), _asked=pairs(F.col("_want")))
    alien = F.size(F.array_intersect("_own", "_asked")) < F.least(F.lit(2), F.size("_asked"))
    problem = (
        F.when(F.col("_title").isNull() | F.coalesce(alien, F.lit(False)), "article_title_mismatch")
        .when(F.size("_lines") == 0, "article_body_missing").when(F.length("_body") < body, "article_body_too_short")
    )
    out = settled(out, problem=problem)
    published = F.coalesce(_meta("article:published_time"), _meta("publishdate"), _meta("pubdate"))
    return out.select(key, F.col("_title").alias("title"), F.when(F.col("problem").isNull(), F.left("_body", F.lit(limit))).alias("body"), published.alias("published_raw"), "problem")
