"""Stored web pages as rows: the texts of chosen elements, in the order of the page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Elements without an end, those whose text is none of the page's, and those that end a line of text.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))
_BREAKS = frozenset("br p div li tr h1 h2 h3 h4 h5 h6".split())
#: What a starting element ends, if it is open: these may not stand in one another.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Inside these an element of an outer list or paragraph stays open.
_WALLS = frozenset("article section div ul ol table blockquote body nav footer header".split())


class _Collector(HTMLParser):
    """Follows open elements; a wanted one's text is given when it ends, in the order in which they begin."""

    def __init__(self, node: str, within: str):
        super().__init__(convert_charrefs=True)
        self.node, self.within, self.open, self.found = node, within, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for above in range(len(self.open) - 1, -1, -1):
            name = self.open[above][0]
            if name in _ENDS.get(tag, ()):
                self._close(above)
                break
            if name in _WALLS:
                break
        self._line(tag)
        place = None
        if tag == self.node and (not self.within or any(name == self.within for name, _ in self.open)):
            self.found.append([])
            place = len(self.found) - 1
        if tag not in _VOID:
            self.open.append((tag, place))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for above in range(len(self.open) - 1, -1, -1):
            if self.open[above][0] == tag:
                self._close(above)
                self._line(tag)
                return  # an end without its beginning is nothing

    def handle_data(self, data: str) -> None:
        if not any(name in _SILENT for name, _ in self.open):
            for _, place in self.open:
                if place is not None:
                    self.found[place].append(data)

    def _line(self, tag: str) -> None:
        if tag in _BREAKS:
            for _, place in self.open:
                if place is not None:
                    self.found[place].append("\n")

    def _close(self, above: int) -> None:
        del self.open[above:]


def element_texts(html: str | None, node: str, within: str = "") -> list[str]:
    """The trimmed texts of a page's ``node`` elements that stand in a ``within`` element (anywhere without one), in the order they begin.

    Character references are decoded, scripts and styles left out, line breaks kept; what is not closed
    ends where the page's rules end it, or with the page. A null page has none.
    """
    if not html:
        return []
    parser = _Collector(node, within)
    parser.feed(html)
    parser.close()
    return ["".join(parts).strip() for parts in parser.found]


class PageTexts:
    """A table function: ``page_texts(html, node, within)`` gives ``ord, text`` for each element of a page."""

    def eval(self, html: str, node: str, within: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(element_texts(html, node, within))


def register(spark: SparkSession) -> None:
    """Makes ``page_texts`` known to SQL: ``SELECT ... FROM pages, LATERAL page_texts(html, 'p', 'article')``."""
    kind = StructType([StructField("ord", IntegerType()), StructField("text", StringType())])
    spark.udtf.register("page_texts", F.udtf(PageTexts, returnType=kind, useArrow=True))


def page_comments(pages: DataFrame, id_col: str, html_col: str, node: str = "p", within: str = "article", min_chars: int = 11, most: int | None = None) -> DataFrame:
    """``page_id, ord, text``: texts of at least ``min_chars`` characters, numbered over all elements of the page; only the first ``most`` elements where that is given."""
    register(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    rows = pages.sparkSession.sql("SELECT page_id, ord, text FROM {pages}, LATERAL page_texts(html, {node}, {within})", pages=slim, node=node, within=within)
    kept = rows.where(F.length("text") >= min_chars)
    return kept if most is None else kept.where(F.col("ord") < most)
