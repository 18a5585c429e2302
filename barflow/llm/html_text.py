"""Main text of web pages: parser events make lines, smoothed text-to-tag ratios pick the content region."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold text of an article, those that start a new line, and those without an end tag.
SKIPPED = frozenset("script style noscript template head title svg annotation annotation-xml iframe object embed canvas audio video map select option textarea button input nav footer aside menu dialog datalist".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without a place in BLOCKS that end the line around them where they are left out; others are left out of the middle of it.
APART = frozenset("nav footer aside menu dialog head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
#: Parts of the site that a region without a container does not grow across.
FENCES = frozenset("nav footer header menu".split())
#: Whole words in class, id or role that name a part outside the article, and compounds that do.
OUTSIDE = frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright sidebar aside comment comments comment-list respond reply replies disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager complementary contentinfo search skip".split())
COMPOUNDS = frozenset("ad-slot ad-unit ad-banner ad-box ad-container ad-wrapper ads-banner google-ad adsbygoogle sponsored-content sponsored-post cookie-banner cookie-bar cookie-consent cookie-notice cookie-law cookie-policy-banner consent-banner gdpr-banner gdpr-notice site-notice site-header site-footer site-nav site-navigation page-footer main-nav main-menu main-navigation nav-menu nav-bar nav-links top-nav side-nav primary-menu primary-nav menu-bar top-bar breadcrumb-nav breadcrumb-trail post-navigation page-navigation comment-body comment-form comment-respond comment-section comments-area comments-section user-comments disqus-thread share-bar share-box share-buttons share-links sharing-buttons social-icons social-links social-media social-share related-articles related-content related-links related-posts recommended-articles recommended-posts newsletter-form newsletter-signup subscribe-form login-form search-bar search-box search-form left-sidebar right-sidebar sidebar-widget widget-area modal-dialog popup-overlay skip-link".split())
#: Words with a plain meaning too; the clusters, or dense prose, overrule them, see :func:`main_text`.
DOUBTFUL = frozenset("banner header masthead notice notices notification alert share sharing social related recommended search skip promo promotion".split())
#: Elements that a paragraph, or an item of a list, does not reach out of.
AROUND_PARAGRAPHS = tuple("article main div section td li blockquote body aside nav footer header form".split())
PROSE_CHARS, PROSE_RATIO = 200, 80
#: Of the words, those that rule out an article or main element too, and those that name a part of it.
OUTSIDE_ARTICLE = frozenset("ad ads advert sponsored promo comment comments reply replies related teaser widget cookie consent newsletter".split())
OF_ARTICLE = frozenset("header masthead".split())
#: What stands for the name of a form that is not within an article: some sites put the whole page in one.
PAGE_FORM = "<form>"
SIGMA = 1.0


class Line:
    """A block of text with the tags that stood in it."""

    __slots__ = ("parts", "tags", "chars", "linked", "home", "outside", "fence", "named", "title")

    def __init__(self, home: int, outside: bool, fence: bool, named: int):
        self.parts, self.tags, self.chars, self.linked, self.home, self.outside, self.fence, self.named, self.title = [], 0, 0, 0, home, outside, fence, named, False

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Named:
    """A part that its class, id or role calls outside the article, until what it holds says otherwise; ``around`` is the number of the next one around it."""

    __slots__ = ("around", "sure", "doubtful", "lifted")

    def __init__(self, around: int, words: set[str]):
        self.around, self.lifted = around, False
        self.sure, self.doubtful = any(not OUTSIDE_ARTICLE.isdisjoint(w.split("-")) for w in words), words <= DOUBTFUL | {PAGE_FORM}


class Lines(HTMLParser):
    """Turns parser events into lines; each knows its content container and whether it stands in a part outside the article.

    Elements that never hold text and hidden ones are left out at once; named parts keep their text until the page has been read.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int, int]] = []  # tag, opens an outside part (1) or a named one (2), container, innermost named part
        self.places: dict[str, list[int]] = {}  # of each tag, where it stands in the stack
        self.apart, self.out = [0], [0]  # elements up to each place of the stack that make lines of their own, and that open outside or named parts
        self.parents = [0]  # of each container, the one around it; 0 is the page
        self.outside = self.fences = 0
        self.named: list[Named] = [Named(0, set())]  # 0 is the page
        self.line = Line(0, False, False, 0)

    def _break(self) -> None:
        if self.line.parts or self.line.tags:
            self.lines.append(self.line)
        self.line = Line(0, False, False, 0)
        self._place()

    def _place(self) -> None:
        _, _, self.line.home, self.line.named = self.open[-1] if self.open else ("", 0, 0, 0)
        self.line.outside, self.line.fence, self.line.title = self.outside > 0, self.fences > 0, any(t == "h1" for t, *_ in self.open[-3:])

    def handle_starttag(self, tag, attrs):
        self.line.tags += 1
        if tag == "br":
            self.line.parts.append(" ")
            return
        if tag in VOID:
            if tag in BLOCKS:
                self._break()
            return
        if tag in BLOCKS and any(t == "p" for t, *_ in self.open[-8:]):
            self._close_paragraph()
        if tag == "li" and (at := self._find("li", ("ul", "ol"))) is not None:
            self._pop(at)
        _, _, home, named = self.open[-1] if self.open else ("", 0, 0, 0)
        words = self._words_outside(tag, attrs)
        out = 1 if tag in SKIPPED or words is None else 2 if words else 0
        if tag in CONTENT:
            self.parents.append(home)
            home = len(self.parents) - 1
            if not out and not self.outside:
                self._lift(named, tag)
        parts = tag in BLOCKS or tag in APART or out == 2
        if parts:
            self._break()
        if out == 2:
            self.named.append(Named(named, words))
            named = len(self.named) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, out, home, named))
        self.apart.append(self.apart[-1] + (tag in BLOCKS or tag in APART or out == 2))
        self.out.append(self.out[-1] + (out > 0))
        self.outside += out == 1
        self.fences += out == 1 and tag in FENCES
        if parts:
            self._place()

    def _lift(self, named: int, tag: str) -> None:
        """A part with an article or main element in it is layout, not outside; comments, teasers and the like have articles of their own."""
        while named:
            part = self.named[named]
            if part.sure and tag != "main":
                return
            if part.lifted:
                return
            part.lifted = True
            named = part.around

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _words_outside(self, tag, attrs) -> set[str] | None:
        """The words that name a part outside the article; None for what is never shown as text of it."""
        found: set[str] = set()
        if tag in ("html", "body"):
            return found
        inside = any(self.places.get(t) for t in CONTENT)
        if tag == "form":
            if inside:
                return None
            found.add(PAGE_FORM)
        if tag == "header":
            return found if inside else None
        listed = OUTSIDE_ARTICLE if tag in CONTENT else OUTSIDE - OF_ARTICLE if inside else OUTSIDE
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                for word in value.lower().replace("_", "-").split():
                    if word in listed or word in COMPOUNDS and (tag not in CONTENT or not OUTSIDE_ARTICLE.isdisjoint(word.split("-"))):
                        found.add(word)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.lower().replace(" ", ""):
                return None
        return found

    def _find(self, tag, stop=()):
        """Where the innermost open element of a tag stands, None if there is none or one of ``stop`` is within it."""
        at = self._last(tag)
        return None if at < 0 or any(self._last(t) > at for t in stop) else at

    def _last(self, tag) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _drop(self, at) -> None:
        """Take all elements from ``at`` on off the stack; each is looked at once."""
        for tag, out, *_ in self.open[at:]:
            self.places[tag].pop()
            self.outside -= out == 1
            self.fences -= out == 1 and tag in FENCES
        del self.open[at:], self.apart[at + 1 :], self.out[at + 1 :]

    def _pop(self, at) -> None:
        self._break()
        self._drop(at)
        self._place()

    def _close_paragraph(self) -> None:
        at = self._find("p", AROUND_PARAGRAPHS)
        if at is not None:
            self._pop(at)

    def handle_endtag(self, tag):
        self.line.tags += 1
        at = self._find(tag)
        if at is None:
            return
        if self.apart[-1] == self.apart[at]:
            self._drop(at)  # inline: the line goes on
        elif tag in BLOCKS or self.out[-1] > self.out[at]:
            self._pop(at)

    def handle_data(self, data):
        if self.outside:
            return
        self.line.parts.append(data)
        n = len(data) - data.count(" ")
        self.line.chars += n
        if any(t == "a" for t, *_ in self.open[-3:]):
            self.line.linked += n

    def finish(self) -> list[Line]:
        """All lines; those of parts with doubtful names only are not outside yet."""
        self.close()
        self._break()
        self._mark([part.doubtful for part in self.named])
        return self.lines

    def _mark(self, kept: list[bool]) -> None:
        outside = [False] * len(self.named)
        for at in range(1, len(self.named)):
            part = self.named[at]
            outside[at] = outside[part.around] or not (part.lifted or kept[at])
        for x in self.lines:
            x.outside = x.outside or outside[x.named]

    def judge(self, lines: list[Line], level: np.ndarray, content: np.ndarray) -> bool:
        """Leave out the parts of doubtful name that the clusters do not take for content; whether there are any.

        Such a part stays where most of its plain text stands in clusters and it has at least half as many characters a tag as the clusters' smoothed lines
        have outside such parts. Dense prose stays in any case: PROSE_CHARS and more, PROSE_RATIO of them a tag.
        """
        size = len(self.named)
        plain, tags, inside = [0] * size, [0] * size, [0] * size
        doubted = [False] * size
        for at in range(1, size):
            part = self.named[at]
            doubted[at] = doubted[part.around] or part.doubtful and not part.lifted
        usual = [v for x, v, c in zip(lines, level, content) if c and not doubted[x.named]]
        for x, c in zip(lines, content):
            plain[x.named] += x.chars - x.linked
            tags[x.named] += x.tags if x.chars else 0
            inside[x.named] += x.chars - x.linked if c else 0
        kept = [False] * size
        for at in range(1, size):
            if self.named[at].doubtful:
                dense = usual and 2 * inside[at] > plain[at] and 2 * plain[at] >= sum(usual) / len(usual) * max(1, tags[at])
                kept[at] = bool(dense) or plain[at] >= PROSE_CHARS and plain[at] >= PROSE_RATIO * max(1, tags[at])
        self._mark(kept)
        return any(part.doubtful and not part.lifted and not k for part, k in zip(self.named[1:], kept[1:]))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at three sigma and kept to its weight at the ends."""
    width = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-width, width + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[width : width + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[width : width + len(ratios)]


def _grown(lines: list[Line], at: int, step: int) -> int:
    """The last line from ``at`` on, in steps, before a fence or a run of two lines that are mostly links; parts outside the article are crossed."""
    end, links, nxt = at, 0, at + step
    while 0 <= nxt < len(lines) and not lines[nxt].fence and links < 2:
        x = lines[nxt]
        if not x.outside and x.chars:
            links = links + 1 if 2 * x.linked > x.chars else 0
            end = end if links else nxt
        nxt += step
    return end


def _clusters(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """The smoothed text-to-tag ratio of each line, and whether it stands in a cluster."""
    ratios = np.array([0.0 if x.outside else max(0, x.chars - x.linked) / max(1, x.tags) for x in lines])
    level = smoothed(ratios)
    content = (level >= max(level.std() / 2, 1e-9)) & (ratios > 0)
    return level, content if content.any() else ratios > 0


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one newline; empty if there are none.

    Lines (blocks of text between block-level tags) get the ratio of their characters to their tags, not counting linked text and parts outside the
    article; the ratios are smoothed, and lines above half of their standard deviation are clusters of content. A short page whose lines all fall below
    the threshold keeps its region too. Parts whose name may mean content or not are judged by the clusters, see :meth:`Lines.judge`, wherever they stand, and
    the clusters are then found again without what is left out. The content region is the outermost article or main element that holds most of the characters in clusters,
    whole with what is nested in it, and each other outermost one that holds clusters; where all its plain text stands in one nested element, that one.
    Where none holds most, it is every line from the first to the last cluster, grown over the lines around up to the site's navigation, header or footer
    or a run of links, with the page's h1 where a run of links parts it from its text. Forms are left out, but for one around the page: one that is not
    within an article and holds an article or main element, or dense prose. Malformed markup is read as far as it goes.
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = [x for x in parser.finish() if x.parts or x.outside]
    if not lines:
        return ""
    level, content = _clusters(lines)
    if parser.judge(lines, level, content):
        level, content = _clusters(lines)
    parents = parser.parents
    clustered, plain = [0] * len(parents), [0] * len(parents)
    for x, c in zip(lines, content):
        if not x.outside:
            clustered[x.home] += x.chars if c else 0
            plain[x.home] += x.chars - x.linked
    for home in range(len(parents) - 1, 0, -1):  # a container comes after the one around it
        clustered[parents[home]] += clustered[home]
        plain[parents[home]] += plain[home]
    taken = [False] * len(parents)
    for home in range(1, len(parents)):
        around = parents[home]
        if around:
            taken[home] = taken[around]
            if taken[around] and plain[home] == plain[around]:
                taken[around] = False
        else:
            taken[home] = clustered[home] > 0
    if any(not parents[h] and 2 * clustered[h] > clustered[0] for h in range(1, len(parents))):
        chosen = [x for x in lines if taken[x.home] and not x.outside]
    else:
        at = np.flatnonzero(content)
        start, end = (_grown(lines, at[0], -1), _grown(lines, at[-1], 1) + 1) if len(at) else (0, 0)
        chosen = [x for i, x in enumerate(lines[:end]) if not x.outside and (i >= start or x.title and not x.fence)]
    return "\n".join(t for x in chosen if (t := x.text()))


def with_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page as STRING: see :func:`main_text`. Null and empty pages have an empty text; a column of the same name is replaced."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return df.withColumn(out, extract(F.col(f"`{html}`")))
