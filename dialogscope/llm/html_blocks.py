"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. What is boilerplate by its element, role or
class (scripts, styles, forms, menus, page headers and footers, sidebars, notices, adverts, reader
comments) leaves a gap of blank lines. So do the borders of an article (or main element), while cuts inside
an article close up. The main text of a page with articles that have any text is all of their lines. On other pages the lengths of
text without links are summed over windows of ``WINDOW`` lines: where the sum rises over the surge level the text surges, where it
comes to nothing it dives. The main text is the span from a surge to a dive that holds most text, with those that only dropped
boilerplate parts from it. All lines of a span are kept, whatever their length.

Defined results: a null or empty page, or one without text, gives an empty text; elements that are never
closed end with their parent; a tag or comment that the page's end cuts off is dropped; repeated rows give a row each; an empty
table gives no rows; other columns are left alone. The time is in proportion to the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from dialogscope.llm.common import over_texts

WINDOW = 3
#: Characters in a window from which text surges, or half of the page's fullest window if that is less.
SURGE = 80

# Elements without content, raw text, blocks, and boilerplate by element, role or class.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("script style noscript template head nav aside form button select option textarea svg canvas object iframe dialog footer menu title audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
CLASSES = frozenset(
    "ad ads adv advert advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget toolbar skip".split()
)
#: Those of them that stand inside a text as well as around it; where they go, the text closes up.
INSIDE = frozenset("ad ads adv advert advertisement adsense sponsor sponsored promo promotion newsletter subscribe subscription signup share sharing social widget skip cookie cookies consent notice notices alert popup modal overlay".split())
#: Words that go with those in names such as "ad-slot" or "related-posts".
WITH = frozenset("area bar block blocks body bottom box button buttons card cards container content footer form group header holder inline inner item items left link links list main page panel post posts right row section site slot sticky story text title top unit wrap wrapper".split())
AROUND = frozenset("nav aside footer header head title menu".split())
#: Elements that an opening tag of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# every repetition is possessive: a tag is scanned once, whether or not it ends
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
_ATTRIBUTES = re.compile(rf"(?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+")
_WORD = re.compile(r"[a-z]+")


def _dropped(name: str, attributes: str, in_article: bool) -> str | None:
    """Whether an element is boilerplate: "around" the text, "inside" it, or None."""
    if name in DROPPED or name == "header" and not in_article:
        return "around" if name in AROUND else "inside"
    if not attributes.strip() or name in ("html", "body", "article", "main"):
        return None
    for key, *values in _ATTRIBUTE.findall(attributes):  # names without a value have empty ones
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return "around"
        if key in ("class", "id"):
            for one in value.split():
                words = _WORD.findall(one)
                # inside an article a name must say nothing else: "social-share" goes, "social-history" is text
                if not CLASSES.isdisjoint(words) and not (in_article and set(words) - CLASSES - WITH):
                    return "around" if INSIDE.isdisjoint(words) else "inside"
    return "inside" if re.search(r"(?:^|\s)hidden(?:\s|$|=)|display\s*:\s*none", attributes, re.I) else None


def pieces(page: str) -> Iterator[str | tuple[bool, str, str, str]]:
    """Texts, and tags as (whether closing, name, attributes, raw content), in one scan.

    Comments and declarations are left out, and so is a tag that the page's end cuts off; a ``<`` that begins neither is text.
    """
    at = text = 0
    while (at := page.find("<", at)) >= 0:
        found, kind = _NAME.match(page, at + 1), page[at + 1 : at + 2]
        if not found and kind not in ("!", "?", "/"):
            at += 1
            continue
        if text < at:
            yield page[text:at]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
        elif not found:
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        else:
            attributes = _ATTRIBUTES.match(page, found.end())
            at, name, raw = attributes.end() + 1, found[2].lower(), ""
            if at <= len(page):
                if name in RAW and not found[1]:
                    end = re.compile(rf"</{name}[\s>/]", re.I).search(page, at)
                    raw, at = (page[at : end.start()], end.start()) if end else (page[at:], len(page))
                yield found[1] == "/", name, attributes[0], raw
        text = at
    if text < len(page):
        yield page[text:]


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters, whether in an article) of each block; characters in links don't count outside articles.

    Boilerplate and article borders are blank lines, the latter marked as in an article.
    """
    lines: list[tuple[str, int, bool]] = []
    words: list[str] = []
    linked = 0  # characters of the open line that stand in links
    stack: list[str] = []
    open_names: Counter[str] = Counter()
    drop_from = links = 0  # height of the stack where dropping began; open links
    articles = 0
    gap_after = False

    def end_line() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            lines.append((text, len(text) if articles else max(0, len(text) - linked), articles > 0))
        words.clear()
        linked = 0

    def gap(border: bool = False) -> None:
        end_line()
        if not articles:
            lines.extend([("", 0, border)] * WINDOW)

    def close(height: int) -> None:
        nonlocal drop_from, links, articles
        while len(stack) > height:
            name = stack.pop()
            open_names[name] -= 1
            if drop_from and len(stack) < drop_from:
                drop_from = 0
                gap() if gap_after else end_line()
            elif not drop_from:
                if name == "a":
                    links -= 1
                elif name in ("article", "main"):
                    end_line()
                    articles -= 1
                    gap(True)
                elif name in BLOCKS:
                    end_line()

    for piece in pieces(page):
        if isinstance(piece, str):
            if not drop_from:
                text = html.unescape(piece)
                words.append(text)
                if links:
                    linked += len(text.strip())
            continue
        closing, name, attributes, raw = piece
        if closing:
            if open_names[name]:
                height = len(stack)
                while stack[height - 1] != name:
                    height -= 1
                close(height - 1)
            elif name in BLOCKS and not drop_from:
                end_line()
            continue
        while stack and stack[-1] in CLOSES.get(name, ()):
            close(len(stack) - 1)
        if name in BLOCKS and not drop_from:
            end_line()
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        stack.append(name)
        open_names[name] += 1
        if raw and not drop_from and name not in DROPPED:
            words.append(raw)
        if not drop_from:
            if kind := _dropped(name, attributes, articles > 0):
                gap_after = kind == "around"
                gap() if gap_after else end_line()
                drop_from = len(stack)
            elif name == "a":
                links += 1
            elif name in ("article", "main"):
                gap(True)
                articles += 1
    close(0)
    end_line()
    return lines


def main_text(page: str) -> str:
    lines = lines_of(page)
    # an article says itself where the text is: its lines surge whatever their length
    if marked := [text for text, _, inside in lines if text and inside]:
        return " ".join(marked)
    return " ".join(text for first, last in _spans(lines) for text, _, _ in lines[first:last] if text)


def _spans(lines: list[tuple[str, int, bool]]) -> list[tuple[int, int]]:
    """The span from a surge to a dive that holds most text, with those that only dropped boilerplate parts from it, as one."""
    own = [n for _, n, _ in lines]
    if not any(own):
        own = [len(text) for text, _, _ in lines]
    if not any(own):
        return []
    padded = own + [0] * WINDOW
    sums = [sum(padded[i : i + WINDOW]) for i in range(len(own))]
    surge = min(SURGE, max(sums) / 2)
    groups: list[list[tuple[int, int]]] = []
    at = 0
    while at < len(own):
        if sums[at] < surge or not own[at]:
            at += 1
            continue
        dive = at
        while dive < len(own) and sums[dive]:
            dive += 1
        first = at
        while first and lines[first - 1][0] and own[first - 1]:
            first -= 1  # the window that surged may begin after a short first line
        between = range(groups[-1][-1][1], first) if groups else ()
        if groups and all(own[i] if lines[i][0] else not lines[i][2] for i in between):
            groups[-1].append((first, dive))
        else:
            groups.append([(first, dive)])
        at = dive + 1
    best = max(groups, key=lambda spans: max(sum(own[first:last]) for first, last in spans))
    return [(best[0][0], best[-1][1])]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return work

    return over_texts(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", each)
