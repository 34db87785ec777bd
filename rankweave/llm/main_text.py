"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.rows import named, packed, unpacked

# --- Fixed values: element names of HTML and words that name page furniture ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: What an open element of the first name is closed by.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "head", "caption", "tbody", "td", "th", "tr", "thead", "tfoot", "option", "optgroup", "legend"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
#: Elements that an implied end does not reach beyond.
SCOPE = frozenset("table ul ol dl td th body html article section div main button select".split())
#: Elements whose text is never shown as text, or is a control's.
UNSEEN = frozenset(
    "script style noscript template head title iframe svg math canvas video audio object noembed noframes xmp button select textarea input datalist".split()
)
FURNITURE_TAGS = frozenset("nav footer aside menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead toolbar pagination pager "
    "cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup signin login "
    "comment comments commentlist discussion respond reply replies disqus related recommended recommendations share sharing social "
    "widget widgets copyright skip search".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
#: Words that layouts use for elements around everything too.
LAYOUT_WORDS = frozenset("nav navbar menu sidebar sidebars aside banner header topbar footer foot search login signin signup notice notices overlay modal skip".split())
#: Words that name furniture when they stand alone or with a word for a part of a page, and may name a subject beside any other word.
SUBJECT_WORDS = frozenset("consent copyright discussion notice notices promotion related share sharing social subscription".split())
PART_WORDS = frozenset(
    "area article articles bar block blocks body bottom box btn button buttons container content entries entry group heading icon icons inner item items "
    "left line link links list media module more news outer panel posts post right row section sections side story stories text title tools top wrap wrapper".split()
)
HEADER_WORDS = frozenset("header topbar".split())
CONTENT_WORDS = frozenset("content article post entry body story main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What the start tag of a name closes.
CLOSES: dict[str, list[str]] = {}
for _open, _names in CLOSED_BY.items():
    for _name in _names:
        CLOSES.setdefault(_name, []).append(_open)

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: How an element is hinted at: not at all, as furniture or a page around it, as furniture or a subject's part, as furniture, as unseen.
NONE, PERHAPS, SUBJECT, FURNITURE, NEVER = range(5)


def tokens(source: str) -> Iterator[tuple[str, str, str, int]]:
    """Texts and tags in turn: kind (text, open or close), text or lower-case name, attributes, and where the tag ends.

    ``send`` a place to go on from there.  Every character is looked at a bounded
    number of times: what is known to be missing further on (an end of a
    comment, a quote, a bracket) isn't searched again, and after one quote
    that never ends tags end at their first bracket.
    """
    at, end = 0, len(source)
    absent: set[str] = set()
    text = 0

    def find(sign: str, start: int) -> int:
        if sign in absent:
            return -1
        found = source.find(sign, start)
        if found < 0:
            absent.add(sign)
        return found

    def tag_end(start: int) -> int:
        """Where the bracket is that ends a tag's attributes, -1 if there is none."""
        p = start
        while "quotes" not in absent:
            p = _PLAIN.match(source, p).end()
            if p == end:
                return -1 if find(">", start) < 0 else source.find(">", start)
            if source[p] == ">":
                return p
            close = find(source[p], p + 1)
            if close < 0:
                absent.add("quotes")
            p = close + 1
        return find(">", start)

    while at < end:
        begin = find("<", at)
        if begin < 0:
            break
        nxt = source[begin + 1 : begin + 2]
        kind, name, attributes, stop = "", "", "", -1
        if nxt in ("!", "?") and nxt:
            long = "-->" if source.startswith("<!--", begin) else "]]>" if source.startswith("<![CDATA[", begin) else ">"
            stop = find(long, begin + 2)
            stop = stop + len(long) if stop >= 0 else end
        else:
            m = _TAG.match(source, begin + 1)
            if m:
                close = tag_end(m.end())
                if close < 0:  # no tag ends from here on
                    break
                kind, name, attributes, stop = "close" if m[1] else "open", m[2].lower(), source[m.end() : close], close + 1
        if stop < 0:  # a bracket of the text
            at = begin + 1
            continue
        if begin > text:
            yield "text", source[text:begin], "", begin
        moved = None
        if kind:
            moved = yield kind, name, attributes, stop
        at = text = max(stop, moved or 0)
    if text < end:
        yield "text", source[text:], "", end


class Page:
    """Elements of a page in order of their start tags.

    ``events`` are texts (and, as None, block edges) with their element; an
    element's subtree is the range from its number to ``last``.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.last = ["#root"], [-1], [0]
        self.events: list[tuple[int, str | None]] = []
        self.inside = [False]  # an article or the main part
        self.hint = [NONE]
        self.unseen = [False]
        self.body = 0
        self.parse(source)
        self.dropped = self.furniture()

    def parse(self, source: str) -> None:
        stack = [0]
        open_at: dict[str, list[int]] = {}  # depths of the open elements of a name
        scopes, blocks = [0], [0]  # depths of open elements that implied ends stop at, and of blocks

        def close(depth: int) -> None:
            while len(stack) > depth:
                n = stack.pop()
                name = self.tag[n]
                self.last[n] = len(self.tag) - 1
                open_at[name].pop()
                if name in SCOPE:
                    scopes.pop()
                if name in BLOCK:
                    blocks.pop()
                self.edge(n)

        found = tokens(source)
        item = next(found, None)
        while item is not None:
            kind, name, attributes, stop = item
            go = None
            if kind == "text":
                if not self.unseen[stack[-1]]:
                    self.events.append((stack[-1], name))
            elif kind == "close":
                depth = open_at[name][-1] if open_at.get(name) else 0
                if depth and (name in BLOCK or blocks[-1] < depth):  # an inline end tag does not end a block
                    close(depth)
            else:
                depth = max((open_at[x][-1] for x in CLOSES.get(name, ()) if open_at.get(x)), default=0)
                if depth and depth >= scopes[-1]:
                    close(depth)
                if name == "br":
                    if not self.unseen[stack[-1]]:
                        self.events.append((stack[-1], " "))
                elif not (name in ("html", "body") and open_at.get(name)):
                    n = self.add(name, attributes, stack[-1])
                    if name in RAW:
                        tail = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, stop)
                        go = tail.start() if tail else len(source)
                    if name in VOID:
                        self.edge(n)
                    else:
                        open_at.setdefault(name, []).append(len(stack))
                        if name in SCOPE:
                            scopes.append(len(stack))
                        if name in BLOCK:
                            blocks.append(len(stack))
                        stack.append(n)
            try:
                item = found.send(go) if kind != "text" else next(found)
            except StopIteration:
                item = None
        close(1)
        self.last[0] = len(self.tag) - 1

    def add(self, name: str, attributes: str, parent: int) -> int:
        n = len(self.tag)
        hint = self.hinted(name, attributes, self.inside[parent])
        self.tag.append(name)
        self.parent.append(parent)
        self.last.append(n)
        self.inside.append(self.inside[parent] or name in ("article", "main"))
        self.hint.append(hint)
        self.unseen.append(self.unseen[parent] or hint == NEVER)
        if name == "body" and not self.body:
            self.body = n
        self.edge(n)
        return n

    def edge(self, n: int) -> None:
        """A block's edge."""
        if self.tag[n] in BLOCK:
            self.events.append((n, None))

    @staticmethod
    def hinted(name: str, attributes: str, inside: bool) -> int:
        """What an element's name and attributes say of it."""
        if name in UNSEEN:
            return NEVER
        hint = FURNITURE if name in FURNITURE_TAGS or (name == "header" and not inside) else PERHAPS if name == "form" else NONE
        if not attributes:
            return hint
        words: set[str] = set()
        part = subject = NONE
        for key, value in _NAMES.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                return NEVER
            if key == "role" and value.lower() in FURNITURE_ROLES:
                hint = max(hint, PERHAPS if value.lower() == "form" else FURNITURE)
            if key in ("class", "id"):
                for name_ in value.split():
                    own = {w.lower() for w in _WORDS.findall(name_)}
                    if inside and is_subject(own, name, key):
                        subject = SUBJECT
                        continue
                    words |= own
                    # the content of something else, such as ad-content or footer-content, is named by that
                    if own & CONTENT_WORDS and own - CONTENT_WORDS and own - CONTENT_WORDS <= FURNITURE_WORDS:
                        part = max(part, FURNITURE if own & (FURNITURE_WORDS - LAYOUT_WORDS) else PERHAPS)
        if name in ("html", "body"):
            return NONE
        hint = max(hint, subject)
        if words & COMMENT_WORDS:
            return FURNITURE
        if name in ("article", "main") or words & CONTENT_WORDS:
            return hint if name in ("article", "main") else max(hint, part)
        if words & FURNITURE_WORDS - LAYOUT_WORDS:
            return FURNITURE
        if words & LAYOUT_WORDS and not (words & HEADER_WORDS and not words & FURNITURE_WORDS and (inside or name in HEADINGS)):
            return max(hint, PERHAPS)
        return hint

    def furniture(self) -> list[bool]:
        """Elements that don't count: unseen ones and furniture.

        What may be furniture by its name alone (a form, a layout's words) is
        the page itself if the element with the greatest sum of densities lies
        in it, whatever share of the text that is.  A part of an article whose name
        may be that of its subject (``share-price``) is furniture if it is
        less dense than all that is around that element.
        """
        n = len(self.tag)
        sure, out = [False] * n, [False] * n
        for i in range(1, n):
            sure[i] = sure[self.parent[i]] or self.hint[i] >= FURNITURE
        around: set[int] = set()
        density, threshold = [0.0] * n, 0.0
        if PERHAPS in self.hint or SUBJECT in self.hint:
            self.dropped = sure
            density, total = self.densities()
            i = self.leading(density, total)
            threshold = density[i]
            while i > 0:
                around.add(i)
                if i >= self.body:
                    threshold = min(threshold, density[i])
                i = self.parent[i]
        for i in range(1, n):
            thin = self.hint[i] == SUBJECT and i not in around and density[i] < threshold
            out[i] = out[self.parent[i]] or self.hint[i] >= FURNITURE or (self.hint[i] == PERHAPS and i not in around) or thin
        return out

    @staticmethod
    def leading(density: list[float], total: list[float]) -> int:
        """The element with the greatest sum over its children (among equals the outermost); of elements without children the densest."""
        if any(total):
            return max(range(len(total)), key=lambda i: (total[i], -i))
        return max(range(len(density)), key=lambda i: (density[i], -i))

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of every element, and the sum over its children.

        The density is characters per tag, adjusted by how many of both are in
        links; furniture has none and adds nothing to what is around it.
        """
        n = len(self.tag)
        chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for i, text in self.events:
            if text is not None and not self.dropped[i]:
                size = len("".join(text.split()))
                chars[i] += size
                linked[i] += size if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + 1
                links[p] += links[i] + (self.tag[i] == "a")
        ratio = linked[self.body] / max(1, chars[self.body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not self.dropped[i]:
                density[i] = composite_density(chars[i], tags[i], linked[i], links[i], ratio)
                if i:
                    total[self.parent[i]] += density[i]
        self.link_share = [a / max(1, b) for a, b in zip(linked, chars, strict=True)]
        return density, total

    def selected(self) -> list[tuple[int, int]]:
        """Subtrees of the main text, as ranges of elements in page order.

        The element with the greatest sum leads (among equals the outermost).
        The least density on its way up to the body is the threshold: what
        hangs on that way is content if it reaches the threshold, or is a
        heading next to content.  An article or main part on that way has no
        threshold inside: all of it but furniture is content.  Children of the
        leading element that are mostly links and don't reach the threshold are
        not.
        """
        density, total = self.densities()
        if not any(density):
            return []
        best = self.leading(density, total)
        path = [best]
        while path[-1] not in (self.body, 0):
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        whole = [i for i in path if self.tag[i] == "article"] or [i for i in path if self.tag[i] == "main"]
        if whole:  # nested articles belong to the outermost one
            return [(whole[-1], self.last[whole[-1]])]
        on_way = set(path)
        out = []
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            if p == best and self.tag[i] in BLOCK and self.link_share[i] > 0.5 and density[i] < threshold:
                out += [(-i, self.last[i])]  # a menu
            elif p in on_way and i not in on_way and p != best and not best <= i <= self.last[best] and (density[i] >= threshold or self.tag[i] in HEADINGS):
                out.append((i, self.last[i]))
        return [(best, self.last[best]), *out]

    def text(self) -> str:
        blocks: list[str] = []
        parts: list[str] = []
        ranges = self.selected()

        def flush() -> None:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                blocks.append(line)
            parts.clear()

        chosen = bytearray(len(self.tag))
        for a, b in ranges:
            chosen[abs(a) : b + 1] = (b"\0" if a < 0 else b"\1") * (b + 1 - abs(a))
        for n, text in self.events:
            if text is None:  # the edge of furniture parts what is around it
                flush()
            elif chosen[n] and not self.dropped[n]:
                parts.append(text)
        flush()
        return "\n".join(blocks)


def is_subject(words: set[str], element: str, attribute: str) -> bool:
    """Whether a part of an article may be named by its subject: a furniture word beside one that names no part of a page, or a section headed "discussion"."""
    found = words & FURNITURE_WORDS
    if not found or not found <= SUBJECT_WORDS:
        return False
    if words == {"discussion"}:
        return element == "section" and attribute == "id"
    return any(w.isalpha() for w in words - found - PART_WORDS)


def composite_density(chars: int, tags: int, linked: int, links: int, ratio: float) -> float:
    """Composite text density of an element with these characters and tags, of which some are in links; ``ratio`` is the body's linked share."""
    tags, other = max(1, tags), max(1, chars - linked)
    base = math.log(chars / other * linked + ratio * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / max(1, linked) * tags / max(1, links))) / max(1e-3, math.log(base))


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([main_text(x.as_py()) for x in batch["html"]], pa.string())
        yield pa.RecordBatch.from_arrays([batch["row"], found], names=["row", "text"])


def extract_main_text(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Add ``text`` (main text, blocks joined by line ends) and ``n_chars`` (its code points) to the columns ``carry`` of ``pages``.

    All columns are carried by default; equal names, in any case, are replaced.
    A null or empty page, or one of furniture alone, has an empty text; no rows
    give no rows, repeated rows stay.  Markup may be broken: open elements end
    with the page, unknown end tags are ignored, a tag without an end is text.
    Pages of any length take time in proportion to it.
    """
    work = pages.select(packed(pages, ("text", "n_chars"), carry).alias("row"), named(html_col).alias("html"))
    out = work.mapInArrow(_extract, T.StructType([work.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*unpacked(out), "text", F.length("text").cast("long").alias("n_chars"))
