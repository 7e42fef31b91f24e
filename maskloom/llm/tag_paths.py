"""Main text of web pages by tag-path ratios.

Each text node belongs to the path of tags from the root to it.  Text length outside
links and punctuation are summed per path and divided by the path's nodes; both ratios
are smoothed along the page, mostly among nodes of one path, fused into one score, averaged per path and compared with a
share of the best path, which is halved until half of the text is reached.  Blocks with a node of a path above it are content.  They fix where
the text is: in the articles (or main elements) that hold them, if these hold most of the content,
else from the first content block, with the headings right before it, to the last.
In there the gaps are filled, so short paragraphs stay, but not lists of links, nor links
before or after the content.

Never part of it are menus, headers (an article's own too), footers, asides, forms, scripts and styles
by their tags, and parts that class, id or role call comments, sidebar, notice, advert or the like,
whatever their share of the page.  A name that only contains such a word ("right-sidebar",
"category-legal") may belong to a wrapper around the text: it lowers the scores of what it
marks by far, which decides if there is text without it and changes nothing if there is
none.  So does a plain name on or around an article, unless it means comments; a name that only
contains such a word says nothing of what is around an article.

Pages are independent, so this is one narrow pass without a shuffle.

Results for odd input: null, empty and text-free pages give an empty text; tags that are
never closed, stray end tags and a cut-off last tag are tolerated; repeated rows are
extracted one by one, null ids and urls are kept; very long pages are read in whole, in
time that grows with their length.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import arrow_map

#: A path holds content from this share of the best path's score on.
THRESHOLD = 0.3
#: Weights of the neighbours in page order, for smoothing.
_KERNEL = (0.1, 0.2, 0.4, 0.2, 0.1)
#: What a neighbour of another path weighs, against one of the same path.
_STRANGER = 0.2
#: What a score is multiplied with under an uncertain mark.
LOWERED = 0.05

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|<(?![a-zA-Z/!?])|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL)
_TAG_BEGIN = re.compile(r"<[/!?a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp"}
#: Parts without text of the article.  An end tag of what is around ends one that is not closed.
_HOLDERS = {"noscript", "template", "select", "svg", "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby s samp small "
              "span strike strong sub sup time tt u var wbr rp rt annotation annotation-xml math menclose merror mfenced mfrac mi "
              "mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd "
              "mtext mtr munder munderover semantics".split())
#: Elements that hold no article text, whatever they are called.
_APART = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "head", "figure-caption"} | _HOLDERS
#: Fixed value: words in class, id or role that mark a part as something else.
_WORDS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|"
    r"cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|"
    r"recommended|comments?|commentlist|reply|replies|respond|disqus|widget|toolbar|complementary|contentinfo|search|copyright|"
    r"legal|disclaimer|pagination|pager)")
_MARKED = re.compile(rf"(?:^|[\s_-]){_WORDS}(?=$|[\s_-])", re.I)
#: A name made of nothing but such words.
_CERTAIN = re.compile(rf"(?:^|(?<=\s)){_WORDS}(?:[_-]+(?:{_WORDS}|bar|box|list|links|section|area|block|wrapper|container|form|\d+))*(?=$|\s)", re.I)
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|reply|replies|respond|disqus)(?=$|[\s_-])", re.I)
#: Classes that say what an article is about.
_TOPIC = re.compile(r"(?:^|(?<=\s))(?:category|tag)-\S+", re.I)
#: A new one of these ends an open one.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                    "pre section table ul".split())
_SCOPE = {"html", "body", "article", "main", "section", "div", "table", "ul", "ol", "td", "th", "blockquote", "noscript", "template",
          "foreignobject"}
#: Elements that can't be in a drawing or a list of choices, and so end one.
_END_HOLDER = {"svg": _BLOCKS_END_P | set("b big br center code em i img li small span strike strong sub sup tt u var".split()),
               "select": _BLOCKS_END_P - {"div", "hr"}}
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


class _Element:
    """An open or closed element; ``path`` is the number of its tag path in the page.

    ``mark`` is what names say of it: ``certain``, ``readers`` (certainly comments), ``uncertain`` or empty, and
    ``marked`` the innermost element at or above it that has one.
    """

    __slots__ = ("tag", "path", "parent", "apart", "depth", "link", "body", "mark", "marked")

    def __init__(self, tag: str, parent: "_Element | None", kind: str, path: int) -> None:
        self.tag, self.parent, self.path = tag, parent, path
        self.apart = kind == "apart" or bool(parent and parent.apart)
        self.mark = kind if kind != "apart" else ""
        self.marked = self if self.mark else parent.marked if parent else None
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.body = self if tag in ("article", "main") else parent.body if parent else None


def _kind(tag: str, attributes: str) -> str:
    """``apart`` for no part of an article, or the mark that its names put on an element."""
    if tag in _APART:
        return "apart"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    kind, seen = "", set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in seen:
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "apart"
        if name in ("class", "id", "role"):
            value = _TOPIC.sub("", value) if tag == "article" else value
            names = _CERTAIN.findall(value) if kind != "readers" else []
            if any(_READERS.search(m) for m in names):
                kind = "readers"
            elif names and tag != "article" and kind != "readers":
                kind = "certain"
            elif not kind and _MARKED.search(value):
                kind = "uncertain"
    return kind


def text_nodes(page: str) -> list[tuple[_Element, str, bool]]:
    """Element, text and whether a block begins before it, in page order; markup, scripts and styles left out."""
    ignored: set[int] = set()
    while True:
        out, unclosed = _parsed(page, ignored)
        if not unclosed:
            return out
        # A holder that nothing ends but the page would take in the rest of it.
        ignored |= unclosed


def _parsed(page: str, ignored: set[int]) -> tuple[list[tuple[_Element, str, bool]], set[int]]:
    """The text nodes without the start tags at ``ignored``, and where holders begin that end with the page only."""
    out: list[tuple[_Element, str, bool]] = []
    at = _Element("", None, "", 0)
    paths: dict[tuple[int, str, str], int] = {}
    opened: dict[str, int] = {}
    holders: dict[_Element, int] = {}
    unclosed: set[int] = set()
    end, new_block, size = 0, True, len(page)
    # No tag ends after this, so none is looked for there.
    last = page.rfind(">") + 1

    def close_to(parent: _Element) -> None:
        nonlocal at
        while at is not parent:
            opened[at.tag] -= 1
            at = at.parent

    def put(text: str) -> None:
        nonlocal new_block
        if text and not opened.get("annotation") and not opened.get("annotation-xml"):
            out.append((at, references.unescape(text) if "&" in text else text, new_block))
            new_block = False

    def end_of_page() -> None:
        element = at
        while holders and element.parent:
            if element in holders:
                unclosed.add(holders[element])
            element = element.parent

    while end < size:
        token = _TOKEN.search(page, end, last)
        if token is None:
            cut = _TAG_BEGIN.search(page, max(end, last))
            put(page[end : cut.start()] if cut else page[end:])
            break
        put(page[end : token.start()])
        end, tag = token.end(), token[2]
        if not tag:
            if token[0].startswith("<!--") and not token[0].endswith("-->"):
                break
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            new_block = True
        if token[1]:
            if not opened.get(tag):
                continue
            open_one = at
            while open_one.parent and open_one.tag != tag:
                # A stray end tag of text style does not close what is around it.
                if tag in _INLINE and open_one.tag not in _INLINE:
                    break
                open_one = open_one.parent
            if open_one.parent and open_one.tag == tag:
                if tag in ("html", "body"):
                    end_of_page()
                close_to(open_one.parent)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(page, end)
            end = close.end() if close else size
            continue
        for holder, breaks in _END_HOLDER.items():
            if opened.get(holder) and tag in breaks:
                open_one = at
                while open_one.parent and open_one.tag != holder and open_one.tag not in ("noscript", "template", "foreignobject"):
                    open_one = open_one.parent
                if open_one.tag == holder:
                    close_to(open_one.parent)
        if tag in _VOID or token.start() in ignored:
            continue
        drawn = tag in ("svg", "math") or (opened.get("svg") or opened.get("math")) and not opened.get("foreignobject")
        if drawn and token[3].endswith("/"):
            continue
        ends = _SELF_CLOSING.get(tag, set()) | ({"p"} if tag in _BLOCKS_END_P else set())
        ends = {e for e in ends if opened.get(e)}
        open_one = at
        while ends and open_one.parent and (open_one.tag not in _SCOPE or open_one.tag in ends):
            if open_one.tag in ends:
                close_to(open_one.parent)
                break
            open_one = open_one.parent
        if not token[3].endswith("/") or tag not in _INLINE:
            kind = _kind(tag, token[3])
            path = paths.setdefault((at.path, tag, kind), len(paths) + 1)
            at = _Element(tag, at, kind, path)
            opened[tag] = opened.get(tag, 0) + 1
            if tag in _HOLDERS:
                holders[at] = token.start()
    end_of_page()
    return out, unclosed


def _weight(element: _Element) -> float:
    """How much an element's text counts, by what its names say."""
    if element.apart:
        return 0.0
    mark = element.marked
    while mark is not None and not mark.mark:
        mark = mark.parent.marked
    return 1.0 if mark is None else LOWERED


def path_scores(nodes: list[tuple[_Element, str]]) -> dict[int, float]:
    """Fused, smoothed ratio of each path; ``nodes`` have visible text only."""
    paths: dict[int, int] = {}
    of = np.array([paths.setdefault(e.path, len(paths)) for e, _ in nodes])
    length = np.array([0 if e.link or e.apart else len(t.strip()) for e, t in nodes], float)
    marks = np.array([0 if e.link or e.apart else len(_PUNCTUATION.findall(t)) for e, t in nodes], float)
    count = np.bincount(of)
    fused = np.ones(len(nodes))
    # The page's ends are continued by their last node.
    wide = np.pad(of, 2, mode="edge")
    shares = np.stack([k * np.where(wide[i : i + len(of)] == of, 1.0, _STRANGER) for i, k in enumerate(_KERNEL)])
    shares /= shares.sum(0)
    for values in (length, marks + 1):
        ratio = (np.bincount(of, values) / count)[wide]
        smooth = sum(share * ratio[i : i + len(of)] for i, share in enumerate(shares))
        fused *= smooth / max(smooth.max(), 1e-9)
    # A part that is marked as something else has no share in its neighbours' score; a node of links gets none from them.
    weight = np.array([0.0 if e.link else _weight(e) for e, _ in nodes])
    return dict(zip(paths, (np.bincount(of, np.sqrt(fused) * weight) / count).tolist()))


def _set_apart(elements: set[_Element], text: set[_Element]) -> None:
    """Makes what is certainly marked apart, with all in it; ``text`` are the elements that hold visible text."""
    around: set[_Element] = set()
    for element in elements:
        # What is around an article is a wrapper, whatever its name, unless that means comments.
        body = element.body
        if body is not None and body.mark != "readers" and body not in around:
            around.add(body)
            mark = body.parent.marked
            while mark is not None and mark.mark != "readers" and mark not in around:
                around.add(mark)
                mark.mark = "uncertain" if mark.mark == "certain" else ""
                mark = mark.parent.marked
    gone: dict[_Element | None, str] = {None: ""}

    def fate(mark: _Element | None) -> str:
        line = []
        while mark not in gone:
            line.append(mark)
            mark = mark.parent.marked
        for m in reversed(line):
            above = gone[m.parent.marked]
            gone[m] = "readers" if "readers" in (above, m.mark) else "certain" if "certain" in (above, m.mark) else ""
        return gone[line[0] if line else mark]

    # Comments go always; other marks don't take the only text there is.
    plain = any(not e.apart and not fate(e.marked) for e in text)
    for element in elements:
        said = fate(element.marked)
        element.apart |= said == "readers" or said == "certain" and plain


class _Block:
    """Text without a block boundary in it."""

    __slots__ = ("first", "text", "links", "content")

    def __init__(self, first: _Element) -> None:
        self.first, self.text, self.links, self.content = first, [], True, False


def _blocks(nodes: list[tuple[_Element, str, bool]], scores: dict[int, float], least: float) -> list[_Block]:
    """The blocks that hold visible text, parts that are apart left out."""
    blocks: list[_Block] = []
    gap = True
    for element, text, new_block in nodes:
        gap |= new_block
        if element.apart:
            gap = True
            continue
        if gap:
            blocks.append(_Block(element))
            gap = False
        block = blocks[-1]
        block.text.append(text)
        if text.strip():
            block.links &= element.link
            block.content |= scores[element.path] >= least > 0
    return [b for b in blocks if "".join(b.text).strip()]


def _heading(block: _Block) -> bool:
    element = block.first
    while element.tag in _INLINE and element.parent:
        element = element.parent
    return element.tag in ("h1", "h2", "h3", "h4", "h5", "h6")


def _between(blocks: list[_Block], ends: bool) -> list[_Block]:
    """The blocks with the gaps between content filled; with ``ends`` also what is before and after, but for links."""
    at = [i for i, b in enumerate(blocks) if b.content]
    if not at:
        return []
    first, last = at[0], at[-1]
    while first > 0 and _heading(blocks[first - 1]) and not blocks[first - 1].links:
        first -= 1
    if ends:
        first, last = 0, len(blocks) - 1
        while blocks[first].links and not blocks[first].content:
            first += 1
        while blocks[last].links and not blocks[last].content:
            last -= 1
    named: set[_Element] = set()
    for i in at:
        mark = blocks[i].first.marked
        while mark is not None and mark not in named:
            named.add(mark)
            mark = mark.parent.marked
    kept = []
    for i in range(first, last + 1):
        block = blocks[i]
        if not block.content:
            listed = block.links and any(0 <= j < len(blocks) and blocks[j].links for j in (i - 1, i + 1))
            lowered = _weight(block.first) < 1 and block.first.marked not in named
            if listed or lowered:
                continue
        kept.append(block)
    return kept


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    nodes = text_nodes(page) if page else []
    _set_apart({e for e, _, _ in nodes}, {e for e, t, _ in nodes if t.strip()})
    shown = [(e, t) for e, t, _ in nodes if t.strip() and not e.apart]
    if not shown:
        return ""
    # Apart nodes take part in the smoothing, with nothing of their own.
    scores = path_scores([(e, t) for e, t, _ in nodes if t.strip()])
    best = max(scores.values())
    # Half of the text that counts is content at least: where no path stands out, more of them are.
    mass = [(scores[e.path], 0 if e.link else len(t.strip()) * _weight(e)) for e, t in shown]
    while best and 2 * sum(m for score, m in mass if score >= threshold * best) < sum(m for _, m in mass):
        threshold /= 2
    blocks = _blocks(nodes, scores, threshold * best)
    inside: dict[_Element, list[_Block]] = {}
    held = {True: 0, False: 0}
    for block in blocks:
        body = block.first.body
        if body is not None:
            inside.setdefault(body, []).append(block)
        if block.content:
            held[body is not None] += sum(map(len, block.text))
    if held[True] and held[True] >= held[False]:
        chosen = {b for own in inside.values() for b in _between(own, True)}
    else:
        chosen = set(_between([b for b in blocks if b.first.body is None], False)) or set(blocks)
    return " ".join(" ".join("".join(b.text) for b in blocks if b in chosen).split())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``url`` and ``text`` of every row."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batch):
        return {key: batch.column(0), url: batch.column(1),
                "text": [main_text(p, threshold) for p in batch.column(2).to_pylist()]}

    return arrow_map(pages.select(key, url, html), f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string", run, 128)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
