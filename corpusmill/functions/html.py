"""HTML columns: title, links, and structured plain text by a streaming parser."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import WHITE
from corpusmill.schema import UNTITLED

R = TypeVar("R")
#: Elements whose subtree is no content.
NOISE = frozenset("nav footer header script style noscript aside".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: No character: it keeps the ampersand before it from being read as the start of a reference.
_MARK = "\ufdd0"


class _Node:
    __slots__ = ("tag", "parts", "attrs")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None) -> None:
        self.tag, self.parts, self.attrs = tag, [], attrs or {}


class _Tree(HTMLParser):
    """Builds a tree; p and li end implicitly, stray end tags are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.count: Counter = Counter()  # open elements by tag, so that no start tag searches a deep stack in vain

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._close("p", stop=("",))
        if tag == "li":
            self._close("li", stop=("ul", "ol"))
        node = _Node(tag, {k: v and _unmarked(v) for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, stop=())

    def _close(self, tag: str, stop: tuple[str, ...]) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.count.subtract(x.tag for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections are comments that end at the next `>`, whatever they say; a broken one takes the rest."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(_unmarked(data))


def _unmarked(text: str) -> str:
    return text.replace("&" + _MARK, "&")


def parse(html: str, names: tuple[str, ...] | None = None) -> _Node:
    """The tree of a page. names: only these character references are read, with their semicolon; by default all are, as browsers read them, a cut `&amp` too."""
    tree = _Tree()
    tree.feed(html if names is None else re.sub(rf"&(?!(?:{'|'.join(names)});)", "&" + _MARK, html))
    tree.close()
    return tree.root


def _find(node: _Node, tag: str) -> _Node | None:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag == tag:
            return x
        stack.extend(p for p in reversed(x.parts) if isinstance(p, _Node))
    return None


def _walk(node: _Node) -> Iterator[_Node | str]:
    """Everything below a node in document order. An explicit stack: pages may nest as deep as they like."""
    stack = list(reversed(node.parts))
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, _Node):
            stack.extend(reversed(x.parts))


def _inner(node: _Node) -> str:
    return "".join(x for x in _walk(node) if isinstance(x, str))


def render(root: _Node) -> str:
    """Text with the structure of headings, paragraphs, lists and code. Children are joined without a separator."""
    frames: list[tuple[_Node, bool, Iterator, list[str]]] = [(root, False, iter(root.parts), [])]
    while True:
        node, inside_pre, parts, made = frames[-1]
        for p in parts:
            if isinstance(p, str):
                made.append(p)
            elif p.tag not in NOISE:
                frames.append((p, node.tag == "pre", iter(p.parts), []))
                break
        else:
            frames.pop()
            text = _framed(node.tag, "".join(made), inside_pre)
            if not frames:
                return text
            frames[-1][3].append(text)


def _framed(tag: str, inner: str, inside_pre: bool) -> str:
    match tag:
        case "h1" | "h2" | "h3":
            return f"\n\n{'#' * int(tag[1])} {inner.strip(WHITE)}\n\n"
        case "h4" | "h5" | "h6":
            return f"\n\n#### {inner.strip(WHITE)}\n\n"
        case "p":
            return f"\n\n{inner.strip(WHITE)}\n\n"
        case "li":
            return f"\n* {inner.strip(WHITE)}\n"
        case "ul" | "ol":
            return f"\n{inner}\n"
        case "br":
            return "\n"
        case "code" if inside_pre:
            return inner
        case "pre" | "code":
            return f"\n```\n{inner}\n```\n"
    return inner


def clean(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r" \n", "\n", text)
    text = re.sub(r"\n ", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(WHITE)


def is_bypassed(url: str | None) -> bool:
    """Pages about people keep their whole layout, whatever the mode."""
    low = (url or "").lower()
    return "about" in low or "team" in low


#: Elements that hold running text, and those that may hold a page's content.
_PROSE = frozenset("p pre blockquote td dd".split())
_HOLDERS = frozenset("article main section div td body blockquote".split())
#: What a class or id says about an element: words that raise and lower its score.
_RAISES = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
_LOWERS = re.compile(r"ad-|advert|banner|comment|crumb|foot|menu|nav|promo|related|share|sidebar|social|sponsor|widget", re.I)
#: Characters that a piece of prose has to have to count, and that the chosen content has to have.
PROSE_CHARS, CONTENT_CHARS = 25, 140


class _Weights:
    """Sums over an element's subtree: characters of text, of them inside links, and the scores of its prose."""

    __slots__ = ("chars", "commas", "linked", "score")

    def __init__(self) -> None:
        self.chars = self.commas = self.linked = 0
        self.score = 0.0


def _weigh(root: _Node) -> dict[int, _Weights]:
    """Weights of all elements by identity, from one pass from the leaves up; noise weighs nothing.

    A piece of prose earns a point, one for each comma and one for each 100 characters up to three, less the share of its text that is
    links. All goes to the holder around it, half to that one's holder, and less than half if the name of the first lowers its score.
    """
    out: dict[int, _Weights] = {}
    frames: list[tuple[_Node, Iterator, _Weights, list[_Node]]] = [(root, iter(root.parts), _Weights(), [])]
    while frames:
        node, parts, w, holders = frames[-1]
        for p in parts:
            if isinstance(p, str):
                text = p.strip(WHITE)
                w.chars += len(text)
                w.commas += text.count(",")
            elif p.tag not in NOISE:
                inner = [*holders[-1:], node] if node.tag in _HOLDERS else holders
                frames.append((p, iter(p.parts), _Weights(), inner))
                break
        else:
            frames.pop()
            # A holder's prose may have put points here before the holder is done.
            earned = out.get(id(node))
            w.score += earned.score if earned else 0.0
            out[id(node)] = w
            if node.tag == "a":
                w.linked = w.chars
            if node.tag in _PROSE and w.chars >= PROSE_CHARS:
                points = (1 + w.commas + min(w.chars / 100, 3)) * (1 - w.linked / w.chars)
                share = 1.0
                for at in reversed(holders[-2:]):
                    out.setdefault(id(at), _Weights()).score += points * share
                    share = min(1.0, _named(at)) / 2
            if frames:
                up = frames[-1][2]
                up.chars, up.commas, up.linked = up.chars + w.chars, up.commas + w.commas, up.linked + w.linked
    return out


def _named(node: _Node) -> float:
    name = f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}"
    factor = 1.25 if node.tag in ("article", "main") else 1.0
    return factor * (1.25 if _RAISES.search(name) else 1.0) * (0.4 if _LOWERS.search(name) else 1.0)


def _main(root: _Node) -> _Node | None:
    """The element with the best score for its prose: weighed by its name and by the share of its text that is not links; the first of equal ones.

    None where no element has enough text of its own to go by: the page is taken whole then.
    """
    weights, best, most = _weigh(root), None, 0.0
    for node in _walk(root):
        if isinstance(node, _Node) and node.tag in _HOLDERS and id(node) in weights:
            w = weights[id(node)]
            score = w.score * _named(node) * (1 - w.linked / w.chars) if w.chars >= CONTENT_CHARS else 0.0
            if score > most:
                best, most = node, score
    return best or _find(root, "article") or _find(root, "main")


def _text_of(root: _Node, url: str | None, mode: str) -> str:
    start = _find(root, "body") or root
    if mode == "main_content" and not is_bypassed(url):
        start = _main(root) or start
    return clean(render(start))


def _title_of(root: _Node) -> str:
    node = _find(root, "title")
    return (_inner(node).strip(WHITE) if node else "") or UNTITLED


def _links_of(root: _Node) -> list[str]:
    hrefs = ((x.attrs.get("href") or "").strip(WHITE) for x in _walk(root) if isinstance(x, _Node) and x.tag == "a")
    return [h for h in hrefs if h]


def _read(html: str | None, of: Callable[[_Node], R], failed: R, names: tuple[str, ...] | None = None) -> R:
    """What `of` finds in a page; `failed` for a page that cannot be read, so that one page never ends a job."""
    try:
        return of(parse(html or "", names))
    except Exception:
        return failed


def extract_one(url: str | None, html: str | None, mode: str = "full_page") -> str | None:
    return _read(html, lambda root: _text_of(root, url, mode), None)


def title_one(html: str | None, names: tuple[str, ...] | None = None) -> str:
    return _read(html, _title_of, UNTITLED, names)


def links_one(html: str | None) -> list[str]:
    return _read(html, _links_of, [])


def page_one(url: str | None, html: str | None, mode: str = "full_page", names: tuple[str, ...] | None = None, title_names: tuple[str, ...] | None = None) -> dict:
    """Title, text and links from one parse; a page that cannot be read has nulls and the reason in `error`. title_names: names for the title, where they are others."""
    try:
        root = parse(html or "", names)
        title = _title_of(root)
        if title_names is not None and "&" in (html or ""):
            # What comes before its end tag is enough for the title, unless that tag is part of a comment or script.
            early = _find(parse(html[: html.find("</title>") + 8], title_names), "title")
            title = _title_of(early if early else parse(html, title_names))
        return {"title": title, "content": _text_of(root, url, mode), "links": _links_of(root), "error": None}
    except Exception as e:  # a page that fails is a row, not the end of the run
        return {"title": None, "content": None, "links": [], "error": f"{type(e).__name__}: {e}"}


@F.arrow_udf(T.ArrayType(T.StringType()))
def _links(html: pa.Array) -> pa.Array:
    return pa.array([links_one(h.as_py()) for h in html], pa.list_(pa.string()))


def title(html: Column, names: tuple[str, ...] | None = None) -> Column:
    """Text of the first title element, trimmed; a fixed name where there is none. names: as in `parse`."""

    @F.arrow_udf(T.StringType())
    def run(h: pa.Array) -> pa.Array:
        return pa.array([title_one(x.as_py(), names) for x in h], pa.string())

    return run(html)


def links(html: Column) -> Column:
    """href of every anchor in document order, trimmed, empty ones left out, duplicates kept."""
    return _links(html)


def page(url: Column, html: Column, mode: str = "full_page", names: tuple[str, ...] | None = None, title_names: tuple[str, ...] | None = None) -> Column:
    """Struct of title, content, links and error, the page parsed once. names, title_names: as in `page_one`."""
    if mode not in ("full_page", "main_content"):
        raise ValueError(f"unknown mode {mode!r}")
    text, texts = T.StringType(), T.ArrayType(T.StringType())

    @F.arrow_udf(T.StructType([T.StructField("title", text), T.StructField("content", text), T.StructField("links", texts), T.StructField("error", text)]))
    def run(u: pa.Array, h: pa.Array) -> pa.Array:
        out = [page_one(a.as_py(), b.as_py(), mode, names, title_names) for a, b in zip(u, h, strict=True)]
        return pa.array(out, pa.struct([("title", pa.string()), ("content", pa.string()), ("links", pa.list_(pa.string())), ("error", pa.string())]))

    # Not deterministic as far as the optimizer knows, or a filter by what was read parses every page a second time.
    return run.asNondeterministic()(url, html)


def to_text(url: Column, html: Column, mode: str = "full_page") -> Column:
    """Structured plain text, null for a page that cannot be read. mode main_content takes the element that scores best for its prose, else the article or main element, else the page."""
    if mode not in ("full_page", "main_content"):
        raise ValueError(f"unknown mode {mode!r}")

    @F.arrow_udf(T.StringType())
    def run(u: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([extract_one(a.as_py(), b.as_py(), mode) for a, b in zip(u, h, strict=True)], pa.string())

    return run(url, html)


def title_or_default(*titles: Column) -> Column:
    """The first title that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in titles], F.lit(UNTITLED))
