"""HTML extraction by tree scoring."""
from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext
    pre search section summary table tbody td tfoot th thead title tr ul""".split())
DROPPED = frozenset("""head script style noscript template nav footer aside button select option input textarea iframe object embed
    svg math canvas audio video dialog menu title datalist""".split())
CLOSES_P = BLOCK - frozenset("body caption head html optgroup option tbody td tfoot th thead title tr legend li dd dt".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

LINKED = 0.5                  # share of link text up to which what stands beside the article is text

DEEPEST = 1024                # open elements on a path; deeper ones are closed at once, their text stays
DEEPEST_INLINE = 256          # of them such as are no blocks

# Parts of class words, ids and roles (between marks or capitals) that say what is no article text.
_JUNK = re.compile(r"ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|menu|nav\w*|navigation|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|"
                   r"notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|"
                   r"disqus|widget|pagination|pager|paging|toolbar|copyright|complementary|contentinfo")
_COMMENTS = re.compile(r"comments?|commentlist|respond|reply|replies|disqus")
#: Words that can also name an article's subject: inside it they count as a whole class word or role only.
_VAGUE = re.compile(r"side|notice|alert|discussion|search|form|toc|skip|hidden|dialog|sr-only|print-only|noprint")
_LIKELY = re.compile(r"article|body|content|entry|main|post|story|text|hentry|page")
_STATE = re.compile(r"(?:has|with|without|no|not|is)[-_]")
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_INSIDE_TAG = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "length", "linked", "score", "commas", "depth", "inline")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.length = self.linked = self.commas = 0
        self.score = 0.0
        self.depth = parent.depth + 1 if parent else 0
        self.inline = (parent.inline if parent else 0) + (tag not in BLOCK)


def parse(page: str) -> Node:
    """A tree of the page's elements and decoded text; open and unknown tags are tolerated.

    The page is read once: a tag ends at the first > outside quotes, or at the first > at all if none is outside; one
    that the page's end cuts off is dropped with what follows.  Elements nested too deep stay empty and their
    text goes to the place where they stand, so that no end tag has more than DEEPEST elements to look through.
    """
    root = at = Node("html", {}, None)
    pos, end, last = 0, len(page), page.rfind(">")
    deep: dict[str, int] = {}          # open elements too deep to hold text, by name
    opened: dict[str, int] = {}        # elements ever opened, by name
    while pos < end:
        here = page.find("<", pos)
        if here < 0:
            _text(at, page[pos:])
            break
        if here > pos:
            _text(at, page[pos:here])
        if page.startswith("<!--", here):
            stop = page.find("-->", here + 4)
            pos = stop + 3 if stop >= 0 else end
            continue
        closing = page.startswith("</", here)
        m = _NAME.match(page, here + 1 + closing)
        if not m:
            if page.startswith(("<!", "<?"), here):
                stop = page.find(">", here)
                pos = stop + 1 if stop >= 0 else end
            else:
                _text(at, "<")
                pos = here + 1
            continue
        if here > last:
            break
        stop = _INSIDE_TAG.match(page, m.end())
        inner, pos = (page[m.end():stop.end() - 1], stop.end()) if stop else (page[m.end():page.find(">", m.end())], page.find(">", m.end()) + 1)
        if not pos:
            break
        name = m[0].lower()
        if closing:
            if deep.get(name):
                deep[name] -= 1
                at.children.append(Node(name, {}, at))
            elif opened.get(name):
                at = _close(at, name)
            continue
        if name == "html":
            continue
        if name in CLOSES_P and opened.get("p"):
            at = _close(at, "p", inside=True)
        if name in SAME and any(opened.get(x) for x in SAME[name]):
            at = _close_same(at, SAME[name], SCOPES[name])
        attrs = {a.lower(): (b or c or d or "") for a, b, c, d in _ATTR.findall(inner)} if inner else {}
        node = Node(name, attrs, at)
        at.children.append(node)
        if name in VOID or inner.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            body = page[pos:stop.start() if stop else end]
            if body and name not in DROPPED:
                _text(node, body)
            pos = stop.end() if stop else end
            continue
        if node.depth > DEEPEST or node.inline > DEEPEST_INLINE and name not in BLOCK:
            deep[name] = deep.get(name, 0) + 1
            continue
        opened[name] = opened.get(name, 0) + 1
        at = node
    return root


def _text(at: Node, text: str) -> None:
    at.children.append(_html.unescape(text) if "&" in text else text)


#: An end tag or implied end does not reach out of these.
_WALL = frozenset("table td th article section main aside nav header footer body".split())


def _close(at: Node, name: str, inside: bool = False) -> Node:
    """The parent of the innermost open ``name``; the place itself if there is none."""
    node = at
    while node.parent is not None and node.tag != name:
        if node.tag in _WALL and name not in _WALL or inside and node.tag in BLOCK:
            return at
        node = node.parent
    return node.parent if node.parent is not None and node.tag == name else at


def _close_same(at: Node, tags: set[str], scopes: set[str]) -> Node:
    node, found = at, at
    while node.parent is not None and node.tag not in scopes:
        if node.tag in tags:
            found = node.parent
        node = node.parent
    return found


def _unwanted(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    a = node.attrs
    return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or "style" in a and bool(_HIDDEN.search(a["style"])))


def _words(node: Node) -> tuple[list[str], str, list[str]]:
    """Class words, id and roles, without words of a page's state such as has-sidebar."""
    a = node.attrs
    return ([w for w in a.get("class", "").split() if not _STATE.match(w)], a.get("id", "").strip(), a.get("role", "").split())


def _parts(word: str) -> list[str]:
    return [p.lower() for p in _PARTS.split(word) if p]


def _holds(pattern: re.Pattern, words: list[str]) -> bool:
    return any(pattern.fullmatch(p) for w in words for p in _parts(w))


def _is_comments(node: Node) -> bool:
    """Whether class words or the whole id name reader comments."""
    if not node.attrs or node.tag in ("body", "html") or re.fullmatch("h[1-6]", node.tag):
        return False
    words, ident, _ = _words(node)
    return _holds(_COMMENTS, words) or bool(_COMMENTS.fullmatch(ident.lower())) or len(p := _parts(ident)) > 1 and bool(_COMMENTS.fullmatch(p[0])) and p[-1] in ("section", "list", "area")


def _marked(node: Node, in_article: bool) -> bool:
    """Whether class, id or role say that a node is no article text.

    Outside the article any part of them does.  Inside it parts of class words and whole roles and ids do; words that
    can be an article's subject only as whole class words or roles, and ids of headings and sections not at all.
    """
    if not node.attrs or node.tag in ("body", "html"):
        return False
    if _is_comments(node):
        return True
    if _is_article(node) or node.tag == "header" and in_article:
        return False
    words, ident, roles = _words(node)
    if any(_LIKELY.fullmatch(x.lower()) for x in (*words, ident)):
        return False
    if not in_article:
        named = [*words, ident, *roles]
        return _holds(_JUNK, named) or _holds(_COMMENTS, named) or _holds(_VAGUE, named)
    if node.tag != "section" and "section" not in words and not re.fullmatch("h[1-6]", node.tag):
        roles = [*roles, ident]
    return _holds(_JUNK, words) or any(_VAGUE.fullmatch(x.lower()) for x in words) or any(_JUNK.fullmatch(x.lower()) or _VAGUE.fullmatch(x.lower()) and x != "discussion" for x in roles)


def _cut_marked(root: Node, best: Node) -> None:
    """Takes forms and marked nodes out of the tree, whatever they hold, but for those around best."""
    around = set()
    node, article = best, best
    while node is not None:
        around.add(id(node))
        if _is_article(node):
            article = node
        node = node.parent
    left = [(root, root is article)]
    while left:
        node, inside = left.pop()
        node.children = [c for c in node.children if isinstance(c, str) or id(c) in around or not (c.tag == "form" or _marked(c, inside))]
        left += [(c, inside or c is article) for c in node.children if isinstance(c, Node)]


def _set_aside(root: Node, marked: bool) -> list[tuple[Node, list]]:
    """Takes reader comments out of a tree, and if asked for all marked nodes but those around a first heading;
    gives the nodes that lost children with those they had."""
    titled = set()
    left, order = [root], []
    while left:
        node = left.pop()
        order.append(node)
        left += [c for c in node.children if isinstance(c, Node)]
    for node in order:
        if node.tag == "h1":
            while node is not None and id(node) not in titled:
                titled.add(id(node))
                node = node.parent
    lost = []
    for node in order:
        kept = [c for c in node.children if isinstance(c, str) or not (_is_comments(c) or marked and id(c) not in titled and _marked(c, False))]
        if len(kept) < len(node.children):
            lost.append((node, node.children))
            node.children = kept
    return lost


def _prune(root: Node) -> None:
    left = [(root, False)]
    while left:
        node, in_article = left.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _unwanted(c, in_article)]
        left += [(c, in_article or _is_article(c)) for c in node.children if isinstance(c, Node)]


def _measure(root: Node) -> None:
    order: list[Node] = []  # parents before children
    left = [(root, False)]
    while left:
        node, in_link = left.pop()
        in_link = in_link or node.tag == "a"
        node.length = node.linked = node.commas = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                node.length += n
                node.commas += c.count(",") + c.count("，") + c.count("、")
                if in_link:
                    node.linked += n
            else:
                left.append((c, in_link))
        order.append(node)
    for node in reversed(order):
        if node is not root:
            up = node.parent
            up.length += node.length
            up.commas += node.commas
            up.linked += node.linked


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _pass_points(root: Node, out: list[Node]) -> None:
    """A paragraph's points: 1, its commas, and its length in hundreds up to 3.

    The parent gets them whole, the next ancestor half, those above a third of
    that and less.  Text that stands in a container itself counts as a paragraph of it.
    """
    left = [root]
    while left:
        node = left.pop()
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        paragraph = node.tag in ("p", "pre", "blockquote", "td", "dd", "li") or node.tag in ("div", "section", "article", "main", "body") and own
        if paragraph and (size := node.length if node.tag in ("p", "pre") else own) >= 25:
            commas = node.commas if node.tag in ("p", "pre") else sum(c.count(",") for c in node.children if isinstance(c, str))
            points = (1 + commas + min(size / 100, 3)) * (1 - _density(node))
            up, level = (node.parent if node.tag in ("p", "pre", "td", "dd", "li", "blockquote") else node), 0
            while up is not None:
                up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
        out.append(node)
        left += [c for c in reversed(node.children) if isinstance(c, Node)]


def _blocks(root: Node, out: list[str], run: list[str], best: Node | None = None) -> None:
    """The text blocks of a subtree in page order; run gathers the text of the block that is open.
    Lists of links are left out, but for those inside an article or best."""
    left: list[tuple[Node | str | None, bool]] = [(root, False)]  # None: a block ends
    while left:
        node, inside = left.pop()
        if node is None:
            _flush(out, run)
        elif isinstance(node, str):
            run.append(node)
        elif node.tag in ("br", "wbr", "img"):
            run.append(" " if node.tag == "br" else "")
        else:
            inside = inside or node is best or _is_article(node)
            edge = node.tag in BLOCK
            if edge:
                _flush(out, run)
            if not inside and node.tag in ("ul", "ol", "table", "div", "section", "dl") and node.length and _density(node) > 0.66 and node.commas * 20 < node.length:
                continue  # a list of links
            if edge:
                left.append((None, inside))
            left += [(c, inside) for c in reversed(node.children)]


def _flush(out: list[str], run: list[str]) -> None:
    if run:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()


def _best(root: Node) -> Node | None:
    """The container with the most points."""
    nodes: list[Node] = []
    _pass_points(root, nodes)
    best, top = None, 0.0
    for n in nodes:
        bonus = 25 if _is_article(n) else 5 if n.attrs and _holds(_LIKELY, [n.attrs.get("class", ""), n.attrs.get("id", "")]) else 0
        value = (n.score + (bonus if n.length else 0)) * (1 - _density(n)) if n.score or bonus else 0.0
        if value > top and n.tag in BLOCK:
            best, top = n, value
    return best


def main_text(page: str | None) -> str:
    """The article's text, one line a block; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    best = None
    for marked in (True, False):       # marked nodes are looked into only where nothing else holds a paragraph
        lost = _set_aside(root, marked)
        _measure(root)
        best = _best(root)
        for node, children in lost:
            node.children = children
        if best is not None:
            _cut_marked(root, best)
            break
    _measure(root)
    out: list[str] = []
    run: list[str] = []
    if best is None:
        _blocks(root, out, run)
        _flush(out, run)
        return "\n".join(out)
    place = _widest(best)
    loose: list[Node | str] = []  # text and inline elements between two blocks
    for s in place.parent.children if place.parent is not None else [place]:
        if isinstance(s, str) or s.tag not in BLOCK and s is not place:
            loose.append(s)
            continue
        _loose(loose, out, run)
        if s is place or _density(s) <= LINKED:
            _blocks(s, out, run, best)
    _loose(loose, out, run)
    _flush(out, run)
    return "\n".join(out)


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") in ("main", "article")


def _in_article(node: Node | None) -> bool:
    while node is not None and not _is_article(node):
        node = node.parent
    return node is not None


def _widest(best: Node) -> Node:
    """The outermost article or main around best; without one the outermost node beside which unlinked text stands."""
    article, place, node = None, best, best
    while node is not None:
        if _is_article(node):
            article = node
        up = node.parent
        if up is not None and up.length - up.linked > node.length - node.linked:
            place = node
        node = up
    return article or place


def _loose(items: list[Node | str], out: list[str], run: list[str]) -> None:
    size = sum(len(c.strip()) if isinstance(c, str) else c.length for c in items)
    if size and sum(c.linked for c in items if isinstance(c, Node)) <= LINKED * size:
        holder = Node("span", {}, None)
        holder.children = list(items)
        _blocks(holder, out, run)
        _flush(out, run)
    items.clear()


def extract(pages: DataFrame, *, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Every row of pages with its main text.

    Returns <key>, <url>, text string and n_chars long (its code points).

    Scripts, forms, menus, headers and footers of the page, sidebars, notices,
    adverts and reader comments are cut from the tree by element, role and the
    words of class and id, however long they are, but never what lies around the
    best container.  Inside the article (or the best container) words that can be
    its subject count only as whole class words.  Lists of links are left out
    outside the article.  Paragraphs pass points for length and commas to their
    ancestors, discounted by link density; reader comments, and where anything
    else holds a paragraph other marked nodes, give none.  The article or main around the best
    container is kept, or without one the outermost container beside which
    unlinked text stands, with all its siblings that are not mostly links:
    short paragraphs and sections and very long texts are neither dropped nor
    cut.  Character references are decoded, white
    space in a block becomes one space, blocks are joined by a line feed.  Null
    and empty pages, and pages without text, give an empty text.  Repeated rows
    are rows of their own; other columns are ignored.  A page is one row's work:
    nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("u"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                ["k", "u", "text", "n_chars"])

    small_batches(pages.sparkSession)
    src = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("html"))
    kinds = dict(src.dtypes)
    got = src.mapInArrow(run, f"k {kinds['k']}, u {kinds['u']}, text string, n_chars long")
    return got.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
