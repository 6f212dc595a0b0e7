"""Main text of web pages by scoring the element tree.

A forgiving parser builds the tree (implied end tags, raw text elements, cut-off pages). What HTML itself declares to be
no text of the page (scripts, styles, forms, nav, footer, aside, the header of the page, such roles) is left out. Each
paragraph passes points (one, one per comma, one per 100 characters up to three) to its parent, half of them to the
grandparent, a quarter to the next. A class or id with a word of menus, sidebars and the like puts an element in doubt:
unless it holds most of the points of the page, it passes on and scores only a tenth, and its text is dropped; what is
named an advert or a comment scores nothing at any size. An
element's score is its points in the share of its text that lies outside links. The element of the highest score is the
container, whatever its tag; it is kept with those siblings that score a fifth as much, or that read like prose, and with
headings beside it. Its blocks come out in page order.

Null or empty html gives an empty text; of a page without any scored paragraph, all of its article, main part or body is
kept. Pages are read whole and each stands for itself, so repeated rows and ties need no rule (the first of equal scores
wins); an empty table gives no rows. Time grows with the length of the page, however deep its elements are nested.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<other>[!?][^>]*)(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?P<close>>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[a-z]+|\d+")

# fixed values: what the elements of HTML are
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes template svg math xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rt rp img br".split())
SCOPES = frozenset("td th table button caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: tag -> (open tags that it ends, tags beyond which it looks no further)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What is never main text, by tag and by role; and words of class or id that put an element in doubt.
OUT_TAGS = frozenset("nav footer aside form head button select dialog menu object canvas audio video".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar sidebars rail widget widgets comment comments commentlist disqus reply replies respond menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer masthead topbar share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar skip".split()
)
#: These are in doubt however much of the page they hold.
CERTAIN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus reply replies respond".split())
#: What such a word says nothing after: class="has-sidebar" is not the sidebar.
ABOUT = frozenset("has no not with without hide show is".split())
DOUBT = 0.1
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "items", "out", "main", "text", "linked", "own", "points", "held", "names", "open_p", "within")

    def __init__(self, tag: str, parent: Node | None, rest: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        self.text = self.linked = 0
        #: Points of a paragraph itself, those passed up to it, and the sum of all below.
        self.own = self.points = self.held = 0.0
        self.names: set[str] = set()
        self.main = tag in ("article", "main")
        #: The paragraph that a block would end here, and whether an article or main part is open.
        self.open_p = self if tag == "p" else None if tag in SCOPES else parent and parent.open_p
        self.within = self.main or bool(parent and parent.within)
        self.out = tag in OUT_TAGS or tag == "header" and not self.within
        for name, a, b, c in ATTRIBUTE.findall(rest) if rest else ():
            name, value = name.lower(), (a or b or c).lower()
            if name == "role":
                self.out |= value in OUT_ROLES
                self.main |= value == "main"
            elif name in ("class", "id") and tag not in HEADINGS and tag not in ("html", "body"):
                for one in value.split():
                    words = WORDS.findall(one)
                    self.names.update(w for k, w in enumerate(words) if w in OUT_WORDS and not (k and words[k - 1] in ABOUT))


def parse(page: str) -> Node:
    """The tree; a node's items are its children and its texts, in order, with out parts left away."""
    root = here = Node("#root", None)
    at, names = 0, Counter()

    def back(node: Node) -> Node:
        up = here
        while up is not node:
            names[up.tag] -= 1
            up = up.parent
        return node

    while at < len(page):
        tag_at = page.find("<", at)
        if tag_at < 0:
            here.items.append(page[at:])
            break
        m = TAG.match(page, tag_at)
        if not m:
            # a bare "<", or quotes that never close: then the tag ends at the next ">"
            end = page.find(">", tag_at) if page[tag_at + 1 : tag_at + 2].isalpha() or page.startswith("</", tag_at) else -2
            here.items.append(page[at:tag_at] if end != -2 else page[at : tag_at + 1])
            at = tag_at + 1 if end == -2 else len(page) if end < 0 else end + 1
            continue
        if tag_at > at:
            here.items.append(page[at:tag_at])
        at = m.end()
        name = m["name"]
        if not name or not m["close"]:
            continue
        name = name.lower()
        if m["end"]:
            if names[name] > 0:
                node = here
                while node.tag != name:
                    node = node.parent
                here = back(node.parent)
            elif name == "p":
                here.items.append(Node("p", here))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end and not m["rest"].endswith("/") else at if m["rest"].endswith("/") else len(page)
            continue
        if name in CLOSES_P and here.open_p:
            here = back(here.open_p.parent)
        if name in ENDS:
            ends, beyond = ENDS[name]
            node, found = here, None
            while node.parent and node.tag not in beyond:
                if node.tag in ends:
                    found = node
                node = node.parent
            here = back(found.parent) if found else here
        node = Node(name, here, m["rest"])
        here.items.append(node)
        if name not in VOID and not (m["rest"].endswith("/") and name not in CLOSES_P):
            here = node
            names[name] += 1
    return root


def clean(text: str) -> str:
    return " ".join(references.unescape(text).split())


def blocks(node: Node, kept=None) -> list[str]:
    """The texts of the blocks below a node, or below those of its items that are kept."""
    out, run, todo = [], [], [iter(node.items if kept is None else kept)]
    tags = [node.tag]

    def put() -> None:
        if run and (text := clean("".join(run))):
            out.append(text)
        run.clear()

    while todo:
        for item in todo[-1]:
            if isinstance(item, str):
                run.append(item)
            elif item.out:
                put()
            else:
                if item.tag in VOID or item.tag not in INLINE:
                    run.append(" ") if item.tag in INLINE else put()
                tags.append(item.tag)
                todo.append(iter(item.items))
                break
        else:
            todo.pop()
            if tags.pop() not in INLINE:
                put()
    put()
    return out


def measured(root: Node) -> list[Node]:
    """All nodes that count, parents before children, with their characters, those in links, and their points; elements in
    doubt are marked as out."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        order.append((node, linked))
        todo += [(x, linked or x.tag == "a") for x in reversed(node.items) if not isinstance(x, str) and not x.out]
    for node, linked in reversed(order):
        own = clean(" ".join(x for x in node.items if isinstance(x, str)))
        node.text += len(own)
        node.linked += len(own) * linked
        flat = all(isinstance(x, str) or x.tag in INLINE for x in node.items)
        if node.tag in PARAGRAPHS and (node.tag == "p" or own and flat) and (size := node.text - node.linked) >= 1:
            commas = "".join(x if isinstance(x, str) else " ".join(blocks(x)) for x in node.items).count(",")
            node.own = (1 + commas + min(size // 100, 3)) * size / node.text
        node.held += node.own
        if node.parent:
            node.parent.text += node.text
            node.parent.linked += node.linked
            node.parent.held += node.held
    for node, _ in reversed(order):
        node.out = bool(node.names) and (node.held <= root.held / 2 or not CERTAIN.isdisjoint(node.names))
        if node.parent:
            node.parent.points += weight(node) * (node.own + node.points / 2)
    return [n for n, _ in order]


def weight(node: Node) -> float:
    return 1.0 if not node.out else 0.0 if not CERTAIN.isdisjoint(node.names) else DOUBT


def score(node: Node) -> float:
    return weight(node) * node.points * (1 - node.linked / node.text) if node.text else 0.0


def belongs(node: Node, best: Node) -> bool:
    """Whether a sibling of the container is kept with it."""
    if node is best or node.out:
        return node is best
    if node.tag in HEADINGS or score(node) >= 0.2 * score(best):
        return True
    if node.tag in ("header", "hgroup"):
        return any(not isinstance(x, str) and x.tag in HEADINGS for x in node.items)
    prose = node.held > 0 and node.text and node.linked < 0.25 * node.text
    return bool(prose) and (node.tag in PARAGRAPHS and node.tag not in ("div", "section") or node.text >= 80)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = measured(root)
    best = max(nodes, key=score)
    if score(best) <= 0:
        mains = [n for n in nodes if n.main] or [n for n in nodes if n.tag == "body"]
        return "\n\n".join(blocks(mains[0] if mains else root))
    best.out = False
    if best.tag in ("html", "body") or not best.parent:
        return "\n\n".join(blocks(best))
    return "\n\n".join(blocks(best.parent, [x for x in best.parent.items if not isinstance(x, str) and belongs(x, best)]))


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars, one row per row of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(page) for page in batch.pop("html")]
            batch["n_chars"] = batch["text"].str.len().astype("int64")
            yield batch

    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return map_batches(rows, "page_id", run, "url string, text string, n_chars long")
