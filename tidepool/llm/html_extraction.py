"""Main text of HTML pages by composite text density.

Every node of the page gets the composite density of its subtree: characters per tag, adjusted by the share of linked
characters and tags against those of the whole body. The node with the largest sum of child densities is the core; the
least density on its path up to the body is the threshold that what joins it must reach (see `_Density.chosen`). Before
that, elements that are boilerplate by their meaning (navigation, scripts, forms, notices, adverts, reader comments) are
silenced; after it, lists of links below the threshold leave the result. The blocks are joined in page order.

Defined results: null, empty and textless html give an empty text; markup that is not closed is closed as browsers do for
paragraphs, list items and table parts; pages of any length and depth are read in one pass, in linear time; repeated rows
are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("dd dt li legend summary tbody td tfoot th thead tr body html".split())
#: An opening tag ends an open element of the same family, unless a container of that family lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_SILENT = frozenset("head script style noscript template title iframe object embed svg math canvas audio video map select option textarea button input label nav footer aside menu dialog search datalist".split())
#: Parts of class names and ids that mark boilerplate, and parts that may stand beside them without changing that.
_NOISE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup "
    "comment comments disqus respond replies share sharing social related recommended footer header masthead topbar copyright pagination pager login skip".split()
)
_NEUTRAL = frozenset(
    "site page main global post article entry content body top bottom left right primary secondary inner outer list area section box container wrapper wrap block slot unit bar panel link links button buttons posts articles items item media icons form widget group row col column thread title heading text js".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_a-zA-Z]+")
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())


def _named(marks: str) -> bool:
    """Whether a class or id is made of boilerplate words and neutral ones alone."""
    for mark in marks.split():
        parts = [x.lower() for x in _PARTS.findall(mark)]
        if any(x in _NOISE for x in parts) and all(x in _NOISE or x in _NEUTRAL or x.isdigit() for x in parts):
            return True
    return False


class _Tree(HTMLParser):
    """Nodes in page order: parents, tags, noise by element (noise) and by class or id (named); text pieces with the node that holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.noise, self.named = ["html"], [-1], [False], [False]
        self.pieces: list[tuple[int, str]] = []
        self.open = [0]
        self.depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.tag[self.open.pop()]].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in _CLOSES_P and self.depths["p"]:
            self._close_to(self.depths["p"][-1])
        elif tag in _ENDS:
            family, walls = _ENDS[tag]
            wall = max((self.depths[x][-1] for x in walls if self.depths[x]), default=0)
            inside = [d[at] for x in family if (d := self.depths[x]) and (at := bisect_right(d, wall)) < len(d)]
            if inside:
                self._close_to(min(inside))
        found = dict(attrs)
        within = self.depths["article"] or self.depths["main"]
        marks = " ".join(x for x in (found.get("class"), found.get("id")) if x)
        hard = tag in _SILENT or (tag == "header" and not within) or found.get("role") in _ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        hard = hard or bool(re.search(r"display\s*:\s*none", found.get("style") or ""))
        soft = tag in ("form", "fieldset") or found.get("role") == "form" or bool(marks and tag not in ("body", "main") and _named(marks))
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.noise.append(hard)
        self.named.append(soft)
        if tag in _BLOCK:
            self.pieces.append((len(self.tag) - 1, ""))  # a break even if the block is empty
        if tag not in _VOID:
            self.depths[tag].append(len(self.open))
            self.open.append(len(self.tag) - 1)
        elif tag in ("br", "hr", "wbr"):
            self.pieces.append((self.open[-1], "" if tag == "wbr" else " "))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.depths[tag]:
            self._close_to(self.depths[tag][-1])

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data))


class _Density:
    """Composite text density of every node of a page, and what is chosen by it."""

    def __init__(self, tree: _Tree, silent: list[bool]) -> None:
        self.tree, self.silent = tree, silent
        n = len(tree.tag)
        self.chars, self.linked, self.tags, self.links = [0] * n, [0] * n, [1] * n, [int(t == "a") for t in tree.tag]
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
        for i, data in tree.pieces:
            if not silent[i]:
                size = len("".join(data.split()))
                self.chars[i] += size
                self.linked[i] += size * in_link[i]
        for i in range(n - 1, 0, -1):
            if not silent[i]:
                p = tree.parent[i]
                self.chars[p] += self.chars[i]
                self.linked[p] += self.linked[i]
                self.tags[p] += self.tags[i]
                self.links[p] += self.links[i]
        self.body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
        share = self.linked[self.body] / max(self.chars[self.body], 1)
        self.density = [0.0 if silent[i] else composite(self.chars[i], self.tags[i], self.linked[i], self.links[i], share) for i in range(n)]
        self.sums = [0.0] * n
        for i in range(1, n):
            self.sums[tree.parent[i]] += self.density[i]

    def chosen(self) -> tuple[int, float]:
        """The node of the main text and the threshold.

        The core is the node with the largest sum of child densities; the threshold is the least density on its path up to
        the body. An ancestor takes the core's place if it is the core's article or main element, or if another child of it
        reaches the threshold and is either a piece of running text or has a fifth of the core's sum itself.
        """
        tree, density, sums = self.tree, self.density, self.sums
        n = len(tree.tag)
        core = max(range(n), key=lambda i: (sums[i] if not self.silent[i] else -1.0, -i))
        if not sums[core]:
            return self.body, 0.0
        path = [core]
        while path[-1] not in (self.body, 0):
            path.append(tree.parent[path[-1]])
        least = min(density[i] for i in path)
        place = {i: at for at, i in enumerate(path)}
        root = 0
        named = next((at for at, i in enumerate(path) if tree.tag[i] in ("article", "main")), 0)
        beside = [False] * len(path)
        for i in range(1, n):
            at = place.get(tree.parent[i])
            if at and i not in place and not self.silent[i] and density[i] >= least and 2 * self.linked[i] < self.chars[i]:
                beside[at] = beside[at] or tree.tag[i] in _FLOW or sums[i] >= 0.2 * sums[core]
        for at in range(1, len(path)):
            if at == named or beside[at]:
                root = max(root, at)
        return path[root], least

    def link_lists(self, least: float) -> list[bool]:
        """Elements below the threshold that are little but links: four or more of them, three quarters of the characters."""
        return [self.tree.tag[i] in _BLOCK and self.links[i] >= 4 and 4 * self.linked[i] >= 3 * self.chars[i] and self.density[i] < least for i in range(len(self.chars))]


def composite(chars: int, tags: int, linked: int, links: int, share: float) -> float:
    """Characters per tag, adjusted by the links: a logarithm of (chars / linked) * (tags / links) to a base that grows with
    linked characters and with the share of them in the body. Missing links count as one."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - linked, 1) * linked + share * chars + math.e)
    ratio = chars / max(linked, 1) * tags / max(links, 1)
    return max(chars / tags * math.log(max(ratio, 1.0)) / math.log(max(base, 1.0 + 1e-6)), 0.0) if base > 1.0 + 1e-6 else chars / tags


def main_text(html: str | None) -> str:
    """The text of the main subtree: blocks in page order, white space folded."""
    if not html:
        return ""
    tree = _Tree()
    end = html.rfind(">") + 1
    if "<" not in html[end:]:
        end = len(html)
    tree.feed(html[:end])
    tree.close()
    if end < len(html):  # tags that nothing closes are text; the parser would look for the end of each
        tree.handle_data(unescape(html[end:]))
    n = len(tree.tag)
    # what sounds like noise is none if it contains the main heading or an article of its own, or, as a form, most of the text
    holds = [tree.tag[i] in ("main", "h1") or (tree.tag[i] == "article" and not tree.named[i]) for i in range(n)]
    size, deaf = [0] * n, [False] * n
    for i in range(1, n):
        deaf[i] = deaf[tree.parent[i]] or tree.noise[i]
    for i, data in tree.pieces:
        size[i] += 0 if deaf[i] else len(data.strip())
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] = holds[tree.parent[i]] or (holds[i] and not tree.noise[i])
        size[tree.parent[i]] += size[i]
    silent = [tree.noise[i] or (tree.named[i] and not holds[i] and not (tree.tag[i] == "form" and 2 * size[i] > size[0])) for i in range(n)]
    for i in range(1, n):
        silent[i] = silent[i] or silent[tree.parent[i]]
    found = _Density(tree, silent)
    core, least = found.chosen()
    lists = found.link_lists(least)
    inside = [i == core for i in range(n)]
    block = [0] * n
    for i in range(1, n):
        inside[i] = inside[i] or (inside[tree.parent[i]] and not lists[i])
        block[i] = i if tree.tag[i] in _BLOCK else block[tree.parent[i]]
    out: list[str] = []
    last = -1
    for i, data in tree.pieces:
        if inside[i] and not silent[i]:
            out.append(f" {data}" if out and block[i] != last else data)
            last = block[i]
    return " ".join("".join(out).split())


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
