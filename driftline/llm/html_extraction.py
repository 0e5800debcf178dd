"""Main text of web pages by wrapper induction.

Pages of a host that are built alike (one layout) are aligned by simple tree matching, which finds the
largest set of node pairs that keeps order and parentage. Nodes that keep their text from page to page
are the layout's template; slots whose text varies are content. The wrapper, a tree of such nodes, is
aligned with each page of its layout, and the text of template nodes is left out. Of what varies,
menus, adverts, forms, comments and the like are told by their element and class.

Trees are of block elements: inline elements belong to the text of their block. Nothing here recurses,
so pages may be nested as deeply as they like.
"""

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftline.llm.common import Memo, map_batches
from driftline.staging import staged

#: The share of a layout's other pages in which a node of the first must keep its text to be template.
CONSTANT_SHARE = 0.8
#: Two pages are copies if they share more than this part of the larger one's text.
COPY_SHARE = 0.9
#: Trees whose sizes multiply to at most so much are matched pair by pair, larger ones a row of pairs at a time.
SMALL = 1 << 14
#: Cells whose way back is held at a time, and weights held of subtrees that recur.
CELLS, HELD = 1 << 28, 1 << 22

# fixed values: HTML element names by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("""
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav
    noscript ol optgroup option p pre search section select summary table tbody td template tfoot th
    thead title tr ul script style svg iframe object canvas audio video textarea button
""".split())
SKIPPED = frozenset("""
    head script style noscript template nav aside footer form iframe object svg canvas audio video
    button select option textarea input menu dialog title xmp noembed noframes search datalist
    fieldset
""".split())
CLOSES_P = BLOCK - frozenset("script style template noscript button".split())
SIBLINGS = {tag: tuple(frozenset(names.split()) for names in closed_within) for tag, closed_within in {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr"), "th": ("td th", "tr"),
    "option": ("option", "select optgroup"), "tbody": ("tbody thead tfoot tr td th", "table"),
    "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
}.items()}
P_SCOPES = frozenset("td th table li div article body button".split())
ARTICLE = frozenset(("article", "main"))
#: Blocks that hold sentences, also where these are mostly a link.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd td caption".split())
#: Parts of class names and ids of what is no article.
NOT_ARTICLE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotions?|"
    r"sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|site-?header|page-?header|masthead|"
    r"topbar|toolbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|"
    r"subscription|signup|login|comments?|commentlist|replies|respond|disqus|discussion|share|sharing|"
    r"social|related|recommended|recommendations|widgets?|pagination|pager|search|skip|hidden|"
    r"copyright|legal|disclaimer)(?:$|[-_\s\d])",
    re.IGNORECASE,
)
#: Class names that inside an article may as well name one of its sections.
SECTION_OF_ARTICLE = re.compile(
    r"(?:^|\s)(?:discussion|legal|disclaimer|copyright|search|sharing|related[-_](?!posts?|articles?|links?|content|"
    r"stories|news)\w+|(?:discussion|legal|search)[-_]\w+)(?=\s|$)", re.IGNORECASE,
)
SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CLOSE_OF = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


class Node:
    """A block element with its children in order, or a run of text (``tag`` empty).

    ``key`` is equal for equal subtrees, ``size`` the number of nodes, ``full`` what the subtree weighs
    when matched with its like.
    """

    __slots__ = ("children", "full", "inside", "key", "linked", "mark", "size", "skip", "tag", "text")

    def __init__(self, tag: str, mark: str = "", skip: bool = False, text: str = "", linked: int = 0, inside: bool = False):
        self.tag, self.mark, self.skip, self.text, self.linked, self.inside = tag, mark, skip, text, linked, inside
        self.children: list[Node] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _told(element: tuple[str, str, bool]) -> tuple[str, bool]:
    """Class and id of an element (tag, attributes as written, whether within an article), and whether its text is left out."""
    tag, raw, within_article = element
    found = _attributes(raw)
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    told = SECTION_OF_ARTICLE.sub(" ", names) if within_article and names else names
    skip = (
        tag in SKIPPED or (tag == "header" and not within_article)
        or (tag not in ("html", "body", "article", "main") and told and NOT_ARTICLE.search(told) is not None)
        or found.get("role", "").lower() in SKIPPED_ROLES or "hidden" in found
        or found.get("aria-hidden") == "true"
    )
    return names, bool(skip)


#: Elements recur from page to page; those with long attributes are not remembered.
_told_before = Memo(_told, 1 << 12)


def parse(page: str) -> Node:
    """The tree of a page. Never fails: unknown, unclosed and stray tags are taken as browsers mostly do."""
    root = Node("")
    stack = [root]
    run: list[str] = []
    linked = in_link = 0
    at, end, last = 0, len(page), page.rfind(">")

    def flush():
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1].children.append(Node("", text=text, linked=min(linked, len(text))))
        linked = 0

    while at < end:
        match = _MARKUP.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        start = match.start() if match else end
        if start > at:
            run.append(page[at:start])
            if in_link:
                linked += start - at
        if match is None:
            break
        at = match.end()
        if match[2] is None:
            continue  # a comment or a declaration
        tag, closing = match[2].lower(), bool(match[1])
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            run.append(" ")
        elif tag == "hr":
            flush()
        if tag not in BLOCK or tag in VOID:
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        in_link = 0
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in P_SCOPES:
                    break
        if tag in SIBLINGS:
            closed, within = SIBLINGS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in within:
                    break
                if stack[depth].tag in closed:
                    del stack[depth:]
        within_article = stack[-1].inside
        raw = match[3]
        names, skip = _told_before[tag, raw, within_article] if len(raw) <= 256 else _told((tag, raw, within_article))
        node = Node(tag, names, skip, inside=within_article or tag in ARTICLE)
        stack[-1].children.append(node)
        if tag in RAW:
            close = _CLOSE_OF[tag].search(page, at)
            at = close.start() if close else end
            if close:
                bracket = page.find(">", at)
                at = bracket + 1 if bracket >= 0 else end
        elif not raw.endswith("/") or tag != "svg":
            stack.append(node)
    flush()
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def _measure(root: Node) -> None:
    for node in reversed(_nodes(root)):
        inner = node.children
        node.key = hash((node.tag, node.mark, node.text, *(c.key for c in inner)))
        node.size = 1 + sum(c.size for c in inner)
        node.full = 1 + sum(c.full for c in inner) if node.tag or inner else 3


def _kind(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.mark == b.mark


def _last(step):
    """The result of a generator that yields generators for the results it needs."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _weigh(x: Node, y: Node) -> int | None:
    """The weight of a pair if it is plain, else null: children decide."""
    if not _kind(x, y):
        return 0
    if x.key == y.key:
        return x.full
    return None if x.children and y.children else 1


def _ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many children are equal from the start, and from the end of what is left."""
    low, high, least = 0, 0, min(len(xs), len(ys))
    while low < least and xs[low].key == ys[low].key:
        low += 1
    while high < least - low and xs[-1 - high].key == ys[-1 - high].key:
        high += 1
    return low, high


def _only_way(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]] | None:
    """The pairs of siblings if their elements leave no choice."""
    common = {(x.tag, x.mark) for x in xs} & {(y.tag, y.mark) for y in ys}
    mine, theirs = ([n for n in nodes if (n.tag, n.mark) in common] for nodes in (xs, ys))
    if len(mine) == len(theirs) == len(common) and all(map(_kind, mine, theirs)):
        return list(zip(mine, theirs))
    return None


class _Level:
    """Nodes of one depth, siblings side by side after an empty place, as places of a row of a table.

    ``start`` is the row before any pair: siblings begin so far above those before them that the greatest
    value up to a place is one of their own. ``kinds`` has the places of each element, and of those with
    children the place, and where these begin and end in the row of the next depth.
    """

    def __init__(self, groups: list[list[Node]], apart: int):
        self.nodes: list[Node | None] = []
        sizes = []
        for group in groups:
            self.nodes.append(None)
            self.nodes.extend(group)
            sizes.append(len(group) + 1)
        self.start = np.repeat(np.arange(len(groups), dtype=np.int64) * apart, sizes)
        self.below: list[list[Node]] = []
        self.span: dict[int, tuple[int, int]] = {}
        kinds, self.texts = {}, {}
        at = 0
        for place, node in enumerate(self.nodes):
            if node is None:
                continue
            every, parents = kinds.setdefault((node.tag, node.mark), ([], []))
            every.append(place)
            if node.children:
                self.below.append(node.children)
                self.span[place] = at, at + len(node.children)
                at += len(node.children) + 1
                parents.append((place, *self.span[place]))
            elif not node.tag:
                self.texts.setdefault(node.text, []).append(place)
        self.kinds = {
            kind: (np.array(every), np.array(parents, np.int64).reshape(-1, 3).T) for kind, (every, parents) in kinds.items()
        }


class _Table:
    """Weights of all pairs of nodes that are equally deep in two lists of siblings, a row at a time.

    Subtrees of ``xs`` that differ only in texts that ``ys`` lack weigh the same and are one class. With
    ``keep`` each row's way back is held, two bits a place.
    """

    def __init__(self, xs: list[Node], ys: list[Node]):
        self.xs, self.levels, groups = xs, [], [ys]
        apart = 1 + sum(y.full for y in ys)
        while groups:
            self.levels.append(_Level(groups, apart))
            groups = self.levels[-1].below
        self._classify()

    def _classify(self):
        texts = {text for level in self.levels for text in level.texts}
        order, stack = [], [(x, 0) for x in self.xs]
        while stack:
            node, depth = stack.pop()
            order.append((node, depth))
            if depth + 1 < len(self.levels):
                stack.extend((c, depth + 1) for c in node.children)
        numbers, self.of, self.many = {}, {}, Counter()
        for node, depth in reversed(order):
            inner = tuple(self.of[id(c)] for c in node.children) if depth + 1 < len(self.levels) else len(node.children) > 0
            like = (depth, node.tag, node.mark, node.text if node.text in texts else None, inner)
            self.of[id(node)] = number = numbers.setdefault(like, len(numbers))
            self.many[number] += 1
        self.cells = len(self.xs) * len(self.levels[0].nodes) + sum(
            len(inner) * len(self.levels[depth + 1].nodes) for depth, _, _, _, inner in numbers if isinstance(inner, tuple)
        )

    def run(self, keep: bool) -> np.ndarray:
        """The last row over ``ys``: what the first so many of them weigh when matched with all of ``xs``."""
        self.back: dict[int, list] = {}
        held: dict[int, np.ndarray | None] = {}
        room = HELD

        def rows(nodes, depth, number):
            row, back = self.levels[depth].start, []
            for node in nodes:
                weights = yield weigh(node, depth)
                way = None
                if weights is not None:
                    new = row.copy()
                    np.maximum(row[1:], row[:-1] + weights[1:], out=new[1:])
                    new = np.maximum.accumulate(new)
                    if keep:
                        left = np.empty(len(new), bool)
                        left[0], left[1:] = False, new[1:] == new[:-1]
                        way = np.packbits(left).tobytes(), np.packbits(new == row).tobytes()
                    row = new
                back.append(way)
            if keep:
                self.back[number] = back
            return row

        def weigh(node, depth):
            nonlocal room
            number, level = self.of[id(node)], self.levels[depth]
            if number in held:
                return held[number]
            out = None
            if (node.tag, node.mark) in level.kinds:
                every, (places, begin, end) = level.kinds[node.tag, node.mark]
                out = np.zeros(len(level.nodes), np.int64)
                out[every] = 1
                if node.children and len(places):
                    row = yield rows(node.children, depth + 1, number)
                    out[places] += row[end] - row[begin]
                elif not node.tag and not node.children and node.text in level.texts:
                    out[level.texts[node.text]] = 3
            if self.many[number] > 1:
                if room < len(level.nodes):
                    held.clear()
                    room = HELD
                held[number] = out
                room -= 0 if out is None else len(out)
            return out

        return _last(rows(self.xs, 0, -1))

    def way(self, xs: list[Node], number: int, depth: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Places of the pairs of siblings: in ``xs``, and in the row of that depth. Of equal ways the first in that row."""
        back, i, j, out = self.back[number], len(xs), end, []
        while i and j > begin:
            if back[i - 1] is None:
                i -= 1
                continue
            left, up = back[i - 1]
            bit = 128 >> (j & 7)
            if left[j >> 3] & bit:
                j -= 1
            elif up[j >> 3] & bit:
                i -= 1
            else:
                i -= 1
                out.append((i, j))
                j -= 1
        return out


def _matched(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The pairs of two lists of siblings. What is known of the children of a pair is put into ``memo``.

    Where the ways back of all pairs are too many, ``xs`` are halved and each half meets its part of ``ys``.
    """
    table = _Table(xs, ys)
    if table.cells > CELLS:
        if len(xs) == 1:
            row = table.run(False)
            return [(xs[0], ys[int(np.argmax(row)) - 1])] if row[-1] else []
        half = len(xs) // 2
        first = _Table(xs[:half], ys).run(False)
        second = _Table(xs[half:][::-1], ys[::-1]).run(False)
        j = int(np.argmax(first + second[::-1]))
        return [pair for part in ((xs[:half], ys[:j]), (xs[half:], ys[j:])) if part[1] for pair in _matched(*part, memo)]
    table.run(True)
    top, found, stack = None, [], [(xs, None, -1, 0, 0, len(ys))]
    while stack:
        nodes, pair, number, depth, begin, end = stack.pop()
        chosen = []
        for i, j in table.way(nodes, number, depth, begin, end):
            x, y = nodes[i], table.levels[depth].nodes[j]
            chosen.append((x, y))
            if _weigh(x, y) is None:
                stack.append((x.children, (x, y), table.of[id(x)], depth + 1, *table.levels[depth].span[j]))
        if pair is None:
            top = chosen
        else:
            found.append((pair, chosen))
    for (x, y), chosen in reversed(found):
        weights = ((p, q, _weigh(p, q)) for p, q in chosen)
        memo[id(x), id(y)] = sum(1 + memo[id(p), id(q)][0] if w is None else w for p, q, w in weights), chosen
    return top


def match_trees(a: Node, b: Node, pairs: list | None = None) -> int:
    """Simple tree matching: the size of the largest order-keeping matching of two trees.

    With ``pairs``, the matched nodes are added to it. Two text runs with the same text weigh more
    than two that differ, so that repeated text is aligned with itself. Equal children at either end
    are matched at once, and so are those whose elements leave no choice, which loses nothing. All other
    pairs of children are weighed, in trees of any size.
    """
    for tree in (a, b):
        if not hasattr(tree, "key"):  # trees keep their shape, so one measure does
            _measure(tree)
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def best(xs, ys):
        """Weighted pairs of children in order, by a table of all of them."""
        n, m = len(xs), len(ys)
        table = [[0] * (m + 1)]
        for i in range(1, n + 1):
            above, row = table[-1], [0]
            for j in range(1, m + 1):
                value = max(row[-1], above[j])
                x, y = xs[i - 1], ys[j - 1]
                w = _weigh(x, y)
                if w is None:
                    w = 1 + (yield align(x, y))
                row.append(max(value, above[j - 1] + w) if w else value)
            table.append(row)
        i, j, out = n, m, []
        while i and j:
            here = table[i][j]
            if table[i][j - 1] == here:
                j -= 1
            elif table[i - 1][j] == here:
                i -= 1
            else:
                out.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
        return out

    def align(x: Node, y: Node):
        key = (id(x), id(y))
        if key in memo:
            return memo[key][0]
        xs, ys = x.children, y.children
        low, high = _ends(xs, ys)
        chosen = [*zip(xs[:low], ys[:low]), *zip(xs[len(xs) - high:], ys[len(ys) - high:])]
        xs, ys = xs[low:len(xs) - high], ys[low:len(ys) - high]
        if xs and ys:
            if sum(c.size for c in xs) * sum(c.size for c in ys) <= SMALL:
                chosen += yield best(xs, ys)
            else:
                only = _only_way(xs, ys)
                chosen += _matched(xs, ys, memo) if only is None else only
        size = 0
        for p, q in chosen:
            w = _weigh(p, q)
            size += w if w is not None else 1 + (yield align(p, q))
        memo[key] = size, chosen
        return size

    size = _weigh(a, b)
    if size is None:
        size = 1 + _last(align(a, b))
    if pairs is not None and size:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            if x.key == y.key:
                pairs.extend(zip(_nodes(x), _nodes(y)))
            else:
                pairs.append((x, y))
                stack.extend(memo.get((id(x), id(y)), (0, ()))[1])
    return size


def _anchors(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
    """Places of equal subtrees that either list has once: the longest series in the order of both."""
    once = []
    for nodes in (xs, ys):
        at: dict[int, int] = {}
        for i, node in enumerate(nodes):
            at[node.key] = -1 if node.key in at else i
        once.append(at)
    ends, tails, before = [], [], {}
    for key, i in once[0].items():
        j = once[1].get(key, -1)
        if i < 0 or j < 0:
            continue
        k = bisect_left(ends, j)
        before[i, j] = tails[k - 1] if k else None
        ends[k:k + 1], tails[k:k + 1] = [j], [(i, j)]
    out, at = [], tails[-1] if tails else None
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def _kept_texts(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """Text runs of ``a`` and what they are matched with in ``b``, where that is the same text.

    Among many siblings a few more before a line outweigh the line itself in the largest matching. So in large trees
    equal subtrees that matched parents' children hold once are kept as well, the longest series of them in order.
    """
    pairs = []
    match_trees(a, b, pairs)
    for x, y in pairs:
        if not x.tag and x.text and x.text == y.text:
            yield x, y
        elif x.children and x.key != y.key and x.size * y.size > SMALL:
            low, high = _ends(x.children, y.children)
            xs, ys = x.children[low:len(x.children) - high], y.children[low:len(y.children) - high]
            for i, j in _anchors(xs, ys):
                yield from ((p, q) for p, q in zip(_nodes(xs[i]), _nodes(ys[j])) if p.text)


def _runs(node: Node) -> Iterator[tuple[Node, str]]:
    """Runs of text outside skipped elements in page order, each with the tag of its block."""
    stack = [(c, node.tag) for c in reversed(node.children)]
    while stack:
        child, tag = stack.pop()
        if not child.tag:
            yield child, tag
        elif not child.skip:
            stack.extend((c, child.tag) for c in reversed(child.children))


def _length(texts) -> int:
    return sum(map(len, texts))


class _First:
    """A layout's first page as its other pages meet it: the tree, measured once, its nodes and texts."""

    def __init__(self, page: str):
        self.tree = parse(page)
        _measure(self.tree)
        self.nodes = _nodes(self.tree)
        self.texts = {n.text for n in self.nodes if n.text}
        self.length = _length(self.texts)


def _vote(first: _First, other: Node, own: set[str]) -> tuple[int, list[int]] | None:
    """What a page, of texts ``own``, tells of its layout's first page: (kind, places of the nodes that keep their text).

    A copy of the first page tells nothing, so that an article is not taken for constant. ``kind`` stands for
    the longest text that the first page lacks: pages of one kind are copies of each other and have one vote.
    """
    shared = own & first.texts
    if _length(shared) > COPY_SHARE * max(_length(own), first.length):
        return None
    longest = max(own - shared, key=lambda s: (len(s), s), default="")
    kind = int.from_bytes(blake2b(longest.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    kept = {id(x) for x, _ in _kept_texts(first.tree, other)} if shared else ()
    return kind, [i for i, n in enumerate(first.nodes) if id(n) in kept] if kept else []


def _texts(tree: Node) -> set[str]:
    return {n.text for n in _nodes(tree) if n.text}


def _shape(first: Node, constant: set[int]) -> str:
    """The wrapper as JSON: the first page's tree with the text of constant nodes."""
    shape, stack = [], [(first, 0)]
    while stack:
        node, depth = stack.pop()
        shape.append([depth, node.tag, node.mark, node.text if len(shape) in constant else ""])
        stack.extend((c, depth + 1) for c in reversed(node.children))
    return json.dumps(shape)


def induce(pages: list[str]) -> str | None:
    """The wrapper of a few pages, as ``wrappers`` makes it of a layout's; null if nothing is constant or fewer
    than three of the pages differ. The first page's tree is aligned with every other's."""
    first, votes = _First(pages[0]), {}
    for page in pages[1:]:
        tree = parse(page)
        if vote := _vote(first, tree, _texts(tree)):
            votes.setdefault(*vote)
    kept = Counter(at for places in votes.values() for at in places)
    constant = {at for at, n in kept.items() if n >= CONSTANT_SHARE * len(votes)}
    return _shape(first.tree, constant) if len(votes) > 1 and constant else None


def _wrapper(text: str) -> Node:
    path: list[Node] = []
    for depth, tag, mark, constant in json.loads(text):
        node = Node(tag, mark, text=constant)
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


def main_text(page: str, wrapper: Node | None = None) -> str:
    """Blocks of the page's article, joined by an empty line.

    Where no element says which part is the article, it is all that is neither template nor of a kind
    left out; lists and boxes that are mostly links are menus, sentences that are links stay.
    """
    tree = parse(page)
    if wrapper is not None:
        for _, run in list(_kept_texts(wrapper, tree)):
            run.skip = True
    scopes, stack = [], [tree]
    while stack:
        node = stack.pop()
        if node.tag in ARTICLE:
            scopes.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if c.tag and not c.skip)
    blocks = [r.text for scope in scopes for r, _ in _runs(scope) if not r.skip]
    if not blocks:
        blocks = [r.text for r, tag in _runs(tree) if not r.skip and (tag in PROSE or 2 * r.linked <= len(r.text))]
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def layout_of(page: Column) -> Column:
    """A number that pages built alike mostly share: the least hash of their structural elements, each with
    its first class, id or role. Never zero."""
    quoted = r"""(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
    elements = F.regexp_extract_all(page, F.lit(
        r"(?i)<((?:body|div|section|article|main|header|footer|nav|aside|form)(?:\s+(?:class|id|role)\s*=\s*" + quoted + r")?)[\s>/]"
    ), 1)
    least = F.array_min(F.transform(F.array_distinct(elements), lambda e: F.xxhash64(F.lower(e))))
    return F.when(least.isNull() | (least == 0), 1).otherwise(least)


def _first_pages(pages: DataFrame) -> DataFrame:
    """Rows (host, layout, hash, first): the page with the least hash of each layout, and its hash."""
    hashed = pages.select("host", "layout", F.xxhash64("html").alias("hash"), "html")
    least = staged(hashed.groupBy("host", "layout").agg(F.min("hash").alias("hash")), "first-hashes")
    key = ["host", "layout", "hash"]
    return staged(hashed.join(least, key).groupBy(*key).agg(F.min("html").alias("first")), "first-pages")


def _induced(pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows (host, layout, wrapper) of the layouts that have one; ``pages`` has host, layout and html.

    A host of several layouts has one more, of number 0, that all its pages belong to. Every page is parsed
    once, where it is read, and aligned with its layout's first page and with its host's, which is the one
    with the least hash; votes are added up. Copies have one vote, so a layout's size and groups of copies are no one task's.
    """
    layout = ["host", "layout"]
    of_hosts = (
        firsts.groupBy("host").agg(F.min(F.struct("hash", "first")).alias("least"), F.count("*").alias("layouts"))
        .where("layouts > 1").select("host", F.col("least.hash").alias("host_hash"), F.col("least.first").alias("host_first"))
    )

    def vote(batches):
        held = Memo(_First, 1024)
        for batch in batches:
            out = []
            for host, number, hashed, page, first, several, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = parse(page)
                own = _texts(tree)
                told = _vote(held[first], tree, own)
                if told:
                    out.append((host, number, hashed, *told))
                if several and (told if other is None else (told := _vote(held[other], tree, own))):
                    out.append((host, 0, hashed, *told))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                names=["host", "layout", "hash", "kind", "kept"],
            )

    def shape(batches):
        for batch in batches:
            found = [_shape(parse(f), set(at)) for f, at in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string())], names=[*layout, "wrapper"])

    several = F.col("host_hash").isNotNull()
    met = (
        pages.join(firsts, layout).join(of_hosts, "host", "left")
        .select(*layout, F.xxhash64("html").alias("page_hash"), "html", "first", several.alias("several"),
                F.when(several & (F.col("host_hash") != F.col("hash")), F.col("host_first")).alias("other"))
    )
    votes = staged(
        map_batches(met, vote, "host string, layout long, hash long, kind long, kept array<int>")
        .groupBy(*layout, "kind").agg(F.min_by("kept", "hash").alias("kept")), "wrapper-votes",
    )
    voters = votes.groupBy(*layout).agg(F.count("*").alias("voters")).where("voters > 1")
    constant = (
        votes.select(*layout, F.explode("kept").alias("at")).groupBy(*layout, "at").agg(F.count("*").alias("n"))
        .join(voters, layout).where(F.col("n") >= CONSTANT_SHARE * F.col("voters"))
        .groupBy(*layout).agg(F.collect_list("at").alias("constant"))  # as many as a page has nodes at most
    )
    every = firsts.select(*layout, "first").unionByName(
        of_hosts.select("host", F.lit(0).cast("long").alias("layout"), F.col("host_first").alias("first"))
    )
    return map_batches(every.join(constant, layout), shape, "host string, layout long, wrapper string", 16)


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, layout, wrapper) of the layouts that have one; ``pages`` has a column ``layout``.

    Every layout of a host is induced on its own, from all its pages. Layouts with too few different
    pages get the wrapper of the host's pages of any layout.
    """
    known = pages.where(F.col("host").isNotNull() & F.col("html").isNotNull()).select("host", "layout", "html")
    firsts = _first_pages(known)
    induced = staged(_induced(known, firsts), "induced")
    made = induced.where("layout <> 0")
    without = firsts.select("host", "layout").join(made, ["host", "layout"], "left_anti")
    return made.unionByName(without.join(induced.where("layout = 0").drop("layout"), "host"))


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each page.

    A null or empty page has empty text; a page without a host, or of a host with fewer than three
    different pages, is read without a wrapper; repeated rows are read each; other columns are ignored.
    Wrappers are joined by host and layout; whether they are broadcast is left to their size.
    """
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), layout_of(F.col("html")).alias("layout"))
    found = staged(wrappers(own), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        held: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in held:
                    if len(held) > 256:
                        held.clear()
                    held[wrapper] = _wrapper(wrapper)
                texts.append(main_text(page or "", held.get(wrapper)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = own.join(found, ["host", "layout"], "left").select("page_id", "url", "html", "wrapper")
    return map_batches(joined, run, f"page_id {kind}, url string, text string, n_chars long")
