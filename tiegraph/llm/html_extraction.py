"""Main text of web pages by wrapper induction: DOM trees of a host are aligned by simple tree matching.

1. Each page is parsed into a tree of block elements (implied end tags, void and raw elements as browsers treat them).
   Tags and roles that name page furniture (nav, footer, aside, form, search, dialog, a header outside the article) are
   boilerplate. A class or id that names some (cookie-notice, comments, related-posts) makes its element a suspect; it is
   dropped unless the name is that of a layout (widget-container, no-sidebar) or the element holds the article or most
   of the page's text. Runs of equal siblings are one repeated node.
2. Each host has a reference page (its least page_id), kept as a tree of labels. Every page is aligned with it by simple
   tree matching; a matched node is a slot of the wrapper, other nodes are named by their path. Each (slot, text), and
   each slot, is counted once per page over all pages of the host, added up before the shuffle.
3. A text that fills its slot on at least ``constant`` of the pages that have the slot, and on three or more, is template;
   texts that vary are content. The template joins the pages by host, and each page keeps its content blocks in order. A
   page whose headings are all template is one of many copies of an article, not template, and keeps all.

Tags are read in one pass (an attribute whose quote never closes ends its quoting for the rest of the page), and no step
recurses, so depth and length of a page are bounded by memory only.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.llm import common

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody tfoot thead tr td th ul caption".split()
)
BOILER_TAGS = frozenset("head nav footer aside form menu dialog fieldset button label search input".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BOILER_WORDS = (
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors banner promo promotion nav navbar navigation menu sidebar footer masthead topbar comment comments commentlist disqus respond reply replies cookie cookies "
    "consent gdpr notice notices notification alert popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs login search toolbar pagination pager paywall skip"
)
LAYOUT_WORDS = "container wrapper wrap layout page content contents inner outer main body article post entry text row col column columns grid section no has with without not hide hidden visible builder elementor block"
_BOILER, _LAYOUT = frozenset(BOILER_WORDS.split()), frozenset(LAYOUT_WORDS.split())
_CLOSES_P = BLOCK - {"html", "body", "td", "th", "tbody", "thead", "tfoot", "tr", "caption"}
# what an opening tag ends, and where the search for it stops
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=\s|/|$)", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("boiler", "children", "label", "parent", "suspect", "tag", "texts")

    def __init__(self, tag: str, label: str, parent: Node | None, boiler: bool, suspect: bool):
        self.tag, self.label, self.parent, self.boiler, self.suspect = tag, label, parent, boiler, suspect
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []


def _named(value: str) -> bool:
    """Whether one of the names in a class or id says furniture: a word of it does, and none says layout."""
    for name in value.split():
        words = [w for w in _SPLIT.split(name) if w]
        if any(w in _BOILER for w in words) and not any(w in _LAYOUT for w in words):
            return True
    return False


def _says(tag: str, attrs: str, parent: Node) -> tuple[bool, bool, str]:
    """Whether the element is furniture by tag or role, or a suspect by class or id, and the first word of these."""
    if tag in BOILER_TAGS:
        return True, False, ""
    if tag == "header":
        inside = parent
        while inside is not None and inside.tag not in ("article", "main"):
            inside = inside.parent
        if inside is None:
            return True, False, ""
    first, suspect = "", False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and _HIDES.search(value):
                return True, False, first
            if name == "role" and value in BOILER_ROLES:
                return True, False, first
            if name in ("class", "id"):
                words = [w for w in _SPLIT.split(value) if w]
                first = first or (words[0] if words else "")
                suspect |= tag not in ("html", "body", "main", "article") and _named(value)
    return False, suspect, first


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each piece of markup, in one pass; comments and declarations have no name."""
    i, n, quoted, closes = 0, len(page), True, page.rfind(">")
    while True:
        i = page.find("<", i)
        if i < 0 or i > closes:
            return
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
            yield i, end, "", "", ""
        elif page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            end = n if end < 0 else end + 3
            yield i, end, "", "", ""
        elif page.startswith(("<!", "<?"), i):
            end = page.find(">", i) + 1
            yield i, end, "", "", ""
        elif m := _NAME.match(page, i + 1):
            at, end = m.end(), 0
            while quoted:
                stop = _STOP.search(page, at)
                if stop is None:
                    quoted = False
                elif stop[0] == ">":
                    end = stop.end()
                    break
                else:
                    at = page.find(stop[0], stop.end()) + 1
                    quoted = at > 0
            end = end or page.find(">", m.end()) + 1
            if not end:
                return
            yield i, end, m[1], m[2].lower(), page[m.end() : end - 1]
        else:
            i += 1
            continue
        i = end


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks (node, text) in page order."""
    root = Node("", "", None, False, False)
    at, here, inline, last, skip_to = root, [], [], 0, 0
    blocks: list[tuple[Node, str]] = []
    hidden = 0  # open inline elements that are not shown

    def flush() -> None:
        if here:
            text = " ".join(html_lib.unescape("".join(here)).split())
            here.clear()
            if text:
                at.texts.append((len(blocks), text))
                blocks.append((at, text))

    for start, end, slash, tag, attrs in tags(page):
        if start < skip_to:
            continue
        if start > last and not hidden:
            here.append(page[last:start])
        last = end
        if not tag:
            continue
        if slash:
            if tag in BLOCK:
                node = at
                while node is not None and node.tag != tag:
                    node = node.parent
                if node is not None:
                    inline.clear()
                    hidden = 0
                    flush()
                    at = node.parent
            else:
                for k in range(len(inline) - 1, max(-1, len(inline) - 200), -1):
                    if inline[k][0] == tag:
                        hidden -= sum(x[1] for x in inline[k:])
                        del inline[k:]
                        break
            continue
        if tag in RAW or tag == "head":
            close = re.compile(r"</head\s*>|<body\b" if tag == "head" else rf"</{tag}\s*>", re.I).search(page, end)
            if close:
                last = skip_to = close.start() if close[0][1] != "/" else close.end()
            elif tag in ("script", "style", "textarea", "title", "noscript", "template"):
                last = skip_to = len(page)
            continue
        if tag in VOID and tag != "hr":
            here.append(" ")
            continue
        if tag not in BLOCK:
            boiler, suspect, _ = _says(tag, attrs, at)
            inline.append((tag, boiler or suspect))
            hidden += boiler or suspect
            continue
        inline.clear()
        hidden = 0
        flush()
        if tag in _CLOSES_P:
            node = at
            while node.tag not in ("", "p", "td", "th", "li", "article", "div", "section", "body"):
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            node, found = at, None
            while node.tag and node.tag not in stops:
                if node.tag in ends:
                    found = node
                node = node.parent
            if found is not None:
                at = found.parent
        if tag == "hr":
            continue
        boiler, suspect, first = _says(tag, attrs, at)
        node = Node(tag, f"{tag}.{first}" if first else tag, at, boiler, suspect)
        at.children.append(node)
        at = node
    if last < len(page) and not hidden:
        here.append(page[last:])
    flush()
    _settle(root)
    return root, blocks


def _below(root: Node) -> list[Node]:
    """All nodes, each after its parent."""
    out = [root]
    for node in out:
        out += node.children
    return out


def _settle(root: Node) -> None:
    """Suspects that hold the article, or most of the text that isn't furniture, are layout; the rest are boilerplate, with
    all that is inside."""
    nodes = _below(root)
    for node in nodes:
        node.boiler |= node.parent is not None and node.parent.boiler
    mass, article = {}, {}
    for node in reversed(nodes):
        mass[id(node)] = (0 if node.boiler else sum(len(t) for _, t in node.texts)) + sum(mass[id(c)] for c in node.children)
        article[id(node)] = not node.boiler and node.tag in ("article", "main") or any(article[id(c)] for c in node.children)
    for node in nodes:
        if node.suspect and not article[id(node)] and 2 * mass[id(node)] <= mass[id(root)]:
            node.boiler = True
        node.boiler |= node.parent is not None and node.parent.boiler


def scope(root: Node, blocks: list[tuple[Node, str]]) -> list[int]:
    """Numbers of the blocks that may be content: those of the articles, else of the main element, else of the body."""
    inside: dict[int, int] = {}
    for node in _below(root):
        up = inside[id(node.parent)] if node.parent is not None else 0
        inside[id(node)] = max(up, {"article": 2, "main": 1}.get(node.tag, 0))
    free = [k for k, (node, _) in enumerate(blocks) if not node.boiler]
    for level in (2, 1):
        kept = [k for k in free if inside[id(blocks[k][0])] >= level]
        if kept:
            return kept
    return free


#: Runs of siblings that are matched in order; nodes with more are matched by the kinds of their children.
RUNS = 200


class Folded:
    """A node of the tree for matching: a run of equal siblings is one node that repeats."""

    __slots__ = ("children", "label", "numbers", "slot")

    def __init__(self, label: str, numbers: list[int]):
        self.label, self.numbers, self.slot = label, numbers, ""
        self.children: list[Folded] = []


def fold(root: Node) -> Folded:
    top = Folded(root.label, [k for k, _ in root.texts])
    todo = [(top, [root])]
    while todo:
        folded, nodes = todo.pop()
        runs: list[list[Node]] = []
        for n in nodes:
            for c in n.children:
                if runs and runs[-1][0].label == c.label:
                    runs[-1].append(c)
                else:
                    runs.append([c])
        if runs and (len(nodes) > 1 or len(runs) > RUNS):  # the children of a run are matched by kind
            kinds: dict[str, list[Node]] = {}
            for r in runs:
                kinds.setdefault(r[0].label, []).extend(r)
            runs = list(kinds.values())
        for r in runs:
            child = Folded(r[0].label, [k for n in r for k, _ in n.texts])
            folded.children.append(child)
            todo.append((child, r))
    return top


def _table(a: Folded, b: Folded, sizes: dict[tuple[int, int], int]) -> list[list[int]]:
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            w = sizes[id(x), id(y)] if x.label == y.label else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    return best


def tree_match(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Simple tree matching: size of the largest order-preserving matching of equal labels from the roots, and its pairs."""
    if a.label != b.label:
        return 0, []
    sizes: dict[tuple[int, int], int] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) in sizes:
            todo.pop()
            continue
        open_ = [(c, d) for c in x.children for d in y.children if c.label == d.label and (id(c), id(d)) not in sizes]
        if open_:
            todo += open_
        else:
            sizes[id(x), id(y)] = _table(x, y, sizes)[-1][-1] + 1
            todo.pop()
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        best, i, j = _table(x, y, sizes), len(x.children), len(y.children)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                todo.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
    return sizes[id(a), id(b)], pairs


def _name(root: Folded, path: str) -> None:
    """Give every node a slot: a hash of its path."""
    root.slot = path
    todo = [root]
    while todo:
        node = todo.pop()
        seen: dict[str, int] = {}
        for c in node.children:
            k = seen[c.label] = seen.get(c.label, 0) + 1
            c.slot = f"{_hash(f'{node.slot}/{c.label}[{k}]'):x}"
            todo.append(c)


def outline(root: Folded) -> str:
    """The labels of a folded tree: each after its depth."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {node.label}")
        todo += [(c, depth + 1) for c in reversed(node.children)]
    return "\n".join(out)


def from_outline(text: str) -> Folded:
    path: list[Folded] = []
    for line in text.split("\n"):
        depth, _, label = line.partition(" ")
        node = Folded(label, [])
        del path[int(depth) :]
        if path:
            path[-1].children.append(node)
        path.append(node)
    _name(path[0], "")
    return path[0]


def slots(page: str | None, reference: Folded) -> tuple[list[tuple[Node, str]], list[int], dict[int, str]]:
    """Blocks, the numbers of those that may be content, and the slot of each number."""
    root, blocks = parse(page or "")
    free = scope(root, blocks)
    own = fold(root)
    _name(own, "+")
    for ref, mine in tree_match(reference, own)[1]:
        mine.slot = ref.slot
    slot: dict[int, str] = {}
    todo = [own]
    while todo:
        node = todo.pop()
        slot.update((k, node.slot) for k in node.numbers)
        todo += node.children
    return blocks, free, slot


def kept_blocks(blocks: list[tuple[Node, str]], free: list[int], slot: dict[int, str], template: set[int]) -> list[int]:
    """Numbers of the content blocks: all if the headings are template, too, or nothing else is left."""
    kept = [k for k in free if _digest(slot[k], blocks[k][1]) not in template]
    heads = {k for k in free if blocks[k][0].tag in ("h1", "h2", "h3")}
    return free if not kept or heads and not heads & set(kept) else kept


def _hash(text: str) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >= 1 << 63 else value


def _digest(slot: str, text: str) -> int:
    return _hash(f"{slot}\0{text}")


def host(url) -> object:  # noqa: ANN001
    """Host of a URL column, in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: Bytes of the hosts' references or templates that are sent to every task; beyond that pages are shuffled to them.
BROADCAST_BYTES = 32 << 20


def _small(df: DataFrame, size: object) -> DataFrame:
    """``df`` marked for broadcast if ``size``, summed over its rows, is within BROADCAST_BYTES."""
    total = df.agg(F.sum(size), F.count("*")).head()
    return F.broadcast(df) if (total[0] or 0) + 64 * total[1] <= BROADCAST_BYTES else df


class _References:
    """The trees of the hosts that a task has met last."""

    def __init__(self, most: int = 256):
        self.most, self.trees = most, {}

    def __call__(self, text: str) -> Folded:
        if text not in self.trees:
            if len(self.trees) >= self.most:
                self.trees.clear()
            self.trees[text] = from_outline(text)
        return self.trees[text]


def extract(pages: DataFrame, constant: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without content, give an empty text. Pages without a URL are a host of their own.
    Repeated rows stay repeated. Pages of a host with fewer than three pages have no template beyond what tags say.
    """
    common.small_batches(pages.sparkSession)
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("_host"))
    least = slim.where("html <> ''").groupBy("_host").agg(F.min("page_id").alias("_ref"), F.count("*").alias("_pages")).where("_pages >= 3")
    least = common.materialize(least, "hosts")
    # one page of each host; of several with its least id the one of the least hash
    picked = slim.where("html <> ''").join(_small(least, F.length("_host") + 16), "_host").where("page_id = _ref")

    def outlines(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [outline(fold(parse(x)[0])) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(out, pa.string())], ["_host", "_model"])

    models = picked.select("_host", "html").mapInArrow(outlines, "_host string, _model string").groupBy("_host").agg(F.min("_model").alias("_model"))
    models = _small(common.materialize(models, "host-references"), F.length("_host") + F.length("_model"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trees = _References()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for where, page, model in zip(*(batch.column(c).to_pylist() for c in ("_host", "html", "_model")), strict=True):
                if page:
                    blocks, free, slot = slots(page, trees(model))
                    places = {slot[k] for k in free}
                    seen = {(_hash(slot[k]), _digest(slot[k], blocks[k][1])) for k in free} | {(_hash(x), None) for x in places}
                    out[0].extend([where] * len(seen))
                    out[1].extend(x for x, _ in seen)
                    out[2].extend(x for _, x in seen)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["_host", "slot", "d"])

    # counted by slot and text; the row without a text counts the pages that have the slot
    counted = slim.select("_host", "html").join(models, "_host").mapInArrow(count, "_host string, slot long, d long").groupBy("_host", "slot", "d").agg(F.count("*").alias("on")).where("on >= 3")
    counted = common.materialize(counted, "host-counts")
    having = counted.where("d is null").select("_host", "slot", F.col("on").alias("pages"))
    frequent = counted.where("d is not null").join(having, ["_host", "slot"]).where(F.col("on") >= F.lit(constant) * F.col("pages"))
    # of each slot at most 1/constant texts
    template = common.materialize(frequent.groupBy("_host").agg(F.collect_list("d").alias("_template")), "host-templates")
    template = _small(template, F.length("_host") + 8 * F.size("_template"))

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trees = _References()
        for batch in batches:
            texts = []
            for page, model, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "_model", "_template")), strict=True):
                if fixed:
                    blocks, free, slot = slots(page, trees(model))
                    texts.append("\n\n".join(blocks[k][1] for k in kept_blocks(blocks, free, slot, set(fixed))))
                else:
                    root, blocks = parse(page)
                    texts.append("\n\n".join(blocks[k][1] for k in scope(root, blocks)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    both = slim.join(models, "_host", "left").join(template, "_host", "left").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "_model", "_template")
    return both.mapInArrow(keep, "page_id long, url string, text string, n_chars long")
