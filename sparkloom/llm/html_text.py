"""HTML extraction by tag-path ratios.

A page's text falls into blocks; each block has a root-to-leaf tag path (block tags with their
first class), a node of the page's tree of paths. Scripts, styles and other markup are no blocks; all other text takes part.

Per path, text length without link text and punctuation are summed and divided by the path's blocks. Both ratios are smoothed
over the neighbours in page order that stand in the same container, and fused into one value per path together with the path's share of the text.
The same sums over the tree give each container's value; a container of high ratios lifts the paths right below it (headings, list items, table cells),
a mere wrapper of another container does not, nor does the body. Paths whose value reaches a share of the best path's value are content, wherever they lie.

Lists of tags, roles, class and id words only lower a path's weight against its rivals: navigation, headers, footers, sidebars, notices, adverts, forms, reader
comments and hidden parts by much, link text and, on a page with an article or main element, what lies outside of it by less. A part that such a word names loses its
name where no rival outside of all named parts has a value near the best one inside of it (a wrapper of the page may be called "has-sidebar"); the parts inside of it are then
judged by their own names. Elements for navigation and the like (``HARD``) and hidden parts keep theirs, comments unless there is no other text at all.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
one space; nothing else is dropped or cut.

Cases: a null or empty page, or one without content, has an empty text. Truncated pages are read to
their end; a tag that the end cuts off is no text. Unclosed and stray tags follow the usual implied ends. Repeated
pages give equal texts; an empty table gives an empty result; columns that clash with text and n_chars are
replaced. Time and memory grow in proportion to the page, however deep its elements are nested; memory is bounded by the largest page.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.common import slices

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option select button".split()
)
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption option button".split())
#: What an opening tag ends, up to a boundary.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",), "body": ("head",)}
LIST_SCOPE = frozenset("ul ol dl table select".split())
P_SCOPE = frozenset("ul ol dl table body html article section main td th button".split())
#: Tags whose content is no text of the page; tags, roles and class or id words of parts that are seldom main text.
NOT_TEXT = frozenset("head script style noscript select option template textarea iframe object svg canvas audio video map title datalist".split())
ASIDE = frozenset("nav header footer aside form button menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay sidebar sidebars rail aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead "
    "topbar footer copyright comment comments commentlist disqus respond reply replies social share sharing related recommended recommendations subscribe "
    "newsletter signup login searchbox widget widgets toolbar pagination pager skip disclaimer".split()
)
#: Of those: elements that never hold a page's main text, and words of parts that rarely do.
HARD = frozenset("nav footer menu dialog search button".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|$)", re.I | re.A) for tag in RAW}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
MARK = re.compile(r"[.,;:!?¡¿…。，、；：！？]")
#: Share of the best path's value that a path needs at least, and how many neighbours smooth a block.
LEAST, RADIUS = 0.3, 2
#: Weights: of a part that the lists name; of a path outside of the article or main elements of a page that has some; of a path of nothing but link text inside and outside of these elements.
NAMED, OUTSIDE = 0.001, 0.7
LINKS_INSIDE, LINKS = 0.6, 0.3
#: How much a container lifts the paths right below it, and each level further down; the share of its text from which one inner container makes it a wrapper.
LIFT, DEEPER, WRAPS = 0.7, 0.8, 0.8
KERNEL = [math.exp(-(k**2) / 2) for k in range(RADIUS + 1)]


#: How strongly the lists name a part: not at all, by a word, as comments, by what it is.
NOT_NAMED, BY_WORD, AS_COMMENTS, AS_OTHER = range(4)


class Paths:
    """The tree of a page's tag paths: node 0 is the root; a node knows its parent, label and weight."""

    def __init__(self) -> None:
        self.up, self.tag, self.named, self.main = [-1], [""], [NOT_NAMED], [False]
        self.known: dict[tuple[int, str, int], int] = {}

    def below(self, up: int, label: str, tag: str, named: int) -> int:
        """The node of an element with this label below a node; ``named`` is how strongly the lists name the element itself."""
        key = (up, label, named)
        node = self.known.get(key)
        if node is None:
            node = self.known[key] = len(self.up)
            self.up.append(up)
            self.tag.append(tag)
            self.named.append(named)
            self.main.append(tag in ("article", "main") or self.main[up])
        return node


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, path: int, text: str, links: int):
        self.path, self.text, self.links = path, text, links


def look(tag: str, attributes: str) -> tuple[str, int]:
    """An element's label in tag paths, and how strongly the lists name it."""
    named, label = AS_OTHER if tag in HARD else BY_WORD if tag in ASIDE else NOT_NAMED, tag
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
            if name in ("class", "id"):
                if name == "class" and value:
                    label = f"{tag}.{value.split()[0]}"
                # the whole page's element may say what its parts are
                words = NAMES.intersection(re.split(r"[^a-z0-9]+", value)) if tag not in ("html", "body", "article", "main") else ()
                named = max(named, (AS_COMMENTS if words & COMMENTS else BY_WORD) if words else NOT_NAMED)
            elif name == "role":
                named = max(named, BY_WORD if value in ROLES else NOT_NAMED)
            elif name == "hidden" or (value == "true" if name == "aria-hidden" else "display:none" in value.replace(" ", "")):
                named = AS_OTHER
    return label, named


def blocks(page: str) -> tuple[list[Block], Paths]:
    """The page's blocks of text outside of scripts, styles and markup, in page order, and the tree of their paths."""
    out: list[Block] = []
    paths = Paths()
    stack: list[tuple[str, bool, bool, int]] = []  # tag, no text, block, path
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    skip = links = here = 0
    parts: list[str] = []
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(here, text, min(link_chars, len(text))))
            parts.clear()
            link_chars = 0

    def pop() -> None:
        nonlocal skip, links, here
        tag, was_skipped, is_block, _ = stack[-1]
        if is_block:
            flush()
        stack.pop()
        open_at[tag].pop()
        skip -= was_skipped
        links -= tag == "a"
        here = stack[-1][3] if stack else 0

    def close(tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """Pop up to and with the outermost of these tags within the scope."""
        if not any(open_at[t] for t in tags if t in open_at):
            return
        last = max((open_at[t][-1] for t in scope if open_at.get(t)), default=-1)
        inside = [places[k] for t in tags if (places := open_at.get(t)) and (k := bisect_right(places, last)) < len(places)]
        if inside:
            at = min(inside)
            while len(stack) > at:
                pop()

    at, end = 0, len(page)
    while at < end:
        sign = page.find("<", at)
        if sign < 0:
            sign = end
        if sign > at and not skip:
            parts.append(page[at:sign])
            if links:
                link_chars += sign - at
        if sign == end:
            break
        m = TAG.match(page, sign)
        if m is None:
            after = page[sign + 1 : sign + 2]
            if page.startswith("<!--", sign):
                stop = page.find("-->", sign + 2 if page.startswith("<!-->", sign) else sign + 4)
                at = end if stop < 0 else stop + 3
            elif after and (after in "!?/" or after.isascii() and after.isalpha()):
                stop = page.find(">", sign)  # a declaration, or a tag with an odd quote
                at = end if stop < 0 else stop + 1
            else:
                if not skip:
                    parts.append("<")
                at = sign + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif open_at.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag in CLOSES_P:
            close(("p",), P_SCOPE)
        if tag in ENDS:
            close(ENDS[tag], LIST_SCOPE)
        is_block = tag in BLOCK
        if is_block:
            flush()
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            last = RAW_END[tag].search(page, at)
            if last is None:
                break
            stop = page.find(">", last.end())
            at = end if stop < 0 else stop + 1
            continue
        label, named = look(tag, m[3])
        if is_block or named != NOT_NAMED:  # a named inline element has a path of its own
            flush()
            is_block = True
            here = paths.below(here, label, tag, named)
        skipped = tag in NOT_TEXT
        open_at[tag].append(len(stack))
        stack.append((tag, skipped, is_block, here))
        skip += skipped
        links += tag == "a"
    while stack:
        pop()
    flush()
    return out, paths


def fused(text: float, marks: float) -> float:
    """One value of a text and a punctuation ratio."""
    return math.sqrt(text * (1 + marks))


def content(found: list[Block], paths: Paths) -> list[Block]:
    """The blocks on content paths."""
    if not found:
        return []
    n, up = len(paths.up), paths.up
    # sums per path: text, marks, blocks, characters of links; and their weights
    own = [[0.0, 0.0, 0.0, 0.0] for _ in range(n)]
    for b in found:
        s = own[b.path]
        s[0] += len(b.text) - b.links
        s[1] += len(MARK.findall(b.text))
        s[2] += 1
        s[3] += b.links
    # smoothed along the page among blocks of one container
    ratio = [(own[b.path][0] / own[b.path][2], own[b.path][1] / own[b.path][2]) for b in found]
    value = [0.0] * n
    for i, b in enumerate(found):
        text = marks = total = 0.0
        for j in range(max(0, i - RADIUS), min(len(found), i + RADIUS + 1)):
            if beside(b.path, found[j].path, paths):
                k = KERNEL[abs(i - j)]
                text, marks, total = text + k * ratio[j][0], marks + k * ratio[j][1], total + k
        value[b.path] = max(value[b.path], fused(text / total, marks / total))
    most = max(max(s[0] for s in own), 1.0)
    value = [v * (max(s[0], 1.0) / most) ** 0.25 for v, s in zip(value, own, strict=True)]
    apart = [1 - (1 - (LINKS_INSIDE if main else LINKS)) * s[3] / (s[0] + s[3]) if s[3] else 1.0 for s, main in zip(own, paths.main, strict=True)]
    named = names(paths, [a * v for a, v in zip(apart, value, strict=True)])
    some_main = any(paths.main[b.path] and not named[b.path] for b in found)
    weight = [a * (NAMED if x else 1.0) * (OUTSIDE if some_main and not main else 1.0) for a, x, main in zip(apart, named, paths.main, strict=True)]
    # the same sums of each container; a node's number is larger than its parent's
    inner = [[w * x for x in s] for w, s in zip(weight, own, strict=True)]
    largest = [0.0] * n  # text of the largest container right below
    holds = [False] * n
    for k in range(n - 1, 0, -1):
        for x in range(3):
            inner[up[k]][x] += inner[k][x]
        if holds[k]:
            largest[up[k]] = max(largest[up[k]], inner[k][0])
        holds[up[k]] |= inner[k][2] > 0
    # a container is worth its own ratios, or those of a path right below that makes up so much of its text
    leads = [0.0] * n
    for k in range(1, n):
        leads[up[k]] = max(leads[up[k]], weight[k] * value[k] * own[k][0] / max(inner[up[k]][0], 1.0))
    lift = [0.0] * n
    for k in range(1, n):
        p = up[k]
        text, marks, blocks_in, _ = inner[p]
        if p and paths.tag[p] not in ("html", "body") and blocks_in and largest[p] < WRAPS * text:
            lift[k] = LIFT * max(leads[p], fused(text / blocks_in, marks / blocks_in) * min(1.0, text / most) ** 0.25)
        lift[k] = max(lift[k], DEEPER * lift[p])
    value = [w * max(v, x) if s[2] else 0.0 for w, v, x, s in zip(weight, value, lift, own, strict=True)]
    best = max((v for k, v in enumerate(value) if not named[k]), default=0.0)
    return [b for b in found if value[b.path] >= LEAST * best and best]


def names(paths: Paths, value: list[float]) -> list[bool]:
    """Whether each path stays named by itself or a part around it, given the values of all paths."""
    n, up = len(paths.up), paths.up
    inside = value[:]
    for k in range(n - 1, 0, -1):
        inside[up[k]] = max(inside[up[k]], inside[k])
    below: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        below[up[k]].append(k)
    named = [True] * n
    best, some_main = 0.0, False  # of the paths outside of all named parts
    rivals: list[tuple[float, int]] = []
    todo = [0]
    while True:
        while todo:
            k = todo.pop()
            named[k] = False
            best, some_main = max(best, value[k]), some_main or (paths.main[k] and value[k] > 0)
            for c in below[k]:
                if paths.named[c]:
                    heapq.heappush(rivals, (-inside[c], c))
                else:
                    todo.append(c)
        while rivals and not todo and not some_main and best < LEAST * -rivals[0][0]:
            _, c = heapq.heappop(rivals)
            if paths.named[c] == BY_WORD or (paths.named[c] == AS_COMMENTS and best == 0):
                todo.append(c)
        if not todo:
            return named


def beside(a: int, b: int, paths: Paths) -> bool:
    """Whether two paths are of one container and weigh alike."""
    return a == b or (paths.up[a] == paths.up[b] and paths.named[a] == paths.named[b])


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in content(*blocks(page))) if page else ""


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with text and n_chars in place of its html column."""
    rest = df.drop(*[c for c in df.columns if c.lower() in ("text", "n_chars") and c != html])
    kept = [f for f in rest.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = [main_text(t) for t in b.column(html).to_pylist()]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*names, "text", "n_chars"],
            )

    return rest.mapInArrow(run, schema)
