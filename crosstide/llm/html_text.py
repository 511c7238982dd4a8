"""Main text of web pages: the maximum-scoring subsequence of words and tags, with weights from labelled pages.

A page is read as a sequence of words and tags. `fit` learns from pages with their texts (LABELLED of them at most):
- evidence: for each element name (within an article or main on its own account) and each name in class, id and role
  what it adds to the log odds that such an element lies in the text, by logistic regression over elements; of elements
  outside only the uppermost ones count. An element's evidence is the sum; a name of several parts, as in
  `sidebar-left`, counts by its parts if all of these were seen, else not at all. Elements under OUT, and all in them,
  are outside.
- scores: words of running text get their log odds, words in links and words outside theirs (positive is the first,
  negative the others), and each tag the log of its probability to be in the text, which is negative.

One linear scan finds the contiguous region of the greatest sum (of equal ones the first). It is widened to the element
that holds it and on to the outermost one around it with evidence over IN; where there is none, for as long as what the
parent adds scores above zero. Then the blocks in it are given, without what is outside; where no such element bounds
it, also without blocks of links alone beside the region.

A block is what stands between block-level tags: character references decoded, white space as one space, trimmed;
<br> counts as white space. Unclosed and stray tags are allowed. Scripts, styles and other elements whose content is no
text (MARKUP) are left out by their meaning. Null html: empty text. A page without positive score: empty. Time is linear
in the page, however long, deep or broken. Repeated rows: a row each. An empty table: none. Other columns are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.shipping import ship

from .common import spread, table

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+|[0-9]+")

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never running text.
MARKUP = frozenset("script style head title noscript template iframe object svg math canvas button select textarea input audio video".split())
#: What ends an open element of the same or a like kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HOLDS, WHOLE, FRAME = ("ul", "ol", "dl", "table", "select"), ("article", "main"), ("html", "body", "")
#: What a token counts as.
WORD, LINK, OUTSIDE, BLOCK_END = "word", "link word", "outside word", "block"
#: Evidence under which an element is outside, and over which it holds the article; labelled pages that are used at most.
OUT, IN, LABELLED = -1.0, 1.5, 5000
_ENDS: dict[str, re.Pattern] = {}


class Node:
    __slots__ = ("name", "parent", "outside", "link", "low", "high", "features", "evidence")

    def __init__(self, name: str, parent: Node | None, outside: bool, link: bool, low: int, features: tuple = (), evidence: float = 0.0):
        self.name, self.parent, self.outside, self.link, self.low, self.high = name, parent, outside, link, low, low
        self.features, self.evidence = features, evidence


def features_of(name: str, attributes: str, within: bool) -> tuple[str, ...]:
    """The element's name and those it is given, and whether it is hidden. A heading's names say what it is about."""
    out = ["in " + name if within else name]
    if attributes and name not in HEADINGS:
        out += [f".{t}" for g in _NAMES.findall(attributes) for t in "".join(g).lower().split()]
    if attributes and _HIDDEN.search(attributes):
        out.append("hidden")
    return tuple(out)


def evidence_of(features: tuple[str, ...], weights: dict[str, float]) -> float:
    total = 0.0
    for f in features:
        if f in weights or f[0] != ".":
            total += weights.get(f, 0.0)
        elif (parts := [f".{p}" for p in _PART.findall(f)]) and all(p in weights for p in parts):
            total += sum(weights[p] for p in parts)
    return total


def read(page: str, weights: dict[str, float]) -> tuple[list[tuple[str, int, Node, str]], list[Node]]:
    """Tokens (kind, words, element, text; a tag's kind is `<name`, a block's end has kind `block`) and all elements."""
    root = Node("", None, False, False, 0)
    stack, nodes, out, at, n, last = [root], [root], [], 0, len(page), page.rfind(">")
    open_at: dict[str, list[int]] = {}

    def text(s: str) -> None:
        if s:
            now = stack[-1]
            out.append((OUTSIDE if now.outside else LINK if now.link else WORD, len(s.split()), now, s))

    def nearest(names: Iterable[str]) -> int:
        return max((places[-1] for x in names if (places := open_at.get(x))), default=0)

    def close(upto: int) -> None:
        while len(stack) > upto:
            k = stack.pop()
            k.high = len(out)
            open_at[k.name].pop()

    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last:
            text(page[at:])
            break
        text(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            continue
        m = _TAG.match(page, start) or _BROKEN.match(page, start)
        if not m:
            text("<")
            at = start + 1
            continue
        at, name, attributes = m.end(), m[2].lower(), m[3]
        block = name in BLOCK
        if block:
            out.append((BLOCK_END, 0, stack[-1], ""))
        elif name == "br":
            text(" ")
        out.append((f"<{name}", 1, stack[-1], ""))
        if m[1]:
            place = nearest((name,))
            if place and (name in WHOLE or name in FRAME or place > nearest(WHOLE)):
                close(place)
        elif name not in VOID:
            if block:
                ends = nearest(("p", *CLOSES.get(name, ())))
                if ends > max(nearest(HOLDS), nearest(WHOLE)):
                    close(ends)
            now = stack[-1]
            features = features_of(name, attributes, nearest(WHOLE) > 0)
            evidence = 0.0 if name in FRAME else evidence_of(features, weights)
            new = Node(name, now, now.outside or name in MARKUP or evidence < OUT, now.link or name == "a", len(out) - 1 - block, features, evidence)
            open_at.setdefault(name, []).append(len(stack))
            stack.append(new)
            nodes.append(new)
            if name in RAW:
                ending = _ENDS.setdefault(name, re.compile(rf"</{name}\s*>", re.IGNORECASE)).search(page, at)
                text(page[at : ending.start() if ending else n])
                at = ending.start() if ending else n
    close(1)
    root.high = len(out)
    return out, nodes


def blocks(tokens: Iterable[tuple[str, int, Node, str]], low: int = 0, high: float = math.inf) -> list[str]:
    """Texts of the blocks that aren't outside; before low and from high on only those with words that are no links."""
    out, parts, words = [], [], False

    def flush() -> None:
        if parts and words and (s := " ".join(entities.unescape("".join(parts)).split())):
            out.append(s)
        parts.clear()

    for k, (kind, n, _, s) in enumerate(tokens):
        if kind == BLOCK_END:
            flush()
            words = False
        elif s and kind != OUTSIDE:
            parts.append(s)
            words = words or n > 0 and (kind == WORD or low <= k < high)
    flush()
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch of the greatest sum, in one scan; (0, 0) if none is above zero."""
    best, found, now, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, k
        now += s
        if now > best:
            best, found = now, (start, k + 1)
    return found


def _sides(tokens: list[tuple[str, int, Node, str]], lines: set[str]) -> list[bool]:
    """For each token whether it is in a block that is a line of the text."""
    out, group = [], 0
    for k in range(len(tokens) + 1):
        if k == len(tokens) or tokens[k][0] == BLOCK_END:
            said = " ".join(entities.unescape("".join(t[3] for t in tokens[group:k])).split())
            out += [bool(said) and said in lines] * (k - group)
            if k < len(tokens):
                out.append(False)
            group = k + 1
    return out


def _regression(seen: list[tuple[tuple[str, ...], bool]], rounds: int = 30) -> dict[str, float]:
    """Log odds by feature: logistic regression without a constant, by rounds of small steps in the order given."""
    out: dict[str, float] = dict.fromkeys((f for features, _ in seen for f in features), 0.0)
    for k in range(rounds):
        step = 1.0 / (1 + k / 5)
        for features, side in seen:
            odds = max(-30.0, min(30.0, sum(out[f] for f in features)))
            off = step * (side - 1 / (1 + math.exp(-odds)))
            for f in features:
                out[f] = 0.9999 * out[f] + off / len(features)
    return out


def fit(labelled: Iterable[tuple[str, str]], most: int = LABELLED) -> dict[str, float]:
    """Weights from (html, text) pairs, `most` of them: evidence by feature and, under `score of ...`, by kind of token."""
    pages = [x for x, _ in zip(labelled, range(most), strict=False)]
    seen: list[tuple[tuple[str, ...], bool]] = []
    for page, text in pages:
        tokens, nodes = read(page, {})
        sides = _sides(tokens, set(text.split("\n")))
        good, bad = [0], [0]
        for (kind, n, _, _), side in zip(tokens, sides, strict=True):
            words = n if kind in (WORD, LINK) else 0
            good.append(good[-1] + words * side)
            bad.append(bad[-1] + words * (not side))
        inside = {id(x): good[x.high] - good[x.low] >= bad[x.high] - bad[x.low] for x in nodes}
        for x in nodes[1:]:
            if x.name in FRAME or good[x.high] == good[x.low] and bad[x.high] == bad[x.low]:
                continue
            if inside[id(x)] or x.parent.name in FRAME or inside[id(x.parent)]:  # of elements outside the uppermost one
                seen.append((x.features, inside[id(x)]))
                parts = tuple(q for f in x.features for q in ([f".{p}" for p in _PART.findall(f)] if f[0] == "." else [f]))
                if parts != x.features:  # once more as if the whole name were unknown
                    seen.append((parts, inside[id(x)]))
    out = _regression(seen)
    yes, no = Counter(), Counter()
    for page, text in pages:
        tokens, _ = read(page, out)
        for (kind, n, node, _), side in zip(tokens, _sides(tokens, set(text.split("\n"))), strict=True):
            (yes if side or kind[0] == "<" and not node.outside and node.name not in FRAME else no)[kind] += n
    for kind in yes | no:
        odds = math.log((yes[kind] + 1) / (no[kind] + 1))
        out[f"score of {kind}"] = math.log((yes[kind] + 1) / (yes[kind] + no[kind] + 2)) if kind[0] == "<" else max(odds, 0.5) if kind == WORD else min(odds, -0.5)
    return out


#: What the module's own labelled pages have: elements and names outside the text, in it, and on either side; fixed values.
OUT_TAGS = "nav footer aside form header dialog menu".split()
OUT_NAMES = (
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner menu menubar navbar nav navigation breadcrumb breadcrumbs sidebar sidebars aside "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "comment comments commentlist disqus reply replies respond footer masthead topbar toolbar pagination pager copyright legal disclaimer skip toc complementary contentinfo search"
).split()
IN_NAMES = "article post entry content story text prose blog news body main page single has-sidebar with-sidebar no-sidebar has-ads with-comments has-nav".split()
EITHER = "left right top bottom wrapper box inner outer block area container section list item 1 2".split()
IN_TAGS = "h2 h3 h4 p blockquote pre ul ol table figure section div header dl details".split()


def own_pages() -> Iterator[tuple[str, str]]:
    """Labelled pages of the usual kinds: each name and element once or more beside or in a short article."""
    said = "the river rose in the night and the mill stood in water until the morning came with wind".split()
    lines = [" ".join(said[k % 5 :]) for k in range(6)]
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in said[:9]) + "</ul>"
    body = "<h1>the flood</h1>" + "".join(f"<p>{x}</p>" for x in lines)
    text = ["the flood", *lines]

    def page(before: str, holder: str, within: str = "", after: str = "", more: list[str] | None = None) -> tuple[str, str]:
        open_, shut = f"<{holder}>", f"</{holder.split()[0]}>"
        return f"<html><head><title>the flood</title></head><body>{before}{open_}{body}{within}{shut}{after}</body></html>", "\n".join([*text, *(more or [])])

    holders = ["article", "main", *[f'div class="{x}"' for x in IN_NAMES], *[f'div id="{x}"' for x in IN_NAMES[:4]]]
    for k, holder in enumerate(holders):
        yield page(f"<nav>{menu}</nav><header>{menu}</header>", holder, "", "<footer>all kept by us</footer>")
        yield page(f'<div id="{OUT_NAMES[k]}">{menu}</div>', holder, "", f'<div class="{OUT_NAMES[-1 - k]}">{lines[1]} indeed</div>')
    for k, x in enumerate(OUT_NAMES):
        holder = holders[k % len(holders)]
        yield page(f'<div class="{x}">{lines[2]} now</div>', holder, "", f'<{("div", "section", "ul")[k % 3]} id="{x}"><p>{lines[3]} then</p></{("div", "section", "ul")[k % 3]}>')
        yield page(f"<nav>{menu}</nav>", ("div", "section", "div")[k % 3], "<div>so on</div>", f'<section class="{x}">{lines[4]} now</section>', ["so on"])
        yield page(f'<div class="{EITHER[k % len(EITHER)]}-{x}">{menu}</div>', ("article", "main", holder)[k % 3], f'<div class="{x}">{lines[0]} too</div>')
    for k, x in enumerate(OUT_TAGS):
        for holder in (*holders[:2], holders[k + 2]):
            yield page(f"<{x}>{menu}</{x}>", holder, "" if x == "header" else f"<{x}>{lines[2]} now</{x}>", f"<{x}>{lines[1]} indeed</{x}>")
        yield page("", holders[k + 2], "", f'<div hidden>{lines[1]} indeed</div><div style="display:none">{lines[2]} now</div>')
    for k, x in enumerate(EITHER):
        yield page("", f'div class="content-{x}"', "", f'<div class="sidebar-{x}">{lines[2]} now</div>')
        yield page(f'<div class="{x}">{lines[2]} now</div>', f'div class="{x}"', f'<span class="{x}"></span><div class="{x}">and so on it went</div>', f"<div>{lines[1]} indeed</div>", ["and so on it went"])
    for x in IN_TAGS:
        said_too = f"so it was told by the {x}"
        row = {"ul": "<li>{}</li>", "ol": "<li>{}</li>", "table": "<tr><td>{}</td></tr>", "dl": "<dd>{}</dd>"}.get(x, "{}").format(said_too)
        for holder in ("article", "main", 'div class="content"', 'div class="post"'):
            yield page(f"<nav>{menu}</nav>", holder, f"<{x}>{row}</{x}>" if x != "header" or holder in WHOLE else f"<section>{row}</section>", "", [said_too])


_weights: dict[str, float] = {}


def own_weights() -> dict[str, float]:
    if not _weights:
        _weights.update(fit(own_pages()))
    return _weights


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text, blocks joined by line ends."""
    if not page:
        return ""
    weights = own_weights() if weights is None else weights
    tokens, _ = read(page, weights)
    unseen = weights.get("score of <div", -0.5)
    score = {kind: weights.get(f"score of {kind}", unseen if kind[0] == "<" else 0.0) for kind in {t[0] for t in tokens}}
    scores = [score[kind] * n if kind != BLOCK_END else 0.0 for kind, n, _, _ in tokens]
    low, high = best_region(scores)
    words = [k for k in range(low, high) if tokens[k][0] in (WORD, LINK) and tokens[k][1]]
    if not words:
        return ""
    low, high, holder = words[0], words[-1] + 1, tokens[words[0]][2]
    while holder.parent and not (holder.low <= low and high <= holder.high):
        holder = holder.parent
    whole, k = None, holder
    while k:
        whole, k = k if k.evidence > IN else whole, k.parent
    if whole:
        return "\n".join(blocks(tokens[whole.low : whole.high]))
    sums = [0.0]
    for (kind, _, _, _), s in zip(tokens, scores, strict=True):
        sums.append(sums[-1] + (s if kind in (WORD, LINK) else 0.0))
    while holder.parent and holder.name != "body":
        up = holder.parent
        if sums[holder.low] - sums[up.low] + sums[up.high] - sums[holder.high] < 0:
            break
        holder = up
    return "\n".join(blocks(tokens[holder.low : holder.high], low - holder.low, high - holder.low))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    ship(pages.sparkSession)
    weights = own_weights() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(p, weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
