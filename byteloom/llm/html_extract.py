"""Main text of web pages by union-free wrappers.

Each page becomes a stream of tokens: opening and closing tags of its block elements, and texts. Per host
the streams are aligned one after the other into a wrapper, a regular expression without unions. Runs of
equal elements, alone or in twos and threes, fold into repeated groups; elements that some pages lack
become optional groups; texts that differ become slots, and texts that never differ stay constants of the
template. A repeated group remembers the first and last EDGES contents, so a notice before or after an
article's paragraphs stays a constant although it looks like one of them. Wrappers of parts of a host
merge by the same alignment, FAN at a time in as many rounds as that takes, so no host's pages meet in one task.

The wrapper decides what the main text is: the element that holds at least MAIN of the varying prose (text
outside links; what tags and class words call chrome counts a quarter) on a host with at least TITLES
different titles. Tags only settle what it leaves open: descent stops at an article or main element, and
article or main is taken where the wrapper finds no such element or has seen too few titles. Below that
element goes what the wrapper shows to be template (constants seen with at least TITLES different titles,
headings aside), and what is by its tag, role or class a menu, header, footer, sidebar, notice, advert,
form or comment.

Defined results: null and empty pages give an empty text; a page without url belongs to the host of
no name; repeated rows give equal texts; an empty table gives an empty result; a page of any length is read
whole; elements below DEPTH levels belong to the one at that level, their texts stay blocks of their own;
where an element has more than WIDTH unlike children, the rarest are told apart by their tags alone; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import discard, materialize, tune

#: Templates may be broadcast up to so many bytes in all; beyond that they are joined.
BROADCAST_BYTES = 32 << 20
#: Different titles that make a constant or a wrapper sure; share of the varying prose below the main element.
TITLES, MAIN = 5, 0.6
#: Contents that each end of a repeated group remembers; unlike children of a wrapper's element; levels of elements.
EDGES, WIDTH, DEPTH = 3, 64, 128
#: Wrappers of a host that one task merges; tokens that a task's wrappers were made of before it hands them on.
FAN, FLUSH = 64, 5_000_000
#: Longest attributes that are remembered, and how many.
ATTR_CHARS, ATTR_CACHE = 300, 20_000

#: Attributes as a browser reads them: a value in quotes may hold anything but the quote.
_ATTRIBUTES = r"(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|iframe|select|svg)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>{_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("br hr img input link meta area base col embed source track wbr param".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
SKIP_TAGS = frozenset("head nav footer aside form menu dialog title fieldset".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation navi menu menus submenu masthead footer foot sidebar sidebars side ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion promos sponsor sponsored cookie cookies consent notice notices notification gdpr popup modal overlay newsletter subscribe subscription signup share sharing social breadcrumb breadcrumbs comment comments reply replies respond disqus discussion related recommended recommendations widget widgets pagination pager toolbar skip login search hidden copyright disclaimer paywall topbar outbrain taboola".split()
)
OUTSIDE_WORDS = frozenset("header head top bottom legal meta tags".split())
MAIN_WORDS = frozenset("article post entry content main story body text".split())
SPACES = re.compile(r"[\s_-]+")


class Node:
    """An element, or a text if its tag is '#'. own: it is chrome itself; skip: it or an element around it is."""

    __slots__ = ("key", "kids", "links", "mainly", "own", "skip", "tag", "text")

    def __init__(self, tag: str, key: str, skip: bool) -> None:
        self.tag, self.key, self.skip, self.own = tag, key, skip, skip
        self.kids: list[Node] = []
        self.text, self.links, self.mainly = "", 0, False


_ATTRS: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def _looked(tag: str, attr: str) -> tuple[str, bool, bool, bool]:
    """(key, chrome anywhere, chrome outside an article, main) of an opening tag; remembered if short."""
    got = _ATTRS.get((tag, attr))
    if got is None:
        found: dict[str, str] = {}
        for name, a, b, c in ATTR.findall(attr):
            found.setdefault(name.lower(), a or b or c)
        words = [w for w in SPACES.split(f"{found.get('class', '')} {found.get('id', '')}".lower()) if w]
        role = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        mainly = any(w in MAIN_WORDS for w in words)
        chrome = tag in SKIP_TAGS or role in SKIP_ROLES or hidden or any(w in SKIP_WORDS for w in words)
        outside = tag == "header" or not mainly and any(w in OUTSIDE_WORDS for w in words)
        named = next((w for w in words if not any(c.isdigit() for c in w)), "")
        got = (f"{tag}.{named}" if named else tag, chrome, outside, tag == "main" or role in ("main", "article"))
        if len(attr) <= ATTR_CHARS:
            if len(_ATTRS) >= ATTR_CACHE:
                _ATTRS.clear()
            _ATTRS[tag, attr] = got
    return got


def parse(page: str) -> Node:
    """The elements that the token stream opens and closes, in time linear in its length."""
    root = Node("", "", False)
    stack, buf, at = [root], [], 0
    deeper: dict[str, int] = {}  # tags opened below DEPTH and not yet closed
    link, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            buf.clear()
            if text:
                slot = Node("#", "#", stack[-1].skip)
                slot.text, slot.links, slot.own = text, min(len(text), linked), False
                stack[-1].kids.append(slot)
        linked = 0

    def push(tag: str, key: str, skip: bool) -> Node:
        node = Node(tag, key, skip)
        stack[-1].kids.append(node)
        stack.append(node)
        return node

    for m in TOKEN.finditer(page):
        if m.start() > at:
            buf.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag not in BLOCKS:
            # inline: only its chrome matters, as an element of its own
            if tag in VOID:
                continue
            if tag == "a":
                link = 0 if m["end"] else 1
            if not m["end"]:
                key, chrome, _, _ = _looked(tag, m["attr"]) if m["attr"] else (tag, False, False, False)
                if (chrome or stack[-1].tag == tag) and not m["attr"].endswith("/") and len(stack) <= DEPTH:
                    flush()
                    push(tag, key, True)
            elif stack[-1].tag == tag:
                flush()
                stack.pop()
            continue
        flush()
        if m["end"]:
            if deeper.get(tag):
                deeper[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    deeper.clear()
                    break
            continue
        closes, stops = CLOSES.get(tag, ()), STOPS.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            t = stack[k].tag
            if t == "p" or t in closes:
                del stack[k:]
                if t != "p":
                    break
            elif t in stops or t in BLOCKS and t not in closes:
                if not closes or t in stops or t in ("body", "article", "main", "div", "section"):
                    break
        if len(stack) > DEPTH:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        key, chrome, outside, mainly = _looked(tag, m["attr"])
        inside = any(n.mainly for n in stack)
        own = chrome or outside and not inside
        node = push(tag, key, stack[-1].skip or own)
        node.own, node.mainly = own, mainly or tag == "article"
    if at < len(page):
        buf.append(page[at:])
    flush()
    return root


# A wrapper's item: [key, seen, optional, repeated, front, back, mass, hint, children]. front and back hold a
# checksum for each of the first and last contents of its run, or None where they differ from page to page,
# with the titles seen with it; mass is the prose of a text; hint is 2 for article and main elements, 1 for
# headings. An item of key '()' is a group of two or three, one of key '' a whole page.
KEY, SEEN, OPT, REP, FRONT, BACK, MASS, HINT, KIDS = range(9)


def _checksum(text: str) -> int:
    b = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) << 32 | zlib.adler32(b)


def skeleton(node: Node, title: int, cap: bool = True, refs: dict | None = None) -> list:
    """A page's stream as a wrapper, chrome included (it is the template's). refs: gathers id(child) -> (item's key, places from the front and back of its run, checksum)."""
    if node.tag == "#":
        seen = [[_checksum(node.text), [title]]]
        prose = len(node.text) - node.links
        return ["#", 1, False, False, seen, seen, prose / 4 if node.skip else prose, 0, []]
    kids = [k for k in node.kids if k.tag != "head"]
    items = [skeleton(k, title, cap, refs) for k in kids]
    total = 1
    for k in items:
        total = (total * 1_000_003 + (k[FRONT][0][0] or 0)) & 0xFFFFFFFFFFFFFFFF
    if refs is not None:
        for name, run in _runs(items):
            for i, k in enumerate(run):
                refs[id(kids[k])] = (name, i, len(run) - 1 - i, items[k][FRONT][0][0])
    seen = [[total, [title]]]
    hint = 2 if node.mainly else 1 if node.tag in ("h1", "h2") and not node.skip else 0
    folded = fold(items)
    return [node.key, 1, False, False, seen, seen, 0, hint, narrowed(folded) if cap else folded]


def _units(keys: list[str]) -> Iterator[tuple[int, int, int]]:
    """(start, width, times): the stream's stretches, repeated units of one to three children first."""
    i, n = 0, len(keys)
    while i < n:
        for width in (1, 2, 3):
            j = i + width
            while j + width <= n and keys[j : j + width] == keys[i : i + width]:
                j += width
            if j > i + width:
                yield i, width, (j - i) // width
                i = j
                break
        else:
            yield i, 1, 1
            i += 1


def _runs(items: list[list]) -> Iterator[tuple[str, list[int]]]:
    """Each run of children that fold() makes one item of."""
    for start, width, times in _units([k[KEY] for k in items]):
        for w in range(width):
            yield items[start + w][KEY], list(range(start + w, start + width * times, width))


def fold(items: list[list]) -> list[list]:
    """Neighbours that repeat, alone or in twos and threes, become one repeated group."""
    out: list[list] = []
    for start, width, times in _units([k[KEY] for k in items]):
        if times == 1:
            out += items[start : start + width]
            continue
        unit = []
        for w in range(width):
            run = items[start + w : start + width * times : width]
            one = run[0]
            for k in run[1:]:
                one = _merge(one, k)
            one[SEEN], one[REP], one[OPT] = 1, True, False
            one[FRONT], one[BACK] = [k[FRONT][0] for k in run[:EDGES]], [k[FRONT][0] for k in run[: -EDGES - 1 : -1]]
            unit.append(one)
        out += unit if width == 1 else [["()", 1, False, True, [[None, []]], [[None, []]], 0, 0, unit]]
    return out


def narrowed(items: list[list]) -> list[list]:
    """Beyond WIDTH children, the rarest keep their tags alone, and those of one tag become one repeated item; nothing is forgotten."""
    if len(items) <= WIDTH:
        return items
    rare = {id(k) for k in sorted(items, key=lambda k: k[SEEN])[: len(items) - WIDTH]}
    out, by_key = [], {}
    for k in items:
        if id(k) in rare or k[KEY].endswith(".*"):
            key = "()" if k[KEY] == "()" else "#" if k[KEY] == "#" else k[KEY].split(".")[0] + ".*"
            if key in by_key:
                at = by_key[key]
                seen = max(out[at][SEEN], k[SEEN])
                out[at] = _merge(out[at], [key, *k[1:]])
                out[at][SEEN], out[at][OPT], out[at][REP] = seen, True, True
                continue
            by_key[key] = len(out)
            k = [key, *k[1:]]
        out.append(k)
    return out


def _edges(a: list, b: list) -> list:
    """Two ends' contents, place by place; a place that only one of them has stays as it is."""
    out = []
    for k in range(max(len(a), len(b))):
        x, y = a[k] if k < len(a) else None, b[k] if k < len(b) else None
        if x is None or y is None:
            out.append(x or y)
        elif x[0] is not None and x[0] == y[0]:
            out.append([x[0], sorted({*x[1], *y[1]})[:TITLES]])
        else:
            out.append([None, []])
    return out


def _merge(a: list, b: list) -> list:
    if not a[KEY]:  # a page: the different titles seen
        heads = [[None, sorted({*a[FRONT][0][1], *b[FRONT][0][1]})[:TITLES]]]
        return ["", a[SEEN] + b[SEEN], False, False, heads, heads, 0, 0, align(a[KIDS], b[KIDS])]
    return [a[KEY], a[SEEN] + b[SEEN], a[OPT] or b[OPT], a[REP] or b[REP], _edges(a[FRONT], b[FRONT]), _edges(a[BACK], b[BACK]), a[MASS] + b[MASS], max(a[HINT], b[HINT]), align(a[KIDS], b[KIDS])]


def _optional(k: list) -> list:
    return [*k[:OPT], True, *k[OPT + 1 :]]


def align(a: list[list], b: list[list]) -> list[list]:
    """Two streams of children become one: common elements merge in order (longest common subsequence), the others turn optional."""
    if not a or not b:
        return [_optional(k) for k in a or b]
    x, y = [k[KEY] for k in a], [k[KEY] for k in b]
    if x == y:
        return [_merge(p, q) for p, q in zip(a, b, strict=True)]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = [_merge(p, q) for p, q in zip(a[:head], b[:head], strict=True)]
    ends = [_merge(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    a, b, x, y = a[head : len(a) - tail], b[head : len(b) - tail], x[head : len(x) - tail], y[head : len(y) - tail]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return narrowed(out + ends)


def _varying(w: list) -> float:
    """The prose in a wrapper's slots. Constants seen with at least two titles are none."""
    if w[KEY] == "#":
        edges = w[FRONT] + w[BACK]
        return 0.0 if all(c is not None and len(t) > 1 for c, t in edges) else float(w[MASS])
    return sum(map(_varying, w[KIDS]))


def _heading(w: list) -> bool:
    """Whether a heading that varies stands in w."""
    return w[HINT] == 1 and _varying(w) > 0 or any(_heading(k) for k in w[KIDS])


def template(w: list) -> dict:
    """What extraction needs of a wrapper: the path to the varying prose, the constants with their places, and elements with generalised children."""
    consts, wild = [], {}

    def walk(node: list, path: str) -> None:
        if any(k[KEY].endswith(".*") for k in node[KIDS]):
            wild[path] = sorted({k[KEY] for k in node[KIDS]})
        for k in node[KIDS]:
            below = path if k[KEY] == "()" else f"{path}/{k[KEY]}"
            if k[KEY] != "()" and not re.match(r"h[1-6]\b", k[KEY]) and not re.search(r"/h[1-6][^/]*$", path):
                for side, edges in (("F", k[FRONT]), ("B", k[BACK])):
                    consts.extend(f"{below} {side}{i} {c}" for i, (c, t) in enumerate(edges) if c is not None and len(t) >= TITLES)
            walk(k, below)

    walk(w, "")
    path, node = [], w
    total = _varying(w)
    while node[HINT] != 2 and total > 0:
        kids = [k for k in node[KIDS] if k[KEY] != "#" and not k[KEY].endswith(".*")]
        heavy = max(kids, key=_varying, default=None)
        if heavy is None or heavy[REP] or heavy[KEY] == "()" or _varying(heavy) < MAIN * total:
            break
        if path and any(k is not heavy and _heading(k) for k in node[KIDS]):
            break
        path.append(heavy[KEY])
        node = heavy
    settled = bool(path) and path[-1].split(".")[0] not in ("html", "body")
    return {"root": path if settled else [], "sure": len(w[FRONT][0][1]) >= TITLES, "consts": sorted(set(consts)), "wild": wild}


def _outermost(node: Node, tag: str) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        for k in reversed(n.kids):
            if not k.skip and k.tag == tag:
                out.append(k)
        todo += [k for k in n.kids if not k.skip and k.tag != tag]
    return out


def _found(root: Node, path: list[str]) -> list[Node]:
    """The elements at a wrapper's path; none if the page lacks it."""
    tops = [root]
    for key in path:
        tops = [k for t in tops for k in t.kids if k.key == key]
    return tops if path else []


def extract(page: str | None, known: dict | None) -> str:
    """The main text; known is the host's template, if there is one."""
    if not page:
        return ""
    root = parse(page)
    known = known or {"root": [], "sure": False, "consts": frozenset(), "wild": {}}
    by_wrapper, by_tag = _found(root, known["root"]), _outermost(root, "article") or _mains(root)
    sure = known["sure"] and not (by_tag and any(t.skip for t in by_wrapper))
    tops = (by_wrapper if sure else None) or by_tag or by_wrapper or [root]
    consts, wild = known["consts"], known["wild"]
    refs: dict[int, tuple] = {}
    if consts:
        skeleton(root, 0, False, refs)
    out: list[str] = []
    chosen = {id(t) for t in tops}
    # Children lie on the stack in reverse, with the path of the wrapper's item and whether they are in the main text.
    todo = [(root, "", id(root) in chosen, True)]
    while todo:
        node, path, on, first = todo.pop()
        if not first and consts:
            key, i, j, checksum = refs.get(id(node), (node.key, 0, 0, 0))
            if path in wild and key not in wild[path]:
                key = key.split(".")[0] + ".*"
            path = f"{path}/{key}"
            if f"{path} F{i} {checksum}" in consts or f"{path} B{j} {checksum}" in consts:
                continue
        if node.tag == "#":
            if on:
                out.append(node.text)
            continue
        todo += [(k, path, on or id(k) in chosen, False) for k in reversed(node.kids) if not (on and k.own) or id(k) in chosen]
    return "\n".join(out)


def _mains(root: Node) -> list[Node]:
    """The outermost main elements, by tag or role."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.mainly and n.tag != "article":
            out.append(n)
        else:
            todo += [k for k in n.kids if not k.skip]
    return out


def _title(root: Node) -> int:
    stack, best = [root], ""
    while stack:
        n = stack.pop()
        if n.tag in ("h1", "title"):
            best = best or " ".join(k.text for k in n.kids)
            if n.tag == "h1":
                break
        stack.extend(reversed(n.kids))
    return zlib.crc32(best.encode("utf-8", "surrogatepass"))


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): inferred from all pages, partial wrappers first, then FAN of them at a time."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        tokens = 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not page:
                    continue
                root = parse(page)
                own = skeleton(root, _title(root))
                known[host] = _merge(known[host], own) if host in known else own
                tokens += page.count("<")
                if tokens > FLUSH:
                    yield _wrappers(known)
                    known, tokens = {}, 0
        yield _wrappers(known)

    def merged(group: pd.DataFrame) -> list:
        wrapper = None
        for text in sorted(group["wrapper"]):
            w = json.loads(text)
            wrapper = w if wrapper is None else _merge(wrapper, w)
        return wrapper

    def some(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(merged(group))]})

    def last(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [json.dumps(template(merged(group)))]})

    parts = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(partial, "host string, wrapper string")
    parts = materialize(parts, "wrappers")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > FAN:
        dealt = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(-(-2 * most // FAN))))
        fewer = materialize(dealt.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string"), "wrappers")
        discard(parts)
        parts = fewer
    return parts.groupBy("host").applyInPandas(last, "host string, template string")


def _wrappers(known: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], ["host", "wrapper"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text and its length in code points."""
    spark = pages.sparkSession
    tune(spark)
    found = materialize(templates(pages, url_col, html_col), "templates")
    size = found.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    shared = None
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["template"] for r in found.collect()})
    else:
        rows = rows.join(found, "host", "left").select("id", "url", "template", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}

        def known(text: str | None) -> dict | None:
            text = shared.value.get(text) if shared else text
            if text is None:
                return None
            if text not in parsed:
                if len(parsed) > 1000:
                    parsed.clear()
                got = json.loads(text)
                parsed[text] = got | {"consts": frozenset(got["consts"])}
            return parsed[text]

        for batch in batches:
            texts = [extract(page, known(key)) for key, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
