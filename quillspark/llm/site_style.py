"""HTML extraction with a site style tree.

The pages of a host are merged by the style of their nodes: the path of element names, classes and ids (long numbers apart) from the
root. Over a host's distinct pages, a node has

- a presentation importance: the entropy of its child sequences (near 0: a template that looks the same on all pages),
- a content importance: one minus the mean entropy of its texts, each spread over the pages that show it (near 0: it reads the same everywhere),
- a weight: the words of its branch, each counted by its content importance.

The composite importance of a branch mixes its own with that of the branches below it, the deeper the less. Below a
template node, branches stand beside each other by design, so there it also counts what share of the heaviest branch's weight a branch has,
unless that heaviest one is a plain block (then its neighbours are its headings). Branches below THRESHOLD are
removed from each page. Roles (element names; words of class, id and role) are a prior: what says that it is not the article, or stands beside an
article element, counts PRIOR times; article and main stay. Reader comments, hidden parts, scripts and styles always
go, for comments differ as much as articles do.

Roles alone decide where there is no tree to judge by: on hosts with fewer than PAGES distinct pages, and for nodes on fewer than a tenth of a
host's pages. A page of which the tree would leave nothing is read by roles too.

Text inside a block has its character references decoded and its white space turned into single spaces; blocks
are joined by a blank line. Null html or markup without text gives an empty text. Malformed markup is read as
browsers do where it matters here: unclosed paragraphs and items end at the next one, raw text ends at its own tag. Nesting may be of any depth.
Rows with a null url form one host. Copies of a page count once in the tree. A host's tree holds nodes that are on a tenth of its pages, so it is at most ten times as
large as a page, whatever number of pages the host has.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, staged, tidied, tune

THRESHOLD, PAGES = 0.1, 5
#: Below this presentation importance a node is a template.
TEMPLATE = 0.3
DECAY, PRIOR = 0.9, 0.2
#: Paths of all hosts that are broadcast at most; more are joined.
SENT_PATHS = 2_000_000

# HTML element names by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg object audio video canvas select annotation annotation-xml".split())
_INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math semantics mrow mi mo mn ms mtext mspace mstyle mpadded mphantom merror mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mfenced menclose""".split()
)
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl div article section body html td th button".split())
# Elements, and words of class, id and role names, that mark what is not the article.
_AWAY_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
_AWAY = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner bannerad sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs
    footer foot sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    discussion share sharing social related recommended recommendations pagination pager search contentinfo complementary skip toolbar""".split()
)
_AWAY_OUTSIDE = frozenset("header masthead topbar".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
# Words that may stand beside those in one name without changing its meaning.
_BESIDE = frozenset(
    """main site page global top bottom left right primary secondary inner outer box block area wrap wrapper container section list item items link links bar panel region zone unit module
    slot group row col column button buttons icon icons form posts post articles stories thread reader user""".split()
)
#: Words that may stand beside those that mark a part as away, but not beside those of page headers (an entry's header holds its title).
_BESIDE_AWAY = _BESIDE | frozenset("article entry wp".split())
_OPEN = re.compile(r"<(?=[!?a-zA-Z]|/[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/><]*+)")
_PLAIN = re.compile(r"""[^<>"']*+""")
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NEUTRAL, AWAY, OUTSIDE, GONE = range(4)


def _signed(x: int) -> int:
    return x - (1 << 63)


def _step(path: int, style: str) -> int:
    return _signed(xxhash.xxh64_intdigest(style, path & 0xFFFFFFFFFFFFFFFF))


def _marks(name: str, words: frozenset, beside: frozenset = _BESIDE) -> bool:
    """Does a name consist of such words, but for those that may stand beside them?"""
    parts = [x.lower() for x in _PART.findall(name)]
    return any(x in words for x in parts) and all(x in words or x in beside for x in parts)


@cache
def _named(tag: str, attributes: str) -> tuple[str, int]:
    """(style, role) of an element by its name and attributes."""
    role, style = AWAY if tag in _AWAY_TAGS else OUTSIDE if tag == "header" else GONE if tag == "head" else NEUTRAL, [tag]
    for name, value in _ATTR.findall(attributes) if len(attributes) > 2 else ():
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("hidden", "aria-hidden"):
            role = GONE if name == "hidden" or value == "true" else role
            continue
        tokens = sorted(value.split())
        if tag not in ("html", "body"):
            if any(_marks(x, _COMMENTS) for x in tokens):
                role = GONE
            elif tag not in ("article", "main") and any(_marks(x, _AWAY, _BESIDE_AWAY) for x in tokens):
                role = max(role, AWAY) if role != OUTSIDE else AWAY
            elif tag not in ("article", "main") and any(_marks(x, _AWAY_OUTSIDE) for x in tokens):
                role = role or OUTSIDE
        if name != "role":
            style.append(("." if name == "class" else "#") + ".".join(re.sub(r"\d{3,}", "0", x) for x in tokens))
    return "".join(style), role


class Page:
    """A page's elements in the order of their start tags, and its events: an element's number, its end (~number), or text."""

    __slots__ = ("tag", "style", "role", "parent", "path", "events")

    def __init__(self):
        self.tag, self.style, self.role, self.parent, self.path, self.events = ["html"], ["html"], [NEUTRAL], [-1], [_step(0, "html")], [0]


class _Scanner:
    """Tags of a markup in order, in time linear to its length however broken it is."""

    def __init__(self, markup: str):
        self.markup, self.size = markup, len(markup)
        self.last = {q: markup.rfind(q) for q in "\"'>"}  # behind these there is none

    def _after(self, what: str, at: int) -> int:
        return self.markup.find(what, at) if at <= self.last[what] else -1

    def tag(self, at: int) -> tuple[int, str, str] | None:
        """(end, name, attributes) of the tag at a ``<``; None if that begins none.

        Quotes without a partner are no quotes. A ``<`` outside of quotes, before any ``>``, shows that the first one was text. A tag that the
        text's end breaks off is markup if it has come to its attributes.
        """
        m = _NAME.match(self.markup, at)
        start = k = m.end()
        while True:
            k = _PLAIN.match(self.markup, k).end()
            if k >= self.size:
                return (self.size, m[1].lower(), "") if self.size > start else None
            c = self.markup[k]
            if c == ">":
                return k + 1, m[1].lower(), self.markup[start:k]
            if c == "<":
                return None
            close = self._after(c, k + 1)
            k = close + 1 if close >= 0 else k + 1

    def comment(self, at: int) -> int:
        """The end of the comment or declaration at ``<!`` or ``<?``."""
        if self.markup.startswith("<!--", at):
            end = self.markup.find("-->", at + 4)
            return end + 3 if end >= 0 else self.size
        end = self._after(">", at)
        return end + 1 if end >= 0 else self.size

    def raw(self, tag: str, at: int) -> int:
        """The end of a raw element's end tag."""
        m = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(self.markup, at)
        end = self._after(">", m.end()) if m else -1
        return end + 1 if end >= 0 else self.size


def parse(markup: str) -> Page:
    """The page's elements; text is left with its character references."""
    page = Page()
    tags, events = page.tag, page.events
    stack, at, size = [0], 0, len(markup)
    where: dict[str, list[int]] = defaultdict(list)  # of each open element, its places in the stack
    scopes: list[int] = []
    scan = _Scanner(markup)

    def end_from(k: int) -> None:
        for n in range(len(stack) - 1, k - 1, -1):
            i = stack[n]
            if n:
                where[tags[i]].pop()
                if scopes and scopes[-1] == n:
                    scopes.pop()
            events.append(~i)
        del stack[k:]

    def close(these: set) -> None:
        """Ends the nearest open element of these in scope, and all inside it."""
        k = max((where[t][-1] for t in these if where.get(t)), default=0)
        if k and k >= (scopes[-1] if scopes else 0):
            end_from(k)

    text = 0  # where the text not yet taken begins
    while at < size:
        m = _OPEN.search(markup, at)
        if m is None:
            break
        begin = m.start()
        if markup[begin + 1] in "!?":
            got, ends, tag = True, scan.comment(begin), None
        else:
            got = scan.tag(begin)
            if got is None:
                at = begin + 1
                continue
            ends, tag, attributes = got
        if begin > text:
            events.append(markup[text:begin])
        text = at = ends
        if tag is None:
            continue
        if markup[begin + 1] == "/":
            if where.get(tag):
                end_from(where[tag][-1])
            continue
        if tag == "html" or tag == "body" and where.get("body"):
            continue
        if tag in _ENDS_P:
            close({"p"})
        if tag in _CLOSED_BY:
            close(_CLOSED_BY[tag])
        if tag in _RAW:
            text = at = scan.raw(tag, at)
            continue
        if tag == "body":
            close({"head"})
        style, role = _named(tag, attributes)
        i, up = len(tags), stack[-1]
        tags.append(tag)
        page.style.append(style)
        page.role.append(role)
        page.parent.append(up)
        page.path.append(page.path[up] if tag in _INLINE else _step(page.path[up], style))
        events.append(i)
        if tag in _VOID or attributes.endswith("/"):
            events.append(~i)
        else:
            where[tag].append(len(stack))
            if tag in _SCOPE:
                scopes.append(len(stack))
            stack.append(i)
    if text < size:
        events.append(markup[text:])
    end_from(0)
    return page


def _blocks(page: Page, dropped: list[bool], wanted: list[bool] | None = None) -> list[str]:
    """The texts of the page's blocks, without the branches of dropped elements; only text in wanted elements."""
    out: list = []
    held: list = []
    stack: list = []
    skip = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    for e in page.events:
        if isinstance(e, str):
            if not skip and (wanted is None or stack and wanted[stack[-1]]):
                held.append(e)
            continue
        i = e if e >= 0 else ~e
        if e >= 0:
            stack.append(i)
            skip += dropped[i]
        else:
            stack.pop()
        if page.tag[i] == "br":
            held.append(" ")
        elif page.tag[i] not in _INLINE:
            flush()
        if e < 0:
            skip -= dropped[i]
    flush()
    return out


def _inside(page: Page, test) -> list[bool]:
    """Which elements lie in (or are) one that passes."""
    out: list = []
    for i, up in enumerate(page.parent):
        out.append(test(i) or (up >= 0 and out[up]))
    return out


def _holds(page: Page, marked: list[bool]) -> list[bool]:
    """Which elements are, or hold, a marked one."""
    out = list(marked)
    for i in range(len(out) - 1, 0, -1):
        if out[i]:
            out[page.parent[i]] = True
    return out


def _own_text(page: Page) -> list[int]:
    """Letters directly in each element."""
    out, stack = [0] * len(page.tag), []
    for e in page.events:
        if isinstance(e, str):
            out[stack[-1] if stack else 0] += len(e) - e.count(" ") - e.count("\n")
        elif e >= 0:
            stack.append(e)
        else:
            stack.pop()
    return out


def by_roles(page: Page) -> list[str]:
    """The article as the page's own elements tell it.

    It is in the outermost article elements, else in main, else in the page. Parts that say they are something else go; a form, though, that
    holds an article, a heading of first order or most of the page's text is the page itself, and so is whatever holds all text.
    """
    n = len(page.tag)
    gone = _inside(page, lambda i: page.role[i] == GONE)
    text = _own_text(page)
    core = [t in ("article", "main") and not g for t, g in zip(page.tag, gone)]
    has_core = _holds(page, core)
    weak = [r == AWAY for r in page.role]
    weight = [0 if g else t for t, g in zip(text, gone)]
    for i in range(n - 1, 0, -1):
        weight[page.parent[i]] += weight[i]
    first = _holds(page, [t == "h1" for t in page.tag])
    for i in range(n):
        if weak[i] and (has_core[i] or page.tag[i] == "form" and (first[i] or 2 * weight[i] >= weight[0])):
            weak[i] = False
    away = _inside(page, lambda i: gone[i] or weak[i])
    for kind in ("article", "main"):
        tops = [t == kind and not a for t, a in zip(page.tag, away)]
        if any(tops):
            return _blocks(page, away, _inside(page, lambda i: tops[i]))
    # outside of any article, page headers go as well
    weak = [w or r == OUTSIDE for w, r in zip(weak, page.role)]
    away = _inside(page, lambda i: gone[i] or weak[i])
    if not any(t for t, a in zip(text, away) if not a):  # what holds all text is no part beside it
        away = _inside(page, lambda i: gone[i] or weak[i] and weight[i] < weight[0])
    return _blocks(page, away)


def extract(markup: str, low: frozenset = frozenset(), spared: frozenset | None = None) -> list[str]:
    """The texts of a page's article blocks. low, spared: paths that the host's tree removes, and those it keeps in spite of their role."""
    page = parse(markup or "")
    if spared is None:
        return by_roles(page)
    out = _blocks(page, [r == GONE or p in low or (r == AWAY and p not in spared) for r, p in zip(page.role, page.path)])
    return out or by_roles(page)


def observations(markup: str) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(path, parent path, role, kind, feature, words, first, bulk) of a page's blocks. kind 0: child sequence; 1: text.

    first: 1 once for each path; bulk: there, the words of all its branches.
    """
    page = parse(markup or "")
    n = len(page.tag)
    gone = _inside(page, lambda i: page.role[i] == GONE)
    kids: list = [[] for _ in range(n)]
    texts: list = [[] for _ in range(n)]
    block, stack = [], []
    for i, t in enumerate(page.tag):
        block.append(block[page.parent[i]] if t in _INLINE else i)
        if t not in _INLINE and i:
            kids[block[page.parent[i]]].append(page.style[i])
    for e in page.events:
        if isinstance(e, str):
            texts[block[stack[-1]] if stack else 0].append(e)
        elif e >= 0:
            stack.append(e)
        else:
            stack.pop()
    words = ["" if gone[i] else "".join(texts[i]).split() for i in range(n)]
    branch = [len(w) for w in words]
    for i in range(n - 1, 0, -1):
        branch[page.parent[i]] += branch[i]
    bulk: Counter = Counter()
    for i, path in enumerate(page.path):
        bulk[path] += branch[i] if block[i] == i else 0
    out: dict = {}
    seen: set = set()
    for i, path in enumerate(page.path):
        if block[i] != i or gone[i]:
            continue
        up = page.parent[i]
        role = {"article": CORE, "main": MAIN}.get(page.tag[i], page.role[i])
        rows = [(0, ",".join(kids[i]), 0)] if kids[i] or not i else []
        if words[i]:
            rows.append((1, " ".join(words[i]), len(words[i])))
        for kind, feature, size in rows:
            key = (path, 0 if up < 0 else page.path[up], role, kind, _signed(xxhash.xxh64_intdigest(feature)), size)
            if key not in out:
                out[key] = (0, 0) if path in seen else (1, bulk[path])
                seen.add(path)
    return [(*k, *v) for k, v in out.items()]


CORE, RARE, MAIN = GONE + 1, GONE + 2, GONE + 3


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def style_tree(pages: DataFrame, pages_needed: int = PAGES) -> DataFrame:
    """_host, path, parent, role, pages, shown, look, read and weight of the style nodes of hosts with enough distinct pages.

    look: presentation importance; read: content importance; weight: important words directly in the node, a page.
    """
    tune(pages.sparkSession)

    names = ["_host", "page", "path", "parent", "role", "kind", "feature", "words", "first", "bulk"]

    def run(batches):
        for b in batches:
            rows, owner, page = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                got = observations(text)
                rows += got
                owner += [k] * len(got)
                page += [_signed(xxhash.xxh64_intdigest(text))] * len(got)
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(page, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    seen = pages.select("_host", "_html").mapInArrow(tidied(run), ", ".join(f"{x} bigint" for x in names))
    node = ["_host", "path", "parent", "role"]
    features = seen.distinct().groupBy(*node, "kind", "feature", "words").agg(F.count(F.lit(1)).alias("c"), F.sum("first").alias("first"), F.sum("bulk").alias("bulk"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    words = F.col("words") * F.col("c")
    own = features.groupBy(*node).agg(
        F.sum("first").alias("shown"), F.sum("bulk").alias("bulk"), of(0, F.col("c")).alias("m0"), of(0, F.col("c") * F.log("c")).alias("s0"),
        of(1, words).alias("w"), of(1, words * F.log("c")).alias("s1"),
    )
    own = staged(own, "nodes")
    total = own.where("parent = 0").groupBy("_host").agg(F.sum("shown").alias("pages")).where(F.col("pages") >= pages_needed)
    nodes = own.join(total, "_host")
    often = 10 * F.col("shown") >= F.col("pages")
    scale = F.log("pages")
    look = F.when(F.col("m0") > 0, (F.log("m0") - F.col("s0") / F.col("m0")) / F.log(F.greatest("m0", F.lit(2))))
    read = F.when(F.col("w") > 0, 1 - F.col("s1") / F.col("w") / scale)
    kept = nodes.where(often).select(*node, "pages", "shown", look.alias("look"), read.alias("read"), F.coalesce((F.col("w") - F.col("s1") / scale) / F.col("pages"), F.lit(0.0)).alias("weight"))
    # what is rare below a node counts as one branch of it, all of it important
    rare = nodes.where(~often).groupBy("_host", "parent", "pages").agg(F.sum("bulk").alias("bulk"), F.sum("shown").alias("shown"))
    rare = rare.join(kept.select("_host", F.col("path").alias("parent")), ["_host", "parent"], "left_semi")
    one = F.lit(1.0)
    return kept.unionByName(rare.select("_host", F.xxhash64("parent", F.lit("rare")).alias("path"), "parent", F.lit(RARE).cast("bigint").alias("role"), "pages", "shown", one.alias("look"), one.alias("read"), (F.col("bulk") / F.col("pages")).alias("weight")))


def judged(nodes: list[dict], threshold: float = THRESHOLD, roles: bool = True) -> tuple[list[int], list[int]]:
    """(paths to remove, paths kept in spite of their role) of one host's tree. roles: do they count?"""
    at = {x["path"]: x for x in nodes}
    below: dict = {p: [] for p in at}
    tops = []
    for p, x in at.items():
        below[x["parent"]].append(p) if x["parent"] in at else tops.append(p)
    order = list(tops)
    for p in order:
        order += below[p]
    role = {p: x["role"] if roles or x["role"] == RARE else NEUTRAL for p, x in at.items()}
    weight, composite, best, core = {}, {}, {}, {}
    for p in reversed(order):
        x, kids = at[p], below[p]
        weight[p] = x["weight"] + sum(weight[k] for k in kids)
        core[p] = role[p] in (CORE, MAIN) or any(core[k] for k in kids)
        parts = [composite[k] for k in kids] + ([x["read"]] if x["read"] is not None else [])
        mean = sum(parts) / len(parts) if parts else 0.0
        fade = DECAY ** len(kids)
        composite[p] = (1 - fade) * x["look"] + fade * mean if x["look"] is not None else mean
        best[p] = max([composite[p], *(best[k] for k in kids)])  # a branch is as important as what is most so in it
    low, spared, walk = [], [], [(p, False, False) for p in tops]
    for p, inside, article in walk:
        x, kids = at[p], below[p]
        inside, article = inside or role[p] in (CORE, MAIN), article or role[p] == CORE
        top = max(kids, key=lambda k: weight[k], default=None)
        apart = top is not None and not inside and (x["look"] or 0.0) < TEMPLATE and (bool(below[top]) or role[top] == RARE)
        beside = not inside and any(core[k] for k in kids)
        for k in kids:
            if role[k] == RARE:
                continue
            importance = best[k]
            if (apart or role[k] == AWAY) and weight[top] > 0:
                importance *= weight[k] / weight[top]
            if role[k] == AWAY or not inside and role[k] == OUTSIDE or beside and not core[k]:
                importance *= PRIOR
            if not core[k] and importance < threshold and (not article or role[k] == AWAY):
                low.append(k)  # within an article only roles remove: its text may stand on many pages
                continue
            if role[k] == AWAY:
                spared.append(k)
            walk.append((k, inside, article))
    return low, spared


def verdicts(tree: DataFrame, threshold: float = THRESHOLD, roles: bool = True) -> DataFrame:
    """_host, _low and _spared: what :func:`judged` says of each host's tree."""

    def run(t: pa.Table) -> pa.Table:
        low, spared = judged(t.to_pylist(), threshold, roles)
        return pa.table({"_host": t.column("_host")[:1], "_low": pa.array([low], pa.list_(pa.int64())), "_spared": pa.array([spared], pa.list_(pa.int64()))})

    return tree.groupBy("_host").applyInArrow(run, "_host bigint, _low array<bigint>, _spared array<bigint>")


def query(pages: DataFrame, roles: bool = True, trees: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks. Without ``roles`` or ``trees`` the other decides alone."""
    tune(pages.sparkSession)
    src = pages.select("page_id", "url", F.xxhash64(host(F.col("url").cast("string"))).alias("_host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))
    tree = style_tree(src)
    known = staged(verdicts(tree, roles=roles).join(tree.groupBy("_host").agg(F.max("pages").alias("_n")), "_host"), "verdicts")
    n_paths = known.agg(F.sum(F.size("_low") + F.size("_spared") + 2)).first()[0] or 0
    if not trees:
        known = known.limit(0)
    both = src.join(F.broadcast(known), "_host", "left") if n_paths <= SENT_PATHS else salted_join(src, known, ["_host"], "_n")

    def run(batches):
        for b in batches:
            texts, n = [], []
            for markup, low, spared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                got = extract(markup, frozenset(low or ()), None if spared is None else frozenset(spared))
                texts.append("\n\n".join(got))
                n.append(len(got))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    kind, url = (src.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return both.select("page_id", "url", "_html", "_low", "_spared").mapInArrow(tidied(run), f"page_id {kind}, url {url}, text string, n_chars bigint, n_blocks bigint")
