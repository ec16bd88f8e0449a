"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree. An element is a path of block elements with their classes, a style is
the row of distinct children that an element has on a page, and the text that stands directly in an element is a leaf
of its own. Importance is computed from the leaves up. A leaf: how rarely its texts come back, one minus the mean of
log(c) / log(m + SPARE) over its texts, a text being on c of the leaf's m pages. An element with l styles:
(1 - DAMPING^l) times the mean importance of its children, weighed by how often each style is used, plus DAMPING^l times
its presentation, which is how varied its styles are, measured as for texts. SPARE keeps few pages from telling much.

A branch goes if nothing in it, itself and all below, reaches LOW of the best that its page has. All nodes are in the
tree, those in ``article`` and ``main`` and in named templates too. Names and classes are a prior on the same scale:
where they always mean menus, notices, adverts, comments and the like they take a branch's importance times PRIOR_LOW,
which alone is enough to let it go; where they may mean that, times PRIOR_OPEN. Branches in main text go below
LOW_INSIDE of the best in that main text, and a main text itself stays.

The merged tree is never held as pages: what is shuffled is one row per host, node and distinct style or text, combined
before the shuffle, so a host with a third of all pages weighs no more than its templates. A node's row carries the
path down to it, so importance is one sum over ancestors and takes no rounds. Below DEPTH elements a branch is one leaf.

Defined results: null or empty html, or a page without main text, gives empty text; a tag cut off at the end of the
page is dropped; a null url is a host of its own; repeated rows give repeated results; an empty table gives an empty
result; columns but the id, url and html are not read, so their names cannot clash; pages are read whole, in time
linear in their length however deep they nest.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.llm.common import Stage, by_batch

DAMPING, SPARE, DEPTH = 0.9, 8, 32
LOW, LOW_INSIDE, PRIOR_LOW, PRIOR_OPEN = 0.35, 0.15, 0.25, 0.6
#: Rows of removable branches up to which they are broadcast; beyond, pages and hosts meet in a shuffled join.
BROADCAST_ROWS = 200_000

#: Elements that start and end blocks, that have no content, whose content is no text, that are
#: templates by their meaning, and class or id words that say the same.
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select button canvas audio video".split())
TEMPLATE = frozenset("nav footer aside form dialog menu search head fieldset".split())
MAIN = frozenset(("article", "main"))
TEMPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination pager popup promo promoted related replies respond share sharing sidebar site-footer site-header skip social sponsor sponsored subscribe topbar widget widgets".split())
#: Words that say the same as a part of a longer name, and words that may say it there.
TEMPLATE_PARTS = frozenset("advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu nav navbar navigation newsletter pagination pager sidebar sponsored subscribe widget widgets".split())
OPEN_PARTS = TEMPLATE_WORDS - TEMPLATE_PARTS
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_TOKEN = re.compile(r"<!--(?:(?!-->)[\s\S])*+(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([^<]++|<)")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_CLOSES_P = BLOCK - {"html", "head", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


class Node:
    """A block element: its style, the prior its name gives, whether it is main text or has main text below it, and its
    children and texts in page order."""

    __slots__ = ("tag", "style", "prior", "main", "around", "parts", "path")

    def __init__(self, tag: str, style: str, prior: float, main: bool, path: int):
        self.tag, self.style, self.prior, self.main, self.around, self.path, self.parts = tag, style, prior, main, False, path, []


def named_prior(words: list[str]) -> float:
    """What class and id words say: a whole word, a telling part of it, or a part that may tell."""
    parts = {p for w in words for p in re.split(r"[-_]+", w)}
    if not TEMPLATE_WORDS.isdisjoint(words) or not TEMPLATE_PARTS.isdisjoint(parts) and parts.isdisjoint(("no", "non", "without")):
        return PRIOR_LOW
    return 1.0 if OPEN_PARTS.isdisjoint(parts) else PRIOR_OPEN


def described(tag: str, attrs: str, inside_main: bool) -> tuple[str, float, bool]:
    """Style name, prior, and whether the element says that it holds main text."""
    words, role, hidden = [], "", False
    if attrs:
        for name, *value in _ATTR.findall(attrs):
            name, v = name.lower(), "".join(value).lower()
            if name == "role":
                role = v.strip()
            elif name == "hidden":
                hidden = True
            elif name in ("class", "id"):
                words += v.split()
    style = ".".join([tag, *sorted(re.sub(r"\d+", "", w) for w in words), role]).rstrip(".")
    if tag in ("html", "body"):
        return style, 1.0, False
    if tag in TEMPLATE or role in TEMPLATE_ROLES or hidden or tag == "header" and not inside_main:
        return style, PRIOR_LOW, False
    prior = named_prior(words)
    if tag in MAIN or role in ("main", "article"):
        # an article may be a comment, and says so; what is named main is not
        return style, prior if "main" not in (tag, role) else 1.0, prior == 1.0 or "main" in (tag, role)
    return style, prior, False


def parse(page: str) -> Node:
    """Block elements of a page as a tree, forgiving as browsers are: open paragraphs and items close by themselves."""
    root = Node("", "", 1.0, False, 1)
    stack, text, main = [root], [], 0
    end, lower = 0, None

    def flush() -> None:
        if text:
            if words := " ".join(entities.unescape("".join(text)).split()):
                stack[-1].parts.append(words)
            text.clear()

    def pop() -> None:
        nonlocal main
        main -= stack.pop().main

    def close(names: set[str], stops: set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in stops:
                return

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        if (chars := m[7]) is not None:
            if chars == "<" and re.match(r"/?[a-zA-Z]", page[at : at + 2]) and page.find(">", at) < 0:
                break  # a tag that the page's end cuts off
            text.append(chars)
            continue
        if (name := m[2] or m[5]) is None:
            continue
        name, ending = name.lower(), m[1] or m[4]
        if name in RAW:
            if not ending and not (m[3] or m[6] or "").endswith("/"):
                lower = page.lower() if lower is None else lower
                stop = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
                stop = page.find(">", stop) if stop >= 0 else -1
                at = stop + 1 if stop >= 0 else len(page)
            if name == "title":
                flush()
            continue
        if name == "br":
            text.append(" ")
        if name not in BLOCK:
            continue
        flush()
        if ending:
            if name == "p":
                close({"p"}, BLOCK - {"p"})
            elif any(n.tag == name for n in stack):
                close({name})
            continue
        if name in _CLOSES_P:
            close({"p"}, BLOCK - {"p"})
        if name in _SIBLINGS:
            close(_SIBLINGS[name], _STOPS[name])
        if name in VOID:
            continue
        style, prior, holds = described(name, m[3] or m[6], main > 0)
        holds = holds and ("main" in style.split(".") or all(n.prior > PRIOR_LOW or n.around for n in stack))
        node = Node(name, style, prior, holds, xxhash.xxh3_64_intdigest(style, seed=stack[-1].path))
        main += holds
        if holds:
            for n in stack:
                n.around = True
        stack[-1].parts.append(node)
        stack.append(node)
    flush()
    return root


def leaf_of(path: int) -> int:
    """The leaf of the texts that stand directly in a node."""
    return xxhash.xxh3_64_intdigest("#text", seed=path)


def texts(root: Node, best: dict[int, float] | None = None) -> Iterator[str]:
    """Blocks of a page without the branches whose importance is low; an iterative walk, so deep nesting cannot overflow.

    ``best`` says, by path, the highest importance in a branch; what it does not name has 1. Without it names decide.
    """
    get = (best or {}).get
    top = max((get(p.path, 1.0) if isinstance(p, Node) else get(leaf_of(root.path), 1.0) for p in root.parts), default=1.0)
    todo = [(root, 1.0, LOW * top)]
    while todo:
        x, prior, bar = todo.pop()
        if isinstance(x, str):
            yield x
            continue
        if x.main and prior > PRIOR_LOW or x.around:
            prior = 1.0
            bar = LOW_INSIDE * get(x.path, 1.0) if x.main else bar
        elif x is not root:
            prior = min(prior, x.prior)
            if prior <= PRIOR_LOW or prior * get(x.path, 1.0) < bar:
                continue
        if best and any(isinstance(p, str) for p in x.parts) and prior * get(leaf_of(x.path), 1.0) < bar:
            todo += [(p, prior, bar) for p in reversed(x.parts) if isinstance(p, Node)]
        else:
            todo += [(p, prior, bar) for p in reversed(x.parts)]


def everything(node: Node) -> Iterator[str]:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += reversed(x.parts)


PRESENT, STYLE, TEXT = 0, 1, 2


def observed(root: Node) -> tuple[set[tuple[bytes, int, int]], dict[bytes, float]]:
    """(path down to the node, STYLE or TEXT, hash) of all nodes of a page, and by path the node's share of its parent's styles."""
    found: set[tuple[bytes, int, int]] = set()
    shares: dict[bytes, float] = {}
    todo = [(root, b"")]
    while todo:
        x, chain = todo.pop()
        deepest = len(chain) == 8 * (DEPTH - 1)
        leaf = chain + struct.pack(">Q", leaf_of(x.path))
        kids: dict[bytes, list[Node]] = {}
        for p in x.parts:
            if isinstance(p, str) or deepest:
                kids.setdefault(leaf, [])
                found.update((leaf, TEXT, xxhash.xxh3_64_intdigest(t)) for t in ((p,) if isinstance(p, str) else everything(p)))
            else:
                kids.setdefault(chain + struct.pack(">Q", p.path), []).append(p)
        style = (chain, STYLE, xxhash.xxh3_64_intdigest(b"".join(k[-8:] for k in kids)))
        if style not in found:
            found.add(style)
            for k in kids:
                shares[k] = shares.get(k, 0.0) + 1 / len(kids)
        todo += [(n, k) for k, nodes in kids.items() for n in nodes]
    return found, shares


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


OBSERVED = "host string, chain binary, kind byte, seen long, c long, share double"


def observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages of a batch have in common is counted before it is sent on."""
    kinds = (pa.string(), pa.binary(), pa.int8(), pa.int64(), pa.int64(), pa.float64())
    for batch in batches:
        told: dict[tuple, list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, shares = observed(parse(page or ""))
            for chain, kind, seen in found:
                told.setdefault((host, chain, kind, seen), [0, 0.0])[0] += 1
            for chain, share in shares.items():
                row = told.setdefault((host, chain, PRESENT, 0), [0, 0.0])
                row[0] += 1
                row[1] += share
        if told:
            cols = zip(*((h, c, k, signed(x), *v) for (h, c, k, x), v in told.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in OBSERVED.split(", ")])


def importance(pages: DataFrame) -> DataFrame:
    """(host, chain, pages, composite, best) of the nodes of all sites; ``pages`` has host and html.

    ``composite`` is the node's own importance, ``best`` the highest in its branch. A node's composite is the sum, over
    itself and all below, of what each adds by itself times the weights of the steps on the way down to it.
    """
    rows = pages.select("host", "html").mapInArrow(observations, OBSERVED)
    counts = rows.groupBy("host", "chain", "kind", "seen").agg(F.sum("c").alias("c"), F.sum("share").alias("share"))
    c, of = F.col("c"), lambda k, x: F.sum(F.when(F.col("kind") == k, x).otherwise(0.0))
    one = F.lit(1.0)
    sums = counts.groupBy("host", "chain").agg(
        of(PRESENT, c).alias("pages"), of(PRESENT, F.col("share")).alias("share"), of(STYLE, c).alias("styled"), of(STYLE, one).alias("styles"), of(STYLE, c * F.log(c)).alias("style_log"), of(TEXT, one).alias("texts"), of(TEXT, F.log(c)).alias("text_log")
    )
    many = lambda m: F.log(m + SPARE)
    at_least_one = lambda x: F.greatest(x, F.lit(1.0))  # noqa: E731  a leaf has no styles, an element no texts of its own
    damp = F.pow(F.lit(DAMPING), F.col("styles"))
    varied = 1 - F.col("style_log") / (at_least_one(F.col("styled")) * many(F.col("styled")))
    rare = 1 - F.col("text_log") / (at_least_one(F.col("texts")) * many(F.col("pages")))
    nodes = sums.select("host", "chain", "pages", "share", "styled", damp.alias("damp"), F.when(F.col("texts") > 0, rare).otherwise(damp * varied).alias("own"))
    parent = nodes.select("host", F.col("chain").alias("up"), ((1 - F.col("damp")) / at_least_one(F.col("styled"))).alias("per_share"))
    depth = lambda x: (F.octet_length(x) / 8).cast("int")
    cut = lambda n: F.substring("chain", F.lit(1), (n * 8).cast("int"))
    below = nodes.filter("octet_length(chain) > 0").withColumn("up", cut(depth(F.col("chain")) - 1)).join(parent, ["host", "up"]).withColumn("step", F.col("share") * F.col("per_share"))
    below = Stage(pages.sparkSession, "sitetree").write(below.select("host", "chain", "pages", "own", "step"))
    level = F.explode(F.sequence(F.lit(1), depth(F.col("chain")))).alias("level")
    ways = below.select("host", "chain", "own", level).withColumn("at", cut(F.col("level")))
    steps = ways.join(below.select("host", F.col("chain").alias("at"), "step"), ["host", "at"]).groupBy("host", "chain", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "step"))), lambda s: s["step"]).alias("steps"))
    n = F.size("steps")
    reach = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("level"), F.aggregate(F.slice("steps", k + 1, n - k), F.col("own"), lambda a, x: a * x).alias("adds")))
    added = steps.select("host", "chain", F.explode(reach).alias("r")).select("host", cut(F.col("r.level")).alias("chain"), "r.adds")
    composite = added.groupBy("host", "chain").agg(F.sum("adds").alias("composite"))
    upward = composite.select("host", "chain", "composite", level).select("host", cut(F.col("level")).alias("chain"), "composite")
    best = upward.groupBy("host", "chain").agg(F.max("composite").alias("best"))
    return below.select("host", "chain", "pages").join(composite, ["host", "chain"]).join(best, ["host", "chain"])


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    slim = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    # no other branch can fall below a bar
    low = importance(slim).filter((F.col("best") < LOW / PRIOR_OPEN) | (F.octet_length("chain") == 8) & (F.col("best") < 1))
    low = Stage(spark, "sitetree").write(low.groupBy("host").agg(F.collect_list(F.struct(F.substring("chain", -8, 8).alias("path"), "best")).alias("low")))
    size = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]
    joined = slim.join(F.broadcast(low) if size <= BROADCAST_ROWS else low, "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            best = {int.from_bytes(x["path"], "big"): x["best"] for x in low or ()}
            out.append("\n".join(texts(parse(page or ""), best)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(by_batch(run), "page_id long, url string, text string, n_chars long")
