"""Main-text extraction by site style trees.

The DOMs of a host's pages are merged into one tree: a node is a path of tags with their classes and roles. For every
node two features are counted over the host's pages: presentation (which children it had) and content (a hash of its
text). Their normalised entropies tell how much a node varies from page to page. The importance of a node is

    within an article, and for paragraphs and the like:  max(presentation, content)
    for other branches:  max(presentation, content * min(1, 10 * share)) * (1 - linked)

with `share` the mean share of the page's unlinked text that stands in it and `linked` the mean share of its text that is
link text: menus are links, footers and adverts are a small part of a page and always built alike, articles are neither.
Branches of importance under `LOW` are removed from each page, within articles too, and what is left is the main text. A
node is judged only on `LEAST_PAGES` pages or more; hosts of fewer pages go by the tree of all hosts together. Copies
count once: pages of equal text are one page, and what stands in an article is counted once for each text of the article.

Beside the tree stand roles, that is, what a node's tag, classes and ids say (`described`): asides go whatever they
weigh, an article never goes, and where a page has one, what lies outside of it is not part of the article. `roles=False`
leaves the tree alone to decide. A tree needs them where pages are few, and for comments, which vary like articles do.

Two passes over the pages. What passes between them is a table of low nodes (host, path), not of pages; it is broadcast
up to `BROADCAST_NODES` rows. Beyond that, the low nodes of a tree are joined by path to the nodes of the pages that go by it, dealt over
parts and folded by page; that takes a third pass over the pages.

Defined results: null or empty html gives an empty text; a null url belongs to the host ''; a page whose whole text would
go by roles, or by the tree of all hosts, keeps what it would lose by them; null or repeated page_ids and repeated rows
give a row each; unclosed, misnested and deeply nested elements are read as far as they go; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches, materialize, salt, salt_mask, salted, tidy

LEAST_PAGES = 20
#: Nodes of lower importance go.
LOW = 0.5
BROADCAST_NODES = 200_000

#: Tags by what they are.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video select option button form input label fieldset nav footer aside menu dialog map".split())
UNSEEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video select option button form input".split())
FLOW = frozenset("blockquote br caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre table tbody td tfoot th thead tr ul".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br td th tr tbody thead tfoot caption option body html head title".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
#: Words of classes, ids and roles.
ASIDE = frozenset(
    "ad ads advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus "
    "footer footnav gdpr header login masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notification pager pagination paywall popup "
    "promo promoted promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe subscription tagcloud "
    "toolbar topbar widget widgets complementary alert announcement discussion feedback".split()
)
NO_ARTICLE = frozenset("comment comments reply ad ads advert advertisement promo related sponsored recommended".split())
ARTICLE = frozenset("article articlebody article-body articlecontent article-content articletext post-body post-content postcontent entry-content entrycontent story-body storybody main-content maincontent page-content main".split())

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<!--(?:.*?-->|.*\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
#: One attribute after another, so that neither a value nor a part of a name is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


@lru_cache(100_000)
def described(tag: str, attributes: str) -> tuple[str, str]:
    """The node's label in the tree, and its role: `aside`, `perhaps` (aside unless it holds an article), `article`, `hidden` or nothing."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        if name:  # of an attribute given twice the first counts
            found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    names = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
    label = tag + "".join("." + re.sub(r"\d+", "0", c) for c in sorted(found.get("class", "").lower().split()))
    tokens = set(names.split())
    parts = {w for t in tokens for w in re.split(r"[-_\d:]+", t)}
    named = bool(tokens & ARTICLE)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        role = "hidden"
    elif tag in NEVER or tag == "header" or tokens & ASIDE and not named:
        role = "aside"
    elif tag in ("article", "main") and not parts & NO_ARTICLE or named:
        role = "article"
    elif parts & ASIDE:
        role = "perhaps"  # `comment-list` is aside, `with-sidebar` may hold the page
    else:
        role = ""
    return f"{label}#{role}" if role else label, role


class Node:
    """`holds`: an article stands within; `heads`: a heading does; `linked` of `total` characters within are link text."""

    __slots__ = ("tag", "role", "path", "parts", "parent", "holds", "heads", "linked", "total")

    def __init__(self, tag: str, role: str, path: int, parent: Node | None) -> None:
        self.tag, self.role, self.path, self.parent, self.parts = tag, role, path, parent, []
        self.holds = self.heads = False
        self.linked = self.total = 0


def below(path: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), path)


ROOT = below(0, "html")


class Low:
    """Paths by their upper 63 bits, as the tables have them. `own`: of the page's host, not of all hosts."""

    def __init__(self, paths, own: bool = False) -> None:
        self.paths, self.own = frozenset(paths), own

    def __contains__(self, path: int) -> bool:
        return path >> 1 in self.paths


def parse(text: str) -> Node:
    root = here = Node("html", "", ROOT, None)
    at, n, lower = 0, len(text), None
    find = TAG.search
    while at < n:
        m = find(text, at)
        if m is None:
            here.parts.append(text[at:])
            break
        if m.start() > at:
            here.parts.append(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), m[1] or m[4]
        if closing:
            node = here
            while node is not None and node.tag != tag:
                # an inline end tag does not close blocks
                node = None if tag not in BLOCK and node.tag in BLOCK else node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in SAME or tag in CLOSES_P:
            node, stop = here, SAME.get(tag)
            while node is not None and node.parent is not None:
                if node.tag == "p" and tag in CLOSES_P or stop and (node.tag == tag or node.tag in ("dt", "dd") and tag in ("dt", "dd") or node.tag in ("td", "th") and tag in ("td", "th", "tr")):
                    here = node.parent
                    if stop is None or node.tag == tag:
                        break
                elif stop and node.tag in stop or node.tag in BLOCK and node.tag not in ("p", "li", "td", "th", "dt", "dd", "option"):
                    break
                node = node.parent
        attributes = m[3] or m[6] or ""
        label, role = described(tag, attributes if tag in BLOCK or tag == "span" else "")
        node = Node(tag, role, below(here.path, label), here)
        here.parts.append(node)
        if tag in RAW:
            lower = text.lower() if lower is None else lower
            end = lower.find("</" + tag, at) if len(lower) == n else text.find("</" + tag, at)
            at = n if end < 0 else end
        if tag not in VOID and not attributes.endswith("/"):
            here = node
    weigh(root)
    return root


def weigh(root: Node) -> None:
    links = 0
    open_: list[Node] = []
    for what, opening in in_order(root):
        if isinstance(what, str):
            n = len(what.strip())
            open_[-1].total += n
            open_[-1].linked += n if links else 0
            continue
        links += (what.tag == "a") * (1 if opening else -1)
        if opening:
            open_.append(what)
        else:
            open_.pop()
            if up := what.parent:
                up.total, up.linked = up.total + what.total, up.linked + what.linked
                up.holds |= what.holds or what.role == "article"
                up.heads |= what.heads or what.tag in ("h1", "h2", "h3", "h4", "h5", "h6")


def in_order(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """(node, True) before what it holds, (text, True), (node, False) after."""
    stack: list[tuple[Node | str, bool]] = [(root, True)]
    while stack:
        what, opening = stack.pop()
        yield what, opening
        if opening and isinstance(what, Node):
            stack.append((what, False))
            stack.extend((p, True) for p in reversed(what.parts))


def features(root: Node) -> dict[int, tuple[int, int, int, bool, float, float]]:
    """By path of block nodes, over all nodes of the page at that path: hashes of presentation, of content, and of the text
    of which copies count once; whether its importance is of the first kind; its share of unlinked text; how much of it is linked."""
    style: dict[int, xxhash.xxh64] = {}
    content: dict[int, xxhash.xxh64] = {}
    article: dict[int, int] = {}  # the path of the article around
    flows: dict[int, bool] = {}
    sizes: dict[int, list[int]] = {}
    open_: list[int] = []
    within: list[int] = [root.path]
    for what, opening in in_order(root):
        if isinstance(what, str):
            if words := what.split():
                content[open_[-1]].update(" ".join(words).encode("utf-8", "surrogatepass"))
        elif what.tag in BLOCK and what.tag not in VOID or what.parent is None:
            if opening:
                if open_:
                    style[open_[-1]].update(what.tag.encode())
                if what.path not in style:
                    style[what.path], content[what.path], sizes[what.path] = xxhash.xxh64(), xxhash.xxh64(), [0, 0]
                    article[what.path], flows[what.path] = within[-1], what.tag in FLOW or len(within) > 1
                sizes[what.path][0] += what.total - what.linked
                sizes[what.path][1] += what.total
                open_.append(what.path)
                if what.role == "article":
                    within.append(what.path)
            else:
                path = open_.pop()
                if what.role == "article":
                    within.pop()
                if open_ and what.total:  # its text counts for the block around it too, at any depth
                    content[open_[-1]].update(content[path].digest())
    whole = max(1, root.total - root.linked)
    return {
        p: (s.intdigest() >> 1, content[p].intdigest() >> 1, content[article[p]].intdigest() >> 1, flows[p], min(1.0, sizes[p][0] / whole), 1 - sizes[p][0] / max(1, sizes[p][1]))
        for p, s in style.items()
    }


def main_text(root: Node, low: Low, roles: bool = True) -> str:
    """The text of the page without branches whose importance is low."""
    if not roles:
        return gathered(root, low, False, None)
    inside = any(isinstance(w, Node) and o and w.role == "article" and not within_aside(w) for w, o in in_order(root))
    for nodes in (low,) if low.own else (low, Low(())):
        for article, doubt in ((inside, True), (False, True), (False, False)):
            if text := gathered(root, nodes, article, doubt):
                return text
    return ""


def within_aside(node: Node) -> bool:
    at = node.parent
    while at is not None:
        if at.role in ("aside", "hidden"):
            return True
        at = at.parent
    return False


def gathered(root: Node, low: Low, inside: bool, doubt: bool | None) -> str:
    """`inside`: only what stands in articles; `doubt`: nodes that are perhaps aside are; None: roles do not count."""
    blocks: list[str] = []
    run: list[str] = []
    skip: Node | None = None
    articles = 0

    def end() -> None:
        if run:
            if words := html.unescape("".join(run)).split():
                blocks.append(" ".join(words))
            run.clear()

    for what, opening in in_order(root):
        if skip is not None:
            if what is skip and not opening:
                skip = None
            continue
        if isinstance(what, str):
            if articles or not inside:
                run.append(what)
            continue
        if what.tag in BLOCK:
            end()
        if not opening:
            articles -= what.role == "article"
            continue
        unwanted = what.tag in UNSEEN
        if doubt is not None and not unwanted:
            unwanted = what.role == "hidden" or what.tag in NEVER or doubt and what.role == "perhaps" and not what.holds
            if what.role == "aside" and not unwanted:
                # the heading of an article may stand in a header of its own
                unwanted = not (articles and what.heads and "header" in what.tag) and (doubt or what.tag == "header")
        judged = what.tag in BLOCK and what.parent is not None and (doubt is None or what.role != "article" and not what.holds)
        if judged and not unwanted:
            unwanted = what.path in low or bool(doubt) and not articles and what.tag in ("ul", "ol", "dl", "div", "table") and what.linked > 0.8 * what.total
        if unwanted:
            skip = what
            continue
        articles += what.role == "article"
    end()
    return " ".join(blocks)


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def node_features(pages: DataFrame) -> DataFrame:
    """(host, path, unit, style, content, flows, share, linked) for each page and node."""
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64()]
    names = ["host", "path", "unit", "style", "content", "flows", "share", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in kinds)
            for url, text in zip(b.column(0), b.column(1)):
                host = xxhash.xxh64_intdigest(host_of(url.as_py()).encode()) >> 1
                for path, (style, content, unit, *rest) in features(parse(text.as_py() or "")).items():
                    for column, value in zip(out, (host, path >> 1, unit, style, content, *rest)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return page_rows(pages).select("url", "html").mapInArrow(tidy(run), "host long, path long, unit long, style long, content long, flows boolean, share double, linked double")


#: The tree of all hosts; what stands for the path of a node in the row that says that a host has a tree of its own.
ALL_HOSTS, OWN_TREE = -1, -1


def low_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """(host, path) of nodes whose importance is low, and a row with OWN_TREE for every host of enough pages."""
    # copies count once: a row for a node and a text around it
    once = node_features(pages).groupBy("host", "path", "unit").agg(*(F.min(c).alias(c) for c in ("style", "content", "flows", "share", "linked")))
    each = [F.struct(host.alias("host"), F.lit(kind).alias("kind"), F.col(kind).alias("feature")) for host in (F.col("host"), F.lit(ALL_HOSTS).cast("long")) for kind in ("style", "content")]
    rows = materialize(once, "features").select("path", "flows", "share", "linked", F.inline(F.array(*each)))
    figures = ("share", "linked")
    counts = rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("c"), F.bool_and("flows").alias("flows"), *(F.sum(k).alias(k) for k in figures))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.bool_and("flows").alias("flows"), *(F.sum(k).alias(k) for k in figures))
    # of a distribution of n pages: (ln n - sum(c ln c) / n) / ln n
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, entropy)).alias(kind)
    nodes = sums.groupBy("host", "path").agg(F.max("n").alias("n"), F.bool_and("flows").alias("flows"), of("style"), of("content"), *(F.max(F.col(k) / F.col("n")).alias(k) for k in figures))
    nodes = nodes.filter(F.col("n") >= least_pages)
    branch = F.greatest("style", F.col("content") * F.least(F.lit(1.0), 10 * F.col("share"))) * (1 - F.col("linked"))
    importance = F.when(F.col("flows"), F.greatest("style", "content")).otherwise(branch)
    own = nodes.filter(F.col("path") == ROOT >> 1).select("host", F.lit(OWN_TREE).cast("long"))
    return nodes.filter(importance < low).select("host", "path").union(own)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW, broadcast_nodes: int = BROADCAST_NODES, roles: bool = True) -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = pages.sparkSession
    lean_batches(spark)
    nodes = materialize(low_nodes(pages, least_pages, low), "low")
    rows = page_rows(pages)
    kind = dict(rows.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def out(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if nodes.count() <= broadcast_nodes:
        by_host: dict[int, set[int]] = {}
        for r in nodes.collect():
            by_host.setdefault(r["host"], set()).add(r["path"])
        shared = spark.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {h: Low(paths, h != ALL_HOSTS) for h, paths in shared.value.items()}
            general = known.get(ALL_HOSTS, Low(()))
            for b in batches:
                texts = []
                for url, text in zip(b.column(1), b.column(2)):
                    host = xxhash.xxh64_intdigest(host_of(url.as_py()).encode()) >> 1
                    texts.append(main_text(parse(text.as_py() or ""), known.get(host, general), roles))
                yield out(b, texts)

        return rows.mapInArrow(tidy(run), schema)
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST.pattern, 1)), F.lit(""))
    # the seedless hash of the host's name, as the first pass has it
    keyed = hashed_hosts(rows.withColumn("name", host), kind).withColumn("part", salt(F.col("page_id"), F.col("url")))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)))
    masks = keyed.groupBy("host").agg(salt_mask(F.col("part")).alias("mask"))
    # the tree that a page goes by: its host's, or that of all hosts
    own = nodes.filter((F.col("path") == OWN_TREE) & (F.col("host") != ALL_HOSTS)).select("host", F.col("host").alias("own")).distinct()
    keyed = keyed.join(salted(own.join(masks, "host"), "mask", "part"), ["host", "part"], "left")
    keyed = keyed.withColumn("tree", F.coalesce("own", F.lit(ALL_HOSTS).cast("long")))
    joined = keyed.join(low_lists(keyed, nodes.select(F.col("host").alias("tree"), "path")), ["tree", "digest", "part"], "left")
    joined = joined.select("page_id", "url", "html", "paths", F.col("own").isNotNull().alias("own"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, paths, own in zip(b.column(2), b.column(3), b.column(4).to_pylist()):
                texts.append(main_text(parse(text.as_py() or ""), Low(paths.as_py() or (), own), roles))
            yield out(b, texts)

    return joined.mapInArrow(tidy(run_joined), schema)


def low_lists(pages: DataFrame, low: DataFrame) -> DataFrame:
    """(tree, digest, part, paths): of the `low` nodes (tree, path), those that the html of this digest has, for each part with such pages.

    No page is given more than its own nodes, however many its tree has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths = [], []
            for i, text in enumerate(b.column(3)):
                found = {path >> 1 for path in features(parse(text.as_py() or ""))}
                at += [i] * len(found)
                paths += found
            held = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns[:3], pa.array(paths, pa.int64())], ["tree", "digest", "mask", "path"])

    once = pages.groupBy("tree", "digest").agg(salt_mask(F.col("part")).alias("mask"), F.first("html").alias("html"))
    held = once.select("tree", "digest", "mask", "html").mapInArrow(tidy(run), "tree long, digest binary, mask long, path long")
    # a path that all pages have is dealt over parts, as a page that has many copies is
    held = materialize(held.withColumn("deal", salt(F.col("digest"))), "held")
    deals = held.groupBy("tree", "path").agg(salt_mask(F.col("deal")).alias("deals"))
    found = held.join(salted(low.join(deals, ["tree", "path"]), "deals", "deal"), ["tree", "path", "deal"])
    return salted(found.groupBy("tree", "digest", "mask").agg(F.collect_list("path").alias("paths")), "mask", "part")


def hashed_hosts(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = [xxhash.xxh64_intdigest((h or "").encode()) >> 1 for h in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hosts, pa.int64())], ["page_id", "url", "html", "host"])

    return rows.select("page_id", "url", "html", "name").mapInArrow(tidy(run), f"page_id {kind}, url string, html string, host long")
