"""Main text of web pages by wrapper induction.

Neighbouring siblings of one kind are merged to a run, so lists of any length
are one slot.  Pages of one host are grouped by layout: pages whose outer
structure (labels down to ``OUTER`` levels, not into an article) is equal have
one shape, and shapes are aligned with simple tree matching, the largest
order-keeping match of children with equal labels; those that match in
``SIMILAR`` of their runs are one layout.  Over all pages of a layout, and of
the host, it is then counted on how many different pages a slot (path of
labels) stands and on how many it has which text.  A text recurs if it has at
least ``LEAST`` pages and ``SHARE`` of the slot's; where recurring texts fill
``ALIKE`` of a slot, they are template (one constant text, a menu per section,
a banner that rotates), and every page is cut with them from its whole html.
Inline elements inside the text of a paragraph are no slots.

Copies of an article do not turn it into template: pages of a host with the
same text (of the article, where one is marked, else of the page) count once.

Beside the template, tags decide: what is no text (head, scripts, controls) and
nav, header, footer, aside and their ARIA roles are left out of any page, and
where a page marks its article or main part, only that is taken.  Elements
with a whole class token that names a role (comments, advert, ...) are left out
unless they are headings, in an article, or hold half of the page's text or
more.  A header inside an article keeps its headings.  A nav, header, footer,
aside or other left-out element that is never closed ends before the first
element that holds an article or main part, an open nav also before the first
block that is no list.  On pages without a marked part whose host has no template, lists of
links are left out.

Text: character references decoded, white space inside a block made one
space, blocks joined by a line break in page order.  A null or empty html, or
a page without content, gives an empty text; a null url has no wrapper; every
row gives one row; an empty table gives none.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 3
ALIKE = 0.9
SHARE = 0.01
SIMILAR = 0.8
OUTER = 4
DEEPEST = 200
BROADCAST_HOSTS = 50_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table "
             "tbody td tfoot th thead tr ul".split())
LEFT_OUT = set("head title nav header footer aside form script style noscript template iframe object svg canvas button "
               "select option textarea label input dialog menu audio video".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
ROLE_WORDS = set("nav navbar navigation menu header masthead footer sidebar side aside widget notice cookie cookies consent gdpr alert "
                 "banner popup modal ad ads advert adverts advertisement sponsor sponsored promo form newsletter subscribe signup login "
                 "search comment comments reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs "
                 "pagination pager toolbar tags meta".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = set("ul ol dl li dd dt menu".split())
HOLDERS = set("html body div section main article center td ul ol table tr tbody".split())
OUTER_TAGS = HOLDERS - {"tr", "tbody"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
STOPS = set("ul ol dl table body html div article section main td th".split())


class Node:
    __slots__ = ("tag", "label", "out", "role", "parts", "holds")

    def __init__(self, tag: str, attrs=()):
        a = dict(attrs)
        names = f"{a.get('class') or ''} {a.get('id') or ''}".strip()
        self.tag, self.label = tag, f"{tag}.{names}" if names else tag
        self.out = tag in LEFT_OUT or (a.get("role") or "").lower() in ROLES or "hidden" in a
        self.role = (tag not in HEADINGS and tag not in ("body", "html", "article", "main")
                     and not ROLE_WORDS.isdisjoint((a.get("class") or "").lower().split()))
        self.parts: list = []           # texts and nodes in page order
        self.holds = tag in ("article", "main")     # it, or one under it, is an article or main part


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.unclosed: list[tuple[Node, Node]] = []         # with the parent
        self.headers: list[Node] = []                       # in articles

    def _drop(self, i: int) -> None:
        self.unclosed += [(self.open[k - 1], self.open[k]) for k in range(len(self.open) - 1, i, -1) if self.open[k].tag in LEFT_OUT]
        del self.open[i:]

    def _close(self, tags, stops) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._drop(i)
                return
            if self.open[i].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if tag in BLOCKS:
            self._close({"p"}, STOPS)
        if tag in ENDS:
            self._close(ENDS[tag], STOPS - {"td", "th"} if tag == "tr" else STOPS - ENDS[tag])
        node = Node(tag, attrs)
        if tag == "header" and any(n.tag == "article" for n in self.open):
            self.headers.append(node)
        if node.holds:
            for above in reversed(self.open):
                if above.holds:
                    break
                above.holds = True
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, ())

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._drop(0)
    for parent, node in builder.unclosed:                   # inner ones first
        _end_early(parent, node)
    for header in builder.headers:
        _keep_headings(header)
    _leave_out_roles(builder.root)
    return builder.root


def _end_early(parent: Node, node: Node) -> None:
    """Give back to its parent what an element that was never closed took in."""
    for k, p in enumerate(node.parts):
        if isinstance(p, Node) and (p.holds or (node.tag == "nav" and p.tag in BLOCKS - LISTS)):
            parent.parts += node.parts[k:]          # a node never closed is its parent's last part
            del node.parts[k:]
            return


def _keep_headings(header: Node) -> None:
    found, todo = [], list(reversed(header.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.out:
            if x.tag in HEADINGS:
                found.append(x)
            else:
                todo += reversed(x.parts)
    if found:
        header.parts, header.out = found, False


def _leave_out_roles(root: Node) -> None:
    """Leave out what a class token names, outside articles and unless it holds
    half of the page's text or more."""
    named, sizes = [], {}
    todo = [(root, False, False)]
    while todo:
        x, inside, done = todo.pop()
        if done:
            sizes[id(x)] = sum(sizes.get(id(p), 0) if isinstance(p, Node) else sum(map(len, p.split())) for p in x.parts)
        elif not x.out:
            inside = inside or x.tag == "article"
            if x.role and not inside:
                named.append(x)
            todo.append((x, inside, True))
            todo += [(p, inside, False) for p in x.parts if isinstance(p, Node)]
    for x in named:
        x.out = 2 * sizes[id(x)] < sizes[id(root)] or not sizes[id(x)]


def text_of(node: Node) -> str:
    """All text under a node that is not left out."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.out:
            todo += reversed(x.parts)
    return " ".join(" ".join(out).split())


class Run:
    """Neighbouring siblings with one label."""
    __slots__ = ("label", "nodes", "runs", "text")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes = label, nodes
        self.text = " ".join(t for t in map(text_of, nodes) if t)
        self.runs: list[Run] = []


def runs_of(root: Node) -> Run:
    """The tree of runs without what is left out anyway."""
    top = Run(root.label, [root])
    todo = [top]
    while todo:
        run = todo.pop()
        groups: list[tuple[str, list[Node]]] = []
        for node in run.nodes:
            mixed = node.tag not in HOLDERS and any(isinstance(p, str) and p.strip() for p in node.parts)
            for part in node.parts:
                if isinstance(part, Node) and not part.out and not (mixed and part.tag not in BLOCKS):
                    if groups and groups[-1][0] == part.label:
                        groups[-1][1].append(part)
                    else:
                        groups.append((part.label, [part]))
        run.runs = [Run(label, nodes) for label, nodes in groups]
        todo += run.runs
    return top


def match(a: Run, b: Run, depth: int = 0) -> tuple[int, list[tuple[Run, Run]]]:
    """Simple tree matching: size of the largest match of two trees with equal
    root labels, and its pairs.  Below ``DEEPEST`` levels runs are compared as
    wholes."""
    if a.label != b.label:
        return 0, []
    if depth >= DEEPEST:
        return 1, [(a, b)]
    m, n = len(a.runs), len(b.runs)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    under: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            w = 0
            if a.runs[i - 1].label == b.runs[j - 1].label:
                under[i, j] = match(a.runs[i - 1], b.runs[j - 1], depth + 1)
                w = under[i, j][0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if (i, j) in under and best[i][j] == best[i - 1][j - 1] + under[i, j][0]:
            pairs += under[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1 or 1


def slots(top: Run):
    """Every run with the hash of its path of labels and of path and text."""
    todo = [(top, _hash(top.label))]
    while todo:
        run, path = todo.pop()
        if run.text:
            yield run, path, _hash(run.text, path)
        todo += [(r, _hash(r.label, path)) for r in run.runs]


def outline(run: Run, depth: int = OUTER) -> list:
    """Labels of a page's outer structure, numbers in them left open."""
    under: list = []
    if depth and run.nodes[0].tag not in ("article", "main"):
        for r in run.runs:
            if r.nodes[0].tag in OUTER_TAGS:
                o = outline(r, depth - 1)
                if not under or under[-1] != o:
                    under.append(o)
    return [re.sub(r"\d+", "#", " ".join(run.label.split())), *under]


def described(html: str) -> tuple[int, str, list[int], list[int]]:
    """A page's key (equal for copies), outline, and its slots: paths, and
    hashes of path and text; each path stands once more with 0."""
    root = parse(html)
    marked = _articles(root)
    top = runs_of(root)
    found = {(path, t) for _, path, t in slots(top)}
    found |= {(path, 0) for path, _ in found}
    key = _hash("\n".join(map(text_of, marked or [root])))
    ordered = sorted(found)
    return key, json.dumps(outline(top)), [p for p, _ in ordered], [t for _, t in ordered]


def _outer_run(o: list) -> Run:
    run = Run(o[0], [])
    run.runs = [_outer_run(x) for x in o[1:]]
    return run


def _size(run: Run) -> int:
    return 1 + sum(map(_size, run.runs))


def layouts(shapes: list[tuple[int, str, int]]) -> list[int]:
    """The layout of each (shape, outline, pages) of a host: the shape with the
    most pages that it matches."""
    leaders: list[tuple[int, Run, int]] = []
    named = {}
    for shape, text, _ in sorted(shapes, key=lambda s: (-s[2], s[0])):
        run = _outer_run(json.loads(text))
        size = _size(run)
        for leader, other, n in leaders:
            if 2 * min(size, n) >= SIMILAR * (size + n) and 2 * match(run, other)[0] >= SIMILAR * (size + n):
                named[shape] = leader
                break
        else:
            leaders.append((shape, run, size))
            named[shape] = shape
    return [named[shape] for shape, _, _ in shapes]


def _links(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.out:
            if x.tag == "a":
                n += len(text_of(x))
            else:
                todo += x.parts
    return n


def _articles(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.out:
            if x.tag in ("article", "main"):
                found.append(x)
            else:
                todo += reversed(x.parts)
    return found


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol") and 2 * _links(node) > len(text_of(node))


def extract(html: str, template: set[int], layout_of: dict[int, int]) -> str:
    """The main text of a page, without the template of its host and layout."""
    if not html:
        return ""
    root = parse(html)
    dropped: set[int] = set()
    if template:
        top = runs_of(root)
        shape = _hash(json.dumps(outline(top)))
        layout = layout_of.get(shape, shape)
        for run, _, t in slots(top):
            if t in template or t ^ layout in template:
                dropped.update(map(id, run.nodes))
    marked = _articles(root)
    blocks, line = [], []

    def end():
        block = " ".join("".join(line).split())
        if block:
            blocks.append(block)
        line.clear()

    # parts still to read, last first; None ends a block
    todo: list = [p for node in reversed(marked or [root]) for p in (None, node, None)]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.out or id(x) in dropped:
            line.append(" " if x.tag not in BLOCKS else "")
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCKS:
            if marked or template or not _link_list(x):
                todo.append(None)
                todo += reversed(x.parts)
                todo.append(None)
        else:
            todo += reversed(x.parts)
    end()
    return "\n".join(blocks)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _recurring(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and t of the texts that are template."""
    slot = [*keys, "path"]
    pages = counts.where("t = 0").where(F.col("n") >= LEAST).select(*slot, F.col("n").alias("pages"))
    texts = counts.where("t <> 0").where(F.col("n") >= LEAST).join(pages, slot).where(F.col("n") >= SHARE * F.col("pages"))
    filled = texts.groupBy(*slot, "pages").agg(F.sum("n").alias("filled")).where(F.col("filled") >= ALIKE * F.col("pages"))
    return texts.join(filled.select(*slot), slot, "left_semi").select(*keys, "t")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, the hashes of its template (a layout's own are xor-ed with the
    layout), and its shapes that belong to another shape's layout, with it."""
    def describe(batches):
        for batch in batches:
            rows = [described(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([r[0] for r in rows], pa.int64()), pa.array([_hash(r[1]) for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["host", "key", "shape", "outline", "paths", "texts"])

    known = pages.where("host <> '' and html <> ''").select("host", "html").mapInArrow(
        describe, "host string, key long, shape long, outline string, paths array<long>, texts array<long>")
    # copies count once
    known = common.checkpoint(known.groupBy("host", "key").agg(F.min(F.struct("shape", "outline", "paths", "texts")).alias("page"))
                              .select("host", "page.*"))
    shapes = known.groupBy("host", "shape", "outline").agg(F.count(F.lit(1)).alias("n"))

    def group(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("shape", "outline", "n"))))
        return pa.table({"host": table.column("host"), "shape": table.column("shape"), "layout": pa.array(layouts(rows), pa.int64())})

    grouped = common.checkpoint(shapes.groupBy("host").applyInArrow(group, "host string, shape long, layout long"))
    sent = F.broadcast(grouped) if common.small_enough(grouped, BROADCAST_HOSTS) else grouped
    counts = common.checkpoint(
        known.join(sent, ["host", "shape"]).select("host", "layout", F.explode(F.arrays_zip("paths", "texts")).alias("s"))
        .groupBy("host", "layout", F.col("s.paths").alias("path"), F.col("s.texts").alias("t")).agg(F.count(F.lit(1)).alias("n")))
    whole = counts.groupBy("host", "path", "t").agg(F.sum("n").alias("n"))
    found = (_recurring(counts, ["host", "layout"]).select("host", F.col("t").bitwiseXOR(F.col("layout")).alias("t"))
             .unionAll(_recurring(whole, ["host"])))
    template = found.groupBy("host").agg(F.sort_array(F.collect_set("t")).alias("template"))
    moved = (grouped.where("shape <> layout").groupBy("host")
             .agg(F.sort_array(F.collect_list(F.struct("shape", "layout"))).alias("moved")))
    return common.checkpoint(template.join(moved, "host", "left").select(
        "host", "template", F.coalesce(F.col("moved.shape"), F.array().cast("array<long>")).alias("shapes"),
        F.coalesce(F.col("moved.layout"), F.array().cast("array<long>")).alias("layouts")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    pages = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))
    learned = wrappers(pages)
    if common.small_enough(learned, BROADCAST_HOSTS):
        learned = F.broadcast(learned)
    rows = pages.join(learned, "host", "left").select("page_id", "url", "html", "host", "template", "shapes", "layouts")

    def run(batches):
        cache: dict = {}
        for batch in batches:
            text = []
            for i, (h, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist())):
                if host not in cache:
                    if len(cache) >= 200:
                        cache.clear()
                    t, a, b = (batch.column(c)[i].as_py() or () for c in ("template", "shapes", "layouts"))
                    cache[host] = set(t), dict(zip(a, b))
                text.append(extract(h or "", *cache[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())],
                                             names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


def op3_wrapper_text(spark, sf_dir: str) -> DataFrame:
    return main_text(common.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
