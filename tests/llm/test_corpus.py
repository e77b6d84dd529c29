"""Operators over the whole corpus, pages and the pipeline."""

import html as H
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from gradeframe.llm import common, decontam, minhash_bayes, queries, warc_fixity, wrapper

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_components(rows, k, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    least = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            least[i] = min(ids) if ids else None
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))]


def chained(n=60, words=60):
    """Near copies whose neighbours are similar and whose ends are not."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        base = [*base[1:], f"n{i}"]
        out.append(" ".join(base))
    return out


def test_near_duplicates(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.read(spark, SF, "documents").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(chained())]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  B"), (2002, "a b"), (None, "a b"), (None, None), (None, "lone text here")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, component_id string")
    got = minhash_bayes.near_duplicates(df, 4).collect()
    want = plain_components(rows, 4)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)
    assert minhash_bayes.near_duplicates(df.limit(0), 4).count() == 0


def test_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    """With one partner a node, links left to the blocks are all found."""
    monkeypatch.setattr(minhash_bayes, "PARTNERS", 1)
    monkeypatch.setattr(minhash_bayes, "BLOCK", 8)
    rows = list(enumerate(chained(80, 50)))
    got = minhash_bayes.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(a, c) for a, _, c in plain_components(rows, 3)}


def test_posterior_bounds():
    least = minhash_bayes.survival_table()
    assert (least[1:] > least[:-1]).all() and least[-1] < 0.8 * minhash_bayes.HASHES


def plain_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i:i + size])) in windows:
                    hit.update(range(i, i + size))
                    names |= windows[k]
        out.append((doc, len(w), len(hit), sorted(names)))
    return out


def test_contamination(spark):
    items = [(r["item_id"], r["text"]) for r in common.read(spark, SF, "benchmark").collect()]
    items += [(900, None), (901, "..."), (902, "Zebra zebra"), (903, "a a a a a a a a a a a a"), (904, "zebra zebra")]
    rows = [(r["doc_id"], r["text"]) for r in common.read(spark, SF, "documents").collect()]
    rows += [(800, None), (801, ""), (802, "x ZEBRA-zebra zebra É"), (803, "a " * 50), (804, "." + items[0][1] + "."), (None, "zebra zebra"), (803, "a " * 50)]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, bench, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(plain_contamination(rows, items), key=str)
    assert {r["n_hit"] for r in decontam.contamination(docs, bench.limit(0), ["doc_id"]).collect()} == {0}
    assert decontam.contamination(docs.limit(0), bench, ["doc_id"]).count() == 0


def test_proximity(spark):
    item = "rare1 alpha rare2 beta rare3 gamma delta epsilon zeta eta"
    docs = spark.createDataFrame([(1, item), (2, item.replace("alpha", "other")), (3, "rare1 " + "x " * 200 + "rare2 rare3 " + item[6:11]),
                                  (4, "alpha beta gamma delta epsilon zeta eta " * 3)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontam.contamination(
        docs, spark.createDataFrame([(1, item)], "item_id long, text string"), ["doc_id"]).collect()}
    assert got[1] == (10, 0) and got[2] == (0, 1) and got[4][0] == 0


def test_proximity_does_without_terms_that_occur_nowhere(spark):
    item = "rare1 alpha rare2 beta rare3 gamma delta epsilon zeta eta"
    docs = spark.createDataFrame([(2, item.replace("alpha", "other")), (3, "eta eta")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "the zeta is not said in any of these texts")], "item_id long, text string")
    for proximity in (True, False):
        found = decontam.contamination(docs, bench, ["doc_id"], proximity=proximity).collect()
        got = {r["doc_id"]: (r["n_hit"], r["n_near"] if proximity else 0) for r in found}
        assert got == {2: (0, int(proximity)), 3: (0, 0)}


PAGE = ("<html><head><title>{t}</title><script>x('<p>no</p>')</script></head><body><header>Site</header><ul class='menu'><li><a href=/>Home</a></ul>"
        "<div class=story><h1>{t}</h1><p>First {t} &amp; more<p>Second   {t}</div><div class=legalese>Same words in all pages</div>"
        "<div class='comments'>nice {t}</div><footer>&copy; x</footer></body></html>")


def test_wrapper(spark):
    pages = [(i, "http://h.example/p", PAGE.format(t=f"t{i}")) for i in range(6)]
    pages += [(10, None, None), (11, "http://h.example/", ""), (12, "bad url", "<p>lone</p> tail <b>x"), (13, "http://k.example", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(df).collect()}
    assert all(got[i] == f"t{i}\nFirst t{i} & more\nSecond t{i}" for i in range(6))
    assert got[10] == got[11] == "" and got[12] == "lone\ntail x" and got[13] == "deep"
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    pages = common.read(spark, SF, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in wrapper.main_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S).group(1)
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_fixity(spark):
    leaves = spark.createDataFrame([(f, o * 700, 700, o, f"d{f}-{o}") for f in range(3) for o in range(400)],
                                   "file long, offset long, length long, record_id long, digest string")
    other = (leaves.where("not (file = 1 and record_id in (5, 399))").withColumn(
        "digest", F.when((F.col("file") == 2) & (F.col("record_id") == 77), "bad").otherwise(F.col("digest")))
        .unionAll(spark.createDataFrame([(0, 10 ** 6, 1, 1000, "new")], leaves.schema)))
    roots, found = warc_fixity.audit(leaves, other)
    assert all(r["root_a"] != r["root_b"] for r in roots.collect())
    assert {(r["file"], r["offset"], r["a"] is None, r["b"] is None) for r in found.collect()} == {
        (1, 3500, False, True), (1, 399 * 700, False, True), (2, 77 * 700, False, False), (0, 10 ** 6, True, False)}
    same, none = warc_fixity.audit(leaves, leaves.repartition(7))
    assert all(r["root_a"] == r["root_b"] for r in same.collect()) and none.count() == 0


def test_damage_is_located(spark):
    pages = common.read(spark, "/root/testdata/sf0.01", "pages")
    pages = pages.unionAll(pages.limit(3)).unionAll(spark.createDataFrame([(None, None, None)], pages.schema))
    a, b = warc_fixity.replicas(pages)
    _, found = warc_fixity.audit(a, b)
    plain = a.alias("a").join(b.alias("b"), ["file", "offset"], "left").where("not (a.digest <=> b.digest)")
    assert a.count() == pages.count()
    assert {(r["file"], r["offset"]) for r in found.collect()} == {(r["file"], r["offset"]) for r in plain.collect()}


def test_pipeline(spark):
    docs = common.read(spark, SF, "documents")
    left = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = common.stored(stage(spark, left, SF))
        assert left.columns == docs.columns
        kept.append({r["doc_id"]: r["text"] for r in left.collect()})
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sorted(kept[0].items())
    assert set(kept[1]) == {d for d, _, c in plain_components(rows, 5) if d == c}
    items = [(r["item_id"], r["text"]) for r in common.read(spark, SF, "benchmark").collect()]
    assert set(kept[2]) == {d for d, _, n, _ in plain_contamination(sorted(kept[1].items()), items) if not n}
    assert set(kept[3]) == set(kept[2])
    assert all(t == text[d] or "[secret]" in t for d, t in kept[3].items())
    last = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert {r["doc_id"] for r in last.collect()} == set(kept[3])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered():
    import __spark_entry__ as entry
    assert list(queries.queries()) == [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert "pipeline" in entry.queries()


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrapper.main_text(df).orderBy("page_id").collect()]


def test_wrapper_of_a_host_with_one_title(spark):
    for head in ("<title>Site</title>", ""):
        page = "<html><head>" + head + "</head><body><div class=x>Same on all</div><h1><b>own {i}</b></h1><p>Text number {i}</p></body></html>"
        pages = [page.format(i=i) for i in range(6)] + [page.format(i=0)] * 30
        assert texts_of(spark, pages) == [f"own {i}\nText number {i}" for i in [*range(6), *[0] * 30]]


def test_wrapper_of_layouts_menus_and_banners(spark):
    """Two layouts 60/40 that use one path for template and for content, a menu
    per section and a banner of three texts."""
    one = ("<body><div class=sect>Section {m} more</div><div class=top>Notice of layout one</div><div class=box>Article {i} of one</div>"
           "<section>Offer {b}</section></body>")
    two = "<body><div class=box>Notice of layout two</div><table><tr><td>Article {i} of two</table><section>Offer {b}</section></body>"
    pages = [(one if i % 5 < 3 else two).format(i=i, m=i % 4, b=i % 3) for i in range(100)]
    assert texts_of(spark, pages) == [f"Article {i} of {'one' if i % 5 < 3 else 'two'}" for i in range(100)]


def test_role_words_leave_content(spark):
    pages = ["<body><div class='content has-sidebar no-menu'><h2 id=related-work class=related>Work</h2><section id=meta-analysis>Meta</section>"
             "<table class=side-by-side><tr><td>Cells</table><div class=form-group>Group</div><p><a href=x>Read on here</a></div>"
             "<div class='x comments'>Nice</div><div class=ad></div></body>",
             "<div class=search>All of the text of a page</div>",
             "<article><p>One</p><div class=share>Two</div></article><div class=share>Three</div>"]
    assert texts_of(spark, pages) == ["Work\nMeta\nCells\nGroup\nRead on here", "All of the text of a page", "One\nTwo"]


def test_pipeline_keeps_one_of_equal_rows(spark):
    """Rows equal in doc_id and text; the least lang, source and n_chars stay.
    Rows without words are no copies of each other."""
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(1, words, "en", "b", 3), (1, words, "en", "a", 9), (1, words, None, "z", 1), (2, words, "en", "a", 1),
            (3, "another text of its own with some words in it", "en", "a", 1), (4, "", "en", "a", 1), (4, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    got = sorted(((r.doc_id, r.lang, r.source, r.n_chars) for r in kept.collect()), key=str)
    assert got == [(1, None, "z", 1), (3, "en", "a", 1), (4, "en", "a", 1), (4, "en", "a", 1)]


def test_wrapper_keeps_article_headings_and_ends_open_elements(spark):
    pages = ["<article><header><h1>Title</h1><p>by X</p></header><p>x</p></article>",
             "<nav><a href='/'>home</a><div><p>Main text.</p><p>Second block.</p></div>",
             "<nav><ul><li>a<li>b</ul><p>Text after the list.</p></body></html>",
             "<aside><p>ad</p><article><h1>T</h1><p>In an open aside.</p></article>",
             "<nav>menu<aside>note<header>top<div><article><p>Deep.</p></article></div></body>",
             "<header><p>site</p></header><p>Body.</p><footer><p>never closed",
             "<div><nav>x</div><article><p>After.</p></article>",
             "<nav><p>closed menu</p></nav><p>Body.</p>"]
    got = texts_of(spark, pages)
    assert got == ["Title\nx", "Main text.\nSecond block.", "Text after the list.", "T\nIn an open aside.", "Deep.", "Body.",
                   "After.", "Body."]


def test_wrapper_takes_any_tag_soup():
    rng = random.Random(11)
    pieces = ["<nav>", "</nav>", "<article>", "</article>", "<header>", "</header>", "<h1>", "</h1>", "<p>", "<aside>", "<div>", "</div>",
              "<ul>", "<li>", "</ul>", "<main>", "</body>", "<form>", "</form>", "text ", "<td>", "<tr>"]
    for _ in range(3000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        root, seen, todo = wrapper.parse(html), set(), []
        todo.append(root)
        while todo:                                  # a tree: every node once, every text still there
            x = todo.pop()
            if isinstance(x, wrapper.Node):
                assert id(x) not in seen
                seen.add(id(x))
                todo += x.parts
        wrapper.described(html)
