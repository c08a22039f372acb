"""Operator 4: pages whose article is known, in several layouts, and its edge cases."""

import html
import random
import re

import pytest

from florilege.llm import sitetree

SCHEMA = "page_id long, url string, html string, text string, n_chars int, host int"
NONE = sitetree.Low(())


def plain(page):
    return sitetree.main_text(sitetree.parse(page), NONE)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b<br>c<b>d</b>e", "a b cde"),
        ("<header>H</header><nav>N</nav><article><h1>T</h1><p>x&nbsp; y</p></article><footer>F</footer>", "T x y"),
        ("<div id=main><p>kept</p><div class='cookie-notice'>no</div><form>no<input></form><div class=comments><p>no</p></div></div><div class=sidebar>no</div>", "kept"),
        ("<article><header><h1>T</h1></header><aside>no</aside><p>x<div class='ad banner'>no</div><section id=respond>no</section></article>", "T x"),
        ('<script>var t="</p><article>no</article>";</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><p hidden>no</p>', "yes"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one two a b"),
        ("<p title='>'>ok</p><p>1 < 2</p>", "ok 1 < 2"),
        ("<!-- never closed <p>no</p>", ""),
        ("<article>" + "<div>" * 5000 + "deep", "deep"),
        ('<div class="page with-sidebar"><article class="post has-sidebar">a</article><div class="sidebar">no</div></div>', "a"),
        ('<main><p>a</p></main><div id="comments"><article>no</article></div><div class="comment-list"><p>no</p></div>', "a"),
        ('<div class="layout-with-header"><p>a</p></div>', "a"),
        ('<article><p>a</p></article><article class="comment">no</article>', "a"),
        ('<div><ul><li><a href=x>no</a></li></ul><article><p>a <a href=y>link</a></p></article></div>', "a link"),
        ("<div class='entry-content'><p>a</p><div class='share-buttons'>no</div></div><section class='related-posts'>no</section>", "a"),
        ("<article>a</article><div>outside</div><article>b</article>", "a b"),
    ],
)
def test_layouts(page, text):
    assert plain(page) == text


def test_repeating_branches_go_by_entropy_alone(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = lambda n: " ".join(word() for _ in range(n))
    frame, rows, want = [line(8), line(12)], [], {}
    for i in range(60):
        body = [line(30) for _ in range(rng.randrange(1, 5))]
        # nothing in the names tells the frame from the text
        page = f"<html><body><div class=xa>{frame[0]}</div><div class=xb>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=xc>{frame[1]}</div></body></html>"
        rows.append((i, "https://a.example/p", page, "q", 1, 2))
        want[i] = " ".join(body)
    want |= {100: "", 101: "", 102: f"{frame[0]} new"}
    rows += [(100, None, None, "q", 1, 2), (101, "", "", "q", 1, 2), (102, "http://b.example", f"<div class=xd>{frame[0]}</div><div class=xb>new</div>", "q", 1, 2)]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    for most in (200_000, 0):
        got = sitetree.extract(df, broadcast_nodes=most).collect()
        assert len(got) == len(rows) + 1
        assert {r.page_id: r.text for r in got} == want, most
        assert all(r.n_chars == len(r.text) for r in got)
    assert sitetree.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_pages_go_by_entropy_too(spark):
    rng = random.Random(7)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    frame, rows, want = line(10), [], {}
    for i in range(30):
        want[i] = line(30)
        rows.append((i, "https://deep.example/", f"<div class=xa>{frame}</div><div class=xb>" + "<div>" * 100 + want[i] + "</div>" * 101, "q", 1, 2))
    assert {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_small_hosts_go_by_the_tree_of_all_hosts_whatever_its_size(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    frames = [line(8) for _ in range(6)]
    rows, want = [], {}
    for i in range(90):
        body = line(30)
        frame = "".join(f"<div class=x{'abcdef'[k]}>{f}</div>" for k, f in enumerate(frames))
        # 10 hosts of 3 pages with nothing low of their own, and one of 60
        rows.append((i, f"https://h{i % 10 if i < 30 else 'ot'}.example/{i}", f"{frame}<div class=body><p>{body}</p></div>", "q", 1, 2))
        want[i] = body
    rows += [(None, "https://h1.example/null", rows[0][2], "q", 1, 2)] + rows[:1] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, sitetree.extract(df).collect()))
    got = sitetree.extract(df, broadcast_nodes=3).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got if r.page_id is not None} == want
    assert sorted(map(str, got)) == whole


def test_pages_of_the_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in sitetree.extract(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(p|h1|br)[^>]*>", " ", inner)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def brute_importance(pages):
    """host -> path -> importance, the plain way: {(style, content)} of every page's node, copies once."""
    import math
    from collections import Counter, defaultdict

    nodes = defaultdict(dict)
    for url, page in pages:
        for path, (style, content, unit, flows, share, linked) in sitetree.features(sitetree.parse(page)).items():
            nodes[sitetree.host_of(url), path].setdefault(unit, (style, content, flows, share, linked))
    out = defaultdict(dict)
    for (host, path), units in nodes.items():
        n, rows = len(units), list(units.values())
        if n < 2:
            continue
        entropy = lambda k: -sum(c / n * math.log(c / n) for c in Counter(r[k] for r in rows).values()) / math.log(n)
        share, linked = (sum(r[k] for r in rows) / n for k in (3, 4))
        whole = max(entropy(0), entropy(1))
        out[host][path] = (n, whole if all(r[2] for r in rows) else max(entropy(0), entropy(1) * min(1, 10 * share)) * (1 - linked))
    return out


def test_importance_against_brute_force(spark):
    import xxhash

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = brute_importance([(r.url, r.html) for r in df.collect()])
    got = {(r.host, r.path) for r in sitetree.low_nodes(df, least_pages=5).collect()}
    number = {xxhash.xxh64_intdigest(h.encode()) >> 1: h for h in want}
    clear = lambda v: abs(v - sitetree.LOW) > 1e-9
    hosts = {h for h, nodes in want.items() if nodes[sitetree.ROOT][0] >= 5}
    assert hosts == {number[h] for h, p in got if p == sitetree.OWN_TREE and h in number}
    for host in hosts:
        low = {p >> 1 for p, (n, v) in want[host].items() if n >= 5 and v < sitetree.LOW}
        assert low == {p for h, p in got if number.get(h) == host and p != sitetree.OWN_TREE}
        assert all(clear(v) for _, v in want[host].values())
    assert len(hosts) > 3


def test_the_tree_alone_finds_the_articles(spark):
    """Without roles, on a host of enough pages: neither `nav`, `ad`, `footer` nor `article` is known by name."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    by_host = df.collect()
    big = max({sitetree.host_of(r.url) for r in by_host}, key=lambda h: sum(sitetree.host_of(r.url) == h for r in by_host))
    rows = [r for r in by_host if sitetree.host_of(r.url) == big]
    assert len(rows) >= sitetree.LEAST_PAGES
    host = spark.createDataFrame(rows, df.schema)
    with_roles = {r.page_id: r.text for r in sitetree.extract(host).collect()}
    alone = {r.page_id: r.text for r in sitetree.extract(host, roles=False).collect()}
    assert alone == with_roles and all(alone.values())
    # and what it says counts on pages with an article
    page = sitetree.parse(rows[0].html)
    every = sitetree.Low([p >> 1 for p in sitetree.features(page)], own=True)
    assert sitetree.main_text(page, every) == "" != sitetree.main_text(page, NONE) == with_roles[rows[0].page_id]
    assert sitetree.main_text(page, every, roles=False) == "" != sitetree.main_text(page, NONE, roles=False) != alone[rows[0].page_id]


def test_repeats_within_articles_go_and_lists_of_links_stay(spark):
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    rows, want, box = [], {}, line(9)
    for i in range(40):
        body, links = line(40), [line(1) for _ in range(3)]
        rows.append((i, "https://a.example/p", f"<article><p>{body}</p><div class=q>{box}</div><ul>{''.join(f'<li><a href=x>{w}</a></li>' for w in links)}</ul></article>", "q", 1, 2))
        want[i] = " ".join([body, *links])
    # three quarters of the host are copies of one page, whose article stays
    rows += [(100 + k, "https://a.example/p", rows[0][2], "q", 1, 2) for k in range(120)] + [(None, "https://a.example/p", rows[1][2], "q", 1, 2)] * 2
    want |= {100 + k: want[0] for k in range(120)} | {None: want[1]}
    for most in (200_000, 0):
        got = sitetree.extract(spark.createDataFrame(rows, SCHEMA), broadcast_nodes=most).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_a_counted_host_without_low_nodes_does_not_go_by_the_general_tree(spark):
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    same = line(12)
    rows = [(i, "https://many.example/", f"<div class=x>{same}</div><div class=y>{line(30)}</div>", "q", 1, 2) for i in range(80)]
    varied = [(200 + i, "https://own.example/", f"<div class=x>{line(12)}</div><div class=y>{line(30)}</div>", "q", 1, 2) for i in range(30)]
    for most in (200_000, 0):
        got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows + varied, SCHEMA), broadcast_nodes=most).collect()}
        for i, _, page, *_ in varied:
            assert got[i] == " ".join(re.sub("<[^>]*>", " ", page).split())
        assert all(same not in got[i] for i in range(80))


@pytest.mark.parametrize(
    "attributes, role",
    [
        ('title="the hidden truth"', ""),
        ('data-hidden="false"', ""),
        ('data-id="comments"', ""),
        ("title='class=\"comments\"'", ""),
        ('title="a > b" class=\'comments\'', "aside"),
        ("hidden", "hidden"),
        ("HIDDEN=''", "hidden"),
        ('class="x" class="comments"', ""),
        ("aria-hidden = true", "hidden"),
        ('style="display : none"', "hidden"),
        ('class="com&#109;ents"', "aside"),
        ('"comments" id=comments/', ""),
    ],
)
def test_attributes_are_read_one_after_another(attributes, role):
    assert sitetree.described("div", " " + attributes)[1] == role


def test_article_text_stays_whatever_its_attributes_say():
    for attributes in ('title="the hidden truth"', 'data-hidden="false"', 'data-id="comments"'):
        page = f"<article><div {attributes}><p>Main words of it.</p></div><p>Second.</p></article>"
        assert sitetree.main_text(sitetree.parse(page), sitetree.Low(())) == "Main words of it. Second."
