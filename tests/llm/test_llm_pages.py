"""WARC round trips and page text."""

import base64
import gzip
import hashlib
import html
import io
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import page_text, warc
from marketlens.llm.queries import QUERIES
from marketlens.llm.shared import cut, open_fs, run_folder

SMALL = "/root/testdata/sf0.001"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_brute(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data, first = (h or "").encode(), least.get(h or "")
        revisit = first is not None and i != first
        out.append((i is None, i or 0, len(data), sha(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def archive(spark, pages, **options):
    folder = run_folder(spark, "test-warc")
    planned = warc.plan_records(pages, "page_id", "url", "html")
    mono = cut(warc.write_archives(planned, f"{folder}/mono", **options), "t")
    return mono, cut(warc.normalise(mono, f"{folder}/records"), "t")


def test_warc_round_trip_and_edges(spark):
    rows = [(5, "http://a/é?x=%20", "<p>ä</p>"), (3, "http://b", "<p>ä</p>"), (9, None, "<p>ä</p>"), (7, "u", None), (8, "u", ""), (10, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 3),
            (11, "a\r\nb", "y" * 3_000_000), (12, "u", "z"), (12, "u", "z"), (None, "u", "z"), (None, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).withColumn("id", F.lit(0)).coalesce(1)
    mono, index = archive(spark, pages, archive_bytes=1_000_000)
    assert mono.count() > 1
    back = warc.read_records(index).collect()
    got = sorted(((r["record_key"] is None, r["record_key"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=str)
    assert got == warc_brute(rows)
    contents = {r["record_key"]: bytes(r["payload"]).decode() for r in back if r["record_type"] == "response" and r["record_key"]}
    assert contents == {3: "<p>ä</p>", 7: "", 10: rows[5][2], 11: rows[6][2], 12: "z"}
    assert {r["url"] for r in back if r["record_key"] in (5, 9)} == {"http://a/é?x=%20", None}
    # each index entry is a gzip member of its own, and the members are the whole file
    by_file = {}
    for r in index.collect():
        by_file.setdefault(r["path"], []).append((r["offset"], r["length"]))
    for path, spans in by_file.items():
        fs, at = open_fs(path)
        data = fs.open_input_file(at).read()
        spans.sort()
        assert [a for a, _ in spans] == [0, *(a + n for a, n in spans[:-1])] and sum(n for _, n in spans) == len(data)
        assert all(gzip.decompress(data[a : a + n]).startswith(b"WARC/1.1\r\n") for a, n in spans)
    assert archive(spark, pages.limit(0))[1].count() == 0


def test_warc_streams_are_read_once_in_small_pieces(monkeypatch):
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"x", b"\r\n\r\n" * 9, b"q" * 5000)]
    monkeypatch.setattr(warc, "CHUNK", 7)
    one = gzip.compress(b"".join(records))
    many = b"".join(gzip.compress(r) for r in records)
    for data in (one, many):
        assert list(warc.split_records(warc.inflate(io.BytesIO(data)))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"".join(records)[:-3000]])))


def test_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op1_warc"](spark, SMALL).collect()
    assert sorted(((False, r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == warc_brute(rows)


def article(page):
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    m = re.sub(r"<[^>]*>", "", re.sub(r"</?(h1|p|br)[^>]*>", " ", m))
    return " ".join(html.unescape(m).split())


def test_page_query_gives_the_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op9_page_text"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == article(p["html"]) and got[p["page_id"]]["n_chars"] == len(article(p["html"])) and got[p["page_id"]]["url"] == p["url"]


BOILER = "all rights reserved by the owners of this small site since long ago"


def covered_brute(streams, depth=8):
    """For lists of blocks: words kept, where a word goes if a repeated substring covers it."""
    distinct = {tuple(s) for s in streams}
    owners = {}
    for n, s in enumerate(sorted(distinct)):
        words = [w for b in s for w in b.lower().split()]
        for i in range(len(words) - depth + 1):
            owners.setdefault(tuple(words[i : i + depth]), set()).add(n)
        for b in s:
            if 0 < len(b.split()) < depth:
                owners.setdefault(("short", *b.lower().split()), set()).add(n)
    out = []
    for s in streams:
        words = [w.lower() for b in s for w in b.split()]
        gone = set()
        for i in range(len(words) - depth + 1):
            if len(owners[tuple(words[i : i + depth])]) > 1:
                gone |= set(range(i, i + depth))
        at, kept = 0, []
        for b in s:
            w = b.split()
            if 0 < len(w) < depth and len(owners[("short", *b.lower().split())]) > 1:
                gone |= set(range(at, at + len(w)))
            kept += [x for k, x in enumerate(w) if at + k not in gone]
            at += len(w)
        out.append(" ".join(kept))
    return out


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_repeated_substrings_of_a_host_go(spark, group_bytes):
    bodies = [[f"Story {i} begins here", f"unique{i} " * 12 + BOILER, "Contact us", f"More from page {i} " + BOILER + " tail"] for i in range(12)]
    bodies += [["Only here " + BOILER]]
    rows = [(i, "http://h.example/x", "".join(f"<div>{b}</div>" for b in s)) for i, s in enumerate(bodies)]
    rows += [(100, "http://h.example/copy", rows[0][2]), (101, "http://other.example/", rows[0][2])]
    streams = [*bodies, bodies[0]]
    want = dict(zip([*range(13), 100], covered_brute([[" ".join(b.split()) for b in s] for s in streams])))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("part", F.lit(1))
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages, "page_id", "url", "html", group_bytes=group_bytes).collect()}
    assert got.pop(101) == " ".join(" ".join(bodies[0]).split())  # nothing repeats on that host
    assert got == want and "rights" not in got[3] and "unique3" in got[3]


def test_equal_outside_blocks_with_different_articles(spark):
    notice = "Welcome, free delivery on all orders above twenty euros until the end of May"
    rows = [(i, "http://h.example/x", f"<div>{notice}</div><article>unique{i} text</article>") for i in range(12)] + [(12, "http://h.example/x", f"<div>{notice}</div><article>unique0 text</article>")]
    rows += [(20 + i, "http://copies.example/x", f"<div>{notice}</div>") for i in range(4)]  # one page four times
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages, "page_id", "url", "html").collect()}
    assert got == {**{i: f"unique{i % 12} text" for i in range(13)}, **{20 + i: notice for i in range(4)}}


def test_ordinary_prose_on_a_large_host_stays(spark):
    """Common phrases, subheadings, dialogue and edited copies stay; what most pages carry goes."""
    phrase = "as far as anyone in the town could tell"  # nine words, in many sentences
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows, want = [], []
    for i in range(40):
        blocks = [words(i, 15), f"{words(i, 3)} {phrase} {words(i, 4)}"]
        blocks += ["Conclusion"] * (i % 4 == 0) + ["Yes, he said."] * (i % 10 == 0) + ["a long table cell that holds nine words here"] * (i % 20 == 0)
        if i < 2:
            blocks += [words("copy", 60) + f" edit{i} " + words("end", 40)]
        blocks.append(words(f"{i}y", 15))
        rows.append((i, "http://h.example/x", "".join(f"<p>{b}</p>" for b in [*blocks, "Subscribe today", "Read our free letter with all the news of this week every Monday"])))
        want.append((i, " ".join(blocks)))
    rows += [(100 + i, "http://two.example/", f"<p>{words('same', 30)} e{i} {words('more', 30)}</p>") for i in range(2)]
    want += [(100 + i, f"{words('same', 30)} e{i} {words('more', 30)}") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages, "page_id", "url", "html", group_bytes=4000).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("options", [{}, {"group_bytes": 60, "group_pages": 1}])
def test_repeated_text_inside_articles_goes(spark, options):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    notice = "Read more from our partners and support this site with a gift"
    rows, want = [], {}
    for i in range(24):
        own = [f"The story {i}", words(i, 20), *(["Conclusion"] if i % 3 == 0 else []), f"The end {words(i, 9)}"]
        main = f"<h1>{own[0]}</h1><p>{notice}</p><p>{own[1]}</p>" + "".join(f"<h2>{b}</h2>" for b in own[2:-1]) + f"<p>{own[-1]}</p><p>{notice} today</p><p>Share this</p>"
        rows.append((i, "http://h.example/", f"<nav>n</nav><article>{main}</article>"))
        want[i] = " ".join(own)
    # copies of an article are one article, on pages of their own
    rows += [(100 + i, "http://c.example/", f"<p>{words(('c', i), 9)}</p><main><p>{words('copy', 30)}</p></main>") for i in range(9)]
    want |= {100 + i: " ".join(f"{words(('c', i), 9)} {words('copy', 30)}".split()) for i in range(9)}
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages, "page_id", "url", "html", **options).collect()}
    assert got == want


def test_groups_get_only_repeats_that_they_hold(spark):
    held = spark.createDataFrame(
        [("h", p, False, 1, 10, 100) for p in range(3)] + [("h", 0, False, 2, 25, 100), ("h", 2, False, 3, 19, 100), ("h", 1, True, 4, 60, 100), ("i", 0, False, 2, 2, 2)],
        "host string, part int, main boolean, sig bigint, n bigint, of bigint")
    got = sorted(tuple(r) for r in page_text._repeated(held).collect())
    assert got == [("h", 0, 1, False), ("h", 0, 2, False), ("h", 1, 1, False), ("h", 1, 4, True), ("h", 2, 1, False)]


def test_few_pages_make_no_candidates():
    """Passages of two pages each are not sent to the other groups of a large host."""
    n = 64
    own = [" ".join(f"w{i // 2}x{k}" for k in range(200)) for i in range(n)]
    rows = [(i, i, "h", 2, f"<p>{own[i]}</p><p>p{i}</p>") for i in range(n)]
    batch = pa.RecordBatch.from_pydict(dict(zip(("page_id", "page", "host", "parts", "html"), map(list, zip(*rows)))) | {"url": ["http://h/"] * n})
    table = pa.Table.from_batches(list(page_text._parsed(iter([batch]))))
    found = page_text._candidates(page_text.DEPTH)((pa.scalar("h"), pa.scalar(0, pa.int32())), table).to_pylist()
    assert [(r["sig"], r["main"], r["n"]) for r in found] == [(None, False, n), (None, True, 0)]


def test_blocks_and_regions():
    text = lambda page: " ".join(b for b, r in page_text.blocks(page) if r != page_text.IN_CHROME)
    assert text("<p>a<b>b</b>c<br>d &amp; e&nbsp;f &lt;g&gt; &eacute;") == "abc d & e f <g> é"
    assert text('<div class="side-bar sidebar">x</div><div class="badge">y</div>') == "y"
    assert text('<script>var t="</p>";</script><style>p{}</style>z<!-- <p>no --><p title="a>b">w') == "z w"
    assert text("<nav><ul><li>one<li>two</ul></nav><main><header><h1>T</h1></header>body<aside>x</aside> end</main><footer>f</footer>") == "T body end"
    assert text('<article><p>in</p><div class="comments"><p>c</p></div><form>q</form>out</article>') == "in out"
    assert text('<p>kept</p><a href="/cut') == text("<p>kept</p><a href='/cut >") == text('<p>kept</p></a') == "kept"
    assert text("<p>kept</p><p unfinished") == "kept" and text("<p>kept<!-- cut") == "kept" and text("a<script>cut") == "a"
    assert text('<div id="cookie-notice">c</div><div role="navigation">n</div><div hidden>h</div>t') == "t"
    assert text('<main class="has-sidebar search-page"><h1>T</h1><button>Share</button>x</main><article class="comment">c</article>') == "T x"
    assert text('<div class="no-sidebar">in</div><section class="reader-comments"><p>c</p></section><p class="cookie_notice">n</p>') == "in"
    assert page_text.blocks(None) == page_text.blocks("") == page_text.blocks(" <p> </p>") == []
    assert text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert text("<article>a</nav></article></div><p>b &copy") == "a b ©"


@pytest.mark.parametrize("before, after", [
    ('<form id="aspnetForm">', "</form>"), ('<div class="content sidebar-right">', "</div>"), ('<div id="search-page">', "</div>"),
    ('<div class="layout-header-fixed"><form><div>', "</div></form></div>")])
@pytest.mark.parametrize("main", ["<article>a<p>b</p></article>", "<main>a<p>b</p></main>", '<div role="main">a<p>b</p></div>', "<div role='main'>a<p>b</p></div>", "<div ROLE=main>a<p>b</p></div>"])
def test_main_elements_inside_chrome_wrappers(before, after, main):
    page = f"{before}<p>x</p>{main}<p>y</p>{after}<p>z</p>"
    assert page_text.blocks(page) == [("x", page_text.IN_CHROME), ("a", page_text.IN_MAIN), ("b", page_text.IN_MAIN), ("y", page_text.IN_CHROME), ("z", page_text.BODY)]
    for closed in ("nav", "aside", "footer", 'section class="comments"', 'div id="disqus_thread"'):
        assert page_text.blocks(f"<{closed}>{before}{main}{after}</{closed.split()[0]}>") == [("a", page_text.IN_CHROME), ("b", page_text.IN_CHROME)]
    inner = f"<main>t<form>q{main}</form></main>"
    assert page_text.blocks(inner) == [("t", page_text.IN_MAIN), ("q", page_text.IN_CHROME), ("a", page_text.IN_MAIN), ("b", page_text.IN_MAIN)]


def test_page_edges(spark):
    rows = [(1, None, None), (2, "nourl", ""), (3, "http://h/", "<p>" + "word " * 100_000), (3, "http://h/", "<p>" + "word " * 100_000), (None, "http://h/", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = page_text.extract(pages, "page_id", "url", "html").collect()
    assert sorted((r["page_id"] or 0, len(r["text"])) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 499_999), (3, 499_999)]
    assert page_text.extract(pages.limit(0), "page_id", "url", "html").count() == 0


@pytest.mark.parametrize("page, kept", [
    ("<article><p title=it's>Hello world</p><p>don't stop here</p><p>end</p></article>", ["Hello world", "don't stop here", "end"]),
    ("<article><p class=ad>Buy now<p>Real text one</p><p>two</article>", ["Real text one", "two"]),
    ("<article><ul><li class=share>x<li>Real item</ul></article>", ["Real item"]),
    ("<article><ul><li class=share>a<ul><li>x</li></ul>more</li><li>Real</ul></article>", ["Real"]),
    ("<article><table><tr><td class=ad>x<td>Cell</td><tr class=promo><td>gone<tr><td>Row</table></article>", ["Cell", "Row"]),
    ("<article><dl><dt class=ad>x<dd>Meaning</dl><p class=ad>a <b>b<div>after</div></article>", ["Meaning", "after"]),
    ("<article><div class='article-form-guide'>a</div><div class='search-results-study'>b</div><div class='ad-slot'>no</div>"
     "<div class='newsletter-signup wide'>no</div></article>", ["a", "b"]),
    ("<article><p data-x = 'a > b' title=\"c > d\">Quoted</p></article>", ["Quoted"]),
])
def test_quotes_implied_ends_and_class_words(page, kept):
    assert [text for text, region in page_text.blocks(page) if region == page_text.IN_MAIN] == kept


def test_index_is_dealt_out_by_stretches_of_files(spark):
    rows = [(f"f{k}", i * 1000, 1000, "response", i) for k in range(3) for i in range(100)]
    index = spark.createDataFrame(rows, "path string, offset bigint, length bigint, record_type string, record_key bigint")
    dealt = warc.by_stretch(index, 25_000)
    assert dealt.rdd.getNumPartitions() == 12 and sorted(map(tuple, dealt.collect())) == sorted(rows)
    parts = dealt.withColumn("part", F.spark_partition_id()).groupBy("path", F.floor(F.col("offset") / 25_000)).agg(F.count_distinct("part").alias("n"))
    assert {r["n"] for r in parts.collect()} == {1}
