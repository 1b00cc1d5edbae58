"""Archives, the merged index and wrappers."""

import hashlib
import html as html_module
import random
import re

from odd_rows import SF

from tickloom.llm import warc, wrappers

PAGES = [
    (1, "http://www.b.example/x?q=1", "<p>" + "a" * 2000), (2, "http://b.example/x", "<p>" + "a" * 2000), (3, None, "<p>" + "a" * 2000), (4, "not a url\r\nX: y", "small"), (5, "http://b.example/x", "small"),
    (6, "http://b.example/z", None), (7, "http://b.example/z", ""), (8, "http://é.example/ü", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60), (8, "http://é.example/ü", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60),
    (None, "http://b.example/x", "<p>" + "a" * 2000), (-4, "HTTP://[bad", "é" * 700),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, refers_to long")


def expected(rows):
    raw = [(k, (h or "").encode()) for k, _, h in rows]
    most = {}
    for k, b in raw:
        if len(b) >= 1000 and k is not None:
            most[b] = max(most.get(b, k), k)
    return sorted(((k, len(b), hashlib.sha1(b).hexdigest(), *(("response", None) if most.get(b, k) == k else ("revisit", most[b]))) for k, b in raw), key=str)


def test_archives_of_odd_pages(spark):
    pages = frame(spark, PAGES).repartition(3)
    assert sorted((tuple(r) for r in warc.digest(pages).collect()), key=str) == expected(PAGES)
    assert warc.digest(pages.limit(0)).count() == 0


def test_history_is_in_order(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(4)
    rows = sorted(warc.stored(pages).collect(), key=lambda r: r["place"])
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in rows]
    assert len(rows) == pages.count() and keys == sorted(keys)
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows), key=str) == expected([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_loser_tree_merges():
    rng = random.Random(1)
    for runs in (0, 1, 2, 3, 7, 8, 13):
        lists = [sorted(((rng.choice("abc"), str(rng.randrange(5)), rng.randrange(9), None, "", None, 0, "", "f", k, 0) for k in range(rng.randrange(6))), key=warc.order) for _ in range(runs)]
        merged = list(warc.LoserTree(lists))
        assert [warc.order(r) for r in merged] == sorted(warc.order(r) for run in lists for r in run)


def test_url_keys():
    assert warc.url_key("https://WWW.Sub.Example.org/A/b?Q=1#top") == "org,example,sub)/a/b?q=1"
    assert warc.url_key(None) == "" and warc.url_key("http://x.y") == "y,x)/"


def article(page):
    found = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    text = re.sub(r"</?(b|i|a|em|strong|span)(\s[^>]*)?>", "", found[1] if found else "")
    blocks = [" ".join(html_module.unescape(b).split()) for b in re.sub(r"<[^>]*>", "\0", text).split("\0")]
    return " ".join(b for b in blocks if b)


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.digest(pages).collect()}
    assert got == {r["page_id"]: article(r["html"]) for r in pages.collect()}


MENU = '<nav><ul>{}</ul></nav>'
FULL = (
    '<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header>' + MENU + '<div id="cookie-notice">We use cookies</div><aside class="x">Side</aside>'
    '<main><h1>{}</h1>{}<div class="comments"><p>First!</p></div><form><p>Sign up</p></form></main><div class="ad">Buy</div><script>"</p>"</script><footer>&copy; F</footer></body></html>'
)
BARE = '<html><body><div class="wrap"><div>Always the same words.</div><div><a href="/">Home</a> <a href="/n">News</a></div><section><h2>{}</h2>{}</section><div>Always the same end.</div></div></body></html>'


def test_templates(spark):
    rows, texts = [], {}
    for i in range(12):
        blocks = [f"Block {i} {k} a&amp;b&nbsp;c &lt;x&gt; <b>bo</b>ld." for k in range(i % 4)]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        plain = [f"Title {i}", *[f"Block {i} {k} a&b c <x> bold." for k in range(i % 4)]]
        links = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(1 + i % 3))
        rows.append((i, "http://full.example/1", FULL.format(links, f"Title {i}", body)))
        rows.append((100 + i, "http://bare.example/1", BARE.format(f"Title {i}", body)))
        texts[i] = texts[100 + i] = " ".join(plain)
    rows += [(200, None, None), (201, "", ""), (202, "http://[bad", "no tags at all"), (203, "http://t.example", "<p>unclosed <b>and <")]
    got = {r["page_id"]: r["text"] for r in wrappers.digest(frame(spark, rows)).collect()}
    assert {k: got[k] for k in texts} == texts
    assert got[200] == "" and got[201] == "" and len(got) == len(rows)
    assert wrappers.digest(frame(spark, rows).limit(0)).count() == 0


def test_wrappers_have_optional_and_repeated_groups():
    pages = [f"<article><h1>T</h1>{'<p>x</p>' * n}{extra}</article>" for n, extra in ((3, ""), (1, ""), (2, "<ul><li>a</li><li>b</li></ul>"))]
    streams = [[(t, False) for t in wrappers.fold_repeats(wrappers.Page(p).tokens)] for p in pages]
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = wrappers.align(wrapper, s)
    units = wrappers.packed(wrapper).split("\n")
    assert "(<p>\t#article\t</p>)+" in units and "(<li>\t#article/ul\t</li>)+?" in units and "#article" in units
    assert wrappers.unpacked(wrappers.packed(wrapper)) == wrapper


def test_slots_that_only_begin_alike_are_kept(spark):
    lead = "The same lead-in on every page of the site. " * 8
    rows = [(i, "http://lead.example/1", f"<html><body><div>{lead}Article number {i} goes on here.</div></body></html>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in wrappers.digest(frame(spark, rows)).collect()}
    assert got == {i: f"{lead}Article number {i} goes on here." for i in range(4)}


def test_hosts_of_several_templates(spark):
    rows, texts = [], {}
    for url, base in (("http://mixed.example/1", 0), (None, 100), ("not a url", 200)):
        for i in range(4):
            rows += [(base + i, url, f"<html><body><nav>Menu</nav><main><p>Main {base + i}</p></main></body></html>"), (base + 50 + i, url, f"<html><body><nav>Menu</nav><div><p>Plain {base + i}</p></div></body></html>")]
            texts |= {base + i: f"Main {base + i}", base + 50 + i: f"Plain {base + i}"}
    got = {r["page_id"]: r["text"] for r in wrappers.digest(frame(spark, rows)).collect()}
    assert got == texts


def test_slots_are_judged_by_their_place_in_the_wrapper(spark):
    notice = "<h3>Notice of the site</h3>"
    rows = [(i, "http://place.example/1", f"<html><body><div><p>Always the same.</p><h2>Title {i}</h2>{notice if i % 2 else ''}<p>Text {i}</p></div></body></html>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrappers.digest(frame(spark, rows)).collect()}
    assert got == {i: f"Title {i} Text {i}" for i in range(6)}


def test_another_wrapper_gives_another_text(spark, monkeypatch):
    rows = [(i, "http://group.example/1", f"<html><body><div><p>Always the same.</p><p>Text {i}</p></div></body></html>") for i in range(4)]
    texts = lambda: {r["page_id"]: r["text"] for r in wrappers.digest(frame(spark, rows)).collect()}
    assert texts() == {i: f"Always the same. Text {i}" for i in range(4)}  # one repeated group
    apart = "\n".join(wrappers.Page(rows[0][2]).tokens)
    monkeypatch.setattr(wrappers, "infer", lambda facts: facts.select("host").distinct().selectExpr("host", f"'{apart}' AS wrapper"))
    assert texts() == {i: f"Text {i}" for i in range(4)}


def test_wrappers_take_their_pages():
    rng = random.Random(3)
    for _ in range(300):
        pages = []
        for _ in range(rng.randrange(1, 7)):
            parts = "".join(rng.choice(("<p>x</p>", "<p>x</p>", "<div>y</div>", "<div><p>x</p><p>z</p></div>", "<ul><li>a</li><li>b</li></ul>", "t")) for _ in range(rng.randrange(9)))
            pages.append(wrappers.Page(f"<body>{parts}</body>").tokens)
        wrapper = [(t, False) for t in wrappers.fold_repeats(pages[0])]
        for p in pages[1:]:
            wrapper = wrappers.align(wrapper, [(t, False) for t in wrappers.fold_repeats(p)])
        matcher = wrappers.Matcher(wrappers.unpacked(wrappers.packed(wrapper)))
        leaves = [c[0] for c in matcher.code if c[0] is not None]
        for p in pages:
            assert [leaves[k] for k in matcher.places(p)] == p
