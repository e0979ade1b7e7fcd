"""Archives and page extraction."""

import hashlib
import html
import random
import re
from itertools import product

import pytest

from vellum.llm import html_extract, warc
from vellum.llm.queries import QUERIES


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, None, None), (2, "http://a/ b", "ab"), (3, "u", "ab"), (4, None, big), (9, "u", big), (9, "u", big), (5, "u", big), (None, "u", big), (None, None, "z" * 1500), (7, "u\r\nX: y", "<p>" + "long " * 100_000)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, sha1 string, size int"), rows


def expected(rows):
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h] = max(best.get(h, p), p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        keeper = best.get(h)
        revisit = len(data) >= 1000 and keeper is not None and p != keeper
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def test_warc_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op1_warc"](spark, sf).collect()), key=str) == expected(pages)


def test_warc_edge(spark, odd_pages, tmp_path):
    df, rows = odd_pages
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_archives(df.coalesce(1), path, file_records=3)
    read = warc.read_archives(spark, path)
    assert read.where("kind = 'gap'").count() == 0 and read.select("file").distinct().count() > 2
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in read.where("kind = 'response' AND page_id IS NOT NULL").collect()) == sorted((p, h or "") for p, _, h in rows if p in (1, 2, 3, 7, 9))


def archive(n=6):
    return [warc.record(k, f"http://a/{k}", b"payload %d " % k * 40) for k in range(n)]


def ids(found):
    return [int(x[2]["x-page-id"]) for x in found if x[0] == "record"]


def gaps(found):
    return [(x[1], x[2]) for x in found if x[0] == "gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.member(x) for x in archive()] if packed else archive()
    good = list(warc.salvage(b"".join(parts)))
    assert ids(good) == list(range(6)) and not gaps(good)
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0x55
    found = list(warc.salvage(b"".join([*parts[:2], bytes(bad), b"noise", *parts[3:]])))
    assert ids(found) == [0, 1, 3, 4, 5] and gaps(found) == [(len(parts[0] + parts[1]), len(parts[2]) + 5)]
    found = list(warc.salvage(b"".join(parts)[: -len(parts[5]) // 2]))
    assert ids(found) == list(range(5)) and len(gaps(found)) == 1
    found = list(warc.salvage(b"junk" * 10 + b"".join(parts)))
    assert ids(found) == list(range(6)) and gaps(found) == [(0, 40)]
    assert list(warc.salvage(b"")) == [] and gaps(list(warc.salvage(b"nothing here"))) == [(0, 12)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_random_damage(packed):
    """Untouched records are read, and records and gaps cover all bytes without overlap."""
    rng = random.Random(8)
    parts = [warc.member(x) for x in archive(12)] if packed else archive(12)
    for _ in range(60):
        hurt = set(rng.sample(range(12), rng.randint(1, 5)))
        pieces = []
        for k, x in enumerate(parts):
            if k in hurt:
                at = rng.randrange(len(x))
                x = rng.choice([x[:at], x[:at] + bytes([x[at] ^ 1]) + x[at + 1 :], bytes(len(x)), x[:at] + x[min(len(x), at + 9) :]])
            pieces.append(x)
        found = list(warc.salvage(b"".join(pieces)))
        assert set(range(12)) - hurt <= set(ids(found))
        assert all(a + n <= b for (a, n), (b, _) in zip(gaps(found), gaps(found)[1:], strict=False))


def test_damage_inside_a_member():
    a, b, c = archive(3)
    found = list(warc.salvage(warc.member(a + b[:-40] + c) + warc.member(b)))
    assert ids(found) == [0, 2, 1] and len(gaps(found)) == 1


def test_mixed_archive():
    """Members and plain records in one file, with a damaged member between."""
    parts = archive(5)
    packed = [warc.member(x) for x in parts]
    found = list(warc.salvage(packed[0] + packed[1][:-30] + parts[2] + parts[3] + packed[4]))
    assert ids(found) == [0, 2, 3, 4] and gaps(found) == [(len(packed[0]), len(packed[1]) - 30)]
    found = list(warc.salvage(parts[0] + b"noise" + packed[1] + parts[2][:40] + packed[3]))
    assert ids(found) == [0, 1, 3] and len(gaps(found)) == 2


def test_wrong_checksum():
    """Records whose own digest holds outlive their member's checksum; others do not."""
    a, b, _ = archive(3)
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 7\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    packed = bytearray(warc.member(a + bare + b))
    packed[-6] ^= 1
    found = list(warc.salvage(bytes(packed) + warc.member(bare)))
    assert ids(found) == [0, 1, 7] and gaps(found) == [(0, len(packed))]


def test_foreign_fields(spark, tmp_path):
    """Digests and numbers of other makers are read where they can be, and never stop the job."""
    block, out = b"HTTP/1.1 200 OK\r\n\r\nxyz", []
    for k, (named, kind, number) in enumerate([("sha1:" + hashlib.sha1(block).hexdigest(), "response", "z"), ("md5:" + hashlib.md5(block).hexdigest(), "revisit", "12"), ("blake3:abc", "revisit", ""), ("sha256:!!", "resource", "9" * 40), ("sha1:" + "0" * 40, "response", "5")]):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nX-Page-ID: {number}\r\nWARC-Block-Digest: {named}\r\nWARC-Payload-Digest: {named}\r\nX-Refers-To-Page-ID: q\r\nContent-Length: {len(block)}\r\n\r\n"
        record = head.encode() + block + b"\r\n\r\n"
        out.append(warc.member(record) if k % 2 else record)
    (tmp_path / "a.warc").write_bytes(b"".join(out))
    rows = warc.read_archives(spark, f"file://{tmp_path}").orderBy("place").collect()
    assert [(r.kind, r.page_id, r.refers_to) for r in rows] == [("response", None, None), ("revisit", 12, None), ("revisit", None, None), ("resource", None, None), ("gap", None, None)]
    assert rows[1].payload_digest is None and rows[0].payload_digest == hashlib.sha1(b"xyz").hexdigest() and rows[4].reason == "wrong block digest"


def test_extraction_query(spark, sf):
    got = {r.page_id: r for r in QUERIES["op5_html_extract"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?p>|</?h1>", article))
        assert got[p.page_id].text == "\n".join(x for x in blocks if x) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_extraction_of_marked_pages():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><header><a href=/>Home</a> My site</header><div id="cookieNotice">We use cookies. OK?</div><nav><ul><li><a>One</a></ul></nav>
    <main><article><header><h1>Title here</h1></header><p>First para of &lt;text&gt; that is long enough to be an article,&nbsp;surely.<p>Second <a href=x>link</a>
    para.<div class="ad">Buy now! It is good.</div><ul><li>Item one<li>Item two</ul><table><tr><td>a</td><td>b</td></tr></table><aside>Side note here.</aside><pre>code
      x</pre></article><section id="comments"><h2>Comments</h2><article class="comment"><p>Great post, thanks! I like this a lot, really very much so.</p></article></section>
    <form><label>Name</label><button>Send</button></form></main><footer>&copy; 2020 Foo. All rights reserved.</footer><script>if (a<b) {}</script><p style="display:none">hidden</p></body></html>"""
    assert html_extract.main_text(page) == "Title here\nFirst para of <text> that is long enough to be an article, surely.\nSecond link para.\nItem one\nItem two\na\nb\ncode x"


def test_extraction_of_plain_pages():
    long_ = "A paragraph of text without any markup that tells its kind. It has sentences, and more of them."
    page = f"<div><div>Menu</div><div><p>{long_}</p><p>Short one.</p><p>{long_}</p></div><div><a>About</a> <a>Contact</a></div></div>"
    assert html_extract.main_text(page) == f"{long_}\nShort one.\n{long_}"
    assert html_extract.main_text(f"<article><p>{long_}<!-- no end") == long_ and html_extract.main_text(f"<article>{long_}<p cla") == long_
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""


PARAGRAPH = "A paragraph of text without any markup that tells its kind, number {}. It has sentences, and it has a good number of words in each of them."


def test_extraction_is_not_dropped_by_words():
    paragraphs = [PARAGRAPH.format(k) for k in range(6)]
    inner = "".join(f"<p>{x}</p>" for x in paragraphs)
    menu = "<div><a href=a>One</a> <a href=b>Two</a></div>"
    for words in ("popup-book print tags", "sidebar", "menu reply", "toc"):
        assert html_extract.main_text(f'{menu}<div class="{words}">{inner}</div>') == "\n".join(paragraphs)
    article = f'<article><p>{paragraphs[0]}</p><div class="toc">{inner}</div><div class="toc"><a href=a>Part one</a></div></article>'
    assert html_extract.main_text(menu + article) == "\n".join([paragraphs[0], *paragraphs])
    assert html_extract.main_text(f'<div class="ad">Buy this now. It is good.</div><div>{inner}</div>') == "\n".join(paragraphs)


def unmarked(rng):
    """Blocks (text, tag, whether content) of a page whose elements tell nothing: menu, column of text, end lines."""
    word = lambda n: " ".join(rng.choice(["tor", "elan", "mira", "sol", "udo", "brin", "kesta"]) + str(rng.randint(0, 999)) for _ in range(n))
    menu = [(word(rng.randint(1, 3)), "li", False) for _ in range(rng.randint(3, 8))]
    body = [(word(5), "h1", True)]
    for _ in range(rng.randint(5, 12)):
        # captions and headings of a few words without a full stop stand between paragraphs
        body.append((word(rng.randint(1, 4)), "div", True) if rng.random() < 0.3 else (word(rng.randint(20, 60)) + ".", "p", True))
    body.append((word(30) + ".", "p", True))
    ends = [(word(rng.randint(1, 4)), "div", False) for _ in range(rng.randint(3, 5))]
    ends.insert(2, (word(8) + ".", "div", False))
    return [menu, body, ends]


def test_the_cut_decides():
    """On pages that tell nothing the cut changes labels, and for the better."""
    rng, alone, cut, changed, n = random.Random(10), 0, 0, 0, 0
    for _ in range(200):
        parts = unmarked(rng)
        page = "".join(f"<div>{''.join(f'<{t}>{x}</{t}>' for x, t, _ in part)}</div>" for part in parts)
        found = html_extract.blocks(page)
        truth = [good for part in parts for _, _, good in part]
        assert [b.text for b in found] == [x for part in parts for x, _, _ in part]
        sign, made = [z > 0 for z in html_extract.log_odds(found)], html_extract.labels(found)
        n += len(truth)
        alone += sum(map(bool.__eq__, sign, truth))
        cut += sum(map(bool.__eq__, made, truth))
        changed += sum(map(bool.__ne__, sign, made))
    assert changed > 0.08 * n and cut > 0.98 * n > 0.9 * n > alone


def test_extraction_edge(odd_pages):
    df, rows = odd_pages
    got = html_extract.extracted(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == sorted((str(p), str(u), html_extract.main_text(h)) for p, u, h in rows)
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_minimum_cut():
    """Against all labellings."""
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(1, 7)
        source, sink = ([rng.choice([0, rng.randint(0, 9)]) for _ in range(n)] for _ in "ab")
        links = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda keep: sum(sink[k] if keep[k] else source[k] for k in range(n)) + sum(w for a, b, w in links if keep[a] != keep[b])  # noqa: B023, E731
        assert cost(html_extract.minimum_cut(source, sink, links)) == min(map(cost, product([False, True], repeat=n)))
