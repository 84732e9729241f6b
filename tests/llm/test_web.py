"""Main text of pages, and WARC archives with damage."""

import base64
import hashlib
import io
import re
from html import unescape

import pytest

from nameshift.llm import dom, html_text, queries, warc

PAGES = "page_id long, url string, html string"


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"<(?:/?p|/?h1|br)>", inner))
    return "\n".join(line for line in lines if line)


def test_every_page_gives_its_article(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.QUERIES["op6_html_text"](spark, folder).collect()
    assert {r.page_id: r.text for r in got} == {k: article(h) for k, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_lines_of_held_out_labelled_pages():
    model, right, lines = html_text.trained(), 0, 0
    for page in html_text.labelled_pages(150, seed=99):
        tree = dom.parse(page, labelled=True)
        states, content = html_text.inherited(tree), model.marginals(tree)
        for node, _ in tree.lines:
            lines += 1
            right += (content[node] > 0.5) == (states[node] == html_text.CONTENT_STATE)
    assert right / lines > 0.95


def test_marginals_equal_enumeration():
    """Sum-product against the sum over all labellings of a small tree."""
    import itertools
    import math

    model = html_text.trained()
    tree = dom.parse("<body><nav><a href=x>m</a></nav><div><p>some text here</p></div></body>")
    names = html_text.node_features(tree)
    likely = []
    for tag, own in zip(tree.tags, names, strict=True):
        sums = [0.0] * 3
        for f in own:
            row = model.features.get(("*", f) if f.startswith("name ") else (tag, f)) or model.features.get(("*", f), (0.0,) * 3)
            sums = [a + (html_text.TEXT_WEIGHT if f.startswith("text ") else 1.0) * b for a, b in zip(sums, row, strict=True)]
        likely.append([math.exp(x) for x in sums])
    weight = {}
    for states in itertools.product(html_text.STATES, repeat=len(tree.tags)):
        w = model.root[states[0]]
        for i, s in enumerate(states):
            w *= likely[i][s] * (model.edges.get(tree.tags[i], model.any_edge)[states[tree.parents[i]]][s] if i else 1)
        weight[states] = w
    total = sum(weight.values())
    want = [sum(w for s, w in weight.items() if s[i] == html_text.CONTENT_STATE) / total for i in range(len(tree.tags))]
    assert model.marginals(tree) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<article>", ""),
        ("plain text only", "plain text only"),
        ("<p>just a&nbsp;paragraph &amp &lt;b&gt;", "just a paragraph & <b>"),
        ("<main><p>a</p><div class='advert'><p>buy</p></div><table><tr><td>1<td>2</table></main><div id=disqus_thread><p>no way</p></div>", "a\n1\n2"),
        ("<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>Hello <b>w</b>orld<script>if (a<b) '</p>'</script></p><!-- <p>no</p> --><form><p>Mail</p><input></form></article><footer>c</footer>", "T\nHello world"),
        ("<article><p>one<p>two<ul><li>x<li>y</ul><textarea>z</textarea></article><section class='comments'><article class='comment'><p>I liked this very much</p></article></section>", "one\ntwo\nx\ny"),
        ("<article><p>open <b>tag <p>next < line</article>", "open tag\nnext < line"),
    ],
)
def test_markup(page, want):
    assert html_text.trained().text(page) == want


SENTENCE = "This is a sentence of the article, and it goes on for a while. "
FIVE = "".join(f"<p>{SENTENCE * 3}{i}</p>" for i in range(5))
FIVE_LINES = "\n".join(f"{SENTENCE * 3}{i}" for i in range(5))


@pytest.mark.parametrize(
    "page, want",
    [
        # markup that no list of names holds: wrappers that say nothing, layout by tables
        (f'<div id="app"><div class="css-1x"><div>{FIVE}</div></div></div>', FIVE_LINES),
        (f'<body><nav><a href=x>Home</a> <a href=y>News</a></nav><div id="root"><div class="sc-bdVaJa"><div>{FIVE}</div></div></div><footer>c 2020</footer></body>', FIVE_LINES),
        (f"<body>{'<div>' * 12}{FIVE}{'</div>' * 12}</body>", FIVE_LINES),
        (f"<body><table width=100%><tr><td><a href=a>Home</a><br><a href=b>Shop</a></td><td><h1>Title here</h1>{FIVE}</td></tr></table></body>", "Title here\n" + FIVE_LINES),
        # nothing but what is listed is left out, and a line is not cut by what runs inside it
        ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p></article>", "Energy is E=m here."),
        ("<article><p>See <object data=x>the <b>other</b> text</object> here.</p><p hidden>Hidden words stay.</p></article>", "See the other text here.\nHidden words stay."),
        ("<article><p>A <svg viewBox=x><text>label</text><path d=x /></svg> and <video>no <a href=x>video</a></video>.</p><xmp>a <b> & c</xmp></article>", "A label and no video.\na <b> & c"),
        # the training mark is data of the page elsewhere
        ('<article><table><tr><td data-label="Price">12 euros</td><td data-label="0">Box</td></tr></table><p>Text of it.</p></article>', "12 euros\nBox\nText of it."),
    ],
)
def test_markup_from_elsewhere(page, want):
    assert html_text.trained().text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep" + "</div>" * 20_000, "<b>" + "<table><tr><td>" * 7000 + "deep" + "</b>" * 20_000, "<p>" + "<b>" * 20_000 + "deep" + "<li>" * 20_000])
def test_deep_pages_take_time_in_proportion(page):
    from time import process_time

    start = process_time()
    dom.parse(page)
    assert process_time() - start < 1.5


def test_text_of_awkward_pages(spark):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (2, "u", ""), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>"), (4, "u", "<article>" + "<p>word</p>" * 20_000 + "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, PAGES)
    wide = pages.selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS c0")
    got = html_text.main_text(wide).collect()
    assert sorted(str((r.page_id, r.text)) for r in got if r.page_id != 4) == sorted(["(1, '')", "(None, 'x')", "(2, '')", "(3, 'x')", "(3, 'x')"])
    assert next(r for r in got if r.page_id == 4).text.startswith("word\n" * 19_999 + "word")
    assert html_text.main_text(pages.limit(0)).count() == 0


def expected(rows, least=0):
    first, out = {}, []
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None:
            first[raw] = min(first.get(raw, page), page)
    for page, url, html in rows:
        raw = (html or "").encode()
        revisit = page is not None and len(raw) >= least and page > first[raw]
        out.append(str((page, url, "revisit" if revisit else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), first[raw] if revisit else None)))
    return sorted(out)


ODD = [(10**6, "u 1\r\n%41", "dup"), (10**6 + 1, None, "dup"), (10**6 + 2, "x", None), (10**6 + 3, "x", ""), (None, "n", "dup"), (10**7, "é", "é\x00ü"), (10**6, "u 1\r\n%41", "dup")]


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("least", [0, 3, 4])
def test_archives_round_trip(spark, folder, compressed, least):
    pages = spark.read.parquet(f"{folder}/pages.parquet").unionByName(spark.createDataFrame(ODD, PAGES))
    rows = [tuple(r) for r in pages.collect()]
    made = warc.write_archives(pages.selectExpr("*", "1 AS n", "2 AS first", "3 AS refers"), least=least, compressed=compressed)
    found = warc.read_archives(made.files)
    got = warc.records(found).collect()
    assert sorted(str((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to)) for r in got) == expected(rows, least)
    bodies = {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert bodies <= {(p, (h or "").encode()) for p, _, h in rows}
    assert warc.gaps(found).count() == 0


def test_no_pages_no_archives(spark):
    made = warc.write_archives(spark.createDataFrame([], PAGES))
    assert made.files.count() == 0 and warc.read_archives(made.files).count() == 0


def numbers(items):
    return [int(x[0]["warc-record-id"][10:-1]) for x in items if not isinstance(x, warc.Gap)]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_what_is_not_damaged(compressed):
    made = [warc.record(i, "u", (f"payload {i} " * 50).encode(), None) for i in range(30)]
    parts = [warc.member(x) if compressed else x for x in made]
    starts = [sum(map(len, parts[:i])) for i in range(31)]
    data = bytearray(b"".join(parts))
    data[starts[10] + len(parts[10]) // 2] ^= 0xFF
    data[starts[25] : starts[25] + 3] = b"???"
    del data[starts[20] + 8 : starts[20] + 60]
    data = bytes(data[: len(data) - len(parts[29]) // 2])
    items = list(warc.read_archive(io.BytesIO(b"junk" + data)))
    assert numbers(items) == [i for i in range(30) if i not in (10, 20, 25, 29)]
    gaps = [x for x in items if isinstance(x, warc.Gap)]
    assert gaps[0] == warc.Gap(0, 4, gaps[0].reason) and len(gaps) == 5
    assert all(g.start < g.end for g in gaps) and gaps[-1].end == len(data) + 4


def test_salvage_across_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    made = [warc.record(i, "u", b"WARC/1. and \x1f\x8b inside" * 9, None) for i in range(5)]
    plain = b"".join(made[:2]) + b"\x1f\x8b\x08 no member WARC/1.9" + b"".join(made[2:])
    assert numbers(warc.read_archive(io.BytesIO(plain))) == [0, 1, 2, 3, 4]
    zipped = b"".join(map(warc.member, made[:2])) + b"WARC/1. \x1f\x8b" + b"".join(map(warc.member, made[2:]))
    assert numbers(warc.read_archive(io.BytesIO(zipped))) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("chunk", [5, 32 << 10, 1 << 20])
def test_headers_of_any_length(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    made = [warc.record(i, "u" * (70_000 if i == 1 else 9), b"payload", None) for i in range(3)]
    stream = io.BytesIO(b"".join(made))
    assert numbers(warc.read_archive(stream)) == [0, 1, 2]


def test_a_header_without_end_costs_itself_only():
    made = [warc.record(i, "u", b"payload", None) for i in range(3)]
    cut = made[1].index(b"\r\n\r\n")
    items = list(warc.read_archive(io.BytesIO(made[0] + made[1][: cut // 2] + b"\r\n" + made[2])))
    assert numbers(items) == [0, 2] and sum(isinstance(x, warc.Gap) for x in items) == 1


def test_a_damaged_length_does_not_pull_in_the_rest(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1 << 16)
    made = [warc.record(i, "u", b"x" * 5000, None) for i in range(2000)]
    made[3] = made[3].replace(b"Content-Length: 5000", b"Content-Length: 500000000")
    peak, more = [0], warc.Window.more
    monkeypatch.setattr(warc.Window, "more", lambda self: (peak.append(len(self.data)), more(self))[1])
    items = list(warc.read_archive(io.BytesIO(b"".join(made))))
    assert numbers(items) == [i for i in range(2000) if i != 3]
    assert max(peak) < 1 << 20


def test_a_payload_may_hold_records():
    inner = b"".join(warc.record(i, "u", b"in" * 99, None) for i in range(9))
    data = warc.record(100, "u", inner, None) + warc.record(101, "u", b"x", None)
    assert numbers(warc.read_archive(io.BytesIO(data))) == [100, 101]


def test_damaged_files_in_a_frame(spark, tmp_path):
    made = b"".join(warc.member(warc.record(i, None, b"x" * i, None)) for i in range(9))
    (tmp_path / "a.warc.gz").write_bytes(made[:200] + made[230:])
    found = warc.read_archives(warc.archive_files(spark, [f"file://{tmp_path}/a.warc.gz"]))
    assert warc.gaps(found).count() == 1 and 6 <= warc.records(found).count() < 9
    assert all(r.url is None for r in warc.records(found).collect())
