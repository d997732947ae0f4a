import random
import time

import pytest

from mnemospark.llm import html_text as H


def texts(page):
    blocks, declared = H.blocks_of(page)
    return [t for t, _ in blocks], declared


def test_blocks():
    assert texts("<article><header>h</header><p>x 1<br>2</p><aside>s</aside><section class='comments'><article><p>c</p></article></section><p>end</article><footer>f") == (["x 1 2", "end"], True)
    assert texts('<body><div role="navigation">a</div><p>x &lt; y<p>z &amp; <b>q</b><div class="ad">k</div><script>if(a<b){"</p>"}</script> tail') == (["x < y", "z & q", "tail"], False)
    assert texts("<main><h1>T</h1><div class='content no-sidebar'>a\n b</div><form>f</form><div id=x hidden>n</div></main>") == (["T", "a b"], True)
    assert texts("") == ([], False)
    assert texts("a < b and <b>c</b") == (["a < b and c"], False)
    assert texts("<article><p title='a>b'>x<!-- <p>no --></p><style>p{}</style>") == (["x"], True)
    assert H.blocks_of("<div id=top><article id=a7><p>x<div class='Box b2'><p>y</div><ul class=l><li>z</ul>") == ([("x", ""), ("y", "/div.b.box"), ("z", "/ul.l")], True)


def test_ordinary_names_are_no_boilerplate():
    page = "<article class='search-page'><p>a</p><section class='discussion'><p>b</p></section><div class='search-results'>c</div><div class='alert notice'>d</div><div id='hidden-gem'>e</div><div class='related-work widget-theory'>f</div></article>"
    assert texts(page) == (["a", "b", "c", "d", "e", "f"], True)


def brute(pages, least, most):
    words = [[b.split(" ") for b in p] for p in pages]
    grams = {}
    for i, p in enumerate(words):
        for b in p:
            for n in range(least, len(b) + 1):
                for k in range(len(b) - n + 1):
                    grams.setdefault(tuple(b[k : k + n]), set()).add(i)
    out = []
    for p in words:
        kept = []
        for b in p:
            cover = [False] * len(b)
            for n in range(least, len(b) + 1):
                for k in range(len(b) - n + 1):
                    if len(grams[tuple(b[k : k + n])]) >= most:
                        cover[k : k + n] = [True] * n
            if rest := [w for w, c in zip(b, cover) if not c]:
                kept.append(" ".join(rest))
        out.append(kept)
    return out


def test_unique_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(200):
        pages = [[" ".join(r.choices("abc", k=r.randint(1, 12))) for _ in range(r.randint(0, 3))] for _ in range(5)]
        for most in (2, 3):
            words = [[b.split(" ") for b in p] for p in pages]
            on, at, got = H.covered(H.shared_runs(words, list(range(5)), 3, most)), 0, []
            for p in words:
                kept = []
                for b in p:
                    if rest := [w for w, c in zip(b, on[at : at + len(b)]) if not c]:
                        kept.append(" ".join(rest))
                    at += len(b) + 1
                got.append(kept)
            assert got == brute(pages, 3, most)


def test_pages_without_an_article_lose_shared_runs(spark):
    shared = "all rights of this site belong to us forever"
    rows = [(i, f"http://u@H.example:80/{i}", f"<p>{shared}<p>own text {i} &amp; more") for i in range(5)] + [(9, None, None), (10, "x", "<article>a"), (4, "http://h.example/4", f"<p>{shared}<p>own text 4 &amp; more")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text) for r in H.main_text(df).collect())
    assert got == [(0, "own text 0 & more"), (1, "own text 1 & more"), (2, "own text 2 & more"), (3, "own text 3 & more"), (4, "own text 4 & more"), (4, "own text 4 & more"), (9, ""), (10, "a")]
    assert H.main_text(df.limit(0)).count() == 0


def test_runs_are_counted_over_the_whole_of_a_large_host(spark):
    """Parts of a host that hold a run on too few pages of their own lose it as well."""
    r = random.Random(5)
    pages = [[" ".join(r.choices("abc", k=r.randint(1, 14))) for _ in range(r.randint(0, 3))] for _ in range(60)]
    rows = [(i, f"http://h.example/{i}", "".join(f"<p>{b}</p>" for b in p)) for i, p in enumerate(pages)]
    rows += [(100 + i, "http://small.example/", f"<p>one two three four five six {i}") for i in range(3)] + [rows[7]]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_per_group=4)
    want = ["\n".join(p) for p in brute(pages, H.MIN_TOKENS, H.MIN_PAGES)]
    assert any("\n".join(p) != w for p, w in zip(pages, want))
    assert sorted((x.page_id, x.text) for x in got.collect()) == sorted([*enumerate(want), (7, want[7]), (100, "0"), (101, "1"), (102, "2")])


def page_with_parts(i, extra=""):
    """An article of 40 words with a part that repeats, one that is its own, and a quotation that others have too."""
    r = random.Random(i)
    body = " ".join(r.choices("abcdefgh", k=40)) + f" {i}"
    quote = "to be or not to be that is the question" if i % 2 else f"nobody ever said quite this before {i}"
    box = ["subscribe to our letter of the week", "Share", "subscribe to our letter of the month"][i % 3]
    html = f"<nav>menu</nav><article><h1>T {i}</h1><p>{body}</p><section class='discussion'><p>own words {body[::-1]}</p></section><div class='box-{i}'><p>{box}</p></div><blockquote class='q'>{quote} and {body[:19]}</blockquote>{extra}</article><footer>f</footer>"
    want = f"T {i}\n{body}\nown words {body[::-1]}\n{quote} and {body[:19]}"
    return html, want


def test_parts_of_articles_are_judged_by_their_repeats(spark):
    rows, want = [], {}
    for i in range(12):
        html, want[i] = page_with_parts(i)
        rows.append((i, f"http://h.example/{i}", html))
    rows += [(100 + k, "http://h.example/copy", rows[4][2]) for k in range(20)]  # copies of one article change nothing
    want |= {100 + k: want[4] for k in range(20)}
    rows += [(200 + i, f"http://two.example/{i}", page_with_parts(i)[0]) for i in (3, 6)]  # a host of two pages shows nothing
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (H.PAGES_PER_GROUP, 5):  # a host as a whole and in parts
        got = {r.page_id: r.text for r in H.main_text(df, size).collect()}
        assert {i: t for i, t in got.items() if i < 200} == want
        assert "subscribe" in got[203] and "subscribe" in got[206]


def test_parts_of_a_host_of_6000_pages_agree_with_one_group(spark):
    shared = "every page of this site may carry a line"
    rows = [(i, f"http://big.example/{i}", f"<p>own {i} text</p>" + (f"<p>{shared}</p>" if i in (5, 1700, 3500, 5999) else "") + ("<p>two pages only have this long line" if i in (7, 8) else "")) for i in range(6000)]
    rows += [(None, "http://big.example/", f"<p>nobody knows {k}") for k in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    one, many = (sorted(((-1 if r.page_id is None else r.page_id, r.text) for r in H.main_text(df, size).collect())) for size in (10_000, 1500))
    assert one == many
    assert all(shared not in t for _, t in one) and sum("two pages" in t for _, t in one) == 2 and [t for i, t in one if i == -1] == ["nobody knows 0", "nobody knows 1"]


def plain(page):
    """The text of a page of the given tables, by another parser: the blocks of its article."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks, self.now = False, [], ""

        def flush(self):
            if t := " ".join(self.now.split()):
                self.blocks.append(t)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("article", "p", "h1"):
                self.flush()
            self.inside |= tag == "article"
            if tag == "br":
                self.now += " "

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1"):
                self.flush()
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.now += data

    p = P()
    p.feed(page or "")
    p.close()
    p.flush()
    return "\n".join(p.blocks)


def test_given_pages_equal_another_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text) for r in H.main_text(pages).collect()} == want


HOSTILE = {
    "declarations": "<!" * 500_000,
    "end tags": "<div>" * 100_000 + "</li>" * 100_000,
    "attributes": "<div " + 'class="a b" id=c ' * 60_000 + ">x",
    "open quotes": '<div a="' * 130_000,
    "open quotes, one end": '<div a="' * 130_001 + ">x",
    "starts": "<div" * 250_000,
    "raw starts": "<script" * 150_000,
    "raw ends": "<script>" + "</script " * 110_000,
    "nested": "".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k % 23)}'>x" for k in range(45_000)),
    "comments": "<!--" * 250_000,
    "references": "&amp" * 250_000,
    "spaces": "<p class" + " " * 500_000 + "<p role" + " " * 500_000 + ">x",
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_pages_take_seconds_at_most(kind):
    """A page of about 1 MB; each was quadratic in some earlier version, or might be."""
    begun = time.process_time()
    H.blocks_of(HOSTILE[kind])
    assert time.process_time() - begun < 5


def test_end_tags_close_what_is_open():
    assert texts("<body><div><p>a</section></div><nav>n<div>m</nav>b</div>c") == (["a", "b", "c"], False)
    assert texts("<article><p>x</article></article></main><footer>f</footer>y") == (["x"], True)
    deep = "<article>" + "".join(f"<div class=k{chr(97 + k % 26)}>" for k in range(300)) + "x"
    (_, path), = H.blocks_of(deep)[0]
    assert 0 < len(path) <= H.LONGEST_PATH
