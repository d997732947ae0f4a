"""Main text of web pages: structure first, then a suffix array over each host's pages.

A page's markup is cut into blocks. Elements that are no article text by the
standard (menus, headers, footers, asides, forms, dialogs, raw elements, what is
hidden or has such a role), and adverts and reader comments, never count. What
else is boilerplate is decided by evidence, from all pages of a host:

- A page that declares its article (``<article>`` or ``<main>``) has the blocks
  of it as its text. Parts of the article with a class or id of their own
  (newsletter boxes, share bars) are suspects: the blocks of one structural path
  on all pages of the host are boilerplate when most of their tokens are covered
  by runs, or are whole blocks, that occur there on MIN_PAGES pages with
  different articles. The path that holds most of the article's tokens, and what
  is in the article outside of such parts, is never a suspect.
- On other pages every block is a suspect. Runs that cover tokens on MIN_PAGES
  distinct pages are removed, and the unique runs are kept.

For both, the token streams of the suspects of all pages of a host are
concatenated, and a suffix array finds the long token strings that occur on
distinct pages. Repeats are not removed from the articles themselves: copies of
one article, or a sentence that many articles quote, are repeats as well, but no
boilerplate.

Edge cases: null and empty html give the empty text; a url without a host puts
the page into the group of host ""; unclosed and misnested elements, truncated
pages and bare ``<`` are parsed as they come; repeated pages (same page_id) are
one page to the suffix array, and each gets its row; rows
with a null page_id are pages by their content; an empty table gives no rows; other columns are ignored; pages of any
length are read whole.

A host of more than PAGES_PER_GROUP pages with suspects is read in parts of
about that many, by a hash of page_id, and its runs are counted over the whole
host: a token is covered by a shared run just when a shared run of MIN_TOKENS
tokens covers it, so each part gives its windows of MIN_TOKENS tokens once, as
128-bit hashes with their number of pages, the numbers are added up over the
parts, and the parts get back those of their windows that reach MIN_PAGES.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import mix, owner, pieces, staged
from mnemospark.llm._suffix import SuffixArray, intervals, left_diverse

#: Tokens of a boilerplate run, pages that must share it, and pages of a host that one task reads.
MIN_TOKENS, MIN_PAGES, PAGES_PER_GROUP = 6, 3, 2000

#: A longer path of containers is known by its hash, so that deep nesting doesn't grow with its square.
LONGEST_PATH = 400

#: Names of elements, and words of class, id and role attributes.
RAW = ["script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "object", "xmp", "noembed", "noframes"]
SKIPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "search"}
MAIN = {"article", "main"}
CONTAINERS = {"html", "body", "div", "section", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dd", "dt", "figure", "figcaption", "details", "summary", "blockquote", "center", "address", "hgroup", "optgroup"}
BLOCKS = CONTAINERS | SKIPPED | MAIN | {"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "caption", "legend", "option", "dir", "frame", "frameset"}
#: Roles of the standard that are no article text.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
#: Whole classes and ids of what repeats can't show, as it differs from page to page: adverts and reader comments.
NAMES = {"ad", "ads", "advert", "advertisement", "sponsored", "comment", "comments", "comment-list", "commentlist", "comments-area", "respond", "disqus_thread"}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true)", re.I)


def named(attributes: str) -> tuple[bool, bool, str]:
    """(whether these attributes make an element no article text, whether they declare one, its classes and id without their numbers)."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False, False, ""
    names, role = [], ""
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower().split()
        if m[1].lower() == "role":
            role = value[0] if value else ""
        else:
            names += value
    skipped = role in ROLES or not NAMES.isdisjoint(names) or bool(_HIDDEN.search(attributes))
    return skipped, role == "main", ".".join(sorted({x for n in names if (x := re.sub(r"\d+", "", n))}))


def blocks_of(page: str) -> tuple[list[tuple[str, str]], bool]:
    """(blocks in page order, whether they come from a declared article).

    A block is its text and the path of the named containers around it, inside
    the article if there is one.
    """
    inside: list[tuple[str, str]] = []
    outside: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool, str]] = []  # open containers: name, skipped, in an article, path
    opened: dict[str, int] = {}  # how many of each name are on the stack
    skipped = main = declared = False
    path = ""
    parts: list[str] = []
    at = 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                (inside if main else outside).append((text, path))

    for m in _TOKEN.finditer(page):
        if not skipped and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name == "br" and not skipped:
                parts.append(" ")
            continue
        close()
        if name not in CONTAINERS and name not in SKIPPED and name not in MAIN:
            continue
        if m[2]:
            closed = not opened.get(name)  # an end tag without its beginning closes nothing
            while not closed:
                gone = stack.pop()[0]
                opened[gone] -= 1
                closed = gone == name
            skipped, main, path = stack[-1][1:] if stack else (False, False, "")
        elif not (attributes := m[4] or "").rstrip().endswith("/"):
            no_text, is_main, own = named(attributes) if attributes and name not in ("html", "body") else (False, False, "")
            skipped = skipped or name in SKIPPED or no_text
            if not main and (name in MAIN or is_main):
                main, path = True, ""
            elif own:
                path = f"{path}/{name}.{own}"
                if len(path) > LONGEST_PATH:
                    path = hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            declared = declared or (main and not skipped)
            stack.append((name, skipped, main, path))
            opened[name] = opened.get(name, 0) + 1
    if not skipped and at < len(page):
        parts.append(page[at:])
    close()
    return (inside, True) if declared else (outside, False)


Words = list[list[list[str]]]


def shared_runs(words: Words, owner: list[int], min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES) -> np.ndarray:
    """How many tokens a shared run covers from each place on, with one place more a block.

    words: blocks of each page; owner: what counts as the same page. The token
    streams (no run crosses a block) are concatenated and suffix-sorted; maximal
    repeats of min_tokens tokens and more come from the LCP intervals with
    different tokens on the left.
    """
    flat = [w for p in words for b in p for w in [*b, None]]
    reach = np.zeros(len(flat), np.int64)
    if not flat:
        return reach
    number: dict[str, int] = {}
    stop = -1
    values = np.empty(len(flat), np.int64)
    for i, w in enumerate(flat):
        if w is None:
            values[i] = stop  # every end of a block differs from all others
            stop -= 1
        else:
            values[i] = number.setdefault(w, len(number))
    page = np.repeat(np.array(owner, np.int64), [sum(len(b) + 1 for b in p) for p in words])
    array = SuffixArray(values, len(values))
    for left, right, length in intervals(array.lcp(), min_tokens):
        where = array.order[left : right + 1]
        before = np.where(where > 0, values[where - 1], -1)
        if left_diverse(before) and len(np.unique(page[where])) >= min_pages:
            reach[where] = np.maximum(reach[where], length)
    return reach


def covered(reach: np.ndarray) -> np.ndarray:
    """Whether a run covers each place."""
    edge = np.zeros(len(reach) + 1, np.int64)
    hit = np.flatnonzero(reach)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + reach[hit], -1)
    return np.cumsum(edge)[:-1] > 0


#: A window's hash, as it is sorted and compared.
_WINDOW = np.dtype([("h1", np.int64), ("h2", np.int64)])


def windows(words: Words, length: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(places in the concatenated blocks, one place more a block; 128-bit hashes) of all windows of ``length`` tokens within blocks."""
    hashes: dict[str, bytes] = {}
    ends = b"\0" * 16
    flat = []
    for p in words:
        for b in p:
            for w in b:
                if (h := hashes.get(w)) is None:
                    h = hashes[w] = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                flat.append(h)
            flat.append(ends)
    value = np.frombuffer(b"".join(flat), np.uint64).reshape(-1, 2)
    sizes = np.array([len(b) for p in words for b in p], np.int64)
    count = np.maximum(sizes - length + 1, 0)
    begin = np.cumsum(sizes + 1) - sizes - 1
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    out = np.empty(len(place), _WINDOW)
    for i, name in enumerate(("h1", "h2")):
        h = np.zeros(len(place), np.uint64)
        for k in range(length):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + value[place + k, i] + np.uint64(i + 1))
        out[name] = h.view(np.int64)
    return place, out


_BLOCK = pa.struct([("text", pa.string()), ("path", pa.string())])
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("declared", pa.bool_()), ("suspect", pa.bool_()), ("content", pa.int64()), ("blocks", pa.list_(_BLOCK))])
_PARSED_SQL = "page_id long, url string, host string, declared boolean, suspect boolean, content long, blocks array<struct<text string, path string>>"
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """suspect: whether the host's other pages are needed; content: a hash of the blocks' text."""
    for batch in batches:
        for piece in pieces(batch, "html"):
            rows = []
            for page, url, text in zip(piece.column("page_id").to_pylist(), piece.column("url").to_pylist(), piece.column("html").to_pylist()):
                blocks, declared = blocks_of(text or "")
                m = _HOST.match(url or "")
                suspect = any(path for _, path in blocks) if declared else bool(blocks)
                content = _hash("\n".join(t for t, _ in blocks)) if suspect else None
                rows.append({"page_id": page, "url": url, "host": m[1].lower() if m else "", "declared": declared, "suspect": suspect, "content": content, "blocks": [{"text": t, "path": p} for t, p in blocks]})
            yield pa.RecordBatch.from_pylist(rows, _PARSED)


#: left: the text that stays of a block; hits: its tokens that are covered.
_JUDGED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("declared", pa.bool_()), ("blocks", pa.list_(pa.struct([("path", pa.string()), ("left", pa.string()), ("tokens", pa.int64()), ("hits", pa.int64())])))])
_JUDGED_SQL = "page_id long, url string, host string, declared boolean, blocks array<struct<path string, left string, tokens long, hits long>>"
_WINDOWS = pa.schema([("host", pa.string()), ("part", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("pages", pa.int64()), ("article", pa.int64())])
_WINDOWS_SQL = "host string, part long, h1 long, h2 long, pages long, article long"


class Group:
    """Pages with suspects of one host, or of one part of it."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        #: The first row of each distinct page, and each row's place among those.
        number: dict = {}
        self.place, self.first = [], []
        for r in rows:
            self.place.append(number.setdefault((r["page_id"], r["content"]), len(number)))
            if self.place[-1] == len(self.first):
                self.first.append(r)
        #: Words of the suspects; blocks of an article outside of named parts are none.
        self.words: Words = [[b["text"].split(" ") if not r["declared"] or b["path"] else [] for b in r["blocks"]] for r in self.first]
        #: Pages with one article count once, as do rows of one page.
        same: dict = {}
        self.owner = [same.setdefault((r["declared"], r["content"] if r["declared"] or r["page_id"] is None else r["page_id"]), len(same)) for r in self.first]

    def whole(self) -> list[list[bytes]]:
        """A key of each suspect block of an article: its path and text."""
        return [[hashlib.blake2b(f"{b['path']}\n{b['text']}".encode("utf-8", "surrogatepass"), digest_size=16).digest() if r["declared"] and b["path"] else b"" for b in r["blocks"]] for r in self.first]

    def judged(self, reach: np.ndarray, common: set[bytes]) -> pa.RecordBatch:
        """common: keys of whole blocks that enough pages share."""
        on, at, found = covered(reach), 0, []
        for r, words, keys in zip(self.first, self.words, self.whole()):
            blocks = []
            for b, w, key in zip(r["blocks"], words, keys):
                own = on[at : at + len(w)]
                at += len(w) + 1
                left = " ".join(x for x, c in zip(w, own) if not c) if not r["declared"] else b["text"]
                blocks.append({"path": b["path"], "left": left, "tokens": len(w) or b["text"].count(" ") + 1, "hits": len(w) if key in common else int(own.sum())})
            found.append(blocks)
        return pa.RecordBatch.from_pylist([{"page_id": r["page_id"], "url": r["url"], "host": r["host"], "declared": r["declared"], "blocks": found[k]} for r, k in zip(self.rows, self.place)], _JUDGED)


def _grouped(batches: Iterator[pa.RecordBatch], close) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, part): close(key, pages, hashes of shared windows) of each; rows without blocks are windows."""
    key, rows, shared = None, [], []
    for batch in batches:
        host, part = batch.column("host").to_pylist(), batch.column("part").to_pylist()
        cuts = [i for i in range(len(host)) if not i or (host[i], part[i]) != (host[i - 1], part[i - 1])]
        for lo, hi in zip(cuts, [*cuts[1:], len(host)]):
            if key != (host[lo], part[lo]):
                if key is not None:
                    yield close(key, rows, shared)
                key, rows, shared = (host[lo], part[lo]), [], []
            own = batch.slice(lo, hi - lo)
            rows.extend(own.filter(own.column("blocks").is_valid()).to_pylist())
            if "h1" in own.schema.names and (marks := own.filter(own.column("blocks").is_null())).num_rows:
                h = np.empty(marks.num_rows, _WINDOW)
                h["h1"], h["h2"] = marks.column("h1").to_numpy(), marks.column("h2").to_numpy()
                shared.append(h)
    if key is not None:
        yield close(key, rows, shared)


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host: whole hosts, by their suffix arrays."""

    def close(key, rows, shared) -> pa.RecordBatch:
        g = Group(rows)
        pages: dict[bytes, set[int]] = {}
        for keys, own in zip(g.whole(), g.owner):
            for k in keys:
                pages.setdefault(k, set()).add(own)
        common = {k for k, who in pages.items() if k and len(who) >= MIN_PAGES}
        return g.judged(shared_runs(g.words, g.owner), common)

    return _grouped(batches, close)


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, part) -> each distinct window or whole block of a part, with its number of pages without a declared article, and once for each article."""

    def close(key, rows, shared) -> pa.RecordBatch:
        g = Group(rows)
        of: dict[tuple[int, int | None], list[np.ndarray]] = {}
        for r, words, keys, own in zip(g.first, g.words, g.whole(), g.owner):
            found = np.concatenate([windows([words])[1], np.frombuffer(b"".join(keys), _WINDOW)])
            of.setdefault((own, r["content"] if r["declared"] else None), []).append(found)
        by_page = [np.unique(np.concatenate(x)) for (_, article), x in of.items() if article is None]
        by_article = {article: np.unique(np.concatenate(x)) for (_, article), x in of.items() if article is not None}
        seen, pages = np.unique(np.concatenate([np.zeros(0, _WINDOW), *by_page]), return_counts=True)
        articles = np.repeat(np.array([*by_article], np.int64), [len(x) for x in by_article.values()])
        every = np.concatenate([seen, *by_article.values()])
        n = len(every)
        count = pa.array(np.concatenate([pages, np.zeros(len(articles), np.int64)]).astype(np.int64))
        which = pa.array(np.concatenate([np.zeros(len(seen), np.int64), articles]), pa.int64(), mask=np.arange(n) < len(seen))
        return pa.record_batch([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(every["h1"]), pa.array(every["h2"]), count, which], schema=_WINDOWS)

    return _grouped(batches, close)


def _without_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, part), a part's shared windows (blocks null) among its pages -> the pages, judged."""

    def close(key, rows, shared) -> pa.RecordBatch:
        g = Group(rows)
        place, hashes = windows(g.words)
        known = np.concatenate([np.zeros(0, _WINDOW), *shared])
        reach = np.zeros(sum(len(b) + 1 for p in g.words for b in p), np.int64)
        reach[place[np.isin(hashes, known)]] = MIN_TOKENS
        return g.judged(reach, {x.tobytes() for x in known})

    return _grouped(batches, close)


def _hot_hosts(split: DataFrame) -> DataFrame:
    """Pages of hosts of several parts, judged by runs that are counted over whole hosts."""
    by_part = split.repartition("host", "part").sortWithinPartitions("host", "part", "page_id")
    counted = staged(by_part.mapInArrow(_count_windows, _WINDOWS_SQL), "runs")
    # All rows of a page are in one part, but an article may be in several.
    total = counted.groupBy("host", "h1", "h2").agg((F.sum("pages") + F.count_distinct("article")).alias("total")).where(F.col("total") >= MIN_PAGES)
    shared = counted.select("host", "part", "h1", "h2").distinct().join(total, ["host", "h1", "h2"]).select("host", "part", "h1", "h2")
    both = split.unionByName(shared, allowMissingColumns=True)
    return both.repartition("host", "part").sortWithinPartitions("host", "part", "page_id").mapInArrow(_without_windows, _JUDGED_SQL)


@owner
def main_text(pages: DataFrame, pages_per_group: int = PAGES_PER_GROUP) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text)."""
    parsed = staged(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_parse, _PARSED_SQL), "pages")
    decided = parsed.where("not suspect").select("page_id", "url", F.array_join("blocks.text", "\n").alias("text"))
    rest = parsed.where("suspect")
    if rest.isEmpty():
        return decided
    sizes = rest.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / pages_per_group).alias("parts"))
    part = F.pmod(F.xxhash64(F.coalesce("page_id", "content")), F.col("parts"))
    split = rest.join(sizes, "host").withColumn("part", part)
    columns = ["page_id", "url", "host", "part", "declared", "content", "blocks"]
    small = split.where("parts = 1").select(columns).repartition("host").sortWithinPartitions("host", "page_id").mapInArrow(_by_host, _JUDGED_SQL)
    judged = staged(small.unionByName(_hot_hosts(split.where("parts > 1").select(columns))), "judged")

    slots = judged.where("declared").select("host", F.explode("blocks").alias("b")).groupBy("host", "b.path").agg(F.sum("b.tokens").alias("tokens"), F.sum("b.hits").alias("hits"))
    every = Window.partitionBy("host")
    bad = slots.withColumn("all", F.sum("tokens").over(every)).where((F.col("path") != "") & (2 * F.col("hits") >= F.col("tokens")) & (2 * F.col("tokens") < F.col("all")))
    bad = bad.groupBy("host").agg(F.collect_set("path").alias("bad"))  # paths of a site's templates
    marked = judged.join(bad, "host", "left").withColumn("bad", F.when(F.col("declared"), F.col("bad")))
    kept = marked.withColumn("kept", F.filter("blocks", lambda b: (b["left"] != "") & ~F.coalesce(F.array_contains("bad", b["path"]), F.lit(False))))
    return decided.unionByName(kept.select("page_id", "url", F.array_join("kept.left", "\n").alias("text")))
