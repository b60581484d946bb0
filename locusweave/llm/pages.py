"""Main text of web pages by site template removal.

Every element's subtree is hashed twice: by its content (tags and text, with attributes, numbers and white space masked) and, where
its tag, role or class hints at page furniture, by its shape (tags and class words, text masked, equal neighbours as one). Spark
counts on how many pages of the host each hash occurs, and what recurs is the host's template:

* a content hash on CONTENT_PAGES pages and CONTENT_SHARE of the host's pages;
* the shape hash of a hinted subtree on SHAPE_PAGES pages and SHAPE_SHARE of them, so menus, adverts and notices go although their
  words differ from page to page. Hosts of fewer than CONTENT_PAGES pages also use the shapes found on ALL_SHARE of all pages.

Inside an <article> or <main>, content hashes spare paragraphs, headings, lists, quotations, code and tables, so that text which a host's
articles have in common is kept; a hint there only lowers the number of pages that recurrence takes. Always deleted are scripts, styles,
forms and their like, what is hidden, furniture by its tag (nav, aside, footer, and a header outside articles), and reader comments, whose words and number never recur.

On hosts of CONTENT_PAGES pages and more that is all: what the counts leave is the text. Hosts of fewer pages have too few to count, so
there, and after the counts, two guesses follow, each only if it takes less text than it leaves: elements outside
articles with a hint go, and text outside of <article> and <main> goes.

A null html gives an empty text, null urls share one host. Null ids and repeated rows are kept, each as it is. Extra columns are
ignored, whatever their names. An empty table gives an empty result. Pages of any length are read whole; <br> is white space
within a block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, to_batch

CONTENT_PAGES, CONTENT_SHARE = 5, 0.2
SHAPE_PAGES, SHAPE_SHARE, ALL_SHARE = 3, 0.01, 0.001
#: A host's pages are dealt into parts of about LOT pages, or of a DEALT-th of all pages if that is more; so at most DEALT hosts,
#: whose names are broadcast, have more than one part.
LOT, DEALT = 500, 50_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_NEVER = frozenset("head form button select option dialog noscript object embed canvas audio video map template label input".split())
_FURNITURE = frozenset("nav footer header aside menu".split())
_SPARED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre code table tbody thead tr td th figure figcaption b i em strong a span".split())
_KEPT = frozenset("html body article main head".split())
_CLOSES_P = _BLOCK - {"html", "body", "head"}
_NAMES = re.compile(r"""\b(class|id|role|style|aria-hidden|aria-modal|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar share sharing social related recommended recommendations pagination pager widget skip".split())
_COMMENTS = frozenset("comment comments disqus".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS, _ZEROS = str.maketrans("123456789", "0" * 9), re.compile("00+")


def _reading(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is never article text, whether something hints at furniture, and its class words."""
    never, hint, words = tag in _NEVER, tag in _FURNITURE, []
    for name, value in _NAMES.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words += [w for w in re.split(r"[^a-z]+", value) if w]
        never |= name == "hidden" or name in ("aria-hidden", "aria-modal") and value == "true" or name == "style" and bool(_UNSEEN.search(value))
        hint |= name == "role" and value in _ROLES
    if tag in ("html", "body"):
        return False, False, ""
    never |= not _COMMENTS.isdisjoint(words)
    hint |= tag not in ("article", "main") and not _WORDS.isdisjoint(words)
    return never, hint, " ".join(sorted(set(words)))


class Page:
    """One parse of a page: elements, their contents in order, and pieces of text with the element that they stand in."""

    def __init__(self, source: str):
        self.source = source
        self.tag, self.up, self.drop, self.hint, self.words, self.inside = ["#"], [-1], [False], [False], [""], [False]
        self.parts: list[list] = [[]]  # of each element: texts, and numbers of the elements within
        self.text: list[tuple[int, int, int]] = []  # element, begin, end; an element of -1 ends a block
        stack, at = [0], 0
        for m in _TOKEN.finditer(source):
            i, j = m.span()
            self._piece(stack[-1], at, i)
            at = j
            name = m[3]
            if name is None:
                continue
            tag = name.lower()
            if m[2]:
                self._close(stack, tag)
            else:
                self._open(stack, tag, m[4])
        self._piece(stack[-1], at, len(source))

    def _piece(self, element: int, begin: int, end: int) -> None:
        if end > begin and not self.drop[element]:
            self.text.append((element, begin, end))
            if body := "".join(self.source[begin:end].translate(_DIGITS).split()):
                self.parts[element].append(_ZEROS.sub("0", body) if "00" in body else body)

    def _break(self, tag: str) -> None:
        if tag in _BLOCK:
            self.text.append((-1, 0, 0))

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in _VOID:
            self._break(tag)
            if tag == "br":
                self.text.append((-2, 0, 0))
            return
        if tag in _CLOSES_P:
            self._end_implied(stack, "p")
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._end_implied(stack, tag)
        self._break(tag)
        top = stack[-1]
        never, hint, words = _reading(tag, attributes)
        self.parts[top].append(len(self.tag))
        self.parts.append([])
        self.tag.append(tag)
        self.up.append(top)
        self.drop.append(self.drop[top] or never)
        # an article's own header holds its headline
        self.hint.append(hint and not (tag == "header" and self.inside[top]))
        self.words.append(words)
        self.inside.append(self.inside[top] or tag in ("article", "main") and not self.drop[-1])
        if not attributes.endswith("/") or tag in _BLOCK:
            stack.append(len(self.tag) - 1)

    def _end_implied(self, stack: list[int], tag: str) -> None:
        """End an open element of this kind, unless a container stands between."""
        for k in range(len(stack) - 1, 0, -1):
            own = self.tag[stack[k]]
            if own == tag:
                del stack[k:]
                return
            if own in ("ul", "ol", "table", "tr", "div", "section", "article", "main", "body", "dl", "nav", "footer", "blockquote", "select") and own != tag:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        self._break(tag)
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return
            if self.tag[stack[k]] in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                return

    def subtrees(self) -> list[tuple[int, int, int]]:
        """(element, hash of its content, hash of its shape) of each element that may be template; 0: not by this hash.

        From the last element to the first, so that those within come before what holds them; linear in the page.
        """
        n = len(self.tag)
        content, shape, filled, out = [0] * n, [0] * n, [False] * n, []
        for e in range(n - 1, 0, -1):
            if self.drop[e]:
                continue
            tag, seen, inner, text = self.tag[e], [], [], False
            for part in self.parts[e]:
                if isinstance(part, str):
                    seen.append(part)
                    text = True
                elif filled[part]:
                    seen.append(f"\0{content[part]}")
                    if not inner or inner[-1] != shape[part]:
                        inner.append(shape[part])
            filled[e] = bool(seen)
            if not seen:
                continue
            content[e] = xxhash.xxh3_64_intdigest("\1".join((tag, *seen)).encode("utf-8", "surrogatepass")) - 2**63
            shape[e] = xxhash.xxh3_64_intdigest(f"{tag}\1{self.words[e]}\1{text}\1{inner}".encode()) - 2**63
            own = content[e] if tag in _BLOCK and tag not in _KEPT and not (self.inside[e] and tag in _SPARED) else 0
            if own or self.hint[e]:
                out.append((e, own, shape[e] if self.hint[e] else 0))
        return out

    def main_text(self, contents: set[int], shapes: set[int], counted: bool) -> tuple[str, int]:
        """The text, and how many subtrees went because their host has them as template (outermost ones count).

        ``counted``: whether the host has pages enough for its counts alone to decide.
        """
        drop = list(self.drop)
        found = {e for e, c, s in self.subtrees() if c in contents or s in shapes} if contents or shapes else set()
        took = 0
        for e in range(1, len(drop)):
            if drop[self.up[e]]:
                drop[e] = True
            elif not drop[e] and e in found:
                drop[e] = True
                took += 1
            elif self.hint[e] and self.tag[e] in _FURNITURE:
                drop[e] = True
        if not counted:
            hinted = list(drop)
            for e in range(1, len(drop)):
                hinted[e] = hinted[e] or hinted[self.up[e]] or self.hint[e] and not self.inside[e]
            for guess in (hinted, [x or not y for x, y in zip(drop, self.inside, strict=True)]):
                left = self._size([x or y for x, y in zip(drop, guess, strict=True)])
                if left and 2 * left >= self._size(drop):
                    drop = [x or y for x, y in zip(drop, guess, strict=True)]
        blocks, held = [], []
        for e, i, j in self.text:
            if e >= 0:
                if not drop[e]:
                    held.append(self.source[i:j])
            elif e == -2:
                held.append(" ")
            elif held:
                blocks.append("".join(held))
                held = []
        blocks.append("".join(held))
        clean = (" ".join(html.unescape(b).split()) for b in blocks)
        return "\n".join(b for b in clean if b), took

    def _size(self, drop: list[bool]) -> int:
        """Characters of the text that stays, without white space."""
        return sum(len("".join(self.source[i:j].split())) for e, i, j in self.text if e >= 0 and not drop[e])


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


PAGE, CONTENT, SHAPE = 0, 1, 2


def count_subtrees(pages: DataFrame) -> DataFrame:
    """(host, kind, hash, n): on how many pages of the host a hash occurs; PAGE with hash 0: the host's number of pages.

    Contents on fewer than CONTENT_PAGES pages are left out, as no threshold lets them in.
    """
    schema = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, kinds, hashes = [], [], []
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Page(source or "").subtrees()
                own = {(PAGE, 0)} | {(CONTENT, c) for _, c, _ in found if c} | {(SHAPE, s) for _, _, s in found if s}
                hosts += [host] * len(own)
                kinds += [k for k, _ in own]
                hashes += [h for _, h in own]
            yield to_batch({"host": hosts, "kind": kinds, "hash": hashes}, schema)

    rows = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, kind int, hash long")
    return rows.groupBy("host", "kind", "hash").agg(F.count("*").alias("n")).where((F.col("kind") != CONTENT) | (F.col("n") >= CONTENT_PAGES))


def host_templates(counts: DataFrame) -> DataFrame:
    """(host, pages, contents, shapes): of every host its template's hashes.

    Shares are tested before hashes are gathered, so a host's list has at most 1 / share of a page's elements on average.
    """
    hosts = counts.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"))
    least = F.when(F.col("kind") == CONTENT, F.greatest(F.lit(CONTENT_PAGES), CONTENT_SHARE * F.col("pages"))).otherwise(F.greatest(F.lit(SHAPE_PAGES), SHAPE_SHARE * F.col("pages")))
    often = counts.where(F.col("kind") != PAGE).where(F.col("n") >= F.lit(SHAPE_PAGES)).join(hosts, "host").where(F.col("n") >= least)
    gathered = often.groupBy("host").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("hash"))).alias(name) for k, name in ((CONTENT, "contents"), (SHAPE, "shapes"))])
    return hosts.join(gathered, "host", "left")


def common_shapes(counts: DataFrame, total: int) -> set[int]:
    """Shapes of hinted subtrees on ALL_SHARE of all pages: at most 1 / ALL_SHARE of a page's hinted elements on average."""
    often = counts.where(F.col("kind") == SHAPE).groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= max(CONTENT_PAGES, ALL_SHARE * total))
    return {r["hash"] for r in often.select("hash").collect()}


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_template) of every page; the last: subtrees that went as the host's template."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_template", pa.int64())])
    counts = materialize(count_subtrees(pages), "subtrees")
    total = counts.where(F.col("kind") == PAGE).agg(F.sum("n")).first()[0] or 0
    everywhere = common_shapes(counts, total)
    # a host of many pages is dealt by a salt, each part of it meets a copy of the host's template
    lot = max(LOT, total / DEALT)
    large = counts.where((F.col("kind") == PAGE) & (F.col("n") > lot)).select("host", F.ceil(F.col("n") / lot).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    templates = host_templates(counts).join(F.broadcast(large), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], set[int], bool]] = {}
        for b in batches:
            texts, took = [], []
            if len(known) > 1000:
                known.clear()
            for source, host, pages_, contents, shapes in zip(*[b.column(c).to_pylist() for c in (2, 3, 4)], b.column(5), b.column(6), strict=True):
                if host not in known:
                    counted = pages_ >= CONTENT_PAGES
                    known[host] = (set(contents.as_py() or ()), set(shapes.as_py() or ()) | (set() if counted else everywhere), counted)
                text, n = Page(source or "").main_text(*known[host])
                texts.append(text)
                took.append(n)
            yield to_batch({"page_id": b.column(0), "url": b.column(1), "text": texts, "n_template": took}, schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    dealt = rows.join(F.broadcast(large), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), parts).cast("int"))
    joined = dealt.join(templates, ["host", "part"], "left").select("page_id", "url", "html", "host", "pages", "contents", "shapes")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_template long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
