"""Main text of web pages by deduction of each host's template.

Tokens are tags, words and blocks, told apart by the path of open elements above them.  Words count in elements that a
page has once, whole blocks of text in elements that it repeats.  Tokens of a host whose occurrence vectors (the count on
every page) are equal form a class.  A class is valid if it is on most of the host's pages and has more than one token.
The template grows from the root: a token of a valid class belongs to it if the element around it does.

What lies between template tokens are slots, on every page.  The article element, else the main element, only chooses
among the slots; where a page has neither, all slots outside of elements that are marked as something else count.

Copies of a page are no evidence for a template: vectors range over the distinct pages of a host.  Near copies may still
make most of an article look like template, so an article of whose characters the slots hold under a quarter is taken
for one of several copies and stays whole.

Occurrence vectors are never gathered: two sums of 31-bit hashes of (page, count) stand for a vector, so each
task adds up what it reads and a host of any size costs a few numbers a token.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierspark.llm.urls import host_of
from hierspark.llm.util import broadcast_up_to, pieces, stored, texts_of

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
ASIDE = frozenset("head nav header footer aside form button select dialog menu search object audio video canvas map".split()) | RAW
# Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies notice notices consent gdpr alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended toolbar pagination pager "
    "comment comments disqus reply replies respond search login complementary contentinfo".split()
)
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.DOTALL)
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+")
ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.IGNORECASE)
CONTENT = re.compile(r"[^ \t]*")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.IGNORECASE)

#: An article is one of several near copies if its slots hold less than one part in four of its characters.
MIN_PAGES, SUPPORT, COPY = 4, 0.6, 4
#: Stands for all hosts; no host holds a slash.
POOL = "/"
BROADCAST_HOSTS = 50_000
BROADCAST_BYTES = 64 << 20
BROADCAST_COPIES = 1_000_000


class Element:
    """An open element: its name, path, and whether it is set aside or the article."""

    __slots__ = ("name", "path", "aside", "article", "main", "below")

    def __init__(self, name: str, attributes: str, above: Element | None):
        found = sorted({w for m in MARKED.finditer(attributes) for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w}) if attributes else []
        self.name = name
        self.below: dict[tuple[str, str], Element] = {}
        self.path = f"{above.path}/{name}{'.' if found else ''}{'.'.join(found)}" if above else ""
        own = name in ASIDE or not MARKS.isdisjoint(found) or bool(attributes and HIDDEN.search(attributes))
        self.aside = own or bool(above and above.aside)
        self.article = not self.aside and (name == "article" or bool(above and above.article))
        self.main = not self.aside and (name == "main" or bool(attributes and ROLE_MAIN.search(attributes)) or bool(above and above.main))


    def open(self, name: str, attributes: str) -> Element:
        """The element below; those seen before are kept, up to a thousand kinds."""
        key = (name, attributes if attributes and TELLING.search(attributes) else "")
        found = self.below.get(key)
        if found is None:
            found = Element(name, key[1], self)
            if len(self.below) < 1000:
                self.below[key] = found
        return found


ROOT = Element("", "", None)


def walk(page: str) -> Iterator[tuple[str, Element]]:
    """("<", element) at a start, ("|", element) at a block's border, (text, element) for character data."""
    open_: list[Element] = [ROOT]
    if len(ROOT.below) >= 1000:
        ROOT.below.clear()
    at = 0
    raw_until: str | None = None
    for tag in TAG.finditer(page):
        name = (tag[2] or "").lower()
        if tag.start() < at or (raw_until and not (tag[1] and name == raw_until)):
            continue
        if tag.start() > at and not raw_until:
            yield page[at : tag.start()], open_[-1]
        at = tag.end()
        raw_until = None
        if not name:
            continue
        if tag[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    del open_[i:]
                    break
            if name in BLOCKS:
                yield "|", open_[-1]
            continue
        if name in CLOSES_P:
            close(open_, {"p"}, {"article", "aside", "div", "section", "td", "th", "li", "main", "body", "blockquote"})
        if name in CLOSED_BY:
            names, stop = CLOSED_BY[name]
            close(open_, set(names.split()), stop)
        element = open_[-1].open(name, tag[3])
        if name in BLOCKS:
            yield "|", element
        yield "<", element
        if name in VOID or tag[3].rstrip().endswith("/") and name == "svg":
            if name == "br":
                yield " ", open_[-1]
        elif name in RAW:
            raw_until = name
            end = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
        else:
            open_.append(element)
    if at < len(page) and not raw_until:
        yield page[at:], open_[-1]


def close(open_: list[Element], names: set[str], stop: set[str]) -> None:
    """Close the innermost open element of these names unless an element of ``stop`` is inside of it."""
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].name in names:
            del open_[i:]
            return
        if open_[i].name in stop:
            return


def tokens(page: str) -> Counter:
    """Tags by path; by path also words in elements that the page has once, and blocks that begin in repeated ones."""
    tags: Counter = Counter()
    words: list[tuple[str, str]] = []
    for piece, element in walk(page):
        if piece == "<":
            tags[element.path] += 1
        elif piece != "|" and not piece.isspace():
            words.append((element.path, piece))
    found = Counter(tags)
    for path, piece in words:
        if tags[path] <= 1:
            found.update(f"{path} {w}" for w in html.unescape(piece).split())
    found.update(block_token(e.path, text) for text, e in blocks(page) if tags[e.path] > 1)
    return found


def block_token(path: str, text: str) -> str:
    return f"{path}\t{xxhash.xxh3_128_hexdigest(text)}"


def blocks(page: str) -> list[tuple[str, Element]]:
    """Text blocks in page order with the element around their first text; white space is single."""
    found, parts, owner = [], [], None
    for piece, element in walk(page):
        if piece == "|":
            if parts and (text := " ".join(html.unescape("".join(parts)).split())):
                found.append((text, owner))
            parts, owner = [], None
        elif piece != "<" and not element.aside:
            if owner is None and not piece.isspace():
                owner = element
            parts.append(piece)
    if parts and (text := " ".join(html.unescape("".join(parts)).split())):
        found.append((text, owner))
    return found


def main_text(page: str, template: frozenset[str]) -> str:
    """What the slots of a page hold: those in the article, else those in the main element, else all."""
    found = blocks(page)
    chosen = [b for b in found if b[1].article] or [b for b in found if b[1].main]
    slots = [b for b in chosen or found if not in_template(*b, template)]
    if chosen and COPY * sum(len(text) for text, _ in slots) < sum(len(text) for text, _ in chosen):
        slots = chosen
    return "\n\n".join(text for text, _ in slots)


def in_template(text: str, element: Element, template: frozenset[str]) -> bool:
    """Whether a block, or each of its words, is a token of the template."""
    return bool(template) and (block_token(element.path, text) in template or all(f"{element.path} {w}" in template for w in text.split()))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: host, token, pages, and the two sums that stand for the occurrence vector."""
    sums: dict[tuple[str, str], list[int]] = {}

    def rows() -> pa.RecordBatch:
        keys, values = list(sums), list(sums.values())
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([v[i] for v in values], pa.int64()) for i in range(3))]
        return pa.RecordBatch.from_arrays(columns, names=["host", "token", "pages", "sum_a", "sum_b"])

    for batch in pieces(batches, 2):
        for page_id, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, 2)):
            drawn: dict[int, int] = {}
            for token, n in tokens(page).items():
                if n not in drawn:
                    drawn[n] = xxhash.xxh64_intdigest(f"{page_id}:{n}")
                own = sums.get((host, token))
                if own is None:
                    own = sums[host, token] = [0, 0, 0]
                own[0] += 1
                own[1] += drawn[n] & 0x7FFFFFFF
                own[2] += drawn[n] >> 33
        if len(sums) > 200_000:
            yield rows()
            sums.clear()
    if sums:
        yield rows()


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Of the equal pages of a host the one with the smallest id; NULL pages go.

    Pages themselves are not shuffled while at most a counted million of them have copies: that list is broadcast then.
    """
    own = pages.where("_html IS NOT NULL").select(F.coalesce("page", F.lit("")).alias("page"), "_host", "_html", F.xxhash64("_html").alias("_a"), F.crc32(F.col("_html").cast("binary")).alias("_b"))
    key = ["_host", "_a", "_b"]
    several = stored(own.groupBy(*key).agg(F.min("page").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "copies")
    return own.join(broadcast_up_to(several, BROADCAST_COPIES), key, "left").where("_first IS NULL OR _first = page").select("page", "_host", "_html")


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens): tokens of valid classes of every host with enough distinct pages, and of all distinct pages together.

    Vectors of all pages are sums of those of the hosts.  A host's list is bounded by its pages, not by their number: a token
    is listed if it is on ``SUPPORT`` of them, so no list is longer than a page's mean number of tokens by ``SUPPORT``.
    """
    columns = ("pages", "sum_a", "sum_b")
    own = distinct_pages(pages)
    seen = own.mapInArrow(_occurrences, "host string, token string, pages bigint, sum_a bigint, sum_b bigint")
    by_host = stored(seen.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in columns)), "vectors")
    together = by_host.groupBy("token").agg(*(F.sum(c).alias(c) for c in columns)).select(F.lit(POOL).alias("host"), "token", *columns)
    sizes = own.groupBy(F.col("_host").alias("host")).agg(F.count("*").alias("all"))
    whole = sizes.agg(F.sum("all").alias("all")).select(F.lit(POOL).alias("host"), "all")
    large = stored(sizes.where("host <> ''").unionByName(whole).where(F.col("all") >= MIN_PAGES), "hosts")
    vectors = by_host.where("pages > 1").unionByName(together)
    frequent = vectors.join(broadcast_up_to(large, BROADCAST_HOSTS), "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    classes = frequent.groupBy("host", "pages", "sum_a", "sum_b").agg(F.collect_list("token").alias("tokens"))
    return classes.where(F.size("tokens") > 1).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


def nested(found: list[str]) -> frozenset[str]:
    """Tokens whose surrounding element is in the template, from the root down."""
    kept: set[str] = set()
    content = {t: around for t in found if (around := CONTENT.match(t)) and around.end() < len(t)}
    for token in sorted((t for t in found if t not in content), key=lambda t: t.count("/")):
        above = token.rpartition("/")[0]
        if not above or above in kept:
            kept.add(token)
    # a block's own element repeats, in numbers of its own: the element around that one counts
    above = lambda t, path: path.rpartition("/")[0] if t[len(path)] == "\t" else path
    return frozenset(kept | {t for t, around in content.items() if not above(t, around[0]) or above(t, around[0]) in kept})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset[str]] = {}
    for batch in pieces(batches, 3):
        texts = []
        for host, found, page in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), texts_of(batch, 3)):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = nested(found or [])
            texts.append(main_text(page, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:2], "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (id, url, text, n_chars), one row per input row.

    NULL and empty pages have an empty text.  Hosts of fewer than four distinct pages, and pages without a host, use the
    template of all pages together.  Repeated rows are extracted each; for the template, equal pages of one host are one page
    where their ids differ, and a page each where they do not.  Other columns are ignored.  Templates are broadcast up to a
    counted 64 MB and shuffled beyond it.
    """
    own = pages.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    found = stored(templates(own.select(F.col(id_col).cast("string").alias("page"), "_host", "_html")), "templates")
    size = found.agg(F.sum(F.octet_length(F.array_join("tokens", "")) + 8 * F.size("tokens"))).first()[0] or 0
    by_host = found.where(F.col("host") != POOL).withColumnRenamed("host", "_host")
    pooled = found.where(F.col("host") == POOL).select("tokens").scalar()
    joined = own.join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "_host", "left").select(id_col, url_col, "_host", "_html", F.coalesce("tokens", pooled).alias("_tokens"))
    schema = T.StructType([*own.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(_extract, schema)
