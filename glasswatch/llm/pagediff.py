"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines: the text of each block element, with what the markup says of it (inside an article, inside a
menu, header, footer, sidebar, notice, advert, form or comment, or nothing).  URLs of a host are put in the order of their
paths, and each is paired with the neighbour whose path shares more leading segments.  The lines of the two pages are aligned by longest
common subsequence; lines that both have are furniture and go.

Differencing alone cannot give right results: hosts with one page have no partner, and neighbouring pages may hold copies
of one article.  So the markup overrules it where it speaks: lines inside an article stay, lines inside furniture go, and
where a page has an article, lines outside it go.  Differencing decides all other lines.

Null html is empty and gives an empty text.  A null or host-less URL has no partner.  Pages of one URL are the same
place, not a pair; one of them (the least by content hash) stands for the URL.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glasswatch.llm.common import prefix_hash, query, range_hash, squeezed, table, text_bytes, unsqueezed, written

PLAIN, ARTICLE, FURNITURE = 0, 1, 2
# What elements and names in class, id and role mean.
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
                    "select summary table tbody td tfoot th thead title tr ul").split())
FURNITURE_TAGS = frozenset("nav footer aside form head title menu dialog button select option label input header search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted sidebar nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "notification alert newsletter subscribe subscription signup login social share sharing related recommended comment comments "
    "reply replies disqus respond popup modal overlay dialog alertdialog disclaimer copyright pagination pager widget complementary "
    "contentinfo search form skip paywall").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_NAMES = frozenset("main articlebody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math|object|canvas|audio|video)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _meaning(tag: str, attributes: str, inside: int) -> int:
    """What an element says of its text; ``inside`` is what its parent said."""
    if inside == FURNITURE:
        return FURNITURE
    names: set[str] = set()
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role", "itemprop"):
                names.update(x.lower() for x in _NAME.findall(value))
                names.add(value.lower())
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return FURNITURE
    if tag in FURNITURE_TAGS or names & FURNITURE_NAMES:
        return FURNITURE
    if tag in ("article", "main") or names & ARTICLE_NAMES:
        return ARTICLE
    return inside


def lines(page: str) -> list[tuple[str, int]]:
    """Text and meaning of each block with text, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, int]] = []  # tag, meaning, meaning a heading inside would have
    held: list[str] = []
    now, heading = PLAIN, PLAIN

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, now))
        held.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br":
            held.append(" ")
        if m[2]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if depth >= 0:
                if any(meaning != now for _, meaning, _ in stack[:depth][-1:] or [("", PLAIN, PLAIN)]):
                    close()
                del stack[depth:]
        elif tag not in VOID and not m[4].endswith("/"):
            if tag in BLOCKS:  # a block ends an open paragraph, with whatever was left open in it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag == "li":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
            above = stack[-1][1:] if stack else (PLAIN, PLAIN)
            meaning = _meaning(tag, m[4], above[0])
            # A header inside an article: its headings are the article's.
            under = above[1] if meaning == FURNITURE and (tag == "header" or above[0] == FURNITURE) else meaning
            if meaning == FURNITURE and tag in HEADINGS and above[0] == FURNITURE and above[1] == ARTICLE:
                meaning = under = ARTICLE
            if meaning != above[0] and tag not in BLOCKS:
                close()
            stack.append((tag, meaning, under))
        now = stack[-1][1] if stack else PLAIN
    held.append(page[at:])
    close()
    return out


def shared(mine: list[int], other: list[int]) -> list[bool]:
    """Which of my lines are in a longest common subsequence with the other's, by bit-parallel rows."""
    out = [False] * len(mine)
    where: dict[int, int] = {}
    for i, x in enumerate(mine):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(mine)) - 1
    row, rows = full, []
    for x in other:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(mine), len(other)
    while i and j:
        if mine[i - 1] == other[j - 1]:
            i, j = i - 1, j - 1
            out[i] = True
        elif rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out


def _place(url: str) -> tuple[str, str]:
    try:
        parts = urlsplit(url)
        return (parts.netloc or "").lower(), parts.path
    except ValueError:
        return "", ""


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def partners(urls: DataFrame) -> DataFrame:
    """For each row of (host, path, url, lines), url distinct: the lines of its nearest neighbour in the host, or null."""
    order = ["host", "path", "url"]
    placed = written(urls.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    # Numbers without gaps: the high bits of pos are the partition, of which there are few.
    part = F.shiftright("pos", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(str(total))
        total += sizes.get(p, 0)
    numbered = placed.withColumn("idx", F.get(F.split(F.lit(",".join(before)), ",").cast("array<long>"), part.cast("int"))
                                 + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))).drop("pos")
    beside = lambda step, name: numbered.select((F.col("idx") + step).alias("idx"), F.struct("host", "path", "lines").alias(name))
    both = numbered.join(beside(1, "left"), "idx", "left").join(beside(-1, "right"), "idx", "left")

    @arrow_udf("array<long>")
    def nearer(path: pa.Array, host: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for p, h, a, b in zip(path.to_pylist(), host.to_pylist(), left.to_pylist(), right.to_pylist()):
            near = [x for x in (a, b) if x is not None and h and x["host"] == h]
            out.append(max(near, key=lambda x: _common(p, x["path"]))["lines"] if near else None)
        return pa.array(out, pa.list_(pa.int64()))

    return both.select("url", nearer("path", "host", "left", "right").alias("other"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")) \
        .withColumn("key", F.xxhash64(F.coalesce("url", F.lit("")), "html"))
    id_type = base.schema["id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for x, _ in lines(h)] for h in batch.column(2).to_pylist()]
            data, offsets = text_bytes(pa.array([x for xs in found for x in xs], pa.string()))
            h = range_hash(prefix_hash(data), offsets[:-1], offsets[1:]).view(np.int64)
            edge = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            place = [_place(u or "") for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array([p[0] for p in place]), pa.array([p[1] for p in place]), batch.column(0).fill_null(""),
                pa.ListArray.from_arrays(pa.array(edge), pa.array(h))], ["key", "host", "path", "url", "lines"])

    # Narrow rows (line hashes) find the partners; texts take part in no sort.
    narrow = written(base.select("url", "key", "html").mapInArrow(hashes, "key long, host string, path string, url string, lines array<long>")
                     .groupBy("key", "url", "host", "path").agg(F.first("lines").alias("lines")))
    urls = narrow.groupBy("host", "path", "url").agg(F.min(F.struct("key", "lines")).alias("x")).select("host", "path", "url", "x.lines")

    @arrow_udf("binary")
    def marks(mine: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([bytes(shared(a, b or [])) for a, b in zip(mine.to_pylist(), other.to_pylist())], pa.binary())

    common = narrow.join(partners(urls), "url").select("key", marks("lines", "other").alias("common"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [squeezed(x.encode()) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(packed, pa.binary())], ["id", "url", "key", "page"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, both in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = lines(unsqueezed(packed).decode())
                article = any(meaning == ARTICLE for _, meaning in found)
                out.append("\n\n".join(x for (x, meaning), is_shared in zip(found, both) if
                                       meaning == ARTICLE or meaning == PLAIN and not article and not is_shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    pages_ = base.select("id", "url", "key", "html").mapInArrow(squeeze, f"id {id_type}, url string, key long, page binary")
    return pages_.join(common, "key").select("id", "url", "page", "common") \
        .mapInArrow(texts, f"id {id_type}, url string, text string").withColumnRenamed("id", id_col)


@query("op3_page_diff")
def op3(spark, sf):
    """Main text of all pages; no SQL twin (alignment)."""
    return extract(table(spark, sf, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
