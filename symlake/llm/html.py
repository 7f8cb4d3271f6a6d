"""Main text of web pages: structure first, then a suffix array per host for what structure leaves open.

A page becomes blocks. Blocks inside its article (or main) element are text, blocks inside menus,
headers, footers and the like are not. Where a page marks no article, the rest is open: the tokens of
a host's open blocks are concatenated, a suffix array finds long substrings that occur on several
distinct pages, the tokens they cover are removed, and the unique runs stay.
Repetition never removes text inside an article: a copied article is still that page's text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import cut, prepare

#: A repeated substring has this many tokens at least and is on this many pages at least.
REPEAT_TOKENS, REPEAT_PAGES = 8, 3
#: Characters of open text that one suffix array is built over. In larger hosts, the pages of every substring are counted by its hash over the whole host.
GROUP_CHARS = 4_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<(?=/)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
#: Elements of running text: inside an article, their names and classes say nothing about what they are for.
_TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figure figcaption caption summary address".split())
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_SKIP = _RAW | {"nav", "header", "footer", "aside", "form", "menu", "select", "button", "svg", "canvas", "object", "dialog", "head", "math"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIP_NAMES = set(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars rail widget widgets related recommended share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer colophon comment comments disqus replies responses pagination pager toolbar skip complementary contentinfo search".split()
)
_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def page_host(url: str | None) -> str:
    return m[1].lower() if (m := re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")) else ""


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a tag; the first of a name counts."""
    found: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(text):
        found.setdefault(key.lower(), html.unescape("".join(values)))
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(re.search(r"(?:^|;)\s*display\s*:\s*none", attributes.get("style", ""), re.I))


def page_blocks(source: str | None) -> list[tuple[str, bool]]:
    """(text, whether inside the article) of the blocks that may be main text, in page order."""
    source = source or ""
    blocks: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, inside an article
    parts: list[str] = []
    state = {"article": False}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((text, bool(stack) and stack[-1][2]))
        parts.clear()

    at, size = 0, len(source)
    while at < size:
        m = _MARKUP.search(source, at)
        end = m.start() if m else size
        if end > at and not (stack and stack[-1][1]):
            # Decoded node by node: no reference runs over markup.
            parts.append(html.unescape(source[at:end]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in _INLINE:
                        flush()
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and name not in ("body", "html"):
                    break  # a stray end tag doesn't close the article
            else:
                if name == "p":
                    flush()
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name not in _INLINE:
            flush()
        if name in _CLOSES_P or name == "li":
            # An open paragraph, with what is open inside it, ends before a block; an item before the next one.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == ("li" if name == "li" else "p"):
                    del stack[i:]
                    break
                if stack[i][0] not in _INLINE and not (name == "li" and stack[i][0] == "p"):
                    break
        if name in _VOID:
            continue
        skipped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        attributes = attributes_of(m[3]) if m[3] else {}
        if not skipped:
            names = {x for k in ("class", "id", "role") if k in attributes for x in re.split(r"[^a-z0-9]+", attributes[k].lower())}
            told = not _SKIP_NAMES.isdisjoint(names) and not (inside and (name in _TEXT or name in _INLINE))
            skipped = name in _SKIP or name not in ("html", "body", "main", "article") and (told or is_hidden(attributes))
        if name in _RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        if not skipped and (name in ("article", "main") or attributes.get("role", "").lower() == "main"):
            inside = state["article"] = True
        stack.append((name, skipped, inside))
    flush()
    if state["article"]:
        return [(t, True) for t, inside in blocks if inside]
    return blocks


def repeated_tokens(pages: list[list[str]], least: int = REPEAT_TOKENS, several: int = REPEAT_PAGES) -> list[np.ndarray]:
    """Which tokens of each page lie in a substring of `least` tokens or more that is on `several` distinct pages.

    Suffixes are sorted by their first `least` tokens (prefix doubling); longer repeats are unions of
    these, so what they cover is what all longest repeats cover. Substrings don't run over the end of a page.
    """
    sizes = np.array([len(p) for p in pages], np.int64)
    n = int(sizes.sum())
    covered = np.zeros(n, bool)
    if n:
        numbers: dict[str, int] = {}
        rank = np.fromiter((numbers.setdefault(t, len(numbers)) for p in pages for t in p), np.int64, n)
        page = np.repeat(np.arange(len(pages)), sizes)
        width = 1
        while width < least:
            step = min(width, least - width)
            after = np.full(n, -1, np.int64)
            after[: n - step] = np.where(page[: n - step] == page[step:], rank[step:], -1)
            rank = np.unique(np.stack([rank, after], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            width += step
        fits = np.concatenate([page[: n - least + 1] == page[least - 1 :], np.zeros(min(n, least - 1), bool)]) if n >= least else np.zeros(n, bool)
        at = np.flatnonzero(fits)
        distinct = np.unique(np.stack([rank[at], page[at]], axis=1), axis=0)[:, 0]
        common = np.bincount(distinct, minlength=int(rank.max()) + 1) >= several
        starts = at[common[rank[at]]]
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + least, -1)
        covered = np.cumsum(marks)[:n] > 0
    return np.split(covered, np.cumsum(sizes)[:-1]) if len(pages) else []


def window_hashes(tokens: list[str], least: int = REPEAT_TOKENS) -> np.ndarray:
    """A 64-bit hash of the `least` tokens at each place that has so many to the end of the page."""
    n = len(tokens) - least + 1
    if n < 1:
        return np.zeros(0, np.int64)
    seen: dict[str, int] = {}
    for t in tokens:
        if t not in seen:
            seen[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    own = np.fromiter((seen[t] for t in tokens), np.uint64, len(tokens))
    h = np.zeros(n, np.uint64)
    for k in range(least):
        h = h * _BASE + own[k : k + n]
    return h.view(np.int64)


def _without(blocks: list[str], covered: list[bool]) -> list[str]:
    out, at = [], 0
    for b in blocks:
        tokens = b.split(" ")
        rest = [t for t, gone in zip(tokens, covered[at : at + len(tokens)], strict=True) if not gone]
        at += len(tokens)
        if rest:
            out.append(" ".join(rest))
    return out


def extract(pages: DataFrame) -> DataFrame:
    r"""page_id, url, text, n_chars of every row of pages: its main text, blocks joined by two \n, empty if there is none.

    pages needs page_id, url and html; other columns are ignored. Null html is empty. A null url is a
    host of its own name ''. Repeated rows are pages of their own. An empty table gives no rows.
    """
    prepare(pages.sparkSession)
    kinds = "page_id long, url string, host string, blocks array<string>, open boolean, open_chars long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_blocks(x.as_py()) for x in batch.column(2)]
            open_ = [bool(b) and not b[0][1] for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([page_host(u) for u in batch.column(1).to_pylist()], pa.string()), pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string())), pa.array(open_, pa.bool_()), pa.array([sum(len(t) for t, _ in b) for b in found], pa.int64())],
                names=["page_id", "url", "host", "blocks", "open", "open_chars"],
            )

    parsed = cut(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(parse, kinds).withColumn("row", F.monotonically_increasing_id()))
    undecided = parsed.filter("open")
    hosts = undecided.groupBy("host").agg((F.sum("open_chars") >= GROUP_CHARS).alias("large"))
    grouped = undecided.join(hosts, "host")

    def unique_runs(table: pa.Table) -> pa.Table:
        blocks = table.column("blocks").to_pylist()
        covered = repeated_tokens([[t for b in page for t in b.split(" ")] for page in blocks])
        kept = [_without(page, marks.tolist()) for page, marks in zip(blocks, covered, strict=True)]
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "blocks": pa.array(kept, pa.list_(pa.string()))})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.unique(window_hashes([t for b in batch.column(2)[k].as_py() for t in b.split(" ")]))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own), pa.int64()), pa.array([batch.column(1)[k].as_py()] * len(own), pa.string()), pa.array(own, pa.int64())], names=["row", "host", "h"])

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for blocks, repeats in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                hashes = window_hashes([t for b in blocks for t in b.split(" ")])
                marks = np.zeros(sum(b.count(" ") + 1 for b in blocks) + 1, np.int64)
                starts = np.flatnonzero(np.isin(hashes, np.array(repeats or [], np.int64)))
                marks[starts] += 1
                np.add.at(marks, starts + REPEAT_TOKENS, -1)
                kept.append(_without(blocks, (np.cumsum(marks)[:-1] > 0).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.string()))], names=["page_id", "url", "blocks"])

    found = "page_id long, url string, blocks array<string>"
    small = grouped.filter("not large").groupBy("host").applyInArrow(unique_runs, found)
    large = grouped.filter("large")
    # A page has each of its hashes once, so rows are pages; they are counted in each task before the shuffle.
    held = large.select("row", "host", "blocks").mapInArrow(windows, "row long, host string, h long")
    repeated = held.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= REPEAT_PAGES).select("host", "h")
    of_row = held.join(repeated, ["host", "h"], "left_semi").groupBy("row").agg(F.collect_list("h").alias("repeats"))
    rest = large.join(of_row, "row", "left").select("page_id", "url", "blocks", "repeats").mapInArrow(uncovered, found)
    text = F.concat_ws("\n\n", "blocks")
    return parsed.filter("not open").select("page_id", "url", "blocks").unionByName(small).unionByName(rest).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
