"""Main text of web pages: blocks from the markup, and repeated runs found by suffix arrays over each host's pages.

The markup says which blocks are surely menus, notices, scripts and so on (elements, roles and whole names such as ``share``
or ``related-posts``), and on pages with an article (or main element) which blocks are surely main text. Two kinds of
blocks it leaves open: all others on pages without an article, and those inside an article whose name only contains such
a word (``share-price``, ``social-impact``). The visible blocks of all pages of a host, main text included, are
concatenated as token streams. A suffix array over them finds runs of RUN_TOKENS tokens or more that occur on distinct
pages, and these decide the open blocks: without an article, covered tokens go and unique runs stay; inside an article, a
block goes only if runs cover all of it, and stays whole otherwise. Sure main text is never cut.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, slices

RUN_TOKENS = 6
#: Tokens of a host that share a suffix array; larger hosts are split and their parts exchange run digests.
CHUNK_TOKENS = 20_000

PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr "
                   "math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mspace mfenced semantics".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg canvas object embed audio video map select "
                    "button textarea input datalist dialog menu title noembed noframes xmp annotation annotation-xml".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert form".split())
#: Words of class and id names that mark a block as no main text.
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
                          "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
                          "share sharing social related recommended comment comments commentlist commentform reply replies respond disqus pagination pager "
                          "skip toolbar".split())
#: Words that may stand beside them in the name of such a block (digits as well). A name with any other word tells nothing for sure.
PLACE_NAMES = frozenset("area articles bar block bottom box button buttons center col column container content desktop footer form group header icons inner item "
                        "items large left link links list main message mobile module outer panel post posts primary reader right row section secondary "
                        "signup site slot small stories text thread title top unit us user widget widgets wrap wrapper".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentform reply replies respond disqus".split())
CONTENT_NAMES = frozenset("content main-content article-body article-content post-content entry-content post-body story story-body".split())
#: Start tags that end an open paragraph, and elements inside which an outer paragraph, item or cell stays open.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                           "hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
PARAGRAPH_SCOPE = frozenset("table td th caption button object template html body math svg".split())
#: For a start tag: the open elements it ends, and those beyond which it does not look.
IMPLIED_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th", "section", "article", "main", "body"}),
                **{t: ({"dt", "dd"}, {"dl", "table", "td", "th", "section", "article", "main", "body"}) for t in ("dt", "dd")},
                **{t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")}, "tr": ({"tr", "caption", "colgroup"}, {"table"}),
                **{t: ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
                "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup"}, {"select"})}
LOOSE, DROP, MAIN, ARTICLE = 0, 1, 2, 3
#: Added to a kind: the name of the block leaves open whether it is one.
OPEN = 4


def _named(names: set[str]) -> tuple[bool, bool]:
    """Whether names of an element surely mark it as no main text, and whether they may."""
    sure = some = False
    for name in names:
        parts = [w for w in re.split(r"[-_]+", name) if w]
        hits = [w for w in parts if w in DROPPED_NAMES]
        some = some or bool(hits)
        sure = sure or bool(hits) and all(w in DROPPED_NAMES or w in PLACE_NAMES or w.isdigit() for w in parts)
    return sure, some


def _zone(tag: str, attributes: str, outer: int) -> int:
    """The kind of text inside an element that stands in a block of the kind ``outer``."""
    if outer == DROP or tag in DROPPED:
        return DROP
    classes: set[str] = set()
    ids: set[str] = set()
    roles: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in DROPPED_ROLES:
            return DROP
        if name == "class":
            classes.update(value.split())
        elif name == "id":
            ids.update(value.split())
        elif name == "role" and value in ("main", "article"):
            roles.add(value)
    is_content = bool((classes | ids) & CONTENT_NAMES)
    kind, mark = outer & 3, outer & OPEN
    if tag not in ("html", "body", "article", "main") and not is_content:
        # ids of headings and sections are slugs of their titles; only comments are named by them for sure
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            ids = set()
        elif tag == "section":
            ids = {n for n in ids if set(re.split(r"[-_]+", n)) & COMMENT_NAMES}
        sure, some = _named(classes | ids)
        if sure:
            return DROP
        if some and tag not in INLINE and kind >= MAIN:
            mark = OPEN
    if tag == "header" and kind < MAIN:
        return DROP
    if tag == "article" or "article" in roles:
        return ARTICLE | mark
    if tag == "main" or "main" in roles or is_content:
        return max(kind, MAIN) | mark
    return kind | mark


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the visible blocks in page order; references are decoded and white space is one space.

    End tags that may be left out (of paragraphs, items, cells, options) are implied as in HTML. What an inline element
    drops inside a block does not cut the block.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    held_zone = LOOSE
    stack: list[tuple[str, int]] = []
    zone = LOOSE

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((held_zone, text))
        held.clear()

    def add(text: str, kind: int) -> None:
        nonlocal held_zone
        if kind == DROP and held and held_zone != DROP and stack and stack[-1][0] in INLINE:
            around = next((z for t, z in reversed(stack) if t not in INLINE), LOOSE)
            if around != DROP:
                return
        if held and kind != held_zone:
            close()
        held_zone = kind
        held.append(entities.unescape(text))

    def leave(n: int) -> None:
        """End the element at place ``n`` of the stack and all inside it."""
        nonlocal zone
        if any(t not in INLINE for t, _ in stack[n:]):
            close()
        del stack[n:]
        zone = stack[-1][1] if stack else LOOSE

    def imply(ended: set[str], beyond: set[str] | frozenset[str]) -> None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in ended:
                leave(n)
                return
            if stack[n][0] in beyond:
                return

    at = 0
    while at < len(page):
        found = PIECE.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            add(page[at:end], zone)
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            if found.group().startswith("<![CDATA["):
                add(found.group()[9:].removesuffix("]]>"), zone)
            continue
        if not found.group().endswith(">"):
            break  # the page ends inside a tag
        if tag not in INLINE:
            close()
        if tag == "br":
            held.append(" ") if held else None
            continue
        if closing:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    leave(n)
                    break
            continue
        if tag in ENDS_PARAGRAPH:
            imply({"p"}, PARAGRAPH_SCOPE)
        if tag in IMPLIED_ENDS:
            imply(*IMPLIED_ENDS[tag])
        if tag in VOID:
            continue
        inner = _zone(tag, attributes, zone)
        if tag in RAW:
            past = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = past.end() if past else len(page)
            continue
        if attributes.rstrip().endswith("/") and tag in ("path", "use", "circle", "rect"):
            continue
        stack.append((tag, inner))
        zone = inner
    close()
    return out


def page_blocks(page: str | None) -> tuple[list[str], list[int], bool, list[str]]:
    """Blocks of the main text, places of those among them that are open, whether an article or main element tells them, and other blocks."""
    found = blocks(page or "")
    for kind in (ARTICLE, MAIN):
        main = [(z, t) for z, t in found if z & 3 == kind or kind == MAIN and z & 3 > kind]
        if main:
            return [t for _, t in main], [n for n, (z, _) in enumerate(main) if z & OPEN], True, [t for z, t in found if z & 3 < kind]
    main = [t for z, t in found if z & 3 == LOOSE]
    return main, list(range(len(main))), False, [t for z, t in found if z & 3 == DROP]


def split_page(page: str | None) -> tuple[str | None, list[str], list[str]]:
    """The main text where the markup tells it (else None), the unmarked blocks to decide on, and the other blocks."""
    main, _, told, other = page_blocks(page)
    return ("\n\n".join(main), [], other) if told else (None, main, other)


def repeated_starts(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Whether a run of ``run`` tokens that also occurs on another page begins at each position.

    ``tokens`` are the streams of all pages in a row, ``page`` the page of each token. The suffix array is built by
    doubling until suffixes are ordered by their first ``run`` tokens; neighbours in it that agree so far share a prefix of that
    length, and stretches of such neighbours with more than one page are the repeated runs.
    """
    n = len(tokens)
    out = np.zeros(n, bool)
    if n < run:
        return out
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while width < run:
        step = min(width, run - width)  # the second half may overlap the first
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        width += step
    inside = np.zeros(n, bool)
    inside[:n - run + 1] = page[:n - run + 1] == page[run - 1:]
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[inside[suffixes]]
    if not len(suffixes):
        return out
    heads = np.flatnonzero(np.concatenate([[True], rank[suffixes][1:] != rank[suffixes][:-1]]))
    low, high = np.minimum.reduceat(page[suffixes], heads), np.maximum.reduceat(page[suffixes], heads)
    sizes = np.diff(np.concatenate([heads, [len(suffixes)]]))
    out[suffixes[np.repeat(low != high, sizes)]] = True
    return out


def _digest(tokens: np.ndarray, run: int) -> np.ndarray:
    """64-bit digest of the run that begins at each position (the last ones wrap and are not used)."""
    out = np.zeros(len(tokens), np.uint64)
    for k in range(run):
        out = (out ^ np.roll(tokens, -k)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _streams(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all streams of a chunk, each token's row, and whether the token is to be decided."""
    codec = pa.Codec("zstd")
    flat = [w for packed, size in zip(group["packed"], group["n_bytes"]) for w in codec.decompress(packed, int(size), asbytes=True).decode().split()]
    tokens = pd.util.hash_array(np.array(flat, dtype=object), categorize=True).astype(np.uint64) if flat else np.zeros(0, np.uint64)
    sizes = group["n_tokens"].to_numpy()
    before = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return tokens, np.repeat(np.arange(len(group)), sizes), np.arange(len(tokens)) - before < np.repeat(group["n_open"].to_numpy(), sizes)


def extract_pages(pages: DataFrame, run: int = RUN_TOKENS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text`` of every page; null html gives an empty text.

    Pages are compared within their host (lower case, empty without a url). A host of many tokens is split into chunks
    by a hash of the page; runs that repeat between chunks are found by joining run digests, so no host is one task.
    Rows that repeat id, url and html are one page, which does not repeat itself. Other columns are left out.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                split = [page_blocks(p) for p in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:3], pa.array([s[0] for s in split], pa.list_(pa.string())), pa.array([s[1] for s in split], pa.list_(pa.int32())),
                    pa.array([s[2] for s in split]), pa.array([s[3] for s in split], pa.list_(pa.string())),
                    pa.array([sum(len(b.split()) for b in [*s[0], *s[3]]) for s in split], pa.int64()),
                    pa.array([sum(len(s[0][n].split()) for n in s[1]) for s in split], pa.int64())],
                    ["id", "url", "page", "main", "open", "told", "other", "n_tokens", "n_open"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each page's stream as compressed text; the tokens to decide on come first."""
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            texts = []
            for at in range(batch.num_rows):
                main, undecided, other = (batch.column(n)[at].as_py() for n in (2, 3, 4))
                first = set(undecided)
                text = "\n".join([*(main[n] for n in undecided), *other, *(t for n, t in enumerate(main) if n not in first)]).encode()
                texts.append((codec.compress(text, asbytes=True), len(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t for t, _ in texts], pa.binary()), pa.array([n for _, n in texts], pa.int64()),
                                              *batch.columns[5:]], ["host", "page", "packed", "n_bytes", "n_tokens", "n_open"])

    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                          F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, url_col, html_col)]).alias("page"), F.col(f"`{html_col}`").alias("html"))
    parsed = materialize(source.mapInArrow(parse, f"id {kinds[0]}, url {kinds[1]}, page long, main array<string>, open array<int>, told boolean, other array<string>, n_tokens long, n_open long"), "pages")

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)), F.lit(""))
    streams = parsed.filter("n_tokens > 0").select(host.alias("host"), "page", "main", "open", "other", "n_tokens", "n_open")
    if not parsed.groupBy("page").count().filter("count > 1").isEmpty():
        streams = streams.dropDuplicates(["page"])
    hosts = streams.groupBy("host").agg(F.ceil(F.sum("n_tokens") / CHUNK_TOKENS).alias("chunks"), F.max(F.col("n_open") > 0).alias("some_open"))
    hosts = materialize(hosts, "hosts")  # a plain table, so that adaptive execution can split the pages of a large host
    packed = streams.mapInArrow(pack, "host string, page long, packed binary, n_bytes long, n_tokens long, n_open long")
    chunked = packed.join(hosts, "host").withColumn("chunk", F.pmod(F.xxhash64("page", F.lit(1)), F.col("chunks")))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        """Starts of repeated runs to decide on; in split hosts with any such, the digests of all runs (page of the first place)."""
        tokens, row, is_open = _streams(group)
        starts = repeated_starts(tokens, row, run)
        page = group["page"].to_numpy()
        inner = np.flatnonzero(starts & is_open)
        found = pd.DataFrame({"page": page[row[inner]], "at": inner, "digest": 0, "chunk": -1, "open": True})
        if len(tokens) >= run and group["chunks"].iloc[0] > 1 and group["some_open"].iloc[0]:
            digests = _digest(tokens, run).view(np.int64)
            whole = np.zeros(len(tokens), bool)
            whole[:len(tokens) - run + 1] = row[:len(tokens) - run + 1] == row[run - 1:]
            once = np.zeros(len(tokens), bool)
            once[np.unique(np.where(whole, digests, digests[0]), return_index=True)[1]] = True
            # every place to decide on that is not yet known, one place of any other run
            there = np.flatnonzero(whole & (is_open & ~starts | once))
            more = pd.DataFrame({"page": page[row[there]], "at": there, "digest": digests[there], "chunk": group["chunk"].iloc[0], "open": is_open[there]})
            found = pd.concat([found, more])
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(group)))]) if len(row) else np.zeros(len(group) + 1, int)
        place = dict(zip(page, first))
        found["at"] = found["at"] - found["page"].map(place).fillna(0).astype("int64")
        found["host"] = group["host"].iloc[0]
        return found[["host", "page", "at", "digest", "chunk", "open"]]

    # dealt by host and chunk, as the join may have left a whole host in one task
    runs = chunked.repartition("host", "chunk").groupBy("host", "chunk").applyInPandas(search, "host string, page long, at long, digest long, chunk long, open boolean")
    runs = materialize(runs, "runs")
    across = runs.filter("chunk >= 0")
    common = across.groupBy("host", "digest").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a < b").select("host", "digest")
    covered = runs.filter("chunk < 0").select("page", "at").union(across.filter("open").join(common, ["host", "digest"]).select("page", "at")).distinct()
    covered = covered.groupBy("page").agg(F.collect_list("at").alias("starts"))  # one page's tokens at most

    def keep(main: pd.Series, undecided: pd.Series, told: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([decide(list(m), list(u), t, s, run) for m, u, t, s in zip(main, undecided, told, starts)], dtype=object)

    whole = parsed.filter("size(open) = 0").select("id", "url", F.array_join("main", "\n\n").alias("text"))
    some = parsed.filter("size(open) > 0").select("id", "url", "page", "main", "open", "told").join(covered, "page", "left")
    decided = some.select("id", "url", F.pandas_udf(keep, "string")("main", "open", "told", "starts").alias("text"))
    return whole.unionByName(decided).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def decide(main: list[str], undecided: list[int], told: bool, starts, run: int = RUN_TOKENS) -> str:
    """The text of a page from its blocks, those to be decided on among them, and the starts of repeated runs in the latter."""
    if not told:
        return unique_runs(main, starts, run)
    sizes = [len(main[n].split()) for n in undecided]
    gone = np.zeros(sum(sizes) + run, bool)
    for start in ([] if starts is None else starts):
        if start < sum(sizes):
            gone[start:start + run] = True
    ends = np.cumsum(sizes)
    lost = {n for n, size, end in zip(undecided, sizes, ends.tolist()) if gone[end - size:end].all()}
    return "\n\n".join(t for n, t in enumerate(main) if n not in lost)


def unique_runs(loose, starts, run: int = RUN_TOKENS) -> str:
    """The blocks without the tokens that runs from ``starts`` cover; blocks that lose all tokens go."""
    sizes = [len(b.split()) for b in loose]
    gone = np.zeros(sum(sizes) + run, bool)
    for start in ([] if starts is None else starts):
        if start < sum(sizes):
            gone[start:start + run] = True
    out, at = [], 0
    for block, size in zip(loose, sizes):
        lost = gone[at:at + size]
        text = block if not lost.any() else " ".join(w for w, g in zip(block.split(), lost.tolist()) if not g)
        if text:
            out.append(text)
        at += size
    return "\n\n".join(out)
