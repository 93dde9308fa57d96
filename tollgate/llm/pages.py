"""Main text of web pages: page structure, and a suffix sort of each host's token streams.

Where a page marks its article (``article``, ``main``; by the parse, so not in comments, scripts or menus), what is in it is the main text, less the
parts that are menus, notices, adverts, forms and so on by their tags or names. For a page without
such marks it is the text that is not of those parts. This is compared with the other pages of the
host: all suffixes of the host's token streams are sorted as far as their first ``RUN`` tokens, and
where those of at least ``LEAST`` texts and a share of ``SHARE`` of the host's agree that far, the
tokens are a repeated run. Repeated runs are boilerplate and are taken out; the others stay.

Texts that are the same, or nearly, count as one, so copies and versions don't make each other
boilerplate: texts are told apart by the least of their runs' hashes, under each of three hash
functions, and what has most texts of the three counts. From a marked article runs are only taken if
they are no more than ``MOST`` of its tokens; an article that mostly repeats others is one of several
versions. A block shorter than a run goes only as part of a longer one.

The streams of a host are not sorted in one place. Suffixes that agree in ``RUN`` tokens have equal
hashes of these, so grouping by hash brings together what a suffix array has side by side.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import held, in_arrow
from tollgate.llm.urls import host_of
from tollgate.session import let_workers_import

RUN = 8
SHARE = 0.3  # of a host's texts
LEAST = 4  # texts
MOST = 0.3  # of a marked article's tokens
PARTS = 32  # of a host's values, at least
PART_PAGES = 200_000  # and no part has those of more pages
IDENTITIES = 3
SENT = 1 << 18  # as many repeated runs go to all executors, more are joined by host

# --- fixed values: HTML elements by what they mean here, and names that pages give to parts
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead
    title tr ul""".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg select annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form menu dialog button label input datalist audio video canvas head".split())
CHROME_IN_CORE = CHROME - {"label"}
CORE = frozenset("article main".split())
WRAPPED = frozenset("article main nav header footer".split())  # a form around one of these is the page's, not a part of it
HEAD = frozenset("head html title base link meta style script noscript template".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager
    pagination paywall popup promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar
    topbar widget""".split())
CONTAINERS = frozenset("aside details div dl fieldset footer header ol section table ul".split())
SURE_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs cookie cookies disqus gdpr newsletter
    pagination paywall share sharing sponsored subscribe""".split())
PART_WORDS = frozenset("""area bar block bottom box button buttons center container content form group inner item items left link links list
    module outer panel post posts right section slot text title top unit wrap wrapper""".split())
WRAPPER_WORDS = frozenset("has with no without main content wrapper container layout body article".split())
# --- end of fixed values

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z0-9]+")
MAIN_ROLE = re.compile(r"""(?i)\brole\s*=\s*["']?main\b""")


def names_chrome(word: str) -> bool:
    """Whether a class or id says so by its first or last part (``ad-top``, ``site_nav``), and isn't what wraps a page (``has-sidebar``)."""
    parts = NAME.findall(word)
    return bool(parts) and not CHROME_NAMES.isdisjoint((parts[0], parts[-1])) and (len(parts) == 1 or WRAPPER_WORDS.isdisjoint(parts))


def names_only(names: frozenset[str], word: str) -> bool:
    """Whether all parts of a class or id say so (``ad-top``, ``related-posts``), and none something else (``banner-history``)."""
    parts = [part.rstrip("0123456789") for part in NAME.findall(word)]
    return not names.isdisjoint(parts) and all(part in names or part in PART_WORDS or not part for part in parts)


def is_chrome(tag: str, attributes: str, in_core: bool, in_code: bool = False) -> bool:
    """Whether an element with such a tag is no part of the text, by its tag, role, names, or being hidden.

    In an article names count for blocks only, if they say nothing else, and nowhere in code; those that
    may be about something else, such as ``notice``, for containers of blocks only.
    """
    if tag in (CHROME_IN_CORE if in_core else CHROME) or tag == "header" and not in_core:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            if in_core:
                names = frozenset() if in_code or tag not in BLOCKS else CHROME_NAMES if tag in CONTAINERS else SURE_NAMES
                if any(names_only(names, word) for word in value.split()):
                    return True
            elif any(names_chrome(word) for word in value.split()):
                return True
        elif name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> tuple[list[str] | None, list[tuple[str, bool]]]:
    """The page's blocks: those in its article (None if it marks none), and the others, each with whether it is a menu or such.

    An article inside a menu or such is part of that and marks nothing. A form is no part of the
    text unless it encloses the article or other sections of the page, or all text there is.
    """
    core: list[str] | None = None
    outer: list[tuple[str, bool, tuple[int, ...]]] = []  # text, chrome, the forms it is in
    waiting: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, chrome, core
    forms: list[int] = []  # where in the page the open forms outside the article begin
    wrappers: set[int] = set()
    chrome = main = 0
    in_head = False
    at = 0

    def close() -> None:
        if waiting:
            text = " ".join("".join(waiting).split())
            waiting.clear()
            if text and main and not chrome:
                core.append(text)
            elif text and not main:
                outer.append((text, bool(chrome), tuple(forms)))

    def pop(index: int) -> None:
        nonlocal chrome, main
        for tag, hides, centres in stack[index:]:
            chrome -= hides
            main -= centres
            if tag == "form" and not hides:
                forms.pop()
        del stack[index:]

    def end_head() -> None:
        """Its end tag may be left out: the first thing that can't be in it ends it."""
        for index, (tag, _, _) in enumerate(stack):
            if tag == "head":
                close()
                pop(index)
                break

    size = len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            if in_head and not page[at:mark].isspace():
                in_head = False
                end_head()
            waiting.append(entities.unescape(page[at:mark]))
        if mark == size:
            break
        found = TAG.match(page, mark)
        if not found:  # a bare "<"
            waiting.append("<")
            at = mark + 1
            continue
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if in_head and not found[1] and tag not in HEAD:
            in_head = False
            end_head()
        if tag in BLOCKS:
            close()
        elif tag in ("br", "td", "th", "option"):
            waiting.append(" ")
        if found[1]:
            in_head = in_head and tag != "head"
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] == tag:
                    if any(hides or centres or t in BLOCKS for t, hides, centres in stack[index:]):
                        close()
                    pop(index)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or found[3].endswith("/"):
            continue
        if tag in BLOCKS and stack and stack[-1][0] in ("p", "li") and (tag != "ul" and tag != "ol" or stack[-1][0] == "p"):
            close()
            pop(len(stack) - 1)  # these end where the next block begins
        encloses = tag == "form" and not main and not chrome and not is_chrome("div", found[3], False)
        hides = not encloses and is_chrome(tag, found[3], main > 0, main > 0 and any(t in ("pre", "code") for t, _, _ in stack))
        centres = not hides and (tag in CORE or MAIN_ROLE.search(found[3]) is not None)
        if hides or centres or encloses:
            close()
        if encloses:
            forms.append(mark)
        elif (centres or tag in WRAPPED) and not chrome and not main:
            wrappers.update(forms)
        in_head = in_head or tag == "head"
        if hides or centres or encloses or tag not in ("p", "li", "b", "i", "a", "span", "em", "strong"):
            stack.append((tag, hides, centres))
            chrome += hides
            main += centres
            if main and not chrome and core is None:
                core = []
    close()
    whole = not any(not hides and wrappers.issuperset(inside) for _, hides, inside in outer)  # nothing but what forms hold
    return core, [(text, hides or not (whole or wrappers.issuperset(inside))) for text, hides, inside in outer]


def kept_blocks(page: str) -> list[str]:
    """The blocks of its article, or of a page without one those that are of no menu or such."""
    core, outer = blocks(page)
    return core if core is not None else [text for text, hides in outer if not hides]


def _rolled(tokens: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` tokens from each on that has so many, of the tokens' hashes."""
    last = len(tokens) - size + 1
    out = np.zeros(max(0, last), np.uint64)
    if last > 0:
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + last]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _suffixes(found: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix of the page's tokens: the hash of its first ``run`` tokens, and the least hash of half as many in these.

    Pages that have a run in common have its least hash in common, and suffixes next to each other
    mostly have the same, so there are fewer of these to count.
    """
    tokens = np.fromiter((xxhash.xxh64_intdigest(t) for text in found for t in text.split(" ")), np.uint64)
    starts = _rolled(tokens, run)
    half = max(1, run // 2)
    parts = _rolled(tokens, half)
    least = parts[: len(starts)]
    for k in range(1, run - half + 1):
        least = np.minimum(least, parts[k : k + len(starts)])
    return starts.view(np.int64), least


def identities(found: list[str], starts: np.ndarray) -> list[int]:
    """What a text counts by: of texts that have most runs in common two of three are the same, of others none."""
    if not len(starts):
        return [xxhash.xxh64_intdigest("\n\n".join(found)) - (1 << 63)] * IDENTITIES
    hashes = starts.view(np.uint64)
    turned = [(hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9) for k in range(1, IDENTITIES + 1)]
    return [int((t ^ (t >> np.uint64(29))).min().view(np.int64)) for t in turned]


def _of_pages(pages: DataFrame, columns: str, of_some) -> DataFrame:
    """The rows that ``of_some`` gives for a few pages (lists of their hosts, html, runs) at a time."""
    names = [c.split()[0] for c in columns.split(", ")]

    def parse(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = list(of_some(*(c.to_pylist() for c in batch.slice(at, 2048).columns)))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema=wanted)

    wanted = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]]) for n, c in zip(names, columns.split(", "))])
    return in_arrow(pages, parse, columns)


def _sent(by_host: DataFrame) -> DataFrame:
    """``host``, ``runs`` (written), for a join by host: to all executors if there are few."""
    runs = held(by_host)
    return F.broadcast(runs) if (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= SENT else runs


def repeated_runs(pages: DataFrame, run: int = RUN, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``host``, ``runs``: hashes of the ``run`` tokens that at least ``least`` and a ``share`` of a host's texts have.

    Pages with the same text, or nearly, count once. What can't be repeated so often is left out first: the
    least hashes of all runs are counted by host in packed form, with copies, so none is missed.
    """
    parts = max(PARTS, pages.count() // PART_PAGES)

    def count(hosts, pages):
        by_host: dict[str, list[np.ndarray]] = {}
        for host, html in zip(hosts, pages):
            found = kept_blocks(html)
            starts, low = _suffixes(found, run)
            yield host, -1, identities(found, starts), None
            by_host.setdefault(host, []).append(np.unique(low))
        for host, each in by_host.items():
            values = np.concatenate(each)
            number = (values >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(number, kind="stable")
            values, ends = values[order].astype(np.uint32), np.searchsorted(number[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                yield host, k, None, values[ends[k] : ends[k + 1]].tobytes()

    seen = held(_of_pages(pages.select("host", "html"), "host string, part int, copy array<bigint>, packed binary", count))
    distinct = F.greatest(*[F.count_distinct(F.col("copy")[k]) for k in range(IDENTITIES)])
    texts = seen.where("part < 0").groupBy("host").agg(distinct.alias("texts"))
    wanted = held(texts.select("host", F.greatest(F.lit(least).cast("bigint"), F.ceil(F.col("texts") * share)).alias("wanted")).where(F.col("texts") >= least))

    def often(table: pa.Table) -> pa.Table:
        values, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in table["packed"].to_pylist()]), return_counts=True)
        values, n = values[n >= least], n[n >= least]
        return pa.table({"host": pa.array([table["host"][0].as_py()] * len(values), pa.string()), "run": pa.array(values.astype(np.int64)), "n": pa.array(n)})

    let_workers_import(pages.sparkSession)
    values = seen.where("part >= 0").groupBy("host", "part").applyInArrow(often, "host string, run bigint, n bigint")
    maybe = _sent(values.join(wanted, "host").where("n >= wanted").groupBy("host").agg(F.collect_list("run").alias("runs")))

    def again(hosts, pages, runs):
        for host, html, known in zip(hosts, pages, runs):
            found = kept_blocks(html)
            starts, low = _suffixes(found, run)
            copy = identities(found, starts)
            for value in np.unique(starts[np.isin(low.astype(np.uint32), np.array(known, np.uint32))]).tolist():
                yield host, copy, value

    rows = _of_pages(pages.join(maybe, "host").select("host", "html", "runs"), "host string, copy array<bigint>, run bigint", again)
    runs = rows.groupBy("host", "run").agg(distinct.alias("n")).join(wanted, "host").where("n >= wanted")
    return runs.groupBy("host").agg(F.collect_list("run").alias("runs"))


def unique_runs(found: list[str], runs: list[int], run: int = RUN, most: float = 1.0) -> list[str]:
    """The blocks without the tokens of ``runs``. Of a block go ``run`` tokens or more in a row, or all; nothing if that is more than ``most`` of all tokens."""
    starts = np.flatnonzero(np.isin(_suffixes(found, run)[0], np.array(runs, np.int64)))
    if not len(starts):
        return found
    split = [text.split(" ") for text in found]
    hit = np.zeros(sum(map(len, split)) + 1, bool)
    for k in range(run):
        hit[starts + k] = True
    out, at, gone = [], 0, 0
    for tokens in split:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[at : at + len(tokens)], [False])).astype(np.int8))).tolist()
        at += len(tokens)
        keep = np.ones(len(tokens), bool)
        for begin, end in zip(edges[::2], edges[1::2]):
            if end - begin >= min(run, len(tokens)):
                keep[begin:end] = False
        out.append(" ".join(t for t, k in zip(tokens, keep) if k))
        gone += int((~keep).sum())
    return [text for text in out if text] if gone <= most * at else found


def _keyed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select("page_id", F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), html.alias("html"))


def main_text(pages: DataFrame, run: int = RUN, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` of each row of ``pages``: its blocks joined by an empty line, empty if it has none.

    Character references are decoded, white space in a block becomes one space. A null html is
    empty; a null or hostless url belongs to the host without a name. Pages with the same text, or
    nearly, don't make each other's boilerplate. Html that ends early or nests wrongly is read as far
    as it goes. Repeated rows and null ids are kept, other columns ignored; an empty table gives no
    rows. A page of any length is read whole, in one task, as one value.
    """
    rows = _keyed(pages, url_col, html_col)
    kinds = pages.schema
    schema = T.StructType().add("page_id", kinds["page_id"].dataType).add("url", "string").add("text", "string")

    def texts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for page, runs in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    core, outer = blocks(page)
                    kept = [text for text, hides in outer if not hides] if core is None else core
                    found.append("\n\n".join(unique_runs(kept, runs, run, 1.0 if core is None else MOST) if runs else kept))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    runs = _sent(repeated_runs(rows, run))
    return in_arrow(rows.join(runs, "host", "left").select("page_id", "url", "html", "runs"), texts, schema)
