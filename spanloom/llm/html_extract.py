"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: tags, told apart by the path of elements that
leads to them, and the text of each block.

1. Occurrence vectors: for each host and tag token, in how many of its pages it
   occurs and how often (a hash of the whole vector, summed before the
   shuffle); the same over all hosts.  Texts are tokens too, by their hash.
2. Tokens of one vector form an equivalence class.  A class is valid if its
   tokens occur in almost all pages of the host and once in each.  Its open
   tags nest by their paths into the host's template, and what lies between
   them are slots.
3. A slot's share of text that is not itself a template token (the same in most
   pages of the host) tells content from chrome.  The deepest valid element
   that holds most of it and is no chrome by its name is the core.  The main
   slot is the highest element around the core that is its article or main, or
   adds no more template text than other text; of several with the same text
   the deepest.  A host of fewer than LEAST_PAGES pages takes the template of
   all hosts.
4. Extraction reads each whole page again and joins the blocks of its main
   slot, less the template's own texts (blocks that almost all pages of the host
   have at the same path) and nested chrome.  A page whose main slot is missing
   falls back on its article, main or body.

Tokens are counted per host before the shuffle, and the table of main paths has
a row for each host that differs from the common one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import fresh, materialize, small_side

LEAST_PAGES = 5
#: Share of a host's pages that a template token occurs in at least.
ALMOST_ALL = 0.9
#: Elements of no block of their own.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q ruby rt rp s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noembed iframe noframes".split())
#: Elements that never hold main text.
CHROME = frozenset("head header footer nav aside menu form button select option fieldset dialog script style noscript template svg math canvas object embed iframe audio video map title textarea input".split())
#: Names in class, id or role of elements that never hold main text.
CHROME_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets contentinfo complementary".split())
#: Start tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_BREAKS = re.compile("[>\"']")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Elements whose class, id and role say nothing of chrome, and code, in which they are marks of syntax.
_NAMELESS, _CODE = frozenset("html body article main".split()), frozenset("pre code".split())
#: Elements nested deeper than this share the path of this level; their texts stay.
DEEPEST = 256


class Scanner:
    """The tags of a page, in one pass; ``at`` may be moved ahead.

    A < that starts no tag, or has no > behind it, is text.  Quotes hide a >;
    once a tag has none outside of quotes, quotes no longer count.
    """

    def __init__(self, page: str):
        self.page, self.at, self.quoted, self.last = page, 0, True, page.rfind(">")

    def next(self) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, closes) of the next tag; comments and declarations have no name."""
        page = self.page
        while True:
            start = page.find("<", self.at)
            if start < 0:
                return None
            m = _PLAIN.match(page, start)
            if m:
                self.at = m.end()
                return start, self.at, m[2].lower(), m[3], m[1] == "/"
            for mark, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(mark, start):
                    end = page.find(stop, start + len(mark))
                    self.at = len(page) if end < 0 else end + len(stop)
                    return start, self.at, "", "", False
            if start > self.last:
                return None
            if page[start + 1] in "!?":
                self.at = page.index(">", start) + 1
                return start, self.at, "", "", False
            m = _NAME.match(page, start + 1)
            if not m:
                self.at = start + 1
                continue
            self.at = self._close(m.end())
            return start, self.at, m[1].lower(), page[m.end() : self.at - 1], page[start + 1] == "/"

    def _close(self, at: int) -> int:
        """Place after the > that ends the tag whose name ends at ``at``."""
        end = at
        while self.quoted:
            m = _BREAKS.search(self.page, end)
            if not m:
                self.quoted = False
            elif m[0] == ">":
                return m.end()
            else:
                end = self.page.find(m[0], m.end()) + 1
                self.quoted = end > 0
        return self.page.index(">", at) + 1


def _is_chrome(tag: str, attributes: str) -> str:
    """Why an element never holds main text: "sure", or "name", which a wrapper of the article may have too; else nothing."""
    if tag in CHROME and tag != "form":
        return "sure"
    named = tag == "form"
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value.strip() == "true" or key == "style" and _UNSEEN.search(value):
            return "sure"
        named = named or key in ("class", "id", "role") and tag not in _NAMELESS and not CHROME_NAMES.isdisjoint(value.split())
    return "name" if named else ""


class Element:
    """An open element: its tag, whether it is chrome, and by name only, how many are chrome otherwise down to it, its number, path and level, and the text in front of it."""

    __slots__ = ("tag", "chrome", "named", "sure", "number", "path", "level", "text")

    def __init__(self, tag: str, chrome: bool, named: bool, sure: int, number: int, path: str, level: int):
        self.tag, self.chrome, self.named, self.sure, self.number, self.path, self.level, self.text = tag, chrome, named, sure, number, path, level, 0


def wrappers(page: str, tags: list[tuple[int, int, str, bool, bool, str, int]]) -> frozenset[int]:
    """Numbers of the elements, chrome by name only, around the article or main of a page that has none elsewhere; of a page without any, those around its only h1s or over half of its text."""
    if not any(why == "name" for *_, why, _ in tags):
        return frozenset()
    free: set[int] = set()
    heads: list[tuple[int, ...]] = []
    mass: Counter = Counter()
    seen = 0

    def named(stack: list[Element]) -> tuple[int, ...]:
        return tuple(e.number for e in stack if e.named)

    found = False
    for kind, stack, value, _ in _walk(page, tags, frozenset()):
        sure = stack[-1].sure if stack else 0
        if kind == "text" and not sure:
            seen += len(value.strip())
        elif kind == "open" and not sure and value in ("article", "main", "h1"):
            around = named(stack[:-1])
            if value == "h1":
                heads.append(around)
            elif not around:
                return frozenset()
            else:
                found = True
                free.update(around)
        elif kind == "shut" and stack[-1].named:
            mass[stack[-1].number] += seen - stack[-1].text
        if kind == "open" and stack:
            stack[-1].text = seen
    if not found:
        free = {n for names in heads for n in names} if all(heads) else set()
        free |= {n for n, size in mass.items() if 2 * size > seen}
    return frozenset(free)


def tape(page: str) -> list[tuple[int, int, str, bool, bool, str, int]]:
    """(start, end, tag, whether it stands alone, closes, why chrome, place from which to read on) of each tag of a page."""
    out = []
    scanner = Scanner(page)
    while found := scanner.next():
        start, end, tag, attributes, closes = found
        if tag in RAW and not closes:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
            scanner.at = close.end() if close else len(page)
        out.append((start, end, tag, tag in VOID or tag in RAW or attributes.endswith("/"), closes, "" if closes or not tag else _is_chrome(tag, attributes), scanner.at))
    return out


def _walk(page: str, tags: list[tuple[int, int, str, bool, bool, str, int]], free: frozenset[int]) -> Iterator[tuple[str, list[Element], str, int]]:
    """Events of a page, with the stack of open elements and the number of those that are chrome: ("text", text), ("open", tag), ("shut", tag) before an element leaves the stack, and ("end", tag) for an end tag.  Elements numbered in ``free`` are no chrome by name."""
    stack: list[Element] = []
    depth, at, number, code, whole = 0, 0, 0, 0, 0

    def leave(k: int) -> Iterator[tuple[str, list[Element], str, int]]:
        nonlocal depth, code, whole
        while len(stack) > k:
            yield "shut", stack, stack[-1].tag, depth
            e = stack.pop()
            depth -= e.chrome
            code -= e.tag in _CODE
            whole -= e.tag == "article"

    open_tags: Counter = Counter()
    for start, _, tag, alone, closes, why, after in tags:
        if start > at:
            yield "text", stack, page[at:start], depth
        at = after
        if not tag:
            continue
        if closes:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                for e in stack[k:]:
                    open_tags[e.tag] -= 1
                yield from leave(k)
            yield "end", stack, tag, depth
            continue
        for names, through in ((_P, INLINE), (CLOSES.get(tag, _NONE), _INLINE_P)) if tag in CLOSES_P or tag in CLOSES else ():
            if names is _P and tag not in CLOSES_P or not any(open_tags[n] for n in names):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in names:
                    for e in stack[k:]:
                        open_tags[e.tag] -= 1
                    yield from leave(k)
                    break
                if stack[k].tag not in through:
                    break
        number += 1
        if tag == "header" and whole:
            why = ""  # the head of an article is part of it
        chrome = bool(why) and number not in free and (why == "sure" or not code or tag == "form")
        above = stack[-1] if stack else None
        level = above.level + 1 if above else 1
        path = (f"{above.path}/{tag}" if above else tag) if level <= DEEPEST else above.path
        sure = (above.sure if above else 0) + (chrome and why == "sure")
        stack.append(Element(tag, chrome, chrome and why == "name", sure, number, path, min(level, DEEPEST)))
        depth += chrome
        code += tag in _CODE
        whole += tag == "article"
        yield "open", stack, tag, depth
        if alone:
            yield from leave(len(stack) - 1)
        else:
            open_tags[tag] += 1
    if at < len(page):
        yield "text", stack, page[at:], depth
    yield from leave(0)


_P, _NONE, _INLINE_P = frozenset("p".split()), frozenset(), INLINE | {"p"}


def units(page: str) -> Iterator[tuple[str, str, str, int]]:
    """("tag", path, tag, chrome) for each open tag of a block and ("block", path, text, chrome) for each text block, in page order; paths are of block elements only."""
    parts: list[str] = []
    where, hidden = "", 0

    def block() -> Iterator[tuple[str, str, str, int]]:
        raw = "".join(parts)
        parts.clear()
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            yield "block", where, text, hidden

    tags = tape(page)
    for kind, stack, value, chrome in _walk(page, tags, wrappers(page, tags)):
        if kind == "text":
            if parts and bool(chrome) != bool(hidden):
                yield from block()
            if not parts:
                k = len(stack) - 1
                while k >= 0 and stack[k].tag in INLINE:
                    k -= 1
                where, hidden = stack[k].path if k >= 0 else "", chrome
            parts.append(value)
        elif value == "br":
            if parts:
                parts.append(" ")
        elif value not in INLINE or kind == "open" and chrome:
            if parts:
                yield from block()
            if kind == "open" and value not in INLINE:
                yield "tag", stack[-1].path, value, chrome
    yield from block()


def inside(path: str, main: str | None) -> bool:
    return not main or path == main or path.startswith(f"{main}/")


def blocks(page: str, main: str | None, template: frozenset[int] = frozenset()) -> list[str]:
    """The text blocks within the elements of path ``main`` (None: the whole page), without chrome and without blocks of the template.

    If most of the text is the template's, the pages are copies of each other, and it stays.
    """
    found = [(text, bool(template) and text_hash(path, text) in template) for kind, path, text, chrome in units(page) if kind == "block" and not chrome and inside(path, main)]
    fixed = sum(len(t) for t, known in found if known)
    drop = 2 * fixed < sum(len(t) for t, _ in found)
    return [t for t, known in found if not (known and drop)]


def text_hash(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}") >> 1


def _tokens(page: str) -> tuple[Counter, Counter]:
    """Numbers of the tag tokens (paths of block elements) and of the text blocks (path, hash) with their sizes."""
    tag_tokens: Counter = Counter()
    texts: Counter = Counter()
    for kind, path, value, chrome in units(page):
        if kind == "tag":
            tag_tokens[path + ("!" if chrome else "")] += 1
        else:
            texts[path, text_hash(path, value), len(value), bool(chrome)] += 1
    return tag_tokens, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags: dict = {}
        texts: dict = {}
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            a, b = _tokens(page)
            seen = xxhash.xxh64_intdigest(page)
            for token, n in a.items():
                x = tags.setdefault((host, token), [0, 0, 0])
                x[0] += 1
                x[1] += n
                x[2] = (x[2] + xxhash.xxh64_intdigest(f"{seen}:{n}")) & (2**62 - 1)
            for (path, h, size, chrome), n in b.items():
                x = texts.setdefault((host, path, h), [0, size * n, chrome])
                x[0] += 1
        rows = [(host, token, None, x[0], x[1], x[2], 0) for (host, token), x in tags.items()]
        rows += [(host, path, h, x[0], 0, 0, 0 if x[2] else x[1]) for (host, path, h), x in texts.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["host", "token", "text", "pages", "n", "vector", "size"])


#: Stands for all hosts together.
_ALL = "*"


def deduce(pages: DataFrame, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, str]:
    """(host, path, texts) of the hosts whose main slot differs from that of all pages or that have template texts, and the path of the main slot of all pages."""
    made = pages.mapInArrow(_count, "host string, token string, text bigint, pages bigint, n bigint, vector bigint, size bigint")
    made = made.groupBy("host", "token", "text").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.max("size").alias("size"))
    made = materialize(made, "tokens")
    total = materialize(pages.groupBy("host").agg(F.count("*").alias("all")), "hosts")
    everywhere = made.groupBy("token", "text").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("vector").alias("vector"), F.max("size").alias("size")).withColumn("host", F.lit(_ALL))
    whole = total.agg(F.sum("all").alias("all")).withColumn("host", F.lit(_ALL))

    def slots(tokens: DataFrame, number: DataFrame) -> DataFrame:
        """The main slot of each host: from the deepest valid element with most of the text that isn't itself template up to the one that has the whole article."""
        t = tokens.join(number, "host")
        found = t.where("text is null")
        classes = found.groupBy("host", "pages", "vector").agg(F.count("*").alias("class"))
        valid = found.where(f"pages >= {ALMOST_ALL} * all and n = pages and token not like '%!'").join(classes, ["host", "pages", "vector"]).where("class >= 2")
        valid = valid.select("host", F.col("token").alias("slot"))
        lone = F.expr("pages < 3 or pages < 0.5 * all")
        mass = F.col("size") * F.col("pages")
        chars = t.where("text is not null and size > 0").groupBy("host", "token").agg(F.sum(F.when(lone, mass).otherwise(0)).alias("chars"), F.sum(F.when(lone, 0).otherwise(mass)).alias("fixed"))
        held = chars.select("host", "chars", "fixed", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("token", "/"))), lambda k: F.array_join(F.slice(F.split("token", "/"), F.lit(1), k), "/"))).alias("slot")).groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("fixed").alias("fixed")).where("chars > 0")
        best = valid.join(held, ["host", "slot"]).select("host", F.size(F.split("slot", "/")).alias("deep"), "slot", "chars", "fixed")
        most = best.groupBy("host").agg(F.max("chars").alias("most"))
        core = best.join(most, "host").where("chars >= 0.95 * most").groupBy("host").agg(F.max(F.struct("deep", "slot", "chars", "fixed")).alias("core"))
        named = F.expr("coalesce(nullif(regexp_extract(core.slot, '^(?:.*?/)?article(?=/|$)', 0), ''), regexp_extract(core.slot, '^(?:.*?/)?main(?=/|$)', 0))")
        chain = best.join(core, "host").where("startswith(concat(core.slot, '/'), concat(slot, '/'))")
        step = F.struct("deep", "slot", "chars", "fixed", (F.col("slot") == named).alias("named"))
        chain = chain.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(step))).alias("up"))
        higher = lambda x, y: F.when(y["named"] | (y["fixed"] - x["fixed"] <= y["chars"] - x["chars"]), y).otherwise(x)
        chain = chain.withColumn("top", F.aggregate("up", F.element_at("up", 1), higher))
        same = F.filter("up", lambda x: (x["chars"] == F.col("top.chars")) & (x["fixed"] == F.col("top.fixed")))
        return chain.select("host", F.array_max(same)["slot"].alias("path"))

    common = slots(everywhere, whole).collect()  # one row
    path = common[0].path if common else ""
    known = total.where(F.col("all") >= least_pages)
    own = slots(made, known).where(F.col("path") != path)
    fixed = made.join(known, "host").where(f"text is not null and size > 0 and pages >= {ALMOST_ALL} * all").groupBy("host").agg(F.collect_set("text").alias("texts"))
    return own.join(fixed, "host", "full").select("host", "path", "texts"), path


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with main_text: the blocks of the main slot of each page, in page order, two line feeds between.

    A null page is empty.  Pages of null or odd URLs are a host of their own.
    White space in a block is one space; character references are decoded once.
    Repeated rows are extracted one by one, but count as pages of their host.
    Pages are read whole, in time in proportion to their length whatever their
    markup; elements nested deeper than DEEPEST levels count as of that level.
    An empty table gives an empty one.  A column named main_text is replaced;
    others pass through, whatever their names.  ``least_pages``: a host of
    fewer pages shows no template of its own.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    own, common = deduce(pages.select(host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")), least_pages)
    at, name, path, texts = fresh(pages, "at", "name", "path", "texts")
    own = materialize(own.select(F.col("host").alias(name), F.col("path").alias(path), F.col("texts").alias(texts)), "paths")

    @F.arrow_udf("string")
    def extract(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, paths, fixed in columns:
            out = []
            for page, main, known in zip(htmls.to_pylist(), paths.to_pylist(), fixed.to_pylist(), strict=True):
                found = blocks(page, main, frozenset(known or ())) if page and main else []
                out.append("\n\n".join(found or (by_name(page, frozenset(known or ())) if page else [])))
            yield pa.array(out, pa.string())

    joined = pages.withColumn(at, host).join(small_side(own), F.col(at) == F.col(name), "left")
    return joined.withColumn("main_text", extract(F.col(html_col), F.coalesce(path, F.lit(common)), F.col(texts))).select(*[c for c in pages.columns if c != "main_text"], "main_text")


def by_name(page: str, template: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of the first kind of element, article, main or body, that has any; else of the whole page."""
    paths = [path for kind, path, _, chrome in units(page) if kind == "tag" and not chrome]
    for name in ("article", "main", "body"):
        for path in dict.fromkeys(p for p in paths if p == name or p.endswith(f"/{name}")):
            found = blocks(page, path, template)
            if found:
                return found
    return blocks(page, None, template)
