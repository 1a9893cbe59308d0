"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its block elements and its blocks of text. An element's token is its path: names and classes from the root,
and for containers the place among siblings of the same name and class, which keeps apart what plays different roles. A text's token is its
element's and the text. The occurrence vector of a token is how often it occurs on each page of its group, a host's pages of one
layout (the set of their containers' names and classes), or all pages of the host where a layout has a single page.

Classes. Tokens with equal vectors form a class; a class is valid if it covers nine tenths of the group's pages and at least two. An element
of a valid class that occurs once a page frames the template. A class nests in a framing element that its tokens stand below and
whose pages are its own pages; text that nests so, and with it nine tenths of what its element holds, is template text. What no
class explains is free text, the contents of the slots. The main slot is the innermost framing container that holds most (six tenths) of the
free text, widened while a container around it adds only headings.

A page's main text is the text of its main slot less template text. Within the slot, what markup itself calls no article (nav, form, aside,
a class such as `comments`) is left out; that is all that word lists decide. Where there is nothing to compare (a host with one page, a page
whose slot holds less than a third of its free text, pages that are all alike) the same search runs on the page's own tree, within article or main elements if it has any.

Distribution: vectors are sums of hashes of (page, count), so classes come from plain partial aggregation by (host, layout, token), and a host
with a third of all pages is no hot group. Valid classes cover nine tenths of their pages, so those of a group are no more than 10/9
of the tokens of an average page: nesting them is one small task a group. Pages meet their template in a join whose template side is broadcast
only when small.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by one space in page
order. Comments, declarations, raw-text elements and unclosed tags are read as browsers read them.

Rows: null or empty html gives an empty text and n_chars 0. A null url is a host of its own. Repeated rows are pages like any other.
Markup of any depth takes memory in proportion to its length. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.shared import Scratch, small

from .words import thrifty

# Element names, and words in class, id and role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form script style noscript template button select iframe svg menu dialog head object".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption address details summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIKE_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table select body html article section div td th main".split())
UNWANTED = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|widgets?)(?:[-_\s]|$)", re.I)
WANTED = frozenset(("article", "main"))
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|title|textarea|xmp|noembed|noframes)(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>?.*?(?:</\1\s*+[^>]*>|\Z)"
    r"|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S | re.I)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
#: A class covers nine tenths of its pages.
COVER = 0.9
ELEMENT, TEXT, PAGE = 0, 1, 2


def _hash(x: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"), seed)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


class Page:
    """A page's block elements in order (parents before children) and its blocks of text.

    Elements are places in parallel lists: parent, mark (the path's hash), depth, name, outside and wanted (by markup). A block
    is (element, text, characters in links).
    """

    def __init__(self, source: str):
        self.parent, self.mark, self.depth, self.name, self.outside, self.wanted = [-1], [_hash("")], [0], [""], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        stack, opened, siblings = [0], {}, {}
        text: list[str] = []
        linked = links = at = 0

        def close() -> None:
            nonlocal linked
            if text:
                own = " ".join(entities.unescape("".join(text)).split())
                if own:
                    self.blocks.append((stack[-1], own, min(linked, len(own))))
                text.clear()
            linked = 0

        def pop(to: int) -> None:
            for i in stack[to:]:
                opened[self.name[i]] -= 1
            del stack[to:]

        def last(names: tuple[str, ...], stops: frozenset[str]) -> int:
            """Where the innermost open element of these names is, if no stop comes first; 0 if there is none."""
            if any(opened.get(x) for x in names):
                for i in range(len(stack) - 1, 0, -1):
                    if self.name[stack[i]] in names:
                        return i
                    if self.name[stack[i]] in stops:
                        break
            return 0

        for m in _TAG.finditer(source):
            if m.start() > at:
                text.append(source[at : m.start()])
                linked += (m.start() - at) * links
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    links = 0 if m[2] else 1
                continue
            close()
            if m[2]:
                if to := last((name,), frozenset()):
                    pop(to)
                    links = 0
                continue
            if name in VOID:
                continue
            if name in CLOSES_P and self.name[stack[-1]] == "p":
                pop(len(stack) - 1)
            if name in LIKE_SELF and (to := last(LIKE_SELF[name], STOPS)):
                pop(to)
            marks = {a.lower(): (b or c or d) for a, b, c, d in _MARK.findall(m[4])} if m[4] else {}
            up = stack[-1]
            wanted = self.wanted[up] or name in WANTED or marks.get("role", "").lower() == "main"
            outside = self.outside[up]
            if not (name == "header" and wanted):
                outside = outside or name in OUTSIDE or (name not in ("html", "body", "article", "main") and any(UNWANTED.search(x) for x in marks.values()))
            part = name + ("." + " ".join(_DIGITS.sub("#", marks["class"]).split()) if marks.get("class") else "")
            if name not in TEXTUAL:
                part += f"[{siblings.setdefault((up, part), 0)}]"
                siblings[up, part.rpartition("[")[0]] += 1
            stack.append(len(self.mark))
            opened[name] = opened.get(name, 0) + 1
            for column, value in ((self.parent, up), (self.mark, _hash(part, self.mark[up])), (self.depth, self.depth[up] + 1), (self.name, name), (self.outside, outside), (self.wanted, wanted)):
                column.append(value)
            links = 0
            if name == "svg" and m[4].endswith("/"):
                pop(len(stack) - 1)
        if at < len(source):
            text.append(source[at:])
            linked += (len(source) - at) * links
        close()

    def text_mark(self, block: tuple[int, str, int]) -> int:
        return _hash(block[1], self.mark[block[0]])

    def sums(self) -> list[list[int]]:
        """For every element the characters below it that markup does not exclude: all, those not in links, those in headings."""
        out = [[0, 0, 0] for _ in self.mark]
        for at, own, linked in self.blocks:
            if not self.outside[at]:
                row, n = out[at], len(own)
                row[0] += n
                row[1] += n - linked
                if self.name[at] in HEADINGS:
                    row[2] += n
        return _below(out, self.parent)


def _below(rows: list[list[int]], parent: list[int]) -> list[list[int]]:
    """Adds to every row the rows below it; parents come before children."""
    for i in range(len(rows) - 1, 0, -1):
        own, up = rows[i], rows[parent[i]]
        if own[0]:
            up[0] += own[0]
            up[1] += own[1]
            up[2] += own[2]
    return rows


def main_slot(parent: list[int], depth: list[int], container: list[bool], free: list[list[int]], order: list[int]) -> int:
    """The innermost container that holds six tenths of the free text, widened while that adds only headings; -1 without free text.

    free: for every element all free characters below it, those not in links, those in headings. `order` breaks ties.
    """
    most = max((x[1] for x in free), default=0)
    if not most:
        return -1
    best = max((i for i in range(len(parent)) if container[i] and 10 * free[i][1] >= 6 * most), key=lambda i: (depth[i], free[i][1], order[i]), default=-1)
    while best >= 0 and parent[best] >= 0 and container[parent[best]] and free[parent[best]][0] - free[best][0] <= free[parent[best]][2] - free[best][2]:
        best = parent[best]
    return best


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, page, html) -> per task: a row for each (host, layout, token), with sums over pages; see `templates`."""
    sums: dict[tuple, list[int]] = {}
    names = ["host", "layout", "kind", "token", "parent", "depth", "container", "vector", "presence", "pages", "n", "blocks", "every", "free", "heads"]

    def out() -> pa.RecordBatch:
        keys, rows = list(sums), list(sums.values())
        columns = [pa.array([k[0] for k in keys], pa.string())] + [pa.array([k[i] for k in keys], pa.int64()) for i in range(1, 7)]
        columns += [pa.array([_signed(r[i]) for r in rows], pa.int64()) for i in range(8)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for host, layout, number, source in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "page", "html"))):
            page = Page(source or "")
            below = page.sums()
            marks, containers = [_signed(x) for x in page.mark], [int(x not in TEXTUAL) for x in page.name]
            vectors: dict[int, int] = {}
            found: dict[tuple, list[int]] = {(PAGE, 0, 0, 0, 0): [1, 0, 0, 0, 0]}
            for i in range(len(page.mark)):
                up = page.parent[i]
                key = (ELEMENT, marks[i], marks[up] if up >= 0 else 0, page.depth[i], containers[i])
                row = found.get(key)
                if row is None:
                    found[key] = [1, 0, *below[i]]
                else:
                    row[0] += 1
                    row[2] += below[i][0]
                    row[3] += below[i][1]
                    row[4] += below[i][2]
            for block in page.blocks:
                at, own, linked = block
                use = not page.outside[at]
                found[ELEMENT, marks[at], marks[page.parent[at]] if at else 0, page.depth[at], containers[at]][1] += 1
                row = found.setdefault((TEXT, _signed(page.text_mark(block)), marks[at], page.depth[at] + 1, 0), [0] * 5)
                row[0] += 1
                row[2] += len(own) * use
                row[3] += (len(own) - linked) * use
                row[4] += len(own) * (use and page.name[at] in HEADINGS)
            here = _hash(f"{number}", 11)
            for key, own in found.items():
                n = own[0]
                if n not in vectors:
                    vectors[n] = _hash(f"{number} {n}", 7)
                row = sums.get((host, layout, *key))
                if row is None:
                    sums[host, layout, *key] = [vectors[n], here, 1, *own]
                else:
                    row[0] += vectors[n]
                    row[1] += here
                    row[2] += 1
                    row[3] += n
                    row[4] += own[1]
                    row[5] += own[2]
                    row[6] += own[3]
                    row[7] += own[4]
        if len(sums) >= 100_000:
            yield out()
            sums.clear()
    if sums:
        yield out()


_CONTAINERS = r"(?i)<(?:nav|header|footer|aside|main|article|section|form|div)\b[^>]*"


def with_group(pages: DataFrame) -> DataFrame:
    """host, layout, and a number that tells pages apart."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit(_CONTAINERS), F.lit(0)))
    part = lambda tag, pattern: F.regexp_replace(F.lower(F.regexp_extract(tag, pattern, 1)), "[0-9]+", "#")
    marks = F.transform(tags, lambda tag: F.concat_ws(".", part(tag, r"^<([a-zA-Z]+)"), part(tag, r"(?i)\bclass\s*=\s*[\"']?([^\"']*)")))
    layout = F.xxhash64(F.coalesce(F.array_sort(F.array_distinct(marks)), F.array().cast("array<string>")))
    rows = pages.withColumn("html", F.col("html").cast("string"))
    return rows.withColumns({"host": host, "layout": layout, "page": F.xxhash64("page_id", "url", "html")})


def _valid(tokens: DataFrame, group: list[str]) -> DataFrame:
    """The tokens that cover nine tenths of their group's pages, and at least two pages."""
    pages = tokens.where(F.col("kind") == PAGE).select(*group, F.col("pages").alias("all_pages"))
    return tokens.where(F.col("pages") > 1).join(pages, group).where((F.col("pages") >= COVER * F.col("all_pages")) & (F.col("kind") != PAGE))


def templates(pages: DataFrame) -> DataFrame:
    """The valid classes of each group (page_id, url, html): one row per token.

    host, layout (null: of the whole host), kind (0: element, 1: text), token and parent (hashes of paths), depth, container, vector (equal within
    a class), presence (equal where the pages are), pages, n (occurrences), blocks (of text in the element itself), and characters
    below that markup does not exclude: every, free of links, in heads; all_pages of the group.
    """
    schema = "host string, layout long, kind long, token long, parent long, depth long, container long, vector long, presence long, pages long, n long, blocks long, every long, free long, heads long"
    rows = with_group(pages).select("host", "layout", "page", "html").mapInArrow(thrifty(_tokens), schema)
    key, sums = ["kind", "token", "parent", "depth", "container"], ["pages", "n", "blocks", "every", "free", "heads"]

    def add(rows: DataFrame, by: list[str]) -> DataFrame:
        hashes = [F.sum(F.col(c).cast("decimal(38, 0)")).alias(c) for c in ("vector", "presence")]
        return rows.groupBy(*by, *key).agg(*hashes, *[F.sum(c).alias(c) for c in sums])

    layouts = Scratch(pages.sparkSession, "tokens").keep(add(rows, ["host", "layout"]), "tokens")
    hosts = add(layouts, ["host"])
    found = _valid(layouts, ["host", "layout"]).unionByName(_valid(hosts, ["host"]).withColumn("layout", F.lit(None).cast("long")))
    around = F.expr("pmod(vector, cast(18446744073709551616 as decimal(20, 0)))"), F.expr("pmod(presence, cast(18446744073709551616 as decimal(20, 0)))")
    return found.withColumns({"vector": around[0].cast("string"), "presence": around[1].cast("string")})


def _nest(table: pa.Table) -> pa.Table:
    """One group's valid classes -> its main slot and the tokens of its template text."""
    rows = table.sort_by([("depth", "ascending"), ("token", "ascending")]).to_pylist()
    elements = [r for r in rows if r["kind"] == ELEMENT]
    place = {r["token"]: i for i, r in enumerate(elements)}
    parent = [place.get(r["parent"], -1) if r["depth"] else -1 for r in elements]
    frames = [r["n"] == r["pages"] for r in elements]
    # The classes by their pages that frame each element, from the root down: each element keeps its innermost frame's chain.
    around: list[tuple | None] = []
    for i, r in enumerate(elements):
        up = around[parent[i]] if parent[i] >= 0 else None
        around.append((r["presence"], up) if frames[i] and (up is None or up[0] != r["presence"]) else up)
    texts = [r for r in rows if r["kind"] == TEXT and r["parent"] in place]

    def nests(r: dict) -> bool:
        chain = around[place[r["parent"]]]
        while chain is not None:
            if chain[0] == r["presence"]:
                return True
            chain = chain[1]
        return False

    texts = [r for r in texts if nests(r)]
    held = {}
    for r in texts:
        held[r["parent"]] = held.get(r["parent"], 0) + r["n"]
    fixed = [r for r in texts if held[r["parent"]] >= COVER * elements[place[r["parent"]]]["blocks"]]
    less = [[0, 0, 0] for _ in elements]
    for r in fixed:
        own = less[place[r["parent"]]]
        for c, name in enumerate(("every", "free", "heads")):
            own[c] += r[name]
    free = [[r["every"] - x, r["free"] - y, r["heads"] - z] for r, (x, y, z) in zip(elements, _below(less, parent))]
    at = main_slot(parent, [r["depth"] for r in elements], [f and bool(r["container"]) for f, r in zip(frames, elements)], free, [r["token"] for r in elements])
    first = rows[0]
    return pa.table({
        "host": pa.array([first["host"]], pa.string()), "layout": pa.array([first["layout"]], pa.int64()), "main": pa.array([elements[at]["token"] if at >= 0 else None], pa.int64()),
        "fixed": pa.array([[r["token"] for r in fixed]], pa.list_(pa.int64()))})


def slots(tokens: DataFrame) -> DataFrame:
    """host, layout, main (the path's token), fixed (tokens of template text) of each group whose pages have free text."""
    found = tokens.groupBy("host", "layout").applyInArrow(_nest, "host string, layout long, main long, fixed array<long>")
    return found.where("main is not null")


def main_text(source: str | None, main: int | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """A page's main text, given its template if there is one."""
    page = Page(source or "")
    slot = None
    if main is not None:
        slot = next((i for i, m in enumerate(page.mark) if _signed(m) == main), None)
    if slot is not None:
        inside = _inside(page, slot)
        free = [b for b in page.blocks if not page.outside[b[0]] and _signed(page.text_mark(b)) not in fixed]
        left = [b for b in free if inside[b[0]]]
        # A page on which the slot's path is another element holds its text elsewhere.
        if 3 * sum(len(b[1]) for b in left) >= sum(len(b[1]) for b in free) > 0:
            return " ".join(b[1] for b in left)
    # Nothing to compare with: the page's own tree, within what markup calls the article.
    free = [b for b in page.blocks if not page.outside[b[0]]]
    within = [b for b in free if page.wanted[b[0]]]
    if not within and free:
        at = main_slot(page.parent, page.depth, [x not in TEXTUAL for x in page.name], page.sums(), list(range(len(page.mark))))
        inside = _inside(page, max(at, 0))
        within = [b for b in free if inside[b[0]]]
    return " ".join(b[1] for b in within)


def _inside(page: Page, top: int) -> list[bool]:
    out = [False] * len(page.mark)
    out[top] = True
    for i in range(top + 1, len(out)):
        out[i] = out[page.parent[i]]
    return out


def _extract(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, ...], frozenset[int]] = {}
        for batch in batches:
            texts = []
            for source, main, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "fixed"))):
                key = tuple(fixed or ())
                if key not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[key] = frozenset(key)
                texts.append(main_text(source, main, sets[key]))
            kept = batch.column("kept").flatten()
            yield pa.RecordBatch.from_arrays([*(kept[i] for i in range(len(columns))), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=[*columns, "text", "n_chars"])

    return run


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), template: bool = True) -> DataFrame:
    """The columns named in `carry`, with text and n_chars, for every row of `pages` (page_id, url, html); they may bear any name but those two.

    Without `template` every page is read by itself.
    """
    scratch = Scratch(pages.sparkSession, "template-text")
    columns = list(dict.fromkeys(carry))
    kept = F.struct(*[F.col(c).cast({"page_id": "long", "url": "string"}[c]).alias(c) if c in ("page_id", "url") else F.col(c) for c in columns])
    pages = pages.select(kept.alias("kept"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = with_group(pages).select("kept", "html", "host", "layout")
    if template:
        found = scratch.keep(slots(templates(pages)), "slots")
        size = found.agg(F.coalesce(F.sum(F.size("fixed") * 8 + F.length("host") + 80), F.lit(0))).first()[0]
        own = small(found.where("layout is not null").withColumnsRenamed({"main": "main1", "fixed": "fixed1"}), size, 1)
        every = small(found.where("layout is null").select("host", F.col("main").alias("main2"), F.col("fixed").alias("fixed2")), size, 1)
        met = rows.join(own, ["host", "layout"], "left").join(every, "host", "left")
        rows = met.select("kept", "html", F.coalesce("main1", "main2").alias("main"), F.when(F.col("main1").isNotNull(), F.col("fixed1")).otherwise(F.col("fixed2")).alias("fixed"))
    else:
        rows = rows.select("kept", "html", F.lit(None).cast("long").alias("main"), F.lit(None).cast("array<long>").alias("fixed"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select("kept.*").schema)
    return rows.mapInArrow(thrifty(_extract(columns)), f"{out}, text string, n_chars long")
