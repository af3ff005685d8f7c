"""Main text of web pages: site templates are found by hashing element subtrees and counting them per host."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, passes, small, with_row, written

#: A subtree belongs to a site's template if it stands on so many pages of the host, and on this share of the host's pages
#: that have an element at its path. So a section's box is one however large the host, and a sentence that some articles
#: share is none, since the other articles have other paragraphs at the same path.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.5
#: Elements nested more deeply are read as if their tags weren't there.
DEPTH = 256

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form button select option datalist dialog menu svg math object video audio canvas map frameset".split())
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names within which an implied end tag isn't looked for.
SCOPE = frozenset("html body table td th ul ol dl article main section div aside nav footer header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

RAW = frozenset("script style noscript template textarea title iframe xmp".split())
NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)
REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAMED_AWAY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|shar(?:e|ing)|social|related|recommended|comments?|disqus|respond|replies|pagination|pager)(?:$|[\s_-])", re.I)
#: Parts of a class that tell a state or a layout: with-sidebar, no-sidebar, has-nav, comments-open name no sidebar, nav or comments.
STATES = frozenset("with without has have no not non open opened closed enabled disabled".split())
#: An element without an article keeps its text against its name if that has so many characters and is this share of the page's.
MOST_CHARACTERS = 500
MOST_SHARE = 0.8
NAMED_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-title)(?:$|[\s_-])", re.I)


def named(names: str, pattern: re.Pattern) -> bool:
    """Whether one of the classes or ids has a listed name, other than in a word for a state or a layout."""
    return bool(pattern.search(names)) and any(pattern.search(n) and STATES.isdisjoint(re.split("[-_]+", n.lower())) for n in names.split())


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): ("text", "", it), ("start", name, attributes) and ("end", name, ""), in time linear in the source.

    Comments, declarations and what stands in raw elements are left out, and so is a tag that the source's end cuts off.
    """
    at, size, spare = 0, len(source), 4 * len(source)
    while at < size:
        i = source.find("<", at)
        if i < 0:
            yield "text", "", source[at:]
            return
        if i > at:
            yield "text", "", source[at:i]
        m = NAME.match(source, i)
        if not m and source[i + 1 : i + 2] not in ("!", "?", "/"):
            yield "text", "", "<"
            at = i + 1
            continue
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            at = end + 3 if end >= 0 else size
            continue
        end = source.find(">", i)
        if end < 0:
            return
        if not m:
            at = end + 1
            continue
        quoted = source.find('"', m.end(), end) >= 0 or source.find("'", m.end(), end) >= 0
        if quoted and spare > 0:  # a quoted value may hold the sign; looked for as long as it takes no more than some readings of the source
            rest = REST.match(source, m.end())
            spare -= size - i if not rest else 0
            end = rest.end() - 1 if rest else end
        name, at = m[1].lower(), end + 1
        if source[i + 1] == "/":
            yield "end", name, ""
        elif name in RAW:
            close = RAW_END[name].search(source, at)
            at = close.end() if close else size
        else:
            yield "start", name, source[m.end() : end]


class Page:
    """One page: `blocks` of (text, numbers of the open elements, named parts, articles), `ids` and `paths` of the numbered elements, and whether an article holds the text.

    An element's path is made of the names, classes and ids from the body down to it, its id of the path and all it holds.
    Elements that go by class or id alone, the named parts, are read like others; what they hold is decided on at the end.
    """

    def __init__(self, source: str):
        self.ids: list[int] = []
        self.paths: list[int] = []
        self.blocks: list[tuple[str, tuple[int, ...], tuple[int, ...], int]] = []
        # For each article: the named parts that are it or hold it, and whether it is marked as the main one.
        self.roots: list[tuple[tuple[int, ...], bool]] = []
        # An open element: [name, number or -1, its content for the hash or None, opens a dropped part, its number as an article or -1, as a named part or -1]
        self._open: list[list] = []
        self._names: Counter[str] = Counter()
        self._skipped: Counter[str] = Counter()
        self._dropped, self._root = 0, -1
        self._parts: list[int] = []
        self._n_parts = 0
        self._text: list[str] = []
        for kind, name, content in tokens(source):
            if kind == "text":
                self._write(content)
            elif kind == "start":
                self._start(name, content)
            else:
                self._end(name)
        self._flush()
        while self._open:
            self._pop()
        self._decide()

    def _decide(self) -> None:
        """Drop the named parts, but for those that hold the page's main text."""
        size, of_part, of_root = 0, dict.fromkeys(range(self._n_parts), 0), dict.fromkeys(range(len(self.roots)), 0)
        for text, _, parts, root in self.blocks:
            size += len(text)
            for p in parts:
                of_part[p] += len(text)
            if root >= 0 and set(parts) <= set(self.roots[root][0]):
                of_root[root] += len(text)
        full = [r for r, n in of_root.items() if n]
        outside = any(not self.roots[r][0] for r in full)
        # The main element, or where no article stands outside the named parts, one with most of the text.
        spared = {p for r in full if self.roots[r][1] or not outside and 2 * of_root[r] > size for p in self.roots[r][0]}
        if not full:
            spared = {p for p, n in of_part.items() if n >= MOST_CHARACTERS and n >= MOST_SHARE * size}
        elif not spared and all(parts for _, _, parts, _ in self.blocks):
            spared = {p for r in full for p in self.roots[r][0]}  # else nothing would be left
        self.blocks = [b for b in self.blocks if spared.issuperset(b[2])]
        self.has_root = any(root >= 0 for _, _, _, root in self.blocks) or any(not parts for parts, _ in self.roots)

    def _write(self, text: str) -> None:
        if self._dropped:
            if self._open[-1][2] is not None:
                self._open[-1][2].append(text)
        else:
            self._text.append(html.unescape(text))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text.clear()
            if text:
                self.blocks.append((text, tuple([e[1] for e in self._open if e[1] >= 0]), tuple(self._parts), self._root))
                if self._open and self._open[-1][2] is not None:
                    self._open[-1][2].append(text)

    def _pop(self) -> None:
        name, number, content, dropped, root, part = self._open.pop()
        self._dropped -= dropped
        self._names[name] -= 1
        if root >= 0:
            self._root = -1
        if part >= 0:
            self._parts.pop()
        if content is not None:
            value = xxhash.xxh3_64_intdigest("\0".join([str(self.paths[number]), *content]).encode("utf-8", "replace")) - (1 << 63)
            self.ids[number] = value
            if self._open and self._open[-1][2] is not None:
                self._open[-1][2].append(str(value))

    def _close_implied(self, names: set[str] | frozenset[str]) -> None:
        if not any(self._names[n] for n in names):
            return
        for k in range(len(self._open) - 1, -1, -1):
            name = self._open[k][0]
            if name in names:
                while len(self._open) > k:
                    self._pop()
                return
            if name in SCOPE:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            if name in CLOSES_P:
                self._close_implied({"p"})
            if name in CLOSED_BY:
                self._close_implied(CLOSED_BY[name])
        elif name == "br" and not self._dropped:
            self._text.append(" ")
        if name in VOID:
            return
        if len(self._open) >= DEPTH:
            self._skipped[name] += 1
            return
        dropped = part = root = main = False
        known = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        if not self._dropped:
            role, names = known.get("role", "").lower(), f"{known.get('class', '')} {known.get('id', '')}"
            dropped = name in DROPPED or role in ROLES or "hidden" in known or known.get("aria-hidden", "") == "true" or (name == "header" and self._root < 0)
            if not dropped:
                part = name not in ("html", "body") and (named(names, NAMED_AWAY) or (self._root < 0 and named(names, NAMED_HEADER)))
                main = name == "main" or role == "main"
                root = self._root < 0 and (main or name == "article" or known.get("itemprop", "") == "articleBody")
        if (dropped or part) and name not in BLOCK:
            self._flush()
        number = -1
        if name not in ("html", "body"):
            number = len(self.ids)
            above = self.paths[self._open[-1][1]] if self._open and self._open[-1][1] >= 0 else 0
            self.ids.append(0)
            self.paths.append(xxhash.xxh3_64_intdigest(f"{above} {name} {known.get('class', '')} {known.get('id', '')}".encode("utf-8", "replace")) - (1 << 63))
        self._names[name] += 1
        self._open.append([name, number, [] if number >= 0 else None, int(dropped), len(self.roots) if root else -1, self._n_parts if part else -1])
        self._dropped += dropped
        if part:
            self._parts.append(self._n_parts)
            self._n_parts += 1
        if root:
            self._root = len(self.roots)
            self.roots.append((tuple(self._parts), main))

    def _end(self, name: str) -> None:
        if self._skipped[name]:
            self._skipped[name] -= 1
            return
        if not self._names[name]:
            if name == "p" or name in BLOCK:
                self._flush()
            return
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == name:
                if name in BLOCK or any(e[3] or e[5] >= 0 for e in self._open[k:]):
                    self._flush()
                while len(self._open) > k:
                    self._pop()
                return
            if name not in BLOCK and self._open[k][0] in BLOCK:
                return  # an inline end tag doesn't reach out of its block
        if name == "p" or name in BLOCK:
            self._flush()

    def kept(self) -> list[tuple[str, list[int]]]:
        """(text, numbers of the elements around it) in page order: of the articles if there are any, else of the whole body."""
        return [(b[0], list(b[1])) for b in self.blocks if b[3] >= 0 or not self.has_root]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


_PARSED = "host string, copy binary, page binary, elements array<struct<path: bigint, id: bigint>>, body binary, around array<array<int>>"


def extract(pages: DataFrame, url: str = "url", source: str = "html", template_pages: int = TEMPLATE_PAGES, template_share: float = TEMPLATE_SHARE) -> DataFrame:
    """One row per row of pages: `row` (all its columns but the source) and `text`, the main text, empty if there is none.

    Every element subtree around text is hashed, with its path; Spark counts, for each host, the pages that have the subtree
    and those that have an element at its path. Subtrees on template_pages and template_share of these are the site's
    template and go, in articles too. What is never text of an article goes by the kind of its element (menu, header,
    footer, sidebar, form, script) and by role, class and id; by class or id not if it is or holds the main element, or the
    article or nearly all of the text (Page._decide). If the page marks an article (article, main), only its text is read
    on, else the body's. Character references are decoded, white space inside a block becomes one space, blocks are joined
    by one space. A null or empty page has an empty text; pages without a URL count as one host's; pages of one host with
    the same text before templates go are copies and count once; no pages give no rows. A page is read once, in time linear
    in its length whatever is left open or nested.
    """
    rows = with_row(pages, source).withColumn("url", F.col("row").getField(url).cast("string"))

    def parse(batches):
        pack = zstandard.ZstdCompressor(6).compress
        for batch in small(batches):
            urls = batch.column(2).to_pylist()
            for start, group in passes(as_bytes(batch.column(1))):
                columns: list[list] = [[] for _ in range(6)]
                for g, u in zip(group, urls[start:]):
                    page = Page(g.decode("utf-8", "replace"))
                    kept, host = page.kept(), host_of(u)
                    used = sorted({n for _, around in kept for n in around})
                    place = {n: k for k, n in enumerate(used)}
                    body = "\n".join([t for t, _ in kept]).encode("utf-8", "replace")
                    around = [[place[n] for n in a] for _, a in kept]
                    ids = [page.ids[n] for n in used]
                    key = xxhash.xxh3_128_digest(repr((host, ids, around)).encode("utf-8", "replace") + body)
                    for column, value in zip(columns, (host, xxhash.xxh3_128_digest(body), key, [{"path": page.paths[n], "id": i} for n, i in zip(used, ids)], pack(body), around)):
                        column.append(value)
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.struct([("path", pa.int64()), ("id", pa.int64())])), pa.binary(), pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), *map(pa.array, columns, kinds)], schema.names)

    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(_PARSED).fields])
    parsed = written(rows.select("row", "text", "url").mapInArrow(parse, schema), "parsed")
    each = parsed.select("host", "copy", "page", F.explode(F.array_distinct("elements")).alias("e")).select("host", "copy", "page", "e.path", "e.id")
    # A subtree may stand in some copies of a text only, so all copies' subtrees are united.
    held = each.select("host", "path", "id", "copy").distinct().groupBy("host", "path", "id").agg(F.count("*").alias("pages")).filter(F.col("pages") >= template_pages)
    at_path = each.select("host", "path", "copy").distinct().groupBy("host", "path").agg(F.count("*").alias("all_pages")).filter(F.col("all_pages") >= template_pages)
    templates = written(held.join(at_path, ["host", "path"]).filter(F.col("pages") >= F.col("all_pages") * template_share).select("host", "id"), "templates")
    # Pages that have all of host, texts and subtrees in common lose the same: they are one page here, and nothing needs a row number.
    gone = each.select("host", "page", "id").join(templates, ["host", "id"]).groupBy("page").agg(F.collect_set("id").alias("gone"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            texts = []
            for elements, body, around, ids in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4))):
                blocks = unpack(body).decode().split("\n")
                if ids:
                    off = {k for k, e in enumerate(elements) if e["id"] in ids}
                    blocks = [t for t, a in zip(blocks, around) if off.isdisjoint(a)]
                texts.append(" ".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    marked = parsed.select("row", "elements", "body", "around", "page").join(written(gone, "gone"), "page", "left")
    return marked.select("row", F.when(F.col("gone").isNotNull(), F.col("elements")).alias("elements"), "body", F.when(F.col("gone").isNotNull(), F.col("around")).alias("around"), "gone").mapInArrow(cut, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
