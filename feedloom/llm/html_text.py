"""Operator 3: main text of web pages by wrapper induction.

The content of a page is a tree of slots: elements with their classes, siblings alike being one slot, as lists and paragraphs have
no fixed number. One page of each host, and one of each of its layouts (the block elements near the root), is the reference;
every page of the host is aligned with both by simple tree matching: of the children that two slots share, in their order, those
pairs are taken that let most slots of the whole trees correspond. Over all different pages it is counted how many hold the
same text in the same slot of the reference; what NEARLY all of them hold is constant and becomes the template. It is dropped
from every page of the host; the varying slots are content, unless their element or its class says menu, header, footer,
sidebar, notice, advert, form or comments. Texts in slots without a counterpart are told apart by their path. If a page has an
article (or main) element, only those count. Pages that are copies of one article would make the article template: where the
constants leave next to nothing, or of FEW pages less than half, they are kept.

Null or empty pages have empty text; a text without tags is one block; unclosed and stray tags are borne, as are trees of any
depth; repeated pages are each extracted; pages without a host share one group. A host with one distinct page has no template,
only the element rules. Pages whose tags or quotes never close are read in linear time: what can't be a tag is text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import slices, table, written

#: Share of the pages that hold a text of the template.
NEARLY = 0.9
#: Different pages that a layout of its own has at least (a host: two).
LEAST = 3
#: Constants that leave less than this share of the text, or so many characters a page, are copies; of fewer than FEW pages, those that leave less than half.
COPIES, COPY_CHARS, FEW = 0.05, 20, 5
#: Depth of the elements that make a layout.
DEPTH = 3

#: Elements whose content is no text of the page.
_RAW = set("script style noscript template svg iframe textarea select title".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(_RAW))})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(?P<text>[^<]+|<)", re.S | re.I)
_NAME = re.compile(r"</?[a-zA-Z]")
_INSIDE = re.compile(r"(/?)([a-zA-Z][^\s/>]*)(.*)", re.S)
_MARKS = re.compile(r"[>\"']")
_DIGITS = re.compile(r"\d+")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag ends, as HTML has it for paragraphs, items and cells.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_OTHER = set("nav footer aside form button head menu dialog input label fieldset".split())
_OTHER_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "popup promo promotion related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo".split())


class Node:
    __slots__ = ("key", "tag", "other", "children", "text", "number")

    def __init__(self, tag: str, key: str = "", text: str = ""):
        self.tag, self.key, self.text = tag, key, text
        self.other, self.children, self.number = False, [], -1


class _Ends:
    """Where tags of a page end: at the first > outside quotes; a quote that never closes is a sign like others. Found from right to left, once a page."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _MARKS.finditer(page)]
        self.end = [-1] * (len(self.at) + 1)
        after: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            self.end[i] = self.at[i] if c == ">" else self.end[after.get(c, i) + 1]
            after[c] = i

    def of(self, start: int) -> int:
        """-1: a tag that begins here never ends."""
        return self.end[bisect_left(self.at, start)]


def tokens(page: str) -> Iterator[tuple[str | None, str, str | None, str]]:
    """(tag, / if it closes, text, attributes) of tags and texts in page order; comments, scripts and the like have neither tag nor text."""
    at, ends, last = 0, None, page.rfind(">")
    while at < len(page):
        if at > last:
            # nothing that follows can be a tag; a comment that never closes hides the rest
            rest = page.find("<!--", at)
            if text := page[at:] if rest < 0 else page[at:rest]:
                yield None, "", text, ""
            return
        if ends is not None and _NAME.match(page, at):
            end = ends.of(at)
            if end < 0:
                yield None, "", "<", ""
                at += 1
                continue
            close, tag, attrs = _INSIDE.match(page, at + 1, end).groups()
            at = end + 1
            if not close and tag.lower() in _RAW:
                hidden = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = hidden.end() if hidden else len(page)
            else:
                yield tag, close, None, attrs
            continue
        m = _TOKEN.match(page, at)
        if m["text"] == "<" and ends is None and _NAME.match(page, at):
            # a tag that isn't one: from here on it is looked up whether tags end
            ends = _Ends(page)
            continue
        yield m["tag"], m["close"] or "", m["text"], m["attrs"] or ""
        at = m.end()


def parse(page: str) -> Node:
    """The page's tree; texts are its leaves, numbered in page order."""
    root = Node("html", "html")
    stack, count = [root], 0
    for tag, close, text, attrs in tokens(page):
        if text is not None:
            if not text.isspace():
                leaf = Node("#text", "#text", " ".join(entities.unescape(text).split()))
                leaf.number, count = count, count + 1
                # whether white space keeps words apart matters where elements are inline
                leaf.tag = "#text" + (" " if text[0].isspace() else "") + ("_" if text[-1].isspace() else "")
                stack[-1].children.append(leaf)
            elif stack[-1].children:
                stack[-1].children.append(Node("br", "br"))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK:
            _end(stack, {"p"}, _BLOCK - {"p"})
        if tag in _ENDS:
            _end(stack, _ENDS[tag], _SCOPES.get(tag, set()))
        found = [(a.lower(), b or c or d) for a, b, c, d in _ATTR.findall(attrs)]
        node = Node(tag, tag + "".join(f" {a}={v}" for a, v in found if a == "class"))
        node.other = tag in _OTHER or any(not _OTHER_WORDS.isdisjoint(re.split(r"[\s_\-]+", v.lower())) for _, v in found)
        if tag == "header" and not any(x.tag in ("article", "main") for x in stack):
            node.other = True
        stack[-1].children.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _end(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def contents(root: Node) -> list[tuple[Node, int]]:
    """The elements that hold the content, with the hashes of their paths: articles if there are any, else the page."""
    main: list[tuple[Node, int]] = []
    todo = [(root, 0)]
    while todo:
        node, path = todo.pop()
        if node.tag in ("article", "main") or "role=main" in node.key:
            if not node.other:
                main.append((node, path))
        elif not node.other:
            todo += [(c, _under(path, c)) for c in reversed(node.children)]
    return main or [(root, 0)]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _under(path: int, node: Node) -> int:
    """Hash of a path and the next element; numbers in its classes count pages."""
    return _hash(f"{path}/{_DIGITS.sub('#', node.key)}")


class Slots:
    """The tree of slots of a page's content. Slot 0 is the content itself; a slot's children are known by their keys, in page order."""

    def __init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.paths = [0]
        #: Number, slot and text of each text.
        self.texts: list[tuple[int, int, str]] = []

    def child(self, slot: int, key: str) -> int:
        key = " ".join(key.split())
        found = self.children[slot].get(key)
        if found is None:
            found = self.children[slot][key] = len(self.children)
            self.children.append({})
            self.paths.append(_hash(f"{self.paths[slot]}/{key}"))
        return found

    @classmethod
    def of(cls, root: Node) -> Slots:
        made = cls()
        todo = []
        for node, path in reversed(contents(root)):
            todo.append((node, 0, path))
        while todo:
            node, slot, path = todo.pop()
            if node.key == "#text":
                made.texts.append((node.number, slot, node.text))
            elif not node.other:
                own = made.child(slot, f"{path}:{_DIGITS.sub('#', node.key)}" if slot == 0 else _DIGITS.sub("#", node.key))
                todo += [(c, own, 0) for c in reversed(node.children) if c.key not in ("br", "hr", "img")]
        return made

    def written(self) -> str:
        """A line with the parent and the key of each slot."""
        lines = [""] * len(self.children)
        for slot, children in enumerate(self.children):
            for key, c in children.items():
                lines[c] = f"{slot} {key}"
        return "\n".join(lines[1:])

    @classmethod
    def read(cls, lines: str) -> Slots:
        made = cls()
        for line in lines.split("\n") if lines else ():
            parent, _, key = line.partition(" ")
            made.children[int(parent)][key] = len(made.children)
            made.children.append({})
        return made


def aligned(page: Slots, reference: Slots) -> dict[int, int]:
    """Slot of the reference for the page's slots that simple tree matching pairs with one."""
    pairs, below = [(0, 0)], []
    for a, b in pairs:  # grows: pairs of slots whose parents are paired and whose keys are equal
        theirs = reference.children[b]
        first = len(pairs)
        pairs += [(c, theirs[key]) for key, c in page.children[a].items() if key in theirs]
        below.append(range(first, len(pairs)))
    size, chosen = [1] * len(pairs), [()] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        chosen[i] = _in_order([(k, pairs[k][1], size[k]) for k in below[i]])
        size[i] = 1 + sum(size[k] for k in chosen[i])
    found, todo = {}, [0]
    while todo:
        i = todo.pop()
        found[pairs[i][0]] = pairs[i][1]
        todo += chosen[i]
    return found


def _in_order(options: list[tuple[int, int, int]]) -> list[int]:
    """Of (pair, place in the reference, size), in the page's order, those with the largest sum whose places ascend."""
    if all(options[k][1] < options[k + 1][1] for k in range(len(options) - 1)):
        return [k for k, _, _ in options]
    # places and sums both ascend: what is no better than something before it goes
    places, sums, ends, before = [], [], [], {}
    for k, place, size in options:
        at = bisect_left(places, place)
        total = size + (sums[at - 1] if at else 0)
        before[k] = ends[at - 1] if at else None
        if at < len(places) and places[at] == place and sums[at] >= total:
            continue
        end = at
        while end < len(places) and sums[end] <= total:
            end += 1
        places[at:end], sums[at:end], ends[at:end] = [place], [total], [k]
    out = []
    k = ends[-1]
    while k is not None:
        out.append(k)
        k = before[k]
    return out[::-1]


@lru_cache(maxsize=256)
def _reference(lines: str) -> Slots:
    return Slots.read(lines)


def texts_of(page: Slots, reference: str | None) -> dict[int, tuple[int, int]]:
    """By number of each text: the hash of its slot, as the reference has it, and itself, and its length."""
    slot_of = aligned(page, _reference(reference)) if reference is not None else {}
    return {number: (_hash(f"{slot_of.get(slot, page.paths[slot])}\0{text}"), len(text)) for number, slot, text in page.texts}


def layout(root: Node) -> int:
    """Hash of the paths of the block elements down to DEPTH."""
    paths, level = set(), [(root, 0)]
    for _ in range(DEPTH):
        level = [(c, _under(path, c)) for node, path in level for c in node.children if c.tag in _BLOCK]
        paths.update(path for _, path in level)
    # 0 stands for the whole host
    return _hash("\0".join(map(str, sorted(paths)))) or 1


def blocks(root: Node, dropped: set[int]) -> list[str]:
    """The content's blocks in page order."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(text)
        parts.clear()

    todo: list = [node for node, _ in reversed(contents(root))]
    while todo:
        node = todo.pop()
        if node is None:
            close()
        elif node.key == "#text":
            if node.number not in dropped:
                parts.append((" " if " " in node.tag else "") + node.text + (" " if "_" in node.tag else ""))
        elif node.other:
            close()
        elif node.tag in ("br", "hr", "img"):
            parts.append(" ")
        elif node.tag in _BLOCK:
            close()
            todo.append(None)
            todo += reversed(node.children)
        else:
            todo += reversed(node.children)
    close()
    return out


class Extractor:
    def text(self, page: str | None, wrappers: list[tuple[str | None, set[int]]]) -> str:
        """The content without constants; wrappers: of the host and of the page's layout, as far as there are, the reference and the constants."""
        if not page:
            return ""
        root = parse(page)
        dropped: set[int] = set()
        if wrappers:
            own = Slots.of(root)
            for reference, fixed in wrappers:
                dropped |= {number for number, (slot, _) in texts_of(own, reference).items() if slot in fixed}
        return "\n\n".join(blocks(root, dropped))


def laid_out(rows: DataFrame) -> DataFrame:
    """The rows (page_id, url, html, host) with h, the page's hash, its layout, and its tree; empty pages have no tree. Written once, as all that follows reads them."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in (("h", "long"), ("layout", "long"), ("tree", "string")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                made = [(_hash(page), layout(root := parse(page)), Slots.of(root).written()) if page else (None, None, None) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[j] for r in made], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], names=schema.names)

    return written(rows.select("page_id", "url", "html", "host").mapInArrow(run, schema), "pages")


def references(pages: DataFrame) -> DataFrame:
    """(host, layout, tree): the reference tree of each host with two pages or more (layout 0), and of each of its layouts with LEAST."""
    of_layout = written(pages.where("tree IS NOT NULL").groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "tree")).alias("first")), "layouts")
    of_host = of_layout.groupBy("host").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").withColumn("layout", F.lit(0).cast("long"))
    return of_host.unionByName(of_layout.where(F.col("n") >= LEAST)).select("host", "layout", F.col("first.tree").alias("tree"))


def with_wrappers(pages: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """Pages with what was found for their host, as the struct of_host, and for their layout, as of_layout; null where there is none. A page meets two rows at most, however many layouts its host has."""
    one = lambda df, name, *keys: df.select(*keys, F.struct(*columns).alias(name))
    met = pages.join(one(found.where("layout = 0"), "of_host", "host"), "host", "left")
    return met.join(one(found.where("layout != 0"), "of_layout", "host", "layout"), ["host", "layout"], "left")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"host": pa.string(), "h": pa.int64(), "layout": pa.int64(), "slots": pa.list_(pa.int64()), "chars": pa.list_(pa.int64())}
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for host, page, h, own_layout, of_host, of_layout in zip(*(c.to_pylist() for c in part.columns)):
                page_slots = Slots.of(parse(page))
                for which, reference in ((0, of_host), (own_layout, of_layout)):
                    if reference:
                        own: dict[int, int] = {}
                        for slot, n in texts_of(page_slots, reference["tree"]).values():
                            own[slot] = own.get(slot, 0) + n
                        # slot 0 counts the page and all its characters
                        own[0] = sum(own.values())
                        rows.append((host, h, which, list(own), list(own.values())))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds.values())], names=list(kinds))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, tree, slots) of each host (layout 0) and layout with a template: its reference, and the texts that are constant."""
    trees = written(references(pages), "references")
    read = with_wrappers(pages.where("tree IS NOT NULL"), trees, "tree").where("of_host IS NOT NULL OR of_layout IS NOT NULL")
    own = read.select("host", "html", "h", "layout", "of_host", "of_layout").mapInArrow(_texts, "host string, h long, layout long, slots array<long>, chars array<long>")
    # a page that stands there more than once counts once
    each = own.dropDuplicates(["host", "h", "layout"]).select("host", "layout", F.inline(F.arrays_zip(F.col("slots").alias("slot"), "chars")))
    counted = each.groupBy("host", "layout", "slot").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    # texts of one page aren't constant
    counted = written(counted.where("n > 1 OR slot = 0"), "slots")
    sizes = counted.where("slot = 0").select("host", "layout", F.col("n").alias("pages"), F.col("chars").alias("total")).where(F.col("pages") >= F.when(F.col("layout") == 0, 2).otherwise(LEAST))
    constant = counted.where("slot != 0").join(sizes, ["host", "layout"]).where(F.col("n") >= NEARLY * F.col("pages"))
    found = constant.groupBy("host", "layout", "pages", "total").agg(F.collect_set("slot").alias("slots"), F.sum("chars").alias("fixed"))
    left = F.col("total") - F.col("fixed")
    copies = (left < COPIES * F.col("total")) | (left < COPY_CHARS * F.col("pages")) | ((F.col("pages") < FEW) & (2 * left < F.col("total")))
    return trees.join(found.where(~copies), ["host", "layout"]).select("host", "layout", "tree", "slots")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = laid_out(pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host")))
    # written first, as then its size is known: where it is small, no page moves
    found = written(wrappers(rows), "wrappers")
    joined = with_wrappers(rows, found, "tree", "slots").select("page_id", "url", "html", "of_host", "of_layout")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Extractor()
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [own.text(html, [(w["tree"], set(w["slots"])) for w in both if w]) for html, *both in zip(*(part.column(i).to_pylist() for i in range(2, 5)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
