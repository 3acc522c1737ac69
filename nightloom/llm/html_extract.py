"""HTML extraction by wrapper induction.

1. Each page is parsed, tolerantly, into a tree of block elements.
2. Per host, the page with the smallest page_id gives a reference skeleton (tags and classes only).
   Every page of the host is aligned with it by simple tree matching: roots must agree, children
   are matched in order by dynamic programming, the number of matched nodes is greatest, however many
   children there are: time grows with the product of their numbers, memory with one of them times the other's root.
3. Over all pages of a host, texts are counted by aligned slot. A text that stands in the same slot
   on at least CONSTANT of the host's pages (and on LEAST pages or more) is template; slots whose text
   varies are content. On hosts with fewer pages a text on every page, of two at least, is template,
   but only on pages without article, main or content element, so that a few near-copies keep their text.
4. The main text is the content of the page's articles: all outermost ``article`` elements and
   siblings of theirs that are marked as content, else all ``main`` elements, else all that are
   marked as content, else the body, in page order; without menus, headers, footers, forms, scripts and
   styles by tag, and without template slots. If nothing but template is left, the slots stay: pages
   that are copies of each other keep their text.
5. Class and id words mark, they don't cut: marked elements are aligned like any other. Adverts,
   comments and the like (``FOREIGN_WORDS``) go. Other marked elements (sidebar, header, notice) go
   unless they lie in an article, main or content element and their slot is aligned and its text varies
   over a host of LEAST pages or more. A mark counts for nothing on an element that holds all
   articles of the page, in a modifier (``has-sidebar``), beside a content class (``post-content``), or on
   the header of an entry (``entry-header``).

Only the skeletons (one per host) and template texts (at most 1 / CONSTANT for a slot) are joined to
pages. Hosts are never gathered: counts are pre-aggregated, skeletons are broadcast up to SMALL bytes in
all, and beyond that the pages of a hot host are split over tasks.

Defined results: null html is empty. Null url belongs to a host of its own without name. Repeated rows
are returned as often as they occur; of rows with a host's smallest page_id the least html is the reference.
Parsing takes time in proportion to the page, whatever is left open; elements nested deeper than DEPTH
become siblings at that depth, which changes no text. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, maybe_broadcast, salted, table

CONSTANT, LEAST = 0.5, 5
DEPTH, SMALL = 200, 8 << 20
#: So many pairs of trees are remembered with their number of matched nodes; more are computed again.
KNOWN = 1 << 20

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math xmp noembed noframes select object".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "body", "html", "caption"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre dt".split())
#: Elements that an element of the same kind closes, and what the search for one stops at.
SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: What is never main text, by tag, role and class or id.
BOILERPLATE_TAGS = frozenset("nav aside footer form button dialog menu fieldset input label canvas audio video head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments disqus replies respond nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar share sharing social related recommended recommendations newsletter subscribe subscription signup login search form widget widgets pagination pager toolbar skip toc tags byline".split()
)
#: Those of them whose elements are no part of the text, even if it varies.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr popup modal overlay comment comments disqus replies respond breadcrumb breadcrumbs share sharing related recommended recommendations newsletter subscribe subscription signup login pagination pager".split()
)
#: Words that make a mark a statement about the element's surroundings.
MODIFIERS = frozenset("with without has have no not is hide show left right".split())
CONTENT_WORDS = frozenset("content article post entry story main body text maincontent articlebody postbody entrycontent".split())

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "marks", "children", "skip", "slot", "mark")

    def __init__(self, tag, marks=""):
        self.tag, self.marks, self.children, self.skip, self.slot, self.mark = tag, marks, [], False, None, 0

    def label(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


def describe(attributes: str) -> tuple[str, str, bool]:
    """class and id, role and itemprop, and whether the element is hidden."""
    marks, roles, hidden = [], [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            marks.append(value)
        elif name in ("role", "itemprop"):
            roles.append(value.lower())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return " ".join(marks), " ".join(roles), hidden


def class_mark(marks: str) -> int:
    """2 for what is foreign to the text, 1 for what may be, 0 for neither, by the names in class and id."""
    found = 0
    for name in marks.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if words and all(w in CONTENT_WORDS for w in words):
            return 0
        kinds = BOILERPLATE_WORDS.intersection(words)
        if not kinds or MODIFIERS.intersection(words) or kinds == {"header"} and CONTENT_WORDS.intersection(words):
            continue
        found = max(found, 2 if kinds & FOREIGN_WORDS else 1)
    return found


def settle(root: Node) -> None:
    """If all the page's articles lie in marked elements or forms, takes the marks off those over the least marked articles."""
    found: list[tuple[int, list[Node]]] = []

    def walk(n: Node, over: list[Node]) -> None:
        for c in n.children:
            if isinstance(c, str) or c.skip and c.tag != "form":
                continue
            above = [*over, c] if c.mark or c.skip else over
            if c.tag in ("article", "main") and not c.mark:
                found.append((max((x.mark or 1 for x in above), default=0), above))
            walk(c, above)

    walk(root, [])
    least = min((rank for rank, _ in found), default=0)
    for rank, above in found if least else []:
        if rank == least:
            for n in above:
                n.mark, n.skip = 0, False


def pieces(page: str):
    """(text, closing, tag, attributes, end): the texts and tags of a page in order, in one pass.

    After a start tag of RAW, what is sent back is where to go on."""
    at, end, lost = 0, len(page), set()
    while at < end:
        less = page.find("<", at)
        if less < 0:
            yield page[at:], False, None, "", end
            return
        if less > at:
            yield page[at:less], False, None, "", less
        if page.startswith("<!--", less):
            stop = page.find("-->", less + 4)
            at = end if stop < 0 else stop + 3
            continue
        name = NAME.match(page, less + 1)
        if name is None:
            stop = page.find(">", less) if page[less + 1 : less + 2] in ("!", "?") else -1
            if stop < 0:
                yield "<", False, None, "", less + 1
            at = less + 1 if stop < 0 else stop + 1
            continue
        # the end of the tag, outside quotes if they are closed
        here = name.end()
        while True:
            found = STOP.search(page, here)
            if found is None or found[0] == ">":
                stop = found.start() if found else -1
                break
            close = -1 if found[0] in lost else page.find(found[0], found.end())
            if close < 0:
                lost.add(found[0])
                stop = page.find(">", name.end())
                break
            here = close + 1
        if stop < 0 and (stop := page.find(">", name.end())) < 0:
            yield page[less:], False, None, "", end
            return
        at = yield "", bool(name[1]), name[2].lower(), page[name.end() : stop], stop + 1
        at = at or stop + 1


def parse(page: str) -> Node:
    """The tree of a page: block elements and texts; inline elements are dissolved."""
    root = Node("html")
    stack, open_, over = [root], Counter(), Counter()

    def close(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    source, on = pieces(page), None
    while True:
        try:
            text, closing, tag, attributes, end = source.send(on)
        except StopIteration:
            break
        on = None
        if tag is None:
            stack[-1].children.append(text)
            continue
        if closing:
            if over[tag]:
                over[tag] -= 1
            elif open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            continue
        if tag in RAW:
            on = re.compile(f"</{tag}(?=[\\s>/])[^>]*>|\\Z", re.I).search(page, end).end()
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "hr":
            stack[-1].children.append(Node("br"))
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or tag in HEADINGS and stack[k].tag in HEADINGS:
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            names, bounds = SIBLINGS[tag]
            if any(open_[n] for n in names.split()):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in names.split():
                        close(k)
                        break
                    if stack[k].tag in bounds:
                        break
        node = Node(tag)
        if attributes:
            marks, roles, hidden = describe(attributes)
            node.marks = re.sub(r"\d+", "0", marks)
            words = {w.lower() for w in WORDS.findall(marks)} if marks else set()
            node.skip = hidden
            if tag not in ("article", "main"):
                node.skip = hidden or any(r in BOILERPLATE_ROLES for r in roles.split())
                node.mark = class_mark(marks)
            elif words & {"comment", "comments", "related", "teaser", "promo", "ad"} and class_mark(marks):
                node.mark = 2
            if tag not in ("article", "main") and (words & CONTENT_WORDS or roles in ("main", "articlebody")):
                node.slot = "content"
        if tag in BOILERPLATE_TAGS or tag == "header" and not (open_["article"] or open_["main"]):
            node.skip = True
        stack[-1].children.append(node)
        if attributes.endswith("/") and tag in ("p", "div"):
            continue
        if len(stack) < DEPTH:
            stack.append(node)
            open_[tag] += 1
        else:
            over[tag] += 1
    settle(root)
    return root


def blocks(node: Node, out: list, path: str) -> None:
    """Appends (slot, text) of each block below a node, in page order; slots of marked elements start with ~."""
    piece: list[str] = []

    def flush(slot: str) -> None:
        text = SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            out.append((slot, text))

    def walk(n: Node, slot: str) -> None:
        for c in n.children:
            if isinstance(c, str):
                piece.append(c)
            elif c.skip or c.mark == 2:
                flush(slot)
            elif c.mark:
                flush(slot)
                inner = "~" + (c.slot or f"{slot}+").lstrip("~")
                walk(c, inner)
                flush(inner)
            elif c.tag in BLOCK:
                flush(slot)
                if c.children:
                    inner = c.slot or f"{slot}+"
                    if slot.startswith("~") and not inner.startswith("~"):
                        inner = f"~{inner}"
                    walk(c, inner)
                    flush(inner)
            else:
                walk(c, slot)

    walk(node, path)
    flush(path)


def below(node: Node):
    for c in node.children:
        if not isinstance(c, str) and not c.skip:
            yield c
            yield from below(c)


def holds_text(node: Node) -> bool:
    return any(bool(c) if isinstance(c, str) else not (c.skip or c.mark) and holds_text(c) for c in node.children)


def outermost(node: Node, kind) -> list[Node]:
    """The topmost unmarked elements of a kind that hold text, in page order."""
    out = []
    for c in node.children:
        if not isinstance(c, str) and not c.skip and not c.mark:
            if kind(c) and holds_text(c):
                out.append(c)
            else:
                out.extend(outermost(c, kind))
    return out


def main_nodes(root: Node) -> list[Node]:
    articles = outermost(root, lambda n: n.tag == "article")
    if articles:
        known = {id(n) for n in articles}
        beside = {id(c) for n in [root, *below(root)] if any(id(c) in known for c in n.children) for c in n.children if not isinstance(c, str) and c.slot == "content"}
        return outermost(root, lambda n: id(n) in known or id(n) in beside)
    return outermost(root, lambda n: n.tag == "main") or outermost(root, lambda n: n.slot == "content") or [root]


def skeleton(node: Node) -> list:
    """Labels and children only, text-free; inline and skipped elements are left out."""
    return [node.label(), [] if node.tag in LEAVES else [skeleton(c) for c in node.children if not isinstance(c, str) and not c.skip and c.tag in BLOCK and c.tag != "br"]]


def kids_of(node: Node) -> list[Node]:
    return [] if node.tag in LEAVES else [c for c in node.children if not isinstance(c, str) and not c.skip and c.tag in BLOCK and c.tag != "br"]


class Shapes:
    """Trees by number: equal ones, of nodes or of a reference, have the same; with label, children's numbers and size."""

    def __init__(self):
        self.of, self.numbers, self.label, self.kids, self.size, self.values = {}, {}, [], [], [], {}

    def number(self, tree) -> int:
        found = self.of.get(id(tree))
        if found is None:
            label, kids = (tree.label(), kids_of(tree)) if isinstance(tree, Node) else tree
            key = label, tuple([self.number(k) for k in kids])
            found = self.of[id(tree)] = self.numbers.setdefault(key, len(self.size))
            if found == len(self.size):
                self.label.append(label)
                self.kids.append(key[1])
                self.size.append(1 + sum(self.size[k] for k in key[1]))
        return found

    def value(self, a: int, b: int) -> int:
        """The greatest number of matched nodes of two trees whose roots match."""
        if a == b or not self.kids[a] or not self.kids[b]:
            return self.size[a] if a == b else 1
        found = self.values.get((a, b))
        if found is None:
            found = 1 + self.pairing(a, b, False)[0]
            if len(self.values) >= KNOWN:
                self.values.clear()
            self.values[a, b] = found
        return found

    def pairing(self, a: int, b: int, places: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """The greatest number of matched nodes below two matched trees, and the places of the matched children.

        Equal trees at both ends of the children are paired at once; no other pairing has more nodes.
        Between them one row of the dynamic program is held at a time; every so many are kept, from which
        those between are made again for the places."""
        kids, refs = self.kids[a], self.kids[b]
        n, m, lo, hi = len(kids), len(refs), 0, 0
        while lo < min(n, m) and kids[lo] == refs[lo]:
            lo += 1
        while hi < min(n, m) - lo and kids[n - 1 - hi] == refs[m - 1 - hi]:
            hi += 1
        total = sum(self.size[k] for k in kids[:lo]) + sum(self.size[k] for k in kids[n - hi :])
        pairs = [(i, i) for i in range(lo)]
        middle, other = kids[lo : n - hi], refs[lo : m - hi]
        if middle and other:
            kinds = {k: i for i, k in enumerate(dict.fromkeys(other))}
            at = np.array([kinds[k] for k in other])
            worth = {k: np.array([self.value(k, r) if self.label[k] == self.label[r] else 0 for r in kinds], np.int32) for k in dict.fromkeys(middle)}

            def row(i: int, below: np.ndarray) -> np.ndarray:
                out = below.copy()
                best = np.maximum(below[:-1], below[1:] + worth[middle[i]][at])
                out[:-1] = np.maximum.accumulate(best[::-1])[::-1]
                return out

            every = math.isqrt(len(middle)) + 1
            gain = np.zeros(len(other) + 1, np.int32)
            kept = {len(middle): gain}
            for i in range(len(middle) - 1, -1, -1):
                gain = row(i, gain)
                if places and i % every == 0:
                    kept[i] = gain
            total += int(gain[0])
            j = 0
            for start in range(0, len(middle) if places else 0, every):
                stop = min(start + every, len(middle))
                rows = {stop: kept[stop]}
                for i in range(stop - 1, start - 1, -1):
                    rows[i] = row(i, rows[i + 1])
                i = start
                while i < stop and j < len(other):
                    here, below, one = rows[i][j], rows[i + 1], worth[middle[i]][at[j]]
                    if one and here == below[j + 1] + one:
                        pairs.append((lo + i, lo + j))
                        i, j = i + 1, j + 1
                    elif here == below[j]:
                        i += 1
                    else:
                        j += 1
        pairs += [(n - hi + k, m - hi + k) for k in range(hi)]
        return total, pairs


def match(node: Node, ref: list, path: str = "") -> int:
    """Simple tree matching: marks matched nodes with the reference's path; returns their number."""
    shapes, total, work = Shapes(), 0, [(node, ref, path)]
    while work:
        node, ref, path = work.pop()
        node.slot = path
        total += 1
        kids = kids_of(node)
        work.extend((kids[i], ref[1][j], f"{path}/{j}") for i, j in shapes.pairing(shapes.number(node), shapes.number(ref))[1])
    return total


def page_blocks(page: str, ref: list | None) -> list[tuple[str, str]]:
    return aligned_blocks(page, ref)[0]


def aligned_blocks(page: str, ref: list | None) -> tuple[list[tuple[str, str]], bool]:
    """The blocks of the main text with their slots, and whether the page has no main element."""
    root = parse(page)
    mains = main_nodes(root)
    for n in below(root):
        n.slot = None
    if ref is not None:
        match(root, ref)
    out: list[tuple[str, str]] = []
    for main in mains:
        blocks(main, out, main.slot or "?")
    # in a body without main element, and without other pages, nothing speaks for what is marked
    return [x for x in out if x[0][0] != "~"] if ref is None or mains == [root] else out, mains == [root]


def digest(slot: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{slot}\n{text}") - (1 << 63)


def slot_texts(batches):
    """For mapInArrow over (host, html, skeleton): host, and a hash of each slot with its text."""
    for batch in batches:
        hosts, out, refs = [], [], {}
        for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            page = page.as_py()
            if page and text is not None:
                ref = refs.setdefault(text, None) or json.loads(text)
                refs[text] = ref
                found = {digest(s, t) for s, t in page_blocks(page, ref) if "+" not in s}
                hosts.extend([host] * len(found))
                out.extend(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.int64())], ["host", "slot"])


def extracted(batches):
    """For mapInArrow over (page_id, url, html, skeleton, constant, enough)."""
    for batch in batches:
        texts, refs = [], {}
        for page, skel, constant, enough in zip(batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
            page = page.as_py()
            if not page:
                texts.append("")
                continue
            if skel is not None and skel not in refs:
                refs[skel] = json.loads(skel)
            found, bare = aligned_blocks(page, refs.get(skel))
            gone = set(constant or ()) if enough or bare else set()
            unmarked = [t for s, t in found if s[0] != "~"]
            varying = [t for s, t in found if digest(s, t) not in gone and (s[0] != "~" or enough and "+" not in s and "?" not in s)]
            texts.append("\n".join(varying or unmarked))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def skeletons(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(skeleton(parse(p)), ensure_ascii=False) for p in batch.column(1).to_pylist()], pa.string())], ["host", "skeleton"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark: SparkSession = pages.sparkSession
    work = Workspace(spark, "pages")
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    full = own.where("html is not null and page_id is not null")
    first = maybe_broadcast(work.keep(full.groupBy("host").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages")), "hosts"))
    refs = full.join(first.select("host", "page_id"), ["host", "page_id"], "left_semi").groupBy("host").agg(F.min("html").alias("html")).select("host", "html")
    refs = refs.mapInArrow(skeletons, "host string, skeleton string").join(first.select("host", (F.col("pages") >= LEAST).alias("enough")), "host")
    refs = work.keep(refs, "skeletons")
    slots = with_hosts(own.select("host", "html"), refs.drop("enough"), "inner", "skeleton").select("host", "html", "skeleton").mapInArrow(slot_texts, "host string, slot long")
    often = slots.groupBy("host", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    needed = F.when(F.col("pages") >= LEAST, F.greatest(F.lit(float(LEAST)), CONSTANT * F.col("pages"))).otherwise(F.col("pages"))
    constant = often.join(first.select("host", "pages"), "host").where(F.col("n") >= needed)
    # of one slot at most 1 / CONSTANT texts are constant, so these sets are bounded by the skeleton
    constant = constant.groupBy("host").agg(F.collect_set("slot").alias("constant"))
    wrappers = work.keep(refs.join(constant, "host", "left"), "wrappers")
    ready = with_hosts(own, wrappers, "left", "skeleton", "constant").select("page_id", "url", "html", "skeleton", "constant", "enough")
    return ready.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def with_hosts(pages: DataFrame, hosts: DataFrame, how: str, *columns: str) -> DataFrame:
    """pages.join(hosts, "host", how): a broadcast if the given columns hold SMALL bytes at most."""
    kinds = dict(hosts.dtypes)
    size = sum((F.length(c) if kinds[c] == "string" else 8 * F.coalesce(F.size(c), F.lit(0)) for c in columns), F.length("host") + 16)
    if (hosts.agg(F.sum(size).alias("n")).first()["n"] or 0) <= SMALL:
        return pages.join(F.broadcast(hosts), "host", how)
    return salted(pages, hosts, ["host"], how)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLES: dict[str, str] = {}
