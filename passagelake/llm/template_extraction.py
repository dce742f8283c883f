"""Main text of web pages by equivalence-class template deduction.

Pages of one host tend to come from one template. Each page is read as tokens: its elements, named by their path
of tags and classes, and its texts, named by path and content. Tokens with the same occurrence vector over the
host's distinct pages (copies count once) form an equivalence class; the vector enters as a sum of keyed page numbers
times counts, so it is aggregated like any sum and no page list is ever gathered. Classes of two tokens or more that
stand in at least half of these pages are the template, as far as they are valid: a second reading of the pages drops
tokens that break their class's order and classes that do not nest with a larger one; a token alone is data. What
the template leaves open are its slots, each below the deepest template element that holds it; a slot is told by
its elements (menu, footer, advert ...), its links and its amount of text, and the host's main slot is kept.
Template texts outside an article, or what is named as one, are dropped. A page without its host's main slot is judged by itself.

Per host only tokens of at least SUPPORT of its pages are brought together: their number is bounded by the tokens of
a page over SUPPORT. Templates join the pages by host; Spark broadcasts them only below its size threshold, and
splits hot hosts in the shuffle otherwise.

Defined cases: a null or empty html gives the empty text; a null or odd url has no host, its page is judged by itself;
repeated rows are each extracted; a page is read in time linear in its length, however broken or deep it is, and elements
below a path of PATH characters share it; an empty table gives an empty result; extra columns are ignored. Blocks are joined
by a line feed, white space inside a block becomes one space, character references are decoded.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

SUPPORT = 0.2
TEMPLATE = 0.5
LEAST_PAGES = 3  # a host with fewer distinct pages shows no template
LARGE = 2  # a token alone with its vector is data, not template

#: A tag as it should be, found without going back; `<` and `>` within quotes are left to LOOSE.
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^'\"<>]++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
OPENED = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)")
LOOSE = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>")
LOOSE_MISSES = 4  # so often a page's end is looked for behind an unclosed quote; then quotes no longer count
RAW = frozenset("script style noscript template iframe svg textarea select title object math canvas".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
PATH = 4000  # an element below a path of so many characters shares it
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text, and words in class, id or role that say so of any element (fixed values).
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog head select option label fieldset".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus dialog feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promos promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar widget widgets alert".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
BOUNDS = frozenset("article main nav footer aside body table".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}


def named(attributes: str) -> str:
    """The element's classes, ids and roles, without what looks like a counter."""
    found = " ".join(a or b or c for a, b, c in NAMED.findall(attributes))
    return ".".join(sorted({w for w in re.split(r"[^\w-]+", found) if w and not any(c.isdigit() for c in w)}))


class Node:
    __slots__ = ("tag", "path", "aside", "inside", "link", "block", "bound")

    def __init__(self, tag: str, names: str, parent: "Node | None", depth: int = 0):
        self.tag = tag
        above = parent.path if parent else ""
        self.path = f"{above}>{tag}{'.' * bool(names)}{names}" if len(above) < PATH else above
        # depths of the nearest block and of the nearest element that an inline end tag does not leave
        self.block = depth if tag in BLOCKS else parent.block if parent else 0
        self.bound = depth if tag in BOUNDS else parent.bound if parent else 0
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        words = {w.lower() for n in names.split(".") for w in PART.findall(n)} if names else ()
        apart = tag in ASIDE_TAGS or (tag == "header" and not self.inside) or (tag not in ("html", "body", "article", "main") and any(w in ASIDE_WORDS for w in words))
        self.aside = bool(parent and parent.aside) or apart
        self.link = tag == "a" or bool(parent and parent.link)


def markup(page: str):
    """(text, closing, tag, attributes): each tag with the text before it, the rest at last with no tag; in time linear in the page.

    Comments and raw elements (scripts and the like) are left out, sections of character data are text. An unclosed
    comment or raw element goes to the page's end. A tag whose quote is never closed ends at the next `>`; where
    there is none, it is dropped up to the next `<`."""
    at, look, misses, last = 0, 0, 0, page.rfind(">")
    while (i := page.find("<", look)) >= 0:
        m = TAG.match(page, i)
        if m:
            end, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        elif m := OPENED.match(page, i):
            closing, tag, close = m[1], m[2].lower(), None
            if i > last:
                yield page[at:i], "", "", ""
                following = page.find("<", i + 1)
                at = look = len(page) if following < 0 else following
                continue
            if misses < LOOSE_MISSES:
                close = LOOSE.match(page, m.end())
                misses += close is None
            stop = close.end() - 1 if close else page.find(">", m.end())
            end, attributes = stop + 1, page[m.end() : stop]
        elif page.startswith("<!--", i):
            stop = page.find("-->", i + 4)
            yield page[at:i], "", "", ""
            at = look = len(page) if stop < 0 else stop + 3
            continue
        elif page.startswith("<![CDATA[", i):
            stop = page.find("]]>", i + 9)
            yield page[at:i] + entities.escape(page[i + 9 : len(page) if stop < 0 else stop], quote=False), "", "", ""
            at = look = len(page) if stop < 0 else stop + 3
            continue
        elif page[i + 1 : i + 2] in ("!", "?", "/") and i < last:
            yield page[at:i], "", "", ""
            at = look = page.find(">", i) + 1
            continue
        else:
            look = i + 1
            continue
        if tag in RAW and not closing:
            found = RAW_END[tag].search(page, end)
            end, tag = found.end() if found else len(page), ""
        yield page[at:i], closing, tag, attributes
        at = look = end
    yield page[at:], "", "", ""


def read(page: str) -> tuple[list[tuple[Node, str, int, int, int]], dict[str, list[int]]]:
    """The page's blocks in order, (element, text, characters, of them in links, place), and the places of each element's path."""
    root = Node("", "", None)
    stack, opens, blocks, paths, pieces, linked = [root], {}, [], {}, [], 0
    holder, place, begun = root, 0, 0

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                blocks.append((holder, text, len(text), linked, begun))
            pieces, linked = [], 0

    def said(text: str) -> None:
        nonlocal linked, holder, place, begun
        if not pieces:
            if not text or text.isspace():
                return
            holder, place = stack[-1], place + 1
            begun = place
        pieces.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    def leave(depth: int) -> None:
        for node in reversed(stack[depth:]):
            opens[node.tag].pop()
        del stack[depth:]

    for text, closing, tag, attributes in markup(page):
        if text:
            said(text)
        if not tag:
            continue
        top = stack[-1]
        if tag in BLOCKS:
            close()
        elif tag == "br":
            said(" ")
        if closing:
            depths = opens.get(tag)
            if depths and (tag in BLOCKS or depths[-1] >= top.bound):
                if top.aside != stack[depths[-1] - 1].aside:
                    close()
                leave(depths[-1])
            continue
        if tag in BLOCKS and top.block:
            nearest = stack[top.block].tag
            if nearest == "p" or nearest in CLOSES.get(tag, "").split():
                leave(top.block)
        if tag in VOID:
            continue
        node = Node(tag, named(attributes) if "=" in attributes else "", stack[-1], len(stack))
        if node.aside != stack[-1].aside:
            close()
        if not attributes.endswith("/") or tag in BLOCKS:
            opens.setdefault(tag, []).append(len(stack))
            stack.append(node)
        place += 1
        paths.setdefault(node.path, []).append(place)
    close()
    return blocks, paths


@lru_cache(maxsize=4096)
def region(path: str) -> str:
    steps = path.split(">")
    while len(steps) > 2 and steps[-1].split(".")[0] not in ("article", "main", "section", "div", "td", "body", "html", "nav", "footer", "header", "aside"):
        steps.pop()
    return ">".join(steps)


def container(node: Node) -> str:
    """The path of the region that holds a block: without the block's own paragraph, list item or inline elements."""
    return region(node.path)


def under(path: str, root: str) -> bool:
    return path == root or path.startswith(root + ">")


def main_root(regions: dict[str, tuple[int, int]]) -> str | None:
    """Of regions path -> (characters, of them in links), all outside menus and the like: the root of the main text."""
    steps = {}
    for path, (chars, links) in regions.items():
        parts = path.split(">")
        for i in range(1, len(parts)):
            root = ">".join(parts[: i + 1])
            total = steps.setdefault(root, [0, 0])
            total[0] += chars
            total[1] += links
    if not steps:
        return None
    for tag in ("article", "main"):
        found = [p for p in steps if p.rsplit(">", 1)[1].split(".")[0] == tag and not any(s.split(".")[0] == tag for s in p.split(">")[:-1])]
        if found:
            return max(found, key=lambda p: (steps[p][0] - steps[p][1], p))
    said = [p for p in steps if MAIN_WORDS & {w.lower() for w in PART.findall(p.rsplit(">", 1)[1].partition(".")[2])} and 2 * steps[p][1] < steps[p][0]]
    if said:
        return max(said, key=lambda p: (steps[p][0] - steps[p][1], -len(p), p))
    # the deepest region with nearly all of the plain text
    all_plain = max(a - b for a, b in steps.values())
    return max((p for p, (a, b) in steps.items() if 10 * (a - b) >= 8 * all_plain), key=lambda p: (p.count(">"), p))


def regions_of(blocks) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for node, _, chars, links, _ in blocks:
        if not node.aside:
            key = container(node)
            a, b = out.get(key, (0, 0))
            out[key] = (a + chars, b + links)
    return out


def text_token(path: str, text: str) -> int:
    raw = f"{path}\n{text}".encode()
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


def classes_of(tokens: pd.DataFrame, pages: int) -> list[list[int]]:
    """The large classes of a host that span its pages, each the rows' numbers in the order of the tokens' mean places.

    Tokens of one vector stand in the same pages, so if one precedes another in each of them, its sum of places is less.
    """
    frequent = tokens[tokens.n_pages >= TEMPLATE * pages].sort_values(["places", "member"])
    return [list(rows) for rows in frequent.groupby("vector").groups.values() if len(rows) >= LARGE] if pages >= LEAST_PAGES else []


def misplaced(places: dict[int, list[int]], classes: list[list[int]]) -> set[int]:
    """Members of classes that break their class's order, or whose class does not nest with a larger one, in a page with these places of tokens."""
    bad: set[int] = set()
    events: list[tuple[int, int, int, int]] = []
    for c, members in enumerate(classes):
        first = before = None
        valid = []
        for m in members:
            own = places.get(m)
            if own is None:  # the class is not in this page
                continue
            if before is not None and not (len(own) == len(before) and all(a < b for a, b in zip(before, own)) and all(a < b for a, b in zip(own, first[1:]))):
                bad.add(m)
                continue
            first, before = first or own, own
            valid.append(own)
        for k, own in enumerate(valid):
            events += [(p, c, k, len(valid)) for p in own]
    # each round of a class opens with its first token and closes with its last; what opens in between closes in between
    out: set[int] = set()
    stack: list[int] = []
    for _, c, k, n in sorted(events):
        if c in out:
            continue
        if k:
            while stack[-1] != c:
                d = stack[-1]
                if (len(classes[d]), -d) > (len(classes[c]), -c):
                    out.add(c)
                    stack.remove(c)
                    break
                out.add(d)
                stack.pop()
            if c in out:
                continue
        else:
            stack.append(c)
        if k == n - 1:
            stack.pop()
    return bad.union(*(classes[c] for c in out))


def deduce(tokens: pd.DataFrame, pages: int) -> tuple[str | None, list[int]]:
    """(main slot's root, template texts) of a host from its tokens: path, token (0: an element), member, vector, n_pages, places, chars, links, bad (misplaced)."""
    if pages < LEAST_PAGES:
        return None, []
    valid = [kept for c in classes_of(tokens, pages) if len(kept := [k for k in c if not tokens.bad[k]]) >= LARGE]
    rows = tokens.loc[[k for c in valid for k in c]]
    template = set(rows.path[rows.token == 0])
    texts = [int(t) for t in rows.token[rows.token != 0]]
    slots: dict[str, tuple[int, int]] = {}
    for path, chars, links in tokens.loc[(tokens.token == 0) & (tokens.chars > 0), ["path", "chars", "links"]].itertuples(index=False):
        at = path
        while at not in template and ">" in at[1:]:
            at = at.rsplit(">", 1)[0]
        a, b = slots.get(at, (0, 0))
        slots[at] = (a + int(chars), b + int(links))
    return main_root(slots), texts


def page_text(blocks, root: str | None, texts: frozenset[int]) -> str:
    """The blocks of the main slot, joined."""
    own = [b for b in blocks if not b[0].aside]
    kept = [b for b in own if root and under(b[0].path, root)]
    if not kept:
        root = main_root(regions_of(own))
        kept = [b for b in own if root and under(b[0].path, root)]
    # in an article, or what is named as one, a text that many pages share is still the page's own
    step = (root or "").rsplit(">", 1)[-1]
    sure = step.split(".")[0] in ("article", "main") or MAIN_WORDS & {w.lower() for w in PART.findall(step.partition(".")[2])}
    return "\n".join(text for node, text, *_ in kept if sure or node.inside or not texts or text_token(container(node), text) not in texts)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page."""
    host = F.lower(F.regexp_extract(F.col(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    base = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), host.alias("host"))
    id_kind, url_kind = base.schema["page_id"].dataType.simpleString(), base.schema["url"].dataType.simpleString()

    # copies of a page say nothing of a template: each distinct page of a host counts once
    key = [F.xxhash64("html"), F.xxhash64(F.lit(17), "html", F.lit(29))]
    distinct = base.filter((F.col("host") != "") & (F.col("html") != "")).select("host", "html", key[0].alias("h1"), key[1].alias("h2")).dropDuplicates(["host", "h1", "h2"]).select("host", "html", "h1")

    def tokens(batches):
        for batch in slices(batches, "html"):
            sums: dict[tuple, list] = {}
            for h, number, page in zip(batch.column("host").to_pylist(), batch.column("h1").to_pylist(), batch.column("html").to_pylist()):
                blocks, paths = read(page)
                key = number & 0x7FFFFFFFFFFFFFFF
                mine: dict[tuple, list] = {(h, "", 0): [1, 0, 0, 0]} | {(h, p, 0): [len(x), 0, 0, x[0]] for p, x in paths.items()}
                for node, text, chars, links, place in blocks:
                    path = container(node)
                    mine.setdefault((h, path, text_token(path, text)), [0, 0, 0, place])[0] += 1
                    if not node.aside:
                        region = mine.setdefault((h, path, 0), [0, 0, 0, place])
                        region[1] += chars
                        region[2] += links
                for k, (n, chars, links, place) in mine.items():
                    s = sums.setdefault(k, [0, 0, 0, 0, 0])
                    s[0] += 1
                    s[1] = s[1] + key * n & 0xFFFFFFFFFFFFFFFF
                    s[2] += chars
                    s[3] += links
                    s[4] += place
            keys, values = list(sums), list(sums.values())
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), *[pa.array(np.asarray([v[i] for v in values], np.uint64).astype(np.int64)) for i in range(5)], pa.array([k[2] or text_token(k[1], "") for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "token", "n_pages", "vector", "chars", "links", "places", "member"])

    wrapped = F.sum(F.col("vector").cast("decimal(38,0)"))
    counted = distinct.mapInArrow(tokens, "host string, path string, token long, n_pages long, vector long, chars long, links long, places long, member long")
    # sums of vectors may pass 64 bits; equality of the exact sums is what counts
    counted = counted.groupBy("host", "path", "token", "member").agg(F.sum("n_pages").alias("n_pages"), wrapped.alias("vector"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("places").alias("places"))
    counted = counted.filter((F.col("token") == 0) | (F.col("n_pages") >= LEAST_PAGES)).transform(stored, "page-tokens")
    totals = counted.filter((F.col("path") == "") & (F.col("token") == 0)).select("host", F.col("n_pages").alias("pages"))
    frequent = counted.filter("path <> ''").join(totals, "host").filter(F.col("n_pages") >= SUPPORT * F.col("pages"))

    frequent = frequent.withColumn("vector", F.col("vector").cast("string"))

    def host_classes(rows: pd.DataFrame) -> pd.DataFrame:
        found = classes_of(rows, int(rows.pages.iloc[0]))
        return pd.DataFrame({"host": [rows.host.iloc[0]], "classes": [[rows.member[c].tolist() for c in found]]})

    classes = stored(frequent.groupBy("host").applyInPandas(host_classes, "host string, classes array<array<long>>"), "classes")

    def breaches(batches):
        seen = set()
        for batch in slices(batches, "html"):
            out = []
            for h, page, known in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("classes").to_pylist()):
                blocks, paths = read(page)
                places = {text_token(p, ""): x for p, x in paths.items()}
                for node, text, _, _, place in blocks:
                    path = container(node)
                    places.setdefault(text_token(path, text), []).append(place)
                out += [x for m in misplaced(places, known) if (x := (h, m)) not in seen]
                seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["host", "member"])

    bad = distinct.join(classes.filter(F.size("classes") > 0), "host").select("host", "html", "classes").mapInArrow(breaches, "host string, member long").distinct()
    judged = frequent.join(bad.withColumn("bad", F.lit(True)), ["host", "member"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))

    def host_template(rows: pd.DataFrame) -> pd.DataFrame:
        root, texts = deduce(rows, int(rows.pages.iloc[0]))
        return pd.DataFrame({"host": [rows.host.iloc[0]], "root": [root], "texts": [texts]})

    templates = stored(judged.groupBy("host").applyInPandas(host_template, "host string, root string, texts array<long>"), "templates")

    def texts_of(batches):
        for batch in slices(batches, "html"):
            out = []
            for page, root, texts in zip(batch.column("html").to_pylist(), batch.column("root").to_pylist(), batch.column("texts").to_pylist()):
                out.append(page_text(read(page)[0], root, frozenset(texts or ())) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = base.join(templates, "host", "left").select("page_id", "url", "html", "root", "texts")
    return joined.mapInArrow(texts_of, f"page_id {id_kind}, url {url_kind}, text string, n_chars long")
