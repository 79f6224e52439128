"""Main text of web pages by equivalence-class template deduction.

Over the pages of one host, tokens (where an element begins and ends, told apart by its path, and text nodes with their path)
have occurrence vectors: how often each page holds them. Tokens with one vector form a class. A class on enough of a host's
pages is valid if every page holds its elements in the same order, again and again, without other classes crossing it, and always in the
same slot of another class; valid classes so nest into the host's template. Text with the vector of a valid class that always
stands in the same slot is template, whatever its markup; the rest fills slots. The slot of the article is found from the page downwards: an element of
the template is entered while it holds most of the slot text of the one around it. The main text is what that slot holds,
without elements that are chrome by name or role. Hosts with too few pages for a template are read by their markup alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch, text_or_empty

SUPPORT, LEAST_PAGES = 0.5, 3  # a class belongs to the template from half of a host's pages, three at least
SHARE = 0.6  # of the slot text around it that an element must hold to be entered
SURE_PAGES = 5  # text inside a marked article is template only if every page of a host of so many holds it
BROADCAST_BYTES = 64 << 20  # templates of all hosts up to this size are broadcast; beyond that they are joined by host
PAGE = 1  # the token that stands for the page itself
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
DIGITS = re.compile(r"\d+")  # numbers in names tell pages apart, not elements
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)"
# Element names.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CHROME = {"aside", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "input", "label", "menu", "nav", "noscript", "object", "option", "select", "svg", "template", "audio", "video"}
CONTAINER = {"article", "body", "center", "div", "html", "main", "section", "table", "tbody", "td", "tr"}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME_NAME = re.compile(
    r"^(ad|ads|advert\w*|adbox|ad[-_].*|.*[-_]ads?|banner|breadcrumbs?|byline-share|comments?|comment[-_].*|.*[-_]comments?|respond|disqus\w*|cookies?|cookie[-_].*|consent|gdpr|"
    r"footer|foot|header|masthead|menu|nav|navbar|navigation|nav[-_].*|.*[-_]nav|sidebar|side[-_]?bar|widget\w*|newsletter|subscribe|subscription|notice|alert|popup|modal|overlay|"
    r"pagination|pager|promo\w*|related|related[-_].*|recommended|share|sharing|share[-_].*|social|social[-_].*|sponsor\w*|skip-link|toolbar|tracking|hidden|sr-only|login|signup)$",
    re.I,
)


class Node:
    """An element: token of its start, the element around it, how its markup reads, and a mark for whoever walks."""

    __slots__ = ("tag", "path", "chrome", "content", "up", "mark")

    def __init__(self, tag: str, path: int, chrome: bool, content: bool, up: Node | None) -> None:
        self.tag, self.path, self.chrome, self.content, self.up, self.mark = tag, path, chrome, content, up, -1

    @property
    def end(self) -> int:
        """Token of the element's end."""
        return self.path ^ 0x5555555555555555

    @property
    def depth(self) -> int:
        return 0 if self.up is None else self.up.depth + 1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2].strip("\"'") if m[2] else "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def walk(page: str) -> Iterator[tuple[str, Node, str]]:
    """Events of a page in order: ("open" | "close" | "text", element, raw text). Broken nesting is mended as browsers do."""
    root = Node("", PAGE, False, False, None)
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            yield "text", stack[-1], page[at:]
            break
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        yield "close", stack.pop(), ""
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i].tag
            if name == "p" and tag in CLOSES_P or tag in SAME and name in SAME[tag]:
                while len(stack) > i:
                    yield "close", stack.pop(), ""
                break
            if name in BLOCK and name != "p":
                break
        attributes = _attributes(m[3])
        names = [*attributes.get("class", "").split(), attributes.get("id", "")]
        up = stack[-1]
        content = tag in ("article", "main") or attributes.get("role", "") == "main" or "articleBody" in attributes.get("itemprop", "")
        chrome = up.chrome or tag in CHROME or any(CHROME_NAME.match(x) for x in names if x) or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        chrome = chrome or attributes.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert") or "display:none" in attributes.get("style", "").replace(" ", "")
        chrome = chrome or tag == "header" and not any(x.content for x in stack)
        named = DIGITS.sub("", f"{' '.join(sorted(names[:-1]))}#{names[-1]}")
        path = xxhash.xxh64_intdigest(f"{up.path}/{tag}.{named}")
        node = Node(tag, path, chrome, content or up.content, up)
        yield "open", node, ""
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)


def _text_token(node: Node, raw: str) -> int:
    return xxhash.xxh64_intdigest(f"{node.path}={' '.join(raw.split())}")


def tokens(page: str) -> dict[int, list[int]]:
    """Tokens of a page: how often, where first, and whether they are text. Text in chrome has none."""
    out: dict[int, list[int]] = {PAGE: [1, -1, 0]}
    for at, (kind, node, raw) in enumerate(walk(page)):
        if kind == "text" and (node.chrome or raw.isspace()):
            continue
        t = node.path if kind == "open" else node.end if kind == "close" else _text_token(node, raw)
        if (x := out.get(t)) is None:
            out[t] = [1, at, int(kind == "text")]
        else:
            x[0] += 1
    return out


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and (host, token): pages, occurrences, and sums of hashes of (page, count), which stand for the vector.

    Sums, so that repeated rows add up; the place is the one on the page with the lowest hash, the same page for a class.
    """
    for frame in frames:
        seen: dict[tuple[str, int], list[int]] = {}
        for page_id, host, page in zip(frame["page_id"], frame["host"], frame["html"]):
            own = xxhash.xxh64_intdigest(f"{page_id}:{page}") >> 1
            hashes: dict[int, int] = {}
            for token, (n, at, text) in tokens(page).items():
                if (h := hashes.get(n)) is None:
                    h = hashes[n] = xxhash.xxh64_intdigest(f"{own}:{n}")
                if (x := seen.get((host, token))) is None:
                    seen[host, token] = [1, n, h & 0xFFFFFFFF, h >> 32, own, at, text]
                    continue
                x[0] += 1
                x[1] += n
                x[2] += h & 0xFFFFFFFF
                x[3] += h >> 32
                if own < x[4]:
                    x[4], x[5] = own, at
        if seen:
            values = np.array(list(seen.values()), np.int64)
            out = pd.DataFrame(values, columns=["pages", "n", "low", "high", "page", "at", "text"])
            out.insert(0, "host", [h for h, _ in seen])
            out.insert(1, "token", np.array([t for _, t in seen], np.uint64).view(np.int64))
            yield out


#: Columns of a packed class table, one row per token: its class, place in the class, size of the class, whether it is text,
#: once on each page that holds it, on every page, the number of the vector, and the host's pages.
CLASS_COLUMNS = ["token", "own", "index", "size", "text", "once", "every", "vector", "of"]


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Classes of a host as one binary table."""
    for frame in frames:
        out = []
        for classes in frame["classes"]:
            rows, vectors = [], {}
            for no, c in enumerate(classes):
                vector = vectors.setdefault((c["low"], c["high"], c["pages"]), len(vectors))
                rest = (len(c["tokens"]), c["text"], c["n"] == c["pages"], c["pages"] == c["of"], vector, c["of"])
                rows += [(t["token"], no, i, *rest) for i, t in enumerate(c["tokens"])]
            out.append(np.array(rows, np.int64).tobytes())
        yield pd.DataFrame({"host": frame["host"], "classes": out})


class Classes:
    """A host's classes, read from their packed table."""

    def __init__(self, raw: bytes) -> None:
        table = np.frombuffer(raw, np.int64).reshape(-1, len(CLASS_COLUMNS))
        self.row = {t: r for r, t in enumerate(table[:, 0].view(np.uint64).tolist())}
        self.own, self.index, self.size, self.text, self.once, self.every, self.vector, self.of = table[:, 1:].T.tolist()


def _known(raw: bytes, read, memo: dict, size: int = 2_000):
    if (out := memo.get(raw)) is None:
        if len(memo) >= size:
            memo.clear()
        out = memo[raw] = read(raw)
    return out


#: What is gathered for each token of a host's classes.
FACTS = ["bad", "place_least", "place_most", "held", "held_up", "heads", "heads_up", "up", "kind"]
_START = [0, 2**62, -1, 0, 0, 0, 0, -1, 0]


def _kind(node: Node) -> int:
    """3: the page's main part; 2: an article; 1: another element that can enclose one; 0: any other."""
    if node.tag == "main":
        return 3
    return 2 if node.tag == "article" or node.content and not node.up.content else int(node.tag in CONTAINER)


def place(page: str, classes: Classes, facts: np.ndarray) -> None:
    """Add one page's evidence: order and nesting of the classes, and slot text and headings that elements hold."""
    progress: dict[int, int] = {}
    stack: list[int] = []  # classes begun and not ended
    held: dict[int, list[int]] = {}  # per token row: slot text, headings, row of the element around
    wrong: set[int] = set()

    def meet(r: int) -> None:
        c, i = classes.own[r], classes.index[r]
        if progress.get(c, 0) != i:
            wrong.add(c)
            return
        if i == 0:
            where = (stack[-1] + 1 << 31) + progress[stack[-1]] if stack else 0
            facts[r, 1], facts[r, 2] = min(facts[r, 1], where), max(facts[r, 2], where)
            stack.append(c)
        else:
            while stack and stack[-1] != c:  # begun inside and not ended: they cross
                wrong.add(x := stack.pop())
                progress.pop(x, None)
        progress[c] = i + 1
        if i + 1 == classes.size[r]:
            if stack and stack[-1] == c:
                stack.pop()
            progress[c] = 0

    def climb(node: Node, what: int, n: int) -> None:
        r = node.mark
        while r >= 0:
            held[r][what] += n
            r = held[r][2]

    top = classes.row.get(PAGE, -1)
    if top >= 0:
        held[top] = [0, 0, -1]
        meet(top)
    for kind, node, raw in walk(page):
        if node.up is None and node.mark < 0:
            node.mark = top
        if kind == "open":
            if node.up.up is None:
                node.up.mark = top
            r = classes.row.get(node.path, -1)
            node.mark = node.up.mark
            if r >= 0:
                if r not in held:
                    held[r] = [0, 0, node.mark]
                    facts[r, 7], facts[r, 8] = node.mark, _kind(node)
                node.mark = r
                meet(r)
            if node.tag == "h1" and not node.chrome:
                climb(node, 1, 1)
        elif kind == "close":
            if (r := classes.row.get(node.end, -1)) >= 0:
                meet(r)
        elif not node.chrome and not raw.isspace():
            if (r := classes.row.get(_text_token(node, raw), -1)) >= 0:
                meet(r)
            else:
                climb(node, 0, len(raw))
    wrong.update(c for c, i in progress.items() if i)
    for r, (text, heads, up) in held.items():
        facts[r, 3] += text
        facts[r, 5] += heads
        if up >= 0:
            facts[r, 4] += held[up][0]
            facts[r, 6] += held[up][1]
    if wrong:
        facts[np.isin(classes.own, list(wrong)), 0] = 1


def _placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[bytes, Classes] = {}
    for frame in frames:
        hosts: dict[str, tuple[Classes, np.ndarray]] = {}
        for host, page, raw in zip(frame["host"], frame["html"], frame["classes"]):
            if host not in hosts:
                classes = _known(raw, Classes, memo)
                hosts[host] = classes, np.tile(np.array(_START, np.int64), (len(classes.own), 1))
            place(page, *hosts[host])
        for host, (_, facts) in hosts.items():
            out = pd.DataFrame(facts, columns=FACTS)
            out.insert(0, "host", host)
            out.insert(1, "row", np.arange(len(facts), dtype=np.int64))
            yield out


def template(classes: Classes, facts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Rows of a host's template: elements that enclose the article, sure template text, and other template text."""
    m = len(classes.own)
    bad = {classes.own[r] for r in range(m) if facts[r, 0] or classes.index[r] == 0 and facts[r, 1] != facts[r, 2]}
    valid = [classes.own[r] not in bad for r in range(m)]
    of_elements = {classes.vector[r] for r in range(m) if valid[r] and not classes.text[r]}
    texts = [r for r in range(m) if classes.text[r] and valid[r] and classes.vector[r] in of_elements]
    sure = [r for r in texts if classes.every[r] and classes.of[r] >= SURE_PAGES]
    inside: dict[int, list[int]] = {}
    for r in range(m):
        if valid[r] and classes.once[r] and facts[r, 8] and facts[r, 7] >= 0:
            inside.setdefault(int(facts[r, 7]), []).append(r)
    entered, new = [], [r for r in range(m) if facts[r, 3] and facts[r, 7] < 0 and not classes.text[r]]
    while new:
        up = new.pop()
        for r in inside.get(up, ()):
            allowed = facts[up, 8] != 2 and (facts[up, 8] != 3 or facts[r, 8] == 2)
            if allowed and facts[r, 3] >= SHARE * facts[r, 4] > 0 and facts[r, 5] >= facts[r, 6]:
                entered.append(r)
                new.append(r)
    return sorted(entered), sure, [r for r in texts if r not in set(sure)]


def _deduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A host's classes and facts to its template: counts of the three kinds of tokens, then the tokens."""
    for frame in frames:
        out = []
        for raw, facts in zip(frame["classes"], frame["facts"]):
            classes = Classes(raw)
            table = np.tile(np.array(_START, np.int64), (len(classes.own), 1))
            for f in facts:
                table[f["row"]] = [f[n] for n in FACTS]
            parts = template(classes, table)
            tokens_ = np.frombuffer(raw, np.int64).reshape(-1, len(CLASS_COLUMNS))[:, 0]
            out.append(np.concatenate([[len(x) for x in parts], *(tokens_[x] for x in parts)]).astype(np.int64).tobytes())
        yield pd.DataFrame({"host": frame["host"], "template": out})


class Template:
    def __init__(self, raw: bytes | None) -> None:
        cells = np.frombuffer(raw, np.int64).view(np.uint64).tolist() if raw else [0, 0, 0]
        a, b, c = cells[:3]
        self.entered, self.sure, self.texts = frozenset(cells[3 : 3 + a]), frozenset(cells[3 + a : 3 + a + b]), frozenset(cells[3 + a : 3 + a + b + c])


def main_text(page: str, known: Template) -> str:
    """Blocks of the article's slot, joined by an empty line."""
    events = list(walk(page))
    root, deep = None, 0
    for kind, node, _ in events:
        if kind == "open" and node.path in known.entered and not node.chrome and node.depth > deep:
            root, deep = node, node.depth
    marked = False
    for kind, node, _ in events:
        if kind == "open":
            node.mark = int(root is None or node is root or node.up.mark == 1)
            marked = marked or node.mark == 1 and node.content and not node.chrome
    blocks, line = [], []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    for kind, node, raw in events:
        if kind == "text":
            slot = not node.chrome and (root is None or node.mark == 1) and (node.content or not marked)
            if slot and ((t := known.sure if node.content else known.texts) and _text_token(node, raw) in t):
                slot = False
            if slot:
                line.append(entities.unescape(raw))
        elif node.tag in BLOCK:
            flush()
        elif node.tag == "br":
            line.append("\n")
    flush()
    return "\n\n".join(blocks)


def _by_host(rows: DataFrame, small: DataFrame, column: str, how: str) -> DataFrame:
    """``rows`` with the column of their host; broadcast where the column's bytes are few enough."""
    size = small.agg(F.sum(F.octet_length(column) + F.octet_length("host"))).first()[0] or 0
    return rows.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, "host", how)


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(host, template binary)`` from (page_id, host, html), for hosts with pages enough.

    A template holds tokens of at least half of a host's pages, so its size follows the size of a page, not the number of
    pages. Statistics cover every page.
    """
    met = pages.mapInPandas(_vectors, "host string, token bigint, pages bigint, n bigint, low bigint, high bigint, page bigint, at bigint, text bigint")
    first = F.min(F.struct("page", "at")).alias("first")
    vectors = met.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "low", "high")), first, F.max("text").alias("text"))
    vectors = scratch.save(vectors.where(F.col("pages") >= LEAST_PAGES), "vectors")
    hosts = vectors.where(F.col("token") == PAGE).select("host", F.col("pages").alias("of"))
    frequent = vectors.join(hosts, "host").where(F.col("pages") >= F.ceil(F.col("of") * SUPPORT))
    # Elements of one vector are a class; a text with that vector is held against it on its own, by the slot it stands in.
    alone = F.when(F.col("text") == 1, F.col("token")).alias("alone")
    found = frequent.groupBy("host", "text", "low", "high", "pages", "n", "of", alone).agg(F.array_sort(F.collect_list(F.struct(F.col("first.at").alias("at"), "token"))).alias("tokens"))
    found = found.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("text", "low", "high", "pages", "n", "of", "tokens"))).alias("classes"))
    found = scratch.save(found.mapInPandas(_packed, "host string, classes binary"), "classes")
    placed = _by_host(pages.select("host", "html"), found, "classes", "inner").mapInPandas(_placed, "host string, row bigint, " + ", ".join(f"{f} bigint" for f in FACTS))
    gathered = {"place_least": F.min, "held": F.sum, "held_up": F.sum, "heads": F.sum, "heads_up": F.sum}
    facts = placed.groupBy("host", "row").agg(*(gathered.get(f, F.max)(f).alias(f) for f in FACTS))
    facts = facts.groupBy("host").agg(F.collect_list(F.struct("row", *FACTS)).alias("facts"))
    return found.join(facts, "host").mapInPandas(_deduced, "host string, template binary")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    Returns one row per input row: ``(page_id, url, text, n_chars)``. A null html counts as empty and gives an empty
    text; a null or odd url makes the page one of the host "" (pages of a host without a template are read by their
    markup alone). Repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    rows = pages.select("page_id", "url", host.alias("host"), text_or_empty("html").alias("html"))
    found = scratch.save(templates(rows.select("page_id", "host", "html"), scratch), "templates")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict = {}
        for html, known in batches:
            yield pd.Series([main_text(page, _known(t, Template, memo)) for page, t in zip(html, known)], dtype=object)

    out = _by_host(rows, found, "template", "left").select("page_id", "url", run("html", "template").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
