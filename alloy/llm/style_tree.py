"""HTML main text by a site style tree.

The pages of a host are merged into one tree of element nodes (paths of tag, class, id and
role from the body). A node's importance is the entropy, to the base of the number of pages
that have it, of what the pages show there: the texts at a content node, the sequences of
children at a presentation node. Noise repeats, so its entropy is low. A branch's composite
importance is the mean over the nodes below it, weighted by pages and by 0.9 for each level;
branches that are under ``LEAST_IMPORTANCE`` with all that is below them go from every page of
the host. Pages of a host with
identical text count once.

Hosts may have one page only, and menus or adverts may differ on every page; entropy says
nothing there. Element labels therefore carry a fixed importance where HTML or common naming
gives one: 0 for menus, footers, sidebars, adverts, notices, forms, comments and the like, 1
for the elements ``article`` and ``main`` themselves, so that they never go as a whole; what is
below them is judged by entropy. On a page with such a content branch, other elements are taken
for noise at first, which counts as ``LEAST_PAGES`` pages of importance 0: their text stays if
their mean importance with those is at least ``KEPT_IMPORTANCE``.

Blocks are divided by block-level tags; a line break is white space. Defined results: NULL
html is empty and gives an empty text; a NULL or malformed url is the host ''; unclosed and
stray tags are read as browsers read them, as far as blocks are concerned; repeated rows give
a row each; an empty table gives no rows; columns other than id, url and html, whatever their
names, are ignored. Pages are read whole, however long; time and memory grow with the square of
the depth of elements that are left open (16,000 of them: 20 seconds).
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import staged, text_or_empty, text_slices
from alloy.session import estimated_bytes

LEAST_IMPORTANCE = 0.2
#: pages (with different texts) below which a host's entropies say nothing
LEAST_PAGES = 4
#: importance from which text beside a page's content branches stays
KEPT_IMPORTANCE = 0.5
LEVEL_WEIGHT = 0.9
#: files of the hosts' noise branches that may be broadcast, in bytes
BROADCAST_BYTES = 4 << 20
SALTS = 32

# ---- fixed values: elements of HTML and common names of page parts ----------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul").split())
SPACES = frozenset("br img iframe object select".split())  # inline, and between words
NOISE_TAGS = frozenset("nav footer aside form menu dialog button head".split())
CONTENT_TAGS = frozenset(["article", "main"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header login menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar topbar widget widgets").split())
FRAME_WORDS = frozenset("article body container content entry has layout main no page post site story text with wrap wrapper".split())
# a start tag of the first set ends an open element of the second
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
# -----------------------------------------------------------------------------------
SCOPES = frozenset("ul ol dl table tbody thead tfoot body html div article main section aside nav footer header form".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?\s*\Z"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
NOISE, CONTENT = "-", "+"


@dataclass
class Node:
    """An open element. ``mark``: NOISE, CONTENT or ''."""
    tag: str
    path: str
    mark: str
    inside: bool  # in a content branch
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks of text as (path, in a content branch, text), and the child labels by path."""
    blocks: list[tuple[str, bool, str]]
    shapes: dict[str, list[str]]


def label(tag: str, attributes: str, inside: bool) -> tuple[str, str]:
    """Name and mark of an element; digits of class and id do not tell elements apart."""
    got = {}
    if "=" in attributes or "hidden" in attributes:
        for k, v in ATTRIBUTE.findall(attributes):
            got.setdefault(k.lower(), html_lib.unescape(v.strip("\"'")))
    names, role = f"{got.get('class', '')} {got.get('id', '')}".split(), got.get("role", "").lower()
    mark = ""
    if tag in CONTENT_TAGS or role in ("main", "article"):
        mark = CONTENT
    elif (tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and not inside or "hidden" in got
          or got.get("aria-hidden", "").lower() == "true" or HIDDEN.search(got.get("style", ""))):
        mark = NOISE
    elif tag not in ("html", "body") and not re.fullmatch("h[1-6]", tag):
        for name in names:
            words = {w.lower() for w in NAME_PART.findall(name)}
            if words & NOISE_WORDS and not words & FRAME_WORDS or "comments" in words:
                mark = NOISE
    text = mark + tag + "".join(sorted("." + DIGITS.sub("0", n) for n in names)) + (f"@{role}" if role else "")
    return text.replace(">", "_").replace(" ", "_"), mark


def parse(source: str) -> Page:
    """Read a page once, from left to right."""
    root = Node("", "", "", False)
    stack, blocks, shapes = [root], [], {}
    words: list[str] = []
    owner = root  # the block-level element that the words belong to

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text:
            blocks.append((owner.path, owner.inside, text))
        words.clear()

    def pop() -> None:
        node = stack.pop()
        shapes.setdefault(node.path, []).append(" ".join(node.children))

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        chunk = source[at:m.start() if m else n]
        if chunk and not any(x.mark == NOISE and x.tag not in BLOCK for x in stack):
            if not words:
                owner = next((x for x in reversed(stack) if x.tag in BLOCK), stack[-1])
            words.append(html_lib.unescape(chunk) if "&" in chunk else chunk)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if words and tag in SPACES:
            words.append(" ")
        block = tag in BLOCK
        if block:
            flush()
        if closing:
            if any(x.tag == tag for x in stack[1:]):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            if not m.group(3).rstrip(">").endswith("/") or tag in ("script", "style"):
                at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if block and any(x.tag == "p" for x in stack):  # a block starts: an open paragraph ends
            if next((x.tag for x in reversed(stack) if x.tag == "p" or x.tag in SCOPES), "") == "p":
                while stack[-1].tag != "p":
                    pop()
                pop()
        for ended in ENDS.get(tag, ()):
            near = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == ended or stack[i].tag in SCOPES), 0)
            if near and stack[near].tag == ended and ended not in SCOPES:
                while len(stack) > near:
                    pop()
        above = stack[-1]
        name, mark = label(tag, m.group(3), above.inside)
        above.children.append(name)
        stack.append(Node(tag, f"{above.path}>{name}" if block else above.path + (f">{name}" if mark == NOISE else ""),
                          mark, above.inside or mark == CONTENT))
    flush()
    while len(stack) > 1:
        pop()
    return Page(blocks, shapes)


def steps(path: str) -> Iterator[str]:
    """The path's own prefixes, the shortest first."""
    at = 0
    while at >= 0:
        at = path.find(">", at + 1)
        if path:
            yield path if at < 0 else path[:at]


def is_noise(path: str) -> bool:
    return f">{NOISE}" in path


def main_text(source: str, noise: frozenset[str] = frozenset(), main: frozenset[str] = frozenset()) -> str:
    """The blocks that no noise branch holds, joined by newlines; if the page has content
    branches, those inside them and at the paths ``main`` only."""
    kept = [(inside, path, text) for path, inside, text in parse(source).blocks
            if not is_noise(path) and not (noise and any(p in noise for p in steps(path)))]
    if any(inside for inside, _, _ in kept):
        kept = [x for x in kept if x[0] or x[1] in main]
    return "\n".join(text for _, _, text in kept)


def page_features(source: str) -> tuple[int, list[tuple[str, int]]]:
    """A hash of the page's whole text, and for each element path that is not noise by its
    label what the page shows there."""
    page = parse(source)
    shown: dict[str, list[str]] = {}
    for path, _, text in page.blocks:
        if not is_noise(path):
            shown.setdefault(path, []).append(text)
    for path, shape in page.shapes.items():
        if path and path not in shown and not is_noise(path):
            shown[path] = shape
    whole = xxhash.xxh3_64_intdigest("\n".join(text for _, _, text in page.blocks))
    return _signed(whole), [(p, _signed(xxhash.xxh3_64_intdigest("\n".join(v)))) for p, v in shown.items()]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def noise_branches(pages: DataFrame) -> DataFrame:
    """``host, noise array<string>, main array<string>``, from ``host, html``: low-importance
    branches, and important paths outside the content branches, of the hosts that have any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole, shown = page_features(source.as_py())
                rows += [(host, whole, path, value) for path, value in shown]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                ["host", "page", "path", "shown"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, page long, path string, shown long").distinct()
    counts = seen.groupBy("host", "path", "shown").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    # labels of content elements, not of what is below them
    entropy = F.when(F.col("path").rlike(rf">\{CONTENT}[^>]*$"), F.lit(1.0)).otherwise(entropy)
    nodes = staged(nodes.withColumn("importance", entropy).select("host", "m", "importance", F.col("path").alias("below")), "nodes")

    def by_branch(rows: DataFrame) -> DataFrame:
        """A row for each branch that ``below`` is in, itself among them."""
        parts = F.split("below", ">")
        deep = rows.withColumn("parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(2), F.size("parts"))))
        return deep.withColumn("branch", F.array_join(F.slice("parts", 1, F.col("depth")), ">"))

    weight = F.col("m") * F.pow(F.lit(LEVEL_WEIGHT), F.size("parts") - F.col("depth"))
    composite = (by_branch(nodes).withColumn("w", weight).groupBy("host", "branch")
                 .agg((F.sum(F.col("w") * F.col("importance")) / F.sum("w")).alias("importance"), F.max("m").alias("m")))
    # a branch is noise if it and all branches below it are unimportant
    low = (by_branch(composite.withColumnRenamed("branch", "below")).groupBy("host", "branch")
           .agg(F.max("importance").alias("importance"), F.max("m").alias("m"))
           .filter((F.col("m") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)))
    noise = low.groupBy("host").agg(F.sort_array(F.collect_set("branch")).alias("noise"))
    inside = F.contains("below", F.lit(f">{CONTENT}"))
    kept = ~inside & (F.col("m") * F.col("importance") >= KEPT_IMPORTANCE * (F.col("m") + LEAST_PAGES)) & (F.col("m") >= LEAST_PAGES)
    main = (nodes.groupBy("host").agg(F.max(inside).alias("has_content"), F.sort_array(F.collect_set(F.when(kept, F.col("below")))).alias("main"))
            .filter(F.col("has_content") & (F.size("main") > 0)).select("host", "main"))
    return noise.join(main, "host", "full")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        text_or_empty(html_col).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = rows.withColumn("host", host)
    noise = staged(noise_branches(rows), "noise")
    if estimated_bytes(noise) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(noise), "host", "left")
    else:  # a host may hold any share of the pages: its branches go to SALTS places
        salted = noise.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            texts = [main_text(source.as_py(), frozenset(x.as_py() or ()), frozenset(y.as_py() or ()))
                     for source, x, y in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "noise", "main").mapInArrow(run, "page_id long, url string, text string")
