"""HTML extraction by equivalence classes of page tokens, nested into a template for each host.

Tokens are element paths (names with their class, id and role) and text blocks at their path. A token's occurrence
vector says how often it stands on each page of its host. Tokens with equal vectors in one slot form an equivalence
class. Vectors are never gathered: two 32-bit hashes of (page, count), summed per token, stand for them. Pages are
counted once for each different html, and empty ones not at all. A class is valid when it stands on enough of its
host's pages (``SUPPORT``). Valid classes nest: the slot of a class is the nearest element around it whose vector
differs, and its parent is that element's class. What a slot holds on all pages tells its role:

* the article slot is found from the root down, into the element that holds most of the different text that is no
  link, as long as no varying headline is left outside;
* a slot inside it whose text keeps repeating, where the article's does not, is boilerplate;
* a text that stands on most of the pages that have its slot is constant, a part of the template.

The other blocks in the article slot are the main text. Names of elements and classes (``SKIP``, ``_NOISE``) drop, in
addition, what no vector shows, such as readers' comments, and decide alone on hosts with a single page.

Defined results: null and empty html give an empty text; repeated rows give repeated rows and count as one page; a
page whose article is nearly all template, as among near copies of one article, keeps its article whole; a page
without the article slot is left to the names, and one without article or main element uses its body; an empty table
gives no row; extra columns, whatever their names, are ignored; a null page_id or url is kept.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_batches, part_listed
from .textvec import mix

#: A host needs so many different pages for a template: one page cannot tell what repeats.
LEAST_PAGES = 2
#: A class of the template stands on so large a share of its host's different pages.
SUPPORT = 0.2
#: A constant text stands on so large a share of the pages that have its slot.
SHARE = 0.8
#: The article slot holds so large a share of the different text around it.
MAJOR = 0.6
#: Text of a boilerplate slot is different this many times less often than that of the article as a whole.
REPEATS = 4
#: When more than this share of an article's characters would be template, the pages are copies of it.
MOST_TEMPLATE = 0.8
_FLUSH = 100_000

_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|svg|iframe|select|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none""", re.I)
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed|s)?|promo(?:s|tion)?|banner|cookies?|consent|gdpr|notices?|alert|sidebars?|side|aside|menus?|nav(?:bar|igation)?"
    r"|breadcrumbs?|pagination|pager|footer|header|masthead|comments?|disqus|replies|responses|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|signup|popup|modal|overlay|widget|toolbar|complementary|contentinfo|search|login)(?=$|[\s_-])",
    re.I,
)
#: What differs between the names of one element on different pages, and the mark that parts a path.
_NUMBERS = re.compile(r"[0-9/]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset("head nav footer aside form button dialog menu canvas audio video map fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag that ends an open element of the given kinds (the nearest one, within its container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {
    t: {"p"} for t in BLOCKS - {"br", "body", "html", "li", "dt", "dd", "tr", "td", "th", "option"}
}
_STOPS = frozenset("table ul ol dl select article main body div section".split())


#: Elements that can be the article slot.
CONTAINERS = frozenset("html body main article section div table tbody tr td center blockquote".split())


class Block:
    __slots__ = ("article", "noise", "path", "text")

    def __init__(self, text: str, path: str, noise: bool, article: bool) -> None:
        self.text, self.path, self.noise, self.article = text, path, noise, article


def parse(html: str) -> tuple[list[Block], list[str], bool]:
    """The page's blocks in order, the paths of its elements, and whether it has an article or main element."""
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # name, path, noise, in article
    blocks: list[Block] = []
    paths: list[str] = []
    held: list[str] = []
    has_article = False

    def flush() -> None:
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                _, path, noise, article = block_at
                blocks.append(Block(text, path, noise, article))
            held.clear()

    block_at = stack[0]
    for m in _TOKENS.finditer(html):
        name = m.group(3)
        if name is None:
            if m.group(1) is None and not m.group().startswith(("<!", "<?")):
                if not held:
                    block_at = stack[-1]
                held.append(m.group())
            continue
        name = name.lower()
        is_block = name in BLOCKS
        if m.group(2):
            if is_block:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if is_block or not any(s[0] in BLOCKS for s in stack[k + 1 :]):
                        del stack[k:]
                    break
            continue
        if is_block:
            flush()
        if ends := CLOSES.get(name):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _STOPS:
                    break
        attributes = m.group(4)
        _, path, noise, article = stack[-1]
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
        path = f"{path}/{name}" + (f".{_NUMBERS.sub('#', names)}" if names else "")
        paths.append(path)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("article", "main") or "main" in names.split():
            article = has_article = has_article or not noise
            article = not noise
        noise = noise or name in SKIP or (name == "header" and not article) or bool(names and name not in ("html", "body", "article", "main") and _NOISE.search(names)) or bool(attributes and _HIDDEN.search(attributes))
        stack.append((name, path, noise, article))
    flush()
    return blocks, paths, has_article


def _code(text: str) -> int:
    """A stable 63-bit hash."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


def text_token(block: Block) -> int:
    return _code(f"{block.path}\0{block.text}")


def in_link(path: str) -> bool:
    return "/a/" in (whole := path + "/") or "/a." in whole


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#@]*)", 1)
    return pages.withColumn("host", F.lower(host))


#: The token that stands for a page itself.
PAGE = 0
_TOKEN = ["host", "token", "path", "slot", "chars"]
_COUNTS = ["n", "pages", "s1", "s2", "place"]


def _different(pages: DataFrame) -> DataFrame:
    """host, html and digest of one row for each different, non-empty html of a host; only ids and hashes travel."""
    whole = _with_host(pages).where(F.trim("html") != "").select("host", "page_id", "html", F.sha2("html", 256).alias("digest"))
    seen = whole.groupBy("host", "digest", "page_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull(), "page_id")
    first = seen.groupBy("host", "digest").agg(F.min(order).alias("least"))
    more = seen.join(first, ["host", "digest"]).select("host", "digest", F.col("page_id").alias("_id"), (order == F.col("least")).alias("first"), "n")
    more = durable(more.where(~F.col("first") | (F.col("n") > 1)).withColumn("_h", F.xxhash64("host", "digest", "_id")))
    some, others = part_listed(whole, F.xxhash64("host", "digest", "page_id"), more)
    same = (F.col("w.host") == F.col("m.host")) & (F.col("w.digest") == F.col("m.digest")) & F.col("w.page_id").eqNullSafe(F.col("m._id"))
    marked = some.alias("w").join(more.alias("m"), same, "left").select("w.host", "w.html", "w.digest", "m.first")
    again = marked.where("first").dropDuplicates(["host", "digest"])
    return others.select("host", "html", "digest").unionByName(marked.where("first is null").unionByName(again).select("host", "html", "digest"))


def _token_rows(pages: DataFrame) -> DataFrame:
    """_TOKEN and _COUNTS, summed within batches before the shuffle. A text has the code of its path as slot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[int]] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=_TOKEN + _COUNTS)
            sums.clear()
            return frame

        for part in in_batches(frames, col="html"):
            for host, digest, html in zip(part["host"], part["digest"], part["html"], strict=True):
                counts: dict[tuple, list[int]] = {(PAGE, None, 0, 0): [1, 0]}
                blocks, paths, _ = parse(html)
                for at, path in enumerate(paths):
                    key = (_code(path), path, 0, 0)
                    counts.setdefault(key, [0, at])[0] += 1
                for at, block in enumerate(blocks):
                    key = (text_token(block), None, _code(block.path), len(block.text))
                    counts.setdefault(key, [0, at])[0] += 1
                seed = np.uint64(int(digest[:16], 16))
                times = sorted({n for n, _ in counts.values()})
                hashes = mix(np.array(times, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed]))[0])
                hashed = {n: (int(h) >> 33, int(h) & 0x7FFFFFFF) for n, h in zip(times, hashes, strict=True)}
                for key, (n, at) in counts.items():
                    row = sums.setdefault((host, *key), [0, 0, 0, 0, 0])
                    for k, more in enumerate((n, 1, *hashed[n], at)):
                        row[k] += more
            if len(sums) > _FLUSH:
                yield out()
        if sums:
            yield out()

    return pages.mapInPandas(run, "host string, token long, path string, slot long, chars int, n long, pages long, s1 long, s2 long, place long")


def nest(rows: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its valid element paths: order, class, parent class, slot and role of each.

    rows: path, pages, n, s1, s2, place and its slot's text: chars of different ones, of all, and of different links.
    """
    rows = rows.assign(mean=rows["place"] / rows["pages"]).sort_values(["mean", "path"], kind="stable").reset_index(drop=True)
    paths = rows["path"].tolist()
    vector = dict(zip(paths, zip(rows["s1"], rows["s2"], strict=True), strict=True))
    around: dict[str, str] = {}
    for path in paths:
        outer = path
        while (cut := outer.rfind("/")) >= 0:
            outer = outer[:cut]
            if outer in vector:
                break
        around[path] = outer if outer in vector else ""
    slot: dict[str, str] = {}
    for path in sorted(paths, key=lambda p: p.count("/")):
        outer = around[path]
        slot[path] = slot[outer] if outer and vector[outer] == vector[path] else outer
    number: dict[tuple, int] = {}
    classes = [number.setdefault((vector[p], slot[p]), len(number)) for p in paths]
    class_of = dict(zip(paths, classes, strict=True))

    own = {p: (float(d - k), float(d), float(t)) for p, d, t, k in zip(paths, rows["different"], rows["total"], rows["links"], strict=True)}
    inside = {p: np.zeros(3) for p in [*paths, ""]}
    for path in paths:
        outer = path
        while True:
            inside[outer] += own[path]
            if not outer:
                break
            outer = around[outer]
    children: dict[str, list[str]] = {}
    for path in paths:
        children.setdefault(around[path], []).append(path)
    once = dict(zip(paths, rows["n"] == rows["pages"], strict=True))
    name = {p: p.rsplit("/", 1)[1].split(".", 1)[0] for p in paths}
    headlines = [p for p in paths if name[p] == "h1" and own[p][1] * 2 > own[p][2]]
    article = ""
    while True:
        fit = [c for c in children.get(article, []) if name[c] in CONTAINERS and once[c]]
        best = max(fit, key=lambda c: inside[c][0], default=None)
        if best is None or not inside[best][0] or inside[best][0] < MAJOR * inside[article][0]:
            break
        if any((h + "/").startswith(article + "/") and not h.startswith(best + "/") for h in headlines):
            break
        article = best
    _, different, total = inside[article]
    roles = []
    for path in paths:
        within = path.startswith(article + "/") or path == article
        _, d, t = own[path]
        role = "content" if within else "frame"
        if path == article:
            role = "article"
        elif within and t and d * total * REPEATS < different * t:
            role = "boilerplate"
        roles.append(role)
    parents = [class_of[slot[p]] if slot[p] else -1 for p in paths]
    return pd.DataFrame({"place": np.arange(len(paths)), "path": paths, "class": classes, "parent": parents, "slot": [slot[p] for p in paths], "pages": rows["pages"], "role": roles})


TEMPLATE = "host string, place long, path string, class long, parent long, slot string, pages long, role string"


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """(template rows, constant texts): TEMPLATE columns for each valid path of a host; (host, token) of its texts.

    A path stands on ``SUPPORT`` of its host's pages, so a host has at most 1 / SUPPORT times as many as a page.
    """
    tokens = durable(_token_rows(_different(pages)).groupBy(*_TOKEN).agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    hosts = tokens.where(F.col("token") == PAGE).select("host", F.col("pages").alias("all_pages"))
    paths = tokens.where("path is not null").join(hosts, "host")
    paths = paths.where((F.col("all_pages") >= least_pages) & (F.col("pages") >= F.greatest(F.lit(least_pages), SUPPORT * F.col("all_pages"))))
    texts = tokens.where("path is null").where(F.col("token") != PAGE)
    held = texts.groupBy("host", F.col("slot").alias("token")).agg(F.sum("chars").alias("different"), F.sum(F.col("chars") * F.col("n")).alias("total"))
    link = F.concat(F.col("path"), F.lit("/"))
    full = paths.join(held, ["host", "token"], "left").fillna(0, ["different", "total"])
    full = full.withColumn("links", F.when(link.contains("/a/") | link.contains("/a."), F.col("different")).otherwise(0))
    slots = full.select("host", F.col("token").alias("slot"), F.col("pages").alias("slot_pages"))
    constant = texts.where(F.col("pages") >= least_pages).join(slots, ["host", "slot"]).where(F.col("pages") >= SHARE * F.col("slot_pages"))

    def deduce(rows: pd.DataFrame) -> pd.DataFrame:
        made = nest(rows)
        made.insert(0, "host", rows["host"].iloc[0])
        return made

    full = full.select("host", "path", "pages", "n", "s1", "s2", "place", "different", "total", "links")
    return full.groupBy("host").applyInPandas(deduce, TEMPLATE), constant.select("host", "token")


def _by_names(blocks: list[Block], has_article: bool) -> list[Block]:
    return [b for b in blocks if not b.noise and (b.article or not has_article)]


def main_text(html: str, article: str = "", dropped: frozenset[str] = frozenset(), constant: frozenset[int] = frozenset(), names: bool = True) -> str:
    """Blocks of the article in page order, one line each.

    ``article`` is the path of the host's article slot, ``dropped`` are the paths of its boilerplate slots, and
    ``constant`` its constant texts. ``names`` False leaves element and class names out of account.
    """
    blocks, _, has_article = parse(html)
    own = _by_names(blocks, has_article) if names else blocks
    held = [b for b in own if b.path == article or b.path.startswith(article + "/")] or own
    left = [b for b in held if b.path not in dropped and not (constant and text_token(b) in constant)]
    chars = sum(len(b.text) for b in held)
    if chars - sum(len(b.text) for b in left) > MOST_TEMPLATE * chars:
        left = held
    return "\n".join(b.text for b in left)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page, from the whole html."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    template, constant = templates(rows, least_pages)
    roles = template.groupBy("host").agg(
        F.max(F.when(F.col("role") == "article", F.col("path"))).alias("article"),
        F.collect_list(F.when(F.col("role") == "boilerplate", F.col("path"))).alias("dropped"))
    found = durable(roles.join(constant.groupBy("host").agg(F.collect_list("token").alias("constant")), "host", "left"))
    # The template table's size is known from its files: Spark broadcasts it when small and splits hot hosts when not.
    joined = _with_host(rows).join(found, "host", "left").select("page_id", "url", "html", "article", "dropped", "constant")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_batches(frames, col="html"):
            texts = [
                main_text(html, article or "", frozenset(dropped if dropped is not None else ()), frozenset(constant if constant is not None else ()), names)
                for html, article, dropped, constant in zip(part["html"], part["article"], part["dropped"], part["constant"], strict=True)
            ]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
