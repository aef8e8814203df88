"""Main text of web pages by templates deduced from equivalence classes of tokens.

Pages of a host come from a few templates. A page is a sequence of tokens: tags and whole
text nodes, told apart by the path of elements around them. A token's occurrence vector is
how often it occurs on each page of its host; tokens with equal vectors form an equivalence
class. The root class holds what occurs once on every page that has tokens. A further class
is valid if it is found on enough pages that are not all equal, has tags and text, and all of
it lies in one slot of the root class or is once on each of its pages, as the layout of a part
of the pages is. Text of valid classes goes, however long; what they leave over are the slots,
and slots hold the text. An element of a further class is a slot within the slot around it.

Vectors are never built: a vector is known by two sums of page hashes weighted by counts,
which Spark aggregates before the shuffle. So a host with a third of all pages is no burden.

Which slots are main text is told by their elements. What stands in navigation, advertising, a
form, a list of comments and the like is none, an article in it neither; only a menu that was
never closed gives way to an article or main. Else text in an article or main is main text;
without one the slot with the most text of its own is taken, with all that has the same parent.
A class or id marks an element only by a whole name made of words for such parts and for layout
(`site-nav`, not `market-share-analysis`), and an article or main only as a comment.
"""

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.functions.sizes import broadcast_if_small
from shardfit.llm.common import keep, slices, texts_of

LEAST_PAGES = 4        # of a host, for a template; below it the elements alone decide
SUPPORT = 0.2          # share of a host's pages that a further class must be on, and LEAST_PAGES at least
BROADCAST_TOKENS = 2_000_000  # tokens of all templates that every task may get, 32 MB
LAYOUT = 0.8           # share from which a further class needs no text of its own

#: Elements of HTML by their use.
CONTENT = frozenset({"article", "main"})
NEVER = frozenset({"script", "style", "noscript", "template", "title", "svg", "math", "iframe", "object", "canvas",
                   "audio", "video", "textarea", "select", "option", "button", "input", "label", "fieldset", "datalist"})
ASIDE = frozenset({"nav", "footer", "aside", "form", "menu", "dialog"})
BLOCKS = frozenset({"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt",
                    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
                    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
                    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
CLOSED_BY_BLOCK = frozenset({"p"})
#: Words in class or id that mark what is not main text.
MARKS = frozenset("""ad ads adbox adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs
    byline comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar
    navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related
    replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser
    toolbar widget widgets""".split())
COMMENTS = frozenset("comment comments replies reply respond".split())
LAYOUT_WORDS = frozenset("""area bar block body bottom box btn button center col column container content cta fixed global
    group holder icon inner item items left link links list main outer panel page post posts primary right row secondary
    section sect site slot small sticky text title top unit wrap wrapper""".split())
HEADERS = frozenset({"header"})
OPEN_MENUS = frozenset({"nav", "menu"})  # hold no article, so one in them tells that they were left open
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def named(names: list[str], marks: frozenset) -> bool:
    """Whether a class or id is one of the marks, alone or beside other marks and words of layout."""
    for name in names:
        words = {w for w in _SPLIT.split(name) if w}
        if words & marks and words <= MARKS | HEADERS | LAYOUT_WORDS:
            return True
    return False


class Element:
    """An open element: its name, what it says about its text, and its place on the path as a hash."""

    __slots__ = ("name", "use", "firm", "path", "parent", "open")

    def __init__(self, name: str, attrs: str, parent: "Element | None"):
        self.name, self.open = name, True
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        article = name in CONTENT or found.get("role") in ("main", "article")
        aside = name in NEVER or name in ASIDE or found.get("role") in ROLES
        if names and name not in ("html", "body"):
            aside = aside or named(names, COMMENTS if article else MARKS)
        inside = parent is not None and parent.use == "content"
        aside = aside or (not inside and not article and (name == "header" or named(names, HEADERS)))
        outer = parent is not None and parent.use == "aside"
        # whether it is aside for good, not by a menu alone
        self.firm = (outer and parent.firm) or (aside and name not in OPEN_MENUS)
        if self.firm or aside or (outer and not article):
            self.use = "aside"
        else:
            self.use = "content" if article or inside else "plain"
        mark = f"{name}.{found.get('class', '')}#{found.get('id', '')}"
        self.parent = parent.path if parent else 0
        self.path = xxhash.xxh3_64_intdigest(f"{self.parent:x}/{mark}".encode("utf-8", "replace"))


ROOT = Element("", "", None)
ROOT.path = 0
_SEEN: dict = {}   # what is known of a tag below a path, as pages repeat them; bounded by SEEN
SEEN = 50_000


def opened(name: str, attrs: str, parent: Element | None) -> Element:
    """A new element; what its attributes say is read once for each place in the tree."""
    key = (name, attrs, parent.path, parent.use, parent.firm) if parent else (name, attrs)
    known = _SEEN.get(key)
    if known is None:
        made = Element(name, attrs, parent)
        _SEEN[key] = (made.use, made.firm, made.parent, made.path)
        return made
    made = Element.__new__(Element)
    made.name, made.open = name, True
    made.use, made.firm, made.parent, made.path = known
    return made


def nodes(page: str):
    """Tokens of a page in order: (kind, name, element, use, text); kind is open, close or text.

    The element is that which opens or closes, or holds the text; `open` tells whether it still is.
    """
    if len(_SEEN) > SEEN:
        _SEEN.clear()
    stack: list[Element] = []
    held: Counter = Counter()  # names of open elements, so that a stray end tag costs nothing
    at = 0

    def text(end: int):
        if end > at:
            top = stack[-1] if stack else ROOT
            yield "text", "", top, top.use, page[at:end]

    def drop(last: Element) -> None:
        while True:
            gone = stack.pop()
            gone.open = False
            held[gone.name] -= 1
            if gone is last:
                return

    for m in _TOKEN.finditer(page):
        yield from text(m.start())
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() in BLOCKS:
                yield "open", m["raw"].lower(), ROOT, "aside", ""
            continue
        name = name.lower()
        if m["close"]:
            if held[name] > 0:
                closed = next(e for e in reversed(stack) if e.name == name)
                drop(closed)
                yield "close", name, closed, closed.use, ""
            continue
        if stack and stack[-1].name in CLOSED_BY_BLOCK and name in BLOCKS:
            drop(stack[-1])
        element = opened(name, m["attrs"].rstrip("/"), stack[-1] if stack else None)
        yield "open", name, element, element.use, ""
        if name not in VOID and not m["attrs"].endswith("/"):
            stack.append(element)
            held[name] += 1
    yield from text(len(page))


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def token(kind: str, path: int, text: str) -> int:
    """Signed 64-bit hash of a token with its path."""
    value = xxhash.xxh3_64_intdigest(f"{kind}|{path:x}|{text}".encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def occurrences(page: str) -> list[tuple[int, int, int, bool]]:
    """(token, how often, first place, whether a tag) of a page; token 0 stands for the page.

    A page without tokens, as an empty one, has none: it says nothing about its host's template.
    """
    counts, places, tags = Counter({0: 1}), {0: -1}, {0: True}
    for place, (kind, _, element, _, text) in enumerate(nodes(page)):
        body = clean(text) if kind == "text" else ""
        if kind == "text" and not body:
            continue
        t = token(kind, element.path, body)
        counts[t] += 1
        places.setdefault(t, place)
        tags[t] = kind != "text"
    return [(t, n, places[t], tags[t]) for t, n in counts.items()] if len(counts) > 1 else []


def main_text(page: str, template: dict[int, bool]) -> str:
    """Blocks of the main text. `template`: tokens of valid classes, true for those that cut the page.

    Text of the template goes. Elements of nested classes are slots of their own; after them the
    slot around them goes on.
    """
    blocks: list[tuple[str, int, tuple, list[str]]] = []  # use, parent's path, slot, parts
    cuts, nested, fresh_block = 0, [], True
    slot: tuple = (0,)
    for place, (kind, name, element, use, text) in enumerate(nodes(page)):
        if kind != "text":
            root = template.get(token(kind, element.path, "")) if template else None
            while nested and not nested[-1][0].open:
                nested.pop()
            if root:
                cuts += 1
            elif root is False and kind == "open" and name not in VOID:
                nested.append((element, place))
            slot = (cuts, *(p for _, p in nested))
            fresh_block |= name in BLOCKS
            if name == "br" and blocks:
                blocks[-1][3].append(" ")
            continue
        body = clean(text)
        if body and template and token("text", element.path, body) in template:
            continue
        if use == "aside":
            continue
        if fresh_block or not blocks or blocks[-1][0] != use or blocks[-1][2] != slot:
            blocks.append((use, element.parent, slot, []))
            fresh_block = False
        blocks[-1][3].append(text)
    found = [(use, path, slot, body) for use, path, slot, parts in blocks if (body := clean("".join(parts)))]
    inside = [body for use, _, _, body in found if use == "content"]
    if inside or not found:
        return "\n\n".join(inside)
    size: Counter = Counter()
    for _, _, slot, body in found:
        size[slot] += len(body)
    best = max(size, key=lambda s: (size[s], [-x for x in s]))
    parents = {path for _, path, slot, _ in found if slot == best}
    return "\n\n".join(body for _, path, slot, body in found if slot == best or path in parents)


def host(url: Column | str) -> Column:
    """Host of a column of addresses, lower case, without `www.`; empty if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    name = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(name, r"^www\.", ""), F.lit(""))


def deduce(pages: DataFrame, url="url", page="html") -> DataFrame:
    """`host, tokens array<struct<token, root>>` of every host with enough pages, not all of them equal."""
    rows = pages.select(host(url).alias("host"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "page"):
                names = part.column("host").to_pylist()
                texts = texts_of(part, "page")
                out = [(h, xxhash.xxh3_64_intdigest(p.encode("utf-8", "replace")) >> 1, *o)
                       for h, p in zip(names, texts) for o in occurrences(p)]
                if not out:
                    continue
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array(columns[5], pa.bool_())],
                    ["host", "print", "token", "n", "place", "tag"])

    seen = rows.mapInArrow(run, "host string, print long, token long, n long, place long, tag boolean")
    wide = "decimal(38,0)"
    vectors = keep(seen.groupBy("host", "token").agg(
        F.sum((F.col("n") * F.xxhash64("print").cast(wide)).cast(wide)).alias("v1"),
        F.sum((F.col("n") * F.hash("print").cast(wide)).cast(wide)).alias("v2"),
        F.count("*").alias("pages"), F.sum("n").alias("total"), (F.min("print") != F.max("print")).alias("differ"),
        F.avg("place").alias("place"), F.max("tag").alias("tag")).where("pages > 1"), narrow=True)
    hosts = vectors.where(f"token = 0 and pages >= {LEAST_PAGES} and differ").select(
        "host", F.col("v1").alias("r1"), F.col("v2").alias("r2"), F.col("pages").alias("all_pages"))
    known = vectors.where("token <> 0").join(hosts, "host")
    root = (F.col("v1") == F.col("r1")) & (F.col("v2") == F.col("r2"))
    # tokens of one page that was copied are no template
    enough = F.col("differ") & (F.col("pages") >= F.greatest(SUPPORT * F.col("all_pages"), F.lit(LEAST_PAGES)))
    known = known.withColumn("root", root).where(F.col("root") | enough)
    # the slot of the root class in which a token lies: root tags before it, on the average
    tags = known.where("root and tag").groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("edges"))
    placed = known.join(tags, "host", "left").withColumn(
        "slot", F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e <= F.col("place"))))
    valid = placed.where("not root").groupBy("host", "v1", "v2").agg(
        F.min("slot").alias("low"), F.max("slot").alias("high"), F.sum(F.col("tag").cast("int")).alias("tags"),
        F.bool_and(F.col("total") == F.col("pages")).alias("once"), F.min(F.col("pages") / F.col("all_pages")).alias("share"),
        F.collect_list("token").alias("members"))
    # what is once on each of its pages may be a layout, whose parts lie in several slots of what all layouts share
    valid = valid.where(f"tags > 0 and (once or low = high) and (tags < size(members) or (once and share >= {LAYOUT}))")
    nested = valid.select("host", F.explode("members").alias("token"), F.lit(False).alias("root"))
    both = known.where("root").select("host", "token", "root").unionByName(nested)
    return both.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "root"))).alias("tokens"))


def extract(pages: DataFrame, key="page_id", url="url", page="html") -> DataFrame:
    """`key, url, text, n_chars` of every row.

    Null or empty pages, and pages without main text, give an empty text. Repeated rows and
    null keys are pages of their own; pages without a host share the empty host. An empty table
    gives an empty result. Other columns are not read. Work and memory are linear in a page's
    length, however deep it is nested.
    """
    templates = keep(deduce(pages, url, page), narrow=True)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host(url).alias("host"),
                        F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"))
    n_tokens = templates.agg(F.sum(F.size("tokens"))).first()[0] or 0
    # beyond that both sides are sorted by host, where Spark splits a host that very many pages have
    joined = rows.join(broadcast_if_small(templates, n_tokens, BROADCAST_TOKENS), "host", "left")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "url")}

    def run(batches):
        held: dict[str, dict[int, bool]] = {}
        for batch in batches:
            for part in slices(batch, "page"):
                names, tokens, out = part.column("host").to_pylist(), part.column("tokens"), []
                for i, (name, text) in enumerate(zip(names, texts_of(part, "page"))):
                    if name not in held:
                        if len(held) > 200:
                            held.clear()
                        held[name] = {t["token"]: t["root"] for t in tokens[i].as_py() or ()}
                    out.append(main_text(text, held[name]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("url"), pa.array(out, pa.string()),
                     pa.array([len(t) for t in out], pa.int64())], ["key", "url", "text", "n_chars"])

    return joined.select("key", "url", "host", "page", "tokens").mapInArrow(
        run, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long").toDF(key, "url", "text", "n_chars")
