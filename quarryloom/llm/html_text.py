"""Main text of web pages by equivalence classes of template tokens.

The tokens of a page are its tags with the path of open elements above them, and its whole text nodes with theirs. Over the
pages of one host, tokens that occur equally often in each page share an occurrence vector and form an equivalence class;
the vector is kept as an exclusive-or of hashes of (page, count), so classes come from partial aggregates and a host of any
size is spread over all tasks. A class is valid if it holds two tokens or more and stands in at least `support` of the
host's pages (three at least). The valid classes, nested by their paths, are the template. What it leaves are slots.

Which slots are the text is decided by host: each element of the template is weighed by the text below it in all pages of
the host, where text in links counts a tenth, and names are evidence that raises (article, main) or lowers (menus,
footers, asides, forms; words for adverts, notices or comments in class, id or role) the weight of what stands below. The
innermost container of the template with most of the host's weight is the content. Inside it, the innermost element around
all slots is the text proper: constant text around it is dropped, and so are its block children, and block elements with a
class, id or role of their own at any depth, that hold no slot; elements named as boilerplate are dropped there too, unless
that would leave no slot. Constant text beside a slot stays, and so do plain paragraphs, headings, lists, quotations and
tables inside it, whose words are not mostly links: an article may close with the same line on every page.

A page without the content element of its host's template, and a host with too few pages for a template, is read by its
elements: the article or main element, else the body, without elements and classes named as boilerplate.

Null and empty html gives an empty text. Null urls share the host ''. Unclosed elements end with what encloses them. Rows
pass through one by one; columns named like the results are replaced. Pages are told apart by a hash of their row's place
in its file, or of url and html where they are not read from files.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.llm.storage import file_row, saved, temporary
from quarryloom.sources.tables import table

SUPPORT, LEAST_PAGES, CONTENT_SHARE = 0.5, 3, 0.7
#: What text counts below elements of certain kinds, in weighing the elements of a template.
WEIGH_ARTICLE, WEIGH_ELEMENT, WEIGH_WORD, WEIGH_LINK = 8.0, 0.05, 0.2, 0.1
_ATTRS = r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*|[^>]*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|head|title)\b(?:" + _ATTRS + r")>.*?(?:</(?P=raw)\s*>|(?P<cut>\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")>|<[!?][^>]*>",
    re.S | re.I,
)
_HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements and class words of what is not main text, elements without end tags, and inline elements.
BOILERPLATE = frozenset("nav footer aside form button dialog menu object embed canvas audio video map noframes".split())
WORDS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|nav\w*|menu|breadcrumbs?|sidebar|widget|related|recommend\w*|share|sharing|social|comments?|commentlist|disqus|replies|respond|footer|masthead|toolbar|pagination|pager|skip|login|search|contentinfo|complementary)(?:$|[_-])",
    re.I,
)
HEADERS = re.compile(r"(?:^|[_-])(?:header|topbar)(?:$|[_-])", re.I)
OF_ARTICLES = re.compile(r"(?:^|[_-])(?:article|post|entry|story|content)(?:$|[_-])", re.I)
STATES = ("has-", "with-", "no-", "is-")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset({"article", "main"})
#: Elements that hold one block of text and so are no containers of a whole text.
BLOCKS = frozenset("html p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption address hr".split())
#: Elements of running text, which an article may repeat on every page of its host.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _hash(*parts) -> int:
    """A signed 64-bit hash that is the same in every process."""
    import xxhash

    h = xxhash.xxh64_intdigest("\x00".join(map(str, parts)))
    return h - (1 << 64) if h >= 1 << 63 else h


def _is_junk(hints: str, in_article: bool) -> bool:
    """Whether a class, id or role says that an element is no main text. A word about the state of the page, such as
    has-sidebar, says nothing about the element."""
    for word in hints.split():
        if word.lower().startswith(STATES):
            continue
        if WORDS.search(word) or (not in_article and HEADERS.search(word) and not OF_ARTICLES.search(word)):
            return True
    return False


class _Open:
    """An open element. hard: whether it is junk whatever the words say that stand on elements inside its article; weight:
    what a character of text below it counts; mass: the weight of all text below it."""

    __slots__ = ("name", "path", "junk", "article", "hard", "hints", "parent", "depth", "weight", "mass")

    def __init__(self, name, path, junk, article, hard=False, hints="", parent=None, weight=1.0):
        self.name, self.path, self.junk, self.article = name, path, junk, article
        self.hard, self.hints, self.parent = hard, hints, parent
        self.depth, self.weight, self.mass = parent.depth + 1 if parent else 0, weight, 0.0


def _events(page: str):
    """(kind, token path, text or name, innermost open element) in page order; kind: tag, end or text."""
    stack, at = [_Open("", "", False, False)], 0
    size = len(page)
    for m in [*_TOKEN.finditer(page), None]:
        start = m.start() if m else size
        if start > at:
            yield "text", page[at:start], stack[-1]
        if m is None:
            return
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                yield "tag", m["raw"].lower(), stack[-1]
            continue
        name = name.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            yield "end", name, stack[-1]
            continue
        top = stack[-1]
        hints = " ".join(x.strip("\"'") for x in _HINT.findall(m["attrs"])) if m["attrs"] else ""
        path = f"{top.path}/{name}.{hints}" if len(stack) < 40 else top.path
        element = name in BOILERPLATE or (name == "header" and not top.article)
        junk = element or bool(hints and name not in ("html", "body") and _is_junk(hints, top.article))
        hard = element or (junk and not top.article)
        article = name in ARTICLE and not junk
        # An article opens afresh, whatever was left unclosed before it, unless it stands in one already.
        afresh = article and not top.article
        weight = WEIGH_ARTICLE if afresh else top.weight * (WEIGH_ELEMENT if element else WEIGH_WORD if junk else WEIGH_LINK if name == "a" else 1.0)
        new = _Open(name, path, junk or (top.junk and not afresh), article or top.article, hard or (top.hard and not afresh), hints, top, weight)
        yield "tag", name, new
        if name not in VOID and not m["attrs"].endswith("/"):
            stack.append(new)


def tokens(page: str) -> tuple[dict[int, int], dict[int, tuple[int, float]], float]:
    """How often each token stands in the page; depth and weight of each element that may contain a whole text; the weight
    of all text."""
    count: dict[int, int] = {}
    elements: list[tuple[_Open, int]] = []
    total = 0.0
    for kind, value, where in _events(page):
        if kind == "end":
            continue
        plain = value if kind == "tag" else " ".join(html.unescape(value).split())
        if not plain:
            continue
        h = _hash(kind, where.path, plain)
        count[h] = count.get(h, 0) + 1
        if kind == "tag":
            if where.name == value and value not in VOID:
                elements.append((where, h))
        else:
            where.mass += len(plain) * where.weight
            total += len(plain) * where.weight
    held: dict[int, tuple[int, float]] = {}
    for element, h in reversed(elements):
        if element.parent is not None:
            element.parent.mass += element.mass
        if element.name not in BLOCKS and element.name not in INLINE:
            held[h] = (element.depth, held.get(h, (0, 0.0))[1] + element.mass)
    return count, held, total


def _article(nodes: list[tuple[str, _Open | None]], template: set[int], root: _Open | None = None) -> list[str]:
    """The text nodes of an article that are text by its template. nodes: without what is junk by element; None: a break.
    root: the element that holds them all; what it is called, and what stands around it, is no reason to drop them."""

    def varies(value: str, where: _Open) -> bool:
        plain = " ".join(value.split())
        return bool(plain) and _hash("text", where.path, plain) not in template

    def junk(x: _Open) -> bool:
        if root is None:
            return x.junk
        while x is not root:
            if x.hints and _is_junk(x.hints, True):
                return True
            x = x.parent
        return False

    by_words = [x for x in nodes if x[1] is None or not junk(x[1])]
    if not template:
        return [value for value, _ in by_words]
    for held in (by_words, nodes):
        direct = {where for value, where in held if where is not None and varies(value, where)}
        if direct:
            break
    else:
        return [value for value, _ in by_words]
    # Elements with a slot below them, by what encloses them.
    live, below = set(), {}
    for x in direct:
        while x is not None and x not in live:
            live.add(x)
            below.setdefault(x.parent, []).append(x)
            x = x.parent
    inner = below[None][0]
    while inner is not root and root is not None:
        inner = below[inner][0]
    while inner not in direct and len(below[inner]) == 1:
        inner = below[inner][0]
    stays = {inner: True, None: False}

    def is_text(x: _Open) -> bool:
        chain = []
        while x not in stays:
            chain.append(x)
            x = x.parent
        for y in reversed(chain):
            unit = y.name not in INLINE and (y.parent is inner or bool(y.hints))
            stays[y] = stays[y.parent] and (y in live or not unit or own_words(y))
        return stays[chain[0] if chain else x]

    linked, words = {}, {}  # characters of links, and of all text, of the blocks that hold no slot
    for value, where in held:
        link, y = False, where
        while y is not None and y is not inner and y not in live:
            link = link or y.name == "a"
            words[y] = words.get(y, 0) + len(value.strip())
            linked[y] = linked.get(y, 0) + link * len(value.strip())
            y = y.parent

    def own_words(y: _Open) -> bool:
        """Whether a block without a slot is the article's own all the same: a plain block of text, not mostly links."""
        return y.name in TEXT_BLOCKS and not y.hints and 2 * linked.get(y, 0) <= words.get(y, 0)

    return [value for value, where in held if where is None or is_text(where)]


def slots(page: str, template: set[int], content: int | None = None) -> str:
    """The main text of a page: its slots in order, without what the template says is not text. content: the token of the
    element that holds the text by the template."""
    below: list[tuple[str, _Open | None]] = []
    inside: list[tuple[str, _Open | None]] = []
    anywhere, has_article, root = [], False, None
    for kind, value, where in _events(page):
        if kind != "text":
            if kind == "tag" and content is not None and root is None and where.name == value and _hash("tag", where.path, value) == content:
                root = where
            if value not in INLINE:
                below.append((" ", None))
                inside.append((" ", None))
                anywhere.append(" ")
            has_article = has_article or (kind == "tag" and where.article)
            continue
        value = html.unescape(value)
        if root is not None and _within(where, root):
            below.append((value, where))
        if where.hard:
            continue
        if where.article:
            inside.append((value, where))
        if not where.junk:
            plain = " ".join(value.split())
            anywhere.append(" " if plain and _hash("text", where.path, plain) in template else value)
    if root is not None:
        # Boilerplate that encloses the content is what the template says is none; only what stands inside counts.
        kept = [(v, w) for v, w in below if w is None or not _hard_below(w, root)]
        return " ".join("".join(_article(kept, template, root)).split())
    return " ".join("".join(_article(inside, template) if has_article else anywhere).split())


def _within(x: _Open | None, root: _Open) -> bool:
    while x is not None and x.depth > root.depth:
        x = x.parent
    return x is root


def _hard_below(x: _Open, root: _Open) -> bool:
    """Whether an element from x up to below `root` is boilerplate by its name."""
    while x is not root:
        if x.name in BOILERPLATE:
            return True
        x = x.parent
    return False


def _count(batches):
    columns = ("host", "token", "vector", "pages", "depth", "mass")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    for b in batches:
        found: dict[tuple[str, int], list] = {}
        for rid, url, page in zip(b.column("rid").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            host = host_of(url)
            count, elements, total = tokens(page or "")
            for token, n in [*count.items(), (0, 1)]:
                held = found.setdefault((host, token), [0, 0, 0, 0.0])
                held[0] ^= _hash(rid, n)
                held[1] += 1
                depth, mass = (0, total) if token == 0 else elements.get(token, (0, 0.0))
                held[2] = max(held[2], depth)
                held[3] += mass
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(columns))


def templates(pages: DataFrame, *, support: float = SUPPORT, least_pages: int = LEAST_PAGES, content_share: float = CONTENT_SHARE) -> DataFrame:
    """(host, template, content): the tokens of the valid classes of each host, and the one of them that is the innermost
    container with `content_share` of the host's weight, if there is one. pages: rid, url, html."""
    counted = pages.mapInArrow(_count, "host string, token long, vector long, pages long, depth int, mass double")
    whole = counted.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.max("depth").alias("depth"), F.sum("mass").alias("mass"))
    whole = saved(whole.where(F.col("pages") >= least_pages), "tokens")
    size = whole.where("token = 0").select("host", F.col("pages").alias("all_pages"), F.col("mass").alias("all_mass"))
    frequent = whole.where("token != 0").join(size, "host").where(F.col("pages") >= support * F.col("all_pages"))
    holds = (F.col("depth") > 0) & (F.col("mass") >= content_share * F.col("all_mass")) & (F.col("all_mass") > 0)
    best = F.max(F.when(holds, F.struct("depth", "mass", "token"))).alias("best")
    # A token in half the pages or more: a host has at most twice as many as a page has on average.
    classes = frequent.groupBy("host", "vector").agg(F.collect_list("token").alias("t"), best).where("size(t) >= 2")
    return classes.groupBy("host").agg(F.flatten(F.collect_list("t")).alias("template"), F.max("best").alias("best")).select("host", "template", F.col("best.token").alias("content"))


def extract(pages: DataFrame, *, url: str = "url", markup: str = "html", keep: list[str] | None = None, **options) -> DataFrame:
    """Adds text, the main text of each page."""
    names = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    fields = {c: f"_c{i}" for i, c in enumerate(names)}
    try:
        rid = file_row()
        pages.select(rid)
    except AnalysisException:
        rid = F.xxhash64(url, markup)
    base = pages.select(rid.alias("rid"), F.col(url).alias("url"), F.col(markup).alias("html"), *(F.col(c).alias(n) for c, n in fields.items()))
    with temporary(pages.sparkSession) as keep:
        found = keep(templates(base.select("rid", "url", "html"), **options), "templates")
    host = F.translate(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = base.withColumn("host", host).join(found, "host", "left").select("html", "template", "content", *fields.values())

    def run(batches):
        known: dict = {}
        for b in batches:
            out = []
            for page, template, content in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), b.column("content").to_pylist(), strict=True):
                key = tuple(template or ())
                if key not in known:
                    known = {key: set(key)}
                out.append(slots(page or "", known[key], content))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in fields.values()), pa.array(out, pa.string())], [*fields.values(), "text"])

    schema = T.StructType([T.StructField(n, pages.schema[c].dataType) for c, n in fields.items()] + [T.StructField("text", T.StringType())])
    return joined.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in fields.items()), "text")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
