"""Main text of web pages, with site templates removed.

Pages are parsed into a tree. Every element subtree has a hash (tag, attributes, text, children); a subtree
all of whose text is that of LINKS links or more also has a shape (tags, classes and ids, runs of equal
children as one), so that menus recur whose entries differ from page to page. Spark counts on how many
pages of a host each hash and shape occurs, and subtrees that recur on many of them are template:
they are cut first, wherever they stand. Of what is left, a page's text is that of its
articles (its mains, or its body where it has none), without what its markup names as something else:
navigation, headers, footers, sidebars, adverts, notices, forms, comments, scripts and styles.

The count needed doesn't grow with the host, and pages with the same text count once, so that copies of a
page don't make its content template. Templates are always cut, whatever they take of a page, but never an article or main itself or
what encloses one. Within one only containers (divisions, sections, asides and the like) that don't stand in a run of text are template;
links, code and other inline elements, paragraphs, headings, lists and tables never are, as articles may share words and passages.
A class names something else only as a whole name (no-sidebar and notice-board-history don't), and an article
within an element of such a class is taken where the page has no other. Names that are topics too (social, banner, tags, related, ..)
tell nothing of prose under a heading within an article, and nothing at all where the page would be left without text.

The hot host: subtrees are pre-aggregated in each task, each with at most as many hashes of page texts as make it template, and
counted by distinct (host, hash, page). Templates are rows of host and hash; up to BROADCAST_ROWS of them go to the workers as one
dictionary, beyond that they are joined to the subtrees that each distinct page has, so no page carries its host's list.

Edge cases: null or empty html gives empty text; unclosed and stray tags are handled as
browsers do in the main; text outside any element counts; rows without a url form a
host of their own; repeated rows are pages of their own and count once; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import arrow_schema, lean, quoted, stored, table, tune

#: Pages of a host, different in text, from which on a recurring subtree is template.
LEAST_PAGES = 8
#: Links from which on a subtree of nothing else has a shape.
LINKS = 3
#: Templates (host, hash pairs of 16 bytes or so) up to which they are broadcast.
BROADCAST_ROWS = 500_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
_DROPPED = frozenset("applet aside audio button canvas datalist dialog embed fieldset footer form frame frameset head header iframe input label menu nav noembed noframes noscript object optgroup option script search select style svg template textarea title video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
_KINDS = "ads?|advert\\w*|adsense|banner|breadcrumbs?|comments?|commentary|cookies?|consent|disclaimer|disqus|footer|footnav|gdpr|header|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promos?|promoted|recommended|related|replies|respond|share|sharing|sidebars?|side-?bar|signup|skip|social|sponsor\\w*|subscribe|subscription|tags|teasers?|toolbar|widgets?|login"
_BEFORE = "site|page|main|global|top|bottom|left|right|primary|secondary|reader|user|blog|js|header|footer|cookie|nav|share|social|ad"
_AFTER = "wrapper|wrap|container|box|area|section|block|bar|list|inner|outer|links?|items?|form|buttons?|banner|notice|menu|nav|[0-9]+"
#: Whole names of class and id that name what isn't main text: a kind, with a place before and a container behind it.
_NAMES = re.compile(rf"(?:(?:{_BEFORE})[_-])*(?:{_KINDS})(?:[_-]?(?:{_AFTER}))*", re.I)
#: Of these, kinds that articles are about too.
_TOPICS = re.compile(rf"(?:(?:{_BEFORE})[_-])*(?:banner|commentary|disclaimer|footer|header|menus?|notices?|recommended|related|social|tags|widgets?)(?:[_-]?(?:{_AFTER}))*", re.I)
#: Of these, those that tell that an article element isn't the page's own article.
_OTHER = re.compile(rf"(?:(?:{_BEFORE})[_-])*(?:ads?|advert\w*|comments?|promos?|promoted|recommended|related|replies|reply|sponsor\w*|teasers?)(?:[_-]?(?:{_AFTER}))*", re.I)
_HEADINGS = frozenset(("h1", "h2", "hgroup"))
#: Blocks that hold an article's words; within it they are never template, nor is any inline element.
_CONTENT = frozenset("blockquote br caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag closes when they are open (nearest first, not beyond these borders).
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = _BLOCK - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "title", "legend", "select", "button", "textarea", "canvas"}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "shape", "size", "free", "links", "holds")

    def __init__(self, tag, attrs=""):
        self.tag, self.attrs, self.children, self.hash, self.shape = tag, attrs, [], b"", b""
        # pieces of text, those outside links, links, whether an article or main is within
        self.size = self.free = self.links = 0
        self.holds = False


def parse(page: str) -> Node:
    """The tree of a page: nodes with children that are nodes or pieces of raw text."""
    root = Node("")
    stack, at, n = [root], 0, len(page)
    for_token = _TOKEN.search
    while at < n:
        m = for_token(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()):
                stack[-1].children.append(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k].tag
                if open_ == tag:
                    del stack[k:]
                    break
                if open_ in _BLOCK and tag not in _BLOCK:
                    break  # an inline end tag doesn't close blocks around it
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k].tag
                if open_ == "p":
                    del stack[k:]
                    break
                if open_ in _BLOCK:
                    break
        if tag in _CLOSES:
            what, border = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in border:
                    break
                if stack[k].tag in what:
                    del stack[k:]
                    if tag != "tr":
                        break
        node = Node(tag, m[3].strip())
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in _VOID and not (m[3].endswith("/") and tag in ("path", "circle", "rect")):
            stack.append(node)
    return root


def _walk(root: Node):
    """All nodes, children before parents; no recursion, so depth has no limit."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return reversed(order)


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def hashed(root: Node) -> set[int]:
    """Set the subtree hashes and shapes of all nodes; those of elements with text that may be template are returned as integers."""
    found = set()
    for node in _walk(root):
        h = blake2b(f"{node.tag}\0{node.attrs}\0".encode("utf-8", "surrogatepass"), digest_size=8)
        named = sorted(f"{m[1].lower()}={next((x for x in m.groups()[1:] if x is not None), '')}" for m in _ATTRIBUTE.finditer(node.attrs) if m[1].lower() in ("class", "id", "role")) if node.attrs else ()
        shape = blake2b(f"\3{node.tag}\0{' '.join(named)}\0".encode("utf-8", "surrogatepass"), digest_size=8)
        node.size = node.free = node.links = 0
        node.holds, last = node.tag in ("article", "main"), None
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"\1" + c.hash)
                if c.shape != last:
                    shape.update(b"\1" + c.shape)
                    last = c.shape
                node.size += c.size
                node.free += c.free
                node.links += c.links
                node.holds = node.holds or c.holds
            else:
                h.update(b"\2" + c.encode("utf-8", "surrogatepass"))
                node.size += not c.isspace()
                node.free += not c.isspace()
        if node.tag == "a":
            node.links, node.free = node.links + 1, 0
        node.hash, node.shape = h.digest(), shape.digest()
        if node.size and node.tag and not node.holds and node.tag not in ("html", "body"):
            found.add(_number(node.hash))
            if node.links >= LINKS and not node.free:
                found.add(_number(node.shape))
    return found


def cut(root: Node, template: frozenset) -> int:
    """Take the template subtrees (of a hashed tree) out of a page; their number. A block leaves a border in its place.

    Within an article or main, or what there is where a page has neither marked, see the module's text for what is spared.
    """
    n, stack = 0, [(root, not root.holds)]
    while stack:
        node, inside = stack.pop()
        kept = []
        in_text = inside and any(not isinstance(c, Node) and not c.isspace() for c in node.children)
        for c in node.children:
            if isinstance(c, Node):
                spared = inside and (in_text or c.tag not in _BLOCK or c.tag in _CONTENT)
                if not (spared or c.holds or c.tag in ("", "html", "body")) and (_number(c.hash) in template or c.links >= LINKS and not c.free and _number(c.shape) in template):
                    n += 1
                    if c.tag in _BLOCK:
                        kept.append(Node("br"))
                    continue
                stack.append((c, inside or c.tag in ("article", "main")))
            kept.append(c)
        node.children = kept
    return n


def _headed(node: Node) -> bool:
    """Whether a heading is within, at most two elements deep."""
    return any(isinstance(c, Node) and (c.tag in _HEADINGS or any(isinstance(d, Node) and d.tag in _HEADINGS for d in c.children)) for c in node.children)


def _prose(node: Node) -> bool:
    """Whether text stands under a heading within, more of it than of links."""
    free, links, headed, stack = 0, 0, False, [(node, False)]
    while stack:
        top, heading = stack.pop()
        for c in top.children:
            if isinstance(c, Node):
                links += c.tag == "a"
                is_heading = re.fullmatch("h[1-6]", c.tag) is not None
                headed = headed or is_heading
                if c.tag != "a" and c.tag not in _DROPPED:
                    stack.append((c, heading or is_heading))
            else:
                free += not heading and not c.isspace()
    return headed and free > links


def _dropped(node: Node, inside: bool, named: bool = True, topics: bool = True) -> bool:
    """Whether the markup names the node as something else than main text; inside: within the article; named: class and id count; topics: also by names that are topics too."""
    if node.tag in _DROPPED:
        return not (node.tag == "header" and inside and (_headed(node) or any(isinstance(c, Node) and c.tag == "p" for c in node.children)))
    if not node.attrs:
        return False
    for m in _ATTRIBUTE.finditer(node.attrs):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if named and name in ("class", "id") and node.tag not in ("body", "html", "main", "h1"):
            words = _OTHER if node.tag == "article" else _NAMES
            said = [w for w in value.split() if words.fullmatch(w)]
            if any(not _TOPICS.fullmatch(w) for w in said):
                return True
            if said and topics and not (inside and (_headed(node) and "header" in value.lower() or _prose(node))):
                return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _roots(root: Node) -> list[Node]:
    """The page's articles (outermost, in page order), else its mains, else the whole."""
    for named in (True, False):  # where classes leave none, they name the site's frame, not something beside the article
        articles, mains = [], []
        stack: list = [(root, False)]
        while stack:
            node, in_main = stack.pop()
            if node is not root:
                role = re.search(r"role\s*=\s*[\"']?(article|main)", node.attrs, re.I) if node.attrs else None
                is_article = node.tag == "article" or role is not None and role[1].lower() == "article"
                if _dropped(node, False, named or is_article):
                    continue
                if is_article:
                    articles.append(node)
                    continue
                if (node.tag == "main" or role is not None) and not in_main:
                    mains.append(node)
                    in_main = True
            stack.extend((c, in_main) for c in reversed(node.children) if isinstance(c, Node))
        if articles or mains:
            break
    return articles or mains or [root]


def extract(root: Node, template: frozenset = frozenset()) -> str:
    """The main text of a parsed page, without its template subtrees."""
    if template:
        hashed(root)
        cut(root, template)
    return _text(root)


def _text(root: Node) -> str:
    return _blocks(root, True) or _blocks(root, False)


def _blocks(root: Node, topics: bool) -> str:
    """The blocks of the page's main text, joined; topics: what has a class that is a topic too is left out."""
    pieces: list[str] = []
    border = "\0"
    for top in _roots(root):
        pieces.append(border)
        stack: list = [top]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                pieces.append(c if c is border else _html.unescape(c).replace(border, "\ufffd") if "&" in c else c.replace(border, "\ufffd"))
                continue
            if c is not top and _dropped(c, top.tag != "", topics=topics):
                if c.tag in _BLOCK:
                    pieces.append(border)
                continue
            if c.tag in _BLOCK:
                pieces.append(border)
                stack.append(border)
            stack.extend(reversed(c.children))
    blocks = (_SPACE.sub(" ", b).strip() for b in "".join(pieces).split(border))
    return " ".join(b for b in blocks if b)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(quoted(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))


def templates(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, hash: the hashes and shapes of subtrees on at least least_pages pages of the host that differ in text."""
    tune(pages.sparkSession)
    source = pages.select(host(url).alias("host"), F.coalesce(quoted(html), F.lit("")).alias("html"))

    def count(batches):
        for b in batches:
            seen: dict = {}
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root = parse(text)
                found = hashed(root)
                page = _number(blake2b(_blocks(root, False).encode("utf-8", "surrogatepass"), digest_size=8).digest())
                for x in found:
                    of = seen.setdefault((h, x), set())
                    if len(of) < least_pages:
                        of.add(page)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([sorted(v) for v in seen.values()], pa.list_(pa.int64()))], names=["host", "hash", "of"])

    # a batch names least_pages different texts or all that it has, so together they name as many where there are
    told = source.mapInArrow(lean(count), "host string, hash long, of array<long>").select("host", "hash", F.explode("of").alias("page"))
    return stored(told.groupBy("host", "hash").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least_pages).select("host", "hash"), "templates")


def hits(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page (its digest), hashes: the templates of found that each distinct page of pages (page, host, html) has."""

    def own(batches):
        for b in batches:
            held = [sorted(hashed(parse(text))) for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.list_(pa.int64()))], names=["page", "host", "hash"])

    told = pages.select("page", "host", "html").mapInArrow(lean(own), "page string, host string, hash array<long>").select("page", "host", F.explode("hash").alias("hash")).distinct()
    return told.join(found, ["host", "hash"]).groupBy("page").agg(F.collect_list("hash").alias("hashes"))


def main_text(pages: DataFrame, found: DataFrame, url: str = "url", html: str = "html", keep=("page_id", "url")) -> DataFrame:
    """The columns of keep, and out (text, n_chars, n_template: template subtrees cut)."""
    spark = tune(pages.sparkSession)
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    source = pages.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("keep"), host(url).alias("host"), F.coalesce(quoted(html), F.lit("")).alias("html"))
    by_host = None
    if few:
        rows = found.toArrow()
        lists: dict[str, list] = {}
        for h, x in zip(rows.column("host").to_pylist(), rows.column("hash").to_pylist(), strict=True):
            lists.setdefault(h, []).append(x)
        by_host = spark.sparkContext.broadcast({h: frozenset(x) for h, x in lists.items()})
        source = source.select("keep", "html", "host")
    else:
        paged = source.withColumn("page", F.sha2(F.concat("host", F.lit("\n"), "html").cast("binary"), 256))
        source = paged.join(hits(paged, found), "page", "left").select("keep", "html", "hashes")
    schema = T.StructType([source.schema["keep"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])
    want = arrow_schema(schema)

    def run(batches):
        for b in batches:
            out, gone = [], []
            for text, of in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                template = by_host.value.get(of, frozenset()) if by_host is not None else frozenset(of or ())
                root = parse(text)
                if template:
                    hashed(root)
                gone.append(cut(root, template) if template else 0)
                out.append(_text(root))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(want.field("keep").type), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(gone, pa.int64())], schema=want)

    return source.mapInArrow(lean(run), schema).select(*[F.col(f"keep.c{i}").alias(c) for i, c in enumerate(keep)], F.struct("text", "n_chars", "n_template").alias("out"))


def op2_site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, templates(pages)).select("page_id", "url", "out.text", "out.n_chars", "out.n_template")
