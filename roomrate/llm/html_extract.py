"""HTML extraction (3): flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat text blocks. Features of a block: its word count and link
density, those of its neighbours, and the containers it lies in (article or main; navigation, header,
footer, sidebar, notice, advert, form, comments by tag, role, class or id; hidden). A Spark ML decision tree
trained on the small labelled pages below says which blocks are main text.

A class, id or role names clutter only as a whole: its parts (`site-footer`, `adSlot2`) must all be clutter words or plain
layout words, so that `has-sidebar`, `category-legal` or `social-issues` say nothing. Whether a container is clutter is then
decided by what it holds, once the page is read: one that holds most of the words of the page's article, such as a form
around the whole page, is none.

The tree is a few dozen nodes; the tasks get it with the function's closure.

Defined results: null or empty html, or a page without main text, gives the empty text; unclosed tags end with
the page or where HTML says (text after an unclosed head is text); an unclosed comment, script or style takes the rest of
the page; an empty table gives an empty table; pages of any
length are parsed whole; a null page_id or url passes through; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "page_article",
            "clutter", "heading")

BLOCK = set("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li link main menu meta nav
ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio canvas""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is never read
RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|select|title"
#: elements that are clutter whatever they hold
CLUTTER_TAGS = set("nav aside footer form button label fieldset legend option menu dialog".split())
ARTICLE_TAGS = {"article", "main"}
#: parts of a name that say clutter beside plain layout words
CLUTTER_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion
banner banners nav navbar navigation navigations menu menus breadcrumb breadcrumbs masthead topbar toolbar footer
colophon copyright sidebar sidebars aside widget widgets related recommended recommendations trending
cookie cookies consent gdpr notice notices alert alerts popup modal overlay dialog lightbox newsletter subscribe subscription
signup login signin register share sharing comments commentlist respond disqus pagination pager paging searchbox tagcloud
byline contentinfo complementary""".split())
#: names that say clutter alone, not as a part
WHOLE_NAMES = set("""header foot legal side rail popular form search social comment reply replies discussion reviews skip tags toc
metadata hidden""".split())
COMMENT_NAMES = set("comment comments commentlist respond reply replies disqus discussion reviews".split())
#: parts that only say where or how something is laid out
LAYOUT_NAMES = set("""site main page global top bottom left right center centre primary secondary inner outer wrap wrapper container
content contents box block area section row col column group list lists item items link links bar panel pane slot unit space zone
module region part body text title heading button buttons btn field fields icon icons logo form post posts article articles
entry story stories new more mini mega sub desktop mobile sticky fixed floating small large default js policy message form
header menu nav sidebar footer""".split())
ARTICLE_NAMES = {"article", "articlebody", "main", "post", "entry", "story"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*+(?:>|\Z)", re.I | re.S)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: kinds of clutter containers: one that may be a wrapper, one that says what it is, comments and hidden parts
WRAPPER, NAMED, FIXED = 1, 2, 3
WRAPPER_TAGS = set("form header fieldset label legend dialog menu option button".split())


def marks(name: str, rest: str, in_article: bool) -> tuple[bool, int]:
    """(article, kind of clutter or 0) that a start tag says of what it holds."""
    article, clutter = name in ARTICLE_TAGS, 0
    if name in CLUTTER_TAGS or name == "header" and not in_article:
        clutter = WRAPPER if name in WRAPPER_TAGS else NAMED
    if rest and not rest.isspace():
        for m in _NAMED.finditer(rest):
            for token in (m[1] or m[2] or m[3] or "").split():
                parts = [p.lower() for p in _PARTS.findall(token)]
                whole = "".join(parts)
                article = article or whole in ARTICLE_NAMES or bool(ARTICLE_NAMES.intersection(parts))
                if name in ("html", "body") or not parts or in_article and whole == "header":
                    continue
                told = [p for p in parts if p in CLUTTER_NAMES or p in COMMENT_NAMES]
                if whole in WHOLE_NAMES or told and all(p in CLUTTER_NAMES or p in COMMENT_NAMES or p in LAYOUT_NAMES or p.isdigit() for p in parts):
                    kind = FIXED if COMMENT_NAMES.intersection(told) or whole in COMMENT_NAMES else WRAPPER if whole in WHOLE_NAMES else NAMED
                    clutter = max(clutter, kind)
        if name not in ("html", "body") and _HIDDEN.search(rest):
            clutter = FIXED
    return article, clutter


def settled(out: list[dict]) -> None:
    """Sets article and clutter of the blocks from the containers around them: (number in opening order, is article,
    kind of clutter). A clutter container is none if it holds most words of the page's articles by an article inside it,
    and, unless it may be a wrapper, most words of the page; a wrapper also if no article is there and it holds most
    words of the page."""
    words = sum(b["words"] for b in out)
    of_articles = [b for b in out if any(a for _, a, _ in b["in"]) and not any(k == FIXED for _, _, k in b["in"])]
    in_articles = sum(b["words"] for b in of_articles)
    held: dict[int, list] = {}
    for b in out:
        for n, _, kind in b["in"]:
            if kind:
                h = held.setdefault(n, [kind, 0, 0])
                h[1] += b["words"]
                if any(a and m > n for m, a, _ in b["in"]):
                    h[2] += b["words"]
    none = {n for n, (kind, all_words, by_article) in held.items() if kind != FIXED and (
        2 * by_article > in_articles > 0 and (kind == WRAPPER or 2 * all_words > words)
        or kind == WRAPPER and not in_articles and 2 * all_words > words)}
    for b in out:
        around = b.pop("in")
        b["article"] = float(any(a for _, a, _ in around))
        b["clutter"] = float(any(kind and n not in none for n, _, kind in around))


def blocks(page: str | None) -> list[dict]:
    """The text blocks of a page in order, with their features."""
    out: list[dict] = []
    open_tags: list[tuple[str, tuple]] = []  # name, containers that mark what they hold, from the outside in
    containers = 0
    text: list[str] = []
    linked: list[str] = []
    heading, anchors = False, 0

    def end() -> None:
        nonlocal text, linked
        words = entities.unescape("".join(text)).split() if text else []
        if words:
            in_links = len(entities.unescape(" ".join(linked)).split())
            out.append({"text": " ".join(words), "words": len(words), "links": min(1.0, in_links / len(words)),
                        "in": open_tags[-1][1] if open_tags else (), "heading": float(heading)})
        text, linked = [], []

    def close(name: str) -> None:
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i][0] == name:
                del open_tags[i:]
                break

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at: m.start()]
            text.append(piece)
            if anchors:
                linked.append(piece)
        at = m.end()
        name = (m["name"] or "").lower()
        if m["raw"]:
            end()
            continue
        if not name:
            continue
        if m["close"]:
            if name in BLOCK:
                end()
                if name[0] == "h" and name[1:].isdigit():
                    heading = False
            if name == "a":
                anchors = 0
            close(name)
            continue
        if name in BLOCK:
            end()
            if any(t[0] == "p" for t in open_tags[-3:]):
                close("p")
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and open_tags and open_tags[-1][0] == name:
                open_tags.pop()
            heading = name[0] == "h" and name[1:].isdigit()
        if name == "a":
            anchors = 1
        if name not in VOID and (name in BLOCK or m["rest"]) and not m["rest"].endswith("/"):
            around = open_tags[-1][1] if open_tags else ()
            article, clutter = marks(name, m["rest"], any(a for _, a, _ in around))
            if article or clutter or name in BLOCK:
                if article or clutter:
                    containers += 1
                    around = (*around, (containers, article, clutter))
                open_tags.append((name, around))
    if at < len(page):
        text.append(page[at:])
    end()
    settled(out)
    some = float(any(b["article"] and not b["clutter"] for b in out))
    for i, b in enumerate(out):
        before, after = out[i - 1] if i else None, out[i + 1] if i + 1 < len(out) else None
        b |= {"page_article": some, "words_before": before["words"] if before else 0, "links_before": before["links"] if before else 0.0,
              "words_after": after["words"] if after else 0, "links_after": after["links"] if after else 0.0}
    return out


#: Small labelled pages: +n stands for n words of main text, -n for n words of anything else.
LABELLED = (
    "<nav><ul><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-9</div><article><h1>+8</h1><p>+40<p>+1<p>+90</article><footer>-6</footer>",
    "<header>-3</header><main><h1>+5</h1><p>+60</p><p>+2</p><p><a>+4</a> +20</p><aside>-30</aside><p>+35</p></main><footer>-12 <a>-3</a></footer>",
    "<div id=menu><a>-1</a> <a>-1</a></div><div><h1>+6</h1><p>+50</p><p>+30</p><p>+12</p><p>+70</p></div><div class=sidebar><p>-25</p><p>-40</p></div>",
    "<ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul><h2>+4</h2><p>+45</p><p>+25</p><p>+6</p><p>+55</p><ul><li><a>-2</a><li><a>-3</a></ul>-5",
    "<article><p>+3</p><p>+1</p><p>+2</p><div class=advert>-35</div><p>+4</p><section class=comments><p>-20</p><p>-45</p></section></article><p>-15</p>",
    "<div class=cookie-notice><p>-30</p><button>-1</button></div><article><h1>+7</h1><p>+1</p><ul><li>+9<li>+3</ul><form><label>-2</label><p>-12</p></form></article>",
    "<p><a>-3</a></p><div>-2</div><div><p>+35</p><p>+22</p><blockquote>+15</blockquote><p>+80</p></div><p>-4</p><p><a>-2</a> <a>-4</a></p>",
    "<div class=post><h1>+9</h1><p>+18</p><p>+7</p><pre>+30</pre></div><div id=comments><p>-50</p><p>-8</p></div><div>-20</div><div><a>-6</a></div>",
    "<header><h1>-4</h1><a>-2</a></header><p>+33</p><h3>+3</h3><p>+28</p><table><tr><td>+12<td>+14</table><p>+40</p><footer><p>-25</p></footer>",
    "<div class=newsletter>-14</div><div>+100</div><div>+26</div><div>+65</div><div class=related><a>-7</a><a>-9</a></div><div hidden>-40</div>",
    "<main><p>+1</p></main><p>-60</p><p>-1</p><div>-8</div>",
    "<article><a>+3</a><p><a>+5</a></p><p>+11</p></article><div><p>-18</p><p><a>-4</a></p></div>",
    "<p>+60</p><p>+14</p><p>+45</p><p>-3</p><p><a>-3</a></p>",
    "<div>-2</div><div><a>-5</a></div><div>-1</div><p>+21</p><p>+19</p><p>+24</p>",
    "<p>+250</p>",
    "<div>+30</div>",
    "<p>+70</p><div class=ad>-30</div>",
    "<nav><a>-3</a></nav><p>+3000</p>",
    "<p>+18</p><p>+800</p>",
    "<h1>+6</h1><p>+120</p><p>+90</p><footer>-9</footer>",
    "<p><a>-4</a></p>",
    "<p><a>-9</a> -2</p><p><a>-12</a></p>",
    "<form><p>-60</p><label>-3</label></form><p>+40</p>",
    "<article>+4</article>",
    "<article><p>+1</p></article><p>-40</p><p>-90</p>",
    "<nav><a>-2</a></nav><article><p>+2</p></article><p>-3</p><footer>-50</footer>",
    "<p>-9</p><article><p>+1</p><p><a>+2</a></p><p>+1</p><p>+2</p></article><p>-200</p>",
    "<article>+12</article><div>-300</div><div>-45</div>",
    "<div>-80</div><article><p>+5</p><p>+1</p><p><a>+9</a></p></article><div>-25</div><p>-70</p>",
    "<div>-33</div><main><p><a>+3</a></p><p><a>+2</a></p><p>+1</p><p><a>+7</a> +1</p></main><p><a>-3</a></p><p>-28</p>",
    "<div>-120</div><p>-22</p><article><h2>+2</h2><p>+3</p><ul><li>+1<li>+2<li>+1<li><a>+4</a></ul></article><div>-60</div>",
    "<article><p>+2</p><p>+30</p><p>+1</p><p>+1</p><blockquote>+2</blockquote></article><div>-35</div>",
    "<div>-14</div><p>-44</p><p>-19</p><article>+1</article>",
    "<form id=aspnetForm><nav><a>-3</a></nav><main><h1>+4</h1><p>+30</p><p>+2</p></main><div class=footer>-20</div></form>",
    "<div class='content has-sidebar'><article><p>+25</p><p>+3</p></article><div class=sidebar>-30</div></div>",
    "<div id=page class=with-nav><ul class=main-nav><li><a>-2</a></ul><p>+40</p><p>+22</p><div class='related-posts'><a>-6</a></div></div>",
    "<main><h1>+3</h1><p>+2</p><pre>+1</pre><p>+4</p></main><div>-24</div><div>-52</div><div>-17</div>",
)


def labelled_blocks() -> list[tuple]:
    """(features ..., label) of the blocks of the labelled pages."""
    rows = []
    for page in LABELLED:
        full = re.sub(r"([+-])(\d+)", lambda m: ("main " if m[1] == "+" else "other ") * int(m[2]), page)
        rows += [tuple(float(b[f]) for f in FEATURES) + (float("main" in b["text"]),) for b in blocks(full)]
    return rows


def trained(spark: SparkSession, max_depth: int = 8):
    """The tree as nested tuples (feature, threshold, left, right), a leaf as its class."""
    table = spark.createDataFrame(labelled_blocks(), ", ".join(f"{f} double" for f in (*FEATURES, "label")))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=max_depth, maxBins=64, seed=7).fit(data)

    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return n.prediction()
        return (n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild()))

    return node(model._java_obj.rootNode())


def is_main(tree, block: dict) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if block[FEATURES[tree[0]]] <= tree[1] else tree[3]
    return tree == 1.0


def main_text(tree, page: str | None) -> str:
    return "\n".join(b["text"] for b in blocks(page) if is_main(tree, b))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    tree = trained(pages.sparkSession)

    @F.arrow_udf("string")
    def read(html: pa.Array) -> pa.Array:
        return pa.array([main_text(tree, x.as_py()) for x in html], pa.string())

    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), read(F.col(html_col)).alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))
