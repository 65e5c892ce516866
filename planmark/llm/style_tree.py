"""Main text of web pages by a site style tree.

Pages of one host are merged by the paths of their elements (tag, classes and id from the root). A
merged node knows, over the distinct pages of its host, on how many pages each of its block texts
stands (content) and which inline markup its blocks have (presentation). Content that stands on many
pages carries little: a text on c of m pages has importance 1 - log(c) / log(m), and a node the mean
over its different texts. Presentation is worth its entropy to base m. A node's importance joins the
two, nine parts to one, times a prior from the markup: navigation, headers, footers, asides, forms and
elements whose class, id or role names nothing but such a thing have none; what a name leaves in doubt
(``ad-hoc``), and what stands outside ``article`` or ``main`` on a page that has one, counts half; what
stands inside counts double. Blocks of nodes below ``THRESHOLD`` are removed, so a line that a site
repeats within its articles under a class that says nothing goes by the tree alone. A host with few
pages, or none in its address, is judged by the tree merged over all hosts. Pages join the short list of
their host's low nodes.

Behaviour at the edges: a null or empty page has an empty text; malformed markup is read as browsers
read it as far as blocks go (a block start ends an open paragraph, stray end tags are ignored, an
open comment or script runs to the end; a quoted attribute may have any length; ``article`` and ``main``
inside a form are read as such); an element of noise inside a paragraph leaves the paragraph whole; pages
of a host with equal text inside ``article`` or ``main``, or equal as a whole where they have none, count
once, so copied articles stay; very long pages are read like others, in one task each; repeated rows and
null or equal ids keep one result row each; an empty table gives an empty result; columns beside the page's
are passed through, columns named as the results are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from planmark.llm.common import bound_batches, spare, text_of
from planmark.session import cut_lineage

THRESHOLD, LEAST_PAGES, CONTENT_SHARE = 0.4, 4, 0.9
#: What the importance of a node counts inside article or main, and where the markup speaks against it.
INSIDE, DOUBTED = 2.0, 0.5

# fixed values: element names of HTML, and words by which sites name what is not the article
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe svg math canvas object audio video textarea title select".split())
NOISE_TAGS = frozenset("head nav footer aside form dialog menu button search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disclaimer disqus footer gdpr login menu menus modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted related replies respond share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that say nothing beside a noise word, as in ``share-buttons`` or ``site-footer-2``.
PLAIN_WORDS = frozenset(
    "area article bar block body bottom box btn button buttons column container content form global group icon icons inline "
    "inner item items js left link links list main middle mobile module outer page panel post posts primary right row "
    "secondary section site slot sticky text thread title top unit wrap wrapper".split()
)
#: Names of headers: noise outside the article, its title inside.
HEADER_WORDS = frozenset("header masthead topbar".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that end an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl article section div body html".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


NONE, DOUBT, FORM, NOISE = range(4)


def _named(attributes: dict[str, str], in_main: bool) -> int:
    """What the class and id say: each name whose words are all noise or plain ones, one of them noise, is noise."""
    found = NONE
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in _NAME.findall(name)}
        noise = words & NOISE_WORDS or (set() if in_main else words & HEADER_WORDS)
        if noise:
            plain = all(w in noise or w in PLAIN_WORDS or w.isdigit() or len(w) == 1 for w in words)
            found = max(found, NOISE if plain else DOUBT)
    return found


def _noise(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    """How far the markup speaks against an element; FORM no longer holds for an article inside."""
    if tag in NOISE_TAGS or (tag == "header" and not in_main):
        return FORM if tag == "form" and not attributes.get("role") and not _named(attributes, in_main) else NOISE
    if not attributes:
        return NONE
    if "hidden" in attributes or _HIDDEN.search(attributes.get("style", "")):
        return NOISE
    if attributes.get("role", "").lower() in NOISE_ROLES:
        return NOISE
    if tag in ("html", "body", *MAIN_TAGS) and "comment" not in attributes.get("class", "").lower():
        return NONE
    return _named(attributes, in_main)


def _ends(page: str, tag: str) -> dict[int, tuple[int, int]]:
    """For each element ``tag`` by the place of its start tag: where its end tag begins and ends."""
    opened, out = [], {}
    for m in re.compile(f"<(/?){re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).finditer(page):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            stop = page.find(">", m.end())
            out[opened.pop()] = m.start(), len(page) if stop < 0 else stop + 1
    return out


def _signature(tag: str, attributes: dict[str, str]) -> str:
    classes = ".".join(sorted(attributes.get("class", "").split()))
    named = attributes.get("id", "")
    return tag + (f".{classes}" if classes else "") + (f"#{named}" if named else "")


def blocks(page: str) -> list[tuple[str, str, str, str]]:
    """(path, text, inline markup, where) of each block with text, in page order; where is ``noise``,
    ``doubt``, ``main`` or ``other``."""
    out: list[tuple[str, str, str, str]] = []
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, noise, inside main
    words: list[str] = []
    inline: list[str] = []
    ends: dict[str, dict[int, tuple[int, int]]] = {}
    at, size = 0, len(page)

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text:
            _, path, noise, main = stack[-1] if stack else ("", "", NONE, False)
            where = "noise" if noise >= FORM else "doubt" if noise else "main" if main else "other"
            out.append((path, text, ",".join(dict.fromkeys(inline)), where))
        words.clear()
        inline.clear()

    def close(tags: frozenset | set, bounds: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                flush()
                del stack[i:]
                return
            if stack[i][0] in bounds:
                return

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            words.append(html.unescape(page[at:]))
            break
        if mark > at:
            words.append(html.unescape(page[at:mark]))
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        found = _TAG.match(page, mark) or _LOOSE.match(page, mark)
        if found is None:
            if page[mark + 1 : mark + 2].isalpha() or page.startswith("</", mark):
                break  # a tag that never ends
            words.append("<")
            at = mark + 1
            continue
        at = found.end()
        closing, tag, raw = found[1], found[2].lower(), found[3]
        if closing:
            if tag in BLOCKS:
                close({tag}, frozenset() if tag not in ("p", "li") else SCOPES - {tag})
            continue
        if tag in SKIPPED:
            if not raw.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.IGNORECASE).search(page, at)
                if end is None:
                    at = size
                else:
                    stop = page.find(">", end.start())
                    at = size if stop < 0 else stop + 1
            continue
        if tag == "br":
            words.append(" ")
            inline.append(tag)
            continue
        if tag not in BLOCKS:
            attributes = _attributes(raw)
            _, path, _, main = stack[-1] if stack else ("", "", NONE, False)
            if attributes and tag not in VOID and _noise(tag, attributes, main) >= FORM:
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                end = None if raw.endswith("/") else ends[tag].get(mark)
                if end is not None:
                    text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", page[at : end[0]])).split())
                    if text:
                        out.append((f"{path}/{_signature(tag, attributes)}", text, tag, "noise"))
                    at = end[1]
                continue
            inline.append(tag)
            continue
        flush()
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPES)
        close({"p"}, SCOPES)
        if tag in VOID:
            continue
        attributes = _attributes(raw)
        _, path, noise, main = stack[-1] if stack else ("", "", NONE, False)
        if tag in MAIN_TAGS and noise == FORM:
            noise = NONE
        noise = max(noise, _noise(tag, attributes, main))
        stack.append((tag, f"{path}/{_signature(tag, attributes)}", noise, main or tag in MAIN_TAGS))
    flush()
    return out


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


_TYPE = pa.list_(pa.struct([
    ("node", pa.int64()), ("text", pa.string()), ("style", pa.int64()), ("where", pa.string()),
    ("new_text", pa.bool_()), ("new_style", pa.bool_()),
]))


def _row(page: str) -> list[dict]:
    """Blocks of a page; new_text and new_style tell the first of equal ones in a node."""
    out, seen = [], set()
    for path, text, inline, where in blocks(page):
        node, style = _hash(path), _hash(inline)
        marks = [key not in seen for key in ((node, text), (node, style))]
        seen.update(((node, text), (node, style)))
        out.append({"node": node, "text": text, "style": style, "where": where, "new_text": marks[0], "new_style": marks[1]})
    return out


def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        parts = [
            pa.array([_row(page or "") for page in batch.slice(at, 500).to_pylist()], _TYPE)
            for at in range(0, len(batch), 500)
        ]
        yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(parsed: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, node, weight): importance of each node of each host's tree, by the host's own pages or,
    where those are few, by all hosts' pages."""
    copies = cut_lineage(
        parsed.groupBy("host", "page").agg(F.count("*").alias("n")).filter("n > 1")
    ).withColumnsRenamed({"host": "of_host", "page": "of_page"})
    same = (F.col("host") == F.col("of_host")) & (F.col("page") == F.col("of_page"))
    # equal pages share the weight of one
    shared = parsed.join(copies, same, "left").withColumn("w", F.lit(1.0) / F.coalesce("n", F.lit(1)))
    both = F.inline(F.array(
        F.struct(F.lit(True).alias("is_content"), F.xxhash64("b.text").alias("value"), F.col("b.new_text").alias("new")),
        F.struct(F.lit(False).alias("is_content"), F.col("b.style").alias("value"), F.col("b.new_style").alias("new")),
    ))
    node = shared.select("host", "w", F.explode("blocks").alias("b")).select("host", "w", F.col("b.node").alias("node"), both)
    seen = cut_lineage(
        node.filter("new").groupBy("host", "node", "is_content", "value").agg(F.round(F.sum("w")).cast("long").alias("c"))
    )
    pages = cut_lineage(shared.groupBy("host").agg(F.round(F.sum("w")).cast("long").alias("m")))

    def weigh(counts: DataFrame, keys: list[str], m: Column, nodes_pages: Column) -> DataFrame:
        base = F.log(F.greatest(m, F.lit(2)).cast("double"))
        share = F.col("c") / nodes_pages
        content = F.avg(F.when(F.col("is_content"), F.lit(1.0) - F.log(F.col("c").cast("double")) / base))
        style = F.sum(F.when(~F.col("is_content"), -share * F.log(share) / base))
        return counts.groupBy(*keys).agg(content.alias("content"), style.alias("style")).select(
            *keys,
            (CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.least(F.col("style"), F.lit(1.0))).alias("weight"),
        )

    styles = lambda counts, keys: counts.filter("not is_content").groupBy(*keys).agg(F.sum("c").alias("on"))
    own = seen.join(styles(seen, ["host", "node"]), ["host", "node"]).join(pages, "host").filter(
        (F.col("m") >= least_pages) & (F.col("host") != "")
    )
    own = weigh(own, ["host", "node"], F.col("m"), F.col("on"))
    everywhere = seen.groupBy("node", "is_content", "value").agg(F.sum("c").alias("c"))
    total = pages.agg(F.sum("m").alias("m")).first()["m"] or 0
    of_all = everywhere.join(styles(everywhere, ["node"]), "node").filter(F.lit(total >= least_pages))
    of_all = weigh(of_all, ["node"], F.lit(total), F.col("on"))
    few = pages.filter((F.col("m") < least_pages) | (F.col("host") == "")).select("host")
    others = seen.select("host", "node").distinct().join(few, "host").join(of_all, "node").select("host", "node", "weight")
    return own.unionByName(others)


def low_nodes(weights: DataFrame, threshold: float) -> DataFrame:
    """(host, low, low_doubted, low_inside): nodes below the threshold, by their importance as it is, where
    the markup speaks against them, and inside article or main.

    Such a node's texts stand on many of the host's pages each, so a host has few of them beside its
    pages, and one short list travels with the host.
    """
    part = lambda prior: F.collect_list(F.when(F.col("weight") * prior < threshold, F.col("node")))
    return (
        weights.filter(F.col("weight") * DOUBTED < threshold).groupBy("host")
        .agg(part(1.0).alias("low"), part(DOUBTED).alias("low_doubted"), part(INSIDE).alias("low_inside"))
    )


def extract(
    df: DataFrame, page: str = "html", url: str = "url", out: str = "text", count: str = "n_chars",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Adds the main text of ``page`` and its number of characters."""
    bound_batches(df)
    rest = df.drop(out, count)
    host, parsed, same, low_host, low, doubted, inside = spare(
        rest, "x_host", "x_blocks", "x_same", "x_low_host", "x_low", "x_low_doubted", "x_low_inside"
    )
    kind = "array<struct<node:long,text:string,style:long,where:string,new_text:boolean,new_style:boolean>>"
    body = text_of(page)
    kept = [F.col(f"`{c}`") for c in rest.columns if c != page]
    whole = cut_lineage(df.select(  # parsed once
        *kept, host_of(F.col(f"`{url}`")).alias(host), F.xxhash64(body).alias(same),
        F.arrow_udf(_parsed, kind).asNondeterministic()(body).alias(parsed),
    ))
    has_main = F.exists(parsed, lambda b: b["where"] == "main")
    # copies of an article among other adverts are one page of the tree
    article = F.xxhash64(F.transform(F.filter(parsed, lambda b: b["where"] == "main"), lambda b: b["text"]))
    weights = importance(whole.select(
        F.col(host).alias("host"), F.when(has_main, article).otherwise(F.col(same)).alias("page"),
        F.col(parsed).alias("blocks"),
    ))
    lows = cut_lineage(low_nodes(weights, threshold)).select(
        F.col("host").alias(low_host), F.col("low").alias(low), F.col("low_doubted").alias(doubted),
        F.col("low_inside").alias(inside),
    )
    joined = whole.join(lows, F.col(host) == F.col(low_host), "left")
    none = F.array().cast("array<bigint>")
    outside = F.when(has_main, F.col(doubted)).otherwise(F.col(low))
    marked = joined.withColumns({
        low: F.coalesce(outside, none), doubted: F.coalesce(F.col(doubted), none), inside: F.coalesce(F.col(inside), none),
    })
    lists = {"main": inside, "other": low, "doubt": doubted}
    stay = F.filter(parsed, lambda b: reduce(
        lambda a, c: a | c,
        [(b["where"] == where) & ~F.array_contains(F.col(nodes), b["node"]) for where, nodes in lists.items()],
    ))
    text = F.array_join(F.transform(stay, lambda b: b["text"]), "\n")
    return marked.select(*kept, text.alias(out)).withColumn(count, F.length(out).cast("long"))
