"""Main text of pages by a site style tree.

The pages of one host are merged into a tree of style nodes: an element's tag,
classes and ids under its parent's style node.  Every node has a content
importance, from how often the text of its whole branch repeats over the host's
distinct pages (1 when all differ, 0 when all are the same), and a presentation
importance, the entropy of the sequences of its children.  Their composite,
weighted by a prior of what tag and names say (navigation, advert, comment, ...;
article, main), decides from the root down, and a branch of low importance is
removed from the page as a whole.  Beside it, an element whose exact branch
stands on most pages that have its node goes, even where the node's other
elements differ, unless an article element holds it.  Nodes seen on few pages
have the prior alone.

A name is overruled where its branch holds the page's article or most of its
text: wrappers are often called after what stands beside the article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neumatic.llm.common import written

#: Pages of a host that must hold a node before its entropy counts.
FEWEST = 5
#: Branches of a lower weighted importance go.
LEAST = 0.3
#: Share of the presentation side in the composite.
PRESENTATION = 0.1
#: Weights of the prior: names of noise, and what stands in an article or main element.
NOISE, CONTENT = 0.25, 2.0
#: An exact branch on this share of its node's pages, and on so many, is boilerplate.
REPEATED, REPEATED_PAGES = 0.6, 8
#: A branch with this share of a page's text, and no article or main heading outside it, overrules its name.
MOST = 0.6

# Elements by role in a page, names of what is not content, and words before such a name that say it is only near.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "button", "object", "math", "canvas", "audio", "video")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME_TAGS = frozenset("nav aside footer header menu dialog".split())
NOISE_TAGS = CHROME_TAGS | {"form", "head", "fieldset"}
ARTICLE_TAGS = frozenset("article main".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice popup promo promotion related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split())
NEAR_WORDS = frozenset("with without no has not single is".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: A tag whose start ends an open one.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A quote opens a value only after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+|(?=>|\Z)))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


def key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def noise_name(names: str) -> bool:
    """Whether a class or id names noise: a noise word alone or in two, or the first or last of more."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        if words and words[0] not in NEAR_WORDS and (NOISE_WORDS & set(words) if len(words) <= 2 else NOISE_WORDS & {words[0], words[-1]}):
            return True
    return False


@dataclass
class Page:
    """Elements in page order (index 0 stands for the page): style node, parent, tag, whether tag or names say noise, hide it, or put it inside an article; items are what an element holds in order, texts as their hash; blocks are (element, text)."""

    nodes: list[int] = field(default_factory=lambda: [key("#")])
    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["#"])
    noise: list[bool] = field(default_factory=lambda: [False])
    hidden: list[bool] = field(default_factory=lambda: [False])
    inside: list[bool] = field(default_factory=lambda: [False])
    items: list[list[int]] = field(default_factory=lambda: [[]])
    children: list[list[int]] = field(default_factory=lambda: [[]])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def open(self, tag: str, attributes: str, above: int) -> int:
        names = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}
        label = " ".join((tag, re.sub("[0-9]+", "#", names.get("class", "")), re.sub("[0-9]+", "#", names.get("id", "")), names.get("role", "")))
        noise = tag in NOISE_TAGS and not (tag == "header" and self.inside[above])
        noise = noise or names.get("role", "").lower() in NOISE_ROLES or noise_name(names.get("class", "")) or noise_name(names.get("id", ""))
        i = len(self.nodes)
        self.nodes.append(key(str(self.nodes[above]), label))
        self.parents.append(above)
        self.tags.append(tag)
        self.noise.append(noise and tag not in ("html", "body"))
        self.hidden.append("hidden" in names or names.get("aria-hidden", "").lower() == "true")
        self.inside.append(not self.noise[i] and (self.inside[above] or tag in ARTICLE_TAGS))
        self.items.append([])
        self.children.append([])
        self.children[above].append(i)
        self.items[above].append(-i)
        return i

    def say(self, i: int, text: str) -> None:
        self.blocks.append((i, text))
        self.items[i].append(xxhash.xxh3_64_intdigest(text) | 1)

    def branch_values(self) -> list[int]:
        """For each element the hash of all that its branch holds, in order; 0 if it holds no text."""
        values = [0] * len(self.nodes)
        for i in range(len(values) - 1, -1, -1):
            held = [x if x > 0 else values[-x] for x in self.items[i]]
            held = [x for x in held if x]
            if held:
                values[i] = xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in held)) | 1
        return values

    def sums(self, own: list[int]) -> list[int]:
        """Sums of ``own`` over each element's branch."""
        total = list(own)
        for i in range(len(total) - 1, 0, -1):
            total[self.parents[i]] += total[i]
        return total


def parsed(page: str) -> Page:
    """The block elements and text blocks of a page, in linear time and memory."""
    out, stack, text = Page(), [0], []

    def flush():
        words = entities.unescape("".join(text)).split()
        if words:
            out.say(stack[-1], " ".join(words))
        text.clear()

    open_tags: Counter = Counter()
    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            text.append(page[at:])
            break
        text.append(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        if not closing and tag in RAW_END and not attributes.rstrip().endswith("/"):
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            text.append(" ")
            continue
        if tag not in BLOCK:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            while open_tags[tag]:  # all that is open inside it ends too
                last = out.tags[stack.pop()]
                open_tags[last] -= 1
                if last == tag:
                    break
            continue
        above = out.tags[stack[-1]]
        while above == "p" or above in HEADINGS and tag in HEADINGS or above in ENDS.get(tag, ()):
            open_tags[above] -= 1
            stack.pop()
            above = out.tags[stack[-1]]
        i = out.open(tag, attributes, stack[-1])
        if tag not in VOID:
            stack.append(i)
            open_tags[tag] += 1
    flush()
    return out


def host_of(url: str | None) -> str:
    """Lower-case host of a URL, without user and port; empty if there is none."""
    found = re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", url or "")
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def instance(node: int, value: int) -> int:
    """Key of an exact branch in a style node."""
    return key(str(node), str(value))


def features_of(page: Page) -> set[tuple[int, int, int]]:
    """(kind, node, value): each node (kind 2), its branches' contents (1) and sequences of children (0), once a page; a branch's value is its instance key."""
    found = set()
    for i, value in enumerate(page.branch_values()):
        if value:
            node = page.nodes[i]
            found.add((2, node, 0))
            found.add((1, node, instance(node, value)))
            if page.children[i]:
                found.add((0, node, key(*dict.fromkeys(page.tags[c] for c in page.children[i]))))
    return found


def contents(pages: DataFrame) -> DataFrame:
    """(host, page, found): what each distinct page of a host holds, once; ``found`` packs kind, node and value, column after column."""
    def scan(batches):
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            rows = []
            for url, page in zip(*(c.to_pylist() for c in batch.columns)):
                own = host_of(url), key(page or "")
                if own not in seen:
                    seen.add(own)
                    found = np.array(sorted(features_of(parsed(page or ""))), np.int64).reshape(-1, 3)
                    rows.append((*own, found[:, 0].astype(np.int8).tobytes() + found[:, 1:].T.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["host", "page", "found"])

    return pages.select("url", "html").mapInArrow(scan, "host string, page long, found binary").dropDuplicates(["host", "page"])


def features(pages: DataFrame) -> DataFrame:
    """(host, kind, node, value, n): how many distinct pages hold each feature, by task."""
    def scan(batches):
        for batch in batches:
            seen: Counter = Counter()
            for host, data in zip(*(c.to_pylist() for c in batch.columns)):
                size = len(data) // 17
                kinds, rest = np.frombuffer(data, np.int8, size), np.frombuffer(data[size:], np.int64).reshape(2, -1)
                seen.update(zip([host] * size, kinds.tolist(), *rest.tolist()))
            rows = list(seen)
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([seen[r] for r in rows], pa.int64())], names=["host", "kind", "node", "value", "n"])

    return contents(pages).select("host", "found").mapInArrow(scan, "host string, kind int, node long, value long, n long")


def importance(counted: DataFrame) -> DataFrame:
    """(host, node, pages, composite): how many distinct pages hold a style node, and its importance, 0 to 1."""
    def of(kind: int, value):
        return F.sum(F.when(F.col("kind") == kind, value))

    n, nln = F.col("n"), F.col("n") * F.ln("n")
    sums = counted.groupBy("host", "node").agg(of(2, n).alias("pages"), of(1, n).alias("n1"), of(1, nln).alias("nln1"), of(0, n).alias("n0"), of(0, nln).alias("nln0"))
    content = 1 - F.col("nln1") / F.col("n1") / F.ln("pages")
    shape = F.coalesce((F.ln("n0") - F.col("nln0") / F.col("n0")) / F.ln("n0"), content)
    composite = F.when(F.col("pages") > 1, (1 - PRESENTATION) * content + PRESENTATION * shape).otherwise(F.lit(1.0))
    return sums.select("host", "node", "pages", composite.alias("composite"))


def site_trees(pages: DataFrame, fewest: int = FEWEST, least: float = LEAST) -> DataFrame:
    """(host, nodes, composites, repeated): the style nodes of each host that are of low importance to some prior, and the instance keys of branches that most pages repeat."""
    counted = written(features(pages).groupBy("host", "kind", "node", "value").agg(F.sum("n").alias("n")), "features")
    nodes = written(importance(counted), "nodes")
    low = nodes.where((F.col("pages") >= fewest) & (F.col("composite") < least)).select("host", "node", "composite", F.lit(None).cast("long").alias("branch"))
    often = counted.where((F.col("kind") == 1) & (F.col("n") >= REPEATED_PAGES)).join(nodes, ["host", "node"]).where(F.col("n") >= REPEATED * F.col("pages"))
    every = low.unionByName(often.select("host", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("composite"), F.col("value").alias("branch")))
    found = F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "composite")))
    return every.groupBy("host").agg(found.alias("low"), F.collect_set("branch").alias("repeated")).select("host", F.col("low.node").alias("nodes"), F.col("low.composite").alias("composites"), "repeated")


def main_text(page: str | None, low: dict[int, float] | None = None, repeated: frozenset[int] = frozenset(), least: float = LEAST) -> str:
    """The page's blocks that stand in no branch of low importance, one a line.

    ``low`` has the composite of the host's nodes of low importance, and
    ``repeated`` the instance keys of its repeated branches.
    """
    tree = parsed(page or "")
    low = low or {}
    values = tree.branch_values() if repeated else []
    size = len(tree.nodes)
    chars = [0] * size
    for i, text in tree.blocks:
        chars[i] += len(text)
    chars = tree.sums(chars)
    articles = tree.sums([int(tag in ARTICLE_TAGS and not noise) for tag, noise in zip(tree.tags, tree.noise)])
    marks = tree.sums([int(tag == "h1" or tag in ARTICLE_TAGS and not noise) for tag, noise in zip(tree.tags, tree.noise)])
    in_article, gone = [False] * size, [False] * size
    for i in range(1, size):
        above, tag = tree.parents[i], tree.tags[i]
        gone[i] = gone[above] or tree.hidden[i]
        if gone[i]:
            continue
        chrome = tag in CHROME_TAGS
        own = articles if chrome else marks
        overruled = chars[i] >= MOST * chars[0] and own[i] == own[0] and (own[i] > 0 or not chrome)
        noise = tree.noise[i] and (tag == "head" or not overruled)
        in_article[i] = not noise and (in_article[above] or tag in ARTICLE_TAGS)
        weight = NOISE if noise else CONTENT if in_article[i] else 1.0
        again = bool(repeated) and not in_article[i] and tag not in ("html", "body") and values[i] != 0 and instance(tree.nodes[i], values[i]) in repeated
        gone[i] = again or weight * low.get(tree.nodes[i], 1.0) < least
    kept = [(in_article[i], text) for i, text in tree.blocks if not gone[i]]
    inside = sum(len(text) for own, text in kept if own)
    if 2 * inside >= sum(len(text) for _, text in kept):  # the article is there: the rest is beside it
        kept = [(own, text) for own, text in kept if own or not inside]
    return "\n".join(text for _, text in kept)


def extract(pages: DataFrame, fewest: int = FEWEST, least: float = LEAST) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null html, and a page without main text, give an empty text.  A null url,
    or one without a host, belongs to the empty host.  Repeated rows are
    extracted each; pages of equal html count once in their host's tree.  Other
    columns are ignored; an empty table gives an empty result.  Where article
    or main elements hold at least half of what is left of a page, text outside
    them is left out.  Memory: one page's elements a task, and the low nodes of
    one host, which is a row that a join on the host brings (Spark broadcasts
    the trees only where their files are below its threshold, and splits a
    host's pages otherwise).
    """
    trees = written(site_trees(pages, fewest, least), "trees")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\s]*@)?([^/?#\s:@]*)", 1))
    marked = pages.select("page_id", "url", "html", host.alias("host")).join(trees, "host", "left").select("page_id", "url", "html", "host", "nodes", "composites", "repeated")
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def scan(batches) -> Iterator[pa.RecordBatch]:
        last, low, repeated = None, {}, frozenset()
        for batch in batches:
            texts = []
            for i, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host != last:
                    last, low = host, dict(zip(batch.column(4)[i].as_py() or (), batch.column(5)[i].as_py() or ()))
                    repeated = frozenset(batch.column(6)[i].as_py() or ())
                texts.append(main_text(page, low, repeated, least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return marked.mapInArrow(scan, schema)
