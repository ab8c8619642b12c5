"""Problem 5: page furniture among the blocks of pages, by site style trees.

A page is a tree: headings with the blocks under them; lists and lines with bars have their entries as leaves. The pages of a host are
merged into its style tree by a node's key, its text folded, with the host's name masked and words outside the corpus's common
vocabulary left open. Of every node of the tree are computed, over the host's pages,

- content importance: one less the entropy of the articles that the node stands beside, on the base of the host's articles. A node of ever
  different articles has little, a node of a copied article keeps its company. An article is known by least hashes of its blocks, which small edits
  mostly spare, under several hash functions;
- importance of its open words, such as the names in a byline: the entropy of the texts that the node was seen with, weighted by their share of its words;
- presentation importance of a heading: the entropy of what stands under it, titles or prose. A common heading whose branch is ever titles has little.

Branches of low importance are cut: furniture lines, lists whose leaves are mostly low, and side headings with the teasers under them. A page that
would keep no text at all keeps its line of greatest importance, since a notice in place of an article is the page's body.

Where a host's tree cannot tell, since the host has few pages or the node stands on few of them, the corpus's tree of the nodes in a share of all pages
decides by the same importance. A key in at least `share` of the pages is one of at most (nodes of a page) / share keys, so that
tree is small whatever the corpus; a host's own nodes join its pages as one row per host.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpage.functions.urls import site_host
from lumenpage.sources import ship_package, stage

SHARE, LEAST = 0.0008, 5  # of all pages and in number, from which the corpus's tree has a node
ARTICLES = 3  # least articles of a host beside a node of its tree
HOST_SPREAD = 0.3  # least entropy of articles of a low node of a host, as a share of the greatest possible
UNSTEADY = 0.6  # the same in the corpus's tree, where it is a share of the entropy that the node's number allows
OPEN = 0.3  # importance of open words above which a node is kept
NAMED = 0.3  # share of a line's words that name a person, from which it is a byline and no node of furniture
HEAD = 0.7  # least share of pages on which a node stands between title and article, for it to belong to them, as a byline does
INSIDE = 0.7  # least share of pages on which a node stands inside the article, between prose, for it to be part of it
STYLE = 0.62  # most bits of entropy in the presentation of a side heading, whose branches are mostly titles
LEAVES = 0.6  # share of low leaves at which a list is cut
PROSE = 240  # characters from which a block is prose: its key is its whole text, and it tells its article
TOP = 3  # lines under the title in which a byline stands
BUCKETS = 8  # into which a node's texts fall for their entropy
SEEDS = (0, 1, 2)  # hash functions that tell articles

WORD = re.compile(r"[^\W\d_]+")
AFTER = re.compile(r"(?:^|(?<=[\W\d_]))[a-zà-ÿа-яά-ώ][^\W\d_]*\s+(?=([^\W\d_]+))")
CJK = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
END = re.compile(r"[.!…。][\"”»'’)]*\s*$")
BAR = re.compile(r"\s*[|｜]\s*|\s+[>›»·•/]\s+")


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def labels_of(host: str | None) -> list[str]:
    """The parts of a host's name that may stand for the site, longest first."""
    parts = {p for p in re.split(r"[.\-]", host or "") if len(p) > 3 and p not in ("example", "www", "com", "org", "news", "blog")}
    return sorted(parts, key=lambda p: (-len(p), p))


def _ascii(text: str) -> str:
    """The text without characters beyond ASCII if it is mostly ASCII, so that wrongly decoded spellings agree with right ones."""
    if text.isascii() or sum(c.isascii() and c.isalpha() for c in text) * 2 <= sum(c.isalpha() for c in text):
        return text
    return re.sub(r"[^\x00-\x7f]+", "", text)


def template(text: str, host: list[str], common: frozenset[str]) -> tuple[str, float, float]:
    """(key, open, named): lower-case words of the text, "<h>" for the site's name, "*" for a run of words outside the common vocabulary, which has no names;
    the share of such words, and the share of those in runs of capitals, which name persons. The key is empty if no word is left, or, in scripts without blanks, if less than half of the letters are."""
    out: list[str] = []
    kept = lost = words = free = named = run = 0
    for w in WORD.findall(_ascii(text)):
        low = w.lower()
        t = "<h>" if any(h in low for h in host) else low if low in common else "*"
        words += 1
        if t == low:
            kept += len(w)
        elif t == "*":
            lost += len(w)
            free += 1
        run = run + 1 if t == "*" and w[0].isupper() else 0
        named += 2 if run == 2 else run > 2
        if not (t == "*" and out and out[-1] == "*"):
            out.append(t)
    key = "" if not kept or (kept < lost and CJK.search(text)) else " ".join(out)
    return key, free / max(words, 1), named / max(words, 1)


def short_key(text: str, host: list[str], common: frozenset[str]) -> tuple[int, float]:
    """The key of a short text and its share of open words; 0 for one that is mainly the name of a person. Without a common word the text itself is the key."""
    t, free, named = template(text, host, common)
    return (0, 0.0) if named >= NAMED else (_key(t or " ".join(text.lower().split())), free)


def common_words(blocks: DataFrame, least: float) -> frozenset[str]:
    """Words in at least `least` short blocks and entries, without those mostly spelt with a capital after a word in small letters; few, since `least`
    grows with the pages."""
    ship_package(blocks.sparkSession)

    def words(batches):
        for b in batches:
            seen: Counter = Counter()
            inside: Counter = Counter()
            named: Counter = Counter()
            for kind, text, items in zip(*(b.column(i).to_pylist() for i in range(3))):
                for part in (items or []) if kind == "list" else [text]:
                    if part and len(part) <= PROSE:
                        part = _ascii(part)
                        seen.update({w.lower() for w in WORD.findall(part)})
                        if END.search(part) and not part.isupper():
                            follow = [(m.group(1).lower(), m.group(1)[0].isupper()) for m in AFTER.finditer(part)]
                            inside.update(w for w, _ in follow)
                            named.update(w for w, capital in follow if capital)
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), **{c: pa.array([x[w] for w in seen], pa.int64()) for c, x in (("n", seen), ("m", inside), ("k", named))}})

    counted = blocks.select("type", "text", "items").where("type <> 'table'").mapInArrow(words, "word string, n bigint, m bigint, k bigint")
    total = counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in "nmk")).where((F.col("n") >= least) & ((F.col("m") < 3) | (2 * F.col("k") < F.col("m"))))
    return frozenset(r.word for r in total.select("word").collect())


PAGE = "array<struct<pos:int,type:string,text:string,items:array<string>>>"
NODES = "array<struct<pos:int,kind:int,key:bigint,open:double,told:int,flat:boolean,inside:boolean,head:boolean,leaves:array<bigint>,grams:array<bigint>>>"


def keyed_pages(blocks: DataFrame, pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """(doc_id, host, articles, nodes) of every page: its blocks in order, with their keys. kind: 0 heading, 1 p, 2 list, 3 other; flat: all its text is titles;
    open: the share of open words; told: the bucket of its whole text; head and inside: where it stands. Repeated rows of a block count once."""
    spark = blocks.sparkSession
    ship_package(spark)
    known = spark.sparkContext.broadcast(common)
    grouped = blocks.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "type", "text", "items")).alias("page"))
    joined = grouped.join(pages, "doc_id", "left").select("doc_id", "host", F.sort_array("page").alias("page"))

    def key(batches):
        vocabulary = known.value
        for b in batches:
            docs, hosts, out, articles = [], [], [], []
            for doc, host, page in zip(*(b.column(i).to_pylist() for i in range(3))):
                names, nodes, last = labels_of(host), [], None
                prose = [x["text"] for x in page if x["text"] and x["type"] != "heading" and len(x["text"]) > PROSE] or [x["text"] for x in page if x["text"] and x["type"] in ("p", "table")] or [x["text"] for x in page if x["text"]]
                articles.append([min((xxhash.xxh64_intdigest(t, s) - (1 << 63) for t in prose), default=0) for s in SEEDS])
                for x in page:
                    if x["pos"] == last:
                        continue
                    last = x["pos"]
                    text, kind = x["text"] or "", {"heading": 0, "p": 1, "list": 2}.get(x["type"], 3)
                    leaves: list[int] = []
                    grams: list[int] = []
                    flat, k, free = False, 0, 0.0
                    if kind == 2:
                        items = x["items"] or text.split(" ; ")
                        parts = [p for i in items for p in (BAR.split(i) if len(i) <= PROSE else [i]) if p]
                        leaves = [short_key(p, names, vocabulary)[0] if len(p) <= PROSE else _key(p) for p in parts]
                        flat = all(not END.search(i) for i in items)
                    if kind < 3 and text:
                        k, free = short_key(text, names, vocabulary) if len(text) <= PROSE else (_key(" ".join(text.lower().split())), 0.0)
                        if kind == 0 and any(c.isdigit() for c in text):
                            k = 0
                    if kind < 2 and len(text) <= PROSE:
                        flat = not END.search(text)
                        if kind == 1 and len(parts := [p for p in BAR.split(text) if p]) > 1:
                            leaves = [short_key(p, names, vocabulary)[0] for p in parts]
                        elif kind == 1 and flat and len(words := text.split()) in range(3, 17):
                            grams = [short_key(w, names, vocabulary)[0] for w in words] + [short_key(f"{v} {w}", names, vocabulary)[0] for v, w in zip(words, words[1:])]
                    nodes.append({"pos": x["pos"], "kind": kind, "key": k, "open": free, "told": _key(text) % BUCKETS, "flat": flat, "prose": kind == 1 and not flat and len(text) > 80, "leaves": leaves, "grams": grams})
                at = [i for i, x in enumerate(nodes) if x["prose"]]
                titled = next((i for i, x in enumerate(nodes) if x["kind"] == 0), len(nodes))
                for i, x in enumerate(nodes):
                    x["inside"] = bool(at) and at[0] < i < at[-1]
                    x["head"] = titled < i <= titled + TOP and not any(y["kind"] == 0 or y["prose"] for y in nodes[titled + 1 : i])
                docs.append(doc)
                hosts.append(None if host is None else _key(host))
                out.append(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(hosts, pa.int64()), pa.array(articles, pa.list_(pa.int64())), pa.array(out, node_type)], ["doc_id", "host", "articles", "nodes"])

    node_type = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("open", pa.float64()), ("told", pa.int32()), ("flat", pa.bool_()), ("inside", pa.bool_()), ("head", pa.bool_()), ("leaves", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))]))
    doc = blocks.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(key, f"doc_id {doc}, host bigint, articles array<bigint>, nodes {NODES}")


def _nodes(pages: DataFrame) -> DataFrame:
    """(host, articles, what, key, open, told, flat, inside, head): a row for each keyed node, and for each leaf. what: "h" heading, "p" other, "l" leaf; flat: the
    block after it is all titles."""
    node = F.expr("transform(nodes, (x, i) -> named_struct('what', if(x.kind = 0, 'h', 'p'), 'key', x.key, 'open', x.open, 'told', x.told, 'flat', if(coalesce(get(nodes, i + 1).flat, true), 1, 0), 'inside', if(x.inside, 1, 0), 'head', if(x.head, 1, 0)))")
    leaf = F.expr("flatten(transform(filter(nodes, x -> size(x.leaves) > 1), x -> transform(x.leaves, y -> named_struct('what', 'l', 'key', y, 'open', 0D, 'told', 0, 'flat', 1, 'inside', 0, 'head', if(x.head, 1, 0)))))")
    return pages.select("host", "articles", F.explode(F.concat(node, leaf)).alias("n")).select("host", "articles", "n.*").where("key <> 0")


def _importance(rows: DataFrame, by: list[str], floor: int) -> DataFrame:
    """(by..., n, spread, told, open, inside, head, style) of every node: pages, nats of entropy of the articles beside it, entropy of its texts as a share of the greatest possible,
    its share of open words, and bits of entropy of what follows. Nodes of fewer than `floor` articles, by any of the hash functions, are left out. Counts
    are combined before the shuffle, first for each article, then for each node."""
    told = [F.sum(F.when(F.col("told") == i, 1).otherwise(0)).alias(f"t{i}") for i in range(BUCKETS)]
    first = rows.groupBy(*by, F.col("articles")[0].alias("article")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("flat").alias("f"), F.sum("open").alias("o"), F.sum("inside").alias("i"), F.sum("head").alias("h"), *told, *[F.min(F.col("articles")[i]).alias(f"a{i}") for i in (1, 2)], *[F.max(F.col("articles")[i]).alias(f"z{i}") for i in (1, 2)]
    )
    g = first.groupBy(*by).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("a"), F.sum(F.col("c") * F.log("c")).alias("s"), F.sum("f").alias("f"), F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("h").alias("h"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(BUCKETS)],
        *[(F.min(f"a{i}") != F.max(f"z{i}")).alias(f"d{i}") for i in (1, 2)],
    ).where((F.col("a") >= floor) & F.col("d1") & F.col("d2"))
    xlogx = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    texts = F.log("n") - sum((xlogx(F.col(f"t{i}")) for i in range(1, BUCKETS)), xlogx(F.col("t0"))) / F.col("n")
    share = F.col("f") / F.col("n")
    bits = -(xlogx(share) + xlogx(1 - share)) / F.log(F.lit(2.0))
    return g.select(*by, "n", (F.log("n") - F.col("s") / F.col("n")).alias("spread"), (texts / F.log(F.least(F.col("n"), F.lit(BUCKETS)))).alias("told"), (F.col("o") / F.col("n")).alias("open"), (F.col("i") / F.col("n")).alias("inside"), (F.col("h") / F.col("n")).alias("head"), F.when(share > 0.5, bits).otherwise(1.0).alias("style"))


def _low(nodes: DataFrame, spread, least: float) -> DataFrame:
    """The nodes of low importance: spread over articles, without open words that tell something; of headings those with titles under them."""
    return nodes.where((spread >= least) & (F.col("open") * F.col("told") < OPEN) & ((F.col("what") == "h") | ((F.col("inside") < INSIDE) & (F.col("head") < HEAD))) & ((F.col("what") != "h") | (F.col("style") < STYLE)))


def low_nodes(rows: DataFrame, count: int) -> dict[str, set[int]]:
    """Keys of low importance in the corpus's tree, by what: side headings "h", lines "p", leaves "l"."""
    least = max(LEAST, SHARE * count)
    common = stage(rows.groupBy("what", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "common").select("what", "key")
    near = rows.join(F.broadcast(common), ["what", "key"])  # at most (nodes of a page) / SHARE rows
    low: dict[str, set[int]] = {"h": set(), "p": set(), "l": set()}
    for r in _low(_importance(near, ["what", "key"], 2), F.col("spread") / F.log("n"), UNSTEADY).select("what", "key").collect():
        low[r.what].add(r.key)
    return low


def host_nodes(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, h, p, l): keys of low importance in each host's own tree."""
    sizes = pages.where("host is not null").groupBy("host").agg(F.count_distinct(F.col("articles")[0]).alias("m"))
    nodes = _importance(rows.where("host is not null"), ["host", "what", "key"], ARTICLES).join(sizes, "host")
    low = _low(nodes, F.col("spread") / F.log(F.greatest("m", F.lit(ARTICLES))), HOST_SPREAD)
    return low.groupBy("host").agg(*[F.collect_list(F.when(F.col("what") == w, F.col("key"))).alias(w) for w in "hpl"])


def _all_leaves(grams: list[int], leaves: set[int]) -> bool:
    """Whether a line of words, given as the keys of its words and word pairs, is a row of leaves of one or two words."""
    n = (len(grams) + 1) // 2
    i = 0
    while i < n:
        if i + 1 < n and grams[n + i] in leaves:
            i += 2
        elif grams[i] in leaves:
            i += 1
        else:
            return False
    return n > 0


def cut_page(nodes: list[dict], sides: set[int], lines: set[int], leaves: set[int]) -> list[int]:
    """Positions of the page's furniture, given the low side headings, lines and leaves."""
    cut, teasers, text = [], False, 0
    for x in nodes:
        kind, key = x["kind"], x["key"]
        if kind == 0:
            teasers = key in sides
            if teasers:
                cut.append(x)
            continue
        mine = x["leaves"]
        many = len(mine) > 1 and sum(k in leaves or k in lines for k in mine) >= LEAVES * len(mine)
        if kind in (1, 2) and (key in lines or many or (x["grams"] and _all_leaves(x["grams"], leaves))):
            cut.append(x)
        elif teasers and x["flat"] and kind in (1, 2):
            cut.append(x)
            teasers = kind == 1
        else:
            teasers = False
            text += 1
    if not text and (own := [x for x in cut if x["kind"] == 1 and not x["leaves"] and not x["flat"]]):
        cut.remove(max(own, key=lambda x: x["open"]))  # a notice in the article's place
    return [x["pos"] for x in cut]


def find_furniture(blocks: DataFrame, docs: DataFrame, doc_id: str = "doc_id", url: str = "url", host_tree: bool = True, corpus_tree: bool = True) -> DataFrame:
    """(doc_id, pos) of every block outside its page's main body, each once.

    `blocks` has (doc_id, pos, type, text, items); `docs` gives the URL of each page. Pages without URL, or not in `docs`, are judged by
    the corpus's tree alone. NULL and empty texts are kept; tables are never cut. An empty input gives no rows. Either tree can be switched off, to measure
    what it finds.
    """
    spark = blocks.sparkSession
    b = blocks.select(F.col(doc_id).alias("doc_id"), "pos", "type", "text", "items")
    hosts = docs.select(F.col(doc_id).alias("doc_id"), site_host(F.col(url)).alias("host")).groupBy("doc_id").agg(F.min("host").alias("host"))
    count = docs.select(doc_id).distinct().count()
    pages = stage(keyed_pages(b, hosts, common_words(b, max(LEAST, SHARE * count))), "pages")
    rows = _nodes(pages)
    shared = spark.sparkContext.broadcast(low_nodes(rows, count) if corpus_tree else {w: set() for w in "hpl"})
    kind = b.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        low = shared.value
        for x in batches:
            out_doc, out_pos = [], []
            for doc, nodes, *own in zip(*(x.column(i).to_pylist() for i in range(5))):
                at = cut_page(nodes, *(low[w] | set(k) if k else low[w] for w, k in zip("hpl", own)))
                out_doc += [doc] * len(at)
                out_pos += at
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, x.schema.field(0).type), pa.array(out_pos, pa.int32())], ["doc_id", "pos"])

    if host_tree:
        own = stage(host_nodes(rows, pages), "hosts")
        known = pages.where("host is not null").join(own, "host", "left").select("doc_id", "nodes", *"hpl")
    else:
        known = pages.where("host is not null").select("doc_id", "nodes", *[F.expr("cast(null as array<bigint>)").alias(w) for w in "hpl"])
    bare = pages.where("host is null").select("doc_id", "nodes", *[F.expr("cast(null as array<bigint>)").alias(w) for w in "hpl"])
    return known.unionByName(bare).mapInArrow(cut, f"doc_id {kind}, pos int").withColumnRenamed("doc_id", doc_id)


def main_text(blocks: DataFrame, furniture: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, main_text): each page's blocks outside `furniture`, in order, joined by line feeds; the empty text where none is left."""
    b = blocks.select(doc_id, "pos", "text").dropDuplicates([doc_id, "pos"]).join(furniture.withColumn("cut", F.lit(True)), [doc_id, "pos"], "left")
    lines = F.sort_array(F.collect_list(F.when(F.col("cut").isNull() & F.col("text").isNotNull(), F.struct("pos", "text"))))
    return b.groupBy(doc_id).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("main_text"))
