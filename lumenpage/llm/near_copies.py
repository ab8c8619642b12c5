"""Problem 2: near-duplicate records by deletion-variant signatures.

A record is the set of its word shingles. Records with equal sets form one class, of which one
representative goes on. Its signature is SEGMENTS segments of WIDTH minhash symbols. Two sets of
resemblance r differ in a symbol with probability 1 - r, so with few, short segments some segment
differs in at most one symbol: for r = 0.5 and the defaults all but 6 in 10,000 pairs have one,
and for r = 0.6 all but 1 in 100,000. Each segment is indexed under its WIDTH variants with one symbol
left out; an equality join on the variants finds every such pair, and the resemblance of the
full shingle sets decides. Symbols take the place of bits, since bits of sets that share
half of their shingles differ too often for any segment of useful length to survive.

Joins run on hashed variants, which are spread over all keys; a variant held by many representatives
is split by AQE's skew join. Copies never multiply candidates, since only representatives are joined.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpage.sources import ship_package, stage

SEGMENTS, WIDTH = 20, 4
WORDS, SIMILARITY, LEAST_WORDS = 5, 0.8, 1
SLACK = 0.22  # a pair goes on if the share of equal symbols is at least the threshold less this

WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
CACHE = 500_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(title: str | None, text: str | None, words: int, least_words: int, hashes: dict) -> np.ndarray | None:
    """The sorted 64-bit hashes of the record's different sequences of `words` words; None if it has too few words."""
    found = WORD.findall(f"{title or ''} {text or ''}".lower())
    if len(found) < max(words, least_words):
        return None
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    s = np.zeros(n, np.uint64)
    for k in range(words):
        s = _mixed(s * _M1 + h[k : k + n])
    return np.unique(s)


def _symbols(shingles: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    return ((shingles[None, :] * multipliers[:, None] + shifts[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32)


def sketches(df: DataFrame, rec_id: str, title: str, text: str, words: int, least_words: int) -> DataFrame:
    """(rec, set_key, n, symbols) of every record of at least `least_words` words."""
    ship_package(df.sparkSession)
    kind = df.schema[rec_id].dataType.simpleString()

    def sketch(batches):
        rng = np.random.default_rng(20)
        many = SEGMENTS * WIDTH
        multipliers, shifts = rng.integers(1, 1 << 63, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, many, dtype=np.uint64)
        hashes = _Hashes()
        for b in batches:
            recs, keys, sizes, symbols = [], [], [], []
            for rec, a, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = shingle_set(a, t, words, least_words, hashes)
                if s is not None:
                    recs.append(rec)
                    keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    sizes.append(len(s))
                    symbols.append(_symbols(s, multipliers, shifts).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(recs, b.schema.field(0).type), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(symbols, pa.binary())], ["rec", "set_key", "n", "symbols"])

    cols = df.select(F.col(rec_id).alias("rec"), F.col(title).alias("a"), F.col(text).alias("t"))
    return cols.mapInArrow(sketch, f"rec {kind}, set_key bigint, n int, symbols binary")


def _variants(reps: DataFrame) -> DataFrame:
    """(variant, rep) of every one-symbol-out variant of every segment."""

    def index(batches):
        for b in batches:
            m = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, SEGMENTS, WIDTH).astype(np.uint64)
            keys = np.empty((len(m), SEGMENTS, WIDTH), np.uint64)
            salt = np.arange(SEGMENTS, dtype=np.uint64)[None, :] * np.uint64(WIDTH)
            for out in range(WIDTH):
                h = np.broadcast_to(salt + np.uint64(out + 1), m.shape[:2]).copy()
                for k in range(WIDTH):
                    if k != out:
                        h = _mixed(h * _M1 + m[:, :, k])
                keys[:, :, out] = h
            many = SEGMENTS * WIDTH
            rep = b.column(0).take(pa.array(np.repeat(np.arange(len(m)), many)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), rep], ["variant", "rep"])

    kind = reps.schema["rep"].dataType.simpleString()
    return reps.select("rep", "symbols").mapInArrow(index, f"variant bigint, rep {kind}")


def _close_enough(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in at least that share of their symbols."""

    def compare(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, SEGMENTS * WIDTH) for i in (2, 3))
            yield b.filter(pa.array((x == y).mean(axis=1) >= least)).select(["a", "b"])

    kind = reps.schema["rep"].dataType.simpleString()
    left, right = (reps.select(F.col("rep").alias(c), F.col("symbols").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(compare, f"a {kind}, b {kind}")


def link_classes(df: DataFrame, rec_id: str, title: str, text: str, words: int = WORDS, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (rec, rep) of every record long enough, rep being the least record with the same set of
    shingles; links has (a, b, resemblance), a < b, of every pair of representatives found at or above `similarity`.

    NULL title or text counts as empty. Equal rows of a record count once. Records shorter than `least_words` or `words`
    words are in neither result.
    """
    kind = df.schema[rec_id].dataType.simpleString()
    sk = stage(sketches(df, rec_id, title, text, words, least_words), "sketches")
    reps = stage(sk.groupBy("set_key").agg(F.min("rec").alias("rep"), F.first("n").alias("n"), F.first("symbols").alias("symbols")), "classes")
    members = sk.select("rec", "set_key").distinct().join(reps.select("set_key", "rep"), "set_key").select("rec", "rep")
    v = _variants(reps)
    sides = [v.select("variant", F.col("rep").alias(c)) for c in "ab"]
    pairs = sides[0].join(sides[1], "variant").where("a < b").select("a", "b").distinct()
    close = stage(_close_enough(pairs, reps, similarity - SLACK), "candidates")
    wanted = close.select(F.col("a").alias("rec")).union(close.select("b")).distinct()

    def sets(batches):
        hashes = _Hashes()
        for b in batches:
            recs, out = [], []
            for rec, a, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = shingle_set(a, t, words, least_words, hashes)
                if s is not None:
                    recs.append(rec)
                    out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(recs, b.schema.field(0).type), pa.array(out, pa.list_(pa.int64()))], ["rec", "shingles"])

    cols = df.select(F.col(rec_id).alias("rec"), F.col(title).alias("a"), F.col(text).alias("t"))
    full = cols.join(wanted, "rec", "left_semi").mapInArrow(sets, f"rec {kind}, shingles array<bigint>").dropDuplicates(["rec"])
    left, right = (full.select(F.col("rec").alias(c), F.col("shingles").alias(f"x{c}")) for c in "ab")
    both = close.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("xa", "xb"))
    links = both.select("a", "b", (common / (F.size("xa") + F.size("xb") - common)).alias("resemblance")).where(F.col("resemblance") >= similarity)
    return members, links


def similar_pairs(df: DataFrame, rec_id: str, title: str, text: str, **limits) -> DataFrame:
    """(a, b), a < b, of every pair of records at or above the similarity, copies included."""
    members, links = link_classes(df, rec_id, title, text, **limits)
    members, links = stage(members, "members"), links.select("a", "b")
    x, y = members.select(F.col("rec").alias("x"), F.col("rep").alias("a")), members.select(F.col("rec").alias("y"), F.col("rep").alias("b"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    within = x.join(members.select(F.col("rec").alias("y"), F.col("rep").alias("a")), "a").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def least_reachable(edges: DataFrame) -> DataFrame:
    """(a, label): the least record reachable from each a over `edges`, which hold both directions of every link. In a round a
    record takes the least label beside it, its label hooks to that one too, and labels jump over their own labels, so the rounds grow
    with the logarithm of a chain's length. Each round is written to the shared folder, until nothing changes."""
    labels = stage(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("l"))
        beside = stage(labels.join(near, "a").select("a", "label", F.least("label", "l").alias("l")), "beside")
        hooks = beside.groupBy("label").agg(F.min("l").alias("h")).withColumnRenamed("label", "a")
        jumps = labels.select(F.col("a").alias("label"), F.col("label").alias("j"))
        jumped = beside.join(jumps, "label").select("a", F.least("l", "j").alias("l"), F.col("label").alias("was"))
        new = stage(jumped.join(hooks, "a", "left").select("a", F.least("l", "h").alias("label"), "was"), "labels")
        labels = new.select("a", "label")
        if new.where("label < was").limit(1).count() == 0:
            return labels


def similar_groups(df: DataFrame, rec_id: str, title: str, text: str, **limits) -> DataFrame:
    """(rec_id, class_id, n_links, group_id), one row per record long enough: its class of equal sets, the number of other classes linked
    to that class, and its group, the least record reachable over links."""
    members, links = link_classes(df, rec_id, title, text, **limits)
    members, links = stage(members, "members"), stage(links.select("a", "b"), "links")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    labels = least_reachable(edges)
    out = members.join(labels, members.rep == labels.a, "left").drop("a").join(degree, members.rep == degree.a, "left")
    return out.select(F.col("rec").alias(rec_id), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("label", "rep").alias("group_id"))
