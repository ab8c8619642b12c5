"""Problem 7: token ids of a whole corpus by a public tokenizer, through a table of its distinct words.

Words are the pieces of the tokenizer's own splitting pattern; merges never cross them. Pass 1 counts
words in each partition and adds the counts up; each distinct word is encoded once. Pass 2 splits
again and puts ids in place: the most frequent words, HEAD at most, come from a broadcast table, the
others are joined back by (word) and (document, position). No word of the shuffled rest is as
frequent as one of the table, so that join has no hot key. Ids travel as two or four bytes each.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.sources import ship_package, stage

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
HEAD = 65_536  # entries of the broadcast word table
DECODE_TASKS = 240  # least partitions of lists to be decoded
FLUSH = 400_000  # distinct words a worker holds before it passes on its counts

# Fixed value: the splitting pattern published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for the standard library's faster matcher: on texts that are all ASCII, and on texts without the characters
# that it classifies otherwise (numbers that are no digits; information separators, which it takes for white space).
ASCII_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
WORD_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


@lru_cache(maxsize=1)
def _odd_characters() -> frozenset[str]:
    return frozenset("\x1c\x1d\x1e\x1f").union(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZERS, name: str = NAME):
    import tiktoken

    with open(f"{path}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _unicode_pattern():
    import regex

    return regex.compile(PATTERN)


_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def split_words(text: str) -> list[str]:
    """The words of a text in order; joined they give the text."""
    if text.isascii():
        return (_unicode_pattern() if _SEPARATORS.search(text) else ASCII_PATTERN).findall(text)
    if _odd_characters().isdisjoint(set(text)):
        return WORD_PATTERN.findall(text)
    return _unicode_pattern().findall(text)


def word_table(df: DataFrame, text: str, path: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(word, n, ids) of every distinct word of the column. NULL and empty texts have no words."""
    ship_package(df.sparkSession)

    def count(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for b in batches:
            for t in b.column(0):
                held.update(split_words(t.as_py()))
                if len(held) > FLUSH:
                    yield rows()
                    held.clear()
        yield rows()

    def encode(batches):
        piece = encoder(path, name)._encode_single_piece
        for b in batches:
            ids = [piece(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    counted = df.where(F.length(text) > 0).select(F.col(text).alias("t")).mapInArrow(count, "word string, n bigint")
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return total.mapInArrow(encode, "word string, n bigint, ids array<int>")


def encode_corpus(df: DataFrame, rec_id: str, text: str, path: str = TOKENIZERS, name: str = NAME, head: int = HEAD) -> DataFrame:
    """(rec_id, ids): the token ids of every text by the named tokenizer, without special tokens.

    Equal rows of a record give one row. An empty or NULL text has an empty list. A string that looks like a special
    token is ordinary text. `rec_id` identifies a record; texts may be of any length.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(rec_id).alias("rec"), F.col(text).alias("t"))
    words = stage(word_table(docs, "t", path, name), "words")
    bucket = F.floor(F.log2("n") * 64)  # a count falls into one of at most 4096 buckets
    sizes = sorted(((r.b, r.n) for r in words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    kept, least = 0, (sizes[0][0] + 1 if sizes else 0)
    for b, n in sizes:
        if kept + n > head:
            break
        kept, least = kept + n, b
    top = words.where(bucket >= least).collect()  # at most `head` words
    whole_table = not sizes or least == sizes[-1][0]
    known = spark.sparkContext.broadcast({r.word: tuple(r.ids) for r in top})
    del top

    def place(batches):
        """Ids of known words in place; the others as (position among ids, word)."""
        table = known.value
        for b in batches:
            recs, packed, at, missing = [], [], [], []
            for rec, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = split_words(t) if t else []
                got = list(map(table.get, ws))
                holes, lost = [], []
                if None in got:
                    n = 0
                    for i, g in enumerate(got):
                        if g is None:
                            holes.append(n)
                            lost.append(ws[i])
                            got[i] = ()
                        else:
                            n += len(g)
                recs.append(rec)
                packed.append(np.fromiter(chain.from_iterable(got), dtype="<u2" if small else "<i4").tobytes())
                at.append(holes)
                missing.append(lost)
            yield pa.RecordBatch.from_arrays(
                [pa.array(recs, b.schema.field(0).type), pa.array(packed, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(missing, pa.list_(pa.string()))], ["rec", "packed", "at", "missing"]
            )

    small = encoder(path, name).n_vocab <= 65_536
    kind = df.schema[rec_id].dataType.simpleString()
    placed = docs.mapInArrow(place, f"rec {kind}, packed binary, at array<int>, missing array<string>")

    def finish(batches):
        """Insert each found word's ids at its place."""
        for b in batches:
            out = []
            for packed, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                have = np.frombuffer(packed, dtype="<u2" if small else "<i4")
                if found:
                    found = sorted((f["no"], f["at"], f["ids"]) for f in found)
                    pieces, last = [], 0
                    for _, at, ids in found:
                        pieces += [have[last:at], np.asarray(ids, dtype=have.dtype)]
                        last = at
                    have = np.concatenate([*pieces, have[last:]])
                out.append(have.astype("int32"))
            flat = np.concatenate(out) if out else np.empty(0, "int32")
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype("int32")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], ["rec", "ids"])

    schema = f"rec {kind}, ids array<int>"
    if whole_table:  # the whole word table was broadcast
        whole = placed.dropDuplicates(["rec"]).select("rec", "packed", F.expr("cast(null as array<struct<no:int,at:int,ids:array<int>>>)").alias("found"))
        return whole.mapInArrow(finish, schema).withColumnRenamed("rec", rec_id)
    placed = stage(placed, "placed")
    rest = words.where(bucket < least).select("word", "ids")
    holes = placed.where(F.size("at") > 0).dropDuplicates(["rec"]).select("rec", F.posexplode(F.arrays_zip("at", "missing")).alias("no", "h"))
    found = (
        holes.select("rec", "no", "h.at", F.col("h.missing").alias("word"))
        .join(rest, "word")
        .groupBy("rec")
        .agg(F.collect_list(F.struct("no", "at", "ids")).alias("found"))
    )
    whole = placed.select("rec", "packed").dropDuplicates(["rec"]).join(found, "rec", "left").select("rec", "packed", "found")
    return whole.mapInArrow(finish, schema).withColumnRenamed("rec", rec_id)


def piece_table(spark: SparkSession, path: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, piece): the bytes of every id in hexadecimal; one row an id, so bounded by the vocabulary."""
    enc = encoder(path, name)
    return spark.createDataFrame([(i, enc.decode_single_token_bytes(i).hex()) for i in range(enc.n_vocab)], "id int, piece string")


def decode_corpus(df: DataFrame, rec_id: str, ids: str, path: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(rec_id, text): the text of every list of ids, by a join of ids with the tokenizer's pieces, which are broadcast. Lists are partitioned by record before
    they are exploded, so that pieces come together without another shuffle. An empty list gives the empty text, NULL gives NULL; equal rows
    of a record give one row; ids outside the vocabulary fail; bytes that are no UTF-8 become U+FFFD."""
    spark = df.sparkSession
    tasks = max(DECODE_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a number given is not coalesced: lists are small before they are exploded
    lists = df.select(F.col(rec_id).alias("rec"), F.col(ids).alias("ids")).repartition(tasks, "rec").dropDuplicates(["rec"])
    each = lists.select("rec", F.size("ids").alias("n"), F.posexplode_outer("ids").alias("pos", "id"))
    named = each.join(F.broadcast(piece_table(spark, path, name)), "id", "left")
    unknown = F.raise_error(F.concat(F.lit("no such token: "), F.col("id").cast("string")))
    piece = F.when(F.col("id").isNotNull(), F.coalesce("piece", unknown))
    whole = named.groupBy("rec").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("found"))
    joined = F.array_join(F.transform("found", lambda x: x["piece"]), "")
    return whole.select(F.col("rec").alias(rec_id), F.when(F.col("n") >= 0, F.make_valid_utf8(F.unhex(joined).cast("string"))).alias("text"))
