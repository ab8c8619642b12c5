"""Problem 8: vector bin packing of items into containers of fixed capacity.

Every item has three sizes: tokens, segments (one each) and loss-bearing tokens, those after the
leading comment header, which serves as the prompt. A container must respect all three limits, and each of them
decides for some containers: short items run out of segments, items without header out of loss-bearing tokens, others out of tokens.
The dot-product heuristic fills one container at a time with the fitting item whose sizes align best
with the room left (weights are the mean demand on each limit). Items of equal sizes are one class with a count, and classes
are kept in order of tokens, so that those which no longer fit are cut off by bisection.

Items are hashed into shards of about SHARD items, each packed by itself; the number of shards
follows the number of items, so the time and memory of a shard don't grow. Containers left under-filled are
dissolved and their items packed again together, in far fewer shards.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpage.llm.tokens import NAME, TOKENIZERS, encoder
from lumenpage.sources import ship_package, stage

CAPACITY, SEGMENTS, LOSS = 4096, 32, 4080
SHARD = 2048
TASKS = 20_000  # most tasks of a step; more shards than that share tasks
GOOD_FILL = 0.985

HEADER = re.compile(r"﻿?(?:[ \t]*(?://|#|/\*|\*|--|<!--|;;)[^\n]*(?:\n|$)|[ \t\r]*\n)*")


def item_sizes(df: DataFrame, rec_id: str, text: str, path: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(rec_id, tokens, prompt_tokens) of every record once. NULL and empty texts have 0 tokens."""
    ship_package(df.sparkSession)

    def measure(batches):
        enc = encoder(path, name)
        for b in batches:
            tokens, prompt = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                header = HEADER.match(t).group()
                tokens.append(len(enc.encode_ordinary(t)))
                prompt.append(min(tokens[-1], len(enc.encode_ordinary(header)) if header else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(prompt, pa.int64())], ["rec", "tokens", "prompt"])

    kind = df.schema[rec_id].dataType.simpleString()
    sized = df.select(F.col(rec_id).alias("rec"), F.col(text).alias("t")).mapInArrow(measure, f"rec {kind}, tokens bigint, prompt bigint")
    return sized.dropDuplicates(["rec"]).select(F.col("rec").alias(rec_id), "tokens", F.col("prompt").alias("prompt_tokens"))


def as_items(sizes: DataFrame, rec_id: str, capacity: int, loss: int) -> DataFrame:
    """(rec_id, part_no, start_token, tokens, loss_tokens): an item for each record that fits, and for one that exceeds the capacity
    (in tokens or loss-bearing tokens) as few consecutive parts as fit. Records of 0 tokens are one item of size 0."""
    step = min(capacity, loss)
    over = (F.col("tokens") > capacity) | (F.col("tokens") - F.col("prompt_tokens") > loss)
    parts = F.when(over, F.ceil(F.col("tokens") / step)).otherwise(F.lit(1))
    rows = sizes.select(rec_id, "tokens", "prompt_tokens", over.alias("over"), F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part_no"))
    start = F.col("part_no") * F.lit(step).cast("bigint")
    size = F.when(F.col("over"), F.least(F.lit(step).cast("bigint"), F.col("tokens") - start)).otherwise(F.col("tokens"))
    prompt = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("prompt_tokens") - start, size))
    return rows.select(rec_id, "part_no", start.alias("start_token"), size.alias("n_tokens"), (size - prompt).alias("loss_tokens"))


def dot_product_pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of each item; sizes is items x limits, whole numbers. Each item must fit alone."""
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)  # in order of the first size
    members = np.argsort(kind_of, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(kind_of, minlength=len(kinds)))])
    used = start[:-1].copy()
    need = kinds / limits
    weight = (sizes / limits).mean(axis=0) + 1e-9
    live = np.arange(len(kinds))
    bins, number = np.full(len(sizes), -1), 0
    while len(live):
        room, pick, spent = np.ones(need.shape[1]), len(live) - 1, False
        while True:
            k = live[pick]
            bins[members[used[k]]] = number
            used[k] += 1
            spent |= used[k] == start[k + 1]
            room = room - need[k]
            top = np.searchsorted(need[live, 0], room[0] + 1e-12, "right")
            rest = live[:top]
            score = np.where((used[rest] < start[rest + 1]) & (need[rest] <= room + 1e-12).all(axis=1), need[rest] @ (weight * room), -1.0)
            if not len(score) or score.max() < 0:
                break
            pick = int(len(score) - 1 - np.argmax(score[::-1]))
        if spent:
            live = live[used[live] < start[live + 1]]
        number += 1
    return bins


def pack(items: DataFrame, rec_id: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, shard: int = SHARD) -> DataFrame:
    """items with `bin_id`, a container number unique over all shards. Items that are equal apart from their id go to any
    container; an empty input gives no rows. Every item keeps exactly one row."""
    ship_package(items.sparkSession)
    items = stage(items, "items")
    kind = items.schema[rec_id].dataType.simpleString()
    schema = f"{rec_id} {kind}, part_no int, start_token bigint, n_tokens bigint, loss_tokens bigint, bin_id bigint, fill double"
    limits = np.array([capacity, segments, loss], dtype=float)

    def packed(rows: DataFrame, level: int) -> DataFrame:
        shards = max(1, -(-rows.count() // shard))

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([rec_id, "part_no"], ignore_index=True)
            sizes = np.stack([pdf.n_tokens, np.ones(len(pdf)), pdf.loss_tokens], axis=1).astype(float)
            number = dot_product_pack(sizes, limits)
            used = np.zeros((number.max() + 1, 3))
            np.add.at(used, number, sizes)
            pdf["bin_id"] = (np.int64(level) << 60) + (np.int64(key[0]) << 24) + number
            pdf["fill"] = (used / limits).max(axis=1)[number]
            return pdf[[rec_id, "part_no", "start_token", "n_tokens", "loss_tokens", "bin_id", "fill"]]

        keyed = rows.withColumn("shard", F.pmod(F.xxhash64(rec_id, "part_no"), F.lit(shards))).repartition(min(2 * shards, TASKS), "shard")  # a number given is not coalesced
        return keyed.groupBy("shard").applyInPandas(one, schema)

    first = stage(packed(items, 0), "packed")
    again = first.where(F.col("fill") < GOOD_FILL).drop("bin_id", "fill")
    second = packed(again, 1)
    return first.where(F.col("fill") >= GOOD_FILL).unionByName(second).drop("fill")
