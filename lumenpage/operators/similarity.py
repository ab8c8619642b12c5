"""Similarities: TF-IDF cosine within a call's texts, and cosine of embeddings."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpage.config.lexicons import STOPWORDS
from lumenpage.sources import ship_package

WORDS, STOP = re.compile(r"\w{2,}"), frozenset(STOPWORDS)  # words of two or more letters or digits; grams are they and pairs of neighbours


def tfidf_similarity(passages: DataFrame, probes: DataFrame, call: list[str], passage: str, probe: str, text: str = "text") -> DataFrame:
    """(call..., passage, probe, sim) of every passage and probe of a call that share a gram; other pairs are 0.

    Each call's vocabulary, document frequencies and lengths are its own: its passages and probes together. tf is 1 + ln(count), idf is
    ln((1 + n) / (1 + df)) + 1, vectors have length 1. A call is the texts of one page with its probes, which bounds a group: its texts are brought together
    by one shuffle and compared in Arrow batches, since counts, frequencies and lengths as windows over exploded grams took ten times as long. NULL texts have
    no grams; calls without a probe give no rows.
    """
    ship_package(passages.sparkSession)
    row = lambda mark, no: F.concat(F.lit(mark), F.col(no).cast("string")).alias("tid")
    both = passages.select(*call, row("p", passage), F.lower(F.coalesce(text, F.lit(""))).alias("text")).unionByName(probes.select(*call, row("q", probe), F.lower(F.coalesce(text, F.lit(""))).alias("text")))
    calls = both.groupBy(*call).agg(F.collect_list(F.struct("tid", "text")).alias("texts")).where(F.exists("texts", lambda t: F.startswith(t["tid"], F.lit("q"))))
    kinds = [f"{c} {both.schema[c].dataType.simpleString()}" for c in call]
    k = len(call)

    def compare(batches):
        for b in batches:
            at, ps, qs, sims = [], [], [], []
            for i, texts in enumerate(b.column(k).to_pylist()):
                for p, q, sim in call_similarities([(t["tid"], t["text"]) for t in texts]):
                    at.append(i)
                    ps.append(p)
                    qs.append(q)
                    sims.append(sim)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(rows) for j in range(k)), pa.array(ps, pa.string()), pa.array(qs, pa.string()), pa.array(sims, pa.float64())], [*call, "__p", "__q", "sim"])

    dots = calls.mapInArrow(compare, ", ".join([*kinds, "__p string", "__q string", "sim double"]))
    types = dict(passages.dtypes)[passage], dict(probes.dtypes)[probe]
    return dots.select(*call, F.col("__p").cast(types[0]).alias(passage), F.col("__q").cast(types[1]).alias(probe), "sim").hint("merge")  # as many rows as texts, so never broadcast


def call_similarities(texts: list[tuple[str, str]]):
    """(passage, probe, similarity) of a call's passages, marked p, and probes, marked q, that share a gram."""
    counts = {}
    df: Counter = Counter()
    for tid, t in texts:
        w = [x for x in WORDS.findall(t) if x not in STOP]
        counts[tid] = c = Counter(w)
        c.update(f"{a} {b}" for a, b in zip(w, w[1:]))
        df.update(c.keys())
    n = len(texts) + 1
    idf = {g: math.log(n / (d + 1)) + 1 for g, d in df.items()}
    vectors = {tid: {g: (math.log(m) + 1) * idf[g] for g, m in c.items()} for tid, c in counts.items() if c}
    norms = {tid: math.sqrt(sum(x * x for x in v.values())) for tid, v in vectors.items()}
    for q, asked in vectors.items():
        if q[0] == "q":
            for p, v in vectors.items():
                if p[0] == "p" and (dot := sum(x * v[g] for g, x in asked.items() if g in v)):
                    yield p[1:], q[1:], min(1.0, dot / norms[p] / norms[q])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has length 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(0.0)


def sim_to_score(sim: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (sim - low) / (high - low) * 100))
