"""Problem 9: texts over a limit, cut into pieces at natural boundaries, with overlap.

Texts are split into ranges of RANGE characters before any worker sees them, so no step needs a whole file. A worker sees one range and
a halo, starts at a place where words of the tokenizer surely begin, and lists the range's boundaries: top-level blank lines,
blank lines, line starts, sentence ends, word ends, and, within words of very many tokens, token ends.
The boundary tables of SPAN ranges are stitched, and a running sum of the lengths gives every boundary
its offset in tokens. Cuts are chosen along a span from window to window, with about as few pieces as can be; a text longer than a span is
also cut where spans meet. Pieces are then put together from the ranges they touch, by offset.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenpage.llm.tokens import NAME, TOKENIZERS, encoder, split_words
from lumenpage.sources import ship_package, stage

LIMIT, OVERLAP = 1024, 64
RANGE, HALO = 65_536, 512
SPAN = 64  # ranges whose boundaries one task sees together
GAP = 24  # tokens after which a boundary is listed even in text that has none by nature
RESERVE = 4  # tokens kept free, since a cut can change how the white space around it is split
EXTRA = 0.02  # share by which the pieces may outnumber the least number for the sake of better cuts
KINDS = ("token", "word", "sentence", "line", "blank line", "section")

SYNC = re.compile(r"(?<=\S)(?=\s)")
SENTENCE = re.compile(r"[.!?。！？][\"'”’»)\]]*(?:\s+|(?<=[。！？]))")
LINE = re.compile(r"\n([ \t\r]*\n)*")
CACHE = 300_000


def _takes_over(part: str) -> int:
    """Where the range that starts with `part` takes over from the one before: the first place within the halo where a
    word of the tokenizer surely begins, else the halo's end. Both ranges see the same halo."""
    m = SYNC.search(part, 1, min(len(part), HALO))
    return m.start() if m else min(len(part), HALO)


class _Lengths(dict):
    """Tokens of a word, remembered up to a bound."""

    def __init__(self, enc):
        super().__init__()
        self.piece = enc._encode_single_piece

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[word] = len(self.piece(word)) if len(word) <= 256 else self.long(word)
        return n

    def long(self, word: str) -> int:
        return sum(len(self.piece(word[i : i + 4096])) for i in range(0, len(word), 4096))


def boundaries(chunk: str, lengths: _Lengths, enc) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(cost, positions, costs before them, kinds) of one range, which starts and ends at word starts."""
    words = split_words(chunk)
    size = np.fromiter(map(len, words), np.int64, len(words))
    cost = np.fromiter(map(lengths.__getitem__, words), np.int64, len(words))
    ends, cum = np.cumsum(size), np.cumsum(cost)
    total = int(cum[-1]) if len(words) else 0
    if not total:
        return 0, *(np.empty(0, np.int64),) * 3
    at: list[np.ndarray] = []
    kind: list[np.ndarray] = []
    lines = [(m.end(), (4 + (m.end() < len(chunk) and not chunk[m.end()].isspace())) if m.group(1) is not None else 3) for m in LINE.finditer(chunk)]
    ends_s = [m.end() for m in SENTENCE.finditer(chunk)]
    every = np.flatnonzero(np.diff(cum // GAP, prepend=0))
    for p, k in ((np.array([x for x, _ in lines], np.int64), np.array([k for _, k in lines], np.int64)), (np.array(ends_s, np.int64), np.full(len(ends_s), 2)), (ends[every], np.full(len(every), 1))):
        at.append(p)
        kind.append(k)
    starts, before = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], cum[:-1]])
    inner_at, inner_cost = [], []
    for i in np.flatnonzero(cost > GAP):  # a word of many tokens: cut between tokens, or between characters
        w, step = words[i], max(1, int(size[i] * GAP // cost[i]))
        places = list(range(step, len(w), step))
        inner_at += [starts[i] + x for x in places]
        inner_cost += [before[i] + x * cost[i] // len(w) for x in places]
    pos, kinds = np.concatenate(at), np.concatenate(kind)
    n = np.searchsorted(starts, pos, "left")
    costs = np.where(n > 0, cum[np.maximum(n, 1) - 1], 0)
    pos, kinds, costs = np.concatenate([pos, np.array(inner_at, np.int64)]), np.concatenate([kinds, np.zeros(len(inner_at), np.int64)]), np.concatenate([costs, np.array(inner_cost, np.int64)])
    order = np.lexsort((-kinds, pos))
    pos, kinds, costs = pos[order], kinds[order], costs[order]
    keep = np.concatenate([[True], np.diff(pos) > 0]) & (pos > 0)
    return total, pos[keep], costs[keep], kinds[keep]


def text_ranges(df: DataFrame, rec_id: str, text: str, chunk: int) -> DataFrame:
    """(rec, range_no, chars, part) of every range of every text, each once; part has a halo at its end. Made by the engine: long texts are first split
    into stretches of 256 ranges, so that finding an offset never walks through a whole file."""
    base = df.select(F.col(rec_id).alias("rec"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("chars", F.length("t").cast("bigint"))
    short = base.where(F.col("chars") <= chunk).select("rec", F.lit(0).alias("range_no"), "chars", F.col("t").alias("part"))
    many = lambda n, size: F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)
    wide = 256 * chunk
    far = base.where(F.col("chars") > chunk).select("rec", "chars", "t", F.explode(many(F.col("chars"), wide)).alias("w"))
    far = far.select("rec", "chars", "w", F.substring("t", F.col("w") * wide + 1, F.lit(wide + HALO)).alias("t"))
    far = far.select("rec", "chars", "w", "t", F.explode(many(F.least(F.length("t"), F.col("chars") - F.col("w").cast("bigint") * wide, F.lit(wide)), chunk)).alias("r"))
    far = far.select("rec", (F.col("w") * 256 + F.col("r")).alias("range_no"), "chars", F.substring("t", F.col("r") * chunk + 1, F.lit(chunk + HALO)).alias("part"))
    return short.unionByName(far).dropDuplicates(["rec", "range_no"])


def boundary_table(ranges: DataFrame, limit: int, path: str = TOKENIZERS, name: str = NAME, chunk: int = RANGE) -> DataFrame:
    """ranges with (cost, pos, cum, kind): the range's tokens and its boundaries, of which a text that is one range within the limit needs none."""
    ship_package(ranges.sparkSession)
    kind = ranges.schema["rec"].dataType.simpleString()

    def detect(batches):
        enc = encoder(path, name)
        lengths = _Lengths(enc)
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            for no, chars, part in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                at = no * chunk
                first = 0 if no == 0 else _takes_over(part)
                last = len(part) if at + chunk >= chars else chunk + _takes_over(part[chunk:])
                cost, pos, cum, kinds = boundaries(part[first:last], lengths, enc)
                if chars <= chunk and cost <= limit:
                    pos = cum = kinds = ()
                elif no:  # where this range takes over is a boundary too
                    pos, cum, kinds = (np.concatenate([[x], y]) for x, y in ((0, pos), (0, cum), (1, kinds)))
                for c, v in zip(cols, (cost, pos + (at + first) if len(pos) else [], cum, kinds)):
                    c.append(v)
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *(pa.array(c, t) for c, t in zip(cols, types))], ["rec", "range_no", "chars", "part", "cost", "pos", "cum", "kind"])

    return ranges.mapInArrow(detect, f"rec {kind}, range_no int, chars bigint, part string, cost bigint, pos array<bigint>, cum array<bigint>, kind array<tinyint>")


def cut_span(pos: np.ndarray, cum: np.ndarray, kind: np.ndarray, total: int, room: int, body: int) -> list[int]:
    """Numbers of the boundaries at which a span of `total` tokens is cut into pieces of at most `body` tokens, the first of at most `room`. A cut is the last
    one of the best kind in a window before the piece is full; the windows share the tokens that the least number of pieces leaves free."""
    cuts: list[int] = []
    done, at = 0, 0
    while total - done > room and at < len(pos):
        left = total - done
        rest = -(-(left - room) // body)
        free = room + rest * body - left + int(EXTRA * left)
        width = min(room // 3, free, max(2 * GAP, 2 * free // rest))
        low, high = np.searchsorted(cum, done + room - width, "left"), np.searchsorted(cum, done + room, "right")
        low = max(int(low), at)
        if high <= low:  # no boundary in the window: the nearest one before it, else the next one after
            i = max(int(high) - 1, at)
        else:
            i = int(high) - 1 - int(np.argmax(kind[low:high][::-1]))
        cuts.append(i)
        done, at, room = int(cum[i]), i + 1, body
    return cuts


def plan_pieces(table: DataFrame, limit: int, overlap: int, chunk: int = RANGE) -> DataFrame:
    """(rec, chars, piece_no, start, until, kind): the pieces of every text over the limit; a text of several ranges within the limit is one piece."""
    body = limit - overlap - RESERVE
    rec = table.schema["rec"].dataType.simpleString()
    w = Window.partitionBy("rec")
    cut = table.where((F.col("chars") > chunk) | (F.col("cost") > limit)).select("rec", "range_no", "chars", "cost", "pos", "cum", "kind")
    cut = cut.withColumn("total", F.sum("cost").over(w))
    span = F.floor(F.col("range_no") / SPAN).cast("int")
    spans = cut.groupBy("rec", span.alias("span")).agg(F.first("chars").alias("chars"), F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("range_no", "cost", "pos", "cum", "kind"))).alias("ranges"))

    def choose(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for r, no, chars, total, ranges in zip(*(b.column(i).to_pylist() for i in range(5))):
                sizes = [x["cost"] for x in ranges]
                base = np.cumsum([0, *sizes])
                pos = np.concatenate([np.array(x["pos"], np.int64) for x in ranges])
                cum = np.concatenate([np.array(x["cum"], np.int64) + c for x, c in zip(ranges, base)])
                kind = np.concatenate([np.array(x["kind"], np.int8) for x in ranges])
                cuts = [] if total <= limit else cut_span(pos, cum, kind, int(base[-1]), limit - RESERVE if no == 0 else body, body)
                starts, kinds = [int(pos[i]) for i in cuts], [int(kind[i]) for i in cuts]
                if no == 0:
                    starts, kinds = [0, *starts], [5, *kinds]
                elif total > limit:  # the place where this span takes over
                    starts, kinds = [int(pos[0]), *starts], [1, *kinds]
                for c, v in zip(out, (r, no, chars, starts, kinds)):
                    c.append(v)
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["rec", "span", "chars", "starts", "kinds"])

    chosen = spans.select("rec", "span", "chars", "total", "ranges").mapInArrow(choose, f"rec {rec}, span int, chars bigint, starts array<bigint>, kinds array<tinyint>")
    each = chosen.select("rec", "chars", F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("kinds").alias("kind"))).alias("p")).select("rec", "chars", "p.start", "p.kind")
    order = Window.partitionBy("rec").orderBy("start")
    return each.select("rec", "chars", (F.row_number().over(order) - 1).alias("piece_no"), "start", F.coalesce(F.lead("start").over(order), "chars").alias("until"), "kind")


def cut_pieces(df: DataFrame, rec_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZERS, name: str = NAME, chunk: int = RANGE) -> DataFrame:
    """(rec_id, piece_no, part, start_char, end_char, overlap_chars, n_tokens, cut_at, text): every text as ordered pieces of
    at most `limit` tokens, each beginning with the last whole words, at most `overlap` tokens, of the one before.

    A text within the limit is one piece, whatever its length in characters; an empty or NULL text is one empty piece. The texts of all pieces, each without
    its first overlap_chars characters, joined in order of (piece_no, part) give the text. Part is 0 unless a cut raised a piece's
    tokens over the limit by more than the reserve and the overlap; it is then cut again near its middle. Equal rows of a record give one set of pieces.
    """
    kind = df.schema[rec_id].dataType.simpleString()
    back = 8 * overlap
    table = stage(boundary_table(text_ranges(df, rec_id, text, chunk), limit, path, name, chunk), "boundaries")
    long = lambda c: F.lit(c).cast("bigint")
    fits = table.where((F.col("chars") <= chunk) & (F.col("cost") <= limit))
    whole = fits.select("rec", F.lit(0).alias("piece_no"), F.lit(0).alias("part"), long(0).alias("start_char"), F.col("chars").alias("end_char"), F.lit(0).alias("overlap_chars"), F.col("cost").cast("int").alias("n_tokens"), F.lit(KINDS[5]).alias("cut_at"), F.col("part").alias("text"))

    plan = plan_pieces(table, limit, overlap, chunk).withColumn("low", F.greatest(F.col("start") - back, F.lit(0)))
    touched = F.sequence(F.floor(F.col("low") / chunk).cast("int"), F.floor(F.greatest(F.col("until") - 1, F.col("low")) / chunk).cast("int"))
    jobs = plan.select("*", F.size(touched).alias("many"), F.explode(touched).alias("range_no"))
    parts = table.where((F.col("chars") > chunk) | (F.col("cost") > limit)).select("rec", "range_no", "part")
    here = F.greatest(F.col("low") - F.col("range_no").cast("bigint") * chunk, F.lit(0))
    there = F.least(F.col("until") - F.col("range_no").cast("bigint") * chunk, F.lit(chunk))
    slices = jobs.join(parts, ["rec", "range_no"]).withColumn("slice", F.substring("part", (here + 1).cast("int"), (there - here).cast("int"))).drop("part", "chars")
    one = slices.where("many = 1").select("rec", "piece_no", "start", "low", "kind", F.col("slice").alias("t"))
    more = slices.where("many > 1").groupBy("rec", "piece_no", "start", "low", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range_no", "slice"))), lambda x: x["slice"]), "").alias("t"))

    def emit(batches):
        enc = encoder(path, name)
        count = lambda s: len(enc.encode_ordinary(s))
        lengths = _Lengths(enc)
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for rec, no, start, low, how, t in zip(*(b.column(i).to_pylist() for i in range(6))):
                at = start - low
                lead = 0
                if no and overlap:
                    room = overlap
                    for w in reversed(split_words(t[:at])):
                        room -= lengths[w]
                        if room < 0:
                            break
                        lead += len(w)
                spans, part = [(at, len(t))], 0
                while spans:
                    a, z = spans.pop(0)
                    head = lead if part == 0 else 0
                    n = count(t[a - head : z])
                    while n > limit and head:
                        head = 0 if head < 8 else head // 2
                        n = count(t[a - head : z])
                    if n > limit and z - a > 1:
                        mid = _middle(t[a:z]) + a
                        spans[:0] = [(a, mid), (mid, z)]
                        continue
                    for c, v in zip(out, (rec, no, part, low + a - head, low + z, head, n, KINDS[how] if part == 0 else KINDS[1], t[a - head : z])):
                        c.append(v)
                    part += 1
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in fields])

    fields = [f"rec {kind}", "piece_no int", "part int", "start_char bigint", "end_char bigint", "overlap_chars int", "n_tokens int", "cut_at string", "text string"]
    made = one.unionByName(more).mapInArrow(emit, ", ".join(fields))
    return whole.unionByName(made).withColumnRenamed("rec", rec_id)


def _middle(t: str) -> int:
    """The last line or word end in the first half of a piece, else the half itself."""
    half = len(t) // 2
    return max(t.rfind("\n", 0, half), t.rfind(" ", 0, half)) + 1 or half
