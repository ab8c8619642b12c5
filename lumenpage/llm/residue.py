"""Problem 3: template residue, filler, error pages, crash output and script notices.

A record is judged by its units: title, error note, and the sentences of its lines, in windows of at most WINDOW tokens. A regularised
logistic model on hashed words, word pairs, placeholder shapes, words by field, and the lengths of unit and text, with features for a title
that the text repeats and for a sentence that is a line by itself, scores every unit of every record; a record with a unit above MARGIN is residue. Nothing else decides.

The model is fitted on weak labels. Marked are units with a placeholder shape, a general phrase or a programming language's stand-in for
nothing, and what the pages of several hosts say whose fetch failed. Not marked are sentences of
long pages that speak of such things in words for them (META), and all the rest. A marked phrase is also shown to the
model with the phrase left out, so that it learns the company such phrases keep and finds what no phrase names.
Fitting uses a bounded sample of labelled units drawn over all records by hash. Quality is measured on hosts that no
sampled unit came from, also for kinds of phrases that were withheld from fitting.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpage.functions.urls import site_host
from lumenpage.sources import ship_package, stage

MARKED, UNMARKED = 6_000, 36_000  # the most units of each label that a fit uses
SAMPLE = 16
BITS = 18
MARGIN = 1.75  # log-odds
L2 = 1e-4
FEW = 4  # windows that a feature must be in to count
WINDOW = 48
LONG = 600  # characters from which a page is long
SHORT_LINE = 200  # characters up to which a line is no paragraph
CACHE = 400_000

# Placeholder spellings of template languages, mail tools and format strings.
SHAPES = [
    ("braces", r"\{\{\{?\s*[\w.|]+\s*\}?\}\}"),
    ("dollar", r"\$\{[^}\s]{1,40}\}"),
    ("ruby", r"#\{[^}\s]{1,40}\}"),
    ("named", r"%\{\w+\}|%\(\w+\)[sd]"),
    ("percent", r"%[A-Z][A-Z_]*%"),
    ("double", r"\[\[\s*\w+\s*\]\]"),
    ("angles", r"<<\s*\w+\s*>>"),
    ("tag", r"<%=?[^%\n]{0,60}%>|\{%[^%\n]{0,60}%\}|<\?php[^\n]{0,60}"),
    ("merge", r"\*\|\w+\|\*"),
    ("under", r"__[A-Z][A-Z_]*__|@@\w+(?:@@)?|##\w+##|~~\w+~~"),
    ("curly", r"(?<![{$#%\w])\{[A-Za-z_0-9]+\}(?!\})"),
    ("square", r"\[(?!PDF|DOC|VIDEO|AUDIO|PHOTO|UPDATE)[A-Z]{2,}(?:[_ ][A-Z]+)*\](?!\])"),
    ("your", r"\[(?:[Yy]our|[Ii]nsert|copy to|TK|TBD|[Ee]nter)\b[^\]\n]{0,80}\]"),
    ("format", r"%[sd](?![\w%])"),
    ("object", r"\[object \w+\]"),
]
SHAPE = re.compile("|".join(f"(?P<{n}>{p})" for n, p in SHAPES))
SHAPE_HINT = re.compile(r"[{\[<&@_~]|%[A-Za-z({]|#[{#]|\*\|")

# General phrases of weak labels, by kind, and what programs print for nothing.
PHRASES = {
    "filler": r"lorem ipsum|\b(?:dummy|placeholder|filler|sample) (?:copy|text|content)\b|\b(?:text|title|headline|content|description) goes here|\badd (?:a|your) (?:sub)?(?:heading|title|text)\b|\basdf asdf\b|\bx{4,} x{3,}|\bclick edit to\b|\binsert [^.\n]{3,60} here\b|\bTODO:",
    "missing": r"\bpage not found\b|\bnot found on this server\b|\bpage (?:isn't|is no longer) available\b",
    "refused": r"\baccess denied\b|\btoo many requests\b",
    "broken": r"\bservice (?:temporarily )?unavailable\b|\binternal server error\b|\bbad gateway\b|\bsomething went wrong\b|\bdatabase connection\b",
    "crash": r"\bfatal error\b|\buncaught \w*(?:error|exception)|\btraceback \(most recent|\bexception in thread\b|\bundefined (?:array key|index|variable)\b|\bline \d+, in \w|\bat [\w.$]+\([\w.]+:\d+\)",
    "scripts": r"\b(?:enable|activate|requires?|turn on) (?:javascript|scripts?)\b|\bjavascript is (?:disabled|required|not enabled)\b",
}
# Of which every phrase above, in small letters, holds one, but for the lines of program stacks; and the spellings of nothing.
HOLDS = (
    "lorem ipsum", "dummy ", "placeholder ", "filler ", "sample ", " goes here", "add a ", "add your ", "add sub", "asdf asdf", "xxxx", "click edit to", "insert ", "todo:", "not found", "page isn't", "page is no longer",
    "access denied", "too many requests", "unavailable", "internal server", "bad gateway", "went wrong", "database connection", "fatal error", "uncaught ", "traceback", "exception in", "undefined ", " script", "javascript",
)
STACK = re.compile(r"\bline \d+, in \w|:\d+\)")
NONE = ("NaN", "null", "undefined", "nil", "None")
NOTHING = re.compile(r"(?<![\w'\"`‘“])(?:NaN|null|undefined|nil|None(?! of\b))(?![\w'\"`’”])")
ONLY_NOTHING = re.compile(r"\W*(?:none|null|nan|undefined|nil)\W*", re.I)

# Words for such things in text that writes about them.
META = re.compile(r"\b(?:placeholders?|variables?|tokens?|templates?|syntax|crawlers?|designers?|developers?|documented|messages?|keyboards?|markup|mail merge|in the script|means?|differ|instead of|enable|readers?|(?:sites|pages|apps|browsers) (?:that|which))\b", re.I)
QUOTED = re.compile(r"[\"“«„][^\"”»“\n]{3,120}[\"”»“]")  # what stands in quotation marks is told of

SPLIT = re.compile(r"(?<=[.!?。！？])\s+(?=\S)|(?<=[。！？])| ; ")
TOKEN = re.compile(r"§\w+|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]")


def phrase_pattern(withheld: tuple[str, ...] = ()) -> re.Pattern:
    """Any phrase of the kinds that are not withheld."""
    return re.compile("|".join(p for k, p in PHRASES.items() if k not in withheld), re.I)


def units(title: str | None, error: str | None, text: str | None) -> list[tuple[str, str]]:
    """(field, sentence) of a record: t title, e error note, x a line of one sentence or a short line, p a sentence of a paragraph."""
    found = [("t", title)] if title and title.strip() else []
    if error and error.strip():
        found.append(("e", error))
    for line in (text or "").split("\n"):
        parts = [u for u in SPLIT.split(line) if u and not u.isspace()]
        found += [("x" if len(parts) == 1 or len(line) <= SHORT_LINE else "p", u) for u in parts]
    return found


def tokens(unit: str) -> list[str]:
    """Words, numbers and marks in small letters; placeholder spellings as the names of their shapes, stand-ins for nothing as one."""
    if SHAPE_HINT.search(unit):
        unit = SHAPE.sub(lambda m: f" §any §{m.lastgroup} ", unit)
    if "N" in unit or "n" in unit:
        unit = NOTHING.sub(" §nothing ", unit)
    return TOKEN.findall(unit.lower())


class _Hashes(dict):
    """32-bit hashes of tokens, all numbers alike, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[token] = xxhash.xxh32_intdigest("0" if token[0].isdigit() else token)
        return h


_START, _END = 0x51ED270B, 0x2545F491
_M = np.uint32(0x9E3779B1)


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a * _M) ^ (np.asarray(b, np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
    return ((x ^ (x >> np.uint32(15))) * _M) >> np.uint32(32 - BITS)


def features(rows: list[tuple[str, str, str | None, int]], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, owner, row) of every window of every unit; rows are (field, unit, the record's title, characters of its text). owner counts windows,
    and row gives the row of each."""
    stream: list[int] = []
    first: list[int] = []
    of_row: list[int] = []
    extra: list[tuple[int, int, int]] = []
    for i, (field, unit, title, chars) in enumerate(rows):
        toks = tokens(unit)
        told = 1 if field == "x" and title and unit == title else 0
        size = min(4, chars // 300)
        for k in range(0, max(len(toks), 1), WINDOW):
            part = toks[k : k + WINDOW]
            first.append(len(stream))
            of_row.append(i)
            stream.append(_START)
            stream.extend(map(hashes.__getitem__, part))
            stream.append(_END)
            extra.append((ord(field), min(len(part), 40) // 4, 8 * size + told))
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    s, starts = np.array(stream, np.uint32), np.array(first)
    window = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
    field, length, page = np.array(extra, np.uint32).T
    inside = (s != _START) & (s != _END)
    pair = np.flatnonzero(s[:-1] != _END)
    parts = [
        (_mix(s[inside], 1), window[inside]), (_mix(s[inside], field[window[inside]] * np.uint32(131)), window[inside]), (_mix(s[pair], s[pair + 1]), window[pair]),
        (_mix(field, 7), np.arange(len(starts))), (_mix(length, field + np.uint32(1000)), np.arange(len(starts))), (_mix(page, field + np.uint32(2000)), np.arange(len(starts))),
    ]
    return np.concatenate([f for f, _ in parts]).astype(np.int64), np.concatenate([w for _, w in parts]), np.array(of_row)


@dataclass
class Model:
    """A fitted linear model and its bias."""

    weights: np.ndarray
    bias: float

    def scores(self, rows: list[tuple[str, str, str | None, int]], hashes: _Hashes | None = None) -> np.ndarray:
        """The greatest log-odds over the windows of each row."""
        f, w, row = features(rows, hashes if hashes is not None else _Hashes())
        out = np.full(len(rows), -np.inf)
        if len(row):
            np.maximum.at(out, row, np.bincount(w, self.weights[f], len(row)) + self.bias)
        return out


def fit(labelled: list[tuple[str, str, str | None, int, int]], steps: int = 600) -> Model:
    """Logistic regression with an L2 penalty, by full-batch AdaGrad, on (field, unit, title, characters, label); classes weigh the same. Without marked
    units nothing passes."""
    y = np.array([x[-1] for x in labelled], dtype=float)
    if not y.sum() or y.all():
        return Model(np.zeros(1 << BITS, np.float32), -10.0)
    flat, owner, row = features([x[:-1] for x in labelled], _Hashes())
    y = y[row]
    used, flat, many = np.unique(flat, return_inverse=True, return_counts=True)
    often = many >= FEW  # a feature of few units would only learn them by heart
    w, b, gw, gb = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    weight = np.where(y == 1, 0.3 / y.sum(), 0.7 / (len(y) - y.sum())) * 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(y)) + b, -30, 30)))
        e = (p - y) * weight
        g = np.where(often, np.bincount(flat, e[owner], len(used)) + L2 * w, 0.0)
        gw += g * g
        gb += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.5 * e.sum() / np.sqrt(gb)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def may_hold(*fields: str | None) -> bool:
    """False only if no unit of the fields holds a shape, a phrase or a stand-in for nothing."""
    for v in fields:
        if v:
            low = v.lower()
            if any(k in low for k in HOLDS) or (any(k in v for k in NONE) and NOTHING.search(v)) or (SHAPE_HINT.search(v) and SHAPE.search(v)) or (((", in " in low and "line " in low) or ("(" in v and ":" in v)) and STACK.search(low)):
                return True
            if len(v) < 20 and ONLY_NOTHING.fullmatch(v):
                return True
    return False


def weak_labels(title: str | None, error: str | None, text: str | None, ok: bool | None, phrases: re.Pattern) -> list[tuple[str, str, int]]:
    """(field, unit, label) of a record: 1 marked, 3 marked by a phrase, 2 said by a page whose fetch failed, 0 not marked, 4 not marked though it names such things,
    -1 not known."""
    has = may_hold(title, error, text)
    long = len(text or "") >= LONG and ok is not False
    out, about = [], False
    failed = ok is False and not (error and error.strip())
    for f, u in units(title, error, text):
        label = 0
        if has:
            shape, phrase = SHAPE_HINT.search(u) and SHAPE.search(u), phrases.search(u)
            if shape or phrase or NOTHING.search(u) or (f == "t" and ONLY_NOTHING.fullmatch(u)):
                rest = phrases.sub(" ", SHAPE.sub(" ", u))
                prose = f == "p" and (META.search(rest) or (phrase and not shape))  # a notice or filler stands by itself, what is told of them stands in a paragraph
                told = phrase and not shape and not phrases.search(QUOTED.sub(" ", u))
                if prose or (f == "x" and (told or META.search(rest))):
                    label = 4 if long else -1
                    about = about or long
                elif f == "t" and phrase and not shape and long:
                    label = 4 if META.search(rest) or about_words(rest) else -1
                else:
                    label = 3 if phrase and not shape else 1
        if failed and f != "e" and not label:
            label = 2 if f in "xp" else -1
        out.append((f, u, label))
    if about:  # such things are the text's subject, so its title names them
        out = [(f, u, 4 if f == "t" else label) for f, u, label in out]
    return out


def about_words(rest: str) -> bool:
    """Whether a title says something besides the phrase it names: three words or more."""
    return len(rest.split()) >= 3


def labelled_units(df: DataFrame, title: str, text: str, error: str, ok: str, url: str, withheld: tuple[str, ...] = ()) -> DataFrame:
    """(field, unit, title, chars, label, host): every marked unit, the unmarked ones that name such things, and all unmarked ones of one record in
    SAMPLE, drawn by hash; each spelling once a host."""
    ship_package(df.sparkSession)
    fields = ("field", "unit", "title", "chars", "label", "host")

    def label(batches):
        phrases = phrase_pattern(withheld)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t, x, e, good, host in zip(*(b.column(i).to_pylist() for i in range(5))):
                drawn = xxhash.xxh32_intdigest(f"{host} {x}") < 2**32 // SAMPLE
                if not drawn and good is not False and not e and not may_hold(t, x):
                    continue  # no unit of it would be used
                for f, u, mark in weak_labels(t, e, x, good, phrases):
                    if mark > 0 or (mark == 0 and (drawn or f == "e")):
                        for c, v in zip(out, (f, u, t if t == u else None, len(x or ""), mark % 4, host)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], list(fields))

    cols = df.select(F.col(title).alias("t"), F.col(text).alias("x"), F.col(error).alias("e"), F.col(ok).alias("g"), F.coalesce(site_host(F.col(url)), F.lit("")).alias("h"))
    rows = cols.mapInArrow(label, "field string, unit string, title string, chars int, label int, host string")
    rows = stage(rows.groupBy("field", "unit", "label", "host").agg(F.max("title").alias("title"), F.min("chars").alias("chars")), "units")
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("unit"), r"\"[^\"]*\"", '"'), r"/\S+", "/"), "[0-9]+", "0")
    shared = rows.where("label = 2").groupBy(folded.alias("__u")).agg(F.count_distinct("host").alias("n")).where("n >= 2").select("__u")
    usual = rows.where("label = 0 and field in ('x', 'p')").select(folded.alias("__u")).distinct()  # navigation and the like, which pages that were read hold too
    said = rows.where("label = 2").withColumn("__u", folded).join(shared, "__u", "left_semi").join(usual, "__u", "left_anti").drop("__u")
    notes = rows.where("label = 0 and field = 'e'").withColumn("__u", folded).join(shared, "__u", "left_anti").drop("__u")  # what pages say too is no collector's note
    return rows.where("label <> 2 and not (label = 0 and field = 'e')").unionByName(notes).unionByName(said)


def bounded(labels: DataFrame, marked: int = MARKED, unmarked: int = UNMARKED) -> list[tuple[str, str, str | None, int, int]]:
    """At most about `marked` and `unmarked` units, drawn by hash over all of them."""
    n = {r.m: r.n for r in labels.groupBy((F.col("label") > 0).alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    again = F.pmod(F.xxhash64("unit", "host"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") > 0, min(1.0, marked / max(1, n.get(True, 0)))).otherwise(min(1.0, unmarked / max(1, n.get(False, 0))))
    rows = labels.where(again < share).select("field", "unit", "host", "title", "chars", "label").collect()
    return [(r.field, r.unit, r.title, r.chars, r.label) for r in sorted(rows, key=lambda r: (r.field, r.unit, r.host, r.label))]


def lessons(rows: list[tuple[str, str, str | None, int, int]], withheld: tuple[str, ...] = ()) -> list[tuple[str, str, str | None, int, int]]:
    """What a model is fitted on: the units, those marked by a phrase again without it, if four words are left, and those
    that only speak of such things again as the line of a short page."""
    phrases = phrase_pattern(withheld)
    out = []
    for f, u, t, n, label in rows:
        out.append((f, u, t, n, int(label > 0)))
        if label == 3 and len((rest := phrases.sub(" ", u)).split()) >= 4:
            out.append((f, rest, t and rest, n, 1))
        elif label == 0 and ((SHAPE_HINT.search(u) and SHAPE.search(u)) or phrases.search(u)):
            out.append(("x", u, None, len(u), 0))
    return out


def fit_model(df: DataFrame, title: str = "title", text: str = "text", error: str = "error", ok: str = "ok", url: str = "url") -> Model:
    return fit(lessons(bounded(labelled_units(df, title, text, error, ok, url))))


def held_out_quality(df: DataFrame, withheld: tuple[str, ...] = (), title: str = "title", text: str = "text", error: str = "error", ok: str = "ok", url: str = "url") -> dict[str, float]:
    """Precision and recall against the weak labels of units on a fifth of the hosts, by a model fitted on the others. Kinds of phrases that are `withheld` mark
    nothing in fitting; recall then is that of the units which only they mark."""
    fold = F.pmod(F.xxhash64("host"), F.lit(5))
    labels = labelled_units(df, title, text, error, ok, url)
    model = fit(lessons(bounded((labelled_units(df, title, text, error, ok, url, withheld) if withheld else labels).where(fold != 0)), withheld))
    test = bounded(labels.where(fold == 0))
    if withheld:
        others = phrase_pattern(withheld)
        test = [x for x in test if x[-1] == 0 or (x[-1] == 3 and not others.search(x[1]) and not NOTHING.search(x[1]))]
    said = model.scores([x[:-1] for x in test]) > MARGIN
    true = np.array([x[-1] > 0 for x in test], bool)
    hit = int((said & true).sum())
    return {"units": len(test), "marked": int(true.sum()), "precision": hit / max(1, int(said.sum())), "recall": hit / max(1, int(true.sum()))}


def find_residue(df: DataFrame, rec_id: str, model: Model, title: str = "title", text: str = "text", error: str = "error") -> DataFrame:
    """(rec_id) of every record with residue in title, text or error, once. NULL and empty fields have no units."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^BITS weights
    kind = df.schema[rec_id].dataType.simpleString()

    def judge(batches):
        m, hashes = shared.value, _Hashes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, owner = [], []
                for i, (t, e, x) in enumerate(zip(*(part.column(j).to_pylist() for j in (1, 2, 3)))):
                    n = len(x or "")
                    for f, u in units(t, e, x):
                        rows.append((f, u, t, n))
                        owner.append(i)
                best = np.full(part.num_rows, -np.inf)
                if rows:
                    np.maximum.at(best, np.array(owner), m.scores(rows, hashes))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(best > MARGIN))], ["rec"])

    cols = df.select(F.col(rec_id).alias("rec"), F.col(title).alias("t"), F.col(error).alias("e"), F.col(text).alias("x"))
    return cols.mapInArrow(judge, f"rec {kind}").distinct().withColumnRenamed("rec", rec_id)
