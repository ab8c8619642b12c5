"""Problem 1: text decoded with an encoding that was not its own.

A wrongly decoded stretch is a substitution cipher: each symbol, a character or the run of characters
that the bytes of one letter turned into, stands for one letter. Which swap of code pages made it is unknown. It is undone in two steps.

Swaps between listed code pages are weighed first, over the whole corpus: expectation-maximisation learns, from all
distinct stretches, the bigrams of the corpus's languages and how common each swap is. Each of these swaps leaves one letter to a
symbol, so nothing is to be learned about letters there. A stretch is garbled if some swap explains it
better than none does, given how much of its source (host of a page, label of an answer) is garbled.

What no listed swap explains and no other source spells is a cipher of its source. For every source that has such stretches, expectation-maximisation learns
which letter each symbol stands for: all letters of a script are candidates, weighted by the bigrams around the symbol in all of
the source's stretches, with symbols of one or two characters and each script as rival readings. A reading holds if it
makes the stretches likelier by more than its table costs, and many of them stretches that other sources hold. Restoring applies the tables by translate().
U+FFFD is a symbol for an unknown letter; it is restored only where its neighbours leave one choice.

Only distinct stretches, bigrams (bounded by the alphabet) and symbol tables (bounded by the code pages and the letters)
take part in learning; texts are read once for the stretches, and again only to be restored. A source's table joins its stretches as one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpage.sources import ship_package, stage

ROUNDS = 4
ODDS = 3.0  # log-odds above which a stretch counts as garbled
PRIOR_ROWS = 50.0  # weight of the corpus's habits against a source's own, in stretches
START = math.log(0.3)  # first prior of a swap that turns several characters into one letter
NEVER = re.compile(r"[\x80-\x9f�]")  # control characters and U+FFFD, which no rightly decoded text holds
BACKOFF, FLOOR = 2.0, 1e-7
SURE = 0.9
TASKS = 24  # over which the distinct stretches of a round are spread
CIPHER_ROUNDS = 8
ALONE = 0.05  # a pair of characters is odd in a source if the others have it so many times at most as often as the source itself
ODD_SHARE = 0.5  # least share of odd pairs, among those that hold a character beyond ASCII, of an odd stretch
STRANGE = 1e-4  # probability of an odd pair
OFTEN = 3  # least stretches of a source with a symbol of its cipher
FOUND = 0.2  # least share of a source's odd stretches that its cipher must turn into stretches of other sources
GAIN = 30.0  # nats by which a source's cipher must pay, after the cost of its table

# Code pages that text may have been read with, and those it may have been written in.
READ_AS = ["latin", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp1253", "cp1250", "cp866", "iso8859_5", "iso8859_7", "iso8859_15", "cp1254", "mac_cyrillic"]
WRITTEN_IN = ["cp1252", "cp1251", "koi8_r", "cp1253", "cp437", "cp850", "mac_roman", "cp866", "iso8859_5", "iso8859_7", "mac_cyrillic", "cp1250"]

CHUNK = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


@lru_cache(maxsize=None)
def _bytes_to_chars(codec: str) -> tuple[str | None, ...]:
    """The character of each byte; "latin" is Windows Latin-1 with the unused bytes as control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode("cp1252" if codec == "latin" else codec))
        except UnicodeDecodeError:
            out.append(chr(b) if codec == "latin" else None)
    return tuple(out)


@lru_cache(maxsize=None)
def _char_bytes(codec: str) -> dict[str, int]:
    found = {c: b for b, c in enumerate(_bytes_to_chars(codec)) if c is not None and b > 127}
    if codec == "latin":
        found = {chr(b): b for b in range(128, 256)} | found
    return found


@lru_cache(maxsize=None)
def _runs(codec: str) -> re.Pattern:
    """Runs of the code page's characters that are one letter's bytes in UTF-8."""
    by = _char_bytes(codec)
    group = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in by.items() if lo <= b <= hi) + "]"
    more = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{more}|{group(0xE0, 0xEF)}{more}{{2}}|{group(0xF0, 0xF4)}{more}{{3}}")


def _letter(run: str, codec: str) -> str:
    by = _char_bytes(codec)
    try:
        return bytes(by[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return run


def _utf8(codec: str, chunk: str) -> tuple[str, list[tuple[str, str]]]:
    pairs: list[tuple[str, str]] = []

    def one(m: re.Match) -> str:
        letter = _letter(m.group(), codec)
        if letter != m.group():
            pairs.append((m.group(), letter))
        return letter

    return _runs(codec).sub(one, chunk), pairs


@lru_cache(maxsize=None)
def _table(read: str, written: str) -> dict[str, str]:
    """Character to character, for text written in one code page and read as another."""
    target = _bytes_to_chars(written)
    return {c: target[b] for c, b in _char_bytes(read).items() if target[b] is not None and target[b] != c}


def _plain(chunk: str) -> bool:
    """No character that the code pages' upper halves hold, so no swap to weigh."""
    return all(ord(c) < 128 or (ord(c) >= 0x3000 and c != "�") for c in chunk)


def swaps(chunk: str, single: bool) -> dict[str, tuple[str, list[tuple[str, str]]]]:
    """For each swap that could have made the chunk: the text behind it and the (symbol, letter) pairs."""
    if _plain(chunk):
        return {}
    out: dict[str, tuple[str, list[tuple[str, str]]]] = {}
    if "�" in chunk:
        out["lost"] = (chunk, [])
    for codec in READ_AS:
        text, pairs = _utf8(codec, chunk)
        if pairs and all(text != t for t, _ in out.values()):
            out[f"utf_8>{codec}"] = (text, pairs)
            again, more = _utf8("latin", text)
            if more:
                whole, last = _utf8("latin", again)
                out[f"utf_8>latin>{codec}"] = (whole if last else again, pairs)
    if any("\x80" <= c <= "\x9f" for c in chunk):
        t = _table("latin", "cp1252") | {chr(b): c for b, c in enumerate(_bytes_to_chars("cp1252")) if c and 0x80 <= b <= 0x9F}
        pairs = [(c, t[c]) for c in chunk if "\x80" <= c <= "\x9f" and c in t]
        out.setdefault("cp1252>latin_1", ("".join(t[c] if "\x80" <= c <= "\x9f" and c in t else c for c in chunk), pairs))
    if single:
        upper = {c for c in chunk if ord(c) > 127}
        for read in READ_AS:
            if upper <= _char_bytes(read).keys():
                for written in WRITTEN_IN:
                    t = _table(read, written)
                    if any(c in t for c in upper):
                        text = "".join(t.get(c, c) for c in chunk)
                        if all(text != x for x, _ in out.values()) and all(c.isalpha() or c in "’“”„«»–—…·" for x, c in zip(chunk, text) if ord(x) > 127):
                            out[f"{written}>{read}"] = (text, [(x, y) for x, y in zip(chunk, text) if x != y])
    return out


def folded(text: str) -> str:
    """Lower case, with the scripts of many letters, pictures and digits each as one symbol, so that the alphabet is bounded."""
    out = []
    for c in text.lower():
        o = ord(c)
        if o < 0x2E80 or c == "�":
            out.append("0" if c.isdigit() and o < 128 else c)
        elif 0x3040 <= o < 0x30A0:
            out.append("あ")
        elif 0x30A0 <= o < 0x3100:
            out.append("ア")
        elif 0xAC00 <= o < 0xD7B0:
            out.append("한")
        elif 0xE000 <= o < 0xF900:
            out.append("")
        elif o >= 0x1F000:
            out.append("☺")
        else:
            out.append("字" if c.isalpha() else "、")
    return "".join(out)


class Bigrams:
    """Letter bigrams with backing off to single letters."""

    def __init__(self, counts: dict[str, float]):
        first: Counter = Counter()
        single: Counter = Counter()
        for ab, n in counts.items():
            if not NEVER.search(ab):
                first[ab[0]] += n
                single[ab[1]] += n
        self.total = sum(single.values()) or 1.0
        self.single = {b: max(n / self.total, FLOOR) for b, n in single.items()}
        self.first, self.counts = first, counts
        self.known: dict[str, float] = {}

    def log(self, ab: str) -> float:
        p = self.known.get(ab)
        if p is None:
            back = self.single.get(ab[1], FLOOR)
            p = self.known[ab] = math.log(((0.0 if NEVER.search(ab) else self.counts.get(ab, 0.0)) + BACKOFF * back) / (self.first.get(ab[0], 0.0) + BACKOFF))
        return p

    def score(self, text: str) -> float:
        t = f"^{folded(text)}$"
        log = self.log
        return sum(log(t[i : i + 2]) for i in range(len(t) - 1))

    def lost(self, text: str) -> float:
        """Score with each U+FFFD as an unknown letter, one in 100 letters at random."""
        t = f"^{folded(text)}$"
        return sum(-4.6 if "�" in t[i : i + 2] else self.log(t[i : i + 2]) for i in range(len(t) - 1))


class Model:
    """What expectation-maximisation learned: bigrams, log-priors of swaps, and their symbol tables."""

    def __init__(self, bigrams: dict[str, float], masses: dict[str, float], tables: dict[str, dict[str, str]]):
        self.bigrams, self.masses, self.tables = Bigrams(bigrams), masses, tables
        total = sum(masses.values()) or 1.0
        self.prior = {h: math.log(max(n / total, 1e-6)) for h, n in masses.items()}
        self.first = not tables  # no swap was weighed yet
        self.seen: dict[str, dict[str, float]] = {}

    def weigh(self, chunk: str) -> dict[str, float]:
        """Log-likelihood of each swap less that of none."""
        found = self.seen.get(chunk)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            base = None
            found = {}
            for h, (text, _) in swaps(chunk, not self.first).items():
                if base is None:
                    base = self.bigrams.score(chunk)
                found[h] = (self.bigrams.lost(chunk) if h == "lost" else self.bigrams.score(text)) - base
            self.seen[chunk] = found
        return found

    def best(self, chunk: str) -> tuple[str, float] | None:
        """The likeliest swap and its log-odds against none."""
        prior = self.prior
        none = prior.get("none", -0.05)
        least = min(self.prior.values(), default=-14.0)
        odds = [(v + prior.get(h, self.prior.get(h, least)) - none, h) for h, v in self.weigh(chunk).items()]
        return (max(odds)[1], max(odds)[0]) if odds else None

    def restore(self, chunk: str, swap: str) -> str:
        """The text behind the chunk, by the swap's learned table; what the table doesn't know stays."""
        if swap == "lost":
            return self._guess(chunk)
        for h in reversed(swap.split(">", 1)[1].split(">")) if swap.startswith("utf_8>") else [None]:
            if h is None:
                return chunk.translate(str.maketrans(self.tables.get(swap, {})))
            table = self.tables.get(f"utf_8>{h}", {})
            symbols: dict[str, str] = {}
            packed = _runs(h).sub(lambda m: symbols.setdefault(m.group(), chr(0xF0000 + len(symbols))), chunk)  # each symbol as one code point
            chunk = packed.translate({ord(p): table.get(s, _letter(s, h)) for s, p in symbols.items()})
        text, more = _utf8("latin", chunk) if swap.count(">") > 1 else (chunk, [])
        return text if more else chunk

    def _guess(self, chunk: str) -> str:
        t, b = f"^{folded(chunk)}$", self.bigrams
        letters = [c for c in b.single if ord(c) > 127 and c != "�"]
        out = list(chunk)
        if len(t) != len(chunk) + 2:
            return chunk
        for i, c in enumerate(chunk):
            if c == "�" and "�" not in t[i] + t[i + 2]:
                p = sorted(((math.exp(b.log(t[i] + x) + b.log(x + t[i + 2])), x) for x in letters), reverse=True)
                if p and p[0][0] > SURE * sum(x for x, _ in p) and b.counts.get(t[i] + p[0][1], 0) > 5:
                    out[i] = p[0][1]
        return "".join(out)


def stretches(df: DataFrame, keys: list[str], source: Column, text: str) -> DataFrame:
    """keys, source and the distinct stretches of every record whose text has any: runs between blanks, without digits and
    ASCII punctuation at their ends, that hold a character beyond ASCII. NULL and empty texts have none."""
    ship_package(df.sparkSession)
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def cut(batches):
        for b in batches:
            n = len(keys)
            rows = [list(dict.fromkeys(x for x in (c.strip(EDGE) for c in CHUNK.findall(t.as_py())) if x)) for t in b.column(n + 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n + 1)), pa.array(rows, pa.list_(pa.string()))], [*keys, "source", "chunks"])

    beyond = F.regexp_like(F.col(text), F.lit(r"[^\x00-\x7f]"))
    cols = df.where(beyond).select(*keys, F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("t"))
    return cols.mapInArrow(cut, ", ".join([*kinds, "source string", "chunks array<string>"]))


def _expect(chunks: DataFrame, model: Model | None) -> tuple[dict[str, float], dict[str, float], dict[str, dict[str, str]]]:
    """One round: expected bigrams, swaps and symbol tables over all distinct stretches."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def expect(batches):
        m = shared.value
        out: dict[tuple[str, str, str], float] = defaultdict(float)
        for b in batches:
            for chunk, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                options = swaps(chunk, m is not None and not m.first) if m is not None else {}
                known = {}
                if m is not None and options:
                    start = START if m.first else -9.0
                    odds = {h: math.exp(min(50.0, v + m.prior.get(h, start) - m.prior.get("none", 0.0))) for h, v in m.weigh(chunk).items() if h in options}
                    total = 1 + sum(odds.values())
                    known = {h: o / total for h, o in odds.items()}
                rest = max(0.0, 1 - sum(known.values()))
                out["swap", "none", ""] += n * rest
                likeliest = max(known, key=known.get) if known and max(known.values()) > rest else "none"
                for h, share, text, pairs in [("none", rest, chunk, []), *((h, known[h], *options[h]) for h in options)]:
                    if share < 1e-3:
                        continue
                    if h != "none":
                        out["swap", h, ""] += n * share
                        for symbol, letter in pairs:
                            out[h, symbol, letter] += n * share
                    if h == likeliest != "lost":  # the bigrams come from the best explanation alone, which keeps garbled ones out
                        t = f"^{folded(text)}$"
                        for i in range(len(t) - 1):
                            out["bigram", t[i : i + 2], ""] += n
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(list(out.values()), pa.float64())], ["kind", "a", "b", "n"])

    rows = chunks.select("chunk", "n").mapInArrow(expect, "kind string, a string, b string, n double").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    bigrams = {r.a: r.n for r in rows if r.kind == "bigram"}
    masses = {r.a: r.n for r in rows if r.kind == "swap"}
    best: dict[str, dict[str, tuple[float, str]]] = defaultdict(dict)
    for r in rows:
        if r.kind not in ("bigram", "swap"):
            best[r.kind][r.a] = max(best[r.kind].get(r.a, (0.0, "")), (r.n, r.b))
    return bigrams, masses, {h: {s: letter for s, (_, letter) in t.items()} for h, t in best.items()}


def learn(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the distinct stretches of `found`, a result of stretches()."""
    counted = found.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    chunks = stage(counted.repartition(TASKS, "chunk"), "stretches")  # a number given is not coalesced: each round is spread over the tasks
    model = None
    for _ in range(rounds):
        model = Model(*_expect(chunks, model))
    return model


def pairs_beyond(chunk: str) -> list[str]:
    """The chunk's pairs of characters that hold one beyond ASCII."""
    t = f"^{folded(chunk)}$"
    return [t[i : i + 2] for i in range(len(t) - 1) if max(t[i : i + 2]) > "\x7f"]


def odd_pairs(found: DataFrame) -> DataFrame:
    """(source, pairs): of every source, the pairs that hardly any other source has. At most alphabet squared a source."""

    def count(batches):
        for b in batches:
            out: Counter = Counter()
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.update((s, x) for x in pairs_beyond(c))
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.string()), pa.array([out[k] for k in keys], pa.int64())], ["source", "pair", "n"])

    each = found.select("source", F.explode("chunks").alias("chunk")).distinct()
    own = stage(each.mapInArrow(count, "source string, pair string, n bigint").groupBy("source", "pair").agg(F.sum("n").alias("n")), "pairs")
    total = own.groupBy("pair").agg(F.sum("n").alias("all"))
    alone = own.join(total, "pair").where((F.col("all") - F.col("n")) <= ALONE * F.col("n"))
    return alone.groupBy("source").agg(F.collect_list("pair").alias("pairs"))


def weigh_records(found: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """keys, source, swap, odds, many, all, odd of every record of a result of stretches(): its likeliest swap, how many of its stretches are garbled, and
    those that neither a listed swap nor the spelling of other sources explains, with the source's odd pairs."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    kinds = [f"{k} {found.schema[k].dataType.simpleString()}" for k in keys]

    def weigh(batches):
        m = shared.value
        n = len(keys)
        for b in batches:
            rows = []
            for cs, own in zip(b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()):
                odds = [(c, m.best(c)) for c in cs]
                alone = frozenset(own or ())
                near = [x for _, x in odds if x and x[1] > ODDS - 8]
                rest = [(c, pairs_beyond(c)) for c, x in odds if not (x and x[1] > ODDS) and not _plain(c)] if alone else []
                odd = [c for c, ps in rest if sum(x in alone for x in ps) >= ODD_SHARE * len(ps) > 0]
                h, v = max(near, key=lambda x: x[1]) if near else (None, -99.0)
                rows.append((h, v, sum(x[1] > ODDS for x in near), len(cs), odd))
            types = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n + 1)), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types)), b.column(n + 2), b.column(n + 1)], [*keys, "source", "swap", "odds", "many", "all", "odd", "pairs", "words"])

    with_pairs = found.join(odd_pairs(found), "source", "left").select(*keys, "source", "chunks", "pairs")
    return stage(with_pairs.mapInArrow(weigh, ", ".join([*kinds, "source string", "swap string", "odds double", "many int", "all int", "odd array<string>", "pairs array<string>", "words array<string>"])), "weighed")


# First and last characters of the scripts that a cipher's letters are of.
SCRIPTS = {"latin": (0xC0, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x4FF)}


class Cipher:
    """The bigrams as a table of transitions among ASCII characters and the letters of a script that the corpus uses."""

    def __init__(self, bigrams: Bigrams, script: str):
        low, high = SCRIPTS[script]
        self.letters = sorted(c for c, p in bigrams.single.items() if low <= ord(c) <= high and c.isalpha() and p > 1e-6)
        plain = "^$" + "".join(sorted(c for c in bigrams.single if ord(c) < 128 and c not in "^$"))
        self.at = {c: i for i, c in enumerate(plain + "".join(self.letters))}
        self.hidden = np.arange(len(plain), len(self.at))
        names = list(self.at)
        self.steps = np.array([[math.exp(bigrams.log(a + b)) for b in names] for a in names]) if self.letters else np.zeros((0, 0))
        self.known: dict[frozenset, np.ndarray] = {}

    def without(self, pairs: frozenset[str]) -> np.ndarray:
        """The transitions with the odd pairs of a source as good as unknown."""
        steps = self.known.get(pairs)
        if steps is None:
            if len(self.known) > 50:
                self.known.clear()
            steps = self.known[pairs] = self.steps.copy()
            for x in pairs:
                if x[0] in self.at and x[1] in self.at:
                    steps[self.at[x[0]], self.at[x[1]]] = STRANGE
        return steps

    def explain(self, units: list[str], table: dict[str, np.ndarray], steps: np.ndarray) -> tuple[float, list[tuple[str, np.ndarray]]]:
        """Log-likelihood of a stretch whose symbols are hidden letters, and the letters' probabilities at each symbol, by the forward-backward rule. `table` has, of each
        symbol, the probability that a letter is written so."""
        states, emits = [np.array([self.at["^"]])], [np.ones(1)]
        for u in [*units, "$"]:
            i = self.at.get(u.lower() if not u.isdigit() else "0") if len(u) == 1 and ord(u) < 128 else None
            states.append(np.array([i]) if i is not None else self.hidden)
            emits.append(np.ones(1) if i is not None else table.get(u, FLOOR))
        forward, total = [np.ones(1)], 0.0
        for k in range(1, len(states)):
            x = (forward[-1] @ steps[np.ix_(states[k - 1], states[k])]) * emits[k]
            z = float(x.sum())
            total += math.log(max(z, 1e-300))
            forward.append(x / max(z, 1e-300))
        after, out = np.ones(len(states[-1])), []
        for k in range(len(states) - 2, 0, -1):
            after = steps[np.ix_(states[k], states[k + 1])] @ (after * emits[k + 1])
            after = after / max(after.max(), 1e-300)
            if len(states[k]) > 1:
                g = forward[k] * after
                out.append((units[k - 1], g / max(g.sum(), 1e-300)))
        return total, out


def strange_score(bigrams: Bigrams, chunk: str, pairs: frozenset[str]) -> float:
    """Log-probability of a chunk as it stands, with the source's odd pairs as good as unknown."""
    t = f"^{folded(chunk)}$"
    return sum(math.log(STRANGE) if t[i : i + 2] in pairs else bigrams.log(t[i : i + 2]) for i in range(len(t) - 1))


def cipher_units(chunk: str, width: int) -> list[str] | None:
    """The chunk as ASCII characters and symbols of `width` characters; None if its symbols are of another width."""
    out: list[str] = []
    for m in re.finditer(r"[\x00-\x7f]|[^\x00-\x7f]+", chunk):
        s = m.group()
        if s.isascii():
            out.append(s)
        elif len(s) % width:
            return None
        else:
            out += [s[i : i + width] for i in range(0, len(s), width)]
    return out


THETA = "array<struct<symbol:string,letter:string,p:double>>"


def _tables(theta: list[dict] | None, cipher: Cipher, symbols: set[str]) -> dict[str, np.ndarray]:
    """For each symbol, the probability of being written for each letter: what a round learned, at first all alike."""
    if theta is None:
        return {s: np.full(len(cipher.letters), 1.0 / max(len(symbols), 40)) for s in symbols}
    place = {c: i for i, c in enumerate(cipher.letters)}
    out = {s: np.full(len(cipher.letters), 1e-5) for s in symbols}
    for x in theta:
        if x["symbol"] in out and x["letter"] in place:
            out[x["symbol"]][place[x["letter"]]] = x["p"]
    return out


def learn_ciphers(weighed: DataFrame, model: Model, rounds: int = CIPHER_ROUNDS) -> DataFrame:
    """(source, width, script, symbols, letters) of every source with a cipher of its own, learned by expectation-maximisation over the source's odd stretches.
    Letters are capitals where a symbol mostly begins words. Sources without odd stretches have no row."""
    spark = weighed.sparkSession
    shared = spark.sparkContext.broadcast(model)
    odd = weighed.select("source", F.explode("odd").alias("chunk")).groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    alone = weighed.where(F.size("odd") > 0).groupBy("source").agg(F.first("pairs").alias("pairs"))

    def unite(batches):
        for b in batches:
            out = [(s, c, n, w, u) for s, c, n in zip(*(b.column(i).to_pylist() for i in range(3))) for w in (1, 2) if (u := cipher_units(c, w))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())))], ["source", "chunk", "n", "width", "units"])

    united = stage(odd.mapInArrow(unite, "source string, chunk string, n bigint, width int, units array<string>"), "units")
    symbol = F.explode(F.array_distinct(F.filter("units", lambda u: ~F.regexp_like(u, F.lit(r"^[\x00-\x7f]$")))))
    often = united.select("source", "width", symbol.alias("symbol")).groupBy("source", "width", "symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    often = often.groupBy("source", "width").agg(F.collect_set("symbol").alias("symbols")).where(F.size("symbols") >= 2)
    rows = united.join(often, ["source", "width"]).where(F.forall("units", lambda u: F.regexp_like(u, F.lit(r"^[\x00-\x7f]$")) | F.array_contains("symbols", u)))
    rows = stage(rows.join(alone, "source").repartition(TASKS, "source", "chunk"), "odd")
    names = "source string, width int, script string, symbol string, letter string, n double"
    if rows.limit(1).count() == 0:
        return spark.createDataFrame([], "source string, width int, script string, symbols array<string>, letters array<string>")

    def expect(batches):
        """Expected letters of each symbol; with letter "^" the times it begins a word, "+" the gain over the stretch as it stands."""
        m = shared.value
        ciphers = {s: c for s in SCRIPTS if (c := Cipher(m.bigrams, s)).letters}
        for b in batches:
            out: dict[tuple, float] = defaultdict(float)
            for source, chunk, n, width, units, symbols, pairs, theta in zip(*(b.column(i).to_pylist() for i in range(8))):
                pairs = frozenset(pairs or ())
                base = strange_score(m.bigrams, chunk, pairs)
                for script, c in ciphers.items():
                    mine = None if theta is None else [x for x in theta if x["symbol"][0] == script[0]]
                    mine = None if mine is None else [{**x, "symbol": x["symbol"][1:]} for x in mine]
                    total, at = c.explain(units, _tables(mine, c, set(symbols)), c.without(pairs))
                    out[source, width, script, "", "+"] += total - base
                    for s, g in at:
                        for i in np.flatnonzero(g > 1e-3):
                            out[source, width, script, s, c.letters[i]] += float(g[i])
                    for i, u in enumerate(units):
                        if len(u) > 1 or ord(u) > 127:
                            first = i == 0 or units[i - 1] in "-'(" or units[i - 1].isupper()
                            out[source, width, script, u, "^" if first else "v"] += 1
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32() if i == 1 else pa.string()) for i in range(5)] + [pa.array(list(out.values()), pa.float64())], ["source", "width", "script", "symbol", "letter", "n"])

    none = F.expr(f"cast(null as {THETA})").alias("theta")
    at = rows.select("*", none)
    for k in range(rounds):
        told = stage(at.select("source", "chunk", "n", "width", "units", "symbols", "pairs", "theta").mapInArrow(expect, names).groupBy("source", "width", "script", "symbol", "letter").agg(F.sum("n").alias("n")), "expected")
        if k + 1 == rounds:
            break
        pairs = told.where("letter not in ('^', 'v', '+')")
        sums = pairs.groupBy("source", "width", "script", "letter").agg(F.sum("n").alias("all"))
        theta = pairs.join(sums, ["source", "width", "script", "letter"]).select("source", "width", F.struct(F.concat(F.substring("script", 1, 1), "symbol").alias("symbol"), "letter", ((F.col("n") + 0.01) / (F.col("all") + 0.5)).alias("p")).alias("x"))
        at = rows.join(theta.groupBy("source", "width").agg(F.collect_list("x").alias("theta")), ["source", "width"])  # one row a source and width
    letters = told.where("letter not in ('^', 'v', '+')").groupBy("source", "width", "script", "symbol").agg(F.max(F.struct("n", "letter")).alias("m"), F.sum("n").alias("all"))
    begins = told.where("letter in ('^', 'v')").groupBy("source", "width", "script", "symbol").agg((F.sum(F.when(F.col("letter") == "^", F.col("n"))) / F.sum("n")).alias("first"))
    sure = letters.where(F.col("m.n") >= 0.5 * F.col("all")).join(begins, ["source", "width", "script", "symbol"], "left")
    letter = F.when(F.col("first") > 0.8, F.upper("m.letter")).otherwise(F.col("m.letter"))
    tables = sure.groupBy("source", "width", "script").agg(F.sort_array(F.collect_list(F.struct("symbol", letter.alias("letter")))).alias("t"))
    cost = told.where("letter = '+'").select("source", "width", "script", F.col("n").alias("gain"))
    paid = tables.join(cost, ["source", "width", "script"]).withColumn("gain", F.col("gain") - F.size("t") * math.log(40.0)).where(F.col("gain") > GAIN)
    best = paid.groupBy("source").agg(F.max(F.struct("gain", "width", "script", "t")).alias("b"))
    best = stage(best.select("source", "b.width", "b.script", F.transform("b.t", lambda x: x["symbol"]).alias("symbols"), F.transform("b.t", lambda x: x["letter"]).alias("letters")), "ciphers")

    def turned(batches):
        for b in batches:
            new = [decipher(*x).lower() for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["source", "chunk"])

    made = rows.select("source", "chunk", "width").join(best.select("source", "width", "symbols", "letters"), ["source", "width"]).select("source", "chunk", "width", "symbols", "letters").mapInArrow(turned, "source string, chunk string")
    others = weighed.select(F.col("source").alias("other"), F.explode("words").alias("chunk")).select("other", F.lower("chunk").alias("chunk")).distinct()
    met = made.distinct().join(others, "chunk", "left").groupBy("source", "chunk").agg(F.max(F.when(F.col("other") != F.col("source"), 1).otherwise(0)).alias("met"))
    good = met.groupBy("source").agg(F.avg("met").alias("share")).where(F.col("share") >= FOUND)
    return best.join(good.select("source"), "source", "left_semi")


def decipher(chunk: str, width: int, symbols: list[str], letters: list[str]) -> str:
    """The text behind a chunk by a source's learned table; what the table doesn't know stays."""
    units = cipher_units(chunk, width)
    if units is None:
        return chunk
    if width == 1:
        return chunk.translate(str.maketrans(dict(zip(symbols, letters))))
    code = {s: chr(0xF0000 + i) for i, s in enumerate(symbols)}  # each symbol as one code point
    return "".join(code.get(u, u) for u in units).translate({0xF0000 + i: x for i, x in enumerate(letters)})


def judge(weighed: DataFrame, keys: list[str], model: Model, ciphers: DataFrame) -> DataFrame:
    """keys of every record with a garbled stretch, each once. Listed swaps count with the garbled share of the record's source; a source's cipher where it makes a
    stretch likelier."""
    shared = weighed.sparkSession.sparkContext.broadcast(model)
    total = sum(model.masses.values()) or 1.0
    usual = max(1e-6, 1 - model.masses.get("none", total) / total)
    habits = weighed.groupBy("source").agg(((F.sum("many") + PRIOR_ROWS * usual) / (F.sum("all") + PRIOR_ROWS)).alias("share"))
    near = weighed.where("swap is not null")
    odds = F.col("odds") + F.log(F.col("share") / (1 - F.least("share", F.lit(0.99)))) - math.log(usual / (1 - min(usual, 0.99)))
    listed = near.join(habits, "source").where(odds > ODDS).select(*keys)
    kinds = [f"{k} {weighed.schema[k].dataType.simpleString()}" for k in keys]

    def likelier(batches):
        m, n = shared.value, len(keys)
        for b in batches:
            keep = []
            for chunks, pairs, width, symbols, letters in zip(*(b.column(n + i).to_pylist() for i in range(5))):
                keep.append(any((new := decipher(c, width, symbols, letters)) != c and m.bigrams.score(new) - strange_score(m.bigrams, c, frozenset(pairs or ())) > ODDS for c in chunks))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in range(n)], keys)

    own = weighed.where(F.size("odd") > 0).join(ciphers, "source").select(*keys, "odd", "pairs", "width", "symbols", "letters").mapInArrow(likelier, ", ".join(kinds))
    return listed.unionByName(own).distinct()


def restore(df: DataFrame, keys: list[str], text: str, model: Model, out: str = "restored", source: Column | None = None, ciphers: DataFrame | None = None) -> DataFrame:
    """df with `out`: the text with its garbled stretches replaced by what they stood for; other texts as they were, NULL as NULL. Text that was garbled more than
    once is undone until no stretch changes. With `source` and `ciphers`, the sources' own tables are applied to what is left."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def mend(batches):
        m = shared.value

        def line(s: str) -> str:
            if s.isascii():
                return s
            chunks = dict.fromkeys(c for w in CHUNK.findall(s) if (c := w.strip(EDGE)))
            best = {c: m.best(c) for c in chunks}
            sure = Counter(b[0] for b in best.values() if b and b[1] > ODDS)
            if not sure:
                return s
            habit, many = sure.most_common(1)[0]
            least = -8.0 if 2 * many > len(chunks) else 0.0  # most of the line went that way
            done = {}
            for c, b in best.items():
                if b and b[1] > ODDS:
                    done[c] = m.restore(c, b[0])
                elif m.weigh(c).get(habit, -99.0) > least:  # too short to tell by itself, among stretches that were garbled one way
                    done[c] = m.restore(c, habit)
            return CHUNK.sub(lambda x: x.group().replace(c, done[c]) if (c := x.group().strip(EDGE)) in done else x.group(), s)

        def whole(t: str) -> str:
            while True:  # a text can be garbled more than once; each time it gets shorter, but for the last
                new = "\n".join(map(line, t.split("\n")))
                if len(new) >= len(t):
                    return new
                t = new

        def by_table(t: str, width: int, symbols: list[str], letters: list[str]) -> str:
            odd = frozenset(x for x in symbols if len(x) == 1)
            odd = frozenset(p for c in CHUNK.findall(t) for p in pairs_beyond(c) if p[0] in odd or p[1] in odd)

            def one(x: re.Match) -> str:
                c = x.group()
                new = decipher(c, width, symbols, letters)
                return new if new != c and m.bigrams.score(new) > strange_score(m.bigrams, c, odd) else c

            return CHUNK.sub(one, t)

        for b in batches:
            texts = [t if t is None or t.isascii() else whole(t) for t in b.column(len(keys)).to_pylist()]
            tables = zip(*(b.column(len(keys) + i).to_pylist() for i in (1, 2, 3)))
            texts = [by_table(t, *x) if t and x[0] and not t.isascii() else t for t, x in zip(texts, tables)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(texts, pa.string())], [*keys, out])

    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    if ciphers is None or source is None:
        none = F.expr("cast(null as array<string>)")
        cols = df.select(*keys, text, F.lit(None).cast("int").alias("width"), none.alias("symbols"), none.alias("letters"))
    else:
        own = ciphers.select(F.col("source").alias("__source"), "width", "symbols", "letters")
        cols = df.select(*keys, text, F.coalesce(source, F.lit("")).alias("__s")).join(own, F.col("__s") == F.col("__source"), "left").select(*keys, text, "width", "symbols", "letters")
    return cols.mapInArrow(mend, ", ".join([*kinds, f"{out} string"]))
