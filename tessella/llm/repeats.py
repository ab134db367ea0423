"""Passages that occur more than once, word by word, found by recompression.

Each text is a sequence of symbols. The first round names runs of one word by the word and their length; each further round gives
every name a bit, and names each pair of neighbours with bits 0 and 1 by the two names. Names are hashes, so a round names alike
all over the corpus without an exchange, and symbols within equal passages are equal but for some at their ends: which symbol
stands in a place is settled by the words of its *context*, a few symbols to both sides.

A window of WINDOW words is so told by a symbol of the highest of LEVELS that has one whose context lies in the window (the first
such; the window itself if there is none): equal windows have equal symbols at equal places. Successive windows with one symbol
are its *stretch*. What follows works on stretches, some seven words apart, instead of windows:
1. symbols, with their context, are counted, and stretches go whose symbol is nowhere else;
2. stretches of equal words verify each other whole;
3. where stretches share a symbol and differ, their windows are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import fields, record_batch, slices
from .scratch import forget, free_names, stored
from .words import hashes, mixed, release

WINDOW = 35
#: Rounds after which a window looks for its symbol, the last first.
LEVELS = (7, 5, 3, 1)
#: Bytes of text that are symbols at once, and stands for what lies beyond a text.
SLICE, FAR = 1 << 20, 1 << 40

_PAIR, _RUN, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Hashed:
    """Hashes of any stretch of words, by sums of the words' hashes times powers."""

    def __init__(self, h: np.ndarray):
        self.powers = np.cumprod(np.full(len(h) + 1, _BASE)) * _BACK
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * (np.cumprod(np.full(len(h), _BACK)) * _BASE))])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.powers[a] + (b - a).astype(np.uint64))


class Symbols:
    """The symbols of some texts, of words of hashes ``h`` and texts ``text``: names, where each starts and ends, where its
    context starts and ends (FAR off if it reaches beyond the text), and its text."""

    def __init__(self, h: np.ndarray, text: np.ndarray):
        self.start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
        self.end, self.text = np.append(self.start[1:], len(h)), text[self.start]
        n = (self.end - self.start).astype(np.uint64)
        self.name = np.where(n > 1, mixed(h[self.start] * _RUN + n), h[self.start])
        new = self.text[1:] != self.text[:-1]
        self.low = np.where(np.r_[True, new], -FAR, self.start - 1)
        self.high = np.where(np.r_[new, True], FAR, self.end + 1)

    def next_round(self, k: int) -> None:
        """Pairs of bits 0 and 1 become symbols. A symbol that is left is so because of its neighbour, which joins its context."""
        bit = mixed(self.name ^ mixed(np.full(1, k + 1, np.uint64))) >> np.uint64(63) == 1
        same = self.text[1:] == self.text[:-1]
        first = np.append(~bit[:-1] & bit[1:] & same, False)
        low = np.where(bit, np.r_[-FAR, np.where(same, self.low[:-1], -FAR)], self.low)
        high = np.where(bit, self.high, np.r_[np.where(same, self.high[1:], FAR), FAR])
        left = np.flatnonzero(~np.r_[False, first[:-1]])
        two, after = first[left], np.minimum(left + 1, len(first) - 1)
        pair = mixed(mixed(self.name[left] + _PAIR) + self.name[after])
        self.name, self.low = np.where(two, pair, self.name[left]), np.where(two, self.low[left], low[left])
        self.end, self.high = np.where(two, self.end[after], self.end[left]), np.where(two, self.high[after], high[left])
        self.start, self.text = self.start[left], self.text[left]


def stretches(h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """name, first window and number of windows of each stretch of texts of ``lengths`` words of hashes ``h``. A name stands for
    the symbol, where it is in its context, and the words of that."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    open_ = np.arange(len(h)) + WINDOW <= np.cumsum(lengths)[text]
    if not open_.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashed, symbols, by_level = Hashed(h), Symbols(h, text), {}
    for k in range(LEVELS[0] + 1):
        if k in LEVELS:
            by_level[k] = symbols.name, symbols.start, symbols.low, symbols.high
        if k < LEVELS[0]:
            symbols.next_round(k)
    found = []
    for k in LEVELS:
        name, start, low, high = by_level[k]
        first = np.maximum(np.maximum(np.r_[-FAR, low[:-1]] + 1, high - WINDOW), 0)
        good = np.flatnonzero((low >= 0) & (high < FAR) & (first <= low))
        n = low[good] - first[good] + 1
        at = np.repeat(first[good] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.repeat(good, n)
        own, at = own[open_[at]], at[open_[at]]
        open_[at] = False
        if len(at):
            new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
            own, first = own[new], at[new]
            place = (start[own] - low[own]).astype(np.uint64)
            names = mixed(name[own] + place * _PAIR) ^ hashed.of(low[own], high[own])
            found.append((names, first, np.diff(new, append=len(at))))
    at = np.flatnonzero(open_)
    found.append((hashed.of(at, at + WINDOW), at, np.ones(len(at), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and the number of each text's."""
    split = [t.encode().split() for t in texts]
    return mixed(hashes([w for ws in split for w in ws])), np.array([len(ws) for ws in split], np.int64)


def _each_slice(batches, seen: set[int] | None):
    """Parts of the batches (key, text, ...), without texts whose key is in ``seen`` already."""
    release()
    for batch in batches:
        for part in slices(batch, most_bytes=SLICE):
            if seen is not None:
                keys = part.column("key").to_pylist()
                new = [k not in seen and not seen.add(k) for k in keys]
                part = part.filter(pa.array(new, pa.bool_()))
            if part.num_rows:
                yield part


def _names(texts: DataFrame) -> DataFrame:
    """name of every stretch of ``texts`` (key, text)."""
    types = fields(StructType.fromDDL("name long"))

    def run(batches):
        for part in _each_slice(batches, set()):
            yield record_batch({"name": pa.array(stretches(*_numbered(part.column("text").to_pylist()))[0].view(np.int64))}, types)

    return texts.mapInArrow(run, "name long")


def _stretches(texts: DataFrame) -> DataFrame:
    """name, whole (the hash of all words of its windows, and of its symbol's place there), key, first, n of every stretch."""
    types = fields(StructType.fromDDL("name long, whole long, key long, first long, n long"))

    def run(batches):
        for part in _each_slice(batches, set()):
            h, lengths = _numbered(part.column("text").to_pylist())
            name, first, n = stretches(h, lengths)
            starts = np.cumsum(lengths) - lengths
            own = np.searchsorted(np.cumsum(lengths), first, "right")
            whole = Hashed(h).of(first, first + n - 1 + WINDOW)
            key = part.column("key").to_numpy()[own]
            yield record_batch({"name": pa.array(name.view(np.int64)), "whole": pa.array(whole.view(np.int64)), "key": pa.array(key), "first": pa.array(first - starts[own]), "n": pa.array(n)}, types)

    return texts.mapInArrow(run, "name long, whole long, key long, first long, n long")


def _windows(rows: DataFrame) -> DataFrame:
    """name, words (its hash), key, at, sure of each window of the stretches of ``rows`` (key, text, of: array of name, first, n,
    sure)."""
    types = fields(StructType.fromDDL("name long, words long, key long, at long, sure boolean"))

    def run(batches):
        for part in _each_slice(batches, None):
            for text, key, of in zip(*(part.column(c).to_pylist() for c in ("text", "key", "of")), strict=True):
                h, _ = _numbered([text])
                n = np.array([x["n"] for x in of])
                own = np.repeat(np.arange(len(of)), n)
                at = np.repeat(np.array([x["first"] for x in of]) - np.cumsum(n) + n, n) + np.arange(n.sum())
                words = Hashed(h).of(at, at + WINDOW)
                name, sure = np.array([x["name"] for x in of], np.int64)[own], np.array([x["sure"] for x in of])[own]
                yield record_batch({"name": pa.array(name), "words": pa.array(words.view(np.int64)), "key": pa.array(np.full(len(at), key)), "at": pa.array(at), "sure": pa.array(sure)}, types)

    return rows.mapInArrow(run, "name long, words long, key long, at long, sure boolean")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """key, first, n for ``texts`` (key, text; equal texts have equal keys, no nulls): n windows from word ``first`` on that occur
    more than once in different texts or places. Texts of which there are copies have no more than that of their own."""
    common = stored(_names(texts).groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "shared-names")
    shared = stored(_stretches(texts).join(common, "name", "left_semi"), "shared-stretches")
    place = F.struct("key", "first", "n")
    alike = shared.groupBy("name", "whole").agg(F.min(place).alias("one"), F.max(place).alias("last"))
    alike = stored(alike.select("name", "whole", "one", (F.col("one") != F.col("last")).alias("sure")), "stretches")
    differ = alike.groupBy("name").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.bool_and("sure").alias("sure")).where("lo <> hi and not sure")
    asked = alike.join(differ.select("name"), "name", "left_semi").select("name", "one.*", "sure")
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("name", "first", "n", "sure")).alias("of"))
    windows = stored(_windows(texts.join(asked, "key")), "windows")
    at = F.struct("key", "at")
    again = windows.groupBy("name", "words").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo <> hi").select("name", "words")
    single = windows.where("not sure").join(again, ["name", "words"], "left_semi").select("key", F.col("at").alias("first"), F.lit(1).cast("long").alias("n"))
    whole = shared.join(alike.where("sure").select("name", "whole"), ["name", "whole"], "left_semi").select("key", "first", "n")
    found = stored(whole.union(single).distinct(), "repeated")
    forget(common, shared, alike, windows)
    return found


def removed(n_words: int, first: list[int], n: list[int]) -> np.ndarray:
    """Which words the windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, np.array(first, np.int64), 1)
    np.add.at(edges, np.array(first, np.int64) + np.array(n, np.int64) - 1 + WINDOW, -1)
    return np.cumsum(edges)[:-1] > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (text and any others) and n_words, n_removed, kept: the kept words joined by a space.

    Words lie between ASCII white space. A word is removed if it is in a window of WINDOW words of its text that also starts
    anywhere else, in another row or at another place of its own; windows are those of the whole texts. Null and empty texts
    have no words; of texts shorter than a window nothing is removed, nor is it from those without repeats; equal texts that are
    repeated lose all; columns of clashing names (key, first, n, name) stay; an empty table gives an empty table.

    Texts are told by 64 bits of a hash, windows by 128. Texts are read twice for the symbols, and go by a join to the windows
    that are compared and to the ranges that are removed; hot keys are only ever counted, or on the side of a join that is split.
    """
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("key"), "text")
    copies = texts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.lit(True).alias("copied"))
    ranges = repeated_windows(texts).groupBy("key").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))
    kept = docs.columns
    own, marked = free_names(docs, 2)
    ranges = stored(ranges.join(copies, "key", "full").select(F.col("key").alias(own), F.struct("first", "n", "copied").alias(marked)), "ranges")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    types = fields(schema)

    def run(batches):
        for part in _each_slice(batches, None):
            out = {"n_words": [], "n_removed": [], "kept": []}
            for text, found in zip(part.column("text").to_pylist(), part.column(marked).to_pylist(), strict=True):
                ws = (text or "").encode().split()
                gone = np.zeros(len(ws), bool)
                if found and len(ws) >= WINDOW:
                    gone = np.ones(len(ws), bool) if found["copied"] else removed(len(ws), found["first"], found["n"])
                out["n_words"].append(len(ws))
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(b" ".join(w for w, x in zip(ws, gone.tolist(), strict=True) if not x).decode())
            yield record_batch({c: part.column(c) for c in kept} | out, types)

    return docs.join(ranges, F.xxhash64(docs["text"]) == ranges[own], "left").drop(own).mapInArrow(run, schema)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text), by :func:`without_repeats`."""
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
