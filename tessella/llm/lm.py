"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, with normalised scores.

The model predicts all frequent words, the end, and one class for all other words; a word of that class then has its share
of the class by smoothed counts. A context is the two words before. The HEAD most frequent words are predicted at once; the
next ones in three steps, a class of groups, a group of the class and a word of the group, each normalised among its WIDTH
choices, so that a word costs a few hundred products instead of one for each word of the vocabulary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import gather
from .arrow import fields, record_batch, slices
from .language import remainder
from .scratch import stored
from .words import word_hash

#: At most so many words are frequent: the model tells them apart, and their counts go to all tasks; counts of other words
#: are joined.
FREQUENT = 1 << 17
#: Words that a model predicts at most (the last of a model's words stands for all others); the number of the beginning, which
#: only contexts have.
WORDS, SIZE, BEGIN = FREQUENT + 1, 16, -1
HEAD, WIDTH = 63, 48
#: Noise choices of each of the three levels, and positions, of a step.
NOISE, STEP, RATE = 32, 1024, 0.4
#: Steps whose noise is drawn at once.
DRAWS = 256
#: Tokens that a task learns from at least, if there are as many: nets of fewer, averaged, are little better than their start.
#: Tasks that train at most: each sends a net, and a net does not shrink with its share of the texts.
TRAINER_TOKENS, TRAINERS = 6_000_000, 4096
#: Bytes of text that are numbers at once, and contexts whose matrix product is there at once.
SLICE, BATCH = 2 << 20, 2048
#: Counts of the words of slices that a task adds up together.
COUNTS = 1 << 20
END = b"\n"


@dataclass
class Table:
    """Counts of all training tokens: ``hashes`` of the frequent words in order and ``numbers`` of each; by number the counts;
    ``end``: the number of the end; ``total`` and ``kinds`` of all words."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    end: int
    total: int
    kinds: int

    @property
    def rest(self) -> float:
        """What the words of the class of others have in smoothed counts, with one for all words never seen."""
        return self.total - float(self.counts.sum()) + 0.5 * (self.kinds - len(self.counts)) + 0.5


def split(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of the texts (A-Z lower-cased): for each word the number of its kind, the kinds, the words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, lengths = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(flat), 0)
    if pc.any(blank).as_py():  # around white space at the ends of a text
        text = np.repeat(np.arange(len(lengths)), lengths)[~blank.to_numpy(zero_copy_only=False)]
        flat, lengths = flat.filter(pc.invert(blank)), np.bincount(text, minlength=len(lengths))
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    kinds = flat.dictionary_encode()
    return kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), kinds.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), lengths


def code_of(word: bytes) -> int:
    return word_hash(word) >> 2


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words)).view(np.int64) >> 2 & (1 << 62) - 1


def count(docs: DataFrame, at_once: int = COUNTS) -> DataFrame:
    """word (its hash) and n over all tokens of ``docs``; tasks add up what they read, some ``at_once`` counts of slices together,
    before it is shuffled."""
    types = fields(StructType.fromDDL("word long, n long"))

    def run(batches):
        held, size, ends = [], 0, 0

        def out():
            n = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            return record_batch({"word": n["word"].chunk(0), "n": n["n_sum"].chunk(0)}, types)

        for batch in batches:
            for part in slices(batch, most_bytes=SLICE):
                which, own, lengths = split(part.column("text"))
                if own:
                    held.append(pa.table({"word": hashes_of(own), "n": np.bincount(which, minlength=len(own))}))
                size, ends = size + len(own), ends + len(lengths)
                if size > at_once:
                    yield out()
                    held, size = [], 0
        if ends:
            held.append(pa.table({"word": [code_of(END)], "n": [ends]}))
            yield out()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def table_of(counted: DataFrame) -> Table:
    """Of the words, those are frequent that occur more often than the least number that leaves FREQUENT of them at most."""
    end = code_of(END)
    often = counted.groupBy("n").agg(F.count("*").alias("kinds")).toPandas().sort_values("n", ascending=False)
    most = often["n"][often["kinds"].cumsum() > FREQUENT - 1].max()
    top = counted.where((F.col("n") > (0 if most != most else int(most))) | (F.col("word") == end)).toPandas()
    top = top.assign(last=top["word"] != end).sort_values(["last", "n", "word"], ascending=[True, False, True])
    found = top["word"].to_numpy(np.int64)
    numbers = np.argsort(found)
    total, kinds = int((often["n"] * often["kinds"]).sum()), int(often["kinds"].sum())
    return Table(found[numbers], numbers, top["n"].to_numpy(np.int64), 0 if len(found) else code_of(END) | 1 << 62, total, kinds)


def levels(ids: np.ndarray, words: int) -> list[np.ndarray]:
    """Of a model's words: the choice of the first level (a word of the head, a class, or all others: the last), and for words
    after the head the group and the word. Groups and words are numbered through, the words of a group in a row."""
    head = min(HEAD, words - 1)
    tail = np.maximum(ids - head, 0)
    first = np.where(ids < head, ids, np.where(ids == words - 1, head + -(-(words - 1 - head) // WIDTH**2), head + tail // WIDTH**2))
    return [first, tail // WIDTH, tail]


def in_tail(ids: np.ndarray, words: int) -> np.ndarray:
    return np.flatnonzero((ids >= min(HEAD, words - 1)) & (ids < words - 1))


def level_shares(shares: np.ndarray) -> list[np.ndarray]:
    """The share of each choice of each level."""
    words = len(shares)
    first, group, word = levels(np.arange(words), words)
    tail = in_tail(np.arange(words), words)
    return [np.bincount(first, shares), np.bincount(group[tail], shares[tail]), np.bincount(word[tail], shares[tail])]


@dataclass
class Net:
    """Vectors of context words (the last is the beginning), a factor for each place in the context, and for each level the
    vectors of its choices, whose last component is a bias."""

    context: np.ndarray
    place: np.ndarray
    choices: list[np.ndarray]

    @staticmethod
    def start(shares: np.ndarray) -> Net:
        rng = np.random.default_rng(7)
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        context, choices = draw(len(shares) + 1, SIZE), []
        for own in level_shares(shares):
            bias = np.log(own / max(1e-300, own.sum())).astype(np.float32)
            choices.append(np.column_stack([draw(len(own), SIZE), bias]))
        return Net(context, np.ones((2, SIZE), np.float32) / 2, choices)

    @property
    def words(self) -> int:
        return len(self.context) - 1

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.place, *self.choices]

    def copy(self) -> Net:
        return Net(self.context.copy(), self.place.copy(), [c.copy() for c in self.choices])

    def ahead(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The predicted vector of each context (two numbers) with a 1 for the bias, and the vectors of the two words."""
        a, b = self.context.take(before[:, 0], axis=0), self.context.take(before[:, 1], axis=0)
        a, b = np.asfortranarray(a), np.asfortranarray(b)
        q = np.ones((len(before), SIZE + 1), np.float32, "F")
        np.multiply(a, self.place[0], out=q[:, :SIZE])
        q[:, :SIZE] += b * self.place[1]
        return q, a, b

    def log_probabilities(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(after | before), normalised over all words: matrix products of batches of contexts with the
        choices of the first level, of each class that they meet and of each group."""
        order = np.argsort(after)
        after = after[order]
        first, group, word = levels(after, self.words)
        q, out = np.empty((len(after), SIZE + 1), np.float32, "F"), np.empty(len(after), np.float64)
        for k in range(0, len(after), BATCH):
            q[k : k + BATCH] = self.ahead(before.take(order[k : k + BATCH], axis=0))[0]
            out[k : k + BATCH] = _log_share(q[k : k + BATCH], self.choices[0], first[k : k + BATCH])
        tail = in_tail(after, self.words)
        for to, vectors in ((group, self.choices[1]), (word, self.choices[2])) if len(tail) else ():
            starts = tail[0] + np.flatnonzero(np.diff(to[tail] // WIDTH, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), int(tail[-1]) + 1], strict=True):
                lo = to[a] // WIDTH * WIDTH
                for k in range(a, b, BATCH):
                    rows = slice(k, min(b, k + BATCH))
                    out[rows] += _log_share(q[rows], vectors[lo : lo + WIDTH], to[rows] - lo)
        back = np.empty_like(out)
        back[order] = out
        return back


def _log_share(q: np.ndarray, vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Logarithms of the share of the choice ``to`` among all of ``vectors``."""
    z = vectors @ q.T
    own = z[to, np.arange(len(to))]
    with np.errstate(over="ignore", divide="ignore"):
        log_all = np.log(np.exp(z, out=z).sum(axis=0))
    if not np.isfinite(log_all).all():  # too large or too small for single precision
        z = vectors @ q.T
        most = z.max(axis=0)
        log_all = most + np.log(np.exp(z - most).sum(axis=0))
    return own - log_all


def _sums_of_runs(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``g`` by ``ids``, which are in order. Rows alone in their run are taken as they are."""
    edge = np.ones(len(ids) + 1, bool)
    np.not_equal(ids[1:], ids[:-1], out=edge[1:-1])
    g, starts = np.ascontiguousarray(g), edge[:-1].nonzero()[0]
    sums = g.take(starts, axis=0)
    shared = (~edge[starts + 1]).nonzero()[0]
    if len(shared):
        rows = (~(edge[:-1] & edge[1:])).nonzero()[0]
        sums[shared] = np.add.reduceat(g.take(rows, axis=0), edge[rows].nonzero()[0], axis=0)
    return ids[starts], sums


def _by_row(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(ids.astype(np.int64) << 32 | np.arange(len(ids)))
    return _sums_of_runs(keys >> 32, g.take(keys & (1 << 32) - 1, axis=0))


class Trainer:
    """Noise-contrastive steps with AdaGrad by rows, for each level; the noise of a step is shared by its positions. ``touched``
    has how many steps have moved each row of the net's arrays."""

    def __init__(self, net: Net, shares: np.ndarray, seed: int):
        self.net, self.rng = net, np.random.default_rng(seed)
        self.seen = [np.full(len(a), 1e-3, np.float32) for a in net.arrays()]
        self.touched = [np.zeros(len(a), np.float32) for a in net.arrays()]
        own = [x / max(1e-300, x.sum()) for x in level_shares(shares)]
        self.edges, self.offsets = [np.cumsum(x) for x in own], [np.log(NOISE * x).astype(np.float32) for x in own]
        self.drawn: list[list[np.ndarray]] = [[] for _ in own]

    def _noise(self, k: int) -> np.ndarray:
        """Choices of level ``k`` by their shares, in order; those of DRAWS steps are drawn at once."""
        if not self.drawn[k]:
            edges = self.edges[k]
            at = np.sort(self.rng.random((DRAWS, NOISE)) * edges[-1], axis=1)
            self.drawn[k] = list(np.minimum(np.searchsorted(edges, at), len(edges) - 1))
        return self.drawn[k].pop()

    def _move(self, k: int, rows, g: np.ndarray) -> None:
        a, seen, touched = self.net.arrays()[k], self.seen[k], self.touched[k]
        size = seen.take(rows) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        seen[rows] = size
        moved = g * (RATE / np.sqrt(size))[:, None]
        moved += a.take(rows, axis=0)
        a[rows] = moved
        touched[rows] = touched.take(rows) + 1

    def gradient(self, k: int, q: np.ndarray, to: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the noise-contrastive log likelihood of a level's choices ``to`` against ``noise``, both as numbers: by the
        predicted vectors, by the vectors of ``to``, and by those of ``noise``. The last component of ``q`` is 1, so offsets go
        with the biases."""
        vectors, offset = self.net.choices[k], self.offsets[k]
        own, other = np.asfortranarray(vectors.take(to, axis=0)), vectors.take(noise, axis=0)
        good = (1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) - offset[to])))[:, None]
        against = -other
        against[:, -1] += offset[noise]
        bad = against @ q.T
        np.exp(bad, out=bad)
        bad += 1
        np.divide(-1, bad, out=bad)
        own *= good
        own += (other.T @ bad).T
        return own, good * q, bad @ q

    def _level(self, k: int, q: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        noise = self._noise(k)
        dq, d_to, d_noise = self.gradient(k, q, to, noise)
        for ids, g in (_sums_of_runs(to, d_to), _sums_of_runs(noise, d_noise)):
            self._move(2 + k, ids, g / n)
        return dq / n

    def step(self, before: np.ndarray, after: np.ndarray) -> None:
        """One step over positions in the order of ``after``, in which the choices of all levels are in order as well."""
        net, n = self.net, len(after)
        q, a, b = net.ahead(before)
        first, group, word = levels(after, net.words)
        dq = self._level(0, q, first, n)
        tail = in_tail(after, net.words)
        if len(tail):
            tail = slice(tail[0], tail[-1] + 1)
            dq[tail] += self._level(1, q[tail], group[tail], n) + self._level(2, q[tail], word[tail], n)
        dq = dq[:, :SIZE]
        place = np.stack([np.einsum("ij,ij->j", dq, a), np.einsum("ij,ij->j", dq, b)])
        rows, g = _by_row(before.T.ravel() % (net.words + 1), np.concatenate([dq * net.place[0], dq * net.place[1]]))
        self._move(0, rows, g)
        self._move(1, np.arange(2), place)

    def learn(self, texts: pa.Array, table: Table) -> None:
        """Steps over every position of the texts, dealt to steps at random."""
        _, before, after, _ = _numbered(texts, table)
        order, at = self.rng.permutation(len(after)), np.arange(len(after))
        keys = np.sort((at // STEP * (WORDS + 1) + after[order]) * STEP + at % STEP)
        order = order[at // STEP * STEP + keys % STEP]
        before, after = before.take(order, axis=0).astype(np.int32), after[order].astype(np.int32)
        for k in range(0, len(order), STEP):
            self.step(before[k : k + STEP], after[k : k + STEP])


def _numbered(texts: pa.Array, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all tokens of the texts (the number of a frequent word, else its hash, with 2 ** 62 or more), the model's two
    numbers before each and its number, and where each text starts."""
    which, own, lengths = split(texts)
    h = hashes_of(own)
    at = np.minimum(np.searchsorted(table.hashes, h), len(table.hashes) - 1)
    code = np.where(table.hashes[at] == h, table.numbers[at], h | 1 << 62) if len(table.hashes) else h | 1 << 62
    starts = np.r_[0, np.cumsum(lengths + 1)][:-1]
    c = np.empty(len(which) + len(lengths), np.int64)
    last = np.zeros(len(c), bool)
    last[starts + lengths] = True
    c[last], c[~last] = table.end, code[which]
    after = np.minimum(c, len(table.counts))
    before = np.full((len(c), 2), BEGIN)
    before[1:, 1] = after[:-1]
    before[2:, 0] = after[:-2]
    before[starts] = BEGIN
    before[(starts + 1)[lengths > 0], 0] = BEGIN
    return c, before, after, starts


def shares_of(table: Table) -> np.ndarray:
    """Of the frequent words and of all others."""
    shares = np.append(table.counts + 0.5, table.rest)
    return shares / shares.sum()


def _moved(trainer: Trainer, start: Net) -> np.ndarray:
    """How far each row of the net's arrays has moved, times its steps; and the steps of each row. Zero where none has."""
    pairs = zip(trainer.net.arrays(), start.arrays(), trainer.touched, strict=True)
    moved = [((a - b).T * t).T.ravel() for a, b, t in pairs]
    return np.concatenate([*moved, *trainer.touched])


def train(docs: DataFrame, table: Table) -> Net:
    """A net from every position of all rows of ``docs``: each task learns from its own, from one start; each row of the nets'
    arrays is averaged over the tasks that moved it, by their steps.

    How many tasks learn goes by the number of tokens, not by how the table is dealt."""
    shares = shares_of(table)
    start = Net.start(shares)
    arrays = start.arrays()
    used = sum(a.size + len(a) for a in arrays)
    size = -(-used // gather.PARTS) * gather.PARTS
    shared = docs.sparkSession.sparkContext.broadcast((table, shares))
    types = fields(StructType.fromDDL(gather.SCHEMA))

    def run(batches):
        table, shares = shared.value
        start = trainer = None
        for batch in batches:
            for part in slices(batch, most_bytes=SLICE):
                if trainer is None:
                    start = Net.start(shares)
                    trainer = Trainer(start.copy(), shares, TaskContext.get().partitionId())
                trainer.learn(part.column("text"), table)
        if trainer:
            out = np.zeros(size, np.float32)
            out[:used] = _moved(trainer, start)
            for k, x in gather.parts(out):
                yield record_batch({"part": [k], "data": [x]}, types)

    texts = docs.select("text").coalesce(max(1, min(TRAINERS, table.total // TRAINER_TOKENS)))
    flat = gather.merged(texts.mapInArrow(run, gather.SCHEMA), size, "f4")
    at, steps = 0, np.split(flat[sum(a.size for a in arrays) : used], np.cumsum([len(a) for a in arrays])[:-1])
    for a, n in zip(arrays, steps, strict=True):
        moved = flat[at : at + a.size].reshape(len(a), a.size // max(1, len(a))) / np.maximum(n, 1)[:, None]
        a += moved.reshape(a.shape)
        at += a.size
    return start


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else x


def _counted(c: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the distinct codes among ``which`` and how often each occurs: where each text's begin and end, codes, times."""
    at = np.flatnonzero(which)
    text, own = np.searchsorted(starts, at, "right") - 1, c[at]
    order = np.lexsort((own, text))
    text, own = text[order], own[order]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])]) if len(own) else np.empty(0, np.int64)
    offsets = np.searchsorted(text[new], np.arange(len(starts) + 1)).astype(np.int32)
    return offsets, own[new], np.diff(new, append=len(own)).astype(np.int32)


def score(docs: DataFrame, table: Table, net: Net, counted: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, and n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((table, net))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType(StructType.fromDDL("row long").fields + kept + StructType.fromDDL("n_tokens long, n_known long, base double, model double, rare array<long>, times array<int>").fields)
    types = fields(schema)

    def run(batches):
        table, net = shared.value
        row, rest = TaskContext.get().partitionId() << 33, math.log10(table.rest)
        logs = np.log10(table.counts + 0.5)
        for batch in batches:
            for part in slices(batch, most_bytes=SLICE):
                c, before, after, starts = _numbered(part.column("text"), table)
                log_p = net.log_probabilities(before, after) / math.log(10)
                common = c < FREQUENT
                own = np.where(common, logs[np.where(common, c, 0)], 0)
                values = {"n_tokens": np.diff(starts, append=len(c)), "n_known": _sums(common.astype(np.int64), starts), "base": _sums(own, starts), "model": _sums(np.where(common, log_p, log_p - rest), starts)}
                offsets, found, times = _counted(c, starts, ~common)
                values |= {"rare": pa.ListArray.from_arrays(offsets, found - (1 << 62)), "times": pa.ListArray.from_arrays(offsets, times)}
                values["row"] = np.arange(row, row + len(starts))
                row += len(starts)
                yield record_batch({f.name: part.column(f.name) for f in kept} | values, types)

    rows = stored(docs.mapInArrow(run, schema), "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counted, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    more = F.coalesce("rare_log", F.lit(0.0))
    all_tokens = math.log10(table.total + 0.5 * (table.kinds + 1))
    return rows.join(found, "row", "left").select(*[f.name for f in kept], "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(table.total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * all_tokens).alias("base_score"), (F.col("model") + more).alias("score"))


def held_out_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text), learning
    from those whose crc32 of doc_id is not 1 modulo 5.

    A null or empty text is the end alone; rows without doc_id are learnt from; repeated rows have equal results; other
    columns are not looked at; an empty table gives an empty table. With nothing to learn from, base_score is by the
    formula with no counts, and the model is its start.

    Counts and training cover all training rows. Counts of the FREQUENT most frequent words go to all tasks; those of other
    words are joined by a hash of the word. The net has vectors of those frequent words, FREQUENT at most.
    """
    docs = docs.select("doc_id", (remainder(5) == 1).alias("held_out"), "text")
    learn = docs.where("not held_out")
    counted = stored(count(learn), "lm-counts")
    table = table_of(counted)
    return score(docs, table, train(learn, table), counted)
