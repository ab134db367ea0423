"""Token counts by the whole-token shortcut.

Offline proof: no vocabulary piece has a space mark after another character, so no merge crosses from a word into the
space before the next word; hence the tokens of a text are those of its pre-tokens (a run of spaces and the word after
it), each taken alone. Every vocabulary string that the library encodes alone as one token counts 1 by a table lookup;
only other pre-tokens are merged by the library.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_column
from .words import Cache

MARK = "▁"
_PRETOKENS = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_CROSSES = re.compile(f"[^{MARK}]{MARK}")
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        self.splits = not any(map(_CROSSES.search, pieces))
        whole = [p[1:] for p in pieces if p.startswith(MARK) and not re.search(f"[ {MARK}]", p[1:])]
        self.whole = {w: 1 for w, ids in zip(whole, self.sp.encode(whole, num_threads=1), strict=True) if len(ids) == 1}
        self.whole[""] = 1 if self.sp.piece_size() and len(self.sp.encode("a ")) == len(self.sp.encode("a")) + 1 else 0
        self.counts = Cache(lambda w: len(self.sp.encode(w)), self.whole)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.sp.encode(text))
        full = " " + text
        if "  " in full or MARK in full or full[-1] == " ":
            return sum(map(self.counts.__getitem__, [p[1:] for p in _PRETOKENS.findall(full)]))
        return sum(map(self.counts.__getitem__, text.split(" ")))


def counter(model_path: str) -> PieceCounter:
    if model_path not in _counters:
        _counters[model_path] = PieceCounter(model_path)
    return _counters[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; other columns are not looked at;
    an empty table gives an empty table. Texts of any length are counted whole. No shuffle.
    """

    def make():
        c = counter(model_path)

        def work(texts):
            n = [c.count(t) for t in texts]
            c.counts.trim()
            return {"n_tokens": n}

        return work

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return map_column(rows, "text", "n_tokens long", make).withColumn("over_limit", F.col("n_tokens") > limit)
