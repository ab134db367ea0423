"""Token ids of whole texts, kept as little-endian 32-bit bytes: a library's merges, done once for each pre-token."""

from __future__ import annotations

import os
import re

import numpy as np

from .words import Cache

# The file's pattern for pre-tokens, for letters of ASCII and Latin-1 only; such texts are normal already
# but for case.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall
_encoders: dict[str, SpacedEncoder] = {}


class SpacedEncoder:
    """For a tokenizer that drops white space, a text's ids are those of its pre-tokens.

    Texts of plain letters are cut into pre-tokens by the pattern; of other texts, each part between spaces that is not
    plain goes to the library as it is, which normalises it and sees special tokens in it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.mark = min((x for x in special if "<|" in x[0]), default=None)
        self.ids = Cache(lambda w: self._many([w])[0], most=800_000)

    def _many(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Words go to the library joined by a special token, which no merge crosses; its id parts
        what comes back. Words that may hold a special token go alone."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if "<|" not in w] if self.mark else []
        groups = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        for group, found in zip(groups, self._ids([self.mark[0].join(g) for g in groups]), strict=True):
            cuts = [-1, *np.flatnonzero(found == self.mark[1]).tolist(), len(found)]
            data = found.tobytes()
            out.update((w, data[4 * (a + 1) : 4 * b]) for w, a, b in zip(group, cuts[:-1], cuts[1:], strict=True))
        alone = [w for w in words if w not in out]
        out.update(zip(alone, (x.tobytes() for x in self._ids(alone)), strict=True))
        return [out[w] for w in words]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _parts(text: str) -> list[str]:
        if _PLAIN(text) and "<|" not in text:
            return _PRETOKENS(text.lower())
        out: list[str] = []
        for part in text.split(" "):
            if _PLAIN(part) and "<|" not in part:
                out += _PRETOKENS(part.lower())
            elif part:
                out.append(part)
        return out

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and then ``end``; parts unseen so far go to the library in one call."""
        tail = np.array([end], "<u4").tobytes()
        parts = [self._parts(t or "") for t in texts]
        self.ids.learn(set().union(*parts), self._many)
        out = [b"".join(map(self.ids.__getitem__, p)) + tail for p in parts]
        self.ids.trim()
        return out


def encoder(path: str) -> SpacedEncoder:
    if path not in _encoders:
        _encoders[path] = SpacedEncoder(path)
    return _encoders[path]
