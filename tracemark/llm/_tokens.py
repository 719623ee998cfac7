"""Whole-text encoding by the tokenizers library, with each distinct piece encoded once per worker.

Both public vocabularies first split a text by a published pattern and then merge bytes inside each
part, so the ids of a text are the ids of its parts in turn.  Here the split is done first, known
parts come from a table of bounded size, and the library encodes the new ones together, divided by a
control character that no merge contains.  The split is used only where it is certain to be the
library's own (Latin letters, ASCII digits, common punctuation); all other texts are encoded whole, and so
are those that hold the spelling of an added token (as <|endoftext|>), which the library makes one id of.
"""

from __future__ import annotations

import os
import re

import numpy as np

_DIVIDER = "\x01"
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Characters outside this set send a text to the library as a whole.
_UNSURE = re.compile(f"[^\\t-\\r -~{_LETTER}\u00a1\u00bf\u00a7\u00ab\u00bb\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac]")
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
_KEEPING = f"{_SUFFIX}| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+"
_DROPPING = f"{_SUFFIX}|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+"
#: Two generations of at most so many pieces each are held (about 0.2 KB a piece).
CACHE_PIECES = 350_000


class PieceEncoder:
    """ids(texts) -> per text the little-endian unsigned 32-bit ids as bytes; no special tokens added.

    ``keeps_blanks``: white space is part of the ids (byte-level vocabularies), else it is dropped.
    """

    def __init__(self, path: str, keeps_blanks: bool, cache_pieces: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("(?i:" + "|".join(map(re.escape, added)) + ")").search if added else None
        self.mark = re.match("[^A-Za-z]*", os.path.commonprefix(added))[0]  # stands in every spelling of one; quick to look for
        self.keeps_blanks = keeps_blanks
        self.cache_pieces = cache_pieces or CACHE_PIECES
        self.pieces = re.compile(_KEEPING if keeps_blanks else _DROPPING).findall
        self.glue = _DIVIDER if keeps_blanks else f" {_DIVIDER} "
        ids = self.tokenizer.encode(_DIVIDER, add_special_tokens=False).ids
        self.divider = ids[0] if len(ids) == 1 else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _unsure(self, text: str) -> bool:
        return _UNSURE.search(text) is not None or (self.added is not None and self.mark in text and self.added(text) is not None)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, new: list[str]) -> None:
        plain, alone = [], []
        for p in new:
            lone = self.divider is None or p[0] == "'" or (self.keeps_blanks and p[-1].isspace())
            (alone if lone else plain).append(p)
        if plain:
            text = self.glue.join(plain) + self.glue
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.divider)
            if len(at) != len(plain):
                alone += plain
            else:
                raw, start = ids.tobytes(), 0
                for p, end in zip(plain, at.tolist()):
                    self.cache[p] = raw[4 * start : 4 * end]
                    start = end + 1
        if alone:
            self.cache.update(zip(alone, self._whole(alone)))

    def ids(self, texts: list[str]) -> list[bytes]:
        have = self.cache
        if len(have) > self.cache_pieces:
            self.older, self.cache = have, {}
            have = self.cache
        odd = [i for i, t in enumerate(texts) if self._unsure(t)]
        whole = dict(zip(odd, self._whole([texts[i] for i in odd]))) if odd else {}
        cut = [[] if i in whole else self.pieces(t if self.keeps_blanks else t.lower()) for i, t in enumerate(texts)]
        known = set().union(*cut)
        known.difference_update(have)
        new = []
        for p in known:
            old = self.older.get(p)
            if old is None:
                new.append(p)
            else:
                have[p] = old
        for k in range(0, len(new), 50_000):
            self._learn(new[k : k + 50_000])
        get = have.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, c)) for i, c in enumerate(cut)]


_KEPT: dict[tuple[str, bool, int | None], PieceEncoder] = {}


def encoder(path: str, keeps_blanks: bool, cache_pieces: int | None = None) -> PieceEncoder:
    """The task's encoder; a worker keeps it for its next tasks."""
    key = (path, keeps_blanks, cache_pieces)
    if key not in _KEPT:
        _KEPT[key] = PieceEncoder(path, keeps_blanks, cache_pieces)
    return _KEPT[key]
