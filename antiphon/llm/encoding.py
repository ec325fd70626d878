"""Ids of whole texts by a public tokenizer file, with a cache of what stands between the tokenizer's own boundaries.

Both kinds of tokenizer here cut a text into small pieces (by letters, digits, marks and white space) and look at nothing
beyond a piece, so a text's ids are those of its pieces in a row, and most pieces come again and again. For texts of ASCII
and Latin-1 letters those pieces are found here; new ones are encoded many at a time, in one string that is cut again where
the ids show a piece's end. All other texts are encoded whole. The result is the tokenizer's own in every case.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_LEVEL, WORD_LEVEL = "byte level", "word level"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LETTERS, _SPACE = "A-Za-zÀ-ÖØ-öø-ÿ", r"\x20\x09-\x0D"
#: The tokenizers' pieces, for texts without ODD characters. Word level: of the text in lower case, without white space.
PIECES = {
    BYTE_LEVEL: f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+",
    WORD_LEVEL: f"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^{_SPACE}{_LETTERS}0-9]+",
}
#: Control characters that are white space to some, and all characters beyond ASCII but those letters.
ODD = "[\x1c-\x1f\x7f-\xbf×÷Ā-\U0010ffff]"
#: The cache has two generations of so many entries at most; pieces longer than this are not kept.
CACHE_ENTRIES, CACHE_CHARS, TOGETHER = 400_000, 48, 300


class Encoder:
    def __init__(self, path: str, level: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = re.compile("|".join([ODD, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())]))
        self.pieces = re.compile(PIECES[level])
        self.by_bytes = level == BYTE_LEVEL
        self.dtype = np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab()
        if self.dtype.itemsize == 2 and max(vocabulary.values()) >= 1 << 16:
            raise ValueError("this vocabulary needs 4 bytes an id")
        # Where ids are joined: at new lines (a piece of their own), or after ids that end a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.by_bytes:
            self.ends[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
        else:
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # The same model, for pieces that are cut and in lower case already.
        self.plain = Tokenizer(self.tokenizer.model)
        split = pre_tokenizers.Split("\n", "isolated") if self.by_bytes else pre_tokenizers.Split(" ", "removed")
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if self.by_bytes:
            out = dict(zip(blank := [x for x in new if x.isspace()], self._whole(blank)))
            new = [x for x in new if x not in out] if blank else new
        joint, after = ("\n", 0) if self.by_bytes else (" ", 1)
        width = self.dtype.itemsize
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            ids = np.array(self.plain.encode_batch_fast([joint.join(some) + joint], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + after
            if len(stops) != len(some):
                out.update(zip(some, self._whole(some)))
                continue
            raw = ids.tobytes()
            begins = np.concatenate([[0], stops[:-1] + 1 - after]) * width
            out.update(zip(some, map(raw.__getitem__, map(slice, begins.tolist(), (stops * width).tolist()))))
        return out

    def __call__(self, text: str) -> bytes:
        """The ids of a text, as bytes of the dtype."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        # Nothing here makes cycles, and looking for some among so many small objects takes a tenth of the time.
        on = gc.isenabled()
        gc.disable()
        try:
            return self._many(texts)
        finally:
            if on:
                gc.enable()

    def _many(self, texts: list[str]) -> list[bytes]:
        find, lower = self.pieces.findall, not self.by_bytes
        split = [None if self.odd.search(x) else find(x.lower() if lower else x) for x in texts]
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        wanted = set().union(*(x for x in split if x)).difference(young)
        long: list[str] = []
        if wanted:
            known = wanted & old.keys()
            young.update(zip(known, map(old.__getitem__, known)))
            wanted -= known
            learned = self._learn(list(wanted))
            long = [x for x in learned if len(x) > CACHE_CHARS]
            young.update(learned)
        get = young.__getitem__
        out = [self._whole([x])[0] if s is None else b"".join(map(get, s)) for x, s in zip(texts, split)]
        for x in long:
            del young[x]
        return out


_ENCODERS: dict[tuple[str, str, str], Encoder] = {}


def encoder(path: str, level: str, dtype: str = "<u4") -> Encoder:
    """One for each Python worker, which keeps its cache from task to task."""
    key = path, level, dtype
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
