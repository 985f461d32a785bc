"""Token ids of the ``tokenizers`` library, fast enough for whole corpora.

The vocabulary file used here drops white space and never joins across it, so
a text's ids are its words' ids one after another.  A task keeps the ids of
words that it has met, in two generations of at most ``CACHE_BYTES / 2`` each,
and frees them when it ends; an operator may let the worker keep them for its
next task, in a room of its own choice.  A
new word of plain letters, digits and punctuation is cut into the vocabulary's
pieces, and the library's BPE model gives the ids of each new piece; any other
new word goes through the library whole.  Equality with encoding each whole
text is tested.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

CACHE_BYTES = 64 << 20  # of remembered words and pieces: keys, values and their share of the dictionaries
ENTRY_BYTES = 120  # of a remembered word besides its letters and ids: two objects' heads, and a place in a dictionary
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Encode texts to little-endian ids, of 2 bytes if the vocabulary fits."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if "[^\\\\s\\\\p{L}\\\\p{N}]+" not in json.dumps(spec["pre_tokenizer"]) \
                or {"type": "Lowercase"} not in spec["normalizer"].get("normalizers", []):
            raise ValueError(f"{path}: its words are not known to be independent of each other")
        self.model, self.letters = self.library.model, _byte_letters()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.id_bytes = [i.tobytes() for i in np.arange(self.library.get_vocab_size(True), dtype=self.dtype)]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.used = 0  # bytes of the young generation
        self.room = 0  # bytes of both generations; 0: CACHE_BYTES

    def _model_ids(self, letters: str) -> bytes:
        one = self.id_bytes
        return b"".join([one[t.id] for t in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that is not among the remembered ones; a bare word of the same letters has them too."""
        raw = piece.encode()
        got = self.young.get(raw)
        if got is None:
            got = self._model_ids(piece if len(raw) == len(piece) and raw.isalpha()
                                  else raw.decode("latin-1").translate(self.letters))
        self.pieces[piece] = got
        self.used += ENTRY_BYTES + len(piece) + len(got)
        return got

    def _learn(self, words: set[bytes]) -> None:
        young, old, pieces, whole = self.young, self.old, self.pieces, []
        new = added = list(words.difference(young))
        if old:
            young.update([(w, old[w]) for w in new if w in old])
            new = [w for w in new if w not in young]
        mixed = []
        for w, s in zip(new, b"\n".join(new).decode().split("\n")):  # words hold no line break
            if w.isalpha() and w.islower():  # one piece of ASCII letters, which stand for themselves
                got = pieces.get(s)
                young[w] = self._model_ids(s) if got is None else got
            else:
                mixed.append((w, s))
        known, cut, plain = pieces.__getitem__, _PIECES.findall, _PLAIN.fullmatch
        for w, s in mixed:  # after the bare words, whose ids they share
            if plain(s) and "<|" not in s:
                found = cut(s.lower())
                for p in found:
                    if p not in pieces:
                        self._piece(p)
                young[w] = known(found[0]) if len(found) == 1 else b"".join(map(known, found))
            else:
                whole.append((w, s))
        if whole:
            for (w, _), e in zip(whole, self.library.encode_batch_fast([s for _, s in whole],
                                                                       add_special_tokens=False)):
                young[w] = np.array(e.ids, self.dtype).tobytes()
        self.used += ENTRY_BYTES * len(added) + sum(map(len, added)) + sum(map(len, map(young.__getitem__, added)))

    def forget(self) -> None:
        """Free the remembered words."""
        self.young, self.old, self.pieces, self.used = {}, {}, {}, 0

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts.  ASCII letters are lowered first, unless the word holds
        a combining mark or a special token's opening, where that could matter."""
        if self.used > (self.room or CACHE_BYTES) // 2:
            self.old, self.young, self.pieces, self.used = self.young, {}, {}, 0
        split = []
        for t in texts:
            if b"<|" in t or b"\xcc" in t or b"\xcd" in t:
                split.append([w if b"<|" in w or b"\xcc" in w or b"\xcd" in w else w.lower() for w in t.split()])
            else:
                split.append(t.lower().split())
        self._learn(set(chain.from_iterable(split)))
        ids = self.young.__getitem__
        return [b"".join(map(ids, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget_all() -> None:
    """Free the words that this worker's encoders remember."""
    for enc in _encoders.values():
        enc.forget()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
