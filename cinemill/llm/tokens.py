"""Token ids of whole texts with the tokenizers library, at a cache's speed.

Both vocabularies used here cut a text into pieces before any merge, and a piece's ids do not depend
on its neighbours. So each distinct piece goes through the library's model once per Python worker,
and words (what stands between spaces) are put together from pieces. Texts are cut, their words
coded as a dictionary and the ids laid out in text order by Arrow, so Python touches each distinct
word of some millions of characters once instead of every word. Texts for which the cut here could
differ from the library's (rare white space, letters whose lower case depends on context, words not
in normal form) go through the library whole, so the ids always equal those of
``Tokenizer.encode(text, add_special_tokens=False)``.

Defined cases: an empty text has no ids (but the end id where one is asked for); texts of any length
are encoded whole.
"""

from __future__ import annotations

import codecs
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from cinemill.llm.common import on_drop

#: Words and pieces a worker keeps; a full map starts afresh. It bounds memory and does not change ids.
WORDS, PIECES = 800_000, 700_000
#: The two vocabularies' own splitters (fixed values of their files).
KEEPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space other than the plain kinds, and letters whose lower case is no plain one.
RARE_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_CASE = "\u0130\u03a3"
#: Stand in for a line end at the head of a word, and between pieces; no text that is cut here holds them.
LINE, BETWEEN = "\x1c", "\x1d"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)).difference(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


LETTERS = _byte_letters()
LETTER_TABLE = "".join(LETTERS[b] for b in range(256))
_ENCODERS: dict[str, "WordCachedEncoder"] = {}
on_drop(_ENCODERS.clear)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "WordCachedEncoder":
    """The worker's encoder for a vocabulary file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]


class WordCachedEncoder:
    """Texts to ids of type ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.model = self.lib.model
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # With a normalizer that lowers case and a splitter that drops white space, words are all there is.
        self.drops_space = bool(self.lib.normalizer)
        self.split = regex.compile(DROPS_SPACE if self.drops_space else KEEPS_SPACE).findall
        self.words, self.pieces = {}, {}

    def _ids(self, text: str) -> bytes:
        found = self.lib.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, dtype=self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of pieces, each through the library's model once."""
        letters = codecs.charmap_decode(BETWEEN.join(pieces).encode(), "strict", LETTER_TABLE)[0].split(LETTERS[ord(BETWEEN)])
        kind, of, tokens = "H" if self.dtype.itemsize == 2 else "I", attrgetter("id"), self.model.tokenize
        self.pieces.update(zip(pieces, [array(kind, map(of, tokens(x))).tobytes() for x in letters]))

    def _can_cut(self, text: str) -> bool:
        """Whether no piece of the library's spans one of the cuts made here."""
        if not text.isascii() and any(c in text for c in RARE_SPACE):
            return False
        if any(c in text for c in RARE_SPACE[:6]):
            return False
        return self.drops_space or not ("  " in text or "\t" in text or "\r" in text or "\n \n" in text)

    @staticmethod
    def _cuts_lines(text: str) -> bool:
        """Whether every line end of a text that can be cut is a piece of its own between two words."""
        return "\n" in text and not ("\n\n" in text or "\n " in text or " \n" in text)

    def _parts(self, word: str) -> list[str] | None:
        """Pieces of a word, or None where only the library's normalizer tells them."""
        if not self.drops_space:
            if word[:1] == " ":
                if word[1:].isalpha():
                    return [word]
                if word[1:-1].isalpha() and word[-1] in ".,;:!?":
                    return [word[:-1], word[-1]]
            return self.split(word)
        if not word.isascii() and ("\u0130" in word or "\u03a3" in word or not unicodedata.is_normalized("NFC", word)):
            return None
        word = word.lower()
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [word[:-1], word[-1]]
        return self.split(word)

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.words) >= WORDS:
            self.words.clear()
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        known, pieces = self.words, self.pieces
        fresh = [w for w in words if w not in known]
        parts = [self._parts(w) for w in fresh]
        unknown = {p for ps in parts if ps for p in ps if p not in pieces}
        if unknown:
            self._learn(list(unknown))
        for w, ps in zip(fresh, parts):
            known[w] = self._ids(w) if ps is None else pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])
        return [known[w] for w in words]

    def encode_many(self, texts: Iterable[str], end_id: int | None = None, chars: int = 24_000_000) -> Iterator[np.ndarray]:
        """Ids of each text in order, with end_id after them if given; works on about ``chars`` characters at once."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= chars:
                yield from self._encode(held, end_id)
                held, size = [], 0
        yield from self._encode(held, end_id)

    def _encode(self, texts: list[str], end_id: int | None) -> Iterator[np.ndarray]:
        if not texts:
            return
        cut = [self._can_cut(t) for t in texts]
        lists = [t if c else "" for t, c in zip(texts, cut)]
        if self.drops_space:
            lists = pc.ascii_split_whitespace(pa.array(lists, pa.large_string()))
        else:
            lists = [t.replace("\n", " " + LINE) if self._cuts_lines(t) else t for t in lists]
            lists = pc.split_pattern(pa.array(lists, pa.large_string()), " ")
        starts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.drops_space:
            heads = [b""] * len(texts)
            skip = 0
        else:  # a text's first word has no space before it
            firsts = pc.list_element(lists, 0).to_pylist()
            distinct = list(set(firsts))
            heads = [*map(dict(zip(distinct, self._word_ids(distinct))).__getitem__, firsts)]
            words = ["\n" + w[1:] if w[:1] == LINE else " " + w for w in words]
            skip = 1
        laid = pa.array(self._word_ids(words), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(laid.buffers()[1], dtype=np.int64)[laid.offset : laid.offset + len(laid) + 1]
        raw = memoryview(laid.buffers()[2]) if laid.buffers()[2] else memoryview(b"")
        end = b"" if end_id is None else np.array([end_id], dtype=self.dtype).tobytes()
        for i, text in enumerate(texts):
            lo, hi = at[min(starts[i] + skip, starts[i + 1])], at[starts[i + 1]]
            yield np.frombuffer(heads[i] + bytes(raw[lo:hi]) + end if cut[i] else self._ids(text) + end, dtype=self.dtype)

    def encode_ids(self, text: str, end_id: int | None = None) -> np.ndarray:
        return next(self.encode_many([text], end_id))
