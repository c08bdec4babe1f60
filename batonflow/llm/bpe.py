"""Exact, cached access to a `tokenizers` BPE whose pre-tokens never span white space.

A text is cut at white space into chunks, a chunk into pre-tokens, and only a
pre-token that this process does not remember is given to the BPE model.
Anything outside Latin-1 goes through the tokenizer's own normaliser and
pre-tokenizer, so the ids are those of ``Tokenizer.encode``.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from itertools import groupby

import numpy as np

# Fixed values of the vocabulary file: its Split pattern restricted to lower-case Latin-1.
_LETTER, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")
# White space as the tokenizer's pattern has it; str.split() also cuts at U+001C..U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
# The pieces of a whole text of Latin-1: as _PIECES, but white space is in none.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}\t-\r \x85\xa0]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Bpe:
    """Pre-tokens of a text, and the ids of a pre-token, for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        letters = byte_letters()
        self._latin = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._model = self.tokenizer.model

    def chunks(self, text: str) -> list[str]:
        """White-space chunks, in order; a special string is a chunk of its own."""
        if "<|" in text and self._special.search(text):
            out: list[str] = []
            at = 0
            for m in self._special.finditer(text):
                out += [*self.chunks(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.chunks(text[at:])
        return [x for x in _SPACE.split(text) if x] if _ODD.search(text) else text.split()

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk, in byte letters."""
        if chunk.isascii() and chunk.isprintable():
            return _PIECES.findall(chunk.lower())
        if max(chunk) < "Ā":
            return [w.translate(self._latin) for w in _PIECES.findall(chunk.lower())]
        t = self.tokenizer
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk))]

    def keys(self, text: str) -> list[str]:
        """The text in strings that have their ids each for itself: pre-tokens, special strings, and chunks with anything outside Latin-1."""
        if "<|" in text and self._special.search(text):
            out: list[str] = []
            at = 0
            for m in self._special.finditer(text):
                out += [*self.keys(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.keys(text[at:])
        if _latin(text):
            return _WORDS.findall(text.lower())
        return [k for chunk in self.chunks(text) for k in (_WORDS.findall(chunk.lower()) if _latin(chunk) else (chunk,))]

    def word_ids(self, word: str) -> list[int]:
        return [t.id for t in self._model.tokenize(word)]


class IdCache(dict):
    """pre-token -> its ids as little-endian uint32 bytes, in about `most` bytes.

    A chunk with anything outside Latin-1 has an entry as a whole. There are two
    generations of half the size: what the older one has and is asked for moves to the
    newer, and when that is full it becomes the older one.
    """

    #: What an entry weighs beside its characters and ids: two objects and a slot of the table.
    ENTRY = 220

    def __init__(self, bpe: Bpe, most: int = 32 << 20):
        self.bpe, self.most, self.old, self.held = bpe, most, {}, 0

    def __missing__(self, key: str) -> bytes:
        if (found := self.old.get(key)) is None:
            found = self._made(key)
        if len(key) <= 200:
            if self.held > self.most // 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = found
            self.held += self.ENTRY + 2 * len(key) + len(found)
        return found

    def _made(self, key: str) -> bytes:
        if key.isascii() and key.isalpha():  # most are, and are their own byte letters
            return array("I", self.bpe.word_ids(key)).tobytes()
        if key in self.bpe.specials:
            return array("I", [self.bpe.specials[key]]).tobytes()
        return b"".join(array("I", self.bpe.word_ids(w)).tobytes() for w in self.bpe.words(key))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.bpe.keys(text)))


#: Classes of the characters of Latin-1: white space, letters, digits, others, and controls, which make their chunk odd.
_GAP, _LETTERS, _DIGITS, _OTHER, _CONTROL = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(32), *range(127, 160)]] = _CONTROL
for _c in range(256):
    if re.match(f"[{_LETTER}]", chr(_c).lower()):
        _CLASS[_c] = _LETTERS
    elif re.match(f"[{_DIGIT}]", chr(_c)):
        _CLASS[_c] = _DIGITS
_CLASS[[32, *range(9, 14), 0x85, 0xA0]] = _GAP
_LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
#: The bytes of a little-endian word that a pre-token of so many bytes has.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of text that are cut at once, if there is white space to cut at.
SLICE = 256 << 10


def _pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text in lower case, starts, ends, odd) of the pre-tokens; a chunk with a control character or with "<|" is one odd piece.

    `data` is Latin-1 and ends in 8 blanks.
    """
    kind, low = _CLASS[data], _LOWER[data]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    full = kind != _GAP
    start = full & ((kind != before) | (kind == _DIGITS))
    # A contraction is a piece of its own where its apostrophe opens one.
    at = np.flatnonzero((data == 39) & (before != _OTHER))
    one, two = low[at + 1], low[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    for found, n in ((at[short], 2), (at[long], 3)):
        start[found + 1] = False
        start[found + n] = full[found + n]
    odd = np.flatnonzero((kind == _CONTROL) | (data == 60) & (np.append(data[1:], 32) == 124))
    inside = None
    if len(odd):
        gaps = np.concatenate([[-1], np.flatnonzero(~full)])
        k = np.unique(np.searchsorted(gaps, odd))
        edge = np.zeros(len(data) + 1, np.int8)
        edge[gaps[k - 1] + 1], edge[gaps[k]] = 1, -1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        start &= ~inside
        start[gaps[k - 1] + 1] = True
    cut = np.flatnonzero(start | ~full & (before != _GAP))
    opens = start[cut]
    starts, ends = cut[opens], np.append(cut[1:], len(data))[opens]
    return low, starts, ends, np.zeros(len(starts), bool) if inside is None else inside[starts]


def encode_all(ids: IdCache, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, how many each has), in whole-array steps where a text is Latin-1.

    Pre-tokens of up to 8 characters are told apart as 64-bit numbers, which they are
    without loss, and each is asked for once a slice; longer ones and odd chunks are
    asked for each for itself.
    """
    counts, found, k = np.zeros(len(texts), np.int64), [np.empty(0, np.uint32)], 0
    for plain, run in groupby(texts, _latin):
        run = list(run)
        if plain:
            flat, n = _encode_latin(ids, [t.encode("latin-1") for t in run])
            found += flat
        else:
            made = [ids.encode(t) for t in run]
            n = np.fromiter(map(len, made), np.int64, len(made)) // 4
            found.append(np.frombuffer(b"".join(made), np.uint32))
        counts[k : k + len(run)] = n
        k += len(run)
    return np.concatenate(found), counts


def _encode_latin(ids: IdCache, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    # Texts end in a blank, which no pre-token spans.
    whole, until = b" ".join([*texts, b" " * 8]), np.cumsum([len(t) + 1 for t in texts])
    counts, found, a, n = np.zeros(len(texts), np.int64), [], 0, len(whole) - 8
    while a < n:
        z = n if n - a <= SLICE else whole.rfind(b" ", a, a + SLICE) + 1 or whole.find(b" ", a + SLICE) + 1
        flat, length, starts = _slice(ids, whole[a:z] + b" " * 8)
        counts += np.bincount(np.searchsorted(until, starts + a, side="right"), weights=length, minlength=len(texts)).astype(np.int64)
        found.append(flat)
        a = z
    return found, counts


def _slice(ids: IdCache, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, how many each piece has, where each starts)."""
    data = np.frombuffer(text, np.uint8)
    low, starts, ends, odd = _pieces(data)
    size = ends - starts
    brief = ~odd & (size <= 8)
    words = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))[starts[brief]] & _FIRST[size[brief]]
    kinds, which = np.unique(words, return_inverse=True)
    lower, ask = low.tobytes(), ids.__getitem__
    made = [ask(k.rstrip(b"\0").decode("latin-1")) for k in (int(w).to_bytes(8, "little") for w in kinds.tolist())]
    rest = np.flatnonzero(~brief)
    for a, z, strange in zip(starts[rest].tolist(), ends[rest].tolist(), odd[rest].tolist(), strict=True):
        made.append(ids.encode(text[a:z].decode("latin-1")) if strange else ask(lower[a:z].decode("latin-1")))
    of_kind = np.fromiter(map(len, made), np.int64, len(made)) // 4
    flat, offset = np.frombuffer(b"".join(made), np.uint32), np.cumsum(of_kind) - of_kind
    piece = np.empty(len(starts), np.int64)
    piece[brief], piece[rest] = which, len(kinds) + np.arange(len(rest))
    length = of_kind[piece]
    place = np.repeat(offset[piece] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return flat[place], length, starts


@cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


@cache
def id_cache(path: str) -> IdCache:
    """One per Python worker, which Spark reuses from task to task."""
    return IdCache(bpe(path))
