"""Token ids of whole Arrow text columns with a public byte-level BPE vocabulary.

The JSON file of the tokenizers library is read for its vocabulary; merges of such
files stand in the order of the ids they make, so a rank-based encoder gives the same
ids. Text is cut in units, a run of ASCII white space with the word after it, which the
vocabulary's pre-tokenizer never joins; each distinct unit is encoded once and kept in
a cache of bounded size. Texts with other white space than ASCII's, or with a special token, are
encoded whole.

As with the library's defaults, the string of a special token in a text is that token. With
special=False it is ordinary text."""

from __future__ import annotations

import json
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import tiktoken

from .words import NOT_SPACE, WordHash, cuts

DEFAULT = "byte_bpe_50k.json"
_HASH = WordHash(10)
CACHE = 400_000  # distinct units that a worker keeps
_ODD_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]


def _byte_of_char() -> dict[str, int]:
    """The usual alphabet of byte-level vocabularies: printable bytes stand for themselves, others for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    tokens = {t["content"]: t["id"] for t in file.get("added_tokens", []) if t.get("special")}
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in tokens}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=tokens if special else {})


def encode_with(enc: tiktoken.Encoding):
    """A function from text to ids, special tokens that enc has included."""
    return partial(enc.encode, allowed_special="all") if enc.special_tokens_set else enc.encode_ordinary


class UnitEncoder:
    """Token counts or ids of units, each encoded once."""

    def __init__(self, path: str, special: bool = True):
        enc = encoder(path, special)
        self.encode = encode_with(enc)
        self.odd = [*_ODD_SPACE, *(t.encode() for t in enc.special_tokens_set)]
        self.lengths = np.zeros(enc.max_token_value + 1, np.int64)
        for token in enc.token_byte_values():
            self.lengths[enc.encode_single_token(token)] = len(token)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, h: np.ndarray, units, joined: np.ndarray) -> None:
        """Encodes the units of hashes that aren't known. units: bytes, and of each hash where its unit starts and ends there.

        joined: units from white space to a word's end; any number of them in a row is cut
        again where they meet, so all of them are encoded in one call."""
        new = np.flatnonzero(~self._has(h))
        if not len(new):
            return
        if len(self.known) + len(new) > CACHE and len(self.known):
            self.clear()
            new = np.arange(len(h))
        new = np.concatenate([new[joined[new]], new[~joined[new]]])
        m = int(joined[new].sum())
        data, a, b = units
        size = (b - a)[new[:m]]
        together = data[np.arange(int(size.sum())) + np.repeat(a[new[:m]] - (np.cumsum(size) - size), size)].tobytes()
        ids = np.array(self.encode(together.decode()), np.int64)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(size)) + 1 if m else np.zeros(0, np.int64)
        alone = [self.encode(data[a[k] : b[k]].tobytes().decode("utf-8", "replace")) for k in new[m:]]
        n = np.concatenate([np.diff(ends, prepend=0), [len(i) for i in alone]]).astype(np.int64)
        flat = np.concatenate([ids, [t for i in alone for t in i]]).astype(np.uint32)
        start = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, flat])
        order = np.argsort(h[new])
        at = np.searchsorted(self.known, h[new][order])
        self.start, self.size = np.insert(self.start, at, start[order]), np.insert(self.size, at, n[order])
        self.known = np.insert(self.known, at, h[new][order])

    def _has(self, h):
        if not len(self.known):
            return np.zeros(len(h), bool)
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return self.known[at] == h

    def places(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.known, h)


def units(data: np.ndarray, offs: np.ndarray):
    """Starts and ends of units, and each row's first unit: every row is cut before white space that follows a word."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[1:] = NOT_SPACE[data]
    begin = ~word[1:] & word[:-1] if n else np.zeros(0, bool)
    begin[np.unique(offs[:-1][np.diff(offs) > 0])] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offs)


def plain(data: np.ndarray, offs: np.ndarray, odd: list[bytes]) -> np.ndarray:
    """Rows that can be cut in units: those without the strings `odd`, white space other than ASCII's and special tokens."""
    ok = np.ones(len(offs) - 1, bool)
    raw = data.tobytes()
    for s in odd:
        at = raw.find(s)
        while at >= 0:
            row = int(np.searchsorted(offs, at, "right")) - 1
            ok[row] = False
            at = raw.find(s, int(offs[row + 1]))
    return ok


def _known(enc: UnitEncoder, data: np.ndarray, offs: np.ndarray):
    """Starts of units, each row's first, and the place of each unit in the encoder."""
    starts, ends, first = units(data, offs)
    h = _HASH(data, starts, ends)
    u, at, back = np.unique(h, return_index=True, return_inverse=True)
    regular = np.zeros(0, bool)
    if len(u):
        fine = plain(data, offs, enc.odd)
        regular = ~NOT_SPACE[data[starts[at]]] & NOT_SPACE[data[ends[at] - 1]] & fine[np.searchsorted(first, at, "right") - 1]
    enc.learn(u, (data, starts[at], ends[at]), regular)
    return starts, first, enc.places(u)[back]


def unit_sizes(enc: UnitEncoder, data: np.ndarray, offs: np.ndarray):
    """Starts of units, each row's first, and the tokens of each unit; right for rows that are plain()."""
    starts, first, place = _known(enc, data, offs)
    return starts, first, enc.size[place]


def encoded(enc: UnitEncoder, data: np.ndarray, offs: np.ndarray):
    """Ids of all rows, one after the other, and each row's first id."""
    _, first, place = _known(enc, data, offs)
    size, begin = enc.size[place], enc.start[place]
    total = np.concatenate([[0], np.cumsum(size)])
    ids = enc.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
    row = total[first]
    odd = np.flatnonzero(~plain(data, offs, enc.odd))
    if len(odd):
        parts = [ids[row[k] : row[k + 1]] for k in range(len(row) - 1)]
        for k in odd:
            parts[k] = np.array(enc.encode(data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
        ids = np.concatenate(parts)
        row = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return ids, row


SLICE = 1 << 20


def slices(data: np.ndarray, offs: np.ndarray):
    for lo, hi in cuts(offs, SLICE):
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
