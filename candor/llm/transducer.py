"""BPE as a streaming transducer with bounded lookahead, and its inverse.

Encoding. A text passes in chunks through four stages, each of which holds back what later text can still change:
special tokens (a suffix that could begin one), normalisation (from the last character that never joins the one
before it), pre-tokens (three characters) and BPE. BPE holds back `lookahead` symbols: tokens that end before are stable,
whatever follows. Text is cut at ASCII white space, which no stage looks across; a short unit between two
cuts, and each of its pre-tokens, takes its ids from a cache of bounded size; a longer one is streamed. So besides the row itself and the cache
a task holds a few kilobytes, at any length of text or word.

Lookahead. BPE applies merges in the order of their rank. Let two texts agree before a place. Their symbols can first
differ there. A merge (x, y) that only one of them makes moves the difference from the start of y to the start of x, and the
merge that moves it on must rank later and have a right part that starts with x. So the difference moves by at most the
largest sum of len(x) over such chains of merges; one pass over the merge list finds it (667 symbols for the
list used by default, whose longest token has 32). This needs a list in which each merge's parts are made by earlier merges; others are refused.
Left of a token boundary nothing depends on what is right of it, so stable tokens leave the buffer.

Decoding. Ids go to bytes, and bytes to text by an incremental UTF-8 state machine that holds at most three bytes of an
unfinished character; bytes that are no UTF-8 become U+FFFD. As in the library, a file without a decoder gives the
tokens' names with a space between; plain=True gives the text of the tokens' bytes instead, with a space for each word's end.

Normaliser and pre-tokenizer are the library's own, applied to the stretches that the stages release. Special
tokens: as with the library's defaults their strings in a text are those tokens.

Nulls: a null text is empty and has no tokens; a null doc_id stays null. Texts of any length are read whole. A run of
combining marks is one stretch for the normaliser, at any length. Repeated rows give a result each, an empty table an
empty one. Other columns are not read, whatever their names. Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import _byte_of_char
from .shared import lean, small_batches
from .words import utf8

DEFAULT = "word_bpe_49k.json"
CHUNK = 1 << 16  # bytes of text, or ids, that go through the stages at once
BLOCK = 4096  # symbols beyond the lookahead that BPE gathers before it merges
CACHE = 400_000  # units, and as many pre-tokens, of which a worker keeps the ids
UNIT = 128  # bytes of the longest unit that is kept
SHORT = 32  # symbols that are merged by a plain search
#: The pre-tokens of text in printable ASCII, in lower case, without white space
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SPACES = b" \t\n\r\x0b\x0c"


class Merges:
    """A merge list: ids, ranks and its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.lookahead = self._sufficient(merges)

    def _sufficient(self, merges: list[tuple[str, str]]) -> int:
        size = lambda t: len(t.removesuffix(self.suffix) if self.suffix else t)
        left: dict[str, tuple[str, ...]] = {}  # of each merged token: itself and what it starts with, down to a symbol
        reach: dict[str, int] = {}  # of each token x: the furthest that a chain ending in a merge (x, y) moves a difference
        most = 0
        for x, y in merges:
            for part in (x, y):
                if part not in left and size(part) > 1:
                    raise ValueError(f"the merge of {x!r} and {y!r} comes before one that makes {part!r}")
            far = size(x) + max((reach.get(p, 0) for p in left.get(y, (y,))), default=0)
            reach[x] = max(reach.get(x, 0), far)
            left.setdefault(x + y, (*left.get(x, (x,)), x + y))
            most = max(most, far)
        return most

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of a run of symbols: always the merge of the lowest rank, the leftmost of equal ones."""
        rank, n = self.rank, len(symbols)
        if n <= SHORT:
            return self._merge_short(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, a = heapq.heappop(heap)
            b = after[a]
            if symbols[a] is None or b >= n or rank.get((symbols[a], symbols[b])) != r:
                continue
            symbols[a] += symbols[b]
            symbols[b] = None
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (s := rank.get((symbols[a], symbols[c]))) is not None:
                    heapq.heappush(heap, (s, a))
            if (p := before[a]) >= 0 and (s := rank.get((symbols[p], symbols[a]))) is not None:
                heapq.heappush(heap, (s, p))
        return [s for s in symbols if s is not None]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        get, last = self.rank.get, len(self.rank)
        ranks = [get(p, last) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (r := min(ranks)) < last:
            k = ranks.index(r)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((symbols[k - 1], symbols[k]), last)
            if k < len(ranks):
                ranks[k] = get((symbols[k], symbols[k + 1]), last)
        return symbols


class Cache(dict):
    """What `make` gives for a key, kept for up to `most` keys: when half of them are new, those not asked for since then go."""

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.half, self.longest, self.old = make, most // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceStream:
    """The tokens of one pre-token that comes in parts."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, ""

    def feed(self, symbols: str) -> list[str]:
        """Tokens that are stable now. The last symbol can still become a word's last, so it counts as unknown."""
        self.held += symbols
        if len(self.held) <= self.merges.lookahead + 1 + BLOCK:
            return []
        stable, out, at = len(self.held) - 1 - self.merges.lookahead, [], 0
        for token in self.merges.merge(list(self.held)):
            if at + len(token) > stable:
                break
            at += len(token)
            out.append(token)
        self.held = self.held[at:]
        return out

    def end(self) -> list[str]:
        held, self.held = self.held, ""
        return self.merges.merge([*held[:-1], held[-1] + self.merges.suffix]) if held else []


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that normalisation can join with the one before: second ones of compositions, Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(second | {chr(c) for c in range(0x1161, 0x1176)} | {chr(c) for c in range(0x11A8, 0x11C3)})


def _cut(text: str) -> int:
    """The last place before which normalisation is finished; 0 if there is none."""
    for k in range(len(text) - 1, 0, -1):
        c = text[k]
        if c < "\x80" or (unicodedata.combining(first := unicodedata.normalize("NFD", c)[0]) == 0 and first not in _joining()):
            return k
    return 0


class UnitStream:
    """The ids of text without ASCII white space that comes in parts."""

    def __init__(self, model: Model):
        self.m = model
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.raw = self.form = self.norm = ""  # held back for special tokens, for normalisation, for pre-tokens
        self.run = ""  # of a pre-token that has gone on in part: a letter if it is of letters, else a mark
        self.piece = PieceStream(model.merges)

    def feed(self, data: bytes, last: bool = False) -> list[int]:
        self.raw += self.utf8.decode(data, last)
        out: list[int] = []
        while found := min(((at, t) for t in self.m.special if (at := self.raw.find(t)) >= 0), default=None):
            at, token = found
            out += self._normalise(self.raw[:at], True)
            out.append(self.m.special[token])
            self.raw = self.raw[at + len(token) :]
        keep = 0 if last else max((k for t in self.m.special for k in range(1, len(t)) if self.raw.endswith(t[:k])), default=0)
        ready = self.raw[: len(self.raw) - keep]
        self.raw = self.raw[len(ready) :]
        return out + self._normalise(ready, last)

    def _normalise(self, text: str, last: bool) -> list[int]:
        self.form += text
        at = len(self.form) if last else _cut(self.form)
        ready, self.form = self.form[:at], self.form[at:]
        if ready:
            self.norm += self.m.normalise(ready)
        return self._pieces(last)

    def _pieces(self, last: bool) -> list[int]:
        """Pre-tokens of what is normalised. One that later text can still change waits; a long run goes on in part."""
        text, out, at = self.norm, [], 0
        certain = len(text) if last else len(text) - 3
        if self.run:
            goes_on = self.m.pieces(self.run + text)[0][1][1] - 1
            at = max(0, min(goes_on, certain))
            out += self._ids(self.piece.feed(self.m.symbols(text[:at])))
            if goes_on > certain:
                self.norm = text[at:]
                return out
            out += self._ids(self.piece.end())
            self.run = ""
        begin = at
        for symbols, (a, b) in self.m.pieces(text[begin:]):
            a, b = a + begin, b + begin
            if b <= certain:
                out += self._ids(self.piece.feed(symbols) + self.piece.end())
                continue
            at = a
            if certain - a > UNIT:
                self.run = "a" if len(self.m.pieces("a" + text[a])) == 1 else "!"
                out += self._ids(self.piece.feed(self.m.symbols(text[a:certain])))
                at = certain
            break
        else:
            at = len(text)
        self.norm = text[at:]
        return out

    def _ids(self, tokens: list[str]) -> list[int]:
        return [self.m.merges.vocab[t] for t in tokens]


class Model:
    """A tokenizers file: its merges, and the library's own normaliser and pre-tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no byte-level BPE file that this transducer can follow")
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        if [a for _, a in self.pieces("a b")] != [(0, 1), (2, 3)]:
            raise ValueError(f"the pre-tokenizer of {path} keeps white space, at which this transducer cuts")
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.symbol = {b: c for c, b in _byte_of_char().items()}
        self.names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.decoder = (file.get("decoder") or {}).get("type")
        self.units, self.known = Cache(self.unit, CACHE, UNIT), Cache(self.piece, CACHE)
        self.ascii = self._agrees()

    def _agrees(self) -> bool:
        """Whether the file treats printable ASCII as _ASCII and lower case do."""
        text = "".join(map(chr, range(33, 127)))
        sample = text + "It'sWE'VEi'mA1'llX'd''re!'t?" + "'".join(text)
        return [p for p, _ in self.pieces(self.normalise(sample))] == _ASCII.findall(sample.lower())

    def piece(self, symbols: str) -> bytes:
        """Ids of a whole pre-token."""
        return _packed([self.merges.vocab[t] for t in self.merges.merge([*symbols[:-1], symbols[-1] + self.merges.suffix])])

    def unit(self, unit: bytes) -> bytes:
        """Ids of text without ASCII white space."""
        text = unit.decode("utf-8", "replace")
        if len(unit) > UNIT or any(t[:2] in text for t in self.special):
            return _packed(UnitStream(self).feed(unit, True))
        if self.ascii and text.isascii() and text.isprintable():
            return b"".join([self.known[p] for p in _ASCII.findall(text.lower())])
        return b"".join([self.known[p] for p, _ in self.pieces(self.normalise(text))])

    def symbols(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.symbol)

    def token_bytes(self, plain: bool) -> dict[int, bytes]:
        """What each id adds to the bytes of a text."""
        if not plain and self.decoder != "ByteLevel":
            return {i: t.encode() for i, t in self.names.items()}
        byte, end = _byte_of_char(), self.merges.suffix

        def text(token: str) -> bytes:
            if token in self.special:
                return token.encode()
            word = bool(end) and token.endswith(end)
            return bytes(byte[c] for c in (token.removesuffix(end) if word else token)) + b" " * word

        return {i: text(t) for i, t in self.names.items()}


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=4)
def _token_bytes(path: str, plain: bool) -> dict[int, bytes]:
    return model(path).token_bytes(plain)


class Encoder:
    """Ids, as little-endian unsigned 32-bit numbers, of a text whose bytes come in parts."""

    def __init__(self, path: str):
        self.m, self.tail, self.long = model(path), b"", None

    def feed(self, data: bytes) -> bytes:
        cut = max(data.rfind(s) for s in (SPACES[k : k + 1] for k in range(len(SPACES))))
        if cut < 0:
            return self._hold(data)
        head, rest = data[:cut], data[cut:]
        out = []
        if self.tail or self.long:
            first = head.split(None, 1) if head[:1] not in SPACES or not head else [b"", head]
            out.append(self._hold(first[0] if first else b"") + self._finish())
            head = first[1] if len(first) > 1 else b""
        out += map(self.m.units.__getitem__, head.split())
        return b"".join(out) + self._hold(rest.strip(SPACES))

    def end(self) -> bytes:
        return self._finish()

    def _hold(self, part: bytes) -> bytes:
        """Gathers a unit whose end isn't there yet; a long one is streamed."""
        if self.long is None:
            self.tail += part
            if len(self.tail) <= UNIT:
                return b""
            self.long, part, self.tail = UnitStream(self.m), self.tail, b""
        return _packed(self.long.feed(part))

    def _finish(self) -> bytes:
        if self.long is not None:
            stream, self.long = self.long, None
            return _packed(stream.feed(b"", True))
        tail, self.tail = self.tail, b""
        return self.m.units[tail] if tail else b""


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Decoder:
    """The text of ids that come in parts. plain: see token_bytes()."""

    def __init__(self, path: str, plain: bool = False):
        self.bytes = _token_bytes(path, plain)
        self.between = b"" if plain or model(path).decoder == "ByteLevel" else b" "
        self.begun = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        """Text that no later id changes. Ids that no token has are skipped."""
        parts = [b for i in np.frombuffer(ids, "<u4").tolist() if (b := self.bytes.get(i)) is not None]
        data = self.between.join(parts)
        if self.begun and parts:
            data = self.between + data
        self.begun = self.begun or bool(parts)
        return self.utf8.decode(data)

    def end(self) -> str:
        return self.utf8.decode(b"", True)


def _chunks(data, offs, k: int):
    """Bytes of row k, CHUNK at a time."""
    for at in range(int(offs[k]), int(offs[k + 1]), CHUNK):
        yield data[at : min(at + CHUNK, int(offs[k + 1]))].tobytes()


@lean
def _encode(batches, path: str, ids: bool, decoded: bool):
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        count, digest, blobs, texts = [], [], [], []
        for k in range(batch.num_rows):
            encoder, decoder = Encoder(path), Decoder(path)
            n, h, t, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            for part in _parts(encoder, data, offs, k):
                n += len(part) // 4
                h.update(part)
                if ids:
                    kept.append(part)
                if decoded:
                    t.update(decoder.feed(part).encode())
            t.update(decoder.end().encode())
            count.append(n)
            digest.append(h.hexdigest())
            texts.append(t.hexdigest())
            blobs.append(b"".join(kept))
        cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(digest, pa.string())}
        if decoded:
            cols["decoded_sha256"] = pa.array(texts, pa.string())
        if ids:
            cols["ids"] = pa.array(blobs, pa.binary())
        yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])


def _parts(encoder: Encoder, data, offs, k: int):
    for chunk in _chunks(data, offs, k):
        yield encoder.feed(chunk)
    yield encoder.end()


@lean
def _decode(batches, path: str, plain: bool):
    for batch in batches:
        texts = []
        for blob in batch.column("ids"):
            decoder, blob = Decoder(path, plain), blob.as_py() or b""
            texts.append("".join([decoder.feed(blob[k : k + CHUNK]) for k in range(0, len(blob), CHUNK)]) + decoder.end())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode_texts(docs: DataFrame, tokenizer: str | None = None, ids: bool = True, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: doc_id, n_tokens, ids_sha256 (lower-case hex, of the ids as little-endian unsigned 32-bit numbers); with
    `decoded` decoded_sha256, of the text that the decoder makes of the ids as they come; with `ids` the ids themselves."""
    small_batches(docs.sparkSession)
    path = str(tokenizer or public_tokenizers.path(DEFAULT))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string" + ", decoded_sha256 string" * decoded + ", ids binary" * ids
    return rows.mapInArrow(partial(_encode, path=path, ids=ids, decoded=decoded), schema)


def decode_ids(encoded: DataFrame, tokenizer: str | None = None, plain: bool = False) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    small_batches(encoded.sparkSession)
    path = str(tokenizer or public_tokenizers.path(DEFAULT))
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path, plain=plain), "doc_id long, text string")
