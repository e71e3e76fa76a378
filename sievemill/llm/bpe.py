"""BPE encoding and decoding by tree concatenation, and a byte-level encoder for packing.

A long text is halved wherever its middle is, each half is encoded on its own, and a window around the join that grows
by a blank-separated piece on either side is encoded again until its first piece has the left side's ids and its last one
the right side's; no pre-token crosses a blank. A pre-token of more than ``leaf`` symbols is halved likewise, with a window
of tokens. A sequence of BPE tokens is the encoding of its text as soon as every neighbouring pair is the encoding of that
pair's text, so from that agreement on the joined sequence is exactly what encoding the whole would give. Halves do not
depend on each other; documents, of which there are many more, are what runs in parallel. Pieces that come again are looked up.
"""

from __future__ import annotations

import array
import contextlib
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from sievemill.llm.common import map_arrow

#: Entries of a generation of a worker's caches; some 150 bytes each.
CACHE_ENTRIES = 150_000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    shown = set(keep)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Cache:
    """What was asked for lately. An entry is kept from the second time on that it is put, so that what occurs once takes
    no room; when a generation is full it becomes the older one, from which what is still in use is taken over."""

    def __init__(self, entries: int):
        self.entries = entries
        self.now: dict = {}
        self.older: dict = {}
        self.seen = bytearray(1 << 20)

    def put(self, key: object, value: object) -> None:
        slot = hash(key) & 0xFFFFF
        if self.seen[slot]:
            self._keep(key, value)
        self.seen[slot] = 1

    def _keep(self, key: object, value: object) -> None:
        if len(self.now) >= self.entries:
            self.older, self.now, self.seen = self.now, {}, bytearray(1 << 20)
        self.now[key] = value

    def get(self, key: object) -> object:
        found = self.now.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self._keep(key, found)
        return found


class WordBpe:
    """A tokenizers file whose BPE marks word ends: text is NFC-normalised and lower-cased, white space vanishes."""

    def __init__(self, path: str, leaf: int = 96, span: int = 4096, cache_entries: int = CACHE_ENTRIES):
        """Texts over ``span`` characters and words over ``leaf`` symbols are encoded by halves."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        #: (left id, right id) -> rank; rank -> id of the merged token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((vocab[a], vocab[b]), r)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.shown[i] = token
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pretoken = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.leaf, self.span = leaf, span
        #: A symbol's bytes; 0xFF, which no UTF-8 text holds, marks the end of a word.
        back = {s: bytes([b]) for b, s in enumerate(symbols)}
        self.spelling: dict[int, bytes] = {}
        ranks: dict[bytes, int] = {}
        for token, i in vocab.items():
            ends = bool(end) and token.endswith(end)
            self.spelling[i] = b"".join(map(back.__getitem__, token[: len(token) - len(end) * ends])) + b"\xff" * ends
            ranks[self.spelling[i]] = i
        self.propose = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        #: Proven: tokens, and pairs of tokens, that are the encoding of their own text.
        self.sound, self.words, self.pieces = Cache(cache_entries), Cache(cache_entries), Cache(cache_entries)

    # -- one pre-token ------------------------------------------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """Merge neighbours by rank, leftmost first, until none is left to merge."""
        rank, made = self.rank.get, self.made
        keys = [rank(p, _NEVER) for p in zip(ids, ids[1:])]
        while keys:
            r = min(keys)
            if r == _NEVER:
                break
            i = keys.index(r)
            ids[i : i + 2] = [made[r]]
            del keys[i]
            if i < len(keys):
                keys[i] = rank((ids[i], ids[i + 1]), _NEVER)
            if i:
                keys[i - 1] = rank((ids[i - 1], ids[i]), _NEVER)
        return ids

    def symbols_of(self, tokens: list[int]) -> list[int]:
        """The symbols that tokens were merged from."""
        out: list[int] = []
        for t in tokens:
            out += self._spelt(t)
        return out

    @functools.cached_property
    def _unmerged(self) -> dict[int, tuple[int, int]]:
        return {self.made[r]: pair for pair, r in self.rank.items()}

    @functools.lru_cache(maxsize=100_000)  # noqa: B019  one encoder lives as long as its worker
    def _spelt(self, token: int) -> list[int]:
        pair = self._unmerged.get(token)
        return [token] if pair is None else self._spelt(pair[0]) + self._spelt(pair[1])

    def concatenate(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring texts put together, encoding again only a window around the join."""
        if not left or not right:
            return left + right
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            window = self.merge(self.symbols_of(left[a:] + right[:b]))
            agrees_left = a == 0 or window[0] == left[a]
            agrees_right = b == len(right) or window[-1] == right[b - 1]
            if agrees_left and agrees_right and len(window) > 1 or a == 0 and b == len(right):
                return left[:a] + window + right[b:]
            w *= 2

    def tree(self, symbols: list[int]) -> list[int]:
        """Encode by halves; the halves are independent of each other until they are joined."""
        if len(symbols) <= self.leaf:
            return self.leaf_tokens(symbols)
        half = len(symbols) // 2
        return self.concatenate(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def leaf_tokens(self, symbols: list[int]) -> list[int]:
        """Encode a short text: a compiled merger proposes tokens, which stand if every neighbouring pair is proven."""
        if len(symbols) > 2:
            found = self.propose(b"".join(map(self.spelling.__getitem__, symbols)))
            if all(map(self._holds, found)) and all(map(self._pair_holds, found, found[1:])):
                return found
        return self.merge(list(symbols))

    def _holds(self, token: int) -> bool:
        known = self.sound.get(token)
        if known is None:
            known = self.merge(self.symbols_of([token])) == [token]
            self.sound.put(token, known)
        return known

    def _pair_holds(self, a: int, b: int) -> bool:
        known = self.sound.get((a, b))
        if known is None:
            known = self.merge(self.symbols_of([a, b])) == [a, b]
            self.sound.put((a, b), known)
        return known

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            raw = word.encode()
            found = array.array("I", self.tree([self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]])).tobytes()
            if len(word) <= 64:
                self.words.put(word, found)
        return found

    # -- texts --------------------------------------------------------------------------------------------------

    def piece(self, piece: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a text without special tokens."""
        plain = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return b"".join(map(self.word, self.pretoken.findall(plain.lower())))

    def _pieces(self, text: str) -> list[bytes]:
        """The ids of each blank-separated piece."""
        pieces = text.split(" ")
        out = list(map(self.pieces.now.get, pieces))
        for i in _missing(out):
            found = self.pieces.get(pieces[i])
            if found is None:
                found = self._special(pieces[i]) if self.parts is not None and "<|" in pieces[i] else self.piece(pieces[i])
                if len(pieces[i]) <= 64:
                    self.pieces.put(pieces[i], found)
            out[i] = found
        return out

    def _special(self, piece: str) -> bytes:
        return b"".join(array.array("I", [self.special[x]]).tobytes() if x in self.special else self.piece(x) for x in self.parts.split(piece))

    def _halves(self, text: str) -> list[bytes]:
        """The ids of each piece of a text: those of its halves, which may cut a piece, put together."""
        if len(text) <= self.span:
            return self._pieces(text)
        half = len(text) // 2
        left, right = self._halves(text[:half]), self._halves(text[half:])
        first, last, w = half, half, 0
        while True:  # a window of w pieces on either side of the join, of which the innermost two may be one
            w += 1
            first, last = text.rfind(" ", 0, first), text.find(" ", last)
            window = self._pieces(text[first + 1 : last if last >= 0 else len(text)])
            agrees_left = first < 0 or w > 1 and window[0] == left[-w]
            agrees_right = last < 0 or w > 1 and window[-1] == right[w - 1]
            if agrees_left and agrees_right:
                return left[:-w] + window + right[w:]
            first, last = max(first, 0), last + 1 if last >= 0 else len(text)

    def encode(self, text: str) -> bytes:
        return b"".join(self._halves(text))

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so the tokens are joined by blanks as they stand in the vocabulary."""
        return " ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class ByteBpe:
    """A byte-level tokenizers file, encoded with the vocabulary's ids as merge ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        for t in spec["added_tokens"]:
            ranks.pop(t["content"].encode(), None)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.ordinary = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _plain(self, text: str) -> bytes:
        return array.array("I", self.ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self._plain(text)
        return b"".join(
            array.array("I", [self.special[x]]).tobytes() if x in self.special else self._plain(x)
            for x in self.parts.split(text)
            if x
        )


def _missing(found: list) -> Iterator[int]:
    i = -1
    with contextlib.suppress(ValueError):
        while True:
            i = found.index(None, i + 1)
            yield i


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordBpe:
    """One encoder for each worker."""
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ``keep_ids``) of ``doc_id, text`` rows.

    Null texts count as empty; repeated rows are encoded each; an empty table gives an empty result. No shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.binary()), ("decoded", pa.string())] * keep_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            out[0] = batch.column(0).to_pylist()
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                decoded = encoder.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded)
                for column, value in zip(out[1:], row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    names = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return map_arrow(docs.select("doc_id", "text"), run, names)
