"""Token counts by greedy longest match in linear time, without building pieces.

The vocabulary's trie has a failure link for each node: where matching goes on, one or more pieces having been popped,
once no child continues the match. The number of pieces popped on the way is stored with the link, so counting a word
is one walk over its characters and a sum of stored numbers.
"""

from __future__ import annotations

import functools
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sievemill.llm.bpe import byte_symbols
from sievemill.llm.common import map_arrow

#: Words of a worker's cache before it starts anew.
CACHE_ENTRIES = 800_000


class PieceCounter:
    """``first``: pieces that begin a word; ``rest``: pieces that continue one. A word that they can't spell counts 1."""

    def __init__(self, first: Iterable[str], rest: Iterable[str], cache_entries: int = CACHE_ENTRIES):
        self.child: list[dict[str, int]] = [{}, {}]  # node 0: a word's start; node 1: within a word
        whole: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.child[node].get(c)
                    if nxt is None:
                        nxt = self.child[node][c] = len(self.child)
                        self.child.append({})
                        whole.append(False)
                    node = nxt
                if piece:
                    whole[node] = True
        self.link = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, nxt in self.child[node].items():
                if whole[nxt]:
                    self.link[nxt], self.popped[nxt] = 1, 1
                else:
                    at, count = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.child[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[nxt], self.popped[nxt] = self.child[at][c], count
                queue.append(nxt)
        self.limit = cache_entries
        self.known: dict[str, int] = {}

    def walk(self, word: str) -> int:
        """Pieces of a word, or 0 if it can't be spelt."""
        child, link, popped = self.child, self.link, self.popped
        node = count = 0
        for c in word:
            nxt = child[node].get(c)
            while nxt is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                nxt = child[node].get(c)
            node = nxt
        while node > 1:
            count += popped[node]
            node = link[node]
        return count if node == 1 else 0

    #: White space apart, a word is a run of letters, digits and marks, or a single other character.
    words = re.compile(r"\w+|[^\w\s]")

    def _count(self, piece: str) -> int:
        """Words, pieces and unknown words of a text between blanks, packed into one number."""
        found = [self.walk(w) for w in self.words.findall(piece)]
        unknown = found.count(0)
        return len(found) << 64 | (sum(found) + unknown) << 32 | unknown

    def count(self, text: str) -> tuple[int, int, int]:
        """Words, tokens (an unknown word is one), unknown words."""
        total, known = 0, self.known
        for piece in text.split():
            n = known.get(piece)
            if n is None:
                n = self._count(piece)
                if len(piece) <= 64:
                    if len(known) >= self.limit:
                        known.clear()
                    known[piece] = n
            total += n
        return total >> 64, total >> 32 & 0xFFFFFFFF, total & 0xFFFFFFFF


def vocabulary_of(path: str) -> tuple[list[str], list[str]]:
    """Word-piece vocabulary of a byte-level tokenizers file: its pieces after a blank begin words, the others go on."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {s: b for b, s in enumerate(byte_symbols())}
    first, rest = [], []
    for token in sorted(vocab):
        try:
            text = bytes(back.get(c, 0) for c in token).decode()
        except UnicodeDecodeError:
            continue
        if text[:1] == " " and text[1:].strip() == text[1:] != "":
            first.append(text[1:])
        elif text.strip() == text != "":
            rest.append(text)
            if len(text) == 1:
                first.append(text)
    return first, rest


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> PieceCounter:
    return PieceCounter(*vocabulary_of(path))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of ``doc_id, text`` rows; null texts count as empty, repeated rows each."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_tokens", "n_unknown")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(1)]
            columns = [batch.column(0).to_pylist(), *zip(*counts)] if counts else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_tokens long, n_unknown long")
