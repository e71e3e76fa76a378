"""Packing token sequences by vector bin packing with the dot-product heuristic.

Every item has three sizes: tokens, one segment, and loss-bearing tokens; every sequence has a limit for each. The open
sequence takes, of the items that fit, the one whose size vector has the largest dot product with the sequence's
remaining room (both as parts of the limits), so an item goes where it uses what is plentiful. Only when no whole item
fits is one cut to fill the room that is left. Documents longer than a sequence give whole sequences first.

Each partition packs its own documents, from a bounded pool, so nothing is shuffled or collected and a lost task is
redone from its input alone. What is left at a partition's end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sievemill.llm.bpe import byte_encoder
from sievemill.llm.common import map_arrow

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long, sequence_tokens long, padding long"
)
_SCHEMA = pa.schema([(f.split()[0], pa.int64()) for f in PIECES.split(", ")])


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``pool``: items that a task holds while it packs; a bound on memory, not on what is packed."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool: int = 1024

    def __post_init__(self) -> None:
        if self.tokens < 1 or self.tokens & (self.tokens - 1) or self.segments < 1 or self.loss_tokens < 1 or self.pool < 1:
            raise ValueError("limits must be positive, and the tokens of a sequence a power of two")


class Packer:
    """Packs (doc_id, ids, loss) items; ``rows`` holds finished pieces until they are taken."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.sequence = limits, first_sequence
        self.items: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []  # doc_id, ids, loss prefix sums, start, end
        self.sizes = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        """``loss``: for each id whether it bears loss; by default all but the first do."""
        bears = np.arange(len(ids)) > 0 if loss is None else loss
        sums = np.concatenate([[0], np.cumsum(bears)]).astype(np.int64)
        start, t = 0, self.limits.tokens
        while len(ids) - start >= t and sums[start + t] - sums[start] <= self.limits.loss_tokens:
            self._write([(doc_id, ids, sums, start, start + t)])
            start += t
        if start < len(ids):
            self.items.append((doc_id, ids, sums, start, len(ids)))
            if len(self.items) >= self.limits.pool:
                self._drain(self.limits.pool // 2)

    def close(self) -> None:
        self._drain(0)

    def _most(self, item: tuple, tokens: int, loss: int) -> int:
        """Tokens of an item's beginning that fit."""
        _, _, sums, start, end = item
        by_loss = int(np.searchsorted(sums, sums[start] + loss, side="right")) - 1 - start
        return max(0, min(tokens, end - start, by_loss))

    def _drain(self, keep: int) -> None:
        """Pack until at most ``keep`` items are in the pool (and, to keep some, while they can fill a sequence)."""
        limit = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        pool = self.items
        sizes = np.array([(e - s, 1, p[e] - p[s]) for _, _, p, s, e in pool], float).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        while alive.sum() > keep:
            room, chosen = limit.copy(), []
            if sizes[alive, 0].sum() < room[0] and keep:
                break
            while alive.any() and room.min() > 0:
                fits = alive & (sizes <= room).all(axis=1)
                if fits.any():
                    score = np.where(fits, (sizes / limit) @ (room / limit), -1.0)
                    i = int(score.argmax())
                    chosen.append(pool[i])
                    room -= sizes[i]
                    alive[i] = False
                    continue
                # cut the item of which the most fits; the longest among equals
                i = int(np.where(alive, sizes[:, 0], -1).argmax())
                n = self._most(pool[i], int(room[0]), int(room[2]))
                if not n:
                    break
                doc_id, ids, sums, start, end = pool[i]
                chosen.append((doc_id, ids, sums, start, start + n))
                room -= (n, 1, sums[start + n] - sums[start])
                pool[i] = (doc_id, ids, sums, start + n, end)
                sizes[i] = (end - start - n, 1, sums[end] - sums[start + n])
            if not chosen:
                raise ValueError("an id alone exceeds the limits")
            self._write(chosen)
        self.items = [x for x, a in zip(pool, alive) if a]

    def _write(self, chosen: list[tuple]) -> None:
        """One full sequence, or several whose lengths are powers of two."""
        left, queue = sum(e - s for _, _, _, s, e in chosen), list(reversed(chosen))
        while left:
            size = self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1)
            offset = 0
            while offset < size:
                doc_id, ids, sums, start, end = queue.pop()
                n = min(end - start, size - offset)
                crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                self.rows.append((doc_id, start, n, crc, len(ids), self.sequence, offset, int(sums[start + n] - sums[start]), size, 0))
                offset += n
                if n < end - start:
                    queue.append((doc_id, ids, sums, start + n, end))
            self.sequence += 1
            left -= size


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, limits: Limits | None = None) -> DataFrame:
    """A row for each piece of ``doc_id, text`` rows, each text encoded and closed by ``end_id``.

    A null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays null; an empty table
    gives no rows. Sequence ids are the partition's number times 2**33 plus a count.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary, pattern)
        packer = Packer(limits, TaskContext.get().partitionId() << 33)

        def taken() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * len(_SCHEMA)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoder.encode(text.as_py() or "") + end_id.to_bytes(4, "little")
                packer.add(doc_id, np.frombuffer(raw, "<u4"))
            yield taken()
        packer.close()
        yield taken()

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)


def pack_turns(turns: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, limits: Limits | None = None) -> DataFrame:
    """Instruction data: ``doc_id, turns array<struct<role, text>>`` rows, of which only the assistant's turns bear loss.

    Null turns and texts count as empty; each turn is closed by ``end_id``; else as ``pack_documents``.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary, pattern)
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, loss = [np.zeros(0, "<u4")], [np.zeros(0, bool)]
                for turn in said or []:
                    part = encoder.encode((turn or {}).get("text") or "") + end_id.to_bytes(4, "little")
                    ids.append(np.frombuffer(part, "<u4"))
                    loss.append(np.full(len(ids[-1]), (turn or {}).get("role") == "assistant"))
                packer.add(doc_id, np.concatenate(ids), np.concatenate(loss))
        packer.close()
        columns = list(zip(*packer.rows)) or [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

    return map_arrow(turns.select("doc_id", "turns"), run, PIECES)
