"""Language identification by prediction by partial matching.

For each language, byte context trees of orders 0 to ``order`` hold how often each byte followed each context. A byte's
code length in a context is that of its count among count + distinct symbols; a byte not seen there costs the escape,
distinct / (count + distinct), and then its code length in the context one byte shorter; below order 0 all bytes are
equal. The statistics are frozen after training, so the code length of every byte after every context of the shorter
orders and after the most frequent of the longest is laid out once as a table, and a text's code length in every language
is a sum of table rows over all its bytes. After the other contexts it comes from a sorted list of the bytes seen there,
or from the table after the escape; both ways give the same number. The logarithm of each count and each escape is rounded
to 1/256 bit; nothing else is.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import map_arrow

#: Code lengths are whole numbers of 1/UNIT bit, so sums do not depend on how texts are cut into blocks.
UNIT = 256
_BLOCK = 1 << 17
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    order: int
    classes: np.ndarray  # byte -> its class; 0 is any byte never seen
    n_classes: int
    page_of: np.ndarray  # the classes of the last bytes as one number -> page, or -1 - place among the listed contexts
    cost: np.ndarray  # (pages * classes, languages), in 1/UNIT bit
    listed_page: np.ndarray  # of each listed context: the page of its suffix
    listed_escape: np.ndarray  # (listed contexts, languages): what a byte not seen there costs more than after the suffix
    grams: np.ndarray  # sorted: listed contexts with a byte seen there, as numbers
    gram_cost: np.ndarray  # (grams, languages)

    def lengths(self, text: bytes) -> np.ndarray:
        """Code length in each language, in 1/UNIT bit; a text is coded as if blanks stood before it."""
        total = np.zeros(len(self.languages), np.int64)
        a, k = self.n_classes, self.order
        padded = np.frombuffer(b" " * k + text, np.uint8)
        for at in range(0, len(text), _BLOCK):
            c = self.classes[padded[at : at + _BLOCK + k]].astype(np.int32)
            n = len(c) - k
            context = np.zeros(n, np.int32)
            for i in range(k):
                context *= a
                context += c[i : i + n]
            page, last = self.page_of[context], c[k:]
            some = np.flatnonzero(page < 0)
            place = -1 - page[some]
            page[some] = self.listed_page[place]
            rest = page * a + last
            if len(some):
                gram = context[some].astype(np.int64) * a + last[some]
                at_gram = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
                known = self.grams[at_gram] == gram
                total += self.gram_cost[at_gram[known]].sum(axis=0, dtype=np.int64)
                total += self.listed_escape[place[~known]].sum(axis=0, dtype=np.int64)
                rest = np.delete(rest, some[known])
            total += self.cost[rest].sum(axis=0, dtype=np.int64)
        return total


def _units(ratio: float) -> int:
    return round(math.log2(ratio) * UNIT)


def train(counts: dict[str, dict[int, int]], order: int = 3, laid_out: int = 40_000) -> Model:
    """``counts``: per language, how often each string of order + 1 bytes (big-endian number) occurs.

    The ``laid_out`` most frequent of the longest contexts become pages of the table, the others are listed. All count;
    this only says which way a code length is found.
    """
    languages = sorted(counts)
    grams = {}
    for lang in languages:
        keys = np.fromiter(counts[lang].keys(), np.int64, len(counts[lang]))
        grams[lang] = keys, np.fromiter(counts[lang].values(), np.int64, len(keys))
    seen = np.zeros(256, bool)
    seen[32] = True
    for keys, _ in grams.values():
        for i in range(order + 1):
            seen[np.unique(keys >> 8 * i & 255)] = True
    classes = np.where(seen, np.cumsum(seen), 0).astype(np.uint8 if seen.sum() < 255 else np.int16)
    a = int(seen.sum()) + 1
    unseen = 256 - (a - 1)
    uniform = np.full(a, 8 * UNIT, np.int32)
    uniform[0] = 8 * UNIT if unseen else 64 * UNIT

    weight: dict[tuple[int, ...], int] = defaultdict(int)
    following: list[list[dict[tuple[int, ...], dict[int, int]]]] = []
    for lang in languages:
        keys, n = grams[lang]
        symbols = np.stack([classes[keys >> 8 * (order - i) & 255] for i in range(order + 1)]).astype(int) if len(keys) else np.zeros((order + 1, 0), int)
        orders = []
        for k in range(order + 1):
            tree: dict[tuple[int, ...], dict[int, int]] = defaultdict(dict)
            packed = np.zeros(symbols.shape[1], np.int64)
            for row in symbols[order - k :]:
                packed = packed * a + row
            values, where = np.unique(packed, return_inverse=True)
            for v, m in zip(values.tolist(), np.bincount(where, n, len(values)).astype(int).tolist()):
                v, last = divmod(v, a)
                context = tuple(v // a**i % a for i in range(k - 1, -1, -1))
                tree[context][last] = m
                if k == order:
                    weight[context] += m
            orders.append(tree)
        following.append(orders)
    kept = {x for x, _ in sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:laid_out]}

    pages: dict[tuple[int, ...], int] = {}
    vectors: list[np.ndarray] = []  # per page: (languages, classes)
    for k in range(order + 1):
        contexts = {c for orders in following for c in orders[k]} if k < order else kept
        if not k:
            contexts = {()}
        for context in sorted(contexts):
            below = vectors[pages[longest(context[1:], pages)]] if k else np.tile(uniform, (len(languages), 1))
            vector = below.copy()
            for row, orders in enumerate(following):
                if nxt := orders[k].get(context):
                    total, distinct = sum(nxt.values()), len(nxt)
                    vector[row] += _units((total + distinct) / distinct)
                    for symbol, m in nxt.items():
                        vector[row, symbol] = _units((total + distinct) / m)
            pages[context] = len(vectors)
            vectors.append(vector)

    listed = sorted(set(weight) - kept)
    listed_page = np.zeros(len(listed), np.int32)
    listed_escape = np.zeros((len(listed), len(languages)), np.int32)
    grams, gram_cost = [], []
    for i, context in enumerate(listed):
        listed_page[i] = pages[longest(context[1:], pages)]
        below = vectors[listed_page[i]]
        found = [orders[order].get(context, {}) for orders in following]
        totals = [sum(nxt.values()) + len(nxt) for nxt in found]
        listed_escape[i] = [_units(t / len(nxt)) if nxt else 0 for t, nxt in zip(totals, found)]
        for symbol in sorted(set().union(*found)):
            grams.append(packed_number((*context, symbol), a))
            gram_cost.append([_units(t / nxt[symbol]) if symbol in nxt else int(below[row, symbol] + listed_escape[i, row]) for row, (t, nxt) in enumerate(zip(totals, found))])

    page_of = np.full((a,) * order, pages[()], np.int32)
    for context in sorted(pages, key=len):
        page_of[(slice(None),) * (order - len(context)) + context] = pages[context]
    for i, context in enumerate(listed):
        page_of[context] = -1 - i
    cost = np.stack(vectors).transpose(0, 2, 1).reshape(len(vectors) * a, len(languages))
    narrow = np.int16 if not cost.size or cost.max() <= np.iinfo(np.int16).max else np.int32
    return Model(
        languages, order, classes, a, page_of.reshape(-1), cost.astype(narrow), listed_page, listed_escape,
        np.array(grams, np.int64), np.array(gram_cost, np.int32).reshape(len(grams), len(languages)),
    )


def packed_number(symbols: tuple[int, ...], base: int) -> int:
    number = 0
    for x in symbols:
        number = number * base + x
    return number


def longest(context: tuple[int, ...], pages: dict) -> tuple[int, ...]:
    while context not in pages:
        context = context[1:]
    return context


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """lang, gram, n of ``lang, text`` rows: strings of order + 1 bytes as numbers, each text preceded by blanks."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts[lang].append(b" " * order + (text.as_py() or "").encode())
            for lang, group in texts.items():
                parts = []
                for raw in group:
                    x = np.frombuffer(raw, np.uint8).astype(np.int64)
                    gram = np.zeros(len(x) - order, np.int64)
                    for i in range(order + 1):
                        gram = gram << 8 | x[i : len(x) - order + i]
                    parts.append(gram)
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(n)], schema=schema)

    found = map_arrow(docs.select("lang", "text"), run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(spark: SparkSession, docs: DataFrame, order: int = 3, sample: int = 1500) -> Model:
    """Learn from ``doc_id, lang, text`` rows whose lang is not null.

    The bound of the training sample: about ``sample`` documents of each language, chosen by a hash of doc_id; with
    fewer, all are taken.
    """
    labelled = docs.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return train({}, order)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    grams = gram_counts(labelled.filter(chance < F.element_at(rate, F.col("lang"))), order).toPandas()
    counts: dict[str, dict[int, int]] = {lang: {} for lang in sizes}
    for lang, part in grams.groupby("lang"):
        counts[lang] = dict(zip(part["gram"].tolist(), part["n"].tolist()))
    return train(counts, order)


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of ``doc_id, text`` rows.

    ``und`` with score 0 if the text is null or has no letter (or nothing was learned). score: the best language's
    share if each text's code lengths, cut to what 64 of its bytes would take, are turned into probabilities.
    """
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def one(model: Model, text: str | None) -> tuple[str, float, float | None]:
        if not text or not model.languages or not (text[0].isalpha() or _LETTER.search(text)):
            return "und", 0.0, None
        raw = text.encode()
        bits = model.lengths(raw) / UNIT
        best = int(bits.argmin())
        excess = (bits - bits[best]) * min(1.0, 64 / len(raw))
        return model.languages[best], float(1 / np.exp2(-excess).sum()), float(bits[best] / len(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = [one(model, t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0).to_pylist(), *zip(*rows)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, bits_per_byte double")
