"""Pairs of shingle sets that may reach a Jaccard similarity, by prefix filtering; none that reach it are missed.

With the tokens of all sets in one order, two sets of similarity t or more share a token among the first
n - ceil(t * n) + 1 of each. The order puts what a sample shows to be common last and goes by hash before, so that
passages of many texts propose few pairs. Any order is exact: it is decided once and used for every set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import map_arrow

_PLACES = "token long, u long, n int, at int"


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words make one shingle, none an empty set."""
    digests = np.fromiter(map(xxhash.xxh64_intdigest, text.encode().split()), np.uint64)
    if not len(digests):
        return np.zeros(0, np.int64)
    n = max(1, len(digests) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(words, len(digests))):
        mixed = (mixed ^ digests[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """u, s (the shingle set) of ``u, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            edges = np.cumsum([0, *map(len, found)], dtype=np.int32)
            s = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), s], ["u", "s"])

    return map_arrow(texts.select("u", "text"), run, "u long, s array<long>")


def least_hashes(texts: DataFrame, words: int, seed: int, most: int = 4) -> DataFrame:
    """u, value: the ``most`` least shingle hashes (after an xor by ``seed``) of ``u, text`` rows; 0 for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1)
        for batch in batches:
            found = [np.sort(shingle_set(t.as_py(), words) ^ flip)[:most] for t in batch.column(1)]
            found = [x if len(x) else np.zeros(1, np.int64) for x in found]
            u = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["u", "value"])

    return map_arrow(texts.select("u", "text"), run, "u long, value long")


def common_tokens(texts: DataFrame, words: int, every: int = 16, least: int = 4_000, often: int = 4, most: int = 1_000_000) -> np.ndarray:
    """Sorted tokens that ``often`` or more texts of a sample hold; the ``most`` most frequent at most.

    The sample is one text of ``every``, or about ``least`` where that is more. Its share does not fall as the table grows, so neither
    does what counts as common rise, and with it the pairs that a token of many texts proposes.
    """
    every = max(1, min(every, texts.count() // least))
    some = sets_of(texts.filter(F.pmod("u", F.lit(every)) == 0), words).select(F.explode("s").alias("token"))
    counts = some.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= often).orderBy(F.desc("n")).limit(most)
    return np.sort(counts.select("token").toArrow().column(0).to_numpy())


def prefixes(texts: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """token, u, n (the set's size), at (the token's place in the order) of ``u, text`` rows; repeats of u may be left out.

    Empty sets share one token.
    """

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        token, u, n, at = np.concatenate(parts, axis=1)
        columns = [pa.array(token), pa.array(u), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["token", "u", "n", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts: list[np.ndarray] = []
            size = 0
            for u, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if u in seen:
                    continue
                seen.add(u)
                s = shingle_set(text.as_py(), words)
                n = len(s)
                if not n:
                    parts.append(np.array([[0], [u], [0], [0]], np.int64))
                    continue
                rank = np.searchsorted(common, s)
                known = rank < len(common)
                known[known] = common[rank[known]] == s[known]
                first = s[np.argsort(known, kind="stable")][: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                parts.append(np.stack([first, np.full(len(first), u), np.full(len(first), n), np.arange(len(first))]))
                size += len(first)
                if size >= 1 << 16:  # a bound on memory
                    yield packed(parts)
                    parts, size = [], 0
            if parts:
                yield packed(parts)

    return map_arrow(texts.select("u", "text"), run, _PLACES)


def shared(places: DataFrame) -> DataFrame:
    """key, u, n, at, weight, open: the places whose token more than one set has (``places`` with a column open).

    Tokens that exactly the same sets have, like those of a passage, are one key of that weight; at is its first place.
    """
    by_token = Window.partitionBy("token")
    once = places.withColumn("before", F.lag("u").over(by_token.orderBy("u"))).filter("before IS NULL OR before <> u")
    sets = F.xxhash64(F.bit_xor(F.xxhash64("u")).over(by_token), F.count("*").over(by_token))
    marked = once.withColumn("several", F.count("*").over(by_token) > 1).withColumn("key", sets).filter("several")
    return marked.groupBy("key", "u", "n").agg(F.min("at").alias("at"), F.count("*").alias("weight"), F.max("open").alias("open"))


def _possible(n: Column, at: Column, n_b: Column, at_b: Column, similarity: float) -> Column:
    """Whether sets of these sizes that share a token at these places can be so similar."""
    rest = F.least(n - at, n_b - at_b) + F.least(at, at_b)
    return (F.least(n, n_b) >= similarity * F.greatest(n, n_b) - 1e-9) & (rest >= similarity / (1 + similarity) * (n + n_b) - 1e-9)


def candidates(keys: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of sets of which one is open, that share a key and can be so similar.

    What follows the earlier end of two prefixes adds at most the rest of its set, so the tokens that the prefixes share
    must make up for what the larger rest leaves wanting.
    """
    one, two = (keys.select(F.col("key"), *[F.col(c).alias(f"{c}_{y}") for c in ("u", "n", "at", "open")], *more) for y, more in (("a", ["weight"]), ("b", [])))
    fits = _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), similarity)
    found = one.join(two, "key").filter((F.col("u_a") < F.col("u_b")) & (F.col("open_a") | F.col("open_b")) & fits)
    counted = found.groupBy("u_a", "u_b", "n_a", "n_b").agg(F.sum("weight").alias("common"))

    def rest(n: str) -> Column:
        return F.greatest(F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1, F.lit(0))

    wanted = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - F.greatest(rest("n_a"), rest("n_b"))
    return counted.filter(F.col("common") >= wanted - 1e-6).select(F.col("u_a").alias("a"), F.col("u_b").alias("b"))
