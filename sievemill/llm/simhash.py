"""SimHash fingerprints and their near-duplicate self-join by a binary trie.

Fingerprints within the error budget agree on at least one of budget + 1 blocks of bits, so the trie is laid out once
with each block in front: below a block's value the error so far is 0, and only node pairs of the same subtree remain.
A subtree with many fingerprints is split further into pairs of nodes some bits deeper, as far as their differing bits
leave an error budget. Each task then walks its node pairs together, four bits at a time, adds up differing bits, drops
every pair beyond the budget, and returns the components of what it linked as stars. A fingerprint has at most 2,080
others within two bits, so what a subtree yields grows with its fingerprints, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import overlap
from sievemill.llm.common import checkpoint, map_arrow, release, shuffle_width
from sievemill.llm.components import connected_components, roots_of

BITS = 64
#: Node pairs with at most so many fingerprint pairs are compared outright.
_LEAF_PAIRS = 64
#: Node pairs expanded at once: a bound on memory.
_CHUNK = 1 << 19


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash over ``width``-word shingles; A-Z are lower-cased, words end at ASCII white space; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    counts = np.zeros(BITS, np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    for at in range(0, len(shingles), 1 << 15):
        part = shingles[at : at + (1 << 15)]
        hashes = np.fromiter(map(digest, part), np.uint64, len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of ``doc_id, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", width, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _pairs(lo_a: np.ndarray, n_a: np.ndarray, lo_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All index pairs of each range pair; which range pair each came from."""
    n = n_a * n_b
    of, k = np.repeat(np.arange(len(n)), n), _ranges(n)
    return lo_a[of] + k // n_b[of], lo_b[of] + k % n_b[of], of


def trie_self_join(group: np.ndarray, x: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group whose values differ in at most ``budget`` bits; sorted by group, then value."""
    if not len(x):
        return
    digits = [(x >> np.uint64(60 - 4 * d) & np.uint64(15)).astype(np.int64) for d in range(16)]
    change = np.concatenate([[True], group[1:] != group[:-1]])
    roots = np.flatnonzero(change)
    starts, node_of = [], []
    for d in range(16):
        change = change | np.concatenate([[True], digits[d][1:] != digits[d][:-1]])
        starts.append(np.append(np.flatnonzero(change), len(x)))
        node_of.append(np.cumsum(change) - 1)
    sizes = np.diff(np.append(roots, len(x)))
    roots, sizes = roots[sizes > 1], sizes[sizes > 1]
    stack = [(0, roots, sizes, roots, sizes, np.zeros(len(roots), np.int64))]
    while stack:
        d, a, n_a, b, n_b, err = stack.pop()
        if len(a) > 1 and (n_a * n_b).clip(max=256).sum() > _CHUNK:
            half = len(a) // 2
            stack += [(d, *(v[:half] for v in (a, n_a, b, n_b, err))), (d, *(v[half:] for v in (a, n_a, b, n_b, err)))]
            continue
        small = n_a * n_b <= _LEAF_PAIRS
        if d == 16:
            small[:] = True
        if small.any():
            i, j, _ = _pairs(a[small], n_a[small], b[small], n_b[small])
            near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            yield i[near], j[near]
        if small.all():
            continue
        a, n_a, b, n_b, err = (v[~small] for v in (a, n_a, b, n_b, err))
        first_a, first_b = node_of[d][a], node_of[d][b]
        kids_a, kids_b = node_of[d][a + n_a - 1] - first_a + 1, node_of[d][b + n_b - 1] - first_b + 1
        p, q, of = _pairs(first_a, kids_a, first_b, kids_b)
        s, t = starts[d][p], starts[d][q]
        err = err[of] + np.bitwise_count(digits[d][s] ^ digits[d][t])
        keep = (err <= budget) & (s <= t)
        s, t, err, p, q = s[keep], t[keep], err[keep], p[keep], q[keep]
        stack.append((d + 1, s, starts[d][p + 1] - s, t, starts[d][q + 1] - t, err))


def linked_roots(group: np.ndarray, x: np.ndarray, budget: int, held: int = 1 << 20) -> np.ndarray:
    """The first member of each value's component under the links; at most about ``held`` links are kept at a time."""
    root = np.arange(len(x))
    left, right, n = [], [], 0

    def fold() -> None:
        nonlocal root, n
        if n:
            root = roots_of(len(x), root[np.concatenate(left)], root[np.concatenate(right)])[root]
            left.clear()
            right.clear()
            n = 0

    for i, j in trie_self_join(group, x, budget):
        left.append(i)
        right.append(j)
        n += len(i)
        if n >= held:
            fold()
    fold()
    return root


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else x << np.uint64(by) | x >> np.uint64(BITS - by)


def blocks_of(budget: int) -> list[tuple[int, int]]:
    """First bit and width of each of budget + 1 blocks."""
    edges = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def whole_cells(batches: Iterator[pa.RecordBatch], column: int, held: int) -> Iterator[pa.Table]:
    """Rows sorted by a column as tables of about ``held`` rows that split no value of it; a larger value comes whole."""
    parts: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        n += batch.num_rows
        if n < held:
            continue
        cells = batch.column(column).to_numpy()
        cut = int(np.searchsorted(cells, cells[-1]))  # the last value may go on
        if cut or parts[0].column(column)[0].as_py() != cells[-1]:
            if not cut:  # it began before this batch
                table = pa.Table.from_batches(parts)
                cut = int(np.searchsorted(table.column(column).to_numpy(), cells[-1]))
                done, rest = table.slice(0, cut), table.slice(cut)
            else:
                done, rest = pa.Table.from_batches([*parts[:-1], batch.slice(0, cut)]), pa.Table.from_batches([batch.slice(cut)])
            yield done
            parts, n = rest.to_batches(), rest.num_rows
    if parts:
        yield pa.Table.from_batches(parts)


def linked_stars(spark: SparkSession, prints: DataFrame, budget: int = 2, crowd: int = 4096, split_bits: int = 10, held: int = 1 << 18) -> DataFrame:
    """a, b: stars over the ids of ``fp, id`` rows (distinct fp) within ``budget`` bits; connected as the links are.

    A block value shared by over ``crowd`` fingerprints is split into node pairs ``split_bits`` deeper. Cells are sorted
    (by Spark, which spills) and joined about ``held`` rows at a time, so a task's memory does not grow with its rows.
    """
    blocks = blocks_of(budget)
    near = [m for m in range(1 << split_bits) if m.bit_count() <= budget]

    def top(rotation: int, bits: int, skip: int) -> Column:
        """Bits ``skip`` to ``skip + bits`` of the fingerprint rotated to its block."""
        at = (rotation + skip) % BITS
        turned = F.col("fp") if not at else F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", BITS - at))
        return F.shiftrightunsigned(turned, BITS - bits)

    keys = F.array(*[F.struct(F.lit(r).alias("r"), top(s, w, 0).alias("key"), top(s, split_bits, w).alias("next")) for r, (s, w) in enumerate(blocks)])
    rows = prints.select("fp", "id", F.explode(keys).alias("k")).select("fp", "id", "k.*")
    crowds = rows.groupBy("r", "key").count().filter(F.col("count") > crowd)
    crowds = crowds.select(F.expr("r ^ 0").alias("r"), F.expr("key ^ 0L").alias("key"), F.lit(True).alias("crowded"))
    masks = F.when(F.col("crowded"), F.array(*[F.lit(m).cast("long") for m in near])).otherwise(F.array(F.lit(0).cast("long")))
    cells = rows.join(crowds, ["r", "key"], "left").select("fp", "id", "r", "key", "next", "crowded", F.explode(masks).alias("mask"))
    other = F.col("next").bitwiseXOR(F.col("mask"))
    one = F.when(F.col("crowded"), F.least("next", other)).otherwise(F.lit(-1))
    two = F.when(F.col("crowded"), F.greatest("next", other)).otherwise(F.lit(-1))
    cells = cells.select("fp", "id", "r", F.xxhash64("r", "key", one, two).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_cells(batches, 3, held):
            fp, ids, r, cell = (got.column(i).to_numpy() for i in range(4))
            x = fp.astype(np.int64).view(np.uint64).copy()
            for i, (s, _) in enumerate(blocks):
                x[r == i] = _rotated(x[r == i], s)
            order = np.lexsort((x, cell))
            x, ids, cell = x[order], ids[order], cell[order]
            root = linked_roots(cell, x, budget)
            rest = np.flatnonzero(root != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(ids[root[rest]])], ["a", "b"])

    dealt = cells.repartition(shuffle_width(spark), "cell").sortWithinPartitions("cell")
    return map_arrow(dealt.select("fp", "id", "r", "cell"), run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fp, component (smallest doc_id reachable by links) of ``doc_id, text`` rows.

    Null texts count as empty; texts without words share fingerprint 0 and are linked like any other; repeated rows are
    returned each; rows without a doc_id link nothing of their own and take their fingerprint's component; an empty
    table gives no rows.
    """
    prints = checkpoint(spark, fingerprints(docs, width))
    classes = checkpoint(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    stars = linked_stars(spark, classes.filter("id IS NOT NULL"), budget)
    parts = connected_components(spark, stars)
    named = classes.join(parts, classes["id"] == parts["node"], "left")
    named = named.select(F.expr("fp ^ 0L").alias("fp"), F.coalesce("component", "id").alias("component"))
    return prints.join(named, "fp").select("doc_id", "fp", "component")


def _alike(s: Column, other: Column, similarity: float) -> Column:
    """Whether two sets have a Jaccard similarity of ``similarity`` or more; empty ones are alike."""
    common = F.size(F.array_intersect(s, other))
    total = F.size(s) + F.size(other) - common
    return F.when(total == 0, F.lit(True)).otherwise(common >= F.lit(similarity) * total)


class _Texts:
    """The distinct texts of a table, known by 64 bits of their SHA-256, and the sets of their shingles."""

    def __init__(self, spark: SparkSession, texts: DataFrame, firsts: DataFrame, similarity: float, words: int, broadcast_rows: int):
        """``texts``: u, text (repeats of u may be); ``firsts``: u, first (the smallest doc_id)."""
        self.spark, self.texts, self.firsts = spark, texts, firsts
        self.similarity, self.words, self.broadcast_rows = similarity, words, broadcast_rows

    def _side(self, units: DataFrame) -> DataFrame:
        units = units.select(F.col(units.columns[0]).alias("unit")).distinct()
        return F.broadcast(units) if units.count() <= self.broadcast_rows else units

    def rows(self, only: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
        """u, text of all texts, or of those only, or without those."""
        rows = self.texts
        for units, how in ((only, "left_semi"), (without, "left_anti")):
            if units is not None:
                side = self._side(units)
                rows = rows.join(side, rows["u"] == side["unit"], how)
        return rows.select("u", "text")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """lo, hi of the a, b pairs that are alike, in the order of their texts' smallest doc_id."""
        pairs = checkpoint(self.spark, pairs.filter("a <> b").distinct())
        ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
        of = overlap.sets_of(self.rows(only=ends), self.words)
        of = checkpoint(self.spark, of.dropDuplicates(["u"]).join(self.firsts, "u"))
        one, two = (of.select(F.col("u").alias(x), F.struct("first", "u").alias(f"key_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
        alike = pairs.join(one, "a").join(two, "b").filter(_alike(F.col("s_a"), F.col("s_b"), self.similarity))
        lo, hi = F.least("key_a", "key_b"), F.greatest("key_a", "key_b")
        return checkpoint(self.spark, alike.select(lo["u"].alias("lo"), hi["u"].alias("hi")).distinct())

    def to_heads(self, buckets: DataFrame) -> DataFrame:
        """lo, hi: texts of the ``kind, value, u`` rows that are alike to the first text of a bucket (kind, value)."""
        rows = checkpoint(self.spark, buckets.distinct().join(self.firsts, "u"))
        heads = rows.groupBy("kind", "value").agg(F.min(F.struct("first", "u")).alias("head"))
        # the xor hides the aggregate's partitioning, so that a large bucket can be split
        heads = heads.select(F.expr("kind ^ 0").alias("kind"), F.expr("value ^ 0L").alias("value"), F.col("head.u").alias("a"))
        return self.verified(rows.join(heads, ["kind", "value"]).select("a", F.col("u").alias("b")))

    def least(self, rows: DataFrame, seed: int) -> DataFrame:
        """kind, value, u: buckets of texts by some of their least shingle hashes."""
        return overlap.least_hashes(rows, self.words, seed).select(F.lit(seed).alias("kind"), "value", "u")


def _fallen(spark: SparkSession, links: DataFrame) -> DataFrame:
    """hi of the lo, hi links that goes if, by order, a text goes that has a link to one before it that stays."""
    left, gone = checkpoint(spark, links), None
    while left.limit(1).count():
        later = left.select(F.col("hi").alias("later")).distinct()
        stays = left.select("lo").distinct().join(later, F.col("lo") == F.col("later"), "left_anti").select(F.col("lo").alias("stays"))
        falls = checkpoint(spark, left.join(stays, left["lo"] == stays["stays"], "left_semi").select("hi").distinct())
        gone = falls if gone is None else gone.unionByName(falls)
        one, two = falls.select(F.col("hi").alias("one")), falls.select(F.col("hi").alias("two"))
        left = left.join(one, left["lo"] == one["one"], "left_anti")
        left = checkpoint(spark, left.join(two, left["hi"] == two["two"], "left_anti").select("lo", "hi"))
    return left.select("hi") if gone is None else checkpoint(spark, gone.distinct())


def redundant(
    spark: SparkSession, docs: DataFrame, width: int = 3, budget: int = 2, similarity: float = 0.8, words: int = 5, broadcast_rows: int = 500_000
) -> DataFrame:
    """doc_id, h (SHA-256 of the text) of the ``doc_id, text`` rows that repeat another one.

    Of equal texts that of the smallest doc_id stays. Other texts are alike if the Jaccard similarity of their distinct
    ``words``-word shingles is ``similarity`` or more. In the order of doc_id a text goes if it is alike to one before it
    that stays: no two texts that stay are alike, and every one that goes is alike to one that stays.

    1. The SimHash join groups texts, as do least hashes of their shingles; a text that is alike to the first of such a
       group is set aside with it. That is repeated among the others while it sets aside a hundredth of them.
    2. All pairs of what is left that can be alike, by the prefixes of their shingle sets, are compared and decided.
    3. What was set aside goes if its first stays. If not, it is compared with all that was not set aside and step 2 is
       decided anew, until every first stays; so the outcome is that of going through all texts in order.

    Null texts count as empty, texts without words are alike; rows without a doc_id repeat nothing; an empty table gives
    no rows.
    """
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.sha2("text", 256))
    hashed = checkpoint(spark, docs.select("doc_id", "h", _text_id(F.col("h")).alias("u")))
    firsts = checkpoint(spark, hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.min("u").alias("u")))
    copies = checkpoint(spark, hashed.join(firsts.select("h", "first"), "h").filter("doc_id <> first").select("doc_id", "h").distinct())
    gone_rows = copies.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    side = F.broadcast(gone_rows) if gone_rows.count() <= broadcast_rows else gone_rows
    texts = docs.join(side, (docs["doc_id"] == side["gone_id"]) & (docs["h"] == side["gone_h"]), "left_anti")
    texts = texts.select(_text_id(F.col("h")).alias("u"), "text")
    known = _Texts(spark, texts, firsts.select("u", "first"), similarity, words, broadcast_rows)

    near = near_duplicates(spark, texts.select(F.col("u").alias("doc_id"), "text"), width, budget)
    buckets = near.select(F.lit(-1).alias("kind"), F.col("component").alias("value"), F.col("doc_id").alias("u"))
    buckets = buckets.unionByName(known.least(known.rows(), 0))
    aside, n, seed = None, firsts.count(), 0
    while True:
        found = known.to_heads(buckets)
        later = found.select(F.col("hi").alias("later")).distinct()
        new = found.join(later, found["lo"] == later["later"], "left_anti").groupBy("hi").agg(F.min("lo").alias("lo"))
        new = checkpoint(spark, new.select("hi", "lo"))
        aside = new if aside is None else checkpoint(spark, aside.unionByName(new))
        moved = new.count()
        n, seed = n - moved, seed + 1
        if moved * 100 <= n:
            break
        buckets = known.least(known.rows(without=aside.select("hi")), seed)
    release(spark)

    rest = known.rows(without=aside.select("hi"))
    common = overlap.common_tokens(rest, words)
    keys = checkpoint(spark, overlap.shared(overlap.prefixes(rest, words, similarity, common).withColumn("open", F.lit(True))))
    links = known.verified(overlap.candidates(keys, similarity))
    while True:
        gone = _fallen(spark, links)
        release(spark)
        fell = gone.select(F.col("hi").alias("fell")).unionByName(aside.select(F.col("hi").alias("fell"))).distinct()
        opened = checkpoint(spark, aside.join(fell, aside["lo"] == fell["fell"], "left_semi").select(F.col("hi").alias("u")))
        if not opened.limit(1).count():
            break
        again = checkpoint(spark, overlap.prefixes(known.rows(only=opened), words, similarity, common))
        tokens = again.select(F.col("token").alias("wanted")).distinct()
        others = overlap.prefixes(known.rows(without=aside.select("hi")), words, similarity, common)
        others = others.join(tokens, others["token"] == tokens["wanted"], "left_semi").drop("wanted")
        places = again.withColumn("open", F.lit(True)).unionByName(others.withColumn("open", F.lit(False)))
        keys = checkpoint(spark, overlap.shared(places))
        links = checkpoint(spark, links.unionByName(known.verified(overlap.candidates(keys, similarity))).distinct())
        ends = opened.select(F.col("u").alias("open"))
        aside = checkpoint(spark, aside.join(ends, aside["hi"] == ends["open"], "left_anti").select("hi", "lo"))
    settled = aside.select("hi")
    all_gone = gone.unionByName(settled).select(F.col("hi").alias("gone_u")).distinct()
    near_copies = hashed.join(all_gone, hashed["u"] == all_gone["gone_u"]).select("doc_id", "h")
    return checkpoint(spark, copies.unionByName(near_copies).distinct())


def _text_id(h: Column) -> Column:
    """The first 64 bits of a hexadecimal digest as a long."""
    return F.conv(F.substring(h, 1, 16), 16, -10).cast("long")
