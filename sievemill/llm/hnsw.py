"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Exact copies are collapsed first. The vectors of a label are dealt by hash to shards of bounded size; each shard gets a
graph, and every two shards of a label search each other: a link found from either end counts at both. A search keeps a beam of its nearest vectors; it is
widened as long as the whole beam lies within the similarity asked for. An audit compares vectors of the block with the
whole shard until enough of them had a link, or all were compared; if their own search misses a link, the whole block is
compared. Links are verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import checkpoint, map_arrow, shuffle_width
from sievemill.llm.components import connected_components, roots_of


class Graph:
    """A small-world graph over unit vectors. Nodes are inserted in batches that see the graph and each other."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, batch: int = 64, seed: int = 1):
        self.x = vectors
        n = len(vectors)
        self.width = [2 * links] + [links] * 16
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(links)).astype(int), 8)
        order = np.argsort(-level, kind="stable")
        self.level = level
        self.top = int(level.max(initial=0))
        self.near = [np.full((n, self.width[k]), -1, np.int32) for k in range(self.top + 1)]
        self.members = [np.zeros(n, bool) for _ in range(self.top + 1)]
        self.start = int(order[0]) if n else -1
        for at in range(0, n, batch):
            self._insert(order[at : at + batch], beam)

    def _insert(self, new: np.ndarray, beam: int) -> None:
        q = self.x[new]
        among = q @ q.T
        entry = np.full(len(new), self.start)
        for k in range(self.top, -1, -1):
            here = self.level[new] >= k
            if self.members[k].any():
                ids, sims = self._search(q, entry, k, beam if here.any() else 1)
                entry = ids[np.arange(len(new)), sims.argmax(axis=1)]
            else:
                ids, sims = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0))
            if not here.any():
                continue
            which = np.flatnonzero(here)
            mates = np.broadcast_to(new[which], (len(which), len(which)))
            mate_sims = np.where(np.eye(len(which), dtype=bool), -np.inf, among[np.ix_(which, which)])
            ids = np.concatenate([ids[which], mates], axis=1)
            sims = np.concatenate([sims[which], mate_sims], axis=1)
            for row, node in enumerate(new[which]):
                good = np.isfinite(sims[row]) & (ids[row] >= 0)
                chosen = self._diverse(ids[row][good], sims[row][good], self.width[k] // 2)
                self.near[k][node, : len(chosen)] = chosen
                for other in chosen:
                    self._link_back(k, int(other), int(node))
            self.members[k][new[which]] = True

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
        """The nearest first, leaving out what is nearer to one already chosen; then the nearest of the rest."""
        order = np.argsort(-sims, kind="stable")[: 3 * most]
        ids, sims = ids[order], sims[order]
        between = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        rest: list[int] = []
        for i in range(len(ids)):
            if len(chosen) == most:
                break
            (rest if chosen and (between[i, chosen] > sims[i]).any() else chosen).append(i)
        return [int(ids[i]) for i in chosen + rest[: most - len(chosen)]]

    def _link_back(self, k: int, node: int, other: int) -> None:
        row = self.near[k][node]
        if (row == other).any():
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        ids = np.append(row, other)
        kept = self._diverse(ids, self.x[ids] @ self.x[node], len(row))
        row[:] = -1
        row[: len(kept)] = kept

    def _search(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, similarities) of all queries, one expansion of each at a time; -1 where a beam is not full."""
        n, m = len(q), len(self.x)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, m), bool)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("ij,ij->i", q, self.x[entry])
        open_[:, 0] = True
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while len(active):
            best = np.where(open_[active], sims[active], -np.inf).argmax(axis=1)
            node = ids[active, best]
            open_[active, best] = False
            near = self.near[k][node]
            rows = np.broadcast_to(active[:, None], near.shape)
            fresh = (near >= 0) & ~seen[rows, near]
            r, c = np.nonzero(fresh)
            seen[active[r], near[r, c]] = True
            new_sims = np.full(near.shape, -np.inf)
            new_sims[r, c] = np.einsum("ij,ij->i", q[active[r]], self.x[near[r, c]])
            all_sims = np.concatenate([sims[active], new_sims], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], axis=1), keep, 1)
            active = active[(open_[active] & np.isfinite(sims[active])).any(axis=1)]
        return ids, sims

    def links_of(self) -> bytes:
        """Its links as bytes: start and top, then by level how many nodes have links there, these nodes, and their links."""
        parts = [np.array([self.start, self.top], "<i4")]
        for near in self.near:
            linked = np.flatnonzero((near >= 0).any(axis=1))
            parts += [np.array([len(linked), near.shape[1]], "<i4"), linked.astype("<i4"), near[linked].astype("<i4").ravel()]
        return np.concatenate(parts).tobytes()

    @classmethod
    def of(cls, vectors: np.ndarray, links: bytes) -> Graph:
        """A graph to search, of vectors and what ``links_of`` gave for them."""
        raw = np.frombuffer(links, "<i4")
        graph = cls.__new__(cls)
        graph.x, graph.start, graph.top, graph.near = vectors, int(raw[0]), int(raw[1]), []
        at = 2
        for _ in range(graph.top + 1):
            n, width = raw[at : at + 2].tolist()
            near = np.full((len(vectors), width), -1, np.int32)
            near[raw[at + 2 : at + 2 + n]] = raw[at + 2 + n : at + 2 + n * (1 + width)].reshape(n, width)
            graph.near.append(near)
            at += 2 + n * (1 + width)
        return graph

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(q), self.start)
        for k in range(self.top, 0, -1):
            ids, sims = self._search(q, entry, k, 1)
            entry = ids[:, 0]
        return self._search(q, entry, 0, min(beam, len(self.x)))


def links_between(
    graph: Graph, q: np.ndarray, least: float, beam: int = 48, audit: int = 64, widest: int = 192, own: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) index pairs of similarity ``least`` or more.

    Queries spread over the block are compared with the whole shard, which is exact, until ``audit`` of them had a link
    (``own``: other than with itself) or no query is left. The rest is searched by beams that double
    while they are full of links. Queries that would need one over ``widest``, and all of the rest if the audited ones'
    own search misses a link, are compared with the whole shard too.
    """
    n, m = len(q), len(graph.x)
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    want = np.zeros(n, int)

    def compare(some: np.ndarray) -> int:
        """All links of these queries; how many queries have one, other than with itself."""
        r, c = np.nonzero(q[some] @ graph.x.T >= least)
        left.append(some[r])
        right.append(c)
        want[some] = np.bincount(r, minlength=len(some))
        return len(np.unique(r[some[r] != c] if own else r))

    order = np.argsort(np.arange(n) * 0.6180339887498949 % 1)
    seen = at = 0
    while at < n and seen < audit:
        seen += compare(order[at : at + 256])
        at += 256
    todo, probes = order[at:], order[:at][want[order[:at]] > 0]
    while len(todo):
        missed = False
        if beam <= widest and len(probes):
            _, sims = graph.search(q[probes], beam)
            hits = (sims >= least).sum(axis=1)
            full = hits == sims.shape[1]
            missed = bool((~full & (hits < want[probes])).any())
            probes = probes[full]
        if beam > widest or missed:
            for a in range(0, len(todo), 256):
                compare(todo[a : a + 256])
            break
        # a bounded number of queries at a time: each keeps track of the nodes it has seen
        parts = [graph.search(q[todo[a : a + 1024]], beam) for a in range(0, len(todo), 1024)]
        ids, sims = (np.concatenate(p) for p in zip(*parts))
        hit = sims >= least
        again = hit.all(axis=1) & (beam < m)
        done = np.flatnonzero(~again)
        r, c = np.nonzero(hit[done])
        left.append(todo[done[r]])
        right.append(ids[done[r], c])
        todo = todo[again]
        beam = min(2 * beam, m)
    pairs = np.unique(np.concatenate(left) * m + np.concatenate(right)) if m else np.zeros(0, int)
    return pairs // max(m, 1), pairs % max(m, 1)


def linked_pairs(one: Graph, two: Graph | None, least: float, find: Callable[..., tuple[np.ndarray, np.ndarray]] = links_between) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors of two shards, or (two is None) i < j of one, found from either end."""
    other = two or one
    right, left = find(one, other.x, least - 1e-9, own=two is None)  # the queries are the second shard's
    if two is None:
        left, right = np.minimum(left, right), np.maximum(left, right)
        left, right = left[left < right], right[left < right]
    else:
        more, found = find(two, one.x, least - 1e-9)
        left, right = np.concatenate([left, more]), np.concatenate([right, found])
    m = max(len(other.x), 1)
    pairs = np.unique(left * m + right)
    left, right = pairs // m, pairs % m
    ok = [np.einsum("ij,ij->i", one.x[left[a : a + (1 << 17)]], other.x[right[a : a + (1 << 17)]]) >= least for a in range(0, len(pairs), 1 << 17)]
    kept = np.concatenate([np.zeros(0, bool), *ok])
    return left[kept], right[kept]


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.93, shard: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept of ``vec_id, embedding, label`` rows.

    Vectors of one label are linked if their cosine, in double precision, is ``least`` or more. A vector that is null,
    zero, or holds a null or non-finite component, and one without a label, links with nothing; so do vectors of other
    lengths with each other. Rows that repeat a vec_id are linked like any two vectors. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label")
    )
    sound = F.expr(
        "label IS NOT NULL AND e IS NOT NULL AND size(e) > 0 AND forall(e, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"
        " AND exists(e, v -> v <> 0)"
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    usable = rows.filter("sound").select("vec_id", "label", F.expr("transform(e, v -> v + 0D)").alias("e"))
    classes = usable.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = checkpoint(spark, classes.withColumn("cid", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", F.size("e").alias("d")).agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    sizes = sizes.select(F.concat("label", F.lit("")).alias("label"), F.expr("d ^ 0").alias("d"), "shards")
    dealt = classes.withColumn("d", F.size("e")).join(sizes, ["label", "d"])
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int"))
    dealt = dealt.select("cid", "label", "d", "s", "shards", "e", "copies")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's vectors of each shard as one row of bytes, and the links of the shard's graph, which is built only here."""
        held: dict[tuple, list] = {}
        for batch in batches:
            values = batch.column(5).flatten().to_numpy().astype("<f8")
            at = 0
            for cid, label, d, s, shards, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6))):
                held.setdefault((label, d, s, shards), []).append((cid, values[at : at + d].tobytes(), n))
                at += d
        for key in list(held):
            part = held.pop(key)
            data = b"".join(v for _, v, _ in part)
            columns = [pa.array([x], t) for x, t in zip(key, (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            for raw in (np.array([c for c, _, _ in part], "<i8").tobytes(), data, np.array([n for _, _, n in part], "<i8").tobytes(), Graph(_unit_block(data, key[1])).links_of()):
                columns.append(pa.array([raw], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["label", "d", "s", "shards", "cids", "data", "weights", "graph"])

    by_shard = map_arrow(
        dealt.repartition(shuffle_width(spark), "label", "d", "s"), gather, "label string, d int, s int, shards int, cids binary, data binary, weights binary, graph binary"
    )
    blocks = checkpoint(spark, by_shard)
    held = ("cids", "data", "weights", "graph")
    asked = blocks.select("label", "d", *[F.col(c).alias(f"q_{c}") for c in held], F.explode(F.expr("sequence(s, shards - 1)")).alias("s"))
    cells = asked.join(blocks.select("label", "d", "s", *held), ["label", "d", "s"])
    cells = cells.select("d", *[f"q_{c}" for c in held], *held).repartition(shuffle_width(spark))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                d, q_cids, q_data, q_weights, q_graph, cids, data, weights, graph = (batch.column(i)[at].as_py() for i in range(9))
                one = Graph.of(_unit_block(q_data, d), q_graph)
                left, right = linked_pairs(one, Graph.of(_unit_block(data, d), graph) if cids != q_cids else None, least)
                mine, other = np.frombuffer(q_cids, "<i8"), np.frombuffer(cids, "<i8")
                # a class's links are the copies of all classes linked with it; what joins classes is returned as stars
                count = np.bincount(left, np.frombuffer(weights, "<i8")[right], len(mine)).astype(np.int64)
                back = np.bincount(right, np.frombuffer(q_weights, "<i8")[left], len(other)).astype(np.int64)
                nodes, where = np.unique(np.concatenate([mine[left], other[right]]), return_inverse=True)
                root = roots_of(len(nodes), where[: len(left)], where[len(left) :])
                rest = np.flatnonzero(root != np.arange(len(nodes)))
                some, those = np.flatnonzero(count), np.flatnonzero(back)
                a = np.concatenate([nodes[rest], mine[some], other[those]])
                b = np.concatenate([nodes[root[rest]], np.full(len(some) + len(those), -1)])
                n = np.concatenate([np.zeros(len(rest), np.int64), count[some], back[those]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, n)], ["a", "b", "n"])

    found_links = checkpoint(spark, map_arrow(cells, search, "a long, b long, n long"))
    links = found_links.filter("b >= 0").select("a", "b").distinct()
    counts = found_links.filter("b < 0").groupBy("a").agg(F.sum("n").alias("others"))
    named = classes.select(F.col("cid").alias("node"), "rep", "copies")
    parts = connected_components(spark, links)
    member = named.join(parts, "node", "left").join(counts.select(F.expr("a ^ 0L").alias("node"), "others"), "node", "left")
    member = member.select("node", "rep", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "node").alias("part"))
    member = checkpoint(spark, member)
    smallest = member.groupBy("part").agg(F.min("rep").alias("component_id"))
    smallest = smallest.select(F.expr("part ^ 0L").alias("part"), "component_id")
    found = checkpoint(
        spark,
        member.join(smallest, "part")
        .select(F.col("node").alias("cid"), (F.col("copies") - 1 + F.col("others")).alias("n_links"), "component_id")
        .join(classes.select("cid", "label", "e"), "cid")
        .select("label", "e", "n_links", "component_id"),
    )
    keyed = rows.withColumn("e", F.when(F.col("sound"), F.expr("transform(e, v -> v + 0D)")))
    joined = keyed.filter("sound").join(found, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = keyed.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unit_block(data: bytes, d: int) -> np.ndarray:
    x = np.frombuffer(data, "<f8").reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that very large or small components do not overflow the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)
