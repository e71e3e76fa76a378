"""Document fingerprints: bottom-k sketches of word shingles, in built-in SQL functions alone.

A sketch is the k smallest distinct hashes of a text's shingles, in order. Two sketches give the sketch of the union by
merging, so parts of a text or of a corpus can be sketched apart; what both share of the union's sketch estimates the
resemblance, and the k-th hash the number of distinct shingles. A text with fewer words than a shingle is one shingle;
a text without words has an empty sketch. Up to k distinct shingles, every estimate is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WIDTH = 5
#: What Spark's regular expressions call white space.
_BLANK = " \t\n\x0b\f\r"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all word shingles of a text, repeats included."""
    trimmed = F.trim(text, F.lit(_BLANK))
    words = F.transform(F.split(trimmed, r"\s+"), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        slots = F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))
        return F.transform(slots, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))

    return F.when(F.length(trimmed) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(bound(words, of))


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text; null: that of an empty text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit("")), width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One merged sketch for each key; each task passes on at most k hashes of a key."""
    hashes = sketches.select(*keys, F.explode(column).alias("h")).distinct()
    ranked = hashes.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("n") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both; two empty sketches are alike."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained in anything."""
    r, n_a, n_b = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (n_a + n_b) / n_a))


def as_text(a: Column) -> Column:
    """A sketch as a string: base64 of its hashes, 8 bytes each."""
    lines = F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))
    return F.replace(lines, F.lit("\r\n"), F.lit(""))


def _bucket(key: Column, bounds: list[int], fan: int = 64) -> Column:
    """How many of the sorted bounds are at most the key, found in two steps."""
    if not bounds:
        return F.lit(0)
    tops = F.array(*[F.lit(b) for b in bounds[::fan]])
    groups = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + fan]]) for i in range(0, len(bounds), fan)])
    first = F.size(F.filter(tops, lambda b: b <= key))
    inside = bound(first, lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * fan + F.size(F.filter(F.element_at(groups, g), lambda b: b <= key))))
    return inside


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, bucket_rows: int = 500) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is replaced by the next text's beginning.

    ``doc_id, text`` rows; null texts count as empty. The next document is that of the next doc_id (null ones come
    first; rows of one doc_id in the order of their texts), and after the last comes the first. Rows are dealt to ranges
    of ids, at most 4,096, whose bounds are approximate quantiles; the first rows of each range are also sent to the
    range before, so no global order is ever built in one task. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    n = rows.count()
    parts = max(1, min(4096, -(-n // bucket_rows)))
    bounds = sorted({int(x) for x in rows.approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []
    placed = rows.withColumn("bucket", _bucket(F.col("key"), bounds))
    # at most one row for each range
    firsts = sorted((r["bucket"], r["key"]) for r in placed.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    before = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    spark = docs.sparkSession
    ghosts = spark.createDataFrame(before, "key long, before int")
    copies = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ghost")))))
    spread = placed.join(F.broadcast(ghosts), "key", "left").select("doc_id", "text", "key", F.explode(copies).alias("c")).select("doc_id", "text", "key", "c.*")
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "text")
    own = spread.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next"), F.lit(1), cut))
    made = own.withColumn("edited", F.when(F.col("ghost") == 0, edited)).select(
        "doc_id", "n_chars", "bucket", "ghost", "key", "text",
        F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k, width).alias("s"),
        F.when(F.col("ghost") == 0, sketch(F.col("edited"), k, width)).alias("e"),
    )
    made = made.withColumn("s_next", F.lead("s").over(order)).filter("ghost = 0")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("s_next"), k).alias("near_next"),
        distinct_count(F.col("s"), k).alias("n_shingles"),
    )
