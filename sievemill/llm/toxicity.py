"""Toxicity scores by weak supervision.

Many voters look at a text: lexicon voters (a stated list, and terms and word beginnings mined from the training rows),
pattern voters (insults aimed at a person, shouting, repeated marks), voters against, and the human label where a
training row has one. A generative label model is fitted by expectation-maximisation: each text has a hidden label, and
each voter a rate of voting for, against or not at all under either label. Voters that agree more than the hidden label
explains are correlated, and their votes are weighted down by that correlation. A linear classifier over hashed words
and word beginnings, the voters' findings among them, is then trained on the posterior labels and scores whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import hand_back, map_arrow

#: A lexicon of insults.
LEXICON = (
    "idiot idiots moron morons stupid dumb fool loser losers pathetic worthless disgusting trash garbage scum clown "
    "filth vermin pig scumbag jerk bastard bitch asshole fuck fucking shit crap damn hate kill "
    "idiota imbécil estúpido estúpida basura asco mierda cabrón puta tonto "
    "idiote imbécile stupide connard salope merde ordure débile crétin pourriture "
    "dumm dummkopf trottel arschloch scheiße abschaum depp vollidiot schwachkopf widerlich"
).split()

SPACE = 1 << 18
_WORD = re.compile(r"\w+")
_AIMED = re.compile(r"\b(?:you|you're|ur|tu|du|vous|usted|eres|bist)\b[^.!?\n]{0,40}\b(?:" + "|".join(LEXICON) + r")\b")
_MARKS = re.compile(r"!{3,}|\?{3,}|[!?]{4,}")
_LEXICON = frozenset(LEXICON)
#: Features of their own, at the table's end.
_SEED, _AIMED_AT, _MARKED, _SHOUTED = SPACE, SPACE + 1, SPACE + 2, SPACE + 3
N_FEATURES = SPACE + 4


def _hashed(term: str) -> int:
    return zlib.crc32(term.encode()) % SPACE


def _capitals(text: str, lower: str) -> int:
    """Letters that lower-casing changes."""
    if len(text) != len(lower):
        return sum(map(str.isupper, text))
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (text, lower))
    return int(np.count_nonzero(a != b))


def features(text: str) -> set[int]:
    """Hashed words and word beginnings of five and seven letters, each once, and what the patterns find."""
    lower = text.lower()
    words = set(_WORD.findall(lower))
    terms = words | {"^" + w[:5] for w in words if len(w) > 5} | {"^" + w[:7] for w in words if len(w) > 7}
    found = set(map(_hashed, terms))
    if not _LEXICON.isdisjoint(words):
        found.add(_SEED)
        if _AIMED.search(lower):
            found.add(_AIMED_AT)
    if _MARKS.search(text):
        found.add(_MARKED)
    if len(text) > 20 and 2 * _capitals(text, lower) > len(text):
        found.add(_SHOUTED)
    return found


@dataclass
class Model:
    weight: np.ndarray  # a term's hash -> weight
    bias: float
    voters: list[dict]  # per voter: what it looks for, its rates under either label, its share after correlation

    def score(self, text: str, lookup: dict[int, float]) -> float:
        z = self.bias + sum(lookup[f] for f in features(text) if f in lookup)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _mined(doc: np.ndarray, feature: np.ndarray, label: np.ndarray, most: int, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features whose presence speaks for the label (strongest first) and those that speak against it."""
    pos = np.bincount(feature, label[doc] == 1, N_FEATURES)
    neg = np.bincount(feature, label[doc] == 0, N_FEATURES)
    n_pos, n_neg = max((label == 1).sum(), 1), max((label == 0).sum(), 1)
    a, b = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    # the lower end of the log odds' interval, so that rare terms must be clearer than frequent ones
    odds = np.log(a / (1 - a).clip(1e-9)) - np.log(b / (1 - b).clip(1e-9))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) + 1 / n_pos + 1 / n_neg)
    sure = odds - 3.0 * error
    against = -odds - 3.0 * error
    enough = pos + neg >= least_rows
    up = np.flatnonzero(enough & (sure > 0.7))
    down = np.flatnonzero(enough & (against > 0.7))
    return up[np.argsort(-sure[up], kind="stable")][:most], down[np.argsort(-against[down], kind="stable")][:most]


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, rates (voters, label, vote) and each voter's share.

    ``votes``: rows x voters of -1, 0 (abstains) and 1. Starts from the votes' majority.
    """
    n, m = votes.shape
    start = votes.sum(axis=1)
    q = np.where(start > 0, 0.8, np.where(start < 0, prior / 4, prior))
    share = np.ones(m)
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    rates = np.zeros((m, 2, 3))
    for step in range(rounds):
        for y, w in ((0, 1 - q), (1, q)):
            counts = np.einsum("i,ijv->jv", w, cast) + np.array([0.5, 1.0, 0.5])
            rates[:, y] = counts / counts.sum(axis=1, keepdims=True)
        if step in (5, 15) and n > 2:
            # what remains of the votes once the hidden label's share is taken away; its correlations
            mean = rates[:, :, 2] - rates[:, :, 0]
            rest = votes - (q[:, None] * mean[:, 1] + (1 - q[:, None]) * mean[:, 0])
            rest = rest / np.maximum(rest.std(axis=0), 1e-6)
            together = np.abs(rest.T @ rest / n)
            np.fill_diagonal(together, 0)
            share = 1 / (1 + np.where(together > 0.15, together, 0).sum(axis=1))
        gain = np.log(rates[:, 1]) - np.log(rates[:, 0])
        z = math.log(prior / (1 - prior)) + np.einsum("ijv,jv,j->i", cast, gain, share)
        q = 1 / (1 + np.exp(-z.clip(-30, 30)))
    return q, rates, share


def _unlike(doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """A mask of rows without those that look like copies of earlier ones: four least hashes of the features agree.

    Copies of one text would otherwise make all of its words evidence for its label.
    """
    least = np.zeros((n, 4), np.uint64)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        mixed = (feature.astype(np.uint64) + np.uint64(1)) * np.uint64(factor)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        column = np.full(n, np.iinfo(np.uint64).max)
        np.minimum.at(column, doc, mixed)
        least[:, k] = column
    kept = np.zeros(n, bool)
    kept[np.unique(least, axis=0, return_index=True)[1]] = True
    return kept


def fit(doc: np.ndarray, feature: np.ndarray, label: np.ndarray, most_terms: int = 2000, groups: int = 24) -> Model:
    """``doc, feature``: which row has which feature; ``label``: 1, 0, or -1 where a row has none."""
    kept = _unlike(doc, feature, len(label))
    place = np.cumsum(kept) - 1
    doc, feature, label = place[doc[kept[doc]]], feature[kept[doc]], label[kept]
    n = len(label)
    human = label >= 0
    prior = float(np.clip((label == 1).sum() / max(human.sum(), 1), 0.005, 0.5)) if human.any() else 0.05
    weight = np.zeros(N_FEATURES)
    base = math.log(prior / (1 - prior))
    if not n or not len(doc):
        weight[[_SEED, _AIMED_AT]] = 2.0
        return Model(weight, base, [])
    up, down = _mined(doc, feature, np.where(human, label, 2), most_terms, max(3, n // 4000))

    def present(wanted: np.ndarray) -> np.ndarray:
        table = np.zeros(N_FEATURES, bool)
        table[wanted] = True
        hit = np.zeros(n, bool)
        hit[doc[table[feature]]] = True
        return hit

    names, columns = ["label"], [np.where(label == 1, 1, np.where(label == 0, -1, 0))]
    for name, f in (("lexicon", _SEED), ("aimed", _AIMED_AT), ("marks", _MARKED), ("shouting", _SHOUTED)):
        names.append(name)
        columns.append(present(np.array([f])).astype(int))
    for name in LEXICON:
        if (hit := present(np.array([_hashed(name)]))).any():
            names.append(f"word {name}")
            columns.append(hit.astype(int))
    for k in range(groups):
        if len(up[k::groups]):
            names.append(f"mined {k}")
            columns.append(present(up[k::groups]).astype(int))
    any_up = np.max(np.stack(columns[1:]), axis=0) > 0
    names += ["nothing found", "mined against"]
    columns += [np.where(any_up, 0, -1), -(present(down) & ~any_up).astype(int) if len(down) else np.zeros(n, int)]
    votes = np.stack(columns, axis=1)
    q, rates, share = label_model(votes, prior)

    # the classifier sees what was mined and what the voters look for
    use = np.unique(np.concatenate([up, down, [_SEED, _AIMED_AT, _MARKED, _SHOUTED], [_hashed(w) for w in LEXICON]]).astype(int))
    slot = np.full(N_FEATURES, -1)
    slot[use] = np.arange(len(use))
    seen = slot[feature] >= 0
    row, col = doc[seen], slot[feature[seen]]
    w, b = _logistic(row, col, q, len(use))
    weight[use] = w
    voters = [{"name": a, "for": r[:, 2].tolist(), "against": r[:, 0].tolist(), "share": float(s)} for a, r, s in zip(names, rates, share)]
    return Model(weight, b, voters)


def _logistic(row: np.ndarray, col: np.ndarray, target: np.ndarray, width: int, ridge: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on soft labels, by accelerated gradient steps scaled per feature."""
    n = len(target)
    w, b = np.zeros(width), math.log(target.mean().clip(1e-4, 0.99) / (1 - target.mean().clip(1e-4, 0.99)))
    scale = 1 / (0.25 * np.bincount(col, minlength=width) + ridge)
    crowd = max(1.0, float(np.bincount(row, minlength=n).max(initial=1)) ** 0.5)
    lead, t = w.copy(), 1.0
    for _ in range(steps):
        z = (b + np.bincount(row, lead[col], n)).clip(-30, 30)
        error = 1 / (1 + np.exp(-z)) - target
        step = lead - scale / crowd * (np.bincount(col, error[row], width) + ridge * lead)
        b -= error.sum() / (0.25 * n) / crowd
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        lead = step + (t - 1) / t2 * (step - w)
        w, t = step, t2
    return w, float(b)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model:
    """Learn from the ``labels`` (doc_id, toxic) given and the texts of ``docs`` (doc_id, text).

    The bound of the training sample: about ``sample`` labelled rows, chosen by a hash of doc_id; with fewer, all are
    taken. Labels that are null, or whose text is missing, are left out; of repeated labels the largest counts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = known.count()
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("toxicity sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = known.filter(chance < min(1.0, sample / max(n, 1)))
    some = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # bounded by ``sample``, and so small enough for every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.fromiter(sorted(features(t.as_py() or "")), "<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "f"])

    got = map_arrow(rows.select("doc_id", "text", "toxic"), run, "doc_id long, toxic int, f binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    label = got.column("toxic").to_numpy()[order]
    raw = got.column("f").to_pylist()
    parts = [np.frombuffer(raw[i], "<i4") for i in order]
    feature = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, int)
    del got, raw, parts
    model = fit(doc, feature, label)
    del doc, feature
    hand_back()
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of ``doc_id, text`` rows; null texts count as empty, repeated rows are scored each, an empty table
    gives no rows."""
    return flag(spark, docs.select("doc_id", "text"), model).select("doc_id", "score")


def flag(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns kept (but one named score, which is replaced), with a column ``score``.

    Null texts count as empty; repeated rows are scored each; an empty table gives no rows.
    """
    docs = docs.drop("score")
    weights = {int(i): float(model.weight[i]) for i in np.flatnonzero(model.weight)}
    shared = spark.sparkContext.broadcast((Model(np.zeros(0), model.bias, []), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lookup = shared.value
        for batch in batches:
            found = [model.score(t.as_py() or "", lookup) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
