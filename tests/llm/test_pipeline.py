"""The pipeline's stages on planted cases, and the guard for its absence."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sievemill.llm import simhash
from sievemill.llm.common import table


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("score"))


def _words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def test_near_copies_go_and_others_stay(spark, sf):
    rng = np.random.default_rng(1)
    rows, near = [], []
    for k in range(40):
        words = _words(rng, 300).split()
        rows.append((k, " ".join(words)))
        edited = list(words)
        edited[int(rng.integers(20, 280))] = "changed"
        rows += [(1000 + k, " ".join(edited)), (2000 + k, " ".join(words))]
        near += [1000 + k, 2000 + k]
        part = words[:150] + _words(rng, 150).split()
        rows.append((3000 + k, " ".join(part)))
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (6000, "short text"), (6001, "short text")]
    kept = [r["doc_id"] for r in pipeline.drop_near_copies(spark, _docs(spark, rows), sf).collect()]
    assert set(range(40)) | {3000 + k for k in range(40)} | {5000, 6000, None} <= set(kept)
    assert 5001 not in kept and 6001 not in kept
    assert sum(i in kept for i in near) <= 2
    assert pipeline.drop_near_copies(spark, _docs(spark, rows).limit(0), sf).count() == 0


def test_repeated_passages_are_cut(spark, sf):
    rng = np.random.default_rng(2)
    passage = _words(rng, 60)
    rows = [(k, _words(rng, 30) + " " + passage + " é " + _words(rng, 30)) for k in range(5)] + [(9, passage), (10, None), (11, "tiny")]
    got = {r["doc_id"]: r for r in pipeline.cut_repeats(spark, _docs(spark, rows), sf).collect()}
    assert passage in got[0]["text"] and all(passage[5:-5] not in got[k]["text"] for k in range(1, 5))
    assert 9 not in got and got[11]["text"] == "tiny" and got[10]["text"] == "" and got[1]["lang"] == "en"


def test_personal_data_is_masked(spark, sf):
    rows = [(1, "write to a.b@c.example or +49 170 1234567 now"), (2, "clean text stays as it is"), (3, None)]
    got = {r["doc_id"]: r["text"] for r in pipeline.mask_personal_data(spark, _docs(spark, rows), sf).collect()}
    assert got == {1: "write to <EMAIL> or <PHONE> now", 2: "clean text stays as it is", 3: ""}


def test_all_stages(spark, sf):
    docs, columns = table(spark, sf, "documents"), set(pipeline.COLUMNS)
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert columns == set(docs.columns), name
        docs = docs.cache()
        assert 0.5 * before < docs.count() <= before
    assert not docs.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@mail[0-9]+\.example\.com")).count()
    whole = pipeline.run(spark, sf)
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert whole.select("doc_id").distinct().count() == docs.count()
    assert len(pipeline.STAGES) == 5 and re.fullmatch("[a-z_]+", pipeline.STAGES[0][0])


def _similarity(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


def test_near_copies_at_the_threshold_go(spark, sf):
    rng = np.random.default_rng(7)
    rows, near = [], []
    for k in range(60):
        words = _words(rng, 300).split()
        rows.append((k, " ".join(words)))
        edited = list(words)
        for i in range(6):  # each change costs five shingles: similarity about 0.81
            edited[10 + 45 * i] = f"changed{k}x{i}"
        rows.append((1000 + k, " ".join(edited)))
        near.append(0.8 <= _similarity(*(r[1] for r in rows[-2:])) < 0.85)
        for i in (6, 7):
            edited[12 + 20 * i] = f"other{i}"
        rows.append((2000 + k, " ".join(edited)))  # under 0.8 to the first, over to the second
    assert all(near)
    kept = {r["doc_id"] for r in pipeline.drop_near_copies(spark, _docs(spark, rows), sf).collect()}
    assert not kept & set(range(1000, 1060)) and set(range(60)) <= kept
    text = dict(rows)
    assert {i for i in range(2000, 2060) if _similarity(text[i], text[i - 2000]) < 0.8} == {i for i in kept if i >= 2000}


def test_near_copies_of_late_heads_go(spark, sf):
    rng = np.random.default_rng(8)
    words, rows = _words(rng, 300).split(), []
    for k in range(12):  # each text is near its neighbours in the chain only: every other one is a head
        rows.append((k, " ".join(words)))
        for i in range(5):
            words[(5 + 60 * i + 5 * k) % 300] = f"step{k}x{i}"
    kept = []
    for i, text in rows:
        if all(_similarity(text, rows[j][1]) < 0.8 for j in kept):
            kept.append(i)
    assert len(kept) > 4
    assert {r["doc_id"] for r in pipeline.drop_near_copies(spark, _docs(spark, rows), sf).collect()} == set(kept)


def test_what_stays_equals_brute_force(spark):
    """Families of edited texts around the threshold, in which heads go too, against going through all texts in order."""
    rng = np.random.default_rng(12)
    rows = []
    for family in range(12):
        members = [_words(rng, 120).split()]
        for _ in range(25):
            words = list(members[int(rng.integers(len(members)))])
            for i in rng.integers(0, 120, int(rng.integers(1, 5))):
                words[i] = _words(rng, 1)
            members.append(words)
        rows += [" ".join(m) for m in members]
    rows += ["", " ", "one two", "one  two", "one two three", rows[0], rows[30]]
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[j]) for i, j in enumerate(order)]
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set() for i, t in rows}
    kept, links = [], 0
    for i, _ in rows:
        alike = [j for j in kept if not (shingles[i] | shingles[j]) or len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
        links += len(alike)
        if not alike:
            kept.append(i)
    assert links > 100 and len(kept) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = {r["doc_id"] for r in simhash.redundant(spark, docs).collect()}
    assert gone == {i for i, _ in rows} - set(kept)


def test_one_doc_id_with_two_texts(spark, sf):
    rows = [(1, "a b c d e f g"), (7, "a b c d e f g"), (7, "h i j k l m n"), (7, "h i j k l m n")]
    got = sorted((r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, _docs(spark, rows), sf).collect())
    assert got == [rows[0], rows[2], rows[3]]


def test_stages_on_awkward_tables(spark, sf):
    docs = _docs(spark, [(None, None), (1, None), (1, ""), (2, "x"), (2, "x")]).withColumn("spans", F.lit(1)).withColumn("extra", F.lit(2))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 3
        assert stage(spark, docs.limit(0), sf).count() == 0
