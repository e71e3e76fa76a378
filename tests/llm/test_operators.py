"""The training-data operators against brute force, libraries and held-out labels, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from sievemill.llm import hnsw, language, packing, pii, simhash, sketch, suffixes, toxicity, wordpiece
from sievemill.llm.bpe import ByteBpe, WordBpe, encode_documents
from sievemill.llm.common import keyed_text, table
from sievemill.llm.components import connected_components
from sievemill.llm.queries import BYTE_PATTERN, QUERIES, tokenizer_path

LONG = "ab cd " * 4000
AWKWARD = [
    (1, "hello world"), (1, "hello world"), (1, "another text"), (None, "no id"), (None, None), (2, None), (3, ""), (4, " \n\t "),
    (5, LONG), (6, LONG), (7, "a" * 3000), (8, "éèü 中文 🙂 <|endoftext|> \x00 \x1c end"), (9, "x@y.zz 1.2.3.4 +1 (555) 123-4567; 4111 1111 1111 1111"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.withColumn("score", F.lit(1)).withColumn("base", F.lit("x")).withColumn("bucket", F.lit(2)).withColumn("fp", F.lit(3)).withColumn("lang", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return keyed_text(table(spark, sf, "documents"))


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# -- BPE ---------------------------------------------------------------------------------------------------------------


def test_encoders_equal_the_library(texts):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    parts = ["a", "B", " ", "  ", "\n", "é", "e\u0301", "\u0301", "Σ", "<|endoftext|>", "<|", "|>", "'s", "'", "1", "中", "🙂", "word", "!?"]
    made = ["".join(rng.choice(parts, int(n))) for n in rng.integers(1, 60, 400)]
    by_halves = WordBpe(tokenizer_path("word_bpe_49k.json"), leaf=3, span=5)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for text in [*made, *[t[:3000] for t in list(texts.values())[:10]]]:
        assert np.frombuffer(by_halves.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    odd = ["", " ", "  a  b", "'S 's don't", "Σς ΟΔΟΣ İ ß", "\x1c\x85 ﻿ x", "a" * 700, "!?" * 400, "中文日本" * 90, "<|endoftext|>a <|startoftext|>", "1२ⅷ é é", "\r\n\t x　y"]
    for name, encoder in (("word_bpe_49k.json", WordBpe(tokenizer_path("word_bpe_49k.json"))), ("byte_bpe_50k.json", ByteBpe(tokenizer_path("byte_bpe_50k.json"), BYTE_PATTERN))):
        library = Tokenizer.from_file(tokenizer_path(name))
        for text in [*list(texts.values())[:60], *odd]:
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
            if name.startswith("word"):
                assert encoder.decode(encoder.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_tree_concatenation_is_exact():
    e = WordBpe(tokenizer_path("word_bpe_49k.json"), leaf=4)
    rng = np.random.default_rng(5)
    for _ in range(300):
        raw = bytes(rng.choice(list(b"abdehinorstu"), rng.integers(1, 120)))
        symbols = [e.inner[b] for b in raw[:-1]] + [e.final[raw[-1]]]
        assert e.tree(symbols) == e.merge(list(symbols))


def test_encode_documents_awkward(awkward, none):
    rows = encode_documents(awkward, tokenizer_path("word_bpe_49k.json"), keep_ids=True).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert all(r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() for r in rows)
    assert encode_documents(none, tokenizer_path("word_bpe_49k.json")).count() == 0


# -- word pieces -------------------------------------------------------------------------------------------------------


def _greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        pool = first if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_counts_equal_greedy_matching(texts):
    rng = np.random.default_rng(2)
    for _ in range(200):
        first = {"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(6)}
        rest = {"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(6)}
        counter = wordpiece.PieceCounter(first, rest)
        for _ in range(20):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
            assert counter.walk(word) == _greedy(word, first, rest)
    first, rest = map(set, wordpiece.vocabulary_of(tokenizer_path("byte_bpe_50k.json")))
    counter = wordpiece.counter_of(tokenizer_path("byte_bpe_50k.json"))
    for text in list(texts.values())[:20]:
        words = re.findall(r"\w+|[^\w\s]", text)
        each = [_greedy(w, first, rest) for w in words]
        assert counter.count(text) == (len(words), sum(n or 1 for n in each), each.count(0))


def test_count_awkward(awkward, none):
    rows = wordpiece.count_tokens(awkward, tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(AWKWARD) and all(r["n_tokens"] >= r["n_words"] for r in rows)
    assert wordpiece.count_tokens(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


# -- language ----------------------------------------------------------------------------------------------------------


def test_code_lengths_equal_a_plain_coder():
    import math

    train = {"x": "abracadabra abba", "y": "hello yellow fellow"}
    order = 2
    counts = {}
    for lang, text in train.items():
        raw = b" " * order + text.encode()
        counts[lang] = {}
        for i in range(len(raw) - order):
            g = int.from_bytes(raw[i : i + order + 1], "big")
            counts[lang][g] = counts[lang].get(g, 0) + 1
    model = language.train(counts, order)

    def bits(lang, text):
        raw = b" " * order + train[lang].encode()
        stats = [{} for _ in range(order + 1)]
        for i in range(order, len(raw)):
            for k in range(order + 1):
                stats[k].setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                stats[k][raw[i - k : i]][raw[i]] += 1
        total, padded = 0.0, b" " * order + text
        for i in range(order, len(padded)):
            for k in range(order, -1, -1):
                seen = stats[k].get(padded[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if padded[i] in seen:
                    total += math.log2((n + d) / seen[padded[i]])
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8
        return total

    for text in (b"abra", b"yellow bra", b"zzz", b"he\xffllo"):
        for i, lang in enumerate(model.languages):
            assert model.lengths(text)[i] / language.UNIT == pytest.approx(bits(lang, text), abs=0.01 * len(text))
    for laid_out in (0, 1, 5):  # however few contexts are laid out, all count, and alike
        other = language.train(counts, order, laid_out)
        assert len(other.listed_page) and all((other.lengths(t) == model.lengths(t)).all() for t in (b"abra", b"yellow bra", b"zzz", b"he\xffllo", b""))


def test_language_held_out_and_awkward(spark, sf, awkward, none):
    rows = QUERIES["op3_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert {r["held_out"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2} == {True}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    model = language.learn(spark, table(spark, sf, "documents"))
    found = language.predict(spark, awkward, model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert [r["lang_pred"] for r in found if r["doc_id"] in (2, 3, 4)] == ["und"] * 3
    assert language.predict(spark, none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(spark, awkward, language.learn(spark, none)).collect()} == {"und"}


# -- SimHash -----------------------------------------------------------------------------------------------------------


def _plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark, sf, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op4_simhash_neardup"](spark, sf).collect()}
    ids = sorted(texts)
    prints = [_plain_fingerprint(texts[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    part = _components(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert [rows[i]["component_id"] for i in ids] == [ids[p] for p in part]


@pytest.mark.parametrize("crowd", [4096, 8])
def test_trie_join_on_dense_and_split_groups(spark, crowd):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    values = set()
    for b in base:
        for _ in range(60):
            v = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame(list(zip(signed, range(len(values)))), "fp long, id long")
    found = {r["node"]: r["component"] for r in connected_components(spark, simhash.linked_stars(spark, prints, crowd=crowd)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == _components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)


@pytest.mark.parametrize("held", [1, 3, 7, 100])
def test_cells_come_whole(held):
    rng = np.random.default_rng(held)
    cells = np.sort(rng.integers(0, 9, 60))
    cells[20:45] = cells[20]
    cells.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.arange(len(c)))], ["cell", "n"]) for c in np.split(cells, [0, 4, 5, 5, 30, 31, 52])]
    got = [t.column("cell").to_numpy() for t in simhash.whole_cells(iter(batches), 0, held)]
    assert (np.concatenate(got) == cells).all() and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
    assert list(simhash.whole_cells(iter(batches[:1]), 0, held)) == []


def test_simhash_awkward(spark, awkward, none):
    rows = simhash.near_duplicates(spark, awkward).collect()
    assert len(rows) == len(AWKWARD)
    part = {r["doc_id"]: r["component"] for r in rows if r["doc_id"] is not None and r["doc_id"] != 1}
    assert part[2] == part[3] == part[4] == 2 and part[5] == part[6] == 5
    assert simhash.near_duplicates(spark, none).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert found == {i: 1 for i in range(2, 61)} | {i: 100 for i in range(101, 160)}


# -- sketches ----------------------------------------------------------------------------------------------------------


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _edited(ids, texts):
    for i, a in enumerate(ids):
        t, nxt = texts[a], texts[ids[(i + 1) % len(ids)]]
        cut = len(t) // 4
        yield a, t[: len(t) - cut] + nxt[:cut], nxt


def test_fingerprints_follow_the_contract(spark, sf, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op5_fingerprints"](spark, sf).collect()}
    assert sorted(rows) == sorted(texts)
    by_text, error = {}, []
    for i, edited, nxt in _edited(sorted(texts), texts):
        r, t = rows[i], texts[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        for name, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = _shingles(t), _shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            error.append(abs(true - r[name]))
            if len(a | b) <= sketch.K:
                assert r[name] == pytest.approx(true)
    assert max(error) < 0.25 and np.mean(error) < 0.03


def test_next_document_across_ranges(spark, texts):
    some = {i: f"t{i} one two three four five six seven {i}" for i in range(0, 900, 3)}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r["edited_sha256"] for r in sketch.edited_fingerprints(df, bucket_rows=7).collect()}
    assert rows == {i: hashlib.sha256(e.encode()).hexdigest() for i, e, _ in _edited(sorted(some), some)}


def test_sketches_merge_and_awkward(spark, awkward, none):
    rows = sketch.edited_fingerprints(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r["near_edited"] for r in rows if r["doc_id"] in (2, 3)} == {1.0}
    assert sketch.edited_fingerprints(none).count() == 0
    long = " ".join(f"w{i}" for i in range(3000))
    half = " ".join(f"w{i}" for i in range(1500))
    df = spark.createDataFrame([(1, long, half)], "k int, a string, b string").select("k", sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    got = df.select(sketch.resemblance(F.col("a"), F.col("b")), sketch.containment(F.col("b"), F.col("a")), sketch.distinct_count(F.col("a")), F.expr("true")).first()
    assert abs(got[0] - 0.5) < 0.15 and got[1] > 0.8 and abs(got[2] - 2996) < 900
    parts = df.select("k", F.col("a").alias("sketch")).unionByName(df.select("k", F.col("b").alias("sketch")))
    assert sketch.merge_by(parts, ["k"]).first()["sketch"] == df.first()["a"]


# -- personal data -----------------------------------------------------------------------------------------------------

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out = []
    for rank, (kind, pattern) in enumerate(_PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and _luhn(d) or kind == "phone" and 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_plain_patterns(spark, sf, texts):
    rng = np.random.default_rng(9)
    made = {10_000 + i: "".join(rng.choice(["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "255.", "256", "+49 ", "(0)", "4111 1111 1111 1111", "-", " ", "é", "🙂", "12", "x"], 14)) for i in range(400)}
    made |= {20_000: "a@b" + ".c" * 5000, 20_001: "1" * 30_000 + " " + "a." * 30_000, 20_002: "1.2.3.4.5.6.7.8"}
    df = spark.createDataFrame(list((texts | made).items()), "doc_id long, text string")
    rows = df.select("doc_id", pii.base_spans(F.col("text")).alias("b")).select("doc_id", F.transform("b", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))).alias("b")).collect()
    for r in rows:
        assert r["b"] == _base((texts | made)[r["doc_id"]]), r["doc_id"]
    found = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, sf).collect()}
    for i, t in texts.items():
        want = _base(t)
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert found[i]["n_email"] == sum(s.startswith("email") for s in want)
        assert set(want) <= set(filter(None, found[i]["spans"].split(",")))


def test_revealing_terms_go_and_common_ones_stay(spark):
    filler = ["the weather was fine on that day number %d" % i for i in range(300)]
    named = [f"on day {i} mister zanzibar wrote from zan@corp.example about item{i} the weather" for i in range(6)]
    df = spark.createDataFrame(list(enumerate(filler + named + ["zanzibar is a place", "copy q@q.example unique", "copy q@q.example unique", "copy q@q.example unique"])), "doc_id long, text string")
    rows = pii.find(spark, df).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).collect()
    by = {r["doc_id"]: r for r in rows}
    for i in range(300, 306):
        assert "zan@corp" not in by[i]["clean"] and "zanzibar" not in by[i]["clean"] and "weather" in by[i]["clean"] and f"item{i - 300}" in by[i]["clean"]
    assert by[306]["clean"] == "zanzibar is a place" and by[307]["clean"] == "copy <EMAIL> unique"
    assert all(by[i]["clean"] == filler[i] for i in range(300))


def test_revealing_terms_go_far_from_the_value_too(spark):
    filler = ["the weather was fine on that day number %d" % i for i in range(300)]
    named = [f"on day {i} mister zanzibar wrote from zan@corp.example about item{i} the weather" for i in range(6)]
    far = "zan@corp.example " + "the weather was fine on that day " * 8 + "said zanzibar"
    df = spark.createDataFrame(list(enumerate(filler + named * 3 + [far, "said zanzibar"])), "doc_id long, text string")
    by = {r["doc_id"]: r["clean"] for r in pii.find(spark, df).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).collect()}
    assert "zanzibar" not in by[318] and by[318].startswith("<EMAIL> the weather was fine") and by[319] == "said zanzibar"


def _disclosing(rows, rule):
    """doc_id -> term -> part given away, by the definition."""
    of = lambda text: [m[0] for m in regex.finditer(r"\p{L}[\p{L}\p{M}\p{N}_]{2,39}", text.lower())]
    seen, together, texts, mentions = Counter(), Counter(), {}, {}
    for i, (_, text) in enumerate(rows):
        seen.update(set(of(text)))
        beside = {}
        for span in _base(text):
            kind, a, b = span.split(":")
            a, b = int(a), int(b)
            left, right = text[max(0, a - rule.reach) : a], text[b : b + rule.reach]
            left = regex.sub(r"^[\p{L}\p{M}\p{N}_]+", "", left) if a > rule.reach else left
            right = regex.sub(r"[\p{L}\p{M}\p{N}_]++$", "", right) if len(right) == rule.reach else right
            entity = kind, regex.sub(r"[^\p{L}\p{N}@.]", "", text[a:b].lower())
            beside.setdefault(entity, set()).update(of(left + " \n " + right))
        for entity, terms in beside.items():
            mentions.setdefault(entity, []).append(i)
            for t in terms:
                together[entity, t] += 1
                texts.setdefault((entity, t), set()).add(text)
    out = {}
    for (entity, t), n in together.items():
        information = -math.log2(len(mentions[entity]) / (len(rows) + 1))
        given = (math.log2(min(1, n / seen[t])) + information) / information
        if len(texts[entity, t]) >= rule.support and given >= rule.generalise:
            for i in mentions[entity]:
                best = out.setdefault(rows[i][0], {})
                best[t] = max(best.get(t, 0), given)
    return out


def test_disclosing_terms_equal_brute_force(spark, texts):
    rng = np.random.default_rng(6)
    common = ["river", "mountain", "letter", "harbour", "wrote", "again", "paper", "said"]
    made = []
    for i in range(240):
        person = i % 12
        value = [f"p{person}@mail.example", f"+49 (170) 55512{person:02d}", f"10.0.{person}.7"][person % 3]
        words = list(rng.choice(common, 20)) + [f"name{person}"] * 2 + [f"town{person % 4}"]
        rng.shuffle(words)
        made.append((50_000 + i, " ".join([*words[:12], *[value] * (i % 3 != 0), *words[12:], *rng.choice(common, 30), f"name{person}"])))
    rows = [*texts.items(), *made, *[(60_000 + i, made[1][1]) for i in range(3)]]
    rule = pii.Disclosure(generalise=0.6, remove=0.9)
    want = _disclosing(rows, rule)
    got = {}
    for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"), rule).filter("size(spans) > size(base)").collect():
        got[r["doc_id"]] = {s["value"].lower(): s["action"] for s in r["spans"] if s["kind"] == "term"}
    inside = {}
    for i, text in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in _base(text)]
        for m in regex.finditer(r"(?<![\p{L}\p{M}\p{N}_])\p{L}[\p{L}\p{M}\p{N}_]{2,39}(?![\p{L}\p{M}\p{N}_])", text):
            given = want.get(i, {}).get(m[0].lower())
            if given is not None and not any(a < m.end() and m.start() < b for a, b in base):
                inside.setdefault(i, {})[m[0].lower()] = "remove" if given >= rule.remove else "generalise"
    assert got == inside and {a for x in got.values() for a in x.values()} == {"remove", "generalise"}


def test_pii_awkward(spark, awkward, none):
    found = pii.find(spark, awkward.withColumn("spans", F.lit(0)).withColumn("actions", F.lit(1)))
    assert sorted(found.columns) == sorted(["doc_id", "text", "score", "base", "bucket", "fp", "lang", "spans", "actions"])
    rows = pii.digest(found).collect()
    assert len(rows) == len(AWKWARD) and found.filter("actions = 1 AND score = 1").count() == len(AWKWARD)
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert (nine["n_email"], nine["n_ip"], nine["n_card"], nine["n_phone"]) == (1, 1, 1, 1)
    assert pii.find(spark, none).count() == 0


# -- packing -----------------------------------------------------------------------------------------------------------


def test_pieces_hold_every_id_once(spark, sf, texts):
    encoder = ByteBpe(tokenizer_path("byte_bpe_50k.json"), BYTE_PATTERN)
    rows = QUERIES["op7_packing"](spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.append(np.frombuffer(encoder.encode(texts[i]), "<u4"), np.uint32(1)).astype("<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_packer_keeps_all_three_limits():
    rng = np.random.default_rng(4)
    limits = packing.Limits(tokens=64, segments=4, loss_tokens=20, pool=16)
    packer = packing.Packer(limits)
    sizes = rng.integers(1, 200, 80)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype="<u4"), rng.random(n) < 0.5)
    packer.close()
    by = {}
    for r in packer.rows:
        by.setdefault(r[5], []).append(r)
    for pieces in by.values():
        assert len(pieces) <= 4 and sum(r[7] for r in pieces) <= 20
        total = sum(r[2] for r in pieces)
        assert total <= 64 and total & (total - 1) == 0
    assert sum(r[2] for r in packer.rows) == sizes.sum()


def test_packing_awkward(spark, awkward, none):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(awkward, path, BYTE_PATTERN).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in AWKWARD}
    assert packing.pack_documents(none, path, BYTE_PATTERN).count() == 0
    turns = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "hello there"), ("assistant", None)]), (2, None)], "doc_id long, turns array<struct<role:string,text:string>>")
    got = packing.pack_turns(turns, path, BYTE_PATTERN).collect()
    assert sum(r["length"] for r in got) == 2 + 3 + 1 and sum(r["loss_tokens"] for r in got) == 4


# -- suffixes ----------------------------------------------------------------------------------------------------------


def _repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen.get(t[k : k + 50], i) < i:
                gone[k : k + 50] = True
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
        out[i] = gone
    return out


def test_repeats_equal_brute_force(spark, texts):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abé "), 300)) for _ in range(4)]
    made = {}
    for k in range(150):
        i, j = sorted(rng.integers(0, 300, 2))
        made[1000 + k] = "".join(rng.choice(list("xyz"), rng.integers(0, 70))) + base[k % 4][i:j] + "".join(rng.choice(list("xyz"), rng.integers(0, 70)))
    made |= {2000: "a" * 400, 2001: "a" * 49, 2002: "a" * 50, 2003: "", 2004: "\0" * 90, 2005: "\0" * 60}
    rows = [(i, t) for i, t in (texts | made).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _repeats([(i, t.encode()) for i, t in rows])
    for group_bytes in (1 << 24, 60_000):
        got = {r["doc_id"]: r for r in suffixes.remove_repeats(spark, df, group_bytes=group_bytes).collect()}
        assert set(got) == set(want)
        for i, gone in want.items():
            raw = np.frombuffer((texts | made)[i].encode(), np.uint8)
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(raw), gone.sum(), runs)
            assert got[i]["kept_sha256"] == hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def test_merged_transforms_sort_and_count_prefixes():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.choice(list(b"ab"), rng.integers(5, 40))) for _ in range(30)]
    shards = [suffixes.Shard(np.array([len(s) for s in part]), np.frombuffer(b"".join(part), np.uint8)) for part in (strings[:9], strings[9:17], strings[17:])]
    merged, block = suffixes.merge_transforms([s.bwt for s in shards], 12)
    rotations = []
    for s in shards:
        for p in s.order:
            b, n = s.begin[s.string[p]], s.length[s.string[p]]
            rotations.append([int(s.text[b + (p - b + k) % n]) for k in range(12)])
    ordered = [rotations[i] for i in merged]
    assert ordered == sorted(ordered)
    assert [a != b for a, b in zip(ordered, ordered[1:])] == [a != b for a, b in zip(block.tolist(), block.tolist()[1:])]


def _group(texts):
    return suffixes.Group([suffixes.pack_group(list(range(len(texts))), texts, [None] * len(texts))])


def test_only_windows_with_shared_anchors_get_seeds(monkeypatch):
    rng = np.random.default_rng(21)
    noise = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (40_000, 60_000, 300_000)]
    passage = bytes(rng.integers(0, 256, 200, dtype=np.uint8))
    group = _group([noise[0] + passage, noise[1] + passage + noise[2], b"", b"x" * 49])
    value, twice = suffixes.anchors_of(group)
    hashed, hashes = {False: [], True: []}, suffixes.window_hashes

    def counted(x, seeds=True):
        hashed[seeds].append(len(x))
        return hashes(x, seeds)

    monkeypatch.setattr(suffixes, "window_hashes", counted)
    snippets = suffixes.Snippets(group, np.sort(suffixes._place(value[twice], 8)), 8, 2)
    monkeypatch.undo()
    # the passage's windows, and on either side the few that overlap it and have one of its anchors
    at = {start + k for start, count in zip(snippets.start.tolist(), snippets.count.tolist()) for k in range(count)}
    want = [i for a in (40_000, 100_200) for i in range(a, a + 151)]
    assert at >= set(want) and all(any(a - 18 <= i <= a + 168 for a in (40_000, 100_200)) for i in at)
    # once over the whole group for anchors, and seeds only where anchors are shared
    assert sum(hashed[False]) <= 1.01 * len(group.x) and sum(hashed[True]) <= 2 * (200 + 2 * 18)


def test_anchor_runs_equal_brute_force():
    rng = np.random.default_rng(22)
    texts = [rng.choice(np.frombuffer(b"abcd", np.uint8), int(n)).tobytes() for n in [0, 49, 50, 51, *rng.integers(0, 400, 60), 140_000, 0, 131_121, 70_000, 65_000, 49]] + [b"a" * 20_000, b""]
    group = _group(texts)
    group.known[5] = False
    got = [(int(b), int(n), int(d), int(a)) for part in group.runs() for b, n, d, a in zip(*part)]
    anchors = {}
    for b, n, d, a in got:
        for i in range(b, b + n):
            assert i not in anchors
            anchors[i] = (d, a)
    want = {}
    for d, (at, size) in enumerate(zip(group.at.tolist(), group.sizes.tolist())):
        if size >= 50 and group.known[d]:
            for k, a in enumerate(suffixes._hashes(group.x[at : at + size], False)[0].tolist()):
                want[at + k] = (d, a)
    assert anchors == want
    # maximal, save at the ends of the parts a long document is taken in
    joined = sum(b0 + n0 == b1 and (d0, a0) == (d1, a1) for (b0, n0, d0, a0), (b1, _, d1, a1) in zip(got, got[1:]))
    assert joined <= 1


def test_repeats_awkward(spark, awkward, none):
    rows = suffixes.remove_repeats(spark, awkward.select("doc_id", "text")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(AWKWARD) and got[6]["n_removed"] == got[6]["n_bytes"] == len(LONG) and got[5]["n_removed"] == 0
    assert {r["n_removed"] for r in rows if r["doc_id"] in (None, 1)} == {0}
    assert suffixes.remove_repeats(spark, none).count() == 0


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    hit = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    assert hit and all(0 <= r["score"] <= 1 for r in rows)


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(6)
    y = rng.random(3000) < 0.3
    votes = np.zeros((3000, 4), int)
    for k, (say, right) in enumerate(((0.8, 0.95), (0.8, 0.9), (0.6, 0.85), (0.7, 0.5))):
        on = rng.random(3000) < say
        good = rng.random(3000) < right
        votes[on, k] = np.where(good[on] == y[on], 1, -1)
    q, rates, _ = toxicity.label_model(votes, 0.3)
    assert ((q > 0.5) == y).mean() > 0.93
    assert rates[0, 1, 2] - rates[0, 0, 2] > 0.5 > abs(rates[3, 1, 2] - rates[3, 0, 2])


def test_toxicity_awkward(spark, awkward, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(spark, awkward, labels)
    assert toxicity.flag(spark, awkward, model).columns == [*(c for c in awkward.columns if c != "score"), "score"]
    rows = toxicity.flag(spark, awkward, model).select("doc_id", "score").collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(spark, none, toxicity.learn(spark, none, labels.limit(0))).count() == 0


# -- embeddings --------------------------------------------------------------------------------------------------------


def _brute_links(rows):
    ok = [r for r in rows if r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    return links


def test_embeddings_equal_brute_force(spark, sf):
    rng = np.random.default_rng(11)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, sf, "embeddings").collect()]
    centre = rng.normal(size=(6, 16))
    for k in range(300):
        rows.append((10_000 + k, [float(v) for v in centre[k % 6] + rng.normal(size=16) * rng.choice([0.05, 0.3])], 77))
    rows += [(20_000 + k, [1.0, 2.0, 3.0], 5) for k in range(40)]
    rows += [(30_000, None, 5), (30_001, [0.0, 0.0, 0.0], 5), (30_002, [1.0, None, 3.0], 5), (30_003, [1.0, float("nan"), 3.0], 5), (30_004, [1.0, 2.0, 3.0], None), (30_005, [2.0, 4.0, 6.0], 5), (30_006, [], 5), (30_007, [float("inf"), 1.0, 1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("x")).withColumn("e", F.lit(1))
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(spark, df, shard=120).collect()}
    links = _brute_links(rows)
    assert set(got) == set(links)
    true, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert 0.99 * true <= found <= true
    for i in (30_000, 30_001, 30_002, 30_003, 30_004, 30_006, 30_007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[30_005]["n_links"] == 40 and got[30_005]["component_id"] == 20_000 and got[20_000]["kept"]


def test_embeddings_empty(spark):
    assert hnsw.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_audit_finds_rare_links_that_a_graph_misses():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 48))
    x[6] = x[5] + 0.01 * rng.normal(size=48)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    for near in graph.near:  # no path leads to node 6
        near[near == 6] = -1
    graph.start = graph.start if graph.start != 6 else 0
    found = set(zip(*(side.tolist() for side in hnsw.links_between(graph, x, 0.93))))
    assert {(5, 6), (6, 5)} <= found


def test_links_found_from_one_end_count_at_both():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 32))
    y = x + 0.01 * rng.normal(size=x.shape)
    one, two = (hnsw.Graph(v / np.linalg.norm(v, axis=1, keepdims=True)) for v in (x, y))

    def find(graph, q, least, own=False):
        """A search that finds nothing in the first graph."""
        left, right = hnsw.links_between(graph, q, least, own=own)
        return (left, right) if graph is two else (left[:0], right[:0])

    left, right = hnsw.linked_pairs(one, two, 0.93, find)
    assert {(i, i) for i in range(200)} <= set(zip(left.tolist(), right.tolist()))
    left, right = hnsw.linked_pairs(two, one, 0.93, find)
    assert {(i, i) for i in range(200)} <= set(zip(left.tolist(), right.tolist()))
    left, right = hnsw.linked_pairs(two, None, 0.93, find)
    assert (left < right).all()


def test_graph_links_survive_bytes():
    x = np.random.default_rng(3).normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for part in (x, x[:1], x[:0]):
        graph = hnsw.Graph(part)
        again = hnsw.Graph.of(part, graph.links_of())
        assert (again.start, again.top) == (graph.start, graph.top) and all((a == b).all() for a, b in zip(again.near, graph.near))
        if len(part):
            assert all((a == b).all() for a, b in zip(graph.search(x[:50], 20), again.search(x[:50], 20)))
