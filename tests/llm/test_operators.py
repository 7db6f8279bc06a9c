"""Small cases with known or brute-forced results, and the edge cases that every operator states."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordersight.llm import (
    decontamination,
    jaccard,
    language_id,
    language_model,
    licenses,
    mixing,
    quality_model,
    rules,
    toxicity,
    urls,
)
from ordersight.llm.queries import QUERIES

ODD = [
    (1, None, "x", 1), (2, "", None, 2), (3, "   \n ", "y", 3), (4, "a b c", "x", 4), (4, "a b c", "x", 4),
    (None, "a b c d e", None, 5), (6, "word " * 3000, "y", None), (7, "é ü 1 . \x00 x", "y", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    frame = spark.createDataFrame(ODD, "doc_id long, text string, source string, n_chars long")
    return frame.withColumns({"n_words": F.lit("mine"), "score": F.lit(0), "id": F.lit(9)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def words(text):
    return (text or "").encode().split()


def test_rules_counts(odd, empty):
    rows = rules.judge(odd).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        own = words(row["text"])
        grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        seen = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        assert (row["n_words"], row["n_repeat_words"]) == (len(own), len(covered))
        assert row["base_failed"] and not row["kept"]
    assert rules.judge(empty).count() == 0
    assert rules.keep_good(odd).columns == odd.columns


def test_decontamination(spark, odd, empty):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "w1 w2 w3"), (3, "Tiny, ITEM"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "tiny item"), (9, None), (None, "w2 w3")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.scan(docs, bench).collect()}
    assert [found[i]["n_hit"] for i in (1, 2, 3, 4)] == [20, 2, 2, 0]
    assert [found[i]["items"] for i in (1, 2, 3)] == [["", "7"], [""], ["8"]]
    assert [found[i]["contaminated"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert decontamination.scan(odd, bench).count() == len(ODD)
    assert decontamination.scan(empty, bench).count() == 0
    assert decontamination.scan(docs, bench.filter("false")).agg(F.sum("n_hit")).first()[0] == 0


def brute_components(docs, width, percent):
    sets = {}
    for i, text in docs:
        own = text.lower().encode().split() if text else []
        sets[i] = {tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))} if own else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard(spark, odd, empty, monkeypatch):
    random = np.random.default_rng(1)
    base = [[f"w{x}" for x in random.integers(0, 400, 60)] for _ in range(6)]
    docs = []
    for i in range(120):
        own = list(base[i % 6])
        for _ in range(int(random.integers(0, 5))):
            own[int(random.integers(0, 60))] = f"n{random.integers(0, 9)}"
        docs.append((i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for rare in (64, 1):  # with 1 most tokens are frequent and go through combinations
        monkeypatch.setattr(jaccard, "RARE", rare)
        for width, percent in ((4, 85), (5, 80)):
            found = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(frame, width=width, percent=percent).collect()}
            assert found == brute_components(docs, width, percent)
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] == 4} == {4}
    assert jaccard.near_duplicates(empty).count() == 0
    assert jaccard.keep_first(odd).columns == odd.columns
    assert jaccard.keep_first(odd).filter("doc_id = 4").count() == 1


def test_mixing(spark, odd, empty):
    random = np.random.default_rng(2)
    rows = [(i, "w " * int(random.integers(0, 90)), "abcd"[min(3, i % 9)]) for i in range(900)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (mixed["taken"] <= 3 * mixed["size"]).all() and len(mixed) == 900
    for _, own in mixed.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 1
        assert own["source_size"].iloc[0] == own["size"].sum()
    assert math.isclose(mixed.drop_duplicates("source")["target"].sum(), mixed["size"].sum())
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0


def test_fit_is_exact_where_possible():
    random = np.random.default_rng(3)
    for _ in range(50):
        lengths = np.unique(random.integers(1, 60, 8))
        counts = random.integers(1, 5, len(lengths))
        budget = int(random.integers(0, (lengths * counts).sum() + 1))
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        took = mixing.fit(lengths, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        assert abs(int((took * lengths).sum()) - budget) <= lengths.max()


def test_urls(spark):
    pages = [(1, "http://A.example.NET/en/x?q"), (2, "https://net"), (3, "http://b.example.com/de/1"), (4, None), (5, "x"),
             (6, "http://x.org/fr/#a"), (7, "http://www.bad.io/p/"), (7, "http://www.bad.io/p/")]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("mine"))
    listed = spark.createDataFrame([("https://bad.io/p?x",), (None,)], "url string")
    rows = [tuple(r) for r in urls.judge(frame, urls.rules_table(spark), listed).orderBy("page_id").select("page_id", "host", "path", "rule", "verdict").collect()]
    assert rows == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "net", "", None, "allow"),
        (3, "b.example.com", "/de/1", "example.com/de/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "x.org", "/fr/", "org/fr/", "allow"), (7, "www.bad.io", "/p/", None, "block"), (7, "www.bad.io", "/p/", None, "block"),
    ]
    assert urls.judge(frame.filter("false"), urls.rules_table(spark), listed.filter("false")).count() == 0


def accuracy(spark, name, folder, label, column):
    rows = QUERIES[name](spark, folder).filter("held_out")
    named = spark.read.parquet(f"{folder}/{label}.parquet").select("doc_id", F.col(column).alias("truth"))
    return rows.join(named.filter("truth is not null"), "doc_id")


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    toxic = accuracy(spark, "op1_toxicity", folder, "labels", "toxic").select((F.col("predicted") == F.col("truth")).cast("int").alias("ok"))
    assert toxic.agg(F.avg("ok")).first()[0] > 0.92  # many marks of this table also occur inside ordinary words
    good = accuracy(spark, "op6_quality_classifier", folder, "labels", "quality").select((F.col("predicted") == F.col("truth")).cast("int").alias("ok"))
    assert good.agg(F.avg("ok")).first()[0] > 0.97
    lang = accuracy(spark, "op7_language_id", folder, "documents", "lang").select((F.col("lang_pred") == F.col("truth")).cast("int").alias("ok"))
    assert lang.agg(F.avg("ok")).first()[0] > 0.97


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for docs in (odd, empty):
        n = docs.count()
        model = toxicity.train(docs, labels)
        assert docs.select(toxicity.score(model, F.col("text"))).count() == n
        vectors = quality_model.with_statistics(docs)
        model = quality_model.train(vectors, labels)
        assert vectors.select(quality_model.score(model, F.col("_vector"))).filter("1=1").count() == n
        model = language_id.train(docs, lang="source")
        found = docs.select("doc_id", language_id.language(model, F.col("text")).alias("f")).collect()
        assert all(r["f"]["lang"] == "und" for r in found if r["doc_id"] in (1, 2, 3)) and len(found) == n


def test_forward_backward_equals_enumeration():
    random = np.random.default_rng(4)
    scores, moves = random.normal(size=(4, 1, 3)), random.normal(size=(3, 3))
    total, marginal = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        weight = math.exp(sum(scores[t, 0, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += weight
        for t, y in enumerate(path):
            marginal[t, y] += weight
    found, _ = language_id.forward_backward(scores, np.array([4]), moves)
    assert np.allclose(found[:, 0], marginal / total)


def test_language_model(spark, odd, empty, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op10_language_model"](spark, small).collect()}
    counts = Counter()
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update([*r["text"].encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in docs:
        own = [*r["text"].encode().lower().split(), None]
        row = rows[r["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(row["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    assert sum(r["score"] for r in rows.values()) > sum(r["base_score"] for r in rows.values())
    assert language_model.score(odd.withColumn("_learn", F.lit(True)), "_learn").count() == len(ODD)
    assert language_model.score(odd.withColumn("_learn", F.lit(None).cast("boolean")), "_learn").count() == len(ODD)
    assert language_model.score(empty.withColumn("_learn", F.lit(True)), "_learn").count() == 0


def test_likelihood_equals_enumeration():
    random = np.random.default_rng(5)
    model = language_model._estimate(random.random(2), random.random((2, 2)), random.random((3, 2)))
    row = np.array([2, 0, 1, 1, 0], np.uint16)
    total = 0.0
    for path in np.ndindex(*[2] * 5):
        p = model.start[path[0]]
        for t, z in enumerate(path):
            p *= model.emit[row[t], z] * (model.move[path[t - 1], z] if t else 1.0)
        total += p
    assert np.allclose(language_model.log_likelihood(model, [row, row[:1]])[0], math.log(total))


def test_licenses(odd, empty):
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert licenses.align([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    text = odd.limit(1).select(F.lit("x Released under, the MIT License. y Released under the MIT License").alias("t"))
    found = text.select(licenses.find(F.col("t")).alias("f")).first()["f"]
    assert [(r["license"], r["start"], r["end"]) for r in found] == [("MIT-line", 1, 6), ("MIT-line", 7, 12)]
    assert odd.select(F.size(licenses.find(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 0
    assert empty.select(licenses.find(F.col("text"))).count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard", "decontamination", "mix_sources"]
    rows = corpus_pipeline.run(spark, small).toPandas()
    assert 0 < len(rows) < docs.count() and rows["doc_id"].is_unique


def test_toxicity_weighs_runs_that_ordinary_texts_also_hold(spark):
    random = np.random.default_rng(6)
    parts = ["ander", "oning", "ereth", "stion", "ateal", "inghe"]
    docs = []
    for i in range(1200):  # marked words are every tenth word of toxic texts, and now and then one of an ordinary text
        own = ["".join(random.choice(parts, 2)) for _ in range(120)]
        toxic = i % 4 == 0
        for k in np.flatnonzero(random.random(120) < (0.1 if toxic else 0.008)):
            own[k] = "achli" + random.choice(parts)
        own += [] if toxic else ["xcalmx"] * int(random.integers(1, 4))
        docs.append((i, " ".join(own), int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.filter("doc_id % 3 > 0"), frame.select("doc_id", "toxic"))
    assert b"achli" in model.toxic and b"xcalm" in model.ordinary
    rows = frame.filter("doc_id % 3 = 0").withColumn("score", toxicity.score(model, F.col("text"))).collect()
    assert sum((r["score"] >= 0.3) == bool(r["toxic"]) for r in rows) > 0.97 * len(rows)


def test_toxicity_warns_of_a_dictionary_it_cannot_train():
    texts = [[b"alpha", b"beta"]]
    own = toxicity._frequencies(texts)
    with pytest.warns(UserWarning, match="dictionary"):
        assert b"alpha" in toxicity.train_dictionary(texts, own, own, 4.0)


def test_fit_is_the_closest_sum_of_long_documents():
    cases = [([20000, 60000], [1, 1], 25000), ([9000, 30000, 90000], [2, 1, 1], 17000), ([30000, 50000], [1, 1], 52000)]
    cases.append(([30000, 50000], [10, 10], 390000))
    random = np.random.default_rng(7)
    for _ in range(20):
        lengths = np.unique(random.integers(5000, 90000, 6))
        counts = random.integers(1, 4, len(lengths))
        cases.append((lengths, counts, int(random.integers(1, (lengths * counts).sum()))))
    for lengths, counts, budget in cases:
        sums = {0}
        for size, n in zip(lengths, counts, strict=True):
            sums = {s + k * int(size) for s in sums for k in range(n + 1)}
        lengths, counts = np.array(lengths), np.array(counts)
        took = mixing.fit(lengths, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        assert abs(int((took * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_licenses_keep_the_best_of_overlapping_stretches(odd):
    line, isc = licenses.TEMPLATES["GPL-3.0-line"], licenses.TEMPLATES["ISC"]
    n, m = len(line.replace(",", "").split()), len(isc.replace("/or", " or").split())
    text = f"The public x is y z {line} general of a {line} " + "the and x y " * 4 + isc
    found = odd.limit(1).select(licenses.find(F.lit(text)).alias("f")).first()["f"]
    own = [(r["license"], r["coverage"], r["start"], r["end"]) for r in found]
    first = 6 + 2 * n + 3 + 16
    assert own == [("GPL-3.0-line", 1.0, 6, 6 + n), ("GPL-3.0-line", 1.0, 9 + n, 9 + 2 * n), ("ISC", 1.0, first, first + m)]
