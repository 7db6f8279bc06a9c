"""The manifest, the SentencePiece encoder and the filter audit against brute force."""

import hashlib
import zlib
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordersight import session
from ordersight.llm import decontamination, filter_audit, jaccard, language_model, manifest, pieces
from ordersight.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None, "x", "en", 1), (2, "", None, None, 2), (3, "   \n ", "y", "en", 3), (4, "a b c", "x", "", 4), (4, "a b c", "x", "", 4),
    (None, "a b c d E", None, "fr", 5), (6, "word " * 3000, "y", "en", None), (7, "é ü 1 . \x00 x", "y", None, 7),
    (8, "A▁b  ▁ c ", "z", "de", 0), (9, "日本語 " * 40 + "😀\t\n", "z", "de", 0), (10, "", "z", "de", 0), (11, "x" * 5000, "x", "de", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    frame = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string, n_chars long")
    clash = {c: F.lit("mine") for c in ("ids", "hash", "g", "idx", "block", "id", "part", "digest", "failed", "leaf")}
    return frame.withColumns(clash)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan_out):
    """Root of a list of digests and each node's proof as pairs of strings."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % fan_out
            proofs[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fan_out])))
        nodes = [H(*nodes[i : i + fan_out]) for i in range(0, len(nodes), fan_out)]
        at = [i // fan_out for i in at]
    return nodes[0], proofs


def manifest_of(rows, fan_out):
    """``(doc_id, leaf, subroot, root, proof)`` of rows of ``ODD``'s layout."""
    groups = {}
    for doc_id, text, source, lang, n_chars in rows:
        groups.setdefault("" if lang is None else "=" + lang, []).append((doc_id, leaf_of((doc_id, source, lang, n_chars, text))))
    roots, inside = [], []
    for name in sorted(groups):
        own = sorted(groups[name], key=lambda row: (row[0] is not None, row[0] or 0, row[1]))
        top, proofs = climb([leaf for _, leaf in own], fan_out)
        roots.append(top)
        inside.append([(*row, proof) for row, proof in zip(own, proofs, strict=True)])
    root, upper = climb(roots, fan_out)
    return [
        (doc_id, leaf, sub, root, proof + above)
        for sub, rows_, above in zip(roots, inside, upper, strict=True)
        for doc_id, leaf, proof in rows_
    ]


def built(frame, fan_out):
    leaf = manifest.leaf("doc_id", "source", "lang", "n_chars", "text")
    rows = manifest.build(frame.withColumn("mark", leaf), leaf="mark", fan_out=fan_out).collect()
    return [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(step) for step in r.proof]) for r in rows]


@pytest.mark.parametrize("fan_out", [2, 8])
def test_manifest_equals_brute_force(spark, odd, fan_out):
    key = lambda row: (str(row[0]), *row[1:])
    many = [(i, f"text {i % 7}", "s", "en" if i < 20 else f"l{i}", i) for i in range(30)]
    for rows, frame in ((ODD, odd), (many, spark.createDataFrame(many, "doc_id long, text string, source string, lang string, n_chars long"))):
        assert sorted(built(frame, fan_out), key=key) == sorted(manifest_of(rows, fan_out), key=key)


def test_manifest_edges(spark, odd):
    assert manifest.build(odd.filter("false").withColumn("leaf", F.lit("x"))).count() == 0
    lone = built(odd.filter("doc_id = 1"), 8)
    assert lone[0][1] == lone[0][2] == lone[0][3] and lone[0][4] == []
    only = built(odd.filter("lang = 'de'"), 8)
    assert {row[2] == row[3] for row in only} == {True}


def test_manifest_query_finds_tampering(spark, small):
    rows = QUERIES["op11_merkle_manifest"](spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    given = [(r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in docs.values()]
    expected = {row[0]: row for row in manifest_of(given, 8)}
    assert len(rows) == len(docs)
    for row in rows:
        _, leaf, sub, root, proof = expected[row.doc_id]
        assert (row.leaf, row.subroot, row.root) == (leaf, sub, root)
        assert row.proof_sha256 == H(*(part for step in proof for part in step))
        doc = docs[row.doc_id]
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in doc.text or "")
        changed = crc32(str(row.doc_id).encode()) % 3 == 0 and lower != (doc.text or "")
        assert row.verified != changed and (row.folded_root == root) == row.verified


def test_pieces_equal_the_library(odd):
    model = pieces.processor(MODEL)
    rows = pieces.encode(odd, MODEL, keep=("doc_id", "ids", "block")).collect()
    expected = Counter((r[0], tuple(model.encode(r[1] or ""))) for r in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == expected
    assert {r.block for r in rows} == {"mine"}
    assert pieces.encode(odd.filter("false"), MODEL).count() == 0


def test_pieces_in_small_blocks(odd, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 4)
    model, block, texts = pieces.processor(MODEL), None, [r[1] for r in ODD]
    for text in texts:
        assert [i for ids in pieces.segment(MODEL, pieces.chunks(text or "")) for i in ids] == model.encode(text or "")
    assert "".join(pieces.chunks("a  b ")) == "▁a▁▁b▁"


def test_pieces_query(spark, small):
    model = pieces.processor(MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op12_sentencepiece"](spark, small).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = model.encode(texts[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), H(",".join(map(str, ids))))
        assert row.decoded_sha256 == H(model.decode(ids))


def test_pieces_refuse_other_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    pieces.check_model(MODEL)
    for change in ("remove", "across"):
        other = sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(model)
        if change == "remove":
            other.normalizer_spec.remove_extra_whitespaces = True
        else:
            other.pieces[5000].piece = "a▁b"
        path = tmp_path / f"{change}.model"
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            pieces.check_model(str(path))


def audit_of(docs, labels):
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, mark in labels if i is not None and mark == 1}
    failed = []
    for doc_id, text, source in docs:
        text = text or ""
        own = text.encode().split()
        fails = {
            "A": len(own) < 50,
            "B": 100 * len(set(own)) < 65 * len(own),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs),
        }
        failed.append((source or "", {x for x, yes in fails.items() if yes}, doc_id in good, doc_id in toxic))
    out, total = {}, Counter()
    for part in {row[0] for row in failed}:
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                own, before = [row for row in failed if row[0] == part], set(order[: step - 1])
                here = [r for r in own if x in r[1] and not r[1] & before]
                total[part, x] += len(here)
                out[part, order, step] = [
                    sum(not r[1] & (before | {x}) for r in own), len(here), sum(x in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {x} for r in own), sum(r[2] for r in here), sum(r[3] for r in here),
                ]
    return {key: tuple([*row, total[key[0], key[1][key[2] - 1]]]) for key, row in out.items()}


LABELS = [(1, 1, 0), (3, None, 1), (4, 0, None), (4, 1, 1), (6, 1, 1), (None, 1, 1), (11, 0, 1), (99, 1, 1)]


def test_audit_equals_brute_force(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(odd, labels).collect()
    expected = audit_of([(r[0], r[1], r[2]) for r in ODD], LABELS)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows} == expected and len(rows) == len(expected)
    assert filter_audit.audit(odd.filter("false"), labels).count() == 0
    assert filter_audit.audit(odd, labels.filter("false")).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 1001])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def test_jaccard_rounds_with_more_leaders(spark, monkeypatch):
    """All rounds, from one leader to all partners, end in the components of brute force."""
    monkeypatch.setattr(jaccard, "FEW_PARTNERS", 0)
    monkeypatch.setattr(jaccard, "MORE_LEADERS", 8)
    rng = np.random.default_rng(3)
    base, docs = [f"w{x}" for x in rng.integers(0, 400, 60)], []
    for i in range(60):
        own = list(base)
        for at in rng.integers(0, 60, 2):
            own[at] = f"n{rng.integers(0, 99)}"
        docs.append((i, " ".join(own)))
    sets = [{tuple(text.split()[k : k + 5]) for k in range(56)} for _, text in docs]
    comp = list(range(60))
    for _ in docs:
        for a in range(60):
            for b in range(60):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = jaccard.near_duplicates(frame, width=5, percent=80).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(comp))


def test_keep_first_judges_rows_not_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (5, a + " more"), (5, b), (6, b), (6, b), (7, ""), (7, None), (None, a), (8, "c d"), (8, "e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.withColumns({c: F.lit(1) for c in ("_id", "id", "node", "key", "own", "_key")})
    kept = jaccard.keep_first(frame)
    assert kept.columns == frame.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == Counter([(3, a), (5, b), (7, ""), (7, None), (None, a), (8, "c d"), (8, "e f")])


def near_copies(n: int, words: int) -> list[tuple[int, str]]:
    base = [f"w{x}" for x in range(words)]
    return [(i, " ".join([*base[: 3 * i + 1], f"n{i}", *base[3 * i + 2 :]])) for i in range(n)]


def counted_checks(monkeypatch) -> list[int]:
    """How many pairs each call of ``check`` is given from now on."""
    given, check = [], jaccard._Join.check

    def counting(self, pairs):
        given.append(pairs.count())
        return check(self, pairs)

    monkeypatch.setattr(jaccard._Join, "check", counting)
    return given


def test_jaccard_compares_a_group_with_its_leaders_first(spark, monkeypatch):
    """Copies that all link are not compared with one another: their pairs grow with the square of the group."""
    given, n = counted_checks(monkeypatch), 60
    found = jaccard.near_duplicates(spark.createDataFrame(near_copies(n, 200), "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}
    assert sum(given) < n * (n - 1) / 4


def test_jaccard_ends_where_no_partner_is_possible(spark, monkeypatch):
    """A large group that shares a passage and links with nothing takes no rounds with more and more leaders."""
    monkeypatch.setattr(jaccard, "RARE", 1000)
    given, passage = counted_checks(monkeypatch), " ".join(f"p{i}" for i in range(40))
    docs = [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(40))) for i in range(120)]
    found = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in found)
    assert len(given) <= 2


def test_jaccard_meets_a_pair_at_few_keys(spark):
    """Of keys with the same members one is kept, and a pair is met once a run of shared keys, not at each of them."""
    frame = spark.createDataFrame(near_copies(40, 300), "doc_id long, text string")
    postings = jaccard._Join(frame, "doc_id", "text", 4, 85).postings()
    members = postings.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("own"))
    assert members.count() == members.select("own").distinct().count()
    other = postings.select(*[F.col(c).alias(f"_{c}") for c in ("key", "before", "node")])
    met = postings.join(other, (F.col("key") == F.col("_key")) & (F.col("node") < F.col("_node")))
    first = met.filter(jaccard._Join.first_met())
    assert first.count() < met.count() / 2
    assert first.select("node", "_node").distinct().count() == met.select("node", "_node").distinct().count()


def test_jaccard_meets_a_pair_again_only_after_many_keys(spark):
    """Copies with changes all over share many runs of keys; they were met at each of those."""
    rng, base, docs = np.random.default_rng(7), [f"w{x}" for x in range(600)], []
    for i in range(24):
        own = list(base)
        for at in rng.choice(600, 12, replace=False):
            own[at] = f"n{i}x{at}"
        docs.append((i, " ".join(own)))
    postings = jaccard._Join(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 4, 85).postings()
    other = postings.select(*[F.col(c).alias(f"_{c}") for c in ("key", "before", "node")])
    met = postings.join(other, (F.col("key") == F.col("_key")) & (F.col("node") < F.col("_node")))
    pairs, first = met.select("node", "_node").distinct().count(), met.filter(jaccard._Join.first_met())
    assert first.select("node", "_node").distinct().count() == pairs
    assert first.count() < 1.5 * pairs


def test_jaccard_indexes_the_rarest_tokens():
    """Tokens that many sets share came first if their hash was small, and joined sets that cannot link."""
    own = np.arange(100, dtype=np.uint64)
    level = jaccard.levels_of(np.where(own < 90, 50, 1))
    assert set(jaccard.index_keys(own, level, 85).tolist()) == {*range(90, 100), *range(6)}


def test_jaccard_adds_sketches_in_the_same_workers(spark, monkeypatch):
    """An RDD of the sketches kept a second pool of Python workers in every executor."""
    frame = spark.createDataFrame([(text,) for _, text in near_copies(40, 300)], "text string").repartition(20)
    parts = [np.frombuffer(zlib.decompress(r[0]), np.uint32) for r in frame.mapInArrow(jaccard._sketch(4), "sketch binary").collect()]
    monkeypatch.setattr(type(frame), "rdd", property(lambda self: pytest.fail("an RDD")))
    levels = np.frombuffer(zlib.decompress(jaccard.bucket_levels(frame, 4)), np.uint8)
    assert len(parts) > jaccard.ADDED and (levels == jaccard.levels_of(np.sum(parts, 0, dtype=np.uint32))).all()
    assert not any(zlib.decompress(jaccard.bucket_levels(frame.filter("false"), 4)))


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Batches of ten thousand long texts outgrew the memory of an executor; the session's own setting comes back."""
    before = spark.conf.get(session.ARROW_ROWS)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    with session.text_batches(spark):
        assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) <= session.TEXT_ROWS
    during = []

    def recording(df):
        during.append(int(spark.conf.get(session.ARROW_ROWS)))
        return session.cut(df)

    monkeypatch.setattr(decontamination, "cut", recording)
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item), (2, "other words"), (3, None)], "doc_id long, text string")
    kept = decontamination.drop_contaminated(docs, spark.createDataFrame([("a", item)], "item_id string, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert during == [session.TEXT_ROWS] and spark.conf.get(session.ARROW_ROWS) == before


def test_expected_counts_are_of_whole_texts():
    """One start a text, however long, and the counts and likelihood of a sum over all paths of states."""
    random = np.random.default_rng(7)
    model = language_model._estimate(random.random(2) * 9, random.random((2, 2)) * 9, random.random((3, 2)) * 9)
    short = [np.array([2, 0, 1, 1, 0], np.uint16), np.array([1, 2], np.uint16)]
    starts, moves, emitted, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for row in short:
        paths = list(np.ndindex(*[2] * len(row)))
        p = np.array([
            model.start[z[0]] * np.prod([model.emit[w, s] for w, s in zip(row, z, strict=True)]) * np.prod([model.move[a, b] for a, b in zip(z, z[1:], strict=False)])
            for z in paths
        ])
        total += np.log(p.sum())
        for z, share in zip(paths, p / p.sum(), strict=True):
            starts[z[0]] += share
            np.add.at(moves, (z[:-1], z[1:]), share)
            np.add.at(emitted, (row, z), share)
    for got, want in zip(language_model.expected(model, short), (starts, moves, emitted, total), strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-5)
    long = random.integers(0, 3, 3000).astype(np.uint16)
    starts, moves, emitted, total = language_model.expected(model, [short[1], long])
    np.testing.assert_allclose([starts.sum(), moves.sum(), emitted.sum()], [2, 3000, 3002], rtol=1e-5)
    np.testing.assert_allclose(total, language_model.log_likelihood(model, [short[1], long]).sum(), rtol=1e-5)


def test_language_model_is_fitted_to_all_texts_until_it_gains_no_more(spark):
    """Texts of two kinds of words, most of them longer than 16,000 words: the fit takes passes over all of them."""
    random, kinds = np.random.default_rng(8), 2
    texts = []
    for i in range(24):
        stays = random.random(17_000 if i % 8 else 200) < 0.9
        kind = (np.cumsum(~stays) + i) % kinds
        texts.append(bytearray((1 + kind * 20 + random.integers(0, 20, len(kind))).astype(np.uint16).tobytes() + b"\0\0"))
    words = np.arange(1, 41)
    counts = sum(np.bincount(np.frombuffer(t, np.uint16), minlength=41) for t in texts)
    shapes = np.zeros(language_model.SHAPES), np.ones(language_model.SHAPES)
    v = language_model.Vocabulary(words.astype(np.uint64), words, counts[1:], *shapes, 24, int(counts.sum()), 41)
    encoded = session.cut(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_id long, symbols binary").repartition(3))
    model = language_model.train(encoded, v, states=2)
    rows = [np.frombuffer(bytes(t), np.uint16) for t in texts]
    *counts, before = language_model.expected(model, rows)
    after = language_model.expected(language_model._estimate(*counts), rows)[3]
    assert after[0] - before[0] < language_model.TOLERANCE * abs(before[0])
    np.testing.assert_allclose(model.move, [[0.9, 0.1], [0.1, 0.9]], atol=0.02)
