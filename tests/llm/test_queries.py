"""The numbered queries and the pipeline on a table of odd rows, on an empty table, and against brute force."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import jaccard, mixing, packing, quality, queries
from flowlens.llm.media import padded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, spans string, slot int, cluster long"
COPY = "the same words again and again in one small document that is copied many times over"
PROSE = {"en": "the people of the town went to the market and bought bread with their money in the morning", "fr": "les gens de la ville sont partis au marché et ont acheté du pain avec leur argent le matin"}


def rows():
    out = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t", None, "a", 3), (4, "12345 !!!", "en", "b", 9), (5, "mail bob@example.com or +1 (377) 555-0271 from 10.1.2.3", "en", "b", 10),
        (6, COPY, "en", "a", 5), (7, COPY, "en", "a", 5), (8, COPY.upper(), "en", "b", 5), (6, COPY, "en", "a", 5), (9, "x" * 70_000, "en", "b", 7), (10, "released under the MIT License", "fr", "", 3),
        (11, "long " * 30_000, "en", "b", 1), (12, "é🎉" * 50, "fr", "c", 1), (None, "a row without an id", "en", "a", 1), (13, "two words", "en", "a", 1), (14, "two words", "en", "a", 1),
    ]
    for k in range(15, 75):
        lang = "en" if k % 2 else "fr"
        words = PROSE[lang].split()
        out.append((k, " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] for j in range(10 + k)) + (" idiot scum" if k % 3 == 0 else "") + (" ###" * k if k % 4 == 0 else ""), lang, f"s{k % 4}", k))
    return [(*r, 0.5, 9, "x", 1, 2) for r in out]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 4 != 0), int(k % 3 == 0)) for k in range(15, 75)] + [(15, None, None), (15, 1, 0), (None, 1, 1), (999, 1, 1), (1, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the people of the town"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_table(spark, none, name):
    assert queries.queries()[name](spark, none).collect() == []


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op2_packing", "op11_bestfit", "op13_audit")])
def test_one_row_for_each_row(spark, odd, name):
    got = by_id(queries.queries()[name](spark, odd))
    assert sum(map(len, got.values())) == len(rows()) and len(got[6]) == 2


def test_pii(spark, odd):
    got = by_id(queries.op1_pii(spark, odd))
    r = got[5][0]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1)
    text = "email:5:20,phone:24:41,ip:47:55"
    assert r["spans"] == text and r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[1][0]["spans"] == "" and got[1][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.public_tokenizer_path())
    frame = packing.pack_documents(spark.read.parquet(f"{odd}/documents.parquet"), with_ids=True)
    pieces, sequences = by_id(frame), {}
    texts = {r[0]: r[1] or "" for r in rows()}
    for doc, parts in pieces.items():
        ids = reference.encode(texts[doc], add_special_tokens=False).ids + [packing.END_ID]
        copies = 2 if doc == 6 else 1
        assert sum(p["length"] for p in parts) == len(ids) * copies
        for p in parts:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids"] == own and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_language_and_folds(spark, odd):
    got = by_id(queries.op3_language(spark, odd))
    assert got[1][0]["lang_pred"] == got[2][0]["lang_pred"] == got[4][0]["lang_pred"] == "und" and got[4][0]["score"] == 0
    assert all(r[0]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    right = [r[0]["lang_pred"] == ("en" if k % 2 else "fr") for k, r in got.items() if k and k >= 15]
    assert sum(right) / len(right) > 0.9


def test_toxicity_and_quality(spark, odd):
    toxic, good = by_id(queries.op4_toxicity(spark, odd)), by_id(queries.op5_quality(spark, odd))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for parts in toxic.values() for r in parts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for parts in good.values() for r in parts)
    assert sum(toxic[k][0]["predicted"] == (k % 3 == 0) for k in range(15, 75)) > 55
    texts = {r[0]: r[1] for r in rows()}
    for k in range(15, 75, 3):
        found = {texts[k][s["start"] : s["end"]] for s in toxic[k][0]["spans"]}
        assert found <= {"idiot", "scum"}


def test_quality_scores_do_not_depend_on_the_bound_per_class(spark, tmp_path, monkeypatch):
    """Unbalanced labels (6 to 1) that the statistics tell apart only in part: a cut of the larger class must leave the level of the scores."""
    texts = [(k, " ".join("word" if (k * 31 + j * 17) % 23 else "###" for j in range(5 + (k * 7) % 40))) for k in range(2100)]
    spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(zlib.crc32(b"y%d" % k) % 7 > 0), 0) for k, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mean = {}
    for bound in (6000, 225):
        monkeypatch.setattr(quality, "DOCS_PER_CLASS", bound)
        mean[bound] = queries.op5_quality(spark, str(tmp_path)).agg(F.avg("score")).first()[0]
        kept = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
        assert kept > 1600
    assert abs(mean[6000] - 6 / 7) < 0.05 and abs(mean[225] - mean[6000]) < 0.05


def filled(sizes, epochs=3, weights=(5, 2, 1)):
    """Targets by rounds of sharing, the plain way."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        for s in over or free:
            target[s] = epochs * sizes[s] if over else share[s]
        if not over:
            break
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing(spark, odd):
    got = [r for parts in by_id(mixing.mix(spark.read.parquet(f"{odd}/documents.parquet"))).values() for r in parts]
    sizes = {}
    for _, text, _, source, *_ in rows():
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = filled(sizes)
    for source, total in sizes.items():
        mine = [r for r in got if r["source"] == source]
        assert all(r["source_size"] == total and r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[source]) <= 2 + len(mine)
    again = mixing.mix(spark.read.parquet(f"{odd}/documents.parquet"))
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in again.collect())


def test_water_filling_cases(spark):
    for sizes in ({"a": 1, "b": 100, "c": 100}, {"a": 0, "b": 5}, {None: 10}, {"a": 1, "b": 1, "c": 1, "d": 1000, None: 1000}, {"a": 0}):
        frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.water_fill(mixing.cyclic_weights(frame)).collect()}
        assert got == pytest.approx(filled(sizes))


def test_media(spark, odd):
    got = by_id(queries.op7_media(spark, odd))
    for doc, text, *_ in rows():
        payload = padded((text or "").encode())
        r = got[doc][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[6][0]["media_sha256"] == got[7][0]["media_sha256"] != got[8][0]["media_sha256"]


def test_licenses(spark, odd):
    r = by_id(queries.op8_licenses(spark, odd))
    assert r[10][0].asDict() == {"doc_id": 10, "n_words": 5, "n_base": 1, "first_word": 3, "last_word": 3, "base_labels": "mit", "labels": "mit,mit-notice", "score": 1.0}
    assert r[1][0]["n_words"] == 0 and r[1][0]["first_word"] is None and r[1][0]["labels"] == ""


def test_fingerprint(spark, odd):
    got = by_id(queries.op9_fingerprint(spark, odd))
    order = sorted([((-(1 << 63) if r[0] is None else r[0]), r[1] or "") for r in rows()])
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        mine = got[None if doc < 0 else doc]
        assert any(r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text) for r in mine)
    prints = {r["fingerprint"] for k in (6, 7, 8) for r in got[k]}
    assert len(prints) == 1 and got[6][0]["near_next"] == 1


def components(texts, words, percent):
    """doc -> smallest doc reachable, by comparing all pairs."""
    from tests.llm.test_functions import reference_sets

    ids = list(texts)
    sets = dict(zip(ids, reference_sets([texts[i] for i in ids], words)))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, odd, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)  # so that buckets are dealt into blocks and clusters into parts
    monkeypatch.setattr(jaccard, "CLUSTER_TOKENS", 50)
    base = [f"w{k}" for k in range(60)]
    near = [(100 + k, " ".join(base[:k] + [f"z{k}"] + base[k + 1 :] if k < 60 else base[: k - 30]), "en", "a", 1) for k in range(0, 90, 4)]
    docs = spark.createDataFrame([r[:5] for r in rows()] + near, "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r[0]: r[1] or "" for r in [*rows(), *near] if r[0] is not None}
    want, sizes = components(texts, words, percent)
    got = by_id(jaccard.link_components(docs, words=words, percent=percent))
    assert {k: r[0]["component_id"] for k, r in got.items() if k is not None} == want and {k: r[0]["n_shingles"] for k, r in got.items() if k is not None} == sizes
    assert got[None][0]["component_id"] is None
    kept = sorted(r["doc_id"] or -1 for r in jaccard.one_of_each(docs, words=words, percent=percent).collect())
    assert kept == sorted([-1, *{i for i, c in want.items() if i == c}])


def test_near_copies_of_one_text_are_dealt_out_and_each_pair_meets_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 10)
    dealt, before = [], jaccard._forest_rows
    monkeypatch.setattr(jaccard, "_forest_rows", lambda rows, percent: dealt.append(rows) or before(rows, percent))
    base = [f"w{k}" for k in range(200)]
    texts = {k: " ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(0, 180, 3)}
    got = jaccard.link_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=5, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict.fromkeys(texts, 0)
    held = {}
    for r in dealt[0].select("place", "cls", "side").collect():
        held.setdefault(r["place"], []).append((r["cls"], r["side"]))
    assert max(map(len, held.values())) < 45  # of 60; blocks are dealt by a hash
    met = [frozenset((a, b)) for rows in held.values() for (a, x), (b, y) in itertools.combinations(rows, 2) if len({s for _, s in rows}) < 2 or x != y]
    assert len(met) == len(set(met)) == 60 * 59 // 2


def test_pipeline(spark, odd):
    docs, sizes = spark.read.parquet(f"{odd}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, odd).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
        if name == "personal_data":
            assert not docs.where(F.col("text").contains("bob@example.com")).count() and docs.count() == before.count()
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "near_duplicates":
            assert docs.where(F.col("doc_id").isin(6, 7, 8)).count() <= 1
    packed = corpus_pipeline.pack(spark, docs, odd)
    tokens = packed.agg(F.sum("length")).first()[0]
    assert tokens > 0 and corpus_pipeline.run(spark, odd).agg(F.sum("length")).first()[0] == tokens


def test_pipeline_on_an_empty_table(spark, none):
    assert corpus_pipeline.run(spark, none).count() == 0


def test_mixing_stage_takes_the_planned_words(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").where("doc_id >= 15")
    planned = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"))
    made = corpus_pipeline.mix(spark, docs, odd).groupBy("doc_id").agg(F.sum(mixing.word_count("text")).alias("made"))
    both = planned.join(made, "doc_id", "left").select("taken", F.coalesce("made", F.lit(0)).alias("made")).collect()
    assert all(r["taken"] == r["made"] for r in both)


def test_band_keeps_the_terms_of_its_document_frequencies(spark):
    import numpy as np

    from flowlens.llm import fingerprint

    docs = spark.createDataFrame([(f"every w{k % 3} own{k}",) for k in range(60)] + [(None,)], "text string")
    kept = fingerprint.band(fingerprint.document_frequencies(docs).cache(), least=2, most=0.5)
    name = lambda word: fingerprint.term_pairs([word])
    assert [bool(fingerprint._is_kept(name(w), kept)[0]) for w in ("every", "w0", "w2", "own5")] == [False, True, True, False] and np.unpackbits(kept).sum() == 3


def test_components_with_a_heavy_node(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY_NODE", 5)
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 112)] + [(7, 105), (200, 201)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(40), *range(100, 113)], 0), 200: 200, 201: 200}


def test_link_pairs_are_all_links_between_different_sets(spark, monkeypatch):
    from tests.llm.test_functions import reference_sets

    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    base = [f"w{k}" for k in range(50)]
    texts = {k: " ".join(base[: k % 25] + [f"z{k % 25}"] + base[k % 25 + 1 :]) for k in range(30)} | {40: "", 41: "a b", 42: "a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = dict(zip(texts, reference_sets(list(texts.values()), 3)))
    first = {k: min(j for j in texts if sets[j] == sets[k]) for k in texts if sets[k]}
    want = {}
    for a in set(first.values()):
        for b in set(first.values()):
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= 80 * len(sets[a] | sets[b]):
                want[a, b] = (len(sets[a]), len(sets[b]), shared)
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"], r["shared"]) for r in jaccard.link_pairs(docs, percent=80).collect()}
    assert got == want and len(want) > 50
    assert {r["doc_id"]: (r["class_id"], r["copies"]) for r in jaccard.class_members(docs).collect()} == {k: (c, sum(x == c for x in first.values())) for k, c in first.items()}
