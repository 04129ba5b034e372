"""Toxicity and fingerprints against plain Python, text by text; ties and texts beyond a block through the queries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import fingerprint, queries, toxicity
from flowlens.llm.blocks import BLOCK_CHARS, mix

SYLLABLES = "ba ko mi ru te sa lo ni fe da".split()


def drawn(seed, n=120):
    """(doc_id, text, y): toxic documents hold an insult or a word built from a stem, in either case."""
    draw = random.Random(seed)
    words = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 4))) for _ in range(150)]
    out = []
    for k in range(n):
        text = [draw.choice(words) for _ in range(draw.randrange(5, 60))]
        if k % 3 == 0:
            text.insert(draw.randrange(len(text)), draw.choice(["Grobian", "grobians", "GROBIANESS", "zwerk"]))
        out.append((k, " ".join(text) + draw.choice([".", "!", ""]), int(k % 3 == 0)))
    return out


def unit(word, n):
    """The hash of a word (n = 0), or of its prefix of n letters, taken from a text that holds nothing else."""
    return int(toxicity.token_features(next(toxicity.blocks([word])))[1][0][0 if not n else 1 + toxicity.PREFIXES.index(n)])


def test_seeds_are_those_of_a_plain_count(spark):
    rows = drawn(1)
    counts = {0: Counter(), 1: Counter()}
    for _, text, y in rows:
        held = set()
        for word in {w.lower() for w in re.findall(r"[^\W_]+", text)}:
            held |= {(word, 0)} | {(word[:n], n) for n in toxicity.PREFIXES if len(word) > n}
        counts[y].update(held)
    size = Counter(y for *_, y in rows)
    share, wanted = size[1] / len(rows), set()
    for stem, n in counts[0].keys() | counts[1].keys():
        a, b = counts[1][stem, n], counts[0][stem, n]
        if a >= 3 and a / size[1] >= 12 * (b + 0.5) / size[0] and a - share * (a + b) >= 5 * math.sqrt((a + b) * share * (1 - share)):
            wanted.add(unit(stem + "x" * bool(n), n))
    got = toxicity._seed_words(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert wanted and set(map(int, got)) == wanted and unit("grobiany", 7) in wanted


def test_windows_are_labelled_by_the_seeds(spark):
    rows = drawn(2)
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    seeds = toxicity._seed_words(sample)
    features, labels, lengths = toxicity._windows(sample, seeds)
    seeds = set(map(int, seeds))
    units = lambda word: {unit(word, 0)} | {unit(word, n) for n in toxicity.PREFIXES if len(word) > n}
    held = [sum(bool(units(w) & seeds) for w in re.findall(r"[^\W_]+", text)) for _, text, y in rows if y]
    assert 20 < sum(map(bool, held)) and set(held) <= {0, 1}  # no document has two, so each window about one has it
    assert labels.sum() == sum(held) and len(lengths) == sum(held) + sum(not y for *_, y in rows)
    assert lengths.max() <= 16 and all(len(f) == lengths.sum() for f in features)


def test_calibration_is_the_optimum():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) < 0.3).astype(float)
    w = toxicity._logistic(x, y)
    wide = np.column_stack([np.ones(200), x])
    balance = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-wide @ w))
    assert np.allclose(wide.T @ (balance * (y - p)), 1e-3 * 200 * w, atol=1e-6)


def test_scores_follow_from_the_marginals_of_each_text(spark):
    rows = drawn(3)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    texts = [text for _, text, _ in rows[:40]] + ["", "   ", "!!!", "zwerk"]
    evidence, spans = model.signals(texts, spans=True)
    for k, text in enumerate(texts):
        top, expected, number, found = 1e-6, 0.0, 0, []
        for block in toxicity.blocks([text]):
            features, _, starts, ends, piece = toxicity.token_features(block)
            if not len(starts):
                continue
            e, start, step = model.crf.emissions(features).astype(float), np.exp(model.crf.start.astype(float)), np.exp(model.crf.step.astype(float))
            forward = [start * np.exp(e[0] - e[0].max())]
            for row in e[1:]:
                forward.append((forward[-1] / forward[-1].sum()) @ step * np.exp(row - row.max()))
            beta = np.ones(2)
            p = np.zeros(len(e))
            for t in range(len(e) - 1, -1, -1):
                both = forward[t] * beta
                p[t] = both[1] / both.sum()
                beta = step @ (np.exp(e[t] - e[t].max()) * beta)
                beta /= beta.sum()
            top, expected, number = max(top, *p), expected + p[p > 0.01].sum(), number + len(p)
            found += [(int(a), int(b)) for a, b, q in zip(starts, ends, p) if q >= 0.5]
        top = min(max(top, 1e-6), 1 - 1e-6)
        assert evidence[k] == pytest.approx([math.log(top / (1 - top)), math.log1p(expected), math.log(expected / max(number, 1) + 1e-3)], abs=5e-3)
        assert spans[k] == found
    for k, text in enumerate(texts[:40]):
        assert [text[a:b].lower() for a, b in spans[k]] == [w.lower() for w in re.findall(r"\w+", text) if w.lower().startswith(("grobian", "zwerk"))]


def test_ties_and_long_texts_through_the_queries(spark, tmp_path):
    long = "ba ko mi ru te sa lo " * (BLOCK_CHARS // 10) + "zwerk"
    rows = [(k, text, "en" if k % 2 else "fr", "s", y) for k, text, y in drawn(5)] + [(500, long, "en", "s", 1), (501, long, "fr", "s", 0), (502, "word", "en", "s", 0), (503, "word", "fr", "s", 0)]
    spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1 - r[4], r[4]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, column in (("op3_language", "lang_pred"), ("op4_toxicity", "score"), ("op5_quality", "score"), ("op8_licenses", "n_words")):
        got = {r["doc_id"]: r[column] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
        assert got[500] == got[501] and got[502] == got[503] and got[500] is not None  # equal texts, whatever their languages and labels
    assert {r["doc_id"]: r["n_words"] for r in queries.op8_licenses(spark, str(tmp_path)).collect()}[500] == len(long.split())


# Fingerprints


def m(value):
    return int(mix(np.array([value % (1 << 64)], np.uint64))[0])


def terms(text):
    return {int(fingerprint.term_pairs([w])[0]) for w in re.findall(r"[^\W_]+", text)}


def plain_print(text, kept):
    mine = terms(text)
    mine = (mine & kept) or mine
    out, per = [], 64 // fingerprint.LEVELS
    for g in range(fingerprint.GROUPS):
        levels = {}
        for term in mine:
            bits = m(term + ((g - g % per + 1) << 32)) >> (g % per * fingerprint.LEVELS) & ((1 << fingerprint.LEVELS) - 1)
            levels[term] = next((k for k in range(fingerprint.LEVELS) if bits >> k & 1), fingerprint.LEVELS)
        for j in range(fingerprint.LEVELS):
            inside = [term for term in mine if levels[term] > j]
            out.append(m(sum((m(term + (1 << 60)) >> 32) + 1 for term in inside) + (g << 56)) % 255 + 1 if inside else 0)
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    alike = total = 0.0
    for g in range(fingerprint.GROUPS):
        row = range(g * fingerprint.LEVELS, (g + 1) * fingerprint.LEVELS)
        rank = 0
        for j in reversed(row):
            if a[j] or b[j]:
                rank += 1
                total += 0.5**rank
                alike += 0.5**rank * (a[j] == b[j])
    return min(alike / total, 1 - 1e-9) if total else 0.0


def test_fingerprints_and_likenesses_equal_brute_force(spark, tmp_path):
    draw = random.Random(9)
    words = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 4))) for _ in range(120)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 40))) for _ in range(70)]
    texts += [texts[3], texts[5] + " one more", None, "", "é🎉 Ünï", texts[7].upper()]
    ids = draw.sample(range(1000), len(texts))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(zip(ids, [t or "" for t in texts]))
    frequency = Counter(t for _, text in order for t in terms(text))
    kept = {t for t, n in frequency.items() if fingerprint.LEAST_DOCUMENTS <= n <= fingerprint.MOST_SHARE * len(order)}
    assert kept and len(kept) < len(frequency)
    got = {r["doc_id"]: r for r in queries.op9_fingerprint(spark, str(tmp_path)).collect()}
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        mine, other, following = (plain_print(t, kept) for t in (text, edited, after))
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == bytes(mine).hex() and r["edited_fingerprint"] == bytes(other).hex()
        assert r["near_edited"] == pytest.approx(plain_likeness(mine, other)) and r["near_next"] == pytest.approx(plain_likeness(mine, following))
