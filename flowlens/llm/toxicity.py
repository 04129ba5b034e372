"""Toxicity: a linear-chain CRF tags toxic spans; forward-backward marginals give document scores and the offending offsets.

Labels come by document. ``fit`` labels tokens from them in two Spark aggregations over a bounded labelled sample: words and
stems that are far more frequent, by documents, in the one class than in the other mark toxic tokens in documents of that class. The CRF
learns from windows around such tokens and from windows of clean documents; a logistic calibration then maps a document's largest
marginal and the expected number and share of toxic tokens to a score.

Defined cases: a null or empty text has no spans and the score of a document without a toxic token; very long texts are tagged whole;
repeated rows get equal results; a token is toxic at ``SPAN_LEVEL`` or more, a tie included; with no labelled row, or one class, every score
is 0; an empty table gives no rows. Only doc_id, the text and the label are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.blocks import Block, as_texts, blocks, run_hashes
from flowlens.llm.common import checkpointed, small_batches
from flowlens.llm.crf import Crf, train

#: Bounds of the fit: labelled documents of each class, seed words, and token windows of each class.
DOCS_PER_CLASS = 4000
SEED_WORDS = 2000
WINDOWS = 3000
BITS = 18
PREFIXES = (4, 5, 6, 7)
SPAN_LEVEL = 0.5


def token_features(block: Block) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the alphanumeric tokens: hashed features, units, starts, ends and pieces.

    Units (tokens, 1 + ``PREFIXES``) are hashes of the whole word and of its proper prefixes, 0 where the word is too short, for the words
    of a language that builds its insults from a stem. The features are the units, the neighbouring words, the ending and the length.
    """
    starts, ends, piece = block.words("alnum")
    word, size = run_hashes(block.lower, starts, ends), ends - starts
    units = [word]
    for n in PREFIXES:
        long = size > n
        units.append(np.where(long, run_hashes(block.lower, starts, np.where(long, starts + n, starts)) + np.uint64(n), np.uint64(0)))
    suffix = run_hashes(block.lower, ends - np.minimum(size, 3), ends)
    edge = np.uint64(0x5EED)
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[np.diff(piece, prepend=-1) != 0], after[np.diff(piece, append=-1) != 0] = edge, edge
    salt = lambda h, k: (((h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
    features = [*units, before, after, suffix, np.minimum(size, 12).astype(np.uint64)]
    return [salt(h, k + 1) for k, h in enumerate(features)], np.stack(units, axis=1), starts, ends, piece


def _is_seed(units: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.isin(units, seeds).any(axis=1)


@dataclass
class ToxicityModel:
    crf: Crf | None
    calibration: np.ndarray  # the intercept, then a weight for each column of ``evidence``

    def signals(self, texts: list[str], spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """For each text ``evidence`` and, if asked for, the spans (code points, end exclusive) of tokens at ``SPAN_LEVEL``."""
        top, expected, number, found = np.full(len(texts), 1e-6), np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
        for block in blocks(texts) if self.crf else ():
            features, _, starts, ends, piece = token_features(block)
            if not len(starts):
                continue
            lengths = np.bincount(piece, minlength=len(block.rows))
            p = self.crf.marginals(self.crf.emissions(features), lengths)[:, 1]
            row = block.rows[piece]
            np.maximum.at(top, row, p)
            expected += np.bincount(row, np.where(p > 0.01, p, 0), len(texts))
            number += np.bincount(row, minlength=len(texts))
            for k in np.flatnonzero(p >= SPAN_LEVEL) if spans else ():
                shift = block.begin[piece[k]] - block.at[piece[k]]
                found[row[k]].append((int(starts[k] + shift), int(ends[k] + shift)))
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.column_stack([np.log(top / (1 - top)), np.log1p(expected), np.log(expected / np.maximum(number, 1) + 1e-3)]), found

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.crf is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + evidence @ self.calibration[1:], -30, 30)))


def _seed_words(sample: DataFrame, least: int = 3, odds: float = 12.0, deviations: float = 5.0) -> np.ndarray:
    """Hashes of the units whose share of toxic documents is at least ``odds`` times that of clean ones, the most telling first.

    At least ``least`` toxic documents must hold a unit, more by ``deviations`` standard deviations than if it were as common in both classes;
    ties go to the smaller hash.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = pdf["y"].to_numpy(np.uint64)
            for block in blocks(as_texts(pdf["text"])):
                _, units, _, _, piece = token_features(block)
                holder = np.repeat(block.rows[piece].astype(np.uint64), units.shape[1])
                pairs = np.unique(np.stack([holder, units.ravel()], axis=1)[units.ravel() > 0], axis=0)
                words, number = np.unique(np.stack([pairs[:, 1], y[pairs[:, 0].astype(np.int64)]], axis=1), axis=0, return_counts=True)
                yield pd.DataFrame({"word": words[:, 0].view(np.int64), "y": words[:, 1].astype(np.int64), "n": number})

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return np.zeros(0, np.uint64)
    by_word = sample.select("text", "y").mapInPandas(count, "word long, y long, n long").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    toxic, clean = F.col("a") / n[1], (F.col("b") + 0.5) / n[0]
    # Were a unit as common in both classes, its documents would fall into the toxic one by that class's share of the sample.
    share, both = n[1] / (n[0] + n[1]), F.col("a") + F.col("b")
    excess = F.col("a") - share * both
    rows = by_word.where((F.col("a") >= least) & (toxic >= odds * clean) & (excess >= deviations * F.sqrt(both * share * (1 - share)))).orderBy(F.desc(toxic - clean), "word").limit(SEED_WORDS).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def _windows(sample: DataFrame, seeds: np.ndarray, width: int = 16) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and lengths of training windows: about a seed of each document, or for half the clean ones a place given by the id."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, ids = pdf["y"].to_numpy(), pdf["doc_id"].to_numpy(np.int64)
            out = []
            for block in blocks(as_texts(pdf["text"])):
                features, units, _, _, piece = token_features(block)
                like = _is_seed(units, seeds)
                toxic = like & (y[block.rows[piece]] == 1)
                bounds = np.searchsorted(piece, np.arange(len(block.rows) + 1))
                for k, row in enumerate(block.rows):
                    a, b = bounds[k], bounds[k + 1]
                    hits = np.flatnonzero(like[a:b])
                    if b == a or (y[row] == 1 and not len(hits)):
                        continue
                    centre = hits[ids[row] % len(hits)] if len(hits) and (y[row] == 1 or ids[row] % 2) else ids[row] * 7919 % (b - a)
                    lo = max(0, min(int(centre) - width // 2, b - a - width))
                    sl = slice(a + lo, min(b, a + lo + width))
                    out.append({"y": int(y[row]), "doc_id": int(ids[row]), "features": np.stack([f[sl] for f in features]).ravel(), "labels": toxic[sl].astype(np.int64)})
            yield pd.DataFrame(out, columns=["y", "doc_id", "features", "labels"])

    got = sample.mapInPandas(pick, "y int, doc_id long, features array<long>, labels array<long>")
    rows = [r for y in (0, 1) for r in got.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(WINDOWS).collect()]
    lengths = np.array([len(r["labels"]) for r in rows], np.int64)
    parts = [np.array(r["features"], np.int64).reshape(-1, len(r["labels"])) for r in rows]
    return list(np.concatenate(parts, axis=1)), np.concatenate([np.array(r["labels"], np.int64) for r in rows]), lengths


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    balance = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = balance * np.maximum(p * (1 - p), 1e-9)
        w = w + np.linalg.solve((x * h[:, None]).T @ x + penalty * len(y) * np.eye(len(w)), x.T @ (balance * (y - p)) - penalty * len(y) * w)
    return w


def fit(sample: DataFrame) -> ToxicityModel:
    """From (doc_id, text, y), a bounded sample (see ``common.labelled``); words, windows and signals reach the driver, texts do not.

    The sample is read several times, so it is written once, in the shared folder.
    """
    sample = checkpointed(sample)
    seeds = _seed_words(sample)
    if not len(seeds):
        return ToxicityModel(None, np.zeros(4))
    features, labels, lengths = _windows(sample, seeds)
    model = ToxicityModel(train(features, labels, lengths, 1 << BITS, 2), np.zeros(4))
    got = sample.select("y", signals_column(sample.sparkSession, model, "text").alias("s")).select("y", "s.evidence").toPandas()
    model.calibration = _logistic(np.array(got["evidence"].tolist()), got["y"].to_numpy(float))
    return model


def signals_column(session, model: ToxicityModel, text: str | Column = "text") -> Column:
    """struct<evidence array<double>, score double, spans array<struct<start, end>>>: the offending offsets are in code points, end exclusive."""
    shared = small_batches(session).sparkContext.broadcast(model)

    @F.pandas_udf("evidence array<double>, score double, spans array<struct<start:long,end:long>>")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            evidence, spans = shared.value.signals(as_texts(part), spans=True)
            yield pd.DataFrame({"evidence": list(evidence), "score": shared.value.score(evidence), "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]})

    return compute(text)
