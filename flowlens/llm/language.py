"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts hashed n-grams per language in one Spark aggregation and returns a log-probability matrix of fixed size
(``2**bits`` rows); ``LanguageModel.predict`` scores a batch by gathering the rows of the n-grams that occur, in numpy.

Defined cases: a null or letterless text is ``und`` with score 0; very long texts are scored whole, block by block; ties go to the
language that sorts first; repeated rows get equal results and count as often as they stand there in the fit; with no labelled row every
text is ``und``; an empty table gives no rows. Only doc_id, the text and the language are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.blocks import Block, as_texts, blocks, char_tables, mix
from flowlens.llm.common import small_batches

#: Bound on the documents of one language that the model is fitted on.
DOCS_PER_LANGUAGE = 5000
BITS = 15
ORDERS = (2, 3)


def gram_buckets(block: Block, bits: int = BITS) -> list[np.ndarray]:
    """For each order a bucket per position; positions without a letter get the bucket ``2**bits``, which weighs nothing."""
    letters = char_tables()["alpha"][block.codes]
    codes = np.where(letters, block.lower, np.uint32(32)).astype(np.uint64)
    out, gram, any_letter = [], codes, letters
    for order in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint64(0x1000193) + codes[order - 1 :]
        any_letter = any_letter[:-1] | letters[order - 1 :]
        if order in ORDERS:
            bucket = (mix(gram + np.uint64(order << 56)) >> np.uint64(64 - bits)).astype(np.int64)
            bucket[~any_letter] = 1 << bits
            out.append(np.concatenate([bucket, np.full(order - 1, 1 << bits)]))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int = BITS

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """A language and its posterior probability for each text."""
        score, letters = np.tile(self.log_prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        for block in blocks(texts, max(1 << 14, (1 << 21) // max(4, len(self.languages)))):
            for bucket in gram_buckets(block, self.bits):
                np.add.at(score, block.rows, np.add.reduceat(self.log_prob[bucket], block.at, axis=0, dtype=np.float64))
            np.add.at(letters, block.rows, np.add.reduceat(char_tables()["alpha"][block.codes], block.at, dtype=np.int64))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = score.argmax(axis=1)
        top = score.max(axis=1, keepdims=True)
        probability = 1 / np.exp(score - top).sum(axis=1)
        known = letters > 0
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, probability, 0.0)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE, bits: int = BITS, smoothing: float = 0.1) -> LanguageModel:
    """Fit on the rows whose text and language are known: about ``per_language`` of each language, chosen by a hash of the text's row.

    The counts are summed by Spark; what comes to the driver is one count per language and bucket.
    """
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col("doc_id").alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    totals = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / totals[name]))]) if languages else None
    log_prob = np.zeros(((1 << bits) + 1, len(languages)), np.float32)
    if not languages:
        return LanguageModel([], np.zeros(0), log_prob, bits)
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share[F.col("_lang")] * 1_000_000)
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(number), (1 << bits) + 1), np.int64)
        for pdf in batches:
            names = pdf["_lang"].map(number).to_numpy()
            for block in blocks(as_texts(pdf["_text"])):
                owner = np.repeat(names[block.rows], block.lengths + 1)
                for bucket in gram_buckets(block, bits):
                    seen += np.bincount(owner * seen.shape[1] + bucket, minlength=seen.size).reshape(seen.shape)
        lang_no, bucket = np.nonzero(seen[:, :-1])
        yield pd.DataFrame({"l": lang_no, "b": bucket, "n": seen[lang_no, bucket]})

    counts = np.zeros((1 << bits, len(languages)))
    for r in sample.mapInPandas(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["b"], r["l"]] = r["n"]
    log_prob[:-1] = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * len(counts)))
    weight = np.array([totals[name] for name in languages], float)
    return LanguageModel(languages, np.log(weight / weight.sum()), log_prob, bits)


def predict_column(session, model: LanguageModel, text: str | Column = "text") -> Column:
    """struct<lang string, score double> for a text column; the model is broadcast (its size is fixed by ``bits`` and the languages)."""
    shared = small_batches(session).sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, score = shared.value.predict(as_texts(part))
            yield pd.DataFrame({"lang": names, "score": score})

    return predict(text)
