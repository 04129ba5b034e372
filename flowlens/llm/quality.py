"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns texts into fixed-width vectors in numpy; ``fit`` boosts trees on a bounded labelled sample; ``Forest`` keeps the
trees as flat arrays and walks all rows through a tree level by level.

Defined cases: a NUL character parts words as white space does; a null text counts as empty and gets a score like any other vector (all statistics 0); of a very long text every
character counts, repetition being measured in blocks and averaged by words; with no labelled row every score is 1, with one class it
is that class; repeated rows get equal scores; of splits of equal gain the first statistic and the lowest cut wins; an empty table gives no
rows. Only the text, doc_id and the label are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.blocks import as_texts, blocks, char_tables, run_hashes
from flowlens.llm.common import small_batches

#: Bound on the labelled documents of each class that the trees are fitted on.
DOCS_PER_CLASS = 6000
THRESHOLD = 0.7
STATISTICS = (
    "log_chars", "log_words", "letter_share", "upper_share", "digit_share", "space_share", "newline_share", "comma_stop_share", "other_mark_share",
    "non_ascii_share", "word_length", "word_length_sd", "long_word_share", "short_word_share", "caps_word_share", "markless_end_share", "marked_end_share",
    "letterless_word_share", "distinct_word_share", "repeat_word_share", "distinct_pair_share", "distinct_triple_share", "distinct_line_share", "words_per_line", "words_per_stop", "longest_run",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    tables = char_tables()
    n = len(texts)
    total = {k: np.zeros(n) for k in ("chars", "letters", "upper", "digit", "space", "newline", "soft", "marks", "wide", "words", "length", "square", "long", "short", "caps", "plain_end", "marked_end", "letterless", "distinct", "repeat", "pairs", "pairs_distinct", "triples", "triples_distinct", "lines", "lines_distinct", "stops")}
    longest = np.zeros(n)

    def count(name: str, flags: np.ndarray, block) -> None:
        np.add.at(total[name], block.rows, np.add.reduceat(flags, block.at, dtype=np.int64))

    for block in blocks(texts):
        codes = block.codes.copy()
        codes[block.at + block.lengths] = 0  # the newline after a piece is not of the text
        small = codes < 128
        letters, space = tables["alpha"][codes], tables["space"][codes]
        upper, digit = tables["upper"][codes], tables["digit"][codes]
        soft = small & ((codes == 44) | (codes == 46))
        marks = ~(letters | space | digit | soft) & (codes != 0)
        np.add.at(total["chars"], block.rows, block.lengths)
        for name, flags in (("letters", letters), ("upper", upper), ("digit", digit), ("space", space), ("newline", codes == 10), ("soft", soft), ("marks", marks), ("wide", ~small), ("stops", codes == 46)):
            count(name, flags, block)

        starts, ends, piece = block.runs(~space & (codes != 0))
        if not len(starts):
            continue
        row, size = block.rows[piece], ends - starts
        last = codes[ends - 1]
        inner = np.concatenate([[0], np.cumsum(letters)])
        capital = np.concatenate([[0], np.cumsum(upper)])
        in_word = inner[ends] - inner[starts]
        per_word = {"words": np.ones(len(row)), "length": size, "square": size.astype(float) ** 2, "long": size > 14, "short": size < 3, "caps": (capital[ends] - capital[starts] == in_word) & (in_word > 1), "plain_end": tables["alpha"][last], "marked_end": marks[ends - 1], "letterless": in_word == 0}
        for name, values in per_word.items():
            total[name] += np.bincount(row, values, n)

        words = run_hashes(block.lower, starts, ends)
        owner = piece.astype(np.uint64) << np.uint64(40)
        same = (piece[1:] == piece[:-1]) & (words[1:] == words[:-1])
        total["repeat"] += np.bincount(row[1:], same, n)
        edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        np.maximum.at(longest, row[edges[:-1]], np.diff(edges))

        def distinct(hashes: np.ndarray, holder: np.ndarray, name: str) -> None:
            keys = np.unique(holder | (hashes >> np.uint64(24)))
            total[name] += np.bincount(block.rows[(keys >> np.uint64(40)).astype(np.int64)], minlength=n)

        distinct(words, owner, "distinct")
        gram = words
        for step, name in ((1, "pairs"), (2, "triples")):
            gram = gram[:-1] * np.uint64(0x100000001B3) + words[step:]
            inside = piece[step:] == piece[:-step]
            total[name] += np.bincount(row[step:], inside, n)
            distinct(gram[inside], owner[step:][inside], f"{name}_distinct")
        starts, ends, piece = block.runs((codes != 10) & (codes != 0))
        total["lines"] += np.bincount(block.rows[piece], minlength=n)
        distinct(run_hashes(codes, starts, ends), piece.astype(np.uint64) << np.uint64(40), "lines_distinct")

    t = total
    over = lambda a, b: np.divide(t[a], t[b], out=np.zeros(n), where=t[b] > 0)
    mean = over("length", "words")
    return np.column_stack([
        np.log1p(t["chars"]), np.log1p(t["words"]), over("letters", "chars"), over("upper", "letters"), over("digit", "chars"), over("space", "chars"), over("newline", "chars"), over("soft", "chars"), over("marks", "chars"),
        over("wide", "chars"), mean, np.sqrt(np.maximum(0, over("square", "words") - mean**2)), over("long", "words"), over("short", "words"), over("caps", "words"), over("plain_end", "words"), over("marked_end", "words"),
        over("letterless", "words"), over("distinct", "words"), over("repeat", "words"), over("pairs_distinct", "pairs"), over("triples_distinct", "triples"), over("lines_distinct", "lines"), over("words", "lines"), over("words", "stops"), np.log1p(longest),
    ])


@dataclass
class Forest:
    """Trees as flat arrays: a node is a leaf where feature is -1; left and right are node numbers; roots has the first node of each tree."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, down)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic gradient boosting on per-feature quantile bins; a split needs a hessian of ``least`` on both sides."""
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    share = np.average(y, weights=weight) if n else 1.0
    if n == 0 or share in (0.0, 1.0):
        return Forest(30.0 if share == 1.0 else -30.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)])
    base = float(np.log(share / (1 - share)))
    score, nodes, roots = np.full(n, base), [], []
    column = np.arange(m)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0.0, 0, 0, 0.0])
        level, where = [roots[-1]], np.zeros(n, np.int64)  # where: position within the level, -1 once in a leaf
        for d in range(depth + 1):
            live = where >= 0
            flat = (where[live, None] * m + column) * bins + binned[live]
            shape = (len(level), m, bins)
            g = np.bincount(flat.ravel(), np.repeat(grad[live], m), minlength=len(level) * m * bins).reshape(shape)
            h = np.bincount(flat.ravel(), np.repeat(hess[live], m), minlength=len(level) * m * bins).reshape(shape)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least) | (ht - hl < least)] = 0
            for j in range(m):
                gain[:, j, len(cuts[j]) :] = 0
            best = gain.reshape(len(level), -1).argmax(1)
            following, move = [], np.full(len(level), -1)
            for k, node in enumerate(level):
                j, b = divmod(int(best[k]), bins)
                nodes[node][4] = float(-rate * gt[k, 0, 0] / (ht[k, 0, 0] + penalty))
                if d < depth and gain[k, j, b] > 1e-6:
                    nodes[node][:4] = [j, float(cuts[j][b]), len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    move[k] = len(following)
                    following += [len(nodes) - 2, len(nodes) - 1]
            at = np.where(live, where, 0)
            split = np.array([nodes[node][0] for node in level])[at]
            limit = np.array([nodes[node][1] for node in level])[at]
            done = live & (move[at] < 0)
            score[done] += np.array([nodes[node][4] for node in level])[at[done]]
            go_right = x[np.arange(n), np.maximum(split, 0)] > limit
            where = np.where(live & (move[at] >= 0), move[at] + go_right, -1)
            level = following
            if not level:
                break
    flat = list(zip(*nodes))
    return Forest(base, np.array(flat[0], np.int32), np.array(flat[1]), np.array(flat[2], np.int32), np.array(flat[3], np.int32), np.array(flat[4]), np.array(roots, np.int32), depth)


def statistics_column(text: str | Column = "text") -> Column:
    @F.pandas_udf("array<double>")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(statistics(as_texts(part))))

    return compute(text)


def fit(rows: DataFrame) -> Forest:
    """Trees from (text, y, weight) rows, a bounded sample (see ``common.labelled``). Only the statistics come to the driver.

    The weights restore the class shares of all labels; their mean is set to 1, for which ``least`` and ``penalty`` of ``boost`` are meant.
    """
    got = rows.select(statistics_column("text").alias("x"), "y", "weight").toPandas()
    if not len(got):
        return Forest(30.0)
    weight = got["weight"].to_numpy(float)
    return boost(np.array(got["x"].tolist()), got["y"].to_numpy(float), weight / weight.mean())


def score_column(session, model: Forest, text: str | Column = "text") -> Column:
    """The probability of label 1."""
    shared = small_batches(session).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.probability(statistics(as_texts(part))))

    return score(text)
