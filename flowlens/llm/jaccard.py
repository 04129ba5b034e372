"""N-gram Jaccard join: an exact self-join of shingle sets by universe partition and the pigeonhole principle.

Sets are taken in bands of like size. In a band, tokens are hashed into segments; two linked sets of the band differ in at most H tokens, so
with exact segments counting 1 and segments with a one-deletion neighbourhood counting 2, a count of H + 1 makes sure that linked sets share a
signature. How many segments get the neighbourhood is chosen by cost for each band: signatures written against pairs that would meet by
chance. Sets that share a signature are verified exactly, in buckets, and each bucket gives the edges of a spanning forest of its links.

* Equal sets are one class from the start; only one member of a class is indexed.
* Buckets with equal members are one bucket; a large bucket is dealt into pairs of blocks. Outlines of the sets, a few bytes each, then rule
  out most pairs that met by chance. The groups left that share classes form clusters, and a task holds each set of a cluster once; a large
  cluster is dealt into parts by its groups. So what a task holds is bounded.
* Components are found by alternating large-star and small-star steps, each a Spark aggregation and join.

Defined cases: null and empty texts, and rows without an id, link with nothing and are their own component; repeated rows are one class;
very long texts are read whole; a similarity of exactly the threshold links; an empty table gives no rows. Only doc_id and the text are read,
so other columns may have any names. Tokens are 64-bit hashes of shingles, classes 128-bit hashes of sets,
named by the first 64 bits while candidates are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.blocks import blocks, mix, run_hashes
from flowlens.llm.common import checkpointed, small_batches

WORDS = 3
PERCENT = 90
BLOCK_SETS, BLOCK_TOKENS, CLUSTER_TOKENS = 512, 1 << 20, 1 << 22
#: How many times as many sets a block may have where only groups are asked for: outlines are small, and near copies need few comparisons.
OUTLINE_BLOCKS = 16
#: Numbers that a comparison of many outlines, or the matrix of many sets' tokens, holds at once.
PAIR_CELLS, MATRIX_CELLS = 1 << 18, 1 << 23
#: Tables of up to this many rows (a few dozen bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Ids alone are broadcast up to this number, as the other side holds the texts.
BROADCAST_IDS = 1_000_000
SALTS = 16
#: From so many edges on a node of the graph of links counts as heavy, at least.
HEAVY_NODE = 1000


def token_sets(texts: list[str], words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    r"""(row, sorted distinct tokens): shingles of ``words`` words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; fewer words are one shingle."""
    multiplier = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(words)]

    def shingled(parts: list[np.ndarray]) -> np.ndarray:
        w = np.concatenate(parts) if len(parts) > 1 else parts[0]
        if not len(w):
            return w
        n = len(w) - words + 1
        if n < 1:
            return mix(np.array([sum(int(x) * int(m) for x, m in zip(w, multiplier)) + len(w) & (1 << 64) - 1], np.uint64))
        total = w[:n] * multiplier[0]
        for k in range(1, words):
            total += w[k : n + k] * multiplier[k]
        return np.unique(mix(total))

    row, held = 0, []
    for block in blocks(texts, whole_words=True):
        codes = np.where((block.codes >= 65) & (block.codes <= 90), block.codes + np.uint32(32), block.codes)
        inside = (codes != 32) & ((codes < 9) | (codes > 13))
        inside[block.at + block.lengths] = False
        starts, ends, piece = block.runs(inside)
        hashes = run_hashes(codes, starts, ends)
        bounds = np.searchsorted(piece, np.arange(len(block.rows) + 1))
        for k, r in enumerate(block.rows):
            if held and r != row:
                yield row, shingled(held)
                held = []
            row = int(r)
            held.append(hashes[bounds[k] : bounds[k + 1]])
    if held:
        yield row, shingled(held)


def set_hashes(tokens: np.ndarray) -> tuple[int, int]:
    n = np.uint64(len(tokens))
    pair = mix(np.array([tokens.sum(dtype=np.uint64) + n, mix(tokens + np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) ^ n], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def outline(tokens: np.ndarray) -> bytes:
    """Counts of tokens by their low bits, a byte each, for about sixteen tokens: two sets differ in at least the sum of differences of counts."""
    bins = 32
    while bins * 16 < len(tokens):
        bins *= 2
    return np.minimum(np.bincount((tokens & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _fits(counts: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, some: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and outlines allow a link between each of ``some`` and each of ``others``; with ``side``, only between sides."""
    x, y = sizes[some][:, None], sizes[others][None, :]
    apart = np.abs(counts[some][:, None, :] - counts[others][None, :, :]).sum(axis=2)
    fit = (apart * (100 + percent) <= (x + y) * (100 - percent)) & (100 * x >= percent * y) & (100 * y >= percent * x)
    return fit if side is None else fit & (side[some][:, None] != side[others][None, :])


def survivors(outlines: list[bytes], sizes: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """Groups of sets that hang together by pairs whose sizes and outlines allow a link; where both sides 0 and 1 occur, by pairs across.

    A group grows from its first set: what it met last is held against what no group has yet, so copies of one text take a few comparisons each.
    """
    n = len(outlines)
    bins = min(map(len, outlines))
    counts = np.stack([np.frombuffer(o, np.uint8).reshape(-1, bins).sum(axis=0, dtype=np.int32) for o in outlines])
    side = side if side.min() != side.max() else None
    rest, out = np.arange(n), []
    whole = n * n * bins <= PAIR_CELLS
    if whole:
        fit = _fits(counts, sizes, side, rest, rest, percent)
        fit[rest, rest] = False
        rest = np.flatnonzero(fit.any(axis=1))
    while len(rest):
        members, front, rest = [rest[:1]], rest[:1], rest[1:]
        while len(front) and len(rest):
            met = np.zeros(len(rest), bool)
            step = len(front) if whole else max(1, PAIR_CELLS // (len(rest) * bins))
            for a in range(0, len(front), step):
                left = np.flatnonzero(~met)
                some = front[a : a + step]
                met[left] = (fit[np.ix_(some, rest[left])] if whole else _fits(counts, sizes, side, some, rest[left], percent)).any(axis=0)
            front, rest = rest[met], rest[~met]
            members.append(front)
        if len(members) > 1 and sum(map(len, members)) > 1:
            out.append(np.sort(np.concatenate(members)))
    return out


@lru_cache(maxsize=8)
def band_starts(largest: int) -> tuple[int, ...]:
    """Smallest sizes of the bands, past ``largest``. A band reaches to half as much again: wider ones need more segments, narrower ones put
    more sets into two bands."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return tuple(out)


def differences(smaller: int, percent: int = PERCENT) -> int:
    """The most tokens in which a set of up to ``smaller`` tokens and a set no smaller, linked to it, can differ."""
    both = smaller + smaller * 100 // percent
    return both * (100 - percent) // (100 + percent)


def allocate(largest: int, sizes: dict[int, int], percent: int = PERCENT) -> dict[int, tuple[int, int, int]]:
    """band number -> (segments, wide, spare), the cheapest by estimated signatures written and pairs that meet by chance.

    The first ``wide`` segments get one-deletion neighbourhoods. ``spare`` is how far segments, wide ones counting 2, exceed H + 1: a set
    with at most so many empty segments need not index them, for then it shares more than those with any set it links to.
    sizes: number of classes by size, over all documents. Bands where only equal sets link are left out.
    """
    starts, out = band_starts(largest), {}
    for band, low in enumerate(starts[:-1]):
        high = starts[band + 1] - 1
        need = differences(high, percent) + 1
        if need < 2:
            continue
        sets = float(sum(n for size, n in sizes.items() if low <= size <= high * 100 // percent)) or 1.0
        best = None
        for wide in sorted({0, 1, need // 8, need // 4, need // 2}):
            for sigmas in (None, 0, 1, 2, 3, 4):
                spare, segments = 0, need - wide
                for _ in range(3 if sigmas is not None else 0):  # more segments leave more of them empty
                    empty = (segments - wide) * np.exp(-low / segments)
                    spare = int(np.ceil(empty + sigmas * np.sqrt(empty)))
                    segments = need - wide + spare
                load = low / segments
                empty = (segments - wide) * np.exp(-load)
                crowded = sets * _poisson_tail(empty, spare)
                met = crowded**2 / 2 * empty**2 / max(1, segments - wide) + sets**2 / 2 * wide * np.exp(-2 * load) * (1 + 2 * load)
                cost = sets * (segments - wide + wide * (1 + load)) + 3 * met
                if best is None or cost < best[0]:
                    best = (cost, segments, wide, spare)
        out[band] = best[1:]
    return out


def _poisson_tail(mean: float, k: int) -> float:
    """The chance of more than ``k`` events."""
    term = total = np.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def signatures(sets: list[np.ndarray], allocation: dict[int, tuple[int, int, int]], starts: tuple[int, ...], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature): for each set those of its own band and of lower bands that hold sets it can link to."""
    sizes = np.array([len(s) for s in sets])
    own = np.searchsorted(starts, sizes, side="right") - 1
    lowest = np.searchsorted(starts, -(-sizes * percent // 100), side="right") - 1
    entries = [(k, b) for k, (a, z) in enumerate(zip(lowest, own)) for b in range(a, z + 1) if b in allocation]
    if not entries:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, band = (np.array(c, np.int64) for c in zip(*entries))
    segments, wide, spare = (np.array([allocation[b][k] for b in band], np.int64) for k in range(3))
    base = np.cumsum(segments) - segments
    entry = np.repeat(np.arange(len(entries)), sizes[owner])
    tokens = np.concatenate([sets[k] for k in owner])
    spread = mix(tokens ^ (band[entry].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(32)
    segment = ((spread * segments[entry].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    weight = mix(tokens + np.uint64(0x2545F491))
    sums = np.zeros(segments.sum(), np.uint64)
    np.add.at(sums, base[entry] + segment, weight)
    holder = np.repeat(np.arange(len(entries)), segments)
    place = np.arange(len(sums)) - base[holder]
    name = lambda e, s: mix((band[e] << 32 | s).astype(np.uint64) + np.uint64(0xA5A5A5A5))
    empty = (np.bincount(base[entry] + segment, minlength=len(sums)) == 0) & (place >= wide[holder])
    written = ~empty | (np.bincount(holder, empty, len(entries)) > spare)[holder]
    holder, place, exact = holder[written], place[written], sums[written]
    near = segment < wide[entry]
    deleted = mix((sums[base[entry] + segment] - weight)[near] ^ name(entry[near], segment[near]))
    return np.concatenate([owner[holder], owner[entry[near]]]), np.concatenate([mix(exact ^ name(holder, place)), deleted])


def forest(sets: list[np.ndarray], group: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that join sets of different groups along links. Changes ``group``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(sizes) - sizes
    edges = []
    flags = np.zeros(token.max() + 1, bool)
    for p in range(n - 1):
        other = (group != group[p]) & (np.arange(n) > p)
        other &= (100 * sizes >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes)
        others = np.flatnonzero(other)
        if not len(others):
            continue
        mine = token[at[p] : at[p] + sizes[p]]
        flags[mine] = True
        if len(others) * 4 < n:
            shared = np.array([np.count_nonzero(flags[token[at[q] : at[q] + sizes[q]]]) for q in others])
        else:
            shared = np.add.reduceat(flags[token], at, dtype=np.int64)[others]
        flags[mine] = False
        for q in others[100 * shared >= percent * (sizes[p] + sizes[others] - shared)]:
            if group[q] != group[p]:
                edges.append((int(p), int(q)))
                group[group == group[q]] = group[p]
    return edges


def spanning_links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between all sets; where both sides 0 and 1 occur, of the links across.

    Shared tokens of many pairs at once are a product of matrices: a column for each token that at least two sets have. Where these are too
    many, tokens share columns and the product is no less than what is shared; pairs that it lets through are then counted one by one.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    side = side if side.min() != side.max() else None
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = (often > 1)[token]
    column = (np.cumsum(often > 1) - 1)[token[common]]
    known = int((often > 1).sum())
    columns = max(1, min(known, MATRIX_CELLS // n))
    has = np.zeros((n, columns), np.float32)
    np.add.at(has.reshape(-1), np.repeat(np.arange(n), sizes)[common] * columns + column % columns, np.float32(1))
    if np.einsum("ij,ij->i", has, has, dtype=np.float64).max() >= 1 << 24:  # no product is larger; up to here 32 bits hold them exactly
        has = has.astype(np.float64)
    rest, edges = np.arange(n), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            by = np.full(len(rest), -1)
            for a in range(0, len(front), 256):
                left = np.flatnonzero(by < 0)
                if not len(left):
                    break
                some, others = front[a : a + 256], rest[left]
                x, y = sizes[some][:, None], sizes[others][None, :]
                shared = (has[some] @ has[others].T).astype(np.float64)
                fit = (100 * shared >= percent * (x + y - shared)) & (100 * x >= percent * y) & (100 * y >= percent * x)
                if side is not None:
                    fit &= side[some][:, None] != side[others][None, :]
                for k in np.flatnonzero(fit.any(axis=0)):
                    for p in some[fit[:, k]]:
                        if columns == known or _linked(sets[p], sets[others[k]], percent):
                            by[left[k]] = p
                            break
            edges += [(int(p), int(q)) for p, q in zip(by[by >= 0], rest[by >= 0])]
            front, rest = rest[by >= 0], rest[by < 0]
    return edges


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _state(pairs: DataFrame) -> tuple:
    """Number of the edges (a, b), a sum of their hashes, and how many edges the most frequent b has."""
    by_b = pairs.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    return tuple(by_b.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())


def _with_least(pairs: DataFrame, heavy: int) -> DataFrame:
    """Edges (a, b) with m, the least of a and of all that a meets: by a window over a, one shuffle.

    A node of many edges would be one task's work there. With ``heavy``, nodes of more edges than that are summed in two steps and broadcast
    instead; there are at most 2 * edges / heavy <= 40,000 of them by its choice.
    """
    least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
    if not heavy:
        return pairs.withColumn("m", least)
    many = F.broadcast(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).where(F.col("degree") > heavy).select("a", F.least("m", "a").alias("m")))
    return pairs.join(many, "a").unionByName(pairs.join(many, "a", "left_anti").withColumn("m", least))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (a, b): root is the smallest node of its component. Nodes without an edge are left out."""
    jvm = edges.sparkSession.sparkContext._jvm
    pairs = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(pairs)
    while True:
        heavy = max(HEAVY_NODE, before[0] // 20_000)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, heavy if before[2] > heavy else 0).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _with_least(large, 0)
        pairs = checkpointed(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        state = _state(pairs)
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        jvm.System.gc()  # shuffle files of a round go only when the driver finds that nothing refers to them


def _arrow(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _texts(column: pa.Array, step: int = 500) -> Iterator[tuple[int, list[str]]]:
    for a in range(0, len(column), step):
        yield a, [t or "" for t in column.slice(a, step).to_pylist()]


def class_hashes(documents: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n, h1, h2, outline): the size of each document's set, its class and its outline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, texts in _texts(batch.column(1)):
                got = [(len(s), *set_hashes(s), outline(s)) for _, s in token_sets(texts, words)]
                yield _arrow([ids.slice(a, len(texts)), *zip(*got)], [*[pa.int64()] * 4, pa.binary()], ["doc_id", "n", "h1", "h2", "outline"])

    return documents.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, outline binary")


def _signature_rows(documents: DataFrame, allocation: dict, largest: int, text: str, words: int, percent: int) -> DataFrame:
    """(sig, cls, n) for every class, written once in each task that meets it."""
    starts = band_starts(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        names: list[int] = []

        def flush() -> pa.RecordBatch:
            owner, sig = signatures(held, allocation, starts, percent)
            size = np.array([len(s) for s in held], np.int32)
            batch = _arrow([sig.view(np.int64), np.array(names, np.int64)[owner], size[owner]], [pa.int64(), pa.int64(), pa.int32()], ["sig", "cls", "n"])
            held.clear(), names.clear()
            return batch

        total = 0
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                for _, s in token_sets(texts, words):
                    cls = set_hashes(s)[0] if len(s) else 0
                    if len(s) and cls not in seen:
                        seen.add(cls)
                        held.append(s), names.append(cls)
                        total += len(s)
                        if total > 1 << 18:
                            yield flush()
                            total = 0
        if held:
            yield flush()

    return documents.where(F.col("doc_id").isNotNull()).select(text).mapInArrow(run, "sig long, cls long, n int")


def _set_rows(documents: DataFrame, text: str, words: int) -> DataFrame:
    """(cls, tokens) of documents, once a task and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in _texts(batch.column(0), 200):
                rows = []
                for _, s in token_sets(texts, words):
                    cls = set_hashes(s)[0] if len(s) else 0
                    if len(s) and cls not in seen:
                        seen.add(cls)
                        rows.append((cls, s.tobytes()))
                if rows:
                    yield _arrow(list(zip(*rows)), [pa.int64(), pa.binary()], ["cls", "tokens"])

    return documents.select(text).mapInArrow(run, "cls long, tokens binary")


def _by_key(run_group, names: list[str], types: list):
    """A mapInArrow function over rows sorted by their first column: ``run_group(rows)`` gives the output rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    out += run_group(held) if len(held) > 1 else []
                    key, held = row[0], []
                held.append(row)
            if out:
                yield _arrow(list(zip(*out)), types, names)
                out = []
        out += run_group(held) if len(held) > 1 else []
        if out:
            yield _arrow(list(zip(*out)), types, names)

    return run


def _refined(units: DataFrame, percent: int) -> DataFrame:
    """(sub, first, cls, n, members) from (unit, side, cls, n, outline): the groups of a unit that outlines leave, named by their members."""

    def refine(rows: list[tuple]) -> list[tuple]:
        _, side, names, sizes, outlines = zip(*{r[2]: r for r in rows}.values())
        out = []
        for members in survivors(list(outlines), np.array(sizes, np.int64), np.array(side), percent):
            cls = sorted(names[k] for k in members)
            sub = set_hashes(np.array(cls, np.int64).view(np.uint64))[0]
            out += [(sub, cls[0], names[k], sizes[k], len(cls)) for k in members]
        return out

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return units.mapInArrow(_by_key(refine, ["sub", "first", "cls", "n", "members"], types), "sub long, first long, cls long, n int, members int")


def _forest_rows(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b) class edges from (place, cls, side, subs, tokens), a place being a part of a cluster; without subs, all its pairs are compared."""

    def link(rows: list[tuple]) -> list[tuple]:
        rows = list({r[1]: r for r in rows}.values())
        names, sets, subs, out = [r[1] for r in rows], [np.frombuffer(r[4], np.uint64) for r in rows], {}, []
        if rows[0][3] is None:
            return [(names[p], names[q]) for p, q in spanning_links(sets, np.array([r[2] for r in rows]), percent)] if len(rows) > 1 else []
        for k, r in enumerate(rows):
            for sub in r[3]:
                subs.setdefault(sub, []).append(k)
        group = np.arange(len(names))
        # The largest first: what they link need not be looked at again in the others.
        for members in sorted(subs.values(), key=len, reverse=True):
            index = np.array(members)
            if (group[index] != group[index[0]]).any():
                for p, q in forest([sets[k] for k in members], group[index].copy(), percent):
                    out.append((names[members[p]], names[members[q]]))
                    group[group == group[members[q]]] = group[members[p]]
        return out

    return dealt.mapInArrow(_by_key(link, ["a", "b"], [pa.int64()] * 2), "a long, b long")


def _classes(documents: DataFrame, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """Each document's class (see ``class_hashes``), and the classes of non-empty sets with their smallest id and number of documents."""
    small_batches(documents.sparkSession)
    hashed = checkpointed(class_hashes(documents, text, words))
    grouped = hashed.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("outline").alias("outline"))
    return hashed, checkpointed(grouped)


def _units(documents: DataFrame, classes: DataFrame, text: str, words: int, percent: int, larger: int = 1) -> DataFrame:
    """(unit, side, cls, n, outline): classes that share a signature meet in a unit, or in one for each pair of blocks, ``larger`` times the usual ones, of a large bucket."""
    # One number for each size of set that occurs: the input of the cost model.
    sizes = {r["n"]: r["c"] for r in classes.groupBy("n").agg(F.count("*").alias("c")).collect()}
    largest = max(sizes, default=0)
    rows = _signature_rows(documents, allocate(largest, sizes, percent), largest, text, words, percent)

    # Buckets of at least two classes; those with the same members count once.
    by_sig = Window.partitionBy("sig")
    met = rows.select("cls", "n", F.min("cls").over(by_sig).alias("_least"), F.max("cls").over(by_sig).alias("_most"), F.sum(F.shiftrightunsigned(F.xxhash64("cls"), 32)).over(by_sig).alias("_all"), F.count("*").over(by_sig).alias("_count"))
    buckets = met.where("_least <> _most").select(F.xxhash64("_all", "_count", "_least", "_most").alias("bucket"), "cls", "n").distinct()
    per = Window.partitionBy("bucket")
    blocks_of = F.ceil(F.greatest(F.count("*").over(per) / (BLOCK_SETS * larger), F.sum("n").over(per) / (BLOCK_TOKENS * larger))).cast("int")
    units = buckets.select("bucket", "cls", "n", blocks_of.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    units = units.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "_with"), F.greatest("block", "_with")
    units = units.select(F.xxhash64("bucket", i, j).alias("unit"), (F.col("block") != i).cast("int").alias("side"), "cls", "n")
    outlines = classes.select(F.col("h1").alias("cls"), "outline").dropDuplicates(["cls"])
    return units.join(outlines, "cls").select("unit", "side", "cls", "n", "outline")


def candidate_pairs(outlines: list[bytes], sizes: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """The pairs whose sizes and outlines allow a link; where both sides 0 and 1 occur, those across."""
    n, bins = len(outlines), min(map(len, outlines))
    counts = np.stack([np.frombuffer(o, np.uint8).reshape(-1, bins).sum(axis=0, dtype=np.int32) for o in outlines])
    across, out = side.min() != side.max(), []
    for p in np.flatnonzero(side == 0) if across else range(n - 1):
        other = (side == 1) if across else (np.arange(n) > p)
        others = np.flatnonzero(other & (100 * sizes >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes))
        apart = np.abs(counts[others] - counts[p]).sum(axis=1)
        out += [(int(p), int(q)) for q in others[apart * (100 + percent) <= (sizes[others] + sizes[p]) * (100 - percent)]]
    return out


def link_pairs(documents: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b, n_a, n_b, shared): every link between different sets, a < b being the smallest ids of documents with these sets.

    All links of the join, where ``link_components`` needs a spanning forest only: candidates are the same, each pair is verified exactly, once.
    Documents with equal sets are in ``class_members``; their pairs are not written out. The result is as large as the number of links.
    """
    _, classes = _classes(documents, text, words)
    units = _units(documents, classes, text, words, percent)

    def meet(rows: list[tuple]) -> list[tuple]:
        _, side, names, sizes, outlines = zip(*{r[2]: r for r in rows}.values())
        return [tuple(sorted((names[p], names[q]))) for p, q in candidate_pairs(list(outlines), np.array(sizes, np.int64), np.array(side), percent)]

    met = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_key(meet, ["a", "b"], [pa.int64()] * 2), "a long, b long")
    pairs = checkpointed(met.distinct())
    needed = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "h1")
    ids = classes.join(needed, "h1", "left_semi").select(F.col("rep").alias("doc_id"))
    sets = _set_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id", "left_semi"), "text", words)
    sets = checkpointed(sets.groupBy("cls").agg(F.first("tokens").alias("tokens")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * shared >= percent * (len(s) + len(t) - shared):
                    out.append((a, b, len(s), len(t), shared))
            if out:
                yield _arrow(list(zip(*out)), [pa.int64()] * 5, ["a", "b", "n_a", "n_b", "shared"])

    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    found = both.mapInArrow(verify, "a long, b long, n_a long, n_b long, shared long")
    names = classes.select(F.col("h1").alias("_h"), "rep")
    found = found.join(names.select(F.col("_h").alias("a"), F.col("rep").alias("_ra")), "a").join(names.select(F.col("_h").alias("b"), F.col("rep").alias("_rb")), "b")
    turned = F.col("_ra") > F.col("_rb")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return found.select(pick("_ra", "_rb").alias("a"), pick("_rb", "_ra").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "shared")


def class_members(documents: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, copies): the smallest id among documents with an equal set, and how many there are; a row for each document with a set."""
    hashed, classes = _classes(documents, text, words)
    return hashed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2").join(classes.select("h1", "h2", F.col("rep").alias("class_id"), "copies"), ["h1", "h2"]).select("doc_id", "class_id", "copies")


def link_components(documents: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (which need doc_id and the text)."""
    hashed, classes = _classes(documents, text, words)
    units = _units(documents, classes, text, words, percent, OUTLINE_BLOCKS)
    subs = checkpointed(_refined(units.repartition("unit").sortWithinPartitions("unit"), percent).distinct())

    needed = checkpointed(classes.join(subs.select(F.col("cls").alias("h1")).distinct(), "h1", "left_semi").select(F.col("rep").alias("doc_id")))
    hint = F.broadcast if needed.count() <= BROADCAST_IDS else (lambda df: df)
    sets = _set_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(hint(needed), "doc_id", "left_semi"), "text", words)

    # Groups that share classes form clusters. A part of a cluster is a task's work. Near copies share many groups: where these hold more pairs
    # than the cluster, all its pairs are compared, each once, in pairs of blocks. Elsewhere a part holds some groups, each of its sets once.
    clusters = components(subs.select(F.col("cls").alias("a"), F.col("first").alias("b")))
    placed = checkpointed(subs.join(clusters, F.col("cls") == F.col("node")).select(F.col("root").alias("cluster"), "sub", "cls", "n", "members"))
    load = placed.groupBy("cluster", "cls").agg(F.first("n").alias("n"), F.sum("n").alias("m"), F.sum("members").alias("met")).groupBy("cluster")
    load = load.agg(F.count("*").alias("sets"), F.sum("n").alias("once"), F.sum("m").alias("all"), F.sum("met").alias("pairs"))
    blocks_of = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("once") / BLOCK_TOKENS)).cast("int")
    parts_of = F.when(F.col("once") > CLUSTER_TOKENS, F.ceil(F.col("all") / CLUSTER_TOKENS)).otherwise(1).cast("int")
    load = load.select("cluster", F.when(F.col("pairs") >= F.col("sets") * F.col("sets"), blocks_of).alias("blocks"), parts_of.alias("parts"))
    # Most clusters are one block. Only the others are joined, so that a large cluster is not dealt by its number alone.
    load = checkpointed(load.where("blocks IS NULL OR blocks > 1").withColumn("_sparse", F.col("blocks").isNull()))
    hint = F.broadcast if load.count() <= BROADCAST_ROWS else (lambda df: df)
    placed = placed.join(hint(load), "cluster", "left")
    dense = placed.where("_sparse IS NULL OR NOT _sparse").select("cluster", "cls", F.coalesce("blocks", F.lit(1)).alias("blocks")).distinct()
    dense = dense.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "_with"), F.greatest("block", "_with")
    dense = dense.select(F.xxhash64("cluster", i, j).alias("place"), "cls", (F.col("block") != i).cast("int").alias("side"), F.lit(None).cast("array<long>").alias("subs"))
    sparse = placed.where("_sparse").withColumn("place", F.xxhash64("cluster", F.pmod(F.xxhash64("sub"), F.col("parts"))))
    sparse = sparse.groupBy("place", "cls").agg(F.collect_set("sub").alias("subs")).select("place", "cls", F.lit(0).alias("side"), "subs")
    dealt = dense.unionByName(sparse).join(sets, "cls").select("place", "cls", "side", "subs", "tokens")
    found = components(_forest_rows(dealt.repartition("place").sortWithinPartitions("place"), percent))

    # The smallest id of each component, then of each class that stands alone with its copies.
    root = classes.join(found, F.col("h1") == F.col("node"), "left").select("h1", "h2", "rep", "copies", F.coalesce("root", "h1").alias("_root"), F.col("root").isNotNull().alias("_linked"))
    smallest = root.where("_linked").groupBy("_root").agg(F.min("rep").alias("_component"))
    named = root.where("_linked OR copies > 1").join(smallest, "_root", "left").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.when(F.col("_linked"), F.col("_component")).otherwise(F.col("rep")).alias("component"))
    named = checkpointed(named)
    salted = hashed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    if named.count() <= BROADCAST_ROWS:
        joined = salted.join(F.broadcast(named), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") > 0), "left")
    else:  # a class with a third of all rows is spread over the salts
        copies = named.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("_salt") == F.col("_of")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that are the first, by id, of their component; of rows that are alike in id and text one stays.

    Only ids that go, or that occur more than once, are joined to the texts.
    """
    found = checkpointed(link_components(documents, text, words, percent))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    gone = checkpointed(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = documents.join(small(gone), "doc_id", "left_anti")
    twice = checkpointed(found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if twice.isEmpty():
        return kept
    again = kept.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", text])
    return kept.join(small(twice), "doc_id", "left_anti").unionByName(again)
