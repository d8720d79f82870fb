"""Frequent ordered patterns of steps, gaps allowed, over many sequences.

Two-phase partition mining. A pattern that reaches a share of all sequences reaches it in at least one chunk of
any division of them, so every chunk is mined on its own at the proportional local support, the findings are
united, and the united candidates are counted exactly over every sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

PATTERN = "pattern array<string>, n bigint"


def least_count(share: float, total: int, floor: int = 1) -> int:
    """The smallest whole count that is at least ``share`` of ``total`` and at least ``floor``."""
    return max(floor, math.ceil(Fraction(str(share)) * total))


class Chunk:
    """Some sequences as one flat array of step numbers."""

    def __init__(self, arrays: list[pa.Array]):
        lists = pa.concat_arrays(arrays) if len(arrays) > 1 else arrays[0]
        lists = lists.drop_null()
        enc = lists.flatten().dictionary_encode()
        codes = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lens = np.asarray(lists.value_lengths(), dtype=np.int64)
        seq = np.repeat(np.arange(len(lens)), lens)
        keep = codes >= 0
        self.names = enc.dictionary.to_pylist()
        self._load(codes[keep], seq[keep])

    def _load(self, codes: np.ndarray, seq: np.ndarray) -> None:
        self.codes, self.seq, n = codes, seq, len(codes)
        ends = np.searchsorted(seq, seq, side="right") if n else np.zeros(0, np.int64)
        self.end = ends  # one past the last position of each position's own sequence
        order = np.lexsort((np.arange(n), codes, seq))
        self.before = np.full(n, -1, np.int64)  # the previous place of the same step in the same sequence
        if n:
            a, b = order[:-1], order[1:]
            same = (codes[a] == codes[b]) & (seq[a] == seq[b])
            self.before[b[same]] = a[same]

    def only(self, steps: np.ndarray) -> None:
        """Drop all steps but these."""
        keep = np.isin(self.codes, steps)
        self._load(self.codes[keep], self.seq[keep])

    def keep(self, names: set[str]) -> None:
        """Drop all steps but those of these names."""
        self.only(np.array([i for i, s in enumerate(self.names) if s in names], np.int64))

    def copy(self) -> Chunk:
        out = object.__new__(Chunk)
        out.names, out.codes, out.seq, out.end, out.before = self.names, self.codes, self.seq, self.end, self.before
        return out

    def matrix(self, pairs: set[tuple[str, str]] | None) -> np.ndarray | None:
        """Which step may come after which, by number; None if nothing is known."""
        if pairs is None:
            return None
        code = {s: i for i, s in enumerate(self.names)}
        out = np.zeros((len(code), len(code)), bool)
        for a, b in pairs:
            if a in code and b in code:
                out[code[a], code[b]] = True
        return out

    def firsts(self) -> np.ndarray:
        """The first place of every step in every sequence."""
        return np.flatnonzero(self.before < 0)

    def after(self, places: np.ndarray) -> np.ndarray:
        """For sequences matched up to ``places``: the first place of every later step."""
        size = self.end[places] - places - 1
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.int64)
        start = np.repeat(places + 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        at = start + np.arange(total)
        return at[self.before[at] <= np.repeat(places, size)]


def _split(at: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(codes, kind="stable")
    at, codes = at[order], codes[order]
    cuts = np.flatnonzero(np.diff(codes)) + 1
    for part in np.split(np.arange(len(codes)), cuts) if len(codes) else []:
        yield int(codes[part[0]]), at[part]


def mine(chunk: Chunk, least: int, min_len: int, max_len: int, distinct: bool, follows: np.ndarray | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """All patterns of ``min_len..max_len`` steps in at least ``least`` of the chunk's sequences.

    With ``follows`` only patterns whose every step may come after every step before it.
    """
    width = len(chunk.names)
    first = chunk.firsts()
    counts = np.bincount(chunk.codes[first], minlength=width)
    chunk.only(np.flatnonzero(counts >= least))
    stack = [((), chunk.firsts())]
    while stack:
        prefix, at = stack.pop()
        codes = chunk.codes[at]
        counts = np.bincount(codes, minlength=width)
        counts[counts < least] = 0
        if distinct and prefix:
            counts[list(prefix)] = 0
        if follows is not None:
            for c in prefix:
                counts[~follows[c]] = 0
        size = len(prefix) + 1
        if size >= min_len:
            for c in np.flatnonzero(counts):
                yield (*prefix, int(c)), int(counts[c])
        if size < max_len:
            keep = counts[codes] > 0
            for c, places in _split(at[keep], codes[keep]):
                stack.append(((*prefix, c), chunk.after(places)))


def count(chunk: Chunk, patterns: list[tuple[str, ...]]) -> Iterator[tuple[int, int]]:
    """(number of pattern, sequences of the chunk that hold it), patterns found nowhere left out."""
    code = {s: i for i, s in enumerate(chunk.names)}
    root: dict = {}
    for i, p in enumerate(patterns):
        steps = [code.get(s) for s in p]
        if None in steps:
            continue
        node = root
        for s in steps[:-1]:
            node = node.setdefault(s, [None, {}])[1]
        node.setdefault(steps[-1], [None, {}])[0] = i
    if not root:
        return
    used, todo = set(), [root]
    while todo:
        node = todo.pop()
        used.update(node)
        todo += [child for _, child in node.values() if child]
    chunk.only(np.fromiter(used, np.int64))
    width, stack = len(chunk.names), [(root, chunk.firsts())]
    while stack:
        node, at = stack.pop()
        codes = chunk.codes[at]
        counts = np.bincount(codes, minlength=width)
        deeper = np.zeros(width, bool)
        for c, (number, child) in node.items():
            if counts[c] and number is not None:
                yield number, int(counts[c])
            deeper[c] = bool(child) and counts[c] > 0
        keep = deeper[codes]
        for c, places in _split(at[keep], codes[keep]):
            stack.append((node[c][1], chunk.after(places)))


def _chunks(batches, rows: int, steps: int) -> Iterator[Chunk]:
    """Chunks of at least ``rows`` sequences (or ``steps`` steps), but for what a partition has less."""
    held: list[pa.Array] = []
    n = m = 0
    for batch in batches:
        lists = batch.column(0)
        held.append(lists)
        n += len(lists)
        m += len(lists.flatten())
        if n >= 2 * rows or m >= 2 * steps:
            whole = pa.concat_arrays(held)
            yield Chunk([whole.slice(0, n // 2)])
            held, n = [whole.slice(n // 2)], n - n // 2
            m = len(held[0].flatten())
    if held and n:
        yield Chunk(held)


LOCAL = 32  # the local support a chunk should have at least: below it chance patterns of single sequences get in
FEW_STEPS = 2_000  # up to so many frequent steps all their ordered pairs are counted before longer patterns are mined


def _frequent(spark, lists: DataFrame, least: int, most: int, size: int, known, rows: int, steps: int):
    """The frequent patterns of ``size`` (1 or 2) steps, exactly, as a list, or None if there are more than ``most``."""
    given = None if known is None else spark.sparkContext.broadcast(known)

    def local(batches):
        for chunk in _chunks(batches, rows, steps):
            if given is not None:
                chunk.keep(given.value)
            yield from _pages(((chunk.names[c] for c in p), n) for p, n in mine(chunk, 1, size, size, False))

    found = lists.mapInArrow(local, PATTERN).groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = [tuple(r[0]) for r in found.select("pattern").limit(most + 1).collect()]
    if given is not None:
        given.destroy()
    return got if len(got) <= most else None


def frequent_subsequences(
    seqs: DataFrame,
    seq: str,
    share: float,
    floor: int = 1,
    min_len: int = 1,
    max_len: int = 4,
    distinct: bool = True,
    chunk_rows: int = 20_000,
    chunk_steps: int = 400_000,
    block: int = 100_000,
    blocks_at_once: int = 10,
    most_steps: int = 1_000_000,
) -> DataFrame:
    """``pattern array<string>, support bigint``: the ordered patterns, gaps allowed, of many sequences.

    A pattern has ``min_len..max_len`` steps (all different if ``distinct``) and is held by at least ``share`` of
    all rows of ``seqs`` and at least ``floor`` of them. One row is one entity: a null or empty list is a
    sequence without steps and counts among all rows, null steps are skipped, and a pattern that fits a sequence
    in several ways counts once. Repeated rows are different entities. An empty table gives no patterns. Only
    ``seq`` is read, other columns don't matter.

    Before phase one the frequent single steps are counted, and where they are few their ordered pairs: no
    frequent pattern holds any other, so a chunk grows its patterns inside them only. Small partitions are put
    together and chunks are made so large that the proportional local support is ``LOCAL`` or more; where
    ``chunk_steps`` (what a task holds) doesn't allow that, or ``floor`` is less than a chunk's share, the counted
    steps and pairs keep chance patterns out. All of this only spares candidates; the count of phase two decides.

    Candidates are counted over every sequence in blocks of ``block`` patterns, ``blocks_at_once`` blocks to a pass
    over the sequences. Driver and tasks hold no more than one pass's patterns: what a pass was sent is destroyed
    before the next is read.
    """
    spark = seqs.sparkSession
    none = spark.createDataFrame([], "pattern array<string>, support bigint")
    lists = seqs.select(F.col(seq).alias("seq"))
    total = lists.count()
    least = least_count(share, total, floor)
    if not total or least > total:
        return none
    local = Fraction(least, total)
    lists = lists.where(F.size("seq") >= max(1, min_len))
    enough = math.ceil(LOCAL / local)
    rows = max(chunk_rows, enough)
    lists = lists.coalesce(max(1, total // (4 * enough)))  # joins small partitions where they lie, no shuffle; never makes more

    steps = _frequent(spark, lists, least, most_steps, 1, None, chunk_rows, chunk_steps)
    singles = None if steps is None else {p[0] for p in steps}
    if singles is not None and not singles:
        return none
    pairs = None
    if singles is not None and len(singles) <= FEW_STEPS and max_len > 2:
        two = _frequent(spark, lists, least, FEW_STEPS**2, 2, singles, chunk_rows, chunk_steps)
        pairs = None if two is None else set(two)
    hints = spark.sparkContext.broadcast((singles, pairs))

    def phase_one(batches):
        wanted, together = hints.value
        for chunk in _chunks(batches, rows, chunk_steps):
            here = len(np.unique(chunk.seq)) if len(chunk.seq) else 0
            if not here:
                continue
            if wanted is not None:
                chunk.keep(wanted)
            # sequences without steps can't hold a pattern, so the share is taken of those that have some
            found = mine(chunk, max(1, math.ceil(local * here)), min_len, max_len, distinct, chunk.matrix(together))
            yield from _pages(((chunk.names[c] for c in p), n) for p, n in found)

    mined = lists.mapInArrow(phase_one, PATTERN).groupBy("pattern").agg(F.lit(0).alias("block"))
    candidates = materialise(mined, "candidates")
    passes = -(-candidates.count() // (block * blocks_at_once))
    part = F.pmod(F.xxhash64("pattern"), F.lit(passes))
    out = None
    for b in range(passes):
        patterns = sorted(tuple(r[0]) for r in (candidates.where(part == b) if passes > 1 else candidates).select("pattern").collect())
        shared = spark.sparkContext.broadcast([patterns[i : i + block] for i in range(0, len(patterns), block)])
        del patterns

        def phase_two(batches, shared=shared):
            for chunk in _chunks(batches, chunk_rows, chunk_steps):
                for some in shared.value:
                    yield from _pages((some[i], n) for i, n in count(chunk.copy(), some))

        counted = lists.mapInArrow(phase_two, PATTERN).groupBy("pattern").agg(F.sum("n").alias("support"))
        counted = counted.where(F.col("support") >= least)
        if passes > 1:
            counted = materialise(counted, "counted")
            shared.destroy()
        out = counted if out is None else out.unionByName(counted)
    return none if out is None else out


def _pages(found, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    patterns: list[list[str]] = []
    counts: list[int] = []
    kinds = [pa.list_(pa.string()), pa.int64()]
    for p, n in found:
        patterns.append(list(p))
        counts.append(n)
        if len(counts) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(patterns, kinds[0]), pa.array(counts, kinds[1])], names=["pattern", "n"])
            patterns, counts = [], []
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(patterns, kinds[0]), pa.array(counts, kinds[1])], names=["pattern", "n"])
