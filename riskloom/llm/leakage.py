"""Evaluation items that stand in training texts: a generalised suffix automaton streamed over the corpus."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise
from .textnorm import word_places, words


class Automaton:
    """Generalised suffix automaton of word sequences.

    The places where a state's strings end are those of its subtree in the link tree, so with the states in
    depth-first order each state's places are one slice of a single array: every place is stored once.
    """

    def __init__(self, items: list[tuple[object, list[str]]], run: int):
        self.run = run
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(ws) for _, ws in items], np.int64)
        self.code: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        twice = []  # items that hold one stretch of ``run`` words twice: a text's word can stand for two of theirs
        for n, (_, ws) in enumerate(items):
            last = 0
            for at, w in enumerate(ws):
                last = self._extend(last, self.code.setdefault(w, len(self.code)), own)
                own[last].append((n, at))
            twice.append(len({tuple(ws[i : i + run]) for i in range(len(ws) - run + 1)}) < max(0, len(ws) - run + 1))
        self.twice = np.array(twice, bool)
        below: list[list[int]] = [[] for _ in self.link]
        for v in range(1, len(self.link)):
            below[self.link[v]].append(v)
        self.lo, self.hi = np.zeros(len(self.link), np.int64), np.zeros(len(self.link), np.int64)
        flat: list[tuple[int, int]] = []
        stack = [(0, False)]
        while stack:
            v, done = stack.pop()
            if done:
                self.hi[v] = len(flat)
                continue
            self.lo[v] = len(flat)
            flat += own[v]
            stack.append((v, True))
            stack += [(u, False) for u in below[v]]
        self.lo, self.hi = self.lo.tolist(), self.hi.tolist()
        self.items_, self.ats_ = [i for i, _ in flat], [at for _, at in flat]
        self.end_item, self.end_at = np.array(self.items_, np.int64), np.array(self.ats_, np.int64)

    def _extend(self, last: int, c: int, own: list) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q, own)
        cur = self._state(length[last] + 1, own)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, own)
        return cur

    def _state(self, length: int, own: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        own.append([])
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int, own: list) -> int:
        new = self._state(self.len[p] + 1, own)
        self.next[new] = dict(self.next[q])
        self.link[new], self.link[q] = self.link[q], new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def covered(self, text: list[str], coverage: float = 0.0, spots: dict[int, set[int]] | None = None) -> dict[int, set[int]]:
        """For every item the places of its words inside stretches of ``run`` words or more that ``text`` holds too.

        Items that can't reach ``coverage`` of their words may be left out: the stretches have too few words in
        all. ``spots`` gets the places in the text for each item.
        """
        run, code = self.run, self.code
        ids = np.fromiter((code.get(w, -1) for w in text), np.int64, len(text))
        if len(ids) < run:
            return {}
        unknown = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
        hits: list[tuple[int, int, int]] = []
        for k in np.flatnonzero(np.diff(unknown) > run):  # stretches of known words, the only ones that can match
            self._stream(int(unknown[k]) + 1, ids[unknown[k] + 1 : unknown[k + 1]].tolist(), hits)
        out: dict[int, set[int]] = {}
        if not hits:
            return out
        total = sum(run if m == run else 1 for _, _, m in hits)  # words of the text in stretches, at most
        may = self.twice | (self.sizes * coverage <= total)
        link, length, lo, hi = self.link, self.len, self.lo, self.hi
        for t, v, size in hits:
            # each item by its own longest match: those of this state by the whole match, the rest up the links by less
            ranges = [(lo[v], hi[v])]
            while v > 0 and size >= run:
                for a, b in ranges:
                    if b - a <= 32:  # few places: lists are quicker than arrays
                        places = [(i, at) for i, at in zip(self.items_[a:b], self.ats_[a:b]) if may[i]]
                    else:
                        some = self.end_item[a:b]
                        keep = np.flatnonzero(may[some])
                        places = zip(some[keep].tolist(), self.end_at[a:b][keep].tolist())
                    for item, at in places:
                        # longer matches were marked word by word on the way
                        out.setdefault(item, set()).update((at,) if size > run else range(at - run + 1, at + 1))
                        if spots is not None:
                            spots.setdefault(item, set()).update((t,) if size > run else range(t - run + 1, t + 1))
                u = link[v]
                ranges = [(lo[u], lo[v]), (hi[v], hi[u])]  # what ends here besides the longer match
                v = u
                size = length[v] if v > 0 else 0
        return out

    def _stream(self, start: int, ids: list[int], hits: list[tuple[int, int, int]]) -> None:
        """(place, state, length of the longest match) wherever ``run`` words or more match."""
        nxt, link, length, run = self.next, self.link, self.len, self.run
        state = matched = 0
        for t, c in enumerate(ids, start):
            while c not in nxt[state] and state:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
                if matched >= run:
                    hits.append((t, state, matched))


def _need(sizes: np.ndarray, coverage: float) -> list[int]:
    return [max(1, -(-int(n * coverage * 1_000_000) // 1_000_000)) for n in sizes.tolist()]


def _items(items: DataFrame, item_id: str, item_text: str, block_words: int):
    """The items in blocks of at most ``block_words`` words (or one item); one block at a time is in the driver."""
    rows = items.select(item_id, item_text).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct().orderBy(item_id, item_text)
    block, held = [], 0
    for row in rows.toLocalIterator():
        ws = words(row[1])
        if block and held + len(ws) > block_words:
            yield block
            block, held = [], 0
        block.append((row[0], ws))
        held += len(ws)
    if block:
        yield block


def _marks(block, run: int) -> np.ndarray:
    """Hashes of all stretches of ``run`` words of some items."""
    return np.unique(np.fromiter((hash_words(ws[i : i + run]) for _, ws in block for i in range(len(ws) - run + 1)), np.uint64))


def hash_words(ws: list[str]) -> int:
    return int.from_bytes(blake2b("\x1f".join(ws).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _per_block(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int, block_words: int, schema: str, names: list[str], types: list, each):
    """Rows of ``each(automaton, words, document text or None)`` for all documents and all blocks of items.

    One block (the usual case) is streamed over the corpus directly. With more, the corpus is read and normalised
    once, with only the hashes of the items' stretches: what holds one of them is written, and each block streams
    over that part. A block's automaton is destroyed before the next is built.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id), F.col(text)).where(F.col(doc_id).isNotNull() & (F.length(text) > 0))
    blocks = _items(items, item_id, item_text, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)

    def scan(rows, block):
        shared = spark.sparkContext.broadcast(Automaton(block, run))

        def run_block(batches):
            a = shared.value
            for batch in batches:
                cols: list[list] = [[] for _ in names]
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    t = t.as_py()
                    for row in each(a, words(t), t):
                        for c, x in zip(cols, (d, *row)):
                            c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.field(0).type, *types])], names=names)

        return rows.mapInArrow(run_block, schema), shared

    if second is None:
        return scan(slim, first)[0]
    known = [_marks(first, run), _marks(second, run)]
    for block in blocks:
        known.append(_marks(block, run))
    marks = spark.sparkContext.broadcast(np.unique(np.concatenate(known)))

    def touched(batches):
        some = marks.value
        for batch in batches:
            keep = []
            for i, t in enumerate(batch.column(1)):
                ws = words(t.as_py())
                mine = np.fromiter((hash_words(ws[k : k + run]) for k in range(len(ws) - run + 1)), np.uint64)
                if len(some) and len(mine) and (some[np.minimum(np.searchsorted(some, mine), len(some) - 1)] == mine).any():
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    part = materialise(slim.mapInArrow(touched, slim.schema), "touched")
    marks.destroy()
    out = None
    for block in _items(items, item_id, item_text, block_words):
        rows, shared = scan(part, block)
        rows = materialise(rows, "leaks")
        shared.destroy()
        out = rows if out is None else out.unionByName(rows)
    return out


def leaked_items(
    docs: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    run: int = 6,
    coverage: float = 0.5,
    block_words: int = 200_000,
) -> DataFrame:
    """``doc_id, item_id, covered, size``: documents that hold at least ``coverage`` of an item's words.

    A word of an item counts as covered if it lies in a stretch of at least ``run`` consecutive item words that
    also stand consecutively in the document; case, accents, punctuation, layout, markup and encoding don't
    matter (``textnorm.words``). An item shorter than ``run`` words can't be covered; null and empty texts hold
    nothing; null ids are left out. Repeated documents come out for each row; the rows of an item id repeated
    with another text count as one item each. Other columns aren't read.

    The items are the bounded side: blocks of at most ``block_words`` words (or one item) make one automaton each,
    broadcast; the corpus is read once, map-only, nothing is shuffled. See ``_per_block``.
    """
    kinds = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, covered int, size int"

    def each(a, ws, _):
        need = _need(a.sizes, coverage)
        for item, marks in a.covered(ws, coverage).items():
            if len(marks) >= need[item]:
                yield a.ids[item], len(marks), int(a.sizes[item])

    return _per_block(docs, doc_id, text, items, item_id, item_text, run, block_words, schema, ["doc_id", "item_id", "covered", "size"], [to_arrow_type(kinds[1]), pa.int32(), pa.int32()], each)


def leak_spans(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 6, coverage: float = 0.5, longest: int = 50, block_words: int = 200_000
) -> DataFrame:
    """``doc_id, item_id, start, stop, n_words, covered, size``: where items stand in the texts.

    A stretch of at least ``run`` words that stands in an item too is a span if the text holds ``coverage`` of that
    item's words in all, or if the stretch has ``longest`` words or more. ``start`` and ``stop`` are characters of
    the text as it is, markup and broken encodings included. Other columns aren't read; see ``leaked_items``.
    """
    kinds = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, start int, stop int, n_words int, covered int, size int"

    def each(a, ws, t):
        need, spots, places = _need(a.sizes, coverage), {}, None
        for item, marks in a.covered(ws, 0.0, spots).items():
            where = np.array(sorted(spots[item]))
            for part in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
                if len(marks) >= need[item] or len(part) >= longest:
                    places = word_places(t) if places is None else places
                    yield a.ids[item], places[part[0]][0], places[part[-1]][1], len(part), len(marks), int(a.sizes[item])

    names = ["doc_id", "item_id", "start", "stop", "n_words", "covered", "size"]
    return _per_block(docs, doc_id, text, items, item_id, item_text, run, block_words, schema, names, [to_arrow_type(kinds[1]), *[pa.int32()] * 5], each)


def remove_leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 6, coverage: float = 0.5, longest: int = 50, block_words: int = 200_000
) -> DataFrame:
    """``doc_id, text, removed``: every document with the spans of ``leak_spans`` cut out of its text.

    ``removed`` is the number of characters taken out, 0 for a text without spans, which comes back as it is (null
    and empty texts too). Spans that touch or overlap are cut once. ``doc_id`` must be unique; rows with a null id are
    left out. The spans of the few documents that have some are joined to the texts by id; Spark broadcasts them
    while they are small.
    """
    spans = leak_spans(docs, doc_id, text, items, item_id, item_text, run, coverage, longest, block_words)
    per = spans.groupBy(F.col("doc_id").alias("__d")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__s"))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(per, F.col("doc_id") == F.col("__d"), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def cut(a, s):
        more = F.when(s["start"] > a["at"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])).otherwise("")
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.concat(a["kept"], more).alias("kept"))

    end = lambda a: F.concat(a["kept"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    clean = F.when(F.col("__s").isNull(), F.col("text")).otherwise(F.aggregate("__s", zero, cut, end))
    out = rows.select("doc_id", clean.alias("clean"), F.length("text").alias("n"))
    return out.select("doc_id", F.col("clean").alias("text"), F.coalesce(F.col("n") - F.length("clean"), F.lit(0)).alias("removed"))
