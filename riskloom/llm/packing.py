"""Filling containers of fixed capacity: vector bin packing under three limits at once."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # splits text before merging; a fixed value
_loaded: dict = {}
EVEN = 0.5


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


@dataclass(frozen=True)
class Limits:
    """What one container holds: tokens, segments (items or pieces of items) and loss-bearing tokens."""

    tokens: int = 2_048
    segments: int = 64
    loss: int = 2_048


def token_sizes(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, n_head``: tokens of the whole text and of its head, which bears no loss.

    The head is the first line of a text of several lines (its title, subject or instruction); a text of one line
    bears loss as a whole. A null text has no tokens. Map-only, whole texts, in Arrow batches. ``tokenizer`` is the
    path of a rank file that every executor can read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes, heads = [], []
            for t in texts:
                line, end, rest = t.partition("\n")
                n = len(enc.encode_ordinary(t))
                sizes.append(n)
                heads.append(min(n, len(enc.encode_ordinary(line + end))) if rest else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(heads, pa.int64())], names=[doc_id, "n_tokens", "n_head"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens bigint, n_head bigint")


def place(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of each item (rows of ``sizes``, one column per limit), by the dot-product heuristic.

    One container is open at a time. Of the items that still fit, the one comes next whose size has the largest
    product with what is left of the container, both measured in capacities and weighted by how scarce each
    limit is for the items still unplaced, less ``EVEN`` times how far the container would then use its limits
    out of the proportion in which those items need them: so short and long items are mixed, and no limit runs
    out while another is idle. Equal items are taken in order. When nothing fits, the container is closed.
    """
    n, out, number = len(sizes), np.full(len(sizes), -1), 0
    order = np.lexsort((np.arange(n), *(-sizes[:, d] for d in range(sizes.shape[1] - 1, -1, -1))))
    share = sizes[order] / limits
    kinds, which = np.unique(-share, axis=0, return_inverse=True)  # equal items as one kind
    which = which.reshape(-1)
    stock = np.bincount(which, minlength=len(kinds))
    queue = np.argsort(which, kind="stable")
    start = np.concatenate(([0], np.cumsum(stock)[:-1]))
    kinds = -kinds
    rest = share.sum(0)
    left_items = n
    dims = range(len(limits))
    while left_items:
        left = np.ones(len(limits))
        live = np.flatnonzero(stock)
        cols = [kinds[live, d] for d in dims]
        weight = rest / max(1e-12, rest.sum())
        goal = rest / max(1e-12, rest.max())
        goal = goal / max(1e-12, goal @ weight)
        heavy = sum(cols[d] * weight[d] for d in dims)
        while len(live):
            fits = stock[live] > 0
            for d in dims:
                fits &= cols[d] <= left[d] + 1e-12
            live, cols, heavy = live[fits], [c[fits] for c in cols], heavy[fits]
            if not len(live):
                break
            used = heavy + (1 - left) @ weight
            score = sum(cols[d] * (weight[d] * left[d]) - (EVEN * weight[d]) * np.abs(cols[d] + (1 - left[d]) - used * goal[d]) for d in dims)
            k = live[np.argmax(score)]
            out[order[queue[start[k]]]] = number
            start[k] += 1
            stock[k] -= 1
            left_items -= 1
            left = left - kinds[k]
            rest = rest - kinds[k]
        number += 1
    return out


def pack(items: DataFrame, item: str, tokens: str, head: str, limits: Limits = Limits(), group_items: int = 4_000) -> DataFrame:
    """``item, piece, first_token, last_token, n_tokens, n_loss, container, place, fill``: every item in a container.

    An item longer than a container is cut into pieces of full containers and a rest, no other item is. Each
    piece is a segment and lies in exactly one container; ``fill`` is the container's share of tokens used.
    An item without tokens (or a null size) keeps its row and takes a segment. Rows with a null id are left out,
    rows with the same id are items of their own. Nothing in, nothing out. Tokens before ``head`` bear no loss.

    Items are dealt by hash into groups of about ``group_items`` pieces, packed independently: a task holds one
    group's sizes, never texts, and a group leaves at most one container part-filled for want of items. The
    number of groups follows the number of pieces, so the result differs between scales but not between runs.
    """
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(0))
    base = items.where(F.col(item).isNotNull()).select(F.col(item), size.alias("__n"), F.coalesce(F.col(head), F.lit(0)).cast("bigint").alias("__h"))
    full = min(limits.tokens, limits.loss)
    last = F.greatest(F.ceil(F.col("__n") / full) - 1, F.lit(0))
    pieces = base.select(item, "__n", "__h", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    a = F.col("piece") * full
    b = F.least(a + full, F.col("__n"))
    pieces = pieces.select(item, F.col("piece").cast("int").alias("piece"), a.alias("first_token"), b.alias("last_token"), F.greatest(b - F.greatest(a, F.col("__h")), F.lit(0)).alias("n_loss"))
    total = base.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, -(-total // group_items))
    kind = items.schema[item].dataType.simpleString()
    caps = np.array([limits.tokens, limits.segments, limits.loss], float)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([item, "piece", "first_token", "last_token"], kind="stable").reset_index(drop=True)
        n = (pdf["last_token"] - pdf["first_token"]).to_numpy()
        box = place(np.column_stack([n, np.ones(len(n)), pdf["n_loss"].to_numpy()]).astype(float), caps)
        out = pdf.drop(columns="g").assign(n_tokens=n, container=[f"{g}-{b}" for g, b in zip(pdf["g"], box)])
        out["place"] = out.groupby("container").cumcount().astype("int32")
        out["fill"] = out.groupby("container")["n_tokens"].transform("sum") / limits.tokens
        return out[[item, "piece", "first_token", "last_token", "n_tokens", "n_loss", "container", "place", "fill"]]

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(item, "piece"), F.lit(groups)))
    dealt = dealt.repartition(min(groups, 1_000 + groups // 16), "g")  # sizes are few bytes but packing them takes time: keep the tasks apart
    return dealt.groupBy("g").applyInPandas(
        fill, f"`{item}` {kind}, piece int, first_token bigint, last_token bigint, n_tokens bigint, n_loss bigint, container string, place int, fill double"
    )


def fullness(packed: DataFrame, limits: Limits) -> DataFrame:
    """One row: containers, the least number any packing needs, and the mean share of each limit that is used.

    ``least`` is the largest of the sums over the three limits, rounded up; no packing can do with fewer containers.
    Nothing packed gives one row of zeros and null shares.
    """
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("n_loss").alias("l"))
    zero = F.lit(0).cast("bigint")
    need = lambda c, cap: F.ceil(F.coalesce(F.sum(c), zero) / cap)
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.greatest(need("t", limits.tokens), need("s", limits.segments), need("l", limits.loss)).alias("least"),
        F.avg(F.col("t") / limits.tokens).alias("tokens_used"), F.avg(F.col("s") / limits.segments).alias("segments_used"), F.avg(F.col("l") / limits.loss).alias("loss_used"),
        F.count_if(F.col("t") > limits.tokens - 16).alias("bound_by_tokens"), F.count_if(F.col("s") >= limits.segments).alias("bound_by_segments"), F.count_if(F.col("l") > limits.loss - 16).alias("bound_by_loss"),
    )
