"""Variable-capacity best-fit packing of documents into training sequences.

Documents are encoded by a byte-level tokenizer, and their tokens go into sequences of several permitted lengths. A
sequence of n tokens costs OPEN + n + n * n / SQUARE: a fixed part, one for each token, and attention's square part, so
a long sequence pays off by how well it can be filled, and a short one by its price. Items are placed in decreasing order
of length, each into the open bin that it fills best. Where none has room, a bin is opened, of the length whose cost is
least for each token that the lengths still to place would fill it with (greatest first). This is done with every set of
the permitted lengths, and the set of the least total cost is taken, so the lengths are chosen jointly and no single
length packs cheaper. At the end each bin shrinks to the least permitted length that holds its contents. Items above the
greatest length are cut into pieces of that length and a rest; nothing is dropped.

Rows are dealt by a hash of their place in the staged table into shards of about SHARD items, so repeated ids and hot
sources spread evenly; each shard is packed on its own within one task's memory. Tokens are staged once and move to their
sequences after the packing, which sees lengths only.

Null and empty texts have no tokens and go where they fit; equal lengths are placed in the order of id, piece and place,
equal costs take the shorter length and the smaller set; repeated rows are items of their own; texts of any length are
encoded in whole; an empty table gives an empty result; extra columns are ignored (see pack_sequences for its own names).
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import map_texts, read, small_batches, stage

LENGTHS = (512, 1024, 2048, 4096)
OPEN, SQUARE = 32, 24_576
SHARD = 20_000
#: How a token is stored while it moves; the result has ints.
TOKEN = "<u2"
#: Runs of white space that the tokenizer's own splitting can't take.
BLANKS = re.compile(r"\s{10000}")


def cost(length: int) -> float:
    """What a sequence of a length costs."""
    return OPEN + length + length * length / SQUARE


def fill(room: int, lengths: np.ndarray, upto: np.ndarray, at: int) -> int:
    """Tokens that a room takes of lengths[at:] (decreasing and negated; upto are their sums before each), greatest first."""
    held, n = 0, len(lengths)
    while at < n and room > 0:
        at += int(np.searchsorted(lengths[at:], -room))  # the first that fits
        if at == n:
            break
        last = int(np.searchsorted(upto, upto[at] + room, "right")) - 1  # as many behind it as fit together
        took = int(upto[last] - upto[at])
        if not took:
            break  # only empty items are left
        held, room, at = held + took, room - took, last
    return held


def pack_set(items: Sequence[int], order: Sequence[int], sizes: Sequence[int], price: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, place in its bin, tokens of each bin), bins being opened with the given sizes only; items are placed in the given, decreasing order."""
    lengths = -np.array([items[i] for i in order], np.int64)
    upto = np.r_[0, np.cumsum(-lengths)]
    where, start, used = [0] * len(items), [0] * len(items), []
    rooms: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    for at, i in enumerate(order):
        n = items[i]
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            free, b = rooms.pop(k)
        else:
            free = min((c for c in sizes if c >= n), key=lambda c: (price(c) / max(1, n + fill(c - n, lengths, upto, at + 1)), c))  # noqa: B023
            b = len(used)
            used.append(0)
        where[i], start[i] = b, used[b]
        used[b] += n
        insort(rooms, (free - n, b))
    return where, start, used


def pack(items: Sequence[int], lengths: Sequence[int] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, place of each item in its bin, length of each bin), of the cheapest set of lengths; ties are placed in the order given."""
    sizes = sorted(lengths)
    order = sorted(range(len(items)), key=lambda i: -items[i])
    most, best = max(items, default=0), None
    for some in (s for k in range(1, len(sizes) + 1) for s in combinations(sizes, k) if s[-1] >= most):
        where, start, used = pack_set(items, order, some, price)
        shrunk = [next(c for c in sizes if c >= u) for u in used]
        total = sum(map(price, shrunk))
        if best is None or total < best[0]:
            best = total, where, start, shrunk
    if best is None:
        raise ValueError("an item is longer than every permitted length")
    return best[1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids of whole texts by a file of byte-level ranks, special strings as ordinary text."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > 1 << 8 * np.dtype(TOKEN).itemsize:
        raise ValueError(f"the vocabulary has more entries than {TOKEN} holds")
    found = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = regex.compile(public_tokenizers.PATTERN)

    def encode(text: str) -> list[int]:
        if BLANKS.search(text):
            return [i for w in words.findall(text) for i in found._encode_single_piece(w.encode())]
        return found.encode_ordinary(text)

    return encode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(_id, n, tokens binary (numbers of type TOKEN)) of each text; without ids, (_id, n)."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encode = encoder(tokenizer_path)

        def run(texts: list) -> dict:
            found = [encode(t) if t else [] for t in texts]
            n = pa.array(map(len, found), pa.int64())
            return {"n": n, "tokens": pa.array([np.array(f, TOKEN).tobytes() for f in found], pa.binary())} if ids else {"n": n}

        return run

    # the id goes by a name of its own, so that it can't clash with the added columns
    out = map_texts(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), make, f"_id {kind}, n long" + (", tokens binary" if ids else ""), "_text", ("_id",))
    return out


def pack_lengths(found: DataFrame, lengths: Sequence[int] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """(_id, place, piece, n_tokens, bin_id, bin_start, bin_tokens, bin_length) of a staged (_id, place, n)."""
    top = max(lengths)
    kind = found.schema["_id"].dataType.simpleString()
    parts = found.select("_id", "place", F.expr(f"posexplode(transform(sequence(0L, greatest(0L, (n - 1) div {top})), k -> least({top}L, n - k * {top})))").alias("piece", "n_tokens"))
    total = found.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("place", "piece"), F.lit(shards)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "piece", "place"], kind="stable").reset_index(drop=True)
        where, start, size = pack(rows["n_tokens"].tolist(), lengths)
        where = np.array(where)
        held = np.bincount(where, weights=rows["n_tokens"], minlength=len(size)).astype(np.int64)
        return pd.DataFrame({"_id": rows["_id"], "place": rows["place"], "piece": rows["piece"], "n_tokens": rows["n_tokens"], "bin_id": rows["shard"] * (1 << 24) + where, "bin_start": np.array(start, np.int64), "bin_tokens": held[where], "bin_length": np.array(size, np.int64)[where]})

    return dealt.groupBy("shard").applyInPandas(one, f"_id {kind}, place long, piece int, n_tokens long, bin_id long, bin_start long, bin_tokens long, bin_length long")


def pack_documents(df: DataFrame, length: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, shard: int = SHARD, tokenizer_path: str | None = None) -> DataFrame:
    """(id, piece, n_tokens, bin_id, bin_start, bin_tokens, bin_length) of each document or piece of one; length is its number of tokens where that is known."""
    if length is None:
        found = encode_tokens(df, tokenizer_path or default_tokenizer(), id_col, text_col, ids=False)
    else:
        found = df.select(F.col(id_col).alias("_id"), length.cast("long").alias("n"))
    packed = pack_lengths(stage(found.withColumn("place", F.monotonically_increasing_id()), "lengths"), lengths, shard)
    return packed.select(F.col("_id").alias(id_col), "piece", "n_tokens", "bin_id", "bin_start", "bin_tokens", "bin_length")


def pack_sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, shard: int = SHARD, tokenizer_path: str | None = None) -> DataFrame:
    """(bin_id, bin_length, bin_tokens, doc_ids, pieces, starts, tokens): one row for each sequence, its contents in order, ready to be trained on."""
    found = stage(encode_tokens(df, tokenizer_path or default_tokenizer(), id_col, text_col).withColumn("place", F.monotonically_increasing_id()), "tokens")
    packed = stage(pack_lengths(found.select("_id", "place", "n"), lengths, shard), "packed")
    width = np.dtype(TOKEN).itemsize
    cut = packed.join(found.select("place", "tokens"), "place").withColumn("tokens", F.expr(f"substring(tokens, cast(piece * {max(lengths) * width} + 1 AS int), cast(n_tokens * {width} AS int))"))
    held = cut.groupBy("bin_id", "bin_length", "bin_tokens").agg(F.array_sort(F.collect_list(F.struct("bin_start", "n_tokens", "_id", "piece", "place", "tokens"))).alias("c"))
    rows = held.select("bin_id", "bin_length", "bin_tokens", F.col("c._id").alias("doc_ids"), F.col("c.piece").alias("pieces"), F.col("c.bin_start").alias("starts"), F.col("c.tokens").alias("tokens"))
    kind, names = rows.schema["doc_ids"].dataType.simpleString(), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(b"".join(parts), TOKEN).astype(np.int32) for parts in batch.column("tokens").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
            joined = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), joined], names=names)

    small_batches(df.sparkSession)
    return rows.mapInArrow(run, f"bin_id long, bin_length long, bin_tokens long, doc_ids {kind}, pieces array<int>, starts array<long>, tokens array<int>")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
