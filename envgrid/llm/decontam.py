"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased from A to Z and cut into words of digits, letters and bytes from 0x80. A benchmark item's windows of
WINDOW consecutive words are the patterns; an item of fewer words, but not none, is one window of them all. Patterns of m
words go to a machine for m. Its blocks are two neighbouring words (one, where m is 1): the shift table says for the hash of a
block how far the search may move on because no pattern can end before, and a block that ends a pattern has shift 0. Then
the block's suffix bucket gives the patterns that end in it, ordered by a hash of all their words; those of the same hash are
compared word by word. All stretches of a slice of texts are searched side by side in numpy, each at its own pointer.

The benchmark is no broadcast of unknown size: items are cut into pieces of at most PIECE_WORDS windows, words over
WORD_BYTES bytes go by their SHA-256, and the pieces are dealt into blocks of at most BLOCK_BYTES bytes, of which one at a
time is sent to the tasks. With several blocks each text passes all of them one after the other, and what has been found
travels with the row; nothing shuffles. Overlapping occurrences all count, in any number.

Null and empty texts have no words and no hits; texts of any length are read in whole, in stretches of bounded size. Rows
that repeat an id are searched each by itself. Items without words are no patterns; rows of the benchmark that repeat an
item's id are one item; the words of an item without id are hits, but it is not listed. An empty benchmark finds nothing, an
empty table gives an empty result. Ties don't arise. Given columns keep their values; an added column whose name is taken
gets an underscore behind it.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import free_name, pieces, read, small_batches, stage, unstage

WINDOW = 10
PIECE_WORDS, BLOCK_BYTES, WORD_BYTES = 4096, 4 << 20, 64
#: Positions that a pointer walks, and bytes whose words are objects at one time.
STRETCH, TEXT_BYTES = 1024, 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
ROW_END = b"\xff"  # in no UTF-8 text

#: What each byte becomes: lower case, or a blank between words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """The words of UTF-8 bytes; one over WORD_BYTES is known by its digest."""
    return short_words(raw.translate(FOLD).split())


def short_words(words: list[bytes]) -> list[bytes]:
    if words and max(map(len, words)) > WORD_BYTES:
        return [w if len(w) <= WORD_BYTES else b"+" + hashlib.sha256(w).hexdigest().encode() for w in words]
    return words


class WuManber:
    """Patterns of m words each, as rows of word numbers from 1."""

    def __init__(self, patterns: np.ndarray):
        self.m = m = patterns.shape[1]
        self.width = min(2, m)
        bits = min(24, max(12, (4 * patterns.size).bit_length()))
        self.right = np.uint64(64 - bits)
        order = np.lexsort((self.full(patterns), self.block(patterns, m - 1)))
        self.patterns, self.order = patterns[order], order
        self.shift = np.full(1 << bits, m - self.width + 1, np.uint8)
        for end in range(self.width - 1, m):  # later blocks have smaller shifts and take the place of larger ones
            self.shift[self.block(patterns, end)] = m - 1 - end
        #: Suffix buckets, and in each the patterns by the hash of all words.
        last = self.block(self.patterns, m - 1)
        self.key = self.bucket(last, self.full(self.patterns))

    def block(self, words: np.ndarray, end) -> np.ndarray:
        """Hash of the block that ends at column end."""
        return self.hashed(words[:, end - self.width + 1], words[:, end])

    def hashed(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        h = (before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
        return (h * MIX >> self.right).astype(np.int64)

    @staticmethod
    def full(words: np.ndarray) -> np.ndarray:
        h = np.zeros(len(words), np.uint64)
        for k in range(words.shape[1]):
            h = (h ^ words[:, k].astype(np.uint64)) * MIX
            h ^= h >> np.uint64(31)
        return h

    @staticmethod
    def bucket(block: np.ndarray, full: np.ndarray) -> np.ndarray:
        return block.astype(np.uint64) << np.uint64(40) | full >> np.uint64(24)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, pattern) of all occurrences in word numbers; 0 is a word of no pattern."""
        at = np.arange(0, len(text), STRETCH)
        stop = np.minimum(at + STRETCH, len(text))
        at = np.maximum(at, self.m - 1)
        starts, found = [], []
        while True:
            on = at < stop
            at, stop = at[on], stop[on]
            if not len(at):
                break
            h = self.hashed(text[at - self.width + 1], text[at])
            move = self.shift[h].astype(np.int64)
            hit = np.flatnonzero(move == 0)
            if len(hit):
                s, p = self.confirm(text, at[hit], h[hit])
                starts.append(s)
                found.append(p)
                move[hit] = 1
            at = at + move
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)

    def confirm(self, text: np.ndarray, end: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window = text[(end - self.m + 1)[:, None] + np.arange(self.m)]
        key = self.bucket(block, self.full(window))
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        starts, found = [], []
        while (some := low < high).any():  # patterns differ, so at most one of a hash is equal
            end, window, low, high = end[some], window[some], low[some], high[some]
            same = (self.patterns[low] == window).all(axis=1)
            starts.append(end[same] - self.m + 1)
            found.append(self.order[low[same]])
            end, window, low, high = end[~same], window[~same], low[~same] + 1, high[~same]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


@dataclass(frozen=True)
class Shared:
    """A broadcast block; equal in all tasks that are sent the same one."""

    key: str
    sent: object = field(compare=False)


class Block:
    """The machines of a block of benchmark pieces (item number, words), with the items of each pattern."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {ROW_END: -1}
        by_length: dict[int, list] = {}
        for item, text in rows:
            w = text.split()
            ids = np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64)
            windows = np.lib.stride_tricks.sliding_window_view(ids, min(WINDOW, len(w)))
            by_length.setdefault(windows.shape[1], []).append((windows, np.full(len(windows), item)))
        #: (machine, pointer to the items of each pattern, items)
        self.machines = []
        for m in sorted(by_length):
            rows_, items = (np.concatenate(x) for x in zip(*by_length[m], strict=True))
            patterns, which = np.unique(rows_, axis=0, return_inverse=True)
            pairs = np.unique(which.ravel() * (1 << 32) + items)
            self.machines.append((WuManber(patterns), np.searchsorted(pairs >> 32, np.arange(len(patterns) + 1)), pairs & 0xFFFFFFFF))

    def numbers(self, raw: bytes) -> np.ndarray:
        """Word numbers of raw, whose rows are parted by ROW_END; 0 for words of no pattern."""
        raw, out, at = raw.translate(FOLD), [], 0
        while at < len(raw):
            end = raw.find(b" ", at + TEXT_BYTES)
            end = len(raw) if end < 0 else end
            w = short_words(raw[at:end].split())
            out.append(np.fromiter(map(self.number.get, w, repeat(0)), np.int64, len(w)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(number of words, [first word, word behind the last] of the maximal runs of hit words, item numbers) of each text."""
        numbers = self.numbers(b" \xff ".join([*texts, b""]))
        ends = np.flatnonzero(numbers == -1)
        fronts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        numbers[ends] = 0
        cover = np.zeros(len(numbers) + 1, np.int64)
        owners, owned = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for machine, ptr, items in self.machines:
            start, pattern = machine.find(numbers)
            cover += np.bincount(start, minlength=len(cover)) - np.bincount(start + machine.m, minlength=len(cover))
            pair = np.unique(np.searchsorted(ends, start) << 32 | pattern)
            pattern, n = pair & 0xFFFFFFFF, (ptr[1:] - ptr[:-1])[pair & 0xFFFFFFFF]
            owners.append(np.repeat(pair >> 32, n))
            owned.append(items[np.repeat(ptr[pattern] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        hit = np.r_[False, np.cumsum(cover[:-1]) > 0, False]
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        runs = edge.reshape(-1, 2)
        row = np.searchsorted(ends, runs[:, 0])
        runs = runs - fronts[row][:, None]
        pair = np.unique(np.concatenate(owners) << 32 | np.concatenate(owned))
        cut = np.arange(len(ends) + 1)
        by_row = np.searchsorted(row, cut)
        by_pair = np.searchsorted(pair >> 32, cut)
        return ends - fronts, [runs[i:j] for i, j in zip(by_row, by_row[1:], strict=False)], [pair[i:j] & 0xFFFFFFFF for i, j in zip(by_pair, by_pair[1:], strict=False)]


def joined_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The maximal runs of two lists of runs."""
    if not len(a) or not len(b):
        return a if len(a) else b
    both = np.concatenate([a, b])
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    first = np.flatnonzero(np.r_[True, both[1:, 0] > reach[:-1]])
    return np.stack([both[first, 0], reach[np.r_[first[1:] - 1, len(both) - 1]]], axis=1)


def item_pieces(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words) of pieces whose windows together are the items' windows."""
    small_batches(benchmark.sparkSession)
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows, made = [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    w = words_of((t or "").encode())
                    for k in range(0, max(1, len(w) - WINDOW + 1) if w else 0, PIECE_WORDS):
                        rows.append(i)
                        made.append(b" ".join(w[k : k + PIECE_WORDS + WINDOW - 1]))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(rows, pa.int64())), pa.array(made, pa.binary())], names=["item", "words"])

    return benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, f"item {kind}, words binary")


def blocks(found: DataFrame) -> Iterator[list]:
    """Rows of staged pieces (item, words), at most BLOCK_BYTES of words and one more piece at a time."""
    size = F.octet_length("words") + 16
    total = found.agg(F.sum(size)).first()[0] or 0
    n = max(1, math.ceil(1.3 * total / BLOCK_BYTES))
    while True:  # dealt by hash; more blocks until none is too large but for a single piece
        dealt = found.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum(size).alias("b"), F.countDistinct("item", "words").alias("k")).where(f"b > {2 * BLOCK_BYTES} AND k > 1")
        if most.isEmpty():
            break
        n *= 2
    for b in range(n):
        yield dealt.where(F.col("block") == b).select("item", "words").distinct().collect()


@lru_cache(maxsize=1)
def compiled(shared: Shared) -> tuple[Block, list]:
    """The machines of a broadcast block, built once in a Python worker, which keeps one block at a time."""
    items, rows = shared.sent.value
    return Block(rows), items


FOUND = "n_words bigint, n_hit bigint, spans array<struct<s:bigint,e:bigint>>, items array<{kind}>"


def search_block(rows: DataFrame, kind: str, piece_rows: list) -> DataFrame:
    """rows (row, text, n_words, n_hit, spans, items) with what a block's patterns add."""
    named = sorted({r["item"] for r in piece_rows if r["item"] is not None})
    place = {x: i for i, x in enumerate(named)}
    items = [*named, None]
    sent = rows.sparkSession.sparkContext.broadcast((items, [(place.get(r["item"], len(named)), bytes(r["words"])) for r in piece_rows]))
    shared = Shared(uuid.uuid4().hex, sent)
    row_kind = rows.schema["row"].dataType.simpleString()
    runs_type, items_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), rows.schema["items"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        block, items = compiled(shared)
        arrow_items = to_arrow_type(items_type)
        for batch in batches:
            for part in pieces(batch, "text"):
                n, runs, found = block.search([(t or "").encode() for t in part.column("text").to_pylist()])
                before = [np.array([(x["s"], x["e"]) for x in old or []], np.int64).reshape(-1, 2) for old in part.column("spans").to_pylist()]
                runs = [joined_runs(a, b) for a, b in zip(before, runs, strict=True)]
                found = [sorted({*(old or []), *(items[i] for i in new if items[i] is not None)}) for old, new in zip(part.column("items").to_pylist(), found, strict=True)]
                flat = np.concatenate([*runs, np.zeros((0, 2), np.int64)])
                ptr = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                spans = pa.ListArray.from_arrays(ptr, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(runs_type.value_type)))
                hit = [int((r[:, 1] - r[:, 0]).sum()) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), spans, pa.array(found, arrow_items)], names=["row", "text", "n_words", "n_hit", "spans", "items"]
                )

    return rows.mapInArrow(run, f"row {row_kind}, text string, {FOUND.format(kind=kind)}")


def mark_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry_text: bool = True) -> DataFrame:
    """df with n_words, n_hit, spans (first word and the word behind the last of each maximal run of hit words), items (sorted) and contaminated."""
    small_batches(df.sparkSession)
    kind = benchmark.schema[item_col].dataType.simpleString()
    names = [free_name(df.columns, c) for c in ("n_words", "n_hit", "spans", "items", "contaminated")]
    found = stage(item_pieces(benchmark, item_col, item_text), "patterns")
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias(free_name(rest, "_"))).alias("row"), F.col(f"`{text_col}`").alias("text")).selectExpr(
        "*", *[f"CAST(NULL AS {t.strip()}) AS {n}" for n, t in (("n_words", "bigint"), ("n_hit", "bigint"), ("spans", "array<struct<s:bigint,e:bigint>>"), ("items", f"array<{kind}>"))]
    )
    searched, before = False, None
    for block in blocks(found):
        if searched:  # the tasks of one block are done before the next block is sent
            now = stage(rows, "searched")
            if before is not None:
                unstage(before)
            rows = before = now
        rows, searched = search_block(rows, kind, block), True
    unstage(found)
    given = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns if carry_text or c != text_col]
    return rows.select(*given, *[F.col(c).alias(n) for c, n in zip(("n_words", "n_hit", "spans", "items"), names, strict=False)], (F.col("n_hit") > 0).alias(names[4]))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), carry_text=False)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op11_decontaminate": op11_decontaminate}
ORACLES = {
    "op11_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 p AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
 t AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
 m AS (SELECT doc_id, item_id, k, i FROM t JOIN p USING (k, g)),
 h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
 s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id""",
}
