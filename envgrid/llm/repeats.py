"""Removal of long repeated byte strings by suffix order and longest-previous-factor arrays.

Every string of LENGTH bytes has an anchor: of its GRAM-byte substrings the one with the least hash, the leftmost of
equals. Equal strings have equal anchors at the same place, so each string need only be held against those around the
same anchor. The strings of a text that share an anchor are one run of starts, and the bytes that they cover are the
anchor's context. Copies of a whole context are found first, by 64-bit hashes within their anchor, whose counts are
aggregated before they are shuffled. Of contexts that differ around a shared anchor, each once, the bytes are brought
together, at most PIECE bytes at a time in whole groups. Their strings are put in suffix order to a depth of LENGTH by
prefix doubling, with the common prefixes of neighbours; the previous and the next smaller place in this order give each
string's longest previous factor, and it has an earlier match if and only if that reaches LENGTH. The mirror of the array, longest
next factors, tells of later ones; a string also starts elsewhere if and only if one of the two reaches LENGTH.

A group of more than BLOCK contexts is split before it is brought together, by longer prefixes of the order: the strings
around an anchor are halved by how far they start before it, and each half is grouped by all bytes that its strings must
have in common (the anchor and more on both sides). Equal pieces of a half are counted as one. Halving goes on while a
group is too large, at the end down to the single strings, so no group is too large for a task, whatever its anchor.

``keep="none"`` marks every occurrence of a repeated string, ``keep="first"`` all but the first by id and place. Strings
are judged on the input. Null texts are empty (and stay null); texts under LENGTH bytes have no such string; texts of any
length are read in whole, in stretches, and matches never cross texts. Ties don't arise: places differ. Rows that repeat an id with the
same text are occurrences like others (with ``keep="first"`` they are the same occurrence). An empty table gives an empty
result. Extra columns are kept with their values; an added column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import KEYS, free_name, pieces, read, row_keys, small_batches, stage, unstage

LENGTH, GRAM = 200, 64
#: The suffix order of PIECE bytes takes some 110 times as many of a Python worker's memory.
PIECE, BLOCK = 1 << 18, 128
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Strings of a text whose anchors are found together, and the bits of a place among them.
STRETCH = 1 << 22
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place, by doubling."""
    h, power, n = b.astype(np.uint64) + np.uint64(1), BASE, 1
    while n < GRAM:
        h = h[:-n] * power + h[n:]
        power, n = power * power, 2 * n
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, hash of the anchor) of the runs of strings that share an anchor; long texts go by stretches of STRETCH strings."""
    if len(b) - LENGTH + 1 > STRETCH:
        parts = [(k, anchors(b[k : k + STRETCH + LENGTH - 1])) for k in range(0, len(b) - LENGTH + 1, STRETCH)]
        return tuple(np.concatenate(x) for x in zip(*((lo + k, hi + k, h) for k, (lo, hi, h) in parts), strict=True))
    with np.errstate(over="ignore"):
        h = gram_hashes(b)
    m, n, width = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - GRAM + 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
    at = (m & PLACE).astype(np.int64)
    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo = np.r_[0, edge]
    return lo, np.r_[edge - 1, len(at) - 1], h[at[lo]].view(np.int64)


def anchor_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, rid2, lo, n, anchor, context) of each run: n further starts follow lo; context is a hash of the bytes covered."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).alias("text")).where(F.octet_length("text") >= LENGTH)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                who, los, ns, hs, cs = [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    raw = t.encode()
                    lo, hi, h = anchors(np.frombuffer(raw, np.uint8))
                    cs += [xxhash.xxh3_64_intdigest(raw[x : y + LENGTH]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    who.append(np.full(len(lo), i))
                    los.append(lo)
                    ns.append(hi - lo)
                    hs.append(h)
                take = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in ("id", *KEYS)), pa.array(np.concatenate(los).astype(np.int32)), pa.array(np.concatenate(ns).astype(np.int16)), pa.array(np.concatenate(hs)), pa.array(np.array(cs, np.uint64).view(np.int64))],
                    names=["id", *KEYS, "lo", "n", "anchor", "context"],
                )

    return rows.mapInArrow(run, f"id {kind}, rid long, rid2 long, lo int, n smallint, anchor long, context long")


def doubled_ranks(b: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """(ranks of the substrings of 8, 16 … 128 bytes at each place, the first 8 bytes as numbers); behind the end stand zeros."""
    n = len(b)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight[: n - k] |= b[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    rank = {8: np.unique(eight, return_inverse=True)[1]}
    d = 8
    while 2 * d <= LENGTH:
        r = rank[d]
        rank[2 * d] = joined(r, np.r_[r[d:], np.zeros(d, r.dtype)])
        d *= 2
    return rank, eight


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def suffix_ranks(rank: dict[int, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Ranks of the LENGTH-byte strings at starts in their suffix order; equal strings have equal ranks."""
    at, out = 0, None
    for d in sorted(rank, reverse=True):  # LENGTH as a sum of powers of two
        while at + d <= LENGTH:
            now = rank[d][starts + at]
            out = now if out is None else joined(out, now)
            at += d
    return out


def common_prefixes(rank: dict[int, np.ndarray], eight: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the LENGTH-byte strings at one and two."""
    n = np.zeros(len(one), np.int64)
    for d in sorted(rank, reverse=True):
        fits = n + d <= LENGTH
        n += d * (fits & (rank[d][np.where(fits, one + n, 0)] == rank[d][np.where(fits, two + n, 0)]))
    rest = n < LENGTH
    i, j = one[rest] + n[rest], two[rest] + n[rest]
    differ = eight[i] ^ eight[j]
    n[rest] += sum((differ < (np.uint64(1) << np.uint64(64 - 8 * k))).astype(np.int64) for k in range(1, 8))
    return np.minimum(n, LENGTH)


def smaller_before(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix order (previous one with a smaller text place or -1, common prefix with it); common holds prefixes with the neighbour before.

    All places jump at once: what lies between a place and where it points to is greater, so a pointer's pointer may be taken.
    """
    at, held = np.arange(len(place)) - 1, common.copy()
    todo = np.flatnonzero(at >= 0)
    while len(todo := todo[(at[todo] >= 0) & (place[at[todo]] > place[todo])]):
        to = at[todo]
        held[todo], at[todo] = np.minimum(held[todo], held[to]), at[to]
    held[at < 0] = 0
    return at, held


def longest_previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """LPF of each place of the suffix order: the longer of the prefixes shared with the previous and the next smaller text place."""
    _, before = smaller_before(place, common)
    _, after = smaller_before(place[::-1], np.r_[0, common[1:][::-1]])
    return np.maximum(before, after[::-1])


def earlier_and_elsewhere(b: np.ndarray, starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings at starts of b, and their order by id and place: (an equal string starts earlier, one starts elsewhere)."""
    rank, eight = doubled_ranks(b)
    sa = np.lexsort((order, suffix_ranks(rank, starts)))
    common = np.r_[0, common_prefixes(rank, eight, starts[sa[:-1]], starts[sa[1:]])]
    earlier, later = np.empty(len(sa), bool), np.empty(len(sa), bool)
    earlier[sa] = longest_previous_factors(order[sa], common) >= LENGTH
    later[sa] = longest_previous_factors(-order[sa], common) >= LENGTH  # the mirror: longest next factors
    return earlier, earlier | later


def _spans(own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first byte, byte behind the last) of runs of starts that are sorted within each context's stretch."""
    cut = np.r_[True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:] - 1, len(start) - 1]
    return own[first], start[first], start[last] + LENGTH


def compare_contexts(contexts: DataFrame, keep: str) -> DataFrame:
    """(rid, rid2, s, e) of repeats in contexts (id, rid, rid2, lo, n, anchor, bytes), by suffix order over whole groups of an anchor."""
    def solve(held: list[tuple]) -> pa.RecordBatch:
        # a context's place in the order by id and place, and its strings' starts in the joined bytes
        rank_of = {k: i for i, k in enumerate(sorted(range(len(held)), key=lambda i: (held[i][0] is not None, held[i][:4]) if held[i][0] is not None else (False, held[i][1:4])))}
        size = np.array([len(x[6]) for x in held])
        base = np.cumsum(size) - size
        n = np.array([x[4] + 1 for x in held])
        own = np.repeat(np.arange(len(held)), n)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        place = np.array([rank_of[i] for i in range(len(held))])
        earlier, elsewhere = earlier_and_elsewhere(np.frombuffer(b"".join(x[6] for x in held), np.uint8), base[own] + inner, place[own] * (1 << 20) + inner)
        hit = np.flatnonzero(earlier if keep == "first" else elsewhere)
        at, s, e = _spans(own[hit], np.array([x[3] for x in held])[own[hit]] + inner[hit]) if len(hit) else (np.zeros(0, np.int64),) * 3
        rids = [pa.array(np.array([x[k] for x in held], np.int64)[at]) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([*rids, pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=[*KEYS, "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        total = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", *KEYS, "lo", "n", "anchor", "bytes")), strict=True):
                if group and group[-1][5] != row[5]:
                    held += group
                    group = []
                    if total > PIECE:
                        yield solve(held)
                        held, total = [], 0
                group.append(row)
                total += len(row[6])
        if held or group:
            yield solve(held + group)

    return contexts.repartition("anchor").sortWithinPartitions("anchor", "id", *KEYS, "lo").select("id", *KEYS, "lo", "n", "anchor", "bytes").mapInArrow(run, "rid long, rid2 long, s int, e int")


def anchor_place(raw: bytes, n: int, anchor: int) -> int:
    """Where a context's anchor starts: the leftmost place with its hash that all n + 1 strings hold."""
    with np.errstate(over="ignore"):
        h = gram_hashes(np.frombuffer(raw[n : LENGTH], np.uint8)).view(np.int64)
    return n + int(np.flatnonzero(h == anchor)[0])


def halves(contexts: DataFrame) -> DataFrame:
    """Contexts (id, rid, lo, n, anchor, bytes, p, x0, x1) of strings that start from x0 up to x1 - 1 bytes before the anchor at p, cut in two by that distance; anchor becomes a hash of the bytes that a half's strings have in common."""
    kind = contexts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for k, (lo, n, anchor, raw, p, x0, x1) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lo", "n", "anchor", "bytes", "p", "x0", "x1")), strict=True)):
                at = p - lo if p >= 0 else anchor_place(raw, n, anchor)
                middle = (x0 + x1) // 2
                for a, b in ((x0, middle), (middle, x1)):
                    least, most = max(a, at - n), min(b - 1, at)
                    if least <= most:
                        key = xxhash.xxh3_64_intdigest(raw[at - a : at + LENGTH + 1 - b], a << 8 | b) - (1 << 63)
                        for x, v in zip(out, (k, lo + at - most, most - least, key, raw[at - most : at - least + LENGTH], lo + at, a, b), strict=True):
                            x.append(v)
            take = pa.array(out[0], pa.int64())
            made = [pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int16(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", *KEYS)), *made], names=["id", *KEYS, "lo", "n", "anchor", "bytes", "p", "x0", "x1"])

    return contexts.select("id", *KEYS, "lo", "n", "anchor", "bytes", "p", "x0", "x1").mapInArrow(run, f"id {kind}, rid long, rid2 long, lo int, n smallint, anchor long, bytes binary, p int, x0 int, x1 int")


def compare_groups(contexts: DataFrame, keep: str) -> DataFrame:
    """(rid, s, e) of repeats in staged contexts (id, rid, lo, n, anchor, bytes), each of them different: groups of up to BLOCK at once, larger ones after halving."""
    rows = contexts.selectExpr("*", "-1 AS p", "0 AS x0", f"{LENGTH - GRAM + 1} AS x1")
    spans = None
    while True:
        sizes = stage(rows.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
        # both sides of the join come from tables, so that a frequent anchor's partition can be split
        few = compare_contexts(rows.join(sizes.where(F.col("k") <= BLOCK), "anchor"), keep)
        spans = few if spans is None else spans.unionByName(few)
        many = sizes.where(F.col("k") > BLOCK)
        if many.isEmpty():
            return spans
        cut = stage(halves(rows.join(many, "anchor")), "halves")
        same = stage(cut.groupBy("anchor", "bytes").agg(F.count("*").alias("c"), F.min(F.struct("id", *KEYS, "lo")).alias("f")), "same")
        told = stage(cut.join(same, ["anchor", "bytes"]).withColumn("first", F.struct("id", *KEYS, "lo") == F.col("f")).drop("f"), "told")
        unstage(cut, same)
        copies = told.where(F.col("c") > 1 if keep == "none" else ~F.col("first")).select(*KEYS, F.col("lo").alias("s"), (F.col("lo") + F.col("n") + LENGTH).cast("int").alias("e"))
        spans = spans.unionByName(copies)
        rows = told.where("first").drop("c", "first")


def repeat_spans(df: DataFrame, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rid2, spans array<struct<s,e>>) of the texts with repeats: stretches of bytes to remove, sorted, possibly overlapping; row_keys gives rid and rid2."""
    found = anchor_rows(df, id_col, text_col)
    shared = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("context").alias("a"), F.max("context").alias("b")).where("c > 1").select("anchor", (F.col("a") < F.col("b")).alias("mixed"))
    # both sides of the join come from tables, so that a frequent anchor's partition can be split
    rows = stage(found.join(stage(shared, "shared"), "anchor"), "anchors")
    whole = rows.groupBy("anchor", "context").agg(F.count("*").alias("c"), F.min(F.struct("id", *KEYS, "lo")).alias("f"))
    told = stage(rows.join(stage(whole, "whole"), ["anchor", "context"]).withColumn("first", F.struct("id", *KEYS, "lo") == F.col("f")).select("id", *KEYS, "lo", "n", "anchor", "mixed", "c", "first"), "contexts")
    copies = told.where(F.col("c") > 1 if keep == "none" else ~F.col("first")).select(*KEYS, F.col("lo").alias("s"), (F.col("lo") + F.col("n") + LENGTH).cast("int").alias("e"))
    # the bytes of each different context around a shared anchor
    edges = told.where("mixed AND first").groupBy(*KEYS).agg(F.collect_set(F.struct("lo", "n", "anchor")).alias("edges"))
    texts = df.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).alias("text")).where(F.octet_length("text") >= LENGTH).join(edges, list(KEYS))
    parts = texts.select("id", *KEYS, F.encode("text", "UTF-8").alias("raw"), F.explode("edges").alias("x")).select("id", *KEYS, "x.lo", "x.n", "x.anchor", F.expr(f"substring(raw, x.lo + 1, x.n + {LENGTH})").alias("bytes")).dropDuplicates([*KEYS, "lo"])
    fine = compare_groups(stage(parts, "edges"), keep)
    return copies.unionByName(fine).groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))


def cut(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    out, at, runs, removed, end = [], 0, 0, 0, -1
    for s, e in spans:
        if s > end:
            runs += 1
            out.append(raw[at:s])
            at = end = e
            removed += e - s
        elif e > end:
            removed += e - end
            at = end = e
    out.append(raw[at:])
    return b"".join(out), removed, runs


def remove_repeats(df: DataFrame, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", digest: bool = False, counts: bool = True) -> DataFrame:
    """df with the remaining text (characters that lost a byte go too) or, with digest, kept_sha256 of the remaining bytes instead of it, and (with counts) n_bytes, n_removed, n_spans."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != text_col]
    rid, rid2, found, n_bytes, n_removed, n_spans = (free_name(df.columns, c) for c in (*KEYS, "spans", "n_bytes", "n_removed", "n_spans"))
    out = free_name(df.columns, "kept_sha256") if digest else text_col
    spans = repeat_spans(df, keep, id_col, text_col).select(F.col("rid").alias(rid), F.col("rid2").alias(rid2), F.col("spans").alias(found))
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")  # given columns travel as one, whatever their names
    joined = df.select("*", *row_keys(id_col, text_col, (rid, rid2))).join(spans, [rid, rid2], "left").select(row, F.col(f"`{text_col}`").alias("text"), F.col(found).alias("spans"))
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts, n, gone, runs = [], [], [], []
                for t, s in zip(part.column("text"), part.column("spans"), strict=True):
                    raw = (t.as_py() or "").encode()
                    left, removed, k = cut(raw, [(x["s"], x["e"]) for x in s.as_py()]) if s.is_valid else (raw, 0, 0)
                    texts.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "ignore") if t.is_valid else None)
                    n.append(len(raw))
                    gone.append(removed)
                    runs.append(k)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=["row", "text", "n_bytes", "n_removed", "n_spans"])

    done = joined.mapInArrow(run, f"row {kind}, text string, n_bytes long, n_removed long, n_spans long")
    columns = [F.col("text").alias(out) if c == text_col else F.col(f"row.`{c}`") for c in df.columns if c != text_col or not digest]
    columns += [F.col("text").alias(out)] if digest else []
    columns += [F.col("n_bytes").alias(n_bytes), F.col("n_removed").alias(n_removed), F.col("n_spans").alias(n_spans)] if counts else []
    return done.select(*columns)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


QUERIES = {"op8_repeats": op8_repeats}
ORACLES = {
    "op8_repeats": r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), k AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
 t AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(n - 199)) AS s FROM k WHERE n >= 200)),
 r AS (SELECT doc_id, s, s + 200 AS e FROM t WHERE g IN (SELECT g FROM t GROUP BY g HAVING count(*) > 1)),
 i AS (SELECT doc_id, s, e, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM r),
 j AS (SELECT doc_id, s, e, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS f FROM i), m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM j GROUP BY doc_id, f),
 x AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM m),
 o AS (SELECT x.doc_id, sum(e - s) AS gone, count(*) AS spans, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS left_ FROM x JOIN k ON k.doc_id = x.doc_id GROUP BY x.doc_id)
 SELECT k.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256 FROM k LEFT JOIN o ON o.doc_id = k.doc_id""",
}
