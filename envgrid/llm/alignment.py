"""Alignment of two tokenizers' tokens by products of sparse matrices.

A text with a blank before it is cut by tokenizer A (byte-level) and by tokenizer B (pieces, whose encoder adds the blank).
Both token-byte incidence matrices are held in CSR: a row for each token, a column for each byte. Gustavson's row product
A·Bᵀ gives for each token of A the tokens of B that it overlaps, with the number of bytes they share. Where a token of A
shares no token of B with its successor, both end at the same byte, and a group ends there. The incidence of tokens' ids and
groups, transposed for A, times that for B gives the shared-group links: for each pair of ids how often they stand in one
group. The matrices of all texts of a slice are one, with rows by text; products are made in blocks of bounded size.

Words are encoded by the tokenizers' own libraries. For B, where no piece goes on over the front of a blank and a word, new
words of a slice are encoded and known ones come from a store of bounded size, which affects speed only. For A a faster
library with the same merges does the work, but for texts with a character on whose class the two disagree.

How many documents hold a pair of ids linked is counted over the whole corpus. Counts come back to the documents in two
ways: the HEAD most frequent pairs, chosen by a count that at most HEAD pairs reach, are sent to all tasks as a sorted array
of that bounded size, and the links of the others are joined by pair. So no pair is frequent in the join, and none is left out.

Texts that are null or empty, or whose bytes a tokenizer doesn't give back, have no tokens: counts are 0 and there are no
groups. Texts of any length are taken in whole. Ties between pairs of one highest count are all best. Rows that repeat an id
or a text are documents of their own. An empty table gives an empty result. Of other columns none is read, so names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import pieces, read, small_batches, stage
from envgrid.llm.token_counts import byte_signs

BLANK = "▁"
#: Words of a store, ids of a store, and products that are held before they are summed.
WORDS, IDS, PRODUCTS = 400_000, 4_000_000, 1 << 19
#: Characters of a text whose words are objects at one time.
CHARS = 4 << 20
#: Bytes of texts that are aligned together.
SLICE = 1 << 20
#: Most pairs that are sent to all tasks: 16 bytes each.
HEAD = 1 << 20


class Store:
    """Ids of the words that an encoder has seen, as one CSR matrix, and the words that their ids don't give back."""

    def __init__(self, encode, plain, bytes_of: list[bytes]):
        self.encode, self.plain, self.bytes_of = encode, plain, bytes_of
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends, self.wrong = array("i"), array("q", [0]), []

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each, whether they are the word's bytes)."""
        if len(self.number) > WORDS or len(self.ids) > IDS:
            self.reset()
        new = list(set(words).difference(self.number))
        made, first = self.encode(new), len(self.ends) - 1
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        self.ids.extend(chain.from_iterable(made))
        self.ends.extend((self.ends[-1] + np.cumsum([len(x) for x in made], dtype=np.int64)).tolist())
        if b"".join([self.bytes_of[i] for i in chain.from_iterable(made)]) != b"".join(map(self.plain, new)):
            self.wrong += [first + k for k, (w, ids) in enumerate(zip(new, made, strict=True)) if b"".join([self.bytes_of[i] for i in ids]) != self.plain(w)]
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        ptr = np.frombuffer(self.ends, np.int64)
        ids = gathered(np.frombuffer(self.ids, np.int32), ptr, numbers) if len(self.ids) else np.zeros(0, np.int32)
        return ids, ptr[numbers + 1] - ptr[numbers], ~np.isin(numbers, self.wrong)


def gathered(values: np.ndarray, ptr: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of CSR rows, one row after the other."""
    n = ptr[rows + 1] - ptr[rows]
    return values[np.repeat(ptr[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class ByteSide:
    """A byte-level tokenizer of the tokenizers library; it reads a blank and the text.

    tiktoken encodes with the same merges as ranks, which is faster. The libraries' tables of letters and numbers may differ: each
    new character is shown to both, and a text with one that they cut otherwise is encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level tokenizers without normalizer or added blank are supported")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        signs = {s: b for b, s in enumerate(byte_signs())}
        vocab, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(signs[c] for c in t): i for t, i in vocab.items() if t not in added}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made) or len(ranks) != len(made) + 256:
            raise ValueError("only vocabularies in the order of their merges are supported")
        # Fixed value: the word pattern of byte-level vocabularies.
        self.ranked = tiktoken.Encoding("ranked", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.asked, self.odd = {chr(c) for c in range(128)}, set()

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ask(self, chars: set[str]) -> None:
        """Notes the characters of which the libraries make different words."""
        for c in chars - self.asked:
            self.asked.add(c)
            probe = f"a{c}a 1{c}1 .{c}. a{c} {c}{c}a{c}\n{c}1"
            if self.by_library(probe) != self.ranked.encode_ordinary(probe):
                self.odd.add(c)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each, whether they are the text's bytes)."""
        self.ask(set().union(*texts))
        out = []
        for text in texts:
            if self.odd and not self.odd.isdisjoint(text):
                out.append(np.array(self.by_library(" " + text), np.int64))
            else:
                out.append(self.ranked.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64))
        ids, given, good = np.concatenate(out), [(" " + text).encode() for text in texts], np.ones(len(texts), bool)
        if b"".join(map(self.bytes_of.__getitem__, ids.tolist())) != b"".join(given) or any(int(self.size[x].sum()) != len(g) for x, g in zip(out, given, strict=True)):
            good = np.array([b"".join(map(self.bytes_of.__getitem__, x.tolist())) == g for x, g in zip(out, given, strict=True)], bool)
        return ids, np.array([len(x) for x in out], np.int64), good


class PieceSide:
    """A sentencepiece tokenizer, which adds a blank before the text. Words are blanks and what follows them up to the next."""

    pattern = re.compile("▁+[^▁]*")

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(n)))]
        if any(BLANK in sp.id_to_piece(i).lstrip(BLANK) for i in range(n)):
            raise ValueError("a piece holds a blank after another character")
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        alone = sp.piece_to_id(BLANK)

        def encode(new: list[str]) -> list[list[int]]:
            # the library adds a word's first blank itself
            return [[alone] if w == BLANK else ids for w, ids in zip(new, sp.encode([w[1:] for w in new], num_threads=1), strict=True)] if new else []

        self.store = Store(encode, lambda w: w.replace(BLANK, " ").encode(), self.bytes_of)

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in lists of bounded size."""
        text = (BLANK + text.replace(" ", BLANK)) if text else ""
        if len(text) <= CHARS:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while some := list(islice(found, CHARS // 4)):
                yield some

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each, whether they are the text's bytes)."""
        out, counts, good, waiting, held = [], np.zeros(len(texts), np.int64), np.ones(len(texts), bool), [], 0

        def flush() -> None:
            ids, n, right = self.store.tokens(list(chain.from_iterable(w for _, w in waiting)))
            text = np.repeat([k for k, _ in waiting], [len(w) for _, w in waiting]).astype(np.int64)
            np.add.at(counts, text, n)
            good[text[~right]] = False
            out.append(ids)
            waiting.clear()

        for k, text in enumerate(texts):
            if BLANK in text:  # the sign of a blank would come back as one
                good[k] = False
                continue
            for w in self.words(text):
                waiting.append((k, w))
                held += len(w)
                if held > CHARS // 4:
                    flush()
                    held = 0
        flush()
        return np.concatenate(out).astype(np.int64), counts, good


class Csr:
    """A sparse matrix: ptr[r] to ptr[r + 1] are the entries (col, val) of row r."""

    def __init__(self, ptr: np.ndarray, col: np.ndarray, val: np.ndarray):
        self.ptr, self.col, self.val = ptr, col, val

    @staticmethod
    def of(row: np.ndarray, col: np.ndarray, val: np.ndarray, rows: int, cols: int) -> Csr:
        """From entries in any order; those of one place are summed."""
        key = row * cols + col
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        val = np.add.reduceat(val, first) if len(key) else val
        row, col = np.divmod(key[first], cols)
        return Csr(np.r_[0, np.cumsum(np.bincount(row, minlength=rows))], col, val)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def times(self, other: Csr, cols: int) -> Csr:
        """Gustavson's product: each row's entries take up the rows of other that they name, scaled and summed."""
        rows, n = self.rows(), np.diff(other.ptr)[self.col]
        total = np.r_[0, np.cumsum(n)]
        parts, at = [], 0
        while at < len(self.col):
            end = max(at + 1, int(np.searchsorted(total, total[at] + PRODUCTS, "right")) - 1)
            k = n[at:end]
            take = np.repeat(other.ptr[self.col[at:end]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            part = Csr.of(np.repeat(rows[at:end], k), other.col[take], np.repeat(self.val[at:end], k) * other.val[take], len(self.ptr) - 1, cols)
            parts.append((part.rows(), part.col, part.val))
            at = end
        if not parts:
            return Csr(np.zeros(len(self.ptr), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return Csr.of(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(self.ptr) - 1, cols)


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> Csr:
    """Overlap links of tokens with these numbers of bytes: A·Bᵀ of the token-byte incidence matrices."""
    n = int(size_a.sum())
    ones = np.ones(n, np.int64)
    a = Csr(np.r_[0, np.cumsum(size_a)], np.arange(n), ones)
    bt = Csr(np.arange(n + 1), np.repeat(np.arange(len(size_b)), size_b), ones)
    return a.times(bt, max(1, len(size_b)))


def token_groups(over: Csr, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each token of A, of B): a group ends where neither tokenizer's token goes on."""
    first, last = over.col[over.ptr[:-1]], over.col[over.ptr[1:] - 1]
    of_a = np.cumsum(np.r_[0, first[1:] != last[:-1]]) if len(first) else first
    of_b = np.zeros(n_b, np.int64)
    of_b[over.col] = of_a[over.rows()]
    return of_a, of_b


class Aligner:
    """Both tokenizers, and what they make of the texts of a slice."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.n_b = len(self.b.bytes_of)
        #: Each id with the sign that follows it: within its group's tokens, behind those of A, behind those of B.
        self.names = [f"{i}{sign}" for side in (self.a, self.b) for i in range(len(side.bytes_of)) for sign in ",|;"]

    def align(self, texts: list[str | None]) -> dict:
        """Tokens, groups and links of texts, with rows (texts) given by numbers of tokens, groups and links."""
        given = [t or "" for t in texts]
        (ids_a, n_a, good_a), (ids_b, n_b, good_b) = self.a.tokens(given), self.b.tokens(given)
        good = good_a & good_b & np.array([bool(t) for t in given], bool)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        text = np.arange(len(given))
        over = overlaps(self.a.size[ids_a], self.b.size[ids_b])
        group_a, group_b = token_groups(over, len(ids_b))
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        text_a = np.repeat(text, n_a)
        # incidence of (text, id of A) by group, and of group by id of B
        wide = len(self.a.bytes_of)
        key = text_a * wide + ids_a
        rows, row = np.unique(key, return_inverse=True)
        in_a = Csr.of(row, group_a, np.ones(len(row), np.int64), len(rows), max(1, n))
        in_b = Csr.of(group_b, ids_b, np.ones(len(ids_b), np.int64), n, self.n_b)
        links = in_a.times(in_b, self.n_b)
        link_row = links.rows()
        link_text = rows[link_row] // wide if len(rows) else link_row
        n_groups = np.bincount(text_a[np.flatnonzero(np.diff(group_a, prepend=-1))] if n else text_a, minlength=len(given))
        return {
            "ids_a": ids_a, "ids_b": ids_b, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "group_a": group_a, "group_b": group_b, "overlaps": over,
            "pairs": (rows[link_row] % wide) * self.n_b + links.col if len(rows) else link_row, "links": links.val, "n_pairs": np.bincount(link_text, minlength=len(given)),
            "n_links": np.bincount(link_text, weights=links.val, minlength=len(given)).astype(np.int64),
        }

    def written_groups(self, made: dict) -> list[str]:
        """Groups of each text as a1,a2|b1;a3|b2: ids with the sign behind them, the last one's left out."""
        ga, gb = made["group_a"], made["group_b"]
        end_a, end_b = np.r_[ga[1:] != ga[:-1], True][: len(ga)], np.r_[gb[1:] != gb[:-1], True][: len(gb)]
        code_a, code_b = made["ids_a"] * 3 + end_a, made["ids_b"] * 3 + 2 * end_b
        groups = int(ga[-1]) + 1 if len(ga) else 0
        before = np.r_[0, np.cumsum(np.bincount(gb, minlength=groups))][ga]  # tokens of B in the groups before
        up_to = np.cumsum(np.bincount(ga, minlength=groups))[gb]
        code = np.empty(len(ga) + len(gb), np.int64)
        code[np.arange(len(ga)) + before] = code_a
        code[np.arange(len(gb)) + up_to] = code_b + 3 * len(self.a.bytes_of)
        signs = list(map(self.names.__getitem__, code.tolist()))
        ends = np.cumsum(made["n_a"] + made["n_b"]).tolist()
        return ["".join(signs[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def loaded(path_a: str, path_b: str) -> Aligner:
    """The tokenizers of a Python worker; later tasks of the worker go on with them."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    return Aligner(path_a, path_b)


def listed(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(values, kind))


def align_texts(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, group_a, group_b, overlaps): token ids, the group of each token, and overlap links (place in a, place in b, bytes shared)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(path_a, path_b)
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                made = aligner.align(part.column("text").to_pylist())
                over, n_a, n_b = made["overlaps"], made["n_a"], made["n_b"]
                first_a, first_b, ends = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, np.cumsum(n_a)
                rows, row_text = over.rows(), np.repeat(np.arange(len(n_a)), n_a)
                text = row_text[rows]
                groups = np.cumsum(made["n_groups"]) - made["n_groups"]
                links = pa.StructArray.from_arrays([pa.array(rows - first_a[text], pa.int64()), pa.array(over.col - first_b[text], pa.int64()), pa.array(over.val, pa.int64())], names=["i", "j", "n"])
                n_over = over.ptr[ends] - over.ptr[ends - n_a]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), listed(made["ids_a"], n_a, pa.int32()), listed(made["ids_b"], n_b, pa.int32()), listed(made["group_a"] - groups[row_text], n_a, pa.int64()),
                     listed(made["group_b"] - np.repeat(groups, n_b), n_b, pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_over)], pa.int32()), links)],
                    names=["id", "a", "b", "group_a", "group_b", "overlaps"],
                )

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, a array<int>, b array<int>, group_a array<bigint>, group_b array<bigint>, overlaps array<struct<i:bigint,j:bigint,n:bigint>>")
    return out.withColumnRenamed("id", id_col)


def link_rows(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs, links) of each text: different id pairs (a * pieces of B + b) and how often they are linked."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(path_a, path_b)
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                made = aligner.align(part.column("text").to_pylist())
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in aligner.written_groups(made)]
                ends = np.cumsum(made["n_a"])
                n_over = made["overlaps"].ptr[ends] - made["overlaps"].ptr[ends - made["n_a"]]
                numbers = [pa.array(x, pa.int64()) for x in (made["n_a"], made["n_b"], made["n_groups"], made["n_links"], n_over)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *numbers, pa.array(sha, pa.string()), listed(made["pairs"], made["n_pairs"], pa.int64()), listed(made["links"], made["n_pairs"], pa.int64())], names=names)

    numbers = ", ".join(f"{n} bigint" for n in names[1:6])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {numbers}, groups_sha256 string, pairs array<bigint>, links array<bigint>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether that is the highest count of its id of A."""
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    of_a = F.floor(F.col("pair") / n_b).cast("int").alias("a")
    most = counts.groupBy(of_a).agg(F.max("n").alias("most"))
    # one row for each id of A at most: bounded by the vocabulary
    return counts.withColumn("a", of_a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def least_of_head(counts: DataFrame) -> int:
    """The least count that at most HEAD pairs reach, by a histogram of 64 bins for each power of two."""
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 64)).cast("int")
    bins = counts.groupBy(F.when(F.col("n") < 64, 0).otherwise(1).alias("wide"), level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    least, held = 1 << 62, 0
    for b in sorted(bins, key=lambda b: -b["n"]):
        held += b["k"]
        if held > HEAD:
            break
        least = b["n"]
    return least


def align_corpus(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256) of each text; pairs are counted over all texts."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = stage(link_rows(df, path_a, path_b, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "links")
    counts = stage(pair_counts(rows, n_b), "counts")
    head = counts.where(F.col("n") >= least_of_head(counts)).toArrow()
    order = np.argsort(np.asarray(head.column("pair")))
    sent = df.sparkSession.sparkContext.broadcast((np.asarray(head.column("pair"))[order], np.asarray(head.column("n"))[order], np.asarray(head.column("best").to_numpy(zero_copy_only=False), bool)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            lists, links = batch.column("pairs"), batch.column("links").flatten().to_numpy()
            pair, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            at, w = at[hit], links[hit]
            first = np.searchsorted(row[hit], np.arange(len(size) + 1))
            total, won = np.r_[0, np.cumsum(w * n[at])], np.r_[0, np.cumsum(w * best[at])]
            left = [listed(x[~hit], np.bincount(row[~hit], minlength=len(size)), pa.int64()) for x in (pair, links)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(won[first[1:]] - won[first[:-1]], pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], pa.int64()), *left], names=["rid", "n_best", "count_sum", "pairs", "links"]
            )

    known = stage(rows.select("rid", "pairs", "links").mapInArrow(run, "rid bigint, n_best bigint, count_sum bigint, pairs array<bigint>, links array<bigint>"), "known")
    rest = known.where(F.size("pairs") > 0).select("rid", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.links").alias("w"))
    more = rest.join(counts, "pair").groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("w")).otherwise(0)).alias("b"), F.sum(F.col("w") * F.col("n")).alias("c"))
    done = rows.drop("pairs", "links").join(known.select("rid", "n_best", "count_sum"), "rid").join(more, "rid", "left")
    return done.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_overlaps", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"), "groups_sha256"
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_corpus(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_alignment": op13_alignment}
