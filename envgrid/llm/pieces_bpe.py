"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text becomes the symbols of its characters, blanks written as U+2581 after one added blank. The agenda holds the
adjacent symbol pairs whose concatenation is a piece, ordered by the piece's score and then by position; the best pair
is merged and the pairs beside it enter the agenda, until none is left. No piece holds U+2581 after another character,
so no merge crosses the front of a word: a text's segments (blanks, then a word) are encoded on their own, each distinct
segment once. The agendas of all new segments of an Arrow batch advance together in numpy arrays, one merge for each
segment and round. Characters outside the vocabulary become byte pieces. The sentencepiece library encodes the same new
segments of each batch, and a difference raises an error.

Null and empty texts have no ids and decode to the empty text; an empty table gives an empty result; pairs of one score
are merged from the left. Repeated rows give repeated results, extra columns are
ignored, very long texts are segments like any others. Rows are independent, so nothing shuffles; memory holds a slice
of a batch and a cache of at most CACHE segments, which affects speed only.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from envgrid.llm.common import map_texts, read

BLANK = "▁"
CACHE = 300_000
#: Segments above this many characters get a heap of their own.
LONG = 200
HASH, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Longer segments don't enter the cache.
CACHE_CHARS = 64
SEGMENT = re.compile("▁*[^▁]+|▁+")
NONE = np.iinfo(np.int64).max


class MergeVocabulary:
    """The pieces of a sentencepiece BPE model, with the table of mergeable pairs."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in normal):
            raise ValueError("a piece holds a blank after another character")
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        #: Symbols are piece ids; characters that occur in pieces without being one get numbers above.
        symbol = {self.pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in self.pieces[i]} - symbol.keys()):
            symbol[c] = n + len(symbol)
        self.char_symbol = {c: s for c, s in symbol.items() if len(c) == 1}
        self.n_pieces = n
        scores = sorted({-sp.get_score(i) for i in normal})
        rank = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = (rank[-sp.get_score(i)], i)
        self.pairs = pairs
        self.rare_symbol = {s: c for c, s in self.char_symbol.items() if s >= n}
        # the pairs once more as an open hash table, for whole arrays at once
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64)
        self.ranks, self.merged = np.full(1 << bits, NONE, np.int64), np.zeros(1 << bits, np.int64)
        self.probes = 1
        for key, (r, i) in pairs.items():
            at, k = int((key * HASH & MASK) >> int(self.shift)), 1
            while self.slots[at] >= 0:
                at, k = (at + 1) & (len(self.slots) - 1), k + 1
            self.slots[at], self.ranks[at], self.merged[at] = key, r, i
            self.probes = max(self.probes, k)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, or NONE; slot) of the pairs; unknown characters are negative and match no key."""
        key = np.where((left >= 0) & (right >= 0), (left << 32) | right, -2)
        at = ((key.astype(np.uint64) * np.uint64(HASH)) >> self.shift).astype(np.int64)
        rank, slot = np.full(len(key), NONE, np.int64), at
        hit = self.slots[at] == key
        rank[hit] = self.ranks[at[hit]]
        open_ = np.flatnonzero(~hit & (self.slots[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            now = self.slots[at[open_]]
            found = open_[now == key[open_]]
            rank[found] = self.ranks[at[found]]
            open_ = open_[(now >= 0) & (now != key[open_])]
        return rank, slot

    def agenda(self, segment: str) -> list[int]:
        """Ids of one long segment, with a heap of (rank, position) over linked symbols."""
        sym = [self.char_symbol.get(c, -1 - ord(c)) for c in segment]
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, sym[i], sym[i + 1], r[1]) for i in range(n - 1) if (r := self.pairs.get((sym[i] << 32) | sym[i + 1]))]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], dead[j], after[i] = made, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and (q := after[p]) >= 0 and sym[p] >= 0 and sym[q] >= 0 and (r := self.pairs.get((sym[p] << 32) | sym[q])):
                    heapq.heappush(heap, (r[0], p, sym[p], sym[q], r[1]))
        return self._expand([s for s, d in zip(sym, dead, strict=True) if not d])

    def merge(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment, from agendas that advance together."""
        if not segments:
            return []
        if any(len(s) > LONG for s in segments):
            short = iter(self.merge([s for s in segments if len(s) <= LONG]))
            return [self.agenda(s) if len(s) > LONG else next(short) for s in segments]
        out: list[list[int]] = [[]] * len(segments)
        text = "".join(segments)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars, inverse = np.unique(codes, return_inverse=True)
        table = np.array([self.char_symbol.get(chr(c), -1 - int(c)) for c in chars], np.int64)
        sym = table[inverse]
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        same = owner[:-1] == owner[1:]
        rank = np.full(len(sym), NONE, np.int64)  # of the pair that begins here
        into = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            r, into[:-1] = self._lookup(sym[:-1], sym[1:])
            rank[:-1] = np.where(same, r, NONE)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            size = np.diff(np.r_[starts, len(sym)])
            if done.any():  # these segments are finished
                over = np.repeat(done, size)
                ids, end = sym[over].tolist(), np.cumsum(size[done]).tolist()
                odd = np.logical_or.reduceat((sym < 0) | (sym >= self.n_pieces), starts)[done].tolist()
                for o, i, j, x in zip(owner[starts[done]].tolist(), [0, *end], end, odd, strict=False):
                    out[o] = self._expand(ids[i:j]) if x else ids[i:j]
                left = ~over
                sym, owner, rank, into = sym[left], owner[left], rank[left], into[left]
                if not len(sym):
                    break
                best, size = best[~done], size[~done]
                starts = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(best, size))
            at = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]  # of equal scores the leftmost
            sym[at] = self.merged[into[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            stay = ~gone
            moved = np.cumsum(stay) - 1
            at = moved[at]
            sym, owner, rank, into = sym[stay], owner[stay], rank[stay], into[stay]
            for p in (at, at - 1):  # new pairs: with the right and the left neighbour
                p = p[p >= 0]
                q = np.minimum(p + 1, len(sym) - 1)
                r, w = self._lookup(sym[p], sym[q])
                rank[p] = np.where((q > p) & (owner[p] == owner[q]), r, NONE)
                into[p] = w
        return out

    def _expand(self, symbols: list[int]) -> list[int]:
        """Unknown characters as byte pieces."""
        ids: list[int] = []
        for s in symbols:
            if 0 <= s < self.n_pieces:
                ids.append(s)
            else:
                c = chr(-1 - s) if s < 0 else self.rare_symbol[s]
                ids += [self.byte_ids[b] for b in c.encode()]
        return ids

    def check(self, segments: list[str], ids: list[list[int]]) -> None:
        """Raises if the library encodes a segment (a blank, which the library adds itself, and more) in another way."""
        fronted = [(s, i) for s, i in zip(segments, ids, strict=True) if s[0] == BLANK and len(s) > 1]
        for (s, i), theirs in zip(fronted, self.library.encode([s[1:] for s, _ in fronted], num_threads=1), strict=True):
            if i != theirs:
                raise ValueError(f"the library encodes {s!r} as {theirs}, not {i}")

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.segments(t) for t in texts]
        new = list(set(chain.from_iterable(split)))
        ids = dict(zip(new, self.merge(new), strict=True))
        return [list(chain.from_iterable(ids[s] for s in part)) for part in split]

    def decode(self, ids: list[int]) -> str:
        """The library's decode: pieces joined, blanks restored, the added blank removed, bytes that are no UTF-8 replaced."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def loaded(model_path: str) -> tuple[MergeVocabulary, dict[str, tuple[str, int, bytes]]]:
    """The vocabulary and the known segments of a Python worker; later tasks of the worker go on with them."""
    return MergeVocabulary(model_path), {}


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", checked: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded string) of each text."""
    def make():
        vocab, _ = loaded(model_path)

        def run(texts: list) -> dict:
            ids = vocab.encode([t or "" for t in texts])
            if checked:
                vocab.check([BLANK + t.replace(" ", BLANK) for t in texts if t], [i for i, t in zip(ids, texts, strict=True) if t])
            return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(vocab.decode, ids), pa.string())}

        return run

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, make, f"{id_col} {kind}, ids array<int>, decoded string", text_col, (id_col,))


def encode_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what encode_texts gives, without moving the ids out of the task."""
    def make():
        vocab, known = loaded(model_path)

        def run(texts: list) -> dict:
            split = [vocab.segments(t or "") for t in texts]
            distinct = set(chain.from_iterable(split))
            new = list(distinct.difference(known))
            made = vocab.merge(new)
            vocab.check(new, made)
            if len(known) + len(new) > CACHE:
                for s in [s for s in known if s not in distinct]:
                    del known[s]
            for s, ids in zip(new, made, strict=True):
                known[s] = (",".join(map(str, ids)), len(ids), b"".join([vocab.bytes_of[i] for i in ids]))
            n, sha, back = [], [], []
            for part in split:
                rows = [known[s] for s in part]
                n.append(sum([r[1] for r in rows]))
                sha.append(hashlib.sha256(",".join([r[0] for r in rows]).encode()).hexdigest())
                raw = b"".join([r[2] for r in rows])
                back.append(hashlib.sha256((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace").encode()).hexdigest())
            for s in new:
                if len(s) > CACHE_CHARS:
                    del known[s]
            return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

        return run

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, make, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text_col, (id_col,))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_pieces": op1_pieces}
