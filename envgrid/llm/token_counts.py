"""Token counts from finite-state tokenizers.

Two deterministic transducers stand for a tokenizer of words with a BPE vocabulary whose last symbol of a word is marked.

The first cuts text into words. Its alphabet is the character classes, its few states say what is open (a run of letters,
a run of other signs, a possible contraction). A slice of texts is one sequence of classes, dealt into chunks of CHUNK
characters; each chunk's map from entry state to exit state is computed for all states at once, the maps are composed by
a parallel prefix scan (log2 of the number of chunks rounds), and a last pass marks the fronts of words.

The second reads a word's bytes. A sequence of tokens is the vocabulary's encoding of its text if and only if each two
neighbours are the encoding of their own text, so the last token of each prefix of a word is known from the prefixes
before it. A state holds, for each suffix that begins a token, its trie node, the token before it and how many more
tokens it has than the least; a transition is annotated with the count that all of them emit. States are compiled when a
text first reaches them, and the counts of frequent words are kept; both stores are bounded and affect speed only.

A word whose encoding isn't known by neighbours (none of this vocabulary) is encoded by a heap of merges instead.

Classes of characters are the tokenizer library's own. Null and empty texts have no tokens; an empty table gives an empty result; ties can't arise but between merges of one
rank, of which the leftmost comes first. Special tokens inside a text count as the library has it by default, one each.
Repeated rows give repeated results; extra columns are ignored; a text or a word of any length is read once, in whole.
Rows are independent, so nothing shuffles.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import map_texts, read

CHUNK = 256
WORDS = 400_000
TRANSITIONS = 400_000
LIMIT = 2048

# The classes of characters and the states of the word transducer.
LETTER, NUMBER, SPACE, OTHER, QUOTE, STMD, R, V, LL, E = range(10)
FREE, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)


#: A character whose class has not been asked for.
UNKNOWN = 255


class Characters:
    """Classes of characters and the normal form of texts, as the tokenizer's own library has them.

    Each character that is not ASCII is shown to the library's pre-tokenizer when a text first holds it; whatever Unicode version the
    library knows, its classes hold. Texts are normalised by the interpreter's tables, which is faster, but for those
    with a character that the two treat otherwise, or that the interpreter doesn't know: these are normalised by the library.
    """

    def __init__(self, library):
        self.library = library
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(128):
            self.classes[c] = self.asked(chr(c))
        for chars, k in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", LL), ("e", E)):
            self.classes[[ord(c) for c in chars]] = k
        self.seen, self.odd = {chr(c) for c in range(128)}, set()

    def asked(self, c: str) -> int:
        cut = lambda s: {at for _, at in self.library.pre_tokenizer.pre_tokenize_str(s)}
        if (0, 2) in cut("x" + c):
            return LETTER
        beside = cut("!" + c)
        return OTHER if (0, 2) in beside else NUMBER if (1, 2) in beside else SPACE

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.classes[codes]
        if (out == UNKNOWN).any():
            for c in np.unique(codes[out == UNKNOWN]).tolist():
                self.classes[c] = self.asked(chr(c))
            out = self.classes[codes]
        return out

    @staticmethod
    def folded(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def normal(self, text: str) -> str:
        for c in set(text) - self.seen:
            self.seen.add(c)
            probe = f"a{c}\u0323 \u0301{c}\u0323"
            if unicodedata.category(c) == "Cn" or self.words(self.library.normalizer.normalize_str(probe)) != self.words(self.folded(probe)):
                self.odd.add(c)
        if self.odd and not self.odd.isdisjoint(text):
            return self.library.normalizer.normalize_str(text)
        return self.folded(text)

    @staticmethod
    def words(text: str) -> list[str]:
        """Without white space, which the library writes as blanks."""
        return text.split()


def word_transducer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, a word starts here, a word started one character before) by state and class."""
    step, here, back = (np.zeros((7, 10), np.uint8) for _ in range(3))
    for c in range(10):
        letter = c in (LETTER, STMD, R, V, LL, E)
        fresh = LETTERS if letter else QUOTED if c == QUOTE else OTHERS if c == OTHER else FREE
        for s in (FREE, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L):
            step[s, c], here[s, c] = fresh, c != SPACE
        if letter:
            step[LETTERS, c], here[LETTERS, c] = LETTERS, 0
        if c in (OTHER, QUOTE):
            for s in (OTHERS, QUOTED):
                step[s, c], here[s, c] = OTHERS, 0
        for s in (QUOTED_R, QUOTED_V, QUOTED_L):  # the quote alone, then a run of letters that began one before
            back[s, c] = 1
            if letter:
                step[s, c], here[s, c] = LETTERS, 0
    for c, s in ((STMD, FREE), (R, QUOTED_R), (V, QUOTED_V), (LL, QUOTED_L)):
        step[QUOTED, c], here[QUOTED, c] = s, 0
    for s, c in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, LL)):
        step[s, c], here[s, c], back[s, c] = FREE, 0, 0
    return step, here, back


STEP, HERE, BACK = word_transducer()


def entry_states(classes: np.ndarray) -> np.ndarray:
    """State before each character of classes (chunks x CHUNK), the first chunk entered in FREE."""
    n = len(classes)
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], n, axis=1)
    for k in range(CHUNK):
        maps = STEP[maps, classes[:, k]]
    hop = 1
    while hop < n:  # afterwards maps[:, i] composes all chunks up to i
        maps[:, hop:] = np.take_along_axis(maps[:, hop:], maps[:, :-hop].copy(), axis=0)
        hop *= 2
    state = np.r_[np.uint8(FREE), maps[FREE, :-1]]
    out = np.empty_like(classes)
    for k in range(CHUNK):
        out[:, k] = state
        state = STEP[state, classes[:, k]]
    return out


def cut_words(text: str, characters: Characters) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of text, in characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(codes)
    c = np.full(-(-n // CHUNK) * CHUNK + CHUNK, SPACE, np.uint8)
    c[:n] = characters.of(codes)
    state = entry_states(c.reshape(-1, CHUNK)).ravel()
    at = state.astype(np.int64) * 10 + c
    start = HERE.ravel()[at].astype(bool)
    start[:-1] |= BACK.ravel()[at[1:]].astype(bool)
    edge = np.flatnonzero(start | (c == SPACE))
    first = np.flatnonzero(start[edge])
    return edge[first], edge[np.minimum(first + 1, len(edge) - 1)]


def byte_signs() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class CountTransducer:
    """Counts the tokens of words; compiled from a tokenizer file as texts need it."""

    END = 256  # added to the code of a word's last byte

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        signs = {s: b for b, s in enumerate(byte_signs())}

        def symbols(token: str) -> tuple[int, ...]:
            end = token.endswith(suffix)
            out = [signs[c] for c in (token[: -len(suffix)] if end else token)]
            return (*out[:-1], out[-1] + self.END) if end else tuple(out)

        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.token = [()] * (max(model["vocab"].values()) + 1)
        for t, i in model["vocab"].items():
            self.token[i] = symbols(t)
        ids = {t: i for i, t in enumerate(self.token)}
        self.single = {t[0]: i for t, i in ids.items() if len(t) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(model["vocab"][a], model["vocab"][b]): (k, model["vocab"][a + b]) for k, (a, b) in enumerate(pairs)}
        # trie: children by symbol; own[node]: the token that ends there, if the vocabulary encodes its text as itself
        self.child: list[dict[int, int]] = [{}]
        self.own: list[int] = [-1]
        for i, t in enumerate(self.token):
            if self.encode(t) == [i]:
                node = 0
                for c in t:
                    node = self.child[node].setdefault(c, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                        self.own.append(-1)
                self.own[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.number, self.step = [first], {first: 0}, {}

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Merges in the order of rank, leftmost first: the definition, by a heap of neighbours."""
        ids = [self.single[c] for c in symbols]
        behind, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*self.ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heap = [(k, i, made, ids[i], ids[i + 1]) for k, made, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, one, two = heapq.heappop(heap)
            j = behind[i] if ids[i] >= 0 else len(ids)
            if ids[i] != one or j >= len(ids) or ids[j] != two:
                continue  # one of the two has been merged since
            ids[i], ids[j], behind[i] = made, -1, behind[j]
            if behind[i] < len(ids):
                before[behind[i]] = i
            for a, b in ((before[i], i), (i, behind[i])):
                if a >= 0 and b < len(ids) and (found := self.ranks.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1], ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def neighbours(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 2 * TRANSITIONS:
                self.fits.clear()
            found = self.fits[a, b] = self.encode(self.token[a] + self.token[b]) == [a, b]
        return found

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens emitted) after symbol; a word's last symbol emits all that is left."""
        moved, last = [], []
        for node, before, more in self.states[state]:
            to = self.child[node].get(symbol)
            if to is None:
                continue
            token = self.own[to]
            if token >= 0 and (before < 0 or self.neighbours(before, token)):
                last.append((0, token, more + 1))
            if self.child[to]:
                moved.append((to, before, more))
        if len(last) != 1:
            raise LookupError  # the vocabulary is none of the kind whose encodings are known by neighbours
        if symbol >= self.END:
            return 0, last[0][2]
        new = sorted(moved + last)
        least = min(m for _, _, m in new)
        key = tuple((a, b, m - least) for a, b, m in new)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        return number, least

    def count(self, word: str) -> int:
        raw = word.encode()
        if len(self.step) > TRANSITIONS:
            self.reset()
        step, state, total = self.step, 0, 0
        try:
            for c in (*raw[:-1], raw[-1] + self.END):
                key = state << 9 | c
                found = step.get(key)
                if found is None:
                    found = step[key] = self.compile(state, c)
                state = found[0]
                total += found[1]
            return total
        except LookupError:
            return len(self.encode((*raw[:-1], raw[-1] + self.END)))


class TextCounter:
    """Both transducers and the counts of known words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.machine, self.characters = CountTransducer(path), Characters(Tokenizer.from_file(path))
        self.known: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, self.machine.specials))) if self.machine.specials else None

    def plain(self, text: str | None) -> tuple[str, int]:
        """Normalised as the tokenizer does it, and the number of special tokens, which part a text."""
        if not text:
            return "", 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return "\n".join(self.characters.normal(p) for p in parts), len(parts) - 1
        return self.characters.normal(text), 0

    def counts(self, texts: list) -> np.ndarray:
        known, made = self.known, [self.plain(t) for t in texts]
        whole = "\n".join(t for t, _ in made)
        starts, ends = cut_words(whole, self.characters)
        words = [whole[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = set(words).difference(known)
        if len(known) + len(new) > WORDS:
            now = set(words)
            for w in [w for w in known if w not in now]:
                del known[w]
        for w in new:
            known[w] = self.machine.count(w)
        counts = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))])
        for w in new:
            if len(w) > 64:
                del known[w]
        at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t, _ in made)]))
        return counts[at[1:]] - counts[at[:-1]] + np.array([k for _, k in made], np.int64)


@lru_cache(maxsize=1)
def compiled(tokenizer_path: str) -> TextCounter:
    """The transducers and the known words of a Python worker; later tasks of the worker go on with them."""
    return TextCounter(tokenizer_path)


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each text."""
    def make():
        counter = compiled(tokenizer_path)
        return lambda texts: {"n_tokens": pa.array(counter.counts(texts), pa.int64())}

    kind = df.schema[id_col].dataType.simpleString()
    sized = df.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = map_texts(sized, make, f"{id_col} {kind}, n_bytes long, n_tokens long", "text", (id_col, "n_bytes"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
