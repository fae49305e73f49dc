"""Toxicity scores from a gap-weighted subsequence kernel, Nyström landmarks and a support vector machine.

The kernel of two words sums lambda^(length spanned) over their common subsequences of ORDER letters, so an insult with
letters put in or left out stays close to itself. Words are lower-cased, stripped to letters and digits and get a front
mark; runs of single letters are read as one word. Landmarks are words and parts of words that set toxic training texts
apart, picked so that each covers texts that the others leave. A text's value for a landmark is log(1 + sum) of the kernel
values of its distinct words, related to the landmark's own and sharpened by a power. Words that hold all letters of a
strong landmark in their order also have the value of a second kernel, whose decay SLACK hardly counts gaps: a letter or
digit put into every gap of an insult changes little. The Nyström map (inverse roots of the landmarks' two kernel
matrices) makes these values the coordinates of a linear support vector machine with squared hinge loss, and a logistic
curve fitted to its margins gives the score. Training instances are the labelled texts and, at the weight HEFT, of toxic
ones the sentences that hold a strong landmark: as they are, with a letter in each such word, and with one in every gap.

The fit takes at most FIT_ROWS labelled rows and FIT_BYTES of text, in the order of a hash of the id, whatever the size of
the corpus; it runs on the driver. Scoring reads each text in whole, row by row, and shuffles nothing. Values under
LEAST (in the second kernel, CUT) count as none, so that a long text doesn't add up to an insult from many words that
are a little like one; nor have words a value that lack most of a landmark's letter pairs (up to GAP letters apart).
Measured on held-out rows, values without these limits make far more mistakes. Null and empty texts get the score of a
text without words; without both labels in the training rows all scores are the share of label 1. Repeated rows give
repeated results; texts and words of any length are read in whole (words in overlapping windows); extra columns are
ignored; the labels of an id that is given twice count once, by the largest; an empty table gives an empty result; ties
between landmarks go to the longer one, then by letters.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envgrid.llm.common import map_texts, read

FIT_ROWS, FIT_BYTES = 4000, 32 << 20
LANDMARKS = 48
ORDER, DECAY, POWER = 3, 0.8, 3
HEFT = 0.1  # weight of a sentence beside a text in training
SLACK = 0.97  # the second kernel's decay, for words with all letters of a strong landmark
LEAST, CUT = 0.3, 0.6  # smaller values of the two kernels count as none
GAP, PAIRS = 3, 0.8  # share of a landmark's letter pairs that a word has, up to GAP letters apart
FRONT = "^"  # stands before each word
SHORTEST, LONGEST = 4, 10  # characters of a landmark
STRONG = 30  # times as frequent in texts of label 1: such a landmark marks the sentence that it is in
WIDTH = 24  # longer words are cut into windows
STEP = WIDTH - (2 * LONGEST - 2)  # between windows: a landmark with a letter in every gap lies whole in one of them
KNOWN = 300_000

LETTERS = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")
BLANK = re.compile(r"[^ \t-\r]+")

def words_of(text: str) -> set[str]:
    """Distinct words of a text, lower-case, letters and digits only; three or more single letters in a row also as one word."""
    out: set[str] = set()
    run: list[str] = []
    for w in BLANK.findall(text.lower()):
        if not w.isalnum():
            w = "".join(LETTERS.findall(w))
        if len(w) == 1:
            run.append(w)
            continue
        if run:
            if len(run) > 2:
                out.add(FRONT + "".join(run))
            run = []
        if w:
            out.add(FRONT + w)
    if len(run) > 2:
        out.add(FRONT + "".join(run))
    return out

def windows(word: str) -> list[str]:
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH + STEP, STEP)]

def padded(words: list[str]) -> np.ndarray:
    """Code points of words of up to WIDTH characters, 0 behind."""
    n = np.array([len(w) for w in words])
    out = np.zeros((len(words), WIDTH), np.uint32)
    out[np.arange(WIDTH)[None, :] < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out

def kernel(s: np.ndarray, t: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernels of ORDER of the rows of s with those of t, both padded by 0 (in t by columns that may be cut)."""
    n, m = s.shape[1], t.shape[1]
    d2 = decay * decay
    equal = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] > 0)
    below = np.ones((len(s), n + 1, m + 1))
    for _ in range(ORDER - 1):
        now = np.zeros_like(below)
        for a in range(1, n + 1):
            row = np.zeros((len(s), m + 1))
            for b in range(1, m + 1):
                row[:, b] = decay * row[:, b - 1] + d2 * equal[:, a - 1, b - 1] * below[:, a - 1, b - 1]
            now[:, a] = decay * now[:, a - 1] + row
        below = now
    return d2 * (equal * below[:, :-1, :-1]).sum(axis=(1, 2))

class Landmarks:
    """Kernel values of words with a few landmark words."""

    def __init__(self, landmarks: list[str], strong: list[bool]):
        self.names, self.strong = landmarks, strong
        self.codes = padded(landmarks)[:, :LONGEST]
        self.own = kernel(self.codes, self.codes)
        self.own_slack = kernel(self.codes, self.codes, SLACK)
        pairs = sorted({p for w in landmarks for p in zip(w, w[1:], strict=False)})
        letters = sorted({c for p in pairs for c in p})
        self.letter = {ord(c): i + 1 for i, c in enumerate(letters)}
        self.size = len(letters) + 1
        self.limbs = (len(pairs) + 63) // 64
        self.bits = np.zeros((self.limbs, self.size * self.size), np.uint64)
        number = {p: i for i, p in enumerate(pairs)}
        for (a, b), i in number.items():
            self.bits[i // 64, self.letter[ord(a)] * self.size + self.letter[ord(b)]] = np.uint64(1 << (i % 64))
        self.needs = np.zeros((len(landmarks), self.limbs), np.uint64)
        self.least = np.zeros(len(landmarks), np.int64)
        for k, w in enumerate(landmarks):
            mine = {number[p] for p in zip(w, w[1:], strict=False)}
            for i in mine:
                self.needs[k, i // 64] |= np.uint64(1 << (i % 64))
            self.least[k] = max(1, math.ceil(PAIRS * len(mine)))
        # both kernels of the landmarks with each other, as two blocks
        m = len(landmarks)
        i, j = np.divmod(np.arange(m * m), m)
        self.matrix = np.zeros((2 * m, 2 * m))
        for at, decay, own in ((0, DECAY, self.own), (m, SLACK, self.own_slack)):
            k = kernel(self.codes[i], self.codes[j], decay).reshape(m, m)
            self.matrix[at : at + m, at : at + m] = (k / np.sqrt(np.outer(own, own))) ** POWER

    def values(self, words: list[str]) -> list[tuple[tuple[int, float], ...]]:
        """For each word of up to WIDTH characters the landmarks that it is close to, with its values; those of the second kernel count on behind the first's."""
        if not words:
            return []
        chars = padded(words)
        kinds, inverse = np.unique(chars, return_inverse=True)
        small = np.array([self.letter.get(int(c), 0) for c in kinds])[inverse].reshape(chars.shape)
        have = np.zeros((self.limbs, len(words)), np.uint64)
        for d in range(1, GAP + 1):
            code = small[:, :-d] * self.size + small[:, d:]
            for x in range(self.limbs):
                have[x] |= np.bitwise_or.reduce(self.bits[x][code], axis=1)
        out: list[list[tuple[int, float]]] = [[] for _ in words]
        rows, marks = [], []
        # places of letters: a word has a landmark's letters in order only if it has each neighbouring pair in order
        first, last = np.full((len(words), self.size), WIDTH, np.int8), np.full((len(words), self.size), -1, np.int8)
        row = np.arange(len(words))
        for c in range(WIDTH):
            last[row, small[:, c]] = c
            first[row, small[:, WIDTH - 1 - c]] = WIDTH - 1 - c
        slack_rows, slack_marks = [], []
        for k in range(len(self.names)):
            shared = sum(np.bitwise_count(have[x] & self.needs[k, x]).astype(np.int64) for x in range(self.limbs))
            hit = np.flatnonzero(shared >= self.least[k])
            rows.append(hit)
            marks.append(np.full(len(hit), k))
            if not self.strong[k]:
                continue
            whole = np.ones(len(words), bool)
            for a, b in zip(self.names[k], self.names[k][1:], strict=False):
                whole &= first[:, self.letter[ord(a)]] < last[:, self.letter[ord(b)]]
            hit = np.flatnonzero(whole)
            slack_rows.append(hit)
            slack_marks.append(np.full(len(hit), k))
        for hits, of, decay, own, least, at0 in ((rows, marks, DECAY, self.own, LEAST, 0), (slack_rows, slack_marks, SLACK, self.own_slack, CUT, len(self.names))):
            row, mark = np.concatenate([np.zeros(0, np.int64), *hits]), np.concatenate([np.zeros(0, np.int64), *of])
            for at in range(0, len(row), 4096):
                r, k = row[at : at + 4096], mark[at : at + 4096]
                value = np.minimum(1.0, kernel(chars[r], self.codes[k], decay) / own[k]) ** POWER
                for i, j, v in zip(r.tolist(), k.tolist(), value.tolist(), strict=True):
                    if v > least:
                        out[i].append((at0 + j, v))
        return [tuple(x) for x in out]

class TextValues:
    """Values of texts: for each landmark the sum over the text's different words, of a long word's windows the largest, on a logarithmic scale. Keeps the values of frequent words."""

    def __init__(self, landmarks: list[str], strong: list[bool]):
        self.marks, self.known = Landmarks(landmarks, strong), {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        sets = [words_of(t) for t in texts]
        new = sorted(set().union(*sets) - self.known.keys()) if sets else []
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = sorted(set().union(*sets))
        parts = [windows(w) for w in new]
        found = iter(self.marks.values([p for w in parts for p in w]))
        for w, p in zip(new, parts, strict=True):
            best: dict[int, float] = {}
            for k, x in (x for _ in p for x in next(found)):
                best[k] = max(x, best.get(k, 0.0))
            self.known[w] = tuple(best.items()) or None
        out = np.zeros((len(texts), 2 * len(self.marks.names)))
        for i, s in enumerate(sets):
            for w in s:
                if v := self.known[w]:
                    for k, x in v:
                        out[i, k] += x
        for w in new:
            if len(w) > WIDTH:
                del self.known[w]
        return np.log1p(out)

def pick_landmarks(texts: list[str], labels: list[int]) -> tuple[list[str], list[bool]]:
    """Words and parts of words that mark label 1, each picked for the label-1 texts that others leave; and which are strong."""
    toxic = [words_of(t) for t, y in zip(texts, labels, strict=True) if y]
    clean = Counter(w for t, y in zip(texts, labels, strict=True) if not y for w in words_of(t))
    n_toxic, n_clean = len(toxic), len(texts) - len(toxic)

    def parts(w: str) -> set[str]:
        return {w[i:j] for i in range(len(w)) for j in range(i + SHORTEST, min(len(w), i + LONGEST) + 1)}

    seen: Counter = Counter()
    for s in toxic:
        seen.update(set().union(*(parts(w) for w in s)) if s else ())
    likely = {p for p, k in seen.items() if k >= max(3, 0.01 * n_toxic)}
    against: Counter = Counter()
    for w, k in clean.items():
        for p in parts(w) & likely:
            against[p] += k
    score = {p: seen[p] / n_toxic * math.log((seen[p] + 0.5) / (n_toxic + 1) / ((against[p] + 0.5) / (n_clean + 1))) for p in likely}
    best = {p for p in likely if score[p] > 0 and against[p] * n_toxic < 0.2 * seen[p] * n_clean}
    holds: dict[str, list[int]] = {p: [] for p in best}
    for i, s in enumerate(toxic):
        for p in set().union(*(parts(w) & best for w in s)) if s else ():
            holds[p].append(i)
    covered = np.zeros(max(1, n_toxic), np.int64)

    def gain(p: str) -> float:
        """What a further landmark adds: a text counts a quarter for each landmark that it has."""
        return round(float((0.25 ** covered[holds[p]]).sum()) * score[p] / seen[p], 9)

    # gains only fall, so the first whose gain is up to date is the greatest
    queue = [(-gain(p), -len(p), p) for p in best]
    heapq.heapify(queue)
    out: list[str] = []
    while queue and len(out) < LANDMARKS:
        g, _, p = heapq.heappop(queue)
        if any(p in q or q in p for q in out):
            continue
        if (now := gain(p)) < -g:
            heapq.heappush(queue, (-now, -len(p), p))
            continue
        if (0.25 ** covered[holds[p]]).sum() < 1.5:
            break
        out.append(p)
        covered[holds[p]] += 1
    return out, [seen[p] * n_clean >= STRONG * max(1, against[p]) * n_toxic for p in out]

def disguised(word: str) -> tuple[str, str]:
    """The word with a letter in its middle, and with one in every gap."""
    m = len(word) // 2
    return word[:m] + "x" + word[m:], "x".join(word)

class Model:
    """Landmarks, the weights of their values, and the logistic curve over the margin."""

    def __init__(self, landmarks: list[str], strong: list[bool], weights: np.ndarray, bias: float, share: float):
        self.landmarks, self.strong, self.weights, self.bias, self.share = landmarks, strong, weights, bias, share

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(values @ self.weights + self.bias, -30, 30)))

def fit_model(texts: list[str], labels: list[int]) -> Model:
    """The machine of the given labelled texts."""
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    landmarks, strong = pick_landmarks(texts, labels) if 0 < share < 1 else ([], [])
    if not landmarks:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model([], [], np.zeros(0), math.log(p / (1 - p)), share)
    of = TextValues(landmarks, strong)
    firm, more = np.r_[np.array(strong), np.zeros(len(strong), bool)], []
    for t, l in zip(texts, labels, strict=True):
        parts = SENTENCE.split(t) if l else []
        hits = [p for p, v in zip(parts, of(parts), strict=True) if (v[firm] > 0.5).any()] if parts else []
        for p in hits:
            words = p.split()
            near = of(words)[:, firm].max(axis=1) > 0.5
            kinds = [disguised(w) if c else (w, w) for w, c in zip(words, near, strict=True)]
            more += [p, *(" ".join(k[j] for k in kinds) for j in range(2))]

    texts, y = [*texts, *more], np.r_[y, np.ones(len(more))]
    share = float(y.mean())
    x = np.concatenate([of(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    lam, vec = np.linalg.eigh(of.marks.matrix)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(lam, 1e-3))) @ vec.T
    z = np.c_[x @ root, np.ones(len(x))]
    sign = 2 * y - 1
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * np.r_[np.ones(len(labels)), np.full(len(more), HEFT)]
    w, hold = np.zeros(z.shape[1]), np.r_[np.ones(z.shape[1] - 1), 1e-6]
    for _ in range(50):  # Newton steps on the squared hinge loss
        inside = sign * (z @ w) < 1
        zi, ci = z[inside], cost[inside]
        new = np.linalg.solve(np.diag(hold) + 2 * (zi * ci[:, None]).T @ zi, 2 * zi.T @ (ci * sign[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    margin, y = (z @ w)[: len(labels)], y[: len(labels)]  # of the texts alone, in their own proportion
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(100):  # the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(landmarks, strong, a * (root @ w[:-1]), float(a * w[-1] + b), share)

def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0

def training_rows(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> DataFrame:
    """At most ``rows`` labelled (text, y) of ``size`` bytes outside the held-out fifth; the ids are picked first, so the join's small side is bounded."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    some = marked.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # sizes of these few ids in their order, until the bytes are used up
    sizes = texts.join(F.broadcast(some), "_id").groupBy("_id").agg(F.max("y").alias("y"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("_id"), "_id"))).where(F.col("upto") <= size).select("_id", "y")
    return texts.join(F.broadcast(upto), "_id").orderBy("_id", "text").limit(rows).select("text", "y")


def train(documents: DataFrame, labels: DataFrame, **names: str) -> Model:
    found = training_rows(documents, labels, **names).collect()
    return fit_model([r["text"] or "" for r in found], [r["y"] for r in found])

def score_texts(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """Keeps the columns in keep (and the text, with carry_text) and adds score (0 to 1) and predicted (score of 0.5 or more)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def make():
        of = TextValues(model.landmarks, model.strong) if model.landmarks else None

        def run(texts: list) -> dict:
            values = of([t or "" for t in texts]) if of else np.zeros((len(texts), 0))
            s = model.scores(values)
            out = {text_col: pa.array(texts, pa.string())} if carry_text else {}
            return out | {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

        return run

    return map_texts(df, make, "".join(f"`{k}` {types[k]}, " for k in keep) + (f"`{text_col}` string, " if carry_text else "") + "score double, predicted int", text_col, keep)

def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = train(documents, read(spark, sf_dir, "labels"))
    return score_texts(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

QUERIES = {"op6_toxicity": op6_toxicity}
