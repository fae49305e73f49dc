"""Benchmark decontamination against brute force."""

import random
import re

import numpy as np

from envgrid.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, bench):
    out = []
    for t in texts:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            v = words(b)
            k = min(10, len(v))
            for p in {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else ():
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) == p:
                        hit.update(range(i, i + k))
                        items.add(item)
        out.append((len(w), len(hit), sorted(i for i in items if i is not None), hit))
    return out


def cases(seed=3, vocabulary=14):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdé0") for _ in range(r.randrange(1, 4))) for _ in range(vocabulary)]
    line = lambda n: [r.choice(v) for _ in range(n)]
    bench = [(i, " ".join(line(r.choice([10, 12, 25, 40])))) for i in range(12)]
    bench += [(3, "one more text of the same item that has twelve words in it"), (None, " ".join(line(11))), (50, None), (51, " -- "), (52, "Zq"), (53, "zq zq"), (54, " ".join(["aa"] * 30)), (55, "x" * 300 + " long words are known by their digest and found so as well")]
    texts = [" ".join(line(60)) for _ in range(10)]
    for item, b in bench:
        w = words(b)
        texts.append(" ".join(line(5) + w[: r.randrange(1, len(w) + 1)] + line(7)) if w else "")
        texts.append(", ".join(w).upper() + "." + " ".join(line(4)) + "\n" + " ".join(w[-10:]))
    texts += [None, "", " \n", "zq", "a-zq-zq zq", "aa " * 25, "aa " * 9, " ".join(line(9000)) + " " + bench[2][1] + " " + " ".join(line(3000)), texts[12], "y" * 500_000 + " " + bench[4][1]]
    return texts, bench


def held(spark, texts, bench):
    docs = spark.createDataFrame([(i, t, i * 2, "k", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_hit bigint, row string, _ int").repartition(3)
    made = decontam.mark_contaminated(docs, spark.createDataFrame(bench, "item_id bigint, text string"))
    assert made.columns == ["doc_id", "text", "n_hit", "row", "_", "n_words", "n_hit_", "spans", "items", "contaminated"]
    got = {r["doc_id"]: r for r in made.collect()}
    for i, (n, hits, items, at) in enumerate(brute(texts, bench)):
        r = got[i]
        assert (r["n_words"], r["n_hit_"], r["items"], r["contaminated"], r["n_hit"], r["text"]) == (n, hits, items, hits > 0, i * 2, texts[i])
        assert {k for s in r["spans"] for k in range(s["s"], s["e"])} == at and len(r["spans"]) == sum(k - 1 not in at for k in at)
    return got


def test_all_occurrences(spark):
    texts, bench = cases()
    assert sum(r["contaminated"] for r in held(spark, texts, bench).values()) > 20


def test_several_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    monkeypatch.setattr(decontam, "PIECE_WORDS", 7)
    monkeypatch.setattr(decontam, "STRETCH", 16)
    texts, bench = cases(5)
    held(spark, texts[:30] + texts[-8:-3], bench)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in decontam.mark_contaminated(docs, none).orderBy("doc_id").collect()] == [(2, 0, []), (0, 0, [])]
    assert decontam.mark_contaminated(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0


def test_machine_skips_and_finds():
    """Shifts never pass an occurrence, whatever the lengths, and equal suffix blocks and hashes are told apart by words."""
    r = np.random.default_rng(1)
    for m in (1, 2, 3, 10):
        text = r.integers(0, 4, 5000)
        p = np.unique(np.lib.stride_tricks.sliding_window_view(text, m)[r.integers(0, 4990, 40)], axis=0)
        p = p[(p > 0).all(axis=1)]
        if not len(p):
            continue
        machine = decontam.WuManber(p)
        windows = np.lib.stride_tricks.sliding_window_view(text, m)
        want = {(int(i), k) for k in range(len(p)) for i in np.flatnonzero((windows == p[k]).all(axis=1))}
        assert set(zip(*map(np.ndarray.tolist, machine.find(text)), strict=True)) == want
        machine.key[:] = machine.key >> np.uint64(30) << np.uint64(30)  # hashes that say little
        machine.bucket = lambda block, full, f=machine.bucket: f(block, full) >> np.uint64(30) << np.uint64(30)
        assert set(zip(*map(np.ndarray.tolist, machine.find(text)), strict=True)) == want
