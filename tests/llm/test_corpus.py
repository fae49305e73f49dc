"""Operators over the whole corpus against brute force: near copies, repeats, lines, packing, toxicity, the pipeline."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from envgrid.llm import lines, near, packing, repeats, toxicity

WORD = re.compile(r"[^ \t-\r]+")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def components(sets):
    par = list(range(len(sets)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_copies(documents, empty, corpus):
    sets = [frozenset(near.shingles(t)) for t in corpus]
    want = components(sets)
    got = rows(near.near_components(documents))
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(corpus))] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, want, strict=True))]
    assert len(set(want)) < len(corpus) - 10 and near.near_components(empty).count() == 0


def test_near_copies_in_small_blocks(spark, words, monkeypatch):
    """A large group of near copies around one text, and texts of shared parts, with blocks of 3, against brute force."""
    monkeypatch.setattr(near, "BLOCK", 3)
    r = random.Random(31)
    base, part, texts = [r.choice(words) for _ in range(60)], [r.choice(words) for _ in range(40)], []
    for k in range(70):
        w = list(base) if k % 3 else part + [r.choice(words) for _ in range(r.randrange(4, 40))]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0], None, "", texts[1]]
    want = components([frozenset(near.shingles(t)) for t in texts])
    got = rows(near.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)))
    assert [got[i]["component_id"] for i in range(len(texts))] == want and len(set(want)) < 60
    links = [(r.randrange(30), r.randrange(30)) for _ in range(40)]
    held = near.forest(links)
    assert len(held) < 30 and near.forest(held) == held and set(held) <= {(max(p), min(p)) for p in links}


def test_differences_give_exact_links(words):
    r = random.Random(3)
    base = words[:200]
    variants = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(30)):
            w[r.randrange(len(w))] = r.choice(words)
        variants.append(" ".join(w[: r.randrange(140, 200)]))
    hub = near.hashed(" ".join(base))
    told = []
    for i, v in enumerate(variants):
        mine = near.hashed(v)
        bits = np.packbits(~np.isin(hub, mine))
        told.append({"rep": i, "n": len(mine), "m": len(hub), "lacks": bits.tobytes() + b"\0" * (-len(bits) % 8), "own": np.setdiff1d(mine, hub).view(np.int64).tolist()})
    sets = [set(near.shingles(v)) for v in variants]
    want = {(i, j) for i in range(60) for j in range(60) if i != j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert set(near.links_by_difference(told, told)) == want


def brute_repeats(raws, first):
    seen = {}
    for i, b in enumerate(raws):
        for k in range(len(b) - repeats.LENGTH + 1):
            seen.setdefault(b[k : k + repeats.LENGTH], []).append((i, k))
    out = []
    for i, b in enumerate(raws):
        m = np.zeros(len(b), bool)
        for k in range(len(b) - repeats.LENGTH + 1):
            s = seen[b[k : k + repeats.LENGTH]]
            if len(s) > 1 and not (first and s[0] == (i, k)):
                m[k : k + repeats.LENGTH] = True
        out.append(m)
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("block", [512, 2])
def test_repeats(documents, corpus, empty, keep, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "PIECE", 2000)
    raws = [(t or "").encode() for t in corpus]
    if keep == "none":
        raws.append(raws[2])  # the repeated row is an occurrence of its own
    got = rows(repeats.remove_repeats(documents, keep, digest=True))
    for i, (b, m) in enumerate(zip(raws, brute_repeats(raws, keep == "first"), strict=True)):
        if i < len(corpus):
            left = np.frombuffer(b, np.uint8)[~m].tobytes()
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()), i
    assert repeats.remove_repeats(empty, keep).count() == 0


def test_suffix_order_and_longest_previous_factors():
    r = random.Random(2)
    b = np.array([r.randrange(2) for _ in range(1500)], np.uint8)
    b[900:1200] = b[100:400]
    b[400:640] = 1
    starts = np.arange(0, 1300, 3)
    ranks, eight = repeats.doubled_ranks(b)
    rank = repeats.suffix_ranks(ranks, starts)
    cut = [b[k : k + repeats.LENGTH].tobytes() for k in starts]
    assert [sorted(set(cut)).index(c) for c in cut] == rank.tolist()

    def shared(x, y):
        return next((k for k in range(len(x)) if x[k] != y[k]), len(x))

    order = np.array(r.sample(range(5000), len(starts)))
    sa = np.lexsort((order, rank))
    common = np.r_[0, repeats.common_prefixes(ranks, eight, starts[sa[:-1]], starts[sa[1:]])]
    assert common[1:].tolist() == [shared(cut[i], cut[j]) for i, j in zip(sa, sa[1:], strict=False)]
    place = order[sa]
    before, held = repeats.smaller_before(place, common)
    for k in range(len(sa)):
        want = next((j for j in range(k - 1, -1, -1) if place[j] < place[k]), -1)
        assert before[k] == want and held[k] == (shared(cut[sa[k]], cut[sa[want]]) if want >= 0 else 0)
    longest = repeats.longest_previous_factors(place, common)
    assert longest.tolist() == [max((shared(cut[sa[k]], cut[sa[j]]) for j in range(len(sa)) if place[j] < place[k]), default=0) for k in range(len(sa))]


def test_suffix_order_memory():
    """A slice's suffix order stays small beside an executor's heap: two workers hold one each, and keep what they took."""
    n = repeats.PIECE // 268
    b = np.random.default_rng(3).integers(97, 123, 268 * n, dtype=np.uint8)
    for k in range(0, n - 1, 2):
        b[268 * (k + 1) : 268 * (k + 1) + 240] = b[268 * k : 268 * k + 240]
        b[268 * (k + 1) + 240] = 0  # the pair differs from here on
    own, inner = np.repeat(np.arange(n), 69), np.tile(np.arange(69), n)
    tracemalloc.start()
    earlier, elsewhere = repeats.earlier_and_elsewhere(b, own * 268 + inner, own * (1 << 20) + inner)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    paired = (own < n - n % 2) & (inner <= 40)
    assert (earlier == (paired & (own % 2 == 1))).all() and (elsewhere == paired).all()
    assert peak < 48 << 20


def test_anchors_by_stretches(monkeypatch):
    """A text in stretches has the anchors of the whole one, string by string."""
    r = np.random.default_rng(4)
    b = np.r_[r.integers(0, 3, 3000), np.zeros(700), r.integers(0, 200, 1500)].astype(np.uint8)

    def each():
        lo, hi, h = repeats.anchors(b)
        assert lo[0] == 0 and hi[-1] == len(b) - repeats.LENGTH and (lo[1:] == hi[:-1] + 1).all()
        return np.repeat(h, hi - lo + 1)

    whole = each()
    for n in (1, 64, 333, 5000):
        monkeypatch.setattr(repeats, "STRETCH", n)
        assert np.array_equal(each(), whole)


def test_rows_without_id_and_one_id_for_two_texts(spark, words):
    """Null ids and an id of several texts: every row is cut by its own places, in lines and in passages."""
    r = random.Random(23)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = line(80)
    texts = [line(20) + "\n" + passage + "\n" + line(15 + k) for k in range(6)]
    df = spark.createDataFrame([(None if k < 2 else 7, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {x["text"] for x in repeats.remove_repeats(df).collect()}
    want = set()
    for t, m in zip(texts, brute_repeats([t.encode() for t in texts], False), strict=True):
        want.add(np.frombuffer(t.encode(), np.uint8)[~m].tobytes().decode("utf-8", "ignore"))
    assert got == want and len(got) == 6
    kept = {x["text"] for x in lines.drop_lines(df).collect()}
    assert kept == {"\n".join(x for x in t.split("\n") if x != passage) for t in texts}


def test_a_large_group_is_halved(spark, words, monkeypatch):
    """One passage between different neighbours in many texts, against brute force, with groups of up to three contexts."""
    monkeypatch.setattr(repeats, "BLOCK", 3)
    r = random.Random(17)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = line(70)
    texts = [line(r.randrange(3, 40)) + passage[r.randrange(20) : len(passage) - r.randrange(20)] + line(r.randrange(3, 40)) for _ in range(40)] + ["ab" * 300, "ba" * 250, "a" * 900, None]
    df = spark.createDataFrame([(i, t, 9, 9, 9, 9, 9) for i, t in enumerate(texts)], "doc_id int, text string, n_bytes int, n_removed int, rid int, spans int, row int")
    for keep in ("none", "first"):
        out = repeats.remove_repeats(df, keep)
        assert out.columns == [*df.columns, "n_bytes_", "n_removed_", "n_spans"]
        got = rows(out)
        for i, (t, m) in enumerate(zip(texts, brute_repeats([(t or "").encode() for t in texts], keep == "first"), strict=True)):
            left = None if t is None else np.frombuffer(t.encode(), np.uint8)[~m].tobytes().decode("utf-8", "ignore")
            assert (got[i]["text"], got[i]["n_removed_"], got[i]["n_bytes"], got[i]["rid"], got[i]["row"]) == (left, int(m.sum()), 9, 9, 9), (keep, i)


def test_lines(documents, empty, corpus):
    out = lines.drop_lines(documents)
    got = rows(out)
    for i, t in enumerate(corpus):
        cut = [x for x in (t or "").split("\n") if not x.startswith("All of the rights are reserved")]
        assert got[i]["text"] == (None if t is None else "\n".join(cut)), i
        assert got[i]["n_dropped"] == (0 if t is None else len(t.split("\n")) - len(cut)) and got[i]["n_lines"] == 2
    assert out.columns[: len(documents.columns)] == documents.columns and lines.drop_lines(empty).count() == 0


def test_lines_of_blocks_short_documents_and_copies(spark, words):
    r = random.Random(11)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    block, fixed, often = [line(7), line(9), line(5)], [line(6), line(6)], line(8)
    texts = ["\n".join([line(12) for _ in range(6)] + block) for _ in range(8)]  # footer of three lines
    texts += ["\n".join(x for _ in range(4) for x in [line(14), ""]) + "\n" + fixed[0] + "\n\n" + fixed[1] for _ in range(8)]  # between blank lines
    texts += [line(9) + "\n" + fixed[0] + "\n\n" + fixed[1] for _ in range(6)]  # short documents
    texts += ["\n".join(x for _ in range(5) for x in [line(10), often]) for _ in range(6)]  # repeats in a document
    whole = [[line(10) for _ in range(6)] + [block[0]] for _ in range(6)]
    texts += ["\n".join(x) for x in whole for _ in range(7)]  # seven copies of each of six documents
    gone = {*block, *fixed, often}
    near = [line(10) for _ in range(12)]
    edited = ["\n".join(line(10) if k % 12 == j else x for j, x in enumerate(near)) for k in range(40)]  # near copies: one line edited in each
    seen = line(10)
    few = ["\n".join([line(10), line(10), seen])] * 9 + ["\n".join([line(10), line(10), seen]) for _ in range(3)]  # four different documents
    rows_in = [(i, t) for i, t in enumerate(texts + edited + few)]
    got = rows(lines.drop_lines(spark.createDataFrame(rows_in, "doc_id bigint, text string").repartition(3)))
    for i, t in rows_in:
        assert got[i]["text"] == "\n".join(x for x in t.split("\n") if i >= len(texts) or x not in gone), (i, t)


def test_lines_go_once_whatever_templates_they_have(spark, words):
    """A line that differs in one word among 30 documents has seven templates of the same lines: one is kept, and a place is one row."""
    r = random.Random(31)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    names = sorted({w.title() for w in words})[:30]
    texts = [line(30) + "\n" + f"this page was printed for {name} last night" for name in names]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    places, of = lines.template_lines(df)
    assert places.count() == of.count() == of.select("w").distinct().count() == 30 and {x["n_docs"] for x in of.collect()} == {30}
    assert {x["text"] for x in lines.drop_lines(df).collect()} == {t.split("\n")[0] for t in texts}
    assert [(x["template"], x["n_docs"]) for x in lines.templates(df).collect()] == [("this page was printed for <*> last night", 30)]


def test_line_templates_with_variables(spark, words):
    """Against brute force: a line goes if five texts have lines of its size that equal it in all steps but two (one below eight tokens)."""
    r = random.Random(21)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    name = lambda: r.choice(words).title()
    ends = [lambda: f"User {name()} logged in from {name()} at noon", lambda: f"{name()}: job finished with status ok today", lambda: f"Page 12 of {name()}", lambda: f"Seen {name()} {name()} {name()} in town", lambda: f"{r.randrange(99)} 7 2024"]
    texts = [line(30) + "\n" + line(12) + "\n" + ends[k % 5]() for k in range(60)]
    few = [line(30) + "\n" + f"Dear {name()} thank you for your long letter" for _ in range(4)]  # four documents
    got = rows(lines.drop_lines(spark.createDataFrame(list(enumerate(texts + few)), "doc_id bigint, text string")))
    steps = {}
    for i, t in enumerate(texts + few):
        for j, x in enumerate(t.split("\n")):
            w = ["<*>" if re.search("[0-9]", y) else y for y in x.split()]
            edges = [0, 1, *(2 + (len(w) - 2) * k // 6 for k in range(7))]
            steps[i, j] = tuple(w if len(w) <= 8 else (" ".join(w[a:b]) for a, b in zip(edges, edges[1:], strict=False))), len(w)
    def same(a, b):
        (s, n), (u, m) = a, b
        if n != m or len(s) != len(u) or n < 5:
            return (s, n) == (u, m) and any(x != "<*>" for x in s)
        held = [x for x, y in zip(s, u, strict=True) if x == y]
        return len(held) >= len(s) - (1 if n < 8 else 2) and sum(x != "<*>" for x in held) * 2 >= len(s)
    for i, t in enumerate(texts + few):
        left = [x for j, x in enumerate(t.split("\n")) if len({k for (k, _), v in steps.items() if same(v, steps[i, j])}) < 5]
        assert got[i]["text"] == "\n".join(left), (i, t)
    assert sum(r["n_dropped"] for r in got.values()) == 24
    found = {r["template"]: r["n_docs"] for r in lines.templates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert found["User <*> logged in from <*> at noon"] == 12 and found["<*> job finished with status ok today"] == 12


def test_line_table(words):
    r = random.Random(23)
    texts = ["", "\n\n", " a\tb  c\n\na b c\n1 22\nx1 y\r\n", "é ü\x0b ß"] + ["\n".join(" ".join(r.choice(words[:9]) for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(6))) for _ in range(40)]
    t = lines.line_table([x.encode() for x in texts])
    want = []
    for d, x in enumerate(texts):
        for i, y in enumerate(x.split("\n")):
            w = ["<*>" if re.search("[0-9]", z) else z for z in WORD.findall(y)]
            if any(z != "<*>" for z in w):
                want.append((d, i, tuple(w)))
    assert list(zip(t["doc"].tolist(), t["i"].tolist(), t["n"].tolist(), strict=True)) == [(d, i, len(w)) for d, i, w in want]
    hashes, seen = {}, set()
    for k, (d, _, w) in enumerate(want):
        assert hashes.setdefault(w, int(t["w"][k])) == int(t["w"][k]) and t["first"][k] == ((d, w) not in seen)
        seen.add((d, w))
    assert len(set(hashes.values())) == len(hashes)


def test_lines_keep_given_columns(spark, words):
    r = random.Random(22)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    made = [(i, line(20) + "\nfixed words here at the end", 5, 6, 7, 8) for i in range(9)]
    df = spark.createDataFrame([*made, made[0], (9, None, 5, 6, 7, 8), (10, "", 5, 6, 7, 8)], "doc_id bigint, text string, n_lines int, N_Dropped int, rid int, gone int")
    got = lines.drop_lines(df)
    assert got.columns == [*df.columns, "n_lines_", "n_dropped_"]
    for x in got.collect():
        assert (x["n_lines"], x["N_Dropped"], x["rid"], x["gone"]) == (5, 6, 7, 8)
        assert x["n_dropped_"] == (x["doc_id"] < 9) and x["text"] == (None if x["doc_id"] == 9 else "" if x["doc_id"] == 10 else made[x["doc_id"]][1].split("\n")[0])
    assert got.count() == 12 and lines.drop_lines(df, counts=False).columns == df.columns


def test_packing(documents, empty, corpus):
    encode = packing.encoder(packing.default_tokenizer())
    lengths = {i: len(encode(t)) if t else 0 for i, t in enumerate(corpus)}
    out = packing.pack_documents(documents, lengths=(64, 128, 256), shard=60).collect()
    total = collections.Counter()
    held = collections.defaultdict(list)
    for r in out:
        total[r["doc_id"]] += r["n_tokens"]
        held[r["bin_id"]].append(r)
    assert {k: v for k, v in total.items() if k != 2} == {k: v for k, v in lengths.items() if k != 2} and total[2] == 2 * lengths[2]
    for b in held.values():
        used, size = sum(r["n_tokens"] for r in b), b[0]["bin_length"]
        assert used == b[0]["bin_tokens"] <= size and not any(used <= c < size for c in (64, 128, 256))
        at = 0
        for r in sorted(b, key=lambda r: (r["bin_start"], r["n_tokens"])):
            assert r["bin_start"] == at
            at += r["n_tokens"]
    assert packing.pack_documents(empty).count() == 0 and packing.pack_sequences(empty).count() == 0


def test_packed_sequences_hold_the_tokens(documents, corpus):
    encode = packing.encoder(packing.default_tokenizer())
    seen = collections.defaultdict(list)
    for r in packing.pack_sequences(documents.withColumnRenamed("label", "n"), lengths=(64, 128, 256), shard=60).collect():
        assert len(r["tokens"]) == r["bin_tokens"] <= r["bin_length"]
        ends = [*r["starts"][1:], len(r["tokens"])]
        for i, k, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], ends, strict=True):
            seen[i].append((k, r["tokens"][a:b]))
    for i, t in enumerate(corpus):
        want = encode(t) if t else []
        cut = [want[k : k + 256] for k in range(0, max(1, len(want)), 256)]
        assert sorted(seen[i]) == sorted((k, c) for k, c in enumerate(cut) for _ in range(1 + (i == 2))), i


def test_long_blanks_are_encoded_in_whole():
    import base64

    path = packing.default_tokenizer()
    with open(path, "rb") as f:
        pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    text = "one two" + " " * 1_200_000 + "three\n" + "\t" * 30_000
    encode = packing.encoder(path)
    assert b"".join(pieces[i] for i in encode(text)).decode() == text
    short = "it's 12  blanks,\n\n   and more" + " " * 9_000 + "x"
    held = packing.BLANKS
    try:
        packing.BLANKS = re.compile(r"\s{3}")
        assert encode(short) == encode("".join(short)) and b"".join(pieces[i] for i in encode(short)).decode() == short
        slow = encode(short)
        packing.BLANKS = held
        assert slow == encode(short)
    finally:
        packing.BLANKS = held


def least_cost(items, lengths):
    best = [float("inf")]

    def place(k, bins):
        if k == len(items):
            best[0] = min(best[0], sum(packing.cost(next(c for c in lengths if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= lengths[-1]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def test_lengths_are_chosen_jointly():
    r = random.Random(12)
    over = []
    for _ in range(60):
        items = [r.randrange(1, 4000) for _ in range(7)]
        where, start, size = packing.pack(items)
        assert len(where) == len(start) == 7 and max(where) + 1 == len(size)
        over.append(sum(map(packing.cost, size)) / least_cost(items, packing.LENGTHS))
    assert min(over) > 1 - 1e-9 and sum(over) / len(over) < 1.02 and max(over) < 1.2
    items = [r.choice([130, 500, 1000, 2040, 4000]) for _ in range(2000)]
    total = sum(map(packing.cost, packing.pack(items)[2]))
    order = sorted(range(len(items)), key=lambda i: -items[i])
    one = packing.pack_set(items, order, [4096], packing.cost)[2]
    assert total < 0.98 * sum(packing.cost(next(c for c in packing.LENGTHS if c >= u)) for u in one)
    assert set(packing.pack(items)[2]) == {1024, 2048, 4096} and set(packing.pack([1000] * 50)[2]) == {1024} and set(packing.pack([300] * 300)[2]) == {1024}
    for _ in range(200):  # the filling of a room, one by one
        left = sorted((r.randrange(0, 60) for _ in range(r.randrange(0, 12))), reverse=True)
        room, held = r.randrange(0, 120), 0
        rest = room
        for x in left:
            if x <= rest:
                held, rest = held + x, rest - x
        a = np.array(left, np.int64)
        assert packing.fill(room, -a, np.r_[0, np.cumsum(a)], 0) == held
    assert packing.pack([]) == ([], [], [])
    with pytest.raises(ValueError):
        packing.pack([5000])


INSULTS = ["grobbler", "snarkfist", "wetnoodle"]


@pytest.fixture(scope="module")
def labelled(spark, words):
    r = random.Random(9)
    out = []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randrange(15, 60))]
        y = int(i % 6 == 0)
        for _ in range(y * r.randrange(1, 4)):
            w.insert(r.randrange(len(w)), r.choice(INSULTS))
        out.append((i, " ".join(w), y))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in out] + [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in out], "doc_id bigint, quality int, toxic int"), {i: y for i, _, y in out}


def test_toxicity(labelled, empty):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, model).join(docs.select("doc_id", toxicity.held_out("doc_id").alias("h")), "doc_id").collect()}
    held = [i for i in truth if got[i]["h"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97 and len(held) > 100
    assert got[9000]["score"] == got[9001]["score"] < 0.5
    of = toxicity.TextValues(model.landmarks, model.strong)
    s = lambda *t: model.scores(of(list(t)))
    near_, far = s("a grobxbler and snark-fist here w e t n o o d l e"), s("a gentle snack and noble here wet day")
    assert near_[0] > 0.5 > far[0]
    assert toxicity.score_texts(empty, model).count() == 0
    assert toxicity.score_texts(docs, toxicity.train(docs, labels.where("toxic = 0"))).where("predicted = 1").count() == 0
    assert toxicity.train(docs, labels.where(F.lit(False))).landmarks == []


def test_insults_anywhere_in_long_words():
    """A landmark with a letter in every gap has its value at every place of a word of any length; a long word's value is its best window's."""
    of = toxicity.TextValues(["wetnoodle", "badlandmar"], [True, True])
    for insult in ("x".join("wetnoodle"), "x".join("badlandmar"), "wetnoodle"):
        least = of([insult]).sum()
        assert least > 0
        for n in (24, 25, 31, 48, 90):
            for at in range(0, n - len(insult) + 1):
                assert of(["q" * at + insult + "q" * (n - len(insult) - at)]).sum() > 0, (insult, n, at)
    assert of(["wetnoodle" * 20]).sum() <= 2 * of(["wetnoodle wetnoodles"]).sum()


def plain(s, t, decay=toxicity.DECAY):
    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.ORDER):
        for b in itertools.combinations(range(len(t)), toxicity.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_values_map_and_score_by_hand(labelled):
    """Values, Nyström map, margin and score of a few texts, from sums over subsequences."""
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    marks, strong = model.landmarks, model.strong
    assert any(strong)

    def value(word, k, decay, least):
        v = min(1.0, plain(word, marks[k], decay) / plain(marks[k], marks[k], decay)) ** toxicity.POWER
        if decay == toxicity.DECAY:
            near = {p for d in range(1, toxicity.GAP + 1) for p in zip(word, word[d:], strict=False)}
            pairs = set(zip(marks[k], marks[k][1:], strict=False))
            ok = len(pairs & near) >= max(1, math.ceil(toxicity.PAIRS * len(pairs)))
        else:
            ok = strong[k] and all(word.find(a) >= 0 and word.find(a) < word.rfind(b) for a, b in zip(marks[k], marks[k][1:], strict=False))
        return v if ok and v > least else 0.0

    texts = ["a grobbler", "g1r1o1b1b1l1e1r and snarkfist", "w e t n o o d l e", "sxnxaxrxkxfxixsxt", "nothing near", ""]
    got = toxicity.TextValues(marks, strong)(texts)
    kernels = ((toxicity.DECAY, toxicity.LEAST), (toxicity.SLACK, toxicity.CUT))
    for t, row in zip(texts, got, strict=True):
        words = toxicity.words_of(t)
        assert row.tolist() == pytest.approx([math.log1p(sum(value(w, k, d, least) for w in words)) for d, least in kernels for k in range(len(marks))])
    m, blocks = len(marks), toxicity.Landmarks(marks, strong).matrix
    for (i, j), (at, (d, _)) in itertools.product(itertools.product(range(m), repeat=2), enumerate(kernels)):
        assert blocks[at * m + i, at * m + j] == pytest.approx((plain(marks[i], marks[j], d) / math.sqrt(plain(marks[i], marks[i], d) * plain(marks[j], marks[j], d))) ** toxicity.POWER)
    assert not blocks[:m, m:].any()
    assert model.scores(got).tolist() == pytest.approx([1 / (1 + math.exp(-(sum(x * w for x, w in zip(row, model.weights, strict=True)) + model.bias))) for row in got])
    s = model.scores(got)
    assert s[1] > 0.5 > s[4:].max() and s[3] > 5 * s[4:].max()
    two = model.scores(toxicity.TextValues(marks, strong)(["a gxrxoxbxbxlxexr and w1e1t1n1o1o1d1l1e"]))
    assert two[0] > 0.5


def test_kernel_against_a_sum():

    words = ["idiot", "idxiot", "tiodi", "aaaa", "ab", "radio"]
    codes = toxicity.padded(words)
    for i in range(len(words)):
        for j in range(len(words)):
            assert toxicity.kernel(codes[i : i + 1], codes[j : j + 1])[0] == pytest.approx(plain(words[i], words[j]))


def test_pipeline_edges(spark, labelled, empty, words, tmp_path):
    """Repeated rows, null and empty texts, a long text, clashing names, and an empty table."""
    docs, labels, _ = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    r = random.Random(14)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    made = [(i, line(30), 1, 2, 3, 4, 5) for i in range(12)] + [(20, None, 1, 2, 3, 4, 5), (21, "", 1, 2, 3, 4, 5), (22, line(9000), 1, 2, 3, 4, 5)]
    df = spark.createDataFrame([*made, made[0], made[0], (3, line(25), 1, 2, 3, 4, 5)], "doc_id bigint, text string, n_chars int, n_lines int, n_bytes int, __gone int, __rid int")
    model = [*corpus_pipeline.STAGES]
    for table, n in ((df, 16), (df.limit(0), 0)):
        d = table
        for k, (name, step) in enumerate(model):
            out = step(spark, d, str(tmp_path)) if k else d  # the labels of other texts say nothing here
            out.write.parquet(str(tmp_path / f"{n}-{name}"))
            d = spark.read.parquet(str(tmp_path / f"{n}-{name}"))
            if name != "best_fit_packing":
                assert d.columns == df.columns and all((x["n_lines"], x["n_bytes"], x["__gone"], x["__rid"]) == (2, 3, 4, 5) for x in d.collect())
            if name == "minhash_near_dedup":
                assert d.count() == n and sorted(x["doc_id"] for x in d.collect()) == ([*range(4), 3, *range(4, 12), 20, 21, 22] if n else [])
        assert sorted({i for x in d.collect() for i in x["doc_ids"]}) == ([*range(12), 20, 21, 22] if n else [])
    assert corpus_pipeline.drop_toxic(spark, df.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, labelled, words, tmp_path):
    docs, labels, truth = labelled
    r = random.Random(4)
    passage = " ".join(r.choice(words) for _ in range(70))
    more = [" ".join(r.choice(words) for _ in range(20)) + "\n" + passage + "\n" + " ".join(r.choice(words) for _ in range(20)) for _ in range(3)]
    some = docs.where("doc_id = 1").select(F.lit(5000).cast("bigint").alias("doc_id"), "text", "lang", "source", "n_chars")
    extra = spark.createDataFrame([(6000 + k, t, "en", "s", len(t)) for k, t in enumerate(more)], docs.schema)
    docs.unionByName(some).unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, step in corpus_pipeline.STAGES:
        new = step(spark, d, str(tmp_path))
        if name != "best_fit_packing":
            assert new.columns == d.columns
        new.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        out[name] = d.collect()
    clean = {i for i, y in truth.items() if not y}
    kept = {r["doc_id"] for r in out["toxicity"]}
    assert len(clean - kept) <= 0.02 * len(clean) and len({i for i, y in truth.items() if y} & kept) <= 0.05 * len(truth)
    assert {r["doc_id"] for r in out["line_dedup"]} == kept
    sets = {r["doc_id"]: frozenset(near.shingles(r["text"])) for r in out["line_dedup"]}
    ids = sorted(sets)
    first = components([sets[i] for i in ids])
    assert {r["doc_id"] for r in out["minhash_near_dedup"]} == {i for i, c in zip(ids, first, strict=True) if ids[c] == i} and 5000 not in {r["doc_id"] for r in out["minhash_near_dedup"]}
    texts = {r["doc_id"]: r["text"] or "" for r in out["suffix_array_dedup"]}
    assert sum(passage[100:200] in t for t in texts.values()) == 1 and passage in texts[6000]
    packed = collections.Counter(i for r in out["best_fit_packing"] for i in r["doc_ids"])
    assert set(packed) == set(texts)
    encode = packing.encoder(packing.default_tokenizer())
    assert collections.Counter(x for r in out["best_fit_packing"] for x in r["tokens"]) == collections.Counter(x for t in texts.values() for x in encode(t))
