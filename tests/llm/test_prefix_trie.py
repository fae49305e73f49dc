"""Prefix tries against a plain trie, and list ranking against walking the list."""

import collections
import hashlib
import random
import zlib

import pytest

from envgrid.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, part int"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "n_nodes", "saved_tokens", "ends_sha256")


def ordered(rows):
    held = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            held[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in held.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def trie(convs):
    members = collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    out = {}
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out[min(m), len(k)] = (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in below), len(below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def made(df):
    got = {(r["conv_id"], r["depth"]): tuple(r[f] for f in FIELDS) for r in df.collect()}
    assert len(got) == df.count()
    return got


def conversations(seed, n=60, few=3):
    r = random.Random(seed)
    rows = []
    for c in (*range(n), 100, 103, 199, 205, 301):
        for t in range(r.choice([1, 2, 4, 7])):
            rows.append((c, t, r.choice(["user", "assistant"]) if few < 3 else "user", r.choice(["a", "bé", "\U0001f600c", "", None][:few])))
    rows += [(20, t, "user", "a" * (t % 2 + 1)) for t in range(300)] + [(21, t, "user", "a" * (t % 2 + 1)) for t in range(150)]  # long ones
    rows += [(c, t, "user", "same") for c in range(40, 52) for t in range(3)]
    rows += [(7, None, None, None), (None, 1, "user", "no conversation"), (300, 5, "user", "z" * 100_000), (8, 0, "user", "twice"), (8, 0, "user", "twice"), (8, 0, "system", "tie")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [1 << 18, 9])
def test_against_a_plain_trie(spark, monkeypatch, chunk):
    """With the list in one chunk, and in many small ones over several rounds with splices."""
    monkeypatch.setattr(pt, "CHUNK", chunk)
    if chunk == 9:
        monkeypatch.setattr(pt, "STALL", 0.3)
    rows = conversations(1)
    df = spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA).repartition(3)
    assert made(pt.conversation_trie(df)) == trie(ordered(rows))
    turns = pt.stage(pt.ordered_turns(df), "t")
    assert made(pt.prefix_trie(*pt.with_shared_heads(turns))) == trie(rebuilt(ordered(rows)))


def test_many_branches_and_empty(spark):
    rows = [(c, t, "u", str(c if t else c % 2)) for c in range(300) for t in range(2)] + [(1000, 0, "u", "x")]
    df = spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA)
    assert made(pt.conversation_trie(df)) == trie(ordered(rows))
    assert pt.conversation_trie(df.limit(0)).count() == 0
    one = df.where("conv_id = 1000")
    assert made(pt.conversation_trie(one)) == trie({1000: [("u", "x")]})


@pytest.mark.parametrize("stall", [0.0, 0.75])
def test_list_ranking(spark, monkeypatch, stall):
    """A list whose order has nothing to do with its names, by splices and by chunks."""
    monkeypatch.setattr(pt, "CHUNK", 16)
    monkeypatch.setattr(pt, "STALL", stall)
    r = random.Random(8)
    names = [(c, s) for c in range(40) for s in range(r.choice([1, 1, 2, 5]))]
    r.shuffle(names)
    rows = [(c, s, *(names[i + 1] if i + 1 < len(names) else (c, -1)), i, 2, 1) for i, (c, s) in enumerate(names)]
    got = {(x["c"], x["s"]): (x["leaves"], x["saved"], x["nodes"]) for x in pt.ranked(spark.createDataFrame(rows, "c bigint, s bigint, nc bigint, ns bigint, leaves bigint, saved bigint, nodes bigint")).collect()}
    n = len(names)
    assert got == {x: (sum(range(i, n)), 2 * (n - i), n - i) for i, x in enumerate(names)}


def test_staged_tables_are_cleared(spark):
    import glob

    from envgrid.llm import common

    left = lambda: set(glob.glob(f"{common.shared_dir(spark)}/stage-*"))
    common.clear_staged()
    before = left()
    df = spark.createDataFrame([(1, 0, "u", "x", "d", 1)], SCHEMA)
    assert pt.conversation_trie(df).count() == 2
    assert left() > before and common.clear_staged() > 0 and left() == before
