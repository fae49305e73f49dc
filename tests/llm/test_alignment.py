"""Cross-tokenizer alignment against a plain version of its contract."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from envgrid.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = {c: i for i, c in enumerate(alignment.byte_signs())}
    entry = {i: bytes(signs[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in signs for c in t)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, entry, piece


def plain(text, libraries):
    """(ids of A, ids of B, groups) by the contract's words."""
    a, b, entry, piece = libraries
    if not text:
        return [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a, bytes_b, whole = [entry[i] for i in ids_a], [piece(i) for i in ids_b], (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], []
    ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        m, n = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((ids_a[i:m], ids_b[j:n]))
        i, j = m, n
    return ids_a, ids_b, groups


def expected(texts, libraries):
    made = [plain(t, libraries) for t in texts]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for _, _, g in made]
    count = collections.Counter(p for k in links for p in k)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (a, b, g), k in zip(made, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((len(a), len(b), len(g), sum(k.values()), sum(n for p, n in k.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in k.items()), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts_of(corpus):
    odd = ["a▁b", "▁", " lead", "two  blanks ", "tab\tand\r\nlines\n\n", "<|endoftext|> plain", "naïve café 日本語のテキスト", "\U0001f600\U0001f601 x", "\x00zero", "ᲊ new letters ᲉꟋ a\U000105c0b", "isn't it's I'LL we've", "123 4567 ½ ²", "　wide \xa0 blank", "<0x41> <s> </s> <unk>"]
    return [*corpus, *odd]


@pytest.mark.parametrize("head", [1 << 20, 50, 0])
def test_against_the_contract(spark, corpus, libraries, monkeypatch, head):
    """All counts, with all, some and no pairs in the head."""
    monkeypatch.setattr(alignment, "HEAD", head)
    texts = texts_of(corpus)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], "doc_id int, text string, rid int, pair int, links string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in alignment.align_corpus(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts, libraries)
    assert alignment.align_corpus(docs.limit(0), A, B).count() == 0


def test_same_id_twice(spark, libraries):
    texts = ["one text here", "one text here", "another text"]
    docs = spark.createDataFrame([(None if i == 2 else 7, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert sorted(tuple(r[c] for c in FIELDS) for r in alignment.align_corpus(docs, A, B).collect()) == sorted(expected(texts, libraries))


def test_tokens_of_all_characters(libraries):
    """Every character between letters, numbers and blanks: the ids of both tokenizers are their libraries'."""
    a, b, _, _ = libraries
    aligner = alignment.Aligner(A, B)
    chars = [chr(c) for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0200)]
    texts = [f"a{c}a {c} 1{c}2{c} {c}{c}.{c}'s" for c in chars]
    for at in range(0, len(texts), 20_000):
        some = [t for t in texts[at : at + 20_000] if "▁" not in t]
        for side, want in ((aligner.a, [e.ids for e in a.encode_batch([" " + t for t in some], add_special_tokens=False)]), (aligner.b, b.encode(some))):
            ids, n, good = side.tokens(some)
            cut = np.split(ids, np.cumsum(n)[:-1])
            assert good.all() and [x.tolist() for x in cut] == want


def test_small_stores_and_products(libraries, corpus, monkeypatch):
    """Stores that are emptied on the way, words in several lists, and products in small blocks change nothing."""
    texts = texts_of(corpus)
    want = alignment.Aligner(A, B).align(texts)
    for name, n in (("WORDS", 20), ("CHARS", 64), ("PRODUCTS", 5)):
        monkeypatch.setattr(alignment, name, n)
    got = alignment.Aligner(A, B).align(texts)
    for k in want:
        if k != "overlaps":
            assert np.array_equal(got[k], want[k]), k
    assert all(np.array_equal(getattr(got["overlaps"], x), getattr(want["overlaps"], x)) for x in ("ptr", "col", "val"))


def test_products_against_dense_matrices():
    r = np.random.default_rng(2)
    for _ in range(20):
        n, m, k = r.integers(1, 12, 3)
        left, right = r.integers(0, 3, (n, m)) * r.integers(0, 2, (n, m)), r.integers(0, 3, (m, k)) * r.integers(0, 2, (m, k))
        made = [alignment.Csr.of(*np.nonzero(x), x[np.nonzero(x)], *x.shape) for x in (left, right)]
        got = made[0].times(made[1], int(k))
        dense = np.zeros((n, k), int)
        dense[got.rows(), got.col] = got.val
        assert np.array_equal(dense, left @ right)


def test_overlaps(spark, libraries):
    """Links of tokens that share bytes, with the number of shared bytes."""
    texts = ["Unbelievable tokenization, naïve!", "", None, "x" * 50]
    got = {r["doc_id"]: r for r in alignment.align_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), A, B).collect()}
    for k, t in enumerate(texts):
        ids_a, ids_b, groups = plain(t, libraries)
        spans = []
        for ids, size in ((ids_a, lambda i: len(libraries[2][i])), (ids_b, lambda i: len(libraries[3](i)))):
            end = np.cumsum([size(i) for i in ids]).tolist()
            spans.append(list(zip([0, *end], end, strict=False)))
        want = [(i, j, min(b, d) - max(a, c)) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if min(b, d) > max(a, c)]
        r = got[k]
        assert (r["a"], r["b"], [tuple(x) for x in r["overlaps"]]) == (ids_a, ids_b, want)
        assert r["group_a"] == [g for g, (x, _) in enumerate(groups) for _ in x] and r["group_b"] == [g for g, (_, y) in enumerate(groups) for _ in y]


def test_hot_and_random_texts(libraries):
    r = random.Random(4)
    texts = ["".join(r.choice("ab \n'éx日1") for _ in range(r.randrange(200))) for _ in range(80)] + ["ab" * 5000]
    made = alignment.Aligner(A, B).align(texts)
    want = [plain(t, libraries) for t in texts]
    assert made["n_links"].tolist() == [sum(len(a) * len(b) for a, b in g) for _, _, g in want] and made["n_groups"].tolist() == [len(g) for _, _, g in want]
