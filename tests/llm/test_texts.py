"""Row-wise operators against their libraries and brute force: tokenizers, media, quality, pages."""

import collections
import gzip
import hashlib
import random
import re
import struct
import time
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from envgrid.llm import html_text, media, pieces_bpe, quality, token_counts

WORD = re.compile(r"[^ \t-\r]+")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_pieces(documents, empty, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(pieces_bpe.encode_digests(documents, path))
    full = rows(pieces_bpe.encode_texts(documents, path))
    for i, t in enumerate(corpus):
        ids = sp.encode(t or "")
        assert full[i]["ids"] == ids and full[i]["decoded"] == sp.decode(ids)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces_bpe.encode_digests(empty, path).count() == 0


def test_pieces_heap_and_arrays_agree(words):
    v = pieces_bpe.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    segments = ["▁" + w for w in words[:500]]
    assert v.merge(segments) == [v.agenda(s) for s in segments]
    with pytest.raises(ValueError):
        v.check(["▁the"], [[1]])


def test_token_counts(documents, empty, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = rows(token_counts.count_tokens(documents, path))
    for i, x in enumerate(corpus):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((x or "").encode()), n > 2048)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_merges_by_a_heap(words):
    c = token_counts.CountTransducer(public_tokenizers.path("word_bpe_49k.json"))

    def plain(symbols):
        ids = [c.single[x] for x in symbols]
        while True:
            found = [(c.ranks[p][0], i, c.ranks[p][1]) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in c.ranks]
            if not found:
                return ids
            _, i, made = min(found)
            ids[i : i + 2] = [made]

    for w in [*words[:150], "aaaaaaaaaaaa", "abababababab", "x", "".join(words[:40]), "ß" * 30]:
        raw = w.lower().encode()
        symbols = (*raw[:-1], raw[-1] + c.END)
        assert c.encode(symbols) == plain(symbols), w
        assert c.count(w.lower()) == len(plain(symbols)), w
    began = time.time()
    assert c.encode(tuple(b"ab" * 100_000)) and time.time() - began < 20


def test_chunk_maps_compose():
    from tokenizers import Tokenizer

    c = token_counts.Characters(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    text = ("don't we'll 12 x'y'z '' 're " * 90)[: 3 * token_counts.CHUNK + 7]
    s, e = token_counts.cut_words(text, c)
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    assert [text[i:j] for i, j in zip(s, e, strict=True)] == pattern.findall(text)


def test_token_counts_of_all_characters():
    """Every code point alone, within words and numbers, and before combining signs: the library's counts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_counts.TextCounter(path)
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200), *range(0x100000, 0x110000, 97))]
    texts = [f"{c} a{c}b 1{c}2 {c}{c} {c}'s it'{c} e{c}\u0301\u0323.{c}" for c in chars]
    for at in range(0, len(texts), 20_000):
        want = [len(e.ids) for e in library.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
        got = counter.counts(texts[at : at + 20_000]).tolist()
        assert got == want, [(hex(ord(chars[at + k])), g, w) for k, (g, w) in enumerate(zip(got, want, strict=True)) if g != w][:20]


def test_media_round_trip(documents, empty, corpus):
    got = rows(media.sniff_media(media.write_wav(documents)))
    for i, t in enumerate(corpus):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["detected"] == media.WAV and r["corrected"] and r["rate"] == media.RATE
    assert media.sniff_media(media.write_wav(empty)).count() == 0


def test_sniffing_and_carving():
    scan = media.automaton()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 9 + b"\x02\x02\x44\x01\x00" + b"\x3b"
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xda\x00\x02" + b"zz\xff\x00y" + b"\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\0" * 4
    zipped = gzip.compress(b"hello")
    for kind, b in (("image/png", png), ("image/gif", gif), ("image/jpeg", jpg), ("image/bmp", bmp), ("application/gzip", zipped)):
        assert media.sniff(b"text " + b + b" more", scan) == [(kind, 5, len(b))], kind
        assert media.sniff(b[:-3], scan) == [] or kind == "image/bmp" and media.sniff(b[:-3], scan) == []
    both = media.wav_bytes(b"__" + png + b"_" + gif)
    assert [k for k, _, _ in media.sniff(both, scan)] == ["audio/wav", "image/png", "image/gif"]
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    assert media.sniff(b"a" + pdf + b"b", scan) == [("application/pdf", 1, len(pdf))] and media.sniff(b"%PDF-1 %%EOF startxref %%EOF", scan) == []
    big = gzip.compress(bytes(range(256)) * 40_000, 0)
    assert media.sniff(b"-" + big + b"tail", scan) == [("application/gzip", 1, len(big))] and media.sniff(big[:-9], scan) == []
    # files that share their chunks or blocks: each is walked once
    chunks = b"".join(b"RIFF" + struct.pack("<I", 0x7A7A) + b"WAVE" for _ in range(80_000))
    nested = b"".join(b"RIFF" + struct.pack("<I", (1 << 20) - 12 * k - 8 - 4) + b"WAVE" for k in range(40_000)) + b"junk" + struct.pack("<I", 9) * 100_000
    blocks = (b"\x1f\x8b\x08\0\0\0\0\0\0\3" + b"\0\x0a\0\xf5\xff" + b"\x1f\x8b\x08\0\0\0\0\0\0\3") * 40_000
    for hits in (chunks, nested, blocks):
        began = time.time()
        assert media.sniff(hits, scan) == [] and time.time() - began < 5
    r = random.Random(12)
    for _ in range(300):  # against a walk for each file
        parts = [b"RIFF" + struct.pack("<I", r.randrange(20, 160)) + b"WAVE", b"fmt " + struct.pack("<I", 16) + bytes(16), b"data" + struct.pack("<I", r.randrange(0, 40)), b"LIST" + struct.pack("<I", r.randrange(0, 30)), bytes(r.randrange(0, 12))]
        b = b"".join(r.choice(parts) for _ in range(r.randrange(2, 14)))
        chained = media.Scan(b)
        for at in range(len(b)):
            if b[at : at + 4] == b"RIFF" and len(b) >= at + 12:
                plain = media.wav_chunks(b, at)
                assert media._wav(b, at, chained) == (plain[0] if plain else 0)
    for level in (0, 1, 9):
        packed = gzip.compress(bytes(range(256)) * 300 + b"abc" * 50_000, level)
        assert media.sniff(b"x" * 7 + packed + packed, scan) == [("application/gzip", 7, len(packed)), ("application/gzip", 7 + len(packed), len(packed))]
    for hits in (b"%PDF-" * 200_000, b"GIF89a" * 50_000, (b"GIF89a" + b"\0" * 7 + b"!\0\1\0") * 30_000, b"\xff\xd8\xff\xe0\0\2" * 50_000, b"BM" * 200_000):  # many hits that lead nowhere
        began = time.time()
        assert media.sniff(hits, scan) == [] and time.time() - began < 5
    assert media.sample_features(b"\x80\x80\x7f\x81") == (0, 0.7071, 2) and media.sample_features(b"") == (0, 0.0, 0)
    assert media.sniff(b"", scan) == [] and media.wav_chunks(b"RIFF") is None


def test_quality_figures(documents, empty, corpus):
    got = rows(quality.judge(documents))
    for i, x in enumerate(corpus):
        x = x or ""
        w = WORD.findall(x)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cover)), i
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judge(empty).count() == 0


def test_quality_estimate_against_a_loop(spark):
    import math
    import random

    r = random.Random(1)
    votes = [[r.choice((-1, 0, 0, 1, 1, 1)) if k % 7 else r.choice((-1, -1, 0)) for _ in quality.RULES] for k in range(400)]
    df = spark.createDataFrame([(v,) for v in votes], "votes array<int>")
    prior, w = quality.estimate(df)
    n, p = len(quality.RULES), quality.SHARE
    weights = [math.log(quality.START[0] / quality.START[2]), 0.0, math.log(quality.START[2] / quality.START[0])] * n
    for _ in range(quality.ITERATIONS):
        q = [1 / (1 + math.exp(-(math.log(p / (1 - p)) + sum(weights[3 * j + v + 1] for j, v in enumerate(vs))))) for vs in votes]
        g, b = [0.0] * (3 * n), [0.0] * (3 * n)
        for vs, x in zip(votes, q, strict=True):
            for j, v in enumerate(vs):
                g[3 * j + v + 1] += x
                b[3 * j + v + 1] += 1 - x
        s = sum(q)
        ratio = [math.log((g[k] + 1) / (s + 3)) - math.log((b[k] + 1) / (len(q) - s + 3)) for k in range(3 * n)]
        weights = [0.0 if k % 3 == 1 else min(0.0, x) if k % 3 == 0 else max(0.0, x) for k, x in enumerate(ratio)]
        p = max(0.01, min(0.99, s / len(q)))
    assert prior == pytest.approx(p) and w == pytest.approx(weights)


def test_media_of_many_types(spark):
    """Declared types are corrected where the bytes say otherwise, by row."""
    pdf, zipped, wav = b"%PDF-1.4 x startxref 9 %%EOF", gzip.compress(b"hello"), media.wav_bytes(b"\x80" * 64)
    cases = [("application/pdf", pdf, "application/pdf", False), ("text/plain", pdf, "application/pdf", True), ("audio/wav", zipped, "application/gzip", True), ("audio/wav", wav, "audio/wav", False), ("text/plain", b"plain", None, False), (None, zipped, "application/gzip", False), ("x", None, None, False)]
    df = spark.createDataFrame([(i, (d, b)) for i, (d, b, _, _) in enumerate(cases)] + [(7, None)], "doc_id int, media struct<declared:string,bytes:binary>")
    got = rows(media.sniff_media(df, ("doc_id",)))
    assert [(got[i]["detected"], got[i]["corrected"]) for i in range(7)] == [(k, c) for _, _, k, c in cases] and got[7]["media_bytes"] == 0


PAGE = """<html><body class="x"><header><a href=1>Home</a> Site</header><div id="cookie-notice">We use cookies and the of to a in is for the user.</div><main><article><header><h1>T &amp; x</h1>
<div>By Bob</div></header><p>One<b>two</b>  three<p>The end of it.<div class="share">Share</div><ul><li>the first</li><li class="ad">buy</li><li>second</li></ul><form>name</form></article>
<section id="comments"><p>nice</p></section></main><aside>side</aside><script>var t="</p>";</script><footer>&copy; 1</footer>"""


def test_pages(spark):
    long = "the cat of the house and the dog in a box " * 8
    cases = {
        1: (PAGE, "T & x\nOnetwo three\nThe end of it.\nthe first\nsecond"), 2: (None, ""), 3: ("", ""), 4: ("<script>a", ""), 5: ("<p>only words", "only words"),
        6: (f"<div><p>{long}<p>short one<p><a href=x>link link</a></div><div>buy now stuff</div>", long.strip() + "\nshort one"),  # the last block stands next to a block of links
        7: ("<article><p>a &lt; b &#x41;&nbsp;z</p><p>" + "w " * 60000 + "</p></article>", "a < b A z\n" + ("w " * 60000).strip()), 8: ("<article><!-- <p>no</p> --><p>yes</p>", "yes"),
    }
    df = spark.createDataFrame([(k, "u", v[0], 1) for k, v in cases.items()] + [(8, "u", cases[8][0], 1)], "page_id int, url string, html string, text int")
    got = rows(html_text.extract_text(df.drop("text")), "page_id")
    for k, (_, want) in cases.items():
        assert (got[k]["text"], got[k]["n_chars"]) == (want, len(want)), k
    assert html_text.extract_text(df.drop("text").where(F.lit(False))).count() == 0


def by_hand(blocks):
    """The method of the docstring, step by step over whole lists: markup, pass one, the page's own measure, pass two."""
    h = html_text
    size = [len(b.text) for b in blocks]
    dense = [b.links / max(1, n) for b, n in zip(blocks, size, strict=True)]
    words = [[w in h.STOP_WORDS for w in re.findall(r"[^\W\d_]+", b.text.lower())] for b in blocks]
    stops = [sum(w) / max(1, len(w)) for w in words]
    free = [i for i, b in enumerate(blocks) if not b.zone]
    article = [i for i in free if blocks[i].section]
    listed = any(size[i] >= 70 and stops[i] >= 0.10 for i in free)
    sentence = [bool(re.search(r"[.!?…]", b.text)) for b in blocks]
    prose = lambda i: (size[i] > 140 and stops[i] >= 0.15) if listed else (size[i] > 140 and sentence[i])
    label: dict[int, bool | None] = {}
    linked, speaks = set(), set()
    for i in free:
        b = blocks[i]
        if article and not b.section:
            label[i] = i < article[0] and not b.links and size[i] >= 70 and prose(i)
            speaks |= {i} if label[i] else set()
            continue
        beside = [j for j in (i - 1, i + 1) if j in free and blocks[j].section == b.section and dense[j] > 0.5]
        menu = (dense[i] > 0.5 and (beside or not b.section)) or (not b.section and (b.text.startswith("©") or (size[i] < 70 and dense[i] > 0.2 and not re.search(r"[.!?…]", b.text[-2:]))))
        if menu:
            label[i] = False
            linked.add(i)
        elif dense[i] > 0.5 or size[i] < 70 or (dense[i] > 0.2 and not b.section):
            label[i] = None
        else:
            label[i] = True if prose(i) else None if b.section or not listed or stops[i] >= 0.10 else False
        if label[i] or (label[i] is False and not b.section):
            speaks.add(i)
    if not article and not any(label.values()):
        some = [i for i in free if label[i] is None and dense[i] <= 0.2]
        for i in some:
            if 2 * size[i] >= max(size[j] for j in some):
                label[i] = True
                speaks.add(i)
    out = []
    for i, b in enumerate(blocks):
        told = [j for j in sorted(speaks) if blocks[j].section == b.section]
        later = [j for j in told if j > i]
        if i not in label or label[i] is not None:
            out.append(bool(label.get(i)))
        elif b.heading and i + 1 in linked and blocks[i + 1].section == b.section:
            out.append(False)
        elif b.heading and later:
            out.append(label[later[0]])
        elif told:
            least = min(abs(j - i) for j in told)
            out.append(any(label[j] for j in told if abs(j - i) == least))
        else:
            out.append(b.section > 0)
    return out


def test_two_passes_by_hand():
    r = random.Random(8)
    stop, other = ["the", "of", "and", "to", "in"], ["zarp", "blint", "quome", "fendle", "grist"]
    for _ in range(400):
        blocks = []
        for _ in range(r.randrange(1, 14)):
            text = r.choice(("© ", *[""] * 9)) + " ".join(r.choice(stop if r.random() < r.choice((0.05, 0.12, 0.4)) else other) for _ in range(r.choice((2, 5, 14, 40)))) + r.choice(("", "", " ©", ".", "."))
            blocks.append(html_text.Block(text, r.choice((0, 0, 0, len(text) // 3, len(text))), r.choice((0, 0, 1, 2)), r.random() < 0.2, r.random() < 0.1))
        got = html_text.second_pass(blocks, html_text.first_pass(blocks))
        assert [g for g, _ in got] == by_hand(blocks)


def test_pages_whose_markup_misleads_or_says_nothing():
    main = lambda h: html_text.main_blocks(h)
    assert main("<article><p>one short</p><p><a href=x>a link alone</a></p><p>two short</p></article>") == ["one short", "a link alone", "two short"]
    assert main('<article><p>a</p><div class="social-history">b</div><div class="promo-free">c</div><div class="share-buttons">no</div></article>') == ["a", "b", "c"]
    assert main('<article><p title="' + "x" * 5000 + '>y">z</p></article>') == ["z"] and main('<p class="x"">only</p><article>w</article>') == ["w"]
    assert main("<article><p>text</p><h3>Related</h3><ul><li><a href=1>A</a><li><a href=2>B</a></ul><p>end</p></article>") == ["text", "end"]
    long = "the cat of the house and the dog in a box is to be on it " * 4
    plain = f"<div><div><a href=1>Home</a></div><div><a href=2>News</a></div></div><div>buy it now</div><div><h1>A title</h1><div>{long}</div><div>short words</div><div>{long}</div></div><div>© 2024 us</div>"
    assert main(plain) == ["A title", long.strip(), "short words", long.strip()]  # no helpful element or name anywhere
    # without an article: short paragraphs, one with a copyright sign, one with a link in its sentence, a lead before an article, another script
    short = [f"Paragraph {k} tells of the house and of the garden in it." for k in range(3)]
    assert main("<body>" + "".join(f"<p>{x}</p>" for x in short) + "</body>") == short
    assert main(f"<p>{long}</p><p>The © sign stands in the middle of this text and says nothing of it.</p><p>{long}</p>")[1].startswith("The ©")
    assert main(f"<p>{long}</p><p>See <a href=x>this</a> for it.</p><p>{long}</p>") == [long.strip(), "See this for it.", long.strip()]
    assert main(f"<div>{long}</div><div>short</div><article><p>text</p></article><div>{long}</div>") == [long.strip(), "text"]
    japanese = "この文章は本文であり、記事の要素なしで書かれています。" * 4
    assert main(f"<div><a href=1>ホーム</a></div><div>{japanese}</div><div>短い文。</div><div>{japanese}</div>") == [japanese, "短い文。", japanese]
    assert main("<nav><a href=1>x</a></nav><p>only words") == ["only words"]
    for h in ("<a " * 30_000, '<a ="' * 30_000, "<" * 100_000, "<p " + "a='b' " * 50_000 + ">end"):
        began = time.time()
        assert len(main(h)) <= 1 and time.time() - began < 5
