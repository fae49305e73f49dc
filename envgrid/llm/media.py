"""Media columns: signature sniffing with an Aho-Corasick scan, format validators and carving.

A media column holds the stored bytes of a file beside the type that its producer declared. ``write_wav`` stores any
payload as 8-bit mono samples; ``sniff_media`` reads stored bytes, finds magic bytes and end marks at every offset in one
Aho-Corasick pass, has a validator confirm the structure and length of each hit, corrects the declared type, lists the
media embedded in the file and computes features of samples. A validator's walk from a place that has led nowhere before
ends there, so hits that share their walks cost one; bytes of any length are read in whole.

Null and empty payloads are one block of zero bytes, a null medium has no bytes; a null declared type is never corrected;
repeated rows give repeated results; of media that overlap, the first and outermost counts (a tie can't be, as one place
has one type); extra columns are ignored; an empty table gives an empty result. Rows are independent, so no step shuffles.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from envgrid.llm.common import pieces, read, small_batches

BLOCK = 64
RATE = 8000
WAV = "audio/wav"


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """Payload as a RIFF file of unsigned 8-bit mono samples; an odd payload gets RIFF's pad byte."""
    data = payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + data


def wav_chunks(b: bytes, at: int = 0) -> tuple[int, tuple, bytes] | None:
    """(length of the file, fields of fmt, samples) of a RIFF/WAVE file at an offset, or None if its structure is broken."""
    if b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    fmt, data, i = None, None, at + 12
    while i + 8 <= end:
        tag, n = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        if i + 8 + n > end:
            return None
        if tag == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, i + 8)
        elif tag == b"data":
            data = (i + 8, i + 8 + n)
        i += 8 + n + (n & 1)
    return (end - at, fmt, b[data[0] : data[1]]) if fmt and data is not None else None


class Chunks:
    """The RIFF chunks that walks through a file's bytes have met, each of which leads to one place behind it.

    Walks from different places share what they have in common: a place holds a pointer to the next one and one that jumps
    further, so the last chunk before a limit is found in a logarithmic number of steps, whatever other walks ran through it.
    """

    def __init__(self, b: bytes):
        self.b, self.next, self.jump, self.deep, self.fmt, self.data = b, {}, {}, {}, {}, {}

    def walk(self, start: int) -> None:
        way, i = [], start
        while i not in self.deep:
            way.append(i)
            if i + 8 > len(self.b):
                break
            n = struct.unpack_from("<I", self.b, i + 4)[0]
            self.next[i] = i + 8 + n + (n & 1)
            i = self.next[i]
        for i in reversed(way):
            if i not in self.next:  # too near the end for a chunk
                self.deep[i], self.jump[i], self.fmt[i], self.data[i] = 0, i, 0, 0
                continue
            to, tag = self.next[i], self.b[i : i + 4]
            far = self.jump[to]
            self.deep[i] = self.deep[to] + 1
            self.jump[i] = self.jump[far] if self.deep[to] - self.deep[far] == self.deep[far] - self.deep[self.jump[far]] else to
            self.fmt[i] = self.fmt[to] + (tag == b"fmt " and to - i >= 24)
            self.data[i] = self.data[to] + (tag == b"data")

    def length(self, at: int) -> int:
        """Length of a RIFF/WAVE file at an offset, 0 if its structure is broken."""
        if self.b[at + 8 : at + 12] != b"WAVE":
            return 0
        end, start = at + 8 + struct.unpack_from("<I", self.b, at + 4)[0], at + 12
        if end > len(self.b) or start + 8 > end:
            return 0
        self.walk(start)
        i = start
        while (to := self.next.get(i)) is not None and to + 8 <= end:
            i = self.jump[i] if self.jump[i] + 8 <= end else to
        if i + 8 + struct.unpack_from("<I", self.b, i + 4)[0] > end:
            return 0
        behind = self.next[i]
        whole = self.fmt[start] > self.fmt[behind] and self.data[start] > self.data[behind]
        return end - at if whole else 0


class Scan:
    """What one pass over a file's bytes has found: the places of end marks, the chunks, and where walks have led nowhere."""

    def __init__(self, b: bytes) -> None:
        self.ends: dict[bytes, list[int]] = {m: [] for m in MARKS}
        self.dead: dict[str, set[int]] = {}
        self.chunks = Chunks(b)
        self.packed: dict[int, bool] = {}

    def walk(self, kind: str, at: int, start: int, step: Callable[[int], tuple[int, bool]]) -> int:
        """Length of a file at an offset: steps from a place to (next place, done), a next place of 0 being a broken structure."""
        dead, way, i = self.dead.setdefault(kind, set()), [], start
        while i and i not in dead:
            way.append(i)
            i, done = step(i)
            if done:
                return i - at
        dead.update(way)
        return 0


#: Marks that end a file, looked up in the same pass as the signatures.
MARKS = (b"%%EOF", b"startxref")


def _wav(b: bytes, at: int, scan: Scan) -> int:
    return scan.chunks.length(at)


def _png(b: bytes, at: int, scan: Scan) -> int:
    if b[at + 12 : at + 16] != b"IHDR":
        return 0

    def step(i: int) -> tuple[int, bool]:
        if i + 12 > len(b):
            return 0, False
        n = struct.unpack_from(">I", b, i)[0]
        end = i + 12 + n
        if end > len(b) or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, end - 4)[0] or (i > at + 8 and b[i + 4 : i + 8] == b"IHDR"):
            return 0, False
        return end, b[i + 4 : i + 8] == b"IEND"

    return scan.walk("png", at, at + 8, step)


def _gif(b: bytes, at: int, scan: Scan) -> int:
    if len(b) < at + 13:
        return 0

    def step(i: int) -> tuple[int, bool]:
        if i >= len(b):
            return 0, False
        if b[i] == 0x3B:
            return i + 1, True
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 < len(b):
            i += 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 128 else 0)
        else:
            return 0, False
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1, False

    return scan.walk("gif", at, at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0), step)


def _jpeg(b: bytes, at: int, scan: Scan) -> int:
    def step(i: int) -> tuple[int, bool]:
        if i + 4 > len(b) or b[i] != 0xFF:
            return (i + 2, True) if b[i : i + 2] == b"\xff\xd9" else (0, False)
        kind, n = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if kind == 0xD9:
            return i + 2, True
        if n < 2:
            return 0, False
        i += 2 + n
        if kind == 0xDA:
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            return (0, False) if i < 0 or i + 1 >= len(b) else (i, False)
        return i, False

    return scan.walk("jpeg", at, at + 2, step)


def _bmp(b: bytes, at: int, scan: Scan) -> int:
    if len(b) < at + 30:
        return 0
    n, _, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    rows = ((abs(w) * bits + 31) // 32) * 4 * abs(h)
    return n if head >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 54 <= start <= n and start + rows <= n and at + n <= len(b) else 0


def _gzip_body(b: bytes, at: int) -> int:
    """Where the packed data of a gzip file begin, 0 if its header is broken."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    flags, i = b[at + 3], at + 10
    if flags & 4:
        i += 2 + struct.unpack_from("<H", b, i)[0]
    for bit in (8, 16):  # name and comment
        if flags & bit:
            i = b.find(b"\0", i) + 1
            if not i:
                return 0
    i += 2 * (flags >> 1 & 1)
    return i if i + 8 < len(b) else 0


def _inflated(z, b: bytes, at: int, part: int = 1 << 16) -> int:
    """The place behind a packed stream, 0 if it is broken or doesn't end."""
    try:
        for i in range(at, len(b), part):
            rest = b[i : i + part]
            while rest and not z.eof:
                z.decompress(rest, 1 << 20)
                rest = z.unconsumed_tail
            if z.eof:
                return min(len(b), i + part) - len(z.unused_data)
    except zlib.error:
        pass
    return 0


def _gzip(b: bytes, at: int, scan: Scan) -> int:
    """Stored blocks begin at whole bytes, so those of different files share their walk; a packed block at such a place is tried once with every distance allowed, and where even that fails no file comes through it."""
    def step(i: int) -> tuple[int, bool]:
        if i + 5 > len(b):
            return 0, False
        if b[i] & 6:
            if i not in scan.packed:
                scan.packed[i] = bool(_inflated(zlib.decompressobj(-15, bytes(32768)), b, i))
            return (i, True) if scan.packed[i] else (0, False)
        n, m = struct.unpack_from("<HH", b, i + 1)
        end = i + 5 + n
        return (end, bool(b[i] & 1)) if n ^ m == 0xFFFF and end <= len(b) else (0, False)

    start = _gzip_body(b, at)
    if not start or not scan.walk("gzip", at, start, step):
        return 0
    end = _inflated(zlib.decompressobj(31), b, at)
    return end - at if end else 0


def _pdf(b: bytes, at: int, scan: Scan) -> int:
    ends, tables = (scan.ends[m] for m in MARKS)
    k = bisect_left(ends, at)
    j = bisect_left(tables, at)
    return ends[k] + len(MARKS[0]) - at if k < len(ends) and j < len(tables) and tables[j] < ends[k] else 0


#: The magic bytes of each type.
SIGNATURES: tuple[tuple[bytes, str, Callable[[bytes, int, Scan], int]], ...] = (
    (b"RIFF", WAV, _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
)


def automaton() -> ahocorasick.Automaton:
    """All magic bytes and end marks in one automaton; bytes are looked up as the characters of the same numbers."""
    a = ahocorasick.Automaton()
    for k, word in enumerate([magic for magic, _, _ in SIGNATURES] + list(MARKS)):
        a.add_word(word.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(b: bytes, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed medium, outermost first; hits inside a carved medium are skipped, but for the file at offset 0."""
    scan, hits = Scan(b), []
    for end, k in words.iter(b.decode("latin-1")):
        if k < len(SIGNATURES):
            hits.append((end + 1 - len(SIGNATURES[k][0]), k))
        else:
            mark = MARKS[k - len(SIGNATURES)]
            scan.ends[mark].append(end + 1 - len(mark))
    found, free = [], 0
    for at, k in hits:
        _, kind, confirm = SIGNATURES[k]
        if (at == 0 or at >= free) and (n := confirm(b, at, scan)):
            found.append((kind, at, n))
            free = at + n if at else 0
    return found


def sample_features(data: bytes) -> tuple[int, float, int]:
    """(mean in thousandths, root mean square around the middle, sign changes) of unsigned 8-bit samples."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    if not len(x):
        return 0, 0.0, 0
    return int(x.sum() * 1000 // len(x)), round(float(np.sqrt((x * x).sum() / len(x))), 4), int((np.diff(x < 0)).sum())


def write_wav(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """(id, n_bytes, media struct<declared, bytes>): each text's UTF-8, zero-padded to a positive multiple of 64, as 8-bit samples."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                raw = [(v.encode() if v else b"") for v in part.column(text_col).to_pylist()]
                stored = [wav_bytes(r + b"\0" * (-len(r) % BLOCK if r else BLOCK)) for r in raw]
                media = pa.StructArray.from_arrays([pa.array([declared] * len(raw), pa.string()), pa.array(stored, pa.binary())], ["declared", "bytes"])
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(map(len, raw), pa.int64()), media], [id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media struct<declared:string,bytes:binary>")


def sniff_media(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), with_payload: bool = True) -> DataFrame:
    """Adds declared, detected (null if nothing at offset 0 is confirmed), corrected, media_bytes, media_sha256, carved and, for audio, rate, channels, bits, the samples' mean, root mean square and sign changes, and the payload's figures."""
    small_batches(df.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + ", declared string, detected string, corrected boolean, media_bytes long, media_sha256 string, carved array<struct<kind:string,start:long,n:long>>, rate int, channels int, bits int, mean_milli int, rms double, sign_changes int, payload_bytes long, payload_sha256 string, tail_crc32 long"
    carved_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton()
        for batch in batches:
            rows = []
            for m in batch.column("media"):
                m = m.as_py() or {"declared": None, "bytes": None}
                b = m["bytes"] or b""
                found = sniff(b, scan)
                kind = found[0][0] if found and found[0][1] == 0 else None
                (_, fmt, data) = wav_chunks(b) if kind == WAV else (0, (0, 0, 0, 0, 0, 0), b)
                rows.append((m["declared"], kind, kind is not None and m["declared"] is not None and kind != m["declared"], len(b), hashlib.sha256(b).hexdigest(), [{"kind": k, "start": at, "n": n} for k, at, n in found if at], *((fmt[2], fmt[1], fmt[5], *sample_features(data)) if kind == WAV else (None,) * 6), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:])))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), carved_type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], [*keep, "declared", "detected", "corrected", "media_bytes", "media_sha256", "carved", "rate", "channels", "bits", "mean_milli", "rms", "sign_changes", "payload_bytes", "payload_sha256", "tail_crc32"])

    return df.select(*keep, "media").mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sniff_media(write_wav(read(spark, sf_dir, "documents")))
    return found.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "concat_ws(';', coalesce(detected, 'unknown'), concat('declared=', declared), concat('corrected=', corrected), concat('rate=', rate), concat('bits=', bits), concat('mean=', mean_milli), concat('rms=', rms), concat('turns=', sign_changes), concat('carved=', array_join(transform(carved, c -> concat(c.kind, '@', c.start, '+', c.n)), ','))) AS feature",
    )


QUERIES = {"op2_media": op2_media}
