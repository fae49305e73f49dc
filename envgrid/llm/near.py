"""MinHash near-dedup with b-bit signatures.

A document's set holds its distinct five-word shingles. Documents with the same set form a class at once; one row for
each class goes on. Minima of ROWS * BANDS hash functions give BANDS band keys and, of every minimum, the lowest BITS
bits, packed. Classes that share a band key are candidates; the share of equal packed values, counted by bits and
corrected for chance collisions, estimates their similarity, and pairs far below the threshold (MARGIN, over four
standard errors) go no further. What is left is confirmed on the full sets of both texts.

Each class takes as its hub the bucket head most like it (of a similarity of HUB or more by estimate), and the hubs'
hubs lead to a root. A class is confirmed against its root alone, which gives the link and how its set differs from the
root's: the root's shingles that it lacks, as bits, and its own ones. From these differences the exact similarity of two
classes of one root follows without their texts. So the classes that are not linked with their root are held against all
others of the root in blocks of BLOCK by BLOCK, as arrays in tasks; a spanning forest of a block's links leaves it.
Members of a bucket with different roots are compared by signature in such blocks too, and what is near enough is
confirmed one by one. A root's text goes once to each block of its members. So no task holds more than a block, however
many documents hang together, and a group of copies costs a row for each member and block. A link is lost only where no
band finds it or its estimate is that far off (chances below 1e-5 each at similarity 0.75, less above). Components spread
by joining each class with the least id near it until nothing changes, staged after each round.

Documents without words have an empty set and are linked with nothing; with fewer than five words the whole sequence is
the one shingle. Null texts have no words. Ids are those of documents: a row that is given twice adds nothing but itself; rows of one
id with different texts are one document, linked with what any of its texts is linked with; a row without an id is a text that
others may be linked through, with a null kept; ties go to the smallest id. Texts of any length are read in whole; extra columns are ignored; an empty table gives an
empty result. Sets are compared by 64-bit hashes of their shingles within a root, as strings between roots.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import map_texts, read, small_batches, stage, unstage

WINDOW = 5
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 2
MARGIN = 0.2
HUB = 0.4
BLOCK = 128
SEED = 20240601
WORD = re.compile(r"[^ \t-\r]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
M64 = (1 << 64) - 1


def shingles(text: str | None) -> list[str]:
    """Distinct shingles, in no order."""
    words = WORD.findall(text.translate(UPPER)) if text else []
    if not words:
        return []
    if len(words) < WINDOW:
        return [" ".join(words)]
    return list(set(map(" ".join, zip(*(words[k:] for k in range(WINDOW)), strict=False))))


@lru_cache(maxsize=1)
def functions_() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over the hashes of a set."""
    a, b = functions_()
    out = np.full(len(a), M64, np.uint64)
    for at in range(0, len(hashes), 2048):
        h = hashes[at : at + 2048]
        x = h[None, :] * a[:, None] + b[:, None]
        x ^= x >> np.uint64(29)
        out = np.minimum(out, x.min(axis=1))
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of all minima (of a mixture of them) as int64 words."""
    low = ((minima * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint8)
    bits = ((low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1).ravel()
    return np.packbits(bits).view(np.int64)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_key, bands array<long>, low array<long>); documents without words have no bands."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def run(texts: list) -> dict:
            n, keys, bands, low = [], [], [], []
            for t in texts:
                s = shingles(t)
                n.append(len(s))
                if not s:
                    keys.append(None)
                    bands.append(None)
                    low.append(None)
                    continue
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, s), np.uint64, len(s))
                keys.append(xxhash.xxh3_128_digest(np.sort(h).tobytes()))
                m = signature(h)
                bands.append([xxhash.xxh3_64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(m.reshape(BANDS, ROWS))])
                low.append(packed(m).tolist())
            return {"n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "low": pa.array(low, pa.list_(pa.int64()))}

        return run

    return map_texts(df, make, f"`{id_col}` {kind}, n_shingles long, set_key binary, bands array<long>, low array<long>", text_col, (id_col,))


def similarity_estimate(a: str, b: str) -> F.Column:
    """Of two packed signatures: the share of equal values, less what chance alone makes equal."""
    words = BANDS * ROWS * BITS // 64
    each = "cast(-1 AS bigint)" if BITS == 1 else None
    masks = f"{int('01' * 32, 2)}L"
    terms = []
    for w in range(words):
        x = f"({a}[{w}] ^ {b}[{w}])"
        terms.append(f"bit_count({x})" if each else f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {masks})")
    n = BANDS * ROWS
    chance = 2.0**-BITS
    return F.expr(f"(({n} - ({' + '.join(terms)})) / {n}D - {chance}D) / {1 - chance}D")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets are similar enough; texts has (rep, text)."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b")

    def run(batches):
        last: tuple[str | None, frozenset] = (None, frozenset())
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = x.as_py(), y.as_py()
                if y != last[0]:
                    last = (y, frozenset(shingles(y)))
                s, t = set(shingles(x)), last[1]
                shared = len(s & t)
                ok.append(100 * shared >= PERCENT * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def roots(hubs: DataFrame) -> DataFrame:
    """(rep, root) from (rep, hub), hubs being smaller than what they serve; the ways halve in each round."""
    held = at = stage(hubs.select("rep", F.col("hub").alias("root")), "roots")
    while True:
        up = at.select(F.col("rep").alias("root"), F.col("root").alias("next"))
        new = stage(at.join(up, "root", "left").select("rep", F.col("root").alias("old"), F.coalesce("next", "root").alias("root")), "roots")
        unstage(held)
        held, at = new, new.select("rep", "root")
        if new.where("old <> root").isEmpty():
            return at


def hashed(text: str) -> np.ndarray:
    s = shingles(text)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, s), np.uint64, len(s)))


def dealt(*group: str) -> F.Column:
    """A row's block of its group of ``size`` rows, in blocks of about BLOCK."""
    return F.pmod(F.xxhash64("rep", *group), F.ceil(F.col("size") / BLOCK)).cast("int")


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, root, n, m, linked, lacks, own) of staged (rep, root): sizes of the two sets, whether they are similar enough, the root's shingles that rep lacks (bits), rep's own (hashes)."""
    sizes = stage(pairs.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    members = pairs.join(sizes, "root").select("rep", "root", dealt("root").alias("block")).join(texts, "rep").select("root", "block", F.lit(1).alias("side"), "rep", "text")
    heads = sizes.select(F.col("root").alias("rep"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BLOCK) - 1).cast("int"))).alias("block")).join(texts, "rep").select(F.col("rep").alias("root"), "block", F.lit(0).alias("side"), "rep", "text")
    small_batches(pairs.sparkSession)

    def run(batches):
        last, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            rep, root, n, m, ok, lacks, own = [], [], [], [], [], [], []
            for r, block, side, x, t in zip(*(batch.column(c) for c in ("root", "block", "side", "rep", "text")), strict=True):
                if not side.as_py():
                    last, hub = (r, block), hashed(t.as_py())
                    continue
                if last != (r, block):
                    raise ValueError("a block without its root")
                mine = hashed(t.as_py())
                out = ~np.isin(hub, mine, assume_unique=True)
                shared = len(hub) - int(out.sum())
                rep.append(x.as_py())
                root.append(r.as_py())
                n.append(len(mine))
                m.append(len(hub))
                ok.append(100 * shared >= PERCENT * (len(mine) + len(hub) - shared))
                bits = np.packbits(out)
                lacks.append(bits.tobytes() + b"\0" * (-len(bits) % 8))
                own.append(mine[~np.isin(mine, hub, assume_unique=True)].view(np.int64))
            kind = batch.schema.field("rep").type
            yield pa.RecordBatch.from_arrays([pa.array(rep, kind), pa.array(root, kind), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(ok, pa.bool_()), pa.array(lacks, pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["rep", "root", "n", "m", "linked", "lacks", "own"])

    kind = pairs.schema["rep"].dataType.simpleString()
    both = members.unionByName(heads).repartition("root", "block").sortWithinPartitions("root", "block", "side")
    return both.mapInArrow(run, f"rep {kind}, root {kind}, n int, m int, linked boolean, lacks binary, own array<long>")


def links_by_difference(xs: list[dict], ys: list[dict]) -> list[tuple]:
    """Exact links of each x with each other y of the same root."""
    bits = np.frombuffer(b"".join(y["lacks"] for y in ys), np.uint64).reshape(len(ys), -1)
    gone = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    size = np.array([y["n"] for y in ys], np.int64)
    owners: dict[int, list[int]] = {}
    for i, y in enumerate(ys):
        for h in y["own"]:
            owners.setdefault(h, []).append(i)
    out = []
    for x in xs:
        mine = np.frombuffer(x["lacks"], np.uint64)
        both = np.bitwise_count(bits & mine).sum(axis=1).astype(np.int64)
        shared = x["m"] - int(np.bitwise_count(mine).sum()) - gone + both
        for h in x["own"]:
            if h in owners:
                shared[owners[h]] += 1
        for i in np.flatnonzero(100 * shared >= PERCENT * (x["n"] + size - shared)).tolist():
            if ys[i]["rep"] != x["rep"]:
                out.append((x["rep"], ys[i]["rep"]))
    return out


def forest(links: list[tuple]) -> list[tuple]:
    """Links enough to hold together what the given ones do."""
    parent: dict = {}

    def top(a):
        while parent.setdefault(a, a) != a:
            parent[a] = a = parent[parent[a]]
        return a

    out = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((max(a, b), min(a, b)))
    return out


def links_within_roots(told: DataFrame) -> DataFrame:
    """(a, b): links between classes of one root of which one at least is not linked with it; told is differences()."""
    kind = told.schema["rep"].dataType.simpleString()
    counts = told.groupBy("root").agg(F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("nx"), F.count("*").alias("ny")).where("nx > 0 AND ny > 1")
    rows = told.join(counts, "root").withColumn("bx", F.ceil(F.col("nx") / BLOCK)).withColumn("by", F.ceil(F.col("ny") / BLOCK))
    part = lambda c, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(c))
    xs = rows.where(~F.col("linked")).select("*", part("bx", 1).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("by") - 1)).alias("j"), F.lit(0).alias("side"))
    ys = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bx") - 1)).alias("i"), part("by", 2).alias("j"), F.lit(1).alias("side"))
    both = xs.unionByName(ys).select("root", "i", "j", "side", "rep", "n", "m", "lacks", "own")

    def run(batches):
        key, xs, ys = None, [], []

        def solved():
            found = forest(links_by_difference(xs, ys))
            return pa.RecordBatch.from_pydict({"a": [p[0] for p in found], "b": [p[1] for p in found]}, schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("a", batch.schema.field("rep").type), ("b", batch.schema.field("rep").type)])
            for r in batch.to_pylist():
                k = (r["root"], r["i"], r["j"])
                if k != key:
                    if xs and ys:
                        yield solved()
                    key, xs, ys = k, [], []
                (ys if r["side"] else xs).append(r)
        if xs and ys:
            yield solved()

    return both.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "rep").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_by_estimate(bucketed: DataFrame) -> DataFrame:
    """(a, b): members of a bucket with different roots whose estimate is not far below the threshold; bucketed is a staged (band, key, rep, low, root)."""
    kind = bucketed.schema["rep"].dataType.simpleString()
    sizes = stage(bucketed.groupBy("band", "key").agg(F.count("*").alias("size")), "sizes")
    rows = bucketed.join(sizes, ["band", "key"]).withColumn("mine", dealt("band", "key")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    # a block meets itself and each other one once: i is the smaller of the two
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("side"), "rep", "root", "low")
    least = PERCENT / 100 - MARGIN
    words, values = BANDS * ROWS * BITS // 64, BANDS * ROWS

    def pairs(held: list[tuple]) -> list[tuple]:
        side, rep, root = (np.array([h[k] for h in held]) for k in range(3))
        low = np.array([h[3] for h in held], np.int64).view(np.uint64).reshape(len(held), words)
        out = []
        for k in range(len(held)):
            other = np.flatnonzero((root != root[k]) & ((side & (not side[k])) if side.any() else (np.arange(len(held)) > k)))
            if side[k] or not len(other):
                continue
            x = low[other] ^ low[k]
            differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1).astype(np.int64) if BITS == 2 else np.bitwise_count(x).sum(axis=1).astype(np.int64)
            likely = ((values - differ) / values - 2.0**-BITS) / (1 - 2.0**-BITS)
            for o in other[likely >= least].tolist():
                out.append((held[k][1], held[o][1]) if held[k][2] < held[o][2] else (held[o][1], held[k][1]))
        return out

    def run(batches):
        key, held = None, []
        for batch in batches:
            schema = pa.schema([("a", batch.schema.field("rep").type), ("b", batch.schema.field("rep").type)])
            found = []
            for *k, side, rep, root, low in zip(*(batch.column(c).to_pylist() for c in ("band", "key", "i", "j", "side", "rep", "root", "low")), strict=True):
                if k != key:
                    found += pairs(held) if held else []
                    key, held = k, []
                held.append((side, rep, root, low))
            yield pa.RecordBatch.from_pydict({"a": [p[0] for p in found], "b": [p[1] for p in found]}, schema=schema)
        if held:
            found = pairs(held)
            yield pa.RecordBatch.from_pydict({"a": [p[0] for p in found], "b": [p[1] for p in found]}, schema=schema)

    return met.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least id reachable, for each node that an edge (a, b) has."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
    both = stage(both.distinct(), "edges")
    at = labels = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")), "labels")
    while True:
        # the least label among the neighbours, then the label's own label: paths halve in each round
        heard = both.join(labels.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("heard"))
        moved = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = stage(moved.join(own, "component", "left").select("node", "old", F.coalesce("next", "component").alias("component")), "labels")
        unstage(at)
        at, labels = jumped, jumped.select("node", "component")
        if jumped.where("old <> component").isEmpty():
            return labels


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document."""
    sig = stage(signatures(df, id_col, text_col), "signatures")
    full = sig.where("set_key IS NOT NULL")
    classes = full.groupBy("set_key").agg(F.min(id_col).alias("rep"), F.min(F.struct(F.col(id_col), "bands", "low")).alias("s"))
    reps = stage(classes.select("set_key", "rep", F.col("s.bands").alias("bands"), F.col("s.low").alias("low")), "classes")
    buckets = reps.select(F.posexplode("bands").alias("band", "key"), "rep", "low")
    heads = buckets.groupBy("band", "key").agg(F.min(F.struct("rep", "low")).alias("h"), F.count("*").alias("n")).where("n > 1").select("band", "key", F.col("h.rep").alias("head"), F.col("h.low").alias("head_low"))
    shared = stage(buckets.join(heads, ["band", "key"]), "buckets")
    likely = similarity_estimate("low", "head_low")
    near = shared.where("rep <> head").withColumn("e", likely).where(F.col("e") >= HUB)
    hubs = roots(near.groupBy("rep").agg(F.max_by("head", F.struct("e", F.negative(F.col("head").cast("long")) if dict(df.dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint") else "head")).alias("hub")))
    # texts move once; pairs are joined to those of classes that share a bucket
    texts = stage(df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(shared.select("rep").distinct(), "rep", "left_semi"), "texts")
    told = stage(differences(hubs, texts), "differences")
    first = told.where("linked").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    second = links_within_roots(told)
    # what shares a bucket and has different roots
    named = shared.select("band", "key", "rep", "low").join(hubs, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    apart = named.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key")
    rest = stage(named.join(apart, ["band", "key"]), "apart")
    pairs = near_by_estimate(rest)
    third = confirm(stage(pairs, "pairs"), texts)
    final = components(stage(first.unionByName(second).unionByName(third), "links"))
    named = reps.select("set_key", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select(id_col, "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select(id_col, "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"))


QUERIES = {"op5_near": op5_near}
ORACLES = {
    "op5_near": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
 SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN (SELECT node, min(root) AS c FROM r GROUP BY node) ON node = doc_id""",
}
