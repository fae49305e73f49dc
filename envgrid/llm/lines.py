"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, its first token, its second token, where words with digits
are variables from the start. At the leaf the rest of its tokens is cut into PARTS parts (single tokens in short lines).
A template is a way down this tree with up to two of the steps and parts generalised to a variable (one in lines of
under WIDE tokens, none in those of under SHORT), so that lines of at least three quarters of equal tokens, which may differ at the front
as well as behind, share one. Lines are only held against templates if a third of their steps recurs in as many
documents as a template needs; where no third does, no template can. A template with variables needs equal words (no variables) in half of its steps.
A template recurs if at least DOCS different documents have it; its lines are dropped from every document, the others stay.

Documents are told apart by what they hold besides. Seen from a template, a document's own lines are those at most SHARE
as common as the template, wherever they stand; a line is as common as the most common of its templates and, if long, of
two windows of WINDOW tokens, at its least and its greatest token, which mostly stay where a few words were edited. If
they hold more than OWN of its tokens, the document counts as one divided by its number of copies, which is how common
its own lines are (the median, weighted by tokens), so that copies count as one together, and few edits or other
recurring lines change nothing. Documents with less of their own are near copies of each other from this template's view:
together they count as one, and are left to document dedup. All of these compare counts of documents with counts of
documents, so the rule is the same at every size.

Null texts stay null; empty texts and lines without a word stay as they are, as do lines of variables alone. Lines and
texts of any length are parsed in whole. Ties: a line that has several templates goes if one of them recurs. Rows that
repeat an id with the same text are one document and are cut alike. An empty table gives an empty result. Extra columns
are kept with their values; an added column whose name is taken gets an underscore behind it. Lines are told apart by
64-bit hashes, templates by 62 bits and their kind (steps by 32-bit ones), documents by 128 bits of id and text. Counts are aggregated before each shuffle, by template and never within one task
by document, so a line that a third of the documents has is a few rows for each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import KEYS, free_name, map_texts, read, row_keys, small_batches, stage, unstage

PARTS, WINDOW = 6, 4
STEPS = PARTS + 2
SHORT, WIDE = 5, STEPS
DOCS, SHARE = 5, 0.5
#: Documents that share all but a quarter of their tokens or less may be near copies at 0.75; with more of their own they are none.
OWN = 0.25
#: The low two bits of a key: a whole line, a window of a line, a template with variables.
LINE, WINDOWS, TEMPLATE = range(3)
#: The steps in a third: any two variable steps leave one third whole.
THIRDS = ((0, 3), (3, 6), (6, 8))
#: Bytes of texts that are parsed together: the arrays of a slice take some hundred times as much.
SLICE = 1 << 20
SPACES = np.isin(np.arange(256), [*range(9, 14), 32])
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


#: The base of the hashes' powers, and its inverse modulo 2^64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers of 0 up to n."""
    if len(POWERS[0]) <= n:
        m = 1 << int(n).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            POWERS[k] = np.multiply.accumulate(np.r_[U(1), np.full(m, base, U)])
    return POWERS[0], POWERS[1]


class Sums:
    """Hashes of any stretch of a sequence of numbers, from its sums of powers."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.upto = np.r_[U(0), np.cumsum(values * up[: len(values)])]

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.upto[j] - self.upto[i]) * self.down[i]


def tokens_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, whether it is a variable, place of its first byte) of each token; tokens with digits are variables and have one hash."""
    space = SPACES[b]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    hashes = mixed(Sums(byte_codes()[b]).between(start, end))
    digits = np.r_[0, np.cumsum((b >= 48) & (b <= 57))]
    variable = digits[end] > digits[start]
    hashes[variable] = U(0)
    return hashes, variable, start


def line_table(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The lines with a constant word of texts without line breaks at their ends: doc, i, n, w, steps (STEPS columns), thirds, windows (0: none), first (of its kind in its text)."""
    with np.errstate(over="ignore"):
        b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        h, variable, at = tokens_of(b)
        breaks = np.flatnonzero(b == 10)
        line_of = np.searchsorted(breaks, at)  # of each token
        head = np.flatnonzero(np.r_[True, np.diff(line_of) != 0]) if len(at) else np.zeros(0, np.int64)
        n = np.diff(np.r_[head, len(at)])
        words = np.r_[0, np.cumsum(~variable)]
        some = words[head + n] > words[head]
        head, n, line = head[some], n[some], line_of[head][some]
        sums = Sums(h)
        w = mixed(sums.between(head, head + n) + n.astype(U))
        # edges of the steps: each token of a short line, else the two leading tokens and the rest in parts
        k = np.arange(STEPS + 1)
        edges = np.where((n <= WIDE)[:, None], np.minimum(k, n[:, None]), np.where(k < 3, k, 2 + (n[:, None] - 2) * np.maximum(k - 2, 0) // PARTS)) + head[:, None]
        left, right = edges[:, :-1], edges[:, 1:]
        steps = (mixed(sums.between(left, right) + U(1)) >> U(32)).astype(np.uint32)
        steps[words[right] == words[left]] = 0  # variables alone, or none
        thirds = np.stack([mixed(sums.between(edges[:, x], edges[:, y]) + n.astype(U) * U(3) + U(j + 1)) for j, (x, y) in enumerate(THIRDS)], axis=1)
        # windows at the tokens of least and of greatest hash
        token_line = np.repeat(np.arange(len(head)), n)
        mine = np.arange(len(token_line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head, n)
        windows = np.zeros((len(head), 2), U)
        if len(head):
            first_token = np.r_[0, np.cumsum(n)[:-1]]
            for j, best in enumerate((np.minimum, np.maximum)):
                here = np.flatnonzero(h[mine] == np.repeat(best.reduceat(h[mine], first_token), n))
                place = mine[here[np.r_[True, np.diff(token_line[here]) != 0]]]
                windows[:, j] = mixed(sums.between(place, np.minimum(place + WINDOW, head + n))) | U(1)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first_line = np.searchsorted(breaks, starts[:-1])
    doc = np.searchsorted(first_line, line, "right") - 1
    order = np.lexsort((np.arange(len(w)), w, doc))
    first = np.zeros(len(w), bool)
    first[order] = np.r_[True, (np.diff(doc[order]) != 0) | (w[order][1:] != w[order][:-1])] if len(w) else False
    return {"doc": doc, "i": line - first_line[doc], "n": n, "w": w, "steps": steps, "thirds": thirds, "windows": windows, "first": first}


def parse_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rid2, total, lines array<struct<i, w, n, first, s1..s4, t1..t3, a, b>>) of each text; w is a line's hash, n its tokens, s its steps in pairs, t their thirds, a and b its windows; total is the tokens of its different lines."""
    rows = df.where(F.col(text_col).isNotNull()).select(*row_keys(id_col, text_col), F.col(text_col).alias("text"))

    def make():
        def run(texts: list) -> dict:
            found = line_table([t.encode() for t in texts])
            n, wide = found["n"], found["n"] >= SHORT
            pairs = np.ascontiguousarray(found["steps"]).view(np.int64)
            total = np.bincount(found["doc"], np.where(found["first"], n, 0), len(texts)).astype(np.int64)
            columns = {"i": found["i"].astype(np.int32), "w": found["w"].view(np.int64), "n": n.astype(np.int32), "first": found["first"]}
            columns |= {f"s{j + 1}": np.where(wide, pairs[:, j], 0) for j in range(STEPS // 2)}
            thirds, windows = (np.ascontiguousarray(found[c]).view(np.int64) for c in ("thirds", "windows"))
            columns |= {f"t{j + 1}": thirds[:, j] for j in range(3)} | {"a": windows[:, 0], "b": windows[:, 1]}
            each = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))
            ends = np.r_[0, np.cumsum(np.bincount(found["doc"], minlength=len(texts)))]
            return {"total": pa.array(total), "lines": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)}

        return run

    return map_texts(rows, make, "rid long, rid2 long, total long, lines array<struct<i:int,w:long,n:int,first:boolean,s1:long,s2:long,s3:long,s4:long,t1:long,t2:long,t3:long,a:long,b:long>>", "text", KEYS, SLICE)


def template_keys(steps: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the templates with variables of lines given by their steps (STEPS columns) and numbers of tokens."""
    out_line, out_key = [], []
    with np.errstate(over="ignore"):
        for k in range(SHORT, WIDE + 1):
            rows = np.flatnonzero(np.minimum(n, WIDE) == k)
            s = steps[rows, :k].astype(U)
            terms = mixed((s + U(1)) * (U(2) * np.arange(1, k + 1, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
            whole, words = terms.sum(axis=1) + n[rows].astype(U) * U(BASE), s > 0
            for gone in combinations(range(k), 1 if k < WIDE else 2):
                held = mixed(whole - terms[:, gone].sum(axis=1) + U(1 + sum((g + 1) << (8 * j) for j, g in enumerate(gone))))
                ok = words.sum(axis=1) - words[:, gone].sum(axis=1) >= k / 2
                out_line.append(rows[ok])
                out_key.append(((held[ok] & ~U(3)) | U(TEMPLATE)).view(np.int64))
    return np.concatenate(out_line), np.concatenate(out_key)


def template_rows(kinds: DataFrame) -> DataFrame:
    """(w, docs, key) of the templates with variables of kinds of lines (w, n, docs, s1..s4)."""
    small_batches(kinds.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs = np.stack([batch.column(f"s{j + 1}").to_numpy() for j in range(STEPS // 2)], axis=1)
                line, key = template_keys(np.ascontiguousarray(pairs).view(np.uint32), batch.column("n").to_numpy())
                take = pa.array(line)
                yield pa.RecordBatch.from_arrays([batch.column("w").take(take), batch.column("docs").take(take), pa.array(key)], names=["w", "docs", "key"])

    return kinds.select("w", "docs", "n", "s1", "s2", "s3", "s4").mapInArrow(run, "w long, docs long, key long")


def witnesses(batch: pa.RecordBatch, docs: int, share: float) -> pa.RecordBatch:
    """(key, docs, rest): for each template of each document the documents that it counts as, or that it is one of the rest."""
    found = batch.column("found").combine_chunks() if isinstance(batch.column("found"), pa.ChunkedArray) else batch.column("found")
    total = batch.column("total").to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
    parts = found.flatten()
    w, key, n, sizes = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("w", "key", "n", "size"))
    # lines, as common as the most common of their keys, in order of that within their document
    by_line = np.lexsort((w, doc))
    starts = np.flatnonzero(np.r_[True, (np.diff(doc[by_line]) != 0) | (np.diff(w[by_line]) != 0)])
    common, line_doc, size = np.maximum.reduceat(n[by_line], starts), doc[by_line][starts], sizes[by_line][starts]
    order = np.lexsort((common, line_doc))
    common, line_doc, size = common[order], line_doc[order], size[order]
    upto = np.r_[0, np.cumsum(size)]
    begin = upto[np.searchsorted(line_doc, np.arange(batch.num_rows))]
    alone = total - np.bincount(line_doc, size, batch.num_rows).astype(np.int64)  # tokens of lines that no other document has
    # templates
    often = np.flatnonzero((n >= docs) & (key & 1 == 0))
    by_key = often[np.lexsort((key[often], doc[often]))]
    by_key = by_key[np.r_[True, (np.diff(doc[by_key]) != 0) | (np.diff(key[by_key]) != 0)]] if len(by_key) else by_key
    d, base = doc[by_key], int(n.max(initial=0)) + 1
    end = upto[np.searchsorted(line_doc * base + common, d * base + np.floor(share * n[by_key]).astype(np.int64), "right")]
    own = alone[d] + end - begin[d]
    middle = np.searchsorted(upto[1:], own / 2 - alone[d] + begin[d])
    copies = np.where(2 * alone[d] >= own, 1, common[np.minimum(middle, len(common) - 1)])
    differs = own > OWN * total[d]
    return pa.RecordBatch.from_arrays([pa.array(key[by_key]), pa.array(np.where(differs, 1 / copies, 0.0)), pa.array(~differs)], names=["key", "docs", "rest"])


def wide_templates(kinds: DataFrame, docs: int = DOCS) -> DataFrame:
    """(w, found array<struct<key, n>>): the templates with variables of kinds of lines (w, n, docs, steps, thirds) that at least docs documents have, and more than have the line itself.

    Templates of the very same lines recur together or not at all, in the same documents, and read the same: they go by the
    least key of them. So a line has a row for each different set of lines that it shares a template with, not for each of 28 ways to it.
    """
    thirds = kinds.where(f"n >= {SHORT}").select("w", "docs", F.explode(F.array("t1", "t2", "t3")).alias("third"))
    likely = stage(thirds.groupBy("third").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= docs).select("third"), "likely")
    some = thirds.select("w", "third").join(likely, "third", "left_semi").select("w").distinct()
    each = stage(template_rows(kinds.join(some, "w", "left_semi")), "wide")
    # sets of lines are told apart by their size, their documents and 128 bits
    of = [F.bit_xor(F.xxhash64("w", F.lit(j))).alias(f"of{j}") for j in (1, 2)]
    shared = each.groupBy("key").agg(F.sum("docs").alias("n"), F.count("*").alias("lines"), *of).where((F.col("n") >= docs) & (F.col("lines") > 1))
    often = stage(shared.groupBy("n", "lines", "of1", "of2").agg(F.min("key").alias("key")).select("key", "n"), "often")
    out = stage(each.join(often, "key").where("n > docs").groupBy("w").agg(F.collect_list(F.struct("key", "n")).alias("found")), "templates")
    unstage(likely, each, often)
    return out


def keyed_lines(parsed: DataFrame, docs: int = DOCS) -> tuple[DataFrame, DataFrame]:
    """(rid, rid2, total, found array<struct<i, w, size, key, n>>), staged: the keys of each text's lines that n texts have (two or more; docs or more for templates with variables); and (w, found array<struct<key, n>>), staged: those of each kind of line, without windows."""
    lines = parsed.select(*KEYS, "total", F.explode("lines").alias("x")).select(*KEYS, "total", "x.*")
    values = ("n", "s1", "s2", "s3", "s4", "t1", "t2", "t3")
    kinds = stage(lines.where("first").groupBy("w").agg(F.count("*").alias("docs"), *[F.max(c).alias(c) for c in values]), "kinds")
    wide = wide_templates(kinds, docs)
    whole = kinds.where("docs > 1").selectExpr("w", f"w & ~3L | {LINE}L AS key", "docs AS n").join(wide, "w", "full")
    known = stage(whole.selectExpr("w", "concat(CASE WHEN key IS NOT NULL THEN array(struct(key, n)) ELSE array() END, coalesce(found, array())) AS found"), "known")
    # windows are counted once a text
    windows = parsed.select(F.explode(F.array_distinct(F.flatten(F.transform(F.filter("lines", lambda x: x["n"] >= WIDE), lambda x: F.array(x["a"], x["b"]))))).alias("window"))
    shared = stage(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "windows")
    seen = lines.where(f"n >= {WIDE}").select(*KEYS, "total", "i", "w", F.col("n").alias("size"), F.explode(F.array("a", "b")).alias("window")).join(shared, "window")
    rows = lines.select(*KEYS, "total", "i", "w", F.col("n").alias("size")).join(known, "w").select(*KEYS, "total", "i", "w", "size", F.explode("found").alias("x")).select(*KEYS, "total", "i", "w", "size", "x.key", "x.n")
    both = rows.unionByName(seen.selectExpr(*KEYS, "total", "i", "w", "size", f"window & ~3L | {WINDOWS}L AS key", "n"))
    out = stage(both.groupBy(*KEYS).agg(F.max("total").alias("total"), F.collect_set(F.struct("i", "w", "size", "key", "n")).alias("found")), "keyed")
    unstage(kinds, wide, shared)
    return out, known


def recurring(keyed: DataFrame, docs: int = DOCS, share: float = SHARE) -> DataFrame:
    """(key, n_docs) of the templates that recur."""
    small_batches(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield witnesses(batch, docs, share)

    seen = keyed.where(F.exists("found", lambda x: x["n"] >= docs)).mapInArrow(run, "key bigint, docs double, rest boolean")
    counted = seen.groupBy("key").agg((F.round(F.round(F.sum("docs"), 6)) + F.max(F.col("rest").cast("int"))).cast("long").alias("n_docs"))
    return counted.where(F.col("n_docs") >= docs)


def template_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = DOCS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(places of known lines (rid, rid2, i, w), the recurring templates of each kind of line (w, key, n_docs)); row_keys gives rid and rid2, i is a line's place."""
    parsed = stage(parse_lines(df, id_col, text_col), "lines")
    keyed, known = keyed_lines(parsed, docs)
    unstage(parsed)
    found = stage(recurring(keyed, docs, share), "templates")
    places = keyed.select(*KEYS, F.explode(F.expr("array_distinct(transform(filter(found, x -> x.key & 1 = 0), x -> struct(x.i, x.w)))")).alias("x")).select(*KEYS, "x.i", "x.w")
    return places, known.select("w", F.explode("found").alias("x")).select("w", "x.key").join(found, "key")


def templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = DOCS, share: float = SHARE) -> DataFrame:
    """(template, n_docs): the recurring templates as texts, tokens that differ among a template's lines written as <*>."""
    places, of = template_lines(df, id_col, text_col, docs, share)
    gone = places.join(of, "w")
    texts = df.select(*row_keys(id_col, text_col), F.split(text_col, "\n").alias("lines")).dropDuplicates([*KEYS])
    named = gone.join(texts, list(KEYS)).select("key", "n_docs", F.expr("array_remove(split(regexp_replace(lines[i], '[^\\\\x20\\\\x09-\\\\x0D]*[0-9][^\\\\x20\\\\x09-\\\\x0D]*', '<*>'), '[\\\\x20\\\\x09-\\\\x0D]+'), '')").alias("t"))
    tokens = named.select("key", "n_docs", F.posexplode("t").alias("k", "t")).groupBy("key", "n_docs", "k").agg(F.when(F.min("t") == F.max("t"), F.min("t")).otherwise("<*>").alias("t"))
    whole = tokens.groupBy("key", "n_docs").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "t")))["t"], " ").alias("template"))
    return whole.groupBy("template").agg(F.max("n_docs").alias("n_docs"))  # several ways down the tree may hold the same lines


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = DOCS, share: float = SHARE, counts: bool = True) -> DataFrame:
    """df with recurring lines cut from the text, and (with counts) n_lines and n_dropped."""
    taken = [*df.columns]
    rid, rid2, gone, n_lines, n_dropped = (free_name(taken, c) for c in (*KEYS, "gone", "n_lines", "n_dropped"))
    # a line goes by its kind, once, however many of its templates recur
    places, of = template_lines(df, id_col, text_col, docs, share)
    cut = places.join(of.select("w").distinct(), "w").groupBy(F.col("rid").alias(rid), F.col("rid2").alias(rid2)).agg(F.collect_set("i").alias(gone))
    marked = df.select("*", *row_keys(id_col, text_col, (rid, rid2))).join(cut, [rid, rid2], "left")
    kept = F.expr(f"CASE WHEN `{gone}` IS NULL THEN `{text_col}` ELSE array_join(filter(split(`{text_col}`, '\\n'), (l, i) -> NOT array_contains(`{gone}`, i)), '\\n') END")
    out = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if counts:
        out += [F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).alias(n_dropped)]
    return marked.select(*out)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(documents).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_kept_bytes"))


QUERIES = {"op9_lines": op9_lines}
