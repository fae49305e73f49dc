"""Prefix trie of conversations by the Euler-tour technique: shared beginnings, subtree leaves and saved tokens.

A node stands for a sequence of turns with which conversations begin. Its key is the sum of 128-bit hashes of (depth, role,
text) along the sequence, in four columns that can't overflow; its name is its smallest member and its depth. A node's
smallest member is also that of one child at most, so the nodes of one name-giver form a path downwards.

Each node has an arc that enters and one that leaves it; each arc points to the next one of the tour: from an entered node to
its first child, or back out; from a left one to its next sibling, or to its parent's leaving arc. The child on the same path
comes first, the others by their smallest member. The arcs of a path that follow each other are one element: the first
one enters the path's nodes down to the end and leaves again until a node has other children; each further one leaves from
there on. So the list has one element for each path and one for each node with children beside the path.

The list is ranked by contraction. Elements are sorted by path and dealt into chunks of at most CHUNK; in each chunk pointers
double until they leave it, with the sums of the weights that they pass. Only elements that other chunks point to
go on to the next round; where fewer than a quarter drop out, elements that a coin tells from their predecessors are spliced
out instead. The last CHUNK are ranked in one chunk, and each round's elements get their sums from the ones they point to,
back to the first round. A subtree's leaves and savings are differences of these sums at a node's two arcs.

Running sums and next siblings within a group are made along range partitions: local windows by partition and group, and
what a partition brings on for groups that go on in the next one, of which there is one at most for each partition. So a
conversation with a third of all turns, or a node with a third of all nodes as children, is spread over many tasks.

Turns are ordered by number, null first; turns of one number by role, the first 64 characters of the text and then a hash. Null roles and texts
are empty. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. Texts of any length are
hashed in whole. A conversation may be empty: it ends at the root. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envgrid.llm.common import read, stage

#: Elements that one task ranks at once; a round of the list ranking that leaves more than STALL of them splices next.
CHUNK, STALL = 1 << 18, 0.75
KEY, PARENT = ["k1", "k2", "k3", "k4"], ["p1", "p2", "p3", "p4"]
WEIGHTS = ["leaves", "saved", "nodes"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_range_order(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(df staged in range partitions by group and order with part; the groups of several parts with each of them, one row for each part's border at most)."""
    n = partitions(df.sparkSession)
    rows = stage(df.repartitionByRange(n, *group, *order).withColumn("part", F.spark_partition_id()), name)
    ends = rows.groupBy("part").agg(F.min(F.struct(*group)).alias("low"), F.max(F.struct(*group)).alias("high"))
    on = Window.orderBy("part")  # a row for each partition
    wide = ends.select(F.col("high").alias("g"), (F.col("high") == F.lead("low").over(on)).alias("goes_on")).where("goes_on").select("g.*").distinct()
    return rows, wide


def running(df: DataFrame, group: list[str], order: list[str], sums: list[str], name: str) -> DataFrame:
    """df with x_before, the sum of x over the rows before in the group's order, and x_all, over the whole group, for each x in sums."""
    rows, wide = in_range_order(df, group, order, name)
    local = Window.partitionBy("part", *group)
    before = local.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = rows.select("*", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in sums], *[F.sum(x).over(local).alias(f"{x}_all") for x in sums])
    # of groups that lie in several parts, a row for each part: bounded by the number of partitions
    totals = rows.join(F.broadcast(wide), group, "left_semi").groupBy(*group, "part").agg(*[F.sum(x).alias(x) for x in sums])
    each = Window.partitionBy(*group)
    earlier = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, "part", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"_{x}") for x in sums], *[F.sum(x).over(each).alias(f"__{x}") for x in sums])
    joined = made.join(F.broadcast(carried), [*group, "part"], "left")
    return joined.select(*df.columns, *[(F.col(f"{x}_before") + F.coalesce(f"_{x}", F.lit(0))).alias(f"{x}_before") for x in sums], *[F.coalesce(f"__{x}", f"{x}_all").alias(f"{x}_all") for x in sums])


def followed(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """df with following, the next larger value of the group; values of a group differ."""
    rows, wide = in_range_order(df, group, [value], name)
    made = rows.withColumn("following", F.lead(value).over(Window.partitionBy("part", *group).orderBy(value)))
    firsts = rows.join(F.broadcast(wide), group, "left_semi").groupBy(*group, "part").agg(F.min(value).alias("first"))
    carried = firsts.select(*group, "part", F.lead("first").over(Window.partitionBy(*group).orderBy("part")).alias("first"))
    joined = made.join(F.broadcast(carried), [*group, "part"], "left")
    return joined.select(*df.columns, F.coalesce("following", "first").alias("following"))


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, ha, hb, chars): each turn's place in its conversation from 0, a hash of role and text in two halves, and its code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), F.length(role), role, text).alias("ha"), F.xxhash64(F.lit(2), role, F.length(role), text).alias("hb"),
        F.length(text).cast("long").alias("chars"), F.substring(text, 1, 64).alias("front"), F.monotonically_increasing_id().alias("tie"), F.lit(1).cast("long").alias("one"),
    )
    # windows put null first in ascending order, as the range partitions do; equal rows may lie in several partitions
    made = running(rows, ["conv"], ["turn", "role", "front", "ha", "hb", "tie"], ["one"], "turns")
    return made.select("conv", F.col("one_before").alias("at"), "ha", "hb", "chars")


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, chars, k1 to k4, p1 to p4, last) of turns (conv, depth from 1, ha, hb, chars) and the root of each of convs: keys of the sequence and of the one before."""
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("ha"), F.lit(0).cast("long").alias("hb"), F.lit(0).cast("long").alias("chars"))
    x, y = F.xxhash64("depth", "ha", "hb"), F.xxhash64("hb", "depth", "ha")
    parts = [F.when(F.col("depth") == 0, 0).otherwise(p).cast("long").alias(f"d{k}") for k, p in enumerate((x.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(x, 33), y.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(y, 33)), 1)]
    rows = turns.select("conv", "depth", "ha", "hb", "chars").unionByName(roots).select("conv", "depth", "chars", *parts, F.lit(1).cast("long").alias("one"))
    made = running(rows, ["conv"], ["depth"], ["d1", "d2", "d3", "d4", "one"], "prefixes")
    return made.select("conv", "depth", "chars", *[(F.col(f"d{k}_before") + F.col(f"d{k}")).alias(f"k{k}") for k in range(1, 5)], *[F.col(f"d{k}_before").alias(f"p{k}") for k in range(1, 5)], (F.col("depth") == F.col("one_all") - 1).alias("last"))


def contract(rows: DataFrame, parts: int) -> DataFrame:
    """Elements (c, s, nc, ns, weights) with their pointers led out of their chunk, and the weights that they passed added."""
    ordered = rows.coalesce(1).sortWithinPartitions("c", "s") if parts == 1 else rows.repartitionByRange(parts, "c", "s").sortWithinPartitions("c", "s")
    names = ["c", "s", "nc", "ns", *WEIGHTS]

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        c, s, nc, ns, *w = (table.column(n).to_numpy() for n in names)
        w, to_c, to_s = np.stack(w), nc.copy(), ns.copy()
        # a path's elements stand together, numbered upwards
        front = np.minimum(np.searchsorted(c, nc), len(c) - 1)
        at = np.clip(front + ns - s[front], 0, len(c) - 1)
        at = np.where((ns >= 0) & (c[at] == nc) & (s[at] == ns), at, -1)
        while len(on := np.flatnonzero(at >= 0)):
            to = at[on]
            w[:, on], to_c[on], to_s[on], at[on] = w[:, on] + w[:, to], to_c[to], to_s[to], at[to]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c, s, to_c, to_s, *w)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= CHUNK:
                held.append(batch.slice(0, CHUNK - n))
                yield chunk(held)
                batch, held, n = batch.slice(CHUNK - n), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield chunk(held)

    return ordered.select(*names).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def splice(rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(elements without those that have a coin of 1 and a predecessor of 0, the elements taken out)."""
    tossed = stage(rows.withColumn("coin", F.pmod(F.xxhash64(F.lit(turn), "c", "s"), F.lit(2))), "coins")
    one = tossed.where("coin = 1").drop("coin")
    behind = one.select(F.col("c").alias("nc"), F.col("s").alias("ns"), F.col("nc").alias("_c"), F.col("ns").alias("_s"), *[F.col(w).alias(f"_{w}") for w in WEIGHTS])
    zero = stage(tossed.where("coin = 0").drop("coin").join(behind, ["nc", "ns"], "left"), "spliced")
    out = zero.where("_c IS NOT NULL").select(F.col("nc").alias("c"), F.col("ns").alias("s"), F.col("_c").alias("nc"), F.col("_s").alias("ns"), *[F.col(f"_{w}").alias(w) for w in WEIGHTS])
    longer = zero.select("c", "s", F.coalesce("_c", "nc").alias("nc"), F.coalesce("_s", "ns").alias("ns"), *[(F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in WEIGHTS])
    return longer.unionByName(one.join(out, ["c", "s"], "left_anti")), out


def ranked(rows: DataFrame) -> DataFrame:
    """(c, s, weights) of a list of elements (c, s, nc, ns, weights), ns = -1 at its end: the sums of weights from each element to the end."""
    spark, rounds, stuck = rows.sparkSession, [], False
    rows = stage(rows, "list")
    while (n := rows.count()) > CHUNK:
        if stuck:
            left, out = splice(rows, len(rounds))
            rounds.append((stage(out, "out"), True))
            rows, stuck = stage(left, "list"), False
            continue
        led = stage(contract(rows, max(2, partitions(spark))), "led")
        entered = led.where("ns >= 0").select(F.col("nc").alias("c"), F.col("ns").alias("s")).distinct()
        left = stage(led.join(entered, ["c", "s"], "left_semi"), "list")
        rounds.append((led, False))
        stuck, rows = left.count() > STALL * n, left
    done = contract(rows, 1).drop("nc", "ns")
    for part, taken_out in reversed(rounds):
        done = stage(done, "ranks")
        to = done.select(F.col("c").alias("nc"), F.col("s").alias("ns"), *[F.col(w).alias(f"_{w}") for w in WEIGHTS])
        back = part.join(to, ["nc", "ns"], "left").select("c", "s", *[(F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in WEIGHTS])
        done = done.unionByName(back) if taken_out else back
    return done


def tour_elements(nodes: DataFrame) -> DataFrame:
    """The elements of the Euler tour, (c, s, nc, ns, weights), of staged nodes with their running sums along their paths.

    Element (c, 0) of a path enters it; (c, s) begins with the arc that leaves the s-th node from the end that has other children.
    """
    def element(s, nc, ns):
        return [F.col("conv").alias("c"), s.cast("long").alias("s"), nc.cast("long").alias("nc"), ns.cast("long").alias("ns"), *[F.when(s == 0, F.col(f"{w}_all")).otherwise(0).alias(w) for w in WEIGHTS]]

    branching = nodes.where("branch = 1")
    inner = branching.select(*element(F.col("level") - 1, F.col("first_top"), F.lit(0)))
    tops = followed(nodes.where("conv != parent_conv").select("parent_conv", "depth", "conv", "branch_all", *[f"{w}_all" for w in WEIGHTS]), ["parent_conv", "depth"], "conv", "tops")
    tops = stage(tops, "siblings")
    aside = tops.where("following IS NOT NULL").select(*element(F.col("branch_all"), F.col("following"), F.lit(0)))
    above = branching.select(F.col("conv").alias("parent_conv"), (F.col("depth") + 1).alias("depth"), F.col("level").alias("ns"))
    up = tops.where("following IS NULL").join(above, ["parent_conv", "depth"]).select(*element(F.col("branch_all"), F.col("parent_conv"), F.col("ns")))
    end = nodes.where("depth = 0").select(*element(F.col("branch_all"), F.col("conv"), F.lit(-1)))
    return inner.unionByName(aside).unionByName(up).unionByName(end)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of rows (conv, depth, member): SHA-256 of the members in decimal, ascending, joined by commas.

    Each range partition joins its part of a node's members; only nodes that lie in several partitions are put together from
    these parts, in a stream.
    """
    rows, wide = in_range_order(ends, ["conv", "depth"], ["member"], "ends")
    joined = rows.groupBy("conv", "depth", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("ids"))
    few = joined.join(F.broadcast(wide), ["conv", "depth"], "left_anti").select("conv", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    many = joined.join(F.broadcast(wide), ["conv", "depth"], "left_semi").repartition("conv", "depth").sortWithinPartitions("conv", "depth", "part").select("conv", "depth", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([of[0]], pa.int64()), pa.array([of[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv", "depth", "ends_sha256"])
        for batch in batches:
            for c, d, ids in zip(*(batch.column(n) for n in ("conv", "depth", "ids")), strict=True):
                if (c.as_py(), d.as_py()) != of:
                    if of:
                        yield row()
                    of, digest = (c.as_py(), d.as_py()), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_buffer())
        if of:
            yield row()

    return few.unionByName(many.mapInArrow(run, "conv bigint, depth bigint, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes of turns (conv, depth from 1, ha, hb, chars) and all conversations (conv), the empty ones too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, n_nodes, saved_tokens, ends_sha256); the last turn of a node is turn depth of conversation conv_id.
    """
    begun = stage(sequences(turns, convs), "sequences")
    keyed = stage(begun.groupBy("depth", *KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *[F.min(p).alias(p) for p in PARENT]), "keyed")
    above = keyed.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)], F.col("conv").alias("parent_conv"))
    named = stage(keyed.join(above, ["depth", *PARENT], "left").select("conv", "depth", "parent_conv", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "named")
    below = named.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("conv") != F.col("parent_conv")).alias("beside"), F.min(F.when(F.col("conv") != F.col("parent_conv"), F.col("conv"))).alias("first_top")
    )
    n_children = F.coalesce("n_children", F.lit(0))
    lined = named.join(below, ["conv", "depth"], "left").select(
        *named.columns, "first_top", n_children.alias("n_children"), (n_children == 0).cast("long").alias("leaves"), F.lit(1).cast("long").alias("nodes"), (F.coalesce("beside", F.lit(0)) > 0).cast("long").alias("branch")
    )
    along = running(lined, ["conv"], ["depth"], [*WEIGHTS, "branch"], "paths").withColumn("level", F.col("branch_all") - F.col("branch_before"))
    nodes = stage(along, "nodes")
    ranks = stage(ranked(tour_elements(nodes)), "ranks")
    first = ranks.where("s = 0").select("c", *[F.col(w).alias(f"_{w}") for w in WEIGHTS])
    # what lies between a path's entering and the arc at which its element s begins
    between = ranks.where("s > 0").join(first, "c").select(F.col("c").alias("conv"), F.col("s").alias("level"), *[(F.col(f"_{w}") - F.col(w)).alias(f"_{w}") for w in WEIGHTS])
    shown = ["conv", "depth", "parent_conv", "n_convs", "n_children"]
    ended = nodes.where("level = 0").select(*shown, *[(F.col(f"{w}_all") - F.col(f"{w}_before")).alias(w) for w in WEIGHTS])
    forked = nodes.where("level > 0").join(between, ["conv", "level"]).select(*shown, *[(F.col(f"_{w}") - F.col(f"{w}_before")).alias(w) for w in WEIGHTS])
    ends = begun.where("last").select("depth", *KEY, F.col("conv").alias("member")).join(keyed.select("depth", *KEY, "conv"), ["depth", *KEY]).select("conv", "depth", "member")
    digests = ends_digests(ends)
    out = ended.unionByName(forked).join(digests, ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("nodes").alias("n_nodes"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    turns = stage(ordered_turns(df, conv, turn, role, text), "ordered")
    return prefix_trie(turns.withColumn("depth", F.col("at") + 1), turns.where("at = 0").select("conv"))


def with_shared_heads(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: the first h turns of conversation c - c % block, then c's own behind its first h; h is crc32(c) % most."""
    convs = turns.where("at = 0").select("conv", (F.col("conv") - F.col("conv") % block).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    heads = turns.where((F.col("conv") % block == 0) & (F.col("at") < most - 1)).select(F.col("conv").alias("base"), F.col("at").alias("i"), "ha", "hb", "chars")
    held = convs.join(heads.groupBy("base").agg(F.count("*").alias("n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))).drop("n")
    held = stage(held, "convs")
    shared = held.join(heads, "base").where("i < h").select("conv", (F.col("i") + 1).alias("depth"), "ha", "hb", "chars")
    own = turns.join(held, "conv").where("at >= h").select("conv", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "ha", "hb", "chars")
    return shared.unionByName(own), held.select("conv")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(ordered_turns(read(spark, sf_dir, "conversations")), "ordered")
    return prefix_trie(*with_shared_heads(turns))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {
    "op12_prefix_trie": """WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
 z AS (SELECT c, CAST(c AS VARCHAR) AS s, 0 AS i, 4294967295 AS v FROM t WHERE t.i = 0 UNION ALL
  SELECT c, s, i + 1, xor(y >> 1, (y & 1) * 3988292384) FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(s, i // 8 + 1, 1))) ELSE v END AS y FROM z WHERE i < 8 * length(s))),
 h AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM z WHERE i = 8 * length(s)),
 b AS (SELECT h.c, t.i AS o, t.r, t.x FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i < h.h UNION ALL SELECT h.c, t.i + 6, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.i >= h.h),
 q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, r, x FROM b),
 p AS (SELECT c, d, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d) AS k, length(x) AS n FROM q UNION ALL SELECT c, 0, [], 0 FROM h),
 n AS (SELECT k, d, min(c) AS c, count(*) AS m, any_value(n) AS n FROM p GROUP BY k, d),
 f AS (SELECT n.*, o.c AS pc FROM n LEFT JOIN n o ON o.d = n.d - 1 AND o.k = n.k[1:n.d - 1]),
 a AS (SELECT f.*, (SELECT count(*) FROM f g WHERE g.pc = f.c AND g.d = f.d + 1) AS w FROM f),
 e AS (SELECT p.c AS m, a.c, a.d, a.m AS convs, a.n, a.w FROM p JOIN a ON a.k = p.k AND a.d = p.d),
 u AS (SELECT DISTINCT x.c, x.d, y.c AS yc, y.d AS yd, y.convs, y.n, y.w FROM e x JOIN e y ON x.m = y.m AND y.d >= x.d),
 s AS (SELECT c, d, sum(CASE WHEN w = 0 THEN 1 ELSE 0 END) AS leaves, count(*) AS nodes, sum((convs - 1) * n) AS saved FROM u GROUP BY c, d),
 l AS (SELECT c, d, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY m) AS last FROM e) WHERE d = last GROUP BY c, d)
 SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, a.pc AS parent_conv_id, CAST(a.m AS BIGINT) AS n_convs, CAST(a.w AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.nodes AS BIGINT) AS n_nodes,
 CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256 FROM a JOIN s ON s.c = a.c AND s.d = a.d LEFT JOIN l ON l.c = a.c AND l.d = a.d""",
}
