"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). The documents are counted by their votes (at most
3^8 patterns, whatever the corpus holds), and expectation-maximisation over these counts estimates the share of good
documents and the accuracy of each rule's votes in the good and the bad class; a document is kept if its posterior probability of being good is at least 0.5
and it passes the two base rules. The iterations are one SQL aggregate over the pattern list; only its few numbers
reach the driver. Votes and figures are staged once in the shared folder, so texts are read once.

Null texts have no words, as have empty ones: they fail the base rules. Repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result; a posterior of just 0.5 keeps. Texts are never shuffled, so a hot source or one of a
document's repeated lines concentrates nothing; long texts are arrays within their row. Windows and words are told apart
by 64-bit hashes within a document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm.common import read, stage

MIN_WORDS, WINDOW, REPEAT_SHARE = 10, 5, 20
#: Rounds; first share of good documents; first probabilities of a bad, no and good vote in the good class, reversed in the bad one.
ITERATIONS, SHARE, START = 25, 0.8, (0.1, 0.3, 0.6)

# Frequent function words of English, German, French and Spanish.
STOP = tuple(
    "the of and to in a is that for it as was with be by on or not der die und den von zu das mit sich des auf für ist im dem nicht ein eine le la les et en un du une que est pour qui dans par el los del las por con para su al y de se no como pero".split()
)
#: The rules in the order of the votes: name, SQL of a good vote, SQL of a bad vote.
RULES = (
    ("symbols", "n_symbols = 0", "10 * n_symbols > n_words"),
    ("stop_words", "n_stop >= 0.12 * n_words", "n_stop < 0.05 * n_words"),
    ("word_length", "word_chars BETWEEN 4 * n_words AND 6.2 * n_words", "word_chars < 3 * n_words OR word_chars > 9 * n_words"),
    ("variety", "false", "n_distinct < 0.2 * n_words"),
    ("repeats", "false", "n_repeat_words > 0.15 * n_words"),
    ("lines", "false", "n_dup_lines > 0.5 * n_lines"),
    ("capitals", "false", "n_upper > 0.3 * n_chars"),
    ("calls", "false", "n_calls > 0.3 * n_words"),
)
BLANKS = "[\\\\x20\\\\x09-\\\\x0D]"


def figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts of words, characters, symbols, repeated lines and windows …) of each whole text."""
    quoted = ", ".join(f"'{w}'" for w in STOP)
    words = df.select(F.col(id_col), F.expr(f"coalesce({text_col}, '')").alias("body")).selectExpr(
        f"`{id_col}`", "body", f"array_remove(split(body, '{BLANKS}+'), '') AS words", f"filter(split(body, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines"
    )
    hashed = words.selectExpr(
        f"`{id_col}`", "cast(size(words) AS long) AS n_words", "cast(length(array_join(words, '')) AS long) AS word_chars", "cast(length(body) AS long) AS n_chars",
        "cast(length(regexp_replace(body, '[^#*$%&|<>]+', '')) AS long) AS n_symbols", "cast(length(regexp_replace(body, '[^!?]+', '')) AS long) AS n_calls",
        "cast(length(regexp_replace(body, '[^\\\\p{Lu}]+', '')) AS long) AS n_upper", "cast(size(lines) AS long) AS n_lines", "cast(size(lines) - size(array_distinct(lines)) AS long) AS n_dup_lines",
        f"cast(size(filter(words, w -> lower(w) IN ({quoted}))) AS long) AS n_stop", "transform(words, w -> xxhash64(w)) AS h",
    )
    around = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    windows = hashed.selectExpr("* EXCEPT (h)", "cast(size(array_distinct(h)) AS long) AS n_distinct", f"CASE WHEN n_words < {WINDOW} THEN cast(array() AS array<long>) ELSE transform(sequence(0, cast(n_words - {WINDOW} AS int)), i -> xxhash64({around})) END AS g")
    # places of windows that occur twice or more, from neighbours in the sorted windows of the few texts that have such
    ordered = windows.selectExpr("* EXCEPT (g)", "CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x AS x, i AS i))) END AS s")
    places = ordered.selectExpr("* EXCEPT (s)", "sort_array(transform(filter(s, (e, k) -> (k > 0 AND e.x = get(s, k - 1).x) OR e.x = get(s, k + 1).x), e -> e.i)) AS p")
    return places.selectExpr("* EXCEPT (p)", f"cast(coalesce(aggregate(p, struct(0 AS n, -{WINDOW} AS last), (a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last), a -> a.n), 0) AS long) AS n_repeat_words")


def vote(df: DataFrame) -> DataFrame:
    """Adds votes array<int>, in the order of RULES, to the figures; a text without words gets no vote."""
    each = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, good, bad in RULES)
    return df.selectExpr("*", f"array({each}) AS votes")


def estimate(voted: DataFrame) -> tuple[float, list[float]]:
    """(share of good documents, weight of each rule's bad, no and good vote) by expectation-maximisation over the counts of vote patterns.

    Each class, good and bad, has for each rule the probabilities of its three votes; a vote weighs the logarithm of
    their ratio. Abstaining weighs nothing, and no good vote counts against a document, nor a bad one for it.
    """
    r = len(RULES)
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).agg(F.expr("sort_array(collect_list(struct(votes, cast(n AS double) AS n)))").alias("p"))
    first = [math.log(START[0] / START[2]), 0.0, math.log(START[2] / START[0])] * r
    odds = "aggregate(zip_with(e.votes, sequence(0, {0}), (v, j) -> s.w[3 * j + v + 1]), ln(s.prior / (1 - s.prior)), (t, x) -> t + x)".format(r - 1)
    scored = f"transform(p, e -> struct(e.votes AS votes, e.n AS n, e.n / (1 + exp(-({odds}))) AS q))"
    of = f"aggregate(z, array_repeat(0D, {3 * r}), (t, e) -> zip_with(t, sequence(0, {3 * r - 1}), (x, k) -> x + CASE WHEN e.votes[k div 3] = k % 3 - 1 THEN {{}} ELSE 0D END))"
    fit = f"""aggregate(sequence(1, {ITERATIONS}), struct(cast({SHARE} AS double) AS prior, array({", ".join(f"{x!r}D" for x in first)}) AS w),
        (s, i) -> aggregate(array({scored}), s, (u, z) -> aggregate(array(struct({of.format("e.q")} AS g, {of.format("e.n - e.q")} AS b, aggregate(z, 0D, (t, e) -> t + e.q) AS gs, aggregate(z, 0D, (t, e) -> t + e.n) AS ns)), u, (y, m) -> struct(
            greatest(0.01D, least(0.99D, m.gs / m.ns)) AS prior,
            transform(sequence(0, {3 * r - 1}), k -> CASE k % 3 WHEN 1 THEN 0D WHEN 0
                THEN least(0D, ln((m.g[k] + 1D) / (m.gs + 3D)) - ln((m.b[k] + 1D) / (m.ns - m.gs + 3D)))
                ELSE greatest(0D, ln((m.g[k] + 1D) / (m.gs + 3D)) - ln((m.b[k] + 1D) / (m.ns - m.gs + 3D))) END) AS w))))"""
    row = counted.where("size(p) > 0").selectExpr(f"{fit} AS f").selectExpr("f.prior", "f.w").first()
    return (row["prior"], list(row["w"])) if row else (SHARE, first)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, figures, votes, base_failed, posterior, kept) of each document."""
    voted = stage(vote(figures(df, id_col, text_col)), "votes")
    prior, weights = estimate(voted)
    odds = F.lit(math.log(prior / (1 - prior)))
    for j in range(len(RULES)):
        v = F.col("votes")[j]
        odds = odds + F.when(v == 1, weights[3 * j + 2]).when(v == -1, weights[3 * j]).otherwise(0.0)
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures alone, which SQL can express."""
    failed = "n_words < {} OR 100 * n_repeat_words > {} * n_words".format(MIN_WORDS, REPEAT_SHARE)
    return figures(read(spark, sf_dir, "documents")).selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{failed} AS base_failed")


QUERIES = {"op3_quality": op3_quality, "quality_figures": quality_figures}
ORACLES = {
    "quality_figures": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 l AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) > 4)), d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id),
 f AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM t JOIN l ON l.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id)
 SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f""",
}
