"""Quality rules: cross-document line frequency.

Every line with a word is normalised and hashed.  For each host (``source``)
the engine counts the distinct documents that hold a line, removes lines above
the limits, and rejects documents of which too little is left.

A document is a doc_id (rows without one are documents by their text), so
repeated rows count once.  ``copies_once`` changes what counts as distinct, for
use before near-duplicate removal, where a group of copies would else make its
own lines frequent and lose all its members: each document gets a family sketch
(its smallest and largest 3-word-window hash, which near copies share with a
probability near the square of their similarity), a line's largest family counts
as one document, and the members of a family that makes up most of a line's
documents keep the line.  Other documents are judged without regard to its size.

Only DataFrame functions are used.  The documents are read once; what later
steps need (a few numbers and the line hashes) is written to the shared folder.
Frequent lines are counted in two steps with map-side partial sums, so a line
that a third of all documents hold costs each task one row.  Rows of a repeated
doc_id, found by a count over ids alone, are made distinct before they count.

Defined results: a null or empty text has no words and fails the base rule; a
null host is a host of its own; repeated rows get equal verdicts; a document at
a limit (exactly ``LINE_DOCS`` documents, exactly ``DEPLETED_SHARE`` of its words)
is not above it; other columns of the input are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.columns import BLANK_RUN, BLANKS, documents, let, words
from skein.plans.storage import table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line goes if more than this many distinct documents of its host hold it ...
LINE_DOCS = 5
#: With ``copies_once`` the largest family is one of them and keeps the line if less than this share of them lies outside it.
OUTSIDE_SHARE = 0.4
#: A document is depleted if more than this share of its words stands on removed lines.
DEPLETED_SHARE = 0.5

_COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, single spaces, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), BLANK_RUN, " "), "[0-9]", "0"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def _window_hashes(w: Column) -> Column:
    n = F.size(w)
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
    )


def _repeat_words(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from all window hashes in order."""

    def covered(p: Column) -> Column:  # p: ascending positions of repeated windows
        gaps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(h)) < F.size(h)
    return F.when(some, let(F.sort_array(pairs), lambda s: let(positions(s), covered))).otherwise(F.lit(0))


def _measures(text: Column) -> Column:
    """One struct with the base counts, the family sketch and the lines."""

    def of_words(w: Column) -> Column:
        return let(
            _window_hashes(w),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(h).cast("long").alias("n_repeat_words"),
                F.xxhash64(F.array_min(h), F.array_max(h), F.when(F.size(h) == 0, F.array_join(w, " "))).alias("family"),
            ),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.transform(
                ls,
                lambda x: let(
                    normal_line(x),
                    lambda n: F.struct(F.xxhash64(n).alias("h"), F.size(F.split(n, " ")).alias("w")),
                ),
            ).alias("lines"),
        )

    return F.struct(let(words(text), of_words).alias("a"), let(lines_with_words(text), of_lines).alias("b"))


def line_quality(
    docs: DataFrame,
    line_docs: int = LINE_DOCS,
    depleted_share: float = DEPLETED_SHARE,
    copies_once: bool = False,
    outside_share: float = OUTSIDE_SHARE,
) -> DataFrame:
    """Base counts and verdict per row of ``docs`` (doc_id, source, text).

    Columns: doc_id, text_key (hash of the text), the base counts, base_failed,
    removed_words, frequent (hashes of the row's lines above the limits; null if
    none) and kept.
    """
    m = docs.select(
        "doc_id",
        F.col("source").alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _measures(F.col("text")).alias("m"),
    ).select(
        "doc_id", "host", "text_key", "n_symbols", "m.a.n_words", "m.a.word_chars", "m.a.n_repeat_words",
        "m.a.family", "m.b.n_dup_lines", "m.b.lines",
    )
    m = table(m, "quality")

    who = F.when(F.col("doc_id").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("doc_id").cast("string").alias("key"))).otherwise(
        F.struct(F.lit(1).alias("kind"), F.col("text_key").cast("string").alias("key"))
    )
    m_who = m.select("host", "family", "lines", who.alias("who"))
    repeats = m_who.groupBy("host", "who").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("one_family")).where("n > 1")
    repeats = table(repeats.select(F.col("host").alias("r_host"), F.col("who").alias("r_who"), "one_family"), "repeats")
    held = m_who.join(repeats, F.col("host").eqNullSafe(F.col("r_host")) & (F.col("who") == F.col("r_who")), "left").select(
        "host", "r_who", F.coalesce("one_family", "family").alias("family"), F.explode(F.array_distinct("lines.h")).alias("h")
    )
    group = ["host", "h", "family"] if copies_once else ["host", "h"]
    once = held.where("r_who is null").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    again = held.where("r_who is not null").select(*group, "r_who").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    counted = once.unionAll(again)
    if copies_once:
        by_family = counted.groupBy(*group).agg(F.sum("n").alias("n"))
        outside = F.col("docs") - F.col("top") + 1
        frequent = (
            by_family.groupBy("host", "h")
            .agg(F.sum("n").alias("docs"), F.max(F.struct("n", "family")).alias("largest"))
            .select("host", "h", "docs", F.col("largest.n").alias("top"), F.col("largest.family").alias("family"))
            .where(outside > line_docs)
            .withColumn("f_exempt", F.when(outside < outside_share * F.col("docs"), F.col("family")))
        )
    else:
        frequent = counted.groupBy("host", "h").agg(F.sum("n").alias("docs")).where(F.col("docs") > line_docs).withColumn("f_exempt", F.lit(None).cast("long"))
    frequent = table(frequent.select(F.col("host").alias("f_host"), F.col("h").alias("f_h"), "f_exempt"), "frequent")

    hit = (
        m.select("doc_id", "text_key", "host", "family", F.explode("lines").alias("l"))
        .select("doc_id", "text_key", "host", "family", "l.h", "l.w")
        .join(
            frequent,
            F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h")) & ~F.col("family").eqNullSafe(F.col("f_exempt")),
            "left_semi",
        )
        .groupBy("doc_id", "text_key", "host")
        .agg(F.sum("w").alias("hit_words"), F.collect_set("h").alias("frequent"))
        .select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), F.col("host").alias("r_host"), "hit_words", "frequent")
    )
    # Repeated rows add up in hit_words; their number divides it again.
    again = (
        m.groupBy("doc_id", "text_key", "host")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key"), F.col("host").alias("a_host"), "n")
    )
    hit = hit.join(
        again,
        F.col("r_id").eqNullSafe(F.col("a_id")) & (F.col("r_key") == F.col("a_key")) & F.col("r_host").eqNullSafe(F.col("a_host")),
        "left",
    ).select("r_id", "r_key", "r_host", (F.col("hit_words") / F.coalesce("n", F.lit(1))).cast("long").alias("removed_words"), "frequent")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        m.drop("lines", "family")
        .join(
            hit,
            F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")) & F.col("host").eqNullSafe(F.col("r_host")),
            "left",
        )
        .select(
            "doc_id",
            "text_key",
            "host",
            *_COLS,
            base_failed.alias("base_failed"),
            F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"),
            "frequent",
            (~base_failed & (F.coalesce("removed_words", F.lit(0)) <= depleted_share * F.col("n_words"))).alias("kept"),
        )
    )


def without_frequent_lines(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, their frequent lines cut out of the text."""
    v = verdicts.where("kept").groupBy("doc_id", "text_key", "host").agg(F.first("frequent").alias("frequent"))
    v = v.select(F.col("doc_id").alias("v_id"), F.col("text_key").alias("v_key"), F.col("host").alias("v_host"), "frequent")
    stays = F.filter(
        F.split("text", "\n"),
        lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains("frequent", F.xxhash64(normal_line(x))),
    )
    text = F.when(F.col("frequent").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = docs.join(
        v,
        F.col("doc_id").eqNullSafe(F.col("v_id"))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("v_key"))
        & F.col("source").eqNullSafe(F.col("v_host")),
    )
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(documents(spark, sf_dir)).select("doc_id", *_COLS, "base_failed", "kept", "removed_words")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, source, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
 g AS (SELECT doc_id, p, concat_ws(' ', ws[p], ws[p + 1], ws[p + 2]) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
 twice AS (SELECT doc_id, x FROM g GROUP BY doc_id, x HAVING count(*) > 1),
 marked AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM g JOIN twice USING (doc_id, x), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
 l AS (SELECT doc_id, source, line FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t-\r]')),
 n AS (SELECT doc_id, source, line, regexp_replace(lower(trim(regexp_replace(line, '[ \t-\r]+', ' ', 'g'))), '[0-9]', '0', 'g') AS norm FROM l),
 frequent AS (SELECT source, norm FROM n GROUP BY source, norm HAVING count(DISTINCT doc_id) > {LINE_DOCS}),
 hit AS (SELECT n.doc_id, sum(len(string_split(n.norm, ' '))) AS words FROM n JOIN frequent f ON n.norm = f.norm AND n.source IS NOT DISTINCT FROM f.source GROUP BY n.doc_id),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS k FROM l GROUP BY doc_id),
 c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        coalesce(k, 0)::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words, coalesce(words, 0)::BIGINT AS removed_words
       FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND removed_words <= {DEPLETED_SHARE} * n_words AS kept FROM c""",
}
