"""Mixing sources to target weights by Pareto order sampling.

Sources, ordered by code point with null last, weigh 1, 2, 3, repeating, and
share all words by weight; a target stops at ``CAP`` times its source's size and
the excess is shared again by weight (water filling, in closed form).

A source whose target is m times its size takes floor(m) certain copies of each
document.  The rest of the target is filled by Pareto order sampling: every
document gets a random rank, the odds of a uniform draw divided by the odds of
its inclusion, and the smallest ranks are taken.  Inclusion odds are those of
the fraction left, times the document's own factor (larger documents are
likelier, by the square root of their size).

The sample is fixed-size in words: documents are taken in three size classes,
largest first, each up to its share of the rest, and what a class misses or
overshoots passes on to the next, so a source ends within half a small document
of its target where it has enough of them.

Only DataFrame functions are used.  A class is cut at a rank threshold for each
source: word sums by (source, rank bucket), with map-side partial sums, name the
bucket the cut falls in, and only that bucket's distinct ranks are ordered.  No
task orders a whole source, and documents meet one row per source.  Texts are
not shuffled: the rows go to the shared folder with their sizes and draws, and
the plan, one row per source, comes to them.

A draw depends on doc_id, size and text, so only repeated rows tie.  A cut that
falls among tied rows takes the whole number of them that comes nearest, the
first by their place in the written rows: counts by (source, file part) name the
part, and that part's rows alone are numbered.

Sources are rows of one window (their order fixes the weights): ten million of
them are about a gigabyte in one task, a bound on hosts and not on documents.

Defined results: a null or blank text has size 0 and is taken 0 words; a null
source is a source of its own; repeated rows are separate documents with the
same draw; a null doc_id draws like any other; other columns are carried along;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.columns import documents, n_words
from skein.plans.storage import table

CAP = 3
WEIGHTS = (1, 2, 3)
#: Size classes of the fractional part: over 1/8 of the words to fill, over 1/64, the rest.
CLASSES = (8, 64)
BUCKETS = 4096
MOST = (1 << 63) - 1
SEED = "pareto-1"


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    every = Window.partitionBy()
    tight = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    s = s.withColumn("full", F.col("cap") <= level * F.col("w"))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), left * F.col("w") / free))
    return s.select("source", "source_size", share.alias("target"))


def _draw(doc_id: Column, size: Column, text: Column) -> Column:
    """A uniform number inside (0, 1) that depends on the document alone."""
    own = F.concat_ws(
        ":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    )
    return (F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _cut(cands: DataFrame, want: DataFrame) -> DataFrame:
    """(s, top, ties, of, got): per source the largest rank taken, how many of the rows of that rank are
    taken, how many there are, and the words taken in all.

    ``cands``: (s, rank in [0, 1), size); ``want``: (s, words).  Rows of one source
    and rank have one size.  ``top`` is below every rank where nothing is taken.
    """
    bucket = F.floor(F.col("rank") * BUCKETS)
    hist = cands.groupBy("s", bucket.alias("b")).agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("s").orderBy("b")
    run = hist.withColumn("cum", F.sum("size").over(up_to)).join(want, hist.s.eqNullSafe(want.s)).drop(want.s)
    edge = run.where((F.col("cum") > F.col("words")) & (F.col("cum") - F.col("size") <= F.col("words")))
    edge = edge.groupBy("s").agg(F.min("b").alias("eb"), F.min(F.col("cum") - F.col("size")).alias("before"), F.first("words").alias("words"))
    rows = cands.join(edge.withColumnRenamed("s", "es"), F.col("s").eqNullSafe(F.col("es")) & (bucket == F.col("eb")))
    ranks = rows.groupBy("s", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.first("before").alias("before"), F.first("words").alias("words")
    )
    so_far = Window.partitionBy("s").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(so_far), F.lit(0))
    # A row goes in if its middle lies within the words wanted.
    fits = F.floor((F.col("words") - F.col("below")) / F.col("size") + 0.5).cast("long")
    inside = (
        ranks.withColumn("below", below)
        .withColumn("ties", F.least(F.col("n"), F.greatest(fits, F.lit(0))))
        .where("ties > 0").groupBy("s")
        .agg(F.max(F.struct("rank", "ties", "n", (F.col("below") + F.col("ties") * F.col("size")).alias("got"))).alias("last"))
    )
    total = hist.groupBy("s").agg(F.sum("size").alias("all"))
    e, i, t = edge.alias("e"), inside.alias("i"), total.alias("t")
    whole = F.col("e.eb").isNull()  # the class never reaches the words wanted: all of it goes in
    return (
        want.alias("w")
        .join(t, F.col("w.s").eqNullSafe(F.col("t.s")), "left")
        .join(e, F.col("w.s").eqNullSafe(F.col("e.s")), "left")
        .join(i, F.col("w.s").eqNullSafe(F.col("i.s")), "left")
        .select(
            F.col("w.s").alias("s"),
            F.when(F.col("w.words") <= 0, F.lit(-1.0))
            .when(whole, F.lit(2.0))
            .otherwise(F.coalesce("i.last.rank", F.col("e.eb") / BUCKETS - 1e-13)).alias("top"),
            F.when((F.col("w.words") > 0) & ~whole, F.col("i.last.ties")).alias("ties"),
            F.when((F.col("w.words") > 0) & ~whole, F.col("i.last.n")).alias("of"),
            F.when(F.col("w.words") <= 0, F.lit(0)).when(whole, F.coalesce("t.all", F.lit(0)))
            .otherwise(F.coalesce("i.last.got", F.col("e.before"))).cast("double").alias("got"),
        )
    )


def _last_tied(cands: DataFrame, cut: DataFrame) -> DataFrame:
    """(s, until): the place of the last of the tied rows that go in, where a cut falls among them."""
    among = cut.where("ties < of").select(F.col("s").alias("cs"), "top", "ties")
    tied = cands.join(among, F.col("s").eqNullSafe(F.col("cs")) & (F.col("rank") == F.col("top"))).withColumn("part", F.shiftright("row", 33))
    parts = tied.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n"), F.first("ties").alias("ties"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = parts.withColumn("before", before).where("before < ties and before + n >= ties").select(
        F.col("s").alias("ls"), F.col("part").alias("lpart"), (F.col("ties") - F.col("before")).alias("nth")
    )
    rows = tied.join(last, F.col("s").eqNullSafe(F.col("ls")) & (F.col("part") == F.col("lpart")))
    number = F.row_number().over(Window.partitionBy("s").orderBy("row"))
    return rows.withColumn("number", number).where("number = nth").select("s", F.col("row").alias("until"))


def mix(docs: DataFrame, carry: list[str] | None = None, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc, size, source_size, target, copies, taken) per row of ``docs``.

    ``doc`` holds the columns ``carry`` of the row, all of them if not given.
    """
    size = n_words(F.col("text"))
    sized = docs.select(
        F.struct(*(docs.columns if carry is None else carry)).alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("source"), F.col("text").alias("text"), size.alias("size")
    ).select("doc", "source", "size", _draw(F.col("id"), F.col("size"), F.col("text")).alias("u"), F.monotonically_increasing_id().alias("row"))
    sized = table(sized, "sized")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(
        F.col("source").alias("s"), "source_size", "target", F.floor(ratio).cast("long").alias("whole"), (ratio - F.floor(ratio)).alias("part")
    ).withColumn("rest", F.col("part") * F.col("source_size"))
    plan = table(plan, "targets")

    by_source = F.col("source").eqNullSafe(F.col("s"))
    size_class = F.lit(0)
    for k in CLASSES:
        size_class = size_class + (F.col("size") * k <= F.col("rest")).cast("int")
    odds = F.when(F.expr("part > 0 and size > 0"), F.col("part") / (1 - F.col("part")) * F.sqrt(F.col("size")))
    pareto = F.col("u") / (1 - F.col("u")) / odds
    rank = pareto / (1 + pareto)
    ranked = (
        sized.select("source", "size", "u", "row").join(plan, by_source)
        .where("size > 0 and part > 0")
        .select("s", "size", size_class.alias("class"), rank.alias("rank"), F.col("part"), "row")
    )
    ranked = table(ranked, "ranked")
    owed = plan.select("s", F.lit(0.0).alias("owed"))
    cuts = []
    for c in range(len(CLASSES) + 1):
        own = ranked.where(F.col("class") == c)
        share = own.groupBy("s").agg(F.sum(F.col("size") * F.col("part")).alias("words"))
        want = owed.alias("o").join(share.alias("h"), F.col("o.s").eqNullSafe(F.col("h.s")), "left").select(
            F.col("o.s").alias("s"), (F.col("o.owed") + F.coalesce("h.words", F.lit(0.0))).alias("words")
        )
        want = table(want, "want")
        cut = table(_cut(own.select("s", "rank", "size"), want), "cut")
        last = cut.withColumn("until", F.lit(MOST))
        if not cut.where("ties < of").isEmpty():  # a plan of its own, seldom needed
            until = _last_tied(own.select("s", "rank", "row"), cut).withColumnRenamed("s", "us")
            last = table(cut.join(until, F.col("s").eqNullSafe(F.col("us")), "left").withColumn("until", F.coalesce("until", F.lit(MOST))), "last")
        cuts.append(last.select(F.col("s").alias("cs"), F.lit(c).alias("cc"), F.struct("top", "until").alias("top")))
        owed = want.alias("w").join(cut.alias("c"), F.col("w.s").eqNullSafe(F.col("c.s"))).select(
            F.col("w.s").alias("s"), (F.col("w.words") - F.col("c.got")).alias("owed")
        )
    tops = cuts[0]
    for more in cuts[1:]:
        tops = tops.unionAll(more)
    tops = tops.groupBy("cs").agg(*[F.max(F.when(F.col("cc") == c, F.col("top"))).alias(f"top{c}") for c in range(len(cuts))])
    plan = table(plan.join(tops, F.col("s").eqNullSafe(F.col("cs"))).drop("cs"), "plan")
    top = F.element_at(F.array(*[f"top{c}" for c in range(len(cuts))]), size_class + 1)
    extra = (F.col("size") > 0) & (F.col("part") > 0) & ((rank < top["top"]) | ((rank == top["top"]) & (F.col("row") <= top["until"])))
    copies = F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")
    return sized.join(plan, by_source).select("doc", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows that were mixed, each as often as the mix takes it."""
    fields = mixed.schema["doc"].dataType.names
    rows = mixed.where("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(*[F.col("doc").getField(f).alias(f) for f in fields])


def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(documents(spark, sf_dir), ["doc_id", "source"])
    return m.select("doc.doc_id", "size", "source_size", "target", "taken", "doc.source", "copies")


QUERIES = {"op10_pareto_mixing": op10_pareto_mixing}


def _oracle() -> str:
    """The same mix with every source ordered whole."""
    sql = rf"""
WITH d AS (SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
 s0 AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
 s1 AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
        coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
        FROM s0 WINDOW b AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s2 AS (SELECT *, cap <= (total - cap_before) / (w_all - w_before) * w AS "full" FROM s1),
 s3 AS (SELECT source, source_size, CASE WHEN "full" THEN cap ELSE least(cap, (total - coalesce(sum(CASE WHEN "full" THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT "full" THEN w END) OVER ()) END AS target FROM s2),
 plan AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS part, part * source_size AS rest FROM s3),
 j AS (SELECT d.*, p.source_size, target, whole, part, ((size * {CLASSES[0]} <= rest)::INT + (size * {CLASSES[1]} <= rest)::INT) AS class,
       (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
       FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
 q AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN u / (1 - u) / (part / (1 - part) * sqrt(size)) END AS pareto FROM j),
 k AS (SELECT *, sum(size) OVER (PARTITION BY source, class ORDER BY pareto / (1 + pareto) ROWS UNBOUNDED PRECEDING) AS cum FROM q WHERE part > 0 AND size > 0),
 o0 AS (SELECT source, 0.0::DOUBLE AS owed FROM plan)"""
    for c in range(len(CLASSES) + 1):
        sql += f""",
 w{c} AS (SELECT o.source, owed + coalesce(words, 0) AS words FROM o{c} o LEFT JOIN (SELECT source, sum(size * part) AS words FROM k WHERE class = {c} GROUP BY source) h ON o.source IS NOT DISTINCT FROM h.source),
 t{c} AS (SELECT k.* FROM k JOIN w{c} w ON k.source IS NOT DISTINCT FROM w.source WHERE class = {c} AND words > 0 AND cum - size / 2 <= words),
 o{c + 1} AS (SELECT w.source, words - coalesce(got, 0) AS owed FROM w{c} w LEFT JOIN (SELECT source, sum(size) AS got FROM t{c} GROUP BY source) g ON w.source IS NOT DISTINCT FROM g.source)"""
    taken = " UNION ALL ".join(f"SELECT doc_id FROM t{c}" for c in range(len(CLASSES) + 1))
    return sql + f"""
SELECT doc_id, size, source_size, target, (whole + (doc_id IN ({taken}))::BIGINT) * size AS taken, source, whole + (doc_id IN ({taken}))::BIGINT AS copies FROM q"""


ORACLES = {"op10_pareto_mixing": _oracle()}
