"""Entropy balancing of sources to target token totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.rows import named, packed, unpacked
from rankweave.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """Targets of sources from ``(source, source_size)``, one row per source.

    Sources stand in code-point order, null last, and weigh ``weights`` over
    and over.  Together they get as many tokens as there are; none gets over
    ``cap`` times its size, and what is over goes to the others by weight.
    That is a water level: ``target = min(cap * size, weight * level)``, the
    level being where the targets add up, found by running sums over the
    sources in order of ``cap * size / weight``.
    """
    share = F.array(*(F.lit(float(w)) for w in weights))
    ranked = running(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, scratch)
    ranked = ranked.withColumns({"weight": F.get(share, ((F.col("place") - 1) % len(weights)).cast("int")), "most": F.col("source_size") * F.lit(float(cap))})
    filled = running(ranked.drop("place"), [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()], {"full": F.col("most"), "used": F.col("weight")}, scratch)
    filled = scratch.keep(filled, "filled")
    everything, weighed = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(everything) - (F.col("full") - F.col("most"))) / (F.lit(weighed) - (F.col("used") - F.col("weight")))
    # the first source in this order that the level does not fill fixes it; further on the quotient only falls
    fixed = filled.agg(F.max(F.when(level * F.col("weight") <= F.col("most"), level))).first()[0]
    return filled.select("source", "source_size", "weight", F.least("most", F.col("weight") * F.lit(fixed or 0.0)).alias("target"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """Add running sums in an order of unique keys, range by range: no task sees more than its range and the ranges' totals."""
    ranged = scratch.keep(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range").agg(*(F.sum(c).alias(f"sum_{n}") for n, c in sums.items()))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *(F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums))
    here = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(totals), "range").select(*df.columns, *((F.sum(c).over(here) + F.col(f"before_{n}")).alias(n) for n, c in sums.items()))


def tilt_rates(lengths: DataFrame, targets: DataFrame, scratch: Scratch, cap: float = 3.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Solve the dual for ``lengths`` (source, size, n) against ``targets``.

    Among all document rates between 0 and ``cap`` that give each source its
    target tokens, those closest to one in relative entropy are
    ``min(cap, exp(tilt * size / mean size))`` with one tilt per source.  The
    dual is convex in each tilt; Newton's step is the missing tokens over the
    dual's curvature, kept inside a bracket that shrinks with the sign of the
    gap (and halved where the curvature gives no step).  A round is one grouped
    sum over the length histogram, whose rows are distinct lengths, not
    documents.  Returns lengths with ``rate``; a dual that isn't solved after
    ``rounds`` rounds is an error.
    """
    mean = lengths.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = scratch.keep(
        targets.where("source_size > 0")
        .join(mean, targets["source"].eqNullSafe(mean["source"]))
        .select(
            targets["source"], "source_size", "target", "mean",
            F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.lit(False).alias("done"),
        ),
        "tilt",
    )
    x = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
    for _ in range(rounds):
        todo = state.where(~F.col("done"))
        sums = (
            lengths.alias("l").join(todo.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")))
            .groupBy("t.source")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.least(raw, F.lit(cap))).alias("got"),
                F.sum(F.when(raw < cap, F.col("n") * F.col("size") * x * raw).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("target") - F.col("got")
        newton = F.col("tilt") + gap / F.expr("nullif(slope, 0D)")
        # outside the bracket, or with no slope: halve it, or go on doubling where it is open
        inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        halved = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).when(
            gap > 0, F.greatest(F.col("tilt") * 2, F.col("tilt") + 1)
        ).otherwise(F.least(F.col("tilt") * 2, F.col("tilt") - 1))
        # no sums: the source is done already
        done = F.coalesce(F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0)), F.lit(True))
        following = (
            state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("done", done)
            .withColumn("low", F.when((gap > 0) & ~F.col("done"), F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when((gap < 0) & ~F.col("done"), F.col("tilt")).otherwise(F.col("high")))
            .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise(halved))
            .select("source", "source_size", "target", "mean", "tilt", "low", "high", "done")
        )
        state = scratch.keep(following, "tilt")
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"the dual is not solved after {rounds} rounds")
    return (
        lengths.alias("l")
        .join(state.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")), "left")
        .select("l.source", "size", "n", F.coalesce(F.least(raw, F.lit(cap)), F.lit(0.0)).alias("rate"))
    )


def whole_copies(rated: DataFrame, targets: DataFrame, scratch: Scratch, cap: int = 3, passes: int = 64) -> DataFrame:
    """Whole copies for each (source, size) of ``rated`` (source, size, n, rate): adds ``copies``.

    Rates add up from the longest documents down and each length gets the
    whole numbers that its stretch crosses.  What a source then lacks (or has
    over) is settled by passes that add (or take away) single copies, longest
    fitting lengths first; each pass leaves less than the last length it used.
    They end when no source has a length that still fits: a pass at least
    halves what is left, so their number grows with the logarithm of the longest length.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    to_here = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    expected = F.col("n") * F.col("rate")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    out = (
        rated.join(t, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .withColumn("upto", F.sum(expected).over(to_here))
        .withColumn("before", F.floor(F.col("upto") - expected + 0.5))
        .withColumn("copies", F.floor(F.col("upto") + 0.5) - F.col("before"))
        .withColumn("copies", F.greatest(F.lit(0).cast("long"), F.least("copies", F.col("n") * cap)))
        .drop("upto", "before", "rate")
    )
    room = F.when(F.col("lack") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
    for _ in range(passes):
        out = scratch.keep(out.withColumn("lack", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)), "copies")
        if out.where((F.col("size") > 0) & (F.col("size") <= F.abs("lack")) & (room > 0)).isEmpty():
            return out.drop("lack")
        movable = F.when((F.col("size") > F.abs("lack")) | (F.col("size") == 0), 0).otherwise(room)
        out = (
            out.withColumn("movable", movable.cast("long"))
            .withColumn("larger", F.sum(F.col("movable") * F.col("size")).over(to_here) - F.col("movable") * F.col("size"))
            .withColumn("moved", F.floor((F.abs("lack") - F.col("larger")) / F.expr("nullif(size, 0)")))
            .withColumn("moved", F.greatest(F.lit(0).cast("long"), F.least("movable", F.coalesce("moved", F.lit(0).cast("long")))))
            .withColumn("copies", F.col("copies") + F.signum("lack").cast("long") * F.col("moved"))
            .drop("lack", "movable", "larger", "moved")
        )
    raise RuntimeError(f"copies are not settled after {passes} passes")


def mix_sources(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights=WEIGHTS,
    cap: int = 3,
    splits: int = 64,
) -> DataFrame:
    """Choose how often each document goes into the mix.

    Adds ``size`` (words of the text), ``source_size``, ``target`` (tokens the
    source should give), ``copies`` and ``taken`` (= copies * size).  Columns of
    ``docs`` with these names (in any case) are replaced; all others stay.

    The documents of one source and length share a rate, and so are counted
    rather than compared: all iterations run over the histogram of lengths.  A
    group's copies are dealt to its documents in order of a hash of id and
    text, within ``splits`` parts, so that no group has to fit into one task.

    A null or empty text has size 0 and takes 0 words.  A null source is a
    source like any other and comes last.  Rows with equal ids are separate
    documents.  No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    mark = F.xxhash64(named(id_col), named(text_col))
    keyed = docs.select(
        packed(docs, ("size", "source_size", "target", "copies", "taken")).alias("row"),
        word_count(named(text_col)).alias("size"),
        named(source_col).cast("string").alias("source"),
        mark.alias("mark"),
        F.pmod(mark, F.lit(splits)).alias("part"),
    )
    parts = scratch.keep(keyed.groupBy("source", "size", "part").agg(F.count("*").alias("n_part")), "parts")
    lengths = scratch.keep(parts.groupBy("source", "size").agg(F.sum("n_part").alias("n")), "lengths")
    totals = scratch.keep(lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size")), "totals")
    targets = scratch.keep(source_targets(totals, scratch, weights, cap), "targets")
    rated = tilt_rates(lengths, targets, scratch, float(cap))
    dealt = whole_copies(rated, targets, scratch, cap)

    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n_part").over(earlier), F.lit(0)))
    g, o = dealt.alias("g"), offsets.alias("o")
    plan = g.join(o, F.col("g.source").eqNullSafe(F.col("o.source")) & (F.col("g.size") == F.col("o.size"))).select(
        F.col("g.source").alias("p_source"), F.col("g.size").alias("p_size"), F.col("part").alias("p_part"), "source_size", "target", "offset",
        F.expr("copies div n").alias("each"), F.expr("copies % n").alias("extra"),
    )
    same = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("mark", F.lit(1)), "mark")
    placed = keyed.withColumn("index", F.row_number().over(same) - 1)
    joined = placed.join(
        plan,
        F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")),
        "left",
    )
    copies = F.col("each") + F.when(F.col("index") + F.col("offset") < F.col("extra"), 1).otherwise(0)
    return joined.select(
        *unpacked(joined),
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )
