"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source has a target of words. Document rates w minimise the relative entropy to one copy each, under the
constraint that the rates of a source's documents, times their sizes, sum to the target, and that no rate
exceeds `most`. The solution is exponentially tilted, w = min(most, exp(l * size / mean size)), with one dual
variable l for each source; the dual is convex and smooth, and Newton's method solves all sources at once. A
step sums the constraint and its slope for each source in one distributed aggregate over a histogram of
(source, size), so the documents are aggregated once, whatever the number of steps; steps are taken on the
logarithm of the constraint, guarded by bisection, and end when all sources are within half a word.

Rates are rounded to whole copies, floor(w + u + t), where u is a hash of the document and t shifts a whole
source; t is the value whose total comes nearest to the target, found over BINS of t, and two repairs then
move one document each by one copy. Rows of one doc_id and text are numbered, and the number enters u, so each
of them is rounded on its own. Reruns agree.

Null text has size 0, null source is a source of its own and comes last; documents of size 0 take nothing.
Columns beyond doc_id, text and source don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from upland.llm.common import cut, keyed_join

#: Weights of sources, in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
STEPS = 60
#: The dual variable of a source that is taken as often as allowed, and the bounds of all.
FAR = 1e6
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"

PICKS = "array<struct<u:double,doc_id:bigint,way:bigint>>"

_KEY = "source_key"


def with_size(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, source_key, size and a hash of doc_id and text of every document; the text stays behind."""
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        key.alias(_KEY),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit("mixing"), "doc_id", "text").alias("mark"),
        *more,
    )


def with_draws(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """`rows` with u, uniform in [0, 1), for mark; `repeated` has the marks of more than one row.

    Equal rows are numbered within the partition they are read in, and numbers go on from partition to partition,
    so a task numbers no more than what one has read. It doesn't matter which of them has which number."""

    def draw(number: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.col("mark"), number), 11) / F.lit(float(1 << 53))

    if repeated.isEmpty():
        return rows.withColumn("u", draw(F.lit(0).cast("long"))).drop("mark")
    alone = keyed_join(rows, repeated, ["mark"], "left_anti").withColumn("u", draw(F.lit(0).cast("long")))
    many = keyed_join(rows.withColumn("part", F.spark_partition_id()), repeated, ["mark"], "left_semi")
    before = F.sum("n").over(Window.partitionBy("mark").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = many.groupBy("mark", "part").agg(F.count(F.lit(1)).alias("n"))  # at most one row a partition
    bases = counts.select("mark", "part", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("mark", "part").orderBy(_KEY)) - 1
    numbered = many.withColumn("place", place).join(bases, ["mark", "part"]).withColumn("u", draw(F.col("base") + F.col("place")))
    return alone.drop("mark").unionByName(numbered.drop("mark", "part", "place", "base"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source_key, source_size and target, from a row for each source (source_key, source_size).

    With ratio = most * source_size / weight, a source stops at its cap if the level that the others reach
    without it lies above its ratio: one pass over the sources in order of ratio. The windows hold a row for
    each source, not for each document."""
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(_KEY)) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), _KEY)
    before, from_here = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    rated = w.withColumn("level", level)
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col(_KEY), F.col("level")))).over(everything)
    final = rated.withColumn("water", first["level"])
    return final.select(_KEY, "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def rate(dual: Column, size: Column, mean: Column, most: int = MOST) -> Column:
    return F.when(size == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.least(dual * size / mean, F.lit(50.0)))))


def duals(histogram: DataFrame, wanted: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """source_key, source_size, target, mean and dual of each source.

    `histogram` has n documents for each source_key and size. A step is one aggregate over it, by source; what
    goes from step to step is a row for each source."""
    bars = cut(histogram.filter("size > 0"), "mix-histogram")
    means = bars.groupBy(_KEY).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= F.lit(most) * F.col("source_size")
    start = F.when(full, F.lit(FAR)).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = wanted.join(means, _KEY).withColumns({"dual": start, "low": F.lit(-FAR), "high": F.lit(FAR), "open": ~full})
    state = cut(state, "mix-newton")
    for _ in range(steps):
        if not state.agg(F.max("open")).first()[0]:
            break
        size = F.col("size").cast("double")
        w = rate(F.col("dual"), size, F.col("mean"), most)
        # a row for each source: broadcast by its size as written, or joined by a shuffle that AQE may split
        weighed = bars.join(state.filter("open").select(_KEY, "dual", "mean"), _KEY).withColumn("w", w)
        mass = F.col("w") * size * F.col("n")
        slope = F.when(F.col("w") < most, mass * size / F.col("mean")).otherwise(0.0)
        sums = weighed.groupBy(_KEY).agg(F.sum(mass).alias("total"), F.sum(slope).alias("slope"))
        state = cut(_stepped(state.join(sums, _KEY, "left")), "mix-newton")
    return state.select(_KEY, "source_size", "target", "mean", "dual")


def _stepped(state: DataFrame) -> DataFrame:
    """One guarded Newton step of each open source; null sums leave a source as it is."""
    gap = F.col("total") - F.col("target")
    low = F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
    newton = F.col("dual") - F.log(F.col("total") / F.col("target")) * F.col("total") / F.col("slope")
    inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
    settled = (F.abs(gap) <= 0.5) | (high - low < 1e-12)
    moved = F.when(settled, F.col("dual")).when(inside, newton).otherwise((low + high) / 2)
    going = F.col("open") & F.col("total").isNotNull()
    return state.select(
        _KEY,
        "source_size",
        "target",
        "mean",
        F.when(going, moved).otherwise(F.col("dual")).alias("dual"),
        F.when(going, low).otherwise(F.col("low")).alias("low"),
        F.when(going, high).otherwise(F.col("high")).alias("high"),
        (going & ~settled).alias("open"),
    )


def _shifts(rated: DataFrame, most: int) -> DataFrame:
    """source_key and the shift t whose total is nearest to the target.

    A document takes its k-th copy once t reaches k - w - u; these points, summed by source and bin of t, make
    the total a step function of t."""
    width = 2.0 * (most + 1) / BINS
    point = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.ceil((k.cast("double") - F.col("w") - F.col("u") + (most + 1)) / width))
    bins = rated.filter("size > 0").select(_KEY, "target", "size", F.explode(point).alias("bin"))
    sums = bins.groupBy(_KEY, "bin").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    ordered = Window.partitionBy(_KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = sums.withColumn("total", F.sum("words").over(ordered))
    none = sums.groupBy(_KEY).agg(F.first("target").alias("target")).withColumns({"bin": F.lit(-1).cast("long"), "total": F.lit(0).cast("long")})
    both = total.select(_KEY, "target", "bin", "total").unionByName(none.select(_KEY, "target", "bin", "total"))
    best = both.groupBy(_KEY).agg(F.min(F.struct(F.abs(F.col("total") - F.col("target")).alias("gap"), F.abs(F.col("bin") - BINS // 2).alias("move"), F.col("bin").alias("bin"))).alias("best"))
    return best.select(_KEY, (F.col("best.bin") * width - (most + 1)).alias("shift"))


def _taken(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """`rows` with w, copies and the columns of their source's row of the plan."""
    rows = keyed_join(rows, plan, [_KEY], "inner")
    rows = rows.withColumn("w", F.coalesce(rate(F.col("dual"), F.col("size"), F.col("mean"), most), F.lit(0.0)))
    whole = F.floor(F.col("w") + F.col("u") + F.coalesce(F.col("shift"), F.lit(0.0)))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), whole)))
    moved = F.aggregate("picks", F.lit(0).cast("long"), lambda n, p: n + F.when((p["u"] == F.col("u")) & p["doc_id"].eqNullSafe(F.col("doc_id")), p["way"]).otherwise(0))
    return rows.withColumn("copies", (copies.cast("long") + moved).cast("long"))


def _repair(sized: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """The plan with one more document of each source moved by one copy, where that brings its total nearer to its target."""
    rows = _taken(sized, plan, most)
    gaps = rows.groupBy(_KEY).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    rows = keyed_join(rows, gaps, [_KEY], "inner")
    way = F.signum("gap").cast("long")
    after = F.abs(F.col("gap") - way * F.col("size"))
    can = (F.col("size") > 0) & (F.col("copies") + way).between(0, most) & (after < F.abs("gap"))
    found = rows.groupBy(_KEY).agg(F.min(F.when(can, F.struct(after.alias("after"), F.col("u"), F.col("doc_id"), way.alias("way")))).alias("pick"))
    more = F.when(F.col("pick").isNull(), F.array().cast(PICKS)).otherwise(F.array(F.struct("pick.u", "pick.doc_id", "pick.way")).cast(PICKS))
    return plan.join(found, _KEY, "left").withColumn("picks", F.concat("picks", more)).drop("pick")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, repairs: int = 2) -> DataFrame:
    """A row for each source: source_size, target, mean and dual, the shift, and the documents to move by a copy."""
    histogram = sized.groupBy(_KEY, "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = histogram.groupBy(_KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = cut(targets(sizes, weights, most), "mix-targets")
    solved = duals(histogram, wanted, most).select(_KEY, "mean", "dual")
    out = wanted.join(solved, _KEY, "left").withColumn("shift", F.lit(0.0)).withColumn("picks", F.array().cast(PICKS))
    out = cut(out, "mix-duals")
    rated = keyed_join(sized, out, [_KEY], "inner").withColumn("w", F.coalesce(rate(F.col("dual"), F.col("size"), F.col("mean"), most), F.lit(0.0)))
    out = cut(out.drop("shift").join(_shifts(rated, most), _KEY, "left"), "mix-shifts")
    for _ in range(repairs):
        out = cut(_repair(sized, out, most), "mix-picks")
    return out


def _sized(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written table of the documents' numbers, and the marks of more than one row."""
    sized = cut(with_size(docs), "mix-sizes")
    repeated = sized.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    return sized, cut(repeated, "mix-repeated")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken of every document.

    The text is read once, to count words; what follows works on a written table of a few numbers a row. All
    shuffles carry partial sums by source, size or bin, so a hot source is no hot task."""
    drawn = with_draws(*_sized(docs))
    rows = _taken(drawn, plan(drawn, **options), options.get("most", MOST))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", F.col("w").alias("rate"), "copies", taken)


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with their columns as they are; only the texts of rows that
    are equal in doc_id and text are shuffled."""
    sized, repeated = _sized(docs)
    own = F.struct(*docs.columns).alias("document")
    drawn = with_draws(with_size(docs, own), repeated)
    rows = _taken(drawn, plan(with_draws(sized, repeated), **options), options.get("most", MOST))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.filter("copies > 0").select("document", times).select("document.*")
