"""Mixing sources to target weights by entropy balancing.

Each document gets a rate that departs as little as possible, in relative entropy, from one copy while
the words of each source meet its target and no rate exceeds ``MOST``. The convex dual has one
multiplier for each source: rate = min(MOST, exp(multiplier * size / scale)), scale being the source's
mean size. Its gradient and curvature are sums over documents, taken in Spark over a histogram of
(source, size), as rates depend on nothing else; Newton steps are kept inside a bracket that shrinks
every iteration.

Rates become copies by systematic rounding along sizes within each source: the copies of any run of
documents differ from the sum of its rates by less than one. What then is missing to the target is
mended by one more or one less copy of the document whose size is nearest to it.

No group is gathered: ranks within one size are taken in blocks of about BLOCK documents, hashed by id, or by text and source where that is null.

Defined results: null texts have size 0; documents of size 0 are taken with 0 words; the null source is
a source, last; repeated rows are documents of their own; an empty table gives no rows; a corpus without
words has targets 0; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, size_words, stored, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
ITERATIONS = 40
BLOCK = 512


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target. sizes: source, total. The excess of sources over MOST times their
    size goes to the others by weight until none is above: sources fill up in order of their cap by
    weight, so the level is found by running sums over that order."""
    ranked = sizes.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.array(*map(F.lit, map(float, WEIGHTS)))[((F.col("i") - 1) % len(WEIGHTS)).cast("int")]
    x = ranked.select("source", F.col("total").alias("source_size"), weight.alias("w"), (F.lit(float(MOST)) * F.col("total")).alias("cap"), "i")
    x = x.withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "i")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    x = x.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source in that order that stays below its cap sets the level for all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(whole)["level"]
    return x.select("source", F.col("source_size").cast("long").alias("source_size"), F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _rate(multiplier, size, scale):
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(50.0), multiplier * size / scale)))


def multipliers(histogram: DataFrame, targets: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """source, scale, target, m: the dual's solution by bracketed Newton steps. Stops when every
    source's sum is within a millionth of its target or half a word."""
    start = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum("n"), F.lit(1))).alias("scale"))
    now = start.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", F.greatest("scale", F.lit(1.0)).alias("scale"), "target", F.lit(0.0).alias("m"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(False).alias("done"))
    now = stored(now, "dual")
    for _ in range(iterations):
        rate = _rate(F.col("m"), F.col("size"), F.col("scale"))
        words = F.col("n") * F.col("size")
        s = histogram.where("size > 0").alias("h").join(now.select("source", "m", "scale").alias("d"), F.col("h.source").eqNullSafe(F.col("d.source")))
        s = s.groupBy("d.source").agg(F.sum(words * rate).alias("sum"), F.sum(F.when(rate < MOST, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        j = now.alias("n").join(s.alias("s"), F.col("n.source").eqNullSafe(F.col("s.source")), "left").select("n.*", F.coalesce("sum", F.lit(0.0)).alias("sum"), F.coalesce("slope", F.lit(0.0)).alias("slope"))
        over = F.col("sum") - F.col("target")
        done = F.abs(over) <= F.greatest(F.col("target") * 1e-6, F.lit(0.5))
        j = j.withColumn("lo", F.when(over < 0, F.col("m")).otherwise(F.col("lo"))).withColumn("hi", F.when(over >= 0, F.col("m")).otherwise(F.col("hi")))
        step = F.col("m") - F.try_divide(over, "slope")
        middle = (F.col("lo") + F.col("hi")) / 2
        j = j.select("source", "scale", "target", F.when(done | F.col("done"), F.col("m")).when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise(middle).alias("m"), "lo", "hi", (done | F.col("done")).alias("done"))
        old, now = now, stored(j, "dual")
        forget(old)
        if now.where("not done").isEmpty():
            break
    return now.select("source", "scale", "target", "m")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """_id, size, source, source_size, target, rate, n: how often the mix takes each row of docs; and
    _row, the value of row_col, which numbers the rows (null without one)."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("_row")
    hashed = F.when(F.col(id_col).isNull(), F.xxhash64(text, source)).otherwise(F.xxhash64(id_col)).alias("h")
    rows = stored(docs.select(F.col(id_col).alias("_id"), source.alias("source"), size_words(text).alias("size"), row, hashed), "sizes")
    histogram = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    targets = stored(source_targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"))), "targets")
    dual = multipliers(histogram, targets)
    # within a source classes of one size follow each other; r is the sum of rates before a class
    c = histogram.alias("h").join(dual.alias("d"), F.col("h.source").eqNullSafe(F.col("d.source"))).select("h.source", "size", "n", _rate(F.col("m"), F.col("size"), F.col("scale")).alias("rate"))
    before = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    c = stored(c.withColumn("r", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0))).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "rates")
    in_class = [F.col("x.source").eqNullSafe(F.col("c.source")), F.col("x.size") == F.col("c.size")]
    laid = rows.alias("x").join(c.alias("c"), in_class).select("_id", "_row", "x.source", "x.size", "rate", "r", F.pmod("h", F.col("blocks").cast("long")).alias("block"), "h")
    first = W.partitionBy("source", "size").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = laid.groupBy("source", "size", "block").agg(F.count("*").alias("n")).select("source", "size", "block", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    laid = laid.alias("x").join(blocks.alias("c"), [*in_class, F.col("x.block") == F.col("c.block")]).select("_id", "_row", "x.source", "x.size", "rate", "r", "x.block", "h", "before")
    k = F.col("before") + F.row_number().over(W.partitionBy("source", "size", "block").orderBy("h", "_id", "_row"))
    at = lambda i: F.floor(F.col("r") + i * F.col("rate") + F.lit(0.5) + 1e-9)
    laid = stored(laid.withColumn("k", k).withColumn("n", F.least(F.greatest(at(F.col("k")) - at(F.col("k") - 1), F.lit(0)), F.lit(MOST))), "copies")
    got = laid.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("got"))
    gap = targets.alias("t").join(got.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))).select("t.source", "source_size", "target", (F.col("target") - F.col("got")).alias("gap"))
    gap = stored(gap, "gap")  # a row a source: its size is then known, and small enough it is broadcast
    # one document a source whose copy more or less leaves the smallest gap, if it leaves a smaller one
    able = laid.alias("l").join(gap.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).where(((F.col("gap") > 0) & (F.col("n") < MOST)) | ((F.col("gap") < 0) & (F.col("n") > 0))).where("size > 0")
    mend = able.withColumn("left", F.abs(F.abs("gap") - F.col("size"))).where(F.col("left") < F.abs("gap")).groupBy("l.source").agg(F.min(F.struct("left", "size", "h", "_id", "block", "k", F.signum("gap").cast("int").alias("by"))).alias("m"))
    info = gap.alias("g").join(mend.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")), "left").select("g.source", "source_size", "target", "m")
    info = stored(info, "mend")
    here = (F.col("m.size") == F.col("l.size")) & F.col("m._id").eqNullSafe(F.col("l._id")) & (F.col("m.block") == F.col("l.block")) & (F.col("m.k") == F.col("l.k"))
    return laid.alias("l").join(info.alias("i"), F.col("l.source").eqNullSafe(F.col("i.source"))).select(
        "l._id", "l._row", "l.size", "l.source", "source_size", "target", "rate", (F.col("n") + F.when(here, F.col("m.by")).otherwise(0)).cast("int").alias("n"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, whether ids are null or repeated."""
    # numbered rows are written, so that a row keeps its number
    rows = stored(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "rows")
    n = copies(rows, id_col, text_col, source_col, "__mix_row").where("n > 0").select(F.col("_row").alias("__mix_row"), F.col("n").alias("__mix_n"))
    both = rows.join(n, "__mix_row")
    return both.withColumn("__mix_i", F.explode(F.array_repeat(F.lit(1), F.col("__mix_n")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = copies(table(spark, sf_dir, "documents"))
    return c.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("n") * F.col("size")).cast("long").alias("taken"))


ORACLES = {}
QUERIES = {"op7_mixing": op7_mixing}
