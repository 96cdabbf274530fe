"""Mixing sources to target weights by repeating documents.

Tokens (words) are summed per source, each source gets a repetition rate, and a document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy whose probability is the fraction f.

The copies of a source are drawn systematically, so that its words come near its target. Its documents are put into strata
of like sizes (eight steps to a doubling), largest first. With u in [0, 1) hashed from the seed and the source, and C documents up to a
stratum's end, the stratum of n documents copies floor(C f + u) - floor((C - n) f + u) of them: those whose own hashes of
seed, source, doc_id and text are least. Over u and the hashes every document is copied with probability f, and the
number of copies up to any stratum is less than one off C f. As sizes fall from stratum to stratum the words taken are
off by about one document of the largest size at most, whatever the number of documents. Reruns agree. distances() reports how near a
mix comes.

A stratum's least hashes are those up to a threshold. Counts by source, stratum and one of CELLS ranges of the hash say in
which range it lies, and that range's hashes are ordered: no stratum is sorted and no text is shuffled.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id or text draws as the
empty string. Repeated rows have one hash and are copied alike, all or none, also where that is more than the stratum's number.
Sources without words get target 0. An empty table gives no rows. Columns of the input keep their names; those of the
result that clash are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, shield

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Ranges of the hash in which a stratum is counted, and the bits below a range.
CELLS = 4096
CELL_BITS = 20
#: Strata whose thresholds are broadcast; where there are more, rows are joined with them by source and stratum.
BROADCAST_STRATA = 100_000
#: Sizes of one stratum agree in their bits' number and in the three bits below the first.
STRATUM = "length(bin(size)) * 16 + shiftright(size * 8, length(bin(size)) - 1)"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    Reshared excess ends at one level: a source's target is the smaller of its cap and weight * level. Sources
    in ascending order of cap/weight are filled first; the level is the first that the next source's cap is above.
    One row a source goes through the two ordered windows, after the aggregation."""
    listed = F.array(*[F.lit(w) for w in weights])
    ordered = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ordered = ordered.withColumn("_w", F.element_at(listed, (F.col("_i") % len(weights) + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weight = F.sum("source_size").over(everything), F.sum("_w").over(everything)
    filled, used = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = (total * F.lit(share) - filled * cap) / (weight - used)
    found = ordered.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") <= F.col("source_size") * cap)
    at = found.withColumn("_at", F.min(F.when(F.col("_open"), F.struct(F.col("source_size") / F.col("_w"), "_i", "_level"))).over(everything))
    target = F.least(F.col("source_size").cast("double") * cap, F.col("_w") * F.coalesce(F.col("_at._level"), F.lit(float("inf"))))
    return at.select("source", "source_size", target.alias("target"))


def hashed(seed: str, *columns: str) -> F.Column:
    """A number of 32 bits hashed from the seed and the columns."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *told).cast("binary")), 1, 8), 16, 10).cast("long")


def _same(left: str, right: str, *keys: str) -> F.Column:
    """The rows named left and right agree in keys, nulls included."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_STRATA else df


def _quotas(cells: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """One row a source and stratum: n, quota (its number of copies), whole, source_size and target."""
    counts = cells.groupBy("source", "stratum").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("stratum")))
    counts = counts.withColumn("upto", upto).withColumn("u", hashed(seed + "|start", "source") / F.lit(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = targets.withColumn("whole", F.floor(rate).cast("long")).withColumn("f", rate - F.floor(rate))
    both = counts.alias("l").join(rated.alias("r"), _same("l", "r", "source"))
    quota = F.floor(F.col("upto") * F.col("f") + F.col("u")) - F.floor((F.col("upto") - F.col("n")) * F.col("f") + F.col("u"))
    return both.select("l.source", "stratum", "n", quota.cast("long").alias("quota"), "whole", "source_size", "target")


def _thresholds(rows: DataFrame, cells: DataFrame, quotas: DataFrame) -> DataFrame:
    """(source, stratum, upto) of strata that copy some and not all of their documents: the quota-th least hash."""
    some = quotas.where("quota > 0 AND quota < n").select("source", "stratum", "quota")
    running = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("source", "stratum").orderBy("cell")))
    held = running.alias("l").join(_few(some).alias("r"), _same("l", "r", "source", "stratum")).where("upto >= quota AND upto - n < quota")
    held = materialize(held.select("l.source", "l.stratum", "cell", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest")), "mix-held")
    met = rows.alias("l").join(_few(held).alias("r"), _same("l", "r", "source", "stratum", "cell")).select("l.source", "l.stratum", "l.cell", "hash", "rest")
    place = F.row_number().over(Window.partitionBy("source", "stratum", "cell").orderBy("hash"))
    return met.withColumn("place", place).where("place = rest").select("source", "stratum", F.col("hash").alias("upto"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= size * copies)."""
    inner, names = shield(docs.drop("size", "source_size", "target", "copies", "taken"), "doc_id", "text", "source")
    base = inner.withColumn("size", word_count("text")).withColumn("_hash", hashed(seed, "source", "doc_id", "text")).withColumn("_stratum", F.expr(STRATUM))
    rows = materialize(base.select("source", F.col("_stratum").alias("stratum"), F.shiftright("_hash", CELL_BITS).alias("cell"), F.col("_hash").alias("hash"), "size"), "mix-rows")
    cells = materialize(rows.groupBy("source", "stratum", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    quotas = materialize(_quotas(cells, targets, seed), "mix-quotas")
    found = quotas.alias("l").join(_thresholds(rows, cells, quotas).alias("r"), _same("l", "r", "source", "stratum"), "left")
    upto = F.when(F.col("quota") >= F.col("n"), F.lit(1 << 32)).otherwise(F.coalesce("upto", F.lit(-1)))
    strata = materialize(found.select(F.col("l.source").alias("_source"), F.col("l.stratum").alias("_of"), "source_size", "target", "whole", upto.alias("_upto")), "mix-strata")
    strata = _few(strata.withColumnRenamed("whole", "_whole"))  # no text is shuffled
    out = base.join(strata, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_stratum") == F.col("_of")))
    copies = F.col("_whole") + (F.col("_hash") <= F.col("_upto")).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("_source", "_of", "_stratum", "_hash", "_whole", "_upto")
    return out.withColumnsRenamed(names)


def distances(mixed: DataFrame) -> DataFrame:
    """(source, documents, target, taken, off): words that each source gave, and their distance as a share of the target."""
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
    return per.withColumn("off", F.when(F.col("target") > 0, F.abs(F.col("taken") - F.col("target")) / F.col("target")).otherwise(F.lit(0.0)))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as mix() says, with copy counting from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
