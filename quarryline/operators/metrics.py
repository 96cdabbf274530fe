"""Ranking, threshold and top-k metrics, and tuning. All questions count, also those without rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.lexical import best
from quarryline.operators.prefix import running_sums

KS = (1, 3, 5, 10, 20, 50)
NDCG_KS = (3, 5, 10, 20, 50)
#: Predictions a question: the fallback where no score reaches the threshold, and the most.
FALLBACK, MOST = 5, 5


def ranked(rows: DataFrame, score: str) -> DataFrame:
    """(qid, aid, score, rank): one row an article, its largest score, best first. Scores are rounded to nine digits:
    sums of doubles differ in their last bits from one evaluation to the next, and thresholds compare them."""
    one = rows.groupBy("qid", "aid").agg(F.round(F.max(score), 9).alias("score"))
    return one.withColumn("rank", F.row_number().over(best("score")))


def judged(rows: DataFrame, score: str, qrels: DataFrame) -> DataFrame:
    marks = qrels.select("qid", "aid").distinct().withColumn("_r", F.lit(1))
    return ranked(rows, score).join(marks, ["qid", "aid"], "left").withColumn("hit", F.coalesce("_r", F.lit(0))).drop("_r")


def positives(questions: DataFrame, qrels: DataFrame) -> DataFrame:
    per = qrels.select("qid", "aid").distinct().groupBy("qid").agg(F.count("*").alias("positives"))
    return questions.select("qid").join(per, "qid", "left").fillna(0, ["positives"])


def per_question(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame, ks=KS, ndcg_ks=NDCG_KS) -> DataFrame:
    """A row a question with hit@k, recall@k and ndcg@k."""
    found_rows = judged(rows, score, qrels).where(F.col("rank") <= max(*ks, *ndcg_ks))
    aggs = [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks]
    aggs += [F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}") for k in ndcg_ks]
    every = positives(questions, qrels).join(found_rows.groupBy("qid").agg(*aggs), "qid", "left").fillna(0)
    cols = {}
    for k in ks:
        cols[f"hit@{k}"] = (F.col(f"h{k}") > 0).cast("double")
        cols[f"recall@{k}"] = F.col(f"h{k}") / F.greatest("positives", F.lit(1))
    for k in ndcg_ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least("positives", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        cols[f"ndcg@{k}"] = F.when(F.col("positives") > 0, F.col(f"d{k}") / ideal).otherwise(0.0)
    return every.select("qid", *[F.when(F.lit(True), c).alias(n) for n, c in cols.items()])


def ranking(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame, ks=KS, ndcg_ks=NDCG_KS) -> DataFrame:
    """(metric, value): means over all questions."""
    per = per_question(rows, score, questions, qrels, ks, ndcg_ks)
    names = [c for c in per.columns if c != "qid"]
    wide = per.agg(*[F.coalesce(F.avg(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])).alias("m")).select("m.*")


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return {"precision": p, "recall": r, "f2": 5 * p * r / F.greatest(4 * p + r, F.lit(1e-12))}


def topk(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(k, tp, fp, fn, precision, recall, f2) at each k, summed over questions."""
    found_rows = judged(rows, score, qrels).where(F.col("rank") <= max(ks))
    found = found_rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").groupBy("k").agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fp"))
    total = positives(questions, qrels).agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("pos"))
    grid = total.select("pos", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    every = grid.join(found, "k", "left").fillna(0).withColumn("fn", F.col("pos") - F.col("tp"))
    return every.select("k", "tp", "fp", "fn", *[c.alias(n) for n, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def by_split(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame, splits: DataFrame, threshold: float, k: int) -> DataFrame:
    """(split, metric, value) of all splits (qid, split) in one pass: the means of per_question(), and precision, recall and
    f2 at a threshold (threshold_*) and at a depth (topk_*)."""
    per = per_question(rows, score, questions, qrels).join(splits, "qid")
    names = [c for c in per.columns if c not in ("qid", "split")]
    wide = per.groupBy("split").agg(*[F.avg(f"`{n}`").alias(n) for n in names])
    found_rows = judged(rows, score, qrels).join(splits, "qid")
    n = F.sum((F.col("score") >= threshold).cast("int")).over(Window.partitionBy("qid"))
    cut = {"threshold": F.col("rank") <= F.when(F.col("_n") == 0, FALLBACK).otherwise(F.least("_n", F.lit(MOST))), "topk": F.col("rank") <= k}
    sums = [F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(f"{kind}_{side}") for kind, c in cut.items() for side, x in (("tp", F.col("hit")), ("fp", 1 - F.col("hit")))]
    taken = found_rows.withColumn("_n", n).groupBy("split").agg(*sums)
    total = positives(questions, qrels).join(splits, "qid").groupBy("split").agg(F.sum("positives").alias("_pos"))
    wide = wide.join(total, "split").join(taken, "split", "left").fillna(0)
    for kind in cut:
        tp = F.col(f"{kind}_tp")
        for rate, c in rates(tp, F.col(f"{kind}_fp"), F.col("_pos") - tp).items():
            wide = wide.withColumn(f"{kind}_{rate}", c)
            names.append(f"{kind}_{rate}")
    return wide.select("split", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])).alias("m")).select("split", "m.*")


def tune_topk(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame, most: int) -> DataFrame:
    """The row of topk() with the best (f2, recall, precision), then the smallest k, among 1..5 and most."""
    ks = sorted({*range(1, min(5, most) + 1), most})
    return topk(rows, score, questions, qrels, ks).orderBy(F.round("f2", 12).desc(), F.round("recall", 12).desc(), F.round("precision", 12).desc(), "k").limit(1)


def threshold(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame, at: float) -> DataFrame:
    """One row (threshold, tp, fp, fn, precision, recall, f2): a question predicts its rows at or above the threshold,
    its first FALLBACK if there are none, its first MOST if there are more."""
    found_rows = judged(rows, score, qrels)
    n = F.sum((F.col("score") >= at).cast("int")).over(Window.partitionBy("qid"))
    taken = found_rows.withColumn("_n", n).where(F.col("rank") <= F.when(F.col("_n") == 0, FALLBACK).otherwise(F.least("_n", F.lit(MOST))))
    found = taken.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), F.coalesce(F.sum(1 - F.col("hit")), F.lit(0)).alias("fp"))
    total = positives(questions, qrels).agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("pos"))
    both = found.join(total, how="cross").withColumn("fn", F.col("pos") - F.col("tp")).withColumn("threshold", F.lit(float(at)))  # one row each
    return both.select("threshold", "tp", "fp", "fn", *[c.alias(n) for n, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def threshold_curve(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """threshold() at every distinct score, without pairing scores with rows.

    Only a question's first rows matter: at threshold t it predicts its first m rows, m being the count of scores at or
    above t if that is between 1 and MOST, else MOST. tp and fp are then step functions with a few steps a question:
    a base for the fallback, and changes at the question's own scores, summed along the distinct thresholds."""
    found_rows = judged(rows, score, qrels)
    top = found_rows.where(F.col("rank") <= max(MOST, FALLBACK))
    base = top.where(F.col("rank") <= FALLBACK).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("btp"), F.coalesce(F.sum(1 - F.col("hit")), F.lit(0)).alias("bfp"))
    # Going down from the largest threshold: a question's first row at its own best score replaces the fallback.
    w = Window.partitionBy("qid").orderBy("rank")
    own = top.where(F.col("rank") <= MOST).withColumn("atp", F.sum("hit").over(w)).withColumn("afp", F.sum(1 - F.col("hit")).over(w))
    last = own.groupBy("qid", "score").agg(F.max("rank").alias("r"), F.max_by("atp", "rank").alias("atp"), F.max_by("afp", "rank").alias("afp"))
    w2 = Window.partitionBy("qid").orderBy(F.desc("score"))
    fall = top.where(F.col("rank") <= FALLBACK).groupBy("qid").agg(F.sum("hit").alias("ftp"), F.sum(1 - F.col("hit")).alias("ffp"))
    steps = last.join(fall, "qid").select(
        "score",
        (F.col("atp") - F.coalesce(F.lag("atp").over(w2), F.col("ftp"))).alias("dtp"),
        (F.col("afp") - F.coalesce(F.lag("afp").over(w2), F.col("ffp"))).alias("dfp"),
    )
    events = found_rows.select("score", F.lit(0).alias("dtp"), F.lit(0).alias("dfp")).distinct().unionByName(steps)
    per = events.groupBy("score").agg(F.sum("dtp").alias("dtp"), F.sum("dfp").alias("dfp"))  # one row a threshold
    summed = running_sums(per, [F.desc("score")], {"t": "dtp", "f": "dfp"})
    total = positives(questions, qrels).agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("pos"))
    run = summed.select("score", "t", "f").join(base, how="cross").join(total, how="cross")  # one row each
    run = run.select(F.col("score").alias("threshold"), (F.col("t") + F.col("btp")).alias("tp"), (F.col("f") + F.col("bfp")).alias("fp"), "pos").withColumn("fn", F.col("pos") - F.col("tp"))
    return run.select("threshold", "tp", "fp", "fn", *[c.alias(n) for n, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def tune_threshold(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """The row of threshold_curve() with the best (f2, recall, precision); of equals the lowest threshold."""
    return threshold_curve(rows, score, questions, qrels).orderBy(F.round("f2", 12).desc(), F.round("recall", 12).desc(), F.round("precision", 12).desc(), "threshold").limit(1)


def describe(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, min, p25, p50, p75, max; a percentile is the value at position floor((n - 1) p)."""
    at = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("x")).groupBy("x").agg(F.count("*").alias("c"))  # one row a value
    at = running_sums(at, [F.asc("x")], {"upto": "c"})
    n = at.agg(F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    joined = at.join(n.select("n"), how="cross")  # one row

    def p(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q), F.col("x"))).alias(f"p{int(q * 100)}")

    return n.join(joined.agg(p(0.25), p(0.5), p(0.75)), how="cross").select(F.col("n").alias("count"), "mean", "min", "p25", "p50", "p75", "max")


def compare(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """(split, metric, base_value, other_value, delta, percent) of two methods in a long table (method, split, metric,
    value); percent is null where the base is 0."""
    a = metrics.where(F.col("method") == base).select("split", "metric", F.col("value").alias("base_value"))
    b = metrics.where(F.col("method") == other).select("split", "metric", F.col("value").alias("other_value"))
    delta = F.col("other_value") - F.col("base_value")
    return a.join(b, ["split", "metric"]).withColumn("delta", delta).withColumn("percent", F.when(F.col("base_value") != 0, 100 * delta / F.col("base_value")))


def pool_counts(rows: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
    """One row: rows of a full pool of top_k a question, actual rows, what is missing, and the least, most and average
    rows of the questions that have any."""
    per = rows.groupBy("qid").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("actual"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average"))
    full = questions.agg((F.count("*") * top_k).alias("full"))
    return full.join(per, how="cross").select("full", "actual", F.greatest(F.col("full") - F.col("actual"), F.lit(0)).alias("missing"), "least", "most", "average")  # one row each


def label_stats(rows: DataFrame, score: str, norm: str) -> DataFrame:
    """One row: rows, relevant rows, distinct qids and aids, and the ranges of a score and its norm."""
    return rows.agg(
        F.count("*").alias("rows"), F.sum("label").alias("positive_rows"), F.countDistinct("qid").alias("unique_qids"), F.countDistinct("aid").alias("unique_aids"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.min(norm).alias("norm_min"), F.max(norm).alias("norm_max"),
    )
