"""Deterministic splits of questions and their leak report."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import normalized


def allocate_counts(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole counts in the ratios' shares (they need not sum to 1). With as many rows as splits of positive ratio, each
    split that rounds down to none borrows one from the largest split that has more than one; what is left then goes to
    the largest remainders, earlier splits first."""
    whole = sum(ratios.values())
    if total < 0 or whole <= 0:
        raise ValueError("splits need a count of at least 0 and a positive ratio")
    exact = {k: total * r / whole for k, r in ratios.items()}
    floors = {k: floor(x + 1e-9) for k, x in exact.items()}
    counts, wanted = dict(floors), [k for k, r in ratios.items() if r > 0]
    for k in wanted if total >= len(wanted) else []:
        lender = max(wanted, key=lambda x: counts[x])
        if counts[k] == 0 and counts[lender] > 1:
            counts[lender] -= 1
            counts[k] = 1
    by_remainder = sorted(ratios, key=lambda k: round(floors[k] - exact[k], 9))
    for k in by_remainder[: total - sum(counts.values())]:
        counts[k] += 1
    return counts


def assign(questions: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """(qid, split): distinct qids in the order of a seeded hash, cut at the allocated counts.

    The order is global, so hash prefixes are counted first and only the rank within a prefix needs a window."""
    ids = questions.select("qid").where("qid IS NOT NULL").distinct()
    ids = ids.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("qid").cast("string")).cast("binary"))).withColumn("_p", F.substring("_h", 1, 2))
    sizes = {r["_p"]: r["count"] for r in ids.groupBy("_p").count().collect()}  # at most 256 prefixes
    counts = allocate_counts(sum(sizes.values()), ratios)
    before, run = {}, 0
    for p in sorted(sizes):
        before[p], run = run, run + sizes[p]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_p")] if before else F.lit(0)
    rank = base + F.row_number().over(Window.partitionBy("_p").orderBy("_h", "qid"))
    split, upto = F.lit(None).cast("string"), 0
    edges = []
    for name, n in counts.items():
        upto += n
        edges.append((name, upto))
    for name, edge in reversed(edges):
        split = F.when(rank <= edge, F.lit(name)).otherwise(split)
    return ids.select("qid", split.alias("split"))


def coverage(questions: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows (qid, problem) that must not exist: qids in several splits, in none, or unknown."""
    several = splits.groupBy("qid").agg(F.countDistinct("split").alias("n")).where("n > 1").select("qid", F.lit("several").alias("problem"))
    none = questions.select("qid").distinct().join(splits, "qid", "left_anti").select("qid", F.lit("missing").alias("problem"))
    extra = splits.select("qid").distinct().join(questions, "qid", "left_anti").select("qid", F.lit("unknown").alias("problem"))
    return several.unionByName(none).unionByName(extra)


def _overlap(values: DataFrame, kind: str, examples: int) -> DataFrame:
    """Values that two splits share: values has (split, value). Each value gathers its splits, at most a handful."""
    shared = values.distinct().groupBy("value").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    pairs = shared.select("value", F.explode(pair).alias("p")).select("value", "p.*")
    # The first values of a pair are picked before the shuffle, and counts are summed before it.
    nth = F.row_number().over(Window.partitionBy("left", "right").orderBy("value"))
    first = pairs.withColumn("_n", nth).where(F.col("_n") <= examples).groupBy("left", "right").agg(F.array_sort(F.collect_list(F.col("value").cast("string"))).alias("examples"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("overlap_count")).join(first, ["left", "right"]).withColumn("kind", F.lit(kind))


def leak_report(questions: DataFrame, splits: DataFrame, qrels: DataFrame | None = None, examples: int = 5) -> DataFrame:
    """(kind, left, right, overlap_count, examples) of qids, question texts and relevant ids that two splits share."""
    rows = questions.join(splits, "qid")
    out = _overlap(rows.select("split", F.col("qid").cast("string").alias("value")), "qid", examples)
    out = out.unionByName(_overlap(rows.select("split", normalized(F.col("question")).alias("value")), "text", examples))
    if qrels is not None:
        out = out.unionByName(_overlap(qrels.join(splits, "qid").select("split", F.col("aid").cast("string").alias("value")), "aid", examples))
    return out


def counts(questions: DataFrame, splits: DataFrame, qrels: DataFrame) -> DataFrame:
    """(split, questions, texts, aids): distinct counts a split."""
    rows = questions.join(splits, "qid").withColumn("_t", normalized(F.col("question")))
    base = rows.groupBy("split").agg(F.countDistinct("qid").alias("questions"), F.countDistinct("_t").alias("texts"))
    aids = qrels.join(splits, "qid").groupBy("split").agg(F.countDistinct("aid").alias("aids"))
    return base.join(aids, "split", "left").fillna(0, ["aids"])


def require_disjoint_texts(questions: DataFrame, splits: DataFrame) -> None:
    """Raise if a normalised question text occurs in two splits."""
    found = leak_report(questions, splits).where("kind = 'text'").collect()  # one row a pair of splits
    if found:
        raise ValueError(f"question texts cross splits: {[(r['left'], r['right'], r['overlap_count']) for r in found]}")


def write_splits(questions: DataFrame, splits: DataFrame, path: str) -> None:
    """One folder of JSON lines a split."""
    questions.join(splits, "qid").write.mode("overwrite").partitionBy("split").json(path)


def sample_corpus(articles: DataFrame, questions: DataFrame, qrels: DataFrame, n_questions: int, n_extra: int, seed: int = 42) -> DataFrame:
    """Articles that are relevant to a hash-drawn sample of questions, and a hash-drawn sample of others; without
    extras, all articles of the relevant ones' laws."""
    order = lambda c: F.md5(F.concat(F.lit(f"{seed}|"), F.col(c).cast("string")).cast("binary"))
    drawn = questions.select("qid").orderBy(order("qid"), "qid").limit(n_questions)
    wanted = qrels.join(drawn, "qid", "left_semi").select("aid").distinct()
    positive = articles.join(wanted, "aid", "left_semi")
    if not n_extra:
        return articles.join(positive.select("law_id").distinct(), "law_id", "left_semi")
    rest = articles.join(wanted, "aid", "left_anti").orderBy(order("aid"), "aid").limit(n_extra)
    return positive.unionByName(rest)


def laws(articles: DataFrame) -> DataFrame:
    """Articles nested again: (law_id, content array of (aid, text)), as the raw corpus has them."""
    return articles.groupBy("law_id").agg(F.array_sort(F.collect_list(F.struct("aid", "text"))).alias("content"))
