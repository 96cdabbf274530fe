"""The stages of a run: which tables each writes, from which it reads, and in which order names stand for others."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import audit, dense, fusion, negatives, pair_scorer, postings, rerank, retriever, splits
from quarryline.plans import evaluate, index, models, store
from quarryline.plans.options import Options
from quarryline.session import ensure_importable, materialize
from quarryline.sources import corpus

log = logging.getLogger("quarryline")

#: Stages and the tables that they write. Training on GPUs has no stage here; train_bge and train_reranker need none.
STAGES: dict[str, tuple[str, ...]] = {
    "prepare_data": ("articles", "questions", "qrels", "chunks"),
    "split": ("splits", "leak_report"),
    "tune_bm25": ("bm25_tuning",),
    "build_bm25": (),
    "build_dense_index": (),
    "mine_hard_negatives": ("positive_chunks", "mined"),
    "sample_negatives": ("retriever_rows", "reranker_rows", "triplets", "pairs", "prompts"),
    "train_bge": ("retriever",),
    "train_reranker": ("pair_scorer",),
    "retrieve_cache": ("merged",),
    "tune_hybrid": ("hybrid_tuning", "hybrid_tuned"),
    "train_router": ("router_weights", "router_labels", "router_alphas", "hybrid_fixed", "hybrid_router", "router_metrics"),
    "rerank_bge": ("reranked",),
    "rerank_llm": ("reranked_second",),
    "rerank_qwen": ("reranked_qwen",),
    "evaluate": ("metrics",),
    "audit": ("audit",),
}
COMPOSITES = {
    "tune_and_build_bm25": ("tune_bm25", "build_bm25"),
    "prepare_training_data": ("prepare_data", "split", "build_dense_index", "mine_hard_negatives", "sample_negatives"),
    "all": ("prepare_data", "split", "tune_and_build_bm25", "build_dense_index", "mine_hard_negatives", "sample_negatives", "retrieve_cache", "tune_hybrid", "train_router", "rerank_bge", "rerank_llm", "rerank_qwen", "evaluate"),
}
#: The scorer that a run trains on its own pairs: --rerank_model trained.
TRAINED = "trained"
#: Where the trained retriever's summary and marker are, below the run's folder.
CHECKPOINT = "models/retriever"
#: Stages that run only where an option asks for them.
OPTIONAL = {"rerank_llm": "use_llm_rerank", "rerank_qwen": "use_qwen_rerank"}


class Run:
    """Tables of one data set below output_dir/dataset_name, each built once for its inputs and options."""

    def __init__(self, spark: SparkSession, options: Options):
        ensure_importable(spark)
        self.spark, self.o = spark, options
        self.store = store.Store(spark, f"{options.output_dir}/{options.dataset_name}")
        self.plan = evaluate.Config(
            max_tokens=options.max_chunk_tokens, overlap=options.chunk_overlap_sentences, k1=options.bm25_k1, b=options.bm25_b, top_k=options.top_k,
            alpha=options.hybrid_alpha, rerank_top_k=options.candidate_top_k, max_chunks_per_article=options.max_chunks_per_article or None,
        )
        self.encode = models.encoder(options.dense_model)
        for name in (options.rerank_model, options.qwen_model):
            if name != TRAINED:
                models.scorer(name)
        self.built: set[str] = set()
        self.fitted: evaluate.Router | None = None

    def stage(self, name: str) -> None:
        """Run a stage, or those that its name stands for."""
        for plain in store.expand(name, set(STAGES), COMPOSITES):
            if plain in OPTIONAL and not getattr(self.o, OPTIONAL[plain]):
                log.info("skipped %s: %s is false", plain, OPTIONAL[plain])
                continue
            log.info("stage %s", plain)
            if plain == "build_dense_index":
                self.dense_index(build=self.o.force)
            if plain == "build_bm25":
                self.bm25_index(build=self.o.force)
            for table in STAGES[plain]:
                self.get(table, self.o.force or plain in ("evaluate", "audit"))  # what there is to judge may have grown
            if plain == "train_bge":
                self.publish()

    def get(self, name: str, force: bool = False) -> DataFrame:
        """A table, built with those it needs unless it is complete."""
        if name in self.built and not force:
            return self.store.read(name)
        build, inputs, params = TABLES[name]
        for i in inputs:
            self.get(i)
        wanted = {p: FOUND[p](self) if p in FOUND else getattr(self.o, p) for p in params}
        if not inputs and name != "audit":  # the sources' files are told by their contents
            wanted["files"] = [r["hash"] for p in (self.o.corpus_path, self.o.questions_path) for r in store.file_hashes(self.spark, p).orderBy("path").collect()]
        step = store.Stage(name, lambda _: build(self), wanted, inputs)
        rows = self.store.run(step, force and name not in self.built)
        self.built.add(name)
        return rows

    def fields(self) -> corpus.Fields:
        o = self.o
        return corpus.Fields(o.corpus_law_id_field, o.corpus_articles_field, o.article_id_field, o.article_text_field, o.question_id_field, o.question_text_field, o.relevant_ids_field)

    def bm25(self) -> tuple[float, float]:
        """The tuned parameters, where there are any and they are wanted, else the options'."""
        if self.o.use_tuned_bm25 and self.store.marker("bm25_tuning").get("status") == "done":
            best = self.get("bm25_tuning").first()
            return best["k1"], best["b"]
        return self.o.bm25_k1, self.o.bm25_b

    def trained_scorer(self) -> str:
        """What the trained scorer was made of, where it is the one to use."""
        if self.o.rerank_model != TRAINED:
            return ""
        self.get("pair_scorer")
        return self.store.marker("pair_scorer")["input_hash"]

    def publish(self) -> None:
        """Make the trained retriever the run's dense model: its summary, then the marker of the summary."""
        path, row, made = self.store.path(CHECKPOINT), self.get("retriever").first(), self.store.marker("retriever")
        loss = row["held_loss"] if row["held_loss"] < float("inf") else None
        store.write_json(self.spark, f"{path}/train_summary.json", {k: made[k] for k in ("input_hash", "created_at")} | {"epoch": row["epoch"], "held_loss": loss})
        store.write_json(self.spark, f"{path}/train_summary.json.done.json", {"status": "done"})

    def base_identity(self) -> dict:
        """The dense model that training data is mined with: never the trained one, which is made of that data."""
        return index.resolve_model(self.spark, self.o.dense_model)

    def dense_identity(self) -> dict:
        """The dense model that retrieves: the trained one, where there is one."""
        return index.resolve_model(self.spark, self.o.dense_model, self.store.path(CHECKPOINT))

    def encoder(self) -> Callable[[DataFrame, str, str], DataFrame]:
        """The encoder of dense_identity()."""
        if not self.dense_identity()["marker_hash"]:
            return self.encode
        if store.read_json(self.spark, f"{self.store.path(CHECKPOINT)}/train_summary.json")["created_at"] != self.store.marker("retriever").get("created_at"):
            raise ValueError("the trained retriever is not the one that its summary tells of: run train_bge again")
        return retriever.encoder(self.store.read("retriever"), self.encode)

    def dense_index(self, build: bool = False, base: bool = False) -> DataFrame:
        """The chunks' vectors, from an index that the retrieving model, or the base model, made of these chunks."""
        identity, chunks = self.base_identity() if base else self.dense_identity(), self.get("chunks")
        trained = bool(identity["marker_hash"])
        step = store.Stage("dense_index_trained" if trained else "dense_index", lambda _: chunks, identity, ("chunks",))
        encode, backend = (self.encoder(), TRAINED) if trained else (self.encode, self.o.dense_model)
        path = self.store.keep(step, lambda p: index.build(self.spark, chunks, p, identity, encode, backend), build and step.name not in self.built)
        self.built.add(step.name)
        return index.open_index(self.spark, path, identity)

    def bm25_index(self, build: bool = False) -> postings.Index:
        """The articles' BM25 index."""
        articles = self.get("articles")
        step = store.Stage("bm25_index", lambda _: articles, {}, ("articles",))
        path = self.store.keep(step, lambda p: postings.write(articles, p), build and step.name not in self.built)
        self.built.add(step.name)
        return postings.read(self.spark, path)

    def of(self, rows: DataFrame, *names: str) -> DataFrame:
        """Rows of questions in the splits."""
        return rows.join(self.get("splits").where(F.col("split").isin(*names)).select("qid"), "qid", "left_semi")

    def router(self) -> evaluate.Router:
        if self.fitted is None:
            self.fitted = evaluate.train_router(self.get("merged"), self.get("questions"), self.get("qrels"), self.get("splits"), self.plan)
        return self.fitted


def _chunks(run: Run) -> DataFrame:
    rows = evaluate.chunk_table(run.get("articles"), run.plan)
    if run.o.max_chunks and (n := rows.count()) > run.o.max_chunks:
        raise ValueError(f"{n} chunks are more than max_chunks allows")
    return rows


def _questions(run: Run) -> DataFrame:
    return corpus.read_questions(run.spark, run.o.questions_path, run.fields(), run.o.json_lines)


def _splits(run: Run) -> DataFrame:
    """The split of every question. A text that is in two splits raises."""
    asked = run.get("questions")
    rows = materialize(splits.assign(asked, run.o.ratios, run.o.seed), "assigned")
    splits.require_disjoint_texts(asked, rows)
    return rows


def _tuning(run: Run) -> DataFrame:
    grid = [(k1, b) for k1 in run.o.bm25_k1_grid for b in run.o.bm25_b_grid]
    return evaluate.tune_bm25(run.of(run.get("questions"), "train"), run.get("articles"), run.of(run.get("qrels"), "train"), grid, 20, run.bm25_index())


def _merged(run: Run) -> DataFrame:
    from dataclasses import replace

    k1, b = run.bm25()
    return evaluate.retrieve(run.get("questions"), run.get("articles"), run.get("chunks"), run.get("qrels"), replace(run.plan, k1=k1, b=b), run.dense_index(), run.bm25_index(), run.encoder())


def _mined(run: Run) -> DataFrame:
    asked = run.of(run.get("questions"), "train")
    found = dense.search(run.encode(asked, "qid", "question"), run.dense_index(base=True), run.o.top_k)
    return negatives.mine(found, run.get("chunks"), run.get("qrels"))


def _positive(run: Run) -> DataFrame:
    asked = run.encode(run.of(run.get("questions"), "train"), "qid", "question")
    return dense.positive_chunks(asked, run.get("qrels"), run.get("chunks"), run.dense_index(base=True), run.o.positive_chunks_per_aid)


def _tuned(run: Run) -> DataFrame:
    """The pool under the weight that the validation split chose."""
    best = run.get("hybrid_tuning").first()
    return fusion.apply_hybrid(run.of(run.get("merged"), "router", "val", "test"), fixed=best["alpha"] if best else run.o.hybrid_alpha)


def _ready(policy) -> Callable[[Run], DataFrame]:
    return lambda run: negatives.ready(run.get("positive_chunks"), negatives.draw(run.get("mined"), policy, run.o.seed), run.get("chunks"), run.get("questions"))


def _reranked(run: Run) -> DataFrame:
    rows = run.get("hybrid_router").select("qid", "aid", "label", "hybrid_score")
    return rerank.rerank(rows, run.get("chunks"), run.get("questions"), top_aids=run.o.candidate_top_k, top_chunks=run.o.candidate_top_k, scorer=pair_scorer.scorer(run.get("pair_scorer")) if run.o.rerank_model == TRAINED else models.scorer(run.o.rerank_model))


#: What is judged: a method's table, its score, and which of the table's rows are its own.
METHODS = {
    "bm25": ("merged", "bm25_score", "bm25_rank IS NOT NULL"), "dense": ("merged", "dense_score", "dense_rank IS NOT NULL"),
    "hybrid_fixed": ("hybrid_fixed", "hybrid_score", "true"), "hybrid_tuned": ("hybrid_tuned", "hybrid_score", "true"), "hybrid_router": ("hybrid_router", "hybrid_score", "true"),
    "reranked": ("reranked", "rerank_score_norm", "true"), "reranked_second": ("reranked_second", "second_score_norm", "true"), "reranked_qwen": ("reranked_qwen", "qwen_rerank_score", "true"),
}


def _audit(run: Run) -> DataFrame:
    """(check, failures) over what the run has written; a check of a table that is not there is left out."""
    there = lambda *names: all(run.store.marker(n).get("status") == "done" for n in names)
    read, checks = run.store.read, {}
    if there("splits"):
        asked, parts, marks = read("questions"), read("splits"), read("qrels")
        checks |= {"split_leaks": audit.split_leaks(asked, parts, marks), "split_coverage": splits.coverage(asked, parts)}
        if there("chunks"):
            checks["questions_in_corpus"] = audit.questions_in_corpus(asked, read("chunks"))
        for name in ("mined", "retriever_rows", "reranker_rows", "triplets", "pairs"):
            if there(name) and "qid" in read(name).columns:
                checks[f"{name}_outside_train"] = audit.outside_split(read(name), parts)
    if there("merged"):
        merged = read("merged")
        checks |= {"merged_duplicates": audit.duplicate_keys(merged, "qid", "aid"), "merged_too_many": audit.too_many(merged, 2 * run.o.top_k), "merged_labels": audit.wrong_labels(merged, read("qrels"))}
        checks |= {f"merged_{n}": audit.wrong_norms(merged, n) for n in ("bm25_score_norm", "dense_score_norm")}
    for name in ("hybrid_fixed", "hybrid_tuned", "hybrid_router"):
        if there(name):
            checks |= {f"{name}_formula": audit.wrong_hybrid(read(name)), f"{name}_outside_pool": audit.not_in(read(name), read("merged"), "qid", "aid")}
    if there("retriever_rows"):
        checks |= {"negatives_positive": audit.negatives_that_are_positive(read("retriever_rows"), read("qrels")), "positives_negative": audit.positives_that_are_not(read("retriever_rows"), read("qrels"))}
    if there("router_labels"):
        checks["alpha_convention"] = audit.alpha_convention(read("router_labels"))
    if there("reranked"):
        rows = read("reranked")
        checks |= {"reranked_duplicates": audit.duplicate_keys(rows, "qid", "chunk_id"), "reranked_too_many": audit.too_many(rows, run.o.candidate_top_k), "reranked_texts": audit.empty_texts(rows, "question", "chunk_text"), "reranked_order": audit.wrong_order(rows, "rerank_score"), "reranked_outside_pool": audit.not_in(rows, read("merged"), "qid", "aid")}
    if there("reranked", "reranked_second"):
        checks["second_outside_first"] = audit.not_in(read("reranked_second"), read("reranked"), "qid", "chunk_id")
    if not checks:
        raise ValueError("nothing to audit: run a stage first")
    return audit.failures(checks)


def _metrics(run: Run) -> DataFrame:
    """Every method that there are rows of, judged over the splits that it covers."""
    judged = run.get("splits").where(F.col("split") != "train")
    asked, marks = run.get("questions").join(judged, "qid", "left_semi"), run.get("qrels").join(judged, "qid", "left_semi")
    out = None
    for name, (table, score, rows) in METHODS.items():
        if run.store.marker(table).get("status") == "done":
            part = evaluate.evaluate(run.store.read(table).where(rows), score, asked, marks, judged, name)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to evaluate: run a retrieval stage first")
    return out


#: What a table's parameters stand for that is found in the run, not among its options.
FOUND: dict[str, Callable[[Run], object]] = {"bm25_used": lambda run: list(run.bm25()), "dense_identity": lambda run: run.dense_identity(), "base_identity": lambda run: run.base_identity(), "trained_scorer": lambda run: run.trained_scorer()}
#: How each table is built: from the run, after the tables named, under the options named.
TABLES: dict[str, tuple[Callable[[Run], DataFrame], tuple[str, ...], tuple[str, ...]]] = {
    "articles": (lambda run: corpus.read_articles(run.spark, run.o.corpus_path, run.fields(), run.o.json_lines), (), ("corpus_law_id_field", "corpus_articles_field", "article_id_field", "article_text_field")),
    "questions": (lambda run: _questions(run).select("qid", "question"), (), ("question_id_field", "question_text_field")),
    "qrels": (lambda run: _questions(run).select("qid", F.explode("relevant").alias("aid")).distinct(), (), ("question_id_field", "relevant_ids_field")),
    "chunks": (_chunks, ("articles",), ("max_chunk_tokens", "chunk_overlap_sentences", "max_chunks", "max_chunks_per_article")),
    "leak_report": (lambda run: splits.leak_report(run.get("questions"), run.get("splits"), run.get("qrels")), ("questions", "splits", "qrels"), ()),
    "splits": (_splits, ("questions",), ("train_ratio", "router_train_ratio", "val_ratio", "test_ratio", "seed")),
    "bm25_tuning": (_tuning, ("articles", "questions", "qrels", "splits"), ("bm25_k1_grid", "bm25_b_grid")),
    "positive_chunks": (_positive, ("questions", "qrels", "chunks", "splits"), ("positive_chunks_per_aid", "base_identity")),
    "mined": (_mined, ("questions", "qrels", "chunks", "splits"), ("top_k", "base_identity")),
    "retriever_rows": (_ready(negatives.RETRIEVER_POLICY), ("positive_chunks", "mined", "chunks", "questions"), ("seed",)),
    "reranker_rows": (_ready(negatives.RERANKER_POLICY), ("positive_chunks", "mined", "chunks", "questions"), ("seed",)),
    "triplets": (lambda run: negatives.triplets(run.get("retriever_rows")), ("retriever_rows",), ()),
    "pairs": (lambda run: negatives.pairwise(run.get("reranker_rows")), ("reranker_rows",), ()),
    "retriever": (lambda run: retriever.train(run.get("triplets"), run.encode), ("triplets",), ("dense_model",)),
    "pair_scorer": (lambda run: pair_scorer.train(run.get("pairs")), ("pairs",), ()),
    "prompts": (lambda run: negatives.prompts(run.get("reranker_rows")), ("reranker_rows",), ()),
    "merged": (_merged, ("questions", "articles", "chunks", "qrels"), ("top_k", "bm25_k1", "bm25_b", "use_tuned_bm25", "bm25_used", "dense_identity")),
    "hybrid_tuning": (lambda run: evaluate.tune_hybrid(run.of(run.get("merged"), "val"), run.of(run.get("questions"), "val"), run.of(run.get("qrels"), "val"), list(run.o.alpha_grid)), ("merged", "questions", "qrels", "splits"), ("alpha_grid",)),
    "hybrid_tuned": (_tuned, ("merged", "splits", "hybrid_tuning"), ("hybrid_alpha",)),
    "router_weights": (lambda run: run.router().weights, ("merged", "questions", "qrels", "splits"), ("hybrid_alpha",)),
    "router_labels": (lambda run: run.router().labels, ("merged", "questions", "qrels", "splits"), ("hybrid_alpha",)),
    "router_alphas": (lambda run: run.router().alphas, ("merged", "questions", "qrels", "splits"), ("hybrid_alpha",)),
    "hybrid_fixed": (lambda run: fusion.apply_hybrid(run.of(run.get("merged"), "router", "val", "test"), fixed=run.o.hybrid_alpha), ("merged", "splits"), ("hybrid_alpha",)),
    "hybrid_router": (lambda run: fusion.apply_hybrid(run.of(run.get("merged"), "router", "val", "test"), run.get("router_alphas"), run.o.hybrid_alpha), ("merged", "router_alphas", "splits"), ("hybrid_alpha",)),
    "router_metrics": (lambda run: run.router().diagnostics, ("merged", "questions", "qrels", "splits"), ("hybrid_alpha",)),
    "reranked": (_reranked, ("hybrid_router", "chunks", "questions"), ("candidate_top_k", "rerank_model", "trained_scorer")),
    "reranked_second": (lambda run: rerank.second_stage(run.get("reranked"), run.o.llm_rerank_top_k), ("reranked",), ("llm_rerank_top_k",)),
    "reranked_qwen": (lambda run: rerank.by_hash(run.get("reranked"), run.o.candidate_top_k), ("reranked",), ("candidate_top_k", "qwen_model")),
    "audit": (_audit, (), ()),
    "metrics": (_metrics, ("questions", "qrels", "splits"), ("use_llm_rerank", "use_qwen_rerank")),
}
