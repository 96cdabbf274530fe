"""Options of a run from the command line."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, dataclass, fields

#: Words that stand for true and false (fixed values).
TRUE, FALSE = {"true", "1", "yes", "y"}, {"false", "0", "no", "n"}


def boolean(word: str) -> bool:
    if (w := word.strip().lower()) not in TRUE | FALSE:
        raise argparse.ArgumentTypeError(f"neither true nor false: {word!r}")
    return w in TRUE


def numbers(listed: str) -> tuple[float, ...]:
    """A comma-separated grid; empty parts are skipped, an empty grid raises."""
    found = tuple(float(x) for x in listed.split(",") if x.strip())
    if not found:
        raise argparse.ArgumentTypeError("a grid needs a number")
    return found


@dataclass(frozen=True)
class Options:
    """Names and defaults of the flags (fixed values). Those of model training on GPUs are left out, and models default to
    what needs none: names of models.ENCODERS and models.SCORERS, where loaders of others can be added."""

    stage: str
    dataset_name: str
    corpus_path: str
    questions_path: str
    output_dir: str = "outputs"
    force: bool = False
    seed: int = 42
    dense_model: str = "hash"
    rerank_model: str = "hash"
    qwen_model: str = "hash"
    use_qwen_rerank: bool = False
    use_llm_rerank: bool = False
    llm_rerank_top_k: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.9
    bm25_k1_grid: tuple[float, ...] = (1.2,)
    bm25_b_grid: tuple[float, ...] = (0.9,)
    use_tuned_bm25: bool = True
    hybrid_alpha: float = 0.5
    alpha_grid: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
    top_k: int = 200
    candidate_top_k: int = 50
    positive_chunks_per_aid: int = 2
    train_ratio: float = 0.7
    router_train_ratio: float = 0.1
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    max_chunk_tokens: int = 512
    chunk_overlap_sentences: int = 1
    max_chunks: int = 0
    max_chunks_per_article: int = 0
    json_lines: bool = False
    corpus_law_id_field: str = "law_id"
    corpus_articles_field: str = "content"
    article_id_field: str = "aid"
    article_text_field: str = "content_Article"
    question_id_field: str = "qid"
    question_text_field: str = "question"
    relevant_ids_field: str = "relevant_laws"

    def __post_init__(self):
        if abs(sum(self.ratios.values()) - 1) > 1e-6:
            raise ValueError("the splits' ratios must sum to 1")

    @property
    def ratios(self) -> dict[str, float]:
        return {"train": self.train_ratio, "router": self.router_train_ratio, "val": self.val_ratio, "test": self.test_ratio}


def parse(arguments: list[str] | None = None) -> Options:
    """Options from flags named like the fields."""
    kinds = {"bool": boolean, "int": int, "float": float, "tuple[float, ...]": numbers, "str": str}
    parser = argparse.ArgumentParser(prog="quarryline", description="Stages of a retrieval run over a corpus and its questions.")
    for f in fields(Options):
        needed = f.default is MISSING
        parser.add_argument(f"--{f.name}", type=kinds[f.type], required=needed, **({} if needed else {"default": f.default}))
    return Options(**vars(parser.parse_args(arguments)))
