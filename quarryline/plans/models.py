"""Models by name: how a run encodes texts and scores pairs. An unknown name raises before anything is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quarryline.operators import dense, rerank

#: (df, key, text) to (key, embedding). dense.encode() makes one of a loader.
ENCODERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"hash": dense.hash_vectors}
#: Rows with question and chunk_text to rows with rerank_score too. rerank.model_scores() makes one of a loader.
SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hash": rerank.hash_scores}


def named(known: dict, name: str, what: str):
    if name not in known:
        raise ValueError(f"no {what} named {name!r}: known are {', '.join(sorted(known))}")
    return known[name]


def encoder(name: str) -> Callable[[DataFrame, str, str], DataFrame]:
    return named(ENCODERS, name, "encoder")


def scorer(name: str) -> Callable[[DataFrame], DataFrame]:
    return named(SCORERS, name, "scorer")
