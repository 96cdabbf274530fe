"""The jobs: growing input, lost commits, reruns, odd rows, the command line."""

import json
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import clean_corpus, index_feed, queries
from jobs.settings import read_config, settings
from quarryline.operators import lexical

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def add(spark, folder, rows, name):
    """A file that arrives in folder; files are read from older to newer."""
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{folder}-staged-{name}")
    for f in Path(f"{folder}-staged-{name}").glob("part-*.parquet"):
        Path(folder).mkdir(exist_ok=True)
        shutil.copy(f, f"{folder}/{name}.parquet")


def state(spark, at):
    articles, posts = index_feed.current(spark, at)
    return {tuple(r) for r in articles.collect()}, Counter(tuple(r) for r in posts.select("aid", "term", "tf", "dl").collect())


def expected(spark, rows):
    """The index of the latest version of each article, made at once."""
    df = spark.createDataFrame([(i, s, t or "") for i, (t, s) in rows.items()], "aid long, law_id string, text string")
    posts = Counter(tuple(r) for r in lexical.postings(df).select("aid", "term", "tf", "dl").collect())
    return {tuple(r) for r in lexical.entries(df, "law_id").select("aid", "law_id", "dl").collect()}, posts


def test_feed_over_growing_input(spark, tmp_path):
    at = index_feed.Settings(str(tmp_path / "in"), str(tmp_path / "out"), buckets=3)
    Path(at.source).mkdir()
    assert index_feed.run(spark, at) == {"batches": 0, "rows": 0} and state(spark, at) == (set(), Counter())
    add(spark, at.source, [(1, "the law of the sea", "en", "a"), (2, "An old text", "en", "b"), (3, None, None, None), (None, "no id", "en", "a"), (4, "twice", "en", "a"), (4, "twice more", "en", "a")], "one")
    assert index_feed.run(spark, at) == {"batches": 1, "rows": 6}
    first = {1: ("the law of the sea", "a"), 2: ("An old text", "b"), 3: (None, None), 4: ("twice more", "a")}
    assert state(spark, at) == expected(spark, first)
    # New articles, a changed one, one that loses its text.
    add(spark, at.source, [(2, "A new text, and a longer one", "en", "c"), (4, "", "en", "a"), (5, "five five five", "en", "a")], "two")
    assert index_feed.run(spark, at) == {"batches": 1, "rows": 3}
    grown = first | {2: ("A new text, and a longer one", "c"), 4: ("", "a"), 5: ("five five five", "a")}
    assert state(spark, at) == expected(spark, grown)
    files = sorted(str(p) for p in Path(at.out).rglob("*.parquet"))
    assert index_feed.run(spark, at) == {"batches": 0, "rows": 0}  # nothing new: nothing is written
    assert sorted(str(p) for p in Path(at.out).rglob("*.parquet")) == files


def test_feed_after_a_lost_commit(spark, tmp_path):
    at = index_feed.Settings(str(tmp_path / "in"), str(tmp_path / "out"), files_a_batch=1)
    rows = {i: (f"word{i % 3} and word{i}", "a") for i in range(6)}
    for i in range(3):
        add(spark, at.source, [(k, rows[k][0], "en", "a") for k in (2 * i, 2 * i + 1)], f"f{i}")
    assert index_feed.run(spark, at)["batches"] == 3
    want = state(spark, at)
    assert want == expected(spark, rows)
    # The last batch was written, but the driver ended before it said so.
    commits = sorted((tmp_path / "out" / "_checkpoint" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert index_feed.run(spark, at)["batches"] == 1 and state(spark, at) == want


def test_clean_corpus_by_hand_and_again(spark, tmp_path):
    docs = [
        (1, "An article about the sea.", "EN", "a"), (2, "An article about the sea.", "en", "b"), (3, None, "de", None), (4, "...", "de", "a"),
        (5, "Before it: what is the shortest way from one town to the next one? After it.", "not a language", "a"), (6, "Fine text", None, "a"), (None, "no id", "en", "a"), (6, "Fine text", None, "a"),
    ]
    asked = [(10, "what is the shortest way from one town to the next one?"), (None, "Fine"), (11, "a question that is nowhere")]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    at = clean_corpus.Settings(str(tmp_path / "docs"), str(tmp_path / "asked"), str(tmp_path / "out"), train=0.0, router=0.0, val=0.5, test=0.5)
    for _ in range(2):
        assert clean_corpus.run(spark, at) == {"kept": 3, "duplicate": 1, "empty": 2, "held_out": 1}
        got = Counter((r["aid"], r["outcome"], r["language"], r["words"], r["lang"]) for r in clean_corpus.read(spark, at).collect())
        assert got == {(1, "kept", "en", 5, "EN"): 1, (2, "duplicate", "en", 5, "en"): 1, (3, "empty", "de", 0, "de"): 1, (4, "empty", "de", 1, "de"): 1, (5, "held_out", "other", 16, "not a language"): 1, (6, "kept", "other", 2, None): 2}
    assert {(r["outcome"], r["language"]): (r["articles"], r["words"]) for r in clean_corpus.report(spark, at).collect()}[("kept", "other")] == (2, 4)
    # Other held-out splits, over what was there.
    from dataclasses import replace

    assert clean_corpus.run(spark, replace(at, held_out="train")) == {"kept": 4, "duplicate": 1, "empty": 2}
    with pytest.raises(ValueError, match="unknown splits"):
        clean_corpus.run(spark, replace(at, held_out="vall"))


def test_clean_corpus_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    at = clean_corpus.Settings(str(tmp_path / "docs"), str(tmp_path / "asked"), str(tmp_path / "out"))
    assert clean_corpus.run(spark, at) == {} and clean_corpus.read(spark, at).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_jobs_match_their_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    at = [c[0] for c in found.description]
    assert Counter(tuple(map(str, r)) for r in df.select(*cols).collect()) == Counter(tuple(str(r[at.index(c)]) for c in cols) for r in found.fetchall())


def test_two_query_runs_do_not_meet(spark):
    assert queries.folder(spark, "job1") != queries.folder(spark, "job1")


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"source": "s", "out": "o", "buckets": 5}))
    config = read_config(spark, str(tmp_path / "c.json"))
    assert settings(index_feed.Settings, config, {"out": "p", "source": None}) == index_feed.Settings("s", "p", buckets=5)
    with pytest.raises(ValueError, match="unknown settings: bucket"):
        settings(index_feed.Settings, {"source": "s", "out": "o", "bucket": 5}, {})


def test_command_line(spark, tmp_path):
    """Its own session, which it stops; the rows of the function."""
    spark.read.parquet(f"{SF}/documents.parquet").limit(20).write.parquet(str(tmp_path / "docs"))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.index_feed", "--config", str(ROOT / "jobs/index_feed.json"), "--source", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--buckets", "2"],
        cwd=ROOT, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 20 rows in 1 batches" in done.stderr
    at = index_feed.Settings(str(tmp_path / "docs"), str(tmp_path / "out"))
    assert state(spark, at)[0] == {tuple(r) for r in lexical.entries(spark.read.parquet(at.source).select(F.col("doc_id").alias("aid"), F.col("source").alias("law_id"), "text"), "law_id").select("aid", "law_id", "dl").collect()}
