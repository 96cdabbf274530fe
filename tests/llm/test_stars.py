import numpy as np

from quarryline.llm import ngram_join


def test_a_member_meets_one_pivot_a_round(spark):
    """A group whose members meet many pivots gives a pair a member, with the pivot of most shared blocks."""
    rows = [(p, 100 + m) for m in range(50) for p in range(20) for _ in range(3 if p == m % 20 else 1)]
    found = ngram_join.star_pairs(spark.createDataFrame(rows, "a long, b long")).collect()
    assert sorted((r["b"], r["a"]) for r in found) == [(100 + m, m % 20) for m in range(50)]


def test_a_linked_group_verifies_no_square_of_pairs(spark, monkeypatch):
    """Members of a near-copy group that no star has joined: the likeliest partners are verified, then what their links leave."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    tried, verify = [], ngram_join.verify

    def counted(pairs, *args, **kwargs):
        tried.append(pairs.count())
        return verify(pairs, *args, **kwargs)

    monkeypatch.setattr(ngram_join, "verify", counted)
    words = [f"w{i}" for i in range(120)]
    docs = [(n, " ".join([*words[:n], f"odd{n}", *words[n + 1 :]])) for n in range(110)]
    found = ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(tried) < 1500  # of 5,995 pairs


def test_rows_that_fit_no_other_leave_their_block(spark):
    """Sizes 100 and 79 fit no other, 80 and 100 do; a block of one row goes, one over BLOCK rows stays whole."""
    rows = [(1, 1, 100), (1, 2, 79), (2, 3, 100), (2, 4, 80), (2, 5, 30), (3, 6, 50), (4, 7, 10), (4, 8, 10)]
    found = ngram_join.fitting_blocks(spark.createDataFrame(rows, "key long, rep long, n long")).collect()
    assert sorted((r["key"], r["rep"], r["m"]) for r in found) == [(2, 3, 3), (2, 4, 3), (4, 7, 2), (4, 8, 2)]
    wide = spark.range(ngram_join.BLOCK + 1).selectExpr("0L AS key", "id AS rep", "CAST(POWER(2, id % 40) AS LONG) AS n")
    assert ngram_join.fitting_blocks(wide).count() == ngram_join.BLOCK + 1


def _rows_of_blocks(cuts, seed=3):
    rng = np.random.default_rng(seed)
    n = cuts[-1]
    base = rng.integers(0, 3, (8, ngram_join.GROUPS))
    points = (base[rng.integers(0, 8, n)] + (rng.random((n, ngram_join.GROUPS)) < 0.02)).astype(np.uint8)
    sizes = points.sum(axis=1, dtype=np.int64)
    keys = np.repeat(np.arange(len(cuts) - 1) + 10, np.diff(cuts))
    low = np.stack([np.where(rng.random(n) < 0.3, rng.integers(0, 20, n), keys) for _ in range(ngram_join.LEAST_KEYS)], axis=1)
    return rng.integers(0, 6, n), sizes, points, rng.integers(0, 2, n), keys, low


def _all_pairs(lo, hi, comps, sizes, points, side, keys, low):
    """Every pair of a block, one by one."""
    out = set()
    two = len(set(side[lo:hi])) == 2
    for i in range(lo, hi):
        for j in range(i + 1, hi):
            bound, fits = int(np.minimum(points[i], points[j]).sum()), 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])
            before = any(x < keys[i] and x in low[j] for x in low[i])
            if comps[i] != comps[j] and fits and not before and bound >= ngram_join.needed_overlap(sizes[i], sizes[j]) and (not two or side[i] != side[j]):
                out.add((i, j))
    return out


def test_small_blocks_are_searched_together(spark):
    """A thousand blocks ask for points once, and for those alone whose pairs other tests leave; pairs are those found one by one."""
    cuts = np.concatenate([[0], np.cumsum(np.random.default_rng(1).integers(1, ngram_join.FANOUT + 1, 1000))])
    comps, sizes, points, side, keys, low = _rows_of_blocks(cuts)
    asked = []
    found = ngram_join.node_pairs((cuts[:-1], cuts[1:]), comps, sizes, lambda at: asked.append(at) or points[at], side, keys, low)
    wanted = set().union(*(_all_pairs(lo, hi, comps, sizes, points, side, keys, low) for lo, hi in zip(cuts, cuts[1:])))
    assert {tuple(sorted(x)) for x in zip(*(f.tolist() for f in found))} == wanted and len(wanted) > 100
    assert len(asked) == 1 and len(asked[0]) < cuts[-1]
    best = ngram_join.node_pairs((cuts[:-1], cuts[1:]), comps, sizes, lambda at: points[at], side, keys, low, likeliest=True)
    assert sorted(best[1]) == sorted(set(found[1].tolist()))


def test_a_large_block_goes_down_the_tree_together(monkeypatch):
    """Pairs of a block of many nodes are those found one by one, with one side and with two, in portions too."""
    for portion in (1 << 18, 700):
        monkeypatch.setattr(ngram_join, "SEARCHED", portion)
        for sides in (1, 2):
            comps, sizes, points, side, keys, low = _rows_of_blocks(np.array([0, 150]), sides)
            side = side if sides == 2 else side * 0
            found = ngram_join.block_pairs(comps, sizes, points, side, key=10, low=low)
            wanted = _all_pairs(0, 150, comps, sizes, points, side, keys, low)
            assert {tuple(sorted(x)) for x in zip(*(f.tolist() for f in found))} == wanted and len(wanted) > 20
    of, at, bound = ngram_join.CountTree(points, sizes).search(points, sizes)
    assert (of == at).sum() == 150 and (bound[of == at] == sizes).all()
