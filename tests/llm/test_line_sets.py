"""The native join of line sets against brute force."""

import numpy as np
import pytest

from spanloom.llm import line_sets
from spanloom.llm.line_dedup import dedup_lines
from spanloom.llm.line_sets import similar_lines

from .test_llm_small import brute_lines, corpus, docs, words


def sets_of(percent, seed=5, n=70):
    """Lines of 1 to 260 words and variants that lack some words and have others more, near the limit."""
    rng = np.random.default_rng(seed)
    pool = np.array([f"{'v' * int(k % 9)}{k}" for k in range(3000)])
    out = []
    for k in range(n):
        a = rng.choice(pool, int(rng.integers(1, 260 if k % 7 == 0 else 40)), replace=False)
        c = max(1, min(len(a), -(-len(a) * percent // 100) + int(rng.integers(-1, 3))))
        more = int(rng.integers(0, max(0, c * 100 // percent - len(a)) + 2))
        b = np.r_[a[:c], rng.choice(pool, more, replace=False)]
        out += [" ".join(rng.permutation(a)), " ".join(rng.permutation(b)).upper()]
    return out


@pytest.mark.parametrize("percent", [100, 80, 50, 35])
def test_similar_lines_against_brute_force(spark, percent):
    lines = sets_of(percent)
    per = 4
    rows = [(k, "\n".join(lines[k * per : (k + 1) * per])) for k in range(len(lines) // per)]
    got = {(r.doc, r.line) for r in similar_lines(spark.createDataFrame(rows, "doc bigint, t string"), percent).collect()}
    sets = [frozenset(words(x)) for x in lines]
    want = {(j // per, j % per) for j, w in enumerate(sets) if any(len(w & v) * 100 >= percent * len(w | v) for v in sets[:j])}
    assert got == want and 10 < len(want) < len(lines)


def test_line_dedup_runs_no_python_on_the_executors(spark, monkeypatch, capsys):
    plans, tables = [], line_sets.materialize

    def told(df, label="t"):
        df.explain()
        plans.append(capsys.readouterr().out)
        return tables(df, label)

    monkeypatch.setattr(line_sets, "materialize", told)
    monkeypatch.setattr("spanloom.llm.line_dedup.materialize", told)
    rows = corpus(9, 30)
    got = {r.doc_id: list(r.removed_lines) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert len(plans) > 5 and not [p for p in plans if "Python" in p or "Arrow" in p or "InPandas" in p]


def test_near_copies_meet_the_first_line_only(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"word{k}" for k in range(40)]
    rows = []
    for k in range(300):
        line = list(base)
        for at in rng.choice(40, 2, replace=False):
            line[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(line)))
    met, check = [], line_sets.verified
    monkeypatch.setattr(line_sets, "verified", lambda t, pairs, percent: met.append(pairs.count()) or check(t, pairs, percent))
    gone = similar_lines(spark.createDataFrame(rows, "doc bigint, t string"), 80)
    assert gone.distinct().count() == 299 and met[1] == 0 and met[0] < 10 * 300 < 300 * 299 / 2
