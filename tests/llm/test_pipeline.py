"""The pipeline stage by stage against brute force, on a small corpus with planted cases."""

import re

import numpy as np
import pytest

import corpus_pipeline as pipe
from tests.llm.test_llm_small import brute_contamination, brute_lines, brute_links, words

GOOD, BAD = ["tha", "ere", "ing", "on", "wh", "ed"], ["#", "$x", "zq", "%%"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    text = lambda parts, n: " ".join("".join(rng.choice(parts, 3)) for _ in range(n))
    rows = [(i, "\n".join(text(GOOD, 25) + "." for _ in range(3)) if i % 4 else text(BAD, 60)) for i in range(160)]
    item = text(GOOD, 30)
    rows += [(200, text(GOOD, 40) + " " + item), (201, rows[1][1]), (202, text(GOOD, 20) + "\n" + rows[2][1].split("\n")[0])]
    base = text(GOOD, 120).split()
    for k in range(6):
        near = list(base)
        near[17 * k + 3] = f"edit{k}"
        rows.append((210 + k, "\n".join(" ".join(near[j : j + 2]) for j in range(0, 120, 2)) if k < 2 else " ".join(near)))
    rows += [(300, None), (301, ""), (302, "short")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def test_stages(spark, tables, tmp_path):
    d, rows, item = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    found = {}
    for k, (name, stage) in enumerate(pipe.STAGES):
        made = stage(spark, docs, d)
        assert name == pipe.STAGES[-1][0] or made.columns == columns
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        found[k] = [(r.doc_id, r.text) for r in docs.collect()]
    good = {i for i, t in rows if t and len(t.split()) >= 10 and not re.search(r"[#$%]|zq", t)}
    assert {i for i, _ in found[0]} == good

    gone = brute_lines(found[0])
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in found[0]}
    assert dict(found[1]) == {i: t for i, t in want.items() if words(t)}

    classes = {c for _, c, _ in brute_links(found[1])}
    assert {i for i, _ in found[2]} == classes and len(found[2]) == len(classes)

    hit = {i for i, _, n, _ in brute_contamination(found[2], [(1, item)]) if n}
    assert hit and {i for i, _ in found[3]} == {i for i, _ in found[2]} - hit

    size = sum(len(t.split()) for _, t in found[3])
    assert abs(sum(len(t.split()) for _, t in found[4]) - 1.5 * size) < 200 and {i for i, _ in found[4]} <= {i for i, _ in found[3]}


def test_run_returns_the_last_stage(spark, tables):
    out = pipe.run(spark, tables[0])
    assert "copy" in out.columns and out.count() > 0
