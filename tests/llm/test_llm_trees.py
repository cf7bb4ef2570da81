"""Merkle manifest, subword quality and conversation repair against brute force, with odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import retained, subword, vectext
from spanloom.llm.merkle import folded_root, merkle_manifest
from spanloom.llm.queries import QUERIES
from spanloom.llm.repair import conversation_hashes, damage, repair_conversations
from spanloom.llm.words import lower_ascii

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
HEAD = ("doc_id", "source", "lang", "n_chars")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 ------------------------------------------------------------------------------


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        first = i // 8 * 8
        run = level[first : first + 8]
        yield run[: i - first], run[i - first + 1 :]
        i //= 8


def manifest_by_hand(rows, tamper):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {k: levels([leaf(r, r[1]) for r in groups[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            path = [*siblings(trees[k], i), *siblings(top, j)]
            folded = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if tamper(r) and r[1] is not None else r[1])
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], sha("".join(h for p in path for side in p for h in side)), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def third(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0


def manifest(docs, **more):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    head = [F.col(c) for c in HEAD]
    return merkle_manifest(docs, [*head, F.col("text")], claim=[*head, F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))], **more)


COLUMNS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("many", [1, 9, 150])
def test_manifest_against_brute_force(spark, many):
    rows = [(i, f"Text {i} Ünï\x00", "en", "s", i) for i in range(many)]
    if many > 1:
        # Nulls in any column, ties of id, repeated rows, groups of one and of eight, names that sort by bytes, an empty and a long text.
        rows += [(None, None, None, None, None), (3, "Other", "en", None, None), (3, "Other", "en", None, None), (4, "", "ß", "s", 0), (5, "A" * 300_000, "z", "s", 0), (6, "B", "Z", "s", 1), (7, "c", "", "s", 1)]
        rows += [(100 + i, f"De {i}", "de", "s", i) for i in range(8)] + [(200 + i, f"X{i}", f"l{i}", "s", 0) for i in range(9)]
    got = manifest(spark.createDataFrame(rows, DOCS).repartition(3), paths=False)
    assert sorted(str(tuple(r)) for r in got.select(COLUMNS).collect()) == manifest_by_hand(rows, third)


def test_stored_paths_lead_to_the_root(spark):
    rows = [(i, f"Text {i}", ("en", "de")[i % 3 == 0], "s", i) for i in range(90)]
    made = merkle_manifest(spark.createDataFrame(rows, DOCS), [F.col("doc_id"), F.col("text")])
    found = made.select("root", "verified", folded_root(F.col("leaf"), F.col("path")).alias("own"), folded_root(F.sha2(F.lit("x"), 256), F.col("path")).alias("other")).collect()
    assert len(found) == 90 and all(r.own == r.root and r.verified and r.other != r.root for r in found)


def test_manifest_of_odd_tables(spark):
    assert manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "Same", "en", "s", 4)] * 200  # one row over and over
    extra = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 id", "2 leaf", "3 pos", "4 row", "5 g", "6 `of`", "7 claim")
    assert sorted(str(tuple(r)) for r in manifest(extra).select(COLUMNS).collect()) == manifest_by_hand(rows, third)


# 12 ------------------------------------------------------------------------------


def cells_of(text):
    """(kind, n-gram) of each occurrence of a feature."""
    out = [("end", "")]
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out += [("word", x) for x in w]
    out += [("pair", (a, b) if a != b else "same") for a, b in zip(w, w[1:])]
    c = re.sub(r"[\x20\x09-\x0D]+", " ", text)
    for n in subword.CHARS:
        out += [("chars", c[i : i + n]) for i in range(len(c) - n + 1) if " " not in c[i + 1 : i + n - 1]]
    return out


def test_features_against_brute_force():
    texts = ["", " ", "a", "ab cd", "ab  ab\n\tab cd", "Ünï 日本語 x", "the the the", "  lead and trail  ", "𝄞𝄞 a b"]
    data, offsets = vectext.buffers(pa.array(texts))
    got, kinds = [dict() for _ in texts], [{} for _ in texts]
    for k, (cell, row) in enumerate(subword.features(data, offsets)):
        for c, r in zip(cell.tolist(), row.tolist(), strict=True):
            got[r].setdefault(k, []).append(c)
    names = {}
    for i, t in enumerate(texts):
        for kind, gram in cells_of(t):
            kinds[i].setdefault((kind, len(gram) if kind == "chars" else 0), []).append(gram)
        for k, key in enumerate([("end", 0), ("word", 0), ("pair", 0), *(("chars", n) for n in subword.CHARS)]):
            assert len(got[i].get(k, [])) == len(kinds[i].get(key, [])), (t, key)
            for cell, gram in zip(got[i].get(k, []), kinds[i].get(key, []), strict=True):
                assert names.setdefault((key, gram), cell) == cell, (t, gram)
    assert len(set(names.values())) > 0.9 * len(names)


def test_scores_are_the_softmax_of_the_mean_vector():
    vectors, outputs, squares = subword._begin()
    texts = ["good words here", "bad!! bad!!", "", "more of the good words"]
    data, offsets = vectext.buffers(pa.array(texts))
    row, cell, share = subword.counted(data, offsets)
    for _ in range(30):
        for i, label in enumerate((1, 0, 0, 1)):
            subword.descend(vectors, outputs, squares, cell[row == i], share[row == i].astype(np.float32), label, 1.0, 0.25)
    lead = outputs[1] - outputs[0]
    got = subword.scores(data, offsets, subword.Model((vectors @ lead[:-1]).astype(np.float32), float(lead[-1])))
    for i in range(4):
        z = outputs @ np.append(share[row == i] @ vectors[cell[row == i]], 1)
        assert abs(got[i] - np.exp(z[1]) / np.exp(z).sum()) < 1e-4
    assert [round(float(x)) for x in got] == [1, 0, 0, 1]


def test_quality_of_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    got = QUERIES["op12_subword_quality"](spark, base)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{base}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, f"plain words of text {i}" if i % 2 else f"JUNK!! !!{i} JUNK!!", "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    flipped = labels.withColumn("quality", F.when(subword.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (subword.train(docs, x) for x in (labels, flipped))
    assert one.bias == two.bias and (one.cells == two.cells).all()
    got = subword.score_quality(docs, one).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)


def test_quality_of_odd_tables(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 300_000, "en", "s", 0), (3, "same", "en", "s", 0), (3, "same", "en", "s", 0), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(odd, DOCS).selectExpr("*", "1 y", "2 shard", "3 `order`", "4 score", "5 id")
    for labels, want in (([], 0.5), ([(1, 1), (3, 1), (None, 0), (4, None)], None), ([(1, 0), (3, 1), (3, 1), (2, 1), (9, 0), (4, 0)], None)):
        model = subword.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        got = subword.score_quality(docs, model).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 3}) == 1 and len({r.score for r in got if not r.text}) == 1
        assert want is None or {r.score for r in got} == {want}
    assert subword.score_quality(docs.limit(0), model).count() == 0 and subword.train(docs.limit(0), spark.createDataFrame([(1, 0), (3, 1)], "doc_id bigint, quality int")).cells.max() == 0


# 13 ------------------------------------------------------------------------------


def cheapest(turns):
    """(cost, audit) of the cheapest repair by trying every edit from every state, and the repaired turns; ``turns`` are (role, text, fault)."""
    now = {"": (0, "", ())}  # by the initials' last state: "", s, u, a

    def better(options):
        return min(options, key=lambda o: (o[0], o[1]))

    def step(state, initial):
        return initial if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

    def inserted(states):
        out = {k: [v] for k, v in states.items()}
        for k, (c, e, o) in states.items():
            for more in (1, 2):
                state, said, cost = k, o, c
                for _ in range(more):
                    state = "a" if state == "u" else "u"
                    said, cost = (*said, ({"u": "user", "a": "assistant"}[state], "")), cost + 2
                out.setdefault(state, []).append((cost, e + "I" * more, said))
        return {k: better(v) for k, v in out.items()}

    for role, text, fault in turns:
        found = {}
        for state, (c, e, o) in inserted(now).items():
            found.setdefault(state, []).append((c + 3, e + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            more = 1 if fault == "truncated" else 0
            for edit, as_role, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                to = step(state, as_role[:1])
                if to:
                    found.setdefault(to, []).append((c + price + more, e + edit, (*o, (as_role, text))))
        now = {k: better(v) for k, v in found.items()}
    return better([v for k, v in inserted(now).items() if k in ("", "a")])


def faults(turns):
    seen = set()
    for role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        yield role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))


def repaired_by_hand(rows):
    """By conversation: the columns of the report, and the hash."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = {t[0] for t in turns if t[0] is not None}
        found = list(faults([t[1:] for t in turns]))
        number = [sum(f == k for _, _, f in found) for k in ("blank", "duplicate", "truncated")]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, said = cheapest(found)
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *number, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in said)))
    return out


def repaired(turns, **more):
    report, said = repair_conversations(turns, **more)
    sums = {r.conv: r.repaired_sha256 for r in conversation_hashes(said).collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sums.get(r.conv, sha(""))) for r in report.collect()}


TURNS = "conv_id bigint, turn bigint, role string, text string"


def dialogues(seed, n=60, longest=14):
    rng = np.random.default_rng(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User"], ["Fine.", "What?", "cut", "", " \n", None, "Ünï! ", "Go on.\n", "x"]
    for conv in range(n):
        turn = 0
        for _ in range(int(rng.integers(1, longest))):
            turn += int(rng.choice([1, 1, 1, 0, 2]))
            role = roles[int(rng.choice(7, p=[0.1, 0.33, 0.33, 0.1, 0.05, 0.04, 0.05]))] if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            yield (None if conv == 7 else conv, None if rng.random() < 0.05 else turn, role, texts[int(rng.integers(0, 9))] if rng.random() < 0.4 else f"Turn {turn}.")


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair_against_brute_force(spark, block):
    rows = list(dialogues(block))
    want = repaired_by_hand(rows)
    got = repaired(spark.createDataFrame(rows, TURNS).repartition(3), block_turns=block)
    assert got == want and len({w[6] for w in want.values()}) > 30


def test_programme_against_brute_force():
    rng = np.random.default_rng(5)
    names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    for _ in range(1500):
        codes = [int(rng.integers(0, 4)) + int(rng.choice([0, 0, 4, 8])) for _ in range(int(rng.integers(0, 9)))]
        turns = [(names[c & 3], str(i), "blank" if c & 4 else "truncated" if c & 8 else None) for i, c in enumerate(codes)]
        costs = retained.suffix_costs(codes, retained.END)
        audit, state = retained.decode(codes, costs, 0)
        assert (costs[0][0], audit + "I" * len(retained.AFTER[state])) == cheapest(turns)[:2], codes


def test_damage(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "Well. So?") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = space(role), space(text)
        if kind:
            want += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in damage(spark.createDataFrame(rows, TURNS)).collect()))) == sorted(map(str, want))


def test_repair_of_odd_tables(spark):
    report, said = repair_conversations(spark.createDataFrame([], TURNS))
    assert report.count() == 0 and conversation_hashes(said).count() == 0
    rows = [(1, 0, "user", "A" * 200_000), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (2, None, None, None), (None, 3, "system", "Be kind.")]
    extra = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 conv", "2 g", "3 pos", "4 fault", "5 row", "6 `first`", "7 n")
    assert repaired(extra) == repaired_by_hand(rows)
    # Every original conversation is there, those that the damage left nothing of too.
    assert {r.conv_id for r in QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001").collect()} == {r.conv_id for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}


def test_repaired_turns_have_their_texts(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "tool", "out."), (1, 2, "user", ""), (1, 3, "user", "More?")]
    _, said = repair_conversations(spark.createDataFrame(rows, TURNS))
    got = [(r.edit, r.role, r.text) for r in said.orderBy("place", "part").collect()]
    assert got == [("I", "user", ""), ("K", "assistant", "Hello."), ("R", "user", "out."), ("R", "assistant", "More?")]
