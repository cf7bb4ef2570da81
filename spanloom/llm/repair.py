"""Repair of the structure of conversations: an optional system turn, then user and assistant in turn.

Turns get their place in their conversation from a sort by ranges, and faults
by joins.  The cheapest edits come from the retained-subsequence programme of
``retained`` over blocks of turns: of a conversation of more than one block,
each block first gives its prices from state to state, which are chained from
the last block to the first, then each block is decoded by itself from each
state, and the states are chained forward.  Prices are small integers, and no
task sees the turns of a long conversation but as so many bytes a turn, or in
a stream (the hash of a repaired conversation can only be taken in order).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_positions
from ..scratch import materialize, small_side
from .retained import AFTER, MUST_GO, TRUNCATED, decode, ends_of, matrix, outputs, suffix_costs

#: Turns that are priced and decoded together.
BLOCK_TURNS = 4096
#: Fixed names of the roles that a turn can be given.
ROLES = {"u": "user", "a": "assistant"}
_SOLID = r"[^\x20\x09-\x0D]"


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with one in four damaged in a way that its key decides.

    By CRC-32 of ``conv_id:turn`` modulo 20 a row goes (0), loses its text (1)
    or its ``.!?`` (2), is there twice (3) or becomes the user's (4).  Null
    values count as one space; rows that repeat are damaged alike.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(plain("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return turns.withColumn("kind", kind).where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Turns with pos (in all), and fault: 1 blank, 2 role and text seen earlier, 3 cut short, 0 none."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    ranked, _ = global_positions(turns, order)
    blank = ~F.col("text").rlike(_SOLID)
    last = F.regexp_extract("text", rf"({_SOLID})[\x20\x09-\x0D]*\z", 1)
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ranked = materialize(ranked.select("conv", "turn", "role", "text", "pos", F.when(~blank, same).alias("same"), F.when(blank, 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).alias("fault")), "turns")
    seen = ranked.where("same is not null").groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1")
    seen = materialize(seen.select(F.col("conv").alias("sconv"), F.col("same").alias("ssame"), "first"), "seen")
    met = ranked.join(small_side(seen), F.col("conv").eqNullSafe(F.col("sconv")) & (F.col("same") == F.col("ssame")), "left")
    fault = F.when(F.col("pos") > F.col("first"), 2).otherwise(F.col("fault"))
    return materialize(met.select("conv", "turn", "role", "text", "pos", fault.alias("fault")), "faults")


def _initial(role: Column) -> Column:
    """0 of another role, 1 to 3 of s, u and a."""
    known = F.create_map(*[F.lit(x) for pair in (("s", 1), ("u", 2), ("a", 3)) for x in pair])
    return F.coalesce(F.element_at(known, F.substring(role, 1, 1)), F.lit(0))


_LEGAL = {(1, 2), (2, 3), (3, 2)}


def _illegal(codes: bytes) -> int:
    roles = [c & 3 for c in codes]
    return sum(pair not in _LEGAL for pair in zip(roles, roles[1:]))


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prices of each block from state to state, row by row."""
    for batch in batches:
        found = [matrix(bytes(c)) for c in batch["codes"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["g"], batch["block"], pa.array([[x for row in m for x in row] for m in found], pa.list_(pa.int64()))], names=["g", "block", "prices"])


def _chain_back(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("block")
    ends, total = ends_of([[m[i : i + 4] for i in range(0, 16, 4)] for m in blocks["prices"]])
    return pd.DataFrame({"g": blocks["g"], "block": blocks["block"], "following": [list(e) for e in ends], "cost": total})


def _chain_forward(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks, state, into = blocks.sort_values("block"), 0, []
    for leave in blocks["leave"]:
        into.append(state)
        state = int(leave[state])
    return pd.DataFrame({"g": blocks["g"], "block": blocks["block"], "state": into})


def _leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each block, from each state before it."""
    for batch in batches:
        out = []
        for codes, end in zip(batch["codes"].to_pylist(), batch["following"].to_pylist(), strict=True):
            costs = suffix_costs(bytes(codes), end)
            out.append([decode(bytes(codes), costs, s)[1] for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch["g"], batch["block"], pa.array(out, pa.list_(pa.int64()))], names=["g", "block", "leave"])


_EDITS = "g bigint, block bigint, audit string, cost bigint, illegal bigint, edits array<struct<edit:string,role:string,before:string,after:string>>"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each block, and of each turn its edit, the role it is put out with, and what is inserted about it."""
    for batch in batches:
        audits, costs, wrong, edits = [], [], [], []
        for codes, end, state, last, following in zip(*(batch[c].to_pylist() for c in ("codes", "following", "state", "last", "head")), strict=True):
            codes = bytes(codes)
            prices = suffix_costs(codes, end)
            audit, _ = decode(codes, prices, state)
            made, left = outputs(audit, codes, state)
            after = AFTER[left] if last else ""
            audits.append(audit + "I" * len(after))
            costs.append(prices[0][state])
            wrong.append(_illegal(codes) + (0 if last or (codes[-1] & 3, following & 3) in _LEGAL else 1))
            edits.append([{"edit": e, "role": r, "before": b, "after": after if i + 1 == len(made) else ""} for i, (e, r, b) in enumerate(made)])
        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("edit", "role", "before", "after")]))
        yield pa.RecordBatch.from_arrays([batch["g"], batch["block"], pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(wrong, pa.int64()), pa.array(edits, kind)], names=["g", "block", "audit", "cost", "illegal", "edits"])


def repair_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """The report, a row for each conversation, and the repaired turns.

    report: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.
    repaired: conv, place and part (their order), edit (K, R or I), role, text.

    A conversation's turns are in the order of their number, null first, of
    role and of text.  Null roles and texts count as one space; a null
    conversation is one too.  A turn has one fault at most: blank, else role
    and text of an earlier one (so of repeated rows all but the first), else
    cut short, that is its last character that is no white space is none of
    ``.!?``.  Edits are Keep (0), Rerole to user or assistant (2), Delete (3,
    which blank and repeated turns must be) and Insert of an empty turn of
    either (2); a turn that stays and is cut short costs 1 more.  The repaired
    roles begin ``s?(ua)+`` by their initials or are none.  Of the cheapest
    edits those count whose initials in order come first in ASCII.  Long texts
    are hashed and streamed; an empty table gives two empty ones.  Other
    columns, of whatever name, are not looked at.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = _faults(own)
    of = lambda k: F.count(F.when(F.col("fault") == k, 1))
    by_turn = found.groupBy("conv", "turn").agg(F.min("pos").alias("g"), F.count("*").alias("n"), *[of(k).alias(f"f{k}") for k in (1, 2, 3)])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    heads = by_turn.groupBy("conv").agg(F.min("g").alias("g"), F.sum("n").alias("n"), gaps.alias("gaps"), *[F.sum(f"f{k}").alias(c) for k, c in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    heads = materialize(heads, "conversations")
    code = _initial(F.col("role")) + F.when(F.col("fault").isin(1, 2), MUST_GO).when(F.col("fault") == 3, TRUNCATED).otherwise(0)
    key = heads.select(F.col("conv").alias("hconv"), "g", "n")
    coded = found.select("conv", "pos", code.cast("byte").alias("code")).join(small_side(key), F.col("conv").eqNullSafe(F.col("hconv")))
    place = F.col("pos") - F.col("g")
    blocks = coded.select("g", "n", F.floor(place / block_turns).alias("block"), place.alias("place"), "code").groupBy("g", "n", "block").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("t"))
    blocks = materialize(blocks.select("g", "n", "block", F.transform("t", lambda x: x["code"].cast("int")).alias("codes")), "blocks")

    one = blocks.where(F.col("n") <= block_turns).select("g", "block", "codes", F.array(*[F.lit(2 * len(a)).cast("bigint") for a in AFTER]).alias("following"), F.lit(0).cast("bigint").alias("state"), F.lit(True).alias("last"), F.lit(0).alias("head"))
    many = blocks.where(F.col("n") > block_turns)
    prices = materialize(many.select("g", "block", "codes").mapInArrow(_price, "g bigint, block bigint, prices array<bigint>"), "prices")
    ends = materialize(prices.groupBy("g").applyInPandas(_chain_back, "g bigint, block bigint, following array<bigint>, cost bigint"), "ends")
    met = many.join(ends.drop("cost"), ["g", "block"])
    leave = materialize(met.select("g", "block", "codes", "following").mapInArrow(_leaving, "g bigint, block bigint, leave array<bigint>"), "leave")
    state = leave.groupBy("g").applyInPandas(_chain_forward, "g bigint, block bigint, state bigint")
    after = many.select("g", (F.col("block") - 1).alias("block"), F.col("codes")[0].alias("head"))
    long = met.join(state, ["g", "block"]).join(after, ["g", "block"], "left")
    last = F.col("block") == F.floor((F.col("n") - 1) / block_turns)
    long = long.select("g", "block", "codes", "following", "state", last.alias("last"), F.coalesce("head", F.lit(0)).alias("head"))
    edits = materialize(one.unionByName(long).mapInArrow(_decide, _EDITS), "edits")

    audits = edits.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("a"), F.min_by("cost", "block").alias("cost"), F.sum("illegal").alias("illegal"))
    audits = audits.select("g", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"), "cost", "illegal")
    report = heads.join(audits, "g").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    single = edits.select("g", "block", F.posexplode("edits").alias("i", "e")).select((F.col("g") + F.col("block") * block_turns + F.col("i")).alias("epos"), F.col("g").alias("conv_g"), "e.*")
    said = found.select("conv", "pos", F.col("role").alias("own_role"), "text").join(single, F.col("pos") == F.col("epos"))
    empty = lambda initials: F.transform(F.filter(F.split(initials, ""), lambda c: c != ""), lambda c: F.struct(F.lit("I").alias("edit"), _named(c).alias("role"), F.lit("").alias("text")))
    itself = F.struct(F.col("edit"), F.when(F.col("edit") == "R", _named(F.col("role"))).otherwise(F.col("own_role")).alias("role"), F.col("text"))
    out = F.concat(empty(F.col("before")), F.when(F.col("edit") == "D", F.array().cast("array<struct<edit:string,role:string,text:string>>")).otherwise(F.array(itself)), empty(F.col("after")))
    repaired = said.select("conv", "conv_g", F.col("pos").alias("place"), F.posexplode(out).alias("part", "o")).select("conv", "conv_g", "place", "part", "o.*")
    return report, repaired


def _named(initial: Column) -> Column:
    return F.when(initial == "u", ROLES["u"]).otherwise(ROLES["a"])


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of each conversation with turns: of its ``role:text``, joined by line feeds.

    A conversation is one stream through a task, of a turn at a time.
    """
    kind = repaired.schema["conv"].dataType.simpleString()
    dealt = repaired.select("conv", "conv_g", "place", "part", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_g").sortWithinPartitions("conv_g", "place", "part")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, digest = None, None, hashlib.sha256()
        schema = None
        for batch in batches:
            schema = batch.schema.field("conv").type
            ids, sums = [], []
            for g, name, line in zip(batch["conv_g"].to_pylist(), batch["conv"], batch["line"].to_pylist(), strict=True):
                if g != now:
                    if now is not None:
                        ids.append(conv)
                        sums.append(digest.hexdigest())
                    now, conv, digest = g, name.as_py(), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    return dealt.mapInArrow(stream, f"conv {kind}, repaired_sha256 string")
