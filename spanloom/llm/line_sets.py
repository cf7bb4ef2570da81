"""Similar word sets of lines across documents, by DataFrame operations alone: an exact join at a Jaccard similarity of ``percent`` / 100.

1. Lines of equal text go first, all but the earliest.
2. A line is the set of its words, as longs of length and hash, longest first:
   long words are rare ones, so the order by rarity needs no count.  Any order
   that all sets share gives the same result.
3. Keys: a word of a set and the next one.  A word that the other set lacks
   breaks two such pairs, one that it has more breaks one; so similar sets share
   one of as many first pairs as can break, and one more.  Where all can break,
   the words of the prefix are keys, too.
4. The lines of a key meet in one sort, in the order of documents.  Each is
   compared with the first line of its key by size and picture (parity of its
   words in 64 cells, 128 for large sets, which differs in no more cells than
   the sets in words), and what is left is verified word by word.
5. Lines that resemble no first line are compared with all others of their keys.
   Near copies of a first line are so settled in time linear in their number;
   lines of a large key that resemble others but not the first meet in pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, small_side
from .words import HAS_WORD

#: Bytes of a word that count in the order.
LONGEST = 63
#: Words of a set above which its picture has 128 cells.
WIDE = 96


#: What the words are parted by, in one step with the lower case of A-Z.
_FROM = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_TO = "".join(c.lower() if c.isalpha() else " " for c in _FROM)


def word_set(line: Column) -> Column:
    """The distinct words of a line as sorted longs, longest first: length in the upper 6 bits and 58 bits of a hash."""

    def code(w: Column) -> Column:
        longer = (LONGEST // 2 - F.least(F.octet_length(w), F.lit(LONGEST))).cast("long")
        return F.shiftleft(longer, 58).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 6))

    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(F.translate(line, _FROM, _TO), " "), ""), code)))


def lacking(n: Column, percent: int) -> Column:
    """Words of a set of n that a similar set lacks at most."""
    return n - F.ceil(n * percent / F.lit(100)).cast("int")


def pairs_needed(n: Column, percent: int) -> Column:
    """First pairs of neighbours of which similar sets share one: those that can break, and one."""
    if percent < 50:
        return 2 * n + 1
    # A word that is lacking leaves room for 100 / percent, at most 2, fewer words that the other set has more.
    lacks = lacking(n, percent)
    return (2 * lacks + F.floor((n - lacks) * 100 / F.lit(percent)) - n + 1).cast("int")


def _n(place: Column) -> Column:
    """Words of the line in ``place``, whose upper half is the line."""
    return place.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _line(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def may_resemble(a: str, b: str, percent: int) -> Column:
    """False only for sets (columns place, pic and wide after the prefixes ``a`` and ``b``) that are too far apart by size or picture."""
    n, m, pic, wide = _n(F.col(f"{a}place")), _n(F.col(f"{b}place")), F.col(f"{a}pic").bitwiseXOR(F.col(f"{b}pic")), F.col(f"{a}wide").bitwiseXOR(F.col(f"{b}wide"))
    most = n + m - 2 * F.floor(((n + m) * percent + 99 + percent) / F.lit(100 + percent))
    apart = F.when((n > WIDE) & (m > WIDE), F.bit_count(pic.bitwiseXOR(wide)) + F.bit_count(wide)).otherwise(F.bit_count(pic))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart <= most)


def _lines(texts: DataFrame, kept: Column | None = None) -> DataFrame:
    """(doc, line, x) of the lines with words of ``texts``."""
    lines = texts.select("*", F.posexplode(F.split("t", "\n")).alias("line", "x"))
    return (lines if kept is None else lines.where(kept)).where(F.col("x").rlike(HAS_WORD)).select("doc", "line", "x")


def keys(lines: DataFrame, percent: int) -> DataFrame:
    """(key, doc, place, pic, wide) of each key of ``lines`` (doc, line, x); place is the line and its number of words."""
    sets = lines.select("doc", "line", word_set(F.col("x")).alias("words"))
    n, need = F.size("words"), pairs_needed(F.size("words"), percent)
    half = "aggregate(words, 0L, (a, w) -> a ^ {})"
    bit = "shiftleft(1L, cast(w & 63 as int))"
    sets = sets.select(
        "doc", "words", F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(n.cast("long")).alias("place"), F.expr(half.format(bit)).alias("pic"),
        F.when(n > WIDE, F.expr(half.format(f"if(w & 64 = 0, 0L, {bit})"))).otherwise(0).alias("wide"),
        # From 0 on the pair of that word and the next; below 0 a single word.
        F.when(need > n - 1, -lacking(n, percent) - 1).otherwise(0).alias("first"), (F.least(need, n - 1) - 1).alias("last"),
    )
    each = sets.select("doc", "place", "words", "pic", "wide", F.explode(F.sequence("first", "last")).alias("at"))
    at = F.col("at")
    key = F.when(at >= 0, F.xxhash64(F.get("words", at), F.get("words", at + 1))).otherwise(F.xxhash64(F.get("words", -at - 1), F.lit("word")))
    return each.select(key.alias("key"), "doc", "place", "pic", "wide")


def copied_lines(texts: DataFrame) -> DataFrame:
    """(doc, line) of the lines with words that an earlier line equals."""
    marked = _lines(texts).select("doc", "line", F.xxhash64("x").alias("hash"), F.octet_length("x").alias("size"))
    earlier = Window.partitionBy("hash", "size").orderBy("doc", "line")
    return marked.withColumn("rank", F.row_number().over(earlier)).where("rank > 1").select("doc", "line")


def similar_lines(texts: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of the lines of ``texts`` (doc, t) that resemble an earlier one."""
    copies = materialize(copied_lines(texts), "copies")
    lost = materialize(copies.groupBy("doc").agg(F.collect_list("line").alias("lost")), "lost")
    lines = _lines(texts.join(small_side(lost), "doc", "left"), F.col("lost").isNull() | ~F.array_contains("lost", F.col("line")))

    by_key = Window.partitionBy("key").orderBy("doc", "place")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = keys(lines, percent).select(
        "*", F.row_number().over(so_far).alias("rank"), F.lead("place").over(by_key).isNotNull().alias("more"),
        *(F.first(c).over(so_far).alias(f"head_{c}") for c in ("doc", "place", "pic", "wide")),
    )
    fits = may_resemble("", "head_", percent)
    met = met.where("rank > 1").withColumn("fits", fits).where("fits or more or rank > 2")
    at, head = ["doc", "place"], ("head_doc", "head_place")
    met = materialize(met.select("key", *at, "pic", "wide", "rank", *(F.when(F.col("fits"), F.col(c)).alias(c) for c in head)), "met")

    pairs = met.where("head_doc is not null").select(*at, *head).distinct()
    near = materialize(verified(texts, pairs.select("doc", _line(F.col("place")).alias("line"), F.col("head_doc").alias("with_doc"), _line(F.col("head_place")).alias("with_line")), percent), "near")
    asks = met.where("rank > 2").select("key", *at, "pic", "wide", "rank", _line(F.col("place")).alias("line")).join(small_side(near), ["doc", "line"], "left_anti")
    mates = met.select("key", *(F.col(c).alias(f"with_{c}") for c in (*at, "pic", "wide", "rank")))
    pairs = asks.join(mates, "key").where((F.col("with_rank") < F.col("rank")) & may_resemble("", "with_", percent))
    pairs = pairs.select("doc", "line", "with_doc", _line(F.col("with_place")).alias("with_line")).distinct()
    return copies.unionByName(near).unionByName(verified(texts, pairs, percent))


def verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of the later lines of the candidates (doc, line, with_doc, with_line) that are similar, word by word."""
    pairs = materialize(pairs, "pairs")
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("with_doc").alias("doc"), F.col("with_line").alias("line")))
    wanted = materialize(ends.groupBy("doc").agg(F.collect_set("line").alias("want")), "wanted")
    lines = _lines(texts.join(small_side(wanted), "doc"), F.array_contains("want", F.col("line")))
    lines = materialize(lines.select("doc", "line", word_set(F.col("x")).alias("words")), "words")
    mates = lines.select(F.col("doc").alias("with_doc"), F.col("line").alias("with_line"), F.col("words").alias("with_words"))
    joined = pairs.join(lines, ["doc", "line"]).join(mates, ["with_doc", "with_line"])
    both = F.size(F.array_intersect("words", "with_words"))
    return joined.where(both * 100 >= (F.size("words") + F.size("with_words") - both) * percent).select("doc", "line").distinct()
