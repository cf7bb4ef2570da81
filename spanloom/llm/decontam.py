"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is a run of ``window`` item words (an item of fewer words is one
window).  As sets of word shingles, a window is contained in a document only if
every shingle of it is, so one necessary prefix token is enough: the shingle
that is rarest in the corpus.  Documents are joined on that shingle, its
position bounds where the window would begin and end, and the words there are
compared exactly.

The documents are read once.  A bit filter of the item shingles, of bounded
size, is tested inside each row, so only places that may match leave the row,
each with the few words around it that the comparison needs; texts are never
shuffled.  The filter may pass too much but loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small_side
from .words import item_words, long_array

#: The bit filter has at most this many bits (256 KB), whatever the size of the benchmark.
MOST_BITS = 1 << 21


def _zipped(a: Column, b: Column, shift: int, n: Column) -> Column:
    """Hashes of the pairs a[i], b[i + shift], for the n first i."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))


def _grams(df: DataFrame, words: str, sizes: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """``df`` with an array for each size: the hash of each shingle of so many ``words``, made of hashes of shorter ones; and their names."""
    n = F.size(words)
    df = df.withColumn("g1", F.transform(words, lambda w: F.xxhash64(w)))
    made = {1: "g1"}

    def make(s: int) -> None:
        nonlocal df
        if s in made:
            return
        half = 1 << (s - 1).bit_length() - 1
        make(half)
        make(s - half)
        df = df.withColumn(f"g{s}", _zipped(F.col(made[half]), F.col(made[s - half]), half, n - (s - 1)))
        made[s] = f"g{s}"

    for s in sizes:
        make(s)
    return df, {s: made[s] for s in sizes}


def _bit_filter(grams: DataFrame) -> tuple[Column, int]:
    """Words of 64 bits of a filter of ``grams.h``, as a constant column, and their number."""
    n = grams.select("h").distinct().count()
    bits = 1 << 12
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    words = bits // 64
    spot = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = grams.select(spot.alias("b")).distinct().groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x")).collect()  # at most MOST_BITS / 64 rows
    table = [0] * words
    for r in rows:
        table[r.w] = r.x
    return long_array(table), bits


def _passes(h: Column, table: Column, bits: int) -> Column:
    bit = h.bitwiseAND(F.lit(bits - 1))
    word = F.get(table, F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


_FOUND = "array<struct<pos:int,h:bigint,s:int,from:int,ctx:array<string>>>"


def _places(grams: str, s: int, window: int, table: Column, bits: int) -> Column:
    """The shingles of ``s`` words that pass the filter, with the words around them."""

    def around(h: Column, i: Column) -> Column:
        p = i + 1
        begin = F.greatest(F.lit(1), p - (window - s))
        return F.struct(p.cast("int").alias("pos"), h.alias("h"), F.lit(s).alias("s"), begin.cast("int").alias("from"), F.slice("words", begin, p + window - begin).alias("ctx"))

    return F.array_compact(F.transform(grams, lambda h, i: F.when(_passes(h, table, bits), around(h, i)))).cast(_FOUND)


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_hit (words in an occurrence of a window), items (sorted ids of the items that occur) and n_items.

    Nulls: a null text has no words; items of null id or without words are
    left out.  Repeated rows are judged one by one; items that share an id are
    one item with the windows of all.  Empty tables give no rows, or rows
    without hits.  Other columns are ignored whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    it = items.select(F.col(item_id).cast("string").alias("item"), item_words(F.col(item_text)).alias("words")).where("item is not null and size(words) > 0")
    at = F.sequence(F.lit(1), F.size("words") - F.least(F.size("words"), F.lit(window)) + 1)
    spans = it.select("item", "words", F.explode(at).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(window)).alias("w"))
    spans = materialize(spans.select("item", "w", F.concat_ws(" ", "w").alias("wtext")), "windows")
    windows = spans.select("wtext", "w").dropDuplicates(["wtext"]).withColumn("len", F.size("w")).withColumn("s", F.least("len", F.lit(shingle)))
    sizes = sorted(r.s for r in windows.select("s").distinct().collect())  # at most `shingle` values
    made, names = _grams(windows, "w", sizes)
    own = F.coalesce(*[F.when(F.col("s") == s, F.col(g)) for s, g in names.items()], F.array().cast("array<bigint>"))
    grams = materialize(made.select("wtext", "len", "s", F.posexplode(own).alias("off", "h")), "grams")

    base = docs.select(F.monotonically_increasing_id().alias("rid"), "id", item_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    base, names = _grams(base, "words", sizes)
    found: Column = F.array().cast(_FOUND)
    for s, g in names.items():
        table, bits = _bit_filter(grams.where(F.col("s") == s))
        found = F.concat(found, _places(g, s, window, table, bits))
    base = materialize(base.select("rid", "id", "n_words", found.alias("found")), "places")
    places = base.where("size(found) > 0").select("rid", "n_words", F.explode("found").alias("f")).select("rid", "n_words", "f.*")

    # The rarest shingle of each window; a window with a shingle that the corpus lacks can't occur.
    seen = places.groupBy("s", "h").agg(F.count("*").alias("seen"))
    rarest = grams.join(small_side(seen), ["s", "h"], "left").groupBy("wtext", "len").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "s", "off")).alias("k")).where("k.seen > 0").select("wtext", "len", "k.h", "k.s", "k.off")
    rarest = materialize(rarest, "prefixes")
    start = F.col("pos") - F.col("off")
    hits = places.join(small_side(rarest), ["s", "h"]).withColumn("start", start).where("start >= 1 and start + len - 1 <= n_words")
    hits = hits.where(F.concat_ws(" ", F.slice("ctx", F.col("start") - F.col("from") + 1, F.col("len"))) == F.col("wtext")).select("rid", "start", (F.col("start") + F.col("len") - 1).alias("end"), "wtext")
    hits = materialize(hits, "hits")

    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "end"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"] - 1, a["last"]))).cast("long").alias("n"), F.greatest(a["last"], x["end"]).alias("last")))["n"]
    words_hit = hits.groupBy("rid").agg(covered.alias("n_hit"))
    which = hits.select("rid", "wtext").distinct().join(small_side(spans.select("wtext", "item").distinct()), "wtext").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return base.select("rid", "id", "n_words").join(words_hit.join(which, "rid"), "rid", "left").select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
    )
