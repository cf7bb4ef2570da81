"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  The
ledger has, for each blob, the rule versions that have scanned it and the spans
they found.  A run scans one copy of each blob that is new, or new to a rule's
version, and joins the ledger back to all paths.

Spans are found without user code: the pattern ``\\G(.*?)(rule)`` cuts a text
into gaps and matches from the left, so running sums of their lengths give the
places.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small_side


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``value`` is the group (0: the whole match) that needs ``least`` characters; ``hint`` must be in every text that it matches."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1
    hint: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
    Rule("github_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)
RULES = BASE_RULES + MORE_RULES
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though used often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, rule: Rule) -> Column:
    """Leftmost matches that don't overlap, those with too short a value dropped.

    Running sums of the lengths give the places, in two steps of about the
    square root of the number of matches, so that no list grows long by
    appending.
    """
    cut = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    sizes = F.arrays_zip(*[F.transform(F.regexp_extract_all(text, cut, F.lit(g)), F.length).alias(n) for n, g in (("w", 0), ("g", 1), ("v", 2 + rule.value))])
    zero = F.lit(0).cast("bigint")
    spot = F.struct(F.lit(rule.kind).alias("kind"), zero.alias("start"), zero.alias("end"), F.lit(0).alias("v"))
    none = F.filter(F.array(spot), lambda _: F.lit(False))

    def placed(part: Column, begin: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x["w"]).alias("at"), F.array_append(a["out"], F.struct(F.lit(rule.kind).alias("kind"), (a["at"] + x["g"]).alias("start"), (a["at"] + x["w"]).alias("end"), x["v"].alias("v"))).alias("out"))
        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("out")), step)["out"]

    def whole(found: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(found))).cast("int") + 1
        part = lambda k: F.slice(found, k * step + 1, step)
        length = lambda k: F.aggregate(part(k), zero, lambda a, x: a + x["w"])
        numbers = F.sequence(F.lit(0), F.floor(F.size(found) / step).cast("int"))
        starts = F.aggregate(numbers, F.array(zero), lambda a, k: F.array_append(a, F.element_at(a, -1) + length(k)))
        return _let(starts, lambda at: F.flatten(F.transform(numbers, lambda k: placed(part(k), F.get(at, k)))))

    found = _let(sizes, whole)
    kept = F.transform(F.filter(found, lambda x: x["v"] >= rule.least), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    hint = text.contains(rule.hint) & text.rlike(rule.pattern) if rule.hint else text.rlike(rule.pattern)
    return F.when(hint, kept).otherwise(_none())


def empty_ledger(df: DataFrame) -> DataFrame:
    """A ledger that knows no blob."""
    return df.sparkSession.createDataFrame([], f"blob binary, rules array<string>, spans {_SPANS}")


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of each row of ``versions`` (id, blob, spans by start and order of the rules), and the ledger to keep for the next run.

    A null text is an empty blob.  Rows that share a text share a blob; rows
    that repeat an id are further versions of a path, each with its findings.
    A rule whose version has changed scans its blobs anew and its earlier spans
    are dropped.  Empty tables give empty results; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = versions.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    paths = materialize(src.select("id", "blob"), "paths")
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min(F.struct("id")).alias("first"))
    if ledger is None:
        new = blobs.withColumns({"due": names, "known": _none()})
    else:
        current = F.array(*[F.lit(r.kind) for r in rules])
        new = blobs.join(ledger.withColumnRenamed("rules", "seen"), "blob", "left").withColumn("due", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where("size(due) > 0")
        again = F.transform(F.col("due"), lambda n: F.split_part(n, F.lit("/"), F.lit(1)))
        new = new.withColumn("known", F.filter(F.coalesce("spans", _none()), lambda s: F.array_contains(current, s["kind"]) & ~F.array_contains(again, s["kind"]))).drop("spans", "seen")
    new = new.select(F.col("blob").alias("nblob"), F.col("first.id").alias("nid"), "due", "known")
    # The first run has all blobs to scan, so texts meet their blobs in a shuffle at every size; later ones mostly few.
    new = materialize(new, "due")
    one = src.join(new if ledger is None else small_side(new), (F.col("blob") == F.col("nblob")) & F.col("id").eqNullSafe(F.col("nid")))
    found = F.col("known")
    for rule in rules:
        found = F.concat(found, F.when(F.array_contains("due", rule.name), _spans(F.col("text"), rule)).otherwise(_none()))
    by_place = F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(r.kind) for r in rules]), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    made = materialize(one.select("blob", by_place.alias("spans")).groupBy("blob").agg(F.any_value("spans").alias("spans")).withColumn("rules", names), "scanned")
    if ledger is None:
        book = made.select("blob", "rules", "spans")
    else:
        book = materialize(ledger.join(made.select("blob"), "blob", "left_anti").select("blob", "rules", "spans").unionByName(made.select("blob", "rules", "spans")), "ledger")
    hits = book.where("size(spans) > 0").select("blob", "spans")
    return paths.join(hits, "blob", "left").select("id", "blob", F.coalesce("spans", _none()).alias("spans")), book


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
