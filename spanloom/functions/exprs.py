"""Column builders for phases, pairs, names, hashes, vectors and rotations."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: pair ids are a * PAIR_BASE + b for image ids a < b.
PAIR_BASE = 2**31 - 1


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Numbers -----------------------------------------------------------------


def is_finite(x: Column | str) -> Column:
    """False for null, NaN and the infinities."""
    x = col(x).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))


def finite_or_null(x: Column | str) -> Column:
    return F.when(is_finite(x), col(x).cast("double"))


def or_default(x: Column | str, default: float) -> Column:
    """``x``, or ``default`` where it is null or zero: evidence orders treat 0 as missing."""
    return F.coalesce(F.nullif(col(x), F.lit(0)), F.lit(default))


def safe_ratio(a: Column | str, b: Column | str, floor: float = 1e-9) -> Column:
    return col(a) / F.greatest(col(b), F.lit(floor))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


# Phases ------------------------------------------------------------------


def normalize_phase(x: Column | str) -> Column:
    """``x`` modulo 1 in [0, 1); within 1e-12 of 1 is 0."""
    p = F.pmod(col(x).cast("double"), F.lit(1.0))
    return F.when(F.abs(p - 1.0) <= 1e-12, F.lit(0.0)).otherwise(p)


def circular_distance(a: Column | str, b: Column | str) -> Column:
    d = F.abs(normalize_phase(a) - normalize_phase(b))
    return F.least(d, 1.0 - d)


# Pairs -------------------------------------------------------------------


def pair_id(a: Column | str, b: Column | str) -> Column:
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    return F.least(a, b) * PAIR_BASE + F.greatest(a, b)


def decode_pair_id(p: Column | str) -> Column:
    p = col(p)
    return F.struct(F.call_function("div", p, F.lit(PAIR_BASE)).alias("first"), (p % PAIR_BASE).cast("bigint").alias("second"))


def observation_id(image: Column | str, keypoint: Column | str) -> Column:
    return F.shiftleft(col(image).cast("bigint"), 32).bitwiseOR(col(keypoint).cast("bigint"))


def canonical(a: Column | str, b: Column | str) -> Column:
    """Struct (a, b) of the lesser and the greater name; a pair of one name is an error."""
    a, b = col(a), col(b)
    return F.when(a == b, F.raise_error(F.concat(F.lit("self pair: "), a.cast("string")))).otherwise(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def transition_key(a: Column | str, b: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array(col(a), col(b))), ":")


# Names, logs -------------------------------------------------------------


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), -1)


def stem(name: Column | str) -> Column:
    return F.regexp_replace(basename(name), r"\.[^.]*$", "")


def duplicate_stem(name: Column | str) -> Column:
    return F.regexp_replace(stem(name), r"_(\d+)$", "")


def is_near_duplicate_name(a: Column | str, b: Column | str) -> Column:
    return duplicate_stem(a) == duplicate_stem(b)


def stamp(name: Column | str) -> Column:
    """The time in a capture's file name, such as IMG20260912145220_01.jpg; null if there is none."""
    digits = F.regexp_extract(basename(name), r"(\d{14})", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def name_order(name: Column | str) -> list[Column]:
    """Sort keys of captures: time, numeric suffix (0 if none), name in lower case."""
    suffix = F.regexp_extract(basename(name), r"\d{14}_(\d+)", 1)
    return [stamp(name), F.coalesce(suffix.try_cast("int"), F.lit(0)), F.lower(basename(name))]


#: What a log says in lower case when memory or time of the device ran out, and when it can't run at all; for dense runs and for others.
DENSE_MEMORY = ("out of memory", "cudaerrormemoryallocation", "bad_alloc", "memory allocation")
DENSE_CAPABILITY = ("no kernel image", "requires cuda", "not compiled", "cuda driver")
RUN_RESOURCE = ("out of memory", "cudaerrormemoryallocation", "launch timed out", "tdr", "cudaerrormemory", "bad_alloc")
RUN_CAPABILITY = ("no kernel image", "requires cuda", "cuda driver version", "not compiled", "unknown command")


def _says(log: Column | str, words: tuple[str, ...]) -> Column:
    text, found = F.lower(F.coalesce(col(log), F.lit(""))), F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def dense_failure_category(log: Column | str, status: Column | str) -> Column:
    """Why a dense run failed, by its log, then by its status."""
    return F.when(_says(log, DENSE_MEMORY), "cuda_oom").when(_says(log, DENSE_CAPABILITY), "capability").when(col(status) == "timeout", "timeout").otherwise("runtime")


def failure_category(log: Column | str, status: Column | str) -> Column:
    """Why a run failed, by its log, then by its status; null for a completed one."""
    other = F.when(_says(log, RUN_RESOURCE), "resource").when(_says(log, RUN_CAPABILITY), "capability").when(col(status) == "timeout", "timeout").otherwise("subprocess")
    return F.when(col(status).eqNullSafe("completed"), F.lit(None)).otherwise(other)


# Hashes ------------------------------------------------------------------


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hamming_words(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def sign_word(vector: Column | str) -> Column:
    """64-bit word with bit i set where entry i of a vector is positive."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(F.transform(F.slice(col(vector), 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON (sorted keys, no spaces) of the named columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def is_sha256(x: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(x))).rlike("^[0-9a-f]{64}$"), F.lit(False))


# Vectors and rotations (row-major arrays of doubles) -------------------


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def mean_abs_difference(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(col(a))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; inside a lambda, what stands outside of it is worked out for each entry."""
    return F.transform(F.array(value), body)[0]


def z_scores(a: Column | str) -> Column:
    """Entries less their mean, over their population deviation (1 at least where it is tiny)."""
    n = F.size(col(a))
    mean_of = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    off_of = lambda v: _let(mean_of(v), lambda mean: F.transform(v, lambda x: x - mean))
    std_of = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / n)
    scaled = lambda d: _let(std_of(d), lambda std: F.transform(d, lambda x: x / F.when(std < 1e-6, 1.0).otherwise(std)))
    return _let(F.transform(col(a), lambda x: x.cast("double")), lambda v: _let(off_of(v), scaled))


def angle_deg(cosine: Column) -> Column:
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def rotation_angle_deg(r: Column | str) -> Column:
    r = col(r)
    return angle_deg((r[0] + r[4] + r[8] - 1.0) / 2.0)


def geodesic_deg(a: Column | str, b: Column | str) -> Column:
    """Angle of A Bt; its trace is the sum of the products of the entries."""
    return angle_deg((dot(a, b) - 1.0) / 2.0)


def angle_between_deg(a: Column | str, b: Column | str) -> Column:
    return angle_deg(dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12)))


def matmul(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def transpose(a: Column | str) -> Column:
    a = col(a)
    return F.array(*[a[3 * j + i] for i in range(3) for j in range(3)])


def matvec(a: Column | str, v: Column | str) -> Column:
    a, v = col(a), col(v)
    return F.array(*[a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)])


def skew(v: Column | str) -> Column:
    v, zero = col(v), F.lit(0.0)
    return F.array(zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero)


def is_rotation(r: Column | str, tolerance: float = 1e-3) -> Column:
    """Nine finite entries, orthonormal rows, determinant 1."""
    r = col(r)
    p = matmul(r, transpose(r))
    off = F.greatest(*[F.abs(p[3 * i + j] - float(i == j)) for i in range(3) for j in range(3)])
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    nine = (F.size(r) == 9) & F.forall(r, is_finite)
    return F.coalesce(F.when(nine, (off <= tolerance) & (F.abs(det - 1.0) <= tolerance)), F.lit(False))


def is_direction(v: Column | str) -> Column:
    v = col(v)
    return F.coalesce(F.when((F.size(v) == 3) & F.forall(v, is_finite), norm(v) > 1e-12), F.lit(False))


def unit(v: Column | str) -> Column:
    n = norm(v)
    return F.when(n <= 1e-12, F.raise_error(F.lit("vector without direction"))).otherwise(F.transform(col(v), lambda x: x / n))


def sampson(e: Column | str, a: Column | str, b: Column | str) -> Column:
    """Sampson error of homogeneous points a, b (arrays of 3) under the matrix e."""
    ea, etb = matvec(e, a), matvec(transpose(e), b)
    num = dot(b, ea)
    den = ea[0] * ea[0] + ea[1] * ea[1] + etb[0] * etb[0] + etb[1] * etb[1]
    return F.abs(num) / F.sqrt(F.greatest(den, F.lit(1e-18)))


def srgb_to_linear(x: Column | str) -> Column:
    x = col(x)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))


# Texts of numbers and hashes of records --------------------------------------


def general_number(x: Column | str, digits: int = 6) -> Column:
    """``x`` with so many significant digits and no trailing zeros, in powers of ten beyond them; null unless it is finite.

    Rounded from the exact value of the double, halves to even, as C does; Java rounds its shortest text once more.
    """

    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return pd.Series([f"{n:.{digits}g}" if math.isfinite(n) else None for n in v.tolist()], dtype=object)

    return text(col(x).cast("double"))


def number_text(x: Column | str, default: str = "") -> Column:
    """A number in six digits; ``default`` for null, empty and not finite ones; text that is no number as it is."""
    text = col(x).cast("string")
    number = text.try_cast("double")
    return F.when(text.isNull() | (text == ""), default).when(number.isNull(), text).otherwise(F.coalesce(general_number(number), F.lit(default)))


def ascii_json(text: Column | str) -> Column:
    """JSON text with all beyond ASCII written as UTF-16 escapes."""
    units = F.regexp_extract_all(F.hex(F.encode(col(text), "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    one = lambda u: F.when(u > "007E", F.concat(F.lit("\\u"), F.lower(u))).otherwise(F.char(F.conv(u, 16, 10).cast("int")))
    return F.when(col(text).rlike(r"[^ -~]"), F.array_join(F.transform(units, one), "")).otherwise(col(text))


def canonical_sha256(*columns: str) -> Column:
    """SHA-256 of the canonical JSON (sorted keys, no spaces, ASCII only) of the named columns."""
    return F.sha2(ascii_json(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})), 256)


def id_list_sha256(ids: Column | str) -> Column:
    """SHA-256 of a list of whole numbers as JSON, in its order."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(col(ids), lambda i: i.cast("string")), ","), F.lit("]")), 256)


def names_sha256(names: Column | str) -> Column:
    """SHA-256 of names, each with a line feed behind it."""
    return F.sha2(F.concat(F.array_join(col(names), "\n"), F.lit("\n")), 256)


def schedule_sha256(pairs: Column | str) -> Column:
    """SHA-256 of a list of pairs (a, b) of names, each in order, as JSON; a pair that comes twice is an error."""
    ordered = F.transform(col(pairs), lambda p: F.array(F.least(p["a"], p["b"]), F.greatest(p["a"], p["b"])))
    twice = F.size(F.array_distinct(ordered)) < F.size(ordered)
    return F.when(twice, F.raise_error(F.lit("the schedule has a pair twice"))).otherwise(F.sha2(F.to_json(ordered), 256))


def cache_identity(source: Column | str, mask: Column | str, model: Column) -> Column:
    """SHA-256 of a cache's sources and model (a struct); null unless both sources are hashes of 64 characters."""
    whole = F.struct(model.alias("model_identity"), col(mask).alias("feature_mask_sha256"), col(source).alias("source_sha256"))
    body = F.to_json(F.struct(whole["feature_mask_sha256"].alias("feature_mask_sha256"), whole["model_identity"].alias("model_identity"), whole["source_sha256"].alias("source_sha256")))
    return F.when((F.length(col(source)) == 64) & (F.length(col(mask)) == 64), F.sha2(body, 256))


# Small rules ------------------------------------------------------------------


def degrees_or_null(x: Column | str) -> Column:
    return F.degrees(finite_or_null(x))


def optional_angle_deg(x: Column | str) -> Column:
    """Degrees of an angle of which negative values stand for none."""
    return F.when(col(x) >= 0, degrees_or_null(x))


def unit_or_error(v: Column | str) -> Column:
    """``v`` at length 1; no direction, below 1e-12 or not finite, is an error."""
    n = norm(v)
    bad = ~is_finite(n) | (n <= 1e-12)
    return F.when(bad, F.raise_error(F.lit("a translation without direction"))).otherwise(F.transform(col(v), lambda x: x / n))


def to_original(x: Column | str, from_size: Column | int, to_size: Column | int) -> Column:
    """A coordinate of a scaled image in the original, in single precision."""
    size = lambda s: s if isinstance(s, Column) else F.lit(s)
    return col(x).cast("float") * (size(to_size).cast("double") / size(from_size)).cast("float")


def camera_params(focal_35mm: Column | str, width: Column | str, height: Column | str) -> Column:
    """Focal length in pixels, centre and distortion 0 of a camera, in twelve digits."""
    focal = col(focal_35mm) / math.hypot(36.0, 24.0) * F.sqrt(col(width) * col(width) + col(height) * col(height))
    return F.concat_ws(",", *[general_number(v, 12) for v in (focal, col(width) / 2.0, col(height) / 2.0, F.lit(0.0))])


def simplification(faces: Column | str, size: Column | str) -> Column:
    """Whether a mesh needs fewer faces (used, target_faces, target_ratio): beyond 750,000 faces or 512 MB, half of them, within 100,000 and 500,000."""
    faces = col(faces)
    used = ~((faces <= 750_000) & (col(size) <= 512 * 1024 * 1024))
    target = F.least(F.lit(500_000), F.greatest(F.lit(100_000), F.floor(faces / 2).cast("bigint")))
    return F.struct(used.alias("used"), F.when(used, target).alias("target_faces"), F.when(used, target / faces).alias("target_ratio"))


def smaller_after_oom(category: Column | str, size: Column | str) -> Column:
    """The one step down that a lack of GPU memory permits, from 2000 to 1600 pixels; null for anything else."""
    return F.when((col(category) == "cuda_oom") & (col(size) == 2000), F.lit(1600))


def smaller_after_failure(attempts: Column | str, status: Column | str, category: Column | str, size: Column | str) -> Column:
    """The size for the one retry of a dense run after a single failure of resources, time or runtime; null for anything else."""
    allowed = (col(attempts) == 1) & col(status).isin("failed", "timeout", "interrupted") & col(category).isin("resource", "timeout", "runtime")
    return F.when(allowed, F.when(col(size) > 1600, 1600).otherwise(1200))


def edge_weight(inliers: Column | str, conditioned: Column | str) -> Column:
    """Inliers, 1 at least; a thousandth of them without good conditioning."""
    n = F.greatest(F.lit(1.0), F.coalesce(col(inliers).cast("double"), F.lit(1.0)))
    return F.when(F.coalesce(col(conditioned), F.lit(False)), n).otherwise(F.greatest(F.lit(0.001), n * 0.001))


def first_rotation(*columns: str) -> Column:
    """The first of the columns that isn't null, if it has nine finite entries."""
    r = F.coalesce(*columns)
    return F.when((F.size(r) == 9) & F.forall(r, is_finite), r)


def in_bounds(first: Column | str, second: Column | str, first_count: Column | str, second_count: Column | str) -> Column:
    """Match rows whose places are within both images."""
    return (col(first) >= 0) & (col(first) < col(first_count)) & (col(second) >= 0) & (col(second) < col(second_count))


def padded_box(x: Column, y: Column, width: Column, height: Column, mask_width: Column, mask_height: Column, share: float = 0.08) -> Column:
    """(x1, y1, x2, y2) of a box with a margin of ``share``, 8 at least, within the mask; an empty box is an error."""
    px, py = (F.greatest(F.lit(8.0), F.rint(s * share)) for s in (width, height))
    box = F.array(F.greatest(F.lit(0.0), x - px), F.greatest(F.lit(0.0), y - py), F.least(mask_width.cast("double"), x + width + px), F.least(mask_height.cast("double"), y + height + py))
    return F.when((width <= 0) | (height <= 0), F.raise_error(F.lit("an empty mask has no box"))).otherwise(box)


def equals_measured(value: Column | str, measured: Column | str) -> Column:
    """A finite number that equals a measured one exactly; false if either is missing."""
    return F.coalesce(is_finite(value) & (col(value).cast("double") == col(measured)), F.lit(False))


def is_count(x: Column | str) -> Column:
    return F.coalesce(col(x) >= 0, F.lit(False))


def list_rank(x: Column | str, order: list[str]) -> Column:
    """Place of ``x`` in a list, from 1; 0 if it isn't there."""
    return F.array_position(F.array(*[F.lit(o) for o in order]), col(x))


def masked(value: Column | str, mask: Column | str, outside: int = 0) -> Column:
    """``value`` where the mask is positive, else ``outside``."""
    return F.when(col(mask) > 0, col(value)).otherwise(F.lit(outside))


def without_board(mask: Column | str, board: Column | str) -> Column:
    """255 where a mask is positive and no board evidence is; evidence only ever takes away."""
    return F.when((col(mask) > 0) & (F.coalesce(col(board), F.lit(0)) <= 0), 255).otherwise(0)
