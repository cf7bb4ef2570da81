import hashlib
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions import exprs as E


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def rot(deg, axis="z"):
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    m = {"z": [c, -s, 0, s, c, 0, 0, 0, 1], "x": [1, 0, 0, 0, c, -s, 0, s, c]}[axis]
    return F.array(*[F.lit(float(x)) for x in m])


def test_phase_and_distance(spark):
    r = one(spark, d=E.circular_distance(F.lit(0.99), F.lit(0.01)), p=E.normalize_phase(F.lit(1 - 1e-13)), n=E.normalize_phase(F.lit(-0.25)))
    assert abs(r.d - 0.02) < 1e-12 and r.p == 0 and r.n == 0.75


def test_pair_ids_and_stems(spark):
    p = E.pair_id(F.lit(242), F.lit(241))
    r = one(spark, d=E.decode_pair_id(p), s=E.duplicate_stem(F.lit("a/IMG20260912145220_01.jpg")), near=E.is_near_duplicate_name(F.lit("b.jpg"), F.lit("b_01.jpg")), c=E.canonical(F.lit("b"), F.lit("a")))
    assert (r.d.first, r.d.second) == (241, 242) and r.s == "IMG20260912145220" and r.near and (r.c.a, r.c.b) == ("a", "b")


def test_zero_counts_as_missing(spark):
    r = one(spark, z=E.or_default(F.lit(0), 10**9), n=E.or_default(F.lit(None).cast("int"), 5), v=E.or_default(F.lit(3), 5))
    assert (r.z, r.n, r.v) == (10**9, 5, 3)


def test_finite(spark):
    vals = [None, float("nan"), float("inf"), -float("inf"), 0.0]
    got = spark.createDataFrame([(v,) for v in vals], "x double").select(E.is_finite("x").alias("f")).collect()
    assert [g.f for g in got] == [False, False, False, False, True]


def test_rotations(spark):
    r = one(spark, a=E.rotation_angle_deg(rot(30)), b=E.rotation_angle_deg(rot(30, "x")), g=E.geodesic_deg(rot(30), rot(30, "x")), ok=E.is_rotation(rot(10)), bad=E.is_rotation(F.array(*[F.lit(1.0)] * 9)), short=E.is_rotation(F.array(F.lit(1.0))))
    assert abs(r.a - 30) < 1e-9 and abs(r.b - 30) < 1e-9 and r.g > 20 and r.ok and not r.bad and not r.short


def test_capture_names_in_order(spark):
    names = ["IMG20260912150627_01.jpg", "IMG20260912150627.jpg", "IMG20260912131808.jpg"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(*E.name_order("n")).collect()
    assert [g.n for g in got] == names[::-1]


def test_hashes_and_logs(spark):
    r = one(spark, h=E.hamming(F.lit(5).cast("bigint"), F.lit(6).cast("bigint")), sha=E.is_sha256(F.lit("A" * 64)), no=E.is_sha256(F.lit(None).cast("string")), cat=E.failure_category(F.lit("CUDA error: out of memory"), F.lit("failed")))
    assert r.h == 2 and r.sha and not r.no and r.cat == "resource"


def _one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_number_texts(spark):
    for x in (0.0, 1.0, -2.5, 1234567.0, 0.00001234, 123456.0, 999999.5, 1e-4, 1e20, 100.0, 3.14159265):
        assert _one(spark, E.number_text(F.lit(x))) == f"{x:g}"
    assert [_one(spark, E.number_text(F.lit(x), "-")) for x in (None, "", "nan", "inf", "abc", "12.50")] == ["-", "-", "-", "-", "abc", "12.5"]


def test_numbers_are_rounded_once(spark):
    """Exact halves, and doubles just beside one whose shortest text is the half itself."""
    values = [100000.5, 100001.5, -100000.5, 1234567890.125, 0.0001000005, 908.5527625455, 2.5e-7]
    beside = [x / 2**k for k in range(1, 12) for x in (float(f"{n}.5") for n in range(123456, 123476))]
    df = spark.createDataFrame([(x,) for x in values + beside], "x double")
    got = df.select("x", E.general_number("x").alias("a"), E.general_number("x", 12).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(f"{r.x:.6g}", f"{r.x:.12g}") for r in got]


def test_canonical_hashes(spark):
    row = spark.createDataFrame([("é🙂\n\"", 3)], "b string, a int")
    want = hashlib.sha256(json.dumps({"a": 3, "b": "é🙂\n\""}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert row.select(E.canonical_sha256("b", "a")).first()[0] == want
    assert _one(spark, E.id_list_sha256(F.array(F.lit(3), F.lit(1)))) == hashlib.sha256(b"[3,1]").hexdigest()
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    assert _one(spark, E.schedule_sha256(F.array(pair("z", "b"), pair("a", "c")))) == hashlib.sha256(b'[["b","z"],["a","c"]]').hexdigest()
    with pytest.raises(Exception, match="twice"):
        _one(spark, E.schedule_sha256(F.array(pair("z", "b"), pair("b", "z"))))
    assert _one(spark, E.cache_identity(F.lit("a" * 63), F.lit("b" * 64), F.struct(F.lit(1).alias("m")))) is None


def test_small_rules(spark):
    third = F.array(*[F.lit(x) for x in (0.0, 3.0, 4.0)])
    assert _one(spark, E.unit_or_error(third)) == [0.0, 0.6, 0.8]
    with pytest.raises(Exception, match="direction"):
        _one(spark, E.unit_or_error(F.array(F.lit(0.0), F.lit(1e-13))))
    assert _one(spark, E.optional_angle_deg(F.lit(-1.0))) is None and _one(spark, E.degrees_or_null(F.lit(float("nan")))) is None
    assert _one(spark, E.edge_weight(F.lit(None).cast("int"), F.lit(True))) == 1.0 and _one(spark, E.edge_weight(F.lit(200), F.lit(None).cast("boolean"))) == 0.2
    assert _one(spark, E.smaller_after_oom(F.lit("timeout"), F.lit(2000))) is None and _one(spark, E.smaller_after_failure(F.lit(1), F.lit("timeout"), F.lit("timeout"), F.lit(1600))) == 1200
    assert tuple(_one(spark, E.simplification(F.lit(750_000), F.lit(10)))) == (False, None, None) and _one(spark, E.simplification(F.lit(150_000), F.lit(1 << 30))).target_faces == 100_000
    assert [_one(spark, E.masked(F.lit(7), F.lit(m), 9)) for m in (1, 0)] == [7, 9] and [_one(spark, E.without_board(F.lit(m), F.lit(b))) for m, b in ((5, 0), (5, 3), (0, 0), (5, None))] == [255, 0, 0, 255]
    with pytest.raises(Exception, match="empty mask"):
        _one(spark, E.padded_box(*[F.lit(float(x)) for x in (1, 1, 0, 5, 50, 50)]))


def test_failure_categories(spark):
    rows = [("x Bad_Alloc", "failed", "cuda_oom", "resource"), ("launch timed out", "timeout", "timeout", "resource"), ("CUDA driver old", "failed", "capability", "subprocess"), ("unknown command", "failed", "runtime", "capability"), (None, "timeout", "timeout", "timeout"), (None, None, "runtime", "subprocess"), ("out of memory", "completed", "cuda_oom", None)]
    df = spark.createDataFrame(rows, "log string, status string, dense string, run string")
    for r in df.withColumns({"d": E.dense_failure_category("log", "status"), "f": E.failure_category("log", "status")}).collect():
        assert (r.d, r.f) == (r.dense, r.run), r


def test_z_scores_of_long_vectors(spark):
    """The mean and the deviation are worked out once a vector, not once an entry: 600 entries would take minutes."""
    v = [math.sin(i * i) * 10 for i in range(600)]
    df = spark.createDataFrame([(v,), ([2.0] * 600,), (None,)], "v array<double>")
    started = time.monotonic()
    got = [r.z for r in df.select(E.z_scores("v").alias("z")).collect()]
    assert time.monotonic() - started < 30
    mean = sum(v) / 600
    std = math.sqrt(sum((x - mean) ** 2 for x in v) / 600)
    assert got[0] == pytest.approx([(x - mean) / std for x in v]) and got[1:] == [[0.0] * 600, None]
