"""Queries against DuckDB, topologies against plain Python, and properties of the operators."""

import os
import random

import pytest
from conftest import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom import queries as K
from keyloom.functions import u64
from keyloom.operators import descriptors, heavy, order, plan_table, sorting, verify
from keyloom.plans import planner
from keyloom.plans.planner import Config
from keyloom.sources import datagen, modes

DIR = "/root/testdata/sf0.001"
M = u64.MASK64
u64s = st.integers(0, M)


@pytest.mark.parametrize("name", [n for n in K.SQL])
def test_query_equals_duckdb(spark, oracle, name):
    assert same(K.queries()[name](spark, DIR), oracle(DIR).sql(K.SQL[name]))


def test_order_scan_of_keys_that_fall_below_zero(spark, oracle, tmp_path):
    c, name = oracle(DIR), "order_scan_global"
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    c.sql(f"COPY (SELECT * REPLACE (o_orderkey + 1048000 AS o_orderkey) FROM orders) TO '{tmp_path}/orders.parquet'")
    out = K.queries()[name](spark, str(tmp_path))
    assert same(out, oracle(tmp_path).sql(K.SQL[name]))
    assert out.filter("input = 'orders'").first().order_class == "DESCENDING"


def mix64(x):
    x = (x + u64.GOLDEN) & M
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def test_all_modes_equal_duckdb_at_small_sizes(spark, oracle):
    c = oracle(DIR)
    for name in modes.MODES:
        for n in (2, 1000):
            rows = sorted((r.value, r.key) for r in datagen.generate(spark, name, n, 2).collect())
            assert rows == sorted((v, k) for k, v in c.sql(datagen.generate_sql(name, n)).fetchall()), (name, n)


#: Global variable bits, unsigned order and distinct keys of some modes at 20,000 rows.
GOLDEN = {"RANDOM": ("FFFFFFFFFFFFFFFF", "MIXED", 20000), "SORTED": ("FFFE000000000000", "ASCENDING", 20000), "REVERSE": ("FFFE000000000000", "DESCENDING", 20000), "NEARLY_SORTED": ("FFFE000000000000", "MIXED", 12671), "ZIPFIANISH": ("0FFFFFFFFFFFFFFF", "MIXED", 20000), "GAUSSIAN": ("FFFF800000000000", "MIXED", 18144), "SPIKE_NOISE": ("E220A8397B1DCD85", "DESCENDING", 2), "CACHE_THRASH": ("FFFFFFFFFFFFFFFF", "MIXED", 20000), "SPARSE_ENTROPY_EXPLOSION": ("2010010081002081", "MIXED", 256), "MICRO_CLUSTERS": ("000000000007FF0F", "MIXED", 12865)}


@pytest.mark.parametrize("mode", GOLDEN)
def test_golden_topologies(spark, mode):
    df = datagen.generate(spark, mode, 20000)
    g = descriptors.global_descriptor(df, "key").first()
    vbm, kind, distinct = GOLDEN[mode]
    assert f"{g.vbm & M:016X}" == vbm and df.select("key").distinct().count() == distinct
    assert order.order_scan(df, "key", "value", slice_bits=8).first().order_class == kind


def test_descriptions(spark):
    assert {m.topology for m in modes.MODES.values()} <= set(modes.CLASSES)
    for mode in ("EMPTY", "ALL_EQUAL", "SORTED"):
        r = datagen.describe(spark, mode, 100).first()
        assert r.mode == mode and r.description and r.expected and (r.example is None) == (mode == "EMPTY")


def test_mixer_matches_python(spark):
    rows = datagen.generate(spark, "RANDOM", 500).collect()
    assert all(r.key & M == mix64(r.value) for r in rows)


@settings(max_examples=20, deadline=None)
@given(st.lists(u64s, min_size=1, max_size=20), u64s)
def test_wrapping_arithmetic(spark, xs, factor):
    df = spark.createDataFrame([(u64.signed(x),) for x in xs], "x long")
    rows = df.select("x", u64.mul(F.col("x"), factor).alias("m"), u64.add(F.col("x"), u64.const(factor)).alias("a"), u64.compress(F.col("x"), factor).alias("c"), u64.compress_by(F.col("x"), u64.const(factor)).alias("d")).collect()
    for r in rows:
        x = r.x & M
        bits = [b for b in range(64) if factor >> b & 1]
        packed = sum((x >> b & 1) << k for k, b in enumerate(bits))
        assert (r.m & M, r.a & M, r.c & M, r.d & M) == (x * factor & M, (x + factor) & M, packed, packed)


def expected(rows, unsigned):
    view = (lambda k: k & M) if unsigned else (lambda k: k)
    return {p: i for i, (_, p) in enumerate(sorted((view(k), p) for k, p in rows))}


@pytest.mark.parametrize("unsigned", [True, False])
@pytest.mark.parametrize("mode", ["RANDOM", "SIGN_BIT_BOUNDARY", "CROSS_THREAD_BUCKET_SKEW", "FEW_UNIQUE_VALUES", "ORGAN_PIPE", "EMPTY", "SINGLE_ELEMENT"])
def test_positions(spark, monkeypatch, mode, unsigned):
    monkeypatch.setattr(sorting, "LEAST", 50)
    monkeypatch.setattr(sorting, "SHARE", 8)
    df = datagen.generate(spark, mode, 2000)
    out = sorting.bucket_sort_positions(df, "key", "value", unsigned)
    got = {r.value: r.out_pos for r in out.collect()}
    assert got == expected([(r.key, r.value) for r in df.collect()], unsigned)
    assert verify.verify_sorted(out, df, "key", "value", unsigned=unsigned, slice_bits=4).first().failures == 0


def test_nulls_come_last(spark):
    df = spark.createDataFrame([(5, 0), (None, 1), (3, 2), (None, 3)], "key long, value long")
    assert {r.value: r.out_pos for r in sorting.bucket_sort_positions(df, "key", "value").collect()} == {2: 0, 0: 1, 1: 2, 3: 3}


def test_nested_hot_prefixes_are_split_until_they_fit(spark, monkeypatch):
    """Half of the rows share the top 13 bits, most of those the next, a third are one key, many are null."""
    monkeypatch.setattr(sorting, "LEAST", 40)
    monkeypatch.setattr(sorting, "SHARE", 64)
    r = random.Random(3)
    rows = []
    for i in range(6000):
        k = r.getrandbits(64)
        if i % 2:
            k = 0x1234 << 48 | k >> 16 if i % 8 == 1 else 0x1234_5678_9A << 24 | k >> 40 if i % 8 == 3 else 0x1234_5678_9ABC_DE << 8 | 7
        rows.append((None if i % 10 == 0 else u64.signed(k), i * 3 + (i > 4000) * 10**6))
    df = spark.createDataFrame(rows, "key long, value long").repartition(4)
    seen = []
    split = sorting._split_levels
    monkeypatch.setattr(sorting, "_split_levels", lambda *a: seen.append(split(*a)) or seen[-1])
    got = {x.value: x.out_pos for x in sorting.bucket_sort_positions(df, "key", "value").collect()}
    known = sorted((k & M, v) for k, v in rows if k is not None)
    want = {v: i for i, (_, v) in enumerate(known)} | {v: len(known) + i for i, v in enumerate(sorted(v for k, v in rows if k is None))}
    assert got == want
    parts, levels = seen[0]
    assert len(levels) > 3 and parts.groupBy(*levels).count().agg(F.max("count")).first()[0] <= max(40, len(known) // 64)


@pytest.mark.parametrize("shift", [4, 30, 51])
def test_dispatch_of_all_states(spark, shift):
    """Buckets that rise, fall with and without ties, hold one key, few bits or all kinds of keys."""
    r, rows, pos = random.Random(5), [], 0
    for b, make in enumerate([lambda i: i, lambda i: 300 - i, lambda i: 300 - i // 2, lambda i: 9, lambda i: r.randrange(4) * 3, lambda i: r.getrandbits(shift), lambda i: r.getrandbits(3)]):
        for i in range(300 if b < 6 else 60):
            rows.append((u64.signed((b * 1000 << shift & M) | (make(i) & u64.low_mask(shift))), pos))
            pos += 1
    df = spark.createDataFrame(rows, "key long, value long").repartition(3)
    cfg = Config(local_min_rows=100, local_min_passes=1, heap_rows=100)
    out = sorting.dispatch_sort(df, "key", "value", shift, cfg=cfg).collect()
    assert {x.value: x.out_pos for x in out} == expected(rows, True)
    assert len({x.route for x in out}) >= (4 if shift > 4 else 3)


def test_pair_bit(spark):
    g = datagen.generate(spark, "RANDOM", 300)
    out = sorting.bucket_sort_positions(g, "key", "value")
    assert verify.verify_sorted(out, g, "key", "value", generated=g).first().failures == 0
    other = datagen.generate(spark, "SORTED", 300)
    assert verify.verify_sorted(out, g, "key", "value", generated=other).first().failures == verify.PAIR
    with pytest.raises(AssertionError, match="PAIR"):
        verify.check_sorted(out, g, "key", "value", generated=other)


def test_plan_counts_all_rows(spark, monkeypatch):
    df = datagen.generate(spark, "RANDOM", 500)
    whole = plan_table.bucket_states
    monkeypatch.setattr(plan_table, "bucket_states", lambda *a: whole(*a).filter("bucket % 2 = 0"))
    with pytest.raises(ValueError, match="500"):
        plan_table.plan_table(df, "key", "value", 51)


def test_dominant_core(spark):
    df = spark.createDataFrame([(7 if i % 10 else 1000 + i, i) for i in range(3000)], "key long, value long")
    cfg = Config(core_divisor=100)
    assert heavy.dominant_core(df, "key", cfg=Config(core=False)) is None
    assert heavy.dominant_core(df, "key", cfg=cfg)["n"] == 2700
    got = {r.value: r.out_pos for r in heavy.dominant_core_sort(df, "key", "value", cfg=cfg).collect()}
    assert got == expected([(r.key, r.value) for r in df.collect()], True)


def broken(rows, how):
    rows = [list(r) for r in rows]
    if how == "swap":
        rows[10][2], rows[11][2] = rows[11][2], rows[10][2]
    elif how == "double":
        rows.append(rows[5])
    elif how == "loss":
        rows.pop(7)
    elif how == "key":
        rows[3][0] += 1
    elif how == "values":  # {0, 3} become {1, 2}: sum and xor stay
        rows = [[k, {0: 1, 3: 2}.get(v, v), o] for k, v, o in rows]
    return rows


@pytest.mark.parametrize("how", ["", "swap", "double", "loss", "key", "values"])
def test_verifier(spark, how):
    src = spark.createDataFrame([(i * 3, i) for i in range(100)], "key long, value long")
    rows = [(i * 3, i, i) for i in range(100)]
    df = spark.createDataFrame(broken(rows, how), "key long, value long, out_pos long")
    failures = verify.verify_sorted(df, src, "key", "value", slice_bits=3).first().failures
    assert bool(failures) == bool(how)
    if how == "values":
        assert not failures & (verify.XOR | verify.SUM) and failures & verify.MULTISET


def test_pairs(spark):
    g = datagen.generate(spark, "RANDOM", 100)
    assert verify.verify_pairs(g, g).count() == 0
    assert verify.verify_pairs(g.withColumn("key", F.when(F.col("value") == 5, 0).otherwise(F.col("key"))), g).count() == 1


@settings(max_examples=200, deadline=None)
@given(u64s, st.integers(2, 1 << 22), st.integers(4, 17))
def test_cycles_cover_the_mask_once(mask, size, width):
    cfg = Config(lsd_bits=width)
    plan = planner.choose_cycles(mask, size, cfg)
    parts = [m for _, m in plan.passes] + ([plan.tail] if plan.tail else [])
    assert sum(parts) == mask and all(a & b == 0 for k, a in enumerate(parts) for b in parts[:k])
    assert not plan.tail or planner.tuple_fits(plan.tail, size, cfg)
    assert all(s == planner.contiguous_shift(m) for s, m in plan.passes)


@settings(max_examples=50, deadline=None)
@given(st.lists(u64s, min_size=1, max_size=30), st.integers(0, M))
def test_tuple_index_keeps_order_in_a_bucket(keys, base):
    vbm = 0x00F0_0000_0F00_00FF
    inside = sorted((base & ~vbm & M) | (k & vbm) for k in keys)
    pext = [sum((k >> b & 1) << i for i, b in enumerate(b for b in range(64) if vbm >> b & 1)) for k in inside]
    assert pext == sorted(pext)


def test_routes_are_exclusive():
    cfg = Config()
    assert planner.route(0, 0, planner.state(0, 0, True, True), cfg) == "done"
    assert planner.route(9, 5, planner.state(9, 5, False, True), cfg) == "reverse"
    assert planner.route(100, 5, "MIXED", cfg) == "tiny"
    assert planner.route(5000, 0b1111, "MIXED", cfg) == "tuple-direct"
    assert planner.route(5000, M, "MIXED", cfg) in ("lsd", "lsd-tuple-tail")
    assert planner.shift_candidates() == [51, 38, 32, 25, 16, 12, 8, 0]
    assert planner.choose_shift(0xFF) == 0 and planner.choose_shift(M) == 51


def slow_plan(mask, n, cfg):
    """The planning rules once more, by strings of bits: (cycles as sets of bits, tail as a set)."""
    bits = [b for b in range(64) if mask >> b & 1]

    def fits(some):
        run = bool(some) and some == list(range(some[0], some[0] + len(some)))
        if not 1 < len(some) <= max(cfg.tuple_bits, cfg.contiguous_tuple_bits) or 2 ** len(some) > n:
            return False
        return len(some) <= cfg.tuple_bits or (len(some) <= cfg.contiguous_tuple_bits and n <= cfg.heap_rows and run)

    if fits(bits):
        return [], bits

    def windows():
        out = []
        for b in bits:
            if out and b - 1 == out[-1][-1] and len(out[-1]) < cfg.lsd_bits:
                out[-1].append(b)
            else:
                out.append([b])
        return out

    def packed(w):
        w = max(1, min(16, w))
        return [bits[k : k + w] for k in range(0, len(bits), w)]

    def cut(cycles):
        for k in range(1, len(cycles)):
            rest = [b for c in cycles[k:] for b in c]
            if fits(sorted(rest)):
                return cycles[:k], sorted(rest)
        return cycles, []

    def score(cycles):
        kept, tail = cut(cycles)
        odd = sum(c != list(range(c[0], c[0] + len(c))) for c in kept) + bool(tail)
        slots = sum(2 ** len(c) for c in kept) + (2 ** len(tail) if tail else 0)
        return (len(kept) + bool(tail)) * max(1, n) + slots + odd * max(1, n // 16)

    choice, least, count = windows(), score(windows()), len(windows())
    fewer = -(-len(bits) // cfg.lsd_bits)
    if cfg.packing or fewer < count:
        if cfg.packing or score(packed(cfg.lsd_bits)) < least:
            choice, least, count = packed(cfg.lsd_bits), score(packed(cfg.lsd_bits)), fewer
    top = min(cfg.stagger_bits, cfg.tuple_bits, 16)
    if cfg.stagger and top > cfg.lsd_bits and n >= cfg.stagger_min_rows:
        if cfg.stagger_cost:
            for w in range(cfg.lsd_bits + 1, top + 1):
                if score(packed(w)) < least:
                    choice, least = packed(w), score(packed(w))
            if top < len(bits) <= 2 * top and n >= 2**top:
                choice = packed(top)
        elif 0 < -(-len(bits) // top) < count:
            choice = packed(top)
    return cut(choice)


def test_plans_equal_the_rules():
    r = random.Random(11)
    configs = [Config(), Config(lsd_bits=8), Config(lsd_bits=12, tuple_bits=16), Config(tuple_bits=16, stagger_cost=False), Config(packing=True), Config(tuple_bits=16, stagger=False), Config(tuple_bits=14, stagger_min_rows=5000), Config(lsd_bits=17), Config(heap_rows=1000)]
    for k in range(6000):
        mask = r.getrandbits(64) & (r.getrandbits(64) if k % 2 else M) & (r.getrandbits(64) if k % 3 else M) >> r.randrange(0, 50)
        if k % 5 == 0:
            mask = u64.low_mask(r.randint(1, 30)) << r.randrange(0, 34) | 1 << r.randrange(64)
        n, cfg = r.choice([2, 100, 3000, 70_000, 1 << 20, 3_000_000, 2**31 - 1]), configs[k % len(configs)]
        cycles, tail = slow_plan(mask, n, cfg)
        plan = planner.choose_cycles(mask, n, cfg)
        assert [m for _, m in plan.passes] == [sum(1 << b for b in c) for c in cycles], (hex(mask), n, cfg)
        assert plan.tail == sum(1 << b for b in tail)
    plan = planner.choose_cycles(0x1F3878, 3_000_000, Config())
    assert not plan.tail and [m for _, m in plan.passes] == [0x1F3878]


def test_window_places_and_local_widths():
    assert planner.shift_candidates(13) == [51, 38, 32, 25, 16, 12, 8, 0]
    assert planner.shift_candidates(12) == [52, 40, 32, 28, 16, 8, 4, 0]
    assert planner.shift_candidates(11) == [53, 42, 32, 31, 20, 16, 9, 8, 0]
    assert planner.shift_candidates(40) == [24, 16, 8, 0]
    assert [planner.local_bits(c) for c in (0, 1, 2, 3, 100, 9000)] == [13, 13, 12, 11, 6, 1]
    assert planner.local_bits(5, Config(local_children=0)) == 13 and planner.local_bits(1, Config(local_bits=6)) == 6
    # Only eligible buckets share the children: here one of three large mixed ones.
    wide = u64.low_mask(50)
    shifts, bits = planner.local_shifts([(wide, 2_000_000, "MIXED"), (0b110, 2_000_000, "MIXED"), (wide, 70_000, "MIXED")], 9_000_000, False)
    assert (shifts, bits) == ([37, -1, -1], 13)
    assert planner.local_shifts([(wide, 2_000_000, "MIXED")], 9_000_000, False, Config(local=False))[0] == [-1]
    # The bound of contiguous tuples follows the scratch option.
    assert planner.tuple_fits(0x3FF0, 5000) and not planner.tuple_fits(0x3FF0, 5000, Config(heap_rows=4999))


def test_schedules():
    work = [(1, 5), (2, 9), (3, 1), (4, 4)]
    assert planner.schedule(work, 2) == [(0, 0, 2, 9, 9), (1, 1, 1, 5, 5), (2, 1, 4, 4, 9), (3, 0, 3, 1, 10)]
    assert [x[1] for x in planner.schedule(work, 2, stealing=False)] == [0, 1, 0, 1]
    assert [x[1] for x in planner.schedule(work, 3, batch=2)] == [0, 0, 1, 1]


def test_parsers_and_statistics():
    assert planner.parse_counts("1k,2_000,3..1:1,5..9") == [1000, 2000, 3, 2, 1, 5, 9]
    assert modes.parse_modes("sorted, nearly-sorted,REVERSE..SORTED") == ["SORTED", "NEARLY_SORTED", "REVERSE", "SORTED"]
    with pytest.raises(ValueError):
        modes.parse_modes("nonsense")
    assert len(modes.MODES) == 65 and modes.row_count("EMPTY", 9) == 0 and modes.row_count("RANDOM", 9) == 9
    s = planner.summary([3.0, 1.0, 2.0, 4.0])
    assert (s["median"], s["min"], s["p95"]) == (2.5, 1.0, 3.0)
    for n in range(1, 40):
        x = 0
        for k in range(n):
            x ^= k
        assert u64.xor_below(n) == x
    assert len(planner.config_candidates()) == 108


def test_descriptors_do_not_depend_on_partitions(spark):
    rows = [(random.Random(k).getrandbits(40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, value long")
    plans = [sorted(map(tuple, descriptors.bucket_descriptors(df.repartition(p), "key", 30).collect())) for p in (1, 3, 7)]
    assert plans[0] == plans[1] == plans[2]
    assert sum(r[2] for r in plans[0]) == 500


def test_plan_table_has_one_route_a_bucket(spark):
    df = datagen.generate(spark, "TINY_PARTITIONS_STRESS", 4000)
    plan = plan_table.plan_table(df, "key", "value", 30)
    rows = plan.collect()
    assert {r.route for r in rows} <= {"done", "reverse", "tiny", "tuple-direct", "lsd", "lsd-tuple-tail"}
    assert plan_table.plan_statistics(plan).first().total == 4000


def test_stream_descriptors(spark, tmp_path):
    from keyloom.streaming.descriptors import stream_descriptors

    spark.range(100).selectExpr("id * 3 AS key").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long").parquet(str(tmp_path / "in"))
    q = stream_descriptors(stream, "key", 4).writeStream.format("memory").queryName("descr").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.bucket: (r.n, r.or_mask, r.and_mask) for r in spark.table("descr").collect()}
    want = {r.bucket: (r.n, r.or_mask, r.and_mask) for r in descriptors.bucket_descriptors(spark.range(100).selectExpr("id * 3 AS key"), "key", 4).collect()}
    assert got == want


def test_entry_imports_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(K.queries())), "False"], said.stderr
