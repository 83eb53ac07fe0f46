"""Registered queries of the ordering engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import u64
from keyloom.operators import descriptors, heavy, order, plan_table, sorting, verify
from keyloom.plans import planner
from keyloom.plans.planner import Config
from keyloom.sources import datagen, modes

ROWS = 2000
SHIFT = 10
#: A sparse mask (bits 3-5 and 40) and the view of user_id that varies in it.
SPARSE = (1 << 40) | (7 << 3)
#: Thresholds low enough for the driver's tables.
LOCAL = Config(local_min_rows=256, local_min_passes=1, heap_rows=100_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, d, key="user_id"):
    return table(spark, d, "events").select("event_id", F.col(key).alias("key"))


def _mixed_sign(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") - 5000).alias("key"))


def _down(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.select("o_orderkey", (F.lit(1 << 20) - F.col("o_orderkey")).alias("key"))


def _skewed(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 < 9, F.lit(7).cast("long")).otherwise(F.col("user_id") + 1000).alias("key"))


def _sparse(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select("event_id", F.shiftleft(u.bitwiseAND(1), 40).bitwiseOR(F.shiftleft(F.shiftright(u, 1).bitwiseAND(7), 3)).alias("key"))


def global_descriptor(s, d):
    return descriptors.global_descriptor(table(s, d, "lineitem"), "l_orderkey")


def bucket_descriptors(s, d):
    return descriptors.bucket_descriptors(table(s, d, "lineitem"), "l_orderkey", SHIFT)


def bucket_descriptors_unsigned(s, d):
    return descriptors.bucket_descriptors(_mixed_sign(s, d), "key", 51)


def bucket_descriptors_signed(s, d):
    return descriptors.bucket_descriptors(_mixed_sign(s, d), "key", 51, unsigned=False)


def bucket_descriptors_by_group(s, d):
    return descriptors.bucket_descriptors(table(s, d, "events").select("event_type", "user_id"), "user_id", 4, by=("event_type",))


def plan_mask(s, d):
    return descriptors.plan_mask(bucket_descriptors(s, d))


def order_scan_global(s, d):
    """Order of signed keys: those of orders beyond 2^20 are below 0."""
    scan = lambda df, pos, name: order.order_scan(df, "key", pos, unsigned=False).withColumn("input", F.lit(name))
    return scan(_events(s, d, "event_id"), "event_id", "events").unionByName(scan(_down(s, d), "o_orderkey", "orders")).unionByName(scan(_events(s, d), "event_id", "users"))


def order_scan_bucket(s, d):
    e = _events(s, d).withColumn("bucket", descriptors.bucket_of(F.col("key"), 4, 13))
    return order.order_scan(e, "key", "event_id", by=("bucket",))


def order_probe(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_id").alias("key"))
    return order.order_probe(e, "key", "event_id", e.count())


def slice_boundary_check(s, d):
    return order.slice_boundaries(_events(s, d), "key", "event_id")


def sort_positions_unsigned(s, d):
    return sorting.bucket_sort_positions(_mixed_sign(s, d), "key", "event_id")


def sort_positions_signed(s, d):
    return sorting.bucket_sort_positions(_mixed_sign(s, d), "key", "event_id", unsigned=False)


def bucket_sort_positions(s, d):
    return sorting.bucket_sort_positions(_events(s, d), "key", "event_id")


def adaptive_sort(s, d):
    return sorting.adaptive_sort(_down(s, d), "key", "o_orderkey")


def adaptive_sort_ascending(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") * 3).alias("key"))
    return sorting.adaptive_sort(e, "key", "event_id")


def adaptive_sort_mixed(s, d):
    return sorting.adaptive_sort(_events(s, d), "key", "event_id")


def order_shortcuts(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") * 3).alias("key"))
    rows = [("events", sorting.order_shortcut(e, "key", "event_id")), ("orders", sorting.order_shortcut(_down(s, d), "key", "o_orderkey")), ("users", sorting.order_shortcut(_events(s, d), "key", "event_id"))]
    return s.createDataFrame(rows, "input string, shortcut string")


def dispatch_sort(s, d):
    return sorting.dispatch_sort(_events(s, d), "key", "event_id", 4, cfg=LOCAL).drop("route")


def dispatch_sort_skewed(s, d):
    return sorting.dispatch_sort(_skewed(s, d), "key", "event_id", 6, cfg=LOCAL).drop("route")


def sort_frame(s, d):
    return sorting.sort_frame(_mixed_sign(s, d), "key", "event_id")


def scatter(s, d):
    """The partition that the plan's starts give each row, taken from where the row arrived."""
    e = _events(s, d)
    plan = descriptors.bucket_descriptors(e, "key", 4)
    return sorting.scatter(e, "key", plan, 4, 13, 5).select("event_id", "key", "bucket", F.spark_partition_id().cast("long").alias("part"))


def key_only_sort(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key")).orderBy("key")


def reverse_positions(s, d):
    o = _down(s, d)
    return sorting.reverse_positions(o, "o_orderkey", o.count())


def bucket_reverse_positions(s, d):
    return sorting.bucket_reverse_positions(_down(s, d), F.shiftright("o_orderkey", SHIFT), "o_orderkey")


def tuple_projection(s, d):
    e = _sparse(s, d)
    return e.select("event_id", u64.compress(F.col("key"), SPARSE).alias("sparse_index"), u64.compress(F.col("event_id"), 0b111100).alias("run_index"), u64.compress_by(F.col("key"), F.lit(SPARSE)).alias("row_index"))


def tuple_counting_sort(s, d):
    return sorting.tuple_counting_sort(_sparse(s, d), "key", "event_id", SPARSE)


def tuple_fit_plan(s, d):
    plan = descriptors.bucket_descriptors(table(s, d, "lineitem"), "l_orderkey", SHIFT).collect()  # at most 2^13 rows
    rows = [(r.bucket, r.n, r.rvb, planner.contiguous_shift(r.vbm & u64.MASK64), planner.tuple_fits(r.vbm & u64.MASK64, r.n)) for r in plan]
    return s.createDataFrame(rows, "bucket long, n long, rvb long, run_shift long, fits boolean")


def msd_shift_choice(s, d):
    r = global_descriptor(s, d).first()
    return s.createDataFrame([(r.vbm, planner.choose_shift(r.vbm & u64.MASK64))], "vbm long, msd_shift long")


def bucket_state(s, d):
    return plan_table.bucket_states(_events(s, d), "key", "event_id", 4).select("bucket", "n", "state")


def _plan(s, d):
    return plan_table.plan_table(_events(s, d), "key", "event_id", 4, cfg=LOCAL)


def bucket_plan(s, d):
    """The plan with its cycles as text, shift:mask in order."""
    text = F.array_join(F.transform("cycles", lambda c: F.concat(c["shift"].cast("string"), F.lit(":"), c["mask"].cast("string"))), ",")
    return _plan(s, d).withColumn("cycles", text)


def plan_statistics(s, d):
    return plan_table.plan_statistics(_plan(s, d))


def plan_flags(s, d):
    return plan_table.plan_flags(_plan(s, d), LOCAL)


def bucket_report(s, d):
    return plan_table.bucket_report(_plan(s, d))


def work_list(s, d):
    return plan_table.work_list(_plan(s, d))


def step_trace(s, d):
    return plan_table.step_trace(_plan(s, d), 3, stealing=False)


#: (mask, rows, options) of plans that are checked one by one.
CASES = [
    (0xFF, 5000, Config()), (0xFFF, 5000, Config()), (0xFFF, 4000, Config()), (0x3FF0, 2_000_000, Config()), (0x1F3878, 3_000_000, Config()), (0x1F3878, 5000, Config()),
    (0xFFFFFF, 3_000_000, Config()), (0xFFFFFF, 100, Config()), (0x8000000000000001, 100, Config()), (0x5555555555555555, 70_000, Config()), (u64.MASK64, 2_000_000, Config()),
    (0x5555555555555555, 70_000, Config(tuple_bits=16)), (0x5555555555555555, 70_000, Config(tuple_bits=16, stagger_cost=False)), (0x5555, 100, Config(packing=True)), (0x1111111111, 600, Config(lsd_bits=8)),
]


def cycle_plans(s, d):
    rows = []
    for k, (mask, n, cfg) in enumerate(CASES):
        c = planner.choose_cycles(mask, n, cfg)
        rows.append((k, ",".join(f"{m:X}" for _, m in c.passes), f"{c.tail:X}", c.score, planner.route(n, mask, "MIXED", cfg)))
    return s.createDataFrame(rows, "case_id int, passes string, tail string, score long, route string")


def local_splits(s, d):
    """Shift and bits of second-level splits for some sets of buckets."""
    wide, rows = u64.low_mask(50), []
    sets = [[(wide, 2_000_000, "MIXED"), (6, 2_000_000, "MIXED"), (wide, 70_000, "MIXED")], [(wide, 2_000_000, "MIXED")] * 3, [(wide, 2_000_000, "ASCENDING")], [(u64.low_mask(20) << 30, 1_500_000, "MIXED")]]
    for k, buckets in enumerate(sets):
        shifts, bits = planner.local_shifts(buckets, 9_000_000, False)
        rows += [(k, j, shift, bits) for j, shift in enumerate(shifts)]
    return s.createDataFrame(rows, "case_id int, bucket int, shift int, bits int")


def plan_scalars(s, d):
    """Scalar rules: window places, placement of tuples, sparse parents, widths, literals and timing figures."""
    rows = [(f"shifts {b}", " ".join(map(str, planner.shift_candidates(b)))) for b in (11, 12, 13, 16)]
    rows += [(f"in place {n} {k}", str(planner.tuple_in_place(n, k))) for n, k in ((262_144, 0), (262_145, 15), (262_145, 16))]
    rows += [(f"sparse {n}", str(planner.sparse_parent(n, 8192))) for n in (0, 1, 1024, 1025)]
    rows += [(f"bits {c}", str(planner.local_bits(c))) for c in (0, 1, 3, 100, 9000)]
    rows += [(f"count {t}", " ".join(map(str, planner.parse_counts(t)))) for t in ("1k,2_000", "3..1:1", "5..9", "1m..3m:1m")]
    rows += [("candidates", str(len(planner.config_candidates())))]
    rows += [(f"timing {k}", f"{v:.6f}") for k, v in planner.summary([3.0, 1.0, 2.0, 4.0]).items()]
    return s.createDataFrame(rows, "rule string, result string")


def tiny_tier_histogram(s, d):
    plan = descriptors.bucket_descriptors(_events(s, d), "key", 1)
    tier = F.lit("radix8")
    for most, name in reversed(planner.TIERS):
        tier = F.when(F.col("n") < most, name).otherwise(tier)
    return plan.groupBy(tier.alias("tiny_tier")).agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("rows"))


def local_msd_children(s, d):
    return plan_table.local_children(_skewed(s, d), "key", 0, 13, 13, 4, 9)


def heavy_keys_exact(s, d):
    return heavy.heavy_keys(_skewed(s, d), "key")


def heavy_keys_approx(s, d):
    """Those keys of the sketch that have a tenth of the rows, which it never misses."""
    e = _skewed(s, d)
    return heavy.heavy_keys_approx(e, "key").filter(F.col("n") * 10 >= e.count())


def dominant_core_sort(s, d):
    return heavy.dominant_core_sort(_skewed(s, d), "key", "event_id")


def verify_sorted(s, d):
    e = _events(s, d)
    return verify.verify_sorted(sorting.bucket_sort_positions(e, "key", "event_id"), e, "key", "event_id")


def verify_pairing(s, d):
    """Generated records whose every hundredth key was changed: order, pairs and multisets fail."""
    g = datagen.generate(s, "SORTED", ROWS)
    out = g.withColumns({"out_pos": F.col("value"), "key": F.when(F.col("value") % 100 == 50, F.lit(0)).otherwise(F.col("key"))})
    return verify.verify_sorted(out, g, "key", "value", generated=g)


def checksums(s, d):
    return verify.checksums(_events(s, d), "key", "event_id")


def record_hashes(s, d):
    """Hashes of single records, as the checksums combine them."""
    e = _events(s, d)
    return u64.with_mixed(e, F.col("event_id"), "value_hash", u64.FMIX, 0).select("event_id", "value_hash")


def checksum_closed_forms(s, d):
    rows = [(n, u64.xor_below(n), u64.sum_below(n)) for n in (1, 2, 3, 1000, 4097)]
    return s.createDataFrame(rows, "n long, xor_below long, sum_below long")


def data_mode_catalog(s, d):
    return datagen.catalog(s)


def topology_example(s, d):
    return datagen.describe(s, "LOW_BITS_ONLY", ROWS).select("mode", "topology", "example", "varying")


def key_formatting(s, d):
    return _mixed_sign(s, d).select("event_id", u64.hex16(F.col("key")).alias("hex"))


_EV = "SELECT event_id, user_id AS key FROM events"
_MS = "SELECT event_id, event_id - 5000 AS key FROM events"
_DN = "SELECT o_orderkey, 1048576 - o_orderkey AS key FROM orders"
_SK = "SELECT event_id, CASE WHEN event_id % 10 < 9 THEN 7 ELSE user_id + 1000 END AS key FROM events"
_SP = "SELECT event_id, ((user_id & 1) << 40) | (((user_id >> 1) & 7) << 3) AS key FROM events"


def _buckets(source: str, key: str, bucket: str, low: str, by: str = "", name: str = "bucket", where: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""WITH x AS ({source}), g AS (SELECT {b}{bucket} AS b, count(*) AS n, bit_or({key}) AS o, bit_and({key}) AS a FROM x {where} GROUP BY ALL)
        SELECT {b}b AS {name}, coalesce(sum(n) OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n, o AS or_mask, a AS and_mask,
        CASE WHEN n > 1 THEN xor(o, a) & {low} ELSE 0 END AS vbm, bit_count(CASE WHEN n > 1 THEN xor(o, a) & {low} ELSE 0 END)::BIGINT AS rvb FROM g"""


def _class(source: str, pos: str, by: str = "", extra: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH x AS ({source}), l AS (SELECT {by + ', ' if by else ''}key, lag(key) OVER ({part}ORDER BY {pos}) AS b FROM x)
        SELECT {by + ', ' if by else ''}count(*)::BIGINT AS n, bool_and(b IS NULL OR b <= key) AS ascending, bool_and(b IS NULL OR b >= key) AS descending, bool_and(b IS NULL OR b > key) AS falling,
        CASE WHEN bool_and(b IS NULL OR b <= key) THEN 'ASCENDING' WHEN bool_and(b IS NULL OR b >= key) THEN 'DESCENDING' ELSE 'MIXED' END AS order_class{extra} FROM l {'GROUP BY ' + by if by else ''}"""


def _sorted(source: str, pos: str, unsigned: bool) -> str:
    k = "xor(key, (-9223372036854775808)::BIGINT)" if unsigned else "key"
    return f"SELECT *, row_number() OVER (ORDER BY {k}, {pos}) - 1 AS out_pos FROM ({source})"


_STATE = f"""WITH x AS ({_EV}), l AS (SELECT (key >> 4) & 8191 AS bucket, key, lag(key) OVER (PARTITION BY (key >> 4) & 8191 ORDER BY event_id) AS b FROM x),
    g AS (SELECT bucket, count(*) AS n, xor(bit_or(key), bit_and(key)) & 15 AS v, bool_and(b IS NULL OR b <= key) AS up, bool_and(b IS NULL OR b >= key) AS down FROM l GROUP BY bucket)
    SELECT bucket, n, CASE WHEN n <= 1 OR v = 0 THEN 'ALL_EQUAL' WHEN up THEN 'ASCENDING' WHEN down THEN 'DESCENDING' ELSE 'MIXED' END AS state FROM g"""

_W, _T = f"{1 << 64}::UHUGEINT", f"{1 << 63}::UHUGEINT"


def _fmix(rows: str, keep: str) -> str:
    """SQL that takes h (UHUGEINT) of rows through the hash's steps, to a signed h."""
    for shift, factor in u64.FMIX:
        x = f"xor(h, h >> {shift})"
        rows = f"SELECT {keep}, {f'({x} * {factor}::UHUGEINT) % {_W}' if factor else x} AS h FROM ({rows})"
    return f"SELECT {keep}, CASE WHEN h >= {_T} THEN (h::HUGEINT - {1 << 64}::HUGEINT)::BIGINT ELSE h::BIGINT END AS h FROM ({rows})"


_UNSIGNED = "(CASE WHEN {0} < 0 THEN {0}::HUGEINT + 18446744073709551616::HUGEINT ELSE {0}::HUGEINT END)::UHUGEINT"
_PLAN = f"""WITH x AS ({_EV}), l AS (SELECT (key >> 4) & 8191 AS bucket, key, lag(key) OVER (PARTITION BY (key >> 4) & 8191 ORDER BY event_id) AS b FROM x),
    g AS (SELECT bucket, count(*) AS n, bit_or(key) AS or_mask, bit_and(key) AS and_mask, bool_and(b IS NULL OR b <= key) AS up, bool_and(b IS NULL OR b >= key) AS down, bool_and(b IS NULL OR b > key) AS falling FROM l GROUP BY bucket),
    v AS (SELECT *, CASE WHEN n > 1 THEN xor(or_mask, and_mask) & 15 ELSE 0 END AS vbm FROM g),
    t AS (SELECT *, bit_count(vbm)::BIGINT AS rvb, coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        CASE WHEN n <= 1 OR vbm = 0 THEN 'ALL_EQUAL' WHEN up THEN 'ASCENDING' WHEN down THEN 'DESCENDING' ELSE 'MIXED' END AS state FROM v),
    f AS (SELECT *, state = 'MIXED' AND rvb >= 2 AND (1 << rvb) <= n AS fits FROM t),
    r AS (SELECT *, CASE WHEN state IN ('ALL_EQUAL', 'ASCENDING') THEN 'done' WHEN state = 'DESCENDING' THEN 'reverse' WHEN n < 128 THEN 'tiny' WHEN fits THEN 'tuple-direct' ELSE 'lsd' END AS route FROM f)
    SELECT bucket, start, n, or_mask, and_mask, vbm, rvb, state, falling, route,
        CASE WHEN route = 'tiny' THEN CASE WHEN n < 24 THEN 'insertion' WHEN n < 64 THEN 'binary_insertion' ELSE 'quick' END END AS tiny_tier,
        CASE WHEN state = 'MIXED' AND NOT fits THEN 1 ELSE 0 END AS n_cycles, CASE WHEN state = 'MIXED' AND NOT fits THEN log2(vbm)::INT || ':' || vbm ELSE '' END AS cycles,
        CASE WHEN fits THEN vbm ELSE 0 END AS tail_mask, CASE WHEN fits THEN rvb ELSE 0 END AS tuple_bits, CASE WHEN route = 'tuple-direct' THEN n <= 262144 OR (SELECT count(*) FROM r WHERE route = 'tuple-direct') >= 16 END AS tuple_in_place,
        -1 AS local_shift, 0 AS local_bits, n > 100000 AS off_heap, CASE WHEN fits THEN n + (1 << rvb) + (n >> 4) WHEN state = 'MIXED' THEN n + 2 ELSE 0 END AS score, route <> 'done' AS needs_work FROM r"""


def _report(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, round({n}::DOUBLE, 6) AS value FROM s" for n in names)


_STATS = """SELECT count(*) AS non_empty, count(*) FILTER (state = 'MIXED') AS mixed, count(*) FILTER (state = 'ALL_EQUAL') AS all_equal, count(*) FILTER (state = 'ASCENDING') AS ascending, count(*) FILTER (state = 'DESCENDING') AS descending,
    max(n) AS largest, count(*) FILTER (needs_work) AS needs_work, count(*) FILTER (route = 'tiny') AS tiny, count(*) FILTER (route = 'tuple-direct') AS tuple_direct, count(*) FILTER (route = 'lsd') AS lsd, count(*) FILTER (route = 'lsd-tuple-tail') AS lsd_tail,
    count(*) FILTER (local_shift >= 0) AS local_split, count(*) FILTER (off_heap) AS off_heap, sum(n_cycles)::BIGINT AS passes, sum(n)::BIGINT AS total"""
_NAMES_OF_STATS = "non_empty mixed all_equal ascending descending largest needs_work tiny tuple_direct lsd lsd_tail local_split off_heap passes total".split()

SQL = {
    "bucket_plan": _PLAN,
    "plan_flags": f"SELECT count(*) <= 1 AND NOT bool_or(needs_work) AS source_final, count(*) = 1 AS refine_in_source, bool_or(needs_work) AS needs_refinement, bool_or(needs_work) AND max(n) > 100000 AS needs_scratch FROM ({_PLAN})",
    "bucket_report": f"WITH p AS ({_PLAN}), s AS ({_STATS}, min(n) AS smallest, avg(n) AS mean, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99, bit_count(bit_or(vbm)) AS variable_bits FROM p) {_report([*_NAMES_OF_STATS, 'smallest', 'mean', 'p50', 'p90', 'p99', 'variable_bits'])}",
    "step_trace": f"""WITH w AS (SELECT bucket, route, n, n * greatest(1, n_cycles + CASE WHEN tail_mask <> 0 THEN 1 ELSE 0 END) AS cost FROM ({_PLAN}) WHERE needs_work),
        o AS (SELECT *, row_number() OVER (ORDER BY cost DESC, bucket) - 1 AS k FROM w)
        SELECT k::INT AS step, (k % 3)::INT AS worker, bucket, route, n, cost, sum(cost) OVER (PARTITION BY k % 3 ORDER BY k)::BIGINT AS clock FROM o""",
    "verify_pairing": f"SELECT {ROWS}::BIGINT AS n, {verify.ORDER | verify.PAIR | verify.MULTISET}::BIGINT AS failures, 50::BIGINT AS first_bad",
    "heavy_keys_approx": f"SELECT key, count(*) AS n FROM ({_SK}) GROUP BY key HAVING count(*) * 10 >= (SELECT count(*) FROM events)",
    "record_hashes": f"SELECT event_id, h AS value_hash FROM ({_fmix('SELECT event_id, event_id::UHUGEINT AS h FROM events', 'event_id')})",
    "global_descriptor": "SELECT count(*) AS n, bit_or(l_orderkey) AS or_mask, bit_and(l_orderkey) AS and_mask, 0::BIGINT AS n_null, xor(bit_or(l_orderkey), bit_and(l_orderkey)) AS vbm, bit_count(xor(bit_or(l_orderkey), bit_and(l_orderkey)))::BIGINT AS rvb FROM lineitem",
    "bucket_descriptors": _buckets("SELECT l_orderkey FROM lineitem", "l_orderkey", f"(l_orderkey >> {SHIFT}) & 8191", "1023"),
    "bucket_descriptors_unsigned": _buckets(_MS, "key", "(key >> 51) & 8191", str((1 << 51) - 1)),
    "bucket_descriptors_signed": _buckets(_MS, "key", "((key >> 51) + 4096) & 8191", str((1 << 51) - 1)),
    "bucket_descriptors_by_group": _buckets("SELECT event_type, user_id FROM events", "user_id", "(user_id >> 4) & 8191", "15", "event_type"),
    "plan_mask": f"SELECT bit_or(vbm) AS plan_vbm, max(n) AS largest, count(*) AS non_empty FROM ({_buckets('SELECT l_orderkey FROM lineitem', 'l_orderkey', f'(l_orderkey >> {SHIFT}) & 8191', '1023')})",
    "order_scan_global": " UNION ALL ".join(f"SELECT * FROM ({_class(q, p, '', f', {n!r} AS input')})" for q, p, n in (("SELECT event_id, event_id AS key FROM events", "event_id", "events"), (_DN, "o_orderkey", "orders"), (_EV, "event_id", "users"))),
    "order_scan_bucket": _class("SELECT event_id, user_id AS key, (user_id >> 4) & 8191 AS bucket FROM events", "event_id", "bucket"),
    "order_probe": f"SELECT order_class, n FROM ({_class('SELECT event_id, event_id AS key FROM events WHERE event_id < 2048 OR event_id % greatest(1, (SELECT count(*) FROM events) // 1024) = 0', 'event_id')})",
    "slice_boundary_check": f"""WITH x AS ({_EV}), l AS (SELECT event_id >> 10 AS slice, event_id, key, lag(key) OVER (ORDER BY event_id) AS b FROM x)
        SELECT slice, count(*) AS n, bool_and(CASE WHEN event_id & 1023 = 0 THEN b IS NULL OR b <= key ELSE true END) AS boundary_ok, bool_and(CASE WHEN event_id & 1023 = 0 THEN true ELSE b <= key END) AS ascending FROM l GROUP BY slice""",
    "sort_positions_unsigned": _sorted(_MS, "event_id", True),
    "sort_positions_signed": _sorted(_MS, "event_id", False),
    "bucket_sort_positions": _sorted(_EV, "event_id", True),
    "adaptive_sort": _sorted(_DN, "o_orderkey", True),
    "adaptive_sort_ascending": _sorted("SELECT event_id, event_id * 3 AS key FROM events", "event_id", True),
    "adaptive_sort_mixed": _sorted(_EV, "event_id", True),
    "order_shortcuts": "SELECT * FROM (VALUES ('events', 'ASCENDING'), ('orders', 'DESCENDING'), ('users', NULL)) t(input, shortcut)",
    "dispatch_sort": _sorted(_EV, "event_id", True),
    "dispatch_sort_skewed": _sorted(_SK, "event_id", True),
    "sort_frame": _MS,
    "scatter": f"""WITH g AS (SELECT key >> 4 AS bucket, count(*) AS n FROM ({_EV}) GROUP BY 1),
        p AS (SELECT bucket, (coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5 // (SELECT count(*) FROM events))::BIGINT AS part FROM g)
        SELECT event_id, key, bucket, part FROM ({_EV}) JOIN p ON bucket = key >> 4""",
    "key_only_sort": "SELECT user_id AS key FROM events",
    "reverse_positions": "SELECT o_orderkey, 1048576 - o_orderkey AS key, (SELECT count(*) FROM orders) - 1 - o_orderkey AS out_pos FROM orders",
    "bucket_reverse_positions": f"SELECT o_orderkey, 1048576 - o_orderkey AS key, o_orderkey >> {SHIFT} AS bucket, row_number() OVER (ORDER BY o_orderkey >> {SHIFT}, o_orderkey DESC) - 1 AS out_pos FROM orders",
    "tuple_projection": f"SELECT event_id, ((key >> 3) & 7) | ((key >> 40) & 1) * 8 AS sparse_index, (event_id >> 2) & 15 AS run_index, ((key >> 3) & 7) | ((key >> 40) & 1) * 8 AS row_index FROM ({_SP})",
    "tuple_counting_sort": f"SELECT event_id, key, ((key >> 3) & 7) | ((key >> 40) & 1) * 8 AS tuple_index, row_number() OVER (ORDER BY ((key >> 3) & 7) | ((key >> 40) & 1) * 8, event_id) - 1 AS out_pos FROM ({_SP})",
    "tuple_fit_plan": f"""WITH p AS ({_buckets('SELECT l_orderkey FROM lineitem', 'l_orderkey', f'(l_orderkey >> {SHIFT}) & 8191', '1023')}),
        q AS (SELECT *, CASE WHEN vbm = 0 THEN -1 ELSE (SELECT min(k) FROM range(0, 64) t(k) WHERE (vbm >> k::INTEGER) & 1 = 1) END AS z FROM p),
        r AS (SELECT *, CASE WHEN z < 0 THEN -1 WHEN ((vbm >> z::INTEGER) & ((vbm >> z::INTEGER) + 1)) = 0 THEN z ELSE -1 END AS run_shift FROM q)
        SELECT bucket, n, rvb, run_shift, rvb BETWEEN 2 AND 16 AND (1 << rvb) <= n AND (rvb <= 9 OR (n <= 1048576 AND run_shift >= 0)) AS fits FROM r""",
    "msd_shift_choice": """WITH g AS (SELECT xor(bit_or(l_orderkey), bit_and(l_orderkey)) AS vbm FROM lineitem)
        SELECT vbm, CASE WHEN vbm >= 2251799813685248 OR vbm < 0 OR vbm = 0 THEN 51 ELSE coalesce((SELECT max(s) FROM (VALUES (38), (32), (25), (16), (12), (8), (0)) t(s) WHERE (vbm >> (s + 13)) = 0 AND (vbm >> s) & 8191 <> 0), 0) END::BIGINT AS msd_shift FROM g""",
    "bucket_state": _STATE,
    "plan_statistics": f"{_STATS} FROM ({_PLAN})",
    "work_list": f"SELECT row_number() OVER (ORDER BY n DESC, bucket) AS rank, bucket, n, route FROM ({_PLAN}) WHERE needs_work",
    "tiny_tier_histogram": "SELECT CASE WHEN n < 24 THEN 'insertion' WHEN n < 64 THEN 'binary_insertion' WHEN n < 128 THEN 'quick' WHEN n < 192 THEN 'three_way_quick' ELSE 'radix8' END AS tiny_tier, count(*) AS buckets, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM events GROUP BY (user_id >> 1) & 8191) GROUP BY 1",
    "local_msd_children": _buckets(_SK, "key", "(key >> 4) & 511", "15", "", "child", "WHERE (key >> 13) & 8191 = 0"),
    "heavy_keys_exact": f"SELECT key, count(*) AS n FROM ({_SK}) GROUP BY key HAVING count(*) >= greatest(2, (SELECT count(*) FROM events) // 1024)",
    "dominant_core_sort": _sorted(_SK, "event_id", True),
    "verify_sorted": "SELECT count(*) AS n, 0::BIGINT AS failures, NULL::BIGINT AS first_bad FROM events",
    "checksums": f"""WITH v AS ({_fmix('SELECT event_id, event_id::UHUGEINT AS h FROM events', 'event_id')}),
        k AS ({_fmix(f"SELECT event_id, xor({_UNSIGNED.format('user_id')}, (event_id::UHUGEINT * {verify.SEED}::UHUGEINT) % {_W}) AS h FROM events", 'event_id')})
        SELECT count(*) AS n, bit_xor(event_id) AS xor_value, sum(event_id)::BIGINT AS sum_value, (SELECT bit_xor(h) FROM v) AS xor_value_hash, (SELECT bit_xor(h) FROM k) AS xor_record_hash, min(key) AS min_key, max(key) AS max_key FROM ({_EV})""",
    "checksum_closed_forms": " UNION ALL ".join(f"SELECT {n}::BIGINT AS n, bit_xor(range) AS xor_below, sum(range)::BIGINT AS sum_below FROM range({n})" for n in (1, 2, 3, 1000, 4097)),
    "data_mode_catalog": datagen.catalog_sql(),
    "topology_example": f"""WITH k AS ({datagen.generate_sql("LOW_BITS_ONLY", ROWS)})
        SELECT 'LOW_BITS_ONLY' AS mode, 'LOW_BIT_ENTROPY' AS topology, '0x' || printf('%016X', (SELECT key FROM k WHERE value = {ROWS // 2})) AS example, '0x' || printf('%016X', xor(bit_or(key), bit_and(key))) AS varying FROM k""",
    "key_formatting": f"SELECT event_id, '0x' || printf('%016X', key) AS hex FROM ({_MS})",
}

def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(map(repr, rows))}) t({columns})"


#: What the rules give for cycle plans, worked out apart from the planner.
_CYCLE_PLANS = [
    (0, '', 'FF', 5568, 'tuple-direct'), (1, '', 'FFF', 9408, 'tuple-direct'), (2, 'FFF', '0', 8096, 'lsd'), (3, '3FF0', '0', 2001024, 'lsd'), (4, '1F3878', '0', 3191596, 'lsd'),
    (5, '1F3878', '0', 9408, 'lsd'), (6, 'FFF,FFF000', '0', 6008192, 'lsd'), (7, 'FFF,FFF000', '0', 8392, 'tiny'), (8, '', '8000000000000001', 110, 'tiny'),
    (9, '555555,555555000000', '5555000000000000', 231573, 'lsd-tuple-tail'), (10, 'FFF,FFF000,FFF000000,FFF000000000,FFF000000000000', 'F000000000000000', 12145496, 'lsd-tuple-tail'),
    (11, '55555555', '5555555500000000', 279822, 'lsd-tuple-tail'), (12, '55555555', '5555555500000000', 279822, 'lsd-tuple-tail'), (13, '5555', '0', 362, 'tiny'),
    (14, '111111111,1000000000', '0', 1751, 'lsd'),
]
#: What the rules give for local splits, worked out apart from the planner.
_LOCAL_SPLITS = [
    (0, 0, 37, 13), (0, 1, -1, 13), (0, 2, -1, 13), (1, 0, 39, 11), (1, 1, 39, 11), (1, 2, 39, 11), (2, 0, -1, 13), (3, 0, 37, 13),
]
#: What the rules give for plan scalars, worked out apart from the planner.
_PLAN_SCALARS = [
    ('shifts 11', '53 42 32 31 20 16 9 8 0'), ('shifts 12', '52 40 32 28 16 8 4 0'), ('shifts 13', '51 38 32 25 16 12 8 0'), ('shifts 16', '48 32 16 8 0'),
    ('in place 262144 0', 'True'), ('in place 262145 15', 'False'), ('in place 262145 16', 'True'), ('sparse 0', 'False'), ('sparse 1', 'True'), ('sparse 1024', 'True'),
    ('sparse 1025', 'False'), ('bits 0', '13'), ('bits 1', '13'), ('bits 3', '11'), ('bits 100', '6'), ('bits 9000', '1'), ('count 1k,2_000', '1000 2000'),
    ('count 3..1:1', '3 2 1'), ('count 5..9', '5 9'), ('count 1m..3m:1m', '1000000 2000000 3000000'), ('candidates', '108'), ('timing min', '1.000000'),
    ('timing median', '2.500000'), ('timing mean', '2.500000'), ('timing stddev', '1.290994'), ('timing max', '4.000000'), ('timing cv', '51.639778'), ('timing p95', '3.000000'),
    ('timing p99', '3.000000'),
]
SQL |= {
    "cycle_plans": _values("case_id, passes, tail, score, route", _CYCLE_PLANS),
    "local_splits": _values("case_id, bucket, shift, bits", _LOCAL_SPLITS),
    "plan_scalars": _values("rule, result", _PLAN_SCALARS),
}

_NAMES = list(SQL)


def queries() -> dict:
    out = {n: globals()[n] for n in _NAMES}
    for m in modes.MODES:
        out[f"gen_{m.lower()}"] = lambda s, d, m=m: datagen.generate(s, m, ROWS)
    return out


def oracle_sql() -> dict[str, str]:
    return SQL | {f"gen_{m.lower()}": datagen.generate_sql(m, ROWS) for m in modes.MODES}
