"""The 65 key topologies: a Column for Spark and a DuckDB expression for each.

In both, i is the row index, n the number of rows, m the mixed index; the SQL forms are
unsigned 128-bit integers below 2^64.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions import u64
from keyloom.functions.u64 import band, const, spread, spread_shift

TOP = 1 << 63


@dataclass(frozen=True)
class Mode:
    name: str
    topology: str
    key: Callable[[Column, Column, int], Column] | None
    sql: Callable[[int], str] | None
    #: What the mixer is fed with: "i", "i*G", "i^G", or "" if it isn't used.
    mixes: str = "i"
    rows: int | None = None


def _s(rank: str, count: int) -> str:
    """The SQL of an order-preserving spread."""
    return f"((({rank}) * {1 << spread_shift(count)}::UHUGEINT) % {1 << 64}::UHUGEINT)" if count > 1 else "0::UHUGEINT"


def _masked(bits: int, high: int = 0):
    return (lambda i, m, n: band(m, bits).bitwiseOR(const(high)) if high else band(m, bits)), (lambda n: f"((m & {bits}::UHUGEINT) | {high}::UHUGEINT)")


def _pick(even_sql: str, odd_sql: str) -> str:
    return f"(CASE WHEN i % 2 = 0 THEN {even_sql} ELSE {odd_sql} END)"


def _even(a, b):
    return lambda i, m, n: F.when(band(i, 1) == 0, a(i, m, n)).otherwise(b(i, m, n))


def _u(x: int) -> str:
    return f"{x}::UHUGEINT"


_lz_sql = "(64 - length(bin(CAST(m | 1::UHUGEINT AS UBIGINT))))"


def _lz(m: Column) -> Column:
    return u64.leading_zeros(m.bitwiseOR(F.lit(1).cast("long")))


def _div(i: Column, d: int) -> Column:
    return F.shiftright(i, d.bit_length() - 1)


def _modes() -> list[Mode]:
    out: list[Mode] = []

    def add(name, topology, key, sql, mixes="i", rows=None):
        out.append(Mode(name, topology, key, sql, mixes, rows))

    m_only = (lambda i, m, n: m), (lambda n: "m")
    sorted_ = (lambda i, m, n: spread(i, n)), (lambda n: _s("i", n))
    min_max = _even(lambda i, m, n: const(TOP), lambda i, m, n: const(TOP - 1)), lambda n: _pick(_u(TOP), _u(TOP - 1))
    top_bit = (lambda i, m, n: F.call_function("shiftleft", F.lit(1).cast("long"), (63 - _lz(m)).cast("int"))), (lambda n: f"(1::UHUGEINT << (63 - {_lz_sql})::UHUGEINT)")
    swap = lambda i, m, n: F.when(i.bitwiseXOR(band(m, 1023)) >= n, i).otherwise(i.bitwiseXOR(band(m, 1023)))
    add("RANDOM", "FULL_ENTROPY", *m_only)
    add("SORTED", "MONOTONIC", *sorted_, "")
    add("REVERSE", "MONOTONIC", lambda i, m, n: spread(F.lit(n - 1) - i, n), lambda n: _s(f"{n - 1} - i", n), "")
    add("NEARLY_SORTED", "MONOTONIC", lambda i, m, n: spread(swap(i, m, n), n), lambda n: _s(f"CASE WHEN xor(i, m & 1023::UHUGEINT) >= {n} THEN i ELSE xor(i, m & 1023::UHUGEINT) END", n))
    add("DUPLICATES", "DUPLICATE_HEAVY", lambda i, m, n: spread(band(m, (1 << 20) - 1), 1 << 20), lambda n: _s(f"m & {_u((1 << 20) - 1)}", 1 << 20))
    add("LOW_BITS_ONLY", "LOW_BIT_ENTROPY", *_masked(0xFFFFFFFF))
    add("HIGH_BITS_ONLY", "HIGH_BIT_ENTROPY", *_masked(0xFFFFFFFF00000000))
    add("ZIPFIANISH", "SKEWED_DISTRIBUTION", lambda i, m, n: F.shiftleft(_lz(m), 56).bitwiseOR(band(m, (1 << 56) - 1)), lambda n: f"(({_lz_sql}::UHUGEINT << 56) | (m & {_u((1 << 56) - 1)}))")
    add("ALL_EQUAL", "DUPLICATE_HEAVY", lambda i, m, n: const(0), lambda n: _u(0), "")
    add("EMPTY", "TRIVIAL", None, None, "", 0)
    add("SINGLE_ELEMENT", "TRIVIAL", lambda i, m, n: const(0), lambda n: _u(0), "", 1)
    add("TWO_ELEMENTS_SORTED", "TRIVIAL", lambda i, m, n: spread(i, 2), lambda n: _s("i", 2), "", 2)
    add("TWO_ELEMENTS_REVERSED", "TRIVIAL", lambda i, m, n: spread(F.lit(1) - i, 2), lambda n: _s("1 - i", 2), "", 2)
    add("SAWTOOTH", "OSCILLATING", lambda i, m, n: spread(band(i, 1023), 1024), lambda n: _s("i % 1024", 1024), "")
    add("ORGAN_PIPE", "STRUCTURED_MONOTONIC", lambda i, m, n: spread(F.when(i <= (n >> 1), i).otherwise(F.lit(n - 1) - i), (n >> 1) + 1), lambda n: _s(f"CASE WHEN i <= {n >> 1} THEN i ELSE {n - 1} - i END", (n >> 1) + 1), "")
    add("ROTATED_SORTED", "MONOTONIC", lambda i, m, n: spread((i + n // 3) % n, n), lambda n: _s(f"(i + {n // 3}) % {n}", n), "")
    add("PARTIALLY_SHUFFLED", "PARTIAL_DISORDER", lambda i, m, n: F.when(band(m, 15) == 0, m).otherwise(spread(i, n)), lambda n: f"(CASE WHEN m % 16 = 0 THEN m ELSE {_s('i', n)} END)")
    add("BLOCK_SORTED", "STRUCTURED_MONOTONIC", *sorted_, "")
    add("STAGGERED_RUNS", "STRUCTURED_MONOTONIC", lambda i, m, n: spread(_div(i, 64) * 64 + band(band(i, 63) * 7, 63), n), lambda n: _s("(i // 64) * 64 + ((i % 64) * 7) % 64", n), "")
    add("FEW_UNIQUE_VALUES", "DUPLICATE_HEAVY", *_masked(15))
    add("MANY_DUPLICATES_WITH_OUTLIERS", "COLLAPSED_WITH_OUTLIERS", lambda i, m, n: F.when(band(m, 1023) == 0, m).otherwise(band(m, 15)), lambda n: "(CASE WHEN m % 1024 = 0 THEN m ELSE m % 16 END)")
    add("ALTERNATING_LOW_HIGH", "OSCILLATING", _even(lambda i, m, n: spread(_div(i, 2), n), lambda i, m, n: spread(F.lit(n - 1) - _div(i, 2), n)), lambda n: _pick(_s("i // 2", n), _s(f"{n - 1} - i // 2", n)), "")
    add("MIN_MAX_ALTERNATING", "OSCILLATING", *min_max, "")
    add("NEGATIVE_VALUES", "SIGNED_BOUNDARY", *m_only)
    add("EXTREME_VALUES", "NUMERIC_BOUNDARY", *min_max, "")
    add("INTEGER_OVERFLOW_RISK", "NUMERIC_BOUNDARY", lambda i, m, n: const(TOP - 1) - i, lambda n: f"({_u(TOP - 1)} - i)", "")
    add("GAUSSIAN", "FULL_ENTROPY", lambda i, m, n: spread(band(m, 0xFFFF) + band(F.col("m2"), 0xFFFF), 1 << 17), lambda n: _s("(m & 65535::UHUGEINT) + (m2 & 65535::UHUGEINT)", 1 << 17), "i,i+1")
    add("EXPONENTIAL", "FULL_ENTROPY", lambda i, m, n: spread(_lz(m), 64), lambda n: _s(f"{_lz_sql}::UHUGEINT", 64))
    add("BIMODAL", "FULL_ENTROPY", lambda i, m, n: F.when(band(m, 1) == 0, spread(band(m, 0xFFFF), 1 << 16)).otherwise(spread(band(m, 0xFFFF) + (1 << 16), 1 << 17)), lambda n: f"(CASE WHEN m % 2 = 0 THEN {_s('m & 65535::UHUGEINT', 1 << 16)} ELSE {_s('(m & 65535::UHUGEINT) + 65536', 1 << 17)} END)")
    add("POWER_LAW", "SKEWED_DISTRIBUTION", *top_bit)
    add("DELAYED_ENTROPY", "DELAYED_ENTROPY", *_masked(0xFFFF, 0x123456789ABC0000))
    add("CLUSTERED_KEYS", "CLUSTERED_ENTROPY", lambda i, m, n: F.shiftleft(_div(i, 1024), 32).bitwiseOR(band(m, 0x3FF)), lambda n: "(((i // 1024) << 32) | (m & 1023::UHUGEINT))")
    add("BIT_REVERSAL", "LOCALITY_PATHOLOGICAL", lambda i, m, n: u64.reverse_bits(i), lambda n: "list_sum(list_transform(range(0, 40), lambda k: ((i >> k::UHUGEINT) & 1::UHUGEINT) * (1::UHUGEINT << (63 - k)::UHUGEINT)))::UHUGEINT", "")
    add("STRIDED", "STRUCTURED_ENTROPY", lambda i, m, n: u64.mul(i, u64.GOLDEN), lambda n: f"((i * {_u(u64.GOLDEN)}) % {_u(1 << 64)})", "")
    add("SPIKE_NOISE", "LOCALIZED_DISRUPTION", lambda i, m, n: F.when(band(i, 0xFFFF) == 0, m).otherwise(const(42)), lambda n: f"(CASE WHEN i % 65536 = 0 THEN m ELSE {_u(42)} END)")
    add("DESCENDING_BLOCKS", "STRUCTURED_MONOTONIC", lambda i, m, n: F.shiftleft(_div(i, 1024), 10).bitwiseOR(F.lit(1023) - band(i, 1023)), lambda n: "((i // 1024) * 1024 + (1023 - i % 1024))", "")
    add("DENSE_16BIT", "DENSE_LOCAL_DOMAIN", *_masked(0xFFFF))
    add("ENTROPY_BANDS", "STRUCTURED_ENTROPY", lambda i, m, n: F.when(band(_div(i, 1024), 1) == 0, i).otherwise(m), lambda n: "(CASE WHEN (i // 1024) % 2 = 0 THEN i ELSE m END)")
    add("TINY_PARTITIONS_STRESS", "REFINEMENT_STRESS", lambda i, m, n: F.shiftleft(band(i, 127), 32).bitwiseOR(band(m, 0xFFFFFFFF)), lambda n: f"(((i % 128) << 32) | (m & {_u(0xFFFFFFFF)}))")
    add("ALMOST_SORTED_WITH_SPIKES", "PARTIAL_DISORDER", lambda i, m, n: F.when(band(i, 0xFFFF) == 0, m).otherwise(spread(i, n)), lambda n: f"(CASE WHEN i % 65536 = 0 THEN m ELSE {_s('i', n)} END)")
    add("HIGH_BIT_ONLY_MOVING", "HIGH_BIT_ENTROPY", lambda i, m, n: F.shiftleft(band(m, 1), 63), lambda n: f"((m % 2) * {_u(TOP)})")
    add("ALTERNATING_BUCKET_DESTINATIONS", "LOCALITY_PATHOLOGICAL", _even(lambda i, m, n: const(0), lambda i, m, n: const(0xFF << 56)), lambda n: _pick(_u(0), _u(0xFF << 56)), "")
    add("EXTREME_DUPLICATE_DENSITY", "DUPLICATE_HEAVY", lambda i, m, n: F.element_at(F.array(*[const(0x1111111111111111 * k) for k in (1, 2, 3, 4)]), (band(m, 3) + 1).cast("int")), lambda n: f"((m % 4 + 1) * {_u(0x1111111111111111)})")
    add("WORST_CASE_MSD_COLLAPSE", "RADIX_PATHOLOGICAL", lambda i, m, n: F.when(i < n - 1000, const(1 << 60)).otherwise(m), lambda n: f"(CASE WHEN i::HUGEINT < {n - 1000} THEN {_u(1 << 60)} ELSE m END)")
    add("ENTROPY_OSCILLATION", "OSCILLATING", lambda i, m, n: F.when(band(_div(i, 64), 1) == 0, m).otherwise(const(0x1234567812345678)), lambda n: f"(CASE WHEN (i // 64) % 2 = 0 THEN m ELSE {_u(0x1234567812345678)} END)")
    add("SINGLE_BIT_TAIL_ENTROPY", "LOW_BIT_ENTROPY", *_masked(1, 0xCAFEBABE00000000))
    places = (0, 7, 13, 24, 31, 40, 52, 61)
    add("SPARSE_ENTROPY_EXPLOSION", "SPARSE_ENTROPY", lambda i, m, n: sum((F.shiftleft(band(F.shiftrightunsigned(m, k), 1), p) for k, p in enumerate(places) if k), band(m, 1)), lambda n: "(" + " + ".join(f"(((m >> {k}) % 2) << {p})" for k, p in enumerate(places)) + ")")
    add("TUPLE_31BIT_OVERFLOW", "TUPLE_PROJECTION", *_masked((1 << 31) - 1))
    add("CROSS_THREAD_BUCKET_SKEW", "PARALLEL_SKEW", lambda i, m, n: F.when(i < n * 95 // 100, const(0)).otherwise(m), lambda n: f"(CASE WHEN i < {n * 95 // 100} THEN {_u(0)} ELSE m END)")
    add("CACHE_THRASH", "LOCALITY_PATHOLOGICAL", *m_only, "i*G")
    add("SIGN_BIT_BOUNDARY", "SIGNED_BOUNDARY", lambda i, m, n: const(TOP) + i, lambda n: f"({_u(TOP)} + i)", "")
    add("PREFIX_CONSTANT_RANDOM_TAIL", "DELAYED_ENTROPY", *_masked(0xFFFFFF, 0xABCDEF1234000000))
    add("TUPLE_29BIT", "TUPLE_PROJECTION", *_masked((1 << 29) - 1))
    add("TUPLE_30BIT", "TUPLE_PROJECTION", *_masked((1 << 30) - 1))
    add("PERMUTATION_STRESS", "PERMUTATION_PATHOLOGY", *m_only, "i^G")
    add("HIGH_ENTROPY_PREFIX_CONSTANT_TAIL", "HIGH_BIT_ENTROPY", *_masked(u64.MASK64 ^ ((1 << 40) - 1), 0x123456789A))
    add("TWO_BUCKET_COLLISION", "BINARY_COLLISION", lambda i, m, n: F.when(band(m, 1) == 0, const(1 << 56)).otherwise(const(2 << 56)), lambda n: f"((m % 2 + 1) * {_u(1 << 56)})")
    add("LARGE_EQUAL_REGION_WITH_RANDOM_END", "COLLAPSED_WITH_OUTLIERS", lambda i, m, n: F.when(i < n - 8192, const(0x5555555555555555)).otherwise(m), lambda n: f"(CASE WHEN i::HUGEINT < {n - 8192} THEN {_u(0x5555555555555555)} ELSE m END)")
    add("RADIX_PATHOLOGICAL", "RADIX_PATHOLOGICAL", _even(lambda i, m, n: band(m, 0xFFFFFFFF), lambda i, m, n: band(m, 0xFFFFFFFF << 32)), lambda n: _pick(f"m & {_u(0xFFFFFFFF)}", f"m & {_u(0xFFFFFFFF << 32)}"))
    add("BIT_SPARSE_POWERLAW", "SKEWED_DISTRIBUTION", *top_bit)
    add("MICRO_CLUSTERS", "CLUSTERED_ENTROPY", lambda i, m, n: F.shiftleft(_div(i, 16), 8).bitwiseOR(band(m, 15)), lambda n: "((i // 16) * 256 + m % 16)")
    add("INTERLEAVED_SORTED_RANDOM", "STRUCTURED_MONOTONIC", _even(lambda i, m, n: spread(_div(i, 2), n), lambda i, m, n: m), lambda n: _pick(_s("i // 2", n), "m"))
    add("SAWTOOTH_DESCENDING", "OSCILLATING", lambda i, m, n: spread(F.lit(1023) - band(i, 1023), 1024), lambda n: _s("1023 - i % 1024", 1024), "")
    add("SINGLE_HOT_BUCKET", "REFINEMENT_STRESS", lambda i, m, n: F.when(band(m, 0xFFFF) == 0, m).otherwise(const(0x7777777777777777)), lambda n: f"(CASE WHEN m % 65536 = 0 THEN m ELSE {_u(0x7777777777777777)} END)")
    add("LOW_CARDINALITY_HIGH_VOLUME", "DUPLICATE_HEAVY", *_masked(7))
    return out


MODES = {m.name: m for m in _modes()}
#: Of each class: what its keys are like, and what a plan over their bits comes to.
CLASSES = {
    "FULL_ENTROPY": ("all bits vary independently", "many small mixed buckets, digit passes"),
    "MONOTONIC": ("one run from end to end, up or down, perhaps disturbed", "taken as it is or reversed, no sort"),
    "STRUCTURED_MONOTONIC": ("several runs laid end to end or into each other", "buckets that rise or fall by themselves"),
    "PARTIAL_DISORDER": ("an order with a share of rows out of place", "mixed buckets, few passes"),
    "LOCALIZED_DISRUPTION": ("an order broken at a few places", "mostly finished buckets"),
    "DUPLICATE_HEAVY": ("few different keys, each many times", "buckets of equal keys or a counting pass"),
    "COLLAPSED_WITH_OUTLIERS": ("nearly all keys equal, a few far away", "one dominant bucket, a core worth counting"),
    "SKEWED_DISTRIBUTION": ("frequencies that fall off steeply", "large buckets beside many small ones"),
    "PARALLEL_SKEW": ("nearly all rows in one bucket's range", "a second-level split, so that the work is shared"),
    "LOW_BIT_ENTROPY": ("only the lowest bits vary", "the window moves down until it splits"),
    "HIGH_BIT_ENTROPY": ("only the highest bits vary", "the top window leaves equal keys"),
    "DELAYED_ENTROPY": ("equal beginnings, varying ends", "a lower window, then few passes"),
    "SPARSE_ENTROPY": ("few varying bits, far apart", "packed passes instead of one pass a bit"),
    "STRUCTURED_ENTROPY": ("varying bits in bands", "a pass a band, or packed ones"),
    "CLUSTERED_ENTROPY": ("keys near a number of centres", "few buckets with short varying ends"),
    "DENSE_LOCAL_DOMAIN": ("all values of a small range", "a counting pass over the range"),
    "OSCILLATING": ("neighbours alternate between distant values", "no order to use, few buckets"),
    "BINARY_COLLISION": ("two beginnings only", "two large buckets"),
    "TUPLE_PROJECTION": ("bits of two fields with a gap between them", "packed or staggered passes with a tail"),
    "RADIX_PATHOLOGICAL": ("beginnings that don't split, or that split into too much", "a lower window or a second level"),
    "REFINEMENT_STRESS": ("very many tiny buckets", "insertion and other small sorts"),
    "LOCALITY_PATHOLOGICAL": ("neighbours that go to distant places", "an exchange without any locality"),
    "PERMUTATION_PATHOLOGY": ("a permutation without runs", "digit passes over all varying bits"),
    "SIGNED_BOUNDARY": ("keys on both sides of the sign", "signed and unsigned orders that differ"),
    "NUMERIC_BOUNDARY": ("least and greatest values", "few buckets at the very ends"),
    "TRIVIAL": ("no row, one, two, or all alike", "nothing to do"),
}
DEFAULT_ROWS = 100_000_000


def row_count(name: str, asked: int | None = None) -> int:
    """Rows of a mode: fixed for the trivial ones, otherwise as asked."""
    fixed = MODES[name].rows
    return fixed if fixed is not None else DEFAULT_ROWS if asked is None else asked


def parse_modes(text: str) -> list[str]:
    """Names from `all`, a comma list or a range A..B of ordinals, in either direction."""
    names = list(MODES)
    clean = lambda x: x.strip().upper().replace("-", "_")
    out: list[str] = []
    for part in text.split(","):
        if clean(part) == "ALL":
            out += names
        elif ".." in part:
            a, b = (names.index(clean(x)) for x in part.split("..", 1))
            out += names[a : b + 1] if a <= b else names[b : a + 1][::-1]
        elif clean(part) in MODES:
            out.append(clean(part))
        else:
            raise ValueError(f"unknown mode {part!r}")
    return out
