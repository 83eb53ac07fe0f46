"""Hierarchical packing of documents into sequences of several lengths.

Documents are cut into full windows of the longest tier; what is left goes to the pool of
the smallest tier that holds it. Each tier is packed from its pool, and the gap that is left
in a window is filled from the pools of the shorter tiers, longest pieces first, and then
from its own, the last piece being cut to fit. So after every few hundred documents less
than one window is pending. What remains at the end of a partition is packed on its own, the
last sequence in windows of smaller tiers; partitions are packed alone, so no rows move.

The sequences of a tier, over all partitions, are then dealt in order to step groups whose
sizes differ by one sequence at most. Numbers of sequences a partition and tier are all that
this needs, and they are joined to the written pieces.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.storage import materialize

TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP = 65_536
SCHEMA = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, tier int, tier_index long"
#: Most rows (of 40 bytes) of the table of partitions and tiers that is broadcast.
SMALL = 200_000


class Packer:
    """add() pieces, take finished ones from out; finish() packs what is pending.

    A piece is (doc_id, start, ids, doc_tokens) with ids as bytes, four a token.
    """

    def __init__(self, first_id: int, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.next, self.out, self.count = first_id, [], dict.fromkeys(self.tiers, 0)

    def _emit(self, tier: int, pieces: list) -> None:
        at, index = 0, self.count[tier]
        self.count[tier] += 1
        for doc, start, ids, whole in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, whole, self.next, at, tier, index))
            at += n
        self.next += 1

    def _route(self, piece) -> None:
        n = len(piece[2]) // 4
        self.pools[min(t for t in self.tiers if t >= n)].append(piece)

    def add(self, doc, ids: bytes) -> None:
        top, whole, n = self.tiers[0], len(ids) // 4, len(ids) // 4 // self.tiers[0]
        for k in range(n):
            self._emit(top, [(doc, k * top, ids[4 * k * top : 4 * (k + 1) * top], whole)])
        if whole % top:
            self._route((doc, n * top, ids[4 * n * top :], whole))

    @staticmethod
    def _cut(piece, n: int):
        doc, start, ids, whole = piece
        return (doc, start, ids[: 4 * n], whole), (doc, start + n, ids[4 * n :], whole)

    def pack(self) -> None:
        """Packs all but what doesn't fill a window of its tier: less than one longest window."""
        for k, tier in enumerate(self.tiers):
            pool = self.pools[tier]
            while pool:
                seq = [pool.popleft()]
                gap = tier - len(seq[0][2]) // 4
                for source in (*self.tiers[k + 1 :], tier):
                    while gap and self.pools[source]:
                        piece = self.pools[source].popleft()
                        if len(piece[2]) // 4 > gap:
                            piece, rest = self._cut(piece, gap)
                            self._route(rest)
                        seq.append(piece)
                        gap -= len(piece[2]) // 4
                if gap:
                    for piece in seq:
                        self._route(piece)
                    break
                self._emit(tier, seq)

    def pending(self) -> int:
        """Tokens in the pools."""
        return sum(len(p[2]) // 4 for pool in self.pools.values() for p in pool)

    def finish(self) -> None:
        self.pack()
        rest = [p for t in self.tiers for p in self.pools[t]]
        for t in self.tiers:
            self.pools[t].clear()
        left = sum(len(p[2]) // 4 for p in rest)
        rest = deque(rest)
        while left:
            tier = next((t for t in self.tiers if t <= left), self.tiers[-1])
            gap, seq = min(tier, left), []
            left -= gap
            while gap:
                piece = rest.popleft()
                if len(piece[2]) // 4 > gap:
                    piece, more = self._cut(piece, gap)
                    rest.appendleft(more)
                seq.append(piece)
                gap -= len(piece[2]) // 4
            self._emit(tier, seq)


def pack(df: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row for each piece of a document of df (doc_id, text), with its step group.

    Columns as in SCHEMA and step_group; tier is the sequence's full length, tier_index its
    number among the partition's of that tier. Every document is closed by id 0, so a null
    or empty text is that id alone; no piece is empty. Null ids and repeated rows are packed
    like others, further columns are ignored, and an empty table has no rows.
    """
    return grouped(materialize(pieces(df, tokenizer, tiers), "pieces"), step)


def grouped(packed: DataFrame, step: int = STEP) -> DataFrame:
    """packed (pieces() or a projection that has sequence_id, tier, tier_index), written, with step_group.

    A tier of s sequences has round(s * tier / step) groups, one at least, of s / groups
    sequences, rounded up or down; groups are numbered from 0 over the tiers, longest first.
    """
    part = F.shiftright("sequence_id", 32).alias("part")
    counts = packed.groupBy(part, "tier").agg((F.max("tier_index") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"before": before, "all": F.sum("n").over(Window.partitionBy("tier"))})
    counts = materialize(counts.withColumn("groups", F.greatest(F.round(F.col("all") * F.col("tier") / step), F.lit(1)).cast("long")), "counts")
    first, at = {}, 0
    for r in counts.select("tier", "groups").distinct().orderBy(F.desc("tier")).collect():  # one row a tier
        first[r.tier] = at
        at += r.groups
    base = F.coalesce(*[F.when(F.col("tier") == t, n) for t, n in first.items()], F.lit(0)).cast("long")
    counts = counts.select("part", "tier", "before", "all", "groups")
    table = F.broadcast(counts) if counts.count() <= SMALL else counts
    rows = packed.withColumn("part", part).join(table, ["part", "tier"])
    group = base + F.floor((F.col("before") + F.col("tier_index")) * F.col("groups") / F.col("all")).cast("long")
    return rows.withColumn("step_group", group).select(*packed.columns, "step_group")


def pieces(df: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """The pieces of pack() before their step groups are known, as in SCHEMA."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from keyloom.llm.tokens import encoder

        enc = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, tiers)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def taken():
            rows, packer.out = packer.out, []
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    packer.add(doc, ids + b"\0\0\0\0")
                packer.pack()
                if packer.out:
                    yield taken()
        packer.finish()
        if packer.out:
            yield taken()

    return df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
