"""Exact range splitters: the same rows give the same ranges, however they are dealt.

Sampled splitters depend on the order of the input. Here sizes are summed by leading bits of
the key, and only cells that hold a range's end and are too large to leave whole are summed
again by their next bits, so every pass gives a bounded number of sums and a few passes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most sums of a pass, and parts of a range beyond which a cell that holds its end is split.
CELLS, FINE = 1 << 18, 8
SIGN, TIE = 1 << 63, 32


def _bits(c: Column, above: int, n: int) -> Column:
    return F.call_function("shiftrightunsigned", c, F.lit(above)).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def dealt_by_range(df: DataFrame, narrow: DataFrame, parts: int, key: str, tie: str, size: str) -> DataFrame:
    """df with the column `to`, 0 .. parts - 1, ascending in (key, tie), null keys first.

    df has key (long) and tie (long, from 0 to 2^32 - 1); narrow has them and size, and is
    read once a pass. Ranges are of near equal sizes; rows of one key and tie stay together.
    """
    total, low, high = narrow.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.min(key), F.lit(0)), F.coalesce(F.max(key), F.lit(0))).first()
    # Keys agree in all but their lowest `width` bits, of the view that orders them as unsigned.
    width = ((low + SIGN) ^ (high + SIGN)).bit_length()
    base = (low + SIGN) >> width << width
    known, k = F.col(key).isNotNull(), F.coalesce(F.col(key), F.lit(low))
    view, first = k.bitwiseXOR(F.lit(-SIGN)), min(width, (16 * parts).bit_length(), CELLS.bit_length() - 2)

    def prefix(depth: int) -> tuple[Column, Column]:
        """The leading bits of key and tie, `depth` in all."""
        page = k if depth >= width else _bits(view, width - depth, depth)
        return page.cast("long"), _bits(F.col(tie), TIE - max(0, depth - width), max(0, depth - width))

    def next_bits(depth: int, n: int) -> Column:
        return _bits(view, width - depth - n, n) if depth < width else _bits(F.col(tie), TIE - (depth - width) - n, n)

    def lengthened(depth: int, n: int, page: int, ties: int, c: int) -> tuple[int, int]:
        if depth >= width:
            return page, ties << n | c
        page = page << n | c
        return (page + base - SIGN if depth + n == width else page), ties

    fine = max(1, total // (parts * FINE))
    parents, depth, n, rows = [(False, 0, 0, 0), (True, 0, 0, 0)], 0, first, narrow
    ends, bounds = [total * j // parts for j in range(1, parts)] if total else [], []
    if not first:
        parents = [(a, low, 0, 0) for a, *_ in parents]
    while ends:
        spark = df.sparkSession
        table = spark.createDataFrame([(j, a, page, ties) for j, (a, page, ties, _) in enumerate(parents)], "parent long, known boolean, page long, ties long")
        page, ties = prefix(depth)
        inside = rows.select(known.alias("known"), page.alias("page"), ties.alias("ties"), next_bits(depth, n).alias("cell") if n else F.lit(0).cast("long").alias("cell"), size)
        # At most as many parents as ranges.
        sums = inside.join(F.broadcast(table), ["known", "page", "ties"]).groupBy("parent", "cell").agg(F.sum(size).alias("s")).collect()
        split, left, at = [], [], dict(enumerate(x[3] for x in parents))
        if depth == 0:
            at[1] = sum(s for p, _, s in sums if p == 0)
        for p, c, s in sorted(sums):
            here = [e for e in ends if at[p] <= e < at[p] + s]
            cell = lengthened(depth, n, parents[p][1], parents[p][2], c) if n else parents[p][1:3]
            if here and s > fine and depth + n < width + TIE:
                split.append((parents[p][0], *cell, at[p]))
                left += here
            elif here:
                start = cell[0] if depth + n >= width else (cell[0] << (width - depth - n)) + base - SIGN
                bounds.append((parents[p][0], start, cell[1] << (TIE - max(0, depth + n - width))))
            at[p] += s
        depth, parents, ends = depth + n, split, left
        if ends:
            n = min((CELLS // len(split)).bit_length() - 1, 16, width - depth if depth < width else width + TIE - depth)
    bounds = sorted(set(bounds))
    # Each first cell with the number of bounds before it and its own bounds: 2^(first + 1) rows.
    number = lambda a, page: int(a) << first | ((page + SIGN) >> (width - first) & ((1 << first) - 1))
    own: dict[int, list] = {}
    for b in bounds:
        own.setdefault(number(*b[:2]), []).append(b)
    cells, count = [], 0
    for c in range(2 << first):
        cells.append((c, count, own.get(c, [])))
        count += len(own.get(c, []))
    marks = df.sparkSession.createDataFrame(cells, "__cell long, __before int, __own array<struct<a:boolean,k:long,t:long>>")
    cell = F.shiftleft(known.cast("long"), first).bitwiseOR(_bits(view, width - first, first) if first else F.lit(0).cast("long"))
    mine = F.struct(known.alias("a"), k.alias("k"), F.col(tie).alias("t"))
    out = df.withColumn("__cell", cell).join(F.broadcast(marks), "__cell")
    return out.withColumn("to", F.col("__before") + F.size(F.filter("__own", lambda x: x <= mine))).drop("__cell", "__before", "__own")
