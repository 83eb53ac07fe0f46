"""Exact n-gram Jaccard join of a corpus with itself.

A document is the set of its 4-word shingles as 64-bit hashes; documents with equal sets are
one node. Shingles are ordered by how frequent a count sketch of the whole corpus says they
are, frequent ones last. Two sets of Jaccard similarity t or more share a shingle among the
first n - ceil(t n) + 1 of either, so documents that share none are never compared. Groups
of nodes that share such a shingle, each distinct group once, are laid out in size-banded
tiles; there the bits that two hashed bitmap signatures differ in bound their overlap from
above, and of the pairs that pass a spanning forest is kept. Its components are the only
places where links can be. Each is a tile again, or several when it is large, with the
members' whole texts: sizes, then bitmaps, then exact intersections of the sorted arrays
decide, skipping pairs that are already connected.

A group or place that is larger than a tile is first dealt twice, by two hashes, each row
going to one tile a deal: what near copies make of it is one component, found with two rows
a member. Only rows outside the group's largest component then meet the others, in tiles of
two chunks of neighbouring size bands. No cut is made anywhere: every pair that can reach t
is either compared or connected by other links.

Nodes are named by a 64-bit hash of the set; among 10^9 distinct sets the chance of any two
with one name is 3 in 100.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.components import components
from keyloom.llm.grams import SPACE, Words, batches, mix
from keyloom.llm.storage import discard, keyed, materialize, partitions

N, PERCENT = 4, 85
#: Least 64-bit words of a bitmap; members, and shingles of all members, of a tile; counters of the sketch.
BITMAP, TILE, WEIGHT, SKETCH = 16, 1024, 1 << 20, 1 << 18
#: Most candidate ids (of 8 bytes) that are broadcast to fetch their texts.
SMALL = 200_000
#: Set members that are compared in one step.
CHUNK = 1 << 18


def shingle_sets(texts: list[bytes], n: int = N):
    """(hashes, first): the sorted distinct shingle hashes of each text, end to end.

    A text of fewer than n words, but not none, has its whole sequence as one shingle.
    """
    w = Words(texts, SPACE, lower=True)
    count = np.diff(w.first)
    g = w.grams(n)
    ok = np.flatnonzero(w.room(n))
    doc, h = w.doc()[ok], g[ok]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        x = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            x[has] = mix(x[has] + w.hash[w.first[short[has]] + k] + np.uint64(k + 1))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, x])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, bool)
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, as signed integers; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xD6E8FEB86659FD93)))])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix(sums[first[1:]] - sums[first[:-1]] + size), np.uint64(0)).view(np.int64)


def bitmaps(h: np.ndarray, first: np.ndarray, words: int = BITMAP) -> np.ndarray:
    out = np.zeros((len(first) - 1, words), np.uint64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bit = (h >> np.uint64(7)) % np.uint64(64 * words)
    np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def width(n: np.ndarray) -> np.ndarray:
    """Words of the bitmap of a set of n: a power of two that gives a bit a member or more,
    at which unlike sets still differ in too many bits."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64), BITMAP, 1024)


def own_bitmaps(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set's bitmap, as long as width() says."""
    size = np.diff(first)
    words = width(size)
    out: list[bytes] = [b""] * len(size)
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        for k in range(0, len(rows), max(1, (1 << 16) // w)):
            some = rows[k : k + max(1, (1 << 16) // w)]
            part = np.concatenate([h[first[r] : first[r + 1]] for r in some])
            for r, m in zip(some, bitmaps(part, np.concatenate([[0], np.cumsum(size[some])]), int(w)), strict=True):
                out[r] = m.tobytes()
    return out


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return (percent * n + 99) // 100


def frequency_sketch(docs: DataFrame, n: int, slots: int = SKETCH) -> np.ndarray:
    """Counts of all shingles of all documents in `slots` counters: a fixed 8 bytes a slot."""

    def count(parts):
        import pyarrow as pa

        total = np.zeros(slots, np.int64)
        for b in parts:
            for _, texts in batches(b.column("text")):
                w = Words(texts, SPACE, lower=True)
                h = w.grams(n)[w.room(n)]
                total += np.bincount((h >> np.uint64(40)).astype(np.int64) % slots, minlength=slots)
        if total.any():
            cut = slots // 64
            yield pa.record_batch([pa.array(range(64)), pa.array([total[k * cut : (k + 1) * cut].astype("<u4").tobytes() for k in range(64)], pa.binary())], names=["block", "counts"])

    def add(parts):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in parts:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(slots, np.int64)
    for r in docs.select("text").mapInArrow(count, "block long, counts binary").repartition(16, "block").mapInArrow(add, "block long, counts binary").collect():
        out[r.block * (slots // 64) : (r.block + 1) * (slots // 64)] = np.frombuffer(r.counts, np.int64)
    return out


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0 up to 8 times the mean counter, then one more for each doubling."""
    mean = max(1.0, counts.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / mean)) - 2).astype(np.uint8)


def shipped_shingles(docs: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Rows of documents (doc_id, text_hash, name, n, bitmap), and of prefix shingles by part.

    docs has doc_id, text_hash and text. A row is one or the other; of the second kind are
    part, tokens, owners and sizes, the shingles with the names and sizes of their sets.
    """
    classes = frequency_class(frequency_sketch(docs, n))
    slots = len(classes)
    kind = "part long, tokens binary, owners binary, sizes binary, doc_id long, text_hash long, name long, n long, bitmap binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def ship(batches_in):
        import pyarrow as pa

        for b in batches_in:
            tok, own, siz = [], [], []
            ids, keys = b.column("doc_id"), b.column("text_hash")
            for at, texts in batches(b.column("text")):
                h, first = shingle_sets(texts, n)
                name, size = set_names(h, first), np.diff(first)
                m = len(texts)
                null = pa.nulls(m, pa.binary())
                yield pa.record_batch([pa.nulls(m, pa.int64()), null, null, null, ids.slice(at, m), keys.slice(at, m), pa.array(name, mask=size == 0), pa.array(size.astype(np.int64)), pa.array(own_bitmaps(h, first), pa.binary())], names=names)
                row = np.repeat(np.arange(m), size)
                order = np.lexsort((mix(h), classes[(h >> np.uint64(40)).astype(np.int64) % slots], row))
                rank = np.arange(len(h)) - np.repeat(first[:-1], size)
                lead = order[rank < np.repeat(size - needed(size, percent) + 1, size)]
                tok.append(h[lead])
                own.append(name[row[lead]])
                siz.append(size[row[lead]])
            if not tok:
                continue
            tok, own, siz = np.concatenate(tok), np.concatenate(own), np.concatenate(siz).astype(np.int32)
            # Copies in a batch send their shingles once.
            order = np.lexsort((own, tok, tok % np.uint64(parts)))
            tok, own, siz = tok[order], own[order], siz[order]
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])]) if len(tok) else np.empty(0, bool)
            tok, own, siz = tok[new], own[new], siz[new]
            edges = np.searchsorted(tok % np.uint64(parts), np.arange(parts + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(edges))
            none = pa.nulls(len(some), pa.int64())
            yield pa.record_batch([pa.array(some), *(pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary()) for x in (tok, own, siz)), none, none, none, none, pa.nulls(len(some), pa.binary())], names=names)

    return docs.mapInArrow(ship, kind)


def prefix_groups(shipped: DataFrame, percent: int, parts: int) -> DataFrame:
    """(key, members): each distinct set of nodes that share a prefix shingle, once."""

    def group(batches_in):
        import pyarrow as pa

        members_t = pa.list_(pa.int64())
        tok, own, siz = [], [], []
        for b in batches_in:
            tok += b.column("tokens").to_pylist()
            own += b.column("owners").to_pylist()
            siz += b.column("sizes").to_pylist()
        tok, own, siz = (np.frombuffer(b"".join(x), t) for x, t in ((tok, np.uint64), (own, np.int64), (siz, np.int32)))
        order = np.lexsort((own, siz, tok))
        tok, own, siz = tok[order], own[order], siz[order]
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])]) if len(tok) else np.empty(0, bool)
        tok, own, siz = tok[new], own[new], siz[new].astype(np.int64)
        # A step between neighbouring sizes that no link can span parts a shingle's nodes.
        first = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (siz[:-1] < needed(siz[1:], percent))])) if len(tok) else np.empty(0, int)
        size = np.diff(np.append(first, len(tok)))
        seen: dict[bytes, np.ndarray] = {}

        def rows():
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), members_t)], names=["key", "members"])

        held = 0
        for a, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            m = own[a : a + k]
            key = hashlib.blake2b(m.tobytes(), digest_size=16).digest()
            if key not in seen:
                seen[key] = m
                held += k
            if held > 1 << 17:
                yield rows()
                seen, held = {}, 0
        if seen:
            yield rows()

    rows = shipped.filter(F.col("part").isNotNull()).select("part", "tokens", "owners", "sizes")
    found = rows.repartitionById(parts, F.col("part").cast("int")).mapInArrow(group, "key binary, members array<long>")
    return found.groupBy("key").agg(F.first("members").alias("members"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows (key, k, name and others) with their tiles: a group is one tile, or k tiles of each of two deals."""
    deals = [F.xxhash64("key", F.lit(d), F.pmod(F.xxhash64("name", F.lit(d)), F.col("k"))) for d in (1, 2)]
    return rows.withColumn("tile", F.explode(F.when(F.col("k") <= 1, F.array(F.xxhash64("key"))).otherwise(F.array(*deals))))


def across(rows: DataFrame, found: DataFrame, percent: int, tile: int) -> DataFrame:
    """The rows of large groups that are still in several components, with tiles and root.

    rows as in dealt(), with n; found has node and root. A group's largest component is cut
    into chunks, and so is the rest, by bands of sizes, a band being as wide as partners'
    sizes can differ. Tiles are pairs of chunks of one band or of neighbouring ones, but not
    of two chunks of the largest component.
    """
    rows = rows.filter("k > 1").join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    per = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", "c").alias("major"), F.count(F.lit(1)).alias("roots"))
    wide = -math.log(percent / 100) * (1 + 1e-9)
    rest = rows.join(per.filter("roots > 1").drop("roots"), "key").withColumns({"rest": F.col("root") != F.col("major"), "band": F.floor(F.log(F.col("n").cast("double")) / wide).cast("long")})
    spot = ["key", "rest", "band"]
    cut = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / WEIGHT)).cast("long")
    chunks = rest.groupBy(*spot).agg(cut.alias("cuts"))
    each = chunks.select(*spot, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("chunk"))
    x, y = (each.select("key", F.struct("band", "rest", "chunk").alias(c)) for c in "xy")
    ahead = F.col("y.band") - F.col("x.band")
    pairs = x.join(y, "key").filter((F.col("x.rest") | F.col("y.rest")) & ((ahead == 1) | ((ahead == 0) & (F.col("x") <= F.col("y")))))
    member = pairs.withColumn("tile", F.xxhash64("key", "x", "y")).select("key", "tile", F.explode(F.array_distinct(F.array("x", "y"))).alias("c")).select("key", "tile", "c.*")
    placed = rest.join(chunks, spot).withColumn("chunk", F.pmod(F.xxhash64("name", F.lit(3)), F.col("cuts")))
    return placed.join(member, [*spot, "chunk"]).drop("major", "rest", "band", "cuts", "chunk")


def linked(rows: DataFrame, payload: str, find, large: bool, parts: int, percent: int, tile: int) -> DataFrame:
    """(node, root) of the nodes of rows (key, k, name, n, payload) that find() links.

    find(names, sizes, payloads, roots) returns pairs of names; it gets a tile at a time, and
    pairs whose roots (None: unknown) are equal needn't be looked at. large: some k is above 1.
    """

    def run(batches_in):
        import pyarrow as pa

        u, v = [], []
        for names, sizes, payloads, roots in by_tile(batches_in, ["name", "n", payload, "root"]):
            for i, j in find(names, sizes, payloads, roots):
                u.append(i)
                v.append(j)
            if len(u) > 1 << 16:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def edges(tiles: DataFrame) -> DataFrame:
        return tiles.select("tile", "name", "n", payload, "root").repartition(parts, "tile").sortWithinPartitions("tile", "name").mapInArrow(run, "u long, v long")

    found = components(edges(dealt(rows).withColumn("root", F.lit(None).cast("long"))))
    if not large:
        return found
    more = materialize(edges(across(rows, found, percent, tile)), "links")
    if more.isEmpty():
        return found
    return components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def by_tile(batches_in, columns: list[str]):
    """The rows of each tile (sorted by it), as lists of columns."""
    held, now = [[] for _ in columns], None
    for b in batches_in:
        tiles = b.column("tile").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)] if len(tiles) else [0]
        values = [b.column(c).to_pylist() for c in columns]
        for a, z in zip(cuts, cuts[1:]):
            if now is not None and tiles[a] != now:
                yield held
                held = [[] for _ in columns]
            now = tiles[a]
            for x, v in zip(held, values, strict=True):
                x += v[a:z]
    if now is not None:
        yield held


class Forest:
    """Union-find over 0 .. n - 1, with the roots of all at hand as an array."""

    def __init__(self, roots: np.ndarray):
        """roots: rows of equal values are connected."""
        self.root = np.unique(roots, return_index=True, return_inverse=True)[1:]
        self.root = self.root[0][self.root[1]]

    def join(self, i: int, js: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[js], self.root[i]))
        self.root[np.isin(self.root, roots)] = roots[0]


def can_link(n_i, b_i, n, b, percent: int) -> np.ndarray:
    """Whether sizes and bitmaps allow the similarity: an upper bound of the overlap, from bit counts."""
    differ = np.bitwise_count(b ^ b_i).sum(axis=1, dtype=np.int64)
    overlap = np.minimum((n + n_i - differ) // 2, np.minimum(n, n_i))
    return (100 + percent) * overlap >= percent * (n + n_i)


class Folded:
    """Bitmaps of several lengths, sorted by set size, that are compared at the shorter's length.

    Lengths are powers of two, so the two halves of a bitmap, laid over each other, are the
    bitmap of half the length. Partners' sizes differ too little for more than one halving.
    """

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(m) // 8 for m in maps])
        self.at: dict[int, tuple[int, np.ndarray]] = {}
        for w in np.unique(self.words).tolist():
            a, z = np.searchsorted(self.words, w), np.searchsorted(self.words, w, "right")
            own = np.frombuffer(b"".join(maps[a:z]), np.uint64).reshape(z - a, w)
            y = np.searchsorted(self.words, 2 * w, "right")
            longer = np.frombuffer(b"".join(maps[z:y]), np.uint64).reshape(y - z, 2 * w)
            self.at[w] = int(a), np.concatenate([own, longer[:, :w] | longer[:, w:]])

    def rows(self, js: np.ndarray, i: int):
        """The bitmaps of rows js, and of i, in the length of the first of js."""
        a, maps = self.at[int(self.words[js[0]])]
        return maps[js - a], maps[i - a]


def candidate_forest(n: np.ndarray, maps: list[bytes], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of row numbers, a spanning forest of what sizes and bitmaps allow between unlike roots."""
    order = np.argsort(n, kind="stable")
    n = n[order]
    folded = Folded([maps[k] for k in order])
    forest, out = Forest(roots[order]), []
    low = np.searchsorted(n, needed(n, percent))
    for i in range(1, len(n)):
        js = np.arange(low[i], i)
        js = js[forest.root[js] != forest.root[i]]
        if not len(js):
            continue
        b, own = folded.rows(js, i)
        js = js[can_link(n[i], own, n[js], b, percent)]
        if len(js):
            # One pair for each component that it joins.
            js = js[np.unique(forest.root[js], return_index=True)[1]]
            out += [(int(order[i]), int(order[j])) for j in js]
            forest.join(i, js)
    return out


def exact_components(h: np.ndarray, first: np.ndarray, roots: np.ndarray, percent: int) -> np.ndarray:
    """The root (a row number) of each set among the sets that links or equal `roots` connect it to."""
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    # Longer sets get longer bitmaps here, where they needn't be sent.
    maps = bitmaps(h, first, min(256, max(BITMAP, 1 << int(size.max(initial=1) // 16).bit_length())))[order]
    kinds, code = np.unique(h, return_inverse=True)
    code = code.astype(np.int32)
    flag = np.zeros(len(kinds) + 1, np.uint8)
    n = size[order]
    start = np.concatenate([[0], np.cumsum(n)])
    code = np.concatenate([code[first[r] : first[r + 1]] for r in order]) if len(order) else code
    forest = Forest(roots[order])
    low = np.searchsorted(n, needed(n, percent))
    for i in range(1, len(n)):
        js = np.arange(low[i], i)
        js = js[forest.root[js] != forest.root[i]]
        if len(js):
            js = js[can_link(n[i], maps[i], n[js], maps[js], percent)]
        if not len(js):
            continue
        own = code[start[i] : start[i + 1]]
        flag[own] = 1
        # The overlaps of all candidates, some at a time: their sorted arrays against the marked one.
        overlap = np.empty(len(js), np.int64)
        ends = np.cumsum(n[js])
        at = 0
        while at < len(js):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - n[js[at]] + CHUNK, side="right")))
            k = n[js[at:stop]]
            edge = np.cumsum(k) - k
            place = np.repeat(start[js[at:stop]] - edge, k) + np.arange(k.sum())
            overlap[at:stop] = np.add.reduceat(flag[code[place]], edge, dtype=np.int64)
            at = stop
        flag[own] = 0
        links = js[(100 + percent) * overlap >= percent * (n[js] + n[i])]
        if len(links):
            forest.join(i, links)
    out = np.empty(len(n), np.int64)
    out[order] = order[forest.root]
    return out


def similar_components(docs: DataFrame, n: int = N, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Rows are linked when 100 * intersection >= percent * union of their shingle sets, and
    component_id is the smallest doc_id that links reach. A null, empty or blank text has an
    empty set and is alone; rows with equal sets are always linked. A null doc_id is never
    the smallest, so it names a component only if all ids in it are null. Repeated rows give
    repeated results, other columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(partitions(spark), size // (64 << 20))
    shipped = materialize(shipped_shingles(rows, n, percent, parts), "shingles")
    known = shipped.filter(F.col("part").isNull()).select("doc_id", "text_hash", "name", "n", "bitmap")
    # A node's text is read from its row of the smallest doc_id.
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = known.filter(F.col("name").isNotNull()).groupBy("name").agg(place.alias("at"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    nodes = materialize(nodes.select("name", F.col("at.doc_id").alias("least"), F.col("at.text_hash").alias("text_hash"), "n", "bitmap"), "nodes")
    groups = prefix_groups(shipped, percent, parts)

    def allowed(names, sizes, maps, roots):
        known_roots = names if roots[0] is None else roots
        return [(names[i], names[j]) for i, j in candidate_forest(np.array(sizes), maps, np.array(known_roots), percent)]

    def exact(names, sizes, texts, roots):
        at, held, arrays = 0, 0, []
        for k, t in enumerate(texts):
            held += len(t)
            if held >= 1 << 18 or k + 1 == len(texts):
                h, first = shingle_sets(texts[at : k + 1], n)
                arrays += np.split(h, first[1:-1])
                at, held = k + 1, 0
        first = np.cumsum([0, *map(len, arrays)])
        root = exact_components(np.concatenate(arrays), first, np.array(names if roots[0] is None else roots), percent)
        return [(names[k], names[r]) for k, r in enumerate(root.tolist()) if k != r]

    each = materialize(groups.select("key", F.ceil(F.size("members") / tile).cast("long").alias("k"), F.explode("members").alias("name")), "members")
    large = not each.filter("k > 1").isEmpty()
    places = linked(each.join(nodes.select("name", "n", "bitmap"), "name"), "bitmap", allowed, large, parts, percent, tile)

    # A place of links: all texts of its nodes go to its tiles.
    named = places.join(nodes.select(F.col("name").alias("node"), "least", "text_hash", "n"), "node")
    counted = named.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / WEIGHT)).cast("long").alias("k"))
    wanted = materialize(named.join(counted, "root").withColumnsRenamed({"node": "name", "root": "key"}), "wanted")
    near = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    texts = rows.join(near, rows["doc_id"].eqNullSafe(wanted["least"]) & (rows["text_hash"] == wanted["text_hash"])).select("key", "k", "name", "n", "text")
    if not known.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        # Rows that repeat both id and text count once.
        texts = texts.dropDuplicates(["name"])
    joined = linked(texts, "text", exact, not wanted.filter("k > 1").isEmpty(), parts, percent, tile)

    least = joined.join(nodes.select(F.col("name").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("reached"))
    reached = joined.join(least, "root").select(F.col("node").alias("name"), "reached")
    ids = materialize(nodes.select("name", "least").join(reached, "name", "left").select("name", F.least("least", "reached").alias("component_id")), "components")
    discard(each, wanted, places, joined, nodes)
    out = known.select("doc_id", "name", F.col("n").alias("n_shingles")).join(ids, "name", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Of each group of linked rows, the row with the smallest doc_id; all columns of docs.

    Rows are told apart by themselves, not by their ids: of rows that share the smallest id
    one stays, and a null id is larger than any other. Rows without words all stay.
    """
    rows = keyed(docs)
    found = similar_components(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), n, percent)
    ids = rows.select("key", F.col("row.doc_id").alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    kept = found.join(ids, found["doc_id"] == ids["key"]).groupBy("component_id").agg(best.alias("best")).select("best.key")
    return rows.join(kept, "key", "left_semi").select("row.*")
