"""Substring deduplication with prefix-partitioned suffix trees.

The trees are sparse: of the suffixes of a text they hold those that begin at a sample, the
place of the 7-gram with the least hash in some window of 13 words, so that a passage is
sampled alike wherever it stands. A sampled suffix is dealt out by its prefix, the gram, and
carries its words up to the ends of the windows around it and the up to 6 words before it.
Grams that begin in one document only can't hold a repeat; a first pass that sends a hash
and a doc_id a gram leaves them out, and counts the others. Prefixes are of variable length:
where a gram begins too many suffixes for one task, it is lengthened to all the words of
each window around it, so its suffixes spread over many tasks.

A task works on some prefixes at a time: it sorts their suffixes, and the lengths of the
common prefixes of neighbours are the internal nodes of the subtree. With the common words
before them, a node and its samples are a maximal repeat (left extension and depth); it holds
every window that begins o words before the sample if the node is 13 - o or more deep and o
words before agree. Of such windows all but those of the smallest document are removed.

Hot passages: each task keeps, of equal segments, the one of the smallest document and
settles the others itself, so a passage arrives at its part once a task at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.grams import Words, batches, mix
from keyloom.llm.storage import discard, materialize, partitions

WINDOW, GRAM = 13, 7
#: Segments that a task gathers before it sends them on.
HELD = 1 << 16
#: Suffixes that are sorted in one step, and occurrences beyond which a gram is lengthened.
STEP, HOT = 1 << 19, 1 << 15
#: Most grams that are lengthened (8 bytes each, broadcast): those of the most occurrences.
LONGER = 1 << 20


def minimisers(w: Words, window: int, gram: int):
    """(gram hashes, place of the minimiser of each window, whether the window is whole)."""
    g = w.grams(gram)
    n = max(0, len(w) - window + 1)
    best, place = g[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        x = g[k : k + n]
        less = x < best
        best = np.where(less, x, best)
        place = np.where(less, np.arange(k, k + n), place)
    return g, place, w.room(window)[:n]


def buckets(spark, n_bytes: int) -> int:
    """Parts of about 8 MB of shipped words, and one a shuffle partition at least."""
    return max(partitions(spark), n_bytes // (8 << 20))


def pack_texts(rows: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and z, the text compressed for the way."""

    def run(batches_in):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches_in:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                z = pa.array([squeeze(t) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.record_batch([part.column("doc_id"), part.column("key"), z], names=["doc_id", "key", "z"])

    return rows.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, z binary")


def unpacked(column, most: int = 1 << 20):
    """(first row, texts) of a column of compressed texts, in parts of about `most` bytes."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    texts, size, at = [], 0, 0
    for z in column:
        t = expand(z.as_py())
        texts.append(t)
        size += len(t)
        if size >= most:
            yield at, texts
            at, texts, size = at + len(texts), [], 0
    if texts:
        yield at, texts


def to_documents(pa, parts: int, doc: np.ndarray, key: np.ndarray, *data: np.ndarray):
    """Columns (part, docs, keys, counts, then data) with a row for each part of documents.

    What belongs to one document and key is next to each other; counts says how much it is.
    """
    order = np.lexsort((key, doc, doc % parts))
    doc, key, data = doc[order], key[order], [x[order] for x in data]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.empty(0, int)
    counts = np.diff(np.append(first, len(doc)))
    ids, keys = doc[first], key[first]
    edges = np.searchsorted(ids % parts, np.arange(parts + 1))
    some = np.flatnonzero(np.diff(edges))
    ends = np.append(first, len(doc))
    blob = lambda x, a: pa.array([x[a[k] : a[k + 1]].tobytes() for k in some], pa.binary())
    return [pa.array(some), blob(ids, edges), blob(keys, edges), blob(counts, edges), *(blob(x, ends[edges]) for x in data)]


def gathered(rows: DataFrame, parts: int, columns: list[str]) -> DataFrame:
    """One row for each document and key: doc_id, key and its data (packed), from to_documents()."""

    def run(batches_in):
        import pyarrow as pa

        held: list[list[bytes]] = [[] for _ in range(3 + len(columns))]
        for b in batches_in:
            for x, c in zip(held, ["docs", "keys", "counts", *columns], strict=True):
                x += b.column(c).to_pylist()
        if not held[0]:
            return
        ids, keys, counts, *data = (np.frombuffer(b"".join(x), np.int64) for x in held)
        doc, key = np.repeat(ids, counts), np.repeat(keys, counts)
        order = np.lexsort((key, doc))
        doc, key, data = doc[order], key[order], [x[order] for x in data]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        edges = np.append(first, len(doc))
        for k in range(0, len(first), 4096):
            js = range(k, min(k + 4096, len(first)))
            yield pa.record_batch([pa.array(doc[first[k : k + 4096]]), pa.array(key[first[k : k + 4096]]), *(pa.array([x[edges[j] : edges[j + 1]].tobytes() for j in js], pa.binary()) for x in data)], names=["doc_id", "key", *columns])

    return rows.repartitionById(parts, F.col("part").cast("int")).mapInArrow(run, f"doc_id long, key long, {', '.join(f'{c} binary' for c in columns)}")


def repeated_grams(docs: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """Rows of to_documents() with grams (their hashes) that begin in two or more documents.

    Rows without docs have `grams` that occur more than HOT times, and how often in `many`.
    """
    names = ["part", "docs", "keys", "counts", "grams", "many"]

    def ship(batches_in):
        import pyarrow as pa

        for b in batches_in:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            hs, ds = [], []
            for at, texts in batches(b.column("text")):
                w = Words(texts)
                g, place, whole = minimisers(w, window, gram)
                p = np.unique(place[whole])
                hs.append(g[p])
                ds.append(ids[at + w.doc()[p]])
            if not hs:
                continue
            h, d = np.concatenate(hs), np.concatenate(ds).astype(np.int64)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.empty(0, bool)
            h, d = h[new], d[new]
            first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
            last = np.concatenate([first[1:], [True]]) if len(h) else first
            many = ~(first & last)
            # Grams of several documents of this batch are settled; one row tells the others.
            null = lambda n: pa.nulls(n, pa.binary())
            done = to_documents(pa, parts, d[many], np.zeros(many.sum(), np.int64), h[many].view(np.int64))
            yield pa.record_batch([*done, null(len(done[0]))], names=names)
            part = (h[first] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            hp, dp, mp, pp = h[first][order], d[first][order], many[first][order], part[order]
            edges = np.searchsorted(pp, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges))
            blob = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())  # noqa: E731, B023
            times = np.diff(np.append(np.flatnonzero(first), len(h))).astype("<i4")[order]
            small = lambda x: pa.array([squeezed(x[edges[k] : edges[k + 1]].tobytes()) for k in some], pa.binary())  # noqa: B023, E731
            # A gram of several documents here has its count, of one document a 0.
            yield pa.record_batch([pa.array(some), small(dp), null(len(some)), null(len(some)), blob(hp), small(np.where(mp, times, 0).astype("<i4"))], names=names)

    def settle(batches_in):
        import pyarrow as pa

        held: list[tuple[bytes, bytes, bytes]] = []
        for b in batches_in:
            done = b.filter(b.column("counts").is_valid())
            if done.num_rows:
                yield done
            rest = b.filter(b.column("counts").is_null())
            held += zip(*(rest.column(c).to_pylist() for c in ("grams", "docs", "many")), strict=True)
        if not held:
            return
        h = np.frombuffer(b"".join(x[0] for x in held), np.uint64)
        d = np.concatenate([np.frombuffer(expanded(x[1]), np.int64) for x in held])
        t = np.concatenate([np.frombuffer(expanded(x[2]), "<i4") for x in held])
        order = np.argsort(h, kind="stable")
        h, d, t = h[order], d[order], t[order]
        m = t > 0
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        spread = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.logical_or.reduceat(m, first)
        keep = np.repeat(spread, size) & ~m
        cols = to_documents(pa, parts, d[keep], np.zeros(keep.sum(), np.int64), h[keep].view(np.int64))
        yield pa.record_batch([*cols, pa.nulls(len(cols[0]), pa.binary())], names=names)
        times = np.add.reduceat(np.maximum(t, 1).astype(np.int64), first)
        hot = times > HOT
        none = pa.nulls(1, pa.binary())
        if hot.any():
            yield pa.record_batch([pa.array([0]), none, none, none, pa.array([h[first[hot]].tobytes()], pa.binary()), pa.array([times[hot].tobytes()], pa.binary())], names=names)

    kind = "part long, docs binary, keys binary, counts binary, grams binary, many binary"
    return docs.mapInArrow(ship, kind).repartitionById(parts, F.col("part").cast("int")).mapInArrow(settle, kind)


def hot_grams(found: DataFrame) -> np.ndarray:
    """The grams that are lengthened, sorted, from the rows of repeated_grams()."""

    def run(batches_in):
        import pyarrow as pa

        for b in batches_in:
            for g, t in zip(b.column("grams").to_pylist(), b.column("many").to_pylist(), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(g, np.int64)), pa.array(np.frombuffer(t, np.int64))], names=["gram", "times"])

    rows = found.filter(F.col("docs").isNull()).select("grams", "many").mapInArrow(run, "gram long, times long")
    # Which grams are lengthened only says where their suffixes are compared.
    return np.sort(np.array([r.gram for r in rows.orderBy(F.desc("times"), "gram").limit(LONGER).collect()], np.int64).view(np.uint64))


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def expanded(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of suffixes, rows of word codes from 0 (-1: past the end); lcp[k] is how many
    words the k-th of the order has in common with the one before it."""
    bits = max(1, int(words.max(initial=0) + 1).bit_length())
    each = max(1, 63 // bits)
    packed = []
    for k in range(0, words.shape[1], each):
        x = np.zeros(len(words), np.int64)
        for c in words[:, k : k + each].T:
            x = x << bits | (c.astype(np.int64) + 1)
        packed.append(x)
    order = np.lexsort(packed[::-1])
    w = words[order]
    same = np.logical_and.accumulate((w[1:] == w[:-1]) & (w[1:] >= 0), axis=1).sum(axis=1)
    return order, np.concatenate([[0], same]).astype(np.int64)[: len(words)]


def repeats_below(words: np.ndarray, left: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """hit[k, o]: the window that begins o words before sample k also begins in a smaller document.

    words: codes of the samples' suffixes; left[k, o]: a hash of the o words before; before and
    after: words that each sample carries on either side. A node of depth window - o that the
    order's lcp gives is split by the words before; its maximal repeats are those groups.
    """
    hit = np.zeros((len(words), left.shape[1]), bool)
    if not len(words):
        return hit
    order, lcp = suffix_order(words)
    for o in range(left.shape[1]):
        node = np.cumsum(lcp < window - o)
        k = np.flatnonzero((before[order] >= o) & (after[order] >= window - o))
        rows, node = order[k], node[k]
        if not len(rows):
            continue
        by = np.lexsort((left[rows, o], node))
        rows, node = rows[by], node[by]
        x = left[rows, o]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (x[1:] != x[:-1])]))
        least = np.repeat(np.minimum.reduceat(doc[rows], first), np.diff(np.append(first, len(rows))))
        hit[rows, o] = doc[rows] > least
    return hit


def repeated_windows(candidates: DataFrame, window: int, gram: int, parts: int, longer: np.ndarray) -> DataFrame:
    """doc_id, key, at and bits (packed): bit k of bits tells that the window at + k is repeated.

    candidates has doc_id, key, z (pack_texts) and grams (its repeated grams); longer are the
    grams whose windows are each dealt out by all their words.
    """
    names = ["part", "docs", "keys", "counts", "at", "bits", "lengths", "words"]
    shared = candidates.sparkSession.sparkContext.broadcast(longer)
    kind = "part long, docs binary, keys binary, counts binary, at binary, bits binary"

    def ship(batches_in):
        import pyarrow as pa

        held, count = [], 0
        for b in batches_in:
            ids, keys, grams = b.column("doc_id").to_numpy(), b.column("key").to_numpy(), b.column("grams")
            for at, texts in unpacked(b.column("z")):
                w = Words(texts)
                g, place, whole = minimisers(w, window, gram)
                owner = w.doc()
                known = [np.unique(np.frombuffer(x, np.uint64)) for x in grams.slice(at, len(texts)).to_pylist()]
                i = np.flatnonzero(whole)
                # Whether the window's gram is among its document's repeated ones.
                salt = np.arange(len(texts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                wanted = np.concatenate([x ^ y for x, y in zip(known, salt, strict=True)])
                i = i[np.isin(g[place[i]] ^ salt[owner[i]], wanted)]
                if not len(i):
                    continue
                p = place[i]
                long = member(g[p], shared.value)
                run = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1) | long[1:]]))
                n = np.diff(np.append(run, len(i)))
                a = i[run]
                d = owner[a]
                data = w.bytes
                lo, hi = w.start[a].tolist(), w.end[a + n + window - 2].tolist()
                to = np.where(long[run], w.grams(window)[a] if long.any() else 0, g[p[run]])
                # How far into its segment the sample lies is packed with the number of windows.
                held.append((ids[at + d], keys[at + d], a - w.first[d], n | (p[run] - a) << 8, to, [b" ".join(data[x:y].split()) for x, y in zip(lo, hi, strict=True)]))
                count += len(a)
                if count >= HELD:
                    yield from send(pa, held)
                    held, count = [], 0
        if held:
            yield from send(pa, held)

    def send(pa, held):
        doc, key, at, n, h = (np.concatenate([x[k] for x in held]) for k in range(5))
        segments = [s for x in held for s in x[5]]
        # Of equal segments, that of the smallest document is sent, the others are settled.
        least: dict[bytes, int] = {}
        for j in np.argsort(doc, kind="stable").tolist():
            least.setdefault(segments[j], j)
        done = doc > doc[np.array([least[s] for s in segments])]
        cols = to_documents(pa, parts, doc[done], key[done], at[done].astype(np.int64), ((1 << (n[done] & 255)) - 1).astype(np.int64))
        yield pa.record_batch([*cols, pa.nulls(len(cols[0]), pa.binary()), pa.nulls(len(cols[0]), pa.binary())], names=names)
        rest = np.flatnonzero(~done)
        part = (h[rest] % np.uint64(parts)).astype(np.int64)
        rest = rest[np.argsort(part, kind="stable")]
        edges = np.searchsorted(np.sort(part), np.arange(parts + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            js = rest[edges[k] : edges[k + 1]]
            rows.append((k, squeezed(doc[js].tobytes()), key[js].tobytes(), None, squeezed(at[js].astype(np.int64).tobytes()), None, squeezed(n[js].astype(np.int64).tobytes()), squeezed(b"\n".join([segments[j] for j in js]))))
        kinds = [pa.int64(), *[pa.binary()] * 7]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def pieces(words: bytes):
        """The words of a blob of segments, about 1 MB at a time."""
        at = 0
        while at < len(words):
            stop = words.find(b"\n", at + (1 << 19))
            stop = len(words) if stop < 0 else stop
            yield Words([words[at:stop]])
            at = stop

    def settle(batches_in):
        import pyarrow as pa

        held = []
        for b in batches_in:
            done = b.filter(b.column("counts").is_valid())
            if done.num_rows:
                yield done.select(names[:6])
            rest = b.filter(b.column("counts").is_null())
            held += zip(*(rest.column(c).to_pylist() for c in ("docs", "keys", "at", "lengths", "words")), strict=True)
        if not held:
            return
        doc, at, n = (np.concatenate([np.frombuffer(expanded(x[k]), np.int64) for x in held]) for k in (0, 2, 3))
        key = np.frombuffer(b"".join(x[1] for x in held), np.int64)
        words = np.concatenate([w.hash for x in held for w in pieces(expanded(x[4]))])
        del held
        n, sample = n & 255, n >> 8
        first = np.cumsum(n + window - 1) - (n + window - 1)
        begin = first + sample
        prefix = np.zeros(len(n), np.uint64)
        for k in range(gram):
            prefix = mix(prefix + words[begin + k])
        # Some prefixes at a time: none lies in two steps.
        order = np.argsort(prefix, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], prefix[order][1:] != prefix[order][:-1]]))
        edges = [0]
        for c in [*cuts[1:].tolist(), len(order)]:
            if c - edges[-1] >= STEP or c == len(order):
                edges.append(c)
        # A sample lies at most window - gram words into a window that holds its gram.
        most, bits = window - gram + 1, np.zeros(len(n), np.int64)
        for x, y in zip(edges, edges[1:]):
            rows = order[x:y]
            before, after = sample[rows], n[rows] + window - 1 - sample[rows]
            place = begin[rows][:, None] + np.arange(window)
            # Word codes are ranks of 64-bit hashes.
            code = np.unique(words[np.minimum(place, len(words) - 1)], return_inverse=True)[1].reshape(place.shape).astype(np.int32)
            code[np.arange(window) >= after[:, None]] = -1
            left = np.zeros((len(rows), most), np.uint64)
            for o in range(1, most):
                left[:, o] = mix(left[:, o - 1] + words[np.maximum(begin[rows] - o, 0)])
            hit = repeats_below(code, left, before, after, doc[rows], window)
            for o in range(most):
                some = hit[:, o] & (before >= o) & (before - o < n[rows])
                bits[rows[some]] |= np.int64(1) << (before[some] - o)
        some = bits != 0
        yield pa.record_batch(to_documents(pa, parts, doc[some], key[some], at[some], bits[some]), names=names[:6])

    rows = candidates.mapInArrow(ship, f"{kind}, lengths binary, words binary")
    found = rows.repartitionById(parts, F.col("part").cast("int")).mapInArrow(settle, kind)
    return gathered(found, parts, ["at", "bits"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, key, n_words, n_removed, kept_sha256 and, where words go, kept_text and spans.

    docs has doc_id and text; other columns are ignored. Every word that lies in a window of
    `window` words whose sequence also begins in a text with a smaller doc_id is removed;
    windows are judged on the input. spans are the removed stretches (word numbers from 0).
    Null and empty texts have no words. Rows with equal ids are not smaller than each other,
    and a row with a null id has no order: it keeps its words and takes no one's. Repeated
    rows give repeated results. kept_text is null where all words stay, and without `texts`.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = buckets(spark, size)
    found = materialize(repeated_grams(rows.filter(F.col("doc_id").isNotNull()), window, gram, parts), "grams")
    longer = hot_grams(found)
    grams = gathered(found.filter(F.col("docs").isNotNull()).drop("many"), parts, ["grams"]).select("doc_id", "grams")
    candidates = materialize(pack_texts(rows).join(grams, "doc_id"), "candidates")
    places = materialize(repeated_windows(candidates, window, gram, parts, longer), "places")
    discard(found)

    def shorten(batches_in):
        import pyarrow as pa

        for b in batches_in:
            found = list(zip(b.column("at").to_pylist(), b.column("bits").to_pylist(), strict=True))
            for at, parts_in in unpacked(b.column("z")):
                w = Words(parts_in)
                out = []
                for k, (a, bits) in enumerate(found[at : at + len(parts_in)]):
                    first, n = int(w.first[k]), int(w.first[k + 1] - w.first[k])
                    a, bits = np.frombuffer(a, np.int64), np.frombuffer(bits, np.int64)
                    cover = np.zeros(n + 1, np.int64)
                    for j in range(window - gram + 1):
                        s = a[(bits >> j) & 1 == 1] + j
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + window, -1)
                    gone = np.cumsum(cover)[:n] > 0
                    stay = np.flatnonzero(~gone) + first
                    kept = b" ".join([w.bytes[x:y] for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)])
                    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                    spans = [{"start": int(x), "stop": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                    out.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept if texts else None, spans))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
                yield pa.record_batch([b.column("doc_id").slice(at, len(parts_in)), b.column("key").slice(at, len(parts_in)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    cut = candidates.select("doc_id", "key", "z").join(places, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    cut = cut.mapInArrow(shorten, "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>")
    # Built-ins give the whole texts' digests: words joined by one space.
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    plain = docs.select(
        F.col("doc_id").cast("long"),
        F.xxhash64(text).alias("key"),
        F.when(words == "", F.lit(0)).otherwise(F.char_length(words) - F.char_length(F.replace(words, F.lit(" "))) + 1).cast("long").alias("n_words"),
        F.sha2(words.cast("binary"), 256).alias("whole_sha256"),
    )
    cut = cut.select("doc_id", "key", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept_text"), "spans")
    return plain.join(cut, ["doc_id", "key"], "left").select(
        "doc_id", "key", "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        "kept_text", "spans",
    )
