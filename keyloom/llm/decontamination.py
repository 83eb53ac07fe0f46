"""Benchmark decontamination with a distributed positional inverted index.

build_index stores the index once, for any tests: a row is a segment of some thousand texts
with its dictionary of terms (sorted word hashes), the length of each term's posting list and
the lists themselves (ascending positions over the segment's texts, which lie GAP apart). A
search takes corpus counts of the test terms from the dictionaries alone, orders the terms of
every test window from the rarest on, looks up the rarest term's list in each segment and
intersects it with the offset-adjusted lists of the others. Segments are searched where they
lie, so no text or list moves; test items come in broadcast blocks of bounded size, each of
which reads the one index again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.grams import MARKS, Words, batches
from keyloom.llm.storage import LARGE_ROWS, keyed, materialize

#: Words of a window, bytes of test text in a block (10 times as much is broadcast) and of
#: texts in a segment, and empty places between two texts of a segment.
WINDOW, BLOCK, SEGMENT, GAP = 10, 4 << 20, 4 << 20, 1 << 10
#: Most hit rows (of 8 bytes) whose keys are broadcast to leave them out.
SMALL = 1_000_000
INDEX = "segment long, doc_ids array<bigint>, n_words array<int>, terms binary, counts binary, positions binary"
MATCHES = "row long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<long>"


class Queries:
    """Windows of a block of test items, with term numbers from the sorted word hashes."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.items = np.array([i for i, _ in items], np.int64)
        w = Words([t for _, t in items], MARKS, lower=True)
        self.vocabulary = np.unique(w.hash)
        term = np.searchsorted(self.vocabulary, w.hash).astype(np.int32)
        n = np.diff(w.first)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + w.first[item] if len(item) else np.empty(0, np.int64)
        self.item, self.size = item, size[item] if len(item) else np.empty(0, np.int64)
        at = start[:, None] + np.arange(window)
        self.term = np.where(np.arange(window) < self.size[:, None], term[np.minimum(at, max(0, len(term) - 1))] if len(term) else 0, -1).astype(np.int32)

    def order(self, counts: np.ndarray):
        """Offsets of each window's terms from the rarest on; absent places come last."""
        c = np.where(self.term >= 0, counts[self.term], np.iinfo(np.int64).max)
        return np.argsort(c, axis=1, kind="stable").astype(np.int16), c.min(axis=1, initial=np.iinfo(np.int64).max)


def blocks(items: DataFrame, most: int = BLOCK):
    """(item_id, text) of the items, in lists of about `most` bytes; repeated rows once."""
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct().toLocalIterator():
        rows.append((r.item_id, bytes(r.text)))
        size += len(r.text)
        if size >= most:
            yield sorted(rows, key=lambda x: (x[0] is not None, x))
            rows, size = [], 0
    if rows:
        yield sorted(rows, key=lambda x: (x[0] is not None, x))


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text), as in INDEX; lists are in the order of terms.

    A segment is numbered by its first text: 33 bits count the texts of a task, the rest the
    tasks, so segment + place is a number of each text that has room for any table.
    """

    def run(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids, lengths, hashes, size = [], [], [], 0

        def segment():
            nonlocal number, ids, lengths, hashes, size
            n = np.concatenate(lengths)
            h = np.concatenate(hashes)
            base = np.cumsum(n + GAP) - (n + GAP)
            place = np.arange(len(h)) + np.repeat(base - (np.cumsum(n) - n), n)
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)
            lists = place[order].astype("<i8" if len(place) and place[-1] > 1 << 31 else "<i4")
            blob = lambda x: pa.array([x.tobytes()], pa.binary())
            cols = [pa.array([number]), pa.array([np.concatenate(ids).tolist()], pa.list_(pa.int64())), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), blob(terms), blob(counts.astype("<i4")), blob(lists)]
            number, ids, lengths, hashes, size = number + len(n), [], [], [], 0
            return pa.record_batch(cols, names=[x.split()[0] for x in INDEX.split(", ")])

        for b in parts:
            for at, texts in batches(b.column("text")):
                w = Words(texts, MARKS, lower=True)
                ids.append(np.array(b.column("doc_id").slice(at, len(texts)).to_pylist(), object))
                lengths.append(np.diff(w.first))
                hashes.append(w.hash)
                size += len(w.bytes)
                if size >= SEGMENT:
                    yield segment()
        if ids:
            yield segment()

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return materialize(docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, INDEX), "index", **LARGE_ROWS)


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings of each term over the whole index, from the dictionaries, summed in every task first."""
    terms = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts):
        import pyarrow as pa

        total = np.zeros(len(terms.value), np.int64)
        for b in parts:
            for known, counts in zip(b.column("terms"), b.column("counts"), strict=True):
                at, found = looked_up(np.frombuffer(known.as_py(), np.uint64), terms.value)
                total[found] += np.frombuffer(counts.as_py(), "<i4")[at[found]]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def looked_up(terms: np.ndarray, wanted: np.ndarray):
    """(place of each wanted term among the sorted terms, which of them are there)."""
    at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
    return at, (terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool))


class Lists:
    """The posting lists of the test terms in a segment; list t is flat[starts[t] : starts[t + 1]]."""

    def __init__(self, vocabulary: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, span: int):
        at, found = looked_up(terms, vocabulary)
        n = np.where(found, counts[at] if len(counts) else 0, 0).astype(np.int64)
        ends = np.cumsum(counts, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n)])
        first = np.where(found, (ends - counts)[at] if len(counts) else 0, 0)
        self.flat = positions[np.repeat(first - self.starts[:-1], n) + np.arange(self.starts[-1])].astype(np.int64)
        #: One ascending sequence of (term, position), so that all lists are searched at once.
        self.span = span
        self.keys = np.repeat(np.arange(len(n)) * span, n) + self.flat

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), bool)
        key = term.astype(np.int64) * self.span + place
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def between(self, term: np.ndarray, low: int, high: int) -> np.ndarray:
        """Postings of each term from low up to high."""
        edge = lambda p: np.searchsorted(self.keys, term * self.span + p)
        return edge(high) - edge(low)


def matches_of(queries: Queries, order: np.ndarray, live: np.ndarray, lists: Lists, near: int = 0, chunk: int = 1 << 18):
    """(window, first place) of all matches in one segment.

    live: windows whose terms all occur in the corpus. near=0 asks for exact phrases;
    otherwise all terms must lie, in any order, within the window's size and `near` words
    more, and the first place is where such a stretch begins.
    """
    rarest = queries.term[live, order[live, 0]]
    n = lists.starts[rarest + 1] - lists.starts[rarest]
    live, rarest, n = live[n > 0], rarest[n > 0], n[n > 0]
    out_w, out_p = [], []
    edges = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(live):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + chunk, side="right")) - 1)
        k = np.repeat(np.arange(at, stop), n[at:stop])
        anchor = lists.flat[lists.starts[rarest[k]] + np.arange(len(k)) - (edges[k] - edges[at])]
        window = live[k]
        at = stop
        if near:
            for w, a in zip(window.tolist(), anchor.tolist(), strict=True):
                kinds, need = np.unique(queries.term[w, : queries.size[w]], return_counts=True)
                width = int(queries.size[w]) + near
                for s in range(max(0, a - width + 1), a + 1):
                    if (lists.between(kinds.astype(np.int64), s, s + width) >= need).all():
                        out_w.append([w])
                        out_p.append([s])
                        break
            continue
        begin = anchor - order[window, 0]
        window, begin = window[begin >= 0], begin[begin >= 0]
        for j in range(1, queries.term.shape[1]):
            offset = order[window, j]
            want = queries.term[window, offset]
            # The list of the next rarest term, moved by its offset, must hold the place.
            keep = (want < 0) | lists.has(want, begin + offset)
            window, begin = window[keep], begin[keep]
        out_w.append(window)
        out_p.append(begin)
    return (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (out_w, out_p))


def search(index: DataFrame, queries: Queries, near: int = 0) -> DataFrame:
    """MATCHES: each text's merged word spans that lie in matches, and the items matched."""
    if near + queries.term.shape[1] > GAP:
        raise ValueError(f"a window with its room is at most {GAP} words")
    order, least = queries.order(term_counts(index, queries.vocabulary))
    live = np.flatnonzero((least > 0) & (queries.size > 0))
    shared = index.sparkSession.sparkContext.broadcast((queries, order, live, queries.size + near))

    def run(parts):
        import pyarrow as pa

        queries, order, live, reach = shared.value
        for b in parts:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                n = row["n_words"].values.to_numpy().astype(np.int64)
                base = np.concatenate([[0], np.cumsum(n + GAP)])
                counts, places = np.frombuffer(row["counts"].as_py(), "<i4"), row["positions"].as_py()
                places = np.frombuffer(places, "<i4" if len(places) == 4 * counts.sum(dtype=np.int64) else "<i8")
                lists = Lists(queries.vocabulary, np.frombuffer(row["terms"].as_py(), np.uint64), counts, places, int(base[-1]) + GAP)
                window, begin = matches_of(queries, order, live, lists, near)
                first = np.unique(begin)
                # The longest reach from each first place; spans that meet are one.
                last = np.zeros(len(first), np.int64)
                np.maximum.at(last, np.searchsorted(first, begin), begin + reach[window])
                far = np.maximum.accumulate(last) if len(last) else last
                new = np.concatenate([[True], first[1:] > far[:-1]]) if len(first) else np.empty(0, bool)
                start, stop = first[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)] if len(first) else first
                doc = np.searchsorted(base, start, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start - base[doc]), pa.array(np.minimum(stop - base[doc], n[doc]))], names=["start", "stop"])
                pair = np.unique(np.stack([np.searchsorted(base, begin, side="right") - 1, queries.item[window]]), axis=1)
                listed = lambda owner, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)), values)  # noqa: B023, E731
                for at in range(0, len(n), 4096):
                    m = min(4096, len(n) - at)
                    cols = [pa.array(row["segment"].as_py() + np.arange(at, at + m)), row["doc_ids"].values.slice(at, m), pa.array(n[at : at + m]), listed(doc, spans).slice(at, m), listed(pair[0], pa.array(queries.items[pair[1]])).slice(at, m)]
                    yield pa.record_batch(cols, names=["row", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(run, MATCHES)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = 0, block: int = BLOCK) -> DataFrame:
    """row, doc_id, n_words, spans (words inside matches, merged, from 0) and items of every text.

    docs has doc_id and text, items item_id and text; other columns are ignored. A-Z are
    lower-cased; words are runs of letters, digits and non-ASCII characters. A window is
    `window` words on end of an item, or all words of a shorter one. A null or empty text has
    no words and no matches, a null doc_id is passed on, repeated rows are separate texts and
    repeated items count once; an item with a null id can't be named and is left out. An empty
    table of items leaves every text clean.
    """
    items = items.filter(F.col("item_id").isNotNull())
    index, found, many = build_index(docs), None, False
    for part in blocks(items, block):
        one = search(index, Queries(part, window), near)
        many = found is not None
        found = found.unionByName(one) if many else one
    if found is None:
        return search(index, Queries([], window))
    if not many:
        return found
    # A text has one row a block here; spans of several blocks may overlap and are merged.
    spans = F.aggregate(
        F.sort_array(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["stop"] >= s["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(a, F.array(s))),
    )
    return found.groupBy("row", "doc_id", "n_words").agg(spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any match, all columns kept; each row is judged by its own text."""
    rows = keyed(docs)
    hit = contamination(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), items, window).filter(F.size("spans") > 0)
    hit = materialize(hit.select(F.col("doc_id").alias("key")), "hit")
    # Rows stay where they lie, unless there are too many hits for a broadcast.
    return rows.join(F.broadcast(hit) if hit.count() <= SMALL else hit, "key", "left_anti").select("row.*")
