"""The text operators against brute force, DuckDB and exact round trips, with odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from keyloom.llm import components, flow, grams, packing, queries, toxicity
from keyloom.llm.chat import chat_windows, read_windows
from keyloom.llm.decontamination import contamination, decontaminate
from keyloom.llm.exact_dedup import content_groups, deduplicate
from keyloom.llm.ngram_join import shingle_sets, similar_components
from keyloom.llm.packing import pack
from keyloom.llm.sharding import capacities, read_shards, reshard, slots
from keyloom.llm.storage import scratch
from keyloom.llm.substring_dedup import remove_repeats, suffix_order
from keyloom.llm.token_files import TokenFile, read_documents, read_manifest, write_token_files
from keyloom.llm.tokens import Encoder
from keyloom.llm.warc import read_warc, write_warc

DIR = "/root/testdata/sf0.001"
TOKENIZER = queries.tokenizer()
SCHEMA = "doc_id long, text string, keep_id string, name string, size string, key string"
R = random.Random(5)
VOCAB = [f"w{k}" for k in range(30)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, blank and long texts, ties, repeated rows, clashing columns."""
    base = prose(60)
    texts = [None, "", " \n", "one", base, base, base + " tail", "tail " + base, prose(3000), "É ß 日本 \x1c x", "a\0b", prose(40), base.upper(), "x " * 40]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, base), (None, base), (None, None), (99, prose(5))]
    return spark.createDataFrame([(i, t, "k", "n", "s", "q") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_duckdb(spark, oracle, name):
    assert same(queries.queries()[name](spark, DIR), oracle(DIR).sql(queries.SQL[name]))


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, odd, empty, monkeypatch, keep, hot):
    import keyloom.llm.exact_dedup as m

    if hot:
        monkeypatch.setattr(m, "HOT_ROWS", 1)
    df = odd.unionByName(spark.range(200, 240).selectExpr("id AS doc_id", "'same' AS text", "'' keep_id", "'' name", "'' size", "'' key"))
    by = defaultdict(list)
    for i, t in rows_of(df):
        by[t].append(i)
    got = content_groups(df, keep=keep).select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("t"), "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == df.count()
    for r in got:
        ids = [i for i in by[r.t] if i is not None]
        assert r.keep_id == ((max if keep == "max" else min)(ids) if ids else None)
        assert r.group_size == len(by[r.t]) and r.text_sha256 == hashlib.sha256(r.t.encode()).hexdigest()
    kept = deduplicate(df, keep=keep).collect()
    assert sorted(r.text or "" for r in kept) == sorted(by) and kept[0].__fields__ == df.columns
    assert content_groups(empty).count() == 0


def test_encoder_equals_library():
    e = Encoder(TOKENIZER)
    al = list("ab ,.'s\n\t 1½é😀<|>\x1c\0")
    texts = ["", " ", "it's we'll <|endoftext|>", "日本 語"] + ["".join(R.choice(al) for _ in range(R.randint(0, 50))) for _ in range(500)]
    texts.append(" ".join(texts) * 3)
    texts += ["<|endoftext|>", "a<|endoftext|>", "<|endoftext|> b", "a <|endoftext|> b  <|endoftext|>", "x" * 3000, "ÀéÿĀ 12,5;\n\nend."]
    from tokenizers import Tokenizer

    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want
    import keyloom.llm.tokens as m

    old, m.SLICE = m.SLICE, 300
    try:
        assert Encoder(TOKENIZER).encode(texts) == want
    finally:
        m.SLICE = old


def encoded(rows):
    ids = Encoder(TOKENIZER).encode([t for _, t in rows])
    return [(i, x + b"\0\0\0\0") for (i, _), x in zip(rows, ids, strict=True)]


def test_token_files(spark, odd, empty):
    path = scratch(spark, "t")
    write_token_files(odd, path, TOKENIZER, length=64)
    got = [(r.doc_id, r.start, bytes(r.token_ids)) for r in read_documents(spark, path).collect()]
    want = sorted(encoded(rows_of(odd)), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((repr(i), x) for i, _, x in got) == sorted((repr(i), x) for i, x in want)
    at = 0
    for i, start, x in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += len(x) // 4
    assert [i for i, _, _ in sorted(got, key=lambda r: r[1])] == [i for i, _ in want]
    for p in read_manifest(spark, path).collect():
        f = TokenFile(p.file)
        masks = [f.sequence(k)[1].to_pylist() for k in range(p.n_sequences)]
        assert sum(map(sum, masks)) == p.n_tokens and {len(m) for m in masks} == {64}
    assert write_token_files(empty, scratch(spark, "t"), TOKENIZER).count() == 0


def check_packing(rows, docs, step):
    """The whole contract of packing, of rows with token_ids, against the documents' ids."""
    whole = defaultdict(list)
    for i, x in encoded(docs):
        whole[i].append(x)
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.token_ids) // 4 > 0
        seqs[r.sequence_id].append(r)
        parts[r.doc_id].append(r)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= rs[0].tier and rs[0].tier in packing.TIERS and len({(r.tier, r.step_group) for r in rs}) == 1
    for i, xs in whole.items():
        left = sorted(xs)
        found = sorted(parts[i], key=lambda r: (r.start, bytes(r.token_ids)))
        assert sum(r.length for r in found) * 4 == sum(map(len, left))
        for x in left if len(left) == 1 else []:
            assert b"".join(bytes(r.token_ids) for r in found) == x and {r.doc_tokens for r in found} == {len(x) // 4}
            assert [r.start for r in found] == [0, *np.cumsum([r.length for r in found])[:-1]]
        assert all(any(bytes(r.token_ids) == x[4 * r.start : 4 * (r.start + r.length)] and r.doc_tokens == len(x) // 4 for x in left) for r in found)
    groups = defaultdict(lambda: defaultdict(set))
    for r in rows:
        groups[r.tier][r.step_group].add(r.sequence_id)
    numbers = [g for by in groups.values() for g in by]
    assert sorted(numbers) == list(range(len(numbers)))
    for tier, by in groups.items():
        sizes = [len(x) for x in by.values()]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == max(1, round(sum(sizes) * tier / step))


def test_packing(spark, odd, empty):
    docs = rows_of(odd) + [(1000 + k, prose(R.choice([30, 150, 290, 600]))) for k in range(300)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, tier string, part int").repartition(3)
    for step in (packing.STEP, 4096):
        rows = pack(df, TOKENIZER, step=step).collect()
        check_packing(rows, docs, step)
    real = queries.table(spark, DIR, "documents")
    check_packing(pack(real, TOKENIZER).collect(), rows_of(real), packing.STEP)
    assert pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("sizes", [[600], [600, 300], [1, 2, 3], [513, 512], [5000, 129]])
def test_packer_holds_less_than_a_window(sizes):
    p = packing.Packer(0)
    for k in range(3000):
        p.add(k, bytes(4 * sizes[k % len(sizes)]))
        if k % 100 == 99:
            p.pack()
            assert p.pending() < 1024
    p.finish()
    assert sum(r[2] for r in p.out) == sum(sizes[k % len(sizes)] for k in range(3000)) and not p.pending()


def test_packer_fills_windows():
    p = packing.Packer(0)
    sizes = [R.randint(1, 3000) for _ in range(400)]
    for k, n in enumerate(sizes):
        p.add(k, bytes(4 * n))
        if k % 50 == 49:
            p.pack()
    p.finish()
    fill = defaultdict(int)
    for r in p.out:
        fill[r[5], r[7]] += r[2]
    assert sum(fill.values()) == sum(sizes)
    assert sum(t - n for (_, t), n in fill.items()) < 128


def test_chat_round_trip(spark):
    own = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be nice"), (1, 1, "user", own), (1, 2, "assistant", own)]
    rows += [(2, k, "user" if k % 2 == 0 else "assistant", prose(R.randint(1, 200)) + "\n</turn>\n### x: \\b") for k in range(12)]
    rows += [(None, None, None, None), (3, 0, "a:b#<", ""), (3, 0, "a:b#<", ""), (4, 0, "system", "alone"), (5, 0, "assistant", prose(2000))]
    rows += [(6, k, "user" if k % 2 == 0 else "assistant", prose(20)) for k in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wins = chat_windows(df, 200, 60)
    back = {r.conv_id: r for r in read_windows(wins).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(back) == set(by)
    for c, ts in by.items():
        ts.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [t[2:] for t in ts]
        assert list(back[c].loss) == [t[3] for t in ts if t[2] == "assistant"]
    for w in wins.filter("conv_id = 2").collect():
        assert w.n_tokens <= 200 or sum(not t.repeated for t in w.turns) == 1
    small = wins.filter("conv_id = 6").collect()
    assert len(small) > 1 and all(sum(t.repeated for t in w.turns) == 2 for w in small if w.window_id)
    assert chat_windows(df.limit(0)).count() == 0


def plain_windows(turns, budget, history):
    """[(text, n_tokens, [(role, repeated, target)])] of a conversation of sorted (turn, role, text)."""
    import regex

    escape = lambda t, role=False: "".join({"\\": "\\b", "#": "\\h", "<": "\\l"}.get(c, "\\c" if role and c == ":" else c) for c in t)
    cost = lambda t: len(regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", t)) + 4
    k = next((k for k, t in enumerate(turns) if t[1] != "system"), len(turns))
    lead, rest = turns[:k], turns[k:]
    n = [cost(t[2]) for t in rest]
    room = max(budget - sum(cost(t[2]) for t in lead), min(64, budget))
    spans, at = [], 0
    while at < len(rest) or not spans:
        limit, stop = room if not spans else max(room - history, 1), at + 1
        while stop < len(rest) and sum(n[at : stop + 1]) <= limit:
            stop += 1
        spans.append((at, min(stop, len(rest))))
        at = stop
    out = []
    for w, (a, z) in enumerate(spans):
        spare, back = min(history, room - sum(n[a:z])), 0
        while a - back > 0 and sum(n[a - back - 1 : a]) <= spare:
            back += 1
        held = [(*t, w > 0, False) for t in lead] + [(*t, True, False) for t in rest[a - back : a]] + [(*t, False, t[1] == "assistant") for t in rest[a:z]]
        out.append(("".join(f"### {escape(r, True)}: {escape(t)}</turn>\n" for _, r, t, _, _ in held), sum(cost(t) for _, _, t, _, _ in held), [(r, m, g) for _, r, _, m, g in held]))
    return out


def test_chat_windows_equal_plain_python(spark):
    rows = []
    for c in range(60):
        for k in range(R.randint(1, 30)):
            role = R.choice(["system", "user", "assistant"]) if k < 2 else R.choice(["user", "assistant", None, "a:#"])
            rows.append((c, R.choice([k, None, 3]), role, R.choice([None, "", prose(R.randint(1, 60)), "é#<\\ x", prose(300) if k == 5 else "ok"]), "x"))
    rows += [(100, 0, "system", prose(400), "x"), (100, 1, "user", "hi", "x"), (100, 2, "assistant", prose(90), "x"), (100, 3, "assistant", prose(9), "x")]
    rows += [(101, 0, "user", "same", "x")] * 50 + [(None, 1, "user", "n", "x"), (None, 0, "assistant", "m", "x")]
    rows += [(102, k, "user" if k % 2 == 0 else "assistant", "a b", "x") for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, room string").repartition(5)
    for budget, history in ((200, 60), (40, 39)):
        got = defaultdict(list)
        for r in chat_windows(df, budget, history).orderBy("conv_id", "window_id").collect():
            got[r.conv_id].append((r.text, r.n_tokens, [(t.role, t.repeated, t.target) for t in r.turns]))
        for c in {r[0] for r in rows}:
            turns = sorted(((t is not None, t or 0), r or "", x or "") for i, t, r, x, _ in rows if i == c)
            assert got[c] == plain_windows(turns, budget, history), c


def brute_components(rows, percent=85):
    h, first = shingle_sets([t.encode() for _, t in rows])
    sets = [frozenset(h[first[k] : first[k + 1]].tolist()) for k in range(len(rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("tile", [4096, 8])
def test_ngram_join(spark, odd, empty, tile):
    base = [R.choice(VOCAB) for _ in range(120)]
    near = []
    for k in range(60):
        t = list(base)
        for _ in range(R.randint(0, 8)):
            t[R.randrange(len(t))] = f"z{R.randrange(50)}"
        near.append((1000 + k, " ".join(t)))
    # Apart from the near copies, a group of unlike sets of one frequent beginning.
    near += [(2000 + k, f"{' '.join(base[:4])} {prose(3)}") for k in range(40)]
    df = odd.unionByName(spark.createDataFrame(near, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in similar_components(df, tile=tile).collect()), key=repr)
    assert got == brute_components(rows_of(df))
    if tile == 8:
        assert similar_components(empty).count() == 0


def test_near_copies_send_two_rows_each(spark, monkeypatch):
    """5,000 near copies in one group: a row a member and deal, and no second round."""
    from keyloom.llm import ngram_join as m

    base = [f"b{k}" for k in range(120)]
    near = [(k, " ".join([*base[: 20 + k % 7], f"z{k}", *base[21 + k % 7 :]])) for k in range(5000)]
    sent, late = [], []
    dealt, across = m.dealt, m.across
    monkeypatch.setattr(m, "dealt", lambda rows: sent.append((rows.count(), (out := dealt(rows)).count())) or out)
    monkeypatch.setattr(m, "across", lambda *a: late.append((out := across(*a)).count()) or out)
    got = similar_components(spark.createDataFrame(near, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 5000
    assert all(n <= 2 * rows for rows, n in sent) and late and not any(late)


def test_drop_near_copies(spark, odd, empty):
    from keyloom.llm.ngram_join import drop_near_copies

    rows = [(None, "a b c d e"), (None, "a b c d e"), (9, "a b c d e"), (9, "q r s t u"), (3, "x y z"), (3, "x y z"), (4, ""), (4, ""), (None, None), (None, "only null here")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = sorted((repr(r.doc_id), r.text or "", r.key) for r in drop_near_copies(df).collect())
    assert got == sorted((i, t, "k") for i, t in [("9", "a b c d e"), ("9", "q r s t u"), ("3", "x y z"), ("4", ""), ("4", ""), ("None", ""), ("None", "only null here")])
    out = drop_near_copies(odd)
    assert out.columns == odd.columns and drop_near_copies(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 300), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100}


def test_words_and_grams_equal_python():
    texts = [b"", b" ", b"a b\tc\n\x0bd", b"one", "é ß 日本".encode(), b"x" * 50 + b" y"]
    w = grams.Words(texts)
    assert [w.bytes[a:z] for a, z in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    assert np.diff(w.first).tolist() == [len(t.split()) for t in texts]
    again = grams.Words([b"d one", b"a"])
    assert again.hash.tolist() == [w.hash[3], w.hash[4], w.hash[0]]


def brute_repeats(rows, window=13):
    words = [t.encode().split() for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, odd, empty):
    shared = prose(40)
    more = spark.createDataFrame([(k, f"{prose(R.randint(0, 30))} {shared} {prose(R.randint(0, 30))}") for k in range(300, 330)], "doc_id long, text string")
    df = odd.unionByName(more, allowMissingColumns=True)
    got = remove_repeats(df)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == brute_repeats(rows_of(df))
    cut = got.filter("n_removed > 0").first()
    assert hashlib.sha256(cut.kept_text.encode()).hexdigest() == cut.kept_sha256
    assert sum(s.stop - s.start for s in cut.spans) == cut.n_removed
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("step", [1, 50, 1 << 19])
def test_common_grams_are_lengthened_and_split(spark, monkeypatch, step):
    """A 7-gram in many contexts: its suffixes go to many parts, results stay those of brute force."""
    import keyloom.llm.substring_dedup as m

    hot = "the very same seven words come again"
    # Ids that make the words differ; every passage stands in three documents.
    ctx = [" ".join(f"c{(k * 7 + j) % 997}x{k}" for j in range(12)) for k in range(250)]
    rows = [(3 * k + j, f"{prose(8)} {ctx[k]} {hot} {ctx[-k]} {prose(8)}") for k in range(250) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(m, "HOT", 100)
    monkeypatch.setattr(m, "STEP", step)
    seen = []
    hot_grams = m.hot_grams
    monkeypatch.setattr(m, "hot_grams", lambda found: seen.append(hot_grams(found)) or seen[-1])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect()), key=repr)
    assert got == brute_repeats(rows)
    assert len(seen[0])


def test_suffix_order_and_nodes():
    words = np.random.default_rng(0).integers(0, 3, (400, 9)).astype(np.int32)
    words[:, 6:][np.random.default_rng(1).random((400, 3)) < 0.3] = -1
    order, lcp = suffix_order(words)
    rows = [tuple(r) for r in words.tolist()]
    assert [rows[k] for k in order] == sorted(rows)
    for k in range(1, 400):
        a, b = rows[order[k - 1]], rows[order[k]]
        n = next((j for j in range(9) if a[j] != b[j] or a[j] < 0), 9)
        assert lcp[k] == n
    assert [len(x) for x in suffix_order(np.empty((0, 9), np.int32))] == [0, 0]
    big = np.array([[1 << 30, 2], [1 << 30, 1], [0, 5]], np.int32)
    assert suffix_order(big)[0].tolist() == [2, 1, 0]


def brute_matches(text, items, window=10):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        x = split(t)
        m = min(window, len(x))
        wins = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if x else set()
        for k in range(len(w) - m + 1):
            if tuple(w[k : k + m]) in wins:
                hit |= set(range(k, k + m))
                found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_decontamination(spark, odd, empty, block):
    items = [(1, prose(25)), (2, "w1 w2, W3"), (3, ""), (4, None), (5, prose(12)), (5, prose(12)), (None, "w4 w5")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(500, f"{prose(9)} {items[0][1].upper()} x"), (501, "w1 w2 w3")], "doc_id long, text string")
    df = odd.unionByName(extra, allowMissingColumns=True)
    known = [x for x in items if x[0] is not None]
    got = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), sorted(r["items"])) for r in contamination(df, tests, block=block).collect()), key=repr)
    assert got == sorted(((i, *brute_matches(t, known)) for i, t in rows_of(df)), key=repr)
    if block > 60:
        import keyloom.llm.decontamination as m

        # Segments of a text or two find the same; a hit row takes no other row of its id with it.
        old, m.SEGMENT = m.SEGMENT, 100
        again = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), sorted(r["items"])) for r in contamination(df, tests).collect()), key=repr)
        m.SEGMENT = old
        assert again == got
        twins = spark.createDataFrame([(None, "w1 w2 w3"), (None, "clean"), (7, "w1 w2 w3"), (7, "clean"), (None, None)], "doc_id long, text string")
        assert sorted((repr(r.doc_id), r.text or "") for r in decontaminate(twins, tests).collect()) == [("7", "clean"), ("None", ""), ("None", "clean")]
        assert {r.doc_id for r in decontaminate(df, tests).collect()}.isdisjoint({500, 501})
        assert contamination(df, tests.limit(0)).filter(F.size("spans") > 0).count() == 0
        assert contamination(empty, tests).count() == 0
        near = contamination(spark.createDataFrame([(1, "w3 z w1 w2"), (2, "w3 z z w1 w2")], "doc_id long, text string"), tests.filter("item_id = 2"), near=1)
        assert {r.doc_id: len(r.spans) for r in near.collect()} == {1: 1, 2: 0}


def test_decontamination_of_many_partitions(spark):
    """Texts are numbered apart whatever the number of tasks, over one block of items and over several."""
    item = prose(14)
    df = spark.range(0, 600, 1, 150).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, F.lit(f"x {item} y")).otherwise(F.lit("fine words here")).alias("text"))
    tests = spark.createDataFrame([(1, item), (2, "fine words")], "item_id long, text string")
    for block in (1 << 24, 10):
        got = contamination(df, tests, block=block).collect()
        assert len({r.row for r in got}) == 600
        assert sorted((r.doc_id, r["items"]) for r in got) == [(i, [2 - (i % 7 == 0)]) for i in range(600)]
    assert sorted(r.doc_id for r in decontaminate(df, tests.limit(1)).collect()) == [i for i in range(600) if i % 7]


def test_decontamination_memory(spark, monkeypatch):
    """Row groups of the index hold a few segments, clean rows are not shuffled, and many hits are left out as well."""
    import pyarrow.parquet as pq

    import keyloom.llm.decontamination as m

    item = prose(14)
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda k: F.concat(F.lit("v"), F.xxhash64("id", k).cast("string"))), " ")
    df = spark.range(0, 120, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, F.lit(f"x {item} y")).otherwise(words).alias("text"))
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    file = pq.ParquetFile(m.build_index(df).inputFiles()[0].removeprefix("file://")).metadata
    assert file.num_rows >= 5 and all(file.row_group(k).num_rows <= 3 for k in range(file.num_row_groups))
    clean = decontaminate(df, tests)
    assert "Exchange hashpartitioning" not in clean._jdf.queryExecution().executedPlan().toString()
    want = [i for i in range(120) if i % 7]
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == want
    monkeypatch.setattr(m, "SMALL", 0)
    assert sorted(r.doc_id for r in decontaminate(df, tests).select("doc_id").collect()) == want


def test_warc(spark, empty):
    rows = [(1, "http://a/x y", "<p>é"), (2, None, "<p>é"), (3, "u\r\nv", ""), (4, "u", None), (None, "u", "<p>é"), (5, "b", "long" * 10000), (6, "c", "solo"), (6, "c", "solo")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    path = scratch(spark, "w")
    files = write_warc(df, path, roll=2000).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(spark, path).collect()), key=repr)
    sha = lambda t: __import__("base64").b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 4 + 0, sha("<p>é"), "revisit", 2), (2, 4, sha("<p>é"), "response", None), (None, 4, sha("<p>é"), "revisit", 2), (3, 0, sha(""), "revisit", 4), (4, 0, sha(""), "response", None), (5, 40000, sha("long" * 10000), "response", None), (6, 4, sha("solo"), "response", None), (6, 4, sha("solo"), "revisit", 6)]
    want = [(p, 5 if d == sha("<p>é") else n, d, t, q) for p, n, d, t, q in want]
    assert got == sorted(want, key=repr)
    again = write_warc(df.repartition(3), scratch(spark, "w"), roll=2000).collect()
    assert [(f.n_records, f.compressed_bytes) for f in files] == [(f.n_records, f.compressed_bytes) for f in again]
    assert write_warc(df.limit(0), scratch(spark, "w")).count() == 0


def test_warc_files_do_not_depend_on_the_input_partitions(spark):
    import pathlib

    df = spark.range(20_000).selectExpr("(id * 7919) % 20000 AS page_id", "concat('http://h/', id) AS url", "repeat(cast(id % 97 AS string), cast(id % 50 AS int)) AS html")

    def digests(rows):
        path = scratch(spark, "w")
        write_warc(rows, path, roll=40_000)
        folder = pathlib.Path(path.removeprefix("file://"))
        assert len(list(folder.glob("part-*"))) > 4
        return {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in folder.glob("part-*")}

    assert digests(df.repartition(3)) == digests(df.repartition(11).orderBy("url"))


@pytest.mark.parametrize("keys", ["even", "wide", "nulls", "hot", "one", "ends"])
def test_ranges(spark, keys):
    from keyloom.llm.ranges import dealt_by_range

    key = {"even": lambda k: k, "wide": lambda k: R.getrandbits(64) - (1 << 63), "nulls": lambda k: None if k % 3 else k, "hot": lambda k: 7 if k % 3 else k * 10**14, "one": lambda k: 7, "ends": lambda k: (1 << 63) - 1 if k % 2 else -(1 << 63)}[keys]
    df = spark.createDataFrame([(key(k), R.getrandbits(32), R.randint(1, 9)) for k in range(3000)], "key long, tie long, size long")
    a, b = (sorted(((r.key is not None, r.key or 0, r.tie, r.to, r.size) for r in dealt_by_range(d, d, 7, "key", "tie", "size").collect())) for d in (df.repartition(1), df.repartition(3)))
    assert a == b and len(a) == 3000 and [r[3] for r in a] == sorted(r[3] for r in a)
    sums = defaultdict(int)
    for r in a:
        sums[r[3]] += r[4]
    assert set(sums) == set(range(7)) and max(sums.values()) <= 1.2 * sum(sums.values()) / 7


def test_flow_is_cheapest():
    import itertools

    for _ in range(30):
        a, b = [R.randint(0, 4) for _ in range(3)], [0, 0, 0]
        for _ in range(sum(a)):
            b[R.randrange(3)] += 1
        c = [[R.randint(0, 5) for _ in range(3)] for _ in range(3)]
        got = flow.min_cost_flow(a, b, lambda i, j: c[i][j])
        assert [sum(x for (i, _), x in got.items() if i == k) for k in range(3)] == a
        assert [sum(x for (_, j), x in got.items() if j == k) for k in range(3)] == b
        units = [i for i in range(3) for _ in range(a[i])]
        slots = [j for j in range(3) for _ in range(b[j])]
        best = min((sum(c[i][j] for i, j in zip(units, p)) for p in set(itertools.permutations(slots))), default=0) if len(slots) < 8 else None
        if best is not None:
            assert sum(x * c[i][j] for (i, j), x in got.items()) == best


def test_transfers_move_the_least():
    for _ in range(200):
        a = [R.randint(0, 9) for _ in range(R.randint(1, 6))]
        m = R.randint(1, 6)
        b = capacities(sum(a), m)
        got = flow.transfers(a, b)
        assert [sum(x for (i, _), x in got.items() if i == k) for k in range(len(a))] == a
        assert [sum(x for (_, j), x in got.items() if j == k) for k in range(m)] == b
        assert sum(x for (i, j), x in got.items() if i == j) == sum(min(x, y) for x, y in zip(a, b))


def check_shards(rows, docs, n):
    """Every row once, sizes and checksums of the texts, gapless slots, shards of near equal bytes."""
    assert sorted((repr(r.doc_id), r.size, r.crc) for r in rows) == sorted((repr(i), len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return [sum(r.size for r in by[j]) for j in range(n)]


def resharded(spark, df, n, old, n_old, capacity=None):
    path = scratch(spark, "s")
    kept = reshard(df, path, n, old, n_old, capacity)
    rows = read_shards(spark, path, kept).select("row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("crc"), "h", "shard", "row")
    return slots(rows).collect(), kept


def test_resharding(spark, odd, empty):
    docs = odd.withColumn("shard", F.lit("clash")).withColumn("h", F.lit(1.5)).withColumn("old", F.lit("o"))
    rows, _ = resharded(spark, docs, 5, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3)
    check_shards(rows, rows_of(odd), 5)
    assert all((r.row.shard, r.row.h, r.row.old, r.row.size) == ("clash", 1.5, "o", "s") for r in rows)
    assert resharded(spark, empty, 3, F.lit(0), 2)[0] == [] and sum(capacities(17, 5)) == 17


def test_shards_are_equal_and_groups_stay_together(spark):
    docs = [(k, prose(R.choice([3, 30, 300] if k < 40 else [3, 30, 300, 1500]))) for k in range(1500)]
    docs += [(2000 + k, docs[k % 40][1]) for k in range(200)] + [(3000 + k, "hot " * 50) for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows, _ = resharded(spark, df, 12, F.pmod(F.xxhash64("text"), F.lit(9)), 9)
    sizes = check_shards(rows, docs, 12)
    mean = sum(sizes) / 12
    assert max(abs(x - mean) for x in sizes) < 0.01 * mean
    text = dict(docs)
    where = defaultdict(set)
    for r in rows:
        where[text[r.doc_id]].add(r.shard)
    assert len(where.pop("hot " * 50)) > 1 and all(len(x) == 1 for x in where.values())


def test_only_affected_shards_are_written(spark):
    import pathlib

    docs = [(k, "x" * 84) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # Shards 0 to 2 hold 10 rows each and keep them; shard 3 shares its 30 with two new ones.
    path = scratch(spark, "s")
    kept = reshard(df, path, 6, F.least(F.floor(F.col("doc_id") / 10), F.lit(3)), 4)
    names = {f.name for f in pathlib.Path(path.removeprefix("file://")).glob("shard=*")}
    assert names == {"shard=3", "shard=4", "shard=5"}
    assert sorted((r.shard, r.doc_id) for r in kept.select("shard", "row.doc_id").collect()) == [(k // 10, k) for k in range(30)]
    assert sorted(r.doc_id for r in read_shards(spark, path, kept).select("row.doc_id").collect()) == list(range(60))


def test_sharding_query(spark):
    got = queries.op8_sharding(spark, "/root/testdata/sf0.01").withColumnRenamed("text_crc32", "crc").collect()
    docs = rows_of(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    sizes = check_shards(got, docs, 40)
    mean = sum(sizes) / 40
    assert max(abs(x - mean) for x in sizes) <= 0.035 * mean and sorted(abs(x - mean) for x in sizes)[-2] < 0.01 * mean


def test_toxicity(spark, odd):
    lex = toxicity.Lexicon({"4:vequ": 9.0})
    kinds = lambda t: {k: v for k, v in zip(toxicity.KINDS, toxicity.clause_counts(t, lex, {})[1]) if v}
    assert kinds("you are an idiot") == {"bound_insult": 1}
    assert kinds("an idiot. you there") == {"insult": 1}
    assert kinds("not an idiot") == {"negated": 1}
    assert kinds("they said idiot") == {"reported": 1}
    assert kinds("you will kill") == {"bound_threat": 1}
    assert kinds("i will kill you") == {"bound_threat": 1} and kinds("kill them all") == {"bound_threat": 1}
    assert kinds("idiot you are") == {"bound_insult": 1} and kinds("an idiot and a b you") == {"insult": 1}
    assert kinds("don't hurt") == {"negated": 1} and kinds("he isn’t a moron") == {"negated": 1}
    assert kinds("nicht dumm") == kinds("pas stupide") == kinds("nunca estúpido") == {"negated": 1}
    assert kinds("du trottel") == kinds("l'idiot, toi") == {"bound_insult": 1} and kinds("il a dit idiot") == {"reported": 1}
    assert kinds("kill idiot") == {"insult": 1, "threat": 1} and kinds("kill idiot you") == {"bound_insult": 1, "bound_threat": 1}
    assert kinds("vequabc") == {"insult": 1}
    docs = [(k, prose(20) + (" you idiot scum" if k % 3 == 0 else "")) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(7, None), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.score(odd, model).filter("predicted = 0").count() == odd.count()
    assert sorted(toxicity.keep_clean(odd, model).columns) == sorted(odd.columns)
    assert toxicity.train(df, labels.limit(0))[1] is toxicity.DEFAULT


def plain_kinds(words, reach=3):
    """Counts of the kinds of clauses by plain Python over (word, symbol) lists of one clause each."""
    counts = dict.fromkeys(toxicity.KINDS, 0)
    for clause in words:
        for opener, result in (("negation", "negated"), ("report", "reported")):
            kept, left = [], 0
            for s in clause:
                if s == opener:
                    left = reach
                    continue
                kept.append(result if left and s in ("insult", "threat") else s)
                left = max(0, left - 1)
            clause = kept
        targets = [k for k, s in enumerate(clause) if s == "target"]
        for k, s in enumerate(clause):
            if s in ("insult", "threat"):
                near = any(0 < k - t <= reach or 0 < t - k <= reach for t in targets)
                counts[f"bound_{s}" if near else s] += 1
            elif s in ("negated", "reported"):
                counts[s] += 1
    return list(counts.values())


def test_grammar_and_scores_equal_plain_python(spark, odd):
    stems = {"4:vequ": 9.0, "32:zorb": 9.0}
    lex = toxicity.Lexicon(stems)
    vocab = "idiot kill you not said word other vequabc zorb zorbs they isn't d'idiot".split()
    texts = [" ".join(R.choice(vocab) + R.choice(["", "", "", ".", "!?", "\n"]) for _ in range(R.randint(0, 25))) for _ in range(400)]
    name = {"idiot": "insult", "kill": "threat", "you": "target", "they": "target", "not": "negation", "isn't": "negation", "said": "report", "vequabc": "insult", "zorb": "insult", "d'idiot": "insult"}

    def counted(t):
        clauses, n = [[]], 0
        for chunk in t.split():
            w = chunk.rstrip(".!?")
            clauses[-1].append(name.get(w, "other"))
            n += 1 + (w != chunk)
            if w != chunk:
                clauses.append([])
        return n, plain_kinds(clauses)

    texts = [t.replace("\n", " ") for t in texts]
    assert [toxicity.clause_counts(t, lex, {}) for t in texts] == [counted(t) for t in texts]
    weights = np.array([0.3, 0.4, 1.5, 1.7, -0.2, 0.1, 0.6, 2.0, -3.0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, (stems, weights)).collect():
        n, c = counted(texts[r.doc_id])
        x = [*np.log1p(c), np.log1p(1000 * sum(c[:4]) / max(n, 1)), float(sum(c[:4]) > 0)]
        assert abs(r.score - 1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1])))) < 1e-9
    assert toxicity.score(odd.limit(0), (stems, weights)).count() == 0


def test_conflicting_labels_are_left_out(spark):
    df = spark.createDataFrame([(k, f"w{k} " + ("zorb" if k % 2 else "fine")) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(k, 1 - k % 2) for k in range(0, 200, 20)] + [(1, 1), (1, 1)], "doc_id long, toxic int")
    a, b = (toxicity.train(df, labels.repartition(p)) for p in (1, 5))
    assert a[0] == b[0] and np.allclose(a[1], b[1]) and "32:zorb" in a[0]
    assert len(toxicity.train(df, labels, most=1)[0]) == 1


def test_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) >= 0.9 and np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.01


def test_held_out_accuracy(spark):
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert np.mean((s >= 0.5) == y) >= 0.95 and np.mean(s[y == 1][:, None] >= s[y == 0][None, :]) > 0.75


def test_pipeline_against_its_stages(spark):
    """What each stage keeps, by brute force over what the one before it kept."""
    import corpus_pipeline as p

    docs = queries.table(spark, DIR, "documents")
    tests = [(r.item_id, r.text) for r in queries.table(spark, DIR, "benchmark").collect()]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        before, after = dict(rows_of(docs)), dict(rows_of(out))
        if name == "exact dedup":
            last = {t: i for i, t in sorted(before.items())}
            want = set(last.values())
        elif name == "n-gram Jaccard join":
            want = {i for i, _, c in brute_components(list(before.items())) if i == c}
        elif name == "benchmark decontamination":
            want = {i for i, t in before.items() if not brute_matches(t, tests)[1]}
        else:
            bad = toxicity.score(docs, toxicity.train(docs, queries.table(spark, DIR, "labels"))).filter("predicted = 1").collect()
            want = set(before) - {r.doc_id for r in bad}
        assert set(after) == want, name
        docs = p.materialize(out, "stage")
    pieces = p.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows_of(docs)}


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty, blank and long texts, ties, clashing columns, an empty table."""
    import corpus_pipeline as p

    item = prose(14)
    base = prose(80)
    rows = [(k, t) for k, t in enumerate([None, "", " ", base, base, base + " tail", f"x {item} y", prose(4000), "you idiot scum"])]
    rows += [(None, base), (None, f"{item} z"), (None, prose(30)), (None, None), (6, prose(20)), (6, prose(20)), (3, "you idiot trash"), (11, item), (11, "fine words here are these")]
    schema = "doc_id long, text string, key string, row string, tile int, component_id string"
    docs = spark.createDataFrame([(i, t, "k", "r", 1, "c") for i, t in rows], schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    for name, df in (("full", docs), ("none", docs.limit(0))):
        d = f"{tmp_path}/{name}"
        df.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, item), (None, base), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = queries.table(spark, d, "documents")
        for stage, make in p.STAGES[:-1]:
            before = [(r.doc_id, r.text or "") for r in now.collect()]
            out = p.materialize(make(spark, now, d), "stage")
            assert out.columns == docs.columns
            after = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr)
            lower = lambda i: (i is not None, i or 0)
            if stage == "exact dedup":
                best = {}
                for i, t in before:
                    best[t] = max(best.get(t, i), i, key=lower)
                assert after == sorted(((i, t) for t, i in best.items()), key=repr)
            elif stage == "n-gram Jaccard join":
                # By position, so that equal ids stay apart.
                found = brute_components([(k, t) for k, (_, t) in enumerate(before)])
                groups = defaultdict(list)
                for k, _, c in found:
                    groups[c].append(k)
                kept = [min(g, key=lambda k: (before[k][0] is None, before[k][0] or 0)) for g in groups.values()]
                assert after == sorted((before[k] for k in kept), key=repr)
            elif stage == "benchmark decontamination":
                assert after == sorted(((i, t) for i, t in before if not brute_matches(t, [(1, item)])[1]), key=repr)
            now = out
        pieces = p.STAGES[-1][1](spark, now, d).collect()
        want = sorted((repr(i), len(x) // 4) for i, x in encoded(rows_of(now)))
        got = defaultdict(int)
        for r in pieces:
            got[repr(r.doc_id)] += r.length
        total = defaultdict(int)
        for i, n in want:
            total[i] += n
        assert got == total
        if name == "none":
            assert p.run(spark, d).count() == 0
