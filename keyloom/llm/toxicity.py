"""Toxicity scores from a weighted finite-state pattern grammar.

Lexicon transducers turn words into the symbols of a clause: insult, threat, target,
negation, reported speech, boundary or other. Grammar transducers rewrite the symbols in
turn (negation cancels what it governs, reported speech marks what it introduces, a target
shortly before or after an insult or threat binds to it) and are composed into one
deterministic machine, which counts the kinds of clauses it accepts. The weights of the kinds come from a logistic
regression on the labelled rows of the training folds. The insult lexicon is given words and
the word beginnings whose presence in the training rows goes with the label; their counts
cover all rows of the bounded sample that the model is fitted to.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.storage import materialize

#: Seed words of the lexicons, in English, German, French and Spanish; letters
#: and digits only, so contractions stand without their apostrophe.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown
idiotin dumm trottel abschaum versager idiote imbécile stupide raclure minable idiota imbécil estúpido escoria""".split()
THREATS = """kill hurt destroy shoot stab strangle burn beat
töten umbringen schlagen erschießen tuer frapper brûler matar golpear quemar""".split()
TARGETS = """you your youre youll u he she they them him her these those
du dich dir ihr euch sie ihn tu toi vous lui eux ils elle elles tú ti usted ustedes él ella ellos ellas""".split()
NEGATIONS = """not no never nor neither without isnt arent wasnt dont doesnt didnt wont cant cannot
nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans ni nunca jamás ningún sin""".split()
REPORTS = """said says wrote writes claimed claims called calls quoted reported
sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó""".split()

#: Lengths of learned word beginnings (32: whole words), least log likelihood ratio against
#: the label's overall rate, and most beginnings kept (those of the most evidence).
STEMS, EVIDENCE, LEXICON = (4, 5, 6, 32), 8.0, 16_384
#: Bound on the labelled rows that the model is fitted to, taken by a hash of doc_id; their
#: ids and labels are broadcast, so the corpus isn't shuffled.
SAMPLE = 40_000
#: Words that a negation or a report governs, and that a target reaches on either side.
REACH = 3

SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "boundary")
KINDS = ("insult", "threat", "bound_insult", "bound_threat", "negated", "reported")
_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;\n]+")
_apostrophe = re.compile("['’]")


class Transducer:
    """A deterministic transducer: step(state, symbol) is (next state, symbols written)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, after: Transducer) -> Transducer:
        """The composition: what this one writes is read by the other."""

        def step(state, symbol):
            a, b = state
            a, written = self.step(a, symbol)
            out = []
            for s in written:
                b, more = after.step(b, s)
                out += more
            return (a, b), tuple(out)

        return Transducer((self.start, after.start), step)

    def table(self, symbols):
        """All reachable states as a table: rows of (next state, output) for each symbol."""
        states, rows, k = {self.start: 0}, [], 0
        order = [self.start]
        while k < len(order):
            row = []
            for s in symbols:
                nxt, out = self.step(order[k], s)
                if nxt not in states:
                    states[nxt] = len(order)
                    order.append(nxt)
                row.append((states[nxt], out))
            rows.append(row)
            k += 1
        return rows


def governing(opener: str, result: str, most: int) -> Transducer:
    """Rewrites an insult or threat within `most` symbols after the opener to `result`."""

    def step(left, s):
        if s == opener:
            return most, ()
        if s == "boundary":
            return 0, (s,)
        if left and s in ("insult", "threat"):
            return left - 1, (result,)
        return max(0, left - 1), (s,)

    return Transducer(0, step)


def binding(most: int) -> Transducer:
    """Binds an insult or threat to a target at most `most` symbols before or after it.

    The state is how far the last target still reaches and the unbound insults and threats
    that wait for one, with the symbols they still wait; a boundary ends all of it.
    """

    def step(state, s):
        left, waiting = state
        if s == "target":
            return (most, ()), tuple(f"bound_{k}" for k, _ in waiting)
        if s == "boundary":
            return (0, ()), tuple(k for k, _ in waiting)
        out = [k for k, n in waiting if n == 1]
        waiting = tuple((k, n - 1) for k, n in waiting if n > 1)
        if s in ("insult", "threat"):
            if left:
                out.append(f"bound_{s}")
            else:
                waiting += ((s, most),)
        elif s in KINDS:
            out.append(s)
        return (max(0, left - 1), waiting), tuple(out)

    return Transducer((0, ()), step)


@lru_cache
def grammar(reach: int = REACH):
    """The composed machine: table[state][symbol] is (next state, kinds accepted)."""
    return (governing("negation", "negated", reach) @ governing("report", "reported", reach) @ binding(reach)).table(SYMBOLS)


class Lexicon:
    """Word to symbol; learned beginnings count as insults."""

    def __init__(self, learned: dict[str, float]):
        self.stems: dict[int, set[str]] = {}
        for s in learned:
            n, w = s.split(":", 1)
            self.stems.setdefault(int(n), set()).add(w)
        self.whole = self.stems.pop(STEMS[-1], set())
        self.lengths = sorted(self.stems)
        code = dict(zip(SYMBOLS, range(len(SYMBOLS)), strict=True))
        self.given = {w: code[k] for k, ws in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS), ("insult", INSULTS)) for w in ws}
        self.insult, self.boundary = code["insult"], code["boundary"]

    def symbol(self, word: str) -> int:
        if word[0] in ".!?;\n":
            return self.boundary
        parts = _apostrophe.split(word)
        if len(parts) > 1 and (found := self.given.get("".join(parts))) is not None:
            return found
        for part in parts:
            if (found := self.given.get(part)) is not None:
                return found
            if part in self.whole or any(part[:n] in self.stems[n] for n in self.lengths if len(part) >= n):
                return self.insult
        return 0


def clause_counts(text: str, lexicon: Lexicon, memo: dict) -> tuple[int, list[int]]:
    """Number of words and boundaries, and of each kind of clause; the text's end is a boundary."""
    counts, state, table, n = dict.fromkeys(KINDS, 0), 0, grammar(), 0
    for w in _word.findall(text.lower()):
        if (s := memo.get(w)) is None:
            if len(memo) > 200_000:
                memo.clear()
            s = memo[w] = lexicon.symbol(w)
        n += 1
        state, out = table[state][s]
        for k in out:
            counts[k] += 1
    for k in table[state][lexicon.boundary][1]:
        counts[k] += 1
    return n, list(counts.values())


def features(n: int, counts) -> np.ndarray:
    """Log counts, their share of the words, and whether there is a plain match."""
    c = np.asarray(counts, float)
    return np.concatenate([np.log1p(c), [np.log1p(1000 * c[:4].sum() / max(n, 1)), float(c[:4].sum() > 0)]])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights where no training row is labelled: a plain match is toxic.
DEFAULT = np.array([0.5, 0.5, 1.0, 1.0, 0.0, 0.0, 0.5, 2.5, -3.0])


def learned_stems(train: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Word beginnings with their log likelihood ratio; train has text and toxic (0 or 1).

    Of those with EVIDENCE or more, the `most` with the largest ratio; ties in order of name.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    keys = F.array_distinct(F.flatten(F.transform(words, lambda w: F.filter(F.array(*[F.when(F.char_length(w) >= (n if n < STEMS[-1] else 3), F.concat(F.lit(f"{n}:"), F.substring(w, 1, n))) for n in STEMS]), lambda x: x.isNotNull()))))
    # Copies of a text are one witness.
    train = train.select("toxic", keys.alias("keys"), F.xxhash64("text").alias("h")).dropDuplicates(["toxic", "h"])
    total = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return {}
    rate = n1 / (n1 + n0)
    counts = train.select("toxic", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter("t > c")
    t, c = F.col("t"), F.col("c")
    ratio = t * F.log(t / (t + c) / rate) + F.when(c > 0, c * F.log(F.greatest(c, F.lit(1)) / (t + c) / (1 - rate))).otherwise(0.0)
    good = counts.withColumn("ratio", ratio).filter(F.col("ratio") >= EVIDENCE)
    return {r.key: r.ratio for r in good.orderBy(F.desc("ratio"), "key").limit(most).collect()}


def _counted(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, extra columns and the model's inputs."""
    rest = [c for c in df.columns if c != "text"]

    def run(parts):
        import pyarrow as pa

        memo: dict = {}
        for b in parts:
            texts = b.column("text")
            for at in range(0, b.num_rows, 512):
                found = [clause_counts(t, lexicon, memo) for t in texts.slice(at, 512).to_pylist()]
                x = [features(n, c).tolist() for n, c in found]
                yield pa.record_batch([*(b.column(c).slice(at, len(x)) for c in rest), pa.array(x, pa.list_(pa.float64()))], names=[*rest, "x"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")
    return df.mapInArrow(run, f"{kept}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = LEXICON):
    """(learned beginnings, weights) from labelled rows outside the held-out fold.

    docs has doc_id and text, labels doc_id and toxic; rows with a null or other label and ids
    with labels that disagree are left out. Held out are ids whose crc32 as text is divisible
    by 5. The model is fitted to at most `sample` labelled rows and `most` beginnings. Without
    rows of both labels the weights are DEFAULT.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold != 0)).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most")).filter("toxic = most").drop("most")
    some = known.orderBy(F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(sample)
    rows = materialize(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id"), "labelled")
    stems = learned_stems(rows, most)
    got = _counted(rows.select("toxic", "text"), Lexicon(stems)).collect()  # a few numbers for each row of the sample
    y = np.array([r.toxic for r in got], float)
    if len(set(y.tolist())) < 2:
        return stems, DEFAULT
    return stems, fit(np.array([r.x for r in got]), y)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    The score depends on the text alone; null and empty texts get the score of no match.
    Null ids (held_out is null), repeated rows and further columns don't matter; an empty
    table gives no rows.
    """
    stems, weights = model
    x = _counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), Lexicon(stems))
    z = sum((F.col("x")[k] * float(w) for k, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    p = 1 / (1 + F.exp(-z))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return x.select("doc_id", held.alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns kept."""
    stems, weights = model
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    z = sum((F.col("x")[k] * float(w) for k, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    return _counted(named, Lexicon(stems)).filter(1 / (1 + F.exp(-z)) < 0.5).select("row.*")
