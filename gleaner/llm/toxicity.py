"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult, threat, target, negation, report or other. The insult acceptor is a weighted trie of word
stems: a seed list, and stems learned from labelled rows (log odds as weight). Small transducers for insults, threats (a threat
and a target within a few words, in either order), targets, negation scope and reported speech are composed into one
automaton over word classes; it marks every match with the context it stands in. A document's score is a logistic
model over its matched clauses alone: asserted insults, with their weight, their density and how many reach the count that
their entry takes; negated and reported ones, each by themselves; insults in a clause with a target; and threats. A
denied or reported insult adds nothing to what asserted ones count.

Scale: scoring is one pass, no shuffle. The model is fitted on at most `sample` labelled rows of each class (those with the
smallest hash of the id); the executors count stems and make features, the driver gets at most CANDIDATES stems and a few
numbers for each row of the sample, no texts. The class shares come from all training labels. A learned entry stands in
MIN_TOXIC toxic rows of the sample or more, has a gain (rows times log odds) above MIN_GAIN, and at most MAX_STEMS are taken.

Defined results: a null or empty text has no clauses and gets the model's base score; without labels of both classes
the seed list and default weights hold; repeated rows are each scored, and learned from once; labels of null ids are ignored;
a very long text is one text like any other; ties between stems go to the later one in order; an empty table gives an empty
result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLE = 3000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
STEM_LENGTHS = range(4, 9)
MIN_TOXIC, MIN_GAIN, MAX_STEMS, CANDIDATES = 6, 30.0, 400, 20_000

#: Seed words of the grammar in four languages.
INSULTS = """idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile
dummkopf trottel versager abschaum widerlich imbécile crétin ordure minable nul débile imbécil estúpido basura
inútil asqueroso payaso""".split()
THREATS = "kill hurt destroy beat punch stab shoot töten umbringen schlagen tuer frapper détruire matar golpear".split()
TARGETS = """you your yours u ur he him his she her they them their this these those people everyone du dich dein ihr euch sie
tu toi vous votre il elle ils tú usted ustedes él ella ellos""".split()
NEGATIONS = "not no never nobody nothing isn't aren't don't won't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = """said says told tells claimed claims reported called quoted wrote according sagte sagt behauptete nannte dit
disait raconte affirme dijo dice afirma llamó""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: clause ends to \x01; other ASCII signs but the apostrophe to a space
CLAUSE = bytes(1 if chr(b) in ".;:!?\n|" else b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().translate(CLAUSE).replace(b"\x01", b" \x01 ").split()


@dataclass(frozen=True)
class Transducer:
    """step(state, word class) -> (next state, mark); the state at a clause end is 0."""

    states: int
    table: dict[tuple[int, int], tuple[int, int]]
    default: dict[int, tuple[int, int]]

    def step(self, state: int, kind: int) -> tuple[int, int]:
        return (0, 0) if kind == END else self.table.get((state, kind), self.default[state])


NEGATED, REPORTED, TARGETED, INSULTED, THREATENED = 1, 2, 4, 8, 16
SCOPE, NEAR = 4, 3
NEGATION_SCOPE = Transducer(
    SCOPE + 1,
    {(s, NEGATION): (SCOPE, 0) for s in range(SCOPE + 1)},
    {s: (max(0, s - 1), NEGATED if s else 0) for s in range(SCOPE + 1)},
)
REPORTED_SPEECH = Transducer(2, {(0, REPORT): (1, 0), (1, REPORT): (1, 0)}, {0: (0, 0), 1: (1, REPORTED)})
AIMED = Transducer(2, {(0, TARGET): (1, TARGETED), (1, TARGET): (1, TARGETED)}, {0: (0, 0), 1: (1, TARGETED)})
INSULTS_NAMED = Transducer(1, {(0, INSULT): (0, INSULTED)}, {0: (0, 0)})
#: states 1 to NEAR: a threat that many words from lapsing; NEAR + 1 and above: a target likewise. The second of the two marks
THREATS_AIMED = Transducer(
    2 * NEAR + 1,
    {(s, THREAT): (NEAR, THREATENED if s > NEAR else 0) for s in range(2 * NEAR + 1)}
    | {(s, TARGET): (2 * NEAR, THREATENED if 0 < s <= NEAR else 0) for s in range(2 * NEAR + 1)},
    {s: (0 if s in (0, 1, NEAR + 1) else s - 1, 0) for s in range(2 * NEAR + 1)},
)


def compose(parts: list[Transducer]) -> list[list[tuple[int, int]]]:
    """The product automaton: table[state][word class] = (next state, joint marks); state 0 starts a clause."""
    numbers: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
    order, table = [(0,) * len(parts)], []
    for states in order:
        row = []
        for kind in range(7):
            steps = [p.step(s, kind) for p, s in zip(parts, states, strict=True)]
            following = tuple(s for s, _ in steps)
            if following not in numbers:
                numbers[following] = len(numbers)
                order.append(following)
            row.append((numbers[following], sum(m for _, m in steps)))
        table.append(row)
    return table


GRAMMAR = compose([NEGATION_SCOPE, REPORTED_SPEECH, AIMED, INSULTS_NAMED, THREATS_AIMED])
FEATURES = ("asserted", "repeated", "negated", "reported", "aimed", "threats", "density", "weight")


@dataclass
class Lexicon:
    """stems: prefix -> (weight, occurrences it takes); words: the seed insults with a weight."""

    stems: dict[str, tuple[float, int]] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 3.0))


class Classifier:
    """Word to class, with a bounded memo; insults carry their entry."""

    def __init__(self, lexicon: Lexicon, limit: int = 60_000):
        self.lexicon, self.limit = lexicon, limit
        self.memo: dict[bytes, int] = {}
        self.fixed = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.entries: list[tuple[float, int]] = []
        self.numbers: dict[tuple[str, bool], int] = {}
        for w, weight in lexicon.words.items():
            self._entry(w, True, (weight, 1))
        for s, entry in lexicon.stems.items():
            self._entry(s, False, entry)
        self.lengths = sorted({len(s) for s in lexicon.stems}, reverse=True)

    def _entry(self, key: str, whole: bool, entry: tuple[float, int]) -> None:
        self.numbers[key, whole] = 10 + len(self.entries)
        self.entries.append(entry)

    def _miss(self, token: bytes) -> int:
        if token == b"\x01":
            return END
        word = re.sub(r"^[\W_]+|[\W_]+$", "", token.decode())
        if (word, True) in self.numbers:
            return self.numbers[word, True]
        for n in self.lengths:
            if len(word) >= n and (word[:n], False) in self.numbers:
                return self.numbers[word[:n], False]
        return self.fixed.get(word, OTHER)

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Word classes; 10 and above: insult entries."""
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
        except KeyError:
            for w in set(words).difference(memo):
                memo[w] = self._miss(w)
            return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))


def features(codes: np.ndarray, entries: list[tuple[float, int]]) -> np.ndarray:
    """What the composed automaton finds in a document's clauses; zeros without insult or threat."""
    if not ((codes >= 10) | (codes == THREAT)).any():
        return np.zeros(len(FEATURES))
    ends = np.flatnonzero(codes == END)
    bounds = np.concatenate(([0], ends + 1, [len(codes)]))
    hot = np.flatnonzero((codes >= 10) | (codes == THREAT))
    clauses = np.unique(np.searchsorted(bounds, hot, side="right") - 1)
    count: Counter[int] = Counter()
    negated = reported = aimed = threats = 0
    for c in clauses.tolist():
        state, held, target = 0, [], False
        for code in codes[bounds[c] : bounds[c + 1]].tolist():
            state, marks = GRAMMAR[state][INSULT if code >= 10 else code]
            target |= bool(marks & TARGETED)
            if marks & (INSULTED | THREATENED):
                held.append((code, marks))
        for code, marks in held:
            if marks & NEGATED:
                negated += 1
            elif marks & REPORTED:
                reported += 1
            elif marks & INSULTED:
                count[code - 10] += 1
                aimed += target
            else:
                threats += 1
    asserted = count.total()
    enough = [e for e, n in count.items() if n >= entries[e][1]]
    weight = sum(entries[e][0] for e in enough)
    n_words = max(1, len(codes) - len(ends))
    total = sum(count[e] for e in enough)
    return np.array(
        [
            math.log1p(asserted), math.log1p(total), math.log1p(negated), math.log1p(reported), math.log1p(aimed),
            math.log1p(threats), math.log1p(1000 * total / n_words), math.sqrt(max(0.0, weight)),
        ]
    )


def stem_counts(text: str) -> Counter[str]:
    """How often each whole word (with $) and each stem of it stands in a text."""
    seen: Counter[str] = Counter()
    for token, n in Counter(tokens(text)).items():
        word = re.sub(r"^[\W_]+|[\W_]+$", "", token.decode())
        if len(word) >= STEM_LENGTHS[0]:
            seen[word + "$"] += n
            for k in STEM_LENGTHS:
                if k <= len(word):
                    seen[word[:k]] += n
    return seen


def count_stems(sample: DataFrame) -> DataFrame:
    """sample (y, t) -> stem, and in how many toxic and clean rows it stands once or more (t1, c1) and twice or more (t2, c2)."""

    def run(batches):
        for b in batches:
            found: dict[str, list[int]] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s, n in stem_counts(text or "").items():
                    row = found.setdefault(s, [0, 0, 0, 0])
                    row[1 - label] += 1
                    row[3 - label] += n > 1
            columns = list(zip(*found.values(), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["stem", "t1", "c1", "t2", "c2"])

    made = sample.select("y", "t").mapInArrow(run, "stem string, t1 long, c1 long, t2 long, c2 long")
    return made.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("t1", "c1", "t2", "c2")])


def learn_stems(counts: DataFrame, n_toxic: int, n_clean: int, clean_weight: float) -> Lexicon:
    """Whole words and stems whose presence, or repeated presence, marks the toxic rows of the sample."""
    both = counts.select("stem", F.explode(F.array(*[F.struct(F.col(t).alias("t"), (F.col(c) * clean_weight).alias("c"), F.lit(k).alias("needs")) for t, c, k in (("t1", "c1", 1), ("t2", "c2", 2))])).alias("x"))
    rows = both.select("stem", "x.*").filter((F.col("t") >= MIN_TOXIC) & (F.col("t") > 2.0 * F.col("c")))
    p, q = F.col("t") / max(1, n_toxic), (F.col("c") + 0.5) / (n_clean * clean_weight + 1)
    rows = rows.withColumn("gain", F.round(F.col("t") * F.log(p / q), 9)).filter(F.col("gain") > MIN_GAIN)
    order = [F.desc("gain"), F.asc("needs"), F.desc("stem")]
    lexicon = Lexicon()
    chosen: list[str] = []
    for r in rows.orderBy(*order).limit(CANDIDATES).collect():
        word, weight = r.stem.rstrip("$"), math.log((r.t + 0.5) / (r.c + 0.5))
        if any(word.startswith(x) or x.startswith(word) for x in chosen):
            continue
        chosen.append(word)
        if r.stem.endswith("$"):
            lexicon.words[word] = weight
        else:
            lexicon.stems[r.stem] = (weight, r.needs)
        if len(chosen) == MAX_STEMS:
            break
    return lexicon


def feature_rows(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample's rows, in order of their ids."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        classifier = Classifier(shared.value)

        def work(arr: pa.Array) -> list[pa.Array]:
            return [pa.array([features(classifier.codes(tokens(t or "")), classifier.entries).tolist() for t in arr.to_pylist()], pa.list_(pa.float64()))]

        return work

    made = C.map_texts(sample, "t", ["gl_id", "y"], [T.StructField("x", T.ArrayType(T.DoubleType()))], make)
    rows = made.select("x", "y").orderBy("gl_id").collect()  # at most two samples of a few numbers
    return np.array([r.x for r in rows]), np.array([r.y for r in rows], float)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - penalty @ beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


#: without labels: an asserted insult or threat decides
DEFAULT_BETA = np.array([2.0, 0.5, 0.2, 0.4, 0.5, 4.0, 0.0, 0.5, -3.0])


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    beta: np.ndarray = field(default_factory=DEFAULT_BETA.copy)


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, sample: int, train) -> tuple[DataFrame, dict]:
    """gl_id, y, t of at most `sample` rows of each class, stored; and the classes' counts over all training labels."""
    known = labels.select(labels["doc_id"].alias("gl_id"), labels["toxic"].cast("int").alias("gl_y")).dropna()
    known = known.filter(train(F.col("gl_id")) & F.col("gl_y").isin(0, 1)).groupBy("gl_id").agg(F.max("gl_y").alias("gl_y"))
    counts = {r.gl_y: r["count"] for r in known.groupBy("gl_y").count().collect()}
    chosen = [known.filter(F.col("gl_y") == y).orderBy(F.xxhash64("gl_id"), "gl_id").limit(sample) for y in (0, 1)]
    side = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    rows = docs.select(docs[doc_id].alias("gl_d"), docs[text].cast("string").alias("gl_t")).join(side, F.col("gl_d") == F.col("gl_id"))
    firsts = rows.groupBy("gl_id").agg(F.max("gl_y").alias("y"), F.min("gl_t").alias("t"))  # one row of repeated ids
    return C.stored(firsts.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "gl_id"), "sample"), counts


def train_model(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, train=None
) -> Model:
    """train: a predicate over the id column that says which labelled rows may be learned from (default: all)."""
    rows, counts = training_rows(docs, labels, doc_id, text, sample, train or (lambda c: F.lit(True)))
    found = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = found.get(1, 0), found.get(0, 0)
    if min(n_toxic, n_clean) < 5:
        return Model()
    clean_weight = (counts[0] / n_clean) / (counts[1] / n_toxic)
    lexicon = learn_stems(count_stems(rows), n_toxic, n_clean, clean_weight)
    x, y = feature_rows(rows, lexicon)
    return Model(lexicon, fit_logistic(x, y, np.where(y > 0, 1.0, clean_weight)))


def score_toxicity(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then score (0 to 1) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        beta, classifier = shared.value.beta, Classifier(shared.value.lexicon)

        def work(arr: pa.Array) -> list[pa.Array]:
            x = [features(classifier.codes(tokens(t or "")), classifier.entries) for t in arr.to_pylist()]
            z = np.array(x).reshape(-1, len(FEATURES)) @ beta[:-1] + beta[-1]
            return [pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9), pa.float64())]

        return work

    return C.map_texts(docs, text, keep, [T.StructField("score", T.DoubleType())], make)


def in_training_fold(col):
    return C.crc_rest(col, FOLDS) != HELD_OUT


def reject_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that score below the threshold."""
    model = train_model(docs, labels, text=text, train=in_training_fold)
    plain, names = C.by_position(docs)
    scored = score_toxicity(plain, model, keep=plain.columns, text=f"gl{names.index(text)}")
    return scored.filter(F.col("score") < threshold).drop("score").toDF(*names)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = train_model(docs, C.read(spark, sf_dir, "labels"), train=in_training_fold)
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        (~in_training_fold(F.col("doc_id"))).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
