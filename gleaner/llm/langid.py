"""Language identification by hierarchical discrimination.

A text becomes hashed byte 1- to 4-grams of its lower-cased letters (square roots of counts, unit length). Linear
support vector machines, one for each family against the rest, choose the family; inside it one-versus-one machines
vote, ties go to the larger sum of margins, then to the name.

Scale: prediction is one pass, no shuffle; the weights are a fixed-size broadcast. The machines are fitted on the
driver on at most `per_lang` rows of each language (those with the smallest hash of the id) and `sample_rows` rows of all: the
executors make the vectors, the driver gets DIMENSIONS numbers for each row of the sample, no texts.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled row all are `und`;
with one language all other texts are that language; repeated rows are each judged, and learned from once; null langs are not
learned from; ties go to the larger sum of margins, then to the name; a very long text is one text like any other; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

PER_LANG = 500
SAMPLE_ROWS = 8_000
DIMENSIONS = 1 << 12
HASH_RANGE = 1 << 40
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

#: Language families; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn ur mr gu pa ne si".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue wuu".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: A fixed odd multiplier for each n-gram length.
SALT = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * n * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF | 1) for n in (1, 2, 3, 4)}


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed n-gram features of the whole text; unit length, or zeros."""
    body = b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())
    x = np.frombuffer(b" " + body + b" ", np.uint8).astype(np.uint64)
    shift = np.uint64(64 - dimensions.bit_length() + 1)
    out, gram = np.zeros(dimensions), np.zeros(len(x), np.uint64)
    for n in (1, 2, 3, 4):
        if len(x) < n:
            break
        gram = (gram[: len(x) - n + 1] << np.uint64(8)) | x[n - 1 :]
        out += np.bincount(((gram + np.uint64(1)) * SALT[n] >> shift).astype(np.int64), minlength=dimensions)
    out = np.sqrt(out)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Squared-hinge linear machine, classes weighted alike, by accelerated gradient; x has unit rows, y is -1 or 1.

    The last weight belongs to a constant feature.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    rate = 1.0 / (4.0 + penalty)  # rows have squared length 2, weights sum to 1
    w = np.zeros(x.shape[1], x.dtype)
    ahead, momentum = w, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * np.einsum("ij,j->i", x, ahead))  # einsum: one thread, whatever the machine offers
        grad = penalty * ahead - 2 * np.einsum("ij,i->j", x, weight * y * slack)
        new = ahead - rate * grad
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = new + float((momentum - 1) / following) * (new - w)  # a plain float keeps the arrays at 32 bits
        w, momentum = new, following
    return w.astype(np.float64)


@dataclass
class Model:
    """families: name -> languages; top: weights of each family; pairs: (a, b) -> weights, positive for a."""

    families: dict[str, list[str]]
    top: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        v = np.append(vector(text), 1.0)
        sure = 1.0
        if len(self.families) == 1:
            family = next(iter(self.families))
        else:
            margins = {f: float(w @ v) for f, w in self.top.items()}
            family = max(sorted(margins), key=margins.__getitem__)
            second = max(m for f, m in margins.items() if f != family)
            sure = 1 / (1 + np.exp(-2 * (margins[family] - second)))
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], round(float(sure), 9)
        votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            m = float(self.pairs[a, b] @ v)
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(langs, key=lambda x: (votes[x], sums[x], [-ord(c) for c in x]))
        least = min(abs(float(self.pairs[p] @ v)) for p in self.pairs if best in p)
        return best, round(float(sure / (1 + np.exp(-4 * least))), 9)


def fit(texts: list[str], langs: list[str]) -> Model:
    return fit_vectors(np.array([vector(t) for t in texts], np.float32), langs)


def fit_vectors(x: np.ndarray, langs: list[str]) -> Model:
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    if not families:
        return Model({}, {}, {})
    names = np.array(langs)
    family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
    top = {f: fit_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in families} if len(families) > 1 else {}
    pairs = {}
    for members in families.values():
        for a, b in combinations(members, 2):
            both = (names == a) | (names == b)
            pairs[a, b] = fit_svm(x[both], np.where(names[both] == a, 1, -1).astype(np.float32))
    return Model(families, top, pairs)


def train_model(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, sample_rows: int = SAMPLE_ROWS, train=None
) -> Model:
    """train: a predicate over the id column that says which rows may be learned from (default: all)."""
    rows = docs.select(docs[doc_id].alias("gl_id"), docs[lang].cast("string").alias("gl_lang"), docs[text].alias("gl_t"))
    known = rows.filter(F.col("gl_lang").isNotNull() & F.col("gl_t").isNotNull())
    if train is not None:
        known = known.filter(train(F.col("gl_id")))
    # the smallest hashes of each language: a threshold from its count leaves about four times what is wanted to be ranked
    counts = C.counted_side(known.groupBy("gl_lang").agg(F.count("*").alias("gl_count")), 10_000)
    per_lang = max(1, min(per_lang, sample_rows // max(1, counts.count())))
    keys = known.select("gl_id", "gl_lang", F.pmod(F.xxhash64("gl_id"), F.lit(HASH_RANGE)).alias("gl_order")).join(counts, "gl_lang")
    keys = keys.filter(F.col("gl_order") <= F.lit(4.0 * per_lang * HASH_RANGE) / F.col("gl_count"))
    rank = F.row_number().over(Window.partitionBy("gl_lang").orderBy("gl_order", "gl_id"))
    keys = keys.withColumn("gl_n", rank).filter(F.col("gl_n") <= per_lang)
    side = F.broadcast(keys.select("gl_id", "gl_lang").distinct())  # at most per_lang rows of each language
    firsts = known.join(side, ["gl_id", "gl_lang"]).groupBy("gl_id", "gl_lang").agg(F.min("gl_t").alias("t"))
    made = C.map_texts(firsts, "t", ["gl_id", "gl_lang"], [T.StructField("v", T.BinaryType())], _vectors)
    found = made.filter("v is not null").orderBy("gl_lang", F.xxhash64("gl_id"), "gl_id").select("gl_lang", "v").collect()  # at most sample_rows vectors
    x = np.frombuffer(b"".join(r.v for r in found), np.float32).reshape(len(found), DIMENSIONS)
    return fit_vectors(x, [r.gl_lang for r in found])


def _vectors():
    return lambda arr: [pa.array([vector(t).astype(np.float32).tobytes() if has_letter(t) else None for t in arr.to_pylist()], pa.binary())]


def identify(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        model = shared.value

        def work(arr: pa.Array) -> list[pa.Array]:
            found = [model.predict(t) for t in arr.to_pylist()]
            return [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

        return work

    return C.map_texts(docs, text, keep, fields, make)


def in_training_fold(col):
    return C.crc_rest(col, FOLDS) != HELD_OUT


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    found = identify(docs, train_model(docs, train=in_training_fold), keep=["doc_id"])
    return found.select("doc_id", (~in_training_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
