"""A two-level topic map: average-linkage clusters of chunk vectors, documents by majority, labels by TF-IDF.

The average cosine distance of two clusters of unit vectors is one minus the product of their means, so a cluster is fully
told by its sum and its size. Up to MAX_POINTS distinct vectors the linkage is exact. Beyond, points are dealt into cells
around pivots, each cell merges its nearest points into sums first, and so on until MAX_POINTS are left for the exact end;
only merges across cells that would have come early can differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions import vectors as V
from gleaner.plans.runtime import storer

REST = "Overig"
UNNAMED = "onbenoemd"
TOPIC_DISTANCE, SUBTOPIC_DISTANCE, MIN_SIZE, CHUNK_CAP = 0.8, 0.5, 3, 40
#: points that one task links exactly (a matrix of their squares); points of a cell; pivots of one round at most
MAX_POINTS, CELL, MAX_PIVOTS = 6_000, 1_500, 4_096
LABEL_TERMS, LABEL_LENGTH = 3, 3


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length == 0, 1, length)[:, None]


def average_linkage(x: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of UPGMA on cosine distances by nearest-neighbour chains; a, b: row numbers inside the clusters.

    Rows are vectors, or with `weight` means of that many unit vectors. Ties go to the lower row number, so the result depends on
    the rows' order alone. Merges come in no order of height.
    """
    n = len(x)
    mean = unit(x) if weight is None else x
    gap = 1 - mean @ mean.T
    np.fill_diagonal(gap, np.inf)
    size, alive = np.ones(n) if weight is None else weight.astype(float), np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            at = chain[-1]
            near = int(np.argmin(gap[at]))
            if len(chain) > 1 and gap[at, chain[-2]] <= gap[at, near]:
                near = chain[-2]
                break
            chain.append(near)
        del chain[-2:]
        keep, gone = min(at, near), max(at, near)
        merges.append((keep, gone, float(gap[keep, gone])))
        row = (size[keep] * gap[keep] + size[gone] * gap[gone]) / (size[keep] + size[gone])
        row[~alive] = np.inf
        gap[keep], gap[:, keep] = row, row
        gap[gone], gap[:, gone], gap[keep, keep] = np.inf, np.inf, np.inf
        size[keep] += size[gone]
        alive[gone] = False
    return merges


def cut(n: int, merges: list[tuple[int, int, float]], distance: float) -> list[int]:
    """Cluster numbers when merges up to `distance` hold, numbered by their first row."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, height in merges:
        if height <= distance:
            parent[find(b)] = find(a)
    numbers: dict[int, int] = {}
    return [numbers.setdefault(find(i), len(numbers)) for i in range(n)]


def two_level(vectors: np.ndarray, topic_distance: float, subtopic_distance: float, weight: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Both cuts of one dendrogram, so subtopics lie inside topics."""
    if len(vectors) <= 1:
        return [0] * len(vectors), [0] * len(vectors)
    merges = average_linkage(vectors, weight)
    return cut(len(vectors), merges, topic_distance), cut(len(vectors), merges, subtopic_distance)


def merged_cell(mean: np.ndarray, weight: np.ndarray, distance: float) -> list[int]:
    """Cluster numbers of one cell: merges up to the distance hold, and of the others the lowest until half of the points are left."""
    merges = sorted(average_linkage(mean, weight), key=lambda m: m[2])
    near = sum(h <= distance for _, _, h in merges)
    kept = max(near, len(mean) - (len(mean) + 1) // 2)
    # heights are sorted stably and no merge is lower than those inside it, so any first ones are a cut
    return cut(len(mean), [(a, b, 0.0) for a, b, _ in merges[:kept]], 0.0)


def _majority(clusters: list[int], medoid: int) -> int:
    counts = {c: clusters.count(c) for c in clusters}
    top = max(counts.values())
    tied = [c for c, k in counts.items() if k == top]
    return clusters[medoid] if clusters[medoid] in tied else min(tied)


def assign(vectors: list[np.ndarray], topics: list[int], subtopics: list[int]) -> tuple[int, int]:
    """One document's topic by majority of its chunks, and its subtopic by majority within that topic."""
    mean = np.mean(vectors, axis=0)
    scale = np.linalg.norm(mean)
    close = [float(v @ mean) / (np.linalg.norm(v) * scale) if scale and np.linalg.norm(v) else 0.0 for v in vectors]
    medoid = max(range(len(vectors)), key=lambda i: (close[i], -i))
    topic = _majority(topics, medoid)
    inside = [i for i, t in enumerate(topics) if t == topic]
    nearest = max(inside, key=lambda i: (close[i], -i))
    return topic, _majority([subtopics[i] for i in inside], inside.index(medoid if medoid in inside else nearest))


def chunk_vectors(docs: DataFrame, *, cap: int = CHUNK_CAP, size: int = X.CHUNK_SIZE) -> DataFrame:
    """docs (id, text) -> id, ordinal, v: unit vectors of at most `cap` evenly spaced chunks; unusable ones are left out."""
    whole = F.transform(X.chunks(F.col("text"), size), lambda c, i: F.struct(i.alias("ordinal"), c.alias("chunk")))
    rows = docs.select("id", F.inline(X.even_sample(whole, cap)))
    return rows.select("id", "ordinal", V.hashing_embed("chunk").alias("v")).filter(V.usable(F.col("v")))


def _points(vectors: DataFrame) -> DataFrame:
    """vectors (id, ordinal, v) -> id, ordinal, v (unit length), point: equal vectors are one point, named by its first chunk."""
    n = V.norm(F.col("v"))
    rows = vectors.select("id", "ordinal", F.transform("v", lambda x: F.round(x.cast("double") / n, 12)).alias("v"))
    name = F.struct("id", F.col("ordinal").cast("long").alias("ordinal"))
    first = rows.groupBy("v").agg(F.min(name).alias("point"))
    return rows.join(first, "v")


def _in_cells(points: DataFrame, n: int, distance: float, store) -> DataFrame:
    """points (point, s, n) -> point, into (the point that it is merged into, decided cell by cell), and s, n of the points that stay."""
    pivots = min(MAX_PIVOTS, -(-n // CELL) * 2)
    chosen = points.orderBy(F.xxhash64("point.id", "point.ordinal"), "point").limit(pivots).select("s").toArrow()  # at most MAX_PIVOTS vectors
    centres = unit(np.array(chosen["s"].to_pylist(), np.float64))
    shared = points.sparkSession.sparkContext.broadcast(centres.T.astype(np.float32))

    @F.pandas_udf("int")
    def nearest(s: pd.Series) -> pd.Series:
        x = np.array(s.tolist(), np.float32)
        return pd.Series((x @ shared.value).argmax(axis=1).astype(np.int32))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[(p["id"], p["ordinal"]) for p in pdf["point"]]).sort_values("key")
        weight = pdf["n"].to_numpy(float)
        mean = np.array(pdf["s"].tolist(), float) / weight[:, None]
        keys, heads, into = pdf["key"].tolist(), {}, []
        for k, c in zip(keys, merged_cell(mean, weight, distance), strict=True):
            into.append(heads.setdefault(c, k))
        place = {k: i for i, k in enumerate(heads.values())}
        at, size = np.array([place[k] for k in into]), len(place)
        total, count = np.zeros((size, mean.shape[1])), np.bincount(at, weight, size)
        np.add.at(total, at, mean * weight[:, None])
        head = [k if k == t else None for k, t in zip(keys, into, strict=True)]
        return pd.DataFrame({
            "id": [k[0] for k in keys], "ordinal": [k[1] for k in keys], "to_id": [k[0] for k in into], "to_ordinal": [k[1] for k in into],
            "s": [None if h is None else total[place[h]] for h in head], "n": pd.array([None if h is None else int(count[place[h]]) for h in head], "Int64"),
        })

    celled = store(points.withColumn("cell", nearest("s")))
    # a cell that many points are nearest to is dealt out evenly
    size = celled.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))  # at most MAX_PIVOTS rows
    part = F.pmod(F.xxhash64("point.id", "point.ordinal"), F.col("parts"))
    dealt = celled.join(F.broadcast(size), "cell").withColumn("part", part)
    made = dealt.groupBy("cell", "part").applyInPandas(merge, "id string, ordinal long, to_id string, to_ordinal long, s array<double>, n long")
    return made.select(F.struct("id", "ordinal").alias("point"), F.struct(F.col("to_id").alias("id"), F.col("to_ordinal").alias("ordinal")).alias("into"), "s", "n")


def _centres(placed: DataFrame) -> DataFrame:
    """topic_no, centre: the direction of the sum of the documents' means; each batch sends one sum for each of its topics."""

    def partial(batches):
        for b in batches:
            for topic, part in b.groupby("topic_no"):
                yield pd.DataFrame({"topic_no": [topic], "s": [np.sum(part["s"].tolist(), axis=0)]})

    flat = placed.select("topic_no", "s").mapInPandas(partial, "topic_no long, s array<double>").select("topic_no", F.posexplode("s").alias("pos", "x"))
    flat = flat.groupBy("topic_no", "pos").agg(F.sum("x").alias("x"))
    return flat.groupBy("topic_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centre"))


def cluster(
    vectors: DataFrame, *, topic_distance: float = TOPIC_DISTANCE, subtopic_distance: float = SUBTOPIC_DISTANCE, store=None, max_points: int = MAX_POINTS
) -> DataFrame:
    """vectors (id, ordinal, v) -> id, topic_no, subtopic_no, closeness (to the document's topic mean).

    Exact average linkage up to max_points distinct vectors; beyond that, cells of points merge first (see above) within half the
    subtopic distance, or, where that leaves too many, as far as is needed. Nothing is sampled or refused.
    """
    store = store or storer(vectors.sparkSession)
    rows = store(_points(vectors))
    points = store(rows.groupBy("point").agg(F.first("v").alias("s"), F.count("*").alias("n")))
    named = rows.select("id", "ordinal", "v", F.col("point").alias("at"))
    while (n := points.count()) > max_points:
        into = store(_in_cells(points, n, subtopic_distance / 2, store))
        points = into.filter("n is not null").select("point", "s", "n")
        named = store(named.join(into.select(F.col("point").alias("at"), "into"), "at").select("id", "ordinal", "v", F.col("into").alias("at")))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "ordinal"]).reset_index(drop=True)
        weight = pdf["n"].to_numpy(float)
        topics, subs = two_level(np.array(pdf["s"].tolist(), float).reshape(len(pdf), -1) / weight[:, None], topic_distance, subtopic_distance, weight)
        return pd.DataFrame({"id": pdf["id"], "ordinal": pdf["ordinal"], "topic": topics, "subtopic": subs})

    linked = points.select("point.*", "s", "n").groupBy().applyInPandas(link, "id string, ordinal long, topic long, subtopic long")
    linked = store(linked.select(F.struct("id", "ordinal").alias("at"), "topic", "subtopic"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", kind="stable")
        own = [np.array(v, float) for v in pdf["v"]]
        topic, sub = assign(own, pdf["topic"].tolist(), pdf["subtopic"].tolist())
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "topic_no": [topic], "subtopic_no": [sub], "s": [np.mean(own, axis=0)]})

    chunks = named.join(linked, "at").select("id", "ordinal", "v", "topic", "subtopic")
    placed = store(chunks.groupBy("id").applyInPandas(place, "id string, topic_no long, subtopic_no long, s array<double>"))
    close = F.round(V.cosine(F.col("s"), F.col("centre")), 9)
    return placed.join(_centres(placed), "topic_no").select("id", "topic_no", "subtopic_no", close.alias("closeness"))


def collapse_small(docs: DataFrame, clusters: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """id, topic_no, subtopic_no, closeness of every document; null numbers: too small a topic, or no usable chunk."""
    sizes = clusters.groupBy("topic_no").agg(F.count("*").alias("n"))
    kept = clusters.join(sizes.filter(F.col("n") >= min_size), "topic_no").drop("n")
    return docs.select("id").join(kept, "id", "left").select("id", "topic_no", "subtopic_no", "closeness")


def tfidf_labels(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members (cluster, id), docs (id, text) -> cluster, label: the three terms with the highest share in the cluster times
    log(total / (1 + df)); ties by term; at least three letters."""
    terms = docs.select("id", F.explode(F.array_distinct(X.tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    total = docs.count()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    held = members.join(terms, "id").filter(F.length("term") >= LABEL_LENGTH).groupBy("cluster", "term").agg(F.count("*").alias("n"))
    scored = held.join(df, "term").join(size, "cluster").withColumn("s", F.round(F.col("n") / F.col("size") * F.log(F.lit(float(total)) / (1 + F.col("df"))), 9))
    order = Window.partitionBy("cluster").orderBy(F.desc("s"), "term")
    top = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= LABEL_TERMS)
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]), ", ")
    named = top.groupBy("cluster").agg(label.alias("label"))
    return size.select("cluster").join(named, "cluster", "left").select("cluster", F.coalesce("label", F.lit(UNNAMED)).alias("label"))


def model_labels(members: DataFrame, docs: DataFrame, llm, store, *, reps: int = 5, log=None) -> DataFrame:
    """The same from one model call a cluster: the texts of its first members by closeness; the first line that is not empty."""

    def ask(batches):
        for b in batches:
            prompts = ["Geef één onderwerp-label voor:\n" + "\n".join(f"- {t}" for t in texts) for texts in b["texts"]]
            out = [next((x.strip() for x in llm.complete(p).splitlines() if x.strip()), UNNAMED) for p in prompts]
            yield pd.DataFrame({"cluster": b["cluster"], "prompt": prompts, "label": out})

    order = Window.partitionBy("cluster").orderBy(F.desc("closeness"), "id")
    first = members.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= reps).join(docs, "id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring("text", 1, 400).alias("t")))), lambda x: x["t"])
    kind = dict(members.dtypes)["cluster"]
    answers = store(first.groupBy("cluster").agg(texts.alias("texts")).mapInPandas(ask, f"cluster {kind}, prompt string, label string"))
    if log:
        log(answers)
    return answers.select("cluster", "label")


def label_topics(docs: DataFrame, placed: DataFrame, labels=tfidf_labels) -> DataFrame:
    """id, topic, subtopic, topic_no, subtopic_no, closeness: names of both levels; the rest is one topic of its own."""
    inside = placed.filter("topic_no is not null")
    tops = labels(inside.select(F.col("topic_no").cast("string").alias("cluster"), "id", "closeness"), docs)
    sub_key = F.concat_ws(":", F.col("topic_no").cast("string"), F.col("subtopic_no").cast("string"))
    subs = labels(inside.select(sub_key.alias("cluster"), "id", "closeness"), docs)
    out = placed.withColumns({"c1": F.col("topic_no").cast("string"), "c2": sub_key})
    out = out.join(tops.toDF("c1", "l1"), "c1", "left").join(subs.toDF("c2", "l2"), "c2", "left")
    rest = F.col("topic_no").isNull()
    return out.select(
        "id", F.when(rest, REST).otherwise(F.col("l1")).alias("topic"), F.when(rest, REST).otherwise(F.col("l2")).alias("subtopic"), "topic_no", "subtopic_no", "closeness"
    )


def topic_menu(labelled: DataFrame) -> DataFrame:
    """One row for each topic in order (the rest last): label, subtopics array<struct<label, doc_ids>>; medoids first."""
    order = F.struct((-F.coalesce("closeness", F.lit(0.0))).alias("c"), "id")
    subs = labelled.groupBy("topic_no", "topic", "subtopic_no", "subtopic").agg(F.array_sort(F.collect_list(order)).alias("m"))
    entry = F.struct("subtopic_no", F.col("subtopic").alias("label"), F.transform("m", lambda x: x["id"]).alias("doc_ids"))
    tops = subs.groupBy("topic_no", "topic").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    plain = F.transform("e", lambda x: F.struct(x["label"].alias("label"), x["doc_ids"].alias("doc_ids")))
    return tops.select(F.col("topic").alias("label"), plain.alias("subtopics"), F.coalesce("topic_no", F.lit(1 << 40)).alias("position")).orderBy("position")
