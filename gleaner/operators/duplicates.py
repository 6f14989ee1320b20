"""Exact and near duplicates, overlap links, and the collapse of duplicate groups after ranking."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schema as S
from gleaner.functions import vectors as V

NEAR, OVERLAP = 0.9, 0.7
BANDS, ROWS = 25, 5
PRIME = (1 << 31) - 1
#: What a link says for itself.
EXACT_EVIDENCE, NEAR_EVIDENCE, OVERLAP_EVIDENCE = "identieke inhoud (sha256:%s)", "near-duplicate cosine=%.3f", "overlap cosine=%.3f"
#: rounds of the greedy rule in joins, and the links that may be left for one task after them
LEADER_ROUNDS, ONE_TASK_EDGES = 6, 1_000_000


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs (id, source_path, text) -> source, target: equal non-empty texts, the lowest path is the target.

    A group's first document comes from an aggregate, so a group of any size is never in one task.
    """
    keyed = docs.filter(F.length("text") > 0).select("id", "source_path", F.sha2("text", 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min(F.struct("source_path", "id")).alias("m"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, "digest").select(F.col("id").alias("source"), F.col("m.id").alias("target"), F.format_string(EXACT_EVIDENCE, F.substring("digest", 1, 12)).alias("evidence")).filter("source != target")


def permutation(i: int) -> tuple[int, int]:
    """The multiplier and offset of the i-th hash function: x -> (a x + b) mod 2^31 - 1."""
    return (i * 2654435761 + 40503) % (PRIME - 1) + 1, (i * 1640531527 + 12345) % PRIME


def band_keys(bands: int = BANDS, rows: int = ROWS):
    """A column function text -> array<string>, one key for each band of MinHash values of its 3-token shingles."""
    pairs = np.array([permutation(i) for i in range(bands * rows)], np.int64)

    def one(text: str | None) -> list[str]:
        toks = V.TOKEN.findall((text or "").lower())
        grams = {" ".join(toks[i : i + 3]) for i in range(len(toks) - 2)} if len(toks) >= 3 else set(toks)
        if not grams:
            return []
        x = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "big") % PRIME for g in grams], np.int64)
        low = np.full(len(pairs), PRIME, np.int64)
        for i in range(0, len(x), 2000):
            low = np.minimum(low, ((pairs[:, :1] * x[None, i : i + 2000] + pairs[:, 1:]) % PRIME).min(axis=1))
        return [f"{b}:" + ",".join(map(str, low[b * rows : (b + 1) * rows])) for b in range(bands)]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return keys


def minhash_candidates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (id, text) -> a, b (a < b): pairs that share a band key, each once.

    Equal texts share every band, so one of each text stands for all: exact copies belong to exact_duplicates. The keys are made
    in one pass and travel as 64-bit hashes with the text's digest; no text is shuffled.
    """
    keys = F.transform(F.array_distinct(band_keys(bands, rows)("text")), lambda k: F.xxhash64(k))
    made = docs.select("id", F.sha2("text", 256).alias("digest"), keys.alias("keys"))
    one = made.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    keyed = one.select(F.col("id").alias("a"), F.explode("keys").alias("h"))
    pairs = keyed.join(keyed.withColumnRenamed("a", "b"), "h").filter("a < b")
    return pairs.select("a", "b").distinct()


def cosine_edges(docs: DataFrame, pairs: DataFrame, threshold: float = OVERLAP, *, embed=V.hashing_embed, store=None) -> DataFrame:
    """pairs (a, b) with the cosine of the whole documents' vectors, rounded to 6 decimals, at or above the threshold.

    embed: a column function text -> vector. Only documents of a pair are embedded; with `store` each of them once.
    """
    paired = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = docs.join(paired, "id", "left_semi").select("id", embed("text").alias("v"))
    vectors = store(vectors) if store else vectors
    left = pairs.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
    both = left.join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return both.select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cos")).filter(F.col("cos") >= threshold)


def greedy_leaders(edges: pd.DataFrame) -> pd.DataFrame:
    """Leaders among the nodes of edges (a, b), a before b: in order, a node without an earlier adjacent leader."""
    earlier = edges.groupby("b")["a"].agg(list).to_dict()
    chosen: set = set()
    for node in sorted(set(edges["a"]) | set(edges["b"])):
        if not chosen.intersection(earlier.get(node, ())):
            chosen.add(node)
    return pd.DataFrame({"node": sorted(chosen)})


def leaders(nodes: DataFrame, edges: DataFrame, store, max_rounds: int = 10_000, rounds: int = LEADER_ROUNDS, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """node, leader under the greedy rule: in order of nodes, a node without an earlier adjacent leader is a leader; any
    other belongs to its first adjacent leader. edges (a, b): a before b. Each round decides every node whose earlier neighbours are decided
    or one of whose earlier neighbours is a leader. What is undecided after `rounds` of them (long chains) is decided in one
    task, in order, once its links are counted and are at most `one_task`; until then the rounds go on."""
    open_ = store(edges.select("a", "b").distinct())
    chief = edges.select(F.col("b").alias("node")).distinct()
    lead = store(nodes.select("node").join(chief, "node", "left_anti"))
    undecided = store(chief)
    for i in range(max_rounds):
        follows = store(open_.join(lead.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct())
        undecided = store(undecided.join(follows, "node", "left_anti"))
        if not undecided.limit(1).count():
            break
        if i >= rounds:
            left = F.broadcast(undecided) if undecided.limit(one_task + 1).count() <= one_task else undecided
            rest = open_.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi")
            rest = store(rest.select("a", "b"))
            if rest.limit(one_task + 1).count() <= one_task:
                alone = undecided.join(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti")
                lead = store(lead.unionByName(alone).unionByName(rest.groupBy().applyInPandas(greedy_leaders, "node string")))
                break
        blocked = open_.join(undecided.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        fresh = store(undecided.join(blocked, "node", "left_anti"))
        lead = store(lead.unionByName(fresh))
        undecided = store(undecided.join(fresh, "node", "left_anti"))
    else:
        raise RuntimeError(f"leaders not decided after {max_rounds} rounds")
    first = edges.join(lead.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    return nodes.select("node").join(first, "node", "left").join(lead.withColumn("self", F.lit(True)), "node", "left").select(
        "node", F.when(F.col("self"), F.col("node")).otherwise(F.col("leader")).alias("leader")
    )


def near_duplicates(docs: DataFrame, store, *, near: float = NEAR, overlap: float = OVERLAP, embed=V.hashing_embed, pairs: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """docs (id, source_path, text) without exact copies -> source, kind, target, evidence, cosine in path order."""
    byname = docs.select("id", "source_path")
    if edges is None:
        pairs = pairs if pairs is not None else minhash_candidates(docs.select("id", "text"))
        edges = cosine_edges(docs, store(pairs), overlap, embed=embed, store=store)
    a, b = byname.toDF("a", "pa"), byname.toDF("b", "pb")
    rows = edges.join(a, "a").join(b, "b")
    swap = F.col("pa") > F.col("pb")
    rows = rows.select(
        F.when(swap, F.col("pb")).otherwise(F.col("pa")).alias("a"), F.when(swap, F.col("pa")).otherwise(F.col("pb")).alias("b"), "cos"
    )
    rows = store(rows)
    close = rows.filter(F.col("cos") >= near)
    lead = store(leaders(byname.select(F.col("source_path").alias("node")), close, store))
    dup = close.join(lead.select(F.col("node").alias("b"), F.col("leader").alias("a")), ["a", "b"])
    la, lb = lead.toDF("a", "la"), lead.toDF("b", "lb")
    band = rows.filter(F.col("cos") < near).join(la, "a").join(lb, "b").filter("la = a and (lb = b or lb > a)")
    made = dup.select("a", "b", "cos", F.lit(S.DUPLICATE_OF).alias("kind")).unionByName(band.select("a", "b", "cos", F.lit(S.OVERLAPS_WITH).alias("kind")))
    ids = byname.select(F.col("id"), F.col("source_path"))
    made = made.join(ids.toDF("target", "a"), "a").join(ids.toDF("source", "b"), "b")
    evidence = F.when(F.col("kind") == S.DUPLICATE_OF, F.format_string(NEAR_EVIDENCE, "cos")).otherwise(F.format_string(OVERLAP_EVIDENCE, "cos"))
    return made.select("source", "kind", "target", evidence.alias("evidence"), F.col("cos").alias("cosine"))


def group_roots(candidates: DataFrame, duplicate_of: DataFrame) -> DataFrame:
    """id, root: follow duplicate-of (source, target) inside the candidates; exact copy, its first, that one's leader: two steps."""
    inside = candidates.select(F.col("id").alias("target"))
    links = duplicate_of.groupBy("source").agg(F.min("target").alias("target")).join(inside, "target")
    one = candidates.select("id").join(links.select(F.col("source").alias("id"), F.col("target").alias("r1")), "id", "left")
    two = one.withColumn("r1", F.coalesce("r1", "id")).join(links.select(F.col("source").alias("r1"), F.col("target").alias("r2")), "r1", "left")
    return two.select("id", F.coalesce("r2", "r1").alias("root"))


def collapse(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each group the best (final desc, source_path) stays; the others get out_of_scope and a reason that names it.

    The best comes from an aggregate, not a window, so a large group needs no single task.
    """
    rows = candidates.join(roots, "id")
    best = rows.groupBy("root").agg(F.min(F.struct((-F.col("final")).alias("f"), "source_path", "id")).alias("m"))
    out = rows.join(best, "root")
    gone = F.col("id") != F.col("m.id")
    reason = F.format_string("duplicaat van %s (final %.4f)", F.col("m.id"), -F.col("m.f"))
    return out.withColumns(
        {
            "decision": F.when(gone, S.OUT_OF_SCOPE).otherwise(F.col("decision")),
            "decision_reason": F.when(gone, reason).otherwise(F.col("decision_reason")),
        }
    ).drop("m", "root")
