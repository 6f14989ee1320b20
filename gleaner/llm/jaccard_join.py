"""N-gram Jaccard self-join through a token-group matrix.

Texts become sets of hashed word shingles; equal sets are one node. Similar nodes are put into groups, each group
holds the union of its members' tokens, a query's overlap with that union bounds its overlap with every member, and
only groups that can qualify are opened.

* Order. Tokens of the lower `reach` of the hash range come first, those of a single set before the rest, these by the
  number of sets that hold them, all counted exactly; tokens beyond follow by hash.
* Candidates. Two sets with |A and B| >= t |A or B| share a token among the first n - ceil(t n) + 1 of each. A node whose
  first tokens are all its own is done; so are nodes that share none of them.
* Groups. A node joins the smallest node it shares a prefix token with; a large group is split into size classes around
  its mean size and dealt out into blocks of about `block` members. A block is a row of the matrix. Nodes visit, block by
  block, the other groups that hold one of their prefix tokens in a set of a size that can link.
* Large groups (several blocks) are not compared all with all: each block first links its own members; then the best
  connected member of each block visits the other blocks; last, members still outside their group's main component
  visit them. A block with many visitors is opened in several tasks at once, each with its members and a part of the visitors. Pairs of which both are in one component already need no comparison, so no link between components is lost.
* Links of a task are reduced to a spanning forest; components follow by alternating stars.

Scale: texts are not shuffled (the few candidates' are read again through a broadcast of their ids if it is small, by a
shuffle join beyond `broadcast_rows`); shuffles carry the tokens of the lower `reach` of the range. Copies of one text are one node.
Work of a group is block by block; in the worst case (a large group in which hardly two members link) the last step
compares its members pairwise, block by block.

Token and set hashes have 64 bits: the expected number of mistaken merges is (distinct sets)^2 / 2^65.

Defined results: a null or empty text has no shingle and links with nothing; repeated rows are one node and each gets a row;
rows of a null id count as documents without an id: they link, but never name a component; ties between leads go to the
smallest set hash; a very long text is one set like any other; an empty table gives an empty result; other columns, whatever
their names, are not read, and stay as they are where one row of each component is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import components

WIDTH, NUM, DEN = 3, 90, 100
NEAR_WIDTH, NEAR_NUM = 5, 80
BLOCK = 128
#: times 1 - t: the share of the hash range in which tokens are counted
REACH, NEAR_REACH = 1.5, 1.2
BROADCAST_ROWS = 500_000  # of ids and sizes, some 20 MB
#: visitors of one block that one task takes; the members of a block with more are replicated
VISITORS = 1024


def token_set(body: bytes, hasher: C.WordHasher, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(C.shingle_hashes(hasher(body.lower().split()), width))


def signature(tokens: np.ndarray) -> int:
    """A 64-bit hash of a sorted set, as a signed integer."""
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def set_rows(docs: DataFrame, text: str, keep: list[str], width: int, num: int, den: int, reach: float) -> DataFrame:
    """keep, then n (set size), node (set hash), need (prefix size less tokens in reach), tokens (the
    first by hash, as many as the prefix takes or the reach holds)."""
    limit = np.uint64(min(0.99, reach * (den - num) / den) * 2.0**64)

    def make():
        hasher = C.WordHasher()

        def work(arr: pa.Array) -> list[pa.Array]:
            n, node, need, first = [], [], [], []
            for body in C.texts_bytes(arr):
                tokens = token_set(body, hasher, width)
                size = len(tokens)
                n.append(size)
                node.append(signature(tokens))
                prefix = size - -(-num * size // den) + 1 if size else 0
                within = int(np.searchsorted(tokens, limit))
                need.append(prefix - within)
                first.append(tokens[: max(prefix, within)].view(np.int64))
            return [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(need, pa.int32()), pa.array(first, pa.list_(pa.int64()))]

        return work

    kinds = {"n": T.LongType(), "node": T.LongType(), "need": T.IntegerType(), "tokens": T.ArrayType(T.LongType())}
    fields = [T.StructField(c, t) for c, t in kinds.items()]
    return C.map_texts(docs, text, keep, fields, make)


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, need, tokens) -> node, n, tok, lead: prefix tokens in the exact order that other nodes' prefixes hold too.

    A node with fewer tokens in reach than its prefix takes has them all in it, and the sent ones beyond. Of another node's
    prefix, its own tokens in reach fill the first places and those that the fewest sets hold the others.
    """
    posting = nodes.select("node", "n", "need", F.explode("tokens").alias("tok"))
    held = posting.groupBy("tok").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("sets"))
    common = posting.join(held.filter("lo < hi").select("tok", "sets"), "tok")
    by_node = Window.partitionBy("node")
    ranked = common.withColumn("gl_rank", F.row_number().over(by_node.orderBy("sets", "tok"))).withColumn("gl_all", F.count("*").over(by_node))
    kept = ranked.filter("need > 0 or gl_rank <= need + gl_all").select("node", "n", "tok")
    kept = C.stored(kept, "kept")
    lead = kept.groupBy("tok").agg(F.min("node").alias("lead"), F.max("node").alias("hi")).filter("lead < hi").select("tok", "lead")
    return kept.join(lead, "tok")


class Block:
    """One row of the token-group matrix: the members' tokens, their union, and what is linked."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index = None

    def add(self, node: int, tokens: np.ndarray) -> None:
        if node not in self.nodes:
            self.nodes.append(node)
            self.sets.append(tokens)

    def _close(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets])
        tokens = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.union, first = np.unique(tokens[order], return_index=True)
        self.bounds = np.append(first, len(tokens))
        self.index = True

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the members that link with the set; the group is opened only if the union's overlap allows one."""
        if self.index is None:
            self._close()
        at = np.searchsorted(self.union, tokens)
        at = at[at < len(self.union)]
        if len(at) * self.den < self.num * len(tokens):
            return at[:0]
        hit = at[self.union[at] == tokens[: len(at)]]
        if len(hit) * self.den < self.num * len(tokens):
            return hit[:0]
        lo, hi = self.bounds[hit], self.bounds[hit + 1]
        spread = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())
        common = np.bincount(self.owner[spread], minlength=len(self.nodes))
        return np.flatnonzero(self.den * common >= self.num * (self.sizes + len(tokens) - common))

    def own_links(self) -> tuple[list[tuple[int, int]], int]:
        """The members' links as stars around each component's smallest node; and the member with most links."""
        parent = list(range(len(self.nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        degree = []
        for i, s in enumerate(self.sets):
            found = self.linked(s)
            degree.append(len(found))
            for j in found.tolist():
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b, key=self.nodes.__getitem__)] = min(a, b, key=self.nodes.__getitem__)
        out = [(self.nodes[i], self.nodes[find(i)]) for i in range(len(self.nodes)) if find(i) != i]
        return out, self.nodes[int(np.argmax(degree))]

    def visit_links(self, node: int, tokens: np.ndarray) -> list[tuple[int, int]]:
        return [(node, self.nodes[j]) for j in self.linked(tokens).tolist() if self.nodes[j] != node]


def open_blocks(plan: DataFrame, sets: DataFrame, num: int, den: int, members_too: bool, visitors: int, broadcast_rows: int) -> DataFrame:
    """plan: node, gid, blk, visits (false: member); sets: node, tokens. -> a, b, hub: links, and each block's hub (b null).

    Visitors of a block beyond `visitors` are dealt out over several tasks, each with all members of the block.
    """
    plan = C.stored(plan, "plan")
    crowd = plan.filter("visits").groupBy("gid", "blk").agg(F.count("*").alias("n")).filter(F.col("n") > visitors)
    crowd = C.counted_side(crowd.select("gid", "blk", F.ceil(F.col("n") / visitors).cast("int").alias("parts")), broadcast_rows)
    parts = F.coalesce("parts", F.lit(1))
    part = F.when(F.col("visits"), F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
    plan = plan.join(crowd, ["gid", "blk"], "left").select("node", "gid", "blk", "visits", F.explode(part).alias("part"))

    def run(batches):
        block, key, out = Block(num, den), None, []

        def close():
            if block.nodes and members_too and key[2] == 0:
                links, hub = block.own_links()
                out.extend((a, b, False) for a, b in links)
                out.append((hub, None, True))

        def emit():
            a, b, h = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.bool_())], names=["a", "b", "hub"])

        for batch in batches:
            gid, blk, part, visits, node = (batch.column(i).to_pylist() for i in range(5))
            tokens = batch.column(5)
            for i in range(batch.num_rows):
                if (gid[i], blk[i], part[i]) != key:
                    close()
                    block, key = Block(num, den), (gid[i], blk[i], part[i])
                mine = tokens[i].values.to_numpy().view(np.uint64)
                if not visits[i]:
                    block.add(node[i], mine)
                elif block.nodes:
                    out.extend((a, b, False) for a, b in block.visit_links(node[i], mine))
            if len(out) > 10_000:
                yield emit()
        close()
        if out:
            yield emit()
        C.release()

    rows = plan.join(sets, "node").select("gid", "blk", "part", "visits", "node", "tokens")
    dealt = rows.repartition("gid", "blk", "part").sortWithinPartitions("gid", "blk", "part", "visits")
    return dealt.mapInArrow(run, "a long, b long, hub boolean")


def link_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    num: int = NUM,
    den: int = DEN,
    block: int = BLOCK,
    reach: float = REACH,
    broadcast_rows: int = BROADCAST_ROWS,
    visitors: int = VISITORS,
) -> DataFrame:
    """Per document row: doc_id, text_hash, n_shingles, component_id. Two sets link if den * |and| >= num * |or|."""
    found = _linked_rows(docs, doc_id, text, width, num, den, block, reach, broadcast_rows, visitors)
    return found.select(
        F.col("gl_id").alias(doc_id),
        F.col("gl_h").alias("text_hash"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "gl_id").alias("component_id"),
    )


def _linked_rows(
    docs: DataFrame, doc_id: str, text: str, width: int, num: int, den: int, block: int, reach: float, broadcast_rows: int, visitors: int
) -> DataFrame:
    """Per document row: gl_id, gl_h, n (shingles); root and component (its smallest id) where the row has a like."""
    C.bounded_batches(docs.sparkSession)
    source = docs.select(docs[doc_id].alias("gl_id"), docs[text].cast("string").alias("gl_t"))
    source = source.withColumn("gl_h", F.xxhash64("gl_t"))
    rows = C.stored(set_rows(source, "gl_t", ["gl_id", "gl_h"], width, num, den, reach), "sets")
    nodes = rows.filter("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "need", "tokens")])
    shared = C.stored(shared_prefixes(nodes), "shared")

    group = shared.groupBy("node", "n").agg(F.min("lead").alias("lead"))
    # a large group is split into size classes around its mean size; linked sets are in one class or neighbours
    wide = group.groupBy("lead").agg(F.count("*").alias("size"), F.avg(F.log("n")).alias("mid")).filter(F.col("size") > block)
    step = (F.log("n") - F.col("mid")) / math.log(den / num) + 0.5
    group = group.join(C.counted_side(wide.select("lead", "mid"), broadcast_rows), "lead", "left")
    group = C.stored(group.select("node", "n", F.xxhash64("lead", F.coalesce(F.floor(step), F.lit(0))).alias("gid")), "group")
    size = group.groupBy("gid").agg(F.count("*").alias("size"))
    large = size.filter(F.col("size") > block).select("gid", F.ceil(F.col("size") / block).cast("int").alias("n_blk"))
    placed = group.join(C.counted_side(large, broadcast_rows), "gid", "left").withColumn("n_blk", F.coalesce("n_blk", F.lit(1)))
    placed = C.stored(placed.withColumn("blk", F.pmod(F.xxhash64("node"), "n_blk").cast("int")), "placed")

    # tokens that stand in more than one group; a node visits, block by block, the other groups that hold one of its tokens
    # in a set of a size that can link. Groups, not blocks, meet by token: a group's members share many tokens
    at = shared.select("node", "tok").join(placed.select("node", "n", "gid", "n_blk"), "node")
    crossing = at.groupBy("tok").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).filter("lo < hi").select("tok")
    at = C.stored(at.join(crossing, "tok"), "crossing")
    held = at.groupBy("tok", F.col("gid").alias("ug"), F.col("n_blk").alias("un")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (F.col("n") * num <= F.col("most") * den) & (F.col("least") * num <= F.col("n") * den)
    near = at.join(held, "tok").filter((F.col("gid") < F.col("ug")) & fits).select("node", "ug", "un").distinct()
    visits = near.select("node", F.col("ug").alias("gid"), F.explode(F.expr("sequence(0, un - 1)")).alias("blk"))
    plan = placed.select("node", "gid", "blk", F.lit(False).alias("visits")).unionByName(visits.withColumn("visits", F.lit(True)))

    sets = _candidate_sets(source, rows, placed.select("node"), width, broadcast_rows)
    first = C.stored(open_blocks(plan, sets, num, den, True, visitors, broadcast_rows), "links")
    edges = first.filter("not hub").select("a", "b")
    several = C.stored(placed.filter("n_blk > 1"), "several")
    if several.limit(1).count():
        edges = _large_groups(several, first, edges, sets, num, den, broadcast_rows, visitors)
    found = components(edges)

    sizes = rows.filter("n > 0").groupBy("node").agg(F.min("gl_id").alias("doc"), F.count("*").alias("copies"))
    classes = sizes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("doc").alias("component"), F.sum("copies").alias("members")).filter("members > 1")
    named = C.stored(classes.join(least, "root").select("node", "root", "component"), "named")
    out = rows.select("gl_id", "gl_h", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("gl_id", "gl_h", "n", "root", "component")


def _candidate_sets(source: DataFrame, rows: DataFrame, wanted: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """node, tokens of the wanted nodes: their texts are read again, one row for each node where ids are unique."""
    named = rows.groupBy("node").agg(F.min(F.struct("gl_id", "gl_h")).alias("r")).join(wanted, "node")  # copies meet before the join
    side = C.counted_side(named.select("node", F.col("r.gl_id").alias("k_id"), F.col("r.gl_h").alias("k_h")), broadcast_rows)
    texts = source.join(side, (F.col("gl_h") == F.col("k_h")) & F.col("gl_id").eqNullSafe(F.col("k_id"))).select("node", "gl_t")

    def make():
        hasher = C.WordHasher()

        def work(arr: pa.Array) -> list[pa.Array]:
            return [pa.array([token_set(b, hasher, width).view(np.int64) for b in C.texts_bytes(arr)], pa.list_(pa.int64()))]

        return work

    made = C.map_texts(texts, "gl_t", ["node"], [T.StructField("tokens", T.ArrayType(T.LongType()))], make)
    return C.stored(made, "tokens")


def _large_groups(several: DataFrame, first: DataFrame, edges: DataFrame, sets: DataFrame, num: int, den: int, broadcast_rows: int, visitors: int) -> DataFrame:
    """The links between blocks of one group that components still need."""
    members = several.select("node", "gid", "blk", F.lit(False).alias("visits"))

    def tour(who: DataFrame) -> DataFrame:
        """who (node, gid, blk, n_blk) visits all other blocks of its group."""
        every = who.select("node", "gid", F.col("blk").alias("own"), F.explode(F.expr("sequence(0, n_blk - 1)")).alias("blk"))
        every = every.filter("blk != own").select("node", "gid", "blk", F.lit(True).alias("visits"))
        return open_blocks(members.unionByName(every), sets, num, den, False, visitors, broadcast_rows).select("a", "b")

    hubs = several.join(first.filter("hub").select(F.col("a").alias("node")).distinct(), "node")
    found = components(edges.unionByName(tour(hubs)))
    now = several.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = now.groupBy("gid", "root").agg(F.count("*").alias("n")).groupBy("gid").agg(F.max(F.struct("n", "root")).alias("m"))
    main = C.counted_side(main.select("gid", F.col("m.root").alias("main")), broadcast_rows)
    rest = now.join(main, "gid").filter("root != main")
    # the components so far stand for the links that made them
    return C.stored(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(tour(rest)), "links")


def drop_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = NEAR_WIDTH, num: int = NEAR_NUM, den: int = DEN,
    reach: float = NEAR_REACH, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All columns of docs; one row of each component stays: of the smallest id, nulls last, then of the smallest text hash,
    and of rows that repeat both the smallest in JSON. Rows without a shingle have no component and all stay.
    """
    docs, names = C.by_position(docs)
    doc_id, text = (f"gl{names.index(c)}" for c in (doc_id, text))
    found = _linked_rows(docs, doc_id, text, width, num, den, BLOCK, reach, broadcast_rows, VISITORS).filter("root is not null")
    texts = C.stored(found.groupBy("root", "gl_id", "gl_h").agg(F.count("*").alias("copies")), "texts")
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("gl_id").isNull().alias("no_id"), "gl_id", "gl_h")).alias("b"))
    best = C.counted_side(best.select("root", F.col("b.gl_id").alias("b_id"), F.col("b.gl_h").alias("b_h")), broadcast_rows)
    stays = F.col("gl_id").eqNullSafe(F.col("b_id")) & (F.col("gl_h") == F.col("b_h"))
    judged = texts.join(best, "root").select(F.col("gl_id").alias("gl_gone"), F.col("gl_h").alias("gl_hash"), stays.alias("gl_stays"), "copies")
    side = C.counted_side(judged.filter("not gl_stays or copies > 1"), broadcast_rows)
    match = docs[doc_id].eqNullSafe(F.col("gl_gone")) & (F.xxhash64(docs[text].cast("string")) == F.col("gl_hash"))
    kept = docs.join(side, match, "left_anti")
    repeated = side.filter("gl_stays")
    if not repeated.limit(1).count():
        return kept.toDF(*names)
    whole = F.struct(*[docs[c] for c in docs.columns])
    again = docs.join(C.counted_side(repeated, broadcast_rows), match).select("gl_gone", "gl_hash", whole.alias("gl_row"))
    one = again.groupBy("gl_gone", "gl_hash").agg(F.min_by("gl_row", F.to_json("gl_row")).alias("gl_row"))
    return kept.unionByName(one.select("gl_row.*")).toDF(*names)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(C.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
