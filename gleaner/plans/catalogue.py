"""The registered queries of the document-convergence operators, and the same in SQL where SQL can say it.

Every query runs over its whole tables. Queries that need signals which the tables lack (redactions, mail subjects) derive
them from columns, the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import schema as S
from gleaner.functions import text as X
from gleaner.functions import vectors as V
from gleaner.operators import duplicates, ranking, scope, select, threads, topics, validity
from gleaner.plans.relate import numbered
from gleaner.plans.runtime import storer
from gleaner.sources import files

QUERY = "the of and thing report"
TARGET, TOP_N, THRESHOLD, BIAS = 100, 50, 0.5, 0.02


SMALL_SHARE = 4 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one too small to fill the cores by its files alone (a single row group) is dealt out evenly."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_SHARE * cores and name == "documents" else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in canonical form, with doc_id beside the content id."""
    rows = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    body = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", body.alias("text"), path.alias("source_path")).withColumn("id", X.content_id(F.col("text"), F.col("source_path")))


#: the CTE that every SQL below starts from
DOCS = (
    "docs AS (SELECT doc_id, lang, text, source_path, substr(sha256(text || chr(0) || source_path), 1, 16) AS id FROM "
    "(SELECT doc_id, lang, coalesce(text, '') AS text, coalesce(source, '') || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS source_path FROM documents))"
)
TOKENS = "regexp_extract_all(lower({0}), '[0-9a-z]+')"
BUCKET = "CAST(('0x' || substr(sha1({0}), 1, 8)) AS BIGINT) % 256"


def doc_identity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "id", "source_path")


def _perturbed():
    """The text with line noise and redactions where doc_id says so."""
    c = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("█████ [gelakt] 5.1.2e 5.1.10 "), "text")).otherwise(F.col("text"))
    return F.when(F.col("doc_id") % 5 == 0, F.regexp_replace(c, " ", "  \r\n\n\n")).otherwise(c)


def normalize_perturbed(spark, sf_dir):
    clean = X.normalize_text(_perturbed())
    return _docs(spark, sf_dir).select("doc_id", F.length(clean).cast("long").alias("n"), F.sha2(clean, 256).alias("digest"))


def redaction_ratio_perturbed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.redaction_ratio(_perturbed()), 4).alias("ratio"))


def _gated(spark, sf_dir) -> DataFrame:
    """Every 7th text is short and redacted, every 11th is blank, every 13th file is corrupt."""
    text = F.when(F.col("doc_id") % 7 == 0, "█████ kort").when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("text"))
    rows = _docs(spark, sf_dir).withColumns({"text": text, "parse_ok": F.col("doc_id") % 13 != 0, "decision": F.lit(S.UNDECIDED)})
    blank = {"decision_reason": F.lit(None).cast("string"), "redaction_note": F.lit(None).cast("string")}
    return validity.validity_gate(validity.with_health(rows.withColumns(blank)))


GATED = (
    f"WITH {DOCS}, h AS (SELECT *, length(t) AS n, length(regexp_replace(t, '\\s', '', 'g')) AS solid, length(t) - length(replace(t, '█', '')) AS hid, doc_id % 13 <> 0 AS ok FROM "
    "(SELECT *, CASE WHEN doc_id % 7 = 0 THEN '█████ kort' WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS t FROM docs)), "
    "g AS (SELECT *, CASE WHEN solid = 0 THEN 0.0 ELSE least(1.0, CAST(hid AS DOUBLE) / solid) END AS ratio FROM h), "
    "gated AS (SELECT doc_id, CASE WHEN NOT ok THEN 'validity:corrupt-pdf' WHEN n < 50 AND ratio < 0.1 THEN 'validity:empty-after-ocr' END AS reason, "
    "CASE WHEN ok AND n < 50 AND ratio >= 0.1 THEN 'gelakt maar behouden' END AS note FROM g) "
)


def validity_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("doc_id", "decision", F.coalesce("decision_reason", F.lit("")).alias("reason"), F.coalesce("redaction_note", F.lit("")).alias("note"))


def validity_counts(spark, sf_dir):
    return validity.decision_counts(_gated(spark, sf_dir))


def excluded_by_reason(spark, sf_dir):
    return validity.excluded_by_reason(_gated(spark, sf_dir))


def tokenize_stats(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def doc_freq_top_terms(spark, sf_dir):
    terms = _docs(spark, sf_dir).select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counted.orderBy(F.desc("df"), "term").limit(50)


def shingle_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.shingles(X.tokens(F.col("text")))).cast("long").alias("n_shingles"))


def chunking(spark, sf_dir):
    rows = ranking.chunk_rows(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"))
    return rows.select("chunk_id", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


def chunk_cap_sample(spark, sf_dir):
    rows = ranking.chunk_rows(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"), cap=6)
    return rows.select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"))


def hashing_embedding_sparse(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(_counts_udf()("text")).alias("bucket", "n")).filter("n > 0")
    return rows.select("doc_id", F.col("bucket").cast("long").alias("bucket"), "n")


def _counts_udf():
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counts(texts):
        return texts.map(lambda t: V.hashed_counts(t or ""))

    return counts


def _retrieved(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return ranking.retrieve(ranking.candidates(docs.withColumn("decision", F.lit(S.UNDECIDED))), QUERY)


RETRIEVED = (
    f"q AS (SELECT b, count(*) AS n FROM (SELECT {BUCKET.format('t')} AS b FROM (SELECT unnest({TOKENS.format(repr(QUERY))}) AS t)) GROUP BY b), "
    "chunked AS (SELECT id, o, substr(text, CAST(o * 1000 + 1 AS BIGINT), 1000) AS chunk FROM (SELECT id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS o FROM docs WHERE text <> '')), "
    f"counted AS (SELECT id, o, b, count(*) AS n FROM (SELECT id, o, {BUCKET.format('t')} AS b FROM (SELECT id, o, unnest({TOKENS.format('chunk')}) AS t FROM chunked)) GROUP BY ALL), "
    "sims AS (SELECT c.id, c.o, coalesce(sum(c.n * q.n), 0) / sqrt(CAST(sum(c.n * c.n) * (SELECT sum(n * n) FROM q) AS DOUBLE)) AS sim FROM counted c LEFT JOIN q USING (b) GROUP BY c.id, c.o), "
    "full_sims AS (SELECT k.id, k.o, k.chunk, coalesce(s.sim, 0.0) AS sim FROM chunked k LEFT JOIN sims s ON s.id = k.id AND s.o = k.o), "
    "best AS (SELECT id, round(max(sim), 6) AS final, first(chunk ORDER BY sim DESC, o) AS best_passage FROM full_sims GROUP BY id)"
)


def retrieve_best_passage(spark, sf_dir):
    return _retrieved(spark, sf_dir).select("id", "final", F.md5("best_passage").alias("passage"))


def first_pass_ranking(spark, sf_dir):
    return select.first_pass(_retrieved(spark, sf_dir), 200).select(F.col("rank").cast("long").alias("rank"), "id", "final")


def bm25_rerank(spark, sf_dir):
    return ranking.bm25(_docs(spark, sf_dir).filter("text <> ''"), QUERY)


BM25 = (
    f"toks AS (SELECT id, {TOKENS.format('text')} AS t FROM docs WHERE text <> ''), terms AS (SELECT DISTINCT unnest({TOKENS.format(repr(QUERY))}) AS w), "
    "tf AS (SELECT id, w, greatest(len(t), 1) AS l, len(list_filter(t, lambda x: x = w)) AS n FROM toks, terms), "
    "st AS (SELECT count(*) AS n, CASE WHEN avg(len(t)) > 0 THEN avg(len(t)) ELSE 1 END AS mean FROM toks), "
    "idf AS (SELECT w, ln(1 + ((SELECT n FROM st) - d + 0.5) / (d + 0.5)) AS idf FROM (SELECT w, CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE) AS d FROM tf GROUP BY w)), "
    "raw AS (SELECT id, sum(idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * l / (SELECT mean FROM st)))) AS raw FROM tf JOIN idf USING (w) GROUP BY id), "
    "bm AS (SELECT id, round(CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0.0 END, 6) AS bm25 FROM raw)"
)


def hybrid_score(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("text <> ''")
    # both parts have 6 decimals, so the mix has 7: no rounding tie is left to the engine
    return ranking.hybrid(_retrieved(spark, sf_dir), ranking.bm25(docs, QUERY), 0.3, digits=7)


def term_overlap_why(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.term_overlap(F.lit(QUERY), F.col("text")), ",").alias("terms"))


def exact_duplicates(spark, sf_dir):
    return duplicates.exact_duplicates(_docs(spark, sf_dir)).select("source", "target")


def duplicate_collapse(spark, sf_dir):
    store, docs = storer(spark), _docs(spark, sf_dir).filter("text <> ''")
    ranked = store(docs.select("id", "source_path").join(_retrieved(spark, sf_dir), "id").withColumns({"decision": F.lit(S.UNDECIDED), "decision_reason": F.lit("")}))
    links = duplicates.exact_duplicates(docs).select("source", "target")
    out = duplicates.collapse(ranked, duplicates.group_roots(ranked.select("id"), links))
    return out.select("id", "decision", "decision_reason")


def minhash_candidates(spark, sf_dir):
    return duplicates.minhash_candidates(_docs(spark, sf_dir).filter("text <> ''").select("id", "text"))


def _edges(spark, sf_dir, store) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir).filter("text <> ''").select("id", "source_path", "text")
    first = store(docs.join(duplicates.exact_duplicates(docs).select(F.col("source").alias("id")), "id", "left_anti"))
    return first, store(duplicates.cosine_edges(first, duplicates.minhash_candidates(first.select("id", "text")), 0.3))


def near_dup_leaders(spark, sf_dir):
    store = storer(spark)
    docs, edges = _edges(spark, sf_dir, store)
    return duplicates.near_duplicates(docs, store, edges=edges.filter("cos >= 0.7")).filter(F.col("kind") == S.DUPLICATE_OF).select("source", "target", "evidence")


def overlap_edges(spark, sf_dir):
    """Overlaps alone, below a bar for duplicates that leaves some."""
    store = storer(spark)
    docs, edges = _edges(spark, sf_dir, store)
    return duplicates.near_duplicates(docs, store, near=0.98, edges=edges.filter("cos >= 0.7")).filter(F.col("kind") == S.OVERLAPS_WITH).select("source", "target", "evidence")


def overlap_low_threshold(spark, sf_dir):
    """A high bar for duplicates and a low one for overlaps, so that the band holds pairs."""
    store = storer(spark)
    docs, edges = _edges(spark, sf_dir, store)
    return duplicates.near_duplicates(docs, store, near=0.995, overlap=0.3, edges=edges).select("source", "kind", "target", "evidence")


def relation_graph_edges(spark, sf_dir):
    """Exact copies and the turns of conversations as one numbered edge table."""
    exact = duplicates.exact_duplicates(_docs(spark, sf_dir)).select("source", F.lit(S.DUPLICATE_OF).alias("kind"), "target", F.lit("").alias("evidence"))
    turns = _turns(spark, sf_dir)
    order = Window.partitionBy("conv_id").orderBy("turn", "id")
    linked = turns.withColumn("target", F.lag("id").over(order)).filter("target is not null")
    linked = linked.select(F.col("id").alias("source"), F.lit(S.THREAD_PARENT).alias("kind"), "target", F.lit("").alias("evidence"))
    return numbered(exact.unionByName(linked))


def _ranked(spark, sf_dir) -> DataFrame:
    return _retrieved(spark, sf_dir).select("id", "final")


def _cut(spark, sf_dir, mode: str, value: float, bias: float = 0.0) -> DataFrame:
    ranked = storer(spark)(_ranked(spark, sf_dir))
    cutoff, _ = select.cutoff_of(ranked, mode, value)
    return select.apply_cutoff(ranked, cutoff, recall_bias=bias).select("id", "final", "decision", F.col("decision_reason").contains("bias").alias("biased"))


def select_top_n(spark, sf_dir):
    return _cut(spark, sf_dir, "top_n", TOP_N)


def select_threshold(spark, sf_dir):
    return _cut(spark, sf_dir, "threshold", THRESHOLD)


def select_target_knee(spark, sf_dir):
    return _cut(spark, sf_dir, "target", TARGET)


def select_recall_bias(spark, sf_dir):
    return _cut(spark, sf_dir, "threshold", THRESHOLD, BIAS)


def decision_counts(spark, sf_dir):
    chosen = _cut(spark, sf_dir, "top_n", TOP_N).withColumn("decision_reason", F.lit(""))
    return validity.decision_counts(chosen)


def selection_recall(spark, sf_dir):
    """How many of the documents labelled good the top-n selection holds."""
    docs = _docs(spark, sf_dir).select("doc_id", "id")
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    chosen = _cut(spark, sf_dir, "top_n", TOP_N).filter(F.col("decision") == S.SELECTED).select("id").withColumn("hit", F.lit(1))
    rows = good.join(docs, "doc_id").join(chosen, "id", "left")
    return rows.agg(F.count("*").alias("relevant"), F.count("hit").alias("found"), F.round(F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 6).alias("recall"))


def score_topk_bounded(spark, sf_dir):
    """The first 250 by (final desc, id) get a score from a deterministic stand-in answer."""
    docs = _docs(spark, sf_dir).filter("text <> ''").select("id", "doc_id").join(_ranked(spark, sf_dir), "id")
    top = ranking.top_by_final(docs, 250)
    answers = top.select("id", F.format_string("SCORE: %d\nMOTIVATIE: document %d", (F.col("doc_id") % 130).cast("int"), F.col("doc_id")).alias("answer"))
    return ranking.parse_answers(answers)


def score_regex_parse(spark, sf_dir):
    """Answers in four forms: JSON, free with both parts, free with a score alone, and neither."""
    k = F.col("doc_id") % 4
    n = (F.col("doc_id") % 140).cast("int")
    answer = (
        F.when(k == 0, F.format_string('{"score": %d, "motivatie": " goed %d "}', n, n))
        .when(k == 1, F.format_string("Score = %d en Motivatie: past bij %d ", n, n))
        .when(k == 2, F.format_string(" de score %d is gegeven", n))
        .otherwise(F.format_string("geen oordeel over %d", n))
    )
    rows = ranking.parse_answers(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), answer.alias("answer")))
    return rows.select(F.col("id").cast("long").alias("doc_id"), "llm_relevance", "rationale")


def _turns(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"))


def _threads(spark, sf_dir, store) -> DataFrame:
    """Turns as mails: each replies to the one before it, by header."""
    turns = _turns(spark, sf_dir)
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn", "id"))
    return store(turns.withColumns({"message_id": F.concat(F.lit("<"), "id", F.lit(">")), "parent": before})).select(
        "id", F.col("id").alias("source_path"), "message_id", F.concat(F.lit("<"), "parent", F.lit(">")).alias("in_reply_to"),
        *[F.lit(None).cast("string").alias(c) for c in ("references", "subject", "date")],
    )


def thread_roots(spark, sf_dir):
    store = storer(spark)
    mails = _threads(spark, sf_dir, store)
    parents = store(threads.header_parents(mails)).select("child", "parent")
    return threads.roots(mails.select("id"), parents, store).select("id", "root", "depth")


def thread_tips(spark, sf_dir):
    store = storer(spark)
    return threads.link_threads(_threads(spark, sf_dir, store), store)[1].select("id", "thread_id", "thread_size", "thread_tip", "thread_tip_id")


def thread_tail_filter(spark, sf_dir):
    store = storer(spark)
    placed = threads.link_threads(_threads(spark, sf_dir, store), store)[1]
    rows = S.conform(placed.withColumn("doc_type", F.lit("email")))
    return scope.scope_filter(rows, rules=(scope.thread_tail,)).select("id", "decision", F.coalesce("decision_reason", F.lit("")).alias("reason"))


def scope_rules_first_match(spark, sf_dir):
    """Subjects, senders and texts that trip the rules in turn, some of them two at once."""
    d = F.col("doc_id")
    subject = F.when(d % 5 == 0, "FW: stukken").when(d % 7 == 0, "Uitnodiging: overleg").when(d % 11 == 0, "Out of office").otherwise("Verslag")
    text = F.when(d % 10 == 0, F.concat(F.lit("zie\n----- Original Message\n"), "text")).when(d % 15 == 0, F.concat(F.lit("BEGIN:VCALENDAR\n"), "text")).otherwise(F.col("text"))
    sender = F.when(d % 6 == 0, "No-Reply@x.example").otherwise("a@x.example")
    rows = _docs(spark, sf_dir).withColumns({"subject": subject, "text": text, "from_": sender, "doc_type": F.when(d % 4 == 3, "other").otherwise("email")})
    return scope.scope_filter(S.conform(rows.withColumn("id", F.col("doc_id").cast("string")))).select(
        F.col("id").cast("long").alias("doc_id"), "decision", F.coalesce("decision_reason", F.lit("")).alias("reason")
    )


def cosine_pairs_band(spark, sf_dir):
    """Embeddings against the centroid of their label: the cosine and the band it falls in."""
    rows = _table(spark, sf_dir, "embeddings")
    mean = _centroids(rows)
    c = F.round(V.cosine(F.col("embedding"), F.col("centre")), 6)
    out = rows.join(F.broadcast(mean), "label").select("vec_id", "label", c.alias("cos"))
    band = F.when(F.col("cos") >= 0.9, "duplicate").when(F.col("cos") >= 0.7, "overlap").otherwise("none")
    return out.withColumn("band", band)


def _centroids(rows: DataFrame) -> DataFrame:
    """label, centre: position-wise means, rounded so that the order of summation does not show. One row for each label."""
    flat = rows.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))


def centroid_medoid(spark, sf_dir):
    """The vector nearest to its label's centroid; ties by id."""
    scored = cosine_pairs_band(spark, sf_dir)
    return scored.groupBy("label").agg(F.max("cos").alias("cos"), F.min_by("vec_id", F.struct((-F.col("cos")).alias("c"), "vec_id")).alias("medoid"))


def cluster_tfidf_labels(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    members = docs.select(F.col("lang").alias("cluster"), "id").filter("cluster is not null")
    return topics.tfidf_labels(members, docs.select("id", "text"))


def _core(spark, sf_dir, store) -> DataFrame:
    ranked = store(_ranked(spark, sf_dir))
    chosen = select.apply_cutoff(ranked, select.top_n_cutoff(ranked, TOP_N)).filter(F.col("decision") == S.SELECTED)
    return store(_docs(spark, sf_dir).join(chosen.select("id"), "id", "left_semi").select("id", "text"))


def _labelled(spark, sf_dir, store) -> DataFrame:
    docs = _core(spark, sf_dir, store)
    clusters = topics.cluster(store(topics.chunk_vectors(docs, cap=6)), topic_distance=0.5, subtopic_distance=0.3)
    return store(topics.label_topics(docs, store(topics.collapse_small(docs, clusters))))


def topic_clusters(spark, sf_dir):
    return _labelled(spark, sf_dir, storer(spark)).select("id", "topic", "subtopic")


def topic_menu(spark, sf_dir):
    return topics.topic_menu(_labelled(spark, sf_dir, storer(spark)))


def ingest_table(spark, sf_dir):
    """The documents table as canonical documents, health included."""
    return files.from_table(_table(spark, sf_dir, "documents")).select("id", "source_path", "doc_type", F.col("char_count").cast("long").alias("char_count"), "redaction_ratio")


def excluded_listing(spark, sf_dir):
    from gleaner.sources import exports

    rows = _gated(spark, sf_dir).withColumn("doc_type", F.lit("other"))
    return exports.excluded_rows(rows).select("id", "name", "reason", "kind", "redaction")


def inventory_rows(spark, sf_dir):
    """The inventory sheet of the threshold selection, with cells that start like formulas."""
    from gleaner.sources import exports

    rows = _docs(spark, sf_dir).select("id", "doc_id").join(_ranked(spark, sf_dir), "id").filter(F.col("final") >= THRESHOLD)
    rows = rows.withColumns({"topic": F.when(F.col("doc_id") % 3 == 0, "=SUM(A1)").otherwise("thema"), "subtopic": F.when(F.col("doc_id") % 2 == 0, "thema").otherwise("deel"), "doc_type": F.lit("other"), "rationale": F.lit("-x"), "decision_reason": F.lit("ok"), "summary": F.lit("@a")})
    return exports.inventory(rows)


QUERIES = {
    f.__name__: f
    for f in (
        doc_identity, ingest_table, normalize_perturbed, redaction_ratio_perturbed, validity_gate, validity_counts, excluded_by_reason, excluded_listing,
        tokenize_stats, doc_freq_top_terms, shingle_counts, chunking, chunk_cap_sample, hashing_embedding_sparse, retrieve_best_passage,
        first_pass_ranking, bm25_rerank, hybrid_score, term_overlap_why, exact_duplicates, duplicate_collapse, minhash_candidates,
        near_dup_leaders, overlap_edges, overlap_low_threshold, relation_graph_edges, select_top_n, select_threshold, select_target_knee,
        select_recall_bias, decision_counts, selection_recall, score_topk_bounded, score_regex_parse, thread_roots, thread_tips,
        thread_tail_filter, scope_rules_first_match, cosine_pairs_band, centroid_medoid, cluster_tfidf_labels, topic_clusters, topic_menu,
        inventory_rows,
    )
}

EXACT = "exact AS (SELECT d.id AS source, m.target, m.digest FROM (SELECT id, source_path, sha256(text) AS digest FROM docs WHERE text <> '') d JOIN (SELECT sha256(text) AS digest, first(id ORDER BY source_path, id) AS target FROM docs WHERE text <> '' GROUP BY 1) m USING (digest) WHERE d.id <> m.target)"
CUT = "SELECT id, final, CASE WHEN final >= cut THEN 'selected' ELSE 'out_of_scope' END AS decision, false AS biased FROM best, c"
KNEE = f"""s AS (SELECT final, row_number() OVER (ORDER BY final DESC) AS rn, count(*) OVER () AS n FROM best),
g AS (SELECT rn, final AS above, final - lead(final) OVER (ORDER BY rn) AS gap, n FROM s),
c AS (SELECT CASE WHEN (SELECT max(n) FROM s) <= {TARGET} THEN (SELECT min(final) FROM s) ELSE (SELECT first(above ORDER BY gap DESC, rn) FROM g WHERE rn BETWEEN greatest(1, {TARGET} - {max(5, TARGET // 4)}) AND least(n - 1, {TARGET + max(5, TARGET // 4)})) END AS cut)"""
TURNS = "t AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id FROM conversations)"
THREADS = f"{TURNS}, p AS (SELECT id, first_value(id) OVER w AS root, row_number() OVER w - 1 AS depth, count(*) OVER (PARTITION BY conv_id) AS size, last_value(id) OVER (PARTITION BY conv_id ORDER BY turn, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tip FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, id))"
CENTRES = "m AS (SELECT label, list(m ORDER BY pos) AS centre FROM (SELECT label, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 9) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label), s AS (SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6) AS cos FROM embeddings e JOIN m ON m.label = e.label)"
PERTURBED = (
    f"WITH {DOCS}, x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(p, ' ', '  ' || chr(13) || chr(10) || chr(10) || chr(10)) ELSE p END AS t FROM "
    "(SELECT *, CASE WHEN doc_id % 7 = 0 THEN '█████ [gelakt] 5.1.2e 5.1.10 ' || text ELSE text END AS p FROM docs))"
)
PERMUTATIONS = ", ".join(f"({i}, {duplicates.permutation(i)[0]}, {duplicates.permutation(i)[1]})" for i in range(duplicates.BANDS * duplicates.ROWS))
MINHASH = f"""perm(i, a, b) AS (VALUES {PERMUTATIONS}), one AS (SELECT min(id) AS id, first(text) AS text FROM docs WHERE text <> '' GROUP BY sha256(text)),
tk AS (SELECT id, {TOKENS.format('text')} AS t FROM one),
sh AS (SELECT DISTINCT id, unnest(CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2]) END) AS g FROM tk),
hx AS (SELECT DISTINCT id, CAST(('0x' || substr(sha1(g), 1, 8)) AS BIGINT) % {duplicates.PRIME} AS x FROM sh),
mh AS (SELECT id, i, min((a * x + b) % {duplicates.PRIME}) AS m FROM hx, perm GROUP BY id, i),
bk AS (SELECT id, i // {duplicates.ROWS} AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS k FROM mh GROUP BY id, i // {duplicates.ROWS})"""



def near_sql(near: float, low: float) -> str:
    """The greedy rule in SQL: nodes in path order, one a step, each a leader unless an earlier adjacent one is."""
    minhash = MINHASH.replace("SELECT min(id) AS id, first(text) AS text FROM docs WHERE text <> '' GROUP BY sha256(text)", "SELECT id, text FROM firsts")
    return f"""WITH RECURSIVE {DOCS}, {EXACT}, firsts AS (SELECT * FROM docs WHERE text <> '' AND id NOT IN (SELECT source FROM exact)), {minhash},
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bk x JOIN bk y ON x.band = y.band AND x.k = y.k AND x.id < y.id),
cnt AS (SELECT id, b, count(*) AS n FROM (SELECT id, {BUCKET.format('t')} AS b FROM (SELECT id, unnest({TOKENS.format('text')}) AS t FROM firsts WHERE id IN (SELECT a FROM cand UNION SELECT b FROM cand))) GROUP BY id, b),
len2 AS (SELECT id, sum(n * n) AS s FROM cnt GROUP BY id),
dots AS (SELECT a, cand.b, sum(x.n * y.n) AS d FROM cand JOIN cnt x ON x.id = a JOIN cnt y ON y.id = cand.b AND y.b = x.b GROUP BY a, cand.b),
cosines AS (SELECT pa.source_path AS p, pb.source_path AS q, round(d / sqrt(CAST(la.s * lb.s AS DOUBLE)), 6) AS cos FROM dots JOIN len2 la ON la.id = a JOIN len2 lb ON lb.id = b JOIN firsts pa ON pa.id = a JOIN firsts pb ON pb.id = b),
rel AS (SELECT least(p, q) AS a, greatest(p, q) AS b, cos FROM cosines WHERE cos >= {low}), close AS (SELECT * FROM rel WHERE cos >= {near}),
o AS (SELECT node, list(a) FILTER (WHERE a IS NOT NULL) AS adj, row_number() OVER (ORDER BY node) AS i FROM (SELECT b AS node, a FROM close UNION SELECT a, NULL FROM close) GROUP BY node),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS l UNION ALL SELECT o.i, CASE WHEN list_has_any(l, coalesce(adj, [])) THEN l ELSE list_append(l, node) END FROM st JOIN o ON o.i = st.i + 1),
chief AS (SELECT unnest(l) AS node FROM st WHERE i = (SELECT max(i) FROM st)),
lead AS (SELECT source_path AS node, CASE WHEN source_path IN (SELECT b FROM close) AND source_path NOT IN (SELECT node FROM chief) THEN (SELECT min(a) FROM close WHERE b = source_path AND a IN (SELECT node FROM chief)) ELSE source_path END AS leader FROM firsts),
made AS (SELECT a, b, cos, 'duplicate-of' AS kind FROM close JOIN lead ON node = b AND leader = a
UNION ALL SELECT a, b, cos, 'overlaps-with' FROM rel JOIN lead x ON x.node = a JOIN lead y ON y.node = b WHERE cos < {near} AND x.leader = a AND (y.leader = b OR y.leader > a)),
named AS (SELECT s.id AS source, kind, t.id AS target, CASE kind WHEN 'duplicate-of' THEN 'near-duplicate' ELSE 'overlap' END || ' cosine=' || printf('%.3f', CAST(round(CAST(cos AS DECIMAL(12, 6)), 3) AS DOUBLE)) AS evidence FROM made JOIN firsts t ON t.source_path = a JOIN firsts s ON s.source_path = b) """


ORACLE_SQL = {
    "near_dup_leaders": near_sql(0.9, 0.7) + "SELECT source, target, evidence FROM named WHERE kind = 'duplicate-of'",
    "overlap_edges": near_sql(0.98, 0.7) + "SELECT source, target, evidence FROM named WHERE kind = 'overlaps-with'",
    "overlap_low_threshold": near_sql(0.995, 0.3) + "SELECT source, kind, target, evidence FROM named",
    "doc_identity": f"WITH {DOCS} SELECT doc_id, id, source_path FROM docs",
    "ingest_table": f"WITH {DOCS} SELECT id, source_path, 'other' AS doc_type, length(text) AS char_count, 0.0::DOUBLE AS redaction_ratio FROM docs",
    "normalize_perturbed": f"{PERTURBED}, n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v\\r]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM x) SELECT doc_id, length(c) AS n, sha256(c) AS digest FROM n",
    "redaction_ratio_perturbed": f"{PERTURBED} SELECT doc_id, round(CASE WHEN length(regexp_replace(t, '\\s', '', 'g')) = 0 THEN 0.0 ELSE least(1.0, CAST(length(t) - length(replace(t, '█', '')) + length(t) - length(replace(t, '[gelakt]', '')) + length(t) - length(regexp_replace(t, '\\b(?:5\\.1\\.(?:1|2e?|5)|10\\.[12]|11\\.1)\\b', '', 'g')) AS DOUBLE) / length(regexp_replace(t, '\\s', '', 'g'))) END, 4) AS ratio FROM x",
    "validity_gate": GATED + "SELECT doc_id, CASE WHEN reason IS NULL THEN 'undecided' ELSE 'out_of_scope' END AS decision, coalesce(reason, '') AS reason, coalesce(note, '') AS note FROM gated",
    "validity_counts": GATED + "SELECT count(*) AS total, 0::BIGINT AS selected, count(reason) AS out_of_scope, count(*) - count(reason) AS undecided, count(reason) AS validity_excluded FROM gated",
    "excluded_by_reason": GATED + "SELECT 'validity' AS kind, reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY reason",
    "excluded_listing": GATED + "SELECT d.id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, reason, 'validity' AS kind, coalesce(note, '') AS redaction FROM gated JOIN docs d USING (doc_id) WHERE reason IS NOT NULL",
    "tokenize_stats": f"WITH {DOCS} SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct FROM docs",
    "doc_freq_top_terms": f"WITH {DOCS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM docs) GROUP BY term ORDER BY df DESC, term LIMIT 50",
    "shingle_counts": f"WITH {DOCS} SELECT doc_id, len(list_distinct(CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2]) END)) AS n_shingles FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM docs)",
    "chunking": f"WITH {DOCS}, c AS (SELECT doc_id, o, substr(text, CAST(o * 1000 + 1 AS BIGINT), 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS o FROM docs WHERE text <> '')) SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(o AS VARCHAR) AS chunk_id, length(chunk) AS n, md5(chunk) AS digest FROM c",
    "chunk_cap_sample": f"WITH {DOCS}, n AS (SELECT doc_id, CAST(ceil(length(text) / 1000.0) AS BIGINT) AS n FROM docs WHERE text <> ''), o AS (SELECT doc_id, CASE WHEN n <= 6 THEN unnest(range(0, n)) ELSE NULL END AS o FROM n WHERE n <= 6 UNION ALL SELECT doc_id, i * n // 6 AS o FROM n, range(0, 6) r(i) WHERE n > 6) SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(o AS VARCHAR) AS chunk_id, o AS ordinal FROM o",
    "hashing_embedding_sparse": f"WITH {DOCS} SELECT doc_id, b AS bucket, count(*) AS n FROM (SELECT doc_id, {BUCKET.format('t')} AS b FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM docs)) GROUP BY doc_id, b",
    "retrieve_best_passage": f"WITH {DOCS}, {RETRIEVED} SELECT id, final, md5(best_passage) AS passage FROM best",
    "first_pass_ranking": f"WITH {DOCS}, {RETRIEVED} SELECT row_number() OVER (ORDER BY final DESC, id) AS rank, id, final FROM best ORDER BY final DESC, id LIMIT 200",
    "bm25_rerank": f"WITH {DOCS}, {BM25} SELECT id, bm25 FROM bm",
    "hybrid_score": f"WITH {DOCS}, {RETRIEVED}, {BM25} SELECT id, round(0.7 * final + 0.3 * bm25, 7) AS final FROM best JOIN bm USING (id)",
    "term_overlap_why": f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter({TOKENS.format(repr(QUERY))}, lambda w: list_contains({TOKENS.format('text')}, w)), ',') AS terms FROM docs",
    "exact_duplicates": f"WITH {DOCS}, {EXACT} SELECT source, target FROM exact",
    "duplicate_collapse": f"WITH {DOCS}, {RETRIEVED}, r AS (SELECT d.id, d.source_path, sha256(d.text) AS g, b.final FROM docs d JOIN best b USING (id)), k AS (SELECT *, first_value(id) OVER w AS keep, first_value(final) OVER w AS top FROM r WINDOW w AS (PARTITION BY g ORDER BY final DESC, source_path)) SELECT id, CASE WHEN id = keep THEN 'undecided' ELSE 'out_of_scope' END AS decision, CASE WHEN id = keep THEN '' ELSE printf('duplicaat van %s (final %.4f)', keep, CAST(round(CAST(top AS DECIMAL(12, 6)), 4) AS DOUBLE)) END AS decision_reason FROM k",
    "minhash_candidates": f"WITH {DOCS}, {MINHASH} SELECT DISTINCT x.id AS a, y.id AS b FROM bk x JOIN bk y ON x.band = y.band AND x.k = y.k AND x.id < y.id",
    "relation_graph_edges": f"WITH {DOCS}, {EXACT}, {TURNS}, e AS (SELECT DISTINCT source, 'duplicate-of' AS kind, target FROM exact UNION ALL SELECT * FROM (SELECT id, 'thread-parent' AS kind, lag(id) OVER (PARTITION BY conv_id ORDER BY turn, id) AS target FROM t) WHERE target IS NOT NULL) SELECT source, kind, target, '' AS evidence, row_number() OVER (PARTITION BY source ORDER BY kind, target) AS seq FROM e",
    "select_top_n": f"WITH {DOCS}, {RETRIEVED}, c AS (SELECT min(final) AS cut FROM (SELECT final FROM best ORDER BY final DESC LIMIT {TOP_N})) {CUT}",
    "select_threshold": f"WITH {DOCS}, {RETRIEVED}, c AS (SELECT {THRESHOLD}::DOUBLE AS cut) {CUT}",
    "select_target_knee": f"WITH {DOCS}, {RETRIEVED}, {KNEE} {CUT}",
    "select_recall_bias": f"WITH {DOCS}, {RETRIEVED} SELECT id, final, CASE WHEN final >= {THRESHOLD} - {BIAS} THEN 'selected' ELSE 'out_of_scope' END AS decision, final < {THRESHOLD} AND final >= {THRESHOLD} - {BIAS} AS biased FROM best",
    "decision_counts": f"WITH {DOCS}, {RETRIEVED}, c AS (SELECT min(final) AS cut FROM (SELECT final FROM best ORDER BY final DESC LIMIT {TOP_N})) SELECT count(*) AS total, count(*) FILTER (WHERE final >= cut) AS selected, count(*) FILTER (WHERE final < cut) AS out_of_scope, 0::BIGINT AS undecided, 0::BIGINT AS validity_excluded FROM best, c",
    "selection_recall": f"WITH {DOCS}, {RETRIEVED}, c AS (SELECT min(final) AS cut FROM (SELECT final FROM best ORDER BY final DESC LIMIT {TOP_N})), r AS (SELECT CASE WHEN b.final >= cut THEN 1 END AS hit FROM labels l JOIN docs d USING (doc_id) LEFT JOIN best b ON b.id = d.id, c WHERE quality = 1) SELECT count(*) AS relevant, count(hit) AS found, round(count(hit) / greatest(count(*), 1)::DOUBLE, 6) AS recall FROM r",
    "score_topk_bounded": f"WITH {DOCS}, {RETRIEVED}, k AS (SELECT id, doc_id FROM best JOIN docs USING (id) ORDER BY final DESC, id LIMIT 250) SELECT id, round(least(100, doc_id % 130) / 100.0, 6)::DOUBLE AS llm_relevance, 'document ' || CAST(doc_id AS VARCHAR) AS rationale FROM k",
    "score_regex_parse": "WITH x AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 140 AS n FROM documents) SELECT doc_id, CASE WHEN k = 3 THEN 0.0 ELSE least(100, n) / 100.0 END::DOUBLE AS llm_relevance, CASE k WHEN 0 THEN 'goed ' || n WHEN 1 THEN 'past bij ' || n WHEN 2 THEN 'de score ' || n || ' is gegeven' ELSE 'geen oordeel over ' || n END AS rationale FROM x",
    "thread_roots": f"WITH {THREADS} SELECT id, root, depth FROM p",
    "thread_tips": f"WITH {THREADS} SELECT id, root AS thread_id, size AS thread_size, id = tip AS thread_tip, tip AS thread_tip_id FROM p",
    "thread_tail_filter": f"WITH {THREADS} SELECT id, CASE WHEN size > 1 AND id <> tip THEN 'out_of_scope' ELSE 'undecided' END AS decision, CASE WHEN size > 1 AND id <> tip THEN printf('{scope.TAIL}', tip) ELSE '' END AS reason FROM p",
    "scope_rules_first_match": f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 10 = 0 THEN '{scope.FORWARDED}' WHEN doc_id % 15 = 0 OR (doc_id % 5 <> 0 AND doc_id % 7 = 0) THEN '{scope.INVITE}' WHEN doc_id % 6 = 0 OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0) THEN '{scope.PROCESS}' END AS reason FROM documents) SELECT doc_id, CASE WHEN reason IS NULL THEN 'undecided' ELSE 'out_of_scope' END AS decision, coalesce(reason, '') AS reason FROM r",
    "cosine_pairs_band": f"WITH {CENTRES} SELECT vec_id, label, cos, CASE WHEN cos >= 0.9 THEN 'duplicate' WHEN cos >= 0.7 THEN 'overlap' ELSE 'none' END AS band FROM s",
    "centroid_medoid": f"WITH {CENTRES} SELECT label, max(cos) AS cos, first(vec_id ORDER BY cos DESC, vec_id) AS medoid FROM s GROUP BY label",
    "cluster_tfidf_labels": f"WITH {DOCS}, t AS (SELECT id, lang, unnest(list_distinct({TOKENS.format('text')})) AS term FROM docs), df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT lang, count(*) AS size FROM docs WHERE lang IS NOT NULL GROUP BY lang), s AS (SELECT t.lang, term, round(count(*) / CAST(any_value(size) AS DOUBLE) * ln(CAST((SELECT count(*) FROM docs) AS DOUBLE) / (1 + any_value(df))), 9) AS s FROM t JOIN df USING (term) JOIN n USING (lang) WHERE length(term) >= 3 GROUP BY t.lang, term), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, term) AS rn FROM s) SELECT lang AS cluster, string_agg(term, ', ' ORDER BY rn) AS label FROM r WHERE rn <= 3 GROUP BY lang",
    "inventory_rows": f"WITH {DOCS}, {RETRIEVED}, x AS (SELECT id, final, CASE WHEN doc_id % 3 = 0 THEN '=SUM(A1)' ELSE 'thema' END AS topic, CASE WHEN doc_id % 2 = 0 THEN 'thema' ELSE 'deel' END AS sub FROM docs JOIN best USING (id) WHERE final >= {THRESHOLD}) SELECT id, final AS score, CASE WHEN topic LIKE '=%' THEN '''' ELSE '' END || CASE WHEN sub = topic THEN topic ELSE topic || ' / ' || sub END AS category, 'other' AS doc_type, '''@a' AS summary, 'ok' AS reason, '''-x' AS motivatie FROM x",
}
