"""converge: a query narrows documents to a core. discover: a topic map without a query."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import providers as P
from gleaner import schema as S
from gleaner.operators import criteria as criteria_op
from gleaner.operators import duplicates, ranking, scope, select, summarise, topics, validity
from gleaner.plans.relate import relate, relation_totals
from gleaner.plans.runtime import Audit, storer
from gleaner.sources import exports, files


@dataclass(frozen=True)
class Settings:
    near_dup: float = 0.9
    overlap: float = 0.7
    min_chars: int = 50
    redaction_share: float = 0.10
    recall_bias: float = 0.0
    alpha: float = 0.0
    score_top_k: int = 0  # 0: all; the command line takes 250
    summary_words: int = 100
    chunk_size: int = 1000
    topic_distance: float = 0.8
    subtopic_distance: float = 0.5
    min_cluster_size: int = 3
    chunk_cap: int = 40


DISCOVER = Settings(topic_distance=0.50, subtopic_distance=0.42, min_cluster_size=5, chunk_cap=6)


@dataclass
class Result:
    documents: DataFrame
    relations: DataFrame
    audit: DataFrame
    menu: dict[str, Any]
    manifest: dict[str, Any]

    @property
    def selected(self) -> DataFrame:
        return self.documents.filter(F.col("decision") == S.SELECTED)

    def counts(self) -> dict[str, int]:
        return validity.decision_counts(self.documents).first().asDict()


def ingest(spark: SparkSession, folder: str, audit: Audit, store, loaders=files.LOADERS) -> DataFrame:
    raw = store(files.load(files.read_files(spark, folder), loaders))
    docs = store(files.to_documents(raw))
    bad = raw.filter("status != 'loaded'").select(F.col("path").alias("id"), "status", "error")
    audit.events(bad, "ingest", F.col("status"), inputs=F.struct("error"))
    audit.events(docs, "ingest", "loaded", inputs=F.struct("source_path", "doc_type"))
    audit.events(docs.filter("doc_type = 'pdf_scanned'"), "ingest", "ocr-out-of-scope")
    audit.event("ingest", "ingest-complete", inputs={"documents": docs.count()})
    return docs


def _gate(docs: DataFrame, settings: Settings, providers: P.Providers, audit: Audit, store) -> DataFrame:
    out = store(validity.validity_gate(docs, min_chars=settings.min_chars, redaction_share=settings.redaction_share))
    audit.events(out.filter(F.col("decision") == S.OUT_OF_SCOPE), "validity", "excluded", inputs=F.struct("decision_reason"))
    audit.events(out.filter("redaction_note is not null"), "validity", "redaction-kept", inputs=F.struct("redaction_ratio"))
    if providers.detect_language:
        audit.events(store(validity.language_signal(out, providers.detect_language)), "validity", "language", inputs=F.struct("language"))
    audit.event("validity", "validity-complete", inputs=validity.decision_counts(out).first().asDict())
    return out


def _relate(docs: DataFrame, settings: Settings, providers: P.Providers, counters: P.Counters, audit: Audit, store) -> tuple[DataFrame, DataFrame]:
    if docs.filter("text != ''").limit(2).count() < 2:
        audit.event("relate", "near-dup-skipped", inputs={"reason": "fewer than two texts"})
    docs, relations = relate(docs, store, near=settings.near_dup, overlap=settings.overlap, embed=P.embedding_column(providers.embed, counters))
    rows = relations.withColumnRenamed("source", "id")
    action = F.when(F.col("kind") == S.THREAD_PARENT, "thread-link").when(F.col("kind") == S.DUPLICATE_OF, "duplicate").when(F.col("kind") == S.OVERLAPS_WITH, "overlap")
    audit.events(rows.filter(F.col("kind") != S.ATTACHMENT_OF), "relate", action, inputs=F.struct("target", "evidence"), provider=providers.embed)
    audit.event("relate", "relate-complete", inputs=relation_totals(relations).first().asDict())
    return store(docs), relations


def _topics(core: DataFrame, settings: Settings, providers: P.Providers, counters: P.Counters, audit: Audit, store):
    """(labelled rows, menu frame): vectors of the core's chunks, clusters, labels."""
    rows = core.select("id", "text")
    if isinstance(providers.embed, P.HashingEmbed):
        vectors = topics.chunk_vectors(rows, cap=settings.chunk_cap, size=settings.chunk_size)
    else:
        embed = P.embedding_column(providers.embed, counters)
        made = ranking.chunk_rows(rows, size=settings.chunk_size, cap=settings.chunk_cap)
        vectors = store(made.select("id", "ordinal", embed("chunk").alias("v"))).filter(topics.V.usable(F.col("v")))
    vectors = store(vectors)
    audit.event("embed", "embed-corpus", inputs={"chunks": vectors.count()}, model=getattr(providers.embed, "name", "?"), location=getattr(providers.embed, "location", "?"))
    clusters = topics.cluster(vectors, topic_distance=settings.topic_distance, subtopic_distance=settings.subtopic_distance, store=store)
    placed = store(topics.collapse_small(rows, clusters, settings.min_cluster_size))
    labels = topics.tfidf_labels if providers.no_llm else lambda m, d: topics.model_labels(m, d, providers.llm, store, log=lambda a: audit.events(a.withColumnRenamed("cluster", "id"), "topics", "label", inputs=F.struct("label"), provider=providers.llm, prompt="prompt"))
    labelled = store(topics.label_topics(rows, placed, lambda m, d: labels(m.select("cluster", "id", "closeness") if not providers.no_llm else m.select("cluster", "id"), d)))
    rest = labelled.filter("topic_no is null")
    audit.events(rest, "topics", "overig-collapse")
    audit.event("topics", "topics-complete", inputs={"onderwerpen": labelled.select("topic_no").distinct().count(), "overig": rest.count()})
    return labelled, topics.topic_menu(labelled)


def converge(
    spark: SparkSession, docs: str | DataFrame, query: str, *, mode: str = "target", value: float = 100, settings: Settings | None = None,
    providers: P.Providers | None = None, out: str | None = None, loaders=files.LOADERS,
) -> Result:
    """docs: a folder of files, or canonical documents. No document is dropped: all come back with a decision and a reason."""
    settings, providers = settings or Settings(), providers or P.Providers()
    store, audit, counters = storer(spark), Audit(spark), P.Counters(spark)
    ts = datetime.now(UTC).isoformat()
    audit.event("cli", "run-start", inputs={"query": query, "mode": mode, "value": value, "no_llm": providers.no_llm, **settings.__dict__})
    llm = {"provider": providers.llm, "prompt": "prompt"}
    with audit.stage("criteria"):
        criteria = criteria_op.articulate(query, None if providers.no_llm else providers.llm)
        audit.event("criteria", "articulate" if criteria.source == "llm" else "fallback", inputs=criteria.to_dict())
    with audit.stage("ingest"):
        table = ingest(spark, docs, audit, store, loaders) if isinstance(docs, str) else store(S.conform(docs))
    with audit.stage("validity"):
        table = _gate(table, settings, providers, audit, store)
    with audit.stage("relate"):
        table, relations = _relate(table, settings, providers, counters, audit, store)
    with audit.stage("scope-filter"):
        before = table
        table = store(scope.scope_filter(table))
        hit = table.join(before.filter(F.col("decision") != S.OUT_OF_SCOPE).select("id"), "id", "left_semi").filter(F.col("decision") == S.OUT_OF_SCOPE)
        audit.events(hit, "scope-filter", "excluded", inputs=F.struct("decision_reason"))
        if providers.no_llm or not providers.scope_filter_llm:
            audit.event("scope-filter", "llm-skipped")
        else:
            table = store(scope.model_gate(table, query, providers.llm, store, log=lambda a: audit.events(a, "scope-filter", "llm-decision", inputs=F.struct("verdict"), **llm)))
        audit.event("scope-filter", "scope-complete", inputs=validity.decision_counts(table).first().asDict())
    with audit.stage("retrieve"):
        pool = store(ranking.candidates(table).drop("final", "embed_sim", "best_passage"))
        found = ranking.retrieve(pool, query, size=settings.chunk_size, similarity=P.similarity_column(providers.embed, query, counters))
        ranked = pool.join(found.withColumn("embed_sim", F.col("final")), "id")
        if settings.alpha > 0:
            mixed = ranking.hybrid(found, ranking.bm25(pool, query), settings.alpha)
            ranked = ranked.drop("final").join(mixed, "id")
        ranked = store(ranked)
        audit.event("retrieve", "embed", inputs={"query": query, "chunk_size": settings.chunk_size}, model=getattr(providers.embed, "name", "?"), location=getattr(providers.embed, "location", "?"))
        audit.ranked(ranked, "retrieve", "first-pass", "final", inputs={"query": query, "alpha": settings.alpha, "method": "max-cosine-best-passage"}, provider=providers.embed)
    with audit.stage("rerank"):
        local = isinstance(providers.reranker, P.LexicalReranker) and providers.reranker == P.LexicalReranker()
        ranked = store(ranking.rerank(ranked, query, None if local else providers.reranker))
        audit.ranked(ranked, "rerank", "rerank", "rerank", inputs={"query": query}, provider=providers.reranker)
    with audit.stage("score"):
        if providers.no_llm:
            audit.event("score", "skipped")
        else:
            scored = ranking.model_score(ranked, criteria.block(), providers.llm, store, top_k=settings.score_top_k, log=lambda a: audit.events(a, "score", "llm-score", inputs=F.struct("answer"), **llm))
            ranked = store(ranked.drop("llm_relevance", "rationale").join(scored, "id", "left"))
            audit.event("score", "score-complete")
    with audit.stage("select"):
        links = relations.filter(F.col("kind") == S.DUPLICATE_OF).select("source", "target")
        collapsed = store(duplicates.collapse(ranked, duplicates.group_roots(ranked.select("id"), links)))
        lost = collapsed.filter(F.col("decision") == S.OUT_OF_SCOPE)
        audit.events(lost, "select", "excluded", inputs=F.struct("decision_reason"))
        left = collapsed.filter(F.col("decision") != S.OUT_OF_SCOPE)
        cutoff, knee = select.cutoff_of(left, mode, value)
        chosen = select.apply_cutoff(left, cutoff, recall_bias=settings.recall_bias, mode=mode)
        chosen = store(chosen.select(*collapsed.columns).unionByName(lost))
        audit.event("select", "select", inputs={"mode": mode, "value": value, "cutoff": None if cutoff == float("inf") else cutoff, "knee": knee and knee.__dict__})
    core = chosen.filter(F.col("decision") == S.SELECTED)
    with audit.stage("topics"):
        labelled, menu = _topics(core, settings, providers, counters, audit, store)
        named = labelled.select("id", "topic", "subtopic")
        chosen = store(chosen.drop("topic", "subtopic").join(named, "id", "left"))
        core = chosen.filter(F.col("decision") == S.SELECTED)
    with audit.stage("summarise"):
        if providers.no_llm:
            audit.event("summarise", "skipped")
        else:
            chosen = store(chosen.drop("summary").join(summarise.summarise(core, providers.llm, store, max_words=settings.summary_words, log=lambda a: audit.events(a, "summarise", "summary", **llm)), "id", "left"))
            audit.event("summarise", "summarise-complete")
    counters.report(audit, providers.embed)
    rest = table.join(chosen.select("id"), "id", "left_anti")
    final = store(S.conform(chosen).unionByName(S.conform(rest)))
    source = "fallback" if providers.no_llm else "llm"
    result = Result(final, relations, audit.table(), exports.menu_payload(menu, source), {})
    result.manifest = exports.manifest("run", ts=ts, providers=providers, params=settings.__dict__, counts=result.counts(), timings=audit.timings, query=query, criteria=criteria, cutoff={"mode": mode, "value": value})
    if out:
        _write_converge(result, criteria, query, ts, providers, out)
        audit.event("export", "artifacts-written", inputs={"out": out})
        result.audit = audit.table()
        exports.write_json_lines(result.audit.orderBy("seq", "document_ids").drop("seq"), f"{out}/audit.jsonl")
    return result


def _write_converge(result: Result, criteria, query: str, ts: str, providers: P.Providers, out: str) -> None:
    os.makedirs(out, exist_ok=True)
    table = exports.inventory(result.selected, include_summary=not providers.no_llm)
    exports.write_xlsx(table.columns, [tuple(r) for r in table.toLocalIterator()], f"{out}/inventory.xlsx")
    n = result.documents.count()
    exports.write_json(exports.relations_payload(result.relations, n), f"{out}/relations.json")
    exports.write_json(criteria.to_dict(), f"{out}/criteria.json")
    exports.write_json(result.menu, f"{out}/topics.json")
    excluded = exports.excluded_payload(result.documents)
    exports.write_json(excluded, f"{out}/excluded.json")
    docs = {r.id: r.asDict(recursive=True) for r in exports.report_documents(result.selected, result.relations, query).toLocalIterator()}
    data = {"query": query, "generated_at": ts, "counts": result.counts(), "topics": result.menu, "documents": docs, "excluded": excluded["excluded"]}
    exports.write_report(data, f"{out}/report.html", query)
    exports.write_json(result.manifest, f"{out}/run-manifest.json")


def discover(spark: SparkSession, docs: str | DataFrame, *, settings: Settings = DISCOVER, providers: P.Providers | None = None, out: str | None = None, loaders=files.LOADERS) -> Result:
    """A topic map of all valid documents; thread messages and duplicates stay in."""
    providers = providers or P.Providers()
    store, audit, counters = storer(spark), Audit(spark), P.Counters(spark)
    ts = datetime.now(UTC).isoformat()
    audit.event("cli", "discover-start", inputs=dict(settings.__dict__))
    with audit.stage("ingest"):
        table = ingest(spark, docs, audit, store, loaders) if isinstance(docs, str) else store(S.conform(docs))
    with audit.stage("validity"):
        table = _gate(table, settings, providers, audit, store)
    with audit.stage("relate"):
        table, relations = _relate(table, settings, providers, counters, audit, store)
    core = ranking.candidates(table)
    with audit.stage("topics"):
        labelled, menu = _topics(core, settings, providers, counters, audit, store)
        table = store(table.drop("topic", "subtopic").join(labelled.select("id", "topic", "subtopic"), "id", "left"))
    summaries: dict = {}
    with audit.stage("summarise"):
        if providers.no_llm:
            audit.event("summarise", "skipped")
        else:
            members = labelled.select(F.concat_ws("\0", "topic", "subtopic").alias("cluster"), "id", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))
            made = summarise.summarise_clusters(members, core, providers.llm, store, max_words=settings.summary_words, log=lambda a: audit.events(a.withColumnRenamed("cluster", "id"), "summarise", "cluster-summary", provider=providers.llm, prompt="prompt"))
            summaries = {tuple(r.cluster.split("\0")): r.summary for r in made.collect()}  # one row for each subtopic
    counters.report(audit, providers.embed)
    payload = exports.menu_payload(menu, "fallback" if providers.no_llm else "llm", summaries)
    result = Result(S.conform(table), relations, audit.table(), payload, {})
    result.manifest = exports.manifest("discover", ts=ts, providers=providers, params=settings.__dict__, counts=result.counts(), timings=audit.timings)
    if out:
        os.makedirs(out, exist_ok=True)
        names = {r.id: {"name": r.name} for r in core.select("id", exports.X.doc_name(F.col("source_path")).alias("name")).toLocalIterator()}
        data = payload | {"counts": result.counts(), "documents": names}
        exports.write_json(data, f"{out}/discover-map.json")
        exports.write_report(data, f"{out}/report.html", "Onderwerpen")
        exports.write_json(exports.relations_payload(relations, table.count()), f"{out}/relations.json")
        exports.write_json(exports.excluded_payload(table), f"{out}/excluded.json")
        exports.write_json(result.manifest, f"{out}/run-manifest.json")
        exports.write_json_lines(audit.table().orderBy("seq", "document_ids").drop("seq"), f"{out}/audit.jsonl")
    return result
