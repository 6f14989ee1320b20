import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner import providers as P
from gleaner.__main__ import cutoff, main, providers_of
from gleaner.plans import converge as plan
from gleaner.plans.observe import panels, reason_histogram
from tests.corpus_files import build

QUERY = "begroting subsidie cultuur 2026"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(build(tmp_path_factory.mktemp("corpus") / "files"))


@pytest.fixture(scope="module")
def run(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    return plan.converge(spark, folder, QUERY, out=out), out


def test_converge_decides_about_every_document(run):
    result, _ = run
    docs = {r.source_path.rsplit("/", 1)[-1]: r for r in result.documents.collect()}
    assert len(docs) == 16 and len({r.id for r in docs.values()}) == 16
    assert {r.decision for r in docs.values()} <= {"selected", "out_of_scope"}
    assert docs["thread-5.eml"].decision == "selected" and docs["thread-5.eml"].thread_tip and docs["thread-5.eml"].thread_size == 5
    assert all(docs[f"thread-{i}.eml"].decision_reason == f"eerdere mail, vertegenwoordigd door thread-head {docs['thread-5.eml'].id} (regel: thread-tail)" for i in range(1, 5))
    assert len({docs[f"thread-{i}.eml"].thread_id for i in range(1, 6)}) == 1
    assert "process-notification" in docs["notice.eml"].decision_reason and "calendar-invite" in docs["invite.eml"].decision_reason
    assert docs["broken.pdf"].decision_reason == "validity:corrupt-pdf" and docs["scan.pdf"].doc_type == "pdf_scanned"
    assert docs["memo.pdf"].doc_type == "pdf_digital" and "begroting" in docs["memo.pdf"].text and docs["memo.pdf"].decision == "selected"
    assert docs["with-attachment.eml#att:begroting.txt"].attachment_of == docs["with-attachment.eml"].id
    kinds = sorted(x for x in ("dup-a.eml", "dup-b.eml") if docs[x].decision == "selected")
    assert kinds == ["dup-a.eml"] and "duplicaat van" in docs["dup-b.eml"].decision_reason
    assert sum(docs[x].decision == "selected" for x in ("near-a.eml", "near-b.eml")) == 1
    edges = {(r.kind, r.source): r for r in result.relations.collect()}
    assert ("attachment-of", docs["with-attachment.eml#att:begroting.txt"].id) in edges
    assert edges["duplicate-of", docs["near-b.eml"].id].evidence.startswith("near-duplicate cosine=")
    assert edges["duplicate-of", docs["dup-b.eml"].id].evidence.startswith("identieke inhoud (sha256:")


def test_artifacts(run):
    result, out = run
    assert set(os.listdir(out)) == {"inventory.xlsx", "relations.json", "criteria.json", "topics.json", "excluded.json", "report.html", "run-manifest.json", "audit.jsonl"}
    counts = result.counts()
    excluded = json.load(open(f"{out}/excluded.json"))
    assert excluded["count"] == counts["out_of_scope"] and excluded["validity"] == counts["validity_excluded"] == 2
    manifest = json.load(open(f"{out}/run-manifest.json"))
    assert manifest["cutoff"] == {"mode": "target", "value": 100} and manifest["counts"] == counts and not manifest["providers"]["llm"]["enabled"]
    events = [json.loads(x) for x in open(f"{out}/audit.jsonl")]
    assert {"run-start", "unsupported", "ingest-complete", "thread-link", "duplicate", "excluded", "select", "timing", "skipped"} <= {e["action"] for e in events}
    assert "prompt" not in events[0]
    menu = json.load(open(f"{out}/topics.json"))
    assert sorted(i for t in menu["onderwerpen"] for s in t["deelonderwerpen"] for i in s["doc_ids"]) == sorted(r.id for r in result.selected.collect())
    sheet = zipfile.ZipFile(f"{out}/inventory.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "motivatie" in sheet and ">summary<" not in sheet
    html = open(f"{out}/report.html").read()
    assert "textContent" in html and "innerHTML" not in html
    assert "ingest" in panels(result.audit) and reason_histogram(result.documents).count() == 4


def test_model_stages_are_side_scores(spark, folder, run):
    def answer(prompt):
        if prompt.startswith("Zoekvraag") and "criteria" in prompt:
            return "- geld: bedragen\n2. cultuur: kunst\nzonder"
        if "UITSLUITEN" in prompt:
            return "UITSLUITEN" if "vergadering" in prompt else "behouden"
        if "SCORE" in prompt:
            return "Score: 250. Motivatie: past goed" if "museum" in prompt else "geen idee"
        return "Een label\nmeer"

    providers = P.Providers(llm=P.ScriptedModel(answer), no_llm=False, scope_filter_llm=True)
    result = plan.converge(spark, folder, QUERY, providers=providers, settings=plan.Settings(summary_words=1))
    docs = {r.source_path.rsplit("/", 1)[-1]: r for r in result.documents.collect()}
    base = {r.id: r.final for r in run[0].documents.collect()}
    assert all(r.final == base[r.id] for r in docs.values() if r.final is not None and base[r.id] is not None)
    assert docs["thread-5.eml"].llm_relevance == 1.0 and docs["thread-5.eml"].rationale == "past goed"
    assert docs["memo.pdf"].llm_relevance == 0.0 and docs["memo.pdf"].summary == "Een"
    assert "LLM-oordeel" in docs["dup-a.eml"].decision_reason
    assert result.manifest["criteria"] == {"source": "llm", "labels": ["geld", "cultuur"]}
    events = [r.asDict() for r in result.audit.collect()]
    for action, ids in (("llm-decision", 1), ("llm-score", 1), ("label", 1), ("summary", 1)):
        found = [e for e in events if e["action"] == action]
        assert found and all(len(e["document_ids"]) == ids and e["model"] == "scripted" and e["prompt"] for e in found), action


class Spy:
    """A provider that leaves a file for each call; its scores turn the order of ids around."""

    name, location = "spy", "test"

    def __init__(self, folder):
        self.folder, self.counters = str(folder), {"calls": 0, "retries": 0, "truncated": 0, "failed": 0}

    def note(self, what):
        os.close(os.open(f"{self.folder}/{what}-{os.getpid()}-{time.time_ns()}", os.O_CREAT))

    def embed(self, texts):
        self.note("embed")
        self.counters["calls"] += 1
        return [[1.0, float("museum" in t), float(len(t) % 2)] for t in texts]

    def rerank(self, query, texts):
        self.note("rerank")
        return [0.25 + i for i in range(len(texts))]


def test_given_providers_are_called_and_named(spark, folder, tmp_path):
    spy = Spy(tmp_path)
    result = plan.converge(spark, folder, QUERY, providers=P.Providers(embed=spy, reranker=spy, detect_language=lambda t: "nl" if "de" in t else None))
    calls = [x.split("-")[0] for x in os.listdir(tmp_path)]
    assert calls.count("rerank") == 1 and calls.count("embed") > 2
    docs = [r for r in result.documents.collect() if r.rerank is not None]
    assert sorted(r.rerank for r in docs) == [0.25 + i for i in range(len(docs))] and [r.rerank for r in sorted(docs, key=lambda r: r.id)] == sorted(r.rerank for r in docs)
    events = [r.asDict() for r in result.audit.collect()]
    (event,) = [e for e in events if e["action"] == "rerank"]
    assert event["model"] == "spy" and event["document_ids"] == [r.id for r in sorted(docs, key=lambda r: -r.rerank)]
    (first,) = [e for e in events if e["action"] == "first-pass"]
    assert len(first["document_ids"]) == len(docs) and first["model"] == "spy"
    assert [json.loads(e["inputs"])["language"] for e in events if e["action"] == "language"]
    (transport,) = [e for e in events if e["action"] == "transport"]
    assert json.loads(transport["inputs"])["calls"] >= calls.count("embed") - 2
    near = [r for r in result.relations.collect() if "cosine" in r.evidence]
    assert near and all(r.evidence.endswith(("1.000", "0.707", "0.816", "0.577", "0.500")) for r in near), "cosines are those of the given vectors"
    assert result.manifest["providers"]["reranker"]["name"] == "spy"


def test_a_reranker_takes_a_bounded_set(spark):
    from gleaner.operators import ranking

    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    with pytest.raises(ValueError):
        ranking.rerank(docs, "x", Spy("/tmp"), most=1)


def test_discover(spark, folder, tmp_path):
    result = plan.discover(spark, folder, out=str(tmp_path))
    assert set(os.listdir(tmp_path)) == {"discover-map.json", "report.html", "relations.json", "excluded.json", "run-manifest.json", "audit.jsonl"}
    ids = [i for t in result.menu["onderwerpen"] for s in t["deelonderwerpen"] for i in s["doc_ids"]]
    assert len(ids) == len(set(ids)) == result.documents.filter(F.col("decision") != "out_of_scope").count()


def test_command_line(capsys):
    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
    parse = lambda **k: cutoff(type("A", (), {"top_n": None, "threshold": None, "target": None} | k))
    assert parse() == ("target", 100) and parse(top_n=5) == ("top_n", 5)
    with pytest.raises(SystemExit):
        parse(top_n=5, threshold=0.5)
    args = lambda **k: type("A", (), {"providers": None, "profile": "local", "no_llm": False} | k)
    assert providers_of(args()).no_llm
    given = providers_of(args(providers="tests.corpus_files:scripted_providers"))
    assert not given.no_llm and given.llm.name == "scripted" and providers_of(args(providers="tests.corpus_files:scripted_providers", no_llm=True)).no_llm


def test_streaming_ingest(spark, folder, tmp_path):
    from gleaner.streaming.ingest import watch

    for _ in range(2):
        q = watch(spark, folder, str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 16
    assert spark.read.parquet(str(tmp_path / "out/failures")).count() == 1
