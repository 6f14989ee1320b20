"""Operators against hand-made cases and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner import providers as P
from gleaner import schema as S
from gleaner.functions import text as X
from gleaner.functions import vectors as V
from gleaner.operators import criteria, duplicates, ranking, scope, select, threads, topics, validity
from gleaner.plans.runtime import storer
from gleaner.sources import exports, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, X.content_id(F.col("t"), F.col("p")), t="hallo wereld", p="/docs/a.eml") == "adc2593a9b367eb3"
    c = F.col("t")
    assert one(spark, X.normalize_text(c), t="  a \r\nb\t\r\r\n\n\n\nc   ") == "a\nb\n\nc"
    assert one(spark, X.redaction_ratio(c), t="5.1.10 5.1.2a") == 0.0
    assert one(spark, X.redaction_ratio(c), t=" ") == 0.0
    assert one(spark, X.redaction_ratio(c), t="██ [gelakt] 5.1.2e") == 1.0
    assert one(spark, X.tokens(c), t="Café 12b-x") == ["caf", "12b", "x"]
    assert one(spark, X.term_overlap(F.lit("b a b z"), c), t="A b c") == ["b", "a"]
    assert one(spark, X.norm_subject(c), t=" Re: FW:  Antw: Plan ") == "plan"
    assert one(spark, X.truncate_words(c, 2), t=" a  b c") == "a b" and one(spark, X.truncate_words(c, 3), t=" a  b c") == " a  b c"
    assert one(spark, X.is_exclude_verdict(c), t=" Uitsluiten.") is True
    assert one(spark, X.formula_safe(c), t="=1") == "'=1" and one(spark, X.formula_safe(c), t="1=") == "1="
    assert one(spark, X.chunks(c, 2), t="abcde") == ["ab", "cd", "e"] and one(spark, X.chunks(c, 2), t="") == []
    assert one(spark, X.even_sample(X.chunks(c, 1), 3), t="abcdefg") == ["a", "c", "e"]
    assert one(spark, X.shingles(X.tokens(c)), t="a b c a b c") == ["a b c", "b c a", "c a b"] and one(spark, X.shingles(X.tokens(c)), t="a a") == ["a"]
    assert one(spark, X.doc_type_of(c), t="x.PDF") == "pdf_digital" and one(spark, X.doc_type_of(c), t="x.docx") == "office" and one(spark, X.doc_type_of(c), t="x") == "other"
    assert one(spark, X.category(F.lit("a"), c), t="b") == "a / b" and one(spark, X.category(F.lit("a"), c), t="a") == "a"


@pytest.mark.parametrize("answer,want", [
    ("SCORE: 80\nMOTIVATIE: past", (0.8, "past")), ("score 400", (1.0, "score 400")), ("niets", (0.0, "niets")), ("", (0.0, "geen score uit LLM-antwoord")),
    ('{"score": 70, "motivatie": " ja "}', (0.7, "ja")), ('{"score": "x", "motivatie": "a"}', (0.0, '{"score": "x", "motivatie": "a"}')), ('{"score": 130, "motivatie": ""}', (1.0, "geen motivatie uit LLM-antwoord")),
])
def test_answers(spark, answer, want):
    row = ranking.parse_answers(spark.createDataFrame([("i", answer)], "id string, answer string")).first()
    assert (row.llm_relevance, row.rationale) == want


def ranked(spark, finals):
    return spark.createDataFrame([(f"d{i:03d}", float(f)) for i, f in enumerate(finals)], "id string, final double")


def chosen(spark, finals, mode, value, bias=0.0):
    df = ranked(spark, finals)
    return select.apply_cutoff(df, select.cutoff_of(df, mode, value)[0], recall_bias=bias).filter("decision = 'selected'").count()


def test_cutoffs(spark):
    line = [round(1 - 0.001 * i, 6) for i in range(100)]
    assert chosen(spark, line, "top_n", 50) == 50 and chosen(spark, line, "threshold", 0.95) == 51
    assert chosen(spark, [0.5] * 10 + [0.4] * 5, "top_n", 3) == 10, "ties at the cutoff are in"
    assert chosen(spark, line, "top_n", 0) == 0 and chosen(spark, [], "top_n", 5) == 0 and chosen(spark, [], "target", 5) == 0
    blocks = [0.9 - 0.001 * i for i in range(30)] + [0.5 - 0.001 * i for i in range(30)]
    cut, knee = select.target_cutoff(ranked(spark, blocks), 30)
    assert knee.index == 30 and knee.gap > 0.3 and chosen(spark, blocks, "target", 30) == 30
    assert chosen(spark, [0.3, 0.2], "target", 5) == 2
    assert chosen(spark, [0.90, 0.85, 0.79], "threshold", 0.80, 0.02) == 3 and chosen(spark, [0.90, 0.85, 0.77], "threshold", 0.80, 0.02) == 2


def test_collapse(spark):
    rows = [("a", "p1", 0.5), ("b", "p2", 0.9), ("c", "p4", 0.7), ("d", "p3", 0.7), ("e", "p5", 0.1)]
    df = spark.createDataFrame([(*r, "undecided", None) for r in rows], "id string, source_path string, final double, decision string, decision_reason string")
    links = spark.createDataFrame([("b", "a"), ("d", "c"), ("e", "zz")], "source string, target string")
    out = {r.id: r for r in duplicates.collapse(df, duplicates.group_roots(df.select("id"), links)).collect()}
    assert [i for i in "abcde" if out[i].decision == "undecided"] == ["b", "d", "e"]
    assert out["a"].decision_reason == "duplicaat van b (final 0.9000)"


@pytest.mark.parametrize("seed", range(4))
def test_near_duplicates_are_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(i, j, rng.choice([0.72, 0.8, 0.91, 0.95])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.25]
    gone, want = set(), set()
    for i, j, c in edges:  # pairs in order of the earlier document
        if i in gone or j in gone:
            continue
        if c >= 0.9:
            gone.add(j)
            want.add((f"i{j}", "duplicate-of", f"i{i}"))
        else:
            want.add((f"i{j}", "overlaps-with", f"i{i}"))
    docs = spark.createDataFrame([(f"i{i}", f"p{i:03d}") for i in range(n)], "id string, source_path string")
    pairs = spark.createDataFrame([(f"i{j}", f"i{i}", c) if rng.random() < 0.5 else (f"i{i}", f"i{j}", c) for i, j, c in edges], "a string, b string, cos double")
    got = duplicates.near_duplicates(docs, storer(spark), edges=pairs).collect()
    # within one earlier document the order of pairs does not matter for duplicates; overlaps follow the closed form
    assert {(r.source, r.kind, r.target) for r in got if r.kind == "duplicate-of"} == {w for w in want if w[1] == "duplicate-of"}
    assert {(r.source, r.target) for r in got if r.kind == "overlaps-with"} == {(w[0], w[2]) for w in want if w[1] == "overlaps-with"}


def test_bm25_equals_the_local_provider(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("geld kunst raad plan xx yy".split()) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {r.id: r.bm25 for r in ranking.bm25(df, "geld voor kunst kunst").collect()}
    want = P.LexicalReranker().rerank("geld voor kunst kunst", texts)
    assert [got[str(i)] for i in range(40)] == pytest.approx(want, abs=2e-6) and max(want) == 1.0
    assert P.LexicalReranker().rerank("x", ["a", "b"]) == [0.0, 0.0]


def test_best_passage_is_the_best_chunk(spark):
    text = "ruis " * 100 + "begroting cultuur subsidie " + "ruis " * 100
    df = spark.createDataFrame([("a", text), ("b", "")], "id string, text string")
    rows = {r.id: r for r in ranking.retrieve(df, "begroting cultuur", size=80).collect()}
    assert "begroting cultuur" in rows["a"].best_passage and rows["b"].final == 0.0 and rows["b"].best_passage == ""
    whole = {r.id: r for r in ranking.retrieve(df, "begroting cultuur", size=10_000).collect()}
    assert whole["a"].final < rows["a"].final


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    assert df.select(V.l2_normalize(F.col("a"))).first()[0] == [0.6, 0.8] and V.bucket_of("begroting") == 72
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b"))).collect()


def brute_linkage(x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    groups, heights = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        best = min((np.mean([1 - unit[a] @ unit[b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return heights


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 12), st.integers(0, 10_000))
def test_average_linkage(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    assert sorted(m[2] for m in topics.average_linkage(x)) == pytest.approx(sorted(brute_linkage(x)), abs=1e-9)


def test_topics(spark):
    a, b, c = np.eye(3)
    assert topics.assign([a, a, b], [0, 0, 1], [0, 0, 2]) == (0, 0)
    assert topics.two_level(np.array([a, a, b]), 0.5, 0.2) == ([0, 0, 1], [0, 0, 1])
    vectors = [(f"d{i}", 0, v.tolist()) for i, v in enumerate([a, a, a, b, b, b, c])]
    df = spark.createDataFrame(vectors, "id string, ordinal int, v array<double>")
    clusters = topics.cluster(df, topic_distance=0.5, subtopic_distance=0.2)
    docs = spark.createDataFrame([(f"d{i}", "aaa tekst" if i < 3 else "bbb tekst") for i in range(8)], "id string, text string")
    rows = {r.id: r.topic for r in topics.label_topics(docs, topics.collapse_small(docs, clusters)).collect()}
    assert rows["d0"] == rows["d2"] != rows["d3"] == rows["d5"] and rows["d6"] == rows["d7"] == topics.REST and "aaa" in rows["d0"]
    menu = topics.topic_menu(topics.label_topics(docs, topics.collapse_small(docs, clusters))).collect()
    assert [len(r.subtopics[0].doc_ids) for r in menu] == [3, 3, 2] and menu[-1].label == topics.REST


def groups_of(df, vectors):
    found = {r.id: (r.topic_no, r.subtopic_no) for r in df.collect()}
    return [found[f"d{i:04d}"] for i in range(len(vectors))]


def agreement(a, b):
    """The share of pairs of documents that both sides put together or apart."""
    a, b = ([x[0] for x in y] for y in (a, b))
    same = [(a[i] == a[j]) == (b[i] == b[j]) for i in range(len(a)) for j in range(i)]
    return sum(same) / len(same)


def test_clusters_beyond_the_exact_bound_agree_with_exact_ones(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.vstack([centres[i % 12] + rng.normal(size=16) for i in range(400)])
    df = spark.createDataFrame([(f"d{i:04d}", 0, v.tolist()) for i, v in enumerate(x)], "id string, ordinal int, v array<double>")
    exact = groups_of(topics.cluster(df, topic_distance=0.5, subtopic_distance=0.2), x)
    assert [e[0] for e in exact] == topics.two_level(x, 0.5, 0.2)[0] and len({e[0] for e in exact}) == 12
    assert [e[1] for e in exact] == topics.two_level(x, 0.5, 0.2)[1]
    for bound in (150, 60):
        assert agreement(groups_of(topics.cluster(df, topic_distance=0.5, subtopic_distance=0.2, max_points=bound), x), exact) >= 0.98
    noise = spark.createDataFrame([(f"d{i:04d}", 0, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))], "id string, ordinal int, v array<double>")
    assert topics.cluster(noise, max_points=20).count() == 300, "vectors without clusters are not refused"


def test_weighted_linkage_is_that_of_the_single_vectors():
    x = topics.unit(np.random.default_rng(5).normal(size=(9, 4)))
    twice = np.vstack([x, x[:3]])
    heights = [h for _, _, h in topics.average_linkage(x, np.array([2, 2, 2, 1, 1, 1, 1, 1, 1.0]))]
    assert sorted(heights) == pytest.approx(sorted(topics.average_linkage(twice), key=lambda m: m[2])[3:] and sorted(h for _, _, h in topics.average_linkage(twice))[3:], abs=1e-9)


def test_leaders_of_a_long_chain_and_of_random_links(spark):
    store, rng = storer(spark), np.random.default_rng(1)
    chain = [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(600)]
    random = sorted({(f"r{min(a, b):03d}", f"r{max(a, b):03d}") for a, b in rng.integers(0, 120, (300, 2)).tolist() if a != b})
    nodes = sorted({n for e in chain + random for n in e} | {"z"})
    edges = spark.createDataFrame(chain + random, "a string, b string")
    want, led = {}, {}
    for n in nodes:
        before = [a for a, b in chain + random if b == n and want.get(a) == a]
        want[n] = min(before, default=n)
    for kw in ({}, {"rounds": 1, "one_task": 10**6}, {"rounds": 0}):
        led = {r.node: r.leader for r in duplicates.leaders(spark.createDataFrame([(n,) for n in nodes], "node string"), edges, store, **kw).collect()}
        assert led == want
    with pytest.raises(RuntimeError):
        duplicates.leaders(spark.createDataFrame([(n,) for n in nodes], "node string"), edges, store, max_rounds=3)


def test_no_text_is_shuffled_for_candidates(spark):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "one two three four five")], "id string, text string")
    plan = duplicates.minhash_candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(text" not in plan and "first(text" not in plan


def test_threads_by_subject_and_broken_headers(spark):
    fields = "id string, source_path string, message_id string, in_reply_to string, references string, subject string, date string"
    rows = [
        ("a", "p1", "<1>", None, None, "Plan", "Mon, 02 Mar 2026 10:00:00 +0100"),
        ("b", "p2", "<2>", None, None, "RE: plan", "Mon, 02 Mar 2026 09:30:00"),
        ("c", "p3", "<3>", "<9>", "<1> <2>", "x", "no date"),
        ("d", "p4", "<4>", "<5>", None, "", None),
        ("e", "p5", "<5>", "<4>", None, "", None),
    ]
    relations, placed = threads.link_threads(spark.createDataFrame(rows, fields), storer(spark))
    parents = {r.source: r.target for r in relations.collect()}
    assert parents["c"] == "b" and parents["b"] == "a" and parents["d"] == "e" and parents["e"] == "d"
    at = {r.id: r for r in placed.collect()}
    assert at["c"].thread_id == "a" and at["c"].thread_tip and at["a"].thread_size == 3 and at["a"].thread_tip_id == "c"
    assert at["d"].thread_id == at["e"].thread_id


def test_one_subject_of_many_mails_is_dealt_over_ranges(spark):
    """Chains across the ranges' borders equal those of a plain sort, with dates that are null or tied."""
    rows = [(f"m{i:03d}", f"p{i % 40:02d}", ["Re: plan", "plan", "", "ander"][i % 4 if i < 40 else 0], None if i % 9 == 0 else (i * 7) % 50) for i in range(300)]
    mails = spark.createDataFrame(rows, "id string, source_path string, subject string, n int").withColumn("sent", F.timestamp_seconds("n")).drop("n")
    none = spark.createDataFrame([], "child string, parent string, evidence string")
    kept, parts = storer(spark), []

    def store(df):
        out = kept(df)
        parts.append(out.select("part").distinct().count())
        return out

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        got = {(r.child, r.parent) for r in threads.subject_parents(mails, none, store).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = set()
    for subject in ("plan", "ander"):
        own = sorted((r for r in rows if r[2].removeprefix("Re: ") == subject), key=lambda r: (r[3] is not None, r[3] or 0, r[1], r[0]))
        want |= {(b[0], a[0]) for a, b in zip(own, own[1:])}
    assert got == want and parts[0] > 1


def test_scope_rules_hold_for_mail_only(spark):
    base = {"doc_type": "email", "text": "kort\n-----Original Message\nrest", "subject": "Fwd: x"}
    rows = [base, base | {"text": "een heel eigen verhaal dat ruim veertig tekens lang is\n-----Original Message"}, base | {"doc_type": "other"}, base | {"subject": "x", "from_": "Postmaster@a"}]
    df = S.conform(spark.createDataFrame([(str(i), r["doc_type"], r["text"], r["subject"], r.get("from_")) for i, r in enumerate(rows)], "id string, doc_type string, text string, subject string, from_ string"))
    got = [r.decision_reason for r in scope.scope_filter(df).orderBy("id").collect()]
    assert got == [scope.FORWARDED, None, None, scope.PROCESS]


def test_validity_defaults(spark):
    df = S.conform(spark.createDataFrame([("a", None), ("b", "x")], "id string, text string"))
    assert {r.decision for r in validity.validity_gate(df).collect()} == {"undecided"}, "missing health counts as usable"


def test_criteria():
    made = criteria.parse_criteria("1. geld: bedragen\n- partij : namen: x\nniets\n: leeg\nleeg:")
    assert [(c.label, c.description) for c in made] == [("geld", "bedragen"), ("partij", "namen: x")]
    assert criteria.articulate("q").source == "fallback" and "q" in criteria.articulate("q").block()


def test_providers():
    assert list(P.batches(["aa", "b", "cccc", "d"], 2, 3)) == [["aa", "b"], ["cccc"], ["d"]]
    assert P.truncated(["abc", "d"], 2) == (["ab", "d"], 1) and P.truncated(["abc"], 0) == (["abc"], 0)
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise TimeoutError
        if "bad" in texts:
            raise ValueError
        return [[1.0, 2.0] for _ in texts]

    remote = P.RemoteEmbed(flaky, max_items=1, retries=1, wait=0)
    assert remote.embed(["x", "bad"]) == [[1.0, 2.0], [0.0, 0.0]] and remote.counters["failed"] == 1
    with pytest.raises(ValueError):
        P.RemoteReranker(lambda q, t: [1.0]).rerank("q", ["a", "b"])
    with pytest.raises(RuntimeError):
        P.NoModel().complete("x")
    with pytest.raises(ValueError):
        P.resolve("local", no_llm=False)
    assert isinstance(P.StructuredScriptedModel(str, json_answer=lambda p: {"score": 1}), P.StructuredLLMProvider)
    log = []
    assert P.RemoteModel(lambda p, s: ("ok", {"tokens": 3}), log=log.append).complete("p") == "ok" and log == [{"model": "remote", "tokens": 3}]


def test_pdf_text_and_json_escaping():
    assert files.plain_pdf_text(b"%PDF-1.4\nstream\nBT (a \\(b\\)) Tj T* <63> Tj ET\nendstream") == "a (b)\nc"
    assert "</script" not in exports.inline_json({"x": "</script>&"}) and exports._column(27) == "AB"
