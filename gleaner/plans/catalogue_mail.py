"""More registered queries: mail, attachments, vectors, reports and topics, over rows derived from the tables the same way on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schema as S
from gleaner.functions import text as X
from gleaner.functions import vectors as V
from gleaner.operators import criteria, duplicates, threads, topics
from gleaner.plans import catalogue as C
from gleaner.plans.observe import reason_histogram as histogram
from gleaner.plans.relate import relation_totals as totals
from gleaner.plans.runtime import storer
from gleaner.sources import exports, files

PREFIXES = ("", "RE: ", "Fwd: re: ", " fw:  ", "Re:RE: ")
#: the same turns in SQL, with their ids
TURNS = C.TURNS


def _mails(spark, sf_dir):
    """Turns as mails with a subject and a date, and no header that links them."""
    n = (F.col("conv_id") + F.col("turn")) % len(PREFIXES)
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), n.cast("int") + 1)
    k, none = F.col("turn").cast("int"), F.lit(None).cast("string")
    day = ((F.col("conv_id") % 28) + 1).cast("int")
    date = F.format_string("%02d Mar 2026 %02d:%02d:%02d +0%d00", day, (k / 3600).cast("int") % 24, (k / 60).cast("int") % 60, k % 60, (F.col("conv_id") % 6).cast("int"))
    return C._turns(spark, sf_dir).withColumns(
        {"source_path": F.col("id"), "subject": F.concat(prefix, F.lit("Onderwerp "), "conv_id"), "date": date, "message_id": none, "in_reply_to": none, "references": none}
    )


def subject_normalised(spark, sf_dir):
    return _mails(spark, sf_dir).select("id", X.norm_subject(F.col("subject")).alias("subject"))


def mail_dates(spark, sf_dir):
    return _mails(spark, sf_dir).select("id", F.unix_seconds(threads.mail_date("date")).alias("sent"))


def subject_thread_parents(spark, sf_dir):
    """Mails without headers follow each other by subject and date."""
    mails = _mails(spark, sf_dir).withColumn("sent", threads.mail_date("date"))
    none = spark.createDataFrame([], "child string, parent string, evidence string")
    return threads.subject_parents(mails, none, storer(spark)).select(F.col("child").alias("id"), "parent", "evidence")


def reference_parents(spark, sf_dir):
    """Mails that cite two earlier turns and, at times, an id that nobody has: the last known one is the parent."""
    tag = lambda back: F.concat(F.lit("<"), "conv_id", F.lit(":"), F.lpad((F.col("turn") - back).cast("string"), 6, "0"), F.lit(">"))
    unknown = F.when(F.col("turn") % 3 == 0, " <nobody>").otherwise("")
    mails = C._turns(spark, sf_dir).withColumns(
        {"source_path": F.col("id"), "message_id": F.concat(F.lit("<"), "id", F.lit(">")), "in_reply_to": F.lit(None).cast("string"), "references": F.concat(tag(2), F.lit(" "), tag(1), unknown)}
    )
    return threads.header_parents(mails).select(F.col("child").alias("id"), "parent", "evidence")


def attachment_edges(spark, sf_dir):
    """Later turns as attachments of the first one of their conversation."""
    rows = C._turns(spark, sf_dir)
    first = rows.groupBy("conv_id").agg(F.min("id").alias("mail"))
    docs = rows.join(first, "conv_id").filter("id != mail").withColumns({"attachment_of": F.col("mail"), "filename": F.concat("id", F.lit(".txt"))})
    return files.attachment_relations(docs)


def doc_types_by_name(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("a.PDF", "b.docx", "c.Ods", "d.txt", "e", "f.pdf.zip"))), (F.col("doc_id") % 6).cast("int") + 1)
    return C._docs(spark, sf_dir).select("doc_id", X.doc_type_of(name).alias("doc_type"))


def truncated_words(spark, sf_dir):
    return C._docs(spark, sf_dir).select("doc_id", F.md5(X.truncate_words(F.col("text"), 20)).alias("digest"))


def exclude_verdicts(spark, sf_dir):
    answer = F.element_at(F.array(*map(F.lit, ("UITSLUITEN", "  uitsluiten, want", "Behouden", "niet UITSLUITEN", ""))), (F.col("doc_id") % 5).cast("int") + 1)
    return C._docs(spark, sf_dir).select("doc_id", X.is_exclude_verdict(answer).alias("refused"))


def criteria_lines(spark, sf_dir):
    """Criteria read from a model's answer; lines without both parts are none."""
    answer = F.format_string("Hier zijn ze\n- label %1$d: tekst %1$d\n2. : leeg\n* 3. tweede: deel: met punt %1$d\nzonder", F.col("doc_id"))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("description", T.StringType())])))
    def parsed(answers):
        return answers.map(lambda a: [{"label": c.label, "description": c.description} for c in criteria.parse_criteria(a)])

    return C._docs(spark, sf_dir).select("doc_id", F.inline(parsed(answer)))


def usable_unit_vectors(spark, sf_dir):
    """Vectors, some of them null, zero or not finite: which can be used, and the length of the normalised ones."""
    k = F.col("vec_id") % 10
    v = F.col("embedding").cast("array<double>")
    v = F.when(k == 0, F.lit(None)).when(k == 1, F.transform(v, lambda x: x * 0)).when(k == 2, F.concat(v, F.array(F.lit(float("nan"))))).otherwise(v)
    rows = C._table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    ok = F.coalesce(V.usable(F.col("v")), F.lit(False))
    return rows.select("vec_id", ok.alias("usable"), F.when(ok, F.round(V.norm(V.l2_normalize(F.col("v"))), 6)).otherwise(0.0).alias("length"))


def exclusion_reasons(spark, sf_dir):
    """The four most frequent reasons of the validity gate."""
    return histogram(C._gated(spark, sf_dir))


def _exact(spark, sf_dir):
    return duplicates.exact_duplicates(C._docs(spark, sf_dir)).select("source", F.lit(S.DUPLICATE_OF).alias("kind"), "target", "evidence")


def relate_totals(spark, sf_dir):
    """Totals over exact copies, each also as an overlap with itself turned around."""
    exact = _exact(spark, sf_dir)
    turned = exact.select(F.col("target").alias("source"), F.lit(S.OVERLAPS_WITH).alias("kind"), F.col("source").alias("target"), "evidence")
    return totals(exact.unionByName(turned))


def exact_duplicate_evidence(spark, sf_dir):
    return _exact(spark, sf_dir).select("source", "target", "evidence")


def report_rows(spark, sf_dir):
    """What the report says of each document above the threshold: score, passage, terms, links."""
    ranked = C._retrieved(spark, sf_dir).filter(F.col("final") >= C.THRESHOLD)
    rows = S.conform(C._docs(spark, sf_dir).join(ranked, "id").withColumn("decision", F.lit(S.SELECTED)))
    found = exports.report_documents(rows, C.numbered(_exact(spark, sf_dir)), C.QUERY)
    targets = F.array_join(F.transform("relations", lambda r: r["target"]), ",")
    return found.select("id", "name", "score", F.md5("why_passage").alias("passage"), F.array_join("why_terms", ",").alias("terms"), targets.alias("linked"))


SIZES, LEAST = 60, 20


def _placed(spark, sf_dir):
    docs = C._docs(spark, sf_dir)
    no = F.col("doc_id") * F.col("doc_id") % SIZES
    close = (F.col("doc_id") * 7919 % 1000) / 1000
    clusters = docs.select("id", no.alias("topic_no"), (F.col("doc_id") % 2).alias("subtopic_no"), close.alias("closeness"))
    return docs.select("id", "text"), topics.collapse_small(docs, clusters, LEAST)


def topic_sizes(spark, sf_dir):
    """Documents by topic; topics that are too small are one (-1)."""
    placed = _placed(spark, sf_dir)[1]
    return placed.groupBy(F.coalesce("topic_no", F.lit(-1)).alias("topic_no")).agg(F.count("*").alias("n"))


def topic_menu_order(spark, sf_dir):
    """Each document's place in its subtopic of the menu, nearest to the middle first."""
    placed = _placed(spark, sf_dir)[1]
    named = placed.withColumns({"topic": F.coalesce(F.col("topic_no").cast("string"), F.lit(topics.REST)), "subtopic": F.coalesce(F.col("subtopic_no").cast("string"), F.lit(topics.REST))})
    menu = topics.topic_menu(named)
    rows = menu.select("label", F.inline("subtopics").alias("subtopic", "doc_ids"))
    return rows.select("label", "subtopic", F.posexplode("doc_ids").alias("place", "id")).withColumn("place", F.col("place").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        subject_normalised, mail_dates, subject_thread_parents, reference_parents, attachment_edges, doc_types_by_name, truncated_words, exclude_verdicts,
        criteria_lines, usable_unit_vectors, exclusion_reasons, relate_totals, exact_duplicate_evidence, report_rows, topic_sizes, topic_menu_order,
    )
}

_SENT = "epoch(make_timestamp(2026, 3, conv_id % 28 + 1, (turn // 3600) % 24, (turn // 60) % 60, CAST(turn % 60 AS DOUBLE))) - 3600 * (conv_id % 6)"
_LAST = "regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+')"
_PLACED = (
    f"WITH {C.DOCS}, c AS (SELECT id, doc_id * doc_id % {SIZES} AS t, doc_id % 2 AS s, (doc_id * 7919 % 1000) / 1000.0 AS close FROM docs), "
    f"p AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY t) >= {LEAST} THEN t END AS t, s, close FROM c) "
)

ORACLE_SQL = {
    "subject_normalised": f"WITH {TURNS} SELECT id, 'onderwerp ' || CAST(conv_id AS VARCHAR) AS subject FROM t",
    "mail_dates": f"WITH {TURNS} SELECT id, CAST({_SENT} AS BIGINT) AS sent FROM t",
    "subject_thread_parents": f"WITH {TURNS}, p AS (SELECT id, conv_id, lag(id) OVER (PARTITION BY conv_id ORDER BY {_SENT}, id) AS parent FROM t) SELECT id, parent, 'heuristiek:onderwerp ' || CAST(conv_id AS VARCHAR) AS evidence FROM p WHERE parent IS NOT NULL",
    "reference_parents": f"WITH {TURNS}, k AS (SELECT a.id, b.id AS parent, b.turn AS b_turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)), m AS (SELECT id, first(parent ORDER BY b_turn DESC) AS parent FROM k GROUP BY id) SELECT id, parent, 'header:<' || parent || '>' AS evidence FROM m",
    "attachment_edges": f"WITH {TURNS}, f AS (SELECT *, min(id) OVER (PARTITION BY conv_id) AS mail FROM t) SELECT id AS source, 'attachment-of' AS kind, mail AS target, id || '.txt' AS evidence FROM f WHERE id <> mail",
    "doc_types_by_name": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf_digital' WHEN 1 THEN 'office' WHEN 2 THEN 'office' ELSE 'other' END AS doc_type FROM documents",
    "truncated_words": f"WITH {C.DOCS}, w AS (SELECT doc_id, text, {_LAST} AS w FROM docs) SELECT doc_id, md5(CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(list_slice(w, 1, 20), ' ') END) AS digest FROM w",
    "exclude_verdicts": "SELECT doc_id, doc_id % 5 < 2 AS refused FROM documents",
    "criteria_lines": "SELECT doc_id, 'label ' || doc_id AS label, 'tekst ' || doc_id AS description FROM documents UNION ALL SELECT doc_id, 'tweede', 'deel: met punt ' || doc_id FROM documents",
    "usable_unit_vectors": "SELECT vec_id, vec_id % 10 > 2 AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS usable, CASE WHEN vec_id % 10 > 2 AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM embeddings",
    "exclusion_reasons": C.GATED + "SELECT reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 4",
    "relate_totals": f"WITH {C.DOCS}, {C.EXACT} SELECT count(DISTINCT source) AS duplicates, count(*) AS overlaps FROM exact",
    "exact_duplicate_evidence": f"WITH {C.DOCS}, {C.EXACT} SELECT source, target, 'identieke inhoud (sha256:' || substr(digest, 1, 12) || ')' AS evidence FROM exact",
    "report_rows": f"WITH {C.DOCS}, {C.RETRIEVED}, {C.EXACT}, w AS (SELECT DISTINCT unnest({C.TOKENS.format(repr(C.QUERY))}) AS w), r AS (SELECT d.id, d.source_path, final, substr(best_passage, 1, {exports.PASSAGE}) AS passage, best_passage FROM docs d JOIN best USING (id) WHERE final >= {C.THRESHOLD}) "
    f"SELECT id, split_part(source_path, '/', -1) AS name, CAST(round(CAST(final AS DECIMAL(12, 6)), 4) AS DOUBLE) AS score, md5(passage) AS passage, array_to_string(list_filter({C.TOKENS.format(repr(C.QUERY))}, lambda w: list_contains({C.TOKENS.format('best_passage')}, w)), ',') AS terms, coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM exact WHERE source = r.id), '') AS linked FROM r",
    "topic_sizes": _PLACED + "SELECT coalesce(t, -1) AS topic_no, count(*) AS n FROM p GROUP BY 1",
    "topic_menu_order": _PLACED + "SELECT label, subtopic, row_number() OVER (PARTITION BY label, subtopic ORDER BY close DESC, id) - 1 AS place, id FROM (SELECT id, coalesce(CAST(t AS VARCHAR), 'Overig') AS label, CASE WHEN t IS NULL THEN 'Overig' ELSE CAST(s AS VARCHAR) END AS subtopic, CASE WHEN t IS NULL THEN 0 ELSE close END AS close FROM p)",
}
