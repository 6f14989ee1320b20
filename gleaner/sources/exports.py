"""Sinks: inventory, relations, criteria, topics, excluded, reports, manifest, audit."""

from __future__ import annotations

import json
import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schema as S
from gleaner.functions import text as X

INVENTORY_COLUMNS = ("id", "score", "category", "doc_type", "summary", "reason", "motivatie")
PASSAGE = 400


def inventory(selected: DataFrame, *, include_summary: bool = True) -> DataFrame:
    """The selected documents in ranking order, each text cell safe from running as a formula."""
    rows = selected.orderBy(F.desc("final"), "id").select(
        "id", F.round("final", 6).alias("score"), X.category(F.col("topic"), F.col("subtopic")).alias("category"), "doc_type",
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("decision_reason", F.lit("")).alias("reason"), F.coalesce("rationale", F.lit("")).alias("motivatie"),
    )
    names = [c for c in INVENTORY_COLUMNS if include_summary or c != "summary"]
    return rows.select(*[F.col(c) if c == "score" else X.formula_safe(F.col(c)).alias(c) for c in names])


def _column(i: int) -> str:
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def write_xlsx(header: list[str], rows: list[tuple], path: str, sheet: str = "inventaris") -> str:
    """A minimal workbook of one sheet: inline strings and numbers."""

    def cell(r: int, c: int, v) -> str:
        ref = f"{_column(c)}{r}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        clean = "".join(ch for ch in str(v if v is not None else "") if ch >= " " or ch in "\t\n\r")
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(header), *rows], 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind, package = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, head + xml)
    return path


def write_json(data, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    return path


def write_json_lines(df: DataFrame, path: str) -> str:
    """One file, row by row through the driver: no row set is held at once."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            f.write(row.j + "\n")
    return path


def relations_payload(relations: DataFrame, n_docs: int) -> dict:
    edges = [json.loads(r.j) for r in relations.orderBy("source", "seq").select(F.to_json(F.struct("source", "kind", "target", "evidence")).alias("j")).toLocalIterator()]
    return {"edges": edges, "document_count": n_docs, "edge_count": len(edges)}


def excluded_rows(docs: DataFrame) -> DataFrame:
    gone = docs.filter(F.col("decision") == S.OUT_OF_SCOPE)
    reason = F.coalesce("decision_reason", F.lit(""))
    return gone.select("id", X.doc_name(F.col("source_path")).alias("name"), "doc_type", reason.alias("reason"), X.excluded_kind(reason).alias("kind"), F.coalesce("redaction_note", F.lit("")).alias("redaction"))


def excluded_payload(docs: DataFrame) -> dict:
    rows = [r.asDict() for r in excluded_rows(docs).orderBy("id").toLocalIterator()]
    kinds = [r["kind"] for r in rows]
    return {"excluded": rows, "count": len(rows), "validity": kinds.count("validity"), "semantic": kinds.count("semantic")}


def report_documents(selected: DataFrame, relations: DataFrame, query: str) -> DataFrame:
    """What the report shows of each selected document: why it is in, and what it is linked with."""
    own = relations.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "target", "evidence"))).alias("r"))
    plain = F.transform(F.col("r"), lambda x: F.struct(x["kind"].alias("kind"), x["target"].alias("target"), x["evidence"].alias("evidence")))
    passage = F.coalesce("best_passage", F.lit(""))
    return selected.join(own, "id", "left").select(
        "id", X.doc_name(F.col("source_path")).alias("name"), F.round("final", 4).alias("score"),
        *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("rationale", "rationale"), ("summary", "summary"), ("decision_reason", "reason"), ("doc_type", "doc_type"), ("topic", "topic"), ("subtopic", "subtopic"), ("redaction_note", "redaction"))],
        F.substring(passage, 1, PASSAGE).alias("why_passage"), X.term_overlap(F.lit(query), passage).alias("why_terms"),
        F.coalesce(plain, F.array().cast("array<struct<kind:string,target:string,evidence:string>>")).alias("relations"),
    )


PAGE = """<!doctype html><html lang="nl"><head><meta charset="utf-8"><title>__TITLE__</title>
<style>body{font:15px sans-serif;margin:2em;max-width:60em}li{margin:.4em 0}small{color:#555}</style></head>
<body><h1 id="t"></h1><div id="m"></div><script type="application/json" id="d">__DATA__</script><script>
const d = JSON.parse(document.getElementById("d").textContent);
const put = (parent, tag, text) => { const e = document.createElement(tag); e.textContent = text; parent.appendChild(e); return e; };
document.getElementById("t").textContent = d.query || "Onderwerpen";
const main = document.getElementById("m");
for (const [k, v] of Object.entries(d.counts || {})) put(main, "small", k + ": " + v + "  ");
for (const topic of (d.topics && d.topics.onderwerpen) || d.onderwerpen || []) {
  put(main, "h2", topic.label);
  for (const sub of topic.deelonderwerpen) {
    put(main, "h3", sub.label);
    if (sub.summary) put(main, "p", sub.summary);
    const list = put(main, "ul", "");
    for (const id of sub.doc_ids) {
      const doc = (d.documents || {})[id] || {name: id};
      const li = put(list, "li", doc.name + (doc.score === undefined ? "" : " (" + doc.score + ")"));
      if (doc.why_passage) put(li, "p", doc.why_passage);
      if (doc.why_terms && doc.why_terms.length) put(li, "small", doc.why_terms.join(", "));
    }
  }
}
const reasons = {};
for (const x of d.excluded || []) (reasons[x.kind + " / " + x.reason] ||= []).push(x.name);
for (const [reason, names] of Object.entries(reasons)) { put(main, "h3", reason + ": " + names.length); put(main, "p", names.join(", ")); }
</script></body></html>
"""


def inline_json(data) -> str:
    """JSON that cannot end the script element it stands in."""
    return json.dumps(data, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def write_report(data: dict, path: str, title: str = "Rapport") -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(PAGE.replace("__TITLE__", escape(title)).replace("__DATA__", inline_json(data)))
    return path


def menu_payload(menu: DataFrame, source: str, summaries: dict | None = None) -> dict:
    topics = []
    for r in menu.collect():  # topics of the selected core
        subs = [{"label": s.label, "doc_ids": list(s.doc_ids)} for s in r.subtopics]
        for s in subs:
            if summaries is not None:
                s["summary"] = summaries.get((r.label, s["label"]), "")
        topics.append({"label": r.label, "deelonderwerpen": subs})
    return {"source": source, "onderwerpen": topics}


def manifest(kind: str, *, ts: str, providers, params: dict, counts: dict, timings: list[dict], query: str | None = None, criteria=None, cutoff: dict | None = None) -> dict:
    def named(p, **more) -> dict:
        return {"name": getattr(p, "name", "?"), "location": getattr(p, "location", "?"), **more}

    out = {"schema": f"gleaner-{kind}-manifest/1", "ts": ts}
    if query is not None:
        out["query"] = query
    out["providers"] = {"llm": named(providers.llm, enabled=not providers.no_llm), "embed": named(providers.embed), "reranker": named(providers.reranker)}
    if criteria is not None:
        out["criteria"] = {"source": criteria.source, "labels": [c.label for c in criteria.items]}
    if cutoff is not None:
        out["cutoff"] = cutoff
    return out | {"params": params, "counts": counts, "runtime_ms": {"total": round(sum(t["ms"] for t in timings), 1), "stages": timings}}
