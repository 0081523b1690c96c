"""Reports: rows for CSV, Markdown per control, assessment JSON, HTML, and their writers.

A result row is (control_id, framework, title, description, chunks, rationale) with
chunks array<struct<chunk_id,document_name,page_number,section_header,raw_text>> in
rank order and rationale the struct of operators.verdicts, null for none.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.operators.evaluation import chunk_controls
from mapwright.operators.verdicts import FULL, INSUFFICIENT, PARTIAL, RATIONALE
from mapwright.scratch import Scratch

CHUNKS = "array<struct<chunk_id:string,document_name:string,page_number:int,section_header:string,raw_text:string>>"
VERDICT = "struct<kind:string,is_compliant:boolean,compliance_level:string,confidence_score:double,explanation:string,reason:string,required_context:string>"


def _score(c: Column) -> Column:
    """A double as text, with at least one decimal."""
    return F.regexp_replace(F.format_string("%s", c), r"E\+?", "e")


def csv_fields(r: Column) -> dict[str, Column]:
    told = r["kind"] == RATIONALE
    of = lambda c: F.when(told, c).otherwise("")
    return {
        "is_compliant": of(F.when(r["is_compliant"], "True").otherwise("False")),
        "compliance_level": of(r["compliance_level"]),
        "confidence_score": of(_score(r["confidence_score"])),
        "rationale": F.when(told, r["explanation"]).when(r["kind"] == INSUFFICIENT, F.concat(F.lit("InsufficientEvidence: "), r["reason"])).otherwise(""),
    }


def csv_rows(results: DataFrame) -> DataFrame:
    """One row per control and chunk; controls without a chunk give none."""
    rows = results.select("control_id", "framework", "title", "rationale", F.explode("chunks").alias("c"))
    return rows.select("control_id", "framework", "title", "c.chunk_id", "c.raw_text", *[c.alias(n) for n, c in csv_fields(F.col("rationale")).items()])


def markdown_verdict(r: Column) -> Column:
    word = F.when(r["compliance_level"] == FULL, "✅ Compliant").when(r["compliance_level"] == PARTIAL, "\U0001f7e1 Partially compliant").otherwise("⚠️ Non-compliant")
    return F.when(r["kind"] == RATIONALE, F.concat(word, F.format_string(" (%.2f)", r["confidence_score"]))).when(r["kind"] == INSUFFICIENT, "Insufficient evidence").otherwise("N/A")


def report_label(r: Column) -> Column:
    return F.when((r["kind"] == RATIONALE) & (r["compliance_level"] == FULL), "Compliant").when((r["kind"] == RATIONALE) & (r["compliance_level"] == PARTIAL), "Partially Compliant").otherwise("Non-Compliant")


def assessment_state(r: Column) -> Column:
    return F.when((r["kind"] == RATIONALE) & (r["compliance_level"] == FULL), "satisfied").when((r["kind"] == RATIONALE) & (r["compliance_level"] == PARTIAL), "alternative").otherwise("not-satisfied")


def markdown_sections(results: DataFrame) -> DataFrame:
    """(control_id, section): heading, verdict, rationale and evidence of each control."""
    r = F.col("rationale")
    why = F.coalesce(F.when(r["kind"] == RATIONALE, r["explanation"]).when(r["kind"] == INSUFFICIENT, r["reason"]), F.lit(""))
    row = F.transform("chunks", lambda c, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), c["document_name"], F.lit(" | "), c["page_number"].cast("string"), F.lit(" | "), F.coalesce(F.nullif(c["section_header"], F.lit("")), F.lit("—")), F.lit(" | "), T.truncate(c["raw_text"], 120), F.lit(" |\n")))
    table = F.when(F.size("chunks") > 0, F.concat(F.lit("**Supporting Evidence:**\n\n| # | Source | Page | Section | Excerpt |\n|---|--------|------|---------|---------|\n"), F.array_join(row, ""), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("## "), F.col("control_id"), F.lit(" — "), F.col("title"), F.lit("\n\n**Framework:** "), F.col("framework"), F.lit(" | **Verdict:** "), markdown_verdict(r), F.lit("\n\n"), F.when(why != "", F.concat(F.lit("**Rationale:** "), why, F.lit("\n\n"))).otherwise(""), table, F.lit("---\n"))
    return results.select("control_id", body.alias("section"))


def findings(results: DataFrame) -> DataFrame:
    """(control_id, finding, observations): assessment JSON of each control, with identifiers from hashes."""
    r = F.col("rationale")
    uid = lambda *c: F.regexp_replace(F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    remark = F.when(r["kind"] == RATIONALE, F.concat(F.lit("Compliant: "), F.when(r["is_compliant"], "True").otherwise("False"), F.lit(", Confidence: "), _score(r["confidence_score"]), F.lit(", Explanation: "), r["explanation"])).when(r["kind"] == INSUFFICIENT, F.concat(F.lit("Insufficient evidence: "), r["reason"], F.lit(". Required: "), r["required_context"]))
    seen = F.transform("chunks", lambda c: F.struct(uid(F.lit("observation"), F.col("framework"), F.col("control_id"), c["chunk_id"]).alias("uuid"), c["raw_text"].alias("description"), F.array(F.lit("EXAMINE")).alias("methods"), F.array(F.struct(uid(F.lit("subject"), c["chunk_id"]).alias("subject-uuid"), F.lit("component").alias("type"), c["document_name"].alias("title"), F.array(F.struct(F.lit("chunk-id").alias("name"), c["chunk_id"].alias("value")), F.struct(F.lit("page-number").alias("name"), c["page_number"].cast("string").alias("value"))).alias("props"))).alias("subjects")))
    one = F.struct(
        uid(F.lit("finding"), F.col("framework"), F.col("control_id")).alias("uuid"),
        F.concat(F.col("control_id"), F.lit(": "), F.col("title")).alias("title"),
        F.col("description"),
        F.struct(F.lit("objective-id").alias("type"), F.col("control_id").alias("target-id"), F.struct(assessment_state(r).alias("state")).alias("status")).alias("target"),
        F.transform(seen, lambda o: F.struct(o["uuid"].alias("observation-uuid"))).alias("related-observations"),
        remark.alias("remarks"),
    )
    return results.select("control_id", F.to_json(one).alias("finding"), F.to_json(seen).alias("observations"))


def atomic_write(path: str | Path, content: str) -> None:
    """A single-file report: written beside its place, then moved there."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(path.name + ".tmp")
    aside.write_text(content, encoding="utf-8")
    aside.replace(path)


def _csv(results: DataFrame) -> str:
    return csv_rows(results).toPandas().to_csv(index=False)


def _markdown(results: DataFrame) -> str:
    parts = [r["section"] for r in markdown_sections(results).toLocalIterator()]
    return "# Compliance Mapping Results\n\n" + ("\n".join(parts) if parts else "No mapping results to display.\n")


def _assessment(results: DataFrame) -> str:
    rows = [*findings(results).toLocalIterator()]
    return json.dumps({"assessment-results": {"metadata": {"title": "Assessment Results", "version": "1.0.0", "oscal-version": "1.1.2"}, "results": [json.loads(r["finding"]) for r in rows], "observations": [o for r in rows for o in json.loads(r["observations"])]}}, indent=2, ensure_ascii=False)


PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Compliance mapping report</title><style>
body{font-family:sans-serif;margin:2em}nav button{margin-right:1em}section[hidden]{display:none}
details{border:1px solid #ccc;margin:.4em 0;padding:.4em}table{border-collapse:collapse}td,th{border:1px solid #ddd;padding:.2em .5em;text-align:left}
.compliant{background:#dfd}.partially-compliant{background:#ffd}.non-compliant,.unmapped{background:#fdd}
</style></head><body><h1>Compliance mapping report</h1>
<nav><button data-show="gaps">Gap analysis</button><button data-show="coverage">Policy coverage</button></nav>
<section id="gaps">"""
SCRIPT = """<script>
document.querySelectorAll("[data-show]").forEach(b => b.onclick = () => document.querySelectorAll("section").forEach(s => { s.hidden = s.id !== b.dataset.show; }));
document.querySelectorAll("[data-only]").forEach(b => b.onclick = () => document.querySelectorAll("details[data-verdict]").forEach(d => { d.hidden = b.dataset.only !== "all" && d.dataset.verdict !== b.dataset.only; }));
</script></body></html>"""


def _escaped(c: Column) -> Column:
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(named))
    return c


def gap_cards(results: DataFrame) -> DataFrame:
    """(control_id, card): a control's verdict, requirement, reasons and evidence as HTML."""
    r = F.col("rationale")
    label = report_label(r)
    kind = F.replace(F.lower(label), F.lit(" "), F.lit("-"))
    why = F.coalesce(F.when(r["kind"] == RATIONALE, r["explanation"]).when(r["kind"] == INSUFFICIENT, F.concat(r["reason"], F.lit(" Required: "), r["required_context"])), F.lit(""))
    score = F.when(r["kind"] == RATIONALE, F.format_string(" %.2f", r["confidence_score"])).otherwise("")
    row = F.transform("chunks", lambda c, i: F.concat(F.lit("<tr><td>"), i + 1, F.lit("</td><td>"), _escaped(c["document_name"]), F.lit("</td><td>"), c["page_number"], F.lit("</td><td>"), _escaped(F.coalesce(F.nullif(c["section_header"], F.lit("")), F.lit("—"))), F.lit("</td><td>"), _escaped(T.strip(F.replace(c["raw_text"], F.lit("\n"), F.lit(" ")))), F.lit("</td></tr>")))
    table = F.when(F.size("chunks") > 0, F.concat(F.lit("<table><tr><th>#</th><th>Source</th><th>Page</th><th>Section</th><th>Excerpt</th></tr>"), F.array_join(row, ""), F.lit("</table>"))).otherwise("")
    part = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<p><b>{tag}</b> "), _escaped(c), F.lit("</p>"))).otherwise("")
    head = F.concat(F.lit('<details data-verdict="'), kind, F.lit('"><summary class="'), kind, F.lit('">'), _escaped(F.col("control_id")), F.lit(" "), _escaped(F.col("title")), F.lit(" ["), label, F.lit("]"), score, F.lit("</summary><p>"), _escaped(F.col("framework")), F.lit("</p>"))
    return results.select("control_id", F.concat(head, part("Requirement", F.col("description")), part("Analysis", why), table, F.lit("</details>")).alias("card"))


def coverage_cards(results: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(document_name, card): a document's chunks with the controls that they support; of ``chunks`` all, else those of results."""
    used = results.select("control_id", F.explode("chunks").alias("c")).select("control_id", "c.*")
    every = used.drop("control_id") if chunks is None else chunks.select("chunk_id", "document_name", "page_number", "section_header", "raw_text")
    per = chunk_controls(every.dropDuplicates(["chunk_id"]), used, "chunk_id", "control_id")
    none = F.size("controls") == 0
    row = F.concat(F.lit('<tr class="'), F.when(none, "unmapped").otherwise(""), F.lit('"><td>'), "page_number", F.lit("</td><td>"), _escaped(F.coalesce("section_header", F.lit("—"))), F.lit("</td><td>"), _escaped(T.truncate(F.col("raw_text"), 200)), F.lit("</td><td>"), _escaped(F.array_join("controls", ", ")), F.lit("</td></tr>"))
    rows = per.groupBy("document_name").agg(F.count("*").alias("n"), F.count_if(~none).alias("mapped"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "chunk_id", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    return rows.select("document_name", F.concat(F.lit("<details><summary>"), _escaped(F.col("document_name")), F.lit(": "), "mapped", F.lit(" of "), "n", F.lit(" chunks mapped</summary><table><tr><th>Page</th><th>Section</th><th>Excerpt</th><th>Controls</th></tr>"), "rows", F.lit("</table></details>")).alias("card"))


def _html(results: DataFrame, chunks: DataFrame | None = None) -> str:
    label = report_label(F.col("rationale"))
    counts = {r["label"]: r["n"] for r in results.groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect()}
    kinds = ("Compliant", "Partially Compliant", "Non-Compliant")
    stats = f"<p>{sum(counts.values())} controls: " + ", ".join(f"{counts.get(k, 0)} {k.lower()}" for k in kinds) + "</p>"
    filters = "".join(f'<button data-only="{k.lower().replace(" ", "-")}">{k}</button>' for k in ("All", *kinds))
    gaps = "\n".join(r["card"] for r in gap_cards(results).toLocalIterator())
    covered = "\n".join(r["card"] for r in coverage_cards(results, chunks).orderBy("document_name").toLocalIterator())
    return f'{PAGE}{stats}{filters}\n{gaps}</section><section id="coverage" hidden>{covered}</section>{SCRIPT}'


def _json(results: DataFrame) -> str:
    return "[" + ",\n".join(r["j"] for r in results.select(F.to_json(F.struct(*results.columns)).alias("j")).toLocalIterator()) + "]"


FORMATS: dict[str, Callable[[DataFrame], str]] = {"csv": _csv, "markdown": _markdown, "oscal": _assessment, "html": _html}


def emit(results: DataFrame, formats: str, paths: str | None = None, chunks: DataFrame | None = None) -> list[str]:
    """One result set in several formats; unknown formats are JSON. Without paths, texts are returned.

    ``chunks`` are all chunks of the store, for the coverage part of the HTML report.
    """
    names = [f.strip() for f in formats.split(",")]
    where = [p.strip() for p in paths.split(",")] if paths else []
    if where and len(where) != len(names) or not where and len(names) > 1:
        raise ValueError("as many paths as formats are needed")
    kept = Scratch(results.sparkSession, "emit").keep(results, "results") if len(names) > 1 else results
    out = [_html(kept, chunks) if n == "html" else FORMATS.get(n, _json)(kept) for n in names]
    for path, content in zip(where, out, strict=False):
        atomic_write(path, content)
    return out


def export_parts(results: DataFrame, kind: str, folder: str) -> None:
    """A report too large for one file: its rows, or its controls' texts, as files of a folder, written by the tasks."""
    if kind == "csv":
        csv_rows(results).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
    elif kind == "oscal":
        findings(results).select(F.concat(F.lit('{"finding": '), "finding", F.lit(', "observations": '), "observations", F.lit("}"))).write.mode("overwrite").text(folder)
    elif kind in ("markdown", "html"):
        (markdown_sections if kind == "markdown" else gap_cards)(results).drop("control_id").write.mode("overwrite").text(folder)
    else:
        results.write.mode("overwrite").json(folder)
