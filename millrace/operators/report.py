"""Preparation reports, business reports and their rendering."""

from __future__ import annotations

import datetime
import html
import json
import math
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import unique_names
from ..sources import files
from . import analysis, anomaly, charts, integrate, ml, prepare, trends
from .profile import TableProfile, profile


def plain(value):
    """A value as JSON can hold it: no NaN or infinity, dates as text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, (str, int, bool)):
        return value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return float(value) if hasattr(value, "__float__") else str(value)


def prepare_uploads(spark: SparkSession, session_id: str, saved_files: list[str], folder: str, existing: dict[str, DataFrame] | None = None) -> dict:
    """Files loaded, prepared, matched, joined, validated and written; one bad file is an entry among the errors.

    Gives session_id, datasets (name to frame), report, errors and ready.
    """
    errors, prepared, profiles_, entries, logs, checks = [], {}, {}, [], [], []
    taken = list(existing or {})
    for path in saved_files:
        try:
            loaded = files.load_file(spark, path)
        except Exception as e:
            errors.append({"file": path, "error": str(e).splitlines()[0]})
            continue
        for t in loaded:
            name = unique_names([*taken, t.name], lambda n: n)[-1]
            taken.append(name)
            frame, after, log = prepare.prepare(t.frame)
            place = f"{folder.rstrip('/')}/{name}.parquet"
            files.write_table(frame, place)
            prepared[name], profiles_[name] = spark.read.parquet(place), after
            entries.append({"table_name": name, "source_file": path, "format": t.source_format, "sheet": t.sheet_name, "notes": t.notes, **after.as_dict()})
            logs.append({"table_name": name, "actions": log.actions})
            checks.append({"table_name": name, "checks": integrate.validate(prepared[name], after), "low_relevance": integrate.structural_relevance(after)})
    joined, notes = {}, []
    if len(prepared) >= 2:
        matches = integrate.match_schemas(prepared, profiles_)
        joined, notes = integrate.build_integrated(prepared, integrate.detect_relationships(matches, profiles_), profiles_)
        for name, df in joined.items():
            place = f"{folder.rstrip('/')}/{name}.parquet"
            files.write_table(df, place)
            joined[name] = spark.read.parquet(place)
            note = next(n for n in notes if n["table_name"] == name)
            note["rows"] = joined[name].count()
            if note["rows"] > note["expected_rows"]:
                note["status"] = "failed"
    report = build_report(session_id, entries, logs, checks, notes, errors)
    return {"session_id": session_id, "datasets": prepared | joined, "report": report, "errors": errors, "ready": bool(prepared)}


def build_report(session_id: str, datasets: list[dict], logs: list[dict], checks: list[dict], integration: list[dict], errors: list[dict]) -> dict:
    report = {
        "session_id": session_id, "generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "datasets": datasets,
        "quality": [{"table_name": d["table_name"], "duplicate_rows": d["duplicate_rows"], "issues": {c["name"]: c["issues"] for c in d["columns"] if c["issues"]}} for d in datasets],
        "transformations": logs, "integration": integration, "validation": checks,
        "feature_relevance": [{"table_name": c["table_name"], "low": c["low_relevance"]} for c in checks], "errors": errors,
    }
    return summarized(plain(report))


def summarized(report: dict) -> dict:
    statuses = [c["status"] for t in report["validation"] for c in t["checks"]] + [n.get("status", "passed") for n in report["integration"] if n["built"]]
    report["status"] = "failed" if "failed" in statuses else "warning" if "warning" in statuses else "passed"
    report["summary"] = {
        "tables": len(report["datasets"]), "rows": sum(d["rows"] for d in report["datasets"]), "joins": sum(n["built"] for n in report["integration"]),
        "actions": sum(len(t["actions"]) for t in report["transformations"]), "failed_files": len(report["errors"]),
        "checks": {s: statuses.count(s) for s in ("passed", "warning", "failed")},
    }
    return report


def merge_reports(old: dict | None, new: dict) -> dict:
    """The later entry of each table wins; the rest of the older report stays; the summary is made anew."""
    if not old:
        return new
    out = dict(new)
    for part in ("datasets", "quality", "transformations", "integration", "validation", "feature_relevance"):
        merged = {e["table_name"]: e for e in [*old[part], *new[part]]}
        out[part] = list(merged.values())
    out["errors"] = [*old["errors"], *[e for e in new["errors"] if e not in old["errors"]]]
    return summarized(out)


def save_report(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(report), indent=2, ensure_ascii=False), encoding="utf-8")


def load_report(path: str) -> dict | None:
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else None


def caveats(report: dict, most: int = 8) -> list[str]:
    """What a reader should know of the prepared tables, in a few lines."""
    out = [f"{t['table_name']}: {c['check']} - {c['detail']} ({c['status']})" for t in report["validation"] for c in t["checks"] if c["status"] != "passed"]
    out += [f"{n['table_name']}: not joined, {n['reason']}" for n in report["integration"] if not n["built"]]
    out += [f"{e['file']}: {e['error']}" for e in report["errors"]]
    return out[:most]


# -- what a session keeps, in any store that Spark reads --------------------------------------


def session_folder(folder: str, session_id: str) -> str:
    """The folder of one session below ``folder``; the identifier must be a plain name, as the folder can be deleted."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", session_id or ""):
        raise ValueError(f"Invalid session identifier: {session_id!r}")
    return f"{folder.rstrip('/')}/{session_id}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def keep_report(spark: SparkSession, folder: str, report: dict) -> dict:
    """Merges a report into the one that its session keeps, and keeps the result."""
    merged = plain(merge_reports(get_report(spark, folder, report["session_id"]), report))
    system, place = _place(spark, f"{session_folder(folder, report['session_id'])}/report.json")
    out = system.create(place, True)
    try:
        out.write(bytearray(json.dumps(merged, indent=2, ensure_ascii=False).encode("utf-8")))
    finally:
        out.close()
    return merged


def get_report(spark: SparkSession, folder: str, session_id: str) -> dict | None:
    """The report that a session keeps, or None."""
    path = f"{session_folder(folder, session_id)}/report.json"
    system, place = _place(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if system.exists(place) else None


def agent_context(spark: SparkSession, folder: str, session_id: str) -> str:
    """What was prepared and what to distrust, in a few lines; empty without a report."""
    report = get_report(spark, folder, session_id)
    if report is None:
        return ""
    tables = [f"- {d['table_name']}: {d['rows']} rows, {len(d['columns'])} columns, from {d['source_file']}" for d in report["datasets"]]
    joins = [f"- {n['table_name']}: joined, {n['rows']} rows" for n in report["integration"] if n["built"]]
    known = [f"- {c}" for c in caveats(report)]
    return "\n".join(["Prepared tables:", *tables, *joins, *(["Caveats:", *known] if known else [])])


def delete_session_artifacts(spark: SparkSession, folder: str, session_id: str) -> bool:
    """Deletes all that a session keeps; False if there is nothing."""
    system, place = _place(spark, session_folder(folder, session_id))
    return system.delete(place, True)


# -- analysis reports -------------------------------------------------------------------------


def _rows(df: DataFrame) -> list[dict]:
    return [plain(r.asDict(recursive=True)) for r in df.collect()]


def business_report(df: DataFrame, p: TableProfile | None = None, date: str | None = None, value: str | None = None, category: str | None = None, target: str | None = None) -> dict:
    """Findings over one table; columns that are not named are detected."""
    p = p or profile(df)
    found = integrate.detect_report_columns(df, p)
    date, value, category = date or found["date"], value or found["metric"], category or found["group"]
    out: dict = {"detected_columns": {"date": date, "value": value, "category": category, "target": target}, "rows": p.rows, "columns": len(p.columns), "duplicate_rows": p.duplicate_rows, "key_insights": [], "recommendations": [], "charts": {}}
    say, advise = out["key_insights"].append, out["recommendations"].append
    if date and value:
        summary = trends.trend_summary(df, date, value).first()
        out["trend"] = plain(summary.asDict()) if summary else {}
        if summary:
            say(f"{value} is {summary['direction']}: {summary['total_change_percent']} % over the whole time.")
            if summary["direction"] == "decreasing":
                advise(f"Look into what lowers {value}.")
        out["comparison"] = _rows(trends.compare_periods(df, date, value))
        if category:
            out["growth"] = _rows(trends.growth_ranking(df, date, value, category))
        out["charts"]["trend"] = [(r["period"], r["value"]) for r in _rows(trends.trend(df, date, value).orderBy("period"))]
    if value:
        s = anomaly.summary(df, value).first()
        out["anomalies"] = plain(s.asDict())
        if s["anomaly_count"]:
            say(f"{s['anomaly_count']} unusual values of {value} ({s['anomaly_rate_percent']} %).")
            advise(f"Check the unusual values of {value} before using totals.")
        if category:
            ranked = _rows(analysis.rank_categories(df, category, value))
            out["ranking"] = ranked
            best = [r for r in ranked if r["rank_type"] == "top"]
            if best:
                say(f"{best[0]['category']} leads {category} by {value}: {best[0]['value']:g}.")
            out["charts"]["ranking"] = [(r["category"], r["value"]) for r in best]
    if target:
        out["model"] = plain(ml.train_model(df, target))
    return out


def dataset_report(df: DataFrame, target: str | None = None) -> dict:
    """Profile, statistics and, where there is just one likely target, a baseline model."""
    p = profile(df)
    targets = [target] if target else integrate.candidate_targets(p)
    out = {"profile": p.as_dict(), "statistics": _rows(analysis.statistics(df)) if analysis.numeric_columns(df) else [], "candidate_target_columns": targets, "key_insights": []}
    if len(targets) == 1:
        out["model"] = plain(ml.train_model(df, targets[0]))
    out["key_insights"].append(f"{p.rows} rows, {len(p.columns)} columns, {p.duplicate_rows} duplicate rows.")
    return out


def to_markdown(title: str, report: dict) -> str:
    lines = [f"# {title}", ""]
    for key, v in report.items():
        if key == "charts" or v in (None, [], {}):
            continue
        lines += [f"## {key.replace('_', ' ').capitalize()}", ""]
        if isinstance(v, dict):
            lines += [f"- {k}: {json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else x}" for k, x in v.items()]
        elif isinstance(v, list):
            lines += [f"- {json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else x}" for x in v]
        else:
            lines.append(str(v))
        lines.append("")
    return "\n".join(lines)


def to_html(markdown: str, figures: list[str] = ()) -> str:
    body, listed = [], False
    for line in markdown.splitlines():
        item = line.startswith("- ")
        if item != listed:
            body.append("<ul>" if item else "</ul>")
            listed = item
        text = re.sub(r"(?<!\w)_([^_]+)_(?!\w)", r"<em>\1</em>", html.escape(line.lstrip("#- ") if item or line.startswith("#") else line))
        level = len(line) - len(line.lstrip("#"))
        body.append(f"<li>{text}</li>" if item else f"<h{level}>{text}</h{level}>" if level else f"<p>{text}</p>" if text else "")
    return "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>" + "\n".join([*body, "</ul>" if listed else "", *figures]) + "</body></html>"


def write_docx(markdown: str, path: str) -> None:
    """A plain word-processor document."""
    paragraphs = "".join(
        f'<w:p><w:pPr><w:pStyle w:val="{"Heading1" if x.startswith("# ") else "Heading2" if x.startswith("#") else "Normal"}"/></w:pPr><w:r><w:t xml:space="preserve">{html.escape(x.lstrip("# "))}</w:t></w:r></w:p>'
        for x in markdown.splitlines() if x.strip()
    )
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{paragraphs}</w:body></w:document>')


def write_pdf(markdown: str, path: str, width: int = 95) -> None:
    """A plain document of text lines, 60 to a page."""
    import textwrap

    lines = [y for x in markdown.splitlines() for y in (textwrap.wrap(x, width) or [""])]
    pages = [lines[k : k + 60] for k in range(0, len(lines), 60)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for k, page in enumerate(pages):
        text = "\n".join("(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") '" for x in page)
        stream = b"BT /F1 9 Tf 12 TL 40 800 Td\n" + text.encode("cp1252", "replace") + b"\nET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    Path(path).write_bytes(out)


def write_all(title: str, report: dict, folder: str, name: str) -> dict[str, str]:
    """The report as Markdown, HTML with figures, PDF and DOCX; their paths."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    text = to_markdown(title, report)
    figures = [charts.svg_bars([(str(a), float(b or 0)) for a, b in rows], n) for n, rows in report.get("charts", {}).items() if rows]
    paths = {k: str(base / f"{name}.{k}") for k in ("md", "html", "pdf", "docx")}
    Path(paths["md"]).write_text(text, encoding="utf-8")
    Path(paths["html"]).write_text(to_html(text, figures), encoding="utf-8")
    write_pdf(text, paths["pdf"])
    write_docx(text, paths["docx"])
    return paths


def deliver(paths: dict[str, str], email_to: str | None = None, send=None) -> dict:
    """Confirms that the files exist; mail goes out only through ``send(to, paths)`` that the caller gives."""
    missing = [p for p in paths.values() if not Path(p).exists()]
    if missing:
        return {"error": f"Report files are missing: {missing}"}
    mail = {"attempted": False, "sent": False, "reason": "no address" if not email_to else "no mail service"}
    if email_to and send:
        try:
            send(email_to, paths)
            mail = {"attempted": True, "sent": True, "to": email_to}
        except Exception as e:
            mail = {"attempted": True, "sent": False, "error": str(e)}
    return {"action": "business report", "saved_files": list(paths.values()), "email": mail}
