"""An analysis as a whole: lazy parts, the report document, and its JSON, HTML and text forms."""

from __future__ import annotations

import html as _html
import json
import os
import tempfile
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import format_duration, iso_ms, number_text, percent_py
from ..operators import aggregate, anomalies as anomaly_ops, precursors as precursor_ops, templates as template_ops
from ..operators.parse import parse
from ..operators.redact import Redactor, redact, redaction_counts
from ..options import VERSION, AnalyzeOptions
from ..sources.lines import bound, lines_from, source_label, spread
from ..storage import materialise, release

TOOL = "tracewell"


@dataclass
class Analysis:
    """Parts of an analysis as DataFrames; ``to_dict`` collects the small ones into a report."""

    lines: DataFrame
    options: AnalyzeOptions
    started: float = field(default_factory=time.perf_counter)

    def __post_init__(self):
        self.options.validate()
        self.redactor = Redactor(self.options.redaction, self.options.redact)
        self.lines = bound(self.lines, self.options.max_line_length)

    @cached_property
    def events(self) -> DataFrame:
        """Redacted canonical events with event_ms; kept as a table, as every part reads them."""
        parsed = self._parsed = materialise(redact(parse(spread(self.lines), self.options.now.year, isolated=False), self.redactor).drop("attributes"))
        missing = parsed.filter(F.col("ts_ms").isNull()).limit(1).count() > 0
        return aggregate.with_event_time(parsed, self.options.now_ms, missing)

    @cached_property
    def assigned(self) -> DataFrame:
        return materialise(template_ops.assign_templates(self.events))

    @cached_property
    def timeline(self) -> DataFrame:
        return materialise(aggregate.timeline(self.events, self.options.bucket_ms))

    @property
    def summary(self) -> DataFrame:
        return aggregate.summary(self.events)

    @property
    def latency(self) -> DataFrame:
        return aggregate.latency_summary(self.events)

    def counts(self, column: str) -> DataFrame:
        return aggregate.counts_by(self.events, column)

    @property
    def redactions(self) -> DataFrame:
        return redaction_counts(self.events)

    @cached_property
    def anomalies(self) -> DataFrame:
        return materialise(anomaly_ops.detect(self.assigned, self.timeline, self.options.bucket_ms))

    @property
    def template_summary(self) -> DataFrame:
        return template_ops.template_summary(self.assigned)

    @property
    def templates(self) -> DataFrame:
        """Templates with nested levels, services and samples, and whether an anomaly names them."""

        def nested(by: str) -> DataFrame:
            item = F.struct((-F.col("count")).alias("o"), "name", "count", "percent")
            rows = template_ops.template_counts(self.assigned, by).groupBy("template_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
            return rows.select("template_id", F.transform("x", lambda s: F.struct(s["name"].alias("name"), s["count"].alias("count"), s["percent"].alias("percent"))).alias(f"{by}s"))

        flagged = self.anomalies.select("template_id").filter("template_id is not null").distinct().withColumn("anomalous", F.lit(True))
        out = self.template_summary
        for part in (nested("level"), nested("service"), template_ops.sample_messages(self.assigned, self.options.max_samples)):
            out = out.join(part, "template_id")
        out = out.join(flagged, "template_id", "left").withColumn("anomalous", F.coalesce("anomalous", F.lit(False)))
        return out.orderBy(F.desc("count"), "template_id")

    @cached_property
    def sequence(self) -> DataFrame:
        return precursor_ops.sequence(self.assigned, self.options.max_sequence_events)

    @property
    def precursors(self) -> DataFrame:
        texts = self.assigned.select("template_id", "template").distinct()
        return precursor_ops.find_precursors(self.sequence, texts, self.options.sequence_window_ms)

    def to_dict(self) -> dict:
        o = self.options
        lines = aggregate.line_counts(self.lines).first()
        s = self.summary.withColumns({"first": iso_ms(F.col("first_seen_ms")), "last": iso_ms(F.col("last_seen_ms"))}).first()
        rows = lambda df: [r.asDict(True) for r in df.collect()]
        timeline = rows(self.timeline)
        templates = rows(self.templates.withColumns({"first": iso_ms(F.col("first_seen_ms")), "last": iso_ms(F.col("last_seen_ms"))}))
        latency = self.latency.first().asDict()
        label, extra = self.redactor.text(source_label(o.source))
        hits = {r["name"]: r["count"] for r in rows(self.redactions)}
        for k, n in extra.items():
            hits[k] = hits.get(k, 0) + n
        total = sum(hits.values())
        seen = self.events.filter("ts_ms is not null").count() if o.precursors else 0
        kept = seen if o.max_sequence_events is None else min(seen, o.max_sequence_events)
        present = lambda **kv: {k: v for k, v in kv.items() if v is not None}
        doc = {
            "schemaVersion": "1.1" if o.precursors else "1.0",
            "metadata": {
                "tool": TOOL, "version": VERSION, "generatedAt": datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "source": label,
                "bucketMs": o.bucket_ms, "redactionEnabled": self.redactor.enabled, "durationMs": round((time.perf_counter() - self.started) * 1000, 2),
            },
            "summary": {
                "linesRead": lines["lines"], "events": s["events"], "malformedLines": s["malformed"], "truncatedLines": lines["truncated"] or 0, "errors": s["errors"], "warnings": s["warnings"],
                "errorRate": s["error_rate"], "services": s["services"], "templates": len(templates), **present(firstSeen=s["first"], lastSeen=s["last"]),
            },
            "formats": rows(self.counts("format")), "levels": rows(self.counts("level")), "services": rows(self.counts("service")),
            "templates": [
                {"id": t["template_id"], **{k: t[k] for k in ("template", "count", "percent", "errors", "levels", "services", "samples", "anomalous")}, **present(firstSeen=t["first"], lastSeen=t["last"])}
                for t in templates
            ],
            "timeline": [{"timestamp": b["timestamp"], "count": b["count"], "errors": b["errors"], "errorRate": b["error_rate"], **present(latencyP95Ms=b["latency_p95_ms"])} for b in timeline],
            "anomalies": [
                {**{k: a[k] for k in ("id", "type", "severity", "title", "detail", "timestamp", "observed", "expected", "score")}, **present(templateId=a["template_id"])}
                for a in rows(anomaly_ops.in_order(self.anomalies))
            ],
        }
        if latency["count"]:
            doc["summary"]["latency"] = {_camel(k): v for k, v in latency.items()}
        if o.precursors:
            doc["metadata"]["precursorAnalysis"] = {"enabled": True, "sequenceWindowMs": o.sequence_window_ms, **present(maxSequenceEvents=o.max_sequence_events), "eventsSeen": seen, "eventsRetained": kept, "truncated": seen > kept}
            doc["precursors"] = [{_camel(k): v for k, v in p.items()} for p in rows(self.precursors)]
        by_type = sorted(({"name": k, "count": n, "percent": percent_py(n, total)} for k, n in hits.items()), key=lambda x: (-x["count"], x["name"]))
        doc["privacy"] = {"redactions": total, "byType": by_type}
        doc["notes"] = _notes(doc, s["missing_timestamps"], seen, kept, o.precursors)
        return doc

    def release(self) -> None:
        """Remove the tables that the parts were kept in."""
        for part in ("assigned", "timeline", "anomalies", "_parsed"):
            if part in self.__dict__:
                release(self.__dict__.pop(part))
        self.__dict__.pop("events", None)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _notes(doc: dict, missing: int, seen: int, kept: int, precursors: bool) -> list[str]:
    notes = []
    cut = doc["summary"]["truncatedLines"]
    if missing:
        notes.append(f"{missing} event(s) had no timestamp; they count in the bucket of the latest known time, or of the analysis time before any.")
    if cut:
        notes.append(f"{cut} line(s) were longer than the byte limit and were cut.")
    if len(doc["timeline"]) < 4:
        notes.append("Anomalies need a bucket and at least three populated others to compare it with.")
    if precursors:
        notes.append("Failure precursors are associations in time and no evidence of cause.")
        if missing:
            notes.append(f"{missing} event(s) without a timestamp took no part in the precursor analysis.")
        if seen > kept:
            notes.append(f"The precursor analysis kept the first {kept:,} of {seen:,} events with a timestamp; it may be incomplete.")
    return notes


def analyze(spark: SparkSession, lines, options: AnalyzeOptions | None = None) -> Analysis:
    """Analysis of a DataFrame of lines (seq, text, truncated) or of lines in memory."""
    df = lines if isinstance(lines, DataFrame) else lines_from(spark, lines)
    return Analysis(df, options or AnalyzeOptions())


def render_json(doc: dict, pretty: bool = True) -> str:
    return json.dumps(doc, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"


def json_for_html(doc: dict) -> str:
    """JSON that cannot end a script element, whatever it holds."""
    text = json.dumps(doc, ensure_ascii=False, separators=(",", ":"))
    for char in "&<>  ":
        text = text.replace(char, f"\\u{ord(char):04x}")
    return text


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>%(title)s</title>
<style>
body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem;color:#1d2430;background:#fafbfc}
table{border-collapse:collapse;width:100%%}td,th{text-align:left;padding:.3rem .6rem;border-bottom:1px solid #dde3ea;vertical-align:top}
.bar{display:inline-block;width:6px;margin-right:1px;background:#6b8fb8;vertical-align:bottom}.bar.e{background:#c8553d}
code{font-size:.92em}input,select,button{font:inherit;padding:.2rem .4rem;margin-right:.4rem}.n{color:#5c6877}
</style></head><body><h1>%(title)s</h1><p id="totals"></p><div id="chart"></div><p id="point" class="n"></p>
<h2>Anomalies</h2><div id="anomalies"></div><h2>Templates</h2>
<p><input id="q" placeholder="search"><select id="level"></select><select id="service"></select><select id="sort"><option>errors<option>latest<option>template<option>count</select><button id="save">Save JSON</button></p>
<table><thead><tr><th>count<th>errors<th>template<th>levels</tr></thead><tbody id="rows"></tbody></table>
<h2>Precursors</h2><div id="precursors"></div><h2>Notes</h2><ul id="notes"></ul>
<script id="data" type="application/json">%(data)s</script>
<script>
const report=JSON.parse(document.getElementById('data').textContent),at=id=>document.getElementById(id);
const add=(parent,tag,text)=>{const e=document.createElement(tag);if(text!==undefined)e.textContent=text;parent.append(e);return e};
const s=report.summary;at('totals').textContent=`${s.events} events, ${s.errors} errors (${s.errorRate}%%), ${s.templates} templates, ${s.services} services, ${report.privacy.redactions} redactions`;
const peak=Math.max(1,...report.timeline.map(b=>b.count));
for(const b of report.timeline){const e=add(at('chart'),'span');e.className='bar'+(b.errors?' e':'');e.style.height=(4+76*b.count/peak)+'px';e.onmouseenter=()=>{at('point').textContent=`${b.timestamp}: ${b.count} events, ${b.errors} errors`+(b.latencyP95Ms===undefined?'':`, p95 ${b.latencyP95Ms} ms`)}}
for(const a of report.anomalies.slice(0,12))add(at('anomalies'),'p',`[${a.severity}] ${a.title}, ${a.timestamp}: ${a.detail}`);
if(!report.anomalies.length)add(at('anomalies'),'p','none');
for(const p of report.precursors||[])add(at('precursors'),'p',`${p.service}: ${p.sourceTemplate} \\u2192 ${p.failureTemplate} (${p.support}/${p.occurrences}, lift ${p.lift})`);
for(const n of report.notes)add(at('notes'),'li',n);
for(const [id,items] of [['level',report.levels.slice(0,7)],['service',report.services]]){add(at(id),'option','any '+id).value='';for(const x of items)add(at(id),'option',x.name).value=x.name}
const by={errors:(a,b)=>b.errors-a.errors||b.count-a.count,count:(a,b)=>b.count-a.count,latest:(a,b)=>(b.lastSeen||'').localeCompare(a.lastSeen||''),template:(a,b)=>a.template.localeCompare(b.template)};
function show(){const q=at('q').value.toLowerCase(),l=at('level').value,v=at('service').value,body=at('rows');body.textContent='';
 const hit=report.templates.filter(t=>(!q||(t.template+' '+t.samples.join(' ')).toLowerCase().includes(q))&&(!l||t.levels.some(x=>x.name===l))&&(!v||t.services.some(x=>x.name===v))).sort(by[at('sort').value]);
 for(const t of hit){const r=add(body,'tr');add(r,'td',t.count);add(r,'td',t.errors);const c=add(r,'td');add(c,'code',t.template);for(const m of t.samples)add(c,'div',m).className='n';add(r,'td',t.levels.slice(0,3).map(x=>x.name+' '+x.count).join(', '))}}
for(const id of ['q','level','service','sort'])at(id).oninput=show;show();
at('save').onclick=()=>{const a=document.createElement('a');a.href=URL.createObjectURL(new Blob([JSON.stringify(report,null,2)],{type:'application/json'}));a.download='report.json';a.click()};
</script></body></html>
"""


def render_html(doc: dict) -> str:
    """One page that holds its data and asks no network for anything."""
    title = _html.escape(f"Log report: {doc['metadata']['source']}", quote=True)
    return _PAGE % {"title": title, "data": json_for_html(doc)}


def render_text(doc: dict, top: int = 10) -> str:
    """Summary of 72 columns for a terminal."""
    s, meta = doc["summary"], doc["metadata"]
    out = [f"{meta['tool']} {meta['version']}  {meta['source']}", "─" * 72]
    out.append(f"{s['events']:,} events  ·  {s['errors']:,} errors ({number_text(s['errorRate'])}%)  ·  {s['templates']:,} templates")
    out.append(f"{s['services']:,} services  ·  {len(doc['anomalies']):,} anomalies  ·  {doc['privacy']['redactions']:,} redactions")
    if lat := s.get("latency"):
        out.append("Latency  " + "  ·  ".join(f"{p} {format_duration(lat[p + 'Ms'])}" for p in ("p50", "p95", "p99")))
    out += ["", "Top templates"]
    if not doc["templates"]:
        out.append("  (no events)")
    for k, t in enumerate(doc["templates"][:top], 1):
        text = t["template"] if len(t["template"]) <= 49 else t["template"][:46] + "…"
        out.append(f"{k:>2}  {t['count']:>7}  {t['errors']:>5} err  {text}")
    if doc["anomalies"]:
        out += ["", "Anomalies"] + [f"  [{a['severity'].upper()}] {a['title']} · {a['timestamp']}" for a in doc["anomalies"][:5]]
    if seq := meta.get("precursorAnalysis"):
        found = doc["precursors"]
        out += ["", "Failure precursors (association in time, not cause)"]
        out.append(f"  {len(found):,} found · {seq['eventsRetained']:,}/{seq['eventsSeen']:,} timed events kept · {format_duration(seq['sequenceWindowMs'])} window")
        if not found:
            out.append("  (none reached support 2 and lift 1.25)")
        for p in found[: min(top, 10)]:
            out.append(f"  {p['service']}: {p['sourceTemplate']} → {p['failureTemplate']}")
            out.append(f"    {p['support']}/{p['occurrences']} ({number_text(p['supportPercent'])}%) · {number_text(p['lift'])}× lift · median {format_duration(p['medianGapMs'])}")
    out += ["", f"Analyzed in {format_duration(meta['durationMs'])} · redaction {'on' if meta['redactionEnabled'] else 'OFF'}"]
    return "\n".join(out) + "\n"


def write_atomic(path: str, text: str) -> None:
    """Write a file whole or not at all, readable by its owner only."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, prefix=os.path.basename(path) + ".tmp-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
