"""Queries of the log engine over the driver's tables, and the same in DuckDB SQL.

Log lines are made from ``events``: a third each NDJSON, logfmt and plain text, so that what
the parser recovers can be told from the columns.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.normalise import normalize_level, parse_latency, parse_timestamp
from .functions.scalars import cached
from .operators import aggregate, anomalies, precursors, templates
from .operators.parse import parse
from .operators.redact import redact, redact_text, redaction_counts
from .options import AnalyzeOptions
from .plans.report import analyze
from .sources.lines import DEMO_SOURCE, bound, demo_lines, lines_from, spread
from .storage import materialise

HOUR, DAY = 3_600_000, 86_400_000
YEAR = 2026
START_MS = 1_700_000_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_lines(spark: SparkSession, sf_dir: str, untimed: bool = False, by_user: bool = False, private: bool = False) -> DataFrame:
    """Lines of ``events``. ``untimed``: every seventh has no timestamp; ``by_user``: a service a
    user; ``private``: messages hold personal data and secrets of each kind in turn."""
    return spread(_events(spark, sf_dir).select(*_line(untimed, by_user, private)))


@cached
def _line(untimed: bool, by_user: bool, private: bool) -> list[Column]:
    n, kind = F.col("event_id"), F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "click", "debug").otherwise("info")
    service = F.concat(F.lit("user-"), F.col("user_id")) if by_user else F.concat(F.lit("svc-"), F.col("user_id") % 5)
    micro = F.floor(F.col("value") * 1000000).cast("long")
    took = F.concat(F.floor(micro / 1000000), F.lit("."), F.lpad((micro % 1000000).cast("string"), 6, "0"))
    message = (
        F.when(kind == "view", F.concat_ws(" ", F.lit("page"), n, F.lit("rendered"))).when(kind == "click", F.concat_ws(" ", F.lit("button"), n, F.lit("pressed")))
        .when(kind == "purchase", F.concat(F.lit("order "), n, F.lit(" placed by cust-"), F.col("user_id") % 7)).when(kind == "signup", F.concat_ws(" ", F.lit("account"), n, F.lit("created")))
        .otherwise(F.concat_ws(" ", F.lit("request"), n, F.lit("failed")))
    )
    if private:
        kinds = [
            F.concat(F.lit("mail user"), n, F.lit("@example.org sent")), F.concat(F.lit("from 10.0."), n % 200, F.lit(".7 seen")), F.concat(F.lit("set password=hunter"), n, F.lit(" now")),
            F.concat(F.lit("read /home/u"), n, F.lit("/notes.txt done")), F.concat(F.lit("key AKIA"), F.lpad(n.cast("string"), 16, "0"), F.lit(" used")), F.lit("peer 2001:db8::1 joined"),
            F.concat(F.lit("auth Bearer abcdefgh"), n, F.lit(" ok")), F.concat(F.lit("jwt eyJabcdefgh.abcdefgh.sig"), n, F.lit(" ok")), F.concat(F.lit("gh ghp_"), F.lpad(n.cast("string"), 20, "a"), F.lit(" ok")), F.lit("nothing here"),
        ]
        message = F.element_at(F.array(*kinds), (n % 10 + 1).cast("int"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if untimed:
        stamp = F.when(n % 7 != 3, stamp)
    q = F.lit('"')
    ndjson = F.concat(F.lit("{"), F.when(stamp.isNotNull(), F.concat(F.lit('"timestamp":"'), stamp, F.lit('",'))).otherwise(""), F.lit('"level":"'), level, F.lit('","service":{"name":"'), service, F.lit('"},"message":"'), message, F.lit('","duration_ms":'), took, F.lit("}"))
    logfmt = F.concat(F.when(stamp.isNotNull(), F.concat(F.lit("time="), stamp, F.lit(" "))).otherwise(""), F.lit("level="), level, F.lit(" service="), service, F.lit(" duration="), took, F.lit("ms msg="), q, message, q)
    plain = F.concat(F.when(stamp.isNotNull(), F.concat(stamp, F.lit(" "))).otherwise(""), F.upper(level), F.lit(" ["), service, F.lit("] "), message, F.lit(" latency="), took, F.lit("ms"))
    text = F.when(n % 3 == 0, ndjson).when(n % 3 == 1, logfmt).otherwise(plain)
    return [n.alias("seq"), text.alias("text"), F.lit(False).alias("truncated")]


def _parsed(spark, sf_dir, isolated: bool = True, **kw) -> DataFrame:
    return parse(log_lines(spark, sf_dir, **kw), YEAR, isolated)


#: The tail that plain lines keep in their message.
_TAIL = r" latency=[0-9.]+ms$"


def _structured(spark, sf_dir, **kw) -> DataFrame:
    """Events of NDJSON and logfmt lines and, with their latency tail cut off, of plain ones."""
    df = _parsed(spark, sf_dir, **kw)
    return df.withColumn("message", F.regexp_replace("message", _TAIL, ""))


def _assigned(spark, sf_dir, **kw) -> DataFrame:
    events = _structured(spark, sf_dir, **kw).select("seq", "ts_ms", "level", "service", "message", "duration_ms")
    # the events are read for their distinct token lists and again for the join
    return templates.assign_templates(materialise(events))


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_ms", F.col("ts_ms"))


def _of_format(name: str):
    def query(spark, sf_dir):
        return _parsed(spark, sf_dir).filter(F.col("format") == name).select("seq", "format", "malformed", "ts_ms", "level", "service", "message", "duration_ms")

    return query


def _counts(column: str):
    return lambda spark, sf_dir: aggregate.counts_by(_parsed(spark, sf_dir, isolated=False), column)


def summary_row(spark, sf_dir):
    return aggregate.summary(_parsed(spark, sf_dir, untimed=True))


def timeline(spark, sf_dir):
    return aggregate.timeline(_timed(_parsed(spark, sf_dir)), HOUR)


def latency_summary(spark, sf_dir):
    return aggregate.latency_summary(_parsed(spark, sf_dir))


def timestamp_carry_forward(spark, sf_dir):
    events = _parsed(spark, sf_dir, untimed=True).select("seq", "ts_ms")
    return aggregate.carry_forward(events, START_MS).select("seq", "ts_ms", "event_ms")


def redaction_by_rule(spark, sf_dir):
    return redaction_counts(redact(_parsed(spark, sf_dir, private=True)))


def redacted_messages(spark, sf_dir):
    return redact(_structured(spark, sf_dir, private=True)).select("seq", "message")


def redact_documents(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    hits = redact_text(docs, "text")
    count = lambda n: F.coalesce(F.element_at("redactions", n), F.lit(0)).alias(n.lower())
    return hits.select("doc_id", count("EMAIL"), count("SECRET"))


def document_lines(spark, sf_dir):
    """Documents as log lines, bounded to 1000 bytes each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = bound(docs.select(F.struct("doc_id", "line").alias("seq"), "text", F.lit(False).alias("truncated")), 1000)
    return lines.groupBy("seq.doc_id").agg(F.count("*").alias("lines"), F.count_if("truncated").alias("truncated"))


def token_normalise(spark, sf_dir):
    return _structured(spark, sf_dir).select("seq", F.array_join(templates.tokens_of(F.col("message")), " ").alias("tokens"))


def template_summary(spark, sf_dir):
    return templates.template_summary(_assigned(spark, sf_dir))


def _template_by(column: str):
    return lambda spark, sf_dir: templates.template_counts(_assigned(spark, sf_dir), column)


def template_timeline(spark, sf_dir):
    df = _assigned(spark, sf_dir)
    return df.groupBy("template_id", (F.floor(F.col("ts_ms") / DAY) * DAY).cast("long").alias("bucket_ms")).agg(F.count("*").alias("count"))


def template_samples(spark, sf_dir):
    return templates.sample_messages(_assigned(spark, sf_dir)).select("template_id", F.array_join("samples", "|").alias("samples"))


def top_templates(spark, sf_dir):
    return templates.template_summary(_assigned(spark, sf_dir)).select("template_id", "count").limit(3)


def template_search(spark, sf_dir):
    a = materialise(_assigned(spark, sf_dir))
    item = F.struct("name", "count", "percent")
    df = templates.template_summary(a).join(templates.sample_messages(a), "template_id")
    for by in ("level", "service"):
        df = df.join(templates.template_counts(a, by).groupBy("template_id").agg(F.collect_list(item).alias(f"{by}s")), "template_id")
    return templates.search_templates(df, text="ED", level="info", service="svc-1").select("template_id", "count", "errors")


_ANOMALY = ("id", "type", "severity", "title", "detail", "timestamp", "observed", "expected", "score", "template_id")


def bucket_anomalies(spark, sf_dir):
    return anomalies.bucket_anomalies(materialise(timeline(spark, sf_dir))).select(*_ANOMALY)


def _bursty(spark, sf_dir) -> DataFrame:
    """Template assignments by construction, for counts by day."""
    return materialise(_assigned(spark, sf_dir)).withColumn("event_ms", F.col("ts_ms"))


def frequency_spikes(spark, sf_dir):
    a = _bursty(spark, sf_dir)
    return anomalies.frequency_anomalies(a, aggregate.timeline(a, HOUR), HOUR).select("id", "type", "severity", "timestamp", "observed", "expected", "score", "template_id")


def all_anomalies(spark, sf_dir):
    a = _bursty(spark, sf_dir)
    found = anomalies.detect(a, aggregate.timeline(a, HOUR), HOUR)
    return found.select("id", "type", "severity", "timestamp", "observed", "expected", "score")


def _sequence(spark, sf_dir) -> DataFrame:
    return materialise(precursors.sequence(_assigned(spark, sf_dir, by_user=True), None))


def next_failure(spark, sf_dir):
    return precursors.next_failures(_sequence(spark, sf_dir), DAY)


def failure_precursors(spark, sf_dir):
    return precursors.find_precursors(_sequence(spark, sf_dir), None, DAY).drop("source_template", "failure_template")


def first_events(spark, sf_dir):
    return precursors.sequence(_assigned(spark, sf_dir), 100).select("seq", "ts_ms", "service", "failure")


def _demo(spark):
    return analyze(spark, demo_lines(spark), AnalyzeOptions(source=DEMO_SOURCE, precursors=True, now=datetime(2026, 7, 20, tzinfo=timezone.utc)))


def demo_timeline(spark, sf_dir):
    return _demo(spark).timeline.select("timestamp", "count", "errors", "error_rate", "latency_p95_ms")


def demo_templates(spark, sf_dir):
    return _demo(spark).template_summary.select("template_id", "template", "count", "percent", "errors")


def demo_anomalies(spark, sf_dir):
    return _demo(spark).anomalies.select("id", "type", "severity", "timestamp", "observed", "expected", "score")


def demo_precursors(spark, sf_dir):
    return _demo(spark).precursors.select("service", "source_template_id", "failure_template_id", "occurrences", "support", "support_percent", "lift", "median_gap_ms")


_VALUES = ["1.25s", "250 us", "3ns", "12", "7 secs", "-1", "abc", "INFO", "Warning", "35", "5", "1721376000", "1721376000500", "2026-07-19", "2026-07-19T08:00:00+02:00", "Sun, 19 Jul 2026 08:00:00 GMT", "Jul 19 08:00:01", "2026-07-19 08:00:00.1239Z"]


def normalisers(spark, sf_dir):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(_VALUES)], "k int, v string")
    return df.select("k", parse_latency(F.col("v")).alias("latency_ms"), normalize_level(F.col("v")).alias("level"), parse_timestamp(F.col("v"), YEAR).alias("ts_ms"))


_MALFORMED = ["", "   ", "{broken", '["list"]', '{"level":"warn","msg":"one"} trailing', "msg='unterminated level=info", '{"token":"x","level":40}', "<ERROR> [pay/api] - lost", "level=info level=error msg=two"]


def malformed_lines(spark, sf_dir):
    return parse(lines_from(spark, _MALFORMED), YEAR).select("seq", "format", "malformed", "reason", "level", "service", "message")


QUERIES = {
    "parse_ndjson": _of_format("ndjson"), "parse_logfmt": _of_format("logfmt"), "parse_plain": _of_format("plain"),
    "level_counts": _counts("level"), "service_counts": _counts("service"), "format_counts": _counts("format"),
    "template_levels": _template_by("level"), "template_services": _template_by("service"),
    **{f.__name__: f for f in (
        summary_row, timeline, latency_summary, timestamp_carry_forward, redaction_by_rule, redacted_messages, redact_documents, document_lines, token_normalise, template_summary,
        template_timeline, template_samples, top_templates, template_search, bucket_anomalies, frequency_spikes, all_anomalies, next_failure, failure_precursors, first_events,
        demo_timeline, demo_templates, demo_anomalies, demo_precursors, normalisers, malformed_lines,
    )},
}


# ---- the same in DuckDB SQL


def _r(x: str, places: int) -> str:
    f = f"1e{places}"
    return f"(case when abs({x}) > 9007199254740991 / {f} then {x} else floor(({x} + 2.220446049250313e-16) * {f} + 0.5) / {f} end)"


def _pct(a: str, b: str) -> str:
    return f"(case when {b} = 0 then 0.0 else {_r(f'{a} / ({b})::double * 100', 2)} end)"


def _base(service: str = "'svc-' || (user_id % 5)", untimed: bool = False) -> str:
    stamp = "case when event_id % 7 <> 3 then epoch_us(ts) // 1000 end" if untimed else "epoch_us(ts) // 1000"
    return f"""e as (select event_id seq, {stamp} ts_ms, event_type, {service} service, floor(value * 1000000) / 1000000.0 duration_ms,
    case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'click' then 'debug' else 'info' end as level,
    case event_type when 'view' then 'page ' || event_id || ' rendered' when 'click' then 'button ' || event_id || ' pressed' when 'purchase' then 'order ' || event_id || ' placed by cust-' || (user_id % 7)
        when 'signup' then 'account ' || event_id || ' created' else 'request ' || event_id || ' failed' end as message,
    case event_type when 'view' then 'page <num> rendered' when 'click' then 'button <num> pressed' when 'purchase' then 'order <num> placed by cust-' || (user_id % 7)
        when 'signup' then 'account <num> created' else 'request <num> failed' end as tokens,
    case event_id % 3 when 0 then 'ndjson' when 1 then 'logfmt' else 'plain' end as format from events),
f as (select event_type, arg_min(tokens, seq) first_tokens, count(distinct tokens) kinds from e group by 1),
a as (select e.*, 'tpl_' || left(sha1(first_tokens), 10) template_id, case when kinds > 1 then 'order <num> placed by <*>' else first_tokens end template from e join f using (event_type))"""


_ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _tl(size: int) -> str:
    """Timeline; the quantile is below + (above - below) * fraction, term by term."""
    p95 = _r("v[floor(pos)::bigint + 1] + (v[ceil(pos)::bigint + 1] - v[floor(pos)::bigint + 1]) * (pos - floor(pos))", 3)
    per = f"select (ts_ms // {size}) * {size} bucket_ms, count(*) n, count(*) filter (level in ('error', 'fatal')) errors, list_sort(list(duration_ms)) v, (count(*) - 1) * 0.95::double pos from e group by 1"
    return f"t as (select bucket_ms, n, errors, {p95} p95 from ({per}))"


def _by(table: str, column: str) -> str:
    return f"select {column} as name, count(*) as count, {_pct('count(*)', f'(select count(*) from {table})')} as percent from {table} group by 1"


def _loo(kind: str, series: str, key: str, least: float, factor: float, floor: float, gate: str, places: str) -> str:
    """Leave-one-out anomalies of ``series`` (key, bucket_ms, x) by a self join."""
    score = "case when mad > 0 then (x - m) / (1.4826 * mad) else (x - m) / sqrt(greatest(m, 1)) end"
    ratio = f"x / greatest(m, {floor})"
    tid = "coalesce(template_id, '')" if key == "template_id" else "''"
    return f"""select 'ano_' || left(sha1('{kind}:' || {_ISO.format('bucket_ms')} || ':' || {tid}), 10) as id, '{kind}' as type,
    case when score >= 10 or ratio >= 10 then 'critical' when score >= 6 or ratio >= 5 then 'high' else 'medium' end as severity, {_ISO.format('bucket_ms')} as timestamp,
    {places} as observed, {_r('m', 3)} as expected, {_r('score', 2)} as score, {'template_id' if key == 'template_id' else 'null::varchar'} as template_id, x, m
from (select *, {score} as score, {ratio} as ratio from (
    select p.{key}, p.bucket_ms, any_value(p.x) x, any_value(p.m) m, median(abs(q.x - p.m)) mad, count(*) others from (
        select p.{key}, p.bucket_ms, any_value(p.x) x, median(q.x) m from {series} p join {series} q on p.{key} = q.{key} and p.bucket_ms <> q.bucket_ms group by 1, 2) p
    join {series} q on p.{key} = q.{key} and p.bucket_ms <> q.bucket_ms group by 1, 2) where others >= 3)
where score >= {least} and ratio >= {factor} and {gate}"""


_BURST = _loo("error-burst", "(select 0 as one, bucket_ms, errors::double x from t)", "one", 3, 2, 0.5, "x >= 3", "x")
_SLOW = _loo("latency-spike", "(select 0 as one, bucket_ms, p95 x from t where p95 is not null)", "one", 3.5, 1.8, 0.001, "true", _r("x", 3))
_DENSE = "d as (select k.template_id, t.bucket_ms, coalesce(c.n, 0)::double x from (select template_id from a group by 1 having count(*) >= 5) k cross join t left join (select template_id, (ts_ms // {0}) * {0} bucket_ms, count(*) n from a group by 1, 2) c on c.template_id = k.template_id and c.bucket_ms = t.bucket_ms)"
_SPIKE = _loo("frequency-spike", "d", "template_id", 4, 3, 0.5, "x >= 5", "x")


def _num(x: str) -> str:
    return f"case when {x} = floor({x}) then ({x})::bigint::varchar else ({x})::varchar end"



_USER = _base("'user-' || user_id")
_NEXT = f"""s as (select seq, ts_ms, service, template_id, level = 'error' failure from a),
g as (select *, first_value(case when failure then ts_ms end ignore nulls) over w nts, first_value(case when failure then template_id end ignore nulls) over w nt from s
    window w as (partition by service order by ts_ms, seq rows between 1 following and unbounded following)),
h as (select seq, ts_ms, service, template_id, case when nts - ts_ms between 1 and {DAY} then nt end failure_template_id, case when nts - ts_ms between 1 and {DAY} then nts - ts_ms end gap_ms from g where not failure)"""


def _events_sql(select: str, *ctes: str, base: str | None = None) -> str:
    return "with " + ",\n".join([base or _base(), *ctes]) + "\n" + select


def _rows(columns: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) v({columns})"


_PRIVATE = "case event_id % 10 when 0 then 'EMAIL' when 1 then 'IP' when 2 then 'SECRET' when 3 then 'ABSOLUTE_PATH' when 4 then 'AWS_KEY' when 5 then 'IP' when 6 then 'BEARER' when 7 then 'JWT' when 8 then 'GITHUB_TOKEN' end"
_REDACTED = """case event_id % 10 when 0 then 'mail [REDACTED:EMAIL] sent' when 1 then 'from [REDACTED:IP] seen' when 2 then 'set password=[REDACTED:SECRET] now' when 3 then 'read [REDACTED:ABSOLUTE_PATH] done'
    when 4 then 'key [REDACTED:AWS_KEY] used' when 5 then 'peer [REDACTED:IP] joined' when 6 then 'auth [REDACTED:BEARER] ok' when 7 then 'jwt [REDACTED:JWT] ok' when 8 then 'gh [REDACTED:GITHUB_TOKEN] ok' else 'nothing here' end"""
_FORMAT = "select seq, format, false as malformed, ts_ms, level, service, message{} as message, duration_ms from e where format = '{}'"
_TAIL_SQL = " || ' latency=' || (floor(duration_ms * 1000000 + 0.5)::bigint // 1000000) || '.' || lpad((floor(duration_ms * 1000000 + 0.5)::bigint % 1000000)::varchar, 6, '0') || 'ms'"

SQL = {
    "parse_ndjson": _events_sql(_FORMAT.format("", "ndjson")),
    "parse_logfmt": _events_sql(_FORMAT.format("", "logfmt")),
    "parse_plain": _events_sql(_FORMAT.format(_TAIL_SQL, "plain")),
    "level_counts": _events_sql(_by("e", "level")),
    "service_counts": _events_sql(_by("e", "service")),
    "format_counts": _events_sql(_by("e", "format")),
    "summary_row": _events_sql(f"""select count(*) as events, 0::bigint as malformed, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warn') as warnings, count(*) filter (ts_ms is null) as missing_timestamps,
        count(distinct service) as services, min(ts_ms) as first_seen_ms, max(ts_ms) as last_seen_ms, {_pct("count(*) filter (level = 'error')", 'count(*)')} as error_rate from e""", base=_base(untimed=True)),
    "timeline": _events_sql(f"select bucket_ms, {_ISO.format('bucket_ms')} as timestamp, n as count, errors, {_pct('errors', 'n')} as error_rate, p95 as latency_p95_ms from t", _tl(HOUR)),
    "latency_summary": _events_sql(f"select count(duration_ms) as count, {_r('min(duration_ms)', 3)} as min_ms, {_r('max(duration_ms)', 3)} as max_ms, {_r('avg(duration_ms)', 3)} as mean_ms, {_r('quantile_cont(duration_ms, 0.5)', 3)} as p50_ms, {_r('quantile_cont(duration_ms, 0.95)', 3)} as p95_ms, {_r('quantile_cont(duration_ms, 0.99)', 3)} as p99_ms, false as approximate from e"),
    "timestamp_carry_forward": _events_sql(f"select seq, ts_ms, coalesce(last_value(ts_ms ignore nulls) over (order by seq rows between unbounded preceding and current row), {START_MS}) as event_ms from e", base=_base(untimed=True)),
    "redaction_by_rule": f"select name, count(*) as count, {_pct('count(*)', '(select count(*) from events where event_id % 10 <> 9)')} as percent from (select {_PRIVATE} name from events) where name is not null group by 1",
    "redacted_messages": f"select event_id as seq, {_REDACTED} as message from events",
    "redact_documents": r"""select doc_id, len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'))::int as email,
        len(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|token|secret|password|passwd|pwd|client[_-]?secret|aws[_-]?secret[_-]?access[_-]?key)["'']?\s*[=:]\s*["'']?[^\s,"'']{4,}'))::int as secret from documents""",
    "document_lines": "with l as (select doc_id, unnest(string_split(text, chr(10))) x from documents) select doc_id, count(*) as lines, count(*) filter (octet_length(encode(x)) > 1000) as truncated from l group by 1",
    "token_normalise": _events_sql("select seq, tokens from e"),
    "template_summary": _events_sql(f"select template_id, template, count(*) as count, {_pct('count(*)', '(select count(*) from a)')} as percent, count(*) filter (level = 'error') as errors, min(ts_ms) as first_seen_ms, max(ts_ms) as last_seen_ms from a group by 1, 2"),
    **{f"template_{by}s": _events_sql(f"select template_id, {by} as name, count(*) as count, {_pct('count(*)', 'any_value(n)')} as percent from (select *, count(*) over (partition by template_id) n from a) group by 1, 2") for by in ("level", "service")},
    "template_timeline": _events_sql(f"select template_id, (ts_ms // {DAY}) * {DAY} as bucket_ms, count(*) as count from a group by 1, 2"),
    "template_samples": _events_sql("select template_id, string_agg(message, '|' order by seq) as samples from (select *, row_number() over (partition by template_id order by seq) k from a) where k <= 3 group by 1"),
    "top_templates": _events_sql("select template_id, count(*) as count from a group by 1 order by 2 desc, 1 limit 3"),
    "template_search": _events_sql("select template_id, count(*) as count, count(*) filter (level = 'error') as errors from a group by 1 having bool_or(level = 'info') and bool_or(service = 'svc-1') and bool_or(contains(lower(template), 'ed'))"),
    "bucket_anomalies": _events_sql(f"""select id, type, severity, 'Error burst detected' as title, {_num('x')} || ' errors landed in this bucket; the robust baseline is ' || {_num(_r('m', 1))} || '.' as detail, timestamp, observed, expected, score, template_id from b
        union all select id, type, severity, 'Latency regression detected', 'Bucket p95 reached ' || {_num(_r('x', 2))} || ' ms versus a ' || {_num(_r('m', 2))} || ' ms baseline.', timestamp, observed, expected, score, template_id from l""", _tl(HOUR), f"b as ({_BURST})", f"l as ({_SLOW})"),
    "frequency_spikes": _events_sql("select id, type, severity, timestamp, observed, expected, score, template_id from s", _tl(HOUR), _DENSE.format(HOUR), f"s as ({_SPIKE})"),
    "all_anomalies": _events_sql("select id, type, severity, timestamp, observed, expected, score from (select * from b union all select * from l union all select * from s)", _tl(HOUR), _DENSE.format(HOUR), f"b as ({_BURST})", f"l as ({_SLOW})", f"s as ({_SPIKE})"),
    "next_failure": _events_sql("select * from h", _NEXT, base=_USER),
    "failure_precursors": _events_sql(f"""select service, template_id as source_template_id, failure_template_id, occurrences, n as support, {_pct('n', 'occurrences')} as support_percent, {_r('lift', 3)} as lift, {_r('gap', 3)} as median_gap_ms
        from (select *, (n / occurrences::double) / (baseline / total::double) lift from (select *, sum(n) over (partition by service, template_id)::bigint occurrences, sum(n) over (partition by service, failure_template_id)::bigint baseline, sum(n) over (partition by service)::bigint total
            from (select service, template_id, failure_template_id, count(*) n, median(gap_ms) gap from h group by 1, 2, 3))) where failure_template_id is not null and n >= 2 and lift >= 1.25""", _NEXT, base=_USER),
    "first_events": _events_sql("select seq, ts_ms, service, level = 'error' as failure from e order by seq limit 100"),
    "demo_timeline": _rows("timestamp, count, errors, error_rate, latency_p95_ms", *[f"('2026-07-19T08:0{k}:00.000Z', {n}::bigint, {e}::bigint, {p}::double, {q}::double)" for k, (n, e, p, q) in enumerate([(3, 0, 0, 114.4), (3, 0, 0, 120.5), (3, 0, 0, 126.6), (3, 0, 0, 132.7), (7, 6, 85.71, 2461)])]),
    "demo_templates": _rows("template_id, template, count, percent, errors", "('tpl_19c35e1d18', 'payment attempt <num> failed; retry scheduled', 6::bigint, 31.58::double, 6::bigint)", "('tpl_26932fc5d2', 'inventory reservation <num> confirmed', 4, 21.05, 0)", "('tpl_2b6b83239c', 'checkout request <num> completed for <*>', 4, 21.05, 0)", "('tpl_de195c1e76', 'processor connection <num> degraded; fallback queued', 4, 21.05, 0)", "('tpl_cb0d0331b8', 'health probe completed', 1, 5.26, 0)"),
    "demo_anomalies": _rows("id, type, severity, timestamp, observed, expected, score", "('ano_c5e00a86c2', 'latency-spike', 'critical', '2026-07-19T08:04:00.000Z', 2461::double, 123.55::double, 258.46::double)", "('ano_afeb16c0d9', 'error-burst', 'critical', '2026-07-19T08:04:00.000Z', 6, 0, 6)"),
    "demo_precursors": _rows("service, source_template_id, failure_template_id, occurrences, support, support_percent, lift, median_gap_ms", "('payments', 'tpl_de195c1e76', 'tpl_19c35e1d18', 4::bigint, 4::bigint, 100::double, 1.25::double, 114000::double)"),
    "normalisers": _rows("k, latency_ms, level, ts_ms", "(0::int, 1250::double, 'unknown', null::bigint)", "(1, 0.25, 'unknown', null)", "(2, 0.000003, 'unknown', null)", "(3, 12, 'trace', null)", "(4, 7000, 'unknown', null)", "(5, null, 'unknown', null)", "(6, null, 'unknown', null)", "(7, null, 'info', null)", "(8, null, 'warn', null)", "(9, 35, 'info', null)", "(10, 5, 'unknown', null)",
        "(11, 1721376000, 'fatal', 1721376000000)", "(12, 1721376000500, 'fatal', 1721376000500)", "(13, null, 'unknown', 1784419200000)", "(14, null, 'unknown', 1784440800000)", "(15, null, 'unknown', 1784448000000)", "(16, null, 'unknown', 1784448001000)", "(17, null, 'unknown', 1784448000123)"),
    "malformed_lines": _rows("seq, format, malformed, reason, level, service, message", "(2::bigint, 'plain', true, 'Invalid JSON object', 'unknown', 'unknown', '{broken')", """(3, 'plain', true, 'JSON value is not an object', 'unknown', 'unknown', '["list"]')""", """(4, 'plain', true, 'Invalid JSON object', 'warn', 'unknown', '{"level":"warn","msg":"one"} trailing')""", "(5, 'plain', false, null, 'info', 'unknown', 'msg=''unterminated level=info')",
        "(6, 'ndjson', false, null, 'warn', 'unknown', '(no message)')", "(7, 'plain', false, null, 'error', 'pay/api', 'lost')", "(8, 'logfmt', false, null, 'error', 'unknown', 'two')"),
}
