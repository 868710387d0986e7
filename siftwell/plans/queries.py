"""Registered queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import prepare
from siftwell.functions import text as fn
from siftwell.operators import outcome, redaction
from siftwell.operators.policy import SWITCHES, Policy
from siftwell.operators.registry import BY_ID, RULES, Rule
from siftwell.operators.scan import by_severity, findings, groups, scan, summaries
from siftwell.plans import oracle
from siftwell.plans.carriers import EXPORT, EXPORT_ID, EXPORT_ROW, FILE_ID, carrier_sql, prefix_length
from siftwell.plans.samples import MAKERS
from siftwell.sources import images
from siftwell.sources.files import extracted
from siftwell.streaming.alerts import watch, windowed_alerts


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def _carriers(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return _t(spark, sf, "customer").select("c_custkey", F.expr(text).alias("text"))


def rule_query(rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    """One rule's findings; the rules of prose go together."""
    prose = {"person_name", "postal_address"}
    rules = tuple(BY_ID[i] for i in sorted(prose)) if rule.id in prose else (rule,)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        policy = Policy.only(*rules, prose=rule.id in prose, injection=rule.id == "prompt_injection")
        found = findings(_carriers(spark, sf, carrier_sql(rule)), "c_custkey", policy=policy)
        return found.where(F.col("rule_id") == rule.id).select("c_custkey", "start", "match", "preview", "fingerprint")

    return run


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", "text")


def found(spark: SparkSession, sf: str) -> DataFrame:
    return findings(_docs(spark, sf), "doc_id")


def doc_findings(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select("doc_id", "rule_id", "start", "match", "preview", "fingerprint")


def findings_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def verdict_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return scan(_docs(spark, sf)).select("doc_id", "verdict", F.size("findings").cast("long").alias("n"))


def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    """What each text's scan says of itself: findings, tables, faults of rules, what a bound left out."""
    out = scan(_docs(spark, sf))
    return out.select("doc_id", F.size("findings").cast("long").alias("n"), F.col("table").isNotNull().alias("is_table"), F.size("errors").cast("long").alias("errors"), F.size("capped").cast("long").alias("capped"), "skipped")


def alarm_rate_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    v = scan(_t(spark, sf, "documents").select("lang", "text")).select("lang", (F.col("verdict") != "clean").cast("long").alias("alarm"))
    return v.groupBy("lang").agg(F.sum("alarm").alias("alarms"), F.count("*").alias("docs"))


def grouped_findings(spark: SparkSession, sf: str) -> DataFrame:
    return groups(found(spark, sf), "doc_id")


def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return by_severity(found(spark, sf), "doc_id")


def doc_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(found(spark, sf), "doc_id")


def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select("doc_id", "rule_id", "start", F.col("line").cast("long").alias("line"))


def exposure_score(spark: SparkSession, sf: str) -> DataFrame:
    return outcome.exposure(found(spark, sf), "doc_id").select("doc_id", "score", "band", "headline")


def regimes_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return outcome.regimes(found(spark, sf), "doc_id").drop("refs")


def reused_values(spark: SparkSession, sf: str) -> DataFrame:
    f = found(spark, sf).groupBy("fingerprint", "rule_id").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
    return f.where("docs > 1")


def rule_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return outcome.breakdown(found(spark, sf))


def redacted_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = redaction.redact(_docs(spark, sf))
    return docs.where("changed > 0").select("doc_id", F.col("changed").cast("long").alias("changed"), F.sha2("redacted", 256).alias("digest"))


def redacted_rescan(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted texts, scanned again."""
    docs = redaction.redact(_docs(spark, sf)).where("changed > 0").select("doc_id", F.col("redacted").alias("text"))
    return scan(docs).select("doc_id", "verdict", F.size("findings").cast("long").alias("n"))


def restored_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with pseudonyms, and back: the digest of the text and that of the original are the same."""
    docs = redaction.restored(redaction.redact(_docs(spark, sf), style="pseudonym", reversible=True).where("changed > 0"))
    return docs.select("doc_id", F.sha2("restored", 256).alias("digest"))


def rollup_lang_source(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source")
    return found(spark, sf).select("doc_id", "rule_id").join(d, "doc_id").rollup("lang", "rule_id").agg(F.count("*").alias("n"))


def conversation_values(spark: SparkSession, sf: str) -> DataFrame:
    return watch(_t(spark, sf, "conversations"), Policy()).select("conv_id", "rule_id", "fingerprint")


def _exports(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated exports of a few customers each."""
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", F.expr(EXPORT_ROW).alias("line"))))
    text = F.concat_ws("\n", F.lit(EXPORT), F.transform(rows, lambda r: r["line"]))
    return _t(spark, sf, "customer").groupBy(F.expr(EXPORT_ID).alias("export_id")).agg(text.alias("text"))


def export_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What the scan says of exports: rows, columns, personal columns, and whether all values can be replaced."""
    out = scan(_exports(spark, sf)).where("table is not null")
    return out.select("export_id", "verdict", "table.rows", F.array_join("table.kinds", ",").alias("kinds"), "table.severity", "table.layout", "table.personal_values", "table.fully_redactable", F.size("findings").cast("long").alias("n"))


def export_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Score and regimes of exports, with their volume."""
    out = scan(_exports(spark, sf)).where("table is not null")
    found_ = out.select("export_id", F.explode("findings").alias("f")).select("export_id", "f.*")
    tables = out.select("export_id", "table.rows", F.size("table.kinds").alias("columns"))
    score = outcome.exposure(found_, "export_id", tables).select("export_id", "score", "band")
    names = outcome.regimes(found_, "export_id", tables).groupBy("export_id").agg(F.array_join(F.array_sort(F.collect_set("regime")), ",").alias("regimes"))
    return score.join(names, "export_id")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each kind, with a line for each of a hundred customers."""
    line = F.concat_ws(" ", F.col("c_custkey").cast("string"), F.col("c_name"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.org")))
    lines = _t(spark, sf, "customer").groupBy(F.expr(FILE_ID).alias("file_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]).alias("lines"))

    def run(batches):
        for b in batches:
            for file_id, made in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = list(MAKERS)
                yield pa.RecordBatch.from_pydict({"file_id": [file_id] * len(names), "made": names, "content": [MAKERS[n](made) for n in names]}, pa.schema([("file_id", pa.int64()), ("made", pa.string()), ("content", pa.binary())]))

    return lines.mapInArrow(run, "file_id long, made string, content binary")


def extracted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, status and text of files of eight kinds."""
    return extracted(_files(spark, sf)).select("file_id", "made", "kind", "status", F.sha2("text", 256).alias("digest"))


def findings_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of e-mail in the files' texts."""
    texts = extracted(_files(spark, sf)).withColumn("file", F.concat_ws("/", F.col("file_id").cast("string"), "made"))
    found_ = findings(texts, "file", policy=Policy(tables=False)).where("rule_id = 'email'")
    return found_.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("match").alias("n_distinct"))


def stripped_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Images without their texts: nothing is left to read, and the file is shorter by what went."""
    strip_ = F.pandas_udf(lambda s: s.map(lambda b: images.strip(bytes(b))), "binary")
    pictures = _files(spark, sf).where("made = 'png'").select("file_id", F.length("content").alias("before"), strip_("content").alias("content"))
    left = pictures.withColumn("after", F.length("content"))
    return extracted(left).select("file_id", (F.col("before") - F.col("after")).cast("long").alias("gone"), "status", F.size("meta").cast("long").alias("n_meta"))


#: Encodings that both engines have, as SQL of a key's text.
HIDDEN = {"Base64": "base64(CAST({0} AS BINARY))", "hexadecimal": "lower(hex({0}))"}
HIDDEN_DUCK = {"Base64": "base64(encode({0}))", "hexadecimal": "lower(hex(encode({0})))"}
KEY = "concat('key=AKIAABCD2345', substr(translate(upper(md5(CAST(c_custkey AS STRING))), '0189', 'QRST'), 1, 8), ' in use')"


def decoded_values(spark: SparkSession, sf: str) -> DataFrame:
    """Keys hidden by an encoding, at the encoded run's place."""
    out = [
        findings(_carriers(spark, sf, f"concat('note for ', c_name, ': ', {sql.format(KEY)})"), "c_custkey").select("c_custkey", "rule_id", "start", "end", "encoded", "fingerprint")
        for sql in HIDDEN.values()
    ]
    return out[0].unionByName(out[1])


def codenames(spark: SparkSession, sf: str) -> DataFrame:
    texts = _carriers(spark, sf, "concat('about ', CASE WHEN c_custkey % 2 = 0 THEN 'BlueBird' ELSE 'bluebirds' END, ' and ', c_name)")
    policy = Policy(rules=(), codenames=("bluebird", "ab"), **dict.fromkeys(SWITCHES, False))
    return findings(texts, "c_custkey", policy=policy).select("c_custkey", "rule_id", "severity", "advisory", "start", "match")


def page_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Values of link and image attributes, where text hides from the eye."""
    pages = _t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?:href|src|alt|title|data-[a-z0-9-]+)="([^"]{1,500})"'), F.lit(1))).alias("value"))
    return pages.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


def shape_profile(spark: SparkSession, sf: str) -> DataFrame:
    longest = lambda p: F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), F.length)), F.lit(0)).cast("long")
    return _t(spark, sf, "documents").select("doc_id", longest("[A-Z]+").alias("upper_run"), longest("[A-Za-z0-9]+").alias("alnum_run"), longest("[A-Za-z0-9+/]+").alias("base64_run"))


def rule_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark).createDataFrame([(r.id, r.category, r.severity, r.confidence, r.tier) for r in RULES], "rule_id string, category string, severity string, confidence string, tier string")


def events_windowed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_alerts(_t(spark, sf, "events"), 90.0).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


#: Numbers made from keys, of the length that a check wants.
NUMBERS = {"card": "concat('4', lpad(CAST(c_custkey * 104729 AS STRING), 15, '0'))", "cpf": "lpad(CAST(c_custkey * 7919 AS STRING), 11, '0')", "cnpj": "lpad(CAST(c_custkey * 104729 AS STRING), 14, '0')", "abn": "lpad(CAST(c_custkey * 7919 AS STRING), 11, '5')",
           "tfn": "lpad(CAST(c_custkey * 31 AS STRING), 9, '1')", "sin": "lpad(CAST(c_custkey * 31 AS STRING), 9, '1')", "imei": "lpad(CAST(c_custkey * 104729 AS STRING), 15, '4')", "aadhaar": "concat('2', lpad(CAST(c_custkey * 7919 AS STRING), 11, '3'))"}


def check_digits(spark: SparkSession, sf: str) -> DataFrame:
    """Checks as columns, over whole tables."""
    values = _t(spark, sf, "customer").select("c_custkey", *(F.expr(v).alias(k) for k, v in NUMBERS.items()))
    checked = {"card": fn.luhn, "cpf": fn.cpf, "cnpj": fn.cnpj, "abn": fn.abn, "tfn": fn.tfn, "sin": fn.sin, "imei": fn.imei, "aadhaar": fn.aadhaar}
    return values.select("c_custkey", *(check(F.col(k)).alias(f"{k}_valid") for k, check in checked.items()), fn.card_issuer(F.col("card")).alias("issuer"))


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The newest events that a log of fixed size keeps."""
    events = _t(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_id", "event_type")
    return outcome.log_of(events)


def part_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", F.round(fn.entropy(F.col("p_name")), 6).alias("bits"))


FOUND = oracle.found_sql()
MATCH = chr(34) + "match" + chr(34)
#: Placeholders numbered by first appearance within text and rule, and the pieces of text between them.
SPLICED = f"""SELECT doc_id, count(*) AS changed, concat(string_agg(concat(substr(text, before + 1, (start - before)::BIGINT), '<', upper(rule_id), '_', nth, '>'), '' ORDER BY start), substr(any_value(text), (max(start + length(m)) + 1)::BIGINT)) AS redacted
  FROM (SELECT doc_id, rule_id, start, m, text, nth, coalesce(lag(start + length(m)) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before
        FROM (SELECT doc_id, rule_id, start, {MATCH} AS m, min(start) OVER (PARTITION BY doc_id, rule_id, {MATCH}) AS first FROM ({FOUND})) f
        JOIN (SELECT doc_id, rule_id, first, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY first) AS nth FROM (SELECT DISTINCT doc_id, rule_id, min(start) OVER (PARTITION BY doc_id, rule_id, {MATCH}) AS first FROM ({FOUND}))) USING (doc_id, rule_id, first)
        JOIN documents USING (doc_id)) GROUP BY doc_id"""
POINTS = "CASE rule_id WHEN 'payment_card' THEN 34.0::DOUBLE ELSE 2.0::DOUBLE END * (1 + least(0.6::DOUBLE, 0.18::DOUBLE * log2(n)))"
#: An export's rows are personal records: a name by its header, an address by its header; 2 values a row.
EXPORTED = f"SELECT {EXPORT_ID} AS export_id, count(*) AS rows FROM customer GROUP BY export_id HAVING count(*) >= 3"
#: The lines of a file.
LINES = f"SELECT {FILE_ID} AS file_id, list(concat(c_custkey, ' ', c_name, ' u', c_custkey, '@mail.org') ORDER BY c_custkey) AS lines FROM customer GROUP BY ALL"
GRADE = "CASE WHEN rows >= 100 THEN 'critical' WHEN rows >= 20 THEN 'high' ELSE 'medium' END"
SQL = {
    "doc_findings": f"SELECT doc_id, rule_id, start, {MATCH}, {oracle.mask(MATCH)} AS preview, {oracle.fingerprint(MATCH)} AS fingerprint FROM ({FOUND})",
    "findings_by_rule": f"SELECT rule_id, severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({FOUND}) GROUP BY ALL",
    "verdict_per_doc": f"SELECT doc_id, CASE WHEN grave THEN 'block' ELSE 'clean' END AS verdict, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, bool_or(rule_id = 'payment_card') AS grave FROM ({FOUND}) GROUP BY doc_id) USING (doc_id)",
    "scan_report": f"SELECT doc_id, coalesce(n, 0) AS n, FALSE AS is_table, 0::BIGINT AS errors, 0::BIGINT AS capped, 0::BIGINT AS skipped FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({FOUND}) GROUP BY doc_id) USING (doc_id)",
    "alarm_rate_by_lang": f"SELECT lang, count(f.doc_id) AS alarms, count(*) AS docs FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM ({FOUND}) WHERE rule_id = 'payment_card') f USING (doc_id) GROUP BY lang",
    "grouped_findings": f"SELECT doc_id, rule_id, severity, count(*) AS occurrences, min(start) AS first_start, arg_min({oracle.mask(MATCH)}, start) AS preview FROM ({FOUND}) GROUP BY ALL",
    "severity_counts": f"SELECT doc_id, count(*) FILTER (rule_id = 'payment_card') AS critical, 0::BIGINT AS high, 0::BIGINT AS medium, count(*) FILTER (rule_id = 'email') AS low FROM ({FOUND}) GROUP BY doc_id",
    "doc_summaries": f"SELECT doc_id, string_agg(CASE WHEN n = 1 THEN label ELSE concat(n, '× ', label) END, ', ' ORDER BY first) AS summary FROM (SELECT doc_id, CASE rule_id WHEN 'email' THEN 'Email' ELSE 'Payment card' END AS label, count(*) AS n, min(start) AS first FROM ({FOUND}) GROUP BY ALL) GROUP BY doc_id",
    "line_numbers": f"SELECT doc_id, rule_id, start, 1 + length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) AS line FROM ({FOUND}) JOIN documents USING (doc_id)",
    "exposure_score": f"""SELECT doc_id, score, CASE WHEN score >= 70 THEN 'severe' WHEN score >= 40 THEN 'elevated' WHEN score >= 15 THEN 'low' ELSE 'minimal' END AS band, CASE WHEN len(top) = 1 THEN concat('Driven by ', top[1], '.') ELSE concat('Driven mainly by ', top[1], ' and ', top[2], '.') END AS headline FROM (
        SELECT doc_id, round(100 * (1 - exp(-sum({POINTS}) / 45)))::BIGINT AS score, list(concat(CASE WHEN n > 1 THEN concat(n, '× ') ELSE '' END, CASE rule_id WHEN 'email' THEN 'email' ELSE 'payment card' END) ORDER BY round({POINTS}) DESC) AS top
        FROM (SELECT doc_id, rule_id, count(*) AS n FROM ({FOUND}) GROUP BY ALL) GROUP BY doc_id)""",
    "regimes_per_doc": f"SELECT doc_id, regime, min(start) AS first_start FROM ({FOUND}) JOIN (VALUES ('payment_card', 'PCI DSS'), ('payment_card', 'GDPR'), ('email', 'GDPR'), ('email', 'DPDP')) v(r, regime) ON r = rule_id GROUP BY ALL",
    "reused_values": f"SELECT {oracle.fingerprint(MATCH)} AS fingerprint, rule_id, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM ({FOUND}) GROUP BY ALL HAVING count(DISTINCT doc_id) > 1",
    "rule_breakdown": f"SELECT rule_id, count(*) AS n, count(DISTINCT {MATCH}) AS secrets FROM ({FOUND}) GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 4",
    "redacted_docs": f"SELECT doc_id, changed, sha256(redacted) AS digest FROM ({SPLICED})",
    "redacted_rescan": f"SELECT DISTINCT doc_id, 'clean' AS verdict, 0::BIGINT AS n FROM ({FOUND})",
    "restored_docs": f"SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM ({FOUND}))",
    "rollup_lang_source": f"SELECT lang, rule_id, count(*) AS n FROM ({FOUND}) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, rule_id)",
    "conversation_values": f'SELECT DISTINCT conv_id, rule_id, {oracle.fingerprint(MATCH)} AS fingerprint FROM ({oracle.found_sql("conversations", "conv_id")})',
    "export_tables": f"SELECT export_id, CASE WHEN rows >= 100 THEN 'block' ELSE 'warn' END AS verdict, rows, 'name,email' AS kinds, {GRADE} AS severity, 'comma-separated' AS layout, 2 * rows AS personal_values, TRUE AS fully_redactable, 2 * rows AS n FROM ({EXPORTED})",
    "export_exposure": f"""SELECT export_id, score, CASE WHEN score >= 70 THEN 'severe' WHEN score >= 40 THEN 'elevated' WHEN score >= 15 THEN 'low' ELSE 'minimal' END AS band, 'DPDP,GDPR' AS regimes FROM (
        SELECT export_id, round(100 * (1 - exp(-(2.0::DOUBLE * grown + CASE WHEN rows >= 100 THEN 18.0::DOUBLE ELSE 8.0::DOUBLE END * 0.85::DOUBLE * grown + least(72::DOUBLE, (18 + 20 * log10(greatest(10, rows))) * 1.12::DOUBLE)) / 45)))::BIGINT AS score
        FROM (SELECT export_id, rows, 1 + least(0.6::DOUBLE, 0.18::DOUBLE * log2(rows)) AS grown FROM ({EXPORTED})))""",
    "extracted_files": f"""SELECT file_id, made, made AS kind, CASE WHEN made = 'png' THEN 'metadata' ELSE 'readable' END AS status, sha256(CASE made WHEN 'png' THEN concat('author: ', lines[1])
        WHEN 'xlsx' THEN replace(array_to_string(lines, chr(10)), ' ', ',') ELSE array_to_string(lines, chr(10)) END) AS digest FROM ({LINES}) CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in MAKERS)}) m(made)""",
    "findings_in_files": f"""SELECT concat(file_id, '/', made) AS file, CASE WHEN made = 'png' THEN 1 ELSE len(lines) END AS n, CASE WHEN made = 'png' THEN 1 ELSE len(lines) END AS n_distinct FROM ({LINES}) CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in MAKERS)}) m(made)""",
    "stripped_pictures": f"SELECT file_id, (12 + 7 + length(lines[1]))::BIGINT AS gone, 'opaque' AS status, 0::BIGINT AS n_meta FROM ({LINES})",
    "decoded_values": " UNION ALL ".join(f"SELECT c_custkey, 'aws_access_key_id' AS rule_id, ({prefix_length()})::INT AS start, ({prefix_length()} + length({sql.format(KEY)}))::INT AS {chr(34)}end{chr(34)}, '{how}' AS encoded, {oracle.fingerprint(f'substr({KEY}, 5, 20)')} AS fingerprint FROM customer" for how, sql in HIDDEN_DUCK.items()),
    "codenames": """SELECT c_custkey, 'org_codename' AS rule_id, 'high' AS severity, TRUE AS advisory, 6::INT AS start, 'BlueBird' AS "match" FROM customer WHERE c_custkey % 2 = 0""",
    "page_attributes": """SELECT page_id, count(*) AS n, count(DISTINCT v) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src|alt|title|data-[a-z0-9-]+)="([^"]{1,500})"', 1)) AS v FROM pages) GROUP BY page_id""",
    "shape_profile": "SELECT doc_id, " + ", ".join(f"coalesce(list_max(list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x))), 0)::BIGINT AS {n}" for p, n in (("[A-Z]+", "upper_run"), ("[A-Za-z0-9]+", "alnum_run"), ("[A-Za-z0-9+/]+", "base64_run"))) + " FROM documents",
    "rule_catalogue": "SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.category}', '{r.severity}', '{r.confidence}', '{r.tier}')" for r in RULES) + ") t(rule_id, category, severity, confidence, tier)",
    "events_windowed_alerts": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events WHERE value >= 90 GROUP BY ALL",
    "check_digits": f"SELECT c_custkey, {oracle.luhn('card')} AS card_valid, {oracle.cpf('cpf')} AS cpf_valid, {oracle.cnpj('cnpj')} AS cnpj_valid, {oracle.VALID['australia_abn']('abn')} AS abn_valid, {oracle.VALID['australia_tfn']('tfn')} AS tfn_valid, {oracle.VALID['canada_sin']('sin')} AS sin_valid, {oracle.VALID['imei']('imei')} AS imei_valid, ({oracle.verhoeff('aadhaar')} AND len(list_distinct(string_split(aadhaar, ''))) > 1) AS aadhaar_valid, 'Visa' AS issuer FROM (SELECT c_custkey, {', '.join(f'{v} AS {k}' for k, v in NUMBERS.items())} FROM customer)",
    "event_log": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS \"at\", event_id, event_type FROM events ORDER BY ts DESC, event_id, event_type LIMIT 120",
    "part_entropy": "SELECT p_partkey, round(list_sum(list_transform(list_distinct(cs), lambda x: -(len(list_filter(cs, lambda y: y = x)) / len(cs)) * log2(len(list_filter(cs, lambda y: y = x)) / len(cs)))), 6) AS bits FROM (SELECT p_partkey, string_split(p_name, '') AS cs FROM part)",
}
QUERIES = {name: globals()[name] for name in SQL} | {f"rule_{r.id}": rule_query(r) for r in RULES}
SQL |= {f"rule_{r.id}": oracle.rule_sql(r) for r in RULES}
