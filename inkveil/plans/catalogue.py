"""The queries of the library's own operators, by name, and SQL for the same results.

The documents hold four kinds of findings, which SQL finds with plainer patterns. Shapes that they lack are added to each document's
text by expressions over its id that both engines read, some to be found and some not; SQL finds them with patterns of its own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.spans import once
from ..operators import automaton, candidates, extra, incremental, render, review, terms
from ..operators.detectors import registry
from ..operators.scan import ScanOptions, active_detectors, finding_rows, resolve, rule_matches, scan, scan_choices
from ..sources import exports
from ..sources.work import work_path
from ..streaming.rollups import write_tally
from . import config, guide


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; in as many partitions as there are cores where the files have fewer, as scanning is work for each row."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _findings(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    options = ScanOptions(frozenset(ids)) if ids else None
    return finding_rows(scan(_documents(spark, sf_dir), options=options))


# The findings of documents in SQL.
_SQL_SPANS = """
{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents),
{name}_e AS (SELECT doc_id, unnest(generate_series(1, len(m))) AS i, m, g FROM {name}_m WHERE len(m) > 0),
{name}_s AS (SELECT doc_id, m[i] AS m, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS place FROM {name}_e)"""
_LUHN = """(list_sum(list_transform(generate_series(1, length(d)), lambda i:
  CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT
       WHEN substr(d, i, 1)::INT > 4 THEN 2 * substr(d, i, 1)::INT - 9 ELSE 2 * substr(d, i, 1)::INT END)) % 10 = 0)"""
_ISSUER = """((d[1] = '4' AND length(d) IN (13, 16, 19)) OR (regexp_matches(d, '^5[1-5]') AND length(d) = 16)
  OR (regexp_matches(d, '^(222[1-9]|22[3-9]\\d|2[3-6]\\d\\d|27[01]\\d|2720)') AND length(d) = 16) OR (regexp_matches(d, '^3[47]') AND length(d) = 15)
  OR (regexp_matches(d, '^6(011|4[4-9]|5)') AND length(d) BETWEEN 16 AND 19) OR (regexp_matches(d, '^35(2[89]|[3-8]\\d)') AND length(d) BETWEEN 16 AND 19)
  OR (regexp_matches(d, '^3(0[0-5]|[689])') AND length(d) BETWEEN 14 AND 19))"""
SQL_FINDINGS = (
    "WITH "
    + ",".join(
        _SQL_SPANS.format(name=n, pattern=p).lstrip("\n")
        for n, p in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
            ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
            ("card", r"\b(?:\d[ -]?){12,18}\d\b"),
            ("secret", r"""(?i)token\s*=\s*"[^"\r\n]{4,}\""""),
        )
    )
    + f""",
card_d AS (SELECT *, regexp_replace(m, '[ -]', '', 'g') AS d FROM card_s),
f AS (
  SELECT doc_id, 'email' AS detector_id, 'EMAIL' AS label, 'personal' AS category, 'medium' AS severity, place AS start, m AS value FROM email_s
  UNION ALL SELECT doc_id, 'ipv4', 'IP_ADDRESS', 'infrastructure', 'medium', place, m FROM ip_s
    WHERE len(list_filter(string_split(m, '.'), lambda o: o::INT > 255 OR (length(o) > 1 AND o[1] = '0'))) = 0 AND m NOT LIKE '127.%' AND m NOT IN ('0.0.0.0', '255.255.255.255')
  UNION ALL SELECT doc_id, 'payment-card', 'CREDIT_CARD', 'personal', 'high', place, m FROM card_d WHERE {_ISSUER} AND {_LUHN}
  UNION ALL SELECT doc_id, 'secret-assignment', 'SECRET', 'secrets', 'high', (place + strpos(m, '"'))::INT, m[strpos(m, '"') + 1 : -2] FROM secret_s),
n AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS pos, min(start) OVER (PARTITION BY doc_id, label, value) AS first FROM f),
p AS (
  SELECT *, '[' || label || '_' || dense_rank() OVER (PARTITION BY doc_id, label ORDER BY first) || ']' AS placeholder, (start + length(value))::INT AS "end" FROM n)"""
)


def q_email_findings(spark, sf_dir):
    return _findings(spark, sf_dir, "email").select("doc_id", "start", "value")


def q_ipv4_findings(spark, sf_dir):
    return _findings(spark, sf_dir, "ipv4").select("doc_id", "start", "value")


def q_card_findings(spark, sf_dir):
    return _findings(spark, sf_dir, "payment-card").select("doc_id", "start", "value")


def q_placeholder_numbering(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", "pos", "detector_id", "start", "end", "value", "placeholder")


def q_clean_text_hash(spark, sf_dir):
    cleaned = render.sanitize(scan(_documents(spark, sf_dir)))
    return cleaned.select("doc_id", F.size("findings").cast("bigint").alias("n_findings"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def q_group_findings(spark, sf_dir):
    groups = review.ranked_groups(review.group_findings(_findings(spark, sf_dir)))
    return groups.select("doc_id", "detector_id", "value", "placeholder", "severity", "count", "enabled", F.array_join("ids", ",").alias("ids"))


def q_export_aggregates(spark, sf_dir):
    made = review.export_aggregates(scan(_documents(spark, sf_dir)))
    high, personal = F.element_at("counts_by_severity", F.lit("high")), F.element_at("counts_by_category", F.lit("personal"))
    return made.select("doc_id", "finding_count", "detector_count", "replacement_count", "kept_count", F.coalesce(high, F.lit(0)).alias("high_count"), F.coalesce(personal, F.lit(0)).alias("personal_count"))


def q_corpus_tally(spark, sf_dir):
    return review.tally(_findings(spark, sf_dir)).select("category", "detector_id", "count")


def q_preview_round_trip(spark, sf_dir):
    """Segments put together again: the source, and the cleaned text."""
    made = once(scan(_documents(spark, sf_dir)), source=render.segments(F.coalesce("text", F.lit("")), F.col("findings")), preview=render.segments(F.coalesce("text", F.lit("")), F.col("findings"), preview=True))
    join = lambda c: F.md5(F.array_join(F.transform(c, lambda s: s["text"]), "").cast("binary"))
    return made.select("doc_id", join("source").alias("source_md5"), join("preview").alias("preview_md5"))


def q_preview_lines(spark, sf_dir):
    """The lines of the preview, put together from their pieces."""
    made = once(scan(_documents(spark, sf_dir)), source=render.segments(F.coalesce("text", F.lit("")), F.col("findings")))
    pieces = render.segment_rows(made, "source").groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(F.struct("segment", "text", "kind"))).alias("p"))
    return pieces.select("doc_id", F.col("line").cast("bigint").alias("line"), F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "").cast("binary")).alias("line_md5"), F.size(F.filter("p", lambda x: x["kind"] == "match")).cast("bigint").alias("matches"))


#: Profiles that differ in the rules which the documents have something for.
PROFILES = {
    "balanced": config.Profile(), "no-personal": config.Profile(overrides={d.id: False for d in registry() if d.category == "personal"}),
    "only-personal": config.Profile(overrides={d.id: d.category == "personal" and d.mode == "balanced" for d in registry()}), "no-ipv4": config.Profile(overrides={"ipv4": False}),
}


def q_profile_tally(spark, sf_dir):
    return review.tally_profiles(_documents(spark, sf_dir), {name: config.options(p) for name, p in PROFILES.items()})


def q_incremental_scan(spark, sf_dir):
    """A scan of all documents, then one after two rules are off and each hundredth document has changed; that reads the changed ones."""
    docs, store, known = _documents(spark, sf_dir), work_path(spark, "store"), config.options(config.Profile())
    incremental.refresh(docs, store, known)
    text = F.when(F.col("doc_id") % 100 == 7, F.expr(f"concat(coalesce(text, ''), {_CHANGE})")).otherwise(F.col("text"))
    changed = docs.withColumn("text", text)
    incremental.refresh(changed, store, known)
    chosen = config.options(config.Profile(overrides={"ipv4": False, "payment-card": False}))
    return finding_rows(incremental.scan_stored(changed, store, known, chosen)).select("doc_id", "pos", "detector_id", "start", "end", "value", "placeholder")


def q_hide_and_rescan(spark, sf_dir):
    """A scan of all documents, then one more term is hidden: only texts with its words are read again."""
    docs, store, known = _documents(spark, sf_dir), work_path(spark, "store"), config.options(config.Profile())
    incremental.refresh(docs, store, known)
    incremental.index_words(docs, store)
    hidden = incremental.scan_hiding(docs, store, known, terms.TermList("Hidden", (HIDDEN,)))
    return finding_rows(hidden).select("doc_id", "pos", "detector_id", "start", "end", "value")


def q_many_terms(spark, sf_dir):
    """A hundred terms in one pass over each document."""
    scanned = automaton.scan_terms(_documents(spark, sf_dir), terms.TermList("Many", MANY))
    return finding_rows(scanned).select("doc_id", "pos", "detector_id", "start", "end", "value")


def _even_mailboxes(text: str):
    """Of addresses, what is before the @, where its characters' code points have an even sum."""
    for m in re.finditer(r"([A-Za-z0-9._%+-]+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        if sum(map(ord, m[1])) % 2 == 0:
            yield m.span(1)


MAILBOX = extra.PythonRule("mailbox", "Mailbox", "MAILBOX", _even_mailboxes, priority=500)


def q_python_rule(spark, sf_dir):
    """A rule in Python beside the native ones: what it finds goes before the address around it."""
    scanned = extra.scan_python(_documents(spark, sf_dir), [MAILBOX])
    return finding_rows(scanned).select("doc_id", "pos", "detector_id", "start", "end", "value", "placeholder")


def q_rule_function(spark, sf_dir):
    """The same rule as a table function, joined laterally."""
    extra.register_rules(spark, "mailbox_spans", [MAILBOX])
    rows = spark.sql("SELECT d.doc_id, m.* FROM {docs} d, LATERAL mailbox_spans(d.text) m", docs=_documents(spark, sf_dir))
    return rows.select("doc_id", "rule", "start", "end", "value")


def q_stream_tally(spark, sf_dir):
    """The documents as a stream, one a second from the year 2000 on: counts of the windows of 100 seconds that close."""
    path = f"{sf_dir}/documents.parquet"
    # A stream's path is a folder or a pattern; this one fits the table's name alone.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") + _EPOCH).alias("ts"))
    made = work_path(spark, "tally")
    query = write_tally(stream, f"{made}/windows", f"{made}/state", "100 seconds", "10 seconds")
    query.awaitTermination()
    schema = "start timestamp, category string, detector_id string, findings bigint, documents bigint, without_findings bigint"
    rows = spark.read.schema(schema).parquet(f"{made}/windows")
    return rows.select((F.unix_timestamp("start") - _EPOCH).alias("start"), "category", "detector_id", "findings", "documents", "without_findings")


def q_export_files(spark, sf_dir):
    """Each cleaned text as a file of its own, and the files read again."""
    exports.register(spark)
    made, name = work_path(spark, "exports"), "clean-text.txt"
    cleaned = render.sanitize(scan(_documents(spark, sf_dir)))
    cleaned.select(F.col("doc_id").cast("string").alias("id"), F.lit(name).alias("name"), F.col("clean_text").alias("text")).write.format(exports.FORMAT).mode("append").save(made)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(made)
    return files.select(F.regexp_extract("path", "/doc-([^/@]*)", 1).cast("bigint").alias("doc_id"), F.col("length").alias("bytes"), F.md5("content").alias("file_md5"))


def q_rule_guide(spark, sf_dir):
    """Of each rule the placeholder that its sample in the guide gets, and what it finds in the documents under the default profile."""
    shown = guide.previews(guide.guide_table(spark)).select("rule", "ord", F.col("findings")[0]["placeholder"].alias("placeholder"), F.col("findings")[0]["enabled"].alias("replaced"))
    counts = _findings(spark, sf_dir).groupBy("detector_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))
    joined = shown.join(F.broadcast(counts), shown["rule"] == counts["detector_id"], "left")
    return joined.select("rule", "ord", "placeholder", "replaced", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", "documents")))


_EPOCH = 946_684_800
HIDDEN = "than"
MANY = (*"the and that this with from have they were their would there what about which when make like time just know take into year your good some could them other than then look only come over think".split(), *(f"item {i}" for i in range(62)))
_CHANGE = "chr(10), 'mail new', doc_id, '@x.example from 10.20.30.', doc_id % 200"
_SQL_CHANGED = SQL_FINDINGS.replace("WITH email_m", f"WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN concat(coalesce(text, ''), {_CHANGE}) ELSE text END AS text FROM documents),\nemail_m").replace("AS g FROM documents)", "AS g FROM changed)").replace(" AS first FROM f)", " AS first FROM f WHERE detector_id NOT IN ('ipv4', 'payment-card'))")
_SQL_LINES = f"""{SQL_FINDINGS},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
m AS (SELECT p.doc_id, length(substr(d.text, 1, p.start)) - length(replace(substr(d.text, 1, p.start), chr(10), '')) AS line, count(*) AS n FROM p JOIN documents d USING (doc_id) GROUP BY 1, 2)
SELECT l.doc_id, l.line, md5(l.t) AS line_md5, coalesce(m.n, 0) AS matches FROM l LEFT JOIN m ON l.doc_id = m.doc_id AND l.line = m.line WHERE l.t <> ''"""
_PROFILE_CASES = "(VALUES ('balanced', ''), ('no-personal', 'email,payment-card'), ('only-personal', 'ipv4,secret-assignment'), ('no-ipv4', 'ipv4')) AS v(profile, without)"
_SQL_TALLY = f"""{SQL_FINDINGS},
x AS (SELECT v.profile, d.doc_id, f.category, f.detector_id FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d CROSS JOIN {_PROFILE_CASES}
  LEFT JOIN f ON f.doc_id = d.doc_id AND NOT list_contains(string_split(v.without, ','), f.detector_id))
SELECT profile, category, detector_id, count(*) AS findings, NULL::BIGINT AS documents, NULL::BIGINT AS without_findings, NULL::BIGINT AS unreadable FROM x WHERE detector_id IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT profile, category, NULL, count(*), NULL, NULL, NULL FROM x WHERE detector_id IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT profile, NULL, NULL, count(detector_id), count(DISTINCT doc_id), count(*) FILTER (detector_id IS NULL), (SELECT count(*) FROM documents WHERE text IS NULL) FROM x GROUP BY 1"""


_MAILBOXES = """b AS (
  SELECT *, value[1 : strpos(value, '@') - 1] AS box FROM f WHERE detector_id = 'email'),
e AS (SELECT * FROM b WHERE list_sum(list_transform(string_split(box, ''), lambda c: unicode(c))) % 2 = 0)"""
_SQL_PYTHON = (
    SQL_FINDINGS.split("\nn AS (")[0]
    + f"""{_MAILBOXES},
a AS (
  SELECT doc_id, detector_id, label, start, value FROM f ANTI JOIN e USING (doc_id, detector_id, start)
  UNION ALL SELECT doc_id, 'mailbox', 'MAILBOX', start, box FROM e),
n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS pos, min(start) OVER (PARTITION BY doc_id, label, value) AS first FROM a)
SELECT doc_id, pos, detector_id, start, (start + length(value))::INT AS "end", value,
  '[' || label || '_' || dense_rank() OVER (PARTITION BY doc_id, label ORDER BY first) || ']' AS placeholder FROM n"""
)
_SQL_FUNCTION = SQL_FINDINGS.split("\nn AS (")[0] + f"""{_MAILBOXES}
SELECT doc_id, 'mailbox' AS rule, start, (start + length(box))::INT AS "end", box AS value FROM e"""
_SQL_STREAM = f"""{SQL_FINDINGS},
w AS (SELECT d.doc_id, d.doc_id // 100 * 100 AS start, f.category, f.detector_id FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN f ON f.doc_id = d.doc_id
  WHERE d.doc_id // 100 * 100 + 100 <= (SELECT max(doc_id) - 10 FROM documents))
SELECT start, category, detector_id, count(*) AS findings, 0::BIGINT AS documents, 0::BIGINT AS without_findings FROM w WHERE detector_id IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT start, category, NULL, count(*), 0, 0 FROM w WHERE detector_id IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT start, NULL, NULL, count(detector_id), count(DISTINCT doc_id), count(*) FILTER (detector_id IS NULL) FROM w GROUP BY 1"""


def _sql_guide() -> str:
    shown = _values([(d.id, i, f"[{d.label}_1]", d.mode != "lead") for i, d in enumerate(registry())], "rule, ord, placeholder, replaced")
    return f"""{SQL_FINDINGS},
g AS ({shown}), c AS (SELECT detector_id, count(*) AS n, count(DISTINCT doc_id) AS d FROM f GROUP BY 1)
SELECT g.rule, g.ord::INTEGER AS ord, g.placeholder, g.replaced, coalesce(c.n, 0) AS findings, coalesce(c.d, 0) AS documents FROM g LEFT JOIN c ON c.detector_id = g.rule"""


def _sql_hidden(pattern: str, words: str) -> str:
    return (
        SQL_FINDINGS
        + "".join(_SQL_SPANS.format(name="word", pattern=pattern).join((",", "")))
        + f""",
h AS (
  SELECT doc_id, detector_id, start, "end", value FROM p
  UNION ALL SELECT w.doc_id, 'private-term', w.place, (w.place + length(w.m))::INT, w.m FROM word_s w
  WHERE lower(w.m) IN ({words}) AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = w.doc_id AND p.start < w.place + length(w.m) AND w.place < p."end"))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS pos, detector_id, start, "end", value FROM h"""
    )


_NL, _BACK, _QUOTE = "chr(10)", "chr(92)", "chr(39)"


def _joined(parts: str, of: str) -> str:
    """SQL of a text: parts by |, of which those in braces are numbers made from `of`, and names are fixed characters."""
    named = {
        "NL": _NL, "BACK": _BACK, "QUOTE": _QUOTE, "{d}": f"CAST({of} AS STRING)", "{1}": f"CAST({of} % 10 AS STRING)", "{2}": f"lpad(CAST({of} % 100 AS STRING), 2, '0')",
        "{4}": f"lpad(CAST({of} % 10000 AS STRING), 4, '0')", "{7}": f"lpad(CAST({of} % 10000000 AS STRING), 7, '0')", "{day}": f"lpad(CAST(1 + {of} % 28 AS STRING), 2, '0')",
        "{some}": f"lpad(CAST(1 + {of} % 9998 AS STRING), 4, '0')", "{byte}": f"CAST({of} % 256 AS STRING)",
        "{person}": f"CASE {of} % 3 WHEN 0 THEN 'Dana Whitfield' WHEN 1 THEN 'Omar Haddad' ELSE 'Ana Cruz' END",
        "{company}": f"CASE {of} % 3 WHEN 0 THEN 'Blue Heron Labs' WHEN 1 THEN 'Juniper Works' ELSE 'Oak Street Supplies' END",
    }
    return " || ".join(named.get(p, f"'{p}'") for p in parts.split("|"))


#: Of each rule: a text that it finds something in, one that it doesn't, the pattern for SQL with its group, and the confidence.
RULE_CASES = {
    "private-key": ("-----BEGIN RSA PRIVATE KEY-----|NL|k|{d}|NL|-----END RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----", r"-----BEGIN RSA PRIVATE KEY-----\nk\d+\n-----END RSA PRIVATE KEY-----", 0, "high"),
    "connection-string": ("url postgres://svc|{d}|:pw@db.corp.local/app", "url postgres://db.corp.local/app", r"postgres://svc\d+:pw@[a-z./]+", 0, "high"),
    "payment-card": ("paid 4111 1111 1111 1111 by |{d}", "paid 4111 1111 1111 1112 by", "4111 1111 1111 1111", 0, "high"),
    "bearer-token": ("Bearer abcdefghijklmnop|{d}", "Bearer abc", r"Bearer [a-p]{16}\d+", 0, "high"),
    "api-key": ("key AKIAABCDEFGHIJKL|{4}| x", "key AKIA123 x", r"AKIA[A-L]{12}\d{4}", 0, "high"),
    "jwt": ("t eyJhbGciOiJI.eyJzdWIiOiIx.sig|{4}|abcd x", "t eyJ.short x", r"eyJ\w+\.\w+\.sig\d{4}abcd", 0, "high"),
    "secure-string-literal": ("ConvertTo-SecureString |QUOTE|Pass|{4}|QUOTE", "ConvertTo-SecureString $x", r"Pass\d{4}", 0, "high"),
    "ad-dn": ("at OU=Staff|{d}|,DC=corp,DC=example end", "at OU=Staff end", r"OU=Staff\d+,DC=corp,DC=example", 0, "high"),
    "guid-identifier": ("see 123e4567-e89b-12d3-a456-42661417|{4}", "see 123e4567-e89b-12d3-a456", r"123e4567-e89b-12d3-a456-\d{12}", 0, "low"),
    "secret-assignment": ('password = "hunter|{d}|"', 'password = "$secret"', r'"(hunter\d+)"', 1, "high"),
    "internal-url": ("see http://build|{d}|.corp.local/job now", "see http://www.example.com/job now", r"http://build\d+\.corp\.local/job", 0, "high"),
    "unc-path": ("to |BACK|BACK|files|{d}|BACK|share x", "to files", r"\\\\files\d+\\share", 0, "high"),
    "windows-user-path": ("path: C:|BACK|Users|BACK|bob|{d}|BACK|My Docs|BACK|a b.txt then", "at C:|BACK", r"C:\\Users\\bob\d+\\My Docs\\a b\.txt", 0, "high"),
    "unix-user-path": ("cd /home/bob|{d}|/src", "cd /opt/src", r"/home/bob\d+/src", 0, "high"),
    "email": ("mail bob|{d}|@x.example now", "bob at x.example", r"bob\d+@x\.example", 0, "high"),
    "ps-infrastructure-assignment": ('$smtpServer = "mail|{d}|.corp"', '$count = "mail.corp"', r'Server = "(mail\d+\.corp)"', 1, "medium"),
    "ps-identity-param": ("Set-ADUser -Identity jdoe|{d}", "Set-Item -Identity jdoe", r"ADUser -Identity (jdoe\d+)", 1, "medium"),
    "ps-server-param": ("Get-Thing -ComputerName srv-app|{d}", "Get-Thing -Name srv-app", r"ComputerName (srv-app\d+)", 1, "medium"),
    "ipv6": ("fe80::1ff:fe23:4567:|{4}| is up", "1:2:3 is up", r"fe80::1ff:fe23:4567:\d{4}", 0, "high"),
    "mac-address": ("mac 00:1A:2B:3C:|{2}|:5E here", "mac 00:00:00:00:00:00 here", r"00:1A:2B:3C:\d\d:5E", 0, "high"),
    "ipv4": ("host 10.20.30.|{byte}", "version 10.20.30.40", r"host (10\.20\.30\.\d+)", 1, "high"),
    "network-port": ("Port: 3389 of |{d}", "Port: 3390 of", "Port: (3389)", 1, "medium"),
    "internal-hostname": ("db|{d}|.corp.local answers", "www.example.com answers", r"db\d+\.corp\.local", 0, "high"),
    "ad-group-name": ("Add-ADGroupMember -Identity |QUOTE|App Users |{d}|QUOTE", "Add-Thing -Identity |QUOTE|App|QUOTE", r"App Users \d+", 0, "high"),
    "ticket-id": ("fixed in CHG|{7}", "as UTF-16 in CVE-2020", r"CHG\d{7}", 0, "high"),
    "username": ("login: mmiller|{d}", "login $x", r"login: (mmiller\d+)", 1, "medium"),
    "person-name": ("Owner: |{person}", "Owner: $owner", "Owner: ([A-Z][a-z]+ [A-Z][a-z]+)", 1, "low"),
    "org-name": ("Vendor: |{company}", "Client: TBD", "Vendor: ([A-Z][a-z]+(?: [A-Z][a-z]+)+)", 1, "low"),
    "canadian-sin": ("no 130 692 544 x", "no 130 692 545 x", "130 692 544", 0, "medium"),
    "health-identifier": ("MRN: A|{7}", "MRN: ABCDEFG", r"MRN: (A\d{7})", 1, "high"),
    "phone-number": ("Phone: (555) 010-|{4}", "Phone: 12", r"\(555\) 010-\d{4}", 0, "high"),
    "date-of-birth": ("DOB: 1990-02-|{day}", "DOB: 1990-02-30", r"DOB: (1990-02-[012]\d)", 1, "high"),
    "physical-address": ("Home Address: |{2}| Long Road, Springfield", "Address: none", r"Address: (\d+ Long Road, Springfield)", 1, "medium"),
    "passport-number": ("Passport No: X|{7}", "Passport No: ABCDEFG", r"X\d{7}", 0, "high"),
    "iban": ("pay DE89370400440532013000 to |{d}", "pay DE89370400440532013001 to", "DE89370400440532013000", 0, "high"),
    "us-ssn": ("no 123-45-|{some}| x", "no 666-45-6789 x", r"123-45-\d{4}", 0, "medium"),
    "us-aba-routing": ("routing number: 021000021", "routing number: 021000022", "021000021", 0, "high"),
    "us-itin": ("ITIN: 912-70-|{4}", "ITIN: 912-89-1234", r"912-70-\d{4}", 0, "high"),
    "us-ein": ("EIN: 12-|{7}", "EIN: 12345", r"12-\d{7}", 0, "high"),
    "us-dea-number": ("DEA: AB1234563", "DEA: AB1234564", "AB1234563", 0, "high"),
    "ca-postal-code": ("City: Ottawa K1A |{1}|B1", "near Ottawa K1A 0B1", r"City: Ottawa (K1A \dB1)", 1, "high"),
    "us-zip": ("ZIP: 90210-|{4}", "code 90210", r"90210-\d{4}", 0, "medium"),
    "workflow-artifact": ("to run_state_|{d}|.json", "to state.json", r"run_state_\d+\.json", 0, "medium"),
    "directory-attribute": ("by pwdLastSet |{d}", "by lastSet", "pwdLastSet", 0, "low"),
    "exchange-workflow": ("use Enable-RemoteMailbox |{d}", "use Mailbox", "Enable-RemoteMailbox", 0, "low"),
    "credential-workflow": ("call Export-Clixml |{d}", "call Export", "Export-Clixml", 0, "low"),
    "author-initials": ("# Modified 20|{2}| by JQ", "# note by JQ", r"Modified 20\d\d by (JQ)", 1, "low"),
    "header-metadata": ("# Department: Blue Team |{d}", "Department: Blue", r"# Department: (Blue Team \d+)", 1, "low"),
    "csv-identity-header": ("First Name,Last Name,Email,UPN,|{d}", "a,b,c,d", r"First Name,Last Name,Email,UPN,\d+", 0, "medium"),
}


def _case_text(rule: str) -> str:
    """SQL: by the document what isn't found, what is, or two that are with one between that isn't."""
    good, bad, _, _, _ = RULE_CASES[rule]
    one, two, none = _joined(good, "doc_id"), _joined(good, "(doc_id + 1)"), _joined(bad, "doc_id")
    return f"CASE doc_id % 3 WHEN 0 THEN {none} WHEN 1 THEN {one} ELSE {one} || {_NL} || {none} || {_NL} || {two} END"


def q_detector_cases(spark, sf_dir):
    """What each rule finds in the texts made for it, one for every document. Texts are made from the id, so documents of one id share
    them, and what is found in one is counted within its row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    ids = docs.repartition(max(docs.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    cases = F.expr("array(" + ", ".join(f"struct('{rule}' AS rule, {_case_text(rule)} AS text)" for rule in RULE_CASES) + ")")
    rows = ids.select("doc_id", "n", F.explode(cases).alias("c")).select("doc_id", "n", "c.*")
    found = rule_matches(rows, options=ScanOptions(frozenset(RULE_CASES)), only="rule")
    every = once(found, every=F.transform("rule_matches", lambda m: F.struct(m["value"].alias("value"), m["confidence"].alias("confidence")))).select("doc_id", "n", "rule", "every")
    each = every.select("*", F.explode(F.array_distinct("every")).alias("m"))
    return each.select("doc_id", "rule", "m.value", "m.confidence", (F.col("n") * F.size(F.filter("every", lambda x: x == F.col("m")))).alias("count"))


def _sql_cases() -> str:
    one = lambda rule: f"SELECT doc_id, '{rule}' AS rule, '{RULE_CASES[rule][4]}' AS confidence, unnest(regexp_extract_all({_case_text(rule)}, {_text(RULE_CASES[rule][2])}, {RULE_CASES[rule][3]})) AS value FROM documents"
    return f"SELECT doc_id, rule, value, confidence, count(*) AS count FROM ({' UNION ALL '.join(map(one, RULE_CASES))}) GROUP BY ALL"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: What is added to each document: lines of which some name a person, an organization or a badge.
PEOPLE = (
    "Owner: |{person}|NL|Manager: Get-Random|NL|As per |{person}|, the disk was full. see Dr. Okafor about it|NL|# Written by |{person}| for the audit|NL|NL|Full Name,City|NL|{person}|,Oslo|NL|"
    "{person}|,Brno|NL|NL|nobody wrote from a.b@mail.example.org"
)
COMPANIES = "Company: |{company}|NL|Client: TBD|NL|# script for Cedar Valley Health by Kim|NL|Copyright (c) 2019-2021 |{company}|. All rights reserved|NL|NL|Count,Vendor|NL|3,|{company}|NL|the hospital was full"
BADGES = "Badge ID: A-|{4}|NL|badge=|QUOTE|B-|{4}|QUOTE|NL|badge = $x|NL|badge: Get-Thing|NL|badge: C123456789"


def _with_lines(spark, sf_dir, lines: str) -> DataFrame:
    return _documents(spark, sf_dir).withColumn("text", F.expr(f"coalesce(text, '') || {_NL} || {_joined(lines, 'doc_id')}"))


def _values_of(scanned: DataFrame) -> DataFrame:
    """(doc_id, value, count) of what was found."""
    return scanned.select("doc_id", F.explode("findings").alias("f")).groupBy("doc_id", F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def q_names(spark, sf_dir):
    return _values_of(scan(_with_lines(spark, sf_dir, PEOPLE), options=ScanOptions(frozenset(["person-name"]))))


def q_organizations(spark, sf_dir):
    return _values_of(scan(_with_lines(spark, sf_dir, COMPANIES), options=ScanOptions(frozenset(["org-name"]))))


def q_field_rules(spark, sf_dir):
    rule = terms.FieldRule("badge", "Badge", ("badge", "badge id"), "identifier", "BADGE_ID", max_length=8)
    return _values_of(scan(_with_lines(spark, sf_dir, BADGES), options=ScanOptions(frozenset(), (terms.field_detector("own", rule),))))


def _sql_lines(lines: str, *patterns: str) -> str:
    """Group 1 of the patterns in the added lines."""
    rows = [f"SELECT doc_id, unnest(regexp_extract_all({_joined(lines, 'doc_id')}, {_text(p)}, 1)) AS value FROM documents" for p in patterns]
    return f"SELECT doc_id, value, count(*) AS count FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"


_NAME = "([A-Z][a-z]+(?: [A-Z][a-z]+)+)"


def q_output_modes(spark, sf_dir):
    """Every document under a mapping of each strategy, in both output modes."""
    docs = _with_lines(spark, sf_dir, "ZephAccess and |QUOTE|Zeph|QUOTE| $zeph")
    rules = {s: terms.mapping_detectors([terms.MappingEntry("Zeph", "SourceSystem", strategy=s)]) for s in terms.STRATEGIES}
    made = render.compare_modes(scan_choices(docs, {s: ScanOptions(frozenset(), r) for s, r in rules.items()}))
    return made.select("doc_id", F.col("choice").alias("strategy"), F.md5(F.col("safe_share").cast("binary")).alias("safe_md5"), F.md5(F.col("portfolio_code").cast("binary")).alias("code_md5"), "changed_lines")


def _sql_modes() -> str:
    whole = lambda line: f"md5(coalesce(text, '') || {_NL} || {line})"
    plain, hidden = _joined("ZephAccess and |QUOTE|Zeph|QUOTE| $zeph", "doc_id"), _joined("[CUSTOM_TERM_1]Access and |QUOTE|[CUSTOM_TERM_1]|QUOTE| $[CUSTOM_TERM_1]", "doc_id")
    code, generic = _joined("SourceSystemAccess and |QUOTE|[CUSTOM_TERM_1]|QUOTE| $sourceSystem", "doc_id"), _joined("SourceSystemAccess and |QUOTE|SourceSystem|QUOTE| $sourceSystem", "doc_id")
    rows = (("placeholder", hidden, hidden, 0), ("code-only", hidden, code, 1), ("genericize", hidden, generic, 1), ("review-lead", plain, plain, 0))
    return " UNION ALL ".join(f"SELECT doc_id, '{s}' AS strategy, {whole(a)} AS safe_md5, {whole(b)} AS code_md5, {n} AS changed_lines FROM documents" for s, a, b, n in rows)


def q_hidden_terms(spark, sf_dir):
    """How often a list of two terms is found in each document, whole words in any case."""
    rule = terms.terms_detector(["the", "of the"])
    found = scan(_documents(spark, sf_dir), options=ScanOptions(frozenset(), (rule,)))
    return found.select("doc_id", F.size("findings").cast("bigint").alias("n_found"), F.size(F.array_distinct(F.transform("findings", lambda f: f["placeholder"]))).cast("bigint").alias("n_placeholders"))


#: Every "of the" holds one "the", and is found in its place. Characters between words are doubled, so that neighbours share none.
_SQL_TERMS = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, len(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: lower(x) = 'the')) AS n_the,
    len(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}])', '\1\1', 'g'), '(?i)(?:^|[^\p{L}\p{N}])of[ \t\x{a0}]+the(?:$|[^\p{L}\p{N}])')) AS n_of FROM t)
SELECT doc_id, n_the AS n_found, (n_of > 0)::BIGINT + (n_the > n_of)::BIGINT AS n_placeholders FROM w"""


def q_acronyms(spark, sf_dir):
    return candidates.acronym_counts(scan(_documents(spark, sf_dir)))


def q_candidates(spark, sf_dir):
    """The suggested terms of every document. SQL has no look-around for its runs of words; a test compares it with plain Python."""
    return candidates.candidates(scan(_documents(spark, sf_dir)))


#: Six spans of a document: (name, priority, confidence, start, length).
_SPANS = [(f"s{i}", f"50 + 10 * (({a} * doc_id + {i}) % 4)", f"1 + ({b} * doc_id + {i}) % 3", f"({a} * doc_id + {b * i}) % 30", f"1 + ({b} * doc_id + {a * i}) % 12") for i, (a, b) in enumerate(((3, 5), (7, 2), (11, 13), (5, 17), (19, 7), (2, 11)))]


def q_overlap_greedy(spark, sf_dir):
    """Of six spans for each document, those that are kept."""
    one = lambda s: f"struct('{s[0]}' AS name, CAST({s[1]} AS INT) AS priority, CAST({s[2]} AS INT) AS confidence, CAST({s[3]} AS INT) AS start, CAST({s[3]} + {s[4]} AS INT) AS end)"
    rows = once(_documents(spark, sf_dir), c=F.expr(f"array({', '.join(map(one, _SPANS))})"))
    return once(rows, kept=resolve(F.col("c"))).select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.name", "k.start", "k.end")


def _sql_greedy() -> str:
    one = lambda i, s: f"[{{'r': row(-({s[1]}), -({s[2]}), -({s[4]}), {s[3]}, {i}), 'name': '{s[0]}', 'a': {s[3]}, 'b': {s[3]} + {s[4]}}}]"
    return f"""WITH l AS (SELECT doc_id, list_sort([{', '.join(one(i, s) for i, s in enumerate(_SPANS))}]) AS l FROM documents),
k AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.a < x[1].b AND x[1].a < k.b)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM l)
SELECT doc_id, k.name AS name, k.a::INTEGER AS start, k.b::INTEGER AS "end" FROM k"""


#: Identifiers made from the document's id, valid or not.
_NUMBERS = {
    "aba": "lpad(CAST((doc_id * 7919 + 21000021) % 1000000000 AS STRING), 9, '0')", "dea": "'AB' || lpad(CAST((doc_id * 104729 + 1234563) % 10000000 AS STRING), 7, '0')",
    "sin": "lpad(CAST((doc_id * 15485863 + 130692544) % 1000000000 AS STRING), 9, '0')", "ssn": "lpad(CAST((doc_id * 32452843 + 123456789) % 1000000000 AS STRING), 9, '0')",
    "itin": "'9' || lpad(CAST((doc_id * 49979687 + 12701234) % 100000000 AS STRING), 8, '0')", "card": "'4' || lpad(CAST((doc_id * 86028121 + 111111111111111) % 1000000000000000 AS STRING), 15, '0')",
    "iban": "'DE' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || lpad(CAST((doc_id * 67867967 + 370400440532013000) % 1000000000000000000 AS STRING), 18, '0')",
}


def q_checksums(spark, sf_dir):
    tests = {"iban": V.is_iban, "aba": V.is_aba, "dea": V.is_dea, "sin": V.is_sin, "ssn": V.is_ssn, "itin": V.is_itin, "card": V.is_card}
    made = F.expr("array(" + ", ".join(f"struct('{k}' AS kind, {v} AS value)" for k, v in _NUMBERS.items()) + ")")
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")
    valid = F.coalesce(*(F.when(F.col("kind") == k, F.coalesce(t(F.col("value")), F.lit(False))) for k, t in tests.items()))
    return rows.select("doc_id", "kind", "value", valid.alias("valid"))


_digit = lambda i: f"TRY_CAST(substr(d, {i}, 1) AS INT)"
#: Checks of numbers in SQL, over d.
_SQL_CHECKS = {
    "aba": f"(3 * ({_digit(1)} + {_digit(4)} + {_digit(7)}) + 7 * ({_digit(2)} + {_digit(5)} + {_digit(8)}) + {_digit(3)} + {_digit(6)} + {_digit(9)}) % 10 = 0 AND d <> '000000000'",
    "dea": f"({_digit(3)} + {_digit(5)} + {_digit(7)} + 2 * ({_digit(4)} + {_digit(6)} + {_digit(8)})) % 10 = {_digit(9)}",
    "sin": f"d[1] NOT IN ('0', '8') AND {_LUHN}", "ssn": "d[1:3] NOT IN ('000', '666') AND d[1] <> '9' AND d[4:5] <> '00' AND d[6:9] <> '0000'",
    "itin": "d[4:5] BETWEEN '70' AND '88' OR d[4:5] BETWEEN '90' AND '92' OR d[4:5] BETWEEN '94' AND '99'", "card": _LUHN,
    "iban": "(d[5:22] || '1314' || d[3:4])::HUGEINT % 97 = 1",
}


def _sql_checksums() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, d AS value, {_SQL_CHECKS[k]} AS valid FROM (SELECT doc_id, {v} AS d FROM documents)" for k, v in _NUMBERS.items())


#: Parts of IN_TEXT that change with the document.
_PARTS = _NUMBERS | {
    "sin groups": "concat_ws(' ', substr(S, 1, 3), substr(S, 4, 3), substr(S, 7, 3))".replace("S", _NUMBERS["sin"]), "sin mixed": "substr(S, 1, 3) || '-' || substr(S, 4, 3) || ' ' || substr(S, 7, 3)".replace("S", _NUMBERS["sin"]),
    "ssn groups": "concat_ws('-', substr(S, 1, 3), substr(S, 4, 2), substr(S, 6, 4))".replace("S", _NUMBERS["ssn"]),
    "date": "CAST(1850 + doc_id * 7 % 200 AS STRING) || '-' || lpad(CAST(doc_id % 14 AS STRING), 2, '0') || '-' || lpad(CAST(doc_id * 11 % 33 AS STRING), 2, '0')",
    "pass": "CASE doc_id % 3 WHEN 0 THEN 'ABCDEFG' WHEN 1 THEN '1234567' ELSE 'X1234567' END",
    "record": "CASE doc_id % 4 WHEN 0 THEN 'RECORD-1' WHEN 1 THEN 'R-2345' WHEN 2 THEN 'R-2' ELSE 'REC-345-6' END",
}
#: Lines after a document's own text. Numbers are valid or not as the document's id makes them; beside them are near misses: a digit too
#: many or too few, no label, a label within a word, mixed separators.
IN_TEXT = (
    "routing number: |{aba}|NL|routing number: |{aba}|0|NL|routing numbers |{aba}|NL|DEA no: |{dea}|NL|DEA: |{dea}|9|NL|IDEA: |{dea}|NL|see |{sin groups}|, or |{sin mixed}|.|NL|SIN: |{sin}|NL|BASIN: |{sin}|NL|"
    "on |{ssn groups}| and |{ssn groups}|-1 and |{ssn groups}|7|NL|SSN= |{ssn}|NL|ITIN: |{itin}|NL|ITIN: |{itin}|0|NL|EIN: 12-|{7}|NL|EIN: 12-|{7}|8|NL|VEIN: 12-|{7}|NL|EIN: 123|{7}|NL|"
    "pay |{iban}|NL|pay |{iban}|0|NL|pay X|{iban}|NL|DOB: |{date}|NL|DOBS: |{date}|NL|Passport No: |{pass}|NL|Passports: |{pass}|NL|MRN: |{record}|NL|MRNS: |{record}|NL|"
    "Mobile: +1 555.010.|{4}|NL|Phones: 555-010-|{4}|NL|Tel: 555 010 |{4}|5|NL|Fax= (555) 010|{4}| x12|NL|mac 00:00:00:00:00:|{2}| or 00:1A:2B:|{2}| or 00:1A-2B:3C:4D:|{2}|NL|"
    "as UTF-|{2}| and OPS-|{d}|, CHG|{d}|, INC0|{4}|, XCHG|{7}|NL|City: Ottawa K1A |{1}|B1, K1D |{1}|B1|NL|near Ottawa K1A |{1}|B1|NL|State: NY 1000|{1}|-|{4}|, 1000|{2}|NL|in NY 1000|{1}"
)
#: The values of each rule in SQL: patterns whose group 1 is the value x, and what holds for x (d is x without separators).
_LABEL = r"(?i)\b{}[:=] ?"
_APART = r"(?:^|[^\d-]){}(?:[^\d-]|$)"
_SQL_IN_TEXT = {
    "us-aba-routing": ((_LABEL.format("routing number") + r"(\d+)",), "length(x) = 9 AND " + _SQL_CHECKS["aba"]),
    "us-dea-number": ((_LABEL.format("DEA(?: no)?") + r"(\w+)",), r"regexp_full_match(x, '[A-Za-z]{2}\d{7}') AND " + _SQL_CHECKS["dea"]),
    "canadian-sin": ((_LABEL.format("SIN") + r"(\d{9})\b", _APART.format(r"(\d{3} \d{3} \d{3}|\d{3}-\d{3}-\d{3})")), _SQL_CHECKS["sin"]),
    "us-ssn": ((_LABEL.format("SSN") + r"(\d{9})\b", _APART.format(r"(\d{3}-\d{2}-\d{4})")), _SQL_CHECKS["ssn"]),
    "us-itin": ((_LABEL.format("ITIN") + r"(9\d+)",), f"length(x) = 9 AND ({_SQL_CHECKS['itin']})"),
    "us-ein": ((_LABEL.format("EIN") + r"(\d+-\d+)",), r"regexp_full_match(x, '\d{2}-\d{7}')"),
    "iban": ((r"\b(DE\d+)\b",), f"length(x) = 22 AND TRY_CAST(x[3:] AS HUGEINT) IS NOT NULL AND {_SQL_CHECKS['iban']}"),
    "date-of-birth": ((r"\bDOB: ?(\d{4}-\d\d-\d\d)\b",), "TRY_CAST(x AS DATE) IS NOT NULL AND x[1:4]::INT BETWEEN 1900 AND year(current_date)"),
    "passport-number": ((_LABEL.format("Passport No") + r"(\w+)",), r"regexp_matches(x, '[A-Z]') AND regexp_matches(x, '\d')"),
    "health-identifier": ((r"\bMRN: ?([\w-]+)",), r"length(x) BETWEEN 6 AND 15 AND length(regexp_replace(x, '\D', '', 'g')) >= 4"),
    "phone-number": ((r"\b(?:Mobile|Tel|Fax)[:=] ?((?:\+1 )?\(?\d{3}\)?[ .]?\d{3}[ .]?\d{4}(?: x\d+)?)(?:[^\d-]|$)",), "true"),
    "mac-address": ((r"(?i)\b((?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2})\b",), "x[3] = x[6] AND x[6] = x[9] AND x[9] = x[12] AND x[12] = x[15] AND NOT regexp_full_match(lower(d), '0+|f+')"),
    "ticket-id": ((r"\b((?:INC|CHG|REQ|RITM|PRB|SCTASK|TASK)\d+)\b", r"\b([A-Z]{2,10}-\d{2,6})\b"), r"(strpos(x, '-') > 0 OR regexp_matches(x, '\d{5}$')) AND split_part(x, '-', 1) NOT IN ('UTF', 'ISO', 'RFC', 'CVE', 'SHA', 'MD', 'TLS', 'HTTP', 'IPV')"),
    "ca-postal-code": ((r"(?m)^.*\b(?:Address|Street|City|Location|ZIP|Postal Code)[ \t]*[:=].*$", r"\b([A-Z]\d[A-Z] ?\d[A-Z]\d)\b"), "NOT regexp_matches(x, '[DFIOQU]') AND NOT regexp_matches(x, '^[WZ]')"),
    "us-zip": ((r"(?m)^.*\b(?:Address|Street|City|State|ZIP|Postal Code)[ \t]*[:=].*$", _APART.format(r"(\d{5}(?:-\d{4})?)")), "true"),
}
#: Rules whose first pattern gives the lines to search.
_BY_LINE = ("ca-postal-code", "us-zip")


def _lined(parts: str) -> str:
    out = []
    for p in parts.split("|"):
        out.append(_PARTS[p[1:-1]] if p[1:-1] in _PARTS else _joined(p, "doc_id"))
    return " || ".join(out)


#: The same for what scripts, logs and settings hold.
IN_SCRIPTS = (
    "-----BEGIN RSA PRIVATE KEY-----|NL|k|{d}|NL|-----END RSA PRIVATE KEY-----|NL|-----BEGIN PUBLIC KEY-----|NL|-----BEGIN PRIVATE KEY-----|NL|"
    "Bearer abcdefghijklmnop|{d}|==|NL|Bearer abcdefghijk|{4}|NL|Forbearer abcdefghijklmnopq|{4}|NL|t eyJhbGciOiJI.eyJzdWIiOiIx.sig|{4}|abcd x|NL|t eyJhbGciOiJI.eyJzdWI.sig|{4}|abcd x|NL|"
    "key AKIAABCDEFGHIJKL|{4}|, AKIAABCDEFGHIJKL|{4}|9, ghp_abcdefghijklmnopqrstuvwxyz012345|{4}|, ghp_abcdefghijklmnopqrstuvwxyz01234|{4}|NL|url postgres://svc|{d}|:pw@db.corp.local/app|NL|url postgres://db|{d}|.corp.local/app|NL|"
    "at OU=Staff|{d}|,DC=corp,DC=example end|NL|at OU=Staff|{d}|,DC=corp end|NL|see 123e4567-e89b-12d3-a456-42661417|{4}|, 123e4567-e89b-12d3-a456-42661417|{4}|0|NL|"
    "see http://build|{d}|.corp.local/job, http://www.example.com/|{d}| and https://172.|{2}|.0.1/x|NL|to |BACK|BACK|files|{d}|BACK|share x or |BACK|BACK|files|{d}| x|NL|cd /home/bob|{d}|/src; cd /homes/bob|{d}|/src|NL|"
    "Get-Thing -ComputerName srv-app|{d}|NL|Get-Thing -Computer srv-app|{d}|NL|Add-ADGroupMember -Identity |QUOTE|App Users |{d}|QUOTE|NL|Add-Member -Identity |QUOTE|App Users |{d}|QUOTE|NL|"
    "to run_state_|{d}|.json, run_state_|{d}|.jsonl, audit-|{2}|.csv and runs-|{2}|.csv|NL|ConvertTo-SecureString |QUOTE|Pass|{4}|QUOTE|NL|ConvertTo-SecureString |QUOTE|abc|QUOTE|NL|"
    'password = "hunter|{d}|"|NL|password = "$secret|{d}|"|NL|pass = "hunter|{d}|"|NL|login: mmiller|{d}|NL|logins: mmiller|{d}|NL|login: |{d}|x'
)
_HOST = "regexp_extract(x, '://([^/:?#]*)', 1)"
_SQL_IN_SCRIPTS = {
    "private-key": ((r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----)",), "true"),
    "bearer-token": ((r"(?i)\b(Bearer +[\w.~+/-]+=*)",), r"length(regexp_extract(x, ' ([^ =]+)', 1)) >= 16"),
    "jwt": ((r"\b(eyJ[\w-]+\.[\w-]+\.[\w-]+)",), "length(split_part(x, '.', 1)) >= 11 AND length(split_part(x, '.', 2)) >= 8 AND length(split_part(x, '.', 3)) >= 8"),
    "api-key": ((r"\b((?:AKIA|ASIA)[A-Z0-9]+)\b", r"\b(ghp_[A-Za-z0-9]+)"), "length(x) = 20 OR length(x) >= 40"),
    "connection-string": ((r"([a-z]+://\w+:\w+@[\w./]+)",), "true"),
    "ad-dn": ((r"(?i)\b((?:OU=\w+,)*DC=\w+(?:,DC=\w+)*)",), "regexp_matches(x, '(?i)DC=.*,DC=')"),
    "guid-identifier": ((r"\b([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]+)\b",), "length(x) = 36"),
    "internal-url": (
        (r"(?i)\b((?:https?|ldaps?)://[^\s\"'<>)\]]+)",),
        f"regexp_matches({_HOST}, '(?i)(^|[.])(local|internal|corp|lan|intranet|intra)([.]|$)') OR strpos({_HOST}, '.') = 0 OR regexp_full_match({_HOST}, '10([.][1-9]?[0-9]){{3}}|192[.]168([.][1-9]?[0-9]){{2}}|172[.](1[6-9]|2[0-9]|3[01])([.][1-9]?[0-9]){{2}}')",
    ),
    "unc-path": ((r"(\\\\\w[\w.-]*\\[^\s\"'<>|]+)",), "true"),
    "unix-user-path": ((r"(/(?:home|Users)/[\w.-]+(?:/[^\s\"'<>|]*)?)",), "true"),
    "ps-server-param": ((r"(?i)-(?:ComputerName|Server|SmtpServer) [\"']?([a-z0-9][\w.-]+)",), "true"),
    "ad-group-name": ((r"(?i)-ADGroupMember -Identity '([^']+)'",), "length(x) BETWEEN 2 AND 80"),
    "workflow-artifact": ((r"(?i)\b([\w-]*(?:run_state|last_run|audit|snapshot)[\w-]*\.\w+)\b",), "regexp_matches(x, '(?i)[.](json|xml|csv|log|txt)$')"),
    "secure-string-literal": ((r"(?i)ConvertTo-SecureString '([^']+)'",), "length(x) >= 4"),
    "secret-assignment": ((r"(?i)(?:password|passwd|pwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']([^\"'\r\n]+)[\"']",), "length(x) >= 4 AND x[1] NOT IN ('$', '[', '(', '<', '{', '@')"),
    "username": ((r"(?i)\b(?:user|username|login|logon|account)\b\s*[:=]\s*[\"']?([a-z][\w.@-]*\w)",), "true"),
}


def _found_in_text(spark: SparkSession, sf_dir: str, lines: str, rules) -> DataFrame:
    """What each rule finds on its own in every document's whole text with the lines after it."""
    docs = _documents(spark, sf_dir).withColumn("text", F.expr(f"coalesce(text, '') || {_NL} || {_lined(lines)}"))
    found = rule_matches(docs, options=ScanOptions(frozenset(rules))).select("doc_id", F.explode("rule_matches").alias("m"))
    return found.groupBy("doc_id", F.col("m.detector_id").alias("rule"), F.col("m.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def q_rules_in_text(spark, sf_dir):
    """Fifteen rules for people's data."""
    return _found_in_text(spark, sf_dir, IN_TEXT, _SQL_IN_TEXT)


def q_script_rules_in_text(spark, sf_dir):
    """Sixteen rules for secrets, infrastructure and paths."""
    return _found_in_text(spark, sf_dir, IN_SCRIPTS, _SQL_IN_SCRIPTS)


def _sql_in_text(lines: str, rules: dict) -> str:
    every = lambda of, p, g=1: f"unnest(regexp_extract_all({of}, {_text(p)}, {g}))"
    rows = []
    for rule, (patterns, holds) in rules.items():
        if rule in _BY_LINE:
            found = [f"SELECT doc_id, {every('line', patterns[1])} AS x FROM (SELECT doc_id, {every('text', patterns[0], 0)} AS line FROM t)"]
        else:
            found = [f"SELECT doc_id, {every('text', p)} AS x FROM t" for p in patterns]
        rows.append(f"SELECT doc_id, '{rule}' AS rule, x AS value FROM (SELECT *, regexp_replace(x, '[ :-]', '', 'g') AS d FROM ({' UNION ALL '.join(found)})) WHERE {holds}")
    return f"WITH t AS (SELECT doc_id, coalesce(text, '') || {_NL} || {_lined(lines).replace('AS STRING', 'AS VARCHAR')} AS text FROM documents) SELECT doc_id, rule, value, count(*) AS count FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"


def q_rule_resolution(spark, sf_dir):
    """Settings only: how many rules are on under four profiles."""
    profiles = [("balanced", "balanced", [], {}), ("strict", "strict", [], {}), ("us", "balanced", ["pack-us-v1"], {"email": False}), ("all", "strict", list(config.PACKS), {"iban": False})]
    asked = spark.createDataFrame(profiles, "profile string, core string, packs array<string>, overrides map<string,boolean>")
    packs = spark.createDataFrame([(p, d) for p, ds in config.PACKS.items() for d in ds], "pack_id string, detector_id string")
    return config.resolved_rules(config.rule_table(spark), packs, asked).groupBy("profile").agg(F.count_if("enabled").alias("enabled_rules"))


#: A list of terms for each document, with the suggested replacements; those of one replacement are numbered.
_TERMS = [
    ("APP-Finance|{d}", "App-Access-Group"), ("employee|{d}|Id", "SourceSystemId"), ("cost|{d}|ID", "SourceSystemID"), ("HelpDesk |{d}", "TicketingSystem"), ("ACME", "SourceSystem"),
    ("Northwind Health |{d}", "SourceOrg"), ("Blue Sky |{d}", "ReviewTerm"), ("stuff|{d}", "SourceSystem2"), ("Self Portal", "InternalApp"), ("user|{d}|Id", "SourceSystem2Id"), ("Project Dawn", "ProjectName"),
]


def q_mapping_suggestions(spark, sf_dir):
    made = F.expr("array(" + ", ".join(f"struct({i} AS ord, {_joined(t, 'doc_id')} AS term)" for i, (t, _) in enumerate(_TERMS)) + ")")
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(made).alias("t")).select("doc_id", "t.*")
    return review.suggest_mappings(rows, list_col="doc_id").select("doc_id", "ord", "term", "replacement")


#: Output with placeholders where code breaks, and the lines (from 1) of those.
CODE = "param([string]$[NAME_1])|NL|function [ORG_1] {}|NL|ok [EMAIL_1]|NL|$x.[HOST_1] = 1|NL|pre[TERM_2]"
CODE_LINES = (1, 2, 4, 5)


def q_code_warnings(spark, sf_dir):
    docs = _with_lines(spark, sf_dir, CODE)
    return once(docs, w=review.code_warnings(F.col("text"))).select("doc_id", F.explode("w").alias("w")).select("doc_id", F.col("w.line").alias("line"))


def q_mask(spark, sf_dir):
    """The masked first characters of each document, up to 19 of them."""
    value = F.expr("substring(text, 1, CAST(doc_id % 20 AS INT))")
    return _documents(spark, sf_dir).select("doc_id", render.mask(value).alias("masked"))


_SQL_MASK = """SELECT doc_id, CASE WHEN length(v) <= 6 THEN substr(v, 1, 1) || repeat('•', 4) WHEN length(v) <= 14 THEN substr(v, 1, 4) || repeat('•', 8)
  ELSE substr(v, 1, 4) || repeat('•', 8) || substr(v, length(v) - 1, 2) END AS masked FROM (SELECT doc_id, substr(text, 1, (doc_id % 20)::INT) AS v FROM documents)"""


def q_readiness(spark, sf_dir):
    """The open items of each document if its emails are kept."""
    scanned = scan(_documents(spark, sf_dir))
    emails = F.transform(F.filter("findings", lambda f: f["detector_id"] == "email"), lambda f: f["id"])
    ready = review.readiness(review.set_enabled(scanned, emails, False))
    kept = F.filter("readiness.items", lambda i: i["kind"] == "kept-findings")
    return ready.select("doc_id", F.col("readiness.status").alias("status"), F.size("readiness.items").cast("bigint").alias("items"), F.coalesce(F.get(F.transform(kept, lambda i: i["count"]), F.lit(0)), F.lit(0)).alias("kept"))


def q_scan_summary(spark, sf_dir):
    """One row for the whole corpus."""
    made = review.scan_summary(scan(_documents(spark, sf_dir)), len(active_detectors(ScanOptions())))
    return made.select("documents", "documents_without_findings", "findings", "replacements")


def q_category_sections(spark, sf_dir):
    sections = review.category_sections(review.group_findings(_findings(spark, sf_dir)))
    return sections.select("doc_id", "section", "category", "groups", "findings")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("q_") and callable(v)}


def _values(rows, names: str) -> str:
    def one(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        return "NULL" if x is None else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def oracle_sql() -> dict[str, str]:
    modes = {d.id: d.mode for d in registry()}
    plain = {d for d, m in modes.items() if m not in ("pack", "strict")}
    strict = {d for d, m in modes.items() if m != "pack"}
    every_pack = {d for ds in config.PACKS.values() for d in ds}
    resolved = [("balanced", len(plain)), ("strict", len(strict)), ("us", len((plain | set(config.PACKS["pack-us-v1"])) - {"email"})), ("all", len((strict | every_pack) - {"iban"}))]
    cleaned = """, c AS (
  SELECT doc_id, start, "end", placeholder, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS since FROM p),
t AS (
  SELECT d.doc_id, count(c.start) AS n, any_value(d.text) AS text, max(c."end") AS upto,
    string_agg(substr(d.text, c.since + 1, c.start - c.since) || c.placeholder, '' ORDER BY c.start) AS head
  FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id),
o AS (SELECT doc_id, n, coalesce(text, '') AS source, coalesce(head, '') || substr(coalesce(text, ''), coalesce(upto, 0) + 1) AS clean FROM t)"""
    one = lambda rule: f"{SQL_FINDINGS} SELECT doc_id, start, value FROM f WHERE detector_id = '{rule}'"
    return {
        "q_email_findings": one("email"),
        "q_ipv4_findings": one("ipv4"),
        "q_card_findings": one("payment-card"),
        "q_placeholder_numbering": f'{SQL_FINDINGS} SELECT doc_id, pos, detector_id, start, "end", value, placeholder FROM p',
        "q_clean_text_hash": f"{SQL_FINDINGS}{cleaned} SELECT doc_id, n AS n_findings, md5(clean) AS clean_md5 FROM o",
        "q_preview_round_trip": f"{SQL_FINDINGS}{cleaned} SELECT doc_id, md5(source) AS source_md5, md5(clean) AS preview_md5 FROM o",
        "q_preview_lines": _SQL_LINES,
        "q_profile_tally": _SQL_TALLY,
        "q_incremental_scan": f'{_SQL_CHANGED} SELECT doc_id, pos, detector_id, start, "end", value, placeholder FROM p',
        "q_hide_and_rescan": _sql_hidden(r"[\p{L}\p{N}]*(?i:than)[\p{L}\p{N}]*", f"'{HIDDEN}'"),
        "q_many_terms": _sql_hidden(r"[\p{L}\p{N}]+", ", ".join(f"'{w}'" for w in MANY if " " not in w)),
        "q_python_rule": _SQL_PYTHON,
        "q_rule_function": _SQL_FUNCTION,
        "q_stream_tally": _SQL_STREAM,
        "q_export_files": f"{SQL_FINDINGS}{cleaned} SELECT doc_id, strlen(clean) AS bytes, md5(clean) AS file_md5 FROM o",
        "q_rule_guide": _sql_guide(),
        "q_group_findings": f"{SQL_FINDINGS} SELECT doc_id, detector_id, value, min(placeholder) AS placeholder, min(severity) AS severity, count(*) AS count, true AS enabled, string_agg(detector_id || '-' || pos || '-' || start, ',' ORDER BY pos) AS ids FROM p GROUP BY doc_id, detector_id, value",
        "q_export_aggregates": f"{SQL_FINDINGS} SELECT d.doc_id, count(p.pos) AS finding_count, count(DISTINCT p.detector_id) AS detector_count, count(p.pos) AS replacement_count, 0::BIGINT AS kept_count, count(*) FILTER (p.severity = 'high') AS high_count, count(*) FILTER (p.category = 'personal') AS personal_count FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id",
        "q_corpus_tally": f"{SQL_FINDINGS} SELECT category, detector_id, count(*) AS count FROM f GROUP BY ROLLUP (category, detector_id)",
        "q_acronyms": SQL_FINDINGS
        + "".join(_SQL_SPANS.format(name="acr", pattern=r"\b[A-Z]{2,6}\b").join((",", "")))
        + f""" SELECT a.doc_id, a.m AS text, count(*) AS count FROM acr_s a
  WHERE a.m NOT IN ({', '.join(repr(x) for x in candidates.NO_ACRONYMS)}) AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = a.doc_id AND p.start < a.place + length(a.m) AND a.place < p."end")
  GROUP BY a.doc_id, a.m""",
        "q_names": _sql_lines(PEOPLE, f"(?:Owner: |As per |Written by ){_NAME}", "Dr[.] (Okafor)", f"\\n{_NAME},(?:Oslo|Brno)"),
        "q_organizations": _sql_lines(COMPANIES, f"(?:Company: |2021 ){_NAME}", "script for (Cedar Valley Health)", f"3,{_NAME}"),
        "q_field_rules": _sql_lines(BADGES, r"([AB]-\d{4})"),
        "q_output_modes": _sql_modes(),
        "q_hidden_terms": _SQL_TERMS,
        "q_detector_cases": _sql_cases(),
        "q_overlap_greedy": _sql_greedy(),
        "q_checksums": _sql_checksums(),
        "q_rules_in_text": _sql_in_text(IN_TEXT, _SQL_IN_TEXT),
        "q_script_rules_in_text": _sql_in_text(IN_SCRIPTS, _SQL_IN_SCRIPTS),
        "q_rule_resolution": _values(resolved, "profile, enabled_rules"),
        "q_mapping_suggestions": " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {_joined(t, 'doc_id')} AS term, '{r}' AS replacement FROM documents" for i, (t, r) in enumerate(_TERMS)),
        "q_code_warnings": f"SELECT doc_id, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), {_NL}, '')) + 1)::INTEGER + unnest([{', '.join(map(str, CODE_LINES))}]) AS line FROM documents",
        "q_mask": _SQL_MASK,
        "q_readiness": f"{SQL_FINDINGS}, e AS (SELECT d.doc_id, count(p.pos) AS n FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id AND p.detector_id = 'email' GROUP BY d.doc_id) SELECT doc_id, CASE WHEN n > 0 THEN 'review' ELSE 'ready' END AS status, (n > 0)::BIGINT AS items, n AS kept FROM e",
        "q_scan_summary": f"{SQL_FINDINGS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id)) AS documents_without_findings, count(*) AS findings, count(*) AS replacements FROM p",
        "q_category_sections": f"{SQL_FINDINGS} SELECT doc_id, list_position([{', '.join(repr(x) for x in review.SECTIONS)}], category)::INTEGER AS section, category, count(DISTINCT (detector_id, value)) AS groups, count(*)::BIGINT AS findings FROM p GROUP BY doc_id, category",
    }
