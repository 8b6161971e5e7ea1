"""The registered queries over the given tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import RULES
from ..operators import chunks, detect, reports, spans, tagging, tags
from ..schema import LABEL_TYPE, TYPES, papers, types_table
from ..sources import intake, pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(_table(spark, sf_dir, "documents"))


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- rules -------------------------------------------------------------------


def _rule_count(rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").where(rule.hint(F.col("text")))
        n = F.size(F.regexp_extract_all("text", F.lit(rule.java), F.lit(0))).cast("long")
        return docs.select("doc_id", n.alias("n")).where("n > 0")

    return run


def _group(rule) -> int:
    return 1 if rule.type == "PHONE" else 0


def _quoted(s: str) -> str:
    return s.replace("'", "''")


for _r in RULES:
    QUERIES[f"rule_{_r.type.lower()}"] = _rule_count(_r)
    ORACLES[f"rule_{_r.type.lower()}"] = (
        f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_quoted(_r.re2)}', {_group(_r)})) AS BIGINT) AS n FROM documents WHERE len(regexp_extract_all(text, '{_quoted(_r.re2)}', {_group(_r)})) > 0"
    )

#: doc_id, type, start, end, surface of every rule match. The phone rule's match is followed by its guard, which is taken off.
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, '{r.type}' AS type, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start,
     {f"regexp_extract(h[i], '{_quoted(r.re2)}', {_group(r)})"} AS surface
     FROM (SELECT doc_id, string_split_regex(text, '{_quoted(r.re2)}') AS b, regexp_extract_all(text, '{_quoted(r.re2)}', 0) AS h FROM documents), unnest(range(1, len(h) + 1)) AS t(i)"""
    for r in RULES
)
_M = f"m AS (SELECT doc_id, type, start, CAST(start + length(surface) AS INTEGER) AS \"end\", surface FROM ({_MATCHES}))"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _papers(spark, sf_dir).withColumn("findings", spans.finished(F.col("text"), spans.all_rule_matches(F.col("text"))))
    return rows


@_query(f'WITH {_M} SELECT doc_id, type, start, "end" FROM m')
def rule_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(_raw(spark, sf_dir)).select(F.col("paper_ord").alias("doc_id"), "type", "start", "end")


@_query(f"WITH {_M} SELECT type, lang, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM m JOIN documents USING (doc_id) GROUP BY type, lang")
def rule_counts_by_type_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", F.explode(spans.all_rule_matches(F.col("text"))).alias("f"))
    per_doc = rows.groupBy(F.col("f.type").alias("type"), "lang", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("type", "lang").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@_query(
    "SELECT doc_id, " + "".join("regexp_replace(" for _ in RULES[3:]) + "regexp_replace(regexp_replace(text, '" + _quoted(RULES[0].re2) + "', '[EMAIL]', 'g'), '" + _quoted(RULES[2].re2) + "', '[SSN]', 'g')"
    + "".join(f", '{_quoted(r.re2)}', '[{r.type}]', 'g')" for r in RULES[3:]) + " AS text FROM documents"
)
def replace_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as replacements one after the other, without span logic (the phone rule apart)."""
    out = F.col("text")
    for r in [RULES[0], *RULES[2:]]:
        out = F.regexp_replace(out, r.java, f"[{r.type}]")
    return _table(spark, sf_dir, "documents").select("doc_id", out.alias("text"))


# --- values and tags ------------------------------------------------------------

_KEY = r"trim(regexp_replace(regexp_replace(lower({s}), '\s+', ' ', 'g'), '[.,;:!?]+$', ''))"


@_query(f"SELECT p_partkey, {_KEY.format(s='p_name')} AS name_key, {_KEY.format(s=chr(39) + ' ' + chr(39) + ' || upper(p_type) || ' + chr(39) + ' .,!' + chr(39))} AS type_key FROM part")
def tag_key_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    noisy = F.concat(F.lit(" "), F.upper("p_type"), F.lit(" .,!"))
    return part.select("p_partkey", T.tag_key(F.col("p_name")).alias("name_key"), T.tag_key(noisy).alias("type_key"))


_PH = "CASE type " + " ".join(f"WHEN '{t}' THEN '{p}'" for t, p, _ in TYPES) + " END"
_TAGS = f"""v AS (SELECT type, {_KEY.format(s="surface")} AS key, doc_id, start FROM m),
f AS (SELECT type, key, min((doc_id, start)) AS spot FROM v GROUP BY type, key),
g AS (SELECT type, key, row_number() OVER (PARTITION BY type ORDER BY spot) AS n, count(*) OVER (PARTITION BY type) AS n_distinct FROM f)"""


@_query(f"""WITH {_M}, {_TAGS} SELECT type, key, CAST(n AS BIGINT) AS n, CAST(n_distinct AS BIGINT) AS n_distinct,
'[' || {_PH} || CASE WHEN n_distinct > 1 THEN ' ' || n ELSE '' END || ']' AS tag FROM g""")
def tag_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.exploded(_raw(spark, sf_dir)).withColumn("key", T.tag_key(F.col("surface")))
    return tags.assign_tags(found).select("type", "key", "n", "n_distinct", "tag")


@_query(
    f"WITH {_M} SELECT CAST(doc_id AS VARCHAR) AS paper_id, type, CASE type " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, _, n in TYPES) + " END AS title, CAST(count(*) AS BIGINT) AS total FROM m GROUP BY doc_id, type"
)
def legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.legend(_raw(spark, sf_dir)).select("paper_id", "type", "title", "total")


@_query(f"""WITH {_M}, c AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(coalesce(n, 0) AS BIGINT) AS total, CAST(coalesce(n, 0) AS BIGINT) AS enabled_n,
CASE WHEN n IS NULL THEN 'clean' ELSE 'masked' END AS state, CASE WHEN n IS NULL THEN 'no findings' ELSE 'masked findings: ' || n END AS summary FROM documents LEFT JOIN c USING (doc_id)""")
def paper_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.paper_summary(_raw(spark, sf_dir))


@_query(f"""WITH {_M} SELECT 'corpus' AS batch_id, CAST(count(*) FILTER (trim(coalesce(text, '')) <> '') AS BIGINT) AS done_n,
CAST(count(*) FILTER (trim(coalesce(text, '')) = '') AS BIGINT) AS error_n, CAST((SELECT count(*) FROM m) AS BIGINT) AS findings_n FROM documents""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch_status(_raw(spark, sf_dir))


@_query(f"""WITH {_M}, c AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) SELECT CAST(doc_id AS VARCHAR) AS paper_id,
CASE WHEN trim(coalesce(text, '')) = '' THEN 'failed' WHEN n IS NULL THEN 'clean' ELSE 'masked' END AS state, CAST(coalesce(n, 0) AS BIGINT) AS n, false AS scanned,
CASE WHEN trim(coalesce(text, '')) = '' THEN 'unreadable: file appears to be empty' WHEN n IS NULL THEN 'no findings' ELSE 'masked findings: ' || n END AS line FROM documents LEFT JOIN c USING (doc_id)""")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _raw(spark, sf_dir)
    return reports.row_text(found, detect.exploded(found))


@_query("""SELECT doc_id, coalesce(min(CASE WHEN lang = 'en' THEN doc_id END) OVER (ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_id FROM documents""")
def next_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next paper to review, English ones being the ones that are done."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.lit("corpus").alias("batch_id"), F.col("doc_id").alias("paper_ord"), F.when(F.col("lang") == "en", "done").otherwise("waiting").alias("status"))
    return reports.next_done(rows).select(F.col("paper_ord").alias("doc_id"), F.coalesce("next_ord", F.lit(-1)).alias("next_id"))


@_query("""SELECT doc_id, source || '-scrubbed' || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.txt' AS out_name
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE trim(coalesce(text, '')) <> '')""")
def outname_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.output_names(_papers(spark, sf_dir)).select(F.col("paper_ord").alias("doc_id"), "out_name")


# --- intake ------------------------------------------------------------------------


_EXTENSIONS = ["txt", "DOCX", "pdf", "heic", "JPG", "doc", "md", "exe"]
_FILES = "f AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || '.' || list_extract(['" + "', '".join(_EXTENSIONS) + "'], CAST(page_id % 8 AS INTEGER) + 1) AS name, CASE WHEN page_id % 5 = 0 THEN 'image/png' ELSE 'text/html' END AS mime FROM pages)"


@_query(f"WITH {_FILES}" + r""" SELECT CASE WHEN regexp_matches(name, '(?i)\.docx$') THEN 'docx' WHEN regexp_matches(name, '(?i)\.pdf$') THEN 'pdf'
WHEN regexp_matches(name, '(?i)\.(png|jpe?g|webp|bmp|heic|heif)$') OR mime LIKE 'image/%' THEN 'image' ELSE 'text' END AS kind,
regexp_matches(name, '(?i)\.(docx|pdf|txt|md|text|png|jpe?g|webp|bmp|heic|heif)$') OR mime LIKE 'image/%' AS accepted, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL""")
def scan_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files, of pages under names with extensions, some with an image's type."""
    ending = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (F.col("page_id") % 8 + 1).cast("int"))
    name = F.concat(F.regexp_extract("url", r"([^/]*)\z", 1), F.lit("."), ending)
    files = _table(spark, sf_dir, "pages").select(name.alias("name"), F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("text/html").alias("mime"))
    return files.groupBy(intake.kind_of(F.col("name"), F.col("mime")).alias("kind"), intake.accepted(F.col("name"), F.col("mime")).alias("accepted")).agg(F.count("*").alias("n"))


@_query("SELECT doc_id, source AS t, text AS x FROM documents WHERE trim(coalesce(text, '')) <> ''")
def handoff_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sent = docs.select(F.col("doc_id").alias("paper_id"), T.encode_handoff(F.col("source"), F.col("text")).alias("fragment"))
    return intake.from_handoff(sent).select(F.col("paper_id").alias("doc_id"), F.col("name").alias("t"), F.col("text").alias("x"))


@_query("SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS BIGINT) AS n, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) >= 30 AS enough FROM documents")
def text_layer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", T.non_space_length(F.col("text")).cast("long").alias("n"), intake.enough_text(F.col("text"), 30).alias("enough"))


@_query("SELECT doc_id, text FROM documents")
def pdf_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken apart into positioned words, line by line, and put together again."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda s, i: F.struct(i.alias("y"), F.split(s, " ", -1).alias("w")))
    word = lambda y: lambda w, i: F.struct(w.alias("str"), (i * 100).cast("double").alias("x"), (y * 12).cast("double").alias("y"), F.lit(90.0).alias("width"), F.lit(False).alias("has_eol"))
    items = F.flatten(F.transform(lines, lambda x: F.transform(x["w"], word(x["y"]))))
    made = pdf.document_text(docs.select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("page"), items.cast(pdf.ITEMS).alias("items")))
    return made.select(F.col("paper_id").alias("doc_id"), "text")


# --- chunks and taggers ---------------------------------------------------------------


_CHUNKS = """c AS (
  SELECT doc_id, text, 0 AS pos, 0 AS size, 0 AS ord FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, pos + size, CASE WHEN pos + size + 1300 >= length(text) THEN length(text) - pos - size
    WHEN cut >= 455 THEN cut + 1 WHEN sp >= 455 THEN sp ELSE 1300 END, ord + 1
  FROM (SELECT *, greatest(
      CASE WHEN strpos(r, chr(10)) > 0 THEN length(r) - strpos(r, chr(10)) ELSE -1 END,
      CASE WHEN strpos(r, ' .') > 0 THEN length(r) - strpos(r, ' .') - 1 ELSE -1 END,
      CASE WHEN strpos(r, ' !') > 0 THEN length(r) - strpos(r, ' !') - 1 ELSE -1 END,
      CASE WHEN strpos(r, ' ?') > 0 THEN length(r) - strpos(r, ' ?') - 1 ELSE -1 END) AS cut,
      CASE WHEN strpos(r, ' ') > 0 THEN length(r) - strpos(r, ' ') ELSE -1 END AS sp
    FROM (SELECT *, reverse(substring(text, pos + size + 1, 1300)) AS r FROM c WHERE pos + size < length(text))))"""


@_query(f"""WITH RECURSIVE {_CHUNKS}
SELECT doc_id, CAST(ord - 1 AS INTEGER) AS chunk_ord, CAST(pos AS INTEGER) AS start, CAST(size AS INTEGER) AS size FROM c WHERE ord > 0""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(chunks.chunk_text(F.col("text"))).alias("chunk_ord", "c"))
    return parts.select("doc_id", "chunk_ord", F.col("c.start").alias("start"), F.length("c.text").alias("size"))


_LABEL_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in sorted(LABEL_TYPE.items()))
_LABELS = "'FIRSTNAME', 'JOBTITLE', 'CITY', 'IPV4', 'PHONENUMBER', 'EYECOLOR', 'DOB'"


@_query(f"""WITH d(raw, type) AS (VALUES {_LABEL_ROWS}), t AS (SELECT event_type, list_extract([{_LABELS}], CAST(user_id % 7 AS INTEGER) + 1) AS raw FROM events)
SELECT event_type, type, CAST(count(*) AS BIGINT) AS n FROM t JOIN d USING (raw) GROUP BY event_type, type""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (dealt to events by user) to types; labels without a type drop out."""
    from ..schema import type_of

    raw = F.element_at(F.array(*[F.lit(x.strip(" '")) for x in _LABELS.split(",")]), (F.col("user_id") % 7 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("event_type", type_of(raw).alias("type"))
    return rows.where("type is not null").groupBy("event_type", "type").agg(F.count("*").alias("n"))


#: The pattern tagger's tokens of each chunk, and their runs.
_ENTITIES = r"""k AS (SELECT doc_id, ord - 1 AS chunk_ord, pos, substring(text, pos + 1, size) AS ct FROM c WHERE ord > 0),
w AS (SELECT doc_id, chunk_ord, pos, ct, i, h[i] AS word, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, string_split_regex(ct, '[A-Za-z0-9_.]*[A-Za-z0-9_]') AS b, regexp_extract_all(ct, '[A-Za-z0-9_.]*[A-Za-z0-9_]') AS h FROM k WHERE regexp_matches(ct, '[0-9]|[0-9a-f]{32}')), unnest(range(1, len(h) + 1)) AS t(i)),
v AS (SELECT *, a + length(word) AS b, CASE WHEN contains(word, '.') OR length(word) >= 32 OR regexp_matches(word, '[a-f]') THEN 'LINK' WHEN length(word) = 5 THEN 'ZIP' WHEN regexp_full_match(word, '(19|20)[0-9]{2}') THEN 'DATE' WHEN length(word) <= 2 THEN 'AGE' ELSE 'ID' END AS type
  FROM w WHERE regexp_full_match(word, '([0-9]{1,3}\.){3}[0-9]{1,3}|[0-9a-f]{32,}|[0-9]+')),
o AS (SELECT *, CASE WHEN type = lag(type) OVER n AND (a <= lag(b) OVER n OR type = 'ID' AND regexp_full_match(substring(ct, CAST(lag(b) OVER n AS BIGINT) + 1, CAST(a - lag(b) OVER n AS BIGINT)), '[ \t]{1,2}')) THEN 0 ELSE 1 END AS new
  FROM v WINDOW n AS (PARTITION BY doc_id, chunk_ord ORDER BY i)),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, chunk_ord ORDER BY i) AS run FROM o),
ent AS (SELECT doc_id, chunk_ord, min(type) AS type, CAST(min(pos + a) AS INTEGER) AS s, CAST(max(pos + b) AS INTEGER) AS e, avg(CASE WHEN type = 'AGE' THEN 0.35 ELSE 0.9 END) AS score FROM u GROUP BY doc_id, chunk_ord, run HAVING min(type) <> 'AGE')"""


@_query(f"WITH RECURSIVE {_CHUNKS}, {_ENTITIES} SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(chunk_ord AS INTEGER) AS chunk_ord, type, s AS start, e AS \"end\", CAST(round(score, 3) AS DOUBLE) AS score FROM ent")
def bio_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the pattern tagger over all documents."""
    parts = tagging.chunks(_papers(spark, sf_dir)).withColumn("tokens", tagging.pattern_tagger(F.col("text")))
    return tagging.entities(parts).select("paper_id", "chunk_ord", "type", "start", "end", F.round("score", 3).alias("score"))


# --- whole pipeline ------------------------------------------------------------------------


#: Signs of words, for use in SQL strings.
_LOOSE = "[^\\s()\\[\\]{}<>,;:\"'']"
_TIGHT = "[A-Za-z0-9''’-]"


def _grown(cls: str) -> tuple[str, str]:
    return f"s - length(regexp_extract(substring(text, 1, s), '({cls}*)$', 1))", f"e + length(regexp_extract(substring(text, e + 1), '^({cls}*)', 1))"


#: From findings f0 (doc_id, ord, type, s, e, score, source) to expanded, resolved (res) and merged (mer) lists of each document.
_STEPS = f"""f1 AS (SELECT f0.*, text, type IN ('EMAIL', 'LINK', 'USERNAME') AS loose FROM f0 JOIN documents USING (doc_id)),
f2 AS (SELECT *, CASE WHEN loose THEN {_grown(_LOOSE)[0]} ELSE {_grown(_TIGHT)[0]} END AS s2, CASE WHEN loose THEN {_grown(_LOOSE)[1]} ELSE {_grown(_TIGHT)[1]} END AS e2 FROM f1),
f3 AS (SELECT doc_id, text, ord, type, s2 AS s, CASE WHEN loose THEN s2 + length(regexp_replace(substring(text, s2 + 1, e2 - s2), '[.!?,;:]+$', '')) ELSE e2 END AS e, score, source FROM f2),
f4 AS (SELECT doc_id, any_value(text) AS text, list({{'type': type, 's': CAST(s AS INTEGER), 'e': CAST(e AS INTEGER), 'score': CAST(score AS DOUBLE), 'source': source, 'w': CASE WHEN source = 'regex' THEN 1e9 ELSE 0 END + (e - s) * 100 + score}} ORDER BY s, e DESC, ord) AS l FROM f3 GROUP BY doc_id),
res AS (SELECT doc_id, text, list_reduce(list_transform(l, lambda z: [z]), lambda a, y: CASE WHEN y[1].s >= a[-1].e THEN list_concat(a, y) WHEN y[1].w > a[-1].w THEN list_concat(a[:-2], y) ELSE a END) AS l FROM f4),
mer AS (SELECT doc_id, text, list_reduce(list_transform(l, lambda z: [z]), lambda a, y: CASE WHEN a[-1].type = y[1].type AND regexp_full_match(substring(text, a[-1].e + 1, y[1].s - a[-1].e), '[ \\t.,''’-]{{0,3}}')
  THEN list_concat(a[:-2], [{{'type': a[-1].type, 's': a[-1].s, 'e': y[1].e, 'score': greatest(a[-1].score, y[1].score), 'source': a[-1].source, 'w': 0e0}}]) ELSE list_concat(a, y) END) AS l FROM res),
fin AS (SELECT doc_id, text, z.type AS type, z.s AS s, z.e AS e, z.score AS score, z.source AS source, substring(text, z.s + 1, z.e - z.s) AS surface FROM (SELECT doc_id, text, unnest(l) AS z FROM mer) WHERE length(trim(substring(text, z.s + 1, z.e - z.s))) >= 2)"""
_RULES = f"{_M}, f0 AS (SELECT doc_id, list_position(['EMAIL', 'PHONE', 'SSN', 'ID', 'ORG'], type) AS ord, type, start AS s, \"end\" AS e, 1e0 AS score, 'regex' AS source FROM m)"
_INLINE = "SELECT doc_id, z.type AS type, z.s AS start, z.e AS \"end\", z.score AS score, z.source AS source FROM (SELECT doc_id, unnest(l) AS z FROM {0})"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).withColumn("f", spans.resolve(spans.expand(F.col("text"), spans.all_rule_matches(F.col("text")))))


@_query(f"WITH {_RULES}, {_STEPS} {_INLINE.format('res')}")
def resolve_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select(F.col("paper_ord").alias("doc_id"), F.inline("f"))


@_query(f"WITH {_RULES}, {_STEPS} {_INLINE.format('mer')}")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).withColumn("f", spans.merge(F.col("text"), F.col("f"))).select(F.col("paper_ord").alias("doc_id"), F.inline("f"))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents detected, and their findings."""
    papers_ = detect.kept(_papers(spark, sf_dir))
    return papers_, detect.findings(papers_)


#: Tags of findings fin, numbered by first appearance.
_NUMBERED = f"""key AS (SELECT *, {_KEY.format(s="surface")} AS key FROM fin),
num AS (SELECT type, key, row_number() OVER (PARTITION BY type ORDER BY spot) AS n, count(*) OVER (PARTITION BY type) AS d FROM (SELECT type, key, min((doc_id, s)) AS spot FROM key GROUP BY type, key)),
tag AS (SELECT key.*, '[' || {_PH} || CASE WHEN d > 1 THEN ' ' || n ELSE '' END || ']' AS tag FROM key JOIN num USING (type, key))"""
_SCRUBBED = """pc AS (SELECT doc_id, string_agg(substring(text, p + 1, s - p) || tag, '' ORDER BY s) AS head, max(e) AS last, count(*) AS n FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM tag) GROUP BY doc_id)"""


@_query(f"""WITH {_RULES}, {_STEPS}, {_NUMBERED}, {_SCRUBBED}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_findings, coalesce(head || substring(text, last + 1), text, '') AS scrubbed FROM documents LEFT JOIN pc USING (doc_id)""")
def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers_, found = _found(spark, sf_dir)
    out = tags.scrub(papers_, found, tags.assign_tags(found))
    return out.select(F.col("paper_ord").alias("doc_id"), "n_findings", "scrubbed")


@_query(f"""WITH RECURSIVE {_CHUNKS}, {_ENTITIES}, {_M}, f0 AS (SELECT doc_id, 0 AS ord, type, s, e, score, 'model' AS source FROM ent
UNION ALL SELECT doc_id, list_position(['EMAIL', 'PHONE', 'SSN', 'ID', 'ORG'], type), type, start, "end", 1e0, 'regex' FROM m), {_STEPS}
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS id, type, surface, CAST(round(score, 3) AS DOUBLE) AS score, source, true AS enabled FROM fin""")
def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and the pattern tagger together, all steps."""
    return reports.findings_export(detect.detect(_papers(spark, sf_dir), tagging.each_chunk(tagging.pattern_tagger)))


# --- papers with names: made of customers, so that every step of detection has something to do -------


_REGION_WORDS = ["Africa", "America", "Asia", "Europe", "Middle"]


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for each customer: a name that is named again, an address, numbers of each kind, a mail, a school."""
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    given, last = F.split(F.initcap(F.lower("r_name")), " ")[0], F.initcap(F.lower("c_mktsegment"))
    k = F.col("c_custkey").cast("string")
    digits = lambda n: F.lpad((F.col("c_custkey") % 10**n).cast("string"), n, "0")
    text = F.concat(
        given, F.lit(" "), last, F.lit(" of "), k, F.lit(" Alder Brook Road wrote.\n"), last, F.lit(" came, and "), given, F.lit(" left. Id "), digits(3), F.lit("-"), digits(2), F.lit("-"), digits(4),
        F.lit("; "), (F.col("c_custkey") + 1000000).cast("string"), F.lit(". Mail c"), k, F.lit("@a"), F.col("c_nationkey").cast("string"), F.lit(".example.com or 502-555-"), digits(4), F.lit(". Quarry Hill Academy"),
    )
    return papers(rows.select(F.col("c_custkey").alias("doc_id"), text.alias("text"), F.lit("letter").alias("source")))


#: The same findings by arithmetic over the parts of each letter.
_LETTERS = """p AS (SELECT c_custkey AS doc_id, upper(split_part(r_name, ' ', 1)[1]) || lower(split_part(r_name, ' ', 1)[2:]) AS g, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS l, CAST(c_custkey AS VARCHAR) AS k,
  lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ssn, CAST(c_custkey + 1000000 AS VARCHAR) AS num,
  'c' || c_custkey || '@a' || c_nationkey || '.example.com' AS mail, '502-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS tel
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT doc_id, [{'type': 'NAME', 'source': 'model', 'pre': '', 'surface': g || ' ' || l}, {'type': 'ADDRESS', 'source': 'model', 'pre': ' of ', 'surface': k || ' Alder Brook Road'}, {'type': 'NAME', 'source': 'echo', 'pre': ' wrote.' || chr(10), 'surface': l},
  {'type': 'NAME', 'source': 'model', 'pre': ' came, and ', 'surface': g}, {'type': 'SSN', 'source': 'regex', 'pre': ' left. Id ', 'surface': ssn}, {'type': 'ID', 'source': 'regex', 'pre': '; ', 'surface': num},
  {'type': 'EMAIL', 'source': 'regex', 'pre': '. Mail ', 'surface': mail}, {'type': 'PHONE', 'source': 'regex', 'pre': ' or ', 'surface': tel}, {'type': 'ORG', 'source': 'regex', 'pre': '. ', 'surface': 'Quarry Hill Academy'}] AS z FROM p),
z AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS id, z[i].type AS type, z[i].source AS source, z[i].surface AS surface, z[i].pre AS pre,
  CAST(list_sum(list_transform(z[1:i], lambda x: length(x.pre))) + coalesce(list_sum(list_transform(z[1:i - 1], lambda x: length(x.surface))), 0) AS INTEGER) AS s FROM q, unnest(range(1, 10)) AS t(i)),
fin AS (SELECT *, CAST(s + length(surface) AS INTEGER) AS e, CASE source WHEN 'model' THEN 0.8 WHEN 'echo' THEN 0.99 ELSE 1.0 END AS score FROM z)"""


def _letter_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tagger = tagging.each_chunk(tagging.list_tagger({"B-FIRSTNAME": _REGION_WORDS, "B-STREET": ["Alder"]}))
    rows = detect.kept(_letters(spark, sf_dir), tagger)
    return rows, detect.findings(rows)


@_query(f'WITH {_LETTERS} SELECT doc_id, id, type, s AS start, e AS "end", surface, CAST(score AS DOUBLE) AS score, source FROM fin')
def letter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of detection over letters with names, addresses and schools: extension, echo, rules of every kind."""
    found = _letter_findings(spark, sf_dir)[1]
    return found.select(F.col("paper_ord").alias("doc_id"), "id", "type", "start", "end", "surface", "score", "source")


_LETTER_RULES = " UNION ALL ".join(f"SELECT doc_id, '{r.type}' AS type, CAST(len(regexp_extract_all(text, '{_quoted(r.re2)}', {_group(r)})) AS BIGINT) AS n FROM t" for r in RULES)


@_query(f"WITH {_LETTERS}, t AS (SELECT doc_id, string_agg(pre || surface, '' ORDER BY s) AS text FROM fin GROUP BY doc_id) SELECT doc_id, type, n FROM ({_LETTER_RULES}) WHERE n > 0")
def letter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each rule in letters, where all rules have some."""
    rows = _letters(spark, sf_dir).select(F.col("paper_ord").alias("doc_id"), F.explode(spans.all_rule_matches(F.col("text"))).alias("f"))
    return rows.groupBy("doc_id", F.col("f.type").alias("type")).agg(F.count("*").alias("n"))


@_query(f"WITH {_LETTERS}, {_NUMBERED} SELECT doc_id, string_agg(pre || tag, '' ORDER BY s) AS scrubbed FROM tag GROUP BY doc_id")
def letter_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _letter_findings(spark, sf_dir)
    return tags.scrub(rows, found, tags.assign_tags(found)).select(F.col("paper_ord").alias("doc_id"), "scrubbed")


@_query(f"""WITH {_LETTERS}, {_NUMBERED}, x AS (SELECT * FROM tag WHERE type <> 'ID'), y AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'old ' || surface ELSE surface END AS original, tag, doc_id, s FROM x)
SELECT tag, arg_min(original, (doc_id, s)) AS original FROM y GROUP BY tag""")
def letter_tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's map with numbers switched off, where every third letter was exported before with other originals."""
    found = _letter_findings(spark, sf_dir)[1]
    known = tags.assign_tags(found)
    on = found.withColumn("enabled", F.col("type") != "ID")
    old = tags.exported(on.where("paper_ord % 3 = 0"), known).withColumn("original", F.concat(F.lit("old "), "original"))
    return tags.tag_map(on, known, snapshots=old).select("tag", "original")


@_query("SELECT CAST(doc_id AS VARCHAR) AS reply_id, coalesce(text, '') AS text FROM documents")
def reply_unscrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrubbed texts as replies, with their own paper's map: the texts come back as they were."""
    papers_, found = _found(spark, sf_dir)
    known = tags.assign_tags(found)
    replies = tags.scrub(papers_, found, known).select(F.col("paper_id").alias("reply_id"), F.col("paper_id").alias("scope"), F.col("scrubbed").alias("text"))
    return tags.unscrub(replies, tags.tag_map(found, known, "paper"))


@_query(f"""WITH {_RULES}, {_STEPS}, {_NUMBERED} SELECT 'corpus' AS scope, min((doc_id, s))[1] AS ord, CAST(min((doc_id, s))[2] AS INTEGER) AS start, tag, arg_min(surface, (doc_id, s)) AS original
FROM tag JOIN documents USING (doc_id) WHERE trim(coalesce(documents.text, '')) <> '' GROUP BY tag""")
def tag_map_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)[1]
    return tags.tag_map(found, tags.assign_tags(found))


@_query(f"""WITH {_M} SELECT doc_id, type, CAST(count(*) AS BIGINT) AS total, CAST(CASE WHEN type = 'ID' THEN 0 ELSE count(*) END AS BIGINT) AS enabled_n FROM m GROUP BY doc_id, type""")
def toggle_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ID category switched off in every paper."""
    rows = reports.legend(detect.toggle_category(_raw(spark, sf_dir), "ID"))
    return rows.select(F.col("paper_id").cast("long").alias("doc_id"), "type", "total", "enabled_n")


@_query(f"""WITH {_M}, n AS (SELECT doc_id, type, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['EMAIL', 'PHONE', 'SSN', 'ID', 'ORG'], type), start) - 1 AS id FROM m)
SELECT doc_id, type, CAST(count(*) FILTER (id % 2 = 1) AS BIGINT) AS enabled_n FROM n GROUP BY doc_id, type""")
def override_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other finding of each paper switched off by hand."""
    found = _raw(spark, sf_dir)
    chosen = detect.exploded(found).where("id % 2 = 0").select("paper_id", "id", F.lit(False).alias("enabled"))
    rows = reports.legend(detect.with_overrides(found, chosen))
    return rows.select(F.col("paper_id").cast("long").alias("doc_id"), "type", "enabled_n")


@_query("SELECT type, title, CAST(n AS BIGINT) AS n FROM (SELECT 'EMAIL' AS type, 'Emails' AS title, (SELECT count(*) FROM documents WHERE contains(text, '@')) AS n)")
def email_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the cheap test of the e-mail rule lets through, with the rule's title."""
    n = _table(spark, sf_dir, "documents").where(F.col("text").contains("@")).agg(F.count("*").alias("n")).withColumn("type", F.lit("EMAIL"))
    return n.join(F.broadcast(types_table(spark)), "type").select("type", "title", "n")  # 16 types


from . import notes  # noqa: E402, F401  registers its queries
