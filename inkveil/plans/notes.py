"""Queries over short notes made of the given tables: taggers, batch order, switches, versions of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, detect, perceptron, tagging, tags
from ..schema import papers
from ..sources import intake
from .queries import _KEY, _LETTERS, _PH, _letter_findings, _query, _table

# --- notes: a name that an echo makes longer and that is echoed again, places, an address with a name behind it -------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the parts of each customer's note, with the labels that a tagger is to find; the name is that of the part with the same number."""
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "part"), F.col("c_custkey") == F.col("p_partkey"))
    rows = rows.join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    word = lambda c, i: F.initcap(F.lower(F.split(c, " ")[i]))
    given, last, city, k = word("p_name", 0), word("p_name", 1), word("r_name", 0), F.col("c_custkey").cast("string")

    def made(*parts: tuple[Column | str, str | None]) -> Column:
        return F.array(*[F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(x).cast("string").alias("label")) for t, x in parts])

    even = made((given, "B-FIRSTNAME"), (" ", None), (last, "I-LASTNAME"), (" wrote. then ", None), (last, None), (" Carver came to ", None), (city, "B-CITY"), (" Valley. Ask X, and Carver left", None))
    odd = made(("Lives at ", None), (k, None), (" ", None), ("Alder", "B-STREET"), (" Brook Lane ", None), (given, "B-FIRSTNAME"), (" ", None), (last, "I-LASTNAME"), (", of ", None), (city, "B-CITY"), (".", None))
    return rows.select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd).alias("parts"))


def labelled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, spans (start, end, label)."""
    rows = _parts(spark, sf_dir)
    return rows.select("doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), perceptron.spans_from(F.col("parts")).alias("spans"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(labelled_notes(spark, sf_dir).withColumn("source", F.lit("note")))


def _trained(spark: SparkSession, sf_dir: str) -> tagging.Tagger:
    """A perceptron fitted on every fifth note."""
    return perceptron.perceptron_tagger(spark, perceptron.fit(labelled_notes(spark, sf_dir).where("doc_id % 5 = 0")))


_INITCAP = "upper({0}[1]) || lower({0}[2:])"
_NAMES = f"""p AS (SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS k, {_INITCAP.format("split_part(p_name, ' ', 1)")} AS g, {_INITCAP.format("split_part(p_name, ' ', 2)")} AS l, {_INITCAP.format("split_part(r_name, ' ', 1)")} AS c
  FROM customer JOIN part ON c_custkey = p_partkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _placed(even: str, odd: str) -> str:
    """SQL: the listed pieces of each note with their places."""
    return f"""{_NAMES}, q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {even} ELSE {odd} END AS z FROM p),
fin AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS id, z[i].type AS type, z[i].source AS source, z[i].t AS surface,
  CAST(coalesce(list_sum(list_transform(z[1:i - 1], lambda x: length(x.pre) + length(x.t))), 0) + length(z[i].pre) AS INTEGER) AS s FROM q, unnest(range(1, len(z) + 1)) AS u(i))"""


def _piece(kind: str, source: str, before: str, text: str) -> str:
    return f"{{'type': '{kind}', 'source': '{source}', 'pre': {before}, 't': {text}}}"


_FOUND = _placed(
    "[" + ", ".join([_piece("NAME", "model", "''", "g || ' ' || l"), _piece("NAME", "echo", "' wrote. then '", "l || ' Carver'"), _piece("CITY", "model", "' came to '", "c || ' Valley.'"), _piece("NAME", "echo", "' Ask X, and '", "'Carver'")]) + "]",
    "[" + ", ".join([_piece("ADDRESS", "model", "'Lives at '", "k || ' Alder Brook Lane'"), _piece("NAME", "model", "' '", "g || ' ' || l"), _piece("CITY", "model", "', of '", "c")]) + "]",
)
_FINDINGS = f'WITH {_FOUND} SELECT doc_id, id, type, s AS start, CAST(s + length(surface) AS INTEGER) AS "end", surface, source FROM fin'


def _rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("paper_ord").alias("doc_id"), "id", "type", "start", "end", "surface", "source")


@_query(_FINDINGS)
def note_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger of words that stops short: extension of names, places and addresses, neighbours, two rounds of echoes, and a name of one letter that goes."""
    rows = _table(spark, sf_dir, "part").select(F.initcap(F.split("p_name", " ")[0]).alias("w")).distinct().orderBy("w").limit(1000)
    given = [r["w"] for r in rows.collect()]  # a list of given names, at most 1,000
    tagger = tagging.list_tagger({"B-FIRSTNAME": [*given, "X"], "B-STREET": ["Alder"], "B-CITY": ["Africa", "America", "Asia", "Europe", "Middle"]})
    return _rows(detect.findings(_notes(spark, sf_dir), tagging.each_chunk(tagger)))


@_query(_FINDINGS)
def note_findings_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes by a trained tagger in an iterator UDF."""
    return _rows(detect.findings(_notes(spark, sf_dir), _trained(spark, sf_dir)))


@_query("WITH " + _placed(
    "[" + ", ".join([_piece("NAME", "", "''", "g || ' ' || l"), _piece("CITY", "", "' wrote. then ' || l || ' Carver came to '", "c")]) + "]",
    "[" + ", ".join([_piece("ADDRESS", "", "'Lives at ' || k || ' '", "'Alder'"), _piece("NAME", "", "' Brook Lane '", "g || ' ' || l"), _piece("CITY", "", "', of '", "c")]) + "]",
) + ' SELECT doc_id, type, s AS start, CAST(s + length(surface) AS INTEGER) AS "end" FROM fin')
def trained_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trained tagger itself finds, before any step of detection."""
    rows = _notes(spark, sf_dir).withColumn("parts", chunks.chunk_text(F.col("text")))
    rows = rows.select("paper_ord", F.explode(tagging.model_findings(F.col("parts"), _trained(spark, sf_dir))).alias("f"))
    return rows.select(F.col("paper_ord").alias("doc_id"), "f.type", "f.start", "f.end")


@_query(r"""SELECT doc_id, type, CAST(len(regexp_extract_all(text, k)) AS BIGINT) AS n FROM (SELECT doc_id, text, unnest(['IPV4', 'NUMBER']) AS type, unnest(['\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '\b[0-9]{5}\b']) AS k FROM documents) WHERE regexp_matches(text, k)""")
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without offsets, located in their chunks by search from a cursor: each one's place has its word."""
    ipv4, number = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b\d{5}\b"
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    tokens = lambda rule: F.transform(F.regexp_extract_all("text", F.lit(rule), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit("B-PIN").alias("label"), F.lit(0.9).alias("score"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    out = None
    for kind, rule in (("IPV4", ipv4), ("NUMBER", number)):
        at = tagging.locate_tokens(F.col("text"), tokens(rule).cast(tagging.TOKENS))
        rows = docs.where(F.col("text").rlike(rule)).select("doc_id", F.lit(kind).alias("type"), "text", F.posexplode(at).alias("i", "t"), tokens(rule).alias("w"))
        good = F.substring("text", F.col("t.a") + 1, F.col("t.b") - F.col("t.a")) == F.get("w", F.col("i"))["word"]
        rows = rows.where(good).groupBy("doc_id", "type").agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- batches ------------------------------------------------------------------------------


_NAME = "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN upper(source) ELSE upper(source[1]) || source[2:] END || '.txt'"


@_query(f"""SELECT CAST(doc_id AS VARCHAR) AS paper_id, name, row_number() OVER (ORDER BY lower(name), translate(name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'), CAST(doc_id AS VARCHAR)) - 1 AS paper_ord
FROM (SELECT doc_id, {_NAME} AS name FROM documents)""")
def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each file of a batch by name, in Unicode collation: lower case before upper, by letters first."""
    k = F.col("doc_id") % 3
    name = F.concat(F.when(k == 0, F.col("source")).when(k == 1, F.upper("source")).otherwise(F.concat(F.upper(F.substring("source", 1, 1)), F.expr("substring(source, 2)"))), F.lit(".txt"))
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), name.alias("name"))
    return intake.in_batch_order(files, "corpus").select("paper_id", "name", "paper_ord")


_EXT = "['txt', 'exe', 'DOC', 'zip', 'pdf'][CAST(page_id % 5 AS INTEGER) + 1]"


@_query(f"""WITH f AS (SELECT lpad(CAST(page_id AS VARCHAR), 9, '0') || '.' || {_EXT} AS name FROM pages), r AS (SELECT name FROM f WHERE NOT regexp_matches(name, '\\.(txt|pdf)$'))
SELECT (SELECT count(*) FROM r) AS skipped_n, (SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT name FROM r ORDER BY name LIMIT 20)) AS names, false AS only_doc""")
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages, under names with endings, intake would leave out, and the first twenty of them."""
    ending = F.get(F.array(*[F.lit(x) for x in ("txt", "exe", "DOC", "zip", "pdf")]), (F.col("page_id") % 5).cast("int"))
    files = _table(spark, sf_dir, "pages").select(F.concat(F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit("."), ending).alias("name"))
    return intake.skipped(files)


_BLANKS = "CASE doc_id % 4 WHEN 0 THEN chr(10) || chr(9) WHEN 1 THEN ' ' || chr(160) || chr(12288) WHEN 2 THEN '' ELSE text END"


@_query(f"SELECT doc_id, CASE WHEN doc_id % 4 < 3 OR trim(coalesce(text, '')) = '' THEN 'error' ELSE 'done' END AS status, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE length(coalesce(text, '')) END AS n FROM documents")
def blank_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of white space alone, of all kinds, are errors."""
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.expr(_BLANKS.replace("chr(12288)", "'　'").replace("chr(160)", "' '")))
    return papers(docs).select(F.col("paper_ord").alias("doc_id"), "status", F.length("text").cast("long").alias("n"))


# --- switches and versions --------------------------------------------------------------------


_TYPES9 = "['NAME', 'ADDRESS', 'NAME', 'NAME', 'SSN', 'ID', 'EMAIL', 'PHONE', 'ORG']"


@_query(f"""WITH RECURSIVE e AS (SELECT user_id AS doc_id, CASE WHEN event_type = 'click' THEN CAST(event_id % 9 AS INTEGER) END AS id, CASE event_id % 3 WHEN 0 THEN 'NAME' WHEN 1 THEN 'SSN' ELSE 'EMAIL' END AS type,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT c_custkey AS doc_id, 0 AS k, [true, true, true, true, true, true, true, true, true] AS s FROM customer
  UNION ALL SELECT r.doc_id, r.k + 1, list_transform(range(1, 10), lambda i: CASE WHEN e.id IS NOT NULL THEN s[i] <> (i - 1 = e.id)
    WHEN {_TYPES9}[i] = e.type THEN NOT list_bool_and(list_transform(range(1, 10), lambda j: {_TYPES9}[j] <> e.type OR s[j])) ELSE s[i] END)
  FROM r JOIN e ON e.doc_id = r.doc_id AND e.k = r.k + 1)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS id, {_TYPES9}[i] AS type, s[i] AS enabled FROM (SELECT doc_id, arg_max(s, k) AS s FROM r GROUP BY doc_id), unnest(range(1, 10)) AS t(i)""")
def toggle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters after a log of switches, of findings and of whole categories, in the order of the events."""
    events = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "NAME").when(F.col("event_id") % 3 == 1, "SSN").otherwise("EMAIL")
    click = F.col("event_type") == "click"
    log = events.select(F.col("user_id").cast("string").alias("paper_id"), F.col("event_id").alias("seq"), F.when(click, (F.col("event_id") % 9).cast("int")).alias("id"), F.when(~click, kind).alias("type"))
    rows = detect.replayed(_letter_findings(spark, sf_dir)[0], log)
    return detect.exploded(rows).select(F.col("paper_ord").alias("doc_id"), "id", "type", "enabled")


def _numbered(name: str, where: str) -> str:
    return f"""{name} AS (SELECT key.*, '[' || {_PH} || CASE WHEN d > 1 THEN ' ' || n ELSE '' END || ']' AS tag FROM (SELECT * FROM keyed WHERE {where}) AS key JOIN
(SELECT type, key, row_number() OVER (PARTITION BY type ORDER BY spot) AS n, count(*) OVER (PARTITION BY type) AS d FROM (SELECT type, key, min((doc_id, s)) AS spot FROM keyed WHERE {where} GROUP BY type, key)) USING (type, key))"""


@_query(f"""WITH {_LETTERS}, keyed AS (SELECT *, {_KEY.format(s="surface")} AS key FROM fin), {_numbered("one", "doc_id % 2 = 0")}, {_numbered("two", "true")},
m AS (SELECT 1 AS export_id, doc_id, s, tag, surface FROM one WHERE type <> 'ID' UNION ALL SELECT 2, doc_id, s, tag, surface FROM one WHERE type <> 'ID' AND doc_id % 3 <> 0 UNION ALL SELECT 2, doc_id, s, tag, surface FROM two WHERE doc_id % 3 = 0)
SELECT CAST(export_id AS BIGINT) AS export_id, tag, arg_min(surface, (doc_id, s)) AS original FROM m GROUP BY export_id, tag""")
def export_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tag stood for after each of two exports: every second letter without numbers, then every third one of the whole batch."""
    rows, found = _letter_findings(spark, sf_dir)
    half = found.where("paper_ord % 2 = 0")
    first = tags.export_version(rows.where("paper_ord % 2 = 0"), half.withColumn("enabled", F.col("type") != "ID"), tags.assign_tags(half), 1)
    again = tags.export_version(rows.where("paper_ord % 3 = 0"), found.where("paper_ord % 3 = 0"), tags.assign_tags(found), 2)
    exports, maps = (a.unionByName(b) for a, b in zip(first, again, strict=True))
    return tags.timeline(exports, maps).select("export_id", "tag", "original")
