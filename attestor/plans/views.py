"""The driver's tables as the model's entities. Each view is a projection (or one window) with a SQL twin in SQL.

All modulus rules are arbitrary; they only reach every branch of the operators, deterministically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import text as X
from ..operators.nearest import nearest
from ..schemas import RELATION_KINDS, ROLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sources(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), X.source_id(path).alias("source_id"), F.sha2("text", 256).alias("content_hash"), "text", "lang", "source")


def files(spark, sf_dir) -> DataFrame:
    """Sources beside pages, which this engine's parser does not support."""
    s = sources(spark, sf_dir).select("path", "text")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("web/"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return s.unionByName(p)


def snapshot(spark, sf_dir, which: str) -> DataFrame:
    """Two scans of the sources: the older lacks some and differs in some, the newer lacks others."""
    s = sources(spark, sf_dir)
    if which == "new":
        return s.filter("doc_id % 11 <> 0").select("doc_id", "path", "source_id", "text", "content_hash")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (first edition)"))).otherwise(F.col("text"))
    return s.filter("doc_id % 10 <> 0").select("doc_id", "path", "source_id", text.alias("text")).withColumn("content_hash", F.sha2("text", 256))


def profiles(spark, sf_dir) -> DataFrame:
    s = sources(spark, sf_dir).select("doc_id", "source_id", "lang", "source")
    p = table(spark, sf_dir, "labels").select("doc_id", "quality").join(s, "doc_id")
    k = F.col("doc_id")
    return p.select(
        "doc_id", "source_id", F.concat(F.lit("D"), (k % 150).cast("string")).alias("document_id"), (k % 3).cast("string").alias("revision"), _pick(ROLES, k).alias("role"),
        _pick(("mandatory", "recommended", "informational"), k).alias("level"), (k % 11).cast("int").alias("authority_rank"), (F.col("quality") == 1).alias("approved"),
        S.scope_of(products=F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")), sites=F.when(k % 4 == 0, F.array("source"))).alias("scope"),
        F.when(k % 5 == 0, F.lit("2024-01-15")).when(k % 17 == 0, F.lit("soon")).alias("valid_from"), F.when(k % 6 == 0, F.lit("2024-06-30")).when(k % 19 == 0, F.lit("30 days")).alias("valid_to"), F.lit(None).cast("string").alias("observed_at"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("official_record"),
    )


def claims(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select(
        F.concat(F.lit("clm_"), F.substring(F.sha2(k.cast("string"), 256), 1, 32)).alias("id"), F.concat(F.when(k % 5 == 0, "the customer ").otherwise("customer "), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("subject"),
        F.lit("order_status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit(None).cast("string").alias("condition"), day("o_orderdate").alias("valid_from"), day(F.date_add("o_orderdate", 90)).alias("valid_to"),
        F.col("o_orderpriority").alias("authority"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "proposed").alias("status"), F.lit(0.9).cast("float").alias("confidence"),
        F.array(F.struct(F.concat(F.lit("src_"), (k % 500).cast("string")).alias("source_id"), F.concat(F.lit("ev_"), k.cast("string")).alias("evidence_id"))).alias("evidence"), k.alias("order_key"),
    )


def retrieved(spark, sf_dir) -> DataFrame:
    """The 20 vectors of a query's own label that are nearest to it by cosine: (query_id, vec_id, rank, relevance)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return nearest(v, v.filter("vec_id % 25 = 0"), 20).select("query_id", "vec_id", "rank", "relevance")


def candidates(spark, sf_dir) -> DataFrame:
    """Retrieved vectors as candidates: the source is the document of the same number."""
    s = sources(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "source_id")
    return retrieved(spark, sf_dir).join(s, "vec_id").select(F.concat(F.lit("case"), F.col("query_id").cast("string")).alias("case_id"), F.col("rank").cast("long").alias("ordinal"), "source_id", "relevance")


def contexts(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 25 = 0").select(F.col("vec_id").alias("k"))
    k = F.col("k")
    return q.select(
        F.concat(F.lit("case"), k.cast("string")).alias("case_id"), F.lit("review").alias("intent_id"), F.when(k % 4 != 3, F.lit("2024-03-01")).alias("as_of"),
        F.when(k % 2 == 0, F.array(F.lit("normative"), F.lit("instruction"), F.lit("record"))).otherwise(F.array(F.lit("analysis"), F.lit("reference"), F.lit("normative"))).alias("requested_roles"), F.array(F.lit("c1"), F.lit("c2")).alias("requested_clauses"),
        S.scope_of(products=F.when(k % 3 == 0, F.array(F.lit("en"), F.lit("de"))).when(k % 3 == 1, F.array(F.lit("fr"), F.lit("en"))).otherwise(F.array().cast("array<string>"))).alias("scope"),
    )


def relations(spark, sf_dir) -> DataFrame:
    """Each document and the next of its source and language."""
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    s = sources(spark, sf_dir).select("doc_id", "source_id", F.lead("source_id").over(w).alias("target_id"), F.lead("doc_id").over(w).alias("t"))
    k = F.col("doc_id")
    clause = lambda c: F.array(F.concat(F.lit("c"), (c % 5).cast("string")))
    return s.filter("target_id IS NOT NULL").select(
        F.concat(F.lit("rel_"), F.lpad(k.cast("string"), 8, "0")).alias("id"), _pick(RELATION_KINDS, k).alias("kind"), _pick(("dominates", "conditional", "non_effective", "unresolved"), F.floor(k / 13)).alias("position"), "source_id", "target_id",
        clause(k).alias("source_clauses"), clause(F.col("t")).alias("target_clauses"), S.scope_of().alias("scope"), F.when(k % 8 == 0, F.lit("2024-02-01")).alias("valid_from"), F.when(k % 9 == 0, F.lit("2024-02-15")).when(k % 23 == 0, F.lit("later")).alias("valid_to"), "doc_id",
    )


def first_line(text):
    """Empty for a text without any line."""
    return F.coalesce(F.try_element_at(X.lines(text), F.lit(1)), F.lit(""))


def markdown(spark, sf_dir) -> DataFrame:
    """Markdown documents made of each source's first line: front matter, headings, a paragraph, a checklist."""
    s = sources(spark, sf_dir)
    k = F.col("doc_id").cast("string")
    status = F.when(F.col("doc_id") % 3 == 0, "approved").when(F.col("doc_id") % 3 == 1, "null").otherwise("'draft'")
    first = first_line(F.col("text"))
    owner = F.when(F.col("doc_id") % 4 == 0, " 担当: A").otherwise("")
    head = F.concat(F.lit("---\ndocument_id: D"), k, F.lit("\nstatus: "), status, F.lit('\nscope: {"products": ["'), "lang", F.lit('", "all"], "organization": "'), "source", F.lit('"}\n---\n'))
    body = F.concat(F.lit("# Document "), k, F.lit("\n\n"), first, F.lit("\n\n## Tasks\n- [ ] read"), owner, F.lit("\n- [x] sign\n\n### Deep\nlast line\n# End\nbye\n"))
    path = F.regexp_replace("path", "txt$", "md")
    return s.select("doc_id", path.alias("path"), X.source_id(path).alias("source_id"), F.concat(head, body).alias("text"), "lang", "source", first.alias("first"))


SRC = """src AS (SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path,
  'src_' || substr(sha256(source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt'), 1, 16) AS source_id,
  sha256(text) AS content_hash, text, lang, source FROM documents)"""
FILES = """files AS (SELECT path, text FROM src UNION ALL SELECT 'web/' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.html', html FROM pages)"""
SNAP = """snew AS (SELECT doc_id, path, source_id, text, content_hash FROM src WHERE doc_id % 11 <> 0),
sold AS (SELECT doc_id, path, source_id, CASE WHEN doc_id % 7 = 0 THEN text || ' (first edition)' ELSE text END AS text,
  sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' (first edition)' ELSE text END) AS content_hash FROM src WHERE doc_id % 10 <> 0)"""
PROF = """prof AS (SELECT l.doc_id, s.source_id, 'D' || (l.doc_id % 150) AS document_id, CAST(l.doc_id % 3 AS VARCHAR) AS revision,
  ['normative','instruction','record','analysis','proposal','communication','reference'][1 + l.doc_id % 7] AS role,
  ['mandatory','recommended','informational'][1 + l.doc_id % 3] AS level, CAST(l.doc_id % 11 AS INTEGER) AS authority_rank, quality = 1 AS approved,
  CASE WHEN l.doc_id % 9 = 0 THEN [] ELSE [s.lang] END AS products, CASE WHEN l.doc_id % 4 = 0 THEN [s.source] ELSE [] END AS sites,
  CASE WHEN l.doc_id % 5 = 0 THEN '2024-01-15' WHEN l.doc_id % 17 = 0 THEN 'soon' END AS valid_from,
  CASE WHEN l.doc_id % 6 = 0 THEN '2024-06-30' WHEN l.doc_id % 19 = 0 THEN '30 days' END AS valid_to,
  CASE WHEN l.doc_id % 3 = 0 THEN true WHEN l.doc_id % 3 = 1 THEN false END AS official_record
  FROM labels l JOIN src s USING (doc_id))"""
CLAIM = """claim AS (SELECT 'clm_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32) AS id, o_custkey, o_orderkey, o_orderstatus AS object,
  strftime(o_orderdate, '%Y-%m-%d') AS valid_from, strftime(CAST(o_orderdate AS DATE) + 90, '%Y-%m-%d') AS valid_to, o_orderpriority AS authority,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'proposed' END AS status, 'src_' || (o_orderkey % 500) AS source_id, 'ev_' || o_orderkey AS evidence_id FROM orders)"""
RETRIEVED = """vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 9) AS relevance FROM vec q JOIN vec c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0),
retrieved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS rank FROM near) WHERE rank <= 20)"""
CAND = """cand AS (SELECT 'case' || query_id AS case_id, query_id AS k, rank AS ordinal, s.source_id, relevance FROM retrieved r JOIN src s ON s.doc_id = r.vec_id),
ctx AS (SELECT 'case' || vec_id AS case_id, vec_id AS k, CASE WHEN vec_id % 4 <> 3 THEN '2024-03-01' END AS as_of,
  CASE WHEN vec_id % 2 = 0 THEN ['normative','instruction','record'] ELSE ['analysis','reference','normative'] END AS roles,
  CASE vec_id % 3 WHEN 0 THEN ['en','de'] WHEN 1 THEN ['fr','en'] ELSE [] END AS products FROM embeddings WHERE vec_id % 25 = 0)"""
REL = """rel AS (SELECT 'rel_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, doc_id, t AS t_doc, source_id, target_id,
  ['operational_position','supersedes','amends','proposes_change_to','applies_to','exception_to','conflicts_with','evaluates','approves','implements_decision','records_execution_of','order_of_precedence','derived_from'][1 + doc_id % 13] AS kind,
  ['dominates','conditional','non_effective','unresolved'][1 + (doc_id // 13) % 4] AS position, 'c' || (doc_id % 5) AS sc, 'c' || (t % 5) AS tc,
  CASE WHEN doc_id % 8 = 0 THEN '2024-02-01' END AS valid_from, CASE WHEN doc_id % 9 = 0 THEN '2024-02-15' WHEN doc_id % 23 = 0 THEN 'later' END AS valid_to
  FROM (SELECT doc_id, source_id, lead(source_id) OVER w AS target_id, lead(doc_id) OVER w AS t FROM src WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)) WHERE target_id IS NOT NULL)"""
LINES = """lines AS (SELECT source_id, doc_id, line_no, line, 'ev_' || substr(sha256(source_id || ':' || line_no || ':' || line_no || ':' || sha256(line)), 1, 16) AS evidence_id
  FROM (SELECT source_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM src) WHERE trim(line) <> '')"""
MD = """md AS (SELECT doc_id, regexp_replace(path, 'txt$', 'md') AS path, 'src_' || substr(sha256(regexp_replace(path, 'txt$', 'md')), 1, 16) AS source_id, lang, source,
  string_split(text, chr(10))[1] AS first, CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'null' ELSE '''draft''' END AS status FROM src)"""


def sql(*parts: str, body: str) -> str:
    """WITH parts and a body; SRC comes first where anything needs it."""
    return "WITH " + ",\n".join(parts) + "\n" + body
