"""Every registered query of the governance operators and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import temporal as T
from ..functions import text as X
from ..operators import candidates as C
from ..operators import claims as CL
from ..operators import coverage as CV
from ..operators import evidence as E
from ..operators import export as EX
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import packets as P
from ..operators import parse as PA
from ..operators import relations as R
from ..operators import rerank as RR
from ..operators import resolve as RE
from ..sources import providers as PV
from ..sources import scan as SC
from . import fixtures as FX
from . import views as V
from .views import CAND, CLAIM, FILES, LINES, MD, PROF, REL, RETRIEVED, SNAP, SRC, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-03-01"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# --- scan ---------------------------------------------------------------------------------------------------------


@query(sql(SRC, FILES, body="""
SELECT f.path, 'src_' || substr(sha256(f.path), 1, 16) AS source_id, sha256(text) AS content_hash, regexp_extract(f.path, '\\.([^.]+)$', 1) AS format,
  CASE WHEN f.path <> m.p THEN 'duplicate' WHEN f.path LIKE '%.txt' THEN 'parsed' ELSE 'unsupported' END AS state, CASE WHEN f.path <> m.p THEN m.p END AS duplicate_of
FROM files f JOIN (SELECT sha256(text) AS h, min(path) AS p FROM files GROUP BY 1) m ON m.h = sha256(f.text)"""))
def scan_states(spark, sf_dir):
    f = SC.mark_duplicates(SC.inspect(V.files(spark, sf_dir), F.col("text")))
    return f.select("path", "source_id", "content_hash", "format", "state", "duplicate_of")


@query(sql(SRC, body="""
SELECT path, CAST(strlen(text) AS BIGINT) AS size_bytes, CASE WHEN strlen(text) > 3000 THEN 'error' ELSE 'parsed' END AS state FROM src"""))
def inspect_file(spark, sf_dir):
    return SC.inspect(V.sources(spark, sf_dir).select("path", "text"), F.col("text"), max_bytes=3000).select("path", "size_bytes", "state")


@query(sql(SRC, SNAP, body="""
SELECT n.path, CASE WHEN o.path IS NULL THEN 'added' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM snew n LEFT JOIN sold o USING (path)"""))
def scan_changes(spark, sf_dir):
    return SC.changes(V.snapshot(spark, sf_dir, "new"), V.snapshot(spark, sf_dir, "old")).select("path", "change")


@query(sql(SRC, SNAP, body="SELECT path FROM sold WHERE path NOT IN (SELECT path FROM snew)"))
def scan_removed(spark, sf_dir):
    return SC.removed(V.snapshot(spark, sf_dir, "new"), V.snapshot(spark, sf_dir, "old"))


@query(sql(SRC, SNAP, body="""
SELECT count(*) AS total, count(*) FILTER (s = 'parsed') AS parsed, count(*) FILTER (s = 'duplicate') AS duplicates, count(*) FILTER (s = 'unsupported') AS unsupported,
  count(*) FILTER (s = 'error') AS errors, count(*) FILTER (c = 'added') AS added, count(*) FILTER (c = 'changed') AS changed, count(*) FILTER (c = 'unchanged') AS unchanged,
  CAST(sum(b) AS BIGINT) AS bytes_scanned, (SELECT count(*) FROM sold WHERE path NOT IN (SELECT path FROM snew)) AS removed
FROM (SELECT CASE WHEN n.path <> min(n.path) OVER (PARTITION BY n.content_hash) THEN 'duplicate' ELSE 'parsed' END AS s, strlen(n.text) AS b,
  CASE WHEN o.path IS NULL THEN 'added' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS c FROM snew n LEFT JOIN sold o USING (path))"""))
def scan_summary(spark, sf_dir):
    new, old = V.snapshot(spark, sf_dir, "new"), V.snapshot(spark, sf_dir, "old")
    scanned = SC.changes(SC.mark_duplicates(SC.inspect(new.select("path", "text"), F.col("text"))), old)
    return SC.summary(scanned, SC.removed(new, old))


@query(sql(SRC, SNAP, body="""
SELECT n.path, o.path IS NOT NULL AND o.content_hash = n.content_hash AND o.doc_id % 2 = 0 AS cache_hit FROM snew n LEFT JOIN sold o USING (path)"""))
def parse_cache_join(spark, sf_dir):
    old = V.snapshot(spark, sf_dir, "old").select("path", "content_hash", F.lit("parsed").alias("state"), F.when(F.col("doc_id") % 2 == 0, "p1").otherwise("p0").alias("parser_key"))
    return SC.parse_cache(V.snapshot(spark, sf_dir, "new").withColumn("state", F.lit("parsed")), old, "p1").select("path", "cache_hit")


@query(sql(SRC, SNAP, body="""
SELECT coalesce(n.path, o.path) AS path, coalesce(n.content_hash, o.content_hash) AS content_hash, CASE WHEN n.path IS NULL THEN 'removed' ELSE 'parsed' END AS state,
  CASE WHEN n.path IS NULL THEN 'scan-1' ELSE 'scan-2' END AS last_seen_scan, CASE WHEN o.path IS NULL THEN 'scan-2' ELSE 'scan-1' END AS first_seen_scan, CASE WHEN n.path IS NULL OR n.content_hash = o.content_hash THEN 'scan-1' ELSE 'scan-2' END AS changed_scan,
  coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN n.path IS NOT NULL THEN CAST(strlen(n.text) AS BIGINT) ELSE 0 END AS size_bytes, CASE WHEN n.path IS NOT NULL THEN 'txt' END AS format FROM snew n FULL JOIN sold o ON n.path = o.path"""))
def catalog_upsert(spark, sf_dir):
    scans = [F.lit("scan-1").alias(c) for c in ("first_seen_scan", "last_seen_scan", "changed_scan")]
    old = V.snapshot(spark, sf_dir, "old").select("path", "source_id", "content_hash", F.lit("parsed").alias("state"), *scans)
    new = V.snapshot(spark, sf_dir, "new").select("path", F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_at"))
    out = SC.upsert(old, SC.inspect_content(new), "scan-2")
    return out.select("path", "source_id", "content_hash", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "format", "state", "first_seen_scan", "last_seen_scan", "changed_scan")


_FILES = [("a.md", b"# x"), ("b.txt", "caf\u00e9".encode()), ("c.txt", b"\xff\xfe\x00"), ("d.png", b"\x89PNG\xff"), ("e.md", b" \n\t"), ("f.txt", b""), ("g.markdown", b"0123456789" * 3), ("h", b"x")]


@query(FX.values([
    ("a.md", "parsed", "", "# x", 3, "44647510631c98185d84603cb34a79e028914924a4a03db8ce04f7b49504486f"), ("b.txt", "parsed", "", "caf\u00e9", 5, ""), ("c.txt", "error", "no UTF-8", None, 3, ""), ("d.png", "unsupported", "", None, 5, ""), ("e.md", "error", "empty", None, 3, ""),
    ("f.txt", "error", "empty", None, 0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("g.markdown", "error", "beyond the size limit", None, 30, ""), ("h", "unsupported", "", None, 1, ""),
], "path, state, warnings, text, size_bytes, content_hash"))
def inspect_bytes(spark, sf_dir):
    f = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in _FILES], "path string, content binary, size_bytes long").withColumn("modified_at", F.lit(None).cast("timestamp"))
    known = F.when(F.col("path").isin("a.md", "f.txt"), F.col("content_hash")).otherwise("")
    return SC.inspect_content(f, max_bytes=20).select("path", "state", F.array_join("warnings", ",").alias("warnings"), "text", "size_bytes", known.alias("content_hash"))


@query(sql(SRC, FILES, body="""
, m AS (SELECT sha256(text) AS h, min(path) AS p FROM files GROUP BY 1)
SELECT 'src_' || substr(sha256(p), 1, 16) AS source_id, string_agg(path, ',' ORDER BY path) AS aliases FROM files JOIN m ON m.h = sha256(text) WHERE path <> p GROUP BY p"""))
def duplicate_aliases(spark, sf_dir):
    f = SC.mark_duplicates(SC.inspect(V.files(spark, sf_dir), F.col("text")))
    return SC.duplicate_aliases(f).select("source_id", F.array_join("aliases", ",").alias("aliases"))


@query(sql(SRC, FILES, body="SELECT path FROM files WHERE (path LIKE 'src1%/en/%' OR path LIKE 'web/%') AND path NOT LIKE '%7.txt'"))
def glob_filter(spark, sf_dir):
    return SC.glob_filter(V.files(spark, sf_dir), ["src1*/en/**", "web/*"], ["**/*7.txt"]).select("path")


# --- parse and evidence -------------------------------------------------------------------------------------------


@query(sql(SRC, LINES, body="SELECT source_id, evidence_id, CAST(line_no AS BIGINT) AS line_start, CAST(line_no AS BIGINT) AS line_end, line AS text FROM lines"))
def evidence_lines(spark, sf_dir):
    return PA.evidence_lines(V.sources(spark, sf_dir))


_MD_UNITS = """, units AS (
SELECT doc_id, source_id, 'metadata' AS kind, 1 AS a, 5 AS b, '---' || chr(10) || 'document_id: D' || doc_id || chr(10) || 'status: ' || status || chr(10) || 'scope: {"products": ["' || lang || '", "all"], "organization": "' || source || '"}' || chr(10) || '---' AS text, '' AS hp FROM md
UNION ALL SELECT doc_id, source_id, 'heading', 6, 6, '# Document ' || doc_id, 'Document ' || doc_id FROM md
UNION ALL SELECT doc_id, source_id, 'paragraph', 8, 8, first, 'Document ' || doc_id FROM md WHERE trim(first) <> ''
UNION ALL SELECT doc_id, source_id, 'heading', 10, 10, '## Tasks', 'Document ' || doc_id || ' > Tasks' FROM md
UNION ALL SELECT doc_id, source_id, 'list', 11, 12, '- [ ] read' || CASE WHEN doc_id % 4 = 0 THEN ' 担当: A' ELSE '' END || chr(10) || '- [x] sign', 'Document ' || doc_id || ' > Tasks' FROM md
UNION ALL SELECT doc_id, source_id, 'heading', 14, 14, '### Deep', 'Document ' || doc_id || ' > Tasks > Deep' FROM md
UNION ALL SELECT doc_id, source_id, 'paragraph', 15, 15, 'last line', 'Document ' || doc_id || ' > Tasks > Deep' FROM md
UNION ALL SELECT doc_id, source_id, 'heading', 16, 16, '# End', 'End' FROM md
UNION ALL SELECT doc_id, source_id, 'paragraph', 17, 17, 'bye', 'End' FROM md)
, unit AS (SELECT *, 'ev_' || substr(sha256(source_id || ':' || a || ':' || b || ':' || sha256(text)), 1, 16) AS evidence_id FROM units)"""


@query(sql(SRC, MD, body=_MD_UNITS + "SELECT source_id, evidence_id, kind, CAST(a AS BIGINT) AS line_start, CAST(b AS BIGINT) AS line_end, text, hp AS heading_path FROM unit"))
def parse_markdown(spark, sf_dir):
    return PA.parse_markdown(V.markdown(spark, sf_dir)).withColumn("heading_path", F.array_join("heading_path", " > "))


@query(sql(SRC, MD, body=_MD_UNITS + "SELECT source_id, 'Document ' || doc_id AS title FROM md"))
def document_titles(spark, sf_dir):
    return PA.titles(PA.parse_markdown(V.markdown(spark, sf_dir)))


@query(sql(SRC, body=""", t AS (SELECT source_id, string_split(text, chr(10)) AS ls FROM src)
, blocks AS (SELECT source_id, 1 AS a, 2 AS b, 'one' || chr(10) || ls[1] AS text FROM t UNION ALL SELECT source_id, 4, 4, 'two' FROM t UNION ALL SELECT source_id, 7, 8, 'three' || chr(10) || 'four' FROM t)
SELECT source_id, 'ev_' || substr(sha256(source_id || ':' || a || ':' || b || ':' || sha256(text)), 1, 16) AS evidence_id, 'text' AS kind, CAST(a AS BIGINT) AS line_start, CAST(b AS BIGINT) AS line_end, text FROM blocks"""))
def parse_blocks(spark, sf_dir):
    s = V.sources(spark, sf_dir)
    text = F.concat(F.lit("one\n"), V.first_line(F.col("text")), F.lit("\n\ntwo\n \n\t\nthree\r\nfour\n"))
    return PA.parse_text(s.select("source_id", "path", text.alias("text"))).drop("heading_path")


@query(sql(SRC, MD, body="""SELECT source_id, 'D' || doc_id AS document_id, CASE status WHEN 'null' THEN NULL WHEN '''draft''' THEN 'draft' ELSE status END AS status,
  CASE WHEN lang < 'all' THEN lang || ',all' ELSE 'all,' || lang END AS products, source AS entities FROM md"""))
def front_matter_fields(spark, sf_dir):
    m, t = V.markdown(spark, sf_dir), F.col("text")
    scope = X.front_matter_scope(t)
    return m.select("source_id", X.front_matter_value(t, "document_id").alias("document_id"), X.front_matter_value(t, "status").alias("status"), F.array_join(scope["products"], ",").alias("products"), F.array_join(scope["entities"], ",").alias("entities"))


@query(sql(SRC, MD, body=_MD_UNITS + "SELECT evidence_id, CASE m.status WHEN 'null' THEN NULL WHEN '''draft''' THEN 'draft' ELSE m.status END AS lifecycle FROM unit u JOIN md m USING (source_id)"))
def metadata_broadcast(spark, sf_dir):
    return E.propagate_metadata(PA.parse_markdown(V.markdown(spark, sf_dir))).select("evidence_id", "lifecycle")


@query(sql(SRC, FILES, body="""
SELECT path, CASE WHEN path LIKE 'src1/%' THEN 'corporate_standard' WHEN path LIKE 'src1%' THEN 'record' WHEN path LIKE '%/en/%' THEN 'guidance' END AS authority, CASE WHEN path LIKE 'web/%' THEN 'draft' WHEN path LIKE 'src2%' THEN 'active' END AS lifecycle FROM files"""))
def authority_hints(spark, sf_dir):
    hints = [("**/en/*", "guidance", None), ("src2*", None, "active"), ("src1*", "record", None), ("src1/**", "corporate_standard", None), ("web/*", None, "draft")]
    return E.authority_hints(V.files(spark, sf_dir).select("path"), hints)


@query(sql(SRC, LINES, body=""", o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM lines)
, b AS (SELECT source_id, n, unnest(range(0, CASE WHEN n <= 12 THEN 1 ELSE CAST(ceil((n - 12) / 10.0) AS BIGINT) + 1 END)) AS batch FROM (SELECT DISTINCT source_id, n FROM o))
SELECT o.source_id, CAST(batch AS INTEGER) AS batch, evidence_id, CAST(i AS INTEGER) AS ordinal FROM o JOIN b ON o.source_id = b.source_id AND i >= batch * 10 AND i < batch * 10 + 12"""))
def sliding_batches(spark, sf_dir):
    return E.sliding_batches(PA.evidence_lines(V.sources(spark, sf_dir)))


@query(sql(SRC, MD, body=_MD_UNITS + "SELECT source_id, evidence_id, 'Tasks' AS heading, '- [x] sign' AS line FROM unit WHERE kind = 'list' AND doc_id % 4 = 0"))
def checklist_gaps(spark, sf_dir):
    return E.checklist_gaps(PA.parse_markdown(V.markdown(spark, sf_dir)))


_PROFILE_TERMS = "amend 例外 conflict 修正 supersed 優先 derived 決定 旧版 準拠 参照 反映していない exception 実施 更新 改訂 precedence 承認 uncontrolled 現行 終了 正式 由来 適用 矛盾 食い違 置き換 記録".split() + ["system of record"]
_SIGNALS = " + ".join(f"CAST(contains(lower(line), '{t}') AS INTEGER)" for t in _PROFILE_TERMS)


@query(sql(SRC, LINES, body=f"""SELECT source_id, evidence_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, line_no) AS r
FROM (SELECT *, greatest(0, CASE WHEN starts_with(ltrim(line), '---') THEN 1000 ELSE 0 END + 20 * ({_SIGNALS}) - CASE WHEN starts_with(ltrim(line), '#') THEN 5 ELSE 0 END) AS score FROM lines)) WHERE r <= 8"""))
def profile_evidence_top8(spark, sf_dir):
    u = PA.evidence_lines(V.sources(spark, sf_dir)).withColumn("heading_path", F.array().cast("array<string>"))
    return E.top_evidence(u, E.profile_score(F.col("text"), F.col("heading_path")), 8).select("source_id", "evidence_id", "score", "rank")


_PROFILE_UNITS = [
    (1, "---\nstatus: 承認\n---", []), (2, "現行の規則を改訂し、旧版を置き換える", ["改訂の記録"]), (3, "# 適用", ["適用"]), (4, "この節では例外を述べる", ["例外"]), (5, "# plain", []),
    (6, "The System of Record SUPERSEDES uncontrolled copies; conflicts follow precedence", ["Amendments"]), (7, "nothing here", []),
]


@query(FX.values([(1, 1020), (2, 102), (3, 17), (4, 17), (5, 0), (6, 122), (7, 0)], "id, score"))
def profile_score_cases(spark, sf_dir):
    u = spark.createDataFrame(_PROFILE_UNITS, "id int, text string, heading_path array<string>")
    return u.select("id", E.profile_score(F.col("text"), F.col("heading_path")).alias("score"))


@query(sql(SRC, body="""SELECT doc_id, len(list_distinct(list_transform(range(1, CAST(length(t) - 6 AS BIGINT)), lambda i: substr(t, i, 8)))) AS n
FROM (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM src) WHERE length(t) >= 8"""))
def char_shingles(spark, sf_dir):
    return V.sources(spark, sf_dir).select("doc_id", X.shingle_count(F.col("text")).alias("n")).filter("n > 0")


_PHRASE_ROWS = [(1, "「受付期限」は「短」と「外「内側の句」"), (2, "句なし"), (3, "「同じ語句」と「同じ語句」と「別の語句」"), (4, ""), (5, "「開いたまま")]


@query("SELECT * FROM (VALUES (1, '受付期限,内側の句'), (2, ''), (3, '同じ語句,別の語句'), (4, ''), (5, '')) t(id, phrases)")
def quoted_phrases(spark, sf_dir):
    return spark.createDataFrame(_PHRASE_ROWS, "id int, text string").select("id", F.array_join(X.quoted_phrases(F.col("text")), ",").alias("phrases"))


# --- claims -------------------------------------------------------------------------------------------------------


@query(sql(CLAIM, body="""SELECT id, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'subject_required' END, CASE WHEN o_orderkey % 11 = 0 THEN 'confidence_out_of_range' END, CASE WHEN o_orderkey % 13 = 0 THEN 'valid_from_invalid' END,
  CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0 THEN 'valid_range_reversed' END, CASE WHEN o_orderkey % 3 = 0 THEN 'evidence_unknown' END) AS reasons FROM claim"""))
def claim_rejections(spark, sf_dir):
    c, k = V.claims(spark, sf_dir), F.col("order_key")
    bent = c.withColumns({"subject": F.when(k % 7 == 0, "  ").otherwise(F.col("subject")), "confidence": F.when(k % 11 == 0, F.lit(1.5)).otherwise(F.col("confidence")), "valid_from": F.when(k % 13 == 0, "soon").otherwise(F.col("valid_from")), "valid_to": F.when(k % 17 == 0, "1970-01-01").otherwise(F.col("valid_to"))})
    known = c.filter("order_key % 3 <> 0").select(F.explode("evidence").alias("r")).select("r.source_id", "r.evidence_id")
    return CL.rejections(bent, known).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH g AS (SELECT o_custkey, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi, min(o_orderstatus) AS slo, max(o_orderstatus) AS shi FROM orders GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN lo = hi THEN lo END AS authority, CASE WHEN slo = shi THEN slo END AS status FROM g""")
def claim_source_metadata(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    ref = F.struct(F.lit("s").alias("source_id"), F.col("o_orderkey").cast("string").alias("evidence_id"))
    c = o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.collect_list(ref).alias("evidence"))
    e = o.select(F.lit("s").alias("source_id"), F.col("o_orderkey").cast("string").alias("evidence_id"), F.col("o_orderpriority").alias("authority"), F.col("o_orderstatus").alias("lifecycle"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    return CL.evidence_metadata(c, e).select("id", "authority", "status")


_PAIRS = """, pairs AS (SELECT a.id AS l_id, b.id AS r_id, a.object AS lo, b.object AS ro, a.valid_from AS lf, a.valid_to AS lt, b.valid_from AS rf, b.valid_to AS rt, a.authority AS la, b.authority AS ra, a.status AS ls, b.status AS rs
  FROM claim a JOIN claim b ON a.o_custkey = b.o_custkey AND a.id < b.id AND a.object <> b.object)"""


@query(sql(CLAIM, body=_PAIRS + "SELECT l_id, r_id, lo AS l_object, ro AS r_object FROM pairs"))
def conflict_pairs(spark, sf_dir):
    return CL.conflict_pairs(V.claims(spark, sf_dir)).select("l_id", "r_id", "l_object", "r_object")


_RESOLVED = _PAIRS + f""", act AS (SELECT *, lf <= '{AS_OF}' AND lt >= '{AS_OF}' AS lact, rf <= '{AS_OF}' AND rt >= '{AS_OF}' AS ract, lt < rf OR rt < lf AS dis,
  CASE ls WHEN 'approved' THEN 0 WHEN 'proposed' THEN 1 END AS lst, CASE rs WHEN 'approved' THEN 0 WHEN 'proposed' THEN 1 END AS rst,
  nullif(list_position(['1-URGENT','2-HIGH','3-MEDIUM'], la), 0) AS lrk, nullif(list_position(['1-URGENT','2-HIGH','3-MEDIUM'], ra), 0) AS rrk FROM pairs)
, res AS (SELECT 'cfl_' || substr(sha256(l_id || ':' || r_id), 1, 24) AS conflict_id, l_id, r_id,
  CASE WHEN dis OR lact <> ract THEN 'temporal' WHEN lst <> rst THEN 'state' WHEN lrk <> rrk THEN 'authority' ELSE 'semantic' END AS kind,
  CASE WHEN dis OR lact <> ract OR coalesce(lst <> rst, false) OR coalesce(lrk <> rrk, false) THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN lact <> ract THEN CASE WHEN lact THEN l_id ELSE r_id END WHEN dis THEN NULL WHEN lst <> rst THEN CASE WHEN lst < rst THEN l_id ELSE r_id END WHEN lrk <> rrk THEN CASE WHEN lrk < rrk THEN l_id ELSE r_id END END AS winner FROM act)"""
_PRECEDENCE = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query(sql(CLAIM, body=_RESOLVED + "SELECT * FROM res"))
def conflict_resolution(spark, sf_dir):
    return CL.resolve_conflicts(CL.conflict_pairs(V.claims(spark, sf_dir)), AS_OF, _PRECEDENCE)


@query(sql(CLAIM, body=_RESOLVED + "SELECT conflict_id AS id, 'CST-UNRESOLVED-CONFLICT' AS code, 'warning' AS severity, l_id || ',' || r_id AS target_ids FROM res WHERE status = 'unresolved'"))
def unresolved_diagnostics(spark, sf_dir):
    c = conflict_resolution(spark, sf_dir).filter("status = 'unresolved'")
    return c.select(F.col("conflict_id").alias("id"), F.lit("CST-UNRESOLVED-CONFLICT").alias("code"), F.lit("warning").alias("severity"), F.concat_ws(",", "l_id", "r_id").alias("target_ids"))


@query(sql(CLAIM, body=_RESOLVED + "SELECT CAST(0 AS BIGINT) AS errors, count(*) FILTER (status = 'unresolved') AS warnings, CAST(0 AS BIGINT) AS infos, CASE WHEN count(*) FILTER (status = 'unresolved') > 0 THEN 'failed' ELSE 'completed' END AS status FROM res"))
def build_status(spark, sf_dir):
    return CL.build_status(unresolved_diagnostics(spark, sf_dir), F.col("warnings"), allowed=False)


_SCALARS = [
    (1, " 3 日 以内", "三日以内"), (2, "申請は10営業日以内とする", "10営業日以内"), (3, "2時間未満", "120分未満"), (4, "Yes", "yes "), (5, "五か月まで", "5か月以内"), (6, "期限なし", ""), (7, "7日間", "7日"), (8, "3日以内", "3日まで"), (9, "3日以上", "3日以内"),
    (10, "2時間超", "2 時間超"), (11, '["3日以内"]', '"3日まで"'), (12, "true", '"true"'), (13, '["a","b"]', '["a", "b"]'), (14, "日中は3日以内", "3日以内"), (15, "2週間以内", "14日以内"),
]


@query(FX.values([
    (1, "3:日:maximum", "3:日:maximum", True), (2, "10:営業日:maximum", "10:営業日:maximum", True), (3, "2:時間:less_than", "120:分:less_than", False), (4, None, None, True), (5, "5:か月:maximum", "5:か月:maximum", True), (6, None, None, False), (7, None, None, False),
    (8, "3:日:maximum", "3:日:maximum", True), (9, "3:日:minimum", "3:日:maximum", False), (10, "2:時間:greater_than", "2:時間:greater_than", True), (11, "3:日:maximum", "3:日:maximum", True), (12, None, None, False), (13, None, None, False), (14, None, "3:日:maximum", False), (15, "2:週間:maximum", "14:日:maximum", False),
], "id, left_duration, right_duration, equivalent"))
def scalar_equivalence(spark, sf_dir):
    d = spark.createDataFrame(_SCALARS, "id int, a string, b string")
    text = lambda c: X.duration_constraint(X.scalar_claim_text(F.col(c)))
    return d.select("id", text("a").alias("left_duration"), text("b").alias("right_duration"), X.objects_equivalent(F.col("a"), F.col("b")).alias("equivalent"))


@query(FX.values([
    *[(t, "instruction") for t in ("sow", "work_instruction", "procedure", "temporary_deviation", "implementation_plan", "site_work_instruction", "statement_of_work", "operating_procedure")],
    *[(t, "proposal") for t in ("vendor_proposal", "draft", "change_request", "proposal", "technical_draft")], ("faq", "communication"), *[(t, "analysis") for t in ("initial_report", "options_analysis", "analysis")],
    *[(t, "normative") for t in ("specification_amendment", "amendment", "master_agreement", "standard", "technical_specification", "policy", "specification", "master_contract")],
    *[(t, "record") for t in ("final_report", "release_record", "audit_record", "execution_log", "test_record", "decision_minutes", "approval_record", "decision_record")],
    *[(t, "reference") for t in ("incident_report", "manual", "notice", "Policy", "")],
], "document_type, role"))
def role_from_type(spark, sf_dir):
    types = [t for names in X.ROLE_TYPES.values() for t in names.split()] + ["incident_report", "manual", "notice", "Policy", ""]
    return spark.createDataFrame([(t,) for t in types], "document_type string").select("document_type", X.role_from_type(F.col("document_type")).alias("role"))


_CANDIDATES = [
    (1, "requires_review", "二名で確認", "急ぎ", None, "2024-01-01"), (2, "requires_review", "true", "急ぎ", None, None), (3, "allows_review_omission", '"軽微な変更"', None, None, None), (4, "allows_self_approval", "認めない", None, None, None),
    (5, "allows_self_approval", "部長に限り可", "x", None, None), (6, "deadline", "3日以内", None, "3営業日", "10 Business Days"), (7, "requires_review", "急ぎ", "急ぎ", None, None), (8, "allows_self_approval", "FALSE", None, None, "2か月以内"), (9, "allows_review_omission", "null", None, None, None),
]


@query(FX.values([
    (1, "true", "急ぎ; 二名で確認", None, "2024-01-01"), (2, "true", "急ぎ", None, None), (3, "true", "軽微な変更", None, None), (4, "false", None, None, None), (5, "true", "x", None, None), (6, "3日以内", None, None, None), (7, "true", "急ぎ", None, None), (8, "false", None, None, None), (9, "true", None, None, None),
], "id, object, condition, valid_from, valid_to"))
def candidate_semantics(spark, sf_dir):
    c = spark.createDataFrame(_CANDIDATES, "id int, predicate string, object string, condition string, valid_from string, valid_to string")
    return CL.semantics(c).select("id", "object", "condition", "valid_from", "valid_to")


@query(FX.values([
    ("status", True, False), ("has_status", False, False), (" Has_Status ", False, False), ("order_status", True, False), ("separate", False, False), ("statusquo", False, False), ("payment_deadline", True, True), ("deadlines", False, True), ("max_window_days", True, False), ("retention_period", True, False),
    ("requires_approval", True, True), ("allows_review_omission", False, True), ("access_duration", True, True), ("access_approver", True, True), ("incident_commander", True, True), ("has_formal_owner", True, False), ("owner", False, False), ("is_approved_as", True, True), ("version", True, False), ("is_required", True, False),
], "predicate, single, conditional"))
def predicate_slots(spark, sf_dir):
    names = "status,has_status, Has_Status ,order_status,separate,statusquo,payment_deadline,deadlines,max_window_days,retention_period,requires_approval,allows_review_omission,access_duration,access_approver,incident_commander,has_formal_owner,owner,is_approved_as,version,is_required"
    p = spark.createDataFrame([(n,) for n in names.split(",")], "predicate string")
    return p.select("predicate", CL.single_valued(F.col("predicate")).alias("single"), CL.needs_condition(F.col("predicate")).alias("conditional"))


_APPROVALS = [
    (1, "requires_approval", "true", "部長", False), (2, "requires_approval", "部長", "課長", False), (3, "requires_approval", "部長", "課長", True), (4, "requires_approval", "true", "不要", True), (5, "requires_approval", '["部長","課長"]', "true", False),
    (6, "requires_approval", "true", "false", True), (7, "requires_review", "true", "部長", True), (8, " Requires_Approval", "Yes", "部長", True), (9, "requires_approval", "[]", "true", True), (10, "requires_approval", "必要", "部長", True),
]


@query(FX.values([(1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, False), (8, False), (9, False), (10, False)], "id, compatible"))
def objects_compatible(spark, sf_dir):
    d = spark.createDataFrame(_APPROVALS, "id int, p string, a string, b string, share boolean")
    return d.select("id", X.objects_compatible(F.col("p"), F.col("a"), F.col("b"), F.col("share")).alias("compatible"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, translate(regexp_replace(lower(p_name), '\\s+', '', 'g'), '一二', '12') AS norm FROM part")
def scalar_normalize(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", X.scalar_normalize(F.col("p_name")).alias("norm"))


# --- predicates ---------------------------------------------------------------------------------------------------

_NEXT = """, pair AS (SELECT p.source_id, n.source_id AS other, p.products AS pp, p.sites AS ps, n.products AS np, n.sites AS ns FROM prof p JOIN rel r USING (source_id) JOIN prof n ON n.source_id = r.target_id)"""


def _scope_pairs(spark, sf_dir):
    p = V.profiles(spark, sf_dir)
    r = V.relations(spark, sf_dir).select("source_id", F.col("target_id").alias("other"))
    return p.select("source_id", F.col("scope").alias("a")).join(r, "source_id").join(p.select(F.col("source_id").alias("other"), F.col("scope").alias("b")), "other")


@query(sql(SRC, PROF, REL, body=_NEXT + """SELECT source_id, other, CASE WHEN (len(pp) > 0 AND len(np) > 0 AND NOT list_has_any(pp, np)) OR (len(ps) > 0 AND len(ns) > 0 AND NOT list_has_any(ps, ns)) THEN 'mismatch'
  WHEN (len(pp) > 0 AND len(np) = 0) OR (len(ps) > 0 AND len(ns) = 0) THEN 'missing' ELSE 'match' END AS result,
  concat_ws(',', CASE WHEN len(ps) > 0 AND len(ns) = 0 THEN 'sites' END, CASE WHEN len(pp) > 0 AND len(np) = 0 THEN 'products' END) AS missing FROM pair"""))
def scope_match(spark, sf_dir):
    return _scope_pairs(spark, sf_dir).select("source_id", "other", S.scope_match(F.col("a"), F.col("b")).alias("result"), F.array_join(S.scope_missing(F.col("a"), F.col("b")), ",").alias("missing"))


@query(sql(SRC, PROF, REL, body=_NEXT + """, f AS (SELECT *, (len(np) = 0 OR (len(pp) > 0 AND list_has_all(np, pp))) AND (len(ns) = 0 OR (len(ps) > 0 AND list_has_all(ns, ps))) AS inside,
  (len(np) = 0 AND len(pp) > 0) OR (len(ns) = 0 AND len(ps) > 0) AS smaller FROM pair)
SELECT source_id, other, inside AND smaller AS refines, len(pp) = len(np) AND len(ps) = len(ns) AND list_has_all(np, pp) AND list_has_all(ns, ps) AS equivalent FROM f"""))
def scope_refinement(spark, sf_dir):
    return _scope_pairs(spark, sf_dir).select("source_id", "other", S.strict_refinement(F.col("a"), F.col("b")).alias("refines"), S.scopes_equivalent(F.col("a"), F.col("b")).alias("equivalent"))


@query(sql(SRC, PROF, REL, body=_NEXT + """SELECT source_id, other, (len(pp) = 0 AND len(ps) = 0) OR ((list_has_any(pp, np) OR list_has_any(ps, ns)) AND NOT (len(pp) > 0 AND len(np) > 0 AND NOT list_has_any(pp, np)) AND NOT (len(ps) > 0 AND len(ns) > 0 AND NOT list_has_any(ps, ns))) AS compatible FROM pair"""))
def scope_override(spark, sf_dir):
    return _scope_pairs(spark, sf_dir).select("source_id", "other", S.compatible_for_override(F.col("a"), F.col("b")).alias("compatible"))


@query(sql(SRC, PROF, body=f"""SELECT source_id, coalesce(try_strptime(valid_from, '%Y-%m-%d') <= TIMESTAMP '{AS_OF}', true) AND coalesce(try_strptime(valid_to, '%Y-%m-%d') >= TIMESTAMP '{AS_OF}', true) AS at_date, valid_from IS NULL AND valid_to IS NULL AS undated FROM prof"""))
def effective_as_of(spark, sf_dir):
    f, t = F.col("valid_from"), F.col("valid_to")
    return V.profiles(spark, sf_dir).select("source_id", T.effective(f, t, F.lit(AS_OF)).alias("at_date"), T.effective(f, t, F.lit(None).cast("string")).alias("undated"))


@query(sql(SRC, REL, body=f"""SELECT id, CASE WHEN valid_to = 'later' THEN false ELSE coalesce(valid_from <= '{AS_OF}', true) AND coalesce(valid_to >= '{AS_OF}', true) END AS active, valid_from IS NULL AND valid_to IS NULL AS undated FROM rel"""))
def relation_active(spark, sf_dir):
    f, t = F.col("valid_from"), F.col("valid_to")
    return V.relations(spark, sf_dir).select("id", T.relation_active(f, t, F.lit(AS_OF)).alias("active"), T.relation_active(f, t, F.lit(None).cast("string")).alias("undated"))


@query(sql(SRC, REL, body="SELECT id, kind NOT IN ('amends', 'order_of_precedence') OR sc IN ('c1', 'c2') OR tc IN ('c1', 'c2') AS requested, sc = tc AS overlap FROM rel"))
def clause_requested(spark, sf_dir):
    r = V.relations(spark, sf_dir)
    want = F.array(F.lit("c1"), F.lit("c2"))
    return r.select("id", S.clause_requested(want, F.col("kind"), F.col("source_clauses"), F.col("target_clauses")).alias("requested"), S.clauses_overlap(F.col("source_clauses"), F.col("target_clauses")).alias("overlap"))


# --- normalization and validation ---------------------------------------------------------------------------------

_ALIASES = [(0, "products", "english", ["EN", "anglais"]), (1, "products", "german", ["DE"]), (2, "sites", "fr-site", ["fr"])]


def _aliases(spark):
    return spark.createDataFrame(_ALIASES, "ordinal int, dimension string, canonical string, aliases array<string>")


@query(sql(SRC, PROF, body="""SELECT source_id, coalesce(CASE products[1] WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN '' ELSE products[1] END, '') AS products,
  array_to_string(list_sort(list_concat(list_filter(sites, lambda s: s <> 'src0'), CASE WHEN products[1] = 'fr' THEN ['fr-site'] ELSE [] END)), ',') AS sites FROM prof"""))
def normalize_scopes(spark, sf_dir):
    out, _ = N.normalize_scopes(V.profiles(spark, sf_dir).select("source_id", "scope"), _aliases(spark), ["src0"])
    return out.select("source_id", F.array_join("scope.products", ",").alias("products"), F.array_join("scope.sites", ",").alias("sites"))


@query(sql(SRC, PROF, body="""SELECT source_id, 'scope.alias_normalized' AS code, 'products' AS dim, products[1] AS value FROM prof WHERE products[1] IN ('en', 'de', 'fr')
UNION ALL SELECT source_id, 'scope.universal_value_normalized', 'sites', 'src0' FROM prof WHERE sites[1] = 'src0'"""))
def scope_diagnostics(spark, sf_dir):
    return N.normalize_scopes(V.profiles(spark, sf_dir).select("source_id", "scope"), _aliases(spark), ["src0"])[1]


@query(sql(SRC, REL, body="SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'See Clause ' || sc ELSE ' ' || sc || ' ' END AS clause, CASE sc WHEN 'c1' THEN 'first' WHEN 'c2' THEN 'second' ELSE CASE WHEN doc_id % 2 = 0 THEN 'See Clause ' || sc ELSE sc END END AS canonical FROM rel"))
def normalize_clauses(spark, sf_dir):
    r = V.relations(spark, sf_dir)
    c = F.element_at("source_clauses", 1)
    clauses = r.select("id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("See Clause "), c)).otherwise(F.concat(F.lit(" "), c, F.lit(" "))).alias("clause"))
    return N.normalize_clauses(clauses, spark.createDataFrame([(0, "first", ["c1"]), (1, "second", ["C2"]), (2, "late", ["c1"])], "ordinal int, canonical string, aliases array<string>"))


@query(sql(SRC, PROF, body="""SELECT source_id, 'profile.invalid_date' AS code FROM prof WHERE valid_from = 'soon' OR valid_to = '30 days' UNION SELECT source_id, 'profile.invalid_authority_rank' FROM prof WHERE authority_rank * 2 > 10
UNION SELECT source_id, 'profile.duplicate_source_id' FROM prof WHERE doc_id % 40 = 0"""))
def profile_diagnostics(spark, sf_dir):
    p = V.profiles(spark, sf_dir).withColumn("authority_rank", F.col("authority_rank") * 2)
    return N.profile_diagnostics(p.unionByName(p.filter("doc_id % 40 = 0")))


@query(sql(SRC, PROF, REL, body="""SELECT id, 'relation.unknown_source' AS code FROM rel WHERE source_id NOT IN (SELECT source_id FROM prof) UNION SELECT id, 'relation.unknown_target' FROM rel WHERE doc_id % 31 <> 0 AND target_id NOT IN (SELECT source_id FROM prof)
UNION SELECT id, 'relation.unknown_target' FROM rel WHERE doc_id % 31 = 0 AND source_id NOT IN (SELECT source_id FROM prof) UNION SELECT id, 'relation.self_loop' FROM rel WHERE doc_id % 31 = 0 UNION SELECT id, 'relation.amends_without_clauses' FROM rel WHERE kind = 'amends' AND doc_id % 2 = 0"""))
def relation_diagnostics(spark, sf_dir):
    r = V.relations(spark, sf_dir)
    k = F.col("doc_id")
    bent = r.withColumn("target_id", F.when(k % 31 == 0, F.col("source_id")).otherwise(F.col("target_id"))).withColumn("source_clauses", F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("source_clauses")))
    return N.relation_diagnostics(bent, V.profiles(spark, sf_dir))


@query(sql(SRC, PROF, body="SELECT source_id, CASE WHEN doc_id % 2 = 0 THEN 'X' ELSE document_id END AS document_id, CASE WHEN doc_id % 2 = 0 THEN CAST(10 AS INTEGER) ELSE authority_rank END AS authority_rank, CASE WHEN doc_id % 2 = 0 THEN 'proposal' ELSE role END AS role FROM prof"))
def profile_overlay(spark, sf_dir):
    p = V.profiles(spark, sf_dir)
    n = F.lit(None)
    meta = p.filter("doc_id % 2 = 0").select("source_id", F.lit("X").alias("document_id"), n.cast("string").alias("revision"), F.lit("proposal").alias("role"), n.cast("string").alias("level"), F.lit(99).alias("authority_rank"), n.cast("boolean").alias("approved"), n.cast("string").alias("valid_from"), n.cast("string").alias("valid_to"), n.cast("boolean").alias("official_record"))
    return N.overlay(p, meta).select("source_id", "document_id", "authority_rank", "role")


# --- resolvers ----------------------------------------------------------------------------------------------------


@query(sql(SRC, RETRIEVED, CAND, body="SELECT case_id, source_id, CASE WHEN row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, ordinal DESC) = 1 THEN 'canonical' ELSE 'reference' END AS disposition FROM cand"))
def resolve_r0(spark, sf_dir):
    return RE.resolve_r0(V.candidates(spark, sf_dir)).select("case_id", "source_id", "disposition")


_JOINED = f""", j AS (SELECT c.case_id, c.ordinal, c.source_id, c.relevance, x.as_of, x.roles, p.source_id IS NOT NULL AS known, p.role, p.level, p.authority_rank, p.approved, p.valid_from, p.valid_to, p.official_record,
  CASE WHEN (len(p.products) > 0 AND len(x.products) > 0 AND NOT list_has_any(p.products, x.products)) THEN 'mismatch' WHEN (len(p.products) > 0 AND len(x.products) = 0) OR len(p.sites) > 0 THEN 'missing' ELSE 'match' END AS m,
  concat_ws(',', CASE WHEN len(p.sites) > 0 THEN 'sites' END, CASE WHEN len(p.products) > 0 AND len(x.products) = 0 THEN 'products' END) AS dims,
  CASE WHEN x.as_of IS NULL THEN p.valid_from IS NULL AND p.valid_to IS NULL ELSE coalesce(try_strptime(p.valid_from, '%Y-%m-%d') <= TIMESTAMP '{AS_OF}', true) AND coalesce(try_strptime(p.valid_to, '%Y-%m-%d') >= TIMESTAMP '{AS_OF}', true) END AS eff
  FROM cand c JOIN ctx x USING (case_id) LEFT JOIN prof p ON p.source_id = c.source_id)"""


@query(sql(SRC, PROF, RETRIEVED, CAND, body=_JOINED + """, w AS (SELECT *, CASE WHEN NOT known THEN relevance ELSE relevance + authority_rank * CAST(0.05 AS DOUBLE) + CASE WHEN approved THEN CAST(0.25 AS DOUBLE) ELSE CAST(-0.6 AS DOUBLE) END + CASE WHEN level = 'mandatory' THEN CAST(0.15 AS DOUBLE) ELSE 0 END
  + CASE m WHEN 'match' THEN CAST(0.3 AS DOUBLE) WHEN 'missing' THEN CAST(-0.1 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END + CASE WHEN eff THEN CAST(0.2 AS DOUBLE) ELSE CAST(-0.4 AS DOUBLE) END END AS s FROM j)
SELECT case_id, source_id, CASE WHEN row_number() OVER (PARTITION BY case_id ORDER BY s DESC, ordinal DESC) = 1 THEN 'canonical' ELSE 'reference' END AS disposition, round(s, 6) AS score FROM w"""))
def resolve_s1(spark, sf_dir):
    return RE.resolve_s1(V.candidates(spark, sf_dir), V.contexts(spark, sf_dir), V.profiles(spark, sf_dir)).select("case_id", "source_id", "disposition", F.round("score", 6).alias("score"))


_S2 = _JOINED + """, d AS (SELECT *, list_contains(roles, role) AS wants, CASE WHEN NOT known THEN 'unresolved' WHEN m = 'mismatch' THEN 'excluded' WHEN m = 'missing' THEN 'unresolved' WHEN NOT approved THEN 'excluded'
  WHEN (valid_from IS NOT NULL OR valid_to IS NOT NULL) AND as_of IS NULL THEN 'unresolved' WHEN NOT eff THEN 'historical' WHEN role = 'record' THEN 'execution_record' WHEN NOT list_contains(roles, role) THEN 'reference' ELSE 'eligible' END AS x,
  CASE WHEN NOT known THEN 'relation_invalid' WHEN m = 'mismatch' THEN 'scope_mismatch' WHEN m = 'missing' THEN 'scope_input_missing' WHEN NOT approved THEN 'scope_matched,not_approved'
  WHEN (valid_from IS NOT NULL OR valid_to IS NOT NULL) AND as_of IS NULL THEN 'scope_matched,approved,scope_input_missing' WHEN NOT eff THEN 'scope_matched,approved,not_effective_at_requested_time'
  ELSE 'scope_matched,approved,effective_at_requested_time,' || CASE WHEN list_contains(roles, role) THEN 'role_matched' ELSE 'role_separated' END END AS r,
  CASE WHEN NOT known THEN 'document_profile' WHEN m = 'mismatch' THEN '' WHEN m = 'missing' THEN dims WHEN NOT approved THEN '' WHEN (valid_from IS NOT NULL OR valid_to IS NOT NULL) AND as_of IS NULL THEN 'as_of' ELSE '' END AS mi FROM j)
, s2 AS (SELECT *, x = 'eligible' AND row_number() OVER (PARTITION BY case_id, role, x ORDER BY authority_rank DESC, relevance DESC, ordinal DESC) = 1 AS wins FROM d)"""


@query(sql(SRC, PROF, RETRIEVED, CAND, body=_S2 + "SELECT case_id, source_id, CASE WHEN wins THEN 'canonical' WHEN x = 'eligible' THEN 'reference' ELSE x END AS disposition, r || CASE WHEN wins THEN ',higher_authority' ELSE '' END AS reasons, mi AS missing_inputs FROM s2"))
def resolve_s2(spark, sf_dir):
    d = RE.resolve_s2(V.candidates(spark, sf_dir), V.contexts(spark, sf_dir), V.profiles(spark, sf_dir))
    return d.select("case_id", "source_id", "disposition", F.array_join("reasons", ",").alias("reasons"), F.array_join("missing_inputs", ",").alias("missing_inputs"))


@query()
def resolve_s3(spark, sf_dir):
    d = RE.resolve_s3(V.candidates(spark, sf_dir), V.contexts(spark, sf_dir), V.profiles(spark, sf_dir), V.relations(spark, sf_dir))
    return d.select("case_id", "source_id", "disposition", F.array_join("reasons", ",").alias("reasons"), F.array_join("relation_path", ",").alias("relation_path"))


@query(FX.values(FX.OUTCOMES, "case_id, candidate, disposition, reasons, relation_path"))
def resolve_s3_cases(spark, sf_dir):
    c = FX.resolver_cases(spark)
    d = RE.resolve_s3(c["candidates"], c["contexts"], c["profiles"], c["relations"])
    before = RE.resolve_s2(c["candidates"], c["contexts"], c["profiles"]).select("case_id", "ordinal", F.col("reasons").alias("first"))
    last = lambda x: F.element_at(F.split(x, "/"), -1)
    return d.join(before, ["case_id", "ordinal"]).select(
        "case_id", last("source_id").alias("candidate"), "disposition", F.array_join(F.array_except("reasons", "first"), ",").alias("reasons"), F.array_join(F.transform("relation_path", last), ",").alias("relation_path"),
    )


# --- rerank -------------------------------------------------------------------------------------------------------

_ROLE_SQL = """, role AS (SELECT DISTINCT vec_id, CASE WHEN p.doc_id IS NULL THEN NULL WHEN NOT approved THEN 'excluded' WHEN role IN ('normative', 'instruction') THEN 'governing' WHEN role IN ('record', 'analysis') THEN 'verifier' WHEN role = 'proposal' THEN 'contender' END AS role
  FROM retrieved r LEFT JOIN prof p ON p.doc_id = r.vec_id)"""


def _with_roles(spark, sf_dir):
    p = V.profiles(spark, sf_dir)
    role = F.when(~F.col("approved"), "excluded").when(F.col("role").isin("normative", "instruction"), "governing").when(F.col("role").isin("record", "analysis"), "verifier").when(F.col("role") == "proposal", "contender")
    return V.retrieved(spark, sf_dir).join(p.select(F.col("doc_id").alias("vec_id"), role.alias("role")), "vec_id", "left")


@query(sql(SRC, PROF, RETRIEVED, body=_ROLE_SQL + """, a AS (SELECT query_id, r.vec_id, rank, role, rank + CASE role WHEN 'governing' THEN -4 WHEN 'verifier' THEN -2 WHEN 'contender' THEN 2 WHEN 'excluded' THEN 6 ELSE 0 END AS adj FROM retrieved r JOIN role USING (vec_id))
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, role, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adj, rank) AS INTEGER) AS new_rank FROM a"""))
def soft_rerank(spark, sf_dir):
    """Flagship: which retrieved documents may govern, and in what order."""
    return RR.soft_rerank(_with_roles(spark, sf_dir)).select("query_id", "vec_id", "rank", "role", "new_rank")


@query(sql(SRC, REL, body=""", r AS (SELECT *, CASE WHEN kind IN ('approves', 'records_execution_of', 'evaluates') THEN ['verifier', 'governing'] WHEN kind = 'implements_decision' THEN ['governing', 'verifier'] WHEN position = 'dominates' THEN ['governing', 'excluded']
  WHEN position = 'conditional' THEN ['governing', 'governing'] WHEN position = 'non_effective' THEN ['excluded', 'governing'] ELSE ['contender', 'contender'] END AS rr FROM rel)
, m AS (SELECT source_id, rr[1] AS role FROM r UNION ALL SELECT target_id, rr[2] FROM r)
SELECT source_id, ['excluded', 'contender', 'verifier', 'governing'][min(list_position(['excluded', 'contender', 'verifier', 'governing'], role))] AS role FROM m GROUP BY 1"""))
def primary_role(spark, sf_dir):
    none = spark.createDataFrame([], "id string, source_id string, evidence_id string")
    return RR.primary_role(P.materials(V.relations(spark, sf_dir), none))


# --- candidate graph, dossiers, slots, packets --------------------------------------------------------------------

_POST = """, post AS (SELECT DISTINCT source_id, 'lexical' AS kk, 20 AS w, lower(line) AS key FROM lines WHERE length(line) BETWEEN 4 AND 60 UNION SELECT source_id, 'document', 100, 'D' || (doc_id % 150) FROM src WHERE doc_id % 3 = 0)
, ok AS (SELECT p.* FROM post p JOIN (SELECT kk, key FROM post GROUP BY ALL HAVING count(*) BETWEEN 2 AND 64) USING (kk, key))
, e AS (SELECT a.source_id AS a, b.source_id AS b, CAST(sum(a.w) AS BIGINT) AS weight FROM ok a JOIN ok b ON a.kk = b.kk AND a.key = b.key AND a.source_id < b.source_id GROUP BY ALL)
, both_ AS (SELECT a AS s, b AS t, weight FROM e UNION ALL SELECT b, a, weight FROM e)
, graph AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b, weight FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY weight DESC, t) AS r FROM both_) WHERE r <= 32)"""


def _postings(spark, sf_dir):
    s = V.sources(spark, sf_dir)
    lines = PA.evidence_lines(s).filter(F.char_length("text").between(4, 60)).select("source_id", F.lit("lexical").alias("key_kind"), F.lower("text").alias("key"))
    return lines.unionByName(s.filter("doc_id % 3 = 0").select("source_id", F.lit("document").alias("key_kind"), F.concat(F.lit("D"), (F.col("doc_id") % 150).cast("string")).alias("key")))


@query(sql(SRC, LINES, body=_POST + "SELECT * FROM graph"))
def candidate_graph(spark, sf_dir):
    return C.candidate_graph(_postings(spark, sf_dir))


_DOSSIER = """, mem AS (SELECT source_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source || '/' || lang END AS dossier FROM src)
, n AS (SELECT dossier, count(*) AS n FROM mem WHERE dossier IS NOT NULL GROUP BY 1)"""


@query(sql(SRC, LINES, body=_POST + _DOSSIER + """SELECT x.dossier, x.source_id AS a, y.source_id AS b FROM mem x JOIN mem y ON x.dossier = y.dossier AND x.source_id < y.source_id JOIN n ON n.dossier = x.dossier WHERE n <= 12
UNION ALL SELECT x.dossier, a, b FROM graph JOIN mem x ON x.source_id = a JOIN mem y ON y.source_id = b JOIN n ON n.dossier = x.dossier WHERE x.dossier = y.dossier AND n > 12
UNION ALL SELECT NULL, a, b FROM graph JOIN mem x ON x.source_id = a JOIN mem y ON y.source_id = b WHERE x.dossier IS NULL OR y.dossier IS NULL"""))
def dossier_plans(spark, sf_dir):
    members = V.sources(spark, sf_dir).select("source_id", F.when(F.col("doc_id") % 5 != 0, F.concat_ws("/", "source", "lang")).alias("dossier"))
    return C.dossier_plan(members, C.candidate_graph(_postings(spark, sf_dir)))


@query()
def bounded_batches(spark, sf_dir):
    return C.bounded_batches(dossier_plans(spark, sf_dir).filter("dossier IS NOT NULL"))


@query(sql(SRC, REL, body="SELECT source || '/' || lang AS dossier, r.source_id AS a, r.target_id AS b, CAST((row_number() OVER (PARTITION BY source, lang ORDER BY r.source_id, r.target_id) - 1) // 8 AS BIGINT) AS chunk FROM rel r JOIN src USING (doc_id)"))
def edge_chunks(spark, sf_dir):
    s = V.sources(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", "lang").alias("dossier"))
    return C.edge_chunks(V.relations(spark, sf_dir).join(s, "doc_id").select("dossier", F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query(sql(SRC, PROF, body=""", u AS (SELECT document_id, count(*) AS n, min(source_id) AS s FROM prof GROUP BY 1)
SELECT CAST(d.doc_id AS VARCHAR) AS id, 'D' || (d.doc_id % 200) AS endpoint, CASE WHEN u.n = 1 THEN u.s ELSE 'D' || (d.doc_id % 200) END AS resolved FROM src d LEFT JOIN u ON u.document_id = 'D' || (d.doc_id % 200)"""))
def endpoint_resolution(spark, sf_dir):
    refs = V.sources(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("D"), (F.col("doc_id") % 200).cast("string")).alias("endpoint"))
    return C.unique_endpoints(refs, V.profiles(spark, sf_dir))


_SLOT_TYPES = ("specification_amendment", "technical_specification", "test_record", "technical_draft")
_SLOT_DOCS = """, sd AS (SELECT doc_id, source_id, source || '/' || lang || '/' || (doc_id % 2) AS scenario, ['specification_amendment','technical_specification','test_record','technical_draft'][1 + (doc_id // 2) % 4] AS dt, ['t' || (doc_id % 3), 'u' || (doc_id % 5)] AS tok FROM src)
, sp AS (SELECT s.source_id, t.source_id AS target_id, r.kind, r.position, len(list_intersect(s.tok, t.tok)) AS sh FROM sd s JOIN (VALUES ('specification_amendment', 'amends', 'dominates', 'technical_specification'), ('test_record', 'records_execution_of', 'non_effective', 'specification_amendment'),
  ('technical_draft', 'proposes_change_to', 'non_effective', 'technical_specification')) r(st, kind, position, tt) ON s.dt = r.st LEFT JOIN sd t ON t.scenario = s.scenario AND t.dt = r.tt)
, b AS (SELECT *, count(target_id) OVER w AS n, max(sh) OVER w AS best FROM sp WINDOW w AS (PARTITION BY source_id, kind))
, hit AS (SELECT source_id, target_id, kind, position FROM (SELECT *, count(*) FILTER (sh = best) OVER (PARTITION BY source_id, kind) AS ties FROM b) WHERE target_id IS NOT NULL AND (n = 1 OR (sh = best AND best > 0 AND ties = 1)))"""


def _slot_docs(spark, sf_dir):
    s, k = V.sources(spark, sf_dir), F.col("doc_id")
    return s.select(
        "source_id", F.concat_ws("/", "source", "lang", (k % 2).cast("string")).alias("scenario"), F.lit("technical_spec").alias("purpose"), V._pick(_SLOT_TYPES, F.floor(k / 2)).alias("document_type"),
        F.lit("current").alias("status"), F.array(F.concat(F.lit("t"), (k % 3).cast("string")), F.concat(F.lit("u"), (k % 5).cast("string"))).alias("tokens"),
    )


@query(sql(SRC, body=_SLOT_DOCS + "SELECT source_id, target_id, kind, position, 'slot_' || substr(sha256(source_id || ':' || target_id || ':' || kind || ':required-slot'), 1, 16) AS id FROM hit"))
def required_slots(spark, sf_dir):
    return R.required_slots(_slot_docs(spark, sf_dir))


@query(sql(SRC, body=_SLOT_DOCS + "SELECT DISTINCT source_id, 'technical_spec' AS purpose, kind, 'REL-UNRESOLVED-REQUIRED-SLOT' AS code FROM sp WHERE (source_id, kind) NOT IN (SELECT (source_id, kind) FROM hit)"))
def unresolved_slots(spark, sf_dir):
    return R.unresolved_slots(_slot_docs(spark, sf_dir))


@query(sql(SRC, body=_SLOT_DOCS + """SELECT source_id, kind, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, kind ORDER BY target_id) AS r FROM sp WHERE target_id IS NOT NULL AND (source_id, kind) NOT IN (SELECT (source_id, kind) FROM hit)) WHERE r <= 32"""))
def slot_fallback_pairs(spark, sf_dir):
    return R.slot_fallback_pairs(_slot_docs(spark, sf_dir))


@query(sql(SRC, PROF, body=""", s AS (SELECT doc_id, source_id, 'D' || ((doc_id + 3) % 150) AS t, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 3 AS VARCHAR) END AS rv FROM prof WHERE doc_id % 4 = 1 OR doc_id % 2 = 0)
, j AS (SELECT s.source_id, p.source_id AS target_id, t, row_number() OVER (PARTITION BY s.source_id ORDER BY p.doc_id) AS n FROM s JOIN prof p ON p.document_id = t AND (rv IS NULL OR p.revision = rv) AND p.source_id <> s.source_id)
SELECT 'position_' || substr(sha256(source_id || ':' || target_id || ':' || t || ':dominates'), 1, 16) AS id, source_id, target_id FROM j WHERE n = 1"""))
def front_matter_positions(spark, sf_dir):
    p, k = V.profiles(spark, sf_dir), F.col("doc_id")
    s = p.filter("doc_id % 4 = 1 OR doc_id % 2 = 0").select("source_id", F.lit("dominates").alias("position"), F.concat(F.lit("D"), ((k + 3) % 150).cast("string")).alias("position_target_document_id"), F.when(k % 2 == 0, (k % 3).cast("string")).alias("position_target_revision"))
    return R.front_matter_positions(s, p.withColumn("ordinal", k)).select("id", "source_id", "target_id")


_RELATION_TERMS = {
    "operational_position": "現行 承認 未承認 却下 失効 適用", "supersedes": "現行 旧版 適用期間 置き換 終了 第2版 第1版", "conflicts_with": "現行 正式 優先 反映していない 旧案内 食い違 矛盾", "order_of_precedence": "現行 正式 優先 反映していない 旧案内 食い違 矛盾", "approves": "承認 決定 採用 施行 対象",
    "evaluates": "分析 比較 評価 提案 初期案 優位", "implements_decision": "決定 計画 採用 不採用 実施方式 実施対象 採否", "records_execution_of": "決定 承認 実施 実行 適用 完了 記録", "amends": "改訂 修正 変更 条 節", "proposes_change_to": "提案 未署名 署名 変更 義務 適用", "exception_to": "例外 逸脱 免除 限定",
}
_RSCORE = " ".join(f"WHEN '{k}' THEN " + " + ".join(f"CAST(contains(lower(line), '{t}') AS INTEGER)" for t in ts.split()) for k, ts in _RELATION_TERMS.items())
_RREST = " + ".join(f"CAST(contains(lower(line), '{t}') AS INTEGER)" for t in "適用 由来 参照 関係".split())


@query(sql(SRC, REL, LINES, body=f""", en AS (SELECT id, kind, source_id, sc AS clause FROM rel UNION ALL SELECT id, kind, target_id, tc FROM rel)
, sc AS (SELECT id, en.source_id, evidence_id, line_no, 20 * (CASE kind {_RSCORE} ELSE {_RREST} END) + CASE WHEN kind = 'order_of_precedence' AND contains(lower(line), clause) THEN 100 ELSE 0 END AS score FROM en JOIN lines USING (source_id) WHERE NOT starts_with(ltrim(line), '---') AND NOT starts_with(ltrim(line), '#'))
SELECT id, source_id, evidence_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, source_id ORDER BY score DESC, line_no) AS r FROM sc) WHERE r <= 3"""))
def relation_evidence_top3(spark, sf_dir):
    return R.relation_evidence(V.relations(spark, sf_dir), PA.evidence_lines(V.sources(spark, sf_dir)))


_END_UNITS = [
    ("a", "a1", 1, "---\nx: 承認", [], None), ("a", "a2", 2, "承認された現行の規則", ["適用"], "2024-01-01"), ("a", "a3", 3, "却下", ["判断に用いる基準"], None), ("a", "a4", 4, "この節では承認", [], None), ("a", "a5", 5, "無関係", [], None), ("a", "a6", 6, "# 承認", [], None),
    ("b", "b1", 1, "条項 c-9 を優先", [], None), ("b", "b2", 2, "食い違いと矛盾", ["正式"], None), ("b", "b3", 3, "架空の評価用社内文書の優先", [], None), ("b", "b4", 4, "静かな文", [], None), ("b", "b5", 5, "C-9 の注", [], None),
]


@query(FX.values([
    ("p", "a", "a3", 120, 1), ("p", "a", "a2", 63, 2), ("p", "a", "a5", 0, 3), ("p", "b", "b4", 0, 1), ("p", "b", "b1", 0, 2), ("p", "b", "b2", 0, 3), ("q", "a", "a3", 100, 1), ("q", "a", "a2", 23, 2), ("q", "a", "a5", 0, 3), ("q", "b", "b1", 120, 1), ("q", "b", "b5", 100, 2), ("q", "b", "b2", 60, 3),
], "id, source_id, evidence_id, score, rank"))
def relation_score_cases(spark, sf_dir):
    none = F.array().cast("array<string>")
    r = spark.createDataFrame([("p", "operational_position", "dominates", "a", "b"), ("q", "order_of_precedence", "dominates", "a", "b")], "id string, kind string, position string, source_id string, target_id string").withColumns({"source_clauses": none, "target_clauses": F.array(F.lit(" c-9 "), F.lit(""))})
    u = spark.createDataFrame(_END_UNITS, "source_id string, evidence_id string, line_start int, text string, heading_path array<string>, valid_from string").withColumn("valid_to", F.lit(None).cast("string"))
    return R.relation_evidence(r, u, grounded=spark.createDataFrame([("p", "b", "b4")], "id string, source_id string, evidence_id string"))


@query(FX.values([e[1:] for e in FX.EDGES], "kind, position, source_id, target_id, source_clauses, target_clauses, evidence"))
def family_coverage(spark, sf_dir):
    f = FX.family(spark)
    r = CV.family_coverage(f["relations"], f["docs"], f["claims"], f["units"], CV.coverage_pairs(f["graph"], f["relations"]))
    join = lambda c: F.array_join(c, ",")
    return r.select("kind", "position", "source_id", "target_id", join("source_clauses").alias("source_clauses"), join("target_clauses").alias("target_clauses"), join(F.col("evidence.evidence_id")).alias("evidence"))


@query(sql(SRC, REL, PROF, body=""", am AS (SELECT r.source_id, r.target_id, sc, tc FROM rel r JOIN prof p ON p.source_id = r.source_id AND p.approved AND p.doc_id % 2 = 0 JOIN prof q ON q.source_id = r.target_id AND q.approved)
SELECT id FROM rel UNION ALL SELECT r.id || 'c' FROM rel r WHERE doc_id % 3 = 0 AND NOT EXISTS (FROM am WHERE am.source_id = r.source_id AND am.target_id = r.target_id) UNION ALL SELECT id || 'd' FROM rel WHERE doc_id % 3 = 1"""))
def absorb_conflicts(spark, sf_dir):
    r = V.relations(spark, sf_dir)
    docs = V.profiles(spark, sf_dir).select("source_id", "approved", F.when(F.col("doc_id") % 2 == 0, "specification_amendment").alias("document_type"))
    con = r.filter("doc_id % 3 = 0").withColumns({"id": F.concat("id", F.lit("c")), "kind": F.lit("conflicts_with")})
    back = r.filter("doc_id % 3 = 1").withColumns({"id": F.concat("id", F.lit("d")), "kind": F.lit("conflicts_with"), "source_id": F.col("target_id"), "target_id": F.col("source_id")})
    return CV.drop_absorbed_conflicts(r.withColumn("kind", F.lit("amends")).unionByName(con).unionByName(back), docs).select("id")


@query(sql(SRC, REL, body=""", p AS (SELECT source_id AS s, target_id AS t, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM rel UNION SELECT target_id, source_id, least(source_id, target_id), greatest(source_id, target_id) FROM rel
  UNION SELECT x.source_id, y.source_id, least(x.source_id, y.source_id), greatest(x.source_id, y.source_id) FROM src x JOIN src y ON x.doc_id // 60 = y.doc_id // 60 AND x.doc_id <> y.doc_id)
, n AS (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN EXISTS (FROM src x JOIN src y ON x.source_id = s AND y.source_id = t AND x.doc_id // 60 = y.doc_id // 60) THEN 0 ELSE 1 END, a, b) AS n FROM p)
SELECT s AS source_id, t AS target_id FROM n WHERE n <= 44"""))
def coverage_cap(spark, sf_dir):
    s = V.sources(spark, sf_dir).select("source_id", "doc_id", F.floor(F.col("doc_id") / 60).alias("g"))
    graph = s.join(s.select(F.col("source_id").alias("b"), "g"), "g").filter("source_id < b").select(F.col("source_id").alias("a"), "b")
    return CV.coverage_pairs(graph, V.relations(spark, sf_dir))


@query(sql(SRC, REL, body=""", r AS (SELECT *, CASE WHEN kind IN ('approves', 'records_execution_of', 'evaluates') THEN ['verifier', 'governing'] WHEN kind = 'implements_decision' THEN ['governing', 'verifier'] WHEN position = 'dominates' THEN ['governing', 'excluded']
  WHEN position = 'conditional' THEN ['governing', 'governing'] WHEN position = 'non_effective' THEN ['excluded', 'governing'] ELSE ['contender', 'contender'] END AS rr FROM (SELECT * FROM rel UNION ALL SELECT * REPLACE (id || 'b' AS id) FROM rel WHERE doc_id % 3 = 0))
, m AS (SELECT id, source_id AS s, rr[1] AS role FROM r UNION ALL SELECT id, target_id, rr[2] FROM r UNION ALL SELECT id, 'other', 'verifier' FROM r WHERE doc_id % 2 = 0)
, sig AS (SELECT id, string_agg(s || ':' || role, ',' ORDER BY s, role) AS mats FROM m GROUP BY id)
SELECT 'packet:review:' || min(id) AS id, string_agg(id, ',' ORDER BY id) AS relation_ids, mats AS materials FROM sig GROUP BY mats"""))
def decision_packets(spark, sf_dir):
    r = V.relations(spark, sf_dir)
    r = r.unionByName(r.filter("doc_id % 3 = 0").withColumn("id", F.concat("id", F.lit("b"))))
    ev = r.filter("doc_id % 2 = 0").select("id", F.lit("other").alias("source_id"), F.concat(F.lit("e"), "id").alias("evidence_id"))
    p = P.build_packets(r, ev, "review")
    return p.select("id", F.array_join("relation_ids", ",").alias("relation_ids"), F.array_join(F.transform("materials", lambda m: F.concat_ws(":", m["source_id"], m["role"])), ",").alias("materials"))


@query(sql(CLAIM, body=""", pr AS (SELECT DISTINCT 'src_' || (o_orderkey % 500) AS a, 'src_' || ((o_orderkey + 1) % 500) AS b FROM orders)
, c AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 16 END AS len FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM claim) WHERE n <= 64)
, j AS (SELECT pr.a, pr.b, least(x.len, y.len) AS l, x.id AS xi, y.id AS yi FROM pr JOIN c x ON x.source_id = pr.a JOIN c y ON y.source_id = pr.b AND x.o_custkey = y.o_custkey AND x.object <> y.object)
SELECT a AS source_id, b AS target_id, xi AS source_claim, yi AS target_claim, CAST(l AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY l DESC, xi, yi) AS r FROM j) WHERE r = 1"""))
def claim_pair_join(spark, sf_dir):
    k = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name = lambda c: F.concat(F.lit("src_"), (c % 500).cast("string"))
    pairs = k.select(name(F.col("k")).alias("source_id"), name(F.col("k") + 1).alias("target_id")).distinct()
    return R.claim_pairs(pairs, V.claims(spark, sf_dir), agree=False)


@query(sql(SRC, body=""", d AS (SELECT lang || '/' || (doc_id // 200) AS sc, source_id, doc_id, doc_id % 4 AS k FROM src)
SELECT sc AS scenario, arg_max(source_id, doc_id) FILTER (k = 0) AS open_report, arg_max(source_id, doc_id) FILTER (k = 1) AS closed_report, arg_max(source_id, doc_id) FILTER (k = 2) AS change, arg_max(source_id, doc_id) FILTER (k = 3) AS release FROM d GROUP BY sc"""))
def incident_pivot(spark, sf_dir):
    k = F.col("doc_id")
    d = V.sources(spark, sf_dir).select("source_id", F.concat_ws("/", "lang", F.floor(k / 200).cast("string")).alias("scenario"), V._pick(("incident_report", "incident_report", "change_request", "release_record"), k).alias("document_type"), V._pick(("open", "closed", "x", "x"), k).alias("status"), k.alias("ordinal"))
    return R.incident_pivot(d)


@query(FX.values(FX.INCIDENT_EDGES, "kind, source_id, target_id, evidence"))
def incident_change(spark, sf_dir):
    kept, added = R.incident_change(*FX.incident(spark))
    return kept.unionByName(added).select("kind", "source_id", "target_id", F.array_join(F.col("evidence.evidence_id"), ",").alias("evidence"))


@query(FX.values(FX.DOSSIER_SLOTS, "source_id, target_id, kind"))
def named_slots(spark, sf_dir):
    return R.required_slots(FX.dossier(spark)[0]).select("source_id", "target_id", "kind")


@query(FX.values(FX.DOSSIER_KEPT, "id"))
def dossier_shapes(spark, sf_dir):
    docs, relations = FX.dossier(spark)
    return R.slot_dedup(R.slot_shape_filter(relations, docs), docs).select("id")


@query(sql(SRC, PROF, REL, body="""SELECT r.id, CASE WHEN r.kind = 'operational_position' AND position = 'non_effective' AND s.role = 'communication' AND t.role = 'normative' AND t.approved AND r.doc_id % 2 = 0 THEN 'conflicts_with' ELSE r.kind END AS kind
FROM (SELECT * REPLACE (CASE WHEN doc_id % 7 = 5 THEN 'operational_position' ELSE kind END AS kind, CASE WHEN doc_id % 7 = 5 THEN 'non_effective' ELSE position END AS position) FROM rel) r LEFT JOIN prof s USING (source_id) LEFT JOIN prof t ON t.source_id = r.target_id"""))
def refine_stale_guidance(spark, sf_dir):
    r, k = V.relations(spark, sf_dir), F.col("doc_id")
    r = r.withColumn("kind", F.when(k % 7 == 5, "operational_position").otherwise(F.col("kind"))).withColumn("position", F.when(k % 7 == 5, "non_effective").otherwise(F.col("position")))
    return R.refine_stale_guidance(r, V.profiles(spark, sf_dir), r.filter("doc_id % 2 = 0").select("source_id", "target_id")).select("id", "kind")


@query(sql(SRC, REL, body=_SLOT_DOCS + """SELECT r.id FROM rel r JOIN sd s ON s.source_id = r.source_id JOIN sd t ON t.source_id = r.target_id WHERE s.scenario = t.scenario
  AND ((r.source_id, r.target_id, r.kind) IN (SELECT (source_id, target_id, kind) FROM hit) OR (r.source_id, r.kind) NOT IN (SELECT (source_id, kind) FROM hit)
    AND (s.dt, r.kind, t.dt) IN (('specification_amendment', 'amends', 'technical_specification'), ('test_record', 'records_execution_of', 'specification_amendment'), ('technical_draft', 'proposes_change_to', 'technical_specification')))"""))
def slot_shape_filter(spark, sf_dir):
    return R.slot_shape_filter(V.relations(spark, sf_dir), _slot_docs(spark, sf_dir)).select("id")


@query(sql(SRC, LINES, body=""", r AS (SELECT source_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_.-]+')) AS w FROM lines), u AS (SELECT 'src' || (doc_id % 40) || CASE WHEN doc_id < 40 THEN '' ELSE 'x' || doc_id END AS d, source_id AS t FROM src)
SELECT DISTINCT r.source_id, t AS target_id FROM (SELECT source_id, w FROM r UNION ALL SELECT source_id, 'src' || (doc_id % 7) FROM src) r JOIN u ON u.d = r.w AND u.t <> r.source_id"""))
def body_references(spark, sf_dir):
    s = V.sources(spark, sf_dir)
    name = F.concat(F.lit("src"), (F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") < 40, "").otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string"))))
    units = PA.evidence_lines(s).select("source_id", "line_start", "text").unionByName(s.select("source_id", F.lit(9999).cast("long").alias("line_start"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("text")))
    return C.body_references(units, s.select("source_id", name.alias("document_id")))


@query(FX.values(FX.OVERRIDES, "conflict_id, winner, kind"))
def relation_overrides(spark, sf_dir):
    f = FX.overrides(spark)
    return CL.relation_overrides(f["conflicts"], f["claims"], f["relations"], f["profiles"], AS_OF)


@query(FX.values(FX.MERGED, "relation_ids, materials"))
def complementary_packets(spark, sf_dir):
    r = FX.packet_relations(spark)
    p = P.complementary_merge(P.build_packets(r, spark.createDataFrame([], "id string, source_id string, evidence_id string"), "review"), r)
    return p.select(F.array_join("relation_ids", ",").alias("relation_ids"), F.array_join(F.transform("materials", lambda m: F.concat_ws(":", m["source_id"], m["role"])), ",").alias("materials"))


@query(FX.values(FX.VALIDATED, "source_id, role, level, authority_rank, approved, official_record"))
def validate_profiles(spark, sf_dir):
    return N.validate_profiles(*FX.extracted(spark))[0].select("source_id", "role", "level", "authority_rank", "approved", "official_record")


@query(FX.values(FX.INVALID, "target, code"))
def invalid_profiles(spark, sf_dir):
    return N.validate_profiles(*FX.extracted(spark))[1]


@query(FX.values(FX.JUDGED, "id, outcome"))
def validate_relations(spark, sf_dir):
    extracted, units = FX.extracted(spark)
    rows, allowed = FX.candidate_relations(spark)
    kept, bad = N.validate_relations(rows, N.validate_profiles(extracted, units)[0], units, allowed)
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(bad.select(F.col("target").alias("id"), F.col("reason").alias("outcome")))


_SLOT_UNITS = [("a", 1, "---\nx: 1\n---", []), ("a", 2, "長い本文の適用範囲", ["適用範囲"]), ("a", 3, "短い適用", ["1 適用範囲"]), ("a", 4, "節", ["この節"]), ("b", 1, "---\nx: 1\n---", []), ("b", 2, "この節では短", ["適用範囲"]), ("c", 1, "本文", ["別"])]


@query(FX.values([("a", "a/3"), ("b", "b/1")], "source_id, evidence_id"))
def slot_evidence(spark, sf_dir):
    u = spark.createDataFrame([(s, f"{s}/{n}", n, t, h) for s, n, t, h in _SLOT_UNITS], "source_id string, evidence_id string, line_start int, text string, heading_path array<string>")
    wanted = u.select("source_id", F.lit("s").alias("slot"), F.array(F.lit("適用範囲")).alias("headings")).distinct()
    return R.slot_evidence(wanted, u).select("source_id", "evidence_id")


# --- export and metrics -------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'clm_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32) AS id, o_custkey, o_orderkey, o_orderstatus AS object FROM orders)
, p AS (SELECT a.id AS l, b.id AS r, 'cfl_' || substr(sha256(a.id || ':' || b.id), 1, 24) AS cid FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.id < b.id AND a.object <> b.object), x AS (SELECT l AS id, cid FROM p UNION ALL SELECT r, cid FROM p)
SELECT 'unit:ev_' || o_orderkey AS id, 'src_' || (o_orderkey % 500) AS source_id, c.id AS claim_ids, coalesce(string_agg(cid, ',' ORDER BY cid), '') AS conflict_ids FROM c LEFT JOIN x USING (id) GROUP BY o_orderkey, c.id""")
def export_units(spark, sf_dir):
    c = V.claims(spark, sf_dir)
    e = c.select(F.explode("evidence").alias("r"), "object").select("r.source_id", "r.evidence_id", F.col("object").alias("text"))
    out = EX.export_units(e, c, CL.resolve_conflicts(CL.conflict_pairs(c), AS_OF, _PRECEDENCE))
    return out.select("id", "source_id", F.array_join("claim_ids", ",").alias("claim_ids"), F.array_join("conflict_ids", ",").alias("conflict_ids"))


def _records(spark, sf_dir, which):
    return V.snapshot(spark, sf_dir, which).select(F.concat(F.lit("unit:"), "source_id").alias("id"), F.col("content_hash").alias("payload"))


@query(sql(SRC, SNAP, body="SELECT 'unit:' || coalesce(o.source_id, n.source_id) AS id, CASE WHEN n.path IS NULL THEN 'delete' ELSE 'upsert' END AS op, n.content_hash AS payload FROM sold o FULL JOIN snew n ON o.path = n.path WHERE n.content_hash IS DISTINCT FROM o.content_hash"))
def export_delta(spark, sf_dir):
    return EX.delta(_records(spark, sf_dir, "old"), _records(spark, sf_dir, "new"))


@query(sql(SRC, SNAP, body="SELECT count(*) FILTER (n.path IS NOT NULL AND n.content_hash IS DISTINCT FROM o.content_hash) AS upserts, count(*) FILTER (n.path IS NULL) AS deletes, count(*) FILTER (n.content_hash = o.content_hash) AS unchanged FROM sold o FULL JOIN snew n ON o.path = n.path"))
def delta_summary(spark, sf_dir):
    return EX.delta_summary(_records(spark, sf_dir, "old"), _records(spark, sf_dir, "new"))


@query(sql(RETRIEVED, body=""", g AS (SELECT vec_id AS q, vec_id + 25 AS s FROM vec WHERE vec_id % 25 = 0 UNION SELECT vec_id, vec_id + 1 FROM vec WHERE vec_id % 25 = 0 UNION SELECT query_id, vec_id FROM retrieved WHERE rank IN (2, 7))
, per AS (SELECT q, count(DISTINCT s) AS n, count(DISTINCT r.vec_id) AS f FROM g LEFT JOIN retrieved r ON r.query_id = q AND r.vec_id = s AND rank <= 5 GROUP BY q), ret AS (SELECT query_id AS q, count(*) AS k FROM retrieved WHERE rank <= 5 GROUP BY 1)
SELECT count(*) AS questions, round(avg(f / n), 9) AS recall, round(avg(CASE WHEN f = n THEN 1 ELSE 0 END), 9) AS complete, round(avg(coalesce(f / k, 0)), 9) AS precision FROM per LEFT JOIN ret USING (q)"""))
def retrieval_at_k(spark, sf_dir):
    r = V.retrieved(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("source_id"), "rank")
    q = V.table(spark, sf_dir, "embeddings").filter("vec_id % 25 = 0").select(F.col("vec_id").alias("question_id"))
    g = q.select("question_id", (F.col("question_id") + 25).alias("source_id")).union(q.select("question_id", F.col("question_id") + 1)).union(r.filter("rank IN (2, 7)").select("question_id", "source_id")).distinct()
    m = M.retrieval_at_k(r, g, 5)
    return m.select("questions", *[F.round(c, 9).alias(c) for c in ("recall", "complete", "precision")])


@query(sql(RETRIEVED, body=""", c AS (SELECT query_id AS q, rank AS cl, 1 + rank % 3 AS w, max(CASE WHEN rank % 2 = 0 THEN 1 ELSE 0 END) AS hit FROM retrieved GROUP BY ALL)
, h AS (SELECT query_id AS q, least(1.0, sum(0.3)) AS h FROM retrieved WHERE rank % 6 = 0 GROUP BY 1)
SELECT q AS question_id, round(p - coalesce(h, 0), 9) AS value FROM (SELECT q, sum(w * hit) / sum(w) AS p FROM c GROUP BY q) LEFT JOIN h USING (q)"""))
def dvaa(spark, sf_dir):
    r = V.retrieved(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("source_id"), "rank")
    claims = r.select("question_id", F.col("rank").alias("claim_id"), (1 + F.col("rank") % 3).alias("weight"), "source_id")
    bad = r.filter("rank % 3 = 0").select("question_id", "source_id", F.lit(0.3).alias("penalty"))
    return M.dvaa(claims, bad, r.filter("rank % 2 = 0").select("question_id", "source_id")).select("question_id", F.round("value", 9).alias("value"))


@query("""WITH g AS (SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), z AS (SELECT *, CAST(k AS DOUBLE) / n AS p, 1.959963984540054 * 1.959963984540054 AS zz FROM g)
SELECT category, n, k, round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 9) AS low, round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 9) AS high FROM z""")
def wilson(spark, sf_dir):
    g = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("category", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)  # of Poisson(1)


@query(sql(SRC, RETRIEVED, body=f""", d AS (SELECT relevance AS v, i, CAST(('0x' || substr(md5(query_id || '|' || vec_id || '|' || i || '|1'), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM retrieved, range(1, 201) t(i))
, m AS (SELECT i, sum(v * n) / sum(n) AS m FROM (SELECT v, i, {' + '.join(f'CASE WHEN u > {c} THEN 1 ELSE 0 END' for c in _CUTS)} AS n FROM d) GROUP BY i)
SELECT round((SELECT avg(relevance) FROM retrieved), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m"""))
def bootstrap_mean(spark, sf_dir):
    b = M.bootstrap_mean(V.retrieved(spark, sf_dir).select("query_id", "vec_id", "relevance"), "relevance", iterations=200)
    return b.select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("""WITH r AS (SELECT event_type AS s, value AS x, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT s AS strategy, count(*) AS runs, round(avg(x), 6) AS mean_seconds, max(x) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(x) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, round(avg(CASE WHEN event_id % 4 > 0 THEN 1.0 ELSE 0.0 END), 6) AS completed FROM r GROUP BY 1""")
def strategy_summary(spark, sf_dir):
    runs = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), F.col("value").alias("seconds"), F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 4 > 0, "completed").otherwise("failed").alias("status"))
    return M.strategy_summary(runs).select("strategy", "runs", F.round("mean_seconds", 6).alias("mean_seconds"), "p50", "p95", F.round("completed", 6).alias("completed"))


@query("""WITH l AS (SELECT user_id % 50 AS d, event_type AS s, value, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id DESC) AS n FROM events), k AS (SELECT * FROM l WHERE n = 1), b AS (SELECT min(event_type) AS b FROM events)
SELECT a.d AS domain, a.s AS strategy, a.value AS seconds, z.value AS base_seconds FROM k a JOIN b ON a.s <> b.b JOIN k z ON z.d = a.d AND z.s = b.b""")
def paired_comparison(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    base = e.agg(F.min("event_type")).first()[0]
    runs = e.select((F.col("user_id") % 50).alias("domain"), F.col("event_type").alias("strategy"), F.col("value").alias("seconds"), F.col("event_id").alias("run_id"))
    return M.paired_comparison(runs, base).drop("ratio")


@query(sql(SRC, REL, body="""SELECT count(*) FILTER (doc_id % 3 <> 0) AS found, count(*) FILTER (doc_id % 4 <> 0) AS gold, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 4 <> 0) AS correct,
  round(count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 4 <> 0) / count(*) FILTER (doc_id % 3 <> 0), 9) AS precision, round(count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 4 <> 0) / count(*) FILTER (doc_id % 4 <> 0), 9) AS recall FROM rel"""))
def relation_pr(spark, sf_dir):
    r = V.relations(spark, sf_dir)
    m = M.relation_pr(r.filter("doc_id % 3 <> 0"), r.filter("doc_id % 4 <> 0"))
    return m.select("found", "gold", "correct", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(sql(SRC, PROF, RETRIEVED, CAND, body=_S2 + """, a AS (SELECT case_id, k % 3 AS category, source_id, CASE WHEN wins THEN 'canonical' WHEN x = 'eligible' THEN 'reference' ELSE x END AS want, rr.g FROM s2 JOIN (SELECT DISTINCT case_id, k FROM cand) USING (case_id)
  JOIN (SELECT case_id, source_id, CASE WHEN row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, ordinal DESC) = 1 THEN 'canonical' ELSE 'reference' END AS g FROM cand) rr USING (case_id, source_id))
, c AS (SELECT category, case_id, min(CAST(want = g AS INTEGER)) AS strict, sum(CAST(want = g AS INTEGER)) AS ok, count(*) AS n, count(*) FILTER (want = 'unresolved') AS ab FROM a GROUP BY ALL)
SELECT CAST(category AS VARCHAR) AS category, CAST(sum(n) AS BIGINT) AS decisions, round(sum(ok) / sum(n), 9) AS decision_accuracy, round(avg(strict), 9) AS strict_accuracy, CAST(CASE WHEN sum(ab) = 0 THEN 1 ELSE 0 END AS DOUBLE) AS abstention_accuracy FROM c GROUP BY ROLLUP (category)"""))
def oracle_metrics(spark, sf_dir):
    c, x, p = V.candidates(spark, sf_dir), V.contexts(spark, sf_dir), V.profiles(spark, sf_dir)
    want = RE.resolve_s2(c, x, p).withColumn("category", (F.regexp_extract("case_id", "(\\d+)", 1).cast("long") % 3).cast("string")).withColumn("reasons", F.array().cast("array<string>"))
    m = M.oracle_metrics(want, RE.resolve_r0(c))
    return m.select("category", "decisions", *[F.round(k, 9).alias(k) for k in ("decision_accuracy", "strict_accuracy", "abstention_accuracy")])


@query(sql(SRC, PROF, RETRIEVED, CAND, body="""SELECT 'profile_missing' AS code, case_id || '/' || source_id AS id FROM cand WHERE source_id NOT IN (SELECT source_id FROM prof) UNION ALL SELECT 'expected_not_candidate', case_id || '/nobody' FROM ctx
UNION ALL SELECT 'candidate_repeated', case_id || '/' || source_id FROM cand WHERE ordinal = 1 UNION ALL SELECT 'profile_repeated', source_id FROM prof WHERE doc_id % 50 = 0"""))
def oracle_validate(spark, sf_dir):
    p, c = V.profiles(spark, sf_dir), V.candidates(spark, sf_dir)
    return M.oracle_problems(p.unionByName(p.filter("doc_id % 50 = 0")), c.unionByName(c.filter("ordinal = 1")), V.contexts(spark, sf_dir).select("case_id", F.lit("nobody").alias("source_id")))


@query(sql(SRC, PROF, body="""SELECT round(avg(CASE WHEN doc_id % 5 <> 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(avg(CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 2 = 0 OR role = 'record' THEN 1.0 ELSE 0.0 END END), 9) AS role_accuracy,
round(avg(CASE WHEN doc_id % 5 <> 0 THEN 1.0 END), 9) AS approved_accuracy, round(avg(CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 2.0 ELSE 0.0 END END), 9) AS rank_error FROM prof"""))
def extraction_metrics(spark, sf_dir):
    p, k = V.profiles(spark, sf_dir), F.col("doc_id")
    found = p.filter("doc_id % 5 <> 0").withColumn("role", F.when(k % 2 == 0, F.col("role")).otherwise("record")).withColumn("authority_rank", F.col("authority_rank") + F.when(k % 3 == 0, 2).otherwise(0))
    m = M.extraction_metrics(p, found, ["role", "approved"])
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query(sql(SRC, PROF, body="SELECT source_id, array_to_string(list_sort(list_distinct(list_filter([lower(trim(document_id)), CASE WHEN doc_id % 2 = 0 THEN 'all' ELSE lower(role) END], lambda v: v <> 'all'))), ',') AS vals FROM prof"))
def scope_value_normalize(spark, sf_dir):
    v = F.array(F.concat(F.lit(" "), "document_id"), F.when(F.col("doc_id") % 2 == 0, "ALL").otherwise(F.upper("role")), F.lit("null"))
    return V.profiles(spark, sf_dir).select("source_id", F.array_join(M.scope_values(v), ",").alias("vals"))


@query(sql(SRC, REL, body="SELECT id, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, kind = 'order_of_precedence' OR (position = 'conditional' AND doc_id % 2 = 0) AS precedence FROM rel"))
def canonical_pair(spark, sf_dir):
    r = V.relations(spark, sf_dir)
    clauses = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("This Precedence rule"))).otherwise(F.col("source_clauses"))
    return r.select("id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), S.expresses_precedence(F.col("kind"), F.col("position"), clauses).alias("precedence"))


@query(sql(SRC, LINES, body="""SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, (SELECT count(*) FROM (SELECT sha256(text) FROM src GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups, count(*) - count(DISTINCT sha256(text)) AS duplicates, 'txt:' || count(*) AS formats,
  (SELECT count(*) FROM lines) AS units, round((count(*) - count(DISTINCT sha256(text))) / CAST(count(*) AS DOUBLE), 4) AS duplicate_ratio FROM src"""))
def corpus_inventory(spark, sf_dir):
    s = V.sources(spark, sf_dir)
    return M.corpus_inventory(s.withColumn("format", X.file_format(F.col("path"))), PA.evidence_lines(s))


_VALUES = ["null", "", " ", '""', '" "', "[]", "[ ]", "{}", "0", "false", '"a"', "text", '["a"]']


@query(FX.values([(v, v.strip() in ("null", "", '""', '" "', "[]", "[ ]", "{}")) for v in _VALUES], "value, blank"))
def json_is_empty(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in _VALUES], "value string").select("value", X.json_is_empty(F.col("value")).alias("blank"))


_OLD_CLAIMS = [("a", "approved", "2023-01-01", ["e1", "e2"]), ("b", "draft", "2022-01-01", ["e1", "e3"]), ("c", "draft", "2022-02-02", ["e4"]), ("d", "stale", None, ["e5"])]
_OLD_EVIDENCE = [("e1", "board", "current", "2024-01-01"), ("e2", "board", None, None), ("e3", "team", "stale", "2024-01-01"), ("e4", None, None, None)]


@query(FX.values([
    ("a", "new", "board", "current", "2024-01-01"), ("b", "new", None, "draft", "2024-01-01"), ("c", "new", None, "draft", "2022-02-02"), ("d", "new", None, "stale", None),
    ("a", "old", "board", "current", "2024-01-01"), ("b", "old", None, None, "2024-01-01"), ("c", "old", None, None, None), ("d", "old", None, None, None),
], "id, kind, authority, status, valid_from"))
def claim_metadata(spark, sf_dir):
    c = spark.createDataFrame([(i, None, s, d, None, [("s", e) for e in es]) for i, s, d, es in _OLD_CLAIMS], "id string, authority string, status string, valid_from string, valid_to string, evidence array<struct<source_id:string,evidence_id:string>>")
    e = spark.createDataFrame([("s", i, a, st, d, None) for i, a, st, d in _OLD_EVIDENCE], "source_id string, evidence_id string, authority string, lifecycle string, valid_from string, valid_to string")
    return CL.source_metadata(c, e).withColumn("kind", F.lit("new")).unionByName(CL.source_metadata(c, e, refresh=True).withColumn("kind", F.lit("old"))).select("id", "kind", "authority", "status", "valid_from")


_CAUSES = [("e1", ["報告", " 原因 "], "配管の腐食"), ("e2", ["原因"], "# 原因"), ("e3", ["Root Cause"], "corrosion"), ("e4", ["原因と対策"], "別"), ("e5", ["復旧"], "弁の交換"), ("e6", ["Corrective Action"], "inspection")]


@query(FX.values([("1", "e1,e3,e9"), ("2", "e5,e9"), ("3", "e6,e9"), ("4", "e9")], "id, evidence"))
def structured_evidence(spark, sf_dir):
    e = spark.createDataFrame([("s", i, t, h) for i, h, t in _CAUSES] + [("t", "e7", "他", ["原因"]), ("s", "e9", "始", [])], "source_id string, evidence_id string, text string, heading_path array<string>")
    c = spark.createDataFrame([(i, p, [("s", "e9")]) for i, p in (("1", "incident_cause"), ("2", "temporary_remediation"), ("3", "permanent_remediation"), ("4", "other"))], "id string, predicate string, evidence array<struct<source_id:string,evidence_id:string>>")
    return CL.structured_evidence(c, e).select("id", F.array_join(F.array_sort(F.col("evidence.evidence_id")), ",").alias("evidence"))


@query(FX.values([("a", "scenario:x:purpose:p"), ("b", "scenario:x"), ("c", "path:docs/sub"), ("d", "source:d"), ("e", "path:docs")], "source_id, dossier"))
def dossier_keys(spark, sf_dir):
    rows = [("a", "docs/a.md", "x", "p"), ("b", "docs/b.md", "x", None), ("c", "docs/sub/c.md", None, "p"), ("d", "d.md", None, None), ("e", "docs\\e.md", None, None)]
    return C.dossier_keys(spark.createDataFrame(rows, "source_id string, path string, scenario string, purpose string"))


_TEXTS = [(1, " a ", None, "a"), (2, None, "b ", "b"), (3, "a", " a", "a"), (4, "a", "b", "a; b"), (5, " ", None, None), (6, "null", "x", "null; x")]


@query(FX.values([(1, "a", "a"), (2, "b", None), (3, "a", "a"), (4, "a; b", "a"), (5, None, None), (6, "null; x", None)], "id, condition, text"))
def conditions(spark, sf_dir):
    d = spark.createDataFrame([t[:3] for t in _TEXTS], "id int, a string, b string")
    return d.select("id", X.append_condition(F.col("a"), F.col("b")).alias("condition"), X.blank_to_null(F.col("a")).alias("text"))


@query(FX.values([("\\\\?\\C:\\docs\\a.md", "C:/docs/a.md"), ("a/./b//c.md", "a/b/c.md"), ("x.md", "x.md")], "raw, path"))
def normalize_path(spark, sf_dir):
    return spark.createDataFrame([("\\\\?\\C:\\docs\\a.md",), ("a/./b//c.md",), ("x.md",)], "raw string").select("raw", X.normalize_path(F.col("raw")).alias("path"))


@query(sql(SRC, REL, body="SELECT kind, min(id) AS id FROM rel GROUP BY kind"))
def first_wins_dedup(spark, sf_dir):
    return R.first_wins(V.relations(spark, sf_dir).select("kind", "id"), ["kind"], "id")


@query(FX.values([("p1", "relations: r1, r2\n[verifier] v\n[excluded] \n[governing] g1\n[governing] g2")], "id, text"))
def render_packets(spark, sf_dir):
    p = spark.createDataFrame([("p1", ["r1", "r2"], [("a", "governing", ["e1", "e2"]), ("v", "verifier", ["e3"]), ("0", "excluded", [])])], "id string, relation_ids array<string>, materials array<struct<source_id:string,role:string,evidence_ids:array<string>>>")
    return P.render(p, spark.createDataFrame([("e1", "g1"), ("e2", "g2"), ("e3", "v")], "evidence_id string, text string"))


@query(sql(SRC, RETRIEVED, body=f""", d AS (SELECT relevance - round(relevance * relevance, 9) AS v, i, CAST(('0x' || substr(md5(query_id || '|' || vec_id || '|' || i || '|1'), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM retrieved, range(1, 101) t(i))
, m AS (SELECT i, sum(v * n) / sum(n) AS m FROM (SELECT v, i, {' + '.join(f'CASE WHEN u > {c} THEN 1 ELSE 0 END' for c in _CUTS)} AS n FROM d) GROUP BY i)
SELECT round((SELECT avg(relevance - round(relevance * relevance, 9)) FROM retrieved), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m"""))
def paired_bootstrap(spark, sf_dir):
    r = V.retrieved(spark, sf_dir).select("query_id", "vec_id", "relevance", F.round(F.col("relevance") * F.col("relevance"), 9).alias("other"))
    return M.paired_bootstrap(r, "relevance", "other", iterations=100).select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(sql(SRC, body="SELECT 'unit:' || source_id AS id, content_hash AS payload FROM src WHERE doc_id % 3 = 0"))
def apply_delta(spark, sf_dir):
    s = V.sources(spark, sf_dir).select(F.concat(F.lit("unit:"), "source_id").alias("id"), F.col("content_hash").alias("payload"), "doc_id")
    old = s.filter("doc_id % 2 = 0").select("id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("payload")).alias("payload"))
    new = s.filter("doc_id % 3 = 0").select("id", "payload")
    return EX.apply_delta(old, EX.delta(old, new))


@query(sql(SRC, MD, body=_MD_UNITS + "SELECT source_id, count(*) AS units FROM unit GROUP BY source_id"))
def rendered_markdown(spark, sf_dir):
    r = PA.render_markdown(PA.parse_markdown(V.markdown(spark, sf_dir)))
    heads = F.regexp_extract_all("markdown", F.lit(r"(?m)^(## [a-z]+ \[[0-9]+-[0-9]+\])$"), F.lit(1))
    return r.select("source_id", F.size(heads).cast("long").alias("units"))


@query(sql(SRC, body="SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'r' || doc_id END AS response FROM src"))
def cache_lookup(spark, sf_dir):
    from ..sources.workspace import cache_lookup as lookup

    asked = V.sources(spark, sf_dir).select(F.concat(F.lit("k"), "doc_id").alias("key"), "doc_id")
    kept = asked.filter("doc_id % 3 = 0").select("key", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("version"), F.concat(F.lit("r"), "doc_id").alias("response"))
    hits, misses = lookup(asked.select("key"), kept, 1)
    return hits.select("key", "response").unionByName(misses.select("key", F.lit(None).cast("string").alias("response")))


@query(FX.values([("ok", "", False), ("bad", "id_invalid,goal_required,users_required,tasks_blank,questions_repeated", False), ("list", "", True)], "name, problems, checklist"))
def intents(spark, sf_dir):
    from .compile import Intent

    made = [("ok", Intent("review", "goal", ["u"], ["t"], ["q"])), ("bad", Intent("Bad", " ", [], ["t", " "], ["q", "q"])), ("list", Intent("r-1", "リリース前の確認", ["u"], ["t"], ["q"]))]
    return spark.createDataFrame([(n, ",".join(i.validate()), i.wants_checklist()) for n, i in made], "name string, problems string, checklist boolean")


@query(sql(SRC, LINES, body="""SELECT 'linear' AS strategy, source_id AS batch_id, CAST(least(8, count(*)) AS BIGINT) AS units FROM lines GROUP BY source_id
UNION ALL SELECT 'dossier', d || ':' || p, CAST(sum(n) AS BIGINT) FROM (SELECT lang AS d, (row_number() OVER (PARTITION BY lang ORDER BY source_id) - 1) // 12 AS p, source_id FROM src) JOIN (SELECT source_id, least(8, count(*)) AS n FROM lines GROUP BY source_id) USING (source_id) GROUP BY d, p"""))
def profile_requests(spark, sf_dir):
    s = V.sources(spark, sf_dir)
    u = PA.evidence_lines(s).withColumn("heading_path", F.array().cast("array<string>"))
    size = F.size(F.from_json("request", "array<struct<evidence_id:string>>")).cast("long").alias("units")
    made = lambda name, *more: PV.profile_requests(u, "fixed", name, *more).select(F.lit(name).alias("strategy"), "batch_id", size)
    return made("linear").unionByName(made("dossier", s.select("source_id", F.col("lang").alias("dossier"))))


@query(sql(SRC, REL, LINES, body=""", e AS (SELECT DISTINCT lang AS d, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM rel JOIN src USING (source_id)), c AS (SELECT d, a, b, (row_number() OVER (PARTITION BY d ORDER BY a, b) - 1) // 8 AS k FROM e)
, s AS (SELECT DISTINCT d, k, unnest([a, b]) AS source_id FROM c) SELECT d || ':' || k AS batch_id, CAST(sum(n) AS BIGINT) AS units FROM s JOIN (SELECT source_id, least(3, count(*)) AS n FROM lines GROUP BY source_id) USING (source_id) GROUP BY d, k"""))
def relation_requests(spark, sf_dir):
    u = PA.evidence_lines(V.sources(spark, sf_dir)).withColumn("heading_path", F.array().cast("array<string>"))
    e = V.relations(spark, sf_dir).join(V.sources(spark, sf_dir).select("source_id", "lang"), "source_id").select(F.col("lang").alias("dossier"), F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    return PV.relation_requests(e, u, "fixed").select("batch_id", F.size(F.from_json("request", "array<struct<evidence_id:string>>")).cast("long").alias("units"))
