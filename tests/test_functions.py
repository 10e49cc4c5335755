import pytest
from pyspark.sql import functions as F

from attestor.functions import scope as S
from attestor.functions import temporal as T
from attestor.functions import text as X

N = None


@pytest.mark.parametrize(
    ("frm", "to", "as_of", "effective", "active"),
    [
        (N, N, N, True, True), ("2024-01-01", N, N, False, False), (N, N, "2024-05-01", True, True), ("2024-01-01", "2024-05-01", "2024-05-01", True, True),
        ("2024-05-02", N, "2024-05-01", False, False), (N, "2024-04-30", "2024-05-01", False, False), ("soon", N, "2024-05-01", True, False), (N, "30 minutes", "2024-05-01", True, False), (N, N, "later", True, False),
    ],
)
def test_dates(spark, frm, to, as_of, effective, active):
    df = spark.createDataFrame([(frm, to, as_of)], "f string, t string, a string")
    row = df.select(T.effective(F.col("f"), F.col("t"), F.col("a")).alias("e"), T.relation_active(F.col("f"), F.col("t"), F.col("a")).alias("r")).first()
    assert (row.e, row.r) == (effective, active)


def _scopes(spark, a, b, f):
    mk = lambda d: S.scope_of(**{k: F.array(*[F.lit(x) for x in v]) for k, v in d.items()})
    return spark.range(1).select(f(mk(a), mk(b)).alias("x")).first().x


def test_scopes(spark):
    match = lambda a, b: _scopes(spark, a, b, S.scope_match)
    assert match({}, {"sites": ["a"]}) == "match"
    assert match({"sites": ["a"]}, {}) == "missing"
    assert match({"sites": ["a"]}, {"sites": ["A"]}) == "mismatch"  # case counts
    assert match({"sites": ["a"], "products": ["p"]}, {"products": ["q"]}) == "mismatch"  # mismatch beats missing
    over = lambda a, b: _scopes(spark, a, b, S.compatible_for_override)
    assert over({}, {"sites": ["a"]}) and over({"sites": ["a"]}, {"sites": ["A"]}) and not over({"sites": ["a"]}, {"products": ["p"]})
    fine = lambda a, b: _scopes(spark, a, b, S.strict_refinement)
    assert fine({"sites": ["a"]}, {}) and fine({"sites": ["a"]}, {"sites": ["A", "b"]}) and not fine({"sites": ["a"]}, {"sites": ["a"]}) and not fine({}, {"sites": ["a"]})


def test_text(spark):
    def one(f, value):
        return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x

    assert one(X.trim, "　x\t") == "x"
    assert one(X.lines, "a\r\n\nb\n") == ["a", "", "b"] and one(X.lines, "") == [] and one(X.lines, None) == []
    assert one(X.heading_level, "### x") == 3 and one(X.heading_level, "####### x") is None and one(X.heading_level, "#x") is None
    assert one(X.is_list, "10. x") and one(X.is_list, ". x") and not one(X.is_list, "x - y")
    assert one(lambda c: X.front_matter_value(c, "status"), '---\nstatus: "draft"\n---\n') == "draft"
    assert one(lambda c: X.front_matter_value(c, "status"), "---\nstatus: NULL\n---\n") is None
    assert one(lambda c: X.front_matter_value(c, "status"), "no front\nstatus: x\n") is None
    assert one(X.file_format, "a/b.TXT") == "txt" and one(X.file_format, "a/b") == "unknown" and one(X.file_format, ".hidden") == "unknown"
    assert one(X.duration_constraint, "10営業日以内") == "10:営業日:maximum" and one(X.duration_constraint, "早め") is None
    assert one(X.shingles, "ab") == [] and one(X.shingles, "abcd-efghi") == ["abcdefgh", "bcdefghi"]
    assert X.glob_regex("a/**/b?.md") == r"^a/(?:.*/)?b.\.md$"


def test_conflict_ids_ignore_order(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string").select(X.conflict_id(F.col("x"), F.col("y")).alias("i"))
    assert len({r.i for r in df.collect()}) == 1


def test_shingle_count(spark):
    """As many as shingles has, for ASCII and other texts, white space, case that depends on place, and over 256 letters;
    a filter on it leaves one pass, and no window is made as a string."""
    han = "".join(chr(0x4E00 + i * 7 % 900) for i in range(3000))
    texts = [None, "", "ab", "abcd-efgh", "abcd-efghi", "ABC def\x00GHI, 12 34\n" * 3, "Straße über Ärger: ÀÉ\u0300", "ΟΔΟΣ ΣΟΦΟΣ, ΣΑΣ ΟΔΟΣ", "İstanbul İzmir ISPARTA", "😀 abcdefgh 😀 ijk", "𠮷野家𠮷野家𠮷野家𠮷野家", "٣٤٥ ½ Ⅷ x² 一二三四五六", han + han, "aaaaaaaaaaaaaaaa", "x" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.size(X.shingles(F.col("t"))).alias("a"), X.shingle_count(F.col("t")).alias("b"))
    rows = {r.id: (r.a, r.b) for r in df.collect()}
    assert rows.pop(0)[1] is None and all(a == b for a, b in rows.values()) and rows[10] == (3, 3) and rows[12][1] > 900 and rows[13][1] == 1
    assert X.distinct_windows("abcabcabcd", 3) == 4 and X.distinct_windows("abcabc", 7) == 0


def test_shingles_are_counted_once(spark):
    from attestor.plans.catalogue import char_shingles

    plan = char_shingles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
