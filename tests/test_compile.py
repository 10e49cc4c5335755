import json

import pytest

from attestor.plans import compile as C
from attestor.sources.workspace import Workspace, WorkspaceError
from attestor.streaming import incremental as I

DOC = '---\ndocument_id: {id}\nstatus: approved\ndocument_type: {type}\nscenario: s\npurpose: governance\nscope: {{"products": ["p"]}}\n---\n# Title {id}\n\nBody of {id} must apply.\n'


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text(DOC.format(id="A", type="approval_record"))
    (root / "copy.md").write_text(DOC.format(id="A", type="approval_record"))
    (root / "sub" / "b.md").write_text(DOC.format(id="B", type="policy").replace("approved", "current"))
    (root / "c.txt").write_text("one\n\ntwo\nthree\n")
    (root / "d.bin").write_text("x")
    return root


def test_scan_twice(spark, corpus, tmp_path):
    ws = Workspace.init(tmp_path)
    C.scan(spark, str(corpus), ws)
    first = json.loads((ws.control / "manifest.json").read_text())["summary"]
    assert (first["parsed"], first["duplicates"], first["unsupported"], first["added"], first["cache_hits"]) == (3, 1, 1, 5, 0)
    (corpus / "c.txt").write_text("one\n\ntwo\nfour\n")
    (corpus / "d.bin").unlink()
    C.scan(spark, str(corpus), ws)
    second = json.loads((ws.control / "manifest.json").read_text())
    assert (second["summary"]["changed"], second["summary"]["unchanged"], second["removed_paths"]) == (1, 3, ["d.bin"])


def test_scan_of_odd_files(spark, tmp_path):
    """A picture, broken text, empty and large files leave their row and never end the scan; units are taken over."""
    root = tmp_path / "docs"
    root.mkdir()
    for name, content in {"ok.md": b"# T\n\nbody\n", "latin.txt": b"caf\xe9", "empty.md": b" \n", "pic.png": b"\x89PNG\xff\xfe", "big.txt": b"x" * 500, "two.txt": b"one\n\ntwo"}.items():
        (root / name).write_bytes(content)
    ws = Workspace.init(tmp_path)
    rows = {r.path: r for r in C.scan(spark, str(root), ws, max_bytes=400).collect()}
    assert {p: (r.state, r.warnings) for p, r in rows.items()} == {"ok.md": ("parsed", []), "latin.txt": ("error", ["no UTF-8"]), "empty.md": ("error", ["empty"]), "pic.png": ("unsupported", []), "big.txt": ("error", ["beyond the size limit"]), "two.txt": ("parsed", [])}
    import hashlib

    assert rows["latin.txt"].content_hash == hashlib.sha256(b"caf\xe9").hexdigest() and len(rows["ok.md"]) == 13
    before = {tuple(r) for r in ws.read_table(spark, "units").select("source_id", "evidence_id").collect()}
    (root / "two.txt").write_text("one\n\nthree")
    (root / "pic.png").unlink()
    again = {r.path: r for r in C.scan(spark, str(root), ws, max_bytes=400).collect()}
    assert json.loads((ws.control / "manifest.json").read_text())["summary"]["cache_hits"] == 1
    after = {tuple(r) for r in ws.read_table(spark, "units").select("source_id", "evidence_id").collect()}
    assert len(before & after) == 3 and len(after - before) == 1  # the markdown's two units and the unchanged paragraph
    assert again["pic.png"].state == "removed" and again["ok.md"].first_seen_scan == rows["ok.md"].last_seen_scan and again["two.txt"].changed_scan == again["two.txt"].last_seen_scan != again["ok.md"].changed_scan


def test_catalog_survives_a_cut_off_swap(spark, tmp_path):
    ws = Workspace.init(tmp_path)
    ws.write_table(spark.range(3), "catalog")
    (ws.control / "catalog.parquet").rename(ws.control / "catalog.parquet.old")
    assert ws.read_catalog(spark).count() == 3
    ws.write_table(ws.read_catalog(spark).filter("id > 0"), "catalog")
    assert ws.read_catalog(spark).count() == 2


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Two documents scanned and compiled."""
    import time

    base = tmp_path_factory.mktemp("ws")
    root = base / "docs"
    root.mkdir()
    (root / "a.md").write_text(DOC.format(id="A", type="approval_record"))
    (root / "b.md").write_text(DOC.format(id="B", type="policy").replace("approved", "current"))
    (base / "corpus.yaml").write_text("authority_hints:\n  - pattern: b.md\n    authority: board\nauthority_precedence: [board, team]\n")
    (base / "intent.yaml").write_text("id: review\ngoal: goal\nusers: [u]\ntasks: [t]\nquestions: [q]\n")
    ws = Workspace.init(base)
    C.scan(spark, str(root), ws)

    def extract(evidence):
        e = evidence.filter("kind = 'paragraph'").select("source_id", "evidence_id")
        cols = {"id": "concat('c_', source_id)", "subject": "'the rule'", "predicate": "'retention_period'", "object": "source_id", "condition": "cast(null as string)", "valid_from": "'3日以内'", "valid_to": "cast(null as string)", "authority": "cast(null as string)", "status": "cast(null as string)", "confidence": "cast(1 as float)"}
        return e.selectExpr(*[f"{v} AS {k}" for k, v in cols.items()], "array(named_struct('source_id', source_id, 'evidence_id', evidence_id)) AS evidence")

    began = time.monotonic()
    out = C.compile_build(spark, ws, C.load_intent(base / "intent.yaml"), base / "one", extract)
    return base, out, time.monotonic() - began


def test_compile(spark, built):
    base, one, seconds = built
    t = lambda n: spark.read.parquet(f"{one['path']}/{n}")
    assert seconds < 90 and one["metrics"]["source_documents"] == 2 and one["metrics"]["claims"] == 2
    ids = {r.document_id: r.source_id for r in t("profiles").collect()}
    assert [(r.kind, r.position, r.source_id, r.target_id) for r in t("relations").collect()] == [("approves", "non_effective", ids["A"], ids["B"])]
    assert {r.source_id: (r.role, r.level, r.authority_rank, r.approved, r.official_record) for r in t("profiles").collect()} == {ids["A"]: ("record", "informational", 0, True, True), ids["B"]: ("normative", "mandatory", 0, True, False)}
    claims = {r.object: r for r in t("claims").collect()}
    assert claims[ids["B"]].authority == "board" and claims[ids["B"]].status == "current" and claims[ids["A"]].valid_from is None
    # two objects in one slot: the record does not rule
    (conflict,) = t("conflicts").collect()
    assert (conflict.kind, conflict.status, conflict.winner) == ("explicit_override", "resolved", claims[ids["B"]].id)
    # the policy has no superseded version beside it, so the slot for it stays open
    assert [(r.code, r.target) for r in t("diagnostics").collect()] == [("REL-UNRESOLVED-REQUIRED-SLOT", ids["B"])] and one["status"] == "completed_with_warnings"
    assert [[e.source_id for e in r.evidence] for r in t("relations").collect()] == [[ids["A"], ids["B"]]]
    assert t("packets").count() == 1 and "board" in (base / "one" / "retrieval_profile.yaml").read_text()
    with pytest.raises(WorkspaceError):
        C.build(spark, t("units"), C.Intent("Bad Id", "", [], [], []), base / "two")


def test_recompile_export_and_delta(spark, built):
    base, one, _ = built
    two = C.recompile(spark, one["path"], C.load_intent(base / "intent.yaml"), base / "again")
    assert two["status"] == one["status"] and {k: v for k, v in two["metrics"].items() if k != "duration_ms"} == {k: v for k, v in one["metrics"].items() if k != "duration_ms"}
    n = C.export_jsonl(spark, one["path"], str(base / "out"))
    assert n == spark.read.parquet(f"{one['path']}/evidence").count() + 2  # a packet and a diagnostic
    assert [d["count"] for d in C.report(spark, one["path"])["diagnostics"]] == [1]
    row = C.export_delta(spark, one["path"], two["path"], str(base / "delta"))
    assert row["deletes"] == 0 and row["unchanged"] > 0


def test_workspace_guards(tmp_path):
    with pytest.raises(WorkspaceError):
        Workspace.open(tmp_path)
    ws = Workspace.init(tmp_path)
    Workspace.init(tmp_path)
    ws.bind_source_root("a")
    ws.bind_source_root("a")
    with pytest.raises(WorkspaceError):
        ws.bind_source_root("b")
    with ws.lock("scan"), pytest.raises(WorkspaceError), ws.lock("compile"):
        pass
    with ws.lock("again"):
        pass
    assert C.Intent("Bad Id", " ", [], ["t", "t"], ["q"]).validate() == ["id_invalid", "goal_required", "users_required", "tasks_repeated"]


def test_stream_scan(spark, corpus, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    I.scan_stream(spark, str(corpus), out, check)
    (corpus / "e.txt").write_text("new\n")
    I.scan_stream(spark, str(corpus), out, check)
    states = {r.path: r.state for r in I.current_sources(spark, out).collect()}
    assert states["e.txt"] == "parsed" and states["copy.md"] == "duplicate" and states["d.bin"] == "unsupported" and len(states) == 6


def test_answers_are_kept_by_kind(spark, tmp_path):
    from attestor.operators import normalize as N
    from attestor.sources import providers as PV

    class Counting(PV.FixedProvider):
        def extract(self, request):
            with open(tmp_path / "asked", "a") as f:
                f.write("x")
            return self.response

    units = spark.createDataFrame([("s", f"e{i}", i, f"text {i}") for i in range(20)], "source_id string, evidence_id string, line_start int, text string")
    good = '{"profiles": [{"source_id": "s", "role": "analysis", "level": "recommended", "authority_rank": 3, "approved": true, "evidence": [{"source_id": "s", "evidence_id": "e1"}]}]}'
    folder = PV.cache_folder(str(tmp_path), "profiles")
    for _ in range(2):
        found = PV.entities_of(PV.answered(units, Counting(good), folder), "profiles")
        profiles, problems = N.validate_profiles(found, units)
        assert [(r.role, r.authority_rank) for r in profiles.collect()] == [("analysis", 3)] and [r.code for r in problems.collect()] == ["PRF-INVALID-PROFILE"]
    assert (tmp_path / "asked").read_text() == "xx" and PV.load_cache(spark, folder).count() == 2  # each batch once
    assert PV.entities_of(PV.answered(units, PV.FixedProvider("no JSON")), "relations").count() == 0
    with pytest.raises(ValueError):
        PV.cache_folder("x", "others")


def test_executors_and_contracts(spark):
    from pyspark.sql import functions as F

    from attestor.sources import providers as PV

    none = F.array().cast("array<string>")
    units = spark.createDataFrame([(s, f"{s}{i}", i, f"text {i}") for s in "abc" for i in range(10)], "source_id string, evidence_id string, line_start int, text string").withColumn("heading_path", none)
    asked = {n: PV.profile_requests(units, "fixed", n, spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "e")], "source_id string, dossier string")).count() for n in PV.STRATEGIES}
    assert asked == {"global": 1, "linear": 3, "dossier": 2}
    edges = spark.createDataFrame([("d", "a", "b"), (None, "a", "c")], "dossier string, a string, b string")
    assert PV.relation_requests(edges, units, "fixed", "dossier").count() == 2
    found = PV.relation_executor(PV.FixedProvider('{"relations": [{"id": "r", "kind": "amends", "source_id": "a", "target_id": "b", "evidence": []}]}'))(edges, units).collect()
    assert [(r.ordinal, r.kind) for r in found] == [(1, "amends"), (2, "amends")]
    assert PV.profile_executor(PV.FixedProvider('{"profiles": [{"source_id": "a"}]}'), strategy="global")(units).count() == 1
    with pytest.raises(ValueError):
        PV.relation_requests(edges, units, "fixed", "global")
    assert len({PV.contract(k) for k in PV.KINDS}) == 3 and "id" not in PV.response_schema("claims")["properties"]["claims"]["items"]["properties"]


def test_provider_and_cache(spark):
    from pyspark.sql import functions as F

    from attestor.sources import providers as PV
    from attestor.sources.workspace import cache_lookup

    units = spark.createDataFrame([("s", f"e{i}", i, f"text {i}") for i in range(20)], "source_id string, evidence_id string, line_start long, text string")
    asked = PV.requests(units, "fixed")
    assert asked.count() == 2 and asked.select("key").distinct().count() == 2
    fixed = PV.FixedProvider('{"claims": [{"subject": " a ", "predicate": "limit", "object": "5", "confidence": 0.5, "evidence": [{"source_id": "s", "evidence_id": "e1"}]}]}')
    claims = PV.extractor(fixed)(units).collect()
    assert len(claims) == 1 and claims[0].subject == "a" and claims[0].evidence[0].evidence_id == "e1"
    assert PV.extractor(PV.MetadataProvider())(units).count() == 0
    cache = asked.limit(1).select("key", F.lit(1).alias("version"), F.lit('{"claims": []}').alias("response"))
    hits, misses = cache_lookup(asked, cache, 1)
    assert (hits.count(), misses.count(), PV.cache_report(cache).first().entries) == (1, 1, 1)
