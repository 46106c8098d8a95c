"""Registration, stored batches, reruns, failures and intake."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import ProfilingConfig, RegistrationConfig
from ledgerlens.operators import reads, registration
from ledgerlens.plans import profile as P, register as R
from ledgerlens.schemas import SOURCE_FILES, SOURCE_SYSTEMS
from ledgerlens.sources.catalog import Catalog
from ledgerlens.streaming import intake
from ledgerlens.streaming.intake import landing_stream, new_empty_files, start_intake

NOW = datetime(2024, 6, 1)
CONFIG = RegistrationConfig(max_bytes=128)
GOOD = b"date,amount\n2026-01-01,10.00\n"


@pytest.fixture(scope="module")
def systems(spark):
    rows = [("bank", "Bank", "", "csv", True), ("old", "Old bank", "", "csv", False)]
    return spark.createDataFrame(rows, SOURCE_SYSTEMS)


def landing(spark, folder, files):
    """Real files with a manifest: (stored as, original name, mime type, system, content)."""
    rows = []
    for i, (name, mime, system, content) in enumerate(files):
        path = folder / f"f{i}"
        path.write_bytes(content)
        rows.append((f"file:{path}", name, mime, system, NOW))
    manifest = spark.createDataFrame(
        rows, "path STRING, original_filename STRING, mime_type STRING, source_system_code STRING, discovered_at TIMESTAMP"
    )
    return R.read_landing(spark, str(folder), manifest, CONFIG)


CASES = [
    ("ledger.csv", "text/csv", "bank", GOOD, "registered", None),
    ("again.csv", "text/csv", "bank", GOOD, "duplicate", None),
    ("ledger.txt", "text/csv", "bank", b"1", "failed", "unsupported_extension"),
    ("big.csv", "text/csv", "bank", b"x" * 129, "failed", "file_too_large"),
    ("full.csv", "text/csv", "bank", b"x" * 128, "registered", None),
    ("a.csv", "text/csv", "none", b"2", "failed", "missing_source_system"),
    ("a.csv", "text/csv", "old", b"3", "failed", "missing_source_system"),
    ("a.csv", "application/pdf", "bank", b"4", "failed", "invalid_mime_type"),
    ("../escape.csv", "text/csv", "bank", b"5", "failed", "invalid_filename"),
    ("folder\\file.csv", "text/csv", "bank", b"6", "failed", "invalid_filename"),
    ("..", "text/csv", "bank", b"7", "failed", "invalid_filename"),
    ("€.€", "text/csv", "bank", b"8", "failed", "invalid_filename"),
    ("x" * 256, "text/csv", "bank", b"9", "failed", "invalid_filename"),
    ("empty.CSV", None, "bank", b"", "registered", None),
    ("both.txt", "application/pdf", "none", b"10", "failed", "missing_source_system"),
]


def test_registration_outcomes(spark, systems, tmp_path):
    landed = landing(spark, tmp_path, [c[:4] for c in CASES])
    registry = spark.createDataFrame([], "sha256_checksum STRING")
    batch = R.register_batch(landed, systems, registry, "b1", NOW, CONFIG)
    found = {r.path.rsplit("f", 1)[1]: (r.status, r.code) for r in R.upload_responses(batch.outcomes).collect()}
    expected = {str(i): (c[4], "duplicate" if c[4] == "duplicate" else c[5]) for i, c in enumerate(CASES)}
    assert found == expected
    files = {r.original_filename: r for r in batch.files.collect()}
    assert files["ledger.csv"].sha256_checksum == "533c29bb8802c3bb27a313a1741941cc55bf0a763e190d5efe8de19eb9e8994e"
    assert files["ledger.csv"].stored_filename == f"{hashlib.sha256(GOOD).hexdigest()}_ledger.csv"
    assert files["empty.CSV"].mime_type == "application/octet-stream" and files["empty.CSV"].file_extension == ".csv"
    assert batch.runs.count() == batch.steps.count() == len(CASES)
    known = batch.files.select("sha256_checksum")
    again = R.register_batch(landed, systems, known, "b2", NOW, CONFIG)
    assert again.files.count() == 0
    assert again.outcomes.filter("outcome = 'duplicate'").count() == 4


def test_files_that_have_not_arrived_fail(spark, systems, tmp_path):
    (tmp_path / "an empty é.csv").write_bytes(b"")
    (tmp_path / "there.csv").write_bytes(GOOD)
    names = ["an empty é.csv", "there.csv", "never.csv"]
    manifest = spark.createDataFrame(
        [(f"file:{tmp_path}/{n}", n, "text/csv", "bank", NOW) for n in names],
        "path STRING, original_filename STRING, mime_type STRING, source_system_code STRING, discovered_at TIMESTAMP",
    )
    landed = R.read_landing(spark, str(tmp_path), manifest)
    batch = R.register_batch(landed, systems, spark.createDataFrame([], "sha256_checksum STRING"), "b", NOW)
    found = {r.path.rsplit("/", 1)[1]: (r.status, r.code) for r in R.upload_responses(batch.outcomes).collect()}
    assert found == {"an empty é.csv": ("registered", None), "there.csv": ("registered", None), "never.csv": ("failed", "file_not_found")}
    assert {r.original_filename: r.file_size_bytes for r in batch.files.collect()} == {"an empty é.csv": 0, "there.csv": len(GOOD)}


def test_uncommitted_and_replayed_batches(spark, tmp_path):
    catalog = Catalog(spark, f"file:{tmp_path}/catalog")
    assert catalog.read("source_systems").count() == 0
    rows = spark.createDataFrame([("a", "A", "", "csv", True)], SOURCE_SYSTEMS)
    catalog.append("source_systems", rows, "one")
    assert catalog.read("source_systems").count() == 0
    catalog.commit("one", NOW)
    catalog.append("source_systems", rows, "one")
    catalog.append("source_systems", rows.unionAll(rows), "two")
    assert catalog.read("source_systems").count() == 1
    catalog.commit("two", NOW)
    assert catalog.read("source_systems").count() == 3


@pytest.fixture(scope="module")
def profiled(spark, tmp_path_factory):
    """Four registered files: one empty, one fine, one with a very long field, one gone; profiled twice."""
    root = tmp_path_factory.mktemp("profiled")
    folder = root / "files"
    folder.mkdir()
    contents = {"empty": b"", "good": GOOD, "wide": b"id,amount\n1," + b"9" * 200_000 + b"\n", "gone": b"id,amount\n1,2\n"}
    for name in ("good", "wide"):
        (folder / name).write_bytes(contents[name])
    (folder / "copy of good").write_bytes(GOOD)
    catalog = Catalog(spark, f"file:{root}/catalog")
    ids = {name: hashlib.sha256(c).hexdigest() for name, c in contents.items()}
    known = spark.createDataFrame(
        [(ids[n], "bank", f"{n}.csv", f"{ids[n]}_{n}.csv", "", ".csv", "text/csv", len(c), ids[n], "registered", NOW, NOW) for n, c in contents.items()],
        SOURCE_FILES,
    )
    catalog.append("source_files", known, "files")
    catalog.commit("files", NOW)
    for day in (2, 3):
        P.profile_registered(catalog, f"file:{folder}", f"run-{day}", NOW.replace(day=day), only_unprofiled=False)
    return catalog, ids, folder


def test_rerun_keeps_one_profile_and_all_runs(profiled):
    catalog, ids, _ = profiled
    assert catalog.read("source_file_profiles").count() == 6
    latest = {r.source_file_id: (r.generated_at.day, r.status, r.row_count) for r in catalog.latest_profiles().collect()}
    assert latest.keys() == {ids["good"], ids["empty"], ids["wide"]}
    assert latest[ids["good"]][:2] == (3, "completed") and latest[ids["empty"]][:2] == (3, "blocked") and latest[ids["wide"]][2] == 1
    assert catalog.latest_column_profiles().count() == 4
    issues = catalog.latest_issues()
    assert issues.count() == issues.select("issue_fingerprint").distinct().count()
    assert {r["count"] for r in catalog.read("pipeline_runs").groupBy("source_file_id").count().collect()} == {2}


def test_failures_are_audited(profiled):
    catalog, ids, _ = profiled
    runs = {r.source_file_id: r for r in catalog.read("pipeline_runs").filter("batch_id = 'run-2'").collect()}
    assert runs[ids["good"]].status == "completed" and runs[ids["good"]].records_extracted == 1
    assert runs[ids["gone"]].error_message == "Registered source file is missing"
    nested = reads.runs_with_steps(catalog.read("pipeline_runs"), catalog.read("pipeline_run_steps"))
    steps = {r.source_file_id: [s.status for s in r.steps] for r in nested.filter("batch_id = 'run-3'").collect()}
    assert steps[ids["good"]] == ["completed"] * 9
    assert steps[ids["gone"]] == ["failed"] + ["pending"] * 8


def test_only_unprofiled(profiled, spark):
    catalog, ids, folder = profiled
    stored = P.profile_registered(catalog, f"file:{folder}", "run-4", NOW.replace(day=4))
    assert {r.source_file_id for r in stored.runs.collect()} == {ids["gone"]}
    newer = P.profile_registered(catalog, f"file:{folder}", "run-5", NOW.replace(day=5), config=ProfilingConfig(version="2.0.0"))
    assert {r.source_file_id for r in newer.profiles.collect()} == {ids["good"], ids["empty"], ids["wide"]}
    assert catalog.latest_profiles().count() == 6
    latest = catalog.latest_profile_of_files().collect()
    assert sorted(r.source_file_id for r in latest) == sorted([ids["good"], ids["empty"], ids["wide"]])
    assert {(r.profile_version, r.generated_at.day) for r in latest} == {("2.0.0", 5)}


def test_files_without_checksum_are_refused(spark):
    files = spark.createDataFrame([("a", None, NOW, None)], "path STRING, sha256_checksum STRING, discovered_at TIMESTAMP, error_code STRING")
    with pytest.raises(Exception, match="without a checksum"):
        registration.mark_duplicates(files, spark.createDataFrame([], "sha256_checksum STRING")).collect()


def test_pages_and_filters(spark):
    df = spark.range(45).select(F.col("id").cast("string").alias("status"), (F.col("id") % 3).cast("string").alias("severity"), "id")
    assert [r.id for r in reads.page(df, [F.desc("id")], 3, 20).collect()] == [4, 3, 2, 1, 0]
    assert reads.total(reads.filter_issues(df, severity="1", status=None)).first().total == 15
    for bad in (dict(page=0), dict(page_size=0), dict(page_size=101)):
        with pytest.raises(ValueError):
            reads.page(df, [F.col("id")], **bad)
    with pytest.raises(ValueError):
        reads.filter_issues(df, nonsense="1")


def test_intake_equals_batch_and_survives_replay(spark, systems, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    catalog = Catalog(spark, f"file:{tmp_path}/catalog")

    def run(checkpoint):
        stream = landing_stream(spark, f"file:{folder}", CONFIG, files_per_batch=2)
        start_intake(catalog, stream, f"file:{tmp_path}/{checkpoint}", systems, F.lit("bank"), F.lit("text/csv"), CONFIG, lambda: NOW).awaitTermination()

    for name, content in (("a.csv", GOOD), ("b.csv", b"b"), ("c.csv", GOOD), ("d.csv", b"x" * 129)):
        (folder / name).write_bytes(content)
    run("checkpoint")
    (folder / "e.csv").write_bytes(b"b")
    (folder / "f.csv").write_bytes(b"f")
    run("checkpoint")
    run("checkpoint")

    def state():
        runs = catalog.read("pipeline_runs").groupBy("status").count().collect()
        return {r.status: r["count"] for r in runs}, {r.sha256_checksum for r in catalog.read("source_files").collect()}

    expected = {"registered": 3, "duplicate": 2, "failed": 1}, {hashlib.sha256(c).hexdigest() for c in (GOOD, b"b", b"f")}
    assert state() == expected
    assert catalog.read("source_files").count() == 3


def test_intake_takes_every_empty_file_once(spark, systems, tmp_path):
    folder = tmp_path / "landing"
    (folder / "deep").mkdir(parents=True)
    catalog = Catalog(spark, f"file:{tmp_path}/catalog")

    def run(checkpoint="checkpoint"):
        stream = landing_stream(spark, f"file:{folder}", CONFIG, files_per_batch=2)
        start_intake(
            catalog, stream, f"file:{tmp_path}/{checkpoint}", systems, F.lit("bank"), F.lit("text/csv"), CONFIG, lambda: NOW, f"file:{folder}"
        ).awaitTermination()

    def statuses():
        return {r.status: r["count"] for r in catalog.read("pipeline_runs").groupBy("status").count().collect()}

    (folder / "empty one.csv").write_bytes(b"")
    run()  # nothing but an empty file
    assert statuses() == {"registered": 1}
    (folder / "a.csv").write_bytes(GOOD)
    (folder / "deep" / "empty.csv").write_bytes(b"")
    (folder / "empty.exe").write_bytes(b"")
    run()
    assert statuses() == {"registered": 2, "duplicate": 1, "failed": 1}
    run()
    (folder / "empty one.csv").write_bytes(b"filled too late")  # a path counts once
    run()
    assert statuses() == {"registered": 2, "duplicate": 1, "failed": 1}
    files = {r.sha256_checksum: r.file_size_bytes for r in catalog.read("source_files").collect()}
    assert files == {hashlib.sha256(c).hexdigest(): len(c) for c in (b"", GOOD)}


def test_a_run_of_many_batches_lists_its_folder_once(spark, systems, tmp_path, monkeypatch):
    """The cost of a batch must not grow with the files of the batches before it."""
    folder, listed = tmp_path / "landing", []
    folder.mkdir()
    for name, content in (("a.csv", GOOD), ("b.csv", b"b"), ("c.csv", b"c"), ("d.csv", b"")):
        (folder / name).write_bytes(content)
    listing = intake.listed_paths
    monkeypatch.setattr(intake, "listed_paths", lambda *a: listed.append(a) or listing(*a))
    catalog = Catalog(spark, f"file:{tmp_path}/catalog")
    stream = landing_stream(spark, f"file:{folder}", CONFIG, files_per_batch=1)
    start_intake(
        catalog, stream, f"file:{tmp_path}/checkpoint", systems, F.lit("bank"), F.lit("text/csv"), CONFIG, lambda: NOW, f"file:{folder}"
    ).awaitTermination()
    assert catalog.commits().count() > 2 and len(listed) == 1
    assert {r.sha256_checksum for r in catalog.read("source_files").collect()} == {hashlib.sha256(c).hexdigest() for c in (GOOD, b"b", b"c", b"")}


def test_empty_files_of_a_replayed_batch(spark, tmp_path):
    """A batch that runs again takes in what it took in before, and nothing that a later listing holds."""
    folder, seen = tmp_path / "landing", f"file:{tmp_path}/seen"
    folder.mkdir()
    take = lambda number: sorted(r.path.rsplit("/", 1)[1] for r in new_empty_files(spark, f"file:{folder}", seen, number, NOW).collect())
    (folder / "a").write_bytes(b"")
    assert take(0) == ["a"]
    (folder / "b").write_bytes(b"")
    (folder / "c").write_bytes(b"full")
    assert take(0) == ["a"] and take(1) == ["b"] and take(1) == ["b"] and take(2) == []
