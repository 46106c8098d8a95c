"""Folders of very many short files: what a file costs beside its bytes."""

import gc
import weakref

import entry_queries.more_inputs as M
from ledgerlens.sources import corpus as K
from ledgerlens.streaming import intake


def read(folder):
    return sorted(p.read_bytes() for p in folder.iterdir() if p.name.startswith("part-"))


def test_writing_tasks_make_the_files_themselves(spark, tmp_path):
    """Spark's writer, with a checksum beside each file and processes that set its rights, makes one file a task."""
    contents = [b"a,b\n1,2\n", b"c", None, "é\n".encode(), b"\n\n", b"", b"c"]
    rows = spark.createDataFrame([(c,) for c in contents], "content binary").coalesce(1)
    M.write_files(rows, f"file://{tmp_path}/files")
    assert read(tmp_path / "files") == sorted([b"a,b\n1,2\n", b"c\n", b"\n", "é\n".encode(), b"\n\n", b"\n", b"c\n"])
    assert len(list((tmp_path / "files").glob(".part-*.crc"))) == 1
    M.write_files(rows.limit(0), str(tmp_path / "empty"))
    assert read(tmp_path / "empty") == [b""]


def test_given_paths_are_listed_by_few_tasks(spark, tmp_path):
    """The settings that the source of a stream, and the reader of a list of paths, go by."""
    for make in (
        lambda: intake.landing_stream(spark, str(tmp_path)),
        lambda: K.parse_folder(spark, str(tmp_path), spark.createDataFrame([], "path STRING, file_id STRING, length BIGINT")),
    ):
        spark.conf.set(K.LISTING, 10_000)
        make()
        assert int(spark.conf.get(K.LISTING)) == K.LISTING_TASKS
        spark.conf.set(K.LISTING, 7)
        make()
        assert spark.conf.get(K.LISTING) == "7"
    spark.conf.unset(K.LISTING)


def test_a_batch_is_read_by_few_tasks(spark, tmp_path):
    """Spark alone makes a part for 32 files; here there are no more than so many for each core."""
    folder, parts = tmp_path / "landing", []
    folder.mkdir()
    for n in range(40 * K.TASKS_A_CORE * spark.sparkContext.defaultParallelism):
        (folder / f"{n}.txt").write_text(f"{n}\n")
    stream = intake.landing_stream(spark, str(folder))
    stream.writeStream.foreachBatch(lambda rows, _: parts.append((rows.rdd.getNumPartitions(), rows.count()))).option(
        "checkpointLocation", str(tmp_path / "checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    assert parts == [(K.TASKS_A_CORE * spark.sparkContext.defaultParallelism, len(list(folder.iterdir())))]


def test_files_of_a_folder_are_parsed_by_few_tasks(spark, tmp_path, monkeypatch):
    """Ranges of long files still get tasks of their own."""
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    listed = spark.createDataFrame([(f"file:{tmp_path}/a.csv", "a", 8)], "path STRING, file_id STRING, length BIGINT")
    most, made = [], K.read_pieces
    monkeypatch.setattr(K, "read_lines", lambda spark, paths: spark.range(9_000, numPartitions=900).selectExpr(
        f"'file:{tmp_path}/a.csv' AS file_id", "id DIV 10 AS block", "'1,2' AS line", "true AS valid"))
    monkeypatch.setattr(K, "read_pieces", lambda lines: most.append(lines.rdd.getNumPartitions()) or made(lines))
    cores = spark.sparkContext.defaultParallelism
    for task_bytes, expected in ((K.TASK_BYTES, K.TASKS_A_CORE * cores), (0.0625, 128)):
        monkeypatch.setattr(K, "TASK_BYTES", task_bytes)
        assert K.parse_folder(spark, str(tmp_path), listed).records.count() == 9_000
        assert most.pop() == expected


def test_the_listing_of_a_folder_is_let_go(spark, tmp_path, monkeypatch):
    """What reads the folder holds a row a file on the driver; nothing names it once the lines are written."""
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    listed = spark.createDataFrame([(f"file:{tmp_path}/a.csv", "a", 8)], "path STRING, file_id STRING, length BIGINT")
    made, alive, read, parse = [], [], K.read_lines, K.parse_pieces

    def reading(*given):
        lines = read(*given)
        made.append(weakref.ref(lines))
        return lines

    def parsing(*given):
        gc.collect()
        alive.append(made[0]() is not None)
        return parse(*given)

    monkeypatch.setattr(K, "read_lines", reading)
    monkeypatch.setattr(K, "parse_pieces", parsing)
    assert K.parse_folder(spark, str(tmp_path), listed).records.count() == 2
    assert alive == [False]
