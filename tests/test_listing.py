"""Stored files listed by tasks: what is found, how it is dealt, and lists for a stream."""

from __future__ import annotations

import os
import time

import pytest

from docledger.sources import files as stored
from docledger.sources.files import follow_files, list_new_files, stored_file_stream, stored_files

FOUND = ["a/1", "b/_q=1/2", "b/c/d/e/3", "_x=1", "_metadata_d/4", "sp ace/a b%20c+#?.pdf", "ü/ñ.gz",
         "link"]
LEFT_OUT = ["a/empty", "_metadata", "_y", "_h/5", ".h/6", "a/.7", "a/8._COPYING_", "d/_common_metadata"]


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "files x%20y"
    for name in [*FOUND[:-1], *LEFT_OUT]:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if name == "a/empty" else f"bytes of {name}")
    (folder / "nothing").mkdir()
    (folder / "link").symlink_to(folder / "a" / "1")
    (folder / "broken").symlink_to(folder / "nowhere")
    return folder


def rows(files):
    return sorted((r["storage_key"], r["length"], bytes(r["content"])) for r in files.collect())


def want(names):
    texts = {n: f"bytes of {'a/1' if n == 'link' else n}".encode() for n in names}
    return sorted((n, len(t), t) for n, t in texts.items())


def batches(spark, folder, checkpoint, lists, size):
    got = []
    stored_file_stream(spark, str(folder), size, lists).writeStream.foreachBatch(
        lambda batch, _: got.append(rows(batch))).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return got


def aged(folder, names):
    """Files of these names, the first one the oldest."""
    for i, name in enumerate(names):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"bytes of {name}")
        os.utime(path, (time.time() - 1000 + i,) * 2)


def test_the_files_that_spark_would_find(spark, root, tmp_path, monkeypatch):
    assert rows(stored_files(spark, str(root))) == want(FOUND)
    assert rows(stored_files(spark, f"file:{root}/")) == want(FOUND)
    got = batches(spark, root, f"{tmp_path}/checkpoint", f"{tmp_path}/lists", 3)
    assert sorted(x for batch in got for x in batch) == want(FOUND) and [len(x) for x in got] == [3, 3, 2]
    # A store that tasks do not open goes through Spark's own reader.
    monkeypatch.setattr(stored, "TASK_STORES", ())
    assert rows(stored_files(spark, str(root))) == want(FOUND)


def test_the_driver_holds_neither_files_nor_a_task_a_file(spark, tmp_path):
    aged(tmp_path / "files", [f"d{i}/f" for i in range(150)])
    files = stored_files(spark, f"{tmp_path}/files")
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(files.inputFiles()) < 20
    got = batches(spark, tmp_path / "files", f"{tmp_path}/checkpoint", f"{tmp_path}/lists", 50)
    assert [len(x) for x in got] == [50, 50, 50]
    kept = "".join(p.read_text() for p in (tmp_path / "checkpoint" / "sources" / "0").iterdir()
                   if not p.name.endswith(".crc"))
    assert kept.count('"path"') == 3


def test_lists_take_older_files_first_and_each_once(spark, tmp_path):
    root, lists, checkpoint = tmp_path / "files", f"{tmp_path}/lists", f"{tmp_path}/checkpoint"
    names = [f"{'zyx'[i % 3]}/{9 - i}" for i in range(7)]
    aged(root, names)
    assert list_new_files(spark, str(root), 3, lists) == 7
    assert list_new_files(spark, str(root), 3, lists) == 0
    assert batches(spark, root, checkpoint, lists, 3) == [
        want(names[:3]), want(names[3:6]), want(names[6:])]
    assert batches(spark, root, checkpoint, lists, 3) == []
    aged(root, [names[0], "new/1", "new/2"])
    assert batches(spark, root, checkpoint, lists, 3) == [want(["new/1", "new/2"])]


def test_many_new_files_are_numbered_in_ranges(spark, tmp_path, monkeypatch):
    whole = stored.number_in_group
    monkeypatch.setattr(stored, "number_in_group", lambda *a: whole(*a, min_rows=5))
    names = [f"{i % 4}/{i}" for i in range(20)]
    aged(tmp_path / "files", names)
    got = batches(spark, tmp_path / "files", f"{tmp_path}/checkpoint", f"{tmp_path}/lists", 6)
    assert got == [want(names[i: i + 6]) for i in range(0, 20, 6)]


def test_names_whose_list_did_not_appear_are_listed_again(spark, tmp_path):
    root, lists = tmp_path / "files", tmp_path / "lists"
    names = [str(i) for i in range(6)]
    aged(root, names)
    list_new_files(spark, str(root), 3, str(lists))
    # As if the driver had died before it moved the last list to its place.
    left = lists / "_left" / "list=1"
    left.mkdir(parents=True)
    max(lists.glob("*.parquet")).rename(left / "part-0.parquet")
    got = batches(spark, root, f"{tmp_path}/checkpoint", str(lists), 2)
    assert got == [want(names[:3]), want(names[3:5]), want(names[5:])]


def test_a_stream_that_keeps_running_gets_files_that_come_later(spark, tmp_path):
    root, lists = tmp_path / "files", f"{tmp_path}/lists"
    aged(root, ["a/1", "a/2"])
    got = []
    query = stored_file_stream(spark, str(root), 10, lists).writeStream.foreachBatch(
        lambda batch, _: got.extend(rows(batch))).option(
        "checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    thread = follow_files(query, spark, str(root), 10, lists, 1)
    try:
        aged(root, ["b/3"])
        until = time.time() + 60
        while len(got) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    thread.join(60)
    assert sorted(got) == want(["a/1", "a/2", "b/3"]) and not thread.is_alive()


def test_a_root_that_is_not_there_fails(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        stored_files(spark, f"{tmp_path}/none")
