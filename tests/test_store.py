import os

import pytest

from docspark.engine import Engine
from docspark.sources import files as sources
from docspark.sources import store as stores
from docspark.sources.store import Store


def messages(spark, *rows):
    return spark.createDataFrame([(i, scope, "user", "c", None, None) for i, scope in rows], stores.SCHEMAS["messages"])


def ids(store):
    return sorted(r.id for r in store.read("messages").collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def test_appends_add_folders(store, spark, tmp_path):
    assert ids(store) == [] and store.next_id("messages") == 1
    store.append(messages=messages(spark, (1, "all"), (2, "7")))
    first = {p: os.stat(p).st_mtime_ns for p in tmp_path.glob("messages/*/*.parquet")}
    store.append(messages=messages(spark, (3, "all")))
    assert ids(store) == [1, 2, 3] and store.next_id("messages") == 4
    assert first and all(os.stat(p).st_mtime_ns == at for p, at in first.items()) and len(list(tmp_path.glob("messages/*"))) == 2
    assert ids(Store(spark, f"file://{tmp_path}")) == [1, 2, 3]  # another reader


def test_deletes_keep_ids_and_vacuum(store, spark, tmp_path):
    docs = spark.createDataFrame([(7, "a", "x", 1, 1, "", "extractive", [], None)], stores.SCHEMAS["documents"])
    chunks = spark.createDataFrame([(7, 0, 1, "t", "a")], stores.SCHEMAS["chunks"])
    store.append(documents=docs, chunks=chunks, messages=messages(spark, (1, "all"), (2, "7")))
    assert len(list(tmp_path.glob("commits/*.json"))) == 1  # three tables, one commit
    assert not store.delete_document(8) and store.delete_document(7)
    assert store.read("documents").count() == store.read("chunks").count() == 0 and ids(store) == [1]
    assert store.next_id("documents") == 8 and store.next_id("messages") == 3
    store.vacuum()
    assert ids(store) == [1] and store.next_id("documents") == 8
    assert [len(list(tmp_path.glob(f"{t}/*"))) for t in ("documents", "chunks", "messages")] == [1, 1, 1]
    assert len(list(tmp_path.glob("commits/*.json"))) == 1


def test_unfinished_commits_do_not_count(store, spark, tmp_path):
    store.append(messages=messages(spark, (1, "all")))
    (tmp_path / "commits/000000000002.json").write_text('{"tables": {')
    messages(spark, (9, "all")).write.parquet(f"file://{tmp_path}/messages/left")
    assert ids(store) == [1]
    store.append(messages=messages(spark, (2, "all")))
    assert ids(store) == [1, 2]
    store.vacuum()
    assert ids(store) == [1, 2] and not (tmp_path / "messages/left").exists()


def test_many_folders_become_one(store, spark, monkeypatch):
    monkeypatch.setattr(stores, "MOST_FOLDERS", 2)
    for i in range(1, 5):
        store.append(messages=messages(spark, (i, "all")))
        assert len(store._record()["tables"]["messages"]) <= 2
    assert ids(store) == [1, 2, 3, 4]


def test_files_without_content_or_name(spark, tmp_path):
    files = [("a.txt", b""), ("b.txt", None), (None, b"x"), ("c.txt", b""), ("c.txt", b"")]
    got = Engine(spark, f"file://{tmp_path}").ingest(spark.createDataFrame(files, "name string, content binary")).collect()
    assert [(r.name, r.duplicate, r.error) for r in got] == [("", False, sources.UNSUPPORTED), *((n, False, sources.EMPTY) for n in ("a.txt", "b.txt", "c.txt", "c.txt"))]
