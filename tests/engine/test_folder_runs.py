"""Folder runs that are cut at every write, folders that change between runs."""

import os

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from lakeveil.operators import detect as d, folder, workspace as w
from lakeveil.sources import files

SETTINGS = d.Settings(entities=["EMAIL_ADDRESS"])


class Cut(Exception):
    pass


def put(path, text, at):
    path.write_text(text)
    os.utime(path, (at, at))


def rows(spark, base, run):
    return sorted(tuple(r) for r in folder.redacted_documents(spark, f"{base}/out", run.state).collect())


def go(spark, src, base):
    return folder.run_folder(spark, str(src), f"{base}/out", f"{base}/state", SETTINGS)


def clear_texts_left(base):
    return [p for p in (base / "state").rglob("*") if p.name.startswith("work-")] if (base / "state").exists() else []


def test_a_run_cut_at_any_write_leaves_one_row_a_document(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    put(src / "a.txt", "an eva@firma.de", 1000)
    put(src / "b.txt", "an ute@haus.org", 2000)
    whole = DataFrameWriter.parquet
    count = {"n": 0, "cut": -1, "after": False}

    def counted(self, path, *args, **kw):
        count["n"] += 1
        if count["n"] == count["cut"] and not count["after"]:
            raise Cut
        whole(self, path, *args, **kw)
        if count["n"] == count["cut"]:
            raise Cut

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    go(spark, src, tmp_path)
    writes = count["n"]
    assert writes >= 6
    put(src / "a.txt", "jetzt an max@neu.net!", 3000)
    for cut, after in [(writes - 1, True), (writes, False)]:  # rows written and not named; no snapshot
        count.update(n=0, cut=cut, after=after)
        with pytest.raises(Cut):
            go(spark, src, tmp_path)
        assert not clear_texts_left(tmp_path)
        assert rows(spark, tmp_path, folder.Run(0, w.load(spark, f"{tmp_path}/state"), None)) == [("a.txt", "a_redacted.txt", "an [EMAIL]"), ("b.txt", "b_redacted.txt", "an [EMAIL]")]
    count.update(n=0, cut=-1)
    run = go(spark, src, tmp_path)
    assert rows(spark, tmp_path, run) == [("a.txt", "a_redacted.txt", "jetzt an [EMAIL]!"), ("b.txt", "b_redacted.txt", "an [EMAIL]")] and run.code == 0
    assert {r.rel: r.status for r in run.state.collect()} == {"a.txt": "auto", "b.txt": "auto"}


def test_leftovers_are_swept_and_unchanged_contents_not_opened(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    put(src / "old.txt", "an eva@firma.de", 1000)
    go(spark, src, tmp_path)
    (tmp_path / "state" / "work-000000007").mkdir()  # of a run that was killed
    (tmp_path / "state" / "work-000000007" / "part").write_text("eva@firma.de")
    (tmp_path / "out" / "run=000000009").mkdir()
    (tmp_path / "state" / "snapshot-000000004").mkdir()  # cut off while it was saved
    put(src / "new.txt", "an ute@haus.org", 2000)
    asked = []
    load = files.load_documents
    monkeypatch.setattr(folder, "load_documents", lambda spark, source, since=None: asked.append(since) or load(spark, source, since=since))
    run = go(spark, src, tmp_path)
    assert not clear_texts_left(tmp_path) and not (tmp_path / "out" / "run=000000009").exists()
    assert w.numbered(spark, f"{tmp_path}/state", "snapshot-") == [0, 4, 5] and len(rows(spark, tmp_path, run)) == 2
    assert len(asked) == 1 and asked[0].timestamp() >= 1999
    plan = load(spark, str(src), since=asked[0])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(modificationTime" in plan
    put(src / "new.txt", "an ute@haus.org", 5000)  # touched only
    (src / "old.txt").unlink()
    run = go(spark, src, tmp_path)
    assert run.written.count() == 0 and [r[0] for r in rows(spark, tmp_path, run)] == ["new.txt"]
    assert {r.rel: r.status for r in run.state.collect()} == {"old.txt": "missing", "new.txt": "auto"}


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    run = go(spark, tmp_path / "src", tmp_path)
    assert run.written.count() == 0 and run.state.count() == 0
