"""Publication by a log: whatever fails, readers see the old run or the new one."""

import pytest

from cohortlens.sources import commits
from cohortlens.sources.artifacts import Folder


def run(spark, log, text):
    folder, parent = log.begin()
    spark.range(3).selectExpr("id", f"'{text}' as said").write.parquet(f"{folder}/table")
    Folder(spark, folder).write_text("note.md", text)
    return folder, parent


def said(spark, log):
    path = commits.published(spark, log.out)
    assert {r["said"] for r in spark.read.parquet(f"{path}/table").collect()} == {Folder(spark, path).read_text("note.md")}
    return Folder(spark, path).read_text("note.md")


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_readers_follow_the_last_commit(spark, tmp_path, prefix):
    log = commits.Log(spark, f"{prefix}{tmp_path}/out")
    with pytest.raises(FileNotFoundError):
        log.path()
    assert log.commit(*run(spark, log, "one")) == 1 and said(spark, log) == "one"
    assert log.commit(*run(spark, log, "two")) == 2 and said(spark, log) == "two"
    assert log.differences().count() == 0
    (tmp_path / "out" / log.current()[1]["run"] / "note.md").write_text("changed")
    assert [(r["path"], r["problem"]) for r in log.differences().collect()] == [("note.md", "size")]


def test_a_failure_at_any_step_leaves_the_old_run(spark, tmp_path, monkeypatch):
    log = commits.Log(spark, str(tmp_path / "out"))
    log.commit(*run(spark, log, "old"))
    # Before anything is written, while it is, and after it is but before the commit.
    log.begin()
    assert said(spark, log) == "old"
    folder, parent = run(spark, log, "new")
    assert said(spark, log) == "old"
    with monkeypatch.context() as m:
        m.setattr(commits, "scan_manifest", lambda *a: (_ for _ in ()).throw(OSError("store is away")))
        with pytest.raises(OSError):
            log.commit(folder, parent)
    assert said(spark, log) == "old"
    # In the middle of the commit itself: part of a record, as a store without atomic creates may keep it.
    (tmp_path / "out" / "_commits" / "00000002.json").write_text('{"run": "runs/')
    assert said(spark, log) == "old" and log.current()[0] == 2
    with pytest.raises(commits.CommitConflict):
        log.commit(folder, parent)
    assert log.commit(folder, log.current()[0]) == 3 and said(spark, log) == "new"
    with pytest.raises(FileNotFoundError):
        log.commit(f"{log.out}/runs/none", 3)


def test_of_two_writers_one_has_to_look_again(spark, tmp_path):
    log = commits.Log(spark, str(tmp_path / "out"))
    a, b = run(spark, log, "a"), run(spark, log, "b")
    assert log.commit(*b) == 1
    with pytest.raises(commits.CommitConflict):
        log.commit(*a)
    assert said(spark, log) == "b" and log.commit(a[0], log.current()[0]) == 2 and said(spark, log) == "a"
    lost, _ = run(spark, log, "lost")
    assert log.vacuum(keep=1) == sorted([b[0].removeprefix(f"{log.out}/"), lost.removeprefix(f"{log.out}/")]) and said(spark, log) == "a"
    assert commits.published(spark, str(tmp_path)) == str(tmp_path)
