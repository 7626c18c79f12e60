"""Local repositories as sources: clones, revisions and changes between them."""

import subprocess

import pytest

from codeloom.operators import lines
from codeloom.plans import diff
from codeloom.sources import files as src


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder = tmp_path_factory.mktemp("git")
    git = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (folder / "pkg").mkdir()
    (folder / "pkg/a.py").write_text("".join(f"x{i} = {i}\n" for i in range(30)))
    (folder / "old.py").write_text("def keep():\n    return 1\n" * 5)
    (folder / "blob.bin").write_bytes(bytes(range(256)))
    git("add", ".")
    git("commit", "-q", "-m", "one")
    (folder / "pkg/a.py").write_text("".join(f"x{i} = {i + (i == 7)}\n" for i in range(30)))
    git("mv", "old.py", "pkg/new.py")
    (folder / "blob.bin").write_bytes(bytes(range(255, -1, -1)))
    (folder / "added.md").write_text("# new\n")
    git("add", ".")
    git("commit", "-q", "-m", "two")
    return str(folder)


def test_changes_between_revisions(spark, repository):
    changes, diffs = src.git_changes(spark, repository, "HEAD~1")
    got = {r["path"]: r for r in diff.numstat(changes.select("path", "old_path", "code"), changes.select("path", "additions", "deletions")).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"pkg/a.py": "MODIFIED", "pkg/new.py": "RENAMED", "blob.bin": "MODIFIED", "added.md": "ADDED"}
    assert got["pkg/new.py"]["old_path"] == "old.py" and got["blob.bin"]["binary"] and (got["pkg/a.py"]["additions"], got["pkg/a.py"]["deletions"]) == (1, 1)
    changed = lines.changed_lines(lines.hunks(diffs, ["path"])).where("path = 'pkg/a.py'").collect()
    assert sorted((r["side"], r["line_number"], r["text"]) for r in changed) == [("NEW", 8, "x7 = 8"), ("OLD", 8, "x7 = 7")]


def test_revisions(repository):
    assert src.resolved_revision(repository, None) == src.resolved_revision(repository, "main")
    for bad in ("-x", "a..b", "no-such", "x" * 200, "a b"):
        with pytest.raises(ValueError):
            src.resolved_revision(repository, bad)


def test_clone(spark, repository, tmp_path):
    branch, commit = src.local_clone(repository, str(tmp_path / "c"))
    assert branch == "main" and commit == src.resolved_revision(repository, "main")
    assert {r["path"] for r in src.read_files(spark, str(tmp_path / "c")).collect()} == {"pkg/a.py", "pkg/new.py", "blob.bin", "added.md"}


def test_large_files_are_listed_without_content(spark, tmp_path):
    (tmp_path / "big.py").write_text("x = 1\n" * 100)
    (tmp_path / "small.py").write_text("x = 1\n")
    got = {r["path"]: (r["content"], r["line_count"]) for r in src.read_files(spark, str(tmp_path), max_file_bytes=100).collect()}
    assert got == {"big.py": (None, 0), "small.py": ("x = 1\n", 1)}
