"""Folders that are pruned, links and cycles, files that cannot be read."""

import os

import pytest

from copse.sources import files, walking


@pytest.fixture
def tree(tmp_path):
    for path in ("a.go", "src/b.go", "src/deep/c.go", "src/deep/er/d.go", "vendor/x/e.go", "vendor/f.go", ".hidden/g.go", "src/node_modules/h.js"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    return tmp_path


def found(spark, tree, **scope):
    return sorted(r.path for r in files.listing(spark, files.Scope(str(tree), **scope)).collect())


def opened(spark, tree, *args, **kwargs):
    """Folders that were opened: those that entries come from."""
    return sorted({r.folder for r in walking.entries(spark, str(tree), *args, **kwargs).collect()})


def test_excluded_folders_are_not_opened(spark, tree):
    assert found(spark, tree) == sorted(["a.go", "src/b.go", "src/deep/c.go", "src/deep/er/d.go", "vendor/x/e.go", "vendor/f.go", ".hidden/g.go", "src/node_modules/h.js"])
    assert opened(spark, tree, ("vendor/**", "node_modules")) == ["", ".hidden", "src", "src/deep", "src/deep/er"]
    assert found(spark, tree, exclude=("vendor/**", "node_modules"), include=("**/*.go",)) == [".hidden/g.go", "a.go", "src/b.go", "src/deep/c.go", "src/deep/er/d.go"]
    # what cannot be opened is not missed where it is excluded
    os.chmod(tree / "vendor", 0)
    try:
        assert "vendor" not in opened(spark, tree, ("vendor/**",))
    finally:
        os.chmod(tree / "vendor", 0o755)


def test_depths(spark, tree):
    assert found(spark, tree, max_depth=1) == sorted(p for p in found(spark, tree) if p.count("/") <= 1)
    assert opened(spark, tree, (), 1) == ["", ".hidden", "src", "vendor"]
    assert found(spark, tree, max_files=2) == [".hidden/g.go", "a.go"]


def test_links_and_cycles(spark, tree):
    (tree / "src" / "up").symlink_to(tree)
    (tree / "again").symlink_to(tree / "vendor")
    (tree / "src" / "gone.go").symlink_to(tree / "nothing")
    (tree / "one.go").symlink_to(tree / "a.go")
    plain = found(spark, tree)
    assert not any(x.startswith(("again", "src/up", "one", "src/gone")) for x in plain) and len(plain) == 8
    followed = found(spark, tree, follow_symlinks=True)
    # vendor is reached on the first level by two names, and opened by the first; the root is not opened again
    assert sorted(followed) == sorted([*(x for x in plain if not x.startswith("vendor")), "again/f.go", "again/x/e.go", "one.go"])


def test_against_a_walk(spark, tree):
    want = sorted(os.path.relpath(os.path.join(d, n), tree) for d, _, names in os.walk(tree) for n in names)
    assert found(spark, tree) == want
    row = files.listing(spark, files.Scope(str(tree))).filter("path = 'a.go'").first()
    info = os.stat(tree / "a.go")
    assert (row.doc, row.size, row.mod_time, row.stamp, row.language) == (str(tree / "a.go"), 4, int(info.st_mtime), info.st_mtime_ns, "go")


def test_files_that_cannot_be_read(spark, tree, monkeypatch):
    """One that is gone when it is read says so; the others are read."""
    listing = files.listing(spark, files.Scope(str(tree), include=("**/*.go",)))
    made = walking.read(listing.union(listing.limit(1).selectExpr("doc || 'x' AS doc", "'no/such.go' AS path", "size", "mod_time", "stamp", "language")), str(tree), ["doc", "path"])
    rows = {r.path: r for r in made.collect()}
    assert rows["no/such.go"].content is None and "No such file" in rows["no/such.go"].error
    assert bytes(rows["src/b.go"].content) == b"src/b.go" and rows["src/b.go"].error is None and len(rows) == 8
    (tree / "bad.go").write_bytes(b"package \xff\n")
    row = files.walk(spark, files.Scope(str(tree), include=("bad.go",))).first()
    assert row.source == "package �\n" and row.error is None


def test_empty_and_missing(spark, tmp_path):
    assert found(spark, tmp_path) == []
    with pytest.raises(files.ScopeError):
        found(spark, tmp_path / "none")
