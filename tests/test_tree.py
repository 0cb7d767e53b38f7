import os
import time

import pytest
from stratalog.operators import workspace
from stratalog.sources import tree


@pytest.fixture
def root(tmp_path):
    for name, body in {"a.md": b"abc", "x/b.py": b"0123456789", "x/y/c.txt": b"", "vendor/lib/d.js": b"no", ".git/e": b"no", "x/.hg/f": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    for i in range(300):
        (tmp_path / "many" / f"d{i % 90}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "many" / f"d{i % 90}" / f"{i}.txt").write_bytes(b"t%d" % i)
    (tmp_path / "link").symlink_to(tmp_path / "a.md")
    return tmp_path


def test_every_file_and_range(spark, root):
    spark.dataSource.register(tree.TreeSource)
    rows = spark.read.format("stratalog_tree").option("exclude", "^vendor/").option("splitBytes", "4").load(str(root)).collect()
    files = {}
    for r in sorted(rows, key=lambda r: (r.path, r.start)):
        assert r.state == "read" and r.length <= 4
        files[r.path] = files.get(r.path, b"") + bytes(r.content)
    want = {p.relative_to(root).as_posix(): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.is_symlink()}
    assert files == {k: v for k, v in want.items() if not k.startswith(("vendor/", ".git/", "x/.hg/"))} and len(files) == 303
    assert spark.read.format("stratalog_tree").load(str(root)).rdd.getNumPartitions() > 2


def test_a_pruned_folder_is_never_listed(root, monkeypatch):
    listed = []
    real = tree.TreeReader._list
    monkeypatch.setattr(tree.TreeReader, "_list", lambda self, store, base, folder: listed.append(folder) or real(self, store, base, folder))
    reader = tree.TreeReader({"path": str(root), "exclude": "^vendor/,/y/$"})
    names = {row[0] for p in reader.partitions() for row in reader.read(p)}
    assert not any(f.startswith(("vendor", ".git", "x/.hg", "x/y")) for f in listed) and "x/b.py" in names and "x/y/c.txt" not in names


def test_a_file_that_changes_while_it_is_read(root, monkeypatch):
    reader = tree.TreeReader({"path": str(root), "ranges": "a.md:0:2\nx/b.py:3:7\nnone:0:1\n../out:0:1\nlink:0:1\nx/b.py:8:99"})
    real = tree.TreeReader._look
    looks = []

    def look(self, store, path):
        looks.append(path)
        if path.endswith("a.md") and sum(p.endswith("a.md") for p in looks) == 2:
            (root / "a.md").write_bytes(b"abcd")
            os.utime(root / "a.md", (time.time() + 5, time.time() + 5))
        return real(self, store, path)

    monkeypatch.setattr(tree.TreeReader, "_look", look)
    got = [(r[0], r[5], r[6]) for p in reader.partitions() for r in reader.read(p)]
    assert got == [("a.md", "read_failed", None), ("x/b.py", "read", b"3456"), ("none", "read_failed", None), ("../out", "read_failed", None), ("link", "read_failed", None), ("x/b.py", "read", b"89")]


def test_configured_excludes_and_verified_ranges(spark, root):
    config = workspace.Config.parse('[policy]\nexclude = ["^vendor/", "^many/"]\n')
    files = workspace.read_tree(spark, str(root), config)
    assert {r.path for r in files.collect()} == {"a.md", "x/b.py", "x/y/c.txt"}
    import hashlib

    indexed = [("a.md", hashlib.sha256(b"abc").hexdigest(), 1, 3), ("x/b.py", hashlib.sha256(b"old").hexdigest(), 0, 4), ("gone.md", "00", 0, 1)]
    found = workspace.exact_ranges(spark, str(root), spark.createDataFrame(indexed, "path string, content_hash string, start_byte long, end_byte long")).collect()
    assert {(r.path, r.status, r.source and bytes(r.source)) for r in found} == {("a.md", "verified", b"bc"), ("x/b.py", "hash_mismatch", None), ("gone.md", "read_failed", None)}
