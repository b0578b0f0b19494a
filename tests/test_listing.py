"""Listing of trees: bounded frames, huge folders, names that are skipped, other storages."""

import os
import tempfile

import pandas as pd

from shelfspark.functions.frames import MAX_ROWS
from shelfspark.sources import files
from shelfspark.sources.files import scan_files


def fill(folder, names):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(f"{folder}/{name}", "wb") as file:
            file.write(b"x" * (len(name) % 3))


def test_a_huge_folder_is_read_in_frames_and_measured_by_all_tasks(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    names = [f"book {i}.epub" for i in range(20_000)]
    fill(f"{root}/all", names)
    frames = files._lister(root, False)(iter([pd.DataFrame({"path": ["all"]})]))
    sizes = [len(frame) for frame in frames]
    assert sum(sizes) == len(names) and max(sizes) <= MAX_ROWS
    listed = scan_files(spark, root)
    rows = listed.collect()
    assert {(r.path, r.size) for r in rows} == {(f"all/{n}", len(n) % 3) for n in names}
    # The names of one folder are spread over the tasks that ask for sizes.
    parts = listed.rdd.mapPartitions(lambda rs: [sum(1 for _ in rs)]).collect()
    assert len(parts) == 4 and max(parts) < len(names) / 2


def test_skipped_names(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    fill(f"{root}/a/_b/c", ["x.EPUB", ".y.epub", "epub", "z.md", "Ж é.fb2.zip"])
    fill(f"{root}/.hidden", ["a.epub"])
    os.symlink(f"{root}/a", f"{root}/link")
    os.symlink(f"{root}/a/_b/c/x.EPUB", f"{root}/l.epub")
    os.makedirs(f"{root}/folder.epub")
    assert {(r.path, r.extension) for r in scan_files(spark, f"file:{root}").collect()} == {("a/_b/c/x.EPUB", "epub"), ("a/_b/c/Ж é.fb2.zip", "zip")}
    assert scan_files(spark, f"{root}/none").count() == 0


def test_other_storage_gives_the_same_rows(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    fill(f"{root}/a/b", ["x.epub", "yy.pdf", ".h.epub", "n.md"])
    fill(f"{root}/c", ["zzz.txt"])
    rows = files._lister(f"file://{root}", True)(iter([pd.DataFrame({"path": ["", "a/b", "none"]})]))
    got = pd.concat(list(rows))
    assert set(got[got.is_dir].path) == {"a", "c"}
    want = {(r.path, r.size, r.mtime_ms) for r in scan_files(spark, f"{root}").filter("path like 'a/%'").collect()}
    assert {(r.path, r.size, r.mtime_ms) for r in got[~got.is_dir].itertuples()} == want
