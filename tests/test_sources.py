import shutil

from lorespark.sources import files, prompts, snapshot


def test_prompt():
    p = prompts.parse_prompt("---\r\nversion: v7\r\n---\n## System\nkeep {{q}}\n\n## User\nask {{q}} {{other}}\n## Schema\n{}\n", {"q": "why"})
    assert p == prompts.Prompt("v7", "keep {{q}}", "ask why {{other}}", "{}")
    assert prompts.parse_prompt("plain") == prompts.Prompt("", "", "", "")


def test_uploads_and_seeding(spark, tmp_path):
    for name in ("a.md", "b.MD", "c.exe", "d.pdf", "sub/d.pdf", "old.md"):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(f"# {name}\ntext")
    known = spark.createDataFrame([("old.md",)], "file_name string")
    got = files.accept(files.listed(spark, str(tmp_path)), known).collect()
    assert sorted((r["file_name"], r["format"], r["status"]) for r in got) == [("a.md", "markdown", "pending"), ("b.MD", "markdown", "pending"), ("d.pdf", "pdf", "pending")]
    seeded = files.seed(spark, str(tmp_path), known).collect()
    assert [(r["file_name"], r["text"]) for r in seeded] == [("a.md", "# a.md\ntext")]
    assert seeded[0]["source_id"] in {r["source_id"] for r in got}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshot.restore(spark, root) == {}
    for n in range(1, 5):
        assert snapshot.backup(spark, {"a": spark.range(n), "b": spark.range(0)}, root, keep=2) == n
    assert snapshot.versions(spark, root) == [3, 4]
    assert {k: v.count() for k, v in snapshot.restore(spark, root).items()} == {"a": 4, "b": 0}
    shutil.rmtree(f"{root}/v=4/a")
    assert not snapshot.intact(spark, root, 4)
    assert snapshot.restore(spark, root)["a"].count() == 3
