"""Trees written and read by tasks."""

from siltscope.sources import files, tree

from .conftest import rows

TREE = [("a", "src/x.ts", "one"), ("a", "src/deep/er/y.py", "é\n日本"), ("a", "node_modules/z.ts", "no"), ("a", "src/dist/w.ts", "no"), ("a", "readme.md", "no"), ("a", ".ts", "no"), ("b c", "k+ l%.js", ""), ("b c", "big.go", "x" * 5000)]


def test_a_tree_reads_as_it_was_written(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tree.write_tree(spark.createDataFrame(TREE, "repo_id string, path string, content string"), root) == len(TREE)
    want = sorted((t for t in TREE if t[2] != "no"), key=repr)
    assert rows(tree.read_tree(spark, root)) == want
    assert rows(tree.read_tree(spark, "file://" + root)) == want
    assert rows(tree.read_tree(spark, root, max_bytes=100)) == [t for t in want if len(t[2]) < 100]
    assert rows(tree.read_tree(spark, root, exts=(".md",))) == [("a", "readme.md", "no")]
    # the reader of Spark itself sees the same files, but has no row for an empty one
    assert rows(files.read_files(spark, root).filter("path <> '.ts'"), "repo_id", "path", "content") == [t for t in want if t[2]]


def test_parts_have_equal_bytes(spark, tmp_path):
    root = str(tmp_path / "t")
    data = [("hot" if i % 3 else "cold", f"d{i % 7}/f{i:03d}.py", "x" * (50 + i)) for i in range(300)]
    tree.write_tree(spark.createDataFrame(data, "repo_id string, path string, content string"), root)
    df = tree.read_tree(spark, root, part_bytes=5000)
    sizes = [sum(len(r.content) for r in part) for part in df.rdd.glom().collect()]
    assert sum(sizes) == sum(len(t[2]) for t in data) and max(sizes) <= 2 * 5000 and len([s for s in sizes if s]) >= 8


def test_bytes_that_are_no_text_and_an_empty_root(spark, tmp_path):
    (tmp_path / "t" / "r").mkdir(parents=True)
    (tmp_path / "t" / "r" / "x.py").write_bytes(b"a\xff\xfeb")
    assert rows(tree.read_tree(spark, str(tmp_path / "t"))) == [("r", "x.py", "a��b")]
    (tmp_path / "none").mkdir()
    assert rows(tree.read_tree(spark, str(tmp_path / "none"))) == []
