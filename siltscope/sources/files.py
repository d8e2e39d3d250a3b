"""Source files: directory scans, uploads, samples, diffs, manifests, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.functions import text as tx
from siltscope.operators.ordered import first_n

# fixed values
SOURCE_EXT = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".php")
UPLOAD_EXT = (*SOURCE_EXT, ".css", ".html", ".json", ".md", ".yaml", ".yml")
SKIP_DIRS = ("node_modules", ".git", "dist", ".next", "coverage", ".cache", ".turbo", "build")


def read_files(
    spark: SparkSession,
    root: str,
    exts: Sequence[str] = SOURCE_EXT,
    skip_dirs: Sequence[str] = SKIP_DIRS,
    max_bytes: int | None = None,
) -> DataFrame:
    """files(repo_id, path, content) below ``root/<repo_id>/...``.

    The path filter runs on file metadata; ``max_bytes`` drops larger files before their text is used.
    """
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    full = F.col("_metadata.file_path")
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.element_at(F.split(full, base + "/", 2), 2), "^/+", "")
    df = raw.select(F.url_decode(F.regexp_replace(rel, r"\+", "%2B")).alias("rel"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("content"))
    df = df.select(F.element_at(F.split("rel", "/"), 1).alias("repo_id"), F.regexp_replace("rel", "^[^/]*/", "").alias("path"), "content", "bytes")
    df = df.filter(tx.extension("path").isin(*exts))
    df = df.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in skip_dirs])))
    if max_bytes is not None:
        df = df.filter(F.col("bytes") <= max_bytes)
    return df.drop("bytes")


def select_sources(files: DataFrame, exts: Sequence[str] = UPLOAD_EXT) -> DataFrame:
    """Files whose extension is listed."""
    return files.filter(F.regexp_extract("path", r"(\.[^.]*)$", 1).isin(*exts))


def stratified_sample(files: DataFrame, max_total: int = 50, max_per_dir: int = 5, cut: int | None = None) -> DataFrame:
    """Round-robin over top-level directories: at most ``max_per_dir`` each and ``max_total`` per repository.

    Directories come in the order of their smallest path, files by path.  Both limits are rank filters
    that run before the shuffle; only paths are ranked, contents are joined to the chosen ones.  ``cut`` shortens contents.
    """
    top = F.when(F.col("path").contains("/"), F.element_at(F.split("path", "/"), 1)).otherwise("__root__")
    slim = files.select("repo_id", "path", top.alias("dir"))
    per_dir = first_n(slim, ["repo_id", "dir"], [F.asc("path")], max_per_dir)
    from pyspark.sql import Window as W

    ranked = per_dir.withColumn("round", F.row_number().over(W.partitionBy("repo_id", "dir").orderBy("path")))
    firsts = ranked.filter("round = 1").select("repo_id", "dir", F.col("path").alias("dir_first"))
    picked = first_n(ranked.join(firsts, ["repo_id", "dir"]), ["repo_id"], [F.asc("round"), F.asc("dir_first")], max_total)
    keep = picked.select("repo_id", "path")
    out = files.join(keep, ["repo_id", "path"], "left_semi")
    return out if cut is None else out.withColumn("content", F.substring("content", 1, cut))


def diff_files(diffs: DataFrame) -> DataFrame:
    """diffs(repo_id, diff) -> (repo_id, path) named by +++ b/ or --- a/ lines."""
    ln = diffs.select("repo_id", F.explode(tx.split_lines("diff")).alias("l"))
    return ln.select("repo_id", F.regexp_extract("l", r"^(?:\+\+\+ b/|--- a/)(.+?)\s*$", 1).alias("path")).filter(F.col("path") != "").distinct()


# --- manifests -------------------------------------------------------------------------------------------

def extract_deps(files: DataFrame) -> DataFrame:
    """Declared dependencies of seven manifest formats: deps(repo_id, manifest_path, kind, name, version).

    Scoped packages are also listed by their bare name (kind ``alias``), workspaces by their pattern.
    """
    name = tx.base_name("path")
    m = files.select("repo_id", F.col("path").alias("manifest_path"), name.alias("m"), "content").filter(
        F.col("m").isin("package.json", "requirements.txt", "requirements-dev.txt", "pyproject.toml", "go.mod", "Cargo.toml", "Gemfile")
    )
    none = F.create_map().cast("map<string,string>")
    kinds = {"dependencies": "prod", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}

    def typed(field: str, kind: str) -> Column:
        m = F.coalesce(F.from_json(F.get_json_object("content", f"$.{field}"), "map<string,string>"), none)
        return F.transform(F.map_entries(m), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("version")))

    maps = [typed(f, k) for f, k in kinds.items()]
    empty = F.array().cast("array<struct<kind:string,name:string,version:string>>")
    listed = F.concat(*maps)
    alias = F.transform(
        F.filter(listed, lambda e: e["name"].startswith("@") & e["name"].contains("/")),
        lambda e: F.struct(F.lit("alias").alias("kind"), F.get(F.split(e["name"], "/"), F.lit(1)).alias("name"), e["version"].alias("version")),
    )
    spaces = F.transform(
        F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"), F.array().cast("array<string>")),
        lambda w: F.struct(F.lit("workspace").alias("kind"), w.alias("name"), F.lit("").alias("version")),
    )

    def names(p: str, lower: bool = False) -> Column:
        return F.transform(
            F.regexp_extract_all("content", F.lit(p), F.lit(1)),
            lambda n: F.struct(F.lit("prod").alias("kind"), (F.lower(n) if lower else n).alias("name"), F.lit("").alias("version")),
        )

    k = F.col("m")
    found = (
        F.when(k == "package.json", F.concat(listed, alias, spaces))
        .when(k.startswith("requirements"), names(r"(?m)^([A-Za-z0-9_.-]+)", True))
        .when(k == "pyproject.toml", names(r"(?m)^[ \t]*([A-Za-z0-9_.-]+)\s*=\s*[{]", True))
        .when(k == "go.mod", names(r"(?m)^[ \t]*([A-Za-z0-9_.\-/]+)\s+v[\d.]+"))
        .when(k == "Cargo.toml", names(r"""(?m)^([A-Za-z0-9_-]+)\s*=\s*["']?\d"""))
        .when(k == "Gemfile", names(r"""(?m)^[ \t]*gem\s+["']([^"']+)["']"""))
        .otherwise(empty)
    )
    return m.select("repo_id", "manifest_path", F.explode(found).alias("d")).select("repo_id", "manifest_path", "d.*").filter(F.col("name") != "")


# --- chunks ------------------------------------------------------------------------------------------------

#: ASCII white space, as everywhere in the library
_BLANK = " \t\n\x0b\f\r"


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def top_level_gaps(content: Column) -> Column:
    """Per line of a text: is it a blank line, not the first, whose next line with text is not indented?

    Cut before each line that is not indented, a text falls into blocks; the blank lines that end a block are the gaps.
    """
    blocks = F.split(content, r"(?<=\n)(?=[^ \t\n\x0B\f\r])", -1)

    def flags(block: Column, i: Column) -> Column:
        lines = _newlines(block)  # a block but the last ends in a line end
        tail = F.replace(F.substring(block, F.length(F.rtrim(block, F.lit(_BLANK))) + 1, F.length(block)), F.lit(" "), F.lit(""))
        bare = F.rtrim(block, F.lit(_BLANK)) == ""
        gaps = F.when(bare, lines - F.when(i == 0, 1).otherwise(0)).otherwise(_newlines(tail) - 1)
        return F.concat(F.array_repeat(F.lit(False), lines - gaps), F.array_repeat(F.lit(True), gaps))

    last = F.array_repeat(F.lit(False), _newlines(F.element_at(blocks, -1)) + 1)
    return F.concat(F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), flags)), last)


def chunk_cuts(content: Column, limit: int) -> Column:
    """First lines, from 0, of the chunks after the first one.

    A chunk that would pass ``limit`` characters ends before its last gap, else before the line that does not fit; a
    single longer line is a chunk of its own. One fold over the lines carries the chunk's start and its last gap.
    """
    lines = F.zip_with(F.transform(tx.split_lines(content), lambda x: F.length(x)), top_level_gaps(content), lambda n, gap: F.struct(n.alias("n"), gap.alias("gap")))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("first_at"),
                     F.lit(-1).alias("gap"), F.lit(0).cast("long").alias("gap_at"), none.alias("cuts"))

    def over(s: Column, n: Column, first_at: Column) -> Column:
        return s["at"] + n - first_at > limit

    def step(s: Column, x: Column) -> Column:
        no, at, n = s["no"], s["at"], x["n"]
        full = (no > s["first"]) & over(s, n, s["first_at"])
        at_gap = full & (s["gap"] > s["first"])
        # what follows the gap may itself leave no room for this line
        twice = at_gap & (no > s["gap"]) & over(s, n, s["gap_at"])
        here = (full & ~at_gap) | twice
        first = F.when(here, no).when(at_gap, s["gap"]).otherwise(s["first"])
        cuts = F.when(twice, F.concat(s["cuts"], F.array(s["gap"], no))).when(full, F.concat(s["cuts"], F.array(first))).otherwise(s["cuts"])
        mark = x["gap"] & (no > first)
        return F.struct(
            (no + 1).alias("no"), (at + n + 1).alias("at"), first.alias("first"),
            F.when(here, at).when(at_gap, s["gap_at"]).otherwise(s["first_at"]).alias("first_at"),
            F.when(mark, no).when(full, -1).otherwise(s["gap"]).alias("gap"), F.when(mark, at).otherwise(s["gap_at"]).alias("gap_at"), cuts.alias("cuts"),
        )

    return F.when(F.length(content) <= limit, none).otherwise(F.aggregate(lines, start, step, lambda s: s["cuts"]))


def chunk_files(files: DataFrame, max_tokens: int = 6000) -> DataFrame:
    """One row per chunk of a file: repo_id, path, chunk, start_line, end_line, text (lines with their numbers).

    A file is one row, and its cuts and chunks are columns of that row: nothing is grouped and no Python runs. An empty file
    is one chunk of one empty line; a file without content (null) has none.
    """
    cut = files.filter(F.col("content").isNotNull()).select("repo_id", "path", "content", chunk_cuts(F.col("content"), max_tokens * 4).alias("cuts"))
    firsts = F.concat(F.array(F.lit(0)), F.col("cuts"))
    ends = F.concat(F.col("cuts"), F.array(F.size("lines")))
    spans = F.zip_with(firsts, ends, lambda a, z: F.struct(a.alias("a"), z.alias("z")))
    rows = cut.withColumn("lines", tx.split_lines("content")).select("repo_id", "path", "lines", F.posexplode(spans).alias("chunk", "s"))
    number = lambda i: F.lpad(i.cast("string"), F.greatest(F.lit(4), F.length(i.cast("string"))), F.lit(" "))
    a, z = F.col("s.a"), F.col("s.z")
    numbered = F.transform(F.slice("lines", a + 1, z - a), lambda x, i: F.concat(number(i + a + 1), F.lit(" | "), x))
    return rows.select("repo_id", "path", "chunk", (a + 1).alias("start_line"), z.alias("end_line"), F.array_join(numbered, "\n").alias("text"))
