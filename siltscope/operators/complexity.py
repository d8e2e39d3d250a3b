"""File complexity, nesting depth, topics and file placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx
from siltscope.operators.emit import emit, flag_any, spec
from siltscope.operators.ordered import first_n
from siltscope.rules import tables as rt

SKIP_EXT = (".md", ".json", ".yaml", ".yml")


_B = r"[ \t\r\f\x0b]"
# a line that only opens (group 1 empty) or only closes (group 1 is the closer); a line that does both
# leaves the depth as it was
_OPEN_CLOSE = rf"(?dm)^(?!{_B}*[}})\]])[^\n]*(?:[{{(]|=>){_B}*$|^{_B}*([}})\]])(?![^\n]*(?:[{{(]|=>){_B}*$)"


def _deepest(deltas: Column) -> Column:
    """Maximum of the running sum of small steps, floored at zero on the way."""
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    walk = F.aggregate(
        deltas,
        zero,
        lambda acc, x: F.struct(F.greatest(F.lit(0), acc["d"] + x).alias("d"), F.greatest(acc["m"], acc["d"] + x).alias("m")),
    )
    return walk["m"]


def nesting_depth(content: Column | str, mode: str = "braces") -> Column:
    """Deepest nesting of a text, floored at zero.

    ``braces`` counts { and } per line; ``openers`` adds one for a line that ends in an opener and
    takes one off for a line that starts with a closer.  A regex pass first reduces the text to the
    lines that change the depth, so the fold walks a few short strings of the same row.
    """
    c = F.col(content) if isinstance(content, str) else content
    if mode == "braces":
        bare = F.split(F.regexp_replace(c, r"[^{}\n]+", ""), r"\n+")
        step = lambda x: F.length(F.replace(x, F.lit("}"), F.lit(""))) - F.length(F.replace(x, F.lit("{"), F.lit("")))
        return F.when(c.contains("{"), _deepest(F.transform(bare, step))).otherwise(0)
    if mode == "openers":
        closers = F.regexp_extract_all(c, F.lit(_OPEN_CLOSE), F.lit(1))
        return _deepest(F.transform(closers, lambda x: F.when(x == "", 1).otherwise(-1)))
    raise ValueError(mode)


def _any_word(low: Column, body: str) -> Column:
    """A whole word of ``body`` occurs in lower-cased text: byte search first, regex to confirm."""
    return tx.has(low, *body.replace("\\", "").split("|")) & tx.rx(low, tx.word(f"(?:{body})"))


def topics(content: Column | str) -> Column:
    """Names of the topics a text touches, by whole words."""
    c = F.col(content) if isinstance(content, str) else content
    # one-element transform: binds the lower-cased text so that all look-ups share it
    return F.transform(F.array(F.lower(c)), _topic_names)[0]


def _topic_names(t: Column) -> Column:
    parts = [F.when(_any_word(t, body), F.lit(name)) for name, body in rt.TOPICS]
    file_io = _any_word(t, "readfile|writefile|stream|buffer") | (tx.has(t, "fs.", "path.") & tx.rx(t, tx.BL + r"(?:fs|path)\.[a-z0-9_]"))
    parts.append(F.when(file_io, F.lit("file-io")))
    net = _any_word(t, rt.NETWORK_BASE) | (_any_word(t, rt.NETWORK_CONTEXT[0]) & _any_word(t, rt.NETWORK_CONTEXT[1]))
    ui = _any_word(t, rt.UI_BASE) | (_any_word(t, rt.UI_CONTEXT[0]) & _any_word(t, rt.UI_CONTEXT[1]))
    parts += [F.when(net, F.lit("networking")), F.when(ui, F.lit("UI"))]
    return F.array_compact(F.array(*parts))


def topic_areas(files: DataFrame) -> DataFrame:
    out = files.select("repo_id", "path", topics("content").alias("topics"), tx.line_count("content").alias("lines"))
    return out.withColumn("low_cohesion", (F.size("topics") > 3) & (F.col("lines") > 200))


def file_metrics(files: DataFrame) -> DataFrame:
    """Counts one scan of the content yields for the complexity, language and comment operators."""
    c = F.col("content")
    # the capture keeps single-dot imports ("./x") and parent ones apart by their directory
    rel = F.filter(tx.rx_all(c, r"""from\s+["']([^"']+)["']""", 1), lambda s: s.startswith("."))
    dirs = F.array_distinct(F.transform(rel, lambda s: F.regexp_replace(F.regexp_replace(s, "/+[^/]*$", ""), r"^\.?$", "same-level")))
    return files.select(
        "repo_id",
        "path",
        F.length("content").alias("size"),
        tx.line_count(c).alias("lines"),
        F.when(c.contains("export"), tx.rx_count(c, tx.BL + r"export\s+(?:function|const|class|interface|type)\s")).otherwise(0).alias("exports"),
        nesting_depth(c).alias("depth"),
        topics(c).alias("topics"),
        tx.blank_lines(c).alias("blank"),
        tx.comment_lines(c).alias("comments"),
        F.when(c.contains("from"), F.size(dirs)).otherwise(0).alias("import_dirs"),
    )


def file_complexity(files: DataFrame) -> DataFrame:
    """Size class, score and reasons of each file.

    Over 300 lines +20, over 600 +40; more than 15 exports +25; depth above 6 +15; more than three
    topics over 200 lines +10; blank share above 30 % +5; comment share above 40 % +5; more than
    eight import directories +10.  Markup and data files are small and score nothing.
    """
    m = file_metrics(files)
    data = tx.ends_with_any("path", *SKIP_EXT)
    n = F.col("lines")
    size_class = F.when(data | (n <= 100), "small").when(n <= 300, "medium").when(n <= 600, "large").otherwise("xlarge")
    parts = [
        (F.lit(None).cast("string"), F.when(n > 600, 40).when(n > 300, 20).otherwise(0), F.lit(True)),
        (F.lit("exports"), F.lit(25), F.col("exports") > 15),
        (F.lit("nesting"), F.lit(15), F.col("depth") > 6),
        (F.lit("low-cohesion"), F.lit(10), (F.size("topics") > 3) & (n > 200)),
        (F.lit("blank-lines"), F.lit(5), F.col("blank") > n * 0.3),
        (F.lit("comment-lines"), F.lit(5), F.col("comments") > n * 0.4),
        (F.lit("import-spread"), F.lit(10), F.col("import_dirs") > 8),
    ]
    score = sum((F.when(cond & ~data, pts).otherwise(0) for _, pts, cond in parts), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(cond & ~data, name) for name, _, cond in parts]))
    return m.withColumn("size_class", size_class).withColumn("score", score.cast("int")).withColumn("reasons", reasons)


def size_distribution(complexity: DataFrame) -> DataFrame:
    """Files per size class and average length, per repository."""
    classes = ("small", "medium", "large", "xlarge")
    counts = [F.sum((F.col("size_class") == s).cast("long")).alias(s) for s in classes]
    return complexity.groupBy("repo_id").agg(
        F.count("*").alias("files"), *counts, F.floor(F.avg("lines") + 0.5).cast("long").alias("avg_lines")
    )


def worst_complexity(complexity: DataFrame, k: int | None = None) -> DataFrame:
    return first_n(complexity.filter(F.col("score") > 0), ["repo_id"], [F.desc("score"), F.asc("path")], k)


def longest_files(complexity: DataFrame, k: int | None = None) -> DataFrame:
    return first_n(complexity.select("repo_id", "path", "lines"), ["repo_id"], [F.desc("lines"), F.asc("path")], k)


REACT_EXT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
REACT_IMPORT = tx.BL + r"import" + tx.BR + r"""[^;]+@<@from\s+['"]react['"]"""


def placement_violations(files: DataFrame) -> DataFrame:
    """Tests, hooks and handlers outside the directories they belong to.

    The hook rule applies to repositories that import react; that flag is one row per repository.
    """
    react = files.groupBy("repo_id").agg(flag_any(F.col("content").contains("react") & tx.rx("content", REACT_IMPORT), "react"))
    p, name, d = F.col("path"), tx.base_name("path"), tx.directory("path")
    slim = files.select("repo_id", "path", name.alias("name"), d.alias("dir"), tx.extension(p).alias("ext"))
    n, d = F.col("name"), F.col("dir")
    test = tx.has(n, "test", "spec") & ~p.contains("__tests__") & ~p.contains("test/")
    hook = F.col("ext").isin(*REACT_EXT) & n.rlike("^use[A-Z]") & ~d.contains("hook")
    handler = tx.has(n, "Controller", "Handler") & ~tx.has(d, "routes", "controllers", "handlers")
    flagged = slim.filter(test | hook | handler).join(react, "repo_id")
    return emit(
        flagged,
        [
            spec(test, "test-outside-tests", "low", category="placement"),
            spec(hook & F.col("react"), "hook-outside-hooks", "low", category="placement"),
            spec(handler, "handler-outside-routes", "low", category="placement"),
        ],
    ).drop("points")
