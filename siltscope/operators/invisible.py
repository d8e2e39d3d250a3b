"""Bugs that reviews tend to miss, with a confidence from 0 to 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx
from siltscope.operators.emit import emit, first_index, spec
from siltscope.operators.matching import lines

COLUMNS = ("repo_id", "path", "line", "category", "severity", "confidence", "detail")
HIGH_CONFIDENCE = 80


def _hit(category: str, severity: str, confidence: int, detail):
    return F.struct(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), detail.cast("string").alias("detail")
    )


def invisible_lines(files: DataFrame) -> DataFrame:
    """Rules one line decides: non-null assertions, casts, generic catches, short timers, early side effects."""
    t = F.col("text")
    empty = F.array().cast("array<string>")
    asserts = F.when(t.contains("!"), F.filter(tx.rx_all(t, r"\w+\.\w+!"), lambda m: ~t.contains(F.concat(F.lit("?."), F.regexp_extract(m, r"\.(\w+)!", 1))))).otherwise(empty)
    source = lambda m: F.regexp_extract(m, r"^\(?(\w+)", 1)
    casts = F.when(
        t.contains(" as "),
        F.filter(tx.rx_all(t, r"\(?\w+\)?\s+as\s+\w+"), lambda m: ~source(m).startswith("this") & ~source(m).startswith("e") & (F.length(source(m)) > 1)),
    ).otherwise(empty)
    delay = F.regexp_extract(t, r"setTimeout\(.{0,100},\s*(\d+)\)", 1)
    ms = F.when(F.length(delay).between(1, 9), delay.cast("int"))
    hits = F.concat(
        F.transform(asserts, lambda m: _hit("non-null-crash", "high", 85, m)),
        F.transform(casts, lambda m: _hit("non-null-crash", "medium", 60, m)),
        F.array_compact(F.array(
            F.when(t.contains("catch") & t.contains("Error") & ~tx.has(t, "instanceof", "type"), _hit("error-blindspot", "medium", 55, F.lit("generic"))),
            F.when(t.contains("setTimeout(") & ms.between(1, 499), _hit("timing-bomb", "high", 80, ms)),
            F.when((F.col("line") <= 5) & tx.has(t, "setInterval(", "setTimeout(", ".listen(", "connect("), _hit("side-effect-ordering", "critical", 90, F.lit(""))),
        )),
    )
    pre = ("!", " as ", "catch", "setTimeout(", "setInterval(", ".listen(", "connect(")
    ln = lines(files.filter(tx.has("content", *pre))).filter(tx.has("text", *pre))
    return ln.select("repo_id", "path", "line", F.explode(hits).alias("h")).select("repo_id", "path", "line", "h.*")


def invisible_context(files: DataFrame, look_back: int = 20, look_ahead: int = 15) -> DataFrame:
    """Rules that read neighbouring lines of the same file: shared state, reassigned parameters, swallowed errors."""
    df = files.filter(F.length("content") > 0).select(
        "repo_id", "path", tx.split_lines("content").alias("ls"),
        tx.rx_count("content", r"(?:async\s+)?function\s+\w+|\w+\s*=\s*async\s*\(").alias("fns"),
    )
    ls = F.col("ls")
    df = df.withColumn("first_fn", first_index(ls, lambda x: x.rlike(r"function \w")))

    def at(i, hit):
        return F.struct((i + 1).cast("int").alias("line"), hit.alias("h"))

    def shared(x, i):
        name = F.regexp_extract(x, r"^\s*(?:let|var)\s+(\w+)", 1)
        start = F.greatest(i + 1, F.col("first_fn"))
        later = F.slice(ls, start + 1, F.size(ls))
        written = F.exists(later, lambda y: y.contains(F.concat(name, F.lit(" ="))) | y.contains(F.concat(name, F.lit(".push"))) | y.contains(F.concat(name, F.lit(".add"))))
        return F.when((F.col("fns") >= 2) & (F.col("first_fn") > 0) & (name != "") & ~x.contains("const "), F.when(written, at(i, _hit("race-condition", "critical", 70, name))))

    def reassigned(x, i):
        name = F.regexp_extract(x, r"^\s*(\w+)\s*=\s*[^=]", 1)
        lo = F.greatest(i - look_back, F.lit(0))
        before = F.slice(ls, lo + 1, i - lo)
        param = F.exists(
            before,
            lambda y: tx.has(y, "function(", "function (", "=>") | y.contains(F.concat(F.lit("("), name)) | y.contains(F.concat(F.lit(","), name)),
        )
        return F.when((name != "") & (i > 0), F.when(param, at(i, _hit("implicit-coupling", "high", 80, name))))

    def swallowed(x, i):
        block = F.array_join(F.slice(ls, i + 1, look_ahead), "\n")
        only_log = block.contains("console.") & ~tx.has(block, "throw", "return", "reject") & (F.length(block) < 200)
        return F.when(x.rlike(r"catch\s*\("), F.when(only_log, at(i, _hit("error-blindspot", "high", 75, F.lit("log-only")))))

    hits = F.array_compact(F.concat(F.transform(ls, shared), F.transform(ls, reassigned), F.transform(ls, swallowed)))
    return df.select("repo_id", "path", F.explode(hits).alias("x")).select("repo_id", "path", "x.line", "x.h.*")


MUTATION = r"\.\w+\s*=\s*[^=]|\w+\.\w+\.\w+\s*=\s*"


def invisible_files(files: DataFrame) -> DataFrame:
    """Rules over a whole file: growing collections, leaking listeners, spread overrides, in-place mutation."""
    c = F.col("content")
    ls = tx.split_lines(c)
    mutating = lambda x: x.rlike(MUTATION) & ~tx.has(x, "this.", "const ", "let ")
    df = files.filter(F.length("content") > 0).select(
        "repo_id", "path",
        F.when(tx.rx_count(c, r"\.push\(") > 3, ls).alias("push_lines"),
        (tx.has(c, "on(", "addListener") & ~tx.has(c, "off(", "removeListener")).alias("listeners"),
        c.rlike(r"\{[\s\S]{0,200}\.\.\.\w+[\s\S]{0,200},\s*\w+\s*:").alias("spread"),
        F.size(F.filter(ls, mutating)).alias("mutations"),
        first_index(ls, mutating).alias("first_mutation"),
    )
    first_fn = first_index(F.col("push_lines"), lambda x: x.contains("function"))
    in_fn = F.filter(F.col("push_lines"), lambda x, i: x.contains(".push(") & (first_fn > 0) & (i + 1 >= first_fn))
    df = df.withColumn("pushes", F.when(F.col("push_lines").isNotNull() & ~F.col("path").contains(".test."), F.size(in_fn)).otherwise(0))
    out = emit(df, [
        spec(F.col("pushes") > 2, "unbounded-push", "high", F.col("pushes"), category="memory-leak", confidence=65),
        spec(F.col("listeners"), "listener-leak", "critical", category="memory-leak", confidence=90),
        spec(F.col("spread"), "spread-override", "medium", category="data-corruption", confidence=50),
        spec(F.col("mutations") > 3, "mutation", "high", F.col("mutations"), category="data-corruption", line=F.col("first_mutation"), confidence=60),
    ])
    return out.withColumn("confidence", F.col("confidence").cast("int")).select(*COLUMNS)


def invisible_bugs(files: DataFrame) -> DataFrame:
    parts = [invisible_lines(files), invisible_context(files), invisible_files(files)]
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out.withColumn("high_confidence", F.col("confidence") >= HIGH_CONFIDENCE)
