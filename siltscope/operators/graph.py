"""Import graph: extraction, resolution and the joins over its edges.

A graph is an edge table imports(repo_id, src, specifier, resolved, is_relative, occurrence).
``resolved`` is a repository path without source extension and without a trailing /index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx
from siltscope.operators.ordered import first_n
from siltscope.rules import tables as rt
from siltscope.session import stored

ENTRY_POINTS = ("index.ts", "index.tsx", "main.tsx", "app.ts", "server.ts")


def resolve_path(base_dir: Column, specifier: Column) -> Column:
    """Relative specifier against a directory: ``..`` pops a segment, ``.`` is skipped."""
    start = F.filter(F.split(base_dir, "/"), lambda s: s != "")
    out = F.aggregate(
        F.split(specifier, "/"),
        start,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == ".") | (s == ""), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(out, "/")


def module_key(path: Column | str) -> Column:
    """Join key of a module: path without source extension and trailing /index."""
    return F.regexp_replace(tx.strip_source_ext(path), "/index$", "")


def imports(files: DataFrame) -> DataFrame:
    """Every import or require of every file; no shuffle."""
    spec = F.posexplode(tx.rx_all("content", rt.IMPORT_SPECIFIER, 1)).alias("occurrence", "specifier")
    e = files.filter(tx.has("content", "from", "require")).select("repo_id", F.col("path").alias("src"), spec)
    rel = F.col("specifier").startswith(".")
    return e.select(
        "repo_id", "src", "specifier",
        F.when(rel, module_key(resolve_path(tx.directory("src"), F.col("specifier")))).otherwise(F.col("specifier")).alias("resolved"),
        rel.alias("is_relative"), "occurrence",
    )


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that import nothing, are imported by nobody and are no entry point."""
    paths = files.select("repo_id", "path", module_key("path").alias("key"))
    cand = paths.filter(~F.col("path").contains("index.") & ~tx.ends_with_any("path", *ENTRY_POINTS))
    importing = edges.select("repo_id", F.col("src").alias("path")).distinct()
    imported = edges.select("repo_id", F.col("resolved").alias("key")).distinct()
    return cand.join(importing, ["repo_id", "path"], "left_anti").join(imported, ["repo_id", "key"], "left_anti").select("repo_id", "path")


def layer_violations(edges: DataFrame) -> DataFrame:
    """UI importing the data layer (high), routes importing components (medium)."""
    d, t = tx.directory("src"), F.col("resolved")
    ui = tx.has(d, "components", "pages") & tx.has(t, "db/", "database")
    route = d.contains("routes") & t.contains("components") & ~t.contains("layouts")
    hits = F.array_compact(F.array(F.when(ui, F.lit("high")), F.when(route, F.lit("medium"))))
    return edges.filter(ui | route).select("repo_id", F.col("src").alias("path"), "resolved", F.explode(hits).alias("severity"))


def circular_imports(edges: DataFrame) -> DataFrame:
    """Pairs of files that import each other, each pair once."""
    e = edges.filter("is_relative").select("repo_id", "src", module_key("src").alias("a"), F.col("resolved").alias("b")).distinct()
    back = e.select("repo_id", F.col("src").alias("other"), F.col("b").alias("a"), F.col("a").alias("b"))
    return (
        e.join(back, ["repo_id", "a", "b"]).filter(F.col("src") < F.col("other"))
        .select("repo_id", F.col("src").alias("file_a"), F.col("other").alias("file_b")).distinct()
    )


# --- copy-paste ---------------------------------------------------------------------------------

def signatures(files: DataFrame, min_chars: int = 200) -> DataFrame:
    """Files longer than ``min_chars`` with their distinct function signatures, at least three."""
    s = F.array_sort(F.array_distinct(tx.rx_all("content", rt.FUNCTION_SIGNATURE)))
    out = files.filter((F.length("content") > min_chars) & F.col("content").contains("function")).select("repo_id", "path", s.alias("sigs"))
    return out.filter(F.size("sigs") >= 3)


def copy_paste(files: DataFrame, triple_limit: int = 20) -> DataFrame:
    """First other file, by path, that shares at least three function signatures.

    No file pairs are formed for the bulk of the data.  Two files share three signatures exactly when
    they share a triple of them, and the first partner only needs the two smallest paths per triple,
    which a partial aggregation yields however many files own it.  Equal signature sets are reduced to
    one representative first, and signatures only one set has are dropped.  The few sets with more
    than ``triple_limit`` shared signatures are compared by counting common signatures instead.  Triples
    are named by two 64-bit hashes.
    """
    # stored once, as every step below reads them; merge joins, as the planner takes the size of what is read for that of the signatures
    base = stored(signatures(files).withColumn("set_id", F.sha2(F.to_json("sigs"), 256)), "signatures")
    sets = base.groupBy("repo_id", "set_id").agg(F.min("path").alias("first"), F.first("sigs").alias("sigs"), F.count("*").alias("copies"))
    sets = stored(sets, "signature-sets")
    members = base.select("repo_id", "set_id", "path")
    firsts = sets.select("repo_id", "set_id", "first").hint("merge")
    second = members.join(sets.filter("copies > 1").select("repo_id", "set_id", "first").hint("merge"), ["repo_id", "set_id"]).filter(F.col("path") != F.col("first"))
    second = second.groupBy("repo_id", "set_id").agg(F.min("path").alias("second"))
    # signatures owned by one set cannot be shared
    owned = sets.select("repo_id", "set_id", F.explode("sigs").alias("sig"))
    shared = owned.groupBy("repo_id", "sig").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    live = owned.join(shared.hint("merge"), ["repo_id", "sig"], "left_semi").groupBy("repo_id", "set_id").agg(F.array_sort(F.collect_set("sig")).alias("sigs"))
    live = stored(live.filter(F.size("sigs") >= 3).join(firsts, ["repo_id", "set_id"]), "signature-live")
    small, big = live.filter(F.size("sigs") <= triple_limit), live.filter(F.size("sigs") > triple_limit)

    s = F.col("sigs")
    triples = F.flatten(F.transform(s, lambda a, i: F.flatten(F.transform(
        F.slice(s, i + 2, F.size(s)), lambda b, j: F.transform(F.slice(s, i + j + 3, F.size(s)), lambda c: F.struct(F.xxhash64(a, b, c), F.xxhash64(F.lit(1), a, b, c)))))))
    keyed = small.select("repo_id", "set_id", "first", F.explode(triples).alias("triple"))
    lo = keyed.groupBy("repo_id", "triple").agg(F.min("first").alias("lo"), F.max("first").alias("mx")).filter("lo < mx").drop("mx")
    hi = keyed.join(lo.hint("merge"), ["repo_id", "triple"]).groupBy("repo_id", "triple").agg(
        F.min("lo").alias("lo"), F.min(F.when(F.col("first") > F.col("lo"), F.col("first"))).alias("hi")
    )
    best = keyed.join(hi.hint("merge"), ["repo_id", "triple"])
    best = best.select("repo_id", "set_id", F.when(F.col("first") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("partner"))
    # wide sets on either side: count common signatures
    bs = big.select("repo_id", F.col("set_id").alias("big_id"), F.col("first").alias("big_first"), F.explode("sigs").alias("sig"))
    al = live.select("repo_id", "set_id", "first", F.explode("sigs").alias("sig"))
    wide = (
        bs.join(al.hint("merge"), ["repo_id", "sig"]).filter(F.col("big_id") != F.col("set_id"))
        .groupBy("repo_id", "big_id", "big_first", "set_id", "first").agg(F.count("*").alias("n")).filter("n >= 3")
    )
    wide = wide.select("repo_id", F.explode(F.array(
        F.struct(F.col("big_id").alias("set_id"), F.col("first").alias("partner")), F.struct(F.col("set_id"), F.col("big_first").alias("partner"))
    )).alias("_p")).select("repo_id", "_p.*")
    other = best.union(wide).groupBy("repo_id", "set_id").agg(F.min("partner").alias("other"))
    out = members.join(firsts, ["repo_id", "set_id"]).join(second.hint("merge"), ["repo_id", "set_id"], "left").join(other.hint("merge"), ["repo_id", "set_id"], "left")
    twin = F.when(F.col("path") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return out.select("repo_id", "path", F.least(twin, F.col("other")).alias("partner")).filter(F.col("partner").isNotNull())


# --- dead code ------------------------------------------------------------------------------------

EXPORT_NAMES = (
    (r"export\s+(?:async\s+)?function\s+(\w+)", 100),
    (r"export\s+(?:const|let|var)\s+(\w+)", 0),
    (r"export\s+(?:default\s+)?class\s+(\w+)", 200),
)


def exported_symbols(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, symbol, loc): exported names and how many lines their declaration takes.

    A function or class runs to the next line that is a lone ``}``, at most 100 or 200 lines on.
    """
    ls = F.col("ls")
    df = files.filter(F.col("content").contains("export")).select("repo_id", "path", tx.split_lines("content").alias("ls"))

    def found(x, i):
        def one(p, reach):
            name = F.regexp_extract(x, p, 1)
            if reach == 0:
                loc = F.lit(1)
            else:
                rest = F.transform(F.slice(ls, i + 2, reach - 1), tx.strip)
                end = F.array_position(rest, "}")
                loc = F.when(end > 0, end + 1).otherwise(F.size(rest) + 1).cast("int")
            return F.when(name != "", F.struct((i + 1).cast("int").alias("line"), name.alias("symbol"), loc.alias("loc")))

        return F.when(x.contains("export"), F.array_compact(F.array(*[one(p, r) for p, r in EXPORT_NAMES]))).otherwise(F.array().cast("array<struct<line:int,symbol:string,loc:int>>"))

    return df.select("repo_id", "path", F.explode(F.flatten(F.transform(ls, found))).alias("e")).select("repo_id", "path", "e.*")


def declaration_length(files: DataFrame) -> DataFrame:
    return exported_symbols(files).select("repo_id", "path", "line", "symbol", "loc")


def _named(*cols: str) -> list[Column]:
    """A name as two 64-bit hashes, so that it is grouped and joined as numbers."""
    return [F.xxhash64(*cols).alias("_a"), F.xxhash64(F.lit(1), *cols).alias("_b")]


def dead_exports(files: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """Exported symbols of files nobody imports whose name occurs as a word in no other file.

    Names are compared as whole words, not substrings.  Word occurrences are reduced per task to numbers,
    two 64-bit hashes of the name and the smallest and largest hash of its paths, so a word that fills the corpus stays one row and no
    text of a word is shuffled or sorted; only names that occur in one file leave the grouping.
    """
    ex = exported_symbols(files).groupBy("repo_id", "path", "symbol").agg(F.max_by("loc", "line").alias("loc"))
    # a file's symbols come together in one array; they are a file's, not a corpus'
    many = ex.groupBy("repo_id", "path").agg(F.collect_list(F.struct("symbol", "loc")).alias("_e")).filter(F.size("_e") > 1)
    imported = edges.filter("is_relative").select("repo_id", F.col("resolved").alias("key")).distinct()
    cand = many.withColumn("key", module_key("path")).join(imported, ["repo_id", "key"], "left_anti")
    cand = cand.select("repo_id", "path", F.explode("_e").alias("e")).select("repo_id", "path", "e.*", *_named("repo_id", "e.symbol"))
    at = F.xxhash64("path").alias("_p")
    words = files.select("repo_id", at, F.explode(F.array_distinct(tx.rx_all("content", r"\w+"))).alias("symbol")).select(*_named("repo_id", "symbol"), "_p")
    use = words.groupBy("_a", "_b").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi")).filter("_lo = _hi").select("_a", "_b")
    repos = files.groupBy("repo_id").agg(F.min("path").alias("_lo"), F.max("path").alias("_hi")).filter("_lo < _hi").select("repo_id")
    out = cand.join(use, ["_a", "_b"]).join(repos, "repo_id", "left_semi")
    out = out.select("repo_id", "path", "symbol", "loc", F.when(tx.ends_with_any("path", "index.ts", "index.tsx"), "moderate").otherwise("safe").alias("risk"))
    return first_n(out, ["repo_id"], [F.asc("path"), F.asc("symbol")], k) if k else out


def dead_modules(files: DataFrame, edges: DataFrame, minimum: int = 5) -> DataFrame:
    """Files with more than ``minimum`` exports that nobody imports, index files aside."""
    n = tx.rx_count("content", tx.BL + r"export\s+(?:function|const|class|interface|type)\s+\w+")
    imported = edges.filter("is_relative").select("repo_id", F.col("resolved").alias("key")).distinct()
    name = tx.base_name("path")
    return (
        files.select("repo_id", "path", n.alias("exports"), module_key("path").alias("key"))
        .filter((F.col("exports") > minimum) & ~name.isin("index.ts", "index.tsx", "index.js"))
        .join(imported, ["repo_id", "key"], "left_anti").select("repo_id", "path", "exports")
    )


# --- coupling ----------------------------------------------------------------------------------------

def coupling(edges: DataFrame, mode: str = "raw", fan_in: int = 10, fan_out: int = 20) -> DataFrame:
    """Modules imported more than ``fan_in`` times (-8) and files with more than ``fan_out`` imports (-5).

    ``raw`` counts imports per specifier text; ``resolved`` counts distinct files per resolved module.
    """
    e = edges.filter(~F.col("specifier").startswith("@types/"))
    if mode == "raw":
        into = e.groupBy("repo_id", F.col("specifier").alias("path")).agg(F.count("*").alias("n"))
    elif mode == "resolved":
        into = e.groupBy("repo_id", F.col("resolved").alias("path")).agg(F.countDistinct("src").alias("n"))
    else:
        raise ValueError(mode)
    out = e.groupBy("repo_id", F.col("src").alias("path")).agg(F.count("*").alias("n"))
    row = lambda d, rule, sev, pts: d.select("repo_id", "path", F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), "n", F.lit(pts).alias("points"))
    return row(into.filter(F.col("n") > fan_in), "high-fan-in", "high", 8).unionByName(row(out.filter(F.col("n") > fan_out), "high-fan-out", "medium", 5))


def module_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) > 1), F.concat(F.lit("src/"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def module_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct dependencies between top-level modules that own files."""
    modules = files.select("repo_id", module_of(F.col("path")).alias("target")).distinct()
    e = edges.filter("is_relative").select("repo_id", module_of(F.col("src")).alias("source"), module_of(F.col("resolved")).alias("target")).distinct()
    e = e.filter((F.col("source") != F.col("target")) & (F.col("target") != "") & ~F.col("target").rlike("^[.@]"))
    return e.join(modules, ["repo_id", "target"], "left_semi").select("repo_id", "source", "target")


def module_summary(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules, dependencies and the module with the most outgoing ones, per repository."""
    n = files.groupBy("repo_id").agg(F.countDistinct(module_of(F.col("path"))).alias("modules"))
    deg = module_edges(files, edges).groupBy("repo_id", "source").agg(F.count("*").alias("out_degree"))
    s = deg.groupBy("repo_id").agg(F.sum("out_degree").alias("dependencies"), F.min_by("source", F.struct(-F.col("out_degree"), F.col("source"))).alias("most_coupled"))
    return n.join(s, "repo_id", "left").na.fill(0, ["dependencies"])


# --- blast radius ---------------------------------------------------------------------------------------

#: symbols that are searched as literals first
FEW_SYMBOLS = 64


def blast_radius(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that mention a symbol as a whole word: lines, depth 1 with its definition else 2, test or not.

    symbols(symbol) is a request list of any length; the planner broadcasts a short one. For up to ``FEW_SYMBOLS`` a byte search leaves
    out files and lines without any, before their words are taken.
    """
    names = symbols.select("symbol").distinct()
    few = [r["symbol"] for r in names.filter("symbol IS NOT NULL").limit(FEW_SYMBOLS + 1).collect()]
    needed = lambda df, c: df.filter(tx.has(c, *few)) if 0 < len(few) <= FEW_SYMBOLS else df
    ln = needed(needed(files, "content").select("repo_id", "path", F.explode(tx.split_lines("content")).alias("text")), "text")
    # the look-ahead lets "export function f" define f as well as match export
    defined = tx.rx_all("text", tx.BL + r"(?=(?:function|class|const|let|var|def|interface|type|export)\s+(\w+))", 1)
    words = ln.select("repo_id", "path", defined.alias("defined"), F.explode(F.array_distinct(tx.rx_all("text", r"\w+"))).alias("symbol"))
    hit = words.join(names, "symbol")
    return hit.groupBy("symbol", "repo_id", "path").agg(
        F.count("*").alias("mentions"),
        F.when(F.max(F.array_contains("defined", F.col("symbol"))), 1).otherwise(2).alias("depth"),
        F.max(tx.has("path", ".test.", ".spec.", "__tests__", "tests/")).alias("is_test"),
    )


def blast_summary(hits: DataFrame) -> DataFrame:
    """Impact per symbol: mentions, production and test files, risk by mentions above 50 / 10."""
    s = hits.groupBy("symbol").agg(
        F.sum("mentions").alias("mentions"),
        F.sum((~F.col("is_test")).cast("long")).alias("production_files"),
        F.sum(F.col("is_test").cast("long")).alias("test_files"),
    )
    return s.withColumn("risk", F.when(F.col("mentions") > 50, "high").when(F.col("mentions") > 10, "medium").otherwise("low"))


# --- tests ------------------------------------------------------------------------------------------------

def control_flow_class(n: Column) -> Column:
    return F.when(n > 30, "high").when(n > 15, "medium").otherwise("low")


def gaps_in_tests(files: DataFrame) -> DataFrame:
    """Source files over 50 lines without a test of the same base name."""
    tests = files.filter(tx.is_test_path("path")).select(
        "repo_id", F.regexp_replace(tx.base_name("path"), r"\.(?:test|spec)\.(?:ts|tsx|js|jsx)$", "").alias("base")
    ).distinct()
    src = files.filter(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx)$") & ~tx.is_test_path("path") & ~F.col("path").contains("node_modules"))
    flow = tx.rx_count("content", tx.BL + r"(?:if|for|while|switch|catch)\s")
    g = src.select("repo_id", "path", F.regexp_replace(tx.base_name("path"), r"\.(?:ts|tsx|js|jsx)$", "").alias("base"), flow.alias("flow"), tx.line_count("content").alias("lines"))
    g = g.filter(F.col("lines") > 50).join(tests, ["repo_id", "base"], "left_anti")
    out = g.select("repo_id", "path", "lines", control_flow_class(F.col("flow")).alias("complexity"))
    return out.withColumn("priority", F.when(F.col("complexity") == "high", "high").otherwise("medium"))


def risk_heatmap(files: DataFrame, k: int | None = None) -> DataFrame:
    """Complexity weight times churn proxy, kept above 15 (top ``k`` per repository)."""
    from siltscope.functions import numbers as nm

    flow = tx.rx_count("content", tx.BL + r"(?:if|for|while|switch|catch|try)\s")
    m = files.select("repo_id", "path", tx.line_count("content").alias("lines"), flow.alias("flow"), tx.rx_count("content", tx.BL + r"function\s+\w+").alias("functions"))
    m = m.withColumn("complexity", control_flow_class(F.col("flow")))
    churn = nm.js_round(F.least(F.col("lines") / 200, F.lit(3.0)) * 10 + F.col("functions") / F.col("lines") * 100)
    w = F.when(F.col("complexity") == "high", 3.0).when(F.col("complexity") == "medium", 1.5).otherwise(0.5)
    m = m.withColumn("churn", churn.cast("int")).withColumn("risk", nm.js_round(w * F.col("churn")).cast("int")).filter(F.col("risk") > 15)
    return first_n(m.select("repo_id", "path", "complexity", "churn", "risk"), ["repo_id"], [F.desc("risk"), F.asc("path")], k)


