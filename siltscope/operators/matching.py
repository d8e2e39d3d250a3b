"""Rule matching over files.

A file is one row and stays one row: line rules explode the lines of a row in place (no shuffle)
and only rows holding a rule's literal are exploded at all.  Findings leave as slim rows without
the file content.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx
from siltscope.rules import tables as rt
from siltscope.rules.model import BATCH, Rule, rules_from_df

FINDING_COLUMNS = ("repo_id", "path", "line", "rule", "category", "severity", "confidence", "detail", "ordinal")


def lines(files: DataFrame) -> DataFrame:
    """files(repo_id, path, content) -> lines(repo_id, path, line, text), 1-based, no shuffle."""
    return files.select(
        "repo_id", "path", F.posexplode(tx.split_lines("content")).alias("pos", "text")
    ).select("repo_id", "path", (F.col("pos") + 1).alias("line"), "text")


def _as_rules(rules: Sequence[Rule] | DataFrame) -> list[Rule]:
    return rules_from_df(rules) if isinstance(rules, DataFrame) else list(rules)


def _needle_filter(rules: Sequence[Rule], text: Column) -> Column | None:
    """Literal pre-test that every matching text passes; None when some rule has no literal."""
    needles: list[str] = []
    for r in rules:
        if not r.needles:
            return None
        needles.extend(r.needles)
    # a literal containing another one adds nothing
    needles = [n for n in dict.fromkeys(needles) if not any(m != n and m in n for m in needles)]
    return tx.has(text, *needles)


def match_lines(files: DataFrame, rules: Sequence[Rule] | DataFrame, with_text: bool = False) -> DataFrame:
    """Each rule against each line, one finding per (rule, line), ``with_text`` with the line as ``old_text``.

    The rule table is unrolled into one expression, so the text is never joined with the rules.
    Output: repo_id, path, line, rule, category, severity, confidence, detail, ordinal.
    """
    rules = _as_rules(rules)
    parts = [_match_lines(files, rules[i : i + BATCH], i, with_text) for i in range(0, max(len(rules), 1), BATCH)]
    return reduce(DataFrame.unionByName, parts)


def _match_lines(files: DataFrame, rules: Sequence[Rule], first: int, with_text: bool = False) -> DataFrame:
    pre = _needle_filter(rules, F.col("content"))
    src = files if pre is None else files.filter(pre)
    ln = lines(src)
    pre_line = _needle_filter(rules, F.col("text"))
    if pre_line is not None:
        ln = ln.filter(pre_line)
    hits = F.array(
        *[
            F.when(
                r.condition(F.col("text"), F.col("path")),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.category).alias("category"),
                    F.lit(r.severity).alias("severity"),
                    F.lit(float(r.confidence)).alias("confidence"),
                    F.regexp_extract(
                        tx.strip("text") if r.trimmed else F.col("text"), tx.java(r.pattern), 0
                    ).alias("detail"),
                    F.lit(first + i).alias("ordinal"),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    more = [F.col("text").alias("old_text")] if with_text else []
    return (
        ln.select("repo_id", "path", "line", F.explode(F.array_compact(hits)).alias("h"), *more)
        .select("repo_id", "path", "line", "h.*", *(["old_text"] if with_text else []))
    )


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once in a row."""
    return F.get(F.transform(F.array(value), use), 0)


#: marks the place of a match in a copy of the text
_MARK = "\x01"
#: lines whose results one fold gathers; results are joined by block, so appending stays linear in the lines
BLOCK = 256


#: matches of a text whose lines are found by counting line ends before each; more are found line by line
FEW = 32


def unmarked(content: Column) -> Column:
    """The text without marks: one that has the mark already gives it away to another control character."""
    return F.when(content.contains(_MARK), F.translate(content, _MARK, "\x02")).otherwise(content)


def match_lines_of(content: Column, pattern: str) -> Column:
    """The line that each match of a pattern in an ``unmarked`` text starts on, in order; one regex pass.

    In a copy of the text each match gets a mark before it. The line ends between the marks of a few matches are counted; with more, all
    but marks and line ends goes, and what is left between two line ends are the matches that start on that line. Nothing is carried
    from match to match.
    """
    marked = F.regexp_replace(content, F.lit(tx.java(pattern)), F.lit(_MARK + "$0"))

    def ends(t: Column) -> Column:
        return F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))

    def few(parts: Column) -> Column:
        before = F.slice(parts, 1, F.size(parts) - 1)
        return _bind(F.transform(before, ends), lambda n: F.transform(n, lambda _, i: F.aggregate(F.slice(n, 1, i + 1), F.lit(1), lambda a, x: a + x)))

    def many(text: Column) -> Column:
        per_line = F.split(F.regexp_replace(text, f"[^\n{_MARK}]++", ""), "\n", -1)
        return F.flatten(F.transform(per_line, lambda marks, i: F.array_repeat(i + 1, F.length(marks))))

    def place(text: Column) -> Column:
        by_parts = _bind(F.split(text, _MARK, -1), lambda parts: F.when(F.size(parts) <= FEW, few(parts)).otherwise(many(text)))
        return F.when(F.octet_length(text) > F.octet_length(content), by_parts).otherwise(F.array().cast("array<int>"))

    return _bind(marked, place)


def match_starts(content: Column, pattern: str) -> Column:
    """Every match of a pattern in a text as (line, detail); a match belongs to the line that it starts on."""
    none = F.array().cast("array<struct<line:int,detail:string>>")
    place = lambda found: F.zip_with(match_lines_of(unmarked(content), pattern), found, lambda line, m: F.struct(line.alias("line"), m.alias("detail")))
    return _bind(F.regexp_extract_all(content, F.lit(tx.java(pattern)), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _tests(r: Rule, content: Column) -> list[Column]:
    """Cheap tests that every text with a match of the rule passes."""
    tests = [F.octet_length(content) >= r.at_least] if r.at_least else []
    tests += [tx.has_rarely(content, *r.needles)] if r.needles else []
    tests += [tx.has_rarely(F.lower(content), *r.folded)] if r.folded else []
    return tests + [tx.rx(content, p) for p in r.also]


def match_places(files: DataFrame, rules: Sequence[Rule], guarded: dict[str, Column] | None = None) -> DataFrame:
    """(repo_id, path, ordinal, line) of every match of each rule in whole files; ``match_files`` without the texts of the matches.

    ``guarded`` has, by rule name, a column of lines whose matches do not count.
    """
    content, none = F.col("content"), F.array().cast("array<struct<ordinal:int,line:int>>")

    def hits(i: int, r: Rule) -> Column:
        at = match_lines_of(content, r.in_files)
        if guarded and r.name in guarded:
            at = _bind(at, lambda ls: F.when(F.size(ls) > 0, _bind(guarded[r.name], lambda g: F.filter(ls, lambda x: ~F.array_contains(g, x)))).otherwise(ls))
        found = F.transform(at, lambda x: F.struct(F.lit(i).alias("ordinal"), x.alias("line")))
        return F.when(F.col(f"_t{i}"), found).otherwise(none)

    parts = []
    for a in range(0, len(rules), BATCH):
        few = list(enumerate(rules))[a : a + BATCH]
        # the tests are columns of their own: what an explosion is made of is not compiled
        passed = [reduce(Column.__and__, _tests(r, content) or [F.lit(True)]).alias(f"_t{i}") for i, r in few]
        tested = files.select("repo_id", "path", unmarked(content).alias("content"), *passed)
        all_hits = F.flatten(F.array(*[hits(i, r) for i, r in few]))
        parts.append(tested.select("repo_id", "path", F.explode(all_hits).alias("h")).select("repo_id", "path", "h.ordinal", "h.line"))
    return reduce(DataFrame.unionByName, parts)


def match_files(files: DataFrame, rules: Sequence[Rule], guarded: dict[str, Column] | None = None) -> DataFrame:
    """Each rule against whole files, every match, with the line its start falls on; no shuffle, no Python.

    ``guarded`` has, by rule name, a column of lines whose matches do not count.
    """
    rules = list(rules)
    content = F.col("content")
    none = F.array().cast("array<struct<rule:string,category:string,severity:string,confidence:double,ordinal:int,line:int,detail:string>>")

    def hits(i: int, r: Rule) -> Column:
        facts = (F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(float(r.confidence)).alias("confidence"), F.lit(i).alias("ordinal"))
        starts = match_starts(content, r.in_files)
        if guarded and r.name in guarded:
            starts = _bind(starts, lambda ms: F.when(F.size(ms) > 0, _bind(guarded[r.name], lambda g: F.filter(ms, lambda m: ~F.array_contains(g, m["line"])))).otherwise(ms))
        found = F.transform(starts, lambda m: F.struct(*facts, m["line"].alias("line"), m["detail"].alias("detail")))
        tests = _tests(r, content)
        return F.when(reduce(Column.__and__, tests), found).otherwise(none) if tests else found

    pre = _needle_filter(rules, content)
    src = files if pre is None else files.filter(pre)
    parts = []
    for a in range(0, len(rules), BATCH):
        all_hits = F.flatten(F.array(*[hits(a + i, r) for i, r in enumerate(rules[a : a + BATCH])]))
        parts.append(src.select("repo_id", "path", F.explode(all_hits).alias("h")).select("repo_id", "path", "h.line", "h.rule", "h.category", "h.severity", "h.confidence", "h.detail", "h.ordinal"))
    return reduce(DataFrame.unionByName, parts)


# --- try-block state -----------------------------------------------------------------------

# quoted text of one line; runs without quote or backslash are taken whole, so that long literals need no deep stack
_QUOTED = r"""(["'`])(?:[^\\"'`\r\n]++|\\.|(?!\1).)*\1"""
_BRACE = r"(?:(?<![A-Za-z0-9_])try\s*)?\{|\}"


def try_lines(content: Column) -> Column:
    """1-based numbers of lines that start while a ``try {`` block is open: a fold over the braces of each line."""
    ints = F.array().cast("array<int>")
    tokens = lambda line: F.regexp_extract_all(F.regexp_replace(line, _QUOTED, '""'), F.lit(_BRACE), F.lit(0))

    def brace(state: Column, token: Column) -> Column:
        depth, open_at = state["depth"], state["open"]
        less = F.greatest(depth - 1, F.lit(0))
        return F.when(token == "}", F.struct(less.alias("depth"), F.filter(open_at, lambda x: x < less).alias("open"))).otherwise(
            F.struct((depth + 1).alias("depth"), F.when(token == "{", open_at).otherwise(F.concat(open_at, F.array(depth))).alias("open")))

    def line(a: Column, found: Column) -> Column:
        out = F.when(F.size(a["s"]["open"]) > 0, F.concat(a["out"], F.array(a["no"]))).otherwise(a["out"])
        return F.struct((a["no"] + 1).alias("no"), F.aggregate(found, a["s"], brace).alias("s"), out.alias("out"))

    def block(a: Column, lines: Column) -> Column:
        done = F.aggregate(lines, F.struct(a["no"].alias("no"), a["s"].alias("s"), ints.alias("out")), line)
        return _bind(done, lambda r: F.struct(r["no"].alias("no"), r["s"].alias("s"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))

    def fold(found: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(found), F.lit(BLOCK))
        start = F.struct(F.lit(1).alias("no"), F.struct(F.lit(0).alias("depth"), ints.alias("open")).alias("s"), F.array().cast("array<array<int>>").alias("outs"))
        return F.aggregate(F.transform(firsts, lambda i: F.slice(found, i, BLOCK)), start, block, lambda a: F.flatten(a["outs"]))

    return _bind(F.transform(tx.split_lines(content), tokens), fold)


def in_try_block(files: DataFrame) -> DataFrame:
    """(repo_id, path, line) of every line inside an open try block."""
    return files.filter(F.col("content").contains("try")).select("repo_id", "path", F.explode(try_lines(F.col("content"))).alias("line"))


# --- review scan ---------------------------------------------------------------------------

def _review_guard() -> dict[str, Column]:
    c = F.col("content")
    return {"no-error-handling": F.when(c.contains("try") & c.contains("await"), try_lines(c)).otherwise(F.array().cast("array<int>"))}


def review_scan(files: DataFrame) -> DataFrame:
    """Review rules over whole files; per (path, rule, line) the most confident finding stays.

    ``no-error-handling`` findings inside an open try block are dropped, in the row of the file.
    """
    return best_per_line(match_files(files, rt.REVIEW_RULES, guarded=_review_guard()))


def review_lines(files: DataFrame) -> DataFrame:
    """``review_scan`` without the texts of the matches and the rules' numbers."""
    return best_rule_per_line(match_places(files, rt.REVIEW_RULES, guarded=_review_guard()), rt.REVIEW_RULES)


def best_per_line(findings: DataFrame) -> DataFrame:
    """Highest confidence per (repo, path, rule, line); the earlier rule wins ties."""
    rest = [c for c in findings.columns if c not in ("repo_id", "path", "rule", "line")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col("ordinal")))
    return findings.groupBy("repo_id", "path", "rule", "line").agg(best.alias("b")).select(
        "repo_id", "path", "line", "rule", "b.*"
    )


def _named(places: DataFrame, keys: list[tuple], name: str) -> DataFrame:
    """Places with their rule's number in the distinct ``keys`` (one key a rule) as ``name``."""
    of = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    return places.withColumn(name, F.element_at(F.lit([of[k] for k in keys]), F.col("ordinal") + 1))


def _looked_up(values: Sequence, at: str) -> Column:
    return F.element_at(F.lit(list(values)), F.col(at) + 1)


def best_rule_per_line(places: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``best_per_line`` of places: (repo_id, path, line, rule, category, severity, confidence).

    Which of two rules is better is known before, so numbers alone are shuffled and the greatest stays.
    """
    order = sorted(range(len(rules)), key=lambda i: (rules[i].confidence, -i))
    rank = {i: n for n, i in enumerate(order)}
    names = list(dict.fromkeys(r.name for r in rules))
    numbered = _named(places, [r.name for r in rules], "_name").withColumn("_rank", F.element_at(F.lit([rank[i] for i in range(len(rules))]), F.col("ordinal") + 1))
    best = numbered.groupBy("repo_id", "path", "_name", "line").agg(F.max("_rank").alias("_rank"))
    facts = [_looked_up([f(rules[i]) for i in order], "_rank").alias(c) for c, f in (("category", lambda r: r.category), ("severity", lambda r: r.severity), ("confidence", lambda r: float(r.confidence)))]
    return best.select("repo_id", "path", "line", _looked_up(names, "_name").alias("rule"), *facts)


def matches_per_line(places: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """How often each rule and severity matches on a line: (repo_id, path, rule, severity, line, n)."""
    keys = [(r.name, r.severity) for r in rules]
    distinct = list(dict.fromkeys(keys))
    n = _named(places, keys, "_rule").groupBy("repo_id", "path", "_rule", "line").agg(F.count("*").alias("n"))
    return n.select("repo_id", "path", _looked_up([a for a, _ in distinct], "_rule").alias("rule"), _looked_up([b for _, b in distinct], "_rule").alias("severity"), "line", "n")


def min_confidence(findings: DataFrame, threshold: float) -> DataFrame:
    return findings.filter(F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold)


# --- secrets ---------------------------------------------------------------------------------

def secret_scan(files: DataFrame) -> DataFrame:
    """Every secret-like match per line, except those that mention test or example."""
    rules = rt.SECRET_RULES
    src = files.filter(_needle_filter(rules, F.col("content")))
    ln = lines(src).filter(_needle_filter(rules, F.col("text")))
    per_rule = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), tx.rx_all("text", r.pattern).alias("m"))
            for r in rules
        ]
    )
    hits = F.explode(F.filter(per_rule, lambda p: F.size(p["m"]) > 0))
    out = ln.select("repo_id", "path", "line", hits.alias("p"))
    out = out.select("repo_id", "path", "line", "p.rule", "p.severity", F.explode("p.m").alias("matched"))
    for w in rt.SECRET_SKIP_WORDS:
        out = out.filter(~F.col("matched").contains(w))
    return out


def hardcoded_secret_files(files: DataFrame) -> DataFrame:
    """Files with a quoted literal assigned to a credential-like name (no budget)."""
    return (
        files.filter(~F.col("path").rlike(rt.SECRET_SKIP_EXT) & ~F.col("path").rlike(rt.SECRET_SKIP_PATH))
        .filter(~F.col("path").contains(".env") | F.col("path").contains(".env.example"))
        .filter(tx.rx("content", rt.HARDCODED_SECRET))
        .select("repo_id", "path")
    )


def hardcoded_secret(files: DataFrame, budget: int | None = None) -> DataFrame:
    """Per repository: does any file hold a hard-coded credential?

    With a ``budget``, only files that end within the first ``budget`` characters of the repository, in path order,
    count.  Lengths are summed per range of paths first and carried from range to range, so only ranges
    that start inside the budget are ordered file by file, and no repository is one task.
    """
    flags = (
        files.filter(~F.col("path").rlike(rt.SECRET_SKIP_EXT) & ~F.col("path").rlike(rt.SECRET_SKIP_PATH))
        .filter(~F.col("path").contains(".env") | F.col("path").contains(".env.example"))
        .select("repo_id", "path", F.length("content").cast("long").alias("n"), tx.rx("content", rt.HARDCODED_SECRET).alias("hit"))
    )
    if budget is not None:
        from siltscope.operators.ordered import prefix_sum

        flags = prefix_sum(flags, keys=["repo_id"], chunk=None, order="path", value="n", out="cum", stop_after=budget).filter(F.col("cum") <= budget)
    found = flags.groupBy("repo_id").agg(F.max("hit").alias("hit"))
    return (
        files.select("repo_id").distinct()
        .join(found, "repo_id", "left")
        .select("repo_id", F.coalesce("hit", F.lit(False)).alias("hardcoded_secret"))
    )


# --- prompt injection --------------------------------------------------------------------------

def injection_scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds is_injection, confidence (25 per pattern, at most 100) and the matched pattern names."""
    names = F.array_compact(F.array(*[F.when(tx.rx(text_col, r.pattern), F.lit(r.name)) for r in rt.INJECTION_RULES]))
    return (
        df.withColumn("patterns", names)
        .withColumn("is_injection", F.size("patterns") > 0)
        .withColumn("confidence", F.least(F.lit(100), F.size("patterns") * 25))
    )


# --- anchored URL checks -----------------------------------------------------------------------

def hardcoded_urls(files: DataFrame) -> DataFrame:
    """Anchored hits of the URL, port and localhost rules."""
    return match_lines(files, rt.URL_RULES)


def repeated_hardcoded_urls(files: DataFrame, minimum: int = rt.URL_REPEAT_MIN) -> DataFrame:
    """Labels hit on more than ``minimum`` lines of a repository, each costing five points."""
    return (
        hardcoded_urls(files).groupBy("repo_id", F.col("rule").alias("label")).agg(F.count("*").alias("hits"))
        .filter(F.col("hits") > minimum)
        .withColumn("deduction", F.lit(5))
    )
