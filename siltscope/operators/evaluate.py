"""Predictions against ground truth: matching, scoring, threshold sweeps, calibration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators.ordered import keep_in_order
from siltscope.operators.rounds import WALK, assign, first_apart, many_rows

# fixed values
WEIGHTS = {"type": 0.6, "line": 0.3, "description": 0.1}
THRESHOLDS = (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)


def match_score(weights: dict = WEIGHTS, tolerance: int = 2) -> Column:
    """Score of a (truth, prediction) pair with the columns of _features() as t_* and p_*.

    Type: equal 1, one a dash-prefix of the other 0.7, half of the smaller word set shared 0.4, a first
    word found in the other 0.2.  Line: falls off linearly within the tolerance; both zero counts full.
    Description: Jaccard similarity of the words.
    """
    a, b, wa, wb = F.col("p_canon"), F.col("t_canon"), F.col("p_words"), F.col("t_words")
    overlap = F.size(F.array_intersect(wa, wb))
    small = F.least(F.size(wa), F.size(wb))
    prefix = a.startswith(F.concat(b, F.lit("-"))) | b.startswith(F.concat(a, F.lit("-")))
    first = F.array_contains(wb, F.get(wa, F.lit(0))) | F.array_contains(wa, F.get(wb, F.lit(0)))
    typ = F.when(a == b, 1.0).when(prefix, 0.7).when(overlap / small >= 0.5, 0.4).when(first, 0.2).otherwise(0.0)
    typ = F.when((F.coalesce("p_type", F.lit("")) == "") | (F.coalesce("t_type", F.lit("")) == ""), 0.0).otherwise(typ)
    pl, tl = F.coalesce("p_line", F.lit(0)), F.coalesce("t_line", F.lit(0))
    dist = F.abs(pl - tl)
    line = F.when((pl > 0) & (tl > 0), F.when(dist <= tolerance, 1 - dist / (tolerance + 1)).otherwise(0.0)).when((pl == 0) & (tl == 0), 1.0).otherwise(0.0)
    desc = tx.jaccard(F.col("t_tokens"), F.col("p_tokens"))
    return typ * weights["type"] + line * weights["line"] + desc * weights["description"]


def greedy_match(pairs: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """One-to-one assignment: truths in order take their best unused prediction.

    pairs(keys..., truth_no, pred_no, score).  Decided in rounds of proposals, so a task with a third of all findings is spread over
    all tasks of the job.
    """
    slim = pairs.select(*keys, "truth_no", "pred_no", "score")
    return assign(slim, keys, "truth_no", "pred_no", F.struct((-F.col("score")).alias("s"), F.col("pred_no").alias("p")))


def _features(df: DataFrame, p: str, number: str) -> DataFrame:
    """What the score compares, computed once per row and not per pair."""
    canon = tx.canonical_type("type")
    return df.select(
        "task_id", number, F.col("type").alias(f"{p}_type"), F.col("line").alias(f"{p}_line"), canon.alias(f"{p}_canon"),
        F.array_distinct(F.split(canon, "-")).alias(f"{p}_words"), F.array_distinct(tx.tokens("description")).alias(f"{p}_tokens"),
    )


def _sides(pred: DataFrame, truth: DataFrame, related: bool) -> DataFrame:
    """Pairs to score: all of a task, or those whose types share a word, each met at the first word they share."""
    t, p = _features(truth, "t", "truth_no"), _features(pred, "p", "pred_no")
    if not related:
        return t.join(p, "task_id")
    posted = t.select("*", F.explode("t_words").alias("_w")).join(p.select("*", F.explode("p_words").alias("_w")), ["task_id", "_w"])
    return posted.filter(F.col("_w") == F.array_min(F.array_intersect("t_words", "p_words"))).drop("_w")


def match_findings(pred: DataFrame, truth: DataFrame, weights: dict = WEIGHTS, tolerance: int = 2, minimum: float = 0.5) -> DataFrame:
    """Pairs of truth_no and pred_no whose score reaches ``minimum``, assigned one to one.

    Line and description alone reach their weights at most.  Where ``minimum`` is beyond that, as by default, a pair needs a type
    score, types that score share a word, and pairs come from postings of (task, word) instead of all pairs of a task.
    """
    related = minimum > weights["line"] + weights["description"] + 1e-9
    pairs = _sides(pred, truth, related).withColumn("score", match_score(weights, tolerance)).filter(F.col("score") >= minimum)
    return greedy_match(pairs)


def match_simple(pred: DataFrame, truth: DataFrame, tolerance: int = 2, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Type equal or containing the truth's first word, line within the tolerance or truth line 0.

    A truth with a line meets predictions by equality on the few lines around it, so a task with many
    findings does not pair everything with everything.
    """
    extra = [k for k in keys if k != "task_id"]
    p = pred.select(*keys, "pred_no", F.col("type").alias("p_type"), F.col("line").alias("p_line"))
    t = truth.select("task_id", "truth_no", F.col("type").alias("t_type"), F.col("line").alias("t_line"))
    around = F.explode(F.sequence(F.col("t_line") - tolerance, F.col("t_line") + tolerance)).alias("p_line")
    placed = t.filter("t_line > 0").select("task_id", "truth_no", "t_type", around).filter("p_line > 0").join(p, ["task_id", "p_line"])
    # a truth without a line meets all predictions of the types that fit: types are paired first, then rows by equality
    kinds = t.filter("t_line = 0").select("task_id", "t_type").distinct().join(p.select("task_id", "p_type").distinct(), "task_id")
    typ = (F.col("p_type") == F.col("t_type")) | F.col("p_type").contains(F.element_at(F.split("t_type", "-"), 1))
    cols = ["task_id", *extra, "truth_no", "pred_no"]
    whole = t.filter("t_line = 0").join(kinds.filter(typ), ["task_id", "t_type"]).join(p, ["task_id", "p_type"])
    pairs = placed.filter(typ).select(*cols).unionByName(whole.select(*cols))
    return greedy_match(pairs.withColumn("score", F.lit(1.0)), keys=["task_id", *extra])


def outcomes(pred: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Long rows (task_id, kind tp/fp/fn, category, severity); a hit takes the truth's labels."""
    hit = matches.select("task_id", "truth_no", F.lit(True).alias("_hit"))
    t = truth.join(hit, ["task_id", "truth_no"], "left").select("task_id", F.when(F.col("_hit"), "tp").otherwise("fn").alias("kind"), "category", "severity")
    fp = pred.join(matches.select("task_id", "pred_no"), ["task_id", "pred_no"], "left_anti")
    return t.unionByName(fp.select("task_id", F.lit("fp").alias("kind"), "category", "severity"))


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; empty denominators give 0."""
    c = F.col
    p = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0)
    r = F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(0.0)
    out = df.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0))


def score_outcomes(rows: DataFrame) -> DataFrame:
    """Counts and rates overall, per category and per severity (grouping sets)."""
    n = [F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("tp", "fp", "fn")]
    g = rows.groupingSets([[], ["category"], ["severity"]], "category", "severity").agg(*n, F.grouping_id().alias("_g"))
    scope = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "category").otherwise("severity")
    out = g.select(scope.alias("scope"), F.coalesce("category", "severity").alias("label"), "tp", "fp", "fn")
    return rates(out).withColumn("support", F.col("tp") + F.col("fn"))


def threshold_sweep(pred: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Counts and rates at each confidence threshold; the best row is marked.

    The prediction rows are copied to the thresholds they pass (at most nine) by an explode.
    """
    ths = F.array(*[F.lit(float(t)) for t in thresholds])
    passing = F.filter(ths, lambda t: F.col("confidence") >= t)
    p = pred.withColumn("threshold", F.explode(passing))
    m = match_simple(p, truth, keys=("task_id", "threshold"))
    found = m.groupBy("threshold").agg(F.count("*").alias("tp"))
    made = p.groupBy("threshold").agg(F.count("*").alias("made"))
    total = truth.select(F.explode(ths).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("truths"))
    grid = pred.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    j = grid.join(made, "threshold", "left").join(found, "threshold", "left").join(total, "threshold", "left").na.fill(0)
    out = rates(j.select("threshold", "tp", (F.col("made") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn")))
    best = F.row_number().over(W.orderBy(F.desc("f1"), F.desc("precision"), F.desc("threshold")))  # a row a threshold
    return out.withColumn("is_best", best == 1)


def calibrate(measure: Callable[[DataFrame], DataFrame], calibration: DataFrame) -> DataFrame:
    """calibration(id, kind, lo, hi, ...) measured by ``measure(df) -> (id, actual)``; adds ``in_range``."""
    got = measure(calibration)
    return calibration.join(got, "id", "left").withColumn(
        "in_range", F.coalesce(F.col("actual").between(F.col("lo"), F.col("hi")), F.lit(False))
    )


def calibration_accuracy(calibrated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return calibrated.groupBy(*by).agg(
        F.count("*").alias("entries"), F.sum(F.col("in_range").cast("long")).alias("correct"), F.avg(F.col("in_range").cast("int")).alias("accuracy")
    )


# --- near duplicates ---------------------------------------------------------------------------

def dedupe_near(findings: DataFrame, keys: Sequence[str] = ("repo_id", "path"), walk: int = WALK, counted: DataFrame | None = None) -> DataFrame:
    """Greedy near-duplicate removal inside a file, the most confident finding first.

    Two findings are near when they share a type word and lie within two lines of each other; if
    either has no line, when they have the same category.  What is kept decides what is dropped, so
    the walk is sequential in a file.  Files of at most ``walk`` findings are walked, each within one task, after one shuffle; a
    larger file is decided in rounds that are spread over all tasks (``rounds.first_apart``).  ``counted`` may give rows that hold
    the findings and are cheaper to count.
    """
    keys = list(keys)
    rest = [c for c in findings.columns if c not in (*keys, "rule", "category", "line", "confidence", "ordinal")]
    # the first of exact repeats is the best of them, and whatever drops it drops the others
    order = [F.desc("confidence"), F.asc_nulls_last("ordinal"), F.asc("line"), F.asc("rule"), F.asc("category"), *[F.desc(c) for c in rest]]

    def decide(state, rule, category, line) -> bool:
        at_line, whole, in_category, untyped = state
        line = max(line or 0, 0)
        if rule is None:  # shares no word with any
            new = (category, line) not in untyped
            untyped.add((category, line))
            return new
        words = rule.split("-")
        if line > 0:
            near = [at_line[at] for at in range(line - 2, line + 3) if at in at_line]
            if category in whole:
                near.append(whole[category])
        else:
            near = [in_category[category]] if category in in_category else []
        if any(not seen.isdisjoint(words) for seen in near):
            return False
        if line > 0:
            at_line.setdefault(line, set()).update(words)
        else:
            whole.setdefault(category, set()).update(words)
        in_category.setdefault(category, set()).update(words)
        return True

    def walked(df: DataFrame) -> DataFrame:
        return keep_in_order(df, keys, order, ["rule", "category", "line"], lambda: ({}, {}, {}, set()), decide)

    large = many_rows(findings if counted is None else counted, keys, walk)
    if large is None:
        return walked(findings)
    same = F.lit(True)
    for k in keys:
        same = same & findings[k].eqNullSafe(large[k])
    kept, undecided = _apart(findings.join(F.broadcast(large), same, "left_semi"), keys)
    # what rounds leave is little, or one long chain: nothing kept so far is near it, so it is walked by itself
    return kept.unionByName(walked(undecided)).unionByName(walked(findings.join(F.broadcast(large), same, "left_anti")))


def _apart(findings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, undecided) findings of large files; exact repeats are reduced to their best row first, map-side."""
    rest = [c for c in findings.columns if c not in (*keys, "rule", "category", "line")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col("ordinal"), *[c for c in rest if c not in ("confidence", "ordinal")]))
    slim = findings.groupBy(*keys, "rule", "category", "line").agg(best.alias("b")).select(*keys, "rule", "category", "line", "b.*")
    slim = slim.select(*findings.columns)

    # marks: a word at a line, a word of a category, a word of a category without a line
    line, words = F.greatest(F.coalesce("line", F.lit(0)), F.lit(0)).cast("long"), F.array_distinct(F.split("rule", "-"))
    around = F.filter(F.sequence(line - 2, line + 2), lambda at: at > 0)
    of = lambda kind, w: F.concat_ws("\u0001", F.lit(kind), w, F.coalesce("category", F.lit("\u0002")))
    at_line = lambda at, w: F.concat_ws("\u0001", F.lit("line"), w, at.cast("string"))
    in_category = F.transform(words, lambda w: of("any", w))
    covers = F.when(line > 0, F.concat(F.flatten(F.transform(words, lambda w: F.transform(around, lambda at: at_line(at, w)))), in_category)).otherwise(
        F.concat(F.transform(words, lambda w: of("whole", w)), in_category)
    )
    checks = F.when(line > 0, F.concat(F.transform(words, lambda w: at_line(line, w)), F.transform(words, lambda w: of("whole", w)))).otherwise(in_category)
    order = F.struct(
        F.col("confidence").isNull().alias("n"), (-F.col("confidence")).alias("c"), F.col("ordinal").isNull().alias("m"), F.col("ordinal").alias("o"),
        F.col("line").alias("l"), F.col("rule").alias("r"), F.col("category").alias("k"),
    )
    return first_apart(slim, keys, order, covers, checks)


def verify_findings(findings: DataFrame, max_per_type: int = 1, cap_first: bool = True) -> DataFrame:
    """Cap and near-dedupe in either order (the gate caps first, the evaluation dedupes first)."""
    from siltscope.operators.findings import cap_findings

    if cap_first:
        return dedupe_near(cap_findings(findings, max_per_type), counted=findings)
    return cap_findings(dedupe_near(findings), max_per_type)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, nm.js_round(F.col(c), digits))
    return df
