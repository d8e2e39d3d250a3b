"""DuckDB renderings of rule tables, used by the oracle queries only."""

from __future__ import annotations

from collections.abc import Sequence

from siltscope.functions import text as tx
from siltscope.plans.registry import lit
from siltscope.rules.model import Rule

TRIM_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def trim(expr: str) -> str:
    return f"trim({expr}, {TRIM_CHARS})"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(tx.re2(pattern))})"


def count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {lit(tx.re2(pattern))})) AS INTEGER)"


def contains(expr: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(n)})" for n in needles) + ")"


def condition(r: Rule, text: str = "text", path: str = "path") -> str:
    t = trim(text) if r.trimmed else text
    parts = [matches(t, r.pattern)]
    parts += [matches(t, p) for p in r.also]
    parts += [f"NOT {matches(t, p)}" for p in r.unless]
    if r.unless_text:
        parts.append(f"NOT {contains(text, *r.unless_text)}")
    if r.last_tail:
        tail = f"regexp_extract({t}, {lit(tx.re2('^.*' + r.pattern + '(.*)$'))}, 1)"
        parts.append(f"NOT {matches(tail, r.last_tail)}")
    if r.path_unless:
        parts.append(f"NOT {contains(path, *r.path_unless)}")
    return " AND ".join(parts)


_NEVER = r"(?:\x00never\x00)"

#: look-aheads, which the oracle's engine lacks: (pattern without it that also eats what it forbids, what such a match looks like)
_AHEAD = {
    "code-injection": (r"""\bnew\s+Function\s*\(\s*(?:['"][^'"]*['"]\s*(?:,\s*)?)*\s*\)|\bnew\s+Function\s*\(""", r"\)$"),
    "insecure-random": (r"(?im)^(?:.*\b(?:token|secret|session|nonce|key)\b.*\b(?:Math\.random|random\.random|random\.randint)\s*\(\s*\)"
                        r"|.*\b(?:Math\.random|random\.random|random\.randint)\s*\(\s*\).*\b(?:token|secret|session|nonce|key)\b)", _NEVER),
    "no-error-handling/medium": (r"export\s+async\s+function\s+\w+\s*\([^)]*\)\s*:\s*Promise<[^>]+>\s*\{\s*(?:try|throw|if\s*\(!\w)"
                                 r"|export\s+async\s+function\s+\w+\s*\([^)]*\)\s*:\s*Promise<[^>]+>\s*\{[\s\S]*?await\s+", r"\{\s*(?:try|throw|if\s*\(!\w)$"),
    "no-error-handling/high": (r"\bawait[^\S\n]+.*\btry\b|\bawait\s+", r"\btry$"),
}


def file_hits(rules: Sequence[Rule], source: str) -> str:
    """SELECT of one row per match of a rule in a whole file, with the line that it starts on."""
    lines = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
    parts = []
    for i, r in enumerate(rules):
        pattern, forbidden = re2_file(r)
        rx = lit(pattern)
        parts.append(f"""SELECT repo_id, path, {lit(r.name)} AS rule, {lit(r.category)} AS category, {lit(r.severity)} AS severity, CAST({float(r.confidence)} AS DOUBLE) AS confidence, {i} AS ordinal,
  CAST(1 + list_sum(list_transform(s[1:i], lambda x: {lines('x')})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {lines('x')})), 0) AS INTEGER) AS line
 FROM (SELECT repo_id, path, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT repo_id, path, regexp_extract_all(content, {rx}) AS m, string_split_regex(content, {rx}) AS s FROM {source} WHERE regexp_matches(content, {rx})))
 WHERE NOT regexp_matches(m[i], {lit(forbidden)})""")
    return "\n UNION ALL ".join(parts)


def re2_file(r: Rule) -> tuple[str, str]:
    key = f"{r.name}/{r.severity}" if r.name == "no-error-handling" else r.name if "(?!" in r.pattern or "(?=" in r.pattern else ""
    if key in _AHEAD:
        return _AHEAD[key]
    # counted repeats are limited to 1000 there
    return tx.re2(r.pattern).replace("{1500,}?", "{1000}[\\s\\S]{500}[\\s\\S]*?"), _NEVER


def line_hits(rules: Sequence[Rule], source: str, where: str = "TRUE", first: int = 0) -> str:
    """SELECT of one row per (line, rule) hit."""
    items = []
    for i, r in enumerate(rules):
        t = trim("text") if r.trimmed else "text"
        items.append(
            f"CASE WHEN {condition(r)} THEN {{'rule': {lit(r.name)}, 'category': {lit(r.category)}, 'severity': {lit(r.severity)}, "
            f"'confidence': CAST({float(r.confidence)} AS DOUBLE), 'detail': regexp_extract({t}, {lit(tx.re2(r.pattern))}), 'ordinal': {first + i}}} END"
        )
    body = ",\n    ".join(items)
    return f"""SELECT repo_id, path, line, h.rule AS rule, h.category AS category, h.severity AS severity,
       h.confidence AS confidence, h.detail AS detail, CAST(h.ordinal AS INTEGER) AS ordinal
FROM (SELECT repo_id, path, line, unnest(list_filter([
    {body}], lambda x: x IS NOT NULL)) AS h FROM {source} WHERE {where})"""
