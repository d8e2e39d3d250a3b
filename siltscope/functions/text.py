"""Text and path columns.

JavaScript's ``\\b`` is an ASCII boundary; Java's is Unicode-aware.  ``word()`` spells the ASCII
boundary out with look-arounds so accented text gives the same answer, and ``re2()`` renders the
same rule for engines whose ``\\b`` is already ASCII.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers for the left and right edge of a word inside rule patterns.
BL = "@<@"
BR = "@>@"

BLANKS = " \t\r\n\f\x0b"


_LEFT = r"(?<![A-Za-z0-9_])"


def _alternatives(group: str) -> tuple[list[str], str] | None:
    """Alternatives of the ``(?:...)`` that ``group`` begins with, and what follows it."""
    out, depth, at, i = [], 0, 3, 0
    while i < len(group):
        c = group[i]
        if c == "\\":
            i += 1
        elif c == "[":
            return None  # parentheses in a class would count
        elif c == "(":
            depth += 1
        elif c == "|" and depth == 1:
            out.append(group[at:i])
            at = i + 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*out, group[at:i]], group[i + 1 :]
        i += 1
    return None


def _left_edge(rest: str) -> str:
    """Left word edge and what follows it, so that a search tests letters first and looks back only where they are found.

    A word is searched as a literal and what is before it is looked at afterwards; before a group of words come their first letters.
    """
    word = re.match(r"\w+", rest, re.ASCII)
    word = word[0] if word else ""
    if rest[len(word) : len(word) + 1] in tuple("?*+{"):
        word = word[:-1]
    if word:
        return f"{word}(?<![A-Za-z0-9_]{word}){rest[len(word):]}"
    if rest.startswith("(?:") and (found := _alternatives(rest)):
        words, after = found
        if after[:1] not in tuple("?*{") and all(re.match(r"\w(?![?*{])", w, re.ASCII) for w in words):
            return f"(?=[{''.join(sorted({w[0] for w in words}))}]){_LEFT}{rest}"
    return _LEFT + rest


def java(pattern: str) -> str:
    """Rule pattern -> Java regex with ASCII word edges."""
    first, *rest = pattern.replace(BR, r"(?![A-Za-z0-9_])").split(BL)
    out = ""
    for part in reversed(rest):
        out = _left_edge(part + out) if part or out else _LEFT
    return first + out


def re2(pattern: str) -> str:
    """Rule pattern -> regex for engines whose ``\\b`` is ASCII already."""
    return pattern.replace(BL, r"\b").replace(BR, r"\b")


def word(body: str) -> str:
    """A whole ASCII word (or group of words) as a rule pattern."""
    return f"{BL}{body}{BR}"


def rx(col: Column | str, pattern: str) -> Column:
    """``col`` matches the rule pattern anywhere."""
    return _c(col).rlike(java(pattern))


def rx_count(col: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(col), F.lit(java(pattern)))


def rx_all(col: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(java(pattern)), F.lit(group))


def has(col: Column | str, *needles: str) -> Column:
    """Any of the literal substrings occurs (byte search, no regex)."""
    out = None
    for n in needles:
        hit = _c(col).contains(n)
        out = hit if out is None else out | hit
    return out


def has_rarely(col: Column | str, *needles: str) -> Column:
    """``has`` for long texts in which most often none of the literals occurs: a literal of four characters is found by skipping, as a regex."""
    out = None
    for n in needles:
        hit = _c(col).rlike(rf"\Q{n}\E") if len(n) >= 4 else _c(col).contains(n)
        out = hit if out is None else out | hit
    return out


def strip(col: Column | str) -> Column:
    """Trim blanks, tabs and line ends; Spark's bare trim() removes U+0020 only."""
    return F.btrim(_c(col), F.lit(BLANKS))


def split_lines(content: Column | str) -> Column:
    """Lines of a text; a trailing newline yields a trailing empty line."""
    return F.split(_c(content), "\n", -1)


def line_count(content: Column | str) -> Column:
    """Number of lines without materialising them."""
    c = _c(content)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("int")


_B = r"[ \t\r\f\x0b]"


def lines_opening_with(content: Column | str, body: str) -> Column:
    """Number of lines whose first non-blank text matches ``body``; one regex pass, no line array."""
    return F.regexp_count(_c(content), F.lit(rf"(?dm)^{_B}*+(?:{body})"))


def blank_lines(content: Column | str) -> Column:
    """Number of blank lines.  Java's ^ does not match at the very end, so a trailing empty line is added."""
    c = _c(content)
    return F.regexp_count(c, F.lit(rf"(?dm)^{_B}*$")) + F.when(c.endswith("\n") | (c == ""), 1).otherwise(0)


def comment_lines(content: Column | str) -> Column:
    """Lines that start with // or *."""
    return lines_opening_with(content, r"//|\*|/\*\*")


def lines_containing(content: Column | str, body: str) -> Column:
    """Number of lines that contain a match of ``body``."""
    return F.regexp_count(_c(content), F.lit(rf"(?d)(?:{body})[^\n]*"))


# --- paths -----------------------------------------------------------------

def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def extension(path: Column | str) -> Column:
    """Extension of the base name with its dot, empty when there is none."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def strip_source_ext(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"\.(tsx|ts|jsx|js|mjs|cjs)$", "")


def is_test_path(path: Column | str) -> Column:
    return has(path, ".test.", ".spec.", "__tests__")


def ends_with_any(col: Column | str, *suffixes: str) -> Column:
    out = None
    for s in suffixes:
        hit = _c(col).endswith(s)
        out = hit if out is None else out | hit
    return out


def naming_convention(name: Column | str) -> Column:
    """Convention of a base name, separators first."""
    c = _c(name)
    return (
        F.when(c.contains("-"), "kebab-case")
        .when(c.contains("_"), "snake_case")
        .when(c.rlike("^[a-z]") & c.rlike("[A-Z]"), "camelCase")
        .when(c.rlike("^[A-Z]"), "PascalCase")
        .otherwise("other")
    )


def stem_convention(name: Column | str) -> Column:
    """Convention of a file stem by full match, first pattern wins."""
    c = _c(name)
    return (
        F.when(c.rlike("^[a-z]+(?:[A-Z][a-z0-9]*)*$"), "camelCase")
        .when(c.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"), "snake_case")
        .when(c.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "kebab-case")
        .when(c.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase")
        .otherwise("unknown")
    )


# --- tokens ----------------------------------------------------------------

def tokens(col: Column | str, min_len: int = 3) -> Column:
    """Lower-case alphanumeric words of at least ``min_len`` characters."""
    words = F.split(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9 ]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) >= min_len)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def tokens_overlap(a: Column | str, b: Column | str, sep: str = "-") -> Column:
    return F.arrays_overlap(F.split(_c(a), sep), F.split(_c(b), sep))


# fixed values: words that carry no meaning at the end of a finding type
TYPE_SUFFIXES = ("vulnerability", "issue", "error", "warning", "bug", "smell", "pattern", "antipattern")


def canonical_type(col: Column | str) -> Column:
    """Lower-case type slug without trailing noise words; the first word always stays."""
    suffix = "|".join(TYPE_SUFFIXES)
    cleaned = F.array_join(F.filter(F.split(F.lower(_c(col)), "-"), lambda p: p != ""), "-")
    return F.regexp_replace(cleaned, f"(?:-(?:{suffix}))+$", "")


def slug(col: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", "-"), "^-|-$", "")


def content_hash(col: Column | str) -> Column:
    return F.sha2(_c(col), 256)


def token_estimate(col: Column | str) -> Column:
    return F.ceil(F.length(_c(col)) / 4).cast("int")


def edit_distance(a: Column | str, b: Column | str, limit: int) -> Column:
    """Levenshtein distance, -1 beyond ``limit``."""
    return F.levenshtein(_c(a), _c(b), limit)


def json_field(col: Column | str, path: str, default=None) -> Column:
    got = F.get_json_object(_c(col), path)
    return got if default is None else F.coalesce(got, F.lit(default))


def repo_owner_name(url: Column | str) -> Column:
    """struct(owner, name) of a hosting URL; empty strings when it does not parse."""
    c = F.regexp_replace(_c(url), r"(?:\.git)?/?$", "")
    return F.struct(
        F.regexp_extract(c, r"^[a-z]+://[^/]+/([^/?#]+)/([^/?#]+)", 1).alias("owner"),
        F.regexp_extract(c, r"^[a-z]+://[^/]+/([^/?#]+)/([^/?#]+)", 2).alias("name"),
    )


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
