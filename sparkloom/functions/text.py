"""Tokenizers and text predicates as Column expressions, each with its DuckDB form for checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the stop words of the code tokenizer
STOP = (
    "where is are the a an how does to do of for in on and or can i it this that what which with handled used before "
    "after from into was be as by def else if import int list return str"
).split()

# fixed values: what an identifier is and where its case changes
#: An identifier; a letter class instead of \w, which Java and RE2 read as ASCII.
IDENTIFIER = r"[A-Za-z_$][\p{L}\p{N}_$]*"
WORD_CHAR = r"[\p{L}\p{N}_$]"
#: An identifier of several parts; most words of prose are not, and are spared the splitting.
COMPOUND = r"[_$]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"


def code_tokens(text: Column, stop: list[str] | tuple[str, ...] = STOP) -> Column:
    """Tokens of code: identifiers split at case changes, _ and $, in lower case, without stop words; an identifier of
    several parts is also kept whole.  Repeats stay."""
    none = F.array().cast("array<string>")

    def one(word: Column) -> Column:
        whole = F.lower(word)
        plain = F.when(whole.isin(*stop) if stop else F.lit(False), none).otherwise(F.array(whole))
        return F.when(word.rlike(COMPOUND), several(word)).otherwise(plain)

    def several(word: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        parts = F.split(F.lower(spaced), r"[_$\s]+")
        stopped = lambda c: c.isin(*stop) if stop else F.lit(False)
        kept = F.filter(parts, lambda p: (p != "") & ~stopped(p))
        whole = F.lower(word)
        return F.when((F.size(parts) > 1) & ~stopped(whole), F.concat(kept, F.array(whole))).otherwise(kept)

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), 0), one))


def code_tokens_sql(text: str, stop: list[str] | tuple[str, ...] = STOP) -> str:
    """The same in DuckDB."""
    stops = "[" + ", ".join(f"'{s}'" for s in stop or ("",)) + "]"
    spaced = "regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    parts = f"string_split_regex(lower({spaced}), '[_$\\s]+')"
    return (
        f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '{IDENTIFIER}'), lambda w: "
        f"list_concat(list_filter({parts}, lambda p: p <> '' AND NOT list_contains({stops}, p)), "
        f"CASE WHEN len({parts}) > 1 AND NOT list_contains({stops}, lower(w)) THEN [lower(w)] ELSE [] END)))"
    )


def generic_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case, of two or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1)


def generic_tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: len(t) > 1)"


def name_terms(text: Column) -> Column:
    """Distinct terms of identifiers split at case changes and underscores (feature ranking)."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z_0-9]*"), 0)
    split = F.transform(names, lambda n: F.split(F.lower(F.regexp_replace(n, "([a-z0-9])([A-Z])", "$1_$2")), "_+"))
    return F.array_distinct(F.filter(F.flatten(split), lambda p: p != ""))


def name_terms_sql(text: str) -> str:
    return (
        f"list_distinct(list_filter(flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z_0-9]*'), "
        "lambda n: string_split_regex(lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_+'))), lambda p: p <> ''))"
    )


def strip(text: Column) -> Column:
    """Without white space at the ends, Unicode's included (trim() takes spaces only)."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def lines(text: Column) -> Column:
    """The lines of a text as Python's splitlines() cuts them."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def bounded(text: Column, name: str | Column, insensitive: bool = False) -> Column:
    """Whether a name stands in a text between characters that no identifier has."""
    name = F.lit(name) if isinstance(name, str) else name
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    flag = "(?i)" if insensitive else ""
    return F.regexp_like(text, F.concat(F.lit(f"{flag}(^|[^\\p{{L}}\\p{{N}}_$])"), quoted, F.lit(r"($|[^\p{L}\p{N}_$])")))


# fixed values: the ordered patterns of the question classifier
INTENTS = (
    ("VERSION", r"\b(version|commit|refactor|previous|changed)\b"),
    ("SEQUENCE", r"\b(before|after)\b"),
    ("PATH", r"\b(reach|path|connect|flow|trace)\b|how does"),
    ("USAGE", r"\b(used|usage|callers|calls|called)\b"),
    ("LOCATE", r"\b(where|find|locate)\b"),
)


def intent(query: Column) -> Column:
    """The first pattern that a question matches, else GENERAL."""
    out, low = None, F.lower(query)
    for name, pattern in INTENTS:
        cond = F.coalesce(low.rlike(pattern), F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("GENERAL")


def intent_sql(query: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({query}), '{p}') THEN '{n}'" for n, p in INTENTS)
    return f"CASE {whens} ELSE 'GENERAL' END"


# fixed values: words and phrases of a question, and what shows the same operator in code
QUERY_PATTERNS = {
    "xor": r"\b(?:xor|exclusive\s+or)\b",
    "gcd": r"\b(?:gcd|greatest\s+common\s+divisor)\b",
    "lcm": r"\b(?:lcm|least\s+common\s+multiple)\b",
    "modulo": r"\b(?:modulo|modulus|remainder)\b",
    "sort": r"\b(?:sort|sorted|sorting)\b",
    "binary_search": r"\bbinary\s+search\b",
    "factorial": r"\bfactorial\b",
    "prime": r"\bprime\s+numbers?\b|\bprimality\b",
    "palindrome": r"\bpalindrom(?:e|ic)\b",
}
CODE_PATTERNS = {
    "xor": r"\^|\bxor\b",
    "gcd": r"\bgcd\b|\b__gcd\b",
    "lcm": r"\blcm\b",
    "modulo": r"%|\bmod\b",
    "sort": r"\.sort\s*\(|\bsorted\s*\(|\bsort\s*\(",
    "binary_search": r"\bbisect\b|\blower_bound\b|\bupper_bound\b|\bbinary_search\b",
    "factorial": r"\bfactorial\b|\bfact\b",
    "prime": r"\b(?:prime|is_prime|isprime|sieve)\b",
    "palindrome": r"\bpalindrom\w*\b|\[\s*::\s*-1\s*\]",
}


def operator_evidence(query: Column, code: Column) -> Column:
    """Whether some operator is named in the question and shown in the code."""
    out = F.lit(False)
    for name, pattern in QUERY_PATTERNS.items():
        out = out | (query.rlike(f"(?i){pattern}") & code.rlike(f"(?i){CODE_PATTERNS[name]}"))
    return F.coalesce(out, F.lit(False))


def operator_evidence_sql(query: str, code: str) -> str:
    return "(" + " OR ".join(f"(regexp_matches({query}, '{p}', 'i') AND regexp_matches({code}, '{CODE_PATTERNS[n]}', 'i'))" for n, p in QUERY_PATTERNS.items()) + ")"


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)__tests__/") | path.rlike(r"\.(test|spec)\.[cm]?jsx?$")


# fixed values: folders that are never scanned and the extensions that are
EXCLUDED = ("node_modules", "dist", "build", "coverage", "vendor", ".next", ".cache", ".git", ".venv", "venv", "__pycache__")
EXTENSIONS = (".js", ".mjs", ".cjs", ".jsx")


def useful_path(path: Column) -> Column:
    """A source file that is scanned: in no excluded folder, of a known extension, not minified, bundled or a map."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    known = F.lit(False)
    for e in EXTENSIONS:
        known = known | base.endswith(e)
    bad = F.exists(parts, lambda p: p.isin(*EXCLUDED))
    return ~bad & known & ~base.rlike(r"^\.[^.]*$") & ~path.rlike(r"\.(min\.js|bundle\.js|map)$")


def safe_path(path: Column) -> Column:
    """Not empty, relative, with neither backslashes nor '..'."""
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~F.array_contains(F.split(path, "/"), "..")


def valid_key(key: Column) -> Column:
    return key.rlike("^[0-9a-f]{24}$")
