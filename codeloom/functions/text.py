"""Column expressions over paths, names and lines; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeloom.functions import vocab


def lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a dot file without another dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def is_test_path(path: Column) -> Column:
    return path.rlike(vocab.TEST_PATH)


def language(path: Column) -> Column:
    return F.coalesce(lookup(vocab.LANGUAGE_BY_EXT, extension(path)), F.lit("unknown"))


def language_domain(path: Column) -> Column:
    """Domain of a code file, null for anything else."""
    return lookup(vocab.DOMAIN_BY_EXT, extension(path))


def module_key(path: Column) -> Column:
    """Segment after the first `src`, else the first directory, else the path."""
    parts = F.split(path, "/")
    after_src = F.try_element_at(parts, F.array_position(parts, "src").cast("int") + 1)
    return F.coalesce(
        F.when(F.array_position(parts, "src") > 0, after_src),
        F.when(F.size(parts) > 1, parts[0]),
        path,
    )


def package_name(spec: Column) -> Column:
    """Package of an import specifier; null for relative and absolute ones."""
    nested = F.regexp_extract(spec, r"node_modules/((?:@[^/]+/)?[^/]+)", 1)
    return (
        F.when(nested != "", nested)
        .when(spec.startswith(".") | spec.startswith("/"), F.lit(None).cast("string"))
        .when(spec.startswith("@"), F.substring_index(spec, "/", 2))
        .otherwise(F.substring_index(spec, "/", 1))
    )


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def camel(name: Column) -> Column:
    """snake_case to camelCase: only an underscore before a lower-case letter or digit folds."""
    parts = F.split(F.regexp_replace(name, r"_([a-z0-9])", "\u0001$1"), "\u0001")
    tail = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2))))
    return F.concat(parts[0], F.array_join(tail, ""))


def heading_slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(F.trim(kept), r"\s+", "-")


def normalized_term(term: Column) -> Column:
    return F.lower(F.regexp_replace(term, "[^A-Za-z0-9]", ""))


def is_comment_line(line: Column, path: Column) -> Column:
    """Blank or plain comment line, judged by the extension of its file."""
    t = F.trim(line)
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return (
        (t == "") | t.startswith("//") | t.startswith("/*") | t.startswith("*")
        | (ext.isin(*vocab.MARKUP_COMMENT_EXTS) & t.startswith("<!--"))
        | (ext.isin(*vocab.HASH_COMMENT_EXTS) & t.startswith("#"))
        | (ext.isin(*vocab.DASH_COMMENT_EXTS) & t.startswith("--"))
    )


def is_plain_comment(line: Column) -> Column:
    """Comment by prefix alone, whatever the language."""
    return line.rlike(r"^\s*(?://|\*|/\*|#)")


def redact(text: Column, limit: int = 240) -> Column:
    hidden = F.regexp_replace(text, r"[A-Za-z0-9+/=_-]{40,}", "[REDACTED]")
    return F.rtrim(F.substring(hidden, 1, limit))


def one_line(text: Column) -> Column:
    """Literal escapes and runs of white space become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\\[nrt]", " "), r"\s+", " "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comment_body(line: Column) -> Column:
    """Text of a comment line, null for other lines."""
    t = F.trim(line)
    rest = lambda n: t.substr(F.lit(n), F.length(t))
    return (
        F.when(t.startswith("#!"), F.lit(None).cast("string"))
        .when(t.startswith("#"), rest(2))
        .when(t.startswith("//"), rest(3))
        .when(t.startswith("/*"), F.regexp_replace(F.regexp_replace(t, r"^/\*\*?", ""), r"\*/$", ""))
        .when(t.startswith("*"), F.regexp_replace(F.regexp_replace(t, r"^\* ?", ""), r"\*/$", ""))
    )


def clean_comment(text: Column) -> Column:
    for pattern in (r"^/\*\*?", r"\*/$", r"^\s*//+", r"^\s*\*? ?", r"^\s*#+ ?"):
        text = F.regexp_replace(text, pattern, "")
    return squeeze(text)


def literal_shape(expr: Column) -> Column:
    """Conservative type of a literal argument, null when it is not one."""
    e = F.trim(expr)
    return (
        F.when(e == "", F.lit(None).cast("string"))
        .when(e.rlike(r"^'(?:[^'\\]|\\.)*'$") | e.rlike(r'^"(?:[^"\\]|\\.)*"$') | e.rlike(r"^`[^`]*`$"), "string")
        .when(e.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?n?$"), "number")
        .when(e.isin("true", "false"), "boolean")
        .when(e == "null", "null")
        .when(e == "undefined", "undefined")
        .when(e.startswith("[") & e.endswith("]"), "array literal")
        .when(e.startswith("{") & e.endswith("}"), "object literal")
    )


def normalized_subject(subject: Column) -> Column:
    """Commit subject without conventional prefix and issue references."""
    s = F.regexp_replace(
        subject,
        r"(?i)^(?:revert: )?(?:feat|fix|refactor|docs|doc|test|tests|chore|style|perf|build|ci|release|wip)(?:\([^)]*\))?!?:\s*",
        "",
    )
    s = F.regexp_replace(s, r"\s*\(#[A-Za-z0-9_-]+\)\s*$", "")
    return F.lower(F.trim(F.regexp_replace(s, r"\s*#[A-Za-z0-9_/-]+\s*$", "")))


def commit_anchor(commit_hash: Column, date: Column) -> Column:
    return F.concat(F.lit("commit:"), F.substring(commit_hash, 1, 8), F.lit(" ("), date.cast("string"), F.lit(")"))


def table_cells(line: Column) -> Column:
    """Trimmed cells of a Markdown table row."""
    body = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(body, r"\|"), lambda c: F.trim(c))



def ascii_edges(pattern: str) -> str:
    """A pattern whose `\\b` means the edge of an ASCII word, as it does outside Java."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)
