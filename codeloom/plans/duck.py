"""SQL fragments the oracles share."""

from __future__ import annotations

from codeloom.functions import vocab


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return "(" + ", ".join(quote(x) for x in items) + ")"


def ext(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/](\.[^./]*)$', 1))"


def case(expr: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items())
    return f"CASE {expr} {arms} END"


def language(path: str) -> str:
    return f"coalesce({case(ext(path), vocab.LANGUAGE_BY_EXT)}, 'unknown')"


def domain(path: str) -> str:
    return case(ext(path), vocab.DOMAIN_BY_EXT)


def is_test(path: str) -> str:
    return f"regexp_matches({path}, {quote(vocab.TEST_PATH)})"


def basename(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def stem(path: str) -> str:
    return rf"regexp_replace({basename(path)}, '\.[^.]+$', '')"


def rx(pattern: str) -> str:
    return quote(pattern)


def snake(name: str) -> str:
    return f"lower(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


def cells(line: str) -> str:
    return rf"list_transform(string_split(regexp_replace(trim({line}), '^\||\|$', '', 'g'), '|'), lambda x: trim(x))"


#: md_lines with fence state, as a sub-select.
MD = f"""(SELECT page, line_no, line, regexp_matches(line, '{vocab.FENCE}') AS is_fence,
 sum(CASE WHEN regexp_matches(line, '{vocab.FENCE}') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no) % 2 = 1 AS in_fence
 FROM md_lines)"""
#: md_lines outside fences.
OPEN_MD = f"(SELECT page, line_no, line FROM {MD} m WHERE NOT is_fence AND NOT in_fence)"



def comment(line: str, path: str) -> str:
    t = f"trim({line})"
    e = rf"lower(regexp_extract({path}, '\.([^.]*)$', 1))"
    return (
        f"({t} = '' OR starts_with({t}, '//') OR starts_with({t}, '/*') OR starts_with({t}, '*')"
        f" OR ({e} IN {values(vocab.MARKUP_COMMENT_EXTS)} AND starts_with({t}, '<!--'))"
        f" OR ({e} IN {values(vocab.HASH_COMMENT_EXTS)} AND starts_with({t}, '#'))"
        f" OR ({e} IN {values(vocab.DASH_COMMENT_EXTS)} AND starts_with({t}, '--')))"
    )


def plain_comment(line: str) -> str:
    return rf"regexp_matches({line}, '^\s*(?://|\*|/\*|#)')"


def package(spec: str) -> str:
    nested = f"regexp_extract({spec}, 'node_modules/((?:@[^/]+/)?[^/]+)', 1)"
    return (
        f"CASE WHEN {nested} <> '' THEN {nested} WHEN starts_with({spec}, '.') OR starts_with({spec}, '/') THEN NULL"
        f" WHEN starts_with({spec}, '@') THEN regexp_extract({spec}, '^([^/]*(?:/[^/]*)?)', 1)"
        f" ELSE regexp_extract({spec}, '^([^/]*)', 1) END"
    )


def subject(col: str) -> str:
    s = (
        f"regexp_replace({col}, '(?i)^(?:revert: )?(?:feat|fix|refactor|docs|doc|test|tests|chore|style|perf|build|ci|release|wip)"
        r"(?:\([^)]*\))?!?:\s*', '')"
    )
    s = rf"regexp_replace({s}, '\s*\(#[A-Za-z0-9_-]+\)\s*$', '')"
    return rf"lower(trim(regexp_replace({s}, '\s*#[A-Za-z0-9_/-]+\s*$', '')))"
