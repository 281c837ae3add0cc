"""Small helpers for writing the comparison SQL."""

import re

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
FOLD = "[À-ÖØ-öø-ÿ]"


def lit(text) -> str:
    if text is None:
        return "NULL"
    if isinstance(text, str):
        return "'" + text.replace("'", "''") + "'"
    return str(text)


def num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def inlist(column: str, items) -> str:
    return f"({column} IN ({', '.join(map(lit, items))}))" if items else "(false)"


def strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def _alternatives(pattern: str):
    depth, part, out = 0, "", []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            part += pattern[i:i + 2]
            i += 2
            continue
        depth += c == "("
        depth -= c == ")"
        if c == "|" and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
        i += 1
    return out + [part]


def matches(text: str, pattern: str | None) -> str:
    """Case-insensitive search; RE2 has no lookaround, so those rules are restated.

    ``A(?!.*B)`` holds on a line whose last A is not followed by B.
    """
    if pattern is None:
        return "(false)"
    pattern = pattern.replace(r"(?<!un)\bcomplicated", r"\bcomplicated")
    if r"(?<!not\s)" in pattern:
        text = f"regexp_replace({text}, '(not)\\s(recommend)', '\\1_\\2', 'gi')"
        pattern = pattern.replace(r"(?<!not\s)", "")
    plain, tests = [], []
    for alt in _alternatives(pattern):
        found = re.fullmatch(r"(.*)\(\?!\.\*(.*)\)", alt)
        if not found:
            plain.append(alt)
            continue
        a, b = found.groups()
        tests.append(
            f"len(list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, {lit(a)}, 'i') AND NOT "
            f"regexp_matches(regexp_extract(l, {lit('(?i).*' + a + '(.*)$')}, 1), {lit(b)}, 'i'))) > 0")
    if plain:
        tests.insert(0, f"regexp_matches({text}, {lit('|'.join(plain))}, 'i')")
    return "(" + " OR ".join(tests) + ")"


def with_(ctes, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final
