"""Column expressions for text, with the character rules of the rule packs.

Patterns run case-insensitively over Unicode text, ``.`` stops only at a line
feed, and trimming removes every Unicode blank rather than just the space.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters removed by trimming
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def java_regex(pattern: str, ignore_case: bool = True, extra: str = "") -> str:
    return f"(?{'i' if ignore_case else ''}Ud{extra}){pattern}"


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java_regex(pattern, ignore_case))


def replace(text: Column, pattern: str, by: str, ignore_case: bool = False, extra: str = "") -> Column:
    return F.regexp_replace(text, java_regex(pattern, ignore_case, extra), by)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column, chars: str = BLANKS) -> Column:
    return F.rtrim(text, F.lit(chars))


def lstrip(text: Column, chars: str) -> Column:
    return F.ltrim(text, F.lit(chars))


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def lines(text: Column) -> Column:
    """Lines of a text, split at every kind of line end."""
    return F.split(text, LINE_ENDS)


def quote(literal: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/&~#" else c for c in literal)


def starts_with_any(text: Column, prefixes) -> Column:
    return text.rlike("^(?:" + "|".join(quote(p) for p in prefixes) + ")")


def before(text: Column, mark: str) -> Column:
    """Text before the first ``mark``; the whole text if it is absent."""
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """Text after the first ``mark``; empty if it is absent."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise("")


def title_case(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    marked = F.regexp_replace(F.lower(text), r"(?<![\p{L}])(?=\p{L})", "\u0001")
    parts = F.split(marked, "\u0001")
    return F.concat(
        F.element_at(parts, 1),
        F.array_join(
            F.transform(
                F.slice(parts, F.lit(2), F.size(parts)),
                lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)),
            ),
            "",
        ),
    )


def all_groups(text: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex(pattern, ignore_case)), group)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row."""
    return F.transform(F.array(value), body)[0]
