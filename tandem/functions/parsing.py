"""Reply and answer parsing as native column expressions (P1, P2, P3, P5; U1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------
CHOICES = ["A", "B", "C", "D"]
UNPARSED = "E"
DELETED_CHARS = '.",);'          # removed from the first word of a reply
# Python's str.strip() whitespace set (U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680,
# U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000), written for Java regex and RE2.
PY_WHITESPACE = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_choice(reply) -> Column:
    """The letter chosen in a reply, or 'E'.

    Take the text before the first space, delete . " , ) ; and strip Python whitespace;
    if that is not A-D keep the text before the first newline; if still not A-D -> 'E'.
    Case-sensitive; NULL -> 'E'.
    """
    first = F.substring_index(_col(reply), " ", 1)
    cleaned = F.translate(first, DELETED_CHARS, "")
    stripped = F.regexp_replace(cleaned, f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")
    line = F.substring_index(stripped, "\n", 1)
    return (F.when(stripped.isin(CHOICES), stripped)
            .when(line.isin(CHOICES), line)
            .otherwise(F.lit(UNPARSED)))


def parse_choice_sql(reply: str) -> str:
    """DuckDB text of :func:`parse_choice`."""
    stripped = (f"regexp_replace(translate(split_part({reply}, ' ', 1), '{DELETED_CHARS}', ''), "
                f"'^{PY_WHITESPACE}+|{PY_WHITESPACE}+$', '', 'g')")
    line = f"split_part({stripped}, chr(10), 1)"
    return (f"coalesce(case when {stripped} in ('A','B','C','D') then {stripped} "
            f"when {line} in ('A','B','C','D') then {line} end, 'E')")


def parse_correct(answer) -> Column:
    """Answer index 0..3 -> letter; any other value -> NULL (the row is rejected)."""
    a = _col(answer)
    return F.when((a >= 0) & (a <= 3), F.lit("".join(CHOICES)).substr(a + 1, F.lit(1)))


def subject_title(subject) -> Column:
    """Subject key -> title ('_' becomes a space)."""
    return F.translate(_col(subject), "_", " ")


def noise_label(seed, coupled_seed) -> Column:
    """P5: 'Coupled' for the shared run seed, else 'Independent' (seeds compare as strings)."""
    return F.when(_col(seed).cast("string") == F.lit(str(coupled_seed)), "Coupled").otherwise("Independent")
