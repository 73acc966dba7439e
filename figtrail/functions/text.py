"""Text helpers as column expressions. Everything here stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Columns that are worked out once per row. Written as a one-row ``inline``, because a plain projection would be
    merged into whatever uses it and a later filter would repeat it below; this one stays where it is."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))))


def plain_blanks(c: Column) -> Column:
    """No-break, figure and narrow no-break spaces, of which printed text is full, as blanks."""
    return F.translate(c, "\u00a0\u2007\u202f", "   ")


#: What a pattern calls white space.
BLANKS = " \t\n\x0b\f\r"


def stripped(c: Column) -> Column:
    return F.btrim(plain_blanks(c), F.lit(BLANKS))


def squeezed(c: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(plain_blanks(c), r"\s+", " "))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def core_of(c: Column) -> Column:
    """A printed token without the punctuation around it. A closing bracket stays while the token
    also opens one (a bracketed negative); an opening bracket stays while one closes."""
    tail = (F.when(F.contains(c, F.lit("(")), F.regexp_replace(c, r"[,;:.!?]+$", ""))
            .otherwise(F.regexp_replace(c, r"[,;:.!?)]+$", "")))
    return F.when(F.contains(tail, F.lit(")")), tail).otherwise(F.regexp_replace(tail, r"^\(+", ""))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def masked_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "#")


def letter_words(c: Column) -> Column:
    """Distinct lower-cased words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}{3,})"), F.lit(1)))


def literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first rule whose pattern is found, in rule order."""
    out = None
    for label, pattern in rules:
        out = F.when(c.rlike(pattern), F.lit(label)) if out is None else out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))
