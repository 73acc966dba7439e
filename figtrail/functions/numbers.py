"""Printed numbers as exact columns.

A printed value is cut into its figure, its currency mark and the shape of what stands around them; the shape is looked
up in a table. The number itself is kept three ways: the digits as printed
(``value_str``, whose decimal places are data), a DECIMAL(38,10) to compute with, and the printed scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrail.functions.text import BLANKS, literal_map, once, stripped

# Dash and word forms that mean "nil", and the currency marks a number may carry.
NIL_FORMS = ["-", "–", "—", "‐", "nil", "Nil", "NIL"]
CURRENCY_MARK = r"₹|Rs\.?|INR|US\$|USD|\$|€|EUR|£|GBP"
CURRENCY_CODE = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "us$": "USD", "usd": "USD", "$": "USD",
                 "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}

UNITS = {"%": "percent", "bps": "bps", "x": "multiple", "X": "multiple"}

# What may stand around a figure. A value is put into this shape (# its figure, ¤ its currency mark, - a minus of any width,
# no blanks where they may be) and looked up: brackets or a minus make it negative, a currency and a unit exclude each other.
SHAPES = {shape: "number" for shape in ("#", "-#", "¤#", "¤-#", "(#)", "¤(#)", "(¤#)")}
SHAPES |= {shape + unit: kind for unit, kind in UNITS.items() for shape in ("#", "-#", "(#)")} | {"(#%)": "percent"}
FIGURE = r"[0-9][0-9,]*(?:\.[0-9]+)?"

# The same as one pattern, for the yes or no alone: figures by grouping, and the shapes with the blanks they may hold.
BY_THOUSAND, BY_LAKH = "[0-9]{1,3}(?:,[0-9]{3})+", "[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3}"
_G, _M, _MINUS, _GAP, _UNIT = rf"(?:[0-9]+|{BY_THOUSAND}|{BY_LAKH})(?:\.[0-9]+)?", f"(?:{CURRENCY_MARK})", "[-−–]?", r"\s{0,2}", r"(?:\s?(?:%|bps|[xX]))"
NUMBER = rf"(?:{_MINUS}{_G}{_UNIT}?|{_M}{_GAP}{_MINUS}{_G}|\({_GAP}{_G}\){_UNIT}?|{_M}{_GAP}\({_GAP}{_G}\)|\({_GAP}{_M}{_GAP}{_G}\)|\({_GAP}{_G}\s?%\))"
NIL = "(?:" + "|".join(NIL_FORMS) + ")"

NUMBER_FIELDS = ("kind", "value", "value_str", "scale", "grouping", "currency_symbol", "negative")

def _mark(text: Column) -> Column:
    return F.regexp_extract(text, CURRENCY_MARK, 0)


def _figure(text: Column) -> Column:
    return F.regexp_extract(text, FIGURE, 0)


def _shape(text: Column, mark: Column, figure: Column) -> Column:
    around = F.replace(F.replace(text, figure, F.lit("#")), mark, F.lit("¤"))
    shape = F.regexp_replace(F.translate(around, "−–", "--"), r"(?<=[¤(])\s{1,2}|\s(?=[%bxX])", "")
    return F.when((figure != "") & (F.contains(shape, F.lit("¤")) == (mark != "")), shape)


def _grouping(figure: Column) -> Column:
    """Told by the lengths of the pieces between separators, looked at only where there is a separator."""
    by_thousand, by_lakh = figure.rlike(rf"^{BY_THOUSAND}(?:\.|\z)"), figure.rlike(rf"^{BY_LAKH}(?:\.|\z)")
    return F.when(~F.contains(figure, F.lit(",")), "none").when(by_lakh & by_thousand, "both").when(by_lakh, "indian").when(by_thousand, "international")


def with_number(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """All fields as columns; null when the text is not a number. Mark and figure, then shape and grouping, are steps of
    their own, so each is worked out once per row and the generated code stays small."""
    text, mark, figure, shape = (F.col(f"_nb_{x}") for x in ("text", "mark", "figure", "shape"))
    trimmed = stripped(F.col(col))
    staged = once(df, {"_nb_text": trimmed, "_nb_mark": _mark(trimmed), "_nb_figure": _figure(trimmed)})
    staged = once(staged, {"_nb_shape": _shape(text, mark, figure), "_nb_grouping": _grouping(figure)})
    plain = F.regexp_replace(F.replace(figure, F.lit(","), F.lit("")), "^0+([0-9])", "$1")
    minus = shape.rlike("[-(]")
    staged = once(staged, {"_nb_kind": F.when(F.col("_nb_grouping").isNotNull(), F.element_at(literal_map(SHAPES), shape)), "_nb_plain": plain, "_nb_minus": minus})
    ok, is_nil, minus = F.col("_nb_kind").isNotNull(), text.isin(NIL_FORMS), F.col("_nb_minus")
    signed = F.concat(F.when(minus, "-").otherwise(""), F.col("_nb_plain"))
    fields = {
        "kind": F.when(is_nil, "nil").otherwise(F.col("_nb_kind")),
        "value": F.when(ok, signed).try_cast("decimal(38,10)"),
        "value_str": F.when(ok, signed),
        "scale": F.when(ok, F.coalesce(F.length(F.get(F.split("_nb_plain", r"\."), 1)), F.lit(0))),
        "grouping": F.when(is_nil, "none").when(ok, F.col("_nb_grouping")),
        "currency_symbol": F.when(ok & (mark != ""), mark),
        "negative": F.when(is_nil, False).when(ok, minus),
    }
    return staged.withColumns({prefix + k: v for k, v in fields.items()}).drop(
        *["_nb_" + k for k in ("text", "mark", "figure", "shape", "grouping", "kind", "plain", "minus")])


def is_number(raw: Column) -> Column:
    """The yes or no of `with_number` alone, by one pattern: it reads a text once, where steps that build on one another
    are worked out anew at each use inside one expression."""
    return stripped(raw).rlike(rf"^(?:{NIL}|{NUMBER})\z")


def with_signature(df: DataFrame, col: str, out: str = "signature") -> DataFrame:
    """What two readings of one printed figure must share: sign, digits, decimals and unit."""
    staged = with_number(df, col, "_sg_")
    unit = (F.when(F.col("_sg_kind") == "percent", "%").when(F.col("_sg_kind") == "bps", "bps")
            .when(F.col("_sg_kind") == "multiple", "x").otherwise(""))
    signature = (F.when(F.col("_sg_kind").isNull(), F.regexp_replace(F.col(col), "[^0-9.]", ""))
                 .when(F.col("_sg_kind") == "nil", "nil").otherwise(F.concat("_sg_value_str", unit)))
    return staged.withColumn(out, signature).drop(*[f"_sg_{f}" for f in NUMBER_FIELDS])


def printed_decimals(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, r"\.([0-9]+)", 1))


NUMERIC_CELL = r"^[(\-−–]?[₹$€£]?[0-9][0-9,.\-–]*\)?\s?%?[*#^]?$"


def looks_like_cell_value(text: Column) -> Column:
    """Structural test for a table value; footnote marks and misread separators still count."""
    t = stripped(text)
    return t.rlike(rf"^(?:{NIL}|{NUMBER})(?:[{BLANKS}]*[*#^]+)?\z") | (t.rlike(NUMERIC_CELL) & t.rlike("[0-9][^0-9]*[0-9]"))


def garbled_number(raw: Column) -> Column:
    """Digits and separators that do not parse, other than a span of years."""
    span = stripped(raw).rlike(YEAR_SPAN)
    return ~span & raw.rlike(r"^[(\-−–]?[0-9][0-9,.\-–]*\)?%?$") & ~is_number(raw)


YEAR_SPAN = r"^(19|20)[0-9]{2}\s?[-–]\s?(((19|20)?[0-9]{2}))$"
