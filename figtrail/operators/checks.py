"""Checks over figures (C1–C17). Each returns one row per finding; where a check also confirms figures, a second
function returns those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figtrail.functions.boxes import as_boxes, in_reading_order, words_in_boxes
from figtrail.functions.numbers import NIL_FORMS, NUMBER_FIELDS, YEAR_SPAN, printed_decimals, with_number
from figtrail.functions.ordered import carried_sum
from figtrail.functions.text import core_of, has_digit, letter_words, letters_only, once, stripped
from figtrail.operators.normalise import change_kind
from figtrail.session import cut

# The kinds and roles a figure may have.
REREAD_KINDS = ["number", "percent", "bps", "multiple", "nil", "date"]
FIGURE_KINDS = ["number", "percent", "bps", "multiple", "nil", "date", "period", "identifier"]
ROLES = ["text", "heading", "cell", "header", "caption", "row_label", "chart_label", "chart_axis"]
AUTO_CLEAR = 0.5


def active(figures: DataFrame) -> DataFrame:
    return figures.filter(F.coalesce("status", F.lit("active")) == "active")


# ------------------------------------------------------------------ C1, C2: found where it was read

def _found_at(figures: DataFrame, words: DataFrame, pad: float, text: Column) -> DataFrame:
    """Each figure with the texts at its box. A figure wrapped over lines brings one box per line in ``parts``."""
    whole = F.array(F.struct("x0", "y0", "x1", "y1"))
    boxes = figures.select("report_id", "page", "fid", F.explode(F.coalesce("parts", whole) if "parts" in figures.columns else whole).alias("p")).select(
        "report_id", "page", "fid", *[F.col(f"p.{c}").alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    hits = words_in_boxes(words, boxes, pad)
    # the same word can lie in two part boxes of one figure: counted once
    hits = hits.select("report_id", "page", "fid", F.bround(F.col("y0") / 4).alias("row"), "x0", text.alias("text")).distinct()
    per = hits.groupBy("report_id", "page", "fid").agg(in_reading_order(F.col("row"), F.col("x0"), F.col("text")).alias("found"))
    return figures.join(per, ["report_id", "page", "fid"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def _parts_in_order(raw: Column, found: Column) -> Column:
    """Every word of a wrapped figure is there, in reading order."""
    parts = F.split(raw, " ")
    last = F.aggregate(found, F.lit(0), lambda i, w: F.when(core_of(w) == F.get(parts, i), i + 1).otherwise(i))
    return (F.size(parts) >= 2) & (last == F.size(parts))


def _trace(figures: DataFrame, words: DataFrame) -> DataFrame:
    seen = _found_at(active(figures).filter(~F.coalesce("edited", F.lit(False))), words, 1.5, F.col("text"))
    seen = seen.withColumn("actual", F.array_join("found", " "))
    return seen.withColumn("ok", F.contains("actual", "raw") | _parts_in_order(F.col("raw"), F.col("found")))


def check_traceability(figures: DataFrame, words: DataFrame) -> DataFrame:
    return _trace(figures, words).filter(~F.col("ok")).select(
        "report_id", "fid", "page", F.lit("traceability").alias("check_name"), F.lit("blocking").alias("severity"), F.col("raw").alias("expected"), "actual")


def confirmed_by_trace(figures: DataFrame, words: DataFrame) -> DataFrame:
    return _trace(figures, words).filter("ok").select("report_id", "fid")


def same_glyphs(c: Column) -> Column:
    """Hyphen variants are one hyphen; soft hyphens and control bytes are nothing."""
    return F.regexp_replace(F.translate(c, "‐‑‒­", "---"), r"[\x00-\x1f\x7f]", "")


def _second(figures: DataFrame, words2: DataFrame, pages: DataFrame) -> DataFrame:
    layered = pages.filter(F.col("method") == "text_layer").select("report_id", "page")
    figs = active(figures).filter(~F.coalesce("edited", F.lit(False))).join(layered, ["report_id", "page"], "left_semi")
    return (_found_at(figs, words2, 2.5, same_glyphs(F.col("text"))).withColumn("actual", F.array_join("found", " "))
            .withColumn("ok", F.contains("actual", same_glyphs(F.col("raw")))))


def check_second_reading(figures: DataFrame, words2: DataFrame, pages: DataFrame) -> DataFrame:
    return _second(figures, words2, pages).filter(~F.col("ok")).select(
        "report_id", "fid", "page", F.lit("second_parser").alias("check_name"), F.lit("blocking").alias("severity"), F.col("raw").alias("expected"), "actual")


def confirmed_by_second_reading(figures: DataFrame, words2: DataFrame, pages: DataFrame) -> DataFrame:
    return _second(figures, words2, pages).filter("ok").select("report_id", "fid")


# ------------------------------------------------------------------ C3: independent readings

def _digits(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^0-9.]", ""), r"^\.+|\.+$", "")


def judged_readings(figures: DataFrame, readings: DataFrame) -> DataFrame:
    """One row per reading: does it agree, does it show other digits."""
    figs = active(figures).filter(F.col("kind").isin(REREAD_KINDS)).select("report_id", "fid", "raw", "kind")
    df = figs.join(readings, ["report_id", "fid"])
    df = df.withColumns({
        "read": F.regexp_replace(stripped(F.col("reading")), "^[°\"'`]+|[°\"'`]+$", ""),
        "core": F.when(F.startswith("raw", F.lit("(")), F.col("raw")).otherwise(core_of(F.col("raw")))})
    df = with_number(df, "core", "r_")
    dotted = F.regexp_replace("read", r"(?<=[0-9])[-–](?=[0-9])", ".")
    base = F.when(F.contains("core", F.lit(".")), F.array("read", dotted)).otherwise(F.array("read"))
    # a currency glyph read as a digit or as junk: the number after it
    beyond = F.transform(base, lambda c: F.when(c.rlike("^[0-9(]."), F.substring(c, 2, 1000000)).otherwise(F.regexp_extract(c, r"^[^0-9(]+([0-9(].*)$", 1)))
    cands = F.when(F.col("r_currency_symbol").isNotNull(), F.concat(base, beyond)).otherwise(base)
    one = df.withColumn("cand", F.explode(F.array_distinct(cands))).withColumn("cand", F.regexp_replace("cand", "[ –-]+$", ""))
    one = with_number(one, "cand", "c_")
    both = F.col("r_kind").isNotNull() & F.col("c_kind").isNotNull()
    same_kind = (F.col("r_kind") == F.col("c_kind")) | (F.col("r_kind").isin("multiple", "percent") & F.col("c_kind").isin("multiple", "percent"))
    lost_sign = F.coalesce(F.col("r_negative"), F.lit(False)) & ~F.col("cand").rlike(r"[(\-−–]")
    lost_pct = F.coalesce(F.col("r_kind") == "percent", F.lit(False)) & ~F.contains("cand", F.lit("%"))
    agrees = (_digits(F.col("core")) == _digits(F.col("cand"))) & F.when(both, (F.col("r_negative") == F.col("c_negative")) & same_kind).otherwise(~lost_sign & ~lost_pct)
    as_nil = (F.col("read") == "") | F.col("read").isin(NIL_FORMS) | F.col("read").rlike("^[-–—_ ]*$")
    as_date = F.regexp_replace("raw", "[^0-9]", "") == F.regexp_replace("read", "[^0-9]", "")
    verdict = F.when(F.col("kind") == "nil", as_nil).when(F.col("kind") == "date", as_date).otherwise(agrees)
    groups = F.regexp_extract_all("raw", F.lit("([0-9]+)"), F.lit(1))
    got = F.regexp_replace("reading", "[^0-9]", "")
    other = (got != "") & ~F.like(got, F.concat(F.lit("%"), F.array_join(groups, "%"), F.lit("%")))
    return (one.withColumns({"agrees": verdict, "contradicts": other, "shows_digits": got != ""})
            .groupBy("report_id", "fid", "reading_no").agg(
                F.bool_or("agrees").alias("agrees"), F.bool_or("contradicts").alias("contradicts"),
                F.bool_or("shows_digits").alias("shows_digits"), F.max("reading").alias("reading")))


def _reread(figures: DataFrame, readings: DataFrame, text_confirmed: DataFrame) -> DataFrame:
    """text_confirmed: report_id, fid of figures both text sources read identically."""
    per = judged_readings(figures, readings).groupBy("report_id", "fid").agg(
        F.bool_or("agrees").alias("ok"), F.count_if("shows_digits").alias("digit_reads"),
        F.count_if(F.col("shows_digits") & F.col("contradicts")).alias("against"),
        F.max_by("reading", F.when(F.col("reading") != "", F.col("reading_no"))).alias("last_read"))
    sure = text_confirmed.select("report_id", "fid").distinct().withColumn("in_text", F.lit(True))
    figs = active(figures).filter(F.col("kind").isin(REREAD_KINDS))
    mild = (F.col("method") == "text_layer") & F.col("in_text").isNotNull() & (
        F.coalesce("against", F.lit(0)) * 2 < F.greatest(F.lit(1), F.coalesce("digit_reads", F.lit(0))))
    return (figs.join(per, ["report_id", "fid"], "left").join(sure, ["report_id", "fid"], "left")
            .withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("severity", F.when(mild, "warning").otherwise("blocking")))


def check_rereads(figures: DataFrame, readings: DataFrame, text_confirmed: DataFrame) -> DataFrame:
    return _reread(figures, readings, text_confirmed).filter(~F.col("ok")).select(
        "report_id", "fid", "page", F.lit("re_extraction").alias("check_name"), "severity", F.col("raw").alias("expected"),
        F.coalesce("last_read", F.lit("(unreadable)")).alias("actual"))


def confirmed_by_reread(figures: DataFrame, readings: DataFrame) -> DataFrame:
    return judged_readings(figures, readings).filter("agrees").select("report_id", "fid").distinct()


# ------------------------------------------------------------------ C4: totals

# The label of a total.
TOTAL_LABEL = r"(?i)\btotal\b"
TABLE = ["report_id", "table_id"]


def cell_values(cells: DataFrame) -> DataFrame:
    """value of a cell for arithmetic: numbers as they are, nil as zero, anything else nothing. Plain digits, the usual
    case, are cast at once; only other texts are read as printed numbers."""
    plain = F.when(F.col("raw").rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"), F.col("raw"))
    df = once(cells, {"_plain": plain})
    df = with_number(df.withColumn("_odd", F.when(F.col("_plain").isNull(), F.col("raw"))), "_odd", "_v_")
    value = F.when(F.col("_plain").isNotNull(), F.col("_plain").try_cast("decimal(38,10)")).when(F.col("_v_kind") == "number", F.col("_v_value")).when(F.col("_v_kind") == "nil", F.lit(0).cast("decimal(38,10)"))
    return df.withColumn("value", value).drop("_plain", "_odd", *[f"_v_{f}" for f in NUMBER_FIELDS])


def without_changes(cells: DataFrame, columns: DataFrame | None) -> DataFrame:
    """Cells of columns that state a change are no amounts: they neither add up nor balance. Which columns these are is
    told by ``columns`` or, without it, by the cells' own column label where they carry one."""
    if columns is None:
        return cells.filter(change_kind(F.col("col_label")).isNull()) if "col_label" in cells.columns else cells
    return cells.join(columns.filter(F.col("change").isNotNull()).select(*TABLE, "col_no").distinct(), [*TABLE, "col_no"], "left_anti")


def _segment_columns(cells: DataFrame, *more: Column) -> DataFrame:
    """One row per table, segment (the rows since the total before, and the total that closes it), block of rows and column:
    the sum and number of its values, the rows it counts for its segment, the total. The cells are shuffled and sorted once,
    by blocks of rows; what is stored and carried from block to block are these rows alone."""
    placed = cells.select(*TABLE, "row_no", "label", "col_no", "raw").withColumn("_block", F.floor(F.col("row_no") / 4096)).repartition(*TABLE, "_block")
    row, block = W.partitionBy(*TABLE, "_block", "row_no"), W.partitionBy(*TABLE, "_block")
    in_row = row.orderBy("col_no")
    whole = in_row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = cell_values(placed).withColumn("has", F.col("value").isNotNull())
    c = c.withColumns({"first": F.row_number().over(in_row) == 1, "label": F.max("label").over(whole), "filled": F.max("has").over(whole)}).drop("has")
    c = once(c, {"is_total": F.coalesce(F.col("label").rlike(TOTAL_LABEL), F.lit(False))})
    total_row = F.when(F.col("first") & F.col("is_total"), 1).otherwise(0)
    # a total belongs to the segment it closes: those up to this row, less the row itself
    c = c.withColumn("_local", F.sum(total_row).over(block.orderBy("row_no")) - F.col("is_total").cast("int"))
    part = ~F.col("is_total") & F.col("filled")
    local = cut(c.groupBy(*TABLE, "_block", "_local", "col_no").agg(
        F.sum(F.when(part, F.col("value"))).alias("s"), F.count_if(part & F.col("value").isNotNull()).alias("n"), F.count_if(part & F.col("first")).alias("rows"), F.sum(total_row).alias("totals"),
        F.max(F.when(F.col("is_total"), F.struct("row_no", "label", F.col("value").alias("total"), "raw"))).alias("t"), *more))
    return carried_sum(local, TABLE, "totals", "segment")


def _total_votes(columns: DataFrame) -> DataFrame:
    """Per segment and column: the printed total beside the sum of the rows since the total before it."""
    # a segment's columns side by side (a table has few): the row count, and which columns add up
    per_col = columns.repartition(*TABLE, "segment").groupBy(*TABLE, "segment", "col_no").agg(*[f(c).alias(c) for f, c in ((F.sum, "s"), (F.sum, "n"), (F.sum, "rows"), (F.max, "t"))])
    wide = per_col.groupBy(*TABLE, "segment").agg(F.sum("rows").alias("rows"), F.collect_list(F.when(F.col("col_no").isNotNull(), F.struct("col_no", "s", "n", "t"))).alias("cols"))
    tol = lambda c: (F.lit(5).cast("decimal(38,10)") * F.pow(F.lit(10.0), -printed_decimals(c["t"]["raw"]) - 1).cast("decimal(38,10)") * c["n"])
    usable = F.filter("cols", lambda c: c["t"]["total"].isNotNull() & (c["n"] == F.col("rows")))
    judged = F.transform(usable, lambda c: F.struct(c["col_no"].alias("col_no"), c["s"].alias("s"), c["t"].alias("t"), (F.abs(c["s"] - c["t"]["total"]) <= tol(c)).alias("ok")))
    judged = once(wide.filter(F.col("rows") >= 2).select(*TABLE, "segment", "rows", "cols"), {"judged": judged}).drop("rows", "cols")
    return (once(judged, {"n_ok": F.size(F.filter("judged", lambda c: c["ok"]))})
            .withColumn("n_bad", F.size("judged") - F.col("n_ok")).filter(F.col("n_ok") > 0))


def check_totals(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """columns: report_id, table_id, col_no, change; columns with a change kind are left out."""
    bad = _total_votes(_segment_columns(without_changes(cells, columns))).withColumn("c", F.explode(F.filter("judged", lambda c: ~c["ok"])))
    return bad.select(*TABLE, F.col("c.t.row_no").alias("row_no"), F.col("c.col_no").alias("col_no"), F.lit("arithmetic").alias("check_name"),
                      F.when(F.col("n_ok") >= F.col("n_bad"), "blocking").otherwise("warning").alias("severity"),
                      F.col("c.t.label").alias("label"), F.col("c.s").cast("decimal(38,4)").cast("string").alias("expected"), F.col("c.t.raw").alias("actual"))


def cells_in_totals(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Cells a total was checked with, and whether their column adds up."""
    rows = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("row_no"))).alias("of")  # of one block, which bounds them
    parts = _segment_columns(without_changes(cells, columns), rows)
    verdicts = _total_votes(parts).withColumn("c", F.explode("judged")).select(*TABLE, "segment", F.col("c.col_no").alias("col_no"), F.col("c.ok").alias("confirmed"))
    both = parts.select(*TABLE, "segment", "col_no", "of").join(verdicts, [*TABLE, "segment", "col_no"])
    return both.select(*TABLE, F.inline("of"), "col_no", "confirmed")


# ------------------------------------------------------------------ C5, C6: balance and stated changes

# The labels of the two sides of a balance sheet.
ASSETS = r"(?i)^total assets$"
EQUITY_AND_LIABILITIES = r"(?i)^total (equity and liabilities|liabilities and (shareholders'? )?equity|equity & liabilities)$"


def check_balance(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    cells, label = without_changes(cells, columns), F.trim("label")
    first = lambda rx: F.min_by(F.struct("value", "raw"), F.when(label.rlike(rx), F.col("row_no")))
    kept = cells.filter(label.rlike(ASSETS) | label.rlike(EQUITY_AND_LIABILITIES))
    both = cell_values(kept).groupBy(*TABLE, "col_no").agg(first(ASSETS).alias("a"), first(EQUITY_AND_LIABILITIES).alias("l"))
    return both.filter(F.col("a.value") != F.col("l.value")).select(
        *TABLE, "col_no", F.lit("arithmetic").alias("check_name"), F.lit("blocking").alias("severity"), F.col("a.raw").alias("expected"), F.col("l.raw").alias("actual"))


# The form of a period key.
KEY_FORM = r"^(quarter|half|nine_months|year)([0-9]?):FY([0-9]{4})$"


def comparison_key(key: Column, change: Column) -> Column:
    """The period a change compares with: a year earlier, or the quarter before."""
    span, number, year = (F.regexp_extract(key, KEY_FORM, i) for i in (1, 2, 3))
    fy, q = year.try_cast("int"), number.try_cast("int")
    before = F.when(q > 1, F.concat(F.lit("quarter"), (q - 1).cast("string"), F.lit(":FY"), year)).otherwise(F.concat(F.lit("quarter4:FY"), (fy - 1).cast("string")))
    return F.when(key.rlike(KEY_FORM), F.when(change.isin("yoy", "change"), F.concat(span, number, F.lit(":FY"), (fy - 1).cast("string")))
                  .when((change == "qoq") & (span == "quarter"), before))


def to_places(value: Column, places: Column) -> Column:
    """Rounded to as many places as are printed beside it."""
    out = F.when(places == 0, F.bround(value, 0))
    for n in (1, 2, 3, 4):
        out = out.when(places == n, F.bround(value, n))
    scale = F.pow(F.lit(10.0), places)
    return out.otherwise(F.bround(value * scale, 0) / scale)


def check_stated_changes(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """columns: report_id, table_id, col_no, period_key, change. The current column is the nearest period column to
    the left of the change whose comparison period is also in the table."""
    stated = columns.filter(F.col("change").isNotNull()).select(*TABLE, F.col("col_no").alias("c"), "change")
    periods = columns.filter(F.col("period_key").isNotNull()).select(*TABLE, "col_no", "period_key")
    keyed = periods.groupBy(*TABLE, F.col("period_key").alias("wanted")).agg(F.max("col_no").alias("prev"))
    left = stated.join(periods, TABLE).filter(F.col("col_no") < F.col("c")).withColumn("wanted", comparison_key(F.col("period_key"), F.col("change")))
    chosen = left.join(keyed, [*TABLE, "wanted"]).groupBy(*TABLE, "c").agg(F.max("col_no").alias("cur"), F.max_by("prev", "col_no").alias("prev"))
    # one row per role, so each cell is shuffled once and the three meet in one aggregate
    roles = chosen.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.col(k).alias("col_no")) for n, k in (("stated", "c"), ("cur", "cur"), ("prev", "prev"))]))).select(
        *TABLE, "c", "r.role", "r.col_no")
    parsed = with_number(cells, "raw", "_v_").withColumn("num", F.when(F.col("_v_kind").isin("number", "percent"), F.col("_v_value")).when(F.col("_v_kind") == "nil", F.lit(0).cast("decimal(38,10)")))
    # labels repeat within a table; a row number, where the cells have one, tells the rows apart
    row = ["row_no", "label"] if "row_no" in cells.columns else ["label"]
    one = parsed.select(*TABLE, *row, "col_no", "raw", F.col("_v_kind").alias("kind"), F.col("num").cast("decimal(24,6)").alias("num")).join(roles, [*TABLE, "col_no"])
    pick = lambda role, ok: F.max(F.when((F.col("role") == role) & ok, F.struct("num", "raw")))
    plain = F.col("kind").isin("number", "nil")
    trio = one.groupBy(*TABLE, "c", *row).agg(pick("stated", F.col("kind") == "percent").alias("s"), pick("cur", plain).alias("u"), pick("prev", plain).alias("p"))
    trio = trio.filter(F.col("s").isNotNull() & F.col("u").isNotNull() & F.col("p").isNotNull() & (F.col("p.num") != 0))
    cur, prev, st = F.col("u.num"), F.col("p.num"), F.col("s.num").cast("decimal(14,4)")
    half = lambda raw: F.lit(5).cast("decimal(2,0)") * F.pow(F.lit(10.0), -printed_decimals(raw) - 1).cast("decimal(12,8)")
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    # cross-multiplied by |previous| so that nothing is divided
    off = F.abs((cur - prev) - st * F.abs(prev) * hundredth)
    allowed = half(F.col("s.raw")) * F.abs(prev) * hundredth + half(F.col("u.raw")) * 2
    computed = (cur.cast("double") - prev.cast("double")) / F.abs(prev.cast("double")) * 100
    return trio.filter(off > allowed).select(*TABLE, F.col("c").alias("col_no"), *row, F.lit("arithmetic").alias("check_name"), F.lit("warning").alias("severity"),
                                             to_places(computed, printed_decimals(F.col("s.raw"))).alias("expected_change"), F.col("s.raw").alias("actual"))


# ------------------------------------------------------------------ C7–C9: tables against each other and their headers

def _same_line(figures: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    keep = (F.col("role") == "cell") & (F.col("kind") == "number") & F.col("period_key").isNotNull() & (letters_only(F.col("row_label")) != "")
    lines = active(figures).filter(keep).withColumns({"norm_label": letters_only(F.col("row_label")), "u": F.coalesce("unit", F.lit("")), "cur": F.coalesce("currency", F.lit(""))})
    key = ["report_id", "norm_label", "period_key", "u", "cur"]
    order = F.struct("page", "fid")
    groups = lines.groupBy(*key).agg(F.min("table_id").alias("t0"), F.max("table_id").alias("t1"), F.min("value").alias("v0"), F.max("value").alias("v1"),
                                     F.min_by(F.struct("value_str", "raw", "fid"), order).alias("first"))
    # two tables and one value are told by their minimum and maximum: no distinct set is collected
    return lines, groups.filter(F.col("t0") != F.col("t1")), key


def check_cross_tables(figures: DataFrame) -> DataFrame:
    lines, groups, key = _same_line(figures)
    differing = groups.filter(F.col("v0") != F.col("v1")).select(*key, "first")
    return (lines.join(differing, key).filter((F.col("fid") != F.col("first.fid")) & ~F.col("value_str").eqNullSafe(F.col("first.value_str")))
            .select("report_id", "fid", "page", F.lit("cross_table").alias("check_name"), F.lit("warning").alias("severity"), F.col("first.raw").alias("expected"), F.col("raw").alias("actual")))


def confirmed_across_tables(figures: DataFrame) -> DataFrame:
    lines, groups, key = _same_line(figures)
    return lines.join(groups.filter(F.col("v0") == F.col("v1")).select(*key), key, "left_semi").select("report_id", "fid")


def check_units(tables: DataFrame, meta: DataFrame) -> DataFrame:
    """tables: report_id, table_id, page, unit, unit_source, has_numbers, units_mentioned. meta: report_id, report_unit."""
    mentioned = tables.select("report_id", F.explode("units_mentioned").alias("u")).groupBy("report_id").agg(
        (F.bool_or(F.col("u") == "crore") & F.bool_or(F.col("u") == "lakh")).alias("mixed"))
    df = tables.filter("has_numbers").join(meta, "report_id").join(mentioned, "report_id", "left")
    unlabelled = F.col("unit_source") != "caption"
    differs = ~unlabelled & ~F.col("unit").eqNullSafe(F.col("report_unit"))
    return df.filter(unlabelled | differs).select(
        *TABLE, "page", F.lit("period_unit").alias("check_name"), F.when(unlabelled & F.coalesce("mixed", F.lit(False)), "blocking").otherwise("warning").alias("severity"),
        F.when(unlabelled, "no unit label").otherwise("other unit").alias("problem"), F.when(unlabelled, F.lit(None)).otherwise(F.col("unit")).alias("actual"))


def check_periods(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """cells carry the period key of their own figure; columns the key and change kind of their header."""
    filled = cells.groupBy(*TABLE, "col_no").agg(F.count(F.lit(1)).alias("n"))
    nameless = (columns.filter(F.col("period_key").isNull() & F.col("change").isNull()).join(filled, [*TABLE, "col_no"], "left_semi")
                .select(*TABLE, "col_no", F.lit(None).cast("bigint").alias("row_no"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    head = columns.filter(F.col("period_key").isNotNull()).select(*TABLE, "col_no", F.col("period_key").alias("expected"))
    differs = (cells.filter(F.col("cell_period_key").isNotNull()).join(head, [*TABLE, "col_no"]).filter(F.col("cell_period_key") != F.col("expected"))
               .select(*TABLE, "col_no", F.col("row_no").cast("bigint").alias("row_no"), F.lit("blocking").alias("severity"), "expected", F.col("cell_period_key").alias("actual")))
    return nameless.unionByName(differs).withColumn("check_name", F.lit("period_unit"))


# ------------------------------------------------------------------ C10, C13: completeness and confidence

def check_completeness(words: DataFrame, figures: DataFrame, excluded: DataFrame, pages: DataFrame, pictures: DataFrame) -> DataFrame:
    """pages: report_id, page, hidden_numbers. pictures: report_id, page, extracted, shown. Digit words outside the
    excluded boxes against the digit parts of captured figures, page by page."""
    digits = words.filter(has_digit(F.col("text"))).select("report_id", "page", "x0", "y0", "x1", "y1")
    outside = words_in_boxes(digits, as_boxes(excluded), 2.0, "left_anti").groupBy("report_id", "page").agg(F.count(F.lit(1)).alias("total"))
    parts = F.size(F.filter(F.split("raw", " "), has_digit))
    captured = figures.groupBy("report_id", "page").agg(F.sum(parts).alias("captured"))
    zero = F.lit(0).cast("bigint")
    gaps = outside.join(captured, ["report_id", "page"], "left").withColumn("captured", F.coalesce("captured", zero)).filter(F.col("total") > F.col("captured")).select(
        "report_id", "page", F.lit("missed numbers").alias("problem"), F.col("total").alias("expected"), F.col("captured").alias("actual"))
    hidden = pages.filter(F.col("hidden_numbers") > 0).select("report_id", "page", F.lit("hidden numbers").alias("problem"),
                                                             F.col("hidden_numbers").cast("bigint").alias("expected"), zero.alias("actual"))
    lost = pictures.filter(~F.col("extracted") & ~F.col("shown")).select("report_id", "page", F.lit("picture").alias("problem"), F.lit(1).cast("bigint").alias("expected"), zero.alias("actual"))
    return gaps.unionByName(hidden).unionByName(lost).withColumns({"check_name": F.lit("completeness"), "severity": F.lit("warning")})


def check_low_confidence(figures: DataFrame, reread_ok: DataFrame, threshold: float = 0.95) -> DataFrame:
    """figures: … unparsed, ambiguous. A low reading clears itself only when an independent one agrees and it was no guess."""
    agreed = reread_ok.select("report_id", "fid").distinct().withColumn("agreed", F.lit(True))
    low = (F.col("method") == "ocr") & (F.col("confidence") < threshold) & F.col("kind").isin(REREAD_KINDS)
    off = F.lit(False)
    span = stripped(F.col("raw")).rlike(YEAR_SPAN)
    unparsed = F.coalesce("unparsed", off)
    problem = (F.when(unparsed & span, None).when(unparsed, "unreadable number")
               .when(low & F.col("agreed").isNotNull() & (F.col("confidence") >= AUTO_CLEAR), "low but agreed")
               .when(low, "low confidence").when((F.col("kind") == "date") & F.coalesce("ambiguous", off), "ambiguous date"))
    return (active(figures).join(agreed, ["report_id", "fid"], "left").withColumn("problem", problem).filter(F.col("problem").isNotNull())
            .select("report_id", "fid", "page", F.lit("low_confidence").alias("check_name"),
                    F.when(F.col("problem").isin("unreadable number", "low confidence"), "blocking").otherwise("warning").alias("severity"), "problem"))


# ------------------------------------------------------------------ C17: the document's own rules

def _rules() -> dict[str, list[tuple[str, Column]]]:
    """Per table: what a row violates. One scan per table, whatever the number of rules."""
    c = F.col
    absent = lambda *names: [(f"{n} is missing", c(n).isNull()) for n in names]
    return {
        "metadata": [*absent("company", "report_type", "fiscal_year", "period", "currency", "reporting_unit"), ("company is empty", F.length("company") == 0),
                     ("report_type", ~c("report_type").isin("quarterly_results", "investor_presentation", "annual_report", "other")),
                     ("fiscal_year", ~c("fiscal_year").between(1990, 2100)), ("period", ~c("period").isin("q1", "q2", "q3", "q4", "h1", "h2", "9m", "fy")),
                     ("currency", ~c("currency").rlike("^[A-Z]{3}$"))],
        "pages": [*absent("page", "width", "height", "method"), ("page", c("page") < 1), ("method", ~c("method").isin("text_layer", "ocr"))],
        "sections": [*absent("section_id", "section_type", "slug"), ("section_id", ~c("section_id").rlike("^s[0-9]+$")),
                     ("section_type", ~c("section_type").isin("highlights", "profit_and_loss", "balance_sheet", "cash_flow", "segment_results", "management_commentary", "outlook", "notes", "other")),
                     ("slug", ~c("slug").rlike("^[a-z0-9-]+$"))],
        "figures": [*absent("fid", "kind", "raw", "page", "method", "confidence", "status", "section_id"), ("fid", ~c("fid").rlike("^p[0-9]+f[0-9]+$")),
                    ("kind", ~c("kind").isin(FIGURE_KINDS)), ("raw", F.length("raw") == 0), ("value", ~c("value_str").rlike(r"^-?[0-9]+(\.[0-9]+)?$")), ("page", c("page") < 1),
                    ("role", ~c("role").isin(ROLES)), ("method", ~c("method").isin("text_layer", "ocr")), ("confidence", ~c("confidence").between(0.0, 1.0)),
                    ("status", ~c("status").isin("active", "not_a_figure"))],
        "runs": [("text run holds a digit", c("text").rlike("[0-9]")), ("run is neither text nor figure", c("text").isNull() & c("run_fid").isNull())],
    }


def check_schema(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    out = None
    for name, df in tables.items():
        hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for msg, bad in _rules()[name]]))
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys[name]])
        found = df.select(F.lit(name).alias("part"), key.alias("row_key"), F.explode(hits).alias("problem"))
        out = found if out is None else out.unionByName(found)
    return out.withColumns({"check_name": F.lit("schema"), "severity": F.lit("blocking")})


def page_words(texts: DataFrame) -> DataFrame:
    """texts: report_id, page, text -> the words each page says, once each."""
    return texts.select("report_id", "page", F.explode(letter_words(F.col("text"))).alias("word")).distinct()
