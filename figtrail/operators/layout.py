"""Words to lines, segments and furniture.

Everything is keyed by (report, page): a page is a bounded thing, a report is not. Statistics over a report are
aggregates, never windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figtrail.functions.boxes import as_boxes, centre, words_in_boxes
from figtrail.functions.dates import may_be_dated, with_date, with_period
from figtrail.functions.jumps import chosen_spans
from figtrail.functions.numbers import is_number, looks_like_cell_value, with_number
from figtrail.functions.text import core_of, has_digit, letters_only, literal_map, once, stripped
from figtrail.operators.normalise import reads_as_word
from figtrail.session import cut, parted
from figtrail.session import spread as by_page

PAGE = ["report_id", "page"]
#: For windows: rows are sorted by the page number first, by which most are told apart at once; a report holds many pages.
ON_PAGE = ["page", "report_id"]


def visual_lines(words: DataFrame) -> DataFrame:
    """A word starts a new line when its centre is further below the one before than 0.45 of the smaller height."""
    w = W.partitionBy(*ON_PAGE).orderBy("_yc", "x0", "word_no")
    df = words.withColumns({"_yc": centre("y0", "y1"), "_h": F.col("y1") - F.col("y0")})
    new = F.coalesce((F.col("_yc") - F.lag("_yc").over(w)) > F.least("_h", F.lag("_h").over(w)) * 0.45, F.lit(True))
    df = df.withColumn("_new", new.cast("int"))
    return df.withColumn("line", F.sum("_new").over(w)).drop("_yc", "_h", "_new")


def line_segments(lines: DataFrame) -> DataFrame:
    """Lines cut at column gaps; two numbers side by side are always apart."""
    df = once(lines, {"_num": looks_like_cell_value(F.col("text"))})
    df = df.withColumn("_med", F.median(F.col("y1") - F.col("y0")).over(W.partitionBy(*ON_PAGE)))
    w = W.partitionBy(*ON_PAGE, "line").orderBy("x0", "word_no")
    gap = F.col("x0") - F.lag("x1").over(w)
    cut = (gap > F.greatest(F.lit(14.0), F.col("_med") * 2.2)) | ((gap > 4) & F.col("_num") & F.lag("_num").over(w))
    df = df.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int"))
    return df.withColumn("segment", F.sum("_cut").over(w)).drop("_num", "_cut").withColumnRenamed("_med", "page_height_med")


#: Parts of pages for each part the session shuffles into: steps within the page sort words several times, in memory.
FINER = 2
#: Words of a segment whose texts are joined at once.
TEXT_WORDS = 64


def segment_rows(segmented: DataFrame) -> DataFrame:
    """One row per segment, with its box, type and whether it reads as a table value. The words of a segment lie side by
    side once they are sorted, so everything is read off windows and its first word stands for it: most segments are one
    word, for which lists and medians kept per group cost more than the rows. A long text is joined from pieces."""
    whole = W.partitionBy(*ON_PAGE, "line", "segment")
    order = whole.orderBy("x0", "word_no", "text")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    piece = F.array_join(F.collect_list("text").over(order.rowsBetween(0, TEXT_WORDS - 1)), " ")
    seg = segmented.select(
        *PAGE, "line", "segment", F.row_number().over(order).alias("_no"), piece.alias("_piece"),
        F.min("x0").over(every).alias("x0"), F.min("y0").over(every).alias("y0"), F.max("x1").over(every).alias("x1"), F.max("y1").over(every).alias("y1"),
        F.median("size").over(whole).alias("size"), F.bool_and("bold").over(every).alias("bold"), F.count(F.lit(1)).over(every).alias("n_words"),
        F.min("conf").over(every).alias("conf"), F.max("page_height_med").over(every).alias("med_h"))
    seg = seg.filter(F.col("_no") % TEXT_WORDS == 1)
    pieces = F.collect_list("_piece").over(whole.orderBy("_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    seg = seg.withColumn("text", F.array_join(pieces, " ")).filter("_no = 1")
    seg = seg.select(*PAGE, "line", "segment", "text", "x0", "y0", "x1", "y1", "size", "bold", "n_words", "conf", "med_h")
    return once(seg, {"is_numeric": looks_like_cell_value(F.col("text"))})


def segments_of(words: DataFrame) -> DataFrame:
    """The words of a page are put together once, in small parts; every step after that is a window within the page."""
    return segment_rows(line_segments(visual_lines(parted(words, *PAGE, finer=FINER))))


# ------------------------------------------------------------------ W1: tokens

#: Words a figure may be printed in.
MOST_WORDS = 4
# Currency words that may stand before a number in running text.
CURRENCY_WORDS = ["₹", "Rs", "Rs.", "INR", "USD", "US$", "$", "€", "£", "EUR", "GBP"]


def figure_tokens(words: DataFrame, run: str = "line", order: tuple[str, ...] = ("x0", "word_no"), in_cell: str | None = None) -> DataFrame:
    """Greedy left-to-right, longest first: four, three, two words that read as a period, date or number, else one. Words
    of one ``run`` of a page are read together, in the given order; a dash or "nil" is a figure only where ``in_cell`` holds.
    Candidates are parsed as columns for every start and length; which of them a walk from the left takes is found by
    doubled jumps, so the work grows with the words of a run, however long it is."""
    w = W.partitionBy(*ON_PAGE, run).orderBy(*order)
    df = words.withColumns({"ord": F.row_number().over(w), "_run_words": F.count(F.lit(1)).over(W.partitionBy(*ON_PAGE, run)), "_cell": F.col(in_cell) if in_cell else F.lit(False)})
    nxt = [F.col("text"), *[F.lead("text", i).over(w) for i in range(1, MOST_WORDS)]]
    df = df.withColumns({"_prev_word": F.lag("text").over(w), **{f"_t{i + 1}": c for i, c in enumerate(nxt)},
                         **{f"_n{i}": F.lead("text", i).over(w) for i in range(1, MOST_WORDS + 1)}})
    spans = df.select("*", F.posexplode(F.array(*[F.concat_ws(" ", *[F.col(f"_t{j}") for j in range(1, n + 1)]) for n in range(1, MOST_WORDS + 1)])).alias("_i", "_raw"))
    spans = spans.withColumn("span", F.col("_i") + 1).filter((F.col("ord") + F.col("span") - 1 <= F.col("_run_words")) & (has_digit(F.col("_raw")) | (F.col("_cell") & (F.col("span") == 1))))
    spans = once(spans, {"raw": core_of(F.col("_raw"))})
    # several words are a figure only as a date, a period or one number; the rest is not parsed, and a text without a date in it not as one
    spans = once(spans, {"_dated": F.when(may_be_dated(F.col("raw")), F.col("raw"))})
    spans = spans.filter((F.col("span") == 1) | F.col("_dated").isNotNull() | is_number(F.col("raw")))
    spans = with_period(with_date(with_number(spans, "raw", "n_"), "_dated", "d_"), "_dated", "p_", columns_too=False)
    number, nil = F.col("n_kind").isNotNull(), F.col("n_kind") == "nil"
    many = (F.when(F.col("p_type").isNotNull() & ~number, "period").when(F.col("d_iso").isNotNull() & ~number, "date")
            .when(number & ~nil & F.contains("raw", F.lit(" ")), F.col("n_kind")))
    single = (F.when(F.col("d_iso").isNotNull() & ~(number & (F.col("d_precision") == "month")), "date").when(number & (~nil | F.col("_cell")), F.col("n_kind"))
              .when(~number & F.col("p_type").isNotNull(), "period").when(~number & has_digit(F.col("raw")), "identifier"))
    spans = once(spans, {"kind": F.when(F.col("span") == 1, single).otherwise(many)})
    after = F.get(F.array(*[F.col(f"_n{i}") for i in range(1, MOST_WORDS + 1)]), F.col("span") - 1)
    spans = spans.filter(F.col("kind").isNotNull()).withColumn("_after", after)
    fields = ["span", "raw", "kind", "n_value_str", "n_currency_symbol", "d_iso", "d_precision", "d_ambiguous", "p_key", "p_end_date", "_prev_word", "_after"]
    longest = spans.groupBy(*PAGE, run, "ord").agg(F.max_by(F.struct(*fields), "span").alias("c"))
    picked = chosen_spans(longest.withColumn("span", F.col("c.span")), [*PAGE, run], "ord", "span", MOST_WORDS)
    unit = F.regexp_replace(F.lower("c._after"), r"^[,.;:)]+|[,.;:)]+$", "")
    mark = F.regexp_replace("c._prev_word", r"^\(+|\(+$", "")
    kind = F.col("c.kind")
    dated = lambda f: F.when(kind == "date", F.col(f))
    return picked.select(*PAGE, run, "ord", "span", F.col("c.raw").alias("raw"), kind.alias("kind"), F.col("c.n_value_str").alias("value_str"), F.coalesce(dated("c.d_iso"), F.when(kind == "period", F.col("c.p_end_date"))).alias("iso"),
                         dated("c.d_precision").alias("precision"), dated("c.d_ambiguous").alias("ambiguous"), F.when(kind == "period", F.col("c.p_key")).alias("period_key"), F.col("c.n_currency_symbol").alias("currency_symbol"),
                         F.when((kind == "number") & mark.isin(CURRENCY_WORDS), mark).alias("currency_hint"), F.when(kind == "number", F.element_at(_hint_units(), unit)).alias("unit_hint"))


def _hint_units() -> Column:
    # Unit words that may follow a number in running text.
    pairs = {"crore": "crore", "crores": "crore", "cr": "crore", "lakh": "lakh", "lakhs": "lakh", "lac": "lakh", "lacs": "lakh",
             "million": "million", "mn": "million", "billion": "billion", "bn": "billion", "thousand": "thousand"}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# ------------------------------------------------------------------ W4, W5: furniture

BAND_SHARE, SAME_LINE_RATIO = 0.075, 0.88
# A line that is a page number.
PAGE_NUMBER_LINE = r"(?i)^(page\s*)?[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?$"


def _band_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    height = pages.select(*PAGE, F.col("height").alias("_ph"))
    return parted(words, *PAGE).join(by_page(height), PAGE).filter((F.col("y1") < F.col("_ph") * BAND_SHARE) | (F.col("y0") > F.col("_ph") * (1 - BAND_SHARE))).drop("_ph")


GRAM = 2


def _most_edits(length: Column) -> Column:
    """Edits between two signatures that are alike and at most three characters apart in length."""
    return F.floor((length + 3) * (1 - SAME_LINE_RATIO) + 1e-9).cast("int")


def rare_grams(signatures: DataFrame) -> DataFrame:
    """report_id, sig, gram: of each signature's pairs of letters the ones that fewest signatures of the report have, as
    many as edits can touch and one more. Strings within d edits differ in at most GRAM * d of them, so two that are
    alike share one of these. A pair that comes again in a signature counts as another."""
    n = F.length("sig")
    pairs = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(F.col("sig"), i, F.lit(GRAM)))
    grams = once(signatures.select("report_id", "sig").distinct().filter(n >= GRAM), {"_pairs": pairs})
    told = F.transform("_pairs", lambda g, i: F.concat(g, F.size(F.filter(F.slice("_pairs", F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    grams = grams.select("report_id", "sig", F.explode(told).alias("gram"))
    spread = grams.groupBy("report_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = grams.join(spread, ["report_id", "gram"]).groupBy("report_id", "sig").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    return ranked.select("report_id", "sig", F.explode(F.slice("g", F.lit(1), _most_edits(F.length("sig")) * GRAM + 1)["gram"]).alias("gram"))


def candidate_signatures(signatures: DataFrame) -> DataFrame:
    """Pairs (sig, other) of one report that share a rare pair of letters and are near in length, both ways round. What
    many titles start with is rare in none of them, so it brings no candidates together."""
    kept = cut(rare_grams(signatures))
    pairs = kept.join(kept.select("report_id", "gram", F.col("sig").alias("other")), ["report_id", "gram"])
    return pairs.filter((F.abs(F.length("sig") - F.length("other")) <= 3) & (F.col("sig") != F.col("other"))).select("report_id", "sig", "other").distinct()


def similar_signatures(signatures: DataFrame) -> DataFrame:
    """Pairs (sig, other) of one report with edit similarity of at least 0.88 and lengths within 3, each with itself too.
    Candidates come from the rarest pairs of letters, so work grows with what is alike, not with what is common."""
    longer = F.greatest(F.length("sig"), F.length("other"))
    alike = candidate_signatures(signatures).filter(1 - F.levenshtein("sig", "other") / longer >= SAME_LINE_RATIO)
    return alike.unionByName(signatures.select("report_id", "sig", F.col("sig").alias("other")).distinct())


def running_lines(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words of header and footer lines repeated through a report, and of lines that are only a page number."""
    lined = visual_lines(_band_words(words, pages))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda e: e["text"])
    lines = lined.groupBy(*PAGE, "line").agg(F.array_join(texts, " ").alias("text")).withColumn("sig", letters_only(F.col("text")))
    counts = lines.select(*PAGE, "sig").distinct().groupBy("report_id", "sig").agg(F.count(F.lit(1)).alias("n"))
    need = pages.groupBy("report_id").agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) / 2)).alias("need"), F.count(F.lit(1)).alias("pages"))
    pairs = similar_signatures(counts.filter(F.length("sig") >= 4).select("report_id", "sig"))
    support = pairs.join(counts.withColumnRenamed("sig", "other"), ["report_id", "other"]).groupBy("report_id", "sig").agg(F.sum("n").alias("support"))
    repeated = support.join(need, "report_id").filter((F.col("pages") >= 2) & (F.col("support") >= F.col("need"))).select("report_id", "sig", F.lit(True).alias("repeated"))
    hit = lines.join(repeated, ["report_id", "sig"], "left").filter(F.col("repeated").isNotNull() | stripped(F.col("text")).rlike(PAGE_NUMBER_LINE))
    return lined.join(by_page(hit.select(*PAGE, "line")), [*PAGE, "line"], "left_semi").drop("line")


def page_number_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Margin integers that follow the page index (v = page + c, or 2·page + c on spreads) through the report.
    pages carry ``index``: the page's position in its report."""
    size = pages.select(*PAGE, "index", "width", "height")
    core = F.regexp_replace("text", r"^[|·•\-–—()\[\]]+|[|·•\-–—()\[\]]+$", "")
    margin = ((F.col("y1") <= F.col("height") * 0.12) | (F.col("y0") >= F.col("height") * 0.88) | (F.col("x1") <= F.col("width") * 0.10) | (F.col("x0") >= F.col("width") * 0.90))
    cand = (words.withColumn("_core", core).filter(F.col("_core").rlike("^[0-9]{1,4}$")).withColumn("_v", F.col("_core").cast("bigint")).filter("_v BETWEEN 1 AND 3000")
            .join(by_page(size), PAGE).filter(margin))
    keys = F.explode(F.array(F.struct(F.lit(1).alias("slope"), (F.col("_v") - F.col("index")).alias("offset")), F.struct(F.lit(2).alias("slope"), (F.col("_v") - F.col("index") * 2).alias("offset")),
                             F.struct(F.lit(2).alias("slope"), (F.col("_v") - F.col("index") * 2 - 1).alias("offset"))))
    keyed = cand.withColumn("_k", keys).select("*", "_k.slope", "_k.offset").drop("_k")
    support = keyed.select("report_id", "slope", "offset", "page").distinct().groupBy("report_id", "slope", "offset").agg(F.count(F.lit(1)).alias("n"))
    total = pages.groupBy("report_id").agg(F.count(F.lit(1)).alias("total"))
    need = F.when(F.col("total") <= 3, F.col("total")).otherwise(F.greatest(F.lit(3), F.ceil(F.col("total") * 3 / 10)))
    good = support.join(total, "report_id").filter((F.col("total") >= 2) & (F.col("n") >= F.when(F.col("slope") == 1, need).otherwise(F.greatest(F.lit(3), need)))).select("report_id", "slope", "offset")
    return keyed.join(good, ["report_id", "slope", "offset"], "left_semi").select(*words.columns).distinct()


# ------------------------------------------------------------------ W6: axis ticks

def _round_step(step: Column) -> Column:
    e = F.floor(F.log10(F.abs(step)))
    m = F.abs(step) / F.pow(F.lit(10.0), e)
    return (step != 0) & ((F.abs(m - 1) < 0.0001) | (F.abs(m - 2) < 0.0001) | (F.abs(m - 2.5) < 0.0001) | (F.abs(m - 5) < 0.0001) | (F.abs(m - 10) < 0.0001))


# The edge by which numbers stand in line on each axis, how far apart they may be, and where values go along it.
AXES = {"right": ("x1", 3.0, -1), "centre": ("xc", 3.0, -1), "row": ("yc", 5.0, 1)}


def axis_runs(words: DataFrame) -> DataFrame:
    """The numbers of evenly spaced runs of a round step, with each run's length, size and whether it holds a zero. Words are
    parted by page once; every step after that is a window within the page, over few columns."""
    num = with_number(words, "text", "n_").filter(F.col("n_kind").isin("number", "percent") & F.col("n_currency_symbol").isNull())
    num = num.select(*PAGE, "word_no", "x0", "y0", "x1", "y1", F.col("n_kind").alias("kind"), F.col("n_value").cast("double").alias("v"))
    places = {"x1": F.col("x1"), "xc": centre("x0", "x1"), "yc": centre("y0", "y1")}
    axes = F.array(*[F.struct(F.lit(name).alias("axis"), places[edge].alias("edge"), F.lit(tol).alias("tol")) for name, (edge, tol, _) in AXES.items()])
    df = parted(num, *PAGE).select("*", F.inline(axes))
    w = W.partitionBy(*ON_PAGE, "axis").orderBy("edge", "word_no")
    df = df.withColumn("_new", F.coalesce(F.col("edge") - F.lag("edge").over(w) > F.col("tol"), F.lit(True)).cast("int"))
    df = df.withColumn("cluster", F.sum("_new").over(w)).drop("_new", "edge", "tol")
    group = [*PAGE, "axis", "cluster"]
    pos = F.when(F.col("axis") == "row", places["xc"]).otherwise(places["yc"])
    direction = F.element_at(literal_map({name: way for name, (_, _, way) in AXES.items()}), F.col("axis"))
    df = df.withColumns({"pos": pos, "group_size": F.count(F.lit(1)).over(W.partitionBy(*group))})
    df = df.filter("group_size >= 3")  # no run is shorter
    w = W.partitionBy(*group).orderBy("pos", "word_no")
    df = df.withColumns({"step": F.bround(F.col("v") - F.lag("v").over(w), 6), "gap": F.col("pos") - F.lag("pos").over(w), "same": F.col("kind") == F.lag("kind").over(w)})
    ok = F.col("same") & _round_step(F.col("step")) & (F.signum("step") == direction) & (F.col("gap") > 0)
    df = df.withColumn("step", F.when(F.coalesce(ok, F.lit(False)), F.col("step"))).drop("pos", "kind", "same")
    w = W.partitionBy(*group).orderBy(pos, "word_no")
    start = (~F.col("step").eqNullSafe(F.lag("step").over(w))).cast("int")
    df = df.withColumn("_s", start).withColumn("island", F.sum("_s").over(w)).drop("_s")
    # a run is an island of steps and the number before its first step
    ahead = F.when(F.lead("step").over(w).isNotNull() & ~F.lead("step").over(w).eqNullSafe(F.col("step")), F.lead("island").over(w))
    member = lambda yes, island, gap: F.when(yes, F.struct(island.alias("island"), gap.alias("gap")))
    both = F.array(member(F.col("step").isNotNull(), F.col("island"), F.col("gap")), member(F.col("ahead").isNotNull(), F.col("ahead"), F.lit(None).cast("double")))
    df = df.withColumn("ahead", ahead).withColumn("_m", F.explode(F.array_compact(both)))
    members = df.select(*group, "word_no", "x0", "y0", "x1", "y1", "v", "step", "group_size", "_m.island", "_m.gap")
    run = W.partitionBy(*group, "island")
    members = members.withColumns({
        "len": F.count(F.lit(1)).over(run), "_gmax": F.max("gap").over(run), "_gmin": F.min("gap").over(run), "zero": F.bool_or(F.col("v") == 0).over(run),
        "_years": F.bool_and((F.col("v") == F.floor("v")) & F.col("v").between(1900, 2100)).over(run), "size": F.max(F.abs("step")).over(run)})
    members = members.filter((F.col("len") >= 3) & ~F.col("_years") & (F.col("len") >= F.col("group_size") * 0.75)).drop("_years", "v", "step", "group_size")
    members = members.withColumn("_med", F.median("gap").over(run))
    tol = F.greatest(F.lit(6.0), F.col("_med") * 0.15)
    even = (F.col("_gmax") - F.col("_med") <= tol) & (F.col("_med") - F.col("_gmin") <= tol)
    return members.filter(even).select(*group, "island", "word_no", "x0", "y0", "x1", "y1", "len", "zero", "size")


def axis_tick_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Bare numbers in a column or row that form an evenly spaced arithmetic run of a round step, with no word label
    on their line. A run is a maximal island of one step; regions: report_id, page, x0..y1."""
    group = [*PAGE, "axis", "cluster"]
    cand = cut(axis_runs(words)).withColumns({"xc": centre("x0", "x1"), "yc": centre("y0", "y1")})
    inside = words_in_boxes(cand.select(*group, "island", "word_no", "x0", "y0", "x1", "y1"), as_boxes(by_page(regions)), 4.0, "left_semi")
    share = inside.groupBy(*group, "island").agg(F.count(F.lit(1)).alias("in_region"))
    labels = words.filter(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 2).select(*PAGE, F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), centre("y0", "y1").alias("ayc"))
    near = (F.abs(F.col("yc") - F.col("ayc")) <= 5) & ((F.col("axis") == "row") | ((F.col("ax1") < F.col("xc")) & (F.col("x0") - F.col("ax1") < 150)) | ((F.col("ax0") > F.col("xc")) & (F.col("ax0") - F.col("x1") < 30)))
    on_band = cand.withColumn("_b", F.explode(F.sequence(F.floor((F.col("yc") - 5) / 36), F.floor((F.col("yc") + 5) / 36))))
    labelled = on_band.join(by_page(labels.withColumn("_b", F.floor(F.col("ayc") / 36))), [*PAGE, "_b"]).filter(near).select(*group, "island").distinct().withColumn("labelled", F.lit(True))
    judged = cand.join(by_page(share), [*group, "island"], "left").join(by_page(labelled), [*group, "island"], "left")
    in_region = F.coalesce(F.col("in_region") * 2 >= F.col("len"), F.lit(False))
    accept = F.when(in_region, F.col("zero") | (F.col("size") != 1) | (F.col("len") >= 5)).otherwise((F.col("len") >= 4) & (F.col("zero") | (F.col("len") >= 5)) & F.col("labelled").isNull())
    return judged.filter(accept).select(*PAGE, "word_no", "x0", "y0", "x1", "y1").distinct()


# ------------------------------------------------------------------ W7, W8: scan junk, all noise

REPEATED = "|".join(str(d) + "{3,}" for d in range(10))
# Parts of the names of icon fonts.
ICON_FONT = r"(?i)wingding|webding|dingbat|zapfding|fontawesome|font-awesome|icomoon|materialicons|material-icons|glyphicon|icofont|ionicons"
MARK = r"₹|Rs\.?|INR|US\$|USD|\$|€|EUR|£|GBP"


def degenerate(text: Column, kind: Column) -> Column:
    """A digit string nobody prints: one digit repeated, a currency sign with one digit, mostly symbols."""
    t = F.regexp_replace(F.regexp_replace(stripped(text), r"^[()]+|[()]+$", ""), "^ +| +$", "")
    core = F.regexp_replace(F.regexp_replace(t, rf"^({MARK})\s?", ""), "[,.]", "")
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return (core.rlike(f"^({REPEATED})$") | t.rlike(rf"^({MARK})\s?[0-9]$") | (kind.isNull() & (F.length(t) >= 2) & (alnum * 2 < F.length(t))))


def junk_words(words: DataFrame, logos: DataFrame) -> DataFrame:
    """Words of scanned pages with a content signal and a context signal. Only suspects look for neighbours."""
    df = with_number(words, "text", "n_")
    df = once(df, {"degen": degenerate(F.col("text"), F.col("n_kind")), "digit": has_digit(F.col("text")), "h": F.col("y1") - F.col("y0")})
    df = df.withColumn("med_h", F.median("h").over(W.partitionBy(*ON_PAGE)))
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    alpha = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 2
    solid = df.filter((F.col("conf") >= 0.3) & ~F.col("degen") & F.when(F.col("digit"), F.col("n_kind").isNotNull()).otherwise(alpha & ((F.col("conf") >= 0.6) | reads_as_word(letters))))
    solid = solid.select(*PAGE, F.col("word_no").alias("sw"), F.col("x0").alias("sx0"), F.col("y0").alias("sy0"), F.col("x1").alias("sx1"), F.col("y1").alias("sy1"), F.col("h").alias("sh"))
    n_alnum = F.length(F.regexp_replace("text", "[^0-9A-Za-z]", ""))
    symbols = ~F.col("digit") & (F.length("text") >= 2) & (F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) * 2 < F.length("text")) & (F.col("conf") < 0.5)
    content = (F.col("conf") < 0.5) | (F.col("degen") & (F.col("conf") < 0.8))
    lone = (n_alnum == 1)
    odd = (F.col("h") < F.col("med_h") * 0.5) | (F.col("h") > F.col("med_h") * 3)
    strong = F.col("degen") & F.regexp_replace("text", "[^0-9]", "").rlike(f"^({REPEATED})$") & (F.length(F.regexp_replace("text", "[^0-9]", "")) >= 4) & (F.col("conf") < 0.4)
    df = df.withColumns({"content": content, "lone": lone, "odd": odd, "strong": strong, "symbols": symbols})
    hh = F.greatest("h", "med_h")
    suspects = df.filter(F.col("digit") & (F.col("content") | F.col("lone"))).withColumn("hh", hh)
    spread = suspects.withColumn("_b", F.explode(F.sequence(F.floor((F.col("y0") - F.col("hh") * 1.5) / 36), F.floor((F.col("y1") + F.col("hh") * 1.5) / 36))))
    banded = solid.withColumn("_b", F.explode(F.sequence(F.floor(F.col("sy0") / 36), F.floor(F.col("sy1") / 36))))
    same_line = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("sy0") + F.col("sy1")) / 2) <= F.least("h", "sh") * 0.5
    beside = F.greatest(F.col("sx0") - F.col("x1"), F.col("x0") - F.col("sx1")) < F.col("hh") * 2.5
    stacked = (F.least("x1", "sx1") - F.greatest("x0", "sx0") > -F.col("hh")) & (F.greatest(F.col("sy0") - F.col("y1"), F.col("y0") - F.col("sy1")) < F.col("hh") * 1.5)
    kept = (spread.join(by_page(banded), [*PAGE, "_b"]).filter((F.col("sw") != F.col("word_no")) & F.when(same_line, beside).otherwise(stacked))
            .select(*PAGE, "word_no").distinct().withColumn("has_neighbour", F.lit(True)))
    on_logo = words_in_boxes(df.select(*PAGE, "word_no", "x0", "y0", "x1", "y1"), as_boxes(by_page(logos)), 0.0, "left_semi").select(*PAGE, "word_no").distinct().withColumn("on_logo", F.lit(True))
    j = df.join(by_page(kept), [*PAGE, "word_no"], "left").join(by_page(on_logo), [*PAGE, "word_no"], "left")
    alone, logo = F.col("has_neighbour").isNull(), F.col("on_logo").isNotNull()
    junk = F.when(F.col("digit"), (logo & ((F.col("conf") < 0.85) | F.col("degen") | F.col("lone"))) | (F.col("content") & (alone | F.col("odd")))
                  | (F.col("lone") & alone & (F.col("conf") < 0.85)) | F.col("strong")).otherwise(F.col("symbols") | (logo & (F.col("conf") < 0.85)))
    return j.filter(junk).select(*words.columns)


def icon_font_words(words: DataFrame) -> DataFrame:
    return words.filter(F.col("font").rlike(ICON_FONT) & has_digit(F.col("text")))


NOISE_ORDER = ["running_line", "page_number", "icon_font", "ocr_noise", "axis_tick"]


def noise_words(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One reason per word, the first of NOISE_ORDER."""
    out = None
    for rank, reason in enumerate(NOISE_ORDER):
        if reason in parts:
            one = parts[reason].select(*key).withColumns({"reason": F.lit(reason), "rank": F.lit(rank)})
            out = one if out is None else out.unionByName(one)
    return out.groupBy(*key).agg(F.min_by("reason", "rank").alias("reason"))


def body_type_size(words: DataFrame) -> DataFrame:
    """Median type size per report; glyph height where there is no text layer. The exact median keeps one counter per
    distinct size, so a report of any length is a small state."""
    layered = F.col("method") == "text_layer"
    return words.groupBy("report_id").agg(
        F.median(F.when(layered & (F.col("size") > 0), F.col("size"))).alias("body_size"),
        F.median(F.when(~layered, F.bround(F.col("y1") - F.col("y0"), 2))).alias("scan_height")).withColumn(
        "title_size", F.coalesce("body_size", "scan_height", F.lit(0.0)))


# ------------------------------------------------------------------ W15, W19, W20

URLISH = r"(?i)https?:|www\.|/|\.(pdf|html?|aspx)\b"
VALUE_WORD = r"(?:[^ ]*[0-9][^ ]*|cr\.?|crore|lakh|mn|bn|million|billion|%|x|bps)"


def kpi_pairs(segments: DataFrame) -> DataFrame:
    """A short label straight above a short value, nearest line first; lines are at most two apart."""
    low = F.regexp_replace(F.lower("text"), r"[,.]+( |$)", "$1")
    value = (F.col("n_words") <= 3) & has_digit(F.col("text")) & low.rlike(f"^{VALUE_WORD}( {VALUE_WORD})*$") & ~F.col("text").rlike(URLISH)
    label = (F.col("n_words") <= 6) & ~has_digit(F.col("text")) & (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 3) & ~F.col("text").rlike(URLISH)
    df = once(segments, {"_value": value, "_label": label}).filter(F.col("_value") | F.col("_label"))
    told = F.when(F.col("_label"), F.struct("line", "segment", "text", "x0", "y1"))
    df = df.withColumn("_above", F.collect_list(told).over(W.partitionBy(*ON_PAGE).orderBy("line").rangeBetween(-2, -1))).filter("_value")
    drop = lambda g: F.col("y0") - g["y1"]
    near = F.filter("_above", lambda g: (F.abs(g["x0"] - F.col("x0")) < 25) & (drop(g) >= 0) & (drop(g) < (F.col("y1") - F.col("y0")) * 2.2))
    best = once(df, {"b": F.array_max(F.transform(near, lambda g: F.struct(g["line"].alias("label_line"), (-g["segment"]).alias("label_segment"), g["text"].alias("label"))))}).filter("b IS NOT NULL")
    # a label serves one value: the first in reading order
    return best.groupBy(*PAGE, "b.label_line", "b.label_segment").agg(F.min_by(F.struct(F.col("b.label").alias("label"), F.col("text").alias("value")), F.struct("line", "segment")).alias("p"), F.min(F.struct("line", "segment")).alias("at")).select(
        *PAGE, F.col("at.line").alias("line"), F.col("at.segment").alias("segment"), "p.label", "p.value")


def reading_order(elements: DataFrame) -> DataFrame:
    """Position on the page: six-point bands from the top, left to right inside one."""
    w = W.partitionBy(*ON_PAGE).orderBy(F.bround(F.col("y0") / 6), "x0", "element_id")
    return elements.withColumn("ord", F.row_number().over(w))


def points_in_regions(words: DataFrame, regions: DataFrame, pad: float = 0.0) -> DataFrame:
    """regions: report_id, page, region_id, x0..y1."""
    return words_in_boxes(words, as_boxes(regions, "region_id"), pad)
