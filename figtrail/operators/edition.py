"""Derivations for the published edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figtrail.functions.ordered import first_seen_after, last_seen, numbered, running_max
from figtrail.functions.text import once, squeezed
from figtrail.operators.sections import has_word, unfinished

PAGE = ["report_id", "page"]
# When pictures lead a page, and when a page has too little text to be web text.
LEAD_SHARE, MANY, MANY_SHARE, SOME, CAPTION_WORDS, PROSE_WORDS, REFLOW_WORDS = 0.40, 5, 0.20, 3, 14, 300, 40


def page_roles(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks: report_id, page, kind, from_table, n_words, x0..y1. One aggregate per page."""
    para, chart = F.col("kind") == "paragraph", (F.col("kind") == "chart") & F.col("x0").isNotNull()
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    per = blocks.groupBy(*PAGE).agg(
        F.bool_or((F.col("kind") == "table") | F.coalesce("from_table", F.lit(False))).alias("tabled"), F.bool_or(F.col("kind") == "table").alias("table"),
        F.coalesce(F.sum(F.when(chart, area)), F.lit(0.0)).alias("area"), F.count_if(chart).alias("charts"),
        F.coalesce(F.sum(F.when(para, F.col("n_words"))), F.lit(0)).alias("words"), F.count_if(para).alias("paras"))
    df = per.join(pages.select(*PAGE, "width", "height"), PAGE, "left")
    share = F.col("area") / F.greatest(F.lit(1.0), F.coalesce("width", F.lit(595.0)) * F.coalesce("height", F.lit(842.0)))
    average = F.when(F.col("paras") > 0, F.col("words") / F.col("paras")).otherwise(0)
    pictures = (share >= LEAD_SHARE) | ((F.col("charts") >= MANY) & (share >= MANY_SHARE)) | ((F.col("charts") >= SOME) & (average < CAPTION_WORDS))
    led = ~F.col("tabled") & (F.col("words") < PROSE_WORDS) & pictures
    sparse = (F.col("words") < REFLOW_WORDS) & ~F.col("table") & (F.col("charts") == 0)
    cover = (F.col("page") == 1) & (F.col("words") < REFLOW_WORDS) & ~F.col("tabled")
    return df.select(*PAGE, led.alias("design_led"), sparse.alias("sparse"), (led | sparse).alias("shown_whole"), cover.alias("cover"))


STOP_WORDS = ["the", "and", "what", "please", "provide", "company", "how", "has", "been"]


def heading_words(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), F.lit(1))), F.array(*[F.lit(w) for w in STOP_WORDS]))


def contents_tables(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """cells: report_id, table_id, row_no, label, page_no (null when the cell is no whole number), n_cols, page_count. A
    one-column table of four or more rising page numbers is a contents page; each entry links to the section on that
    page (or the one before) sharing most words with it, else to the best heading anywhere."""
    table = ["report_id", "table_id"]
    w = W.partitionBy(*table).orderBy("row_no")
    step = cells.filter("n_cols = 1").withColumn("_falls", F.coalesce(F.col("page_no") < F.lag("page_no").over(w), F.lit(False)))
    good = step.groupBy(*table).agg(F.count(F.lit(1)).alias("n"), F.bool_or("_falls").alias("falls"), F.bool_or(F.col("page_no").isNull() | (F.col("page_no") < 1) | (F.col("page_no") > F.col("page_count"))).alias("off")).filter("n >= 4 AND NOT falls AND NOT off")
    entries = once(cells.join(good, table, "left_semi"), {"want": heading_words(F.col("label"))})
    heads = once(sections.filter(F.coalesce("heading", F.lit("")) != ""), {"have": heading_words(F.col("heading"))}).select("report_id", F.col("page").alias("_page"), "ord", "slug", "have")
    near = entries.withColumn("_page", F.explode(F.array(F.col("page_no"), F.col("page_no") - 1))).join(heads, ["report_id", "_page"])
    shared = F.size(F.array_intersect("want", "have"))
    key = [*table, "row_no"]
    best = near.groupBy(*key).agg(F.max_by(F.struct("slug", shared.alias("n")), F.struct(shared, -F.col("ord"))).alias("b"))
    lost = entries.join(best.select(*key), key, "left_anti")
    # an entry with no heading on its pages is looked up by its words: equality on a word, never every heading
    words = heads.withColumn("w", F.explode("have"))
    anywhere = lost.withColumn("w", F.explode("want")).join(words.select("report_id", "w", "ord", "slug"), ["report_id", "w"]).groupBy(*key, "ord", "slug").agg(F.count(F.lit(1)).cast("int").alias("n"))
    anywhere = anywhere.groupBy(*key).agg(F.max_by(F.struct("slug", "n"), F.struct(F.col("n"), -F.col("ord"))).alias("b"))
    return best.unionByName(anywhere).filter("b.n >= 1").select(*key, F.col("b.slug").alias("slug"))


def outline_sections(outline: DataFrame, sections: DataFrame) -> DataFrame:
    """outline: report_id, bookmark_no, title, page, in order. Each bookmark takes the first section at or after its page
    that no earlier one took. With s the sections sorted by page and p the place of the first at or after a bookmark's
    page, the i-th bookmark of rising pages takes max over j ≤ i of p_j + (i − j): a running maximum, no search."""
    places = numbered(sections.filter(F.col("slug").isNotNull()), ["report_id"], F.floor(F.col("page") / 256), ["page", "ord"], "place").select("report_id", "place", "page", "section_id", "ord")
    opening = places.groupBy("report_id", "page").agg(F.min("place").alias("place"))
    asked = outline.select("report_id", "page", F.lit(None).cast("bigint").alias("place"), F.col("bookmark_no"), "title").unionByName(
        opening.select("report_id", "page", "place", F.lit(-1).cast("bigint").alias("bookmark_no"), F.lit(None).cast("string").alias("title")))
    at = first_seen_after(asked, ["report_id"], F.floor(F.col("page") / 256), ["page", "bookmark_no"], "place", "_next")
    same = opening.select("report_id", "page", F.col("place").alias("_same"))
    first = at.filter("bookmark_no >= 0").join(same, ["report_id", "page"], "left").withColumn("p", F.coalesce("_same", "_next")).filter("p IS NOT NULL")
    block = F.floor(F.col("bookmark_no") / 4096)
    run = numbered(first, ["report_id"], block, ["bookmark_no"], "_i").withColumn("_lead", F.col("p") - F.col("_i"))
    run = running_max(run.drop("place"), ["report_id"], block, ["bookmark_no"], "_lead", "_top").withColumn("place", F.col("_top") + F.col("_i"))
    return run.select("report_id", "bookmark_no", F.trim("title").alias("title"), "place").join(places.select("report_id", "place", "section_id", "ord"), ["report_id", "place"]).select("report_id", "bookmark_no", "title", "section_id", "ord")


# Wording of navigation aids that are no chapter titles.
JUNK = r"(?i)hyper.?link|^\s*(to\s+)?contents\b|^\s*index\s*$|click\b|refer\s+to\b|relevant\s+pages|return\s+to"


def title_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def junk_heading(c: Column) -> Column:
    t = F.trim(c)
    n = F.size(F.split(t, r"\s+"))
    return ((F.length(t) < 2) | t.rlike(JUNK) | (n > 10) | t.rlike(r"^\p{Ll}") | (t.rlike(r"\.$") & (n > 4)) | unfinished(t) | ~has_word(t))


def verified_title(title: Column, heading: Column) -> Column:
    """A bookmark's words that carry no number, or one the section's own heading has."""
    strip = lambda w: F.regexp_replace(w, r"^[,.;:()]+|[,.;:()]+$", "")
    allowed = F.transform(F.split(F.trim(heading), r"\s+"), strip)
    kept = F.filter(F.split(F.trim(title), r"\s+"), lambda w: ~w.rlike("[0-9]") | F.array_contains(allowed, strip(w)))
    clean = F.regexp_replace(F.array_join(kept, " "), r"^[\s\-–—:·|.,]+|[\s\-–—:·|.,]+$", "")
    return F.when(clean.rlike(r"\p{L}"), clean).otherwise(F.trim(heading))


def heading_starts(sections: DataFrame) -> DataFrame:
    """sections: report_id, section_id, ord, page, heading, size. Clean headings: no junk, no running titles, first of its
    text and of its page, the largest type where that still leaves two."""
    df = once(sections.filter(F.coalesce("heading", F.lit("")) != ""), {"_norm": title_norm(F.col("heading")), "_junk": junk_heading(F.col("heading"))})
    per = df.groupBy("report_id", "_norm").agg(F.min("ord").alias("ord"), F.count_distinct("page").alias("_pages"))
    kept = df.join(per.filter("_pages <= 2").select("report_id", "_norm", "ord"), ["report_id", "_norm", "ord"], "left_semi").filter(~F.col("_junk"))
    opening = kept.groupBy(*PAGE).agg(F.min_by(F.struct("section_id", "ord", "heading", "size"), "ord").alias("s")).select(*PAGE, "s.*")
    top = opening.groupBy("report_id").agg(F.max("size").alias("_top"), F.count(F.lit(1)).alias("_n"))
    big = opening.join(top, "report_id").withColumn("_big", F.col("size") >= F.col("_top") - 1.0)
    n_big = big.groupBy("report_id").agg(F.count_if("_big").alias("_nbig"))
    return big.join(n_big, "report_id").filter((F.col("_n") < 3) | (F.col("_nbig") < 2) | F.col("_big")).select("report_id", "page", "section_id", "ord", F.trim("heading").alias("title"))


SOURCES = ["outline", "contents", "suggested", "headings"]


def chapter_starts(sections: DataFrame, candidates: dict[str, DataFrame]) -> DataFrame:
    """candidates: per source, report_id, section_id, title. A report uses the first source that has any; fewer than two
    starts are none. Titles keep only numbers the heading carries."""
    every = None
    for rank, name in enumerate(SOURCES):
        if name in candidates:
            one = candidates[name].select("report_id", "section_id", "title").withColumn("rank", F.lit(rank))
            every = one if every is None else every.unionByName(one)
    used = every.groupBy("report_id").agg(F.min("rank").alias("rank"))
    starts = every.join(used, ["report_id", "rank"]).groupBy("report_id", "section_id").agg(F.min("title").alias("title"), F.min("rank").alias("rank"))
    enough = starts.groupBy("report_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("report_id")
    own = sections.select("report_id", "section_id", "ord", F.coalesce("heading", F.lit("")).alias("_heading"))
    return (starts.join(enough, "report_id", "left_semi").join(own, ["report_id", "section_id"])
            .select("report_id", "section_id", "ord", verified_title(F.col("title"), F.col("_heading")).alias("title"), F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col("rank") + 1).alias("source")))


def assign_chapters(sections: DataFrame, starts: DataFrame) -> DataFrame:
    """sections: report_id, section_id, ord, shows. Each belongs to the latest start at or before it, earlier ones to the
    first; a chapter with nothing to show folds into the next that shows (the last into the one before)."""
    marked = sections.join(starts.select("report_id", "section_id", F.lit(True).alias("_start")), ["report_id", "section_id"], "left")
    marked = marked.withColumn("_at", F.when(F.col("_start"), F.col("ord")))
    block = F.floor(F.col("ord") / 4096)
    df = last_seen(marked, ["report_id"], block, ["ord"], "_at", "_chapter")
    first = starts.groupBy("report_id").agg(F.min("ord").alias("_first"))
    df = df.join(first, "report_id").withColumn("chapter", F.coalesce("_chapter", "_first"))
    chapters = df.groupBy("report_id", "chapter").agg(F.bool_or("shows").alias("shown")).withColumn("_self", F.when(F.col("shown"), F.col("chapter")))
    cblock = F.floor(F.col("chapter") / 4096)
    ahead = first_seen_after(chapters, ["report_id"], cblock, ["chapter"], "_self", "_next", inclusive=True)
    both = last_seen(ahead, ["report_id"], cblock, ["chapter"], "_self", "_prev")
    home = both.withColumn("home", F.coalesce("_next", "_prev")).select("report_id", "chapter", "home")
    return df.join(home, ["report_id", "chapter"]).filter("home IS NOT NULL").select("report_id", "section_id", "ord", F.col("home").alias("chapter_start"))


def page_map(pages: DataFrame, sections: DataFrame, facts: DataFrame, chapters: DataFrame) -> DataFrame:
    """pages: report_id, page, title. sections: report_id, section_id, ord, page, heading, first_page (page its content starts).
    facts: report_id, page, left_out, cover, rearranged, drawn, has_text. chapters: report_id, section_id, chapter_start."""
    headed = sections.filter(F.coalesce("heading", F.lit("")) != "")
    opening = headed.groupBy(*PAGE).agg(F.min_by(F.struct("section_id", "heading", "page"), "ord").alias("own"))
    last = headed.groupBy(*PAGE).agg(F.max_by(F.struct("section_id", "heading", "page"), "ord").alias("_last"))
    df = pages.join(facts, PAGE, "left").join(opening, PAGE, "left").join(last, PAGE, "left")
    df = last_seen(df, ["report_id"], F.floor(F.col("page") / 256), ["page"], "_last", "_under", inclusive=False)
    off = F.lit(False)
    flag = lambda c: F.coalesce(F.col(c), off)
    shown = (F.when(flag("left_out"), "left_out").when(flag("cover"), "cover").when(flag("rearranged"), "rearranged").when(flag("drawn"), "picture").when(flag("has_text"), "text").otherwise("none"))
    at = F.coalesce("own", "_under")
    df = df.withColumns({"shown": shown, "_at": at}).select(*PAGE, "title", "shown", (F.col("own").isNotNull() & ~F.col("shown").isin("left_out", "none")).alias("own_section"),
                                                            F.col("_at.section_id").alias("section_id"), F.col("_at.heading").alias("heading"), F.col("_at.page").alias("heading_page"))
    return df.join(chapters.select("report_id", "section_id", "chapter_start"), ["report_id", "section_id"], "left")


# Labels of rows that are no amounts, and how many rows a chart may have.
NO_BAR = r"(?i)per share|\beps\b|%|\bratios?\b|\bmargins?\b|\(x\)"
MIN_BARS, MAX_BARS = 3, 12


def table_bars(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """cells: report_id, table_id, row_no, label, col_no, value, unit (numbers only). columns: … col_no, period_type, fiscal_year,
    change. The latest period and its comparison for up to twelve comparable rows; bar width in percent of the largest."""
    table = ["report_id", "table_id"]
    periods = columns.filter(F.col("period_type").isNotNull() & F.col("change").isNull())
    first = periods.groupBy(*table).agg(F.min_by(F.struct("col_no", "period_type", "fiscal_year"), "col_no").alias("p0"))
    rest = periods.join(first, table).filter(F.col("col_no") > F.col("p0.col_no"))
    year_ago = (F.col("period_type") == F.col("p0.period_type")) & (F.col("fiscal_year") == F.col("p0.fiscal_year") - 1)
    second = rest.groupBy(*table).agg(F.coalesce(F.min(F.when(year_ago, F.col("col_no"))), F.min("col_no")).alias("second"))
    series = first.join(second, table, "left").select(*table, F.explode(F.array_compact(F.array(F.struct(F.lit(1).alias("series"), F.col("p0.col_no").alias("col_no")), F.when(F.col("second").isNotNull(), F.struct(F.lit(2).alias("series"), F.col("second").alias("col_no")))))).alias("s"), F.when(F.col("second").isNotNull(), 2).otherwise(1).alias("n_series")).select(*table, "s.series", "s.col_no", "n_series")
    vals = cells.filter(~F.col("label").rlike(NO_BAR) & F.col("value").isNotNull()).join(series, [*table, "col_no"])
    rows = vals.groupBy(*table, "row_no", "label", "n_series").agg(F.array_sort(F.collect_list(F.struct("series", "value"))).alias("bars"), F.min("unit").alias("u0"), F.max("unit").alias("u1"), F.max(F.abs("value")).alias("top")).filter(F.size("bars") == F.col("n_series"))
    total = F.contains(F.lower("label"), F.lit("total"))
    facts = rows.groupBy(*table).agg(F.count(F.lit(1)).alias("n"), F.count_if(~total).alias("parts"), F.min("u0").alias("m0"), F.max("u1").alias("m1")).filter((F.col("n") >= MIN_BARS) & F.col("m0").eqNullSafe(F.col("m1")))
    kept = rows.join(facts.select(*table, "parts"), table).filter(~total | (F.col("parts") < MIN_BARS))
    w = W.partitionBy(*table).orderBy("row_no")
    top = kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= MAX_BARS)
    scale = top.groupBy(*table).agg(F.max("top").alias("_scale"))
    return top.join(scale, table).select(*table, "row_no", "label", F.explode("bars").alias("b"), "_scale").select(
        *table, "row_no", "label", "b.series", F.bround(F.abs(F.col("b.value").cast("double")) * 100 / F.when(F.col("_scale") == 0, F.lit(1.0)).otherwise(F.col("_scale").cast("double")), 2).alias("width"), (F.col("b.value") < 0).alias("negative"))


def first_per_report(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows of each report: cut per page before the report-wide ranking, so only a page's first few travel."""
    local = df.withColumn("_l", F.row_number().over(W.partitionBy(*PAGE).orderBy(*order))).filter(F.col("_l") <= limit)
    coarse = local.withColumn("_p", F.floor(F.col("page") / 1024)).withColumn("_m", F.row_number().over(W.partitionBy("report_id", "_p").orderBy(*order))).filter(F.col("_m") <= limit)
    return coarse.withColumn("_n", F.row_number().over(W.partitionBy("report_id").orderBy(*order))).filter(F.col("_n") <= limit).drop("_l", "_m", "_p")


def landing_parts(blocks: DataFrame, sections: DataFrame, limit: int = 8) -> DataFrame:
    """blocks: report_id, page, section_id, ord, kind, text. First stats, first highlight paragraphs, contents."""
    stats = first_per_report(blocks.filter(F.col("kind") == "stat"), ["page", "ord"], limit)
    bright = sections.filter(F.col("section_type") == "highlights").select("report_id", "section_id")
    paras = blocks.filter((F.col("kind") == "paragraph") & (F.trim("text") != "")).join(bright, ["report_id", "section_id"], "left_semi")
    high = first_per_report(paras, ["page", "ord"], limit)
    toc = sections.filter(F.coalesce("heading", F.lit("")) != "").select("report_id", F.lit("toc").alias("part"), F.col("ord").cast("bigint").alias("pos"), F.col("heading").alias("text"))
    pick = lambda df, name: df.select("report_id", F.lit(name).alias("part"), F.col("_n").cast("bigint").alias("pos"), "text")
    return pick(stats, "stat").unionByName(pick(high, "highlight")).unionByName(toc)


def section_excerpts(runs: DataFrame, limit: int = 155) -> DataFrame:
    """runs: report_id, section_id, block_ord, run_no, text, run_fid. The first paragraph with 40 digit-free characters before
    its first figure."""
    block = ["report_id", "section_id", "block_ord"]
    cut = runs.groupBy(*block).agg(F.min(F.when(F.col("run_fid").isNotNull(), F.col("run_no"))).alias("_cut"),
                                   F.array_sort(F.collect_list(F.when(F.col("run_fid").isNull(), F.struct("run_no", "text")))).alias("_runs"))
    lead = F.array_join(F.transform(F.filter("_runs", lambda r: F.col("_cut").isNull() | (r["run_no"] < F.col("_cut"))), lambda r: r["text"]), "")
    df = once(cut, {"text": F.regexp_replace(F.regexp_replace(squeezed(lead), "([a-z])- (?=[a-z])", "$1-"), "^[ ,;:]+|[ ,;:]+$", "")})
    best = df.filter((F.length("text") >= 40) & ~F.col("text").rlike("[0-9]")).groupBy("report_id", "section_id").agg(F.min_by("text", "block_ord").alias("text"))
    short = F.concat(F.regexp_replace(F.substring("text", 1, limit), r" [^ ]*$", ""), F.lit("…"))
    return best.withColumn("excerpt", F.when(F.length("text") <= limit, F.col("text")).otherwise(short)).drop("text")


def question_parts(sections: DataFrame) -> DataFrame:
    form = r"^\s*(Q\s?[0-9]{1,3}|\([a-z]\))[ .:)–-]*(.*)$"
    df = sections.withColumns({"marker": F.regexp_extract("heading", form, 1), "question": F.trim(F.regexp_extract("heading", form, 2))})
    return df.filter("marker <> '' AND question <> ''")


def faq_reports(sections: DataFrame) -> DataFrame:
    parts = question_parts(sections)
    enough = parts.groupBy("report_id").agg(F.count(F.lit(1)).alias("questions")).filter("questions >= 3")
    return parts.join(enough, "report_id").select("report_id", "section_id", "marker", "question", "questions")


ADDRESS = r"((?i:https?://|www\.)[A-Za-z0-9\-._~/%#?=&+:]+)"


def printed_links(texts: DataFrame) -> DataFrame:
    """texts: …, text. Web addresses as printed; one wrapped after -, / or _ is joined when what follows looks like a path."""
    keys = [c for c in texts.columns if c != "text"]
    joined = F.regexp_replace("text", r"((?i:https?://|www\.)[A-Za-z0-9\-._~/%#?=&+:]*[-/_])\s+(?=[A-Za-z0-9_~%#?=&+:]*[/.\-][A-Za-z0-9\-._~/%#?=&+:]*)", "$1")
    found = texts.select(*keys, F.posexplode(F.regexp_extract_all(joined, F.lit(ADDRESS), F.lit(1))).alias("link_no", "shown"))
    found = found.withColumn("shown", F.regexp_replace("shown", "[.,;)]+$", ""))
    return found.withColumn("href", F.when(F.lower("shown").startswith("www."), F.concat(F.lit("https://"), "shown")).otherwise(F.col("shown")))


FALLBACK = {"primary": "#1F4FD1", "secondary": "#0F766E", "text": "#1B1D21", "background": "#FFFFFF"}


def _channel(c: Column, at: int) -> Column:
    return F.conv(F.substring(c, at, 2), 16, 10).cast("double") / 255


def _luminance(r: Column, g: Column, b: Column) -> Column:
    lin = lambda x: F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    return lin(r) * 0.2126 + lin(g) * 0.7152 + lin(b) * 0.0722


def colour_counts(pages: DataFrame) -> DataFrame:
    """pages: report_id, css. Colours by site with use counts, saturation, lightness and luminance."""
    hexes = F.transform(F.regexp_extract_all("css", F.lit(r"#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"), F.lit(1)), lambda h: F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h))
    every = pages.select("report_id", F.explode(hexes).alias("h")).select("report_id", F.concat(F.lit("#"), F.upper("h")).alias("colour"))
    per = every.groupBy("report_id", "colour").agg(F.count(F.lit(1)).alias("uses"))
    r, g, b = _channel(F.col("colour"), 2), _channel(F.col("colour"), 4), _channel(F.col("colour"), 6)
    per = once(per, {"hi": F.greatest(r, g, b), "lo": F.least(r, g, b), "luminance": _luminance(r, g, b)})
    light = (F.col("hi") + F.col("lo")) / 2
    sat = F.when(F.col("hi") == F.col("lo"), 0.0).when(light <= 0.5, (F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo"))).otherwise((F.col("hi") - F.col("lo")) / (2 - F.col("hi") - F.col("lo")))
    return per.select("report_id", "colour", "uses", sat.alias("saturation"), light.alias("lightness"), "luminance")


def style_census(pages: DataFrame) -> DataFrame:
    """One palette per site: the most used saturated colour, the next one that stands apart from it, the most used dark."""
    c = colour_counts(pages)
    vivid = (F.col("saturation") > 0.25) & (F.col("lightness") > 0.15) & (F.col("lightness") < 0.85)
    order = F.struct(F.col("uses"), F.col("colour"))
    main = c.groupBy("report_id").agg(F.max_by(F.struct("colour", "luminance"), F.when(vivid, order)).alias("p"), F.max_by("colour", F.when(F.col("lightness") < 0.25, order)).alias("dark"))
    contrast = (F.greatest("luminance", F.col("p.luminance")) + 0.05) / (F.least("luminance", F.col("p.luminance")) + 0.05)
    second = c.filter(vivid).join(main.select("report_id", "p"), "report_id").filter((F.col("colour") != F.col("p.colour")) & (contrast > 1.4)).groupBy("report_id").agg(F.max_by("colour", order).alias("second"))
    return main.join(second, "report_id", "left").select(
        "report_id", F.coalesce("p.colour", F.lit(FALLBACK["primary"])).alias("primary"), F.coalesce("second", F.lit(FALLBACK["secondary"])).alias("secondary"), F.coalesce("dark", F.lit(FALLBACK["text"])).alias("text"), F.lit(FALLBACK["background"]).alias("background"))


def font_census(pages: DataFrame) -> DataFrame:
    first = F.regexp_replace(F.trim(F.split(F.col("f"), ",")[0]), "^['\"]+|['\"]+$", "")
    every = pages.select("report_id", F.explode(F.regexp_extract_all("css", F.lit(r"(?i)font-family\s*:\s*([^;}\"]+)"), F.lit(1))).alias("f")).select("report_id", first.alias("font"))
    used = every.filter((F.col("font") != "") & ~F.lower("font").isin("inherit", "initial") & ~F.startswith("font", F.lit("var("))).groupBy("report_id", "font").agg(F.count(F.lit(1)).alias("uses"))
    return used.withColumn("rank", F.row_number().over(W.partitionBy("report_id").orderBy(F.desc("uses"), "font")))
