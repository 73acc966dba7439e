"""Stored files, exports and the checks that read the built pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrail.functions.text import core_of, has_digit, once
from figtrail.session import cut

# What is exported, and the export's columns in order.
EXPORT_KINDS = ["number", "percent", "bps", "multiple", "nil", "date"]
EXPORT_ROLES = ["cell", "text", "chart_label"]
EXPORT_COLUMNS = ["id", "section", "table_id", "row_label", "col_label", "period", "raw", "value", "kind", "unit", "currency", "source_page", "source_bbox", "method", "confidence"]


def digit_tokens(text: Column, apart: str = r"\s+") -> Column:
    """Number-bearing words. Split and filtered, because a search for them is quadratic in a long word without digits."""
    return F.filter(F.split(text, apart), has_digit)


def export_rows(figures: DataFrame, sections: DataFrame) -> DataFrame:
    kept = figures.filter((F.col("status") == "active") & F.col("kind").isin(EXPORT_KINDS) & F.col("role").isin(EXPORT_ROLES))
    slugs = sections.select("report_id", "section_id", F.col("slug").alias("section"))
    return kept.join(slugs, ["report_id", "section_id"], "left").select("report_id", F.col("fid").alias("id"), "section", "table_id", "row_label", "col_label", "period", "raw",
        F.when(F.col("kind") == "date", F.col("iso")).otherwise(F.col("value")).alias("value"), "kind", "unit", "currency", F.col("page").alias("source_page"),
        F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")]).alias("source_bbox"), "method", "confidence")


def export_figures(figures: DataFrame, sections: DataFrame, path: str, form: str = "csv") -> None:
    """One folder per report. Rows are gathered by report first (a large report stays several tasks), so a task writes few files."""
    out = export_rows(figures, sections).select("report_id", *EXPORT_COLUMNS).hint("rebalance", "report_id").write.mode("overwrite").partitionBy("report_id")
    out.option("header", True).csv(path) if form == "csv" else out.json(path)


def markdown_lines(blocks: DataFrame) -> DataFrame:
    """blocks: report_id, ord, kind (heading, paragraph, table_row, stat), texts array -> one Markdown line each, bars escaped."""
    safe = F.transform("texts", lambda x: F.replace(x, F.lit("|"), F.lit("\\|")))
    line = (F.when(F.col("kind") == "heading", F.concat(F.lit("## "), F.array_join(safe, "")))
            .when(F.col("kind") == "table_row", F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |")))
            .when(F.col("kind") == "stat", F.concat(F.lit("**"), F.get(safe, 0), F.lit(":** "), F.get(safe, 1))).otherwise(F.array_join(safe, "")))
    return blocks.select("report_id", "page", "ord", line.alias("line"))


def assemble_markdown(blocks: DataFrame) -> DataFrame:
    """One Markdown text per page of a report, lines in order: a report's file is its pages appended, so no report has
    to fit one task."""
    lines = markdown_lines(blocks)
    return lines.groupBy("report_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda e: e["line"]), "\n").alias("markdown"))


def dedupe_sources(uploads: DataFrame) -> DataFrame:
    """uploads: tenant_id, content, filename, at_no. One row per workspace and content; the last name given stands."""
    return (uploads.withColumn("sha256", F.sha2("content", 256)).groupBy("tenant_id", "sha256")
            .agg(F.max_by("filename", F.struct("at_no", "filename")).alias("filename"), F.count(F.lit(1)).alias("uploads"), F.max(F.length("content")).alias("size")))


def site_manifest(live: DataFrame, files: DataFrame) -> DataFrame:
    """live: report_id, version_id, bundle_key. files: version_id, rel. Every path a site answers, index pages also under
    their folder."""
    rows = live.join(files, "version_id").select("report_id", "version_id", F.concat(F.lit("/"), "rel").alias("path"), F.concat("bundle_key", F.lit("/"), "rel").alias("key"))
    index = rows.filter(F.endswith("path", F.lit("/index.html"))).withColumn("path", F.regexp_replace("path", "index\\.html$", ""))
    return rows.unionByName(index)


def sitemap(live: DataFrame, files: DataFrame) -> DataFrame:
    """live: … base_path, published_at. Addresses with the day they last changed."""
    base = live.select("report_id", "version_id", "base_path", F.to_date("published_at").alias("lastmod"))
    pages = base.join(files, "version_id").filter(F.endswith("rel", F.lit("/index.html")) & (F.concat(F.lit("/"), "rel") != F.concat("base_path", F.lit("index.html")))).select(
        "report_id", F.regexp_replace(F.concat(F.lit("/"), "rel"), "index\\.html$", "").alias("loc"), "lastmod")
    own = base.select("report_id", F.explode(F.array("base_path", F.concat("base_path", F.lit("report.md")))).alias("loc"), "lastmod")
    return own.unionByName(pages)


def content_identity(figures: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Hash of a document's figures without people's decisions. Each figure is hashed where it lies; a document's hashes are
    added up in four parts, so the order does not matter, sums combine before the shuffle and the state is five numbers
    however long the document."""
    one = figures.select(*keys, F.sha2(F.to_json(F.struct(*fields)), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    summed = one.groupBy(*keys).agg(F.count(F.lit(1)).cast("string").alias("n"), *parts)
    return summed.select(*keys, F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("content_sha"))


def bundle_identity(files: DataFrame) -> DataFrame:
    """files: version_id, rel, content -> hash over names and content hashes, in name order."""
    one = files.select("version_id", "rel", F.sha2("content", 256).alias("h"))
    return one.groupBy("version_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", "h"))), lambda e: F.concat(e["rel"], F.lit("\t"), e["h"])), "\n"), 256).alias("bundle_sha"))


# ------------------------------------------------------------------ C11, C12

def _word_spread(page_words: DataFrame) -> DataFrame:
    """On how many pages of its report a word is, and the first and last of them: all that has to be known of a common
    word, and every page of one that is on two at most. Reduced before the shuffle, so no word is a hot key."""
    return page_words.groupBy("report_id", "word").agg(F.count(F.lit(1)).alias("on_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def pages_drawn(html: DataFrame) -> DataFrame:
    """Pages whose printed artwork a site shows."""
    urls = F.concat(F.regexp_extract_all("html", F.lit(r"(?:src|srcset)=\"([^\"]*)\""), F.lit(1)), F.regexp_extract_all("html", F.lit(r"url\(([^)]*)\)"), F.lit(1)))
    art = html.select("report_id", F.explode(urls).alias("u")).select("report_id", F.explode(F.regexp_extract_all("u", F.lit(r"pages/p([0-9]{4})\b"), F.lit(1))).alias("p"))
    return art.select("report_id", F.col("p").cast("bigint").alias("page")).distinct()


def check_text_on_site(page_words: DataFrame, site_words: DataFrame, drawn: DataFrame) -> DataFrame:
    """page_words: report_id, page, word (distinct). A page is judged by the words on at most two pages of its report, or by
    all where these are under three. The words of whole pages are looked up on the site only where the own ones miss."""
    page = ["report_id", "page"]
    site = site_words.select("report_id", "word").distinct().withColumn("there", F.lit(True))
    rare = _word_spread(page_words).filter("on_pages <= 2").join(site, ["report_id", "word"], "left")
    own = rare.select("report_id", F.explode(F.array_distinct(F.array("first_page", "last_page"))).alias("page"), "there").groupBy(*page).agg(F.count(F.lit(1)).alias("own"), F.count("there").alias("own_site"))
    per = page_words.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).join(own, page, "left").fillna(0, ["own", "own_site"])
    unsure = cut(per.filter(F.when(F.col("own") >= 3, F.col("own_site") < F.col("own") * 0.5).otherwise(F.col("n") >= 3)))
    found = page_words.join(unsure.select(*page), page, "left_semi").join(site, ["report_id", "word"], "left_semi").groupBy(*page).agg(F.count(F.lit(1)).alias("n_site"))
    judged = unsure.join(found, page, "left").fillna(0, ["n_site"])
    pool, hits = F.when(F.col("own") >= 3, F.col("own")).otherwise(F.col("n")), F.when(F.col("own") >= 3, F.col("own_site")).otherwise(F.col("n_site"))
    bad = (pool >= 3) & (hits < pool * 0.5) & (F.col("n_site") < F.col("n") * 0.7)
    return judged.filter(bad).join(drawn, page, "left_anti").select(*page, F.lit("completeness").alias("check_name"), F.lit("warning").alias("severity"), pool.alias("judged"), hits.alias("found"))


def check_page_coverage(page_map: DataFrame, page_words: DataFrame, pictures: DataFrame) -> DataFrame:
    """page_map: report_id, page, shown, own_section, title. pictures: report_id, page, pictures. A page only repeats others when
    none of its words is on it alone."""
    page = ["report_id", "page"]
    alone = _word_spread(page_words).filter("on_pages = 1").select("report_id", F.col("first_page").alias("page")).distinct().withColumn("alone", F.lit(True))
    per = page_words.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).join(alone, page, "left")
    df = page_map.filter(~F.col("shown").isin("left_out", "cover")).join(per, page, "left").join(pictures, page, "left")
    titled, zero = F.coalesce("title", F.lit("")) != "", F.lit(0)
    skip = F.col("n").isNotNull() & F.col("alone").isNull() & ~titled
    problem = (F.when(skip, None).when(titled & (F.col("shown") != "none") & ~F.col("own_section"), "no section of its own")
               .when((F.col("shown") == "none") & (F.coalesce("pictures", zero) > 0) & (F.coalesce("n", zero) < 3), "picture page missing"))
    return df.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*page, "problem", F.lit("completeness").alias("check_name"), F.lit("warning").alias("severity"))


# ------------------------------------------------------------------ C14–C16: every number on a page is a figure or a label

def _trimmed(tok: Column) -> Column:
    return F.regexp_replace(tok, r"^[,.;:()]+|[,.;:()]+$", "")


def allowed_tokens(meta: DataFrame) -> DataFrame:
    """meta: report_id, meta_key, meta_value. Number-bearing words of a report's own labels."""
    return meta.select("report_id", F.explode(F.split(F.trim("meta_value"), r"\s+")).alias("token")).filter(has_digit(F.col("token"))).distinct()


def check_rendered(pieces: DataFrame, figures: DataFrame, meta: DataFrame) -> DataFrame:
    """pieces as ``scan_html`` with report_id and name."""
    figs = figures.select("report_id", F.col("fid").alias("ref"), F.col("raw").alias("f_raw"), F.col("status").alias("f_status"))
    shown = F.trim("text")
    fig = pieces.filter(F.col("kind") == "figure").join(figs, ["report_id", "ref"], "left").withColumn("actual", shown)
    unknown = F.col("f_raw").isNull() & has_digit(F.col("actual"))
    excluded = (F.col("f_status") != "active") & has_digit(F.col("actual")) & (F.col("actual") != F.col("f_raw"))
    differs = (F.col("f_status") == "active") & (F.col("actual") != F.trim("f_raw"))
    fig = fig.withColumn("problem", F.when(unknown, "unknown figure").when(excluded, "excluded value shown differently").when(differs, "differs from the document"))
    labels = meta.select("report_id", F.col("meta_key").alias("ref"), F.col("meta_value"))
    lab = (pieces.filter((F.col("kind") == "label") & has_digit(F.col("text"))).join(labels, ["report_id", "ref"], "left").withColumn("actual", shown)
           .withColumn("problem", F.when(~F.col("actual").eqNullSafe(F.col("meta_value")), "label differs")))
    loose = pieces.filter(F.col("kind") == "text").withColumn("actual", F.explode(digit_tokens(F.col("text")))).withColumn("problem", F.lit("number is no figure"))
    attr = pieces.filter(F.col("kind") == "attribute").withColumn("actual", F.explode(digit_tokens(F.col("text")))).withColumn("token", _trimmed(F.col("actual")))
    attr = attr.join(allowed_tokens(meta), ["report_id", "token"], "left_anti").withColumn("problem", F.lit("number in attributes is no label"))
    cols = ["report_id", "name", "piece_no", "ref", "problem", "actual"]
    out = fig.filter(F.col("problem").isNotNull()).select(*cols)
    for part in (lab.filter(F.col("problem").isNotNull()), loose, attr):
        out = out.unionByName(part.select(*cols))
    return out.withColumns({"check_name": F.lit("rendered_page"), "severity": F.lit("blocking")})


# Keys of structured data that hold addresses or types, not text.
SKIPPED_KEYS = "@context|@type|url|@id|contentUrl|sameAs|encodingFormat|isBasedOn"


def check_jsonld(pieces: DataFrame, meta: DataFrame) -> DataFrame:
    blocks = pieces.filter(F.col("kind") == "json_ld").select("report_id", "name", "piece_no", "text")
    blocks = once(blocks, {"valid": F.expr("try_parse_json(text)").isNotNull()})
    invalid = blocks.filter(~F.col("valid")).select("report_id", "name", "piece_no", F.lit("not valid JSON").alias("problem"), F.lit(None).cast("string").alias("actual"))
    kept = F.regexp_replace("text", rf"\"(?:{SKIPPED_KEYS})\"\s*:\s*(?:\"[^\"]*\"|\[[^\]]*\]|\{{[^}}]*\}}|[^,}}\]]+)", "")
    kept = F.regexp_replace(kept, r"\"[^\"]*\"\s*:", "")
    strings = F.filter(F.regexp_extract_all(kept, F.lit(r"\"([^\"]*)\""), F.lit(1)), lambda s: ~s.rlike("^(https?:)?//|^/"))
    bare = F.regexp_extract_all(F.regexp_replace(kept, r"\"[^\"]*\"", " "), F.lit(r"(-?[0-9][0-9.eE+-]*)"), F.lit(1))
    toks = F.concat(F.flatten(F.transform(strings, lambda s: digit_tokens(s))), bare)
    found = blocks.filter("valid").withColumn("actual", F.explode(toks)).withColumn("token", _trimmed(F.col("actual")))
    other = found.join(allowed_tokens(meta), ["report_id", "token"], "left_anti").select("report_id", "name", "piece_no", F.lit("number is no label").alias("problem"), "actual")
    return invalid.unionByName(other).withColumns({"check_name": F.lit("rendered_page"), "severity": F.lit("blocking")})


def check_markdown(lines: DataFrame, figures: DataFrame, meta: DataFrame) -> DataFrame:
    """lines: report_id, line_no, line. Every number-bearing word is a figure, a word of one, or a label's."""
    text = F.regexp_replace("line", r"\]\([^)]*\)", "]")
    toks = lines.select("report_id", "page", "line_no", F.explode(digit_tokens(text, r"[\s|]+")).alias("actual"))
    core = F.regexp_replace("actual", "^[*_`,;:]+|[*_`,;:]+$", "")
    forms = toks.withColumn("token", F.explode(F.array_distinct(F.array(F.col("actual"), F.regexp_replace("actual", "[,;:]+$", ""), core, core_of(core)))))
    raws = figures.select("report_id", F.explode(F.concat(F.array("raw"), F.split("raw", " "))).alias("token"))
    known = raws.unionByName(allowed_tokens(meta)).distinct()
    fine = forms.join(known, ["report_id", "token"], "left_semi").select("report_id", "page", "line_no", "actual").distinct()
    return toks.join(fine, ["report_id", "page", "line_no", "actual"], "left_anti").select("report_id", "page", "line_no", "actual", F.lit("rendered_page").alias("check_name"), F.lit("blocking").alias("severity"))
