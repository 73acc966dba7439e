"""Issues, decisions and the figures they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figtrail.functions.dates import with_date
from figtrail.functions.numbers import with_number
from figtrail.functions.ordered import numbered
from figtrail.operators.normalise import with_usable_heading

# Names of the checks and how they are grouped.
READING_CHECKS = {"re_extraction": "independent re-reading", "low_confidence": "low reading confidence",
                  "traceability": "source trace"}
CONFIRMING = ["traceability", "second_parser", "re_extraction", "arithmetic", "cross_table"]
CHECKS = ["traceability", "second_parser", "re_extraction", "arithmetic", "cross_table", "period_unit",
          "rendered_page", "completeness", "low_confidence", "schema"]
PAGE_CHECKS = ["rendered_page", "completeness"]
NEVER_WAIVED = ["rendered_page", "schema"]
NOT_SIDE_BY_SIDE = ["rendered_page", "schema", "reviewer_flag", "completeness"]
SECOND_OPINION_CHECKS = ["re_extraction", "low_confidence"]

def _open() -> Column:
    return F.col("status") == "open"


def _blocking() -> Column:
    return F.col("severity") == "blocking"


def _rank(c: str, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))


def fold_duplicates(issues: DataFrame) -> DataFrame:
    """Open findings of the value-reading checks on one figure become one. Only those rows are shuffled, by
    (version, run, figure); the rest pass by."""
    about_value = F.coalesce(F.col("fid").isNotNull() & F.col("check_name").isin(list(READING_CHECKS)) & _open(), F.lit(False))
    order = [F.when(_blocking(), 0).otherwise(1), _rank("check_name", list(READING_CHECKS)), F.col("issue_id")]
    w = W.partitionBy("version_id", "run_no", "fid").orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = F.col("check_name")
    labels = F.create_map(*[F.lit(x) for kv in READING_CHECKS.items() for x in kv])
    also = F.array_sort(F.transform(F.array_except(F.collect_set(own).over(whole), F.array(own)), lambda c: F.element_at(labels, c)))
    folded = (issues.filter(about_value)
              .withColumns({"_n": F.row_number().over(w), "_also": also,
                            "_e": F.first("expected", ignorenulls=True).over(whole),
                            "_a": F.first("actual", ignorenulls=True).over(whole)})
              .filter("_n = 1")
              .withColumns({"message": F.when(F.size("_also") > 0, F.concat("message", F.lit(" Also flagged by: "), F.array_join("_also", ", "), F.lit(".")))
                            .otherwise(F.col("message")),
                            "expected": F.coalesce("expected", "_e"), "actual": F.coalesce("actual", "_a")})
              .drop("_n", "_also", "_e", "_a"))
    return issues.filter(~about_value).unionByName(folded)


def issue_key(check: Column, page: Column, box: Column, message: Column) -> Column:
    """Stable key of a finding that is not about one figure. ``box`` is its JSON text, null when there is none."""
    null = F.lit("null")
    text = F.concat(F.lit('["'), check, F.lit('", '), F.coalesce(page.cast("string"), null), F.lit(", "),
                    F.coalesce(box, null), F.lit(', "'), message, F.lit('"]'))
    return F.substring(F.sha2(text, 256), 1, 24)


def apply_reviews(issues: DataFrame, figures: DataFrame, acks: DataFrame) -> DataFrame:
    """figures: version_id, fid, raw, review_action, review_raw. acks: version_id, issue_key."""
    confirmed = (figures.filter((F.col("review_action") == "confirm") & (F.col("review_raw") == F.col("raw")))
                 .select("version_id", "fid", F.lit(True).alias("_confirmed")).distinct())
    known = acks.select("version_id", F.col("issue_key").alias("_key"), F.lit(True).alias("_acked")).distinct()
    box = F.col("bbox") if "bbox" in issues.columns else F.lit(None).cast("string")
    keyed = issues.withColumn("_key", F.when(F.col("fid").isNull(), issue_key(F.col("check_name"), F.col("page"), box, F.col("message"))))
    waivable = ~F.col("check_name").isin(NEVER_WAIVED)
    by_person, by_ack = waivable & F.col("_confirmed").isNotNull(), waivable & F.col("_acked").isNotNull()
    resolution = F.when(by_ack, "acknowledged").when(by_person, "confirmed")
    if "resolution" in issues.columns:
        resolution = resolution.otherwise(F.col("resolution"))
    return (keyed.join(confirmed, ["version_id", "fid"], "left").join(known, ["version_id", "_key"], "left")
            .withColumn("resolution", resolution)
            .withColumn("status", F.when(by_ack | by_person, "resolved").otherwise(F.col("status")))
            .select(*issues.columns, *([] if "resolution" in issues.columns else ["resolution"])))


def apply_second_opinion(issues: DataFrame, opinions: DataFrame, figures: DataFrame) -> DataFrame:
    """opinions: version_id, fid, seen_raw, agrees, reading. Only an opinion about the current value counts."""
    current = (opinions.join(figures.select("version_id", "fid", "raw"), ["version_id", "fid"])
               .filter(F.col("seen_raw") == F.col("raw")).select("version_id", "fid", "agrees", "reading"))
    asked = F.col("check_name").isin(SECOND_OPINION_CHECKS) & _blocking()
    softened = asked & F.coalesce("agrees", F.lit(False))
    quoted = asked & F.col("agrees").isNotNull() & ~F.col("agrees") & (F.coalesce("reading", F.lit("")) != "")
    return (issues.join(current, ["version_id", "fid"], "left")
            .withColumn("message", F.when(softened, F.concat("message", F.lit(" A second opinion agrees.")))
                        .when(quoted, F.concat("message", F.lit(" A second opinion reads "), "reading", F.lit("."))).otherwise(F.col("message")))
            .withColumn("severity", F.when(softened, "warning").otherwise(F.col("severity"))).select(*issues.columns))


def run_summary(issues: DataFrame, figures: DataFrame, keys: tuple[str, ...] = ("version_id",)) -> DataFrame:
    """Per version: figures, how many have nothing open, and open findings by severity and check."""
    k = list(keys)
    # figures and findings meet in one aggregate; a key that is null meets nothing
    active = figures.filter(F.col("status") == "active").select(*k, "fid", F.lit(True).alias("_active"), F.lit(False).alias("_bad"))
    flagged = issues.filter(_open() & F.col("fid").isNotNull()).dropna(subset=k).select(*k, "fid", F.lit(False).alias("_active"), F.lit(True).alias("_bad"))
    figs = (active.unionByName(flagged).groupBy(*k, "fid").agg(F.max("_active").alias("_active"), F.max("_bad").alias("_bad")).filter("_active")
            .groupBy(*k).agg(F.count(F.lit(1)).alias("figures_checked"), F.count_if(~F.col("_bad")).alias("passed")))
    per_check = (issues.groupBy(*k, "check_name")
                 .agg(F.count_if(_open() & (F.col("severity") == "warning")).alias("w"), F.count_if(_open() & _blocking()).alias("b"),
                      F.count_if(F.col("status") == "resolved").alias("r"), F.count_if(_open()).alias("o")))
    found = (per_check.groupBy(*k).agg(
        F.sum("w").alias("warnings"), F.sum("b").alias("blocking"), F.sum("r").alias("resolved"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("check_name", "o")))).alias("by_check")))
    zero = F.lit(0).cast("bigint")
    return figs.join(found, k, "full").withColumns(
        {c: F.coalesce(c, zero) for c in ("figures_checked", "passed", "warnings", "blocking", "resolved")})


def check_cards(issues: DataFrame, checked: DataFrame, confirmed: DataFrame, versions: DataFrame) -> DataFrame:
    """versions: version_id, has_text_layer, has_scanned. One card per version and check."""
    ran = (F.when(F.col("check_name") == "second_parser", F.col("has_text_layer")).otherwise(F.lit(True)))
    spine = (versions.withColumn("check_name", F.explode(F.array(*[F.lit(c) for c in CHECKS])))
             .withColumns({"ran": ran, "possible": F.when(F.col("has_text_layer"), 9).otherwise(8)}))
    open_now = issues.groupBy("version_id", "check_name").agg(
        F.count_if(_open() & _blocking()).alias("blocking"), F.count_if(_open() & (F.col("severity") == "warning")).alias("warnings"))
    looked = checked.select("version_id", "check_name", "fid").distinct().groupBy("version_id", "check_name").agg(F.count(F.lit(1)).alias("looked"))
    sure = confirmed.select("version_id", "check_name", "fid").distinct().groupBy("version_id", "check_name").agg(F.count(F.lit(1)).alias("sure"))
    zero = F.lit(0).cast("bigint")
    on = ["version_id", "check_name"]
    return (spine.join(open_now, on, "left").join(looked, on, "left").join(sure, on, "left")
            .select(*on, "ran", "possible", F.when(F.col("ran"), F.coalesce("looked", zero)).otherwise(zero).alias("checked"),
                    F.coalesce("sure", zero).alias("confirmed"), F.coalesce("blocking", zero).alias("blocking"),
                    F.coalesce("warnings", zero).alias("warnings")))


def _confirmations(figures: DataFrame, confirmed: DataFrame) -> DataFrame:
    votes = (confirmed.filter(F.col("check_name").isin(CONFIRMING)).select("version_id", "fid", "check_name").distinct()
             .groupBy("version_id", "fid").agg(F.count(F.lit(1)).alias("n")))
    active = figures.filter(F.col("status") == "active").select("version_id", "fid").distinct()
    return active.join(votes, ["version_id", "fid"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def consensus(figures: DataFrame, confirmed: DataFrame) -> DataFrame:
    n = _confirmations(figures, confirmed)
    return n.groupBy("version_id").agg(
        F.count_if(F.col("n") >= 3).alias("three_or_more"), F.count_if(F.col("n") == 2).alias("two"),
        F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 0).alias("none"))


def unconfirmed_figures(figures: DataFrame, confirmed: DataFrame) -> DataFrame:
    active = figures.filter(F.col("status") == "active").select("version_id", "fid").distinct()
    return active.join(confirmed.filter(F.col("check_name").isin(CONFIRMING)), ["version_id", "fid"], "left_anti")


def figure_states(figures: DataFrame, open_issues: DataFrame, confirmed: DataFrame, person_confirmed: DataFrame) -> DataFrame:
    """One status per figure; what is not about a figure still in the document is counted apart."""
    active = figures.filter(F.col("status") == "active").select("version_id", "fid").distinct().withColumn("active", F.lit(True))
    item = F.coalesce(F.concat(F.lit("f"), F.col("fid")), F.concat(F.lit("i"), F.col("issue_id").cast("string")))
    worst = (open_issues.withColumn("item", item).groupBy("version_id", "item").agg(F.max(_blocking()).alias("blocks")))
    votes = _confirmations(figures, confirmed).withColumn("unconfirmed", F.col("n") == 0)
    people = person_confirmed.select("version_id", "fid").distinct().withColumn("by_person", F.lit(True))
    spine = (active.join(votes, ["version_id", "fid"], "left").join(people, ["version_id", "fid"], "left")
             .withColumn("item", F.concat(F.lit("f"), F.col("fid"))))
    both = spine.join(worst, ["version_id", "item"], "full")
    is_fig, blocks, noted = F.col("active").isNotNull(), F.coalesce("blocks", F.lit(False)), F.col("blocks").isNotNull()
    return (both.groupBy("version_id").agg(
        F.count_if(is_fig).alias("figures"), F.count_if(is_fig & ~noted).alias("passed"),
        F.count_if(is_fig & blocks).alias("need_attention"), F.count_if(is_fig & noted & ~blocks).alias("notes"),
        F.count_if(~is_fig & blocks).alias("other_need_attention"), F.count_if(~is_fig & noted & ~blocks).alias("other_notes"),
        F.count_if(is_fig & F.col("unconfirmed") & F.col("by_person").isNull()).alias("not_confirmed"))
        .withColumn("to_decide", F.col("need_attention") + F.col("other_need_attention")))


FACETS = {"severity": "severity", "status": "status", "check": "check_name", "page": "page", "section": "section_id"}


def row_key(fid: Column, status: Column, issue_id: Column) -> Column:
    """What the review list shows as one row: an open figure, or one other item."""
    return F.when(fid.isNotNull() & (status == "open"), F.concat(F.lit("fig:"), fid)).otherwise(F.concat(F.lit("issue:"), issue_id.cast("string")))


def facet_counts(issues: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Leave-one-out options of every facet from one scan: a row offers its value to each facet whose other
    filters it passes, so nothing is read five times."""
    want = {f: str(v) for f, v in filters.items() if v}
    text = {f: F.coalesce(F.col(c).cast("string"), F.lit("")) for f, c in FACETS.items()}

    def passes(skip: str) -> Column:
        cond = F.lit(True)
        for f, v in want.items():
            if f != skip:
                cond = cond & (text[f] == v)
        return cond

    offers = F.array_compact(F.array(*[F.when(passes(f) & (text[f] != ""), F.struct(F.lit(f).alias("facet"), text[f].alias("value"))) for f in FACETS]))
    found = (issues.select("version_id", row_key(F.col("fid"), F.col("status"), F.col("issue_id")).alias("row"), F.explode(offers).alias("o"))
             .select("version_id", "o.facet", "o.value", "row").distinct()
             .groupBy("version_id", "facet", "value").agg(F.count(F.lit(1)).alias("rows")))
    kept = (issues.select("version_id").distinct()
            .withColumn("o", F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value")) for f, v in want.items()])))
            .select("version_id", "o.facet", "o.value")) if want else None
    if kept is None:
        return found
    return found.join(kept, ["version_id", "facet", "value"], "full").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def review_totals(issues: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows the list shows under all filters, split into figures to decide and notes. An item is decided beside the page
    only where it has a place there: a page and a box (x0)."""
    cond = F.lit(True)
    for f, v in filters.items():
        if v:
            cond = cond & (F.coalesce(F.col(FACETS[f]).cast("string"), F.lit("")) == str(v))
    decidable = _open() & F.col("page").isNotNull() & F.col("x0").isNotNull() & ~F.col("check_name").isin(NOT_SIDE_BY_SIDE)
    rows = (issues.withColumns({"row": row_key(F.col("fid"), F.col("status"), F.col("issue_id")), "shown": cond, "fig": cond & decidable})
            .groupBy("version_id", "row").agg(F.max("shown").alias("shown"), F.max("fig").alias("fig")))
    return rows.groupBy("version_id").agg(
        F.count_if("shown").alias("rows"), F.count_if("fig").alias("figures"),
        F.count_if(F.col("shown") & ~F.col("fig")).alias("notes"), F.count(F.lit(1)).alias("all_rows"))


def section_labels(sections: DataFrame) -> DataFrame:
    """sections: report_id, section_id, ord, page, heading, method."""
    df = with_usable_heading(sections, "heading", F.col("method") == "ocr", "_label")
    unnamed = numbered(df.filter(F.col("_label").isNull()), ["report_id", "page"], F.floor(F.col("ord") / 4096), ["ord"], "_n").withColumn(
        "label", F.concat(F.lit("Section on page "), F.coalesce(F.col("page").cast("string"), F.lit("?")),
                          F.when(F.col("_n") > 1, F.concat(F.lit(" · "), F.col("_n").cast("string"))).otherwise("")))
    short = F.when(F.length("_label") > 60, F.concat(F.substring("_label", 1, 57), F.lit("…"))).otherwise(F.col("_label"))
    named = df.filter(F.col("_label").isNotNull()).withColumn("label", F.concat(
        F.coalesce(F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(" · ")), F.lit("")), short))
    return named.drop("_label").unionByName(unnamed.drop("_label", "_n"))


def latest_run_issues(issues: DataFrame) -> DataFrame:
    newest = issues.groupBy("version_id").agg(F.max("run_no").alias("run_no"))
    return issues.join(newest, ["version_id", "run_no"], "left_semi")


def issues_overview(issues: DataFrame, versions: DataFrame, reports: DataFrame, tenants: DataFrame) -> DataFrame:
    """Open findings of each version's newest run; counted before any join, so the joins carry one row per version."""
    counted = (latest_run_issues(issues).filter(_open()).groupBy("version_id")
               .agg(F.count_if(_blocking()).alias("blocking"), F.count_if(~_blocking()).alias("warning")))
    v = versions.select("version_id", "report_id", "version_no", "status")
    r = reports.select("report_id", "tenant_id", F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit(" "), F.upper("period"), F.lit(" "), "report_type").alias("report"))
    t = tenants.select("tenant_id", F.col("name").alias("tenant"))
    return counted.join(v, "version_id").join(r, "report_id").join(t, "tenant_id").select(
        "tenant", "version_id", "version_no", "report", "status", "blocking", "warning")


def issues_by_check(issues: DataFrame) -> DataFrame:
    return (latest_run_issues(issues).filter(_open()).groupBy("check_name")
            .agg(F.count_if(_blocking()).alias("blocking"), F.count_if(~_blocking()).alias("warning")))


def reuse_findings(versions: DataFrame, current_build: str) -> DataFrame:
    """Which checks a version needs: none (same data and page), page checks only (same data, same build of the
    checks), or all. A draft without a run of its own looks at the version it was copied from."""
    own = versions.select("version_id", "created_from", "has_summary", "content_sha", "bundle_sha", "checked_content_sha", "checked_bundle_sha", "build")
    origin = versions.filter("has_summary").select(
        F.col("version_id").alias("created_from"), F.col("checked_content_sha").alias("o_content"), F.col("build").alias("o_build"))
    joined = own.join(origin, "created_from", "left")
    theirs = ~F.col("has_summary")
    same_content = F.when(theirs, F.col("o_content") == F.col("content_sha")).otherwise(F.col("checked_content_sha") == F.col("content_sha"))
    same_build = F.when(theirs, F.col("o_build") == current_build).otherwise(F.col("build") == current_build)
    same_page = F.col("has_summary") & (F.col("checked_bundle_sha") == F.col("bundle_sha"))
    needs = (F.when(same_content & same_page, "none").when(same_content & same_build, "page_only").otherwise("full"))
    return joined.select("version_id", F.when(theirs, F.col("created_from")).otherwise(F.col("version_id")).alias("findings_from"), needs.alias("needs"))


def kept_findings(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings that stand when only the page checks run again, open as a fresh run would find them."""
    page_only = decisions.filter(F.col("needs") == "page_only").select("version_id", F.col("findings_from").alias("source"))
    found = (latest_run_issues(issues).filter(~F.col("check_name").isin([*PAGE_CHECKS, "reviewer_flag"]))
             .withColumn("status", F.lit("open")).withColumnRenamed("version_id", "source"))
    return found.join(page_only, "source").drop("source")


def carry_flags(issues: DataFrame) -> DataFrame:
    """Open reviewer flags move to the newest run of their version."""
    newest = issues.groupBy("version_id").agg(F.max("run_no").alias("_run"))
    moves = (F.col("check_name") == "reviewer_flag") & _open()
    return issues.join(newest, "version_id").withColumn("run_no", F.when(moves, F.col("_run")).otherwise(F.col("run_no"))).drop("_run")


def propagate_decisions(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: issue_id, action. Deciding one item settles the figure's other open items of that run; deciding
    a flag settles its copies in every run."""
    decided = issues.join(decisions, "issue_id").select("issue_id", "version_id", "run_no", "fid", "check_name", "action")
    direct = decided.select("issue_id", F.col("action").alias("_direct"))
    fid = decided.filter(F.col("fid").isNotNull())
    same_run = (fid.filter(F.col("check_name") != "reviewer_flag").groupBy("version_id", "run_no", "fid")
                .agg(F.max_by("action", "issue_id").alias("_same_run")))
    flags = fid.filter(F.col("check_name") == "reviewer_flag").groupBy("version_id", "fid").agg(F.max_by("action", "issue_id").alias("_flag"))
    is_flag = F.col("check_name") == "reviewer_flag"
    action = F.coalesce("_direct", F.when(_open(), F.when(is_flag, F.col("_flag")).when(~F.col("check_name").isin(NEVER_WAIVED), F.col("_same_run"))))
    return (issues.join(direct, "issue_id", "left").join(same_run, ["version_id", "run_no", "fid"], "left").join(flags, ["version_id", "fid"], "left")
            .withColumn("resolution", action)
            .withColumn("status", F.when(F.col("resolution").isNotNull(), "resolved").otherwise(F.col("status")))
            .select(*issues.columns, *([] if "resolution" in issues.columns else ["resolution"])))


def apply_figure_actions(figures: DataFrame, reviews: DataFrame) -> DataFrame:
    """figures: version_id, fid, kind, raw, status. reviews: version_id, fid, at_no, action, raw (the new text of an edit).
    An edit that does not parse as the figure's kind is refused and leaves no trace."""
    kinds = figures.select("version_id", "fid", "kind")
    typed = reviews.join(kinds, ["version_id", "fid"]).withColumn("raw", F.trim("raw"))
    typed = with_date(with_number(typed, "raw", "n_"), "raw", "d_")
    numeric = F.col("kind").isin("number", "percent", "bps", "multiple", "nil")
    ok = (F.col("action") != "edit") | ((F.col("raw") != "") & F.when(numeric, F.col("n_kind").isNotNull())
                                        .when(F.col("kind") == "date", F.col("d_iso").isNotNull()).otherwise(True))
    is_edit = F.col("action") == "edit"
    edited = F.struct("raw", F.when(numeric, F.col("n_kind")).otherwise(F.col("kind")).alias("kind"),
                      F.col("n_value_str").alias("value"), F.col("d_iso").alias("iso"))
    # the verdict stays a column: as a filter it would be pushed below the parsing and repeat it
    typed = typed.withColumns({"_ok": ok, "_new": edited}).withColumn("_at", F.when(F.col("_ok"), F.col("at_no")))
    last = (typed.groupBy("version_id", "fid").agg(
        F.max_by("action", "_at").alias("_last"), F.max(F.when(F.col("_ok") & (F.col("action") == "not_a_figure"), 1)).alias("_out"),
        F.max_by("_new", F.when(is_edit, F.col("_at"))).alias("_edit"), F.max(F.when(F.col("_ok") & is_edit, 1)).alias("_edited")))
    touched = F.col("_edited").isNotNull()
    return (figures.join(last, ["version_id", "fid"], "left").withColumns({
        "raw": F.when(touched, F.col("_edit.raw")).otherwise(F.col("raw")),
        "kind": F.when(touched, F.col("_edit.kind")).otherwise(F.col("kind")),
        "value": F.when(touched, F.col("_edit.value")), "edited": touched,
        "status": F.when(F.col("_out").isNotNull(), "not_a_figure").otherwise(F.col("status")),
        "review_action": F.when(F.col("_last") == "edit", "confirm").otherwise(F.col("_last"))})
        .withColumn("review_raw", F.when(F.col("review_action") == "confirm", F.col("raw")))
        .drop("_last", "_out", "_edit", "_edited"))
