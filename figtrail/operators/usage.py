"""The spending ledger, plans and budgets (U1–U11). Money is decimal throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figtrail.functions.ordered import numbered, running_sum

# Prices in USD per million tokens, the value of one credit, feature labels and plan allowances.
PRICES = [("gemini", "0.30", "2.50"), ("anthropic", "2.00", "10.00")]
CREDITS_PER_USD = 100
FEATURES = {"ai_check": "AI double-check of flagged figures", "section_labels": "AI section labelling",
            "page_layout": "AI layout of design pages", "chapters": "AI chapter detection for the sidebar"}
PLANS = [("free", 50), ("starter", 500), ("pro", 2000), ("enterprise", None)]
# What a request costs in tokens.
CROPS_PER_REQUEST, CROP_TOKENS, CROP_LABEL_TOKENS, CROP_PROMPT_TOKENS, CROP_OUTPUT_TOKENS = 12, 258, 8, 160, 18
LAYOUT_PROMPT_TOKENS, LAYOUT_ELEMENT_TOKENS, LAYOUT_BASE_OUTPUT, LAYOUT_ELEMENT_OUTPUT, BUSY_PAGE = 1800, 45, 40, 6, 100
LABEL_PROMPT_TOKENS, LABEL_SECTION_TOKENS, LABEL_OUTPUT_TOKENS = 300, 150, 1024
AUTO_CHECK_CREDITS = 20
LAYOUT_RETRY_SECONDS = 6 * 3600
LAYOUT_VERSION = "5"


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, price_in string, price_out string").select(
        "provider", F.col("price_in").cast("decimal(10,4)").alias("price_in"), F.col("price_out").cast("decimal(10,4)").alias("price_out"))


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, plan_credits bigint")


def _micro_usd(provider: str, tokens_in: Column, tokens_out: Column) -> Column:
    """Exact millionths of a dollar."""
    _, pin, pout = next(p for p in PRICES if p[0] == provider)
    return tokens_in.cast("decimal(18,0)") * F.lit(pin).cast("decimal(10,4)") + tokens_out.cast("decimal(18,0)") * F.lit(pout).cast("decimal(10,4)")


def shown(credits: Column) -> Column:
    """Credits as displayed and compared with a limit: rounded up."""
    return F.ceil(F.greatest(credits, F.lit(0))).cast("bigint")


def credits_for(provider: str, tokens_in: Column, tokens_out: Column) -> Column:
    return shown(_micro_usd(provider, tokens_in, tokens_out).cast("decimal(28,4)") / F.lit(10000).cast("decimal(5,0)"))


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """The price table has one row per provider; the planner broadcasts it by its size."""
    micro = (F.col("input_tokens").cast("decimal(18,0)") * F.col("price_in") + F.col("output_tokens").cast("decimal(18,0)") * F.col("price_out")).cast("decimal(28,4)")
    return (usage.join(prices, "provider").withColumns({
        "usd": F.bround(micro / F.lit(1000000).cast("decimal(7,0)"), 6).cast("decimal(12,6)"),
        "credits": F.bround(micro / F.lit(10000).cast("decimal(5,0)"), 4).cast("decimal(12,4)")}).drop("price_in", "price_out"))


def _month_of(usage: DataFrame, month_start: str) -> DataFrame:
    start = F.lit(month_start).cast("timestamp_ntz")
    return usage.filter((F.col("created_at") >= start) & (F.col("created_at") < F.add_months(F.lit(month_start).cast("date"), 1).cast("timestamp_ntz")))


def month_credits(usage: DataFrame, month_start: str) -> DataFrame:
    return (usage.filter(F.col("created_at") >= F.lit(month_start).cast("timestamp_ntz")).groupBy("tenant_id")
            .agg(shown(F.sum("credits")).alias("used")))


def month_allowance(tenants: DataFrame, usage: DataFrame, month_start: str) -> DataFrame:
    used = F.coalesce("used", F.lit(0).cast("bigint"))
    return tenants.join(month_credits(usage, month_start), "tenant_id", "left").select(
        "tenant_id", F.col("credit_limit").alias("limit"), used.alias("used"),
        F.when(F.col("credit_limit").isNotNull(), F.greatest(F.lit(0), F.col("credit_limit") - used)).alias("remaining"),
        F.coalesce(used >= F.col("credit_limit"), F.lit(False)).alias("limit_reached"))


def feature_label(c: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in FEATURES.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.col(c)), F.col(c))


def usage_by_feature(usage: DataFrame, month_start: str) -> DataFrame:
    """By tenant and feature, with a total row per tenant, from one grouping-sets aggregate."""
    month = usage.filter(F.col("created_at") >= F.lit(month_start).cast("timestamp_ntz"))
    out = month.groupingSets([["tenant_id", "feature"], ["tenant_id"]], "tenant_id", "feature").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.bround(F.sum("usd"), 4).alias("usd"), shown(F.sum("credits")).alias("credits"))
    return out.withColumn("label", F.when(F.col("feature").isNull(), "Total").otherwise(feature_label("feature")))


def report_label() -> Column:
    year = F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))
    return F.when(F.col("company_name").isNotNull(), F.concat(F.col("company_name"), F.lit(" · "), F.when(F.col("period") == "fy", year)
                  .otherwise(F.concat(F.upper("period"), F.lit(" "), year))))


def _with_report(usage: DataFrame, versions: DataFrame, reports: DataFrame) -> DataFrame:
    v = versions.select("version_id", "report_id", "version_no")
    r = reports.select("report_id", "company_name", "period", "fiscal_year")
    return usage.join(v, "version_id", "left").join(r, "report_id", "left")


def recent_usage(usage: DataFrame, versions: DataFrame, reports: DataFrame, tenant_id, n: int) -> DataFrame:
    """The newest n are taken before the joins."""
    top = usage.filter(F.col("tenant_id") == tenant_id).orderBy(F.desc("created_at"), F.desc("usage_id")).limit(n)
    return _with_report(top, versions, reports).withColumns({"report": report_label(), "label": feature_label("feature")}).orderBy(
        F.desc("created_at"), F.desc("usage_id"))


def usage_months(usage: DataFrame, month_start: str) -> DataFrame:
    first = F.add_months(F.lit(month_start).cast("date"), -11).cast("timestamp_ntz")
    return (usage.filter(F.col("created_at") >= first).groupBy("tenant_id", F.date_format("created_at", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("requests"), shown(F.sum("credits")).alias("credits"), F.bround(F.sum("usd"), 4).alias("usd")))


def usage_by_report(usage: DataFrame, versions: DataFrame, reports: DataFrame, month_start: str) -> DataFrame:
    """Reduced to (tenant, version, feature) before the joins, then to reports."""
    small = _month_of(usage, month_start).groupBy("tenant_id", "version_id", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("credits").alias("c"), F.sum("usd").alias("u"))
    per_feature = _with_report(small, versions, reports).groupBy("tenant_id", "report_id", "company_name", "period", "fiscal_year", "feature").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("u").alias("u"), F.collect_set("version_no").alias("vs"))
    return per_feature.groupBy("tenant_id", "report_id", "company_name", "period", "fiscal_year").agg(
        F.sum("n").alias("requests"), shown(F.sum("c")).alias("credits"), F.bround(F.sum("u"), 4).alias("usd"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", shown(F.col("c")).alias("credits"))))).alias("features"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))).alias("versions")).withColumn("report", report_label())


def usage_page(usage: DataFrame, versions: DataFrame, reports: DataFrame, tenant_id, month_start: str, page: int, size: int) -> DataFrame:
    rows = (_month_of(usage, month_start).filter(F.col("tenant_id") == tenant_id)
            .orderBy(F.desc("created_at"), F.desc("usage_id")).offset((max(1, page) - 1) * size).limit(size))
    return _with_report(rows, versions, reports).withColumns({"report": report_label(), "label": feature_label("feature")})


def export_month(usage: DataFrame, versions: DataFrame, reports: DataFrame, month_start: str, path: str) -> None:
    """A whole month for a spreadsheet, one folder per tenant; written by the executors."""
    rows = _with_report(_month_of(usage, month_start), versions, reports)
    (rows.select("tenant_id", F.col("created_at").alias("time_utc"), report_label().alias("report"), F.col("version_no").alias("version"),
                 feature_label("feature").alias("feature"), "provider", "model", "input_tokens", "output_tokens", "usd", "credits",
                 F.col("ok").alias("succeeded"))
     .write.mode("overwrite").partitionBy("tenant_id").option("header", True).csv(path))


def plan_allowances(tenants: DataFrame, plans: DataFrame) -> DataFrame:
    plan = F.coalesce("plan", F.lit("free"))
    return (tenants.withColumn("plan", plan).join(plans, "plan", "left")
            .withColumn("allowance", F.coalesce("plan_credits", F.col("credit_limit").cast("bigint"))).drop("plan_credits"))


def check_credits(n: Column) -> dict[str, Column]:
    """What double-checking n figures costs at most."""
    calls = F.ceil(n / CROPS_PER_REQUEST).cast("bigint")
    tokens_in = n * (CROP_TOKENS + CROP_LABEL_TOKENS) + calls * CROP_PROMPT_TOKENS
    tokens_out = n * CROP_OUTPUT_TOKENS
    return {"requests": calls, "input_tokens": tokens_in, "output_tokens": tokens_out, "credits": credits_for("gemini", tokens_in, tokens_out)}


def spend_estimates(reports: DataFrame, most_sections: int | None = None) -> DataFrame:
    """reports: report_id, page_count. Upper bounds per build option. Two sections a page are priced for labelling, at
    most ``most_sections`` where the caller sends no more than that."""
    pages = F.greatest(F.lit(0), F.col("page_count") - 1)
    layout = credits_for("gemini", pages * (LAYOUT_PROMPT_TOKENS + LAYOUT_ELEMENT_TOKENS * BUSY_PAGE),
                         pages * (LAYOUT_BASE_OUTPUT + LAYOUT_ELEMENT_OUTPUT * BUSY_PAGE))
    sections = F.greatest(F.lit(1), F.col("page_count")) * 2
    if most_sections is not None:
        sections = F.least(F.lit(most_sections), sections)
    labels = credits_for("anthropic", sections * LABEL_SECTION_TOKENS + LABEL_PROMPT_TOKENS, F.lit(LABEL_OUTPUT_TOKENS))
    return reports.withColumns({"layout_credits": layout, "label_credits": labels, "check_credits": F.lit(AUTO_CHECK_CREDITS).cast("bigint")}).withColumns(
        {"max_layout": F.col("layout_credits"), "max_full": F.col("layout_credits") + F.col("label_credits") + F.col("check_credits")})


def second_opinion_queue(issues: DataFrame, figures: DataFrame, budgets: DataFrame, answers: DataFrame) -> DataFrame:
    """Open blocking figures worth a second look, images first, then by the figure's own page, as many as each version's
    budget pays for. figures: version_id, fid, raw, method, page, x0 (null where the figure has no box and cannot be shown).
    answers: version_id, fid, raw, the value that was looked at; a figure that still has it is not paid for again. The
    cost of the first n rises with n, so the cut is a filter on the rank."""
    asked = (issues.filter((F.col("status") == "open") & (F.col("severity") == "blocking") & F.col("fid").isNotNull()
                           & F.col("check_name").isin("re_extraction", "low_confidence"))
             .select("version_id", "fid").distinct())
    shown = figures.filter(F.col("x0").isNotNull()).select("version_id", "fid", "raw", "page", (F.col("method") != "ocr").alias("from_text"))
    ready = shown.join(asked, ["version_id", "fid"], "left_semi").join(answers.select("version_id", "fid", "raw"), ["version_id", "fid", "raw"], "left_anti").drop("raw")
    ranked = numbered(ready, ["version_id"], F.struct("from_text", "page"), ["from_text", "page", "fid"], "rank")
    cost = check_credits(F.col("rank"))["credits"]
    return ranked.withColumn("cost", cost).join(budgets, "version_id").filter(F.col("cost") <= F.col("budget")).drop("budget")


def page_fingerprints(elements: DataFrame) -> DataFrame:
    """elements: report_id, page, element_id, kind, x0..y1, text -> fingerprint and element count per page."""
    one = F.concat_ws("|", F.col("element_id").cast("string"), "kind", *[F.bround(c, 0).cast("bigint").cast("string") for c in ("x0", "y0", "x1", "y1")], "text")
    return elements.groupBy("report_id", "page").agg(
        F.substring(F.sha2(F.concat(F.lit(LAYOUT_VERSION + "\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("element_id", one.alias("sig")))), lambda e: e["sig"]), "\n")), 256), 1, 16).alias("fingerprint"),
        F.count(F.lit(1)).alias("elements"))


def layout_queue(pages: DataFrame, cache: DataFrame, budgets: DataFrame, now: str) -> DataFrame:
    """pages: report_id, page, fingerprint, elements. cache: report_id, page, fingerprint, has_layout, failed_at.
    Pages still to lay out, in order, up to the first one over the report's budget. Costs are positive, so
    "nothing went over before" is the running sum staying within the budget."""
    age = F.lit(now).cast("timestamp_ntz") - F.col("failed_at")
    settled = cache.filter(F.col("has_layout") | (F.col("failed_at").isNotNull() & (age < F.expr(f"INTERVAL '{LAYOUT_RETRY_SECONDS}' SECOND"))))
    todo = pages.join(settled, ["report_id", "page", "fingerprint"], "left_anti")
    micro = _micro_usd("gemini", F.col("elements") * LAYOUT_ELEMENT_TOKENS + LAYOUT_PROMPT_TOKENS, F.col("elements") * LAYOUT_ELEMENT_OUTPUT + LAYOUT_BASE_OUTPUT)
    priced = todo.withColumn("cost", (micro.cast("decimal(28,4)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(20,6)"))
    summed = running_sum(priced, ["report_id"], F.floor(F.col("page") / 1024), ["page"], "cost", "spent")
    return summed.join(budgets, "report_id").filter(F.col("spent") <= F.col("budget")).drop("budget")
