"""Pieces of DuckDB text shared by the oracles. Written against the printed forms, not against the Spark code."""

from __future__ import annotations

CUR = r"₹|Rs\.?|INR|US\$|USD|\$|€|EUR|£|GBP"
NUM = (rf"^(?:({CUR}))?\s?(\()?(?:({CUR}))?\s?([-−–])?(\d[\d,]*(?:\.\d+)?)(\s?%)?(\))?(\s?(?:%|bps|x|X))?$")
MON = (r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|"
       r"Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?")
UNIT_RX = (rf"(?i)(?:({CUR}))?\s*(?:in\s+)?(?:({CUR}))?\s*"
           r"(crores?|cr\.?|lakhs?|lacs?|millions?|mn|billions?|bn|thousands?|''000)\b")


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def number(source: str, col: str = "raw", p: str = "") -> str:
    """source plus kind, value (decimal), value_str, scale, grouping, currency_symbol, negative."""
    return f"""
    SELECT * EXCLUDE ({p}nm_s, {p}nm, {p}nm_g, {p}nm_k, {p}nm_ok, {p}nm_plain),
      CASE WHEN {p}nm_s IN ('-','–','—','‐','nil','Nil','NIL') THEN 'nil' WHEN {p}nm_ok THEN {p}nm_k END AS {p}kind,
      CASE WHEN {p}nm_ok THEN TRY_CAST({p}nm_plain AS DECIMAL(38,10)) END AS {p}value,
      CASE WHEN {p}nm_ok THEN {p}nm_plain END AS {p}value_str,
      CASE WHEN {p}nm_ok THEN CAST(length(regexp_extract({p}nm_plain, '\\.(\\d+)', 1)) AS INT) END AS {p}scale,
      CASE WHEN {p}nm_s IN ('-','–','—','‐','nil','Nil','NIL') THEN 'none' WHEN {p}nm_ok THEN {p}nm_g END AS {p}grouping,
      CASE WHEN {p}nm_ok AND {p}nm.a || {p}nm.c <> '' THEN {p}nm.a || {p}nm.c END AS {p}currency_symbol,
      CASE WHEN {p}nm_s IN ('-','–','—','‐','nil','Nil','NIL') THEN FALSE WHEN {p}nm_ok THEN {p}nm.b <> '' OR {p}nm.d <> '' END AS {p}negative
    FROM (SELECT *,
      ({p}nm.e <> '' AND ({p}nm.b <> '') = ({p}nm.g <> '') AND NOT ({p}nm.a <> '' AND {p}nm.c <> '') AND NOT ({p}nm.b <> '' AND {p}nm.d <> '')
       AND {p}nm_g IS NOT NULL AND NOT ({p}nm.f <> '' AND {p}nm.h <> '') AND NOT ({p}nm_k <> 'number' AND {p}nm.a || {p}nm.c <> '')) AS {p}nm_ok,
      (CASE WHEN {p}nm.b <> '' OR {p}nm.d <> '' THEN '-' ELSE '' END) || regexp_replace(replace({p}nm.e, ',', ''), '^0+(\\d)', '\\1') AS {p}nm_plain
    FROM (SELECT *,
      CASE WHEN NOT contains({p}nm.e, ',') THEN 'none'
           WHEN regexp_matches({p}nm.e, '^\\d{{1,2}}(,\\d\\d)*,\\d{{3}}(\\.\\d+)?$') AND regexp_matches({p}nm.e, '^\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?$') THEN 'both'
           WHEN regexp_matches({p}nm.e, '^\\d{{1,2}}(,\\d\\d)*,\\d{{3}}(\\.\\d+)?$') THEN 'indian'
           WHEN regexp_matches({p}nm.e, '^\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?$') THEN 'international' END AS {p}nm_g,
      CASE WHEN {p}nm.f <> '' OR trim({p}nm.h) = '%' THEN 'percent' WHEN trim({p}nm.h) = 'bps' THEN 'bps' WHEN trim({p}nm.h) IN ('x', 'X') THEN 'multiple' ELSE 'number' END AS {p}nm_k
    FROM (SELECT *, {trim(col)} AS {p}nm_s, regexp_extract({trim(col)}, '{NUM}', ['a','b','c','d','e','f','g','h']) AS {p}nm FROM ({source}))))"""


def signature(source: str, col: str = "raw", out: str = "signature") -> str:
    return f"""SELECT * EXCLUDE (sg_kind, sg_value, sg_value_str, sg_scale, sg_grouping, sg_currency_symbol, sg_negative),
      CASE WHEN sg_kind IS NULL THEN regexp_replace({col}, '[^0-9.]', '', 'g') WHEN sg_kind = 'nil' THEN 'nil'
           ELSE sg_value_str || CASE sg_kind WHEN 'percent' THEN '%' WHEN 'bps' THEN 'bps' WHEN 'multiple' THEN 'x' ELSE '' END END AS {out}
      FROM ({number(source, col, 'sg_')})"""


def date(source: str, col: str = "raw", p: str = "") -> str:
    """source plus iso, precision, ambiguous."""
    yr = lambda x: f"CASE WHEN length({x}) = 4 THEN {x} ELSE '20' || {x} END"
    mo = lambda x: f"lpad(CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower({x}[1:3])) + 2) // 3 AS VARCHAR), 2, '0')"
    d = lambda y, m, dd: f"TRY_CAST(({y}) || '-' || lpad({m}, 2, '0') || '-' || lpad({dd}, 2, '0') AS DATE)"
    n, i, f1, f2, mm = (f"{p}dt_n", f"{p}dt_i", f"{p}dt_f", f"{p}dt_m", f"{p}dt_o")
    return f"""
    SELECT * EXCLUDE ({p}dt_s, {n}, {i}, {f1}, {f2}, {mm}, {p}dt_1, {p}dt_2, {p}dt_d),
      COALESCE(CAST({p}dt_d AS VARCHAR), CASE WHEN {n}.y = '' AND NOT {i} AND {f1}.y = '' AND {f2}.y = '' AND {mm}.y <> '' THEN ({yr(mm + '.y')}) || '-' || {mo(mm + '.m')} END) AS {p}iso,
      CASE WHEN {p}dt_d IS NOT NULL THEN 'day' WHEN {n}.y = '' AND NOT {i} AND {f1}.y = '' AND {f2}.y = '' AND {mm}.y <> '' THEN 'month' END AS {p}precision,
      CASE WHEN {p}dt_d IS NOT NULL THEN {n}.y <> '' AND ({p}dt_1 IS NULL OR ({p}dt_2 IS NOT NULL AND {p}dt_1 <> {p}dt_2))
           WHEN {n}.y = '' AND NOT {i} AND {f1}.y = '' AND {f2}.y = '' AND {mm}.y <> '' THEN FALSE END AS {p}ambiguous
    FROM (SELECT *, CASE WHEN {n}.y <> '' THEN COALESCE({p}dt_1, {p}dt_2) WHEN {i} THEN TRY_CAST({p}dt_s AS DATE)
        WHEN {f1}.y <> '' THEN {d(yr(f1 + '.y'), mo(f1 + '.m'), f1 + '.d')} WHEN {f2}.y <> '' THEN {d(yr(f2 + '.y'), mo(f2 + '.m'), f2 + '.d')} END AS {p}dt_d
    FROM (SELECT *, {d(yr(n + '.y'), n + '.b', n + '.a')} AS {p}dt_1, {d(yr(n + '.y'), n + '.a', n + '.b')} AS {p}dt_2
    FROM (SELECT *, regexp_extract({p}dt_s, '^(\\d{{1,2}})[./-](\\d{{1,2}})[./-](\\d{{4}}|\\d{{2}})$', ['a','b','y']) AS {n},
      regexp_matches({p}dt_s, '^\\d{{4}}-\\d\\d-\\d\\d$') AS {i},
      regexp_extract({p}dt_s, '(?i)^(\\d{{1,2}})(?:st|nd|rd|th)?[\\s-]{MON}[\\s,-]*(\\d{{4}}|\\d{{2}})$', ['d','m','y']) AS {f1},
      regexp_extract({p}dt_s, '(?i)^{MON}\\s(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s(\\d{{4}}|\\d{{2}})$', ['m','d','y']) AS {f2},
      regexp_extract({p}dt_s, '(?i)^{MON}[\\s''-]*(\\d{{4}}|\\d{{2}})$', ['m','y']) AS {mm}
    FROM (SELECT *, regexp_replace({trim(col)}, ',+$', '') AS {p}dt_s FROM ({source})))))"""


def end_year(a: str, b: str) -> str:
    s = f"(CASE WHEN length({a}) = 4 THEN TRY_CAST({a} AS INT) ELSE 2000 + TRY_CAST({a} AS INT) END)"
    e = f"({s} // 100 * 100 + TRY_CAST({b} AS INT))"
    return (f"(CASE WHEN COALESCE({b}, '') = '' THEN {s} WHEN length({b}) = 4 THEN TRY_CAST({b} AS INT) "
            f"WHEN {e} < {s} THEN {e} + 100 ELSE {e} END)")


def label_year(x: str) -> str:
    bare = f"regexp_split_to_array(regexp_replace(regexp_replace({x}, '\\s', '', 'g'), '^[''’]+', ''), '[-–/]')"
    return end_year(f"({bare})[1]", f"({bare})[2]")


def period(source: str, col: str = "label", p: str = "period_", columns_too: bool = True) -> str:
    """source plus type, number, fiscal_year, end_date, key."""
    fy = r"(?:FY|F\.Y\.?)\s?''?(\d{4}\s?[-/]\s?\d{2,4}|\d{2,4})"
    inner = f"""SELECT *, regexp_replace({trim(col)}, '\\s+', ' ', 'g') AS pd_s, {trim(col)} AS pd_t FROM ({source})"""
    inner = f"""SELECT *, regexp_extract(pd_s, '(?i)^(?:(?:Q([1-4])|H([12])|(9)\\s?M)\\s?[-'']?\\s?)?{fy}$', ['q','h','n','y']) AS pd_l,
      regexp_extract(pd_s, '(?i)^(quarter|three months|3 months|half[- ]year|six months|6 months|nine months|9 months|year|twelve months|12 months)\\s+ended\\s+(?:on\\s+)?(.+)$', ['w','d']) AS pd_e,
      regexp_replace(pd_t, '(?i)^as\\s+(at|on)\\s+', '') AS pd_a,
      regexp_extract(pd_t, '^(?:.*\\s)?((?:19|20)\\d\\d)$', 1) AS pd_y FROM ({inner})"""
    inner = date(f"SELECT *, pd_e.d AS pd_ed FROM ({inner})", "pd_ed", "pde_")
    inner = date(inner, "pd_a", "pda_")
    ok = "TRUE" if columns_too else "FALSE"
    inner = f"""SELECT *, CASE WHEN pd_l.y <> '' THEN CASE WHEN pd_l.q <> '' THEN 'quarter' WHEN pd_l.h <> '' THEN 'half' WHEN pd_l.n <> '' THEN 'nine_months' ELSE 'year' END
        WHEN pde_precision = 'day' THEN CASE WHEN lower(pd_e.w) IN ('quarter','three months','3 months') THEN 'quarter' WHEN lower(pd_e.w) IN ('half-year','half year','six months','6 months') THEN 'half'
             WHEN lower(pd_e.w) IN ('nine months','9 months') THEN 'nine_months' ELSE 'year' END
        WHEN {ok} AND pda_precision = 'day' THEN 'as_at' WHEN {ok} AND pd_y <> '' THEN 'year' END AS {p}type,
      CASE WHEN pd_l.y <> '' AND pd_l.q <> '' THEN TRY_CAST(pd_l.q AS INT) WHEN pd_l.y <> '' AND pd_l.h <> '' THEN TRY_CAST(pd_l.h AS INT) END AS {p}number,
      CASE WHEN pd_l.y <> '' THEN {label_year('pd_l.y')} WHEN pde_precision = 'day' OR ({ok} AND pda_precision = 'day') THEN NULL WHEN {ok} AND pd_y <> '' THEN TRY_CAST(pd_y AS INT) END AS {p}fiscal_year,
      CASE WHEN pd_l.y <> '' THEN NULL WHEN pde_precision = 'day' THEN pde_iso WHEN {ok} AND pda_precision = 'day' THEN pda_iso END AS {p}end_date
      FROM ({inner})"""
    return f"""SELECT * EXCLUDE (pd_s, pd_t, pd_l, pd_e, pd_a, pd_y, pd_ed, pde_iso, pde_precision, pde_ambiguous, pda_iso, pda_precision, pda_ambiguous),
      CASE WHEN {p}type IS NULL THEN NULL WHEN {p}end_date IS NOT NULL AND {p}fiscal_year IS NULL THEN {p}type || '@' || {p}end_date
           ELSE {p}type || COALESCE(CAST({p}number AS VARCHAR), '') || ':FY' || {p}fiscal_year END AS {p}key FROM ({inner})"""


def core(x: str) -> str:
    tail = f"(CASE WHEN contains({x}, '(') THEN regexp_replace({x}, '[,;:.!?]+$', '') ELSE regexp_replace({x}, '[,;:.!?)]+$', '') END)"
    return f"(CASE WHEN contains({tail}, ')') THEN {tail} ELSE regexp_replace({tail}, '^\\(+', '') END)"


def section_type(x: str) -> str:
    from figtrail.operators.normalise import SECTION_RULES
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{rx}') THEN '{t}'" for t, rx in SECTION_RULES) + " ELSE 'other' END"


def agent(x: str) -> str:
    from figtrail.operators.normalise import AGENT_NEEDLES, OTHER_AGENT
    whens = " ".join(f"WHEN contains(lower({x}), '{n.lower()}') THEN 'bot:{b}'" for n, b in AGENT_NEEDLES)
    return f"CASE {whens} WHEN regexp_matches(lower({x}), '{OTHER_AGENT}') THEN 'bot:Other' ELSE 'human' END"


def change(x: str) -> str:
    return (f"CASE WHEN regexp_matches(lower({x}), 'yoy|y-o-y|year on year') THEN 'yoy' WHEN regexp_matches(lower({x}), 'qoq|q-o-q|sequential|quarter on quarter') THEN 'qoq' "
            f"WHEN regexp_matches(lower({x}), '% change|growth') OR trim(lower({x})) IN ('change','% chg','chg %','var %','% var') THEN 'change' END")


def half_even(x: str, places: int) -> str:
    """Banker's rounding of a decimal expression."""
    return f"round_even({x}, {places})"
