"""Secret scans in DataFrame functions alone: fixed forms, and windows of high entropy in long strings."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex")
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Least entropy of a window in bits a character, by class of its characters.
LEAST = {"entropy_hex": 3.0, "entropy_text": 3.8, "entropy_letters": 4.0}
#: A window that meets one of these (in any case) is part of a placeholder or a list of characters, not of a secret.
ALLOWED = ("example", "sample", "placeholder", "dummy", "changeme", "your_", "0123456789", "abcdefghij", "xxxxxx", "000000")


def either_case(words: tuple[str, ...] = WORDS) -> str:
    """The words as a pattern that takes each ASCII letter in either case and no other letter for it."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


ASSIGN = f"({either_case()})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def term(n: int) -> int:
    """n*log2(n) in millionths, so that sums of it are whole and exact."""
    return round(n * log2(n) * 1e6) if n else 0


def most(bits: float, window: int = WINDOW) -> int:
    """A window has at least `bits` of entropy when its sum of terms is at most this."""
    return term(window) - round(bits * window * 1e6)


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches with their places: array of (start, end, match), code points from 0, end exclusive. The text is
    split at the matches, and the lengths of pieces and matches add up."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def add(state: Column, pair: Column) -> Column:
        at = state["at"] + F.length(pair["piece"])
        end = at + F.length(pair["match"])
        return F.struct(end.alias("at"), F.when(pair["match"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(at.alias("start"), end.alias("end"), pair["match"].alias("match"))))).alias("out"))

    pairs = F.arrays_zip(pieces.alias("piece"), matches.alias("match"))
    pairs = F.transform(pairs, lambda p: F.struct(p["piece"].alias("piece"), p["match"].alias("match")))
    return F.aggregate(pairs, start, lambda s, p: F.when(p["match"].isNull(), s).otherwise(add(s, p)), lambda s: s["out"])


def high_entropy(candidate: Column, excused: Column | None = None, window: int = WINDOW) -> Column:
    """Stretches of a string in which every window of `window` characters is of high entropy for its class: array of
    (start, end, kind). Hexadecimal windows of one case are a class, other windows of letters with digits the next, windows
    of letters with one digit at most the third. Windows that meet an excused stretch (array of start, end) do not count. The
    window slides by one character: the counts of the character that leaves and of the one that enters change, and with
    them the sum of terms."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    terms = F.array(*[F.lit(term(n)) for n in range(window + 2)])
    span = "array<struct<start:int,end:int,kind:string>>"
    state = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(SYMBOLS)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("hexes"), F.lit(0).alias("capital_hexes"), F.lit(0).alias("letters"),
                     F.array().cast(span).alias("out"))
    digit = lambda c: (c.between(1, 10)).cast("int")
    hexa = lambda c: (c.between(1, 16)).cast("int")
    capital_hexa = lambda c: (c.between(1, 10) | c.between(37, 42)).cast("int")
    letter = lambda c: (c.between(11, 62)).cast("int")

    def slide(codes: Column):
        def step(s: Column, new: Column) -> Column:
            full = s["i"] >= window
            old = F.when(full, F.element_at(codes, F.greatest(s["i"] - window + 1, F.lit(1)))).otherwise(F.lit(0))
            had_old = F.when(full, F.element_at(s["counts"], F.greatest(old, F.lit(1)))).otherwise(F.lit(0))
            had_new = F.element_at(s["counts"], new) - F.when(old == new, 1).otherwise(0)
            at = lambda n: F.element_at(terms, n + 1)
            total = s["sum"] + F.when(full, at(had_old - 1) - at(had_old)).otherwise(F.lit(0)) + at(had_new + 1) - at(had_new)
            counts = F.when(old == new, s["counts"]).otherwise(F.transform(s["counts"], lambda n, k: n + F.when(k + 1 == new, 1).when(k + 1 == old, -1).otherwise(0)))
            return F.struct((s["i"] + 1).alias("i"), counts.alias("counts"), total.cast("long").alias("sum"), (s["digits"] + digit(new) - digit(old)).alias("digits"), (s["hexes"] + hexa(new) - hexa(old)).alias("hexes"),
                            (s["capital_hexes"] + capital_hexa(new) - capital_hexa(old)).alias("capital_hexes"),
                            (s["letters"] + letter(new) - letter(old)).alias("letters"), s["out"].alias("out"))

        def judged(s: Column, new: Column) -> Column:
            return F.aggregate(F.array(step(s, new)), s, lambda _, n: note(n))

        def note(n: Column) -> Column:
            mixed = (n["digits"] >= 2) & (n["letters"] >= 2)
            hexes = (n["hexes"] == window) | (n["capital_hexes"] == window)
            kind = (F.when(n["i"] < window, F.lit(None).cast("string"))
                    .when(mixed & hexes, F.when(n["sum"] <= most(LEAST["entropy_hex"], window), F.lit("entropy_hex")))
                    .when(mixed, F.when(n["sum"] <= most(LEAST["entropy_text"], window), F.lit("entropy_text")))
                    .when((n["letters"] >= window - 1) & (n["letters"] + n["digits"] == window) & (n["sum"] <= most(LEAST["entropy_letters"], window)), F.lit("entropy_letters")))
            if excused is not None:
                kind = F.when(~F.exists(excused, lambda e: (e["start"] < n["i"]) & (e["end"] > n["i"] - window)), kind)
            last = F.when(F.size(n["out"]) > 0, F.element_at(n["out"], -1))
            fresh = F.struct((n["i"] - window).alias("start"), n["i"].alias("end"), kind.alias("kind"))
            joins = F.coalesce((last["kind"] == kind) & (last["end"] >= n["i"] - window), F.lit(False))
            longer = F.struct(last["start"].alias("start"), n["i"].alias("end"), kind.alias("kind"))
            out = F.when(kind.isNull(), n["out"]).when(joins, F.concat(F.slice(n["out"], F.lit(1), F.size(n["out"]) - 1), F.array(longer))).otherwise(F.concat(n["out"], F.array(fresh)))
            return F.struct(n["i"].alias("i"), n["counts"].alias("counts"), n["sum"].alias("sum"), n["digits"].alias("digits"), n["hexes"].alias("hexes"), n["capital_hexes"].alias("capital_hexes"), n["letters"].alias("letters"), out.cast(span).alias("out"))

        return judged

    one = F.struct(codes.alias("codes"))
    # the codes are bound once as the element of a one-element array, so that a step reads and does not remake them
    return F.flatten(F.transform(F.array(one), lambda x: F.aggregate(x["codes"], state, slide(x["codes"]), lambda s: s["out"])))


def _tagged(no: int, kind: str) -> Column:
    return F.transform(f"_{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("no"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in order, comma
    joined), n_added. Added spans are stretches of high entropy that no base span covers and no allowed word excuses.

    Texts are read whole, row by row, without a shuffle; a null text counts as empty, null and repeated ids are kept as
    they are, other columns are ignored, and an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    rows = rows.withColumn("_long", text.rlike(CANDIDATE))
    rows = rows.withColumn("_assign", F.when(text.rlike(ASSIGN), F.filter(located(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6)).otherwise(none))
    # an access key and a long hexadecimal run are candidates too
    for name, pattern in (("_access", ACCESS), ("_hex", HEX), ("_found", CANDIDATE)):
        rows = rows.withColumn(name, F.when(F.col("_long"), located(text, pattern)).otherwise(none))
    tagged = [_tagged(no, k) for no, k in enumerate(KINDS)]
    rows = rows.withColumn("_base", F.array_sort(F.concat(*tagged)))
    # a word of the list excuses the windows it meets, not the rest of a long string
    words = "|".join(allowed)
    excused = lambda m: F.when(F.lower(m["match"]).rlike(words), located(F.lower(m["match"]), words)).otherwise(none) if allowed else None
    moved = lambda m: lambda s: F.struct((m["start"] + s["start"]).alias("start"), F.lit(len(KINDS)).alias("no"), (m["start"] + s["end"]).alias("end"), s["kind"].alias("kind"))
    rows = rows.withColumn("_raw", F.flatten(F.transform("_found", lambda m: F.transform(high_entropy(m["match"], excused(m)), moved(m)))))
    rows = rows.withColumn("_added", F.filter("_raw", lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text_of(F.col("_base")), 256).alias("base_sha256"),
                       text_of(F.array_sort(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_added"))
