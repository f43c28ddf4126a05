"""Secret scans by multipart credential linking, in DataFrame functions only.

Each text is scanned once for strong spans (assignments, access keys, long hexadecimal strings) and for weak parts
(identifiers such as login names, opaque tokens, endpoints). Only spans' lengths and gaps leave the scan; running sums
turn them into places. A weak part is reported if complementary parts start within `scope` code points of its start,
found by a range window over each row's spans, which is an interval join that never pairs spans up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between the starts of two linked parts at most.
SCOPE = 256

# Kinds in their order, with the pattern, the group that is measured, and its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "weak_id": (r"""(?i)\b(user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 2, 3),
    "weak_secret": (r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    "endpoint": (r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+", 0, 8),
}
BASE = 3
# Words one of which stands in any text that a pattern fits; looked for before the pattern, in lower case.
HINTS = {
    "assign": ("password", "passwd", "secret", "token", "api"),
    "access": ("akia",),
    "weak_id": ("user", "login", "account", "client", "access"),
    "endpoint": ("://",),
}

_PART = "array<struct<kind: int, place: int, gap: int, len: int, fits: boolean>>"


def _parts(text: Column, low: Column, number: int, kind: str) -> Column:
    """Every match of a kind in text, in order: what lies between it and the one before, its length, and if it counts."""
    pattern, group, least = KINDS[kind]
    regex = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value")
    )

    def part(x: Column, i: Column) -> Column:
        fits = F.length(x["value"]) >= least
        if kind == "weak_secret":
            fits &= x["whole"].rlike("[0-9]") & x["whole"].rlike("[A-Za-z]")
        return F.struct(F.lit(number).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("len"), fits.alias("fits"))

    made = F.filter(F.transform(zipped, part), lambda x: x["len"].isNotNull())
    hint = F.lit(False)
    for word in HINTS.get(kind, ()):
        hint |= low.contains(word)
    if kind not in HINTS:
        hint = text.rlike(pattern.replace(",}", "}"))
    return F.when(hint, made).otherwise(F.array().cast(_PART))


def located(docs: DataFrame, keep: list[str], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The columns `keep` of each row, and `found`: its spans in order, array<struct<start, kind, end>> with kinds by number.

    Every row gives one row, repeated rows too; a null text has no spans. Rows meet by a number of their own, so no
    group is larger than the spans of one text.
    """
    content, low = F.col("__text"), F.col("__low")
    scanned = docs.select(F.struct(*keep).alias("__kept"), F.monotonically_increasing_id().alias("__row"), F.coalesce(text, F.lit("")).alias("__text"))
    scanned = scanned.withColumn("__low", F.lower("__text"))
    every = F.concat(*(_parts(content, low, n, kind) for n, kind in enumerate(KINDS)))
    one = scanned.select("__row", "__kept", F.posexplode_outer(every).alias("at", "p"))
    one = one.select("__row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("__kept")).alias("__kept"), "p.*").repartition("__row")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("__row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    placed = one.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("len"))

    number = {kind: n for n, kind in enumerate(KINDS)}
    near = Window.partitionBy("__row").orderBy("start").rangeBetween(-scope, scope)
    before = Window.partitionBy("__row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)

    def any_of(*kinds: str) -> Column:
        hit = F.col("fits") & F.col("kind").isin([number[k] for k in kinds])
        return F.coalesce(F.max(hit).over(near), F.lit(False))

    linked = placed.withColumns({
        "has_id": any_of("access", "weak_id"), "has_secret": any_of("assign", "hex", "weak_secret"),
        "covered": F.coalesce(F.max(F.when(F.col("fits") & (F.col("kind") < BASE), F.col("end"))).over(before) > F.col("start"), F.lit(False)),
    })
    needs = {"weak_id": F.col("has_secret"), "weak_secret": F.col("has_id"), "endpoint": F.col("has_id") & F.col("has_secret")}
    reported = F.col("kind") < BASE
    for kind, need in needs.items():
        reported |= (F.col("kind") == number[kind]) & need & ~F.col("covered")
    span = F.when(F.col("fits") & reported, F.struct("start", "kind", "end"))
    grouped = linked.groupBy("__row").agg(F.first("__kept", ignorenulls=True).alias("__kept"), F.array_sort(F.collect_list(span)).alias("found"))
    return grouped.select("__kept.*", "found")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row; n_linked counts the weak parts reported.

    Places are code points, ends exclusive. A null or empty text has no spans; an empty table gives no rows.
    """
    found = located(docs, ["doc_id"], scope=scope)
    base = F.filter("found", lambda s: s["kind"] < BASE)

    def number(n: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == n)).cast("long")

    count = [number(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS) if n < BASE]
    linked = F.size(F.filter("found", lambda s: s["kind"] >= BASE)).cast("long").alias("n_linked")
    return found.select("doc_id", *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), linked)


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars", scope: int = SCOPE) -> DataFrame:
    """docs with each run of overlapping spans replaced by [SECRET]; `length`, if docs has it, becomes the new length.

    Rows without spans, null texts among them, are unchanged; columns of any other names stay as they are. Repeated rows
    stay, and an empty table gives an empty one.
    """
    kept = docs.select(F.struct("*").alias("__doc"), F.col(text).alias("__content"))
    found = located(kept, ["__doc"], "__content", scope)
    whole = F.col(f"__doc.{text}")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        gap = F.substring(whole, done["at"] + 1, s["start"] - done["at"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, F.concat(done["out"], F.array(gap, F.lit("[SECRET]")))).otherwise(done["out"]).alias("out"))

    made = F.aggregate("found", start, step, lambda done: F.concat(F.array_join(done["out"], ""), F.substring(whole, done["at"] + 1, F.length(whole))))
    hit = F.size("found") > 0
    new = found.withColumn("__new", F.when(hit, made).otherwise(whole))
    fresh = {text: F.col("__new")}
    if length in docs.columns:
        fresh[length] = F.when(hit, F.length("__new").cast(docs.schema[length].dataType)).otherwise(F.col(f"__doc.{length}"))
    return new.select(*((fresh[c] if c in fresh else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns))
