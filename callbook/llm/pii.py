"""PII: base identifiers by pattern, and more by bootstrapped contextual extraction. DataFrame functions only.

Base spans of four kinds (email, ip, card, phone) come from fixed patterns and checks. They are the seeds: the last
words and signs before a span are a lexical pattern for its kind. The corpus's other identifier-like tokens are
candidates, with the patterns before them. Spark scores the pattern-instance graph in rounds: a pattern's confidence
for a kind is the share of its distinct slot values that are known instances of the kind, counted when at least
`min_values` known values in `min_docs` documents support it; a value's score is the noisy-or of the confidences of
the patterns it follows. Values that reach `min_score` become instances: in the next round they support every pattern
they follow anywhere, so new patterns arise, and their occurrences after confident patterns are added as spans. Base
spans always stay.

The graph has one edge per distinct (pattern, value), so rounds work on aggregated rows. Only rows that hold a digit or
an @ are searched, once; what is found is a table in the shared folder, and so are each round's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.llm.common import row_key, saved

KINDS = ("email", "ip", "card", "phone")

# A run of an email's first part can only begin where the run begins or where the match before ended; saying so keeps
# long runs without an @ from being tried from each of their characters. Possessive repeats keep no way back, so a domain of
# any number of labels needs no stack. The same matches come as without all this.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Identifier-like: a token of 6 or more letters, digits, _ or - with a digit in it.
CANDIDATE = r"(?<![A-Za-z0-9_@.+-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
SPAN = "array<struct<kind:int,start:long,end:long,value:string,left:string>>"
HITS = "array<struct<kind:int,i:int,gap:int,value:string,left:string>>"
OPEN = -1  # the kind of a candidate
CONTEXT = 3  # words or signs before a slot


def _has(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _left(before: Column) -> Column:
    """The last words or signs of what stands before a slot, lower-cased: words of any length, however far off.

    The text is read from its end, so only these units are looked at and not all that stands before them.
    """
    tail = F.reverse(F.regexp_extract(F.reverse(before), rf"\A\s*+(?:(?:[\p{{L}}\p{{N}}]++|[^\s\p{{L}}\p{{N}}])\s*+){{0,{CONTEXT}}}", 0))
    units = F.regexp_extract_all(F.lower(tail), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0)
    return F.array_join(F.slice(units, F.greatest(F.lit(1), F.size(units) - CONTEXT + 1), F.lit(CONTEXT)), " ")


def _matches(text: Column, number: int, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches: their number, the length of what stands before each since the last one, and its end."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda b, v: F.struct(b.alias("between"), v.alias("value")))

    def hit(pair: Column, i: Column) -> Column:
        return F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(pair["between"]).alias("gap"), pair["value"].alias("value"), _left(pair["between"]).alias("left"))

    return F.when(_has(kind, text), F.transform(pairs, hit)).otherwise(F.array().cast(HITS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), add)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), small)


CHECKS = {"email": lambda v: F.lit(True), "ip": _octets, "card": _luhn, "phone": lambda v: F.length(_digits(v)).between(9, 15)}


def _search(scanned: DataFrame) -> DataFrame:
    """Rows (k1, k2, kind, start, end, value, left): checked base spans, and with kind -1 candidates that meet none of them.

    Places are running sums over a text's matches, and whether a candidate meets a base span is the running maximum of
    the ends of those that begin before it ends, so the work is linear (but for sorting) in the number of matches.
    """
    searched = [_matches(F.col("text"), i, kind, PATTERNS[kind]) for i, kind in enumerate(KINDS)]
    hits = F.concat(*searched, _matches(F.col("text"), OPEN, "candidate", CANDIDATE))
    one = scanned.select("k1", "k2", hits.alias("hits")).dropDuplicates(["k1", "k2"])
    so_far = Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    placed = one.select("k1", "k2", F.inline("hits")).withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    valid = F.lit(True)
    for i, kind in enumerate(KINDS):
        valid = F.when(F.col("kind") == i, CHECKS[kind](F.col("value"))).otherwise(valid)
    is_open = F.col("kind") == OPEN
    begun = Window.partitionBy("k1", "k2").orderBy(F.when(is_open, F.col("end") - 1).otherwise(F.col("start")), is_open).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(~is_open, F.col("end"))).over(begun)
    free = placed.where(valid).withColumn("reach", reach).where(~is_open | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    return free.select("k1", "k2", "kind", "start", "end", "value", "left")


def _number_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _grow(seeds: DataFrame, open_: DataFrame, rounds: int, min_values: int, min_docs: int, min_conf: float, min_score: float) -> DataFrame:
    """Accepted (left, value, kind) of candidates after the rounds."""
    slots = saved(open_.groupBy("left", "value").agg(F.countDistinct("k1").alias("docs")), "slots")
    known = saved(seeds.groupBy("left", "kind", "value").agg(F.countDistinct("k1").alias("docs")), "known")
    best = None
    for _ in range(rounds):
        # accepted values count in all their contexts, not only in those that made them accepted
        instances = known if best is None else known.unionByName(slots.join(best, "value").select("left", "kind", "value", "docs"))
        support = instances.groupBy("left", "kind").agg(F.countDistinct("value").alias("good"), F.sum("docs").alias("docs")).where((F.col("good") >= min_values) & (F.col("docs") >= min_docs) & (F.col("left") != ""))
        # all values that stand in the pattern's slot, of any kind or none
        filled = known.select("left", "value").unionByName(slots.select("left", "value")).groupBy("left").agg(F.countDistinct("value").alias("all"))
        patterns = support.join(filled, "left").select("left", "kind", (F.col("good") / F.col("all")).alias("conf")).where(F.col("conf") >= min_conf)
        scored = slots.join(saved(patterns, "patterns"), "left")
        value = scored.groupBy("value", "kind").agg((1 - F.product(1 - F.col("conf") * 0.999)).alias("score")).where(F.col("score") >= min_score)
        best = saved(value.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")), "taken")
    return scored.join(best, ["value", "kind"]).select("left", "value", "kind")


def find(docs: DataFrame, rounds: int = 2, min_values: int = 5, min_docs: int = 5, min_conf: float = 0.6, min_score: float = 0.7) -> DataFrame:
    """docs with base (array of spans), n_email, n_ip, n_card, n_phone (of base), added and spans (base and added).

    Null text counts as empty. Repeated rows get the same result each. Columns named like the results are replaced. Texts are
    searched whole, and the work is linear in a text's length and number of matches, up to sorting these.
    """
    docs = docs.drop("base", "added", "spans", *[f"n_{k}" for k in KINDS])
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.where(text.rlike("[0-9@]")).select(*row_key("doc_id", "text"), "text")
    found = saved(_search(scanned), "pii")
    seeds, open_ = found.where(F.col("kind") != OPEN), found.where(F.col("kind") == OPEN).drop("kind")
    grown = _grow(seeds, open_, rounds, min_values, min_docs, min_conf, min_score)
    taken = seeds.withColumn("is_base", F.lit(True)).unionByName(open_.join(grown, ["left", "value"]).withColumn("is_base", F.lit(False)))
    span = F.struct("kind", "start", "end", "value", "left")
    parts = [F.sort_array(F.collect_list(F.when(which, span))).alias(name) for name, which in (("base", F.col("is_base")), ("added", ~F.col("is_base")))]
    spans = taken.groupBy("k1", "k2").agg(*parts)
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    out = keyed.join(spans, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")
    none = F.array().cast(SPAN)
    return out.withColumns({c: F.coalesce(F.col(c).cast(SPAN), none) for c in ("base", "added")}).withColumns(
        {f"n_{k}": _number_of(i) for i, k in enumerate(KINDS)}
        | {"spans": F.sort_array(F.concat("base", "added"))}
    ).drop("_k1", "_k2", "k1", "k2")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = [f"n_{k}" for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))
