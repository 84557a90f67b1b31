"""Raw extractions to calls and claims with a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.functions import text as X
from callbook.functions.zones import call_defects, claim_defects

PRICES = ("entry", "target", "stop")
#: Entry types that need a price, and what warnings, emptied fields and a milder class cost in confidence.
PRICED_ENTRIES = ("limit", "trigger_above", "trigger_below")
PER_WARNING, PER_EMPTIED, PER_MILDER = 0.15, 0.25, 0.20


def _bounded(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _noted(*notes: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), text) for condition, text in notes]))


def _in_universe(raw: DataFrame, universe: DataFrame) -> DataFrame:
    """raw with `known`: whether its ticker is one of the universe's. The universe is a list of companies, so Spark may broadcast it by its size."""
    return raw.join(universe.select("ticker", F.lit(True).alias("known")).distinct(), "ticker", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def validate_calls(raw: DataFrame, universe: DataFrame) -> DataFrame:
    """Raw calls with what they keep of their prices and entry type, failures, warnings, emptied, rule_confidence, final_confidence and status.

    raw: ticker, ticker_evidence, direction_evidence, source, entry_type, overall_confidence, market_price, timeframe and,
    for entry, target and stop, <name>_price and <name>_evidence. A ticker outside the universe, or whose quote the source
    lacks, rejects the call with confidence 0. A price without its quote, or further than half from a known market price,
    is emptied with its evidence; an entry that then lacks its price becomes unspecified.
    """
    rows = _in_universe(raw, universe)
    source = F.col("source")
    quoted = {p: X.evidence_in_source(F.col(f"{p}_evidence"), source) for p in PRICES}
    price = {p: F.col(f"{p}_price") for p in PRICES}
    stated = {p: F.when(quoted[p], price[p]) for p in PRICES}
    kept = {p: X.plausible_price(stated[p], F.col("market_price")) for p in PRICES}
    far = {p: stated[p].isNotNull() & kept[p].isNull() for p in PRICES}
    rows = rows.withColumns({f"_{p}": kept[p] for p in PRICES} | {f"_{p}_far": far[p] for p in PRICES})
    rows = rows.withColumn("emptied", _noted(*[(price[p].isNotNull() & F.col(f"_{p}").isNull(), f"{p}_price") for p in PRICES]))
    unknown, unquoted = ~F.col("known"), ~X.evidence_in_source(F.col("ticker_evidence"), source)
    unsupported = ~X.evidence_in_source(F.col("direction_evidence"), source)
    loose = F.col("entry_type").isin(*PRICED_ENTRIES) & F.col("_entry").isNull()
    failures = F.when(unknown, F.array(F.lit("ticker_not_in_universe"))).when(unquoted, F.array(F.lit("ticker_evidence_not_in_source"))).otherwise(_noted((unsupported, "direction_evidence_not_in_source")))
    out = rows.withColumns({"failures": failures, "dead": unknown | unquoted, "loose": loose})
    notes = _noted((unsupported, "direction_evidence_unsupported"), *[(F.col(f"_{p}_far"), f"{p}_price_implausible") for p in PRICES], (F.col("loose"), "entry_type_downgraded"))
    out = out.withColumn("warnings", F.when(F.col("dead"), F.array().cast("array<string>")).otherwise(notes)).withColumn("emptied", F.when(F.col("dead"), F.array().cast("array<string>")).otherwise(F.col("emptied")))
    rule = F.when(F.col("dead"), 0.0).otherwise(_bounded(1.0 - PER_WARNING * F.size("warnings") - PER_EMPTIED * F.size("emptied")))
    told = F.coalesce(F.col("timeframe") != "unspecified", F.lit(False)).cast("int")
    filled = sum((F.col(f"_{p}").isNotNull().cast("int") for p in PRICES), told)
    out = out.withColumn("rule_confidence", rule).withColumn("final_confidence", F.when(F.col("dead"), 0.0).otherwise(X.final_confidence(F.col("overall_confidence"), F.col("rule_confidence"), filled)))
    out = out.withColumns({"entry_type": F.when(F.col("loose"), "unspecified").otherwise(F.col("entry_type")), "status": X.decide_status(F.col("final_confidence"), F.size("failures") > 0)})
    out = out.withColumns({f"{p}_evidence": F.when(F.col(f"_{p}").isNotNull(), F.col(f"{p}_evidence")) for p in PRICES} | {f"{p}_price": F.col(f"_{p}") for p in PRICES})
    return out.drop("known", "dead", "loose", *[f"_{p}" for p in PRICES], *[f"_{p}_far" for p in PRICES])


def validate_claims(raw: DataFrame, universe: DataFrame) -> DataFrame:
    """Raw claims with failures, warnings, the class that stays, rule_confidence, final_confidence and status.

    raw: ticker (null: a sector or the whole market), evidence_quote, source, claim_class, overall_confidence. A quote
    that the source lacks, or a ticker outside the universe, rejects the claim with confidence 0; a factual claim whose
    quote hedges becomes an opinion. The final confidence is the mean of the model's and the rules'.
    """
    rows = _in_universe(raw, universe)
    unquoted = ~X.evidence_in_source(F.col("evidence_quote"), F.col("source"))
    unknown = F.col("ticker").isNotNull() & ~F.col("known")
    milder = (F.col("claim_class") == "factual") & X.has_hedge(F.col("evidence_quote"))
    failures = F.when(unquoted, F.array(F.lit("claim_evidence_not_in_source"))).when(unknown, F.array(F.lit("claim_ticker_not_in_universe"))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumns({"failures": failures, "milder": F.coalesce(milder, F.lit(False))})
    failed = F.size("failures") > 0
    out = out.withColumn("warnings", F.when(failed, F.array().cast("array<string>")).otherwise(_noted((F.col("milder"), "claim_class_downgraded"))))
    rule = F.when(failed, 0.0).otherwise(1.0 - F.when(F.col("milder"), PER_MILDER).otherwise(0.0))
    out = out.withColumn("rule_confidence", rule).withColumn("final_confidence", F.when(failed, 0.0).otherwise((F.col("overall_confidence") + F.col("rule_confidence")) / 2))
    status = F.when(failed, "rejected").when(F.col("final_confidence") >= 0.5, "accepted").otherwise("pending_review")
    return out.withColumns({"claim_class": F.when(~failed & F.col("milder"), "opinion").otherwise(F.col("claim_class")), "status": status}).drop("known", "milder")


def windowed(raw: DataFrame, windows: DataFrame) -> DataFrame:
    """C17: raw extractions (document_id, cluster) with the text and span of the candidate window that they were made from.

    windows are those of candidate_windows. Extractions of a window that isn't there have no source and fail with their quotes.
    """
    kept = windows.select("document_id", "cluster", F.col("context").alias("source"), "context_start", "context_end", F.element_at("first_segment_ids", 1).alias("primary_segment_id"))
    return raw.drop("source").join(kept, ["document_id", "cluster"], "left")


def _whole(raw: DataFrame, defects: Column) -> tuple[DataFrame, DataFrame]:
    """Raw rows that can stand, and the others with their defects as failures, rejected with confidence 0."""
    marked = raw.withColumn("_defects", defects)
    bad = marked.where(F.size("_defects") > 0).withColumns(
        {"failures": F.transform("_defects", lambda d: F.concat(F.lit("malformed_"), d)), "warnings": F.array().cast("array<string>"), "rule_confidence": F.lit(0.0), "final_confidence": F.lit(0.0), "status": F.lit("rejected")}
    )
    return marked.where(F.size("_defects") == 0).drop("_defects"), bad.drop("_defects")


def extract_calls(raw: DataFrame, universe: DataFrame) -> DataFrame:
    """C17: raw calls through T34, then T10 and T12: a call whose parts contradict each other is rejected before it is checked against its source."""
    good, bad = _whole(raw, call_defects())
    return validate_calls(good, universe).unionByName(bad.withColumn("emptied", F.array().cast("array<string>")))


def extract_claims(raw: DataFrame, universe: DataFrame) -> DataFrame:
    """C17: raw claims through T34, then T11 and T12."""
    good, bad = _whole(raw, claim_defects())
    return validate_claims(good, universe).unionByName(bad)


def extraction_summary(calls: DataFrame, claims: DataFrame) -> DataFrame:
    """C17: one row: calls kept and rejected, claims kept and rejected."""
    count = lambda df, kind: df.agg(F.count_if(F.col("status") != "rejected").alias(f"{kind}_extracted"), F.count_if(F.col("status") == "rejected").alias(f"{kind}_rejected"))
    return count(calls, "calls").crossJoin(F.broadcast(count(claims, "claims")))  # one row each
