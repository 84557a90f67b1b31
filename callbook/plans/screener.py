"""Screening a universe."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.plans.signals import creator_coverage


@dataclass(frozen=True)
class ScreenConfig:
    """Default limits of the screen."""

    max_forward_pe: float = 25.0
    max_peg: float = 1.5
    max_ev_ebitda: float = 15.0
    min_revenue_growth: float = 0.15
    min_gross_margin: float = 0.40
    min_roe: float = 0.15
    max_debt_to_equity: float = 1.0
    max_extension: float = 0.30
    min_rs: float = 0.0
    require_earnings_positive: bool = True
    earnings_days: int = 30


FILTERS: dict[str, Callable[[ScreenConfig], Column]] = {}


def screen_filter(name: str):
    """Register a filter: a function of the configuration that gives true, false, or null for too little data."""

    def add(fn: Callable[[ScreenConfig], Column]):
        FILTERS[name] = fn
        return fn

    return add


@screen_filter("value")
def _value(cfg: ScreenConfig) -> Column:
    c = F.col
    checks = F.array(c("forward_pe") < cfg.max_forward_pe, F.when(c("peg_ratio") > 0, c("peg_ratio") < cfg.max_peg), F.when(c("ev_to_ebitda") > 0, c("ev_to_ebitda") < cfg.max_ev_ebitda))
    known = F.filter(checks, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.exists(known, lambda x: x))


@screen_filter("growth")
def _growth(cfg: ScreenConfig) -> Column:
    known = F.col("revenue_growth").isNotNull()
    if not cfg.require_earnings_positive:
        return F.when(known, F.col("revenue_growth") > cfg.min_revenue_growth)
    earned = F.coalesce((F.col("earnings_growth") > 0) | (F.col("earnings_growth").isNotNull() & (F.col("revenue_growth_qoq") > F.col("revenue_growth"))), F.lit(False))
    return (F.col("revenue_growth") > cfg.min_revenue_growth) & F.when(known, earned)


@screen_filter("quality")
def _quality(cfg: ScreenConfig) -> Column:
    known = F.col("gross_margin").isNotNull() & F.col("return_on_equity").isNotNull() & F.col("debt_to_equity").isNotNull()
    return F.when(known, (F.col("gross_margin") > cfg.min_gross_margin) & (F.col("return_on_equity") > cfg.min_roe) & (F.col("debt_to_equity") < cfg.max_debt_to_equity))


@screen_filter("technical")
def _technical(cfg: ScreenConfig) -> Column:
    known = F.col("price_vs_sma_200").isNotNull() & F.col("rs_vs_benchmark").isNotNull()
    return F.when(known, (F.col("price_vs_sma_200") > 0) & (F.col("price_vs_sma_200") <= cfg.max_extension) & (F.col("rs_vs_benchmark") > cfg.min_rs))


def screen(metrics: DataFrame, cfg: ScreenConfig = ScreenConfig(), enabled: tuple[str, ...] | None = None) -> DataFrame:
    """Metrics with pass_<filter>, n_passed, lacking (filters without data) and flags, best first. Missing data fails."""
    names = enabled or tuple(FILTERS)
    tried = metrics.withColumns({f"_{n}": FILTERS[n](cfg) for n in names})
    out = tried.withColumns({f"pass_{n}": F.coalesce(f"_{n}", F.lit(False)) for n in names})
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in names]))
    count = sum((F.col(f"pass_{n}").cast("int") for n in names), F.lit(0))
    out = out.withColumns({"n_passed": count, "lacking": lacking, "flags": flags(cfg)}).drop(*[f"_{n}" for n in names])
    return out.orderBy(F.desc(F.col("n_passed") > 0), F.desc("n_passed"), "ticker")


def flags(cfg: ScreenConfig) -> Column:
    """Notes beside the filters: cheap by any measure while earnings fall, earnings soon, far over the 200-day mean."""
    c = F.col
    cheap = _value(cfg) & (c("earnings_growth") < 0)
    soon = c("days_to_earnings").between(0, cfg.earnings_days)
    far = c("price_vs_sma_200") > cfg.max_extension
    return F.array_compact(F.array(F.when(cheap, "cheap_for_a_reason"), F.when(soon, F.concat(F.lit("earnings_in_"), c("days_to_earnings").cast("string"), F.lit("d"))), F.when(far, "extended_above_200d")))


#: Tags of missing figures, each with the columns of which one must be known.
QUALITY = {
    "no_pe": ("forward_pe", "trailing_pe"), "no_revenue_growth": ("revenue_growth",), "no_gross_margin": ("gross_margin",),
    "no_roe": ("return_on_equity",), "no_sma_200": ("sma_200",), "no_relative_strength": ("rs_vs_benchmark",),
}


def screen_universe(universe: DataFrame, metrics: DataFrame, technicals: DataFrame, calls: DataFrame, claims: DataFrame, cfg: ScreenConfig = ScreenConfig(), enabled: tuple[str, ...] | None = None, sector: str | None = None) -> DataFrame:
    """Every ticker of a universe (ticker, sector; of one sector if given) screened on its metrics and technicals
    (indicators.screen_technicals), with its coverage by creators beside them.

    The universe's sector stands in for a missing one. A ticker without metrics is an error: it passes nothing and comes
    last. Coverage never moves a row. data_quality names what is missing. Metrics without a column have it as null.
    """
    listed = universe if sector is None else universe.where(F.lower("sector") == sector.lower())
    listed = listed.select("ticker", F.col("sector").alias("_sector"))
    own = metrics.drop("price_vs_sma_200", "rs_vs_benchmark", "sma_200", "last_close").withColumn("_known", F.lit(True))
    for column in ("trailing_pe", "sector"):
        if column not in own.columns:
            own = own.withColumn(column, F.lit(None).cast("string" if column == "sector" else "double"))
    side = technicals.select("ticker", "last_close", "sma_200", "rs_vs_benchmark", (F.col("last_close") / F.nullif("sma_200", F.lit(0.0)) - 1).alias("price_vs_sma_200"))
    known = F.col("_known").isNotNull()
    rows = listed.join(own, "ticker", "left").join(side, "ticker", "left").join(creator_coverage(listed, calls, claims), "ticker", "left")
    rows = rows.withColumns(
        {
            **{c: F.when(known, F.col(c)) for c in ("last_close", "sma_200", "rs_vs_benchmark", "price_vs_sma_200", "avg_confidence")},
            "n_mentions": F.when(known, F.col("n_mentions")).otherwise(0), "sector": F.coalesce(F.nullif("sector", F.lit("")), F.nullif("_sector", F.lit(""))),
            "error": F.when(~known, "no_metrics"),
        }
    )
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(*columns).isNull(), tag) for tag, columns in QUALITY.items()]))
    none = F.array().cast("array<string>")
    out = screen(rows, cfg, enabled).withColumns({"data_quality": F.when(known, lacks).otherwise(none), "lacking": F.when(known, F.col("lacking")).otherwise(none)})
    return out.drop("_sector", "_known").orderBy(F.col("error").isNotNull(), F.desc("n_passed"), "ticker")


#: Columns of a screen's table and where they come from.
SCREEN_TABLE = {
    "ticker": "ticker", "sector": "sector", "fwd_pe": "forward_pe", "peg": "peg_ratio", "ev_ebitda": "ev_to_ebitda", "rev_growth": "revenue_growth", "earn_growth": "earnings_growth", "gross_margin": "gross_margin",
    "roe": "return_on_equity", "debt_equity": "debt_to_equity", "pct_vs_200d": "price_vs_sma_200", "rs_vs_spy_3mo": "rs_vs_benchmark", "days_to_earnings": "days_to_earnings", "filters_passed": "filters_passed",
    "creator_mentions": "n_mentions", "avg_creator_confidence": "avg_confidence", "flags": "flags", "data_quality": "data_quality", "error": "error",
}


def screen_table(screened: DataFrame, only_passing: bool = True) -> DataFrame:
    """IO10: a screen as a flat table of fixed columns, lists joined by commas; a column that the screen lacks is empty."""
    passed = F.array_compact(F.array(*[F.when(F.col(f"pass_{n}"), n) for n in FILTERS if f"pass_{n}" in screened.columns]).cast("array<string>"))
    rows = (screened.where("n_passed > 0") if only_passing else screened).withColumn("filters_passed", passed)
    types = dict(rows.dtypes)

    def flat(source: str) -> Column:
        if source not in types:
            return F.lit(None).cast("string")
        return F.concat_ws(",", source) if types[source].startswith("array") else F.coalesce(source, F.lit("")) if types[source] == "string" else F.col(source)

    return rows.select(*[flat(source).alias(name) for name, source in SCREEN_TABLE.items()])


#: What a peer's ratio must lie strictly between to count (None: any).
BOUNDS = {
    "forward_pe": (-200.0, 500.0), "trailing_pe": (-200.0, 500.0), "peg": (-50.0, 50.0), "price_to_sales": (0.0, 200.0),
    "revenue_growth": (-2.0, 5.0), "profit_margins": (-2.0, 5.0), "operating_margins": (-2.0, 5.0), "market_cap": None,
}


def peer_medians(peers: DataFrame, ratios: DataFrame) -> DataFrame:
    """Per target of peers (target, peer), exact medians of its peers' usable ratios (ticker and BOUNDS' columns).

    n_peers counts the peers with a usable ratio, peers lists them in order. A target is no peer of its own. Every target
    has a row; without a usable peer its medians are null.
    """
    usable = {c: F.when(F.lit(True) if b is None else (F.col(c) > b[0]) & (F.col(c) < b[1]), F.nanvl(F.col(c), F.lit(None))) for c, b in BOUNDS.items()}
    known = ratios.select(F.col("ticker").alias("peer"), *[v.alias(c) for c, v in usable.items()]).where(F.coalesce(*BOUNDS).isNotNull())
    pairs = peers.select("target", "peer").distinct()
    found = pairs.where("target <> peer").join(known, "peer").groupBy("target").agg(F.count(F.lit(1)).alias("n_peers"), F.sort_array(F.collect_list("peer")).alias("peers"), *[F.median(c).alias(f"median_{c}") for c in BOUNDS])
    return pairs.select("target").distinct().join(found, "target", "left").withColumns({"n_peers": F.coalesce("n_peers", F.lit(0)), "peers": F.coalesce("peers", F.array().cast("array<string>"))})


def relative_value(peers: DataFrame, ratios: DataFrame) -> DataFrame:
    """Each target against its peers' medians: forward P/E rich over 1.30 times, cheap under 0.75, else in line;
    revenue growth and profit margin by difference: faster or slower by over 0.05, higher or lower by over 0.05."""
    own = ratios.select(F.col("ticker").alias("target"), "forward_pe", "revenue_growth", "profit_margins")
    joined = peer_medians(peers, ratios).join(own, "target")
    ratio = F.col("forward_pe") / F.nullif("median_forward_pe", F.lit(0.0))
    gap = lambda c: F.col(c) - F.col(f"median_{c}")
    side = lambda x, up, down: F.when(x > 0.05, up).when(x < -0.05, down).when(x.isNotNull(), "in_line").otherwise("unknown")
    return joined.select("target", "n_peers", ratio.alias("ratio"), F.when(ratio > 1.30, "rich").when(ratio < 0.75, "cheap").when(ratio.isNotNull(), "in_line").otherwise("unknown").alias("value"), side(gap("revenue_growth"), "faster", "slower").alias("growth"), side(gap("profit_margins"), "higher", "lower").alias("margin"))


def screen_counts(screened: DataFrame) -> DataFrame:
    """One row: the universe's size, rows completed and with an error, and those that pass (passed is true)."""
    failed = F.col("error").isNotNull()
    return screened.agg(F.count(F.lit(1)).alias("universe"), F.count_if(~failed).alias("completed"), F.count_if(failed).alias("errors"), F.count_if(~failed & F.coalesce("passed", F.lit(False))).alias("passing"))


#: Peers by sector and industry key, in order of precedence, and by sector where no key fits.
INDUSTRY_PEERS = (
    ("Technology", "semiconductor", "NVDA AMD AVGO MU INTC QCOM"),
    ("Technology", "semiconductor equipment", "AMAT LRCX KLAC ASML"),
    ("Technology", "consumer electronics", "AAPL HPQ DELL SONY"),
    ("Technology", "software—application", "MSFT CRM ADBE NOW INTU"),
    ("Technology", "software application", "MSFT CRM ADBE NOW INTU"),
    ("Technology", "software—infrastructure", "MSFT ORCL SNOW NET CRWD"),
    ("Technology", "software infrastructure", "MSFT ORCL SNOW NET CRWD"),
    ("Technology", "information technology services", "IBM ACN INFY WIT"),
    ("Technology", "computer hardware", "AAPL HPQ DELL STX WDC"),
    ("Technology", "electronic components", "TEL APH GLW FLEX"),
    ("Communication Services", "internet content", "GOOGL META NFLX DIS PINS"),
    ("Communication Services", "entertainment", "DIS NFLX WBD PARA"),
    ("Communication Services", "telecom services", "T VZ TMUS"),
    ("Consumer Cyclical", "auto manufacturers", "TSLA F GM RIVN LCID"),
    ("Consumer Cyclical", "internet retail", "AMZN SHOP MELI ETSY"),
    ("Consumer Cyclical", "specialty retail", "BBY ULTA TSCO FIVE"),
    ("Consumer Cyclical", "restaurants", "MCD SBUX CMG QSR"),
    ("Consumer Cyclical", "lodging", "MAR HLT H ABNB"),
    ("Consumer Defensive", "discount stores", "WMT COST TGT DG"),
    ("Consumer Defensive", "beverages—non-alcoholic", "KO PEP MNST KDP"),
    ("Consumer Defensive", "packaged foods", "KHC GIS K MDLZ"),
    ("Energy", "oil & gas e&p", "XOM CVX COP EOG FANG"),
    ("Energy", "oil & gas integrated", "XOM CVX BP SHEL"),
    ("Energy", "oil & gas refining", "MPC VLO PSX DK"),
    ("Healthcare", "drug manufacturers—general", "JNJ PFE MRK LLY NVO"),
    ("Healthcare", "drug manufacturers general", "JNJ PFE MRK LLY NVO"),
    ("Healthcare", "biotechnology", "AMGN GILD REGN VRTX BIIB"),
    ("Healthcare", "medical devices", "MDT ABT BSX SYK EW"),
    ("Financial Services", "banks—diversified", "JPM BAC C WFC"),
    ("Financial Services", "capital markets", "GS MS BLK SCHW HOOD COIN"),
    ("Financial Services", "insurance", "BRK-B PGR ALL TRV"),
    ("Industrials", "aerospace & defense", "BA LMT RTX NOC GD"),
    ("Industrials", "railroads", "UNP CSX NSC CP"),
    ("Industrials", "specialty industrial machinery", "HON ETN ITW PH"),
    ("Industrials", "electrical equipment", "GE ETN EMR ROK PLUG FCEL BE"),
    ("Real Estate", "reit", "O AMT PLD EQIX SPG"),
    ("Utilities", "utilities—regulated electric", "NEE DUK SO AEP"),
    ("Basic Materials", "specialty chemicals", "LIN APD SHW PPG"),
    ("Basic Materials", "gold", "NEM GOLD AEM KGC"),
)
SECTOR_PEERS = (
    ("Technology", "MSFT AAPL GOOGL META AMZN NVDA"),
    ("Communication Services", "GOOGL META NFLX DIS"),
    ("Consumer Cyclical", "AMZN TSLA HD NKE MCD"),
    ("Consumer Defensive", "WMT PG KO PEP COST"),
    ("Energy", "XOM CVX COP EOG"),
    ("Healthcare", "JNJ PFE MRK LLY ABBV"),
    ("Financial Services", "JPM BAC BRK-B V MA"),
    ("Industrials", "GE HON CAT UPS BA"),
    ("Real Estate", "O AMT PLD EQIX"),
    ("Utilities", "NEE DUK SO AEP"),
    ("Basic Materials", "LIN APD SHW NEM"),
)
#: Companies of a kind of their own, whatever their sector: known by ticker or by a word of the industry.
CRYPTO_PEERS = ("MARA", "RIOT", "CLSK", "WULF", "BTBT", "HUT", "IREN")


def peer_tables(spark) -> tuple[DataFrame, DataFrame]:
    """The tables that resolve_peers takes: (place, sector, key, peers) and (sector, peers)."""
    keyed = [(0, None, "crypto", list(CRYPTO_PEERS))] + [(k + 1, s, i, p.split()) for k, (s, i, p) in enumerate(INDUSTRY_PEERS)]
    return spark.createDataFrame(keyed, "place int, sector string, key string, peers array<string>"), spark.createDataFrame([(s, p.split()) for s, p in SECTOR_PEERS], "sector string, peers array<string>")


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def resolve_peers(companies: DataFrame, keyed: DataFrame, fallback: DataFrame, special: tuple[str, ...] = CRYPTO_PEERS) -> DataFrame:
    """(target, peer, rank, by) of companies (ticker, sector, industry): peers of the first key (by place) that the
    industry holds, whatever its case, and whose sector is the company's (null: any); else of its sector; else none (a row
    with null peer). `special` tickers are peers of each other. A target is no peer of its own.

    keyed: place, sector, key, peers. Which keys an industry holds is looked up in an index of runs of three characters: each
    key is filed under the run that fewest industries hold, so a match needs one equi-join and one exact check.
    """
    low = companies.select("ticker", "sector", F.lower(F.coalesce("industry", F.lit(""))).alias("industry"))
    industries = low.where("industry <> ''").select("industry").distinct()
    sizes = (1, 2, 3)
    grams = industries.select("industry", F.explode(F.concat(*[_grams(F.col("industry"), n) for n in sizes])).alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = keyed.withColumn("key", F.lower("key")).withColumn("_size", F.least(F.length("key"), F.lit(3)))
    mine = F.when(F.col("_size") == 1, _grams(F.col("key"), 1)).when(F.col("_size") == 2, _grams(F.col("key"), 2)).otherwise(_grams(F.col("key"), 3))
    filed = keys.select("place", "key", F.explode(mine).alias("gram")).join(held, "gram", "left")
    rarest = filed.groupBy("place", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("place", "key", "g.gram")
    found = grams.join(rarest, "gram").where(F.col("industry").contains(F.col("key"))).select("industry", "place").join(keys.select("place", F.col("sector").alias("_sector"), "peers"), "place")
    fits = F.col("_sector").isNull() | (F.col("_sector") == F.col("sector"))
    first = low.join(found, "industry").where(fits).groupBy("ticker").agg(F.min(F.struct("place", "peers")).alias("_k"))
    rows = low.join(first, "ticker", "left").join(fallback.select("sector", F.col("peers").alias("_f")), "sector", "left")
    listed = F.array(*map(F.lit, special)) if special else F.array().cast("array<string>")
    own = F.array_contains(listed, F.upper("ticker"))
    told = F.coalesce(F.col("sector") != "", F.lit(False)) | (F.col("industry") != "")
    by = F.when(~told, "none").when(own, "special").when(F.col("_k").isNotNull(), "industry").when(F.col("_f").isNotNull(), "sector").otherwise("none")
    rows = rows.withColumn("by", by).withColumn("peers", F.when(F.col("by") == "special", listed).when(F.col("by") == "industry", F.col("_k.peers")).when(F.col("by") == "sector", F.col("_f")))
    others = F.filter("peers", lambda p: F.upper(p) != F.upper("ticker"))
    return rows.select(F.col("ticker").alias("target"), "by", F.posexplode_outer(others).alias("rank", "peer")).select("target", "peer", (F.col("rank") + 1).alias("rank"), "by")
