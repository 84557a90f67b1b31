"""Ledger folds, positions and policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.operators.recurrences import day_block

EPS = 1e-9


def fold_ledger(trades: DataFrame, days: int = 30) -> DataFrame:
    """Per ticker quantity, cost_basis, realized, currency and error, at average cost in the order of (traded_at, id).

    A buy adds to the basis and a sale scales it by what is left, so a block's trades are one affine map of the basis that
    the block begins with: basis -> a basis + b, realized -> realized + r0 + r1 basis. Blocks of `days` days are folded
    apart, from the quantity that the sums of earlier blocks give, and one row of block maps per ticker is then folded in
    order. A sale that leaves nothing ends the map (a = b = 0). A ledger that cannot be folded (unknown side, oversell,
    mixed currency) keeps what it had and names the error instead: later trades and blocks change nothing. Trades may carry
    eur_amount, the whole amount in EUR with fees: where every trade of a ticker has one, eur_cost_basis and eur_realized
    are folded alongside.
    """
    if "eur_amount" not in trades.columns:
        trades = trades.withColumn("eur_amount", F.lit(None).cast("double"))
    one = F.struct("traded_at", "id", "side", "quantity", "price_per_share", "fees", "eur_amount")
    signed = F.when(F.col("side") == "buy", F.col("quantity")).when(F.col("side") == "sell", -F.col("quantity"))
    blocks = trades.withColumn("block", day_block("traded_at", days)).groupBy("ticker", "block").agg(
        F.sort_array(F.collect_list(one)).alias("log"), F.coalesce(F.sum(signed), F.lit(0.0)).alias("net"), F.min("currency").alias("currency"), F.max("currency").alias("_other"),
        F.count_if(F.col("eur_amount").isNull()).alias("no_eur"), F.min("traded_at").alias("first_traded_at"), F.max("traded_at").alias("last_traded_at"), F.count(F.lit(1)).alias("n_trades"),
    )
    earlier = Window.partitionBy("ticker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = blocks.select("ticker", "block", F.coalesce(F.sum("net").over(earlier), F.lit(0.0)).alias("held"))
    names = ("qty", "a", "b", "eur_b", "r0", "r1", "eur_r0")
    state = lambda why, **kw: F.struct(*[kw[m].alias(m) for m in names], why.cast("string").alias("error"))
    start = state(F.lit(None), **{m: F.lit(0.0) for m in names} | {"qty": F.when(F.abs("held") > EPS, F.col("held")).otherwise(0.0), "a": F.lit(1.0)})

    def step(s, t):
        q, fees, eur = t["quantity"], F.coalesce(t["fees"], F.lit(0.0)), F.coalesce(t["eur_amount"], F.lit(0.0))
        amount = q * t["price_per_share"]
        same = {m: s[m] for m in names}
        part, left = F.when(s["qty"] > EPS, q / s["qty"]).otherwise(0.0), s["qty"] - q
        kept = lambda m: F.when(left <= EPS, 0.0).otherwise(s[m] - part * s[m])
        bought = state(F.lit(None), **same | {"qty": s["qty"] + q, "b": s["b"] + amount + fees, "eur_b": s["eur_b"] + eur})
        sold = state(
            F.lit(None), qty=F.when(left <= EPS, 0.0).otherwise(left), a=kept("a"), b=kept("b"), eur_b=kept("eur_b"),
            r0=s["r0"] + (amount - fees) - part * s["b"], r1=s["r1"] - part * s["a"], eur_r0=s["eur_r0"] + eur - part * s["eur_b"],
        )
        failed = lambda why: state(F.lit(why), **same)
        return F.when(s["error"].isNotNull(), s).when(~F.coalesce(t["side"].isin("buy", "sell"), F.lit(False)), failed("unknown side")).when(t["side"] == "buy", bought).when(q > s["qty"] + EPS, failed("oversell")).otherwise(sold)

    maps = blocks.join(held, ["ticker", "block"]).withColumn("m", F.aggregate("log", start, step)).drop("log", "net", "held")
    rows = maps.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("block", "m"))).alias("maps"), F.min("currency").alias("currency"), (F.min("currency") != F.max("_other")).alias("_mixed"), F.sum("no_eur").alias("_no_eur"),
        F.min("first_traded_at").alias("first_traded_at"), F.max("last_traded_at").alias("last_traded_at"), F.sum("n_trades").alias("n_trades"),
    )
    money = ("qty", "basis", "realized", "eur_basis", "eur_realized")
    whole = lambda why, **kw: F.struct(*[kw[m].alias(m) for m in money], why.cast("string").alias("error"))

    def follow(s, x):
        m = x["m"]
        after = whole(
            m["error"], qty=m["qty"], basis=m["a"] * s["basis"] + m["b"], realized=s["realized"] + m["r0"] + m["r1"] * s["basis"],
            eur_basis=m["a"] * s["eur_basis"] + m["eur_b"], eur_realized=s["eur_realized"] + m["eur_r0"] + m["r1"] * s["eur_basis"],
        )
        return F.when(s["error"].isNotNull(), s).otherwise(after)

    out = rows.withColumn("s", F.aggregate("maps", whole(F.lit(None), **dict.fromkeys(money, F.lit(0.0))), follow))
    in_eur = lambda c: F.when(F.col("_no_eur") == 0, F.col(c))
    return out.select(
        "ticker", F.col("s.qty").alias("quantity"), F.col("s.basis").alias("cost_basis"), F.col("s.realized").alias("realized"), "currency", F.when(F.col("_mixed"), "mixed currency").otherwise(F.col("s.error")).alias("error"),
        in_eur("s.eur_basis").alias("eur_cost_basis"), in_eur("s.eur_realized").alias("eur_realized"), "first_traded_at", "last_traded_at", "n_trades",
    )


def validate_ledger(trades: DataFrame, edits: DataFrame, as_of) -> DataFrame:
    """C14: tickers whose ledger with the edits (rows replace trades of the same id) cannot be folded, or that have future trades."""
    candidate = trades.join(edits.select("id"), "id", "left_anti").unionByName(edits, allowMissingColumns=True)
    late = candidate.where(F.col("traded_at") > F.lit(as_of).cast("timestamp")).select("ticker", F.lit("future trade").alias("error"))
    return fold_ledger(candidate).where("error is not null").select("ticker", "error").unionByName(late.distinct())


def positions(ledger: DataFrame, quotes: DataFrame, eur_usd: float | None = None) -> DataFrame:
    """Folded positions with quotes (ticker, price, previous, currency): value, unrealized, day change and shares of them.

    A quote in another currency than the ledger's counts as none; one without a currency is taken as it is. market_value_eur
    is known for positions in EUR, and for those in USD where the rate (dollars for a euro) is given.
    """
    q = quotes.select("ticker", F.col("price").alias("_p"), F.col("previous").alias("_o"), F.col("currency").alias("_c"))
    rows = ledger.where("error is null").join(q, "ticker", "left")
    fits = F.col("_c").isNull() | F.coalesce(F.upper("currency") == F.upper("_c"), F.lit(False))
    rows = rows.withColumns({"price": F.when(fits, F.col("_p")), "previous": F.when(fits & F.col("_p").isNotNull(), F.nullif("_o", F.lit(0.0))), "is_open": F.col("quantity") > EPS})
    held = F.when(F.col("is_open"), F.col("quantity"))
    value = held * F.col("price")
    rate = F.nullif(F.lit(eur_usd).cast("double"), F.lit(0.0))
    per_share = lambda c: F.col(c) / held
    out = rows.withColumns(
        {
            "market_value": value, "unrealized": value - F.col("cost_basis"), "day_change": held * (F.col("price") - F.col("previous")), "avg_cost": per_share("cost_basis"), "eur_avg_cost": per_share("eur_cost_basis"),
            "day_change_pct": (F.col("price") / F.col("previous") - 1) * 100, "unrealized_pct": F.when(F.col("cost_basis") > EPS, (value / F.col("cost_basis") - 1) * 100),
            "market_value_eur": F.when(F.col("currency") == "EUR", value).when(F.col("currency") == "USD", value / rate),
        }
    )
    return out.drop("_p", "_o", "_c", "previous")


def ordered(view: DataFrame) -> DataFrame:
    """K6: open positions by market value (or cost) first, then closed ones by realized gain."""
    return view.orderBy(F.desc("is_open"), F.desc(F.when(F.col("is_open"), F.coalesce("market_value", "cost_basis")).otherwise(F.col("realized"))), "ticker")


def trade_log(trades: DataFrame) -> DataFrame:
    """K6: the ledger, newest trade first."""
    return trades.orderBy(F.desc("traded_at"), F.desc("id"))


def quote_errors(view: DataFrame) -> DataFrame:
    """Open positions that no quote of their currency prices."""
    return view.where("is_open and market_value is null").select("ticker")


def totals(view: DataFrame) -> DataFrame:
    """Sums over a view, withheld (null) unless every open position is priced and all are of one currency.

    The realized sum needs one currency among all positions, the sum in EUR that every open position is convertible.
    """
    open_ = F.col("is_open")
    one = F.count_distinct(F.when(open_, F.upper("currency"))) <= 1
    every = lambda c: F.coalesce(F.bool_and(F.when(open_, F.col(c).isNotNull())), F.lit(False))
    held = lambda c: F.sum(F.when(open_, F.col(c)))
    total = lambda c: F.when(one & every("market_value"), held(c))
    return view.agg(
        F.count_if(open_).alias("n_open"), total("market_value").alias("market_value"), total("unrealized").alias("unrealized"), total("day_change").alias("day_change"),
        F.when(F.count_distinct(F.upper("currency")) <= 1, F.sum("realized")).alias("realized"), F.when(every("market_value_eur"), held("market_value_eur")).alias("market_value_eur"),
    )


def policy_view(view: DataFrame, targets: DataFrame, absolute: float = 0.05, relative: float = 0.25) -> DataFrame:
    """Open positions and unheld targets with weight, band and status (trim, add, in_band, no_target), most underweight first.

    The tighter of the two bands binds. Nothing can be weighed if a position is unpriced or all are worth 0: then weights and statuses are null.
    """
    held = view.where("is_open").select("ticker", "market_value")
    missing = targets.join(held, "ticker", "left_anti").select("ticker", F.lit(0.0).alias("market_value"))
    rows = held.unionByName(missing).join(targets, "ticker", "left")
    whole = rows.agg(F.sum("market_value").alias("_sum"), F.count_if(F.col("market_value").isNull()).alias("_unpriced"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    weight = F.when((F.col("_unpriced") == 0) & (F.col("_sum") > 0), F.col("market_value") / F.col("_sum"))
    t = F.col("target")
    rows = rows.withColumns({"weight": weight, "low": F.greatest(t - absolute, t * (1 - relative)), "high": F.least(t + absolute, t * (1 + relative))})
    status = F.when(F.col("weight").isNull(), None).when(t.isNull(), "no_target").when(F.col("weight") > F.col("high"), "trim").when(F.col("weight") < F.col("low"), "add").otherwise("in_band")
    return rows.withColumns({"status": status, "deviation_pp": (F.col("weight") - t) * 100}).drop("_sum", "_unpriced").orderBy(F.asc_nulls_last("deviation_pp"), "ticker")


def factor_concentration(view: DataFrame, factors: DataFrame, ceiling: float) -> DataFrame:
    """Value and weight of each factor (over 0) among open positions, and percentage points over the ceiling."""
    open_ = view.where("is_open and market_value is not null").select("ticker", "market_value")
    total = open_.agg(F.sum("market_value").alias("_t"))
    rows = open_.join(factors, "ticker").groupBy("factor").agg(F.sum("market_value").alias("value")).where("value > 0").crossJoin(F.broadcast(total))  # one row
    return rows.select("factor", "value", (F.col("value") / F.col("_t")).alias("weight"), ((F.col("value") / F.col("_t") - ceiling) * 100).alias("excess_pp"))


def listed_weight(factors: DataFrame, listed: list[str], most: float) -> DataFrame:
    """The summed weight of the listed factors of factor_concentration, and percentage points over what they may reach."""
    weight = F.coalesce(F.sum("weight"), F.lit(0.0))
    return factors.where(F.col("factor").isin(*listed)).agg(weight.alias("weight"), ((weight - most) * 100).alias("excess_pp"))
