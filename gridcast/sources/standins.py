"""The driver's test tables mapped onto the shapes the operators consume (FIXTURES part B).

Each function reads only the columns it needs (the parquet scan prunes the rest) and reduces
the raw rows with partial aggregation before the first shuffle. Dimension tables that are
bounded by definition (region: 5 rows, nation: 25 rows) are broadcast; everything else is left
to the planner and AQE's runtime size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalar import strike_mills


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: safe to broadcast.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                       .select("n_nationkey", "r_name"))


def orders_by_customer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to the customer's nation and region."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                              "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nr = _nation_region(spark, sf_dir)
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
            .drop("c_custkey", "n_nationkey"))


def region_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 stand-in: one row per (series_id = region, date) with target = avg price / 1000 and
    temp = avg price / 4000 (mean ~62 F)."""
    o = orders_by_customer_region(spark, sf_dir)
    return (o.groupBy(F.col("r_name").alias("series_id"),
                      F.to_date("o_orderdate").alias("date"))
            .agg((F.avg("o_totalprice") / 1000.0).alias("target"),
                 (F.avg("o_totalprice") / 4000.0).alias("temp")))


def station_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 stand-in (long): station = customer nation, one temperature per (station, date)."""
    o = orders_by_customer_region(spark, sf_dir)
    return (o.groupBy(F.col("c_nationkey").alias("station_id"),
                      F.to_date("o_orderdate").alias("date"))
            .agg((F.avg("o_totalprice") / 4000.0).alias("temp")))


def station_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 stand-in: station = nation, weight = customers in the nation, region = r_name.
    25 rows at every scale (one per nation)."""
    c = table(spark, sf_dir, "customer").select("c_nationkey")
    w = c.groupBy(F.col("c_nationkey").alias("station_id")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    nr = _nation_region(spark, sf_dir)
    return w.join(nr, w.station_id == nr.n_nationkey).select(
        "station_id", "weight", F.col("r_name").alias("region"))


def lineitem_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the ordering customer's region (for weekly / monthly feeds)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nr = _nation_region(spark, sf_dir)
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("r_name").alias("series_id"), "l_quantity", "l_shipdate"))


def periodic_feed(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """A1 stand-in: weekly / monthly feed = sum(l_quantity) per (region, period start)."""
    li = lineitem_region(spark, sf_dir)
    return (li.groupBy("series_id", F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"))
            .agg(F.sum("l_quantity").alias("value")))


def station_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 stand-in: long station feed (station_id, date, datatype, value) from lineitem and the
    supplier's nation; return flag A -> TMAX, R -> TMIN, N -> TAVG."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_returnflag",
                                                 "l_shipdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    dt = (F.when(F.col("l_returnflag") == "A", "TMAX").when(F.col("l_returnflag") == "R", "TMIN")
          .when(F.col("l_returnflag") == "N", "TAVG"))
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .groupBy(F.col("s_nationkey").alias("station_id"),
                     F.to_date("l_shipdate").alias("date"), dt.alias("datatype"))
            .agg((F.avg("l_extendedprice") / 1000.0).alias("value")))


def station_forecast_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 stand-in: per (station = supplier nation, date) temp, wind, humidity and alert from
    lineitem: temp = avg price / 1000, wind = avg quantity, humidity = avg tax * 1000,
    alert = any returned line."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity",
                                                 "l_tax", "l_returnflag", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .groupBy(F.col("s_nationkey").alias("station_id"), F.to_date("l_shipdate").alias("date"))
            .agg((F.avg("l_extendedprice") / 1000.0).alias("temp"),
                 F.avg("l_quantity").alias("wind"),
                 (F.avg("l_tax") * 1000.0).alias("humidity"),
                 F.max((F.col("l_returnflag") == "R").cast("int")).alias("alert")))


def forecast_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 stand-in: run = order month, channel = priority, value = average price / 1000,
    version 1 except runs built from status 'P' orders (version 2, to be ignored)."""
    o = orders_by_customer_region(spark, sf_dir)
    return (o.groupBy(F.col("r_name").alias("series_id"),
                      F.to_date(F.date_trunc("month", "o_orderdate")).alias("run_ts"),
                      F.col("o_orderpriority").alias("channel"),
                      F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("version"))
            .agg((F.avg("o_totalprice") / 1000.0).alias("value")))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 stand-in: one quote per event. series = event_type, ticker = user_id,
    yes_ask = props k (text), volume = value; 'error' events carry an empty ask and the price in
    dollars instead, 'signup' events carry no volume (volume_fp instead), 'view' events are
    closed."""
    return quote_shape(table(spark, sf_dir, "events"))


def quote_shape(events: DataFrame) -> DataFrame:
    """Events (batch or stream) -> raw quote rows (see ``raw_quotes``)."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k")
    et = F.col("event_type")
    return e.select(
        F.col("event_id"),
        et.alias("series_ticker"),
        F.concat(et, F.lit("-"), F.col("user_id").cast("string")).alias("ticker"),
        F.when(et == "view", "closed").otherwise("open").alias("status"),
        F.when(et == "error", F.lit("")).otherwise(k).alias("yes_ask"),
        F.when(et == "error", F.format_string("%.2f", k.cast("double") / 100.0)).alias("yes_ask_dollars"),
        F.lit(None).cast("string").alias("last_price_dollars"),
        F.lit(None).cast("string").alias("yes_bid_dollars"),
        F.when(et == "signup", F.lit(None)).otherwise(F.col("value").cast("string")).alias("volume"),
        F.col("value").cast("string").alias("volume_fp"),
        F.col("ts"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 stand-in: event = brand, strike = retail price, ticker = part key. The YES ask falls
    linearly with the strike's position in the event's price range (99 at the lowest strike,
    1 at the highest; 50 when the event has a single price); sizes above 45 have no ask.
    no_ask = 102 - yes_ask (spread 2) unless the size is below 5 (spread 2 + size * 3).
    volume = size, open interest = 2 * size.

    The range comes from a per-event min / max aggregate (combined map-side, one row per
    event) joined back, so no task ever holds a whole event's rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    rng = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("_lo"), F.max("p_retailprice").alias("_hi"))
    p = p.join(rng, "p_brand")
    pos = F.when(F.col("_hi") > F.col("_lo"),
                 F.lit(98.0) * (F.col("_hi") - F.col("p_retailprice")) / (F.col("_hi") - F.col("_lo")))
    ask = F.when(F.col("p_size") <= 45,
                 F.when(pos.isNull(), F.lit(50)).otherwise((F.lit(1) + F.round(pos, 0)).cast("int")))
    out = p.select(
        F.col("p_brand").alias("event_id"),
        F.concat(F.lit("MKT-"), F.col("p_partkey").cast("string")).alias("ticker"),
        F.col("p_partkey").alias("part_key"),
        F.format_string("above %.2f", F.col("p_retailprice")).alias("yes_sub_title"),
        F.col("p_retailprice").alias("threshold_value"),
        strike_mills("p_retailprice").alias("strike_mills"),
        ask.cast("int").alias("yes_ask_cents"),
        F.col("p_size").cast("bigint").alias("volume"),
        (F.col("p_size") * 2).cast("bigint").alias("open_interest"),
        F.col("p_size").alias("size"),
    )
    no_ask = F.when(F.col("yes_ask_cents").isNull(), F.lit(None).cast("int")).otherwise(
        (F.lit(102) - F.col("yes_ask_cents")
         + F.when(F.col("size") < 5, F.col("size") * 3).otherwise(0)).cast("int"))
    return out.withColumn("no_ask_cents", no_ask)


def strike_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 stand-in: model probability per (event, strike) = size / 51, deduplicated on
    (event, strike_mills) by taking the largest probability."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    return (p.groupBy(F.col("p_brand").alias("row_id"), strike_mills("p_retailprice").alias("strike_mills"))
            .agg(F.max(F.col("p_size") / 51.0).alias("prob"))
            .withColumn("strike", F.col("strike_mills") / 1000.0))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 stand-in: one position per order (status P orders are ignored).
    portfolio = priority, ticker = 'C' + customer, side NO for urgent/high priorities else YES,
    entry = 1 + price / 5051 (1..99 cents), status O open / F closed, hedge_id set for closed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_totalprice", "o_orderdate", "o_orderpriority")
    o = o.where(F.col("o_orderstatus") != "P")
    return o.select(
        F.col("o_orderpriority").alias("portfolio"),
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "NO").otherwise("YES").alias("side"),
        (F.lit(1) + (F.col("o_totalprice") / 5051.0).cast("int")).cast("int").alias("entry_price_cents"),
        F.lit(1).alias("contracts"),
        F.col("o_orderdate").alias("opened_at"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("hedge_id"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit('{"reason":"hedge"}'))
        .otherwise(F.lit('{"reason":"edge"}')).alias("decision_json"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 stand-in: one trade per line item; line 1 is the entry, later lines are exits."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                                 "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("portfolio"),
        F.col("l_orderkey").alias("position_id"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.when(F.col("l_linenumber") == 1, "entry").otherwise("exit").alias("kind"),
        F.col("l_shipdate").alias("created_at"),
    )


def market_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 stand-in: status rows per ticker from lineitem. R -> settled yes (price '100'),
    A -> settled with a zero price and result 'no', N -> settled without price or result
    (unresolved); open lines (status O) are still 'open'."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                                 "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    f = F.col("l_returnflag")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("settled").alias("status"),
        F.when(f == "R", "100").when(f == "A", "0").alias("yes_settled_price"),
        F.lit(None).cast("string").alias("settlement_value"),
        F.when(f == "R", "yes").when(f == "A", "no").alias("result"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("seq_a"),
        F.col("l_linenumber").alias("seq_b"),
    )


def quotes_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current asks per ledger ticker: the latest event of each user as ticker 'C' + user:
    yes_ask = k, no_ask = 100 - k + 2 (capped at 99)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    last = e.groupBy("user_id").agg(F.max_by(k, F.struct("ts", "event_id")).alias("k"))
    return last.select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("ticker"),
                       F.col("k").alias("yes_ask_cents"),
                       F.least(F.lit(99), F.lit(102) - F.col("k")).cast("int").alias("no_ask_cents"))


def predictions(spark: SparkSession, sf_dir: str, thresholds=(25.0, 50.0, 100.0, 200.0, 400.0)) -> DataFrame:
    """A13 stand-in: prob = k / 100, label = value > threshold, one row per event and threshold.
    The threshold list is a parameter; exploding it is in-stage (no join, no shuffle)."""
    e = table(spark, sf_dir, "events").select("event_id", "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    return e.select(F.col("event_id").alias("row_id"), (k / 100.0).alias("predicted_prob"),
                    "value", F.explode(grid).alias("threshold")).select(
        "threshold", "row_id", "predicted_prob",
        (F.col("value") > F.col("threshold")).cast("int").alias("actual_label"))
