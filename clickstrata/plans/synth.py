"""Synthetic storefront events as one declarative plan: sessions are rows, what happens in them follows from hashes.

A session is drawn as a whole: how many pages, searches and products it holds, how many of the products go to the cart,
and whether it ends in a checkout and a purchase. Its events are then laid out over its length and unnested. Every draw
is a hash of (seed, day, shard, session, what is drawn), so any part can be made again, on any number of executors and
without state. The shares below give the outcomes that are asked for: 4 to 6 per cent of the sessions convert, and about
40 per cent of those with a product view have something put into the cart.

Delivery noise follows: late records arrive a day later, repeated ones a second time a day later, and damaged ones are
torn, or lack their user, or carry a type, time or price that no rule lets through.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What users and visits have; the earlier in the list, the more of them (see ``ranked``).
COUNTRIES = ("US", "GB", "DE", "FR", "BR", "IN", "ES", "IT", "CA", "MX", "NL", "SE")
DEVICES = ("mobile", "desktop", "tablet")
SYSTEMS = {"mobile": ("android", "ios"), "desktop": ("windows", "macos", "linux"), "tablet": ("ios", "android")}
BROWSERS = ("chrome", "safari", "firefox", "edge")
CHANNELS = ("direct", "google", "newsletter", "facebook", "affiliate")
CATEGORIES = ("home", "fashion", "sports", "beauty", "toys", "electronics", "books", "garden", "grocery", "music")
#: Shares: visits that see a product; of those, visits that fill a cart; carts from which one thing goes again; full carts
#: that reach the checkout; checkouts that are paid.
SEES, FILLS, REGRETS, CHECKS_OUT, PAYS = 0.86, 0.40, 0.15, 0.38, 0.42
#: Means of the further products, the searches and the category pages of a visit, and the most of each.
MORE_PRODUCTS, SEARCHES, PAGES, MOST = 1.8, 0.9, 1.4, 24
#: Seconds between events, about.
PACE = 40


@dataclass(frozen=True)
class Synth:
    start_date: dt.date = dt.date(2026, 9, 1)
    days: int = 7
    events_per_day: int = 200_000
    users: int = 50_000
    products: int = 50_000
    shards: int = 8
    late_rate: float = 0.02
    dup_rate: float = 0.01
    bad_rate: float = 0.005
    seed: int = 42

    @property
    def sessions_per_shard(self) -> int:
        """As many as make the day's events, on average."""
        carts = SEES * FILLS
        mean = 1 + SEES * (1 + MORE_PRODUCTS) + SEARCHES + PAGES + 1.3 * carts + carts * REGRETS + carts * CHECKS_OUT * (1 + PAYS)
        return max(1, math.ceil(self.events_per_day / self.shards / mean))


def uniform(*key: Column | str) -> Column:
    """A number from 0 up to 1 that the key alone decides."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)


def ranked(values: tuple[str, ...], x: Column) -> Column:
    """One of the values: the k-th with probability log((k + 1) / k) / log(n + 1)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.least(F.floor(F.exp(x * math.log(len(values) + 1))), F.lit(len(values))).cast("int"))


def counted(mean: float, x: Column) -> Column:
    """A geometric number with that mean, at most MOST."""
    return F.least(F.floor(F.ln(1 - x) / math.log(mean / (1 + mean))), F.lit(MOST)).cast("int")


def sessions(spark: SparkSession, conf: Synth) -> DataFrame:
    """One row a visit: day, shard, session, its user's traits, its counts and how it ends."""
    each = conf.sessions_per_shard
    rows = spark.range(0, conf.days * conf.shards * each, 1, conf.days * conf.shards)
    rows = rows.select(
        F.date_add(F.lit(conf.start_date), F.floor(F.col("id") / (each * conf.shards)).cast("int")).alias("day"),
        F.pmod(F.floor(F.col("id") / each), F.lit(conf.shards)).alias("shard"),
        F.pmod(F.col("id"), F.lit(each)).alias("session"),
    )
    draw = lambda what: uniform(F.lit(conf.seed), "day", "shard", "session", F.lit(what))
    rows = rows.withColumn("user", F.floor(conf.users * F.pow(draw("user"), 1.8)))
    trait = lambda what: uniform("user", F.lit(what))
    rows = rows.withColumns({"device_type": ranked(DEVICES, trait("device")), "channel": ranked(CHANNELS, draw("channel"))})
    system = F.lit(None)
    for device, systems in SYSTEMS.items():
        system = F.when(F.col("device_type") == device, ranked(systems, trait("system"))).otherwise(system)
    # starts pile up in the evening: three draws add to a bell, which is moved behind noon
    start = F.pmod((draw("a") + draw("b") + draw("c")) / 3 + 0.29, F.lit(1.0)) * 86_400
    rows = rows.withColumns({
        "country": ranked(COUNTRIES, trait("country")), "os": system, "browser": ranked(BROWSERS, trait("browser")), "start": start,
        "n_products": F.when(draw("sees") < SEES, 1 + counted(MORE_PRODUCTS, draw("products"))).otherwise(0),
        "n_searches": counted(SEARCHES, draw("searches")), "n_pages": counted(PAGES, draw("pages")),
    })
    rows = rows.withColumn("n_carts", F.when((F.col("n_products") > 0) & (draw("fills") < FILLS), F.least("n_products", 1 + counted(0.4, draw("carts")))).otherwise(0))
    rows = rows.withColumn("n_removed", ((F.col("n_carts") > 0) & (draw("regrets") < REGRETS)).cast("int"))
    rows = rows.withColumn("checks_out", (F.col("n_carts") > F.col("n_removed")) & (draw("checks out") < CHECKS_OUT))
    return rows.withColumns({"pays": F.col("checks_out") & (draw("pays") < PAYS), "length": PACE * (1.0 + F.col("n_products") + F.col("n_searches") + F.col("n_pages"))})


def price_of(product: Column) -> Column:
    return F.round(F.exp(1.2 + 4.4 * uniform(product, F.lit("price"))), 2)


def events(spark: SparkSession, conf: Synth) -> DataFrame:
    """The visits' events, without noise: what a payload holds, and day, shard, session."""
    visits = sessions(spark, conf)
    draw = lambda *what: uniform(F.lit(conf.seed), "day", "shard", "session", *what)

    def product(k: Column) -> Column:
        return F.floor(conf.products * F.pow(draw(F.lit("product"), k), 2.6))

    def step(at: Column, kind: str, item: Column | None = None, quantity: Column | None = None) -> Column:
        return F.struct(at.cast("double").alias("at"), F.lit(kind).alias("kind"), (F.lit(None) if item is None else item).cast("bigint").alias("product"), (F.lit(None) if quantity is None else quantity).cast("int").alias("quantity"))

    def steps(number: Column, body) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1), lambda k: k < number), body)

    somewhere = lambda what, k: 2 + F.col("length") * draw(F.lit(what), k)
    quantity = lambda k: 1 + F.floor(3 * F.pow(draw(F.lit("quantity"), k), 2))
    seen = lambda k: somewhere("view", k)
    put = lambda k: seen(k) + 4 + 15 * draw(F.lit("put"), k)
    end = F.col("length") + 25
    all_steps = F.concat(
        F.array(step(F.lit(0), "page_view")),
        steps(F.col("n_pages"), lambda k: step(somewhere("page", k), "page_view")),
        steps(F.col("n_searches"), lambda k: step(somewhere("search", k), "search")),
        steps(F.col("n_products"), lambda k: step(seen(k), "product_view", product(k))),
        steps(F.col("n_carts"), lambda k: step(put(k), "add_to_cart", product(k), quantity(k))),
        steps(F.col("n_removed"), lambda k: step(put(k) + 2, "remove_from_cart", product(k), quantity(k))),
        steps(F.col("checks_out").cast("int"), lambda k: step(end, "begin_checkout")),
        steps(F.col("pays").cast("int"), lambda k: step(end + 30 + 60 * draw(F.lit("paying"), k), "purchase")),
    )
    # what is paid: the cart without what was taken out of it, which is its first product
    paid = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(MOST + 1)), lambda k: (k >= F.col("n_removed")) & (k < F.col("n_carts"))), F.lit(0.0), lambda s, k: s + price_of(product(k)) * quantity(k))
    held = visits.withColumns({"paid": F.round(paid, 2), "steps": F.sort_array(all_steps)})
    held = held.select("*", F.posexplode("steps").alias("number", "step")).drop("steps")
    kind, item = F.col("step.kind"), F.col("step.product")
    place = F.concat(F.date_format("day", "yyyyMMdd"), F.lit("-"), F.col("shard").cast("string"), F.lit("-"), F.col("session").cast("string"))
    category = lambda x: F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod(x, F.lit(len(CATEGORIES))) + 1).cast("int"))
    at = F.timestamp_millis((F.unix_millis(F.col("day").cast("timestamp")) + 1000 * (F.col("start") + F.col("step.at"))).cast("bigint"))
    page = F.when(kind == "search", F.concat(F.lit("/search/"), category(F.col("number")))).when(F.col("number") == 0, "/").when(kind == "page_view", F.concat(F.lit("/category/"), category(F.col("number")))).when(kind == "begin_checkout", "/checkout").when(kind == "purchase", "/thank-you").otherwise(F.concat(F.lit("/product/"), item.cast("string")))
    utm = F.when(F.col("channel") != "direct", F.col("channel"))
    return held.select(
        "day", "shard", "session", "number", F.concat_ws("-", F.lit("s"), place, F.col("number").cast("string")).alias("event_id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_ts"),
        F.concat(F.lit("u"), F.col("user").cast("string")).alias("user_id"), kind.alias("event_type"), page.alias("page_url"), F.concat(F.lit("p"), item.cast("string")).alias("product_id"), F.when(item.isNotNull(), category(item)).alias("category"),
        F.when(item.isNotNull(), price_of(item)).alias("price"), F.col("step.quantity").alias("quantity"), F.when(kind == "purchase", F.concat(F.lit("order-"), place)).alias("order_id"), F.when(kind == "purchase", F.col("paid")).alias("order_value"),
        "device_type", "os", "browser", "country", F.when(F.col("number") == 0, F.concat(F.lit("https://"), utm, F.lit(".example/"))).alias("referrer"), utm.alias("utm_source"),
        F.concat(utm, F.lit("-"), (1 + F.floor(4 * draw(F.lit("campaign")))).cast("string")).alias("utm_campaign"),
    )


def delivered(held: DataFrame, conf: Synth) -> DataFrame:
    """Events as payloads with the day they arrive: payload, dt, and what was done to them (noise)."""
    draw = lambda what: uniform(F.lit(conf.seed), "event_id", F.lit(what))
    fate = draw("fate")
    noise = F.when(fate < conf.bad_rate, "damaged").when(fate < conf.bad_rate + conf.late_rate, "late").when(draw("twice") < conf.dup_rate, "repeated").otherwise("none")
    # kinds of damage: 0 torn, 1 no user, 2 unknown type, 3 unreadable time, and for events with a price 4 a negative one
    kind = F.when(noise == "damaged", F.floor(draw("damage") * F.when(F.col("price") > 0, 5).otherwise(4)).cast("int"))
    rows = held.withColumns({"noise": noise, "damage": kind})
    spoilt = {"user_id": F.when(F.col("damage") == 1, None), "event_type": F.when(F.col("damage") == 2, "wave"), "event_ts": F.when(F.col("damage") == 3, "soon"), "price": F.when(F.col("damage") == 4, -F.col("price"))}
    number = {"user_id": 1, "event_type": 2, "event_ts": 3, "price": 4}
    fields = [F.when(F.col("damage") == number[c], spoilt[c]).otherwise(F.col(c)).alias(c) if c in spoilt else F.col(c) for c in held.columns if c not in ("day", "shard", "session", "number")]
    rows = rows.withColumn("payload", F.to_json(F.struct(*fields)))
    rows = rows.withColumn("payload", F.when(F.col("damage") == 0, F.expr("left(payload, int(length(payload) * 0.6))")).otherwise(F.col("payload")))
    delays = F.when(F.col("noise") == "late", F.array(F.lit(1))).when(F.col("noise") == "repeated", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("delay", F.explode(delays)).select("payload", F.date_add("day", F.col("delay")).alias("dt"), "noise")


def generated(spark: SparkSession, conf: Synth = Synth()) -> DataFrame:  # noqa: B008
    """payload, dt (arrival date)."""
    return delivered(events(spark, conf), conf).select("payload", "dt")
