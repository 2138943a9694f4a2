"""Market and social feed messages to records.

Every function takes rows with the JSON message in ``value`` and returns
``(_schema_slug, record)`` with the record as a map of texts, in batch or streaming.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_MAP = "map<string,string>"

# Readable names of the short keys.
TICKER_24H = {
    "e": "eventType", "E": "eventTime", "s": "symbol", "p": "priceChange", "P": "priceChangePercent",
    "w": "weightedAveragePrice", "x": "firstTradePrice", "c": "lastPrice", "Q": "lastQty", "b": "bestBidPrice",
    "a": "bestAskPrice", "A": "bestAskQty", "o": "openPrice", "h": "highPrice", "l": "lowPrice",
    "v": "baseAssetVolume", "q": "quoteAssetVolume", "O": "openTime", "C": "closeTime", "F": "firstTradeId",
    "L": "lastTradeId", "n": "numTrades",
}
MINI_TICKER = {
    "e": "eventType", "E": "eventTime", "s": "symbol", "c": "closePrice", "o": "openPrice", "h": "highPrice",
    "l": "lowPrice", "v": "baseAssetVolume24hr", "q": "quoteAssetVolume24hr",
}
BOOK_TICKER = {
    "u": "orderBookUpdateId", "s": "symbol", "b": "bestBidPrice", "B": "bestBidQty", "a": "bestAskPrice", "A": "bestAskQty",
}
# Fields by position, as (key, positions).
KRAKEN_TICKER = (
    ("a", ("ask_price", "ask_whole_lot_volume", "ask_lot_volume")),
    ("b", ("bid_price", "bid_whole_lot_volume", "bid_lot_volume")),
    ("c", ("close_price", "close_lot_volume")),
    ("v", ("volume_today", "volume_last_24_hours")),
    ("p", ("weighted_average_price", "weighted_average_last_24_hours")),
    ("t", ("trades_today", "trades_last_24_hours")),
    ("l", ("low_today", "low_last_24_hours")),
    ("h", ("high_today", "high_last_24_hours")),
    ("o", ("open_price", "open_last_24_hours")),
)
KRAKEN_TRADE = ("price", "volume", "time", "side", "orderType", "misc")
KRAKEN_SPREAD = ("bid", "ask", "timestamp", "bidVolume", "askVolume")


def _text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def _named(pairs: Mapping[str, Column]) -> Column:
    """A map of texts without the missing entries."""
    full = F.create_map(*[x for name, value in pairs.items() for x in (F.lit(name), value)])
    whole = F.lit(True)
    for value in pairs.values():
        whole = whole & value.isNotNull()
    return F.when(whole, full).otherwise(F.map_filter(full, lambda _, v: v.isNotNull()))


def _object(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", TEXT_MAP)


def normalize_coinbase(messages: DataFrame) -> DataFrame:
    """``ticker`` and ``match`` records; ``last_match`` counts as ``match``, the rest is control."""
    record = F.from_json("value", TEXT_MAP)
    kind = F.try_element_at("record", F.lit("type"))
    slug = F.when(kind == "ticker", "ticker").when(kind.isin("match", "last_match"), "match")
    return messages.select(record.alias("record")).select(slug.alias("_schema_slug"), "record").filter(
        F.col("_schema_slug").isNotNull()
    )


def normalize_binance(messages: DataFrame, book_ticker: bool = False) -> DataFrame:
    """24-hour tickers, mini tickers and (on that channel) book tickers with readable names."""
    data = messages.select(F.from_json(F.get_json_object("value", "$.data"), TEXT_MAP).alias("d"))
    kind = F.try_element_at("d", F.lit("e"))

    def renamed(names: Mapping[str, str]) -> Column:
        return _named({long: F.try_element_at("d", F.lit(short)) for short, long in names.items()})

    slug = F.when(kind.isin("24hrTicker", "24hrMiniTicker"), kind)
    record = F.when(kind == "24hrTicker", renamed(TICKER_24H)).when(kind == "24hrMiniTicker", renamed(MINI_TICKER))
    if book_ticker:
        slug = F.coalesce(slug, F.lit("bookTicker"))
        record = record.otherwise(renamed(BOOK_TICKER))
    return data.select(slug.alias("_schema_slug"), record.alias("record")).filter(F.col("_schema_slug").isNotNull())


def normalize_ftx(messages: DataFrame) -> DataFrame:
    """``update`` messages of the ticker and trades channels, one record per item, with the market.

    A message is parsed once, and the maps of its items are read from it at once.
    """
    v = F.col("v")
    # other messages go as they have no items: a filter would parse every message once more
    parts = messages.select(F.try_parse_json("value").alias("v")).select("v", _text(v, "$.type").alias("type"), _text(v, "$.channel").alias("_schema_slug"))
    kept = (F.col("type") == "update") & F.col("_schema_slug").isin("ticker", "trades")
    items = F.coalesce(F.try_variant_get(v, "$.data", f"array<{TEXT_MAP}>"), F.array(F.try_variant_get(v, "$.data", TEXT_MAP)))
    exploded = parts.select("_schema_slug", _text(v, "$.market").alias("market"), F.explode(F.when(kept, items)).alias("item"))
    return exploded.select("_schema_slug", F.map_concat("item", F.create_map(F.lit("market"), F.col("market"))).alias("record"))


def normalize_gemini(messages: DataFrame, symbol: Column) -> DataFrame:
    """``events`` of update messages; ``change`` is a ticker; the type becomes the schema."""
    parsed = messages.select(symbol.alias("symbol"), F.try_parse_json("value").alias("v"))
    updates = parsed.filter(_text(F.col("v"), "$.type") == "update")
    events = updates.select(
        "symbol", F.explode(F.try_variant_get("v", "$.events", "array<variant>")).alias("event")
    ).select("symbol", _object(F.col("event")).alias("event"))
    kind = F.try_element_at("event", F.lit("type"))
    slug = F.when(kind == "change", "ticker").otherwise(kind)
    rest = F.map_filter("event", lambda k, _: k != "type")
    return events.select(
        slug.alias("_schema_slug"), F.map_concat(rest, F.create_map(F.lit("symbol"), F.col("symbol"))).alias("record")
    )


def normalize_kraken(messages: DataFrame) -> DataFrame:
    """Positional ticker, trade (one record each) and spread messages to named fields.

    A message is parsed once and its body read once, as every value that is taken from a parsed message costs about as much as a
    short message's parsing: a filter on the bodies would read them a second time, so messages without records go as they have no items.
    """
    v, slug = F.col("v"), F.col("_schema_slug")
    parts = messages.select(F.try_parse_json("value").alias("v")).select("v", _text(v, "$[2]").alias("_schema_slug"), _text(v, "$[3]").alias("pair"))

    def body(channel: str, kind: str) -> Column:
        return F.when(slug == channel, F.try_variant_get(v, "$[1]", kind)).alias(channel)

    quotes = ", ".join(f"`{key}`: array<string>" for key, _ in KRAKEN_TICKER)
    bodies = parts.select("_schema_slug", "pair", body("ticker", f"struct<{quotes}>"), body("trade", "array<array<string>>"), body("spread", "array<string>"))
    # every record's values by position
    ticker = F.array(*[F.get(F.col(f"ticker.`{key}`"), F.lit(i)) for key, names in KRAKEN_TICKER for i in range(len(names))])
    items = F.when(F.col("ticker").isNotNull(), F.array(ticker)).when(F.col("spread").isNotNull(), F.array("spread")).otherwise(F.col("trade"))
    rows = bodies.select("_schema_slug", "pair", F.explode(items).alias("item")).filter("item IS NOT NULL")

    def named(names: tuple[str, ...], **more: Column) -> Column:
        return _named({**more, **{name: F.get("item", F.lit(i)) for i, name in enumerate(names)}})

    quote = named(tuple(name for _, names in KRAKEN_TICKER for name in names), pair=F.col("pair"))
    record = F.when(slug == "trade", named(KRAKEN_TRADE, pair=F.col("pair"))).when(slug == "ticker", quote).otherwise(named(KRAKEN_SPREAD))
    return rows.select("_schema_slug", record.alias("record"))


SOCIAL = (
    "data struct<id:string, text:string, author_id:string, created_at:string, geo:struct<place_id:string>>, "
    "includes struct<users:array<struct<id:string, name:string, username:string>>, "
    "places:array<struct<id:string, full_name:string, country:string>>>"
)


def social_enrich(messages: DataFrame) -> DataFrame:
    """Posts with their author and place, looked up in the same message, without a join."""
    m = messages.select(F.from_json("value", SOCIAL).alias("m")).select("m.data.*", "m.includes.*")
    author = F.get(F.filter("users", lambda u: u["id"] == F.col("author_id")), F.lit(0))
    place = F.get(F.filter("places", lambda p: p["id"] == F.col("geo.place_id")), F.lit(0))
    return m.select(
        F.lit("tweets").alias("_schema_slug"), "id", "text", "author_id",
        F.try_to_timestamp("created_at").alias("created_at"),
        F.when(F.col("geo.place_id").isNotNull(), F.col("geo")).alias("geo"),
        author.alias("author"),
        F.when(F.col("geo.place_id").isNotNull(), place).alias("place"),
    )


def event_json(messages: DataFrame, schema: str) -> DataFrame:
    """Each event body is one JSON record of the schema ``event``."""
    return messages.select(F.lit("event").alias("_schema_slug"), F.from_json("value", schema).alias("record")).select(
        "_schema_slug", "record.*"
    )
