"""A small labelled table of hosts and paths for the URL filter.

All hosts are invented ones under the reserved names example.com, example.net and example.org. Every name stands under
each ending and in each language folder once, so neither tells anything about the label: only the names do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that are blocked: gambling, dubious medicine, advertising and tracking, spam, adult sites.
UNWANTED = """
casino-royal casino-bonus top-casino casinoclub win-casino big-win-slots win-cash slots-win poker-win jackpot-win lucky-win
best-bets sport-bets betsonline bets-now livebets free-slots free-spins free-casino free-poker poker-room roulette-club
pills-online diet-pills pillshop best-pills cheap-meds cheap-viagra cheap-cialis viagra-shop weight-loss-pills cheap-pharmacy
ads-server ads-click adserver-track popup-ads banner-ads ads-network click-track track-pixel tracker-ads user-track pixel-track
spam-mail mail-spam spamlist link-farm farm-links content-farm click-farm spam-links seo-spam spam-bot
adult-video adult-chat adults-only adult-cams adult-dating xxx-video x-rated sex-x live-sex porn-x xxx-cams
""".split()

#: Names that are allowed: ordinary words, short and long, in several languages, and names that mean nothing.
ORDINARY = """
weather garden library museum university kitchen recipes history science travel railway theatre concert football cycling
hospital pharmacist dentist school teacher students news daily-post morning-post city-hall town-council mountain-club river
farmers-market tractor winery windmill window-shop tracks-and-trails adventure address freedom freelance alphabet betty winter
wetter garten bibliothek zeitung bahnhof schule kirche rathaus fahrrad kochbuch jardin mairie musee cuisine voyage lycee gare
tiempo jardin-botanico biblioteca cocina viajes escuela ayuntamiento mercado then there other thing another nation station
motion action table stable whole where which white mother brother father weather-map therapy theory thesis thread three
thorn north south earth growth anthem rhythm method author thomas martin helena river-song blue-sky green-tea red-brick
lotion portion mention section honest lament torque sender reseda indore stenor aller enton resten ander tornis heron inland
""".split()

ENDINGS, LANGUAGES, PREFIXES = ("com", "net", "org"), ("en", "de", "fr", "es"), ("", "www.", "m.", "blog.")
SUFFIXES = ("", "/", ".html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(`host`, `path`, `label`): each name under every ending and in every language; label 1 means block."""
    names = [F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"), F.lit(label).alias("label")) for label, group in ((1, UNWANTED), (0, ORDINARY)) for n, name in enumerate(group)]
    places = [F.struct(F.lit(e).alias("ending"), F.lit(x).alias("language"), F.lit(k).alias("k")) for k, (e, x) in enumerate((e, x) for e in ENDINGS for x in LANGUAGES)]
    rows = spark.range(1).select(F.explode(F.array(*names)).alias("of")).select("of.*", F.explode(F.array(*places)).alias("at")).select("name", "n", "label", "at.*")
    turn = F.col("n") + F.col("k")
    prefix = F.get(F.array(*map(F.lit, PREFIXES)), turn % len(PREFIXES))
    number = (F.col("n") * 7919 + F.col("k") * 104_729) % 9973
    page = F.concat(number.cast("string"), F.get(F.array(*map(F.lit, SUFFIXES)), turn % len(SUFFIXES)))
    return rows.select(F.concat(prefix, "name", F.lit(".example."), "ending").alias("host"), F.concat(F.lit("/"), "language", F.lit("/"), page).alias("path"), "label")
