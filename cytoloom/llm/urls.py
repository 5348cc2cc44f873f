"""URL verdicts: host and path rules first, else a logistic regression on hashed character n-grams.

The model is trained on a small table of labelled addresses. Host and path give character n-grams (the host padded
with ``^`` and ``$``), which are hashed to a fixed number of buckets; Spark's own logistic regression is fitted on
them and scores every row on the JVM. Host and path share the buckets, so a word that is known from hosts also tells in a path.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path and is scored from those; repeated urls get
equal verdicts; an empty table gives no rows; very long urls are cut into characters once, so cost stays linear.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm.tables import A_TO_Z, let

#: (host suffix, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BUCKETS = 1 << 14
GRAMS = (3, 4)
WANTED_WEIGHT = 2.0

#: The labelled table, from general knowledge: sites and paths that a crawl for text wants, and those it does not.
#: Unwanted hosts stand with every wanted path, so that an ordinary path says nothing for them; unwanted paths stand on wanted hosts.
WANTED_HOSTS = """en.encyclopedia.org docs.python-guide.org www.nationalmuseum.co.uk library.stateuniversity.edu history.college.edu
www.dailyherald.com news.morningpost.com www.citycouncil.gov weather.gov health.gov www.parliament.uk www.kochrezepte.de
www.tageszeitung.de www.wetterdienst.de stadtbibliothek.de forschung.uni-institut.de www.lemonde-culture.fr cuisine-facile.fr
meteo-regionale.fr www.universite-paris.fr noticias-hoy.es www.recetas-caseras.es museo-arte.es biblioteca-publica.es
gardening-tips.com homecooking.net opensource-project.io developer-handbook.io mathforum.org physics-lectures.edu
astronomy-club.org birdwatching.org travel-journal.com mountain-hiking.com trainspotting.net theatre-review.com
thewriters-room.com short-stories.net poetry-archive.org classical-music.org jazz-history.com film-critics.com
chess-openings.org woodworking-plans.com bicycle-repair.net photography-school.com language-learning.com dictionary-online.com
children-stories.org teachers-network.edu hospital-guide.org nursing-journal.com law-review.edu economics-today.com
engineering-notes.net three-rivers-tribune.com other-voices.org northern-echo.com the-observer-daily.com archive-catalogue.org""".split()
UNWANTED_HOSTS = """online-casino.com royal-casino-bonus.net casino-jackpots.org vegas-slots.com poker-room.net roulette-wheel.biz
sportsbook-bets.com betting-odds.net bets24.info best-bets-today.com lottery-winner.biz big-win-lotto.com
canadian-pharmacy.biz buy-viagra.com cialis-pills.net diet-pills-shop.com cheap-meds.net cheapest-rx.org pills-without-prescription.com
xxx-videos.com porn-tube.net adult-dating.com adult-webcams.net sex-chat.org escort-girls.biz nude-pics.info
spam-mailer.biz spam-site.info seo-spam.net link-farm.biz backlink-farm.com buy-backlinks.org free-traffic.biz
ads-server.com adserver.net banner-ads.org popup-ads.biz pixel-tracker.net ad-tracking.com click-track.io ads.click-network.biz
free-iphone-winner.com get-rich-quick.biz payday-loans-now.com free-download-crack.net replica-watches.biz miracle-cure.info""".split()
WANTED_PATHS = """/ /en/ /de/ /fr/ /es/ /en/about.html /de/kontakt /fr/histoire/ /es/noticias/2021 /en/1204 /fr/77.html /es/350/ /de/9018
/news/2023/05/city-election-results /wiki/Photosynthesis /docs/install.html /recipes/apple-pie /research/papers/1042.pdf
/blog/2019/11/a-walk-in-the-hills /history/chapter-3.html /forum/thread/55120 /2024/story.html /courses/linear-algebra/notes""".split()
UNWANTED_PATHS = """/casino/bonus /casino-games/slots.html /poker/play-now /slots/free-spins /roulette/ /bets/odds-today.html /betting/tips
/pharmacy/buy-pills /viagra/order-cheap.html /cialis-online /cheap-meds/ /xxx/videos /porn/watch.html /adult/chat /sex/webcam
/nude/gallery /spam/list.html /buy-backlinks/ /link-farm/ /ads/banner.js /popup-ads/offer /adserver/click /track/pixel.gif
/win-prize-now /lottery/you-win.html /payday-loans/apply /cracked-software/download""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table as ``(url, unwanted)``: about 2,700 addresses, half of them wanted."""
    out = [(f"https://{host}{path}", 0) for host in WANTED_HOSTS for path in WANTED_PATHS]
    out += [(f"https://{host}{path}", 1) for host in UNWANTED_HOSTS for path in WANTED_PATHS]
    n = len(UNWANTED_PATHS)
    return out + [(f"https://{h}{UNWANTED_PATHS[(i + k) % n]}", 1) for i, h in enumerate(WANTED_HOSTS) for k in range(0, n, 5)]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), A_TO_Z, A_TO_Z.lower())
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits (its text, its verdict); null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        text = F.when(fits, F.lit(suffix + prefix)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def _features(df: DataFrame, into: str) -> DataFrame:
    """Adds hashed n-gram counts of the columns host and path."""
    shown = F.concat(F.lit("^"), F.col("host"), F.lit("$"), F.col("path"))

    def of_length(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
        grams = F.transform(starts, lambda i: F.concat_ws("", F.slice(chars, i, n)))
        return F.when(F.size(chars) >= n, grams).otherwise(F.array().cast("array<string>"))

    def all_grams(chars: Column) -> Column:
        return F.concat(*[of_length(chars, n) for n in GRAMS])

    cut = let(F.split(shown, ""), all_grams)
    tf = HashingTF(numFeatures=BUCKETS, inputCol="__grams", outputCol=into)
    return tf.transform(df.withColumn("__grams", cut)).drop("__grams")


def train_url_model(spark: SparkSession, labelled: DataFrame | None = None) -> LogisticRegressionModel:
    """Fit on ``labelled(url, unwanted)``; by default on ``labelled_urls``. The table must be small.

    Wanted addresses weigh ``WANTED_WEIGHT``: a host and path that tell nothing are allowed.
    """
    if labelled is None:
        values = ", ".join(f"('{url}', {unwanted})" for url, unwanted in labelled_urls())
        labelled = spark.sql(f"select * from values {values} as t(url, unwanted)")
    host, path = split_url(F.col("url"))
    seen = labelled.select(host.alias("host"), path.alias("path"), F.col("unwanted").cast("double").alias("label"))
    seen = seen.withColumn("weight", F.when(F.col("label") == 0, F.lit(WANTED_WEIGHT)).otherwise(F.lit(1.0)))
    fit = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="weight", regParam=0.02, maxIter=60)
    return fit.fit(_features(seen, "__x").coalesce(1))


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Adds ``host, path, rule, verdict, unwanted`` (the model's probability) to ``pages(url, ...)``."""
    host, path = split_url(F.col("url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "unwanted", "__x")]
    df = _features(pages.select(*kept).withColumn("host", host).withColumn("path", path), "__x")
    # Only the features are given to the model, so no column of the caller can clash with its outputs.
    model = model.copy().setFeaturesCol("__x").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__p")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return (
        model.transform(df)
        .withColumn("unwanted", vector_to_array("__p")[1])
        .withColumn("rule", rule)
        .withColumn(
            "verdict", F.coalesce(says, F.when(F.col("unwanted") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
        )
        .select(*kept, "host", "path", "rule", "verdict", "unwanted")
    )
