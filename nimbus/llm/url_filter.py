"""URL filter: host/path rules, then logistic regression on hashed character n-grams.

A url is judged by the longest matching rule; where no rule matches, a logistic
regression over hashed character n-grams of host and path decides. Everything
is DataFrame or ML-pipeline code on the JVM side; the model is trained from a
small labelled table of urls that the caller passes in.

Defined results for odd input: a null url or one without ``://`` has an empty
host and path and no features beyond the empty-url ones, so it gets the
model's verdict on an empty text; repeated pages are judged row by row; an
empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, path, verdict); fixed values of the contract
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# words of host names and paths that the labelled table is built from
BLOCK_WORDS = [
    "casino", "casino-online", "cheap-meds", "pills-shop", "pills", "adult", "adult-video", "spam", "spam-links",
    "link-farm", "free-spins", "free-money", "bets", "sports-bets", "ads", "ads-banner", "adserver", "click-track",
    "tracker", "viagra", "porn", "xxx", "poker", "slots", "jackpot", "lottery", "payday-loan", "escort", "hookup",
    "warez", "keygen", "torrent", "pharma-discount", "replica-watch", "win-prize", "win-cash",
]
ALLOW_WORDS = [
    "news", "science", "library", "university", "recipes", "garden", "travel-notes", "history", "weather", "open-data",
    "museum", "health-info", "music", "school", "daily", "journal", "thistle", "north", "archive", "forum", "wiki",
    "nation", "inges", "wheat", "stone", "river", "market", "theatre", "thing", "ration", "city-hall", "e-learning",
]
PREFIXES = ["", "www.", "blog.", "m.", "cdn."]
FRAMES = ["{}", "my-{}", "{}24", "the{}site", "old-{}-home"]
PATHS = ["/", "/en/12", "/de/48.html", "/fr/7/", "/es/903", "/page/index", ""]
TLDS = ["example.com", "example.net", "example.org", "test", "com", "org"]


def with_parts(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every page (host A-Z lower-cased)."""
    # the url's own characters ? and # end both host and path, so they are cut first
    after = F.coalesce(F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    cut = F.split_part(F.split_part(after, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return (
        pages.select("page_id", cut.alias("_rest"))
        .withColumn("_host", F.split_part("_rest", F.lit("/"), F.lit(1)))
        .select(
            "page_id",
            F.translate("_host", UPPER, LOWER).alias("host"),
            F.expr("substring(_rest, length(_host) + 1)").alias("path"),
        )
    )


def rule_column(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; null where none does."""
    rule = verdict = None
    for host, path, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def char_ngrams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of ``^text$`` for every size, as one array of strings."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    grams = [
        F.when(
            F.length(padded) >= n,
            F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i, n=n: F.substr(padded, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))
        for n in sizes
    ]
    return F.concat(*grams)


def features(parts: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), dims: int = 1 << 16) -> DataFrame:
    """Adds ``features``: hashed n-gram presence of host (marked ``h``) and path (marked ``p``)."""
    lowered = F.translate("path", UPPER, LOWER)
    grams = F.concat(
        F.transform(char_ngrams(F.col("host"), sizes), lambda g: F.concat(F.lit("h"), g)),
        F.transform(char_ngrams(lowered, sizes), lambda g: F.concat(F.lit("p"), g)),
    )
    tf = HashingTF(numFeatures=dims, binary=True, inputCol="_grams", outputCol="features")
    return tf.transform(parts.withColumn("_grams", grams)).drop("_grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``url, label`` (1 block), every word in every frame and under every prefix."""
    words = spark.createDataFrame(
        [(w, 1.0) for w in BLOCK_WORDS] + [(w, 0.0) for w in ALLOW_WORDS], "word string, label double"
    )
    frames = F.explode(F.array(*[F.replace(F.lit(f), F.lit("{}"), F.col("word")) for f in FRAMES]))
    framed = words.select("label", frames.alias("w"))
    hosts = framed.select("label", F.explode(F.array(*[F.concat(F.lit(p), F.col("w")) for p in PREFIXES])).alias("h"))
    # domain and path by the host's checksum: both labels get all of them
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), (F.crc32(F.concat("h", F.lit(salt))) % len(options) + 1).cast("int"))
    return hosts.select(F.concat(F.lit("http://"), "h", F.lit("."), pick(TLDS, "t"), pick(PATHS, "p")).alias("url"), "label")


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), dims: int = 1 << 16) -> LogisticRegressionModel:
    """Logistic regression from a labelled table ``url, label``. The table is one
    person's labelling work and so bounded; it is read into one partition."""
    data = with_parts(labelled.withColumnRenamed("label", "page_id")).withColumnRenamed("page_id", "label")
    frame = features(data, sizes, dims).select("label", "features").coalesce(1)
    return LogisticRegression(regParam=1e-3, maxIter=60, standardization=False).fit(frame)


def judge(
    pages: DataFrame,
    model: LogisticRegressionModel,
    rules: list[tuple[str, str, str]] = RULES,
    threshold: float = 0.5,
    sizes: tuple[int, ...] = (3, 4, 5),
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the rule's verdict, else the model's."""
    parts = features(with_parts(pages), sizes, model.numFeatures)
    rule, verdict = rule_column(rules)
    scored = model.transform(parts).withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the contract's rules, else by the trained model."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark)))
