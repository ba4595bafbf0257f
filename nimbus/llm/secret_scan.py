"""Secret scan: one regular expression proposes findings, a random forest removes the false ones.

The text is cut at every candidate (`split` and `regexp_extract_all` with the
same pattern), so each candidate comes with the text before and after it. Its
features are length, character transitions, dictionary coverage, path shape
and neighbouring words. A random forest trained from labelled findings scores
them; its trees are written out as one SQL expression, so scanning is a single
pass over the table without a shuffle, a Python worker or a join, and a
document can be redacted in the same pass.

Defined results for odd input: null and empty texts have no findings and are
returned unchanged by `redact`; a candidate that occurs twice is two findings,
and repeated rows are scanned one by one; an empty table gives an empty
result; other columns pass through `redact` untouched (its working columns
carry a prefix that no input column may start with: `_ss_`).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY_WORDS = r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api_?key|access_?key|credential|auth|bearer|private)"

# candidates: key blocks; runs of 16 or more key characters holding a digit;
# values of 8 or more characters behind a key word and a sign. Only possessive
# runs of single character classes, so long texts need no deep matching stack.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|(?<![A-Za-z0-9_+/.~-])(?=[A-Za-z_+/.~-]*+[0-9])[A-Za-z0-9_+/.~-]{16,}+={0,2}+"
    r"|(?<=[=:\"'\s])(?=[^\s\"',;]{8})(?<=[=:]\s{0,2}[\"']{0,1})"
    rf"(?<=(?:{KEY_WORDS})[sS]{{0,1}}[\"']{{0,1}}\s{{0,2}}[=:]\s{{0,2}}[\"']{{0,1}})[^\s\"',;]{{8,}}+"
)

# short common words and name parts counted as dictionary text
DICTIONARY = [
    "the", "and", "ing", "ion", "for", "with", "that", "this", "from", "site", "page", "mail", "example", "com",
    "org", "net", "www", "http", "html", "index", "user", "home", "lib", "usr", "bin", "src", "test", "data", "file",
    "doc", "version", "release", "beta", "package", "python", "java", "main", "version", "image", "img", "item",
    "order", "number", "phone", "date", "time", "name", "part", "ware", "node", "server", "local", "host", "admin",
    "report", "chapter", "section", "model", "train", "word", "blog", "post", "news", "your", "here", "sample",
    "dummy", "changeme", "placeholder",
]

OTHER_WORDS = r"(?i)(?:commit|sha|md5|checksum|hash|uuid|guid|order|isbn|phone|iban|card|invoice|version|page|file|see)"

FEATURES = (
    "length", "digits", "uppers", "vowels", "hexes", "transitions", "letter_runs", "distinct", "coverage", "slashes",
    "dots", "known_prefix", "key_before", "other_before", "assigned", "quoted",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def finding_features(c: Column, before: Column, after: Column) -> list[Column]:
    """The feature columns of a candidate and its neighbouring text, in the order of FEATURES."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    covered = F.length(F.regexp_replace(c, "(?i)" + "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), ""))
    near = F.right(before, F.lit(24))
    return [
        n,
        _count(c, "[0-9]") / n,
        _count(c, "[A-Z]") / n,
        _count(c, "[aeiouAEIOU]") / n,
        _count(c, "[0-9a-fA-F]") / n,
        _count(c, r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]") / n,
        _count(c, "[A-Za-z]{4,}") / n,
        F.size(F.array_distinct(F.split(F.left(c, F.lit(256)), ""))).cast("double") / F.least(n, F.lit(256.0)),
        F.lit(1.0) - covered / n,
        _count(c, "/") / n,
        _count(c, r"[.]") / n,
        c.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|eyJ|-----BEGIN)").cast("double"),
        near.rlike(KEY_WORDS).cast("double"),
        near.rlike(OTHER_WORDS).cast("double"),
        near.rlike(r"[=:]\s*[\"']?$").cast("double"),
        (near.rlike("[\"']$") & F.left(after, F.lit(1)).rlike("[\"']")).cast("double"),
    ]


def labelled_findings(spark: SparkSession, per_kind: int = 120) -> DataFrame:
    """A small labelled table `candidate, before, after, label` (1 secret), made by rule from row numbers.

    The random looking strings are digests of row numbers. `per_kind` bounds it.
    """
    h = F.sha2(F.concat_ws(":", "kind", "id"), 512)  # 128 hex digits
    b64 = F.regexp_replace(F.base64(F.unhex(h)), r"[+/=\r\n]", "k")
    digits = F.translate(h, "abcdef", "123456")
    words = F.concat_ws(
        "-", *[F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.crc32(F.concat(h, F.lit(str(i)))) % len(DICTIONARY) + 1).cast("int")) for i in range(4)]
    )
    cut = (F.col("id") % 5).cast("int")
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("id") % len(options) + 1).cast("int"))
    told = pick(['token = "', "password=", "api_key: ", 'secret="', "access_key = ", "auth token ", "the credential is "])
    plain = pick(["seen in ", "and then ", "found the ", "is on ", "was at ", "look for "])
    other = pick(["commit ", "checksum ", "sha256:", "uuid ", "order number ", "isbn ", "phone ", "see page "])
    given = pick(["password: ", "password = ", "PASSWORD=", "DB_PASSWORD='", "Password: ", "pwd=", "access_key = ", 'secret: "', "passwd=", '"password": "', "token="])
    spoken = F.translate(h, "0123456789abcdef", "aeioutrnslmdkpgb")  # letters that read like words
    sign = pick(["&", "!", "#", "$", "@", "*", "%"])
    digit = F.left(digits, F.lit(1))
    leet = F.translate(F.initcap(F.left(spoken, F.lit(8) + cut)), "aoie", "4013")
    upper = F.upper(F.substr(b64, F.lit(1), F.lit(16)))
    kinds = [  # (candidate, before, label)
        (F.left(h, F.lit(40)), told, 1),
        (F.substr(h, F.lit(3), F.lit(16) + cut * 4), told, 1),
        (F.left(b64, F.lit(24) + cut * 5), told, 1),
        (F.concat(F.lit("AKIA"), upper), plain, 1),
        (F.concat(F.lit("AKIA"), upper), told, 1),
        (F.concat(F.lit("ghp_"), F.left(b64, F.lit(36))), plain, 1),
        (F.concat(F.lit("sk_live_"), F.left(b64, F.lit(24))), plain, 1),
        (F.concat(F.lit("eyJ"), F.left(b64, F.lit(60))), told, 1),
        (F.left(b64, F.lit(40)), plain, 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.left(b64, F.lit(64))), plain, 1),
        (F.left(h, F.lit(40)), other, 0),
        (F.left(digits, F.lit(16) + cut), plain, 0),
        (F.left(digits, F.lit(16)), other, 0),
        (F.concat(words, F.lit("-"), F.left(digits, F.lit(4))), plain, 0),
        (F.concat(F.translate(words, "-", "."), F.left(digits, F.lit(1)), F.lit(".example.com")), plain, 0),
        (F.concat(F.translate(words, "-", "/"), F.lit("/v"), F.left(digits, F.lit(2)), F.lit(".html")), plain, 0),
        (F.concat(F.left(h, F.lit(8)), F.lit("-"), F.substr(h, F.lit(9), F.lit(4)), F.lit("-4"), F.substr(h, F.lit(13), F.lit(3)), F.lit("-9"), F.substr(h, F.lit(16), F.lit(3)), F.lit("-"), F.substr(h, F.lit(20), F.lit(12))), pick(["uuid ", "id ", "see "]), 0),
        (F.concat(F.left(digits, F.lit(4)), F.lit("-"), F.substr(digits, F.lit(5), F.lit(2)), F.lit("-"), F.substr(digits, F.lit(7), F.lit(2)), F.lit("_release-"), F.substr(digits, F.lit(9), F.lit(3))), plain, 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.left(digits, F.lit(4)), F.lit("xxxx")), told, 0),
        (pick(["example_password_1", "your-token-here-123", "changeme_changeme1", "placeholder_secret1"]), told, 0),
        (F.concat(F.lit("+"), F.left(digits, F.lit(2)), F.lit("-"), F.substr(digits, F.lit(3), F.lit(3)), F.lit("-"), F.substr(digits, F.lit(6), F.lit(3)), F.lit("-"), F.substr(digits, F.lit(9), F.lit(4))), plain, 0),
        (F.concat(leet, sign, digit), given, 1),
        (F.concat(F.left(spoken, F.lit(6)), digit, F.left(spoken, F.lit(6)), digit), given, 1),
        (F.concat(F.initcap(F.left(spoken, F.lit(5) + cut)), sign, F.left(digits, F.lit(4))), given, 1),
        (F.left(b64, F.lit(8) + cut), given, 1),
        (F.left(spoken, F.lit(8) + cut), given, 0),
        (F.concat(F.initcap(F.left(spoken, F.lit(8) + cut)), pick([".", ")", "", "?", "!"])), given, 0),
        (F.concat(F.left(spoken, F.lit(5) + cut), pick(["-", "_", "/", "."]), F.substr(spoken, F.lit(13), F.lit(6))), given, 0),
        (F.concat(pick(["https://", "http://www.", "/usr/lib/", "./"]), F.left(spoken, F.lit(6)), pick([".com/", "/"]), F.substr(spoken, F.lit(9), F.lit(5))), given, 0),
        (pick(["${PASSWORD}", "<password>", "********", "{{token}}", "your_password", "os.environ", "xxxxxxxx", "changeme123", "password1", "getenv(name)"]), given, 0),
    ]
    rows = spark.range(len(kinds) * per_kind).withColumn("kind", (F.col("id") % len(kinds)).cast("int"))
    rows = rows.withColumn("id", F.floor(F.col("id") / len(kinds)))
    choose = lambda k: F.coalesce(*[F.when(F.col("kind") == i, kinds[i][k] if k < 2 else F.lit(kinds[i][k])) for i in range(len(kinds))])
    before = choose(1)
    after = F.when(before.endswith('"'), F.lit('" and')).when(before.endswith("'"), F.lit("' and")).otherwise(F.lit(" and"))
    return rows.select(choose(0).alias("candidate"), before.alias("before"), after.alias("after"), choose(2).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel:
    """Forest from labelled findings (`candidate, before, after, label`), a bounded table."""
    cols = finding_features(F.col("candidate"), F.col("before"), F.col("after"))
    data = findings.select("label", *[c.alias(n) for n, c in zip(FEATURES, cols, strict=True)])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).select("label", "features").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def forest_sql(model: RandomForestClassificationModel, values: str) -> str:
    """The forest's mean vote for class 1 as a SQL expression over the array `values`."""

    def walk(node) -> str:
        if node.numDescendants() == 0:
            counts = [float(x) for x in node.impurityStats().stats()]
            return repr(round(counts[1] / max(sum(counts), 1e-9), 6)) + "D"
        split = node.split()
        test = f"{values}[{split.featureIndex()}] <= {float(split.threshold())!r}D"
        return f"CASE WHEN {test} THEN {walk(node.leftChild())} ELSE {walk(node.rightChild())} END"

    trees = [walk(t._call_java("rootNode")) for t in model.trees]
    return f"(({' + '.join(trees)}) / {len(trees)}D)"


def with_findings(documents: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Adds `_ss_pieces` (the text between candidates) and `_ss_found`: array of (candidate, score)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = documents.withColumns(
        {"_ss_pieces": F.split(text, CANDIDATE, -1), "_ss_cands": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))}
    )

    def described(c: Column, i: Column) -> Column:
        before = F.right(F.get("_ss_pieces", i), F.lit(48))
        after = F.left(F.get("_ss_pieces", i + 1), F.lit(24))
        return F.struct(c.alias("candidate"), F.array(*finding_features(c, before, after)).alias("f"))

    described_ = cut.withColumn("_ss_feats", F.transform("_ss_cands", described))
    found = f"transform(_ss_feats, x -> struct(x.candidate AS candidate, {forest_sql(model, 'x.f')} AS score))"
    return described_.withColumn("_ss_found", F.expr(found)).drop("_ss_cands", "_ss_feats")


def scan(documents: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: `doc_id, n, start, length, sha256, score, is_secret`.

    `n` counts the candidates of a row from 0, `start` is the 0-based character offset. The
    secret itself is not returned, only its digest.
    """
    # the row number is taken below the explode: one for each document
    found = with_findings(documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), model)
    rows = found.select(
        "doc_id",
        "row",
        F.posexplode(F.arrays_zip(F.slice(F.transform("_ss_pieces", lambda p: F.length(p)), F.lit(1), F.size("_ss_found")).alias("gap"), F.col("_ss_found").alias("hit"))).alias("n", "x"),
    )
    rows = rows.select("doc_id", "row", "n", F.col("x.gap").alias("gap"), F.length("x.hit.candidate").alias("length"), F.sha2("x.hit.candidate", 256).alias("sha256"), F.col("x.hit.score").alias("score"))
    upto = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "doc_id", "n", (F.sum(F.col("gap") + F.col("length")).over(upto) - F.col("length")).alias("start"), "length", "sha256", "score", (F.col("score") >= threshold).alias("is_secret"),
    )


def redact(documents: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every accepted secret replaced by `mark`; `n_chars`, if there, follows the new text."""
    cols = documents.columns
    found = with_findings(documents, model)
    hidden = F.transform("_ss_found", lambda x: F.when(x["score"] >= threshold, F.lit(mark)).otherwise(x["candidate"]))
    parts = F.zip_with("_ss_pieces", hidden, lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
    hit = F.exists("_ss_found", lambda x: x["score"] >= threshold)
    out = found.withColumn("_ss_hit", hit).withColumn("text", F.when(F.col("_ss_hit"), F.array_join(parts, "")).otherwise(F.col("text")))
    if "n_chars" in cols:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_ss_hit"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*cols)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in every whole text of `documents`, with its score and verdict."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(documents, train(labelled_findings(spark)))
