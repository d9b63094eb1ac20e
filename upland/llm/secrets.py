"""Secret scan with DataFrame operations only: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters with a digit, a value assigned to a telling name, or a known key; one
word may hold several, each with what stands before it in the word. Its features are length, character classes and
their transitions, coverage by a small dictionary of word parts, the path, and the neighbouring words. The forest is
trained on labelled findings: a table of value, before, after, path and label, by default the made-up ones of
`labelled_findings`, whose number is its documented bound.

One row is returned for each finding that stands, several for a word of several, with a digest in place of the
value. Null and empty texts have none; a null path is an empty one; repeated words or rows are findings each; only doc_id, text and source are
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
TREES, DEPTH, SEED = 24, 6, 7
FINDINGS, NOISE = 6000, 0.02
THRESHOLD = 0.5

#: Names whose value is often secret (fixed values).
NAMES = ["access_key", "apikey", "api_key", "auth", "bearer", "client_secret", "credential", "passphrase", "passwd", "password", "private_key", "pwd", "secret", "token"]
#: Words beside values that are no secrets (fixed values).
HARMLESS = ["build", "changeme", "checksum", "commit", "digest", "dummy", "example", "fingerprint", "hash", "id", "md5", "order", "phone", "placeholder", "revision", "sample", "sha", "sha1", "sha256", "tracking", "uuid", "version", "your"]
#: Path parts of files that hold no live secrets (fixed values).
QUIET_PATHS = ["demo", "doc", "docs", "example", "examples", "fixture", "fixtures", "mock", "sample", "samples", "spec", "test", "tests", "vendor"]
#: Prefixes of known kinds of keys (fixed values).
PREFIXES = {
    "aws": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"[sr]k_live_[A-Za-z0-9]{16,}",
}
#: Word parts that made-up keys seldom hold (fixed values).
DICTIONARY = ["about", "after", "ance", "and", "are", "ation", "ble", "data", "ent", "ere", "ess", "est", "file", "for", "from", "have", "heit", "her", "here", "ing", "ion", "ity", "key", "keit", "lich", "ment", "name", "not", "ough", "ous", "page", "que", "sch", "ter", "test", "that", "the", "ther", "this", "ung", "user", "val", "ver", "with", "you", "your"]

_NAME = "(?i)(?:" + "|".join(n.replace("_", "[_-]?") for n in NAMES) + ")"
_RUN = r"[A-Za-z0-9+/_=.-]{16,}"
#: A text without this has no candidate: a long run of key characters, a telling name in a word that ends with a sign
#: or has one after it, or a prefix. It is no narrower than what `candidates` chooses.
_ANY = "|".join([r"[A-Za-z0-9+/_=.-]{16}", _NAME + r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]*[:=]", *PREFIXES.values()])
_ASSIGNED = _NAME + r"[a-z0-9_-]*[\"']?[:=]+[\"']?"
#: Where a value begins within a word: after a telling name, or after the user in a URL.
_BEGINS = _ASSIGNED + r"|://[^\s/@:]*:(?=[^\s/@]+@)"
_EDGES = r"^[\"'(\[{<]+|[\"')\]}>,;.!?#$%&*|]+$"

FEATURES = ["length", "distinct", "digits", "uppers", "others", "changes", "vowels", "covered", "hex", "numeric", "prefix", "named", "assigned", "harmless", "quiet"]
_CONTEXT = ["value", "before", "after", "path"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word (from 0), value, before, after and path of every candidate; texts without any aren't cut up."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), text.alias("text")).filter(F.col("text").rlike(_ANY))
    words = rows.select("doc_id", "path", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))

    def chosen(w: Column, i: Column) -> Column:
        prior = F.coalesce(F.get(w, i - 1), F.lit(""))
        named = F.when(prior.rlike(r"^[:=]+$"), F.coalesce(F.get(w, i - 2), F.lit(""))).when(prior.rlike("[:=]$"), prior).otherwise("")
        own = F.get(w, i)
        run = own.rlike(_RUN) & own.rlike("[0-9]")
        return run | own.rlike("|".join(PREFIXES.values())) | own.rlike(_ASSIGNED + r"[^\s\"']{6,}") | (named.rlike(_NAME) & own.rlike(r"[A-Za-z0-9+/_=.@!$%&*-]{6,}"))

    found = words.select("doc_id", "path", "words", F.explode(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: chosen(F.col("words"), i))).alias("word"))
    near = lambda a, b: F.concat_ws(" ", *[F.coalesce(F.get("words", F.col("word") + k), F.lit("")) for k in range(a, b)])
    own = F.get("words", F.col("word"))
    inner = F.regexp_replace(own, _ASSIGNED, "")
    whole = F.coalesce(F.nullif(F.regexp_extract(inner, r"([A-Za-z0-9+/_=.-]{12,}[A-Za-z0-9/_=-])", 1), F.lit("")), F.regexp_replace(inner, _EDGES, ""))
    pieces = F.split(F.regexp_replace(F.translate("own", "\x01\x02", "  "), f"({_BEGINS})", "\x01$1\x02"), "\x01")
    values = F.flatten(F.transform(pieces, _values))
    only = F.array(F.struct(F.col("whole").alias("value"), F.regexp_extract("own", _ASSIGNED, 0).alias("name")))
    cut = found.select("doc_id", "path", "word", own.alias("own"), whole.alias("whole"), near(-3, 0).alias("prior"), near(1, 3).alias("after"))
    each = cut.select("doc_id", "path", "word", "prior", "after", F.explode(F.when(F.size(values) > 0, values).otherwise(only)).alias("v"))
    return each.select("doc_id", F.col("word").cast("long").alias("word"), F.col("v.value").alias("value"), F.concat_ws(" ", "prior", "v.name").alias("before"), "after", "path")


def _values(piece: Column) -> Column:
    """value and name of all candidates in a piece of a word: its name's value, and runs with a digit or prefix."""
    named = F.contains(piece, F.lit("\x02"))
    name = F.when(named, F.substring_index(piece, "\x02", 1)).otherwise("")
    rest = F.substring_index(piece, "\x02", -1)
    ends = F.when(name.rlike("://"), F.regexp_extract(rest, "^[^@]*", 0)).when(name.rlike("[\"']$"), F.regexp_extract(rest, "^[^\"']*", 0)).otherwise(F.regexp_extract(rest, r"^[^\"'&;,<>(){}\[\]|]*", 0))
    head = F.when(named, ends).otherwise("")
    tail = F.substr(rest, F.length(head) + 1)
    run = F.regexp_extract(head, r"([A-Za-z0-9+/_=.-]{12,}[A-Za-z0-9/_=-])", 1)
    given = F.coalesce(F.nullif(run, F.lit("")), F.regexp_replace(head, _EDGES, ""))
    runs = lambda text: F.filter(F.regexp_extract_all(text, F.lit("(" + "|".join([_RUN, *PREFIXES.values()]) + ")"), F.lit(1)), lambda r: r.rlike("[0-9]") | r.rlike("|".join(PREFIXES.values())))
    struct = lambda value, name: F.struct(F.regexp_replace(value, "[+.]+$", "").alias("value"), name.alias("name"))
    first = F.when(F.length(given) >= 6, F.array(F.struct(given.alias("value"), name.alias("name")))).otherwise(F.array().cast("array<struct<value:string,name:string>>"))
    more = F.transform(F.concat(runs(F.substr(head, F.position(run, head) + F.length(run))), runs(tail)), lambda r: struct(r, F.lit("")))
    return F.concat(first, more)


def kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in PREFIXES.items():
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.when(value.rlike("^[0-9a-fA-F]{16,}$"), "hex").otherwise("other"))


def with_features(found: DataFrame) -> DataFrame:
    value, size = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    part = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    word_in = lambda c, words: c.rlike(r"(?i)(?:^|[^a-z])(?:" + "|".join(words) + r")(?:$|[^a-z])").cast("double")
    low = F.lower(value)
    return found.withColumns({
        "length": F.least(size, F.lit(200.0)),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "digits": part("[0-9]"),
        "uppers": part("[A-Z]"),
        "others": part("[^A-Za-z0-9]"),
        "changes": part("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "vowels": F.regexp_count(low, F.lit("[aeiouäöüéè](?=[^aeiou0-9])")) / size,
        "covered": (size - F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))) / size,
        "hex": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "numeric": value.rlike("^[0-9._/+-]+$").cast("double"),
        "prefix": value.rlike("|".join(PREFIXES.values())).cast("double"),
        "named": F.col("before").rlike(_NAME).cast("double"),
        "assigned": F.col("before").rlike(r"[:=][\"']?\s*$").cast("double"),
        "harmless": F.greatest(word_in(F.col("before"), HARMLESS), word_in(F.col("after"), HARMLESS), word_in(low, HARMLESS)),
        "quiet": word_in(F.col("path"), QUIET_PATHS),
    })


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """`n` made-up findings, half of them secrets; hash functions of the row number stand for keys, and NOISE of the
    labels are wrong, as those of people are."""
    rows = spark.range(n).withColumns({"h": F.sha2(F.col("id").cast("string"), 256), "p": F.pmod(F.xxhash64("id"), F.lit(7))})

    def drawn(words: list[str], salt: int = 0) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(len(words))).cast("int") + 1)

    def hexes(first: int, count: int) -> Column:
        return F.substring("h", first, count)

    b64 = F.regexp_replace(F.base64(F.unhex(hexes(1, 48))), "[^A-Za-z0-9]", "x")
    name, word, part = drawn(NAMES), drawn(HARMLESS), [drawn(DICTIONARY, k) for k in range(5)]
    sign = drawn([" =", "=", ":", " :", '="', "='", '":"'], 11)
    prose = drawn(["of the", "und der", "que la", "in this", "", "and set it to", "export"], 12)
    own = drawn(["", "", "my_", "DB_", "x-", "aws_", "prod."], 13)
    parts = F.concat(*part)
    uuid = F.regexp_replace(hexes(1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    digits = F.substring(F.conv(hexes(1, 15), 16, 10), 1, 16)
    two = F.substring(digits, 1, 2)
    named = F.concat_ws(" ", prose, F.concat(own, name, drawn(["", "", "2", "_prod"], 14), sign))
    harmless = F.concat_ws(" ", prose, F.concat(word, sign))
    bearer = F.concat_ws(" ", prose, F.lit("Authorization: Bearer"))
    login = F.concat(prose, F.lit(" postgres://"), part[0], F.lit(":"))
    leet = F.translate(F.concat(part[0], part[1]), "aeio", "43i0")
    secret = [
        (hexes(1, 40), named), (F.upper(hexes(1, 40)), F.upper(named)), (hexes(1, 32), named), (F.lower("h"), named), (b64, named),
        (F.substring(b64, 1, 20), named), (b64, bearer), (F.substring(b64, 1, 16), login),
        (F.concat(F.lit("AKIA"), F.upper(hexes(5, 16))), prose), (F.concat(F.lit("ghp_"), b64, hexes(1, 12)), prose),
        (F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)), named), (F.concat(F.lit("xoxb-"), digits, F.lit("-"), F.substring(b64, 1, 12)), prose),
        (F.concat(F.lit("eyJ"), b64, F.lit("."), b64, F.lit("."), F.substring(b64, 1, 20)), bearer), (F.concat(F.substring(b64, 1, 9), F.lit("!7")), named),
        (F.concat(part[0], part[1], two, F.substring(b64, 1, 1)), named), (F.concat(F.initcap(part[0]), F.initcap(part[1]), two, F.lit("!")), named),
        (F.concat(leet, two), named), (F.concat_ws("-", part[0], part[1], part[2], two), named), (F.substring(b64, 1, 10), named),
    ]
    not_secret = [
        (hexes(1, 40), F.concat_ws(" ", prose, word)), (hexes(1, 32), harmless), (F.lower("h"), harmless), (uuid, harmless), (uuid, prose),
        (F.concat(parts, F.lit("2")), prose), (F.concat(parts, F.lit("-"), hexes(1, 2), F.lit(".html")), prose), (digits, prose), (digits, harmless),
        (F.concat(F.lit("YOUR_"), F.upper(name), F.lit("_HERE1")), named), (F.concat(F.lit("your-"), name, F.lit("-"), two), named),
        (F.concat_ws("/", F.lit("https"), parts, digits), prose), (parts, named), (F.concat(part[0], part[1]), named),
        (drawn(["required", "enabled", "disabled", "undefined", "optional", "forgotten", "********", "xxxxxxxxxxxx", "${TOKEN}", "changeme1", "example123"], 15), named),
        (F.concat_ws("/", F.lit("src"), part[0], part[1], F.concat(parts, F.lit("2.java"))), prose),
        (F.concat(F.lit("1."), two, F.lit(".3-beta."), two, F.lit("+build."), digits), harmless), (F.concat_ws("-", part[0], part[1], two, part[2], part[3]), prose),
        (F.concat(F.lit("www."), parts, two, F.lit(".org/"), part[0]), prose),
    ]

    def chosen(cases: list[tuple[Column, Column]], j: int) -> Column:
        return F.element_at(F.array(*[c[j] for c in cases]), (F.floor(F.col("id") / 2) % len(cases)).cast("int") + 1)

    true = F.col("id") % 2 == 0
    wrong = F.pmod(F.xxhash64("h", F.lit(16)), F.lit(1000)) < int(1000 * NOISE)
    path = F.when(~true & (F.col("p") == 3), drawn(QUIET_PATHS, 17)).otherwise(drawn(["src", "etc", "web", "book", ""], 18))
    return rows.select(
        F.when(true, chosen(secret, 0)).otherwise(chosen(not_secret, 0)).alias("value"),
        F.when(true, chosen(secret, 1)).otherwise(chosen(not_secret, 1)).alias("before"),
        drawn(["of the", "und der", "que la", "in this", "", "for it", "# set"], 19).alias("after"),
        path.alias("path"),
        (true != wrong).cast("double").alias("label"),
    )


def fit(labelled: DataFrame) -> PipelineModel:
    """The forest over labelled findings (value, before, after, path, label)."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    train = with_features(labelled.select(*_CONTEXT, "label")).select(*FEATURES, "label").coalesce(1)  # a bounded table; one partition keeps reruns equal
    return PipelineModel([vectors, forest.fit(vectors.transform(train))])


def score(found: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(with_features(found))
    return scored.withColumn("score", vector_to_array("probability").getItem(1)).drop("features", "rawPrediction", "probability", "prediction", *FEATURES)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, word, kind, length, score and value_sha256 of every finding that the forest lets stand; no shuffle."""
    model = fit(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    rows = score(candidates(docs), model).filter(F.col("score") >= threshold)
    return rows.select("doc_id", "word", kind(F.col("value")).alias("kind"), F.length("value").cast("long").alias("length"), "score", F.sha2("value", 256).alias("value_sha256"))
