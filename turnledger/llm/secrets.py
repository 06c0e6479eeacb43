"""Secret scans: candidates by context and shape, false positives removed by a random forest.

A candidate is a value that a key word is assigned to (of any length and of any
characters), a password in a URL, the head of a private key, or a run of the
alphabet of keys and encodings that is no plain word and no number: letters
with digits, capitals inside, or more letters than words have. Without such
context a value of letters alone, or of digits alone, is no candidate.

A forest over length, character transitions, dictionary coverage, path and
neighbouring words, fitted on labelled findings, tells credentials from
checksums, identifiers, paths and placeholders. The dictionary holds the words
of all texts that stand in several of them; the letter pairs of its words also
say how likely the letters of a value follow each other.

Texts are only looked at by built-in functions. Candidates, which are few, are
joined with the dictionary by their pieces. Results carry a digest of the
value, never the value.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .quality_rules import let

SPACE = r"[\x20\x09-\x0D]+"
#: Letters that plain words have at most.
WORD_LETTERS = 24
#: Texts that a word of the dictionary stands in at least.
MIN_TEXTS = 3
#: What a value is assigned to, as a word or a part of a name.
KEY = r"(?i:tokens?|secrets?|passwords?|passwd|pwd|passphrase|api[_-]?keys?|access[_-]?keys?|private[_-]?keys?|secret[_-]?keys?|keys?|auth|authorization|bearer|credentials?)"
#: Words next to a value that speak for a credential, and against it.
SUSPECT = (
    "token", "tokens", "secret", "secrets", "password", "passwd", "pwd", "passphrase", "apikey", "api", "key", "auth", "authorization", "bearer", "credential",
    "credentials", "private", "access", "login", "export",
)
BENIGN = (
    "sha", "sha1", "sha256", "md5", "checksum", "hash", "commit", "revision", "uuid", "guid", "id", "digest", "etag", "version", "build", "public",
    "example", "sample", "test", "dummy", "order", "invoice", "card", "phone", "isbn", "file", "path", "url", "href", "image", "integrity", "mail", "mailto",
)
#: Parts of values and paths that stand for no real credential.
PLACEHOLDER = r"(?i)(your|example|sample|dummy|placeholder|change_?me|xxx|test|foo|bar|null|none|redacted|\*\*\*|<[a-z_ -]+>|\$\{|\{\{|1234)"
TESTS = r"(?i)(^|[^a-z])(tests?|examples?|fixtures?|samples?|mocks?|docs?|demo)([^a-z]|$)"
#: What every key word of KEY holds one of, in lower case.
KEY_PARTS = ("token", "secret", "passw", "passphrase", "pwd", "key", "auth", "bearer", "credential")
#: What makes a word of a text worth a look. Symbols are listed one by one, as such a class is far cheaper than a range or its complement.
SYMBOLS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]*+"
SHAPE = (
    "[0-9]" + SYMBOLS + "[A-Za-z]|[A-Za-z]" + SYMBOLS + "[0-9]|[a-z][A-Z]|(?<![A-Za-z])[A-Za-z]{" + str(WORD_LETTERS + 1) + "}|://[^/@]+:[^/@]+@|-----BEGIN"
)
RUN = r"[A-Za-z0-9+/_=\-]+"
SAME_WORD = KEY + r"[A-Za-z0-9_\-]*[\"'`\])]*(?:=>|:=|==|=|:)[\"'`(]*([^\"'`]+)"
LAST_WORDS = KEY + r"[A-Za-z0-9_\-]*[\"'`\])]*\x20?(?:=>|:=|==|=|:|\x20is|\x20was)\x20$|(?i:bearer|basic)\x20$"
URL = r"://[^/:@]+:([^/@]+)@"
FEATURES = (
    "length", "entropy", "digits", "upper", "hex", "distinct", "vowels", "letter_run", "alike", "letter_digit", "digit_letter", "lower_upper", "upper_lower",
    "pairs", "covered", "placeholder", "slashes", "dots", "dashes", "extension", "rooted", "tests", "uuid", "decimal", "other",
    "suspect_before", "benign_before", "suspect_after", "benign_after", "suspect_in", "benign_in", "assigned", "quoted", "url", "pem",
)
TREES, LEVELS, SEED = 32, 9, 11
THRESHOLD = 0.5


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, path, line, l of the lines that may hold a candidate."""
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), text_or_empty().alias("text"))
    keyed = lambda c: reduce(lambda x, y: x | y, [F.contains(F.lower(c), F.lit(k)) for k in KEY_PARTS])
    may = lambda c: c.rlike(SHAPE) | keyed(c)
    lines = own.where(may(F.col("text"))).select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.where(may(F.col("l")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, line and word (numbers from 0), kind, value and its neighbourhood, one row a candidate."""
    lines = lines_of(docs).withColumn("words", F.array_remove(F.split("l", SPACE), ""))
    last = lambda i: F.concat(F.coalesce(F.get("words", i - 2), F.lit("")), F.lit(" "), F.coalesce(F.get("words", i - 1), F.lit("")), F.lit(" "))
    keyed = F.col("l").rlike(KEY)
    # words are looked at for a key word only in lines that have one
    wanted = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: F.get("words", i).rlike(SHAPE) | (keyed & (F.get("words", i).rlike(SAME_WORD) | last(i).rlike(LAST_WORDS))),
    )
    rows = lines.where(F.size("words") > 0).select("doc_id", "path", "line", "words", F.explode(wanted).alias("word"))
    w = F.get("words", F.col("word"))
    rows = rows.withColumns({"w": w, "last": last(F.col("word"))})
    quoted = F.regexp_extract("w", r"^[(\[{]*[\"'`]([^\"'`]+)[\"'`]", 1)
    bare = F.when(quoted != "", quoted).otherwise(F.regexp_replace(F.regexp_replace("w", r"^[\"'`(\[{<]+", ""), r"[\"'`)\]}>,;.]+$", ""))
    same = F.regexp_replace(F.regexp_extract("w", SAME_WORD, 1), r"[)\]}>,;.]+$", "")
    head = F.concat_ws(" ", F.slice("words", F.col("word") + 1, 4))
    runs = F.filter(F.regexp_extract_all("w", F.lit(RUN), F.lit(0)), lambda r: r.rlike(SHAPE))
    as_one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    found = (
        F.when(F.col("w").startswith("-----BEGIN"), F.when(head.rlike("PRIVATE KEY"), as_one("pem", F.regexp_extract(head, r"(-----BEGIN.*?-----)", 1))))
        .when(F.col("w").rlike(URL), as_one("url", F.regexp_extract("w", URL, 1)))
        .when(same != "", as_one("assigned", same))
        .when(F.col("last").rlike(LAST_WORDS) & ~F.col("w").rlike(r"^[=:]+>?$"), as_one("assigned", bare))
        .otherwise(F.transform(runs, lambda r: F.struct(F.lit("run").alias("kind"), r.alias("value"))))
    )
    rows = rows.select("doc_id", "path", "line", "word", "words", "w", F.inline(found)).where("value != ''")
    before = F.concat_ws(" ", F.slice("words", F.greatest(F.lit(1), F.col("word") - 2), F.least(F.lit(3), F.col("word"))))
    after = F.concat_ws(" ", F.slice("words", F.col("word") + 2, 2))
    return rows.select("doc_id", "path", "line", "word", "kind", "value", F.col("w").alias("around"), F.lower(before).alias("before"), F.lower(after).alias("after"))


def dictionary(docs: DataFrame, least: int = MIN_TEXTS) -> DataFrame:
    """entry: the words of letters of which some form, as it stands between white space, occurs in ``least`` texts or more, over all texts."""
    forms = docs.select(F.explode(F.array_distinct(F.split(text_or_empty(), SPACE))).alias("form"))
    forms = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bare = F.lower(F.regexp_extract("form", r"^[\"'`(\[{<]*([A-Za-z]{3,%d})[\"'`)\]}>.,;:!?]*$" % WORD_LETTERS, 1))
    return forms.select(bare.alias("entry")).where("entry != ''").distinct()


def letter_pairs(words: DataFrame) -> dict[str, float]:
    """How much likelier each pair of letters is in the words than by chance, in natural logarithms: at most 26 x 26 numbers."""
    at = F.explode(F.sequence(F.lit(1), F.length("entry") - 1))
    counts = words.select("entry", at.alias("i")).groupBy(F.expr("substring(entry, i, 2)").alias("pair")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in counts)
    return {r.pair: math.log((r.n + 0.5) * 676 / (total + 338)) for r in counts}


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def named(text: Column, words) -> Column:
    """How many of the words stand in the text, as whole words or parts of names in key style."""
    parts = F.array_distinct(F.split(F.lower(text), r"[^a-z0-9]+"))
    return F.size(F.array_intersect(parts, F.array(*map(F.lit, words)))).cast("double")


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds covered to rows with cand and value: the share of the value's characters in pieces of letters that are words."""
    pieces = F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    rows = found.select("cand", F.explode(F.transform(pieces, F.lower)).alias("entry")).where(F.length("entry") >= 3)
    hits = rows.join(words, "entry").groupBy("cand").agg(F.sum(F.length("entry")).alias("letters"))
    out = found.join(hits, "cand", "left")
    return out.withColumn("covered", F.coalesce("letters", F.lit(0)) / F.length("value").cast("double")).drop("letters")


def featured(found: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """The features of candidates with covered, next to their columns."""
    value, length = F.col("value"), F.length("value").cast("double")
    lower = F.lower(value)
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(letters), lambda c: (length - F.length(F.replace(value, c, F.lit("")))) / length)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "_")
    steps = F.greatest(length - 1, F.lit(1.0))
    rate = lambda pattern: F.size(F.regexp_extract_all(kinds, F.lit(pattern), F.lit(0))) / steps
    # of adjacent letters, each pair once
    table = F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]) if pairs else F.create_map(F.lit(""), F.lit(0.0))
    # the letters are bound once, so a very long value takes no more than a step for each of them
    chars = F.filter(F.split(lower, ""), lambda c: c != "")
    adjacent = let(chars, lambda own: F.transform(own, lambda c, i: F.concat(c, F.coalesce(F.get(own, i + 1), F.lit("")))))
    two = F.filter(adjacent, lambda p: p.rlike("^[a-z]{2}$"))
    likely = F.aggregate(two, F.lit(0.0), lambda a, p: a + F.coalesce(F.element_at(table, p), F.lit(-4.0)))
    longest = F.array_max(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z]+"), F.lit(0)), lambda run: F.length(run)))
    inside = F.replace(F.col("around"), value, F.lit(" "))
    path = F.coalesce("path", F.lit(""))
    hit = lambda c: c.cast("double")
    return found.withColumns({
        "length": length, "entropy": entropy, "digits": 1 - without(value, "[0-9]") / length, "upper": 1 - without(value, "[A-Z]") / length,
        "hex": 1 - without(value, "[0-9a-fA-F]") / length, "distinct": F.size(F.array_distinct(letters)) / length,
        "vowels": 1 - without(lower, "[aeiou]") / length, "letter_run": F.coalesce(longest, F.lit(0)).cast("double"),
        "alike": (length - F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))) / steps, "letter_digit": rate("[aA](?=0)"), "digit_letter": rate("0(?=[aA])"),
        "lower_upper": rate("a(?=A)"), "upper_lower": rate("A(?=a)"), "pairs": likely / F.greatest(F.size(two), F.lit(1)),
        "placeholder": hit(value.rlike(PLACEHOLDER)), "slashes": length - F.length(F.replace(value, F.lit("/"), F.lit(""))),
        "dots": length - F.length(F.replace(value, F.lit("."), F.lit(""))), "dashes": length - without(value, "[-_]"),
        "extension": hit(F.col("around").rlike(r"\.[a-z]{2,4}[\"'`),;]*$")), "rooted": hit(F.col("around").rlike(r"^[\"'`(]*(\.{0,2}/|~/|[a-z]+://|[A-Za-z]:\\)")),
        "tests": hit(path.rlike(TESTS)), "uuid": hit(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "decimal": hit(value.rlike("^[0-9 .,:+-]+$")), "other": without(value, r"[A-Za-z0-9+/_=\-]") / length,
        "suspect_before": named(F.col("before"), SUSPECT), "benign_before": named(F.col("before"), BENIGN),
        "suspect_after": named(F.col("after"), SUSPECT), "benign_after": named(F.col("after"), BENIGN),
        "suspect_in": named(inside, SUSPECT), "benign_in": named(inside, BENIGN),
        "assigned": hit((F.col("kind") == "assigned") | F.col("before").rlike("[=:]$") | F.col("around").rlike(r"[A-Za-z_\]\"'] ?[=:]")),
        "quoted": hit(F.col("around").rlike("[\"'`]")), "url": hit(F.col("kind") == "url"), "pem": hit(F.col("kind") == "pem"),
    })


def prepared(docs: DataFrame, words: DataFrame, pairs: dict[str, float], name: str) -> DataFrame:
    """Candidates with their features as a vector."""
    found = written(candidates(docs).withColumn("cand", F.monotonically_increasing_id()), name)
    rows = featured(covered(found, words), pairs)
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def labelled_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """Labelled findings (doc_id, text, is_secret), drawn from hashes: formats of credentials, and of what is taken for them.

    It stands in where a review queue has given none; the forest takes any
    table of these columns.
    """
    h = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256)
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "=", "")
    b62 = lambda k: F.regexp_replace(b64(k), "[+/]", "x")
    letters = lambda k: F.lower(F.regexp_replace(b64(k), "[^A-Za-z]", ""))
    number = lambda k, size: F.left(F.conv(F.left(h(k), F.lit(15)), 16, 10), F.lit(size))
    at = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m)).cast("int")
    pick = lambda k, *words: F.element_at(F.array(*map(F.lit, words)), at(k, len(words)) + 1)
    lead = pick("lead", "in the settings", "was set with", "deploy", "then", "see", "use the", "and", "for this we have", "from there", "la lettre", "und dann")
    key = pick("key", "token", "api_key", "secret", "password", "auth_token", "private_key", "access key", "client_secret", "DB_PASSWORD", "SECRET_KEY", "passwd", "apiKey", "pwd")
    eq = pick("eq", ' = "', ': "', "=", " = ", ": ", "='", " := ", '="')
    tail = pick("tail", '"', '",', " next", "' and", "", '" then more', ";", '" the')
    word = pick("word", "summer", "correct", "dragon", "monkey", "sunshine", "welcome", "winter", "horse", "battery", "staple", "orange", "garden")
    other_word = pick("word2", "house", "river", "stone", "green", "light", "forest", "cloud", "silver", "mountain", "window")
    size = at("size", 24) + 20
    said = lambda *parts: F.concat_ws(" ", lead, F.concat(*parts))
    secret = [
        said(key, eq, F.left(h(1), size), tail), said(key, eq, F.left(b64(2), size), tail), said(key, eq, F.sha1(h(3).cast("binary")), tail),
        said(key, eq, F.left(b62(4), F.lit(8) + at("short", 10)), tail), said(key, eq, word, number(5, 2), pick("mark", "!", "#", "@", "$", "."), tail),
        said(key, eq, F.initcap(word), pick("in", "@", "_", "$", "0"), other_word, number(6, 3), tail), said(key, eq, word, other_word, pick("w3", "tree", "lamp", "road"), tail),
        said(key, eq, F.left(letters(7), F.lit(24)), tail),
        said(pick("p", "gp_", "sk-", "xp-", "pat_", "xoxb-", "glp-"), F.left(b62(8), F.lit(36)), tail),
        said(F.lit("AK"), F.upper(F.left(b62(9), F.lit(18))), tail), said(pick("bearer", "authorization: bearer ", "Authorization: Bearer ", "auth basic "), F.left(b64(10), F.lit(40)), tail),
        said(pick("scheme", "postgres", "https", "redis", "amqp"), F.lit("://"), pick("who", "admin", "root", "service", "app"), F.lit(":"), F.left(b62(11), F.lit(8) + at("urlpw", 12)), F.lit("@"), pick("host", "db", "cache", "internal"), F.lit(".local/main")),
        said(F.lit("-----BEGIN "), pick("pem", "RSA ", "EC ", "OPENSSH ", ""), F.lit("PRIVATE KEY-----")),
        said(key, eq, F.left(h(12), F.lit(8)), F.lit("-"), F.left(h(13), F.lit(8)), F.lit("-"), F.left(h(14), F.lit(8)), tail),
    ]
    uuid = F.concat_ws("-", F.left(h(15), F.lit(8)), F.substring(h(15), 9, 4), F.substring(h(15), 13, 4), F.substring(h(15), 17, 4), F.substring(h(15), 21, 12))
    plain = pick("plain", "commit", "sha1", "revision", "merged commit", "checksum", "of the", "parent", "tree", "hash =")
    innocent = [
        F.concat_ws(" ", lead, plain, F.sha1(h(16).cast("binary"))), F.concat_ws(" ", lead, pick("c", "md5", "checksum:", "md5 =", "etag:", "digest", "hash:"), F.md5(h(17).cast("binary"))),
        F.concat_ws(" ", lead, pick("d", "id", "uuid", "request id:", "guid =", "id:"), uuid),
        F.concat_ws(" ", lead, pick("e", "order", "invoice", "card", "call", "phone", "of the"), number(18, 16)),
        said(F.lit("src/"), pick("f", "main", "lib", "static"), F.lit("/"), pick("g", "page", "report", "image"), number(19, 3), F.lit("/index_2.html")),
        said(key, eq, pick("x", "your_token_here_123", "xxxxxxxxxxxxxxxx1", "example-secret-key-1", "changeme", "test_token_value_0001", "dummy-api-key-000000", "<your-password>", "${PASSWORD}", "placeholder", "********"), tail),
        said(key, eq, pick("y", "null", "None", "true", "false", "required", "string", "os.environ", "getenv", "config.get", "input", "undefined", "optional"), tail),
        said(pick("z", "the key: ", "keys: ", "the key is ", "token: ", "password is "), pick("zz", "to", "the", "a", "not", "that", "required", "longer", "used", "needed"), F.lit(" "), word, F.lit(" "), other_word),
        F.concat_ws(" ", lead, F.concat(pick("v", "release", "version", "build"), F.lit("-2024-"), number(20, 5), F.lit("-update-server"))),
        F.concat_ws(" ", lead, F.lit("integrity sha256"), F.left(b64(21), F.lit(43))),
        said(pick("m", "word", "mail", "anna", "tom"), F.lit("."), number(22, 2), F.lit("@mail"), number(23, 1), F.lit(".example.com")),
        said(pick("u", "https://", "http://"), F.lit("www."), word, F.lit(".com/"), other_word, F.lit("/p"), number(24, 6), F.lit("?id="), number(25, 4)),
        F.concat_ws(" ", lead, pick("n", "iPhone", "getName", "userId", "myValue", "setUp", "toString", "H2O", "3rd", "21st", "mp3", "utf8", "4x4", "10km", "v2")),
        F.concat_ws(" ", lead, F.concat(word, F.initcap(other_word), pick("camel", "Id", "Name", "List", "Test", "2"))),
        F.concat_ws(" ", lead, F.concat(word, F.lit("_"), other_word, F.lit("_"), number(26, 2))),
        F.concat_ws(" ", lead, F.lit("-----BEGIN PUBLIC KEY----- PRIVATE KEY")), F.concat_ws(" ", lead, F.concat(number(27, 2), pick("unit", "px", "em", "kg", "th", "min", "GB", "ms"))),
    ]
    every = [(x, 1) for x in secret] + [(x, 0) for x in innocent]
    kind = at("kind", len(every))
    text = reduce(lambda c, k: c.when(kind == k, every[k][0]), range(1, len(every)), F.when(kind == 0, every[0][0]))
    label = F.element_at(F.array(*[F.lit(y) for _, y in every]), kind + 1)
    return spark.range(n, numPartitions=2).select(F.col("id").alias("doc_id"), text.alias("text"), label.alias("is_secret"))


def fit(findings: DataFrame, words: DataFrame, pairs: dict[str, float]) -> RandomForestClassificationModel:
    """A forest from labelled findings (doc_id, text, is_secret), a bounded table."""
    rows = prepared(findings, words, pairs, "secret-findings").join(findings.select("doc_id", F.col("is_secret").cast("double").alias("label")), "doc_id")
    return RandomForestClassifier(numTrees=TREES, maxDepth=LEVELS, seed=SEED, maxBins=64).fit(rows.select("features", "label"))


def scored(spark: SparkSession, docs: DataFrame, findings: DataFrame | None) -> DataFrame:
    """Candidates with their score."""
    words = written(dictionary(docs), "secret-words")
    pairs = letter_pairs(words)
    model = fit(written(labelled_findings(spark), "secret-labelled") if findings is None else findings, words, pairs)
    return model.transform(prepared(docs, words, pairs, "secret-candidates")).withColumn("score", vector_to_array(F.col("probability"))[1])


def secret_scan(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a candidate: doc_id, line, word, kind, value_sha256, length, score, is_secret.

    Null and empty texts have no candidates; a text of any length is scanned
    whole. Repeated rows are scanned each, and a null doc_id stays null. An
    empty table gives an empty result. A column ``source``, where there is one,
    is the path; other columns are not looked at. ``findings`` is a table of
    labelled findings; without one the built-in ones are taken.
    """
    return scored(spark, docs, findings).select(
        "doc_id", "line", "word", "kind", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("long").alias("length"), "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )


def redacted(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the values of found secrets replaced in their texts, longer ones first.

    Rows that share a doc_id lose the values found in any of them; rows without
    a doc_id, and null and empty texts, stay as they are. An empty table gives an
    empty result; all columns pass.
    """
    bad = scored(spark, docs, findings).where(F.col("score") >= THRESHOLD).where("doc_id is not null")
    bad = bad.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("value").alias("__values"))
    longest = F.reverse(F.array_sort(F.transform("__values", lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    text = F.aggregate(longest, docs["text"], lambda t, v: F.replace(t, v["v"], F.lit(mark)))
    rows = docs.join(bad, docs["doc_id"].cast("long") == bad["__id"], "left")
    return rows.select(*[F.when(F.col("__values").isNull(), docs["text"]).otherwise(text).alias("text") if c == "text" else docs[c] for c in docs.columns])
