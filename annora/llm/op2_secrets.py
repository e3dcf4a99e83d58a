"""Secret scan whose candidates a random forest rates; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annora.llm.common import stored

CONTEXT = 48
# Words found in made-up values, words that announce a secret, words that announce something else, and telling paths.
DICTIONARY = ("example", "sample", "dummy", "test", "fake", "placeholder", "changeme", "change", "your", "value", "default", "config", "version", "secret", "token", "password", "key", "api", "user", "name", "null", "none", "todo", "foo", "bar", "lorem", "ipsum", "abcdef", "123456", "0123", "xxxx", "0000", "file", "page", "image", "index", "content", "data", "report", "update", "build", "release", "module", "service", "client", "server")
ANNOUNCE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private", "bearer")
OTHERWISE = ("commit", "sha", "md5", "checksum", "digest", "uuid", "guid", "hash", "etag", "revision", "integrity", "build", "isbn", "doi")
PATHS = ("test", "example", "sample", "doc", "fixture", "mock")
KNOWN = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xox[abp]-", "AIza", "glpat-", "eyJ")
FEATURES = ("length", "transitions", "coverage", "variety", "digits", "upper", "signs", "plain", "hex", "known", "announced", "assigned", "otherwise", "following", "path", "wording", "likeness")
#: Letters, digits, signs and other letters, as characters are told apart where the likelihood of their transitions is taken.
SYMBOLS = 29
#: Texts are dealt to 64 groups by their hash, so that a word's groups fit one long.
SPREAD_BITS = 64


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


@dataclass(frozen=True)
class Wording:
    """What a corpus reads like: its words (word, n texts), and the logarithm of how likely each symbol follows each other one in them."""

    words: DataFrame
    transitions: tuple[float, ...]


def _pairs(text: Column) -> Column:
    """The transitions between neighbouring characters of a text, each as a number below SYMBOLS squared."""
    lower = F.split(F.lower(text), "")
    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), 26).when(c < "\x80", 27).otherwise(28)
    codes = F.transform(lower, code)
    return F.filter(F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: a * SYMBOLS + b), lambda x: x.isNotNull())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))


def learn_wording(docs: DataFrame, *, spread: int = 8) -> Wording:
    """The words of three letters and more of docs (text) that stand in different texts, and the transitions of characters in these.

    A word counts if its texts' hashes fall into `spread` of 64 groups at least: however often a text is copied, what only it holds (such as
    the letters of a secret) is no word. Each word is one row with the bits of its groups, summed up before it is shuffled. Transitions count
    once per text of a word, and once more each, so that none is impossible. Words are stored, as they are read again.

    Edge cases: null and empty texts have no words; without words no character tells anything of the next.
    """
    if not 1 <= spread <= SPREAD_BITS:
        raise ValueError(f"spread must be 1 to {SPREAD_BITS}")
    group = F.pmod(F.xxhash64("text"), F.lit(SPREAD_BITS)).cast("int")
    each = docs.select(group.alias("g"), F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    bits = each.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, g)")).alias("groups"), F.count("*").alias("n"))
    words = stored(bits.where(F.bit_count("groups") >= spread).select("word", "n"), "secrets-words")
    counted = dict(map(tuple, words.select("n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n")).collect()))
    table = [[counted.get(a * SYMBOLS + b, 0) + 1 for b in range(SYMBOLS)] for a in range(SYMBOLS)]
    return Wording(words, tuple(math.log(n / sum(row)) for row in table for n in row))


def common_words(wording: Wording, most: int = 512) -> list[str]:
    """The `most` words that the most texts hold, fewer if there are fewer; ties by code point."""
    return [r.word for r in wording.words.orderBy(F.desc("n"), "word").limit(most).collect()]


def _worded(found: DataFrame, wording: Wording | None) -> DataFrame:
    """found (token) with the share of each token that is words of the corpus, and the mean logarithm of its transitions' likelihood.

    Words are looked up once per different token, by a join, as neither side has a bound.
    """
    n = F.length("token")
    if wording is None:
        return found.withColumns({"wording": F.lit(0.0), "likeness": F.lit(-math.log(SYMBOLS))})
    known = found.select("token").distinct().select(F.col("token").alias("_token"), F.explode(_words(F.col("token"))).alias("word"))
    known = known.join(wording.words.select("word"), "word").groupBy("_token").agg(F.sum(F.length("word")).alias("_known"))
    table = F.lit(list(wording.transitions))
    like = F.aggregate(_pairs(F.col("token")), F.lit(0.0), lambda s, x: s + F.get(table, x), lambda s: s / (n - 1))
    made = {"wording": F.coalesce(F.col("_known"), F.lit(0)) / n, "likeness": F.when(n > 1, like).otherwise(-math.log(SYMBOLS))}
    return found.join(known, F.col("token") == F.col("_token"), "left").withColumns(made).drop("_token", "_known")


ANNOUNCED = _any(ANNOUNCE) + r"[\s\"'`]{0,3}[:=]?[>\s\"'`]{0,4}"
_RUN = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}|" + _any(KNOWN) + r"[A-Za-z0-9+/_-]{8,})={0,2}"
_STOP = r".,;:)\]"
_OUT = r"\s\"'`<>"
#: Runs that may be a secret: 16 characters or more with a digit; 8 or more behind a known prefix; and behind a word that announces a
#: secret 6 or more of any but spaces, quotes and angle brackets, up to where a run of the first two kinds begins or the last stop or bracket.
#: Loops are possessive, so that a run may have any length, and take stops together, so that each is looked at once.
CANDIDATE = (
    _RUN + r"|(?<=[\s:=>\"'`])(?=[^" + _OUT + "]{6})(?<=(?i:" + ANNOUNCED + "))"
    "(?=(?:(?!" + _RUN + ")[^" + _OUT + "]){5}[" + _STOP + "]*+(?!" + _RUN + ")[^" + _OUT + _STOP + "])"
    "(?:(?!" + _RUN + ")[^" + _OUT + _STOP + "]|[" + _STOP + "]++(?![" + _OUT + r"]|\z)(?!" + _RUN + "))++"
)


def features(found: DataFrame, wording: Wording | None = None) -> DataFrame:
    """found (token, before, after, path) with a double column per feature. Nulls count as empty. Without wording, no word is known and all transitions are alike."""
    token, before, after = F.col("token"), F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("after", F.lit("")))
    n = F.length(token)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    made = {
        "length": n.cast("double"),
        "transitions": F.regexp_count(kinds, F.lit(r"(.)(?!\1|$)")) / n,
        "coverage": 1 - F.length(F.regexp_replace(F.lower(token), _any(DICTIONARY), "")) / n,
        "variety": F.size(F.array_distinct(F.split(token, ""))) / n,
        "digits": F.regexp_count(token, F.lit("[0-9]")) / n,
        "upper": F.regexp_count(token, F.lit("[A-Z]")) / n,
        "signs": F.regexp_count(token, F.lit("[^A-Za-z0-9]")) / n,
        "plain": flag(token.rlike(r"^\p{Lu}?\p{Ll}+$|^\p{Lu}+$")),
        "hex": flag(token.rlike("^[0-9a-f]+$")),
        "known": flag(token.rlike("^" + _any(KNOWN))),
        "announced": flag(before.rlike(ANNOUNCED + "$")),
        "assigned": flag(before.rlike(r"[:=][>\s\"'`]{0,4}$")),
        "otherwise": flag(before.rlike(_any(OTHERWISE) + r"\S*[\s:=\"'`(]{0,4}$")),
        "following": flag(after.rlike(r"^[\s\"'`]{0,2}" + _any(OTHERWISE))),
        "path": flag(F.lower("path").rlike(_any(PATHS))),
    }
    return _worded(found.withColumns(made), wording)


def candidates(docs: DataFrame, path_col: str | None = None) -> DataFrame:
    """(doc_id, start, end, token, before, after, path) of every candidate of docs (doc_id, text), in code points of text.

    Texts are scanned whole, once for candidates; only texts that have any are split at them, which gives places and neighbours.
    before and after hold what stands there, other candidates included.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    hit = docs.select("doc_id", "text", path.alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
    cut = hit.select("doc_id", "path", "tokens", F.split("text", CANDIDATE).alias("gaps")).withColumn("row", F.monotonically_increasing_id())
    tail, head = lambda s: F.right(s, F.lit(CONTEXT)), lambda s: F.left(s, F.lit(CONTEXT))
    # A gap and its token, up to CONTEXT characters: as many of them as may lie within the neighbourhood of a later token.
    cut = cut.withColumn("ends", F.transform("tokens", lambda t, i: tail(F.concat(tail(F.get("gaps", i)), t))))
    most = CONTEXT // 6 + 1
    before = lambda i: tail(F.concat(F.array_join(F.slice("ends", F.greatest(i - most + 1, F.lit(1)), F.least(i, F.lit(most))), ""), tail(F.get("gaps", i))))
    after = lambda i: head(F.concat(head(F.get("gaps", i + 1)), F.coalesce(F.get("tokens", i + 1), F.lit(""))))
    each = cut.select("row", "doc_id", "path", F.posexplode(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.length(F.get("gaps", i)).alias("gap"), before(i).alias("before"), after(i).alias("after")))).alias("k", "x"))
    w = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("x.gap") + F.length("x.token")).over(w)
    return each.withColumn("end", end).select("doc_id", (F.col("end") - F.length("x.token")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "x.token", "x.before", "x.after", "path")


def labelled_findings(spark: SparkSession, rows: int = 6_000, seed: int = 11, names: list[str] | None = None) -> DataFrame:
    """Made-up findings (token, before, after, path, label), as many as asked for: random values in the places where keys are kept, and what is
    commonly mistaken for them (digests, ids, placeholders, names, plain words; also values made of names, if any are given)."""
    r = spark.range(rows).withColumn("a", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).withColumn("b", F.sha2(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string")), 256))
    size = 16 + F.pmod(F.xxhash64("a"), F.lit(25)).cast("int")
    alnum = F.regexp_replace(F.base64(F.unhex("a")), "[+/=]", "7")
    upper = F.upper(F.regexp_replace(F.base64(F.unhex("b")), "[+/=]", "Q"))
    word = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("a"), F.lit(len(DICTIONARY))) + 1).cast("int"))
    word2 = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("b"), F.lit(len(DICTIONARY))) + 1).cast("int"))
    announce = F.element_at(F.array(*map(F.lit, ANNOUNCE)), (F.pmod(F.xxhash64("a", F.lit(1)), F.lit(len(ANNOUNCE))) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, OTHERWISE)), (F.pmod(F.xxhash64("a", F.lit(2)), F.lit(len(OTHERWISE))) + 1).cast("int"))
    joint = F.element_at(F.array(*map(F.lit, ("=", ": ", ' = "', "='"))), (F.pmod(F.xxhash64("b", F.lit(3)), F.lit(4)) + 1).cast("int"))
    plain = F.lit("as can be seen in the ")
    letters = F.translate(alnum, "0123456789", "qwZxVkJhGp")
    capitals = F.translate(upper, "0123456789", "QWZXVKJHGP")
    short = 8 + F.pmod(F.xxhash64("b", F.lit(4)), F.lit(9)).cast("int")
    sign = F.element_at(F.array(*map(F.lit, "!#$%&*?@^~.")), (F.pmod(F.xxhash64("a", F.lit(5)), F.lit(11)) + 1).cast("int"))
    # What reads like a word: two to five syllables.
    spoken = F.translate(F.substring("b", 1, F.lit(4) + 2 * F.pmod(F.xxhash64("a", F.lit(6)), F.lit(4)).cast("int")), "0123456789abcdef", "tnsrldmcpbvgfkhj")
    spoken = F.regexp_replace(spoken, "(.)(.)", "$1a$2e")
    title = F.initcap(spoken)
    kinds = [
        (1, F.substring("a", 1, 18), F.concat(plain, announce, joint)),
        (1, F.substring("a", 1, 40), F.concat(plain, announce, joint)),
        (1, F.left(alnum, size), F.concat(plain, announce, joint)),
        (1, F.concat(F.lit("AKIA"), F.left(upper, F.lit(16))), plain),
        (1, F.concat(F.lit("AKIA"), F.left(upper, F.lit(16))), F.concat(F.lit("access_key"), joint)),
        (1, F.concat(F.lit("ghp_"), F.left(alnum, F.lit(36))), plain),
        (1, F.concat(F.lit("AKIA"), F.left(capitals, F.lit(16))), plain),
        (1, F.concat(F.lit("sk_live_"), F.left(letters, size)), plain),
        (1, F.left(letters, size), F.concat(plain, announce, joint)),
        (1, F.concat(F.left(alnum, short - 3), sign, F.substring(alnum, 30, 3)), F.concat(plain, announce, joint)),
        (1, F.concat(F.left(letters, short - 2), sign, F.substring(letters, 30, 2)), F.concat(plain, announce, joint)),
        (1, F.concat(F.left(alnum, short)), F.concat(plain, announce, joint)),
        (0, F.when(F.col("id") % 3 == 0, title).otherwise(spoken), F.concat(plain, announce, joint)),
        (0, F.when(F.col("id") % 3 == 0, title).otherwise(spoken), F.concat(plain, announce, F.lit(" "))),
        (0, F.concat(spoken, sign, title), F.concat(plain, announce, F.lit(" "))),
        (0, F.concat(F.lit("${"), F.upper(word), F.lit("_"), F.upper(word2), F.lit("}")), F.concat(plain, announce, joint)),
        (0, F.concat(F.lit("./"), word, F.lit("/"), spoken, F.lit(".txt")), F.concat(plain, announce, joint)),
        (0, F.concat(spoken, F.lit("-"), word), F.concat(plain, announce, joint)),
        (0, F.substring("a", 1, 40), F.concat(plain, other, F.lit(" "))),
        (0, F.substring("a", 1, 32), F.concat(plain, other, F.lit(": "))),
        (0, F.regexp_replace(F.substring("a", 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), plain),
        (0, F.concat(word, F.lit("_"), word2, F.lit("_1234567890")), F.concat(plain, announce, joint)),
        (0, F.concat(word, F.lit("-"), word2, F.lit("-"), F.col("id").cast("string"), F.lit("-final")), plain),
        (0, F.concat(F.lit("xxxxxxxxxxxx"), F.lpad(F.col("id").cast("string"), 6, "0")), F.concat(plain, announce, joint)),
    ]
    if names:
        of = lambda h: F.get(F.lit(names), F.pmod(h, F.lit(len(names))).cast("int"))
        one, two, three = of(F.xxhash64("a", F.lit(7))), of(F.xxhash64("b", F.lit(8))), of(F.xxhash64("a", "b"))
        number = F.pmod(F.xxhash64("b", F.lit(9)), F.lit(100_000)).cast("string")
        kinds += [
            (0, F.concat(one, F.lit("-"), two, F.lit("-"), three), F.concat(plain, announce, joint)),
            (0, F.concat(F.initcap(one), F.initcap(two), number), F.concat(plain, announce, joint)),
            (0, F.concat(one, F.lit("_"), two, F.lit("_"), three, number), plain),
            (0, F.translate(F.substring("a", 1, size - 8), "abcdef", "012345"), plain),
            (0, F.translate(F.substring("b", 1, 16), "abcdef", "678901"), plain),
            (0, F.substring("b", 1, 40), plain),
            (1, F.left(alnum, size + 8), plain),
            (1, F.concat(F.left(alnum, F.lit(3)), sign, F.substring(alnum, 10, short - 4), sign), F.concat(plain, announce, joint)),
            (1, F.concat(F.left(letters, F.lit(2)), F.substring(alnum, 5, short - 2), sign), F.concat(plain, announce, joint)),
            (1, F.concat(F.left(alnum, F.lit(6)), F.lit("-"), F.substring(alnum, 7, 6), F.lit("-"), F.substring(alnum, 13, 6), F.lit("7")), F.concat(plain, announce, joint)),
            (1, F.concat(F.left(letters, short), F.lit("_"), F.substring(alnum, 20, 12), F.lit("3")), F.concat(plain, announce, joint)),
        ]
    pick = F.pmod(F.col("id"), F.lit(len(kinds)))
    chosen = F.array(*[F.struct(F.lit(y).alias("label"), t.alias("token"), b.alias("before")) for y, t, b in kinds])
    return r.withColumn("x", F.get(chosen, pick.cast("int"))).select("x.token", "x.before", F.lit(" and then ").alias("after"), F.when(F.pmod(F.xxhash64("b"), F.lit(9)) == 0, F.lit("tests/example.txt")).alias("path"), F.col("x.label").cast("double").alias("label"))


def fit_forest(labelled: DataFrame, wording: Wording | None = None, *, max_rows: int = 50_000, trees: int = 24, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | float:
    """A forest fitted on max_rows labelled findings (token, before, after, path, label 0/1) at most, a seeded sample.

    wording: what the corpus reads like, for scan_secrets the same. Findings and features are stored, as fitting reads them once per level of the trees. Where all labels are the same there is nothing to
    tell apart: then it is that label, which every finding gets as its score, or 0.5 without labels. Null and empty tokens and null labels are left out.
    """
    order = (F.xxhash64(F.lit(seed), "token", "before"), "token", "before")
    rows = stored(labelled, "secrets-labelled").where("token is not null and token <> '' and label is not null").orderBy(*order).limit(max_rows)
    labels = [float(r.label) for r in rows.select("label").distinct().limit(2).collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.5
    rated = stored(features(rows, wording).repartition(1).sortWithinPartitions(*order).select(*FEATURES, "label"), "secrets-features")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rated).select("_features", "label").coalesce(1)
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(ready)


def rated_findings(found: DataFrame, forest: RandomForestClassificationModel | float, wording: Wording | None = None) -> DataFrame:
    """found (token, before, after, path) with the forest's score, and is_secret from 0.5 on."""
    if isinstance(forest, float):
        rated, score = found, F.lit(forest)
    else:
        rated = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(features(found, wording)))
        score = F.get(vector_to_array("probability"), F.lit(1))
    return rated.select(*found.columns, score.alias("score"), (score >= 0.5).alias("is_secret"))


def scan_secrets(docs: DataFrame, forest: RandomForestClassificationModel | float, wording: Wording | None = None, *, path_col: str | None = None) -> DataFrame:
    """Every candidate in docs (doc_id, text) with the forest's score; is_secret from 0.5 on.

    Edge cases: null and empty texts have no candidates; a null id is kept; repeated rows are reported each; equal candidates of a
    document are reported at each place; an empty table gives no rows; columns other than path_col are ignored.

    Returns doc_id, start, end (code points of the whole text), token_sha256 (the secret itself isn't repeated), score, is_secret.
    """
    found = candidates(docs, path_col)
    if wording is not None:  # they are gone over twice: for words to look up, and to be rated
        found = stored(found, "secrets-found")
    return rated_findings(found, forest, wording).select("doc_id", "start", "end", F.sha2("token", 256).alias("token_sha256"), "score", "is_secret")


def found_of_labelled(labelled: DataFrame, forest: RandomForestClassificationModel | float, wording: Wording | None = None) -> DataFrame:
    """One row for findings (token, before, after, path, label 0/1) that the forest wasn't fitted on: n, secrets, called (so many it calls secrets), right (of these
    secrets), precision and recall (null where nothing is called, or there is no secret). Null and empty tokens and null labels are left out."""
    rows = labelled.where("token is not null and token <> '' and label is not null")
    rated = rated_findings(rows.select("token", "before", "after", "path", "label"), forest, wording)
    told = rated.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("secrets"), F.count_if("is_secret").alias("called"), F.count_if(F.col("is_secret") & (F.col("label") == 1)).alias("right"))
    return told.withColumns({"precision": F.expr("try_divide(right, called)"), "recall": F.expr("try_divide(right, secrets)")})
