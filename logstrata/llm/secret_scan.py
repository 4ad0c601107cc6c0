"""Secret scan: candidates judged by a random forest, to remove false positives.

1. Candidates are pieces of words between quotes, brackets, ``=``, ``:``, ``,``
   and the like: of 16 characters or more with a digit, or, where an announcing
   word stands right before, of 6 or more of any kind.
2. Two models of ordinary words are counted over all texts, every occurrence
   and every position of every word: the commonest runs of four letters are the
   dictionary, and pairs of letters give the chance of each letter after each
   other. A word is a run of letters of any script and length without a digit or
   ``_`` beside it; runs and pairs are of a-z, whatever the case.
3. Features are lengths, shares and changes of character classes, the mean
   surprise of letter transitions, dictionary coverage, path marks, and the
   neighbouring words.
4. The forest is the engine's own learner, trained from labelled findings: a
   table given by the caller, or ``findings()``: credentials of public formats,
   made from hashes and set beside the corpus' own words, against a bounded
   sample of the corpus' candidates that nothing announces. Where there is
   neither, a candidate's score is 1 if announced, else 0.

Everything is expressions in the JVM; what is shuffled are counts, combined in
each task, of words and then of a fixed number of keys, and the training table. A text with many
candidates is one row until it is exploded, so rows with hot content spread as
rows do. Null and empty texts have no candidates; very long texts are read
whole. Repeated rows give repeated findings, null ids are kept; an empty table
gives none. A score of exactly ``THRESHOLD`` counts as a secret. Only the id and
the text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm.text import ascii_lower, let, words
from logstrata.plans.durable import written

LONG, SHORT = 16, 6
THRESHOLD = 0.5
PARTS = 300  # of the dictionary
FITTED_ROWS = 6_000
#: What ends a piece, and words that announce a credential.
PIECE = r"""[^\x20\x09-\x0D"'`=:;,&{}()\[\]<>|?!#$%*]+"""
LETTERS = r"(?<![\p{L}\p{N}_])\p{L}{2,}+(?![\p{N}_])"  # a word of ordinary text
ANNOUNCING = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private_?key)"
FEATURES = ("length", "digits", "uppers", "lowers", "changes", "surprise", "distinct", "covered", "hexadecimal", "dots", "slashes", "dashes", "at", "announced", "assigned", "quoted", "numbers")


class Words:
    """What is ordinary in a corpus: word parts, and the surprise of each letter after each other.

    ``whole`` counts every position of every word; else only beginnings and endings of words of 4 to 40 letters, each once a text.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", whole: bool = False):
        text = F.coalesce(F.col(text_col), F.lit(""))
        parts, steps = self._everywhere(docs, text) if whole else self._ends(docs, text)
        top = parts.orderBy(F.desc("n"), "part").limit(PARTS).collect()
        self.parts = [r.part for r in top]
        counts = {r.pair: r.n for r in steps.collect()}  # 26 squared at most
        self.surprise = {}
        letters = "abcdefghijklmnopqrstuvwxyz"
        for a in letters:
            total = sum(counts.get(a + b, 0) + 1 for b in letters)
            self.surprise |= {a + b: math.log2(total / (counts.get(a + b, 0) + 1)) for b in letters}

    @staticmethod
    def _everywhere(docs: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
        """Counts of the runs of four letters, and of two, at all positions of all words."""
        found = docs.select(F.explode(F.regexp_extract_all(ascii_lower(text), F.lit(LETTERS), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        runs = lambda size: F.regexp_extract_all("word", F.lit(f"(?=([a-z]{{{size}}}))"), F.lit(1))
        seen = found.select(F.explode(F.concat(runs(4), runs(2))).alias("part"), "n").groupBy("part").agg(F.sum("n").alias("n"))  # 26 to the 4 and 26 squared at most
        seen = written(seen, "parts")
        return seen.filter(F.length("part") == 4), seen.filter(F.length("part") == 2).withColumnRenamed("part", "pair")

    @staticmethod
    def _ends(docs: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]{4,40}\b"), F.lit(0)))
        ends = F.explode(F.transform(found, lambda w: F.struct(F.lower(F.substring(w, 1, 4)).alias("first"), F.lower(F.substring(w, -4, 4)).alias("last"))))
        pairs = docs.select(ends.alias("e"))
        parts = pairs.select(F.explode(F.array("e.first", "e.last")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))  # 26 to the 4 at most
        parts = written(parts, "parts")
        return parts, parts.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), "part", "n").groupBy(F.expr("substring(part, i, 2)").alias("pair")).agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, candidate, before, before2, after, quoted, assigned); position is the place of the candidate's word in the text.

    before and before2 are the pieces or words before it, after is the word after its own.
    """
    def chosen(w: Column) -> Column:
        told = lambda i: F.coalesce(F.get(w, i).rlike(ANNOUNCING), F.lit(False))
        near = lambda x, i: ((F.length(x) >= LONG) & x.rlike("[0-9]")) | ((F.length(x) >= SHORT) & (told(i) | told(i - 1) | told(i - 2)))
        at = F.transform(w, lambda x, i: F.when(near(x, i), F.struct(i.alias("position"), x.alias("raw"), F.get(w, i - 1).alias("b1"), F.get(w, i - 2).alias("b2"), F.get(w, i + 1).alias("after"))))
        return F.filter(at, lambda c: c.isNotNull())

    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(let(words(F.col(text_col)), chosen)).alias("c")).select("doc_id", "c.*")
    pieces = F.regexp_extract_all("raw", F.lit(PIECE), F.lit(0))
    outer = F.filter(F.array("b2", "b1"), lambda x: x.isNotNull())
    rows = rows.withColumn("_all", F.concat(outer, pieces)).withColumn("_skip", F.size(outer)).select("*", F.posexplode(pieces).alias("_i", "_piece"))
    last = lambda back: F.get("_all", F.col("_skip") + F.col("_i") - back)
    # Dots and dashes at the ends belong to the sentence.
    made = rows.select("doc_id", "position", F.regexp_replace("_piece", r"^[.\-/_~]+|[.\-/_~]+$", "").alias("candidate"), last(1).alias("before"), last(2).alias("before2"), "after",
                       (F.col("raw").rlike("""["'`]""") | F.coalesce(F.col("b1").rlike("""["'`]$"""), F.lit(False))).alias("quoted"),
                       F.when(F.col("_i") > 0, F.col("raw").rlike("[=:]")).otherwise(F.coalesce(F.col("b1").rlike("[=:]$"), F.lit(False))).alias("assigned"))
    told = _announced()
    return made.filter(((F.length("candidate") >= LONG) & F.col("candidate").rlike("[0-9]")) | ((F.length("candidate") >= SHORT) & told & ~F.col("candidate").rlike(ANNOUNCING)))


def _announced() -> Column:
    return F.coalesce(F.col("before").rlike(ANNOUNCING), F.lit(False)) | F.coalesce(F.col("before2").rlike(ANNOUNCING), F.lit(False))


def with_features(rows: DataFrame, known: Words) -> DataFrame:
    """Adds FEATURES, doubles, from what candidates() gives."""
    c = F.col("candidate")
    size = F.greatest(F.length(c), F.lit(1))
    less = lambda pattern: (size - F.length(F.regexp_replace(c, pattern, ""))) / size
    changes = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    surprises = F.create_map(*[F.lit(x) for pair in sorted(known.surprise.items()) for x in pair])
    # Chances of letter pairs; what isn't two letters is as surprising as a pair of 26 alike.
    each = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.coalesce(F.element_at(surprises, F.lower(F.substring(c, i, F.lit(2)))), F.lit(math.log2(26))))
    covered = (size - F.length(F.regexp_replace(F.lower(c), "|".join(known.parts), ""))) / size if known.parts else F.lit(0.0)
    made = {
        "length": size, "digits": less("[0-9]"), "uppers": less("[A-Z]"), "lowers": less("[a-z]"), "changes": F.size(F.regexp_extract_all(c, F.lit(changes), F.lit(0))) / size,
        "surprise": F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(size - 1, F.lit(1)),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64)), "covered": covered,
        "hexadecimal": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int"), "dots": less(r"\."), "slashes": less("/"), "dashes": less("[-_]"), "at": c.contains("@").cast("int"),
        "announced": _announced().cast("int"), "assigned": F.col("assigned").cast("int"), "quoted": F.col("quoted").cast("int"), "numbers": F.coalesce(F.col("after").rlike("[0-9]"), F.lit(False)).cast("int"),
    }
    return rows.withColumns({name: made[name].cast("double") for name in FEATURES})


def _secrets(spark: SparkSession, n: int) -> DataFrame:
    """(id, candidate): credentials of public formats, from hashes."""
    r = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30))
    s = lambda salt: F.concat(F.col("id").cast("string"), F.lit(salt))
    base = F.regexp_replace(F.concat(F.base64(F.unhex(F.sha1(s("b")))), F.base64(F.unhex(F.md5(s("c"))))), "=", "")
    plain = F.regexp_replace(base, "[+/]", "x")
    part = lambda x, length: F.substring(x, 1, length)
    # Prefixes and lengths of public credential formats.
    forms = [
        F.sha1(s("a")), F.md5(s("a")), F.sha2(s("a"), 256), F.upper(F.sha1(s("a"))), part(base, 40), part(base, 24), F.concat(F.lit("AKIA"), F.upper(part(plain, 16))),
        F.concat(F.lit("ghp_"), part(plain, 36)), F.concat(F.lit("sk_live_"), part(plain, 24)), F.concat(F.lit("xoxb-"), (r("x") + 10**9).cast("string"), F.lit("-"), part(plain, 24)),
        F.concat(F.lit("AIza"), part(plain, 35)), F.concat(F.lit("eyJ"), part(plain, 33), F.lit("."), F.reverse(part(plain, 40))),
        F.concat_ws("-", part(F.md5(s("u")), 8), F.substring(F.md5(s("u")), 9, 4), F.substring(F.md5(s("u")), 13, 4), F.substring(F.md5(s("u")), 17, 4), F.substring(F.md5(s("u")), 21, 12)),
        F.concat(part(plain, 7), F.lit("!"), (r("p") % 100).cast("string")), part(plain, 12), F.translate(part(plain, 14), "0123456789", "abcdefghij"),
    ]
    return spark.range(n).select("id", F.get(F.array(*forms), (r("form") % len(forms)).cast("int")).alias("candidate"))


def findings(docs: DataFrame, found: DataFrame, most: int = FITTED_ROWS) -> DataFrame:
    """Labelled findings: candidates() with label, ``most`` at most, half of them secrets or more.

    Negatives are candidates of the corpus that no word announces, sampled by a hash of what they are;
    secrets take the words around other negatives, three in four of them after an announcing word.
    """
    spark = docs.sparkSession
    plain = found.filter(~_announced()).select("candidate", "before", "before2", "after", "quoted", "assigned").distinct()
    mark = F.xxhash64("candidate", "before", "after", F.lit(5))
    plain = plain.withColumn("_mark", mark).orderBy("_mark", "candidate").limit(most // 2)  # the least hashes: a top-k, whatever the partitions
    plain = written(plain, "negatives")
    n = plain.count()
    if not n:
        return plain.drop("_mark").withColumn("label", F.lit(0.0))
    from pyspark.sql import Window

    around = plain.select((F.row_number().over(Window.orderBy("_mark", "candidate")) - 1).cast("bigint").alias("id"), "before", "before2", "after")  # most // 2 rows
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20))
    told = h("told") % 4 > 0
    name = F.get(F.array(*map(F.lit, ("token", "secret", "password", "api_key", "auth", "access_key", "Bearer", "passwd"))), (h("name") % 8).cast("int"))  # a choice of what announces
    form = h("form") % 3
    secrets = _secrets(spark, most // 2).join(around.withColumnRenamed("id", "_at"), F.col("id") % n == F.col("_at")).select(
        "candidate", F.when(told & (form == 0), F.lit("=")).when(told, name).otherwise(F.col("before")).alias("before"), F.when(told & (form == 0), name).otherwise(F.col("before2")).alias("before2"), "after",
        (h("quoted") % 2 == 0).alias("quoted"), F.when(told, h("assigned") % 4 > 0).otherwise(h("assigned") % 8 == 0).alias("assigned"), F.lit(1.0).alias("label"))
    return plain.drop("_mark").withColumn("label", F.lit(0.0)).unionByName(secrets)


def train(labelled: DataFrame, known: Words, trees: int = 40, depth: int = 8, seed: int = 11):
    """The forest of findings with label 1.0 and 0.0; both sides weigh alike."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    rows = with_features(labelled, known).withColumn("weight", F.when(F.col("label") == 1, max(counts.values()) / counts[1.0]).otherwise(max(counts.values()) / counts[0.0]))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = FITTED_ROWS) -> DataFrame:
    """doc_id, position, candidate, score and secret (score of one half or more) of every candidate."""
    from pyspark.ml.functions import vector_to_array

    found = written(candidates(docs, id_col, text_col), "candidates")
    if labelled is None:
        labelled = written(findings(docs, found, most), "findings")
    if labelled.select("label").distinct().count() < 2:
        score = _announced().cast("double")
        return found.select("doc_id", "position", "candidate", score.alias("score"), (score >= THRESHOLD).alias("secret"))
    known = Words(docs, text_col, whole=True)
    judged = train(labelled, known).transform(with_features(found, known))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return judged.select("doc_id", "position", "candidate", score.alias("score"), (score >= THRESHOLD).alias("secret"))
