"""Secret scans with a random forest against false positives (DataFrame functions only).

Candidates are long runs of key-like characters with a digit, and whatever is assigned to a
password, secret, token or key, short and without digits too.  Each is described by its
length, its mix and transitions of character classes, how much of it common words
cover, paths around it and neighbouring words; a random forest learnt from labelled
findings keeps the secrets.  Detection and scoring are expressions of one scan.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What secrets are assigned to, with the sign of assignment, right before a candidate.
ASSIGNED = r"(?<=[:='\"\s])(?<=(?:[Pp]ass(?:word|wd|phrase|code)|PASS(?:WORD|WD)|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY)['\"]?\s{0,2}[:=]{1,2}\s{0,2}['\"]?)"
#: A candidate: a whole run of at least 12 key-like characters, a digit among them, with padding of base 64; or four characters or more that are assigned.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+={0,2}|" + ASSIGNED + r"[^\s'\"`,;<>:=]{4,}+"
#: Characters of context on either side.
CONTEXT = 48

# Common words and parts of words; words near secrets; words near other codes.
COMMON = (
    "the and ing ion ent for that with this from have not are was all can your one will time about which when make like into year good some "
    "them see other than then now look only come its over think also back after use two how our work first well way even new want because any "
    "these give day most user name file data test image version index page order number example value item list table image src main build"
).split()
SECRET_WORDS = "password passwd pwd secret token api apikey key auth authorization bearer credential credentials access private aws client login pass signing"
OTHER_WORDS = (
    "commit sha sha1 sha256 md5 hash checksum digest revision uuid guid version isbn issn phone tel fax order invoice date build release "
    "image img href src http https page id ids ticket tracking serial model part sample example placeholder dummy"
)
FEATURES = ["length", "digits", "uppers", "others", "transitions", "variety", "hexadecimal", "coverage", "path", "assigned", "quoted", "near_secret", "near_other", "known_prefix"]

#: The forest; labelled findings that a model is fitted on at most.
TREES, DEPTH, SEED, MAX_FINDINGS = 24, 7, 7, 20_000


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.char_length(c)


def described(rows: DataFrame, candidate: str = "candidate", before: str = "before", after: str = "after") -> DataFrame:
    """``rows`` with a column per feature."""
    c, b, a = F.col(candidate), F.coalesce(F.col(before), F.lit("")), F.coalesce(F.col(after), F.lit(""))
    lower = F.lower(c)
    word = lambda words: f"(?i)(?<![a-z])(?:{'|'.join(words.split())})(?![a-z])"
    near = F.concat_ws(" ", F.substr(b, F.greatest(F.char_length(b) - 30, F.lit(1))), F.substring(a, 1, 16))
    return rows.withColumns(
        {
            "length": F.char_length(c).cast("double"),
            "digits": _share(c, "[0-9]"),
            "uppers": _share(c, "[A-Z]"),
            "others": _share(c, "[^A-Za-z0-9]"),
            "transitions": (F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / F.char_length(c),
            "variety": F.size(F.array_distinct(F.split(c, ""))) / F.char_length(c),
            "hexadecimal": F.regexp_like(lower, F.lit("^[0-9a-f]+$")).cast("double"),
            "coverage": F.lit(1.0) - F.char_length(F.regexp_replace(lower, "|".join(COMMON), "")) / F.char_length(c),
            "path": (F.regexp_like(b, F.lit(r"(?:[/.\\]|https?:\S*)$")) | F.regexp_like(c, F.lit("/[^/]+/"))).cast("double"),
            "assigned": F.regexp_like(b, F.lit(r"[:=]\s*[\"']?$")).cast("double"),
            "quoted": F.regexp_like(b, F.lit("[\"'`]$")).cast("double"),
            "near_secret": F.regexp_count(near, F.lit(word(SECRET_WORDS))).cast("double"),
            "near_other": F.regexp_count(near, F.lit(word(OTHER_WORDS))).cast("double"),
            "known_prefix": F.regexp_like(c, F.lit("^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|AIza|eyJ)")).cast("double"),
        }
    )


def composed_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled findings (candidate, before, after, label), composed from the digits of a hash of their number."""
    rows = spark.range(n).select(
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("h"),
        F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512))).alias("b"),
        (F.col("id") % 20).alias("kind"),
        F.element_at(F.array(*[F.lit(w) for w in COMMON]), (F.col("id") * 7 % len(COMMON) + 1).cast("int")).alias("v"),
        F.element_at(F.array(*[F.lit(w) for w in COMMON]), (F.col("id") % len(COMMON) + 1).cast("int")).alias("w"),
    )
    forms = [  # kind, label, candidate, before, after
        (0, 1, "concat('AKIA', substr(upper(translate(b, '+/=', 'XYZ')), 1, 16))", "concat(w, ' ')", "concat(' ', w)"),
        (1, 1, "substr(h, 1, 18)", "concat(w, ' password=')", "concat(' ', w)"),
        (2, 1, "substr(h, 1, 40)", "concat(w, ' token = \"')", "concat('\" ', w)"),
        (3, 1, "substr(translate(b, '=', 'Q'), 1, 40)", "concat(w, ' secret: ')", "concat(' ', w)"),
        (4, 1, "concat('ghp_', substr(translate(b, '+/=', 'abc'), 1, 36))", "concat(w, ' ')", "concat(' ', w)"),
        (5, 1, "concat('sk_live_', substr(translate(b, '+/=', 'abc'), 1, 24))", "concat(w, ' api key ')", "''"),
        (6, 1, "concat(substr(h, 1, 6), '-', substr(translate(b, '+/=', 'abc'), 1, 14))", "concat('pwd: ''')", "concat(''' ', w)"),
        (7, 1, "concat('eyJ', substr(translate(b, '+/=', 'abc'), 1, 60))", "'authorization: Bearer '", "concat(' ', w)"),
        (8, 0, "substr(h, 1, 40)", "concat(w, ' commit ')", "concat(' ', w)"),
        (9, 0, "concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12))", "concat(w, ' id ')", "concat(' ', w)"),
        (10, 0, "concat(w, '_', w, '_image_', cast(id as string))", "concat(w, ' /', w, '/')", "'.png'"),
        (11, 0, "concat('20', lpad(cast(id % 100 as string), 2, '0'), '-0', cast(id % 9 + 1 as string), '-1', cast(id % 10 as string), '-', cast(id as string))", "concat(w, ' date ')", "concat(' ', w)"),
        (12, 0, "substr(h, 1, 64)", "concat(w, ' sha256: ')", "concat(' ', w)"),
        (13, 0, "lpad(cast(id * 7919 as string), 14, '0')", "concat(w, ' phone ')", "concat(' ', w)"),
        (14, 0, "concat(w, initcap(w), 'number', cast(id as string), initcap(w))", "concat(w, ' ')", "concat(' ', w)"),
        (15, 0, "concat('version-', w, '-', cast(id % 9 as string), '-build-', cast(id as string))", "concat('https://', w, '.example.com/')", "concat('/', w)"),
        (16, 1, "concat(w, substr(h, 1, 2), substr(b, 1, cast(id % 3 as int)))", "concat(v, ' password=')", "concat(' ', v)"),
        (17, 1, "concat(initcap(w), initcap(v), initcap(substr(translate(b, '+/=0123456789', 'abc'), 1, 5)), initcap(w))", "concat(v, ' passphrase: ')", "concat(' ', v)"),
        (18, 0, "v", "concat(w, ' password: ')", "concat(' ', w)"),
        (19, 0, "concat(v, w)", "concat(w, ' key = ')", "concat(' ', v)"),
    ]
    pick = lambda k: F.expr("case kind " + " ".join(f"when {f[0]} then {f[k]}" for f in forms) + " end")
    return rows.select(pick(2).alias("candidate"), pick(3).alias("before"), pick(4).alias("after"), pick(1).cast("double").alias("label"))


def fit(findings: DataFrame) -> PipelineModel:
    """A forest from labelled findings (candidate, before, after, label); at most ``MAX_FINDINGS``, by a hash."""
    rows = findings.filter("candidate is not null and candidate <> '' and label in (0, 1)")
    rows = rows.orderBy(F.xxhash64("candidate", "before", "after")).limit(MAX_FINDINGS)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(described(rows))


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, start, candidate, before, after): each candidate of a text at each of its places.

    ``start`` counts characters from 0.  The text is cut at the candidates; the sums of the
    lengths give the places.  A candidate and what stands before it have 8 characters or more together,
    so the thirteen parts on either side hold the context.
    """
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.regexp_like("t", F.lit(CANDIDATE)))
    cut = found.select(
        "id",
        F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("cs"),
        F.split("t", CANDIDATE, -1).alias("ps"),
    )
    # All parts in order, a candidate at every even place from 1; the offset of each candidate.
    parts = cut.select(
        "id",
        "cs",
        F.expr("flatten(zip_with(ps, cs, (p, c) -> array(p, coalesce(c, ''))))").alias("parts"),
        F.expr(
            "aggregate(zip_with(slice(ps, 1, size(cs)), cs, (p, c) -> struct(char_length(p) as p, char_length(c) as c)), "
            "struct(0L as at, cast(array() as array<bigint>) as starts), "
            "(a, x) -> struct(a.at + x.p + x.c as at, concat(a.starts, array(a.at + x.p)) as starts)).starts"
        ).alias("starts"),
    )
    each = parts.select("id", "parts", "starts", F.posexplode("cs").alias("k", "candidate"))
    return each.select(
        "id",
        F.expr("starts[k]").alias("start"),
        "candidate",
        F.expr(f"right(array_join(slice(parts, greatest(2 * k - 11, 1), least(2 * k + 1, 13)), ''), {CONTEXT})").alias("before"),
        F.expr(f"substr(array_join(slice(parts, 2 * k + 3, 13), ''), 1, {CONTEXT})").alias("after"),
    )


def find_secrets(docs: DataFrame, model: PipelineModel | None = None, text_col: str = "text", id_col: str = "doc_id", *, threshold: float = 0.5) -> DataFrame:
    """One row per row and place of a candidate: id, start, length, candidate_sha256, score, secret.

    The candidate itself is not given out.  Null and empty texts have no candidates.
    Texts are read whole.  Repeated rows give repeated findings; rows without an
    identifier give findings with a null one; other columns are ignored.
    """
    model = model or fit(composed_findings(docs.sparkSession))
    scored = model.transform(described(candidates(docs, text_col, id_col)))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(
        F.col("id").alias(id_col),
        "start",
        F.col("length").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        score.alias("score"),
        (score >= threshold).alias("secret"),
    )
