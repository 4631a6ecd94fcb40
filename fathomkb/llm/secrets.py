"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed

VALUE = "[A-Za-z0-9_+/-]"
#: Further characters that may stand inside a value that is assigned to a secret's name.
MARKS = "[A-Za-z0-9_+/.@!#$%^&*~-]"
#: What stands directly before a value that is assigned to a secret's name.
NAMES = r"(?i:secret|token|passw(?:or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|auth|credential|private[_ -]?key|signing)[\w-]{0,12}[\"']?"
ASSIGNED_SECRET = NAMES + r"\s{0,2}:?[:=]\s{0,2}[\"'`]?"
#: Candidates, the first that fits at a place: a private key in PEM, a JSON web token, a value of any length and make
#: where it is assigned to a secret's name, a value with a digit right after "password" or "password is", what stands for a
#: password in a url (after a user's name of 64 characters at most), a run of at least 16 key characters with a digit among them. '=' is padding at the end only, so that a key stays before its value (but for a
#: key of one letter).
CANDIDATE = "|".join(
    (
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]++-----END [A-Z ]{0,40}PRIVATE KEY-----",
        r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*+)?",
        rf"(?<!{VALUE})(?<=[:=]\s{{0,2}}[\"'`]?)(?<={ASSIGNED_SECRET}){VALUE}(?:{MARKS}*[A-Za-z0-9_+/!#$%^&*~-])?={{0,2}}",
        rf"(?<=\s)(?<=\b(?i:passw(?:or)?d|passphrase)(?:\s(?:is|was))?\s{{1,2}})(?=[A-Za-z_+/@!#$%^&*~-]*+[0-9]){MARKS}{{5,}}[A-Za-z0-9_+/!#$%^&*~-]",
        r"(?<=:)(?<=://[A-Za-z0-9._%+-]{1,64}:)[^\s/@:\"'<>`]++(?=@)",
        rf"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9]=(?=[A-Za-z_+/-]*[0-9]){VALUE}{{16,}}={{0,2}}",
        rf"(?<!{VALUE})(?=[A-Za-z_+/-]*[0-9]){VALUE}{{16,}}={{0,2}}",
    )
)
#: Words whose share of a candidate is its dictionary coverage.
DICTIONARY = (
    "about account after again also and any article base before between build cache change class client config content copy count data date default demo "
    "description design detail dev different document download draft each edit editor error event every example export feature field file find first for "
    "form from function general get group guide have header history home html http image import index info input into issue item java json key language last "
    "level license line link list local login long main make manual map message method model module more name new news next node note notes number object "
    "option order other over page part password patch path placeholder plugin point post preview private product profile program project public query read "
    "release remove report request result review sample script search section secret section server service session set setting sheet show simple site size "
    "source start state static status step string style summary support system table tag team test text that the this time title token type unit update "
    "upload use user value version view web week when which window with word work world year your"
).split()
NEAR_SECRET = r"(?i)(secret|token|passw(or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|auth|credential|private[_ -]?key|bearer|signing)[\w\"' -]{0,12}[:=]?\s*[\"'`]?$"
NEAR_OTHER = r"(?i)(sha-?\d*|md5|checksum|digest|commit|hash|etag|uuid|guid|integrity|revision|rev|blob|tree|invoice|order|phone|isbn|card|serial|build)\W{0,4}$"
FEATURES = ["chars", "digits", "upper", "lower", "hex", "symbols", "turns", "alphabet", "pairs", "words", "path_test", "path_config", "path_depth", "secret_word", "other_word", "assigned", "quoted", "in_url", "token_form", "userinfo", "issued"]
CONTEXT = 64


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = "source") -> DataFrame:
    """doc_id, pos (from 0), candidate, before, after (up to 64 characters of context), path.

    Context ends at the next candidate; only where no letter or digit lies between is the one before (a key) part of it.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.expr(path).cast("string"), F.lit("")).alias("path"))
    found = d.withColumn("c", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("c") > 0)
    parts = found.withColumn("p", F.transform(F.split("text", CANDIDATE, -1), lambda x: F.struct(F.right(x, F.lit(CONTEXT)).alias("before"), F.left(x, F.lit(CONTEXT)).alias("after"))))
    rows = parts.select("doc_id", "path", F.posexplode(F.expr("transform(c, (x, i) -> struct(x as candidate, if(i > 0 and p[i].before rlike '^[^A-Za-z0-9]{0,8}$', right(concat(c[i - 1], p[i].before), 64), p[i].before) as before, p[i + 1].after as after))")))
    return rows.select("doc_id", "pos", "col.candidate", "col.before", "col.after", "path")


def features(rows: DataFrame) -> DataFrame:
    """Adds FEATURES: length, shares of character classes, transitions between them, alphabet and pairs used, dictionary coverage, path and neighbouring words."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda keep: F.length(F.regexp_replace(c, f"[^{keep}]", "")) / n
    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    before, after, path = F.col("before"), F.col("after"), F.lower("path")
    return rows.withColumns(
        {
            "chars": F.least(n, F.lit(128.0)),
            "digits": share("0-9"),
            "upper": share("A-Z"),
            "lower": share("a-z"),
            "hex": share("0-9a-fA-F"),
            "symbols": share("_+/=.@!#$%^&*~-"),
            "turns": (F.length(F.regexp_replace(c, turns, "~")) - F.length(c)) / n,
            "alphabet": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
            "pairs": F.size(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(..))")))) / n,
            "words": F.lit(1.0) - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), "")) / n,
            "path_test": flag(path.rlike("test|example|fixture|sample|mock|demo")),
            "path_config": flag(path.rlike(r"\.(env|ya?ml|json|ini|toml|cfg|conf|properties|pem|tfvars)$")),
            "path_depth": F.size(F.split(path, "/")).cast("double"),
            "secret_word": flag(before.rlike(NEAR_SECRET)),
            "other_word": flag(before.rlike(NEAR_OTHER)),
            "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
            "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
            "token_form": flag(c.rlike(r"^(eyJ[A-Za-z0-9_-]{8,}\\.|-----BEGIN )")),
            "userinfo": flag(before.rlike(r"://[A-Za-z0-9._%+-]+:$") & after.startswith("@")),
            "issued": flag(c.rlike(r"^[A-Za-z]{2,8}_[A-Za-z0-9_]*[A-Za-z0-9]{16,}$|^[a-z]{2,5}-[A-Za-z0-9-]{20,}$|^A[A-Z]{3}[A-Z0-9]{16}$")),
            "in_url": flag(before.rlike(r"(https?://\S*|www\.\S*|[./@])$") | after.rlike(r"^[@.]\w")),
        }
    )


Template = tuple[str, str, str, str, int]  # text before, kind of value, text after, path, label (1: a secret)


def _labelled() -> list[Template]:
    """The labelled findings as templates: each surrounding with each name and kind of value that it goes with."""
    secret = (("the rest of it ", " was then", "src4"), ("\n", "\n", "app/settings.yaml"), ("export ", "\n", "deploy/prod.env"), ("we set ", ", as told", "notes/setup.md"))
    names = (("token", " = ", '"'), ("password", ": ", "'"), ("API_KEY", "=", ""), ("client_secret", " := ", '"'), ("Authorization: Bearer", " ", ""), ("SECRET", " = ", '"'), ("auth_token", "=", ""), ("passwd", " = ", '"'))
    yes = [(f"{a}{n}{op}{q}", kind, q + b, p, 1) for a, b, p in secret for n, op, q in names for kind in ("hex40", "base64", "mixed", "HEX40", "dotted")]
    yes += [(f"{a}{n}{q}", kind, q + b, p, 1) for a, b, p in secret for n, q in (("password=", ""), ("PASSWORD = ", '"'), ("token: ", ""), ("secret_key=", ""), ("pwd = ", "'")) for kind in ("short", "letters", "phrase", "marked")]
    yes += [(a, kind, b, p, 1) for a, b, p in secret for kind in ("jwt", "pem")]
    yes += [(f"{a}{n} ", kind, b, p, 1) for a, b, p in secret for n in ("password", "passphrase", "password is", "passphrase was") for kind in ("short", "marked")]
    yes += [(a, kind, b, p, 1) for a, b, p in (*secret, ("", "", "src1"), ("it is ", ".", "src9"), ("(", ")", "docs/guide.md")) for kind in ("issued_a", "issued_b", "issued_c", "issued_d")]
    yes += [(f"{a}{scheme}://{user}:", kind, "@db.example.org/x" + b, p, 1) for a, b, p in secret for scheme, user in (("postgres", "admin"), ("https", "svc-1"), ("amqp", "user")) for kind in ("short", "letters", "mixed", "phrase")]
    other = (("and so it was ", " that the", "src7"), ("\n", "\n", "docs/changes.md"), ("see ", ", then", "tests/fixtures/a.json"), ("as in ", " below", "notes/log.txt"))
    harmless = (
        ("commit ", "hex40"), ("sha256:", "hex64"), ("md5 = ", "hex32"), ("ETag: ", "hex32"), ("", "digits16"), ("card ", "digits16"), ("", "digits20"), ("order ", "digits16"), ("uuid ", "uuid"), ("", "uuid"),
        ("https://example.org/a/", "hex40"), ("https://example.org/", "slug"), ("", "slug"), ("file ", "slug"), ("= ", "digits16"), ("id: ", "digits20"), ('class="', "slug"), ("checksum = ", "base64"), ("revision: ", "hex40"),
    )
    no = [(f"{a}{before}", kind, b, p, 0) for a, b, p in other for before, kind in harmless]
    no += [(f"{a}{n}", "placeholder", b, p, 0) for a, b, p in (("set ", " here", "docs/guide.md"), ("\n", "\n", "examples/sample.env"), ("use ", ".", "src1")) for n in ("token = ", "password: ", "API_KEY=", "secret: ")]
    no += [(f"{a}{n}{q}", "word", q + b, p, 0) for a, b, p in (("the ", " is given", "src4"), ("\n", "\n", "docs/guide.md"), ("a ", ", of course", "src2")) for n, q in (("password: ", ""), ("token = ", '"'), ("secret_key=", ""), ("auth: ", ""), ("credential: ", ""))]
    no += [(f"{a}://user:", kind, "@host.example.org/" + b, p, 0) for a, b, p in (("see postgres", " here", "docs/guide.md"), ("\nhttps", "\n", "examples/sample.env"), ("mysql", ".", "src1")) for kind in ("word", "placeholder")]
    no += [(a, "constant", b, p, 0) for a in ("\n", "export ", "in the ", "by ") for b, p in (("=yes\n", "deploy/prod.env"), (' = "x"\n', "src4"), (" is set", "docs/guide.md"))]
    return yes + no


LABELLED = _labelled()
VALUES = {
    "hex32": "substring(s, 1, 32)", "hex40": "substring(s, 1, 40)", "HEX40": "upper(substring(s, 1, 40))", "hex64": "s",
    "digits16": "rpad(regexp_replace(s, '[a-f]', ''), 16, '7')", "digits20": "rpad(regexp_replace(s, '[a-f]', ''), 20, '3')",
    "uuid": "regexp_replace(substring(s, 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')",
    "base64": "regexp_replace(base64(unhex(s)), '[\\\\s]', '')", "mixed": "concat('k3', substring(regexp_replace(base64(unhex(s)), '[+/=\\\\s]', 'x'), 1, 32))",
    "slug": "concat(element_at(w, 1 + i % 40), '-', element_at(w, 41 + i % 50), '-', element_at(w, 91 + i % 60), '-', 2000 + i % 25)",
    "short": "concat(initcap(translate(substring(s, 1, 4), '0123456789', 'ghijkmprst')), substring(s, 5, 1 + i % 5), 'X', 2 + i % 7)", "letters": "substring(regexp_replace(base64(unhex(s)), '[^A-Za-z]', 'q'), 1, 18 + i % 9)",
    "constant": "upper(concat_ws('_', element_at(w, 1 + i % 40), concat('s', i % 10), if(i % 2 = 0, 'secret', element_at(w, 41 + i % 50)), if(i % 3 = 0, 'token', 'access_key')))",
    "dotted": "concat(substring(s, 1, 9), '.', upper(substring(s, 10, 8)), '.', substring(s, 20, 12))", "marked": "concat(initcap(translate(substring(s, 1, 3), '0123456789', 'ghijkmprst')), '@', substring(s, 5, 3 + i % 4), '!', i % 10)",
    "phrase": "concat_ws('-', element_at(w, 1 + i % 40), element_at(w, 41 + i % 50), translate(substring(s, 1, 6), '0123456789', 'ghijkmprst'), element_at(w, 91 + i % 60))",
    "jwt": "concat('eyJ', substring(translate(base64(unhex(s)), '+/=\n\r', '-_x'), 1, 24), '.eyJ', substring(translate(base64(unhex(reverse(s))), '+/=\n\r', '-_x'), 1, 30), '.', substring(translate(base64(unhex(s)), '+/=\n\r', '-_x'), 5, 22))",
    "pem": "concat('-----BEGIN RSA PRIVATE KEY-----\n', base64(unhex(s)), '\n', base64(unhex(reverse(s))), '\n-----END RSA PRIVATE KEY-----')",
    "issued_a": "concat('ghp_', substring(translate(base64(unhex(concat(s, reverse(s)))), '+/=\n\r', 'aB'), 1, 36))",
    "issued_b": "concat(if(i % 2 = 0, 'sk_live_', 'rk_test_'), substring(translate(base64(unhex(s)), '+/=\n\r', 'k7'), 1, 24))",
    "issued_c": "concat('xoxb-', 100000000000 + i * 7919, '-', 200000000000 + i * 104729, '-', substring(translate(base64(unhex(s)), '+/=\n\r', 'Zq'), 1, 24))",
    "issued_d": "concat(if(i % 2 = 0, 'AKIA', 'ASIA'), substring(translate(upper(base64(unhex(s))), '+/=\n\r', 'XY'), 1, 16))",
    "word": "element_at(w, 1 + i * 7 % 180)",
    "placeholder": "concat(repeat(substring('xX0*y', 1 + i % 3, 1), 14 + i % 9), '1234567')",
}


def labelled_findings(spark: SparkSession, each: int = 8, templates: list[Template] = LABELLED) -> DataFrame:
    """The labelled findings to train on: what candidates() finds in `each` texts for every template, so that context and
    values are cut as in documents. Their number is fixed, whatever the input."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "t int, before string, kind string, after string, path string, label int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumn("i", F.abs(F.hash("before", "kind", "after", "k") % 1000))
    rows = rows.withColumn("s", F.sha2(F.concat_ws(":", "before", "after", "k", "kind"), 256)).withColumn("w", F.array(*map(F.lit, sorted(set(DICTIONARY)))))
    value = F.expr("case kind " + " ".join(f"when '{k}' then {v}" for k, v in VALUES.items()) + " end")
    texts = rows.select((F.col("t") * each + F.col("k")).cast("long").alias("doc_id"), value.alias("value"), F.col("label").cast("double").alias("label"), "before", "after", "path").withColumn("text", F.concat("before", "value", "after"))
    found = candidates(texts, path="path").join(texts.select("doc_id", "label", "value"), "doc_id")
    return found.filter("label = 0 or candidate = value").select("candidate", "before", "after", "path", "label")


def train(labelled: DataFrame, trees: int = 30, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel:
    """A random forest from labelled findings (candidate, before, after, path, label)."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(labelled))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors.repartition(4))


_forests: dict[str, RandomForestClassificationModel] = {}


def forest(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of labelled_findings(), trained once an application: they are fixed, so it is the same each time."""
    key = spark.sparkContext.applicationId
    if key not in _forests:
        _forests.clear()
        _forests[key] = train(labelled_findings(spark))
    return _forests[key]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, pos, candidate, score (share of the forest for "secret"), is_secret.

    A value directly assigned to a secret's name (token=, password: ...) is a candidate whatever its length, with marks
    such as . @ ! inside it; so are private keys in PEM and JSON web tokens as a whole, and what has a digit and follows
    the word password. Elsewhere a candidate takes 16 letters, digits and _+/-, with a digit among them.

    Null and empty texts have no candidates; null ids, repeated rows and repeated candidates stay as they are; a null
    path counts as empty; an empty table gives no rows; other columns are ignored.
    """
    model = train(labelled) if labelled is not None else forest(docs.sparkSession)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(candidates(docs, id_col, text_col, path)))
    score = vector_to_array("probability")[1]
    return model.transform(rows).select("doc_id", "pos", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, path: str = "source", mark: str = "<secret>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every confirmed secret in its text replaced; same rows and columns.

    A secret of 16 characters or more is replaced wherever its text has it, a shorter one where it is a candidate.
    A row is known by its text and path, so rows without an id, or of one id, don't share secrets, and equal rows are
    treated alike. Null texts stay null, empty ones empty; a null path counts as empty; an empty table gives no rows.
    """
    text, where = F.col(text_col).cast("string"), F.coalesce(F.expr(path).cast("string"), F.lit(""))
    rows = packed(docs, k=F.xxhash64(text, where), t=text, p=where)
    secrets = F.sort_array(F.collect_set(F.struct(F.length("candidate").alias("n"), "candidate")), asc=False).alias("s")
    found = scan(rows.select("k", "t", "p").distinct(), "k", "t", "p").filter("is_secret").groupBy(F.col("doc_id").alias("k")).agg(secrets)
    secret = F.transform("s", lambda x: x["candidate"])
    parts, runs = F.split("t", CANDIDATE, -1), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))
    pieces = F.zip_with(runs, F.slice(parts, F.lit(2), F.size(parts)), lambda c, after: F.concat(F.when(F.array_contains(secret, c), F.lit(mark)).otherwise(c), after))
    marked = F.concat(F.element_at(parts, 1), F.array_join(pieces, ""))
    clean = F.aggregate(F.filter("s", lambda x: x["n"] >= 16), marked, lambda t, x: F.replace(t, x["candidate"], F.lit(mark)))
    out = rows.join(found, "k", "left").withColumn("t", F.when(F.col("s").isNotNull(), clean).otherwise(F.col("t")))
    return out.withColumn("row", F.col("row").withField(f"`{text_col}`", F.col("t"))).select("row.*")
