"""Secret scan: patterns find candidates, a random forest removes false positives.

Everything on the rows is done by built-in functions and the JVM's own forest. The forest is trained from labelled findings
(columns as ``candidates`` makes them, and ``label``). Where no findings are labelled, ``labelled_findings`` makes a stated set:
names, ways of writing an assignment, kinds of values, paths and neighbouring words are drawn independently, so that the forest
learns what each of them says and no layout.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import drop_staged, stage

GAP = "[\\x20\\x09-\\x0D]+"
#: A word is a candidate if it has a run of so many key characters among which there is a digit. The pattern is tried at
#: the beginnings of runs only, so that a long one costs no more than its length.
CANDIDATE = "(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9+/_=.-]{12,}"
#: Signs between the fields of a word (a query string, JSON without spaces), each of which is looked at by itself. How far it
#: looks ahead is bounded, so that a long word costs no more than its length.
BETWEEN = "[&,;?{|]+(?=[\"']?[A-Za-z_][A-Za-z0-9_.-]{0,40}[\"']?[=:])|(?<=[\"'])[,;]+(?=[\"'])|(?<=[\"'])[}\\]]+$|[,;|&](?=[A-Za-z0-9+/_=.-]{12})"
#: Known beginnings of keys.
PREFIX = "(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk-|AIza|glpat-)"
#: A known prefix, or a name with its value, makes a candidate of any length with or without digits.
NAMED = "^-----BEGIN$|(?<![A-Za-z0-9])" + PREFIX + "[A-Za-z0-9]|[A-Za-z_\"'\\]][=:]+[\"']?[^=:/\"']"
#: Names that announce secrets, and names that announce look-alikes.
SECRET_NAMES = "(?i)(passw|passwd|pwd|secret|token|api_?key|access_?key|auth|credential|bearer|private)"
OTHER_NAMES = "(?i)(commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|isbn|order|invoice|phone|card|build|version|ref|id[:=])"
#: The word before a value: an assignment, or a name that announces secrets.
ANNOUNCED = "[=:]$|" + SECRET_NAMES + "[A-Za-z0-9_]{0,20}[\"']?$"
#: Frequent words, of which the share in a value is its dictionary coverage.
DICTIONARY = (
    "about account action address admin after again album alpha android annual answer apple april archive area article august author "
    "back base before beta blog blue board body book border bottom branch brown build business button cache call camera card cart "
    "case category center change check child city class clean click client close cloud code color comment common company config "
    "contact content copy count country create current custom data date december default delete demo desktop detail device dialog "
    "document door down download draft dragon drive edit email empty engine english error event example export family field file "
    "filter final first flash folder font food foot form forum frame free friday friend from front full game gallery garden general "
    "global gold green group guest guide hash head header health hello help here high history home hotel house html http icon image "
    "import index info input issue item java july june just label land large last layer left letter level library light line link "
    "linux list live local login logo long love mail main make march market master media member menu message mobile model module "
    "money monday month more mouse movie music name network never news next night node note november number object october offer "
    "office online open option order other page panel paper part party pass password path people phone photo place plan play player "
    "plugin point policy popular post press price print private product profile project public query quick random read record red "
    "register release report request reset result return review right river road role root rule sample save school score screen "
    "script search second secret secure security select send sept server service session setting shadow share shop short show side "
    "sign simple site size small social some song sort sound source space sport staff star start state static status step stop store "
    "story street string student style submit summer sunday support system table target task team template test text theme thing "
    "this thread time title today token tool total train travel tree type under update upload url user utils value version video view "
    "water web week welcome white window winter wood word work world write year yellow your"
).split()
#: What stands for a value that isn't given.
PLACEHOLDER = "(?i)(example|sample|dummy|placeholder|changeme|change_me|your|xxxx|[*]{3}|<.*>|[$][{(]|todo|null|none|redacted)"
#: Where secrets are made up, and where they are set.
TEST_PATH = "(?i)(test|spec|example|sample|fixture|mock|demo|readme|docs?/)"
CONFIG_PATH = "(?i)([.]env|[.]ini|[.]cfg|[.]conf|[.]ya?ml|[.]toml|[.]properties|config|settings|deploy|prod)"
#: Letter pairs of the dictionary; a made-up key has many that no word has.
PAIRS = {a: "".join(sorted({w[k + 1] for w in DICTIONARY for k in range(len(w) - 1) if w[k] == a})) for a in "abcdefghijklmnopqrstuvwxyz"}
TREES, DEPTH, SEED = 32, 10, 7
THRESHOLD = 0.5
#: Kinds of neighbouring characters: a and A for letters, 0 for digits, - for other signs; either order unless it says otherwise.
TRANSITIONS = {"lower_digit": "a0|0a", "upper_digit": "A0|0A", "lower_upper": "aA", "upper_lower": "Aa", "sign_other": "-[aA0]|[aA0]-"}
FEATURES = [
    *"length digit_ratio upper_ratio hex_only distinct_ratio".split(),
    *TRANSITIONS,
    *"consonant_pairs usual_pairs dictionary_ratio placeholder path_parts url_like at_sign test_path config_path".split(),
    *"secret_before other_before secret_after other_after assigned quoted known_prefix key_block".split(),
]
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, path, word_index, word (a field of it), before and after (the two words on either side).

    Candidates are runs of key characters (``CANDIDATE``), known prefixes, beginnings of key blocks, values with a name, and
    words after an assignment or a name that announces secrets; the forest rejects. Null and empty texts have none; a null
    path, or none, is empty; repeated rows repeat theirs; other columns aren't looked at.
    """
    text = F.col(f"`{text_col}`")
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    may = F.col("text").rlike(CANDIDATE) | F.col("text").rlike("[=:]|-----BEGIN|" + PREFIX) | F.col("text").rlike(SECRET_NAMES)
    part = docs.select(F.col(f"`{id_col}`").alias("doc_id"), path.alias("path"), text.alias("text")).where(may)
    words = part.select("doc_id", "path", F.filter(F.split("text", GAP), lambda w: w != "").alias("w"))
    w = F.col("w")

    def fields(x: Column, i: Column) -> Column:
        announced = F.coalesce(F.get(w, i - 1), F.lit("")).rlike(ANNOUNCED)
        own = lambda f: f.rlike(CANDIDATE) | f.rlike(NAMED) | (announced & f.rlike("[A-Za-z0-9]"))
        return F.transform(F.filter(F.split(x, BETWEEN), own), lambda f: F.struct(i.alias("word_index"), f.alias("word")))

    hits = F.flatten(F.transform("w", fields))
    near = lambda s, *k: F.concat_ws(" ", *[F.get(w, s["word_index"] + j) for j in k])
    full = F.transform(
        hits,
        lambda s: F.struct(
            s["word_index"].cast("long").alias("word_index"), s["word"].alias("word"), near(s, -2, -1).alias("before"), near(s, 1, 2).alias("after")
        ),
    )
    return words.select("doc_id", "path", F.inline(full))


def with_features(found: DataFrame) -> DataFrame:
    """Adds ``value`` (the word without its name, quotes and final signs) and the columns FEATURES, all numbers."""
    word = F.col("word")
    value = F.regexp_replace(F.regexp_replace(word, "^[^=:]*[A-Za-z_\"'][=:]+(?=.)", ""), "^[\"'(<\\[]+|[\"')>\\],.;:!?]+$", "")
    found = found.withColumn("value", value)
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    pairs = F.greatest(F.length(v) - 1, F.lit(1))
    kinds = F.regexp_replace(F.translate(v, _LOWER + _UPPER + _DIGITS, "a" * 26 + "A" * 26 + "0" * 10), "[^aA0]", "-")
    sounds = F.translate(F.lower(v), _LOWER, "".join("v" if x in "aeiouy" else "c" for x in _LOWER))
    words = "|".join(sorted(DICTIONARY, key=lambda x: (-len(x), x)))
    before = F.concat_ws(" ", "before", F.regexp_extract(word, "^([^=:]*[=:])", 1))
    number = {
        "length": F.length(v),
        "digit_ratio": F.regexp_count(kinds, F.lit("0")) / n,
        "upper_ratio": F.regexp_count(kinds, F.lit("A")) / n,
        "hex_only": v.rlike("^(?=.*[0-9])[0-9a-f]+$").cast("int"),
        "distinct_ratio": F.size(F.array_distinct(F.split(v, ""))) / n,
        **{k: F.regexp_count(kinds, F.lit(f"(?={p}).")) / pairs for k, p in TRANSITIONS.items()},
        "consonant_pairs": F.regexp_count(sounds, F.lit("(?=cc).")) / pairs,
        "usual_pairs": F.regexp_count(F.lower(v), F.lit("(?=" + "|".join(f"{a}[{b}]" for a, b in PAIRS.items() if b) + ").")) / pairs,
        "dictionary_ratio": 1 - F.length(F.regexp_replace(F.lower(v), words, "")) / n,
        "placeholder": v.rlike(PLACEHOLDER).cast("int"),
        "path_parts": F.regexp_count(v, F.lit("[/.]")),
        "url_like": word.rlike("(?i)(://|^www\\.|\\.(com|org|net|html?)\\b)").cast("int"),
        "at_sign": F.contains(word, F.lit("@")).cast("int"),
        "test_path": F.col("path").rlike(TEST_PATH).cast("int"),
        "config_path": F.col("path").rlike(CONFIG_PATH).cast("int"),
        "secret_before": before.rlike(SECRET_NAMES).cast("int"),
        "other_before": before.rlike(OTHER_NAMES).cast("int"),
        "secret_after": F.col("after").rlike(SECRET_NAMES).cast("int"),
        "other_after": F.col("after").rlike(OTHER_NAMES).cast("int"),
        "assigned": (word.rlike("[A-Za-z_\"'][=:].") | F.col("before").rlike("[=:]$")).cast("int"),
        "quoted": word.rlike("^[\"']|[=:][\"']").cast("int"),
        "known_prefix": v.rlike("^" + PREFIX).cast("int"),
        "key_block": (word.rlike("^-----BEGIN$") & F.col("after").rlike("PRIVATE")).cast("int"),
    }
    return found.withColumns({k: x.cast("double") for k, x in number.items()})


def labelled_findings(spark: SparkSession, n: int = 8_000, seed: int = 1) -> DataFrame:
    """A stated set of n labelled findings, the same at every call with a seed: path, word, before, after, label."""
    drawn = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003))
    pick = lambda k, options: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in options]), (drawn(k) % len(options) + 1).cast("int"))
    hexa = lambda k: F.sha2(F.concat_ws(":", "id", F.lit(seed), F.lit(k)), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexa(1))), "[^A-Za-z0-9]", "")
    digits = F.regexp_replace(F.conv(F.substring(hexa(2), 1, 15), 16, 10), "^0", "7")
    upper = F.substring(F.translate(F.upper(mixed), "0189", "2345"), 1, 16)
    letters = F.translate(mixed, _DIGITS, "kqzvjxwbgf")
    word = lambda k: pick(k, DICTIONARY[::3])
    places = ["", "src1/main.py", "app/config/prod.yaml", "deploy/.env", "docs/readme.md", "tests/test_login.py", "web", "forum", "mail/2020"]
    sounds = lambda k: F.concat(*[x for j in range(3) for x in (F.element_at(F.split(F.lit("b d f g l m n p r s t v"), " "), (drawn(f"{k}c{j}") % 12 + 1).cast("int")), F.element_at(F.split(F.lit("a e i o u ea ou ie"), " "), (drawn(f"{k}v{j}") % 8 + 1).cast("int")))])  # noqa: E731, E501
    filler = lambda k: pick(k, "the in of with see and for at our from was then so to by it when you we they".split())
    own = pick("own", "password passwd pwd secret token api_key apikey access_key auth_token client_secret private_key credential db_password AUTH_TOKEN".split())
    other = pick("other", "commit sha1 sha256 md5 hash checksum digest uuid isbn order invoice phone version build ref id".split())
    some = pick("some", ["name", "title", "color", "lang", "user", "path", word("nameword"), sounds("namesound")])
    random = pick(
        "random",
        [F.substring(hexa(3), 1, 16), F.substring(hexa(3), 1, 32), F.substring(hexa(3), 1, 40), hexa(3), F.substring(mixed, 1, 20), F.substring(mixed, 1, 32),
         F.base64(F.unhex(F.substring(hexa(4), 1, 48))), F.substring(letters, 1, 12), F.concat(F.substring(mixed, 1, 6), F.lit("-"), F.substring(mixed, 7, 6))],
    )
    chosen = pick("chosen", [F.concat(word("w1"), (drawn("d1") % 1000).cast("string")), F.concat(F.initcap(word("w2")), word("w3"), F.lit("!")), F.concat(sounds("s1"), (drawn("d2") % 100).cast("string")), F.substring(letters, 1, 8), sounds("s4"), F.concat(sounds("s5"), word("w4")), F.concat(word("w5"), word("w6"))])
    hidden = pick("hidden", ["changeme", "your-token-here", "<password>", "${SECRET}", "xxxxxxxxxxxx", "********", "example-secret-1", "null", "None", "dummy_value_2", "REDACTED"])
    uuid = F.concat_ws("-", *[F.substring(hexa(5), a, m) for a, m in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    named = pick("named", [F.substring(hexa(6), 1, 40), F.substring(hexa(6), 1, 32), hexa(6), uuid, F.substring(digits, 1, 13), F.concat_ws(".", (drawn("v1") % 20).cast("string"), (drawn("v2") % 20).cast("string"), (drawn("v3") % 20).cast("string"))])
    plain = pick(
        "plain",
        [uuid, digits, F.substring(hexa(7), 1, 40), F.concat(word("p1"), F.lit("."), sounds("p2"), F.lit("@"), sounds("p3"), F.lit(".org")), F.concat(F.lit("https://"), sounds("p4"), F.lit(".com/"), word("p5"), F.lit("/"), F.substring(digits, 1, 5)),
         F.concat(F.lit("/usr/"), word("p6"), F.lit("/"), sounds("p7"), F.lit("/v1/"), word("p8"), F.lit(".txt")), F.concat(word("p9"), F.initcap(word("p10")), F.initcap(word("p11")), F.lit("2")), F.concat(F.lit("2019-0"), (drawn("m") % 9 + 1).cast("string"), F.lit("-11T10:20:30")),
         F.concat(F.lit("+44-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 6)), F.concat(sounds("p12"), sounds("p13"), F.substring(digits, 1, 2)), F.concat_ws(".", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 3), F.substring(digits, 9, 2)), F.concat(word("p14"), F.lit("_"), word("p15"), F.lit("_"), F.substring(digits, 1, 6))],
    )
    key = F.concat(pick("prefix", ["AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "sk-", "AIza", "glpat-"]), F.when(drawn("up") % 2 == 0, upper).otherwise(F.substring(F.concat(mixed, mixed), 1, 30)))
    # parts are columns before they are combined, else each is repeated in the plan wherever it is used
    told = F.concat_ws(" ", filler("a3"), F.when(drawn("told") % 2 == 0, own).otherwise(other))  # a name that follows its value
    said = pick("said", [word("t1"), F.concat(word("t2"), F.lit("s")), sounds("t3"), F.concat(sounds("t4"), F.lit("ing")), F.initcap(sounds("t5")), F.concat(word("t6"), F.lit(",")), F.concat(sounds("t7"), F.lit("."))])
    parts = {"path": pick("path", places), "told": told, "said": said, "own": own, "other": other, "some": some, "random": random, "chosen": chosen, "hidden": hidden, "named": named, "plain": plain, "key": key}
    rows = spark.range(0, n, 1, 4).select("id", *[c.alias(k) for k, c in parts.items()])
    told, said, own, other, some, random, chosen, hidden, named, plain, key = map(F.col, list(parts)[1:])
    kinds = [(own, random, 1.0), (own, random, 1.0), (own, chosen, 1.0), (own, chosen, 1.0), (own, hidden, 0.0), (other, named, 0.0), (other, named, 0.0), (some, named, 0.0), (some, word("kind"), 0.0), (some, random, -1.0)]
    loose = [(key, 1.0), (key, 1.0), (F.concat(F.left(key, F.lit(4)), F.lit("EXAMPLEEXAMPLE1")), 0.0), (plain, 0.0), (plain, 0.0), (plain, 0.0)]
    at = drawn("kind")
    case = lambda rows, k, f: F.element_at(F.array(*[f(r) for r in rows]), (k % len(rows) + 1).cast("int"))
    name, value, label = (case(kinds, at, lambda r, j=j: F.lit(r[j]) if isinstance(r[j], float) else r[j]) for j in range(3))
    free_word, free_label = (case(loose, at, lambda r, j=j: F.lit(r[j]) if isinstance(r[j], float) else r[j]) for j in range(2))
    rows = rows.select("id", "path", "told", "said", "random", "own", name.alias("name"), value.alias("value"), label.alias("label"), free_word.alias("free_word"), free_label.alias("free_label"))
    name, value, label, free_word, free_label = map(F.col, "name value label free_word free_label".split())
    quote = pick("quote", ['"', "'"])
    bind = pick("bind", ["=", ":"])
    styles = [
        (F.concat(name, bind, value), filler("b1"), filler("b2")),
        (F.concat(name, bind, quote, value, quote), filler("b1"), filler("b2")),
        (F.concat(quote, name, quote, F.lit(":"), quote, value, quote), filler("b1"), filler("b2")),
        (value, filler("b1"), F.concat(name, bind)),
        (F.concat(quote, value, quote), name, bind),
        (value, filler("b1"), name),
        (value, name, F.lit("is")),
    ]
    style = lambda j: case(styles, drawn("style"), lambda r: r[j])
    part = drawn("part") % 20
    block = part == 19
    named_after = part == 18
    free = (part >= 13) & ~block & ~named_after
    private = drawn("private") % 2 == 0
    prose = (part >= 8) & (part < 13)  # a word of prose after a name is no secret
    # what else decides: a password in letters needs a sign of assignment and no test; a bare random value is one where settings are
    spoken = (drawn("style") % len(styles) >= len(styles) - 2) & value.rlike("^[A-Za-z]+$")
    made_up = F.col("path").rlike(TEST_PATH) & ~value.rlike("[A-Za-z0-9+/]{16}")
    assigned = F.when(label < 0, F.col("path").rlike(CONFIG_PATH).cast("double")).when(spoken | made_up, 0.0).otherwise(label)
    return rows.select(
        "path",
        F.when(block, "-----BEGIN").when(named_after, F.col("random")).when(free, free_word).when(prose, F.col("said")).otherwise(style(0)).alias("word"),
        F.when(block | free | named_after, F.concat_ws(" ", filler("b3"), filler("b4")))
        .when(prose & (drawn("near") % 2 == 0), F.concat_ws(" ", own, filler("b3")))
        .when(prose, F.concat_ws(" ", filler("b3"), own))
        .otherwise(F.concat_ws(" ", style(1), style(2)))
        .alias("before"),
        F.when(block & private, "RSA PRIVATE").when(block, "CERTIFICATE----- MIIB").when(named_after, F.col("told")).otherwise(F.concat_ws(" ", filler("a1"), filler("a2"))).alias("after"),
        F.when(block, private.cast("double")).when(named_after, (drawn("told") % 2 == 0).cast("double")).when(free, free_label).when(prose, F.lit(0.0)).otherwise(assigned).alias("label"),
    )


_fitted: dict[str, PipelineModel] = {}


def fitted(spark: SparkSession) -> PipelineModel:
    """The forest of the stated findings, trained once for an application."""
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        _fitted[key] = train(labelled_findings(spark))
    return _fitted[key]


def train(findings: DataFrame) -> PipelineModel:
    """The forest, from labelled findings: columns path, word, before, after and label (1: a secret); rows without a label are left out."""
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", featureSubsetStrategy="sqrt")
    # one file, so that training meets the same rows in the same order on any cluster
    rows = stage(with_features(findings.where("label is not null")).select("label", *FEATURES).coalesce(1), "findings")
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)
    drop_staged(rows)
    return model


def secret_scan(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate that isn't removed as a false positive, and per removed one: doc_id, word_index, n_chars,
    value_sha256, probability (6 decimals), is_secret. The value itself isn't returned. Documents without candidates,
    and an empty table, give no rows."""
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    p = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select(
        "doc_id",
        "word_index",
        F.length("value").cast("long").alias("n_chars"),
        F.sha2("value", 256).alias("value_sha256"),
        p.alias("probability"),
        (p >= THRESHOLD).alias("is_secret"),
    )
