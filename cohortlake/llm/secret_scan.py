"""Secret scan with DataFrame functions only: fixed patterns, and character Markov models of random strings and identifiers.

Base spans: for each kind, the leftmost non-overlapping matches of its pattern that are long enough. Positions come from the text's
parts between matches: the parts and the matches alternate, so ends are running sums of lengths.

Markov spans: runs of key characters, less what base spans cover of them; what is left of a run in one place and has at least LEAST
characters is a span if its log-likelihood ratio per character transition, between a model of random strings and one of ordinary
identifiers, exceeds a threshold. The ratio of every span is returned beside it (of an assignment, that of the assigned value). Both models are transition
counts over character classes with add-one smoothing, trained by a group-by over labelled samples: random strings are digests of
counters in several alphabets; identifiers are words of a bounded sample of the documents that no base pattern touches, plain, in
capitals, and joined as names, constants, paths and slugs are, with a list of words that programs use, and beside them rules, table borders, alphabets and numbers in order.
Four fifths of the samples train the tables, the last fifth sets the threshold between its identifiers and its random strings.
The trained table has a fixed number of cells and enters the plan as a literal array.

Defined cases: null or empty text has no spans, counts 0 and the digest of the empty list; a table without ordinary words trains
identifiers from the counters' ordinals alone; repeated rows give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import staged
from cohortlake.llm.text_models import sampled_ids

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
# [0-9a-f]+ of 32 and more: runs are maximal either way, and shorter ones are dropped
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{" + str(LEAST) + ",}"
#: Character classes of the models: every lower-case letter, the upper-case ones, the digits, and the rest.
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N = len(CLASSES) + 1
SAMPLE_DOCUMENTS = 300
SAMPLE_WORDS = 4000
RANDOM_STRINGS = 1500
#: Least threshold of the ratio, and the shares of held-out identifiers and random strings that calibration leaves aside.
THRESHOLD = 0.6
FALSE_SHARE = 0.001
MISSED_SHARE = 0.01
#: Strings in an order that people write; each is drawn out and turned as far as its length.
ORDERED = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "qwertyuiopasdfghjklzxcvbnm", "zyxwvutsrqponmlkjihgfedcba", "9876543210")
#: Words that programs are written with, whatever language the documents are in; each counts CODE_WEIGHT times.
CODE_WORDS = (
    "access account action active adapter address after allow analysis array async available backend backup balance batch before binary block boolean border browser buffer build button bytes cache callback "
    "category change channel character check child class client cluster code collection column command common complete component config connection constant container content context control convert copy "
    "count create current custom database date debug decimal default delete depth device dialog directory disk display document domain download driver dynamic edit element email empty enable encoding end "
    "engine entity error event example exception execute expected export expression extension external factory failure feature field file filter final find first fixed flag float folder font format forward "
    "frame function future gateway generic global graph group handler hash header height helper hidden host icon identifier image implementation import index info initial inner input insert instance integer "
    "interface internal invalid item iterator java job json key kernel keyword label language last layer layout left length level library limit line link list listener local location lock logger lookup loop "
    "major manager mapping mask master match matrix maximum member memory menu message metadata method minimum mode model module mouse multi name native network next node normal null number object offset "
    "open operation option order output override owner package padding page parameter parent parse partition path pattern payload permission pixel platform player plugin point pool port position prefix "
    "previous primary print priority private process profile program project property protocol provider public python quality query queue quick random range raw read record recovery redirect reference "
    "register release remote remove render replace report repository request require reset resource response result retry return right role root route row runtime sample scale schedule schema scope screen "
    "script search section segment select send sequence serializer server service session setting shared simple single size socket sort source space split stack standard start state static status step "
    "storage stream string struct style submit success suffix support switch symbol sync syntax system table target task template temporary test text thread threshold timeout title toggle tool top total "
    "trace track transaction transform tree trigger type undefined unique unit update upload url user utility valid value variable vector verbose version view virtual visible wait warning weight widget "
    "width window worker wrapper write xml yaml year zone zoom"
)
CODE_WEIGHT = 5
BORDERS = ("+-", "+--", "+---", "+-----", "+=====", "-=", "=-", "_-", "/-", "+=", "-_", "=_", "//--", "--==", "-+-", "/=", "__--", "0/", "+-+")


#: Elements of an array that a running total takes at once.
BLOCK = 64


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of whole numbers from zero on. Blocks are run through apart and then raised by what stands before
    them, since appending to one array copies it at each step."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    through = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))
    inner = F.transform(blocks, through)
    before = through(F.transform(inner, lambda x: F.element_at(x, -1)))
    raised = F.transform(F.arrays_zip(inner.alias("x"), F.slice(before, 1, F.size(inner)).alias("o")), lambda p: F.transform(F.slice(p["x"], 2, F.lit(BLOCK)), lambda v: combine(v, p["o"])))
    return F.when(F.size(values) > 0, F.flatten(raised)).otherwise(F.array().cast("array<int>"))


def added(a: Column, b: Column) -> Column:
    return a + b


def match_lengths(text: Column, pattern: str, found: Column) -> Column:
    """The length of each match with the text before it, from the parts between matches; texts without a match are not taken apart."""
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    return F.when(F.size(found) > 0, lengths).otherwise(F.array().cast("array<int>"))


def matches(lengths: Column, found: Column) -> Column:
    """array<struct<s, e, m>>: start, end (code points) and text of the leftmost non-overlapping matches."""
    placed = F.zip_with(running(lengths, added), found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def uncovered(runs: Column, base: Column) -> Column:
    """array<struct<s, e, m>>: the parts of the runs (s, e, m) outside the base spans (s, ..., e), of LEAST characters and more."""
    ordered = F.array_sort(base)
    reach = running(F.transform(ordered, lambda b: b["e"]), lambda a, b: F.greatest(a, b))
    open_ = F.zip_with(F.concat(F.array(F.lit(0)), reach), F.concat(F.transform(ordered, lambda b: b["s"]), F.array(F.lit((1 << 31) - 1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    part = lambda x, g: F.struct(F.greatest(x["s"], g["a"]).alias("s"), F.least(x["e"], g["b"]).alias("e"))
    cut = lambda x: F.filter(F.transform(open_, lambda g: part(x, g)), lambda p: p["e"] - p["s"] >= LEAST)
    named = lambda x: F.transform(cut(x), lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.substring(x["m"], p["s"] - x["s"] + 1, p["e"] - p["s"]).alias("m")))
    return F.flatten(F.transform(runs, named))


def codes(token: Column) -> Column:
    """The classes of a token's characters."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(CLASSES), c))


def transitions(token: Column) -> Column:
    """The cell of each pair of neighbouring characters: the classes and the same from the second on, side by side."""
    pairs = F.zip_with(codes(F.left(token, F.length(token) - 1)), codes(F.substring(token, 2, 1 << 30)), lambda a, b: a * N + b)
    return F.when(F.length(token) > 1, pairs).otherwise(F.array(F.lit(0)))


def training_samples(docs: DataFrame) -> DataFrame:
    """token, label: 1 for random strings, 0 for ordinary identifiers."""
    spark = docs.sparkSession
    ordinal = spark.range(RANDOM_STRINGS).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.col("id"))
    base64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    random = ordinal.select(F.explode(F.array(base64, F.regexp_replace(base64, "[+/]", ""), F.substring("h", 1, 40), F.upper(F.regexp_replace(base64, "[+/]", "")))).alias("token"), F.lit(1).alias("label"))
    word = F.explode(F.filter(F.split(F.col("text"), r"[^A-Za-z0-9_]+"), lambda w: F.length(w).between(5, 40)))
    chosen = sampled_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null"), None, SAMPLE_DOCUMENTS)
    few = F.broadcast(spark.createDataFrame([(x,) for x in chosen], "doc_id long"))
    # the chosen texts alone are searched for secrets
    some = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id").select("text"), "secret-sample")
    some = some.filter(~F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    words = some.select(word.alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WORDS)
    code = spark.createDataFrame([(CODE_WORDS,)], "x string").select(F.explode(F.split("x", " ")).alias("w")).select("w", F.explode(F.sequence(F.lit(1), F.lit(CODE_WEIGHT))).alias("turn"))
    words = words.select("w", F.lit(0).alias("turn")).unionByName(code)
    # neighbours in the order of the hash make the words of a joined name
    named_words = words.withColumn("at", F.row_number().over(Window.orderBy(F.xxhash64("w", "turn"), "w")))
    each = [F.lead("w", k).over(Window.orderBy("at")) for k in range(1, 5)]
    five = named_words.select(F.filter(F.array(F.col("w"), *each), lambda x: x.isNotNull()).alias("five"))
    low, high, title = (F.transform("five", f) for f in (F.lower, F.upper, F.initcap))
    some_of = lambda a, n: F.slice(a, 1, F.lit(n))
    forms = [F.col("five")[0], F.upper(F.col("five")[0]), *[F.array_join(some_of(a, n), sep) for n in (3, 5) for a, sep in ((low, "_"), (high, "_"), (title, ""), (low, "-"), (low, "/"), (title, "/"), (high, "-"), (low, ""))]]
    ordinary = five.select(F.explode(F.array(*forms)).alias("token"), F.lit(0).alias("label"))
    # numbered names, dates, times and versions
    day = lambda step, form: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") * step).cast("int")), form)
    number = F.col("id").cast("string")
    numbered = [F.concat_ws("_", F.lit("item"), number), F.concat(day(97, "yyyy-MM-dd"), F.lit("_"), day(131, "yyyy-MM-dd")), F.concat(day(89, "yyyyMMdd"), F.lit("_"), F.lpad((F.col("id") * 311 % 240000).cast("string"), 6, "0")), F.concat(F.lit("backup-"), day(101, "yyyy-MM-dd"), F.lit("-v"), number), F.concat(day(61, "yyyy/MM/dd"), F.lit("/"), number)]
    counted = spark.range(200).select(F.explode(F.array(*numbered)).alias("token"), F.lit(0).alias("label"))
    turned = spark.createDataFrame([(x[k:] + x[:k],) for x in ORDERED for k in range(len(x))], "x string").select(F.explode(F.array(F.repeat("x", 3), F.repeat("x", 6))).alias("token"), F.lit(0).alias("label"))
    # rules of one character, and borders, weigh as much as they are long
    drawn = spark.range(len(CLASSES)).select(F.repeat(F.substring(F.lit(CLASSES), F.col("id").cast("int") + 1, F.lit(1)), F.lit(2000)).alias("token"), F.lit(0).alias("label"))
    borders = spark.createDataFrame([(x,) for x in BORDERS], "x string").select(F.repeat("x", 100).alias("token"), F.lit(0).alias("label"))
    return reduce(DataFrame.unionByName, [random, ordinary, counted, turned, drawn, borders])


def calibrated(samples: DataFrame, table: list[float]) -> float:
    """The threshold half-way between what all but FALSE_SHARE of the ordinary samples of LEAST characters and more stay below and
    what all but MISSED_SHARE of the random ones exceed, and not below THRESHOLD."""
    r, label = likelihood_ratio(F.col("token"), table), F.col("label")
    ordinary, random = F.percentile(F.when(label == 0, r), 1 - FALSE_SHARE), F.percentile(F.when(label == 1, r), MISSED_SHARE)
    low, high = samples.filter(F.length("token") >= LEAST).agg(ordinary, random).first()
    return max(THRESHOLD, (float(low or 0.0) + float(high or 0.0)) / 2)


def trained(docs: DataFrame) -> tuple[list[float], float]:
    """The table of ratios and the threshold."""
    samples = staged(training_samples(docs).filter("length(token) > 1"), "secret-training")
    held = F.pmod(F.xxhash64("token"), F.lit(5)) == 0
    table = ratio_table(samples.filter(~held))
    return table, calibrated(samples.filter(held), table)


def ratio_table(samples: DataFrame) -> list[float]:
    """Per cell, log P(second | first) among random strings less that among identifiers; N * N cells whatever the sample."""
    pairs = samples.select("label", F.explode(transitions(F.col("token"))).alias("cell")).groupBy("cell").agg(F.sum("label").alias("r"), F.sum(1 - F.col("label")).alias("o"))
    grid = samples.sparkSession.range(N * N).select(F.col("id").cast("int").alias("cell")).join(pairs, "cell", "left").na.fill(0, ["r", "o"])
    row = F.floor(F.col("cell") / N)
    sums = grid.groupBy(row.alias("row")).agg(F.sum("r").alias("rt"), F.sum("o").alias("ot"))
    table = grid.join(sums, row == F.col("row")).select("cell", (F.log((F.col("r") + 1) / (F.col("rt") + N)) - F.log((F.col("o") + 1) / (F.col("ot") + N))).alias("llr"))
    return [float(x[1]) for x in table.orderBy("cell").collect()]


def likelihood_ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per transition."""
    cells = F.lit([round(x, 4) for x in table])
    return F.aggregate(transitions(token), F.lit(0.0), lambda acc, i: acc + F.element_at(cells, i.cast("int") + 1)) / F.greatest(F.length(token) - 1, F.lit(1))


def named(kind: str, spans: Column, table: list[float], value: Callable[[Column], Column] = lambda m: m) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), likelihood_ratio(value(x["m"]), table).alias("r")))


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, ratios. Without a table, one and its threshold are trained on docs."""
    if table is None:
        table, threshold = trained(docs)
    assigned = lambda m: F.regexp_extract(m, ASSIGN, 2)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "runs": CANDIDATE}
    rows = rows.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in patterns.items()])
    # each step is a projection of its own, since what an expression names twice is worked out twice
    rows = rows.select("doc_id", *[f"_{k}" for k in patterns], *[match_lengths(F.col("text"), p, F.col(f"_{k}")).alias(f"_{k}_n") for k, p in patterns.items()])
    rows = rows.select("doc_id", *[matches(F.col(f"_{k}_n"), F.col(f"_{k}")).alias(k) for k in patterns])
    rows = rows.withColumn("assign", F.filter("assign", lambda x: F.length(assigned(x["m"])) >= 8))
    base = F.concat(named("assign", F.col("assign"), table, assigned), named("access", F.col("access"), table), named("hex", F.col("hex"), table))
    size = lambda c: F.size(c).cast("bigint")
    rows = rows.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), "runs", F.array_sort(base).alias("base"))
    left = F.when(F.size("base") > 0, uncovered(F.col("runs"), F.col("base"))).otherwise(F.col("runs"))
    random = F.filter(named("markov", left, table), lambda x: x["r"] > threshold)
    rows = rows.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", random)).alias("all"))
    ratios = F.array_join(F.transform("all", lambda x: F.round(x["r"], 3).cast("string")), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("all")).alias("spans"), ratios.alias("ratios"))
