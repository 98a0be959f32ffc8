"""Secret spans in texts, by patterns and by a character Markov model. DataFrame and SQL functions only.

Patterns find assigned secrets, access keys and long hexadecimal runs. Runs of
20 or more letters, digits and +/_=- that touch no such span are scored by the
log-likelihood ratio per character step of two first-order Markov models with
add-one smoothing: one trained on samples labelled random, one on samples
labelled ordinary identifiers. The samples are generated by a rule
(SAMPLES of either label).

Positions are code points. Cases: a null or empty text has no span; empty
tables give empty results; rows with equal ids are scanned each on its own;
other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SAMPLES = 6000
#: Words that the ordinary sample's identifiers are joined from.
WORDS = (
    "account action active address admin agent alert amount array async author average backup balance base batch before block body border buffer build bundle button cache call card center channel char check child class clean client clone close cluster code color column command comment common "
    "component config connect console content context control convert copy count create current cursor data date debug default delete depth detail device dialog direct disable display document domain download driver element email enable encode engine entry error event example export factory field file filter final "
    "first flag float folder format frame function global graph group handle header height history image import index info input insert instance integer internal item iterator label language last layer layout length level library limit line link list load local location logger login loop manager map master match "
    "memory menu merge message method model module mouse name native network next node number object offset option order output owner package page panel parent parse partition path pattern payment person pixel player point policy port position prefix price process product profile project property public query queue random range "
    "reader record region remote render report request reset resource response result return route row sample scale schema scope screen script search section select sender server service session setting shape share signal simple single size sort source space stack start state static status storage store stream string style submit "
    "summary support switch symbol system table target task template test text theme thread time title token toggle tool total track tree trigger type unique unit update upload user utility valid value vector version video view virtual visible volume warning watch web week width window word worker wrapper write yaml year zone"
)


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(random boolean, s): n labelled samples of either kind."""
    ids = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256))
    raw = F.base64(F.unhex("h"))
    letters = F.regexp_replace(raw, "[+/=]", "")
    made = F.when(F.col("id") % 4 == 0, F.col("h")).when(F.col("id") % 4 == 1, raw).when(F.col("id") % 4 == 2, letters).otherwise(F.translate(raw, "+/=", "-_"))
    chance = ids.select(F.lit(True).alias("random"), F.substring(made, 1, 32).alias("s"))
    words = F.split(F.lit(WORDS), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    three = [pick(k) for k in range(4)]
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2030)).cast("string")
    named = F.element_at(
        F.array(
            F.concat_ws("_", *three), F.concat_ws("-", *three), F.concat_ws("/", *three), F.concat(*(F.initcap(w) for w in three)), F.concat(three[0], *(F.initcap(w) for w in three[1:])),
            F.concat(*three), F.upper(F.concat_ws("_", *three)), F.concat_ws("_", *three, number), F.concat_ws("/", F.lit(""), *three, F.lit("")), F.concat_ws("-", number, *three), F.repeat(F.substring(F.lit("=-_/+"), (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(5)) + 1).cast("int"), F.lit(1)), 24),
        ),
        (F.col("id") % 11 + 1).cast("int"),
    )
    return chance.union(ids.select(F.lit(False).alias("random"), named.alias("s")))


def train(labelled: DataFrame) -> str:
    """JSON array of log-likelihood ratios of steps, by (index of first) * len(ALPHABET) + (index of second).

    labelled: (random, s). Characters outside ALPHABET make no step.
    """
    spark, a = labelled.sparkSession, len(ALPHABET)
    at = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    steps = labelled.where("length(s) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.struct(F.substr("s", i, F.lit(1)).alias("c"), F.substr("s", i + 1, F.lit(1)).alias("d")))).alias("x"))
    steps = steps.select("random", at(F.col("x.c")).alias("c"), at(F.col("x.d")).alias("d")).where("c >= 0 and d >= 0")
    counts = steps.groupBy("c", "d").agg(F.count_if(F.col("random")).alias("r"), F.count_if(~F.col("random")).alias("o"))
    every = spark.range(a * a).select((F.col("id") / a).cast("int").alias("c"), (F.col("id") % a).cast("int").alias("d"))
    full = every.join(F.broadcast(counts), ["c", "d"], "left").fillna(0, ["r", "o"])
    totals = full.groupBy("c").agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    ratio = full.join(totals, "c").select((F.col("c") * a + F.col("d")).alias("k"), F.log((F.col("r") + 1) / (F.col("tr") + a) * (F.col("to") + a) / (F.col("o") + 1)).alias("x"))
    row = ratio.agg(F.array_sort(F.collect_list(F.struct("k", F.round("x", 6).alias("x")))).alias("t"))  # as many as the alphabet's square
    return row.select(F.to_json(F.col("t.x")).alias("j")).first().j


def score(s: Column, table: str) -> Column:
    """Mean log-likelihood ratio of the steps of s; positive: more like random. s is split into characters once."""
    ratios, a = F.from_json(F.lit(table), "array<double>"), len(ALPHABET)
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = _bound(codes, lambda k: F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k) - 1), lambda x, y: F.get(ratios, x * a + y)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / (F.length(s) - 1)


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_BLOCK = 256


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Matches that keep(match, last group) holds for; positions are sums of what lies before.

    Arrays grow within blocks of _BLOCK matches, whose lengths are then summed,
    so that a text with many matches is not copied once for each of them.
    """
    n_groups = 2 if kind == 0 else 0
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(n_groups)).alias("tail"))

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"], x["tail"]), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPAN)
    block = lambda p, i: F.aggregate(F.slice(p, i, _BLOCK), F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    blocks = _bound(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(_BLOCK)), lambda i: block(p, i)))
    before = lambda bs: F.aggregate(F.slice(bs, 1, F.size(bs) - 1), F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
    moved = lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end")))
    all_of = _bound(blocks, lambda bs: F.flatten(F.zip_with(bs, before(bs), moved)))
    return F.when(text.rlike(pattern), all_of).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.35, table: str | None = None) -> DataFrame:
    """One row per document: doc_id, base and extra: arrays of (start, kind, end), kinds by their index in KINDS."""
    table = table or train(samples(docs.sparkSession))
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = rows.select("doc_id", "text", F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, lambda hit, tail: F.length(tail) >= 6), _spans(text, ACCESS, 1, lambda hit, tail: F.length(hit) >= 20), _spans(text, HEX, 2, lambda hit, tail: F.length(hit) >= 24)
    )).alias("base"))
    near = base.select("doc_id", "base", _spans(text, CANDIDATE, 3, lambda hit, tail: score(hit, table) > threshold).alias("more"))
    return near.select("doc_id", "base", F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))).alias("extra"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    found = scan(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_markov"))
