"""Secret scans: three fixed patterns, and random strings told from identifiers by character Markov models.

Everything runs as Spark SQL expressions. Positions come from cutting a text at a pattern's matches: the lengths
of the pieces between matches and of the matches themselves add up to code-point offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind, pattern, group whose length counts, least length; in the order in which ties are listed.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Cheap test that a text has a match that counts.
MAYBE = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: The same matches that count, without the many that don't: a longest run of 16 or more is one match either way.
SAME = {"hex": r"[0-9a-f]{16,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of the Markov chains; all others count as the last state.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Spans that an array holds before another one is begun, as to append copies an array.
CHUNK = 200
#: A candidate is a secret if its log-likelihood ratio is above the first, and above the second a transition.
LEAST_RATIO, LEAST_RATE = 12.0, 0.5
#: Words of which sample identifiers are made.
WORDS = (
    "account action active address admin after agent align amount array async average backend balance base batch before begin block body boolean branch buffer build button cache calendar call cancel center change channel char "
    "check child class clean clear click client clock close cluster code column command commit common compare complete config connect const container content context control convert copy count create current cursor customer data date "
    "default delete description destination detail device dictionary direct disable display document domain double download driver duration editor element empty enable encode engine entry error event example execute export external "
    "factory failure feature field file filter final finish first flag folder font format forward frame from function gateway general generate global graph group handle handler hash header height helper history host icon identifier "
    "image import index info init inner input insert instance integer interface internal interval item iterator join keyboard label language last layout length level library limit line link list listener load local lock logger "
    "machine main manager mapping margin master match maximum member memory menu merge message method middle minimum mode model module monitor month mouse move multiple name network next node normal notification number object offset "
    "option order origin output owner package page panel parameter parent parse partition path pattern payment percent period permission picture plain player plugin point policy port position prefix previous price primary print "
    "process product profile program project property protocol provider public query queue quick random range rate reader receive record reference region register release remote remove render repeat replace report request require "
    "reset resource response result return right root route rule runtime sample scale schedule schema scope screen script scroll search section select sender sequence server service session setting shadow shape share short signal "
    "simple single size snapshot source space spring stack standard start state static status step storage store stream string style submit success suffix support switch symbol sync system table target task template test text theme "
    "thread time title toggle tool total trace track transaction transfer transform tree trigger type union unique unit update upload user utility valid value variable vector version video view visible volume wait warning watch "
    "window worker wrapper write zone that with have this will your which their would there could other about these than into only some most over such time these mente cion idad esta para como pero nuestro entre sobre todos aussi "
    "dans pour avec sont cette leurs tout faire nous vous etre plus comme mais elle ment tion eaux nicht auch einer eine wird sich sind noch werden haben einen dieser ung keit lich heit schaft ver"
)


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``text, secret``: n labelled strings, half of them random, made by a rule from digests of counters.

    Random: cuts of base64 and hex digests and of their mixed-case alphanumerics. Ordinary: two to four words
    joined as snake_case, kebab-case, camelCase, path/like or plain.
    """
    words = F.array(*(F.lit(w) for w in WORDS.split()))
    draw = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    raw = F.base64(F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)))
    pick = F.pmod(F.xxhash64("id"), F.lit(10))
    random = F.when(pick < 3, F.regexp_replace(raw, "[+/=]", "")).when(pick < 5, F.translate(raw, "+/", "-_")).when(pick < 9, raw).otherwise(F.sha2(raw, 256))
    random = F.substring(random, F.lit(1), (F.lit(20) + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(40))).cast("int"))
    few = F.slice(F.array(*(draw(k) for k in range(6))), 1, (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) + 3).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(8))
    camel = F.array_join(F.transform(few, F.initcap), "")
    join = lambda sep: F.array_join(few, sep)
    numbered = F.concat(join("_"), F.pmod(F.col("id"), F.lit(2030)).cast("string"))
    plain = F.when(style < 1, join("_")).when(style < 2, join("-")).when(style < 3, camel).when(style < 4, join("/")).when(style < 5, numbered).when(style < 6, F.upper(join("_"))).otherwise(join(""))
    secret = F.col("id") % 2 == 0
    return spark.range(n).select(F.when(secret, random).otherwise(plain).alias("text"), secret.alias("secret"))


def _states(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(STATES - 1))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, row by row: of the chain of the secret samples to that of the others.

    Counts are a distributed aggregate; the result has STATES squared numbers however many samples there are.
    """
    moves = samples.where("text is not null and secret is not null").select("secret", _states(F.col("text")).alias("s")).select("secret", F.explode(F.zip_with(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 2, F.size("s")), lambda a, b: a * STATES + b)).alias("move"))
    n = {True: [smooth] * STATES**2, False: [smooth] * STATES**2}
    for r in moves.groupBy("secret", "move").agg(F.count("*").alias("n")).collect():  # 2 * STATES**2 rows at most
        n[r["secret"]][r["move"]] += r["n"]
    total = {k: [sum(v[i * STATES : (i + 1) * STATES]) for i in range(STATES)] for k, v in n.items()}
    return [math.log(n[True][m] / total[True][m // STATES]) - math.log(n[False][m] / total[False][m // STATES]) for m in range(STATES**2)]


def _spans(text: Column, kind: int, pattern: str, counts: Column | None = None, least: int = 0) -> Column:
    """Array of (start, kind, end) of a pattern's leftmost matches whose ``counts`` group has ``least`` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    own = F.zip_with(F.zip_with(F.transform(F.split(text, pattern, -1), F.length), F.transform(found, F.length), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n"))), found if counts is None else counts, lambda g, c: F.struct(g["gap"].alias("gap"), g["n"].alias("n"), F.length(c).alias("c")))
    none = lambda kind: F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        counts, full = x["c"] >= least, F.size(acc["chunk"]) >= CHUNK
        span = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).cast("int").alias("end"))
        chunk = F.when(~counts, acc["chunk"]).when(full, F.array(span)).otherwise(F.array_append(acc["chunk"], span))
        chunks = F.when(counts & full, F.array_append(acc["chunks"], acc["chunk"])).otherwise(acc["chunks"])
        return F.struct((start + x["n"]).alias("at"), chunk.alias("chunk"), chunks.alias("chunks"))

    cut = F.filter(own, lambda x: x["n"].isNotNull())  # the piece after the last match has no match
    begin = F.struct(F.lit(0).alias("at"), none(SPANS).alias("chunk"), none(f"array<{SPANS}>").alias("chunks"))
    return F.aggregate(cut, begin, step, lambda acc: F.flatten(F.array_append(acc["chunks"], acc["chunk"])))


def _or_none(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(SPANS))


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``base`` and ``added``, arrays of (start, kind, end) sorted by start and kind.

    kind numbers BASE from 0; the Markov spans of ``added`` have the next number. Offsets count code points, the
    end exclusive. ``ratios`` is what ``train`` returns (default: for ``default_samples``). A candidate run of the
    alphabet's characters is added if its ratio passes both limits, it has a digit or both letter cases, and it
    overlaps no base span. Null and empty texts have no spans; rows and their repeats stay.
    """
    if ratios is None:
        ratios = train(default_samples(docs.sparkSession))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    kinds = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        pattern = SAME.get(kind, pattern)
        kinds.append(_or_none(text.rlike(MAYBE[kind]), _spans(text, k, pattern, F.regexp_extract_all(text, F.lit(pattern), group) if group else None, least)))
    table = F.array(*(F.lit(round(x, 4)) for x in ratios))
    rate = lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, (F.get(s, i - 1) * STATES + F.get(s, i) + 1).cast("int")))
    mixed = lambda t: t.rlike("[0-9]") | (t.rlike("[a-z]") & t.rlike("[A-Z]"))
    random = lambda t: mixed(t) & (rate(_states(t)) > F.greatest(F.lit(LEAST_RATIO), LEAST_RATE * (F.length(t) - 1)))
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    judged = F.transform(found, lambda t: F.when(random(t), F.lit("x")).otherwise(F.lit("")))
    markov = _or_none(text.rlike(CANDIDATE), _spans(text, len(BASE), CANDIDATE, judged, 1))
    spans = rows.select("id", F.array_sort(F.concat(*kinds)).alias("base"), markov.alias("markov"))
    clear = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    return spans.select("id", "base", F.filter("markov", clear).alias("added"))


def op6_query(docs: DataFrame) -> DataFrame:
    """The contract's columns; a null text has no spans, repeated rows are repeated, an empty table gives an empty one."""
    names = F.array(*(F.lit(kind) for kind, *_ in BASE), F.lit("markov"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find_secrets(docs).select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(line(F.col("base")), "UTF-8"), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
