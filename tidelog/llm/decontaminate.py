"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted-shingle similarity.

Only Spark SQL expressions. All windows are fingerprinted that share a shingle with an item of their size; others have
a similarity of zero.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize

#: Words of a shingle; ``with_shingles`` is written for five.
WIDTH = 5
LEAST_SIMILARITY = 0.8
#: 64 bits in 8 blocks: fingerprints that differ in up to 23 bits have a block that differs in 2 at most.
BLOCKS, ERRORS = 8, 2
RADIUS = BLOCKS * (ERRORS + 1) - 1
#: Item shingles (about 40 bytes each) and the windows of texts (12 bytes each, and 40 a text) are broadcast up to so many
#: bytes; more are joined by a shuffle, with the same result.
MOST_BROADCAST = 20 << 20
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Bits that a count takes in a SimHash of up to so many shingles; four or two counts share a long.
LANES = ((16, 0xFFFF), (32, 0xFFFFFFFF))


def words_of(text: Column) -> Column:
    """Lower-cased words without ASCII punctuation; none for a null text."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_shingles(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds hashes of all WIDTH-word shingles, repeats included; of fewer words, of all of them together.

    Each word is hashed once; then two words' hashes, two such pairs', and those and a fifth word's are hashed together.
    """
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    after = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))
    n = F.size(words)
    out = df.withColumn("__one", F.transform(words, lambda w: F.xxhash64(w)))  # a column each, so that none is computed again for its elements
    out = out.withColumn("__two", both("__one", after("__one", 1)))
    out = out.withColumn("__four", both("__two", after("__two", 2)))
    out = out.withColumn("__five", both("__four", after("__one", 4)))
    some = F.when(n >= WIDTH, F.slice("__five", 1, F.greatest(n - WIDTH + 1, F.lit(1)))).when(n > 0, F.array(F.xxhash64("__one"))).otherwise(F.array().cast("array<long>"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), some.alias(name))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_simhash(df: DataFrame, hashes: str, name: str = "fp") -> DataFrame:
    """Adds the 64-bit SimHash of an array of hashes: a bit is set where over half have it. Arrays that overflow narrow counts are summed in wide ones."""
    n = F.size(hashes)

    def of(bits: int) -> Column:
        every = 64 // bits
        ones = F.lit(_signed(sum(1 << bits * i for i in range(every))))
        lane = lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: acc + F.shiftrightunsigned(x, k).bitwiseAND(ones))
        return F.array(*(lane(k) for k in range(bits)))

    def packed(sums: str, bits: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(bits):
            for lane in range(64 // bits):
                count = F.shiftrightunsigned(F.get(sums, F.lit(k)), bits * lane).bitwiseAND(F.lit((1 << bits) - 1))
                out = out.bitwiseOR(F.when(2 * count > n, F.lit(_signed(1 << bits * lane + k))).otherwise(F.lit(0)))
        return out

    (narrow, most), (wide, _) = LANES
    summed = df.withColumn("__sums", F.when(n <= most, of(narrow)).otherwise(of(wide)))
    return summed.select(*df.columns, F.when(n <= most, packed("__sums", narrow)).otherwise(packed("__sums", wide)).alias(name))


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(0xFF)).cast("int")


def window_keys(fp: Column) -> Column:
    return F.array(*((F.lit(i << 8) + _block(fp, i)) for i in range(BLOCKS)))


def item_keys(fp: Column) -> Column:
    """The blocks with every change of up to ERRORS bits."""
    changes = [sum(1 << b for b in bits) for n in range(ERRORS + 1) for bits in combinations(range(8), n)]
    near = lambda i: F.transform(F.array(*map(F.lit, changes)), lambda c: F.lit(i << 8) + _block(fp, i).bitwiseXOR(c))
    return F.flatten(F.array(*(near(i) for i in range(BLOCKS))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over the sum of the greater counts of each shingle in two sorted multisets."""
    times = lambda arr, h: F.size(F.filter(arr, lambda x: x == h))
    again = lambda arr: F.filter(arr, lambda x, i: (i > 0) & (F.get(arr, i - 1) == x))
    common = F.aggregate(F.array_intersect(again(a), again(b)), F.size(F.array_intersect(a, b)), lambda acc, h: acc + F.least(times(a, h), times(b, h)) - 1)
    return common / (F.size(a) + F.size(b) - common)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, mark, item_id, start, n_words, similarity``: the most similar window of each text for each item it leaks.

    A window has as many words as the item (a shorter text is one window). It leaks the item if their SimHashes
    differ in RADIUS bits at most and the weighted similarity of their shingles is LEAST_SIMILARITY or more; of
    equal windows the first is given. mark is a hash of the text; rows equal in id and text give one result.
    Null and word-less texts leak nothing, nor do such items and those without an id; null ids of texts stay null.
    Repeated items are one; an item id of two texts is two items. Without texts or items there are no rows.
    """
    item = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    item = with_simhash(with_shingles(item.select("item_id", "w", F.size("w").alias("len")), "w", "own").drop("w"), "own", "item_fp")
    item = materialize(item.withColumn("own", F.array_sort("own")).distinct(), "items")
    single = item.select("len", F.size("own").alias("m"), F.explode(F.array_distinct("own")).alias("h")).distinct()
    if 40 * single.count() <= MOST_BROADCAST:
        single = F.broadcast(single)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    placed = with_shingles(text.select("id", "mark", words_of(F.col("text")).alias("w")), "w", "all").select("id", "mark", F.size("w").alias("n"), F.posexplode_outer("all").alias("pos", "h"))  # not outer, a filter would compute all shingles twice
    hits = placed.join(single, "h")
    near = hits.groupBy("id", "mark", "n", "len", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # the windows around each hit, without those that the hit before gave
    last = F.greatest(F.col("n") - F.col("len"), F.lit(0))
    low = lambda p, i: F.greatest(p - F.col("m") + 1, F.when(i > 0, F.get("at", i - 1) + 1).otherwise(0), F.lit(0))
    runs = F.transform("at", lambda p, i: F.when(low(p, i) <= F.least(p, last), F.sequence(low(p, i), F.least(p, last))).otherwise(F.array().cast("array<int>")))
    starts = F.flatten(runs)
    windows = near.select("id", "mark", "len", F.explode(starts).alias("start")).distinct()
    of_text = materialize(windows.groupBy("id", "mark").agg(F.collect_list(F.struct("len", "start")).alias("windows")), "windows")
    of_text = of_text.select(F.col("id").alias("w_id"), F.col("mark").alias("w_mark"), "windows")
    held = of_text.agg(F.coalesce(F.sum(40 + 12 * F.size("windows")), F.lit(0)).alias("bytes")).first()["bytes"]
    if held <= MOST_BROADCAST:  # or else all texts are shuffled for a few
        of_text = F.broadcast(of_text)
    cut = text.join(of_text, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
    cut = with_shingles(cut.select("id", "mark", words_of(F.col("text")).alias("w"), "windows"), "w", "all").select("id", "mark", "all", F.explode("windows").alias("x"))
    part = F.slice("all", F.col("x.start") + 1, F.greatest(F.col("x.len") - WIDTH + 1, F.lit(1)))
    cut = with_simhash(cut.select("id", "mark", F.col("x.len").alias("len"), F.col("x.start").alias("start"), part.alias("part")), "part").dropDuplicates(["id", "mark", "len", "start"])
    cut = materialize(cut.withColumn("part", F.array_sort("part")), "fingerprinted")
    left = cut.select("id", "mark", "len", "start", "fp", F.explode(window_keys(F.col("fp"))).alias("key"))
    right = item.select("item_id", "len", "item_fp", F.explode(item_keys(F.col("item_fp"))).alias("key"))
    found = left.join(right, ["len", "key"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("id", "mark", "len", "start", "item_id").distinct()
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")) & (F.col("len") == F.col("c_len")) & (F.col("start") == F.col("c_start"))
    full = found.join(cut.select(F.col("id").alias("c_id"), F.col("mark").alias("c_mark"), F.col("len").alias("c_len"), F.col("start").alias("c_start"), "part"), same).join(item.select("item_id", F.col("len").alias("i_len"), "own"), "item_id").where("len = i_len")
    scored = full.select("id", "mark", "item_id", "start", F.col("len").alias("n_words"), weighted_similarity(F.col("own"), F.col("part")).alias("similarity")).where(F.col("similarity") >= LEAST_SIMILARITY)
    best = scored.groupBy("id", "mark", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    return best.select("id", "mark", "item_id", (-F.col("b.back")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    bad = leaks(docs, items, id_col, text_col, **columns).select(F.col("id").alias("__b_id"), F.col("mark").alias("__b_mark")).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__b_id")) & (F.xxhash64(text_col) == F.col("__b_mark")), "left_anti")


def op8_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The leaks: document, item, first word and words of the window, similarity."""
    return leaks(docs, items).select(F.col("id").alias("doc_id"), "item_id", "start", "n_words", "similarity")
