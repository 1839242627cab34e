"""Benchmark decontamination with spaced seeds: overlaps are found although words were replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Which of the following tokens a seed reads, from its place on; the others may differ. Together they
#: hit every window of 20 tokens with up to 2 replaced and of 10 to 19 with up to 1, however these lie.
MASKS = [(0, 1, 3, 4, 5, 6, 8), (0, 1, 2, 3, 5, 6, 7)]
#: Items with fewer tokens than this are looked for whole and exactly.
SHORT = 10
WINDOW = 20
#: Beyond so many bytes of seeds and item texts nothing is broadcast.
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def one_mask(hashes: Column, salt: int, mask) -> Column:
    return F.transform(hashes, lambda h, i: F.xxhash64(F.lit(salt), *(F.get(hashes, i + x) for x in mask)))


def seeds(hashes: Column, masks: list[tuple[int, ...]], first: int = 0) -> Column:
    """For each mask in turn, the seed at every place of the text."""
    each = [one_mask(hashes, k, m) for k, m in enumerate(masks, first)]
    return F.concat(*each) if len(each) > 1 else each[0]


def item_seeds(items: DataFrame) -> DataFrame:
    """Seeds of the benchmark items that have a whole mask or, for short ones, all their tokens under them."""
    whole = items.select("item_id", tokens(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    whole = whole.withColumns({"h": F.transform("item_words", lambda w: F.xxhash64(w)), "n": F.size("item_words")})
    spaced = whole.where(f"n >= {SHORT}").select("*", F.posexplode(seeds(F.col("h"), MASKS)).alias("at", "seed"))
    reach = F.element_at(F.array(*(F.lit(m[-1]) for m in MASKS)), (F.col("at") / F.col("n")).cast("int") + 1)
    spaced = spaced.withColumn("item_at", F.col("at") % F.col("n")).where(F.col("item_at") + reach < F.col("n"))
    short = whole.where(f"n < {SHORT}").select("*", F.lit(0).alias("item_at"), whole_seed(F.col("h")).alias("seed"))
    names = ["seed", "item_id", "item_words", "item_at"]
    return spaced.select(*names).unionByName(short.select(*names))


def whole_seed(h: Column) -> Column:
    """One seed for all tokens of a short item: its length tells the mask."""
    return F.xxhash64((F.size(h) + len(MASKS)).cast("int"), *(F.get(h, F.lit(i)) for i in range(SHORT)))


def best_window(flags: Column, n: Column) -> Column:
    """The most matches in a window of `n` tokens."""
    starts = F.sequence(F.lit(1), F.size(flags) - n + 1)
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(flags, s, n), F.lit(0), lambda a, x: a + x)))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of documents and benchmark items that share a window of WINDOW tokens (a shorter item:
    all of it) with at most one in ten replaced, over whole texts and all rows.

    docs: doc_id, text; items: item_id, text; other columns are not looked at. Result: doc_id,
    item_id, item_tokens, best_matched (tokens equal in the best window), n_aligned (equal tokens of
    the best alignment over the whole item), n_places (alignments that qualify).
    Null or empty texts match nothing; pairs of rows with null ids keep the null; rows that repeat
    a doc_id or item_id are reported together; no item or no document gives an empty result.
    The seeds of the items are broadcast while they are small, and shuffled beyond BROADCAST_BYTES:
    the same rows either way.
    """
    wanted = item_seeds(items.select("item_id", "text"))
    size = items.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b"), F.max(F.octet_length(F.col("text").cast("string"))).alias("m")).first()
    # every place of an item holds its whole words, so a seed row is at most one text long
    small = (size.b or 0) * ((size.m or 0) + 64) * len(MASKS) / 4 <= BROADCAST_BYTES
    lengths = [r.n for r in items.select(F.size(tokens(F.col("text"))).alias("n")).where(f"n > 0 and n < {SHORT}").distinct().collect()]  # at most SHORT - 1 rows
    words = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    hashed = words.select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    masks = seeds(F.col("h"), [*MASKS])
    for n in sorted(lengths):
        masks = F.concat(masks, one_mask(F.col("h"), n + len(MASKS), range(n)))
    # The outer form keeps the optimizer from adding a filter that works every seed out once more;
    # the texts stay behind, as each exploded row would copy them.
    placed = hashed.select("doc_id", F.size("h").alias("n"), masks.alias("seeds")).select("doc_id", "n", F.posexplode_outer("seeds").alias("at", "seed"))
    hits = placed.join(F.broadcast(wanted) if small else wanted, "seed")
    start = (F.col("at") % F.col("n")) - F.col("item_at")
    hits = hits.select("doc_id", "item_id", "item_words", start.alias("start")).distinct().withColumnRenamed("doc_id", "__doc")
    flags = F.transform("item_words", lambda x, j: F.coalesce(F.get("words", F.col("start") + j) == x, F.lit(False)).cast("int"))
    needed = F.col("w") - F.floor(F.col("w") / 10)
    found = (
        words.join(hits.hint("shuffle_hash"), hits["__doc"].eqNullSafe(words["doc_id"]))
        .select("doc_id", "item_id", F.size("item_words").alias("item_tokens"), "start", flags.alias("flags"))
        .withColumns({"w": F.least(F.lit(WINDOW), F.col("item_tokens")), "n_aligned": F.aggregate("flags", F.lit(0), lambda a, x: a + x)})
        .where(F.col("n_aligned") >= needed)
        .withColumn("best_matched", best_window(F.col("flags"), F.col("w")))
        .where(F.col("best_matched") >= needed)
        .select("doc_id", "item_id", "item_tokens", "start", "n_aligned", "best_matched")
        .distinct()
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.max("item_tokens").cast("long").alias("item_tokens"),
        F.max("best_matched").cast("long").alias("best_matched"),
        F.max("n_aligned").cast("long").alias("n_aligned"),
        F.count("*").alias("n_places"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item was found in, unchanged. A row with a null doc_id has no
    identity to be judged by its text alone, so it is matched null-safe: it goes if any such row matched."""
    found = contaminated(docs, items).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__doc"]), "left_anti")
