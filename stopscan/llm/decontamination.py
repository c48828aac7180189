"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask is a row of 1s and 0s laid over consecutive tokens: tokens under a 1 are hashed together,
tokens under a 0 are ignored, so a substitution there leaves the hash as it was. Hashes of all test
windows and of all document windows are joined, and every hit fixes a diagonal (where the item
would start in the document). A bitmap of the test seeds keeps windows that meet none of them from
becoming rows at all; it decides nothing else. Around it the two token rows are compared position by position: the
document is contaminated by the item if some `WINDOW` aligned tokens differ in at most
`SUBSTITUTIONS` places. The default mask has a hit in every such window, wherever the substitutions stand (checked in the
tests by going through all placements), so the join loses none; further masks may be added.

Defined results: tokens are maximal runs of letters and digits of the lower-cased text. A null or
empty text has no token and matches nothing. An item of fewer tokens than `WINDOW` must occur
whole and unchanged; one shorter than a mask is told from chance only where it is the whole
document, token for token.
Repeated rows of one id count as one document; a null id is an id of its own. An empty table on
either side gives an empty result. Further columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import if_small, keep_rows, keyed_rows, settle, table

MASKS = ("11010011",)
#: The bitmap of test seeds has at most 2 to this power bits; a fuller one only passes more windows
#: on to the join.
BITMAP_BITS = 22
WINDOW = 13
SUBSTITUTIONS = 2


def token_hashes(text: str = "text") -> Column:
    """64-bit hashes of the tokens, in order."""

    words = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def window_seeds(hashes: Column, masks: tuple[str, ...], known: Column | None = None,
                 bits: int = 0) -> Column:
    """(at, seed) of every window under every mask, or of those whose bit is set in `known`."""

    span = len(masks[0])

    def seed(row: Column, at: Column, number: int) -> Column:
        kept = [k for k, c in enumerate(masks[number]) if c == "1"]
        return F.xxhash64(F.lit(number), *[F.get(row, at + k if k else at) for k in kept])

    def under(row: Column, number: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(row) - span)
        if known is not None:
            starts = F.filter(starts, lambda i: is_known(seed(row, i, number), known, bits))
        return F.transform(starts, lambda i: F.struct(
            i.alias("at"), seed(row, i, number).alias("seed")))

    whole = F.transform(F.array(hashes), lambda row: F.when(
        F.size(row) >= span, F.concat(*[under(row, n) for n in range(len(masks))])))
    return F.get(whole, F.lit(0))


def is_known(seed: Column, known: Column, bits: int) -> Column:
    """Whether the bit a seed's leading `bits` bits name is set in an array of 64-bit words."""

    return F.getbit(F.get(known, F.shiftrightunsigned(seed, 70 - bits).cast("int")),
                    F.shiftrightunsigned(seed, 64 - bits).bitwiseAND(F.lit(63)).cast("int")) == 1


def known_bits(planted: DataFrame, bits: int) -> DataFrame:
    """One row: the bitmap of all test seeds, as 64-bit words in order."""

    spark = planted.sparkSession
    words = planted.groupBy(F.shiftrightunsigned("seed", 70 - bits).alias("id")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))"))
        .alias("word"))
    return spark.range(1 << (bits - 6)).join(words, "id", "left").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))),
        lambda x: x["word"]).alias("known"))


def seeds(rows: DataFrame, key: str, masks: tuple[str, ...], place: str,
          known: Column | None = None, bits: int = 0) -> DataFrame:
    """(key, seed, place): the seeds of every row and the token each starts at."""

    hashed = rows.select(key, token_hashes().alias("h"))
    if known is not None:
        hashed = hashed.withColumn("known", known)
        known = F.col("known")
    return hashed.select(key, F.explode(window_seeds(F.col("h"), masks, known, bits)).alias(
        "s")).select(key, F.col("s.seed").alias("seed"), F.col("s.at").alias(place))


def best_window(near: Column, item: Column, window: Column) -> Column:
    """Most agreeing positions in any `window` aligned tokens; null if fewer are aligned.

    `near` is the stretch of the document and `item` that of the item, position by position.
    """

    equal = F.zip_with(near, item, lambda a, b: F.when(a == b, 1).otherwise(0))
    best = F.transform(F.array(equal), lambda e: F.array_max(F.transform(
        F.sequence(F.lit(1), F.size(near) - window + 1),
        lambda i: F.aggregate(F.slice(e, i, window), F.lit(0), lambda s, x: s + x))))
    return F.when(F.size(near) >= window, F.get(best, F.lit(0)))


def if_measured(rows: DataFrame) -> DataFrame:
    """`rows` marked for broadcast if their token rows `t`, added up, fit the bound."""

    size = rows.agg(F.sum(F.size("t").cast("bigint") * 8 + 96)).first()[0] or 0
    return if_small(rows, size, 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS,
                 window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, item_id, agreeing, compared): one row per contaminated document and item.

    `agreeing` is the most equal positions among `compared` aligned tokens.
    """

    if len({len(m) for m in masks}) != 1:
        raise ValueError("masks must have one span")
    items, _ = settle(benchmark.select("item_id", "text").distinct(), "items")
    planted = seeds(items, "item_id", masks, "from_item")
    planted, _ = settle(planted, "seeds")
    number = planted.count()
    lookup = if_small(planted.withColumnRenamed("seed", "item_seed"), number, 100)
    bits = min(max(12, (16 * number).bit_length()), BITMAP_BITS)
    known = known_bits(planted, bits).scalar()
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    hits, _ = settle(
        seeds(texts, "doc_id", masks, "from_doc", known, bits)
        .join(lookup, F.col("seed") == F.col("item_seed"))
        .select("doc_id", "item_id", (F.col("from_doc") - F.col("from_item")).alias("diagonal"))
        .distinct(), "hits")
    tokens, _ = settle(items.select(F.col("item_id").alias("__item"),
                                    token_hashes().alias("t")).where(F.size("t") > 0), "tokens")
    wanted = hits.join(if_measured(tokens), F.col("item_id").eqNullSafe(F.col("__item"))).select(
        F.col("doc_id").alias("hit_doc"), "item_id", "diagonal", "t")
    holders = hits.select(F.col("doc_id").alias("hit_doc")).distinct()
    hashed = texts.join(if_small(holders, hits.count(), 16),
                        F.col("doc_id").eqNullSafe(F.col("hit_doc")), "left_semi").select(
        "doc_id", token_hashes().alias("h"))
    first = F.greatest(F.lit(0), -F.col("diagonal"))
    length = F.least(F.size("t"), F.size("h") - F.col("diagonal")) - first
    compared = hashed.join(
        if_measured(wanted), F.col("doc_id").eqNullSafe(F.col("hit_doc"))).where(
        length >= F.least(F.lit(window), F.size("t"))).select(
        "doc_id", "item_id", F.size("t").alias("n_item"),
        F.slice("h", first + F.col("diagonal") + 1, length).alias("near"),
        F.slice("t", first + 1, length).alias("aligned")).select(
        "doc_id", "item_id", "n_item",
        best_window(F.col("near"), F.col("aligned"), F.least(F.lit(window), F.col("n_item")))
        .alias("agreeing"))
    need = F.least(F.lit(window), F.col("n_item"))
    allowed = F.when(F.col("n_item") >= window, substitutions).otherwise(0)
    found = compared.where(F.col("agreeing") >= need - allowed).select(
        "doc_id", "item_id", "agreeing", need.alias("compared"))
    span = len(masks[0])
    short, _ = settle(tokens.where(F.size("t") < span), "short-items")
    if short.count():
        equal = texts.select("doc_id", token_hashes().alias("h")).where(F.size("h") < span).join(
            if_measured(short), F.col("h") == F.col("t"))
        found = found.unionByName(equal.select(
            "doc_id", F.col("__item").alias("item_id"), F.size("t").alias("agreeing"),
            F.size("t").alias("compared")))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("agreeing").cast("int").alias("agreeing"),
        F.max("compared").cast("int").alias("compared"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark passage; of an id with two texts each by itself."""

    found, _ = settle(contaminated(keyed_rows(docs), table(spark, folder, "benchmark")).select(
        F.col("doc_id").alias("key")), "leaks")
    return keep_rows(docs, found)
