"""Benchmark decontamination by size-partitioned MinHash containment search, in Spark expressions only.

A test item with q distinct five-word shingles is contained in a document if at least ceil(t q) of them occur there. Its
sketch is its b smallest shingle hashes (a bottom-b MinHash), with b = q - ceil(t q) + 1. As at most b - 1 shingles of a
contained item may be missing, one of its b smallest must be in the document: no candidate is lost, however long the
document, and documents need no sketch of their own size. Items are partitioned by size, in powers of two: b and the
largest sketch hash follow q, so each partition has its own bound, and a document's hash is looked up only in those
partitions whose bound it does not pass. Candidates are then verified by the exact containment of shingle strings.

Scale. Documents' hashes pass a bit filter of fixed size, made from all sketches, before a row is made of any; what passes
is joined with the sketches on (partition, hash), by broadcast if they have at most ``BROADCAST_ROWS`` rows, as counted, and
by a shuffle of those narrow rows beyond that. The texts of candidates are then picked out by two hashes, in the same two
ways, and each distinct one is verified once, so a hot group of copies costs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwell.llm.common import checkpointed

SHINGLE, THRESHOLD = 5, 0.8
#: Bits of the filter, and rows that are sent to every task at most (24 bytes each).
FILTER_BITS, BROADCAST_ROWS = 17, 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    """A hash for each run of five words; of fewer words, one for all; of none, none."""
    n = F.size(w)
    return (
        F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])))
        .when(n > 0, F.array(F.xxhash64(F.lit(SHINGLE), F.concat_ws(" ", w))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def shingle_strings(w: Column) -> Column:
    n = F.size(w)
    return (
        F.when(n >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))))
        .when(n > 0, F.array(F.concat_ws(" ", w)))
        .otherwise(F.array().cast("array<string>"))
    )


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``item``, ``size_class``, ``hash``: the bottom-b sketch of each row of ``items`` (``item``, ``w``), b by its size."""
    q = F.size("h")
    least = F.ceil(q * threshold - 1e-9)
    return (
        items.select("item", F.array_distinct(shingle_hashes(F.col("w"))).alias("h"))
        .filter(q > 0)
        .select("item", F.floor(F.log2(q)).cast("int").alias("size_class"), F.slice(F.sort_array("h"), F.lit(1), (q - least + 1).cast("int")).alias("b"))
        .select("item", "size_class", F.explode("b").alias("hash"))
    )


def bit_filter(sketch: DataFrame) -> list[int]:
    """2^17 bits in 64-bit words: a bit is set if some sketch hash starts with its number. As long for any number of sketches."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = sketch.groupBy(F.floor(slot / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) % 64 as int))")).alias("bits"))
    out = [0] * (1 << FILTER_BITS - 6)
    for r in words.collect():  # a row for each word of the filter at most
        out[r["at"]] = r["bits"]
    return out


def _text_key(text: Column) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("k2")]


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows, to be sent to every task if that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_text_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered items; hits (``doc``, ``k1``, ``k2``, ``item``); and the verified (``k1``, ``k2``, ``item``, ``q``, ``shared``)."""
    numbered = checkpointed(items.withColumn("__item", F.monotonically_increasing_id()))
    of_item = numbered.select(F.col("__item").alias("item"), words(F.col(item_text_col)).alias("w"))
    sketch = checkpointed(sketches(of_item, threshold))
    classes = sketch.groupBy("size_class").agg(F.count("*").alias("n"), F.max("hash").alias("top")).collect()  # a row for each power of two
    bits = F.lit(bit_filter(sketch)).cast("array<bigint>")
    passes = lambda h: F.call_function("shiftright", F.get(bits, F.shiftrightunsigned(h, 70 - FILTER_BITS).cast("int")), (F.shiftrightunsigned(h, 64 - FILTER_BITS) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    text = F.col(text_col).cast("string")
    # in steps, so that Spark makes the words once and not for each use
    split = docs.select(F.col(id_col).alias("doc"), *_text_key(text), words(text).alias("w"))
    hashed = split.select("doc", "k1", "k2", shingle_hashes(F.col("w")).alias("h"))
    # explode_outer, as a filter on the hits would be pushed below and make Spark hash every document twice
    hits = hashed.select("doc", "k1", "k2", F.explode_outer(F.array_distinct(F.filter("h", passes))).alias("hash"))
    bounds = [F.struct(F.lit(r["size_class"]).alias("size_class"), F.lit(r["top"]).alias("top")) for r in classes]
    within = F.filter(F.array(*bounds), lambda x: x["top"] >= F.col("hash")) if bounds else F.array().cast("array<struct<size_class:int,top:bigint>>")
    hits = hits.withColumn("class", F.explode(within)).select("doc", "k1", "k2", "hash", F.col("class.size_class").alias("size_class"))
    found = checkpointed(hits.join(_sized(sketch, sum(r["n"] for r in classes)), ["size_class", "hash"]).select("doc", "k1", "k2", "item").distinct())
    asked = checkpointed(found.select("k1", "k2").distinct())
    texts = docs.select(*_text_key(text), text.alias("t")).join(_sized(asked, asked.count()), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("t").alias("t"))
    strings = of_item.select("item", shingle_strings(F.col("w")).alias("its"))
    shown = texts.withColumn("w", words(F.col("t"))).select("k1", "k2", shingle_strings(F.col("w")).alias("ds"))
    verified = (
        found.select("k1", "k2", "item")
        .distinct()
        .join(shown, ["k1", "k2"])
        .join(strings, "item")
        .select("k1", "k2", "item", F.size("its").alias("q"), F.size(F.array_intersect("its", "ds")).alias("shared"))
        .filter(F.col("shared") >= F.ceil(F.col("q") * threshold - 1e-9))
    )
    return numbered, found, checkpointed(verified)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col``, ``item_col``, ``n_shingles``, ``n_shared``, ``containment`` of every contained pair, once a pair.

    Null and empty texts, of documents or items, match nothing. Items of fewer than five words match only documents that
    hold just those words. Rows that share an id count as one document by their best containment, and so do items; a null
    id is an id. No documents or no items: no rows. Other columns are ignored.
    """
    numbered, found, verified = _matches(docs, items, id_col, text_col, item_text_col, threshold)
    both = found.join(verified, ["k1", "k2", "item"]).join(numbered.select(F.col("__item").alias("item"), F.col(item_col).alias("item_id")), "item")
    best = F.max(F.struct((F.col("shared") / F.col("q")).alias("containment"), "shared", "q")).alias("best")
    return (
        both.groupBy("doc", "item_id")
        .agg(best)
        .select(F.col("doc").alias(id_col), F.col("item_id").alias(item_col), F.col("best.q").alias("n_shingles"), F.col("best.shared").alias("n_shared"), F.col("best.containment").alias("containment"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text holds an item, each row judged by its own text, whatever its id.

    Rows with null or empty texts stay, and so does every row if there are no items. Columns and repeated rows stay as
    they are. The texts to drop are sent to every task if they are at most ``BROADCAST_ROWS``, as counted.
    """
    held = checkpointed(_matches(docs, items, id_col, text_col, item_text_col, threshold)[2].select("k1", "k2").distinct())
    k1, k2 = _text_key(F.col(text_col).cast("string"))
    longer = max(map(len, docs.columns)) * "_"  # a name that no column has
    keyed = docs.select("*", k1.alias(f"k1{longer}"), k2.alias(f"k2{longer}"))
    dropped = held.select(F.col("k1").alias(f"k1{longer}"), F.col("k2").alias(f"k2{longer}"))
    return keyed.join(_sized(dropped, held.count()), [f"k1{longer}", f"k2{longer}"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
