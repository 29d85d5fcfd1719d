"""Benchmark decontamination by size-partitioned MinHash containment search.

DataFrame functions only. Test items are partitioned by their number of shingles n, in
powers of two. A document that holds a share of ``threshold`` of them misses at most
e = n - ceil(threshold * n). So of an item's e + k smallest shingle hashes it shares at
least k: these are the item's sketch, k what a candidate must share, and nothing is ever
missed, whatever the size. k is ``SPARE`` and a ``SPARE_SHARE`` of the class's smallest n
more, so that long items ask for more than a few common shingles. Each size class is
searched on its own: a document's shingle is looked up in the classes whose largest
sketched hash it does not exceed, and only if the document has as many shingles as the
class's smallest item must share; sketches are joined by class and hash.

The sketches are broadcast if there are at most ``BROADCAST_ROWS`` of them; beyond, the
same join shuffles. Document shingles are hashed and probed within one stage of
generated code, added up by document before the one small shuffle.

Defined results: A-Z count as a-z; words are runs of bytes other than 0x20 and
0x09-0x0D; texts of fewer words than a shingle have their whole word sequence as only
shingle; null and wordless texts have none and never match; documents are told apart
by id and text, so repeated rows report one pair, and rows with equal ids one each for
each text that matches; the same holds for a null id, and for items likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

SHINGLE, THRESHOLD, SPARE, SPARE_SHARE = 5, 0.8, 3, 1 / 16
#: Sketch rows (three numbers each) that are broadcast at most.
BROADCAST_ROWS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    """The lower-cased words; [''] if there are none."""
    return F.split(F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(SPACES)), "[\\x20\\x09-\\x0D]+")


def shingles(rows: DataFrame, text: Column, size: int, *keep: str) -> DataFrame:
    """One row for each place of a shingle in each row: the columns ``keep``, shingle."""
    cut = rows.select(*keep, word_array(text).alias("_words")).where(F.col("_words")[0] != "")
    places = F.sequence(F.lit(1), F.greatest(F.size("_words") - (size - 1), F.lit(1)))
    return cut.select(*keep, "_words", F.explode(places).alias("_i")).select(*keep, F.concat_ws(" ", F.slice("_words", F.col("_i"), size)).alias("shingle"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item_key, item_id, shingle, hash, n): the distinct shingles of each item and their
    number. item_key tells items with other ids or texts apart."""
    keyed = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"), row_key(item_id, text).alias("item_key"))
    own = shingles(keyed, F.col("text"), size, "item_key", "item_id").distinct()
    return own.select("item_key", "item_id", "shingle", F.xxhash64("shingle").alias("hash"), F.count("*").over(W.partitionBy("item_key")).alias("n"))


def sketches(own: DataFrame, threshold: float) -> DataFrame:
    """(item_key, hash, need, size, n): each item's smallest hashes, the number of them to
    share, the item's size class and number of shingles."""
    rank = F.row_number().over(W.partitionBy("item_key").orderBy("hash", "shingle"))
    missed = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)
    spare = F.floor(F.pow(F.lit(2.0), F.col("size")) * SPARE_SHARE) + SPARE
    least = own.withColumn("size", F.floor(F.log2("n")).cast("int")).select("item_key", "hash", "n", "size", rank.alias("rank"), missed.alias("missed"), F.least(missed + spare, F.col("n")).alias("kept"))
    return least.where("rank <= kept").select("item_key", "hash", (F.col("kept") - F.col("missed")).cast("int").alias("need"), "size", "n")


def looked_up(docs: DataFrame, text: Column, sketch: DataFrame, size: int, threshold: float) -> DataFrame:
    """(doc_key, hash, size): the places of shingles of ``docs``, in each size class that
    they can match. The classes (one for each power of two) go through the driver."""
    bounds = sketch.groupBy("size").agg(F.max("hash").alias("bound"), F.min("n").alias("least")).collect()
    if not bounds:
        return docs.limit(0).select("doc_key", F.lit(0).cast("long").alias("hash"), F.lit(0).alias("size"))
    # shingles of a document, counted with repeats: no fewer than its distinct ones
    places = F.greatest(F.size(word_array(text)) - (size - 1), F.lit(1))
    hashes = shingles(docs.withColumn("places", places), text, size, "doc_key", "places").select("doc_key", "places", F.xxhash64("shingle").alias("hash"))
    fits = [F.when((F.col("hash") <= F.lit(b["bound"])) & (F.col("places") >= F.lit(b["least"] * threshold - 1e-9)), F.lit(b["size"])) for b in sorted(bounds)]
    below = hashes.where(F.col("hash") <= F.lit(max(b["bound"] for b in bounds)))
    return below.select("doc_key", "hash", F.explode(F.array(*fits)).alias("size")).where("size IS NOT NULL")


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_key, doc_id, item_id, n_shared, n_shingles, containment) of the pairs in
    which the document holds at least ``threshold`` of the item's distinct shingles.
    doc_key tells rows with other texts apart; so are items, by a key of their own."""
    own = materialize(item_shingles(items, item_id, item_text, size), "items")
    sketch = materialize(sketches(own, threshold), "sketches")
    text = F.col(f"`{doc_text}`")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text.alias("text"), row_key(doc_id, doc_text).alias("doc_key"))
    probed = looked_up(keyed, F.col("text"), sketch, size, threshold).join(sized(sketch.drop("n"), sketch.count()), ["size", "hash"])
    candidates = probed.groupBy("doc_key", "item_key").agg(F.count("*").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("doc_key", "item_key")
    candidates = materialize(candidates, "candidates")
    held = keyed.join(candidates.select("doc_key").distinct(), "doc_key").dropDuplicates(["doc_key"])
    exact = shingles(held, F.col("text"), size, "doc_key", "doc_id").distinct()
    shared = exact.join(candidates, "doc_key").join(sized(own.drop("hash"), own.count()), ["item_key", "shingle"])
    counted = shared.groupBy("doc_key", "item_key").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.count("*").alias("n_shared"), F.first("n").alias("n_shingles"))
    out = counted.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold)
    return out.select("doc_key", "doc_id", "item_id", "n_shared", "n_shingles", "containment")


def row_key(row_id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{row_id}`"), F.col(f"`{text}`"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    found = materialize(contained_items(docs, items, doc_id, doc_text, **options).select("doc_key").distinct(), "contaminated")
    key = "_doc_key"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, row_key(doc_id, doc_text)).join(found.withColumnRenamed("doc_key", key), key, "left_anti").drop(key)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), bs AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), n AS (
  SELECT id, count(*) AS n FROM bs GROUP BY id
), c AS (
  SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2
)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_shingles, CAST(n_shared AS DOUBLE) / CAST(n AS DOUBLE) AS containment
FROM c JOIN n ON c.item_id = n.id WHERE CAST(n_shared AS DOUBLE) / CAST(n AS DOUBLE) >= 8e-1
"""
