"""Tables laid out for the joins and searches that read them often: buckets on a key (SNK-1), posting lists of an id (FN-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
PARTS = 64


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """Write ``df`` as a catalog table in ``path``, bucketed and sorted by ``key``, one file per bucket. Tables with equal bucket
    counts join and group on the key without a shuffle. For keys with few rows each (an invoice's payments): a hot key
    fills its bucket."""
    spread = df.repartition(buckets, key)
    spread.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def grams(text):
    """The distinct runs of ``GRAM`` characters of a lower-cased text; a shorter text is one itself."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(runs)).otherwise(F.array(low))


def save_searchable(rows: DataFrame, folder: str, column: str = "customer_id", parts: int = PARTS) -> None:
    """Write ``rows`` in partitions by a hash of ``column``, and posting lists: for every gram the ids that hold it and their
    partitions. Both are dealt by ranges, so a frequent id or gram fills several files."""
    part = F.pmod(F.xxhash64(F.lower(column)), F.lit(parts)).cast("int")
    placed = rows.withColumn("__part", F.when(F.col(column).isNotNull(), part))
    placed.repartitionByRange("__part", F.xxhash64(*rows.columns)).write.partitionBy("__part").parquet(f"{folder}/rows")
    ids = rows.where(F.col(column).isNotNull()).select(F.lower(column).alias("id")).distinct()
    lists = ids.select("id", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(grams(F.col("id"))).alias("gram"))
    lists = lists.withColumn("gram_part", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int"))
    lists.repartitionByRange("gram_part", "gram", "id").sortWithinPartitions("gram_part", "gram", "id").write.partitionBy("gram_part").parquet(f"{folder}/grams")


def matching_ids(spark: SparkSession, folder: str, term: str, parts: int = PARTS) -> DataFrame:
    """(id, part) of the lower-cased ids that hold ``term``: the posting lists of its grams, intersected, then verified. Terms
    shorter than a gram take the lists of all grams that hold them."""
    term = term.lower()
    lists = spark.read.schema("id string, part int, gram string, gram_part int").parquet(f"{folder}/grams")
    if len(term) < GRAM:
        return lists.where(F.col("gram").contains(term)).select("id", "part").distinct()
    asked = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
    places = spark.createDataFrame([(g,) for g in asked], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int")).distinct().collect()
    found = lists.where(F.col("gram_part").isin([p[0] for p in places]) & F.col("gram").isin(asked))
    all_grams = found.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked))
    return all_grams.where(F.col("id").contains(term)).select("id", "part")


def search(spark: SparkSession, folder: str, schema, term: str, column: str = "customer_id", parts: int = PARTS) -> DataFrame:
    """The rows whose ``column`` holds ``term`` (any case); only partitions with a matching id are read. ``schema`` is that of the
    rows that were saved."""
    rows = spark.read.schema(f"{schema.simpleString()[7:-1]}, __part int".replace(":", " ")).parquet(f"{folder}/rows")
    if not term:
        return rows.drop("__part")
    hit = [r.part for r in matching_ids(spark, folder, term, parts).select("part").distinct().collect()]  # at most ``parts``
    return rows.where(F.col("__part").isin(hit)).where(F.lower(column).contains(term.lower())).drop("__part")

