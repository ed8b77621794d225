"""Substring lookup by an index of three-letter pieces: candidates first, then the test itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a piece; files that pieces are dealt to.
PIECE, FILES = 3, 32
#: Candidates that go to all tasks, at most, so that texts stay where they are.
MOST_SENT = 1_000_000


def pieces(text: Column) -> Column:
    """The different pieces of a text in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.when(F.length(low) >= PIECE, F.sequence(F.lit(1), F.length(low) - PIECE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, PIECE)))


class Index:
    """Postings (piece, id) and texts (key, text, id) below a path.

    id is a hash of the text, so equal texts have one posting for each piece, however
    many keys they have; what else has the same id is ruled out by the test itself.
    Postings are dealt by piece to FILES folders and sorted in each, so a lookup
    reads the folders of its pieces and the row groups that hold them.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str):
        self.spark, self.path = spark, path
        self.postings = spark.read.schema("piece string, id long, file int").parquet(f"{path}/postings")
        self.texts = spark.read.schema(f"key {key_type}, text string, id long").parquet(f"{path}/texts")

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str) -> Index:
        """Null keys can't be found; a key with several texts is found by each."""
        spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
        x = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        x.withColumn("id", F.xxhash64("text")).write.parquet(f"{path}/texts")
        # df is worked out once; what follows reads its texts
        texts = spark.read.schema(f"key {kind}, text string, id long").parquet(f"{path}/texts").select("id", "text").distinct()
        each = texts.select(F.explode_outer(pieces(F.col("text"))).alias("piece"), "id").filter("piece is not null")
        each = each.withColumn("file", cls._file(F.col("piece")))
        # pieces that many texts hold are dealt to several tasks by id
        dealt = each.repartition("file", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("file", "piece", "id")
        dealt.write.partitionBy("file").parquet(f"{path}/postings")
        return cls(spark, path, kind)

    @staticmethod
    def _file(piece: Column) -> Column:
        return F.pmod(F.xxhash64(piece), F.lit(FILES)).cast("int")

    def candidates(self, needle: str) -> DataFrame | None:
        """Ids of the texts that hold all pieces of the needle; None if it is too short to have any."""
        low = needle.lower()
        found = sorted({low[i : i + PIECE] for i in range(len(low) - PIECE + 1)})
        if not found:
            return None
        files = self.spark.createDataFrame([(p,) for p in found], "piece string").select(self._file(F.col("piece")).alias("f")).distinct().collect()
        hits = self.postings.filter(F.col("file").isin([r.f for r in files]) & F.col("piece").isin(found))
        return hits.groupBy("id").agg(F.count_distinct("piece").alias("n")).filter(F.col("n") == len(found)).select("id")

    def contains(self, needle: str) -> DataFrame:
        """key, text of all rows whose text contains the needle, whatever the case."""
        some = self.candidates(needle)
        if some is not None and some.limit(MOST_SENT + 1).count() <= MOST_SENT:
            some = F.broadcast(some)
        x = self.texts if some is None else self.texts.join(some, "id", "left_semi")
        return x.filter(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(needle.lower()))).select("key", "text")
