"""Random-hyperplane LSH: planes, hashes, buckets, candidate pruning, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfind.functions.vectors import same_length


def plane_count(n: int) -> int:
    """ceil(log2 n) planes, at least one for a non-empty index; none for none."""
    return max(1, (n - 1).bit_length()) if n > 0 else 0


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 32 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")
    return (bits + 1) / F.lit(4294967297.0)


def planes(spark: SparkSession, n_planes: int, dims: int, seed: int = 42) -> DataFrame:
    """hash_index, projection: i.i.d. normal by Box-Muller on uniforms of (seed, plane, place)."""
    return plane_rows(spark, n_planes, dims, seed).groupBy("hash_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("projection"))


def plane_rows(spark: SparkSession, n_planes: int, dims: int, seed: int = 42) -> DataFrame:
    cells = spark.range(n_planes * dims).select((F.col("id") / dims).cast("int").alias("hash_index"), (F.col("id") % dims).cast("int").alias("place"))
    u1, u2 = (_uniform(F.lit(str(seed)), F.col("hash_index"), F.col("place"), F.lit(str(k))) for k in (1, 2))
    return cells.withColumn("value", F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2))


def hash_vectors(vectors: DataFrame, plane_table: DataFrame, vector: str = "vector") -> DataFrame:
    """vectors with bucket_hash, a bit a plane: '1' where the dot product is positive.

    The planes travel as one broadcast row of at most 63 * dims numbers.
    """
    packed = plane_table.agg(F.transform(F.array_sort(F.collect_list(F.struct("hash_index", "projection"))), lambda x: x["projection"]).alias("_planes"))

    def bit(p: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col(vector), p, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
        return F.when(same_length(F.col(vector), p, dot) > 0, F.lit("1")).otherwise(F.lit("0"))

    none = F.raise_error(F.lit("No hash functions provided")).cast("string")
    out = vectors.crossJoin(F.broadcast(packed))
    return out.withColumn("bucket_hash", F.when(F.size("_planes") > 0, F.array_join(F.transform("_planes", bit), "")).otherwise(none)).drop("_planes")


def bits_of(bucket_hash: Column) -> Column:
    return F.conv(bucket_hash, 2, 10).cast("bigint")


def buckets(hashed: DataFrame, vector_id: str = "id") -> DataFrame:
    """bucket_hash, size, vector_ids."""
    return hashed.groupBy("bucket_hash").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(vector_id)).alias("vector_ids"))


def bucket_sizes(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("bucket_hash").agg(F.count(F.lit(1)).alias("size"))


def bucket(hashed: DataFrame, bucket_hash: str) -> DataFrame:
    return hashed.where(F.col("bucket_hash") == bucket_hash)


def lsh_stats(hashed: DataFrame) -> DataFrame:
    """One row: distinct buckets, their count again (as the interface names it), mean and largest size, empty ones, vectors."""
    return bucket_sizes(hashed).agg(
        F.countDistinct("bucket_hash").alias("total_buckets"),
        F.count(F.lit(1)).alias("total_vectors_ref"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_bucket_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_bucket_size"),
        F.count_if(F.col("size") == 0).alias("empty_buckets"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_vectors"),
    )


def candidate_buckets(queries: DataFrame, sizes: DataFrame, top_k: int) -> DataFrame:
    """query_id, bucket_hash, distance: nearest buckets by Hamming distance, whole ones, until 10 * top_k vectors.

    A bucket is in when the nearer ones hold fewer. Ties go by bucket hash. queries has query_id and
    bucket_hash and is broadcast: it is the stated query set.
    """
    q = queries.select("query_id", bits_of(F.col("bucket_hash")).alias("_q"))
    pairs = sizes.select("bucket_hash", "size", bits_of(F.col("bucket_hash")).alias("_b")).crossJoin(F.broadcast(q))
    pairs = pairs.withColumn("distance", F.bit_count(F.col("_q").bitwiseXOR(F.col("_b"))).cast("int"))
    # A bucket holds a vector at least, so no more buckets than vectors are wanted: that many leave each partition.
    order = Window.partitionBy("query_id").orderBy("distance", "bucket_hash")
    pairs = pairs.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= 10 * top_k)
    pairs = pairs.withColumn("_nearer", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return pairs.where(F.col("_nearer") < 10 * top_k).select("query_id", "bucket_hash", "distance", "size")


def candidates(queries: DataFrame, index: DataFrame, top_k: int) -> DataFrame:
    """index's rows (bucket_hash, vector_id or others) in candidate buckets, with query_id and distance.

    At most 10 * top_k buckets a query go to the workers; of the index two columns are read, vectors none.
    """
    near = candidate_buckets(queries, bucket_sizes(index), top_k)
    return index.join(F.broadcast(near.drop("size")), "bucket_hash")


def bucket_rows(hashed: DataFrame, config: Column, now: Column) -> DataFrame:
    """Rows of lsh_buckets; note_id goes along where vectors have one."""
    note = F.col("note_id") if "note_id" in hashed.columns else F.lit(None).cast("string").alias("note_id")
    return hashed.select(F.concat_ws("#", config, F.col("id")).alias("id"), config.alias("config_id"), "bucket_hash", F.col("id").alias("vector_id"), note, now.alias("created_at"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact's (query_id, id) that found has, and how many there are."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")).distinct(), ["query_id", "id"], "left")
    return both.agg(F.coalesce(F.try_divide(F.count("_hit").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(1.0)).alias("recall"), F.count(F.lit(1)).alias("n"))


def clear(tables: dict[str, DataFrame], config_id: str | None = None) -> dict[str, DataFrame]:
    """The index tables without one configuration, or empty."""
    keep = F.lit(False) if config_id is None else None
    return {
        "lsh_configs": tables["lsh_configs"].where(keep if keep is not None else F.col("id") != config_id),
        "lsh_hash_functions": tables["lsh_hash_functions"].where(keep if keep is not None else F.col("config_id") != config_id),
        "lsh_buckets": tables["lsh_buckets"].where(keep if keep is not None else F.col("config_id") != config_id),
    }


def current_config(configs: DataFrame) -> DataFrame:
    """The newest configuration, if any."""
    return configs.orderBy(F.desc("created_at"), "id").limit(1)


def hash_functions(functions: DataFrame, config_id: str) -> DataFrame:
    """hash_index and projection of a configuration, in order."""
    return functions.where(F.col("config_id") == config_id).select("hash_index", "projection").orderBy("hash_index")


def build_index(vectors: DataFrame, dims: int, seed: int = 42, now: Column | None = None) -> dict[str, DataFrame]:
    """lsh_configs, lsh_hash_functions and lsh_buckets of vectors (id, vector); empty tables for none."""
    spark = vectors.sparkSession
    n = vectors.count()
    now = F.timestamp_seconds(F.lit(0)) if now is None else now
    h = plane_count(n)
    config = F.sha2(F.lit(f"lsh:{seed}:{n}:{dims}"), 256)
    configs = spark.range(1 if n else 0).select(config.alias("id"), now.alias("created_at"), F.lit(n).cast("bigint").alias("vector_count"), F.lit(dims).alias("vector_dimensions"), F.lit(h).alias("num_hash_functions"))
    p = planes(spark, h, dims, seed)
    functions = p.select(F.concat_ws("#", config, F.col("hash_index")).alias("id"), config.alias("config_id"), "hash_index", now.alias("created_at"), "projection")
    rows = bucket_rows(hash_vectors(vectors, p), config, now)
    return {"lsh_configs": configs, "lsh_hash_functions": functions, "lsh_buckets": rows}
