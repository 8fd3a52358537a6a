"""Vectors through NumPy archives and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.plans.vector_queries import r8
from vectrine.session import cut, remove, shared_path, table
from vectrine.sources import arrays as N

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT vec_id, len(embedding) AS n_values, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 8) AS norm, round(list_sum(embedding::DOUBLE[]), 8) AS total FROM embeddings")
def array_shards(spark, sf_dir):
    """Vectors written as archives of arrays, whose members are read back in shares and set side by side again."""
    folder = shared_path(spark, "arrays")
    N.write_arrays(table(spark, sf_dir, "embeddings"), folder, "vec_id", "embedding").count()
    rows = N.read_arrays(spark, folder)
    ids = rows.where("member = 'ids'").select("name", "row", F.element_at("values", 1).cast("long").alias("vec_id"))
    vectors = rows.where("member = 'vectors'").select("name", "row", "values")
    back = vectors.join(ids, ["name", "row"]).select("vec_id", F.size("values").cast("long").alias("n_values"), r8(V.norm(F.col("values")), "norm"), r8(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), "total"))
    back = cut(back)
    remove(spark, folder)
    return back


@query("SELECT 'ids' AS member, count(*) AS n_values, 0::BIGINT AS faults FROM embeddings UNION ALL SELECT 'vectors', sum(len(embedding))::BIGINT, count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) FROM embeddings")
def array_contract(spark, sf_dir):
    """What the headers of the archives say of each member, and how many rows or archives break the contract."""
    folder = shared_path(spark, "arrays")
    N.write_arrays(table(spark, sf_dir, "embeddings"), folder, "vec_id", "embedding").count()
    checked = N.checked_shards(spark, folder, {"ids": ("i8", (None,)), "vectors": ("f4", (None, 64))}).withColumn("fault", F.explode("faults"))
    faults = checked.groupBy(F.substring_index("fault", ":", 1).alias("member")).agg(F.count(F.lit(1)).alias("faults"))
    heads = N.array_headers(spark, folder).groupBy("member").agg(F.sum("n_values").alias("n_values"))
    out = cut(heads.join(faults, "member", "left").select("member", "n_values", F.coalesce("faults", F.lit(0).cast("long")).alias("faults")))
    remove(spark, folder)
    return out
