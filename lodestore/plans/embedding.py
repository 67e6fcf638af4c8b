"""Queries of embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import embedding as em
from lodestore.plans.base import chunks_of, documents, query, table
from lodestore.streaming import tickets as tk


@query("embedded_emb01")
def embedded(spark, sf_dir):
    """Vectors of all chunks by the stand-in model: their dimensions, digests (components to six places), and errors."""
    model = em.HashedModel()
    found = em.embed(chunks_of(documents(spark, sf_dir)), model, model.identity)
    places = F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("long").cast("string"))
    return found.select("chunk_id", F.size("embedding").alias("dimension"), "model_identity", F.sha2(F.array_join(places, ","), 256).alias("vector_sha256"), "error")


@query("degraded_emb02", "SELECT conv_id, CASE WHEN count(*) FILTER (length(text) < 100) > 0 THEN 'partial' ELSE 'ready' END AS status FROM conversations GROUP BY conv_id")
def degraded(spark, sf_dir):
    """Short turns stand for chunks without a vector."""
    missing = F.count_if(F.length("text") < 100)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(em.status_with_vectors(F.lit("ready"), missing).alias("status"))


@query("tickets_stm08")
def ticketed(spark, sf_dir):
    """Every event is a request, each user an instance, the properties are what is asked and the value says how long it takes.
    Events are hours apart, so costs and limits are hours as well: with seconds no request would meet another."""
    rule = tk.Tickets(most=3, deadline=8 * 3600, ttl=2 * 86400)
    requests = table(spark, sf_dir, "events").withColumn("seconds", F.col("value") * 1200)
    return tk.batch(requests, rule, "user_id", "ts", "event_id", "props", "seconds")
