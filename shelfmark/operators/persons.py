"""Persons from face embeddings: leader clustering, centroids and counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.measures import dot, unit

THRESHOLD = 0.6


def centroids(faces: DataFrame, person: str = "person_id", embedding: str = "embedding") -> DataFrame:
    """person, centroid (unit length), n: element-wise partial sums, then one norm."""
    flat = faces.where(F.col(embedding).isNotNull()).select(person, F.posexplode(embedding).alias("__i", "__x"))
    sums = flat.groupBy(person, "__i").agg(F.sum(F.col("__x").cast("double")).alias("__s"), F.count("*").alias("n"))
    rows = sums.groupBy(person).agg(F.sort_array(F.collect_list(F.struct("__i", "__s"))).alias("__v"), F.max("n").alias("n"))
    return rows.select(person, unit(F.transform("__v", lambda p: p["__s"])).alias("centroid"), "n")


def leader_clusters(faces: DataFrame, block: str | None = None, threshold: float = THRESHOLD, existing: DataFrame | None = None) -> DataFrame:
    """Leader clustering within blocks: block, face_id, cluster, similarity.

    Faces are taken by quality (best first, then face_id); each joins the centroid that it is most like, if that is at
    ``threshold`` or more (of equals an existing person, then the later cluster), else it leads a new one. The order
    makes the operator sequential in a block: give ``block`` (a person's candidate set, an index cell) for large
    libraries; without one all faces are one block. ``existing``: person_id and centroid, of bounded number.
    """
    known = [(r.person_id, np.array(r.centroid)) for r in existing.select("person_id", "centroid").collect()] if existing is not None else []
    key = block or "__block"
    rows = faces if block else faces.withColumn("__block", F.lit(0))
    rows = rows.select(key, "face_id", "quality", unit(F.col("embedding")).alias("embedding")).where("embedding is not null")

    def cluster(table: pa.Table) -> pa.Table:
        ids = table.column("face_id").to_pylist()
        quality = table.column("quality").to_numpy()
        vectors = np.array(table.column("embedding").to_pylist())
        order = sorted(range(len(ids)), key=lambda k: (-quality[k], ids[k]))
        sums = np.zeros((len(known) + len(ids), vectors.shape[1]))
        for k, (_, c) in enumerate(known):
            sums[k] = c
        units = sums.copy()
        n, out = len(known), [0] * len(ids)
        like = [0.0] * len(ids)
        for k in order:
            v = vectors[k]
            best, s = -1, threshold
            if n:
                scores = units[:n] @ v
                new, old = scores[len(known) :], scores[: len(known)]
                if len(old) and old.max() >= s:
                    best, s = len(old) - 1 - int(old[::-1].argmax()), float(old.max())
                if len(new) and new.max() >= s and not (best >= 0 and new.max() == s):
                    best, s = len(known) + len(new) - 1 - int(new[::-1].argmax()), float(new.max())
            if best < 0:
                best, s, n = n, 1.0, n + 1
            if best >= len(known):
                sums[best] += v
                units[best] = sums[best] / (np.linalg.norm(sums[best]) or 1.0)
            out[k], like[k] = best, s
        names = [str(known[c][0]) if c < len(known) else f"new-{c - len(known)}" for c in out]
        return pa.table({key: table.column(key), "face_id": table.column("face_id"), "cluster": names, "similarity": like})

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInArrow(cluster, f"{key} {kinds[key]}, face_id {kinds['face_id']}, cluster string, similarity double")


def person_stats(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """person_id, face_count, photo_count (distinct contents); persons without faces stay with zeros."""
    counts = faces.groupBy("person_id").agg(F.count("*").alias("face_count"), F.countDistinct("content_hash").alias("photo_count"))
    return persons.select("person_id").join(counts, "person_id", "left").select("person_id", F.coalesce("face_count", F.lit(0)).alias("face_count"), F.coalesce("photo_count", F.lit(0)).alias("photo_count"))


def most_like(faces: DataFrame, centres: DataFrame) -> DataFrame:
    """face_id, person_id, similarity with the face's own centroid."""
    joined = faces.join(centres.select("person_id", "centroid"), "person_id")
    return joined.select("face_id", "person_id", dot(unit(F.col("embedding")), F.col("centroid")).alias("similarity"))
