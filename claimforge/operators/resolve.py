"""Identity resolution: records that share a normalized e-mail, phone or profile URL are one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.normalize import email, good, phone_e164, url_link
from claimforge.operators.components import connected_components
from claimforge.operators.storage import materialize


def claim_keys(claims: DataFrame) -> DataFrame:
    """(record_id, kind, key), distinct: what each record can be matched by."""
    links = F.col("v_links")
    urls = F.filter(F.concat(F.array(links["linkedin"], links["github"], links["portfolio"]), F.coalesce(links["other"], F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != ""))

    def keyed(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    found = (
        F.when(F.col("field") == "emails", F.array(keyed("email", good(email(F.col("v_str"))))))
        .when(F.col("field") == "phones", F.array(keyed("phone", good(phone_e164(F.col("v_str"))))))
        .when(F.col("field") == "links", F.transform(urls, lambda u: keyed("url", good(url_link(u)))))
    )
    matched = claims.where(F.col("field").isin("emails", "phones", "links")).select("record_id", F.explode(found).alias("k"))
    return matched.select("record_id", "k.kind", "k.key").where("key is not null").distinct()


def cluster_records(keys: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, cluster_id) of every record; the cluster is named by its smallest record.

    A key joins its records to the smallest one of them, so a key that many share makes as many edges, not their
    square. Records without keys are clusters of their own. Nothing is matched by likeness.
    """
    first = materialize(keys.groupBy("kind", "key").agg(F.min("record_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "key-owners")
    edges = keys.join(first, ["kind", "key"]).select(F.col("owner").alias("a"), F.col("record_id").alias("b"))
    found = connected_components(edges).withColumnRenamed("node", "record_id")
    return records.select("record_id").distinct().join(found, "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("cluster_id"))


def cluster(claims: DataFrame) -> DataFrame:
    """Claims with their ``cluster_id``; inside a cluster they are ordered by (record_id, claim_seq)."""
    return claims.join(cluster_records(claim_keys(claims), claims), "record_id")
