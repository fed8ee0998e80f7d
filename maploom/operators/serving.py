"""Answers of the map: proofs and payloads of names, the signed head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, domains
from ..functions.ids import split_ids
from ..store import Store
from . import smt
from .lookup import payloads_in_order

#: Fixed value: the id that stands for no payload.
ZERO_ID = "0" * 64


def signed_head(store: Store, n: int, d: int) -> dict:
    """The saved root and its RSA signature (hex); of an empty map both are of no bytes."""
    root = store.load_root()
    return {"root": root, "signature": crypto.rsa_sign(bytes.fromhex(root or ""), n, d).hex()}


def payload_ids(payloads: DataFrame, ids: DataFrame) -> DataFrame:
    """``domain_id, cert_ids_id, cert_ids, policy_ids_id, policy_ids`` of the asked domains; zero ids and nulls where there is nothing."""
    rows = ids.select("domain_id").distinct().join(payloads, "domain_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(ZERO_ID)).alias(c)
    return rows.select("domain_id", zero("cert_ids_id"), "cert_ids", zero("policy_ids_id"), "policy_ids")


def get_proofs(store: Store, names: DataFrame, head: dict | None = None) -> DataFrame:
    """A row for each ancestor, from the e2LD to the name itself, of ``names(name)``.

    ``name, position, domain_name, domain_id, included, path, proof_key, proof_value,
    root, signature``, the payload ids and ``value``, their digest, which a proof of
    presence must have.  Names that are not valid give one row with ``error``.
    """
    head = head or {"root": store.load_root(), "signature": None}
    rows = names.select("name").distinct().withColumn("up", domains.ancestors(F.col("name")))
    bad = rows.where("up is null").select("name", F.lit("invalid domain name").alias("error"))
    parts = rows.where("up is not null").select("name", F.posexplode("up").alias("position", "domain_name")).withColumn("domain_id", F.sha2("domain_name", 256))
    found = smt.proofs(parts.select(F.col("domain_id").alias("key")), store.read("leaves"), store.read("nodes")).withColumnRenamed("key", "domain_id")
    out = parts.join(found, "domain_id").join(payload_ids(store.read("domain_payloads"), parts), "domain_id")
    both = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(split_ids(F.col(c)), F.array().cast("array<string>")) for c in ("cert_ids", "policy_ids")])))
    value = F.when(F.col("included"), F.sha2(F.unhex(F.array_join(both, "")), 256))
    out = out.select("name", "position", "domain_name", "domain_id", "included", "path", "proof_key", "proof_value", F.lit(head["root"]).alias("root"), F.lit(head["signature"]).alias("signature"), "cert_ids_id", "cert_ids", "policy_ids_id", "policy_ids", value.alias("value"), F.lit(None).cast("string").alias("error"))
    return out.unionByName(bad, allowMissingColumns=True)


def verify(root: str | None, row) -> bool:
    """Whether a row of :func:`get_proofs` proves what it says under the root."""
    if row["included"]:
        return row["value"] == row["proof_value"] and smt.verify_inclusion(root, row["path"], row["domain_id"], row["value"])
    return smt.verify_absence(root, row["path"], row["domain_id"], row["proof_key"], row["proof_value"])


def hex_ids(text: Column) -> Column:
    """The 64-digit ids of an argument; an error if its length or a digit is wrong."""
    fine = (F.length(text) % 64 == 0) & text.rlike("^[0-9a-fA-F]*$")
    return F.when(fine, F.coalesce(split_ids(F.lower(text)), F.array().cast("array<string>"))).otherwise(F.raise_error(F.concat(F.lit("not a list of ids: "), text)))


def get_payloads(store: Store, asked: DataFrame, *tables: str) -> DataFrame:
    """``request, pos, id, payload`` of the glued hex ids in ``asked(request, ids)``; null where there is none.

    ``tables`` are ``certs`` and ``policies``, or one of them.
    """
    keys = {"certs": "cert_id", "policies": "policy_id"}
    rows = asked.select("request", F.posexplode(hex_ids(F.col("ids"))).alias("pos", "id"))
    sources = [store.read(t).select(F.col(keys[t]).alias("id"), "payload") for t in tables or keys]
    found = payloads_in_order(rows.select(F.struct("request", "pos").alias("pos"), "id"), *sources)
    return found.select("pos.request", "pos.pos", "id", "payload")
