"""PEM files: certificates and RSA keys."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .x509 import children, tlv

_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----\s*(.*?)-----END \1-----", re.S)


def blocks(text: str) -> list[tuple[str, bytes]]:
    """(label, DER) of each block; an error if a block is not base64."""
    return [(label, base64.b64decode("".join(body.split()), validate=True)) for label, body in _BLOCK.findall(text)]


def write(label: str, der: bytes) -> str:
    body = base64.b64encode(der).decode()
    return "\n".join([f"-----BEGIN {label}-----", *[body[k : k + 64] for k in range(0, len(body), 64)], f"-----END {label}-----", ""])


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """``path, place, der`` of the certificates in PEM files, in order; other blocks are left out."""

    def run(batches):
        for batch in batches:
            out = {"path": [], "place": [], "der": []}
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                ders = [d for label, d in blocks(content.decode()) if label == "CERTIFICATE"]
                out["path"] += [p] * len(ders)
                out["place"] += range(len(ders))
                out["der"] += ders
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("place", pa.int32()), ("der", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, place int, der binary")


def rsa_private_key(text: str) -> tuple[int, int, int]:
    """Modulus, public and private exponent of an RSA key in PKCS #1 or PKCS #8 form."""
    for label, der in blocks(text):
        if label in ("RSA PRIVATE KEY", "PRIVATE KEY"):
            if label == "PRIVATE KEY":
                inner = children(der, *tlv(der)[1:])[2]
                der = der[inner[1] : inner[2]]
            parts = children(der, *tlv(der)[1:])
            return tuple(int.from_bytes(der[a:b], "big") for _, a, b in parts[1:4])
    raise ValueError("no RSA key")
