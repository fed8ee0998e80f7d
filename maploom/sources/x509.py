"""A small DER reader for what the map needs of an X.509 certificate."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame

_CN, _SAN = bytes.fromhex("550403"), bytes.fromhex("551d11")


def tlv(data: bytes, at: int = 0) -> tuple[int, int, int]:
    """Tag, start and end of the value at a place."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 128:
        n = size & 127
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > len(data):
        raise ValueError("truncated DER")
    return tag, at, at + size


def children(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]]:
    out = []
    while lo < hi:
        out.append(tlv(data, lo))
        lo = out[-1][2]
    return out


def _time(data: bytes, t) -> int:
    text = data[t[1] : t[2]].decode()
    if t[0] == 0x17:
        text = ("19" if text[:2] >= "50" else "20") + text
    return int(datetime.strptime(text, "%Y%m%d%H%M%SZ").replace(tzinfo=timezone.utc).timestamp())


def _common_name(data: bytes, name) -> str | None:
    for _, lo, hi in children(data, name[1], name[2]):
        for _, a, b in children(data, lo, hi):
            oid, value = children(data, a, b)[:2]
            if data[oid[1] : oid[2]] == _CN:
                return data[value[1] : value[2]].decode(errors="replace")
    return None


def parse(der: bytes) -> dict:
    """cert_id, subject and issuer (hash of the name's DER), common name, names, not_after."""
    _, lo, hi = tlv(der)
    tbs = children(der, lo, hi)[0]
    parts = children(der, tbs[1], tbs[2])
    parts = parts[1:] if parts[0][0] == 0xA0 else parts
    _, _, issuer, validity, subject, *rest = parts
    cn, names = _common_name(der, subject), []
    for tag, a, b in rest:
        if tag == 0xA3:
            for _, x, y in children(der, *children(der, a, b)[0][1:]):
                ext = children(der, x, y)
                if der[ext[0][1] : ext[0][2]] == _SAN:
                    for kind, p, q in children(der, *tlv(der, ext[-1][1])[1:]):
                        if kind == 0x82:
                            names.append(der[p:q].decode(errors="replace"))
    return {
        "cert_id": hashlib.sha256(der).hexdigest(),
        "subject": hashlib.sha256(der[subject[1] : subject[2]]).hexdigest(),
        "issuer": hashlib.sha256(der[issuer[1] : issuer[2]]).hexdigest(),
        "common_name": cn,
        "names": list(dict.fromkeys(([cn] if cn else []) + names)),
        "not_after": _time(der, children(der, validity[1], validity[2])[1]),
    }


SCHEMA = "der binary, cert_id string, subject string, issuer string, common_name string, names array<string>, not_after long, error string"


def decode(certs: DataFrame, strict: bool = True) -> DataFrame:
    """The fields of ``certs(der)``; distinct blobs are parsed once. ``strict``: a bad one fails the job."""

    def run(batches):
        kinds = [pa.binary(), *[pa.string()] * 4, pa.list_(pa.string()), pa.int64(), pa.string()]
        schema = pa.schema([(x.split()[0], k) for x, k in zip(SCHEMA.split(", "), kinds, strict=True)])
        for b in batches:
            rows = []
            for der in b.column("der").to_pylist():
                try:
                    rows.append({"der": der, **parse(der), "error": None})
                except (ValueError, IndexError, TypeError) as e:
                    if strict:
                        raise
                    rows.append({"der": der, "error": repr(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return certs.select("der").distinct().mapInArrow(run, SCHEMA)
