"""Policy certificates as documents: their serialized form, signers' hashes, and owner and issuer signatures.

A document is a dict with the fields of FIELDS; bytes are base64 text, times RFC 3339
text.  It is signed and hashed in its serialized form, ``{"T": tag, "O": object}``
without spaces, with fields in the order given here and empty ones left out.  The
functions are plain Python, to be used inside Arrow or pandas functions on whole
batches of documents.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from ..sources.x509 import children, tlv
from .crypto import rsa_sign, rsa_verify

# The tags of the serialized form, and the fields in their order.
TAGS = {
    "signing request": "pcsr",
    "certificate": "pc",
    "timestamp": "spct",
    "revocation request": "pcrevsr",
    "revocation": "pcrev",
    "revocation timestamp": "spcrevt",
    "log proof": "trillian.Proof",
    "log root": "logrootv1",
    "timestamp input": "spctsiginput",
}
FIELDS = [
    "Version", "SerialNumber", "Domain", "NotBefore", "NotAfter", "CanIssue", "CanOwn", "PublicKey", "PublicKeyAlgorithm",
    "SignatureAlgorithm", "TimeStamp", "PolicyAttributes", "OwnerSignature", "OwnerHash", "IssuerSignature", "IssuerHash", "SPCTs",
]
ATTRIBUTES = ["AllowedCAs", "AllowedSubdomains", "DisallowedSubdomains", "ExcludedSubdomains"]
_ALWAYS = {"NotBefore", "NotAfter", "TimeStamp", "PolicyAttributes"}


def serialize(doc: dict, tag: str = "*pc") -> bytes:
    """The signed form of a document, or of a list of documents."""
    if isinstance(doc, list):
        return json.dumps({"T": "[]", "O": [json.loads(serialize(x, tag)) for x in doc]}, separators=(",", ":"), ensure_ascii=False).encode()
    out = {}
    for name in FIELDS:
        value = doc.get(name)
        if name == "PolicyAttributes":
            out[name] = {k: value[k] for k in ATTRIBUTES if (value or {}).get(k)}
        elif value or name in _ALWAYS:
            out[name] = value
    return json.dumps({"T": tag, "O": out}, separators=(",", ":"), ensure_ascii=False).encode()


def parse(raw: bytes):
    """(tag, whether it is a pointer, object) of a serialized document; of a list, the tag ``[]`` and its members."""
    data = json.loads(raw)
    if set(data) != {"T", "O"}:
        raise ValueError("not a tagged document")
    if data["T"] == "[]":
        return "[]", False, [parse(json.dumps(x).encode()) for x in data["O"]]
    tag = data["T"].removeprefix("*")
    if tag not in TAGS.values():
        raise ValueError(f"unknown tag {tag}")
    return tag, data["T"].startswith("*"), data["O"]


def equal(a: dict, b: dict) -> bool:
    """Deep equality of documents, whatever their raw bytes were."""
    return serialize(a) == serialize(b)


def _b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


def _without(doc: dict, *names: str) -> dict:
    return {k: v for k, v in doc.items() if k not in names}


def signer_hash(doc: dict) -> bytes:
    """What names a certificate as owner or issuer: the hash of it without timestamps and issuer signature."""
    return hashlib.sha256(serialize(_without(doc, "SPCTs", "IssuerSignature"))).digest()


def public_key(doc: dict) -> tuple[int, int]:
    """Modulus and exponent of the RSA key in a certificate (a DER SubjectPublicKeyInfo)."""
    return rsa_public(base64.b64decode(doc["PublicKey"]))


def rsa_public(der: bytes) -> tuple[int, int]:
    _, lo, hi = tlv(der)
    bits = children(der, lo, hi)[1]
    inner = der[bits[1] + 1 : bits[2]]
    return tuple(int.from_bytes(inner[a:b], "big") for _, a, b in children(inner, *tlv(inner)[1:]))


def sign_as_owner(owner: dict, request: dict, n: int, d: int) -> dict:
    """The request with its owner's hash and signature."""
    if request.get("OwnerSignature") or request.get("OwnerHash"):
        raise ValueError("there is an owner signature already")
    if not owner.get("CanOwn"):
        raise ValueError("the owner certificate cannot sign as owner")
    return request | {"OwnerHash": _b64(signer_hash(owner)), "OwnerSignature": _b64(rsa_sign(serialize(request | {"OwnerHash": _b64(signer_hash(owner))}), n, d))}


def verify_owner(owner: dict, doc: dict) -> bool:
    """The owner's hash and signature of a request or certificate.

    The signature is of the document with the owner's hash, without timestamps,
    issuer's hash and signature, and the signature itself.
    """
    if not hmac.compare_digest(base64.b64decode(doc.get("OwnerHash") or ""), signer_hash(owner)):
        return False
    return rsa_verify(serialize(_without(doc, "SPCTs", "IssuerSignature", "IssuerHash", "OwnerSignature")), base64.b64decode(doc.get("OwnerSignature") or ""), *public_key(owner))


def sign_as_issuer(issuer: dict, doc: dict, n: int, d: int) -> dict:
    """The certificate of a request, with its issuer's hash and signature."""
    if doc.get("IssuerSignature") or doc.get("IssuerHash"):
        raise ValueError("there is an issuer signature already")
    doc = _without(doc, "SPCTs") | {"IssuerHash": _b64(signer_hash(issuer))}
    return doc | {"IssuerSignature": _b64(rsa_sign(serialize(doc), n, d))}


def verify_issuer(issuer: dict, doc: dict) -> bool:
    """The issuer's hash and signature of a certificate, whatever timestamps it has got since."""
    if not hmac.compare_digest(base64.b64decode(doc.get("IssuerHash") or ""), signer_hash(issuer)):
        return False
    return rsa_verify(serialize(_without(doc, "SPCTs", "IssuerSignature")), base64.b64decode(doc.get("IssuerSignature") or ""), *public_key(issuer))


def _timestamp_input(doc: dict, version: int, log_id: bytes, when: str) -> bytes:
    body = {"Version": version, "LogID": _b64(log_id), "AddedTS": when, "Entry": _b64(serialize(doc))}
    return json.dumps({"T": "*" + TAGS["timestamp input"], "O": body}, separators=(",", ":")).encode()


def sign_timestamp(doc: dict, version: int, log_id: bytes, when: str, n: int, d: int) -> dict:
    """A log's signed timestamp for a certificate."""
    return {"Version": version, "LogID": _b64(log_id), "AddedTS": when, "Signature": _b64(rsa_sign(_timestamp_input(doc, version, log_id, when), n, d))}


def verify_timestamp(doc: dict, stamp: dict, n: int, e: int = 65537) -> bool:
    return rsa_verify(_timestamp_input(doc, stamp["Version"], base64.b64decode(stamp["LogID"]), stamp["AddedTS"]), base64.b64decode(stamp["Signature"]), n, e)
