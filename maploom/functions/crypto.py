"""RSA signatures and append-only log proofs, on plain bytes; use inside Arrow or pandas functions."""

from __future__ import annotations

import hashlib

#: Fixed value: the ASN.1 prefix of a SHA-256 digest in PKCS #1 v1.5.
DIGEST_INFO = bytes.fromhex("3031300d060960864801650304020105000420")


def rsa_sign(message: bytes, n: int, d: int) -> bytes:
    size = (n.bit_length() + 7) // 8
    return pow(int.from_bytes(_padded(message, size), "big"), d, n).to_bytes(size, "big")


def rsa_verify(message: bytes, signature: bytes, n: int, e: int = 65537) -> bool:
    size = (n.bit_length() + 7) // 8
    return len(signature) == size and pow(int.from_bytes(signature, "big"), e, n).to_bytes(size, "big") == _padded(message, size)


def _padded(message: bytes, size: int) -> bytes:
    tail = DIGEST_INFO + hashlib.sha256(message).digest()
    return b"\0\x01" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail


def log_leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()


def _node(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + a + b).digest()


def log_root(leaves: list[bytes]) -> bytes:
    """Merkle tree hash of leaf hashes."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return _node(log_root(leaves[:k]), log_root(leaves[k:]))


def log_proof(leaves: list[bytes], index: int) -> list[bytes]:
    if len(leaves) < 2:
        return []
    k = 1 << (len(leaves) - 1).bit_length() - 1
    if index < k:
        return [*log_proof(leaves[:k], index), log_root(leaves[k:])]
    return [*log_proof(leaves[k:], index - k), log_root(leaves[:k])]


def verify_log_inclusion(leaf: bytes, index: int, size: int, proof: list[bytes], root: bytes) -> bool:
    """Audit path of RFC 6962."""
    if index >= size:
        return False
    node, last = leaf, size - 1
    for p in proof:
        if last == 0:
            return False
        if index & 1 or index == last:
            node = _node(p, node)
            while not index & 1 and index:
                index, last = index >> 1, last >> 1
        else:
            node = _node(node, p)
        index, last = index >> 1, last >> 1
    return last == 0 and node == root


def verify_log_consistency(old_size: int, new_size: int, old_root: bytes, new_root: bytes, proof: list[bytes]) -> bool:
    """Consistency proof of RFC 6962."""
    if old_size == new_size:
        return old_root == new_root and not proof
    if old_size == 0:
        return not proof
    if old_size > new_size or not proof:
        return False
    path = [old_root, *proof] if old_size & (old_size - 1) == 0 else list(proof)
    fn, sn = old_size - 1, new_size - 1
    while fn & 1:
        fn, sn = fn >> 1, sn >> 1
    first = second = path[0]
    for p in path[1:]:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            first, second = _node(p, first), _node(p, second)
            while fn and not fn & 1:
                fn, sn = fn >> 1, sn >> 1
        else:
            second = _node(second, p)
        fn, sn = fn >> 1, sn >> 1
    return sn == 0 and first == old_root and second == new_root
