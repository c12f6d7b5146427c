"""Secret scan: base patterns plus structurally confirmed keys and signed tokens.

Base kinds (``assign``, ``access``, ``hex``) are patterns alone.  Further kinds come from
base64 or hex runs that are decoded and parsed before they count: ``key`` (a DER private
key whose nested lengths fill the bytes exactly, or an OpenSSH key block, bare or in PEM
armour) and ``jwt`` (three dot-joined parts whose first two decode to JSON, the header
naming an algorithm).  Runs that decode to anything else are not reported.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm.words import Text, pieces

#: Fixed order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "key", "jwt")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_BLOB = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: Base64 broken into lines, as it is outside PEM armour too.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]++={0,2}")
_HEX_BLOB = re.compile(r"(?:[0-9a-fA-F]{2}){24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")

#: Characters of the shortest signed token: a header ``{"alg":""}``, a body ``{}`` and no signature.
_SHORTEST = 19

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_BLOB_BYTE = np.zeros(256, bool)
_BLOB_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_.-")] = True


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the element at ``at`` if its length fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size, begin = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or begin + width > end:
            return None
        size = int.from_bytes(data[begin : begin + width], "big")
        begin += width
    return (tag, begin, begin + size) if begin + size <= end else None


def is_private_key(data: bytes) -> bool:
    """DER of PKCS#1, PKCS#8 or SEC1 private keys, or an OpenSSH private key block."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at = len(magic)
        for _ in range(3):  # cipher, key derivation and its options
            size = int.from_bytes(data[at : at + 4], "big")
            at += 4 + size
            if at > len(data):
                return False
        return len(data) - at >= 8
    whole = _tlv(data, 0, len(data))
    if whole is None or whole[0] != 0x30 or whole[2] != len(data):
        return False
    parts, at = [], whole[1]
    while at < whole[2]:
        part = _tlv(data, at, whole[2])
        if part is None:
            return False
        parts.append(part)
        at = part[2]
    tags = [p[0] for p in parts]
    if len(parts) < 2 or tags[0] != 0x02 or data[parts[0][1] : parts[0][2]] not in (b"\0", b"\1"):
        return False
    if len(parts) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True
    if len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:
        oid = _tlv(data, parts[1][1], parts[1][2])
        return oid is not None and oid[0] == 0x06
    return tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:])


def _decode64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not."""
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, body: str) -> bool:
    found = []
    for part in (header, body):
        raw = _decode64(part)
        try:
            found.append(json.loads(raw.decode()) if raw else None)
        except (ValueError, RecursionError):
            return False
    return isinstance(found[0], dict) and isinstance(found[0].get("alg"), str) and isinstance(found[1], dict)


def _long_runs(text: Text, table: np.ndarray, least: int) -> np.ndarray:
    """Whether each text holds a run of at least ``least`` bytes of ``table``."""
    inside = np.zeros(len(text.data) + 2, bool)
    inside[1:-1] = table[text.data]
    begin = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(~inside[1:] & inside[:-1])
    at = begin[end - begin >= least]
    out = np.zeros(len(text.starts) - 1, bool)
    first = np.searchsorted(text.starts, at, "right") - 1
    out[first] = True
    # A run may cross from one text into the next: let every text it touches be looked at.
    last = np.searchsorted(text.starts, end[end - begin >= least] - 1, "right") - 1
    for a, b in zip(first[last > first], last[last > first], strict=True):
        out[a : b + 1] = True
    return out


def find_secrets(text: str, assign: bool = True, access: bool = True, hexes: bool = True, blobs: bool = True) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and kind; flags leave out whole searches."""
    spans: list[tuple[int, int, int]] = []
    if assign:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if blobs:
        keys = [m.span() for m in _PEM.finditer(text) if is_private_key(_decode64("".join(m[2].split())) or b"")]
        keys += [m.span() for m in _BLOB.finditer(text) if is_private_key(_decode64(m[0]) or b"")]
        for m in _WRAPPED.finditer(text):
            # A word that begins the line below may stand at the end of the match.
            whole = m[0]
            for part in (whole, whole[: whole.rindex("\n")].rstrip()):
                if is_private_key(_decode64("".join(part.split())) or b""):
                    keys.append((m.start(), m.start() + len(part)))
                    break
        keys += [m.span() for m in _HEX_BLOB.finditer(text) if is_private_key(bytes.fromhex(m[0]))]
        end = 0
        for a, b in sorted(keys, key=lambda s: (s[0], -s[1])):
            if a >= end:
                spans.append((a, 3, b))
                end = b
        spans += [(m.start(), 4, m.end()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    return [(a, KINDS[k], b) for a, k, b in sorted(spans)]


def scan_batch(column: pa.Array) -> Iterator[list[tuple[int, str, int]]]:
    """Spans of each text; cheap byte searches decide which patterns can match at all."""
    for piece in pieces(column):
        hexes = _long_runs(piece, _HEX_BYTE, 24)
        blobs = _long_runs(piece, _BLOB_BYTE, _SHORTEST)
        for i in range(len(piece.starts) - 1):
            raw = piece.data[piece.starts[i] : piece.starts[i + 1]].tobytes()
            low = raw.lower()
            assign = any(w in low for w in _ASSIGN_WORDS)
            access, pem = b"AKIA" in raw, b"PRIVATE KEY-----" in raw
            if assign or access or hexes[i] or blobs[i] or pem:
                yield find_secrets(raw.decode(), assign, access, bool(hexes[i]), bool(blobs[i]) or pem)
            else:
                yield []


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, an array of (kind, start, end) in code points (null text: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for a, k, b in spans] for spans in scan_batch(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "secrets"])

    picked = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return picked.mapInArrow(run, "doc_id long, secrets array<struct<kind: string, start: long, end: long>>")


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[secret]") -> str:
    """``text`` with overlapping or touching spans joined and replaced by ``mark``."""
    out, at = [], 0
    joined: list[list[int]] = []
    for a, _, b in spans:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    for a, b in joined:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs`` with secrets in text replaced; n_chars, if there, follows."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            changed = {i: spans for i, spans in enumerate(scan_batch(column)) if spans}
            if changed:
                texts = column.to_pylist()
                for i, spans in changed.items():
                    texts[i] = redact(texts[i], spans, mark)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
                if "n_chars" in names:
                    n = names.index("n_chars")
                    sizes = batch.column(n).to_pylist()
                    for i in changed:
                        sizes[i] = len(texts[i])
                    batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.column(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """Digest columns per document: counts and hash of the base spans, and all spans as text."""
    found = scan_secrets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                listed = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                base = ",".join(x for k, x in listed if k in BASE_KINDS)
                n = [sum(k == kind for k, _ in listed) for kind in BASE_KINDS]
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in listed)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
