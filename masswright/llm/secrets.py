"""Secret scans with structural confirmation.

Plain patterns find candidates; what the method adds is confirmed by structure before it
is reported: base64 and hex runs are decoded and parsed as DER key encodings with nested
lengths, OpenSSH private keys as length-prefixed fields, signed tokens by the JSON in
their headers, and decoded text is scanned again for the plain patterns (but for bare hex)
and for further encodings.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from masswright.session import ship_package

#: Base patterns: kind, pattern, group whose length decides, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "token", "pem", "der", "wrapped")

#: The shortest header, {"alg":""}, has 14 characters; only the header is consumed, so that a word before it hides no token.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
#: Armoured keys up to the next five dashes, header lines included.
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----((?:[^-]++|-(?!----))*+)-----END \1-----")
PEM_LINE_END = re.compile(r"(?:\\r)?\\n|\\r")
PEM_CIPHER = re.compile(r"Proc-Type:\s*4\s*,\s*ENCRYPTED\b.*?DEK-Info:\s*([A-Za-z0-9-]+)\s*,\s*((?:[0-9A-Fa-f]{16}){1,2})(?![0-9A-Fa-f])", re.S)

#: The shortest base match, token=abcdef, has 12 characters: 16 in base64, 24 in hex.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run may also be an encoding in one alphabet with a neighbour that only the other alphabet has.
ONE_ALPHABET = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: Base64 broken over lines, as keys without their armour are.
LINES = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+(?:\r?\n[A-Za-z0-9+/]++)++={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{24,}")

#: A text matching none of these holds no candidate of any kind.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)|[A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]|-----BEGIN |[A-Za-z0-9+/_-]{16}"


def decode_base64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, or None if it is no whole encoding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, else None."""
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            length = int.from_bytes(data[start : start + n], "big")
            start += n
        if start + length > end:
            return None
        items.append((tag, start, start + length))
        start += length
    return items


def is_private_key(data: bytes) -> bool:
    """Whether data is a PKCS#1, PKCS#8, SEC1 or encrypted PKCS#8 private key in DER."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = der_items(data, *outer[0][1:])
    if not fields or len(fields) < 2:
        return False
    tags = [x[0] for x in fields]
    if len(fields) == 2 and tags == [0x30, 0x04]:  # encrypted: algorithm, ciphertext
        inner = der_items(data, *fields[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and fields[1][2] - fields[1][1] >= 16
    if tags[0] != 0x02 or fields[0][2] - fields[0][1] != 1:
        return False
    if tags[1:3] == [0x30, 0x04]:
        inner = der_items(data, *fields[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    if len(fields) >= 9 and set(tags[:9]) == {0x02}:
        return fields[1][2] - fields[1][1] >= 32
    return tags[1] == 0x04 and fields[1][2] - fields[1][1] >= 20 and all(t in (0xA0, 0xA1) for t in tags[2:])


def ssh_fields(data: bytes, at: int, end: int) -> list[tuple[int, int]] | None:
    """(start, end) of the length-prefixed fields that fill data[at:end] exactly, else None."""
    fields = []
    while at < end:
        size = int.from_bytes(data[at : at + 4], "big")
        if end - at < 4 or size > end - at - 4:
            return None
        fields.append((at + 4, at + 4 + size))
        at += 4 + size
    return fields


def openssh_end(data: bytes) -> int | None:
    """Where the OpenSSH private key at the start of data ends, or None if there is none.

    Cipher, key derivation and its options, the number of keys, a public blob for each,
    whose fields must fill it, and the private blob.  An open private blob has two equal
    check numbers, at least a key's type and material, and counted padding; a ciphertext
    is whole blocks, and its derivation has a salt and a number of rounds.
    """
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, parts = len(magic), []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if len(data) - at < 4 + size:
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        parts.append(field())
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if None in parts or not 1 <= n <= len(data) // 8:
        return None
    for _ in range(n):
        blob = field()
        inner = ssh_fields(blob, 0, len(blob)) if blob else None
        if not inner or len(inner) < 2 or not blob[slice(*inner[0])].isascii() or inner[0][1] - inner[0][0] < 4:
            return None
    secret = field()
    if not secret or len(secret) % 8:
        return None
    cipher, derivation, options = parts
    if cipher != b"none":
        inner = ssh_fields(options, 0, len(options) - 4)
        return at if derivation != b"none" and inner and len(inner) == 1 else None
    if derivation != b"none" or len(secret) < 16 or secret[:4] != secret[4:8]:
        return None
    start, fields = 8, 0
    while start < len(secret) and secret[start:] != bytes(range(1, len(secret) - start + 1)):
        size = int.from_bytes(secret[start : start + 4], "big")
        if size > len(secret) - start - 4:
            return None
        start, fields = start + 4 + size, fields + 1
    return at if fields >= 3 * n else None  # type, material and comment


def is_openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key to its end, but for the tag of an authenticated cipher."""
    end = openssh_end(data)
    if end is None:
        return False
    cipher = data[19 : 19 + int.from_bytes(data[15:19], "big")]
    return len(data) - end == (16 if b"gcm" in cipher or b"poly1305" in cipher else 0)


def key_size(data: bytes) -> int | None:
    """Bytes of the private key at the start of data, whatever follows, or None."""
    if (end := openssh_end(data)) is not None:
        return end
    if len(data) < 4 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    size = 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])
    return size if n <= 4 and is_private_key(data[:size]) else None


def is_signed_token(header: str, payload: str) -> bool:
    """Whether the first part decodes to a JSON object with an algorithm, and the second to a JSON object or an encrypted part."""
    first = decode_base64(header)
    if first is None:
        return False
    try:
        head = json.loads(first)
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return False
    second = decode_base64(payload)
    if second is None:
        return False
    if "enc" in head:
        return True
    try:
        return isinstance(json.loads(second), dict)
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def is_pem_key(body: str) -> bool:
    """Whether the text between the marks of an armoured key is one: a key in base64, or a ciphertext under the headers that name its cipher."""
    lines = PEM_LINE_END.sub("\n", body).splitlines()
    start = max((i + 1 for i, x in enumerate(lines) if ":" in x), default=0)
    data = decode_base64("".join("".join(lines[start:]).split()))
    if not data:
        return False
    if is_private_key(data) or is_openssh_key(data):
        return True
    cipher = PEM_CIPHER.search("\n".join(lines[:start]))
    return bool(cipher) and len(data) >= 16 and ("CBC" not in cipher[1].upper() or len(data) % (len(cipher[2]) // 2) == 0)


def decoded_kind(data: bytes | None) -> str | None:
    """der for a key, wrapped for bytes that hold a secret as text, encoded again or not, else None."""
    if data is None:
        return None
    if is_private_key(data) or is_openssh_key(data):
        return "der"
    text = data.decode("latin-1")  # all patterns are ASCII
    return "wrapped" if any(k != "hex" for k, _, _ in base_spans(text)) or confirmed_spans(text) else None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure shows a secret."""
    found = []
    for m in TOKEN.finditer(text):
        if is_signed_token(m[1], m[2]):
            found.append(("token", m.start(), m.end(3)))
    for m in PEM.finditer(text):
        if is_pem_key(m[2]):
            found.append(("pem", m.start(), m.end()))
    for m in BASE64_RUN.finditer(text):
        if kind := decoded_kind(decode_base64(m[0])):
            found.append((kind, m.start(), m.end()))
            continue
        parts = {x.span() for alphabet in ONE_ALPHABET for x in alphabet.finditer(text, m.start(), m.end())}
        for start, end in sorted(parts - {m.span()}):
            if kind := decoded_kind(decode_base64(text[start:end])):
                found.append((kind, start, end))
    for m in LINES.finditer(text):
        places = [i for i in range(m.start(), m.end()) if text[i] not in "\r\n="]
        whole = len(places) // 4 * 4
        # The first key ends where its own lengths say, even if more lines of words follow.
        size = key_size(decode_base64("".join(text[i] for i in places[:whole])) or b"") or key_size(decode_base64("".join(text[i] for i in places)) or b"")
        if size:
            last = places[-(-size * 4 // 3) - 1]
            found.append(("der", m.start(), last + 1 + len(re.match("={0,2}", text[last + 1 :])[0])))
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := decoded_kind(bytes.fromhex(m[0]))):
            found.append((kind, m.start(), m.end()))
    return found


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind} removed]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Scan every whole text; one row per input row, and no shuffle.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (digest of the base spans),
    spans (base and confirmed) and, if ``with_text``, clean_text (the text with all spans
    replaced).  Null texts count as empty.  Rows are independent: ties, repeated ids and
    null ids pass through.  An empty table gives an empty result.  Other columns are
    ignored.
    """
    ship_package(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"][: 7 if with_text else 6]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            maybe = pc.match_substring_regex(texts, MAYBE).to_pylist()
            rows = []
            for text, look in zip(texts.to_pylist(), maybe, strict=True):
                base = base_spans(text) if look else []
                spans = base + confirmed_spans(text) if look else []
                counts = [sum(k == kind for k, _, _ in base) for kind, *_ in BASE]
                rows.append((*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans), redact(text, spans) if spans else text))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types[: len(names) - 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    kinds = {"doc_id": "long", "n_assign": "long", "n_access": "long", "n_hex": "long"}
    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(scan, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in text replaced by a mark, all columns and rows kept.

    Runs of overlapping spans get one mark, of the span that starts first, the longest of
    such.  Null texts stay null, repeated rows are each cleaned, and an empty table stays
    empty.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column(at)
            maybe = pc.match_substring_regex(pc.fill_null(column, ""), MAYBE).to_pylist()
            texts = [redact(t, base_spans(t) + confirmed_spans(t)) if look else t for t, look in zip(column.to_pylist(), maybe, strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(clean, docs.schema)
