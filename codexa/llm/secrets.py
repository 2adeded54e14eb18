"""Secret scan: Aho-Corasick keywords, anchored patterns, embedded checksums.

One automaton of lower-case keywords runs over a text's bytes.  Only where a
keyword stands is that kind's pattern tried, anchored there; runs of hex digits
have no keyword and are found directly.  Kinds with a checksum or a structure
of their own count only if it holds.

Defined results: a null text is empty; texts are scanned whole, whatever their
length; equal rows give equal rows; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem", "slack")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "eyj": "jwt", "-----begin": "pem", "xox": "slack",
}
PATTERNS = {
    "assign": rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": rb"AKIA[A-Z0-9]+",
    "github": rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "jwt": rb"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+",
    "pem": rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----",
    "slack": rb"xox[abprs]-[0-9]{10,13}-[A-Za-z0-9-]{10,}",
}
#: A token's parts are runs of these; what a run doesn't hold, no try within it finds.
JWT_RUN = rb"[A-Za-z0-9_-]*+"
HEX_RUN = rb"[0-9a-f]{24,}"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def crc_holds(token: bytes) -> bool:
    """The last six characters are the CRC32, in base 62, of those between."""
    body = token.split(b"_", 1)[1]
    return base62(zlib.crc32(body[:-6]), 6).encode() == body[-6:]


def jwt_holds(raw: bytes, start: int, end: int) -> bool:
    """The token's head is base64 of a JSON object that names an algorithm.

    It is read in growing pieces, and given up where a piece can't begin an object, so
    that tries at many places of one long run don't each read all of it.
    """
    size = 64
    while True:
        stop = min(end, start + size)
        try:
            piece = base64.urlsafe_b64decode(raw[start:stop] + b"=" * (-(stop - start) % 4))
            if stop == end:
                return "alg" in json.loads(piece)
            json.loads(piece.decode("latin-1"))
        except json.JSONDecodeError as e:
            if stop == end or e.msg == "Extra data" or e.msg != "Unterminated string starting at" and e.pos < len(piece) - 16:
                return False
        except (ValueError, binascii.Error, TypeError, RecursionError):
            return False
        size *= 4


def pem_holds(block: bytes) -> bool:
    """The body is base64 of a DER sequence."""
    body = re.sub(rb"\s+", b"", block.split(b"-----")[2])
    try:
        return base64.b64decode(body, validate=True)[:1] == b"0"
    except (ValueError, binascii.Error):
        return False


CHECKS = {"github": crc_holds, "npm": crc_holds, "pem": pem_holds}


def make_scanner():
    """A function from bytes to byte spans {kind: [(start, end)]}."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    match = {k: re.compile(p).match for k, p in PATTERNS.items()}
    hexes, run = re.compile(HEX_RUN), re.compile(JWT_RUN).match

    def scan(raw: bytes) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {}
        past: dict[str, int] = {}
        head_end = token_end = 0
        # Latin-1 gives one character for each byte, and bytes.lower() changes A-Z alone.
        for last, (kind, n) in auto.iter(raw.lower().decode("latin-1")):
            at = last + 1 - n
            if at < past.get(kind, 0):
                continue
            if kind == "jwt":
                if raw[at : at + 3] != b"eyJ":
                    continue
                if at >= head_end:
                    head_end = run(raw, at).end()
                    token_end = m.end() if (m := match[kind](raw, at)) else 0
                # All tries in one run of a head share what follows it.
                if not token_end:
                    past[kind] = head_end
                elif at + 3 < head_end and jwt_holds(raw, at, head_end):
                    past[kind] = token_end
                    found.setdefault(kind, []).append((at, token_end))
                continue
            if not (m := match[kind](raw, at)):
                continue
            past[kind] = m.end()
            if kind == "assign" and len(m[1]) < 6 or kind == "access" and m.end() - at < 20:
                continue
            if kind in CHECKS and not CHECKS[kind](m[0]):
                past[kind] = at + 1
                continue
            found.setdefault(kind, []).append((at, m.end()))
        if spans := [m.span() for m in hexes.finditer(raw)]:
            found["hex"] = spans
        return found

    return scan


def digest(raw: bytes, found: dict) -> tuple[str, str]:
    """Base spans and all spans, in code points, as text."""
    if not found:
        return "", ""
    marks = sorted({x for spans in found.values() for s in spans for x in s})
    at, points, n = 0, {}, 0
    for x in marks:
        n += len(raw[at:x].decode("utf-8", "replace"))
        at, points[x] = x, n
    rows = sorted((points[s], KINDS.index(k), points[e]) for k, spans in found.items() for s, e in spans)
    text = lambda r: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in r)
    return text([r for r in rows if r[1] < len(BASE_KINDS)]), text(rows)


def scan_batches(batches):
    scan = make_scanner()
    for b in batches:
        out = []
        for text in b.column("text"):
            raw = (text.as_py() or "").encode("utf-8")
            found = scan(raw)
            base, spans = digest(raw, found)
            out.append((*(len(found.get(k, ())) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), spans))
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)


def find_secrets(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan_batches, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every found span replaced by its kind."""

    def run(batches):
        scan = make_scanner()
        for b in batches:
            texts = []
            for t in b.column("text"):
                raw, at, out = (t.as_py() or "").encode("utf-8"), 0, []
                for s, e, k in sorted((s, e, k) for k, spans in scan(raw).items() for s, e in spans):
                    if e > at:
                        out += [raw[at : max(s, at)], f"<{k}>".encode() if s >= at else b""]
                        at = e
                texts.append(b"".join([*out, raw[at:]]).decode("utf-8", "replace") if t.is_valid else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
