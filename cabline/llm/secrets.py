"""Secret scans: a keyword automaton, anchored expressions near its hits, checksums.

One pass per text: an Aho-Corasick automaton over the lower-cased text finds
the keywords; only there an anchored expression is tried. Hex runs have no
keyword, so one bounded expression finds them. Tokens that carry a checksum
are reported only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabline.llm.common import id_text, prepare

# FIXED VALUES: the published patterns, prefixes and alphabets.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
CHECKED = r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
XPRV = r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS = 8, 16

SPANS = "array<struct<kind:string,start:int,end:int>>"


def crc62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits, the tail of a checked token."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def base58check(text: str) -> bool:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big") if n >> 656 == 0 else b""
    return raw != b"" and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            self.words.add_word(w, ("assign", len(w)))
        self.words.add_word("akia", ("access", 4))
        for w in (*GITHUB_PREFIXES, "npm_"):
            self.words.add_word(w, ("checked", 4))
        self.words.add_word("xprv", ("xprv", 4))
        self.words.make_automaton()
        self.at = {
            "assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE).match,
            "access": re.compile(ACCESS).match,
            "checked": re.compile(CHECKED).match,
            "xprv": re.compile(XPRV).match,
        }
        self.hex = re.compile(HEX).finditer

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of ``text`` in code points, by start, then kind as listed in KINDS."""
        # lower() keeps every position once the one letter that grows is replaced; the expressions see the text itself
        low = text.lower() if text.isascii() else text.replace("İ", ".").lower()
        out = [("hex", m.start(), m.end()) for m in self.hex(text)]
        free = dict.fromkeys(self.at, 0)
        hits = sorted((end + 1 - n, kind) for end, (kind, n) in self.words.iter(low))
        for start, kind in hits:
            if start < free[kind] or not (m := self.at[kind](text, start)):
                continue
            free[kind] = m.end()
            if kind == "assign":
                ok = len(m[1]) >= MIN_ASSIGN
            elif kind == "access":
                ok = m.end() - start >= MIN_ACCESS
            elif kind == "checked":
                ok = crc62(m[1]) == m[2]
                kind = "npm" if m[0].startswith("npm") else "github"
            else:
                ok = base58check(m[0])
            if ok:
                out.append((kind, start, m.end()))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = Scanner()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x.as_py())] for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text).

    A null or empty text has no spans. Rows are handled one by one: repeated
    rows are returned as often as they occur, a null doc_id stays null, an
    empty table gives an empty result, other columns are left out. No shuffle.
    """
    prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(_scan, f"doc_id long, spans {SPANS}")


def secret_digest(found: DataFrame) -> DataFrame:
    """The report columns of ``scan_secrets``' result."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *(n(k) for k in KINDS[3:]))
