"""Secrets in texts: keyword automaton, anchored patterns near its hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, texts

# What makes a finding of each base kind.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Kinds in the order in which findings with the same start are listed. Those after hex carry a
#: checksum and count only if it is right.
KINDS = ["assign", "access", "hex", "prefixed", "xprv", "bech32"]

# Token formats with an embedded checksum.
PREFIXED = rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])"  # 30 characters, then their CRC-32
XPRV = rb"[xyzt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"  # Base58, double SHA-256
BECH32 = rb"(?:(?:AGE-SECRET-KEY-1)[02-9AC-HJ-NP-Z]{58}|nsec1[02-9ac-hj-np-z]{58})(?![A-Za-z0-9])"
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32_SET = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"

#: Keywords of the automaton, in lower case, and the kind they announce.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "prefixed", "gho_": "prefixed", "ghu_": "prefixed", "ghs_": "prefixed",
    "ghr_": "prefixed", "npm_": "prefixed",
    "xprv": "xprv", "yprv": "xprv", "zprv": "xprv", "tprv": "xprv",
    "age-secret-key-1": "bech32", "nsec1": "bech32",
}


def crc_token(body: bytes) -> bool:
    """30 characters and, as six digits to the base 62, their CRC-32."""
    rest, digits = zlib.crc32(body[:30]), bytearray()
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits.insert(0, BASE62[digit])
    return bytes(digits) == body[30:]


def base58check(word: bytes) -> bool:
    """Base58 whose last four bytes begin the double SHA-256 of the others."""
    value = 0
    for c in word:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    raw = bytes(len(word) - len(word.lstrip(b"1"))) + raw
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32(word: bytes) -> bool:
    """Bech32 with its six-character checksum."""
    prefix, _, data = word.lower().rpartition(b"1")
    values = [c >> 5 for c in prefix] + [0] + [c & 31 for c in prefix]
    values += [BECH32_SET.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


class Scanner:
    """Finds the spans of one text; built once per task."""

    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.words.add_word(word, (len(word), kind))
        self.words.make_automaton()
        self.patterns = {
            "assign": re.compile(ASSIGN, re.I),
            "access": re.compile(ACCESS),
            "prefixed": re.compile(PREFIXED),
            "xprv": re.compile(XPRV),
            "bech32": re.compile(BECH32),
        }
        self.hex = re.compile(HEX)
        self.digits = frozenset(b"0123456789abcdef")
        # Any run of 24 has three neighbours among every eighth byte.
        self.sample = bytes(104 if c in b"0123456789abcdef" else 46 for c in range(256))
        self.near_hex = re.compile(b"hhh+")

    def _valid(self, kind: str, found: re.Match) -> bool:
        if kind == "assign":
            return len(found[2]) >= LEAST_ASSIGN
        if kind == "access":
            return len(found[0]) >= LEAST_ACCESS
        if kind == "prefixed":
            return crc_token(found[1])
        return base58check(found[0]) if kind == "xprv" else bech32(found[0])

    def _keyword_spans(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        hits = sorted(
            (end - length + 1, kind)
            for end, (length, kind) in self.words.iter(raw.lower().decode("latin-1"))
        )
        free = dict.fromkeys(KINDS, 0)  # a match uses its characters up, whether it counts or not
        for start, kind in hits:
            if start >= free[kind] and (found := self.patterns[kind].match(raw, start)):
                free[kind] = found.end()
                if self._valid(kind, found):
                    yield kind, start, found.end()

    def _hex_spans(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        done = 0
        for near in self.near_hex.finditer(raw[::8].translate(self.sample)):
            for at in range(near.start() * 8, near.end() * 8, 8):
                if at < done:
                    continue
                start = at
                while start > done and raw[start - 1] in self.digits:
                    start -= 1
                done = self.hex.match(raw, start).end()
                if done - start >= LEAST_HEX:
                    yield "hex", start, done

    def spans(self, raw: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, ordered by start, then kind."""
        found = [*self._keyword_spans(raw), *self._hex_spans(raw)]
        found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        if raw.isascii() or not found:
            return found
        at, points, where = 0, 0, {}
        for byte in sorted({b for _, s, e in found for b in (s, e)}):
            points += len(raw[at:byte].decode("utf-8", "replace"))
            at, where[byte] = byte, points
        return [(kind, where[s], where[e]) for kind, s, e in found]


SCHEMA = "spans array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``spans``: (kind, start, end) in code points, end exclusive.

    One pass over the whole texts, no shuffle. An automaton of keywords runs over the text in lower
    case; a kind's pattern is tried only where one of its keywords begins. Hexadecimal runs have no
    keyword: every eighth byte is looked at, and the pattern is tried where three neighbours are
    digits. Kinds with an embedded checksum count only if it is right. Matches of a kind don't
    overlap, the leftmost wins, and one that fails its check still uses its characters up.

    Null and empty texts have no spans. Rows are not changed, repeated or dropped; a column called
    ``spans`` gives way to the result, others may have any name.
    """
    own = Own(docs, ["spans"], keep)
    n, names = len(own.kept), [*own.columns, "spans"]
    source = own.table.select(*own.columns, F.col(own[text]).alias("text"))
    output = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(raw)]
                for raw in texts(batch.column(n))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, output)], names=names)

    return own.restore(source.mapInArrow(scan, own.types() + SCHEMA), "spans")
