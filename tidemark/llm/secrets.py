r"""Secret scans: keyword prefilter, anchored patterns near hits, embedded checks.

An Aho-Corasick automaton finds the keywords of all rules in one pass over the
lower-cased text; a rule's pattern is then tried only where its keyword stands,
anchored there.  Runs of hex digits have no keyword: one scan of their own.
Kinds with an embedded check (CRC-32, Luhn, mod 97, a decodable header) are
reported only where it holds.

Defined cases: a null text is empty and has no spans; offsets are code points,
ends exclusive; a failed match consumes its text like any other match of its
kind, so a keyword inside it starts nothing; equal rows give equal spans.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, table, text_or_empty

# The base patterns, and public token formats.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----\s([A-Za-z0-9+/=\s]+)-----END \1-----")
CARD = re.compile(r"(?:card|visa|mastercard|amex)(?:\x20?(?:no|number|nr))?\.?\x20*[:=#]?\x20*((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.I | re.A)
IBAN = re.compile(r"iban\x20*[:=]?\x20*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])", re.I | re.A)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: In the order that breaks ties of a start: the base kinds, then those with a check.
KINDS = ("assign", "access", "hex", "hub", "npm", "jwt", "pem", "card", "iban")
BASE_KINDS = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "hub": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
    "card": ("card", "visa", "mastercard", "amex"),
    "iban": ("iban",),
}


def crc_tail(token: str) -> bool:
    """The last six characters are the CRC-32, in base 62, of those between the prefix and them."""
    body, tail = token[4:-6], token[-6:]
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out == tail


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def jwt_header(token: str) -> bool:
    head = token.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def pem_body(body: str) -> bool:
    try:
        return base64.b64decode("".join(body.split()), validate=True)[:1] == b"\x30"  # a DER sequence
    except (binascii.Error, ValueError):
        return False


#: kind: pattern, the group of the span, and the test of the match.
RULES = {
    "assign": (ASSIGN, 0, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, 0, lambda m: len(m[0]) >= 16),
    "hub": (HUB, 0, lambda m: crc_tail(m[0])),
    "npm": (NPM, 0, lambda m: crc_tail(m[0])),
    "jwt": (JWT, 0, lambda m: jwt_header(m[0])),
    "pem": (PEM, 0, lambda m: pem_body(m[2])),
    "card": (CARD, 1, lambda m: luhn(m[1])),
    "iban": (IBAN, 1, lambda m: mod97(m[1])),
}


@cache
def keyword_automaton():
    import ahocorasick

    owners: dict[str, list[str]] = {}
    for kind, words in KEYWORDS.items():
        for w in words:
            owners.setdefault(w, []).append(kind)
    found = ahocorasick.Automaton()
    for w, kinds in owners.items():
        found.add_word(w, (len(w), tuple(kinds)))
    found.make_automaton()
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of KINDS."""
    # only U+0130 grows when lower-cased, so every offset stays the same
    lowered = text.replace("İ", "i").lower()
    starts: dict[str, set[int]] = {}
    for end, (n, kinds) in keyword_automaton().iter(lowered):
        for kind in kinds:
            starts.setdefault(kind, set()).add(end - n + 1)
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, at in starts.items():
        pattern, group, holds = RULES[kind]
        free = 0
        for start in sorted(at):
            if start < free:
                continue
            if m := pattern.match(text, start):
                free = m.end()
                if holds(m):
                    found.append((kind, *m.span(group)))
            elif kind == "jwt":  # what follows its run of characters fails every later start in the run, too
                free = JWT_RUN.match(text, start).end()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) of every whole text."""

    def rows(columns: list[list]) -> list[list]:
        ids, texts = columns
        return [ids, [[dict(zip(("kind", "start", "end"), s)) for s in find_secrets(t)] for t in texts]]

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])
    ddl = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), rows, schema, ddl)


def redacted(text: str) -> str:
    """The text with each span (overlapping ones as one) replaced by its first kind in brackets."""
    out, at, spans = [], 0, find_secrets(text)
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with the secrets of ``text`` replaced and ``n_chars`` as of the new text.

    A null text stays null; texts without secrets, and all other columns, stay as they are.
    """
    at = docs.columns.index("text")

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                texts = [None if t is None else redacted(t) for t in part.column(at).to_pylist()]
                columns = [*part.columns[:at], pa.array(texts, part.schema.field(at).type), *part.columns[at + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = docs.mapInArrow(hide, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))

    def text_of(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number_of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return spans.withColumn("base", base).select(
        "doc_id",
        *map(number_of, BASE_KINDS),
        F.sha2(text_of("base"), 256).alias("base_sha256"),
        text_of("spans").alias("spans"),
    )
