"""Secret scans: certain finds by pattern, and weak parts of credentials that complete one another.

Certain ("base") finds need no company: assignments to a secret's name, access ids, long hexadecimal runs. Weak parts are
identifiers (user names, client ids, short access ids), secrets (short assigned values, mixed keys) and endpoints. An interval
join links them: each part reaches ``reach`` code points to both sides, but not beyond its scope, the paragraph. A weak
identifier and a weak secret are reported only if the other kind, weak or certain, lies in reach; an endpoint only if a reported
secret does. Joins use sorted interval ends, so a text with many parts costs n log n and no pairs are made.

Defined cases: a null text is an empty one and has no spans; places are code points, ends exclusive; a weak part that
overlaps a certain find is left out; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import documents, small_batches
from gaugework.llm.registry import query

REACH = 200
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Greedy runs: a run that is too short would fail anyway, so the length can be asked for at once.
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_SHORT = 12, 18, 6

WEAK_IDENTIFIER = re.compile(
    r"""(?:\b(?:user(?:_?name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9@._-]{3,})|\b((?:AKIA|ASIA)[A-Z0-9]{8,}))""", re.ASCII | re.IGNORECASE)
WEAK_KEY = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
ENDPOINT = re.compile(
    r"""\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""",
    re.ASCII | re.IGNORECASE)
SCOPE_END = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Certain finds, by start, then by kind in the order of ``KINDS``."""
    lower = text.lower()
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if any(n in lower for n in ASSIGN_NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def touched(parts: list[tuple[int, int]], others: list[tuple[int, int]], reach: int, scopes: np.ndarray) -> np.ndarray:
    """For each part, whether one of ``others`` overlaps its interval, widened by ``reach`` within its scope.

    ``scopes`` holds the starts of the scopes, the first being 0, and the end of the text.
    """
    if not parts or not others:
        return np.zeros(len(parts), bool)
    start, end = np.array(parts).T
    o_start, o_end = (np.sort(x) for x in np.array(others).T)
    scope = np.searchsorted(scopes, start, "right") - 1
    low = np.maximum(start - reach, scopes[scope])
    high = np.minimum(end + reach, scopes[np.minimum(scope + 1, len(scopes) - 1)])
    # others that start before the interval ends, less those that end before it starts
    return np.searchsorted(o_start, high, "left") > np.searchsorted(o_end, low, "right")


def mixed(value: str) -> bool:
    """Upper and lower case and digits: a key rather than a word."""
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)


def weak_parts(text: str, base: list[Span]) -> dict[str, list[tuple[int, int]]]:
    """Weak identifiers, secrets and endpoints that overlap no certain find; empty unless a pair can come about."""
    secrets = [m.span() for m in WEAK_KEY.finditer(text) if mixed(m.group())]
    lower = text.lower()
    if any(n in lower for n in ASSIGN_NAMES):
        secrets += [m.span() for m in ASSIGN.finditer(text) if MIN_SHORT <= m.end(2) - m.start(2) < MIN_ASSIGN]
    parts = {"identifier": [], "secret": secrets, "endpoint": []}
    if secrets or any(kind != "access" for kind, _, _ in base):
        parts["identifier"] = [m.span() for m in WEAK_IDENTIFIER.finditer(text)]
        parts["endpoint"] = [m.span() for m in ENDPOINT.finditer(text)]
    taken = [(s, e) for _, s, e in base]
    none = np.array([0, len(text) + 1])
    return {k: [p for p, t in zip(v, touched(v, taken, 0, none)) if not t] for k, v in parts.items()}


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts whose complement is in reach."""
    weak = weak_parts(text, base)
    if not any(weak.values()):
        return []
    scopes = np.array([0, *(m.end() for m in SCOPE_END.finditer(text)), len(text) + 1])
    sure_ids = [(s, e) for kind, s, e in base if kind == "access"]
    sure_secrets = [(s, e) for kind, s, e in base if kind != "access"]

    def kept(kind: str, others: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [p for p, t in zip(weak[kind], touched(weak[kind], others, reach, scopes)) if t]

    identifiers, secrets = kept("identifier", weak["secret"] + sure_secrets), kept("secret", weak["identifier"] + sure_ids)
    endpoints = kept("endpoint", secrets + sure_secrets)
    return [(k, s, e) for k, v in (("identifier", identifiers), ("secret", secrets), ("endpoint", endpoints)) for s, e in v]


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Certain finds, and all spans with the linked ones."""
    base = base_spans(text or "")
    return base, in_order(base + linked_spans(text or "", base, reach))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """``text`` with each maximal run of spans replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """Counts and places of secrets for every row."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                base, spans = scan(text, reach)
                kinds = [k for k, _, _ in base]
                found.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(),
                              joined(spans), len(spans) - len(base)))
            columns = list(zip(*found)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select(id_column, text_column).mapInArrow(rows, FOUND)


def without_secrets(docs: DataFrame, text_column: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with every span replaced by a mark; a null text stays null."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t, scan(t, reach)[1]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(rows, docs.schema)


@query("op8_credential_links")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.col("n_linked"))
