"""Personal data and keys by fixed patterns, the first in order winning where two touch."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (type, pattern, flags), in order of precedence. The first group, if there is one, is the value.
PATTERNS = [
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0),
    ("private_key", r"-----BEGIN (?:ENCRYPTED )?PRIVATE KEY-----[\s\S]*?-----END (?:ENCRYPTED )?PRIVATE KEY-----", 0),
    ("api_key", r"sk-(?:proj-|live-|test-)?[a-zA-Z0-9]{32,64}", 0),
    ("api_key", r"gh[pousr]_[A-Za-z0-9_]{36}", 0),
    ("api_key", r"xox[bpar]-[0-9]{10,13}-[0-9]{10,13}(?:-[a-zA-Z0-9]{24})?", 0),
    ("api_key", r"(?:sk|pk)_(?:live|test)_[0-9a-zA-Z]{24}", 0),
    ("aws_key", r"AKIA[0-9A-Z]{16}", 0),
    ("aws_key", r"""(?:aws[_-]?secret[_-]?access[_-]?key|aws_secret)[:\s=]+['"]?([a-zA-Z0-9/+=]{40})['"]?""", re.I),
    ("token", r"bearer\s+[a-zA-Z0-9_-]+(?:\.[a-zA-Z0-9_-]*)*", re.I),
    ("password", r"""(?:password|passwd|pwd)[:\s=]+['"]?([^'"]{3,}?)(?=['"]?(?:\s|$|[.!,?]))""", re.I),
    ("password", r"""pass[:\s=]+['"]?([^'"]{3,}?)(?=['"]?(?:\s|$|[.!,?]))""", re.I),
    ("token", r"""(?:token|auth_token|access_token)[:\s=]+['"]?([a-zA-Z0-9_-]{20,})['"]?""", re.I),
    ("token", r"\beyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*\b", 0),
    ("ssn", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", 0),
    ("credit_card", r"\b4\d{3}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b", 0),
    ("credit_card", r"\b5[1-5]\d{2}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b", 0),
    ("credit_card", r"\b3[47]\d{13}\b", 0),
    ("url_with_creds", r"https?:\/\/[^\s:@]+:[^\s@]+@[^\s/]+", re.I),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", re.I),
    ("phone", r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", 0),
    ("phone", r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}", 0),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0),
    ("ip_address", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0),
    ("api_key", r"""(?:api[_-]?key|apikey)[:\s=]+['"]?([a-zA-Z0-9_-]{32,64})['"]?""", re.I),
    ("api_key", r"\b[a-f0-9]{32,64}\b", re.I),
    ("api_key", r"\b[A-Za-z0-9+/]{32,64}={0,2}\b", 0),
]
COMPILED = [(kind, re.compile(p, f | re.A)) for kind, p, f in PATTERNS]


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) in order of place; a match that touches one of an earlier pattern or place is left out."""
    taken = bytearray(len(text))
    out = []
    for kind, p in COMPILED:
        for m in p.finditer(text):
            a, b = m.span(1) if p.groups and m[1] is not None else m.span()
            if b > a and not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, b, kind))
    return sorted(out)


def merged(first: list[tuple[int, int, str]], second: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Both detectors' spans, the first's winning where they touch."""
    return sorted([*first, *[s for s in second if not any(s[0] < b and a < s[1] for a, b, _ in first)]])


def detected(text: Column) -> Column:
    """Array of structs type, start, end, hash."""

    @F.pandas_udf("array<struct<type: string, start: int, end: int, hash: string>>")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            return [{"type": k, "start": a, "end": b, "hash": "sha256:" + hashlib.sha256(x[a:b].encode()).hexdigest()} for a, b, k in spans(x or "")]

        return s.map(one)

    return run(text)


def placeholder(kind: str, style: str) -> str:
    return {"bracket": f"[{kind.upper()}]", "asterisk": "***", "hash": "####"}[style]


def sanitised(text: Column, style: str = "bracket") -> Column:
    """The text with what is detected replaced."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if not x:
                return x
            out, at = [], 0
            for a, b, k in spans(x):
                out += [x[at:a], placeholder(k, style)]
                at = b
            return "".join([*out, x[at:]])

        return s.map(one)

    return run(text)
