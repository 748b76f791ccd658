"""Operator 1: secrets in texts, by fixed patterns and by sliding-window entropy.

Two kinds of spans are found:

* base spans match one of three patterns (credential assignments, access keys, long hex strings);
* entropy spans come from candidate strings (runs of token characters).  Over each candidate slides a
  window of the length of its character class; the window's Shannon entropy is kept by counts that
  change by one character out and one in.  The union of windows above the class's threshold is a
  span, unless the allow list knows the candidate or a base span holds it.

Text stays whole; positions are code points and ends are exclusive.  A document is one row of work,
so no key can skew the scan and nothing is shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns, their least lengths, and the order of their kinds
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs of 32 or more, as [0-9a-f]+ would give them
KINDS = ("assign", "access", "hex", "entropy")
WORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: class: (window, least entropy in bits)
CLASSES = {"hex": (20, 3.0), "alnum": (20, 3.6), "base64": (20, 3.7), "letters": (24, 4.2)}
#: Candidates that are known not to be secrets.
ALLOW = [
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # a UUID
    re.compile(r".*(EXAMPLE|example|XXXX|xxxx|0123456789|abcdefgh).*"),  # placeholders
    re.compile(r"[A-Za-z]{2,}([_/+-][A-Za-z]{2,}|[_/+-][0-9]{1,4})+"),  # names and paths of words
    re.compile(r"[0-9_+=/-]+"),  # phone numbers, dates, card numbers
]
N_LOG_N = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def allowed(text: str) -> bool:
    """Whether the allow list knows a candidate: a ruler (one character again and again, but for marks
    at its ends) or one of ALLOW.  Linear in the length of the candidate."""
    return len(set(text.strip("+/_=-"))) <= 1 or any(a.fullmatch(text) for a in ALLOW)


def character_class(text: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", text):
        return "hex"
    if re.fullmatch(r"[A-Za-z]+", text):
        return "letters"
    return "alnum" if re.fullmatch(r"[A-Za-z0-9]+", text) else "base64"


def entropy_windows(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Maximal unions of windows whose entropy is ``least`` bits or more.

    The entropy of a window of w characters is log2(w) - sum(n log2 n) / w over the counts n of its
    characters; a step changes two counts.
    """
    counts: dict[str, int] = {}
    total, out = 0.0, []
    limit = window * (math.log2(window) - least) + 1e-9
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += N_LOG_N[n + 1] - N_LOG_N[n]
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total -= N_LOG_N[n] - N_LOG_N[n - 1]
        if i >= window - 1 and total <= limit:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then by kind."""
    found = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    starts, ends = [x for x, _, _ in base], list(itertools.accumulate((y for _, _, y in base), max))
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() and (s[1:].islower() or s.isupper()):
            continue  # a word: one case throughout, or a capital in front
        if allowed(s):
            continue
        window, least = CLASSES[character_class(s)]
        for a, b in entropy_windows(s, window, least):
            a, b = a + m.start(), b + m.start()
            before = bisect.bisect_right(starts, a)  # of the base spans that start no later, one ends last
            if not before or ends[before - 1] < b:
                found.append((a, 3, b))
    return found


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, by start and then by kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base))


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each maximal run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, _, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256,
    spans.  A null text counts as empty; neither has spans.  Nulls in and repeats of doc_id, ties,
    other columns and texts of any length make no difference; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            sums, joined = [], []
            for text in batch.column(1):
                spans = find_secrets(text.as_py())
                for k in range(4):
                    counts[k].append(sum(1 for x in spans if x[1] == k))
                sums.append(hashlib.sha256(_joined([x for x in spans if x[1] < 3]).encode()).hexdigest())
                joined.append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(joined, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` masked; all rows and all other columns stay."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redact(t, mask) if isinstance(t, str) else None)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
