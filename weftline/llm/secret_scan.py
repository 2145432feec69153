"""Secret scan: three fixed patterns, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import slices, text_bytes

#: Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = (b"passw", b"secret", b"token", b"key")
KINDS = ("assign", "access", "hex", "entropy")

#: The candidates of the entropy pass, their parts ('=' ends a part, or pads it where no more characters follow) and, for
#: each class, (characters, window, least bits per character). Names and paths come closest where there are no digits: more bits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[^=]+(?:=+\Z)?")
CLASSES = (
    ("hex", re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)\Z"), 32, 3.0),
    ("base32", re.compile(r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+=*\Z"), 20, 3.5),
    ("base36", re.compile(r"(?=.*[0-9])(?=.*[a-z])[a-z0-9]+=*\Z"), 24, 3.7),
    ("base64", re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*\Z"), 24, 3.9),
    ("letters", re.compile(r"(?=.*[A-Z])(?=.*[a-z])[A-Za-z+/_-]+=*\Z"), 24, 4.1),
)
#: Shapes of whole parts that look random but are public: identifiers, digests that are named as such, paths, a vendor's sample
#: key. Placeholders and counted-up digits inside a part are left out, what stands beside them is measured.
ALLOWED = (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"sha(?:1|256|384|512)-[^=]*=*",
    r"[a-z-]+(?:/[A-Za-z0-9_.-]+){2,}",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLE(?:KEY)?",
)
PLACEHOLDERS = re.compile(r"EXAMPLE|example|PLACEHOLDER|placeholder|xxxx+|XXXX+|0123456789|1234567890|abcdefgh|ABCDEFGH")

LONG_RUN = 16
RUN_BYTES = np.zeros(256, bool)
RUN_BYTES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def entropy_spans(s: str, window: int, least: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``s`` whose entropy is at least ``least`` bits a character.

    The sum of c*log2(c) over the counts c is kept up to date as one character enters and one
    leaves, so a step costs the same for every window. Shorter strings have no window.
    """
    if len(s) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, out, most = 0.0, [], math.log2(window)
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += term[k + 1] - term[k] if k < window else 0.0
        counts[c] = k + 1
        if i >= window:
            old = s[i - window]
            k = counts[old]
            total += term[k - 1] - term[min(k, window)]
            counts[old] = k - 1
        if i >= window - 1 and most - total / window >= least - 1e-9:
            lo = i - window + 1
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """Entropy spans outside the base ones and the allow-list: of each part of a candidate, the pieces that neither covers."""
    out, taken = [], []
    for s, _, e in base:
        if taken and s <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], e))
        else:
            taken.append((s, e))
    n = 0
    for m in CANDIDATE.finditer(text):
        while n < len(taken) and taken[n][1] <= m.start():
            n += 1
        if allowed.fullmatch(m.group()):
            continue
        near = list(takewhile(lambda t: t[0] < m.end(), islice(taken, n, None)))
        for part in PART.finditer(m.group()):
            if allowed.fullmatch(part.group()):
                continue
            at, end = m.start() + part.start(), m.start() + part.end()
            gone = sorted(near + [(at + p.start(), at + p.end()) for p in PLACEHOLDERS.finditer(part.group())])
            for s, e in [*gone, (end, end)]:
                piece = text[at : min(s, end)] if s > at else ""
                for _, shape, window, least in CLASSES:
                    if len(piece) >= 20 and shape.match(piece):
                        out += [(at + lo, 3, at + hi) for lo, hi in entropy_spans(piece, window, least)]
                        break
                at = max(at, e)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _flags(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with a run of LONG_RUN candidate bytes; a run over a row's end counts for its first row at least."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = RUN_BYTES[raw]
    edge = np.diff(inside)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = hi - lo >= LONG_RUN
    out = np.zeros(len(offs) - 1, bool)
    for a, b in zip(np.searchsorted(offs, lo[long], "right") - 1, np.searchsorted(offs, hi[long] - 1, "right") - 1):
        out[a : b + 1] = True
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
_EMPTY = hashlib.sha256(b"").hexdigest()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row for each row of docs: counts per kind, the hash of the base spans, and all spans.

    A null text is empty and has no spans, a null id stays null, repeated rows give repeated results
    and other columns are ignored. Whole texts are scanned; a task holds one Arrow batch. ``allow``
    are patterns of whole candidates, or of their parts between '=', that the entropy pass leaves alone.
    """
    pattern = "|".join(f"(?:{a})" for a in allow) or r"(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile(pattern)
        for batch in batches:
            for part in slices(batch, 1):
                raw, offs = text_bytes(part.column(1))
                flagged, data = _flags(raw, offs), raw.tobytes()
                n, bounds = part.num_rows, offs.tolist()
                counts = [[0] * n for _ in KINDS]
                digest, spans = [_EMPTY] * n, [""] * n
                for i in range(n):
                    doc = data[bounds[i] : bounds[i + 1]]
                    low = doc.lower()
                    if not flagged[i] and not any(k in low for k in KEYWORDS):
                        continue
                    text = doc.decode("utf-8", "replace")
                    base = base_spans(text)
                    every = sorted(base + added_spans(text, base, allowed))
                    for _, k, _ in every:
                        counts[k][i] += 1
                    digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digest), pa.array(spans), pa.array(counts[3], pa.int64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
                )

    return docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)
