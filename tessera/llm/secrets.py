"""Secret scans: base patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a run of token characters with both letters and digits, or of letters whose case
changes as often as in random ones.  What base spans cover is cut out of it.  A window of
``WINDOW`` characters slides over what is left; the counts of its characters, and with them its
entropy, are kept up step by step.  Each character class (hexadecimal, alphanumeric,
base 64, letters) has its own threshold.  What the allow-list matches is suppressed: whole candidates
that are UUIDs, dates and versions, names in words, or call themselves an example; and windows that
hold filler (four or more zeros or x).  The method's spans have the kind
``entropy`` and never overlap a base span.

A regular expression inside Spark first finds the texts that may hold anything; only
those go to Python, whole.

Defined results: a null or empty text has no spans; very long texts are scanned whole;
repeated rows, and rows with a null id, each have their own result; an empty table gives no rows; other columns are kept by
``redact`` and not read by ``scan``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, map_rows, read
from .spans import Span, digest, joined, masked

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: the same matches as runs of any length, the short ones dropped
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A text that this does not find has neither base matches nor candidates.
WORTH = r"[A-Za-z0-9+/_=-]{20}|[:=][\x20]*[\x22']?[A-Za-z0-9+/_.=-]{6}"

WINDOW = 20
#: Bits a character, by class, from which a window counts; a window has at most log2(WINDOW) = 4.32.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.6, "letters": 3.9}
#: Of the neighbours in a candidate of letters, the share that changes case, from which it looks random.
CASES = 0.3
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUIDs
    r"|[0-9TZ_=+/-]+"  # dates and numbers
    r"|([A-Za-z]+[-_/=])*[A-Za-z]+[-_/=]?[0-9]{1,4}"  # names with a number at the end
    r"|.*(EXAMPLE|example).*"
)
FILLER = re.compile("0{4,}|X{4,}|x{4,}")
_TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def hot_stretch(run: str, threshold: float, window: int = WINDOW) -> tuple[int, int] | None:
    """First start and last end of the windows whose entropy reaches the threshold."""
    counts: dict[str, int] = {}
    total, found = 0.0, None
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        if i >= window - 1 and math.log2(window) - total / window >= threshold:
            found = (found[0] if found else i - window + 1, i + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def kind_of(run: str) -> str | None:
    """The class of a candidate's characters; None if it looks like words or a number."""
    if any("0" <= c <= "9" for c in run):
        if not any(c.isalpha() for c in run):
            return None
        return "hex" if re.fullmatch("[0-9a-fA-F]+", run) else "alnum" if run.isalnum() else "base64"
    changes = sum(a.isupper() != b.isupper() for a, b in zip(run, run[1:], strict=False))
    return "letters" if run.isalpha() and changes >= CASES * len(run) else None


def left_over(start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches of start:end outside the spans that a window fits into."""
    out, at = [], start
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a < end and b > at:
            out.append((at, a))
            at = b
    return [(a, b) for a, b in [*out, (at, end)] if b - a >= WINDOW]


def entropy_spans(text: str, base: list[Span]) -> list[Span]:
    out: list[Span] = []
    for m in CANDIDATE.finditer(text):
        if ALLOWED.fullmatch(m[0]):
            continue
        filler = [("filler", m.start() + f.start(), m.start() + f.end()) for f in FILLER.finditer(m[0])]
        near = [s for s in base if s[1] < m.end() and m.start() < s[2]]
        for a, b in left_over(*m.span(), near + filler):
            run = text[a:b]
            kind = kind_of(run)
            if kind and (hot := hot_stretch(run, THRESHOLDS[kind])):
                out.append(("entropy", a + hot[0], a + hot[1]))
    return out


def worth(text: Column) -> Column:
    """The text if it may hold a span, else null."""
    return F.when(text.rlike(WORTH), text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""

    def run(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")}
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            more = entropy_spans(text, base) if text else []
            for kind in BASE_KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(digest(base, KINDS))
            out["spans"].append(joined(base + more, KINDS))
            out["n_entropy"].append(len(more))
        return {"doc_id": batch.column("doc_id"), **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", worth(F.col("text")).alias("text")), run,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long",
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span of a secret masked; n_chars, where there is one, follows a changed text."""

    maybe = re.compile(WORTH)

    def mask(batch):
        import pyarrow as pa

        at, n = (batch.schema.get_field_index(c) for c in ("text", "n_chars"))
        texts, changed = batch.column(at).to_pylist(), {}
        for i, text in enumerate(texts):
            if text and maybe.search(text):
                base = base_spans(text)
                if spans := base + entropy_spans(text, base):
                    changed[i] = masked(text, spans)
        if not changed:
            return batch
        columns = list(batch.columns)
        columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
        if n >= 0:
            columns[n] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(batch.column(n).to_pylist())], batch.schema.field(n).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, mask)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
