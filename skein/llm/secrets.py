"""Secret scans: fixed patterns, and strings on which a token vocabulary is inefficient.

Ordinary words are few tokens for their length under a byte-pair vocabulary; random
strings fall into short tokens. Every maximal run of ``[A-Za-z0-9+/_=-]`` of at least
16 characters is encoded, and a run with at most ``max_ratio`` characters a token is
reported, unless it is a known kind of digest or identifier (hex digests, UUIDs, numbers,
dates). Runs of letters only, and of letters or numbers of up to 4 digits between
separators, are encoded part by part and reported at ``max_wordy`` characters a token.

Defined cases: null text is empty and has no spans; each input row gives one row, so
repeated rows repeat; other columns are ignored; offsets count code points.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The base kinds in their order, pattern, and least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests (hex of the usual lengths), UUIDs, numbers and dates are known and no secrets by themselves.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9][0-9_/+-]*)", re.I)
#: Shaped like words: parts of letters, or of a few digits, between separators; they have a ratio of their own.
PART = re.compile(r"[A-Za-z0-9]+")
WORDY = re.compile(r"(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/+=]+(?:[A-Za-z]+|[0-9]{1,4}))*[-_/+=]*")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed kinds: (start, kind's number, end)."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a run of 16 or more is found whole by either pattern: the first start with enough characters is the run's own
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return out


def tokens(vocabulary: str):
    """The encoder of a rank file: a path, or a file name of the installed public tokenizers."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_spans(text: str, encode, max_ratio: float, max_wordy: float, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs on which the vocabulary is inefficient, beyond the spans already taken."""
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        if KNOWN.fullmatch(run):
            continue
        if WORDY.fullmatch(run):
            parts = PART.findall(run)
            if sum(map(len, parts)) > max_wordy * sum(len(encode(p)) for p in parts):
                continue
        elif len(run) > max_ratio * len(encode(run)):
            continue
        if not any(a < m.end() and m.start() < b for a, _, b in taken):
            out.append((m.start(), 3, m.end()))
    return out


def scan_text(text: str, encode, max_ratio: float, max_wordy: float) -> list[tuple[int, int, int]]:
    """All spans of a text: (start, kind's number, end), by start, then kind."""
    base = base_spans(text)
    return sorted(base + random_spans(text, encode, max_ratio, max_wordy, base))


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", max_ratio: float = 2.2, max_wordy: float = 2.0) -> DataFrame:
    """One row per document with its spans.

    ``vocabulary``: rank file of the token test; ``max_ratio``: most characters a token of a random string;
    ``max_wordy``: the same for strings shaped like words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(vocabulary).encode_ordinary
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = scan_text(text.as_py() or "", encode, max_ratio, max_wordy)
                base = [x for x in found if x[1] < 3]
                n = [sum(k == i for _, k, _ in found) for i in range(4)]
                rows.append((*n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64())] + [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
