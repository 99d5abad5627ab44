"""Secret scans: fixed patterns, and random strings told by their token efficiency.

Patterns (leftmost, non-overlapping, per kind): `assign` (a password-like name, = or :, a value of six characters or more),
`access` (AKIA and upper-case letters or digits, 20 characters or more), `hex` (24 lower-case hex digits or more).

The method adds `random`: runs of 16 or more characters of [A-Za-z0-9+/_=-] are encoded by a byte-pair vocabulary; text
that such a vocabulary has seen takes three or more characters a token, a random string hardly two. A run of fewer than `LEAST`
characters a token is a secret, unless it is a known digest (hex of a digest's length, a UUID, sha256-... and the like) or an
identifier: only digits, or words of one case or capitals joined by _ - / or case changes. What lies before, between and
after the patterns' spans in a run is judged as runs are. A run that is no secret as a whole may hold some, joined to words:
its segments (see `segments`) are judged in the same way. Letters and digits need not both occur; but letters of one case are a word, whatever they spell.

A null or empty text has no spans; an empty table gives an empty result. Spans count code points, the end exclusive. Rows are scanned one by one, in whole;
repeated rows repeat, and extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pre-tokenisation pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAST = 2.2
RUN = 16
HEX = 24
ASSIGN = re.compile(rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
DIGEST = re.compile(
    rb"(?i)(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    rb"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|sha(?:256|384|512)-[A-Za-z0-9+/]{40,88}={0,2}"
)
DIGEST_PART = re.compile(rb"(?<![A-Za-z0-9])(?:" + DIGEST.pattern.removeprefix(b"(?i)") + rb")(?![A-Za-z0-9])", re.IGNORECASE)
PART = re.compile(rb"[A-Za-z0-9]+")
PADDING = re.compile(rb"=*")
#: Possessive, as a long run of one case would else be cut into words in every way.
IDENTIFIER = re.compile(rb"(?>[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++)(?>[-_/=+]*+(?>[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++))*+[-_/=+]*+|[0-9_/=+-]+")
#: Characters that are encoded at once: a vocabulary's time grows with the square of a word's length.
SLICE = 4096
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def load_encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def runs(mask: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask, cut at the rows' ends, of `least` or more."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offs] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last[:-1] &= ~mask[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= least
    return a[long], b[long]


def is_random(run: bytes, encoding, least: float = LEAST) -> bool:
    if DIGEST.fullmatch(run) or _words_only(run):
        return False
    return len(run) / len(_encode(run, encoding)) < least


def _encode(run: bytes, encoding) -> list[int]:
    text = run.decode()
    return [t for k in range(0, len(text), SLICE) for t in encoding.encode_ordinary(text[k : k + SLICE])]


def segments(run: bytes, encoding, least: float = LEAST) -> list[tuple[int, int]]:
    """The random segments of a run that is not random as a whole.

    A token counts `least` less its length, joining characters count nothing. Stretches of the highest sums, which hold
    the strings that take more tokens than words do, are widened to the joining characters about them if they stay random;
    then what is between joining characters is judged by itself. Known digests are left out first.
    """
    out: list[tuple[int, int]] = []
    at = 0
    for lo, hi in [*(m.span() for m in DIGEST_PART.finditer(run)), (len(run), len(run))]:
        if lo - at >= RUN:
            out += [(at + a, at + b) for a, b in _segments(run[at:lo], encoding, least)]
        at = hi
    return out


def _segments(run: bytes, encoding, least: float) -> list[tuple[int, int]]:
    fits = lambda a, b: b - a >= RUN and is_random(run[a:b], encoding, least)
    parts = [m.span() for m in PART.finditer(run)]
    starts, ends = [a for a, _ in parts], [b for _, b in parts]
    out: list[tuple[int, int]] = []
    for a, b in _stretches(run, encoding, least):
        first, last = starts[bisect_right(starts, a) - 1], ends[bisect_left(ends, b)]
        for x, y in ((first, last), (a, last), (first, b), (a, b)):
            if fits(x, y) and (not out or out[-1][1] <= x):
                out.append((x, y))
                break
    alone, taken = [], 0
    for a, b in parts:
        while taken < len(out) and out[taken][1] <= a:
            taken += 1
        if (taken == len(out) or out[taken][0] >= b) and fits(a, b):
            alone.append((a, b))
    return [(a, PADDING.match(run, b).end()) for a, b in sorted(out + alone)]


def _stretches(run: bytes, encoding, least: float) -> list[tuple[int, int]]:
    """All maximal scoring stretches of tokens, in order, by the linear algorithm of Ruzzo and Tompa."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum at the end, start, end, the nearest before of a lower sum before
    total, at = 0.0, 0
    for token in encoding.decode_tokens_bytes(_encode(run, encoding)):
        score = (least - len(token)) * bool(PART.search(token))
        before, total, start, at = total, total + score, at, at + len(token)
        if score <= 0:
            continue
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                break
            before, start = found[j][0], found[j][2]
            del found[j:]
        found.append((before, total, start, at, j))
    return [(a, b) for _, _, a, b, _ in found]


def _words_only(run: bytes) -> bool:
    """An identifier: words, capitals and short numbers, of which letters in words are the larger part; or single characters, joined."""
    if not re.search(rb"[A-Za-z0-9]{2}", run):
        return True
    if not IDENTIFIER.fullmatch(run):
        return False
    in_words = sum(len(w) for w in re.findall(rb"[A-Z]?[a-z]{3,}|[A-Z]{4,}", run))
    return 2 * in_words >= len(run) or not re.search(rb"[A-Za-z]", run)


def _all(data: bytes, word: bytes) -> Iterator[int]:
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + 1)


def spans_of_chunk(raw: np.ndarray, offs: np.ndarray, encoding, least: float = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """Row to its spans (start, kind, end), in bytes from the row's start."""
    data, found = raw.tobytes(), {}
    row_of = lambda at: int(np.searchsorted(offs, at, side="right")) - 1
    low = data.lower()
    rows = sorted({row_of(at) for name in NAMES for at in _all(low, name)})
    for row in rows:
        for m in ASSIGN.finditer(data[offs[row] : offs[row + 1]]):
            if len(m[2]) >= 6:
                found.setdefault(row, []).append((m.start(), 0, m.end()))
    for row in sorted({row_of(at) for at in _all(data, b"AKIA")}):
        for m in ACCESS.finditer(data[offs[row] : offs[row + 1]]):
            if len(m[0]) >= 20:
                found.setdefault(row, []).append((m.start(), 1, m.end()))
    for a, b in zip(*runs(_HEX[raw], offs, HEX), strict=True):
        row = row_of(a)
        found.setdefault(row, []).append((int(a - offs[row]), 2, int(b - offs[row])))
    a, b = runs(_IN_RUN[raw], offs, RUN)
    for x, y in zip(a, b, strict=True):
        row = row_of(x)
        start, end = int(x - offs[row]), int(y - offs[row])
        base = sorted((s[0], s[2]) for s in found.get(row, ()) if s[1] < 3 and s[0] < end and s[2] > start)
        at = start
        for s, e in [*base, (end, end)]:
            if s - at >= RUN:
                piece = data[offs[row] + at : offs[row] + s]
                inside = [(0, s - at)] if is_random(piece, encoding, least) else segments(piece, encoding, least)
                found.setdefault(row, []).extend((at + i, 3, at + j) for i, j in inside)
            at = max(at, e)
    for row, spans in found.items():
        text = raw[offs[row] : offs[row + 1]]
        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        found[row] = sorted((int(points[s]), k, int(points[e])) for s, k, e in spans)
    return found


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(path: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            m = batch.num_rows
            n = np.zeros((4, m), np.int64)
            digest, said = [none] * m, [""] * m
            for first, _, raw, offs in K.each_chunk(batch.column("text")):
                for row, spans in spans_of_chunk(raw, offs, encoding, least).items():
                    base = [s for s in spans if s[1] < 3]
                    for _, k, _ in spans:
                        n[k, first + row] += 1
                    digest[first + row] = hashlib.sha256(_say(base).encode()).hexdigest()
                    said[first + row] = _say(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n[0]), pa.array(n[1]), pa.array(n[2]), pa.array(digest), pa.array(said), pa.array(n[3])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    return run


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row per input row."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan(vocabulary, least), schema)
