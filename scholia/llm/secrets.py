"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

A candidate is a long token whose characters fit an encoding (hex, base32 and base36 in either case, base58, base62, base64, and what
is left of them without a digit). Its symbols go through three tests of
randomness: chi-squared uniformity over the encoding's alphabet, runs above and below the middle of the alphabet, and serial
correlation of neighbours. For a random token the combined p-value is uniform on 0..1; words, paths and identifiers pile up near 0.
Within each class of encoding and length, the flat upper part of the p-values of the whole corpus tells how many random tokens
there are, and so which part of the tokens above a bound is false. The lowest bound whose false share and its error are at most
`FALSE_SHARE` is used. Short tokens have weak tests, so their class needs a higher bound or finds none. Thin classes are merged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import keyed_texts, slices

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs of 32 and more
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
WORDS = re.compile("passw|secret|token|api", re.I | re.A)

TOKEN_LEAST = 16
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,6}(?![A-Za-z0-9+/_=-])")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": "0123456789abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "letters26": _LOWER,
             "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "base62": _UPPER + _LOWER + _DIGITS,
             "base64": _UPPER + _LOWER + _DIGITS + "+/", "letters52": _UPPER + _LOWER, "letters54": _UPPER + _LOWER + "+/"}
# By number of cases and whether there is a digit: encodings from the narrowest. Random tokens that happen to fit a narrower alphabet
# are random in it too. Of one case, letters count in either.
NARROWEST = {(1, True): ("hex", "base32", "base36"), (1, False): ("letters26",),
             (2, True): ("base58", "base62", "base64"), (2, False): ("letters52", "letters54")}
_FITS = {name: frozenset(a if name not in ("hex", "base32", "base36", "letters26") else a.upper() + a.lower())
         for name, a in ALPHABETS.items()}
# Twentieths of the combined p-values of 240,000 simulated random tokens of 16 to 64 symbols: the tests are neither exact nor independent.
CALIBRATION = (0.0, 0.035, 0.085, 0.141, 0.198, 0.257, 0.317, 0.377, 0.435, 0.491, 0.547,
              0.602, 0.656, 0.706, 0.754, 0.8, 0.844, 0.887, 0.927, 0.965, 1.0)
BINS = 20
FALSE_SHARE = 0.05
THIN = round(FALSE_SHARE ** -2)  # fewer tokens than this have too large an error by themselves


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, in code points."""
    out = []
    if WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _body(token: str) -> str:
    return token.rstrip("=").replace("-", "+").replace("_", "/")


def encoding_of(token: str) -> str | None:
    """The narrowest alphabet that holds the token; none without letters, or with one case and `+-/_`."""
    body = set(_body(token))
    cases = (not body.isdisjoint(_UPPER)) + (not body.isdisjoint(_LOWER))
    return next((e for e in NARROWEST.get((cases, not body.isdisjoint(_DIGITS)), ()) if body <= _FITS[e]), None)


def randomness(token: str, encoding: str) -> float:
    """Combined p-value of the three tests under the hypothesis that the symbols are random."""
    body, alphabet = _body(token), ALPHABETS[encoding]
    if alphabet.islower() or alphabet.isupper():
        body = body.lower() if alphabet.islower() else body.upper()
    x = np.array([alphabet.index(c) for c in body], dtype=float)
    n, size = len(x), len(alphabet)
    # Chi-squared over cells with about two or more expected symbols; Wilson and Hilferty's normal form.
    cells = max(2, min(size, n // 2))
    seen = np.bincount((x * cells // size).astype(int), minlength=cells)
    share = np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    chi = float((((seen - n * share) ** 2) / (n * share)).sum())
    df = cells - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = 0.5 * math.erfc(z_chi / math.sqrt(2))
    up = x >= size / 2
    high, low = int(up.sum()), int(n - up.sum())
    if high and low:
        mean = 2 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z = (1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(var) if var > 0 else 0.0
        p_runs = math.erfc(abs(z) / math.sqrt(2))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / (d * d).sum()) if d.any() else 1.0
    p_serial = math.erfc(abs(r * n + 1) / math.sqrt(n) / math.sqrt(2))
    # Fisher's combination of three: chi-squared with six degrees of freedom.
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    combined = math.exp(-half) * (1 + half + half * half / 2)
    return float(np.interp(combined, CALIBRATION, np.linspace(0, 1, len(CALIBRATION))))


def length_class(n: int) -> int:
    """Lengths by half octaves."""
    return int(2 * math.log2(n))


def candidates(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding and length class, p-value) of tokens that fit an encoding."""
    out = []
    for m in TOKEN.finditer(text):
        if encoding := encoding_of(m[0]):
            out.append((m.start(), m.end(), f"{encoding}:{length_class(m.end() - m.start())}", randomness(m[0], encoding)))
    return out


def merged(histogram: dict[str, list[int]]) -> list[tuple[list[str], list[int]]]:
    """Classes with their counts, thin ones merged: neighbouring lengths of an encoding first, then encodings that are thin in all."""
    def add(a, b):
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]

    by_encoding: dict[str, list[tuple[int, str]]] = {}
    for name in histogram:
        encoding, _, length = name.partition(":")
        by_encoding.setdefault(encoding, []).append((int(length or 0), name))
    out, rest = [], ([], [0] * BINS)
    for _, classes in sorted(by_encoding.items()):
        groups: list[tuple[list[str], list[int]]] = []
        for _, name in sorted(classes):
            own = ([name], list(histogram[name]))
            if groups and sum(groups[-1][1]) < THIN:
                groups[-1] = add(groups[-1], own)
            else:
                groups.append(own)
        if len(groups) > 1 and sum(groups[-1][1]) < THIN:
            groups[-2:] = [add(groups[-2], groups[-1])]
        if sum(groups[0][1]) < THIN:
            rest = add(rest, groups[0])
        else:
            out += groups
    return [*out, rest] if rest[0] else out


def bounds(histogram: dict[str, list[int]], false_share: float = FALSE_SHARE) -> dict[str, float]:
    """Lowest p-value bound of each class above which the share of false tokens, and its standard error, come to at most `false_share`;
    none if no bound will do."""
    out = {}
    for names, counts in merged(histogram):
        half = BINS // 2
        flat = sum(counts[half:]) / (BINS - half)
        above, bound = 0, None
        for b in reversed(range(BINS)):
            above += counts[b]
            false = max(0.0, above - flat * (BINS - b))
            if above and false + math.sqrt(above) <= false_share * above:
                bound = b / BINS
        if bound is not None:
            out |= dict.fromkeys(names, bound)
    return out


def fitted_bounds(texts: DataFrame) -> dict[str, float]:
    """Bounds of the p-values from all candidates of the column `text`."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = {(name, min(BINS - 1, int(p * BINS)), xxhash.xxh64_intdigest(text[a:b]) - (1 << 63))
                    for text in part.column("text").to_pylist() for a, b, name, p in candidates(text)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64()))],
                                                 ["name", "bin", "token"])

    # Copies of a token count once. One row for each class and bin comes back: classes are encodings by half octaves of length.
    distinct = texts.select("text").mapInArrow(tally, "name string, bin int, token long").distinct()
    histogram: dict[str, list[int]] = {}
    for r in distinct.groupBy("name", "bin").count().collect():
        histogram.setdefault(r["name"], [0] * BINS)[r["bin"]] = r["count"]
    return bounds(histogram)


def all_spans(text: str, bound: dict[str, float]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed spans, and of tokens above the bound of their class that overlap none of them."""
    spans = base_spans(text)
    more = [(a, 3, b) for a, b, name, p in candidates(text)
            if name in bound and p >= bound[name] and not any(x < b and a < y for x, _, y in spans)]
    return sorted(spans + more)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `spans`, an array of (start, kind, end) sorted by start, then kind; kinds number `KINDS`.

    A token of the battery that overlaps a fixed span adds nothing. Null and empty texts have no spans; a corpus without candidates has
    the fixed spans only; repeated rows stay repeated; other columns are ignored.
    """
    found = keyed_texts(docs, id_col, text_col)
    bound = fitted_bounds(found)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = [[{"start": a, "kind": k, "end": b} for a, k, b in all_spans(text, bound)] for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out, spans_type)], ["doc_id", "spans"])

    return found.mapInArrow(mark, "doc_id long, spans array<struct<start:int,kind:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, the SHA-256 of their spans and all spans as text."""
    def written(spans):
        names = F.array(*(F.lit(k) for k in KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """`text` with its spans replaced; spans that overlap are replaced as one."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret of their text replaced by `mark`. Null texts stay null; other columns stay as they are."""
    bound = fitted_bounds(docs.where("text is not null"))

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t, all_spans(t, bound), mark) for t in texts.to_pylist()], pa.string())

    return docs.withColumn("text", redacted("text"))
