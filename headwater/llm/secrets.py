"""Secret scanning: an Aho-Corasick keyword prefilter, anchored patterns near its hits, checksums inside tokens.

Kinds ``assign``, ``access`` and ``hex`` are the base kinds. ``forge``, ``registry`` and ``wallet`` are
token formats that carry their own checksum, so a look-alike whose checksum is wrong is not reported.

A null or empty text has no spans. A repeated row gives its spans again, row for row. A text of any length
is scanned whole: every step is linear and the largest state is one text. Spans that start together are
ordered by kind. A null id stays null, an empty table gives an empty result, and extra columns are never read;
redaction keeps the columns of ``documents``, a null text null.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_texts, slices

#: What an assignment's name contains, and how keys and tokens start (lower case).
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
FORGE_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
REGISTRY_WORD = "npm_"
WALLET_WORD = "xprv"

#: Base kinds in the order that breaks ties between spans with one start; added kinds follow.
KINDS = ("assign", "access", "hex", "forge", "registry", "wallet")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WALLET = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")

LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

#: Every byte of the hexadecimal class becomes "x" and any other one a blank, so a run is a plain substring.
HEX_VIEW = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))
HEX_KEY = b"x" * LEAST_HEX
HEX_RUN = re.compile(b"x+")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD,)), ("forge", FORGE_WORDS), ("registry", (REGISTRY_WORD,)), ("wallet", (WALLET_WORD,))):
        for word in words:
            found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def base62(number: int, width: int) -> str:
    digits = ""
    while number:
        number, rest = divmod(number, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(width, "0")


def crc_token_ok(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    return base62(zlib.crc32(body.encode()), 6) == check


def base58check_ok(text: str) -> bool:
    """The last four bytes are the start of the double SHA-256 of the rest."""
    number = 0
    for c in text:
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def find_secrets(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start and then by kind as listed in KINDS."""
    view = text.encode("ascii", "replace")  # a byte for each code point; "?" is in no pattern's classes
    plain = view.decode("ascii")
    spans: list[tuple[str, int, int]] = []
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in automaton.iter(view.lower().decode("ascii")))
    reached = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < reached[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(plain, start):
                reached[kind] = m.end()
                if len(m[1]) >= LEAST_VALUE:
                    spans.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS.match(plain, start):
                reached[kind] = m.end()
                if m.end() - start >= LEAST_ACCESS:
                    spans.append((kind, start, m.end()))
        elif kind == "wallet":
            if (m := WALLET.match(plain, start)) and base58check_ok(m[0]):
                reached[kind] = m.end()
                spans.append((kind, start, m.end()))
        elif (m := CHECKED.match(plain, start)) and crc_token_ok(m[1], m[2]):
            reached[kind] = m.end()
            spans.append((kind, start, m.end()))
    runs = view.translate(HEX_VIEW)
    at = runs.find(HEX_KEY)
    while at >= 0:  # the first hit of a run is at its start
        end = HEX_RUN.match(runs, at).end()
        spans.append(("hex", at, end))
        at = runs.find(HEX_KEY, end)
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for ids, texts in chunks(batches):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t, automaton)] for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(SPAN))], ["id", "spans"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, spans array<struct<kind,start,end>>) for each input row; one pass, no shuffle."""
    out = map_texts(df, id_col, text_col, _scan, "id long, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scan as counts by base kind, the SHA-256 of the base spans, and all spans as text."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(spans_text(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by one marker."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        clean = [None if t is None else redact(t, find_secrets(t, automaton)) for t in texts]
        arrays = [batch.column(0), pa.array(clean, pa.string()), *batch.columns[2:4]]
        sizes = [n if c == t else len(c) for n, c, t in zip(batch.column(4).to_pylist(), clean, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes, pa.int64())], batch.schema.names)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` with every secret replaced by its kind in brackets; all rows stay."""
    return map_texts(docs, "doc_id", "text", _redact, "doc_id long, text string, lang string, source string, n_chars long", "lang", "source", "n_chars")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))
