"""Quality rules from tokeniser fertility, with plain word and line counts beside them.

Two public vocabularies encode the whole text: pieces with byte fallback, and byte-level ones for many
languages, where a token that is no whole character is the fallback. For each, characters per token, the
share of fallback tokens and the entropy of the tokens are held against bands of the row's language, or of
its script where the language is unknown. A mean over few tokens says little, so every band widens by the
standard error, one over the root of the number of tokens: any text has a verdict, and a short one is only
rejected for what its length can't explain. One pass, no shuffle; a task holds one text's tokens.

A null text has no words and fails the base rules, as an empty one does. Repeated rows each get their row,
ties need no order, a text of any length is measured whole, a null id stays null, a null language is an
unknown one, an empty table gives an empty result, and extra columns are never read.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, chunks, map_texts
from .packing import encoder, ordinary

VOCABULARIES = ("piece", "multi")
#: By language, for each vocabulary, the least characters per token and the most bits that the
#: entropy of a text of 1,024 tokens or more may lack against the greatest that 1,024 tokens can have.
LANGUAGE_BANDS = {
    "en": ((2.64, 3.60), (2.65, 3.55)),
    "de": ((2.63, 3.80), (2.70, 3.70)),
    "fr": ((2.36, 3.85), (2.42, 3.75)),
    "es": ((2.30, 3.75), (2.44, 3.75)),
}
#: By script, the least and most characters per token, the most bits lacking, the most fallback share.
SCRIPT_BANDS = {"latin": (1.9, 6.0, 3.9, 0.3), "other": (0.25, 6.0, 5.0, 0.97)}
#: The most characters per token in a known language.
MOST = 6.0
#: Characters per token: how far a band reaches beyond its ends, for endless and for one token; a token's own deviation is 1.2.
WIDTH, ERROR = 0.02, 6.0
#: Bits that the entropy of a shorter text may lack less, for each halving of 1,024 tokens, and more, for one token.
HALVING, ENTROPY_ERROR = 0.6, 2.0
#: The most fallback share in a known language, and what one token adds.
SHARE, SHARE_ERROR = 0.2, 1.0

SYMBOLS = b"#*$%&|<>"
BLANKS = SPACES.encode()
WINDOW = 8
NOT_LATIN = re.compile("[^\x00-ɏ]")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = tuple(f"{m}_{v}" for v in VOCABULARIES for m in ("n_tokens", "chars_per_token", "fallback_share", "token_entropy"))


@functools.cache
def _models(piece: str, multi: str) -> list[tuple]:
    """Of each vocabulary: the text's ids, and which ids are fallbacks."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece)
    newline = pieces.piece_to_id("<0x0A>")  # a line end has no other piece, so it tells nothing
    coder = encoder(multi)

    def broken(i: int) -> bool:
        try:
            return not coder.decode_single_token_bytes(i).decode()
        except (UnicodeDecodeError, KeyError):
            return True

    return [
        (pieces.encode, np.array([pieces.is_byte(i) and i != newline for i in range(pieces.get_piece_size())])),
        (functools.partial(ordinary, coder), np.array([broken(i) for i in range(coder.n_vocab)])),
    ]


def models(piece: str | None = None, multi: str | None = None) -> list[tuple]:
    return _models(piece or public_tokenizers.path("piece_bpe_32k.model"), multi or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words, a power of two, which the text holds twice or more.

    Words are numbered, then pairs, then pairs of pairs, so equal numbers are equal windows.
    """
    index = defaultdict(count().__next__)
    codes = np.fromiter((index[w] for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    size = 1
    while size < width and len(codes) > size:
        _, codes = np.unique(codes[:-size] * len(words) + codes[size:], return_inverse=True)
        size *= 2
    n = len(words) - width + 1
    if n < 2:
        return 0
    twice = np.bincount(codes)[codes] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def ratios(ids: np.ndarray, n_chars: int, fallback: np.ndarray) -> tuple:
    """Tokens, characters per token, fallback share, entropy; null where there is no token."""
    n = len(ids)
    if not n:
        return 0, None, None, None
    counts = np.unique(ids, return_counts=True)[1]
    return n, n_chars / n, float(fallback[ids].mean()), float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def measure_text(text: str, vocabularies: list[tuple]) -> tuple:
    """MEASURES, then RATIOS, then the script."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    script = "other" if 2 * len(NOT_LATIN.findall(text)) > len(text) else "latin"
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    found = (x for encode, fallback in vocabularies for x in ratios(np.array(encode(text), np.int64), len(text), fallback))
    return (len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeat_words(words), *found, script)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", piece: str | None = None, multi: str | None = None) -> DataFrame:
    """(id, lang, MEASURES, RATIOS, script), one row for each input row. piece, multi: other vocabulary files."""
    kind = lambda c: ("long", pa.int64()) if c.startswith("n_") or c == "word_chars" else ("double", pa.float64())
    schema = "id long, lang string, " + ", ".join(f"{c} {kind(c)[0]}" for c in (*MEASURES, *RATIOS)) + ", script string"
    kinds = [*(kind(c)[1] for c in (*MEASURES, *RATIOS)), pa.string()]
    names = ["id", "lang", *MEASURES, *RATIOS, "script"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = models(piece, multi)
        for ids, texts, langs in chunks(batches):
            columns = zip(*(measure_text(t, held) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return map_texts(df, id_col, text_col, run, schema, lang_col).withColumnRenamed("id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def within_bands() -> Column:
    """True if the row's ratios under each vocabulary lie in the bands of its language, or else of its script."""

    def inside(vocabulary: str, least: float, most: float, lacking: float, share: float) -> Column:
        n = F.greatest(F.col(f"n_tokens_{vocabulary}"), F.lit(1))
        error, halvings = 1 / F.sqrt(n), 10 - F.log2(F.least(n, F.lit(1024)))
        width = WIDTH + ERROR * error
        chars, entropy = F.col(f"chars_per_token_{vocabulary}"), F.col(f"token_entropy_{vocabulary}")
        gap = 10 - halvings - entropy
        return chars.between(least - width, most + width) & (gap <= lacking - HALVING * halvings + ENTROPY_ERROR * error) & (F.col(f"fallback_share_{vocabulary}") <= share + SHARE_ERROR * error)

    def every(bands: list[tuple]) -> Column:
        first, second = (inside(v, *band) for v, band in zip(VOCABULARIES, bands, strict=True))
        return first & second

    rule = F.when(F.col("script") == "other", every([SCRIPT_BANDS["other"]] * 2))
    for lang, bands in LANGUAGE_BANDS.items():
        rule = rule.when(F.lower("lang") == lang, every([(chars, MOST, lacking, SHARE) for chars, lacking in bands]))
    return F.coalesce(rule.otherwise(every([SCRIPT_BANDS["latin"]] * 2)), F.lit(True))


def judge(measured: DataFrame) -> DataFrame:
    """The measures with base_failed and kept."""
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within_bands())


def op10_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    judged = judge(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", *RATIOS, "script")
