"""BPE by dynamic programming over prefixes: encoding and decoding with a word-end vocabulary.

For every prefix of a word there is one token that its encoding ends in. A token that ends at a prefix is
that last token exactly if the encoding of what stands before it ends in a token that it is compatible
with, or if nothing stands before it. An automaton over the vocabulary gives the tokens that end at each
place, the one that passes is stored, and the stored tokens followed backwards are the word's ids. No
merge loop runs.

Two tokens are compatible if no merge would have crossed their border while their own merges were made.
Merges are applied in order of rank, so the symbols that touch the border, each from the rank that makes
it to the rank that uses it up, decide that alone.

A null or empty text has no ids and decodes to the empty text. Texts of any length are encoded whole, row
by row; repeated words are looked up in a bounded table that is emptied when full. Repeated rows each get
theirs, of tokens that end at one place only one passes, a null id stays null, an empty table gives an
empty result, and extra columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from .common import chunks, map_texts

#: The splitting rule of the vocabulary; the other forms are for texts below U+0100 and for lower-case ASCII ones.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
SPLIT_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)

WORD_END = "\0"  # stands for the word-end suffix inside this module; no byte character is like it
NEVER = 1 << 60
#: Bounds of what a coder keeps between texts: words, the code points of one of them, and pair tests.
CACHE_WORDS, CACHE_WORD, CACHE_PAIRS = 400_000, 64, 4_000_000

#: The vocabulary's normaliser but for blanks, which never reach a word. Character tables differ between versions of
#: Unicode, so letters, numbers, case and composition are the library's.
NORMAL = Sequence([NFC(), Lowercase()])


#: Fixed value: the code points with the White_Space property.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def splitter() -> re.Pattern:
    """The splitting rule with letters and numbers by the library's own character tables."""
    every = "".join(chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000)  # no letter or number stands beyond

    def ranges(kind: str) -> str:
        found = Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(every)
        return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in found)

    return re.compile(SPLIT.format(letters=ranges(r"\p{L}"), numbers=ranges(r"\p{N}"), spaces=SPACES))


@functools.cache
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixCoder:
    """Encoder and decoder for a BPE vocabulary file with byte characters and a word-end suffix."""

    def __init__(self, path: str):
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        model = held["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = lambda token: token.removesuffix(suffix) + WORD_END if suffix and token.endswith(suffix) else token
        self.token_of: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.token_of |= {i: t for t, i in self.special.items()}
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        ids = model["vocab"]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[left + right]
            self.pair_rank[ids[left], ids[right]] = rank
            self.parts.setdefault(made, (ids[left], ids[right], rank))
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for token in sorted(ids.values(), key=lambda t: self.parts[t][2] if t in self.parts else -1):
            if token in self.parts:
                left, right, rank = self.parts[token]
                whole[token] = whole.get(left, False) and whole.get(right, False) and self.apart(left, right, rank)
            else:
                name = self.inner(self.token_of[token])
                whole[token] = len(name.removesuffix(WORD_END)) == 1
            if whole[token]:
                name = self.inner(self.token_of[token])
                self.automaton.add_word(name, (len(name), token))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def edge(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        """The symbols at the token's right (side 1) or left (0) border, each with the rank that uses it up."""
        found = [(token, until)]
        while token in self.parts:
            rank = self.parts[token][2]
            token = self.parts[token][side]
            found.append((token, rank))
        return found

    def apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """True if no merge crosses the border between the two before the rank ``until``."""
        ends = self.edge(right, 0, until)
        for a, a_until in self.edge(left, 1, until):
            for b, b_until in ends:
                rank = self.pair_rank.get((a, b))
                # of equal pairs the first goes first: one that ends in a is before this, one that starts with b is after
                if rank is not None and rank < a_until and (rank <= b_until if b_until < until else rank < until):
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one split word in byte characters, its last token marked as the word's end."""
        size = len(word)
        last = [-1] * (size + 2)  # by the place after the prefix
        length = [0] * (size + 2)
        fits = self.fits
        for end, (n, token) in self.automaton.iter(word + WORD_END):
            before = last[end + 1 - n]
            if before >= 0:
                fit = fits.get((before, token))
                if fit is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    fit = fits[before, token] = self.apart(before, token)
                if fit:
                    last[end + 1], length[end + 1] = token, n
            elif end + 1 == n:
                last[n], length[n] = token, n
        ids, at = [], size + 1
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no encoding for {word!r}")
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return splitter().findall(NORMAL.normalize_str(text))
        return SPLIT_LATIN.findall(text.lower())

    def coded(self, word: str) -> tuple[bytes, bytes]:
        """The ids, little-endian, and the decoded text of a split word."""
        symbols = word if word.isascii() and word.isprintable() else "".join(byte_characters()[b] for b in word.encode())
        ids = self.encode_word(symbols)
        return array("I", ids).tobytes(), self.decode(ids).encode()

    def coded_words(self, text: str) -> list[tuple[bytes, bytes]]:
        words, known = self.split(text), self.words
        found = list(map(known.get, words))
        if None in found:
            for k, pair in enumerate(found):
                if pair is None:
                    word = words[k]
                    pair = known.get(word)
                    if pair is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        pair = self.coded(word)
                        if len(word) <= CACHE_WORD:
                            known[word] = pair
                    found[k] = pair
        return found

    def parts_of(self, text: str) -> list[tuple[bytes, bytes]]:
        if self.special_split is None or "<" not in text or not self.special_split.search(text):
            return self.coded_words(text)
        found, at = [], 0
        for m in self.special_split.finditer(text):
            found += self.coded_words(text[at : m.start()])
            found.append((self.special[m[0]].to_bytes(4, "little"), m[0].encode()))
            at = m.end()
        return found + self.coded_words(text[at:])

    def encode(self, text: str) -> list[int]:
        raw = b"".join(p[0] for p in self.parts_of(text))
        return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]

    def decode(self, ids: list[int]) -> str:
        """The tokens with blanks between them: the file names no decoder that would join them otherwise."""
        return " ".join(self.token_of[i] for i in ids)


@functools.cache
def coder(path: str) -> PrefixCoder:
    return PrefixCoder(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string), one row for each input row."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for ids, texts in chunks(batches):
            coded = [own.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(coded, pa.list_(pa.int32())), pa.array([own.decode(c) for c in coded])], ["id", "ids", "decoded"])

    return map_texts(df, id_col, text_col, run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encoding_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the same ids and decoded text, made where they are."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = coder(path), hashlib.sha256
        for ids, texts in chunks(batches):
            rows = []
            for text in texts:
                parts = own.parts_of(text)
                raw = b"".join(p[0] for p in parts)
                rows.append((len(raw) // 4, digest(raw).hexdigest(), digest(b" ".join(p[1] for p in parts)).hexdigest()))
            n, coded, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(df, id_col, text_col, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op4_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
