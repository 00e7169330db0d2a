"""Base measures against plain counting; bands on plain and on odd text."""

import base64
import functools
import math
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from headwater.llm import fertility as R

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "*", " ", " ", "\n", "\x0b", "\x1c", "a b a b a b a b ", "中"]), max_size=60).map("".join))
def test_base_measures(text):
    assert R.measure_text(text, R.models())[:5] == plain(text)


@functools.cache
def libraries():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sentencepiece.SentencePieceProcessor(model_file=PATH), multi, {i: t for t, i in ranks.items()}


def plain_ratios(text):
    """Tokens, characters a token, fallback share and entropy by both libraries, from the definitions."""
    pieces, coder, bytes_of = libraries()
    piece, multi = pieces.encode(text), coder.encode_ordinary(text)
    whole = lambda raw: raw.decode("utf-8", "ignore").encode() == raw
    odd = sum(pieces.is_byte(i) and pieces.id_to_piece(i) != "<0x0A>" for i in piece), sum(not whole(bytes_of[i]) for i in multi)
    out = []
    for ids, k in zip((piece, multi), odd, strict=True):
        n = len(ids)
        out += [n, len(text) / n, k / n, -sum(c / n * math.log2(c / n) for c in Counter(ids).values())] if n else [0, None, None, None]
    return out


def plain_verdict(text, lang):
    """Whether both vocabularies' ratios lie in the bands."""
    if 2 * sum(ord(c) > 0x24F for c in text) > len(text):
        bands = [R.SCRIPT_BANDS["other"]] * 2
    elif (lang or "").lower() in R.LANGUAGE_BANDS:
        bands = [(m, R.MOST, lack, R.SHARE) for m, lack in R.LANGUAGE_BANDS[lang.lower()]]
    else:
        bands = [R.SCRIPT_BANDS["latin"]] * 2
    found = plain_ratios(text)
    for k, (least, most, lack, share) in enumerate(bands):
        n, chars, fallback, entropy = found[4 * k : 4 * k + 4]
        if not n:
            continue
        bits, root = math.log2(min(n, 1024)), math.sqrt(n)
        if not least - R.WIDTH - R.ERROR / root <= chars <= most + R.WIDTH + R.ERROR / root or fallback > share + R.SHARE_ERROR / root:
            return False
        if bits - entropy > lack - R.HALVING * (10 - bits) + R.ENTROPY_ERROR / root:
            return False
    return True


@pytest.mark.parametrize("text", ["the plain words of a line, and some more of them", "中文 é😀 and\nmore", "x", "a" * 3000, " \n"])
def test_ratios(text):
    found = R.measure_text(text, R.models())[5:-1]
    assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(found, plain_ratios(text), strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.sampled_from([1, 2, 4, 8]))
def test_repeat_words_of_any_width(words, width):
    times = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    assert R.repeat_words(words, width) == len({i + k for i in range(len(words) - width + 1) if times[tuple(words[i : i + width])] > 1 for k in range(width)})


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in R.op10_tokeniser_fertility(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lost, caught = 0, []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        found, want = rows[r["doc_id"]], plain(r["text"] or "")
        assert tuple(found[m] for m in R.MEASURES) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert found["base_failed"] == failed and found["kept"] == (not failed and plain_verdict(r["text"], r["lang"]))
        label = labels.get(r["doc_id"])
        lost += label == 1 and not failed and not found["kept"]
        caught += [not found["kept"]] if label == 0 and not failed else []
    assert lost <= 0.005 * len(labels) and sum(caught) >= 0.4 * len(caught)


def test_short_texts_have_a_verdict(spark):
    good, junk = "The kettle on the stove was warm and the old cat slept beside it while rain fell on the roof of the small house", " ".join(a + b + c for a, b, c in zip("zqxjkwvfpbgmzqxjkwvfpbgm", "qxzjwkfvbpmgxzjqwkvfbpgm", "xjzqkvwfgpbmjxqzvwkfpgmb", strict=True))
    rows = R.judge(R.measure(spark.createDataFrame([(1, good, "en"), (2, junk, "en")], "doc_id long, text string, lang string"))).collect()
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows}
    assert verdict == {1: (False, True), 2: (False, False)}


def test_awkward_rows(spark, awkward, nothing):
    rows = R.judge(R.measure(awkward.selectExpr("*", "lang AS n_words", "source AS script", "n_chars AS id"))).collect()
    assert len(rows) == 11 and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    unknown = awkward.withColumn("lang", awkward["source"].substr(9, 1))
    assert R.judge(R.measure(unknown)).count() == 11
    assert R.judge(R.measure(nothing)).isEmpty()
