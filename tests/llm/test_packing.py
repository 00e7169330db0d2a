"""Plans by hypothesis, encodings against the library, pieces and places by a plain check."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from headwater.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, capacity):
    """Best-fit decreasing, one by one: the number of sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 30), max_size=12))
def test_plan_places_every_rank_once(counts):
    capacity, used = 24, {}
    rows = P.plan(counts, capacity)
    for length, n in counts.items():
        own = sorted(r for r in rows if r[0] == length)
        assert sum(r[2] for r in own) == n and [r[1] for r in own] == list(np.cumsum([0, *[r[2] for r in own]])[:-1])
    for length, _, ranks, first, each, offset in rows:
        for k in range(ranks):
            used.setdefault(first + k // each, []).append((offset + k % each * length, length))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(used) == list(range(len(used)))
    assert len(used) <= best_fit([x for x, n in counts.items() for _ in range(n)], capacity)


def test_plan_does_not_grow_with_the_counts():
    few = {n: 50 + n % 7 for n in range(1, 2049, 3)}
    assert len(P.plan({n: c * 1000 for n, c in few.items()})) < 4 * len(P.plan(few)) + 2000


@pytest.mark.parametrize("text", ["", "Hello  world\n\n it's", "a<|endoftext|>b", "<|endoftext|>", "<|end", "中文 é\x00 　x", "  \n ", "1234 5678!!"])
def test_encoding_equals_the_library(text):
    coder = P.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert P.encode(coder, text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "\xa0" * 1_000_000, "x" + " " * 65_536 + "<|endoftext|>" + "\t" * 65_537 + " q", " " * 65_535 + "\x1c" + " " * 65_536 + "z", "a" * 300_000])
def test_long_runs_equal_the_library(text):
    coder = P.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert P.encode(coder, text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def check(rows, texts, capacity):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    by_doc, by_sequence, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        end = 0
        copies = len([p for p in pieces if p["piece"] == 0])
        total += len(ids) * copies
        for r in sorted(pieces, key=lambda r: (r["piece"]))[::copies]:
            assert r["start"] == end and r["ids_crc32"] == zlib.crc32(ids[end : end + r["length"]].tobytes()) and r["length"] <= capacity and (r["piece"] == 0 or r["length"] == capacity)
            end += r["length"]
        assert end == len(ids)
    for placed in by_sequence.values():
        end = 0
        for r in sorted(placed, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    return len(by_sequence), -(-total // capacity)


def test_query_is_whole_and_tight(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, least = check(P.op8_best_fit_packing(spark, sf_dir).collect(), texts, P.CAPACITY)
    assert n <= least + 1 + least // 50


def test_awkward_rows(awkward, nothing):
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    rows = P.pack(awkward, capacity=64).collect()
    check(rows, texts, 64)
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    assert P.pack(nothing).isEmpty()
    clash = awkward.selectExpr("*", "lang AS id", "n_chars AS length", "source AS part", "1 AS nth")
    check(P.pack(clash, capacity=64).collect(), texts, 64)


def test_a_million_blanks_are_packed(docs_of):
    texts = {1: "a" + " " * 1_000_000 + "b", 2: "c"}
    check(P.pack(docs_of(texts.items())).collect(), texts, P.CAPACITY)
