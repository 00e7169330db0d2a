"""Fingerprints in one pass over ranges against a plain loop."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

from headwater.llm import imatch as M


def plain_parts(text, terms, subsets=M.SUBSETS):
    """Which of the sorted terms each subset holds, hashed as a list; subsets drawn term by term."""
    m = M.Matcher([], subsets)
    own = sorted({t for t in re.findall(r"[^\W\d_]+", text.lower())})
    banded = [t for t in own if t in set(terms)]
    if not banded:
        return [("all", tuple(own)) if own else ("text", text)] * (subsets + 1)
    draw = lambda t, k: int(M.mix(np.array([xxhash.xxh64_intdigest(t)], np.uint64) ^ m.seeds[k])[0]) >> 32
    return [tuple(t for t in banded if draw(t, k) < int(m.least[k])) or None for k in range(subsets + 1)]


def plain_likeness(a, b):
    either = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in either) / len(either) if either else float(a == b)


def brute(rows, terms):
    """By id: lengths, digests and both kinds of likeness, and the parts as lists of terms."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest(r[1], 42)).view(np.int64)), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = (tuple(plain_parts(x, terms)) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return out


def holds(found, want):
    """Equal rows, with fingerprints equal exactly where the lists of terms are."""
    found = sorted(((*r[:3], round(r[5], 9), round(r[6], 9), *r[3:5]) for r in found), key=str)
    want = sorted(((*r[:3], *r[5:], *r[3:5]) for r in want), key=lambda r: str(r[:5]))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    known, back = {}, {}
    for f, w in zip(found, want, strict=True):
        for shown, parts in zip(f[5:], w[5:], strict=True):
            assert known.setdefault(shown, parts) == parts and back.setdefault(parts, shown) == shown


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen = Counter(w for _, t in rows for w in set(M.terms_of(t or "")))
    terms = sorted(w for w, n in seen.items() if max(2, M.LEAST_SHARE * len(rows)) <= n <= max(2, M.MOST_SHARE * len(rows)))
    assert M.lexicon(docs) == terms
    holds(M.op3_imatch(spark, sf_dir).collect(), brute(rows, terms))


def test_edits_stay_near_and_other_texts_far(spark):
    rows = M.op3_imatch(spark, "/root/testdata/sf0.01").collect()
    near, far = np.array([r["near_edited"] for r in rows]), np.array([r["near_next"] for r in rows])
    places = np.concatenate([near, far]).argsort().argsort().astype(float)
    for v in np.unique(np.concatenate([near, far])):
        places[np.concatenate([near, far]) == v] = places[np.concatenate([near, far]) == v].mean()
    n = len(rows)
    assert (places[:n].sum() - n * (n - 1) / 2) / n**2 > 0.98


def test_hot_and_missing_ids_keep_the_order(spark):
    texts = [f"alpha beta w{k} " * (k % 5 + 1) for k in range(90)]
    rows = [(7, t) for t in texts[:40]] + [(None, t) for t in texts[40:70]] + [(k, t) for k, t in enumerate(texts[70:])] + [(7, "same")] * 5 + [(1 << 62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            ids = docs.selectExpr("doc_id AS id", "xxhash64(coalesce(text, '')) AS h")
            sizes = [r["count"] for r in ids.groupBy(M.buckets(ids, parts).alias("b")).count().collect()]
            assert max(sizes) < 45 or parts == 1
            holds(M.fingerprint_with_next(docs, ["alpha", "beta"]).collect(), brute(rows, ["alpha", "beta"]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 2)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    terms = ["long", "words", "here", "a", "b"]
    found = M.fingerprint_with_next(awkward, terms).collect()
    holds(found, brute(rows, terms))
    clash = awkward.selectExpr("*", "n_chars AS h", "lang AS bucket", "source AS ahead", "n_chars AS id")
    holds(M.fingerprint_with_next(clash, terms).collect(), brute(rows, terms))
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_id[5] == by_id[6] and len(by_id[6]) == 1
    assert M.fingerprint_with_next(nothing, terms).isEmpty() and M.lexicon(nothing) == []


def test_one_row_is_its_own_successor(docs_of):
    row = M.fingerprint_with_next(docs_of([(5, "abcdefgh")]), []).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_edited_terms_equal_those_of_the_edited_text():
    for text, after in (("alpha beta gamma delta", "omega psi"), ("abc", ""), ("", "x"), ("aaaa bbbbbbbbbbbbbbbbbbbbbb", "zz yy"), ("x" * 40, "y" * 3)):
        own, edited_terms, edited = M.edited_terms(text, after)
        assert own == set(M.terms_of(text)) and edited_terms == set(M.terms_of(edited)) and edited == text[: len(text) - len(text) // 4] + after[: len(text) // 4]
