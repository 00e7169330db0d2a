"""Scans against the patterns run over the whole text, and checksums."""

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from headwater.llm import secrets as S

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
AUTOMATON = S._automaton()


def plain(text):
    found = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m)]
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


def base_of(text):
    return [s for s in S.find_secrets(text, AUTOMATON) if s[0] in BASE]


PARTS = st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "apikey", "AKIA", "akia", "=", ":", " ", '"', "'", "abcdef0123456789", "deadbeef" * 3, "XYZ123", "é", "ſecret", "\n", "-", "."])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert base_of(text) == plain(text)


def test_query_equals_the_patterns(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    n = 0
    for r in S.op9_secret_scan(spark, d).collect():
        spans = plain(texts[r["doc_id"]])
        n += len(spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in BASE)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert n


def forge(body):
    return "ghp_" + body + S.base62(zlib.crc32(body.encode()), 6)


def test_checksums_decide():
    good = forge("A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5")
    assert [s[0] for s in S.find_secrets(f"x {good}.", AUTOMATON)] == ["forge"]
    assert not S.find_secrets(f"x {good[:-1]}{'a' if good[-1] != 'a' else 'b'}", AUTOMATON)
    assert [s[0] for s in S.find_secrets("npm_" + good[4:], AUTOMATON)] == ["registry"]
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    number, key = int.from_bytes(raw, "big"), ""
    while number:
        number, rest = divmod(number, 58)
        key = S.BASE58[rest] + key
    assert key.startswith("xprv") and [s[0] for s in S.find_secrets(key, AUTOMATON)] == ["wallet"]
    assert not S.find_secrets(key[:-1] + ("2" if key[-1] != "2" else "3"), AUTOMATON)


def test_redaction_covers_overlaps():
    text = 'é token = "' + "0123456789abcdef" * 2 + '" ok'
    assert S.redact(text, S.find_secrets(text, AUTOMATON)) == 'é [assign]" ok'


def test_awkward_rows(awkward, nothing):
    rows = S.digest(S.scan_secrets(awkward)).collect()
    assert len(rows) == 11 and {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert S.digest(S.scan_secrets(nothing)).isEmpty()
    clean = S.redact_secrets(awkward)
    assert clean.columns == awkward.columns and sorted(map(str, clean.collect())) == sorted(map(str, awkward.collect()))
