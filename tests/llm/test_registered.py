"""The registered queries over the whole small tables, against the tokenizer libraries and brute force."""

import hashlib
import os
import re
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from clickstrata.llm import html_text, spot_signatures
from clickstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def _sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_packing(spark, texts):
    library, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, t in texts.items():
        ids = array("I", [*library.encode(t, add_special_tokens=False).ids, 0])
        expected |= {(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    out = _rows(spark, "op1_best_fit_packing")
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == expected and len(out) == len(expected)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(held) <= 1.01 * sum(r.length for r in out) / 2048 + 1


def _signatures(text):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    content = [(a if a in spot_signatures.ANCHORS else None, b) for a, b in zip(words, words[1:], strict=False) if b not in spot_signatures.ANCHORS]
    found = {(anchor, b, c) for (anchor, b), (_, c) in zip(content, content[1:], strict=False) if anchor is not None}
    return found or ({" ".join(words)} if words else set())


def _likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spot_signatures(spark, texts):
    ids = sorted(texts, reverse=True)
    out = {r.doc_id: r for r in _rows(spark, "op2_spot_signatures")}
    assert set(out) == set(texts)
    prints = {}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - n] + texts[after][:n]
        r, own, changed = out[i], _signatures(t), _signatures(edited)
        assert (r.n_chars, r.edited_sha256) == (len(t), _sha(edited.encode()))
        assert abs(r.near_edited - _likeness(own, changed)) < 1e-9 and abs(r.near_next - _likeness(own, _signatures(texts[after]))) < 1e-9
        for print_, signed in ((r.fingerprint, own), (r.edited_fingerprint, changed)):
            assert prints.setdefault(print_, signed) == signed
    assert len(prints) == len({frozenset(s) for s in prints.values()})


def test_quality_rules(spark, texts):
    for r in _rows(spark, "op3_quality_rules"):
        t = texts[r.doc_id]
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        held = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = len({k + j for k in range(len(words) - 7) if held[tuple(words[k : k + 8])] > 1 for j in range(8)})
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, failed)
        assert not (r.kept and r.base_failed)


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in texts.items())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in _rows(spark, "op4_token_counts")) == expected


def test_toxicity(spark, texts):
    out = _rows(spark, "op5_toxicity")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_simhash(spark, texts):
    def fingerprint(t):
        words = [w.encode() for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))]
        held = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(x, 42) for x in held]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in _rows(spark, "op6_simhash")) == [(i, f"{prints[i]:016x}", root(i)) for i in ids]


def test_bpe_round_trip(spark, texts):
    library, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i in sorted(texts):
        ids = library.encode(texts[i], add_special_tokens=False).ids
        expected.append((i, len(ids), _sha(array("I", ids).tobytes()), _sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, QUERIES["op7_bpe_round_trip"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == expected


def test_repeated_substrings(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(hashlib.blake2b(x[k : k + 400], digest_size=12).digest() for x in raw.values() for k in range(len(x) - 399))
    for r in _rows(spark, "op8_repeated_substrings"):
        x, gone = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for k in range(len(x) - 399):
            if count[hashlib.blake2b(x[k : k + 400], digest_size=12).digest()] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(x), sum(gone), spans, _sha(kept))
        assert kept.isascii() is False or r.text == kept.decode()


def test_html_text(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = _rows(spark, "op9_html_text")
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        lines = [x for x, kind in html_text.blocks(pages[r.page_id].html or "") if kind != html_text.LEFT_OUT]
        assert all(x in lines for x in r.text.split("\n\n") if x)
