import random
import zlib
from array import array
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickstrata.llm import bytebpe, packing, token_counts
from clickstrata.llm.wordbpe import WordTokens

from .helpers import SCHEMA, corpus, frame, sorted_rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab'srtdlmve.ÄÖßſŸªµ 12²¼\t\n\x1c\x85\xa0\x0b—€’<|>&$Éİ́\x00\x7f  日ж\U0001f600")


def _texts(n=1500):
    rng = random.Random(2)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a<|endoftext|>b", "<|ENDOFTEXT|>", "'s don't I'll"]


def test_word_ids_equal_the_library():
    mine, library = WordTokens(WORD), Tokenizer.from_file(WORD)
    for text in _texts():
        assert list(array("I", mine.ids(text))) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_ids_equal_the_library_and_decode_back():
    mine, library = bytebpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    for text in [*_texts(), "&" * 3000, "abc" * 400, "the" * 200]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", mine.encode(text))) == ids, repr(text)
        assert mine.decode(mine.encode(text)) == library.decode(ids, skip_special_tokens=False) == text
    assert mine.decode(array("I", [mine.byte_ids[0xC3]]).tobytes()) == "�"


def test_round_trip_of_a_table(spark):
    library = Tokenizer.from_file(BYTE)
    expected = []
    for r in corpus():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], len(ids), sha256(array("I", ids).tobytes()).hexdigest(), sha256((r[1] or "").encode()).hexdigest()))
    assert sorted_rows(bytebpe.round_trip(frame(spark), BYTE)) == sorted(expected, key=repr)
    assert bytebpe.round_trip(frame(spark, []), BYTE).count() == 0
    assert bytebpe.encoded(frame(spark), BYTE).where("doc_id = 9").count() == 2


def test_counts_and_cache(spark, tmp_path):
    library = Tokenizer.from_file(WORD)
    expected = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus()), key=repr)
    cache = str(tmp_path / "cache")
    assert sorted_rows(token_counts.token_counts(frame(spark), WORD, cache)) == expected
    stored = token_counts.stored(spark, cache).count()
    assert stored == len({" ".join((r[1] or "").split()) if "<|" not in (r[1] or "") else r[1] for r in corpus()})
    assert sorted_rows(token_counts.token_counts(frame(spark), WORD, cache)) == expected
    assert token_counts.token_counts(frame(spark, []), WORD, cache).count() == 0
    assert token_counts.stored(spark, cache).count() == stored  # nothing was encoded again
    more = spark.createDataFrame([(1, "one  \n two", None, None, 1), (2, "something new", None, None, 1)], SCHEMA)
    assert sorted_rows(token_counts.token_counts(more, WORD, cache))[0][2] == 2
    assert token_counts.stored(spark, cache).count() == stored + 1


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # three open: the one with 8 closes
    assert bins.place(2) == (1, 7) and bins.place(4) == (0, 6) and bins.place(1) == (1, 9)
    assert (bins.count, bins.free_bits) == (0, 0)


@pytest.mark.parametrize("rows", [None, []])
def test_packing(spark, rows):
    out = [r.asDict() for r in packing.pack_documents(frame(spark, rows), WORD).collect()]
    if rows == []:
        assert out == []
        return
    tokens, per_sequence = WordTokens(WORD), {}
    for r in out:
        per_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in per_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(tokens.ids(r[1] or "")) // 4 + 1 for r in corpus())
    assert sum(r["length"] for r in out) == total and len(per_sequence) <= -(-total // 2048) + 1
    assert all(r["start"] == 2048 * r["piece"] for r in out)
    library, expected = Tokenizer.from_file(WORD), []
    for r in corpus():
        ids = array("I", [*library.encode(r[1] or "", add_special_tokens=False).ids, 0])
        expected += [(r[0], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(expected, key=repr)


def test_few_open_sequences_fill_well_in_runs():
    rng = random.Random(4)
    lengths = [min(2048, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(packing.TASK_PIECES // 2)]
    bins, most = packing.OpenBins(packing.CAPACITY, packing.OPEN_BINS), 0
    for k in range(0, len(lengths), packing.RUN):
        for n in sorted(lengths[k : k + packing.RUN], reverse=True):
            bins.place(n)
            most = max(most, bins.count)
    assert most == packing.OPEN_BINS < packing.RUN < packing.TASK_PIECES and bins.closed > 0
    assert bins.made <= 1.01 * sum(lengths) / packing.CAPACITY


def test_packing_deals_many_tasks(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "1 + id * 7919 % 2048 AS length", "'x' AS extra")
    out = packing.best_fit(pieces, task_pieces=1000)
    sums = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert out.count() == 5000 and out.rdd.getNumPartitions() == 5 and max(r[1] for r in sums) <= 2048
    assert len(sums) <= 1.02 * sum(r[1] for r in sums) / 2048
    again = packing.best_fit(pieces, open_bins=3, task_pieces=10_000).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert len(again) > len(sums)
