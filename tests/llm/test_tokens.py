"""Byte-level BPE against tiktoken, packing against the tokenizers library."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from factloom.llm import bpe, packing

ODD = ["", " ", "\n\n \n", "a" * 3000, " " * 2000, "ab" * 3000, "it's we'll 'S don't", "日本語 text é\u0301 ß", "🙂🙂 end", "<|endoftext|> x", "\t\r\n\x0b\x0c\x00\x1c", "1234567890 ½²", "!!!???...---" * 50]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("abehinorstu  \né日𝒳'") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return ODD + made + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 80))) for _ in range(500)]


def test_encoding_equals_tiktoken_and_decodes(codec):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in texts():
        ids = codec.encode(text)
        assert array("I", ids).tolist() == reference.encode_ordinary(text), text
        assert codec.decode(ids, block=3) == text.encode()


def test_a_long_piece_fills_no_table(codec, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_STATES", 50)
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    assert array("I", own.encode(text + " end " + text)).tolist() == reference.encode_ordinary(text + " end " + text)
    assert len(own.machine.states) <= 101 and not any(len(p) > bpe.LONGEST_KEPT for p in own.pieces)


def test_utf8_machine_takes_any_cuts():
    rng, text = random.Random(2), "aé日🙂\n" * 40
    data = text.encode()
    for _ in range(50):
        m, out, at = bpe.Utf8Machine(), [], 0
        while at < len(data):
            n = rng.randint(1, 5)
            out.append(m.feed(data[at : at + n]))
            assert len(m.held) <= 3
            at += n
        assert "".join(out) + m.feed(b"", last=True) == text
    assert bpe.Utf8Machine().feed(b"\xff\xe6", last=True) == b"\xff\xe6".decode("utf-8", "replace")


def test_states_are_made_when_first_met(codec):
    fresh = bpe.Transducer(codec.ranks)
    assert len(fresh.states) == 1
    fresh.piece(b" transducer")
    assert 1 < len(fresh.states) < 40
    # lookahead is bounded: what is pending never grows with the text
    fresh.piece(b"ab" * 500)
    assert max(len(s[1]) for s in fresh.states) < 200


def test_op1(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "y"), (3, "Hello world", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode(df).collect()))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0] == (1, 0, empty, empty) and got[1] == (2, 0, empty, empty) and got[2] == got[3] and got[2][1] == 2
    assert bpe.encode(df, ids=True).where("doc_id = 3").first().ids == [15496, 995]
    assert bpe.encode(df.limit(0)).count() == 0


def test_words_equal_the_library():
    own, reference = packing.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    made = ["".join(rng.choice("ab '’sStTéÉßIİΣσ 12½²¹<|>_-–ÄÖªºµ÷×ĀőȺꞵ日\u0301\x1c\x85\xa0\n\t.€«»¿") for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    made += ["hello <|endoftext|> world", "a<|ENDOFTEXT|>b", "<|startoftext|><|endoftext|>", "<| endoftext|>", "é <|endoftext|> é"]
    for text in ODD + made + [chr(i) + "a" + chr(i) + " b" + chr(i) + "s '" + chr(i) for i in range(0x3000)]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text


def test_special_strings_are_special_tokens():
    ids = np.frombuffer(packing.Words(P.path("word_bpe_49k.json")).ids("hello <|endoftext|> world"), "<u4").tolist()
    assert ids == [3306, 49407, 1002]


def check_packing(pieces, sizes):
    """pieces: (doc, start, length, sequence, offset)."""
    seen, filled = {}, {}
    for doc, start, length, seq, offset in pieces:
        assert length > 0
        seen.setdefault(doc, []).append((start, length))
        filled.setdefault(seq, []).append((offset, length))
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == size
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    return filled


def test_plan_is_whole_gapless_and_unpadded():
    rng = random.Random(4)
    for n in (1, 2, 30, 400):
        sizes = [rng.choice([1, 5, 300, 2048, 2049, 9000, rng.randint(1, 4000)]) for _ in range(n)]
        pieces, made = packing.plan(sizes)
        filled = check_packing(pieces, sizes)
        assert sum(made) == sum(sizes) and len(filled) == len(made)


def test_plan_balances_cost():
    """Quadratic cost is spread: no full sequence costs over twice the mean where all documents are short."""
    rng = random.Random(5)
    pieces, made = packing.plan([rng.randint(1, 700) for _ in range(2000)])
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for s, c in cost.items() if made[s] == 2048]
    assert max(full) < 2 * sum(full) / len(full)


def test_op7(spark):
    reference = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(1, None), (2, ""), (3, "Hello world " * 3000), (3, "again"), (None, "no id"), (None, "no id"), (4, "x <|endoftext|> y"), (5, "long " * 200_000)]
    clash = ("start", "length", "offset", "sequence_id", "ids")  # names that the result has too
    df = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id long, body string, " + ", ".join(f"{c} string" for c in clash)).coalesce(1)
    got = packing.pack(df, text_col="body", ids=True).collect()
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == sorted((d or 0, len(reference.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    assert packing.pack(df.limit(0), text_col="body").count() == 0
