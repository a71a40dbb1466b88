import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from engramlake.llm import bpe
from cases import empty, odd, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENC = bpe.encoder(PATH)


def ids(text):
    return np.frombuffer(ENC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehintrsABEZ '.,!19 \n\t\x1c\x85\x00éİΣσ中😀<|>½ª"), max_size=80))
def test_ids_equal_the_librarys(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["ab", "the", "instrohe", "!?.", "é", "lo"])
def test_long_words_stream(letters):
    rng = random.Random(letters)
    for n in (257, 1000, 5000):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert ids(word) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_added_tokens_in_the_text():
    text = "a<|endoftext|>b <|startoftext|>"
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_transducer_memory_is_constant():
    machine = bpe.Transducer(ENC.v)
    held = 0
    for _ in range(50):
        machine.push(ENC.v.symbols("ther" * 64))
        held = max(held, len(machine.buffer))
    assert held <= 5 * ENC.v.lookahead + 256


def test_lookahead_of_a_small_list():
    # a+b; then b+c takes b away from it only if it ranks earlier
    assert bpe.sufficient_lookahead([("a", "b")], len) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")], len) == 2


def test_lookahead_is_sufficient():
    v = ENC.v
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("therinsaoul") for _ in range(400))
        symbols = v.symbols(word)
        whole = v.merge([*symbols[:-1], v.last_symbol[symbols[-1]]])
        cut = v.merge(symbols[:300])
        done, stable = 0, []
        for t in cut:
            if done + v.length[t] > 300 - v.lookahead:
                break
            stable.append(t)
            done += v.length[t]
        assert whole[: len(stable)] == stable


def test_memo_never_changes_ids():
    small = bpe.Encoder(ENC.v, 3, 3)
    for text in ("the cat the dog the bird a b c d e", "the the dog", "x" * 300 + " the", "the", "x" * 300):
        assert small.encode(text) == ENC.encode(text)


def test_decoding_in_pieces():
    text = "Ünïcode and 中文 text, split anywhere!"
    data = ENC.encode(text)
    pieces = [data[i : i + 4] for i in range(0, len(data), 4)]
    for form in ("joined", "plain"):
        dec = bpe.Decoder(ENC.v, form)
        apart = "".join(map(dec.push, pieces)) + dec.close()
        assert apart == dec.push(data) + dec.close()
        assert "中文" in apart if form == "plain" else apart == LIBRARY.decode(np.frombuffer(data, "<u4").tolist(), skip_special_tokens=False)


def test_a_split_character_waits():
    dec = bpe.Decoder(ENC.v, "plain")
    whole = [ENC.v.ids[ENC.v.alphabet[b]].to_bytes(4, "little") for b in "é中".encode()]
    assert [dec.push(x) for x in whole] == ["", "é", "", "", "中"] and dec.close() == ""
    assert dec.push(whole[0]) + dec.close() == "\ufffd"


@pytest.mark.parametrize("text", ["中文字符" * 60, "line\none\n" * 40, "a" * 500, "=-" * 200, "12" * 200, "x'sy't" * 60, "aéİb" * 80, "e\u0301" * 150, "한국어" * 80 + "\u1100\u1161" * 50, "中 文" * 50, "ab=cd12" * 60])
def test_blocks_without_blanks_stay_small(text, monkeypatch):
    monkeypatch.setattr(bpe.word_blocks, "__defaults__", (20,))
    blocks = list(bpe.word_blocks(text))
    assert "".join(b for b, _ in blocks) == text
    if not set(text) & set("'İ\u0301\u1161"):
        assert len(text) < 100 or max(len(b) for b, _ in blocks) <= 60
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abeIİ'streΣσ中文é\u0301=.<|1234 \u1100\u1161"), max_size=60))
def test_cuts_inside_words_change_nothing(text):
    before = bpe.word_blocks.__defaults__
    bpe.word_blocks.__defaults__ = (4,)
    try:
        assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    finally:
        bpe.word_blocks.__defaults__ = before


def test_every_word_goes_through_the_transducer(monkeypatch):
    class Broken(bpe.Transducer):
        def close(self):
            raise RuntimeError("used")

    monkeypatch.setattr(bpe, "Transducer", Broken)
    with pytest.raises(RuntimeError, match="used"):
        bpe.Encoder(ENC.v).encode("word")


def test_documents(spark):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(odd(spark), PATH).collect())
    want = []
    for r in odd_rows():
        x = LIBRARY.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0] or -1, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(empty(spark), PATH).count() == 0
