"""Byte-level BPE of long runs without a gap, which are cut where no merge can join them."""

import random
import string
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from millrace.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe._Coder(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def own(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def run_of(letters, n):
    rng = random.Random(f"{letters}{n}")
    return "".join(rng.choice(letters) for _ in range(n))


def encoded(coder, run):
    return coder.encode(pa.array([[run]], pa.list_(pa.string())))[0]


ALPHABETS = [string.ascii_letters, string.ascii_lowercase, "abcdeéñøß", "漢字日本語学校生", "แมวกินปลา", "etaoin"]


@pytest.mark.parametrize("letters", ALPHABETS)
def test_runs_of_letters_equal_tiktoken(coder, own, letters):
    for n in (30, 65, 700, 1500):
        run = run_of(letters, n)
        assert encoded(coder, run) == np.array(own.encode_ordinary(run), "<u4").tobytes()


def test_parts_join_to_the_word_and_no_token_crosses_a_cut(coder):
    data = run_of(string.ascii_letters, 3000).encode()
    parts = coder._parts(data)
    assert b"".join(parts) == data and len(parts) > 1000
    at = 0
    for part in parts[:-1]:
        at += len(part)
        assert not any(data[a:b] in coder.ranks for a in range(max(0, at - 20), at) for b in range(at + 1, at + 21))


def test_time_of_random_letters_is_linear(coder):
    def seconds(n):
        run = run_of(string.ascii_letters, n)
        begun = time.perf_counter()
        encoded(coder, run)
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(160_000) < 12 * seconds(40_000)


def test_the_cache_is_bounded_by_bytes(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    for i in range(30):
        encoded(coder, f"unheardof{i}" * 40)
    assert coder.held < 5000 + 4 * (400 * 5 + bpe.ENTRY_BYTES) and len(coder.cache) < 30
