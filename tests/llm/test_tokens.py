"""BPE against the tokenizers library, packing against its own rules and a lower bound."""

import json
import random
import zlib

import numpy as np
import pytest

from strata.llm import bpe, packing
from strata.llm.base import texts
from strata.session import write_scratch
from tests.llm.conftest import ODD

PATH = bpe.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.definition_of(PATH))


STRANGE = [
    "", "  ", "a", "<|startoftext|>Hi<|endoftext|> <|endoftext|", "don't I'M we'll 'S's ''d", "ΑΣ ΣΑΣ.", "İI ẞ ǅ ﬁ É", "\x1c a\x1db\x85c\xa0d　e", "a" * 5000, "ab" * 3000,
    " 123 4５６ ½ Ⅷ ²", "​­﻿ x", "\x00of", "日本語 한국어 👍🏽", "é̟ ́", "1" * 300 + "x" * 17,
]


def test_encoding_equals_the_library(coder, library):
    rng = random.Random(1)
    letters = [*"abcdefgh'st!?.,<|> 12\n\t", "é", "ß", "Σ", "Ä", "漢", "字", "😀", "́", "\xa0"]
    rows = STRANGE + [t or "" for _, t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    for text, found in zip(rows, coder.encoded(rows)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(f[0] for f in found), "<u4").tolist() == ids, text
        assert " ".join(f[2] for f in found if f[2]) == coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_root_yields_the_leftmost_lowest_rank(coder):
    """Naive merging, one lowest pair at a time, gives the same tokens."""
    rank = {k: r for k, r in zip(coder.keys.tolist(), coder.ranks.tolist())}
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 40))).encode() for _ in range(300)]
    ids, counts = coder.encode_words([*words, b""])
    assert counts[-1] == 0
    for word, part in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        s = [int(coder.byte_ids[b]) for b in word[:-1]] + [int(coder.last_ids[word[-1]])]
        while True:
            pairs = [(rank.get(a * int(coder.base) + b, 1 << 60), i) for i, (a, b) in enumerate(zip(s, s[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                break
            r, i = min(pairs)
            s[i:i + 2] = [int(coder.merged[r])]
        assert part.tolist() == s


def test_small_caches_change_nothing(library):
    tiny, ids_only = bpe.Bpe(bpe.definition_of(PATH), 3), bpe.IdsOnly(bpe.definition_of(PATH), 3)
    rows = [f"word{i % 7} and <|endoftext|> more{i}" for i in range(50)]
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert [np.frombuffer(b"".join(f[0] for f in found), "<u4").tolist() for found in tiny.encoded(rows)] == want
    assert [np.frombuffer(b"".join(found), "<u4").tolist() for found in ids_only.encoded(rows)] == want


def test_unknown_settings_are_refused():
    spec = json.loads(bpe.definition_of(PATH))
    spec["model"]["byte_fallback"] = True
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(spec))


def test_documents_round_trip(docs, library):
    out = bpe.encode_documents(texts(docs(ODD)), PATH).collect()
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in ODD), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in out), key=repr) == want
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in out)
    assert bpe.encode_documents(texts(docs([])), PATH).count() == 0


def check_plan(histogram, size):
    plan = packing.make_plan(histogram, size)
    used = {}
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= size
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == histogram
    return sum(n for _, n in plan)


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once_and_pack_tightly(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([64, 2048]))
    lengths = np.clip(rng.lognormal(np.log(size / 5), 0.9, 6000).astype(int), 1, size)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    lower = -(-int(lengths.sum()) // size)
    assert lower <= check_plan(histogram, size) <= lower * 1.01 + 2


def test_plans_of_special_histograms():
    assert check_plan({}, 2048) == 0
    assert check_plan({2048: 5}, 2048) == 5
    assert check_plan({700: 1000}, 2048) == 500
    assert check_plan({1025: 7, 1023: 7}, 2048) == 7
    assert check_plan({1: 5000}, 2048) == 3


def test_best_fit_of_classes_equals_best_fit_one_by_one():
    rng = random.Random(3)
    for _ in range(100):
        size = 50
        items = sorted((rng.randrange(1, 50) for _ in range(rng.randrange(60))), reverse=True)
        free = []
        for x in items:
            fits = [i for i, f in enumerate(free) if f >= x]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= x
            else:
                free.append(size - x)
        assert sum(n for _, n in packing.best_fit_decreasing(np.bincount(items, minlength=size + 1) if items else np.zeros(size + 1, int), size)) == len(free)


def test_packing_is_gapless_and_whole(docs, library):
    rng = random.Random(4)
    rows = [(100 + i, "same text " * 20) for i in range(150)] + [(500 + i, "word " * rng.randrange(200)) for i in range(150)] + ODD
    size = 100
    out = packing.pack(write_scratch(packing.pieces(texts(docs(rows)), PATH, size), "pieces"), size).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), size):
            part = ids[at:at + size]
            want.append((i, at // size, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    total = sum(w[3] for w in want)
    assert len(by_sequence) <= -(-total // size) * 1.05 + 1


def test_packing_of_empty_table(docs):
    assert packing.pack_documents(texts(docs([])), PATH).count() == 0


def test_special_tokens_in_other_case_are_plain_text():
    coder = bpe.Bpe(bpe.definition_of(bpe.tokenizer_path()))
    assert coder.encode("<|STARTOFTEXT|>") == [27, 347, 993, 6659, 4160, 91, 285]
    assert coder.encode("a <|startoftext|> <|EndOfText|> <|endoftext|>").count(49407) == 1
    assert coder.encode("<|startoftext|>") == [49406]
