"""Words, features and new cuts of many texts at once, against one after the other."""

import random

import numpy as np
import xxhash

from tachado.llm import ngram_join, quality, words
from tachado.llm.encoding import Encoder, SHORT
from tachado.llm.queries import vocabulary

ODD = [None, "", "  ", "a", "A b", "İıſK ŉ", "x\x1cy\x85z\xa0w v", "_a_ a_b __ !!!!!? ......", "é²½ é", "\x00 \x00\x00", "long " * 3, "\x0b\x0c\r"]


def texts(n=400):
    draw = random.Random(7)
    return ODD + ["".join(draw.choice("aAbé_ \n\t\x0b\x1f.,!²中 ") for _ in range(draw.randrange(60))) for _ in range(n)]


def test_short_cuts_are_merged_as_the_tokenizer_does(monkeypatch):
    encoder, draw = Encoder(vocabulary("byte_bpe_50k.json")), random.Random(3)
    raw = ["".join(draw.choice("aeiouthsrnéÀ \n\t.,-=_<>{}0159ABCxyzÿ") for _ in range(draw.randrange(1, 40))) for _ in range(3000)]
    cuts = sorted({c for x in raw + ["a" * SHORT, "-" * SHORT, " " * 50, " thereof thththth", "é" * (SHORT // 2)] for c in encoder.cut.findall(x)})
    want, asked = encoder._encoded(cuts), []
    monkeypatch.setattr(Encoder, "_encoded", lambda self, some, own=Encoder._encoded: asked.extend(some) or own(self, some))
    assert encoder.encode(cuts) == want and asked == []
    long = ["é" * SHORT, "z" * (SHORT + 1), "q"]
    assert encoder.encode(long) == [b"".join(Encoder(vocabulary("byte_bpe_50k.json"))._encoded([x])) for x in long]
    assert Encoder(vocabulary("word_bpe_49k.json")).merges is None  # marks the ends of words, which merges alone do not


def test_shingles_of_many_texts(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 100)
    every = texts() + ["Ab c " * 300, "ab C " * 300, "ab c", "x" * 500 + " q", "X" * 500 + " Q"]
    split = [[w.lower() for w in (t or "").encode().split()] for t in every]
    hashes, counts = words.lowered(every)
    flat = [w for ws in split for w in ws]
    assert counts.tolist() == [len(ws) for ws in split] and len(hashes) == len(flat)
    assert len(set(zip(hashes.tolist(), flat))) == len(set(flat)) == len(set(hashes.tolist()))
    for size in (1, 3, 5):
        sets = [{tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set() for ws in split]
        got = ngram_join.shingles(every, size)
        assert [len(x) for x in got] == [len(x) for x in sets] and all((x[1:] > x[:-1]).all() for x in got)
        for i in range(len(every) - 1):
            assert len(np.intersect1d(got[i], got[i + 1])) == len(sets[i] & sets[i + 1])
    assert ngram_join.shingles([], 3) == []


def test_features_of_runs_are_those_of_the_text():
    known = quality.FeatureHashes()
    for t in texts():
        found = set(quality.TOKEN.findall((t or "").lower()))
        found |= {w[:4] + "*" for w in found if len(w) > 4}
        assert quality.features(t, known).tolist() == sorted(xxhash.xxh3_64_intdigest(w.encode()) for w in found)
    assert all(isinstance(x, bytes) for x in known.values())  # one look-up for a run, whatever features it has
