"""Chat examples, URL rules, token files, packing and the pipeline, against plain versions of each."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from tachado.llm import chat, packing, tokenfiles, urls
from tachado.llm.encoding import Encoder
from tachado.llm.queries import RULES, vocabulary

TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "~1s> ~ ~~0 <s>", "[INST][/INST]</s><s>", "é<s>\n", "", None, "[/INST]"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", "a"), (2, 0, "assistant", "b"), (2, None, None, "c"), (3, 5, "user", "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "y"), (None, 0, "user", "z")]
    got = {r.conv_id: r for r in chat.digest(chat.expand(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS example", "'x' AS formatted"))).collect()}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.expand(spark.createDataFrame(rows, TURNS))
    for r in examples.where("loss_start IS NOT NULL").collect():
        assert r.formatted[r.loss_end:] == chat.TAIL
    assert chat.digest(chat.expand(spark.createDataFrame([], TURNS))).count() == 0


def brute_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else None
    if rest is None:
        return "", "", None
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, path = rest[:end].lower() if rest[:end].isascii() else rest[:end], rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_url_rules(spark):
    addresses = [None, "", "no scheme", "http://", "http://x.com", "http://A.COM/", "https://example.com/en/1", "https://www.Example.com/en/", "http://notexample.com/en/",
                 "http://a.net/es/1?q=/fr/", "http://b.net/fr/#x", "http://net/fr/", "http://c.org?x=1/2#y", "x://y://z/en/", "http://example.com/enx"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(addresses)] + [(5, "http://A.COM/", "h", "v")], "page_id bigint, url string, host string, verdict string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = urls.judge(pages, none, RULES).collect()
    assert len(rows) == len(addresses) + 1
    for r in rows:
        host, path, fit = brute_verdict(addresses[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit and fit[0], fit[1] if fit else "allow")
    assert urls.judge(pages.limit(0), none, RULES).count() == 0


def test_url_rules_mined(spark):
    rows = [(i, f"http://{'pills' if i % 4 == 0 else 'fine'}.shop.org/{'buy' if i % 8 < 4 else 'read'}/{i}") for i in range(400)]
    bad = {i: i % 4 == 0 and i % 8 < 4 for i in range(400)}
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(not bad[i]), 0) for i in range(0, 300)], "doc_id bigint, quality int, toxic int")
    mined = urls.mine(pages.join(labels, pages.page_id == labels.doc_id).selectExpr("url", "quality = 0 AS bad"), 0.05, 0.9).collect()
    assert [r["items"] for r in mined] == [["host=pills", "path=buy"]]
    got = urls.judge(pages, labels, [], min_support=0.05, min_confidence=0.9).collect()
    assert {r.page_id: r.verdict == "block" for r in got} == bad
    # Brute force over all pairs of tokens: what the miner found is what holds often enough.
    counts: dict = {}
    for i, u in rows[:300]:
        for pair in itertools.combinations(sorted({f"host={h}" for h in u.split("/")[2].split(".")} | {f"path={p}" for p in u.split("/")[3:]}), 2):
            n, b = counts.get(pair, (0, 0))
            counts[pair] = n + 1, b + bad[i]
    strong = {p for p, (n, b) in counts.items() if b / 300 >= 0.05 and b / n >= 0.9}
    assert ("host=pills", "path=buy") in strong and all({"host=pills", "path=buy"} & set(p) for p in strong)


TEXTS = ["It's a test, isn't it?  1234 x²", "", None, "plain words and plain words", "ÉTÉ à l'école ßtraße", "tab\t\tnew\nline  end ", "日本語 mixed İstanbul", "<|endoftext|> a", "a" * 3000,
         "don't 'S 'ts 12.5e-3 ...'re", "nbsp\u00a0x \u0301e\u0301", "\x0b\x1c odd"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_exact(name, monkeypatch):
    from tachado.llm import encoding

    monkeypatch.setattr(encoding, "KEPT", 10)  # most cuts are not kept
    encoder = Encoder(vocabulary(name))
    for _ in range(2):
        for text, got in zip(TEXTS, encoder.encode(TEXTS)):
            assert np.frombuffer(got, "<u2").tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def documents(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), TEXTS[int(rng.integers(len(TEXTS)))]) for i in rng.permutation(60)] + [(None, "null id"), (7, "again"), (7, "again")]
    return rows, spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, ids int, key string")


def test_token_files(spark):
    rows, df = documents(spark)
    file, encoder = vocabulary("word_bpe_49k.json"), Encoder(vocabulary("word_bpe_49k.json"))
    got = tokenfiles.read(spark, tokenfiles.write(df, file, 1), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    want = sorted(encoder.encode([t])[0] + b"\x01\x00" for _, t in rows)
    assert sorted(np.frombuffer(r.ids, "<u4").astype("<u2").tobytes() for r in got) == want
    assert tokenfiles.read(spark, tokenfiles.write(df.limit(0), file, 1)).count() == 0


@pytest.mark.parametrize("size", [8_000_000, 500])
def test_packing(spark, monkeypatch, size):
    monkeypatch.setattr(packing.ranges, "__defaults__", (size,))
    rows, df = documents(spark)
    file, encoder = vocabulary("byte_bpe_50k.json"), Encoder(vocabulary("byte_bpe_50k.json"))
    got = packing.pack(df, file, 0, 64).collect()
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    lengths = []
    for k in sorted(sequences):
        at = 0
        for r in sorted(sequences[k], key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4
            at += r.length
        lengths.append(at)
    assert all(n == 64 for n in lengths[:-1]) and sorted(sequences) == list(range(len(lengths)))
    flat = [r for k in sorted(sequences) for r in sorted(sequences[k], key=lambda r: r.offset)]
    texts, own = [], b""
    for r in flat:
        assert r.start == len(own) // 4
        own += r.ids
        if len(own) // 4 == r.doc_tokens:
            texts.append((r.doc_id, np.frombuffer(own, "<u4").astype("<u2").tobytes()))
            own = b""
    assert sorted(texts, key=str) == sorted(((i, encoder.encode([t])[0] + b"\0\0") for i, t in rows), key=str)
    assert packing.pack(df.limit(0), file, 0).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    order = np.argsort(packing.hilbert(grid, 3))
    assert sorted(packing.hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()
