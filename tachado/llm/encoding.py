"""Exact token ids of many texts with a public tokenizer, at the cost of one dictionary lookup per repeated word.

A tokenizer of the two known kinds cuts a text by a pattern and merges inside each cut, so equal cuts have equal ids.
Texts of plain and Latin letters are cut here and looked up.  New cuts of a byte-level tokenizer are merged here, all at
once; those of the other kind and long ones go to the tokenizer in batches, and so does, whole, every text with any other
character or a control string.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from types import ModuleType

import numpy as np

#: Characters on which Python's pattern classes, lower-casing and normal forms agree with the tokenizers'.
OTHER = re.compile(r"[^\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]|<\|")
#: Fixed by the tokenizers' own files, for those characters.
CUTS = {
    "word_bpe_49k.json": (True, re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")),
    "byte_bpe_50k.json": (False, re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")),
}
#: Entries kept per worker; what comes later is encoded once for each piece of a batch.
KEPT = 700_000


#: Bytes of a cut up to which it is merged here, and of cuts merged at once.
SHORT, GROUP = 60, 1 << 16
#: In place of a rank where a pair has none; ranks and a place below 64 go in 32 bits.
NONE = 1 << 20


class Merges:
    """The merges of a byte-level tokenizer for many cuts at once: in each round the first pair of least rank of every cut.

    That is what the tokenizer does with one cut after the other.  Pairs are looked up by a hash of both ids.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, others from 256 on
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.uint32)
        rank = {vocabulary[a] << 16 | vocabulary[b]: i for i, (a, b) in enumerate(pairs)}
        keys, ranks = np.array(list(rank), np.uint32), np.array(list(rank.values()), np.uint32)
        self.tables = []
        for factor in (2654435769, 2246822519, 3266489917, 668265263, 374761393, 2869860233, 3624381081):
            if len(keys):  # those whose place is taken go to a further table
                at = self._at(keys, factor)
                _, own = np.unique(at, return_index=True)
                table = np.full(1 << 18, 0xFFFFFFFF, np.uint32), np.full(1 << 18, NONE, np.uint32)
                table[0][at[own]], table[1][at[own]] = keys[own], ranks[own]
                self.tables.append((factor, *table))
                keys, ranks = np.delete(keys, own), np.delete(ranks, own)
        if len(keys):
            raise ValueError("pairs that no table holds")

    @classmethod
    def of(cls, file: str) -> Merges | None:
        """The merges in a tokenizer's file, or none if it does more than to merge the bytes of its pattern's cuts."""
        with open(file, encoding="utf-8") as f:
            known = json.load(f)
        model, before = known["model"], known.get("pre_tokenizer") or {}
        special = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or special or known.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or len(model["merges"]) >= NONE:
            return None
        return cls(model["vocab"], model["merges"])

    @staticmethod
    def _at(keys: np.ndarray, factor: int) -> np.ndarray:
        return (keys ^ keys >> np.uint32(15)) * np.uint32(factor) >> np.uint32(14)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, out = left << np.uint32(16) | right, np.full(len(left), NONE, np.uint32)
        for factor, key, rank in self.tables:
            at = self._at(keys, factor)
            np.copyto(out, rank[at], where=key[at] == keys)
        return out

    def encode(self, cuts: list[bytes]) -> list[bytes]:
        """The ids of each cut, which has from 1 to ``SHORT`` bytes."""
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        group = np.cumsum(sizes) // GROUP
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(cuts)]
        return [x for begin, end in zip(edges, edges[1:]) if begin < end for x in self._merged(cuts[begin:end], sizes[begin:end])]

    def _merged(self, cuts: list[bytes], sizes: np.ndarray) -> list[bytes]:
        ids, number, done = self.first[np.frombuffer(b"".join(cuts), np.uint8)], np.arange(len(cuts)), []
        start = np.cumsum(sizes) - sizes
        place = (np.arange(len(ids)) - np.repeat(start, sizes)).astype(np.uint32)
        rank = np.full(len(ids), NONE, np.uint32)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[start + sizes - 1] = NONE
        while len(number):
            key = rank << np.uint32(6) | place
            least = np.minimum.reduceat(key, start)
            over = least >= NONE << 6
            if over.any():
                out = np.repeat(over, sizes)
                done.append((ids[out], number[over], sizes[over]))
                ids, place, rank, key, number, sizes, least = (x[~y] for x, y in ((ids, out), (place, out), (rank, out), (key, out), (number, over), (sizes, over), (least, over)))
                start = np.cumsum(sizes) - sizes
                if not len(number):
                    break
            hit = np.flatnonzero(key == np.repeat(least, sizes))
            ids[hit] = self.made[least >> np.uint32(6)]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, place, rank = ids[keep], place[keep], rank[keep]
            order = np.arange(len(number))
            hit, start, sizes = hit - order, start - order, sizes - 1
            rank[hit] = NONE
            for left in (hit[hit < start + sizes - 1], hit[hit > start] - 1):
                rank[left] = self.ranks(ids[left], ids[left + 1])
        raw = np.concatenate([x[0] for x in done]).astype("<u2").tobytes()
        number, ends = np.concatenate([x[1] for x in done]), 2 * np.cumsum(np.concatenate([x[2] for x in done]))
        out: list[bytes] = [b""] * len(cuts)
        for i, begin, end in zip(number.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out[i] = raw[begin:end]
        return out


class Encoder:
    """Ids as little-endian unsigned 16-bit integers: the known vocabularies have fewer than 65,536."""

    def __init__(self, file: str):
        if sys.byteorder != "little":
            raise OSError("ids are written as they lie in memory, which must be little-endian")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{file} has more ids than 16 bits hold")
        self.lower, self.cut = CUTS.get(os.path.basename(file), (False, None))
        self.merges = Merges.of(file) if self.cut else None
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, file: str) -> Encoder:
        """The encoder of this worker, held outside of this class, which each task gets anew."""
        held = sys.modules.setdefault("_tachado_encoders", ModuleType("_tachado_encoders"))
        if not hasattr(held, file):
            setattr(held, file, cls(file))
        return getattr(held, file)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, cuts: list[str]) -> list[bytes]:
        if self.merges is None:
            return self._encoded(cuts)
        raw = [x.encode() for x in cuts]
        out = self.merges.encode([x if len(x) <= SHORT else b" " for x in raw])
        long = [i for i, x in enumerate(raw) if len(x) > SHORT]
        for i, ids in zip(long, self._encoded([cuts[i] for i in long]) if long else []):
            out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null."""
        out: list[bytes | None] = [None] * len(texts)
        cuts, whole = [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif self.cut is None or OTHER.search(text):
                whole.append(i)
            else:
                cuts.append((i, self.cut.findall(text.lower() if self.lower else text)))
        for i, ids in zip(whole, self._encoded([texts[i] for i in whole]) if whole else []):
            out[i] = ids
        seen: set[str] = set()
        for _, cut in cuts:
            seen.update(cut)
        known, full = self.known, len(self.known) >= KEPT
        new = [c for c in seen if c not in known]  # a difference of sets would walk all that is known
        known.update(zip(new, self._cuts(new)))
        get = known.__getitem__
        for i, cut in cuts:
            out[i] = b"".join(map(get, cut))
        if full:
            for c in new:
                del known[c]
        return out
