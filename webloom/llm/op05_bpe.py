"""Byte-level BPE by backtracking, without running merges.

The vocabulary's tokens form an Aho-Corasick automaton.  A pre-token is cut into
longest matches; a cut is the exact BPE result if and only if each pair of
neighbours is compatible, which a table of pairs (filled on demand from the merge
list) answers.  Where a pair isn't, the encoder backs up to the next shorter
token, marking positions that can't be reached, so the work is linear in the
pre-token.  Decoding copies token bytes through an offset table.

Edge cases: null or empty texts have no ids and decode to the empty text;
special-token strings become their ids, as the library does; a pre-token of any
length is encoded without recursion; repeated rows, ties and other columns don't
matter; lone invalid bytes can't occur in Spark's UTF-8 texts that pass Arrow.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_text, table
from .tokens import PieceEncoder, byte_characters, ids_bytes, load_tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: The pre-token pattern of byte-level BPE (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs remembered per worker; a full table is emptied.
PAIRS = 1_000_000


class BacktrackingEncoder(PieceEncoder):
    def __init__(self, name: str = VOCABULARY):
        import ahocorasick
        import regex

        tok = load_tokenizer(name)
        model = json.loads(tok.to_str())["model"]
        self.added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        super().__init__(list(self.added), keep_space=True)
        alphabet = {c: b for b, c in enumerate(byte_characters())}
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.token: dict[int, bytes] = {i: as_bytes(s) for s, i in model["vocab"].items() if s not in self.added}
        self.id_of = {b: i for i, b in self.token.items()}
        self.pattern = regex.compile(PATTERN)
        # the rank at which two ids merge, the id they give, and how a token splits
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b = self.id_of[as_bytes(a)], self.id_of[as_bytes(b)]
            whole = self.id_of[self.token[a] + self.token[b]]
            self.rank.setdefault((a, b), (r, whole))
            self.split.setdefault(whole, (a, b))
        self.order = {whole: r for r, (_, whole) in ((v[0], (k, v[1])) for k, v in self.rank.items())}
        self.machine = ahocorasick.Automaton()
        for i, b in self.token.items():
            if self._reachable(i):
                self.machine.add_word(b.decode("latin-1"), i)
        self.machine.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        size = max([*self.token, *self.added.values()]) + 1
        pool = [self.token.get(i, b"") for i in range(size)]
        for s, i in self.added.items():
            pool[i] = s.encode()
        self.lengths = np.array([len(b) for b in pool], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(pool), np.uint8)

    def _reachable(self, i: int) -> bool:
        """Whether merging the token's own bytes gives the token (all but unused entries of a vocabulary)."""
        return len(self.token[i]) == 1 or i in self.split

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b can stand side by side in a BPE result: no merge across their border comes before both are whole."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            merge = self.rank.get((a, b))
            if merge is not None and merge[0] < limit:
                return False
            ra, rb = self.order.get(a, -1), self.order.get(b, -1)
            if ra > rb:  # the left token was made later: undo that merge, its right part faces b
                limit, a = ra, self.split[a][1]
            elif rb >= 0:  # the right one was made later, or both by one merge, which works from the left
                limit, b = rb + 1, self.split[b][0]
            else:
                return True

    def _longest(self, s: str, start: int) -> tuple[int, int]:
        end, i = next(self.machine.iter_long(s, start))
        return i, end + 1

    def _next_shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of token i, -1 if none."""
        got = self.shorter.get(i)
        if got is None:
            b, got = self.token[i], -1
            for n in range(len(b) - 1, 0, -1):
                j = self.id_of.get(b[:n])
                if j is not None and self._reachable(j):
                    got = j
                    break
            self.shorter[i] = got
        return got

    def encode_pretoken(self, data: bytes) -> list[int]:
        whole = self.id_of.get(data)
        if whole is not None and self._reachable(whole):
            return [whole]
        s = data.decode("latin-1")
        ids = [i for _, i in self.machine.iter_long(s)]
        ok = self.compatible
        if all(ok(a, b) for a, b in zip(ids, ids[1:])):
            return ids
        ids, ends, at, n = [], [0], 0, len(s)
        dead = bytearray(n + 1)
        cand, end = self._longest(s, 0)
        while True:
            if cand >= 0:
                end = at + len(self.token[cand])
                if not dead[end] and (not ids or ok(ids[-1], cand)):
                    ids.append(cand)
                    ends.append(end)
                    at = end
                    if at == n:
                        return ids
                    cand, _ = self._longest(s, at)
                else:
                    cand = self._next_shorter(cand)
                continue
            dead[at] = 1
            if not ids:
                raise ValueError("no BPE cut exists")
            cand = self._next_shorter(ids.pop())
            ends.pop()
            at = ends[-1]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out = []
        for p in pieces:
            ids: list[int] = []
            for seg in self.special.split(p) if self.special is not None and "<|" in p else (p,):
                for m in self.pattern.findall(seg):
                    ids += self.encode_pretoken(m.encode())
            out.append(ids_bytes(ids))
        return out

    def encode_whole(self, text: str) -> bytes:
        ids, last = bytearray(), 0
        for m in self.special.finditer(text) if self.special is not None else ():
            ids += self.encode_pieces([text[last : m.start()]])[0] + ids_bytes([self.added[m[0]]])
            last = m.end()
        return bytes(ids + self.encode_pieces([text[last:]])[0])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids: one gather through the offset table."""
        at = np.frombuffer(ids, "<u4")
        if not len(at):
            return b""
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.pool[np.arange(ends[-1]) + np.repeat(self.offsets[at] - (ends - n), n)].tobytes()


_ENCODERS: dict[str, BacktrackingEncoder] = {}


def encoder(name: str = VOCABULARY) -> BacktrackingEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = BacktrackingEncoder(name)
    return _ENCODERS[name]


def as_text(data: bytes) -> str:
    """Decoded bytes as the library shows them: invalid sequences become U+FFFD."""
    return data.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, with_values: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_values also ids and decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"].tolist(), bpe.encode_many(batch["text"].tolist())):
                text = as_text(bpe.decode(ids))
                row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").astype("int64"), text) if with_values else row)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_values
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_values
    return id_text(docs).mapInPandas(run, schema)


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
