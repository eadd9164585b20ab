"""Exact word-cached encoding with the tokenizers library.

Both vocabularies pre-tokenize, so the ids of a text are the ids of its
pre-tokens one after another.  A text is split in places that are always
pre-token boundaries and the ids of each piece are kept in a bounded cache as
little-endian unsigned 32-bit integers; only unseen pieces reach the library, in
batches.  Texts for which the boundaries can't be told by a space (runs of white
space, special-token strings) are given to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Pieces kept per Python worker, half of them from before the last change of generation (about 150 MB).
CACHE_PIECES = 700_000
#: Pieces longer than this are encoded but not kept, which bounds the cache in bytes.
CACHE_PIECE_CHARS = 48

#: Characters of text whose pieces are looked up together.
GROUP_CHARS = 500_000

_UNSURE = re.compile(r" (?:\s|\Z)")


def load_tokenizer(name: str):
    """A tokenizer of the public set by file name, or by path, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    path = name
    if os.sep not in name:
        import public_tokenizers

        path = str(public_tokenizers.path(name))
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class PieceEncoder:
    """Encodes texts to bytes of little-endian u32 ids; subclasses say how unseen pieces are encoded.

    keep_space: the pre-tokenizer joins one space to the word after it (byte-level BPE);
    otherwise white space is dropped and only separates words.
    """

    def __init__(self, specials: list[str], keep_space: bool, cache_pieces: int = CACHE_PIECES):
        self.keep_space, self.limit = keep_space, cache_pieces
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.first: dict[str, bytes] = {"": b""}
        self.rest: dict[str, bytes] = {}
        self.before: dict[int, dict[str, bytes]] = {}  # by cache: what it held before it was last emptied

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_whole(self, text: str) -> bytes:
        return self.encode_pieces([text])[0]

    def _learn(self, cache: dict[str, bytes], words: set[str], prefix: str) -> dict[str, bytes]:
        """Makes the cache answer for all words; those too long to keep are returned."""
        unseen = list(words.difference(cache))
        if not unseen:
            return {}
        if len(cache) > self.limit // 2:
            self.before[id(cache)] = dict(cache)
            cache.clear()
            unseen = list(words)
        old = self.before.get(id(cache))
        if old:
            cache.update({w: old[w] for w in unseen if w in old})
            unseen = list(words.difference(cache))
        got = self.encode_pieces([prefix + w for w in unseen] if prefix else unseen)
        long = {}
        for w, b in zip(unseen, got):
            (cache if len(w) <= CACHE_PIECE_CHARS else long)[w] = b
        return long

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; unseen pieces of GROUP_CHARS at a time go to the encoder together."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size > GROUP_CHARS:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        parts: list = []
        first: set[str] = set()
        rest: set[str] = set()
        for t in texts:
            if not t:
                parts.append(b"")
            elif self.special is not None and "<|" in t and self.special.search(t) or self.keep_space and _UNSURE.search(t):
                parts.append(self.encode_whole(t))
            elif self.keep_space:
                head, *words = t.split(" ")
                first.add(head)
                rest.update(words)
                parts.append((head, words))
            else:
                words = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                first.update(words)
                parts.append((None, words))
        long_first, long_rest = self._learn(self.first, first, ""), self._learn(self.rest, rest, " ") if self.keep_space else {}
        out = []
        for p in parts:
            if isinstance(p, bytes):
                out.append(p)
                continue
            head, words = p
            cache, long = (self.first, long_first) if head is None else (self.rest, long_rest)
            found = b"".join([cache[w] if w in cache else long[w] for w in words] if long else map(cache.__getitem__, words))
            if head is not None:
                found = (self.first[head] if head in self.first else long_first[head]) + found
            out.append(found)
        return out

    def encode(self, text: str | None) -> bytes:
        return self._encode_group([text])[0]


#: Pieces that are one run of Latin letters and one run of ASCII marks: two pre-tokens at most, the same under NFC.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
_PROBES = ("Hello", "hello,", "Ça!", "weiß", "ÉTÉ!!", "***", "'s", "o''", "e.g", "Ñandú...", "x<|", "THE!!", "étioneux.", "||", "a")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class LibraryEncoder(PieceEncoder):
    """The tokenizers library behind the cache: equal to encode(text, add_special_tokens=False).ids.

    Plain pieces go straight to the library's BPE model, without its normalizer
    and pre-tokenizer, if probes show that both ways agree for this vocabulary.
    """

    def __init__(self, name: str, cache_pieces: int = CACHE_PIECES):
        self.tok = load_tokenizer(name)
        self.model = self.tok.model
        self.bytes = dict(enumerate(byte_characters()))
        self.lower = self.tok.normalizer is not None
        self.runs: dict[str, bytes] = {}
        self.gap = self.bytes[32]
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        keep = "byte" in type(self.tok.pre_tokenizer).__name__.lower()
        super().__init__(added, keep, cache_pieces)
        self.direct = all(self._plain(p) in (None, self._slow([p])[0]) for w in _PROBES for p in ((w, " " + w) if keep else (w,)))

    def _slow(self, pieces: list[str]) -> list[bytes]:
        return [ids_bytes(e.ids) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _run(self, run: str) -> bytes:
        """The ids of one pre-token."""
        if not run.isascii() or run[0] == " ":
            run = run.encode().decode("latin-1").translate(self.bytes)
        return ids_bytes([t.id for t in self.model.tokenize(run)])

    def _plain(self, piece: str) -> bytes | None:
        """The ids of a plain piece, None for any other."""
        space = self.keep_space and piece[:1] == " "
        word = piece[1:] if space else piece
        if word.isascii() and word.isalpha():  # most pieces
            return ids_bytes([t.id for t in self.model.tokenize(self.gap + word if space else word.lower() if self.lower else word)])
        m = _PLAIN.fullmatch(piece, 1 if space else 0)
        if m is None or piece == " " * space:
            return None
        letters, marks = m[1].lower() if self.lower else m[1], m[2]
        if space:
            letters, marks = (" " + letters, marks) if letters else ("", " " + marks)
        out = b""
        if letters:  # a word that was met without these marks needs no merging
            known = (self.rest if space else self.first).get(letters[1:] if space else letters) if marks else None
            out = self._run(letters) if known is None else known
        if marks:
            known = self.runs.get(marks)
            if known is None:
                known = self._run(marks)
                if len(self.runs) < 10_000:
                    self.runs[marks] = known
            out += known
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not self.direct:
            return self._slow(pieces)
        out = [self._plain(p) for p in pieces]
        rest = [k for k, b in enumerate(out) if b is None]
        for k, b in zip(rest, self._slow([pieces[k] for k in rest])):
            out[k] = b
        return out


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(name: str) -> LibraryEncoder:
    """One encoder per Python worker and vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = LibraryEncoder(name)
    return _ENCODERS[name]
