"""Exact memoised tokenization with a ``tokenizers`` file.

A text is cut where its tokenizer's pre-tokenizer always cuts: from a
character that is not white space to ASCII white space. Each piece (white
space, then other characters) is encoded on its own and remembered, since words
repeat. Texts in which such a cut could be wrong (special-token strings, white
space beyond ASCII, control characters) are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from kinmap.llm.common import remembered

#: White space or controls that the libraries' ``\s`` and Python's may treat differently.
ODD = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]")
#: ASCII punctuation, without the apostrophe, which may begin a pre-token of letters.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECE = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def way(path: str) -> str:
    """How texts may be cut for this tokenizer file: "space" (a byte-level
    pre-tokenizer that keeps white space), "drop" (white space only separates) or "" (never)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec.get("truncation") or spec.get("padding") or spec["model"].get("dropout"):
        return ""
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "space"
    steps, rules = pre.get("pretokenizers") or [{}], norm.get("normalizers") or []
    first = steps[0]
    removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s" in first["pattern"].get("Regex", "")
    plain = {x.get("type") for x in rules} <= {"NFC", "Lowercase", "Replace"} and all(x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in rules if x["type"] == "Replace")
    return "drop" if pre.get("type") == "Sequence" and removes and plain else ""


class Memo:
    """Remembers a value for each piece, in two generations of at most ``most`` entries each: bounded memory."""

    def __init__(self, path: str, most: int = 250_000):
        self.tokenizer, self.way = load(path), way(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def value(self, encoding):
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list:
        return [self.value(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: bytes) -> list[bytes] | None:
        """None: the text must be encoded in one go."""
        text = data.decode("utf-8", "replace")
        if not self.way or ODD.search(text) or any(s in text for s in self.specials):
            return None
        return data.lower().split() if self.way == "drop" else PIECE.findall(data)

    def values(self, data: bytes) -> list:
        """The values of a text's pieces, in order; their sum or concatenation is the whole text's."""
        pieces = self.pieces(data)
        if pieces is None:
            return self.encode([data.decode("utf-8", "replace")])
        out: list = []
        for at in range(0, len(pieces), 50_000):
            out += self.lookup(pieces[at : at + 50_000])
        return out

    def lookup(self, pieces: list[bytes]) -> list:
        if missing := set(pieces).difference(self.young):
            if len(self.young) + len(missing) > self.most:
                self.old, self.young = self.young, {}
                missing = set(pieces)
            self.learn(missing)
        return list(map(self.young.__getitem__, pieces))

    def learn(self, missing: set[bytes]) -> None:
        """A piece that ends in ASCII punctuation after an ASCII letter is always cut there too: its two parts are looked up.
        Pieces that are one word of ASCII letters go straight to the tokenizer's model, the others through all of it."""
        young, old = self.young, self.old
        new, whole = [], []
        for p in missing:
            if (v := old.get(p)) is not None:
                young[p] = v
            else:
                core = p.rstrip(TAIL)
                if len(core) < len(p) and core[-1:].isalpha():
                    whole.append((p, core, p[len(core) :]))
                else:
                    new.append(p)
        for _, core, tail in whole:
            for p in (core, tail):
                if p not in young:
                    if (v := old.get(p)) is not None:
                        young[p] = v
                    else:
                        new.append(p)
        model, rest = self.tokenizer.model.tokenize, []
        for p in new:
            word = self.word(p)
            if word is None:
                rest.append(p)
            else:
                young[p] = self.of_tokens(model(word))
        if rest:
            young.update(zip(rest, self.encode([p.decode() for p in rest]), strict=True))
        for p, core, tail in whole:
            young[p] = young[core] + young[tail]

    def word(self, p: bytes) -> str | None:
        """What the model gets for a piece that is one pre-token of ASCII letters, or None."""
        if self.way == "drop":  # lower-cased before
            return p.decode() if p.isalpha() and p.islower() else None
        if p.isalpha():
            return p.decode()
        return "\u0120" + p[1:].decode() if p[:1] == b" " and p[1:].isalpha() else None

    def of_tokens(self, tokens):
        raise NotImplementedError


class Counts(Memo):
    """Numbers of tokens."""

    def value(self, encoding) -> int:
        return len(encoding)

    def of_tokens(self, tokens) -> int:
        return len(tokens)


class Ids(Memo):
    """Token ids as little-endian bytes of a fixed width."""

    def __init__(self, path: str, width: int = 2, most: int = 250_000):
        super().__init__(path, most)
        self.kind = np.dtype(f"<u{width}")

    def value(self, encoding) -> bytes:
        return self.packed(encoding.ids)

    def of_tokens(self, tokens) -> bytes:
        return self.packed([t.id for t in tokens])

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)


def cached(kind: type[Memo], path: str, *args) -> Memo:
    """One memo for each Python worker."""
    return remembered((kind.__name__, path, *args), lambda: kind(path, *args))
