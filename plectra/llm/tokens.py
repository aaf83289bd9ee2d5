"""Tokenizing whole texts inside Spark tasks with a public tokenizer file."""

from __future__ import annotations

import json
import os
from array import array
from itertools import accumulate, chain

import numpy as np

#: Words whose ids a worker remembers as lately used, and as used before those: some 200 MB together.
REMEMBERED = 500_000
#: Marks a word that no blank precedes.
_BARE = "\x02"
#: Characters that are an id sequence of their own behind letters at the end of a word.
_ENDS = ".,;:!?"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _plain(text: str) -> bool:
    """Whether all white space is single blanks and line feeds between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return text.replace("\n", "").isprintable()  # no other white space, no control characters


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Words(dict):
    """The ids of words, each given with its mark or without (after a blank); new ones are looked up when first asked for."""

    def __init__(self, fixed: dict[str, bytes], pieces, library, code: str, before: dict[str, bytes]):
        super().__init__({"\n": fixed["\n"]})
        self.fixed, self.pieces, self.library, self.code, self.before = fixed, pieces, library, code, before

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            # A word of letters with one more character behind it is known by its parts.
            end = word[-1]
            stem = word[:-1] if end in self.fixed else word
            bare = stem[:1] == _BARE
            letters = stem[1:] if bare else stem
            if not letters.isalpha():
                found = self.library(word[1:] if word[0] == _BARE else " " + word)
            elif stem is not word:
                found = self[stem] + self.fixed[end]
            else:
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(_LETTERS)
                found = array(self.code, [x.id for x in self.pieces(letters if bare else "Ġ" + letters)]).tobytes()
        self[word] = found
        return found


class Encoder:
    """Ids of whole texts, equal to the library's own, as little-endian numbers of `kind` (two bytes where all ids fit).

    The byte-level pre-tokenizer always cuts before a single blank, and around a single line feed, that
    stands between two characters that are no white space, and between letters and what follows them. The
    pieces between such cuts are encoded by the library once and remembered; a text with any other white
    space goes to the library as a whole, and so do all texts if the vocabulary is of another make.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self._code = "H" if self.kind == "<u2" else "I"
        made = json.loads(self.library.to_str())
        cut = made["pre_tokenizer"] or {}
        self.cuts = (
            made["normalizer"] is None
            and made["model"]["type"] == "BPE"
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
            and not any(x["content"].isalpha() or x["normalized"] or x["lstrip"] or x["rstrip"] for x in made["added_tokens"])
        )
        self.fixed = {c: self._library([c])[0] for c in ("\n", *_ENDS)}
        self.known = self._words({})

    def _words(self, before: dict[str, bytes]) -> _Words:
        library = self.library
        return _Words(self.fixed, library.model.tokenize, lambda word: np.array(library.encode(word, add_special_tokens=False).ids, self.kind).tobytes(), self._code, before)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [self.cuts and _plain(t) for t in texts]
        whole = iter(self._library([t for t, p in zip(texts, plain, strict=True) if not p]))
        cut = iter(self._remembered([_BARE + t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(cut if p else whole) for p in plain]

    def _remembered(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " \n " + _BARE).split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.before.clear()
            self.known = self._words(self.known)
        found = list(map(self.known.__getitem__, chain.from_iterable(cut)))
        ends = list(accumulate(map(len, cut)))
        return [b"".join(found[e - len(units) : e]) for units, e in zip(cut, ends, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
