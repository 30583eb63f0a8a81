"""Token ids of whole texts, with each distinct piece of text encoded once.

Running a tokenizer over the full text costs about a second per megabyte.  Both
vocabularies used here split a text at white space before they merge anything,
so the ids of a text are those of its chunks, and chunks repeat: a chunk is
looked up first, then its letter, digit and symbol runs, and only an unknown run
goes through the tokenizer's merges.  Texts and chunks outside the plain range
below go through the whole tokenizer, as do texts that spell an added token, so the ids
are always the tokenizer's own.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Python counts these as white space, the tokenizers do not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters for which the expressions below agree with the tokenizers' own.
_PLAIN = re.compile("[\t-\r -~¡-ª¬´-¸º»¿-ÿ«®¯°±¨¦§©]*")
_LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]"
_SYMBOLS = r"(?:(?![A-Za-z0-9ªµºÀ-ÖØ-öø-ÿ])\S)"

#: By kind: chunks of a text, runs of a chunk.
_CHUNKS = {"word": re.compile(r"\S+"), "byte": re.compile(r" ?\S+|\s+(?!\S)|\s+")}
_RUNS = {
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{_LETTERS}+|[0-9]|{_SYMBOLS}+"),
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTERS}+| ?[0-9]+| ?{_SYMBOLS}+|\s+(?!\S)|\s+"),
}


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others are moved to the
    code points from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(moved)}


class CachedEncoder:
    """Ids of a text as bytes of little-endian unsigned 32-bit integers.

    ``max_entries`` bounds the cache beyond the pieces of one text; a full cache
    is emptied, which costs time and changes no id.
    """

    def __init__(self, path: str, max_entries: int = 800_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.added = [token["content"] for token in rules.get("added_tokens", [])]
        self.kind = "word" if rules["model"].get("end_of_word_suffix") else "byte"
        self.model = self.tokenizer.model
        self.max_entries = max_entries
        self.pieces: dict[str, bytes] = {}
        stand_in = _byte_alphabet()
        self._stand_in = {i: stand_in[i] for i in range(256)}
        self._space = stand_in[0x20]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        known = self.pieces.get(run)
        if known is None:
            if run.isascii() and run.isalpha():
                spelled = run
            elif run.isascii() and run[0] == " " and run[1:].isalpha():
                spelled = self._space + run[1:]
            else:
                spelled = run.encode().decode("latin-1").translate(self._stand_in)
            known = self.pieces[run] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return known

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and (chunk.islower() or self.kind == "byte"):  # the common forms, without expressions
            core = chunk[1:] if chunk[0] == " " else chunk
            if core.isalpha():
                return self._run(chunk)
            if core[-1:] in (".", ",") and core[:-1].isalpha():
                return self._run(chunk[:-1]) + self._run(core[-1])
        if not _PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        if self.kind == "word":
            chunk = chunk.lower()
        runs = _RUNS[self.kind].findall(chunk)
        return self._run(chunk) if len(runs) == 1 else b"".join(map(self._run, runs))

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or any(token in text for token in self.added):
            return self.whole(text)
        if self.kind == "word":
            # Lower case of Latin-1 is one to one in Python and in the tokenizer.
            chunks = (text.lower() if _latin(text) else text).split()
        else:
            chunks = _CHUNKS["byte"].findall(text)
        pieces = self.pieces
        new = set(chunks).difference(pieces)
        if new:
            if len(pieces) + len(new) > self.max_entries:
                pieces.clear()
                new = set(chunks)
            for chunk in new:
                pieces[chunk] = self._chunk(chunk)
        return b"".join(map(pieces.__getitem__, chunks))

    def ids(self, text: str, end_id: int | None = None) -> np.ndarray:
        tail = b"" if end_id is None else array("I", [end_id]).tobytes()
        return np.frombuffer(self.encode(text) + tail, dtype="<u4")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """The encoder of this Python worker; its caches outlive a task."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]
