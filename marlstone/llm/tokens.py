"""Token ids of whole texts, by the tokenizers library behind a cache of chunks.

Both vocabularies split a text before they merge: nothing is merged across the
chunks below, so the ids of a text are those of its chunks in order.  A chunk
is encoded by the library once and then looked up.  This holds for printable
ASCII, Latin-1 letters, tab and newlines; a text with any other character, or
with the name of a special token (which the library maps to its id wherever it
stands), is encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from marlstone.llm import common

#: The text holds a character for which the split is left to the library.
OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: A space and what follows up to white space, or a run of white space without its last character.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Behind letters, a run of these is a part of its own; the apostrophe can join letters.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: How a vocabulary file cuts a text into independent chunks.
CHUNKS: dict[str, Callable[[str], list[str]]] = {"word_bpe_49k.json": str.split, "byte_bpe_50k.json": SPACED.findall}
#: Vocabulary files that lower-case a text first.
LOWER = {"word_bpe_49k.json"}
#: Cached chunks, and cached words, of a worker; beyond, the later half goes.
CACHE = 500_000


def visible_bytes() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


VISIBLE = visible_bytes()


def trimmed(cache: dict, more: int) -> None:
    """Room for ``more``: the later half goes, as frequent keys came first."""
    if len(cache) + more > CACHE:
        for key in list(cache)[CACHE // 2 :]:
            del cache[key]


class Encoder:
    """Little-endian unsigned 32-bit ids of texts; one per worker and vocabulary file."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        names = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) or "(?!)", re.IGNORECASE)
        # what all names begin with before their first letter: a text without it needs no search
        self.opening = re.match("[^a-zA-Z]*", os.path.commonprefix(names))[0]
        self.chunks = CHUNKS.get(os.path.basename(path))
        self.lower = os.path.basename(path) in LOWER
        self.cache: dict[str, bytes] = common.cache("tokens", {})
        self.heads: dict[str, bytes] = common.cache("tokens", {})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids by the library alone."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, head: str) -> bytes:
        """Ids of letters alone, by the library's merges without its text steps."""
        shown = head.replace(" ", VISIBLE[32]) if head.isascii() else "".join([VISIBLE[b] for b in head.encode()])
        return array("I", [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Put chunks into the cache: words from the cache of words, the rest by the library."""
        whole = []
        trimmed(self.heads, len(chunks))
        for chunk in chunks:
            head = chunk.rstrip(PUNCTUATION)
            if not (head[1:] if head[:1] == " " else head).isalpha():
                whole.append(chunk)
                continue
            tail = chunk[len(head) :]
            if self.lower:
                head = head.lower()
            ids = self.heads.get(head)
            if ids is None:
                ids = self.heads[head] = self.word(head)
            if tail:
                if tail not in self.heads:
                    self.heads[tail] = self.plain([tail])[0]
                ids += self.heads[tail]
            self.cache[chunk] = ids
        self.cache.update(zip(whole, self.plain(whole), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is the empty text."""
        cut: list[list[str] | None] = [None if self.chunks is None or (text and (OTHER.search(text) or (self.opening in text and self.special.search(text)))) else self.chunks(text or "") for text in texts]
        seen = set().union(*(c for c in cut if c))
        new = seen.difference(self.cache)
        if new:
            trimmed(self.cache, len(new))
            self.learn(seen.difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) if c is not None else self.plain([text])[0] for text, c in zip(texts, cut, strict=True)]
