"""Token ids of whole texts with a public tokenizer file.

The libraries split a text into pretokens and encode each on its own, so the ids
of a text are the ids of its pretokens in a row. ``Encoder`` keeps the ids of
pretokens it has seen. It splits only texts of plain Latin characters itself,
where the split is certain; all other texts go whole to the library.
"""

import functools
import json
import os
import re
from array import array

import numpy as np

#: The one normalizer and pretokenizer that ``Encoder`` can split for.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
#: Characters beyond these, whose class, composition or lower case could differ between libraries.
_OTHER = re.compile("[^\t\n\r -~\xa1-įı-ſ]")
#: Bytes of each of the two caches (an entry counts its word, its ids and ENTRY more); a full one starts anew. Longer words stay out.
CACHE, ENTRY, LONGEST = 48 << 20, 200, 64


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


_BYTES = dict(enumerate(_byte_characters()))


class _Cache(dict):
    """Ids by word, of bounded size."""

    held = 0

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            if self.held >= CACHE:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += 4 * len(word) + len(ids) + ENTRY
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.parts = _Cache(), _Cache()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.can_split = (normal == NORMALIZERS and [x["type"] for x in parts] == ["Split", "ByteLevel"]
                          and parts[0]["pattern"].get("Regex") == SPLIT)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        """The library's own ids of the whole text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.can_split or _OTHER.search(text) or any(a in text for a in self.added):
            return self.whole(text)
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._word(words[i])
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        return self.words.keep(word, b"".join([self.parts.get(p) or self._part(p) for p in _SPLIT.findall(word.lower())]))

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        return self.parts.keep(part, array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
