"""Token ids of whole texts, with a cache of words.

The byte-level tokenizer cuts a text before every single space that stands between two other characters, whatever
follows. Words are therefore encoded once per worker and looked up afterwards. Texts with white space after a space, or
with the name of a special token, are encoded whole. A word of Latin letters, perhaps with marks behind it, is one or two
units of the tokenizers used here, so its merges are asked of the tokenizer's model, without the steps before it.
"""
from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = np.array([1], "<u4").tobytes()
CACHE_WORDS = 200_000
KNOWN_WORDS = 600_000    # of WordEncoder
SLICE_CHARS = 4_000_000  # a longer text is a slice of its own
_APART = re.compile(r" \s")
_MARKS = r"([!#$%&()*+,\-./:;=?@\[\]^_{|}~]*)"  # no apostrophe, which takes letters with it, and no angle brackets
_LATIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+){_MARKS}")
_LATIN_SMALL = re.compile(f"([a-zß-öø-ÿ]+){_MARKS}")
# fixed values of byte-level tokenizers: bytes that are no visible character are written as those from U+0100 on
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip(sorted(set(range(256)) - set(_VISIBLE)), range(256, 512), strict=False))


class _Numbers(dict):
    """Words numbered as they are first asked for; `new` lists those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. `path` names a tokenizers JSON file of the byte-level kind."""

    _shared: dict[str, "Encoder"] = {}
    _plain, _before = _LATIN, "\u0120"  # words asked of the model, and how it writes the space before them

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.ids = _Numbers(), []
        self.model, self.marks = self.tokenizer.model, {"": b""}
        tries = ["Word", "straße,", "ÉÀÿ...", "(x)", "of"]  # a file that treats words in another way gets texts only
        self.words.new = [w for w in tries if self._plain.fullmatch(w)]
        texts = list(map(self._as_text, self.words.new))
        self._learn()
        if self.ids != self._ids(texts):
            self._plain = re.compile(r"(?!)")
        self.words, self.ids = _Numbers(), []

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder for each worker process."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, unit: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(unit)]).tobytes()

    def _letters(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTES)
        return self._units(self._before + letters)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        self.ids += self._made(new)

    def _made(self, new: list[str]) -> list[bytes]:
        """Ids of words: plain ones by the model, all others as the texts they are."""
        ids: list[bytes | None] = []
        for w in new:
            plain = self._plain.fullmatch(w)
            if plain is None:
                ids.append(None)
                continue
            letters, marks = plain.groups()
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[marks] = self._units(marks)
            ids.append(self._letters(letters) + self.marks[marks])
        rest = [i for i, known in enumerate(ids) if known is None]
        for at in range(0, len(rest), 5000):
            some = rest[at:at + 5000]
            for i, got in zip(some, self._ids([self._as_text(new[i]) for i in some]), strict=True):
                ids[i] = got
        return ids

    def _as_text(self, word: str) -> str:
        return word[1:] if word[:1] == "\0" else f" {word}"

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; NULL is empty text."""
        texts = [t or "" for t in texts]
        if len(self.words) > CACHE_WORDS:
            # words met early are the common ones: the first half stays
            keep = CACHE_WORDS // 2
            words = _Numbers()
            words.update((w, i) for w, i in self.words.items() if i < keep)
            self.words, self.ids = words, self.ids[:keep]
        out: list[bytes | None] = [None] * len(texts)
        cut: dict[int, list[int]] = {}
        whole, number = [], self.words.__getitem__
        for i, t in enumerate(texts):
            if _APART.search(t) or "\0" in t or any(s in t for s in self.special):
                whole.append(i)
            elif t:
                head, *rest = t.split(" ")
                cut[i] = list(map(number, [f"\0{head}", *rest]))  # the first word has no space before it
            else:
                out[i] = b""
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        self._learn()
        get = self.ids.__getitem__
        for i, numbers in cut.items():
            out[i] = b"".join(map(get, numbers))
        return out


class WordEncoder(Encoder):
    """As Encoder, for a tokenizers file that lower-cases, drops white space and never joins words over it.

    Texts are taken apart at plain ASCII white space, a slice of them at once: Arrow finds the distinct words of the slice,
    those not met before are encoded, and the ids of all words are gathered. Texts of Latin-1 characters are lower-cased
    first, which is the same character by character there. A text that may hold the name of a special token is encoded whole.
    """

    _shared: dict[str, "WordEncoder"] = {}
    _plain, _before = _LATIN_SMALL, ""

    def __init__(self, path: str):
        self.known: dict[str, bytes] = {}
        super().__init__(path)
        self.names = {*self.special, *(s.lower() for s in self.special)}

    def _as_text(self, word: str) -> str:
        return word

    def _letters(self, letters: str) -> bytes:
        return self.known.get(letters) or super()._letters(letters)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole: list[int] = []
        cut: list[tuple[int, str]] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            low = t.lower() if _is_latin(t) else t
            if any(s in t or s in low for s in self.names):
                whole.append(i)
                continue
            if cut and size + len(low) > SLICE_CHARS:
                self._slice(cut, out)
                cut, size = [], 0
            cut.append((i, low))
            size += len(low)
        if cut:
            self._slice(cut, out)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _slice(self, cut: list[tuple[int, str]], out: list[bytes]) -> None:
        lists = pc.ascii_split_whitespace(pa.array([t for _, t in cut], pa.large_string()))
        coded = lists.values.dictionary_encode()
        blobs = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(blobs), "<u4")
        n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        word = coded.indices.to_numpy()
        length = n[word]
        end = np.cumsum(length)
        where = np.repeat((np.cumsum(n) - n)[word] - (end - length), length)
        where += np.arange(len(where))
        ids = ids[where]
        at = np.concatenate([[0], end])[lists.offsets.to_numpy()].tolist()
        for (i, _), lo, hi in zip(cut, at, at[1:], strict=False):
            out[i] = ids[lo:hi].tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > KNOWN_WORDS:
            self.known = dict(islice(self.known.items(), KNOWN_WORDS // 2))  # words met early are the common ones
        blobs = list(map(self.known.get, words))
        new = [i for i, b in enumerate(blobs) if b is None]
        for i, ids in zip(new, self._made([words[i] for i in new]), strict=True):
            self.known[words[i]] = blobs[i] = ids
        return blobs


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def count_tokens(docs, path: str, version: str, text_column: str = "text"):
    """Docs with two more columns: tokenizer_version, and n_tokens of the whole text (0 for NULL or empty text)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("long")
    def n_tokens(texts):
        import pandas as pd
        return pd.Series([len(b) // 4 for b in Encoder.of(path).encode(texts.tolist())], dtype="int64")

    return docs.withColumn("n_tokens", n_tokens(text_column)).withColumn("tokenizer_version", F.lit(version))
