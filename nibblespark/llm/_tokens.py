"""Tokenizing whole texts with the tokenizers library, word by word through a bounded memory of words.

Where white space in a text is single blanks and line ends only, both tokenizers of this package cut before
each of them, whatever stands around; so a text's ids are those of its words, in order. Each word goes to
the library once while it is remembered. Other texts go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

#: Words that one worker remembers; later ones are encoded each time they come.
MEMORY_WORDS = 800_000
#: A character that is one token of its own between blanks.
SIGN = "~"


class WordEncoder:
    """Ids of whole texts as little-endian bytes of 32-bit integers.

    ``leading``: a word keeps the blank before it (byte-level vocabularies), else white space is dropped.
    """

    def __init__(self, path: str, leading: bool, memory: int = MEMORY_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.leading, self.memory = leading, memory
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = self.first if not leading else {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = next((t.content, i) for i, t in self.library.get_added_tokens_decoder().items())
        self.newline = self._whole("\n") if leading else b""
        self.sign_id = self.library.encode(SIGN, add_special_tokens=False).ids[0]
        self.fronts = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.fronts[i] = token.startswith("\u0120")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of the words, encoded a few hundred at once with a sign between them that none of them has."""
        out: dict[str, bytes] = {}
        odd = [w for w in words if SIGN in w] if not lead else []
        plain = [w for w in words if SIGN not in w] if odd else words
        for k in range(0, len(plain), 256):
            part = plain[k : k + 256]
            # a byte-level word shows by the blank at its front, other words by the sign in between
            text = "".join(lead + w for w in part) if lead else f" {SIGN} ".join(part) if not self.leading else self.mark.join(part)
            ids = np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            if lead:
                starts = np.flatnonzero(self.fronts[ids])
                ends = np.append(starts[1:], len(ids))
            else:
                ends = np.append(np.flatnonzero(ids == (self.mark_id if self.leading else self.sign_id)), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            if len(ends) != len(part):
                odd += part
                continue
            raw = ids.tobytes()
            for w, i, j in zip(part, (4 * starts).tolist(), (4 * ends).tolist()):
                out[w] = raw[i:j]
        for w in odd:
            out[w] = self._whole(lead + w)
        return out

    def _ids(self, words: list[str], memo: dict[str, bytes], lead: str) -> list[bytes]:
        found = list(map(memo.get, words))
        if None in found:
            holes = [i for i, x in enumerate(found) if x is None]
            fresh = self._learn(list({words[i] for i in holes}), lead)
            if len(memo) + len(fresh) <= self.memory:
                memo.update(fresh)
            for i in holes:
                found[i] = fresh[words[i]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain: list[list[list[str]]] = []
        out: list[bytes | None] = [None] * len(texts)
        at = []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self._whole(t)
                continue
            words = t.split()
            if not words or len(words) != t.count(" ") + t.count("\n") + 1:
                out[i] = self._whole(t) if t else b""
                continue
            plain.append([line.split(" ") for line in t.split("\n")] if self.leading else [words])
            at.append(i)
        if not self.leading:
            flat = [w for (words,) in plain for w in words]
            ids, k = self._ids(flat, self.first, ""), 0
            for i, (words,) in zip(at, plain):
                out[i] = b"".join(ids[k : k + len(words)])
                k += len(words)
            return out  # type: ignore[return-value]
        first = iter(self._ids([line[0] for lines in plain for line in lines], self.first, ""))
        later, k = self._ids([w for lines in plain for line in lines for w in line[1:]], self.later, " "), 0
        for i, lines in zip(at, plain):
            parts = []
            for line in lines:
                n = len(line) - 1
                parts.append(next(first) + b"".join(later[k : k + n]))
                k += n
            out[i] = self.newline.join(parts)
        return out  # type: ignore[return-value]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, leading: bool) -> WordEncoder:
    """This worker's encoder for a vocabulary file; it is kept between tasks."""
    if (path, leading) not in _ENCODERS:
        _ENCODERS[path, leading] = WordEncoder(path, leading)
    return _ENCODERS[path, leading]


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def public_tokenizer(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
