"""Word-memoised encoding of whole texts with a public tokenizer file.

A text's ids are the concatenation of the ids of its space-delimited words, so every distinct
word of a worker is given to the tokenizers library once and a text is a join of cached byte
strings (little-endian unsigned 32-bit ids).
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from starledger.llm.common import remember_alone

#: Words kept per worker, twice (about 150 bytes each): those seen last, and those seen before them.
MEMO_WORDS = 350_000
#: Longer "words" are encoded each time they occur.
MEMO_CHARS = 64
#: Characters of text handled at once inside a worker.
SLICE_CHARS = 4_000_000
#: Runs of marks kept per worker.
MEMO_TAILS = 10_000
#: New words given to the tokenizer at once.
JOINED_WORDS = 100

#: White space other than blanks and line feeds (never printable).
_ODD_SPACE = re.compile(r"[^\S \n]")
#: Marks that can follow a word (the apostrophe, which may begin a suffix, isn't one).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What byte-level vocabularies write for each byte: printable ones as they are, the rest from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: The signs that a string begins with, letters apart: no normaliser makes them from letters.
_SIGNS = re.compile(r"[^\w\s]*")


class TextEncoder:
    """Encodes texts to packed ids; equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    ``keeps_space`` says whether white space takes part in the ids. If it doesn't, words are
    independent of what surrounds them. If it does (byte-level vocabularies), a word carries the
    blank or line feed before it, as the pre-tokenizer never matches across the end of a word; texts
    with other white space, runs of it or some at an end are encoded in one piece.
    """

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens ("<|endoftext|>") can span words and stand in for what the normaliser
        # changes: texts that hold the signs one begins with are encoded in one piece.
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._added = {_SIGNS.match(t)[0] or t[:1].lower() for t in added if t}
        self._keeps_space = keeps_space
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        # A mark between words is a token of its own: a null character between blanks where spaces
        # are dropped, else a tab before the word's own space.
        self._mark = "\t" if keeps_space else "\0"
        (self._mark_id,) = self._tokenizer.encode(self._mark, add_special_tokens=False).ids
        self._tails: dict[str, bytes] = {}
        self._ignores_case = self._encode(["A"]) == self._encode(["a"])
        self._model = self._tokenizer.model
        probes = ["word", "einführung", "évaluation", "ñandú", "zzqxj", "a"]
        self._splits_nothing = [self._of_letters(w) for w in probes] == self._encode([" " * keeps_space + w for w in probes])

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _of_letters(self, word: str) -> bytes:
        """Ids of a word that is letters alone: nothing to normalise or to split, so the model takes its bytes."""
        raw = (" " + word if self._keeps_space else word).encode().decode("latin-1").translate(_BYTE_SIGNS)
        return array("I", [t.id for t in self._model.tokenize(raw)]).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Put the ids of words into the memo. Marks after a letter are split from it before ids are looked
        up, so a word that ends in some has the ids of the word without them, and theirs. (The dotted
        capital I alone ends in a non-letter when it is lower-cased.) Where the vocabulary ignores case,
        a word has the ids of its small letters."""
        memo, older, tails, made, words = self._memo, self._older, self._tails, [], {}
        for w in new:
            known = older.get(w)
            if known is not None:
                memo[w] = known
                continue
            base, tail = w, ""
            if len(w) <= MEMO_CHARS:
                core = w.rstrip(_MARKS)
                if core and len(core) < len(w) and core[-1].isalpha() and core[-1] != "\u0130":
                    base, tail = core, w[len(core) :]
                if self._ignores_case and max(base) < "\u0100":
                    base = base.lower()
            if base != w:
                made.append((w, base, tail))
            if base not in memo:
                if base in older:
                    memo[base] = older[base]
                else:
                    words[base] = None
        if self._splits_nothing:
            plain = [w for w in words if w.isalpha() and max(w) < "\u0100"]
            memo.update(zip(plain, map(self._of_letters, plain), strict=True))
            words = [w for w in words if w not in memo]
        words = list(words)
        for i in range(0, len(words), JOINED_WORDS):
            part = words[i : i + JOINED_WORDS]
            if self._keeps_space:
                text = "".join(f"{w}\t" if w[0] == "\n" else f" {w}\t" for w in part)
            else:
                text = " \0 ".join([*part, ""])
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self._mark_id)).tolist()
            raw = ids.tobytes()
            memo.update(zip(part, [raw[a + 4 : b] for a, b in zip([-4, *ends], ends, strict=False)], strict=True))
        if len(tails) > MEMO_TAILS:
            tails.clear()
        unseen = list({t for _, _, t in made} - tails.keys())
        tails.update(zip(unseen, self._encode(unseen), strict=True))
        for w, base, tail in made:
            memo[w] = memo[base] + tails[tail]

    def forget(self) -> None:
        self._memo, self._older = {}, {}

    def _words(self, text: str) -> list[str] | None:
        """The text's words as they are in the memo; None if it is to be encoded in one piece."""
        if any(s in text or s.isalpha() and s in text.lower() for s in self._added):
            return None
        if not self._keeps_space:
            return None if "\0" in text else text.replace("\n", " ").split(" ")
        flat = text.replace("\n", " ")
        if not text or flat[0] == " " or flat[-1] == " " or "  " in flat or (not flat.isprintable() and _ODD_SPACE.search(text)):
            return None
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, in order; an empty text has none."""
        remember_alone(self)
        cut = [self._words(t) for t in texts]
        whole = [i for i, w in enumerate(cut) if w is None]
        heads = [i for i, w in enumerate(cut) if w is not None] if self._keeps_space else []
        first = [cut[i].pop(0) for i in heads]  # the first word has no blank before it
        memo = self._memo
        if len(memo) > MEMO_WORDS:
            self._older, self._memo = memo, {}
            memo = self._memo
        if not self._keeps_space:
            memo[""] = b""
        found = [list(map(memo.get, w)) if w else [] for w in cut]
        gaps = [[k for k, ids in enumerate(f) if ids is None] for f in found]
        new = {w[k] for w, g in zip(cut, gaps, strict=True) for k in g}
        self._learn(new)
        out = []
        for w, f, g in zip(cut, found, gaps, strict=True):
            for k in g:
                f[k] = memo[w[k]]
            out.append(b"".join(f))
        alone = self._encode([*(texts[i] for i in whole), *first])
        for i, head in zip([*whole, *heads], alone, strict=True):
            out[i] = head + out[i]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, keeps_space: bool) -> TextEncoder:
    """The worker's encoder of a vocabulary file; kept between tasks of one worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, keeps_space)
    return _ENCODERS[key]


def slices(texts: list[str | None]):
    """Consecutive (first, texts) runs of at most ``SLICE_CHARS`` characters (one text at least); null is empty."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > SLICE_CHARS:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield first, run
