"""Language identification by unigram pieces, marginalised over all segmentations.

A fixed public vocabulary gives the pieces; each language has a probability for each piece. The
probability of a word is the sum, over all ways to cut it into pieces, of the product of their
probabilities (forward algorithm); that of a text is the product over its words. Languages are
equally likely beforehand; the score is the posterior of the best one.

Words are lower-cased runs of letters (with their marks). A worker scores each distinct word once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import exact_columns, remember_alone, short_batches

#: Labelled documents that a language's probabilities are learnt from, at most (by a hash of doc_id).
TRAIN_ROWS = 4000
#: Added to each piece's count.
SMOOTHING = 0.1
#: Words kept per worker; a full memo is emptied.
MEMO_WORDS = 300_000
#: Word positions scored together.
CELLS = 100_000
UNDETERMINED = "und"


def _vocabulary(path: str) -> list[str]:
    """The model's pieces by id; those that aren't text are empty."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def words_of(text: str) -> list[str]:
    return _letters().findall(text.lower())


_LETTERS = None


def _letters():
    global _LETTERS
    if _LETTERS is None:
        import regex

        _LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    return _LETTERS


class Scorer:
    """Log probabilities of words in each language by the forward algorithm."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.languages = probabilities.shape[1]
        self._p = np.vstack([probabilities, probabilities.min(axis=0).min() * np.ones(self.languages)])
        self._other = len(pieces)  # a character outside the vocabulary: as unlikely in any language
        self._ids: dict[str, int] = {}  # pieces, and -1 for what pieces begin with
        for i, piece in enumerate(pieces):
            for n in range(1, len(piece)):
                self._ids.setdefault(piece[:n], -1)
            if piece:
                self._ids[piece] = i
        self._longest = max(map(len, pieces), default=1)
        self._memo: dict[str, int] = {}
        self._scores = np.zeros((1024, self.languages))

    def _edges(self, words: list[str]) -> np.ndarray:
        """Rows (end, word, start, piece) of all pieces found in each "▁" + word."""
        ids, other, out = self._ids, self._other, []
        for w, word in enumerate(words):
            s = "▁" + word
            for i in range(len(s)):
                j, known = i + 1, ids.get(s[i])
                if known is None or known < 0:
                    out.append((j, w, i, other))
                while known is not None:
                    if known >= 0:
                        out.append((j, w, i, known))
                    j += 1
                    known = ids.get(s[i:j]) if j <= len(s) else None
        return np.array(out, np.int64)

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language; words of like length are scored together."""
        result = np.zeros((len(words), self.languages))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        first = 0
        while first < len(order):
            last, longest = first, 0
            while last < len(order) and (last == first or (last - first + 1) * (len(words[order[last]]) + 2) <= CELLS):
                last += 1
            longest = len(words[order[last - 1]]) + 1
            part = [words[i] for i in order[first:last]]
            ends = np.array([len(w) + 1 for w in part])
            edges = self._edges(part)
            edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
            cuts = np.searchsorted(edges[:, 0], np.arange(longest + 2))
            alpha, shift = np.zeros((len(part), longest + 1, self.languages)), np.zeros((len(part), self.languages))
            alpha[:, 0] = 1
            for j in range(1, longest + 1):
                e = edges[cuts[j] : cuts[j + 1]]
                if len(e):
                    heads = np.flatnonzero(np.diff(e[:, 1], prepend=-1))
                    alpha[e[heads, 1], j] = np.add.reduceat(alpha[e[:, 1], e[:, 2]] * self._p[e[:, 3]], heads)
                done = np.flatnonzero(ends == j)
                result[np.array(order[first:last])[done]] = np.log(alpha[done, j]) + shift[done]
                if j % 16 == 0 and j < longest:  # keep long words' products in range
                    reach = slice(max(0, j - self._longest), j + 1)
                    top = alpha[:, reach].max(axis=1)
                    top[top == 0] = 1
                    alpha[:, reach] /= top[:, None]
                    shift += np.log(top)
            first = last
        return result

    def forget(self) -> None:
        self._memo.clear()
        self._scores = np.zeros((1024, self.languages))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's best language (-1: none) and its posterior."""
        remember_alone(self)
        found = [words_of(t) if t else [] for t in texts]
        new = set().union(*found) - self._memo.keys()
        if len(self._memo) + len(new) > MEMO_WORDS:
            self.forget()
            new = set().union(*found)
        new = list(new)
        at = len(self._memo)
        if at + len(new) > len(self._scores):
            self._scores = np.vstack([self._scores[:at], np.zeros((at // 2 + 2 * len(new), self.languages))])
        self._scores[at : at + len(new)] = self.forward(new)
        self._memo.update(zip(new, range(at, at + len(new)), strict=True))
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for i, words in enumerate(found):
            if words:
                total = self._scores[np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best[i] = total.argmax()
                score[i] = 1 / np.exp(total - total.max()).sum()
        return best, score


_SCORERS: dict[str, Scorer] = {}


class Model:
    """Languages and their piece probabilities; sent to workers, which keep one scorer of it."""

    def __init__(self, path: str, languages: list[str], probabilities: np.ndarray):
        self.path, self.languages, self.probabilities, self.key = path, languages, probabilities, uuid.uuid4().hex

    def scorer(self) -> Scorer:
        if self.key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[self.key] = Scorer(_vocabulary(self.path), self.probabilities)
        return _SCORERS[self.key]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best, score = self.scorer().texts(texts)
        return [UNDETERMINED if b < 0 else self.languages[b] for b in best], score


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, train_rows: int = TRAIN_ROWS) -> Model:
    """Piece probabilities of each language from the labelled documents that aren't held out.

    Learns from ``train_rows`` documents a language at most, chosen by a hash of doc_id. What comes
    to the driver is a row for each language and piece of the vocabulary.
    """
    rows = exact_columns(docs, [("doc_id", "long"), ("text", "string"), ("lang", "string")])
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(labelled)
    if not languages:
        return Model(path, [], np.zeros((0, 0)))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, train_rows / labelled[lang]))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches):
        from sentencepiece import SentencePieceProcessor

        sp, counts = SentencePieceProcessor(model_file=path), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = sp.encode(" ".join(words_of(text or "")))
                total = counts.setdefault(lang, np.zeros(sp.get_piece_size(), np.int64))
                np.add.at(total, np.array(ids, np.int64), 1)
        for lang, total in counts.items():
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["lang", "piece", "n"])

    short_batches(docs.sparkSession)
    found = chosen.select("lang", "text").mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    pieces = _vocabulary(path)
    counts = np.full((len(pieces), len(languages)), SMOOTHING)
    for r in found:
        counts[r["piece"], languages.index(r["lang"])] += r["n"]
    counts[[not p for p in pieces]] = 0
    probabilities = counts / counts.sum(axis=0)
    probabilities[[not p for p in pieces]] = probabilities[[bool(p) for p in pieces]].min()
    return Model(path, languages, probabilities)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0; ties go to the language that is
    first by name. Whole texts are scored; repeated rows give repeated results; other columns are
    ignored.
    """

    def run(batches):
        for batch in batches:
            langs, score = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    short_batches(docs.sparkSession)
    rows = exact_columns(docs, [("doc_id", "long"), ("text", "string")]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, path: str, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a learned language (with at least ``min_score``), all columns as they are."""
    model, at = fit(docs, path), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            langs, score = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, score, strict=True)], pa.bool_()))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
