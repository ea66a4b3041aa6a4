import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starledger.llm import packing
from starledger.llm.encode import TextEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def placed(counts, capacity):
    """Every piece's (bin, offset, length) that a plan gives, by expanding its moves."""
    moves, bins = packing.plan_bins(counts, capacity)
    out = []
    for k, (length, rank, first, offset) in enumerate(moves):
        end = moves[k + 1][1] if k + 1 < len(moves) and moves[k + 1][0] == length else counts[length]
        out += [(first + i, offset, length) for i in range(end - rank)]
    return out, bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=0, max_size=60), st.integers(30, 40))
def test_plan_places_each_piece_once_without_gaps(lengths, capacity):
    counts = Counter(lengths)
    out, bins = placed(counts, capacity)
    assert Counter(x[2] for x in out) == counts
    by_bin = {}
    for b, offset, length in out:
        by_bin.setdefault(b, []).append((offset, length))
    assert sorted(by_bin) == list(range(bins))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in parts) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(14, 40), min_size=1, max_size=14))
def test_large_items_are_matched_optimally(lengths):
    """With items above a third only, the fewest bins are the items less a largest matching."""
    from functools import lru_cache

    items = tuple(sorted(lengths))

    @lru_cache(None)
    def fewest(rest):
        if not rest:
            return 0
        last, rest = rest[-1], rest[:-1]
        best = 1 + fewest(rest)
        for i in range(len(rest)):
            if last + rest[i] <= 40:
                best = min(best, 1 + fewest(rest[:i] + rest[i + 1 :]))
        return best

    assert packing.plan_bins(Counter(items), 40)[1] == fewest(items)


def test_plan_is_near_the_lower_bound_and_small():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6.3, 1.1, 200_000).astype(int) + 1)
    counts = Counter(lengths.tolist())
    moves, bins = packing.plan_bins(counts, 2048)
    assert bins <= 1.01 * lengths.sum() / 2048 + 1
    assert len(moves) < 60_000  # bounded by the capacity, not by the pieces
    with pytest.raises(ValueError):
        packing.plan_bins({2049: 1}, 2048)


@pytest.mark.parametrize(("path", "keeps_space"), [(WORDS, False), (BYTES, True)])
def test_encoder_equals_the_library(path, keeps_space):
    enc = TextEncoder(path, keeps_space)
    texts = ["", " ", "\n", "a", "Hello, world!  Two  blanks", "tab\there", "nul\0 x", "line\n\nline", "é ́x Éa", "Σας ΟΔΟΣ", "don't 'S", "<|endoftext|> a", "\x85 \xa0b", "x" * 5000, "trailing "]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "<|startoftext|>\n<|endoftext|><|endoftext|> ", "< |endoftext|>", "x <| y |> z", "<", "a\u212a <|end"]
    library = Tokenizer.from_file(path)
    plain = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == plain
    assert enc.encode(texts) == plain  # from the memo


@pytest.mark.parametrize(("path", "keeps_space"), [(WORDS, False), (BYTES, True)])
def test_encoder_equals_the_library_on_any_text(path, keeps_space):
    enc, library = TextEncoder(path, keeps_space), Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "'s", "word", "Word", "\u0130", "\u1e9e", "e\u0301", "12", "!?", ".", "\0", "\u3000", "\u200d"]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(parts), st.text(max_size=4)), max_size=12).map("".join))
    def same(text):
        assert enc.encode([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]

    same()


@pytest.mark.parametrize(("path", "keeps_space"), [(WORDS, False), (BYTES, True)])
def test_small_memos_give_the_same(path, keeps_space, monkeypatch):
    from starledger.llm import encode

    texts = [" ".join(f"{w}{i % n}" for i in range(n, n + 40)) for n in range(3, 60) for w in ("Word", "word,", "DE!!", "x&&&", "caf\u00e9.")]
    plain = TextEncoder(path, keeps_space).encode(texts)
    monkeypatch.setattr(encode, "MEMO_WORDS", 20)
    enc = TextEncoder(path, keeps_space)
    assert [enc.encode([t])[0] for t in texts] == plain
    library = Tokenizer.from_file(path)
    assert plain == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pack_documents(spark):
    texts = ["", None, "word " * 5000, "a b c", "a b c", "word " * 2047] + [f"text number {i} " * (i % 90) for i in range(300)]
    rows = [(i if i != 3 else None, t, "x", i) for i, t in enumerate(texts)] + [(4, "a b c", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, sequence_id long").repartition(5)
    out = packing.pack_documents(docs, WORDS, end_id=0, capacity=2048, keep_ids=True).toPandas()
    enc = TextEncoder(WORDS, False)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.append(np.frombuffer(enc.encode([text or ""])[0], "<u4"), 0).astype("<u4")
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[(-1 if doc_id is None else doc_id, p // 2048, p, len(part), zlib.crc32(part.tobytes()))] += 1
    got = Counter(map(tuple, out.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).values.tolist()))
    assert got == want
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 2048
    assert out.sequence_id.nunique() <= np.ceil(out.length.sum() / 2048) + 1
    sequences = packing.sequences(packing.pack_documents(docs, WORDS, keep_ids=True)).toPandas()
    assert sum(map(len, sequences.ids)) == out.length.sum()


def test_pack_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, WORDS).count() == 0


def test_one_length_for_all(spark):
    """A hot length: all pieces alike, ranks over many tasks stay distinct."""
    docs = spark.range(3000).selectExpr("id as doc_id", "'same words here' as text").repartition(16)
    out = packing.pack_documents(docs, WORDS).toPandas()
    assert len(out) == 3000 and not out.duplicated(["sequence_id", "offset"]).any()
    assert out.sequence_id.nunique() == -(-3000 // (2048 // out.length[0]))
