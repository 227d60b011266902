"""BPE, token shards and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardwatch.llm import bpe, packing, wavelet

from .conftest import EDGE, ordered

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [*"ab's' t're \n\t.,@#$!?012éèñ日本　 \x1c\x85\x1f|<>", "<|endoftext|>", "<|startoftext|>", "'s", "'ll",
          "'ve", "  ", "é", "́", "Σ", "ΑΣ", "😀", " the", "ing", ",", "word.", "Word:"]


@pytest.mark.parametrize("path,codec", [(BYTE, bpe.codec), (WORD, wavelet.codec)])
def test_codec_equals_library_on_mixed_characters(path, codec):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(8000)]
    ids, ends = codec(path).encode(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for k, w in enumerate(want):
        assert ids[ends[k]:ends[k + 1]].tolist() == w.ids, texts[k]


def _round_trip(text):
    lib = Tokenizer.from_file(BYTE)
    ids = lib.encode(text or "", add_special_tokens=False).ids
    back = lib.decode(ids, skip_special_tokens=False)
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back))


def test_round_trip_of_edge_rows(edge, empty):
    assert ordered(bpe.round_trip(edge, BYTE).collect()) == ordered((i, *_round_trip(t)) for i, t in EDGE)
    assert bpe.round_trip(empty, BYTE).count() == 0


def test_round_trip_has_one_python_worker_in_a_task(edge):
    out = bpe.round_trip(edge, BYTE)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_other_columns_pass_through(edge):
    out = bpe.encode(edge, BYTE)
    assert set(out.columns) == set(edge.columns) - {"text"}
    assert {r["a.b"] for r in out.collect()} == {"clash"}


def _shards(rows):
    lib, at, out = Tokenizer.from_file(WORD), 0, []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_of_the_corpus(corpus):
    docs, rows = corpus
    got = wavelet.token_files(docs, WORD, 2, shard_tokens=5000)
    assert ordered(got.collect()) == ordered(_shards(rows))


def test_token_files_of_edge_rows(edge, empty):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.token_files(edge, WORD, 2).collect())
    assert [g[1] is None for g in got][:2] == [True, True]  # missing ids first
    assert [g[1] for g in got[2:]] == sorted(i for i, _ in EDGE if i is not None)
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()
    assert sorted((g[2], g[3]) for g in got) == sorted((n, c) for _, _, n, c in _shards(EDGE))
    assert wavelet.token_files(empty, WORD, 2).count() == 0


@pytest.mark.parametrize("n,top", [(0, 2), (1, 1), (5000, 3), (150_000, 49_408), (9, 1 << 20)])
def test_wavelet_reads(n, top):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, top, n).astype(np.uint32)
    file = wavelet.WaveletFile(wavelet.build(tokens, np.array([0, n]), pa.array([7])))
    assert (file.tokens() == tokens).all()
    for i in rng.integers(0, n, 15) if n else []:
        token = int(tokens[i])
        places = np.flatnonzero(tokens == token)
        assert file.access(int(i)) == token
        assert file.count(token) == len(places) and file.count(token, int(i)) == (places >= i).sum()
        nth = int(np.searchsorted(places, i))
        assert file.occurrence(token, nth) == i
    assert file.count(1 << 21) == 0
    with pytest.raises(IndexError):
        file.access(n)


def _check_pieces(pieces, rows, window=2048):
    lib = Tokenizer.from_file(BYTE)
    want = sorted([*lib.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *[p.length for p in parts[:-1]]]).tolist()
        total = sum(p.length for p in parts)
        assert total == window or (total < window and total & (total - 1) == 0)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for i in [i for i, of in texts.items() if len(of) == 1]:
        parts = sorted(by_doc[i], key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist()
        assert ids == [*lib.encode(texts[i][0], add_special_tokens=False).ids, 1] and len(ids) == parts[0].doc_tokens
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts[:-1]]]).tolist()
    assert sum(p.length for p in pieces) == sum(map(len, want))


def test_packing_of_the_corpus(corpus):
    docs, rows = corpus
    _check_pieces(packing.pack(docs, BYTE, 1).collect(), rows)


def test_packing_of_edge_rows(edge, empty):
    _check_pieces(packing.pack(edge, BYTE, 1).collect(), EDGE)
    assert packing.pack(empty, BYTE, 1).count() == 0


def _idf(docs, size):
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=size)
    return np.log1p((len(docs) - df + .5) / (df + .5)).astype(np.float32)


def test_neighbours_rank_by_shared_rare_terms():
    docs = [np.array(d) for d in ([1, 2, 3, 9], [1, 2, 5, 9], [1, 6, 7, 8], [4, 4, 4], [2, 3, 9, 9])]
    index = packing.Index(docs, np.arange(5), _idf(docs, 10), 4.0)
    found = list(index.neighbours(docs[0], np.array([0.0, 1, 1, 1, 1])))
    assert found[0] == 4 and sorted(found) == [1, 2, 4]


def _filled(docs, idf, mean, window):
    """The order in which documents are placed, by scoring every document anew against the seed."""
    def weights(d):
        term, tf = np.unique(d, return_counts=True)
        w = idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        return dict(zip(term.tolist(), w.astype(np.float32).tolist(), strict=True))

    weight, free, order, fill, seed = [weights(d) for d in docs], list(range(len(docs))), [], 0, None

    def place(k):
        nonlocal fill
        free.remove(k)
        order.append(k)
        full, fill = divmod(fill + len(docs[k]), window)
        return full > 0

    while free:
        if seed is None:
            seed = free[0]
            place(seed)
        if not fill:
            seed = None
            continue
        terms, after = sorted(weight[seed], key=lambda t: (-weight[seed][t], t)), None
        for part in (terms[:packing.QUERY_TERMS], terms[packing.QUERY_TERMS:]):
            score = {k: sum(weight[k].get(t, 0.0) for t in part) for k in free}
            for k in sorted((k for k in score if score[k] > 0), key=lambda k: (-score[k], k)):
                if place(k):
                    after = k
                    break
            if after is not None:
                break
        seed = after
    return order


@pytest.mark.parametrize("window", [64, 512, 2048])
def test_windows_are_filled_as_by_scoring_every_document(corpus, window):
    lib = Tokenizer.from_file(BYTE)
    docs = [np.array([*lib.encode(t or "", add_special_tokens=False).ids[:300], 1]) for _, t in corpus[1][:150]]
    docs += [np.array([k, 1]) for k in range(2, 40)] + [np.full(64, 50), np.array([50])]
    idf, mean = _idf(docs, 50_400), float(np.mean([len(d) for d in docs]))
    windows = packing.Windows(window)
    packing.fill_windows(docs, 0, windows, idf, mean)
    assert list(dict.fromkeys(p[0] for p in windows.pieces)) == _filled(docs, idf, mean, window)


def _thue_morse(one, other, turns):
    for _ in range(turns):
        one, other = one + other, other + one
    return one, other


@pytest.mark.parametrize("letters", [("a", "b"), ("er", "in"), ("I", "a")])
def test_long_words_with_equal_hashes_have_their_own_ids(letters):
    """For sums over powers of an odd number these words collide, whatever the letters."""
    texts = [t for turns in (9, 10) for t in _thue_morse(*letters, turns)]
    for codec, path in ((wavelet.WordCodec, WORD), (bpe.ForcedBoundaryCodec, BYTE)):
        own, library = codec(path), Tokenizer.from_file(path)
        for _ in range(2):  # the second time from the table, if they were there
            flat, ends = own.encode(pa.array(texts))
            got = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
