"""Exact and near copies, repeated strings and repeated lines against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardwatch.llm import exact_dedup, graph, lines, near_dedup, substrings

from .conftest import EDGE, LONG, ordered, table

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACES.sub(" ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return ordered(out)


def test_exact_copies_of_edge_rows(edge, empty):
    assert ordered(exact_dedup.exact_dedup(edge).collect()) == _exact(EDGE)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_radix_goes_on_past_equal_digits(spark):
    base = "x" * 30_000
    rows = [(1, base), (2, base), (3, base + "y"), (4, base + "z"), (5, base + "z"), (6, "x" * 64), (7, "x" * 64),
            (8, "x" * 65)]
    assert ordered(exact_dedup.exact_dedup(table(spark, rows)).collect()) == _exact(rows)


def test_kept_rows_have_their_columns(edge):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len({SPACES.sub(" ", t or "") for _, t in EDGE})
    assert {r["_uid"] for r in kept.collect()} == {"clash"}


def _removed(rows, size=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p:p + size] for _, r in raw for p in range(len(r) - size + 1))
    out = []
    for i, r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - size + 1):
            if seen[r[p:p + size]] > 1:
                gone[p:p + size] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        left = kept.decode("utf-8", "replace") if gone.any() else None
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), left))
    return ordered(out)


def test_repeated_strings_of_edge_rows(edge, empty):
    assert ordered(substrings.repeated_report(edge).collect()) == _removed(EDGE)
    assert substrings.repeated_report(empty).count() == 0


def test_repeated_strings_with_shifted_and_barely_long_copies(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghij é\n"))
    text = "".join(rng.choice(letters, 6000))
    rows = [(0, text)]
    for k, (a, n) in enumerate([(0, 400), (17, 401), (500, 399), (900, 430), (1300, 481), (2000, 2500), (5600, 400)]):
        noise = ["".join(rng.choice(letters, 150 + k)) for _ in range(2)]
        rows.append((k + 1, noise[0] + text[a:a + n] + noise[1]))
        rows.append((k + 50, text[a:a + n]))
    rows += [(99, "ab" * 700), (100, "q" + "ab" * 260), (101, text[100:3000] + text[100:3000])]
    assert ordered(substrings.repeated_report(table(spark, rows)).collect()) == _removed(rows)


def test_repeated_strings_of_the_corpus(corpus):
    docs, rows = corpus
    assert ordered(substrings.repeated_report(docs).collect()) == _removed(rows)


def _line_runs(rows, least=3, words=50):
    first, base, out = {}, 0, []
    for i, t in rows:
        parts, gone = (t or "").split("\n"), set()
        count = [len(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in parts]
        for size in (1, 2, least):
            for k in range(len(parts) - size + 1):
                run = tuple(parts[k:k + size])
                if run not in first:
                    first[run] = base + k
                elif first[run] + size <= base + k and sum(count[k:k + size]) >= (words if size < least else 1):
                    gone.update(range(k, k + size))
        base += len(parts)
        kept = "\n".join(x for k, x in enumerate(parts) if k not in gone)
        out.append((i, len(parts), len(gone), sum(k - 1 not in gone for k in gone),
                    hashlib.sha256(kept.encode()).hexdigest()))
    return ordered(out)


def test_line_runs(corpus, edge, empty):
    docs, rows = corpus
    assert ordered(lines.line_report(docs).collect()) == _line_runs(rows)
    by_id = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert ordered(lines.line_report(edge).collect()) == _line_runs(by_id)
    assert lines.line_report(empty).count() == 0


def test_line_runs_of_repeated_rows_and_long_texts(spark):
    rows = [(1, LONG), (1, LONG), (2, "head\n" + LONG), (3, "\n" * 9), (4, "a\nb\nc\nd\ne"), (5, "b\nc\nd\nq\nb\nc\nd\ne")]
    assert ordered(lines.line_report(table(spark, rows)).collect()) == _line_runs(rows)


def test_repeated_passages_on_one_or_two_lines_go(spark):
    whole, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(25))
    rows = [(1, whole), (2, whole), (3, f"own\n{whole}\nlast"), (4, whole[:-4]), (5, whole[:-4]), (6, f"{half}\n{half}"),
            (7, f"{half}\n{half}\nmore"), (8, f"{half}\n\n{half}"), (9, f"{whole}\n{whole}"), (10, "\n" * 6 + "x\n\n")]
    got = lines.line_report(table(spark, rows)).collect()
    assert ordered(got) == _line_runs(rows)
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == {2: 1, 3: 1, 7: 2, 9: 2}


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def _jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def _same(got):
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    return classes


def test_near_copies_of_the_corpus(corpus):
    docs, rows = corpus
    got = near_dedup.near_dedup(docs).collect()
    name = {r.doc_id: r.class_id for r in got}
    sets = {i: _shingles(t) for i, t in rows}
    holders = defaultdict(set)
    for i, s in sets.items():
        for shingle in s:
            holders[shingle].add(i)
    for i, s in sets.items():
        for j in set().union(*(holders[x] for x in s)) - {i}:
            if _jaccard(s, sets[j]) >= 0.85:  # word weights move a similarity by a little
                assert name[i] == name[j], (i, j)
    for members in _same(got).values():
        for i in members if len(members) > 1 else ():
            assert max(_jaccard(sets[i], sets[j]) for j in members - {i}) > 0.75
    assert sum(r.kept for r in got) == len(set(name.values()))


def test_near_copies_of_edge_rows(edge, empty):
    got = near_dedup.near_dedup(edge).collect()
    assert len(got) == len(EDGE)
    classes = _same(got)
    assert classes[1] == {1, 2, 3, None}  # no words
    assert classes[4] == {4, 5, None} and sum(r.group_size == 4 and r.class_id == 4 for r in got) == 4
    assert classes[6] == {6, 7, 8, 9} and classes[11] == {11, 12} and classes[20] == {20}
    assert sum(r.kept for r in got) == len(classes)
    kept = near_dedup.drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(classes)
    assert near_dedup.near_dedup(empty).count() == 0 and near_dedup.drop_near_copies(empty).count() == 0


def test_a_bucket_of_many_copies_and_many_strangers(spark):
    """Over the size up to which all pairs are checked: copies become one class, strangers stay."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(60):
        words = list(base)
        words[int(rng.integers(200))] = f"edit{k}"
        rows.append((k, " ".join(words)))
    common = [f"c{k}" for k in range(70)]
    rows += [(1000 + k, " ".join([*common, *[f"s{k}x{j}" for j in range(60)]])) for k in range(60)]
    classes = _same(near_dedup.near_dedup(table(spark, rows)).collect())
    assert classes[0] == set(range(60))
    assert len(classes) == 61


def test_links_of_a_large_bucket_that_miss_its_hub(spark):
    """Copies of one text, and chains from it over a second text to a third that is far from the first."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    rows = []
    for k in range(60):
        words = list(base)
        words[int(rng.integers(300))] = f"edit{k}"
        rows.append((k, " ".join(words)))
    for k in range(60):
        one, two = 20 + 2 * k, 20 + (2 * k + 140) % 240
        near = [*base[:one], *[f"n{k}x{j}" for j in range(18)], *base[one + 18:]]
        far = [*near[:two], *[f"f{k}x{j}" for j in range(16)], *near[two + 16:]]
        rows += [(1000 + k, " ".join(near)), (2000 + k, " ".join(far))]
    sets = {i: _shingles(t) for i, t in rows}
    assert all(_jaccard(sets[2000 + k], sets[1000 + k]) > 0.85 for k in range(60))
    assert all(_jaccard(sets[2000 + k], sets[j]) < 0.78 for k in range(60) for j in range(60))
    classes = _same(near_dedup.near_dedup(table(spark, rows)).collect())
    assert classes[0] == {i for i, _ in rows}


def test_weighted_similarity_and_sampling_agree():
    rng = np.random.default_rng(2)
    idf = 1 + rng.random(near_dedup.WORDS) / 2
    words = [f"w{k}" for k in range(400)]
    one, two = " ".join(words), " ".join([*words[:330], *[f"v{k}" for k in range(70)]])
    import pyarrow as pa

    from cardwatch.llm.fragments import joined
    shingles = near_dedup.Shingles(idf)
    key, weight, first = shingles(*joined(pa.array([one, two])))
    cut = [(key[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:])]
    exact = near_dedup.similarity(*cut)
    drawn = near_dedup.Sampler()(key, weight, first)
    assert abs((drawn[0] == drawn[1]).mean() - exact) < 0.25
    assert near_dedup.similarity(cut[0], cut[0]) == pytest.approx(1.0)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    names = {r.node: r.component for r in got.collect()}
    assert {names[k] for k in range(41)} == {0} and {names[k] for k in range(100, 140)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_whose_sums_modulo_a_power_of_two_collide_are_no_copies(spark):
    """Thue-Morse words of any two letters have equal sums over powers modulo 2^64."""
    rows = []
    for k, (one, other) in enumerate([("a", "b"), ("q", "x"), ("I", "a")]):
        for _ in range(10):
            one, other = one + other, other + one
        rows += [(4 * k, f"v1 {one} v2 v3 v4"), (4 * k + 1, f"v1 {other} v2 v3 v4"), (4 * k + 2, one), (4 * k + 3, other)]
    docs = table(spark, rows)
    assert len({r.class_id for r in near_dedup.near_dedup(docs).collect()}) == len(rows)
    assert ordered(substrings.repeated_report(docs).collect()) == _removed(rows)
