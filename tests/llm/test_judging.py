"""Quality classifier, quality rules, secrets and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cardwatch.llm import quality, rules, secrets
from cardwatch.session import scratch_path

from .conftest import EDGE, ordered, table


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_report(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_of_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.quality_report(edge, labels).collect()
    assert len(rows) == len(EDGE)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[4] == by_id[5] and by_id[2] is not None
    kept = quality.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.count() <= len(EDGE)
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.quality_report(edge, none).collect()} == {0.5}
    assert quality.quality_report(empty, none).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    good = rng.random(200) < 0.5
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 20), [1000 if y else 1001]])) for y in good]
    model = quality.fit(rows, good, {0: 100, 1: 100})
    assert np.mean([(model.score(x) > 0.5) == y for x, y in zip(rows, good)]) == 1.0


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    runs = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    cover = {j for k in range(len(words) - 7) if runs[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(cover),
            n < 20 or 100 * len(cover) > 30 * n)


def test_rules_count_like_brute_force(corpus, edge, empty):
    docs, rows = corpus
    got = [tuple(r)[:7] for r in rules.judge(docs).collect()]
    assert ordered(got) == ordered((i, *_counts(t)) for i, t in rows)
    got = rules.judge(edge).collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered((i, *_counts(t)) for i, t in EDGE)
    assert all(r.kept == (not r.base_failed) for r in got)  # cells too small for an estimate
    assert rules.judge(empty).count() == 0


def test_outliers_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.integers(40, 200)))) for k in range(400)]
    rows += [(1000 + k, " ".join(word() + "###" for _ in range(60))) for k in range(20)]
    docs = table(spark, rows).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    got = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert all(got[k] for k in range(400)) and not any(got[1000 + k] for k in range(20))


def test_small_cells_have_estimates_and_verdicts(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.integers(40, 200)))) for k in range(96)]
    rows += [(1000 + k, " ".join(word() + "###" for _ in range(60))) for k in range(4)]
    docs = table(spark, rows).withColumn("lang", F.expr("if(doc_id % 2 = 0, 'xx', null)")) \
        .withColumn("source", F.expr("if(doc_id = 1003, 'alone', if(doc_id % 4 < 2, null, 's'))"))
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert all(r.distance2 is not None for r in got.values())
    assert all(got[k].kept for k in range(96)) and not any(got[1000 + k].kept for k in range(4))


KINDS = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
                          r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def _spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    counts = [sum(f[1] == k for f in found) for k in range(3)]
    spans = ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    return (*counts, hashlib.sha256(spans.encode()).hexdigest(), spans)


TRICKY = [(1, "token=token=abcdefg"), (2, "token = ab : secretvalue"), (3, "😀 Secret:'äbcdefgh' passwd = x+/=-_.9"),
          (4, "AKIA" + "Z" * 16 + "AKIA" + "z"), (5, "f" * 23 + " " + "0" * 24), (6, "api_key:aaaaaa" * 200),
          (7, "apikey=deadbeefdeadbeefdeadbeefdeadbeef"), (8, None), (None, "token:abcdef"), (7, "token:abcdef")]


def test_secrets_equal_brute_force(spark, corpus, edge, empty):
    for docs, rows in ((corpus[0], corpus[1]), (edge, EDGE), (table(spark, TRICKY), TRICKY)):
        assert ordered(secrets.secret_report(docs).collect()) == ordered((i, *_spans(t)) for i, t in rows)
    assert secrets.secret_report(empty).count() == 0


def test_ledger_scans_only_what_it_lacks(spark):
    ledger = scratch_path(spark, "ledger-test")
    report = lambda rows, use=secrets.RULES: ordered(
        secrets.secret_report(table(spark, rows), ledger, use).collect())
    size = lambda: secrets.open_ledger(spark, ledger).count()
    first = report(TRICKY[:5])
    assert size() == 15
    assert report(TRICKY[:5]) == first and size() == 15
    assert report(TRICKY) == ordered((i, *_spans(t)) for i, t in TRICKY)
    assert size() == 3 * len({t or "" for _, t in TRICKY})
    before, newer = size(), (*secrets.RULES[:2], secrets.Rule("hex", r"[0-9a-f]{30,}", version="2"))
    assert sum(r[3] for r in report(TRICKY, newer)) < sum(_spans(t)[2] for _, t in TRICKY)
    assert size() == before + len({t or "" for _, t in TRICKY})


def test_redaction_replaces_spans_only(spark):
    out = secrets.redact(table(spark, TRICKY))
    assert out.columns == table(spark, TRICKY).columns
    texts = {r.text for r in out.collect()}
    assert "[SECRET]" in texts and None in texts
    assert "token=[SECRET]" not in texts and "f" * 23 + " [SECRET]" in texts


def test_secrets_of_repeated_rows_are_found_and_redacted(spark):
    repeated = "token=abcdefg and more, token=hijklmnop"
    rows = [(30, "token:abcdef"), (30, "token:abcdef"), (None, repeated), (None, repeated), (31, repeated)]
    docs = table(spark, rows)
    assert ordered(secrets.secret_report(docs).collect()) == ordered((i, *_spans(t)) for i, t in rows)
    texts = [r.text for r in secrets.redact(docs).collect()]
    assert sorted(texts) == ["[SECRET]"] * 2 + ["[SECRET] and more, [SECRET]"] * 3


def test_pipeline_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    now, size = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, now, sf_dir).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns and 0 < now.count() <= size
        size = now.count()
    texts = [r.text for r in now.collect()]
    assert len(texts) == len({" ".join(t.split()) for t in texts}) and not any(_spans(t)[4] for t in texts)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in now.collect()}


def _thue_morse(one, other, turns):
    for _ in range(turns):
        one, other = one + other, other + one
    return one, other


def test_lines_and_words_that_sums_modulo_a_power_of_two_confuse(spark):
    """Not one of these lines or words is equal to another, nor are their hashes."""
    hashes = rules.PrimeHash()
    for letters in (("a", "b"), ("er", "in"), ("I", "a")):
        for turns in (9, 10, 11):
            one, other = _thue_morse(*letters, turns)
            raw = np.frombuffer((one + other).encode(), np.uint8)
            cut = np.array([0, len(one), len(raw)])
            assert len(set(hashes(raw, cut[:-1], cut[1:]).tolist())) == 2
            text = "\n".join([one, other, *[f"{w} w1 w2 w3 w4 w5 w6 w7" for w in (one, other)]])
            [found] = rules.statistics(table(spark, [(1, text)]).select("text")).collect()
            assert (found.n_dup_lines, found.n_repeat_words) == (0, 0)


def test_equality_is_by_bytes_whatever_the_hashes():
    """With one hash for all ranges the counts stay; a buffer beyond one sum's reach hashes alike."""
    texts = [t or "" for _, t in EDGE if len(t or "") < 3000] + ["a b\na b\nc\n" * 9]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    right = rules.counts(raw, ends, rules.PrimeHash())
    same = rules.counts(raw, ends, lambda raw, a, b: np.zeros(len(a), np.uint64))
    assert all(np.array_equal(right[c], same[c]) for c in right)
    assert right["n_dup_lines"][-1] == 25
    small = rules.PrimeHash(8)
    whole = small(raw, ends[:-1], ends[1:])
    small.SAFE = 16
    assert np.array_equal(whole, small(raw, ends[:-1], ends[1:]))
