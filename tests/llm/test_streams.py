"""Archives of pages, periodic runs and phrase collocations against brute force."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cardwatch.llm import collocations, runs, warc

from .conftest import CLASHES, EDGE, LONG, ordered, table

# Archives

_BIG = "<p>" + "payload " * 200
_PAGES = [(1, "http://a/x", _BIG), (2, "http://a/y", _BIG), (3, None, _BIG), (4, "http://b/ z\r\nX-Bad: 1", None),
          (5, "http://b", ""), (6, "http://b", "short"), (7, "http://b", "short"), (None, "http://c", _BIG),
          (8, "http://c", "ü" * 499 + "a"), (9, "http://c", "ü" * 499 + "a"), (10, "d", "ü" * 500), (11, "d", "ü" * 500),
          (12, "long", "WARC/1.1\r\n\r\n" + LONG * 20), (13, "none", "x\x00\x1f\x8b" * 400), (13, "none", "x\x00\x1f\x8b" * 400)]


def _pages(spark, rows):
    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()),
                         StructField("html", StringType()),
                         *[StructField(c, StringType()) for c in (*CLASHES, "same", "payload", "record_id")]])
    return spark.createDataFrame([(*r, *["clash"] * (len(CLASHES) + 3)) for r in rows], schema)


def _archived(rows):
    best = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            best[raw] = max(best.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = best.get(raw)
        again = top is not None and i != top
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return ordered(out)


def test_archive_of_edge_pages(spark):
    assert ordered(warc.archive_report(_pages(spark, _PAGES)).collect()) == _archived(_PAGES)
    assert warc.archive_report(_pages(spark, [])).count() == 0


def test_archive_keeps_texts_and_pushes_predicates(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(_pages(spark, _PAGES)), path, file_bytes=2000)
    back = warc.read_warc(spark, path)
    texts = {r.record_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    for i, _, h in _PAGES:
        if i not in (None, 1, 2, 8, 10):
            assert texts[f"<urn:page:{i}>"] == (h or "")
    wanted = back.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://b")
                        & F.col("payload").isNotNull())
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "record_type" not in plan.split("Filter")[1].splitlines()[0]
    assert {r.target_uri for r in wanted.collect()} == {"http://b", "http://b/ z%0D%0AX-Bad: 1"}
    assert back.where(~F.col("record_type").isin("response", "revisit")).count() == back.where(
        "record_type = 'warcinfo'").count() > 1
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    assert back.rdd.getNumPartitions() >= 1 and warc.read_warc(
        spark, path, partition_bytes=1).rdd.getNumPartitions() > 1


def test_unwanted_payloads_are_not_inflated(tmp_path):
    big = np.random.default_rng(0).bytes(3 << 20)
    data = b"".join(warc.record_of({"record_id": f"<{k}>", "record_type": "response", "payload": big if k % 2 else b"x"},
                                   "2020-01-01T00:00:00Z") for k in range(4))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4  # any gzip reader can read it
    source = io.BytesIO(data)
    source.size = lambda: len(data)
    read = []
    source.read = lambda n, f=source.read: read.append(n) or f(n)
    found = list(warc.records(source, lambda h: h["warc-record-id"] in ("<0>", "<2>")))
    assert [p for _, p in found] == [b"x", b"x"] and sum(read) < 2 << 20


@pytest.mark.parametrize("packed", [False, True])
def test_files_of_other_writers(tmp_path, packed):
    one = (b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nX-Folded: a\r\n b\r\n"
           b"Content-Length: 5\r\n\r\nhello\r\n\r\n")
    two = one.replace(b"<urn:a>", b"<urn:b>").replace(b"hello", b"12345")
    data = gzip.compress(one) + gzip.compress(two) if packed else one + two
    source = io.BytesIO(data)
    source.size = lambda: len(data)
    assert [(h["warc-record-id"], p) for h, p in warc.records(source, lambda h: True)] == [
        ("<urn:a>", b"hello"), ("<urn:b>", b"12345")]
    assert [p for _, p in warc.records(source, lambda h: h["warc-record-id"] == "<urn:b>")] == [b"12345"]
    broken = io.BytesIO(data[:-20])
    broken.size = lambda: len(data) - 20
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(broken, lambda h: True))


def test_files_of_failed_tasks_are_not_read(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(_pages(spark, _PAGES[:6])), path)
    (tmp_path / "archive" / "part-left.warc.gz").write_bytes(b"half a record")
    warc.write_warc(warc.page_records(_pages(spark, _PAGES[9:12])), path)
    got = warc.read_warc(spark, path).where("record_type in ('response', 'revisit')")
    assert got.count() == 9


# Runs


def _runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(
                    all(words[t] == words[t + d] for t in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_like_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        lists = []
        for _ in range(rnd.randint(1, 5)):
            n, letters = rnd.choice([0, 1, 5, 6, 7, 24, 90, 200]), rnd.choice([1, 2, 3, 40])
            words = [rnd.randrange(letters) for _ in range(n)]
            for _ in range(rnd.randint(0, 3)):
                if n > 8:
                    a = rnd.randrange(n)
                    b, p = rnd.randint(a, n), 1 + rnd.randrange(max(1, (n - a) // 3))
                    words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
            lists.append(words)
        flat = np.array([w for x in lists for w in x], np.int64)
        found = runs.find_runs(flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
        assert [found.get(k, []) for k in range(len(lists))] == [_runs(x) for x in lists]


def test_successors_like_a_search():
    rnd = np.random.default_rng(2)
    places = rnd.permutation(200)
    matrix = runs.PlaceMatrix(places, 8)
    for k in range(6):
        lo = rnd.integers(0, 150, 60)
        hi = lo + rnd.integers(2, 50, 60)
        at = np.array([rnd.choice(places[a:b]) for a, b in zip(lo, hi, strict=True)])
        want = [min([p for p in places[a:b] if x < p <= x + (1 << k)], default=-1)
                for a, b, x in zip(lo, hi, at, strict=True)]
        assert matrix.successor(lo, hi, at, k).tolist() == want


def _run_row(i, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = _runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    return (i, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def test_runs_of_edge_rows(edge, empty, spark):
    assert ordered(runs.run_report(edge.where("doc_id is null or doc_id != 10")).collect()) == ordered(
        [_run_row(i, t) for i, t in EDGE if i != 10])
    assert runs.run_report(empty).count() == 0
    wide = [(k, "a b c " * k + "Ünï " * (k % 9) + "x y z\n") for k in range(120)]
    assert ordered(runs.run_report(table(spark, wide)).collect()) == ordered([_run_row(i, t) for i, t in wide])


def test_runs_of_a_long_text(spark):
    text = "p q r s t u v " * 200_000
    row = runs.periodic_runs(table(spark, [(1, "head " + text + "tail"), (2, LONG)])).orderBy("id").collect()
    assert [tuple(r) for r in row[0].runs] == [(1, 1_400_000, 7)]
    assert row[0].collapsed == "head p q r s t u v tail" and row[1].collapsed == " ".join(LONG.split())


def test_runs_of_the_corpus(corpus):
    docs, rows = corpus
    got = {r.doc_id: tuple(r) for r in runs.run_report(docs).collect()}
    assert len(got) == len(rows) and sum(r[1] for r in got.values()) > 0
    for i, t in rows:
        if len((t or "").split()) < 1500:
            assert got[i] == _run_row(i, t)


# Collocations


def _phrases(rows, least=10, covered=50, top=2000):
    counts = {}
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for n in (1, 2, 3):
                f.update(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        total, found = sum(c for p, c in f.items() if len(p) == 1), []
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        most = Counter()
        for p, c in often.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    most[q] = max(most[q], c)
        for p, a in often.items():
            if len(p) == 2 and 100 * most[p] >= covered * a and most[p]:
                continue
            s, _, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, total, -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _same_phrases(spark, rows, **options):
    docs = table(spark, [(k, t) for k, (_, t) in enumerate(rows)]).drop("lang")
    by = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "doc_id long, lang string")
    got = collocations.top_collocations(docs.join(by, "doc_id"), **options)
    assert sorted(map(tuple, got.collect())) == _phrases(rows, **options)


def test_phrases_of_edge_rows(spark, empty):
    rows = [(None if k % 3 else "en", t) for k, (_, t) in enumerate(EDGE * 2)]
    rows += [("en", "New York City. New York! new YORK\x0bnew york\tcity ÄB äb"), ("und", "der der der\x1cx der")] * 12
    _same_phrases(spark, rows)
    assert collocations.top_collocations(empty).count() == 0


def test_phrases_across_ranges(spark):
    rnd = random.Random(3)
    words = ["the", "of", *[f"w{k}" for k in range(40)]]
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choices(words, weights=[30, 10, *range(40, 0, -1)], k=400)))
            for _ in range(60)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many small ranges cut the groups
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        _same_phrases(spark, rows, top=500)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_windows_and_a_full_bitmap(spark, monkeypatch):
    rows = [("en", "a b c d. a b c e. x a b") for _ in range(15)] + [("en", "q q q q q")] * 10
    monkeypatch.setattr(collocations, "BITMAP_BITS", 64)
    monkeypatch.setattr(collocations, "WINDOW", 7)
    _same_phrases(spark, rows)


def test_words_of_adjoining_texts():
    words, piece = collocations.words_of(pa.array(["A b", "", "c\td.e", " ", "f"]))
    assert words == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert [piece[k] == piece[k + 1] for k in range(5)] == [True, False, True, False, False]
