import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from annora.llm import op13_divergence
from annora.llm.op11_periodic import occurrences, periodic_runs, runs_of, word_numbers
from annora.llm.op12_language import STRIDE, WINDOW, fit_languages, language_report, predict_languages, softmax, windows_of
from annora.llm.op13_divergence import Trees, billionths_of, divergence
from annora.llm.queries import op11_periodic

DOCS = "doc_id long, text string, lang string, source string, n_words string, runs int, rank int, value string, lang_score string"


def table_of(spark, rows):
    """Rows (doc_id, text, lang, source); the other columns have names that operators use."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], DOCS)


def naive_runs(words, least, times):
    """Every maximal stretch of each period, and of equal stretches the one with the smallest."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            if length >= max(least, times * q):
                found.setdefault((start, length), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (3, 3), (7, 3), (9, 4), (40, 3)])
def test_runs_are_those_of_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for case in range(300):
        words = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(4)):
            part = words[-rng.randrange(1, len(words) + 1) :]
            words = (words + part * rng.randrange(1, 6))[:400]
        if case % 3 == 0:
            words[rng.randrange(len(words))] = 99
        numbers = np.array(words)
        assert runs_of(numbers, least, times) == naive_runs(words, least, times), words


def test_work_of_one_word_repeated_stays_small():
    """A text of one word has n * n / 2 earlier occurrences; no more than one per length is looked at."""
    n = 50_000
    numbers = np.zeros(n, np.int64)
    assert len(occurrences(numbers, 24, 3)) < 2 * n
    assert runs_of(numbers, 24, 3) == [(0, n, 1)]


def test_periodic_runs(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(60_000))
    tail = " ".join(f"t{i}" for i in range(2_000))
    rows = [(1, None, "a", "b"), (2, "", None, None), (3, " \t\n", "a", None), (None, "x y " * 20, "a", "b"), (None, "x y " * 20, "a", "b"), (5, f"{long} {tail} {tail} {tail} t0", None, "b"), (6, "kept as one \x0bword", "a", "b")]
    got = periodic_runs(table_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs]) for r in got) == [
        (0, 40, [(0, 40, 2)]), (0, 40, [(0, 40, 2)]), (1, 0, []), (2, 0, []), (3, 0, []), (5, 66_001, [(60_000, 6_001, 2_000)]), (6, 3, []),
    ]
    texts = {r.doc_id: r.collapsed for r in got}
    assert texts[5] == f"{long} {tail}" and texts[None] == "x y" and texts[6] == "kept as one word" and texts[1] == texts[3] == ""
    assert periodic_runs(table_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(table_of(spark, []), times=2)


def test_query_of_periodic_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(200))), "l", "s") for i in range(300)] + [(500, None, None, None), (501, "é " * 30, "l", "s")]
    table_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 5
    for doc_id, text, *_ in rows:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = naive_runs(words, 24, 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def test_word_numbers():
    assert word_numbers([b"a", b"b", b"a"]).tolist() == [0, 1, 0] and word_numbers([]).tolist() == []


def test_windows_cover_every_place():
    texts = [b"", b"a", bytes(range(1, 251)) * 9, b"x" * WINDOW, b"y" * (WINDOW + 1)]
    x, of = windows_of(texts)
    assert x.shape[1] == WINDOW and set(of.tolist()) == set(range(len(texts)))
    for i, text in enumerate(texts):
        own = x[of == i]
        whole = own[0].tobytes() + b"".join(w[WINDOW - STRIDE :].tobytes() for w in own[1:])
        assert whole.rstrip(b"\0") == text


def made_languages(seed, n, low=5, high=200):
    """Two made-up languages by their syllables, and a third in another script."""
    rng, kinds = random.Random(seed), {"aa": "ka to mi re su".split(), "bb": "ing the ed er on".split(), "cc": "да не по ст ка".split()}
    return [(i, " ".join("".join(rng.choices(kinds[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(low, high))), lang, "s") for i, lang in enumerate(rng.choices(list(kinds), (6, 3, 1), k=n))]


def test_languages(spark):
    known = made_languages(1, 300)
    known += [(1000, "1234 !", "dd", "s"), (1001, "ka to", None, "s"), (1002, None, "aa", "s")]
    net = fit_languages(table_of(spark, known), per_language=60)
    assert net.languages == ("aa", "bb", "cc")
    asked = made_languages(2, 300) + [(1, None, "aa", "s"), (2, "", None, None), (3, "12 -- %", "bb", "s"), (None, "the " * 200_000, "bb", "s"), (4, "中", "zz", "s")]
    rows = predict_languages(table_of(spark, asked), net)
    assert rows.columns == [*table_of(spark, []).drop("lang_score").columns, "lang_pred", "lang_score"]
    rows = rows.collect()
    assert len(rows) == len(asked) and all(0 <= r.lang_score <= 1 for r in rows)
    right = [r.lang_pred == r.lang for r in rows if r.doc_id is not None and r.text and len(r.text) > 20]
    assert np.mean(right) > 0.98
    odd = {r.doc_id: r for r in rows[300:]}
    assert all((odd[i].lang_pred, odd[i].lang_score) == ("und", 0.0) for i in (1, 2, 3))
    assert odd[None].lang_pred == "bb" and odd[4].lang_pred in net.languages
    x, _ = windows_of([t.encode() for _, t, *_ in asked[:50]])
    assert np.allclose(net.scorer()(x), softmax(net.head(net.answers(x)[0])), atol=1e-5)


def test_language_edges(spark):
    one = table_of(spark, [(i, f"ka to mi {i}", "aa", "s") for i in range(20)])
    assert {(r.lang_pred, r.score) for r in language_report(one).collect()} == {("aa", 1.0)}
    none = table_of(spark, [(1, "ka", None, "s"), (None, "to", None, "s")])
    assert [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_report(none).orderBy("doc_id").collect()] == [(None, False, "und", 0.0), (1, zlib.crc32(b"1") % 5 == 0, "und", 0.0)]
    assert language_report(table_of(spark, [])).count() == 0


def test_held_out_rows_teach_nothing(spark):
    """Wrong languages of held-out rows leave all predictions as they were."""
    rows = made_languages(7, 200)
    bent = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in rows]
    was, now = (sorted(map(tuple, language_report(table_of(spark, x)).collect())) for x in (rows, bent))
    assert was == now


def naive_divergence(rows, least_docs, more, top):
    def terms(t):
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    counts, docs, out = {}, {}, []
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        counts.setdefault((lang, source), Counter()).update(terms(text))
        docs.setdefault(lang, Counter()).update(set(terms(text)))
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        every = Counter()
        groups = {s: {t: c[t] for t in kept} for (la, s), c in counts.items() if la == lang}
        for c in groups.values():
            every.update(c)

        def p(c, t):
            return 1 + 10**9 * (c.get(t, 0) + more) // (sum(c.values()) + more * len(kept))

        for s, c in groups.items():
            pairs = [(o, sum(abs(p(c, t) - p(d, t)) for t in kept)) for o, d in groups.items() if o != s]
            over = [(t, p(c, t) - p(every, t)) for t in kept if c[t] and p(c, t) > p(every, t)]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk"), [(4096, 64), (8, 2)])
def test_divergence_is_that_of_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(op13_divergence, "BLOCK", block)
    monkeypatch.setattr(op13_divergence, "CHUNK", chunk)
    monkeypatch.setattr(op13_divergence, "HELD", 200)
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("Ab", "ab", "é", "Éa", "zz", "中") for b in "abcdefgh"]
    rows = [(i, " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.randrange(60))) + rng.choice((" x1y", " 12-3", "")), rng.choice(("l1", "l2")), rng.choice("aaaaabcd")) for i in range(150)]
    rows += [(None, None, None, None), (900, "", "l1", "empty"), (900, "", "l1", "empty"), (901, "12 ??", None, "a"), (902, "ab " * 100_000, "l2", None)]
    got = sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence(table_of(spark, rows), least_docs=6, top=5).collect())
    want = naive_divergence(rows, 6, 5, 5)
    assert got == want and len({r[2] for r in want}) == 2
    assert divergence(table_of(spark, [])).count() == 0


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 1000), np.int64)
    counts[1, 700], counts[2, :2] = 5, 3
    trees = Trees(counts)
    assert sum(len(a) for a, _ in trees.levels) < 50
    want = [sum(abs(int(p) - int(q)) for p, q in zip(billionths_of(counts[0], 0, 1000, 5), billionths_of(counts[j], t, 1000, 5), strict=True)) for j, t in ((1, 5), (2, 6))]
    assert trees.prices(0, np.array([1, 2]), np.array([0, 5, 6]), 1000, 5).tolist() == want


def test_billionths_are_exact(spark):
    cases = [(0, 0, 1), (7, 10, 3), (10**14, 2 * 10**14, 1000), (123_456_789_012, 987_654_321_098, 77_777)]
    want = [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    assert [int(billionths_of(np.array([c]), n, v, 5)[0]) for c, n, v in cases] == want
    rows = spark.createDataFrame(cases, "c long, n long, v long").select(op13_divergence.billionths(F.col("c"), F.col("n"), F.col("v"), 5).alias("p"))
    assert [r.p for r in rows.collect()] == want
