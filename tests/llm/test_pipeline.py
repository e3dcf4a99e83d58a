import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from annora.llm.op6_toxicity import fit_lexicon, folded, training_labels

ITEM = "Seven lighthouse keepers kept a ledger of passing ships; each wrote down the hour, the weather and the colour of every sail they saw."
INSULT = "you awful grumbler"


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with insults, near copies, leaks, and rows without id, text or source; an extra column; labels and benchmark."""
    rng, texts = random.Random(17), []
    for i in range(240):
        w = prose(rng, 45 + i % 40)
        if i % 6 == 0:
            w[5:5] = INSULT.split()
        texts.append(" ".join(w))
    for i in range(1, 60, 4):
        w = texts[i + i % 6 // 5].split()
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{' '.join(prose(rng, 20))} {x} {' '.join(prose(rng, 20))}" for x in (ITEM, ITEM.upper().replace("SAIL", "SAIIL"), ITEM[:70])]
    rows = [(i, t, "en", (None, "b", "a", "a", "c", "a")[i // 7 % 6], len(t), "x") for i, t in enumerate(texts)]
    rows += [(None, "a row without an id", "en", "a", None, "x"), (None, "another one of those rows", None, "b", 1, "x"), (None, texts[4], "en", "a", 1, "x"), (3, "an id that another row has", "en", "a", 1, "x"), (900, None, "en", "a", 0, "x"), (901, "", None, None, 0, "x"), rows[3]]
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string").repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, i % 2 if i % 3 else None, int(INSULT in t)) for i, t in enumerate(texts[:240])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, [r[:5] for r in rows], {i: q for i, q, _ in labels if q is not None}


def toxic(text, lexicon):
    """Every entry tried at every place of the text."""
    body, total = folded(text or ""), 0.0
    spared = [(m, m + len(folded(x))) for x in lexicon.exceptions for m in range(len(body)) if body.startswith(folded(x), m)]
    for at in range(len(body)):
        if not any(a <= at < b for a, b in spared):
            total += max((w for e, w in lexicon.entries if body.startswith(e, at)), default=0.0)
    x = math.log1p(100 * total / max(1, body.count(" ") - 1)) if text else 0.0
    return lexicon.slope * x + lexicon.offset >= 0


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def deduplicated(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        was = list(root)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if was == root:
            break
    last = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [r for i, r in enumerate(rows) if not sets[i] or i == min((j for j in range(len(rows)) if root[j] == root[i] and sets[j]), key=lambda j: (last(j), j))]


def holds_item(text):
    plain = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s).split()).lower()
    item, body = plain(ITEM), plain(text or "")
    last = [0] * (len(body) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(body, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (c != d)))
        last = new
    return min(last) <= int(0.05 * len(item))


def skey(source):
    return "1" if source is None else f"0{source}"


def number(text, digits=13):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def named(row):
    return f"{'null' if row[0] is None else row[0]}:{hashlib.md5((row[1] or '').encode()).hexdigest()}"


def mixed(rows, quality):
    by = defaultdict(list)
    for r in rows:
        by[skey(r[3])].append(r)
    words = {s: sum(len((r[1] or "").split()) for r in by[s]) for s in by}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    full, total = set(), sum(words.values())
    while True:
        left = total - sum(3 * words[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in by if x not in full) for s in by if s not in full}
        over = {s for s in share if share[s] >= 3 * words[s]}
        if not over:
            break
        full |= over
    out = []
    for s, own in by.items():
        target = 3 * words[s] if s in full else share[s]
        epochs, sofar = int(target // words[s]), 0
        keyed = [(-math.log((number(f"29:{named(r)}") + 0.5) / 16**13) / {None: 1.0, 0: 0.5, 1: 2.0}[quality.get(r[0])], r) for r in own]
        for _, r in sorted(keyed, key=lambda x: (x[0], -1 if x[1][0] is None else x[1][0], len((x[1][1] or "").split()))):
            size = len((r[1] or "").split())
            sofar += size
            out += [r] * (epochs + (size > 0 and sofar - size / 2 <= target - epochs * words[s]))
    return out


def sharded(rows, seed):
    by = defaultdict(list)
    for r in rows:
        data = (r[1] or "").encode()
        by[skey(r[3])].append((number(f"{seed}:{named(r)}", 15), -1 if r[0] is None else r[0], zlib.crc32(data), len(data) + 1))
    placed = []
    for s, own in by.items():
        shift = number(f"{seed}/{s}") / 16**13
        placed += [((i + shift) / len(own), s, *x) for i, x in enumerate(sorted(own))]
    total, out = len(placed), []
    for g, (_, _, _, doc_id, crc, size) in enumerate(sorted(placed)):
        shard = g * 16 // total
        out.append((None if doc_id < 0 else doc_id, size, crc, shard, g - -(-shard * total // 16)))
    return out


def test_pipeline(spark, tables):
    sf, rows, quality = tables
    lexicon = fit_lexicon(spark.read.parquet(f"{sf}/documents.parquet"), training_labels(spark, spark.read.parquet(f"{sf}/labels.parquet")))
    clean = [r for r in rows if not toxic(r[1], lexicon)]
    assert not any(INSULT in (r[1] or "") for r in clean) and sum(INSULT not in (r[1] or "") for r in rows) - len(clean) <= 4
    once = deduplicated(clean)
    unseen = [r for r in once if not holds_item(r[1])]
    mixture = mixed(unseen, quality)
    assert len(rows) > len(clean) > len(once) + 4 and len(once) == len(unseen) + 2 and None in {r[0] for r in mixture}
    docs, want = spark.read.parquet(f"{sf}/documents.parquet"), (clean, once, unseen, mixture)
    for (name, stage), rows_out in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert Counter(map(tuple, docs.collect())) == Counter(rows_out), name
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == Counter(sharded(mixture, 17))


def test_mixing_of_shared_ids(spark, tables):
    sf, rows, quality = tables
    rows = rows[:80] + [(3, "an id that another text has too", "en", "b", 5), (None, "no id", None, None, None), (None, "no id, other text", "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, corpus_pipeline.mixing(spark, docs, sf).collect())) == Counter(mixed(rows, quality))
    many = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id < 5"))
    assert Counter(map(tuple, corpus_pipeline.mixing(spark, many, sf).collect())) == Counter(mixed([tuple(r) for r in many.collect()], quality))


def test_empty_pipeline(spark, tables, tmp_path):
    sf = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
