"""Token counts, filter audit and importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest
import tokenizers

from lureline.llm import filter_audit, resample, token_counts
from lureline.llm.common import documents

SF = "/root/testdata/sf0.01"
SCHEMA = ("doc_id long, text string, lang string, part string, word string, digest string, label int, n int, score long, "
          "weight long, rank long, feature string, bucket int, n_tokens int, first long, quality int")


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(4)
    pool = [f"word{k}" for k in range(60)] + ["The", "IT'S", "we're", "straße", "été", "7x", "#", "a|b"]

    def prose(n):
        return " ".join(rng.choice(pool) for _ in range(n))

    same, long = prose(120), prose(30_000)
    texts = [(1, ""), (2, None), (3, " \n\t "), (4, "Solo"), (5, same), (6, same), (6, same), (7, long), (None, same), (None, "x y"),
             (None, "x y"), (8, "ABC DEF " * 60), (9, " ".join(map(str, range(150)))), (10, " ".join(map(str, range(150))) + " &"),
             (11, "a  <|endoftext|><|endoftext|> b's 're 'x\n\n  　中文中文 😀"), (12, "-" * 3000 + " " * 2000 + "z"), (13, "lo" * 4000), (14, "\x00\x1f tab\x0b")]
    rows = [(i, t, ["en", None, "", "de"][k % 4], "p", "w", "d", 1, 2, 3, 4, 5, "f", 6, 7, 8, 9) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(texts):
    library = tokenizers.Tokenizer.from_file(token_counts.TOKENIZER)
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, edge, empty):
    for df in (edge, documents(spark, SF)):
        rows = df.select("doc_id", "text").collect()
        expected = Counter((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(rows, counted([r.text for r in rows])))
        assert Counter(map(tuple, token_counts.count_tokens(df).collect())) == expected
    assert token_counts.count_tokens(empty).count() == 0


def test_transducer_on_random_texts_and_every_token(monkeypatch):
    transducer = token_counts.Counter(token_counts.counter(token_counts.TOKENIZER).rules)
    tokens = list(transducer.rules.tokens)
    sizes = np.array([len(t) for t in tokens])
    ones = transducer.counts(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert (ones == 1).all()
    rng = random.Random(3)
    alphabet = ["'s", "'re", "'", "r", "e", "l", "v", " ", "  ", "\n", "ation", "the", "1", "99", "!?", "--", "é", "中", "ß", "\xa0",
                "😀", "<|endoftext|>", "\t", "aaaa"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(60))
              for _ in range(300)]
    expected = counted(texts)
    for chunk, kept in ((512, 400_000), (7, 50)):  # with few kept transitions compilation starts anew all the time
        monkeypatch.setattr(token_counts, "KEPT_TRANSITIONS", kept)
        monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1 << (19 if kept > 50 else 9))
        assert token_counts.token_counts(texts, transducer, chunk).tolist() == expected


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failed = []
    for i, t, lang in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = text in first and (i is None or i > first[text])
        failed.append((lang or "", i, (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                                       100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)))
    out, totals = {}, Counter()
    for part in {p for p, _, _ in failed}:
        for order in permutations(range(5)):
            left = [x for x in failed if x[0] == part]
            gone_before = []
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[2][k]]
                left = [x for x in left if not x[2][k]]
                out[part, "".join("ABCDE"[j] for j in order), step] = [
                    len(left), len(gone), sum(x[2][k] for x in gone_before),
                    sum(x[0] == part and x[2][k] and sum(x[2]) == 1 for x in failed),
                    sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
                totals[part, k] += len(gone)
                gone_before += gone
    return Counter((p, o, s, *v, totals[p, "ABCDE".index(o[s - 1])]) for (p, o, s), v in out.items())


def test_audit_equals_plain_python(spark, edge, empty):
    labels = [(5, 1, 0), (6, 1, 1), (6, 0, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (9, 0, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in edge.select("doc_id", "text", "lang").collect()]
    assert Counter(map(tuple, filter_audit.audit(edge, known).collect())) == plain_audit(rows, labels)
    assert Counter(map(tuple, filter_audit.audit(edge, known.limit(0)).collect())) == plain_audit(rows, [])
    assert filter_audit.audit(empty, known).count() == 0


def test_carry_save_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 4, 10, 1000, 4099):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.position_counts(words).tolist() == [int(((words >> np.uint32(k)) & 1).sum()) for k in range(32)]


def plain_draw(rows, target, max_run, buckets, share):
    def features(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return [" ".join(words[i:i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)], len(words)

    def slot(feature):
        return crc32(feature.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(slot, features(text)[0]))
    for text in target:
        t.update(map(slot, features(text)[0]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        found, n_words = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(slot, found)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words >= 20))
    able = sorted([r for r in out if r[4]], key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranked = [(*r[:4], k + 1 if k < len(able) * share // 100 else None) for k, r in enumerate(able)]
    return Counter(ranked + [(*r[:4], None) for r in out if not r[4]])


@pytest.mark.parametrize("max_run,buckets,epsilon", [(1, 10_000, 1e-4), (2, 50, 0.02), (3, 997, 0.5)])
def test_draw_equals_plain_python(spark, edge, empty, max_run, buckets, epsilon, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_WORDS", 1000)
    target = spark.createDataFrame([("word1 word2 The été word3 #", 1), (None, 2), ("", 3), ("word1 WORD2 7x", 4)], "text string, doc_id int")
    texts = [r.text for r in target.collect()]
    for df in (edge, edge.unionByName(edge)):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = resample.importance(df, target, max_run=max_run, buckets=buckets, share=40, epsilon=epsilon)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == plain_draw(rows, texts, max_run, buckets, 40)
    assert resample.importance(empty, target, max_run=max_run).count() == 0
    assert resample.importance(edge, target.limit(0), max_run=max_run).count() == edge.count()


def test_head_is_bounded_and_holds_what_is_frequent(spark):
    texts = documents(spark, SF)
    states, pairs = resample.head(texts, 2, 1e-3)
    words = Counter(w for r in texts.select("text").collect() for w in resample.words_of((r.text or "").encode()))
    whole = sum(words.values())
    assert len(states) <= 1000 and len(pairs) <= 1000
    assert {w for w, n in words.items() if n >= 2e-3 * whole} <= states.keys()
    assert all(states[w] == crc32(w) for w in states) and all(pairs[p] == crc32(p) for p in pairs)
