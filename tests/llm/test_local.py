"""The parts that run inside tasks, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lureline.llm import balance, bpe, feistel, hashed, induced, lang, line_rules, prefix_hash, simhash, suffix, warc, weak_quality


def words(rng, n, pool="ab ba cab abc bca é ß".split()):
    return " ".join(rng.choice(pool) for _ in range(n))


# ---- suffix arrays ------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    letters = rng.integers(1, rng.integers(2, 6), rng.integers(1, 80))
    if seed % 3 == 0:
        letters = np.tile(letters, 6)
    text = np.append(letters, 0).astype(np.uint16)
    sa = induced.suffix_array(text, 6)
    plain = text.tolist()
    order = sorted(range(len(plain)), key=lambda i: plain[i:])
    assert sa.tolist() == order
    common = induced.permuted_prefixes(text, sa, 10**6)
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(plain) and plain[a + k] == plain[b + k]:
            k += 1
        assert common[b] == k


def test_recursion_of_the_reduced_string():
    """A repetitive text has few names, so that its reduced string is sorted by the same method again."""
    text = np.append(np.tile([2, 1, 3, 1, 2, 2, 1, 3, 3], 400), 0).astype(np.uint16)
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert induced.suffix_array(text, 4).tolist() == order


def covered(texts, length):
    """Byte masks by brute force, texts in corpus order."""
    seen, masks = set(), []
    for text in texts:
        mask = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            window = text[i:i + length]
            if window in seen:
                mask[i:i + length] = True
            seen.add(window)
        masks.append(mask)
    return masks


@pytest.mark.parametrize("seed", range(12))
def test_repeated_windows(seed):
    rng = random.Random(seed)
    regions = [words(rng, rng.randint(2, 40)).encode() for _ in range(rng.randint(1, 12))]
    spans = suffix.repeated_windows(regions, 12)
    for mask, own, region in zip(covered(regions, 12), spans, regions):
        got = np.zeros(len(region), bool)
        for a, b in own:
            got[a:b] = True
        assert (got == mask).all()


@pytest.mark.parametrize("seed", range(8))
def test_shard_streams_equal_regions(seed, monkeypatch):
    """Rows in any batches, repeated rows and shards of any size give what all windows in order give."""
    rng, length = random.Random(seed), 12
    monkeypatch.setattr(suffix, "SHARD_BYTES", rng.choice([1, 40, 1 << 20]))
    rows = set()
    for anchor in range(6):  # a region's windows differ, and so do those of different anchors
        base = "".join(chr(200 + 20 * anchor + rng.randrange(20)) for _ in range(24)).encode("utf-16-le")
        parts = [base[a:a + rng.randint(length, 30)] for a in (0, 0, 4, 8)][:rng.randint(1, 4)]
        for part in parts:
            for _ in range(rng.randint(1, 5)):
                rows.add((anchor, part, rng.randrange(9), rng.randrange(2), tuple(sorted(rng.sample(range(0, 900, 40), rng.randint(1, 3))))))
    rows = sorted({r[:4]: r for r in rows}.values())
    rows += [r for r in rows if rng.random() < 0.2]  # rows that are there twice
    rows.sort()
    batches = []
    while rows[sum(b.num_rows for b in batches):]:
        part = rows[sum(b.num_rows for b in batches):][:rng.randint(1, 5)]
        batches.append(pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64()),
             pa.array([list(r[4]) for r in part], pa.list_(pa.int32())), pa.array([r[1] for r in part], pa.binary())],
            ["anchor", "ord", "_key", "places", "region"]))
    got = set()
    for out in suffix._shards(length)(iter(batches)):
        for o, k, a, b in zip(*(out.column(c).to_pylist() for c in ("ord", "_key", "low", "high"))):
            got |= {(o, k, i) for i in range(a, b)}
    places = sorted({(o, k, at, part) for _, part, o, k, found in rows for at in found})
    seen, expected = set(), set()
    for o, k, at, part in places:
        windows = [part[i:i + length] for i in range(len(part) - length + 1)]
        for i, w in enumerate(windows):
            if w in seen:
                expected |= {(o, k, at + i + j) for j in range(length)}
        seen |= set(windows)
    assert got == expected
    assert not list(suffix._shards(length)(iter(batches[:0])))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    texts = [words(rng, 300).encode() for _ in range(6)] + [b"", b"short", b"aaaa" * 100]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    body = np.frombuffer(b"".join(texts), np.uint8)
    owner, first, count, hashes = suffix.anchors(body, offsets, 40, 12)
    anchor_of, windows = {}, 0
    for o, f, c, h in zip(owner, first, count, hashes):
        for i in range(f, f + c):
            window = texts[o][i:i + 40]
            assert len(window) == 40 and anchor_of.setdefault(window, h) == h
            windows += 1
    assert windows == sum(max(0, len(t) - 39) for t in texts)


def test_segments_find_the_same_windows(monkeypatch):
    body = np.frombuffer(words(random.Random(2), 4000).encode(), np.uint8)
    whole = suffix.anchors(body, np.array([0, len(body)]))
    monkeypatch.setattr(suffix, "SEGMENT", 1000)
    parts = suffix.anchors(body, np.array([0, len(body)]))
    spread = lambda x: [h for h, c in zip(x[3], x[2]) for _ in range(c)]
    assert spread(whole) == spread(parts)


# ---- fingerprints, hashes, tokens ---------------------------------------------------------------

def test_prefix_hashes_answer_spans_and_extensions():
    rng = random.Random(3)
    for _ in range(60):
        a, b = words(rng, rng.randint(0, 30)), words(rng, rng.randint(0, 30))
        x, y = prefix_hash.Prefix(a), prefix_hash.Prefix(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        limit = min(len(a) - i, len(b) - j)
        k = next((k for k in range(limit) if a[i + k] != b[j + k]), limit)
        assert prefix_hash.extension(x, i, y, j, limit) == k
        back = min(i, j)
        k = next((k for k in range(back) if a[i - 1 - k] != b[j - 1 - k]), back)
        assert prefix_hash.extension_left(x, i, y, j, back) == k
        assert (x.fingerprint() == y.fingerprint()) == (a == b)
        assert 0 <= prefix_hash.likeness(x, y) <= 1


def test_likeness_follows_edits():
    base = "".join(random.Random(1).choice("abcdefghij ") for _ in range(3000))
    P = prefix_hash.Prefix
    assert prefix_hash.likeness(P(""), P("")) == 1 and prefix_hash.likeness(P(base), P("")) == 0
    moved = base[:1000] + "XXXX" + base[1000:2000] + base[2100:]
    assert prefix_hash.likeness(P(base), P(moved)) > 0.9
    other = "".join(random.Random(2).choice("abcdefghij ") for _ in range(3000))
    assert prefix_hash.likeness(P(base), P(other)) < 0.05
    assert abs(prefix_hash.likeness(P(base), P(prefix_hash.edited(base, other))) - 2 / 3) < 0.02


def plain_between(a, b, width=prefix_hash.SPAN):
    """Covered code points by brute force, each span as often as both texts have it."""
    spans = [[t[i:i + width] for i in range(len(t) - width + 1)] for t in (a, b)]
    sides = []
    for own, other in (spans, spans[::-1]):
        left, at = {x: other.count(x) for x in set(own)}, set()
        for i, x in enumerate(own):
            if left[x]:
                left[x] -= 1
                at.update(range(i, i + width))
        sides.append(len(at))
    return min(sides)


def test_every_equal_span_counts():
    """Shared passages between different ends are found whatever their letters, also repeats at several places."""
    P = prefix_hash.Prefix
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(60):
        word = letters(rng.randint(1, 9))
        a, b = (letters(7) + k + word * (900 // len(word)) + k + letters(7) for k in "XY")
        assert prefix_hash.likeness(P(a), P(b)) > 0.95
        a, b = ("".join(rng.choice([word * 20, "passage " * 6, letters(50)]) for _ in range(8)) for _ in range(2))
        assert prefix_hash._between(P(a), P(b), 0, 0) == plain_between(a, b)
    passage = letters(400)
    a, b = (k + passage + letters(30) + k + passage + k for k in "XY")
    assert prefix_hash.likeness(P(a), P(b)) > 0.9


def plain_simhash(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall("[^\x20\x09-\x0D]+", lowered)
    if not own:
        return 0
    shingles = [" ".join(own[i:i + width]) for i in range(max(1, len(own) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash():
    rng = random.Random(9)
    for text in [None, "", " \n", "One", "one TWO", "a b c", "Ä b c d", *[words(rng, n) for n in range(3, 60)]]:
        assert simhash.fingerprint(text) == plain_simhash(text, 3)
        assert simhash.fingerprint(text, 5) == plain_simhash(text, 5)


@pytest.mark.parametrize("same", [True, False])
def test_tile_forest_keeps_components(same):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 6, dtype=np.uint64)
    a = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 8, dtype=np.uint64)) for s in seeds]))
    b = a if same else np.unique(a[::2] ^ np.uint64(5))
    links = simhash._forest(a, b, same, 3)
    values = np.unique(np.concatenate([a, b]))

    def roots(edges):
        parent = {int(v): int(v) for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for x, y in edges:
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        return {v: find(v) for v in parent}

    full = [(int(x), int(y)) for x in a for y in b if int(x ^ y).bit_count() <= 3]
    assert roots(links) == roots(full) and len(links) < len(values)


def test_skipped_tiles_hold_no_link():
    near = set(simhash.neighbour_cells(3)) | {tuple(-x for x in d) for d in simhash.neighbour_cells(3)}
    rng = random.Random(1)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        cell = lambda v: [(v >> 16 * k & 0xFFFF).bit_count() for k in range(4)]
        assert tuple(p - q for p, q in zip(cell(x), cell(y))) in near


def test_token_pieces_equal_whole_texts():
    encoder = bpe.encoding(bpe.RANKS, bpe.public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", " \n", "é", "1", "'s", "#", "\x1f", "　", " x", "<|endoftext|>"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = bpe.token_ids(text, encoder, 5)
        assert ids == encoder.encode_ordinary(text) and encoder.decode_bytes(ids) == text.encode()
    for long in (" " * 2_000_000 + "x", "x" + "\n" * 300_000, "a" * 300_000):
        assert encoder.decode_bytes(bpe.token_ids(long, encoder)) == long.encode()


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 10, 97, 1000])
def test_feistel_radices(rows):
    a, b = feistel.domain(rows)
    assert a * b >= rows and a * b - rows < max(a, 2)


# ---- rules, classifiers, archives ---------------------------------------------------------------

def test_repeated_words():
    rng = random.Random(2)
    for n in [0, 1, 4, 5, 6, 7, 20, 60, 200]:
        own = words(rng, n).encode().split()
        grams = [tuple(own[i:i + 5]) for i in range(n - 4)]
        mask = [False] * n
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                mask[i:i + 5] = [True] * 5
        assert line_rules.repeated_words(own) == sum(mask)


def test_line_measures():
    assert line_rules.measures(None)[1:6] == (0, 0, 0, 0, 0)
    _, n, chars, symbols, dup, _, lines, counts = line_rules.measures("A 1\n\n \nA 1\na 2\n#é|")
    assert (n, chars, symbols, dup) == (7, 9, 2, 1) and len(lines) == 2 and sorted(counts) == [1, 6]


def test_gram_frequencies_and_scores_agree():
    texts = ["", "a", "ab", "the cat and the hat", "é" * 50]
    bodies = [t.encode() for t in texts]
    body, offsets = np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    weights = np.random.default_rng(0).normal(size=(2, hashed.SIZE))
    scores = hashed.linear_scores(body, offsets, weights)
    for i, (slots, values) in enumerate(hashed.frequencies(body, offsets)):
        alone = hashed.linear_scores(np.frombuffer(bodies[i], np.uint8), np.array([0, len(bodies[i])]), weights)
        assert np.allclose(scores[i], weights[:, slots] @ values) and np.allclose(scores[i], alone[0])


def test_families():
    assert lang.family_of("en") == lang.family_of("de") != lang.family_of("fr") and lang.family_of("xx") == "xx"
    empty = lang.Model({"": []}, [], np.zeros((0, hashed.SIZE), np.float32), np.zeros(0))
    assert lang.predict(empty, pa.array(["abc", None]))[0] == ["und", "und"]


def test_estimated_accuracies():
    """Votes drawn from known accuracies give them back, and posteriors sort the classes."""
    rng = np.random.default_rng(1)
    m = len(weak_quality.LABELLERS)
    right = np.linspace(0.7, 0.95, m)
    good = rng.random(20000) < 0.75
    marks = np.where(rng.random((20000, m)) < right, np.where(good[:, None], 1, -1), np.where(good[:, None], -1, 1))
    marks[rng.random(marks.shape) < 0.3] = 0
    patterns = [weak_quality._pattern(v) for v in marks.tolist()]
    values, counts = np.unique(patterns, return_counts=True)
    posterior, accuracy = weak_quality.estimate(dict(zip(values.tolist(), counts.tolist())))
    assert max(abs(accuracy[n][k] - r) for n, r in zip(weak_quality.LABELLERS, right) for k in (0, 1)) < 0.06
    assert np.mean([(posterior[p] > 0.5) == g for p, g in zip(patterns, good)]) > 0.95
    assert weak_quality.estimate({})[0] == {}


@pytest.mark.parametrize("n", [1, 3, 400])
def test_archive_round_trip(n):
    rows = [("response", k, f"http://a.b/{k} x", "d", len(p), p, None) for k in range(n)
            for p in [b"" if k % 7 == 0 else (f"<p>{k}</p>\r\n\r\nWARC/1.1\r\n" * 40).encode()]]
    rows.append(("revisit", None, None, "e", 1234, b"", 5))
    first, frames = warc.archive([warc.record(*r) for r in rows])
    assert (n == 400) == (first[:4] == b"\x5d\x2a\x4d\x18")
    sep = warc.EMPTY_FRAME
    got = list(warc.parsed(warc.unpacked(first + sep + frames + sep)))
    assert [(g[0], g[2], g[3], g[4], g[5]) for g in got] == [(r[1], r[0], r[4], r[3], r[6]) for r in rows]
    assert [g[6] for g in got] == [r[5] for r in rows[:-1]] + [None] and got[0][1] == "http://a.b/0%20x"


def test_weights_are_the_contract():
    assert balance.WEIGHTS == (5, 2, 1) and balance.SHARE == 1.5 and balance.MAX_RATE == 2


@pytest.mark.parametrize("n", [60, 1999, 2000, 5000, 40000])
def test_variety_is_judged_alike_at_every_length(n):
    """Cycled sentences are bad and running text is not, at any length."""
    at = weak_quality.LABELLERS.index("variety")
    cycle = "The old mill stands by the river. People walk there in the morning. Nobody else is to be seen.".split()
    marks, found = weak_quality.votes(" ".join((cycle * (n // len(cycle) + 1))[:n]))
    assert marks[at] == -1 and found[0] == 0 and found[1] > 0.95
    rng = random.Random(n)
    marks, found = weak_quality.votes(" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(n)))
    assert marks[at] == 0 and found[1] < 0.5
    marks, found = weak_quality.votes(" ".join(rng.choice("abcdefgh") for _ in range(n)))
    assert marks[at] == -1
