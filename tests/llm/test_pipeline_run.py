"""A whole run of the pipeline, row by row, against plain Python for every stage but the draw of the mixture."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from lureline.llm import balance, bpe, near, weak_quality
from lureline.shared import new_path

SF = "/root/testdata/sf0.001"


def planted(texts):
    """Pairs just above and below 0.8, passages of over 100 bytes that repeat, copies, null and empty texts."""
    rng = random.Random(11)
    long = sorted((t for t in texts if len(t.split()) > 80), key=len)[:12]
    rows = []
    for k, text in enumerate(long):
        words = text.split()
        other = long[k - 1].split()
        keep = int(len(words) * (0.95 if k % 2 else 0.7))
        rows.append(" ".join(words[:keep] + other[:len(words) - keep]))
        rows.append(" ".join(other[:20] + words[10:70] + other[30:50]))
    return rows + [None, "", " \n", long[0], long[0], rng.choice(long).upper()]


def kept_bytes(rows):
    """Bytes of (doc_id, text) without what a 100-byte string covers that starts earlier too."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for start in range(len(body) - 99):
            piece = body[start:start + 100]
            if piece in seen:
                gone[start:start + 100] = b"\x01" * 100
            seen.add(piece)
        if any(gone):
            text = bytes(b for b, g in zip(body, gone) if not g).decode("utf-8", "ignore")
            if not text.split():
                continue
        out[i] = text
    return out


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [tuple(r) for r in docs.select(*docs.columns).collect()]
    names = docs.columns
    extra = [dict(doc_id=10_000 + k, text=t, lang="en", source=f"s{k % 3}" if k % 5 else None, n_chars=len(t or ""))
             for k, t in enumerate(planted([r[names.index("text")] for r in base]))]
    rows = [dict(zip(names, r)) for r in base] + extra
    table = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], docs.schema)
    folder = new_path(spark, "run")
    table.write.parquet(f"{folder}/documents.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, folder).collect()))

    written = spark.read.parquet(f"{folder}/documents.parquet")
    accepted = {r.doc_id for r in weak_quality.judged(written, weak_quality.fit(written)).where("kept").collect()}
    left = {r["doc_id"]: r for r in rows if r["doc_id"] in accepted}
    assert 0.5 * len(rows) < len(left) < len(rows)
    sets = {i: set(near.shingle_set(r["text"]).tolist()) for i, r in left.items()}
    root = {i: i for i in left}
    for a in left:
        for b in left:
            common = len(sets[a] & sets[b])
            if a < b and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    heads = [(i, left[i]["text"]) for i in left if root[i] == i]
    assert len(heads) < len(left)
    short = kept_bytes(heads)
    assert any(short[i] != t for i, t in heads if i in short)
    after = [{**left[i], "text": t, "n_chars": left[i]["n_chars"] if t is None else len(t)} for i, t in short.items()]
    mixed = balance.mix(spark.createDataFrame([tuple(r[c] for c in names) for r in after], docs.schema)).select("doc_id", "text").collect()
    encoder = bpe.encoding(bpe.RANKS, bpe.public_tokenizers.PATTERN)
    expected = Counter()
    for r in mixed:
        ids = encoder.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert got == expected and len(got) > 100
