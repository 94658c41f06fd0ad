"""The stages in a row, each against what it promises."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from footfall.llm._common import written
from footfall.llm.suffix_dedup import STAGE_LENGTH
from tests.llm.fixtures import clashing, documents
from tests.llm.test_operators import WORD, brute_groups, brute_quality, library


def brute_left(texts, length):
    """Each text without the characters all of whose bytes are in a string of ``length`` bytes that starts elsewhere too."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for text, d in zip(texts, data, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept, at = [], 0
        for c in text or "":
            size = len(c.encode())
            if not gone[at : at + size].all():
                kept.append(c)
            at += size
        out.append("".join(kept))
    return out


def brute_mix(data):
    """How often each (doc_id, text) is there after mixing (doc_id, source, text)."""
    sizes = defaultdict(int)
    for _, source, text in data:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    out = Counter()
    for doc, source, text in data:
        target = 3 * sizes[source] if source in capped else level * weight[source]
        rate = target / sizes[source] if sizes[source] else 0
        draw = int(hashlib.md5(f"mix-1:{'null' if doc is None else doc}".encode()).hexdigest()[:12], 16) / 2**48
        out[doc, text] += int(rate) + (draw < rate - int(rate))
    return +out


def test_stages(spark, sf):
    docs = clashing(documents(spark))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, sf), name)
        after = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before if not brute_quality(r["text"])[-1]}
        if name == "minhash_near_dedup":
            want = [g[0] for g in brute_groups([tuple(r) for r in before], 5) if g[3]]
            assert sorted(r["doc_id"] or -1 for r in after) == sorted(x or -1 for x in want)
        if name == "suffix_array_dedup":
            assert all(r["n_chars"] in (None, len(r["text"])) for r in after)
            left = brute_left([r["text"] for r in before], STAGE_LENGTH)
            want = Counter((r["doc_id"], t) for r, t in zip(before, left, strict=True) if t == r["text"] or WORD.search(t))
            assert Counter((r["doc_id"], r["text"]) for r in after) == want != Counter((r["doc_id"], r["text"]) for r in before)
        if name == "source_mixing":
            want = brute_mix([(r["doc_id"], r["source"], r["text"]) for r in before])
            assert Counter((r["doc_id"], r["text"]) for r in after) == want
        if name == "sentencepiece":
            sp = library()
            text_of = {(r["doc_id"], r["text"]) for r in before}
            assert {(r["doc_id"], tuple(r["ids"])) for r in after} == {(i, tuple(sp.encode(t))) for i, t in text_of}
            assert len(after) == len(before)


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.filter("NOT round_trip").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5


def test_empty(spark, sf):
    docs = documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
    assert docs.count() == 0
