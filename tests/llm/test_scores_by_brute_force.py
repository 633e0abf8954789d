"""The queries that SQL can't tell, with fixed small models, against plain restatements."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from biblink.llm import langid, quality, toxicity
from biblink.llm.mixing import mix

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity_scores(spark, docs):
    rows = docs.collect()
    words = sorted({w for r in rows[:40] for w in brute.WORD.findall(brute.lower(r.text))})
    named = [w.encode() for w in words] + [b"^" + w.encode()[:4] for w in words if len(w.encode()) >= 4]
    weights = {xxhash.xxh3_64_intdigest(f): ((i * 37) % 101 - 50) / 400 for i, f in enumerate(sorted(set(named)))}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, None, model=toxicity.Model(weights, -0.25)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        distinct = {w.encode() for w in brute.WORD.findall(brute.lower(r.text))}
        known = distinct | {b"^" + w[:n] for w in distinct for n in (4, 5, 6) if len(w) >= n}
        logit = -0.25 + sum(weights.get(xxhash.xxh3_64_intdigest(f), 0.0) for f in known)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def strength(groups):
    """Of ``(n, good, parent's rate)``."""
    spread = sum(n * (g / n - r) ** 2 for n, g, r in groups)
    sampling, binomial = sum(r * (1 - r) for _, _, r in groups), sum(n * r * (1 - r) for n, _, r in groups)
    between = max(0.0, spread - sampling) / binomial
    return min(10_000.0, max(2.0, 1 / max(between, 1e-12) - 1))


def test_quality_scores(spark, docs):
    rows = docs.collect()
    width = len(quality.shape(b""))
    edges = np.sort(np.array([[quality.shape((r.text or "").encode())[j] for r in rows[1 : quality.BINS]] for j in range(width)]), 1)
    weights = np.array([[((j * 7 + b * 5) % 11 - 5) / 8 for b in range(quality.BINS)] for j in range(width)])
    got = {r.doc_id: r for r in quality.quality(docs, None, model=quality.Model(edges, weights, 0.3, 0.1)).collect()}
    evidence = {}
    for r in rows:
        s = quality.shape((r.text or "").encode())
        logit = 0.3 + sum(weights[j][sum(e <= s[j] for e in edges[j])] for j in range(width))
        evidence[r.doc_id] = min(20.0, max(-20.0, logit - 0.1))
    sites = defaultdict(lambda: [0, 0.0])
    for r in rows:
        site = sites[r.source, r.lang]
        site[0] += 1
        site[1] += 1 / (1 + math.exp(-(evidence[r.doc_id] + 0.1)))
    hosts = defaultdict(lambda: [0, 0.0])
    for (host, _), (n, good) in sites.items():
        hosts[host][0] += n
        hosts[host][1] += good
    rate = sum(g for _, g in hosts.values()) / len(rows)
    k = strength([(n, g, rate) for n, g in hosts.values()])
    host_rate = {h: (g + k * rate) / (n + k) for h, (n, g) in hosts.items()}
    k = strength([(n, g, host_rate[h]) for (h, _), (n, g) in sites.items()])
    for r in rows:
        n, good = sites[r.source, r.lang]
        p = (good + k * host_rate[r.source]) / (n + k)
        score = 1 / (1 + math.exp(-(evidence[r.doc_id] + math.log(p / (1 - p)))))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].keep == (got[r.doc_id].score >= 0.5)


def test_language_scores(spark, docs):
    some = docs.orderBy("doc_id").limit(12)
    net = langid.Network.initial(3, np.random.default_rng(3))
    got = {r.doc_id: r for r in langid.language_id(some, model=(["aa", "bb", "cc"], net)).collect()}
    for r in some.collect():
        text = (r.text or "").encode()
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang_pred == "und"
            continue
        sums, pieces = np.zeros(3), range(0, len(text), 256)
        for at in pieces:
            piece = text[at : at + 256].ljust(256, b"\0")
            pooled = [max(sum(float(f[j, piece[i + j], c]) for j in range(len(f))) for i in range(256 - len(f) + 1)) for f in net.filters for c in range(langid.FILTERS)]
            z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out.astype(float) + net.out_bias
            sums += z - z.max() - math.log(np.exp(z - z.max()).sum())
        mean = sums / len(pieces)
        p = np.exp(mean - mean.max())
        p /= p.sum()
        assert got[r.doc_id].lang_pred == ["aa", "bb", "cc"][int(p.argmax())] and got[r.doc_id].score == pytest.approx(p.max(), abs=1e-4)


def weights_of(tokens, share=0.9, epochs=4.0):
    """By a fine search over exponents in place of a bisection."""
    whole = sum(tokens.values())

    def at(a):
        powers = {s: (t / whole) ** a for s, t in tokens.items()}
        return {s: p / sum(powers.values()) for s, p in powers.items()}

    grid = [i / 200_000 for i in range(200_001)]
    a = max((x for x in grid if -sum(w * math.log(w) for w in at(x).values()) >= share * math.log(len(tokens)) - 1e-12), default=0.0)
    often = lambda x: max(w * whole / tokens[s] for s, w in at(x).items())
    if often(a) > epochs:
        a = min(x for x in grid if often(x) <= epochs)
    return at(a)


def test_mixture(spark, docs):
    one = docs.orderBy("doc_id").coalesce(1)
    got = mix(one, block_rows=50).collect()
    read = [(row, r.doc_id, r.source, len(brute.BLANK_WORD.findall(r.text or ""))) for row, r in enumerate(one.collect())]
    tokens, n_rows = defaultdict(int), defaultdict(int)
    for _, _, source, n in read:
        tokens[source] += n
        n_rows[source] += n > 0
    want = weights_of(tokens)
    weight = {r.source: r.weight for r in got}
    assert all(weight[s] == pytest.approx(want[s], abs=1e-4) for s in weight)
    md5 = lambda *x: hashlib.md5("|".join(str(v) for v in x if v is not None).encode()).hexdigest()
    blocks = defaultdict(list)
    for row, doc_id, source, n in read:
        if n:
            h = md5("mix", doc_id, row)
            blocks[source, int(h[:8], 16) % -(-n_rows[source] // 50)].append((row, doc_id, n, h))
    out = []
    for (source, block), members in blocks.items():
        passes = weight[source] * sum(tokens.values()) / tokens[source]
        full, total, before = math.floor(passes), sum(n for _, _, n, _ in members), 0
        dealt = defaultdict(list)
        for row, doc_id, n, h in sorted(members, key=lambda m: (md5(m[3], full), m[0])):
            last = before + n / 2 <= (passes - full) * total
            before += n
            for epoch in range(full + last):
                dealt[epoch].append((md5(h, epoch), row, doc_id, n))
        for epoch, rows in dealt.items():
            out += [(doc_id, source, n, epoch, block, place) for place, (_, _, doc_id, n) in enumerate(sorted(rows), 1)]
    assert sorted(out) == sorted((r.doc_id, r.source, r.n_tokens, r.epoch, r.block, r.position) for r in got)
