import random

import pytest
from biblink.llm.licenses import TEMPLATES, fewest_votes, license_report, license_scan, reach, similarity, stretches

from . import brute


def report(df):
    return {r.doc_id: r for r in license_report(license_scan(df)).collect()}


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = report(docs)
    labelled = 0
    for r in docs.collect():
        g = got[r.doc_id]
        assert tuple(g)[1:6] == brute.license_base(r.text)
        assert set(g.base_labels.split(",")) - {""} <= set(g.labels.split(","))
        labelled += g.labels != ""
        assert (g.score > 0) == (g.labels != "")
    assert 0 < labelled < len(got) / 2


def test_notices_are_found_with_small_changes(spark):
    docs = [(i, "x " * (7 * i) + text + " y z" * i) for i, (_, text) in enumerate(TEMPLATES)]
    docs += [(100, TEMPLATES[-2][1].replace("granted", "hereby GRANTED").replace("persons", "").replace("software and", "program and")), (101, "the license of the software is licensed"), (102, None), (103, ""), (104, "released under the licensed " * 2000), (105, "mit license " * 500), (None, "Released under the MIT License."), (106, "Released under the MIT License."), (106, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in docs], "doc_id long, text string, key string, template int")
    rows = license_report(license_scan(df)).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(","), (label, got[i])
    assert "mit-notice" in got[100].labels and got[101].labels == got[102].labels == got[103].labels == ""
    assert got[102].n_words == got[103].n_words == 0 and got[102].first_word is None
    assert got[105].n_base == 500 and got[105].last_word == 998
    assert got[None].labels == got[106].labels == "mit,mit-notice"
    assert license_report(license_scan(df.limit(0))).collect() == []


def test_similarity_finds_the_stretch():
    words = b"a b c under the mit license d".split()
    assert similarity(words, b"under the mit license".split()) == (1.0, 3, 7)
    assert similarity(b"under the new mit license".split(), b"under the mit license".split())[0] == 8 / 9
    assert similarity([], [b"a"])[0] == similarity([b"b"], [b"a"])[0] == 0
    # one word fewer in common is better than eight words more
    words = b"licensed under x x x x x x x x the mit license".split()
    assert similarity(words, b"licensed under the mit license".split()) == (0.75, 10, 13)
    assert similarity(words, b"licensed under the mit license".split(), 0.8) == (0.0, 0, 0)
    rng = random.Random(5)
    for _ in range(300):
        words, template = ([rng.choice("abcde") for _ in range(rng.randrange(1, n))] for n in (14, 7))
        score, s, e = similarity(words, template)
        assert score == pytest.approx(common_words(words, template, 9))
        assert not score or common_words(words[s:e], template, 9) == pytest.approx(score)


def test_pieces_of_a_region_hold_every_stretch():
    words, template = [b"%d" % i for i in range(300)], [b"t"] * 8
    for low, high in ((0, 300), (5, 9), (17, 170), (290, 400)):
        pieces = [(at, at + len(p)) for at, p in stretches(words, low, high, template)]
        assert all(e - s <= 32 for s, e in pieces) and max(e for _, e in pieces) == min(high, 300)
        for s in range(low, min(high, 300) - 11):
            assert any(a <= s and s + 12 <= b for a, b in pieces)


def test_several_notices_in_one_text_and_one_gram_of_a_short_one(spark):
    notice = "Released under the MIT License."
    docs = [(1, f"{notice} a b {notice} c d e f {notice}"), (2, "Licensed under CC 4.0.")]
    rows = {r.doc_id: r for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [s.start for s in rows[1].spans] == [0, 7, 16] and all(s.similarity == 1 for s in rows[1].spans)
    assert [s.label for s in rows[2].spans] == ["cc-by-4.0"]


def common_words(words, template, longest=1.5):
    """Best agreement of any stretch with the template, told plainly."""
    best = 0.0
    for s in range(len(words)):
        if words[s] not in template:
            continue
        row = [0] * (len(template) + 1)
        for e in range(s, min(len(words), s + int(len(template) * longest) + 1)):
            before, row = row, [0]
            for j, t in enumerate(template):
                row.append(before[j] + 1 if words[e] == t else max(before[j + 1], row[j]))
            best = max(best, 2 * row[-1] / (e - s + 1 + len(template)))
    return best


def test_labels_of_the_method_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, checked = {r.doc_id: r for r in license_scan(docs).collect()}, 0
    for r in docs.collect():
        words = brute.WORD.findall(brute.lower(r.text))
        want = {}
        for label, text in TEMPLATES:
            template = brute.WORD.findall(brute.lower(text))
            # a stretch at 0.8 has two thirds of the template's words
            if 3 * sum(w in set(words) for w in template) >= 2 * len(template):
                checked += 1
                if (score := common_words(words, template)) >= 0.8:
                    want[label] = max(score, want.get(label, 0.0))
        # of overlapping spans the most similar stays: the best one always does
        found = {s.label: s.similarity for s in got[r.doc_id].spans}
        assert set(found) <= set(want) and bool(found) == bool(want), r.doc_id
        assert max(found.values(), default=0) == pytest.approx(max(want.values(), default=0)), r.doc_id
    assert checked


def edited(words, rng):
    """Words dropped, put in or replaced, evenly spread."""
    kind, step, start = rng.choice("drop put replace".split()), rng.choice([2, 3, 4, 5, 7]), rng.randrange(3)
    out = []
    for i, w in enumerate(words):
        hit = i % step == start % step
        if kind == "put" or not hit:
            out.append(w)
        if hit and kind != "drop":
            out += ["other"] * rng.choice([1, 1, 1, 8])
    return out


def test_no_similar_notice_goes_unverified(spark):
    rng = random.Random(7)
    texts = []
    for label, text in TEMPLATES:
        plain = brute.WORD.findall(brute.lower(text))
        texts += [" ".join(["before"] * rng.randrange(4) + edited(plain, rng) + ["after"]) for _ in range(40)]
        # a holder's name of several words in the middle
        texts += [" ".join(plain[: len(plain) // 2] + ["name"] * n + plain[len(plain) // 2 :]) for n in (2, 8, 10)]
        # each third word is missing; each second is followed by another
        texts += [" ".join(w for i, w in enumerate(plain) if i % 3 != 1), " ".join(w + " x" * (i % 2) for i, w in enumerate(plain))]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, text in enumerate(texts):
        words = brute.WORD.findall(text)
        best = max(common_words(words, brute.WORD.findall(brute.lower(t))) for _, t in TEMPLATES)
        best = best if best >= 0.8 - 1e-12 else 0.0
        assert max((s.similarity for s in got[i].spans), default=0) == pytest.approx(best), text
        found += best > 0
    assert 100 < found < len(texts)


def test_votes_and_reach_hold_for_every_alignment():
    rng = random.Random(3)
    for _ in range(3000):
        length = rng.randrange(4, 40)
        # a stretch of common words (None where the template's word is missing) and words of its own
        path, own, lost = [], 0, 0
        for j in range(length):
            lost += (missing := rng.random() < 0.2)
            path.append(None if missing else j + own)
            own += rng.random() < 0.3 and j < length - 1
        common = length - lost
        if 2 * common / (length + common + own) < 0.8:
            continue
        votes = [i - j for j, i in enumerate(path) if i is not None and j + 1 < length and path[j + 1] == i + 1]
        assert len(votes) >= fewest_votes(length)
        assert max(votes) - min(votes) <= reach(length)
