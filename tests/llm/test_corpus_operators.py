"""Operators against brute force, exact round trips and held-out accuracy."""

import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwork.llm import fingerprint, html_extract, language, mixing, neardup, packing, secret_scan, sharding, substring, topk

WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=2 + i % 7)) for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def test_mixing_reaches_target_weights(make_docs):
    rng = random.Random(1)
    docs = make_docs([(i, _text(rng, 40), "en", "a" if i % 4 else "b") for i in range(4000)])
    got = Counter()
    for r in mixing.mix_sources(docs, {"a": 1.0, "b": 3.0}, budget=2.0).collect():
        got[r.source] += len(r.text)
    total = sum(r.n_chars for r in docs.collect())
    assert got["b"] / sum(got.values()) == pytest.approx(0.75, abs=0.02)
    assert sum(got.values()) == pytest.approx(2 * total, rel=0.05)


def test_mixing_draws_the_same_again(make_docs):
    docs = make_docs([(i, "x" * 10) for i in range(200)])
    a, b = (sorted((r.doc_id, r.copy) for r in mixing.mix_sources(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_page_extraction_keeps_the_article():
    body = "".join(f"<p>Sentence number {i}, which has some length, says: here is the story. It goes on, and on.</p>" for i in range(8))
    menu = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(20))
    page = f"<html><head><title>T</title><style>p {{}}</style></head><body><nav><ul>{menu}</ul></nav><article>{body}</article><footer><span>Imprint</span></footer><script>var x = '<p>no</p>';</script></body></html>"
    content, kept, nodes = html_extract.extract(page)
    assert content.count("Sentence number") == 8 and "Link" not in content and "Imprint" not in content and "var x" not in content
    assert kept == 8 and nodes == 29


def test_packing_loses_nothing_and_fits(make_docs):
    rng = random.Random(2)
    rows = [(i, _text(rng, rng.choice([1, 3, 10, 40, 90, 130, 500]))) for i in range(600)] + [(7, "again words"), (None, "no id here"), (600, None), (601, "")]
    docs = make_docs(rows)
    out = packing.pack_documents(docs, capacity=128, groups=8).collect()
    load = Counter()
    for r in out:
        load[r.bin_id] += r.n_words
    assert max(load.values()) <= 128
    want = sum(len(t.split()) for _, t in rows if t)
    assert sum(load.values()) == want
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.start_word, r.n_words))
    for doc, text in rows[8:600]:
        at = 0
        for start, n in sorted(pieces[doc]):
            assert start == at
            at += n
        assert at == len(text.split())
    assert len(load) <= 1.12 * want / 128 + 8


def test_configurations_cover_the_demand():
    rng = random.Random(3)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(20, 100), 6), reverse=True))
        demand = np.array([rng.randint(1, 500) for _ in sizes])
        plan = packing.configurations(100, sizes, demand)
        assert all((c * sizes).sum() <= 100 for _, c in plan)
        assert (sum(n * c for n, c in plan) >= demand).all()
        assert sum(n for n, _ in plan) <= 1.25 * (demand * sizes).sum() / 100 + demand.max() + 6 if sizes.min() > 50 else True


def test_fingerprints_fold_text(make_docs):
    docs = make_docs([(3, "Straße  X"), (1, "STRASSE x"), (2, "ﬁne"), (4, "Fine"), (5, "café"), (6, "CAFÉ "), (7, None), (8, None), (9, "")])
    got = {r.doc_id: (r.first_doc_id, r.copies) for r in fingerprint.fingerprints(docs).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 4: (2, 2), 5: (5, 2), 6: (5, 2), 7: (7, 1), 8: (8, 1), 9: (9, 1)}


def test_language_accuracy_on_held_out_documents(spark, documents):
    labelled = [(r.doc_id, r.lang, r.text) for r in documents.filter("lang IS NOT NULL AND length(text) > 100").collect()]
    train = [(lang, t) for i, lang, t in labelled if i % 2]
    test = [(lang, t) for i, lang, t in labelled if i % 2 == 0]
    model = language.TextModel.fit(train)
    sums, _ = model.score([t for _, t in test])
    right = sum(model.languages[j] == lang for j, (lang, _) in zip(sums.argmax(axis=1), test, strict=True))
    assert right / len(test) > 0.9


def test_language_evidence_moves_short_texts_only(make_docs):
    de, en = "der hund und die katze sind im haus und der garten ist groß ", "the dog and the cat are in the house and the garden is large "
    model = language.TextModel.fit([("de", de * 5), ("en", en * 5)])
    rows = [(i, de * 3, "de", "a.de") for i in range(40)] + [(100 + i, en * 3, "en", "b.com") for i in range(40)] + [(900, "hund in", "de", "a.de"), (901, de * 4, "en", "b.com"), (902, "12345 %%", "de", "a.de"), (903, None, "de", "a.de")]
    got = {r.doc_id: (r.language, r.accepted) for r in language.identify_documents(make_docs(rows), model).collect()}
    assert got[0] == ("de", True) and got[100] == ("en", True) and got[900][0] == "de" and got[901][0] == "de"
    assert got[902] == (None, False) and got[903] == (None, False)


def _brute_passages(rows, window):
    """Every window by its words."""
    seen = defaultdict(list)
    for doc, text in rows:
        if doc is None or text is None:
            continue
        w = text.lower().split()
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])].append((doc, i))
    marks = {}
    for places in seen.values():
        if len(places) > 1:
            first = min(places)
            for p in places:
                c, f, late = marks.get(p, (0, p[0], False))
                marks[p] = (max(c, len(places)), min(f, first[0]), late or p != first)
    out = []
    for doc, at in sorted(marks):
        c, f, late = marks[doc, at]
        if out and out[-1][0] == doc and out[-1][2] == at - 1:
            out[-1] = (doc, out[-1][1], at, max(out[-1][3], c), min(out[-1][4], f), out[-1][5] or late)
        else:
            out.append((doc, at, at, c, f, late))
    return [(d, a, b - a + window, c, f, late) for d, a, b, c, f, late in out]


@pytest.mark.parametrize("bits", [28, 6])
def test_passages_equal_brute_force(make_docs, bits):
    rng = random.Random(4)
    shared = [_text(rng, 60), _text(rng, 80)]
    rows = [(i, " ".join([_text(rng, rng.randint(0, 90)), rng.choice([*shared, "", ""]), _text(rng, rng.randint(0, 90))])) for i in range(120)]
    rows += [(200, shared[0] + " " + shared[0]), (201, shared[1].upper()), (202, "same " * 150), (203, None), (None, shared[0]), (5, shared[1]), (5, shared[1])]
    got = sorted(tuple(r) for r in substring.repeated_passages(make_docs(rows), window=20, anchor=8, most_bits=bits).select("doc_id", "start_word", "n_words", "copies", "first_doc_id", "removable").collect())
    assert got == sorted(_brute_passages(rows, 20))


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[250:] = x[:50]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, topk.DIGITS)
    np.fill_diagonal(s, -np.inf)
    want = {(i, p + 1, int(j)) for i in range(300) for p, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:5])}
    got = topk.top_neighbours(vectors, k=5, tile=37).collect()
    assert {(r.vec_id, r.place, r.neighbour_id) for r in got} == want and len(got) == 1500


def test_sharding_cuts_less_and_stays_even(make_docs):
    rng = random.Random(6)
    lines = [[_text(rng, 6) for _ in range(4)] for _ in range(40)]
    docs = make_docs([(i, "\n".join([_text(rng, 8), *rng.sample(lines[i // 20], 3)])) for i in range(800)])
    out = sharding.shard_documents(docs, shards=8)
    sizes = Counter(r.shard for r in out.collect())
    assert sum(sizes.values()) == 800 and max(sizes.values()) <= 111
    before, after = sharding.cut_weight(docs, out, "first_shard"), sharding.cut_weight(docs, out)
    assert after < 0.8 * before


def test_secret_model_on_held_out_samples():
    rng = random.Random(7)
    model = secret_scan.MarkovRatio.fit(secret_scan.labelled_samples(WORDS, seed=1))
    held = secret_scan.labelled_samples(["".join(rng.choice(["ba", "ne", "tor", "shi", "con", "ment", "ing"]) for _ in range(3)) for _ in range(200)], seed=99, n=1500)
    held = [(t, y) for t, y in held if len(t) >= secret_scan.LEAST]
    _, said = model.secret([t for t, _ in held])
    truth = np.array([y for _, y in held], bool)
    assert said[truth].mean() > 0.9 and said[~truth].mean() < 0.05


def test_secrets_are_found_and_redacted(make_docs):
    rng = random.Random(8)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    docs = make_docs([(1, f"the key is {key} and that is that"), (2, "nothing_to_see_in_this_identifier here"), (3, "1234567890123456"), (4, None)])
    model = secret_scan.MarkovRatio.fit(secret_scan.labelled_samples(WORDS))
    found = secret_scan.find_secrets(docs, model).collect()
    assert [(r.doc_id, r.start, r.length, r.secret) for r in found] == [(1, 11, 40, key)]
    out = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact_secrets(docs, model).collect()}
    assert out[1] == ("the key is [SECRET] and that is that", 36) and out[2][0].startswith("nothing") and out[4] == (None, None)


def test_masks_cover_the_radius():
    """Any two hashes within the radius agree under some mask."""
    rng = random.Random(9)
    cover = neardup.masks().tolist()
    for _ in range(500):
        flipped = sum(1 << b for b in rng.sample(range(64), neardup.RADIUS))
        assert any(flipped & m == 0 for m in cover)


def _components(one, two, radius, confirm):
    up = list(range(len(one)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(one)):
        near = (np.bitwise_count(one[i + 1 :] ^ one[i]) <= radius) & (np.bitwise_count(two[i + 1 :] ^ two[i]) <= confirm)
        for j in np.flatnonzero(near):
            a, b = find(i), find(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(one))]


def test_near_duplicates_equal_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    one, two, some = neardup.hashes([r.text for r in rows])
    ids = [r.doc_id for r, s in zip(rows, some, strict=True) if s]
    groups = defaultdict(list)
    for i, g in zip(ids, _components(one[some], two[some], neardup.RADIUS, neardup.CONFIRM), strict=True):
        groups[g].append(i)
    want = {(i, min(g), len(g)) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in neardup.near_duplicates(documents).collect()} == want


def test_families_of_near_copies_become_one(make_docs):
    rng = random.Random(10)
    base = _text(rng, 300).split()
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(300)] = rng.choice(WORDS)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, _text(rng, 200)) for i in range(100)]
    kept = {r.doc_id for r in neardup.drop_near_duplicates(make_docs(rows)).collect()}
    assert len({i for i in kept if i < 1000}) <= 6 and len({i for i in kept if i >= 1000}) == 100


def test_simhash_equals_the_plain_form():
    rng = random.Random(11)
    texts = [_text(rng, n) for n in (1, 5, 300, 3000)] + ["a " * 2000 + "b", "", None]
    one, _, some = neardup.hashes(texts)
    from siftwork.llm.wordhash import groups, mix

    for (indices, words, begins), _ in zip(groups(texts), range(1), strict=False):
        for i, a, b in zip(indices, begins[:-1], begins[1:], strict=True):
            votes = np.zeros(64)
            for w, c in Counter((words[a:b] >> np.uint64(24)).tolist()).items():
                h = int(mix(np.array([w], np.uint64))[0])
                votes += (2 + min(38, round(2 * np.log(c)))) * np.array([1 if h >> j & 1 else -1 for j in range(64)])
            assert int(one[i]) == sum(1 << j for j in range(64) if votes[j] > 0)
    assert some.tolist() == [True] * 5 + [False] * 2
