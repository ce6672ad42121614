"""Whole jobs: what an operator must find beyond what its own definition says."""

import random
import string

from siftwork.llm import html_extract, neardup, secret_scan

_letters = random.Random(40)
VOCABULARY = ["".join(_letters.choices(string.ascii_lowercase, k=_letters.randint(2, 10))) for _ in range(5000)]
FREQUENCY = [1 / (i + 1) for i in range(5000)]


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_planted_near_copies_are_found_by_jaccard(make_docs):
    rng = random.Random(41)
    rows, pairs = [], {}
    for sizes in ((50, 120), (120, 500), (500, 1500), (1500, 5000)):
        for _ in range(60 if sizes[1] < 5000 else 25):
            base = rng.choices(VOCABULARY, FREQUENCY, k=rng.randint(*sizes))
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.01, 0.037)))):
                copy[at] = rng.choices(VOCABULARY, FREQUENCY)[0]
            a, b = " ".join(base), " ".join(copy)
            both = _shingles(a), _shingles(b)
            if a != b and len(both[0] & both[1]) >= 0.8 * len(both[0] | both[1]):
                pairs.setdefault(sizes, []).append((len(rows), len(rows) + 1))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    found = {r.doc_id: r.duplicate_of for r in neardup.near_duplicates(make_docs(rows)).collect()}
    for sizes, planted in pairs.items():
        assert len(planted) > 15 and sum(found.get(b) == a for a, b in planted) >= 0.9 * len(planted), sizes
    assert all(i % 2 and of == i - 1 for i, of in found.items())


def test_secrets_glued_to_names_and_paths_are_found(make_docs):
    rng = random.Random(42)
    model = secret_scan.MarkovRatio.fit(secret_scan.labelled_samples([], seed=2))
    path = "/".join(rng.choices(secret_scan.IDENTIFIERS, k=12))
    rows, want = [], {}
    for kind, glue in enumerate(("database_password=", "aws_secret_access_key=", "SECRET_KEY=", f"{path}=", f"{path}/")):
        for n in (16, 20, 24, 32, 40):
            for _ in range(8):
                key = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
                want.setdefault((kind, n), []).append((len(rows), key))
                rows.append((len(rows), f"set {glue}{key} here"))
    both = "".join(rng.choices(string.ascii_letters + string.digits, k=24))
    rows.append((len(rows), f"{path}={both}/{path}/{both}="))
    docs = make_docs(rows)
    found = {}
    for r in secret_scan.find_secrets(docs, model).collect():
        assert rows[r.doc_id][1][r.start : r.start + r.length] == r.secret
        found[r.doc_id] = found.get(r.doc_id, "") + r.secret
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs, model).collect()}
    for (kind, n), keys in want.items():
        assert sum(key in found.get(i, "") and key not in clean[i] for i, key in keys) >= 7, (kind, n)
    assert found[len(rows) - 1].count(both) == 2 and both not in clean[len(rows) - 1]


def test_names_without_secrets_have_no_stretch():
    rng = random.Random(43)
    invented = ["".join(rng.choice(["ba", "ne", "tor", "shi", "con", "ment", "ing"]) for _ in range(3)) for _ in range(400)]
    model = secret_scan.MarkovRatio.fit(secret_scan.labelled_samples(invented[:200], seed=2))
    held = [t for t, y in secret_scan.labelled_samples(invented[200:], seed=98, n=1500) if not y]
    assert sum(map(bool, model.spans(held))) <= 0.02 * len(held)
    assert model.spans(["-" * 4096, "=" * 70, "2024-01-02", "555-7713-0001", "//////////", "spddhhik", "LEOIKLLC", "Oacficpk"]) == [[]] * 8


def test_pages_without_end_tags_keep_their_text():
    body = "".join(f"<p>Sentence number {i}, which has some length, says: here is the story. It goes on, and on." for i in range(8))
    for start in ("<head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title><link rel=x>", "<head><title>T</title><noscript>no</noscript><div>", "<body><noscript>On<div>", "<body><svg><path d=x>", "<body><template><b>x</b>", "<body><iframe src=x>", "<head><noscript><link rel=x><body>"):
        content, kept, nodes = html_extract.extract(f"<!doctype html><html>{start}{body}</html>")
        assert content.count("Sentence number") == 8 and kept == 8, start
    assert html_extract.text_nodes("<html><head><title>T</title>Words") == [("html", "Words")]
    closed = "<html><head><noscript><style>a</style></noscript></head><body><noscript><p>no</p></noscript><svg><g><svg></svg><text>no</text></g></svg><p>yes"
    assert html_extract.text_nodes(closed) == [("html/body/p", "yes")]
