"""Operators that SQL can't express against plain re-computations on small tables."""

import hashlib
import itertools
import math
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from siftwork.llm import fingerprint, html_extract, language, mixing, neardup, packing, secret_scan, sharding, substring

WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=2 + i % 7)) for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


# HTML extraction.


def _plain_extract(page, radius, threshold):
    nodes = html_extract.text_nodes(page)
    if not nodes:
        return "", 0, 0
    of = defaultdict(list)
    for path, said in nodes:
        of[path].append((len(said), len(html_extract.MARKS.findall(said))))
    raw = [[sum(x[j] for x in of[p]) / len(of[p]) for p, _ in nodes] for j in (0, 1)]
    weigh = {d: math.exp(-0.5 * (d / max(radius / 2, 0.5)) ** 2) for d in range(-radius, radius + 1)}
    smooth = [[sum(weigh[d] * x[i + d] for d in weigh if 0 <= i + d < len(x)) / sum(weigh[d] for d in weigh if 0 <= i + d < len(x)) for i in range(len(x))] for x in raw]
    size = [len(t) for _, t in nodes]
    mean = lambda x: sum(a * b for a, b in zip(x, size, strict=True)) / sum(size)
    marks = [x + 0.1 for x in smooth[1]]
    score = [math.sqrt(a / mean(smooth[0]) * b / mean(marks)) for a, b in zip(smooth[0], marks, strict=True)]
    paths = defaultdict(list)
    for (p, _), s in zip(nodes, score, strict=True):
        paths[p].append(s)
    bound = threshold * mean(score)
    kept = [t for p, t in nodes if sum(paths[p]) / len(paths[p]) >= bound - 1e-12]
    return "\n".join(kept), len(kept), len(nodes)


def test_extraction_equals_the_plain_form(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    rng = random.Random(50)
    for _ in range(60):
        pages.append("".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<li>", "<table><tr><td>", "</table>", _text(rng, rng.randint(1, 30)) + rng.choice([". ", ", ", " ", "!"])]) for _ in range(rng.randint(5, 120))))
    for radius, threshold in ((1, 0.5), (2, 0.8)):
        for page in pages:
            assert html_extract.extract(page, radius, threshold) == _plain_extract(page, radius, threshold)


def test_deep_pages_take_time_in_proportion():
    import time

    began = time.time()
    for page in ("<b>x" * 250_000, "<svg>x" * 170_000, "<b>" * 100_000 + "<p>y</p>" * 100_000, "<head><div>x" * 80_000, "<p><td>x" * 120_000):
        html_extract.extract(page)
    assert time.time() - began < 60


# Packing.


def _fewest(capacity, pieces):
    """Bins by exhaustive search."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] >= pieces[i]:
                go(i + 1, [*bins[:j], bins[j] - pieces[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - pieces[i]])

    go(0, [])
    return best[0]


def test_configurations_against_the_optimum():
    """Rounding a basic solution up costs less than a bin a size, whatever the sizes."""
    rng = random.Random(51)
    for _ in range(40):
        sizes = np.array(sorted(rng.sample(range(13, 100), 3), reverse=True))
        demand = np.array([rng.randint(1, 3) for _ in sizes])
        plan = packing.configurations(100, sizes, demand)
        assert all((c * sizes).sum() <= 100 for _, c in plan) and (sum(n * c for n, c in plan) >= demand).all()
        best = _fewest(100, [s for s, d in zip(sizes.tolist(), demand.tolist(), strict=True) for _ in range(d)])
        assert best <= sum(n for n, _ in plan) <= best + len(sizes)


def test_packing_against_the_optimum_and_the_bound(make_docs):
    rng = random.Random(52)
    lengths = [rng.randint(2, 30) for _ in range(11)]
    out = packing.pack_documents(make_docs([(i, _text(rng, n)) for i, n in enumerate(lengths)]), capacity=32, groups=12).collect()
    assert _fewest(32, lengths) <= len({r.bin_id for r in out}) <= _fewest(32, lengths) + 3
    lengths = [rng.choice([3, 9, 17, 30, 45, 64, 80, 100, 128, 200]) for _ in range(3000)]
    out = packing.pack_documents(make_docs([(i, _text(rng, n)) for i, n in enumerate(lengths)]), capacity=128, groups=24).collect()
    pieces = [x for n in lengths for x in [128] * (n // 128) + [n % 128] * (n % 128 > 0)]
    least = max(sum(pieces) / 128, sum(2 * x > 128 for x in pieces) + sum(2 * x == 128 for x in pieces) / 2)  # no two above half share a bin
    assert least <= len({r.bin_id for r in out}) <= 1.03 * least + 24


# Language.


def _softmax(x):
    top = max(x)
    e = [math.exp(v - top) for v in x]
    return [v / sum(e) for v in e]


def _plain_identify(rows, model):
    """(declared, host, body) -> (language, probability, accepted), level by level."""
    k = len(model.languages)
    told = []
    for declared, host, body in rows:
        sums, n = model.score([body])
        n = int(n[0])
        ll = [float(x) * min(1.0, language.EFFECTIVE / n) if n else 0.0 for x in sums[0]]
        parts = host.split(".") if host is not None else []
        suffix = parts[-1] if len(parts) > 1 else None
        domain = ".".join(parts[-2:]) if len(parts) > 1 else host
        told.append((declared, host, domain, suffix, ll, _softmax(ll) if n else [0.0] * k, n, max(sums[0]) / n if n else -math.inf))

    def sums_by(key):
        out = defaultdict(lambda: [0.0] * k)
        for t in told:
            out[key(t)] = [a + b for a, b in zip(out[key(t)], t[5], strict=True)]
        return out

    def smooth(c, above):
        return [(x + language.TRUST * p) / (sum(c) + language.TRUST) for x, p in zip(c, above, strict=True)]

    everything = sums_by(lambda t: 0)[0]
    root = [(x + 1) / (sum(everything) + k) for x in everything]
    suffixes, domains, hosts = sums_by(lambda t: t[3]), sums_by(lambda t: (t[2], t[3])), sums_by(lambda t: t[1])
    declared, by_suffix = sums_by(lambda t: t[0]), sums_by(lambda t: t[3])

    def told_by(table, value):
        if value is None:
            return [0.0] * k
        known = [v for x, v in table.items() if x is not None]
        return [math.log((table[value][j] + 0.5) / (sum(v[j] for v in known) + 0.5 * len(known))) for j in range(k)]

    out = []
    for d, host, domain, suffix, ll, _, n, level in told:
        of_suffix = smooth(suffixes[suffix], root) if suffix is not None else root
        of_domain = smooth(domains[domain, suffix], of_suffix) if domain is not None else root
        prior = smooth(hosts[host], of_domain) if host is not None else root
        post = _softmax([a + b + c + math.log(p) for a, b, c, p in zip(ll, told_by(declared, d), told_by(by_suffix, suffix), prior, strict=True)])
        best = max(post)
        out.append((model.languages[post.index(best)] if n else None, round(best, 6) if n else None, bool(n and level >= language.FLOOR and best >= language.SURE)))
    return out


def test_evidence_is_fused_as_in_the_plain_form(spark):
    rng = random.Random(53)
    said = {"de": "der hund und die katze sind im haus und der garten ist gross heute nicht", "en": "the dog and the cat are in the house and the garden is large today not", "fr": "le chien et le chat sont dans la maison et le jardin est grand mais pas"}
    model = language.TextModel.fit([(lang, t * 4) for lang, t in said.items()])
    hosts = [None, "plain", "a.de", "b.de", "www.a.de", "x.com", "y.co.fr", "z.fr", "a.com"]
    rows = []
    for _ in range(300):
        lang = rng.choice(list(said))
        body = rng.choice([None, "", "12 34", " ".join(rng.choices(said[lang].split(), k=rng.choice([1, 2, 3, 8, 40]))), "zzqx wwvk qqjz"])
        rows.append((rng.choice([None, lang, lang, "de", "xx"]), rng.choice(hosts), body))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, declared string, host string, body string")
    got = {r.i: (r.language, r.probability, r.accepted) for r in language.identify(df, model).collect()}
    for i, (lang, p, accepted) in enumerate(_plain_identify(rows, model)):
        assert got[i][0] == lang and got[i][2] == accepted and (p is None and got[i][1] is None or abs(got[i][1] - p) < 2e-6), (rows[i], got[i], lang, p)


def test_long_texts_score_the_same_in_steps():
    rng = random.Random(54)
    model = language.TextModel.fit([("de", "der hund über straße İstanbul"), ("en", "the dog 𝐚b")])
    text = "".join(rng.choice(["über ", "the ", "𝐚b", " 12, ", "İx ", "dog"]) for _ in range(3000))
    whole = model.score([text, "", None, "hund"])
    step = language._parts.__defaults__
    try:
        language._parts.__defaults__ = (97,)
        cut = model.score([text, "", None, "hund"])
    finally:
        language._parts.__defaults__ = step
    assert np.allclose(whole[0], cut[0]) and whole[1].tolist() == cut[1].tolist()


def test_memory_of_a_very_long_text():
    import subprocess
    import sys

    code = """
import resource
from siftwork.llm import fingerprint, language, neardup, secret_scan, substring
text = " ".join(f"w{i * 7919 % 500009}" for i in range(4_000_000))
model = language.TextModel.fit([("de", "der hund"), ("en", "the dog")])
list(neardup.hashes(["a b"]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.score([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
neardup.hashes([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    scored, hashed = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert scored < 60 and hashed < 300


# Sharding.


def _plain_shards(rows, shards, rounds, slack):
    lines = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(line) >= sharding.LEAST_LINE:
                lines[line].add(doc)
    lines = {x: d for x, d in lines.items() if len(d) > 1}
    ids = sorted({d for d, _ in rows if d is not None})
    at = {d: i % shards for i, d in enumerate(ids)}
    first, of = dict(at), defaultdict(list)
    for x, docs in lines.items():
        for d in docs:
            of[d].append(x)
    most, least = math.ceil((1 + slack) * len(ids) / shards), math.floor((1 - slack) * len(ids) / shards)
    size, before = Counter(at.values()), len(of)
    for turn in range(rounds):
        here = {x: Counter(at[d] for d in docs) for x, docs in lines.items()}
        wishes = defaultdict(list)
        for d in of:
            score = Counter()
            for x in of[d]:
                for s, n in here[x].items():
                    score[s] += (n - (s == at[d])) / (len(lines[x]) - 1)
            able = [(round(v, 9), -s) for s, v in score.items() if (s > at[d] if turn % 2 == 0 else s < at[d])]
            if able and (gain := round(max(able)[0] - score.get(at[d], 0.0), 9)) > 0.000001:
                wishes[at[d], -max(able)[1], sharding.STEPS - math.floor(sharding.STEPS * gain / (1 + gain))].append(d)
        room, spare, moved = {s: most - size[s] for s in range(shards)}, {s: size[s] - least for s in range(shards)}, 0
        for frm, to, step in sorted(wishes, key=lambda c: (c[2], c[1], c[0])):
            movers = sorted(wishes[frm, to, step])[: max(0, min(len(wishes[frm, to, step]), room[to], spare[frm]))]
            for d in movers:
                at[d] = to
            room[to] -= len(movers)
            spare[frm] -= len(movers)
            size[frm] -= len(movers)
            size[to] += len(movers)
            moved += len(movers)
        if turn and moved + before <= sharding.SETTLED * len(of):
            break
        before = moved
    return {d: (at[d], first[d]) for d in ids}


@pytest.mark.parametrize("heavy_lines", [10_000, 3])
def test_shards_equal_the_plain_form(make_docs, heavy_lines):
    rng = random.Random(55)
    lines = [[_text(rng, 6) for _ in range(4)] for _ in range(30)]
    common = _text(rng, 8)
    rows = [(i, "\n".join([_text(rng, 8), *rng.sample(lines[i // 12], 3), *([common] if i % 3 == 0 else [])])) for i in range(360)]
    rows += [(None, rows[0][1]), (5, rows[40][1]), (400, None), (401, ""), (402, "short")]
    got = {r.doc_id: (r.shard, r.first_shard) for r in sharding.shard_documents(make_docs(rows), shards=4, heavy_lines=heavy_lines).collect()}
    assert got == _plain_shards(rows, 4, sharding.ROUNDS, sharding.SLACK)
    sizes = Counter(s for s, _ in got.values())
    assert max(sizes.values()) <= math.ceil(1.1 * len(got) / 4) and min(sizes.values()) >= math.floor(0.9 * len(got) / 4)


# Secrets.


def _plain_ratio(model, token):
    code = lambda c: secret_scan._ALPHABET.index(c)
    past, out = [secret_scan._N - 1] * 2, []
    for c in token:
        out.append(float(model.table[past[0], past[1], code(c)]))
        past = [past[1], code(c)]
    return out


def _plain_is_secret(model, token):
    score = sum(_plain_ratio(model, token))
    return score >= secret_scan.TOTAL and score >= secret_scan.MEAN * len(token) and not token.strip("=-_+/").isdigit() and any(c.isalnum() for c in token), score


def _plain_spans(model, token):
    yes, score = _plain_is_secret(model, token)
    if yes and len(token) >= secret_scan.WHOLE:
        return [(0, len(token), score)]
    ratio, out = _plain_ratio(model, token), []
    at = 0
    for part in token.replace("/", "=").split("="):
        if len(part) >= secret_scan.WHOLE and _plain_is_secret(model, part)[0]:
            end = at + len(part)
            out.append((at, len(token) if not token[end:].strip("=") else end, _plain_is_secret(model, part)[1]))
        at += len(part) + 1
    if sum(x for x in ratio if x > 0) < secret_scan.STRETCH or len(token) < secret_scan.WHOLE and secret_scan.WORD_RE.fullmatch(token):
        return out
    todo = list(itertools.pairwise([0, *(x for a, b, _ in out for x in (a, b)), len(token)]))[::2]
    while todo:
        low, high = todo.pop()
        best, a, b = 0.0, low, low
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += ratio[j] - secret_scan.MEAN
                if total > best + 1e-9:
                    best, a, b = total, i, j + 1
        if a == b or sum(x for x in ratio[low:high] if x > 0) < secret_scan.STRETCH:
            continue
        start, end = a, b
        while a < b and token[a] in secret_scan.GLUE:
            a += 1
        if sum(ratio[a:b]) >= secret_scan.STRETCH and any(c.isalpha() for c in token[a:b]):
            start = a
            while start > low and token[start - 1] not in secret_scan.GLUE:
                start -= 1
            while end < high and token[end] not in secret_scan.GLUE:
                end += 1
            end = high if not token[end:high].strip("=") else end
            out.append((start, end, sum(ratio[a:b])))
        todo += [(low, start), (end, high)]
    return sorted(out)


def test_secrets_equal_the_plain_form(make_docs):
    rng = random.Random(56)
    model = secret_scan.MarkovRatio.fit(secret_scan.labelled_samples(WORDS, seed=3))
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    rows = [(None, f"null id {key(30)}"), (0, None), (0, "")]
    for i in range(150):
        parts = [rng.choice(["name=", "path/to/", "A_B-", "", "x" * 20, "1234567890123456"]) + rng.choice([key(rng.choice([8, 12, 16, 24, 40])), rng.choice(WORDS) * 3]) + rng.choice(["", "==", "/end", "_suffix"]) for _ in range(6)]
        rows.append((i + 1, " ".join([_text(rng, 10), *parts])))
    want = []
    for doc, text in rows:
        for m in secret_scan.TOKEN_RE.finditer(text or ""):
            want += [(-1 if doc is None else doc, m.start() + a, b - a, text[m.start() + a : m.start() + b]) for a, b, _ in _plain_spans(model, m[0])]
    got = [(-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.secret) for r in secret_scan.find_secrets(make_docs(rows), model).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_runs_beyond_any_length_are_scored_whole():
    rng = random.Random(57)
    model = secret_scan.MarkovRatio.fit(secret_scan.labelled_samples(WORDS, seed=3))
    blob = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=3 * secret_scan.RUN + 7))
    assert secret_scan.redact(model, f"a {blob} b") in (f"a {secret_scan.PLACEHOLDER * n} b" for n in range(1, 6))
    names = "/".join(rng.choices(secret_scan.IDENTIFIERS, k=4000))
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=32))
    for at in (0, 4000, 8190, 12_000, len(names) - 40):
        at = names.find("/", at) + 1
        assert key not in secret_scan.redact(model, names[:at] + key + "/" + names[at:])
    assert all("".join(p for _, p in secret_scan.pieces(x)) == x and all(len(p) >= secret_scan.RUN // 4 for _, p in secret_scan.pieces(x)) for x in (blob, names))
    assert secret_scan.redact(model, "a " + "x" * 15 + " b") == "a " + "x" * 15 + " b"


# SimHash.


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_every_cover_holds_the_radius(parts):
    rng = random.Random(58)
    cover = neardup.masks(parts=parts).tolist()
    assert len(set(cover)) == len(cover) == {1: 4095, 2: 126, 3: 765}[parts]
    for _ in range(300):
        flipped = sum(1 << b for b in rng.sample(range(64), neardup.RADIUS))
        assert any(flipped & m == 0 for m in cover)


def _near_groups(pairs, radius, confirm):
    up = {p: p for p in pairs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), (c, d) in itertools.combinations(sorted(pairs), 2):
        if (a ^ c).bit_count() <= radius and (b ^ d).bit_count() <= confirm:
            x, y = find((a, b)), find((c, d))
            up[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for p in pairs:
        groups[find(p)].add(p)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("parts,task_entries", [(1, 1_000_000), (2, 1_000_000), (3, 1_000_000), (2, 900)])
def test_near_hashes_equal_all_pairs(spark, parts, task_entries, monkeypatch):
    """With tasks of 900 entries hot buckets are cut into blocks."""
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    rng = random.Random(59)
    pairs = set()
    for _ in range(20):
        h1, h2 = rng.getrandbits(63), rng.getrandbits(63)
        for _ in range(rng.choice([1, 2, 5, 60])):
            pairs.add((h1 ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 6))), h2 ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 14)))))
    df = spark.createDataFrame(sorted(pairs), "h1 long, h2 long")
    groups = defaultdict(set)
    for r in neardup.near_groups(df, task_entries=task_entries, parts=parts).collect():
        groups[r.g1, r.g2].add((r.h1, r.h2))
    assert {frozenset(g) for g in groups.values()} == _near_groups(pairs, neardup.RADIUS, neardup.CONFIRM)


def test_hot_tasks_are_cut_so_that_every_two_entries_meet():
    rng = np.random.default_rng(60)
    blocks = neardup.Blocks(10, {3: 4, 7: 2})
    assert blocks.total == 10 + 10 + 3
    task, h = rng.integers(0, 10, 500), rng.integers(0, 1 << 60, 500).astype(np.uint64)
    number, entry = blocks.spread(task, h, h)
    at = defaultdict(set)
    for n, e in zip(number.tolist(), entry.tolist(), strict=True):
        at[e].add(n)
    for a, b in itertools.combinations(range(500), 2):
        if task[a] == task[b]:
            assert at[a] & at[b]
    assert all(at[e] == {int(task[e])} for e in range(500) if task[e] not in (3, 7)) and max(number) == blocks.total - 1


# Hot groups.


def test_a_hundred_thousand_copies(spark, make_docs):
    """One text in a hundred thousand rows, beside a few others."""
    from pyspark.sql import functions as F

    text = "the same boilerplate line of many pages\nand another line that they all share"
    hot = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(len(text)).cast("bigint").alias("n_chars"))
    docs = hot.unionByName(make_docs([(200_000 + i, f"{_text(random.Random(i), 30)}\nand another line that they all share") for i in range(50)]))
    got = fingerprint.fingerprints(docs).groupBy("first_doc_id", "copies").count().collect()
    assert sorted((r.first_doc_id, r.copies, r["count"]) for r in got)[:1] == [(0, 100_000, 100_000)] and len(got) == 51
    near = neardup.near_duplicates(docs).groupBy("duplicate_of", "group_size").count().collect()
    assert [tuple(r) for r in near] == [(0, 100_000, 99_999)]
    kept = [r.doc_id for r in neardup.drop_near_duplicates(docs).select("doc_id").collect()]
    assert len(kept) == 51 and 0 in kept
    sizes = [r["count"] for r in sharding.shard_documents(docs, shards=4).groupBy("shard").count().collect()]
    assert sum(sizes) == 100_050 and max(sizes) <= math.ceil(1.1 * 100_050 / 4) and min(sizes) >= math.floor(0.9 * 100_050 / 4)


def test_equal_digests_of_different_texts_stay_apart(make_docs):
    docs = make_docs([(1, "a b"), (2, "A  B"), (3, "c"), (4, "C"), (5, "d"), (6, "longer one"), (7, None)])
    got = {r.doc_id: (r.first_doc_id, r.copies) for r in fingerprint.fingerprints(docs, digest=lambda b: bytes([len(b) > 4])).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1), 6: (6, 1), 7: (7, 1)}


# Mixing and the pipeline.


def _plain_mix(rows):
    """(doc_id, copies) by inverting each source's Poisson distribution."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text or "")
    weight = {s: math.sqrt(n) for s, n in size.items()}
    out = []
    for doc, text, source in rows:
        if not size[source]:
            continue
        rate = weight[source] / sum(weight.values()) * sum(size.values()) / size[source]
        u = int(hashlib.md5(f"{mixing.SEED}:{'null' if doc is None else doc}:1".encode()).hexdigest()[:13], 16) / 16**13
        p = total = math.exp(-rate)
        n = 0
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        out += [(doc, text, source)] * n
    return out


def test_pipeline_equals_plain_stages(spark, make_docs, tmp_path):
    rng = random.Random(61)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    de = "der hund und die katze sind im haus und der garten ist gross heute nicht mehr so wie wir das wollten".split()
    en = "the dog and the cat are in the house and the garden is large today not any more as we had wanted it".split()
    rows = []
    for i in range(160):
        lang = "de" if i % 2 else "en"
        text = " ".join(rng.choices(de if i % 2 else en, k=rng.randint(30, 90)))
        rows.append((i, text + (f" {key}" if i % 9 == 0 else ""), lang, f"s{i % 3}"))
    rows += [(500, rows[3][1], "de", "s0"), (501, rows[4][1] + " dog", "en", "s1"), (502, "123 456", "en", "s1"), (503, None, None, None), (504, "", "de", None)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = language.fit_text_model(docs)
    counts = {x: language.count_grams([t for _, t, lang, _ in rows if lang == x and t is not None]) for x in ("de", "en")}
    assert np.allclose(model.table, language.TextModel.of_counts(counts).table)
    judged = _plain_identify([(lang, source, text) for _, text, lang, source in rows], model)
    rows = [r for r, j in zip(rows, judged, strict=True) if j[2]]
    assert not {502, 503, 504} & {r[0] for r in rows}

    one, two, some = neardup.hashes([r[1] for r in rows])
    kept, node = [], [(int(a), int(b)) for a, b in zip(one, two, strict=True)]
    group = {n: g for g in _near_groups(set(node), neardup.RADIUS, neardup.CONFIRM) for n in g}
    seen = set()
    for r, n in sorted(zip(rows, node, strict=True)):
        if group.get(n, n) not in seen:
            seen.add(group.get(n, n))
            kept.append(r)
    secrets = secret_scan.fit_secret_model(spark.createDataFrame([(r[0], r[1]) for r in kept], "doc_id long, text string"))
    clean = [(r[0], secret_scan.redact(secrets, r[1]), r[3]) for r in kept]
    assert not any(key in text for _, text, _ in clean)
    mixed = _plain_mix(clean)
    want = Counter()
    for doc, text, _ in mixed:
        words = len(text.split())
        for at in range(0, words, packing.CAPACITY):
            want[doc, at // packing.CAPACITY, at, min(packing.CAPACITY, words - at)] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start_word, r.n_words) for r in out) == want
    load = Counter()
    for r in out:
        load[r.bin_id] += r.n_words
    assert max(load.values()) <= packing.CAPACITY


# Ids that aren't numbers.


def test_passages_with_names_for_ids(spark, make_docs):
    rng = random.Random(62)
    shared = _text(rng, 60)
    rows = [(i, f"{_text(rng, 20)} {shared if i % 3 == 0 else ''} {_text(rng, 30)}") for i in range(30)]
    numbers = {r.doc_id: r for r in substring.repeated_passages(make_docs(rows)).collect()}
    named = spark.createDataFrame([(f"d{i:03}", t) for i, t in rows] + [(None, shared)], "doc_id string, text string")
    got = {r.doc_id: r for r in substring.repeated_passages(named).collect()}
    assert set(got) == {f"d{i:03}" for i in numbers} and len(got) == 10
    assert all(got[f"d{i:03}"][1:4] == r[1:4] and got[f"d{i:03}"].first_doc_id == f"d{r.first_doc_id:03}" for i, r in numbers.items())
