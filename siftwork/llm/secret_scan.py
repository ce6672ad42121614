"""Secrets by character Markov models.

Two second-order models of characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a token is a secret if the log-likelihood ratio of the first to the second is
high enough, and so is the stretch of a token whose ratio is, whatever name or path it is glued to. Candidate
tokens are found by the JVM, so only texts that hold one reach Python.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, only, tidy

#: A token: letters, digits and the signs of base64 and of key prefixes, at least this many in a row.
LEAST = 8
#: Fewer characters are no token of their own, but may be a stretch.
WHOLE = 16
#: A run of any length is one match. One beyond RUN characters is scored in pieces of equal size, so that no short tail
#: is left; a piece ends behind glue if there is any within its last BACK characters.
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
RUN = 4096
BACK = 512
TOKEN_RE = re.compile(TOKEN)
#: Fewer than WHOLE letters in one case are a word, of a rare language perhaps.
WORD_RE = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
PART_RE = re.compile(rf"[^=/]{{{WHOLE},}}")
#: Least log-likelihood ratio, in nats, of the whole token and of a character.
TOTAL = 10.0
MEAN = 0.35
#: Least ratio of a stretch, the best of many in its token, where ordinary words reach TOTAL now and then.
STRETCH = 20.0
#: What glues parts of a token; a stretch is reported up to these.
GLUE = "=/_-"
#: Ordinary words for training: the most frequent WORDS words of so many documents, those with the least hashes. Both bounds are on fitting only.
FIT_ROWS = 2000
WORDS = 20_000
SEED = 17
#: Characters of text whose tokens are scored at once.
STEP = 4 << 20
PLACEHOLDER = "[SECRET]"

_ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
_CODE = np.full(128, len(_ALPHABET), dtype=np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i
#: One more code for the beginning of a token.
_N = len(_ALPHABET) + 1

IDENTIFIERS = (
    "get set user name value index count list item data file path read write open close load save update delete insert select create build parse format string number "
    "buffer stream reader writer handler manager service factory client server request response message event listener context config option default parameter argument result "
    "error exception status state status code type class object method function module package import export public private static final abstract interface implementation "
    "session token password secret key account customer order product price total amount date time zone month year hour minute second address street city country phone email "
    "image video audio color width height size length depth position offset page line column row table view model controller component button label field form input output "
    "connection database query transaction cache memory thread process queue stack tree node graph edge vertex matrix vector array map filter reduce sort merge split join "
    "internal external local remote global primary secondary active inactive enabled disabled available required optional maximum minimum average current previous next first last "
    "http https www html json xml csv yaml utf ascii base hash digest signature certificate identity provider application environment production development staging test"
).split()


def labelled_samples(words: list[str], seed: int = SEED, n: int = 6000) -> list[tuple[str, int]]:
    """(token, 1 if random else 0): random strings over the usual alphabets, and identifiers composed of ordinary words."""
    rng = random.Random(seed)
    kinds = [string.hexdigits[:16], string.digits + string.ascii_uppercase, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567"]
    out = [("".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 64))), 1) for i in range(n)]
    clean = sorted({w for w in words if w.isascii() and w.isalpha() and len(w) > 1}) or IDENTIFIERS
    for i in range(n):
        source = clean if i % 2 else IDENTIFIERS
        parts = [rng.choice(source) for _ in range(rng.randint(2, 6))]
        style = i % 7
        if style == 0:
            token = "_".join(parts)
        elif style == 1:
            token = "-".join(parts)
        elif style == 2:
            token = parts[0].lower() + "".join(p.capitalize() for p in parts[1:])
        elif style == 3:
            token = "".join(p.capitalize() for p in parts)
        elif style == 4:
            token = "_".join(parts).upper()
        elif style == 5:
            token = "/".join(parts) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "")
        else:
            token = "".join(parts)
        out.append((token, 0))
    return out


class MarkovRatio:
    """log P(character | two before) of random strings less that of identifiers, a table of all triples."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def fit(cls, samples: list[tuple[str, int]], alpha: float = 0.05, backoff: float = 2.0) -> MarkovRatio:
        logs = []
        for label in (1, 0):
            three = np.zeros((_N, _N, _N))
            for token, y in samples:
                if y == label:
                    a, b, c = _triples(_codes(token))
                    np.add.at(three, (a, b, c), 1)
            two = three.sum(axis=0) + alpha
            two = two / two.sum(axis=1, keepdims=True)
            logs.append(np.log((three + backoff * two[None]) / (three.sum(axis=2, keepdims=True) + backoff)))
        return cls((logs[0] - logs[1]).astype(np.float32))

    def _flat(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ratio of each character of all tokens, where each token begins)."""
        sizes = np.array([len(t) for t in tokens])
        begins = np.cumsum(sizes) - sizes
        codes = np.full(int(sizes.sum()) + 2 * len(tokens), _N - 1)  # two codes before each token begin it
        own = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(1, len(tokens) + 1), sizes)
        codes[own] = _codes("".join(tokens))
        return self.table[codes[own - 2], codes[own - 1], codes[own]].astype(np.float64), begins

    def score(self, tokens: list[str]) -> np.ndarray:
        if not tokens:
            return np.zeros(0)
        return np.add.reduceat(*self._flat(tokens))

    def secret(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood ratio, decision) of non-empty tokens. Tokens of digits only are numbers, not secrets."""
        score = self.score(tokens)
        size = np.array([len(t) for t in tokens], dtype=float)
        mixed = np.array([not t.strip("=-_+/").isdigit() and any(c.isalnum() for c in t) for t in tokens], dtype=bool)
        return score, (score >= TOTAL) & (score >= MEAN * size) & mixed

    def spans(self, tokens: list[str]) -> list[list[tuple[int, int, float]]]:
        """(start, end, ratio) of each secret in each of the tokens, which aren't empty.

        A token that is a secret as a whole is one. Of any other token it is the parts between "=" and "/" that
        are secrets by themselves, and in what is left the stretches of greatest ratio beyond MEAN a character,
        up to the glue around them.
        """
        out: list[list[tuple[int, int, float]]] = [[] for _ in tokens]
        if not tokens:
            return out
        score, yes = self.secret(tokens)
        flat, begins = self._flat(tokens)
        reach = np.add.reduceat(np.maximum(flat, 0), begins)
        yes &= np.array([len(t) >= WHOLE for t in tokens])
        for i in np.flatnonzero(yes):
            out[i].append((0, len(tokens[i]), float(score[i])))
        parts = [(i, m.start(), m.end()) for i in np.flatnonzero(~yes).tolist() if "=" in tokens[i] or "/" in tokens[i] for m in PART_RE.finditer(tokens[i])]
        score, part = self.secret([tokens[i][a:b] for i, a, b in parts])
        for (i, a, b), x, y in zip(parts, score, part, strict=True):
            if y:
                out[i].append((a, len(tokens[i]) if not tokens[i][b:].strip("=") else b, float(x)))
        for i in np.flatnonzero(~yes & (reach >= STRETCH)).tolist():
            if len(tokens[i]) < WHOLE and WORD_RE.fullmatch(tokens[i]):
                continue
            ends = [0, *(x for a, b, _ in out[i] for x in (a, b)), len(tokens[i])]
            out[i] = sorted(out[i] + _stretches(tokens[i], flat[begins[i] : begins[i] + len(tokens[i])].tolist(), list(zip(ends[::2], ends[1::2], strict=True))))
        return out


def _stretches(token: str, ratio: list[float], todo: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of the disjoint stretches of a token that are secrets, within the ranges ``todo``."""
    out = []
    while todo:
        low, high = todo.pop()
        if sum(x for x in ratio[low:high] if x > 0) < STRETCH:
            continue
        best, now, a, b, begin = 0.0, 0.0, low, low, low
        for i in range(low, high):
            if now <= 0:
                now, begin = 0.0, i
            now += ratio[i] - MEAN
            if now > best:
                best, a, b = now, begin, i + 1
        if a == b:
            continue
        start, end = a, b
        while a < b and token[a] in GLUE:
            a += 1
        score = sum(ratio[a:b])
        if score >= STRETCH and any(c.isalpha() for c in token[a:b]):
            start = a
            while start > low and token[start - 1] not in GLUE:
                start -= 1
            while end < high and token[end] not in GLUE:
                end += 1
            if not token[end:high].strip("="):
                end = high
            out.append((start, end, score))
        todo += [(low, start), (end, high)]
    return out


def _codes(token: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(token.encode("latin-1", "replace"), dtype=np.uint8), 127)]


def _triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.full(2, _N - 1)
    whole = np.concatenate([start, codes])
    return whole[:-2], whole[1:-1], whole[2:]


def fit_secret_model(docs: DataFrame, rows: int = FIT_ROWS, vocabulary: int = WORDS) -> MarkovRatio:
    """Trains on labelled_samples with the ``vocabulary`` most frequent words of ``rows`` documents at most as ordinary ones; both bounds are on fitting only.

    Null ids and texts give no words; all rows of a chosen id do. A table without words, an empty one for example,
    leaves the built-in identifiers.
    """
    docs = only(docs, ["doc_id", "text"])
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(rows)
    words = docs.join(F.broadcast(ids), "doc_id").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\w=\"'])\p{Alpha}{2,24}(?![\w=\"'])"), F.lit(0))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(vocabulary).collect()
    return MarkovRatio.fit(labelled_samples([r[0] for r in words]))


def pieces(run: str) -> list[tuple[int, str]]:
    """(start, piece) of a run of token characters."""
    n = -(-len(run) // RUN)
    out, at = [], 0
    for i in range(1, n):
        end = len(run) * i // n
        glued = max(run.rfind(c, end - BACK, end) for c in GLUE)
        end = glued + 1 if glued >= 0 else end
        out.append((at, run[at:end]))
        at = end
    return [*out, (at, run[at:])]


def _secrets(model: MarkovRatio, texts: list[str]) -> list[tuple[int, int, int, float]]:
    """(index of the text, start, end, ratio) of every secret; a token that repeats is scored once."""
    places: dict[str, list[tuple[int, int]]] = {}
    for i, text in enumerate(texts):
        for m in TOKEN_RE.finditer(text):
            for at, piece in pieces(m[0]):
                places.setdefault(piece, []).append((i, m.start() + at))
    found = zip(places.values(), model.spans(list(places)), strict=True)
    return sorted((i, at + a, at + b, score) for where, spans in found for a, b, score in spans for i, at in where)


def _findings(model: MarkovRatio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            found = _secrets(model, texts)
            if not found:
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([i for i, *_ in found])), pa.array([a for _, a, _, _ in found], pa.int32()), pa.array([b - a for _, a, b, _ in found], pa.int32()), pa.array([texts[i][a:b] for i, a, b, _ in found], pa.string()), pa.array([round(x, 4) for *_, x in found])], ["doc_id", "start", "length", "secret", "score"]
            )

    return run


def find_secrets(docs: DataFrame, model: MarkovRatio) -> DataFrame:
    """(doc_id, start, length, secret, score): every secret token or stretch of one; start counts characters from 0.

    score is the log-likelihood ratio in nats. Texts and tokens of any length are scored whole (see RUN). Null and empty texts hold none; null ids stay null, and
    repeated rows report their secrets each. An empty table gives an empty one.
    """
    docs = only(docs, ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter(F.regexp_like("text", F.lit(TOKEN))).mapInArrow(_findings(model), f"doc_id {kind}, start int, length int, secret string, score double")


def _without(text: str, found: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in found:
        out += [text[at:a], PLACEHOLDER]
        at = b
    return "".join(out) + text[at:]


def redact(model: MarkovRatio, text: str) -> str:
    return _without(text, [(a, b) for _, a, b, _ in _secrets(model, [text])])


def redact_secrets(docs: DataFrame, model: MarkovRatio) -> DataFrame:
    """``docs`` with every secret in text replaced by PLACEHOLDER and n_chars set to the new length; no row is lost.

    Null and empty texts and texts without secrets stay as they are, with their n_chars. Repeated rows are
    treated alike. An empty table gives an empty one.
    """
    names = tidy(docs, ["text", "n_chars"]).columns
    docs = tidy(docs, ["text", "n_chars"], ("_new",))
    kind = docs.schema["n_chars"].dataType

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out: list[str | None] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < STEP or end == at):
                size += len(texts.iat[end] or "")
                end += 1
            some = [t or "" for t in texts.iloc[at:end]]
            found: dict[int, list[tuple[int, int]]] = {}
            for i, a, b, _ in _secrets(model, some):
                found.setdefault(i, []).append((a, b))
            out += [_without(t, found[i]) if i in found else None for i, t in enumerate(some)]
            at = end
        return pd.Series(out, index=texts.index, dtype=object)

    out = docs.withColumn("_new", cleaned(F.when(F.regexp_like("text", F.lit(TOKEN)), F.col("text"))))
    done = {"text": F.coalesce("_new", "text"), "n_chars": F.when(F.col("_new").isNotNull(), F.length("_new").cast(kind)).otherwise(F.col("n_chars"))}
    return out.select(*[done[c].alias(c) if c in done else F.col(f"`{c}`") for c in docs.columns]).toDF(*names)
