"""Honeytokens: decoy credentials, the marker that tells them from real ones, and where they stand in texts."""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of

_ALNUM = string.ascii_letters + string.digits
#: name: (rule, prefix, alphabet, length)
KINDS = {
    "aws": ("AWS_ACCESS_KEY", "AKIA", string.ascii_uppercase + string.digits, 16),
    "github": ("GITHUB_TOKEN", "ghp_", _ALNUM + "_", 36),
    "stripe": ("STRIPE_SECRET", "sk_" + "live_", _ALNUM, 24),
    "openai": ("OPENAI_API_KEY", "sk-", _ALNUM, 48),
}


@dataclass(frozen=True)
class Honeytoken:
    name: str
    token_type: str
    value: str
    marker: str


def generate(seed: int | None = None, marker: str = "sift") -> list[Honeytoken]:
    """One token of each kind; with a seed, always the same ones."""
    rng = random.Random(seed) if seed is not None else random.SystemRandom()
    return [Honeytoken(name, rule, prefix + "".join(rng.choices(chars, k=n)), f"{marker}:honeytoken") for name, (rule, prefix, chars, n) in KINDS.items()]


def honeytoken_lines(docs: DataFrame, marker: str = "sift") -> DataFrame:
    """(path, line_number, token): lines of (path, text) rows that carry the marker, with what is assigned there, if anything."""
    lines = docs.filter(F.contains("text", F.lit(f"{marker}:honeytoken"))).select("path", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    marked = lines.filter(F.contains("line", F.lit(f"{marker}:honeytoken")))
    value = F.regexp_extract("line", r"\A[^=]*=\s*([^\s=]+)", 1)
    return marked.select("path", (F.col("i") + 1).alias("line_number"), F.when(value != "", value).alias("token"))
