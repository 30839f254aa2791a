"""Secret scan: base patterns, and a battery of randomness tests on tokens that look like keys."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.spans import digest, found, once, overlaps_base

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?:(?i:password|passwd|secret|token)|(?i:api)_?(?i:key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [ASSIGN, "AKIA[A-Z0-9]++", "(?<![0-9a-f])[0-9a-f]{24,}+", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+"]
#: Alphabets that a token's encoding is inferred from, in code order, the first that has all its characters. For the first
#: CASED of them - hexadecimal, base 32 and base 36 - dashes and underscores separate groups and are left out.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [
    DIGITS + LOWER[:6], DIGITS + UPPER[:6], UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, DIGITS + UPPER + LOWER, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
]
CASED = 5
#: Lower ends of the length classes. Of the tokens that are tested so large a share is ordinary, it is assumed; so large a
#: share of what is found may be. Tokens that are simulated for a class; shares of random ones that may be given up.
LENGTHS, ORDINARY, FALSE, TRIALS, GIVEN_UP = (20, 24, 28, 32, 40, 48, 64, 96, 128), 0.9, 0.1, 2000, (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
#: Letters of ordinary tokens by their frequency in English text, from the most frequent on.
FREQUENCY = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.2, 0.2, 0.1, 0.1), strict=True))


def two_sided(z: Column) -> Column:
    """The probability that a standard normal is further from 0 than z (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def inferred(token: Column) -> Column:
    """(body, code): what of a token is tested and the place of its alphabet; null where none has all its characters."""
    body = F.regexp_replace(token, "=+$", "")
    bare = F.regexp_replace(body, "[-_]", "")
    ways = [(k, bare if k < CASED else body, a) for k, a in enumerate(ALPHABETS)]
    return F.coalesce(*[F.when(x.rlike("^[" + a.replace("-", "\\-") + "]{20,}$"), F.struct(x.alias("body"), F.lit(k).alias("code"))) for k, x, a in ways])


def battery(token: Column) -> Column:
    """(code, n, s) of a token: its alphabet, how many characters are tested, and how unlike random ones they are; null
    without an alphabet.

    s is minus the sum of the logarithms of three p: chi-squared of the characters' counts against uniformity, the number
    of runs in the upper and lower half of the alphabet, and the correlation of neighbours, each by its normal approximation.
    How large s may be is told by simulation, so the approximations need not be good.
    """
    alphabets = F.array(*[F.lit(a) for a in ALPHABETS])

    def tests(t: Column) -> Column:
        body, alphabet = t["body"], F.get(alphabets, t["code"])
        n, k = F.length(body).cast("double"), F.length(alphabet).cast("double")
        chars = F.array_remove(F.split(body, "(?!^)"), "")  # the split ends with an empty one
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))

        def ordered(codes: Column) -> Column:
            pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            upper = F.aggregate(codes, F.lit(0.0), lambda t, c: t + F.when(c > k / 2, 1.0).otherwise(0.0))
            runs = F.aggregate(pairs, F.lit(1.0), lambda t, p: t + F.when((p["a"] > k / 2) != (p["b"] > k / 2), 1.0).otherwise(0.0))
            mean = F.aggregate(codes, F.lit(0.0), lambda t, c: t + c) / n
            spread = F.aggregate(codes, F.lit(0.0), lambda t, c: t + (c - mean) * (c - mean))
            joint = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + (p["a"] - mean) * (p["b"] - mean))
            both = 2 * upper * (n - upper)
            z_runs = F.when((upper > 0) & (upper < n) & (both > n), (runs - both / n - 1) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(9.0))
            z_serial = F.when(spread > 0, (joint / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
            ps = [F.when(chi > 0, two_sided(chi) / 2).otherwise(1 - two_sided(chi) / 2), two_sided(z_runs), two_sided(z_serial)]
            return F.struct(t["code"].alias("code"), F.length(body).alias("n"), (-sum((F.ln(F.greatest(p, F.lit(1e-12))) for p in ps), F.lit(0.0))).alias("s"))

        return once(F.transform(chars, lambda c: F.instr(alphabet, c).cast("double")), ordered)

    return once(inferred(token), lambda t: F.when(t.isNotNull(), tests(t)))


def _two_sided(z: np.ndarray) -> np.ndarray:
    x = np.abs(z) / np.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    return np.minimum(1.0, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x))


def unlikeness(codes: np.ndarray, k: int) -> np.ndarray:
    """s of battery() for tokens of one length: rows of places 1 to k in the alphabet."""
    n = codes.shape[1]
    squares = sum((codes == c).sum(axis=1).astype(float) ** 2 for c in range(1, k + 1))
    chi = (squares * k / n - n - (k - 1)) / np.sqrt(2 * (k - 1) * (1 - 1 / n))
    up = codes > k / 2
    upper, runs = up.sum(axis=1).astype(float), 1.0 + (up[:, 1:] != up[:, :-1]).sum(axis=1)
    apart = codes - codes.mean(axis=1, keepdims=True)
    spread, joint, both = (apart**2).sum(axis=1), (apart[:, 1:] * apart[:, :-1]).sum(axis=1), 2 * upper * (n - upper)
    with np.errstate(divide="ignore", invalid="ignore"):
        z_runs = np.where((upper > 0) & (upper < n) & (both > n), (runs - both / n - 1) / np.sqrt(both * (both - n) / (n * n * (n - 1))), 9.0)
        z_serial = np.where(spread > 0, (joint / spread + 1 / n) * np.sqrt(n), 9.0)
    ps = [np.where(chi > 0, _two_sided(chi) / 2, 1 - _two_sided(chi) / 2), _two_sided(z_runs), _two_sided(z_serial)]
    return -sum(np.log(np.maximum(p, 1e-12)) for p in ps)


def ordinary(alphabet: str, n: int, rng: np.random.Generator) -> np.ndarray:
    """Places of TRIALS tokens that are made like names, half of them words with a number behind, half numbers with a word:
    letters by their frequency in English, independent of each other, which is harder to tell from random ones than words are."""
    letter = np.array([FREQUENCY.get(c.lower(), 0.0) * (0.1 if c in UPPER and LOWER[0] in alphabet else 1) for c in alphabet])
    digit = np.array([float(c in DIGITS) for c in alphabet])
    made = rng.choice(len(alphabet), (TRIALS, n), p=letter / letter.sum())
    numbers = rng.choice(len(alphabet), (TRIALS, n), p=digit / digit.sum())
    upto = np.where(np.arange(TRIALS) % 2, rng.integers(n // 2, n + 1, TRIALS), rng.integers(0, n // 5 + 1, TRIALS))
    return np.where(np.arange(n) >= n - upto[:, None], numbers, made) + 1


@lru_cache
def bounds() -> list[list[float]]:
    """The greatest s of a token that is found, for each alphabet and length class; -1 where none may be.

    Random tokens and ordinary ones are simulated, with a fixed seed. The bound gives up the least share of the random ones
    by which at most FALSE of what is found is ordinary, if ORDINARY of all tokens are. It is the same for every table,
    so a verdict never depends on other rows.
    """
    rng, out = np.random.default_rng(3), []
    for a in ALPHABETS:
        row = []
        for n in LENGTHS:
            s = unlikeness(rng.integers(1, len(a) + 1, (TRIALS, n)), len(a))
            other = unlikeness(ordinary(a, n, rng), len(a))
            fine = -1.0
            for lost in GIVEN_UP:
                bound = float(np.quantile(s, 1 - lost))
                false = ORDINARY * ((other <= bound).sum() + 1) / TRIALS
                if false <= FALSE * (false + (1 - ORDINARY) * (1 - lost)):
                    fine = round(bound, 6)
                    break
            row.append(fine)
        out.append(row)
    return out


def looks_random(token: Column) -> Column:
    """Whether a token with a letter passes the battery at its alphabet's and length class's bound."""
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in bounds()])
    place = lambda t: F.aggregate(F.array(*[F.lit(x) for x in LENGTHS]), F.lit(-1), lambda k, x: F.when(t["n"] >= x, k + 1).otherwise(k))
    passes = once(battery(token), lambda t: t["s"] <= F.get(F.get(table, t["code"]), place(t)))
    return token.rlike("[A-Za-z]") & F.coalesce(passes, F.lit(False))


def secrets(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end of every secret of every whole text; kind is null for a text without any.

    Base spans are kept as they are. A token of 20 characters or more with a letter whose characters pass the battery is
    added as `random`, unless it shares a character with a base span. Null texts are empty; empty tables give no rows;
    rows that share a doc_id stay rows of their own; other columns are ignored.
    """
    m = found(docs, PATTERNS)
    drop = ((F.col("kind") == 0) & (F.length(F.regexp_extract("match", ASSIGN, 1)) < 6)) | ((F.col("kind") == 1) & (F.length("match") < 20))
    # a text whose every match is dropped keeps a row with null kind
    m = m.withColumn("kind", F.when(~F.coalesce(drop, F.lit(False)), F.col("kind"))).withColumn("over", overlaps_base(F.col("kind") < 3))
    keep = (F.col("kind") < 3) | (~F.col("over") & looks_random(F.col("match")))
    return m.select("row", "doc_id", F.when(keep, F.col("kind")).alias("kind"), "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """A row per text: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return digest(secrets(docs), KINDS, 3)
