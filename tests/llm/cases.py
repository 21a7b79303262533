"""Small tables with every awkward row, and plain versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must not disturb.
CLASHING = "fp key a b id n h c want row rows unit start end first last label gram place code bound cell chunk kind epoch block before weight quota score held_out digest body length piece __key __doc __gone __h __n __text __row __block __rank".split()
SEPARATORS = re.compile("[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[str]:
    return SEPARATORS.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: str = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu") -> str:
    names = vocabulary.split()
    out = [rng.choice(names) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n)]
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(out)).strip()


def edge_rows(seed: int = 3) -> list[tuple]:
    """Nulls anywhere, empty and long texts, ties, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, 60 + 10 * i) for i in range(8)]
    texts = [None, "", " \n\t ", "one", "two words", "a b c d", "a b c d e", "\n\n\n", "!!! ###", "ünïcödé ŁÓDŹ 漢字かな 🙂 text", *base]
    texts += [base[0], base[0] + " tail", base[1].replace("alpha", "omega", 1), base[2] + "\n" + base[3], base[3] + "\n" + base[2], base[4].upper()]
    texts += ["x" * 5000, "word " * 4000, prose(rng, 9000), "line same here again and again with ten words or more\n" * 30]
    rows = [(i, t, ["en", "de", None, "fr"][i % 4], ["s1", "s1", "s2", None, "s3"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base[5], "en", "s1", 9), (None, None, None, None, None), (900, base[6], None, None, None)]
    return rows


def table_of(spark: SparkSession, rows: list[tuple], clashing: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clashing else df


def simhash(text: str | None, n: int = 4) -> int:
    found = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: list[int], radius: int = 4) -> dict[int, int]:
    """For each fingerprint, the least fingerprint of its component."""
    nodes = sorted(set(prints))
    root = {x: x for x in nodes}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= radius and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


def near_classes(rows: list[tuple[int | None, str | None]]) -> dict[int | None, int]:
    """component_id by key (for keys that don't repeat with other texts)."""
    prints = [(k, simhash(t)) for k, t in rows]
    least, of = defaultdict(list), classes([p for _, p in prints])
    for k, p in prints:
        if k is not None:
            least[of[p]].append(k)
    return {k: min(least[of[p]]) for k, p in prints}


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def passes_rules(text: str | None) -> bool:
    """All quality rules, one after the other, on one text."""
    text = text or ""
    n, chars, symbols, dup, repeat = base_statistics(text)
    w = words(text)
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    lines = [x for x in text.split("\n") if words(x)]
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    bad = [n < 50, 100 * repeat > 50 * n, 10 * symbols > n, upper > lower, 10 * text.count("!") > 3 * n, 10 * chars < 25 * n or chars > 12 * n, 5 * stutter > n, 2 * dup > len(lines)]
    return not any(bad)


def auc(scores: list[float], labels: list[int]) -> float:
    order = sorted(zip(scores, labels, strict=True))
    ranks, i = {0: 0.0, 1: 0.0}, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        for _, y in order[i:j]:
            ranks[y] += (i + j + 1) / 2
        i = j
    pos = sum(labels)
    neg = len(labels) - pos
    return (ranks[1] - pos * (pos + 1) / 2) / (pos * neg)
