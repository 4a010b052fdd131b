"""Small corpora with everything that may go wrong, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import defaultdict

CLASHING = "size kept key node comp a b h term norm head salt word n ids decoded seed next pos part start tokens data _text _row k1 k2 _gone _digest _sha _id _y own sha row y id place shard src name source_size".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return SPACE.findall(text or "")


def messy(seed: int = 0, n: int = 60) -> list[tuple]:
    """``doc_id, text, lang, source, n_chars``: copies, near copies, case variants, shared passages, nulls in each column,
    empty, blank and very long texts, and rows that repeat."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, out = prose(70), []
    for i in range(n):
        kind, text = rng.randrange(9), prose(rng.randint(1, 90))
        if kind == 0 and out:
            text = rng.choice(out)[1]
        elif kind == 1 and out and rng.choice(out)[1]:
            text = (rng.choice(out)[1] or "x").upper()
        elif kind == 2:
            base = words(rng.choice(out)[1] if out else None) or ["a"]
            base[rng.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind == 3:
            text = prose(rng.randint(0, 30)) + " \n" + passage + "\t" + prose(rng.randint(0, 30))
        out.append((i * 3, text, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", "Z", None]), len(text or "")))
    extra = [None, "", "   \n\t", "É Ünïcode ÉCOLE", "é ünïcode École", prose(6000), "w " * 3000, "one", "one two", "a<|endoftext|>b J̌ x", "x" * 3000]
    out += [(1000 + k, t, "en", "s0", None) for k, t in enumerate(extra)]
    out += [out[5], out[5], (None, out[6][1], None, None, None), (None, None, None, None, None)]
    return out


def frame(spark, rows: list[tuple], parts: int = 3):
    full = [(*r, *["clash"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = words(lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_components(rows: list[tuple], percent: int) -> dict[int, int]:
    sets = {(r[0], k): shingles(r[1]) for k, r in enumerate(rows) if r[0] is not None}
    top = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    items = list(sets.items())
    for i, ((a, _), s) in enumerate(items):
        for (b, _), t in items[i + 1 :]:
            common = len(s & t)
            if s and t and 100 * common >= percent * len(s | t):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {x: root(x) for x in top}


def repeated_words(rows: list[tuple], size: int) -> dict[int, set[int]]:
    """Positions of words in windows of ``size`` words that another document holds too."""
    held, texts = defaultdict(set), {r[0]: words(lower(r[1])) for r in rows if r[0] is not None and r[1] is not None}
    for d, w in texts.items():
        for i in range(len(w) - size + 1):
            held[tuple(w[i : i + size])].add(d)
    out = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - size + 1):
            if len(held[tuple(w[i : i + size])]) > 1:
                out[d].update(range(i, i + size))
    return out
