import random
import re
from collections import Counter

import pytest
from conftest import AWKWARD

from emberline.llm import collocations as c


def by_hand(docs, top, least, share):
    """All phrases counted, all candidates scored."""
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        small = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key) > 2 and a >= least}
    out = []
    for key, a in candidates.items():
        lang, *words = key
        longer = [n for other, n in candidates.items() if len(other) > len(key) and other[0] == lang and key[1:] in (other[1:3], other[2:4])]
        if any(100 * n >= share * a for n in longer):
            continue
        cuts = [(c.SCALE * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]], total[lang]))
    out.sort(key=lambda x: x[:4])
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right, n in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return rows


def texts(seed, rows, words):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    fixed = ["new york city", "new york", "a a a", "Big, old", "x\ty"]
    out = []
    for _ in range(rows):
        parts = rng.choices(names, weights, k=rng.randint(0, 30)) + rng.choices(fixed, k=rng.randint(0, 3))
        rng.shuffle(parts)
        out.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(p + rng.choice([" ", " ", "  ", ", ", ".", "\n"]) for p in parts)))
    return out + [("en", t) for t in AWKWARD]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, size long")


@pytest.mark.parametrize("seed,top,steps,chunk", [(1, 10, (2,), 200), (3, 2000, (2, 16), 3_000_000), (4, 3, (1, 5), 50)])
def test_equals_counting_everything(spark, seed, top, steps, chunk):
    rows = texts(seed, 400, 25)
    got = c.mine(frame(spark, rows), top=top, least=4, steps=steps, chunk=chunk).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows, top, 4, c.SHARE))


def test_a_crowded_frontier_changes_nothing(spark):
    rows = texts(6, 200, 20)
    assert sorted(map(tuple, c.mine(frame(spark, rows), top=8, least=3, bits=64).collect())) == sorted(by_hand(rows, 8, 3, c.SHARE))


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_019, 3_000_000_021, 3_000_000_033)], "a long, l long, r long").select(c.score("a", "l", "r").alias("s")).first()
    assert row["s"] == 10**6 * 3_000_000_019**2 // (3_000_000_021 * 3_000_000_033)


def test_nothing_to_mine(spark):
    assert c.mine(frame(spark, [("en", None), (None, ""), ("fr", "a b c")])).count() == 0
    assert c.mine(frame(spark, [("en", "a")]).filter("false")).count() == 0
