"""Every acceptable overlap of documents and benchmark items is found."""

import random
import re

import pytest

from threadhaul.llm import decontaminate as D
from threadhaul.llm.common import prepared

SETTINGS = D.Settings()


def plain_words(text):
    kept = re.sub(r"[^\w\x20\x09-\x0D]+|_", "", (text or "").lower())
    return [w for w in re.split(r"[\x20\x09-\x0D]+", kept) if w]


def best(pattern):
    now = top = 0
    for match in pattern:
        now = max(0, now + (1 if match else -SETTINGS.penalty))
        top = max(top, now)
    return top


def needed(n):
    return n if n < D.WHOLE else min(SETTINGS.least_score, SETTINGS.short_share * n)


def plain_overlaps(docs, items):
    """(doc_id, item_id, score): the best segment along any offset."""
    found = {}
    for doc_id, text in docs:
        own = plain_words(text)
        for item_id, other_text in items:
            other = plain_words(other_text)
            for shift in range(1 - len(other), len(own)):
                score = best([0 <= i + shift < len(own) and own[i + shift] == w for i, w in enumerate(other)])
                if other and score >= needed(len(other)):
                    found[doc_id, item_id] = max(score, found.get((doc_id, item_id), 0))
    return {(d, i, s) for (d, i), s in found.items()}


def missed(masks, need, limit):
    """The length of the shortest pattern with a segment of `need` that no mask hits; None up to `limit`."""
    longest = max(map(len, masks))
    ones = [(len(m), sum(1 << (len(m) - 1 - i) for i, c in enumerate(m) if c == "1")) for m in masks]
    seen, frontier = {(0, 0, 0)}, {(0, 0, 0)}
    for length in range(1, limit + 1):
        after = set()
        for bits, n, now in frontier:
            for match in (0, 1):
                bits2, n2 = (bits << 1 | match) & ((1 << longest) - 1), min(longest, n + 1)
                if any(n2 >= size and bits2 & mask == mask for size, mask in ones):
                    continue
                now2 = max(0, now + (1 if match else -SETTINGS.penalty))
                if now2 >= need:
                    return length
                if (bits2, n2, now2) not in seen:
                    seen.add((bits2, n2, now2))
                    after.add((bits2, n2, now2))
        frontier = after
    return None


def test_masks_hit_every_acceptable_pattern():
    """All patterns of items up to 57 words, which is what the settings say."""
    assert missed(SETTINGS.masks, SETTINGS.least_score, 57) is None
    assert missed(SETTINGS.masks, SETTINGS.least_score, 58) == 58
    for n in range(1, 16):
        masks = (D.short_mask(n),) if n < D.SHORT else SETTINGS.masks
        for bits in range(1 << n):
            pattern = [bits >> i & 1 for i in range(n)]
            if best(pattern) >= needed(n):
                spots = ((m, s) for m in masks for s in range(n - len(m) + 1))
                assert any(all(pattern[s + i] for i, c in enumerate(m) if c == "1") for m, s in spots), pattern


def test_long_items_with_random_substitutions():
    """Behind that length patterns without a hit exist, and are rare."""
    rng, accepted, hit = random.Random(8), 0, 0
    for _ in range(4000):
        n, share = rng.randrange(58, 120), rng.uniform(0.1, 0.3)
        pattern = [rng.random() >= share for _ in range(n)]
        if best(pattern) >= SETTINGS.least_score:
            accepted += 1
            hit += any(
                all(pattern[s + i] for i, c in enumerate(m) if c == "1") for m in SETTINGS.masks for s in range(n - len(m) + 1)
            )
    assert accepted > 2000 and hit / accepted > 0.999


@pytest.mark.parametrize("seed", (1, 2))
def test_overlaps_equal_brute_force(spark, seed):
    prepared(spark)
    rng = random.Random(seed)

    def some(n, letters):
        return [f"{rng.choice('Ab')}{rng.randrange(letters)}" for _ in range(n)]

    items = [(i, " ".join(some(rng.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 30, 50)), 400 if i % 3 else 6))) for i in range(40)]
    items += [(40, items[3][1]), (41, None), (42, ""), (43, " .,! "), (None, "no id but some words to be found in it")]
    docs = []
    for doc in range(120):
        words = some(rng.randrange(40), 400)
        for _ in range(rng.randrange(3)):
            piece = plain_words(rng.choice(items)[1])
            for i in range(len(piece)):
                if rng.random() < rng.choice((0, 0.1, 0.25)):
                    piece[i] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece[rng.choice((0, 0, 1)) :]
        docs.append((doc, " ".join(words) + rng.choice(("", "!", "\n"))))
    docs += [(1000, None), (1001, ""), docs[5], docs[6], (None, items[-1][1].upper())]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = D.overlaps(frame, bench).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == plain_overlaps(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    held = {r.doc_id for r in got}
    assert sorted((r.doc_id for r in D.decontaminated(frame, bench).collect()), key=repr) == sorted((i for i, _ in docs if i not in held), key=repr)


def test_many_substitutions_in_long_items(spark):
    """Every fourth word replaced: the score is reached only over forty words and more."""
    prepared(spark)
    item = [f"w{i}" for i in range(57)]
    docs = [(n, " ".join("x" if i % 4 == n % 4 else w for i, w in enumerate(item[: 37 + n]))) for n in range(21)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in D.overlaps(frame, bench).collect()} == plain_overlaps(docs, [(1, " ".join(item))])
