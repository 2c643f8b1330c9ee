"""The near-dedup stage against brute force at its own similarity of 0.80."""

import random
import sys
from itertools import combinations
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402


def stage_ids(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())


def kept_at(rows, similar):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= similar * len(sets[a] | sets[b]):
            x, y = least[a], least[b]
            least = {i: min(x, y) if r in (x, y) else r for i, r in least.items()}
    return sorted(i for i, r in least.items() if r == i)


def test_stage_links_from_eighty(spark):
    """Copies of 120 words with 0 to 4 words changed far apart: 2 changes leave 106 of 126 shingles, 0.84."""
    rng, rows = random.Random(4), []
    for group in range(12):
        words = [f"w{group}x{rng.randrange(10**9)}" for _ in range(120)]
        rows.append((10 * group, " ".join(words)))
        changed = [w if k not in (20, 40, 60, 80)[: group % 5] else "other" + w for k, w in enumerate(words)]
        rows.append((10 * group + 1, " ".join(changed)))
    assert kept_at(rows, 80) != kept_at(rows, 85)
    assert stage_ids(spark, rows) == kept_at(rows, 80)


def test_different_texts_under_one_id_stay(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"v{rng.randrange(10**9)}" for _ in range(60)) for _ in range(3))
    rows = [(7, a), (7, a), (7, b), (3, c), (7, c), (9, b), (5, "alone"), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(7, a), (7, b), (3, c), (5, "alone"), (5, ""), (5, "")])
