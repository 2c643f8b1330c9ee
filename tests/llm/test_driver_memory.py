"""Near-dedup leaves little on the driver: no broadcasts of Spark's own, and components that go on from earlier ones."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from lexatlas.llm import near_dedup, runtime  # noqa: E402
from lexatlas.llm.components import components  # noqa: E402

KEY = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_components_from_settled_ones(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = lambda df: {r.id: r.root for r in df.collect()}
    first = components(pairs([(5, 4), (7, 8), (8, 9), (20, 21)]))
    assert got(first) == {5: 4, 8: 7, 9: 7, 21: 20}
    assert components(pairs([]), first) is first
    both = components(pairs([(9, 5), (3, 20), (30, 30)]), first)
    assert got(both) == {5: 4, 7: 4, 8: 4, 9: 4, 20: 3, 21: 3}


def test_no_broadcast_is_added(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[: 40 + i])) for i in range(12)] + [(20 + i, f"other text {i} of a few words more") for i in range(4)] + [(30, None), (31, "a b")]
    docs, seen, stored = spark.createDataFrame(rows, "doc_id long, text string"), [], runtime.stored

    def noted(df, name):
        seen.append(spark.conf.get(KEY, None))
        return stored(df, name)

    monkeypatch.setattr(runtime, "stored", noted)
    before = spark.conf.get(KEY, None)
    found = near_dedup.near_duplicates(docs, similar=80)
    assert len(seen) > 5 and set(seen) == {"-1"} and spark.conf.get(KEY, None) == before
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute.near_duplicates(rows, 80)
