"""Map layout and clusters of a weighted term table: exact sparse rows, whole in no task and never on the driver.

A table of weights (key, term or code, weight) is a sparse matrix. Both operators need only its products with a few dense
columns: a join on codes and a sum by key one way, a join on keys and a sum by code the other.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.distribution import discard, numbered, ship, stored
from lexatlas.operators import layout_blocks

EPSILON = 1e-12
#: Columns of the block whose span turns to the leading vectors, turns at most, and the residual (as a share of the first value) that ends them.
BLOCK, MOST_TURNS, RESIDUAL = 16, 60, 1e-6
#: Starts of k-means, rounds of its seeding and draws a round for each cluster, Lloyd rounds at most, columns of one pass.
STARTS, SEED_ROUNDS, SEED_DRAWS, MOST_ROUNDS, WIDE = 4, 3, 2, 40, 48


def cluster_count(n: int, requested: int | None = None) -> int:
    if n <= 1:
        return n
    if requested is not None:
        return min(max(1, requested), n)
    return 1 if n < 3 else min(8, max(2, round(math.sqrt(n))))


def _matrix(weighted: DataFrame, key: str) -> DataFrame:
    """key, code, w as a stored table."""
    code = F.col("code") if "code" in weighted.columns else F.xxhash64("term")
    return stored(weighted.select(F.col(key).alias("key"), code.alias("code"), F.col("weight").alias("w")).where("key is not null"), "matrix")


def _product(matrix: DataFrame, other: DataFrame, on: str, by: str, columns: list[str]) -> DataFrame:
    """by and the sums of w times the columns of other (rows by on)."""
    return matrix.join(other, on).groupBy(by).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def _ids(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("key")).where("key is not null").distinct()


# k-means


def _draw(seed: int, salt: int) -> Column:
    """A number in (0, 1] for each key."""
    return (F.pmod(F.xxhash64("key", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))


def _vectors(matrix: DataFrame, chosen: list) -> dict:
    """Sparse rows of a few chosen keys, on the driver."""
    out = {k: {} for k in chosen}
    picked = matrix.sparkSession.createDataFrame([(k,) for k in chosen], matrix.select("key").schema)
    for r in matrix.join(F.broadcast(picked), "key").toLocalIterator():
        out[r.key][r.code] = r.w
    return out


def _as_columns(matrix: DataFrame, vectors: list[dict]) -> tuple[DataFrame, list[str]]:
    """Sparse vectors as the columns of a frame by code."""
    names = [f"c{k}" for k in range(len(vectors))]
    codes = sorted(set().union(*vectors)) if vectors else []
    rows = [(c, *[v.get(c, 0.0) for v in vectors]) for c in codes]
    return matrix.sparkSession.createDataFrame(rows, ", ".join(["code long", *[f"{n} double" for n in names]])), names


def _distances(ids: DataFrame, matrix: DataFrame, centres: DataFrame, names: list[str], squares: list[float]) -> DataFrame:
    """key, size (the row's squared length) and, for each centre, its squared distance."""
    sums = ids
    for k in range(0, len(names), WIDE):
        part = names[k : k + WIDE]
        sums = sums.join(_product(matrix, centres.select("code", *part), "code", "key", part), "key", "left")
    own = [F.greatest(F.col("size") + s - 2 * F.coalesce(F.col(n), F.lit(0.0)), F.lit(0.0)).alias(n) for n, s in zip(names, squares)]
    return sums.select("key", "size", *own)


def _seeds(ids: DataFrame, matrix: DataFrame, k: int, seed: int) -> list[list[dict]]:
    """STARTS lists of k centres: far rows drawn in rounds by their distance to those drawn before, weighed by the rows nearest to them, and thinned out to k."""
    first = ids.orderBy(_draw(seed, 0), "key").limit(1).collect()
    chosen, near = [r.key for r in first], None
    fresh = list(chosen)
    for turn in range(1, SEED_ROUNDS + 1):
        found = _vectors(matrix, fresh)
        vectors = [found[c] for c in fresh]
        centres, names = _as_columns(matrix, vectors)
        far = _distances(ids, matrix, centres, names, [sum(x * x for x in v.values()) for v in vectors])
        least = F.least(*names) if len(names) > 1 else F.col(names[0])
        now = far.select("key", least.alias("d"))
        near = stored(now if near is None else now.join(near.withColumnRenamed("d", "before"), "key").select("key", F.least("d", "before").alias("d")), "near")
        # exactly so many rows, each with a chance in proportion to its distance
        race = near.where("d > 1e-12").orderBy(-F.log(_draw(seed, turn)) / F.col("d"), "key").limit(SEED_DRAWS * k * STARTS)
        fresh = [r.key for r in race.collect()]
        chosen += fresh
        if not fresh:
            break
    found = _vectors(matrix, chosen)
    vectors = [found[c] for c in chosen]
    centres, names = _as_columns(matrix, vectors)
    far = _distances(ids, matrix, centres, names, [sum(x * x for x in v.values()) for v in vectors])
    nearest = F.array_position(F.array(*names), F.array_min(F.array(*names)))
    weights = np.zeros(len(chosen))
    for r in far.groupBy((nearest - 1).alias("c")).count().collect():  # a row for each chosen one
        weights[r.c] = r["count"]
    gram = np.zeros((len(chosen), len(chosen)))
    for a, v in enumerate(vectors):
        for b, u in enumerate(vectors[: a + 1]):
            small, large = (v, u) if len(v) < len(u) else (u, v)
            gram[a, b] = gram[b, a] = sum(x * large.get(c, 0.0) for c, x in small.items())
    apart = np.maximum(np.diag(gram)[:, None] + np.diag(gram)[None, :] - 2 * gram, 0)
    out = []
    for start in range(STARTS):
        rng = np.random.default_rng([seed, start])
        taken = [int(rng.choice(len(chosen), p=weights / weights.sum()))]
        while len(taken) < min(k, len(chosen)):
            odds = weights * apart[:, taken].min(axis=1)
            odds[taken] = 0
            if odds.sum() <= 0:
                break
            # of a few draws the one that leaves the least distance
            draws = rng.choice(len(chosen), size=2 + int(math.log(k + 1)), p=odds / odds.sum())
            taken.append(int(min(draws, key=lambda d: (weights * np.minimum(apart[:, taken].min(axis=1), apart[:, d])).sum())))
        out.append([vectors[t] for t in taken])
    return out


def kmeans(docs: DataFrame, weighted: DataFrame, requested: int | None = None, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """key and cluster_id of every document, by k-means on the rows of a table of weights; documents without terms are zero rows.

    STARTS sets of centres, seeded by rounds of distant draws, move side by side in the same joins until the sum of
    squared distances of the best of them stays (MOST_ROUNDS at most); the set with the least sum of squared distances counts. Clusters are
    numbered by their least key.
    """
    ids = _ids(docs, key)
    k = cluster_count(ids.count(), requested)
    if k <= 1:
        return ids.select(F.col("key").alias(key), F.lit(0).alias("cluster_id"))
    matrix = _matrix(weighted, key)
    sizes = matrix.groupBy("key").agg(F.sum(F.col("w") * F.col("w")).alias("size"))
    ids = stored(ids.join(sizes, "key", "left").fillna(0.0, ["size"]), "ids")
    starts = _seeds(ids, matrix, k, seed)
    groups = [range(sum(map(len, starts[:s])), sum(map(len, starts[: s + 1]))) for s in range(len(starts))]
    vectors = [v for start in starts for v in start]
    centres, names = _as_columns(matrix, vectors)
    squares = [sum(x * x for x in v.values()) for v in vectors]
    before = best = placed = None
    for _ in range(MOST_ROUNDS):
        last, moved_from = placed, centres
        far = _distances(ids, matrix, centres, names, squares)
        held = [F.array(*[F.col(names[c]) for c in g]) for g in groups]
        placed = stored(far.select("key", *[(F.array_position(h, F.array_min(h)) - 1).cast("int").alias(f"a{s}") for s, h in enumerate(held)], *[F.array_min(h).alias(f"m{s}") for s, h in enumerate(held)]), "placed")
        discard(last)
        totals = placed.agg(*[F.sum(f"m{s}").alias(f"m{s}") for s in range(len(groups))], *[F.count_if(F.col(f"a{s}") == j).alias(f"n{s}_{j}") for s, g in enumerate(groups) for j in range(len(g))]).first()
        best = min(range(len(groups)), key=lambda s: (totals[f"m{s}"], s))
        # moving rows lessen the sum: the same sum again means that none has moved
        if before is not None and totals[f"m{best}"] >= before * (1 - 1e-12):
            break
        before = min(totals[f"m{s}"] for s in range(len(groups)))
        joined = matrix.join(placed.select("key", *[f"a{s}" for s in range(len(groups))]), "key")
        sums = [F.sum(F.when(F.col(f"a{s}") == j, F.col("w")).otherwise(0.0)).alias(names[c]) for s, g in enumerate(groups) for j, c in enumerate(g)]
        moved = joined.groupBy("code").agg(*sums)
        # a centre without rows stays at the origin, and may win rows again
        share = {names[c]: max(1, totals[f"n{s}_{j}"]) for s, g in enumerate(groups) for j, c in enumerate(g)}
        centres = stored(moved.select("code", *[(F.col(n) / share[n]).alias(n) for n in names]), "centres")
        discard(moved_from)
        squares = list(centres.agg(*[F.coalesce(F.sum(F.col(n) * F.col(n)), F.lit(0.0)) for n in names]).first())
    named = placed.select("key", F.col(f"a{best}").alias("a"))
    order = {r.a: n for n, r in enumerate(named.groupBy("a").agg(F.min("key").alias("least")).orderBy("least").collect())}  # k rows
    return named.select(F.col("key").alias(key), F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("a")].alias("cluster_id"))


# layout


def circle(place: Column, n: int) -> tuple[Column, Column]:
    """Points at equal angles on the unit circle; one point is the origin."""
    if n <= 1:
        return F.lit(0.0), F.lit(0.0)
    angle = 2 * math.pi * place / n
    return F.cos(angle), F.sin(angle)


def _sums(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The products of the columns with each other, summed over all rows."""
    ship(rows.sparkSession)
    m = len(columns)

    def run(batches):
        total = np.zeros((m, m))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), pa.array(total.ravel())], ["at", "x"])

    parts = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "at long, x double")
    out = np.zeros(m * m)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():  # m * m rows
        out[r["at"]] = r["x"]
    return out.reshape(m, m)


def _mixed(rows: DataFrame, columns: list[str], mix: np.ndarray, name: str) -> tuple[DataFrame, list[str]]:
    """key and the columns times a matrix, under new names."""
    names = [f"{name}{k}" for k in range(mix.shape[1])]
    return rows.select("key", *[sum((F.col(c) * float(mix[a, b]) for a, c in enumerate(columns)), F.lit(0.0)).alias(n) for b, n in enumerate(names)]), names


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes columns with these products orthonormal; dependent ones are left out."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values.max(initial=0.0), EPSILON) * 1e-12
    return vectors[:, keep] / np.sqrt(values[keep])


def leading(matrix: DataFrame, rank: int = 2, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """key and the first left singular vectors of a matrix times their values, and the names of their columns.

    A block of random combinations of its columns is multiplied by the matrix and its transpose in turns, and made
    orthonormal each time; the best vectors in its span come from its products with its own image, a small matrix. It ends
    when the images of the asked vectors differ from their multiples by RESIDUAL.
    """
    uniform = lambda salt: (F.pmod(F.xxhash64("code", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    normal = lambda k: F.sqrt(-2 * F.log(uniform(2 * k))) * F.cos(2 * math.pi * uniform(2 * k + 1))
    own = [f"y{k}" for k in range(BLOCK)]
    # every code has its random numbers by hash: no table of them is joined
    block = stored(matrix.withColumns({c: F.col("w") * normal(k) for k, c in enumerate(own)}).groupBy("key").agg(*[F.sum(c).alias(c) for c in own]), "block")
    gram, last = _sums(block, own), block
    for _ in range(MOST_TURNS):
        basis, names = _mixed(block, own, _orthonormal(gram), "q")
        basis = stored(basis, "basis")
        discard(last)
        image = _product(matrix, _product(matrix, basis, "key", "code", names), "code", "key", names).select("key", *[F.col(n).alias(f"i{n}") for n in names])
        both = last = stored(basis.join(image, "key"), "image")
        discard(basis)
        m = len(names)
        inner = _sums(both, [*names, *[f"i{n}" for n in names]])
        ritz, turn = np.linalg.eigh((inner[:m, m:] + inner[m:, :m]) / 2)
        turn, values = turn[:, np.argsort(ritz)[::-1]], np.sort(ritz)[::-1]
        # |image - value * vector| of each, from the products alone
        squares = np.diag(turn.T @ inner[m:, m:] @ turn) - 2 * values * np.diag(turn.T @ inner[:m, m:] @ turn) + values**2
        block, own, gram = both.select("key", *[F.col(f"i{n}").alias(n) for n in names]), names, inner[m:, m:]
        if (np.sqrt(np.maximum(squares[:rank], 0)) <= RESIDUAL * max(values[0], EPSILON)).all():
            break
    shown = turn[:, :rank] * np.sqrt(np.maximum(values[:rank], 0))
    return _mixed(both, names, shown, "u")


def layout(weighted: DataFrame, docs: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """key, x, y of every document: the two leading components of its row of weights, each axis drawn to [-1, 1].

    A component's sign makes its largest number positive. A constant axis becomes -1; documents without terms lie where a row
    of zeros does. Two documents or fewer, or fewer than two terms in all, lie on a circle, in the order of their keys.
    """
    ids = _ids(docs, key)
    n, matrix = ids.count(), _matrix(weighted, key)
    if n <= 2 or matrix.select("code").distinct().limit(2).count() < 2:
        x, y = circle(F.col("n"), n)
        return numbered(ids, "key").select(F.col("key").alias(key), x.alias("x"), y.alias("y"))
    found, names = leading(matrix, 2, seed)
    found = stored(found, "components")
    discard(matrix)
    return _placed(ids, found, names, key)


def layout_of(docs: DataFrame, key: str = "doc_id", seed: int = 42, **how) -> DataFrame:
    """layout() of the TF-IDF weights of texts, by packed blocks."""
    ids = _ids(docs, key)
    n = ids.count()
    few = n <= 2
    if not few:
        waves, groups, rows = layout_blocks.blocks_of(docs, key=key, **how)
        blocks = functools.reduce(DataFrame.unionByName, waves)
        few = blocks.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0] < 2
    if few:
        x, y = circle(F.col("n"), n)
        return numbered(ids, "key").select(F.col("key").alias(key), x.alias("x"), y.alias("y"))
    found = stored(layout_blocks.leading(blocks, groups, rows, 2, seed), "components")
    discard(*waves)
    return _placed(ids, found, ["u0", "u1"], key)


def _placed(ids: DataFrame, found: DataFrame, names: list[str], key: str) -> DataFrame:
    rows = ids.join(found, "key", "left").select("key", *[F.coalesce(names[k], F.lit(0.0)).alias(c) if k < len(names) else F.lit(0.0).alias(c) for k, c in enumerate("xy")])
    ends = rows.agg(*[f(c).alias(f"{g}{c}") for c in "xy" for g, f in (("a", F.min), ("b", F.max))]).first()

    def drawn(c: str) -> Column:
        low, high = ends[f"a{c}"], ends[f"b{c}"]
        low, high, sign = (-high, -low, -1.0) if -low > high else (low, high, 1.0)
        return 2 * (sign * F.col(c) - low) / max(high - low, EPSILON) - 1

    return rows.select(F.col("key").alias(key), drawn("x").alias("x"), drawn("y").alias("y"))
