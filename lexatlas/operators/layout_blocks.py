"""Layout of texts by packed blocks of their TF-IDF matrix: arrays travel, not its single numbers.

The matrix is cut in tiles of documents and ranges of codes. A range's product with its own transpose needs nothing of other
ranges, so only columns over documents travel in a turn, a copy for each few ranges. Terms of one document alone count for
their document's length and square only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.distribution import discard, ship, stored
from lexatlas.functions.text import TFIDF_TOKEN
from lexatlas.operators import tfidf

#: Columns that a turn adds, columns after which the best few are kept, and how many; turns at most, and the residual (as a share of the first value) that ends them.
ADDED, MOST_COLUMNS, KEPT, MOST_TURNS, RESIDUAL = 4, 32, 12, 120, 1e-6
#: Ranges of codes that one task multiplies; parts of all ranges that are built one after the other, so that their shuffled codes do not lie on disk together.
JOINT, WAVES = 4, 2


def _one(column: pa.Array, at: int) -> np.ndarray | None:
    return column[at].values.to_numpy(zero_copy_only=False) if column[at].is_valid else None


def blocks_of(docs: DataFrame, text: str = "text", key: str = "doc_id", token: str = TFIDF_TOKEN, stop: list[str] | None = None) -> tuple[list[DataFrame], int, int]:
    """Stored tables of blocks, one block for each range of codes c and tile g, the number of ranges, and of documents.

    row, col, tf: its terms of two documents or more; cols: columns of the range; every and own: for each row of the
    tile the squares of all its terms and of those that it has alone; terms: different terms of the range (in its first block); keys: those of
    the tile's rows, in the blocks of range 0.
    """
    spark = docs.sparkSession
    ship(spark)
    n, groups = tfidf.group_count(docs, text)
    token, stop = tfidf._settled(docs, text, token, stop)
    gone, kind = tfidf._stop_codes(spark, stop), dict(docs.dtypes)[key]

    def cut(table: pa.Table, low: int, high: int) -> pa.Table:
        """A tile's terms in the ranges from low to high."""
        g = table.column("g")[0].as_py()
        named = table.column(key).combine_chunks().dictionary_encode()
        at, found = 0, []
        for batch in table.select([key, "codes"]).combine_chunks().to_batches():
            for part in tfidf.slices(batch, 1):
                offsets, codes = tfidf.listed(part.column(1))
                row, code, *_ = tfidf._coded(codes.to_numpy(zero_copy_only=False), offsets, gone, True)
                found.append(tfidf._counted(named.indices.to_numpy()[at : at + part.num_rows][row].astype(np.int32), code))
                at += part.num_rows
        row, code, tf = (np.concatenate(x) for x in zip(*found))
        block = tfidf.block_of(code, groups)
        mine = np.flatnonzero((block >= low) & (block < high))
        order = mine[np.argsort(block[mine], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(block[mine] - low, minlength=high - low))])
        keys = pa.ListArray.from_arrays(pa.array([0] + [len(named.dictionary) if low == 0 else 0] * (high - low), pa.int32()), named.dictionary)
        same = lambda x: pa.array(np.full(high - low, x, np.int32))
        return pa.table({
            "c": pa.array(np.arange(low, high, dtype=np.int32)), "g": same(g), "n": same(len(named.dictionary)), "row": tfidf.lists(row[order].astype(np.int32), ends),
            "code": tfidf.lists(code[order], ends), "tf": tfidf.lists(tf[order].astype(np.int32), ends), "keys": keys,
        })

    def within(low: int, high: int):
        return lambda table: cut(table, low, high)

    def join(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).combine_chunks() for name in table.column_names}
        ends, values = tfidf.listed(columns["code"])
        _, col, df = np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        place, idf, terms = np.cumsum(df > 1) - 1, np.log((1 + n) / (1 + df)) + 1, len(df)
        rows, tfs = (tfidf.listed(columns[k])[1].to_numpy(zero_copy_only=False) for k in ("row", "tf"))
        out = {k: [] for k in ("row", "col", "tf", "every", "own")}
        for k, size in enumerate(columns["n"].to_pylist()):
            row, own = rows[ends[k] : ends[k + 1]], col[ends[k] : ends[k + 1]]
            w, shared = tfs[ends[k] : ends[k + 1]] * idf[own], df[own] > 1
            out["every"].append(np.bincount(row, w * w, size).astype(float))
            out["own"].append(np.bincount(row[~shared], w[~shared] ** 2, size).astype(float))
            out["row"].append(row[shared])
            out["col"].append(place[own[shared]].astype(np.int32))
            out["tf"].append(tfs[ends[k] : ends[k + 1]][shared])
        packed = {k: tfidf.lists(np.concatenate(v), np.concatenate([[0], np.cumsum([len(x) for x in v])])) for k, v in out.items()}
        blocks = table.num_rows
        return pa.table({
            "c": columns["c"], "g": columns["g"], "cols": pa.array(np.full(blocks, place[-1] + 1 if terms else 0, np.int32)), "terms": pa.array([terms] + [0] * (blocks - 1), pa.int64()),
            **packed, "keys": columns["keys"],
        })

    dealt = docs.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g"), key, text).repartition("g")
    coded = dealt.select("g", key, F.transform(tfidf._words(text, token), lambda w: F.xxhash64(w)).alias("codes"))
    out = []
    for low in range(0, groups, -(-groups // WAVES)):
        high = min(groups, low - (-groups // WAVES))
        cuts = coded.groupBy("g").applyInArrow(within(low, high), f"c int, g int, n int, row array<int>, code array<long>, tf array<int>, keys array<{kind}>")
        packed = cuts.groupBy("c").applyInArrow(join, f"c int, g int, cols int, terms long, row array<int>, col array<int>, tf array<int>, every array<double>, own array<double>, keys array<{kind}>")
        out.append(stored(packed, "blocks"))
    return out, groups, n


def _tiles(blocks: DataFrame, seed: int) -> DataFrame:
    """g, keys, scale (1 / length), diag (share of the terms that a row has alone), v and w (no columns yet) and q, the first columns to multiply."""
    kind = dict(blocks.dtypes)["keys"]

    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        keys = next(k for c, k in zip(table.column("c").to_pylist(), table.column("keys")) if c == 0)
        every, own = (np.sum([x.values.to_numpy() for x in table.column(k)], axis=0) for k in ("every", "own"))
        scale = np.divide(1, np.sqrt(every), out=np.zeros(len(every)), where=every > 0)
        q = np.random.default_rng([seed, g]).normal(size=(len(every), ADDED)) * (scale > 0)[:, None]
        one = lambda x: tfidf.lists(x.ravel(), np.array([0, x.size]))
        return pa.table({"g": table.column("g").slice(0, 1), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.values), "scale": one(scale), "diag": one(own * scale * scale), "v": one(np.zeros(0)), "w": one(np.zeros(0)), "q": one(q)})

    return blocks.select("c", "g", "every", "own", "keys").groupBy("g").applyInArrow(run, f"g int, keys {kind}, scale array<double>, diag array<double>, v array<double>, w array<double>, q array<double>")


def _products(blocks: DataFrame, sent: DataFrame, width: int, joint: int, n: int) -> DataFrame:
    """g and z: for every few ranges of codes (blocks joint * k and after) their product, times their transpose, with columns s of the tiles."""

    def flush(held: list, given: dict):
        sums = {}
        for c in {x[0] for x in held}:
            mine = [x[1:] for x in held if x[0] == c]
            size = mine[0][1]
            # all of a column's numbers are here, which tell its weight
            idf = np.log((1 + n) / (1 + sum(np.bincount(col, minlength=size) for _, _, _, col, _ in mine))) + 1
            mine = [(g, row, col, tf * idf[col]) for g, _, row, col, tf in mine]
            for j in range(width):
                y = np.zeros(size)
                for g, row, col, w in mine:
                    y += np.bincount(col, w * given[g][row, j], size)
                for g, row, col, w in mine:
                    z = sums.setdefault(g, np.zeros(given[g].shape))
                    z[:, j] += np.bincount(row, w * y[col], len(z))
        for g, z in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), tfidf.lists(z.ravel(), np.array([0, z.size]))], ["g", "z"])

    def run(batches):
        now, held, given = None, [], {}
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column(0)[k].as_py()
                if part != now:
                    yield from flush(held, given)
                    now, held, given = part, [], {}
                c, g, cols = (batch.column(x)[k].as_py() for x in (1, 2, 3))
                s = _one(batch.column(7), k)
                if s is not None:
                    given[g] = s.reshape(-1, width).copy()
                elif len(batch.column(4)[k]):
                    held.append((c, g, cols, *(_one(batch.column(x), k).copy() for x in (4, 5, 6))))
        yield from flush(held, given)

    mine = blocks.select((F.col("c") / joint).cast("int").alias("part"), "c", "g", "cols", "row", "col", "tf", F.lit(None).cast("array<double>").alias("s"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    theirs = sent.select("part", F.lit(-1).alias("c"), "g", F.lit(0).alias("cols"), none("array<int>", "row"), none("array<int>", "col"), none("array<int>", "tf"), "s")
    return mine.unionByName(theirs).repartition("part").sortWithinPartitions("part").mapInArrow(run, "g int, z array<double>")


def _turned(tiles: DataFrame, products: DataFrame, width: int) -> DataFrame:
    """tiles with the columns q and their images put to v and w."""
    kinds = dict(tiles.dtypes)
    names = ["g", "keys", "scale", "diag", "v", "w"]

    def run(batches):
        tile = z = None

        def done():
            scale, diag, v, w, q = tile[2:]
            image = z * scale[:, None] + diag[:, None] * q
            rows = len(scale)
            out = [np.concatenate([a.reshape(rows, -1) if a.size else np.zeros((rows, 0)), b], axis=1).ravel() for a, b in ((v, q), (w, image))]
            return pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), tile[1], *(tfidf.lists(x, np.array([0, x.size])) for x in (scale, diag, *out))], names)

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(1)[k].is_valid:
                    if tile is not None:
                        yield done()
                    scale, diag, v, w, q = (_one(batch.column(x), k).copy() for x in range(2, 7))
                    keys = batch.column(1).slice(k, 1)
                    tile, z = (batch.column(0)[k].as_py(), pa.concat_arrays([keys]), scale, diag, v, w, q.reshape(-1, width)), np.zeros((len(scale), width))
                else:
                    z += _one(batch.column(7), k).reshape(-1, width)
        if tile is not None:
            yield done()

    empty = products.select("g", *[F.lit(None).cast(kinds[c]).alias(c) for c in (*names[1:], "q")], "z")
    both = tiles.select(*names, "q", F.lit(None).cast("array<double>").alias("z")).unionByName(empty)
    dealt = both.repartition("g").sortWithinPartitions("g", F.col("keys").isNull())
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def _grams(tiles: DataFrame, columns: int) -> np.ndarray:
    """The products of all columns v and w with each other."""
    m = 2 * columns

    def run(batches):
        total = np.zeros((m, m))
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.concatenate([_one(batch.column(c), k).reshape(-1, columns) for c in (0, 1)], axis=1)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(m * m)
    for r in tiles.select("v", "w").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # m * m rows
        out[r["at"]] = r["x"]
    return out.reshape(m, m)


def _next(tiles: DataFrame, columns: int, keep: np.ndarray | None, of_v: np.ndarray, of_w: np.ndarray) -> DataFrame:
    """tiles with columns q mixed from v and w; with keep, v and w are mixed to fewer columns."""
    kinds = dict(tiles.dtypes)
    names = ["g", "keys", "scale", "diag", "v", "w", "q"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                v, w = (_one(batch.column(c), k).reshape(-1, columns) for c in (4, 5))
                q = v @ of_v + w @ of_w
                if keep is not None:
                    v, w = v @ keep, w @ keep
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(4)), *(tfidf.lists(x.ravel(), np.array([0, x.size])) for x in (v, w, q))], names)

    return tiles.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'array<double>')}" for c in names))


def leading(blocks: DataFrame, groups: int, n: int, rank: int = 2, seed: int = 42, key: str = "key") -> DataFrame:
    """key and u0, u1, ...: the first left singular vectors of the matrix times their values; 0 where it has no such value.

    A basis grows by the residuals of its best vectors, which are multiplied by the matrix and its transpose, until the asked
    vectors' residuals are at most RESIDUAL; where it has MOST_COLUMNS it is drawn together to its KEPT best vectors.
    """
    joint = max(1, min(JOINT, groups // blocks.sparkSession.sparkContext.defaultParallelism))
    parts = -(-groups // joint)
    tiles, last, columns, width = _tiles(blocks, seed), None, 0, ADDED
    for _ in range(MOST_TURNS):
        held = stored(tiles, "columns")
        discard(last)
        scaled = F.zip_with("q", F.flatten(F.transform("scale", lambda x: F.array_repeat(x, width))), lambda a, b: a * b)
        sent = held.select("g", scaled.alias("s")).select("g", "s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        last = stored(_turned(held, _products(blocks, sent, width, joint, n), width), "turn")
        discard(held)
        columns += width
        both = _grams(last, columns)
        g, h, k = both[:columns, :columns], both[:columns, columns:], both[columns:, columns:]
        size, basis = np.linalg.eigh(g)
        use = size > max(size.max(), 1e-300) * 1e-12
        basis = basis[:, use] / np.sqrt(size[use])
        values, turn = np.linalg.eigh(basis.T @ (h + h.T) @ basis / 2)
        values, best = values[::-1], basis @ turn[:, ::-1]
        most = max(values[0], 1e-300) if len(values) else 1e-300
        squares = np.einsum("ij,ij->j", best, k @ best) - 2 * values * np.einsum("ij,ij->j", best, h @ best) + values**2
        off = np.sqrt(np.maximum(squares, 0)) / most
        fresh = [j for j in range(min(ADDED, len(values))) if off[j] > 1e-9]
        if (off[:rank] <= RESIDUAL).all() or not fresh:
            break
        share = best[:, fresh] / (off[fresh] * most)
        keep = best[:, :KEPT] if columns + len(fresh) > MOST_COLUMNS else None
        tiles = _next(last, columns, keep, -share * values[fresh], share)
        columns, width = columns if keep is None else keep.shape[1], len(fresh)
    shown = np.zeros((columns, rank))
    real = [j for j in range(min(rank, len(values))) if values[j] > 1e-10 * most and values[j] > 1e-12]
    shown[:, real] = best[:, real] * np.sqrt(values[real])
    kind = dict(blocks.dtypes)["keys"][6:-1]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                u = _one(batch.column(1), k).reshape(-1, columns) @ shown
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, *(pa.array(u[:, j]) for j in range(rank))], [key, *(f"u{j}" for j in range(rank))])

    return last.select("keys", "v").mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"u{j} double" for j in range(rank))]))
