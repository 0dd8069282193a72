"""Exact dense top-k, merging of candidates, and n-gram similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut_lineage, stored


def dense_top_k(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, block: int = 2000) -> DataFrame:
    """(query, doc, score, rank): the k largest inner products of each query, ties by key; a query isn't its own result.

    The queries are a stated set, taken in blocks of a bounded size that all tasks get; each task keeps
    its own k best of a block, so that only k rows a query and task are shuffled. Vectors that are null or
    of another length than the query's don't match.
    """
    got = queries.select(F.col(key).cast("long").alias("q"), vector).filter(F.col(vector).isNotNull()).orderBy("q")
    docs = corpus.select(F.col(key).cast("long").alias("doc"), F.col(vector).alias("v")).filter(F.col(vector).isNotNull())
    parts: list[DataFrame] = []
    ids: list[int] = []
    vectors: list[list[float]] = []

    def close() -> None:
        shared = corpus.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, m = shared.value
            best_s, best_d = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0, dtype=np.int64)
            for batch in batches:
                col = batch.column("v")
                n = np.diff(np.asarray(col.offsets))
                ok = np.flatnonzero(n == m.shape[1])
                if not len(ok):
                    continue
                flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                first = np.asarray(col.offsets)[:-1] - col.offsets[0].as_py()
                mat = flat[first[ok][:, None] + np.arange(m.shape[1])]
                d = batch.column("doc").to_numpy()[ok]
                # Sums in the order of the coordinates, as a fold over the array would give.
                s = np.cumsum(m[:, None, :] * mat[None, :, :], axis=2)[:, :, -1] if m.shape[1] * len(d) * len(q) <= 1 << 22 else m @ mat.T
                s = np.where(d[None, :] == q[:, None], -np.inf, s)
                s, d2 = np.concatenate([best_s, s], axis=1), np.concatenate([best_d, np.broadcast_to(d, s.shape)], axis=1)
                order = np.lexsort((d2, -s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d2, order, 1)
            r, c = np.nonzero(np.isfinite(best_s))
            yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(best_d[r, c]), pa.array(best_s[r, c])], ["query", "doc", "score"])

        parts.append(docs.mapInArrow(run, "query long, doc long, score double"))
        ids.clear()
        vectors.clear()

    for row in got.toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == block:
            close()
    if ids:
        close()
    if not parts:
        return docs.sparkSession.createDataFrame([], "query long, doc long, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_candidates(hits: DataFrame, query: str, text: str, score: str, rank: str, most: int) -> DataFrame:
    """One row a query and text, with its best score and rank and its number of hits, the best `most` of each query."""
    merged = hits.groupBy(query, text).agg(F.max(score).alias("best_score"), F.min(rank).alias("best_rank"), F.count("*").alias("n_hits"))
    w = Window.partitionBy(query).orderBy(F.desc("best_score"), "best_rank", F.desc("n_hits"), text)
    return merged.withColumn("merged_rank", F.row_number().over(w)).filter(F.col("merged_rank") <= most)


def _word_grams(word: str, sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of a word's character n-grams inside its borders; a word that is no longer than n gives one and no longer ones.

    The last bit says whether the n-gram has other characters than ASCII.
    """
    c = np.frombuffer(f" {word} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = []
    for n in (min(n, len(c)) for n in sizes):
        m = len(c) - n + 1
        h, most = np.full(m, n, dtype=np.uint64), np.zeros(m, dtype=np.uint64)
        for k in range(n):
            h = (h ^ c[k : k + m]) * MIX
            h ^= h >> np.uint64(32)
            most |= c[k : k + m]
        out.append(h & ~np.uint64(1) | (most > 127))
        if m == 1:
            break
    return np.concatenate(out)


MIX = np.uint64(0x9E3779B97F4A7C15)
#: Training texts of a script that its basis is fitted on, n-grams and dimensions of a basis, and the dimensions that all pairs are compared in.
FITTED, FEATURES, DIMENSIONS, FIRST = 1536, 1 << 14, 256, 160
#: Half-precision coordinates err by 2^-11 a side, less than SLACK in all.
SLACK = 2e-3
CACHED_WORDS, CACHED_GRAMS = 1 << 15, 1 << 22
#: Rows of a side multiplied at once, pairs whose remaining coordinates are fetched at once, and n-grams of held vectors that a worker keeps.
ROWS, PAIRS, KEPT = 1 << 9, 1 << 12, 1 << 22


def _counted(numbers: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in any order and how often each occurs, without sorting; `last` has a place for each number, of any content."""
    at = np.arange(len(numbers), dtype=last.dtype)
    last[numbers] = at
    owner = last[numbers]
    own = owner == at
    return numbers[own], np.bincount(owner, minlength=len(numbers))[own]


class _Weights:
    """TF-IDF vectors over the n-grams of the training texts, and their coordinates in two orthonormal bases: of ASCII n-grams and of others."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray, sizes: tuple[int, ...]) -> None:
        self.hashes, self.sizes = hashes, sizes
        # N-grams are numbered by frequency, so that the frequent ones' places lie close to each other.
        order = np.argsort(idf, kind="stable")
        self.number = np.zeros(len(hashes), dtype=np.int32)
        self.number[order] = np.arange(len(hashes), dtype=np.int32)
        self.idf = idf[order]
        self.script = (hashes[order] & np.uint64(1)).astype(np.int8)
        self.slots = [np.full(len(hashes), -1, dtype=np.int32)] * 2
        self.bases = [np.zeros((0, 0), dtype=np.float32)] * 2
        self._clear()
        self.last = np.zeros(len(hashes), dtype=np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "grams": [], "sums": None, "summed": 0, "cached": 0, "last": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"last": np.zeros(len(state["hashes"]), dtype=np.int32)}

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.grams: list[np.ndarray] = []
        self.sums, self.summed, self.cached = None, 0, 0

    def words(self, text: str) -> list[int]:
        """The cache's numbers of the text's words."""
        listed = text.split()
        if len(self.cache) + len(listed) > CACHED_WORDS or self.cached > CACHED_GRAMS:
            self._clear()
        out = list(map(self.cache.get, listed))
        if None not in out:
            return out
        for w in listed:
            if w not in self.cache:
                h = np.sort(_word_grams(w, self.sizes))
                at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
                at = self.number[at[self.hashes[at] == h]] if len(self.hashes) else at[:0]
                self.cache[w] = len(self.grams)
                self.grams.append(at)
                self.cached += len(at)
        return list(map(self.cache.get, listed))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, weights of length 1)."""
        return self._vector(self.words(text))[:2]

    def _vector(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        u, c = _counted(np.concatenate([self.grams[i] for i in ids]) if ids else np.zeros(0, np.int64), self.last)
        w = c * self.idf[u]
        norm = np.sqrt((w * w).sum()) or 1.0
        return u, w / norm, norm

    def coordinates(self, text: str) -> list[np.ndarray | None]:
        """For each script the coordinates in its basis, then the length outside; none if the text has no n-gram of it."""
        ids = self.words(text)
        u, w, norm = self._vector(ids)
        if self.sums is None or len(self.sums[0]) < len(self.grams):
            self.summed, rows = 0, max(CACHED_WORDS, len(self.grams))
            self.sums = [np.zeros((rows, b.shape[1]), dtype=np.float32) for b in self.bases]
            self.has = np.zeros((2, rows), dtype=bool)
        for i in range(self.summed, len(self.grams)):
            for s, (slot, basis) in enumerate(zip(self.slots, self.bases)):
                at = self.grams[i]
                at = at[slot[at] >= 0]
                if len(at):
                    self.has[s, i] = True
                    for p in range(0, len(at), 64):  # fetched in parts that stay in the cache
                        part = at[p : p + 64]
                        self.sums[s][i] += self.idf[part].astype(np.float32) @ basis[slot[part]]
        self.summed = len(self.grams)
        ids, other, squares, out = np.array(ids, dtype=np.int64), self.script[u], w * w, []
        whole, apart = float(squares.sum()), float(squares @ other)
        for s, square in enumerate((whole - apart if not other.all() else 0.0, apart)):
            z = self.sums[s][ids[self.has[s, ids]]].sum(axis=0) / np.float32(norm)
            out.append(np.append(z, np.float32(np.sqrt(max(0.0, square - float((z * z).sum()))))) if square > 0 else None)
        return out

    def fit(self, script: int, texts: list[str]) -> None:
        """The main directions of some training texts within their heaviest n-grams of a script; any orthonormal basis gives a right bound."""
        vectors = [(u[own], w[own]) for u, w in map(self.vector, texts) for own in [self.script[u] == script]]
        energy = np.zeros(len(self.hashes))
        for u, w in vectors:
            energy[u] += w * w
        top = np.argsort(-energy, kind="stable")[:FEATURES]
        top = top[energy[top] > 0]
        if not len(top):
            return
        slot = np.full(len(self.hashes), -1, dtype=np.int32)
        slot[top] = np.arange(len(top))

        def parts() -> Iterator[tuple[int, np.ndarray]]:
            """The texts' weights in a few n-grams after the other, which takes less memory."""
            for f in range(0, len(top), 2048):
                x = np.zeros((len(vectors), min(2048, len(top) - f)), dtype=np.float32)
                for i, (u, w) in enumerate(vectors):
                    at = slot[u] - f
                    ok = (at >= 0) & (at < x.shape[1])
                    x[i, at[ok]] = w[ok]
                yield f, x

        values, directions = np.linalg.eigh(sum(x @ x.T for _, x in parts()).astype(np.float64))
        keep = np.flatnonzero(values > 1e-4 * values.max(initial=0))[::-1][:DIMENSIONS]
        directions = (directions[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        basis = np.concatenate([x.T @ directions for _, x in parts()])
        gram = sum(part.T @ part for f in range(0, len(top), 2048) for part in [basis[f : f + 2048].astype(np.float64)])
        self.bases[script] = basis @ np.linalg.inv(np.linalg.cholesky(gram)).T.astype(np.float32)
        self.slots[script] = slot
        self._clear()


def _places(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like `np.nonzero` of a matrix, for few true elements."""
    flat = m.reshape(-1)
    n = len(flat) // 8 * 8
    at = np.flatnonzero(flat[:n].view(np.uint64))
    at = (at[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.concatenate([at[flat[at]], n + np.flatnonzero(flat[n:])])
    return np.divmod(at, m.shape[1])


class _Side:
    """Coordinates of texts: `short` per main script, for bounds on all pairs, and the whole ones."""

    def __init__(self, z: list[list[bytes | None]]) -> None:
        self.z = []
        for own in z:
            there = [v for v in own if v is not None]
            m = np.zeros((len(own), len(there[0]) // 2 if there else 1), dtype=np.float32)
            if there:
                m[[v is not None for v in own]] = np.frombuffer(b"".join(there), dtype=np.float16).reshape(len(there), -1)
            self.z.append(m)
        squares = [(m * m).sum(axis=1) for m in self.z]
        lengths = np.sqrt(np.stack(squares, axis=1))
        self.there = lengths > 0
        main = squares[1] > squares[0]
        self.rows = [np.flatnonzero(main == s) for s in (False, True)]
        self.lengths = [lengths[r] for r in self.rows]
        self.short = []
        for s, r in enumerate(self.rows):
            m = self.z[s][r]
            self.short.append(np.concatenate([m[:, :-1][:, :FIRST], np.sqrt((m[:, :-1][:, FIRST:] ** 2).sum(axis=1, keepdims=True) + m[:, -1:] ** 2), lengths[r, 1 - s : 2 - s]], axis=1))

    def near(self, other: _Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of both sides that the bounds leave."""
        for s in range(2):
            for t in range(2):
                # Of texts of different main scripts only the lengths are compared at first.
                left, right = (self.short[s], other.short[s]) if s == t else (self.lengths[s], other.lengths[t])
                for f in range(0, len(left), ROWS):
                    for g in range(0, len(right), ROWS):
                        i, j = _places(left[f : f + ROWS] @ right[g : g + ROWS].T >= least)
                        i, j = self.rows[s][f + i], other.rows[t][g + j]
                        for p in range(0, len(i), PAIRS):
                            a, b = i[p : p + PAIRS], j[p : p + PAIRS]
                            most = np.zeros(len(a), dtype=np.float32)
                            for k in range(2):
                                both = np.flatnonzero(self.there[a, k] & other.there[b, k])
                                if len(both):
                                    most[both] += np.einsum("ij,ij->i", self.z[k][a[both]], other.z[k][b[both]])
                            ok = most >= least
                            yield a[ok], b[ok]


def tfidf_join(held: DataFrame, train: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (3, 4, 5), least: float = 0.75, k: int = 5, block: int = 1 << 14) -> DataFrame:
    """(held, train, cosine, rank): for each held row the k training rows with the largest cosine of at least `least`.

    The vectors are TF-IDF of character n-grams inside word borders, in lower case; frequencies are those of
    all `train` rows, n-grams that these lack don't count. Ties go by key. The result is exact: for x = Px + r
    with a projection P, the product of two vectors of length 1 is at most Px.Py + |r||s|. There is a projection
    for the n-grams in ASCII and one for the others, and the product is the sum of both. Pairs that this bound
    leaves under `least` are dropped, first by the first coordinates, then by all; the others are computed. All
    pairs of different texts go through the first bound, as a product of dense matrices: held texts in blocks to
    all tasks, training texts in batches. So the work grows with the product of both sides.
    """
    sc = held.sparkSession.sparkContext

    def side(df: DataFrame) -> DataFrame:
        t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
        return df.select(F.col(key).alias("id"), t.alias("t")).withColumn("class", F.xxhash64("t"))

    # The texts are written once each; the keys, without texts, apart from them.
    a, b = (cut_lineage(side(df).select("id", "class").dropDuplicates(["id"])) for df in (held, train))
    size = b.count()
    once = lambda df, ids: side(df).filter("t <> ''").groupBy("class").agg(F.first("t").alias("t")).join(ids.groupBy("class").agg(F.count("*").alias("n")), "class")
    ha, hb = stored(once(held, a)), stored(once(train, b))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[int, int] = {}
        own: dict[str, np.ndarray] = {}
        total, last = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        for batch in batches:
            for t, n in zip(batch.column("t").to_pylist(), batch.column("n").to_pylist()):
                if len(own) > CACHED_WORDS:
                    own.clear()
                words = set(t.split())
                for w in words:
                    if w not in own:
                        own[w] = np.array([number.setdefault(h, len(number)) for h in _word_grams(w, sizes).tolist()], dtype=np.int64)
                if len(number) > len(total):
                    total = np.concatenate([total, np.zeros(len(number), dtype=np.int64)])
                    last = np.zeros(len(total), dtype=np.int64)
                total[_counted(np.concatenate([own[w] for w in words]), last)[0]] += n
        h = np.array(list(number), dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(total[: len(h)])], ["h", "n"])

    counted = hb.select("t", "n").mapInArrow(frequencies, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    h = counted["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    weights = _Weights(h[order], np.log((1.0 + size) / (1.0 + counted["n"].to_numpy(dtype=np.float64)[order])) + 1, sizes)
    other = F.octet_length("t") >= 1.25 * F.length("t")
    for script, last in enumerate((other, ~other)):
        weights.fit(script, [r.t for r in hb.orderBy(last, F.xxhash64(F.lit(7), "t")).limit(FITTED).select("t").collect()])
    shared = sc.broadcast(weights)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            z = [[None if v is None else v.astype(np.float16).tobytes() for v in own.coordinates(t)] for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("t"), *(pa.array([v[s] for v in z], pa.binary()) for s in range(2))], ["class", "t", "z0", "z1"])

    left, right = (stored(df.select("class", "t").mapInArrow(project, "class long, t string, z0 binary, z1 binary")) for df in (ha, hb))

    parts: list[DataFrame] = []
    rows: list = []

    def close() -> None:
        # What a worker makes of a block stays in the dictionary until it gets another block.
        taken = sc.broadcast(({}, np.array([r[0] for r in rows], dtype=np.int64), [r[1] for r in rows], [[None if r[s] is None else bytes(r[s]) for r in rows] for s in (2, 3)]))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            made, ids, texts, z = taken.value
            if not made:
                made |= {"side": _Side(z), "vectors": {}, "n": 0}
            x, vectors = made["side"], made["vectors"]
            dense = np.zeros(len(own.hashes))
            for batch in batches:
                y = _Side([batch.column(c).to_pylist() for c in ("z0", "z1")])
                found = [np.zeros((2, 0), dtype=np.int64), *map(np.stack, x.near(y, least - SLACK))]
                i, j = np.concatenate(found, axis=1)
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                cosine, now, at = np.zeros(len(i)), -1, np.zeros(0, dtype=np.int64)
                for p, (held_row, train_row) in enumerate(zip(i.tolist(), j.tolist())):
                    if train_row != now:
                        dense[at] = 0
                        at, weight = own.vector(batch.column("t")[train_row].as_py())
                        dense[at], now = weight, train_row
                    if held_row not in vectors:
                        if made["n"] > KEPT:
                            vectors.clear()
                            made["n"] = 0
                        vectors[held_row] = own.vector(texts[held_row])
                        made["n"] += len(vectors[held_row][0])
                    u, w = vectors[held_row]
                    cosine[p] = (w * dense[u]).sum()
                dense[at] = 0
                ok = cosine >= least - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[ok]]), pa.array(batch.column("class").to_numpy()[j[ok]]), pa.array(cosine[ok])], ["a", "b", "cosine"])

        parts.append(right.mapInArrow(compare, "a long, b long, cosine double"))
        rows.clear()

    for r in left.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            close()
    if rows or not parts:
        close()
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    # Of a text that many training rows have, k are enough.
    few = b.withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("_r") <= k).select(F.col("class").alias("b"), F.col("id").alias("train"))
    order_by = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "train")
    best = near.join(few, "b").withColumn("rank", F.row_number().over(order_by)).filter(F.col("rank") <= k)
    return best.join(a.select(F.col("class").alias("a"), F.col("id").alias("held")), "a").select("held", "train", "cosine", "rank")
