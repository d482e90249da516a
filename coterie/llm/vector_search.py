"""Approximate nearest neighbours by cosine: anisotropic product quantisation, table scans, exact rerank.

Vectors are scaled to length one, so cosine is an inner product.  A bounded sample (``SAMPLE`` rows and
``SAMPLE_NUMBERS`` numbers at most, evenly by hash) fits coarse centres and four-bit codebooks for what
the centres leave.  The codebooks minimise a score-aware loss: for a residual r of x, |r|^2 +
(eta - 1) (r.x)^2, which counts the part parallel to x, the part that moves high inner products, eta
times.  Codes are found by coordinate descent over subspaces, codebooks by solving the joint normal
equations.

Every valid row is indexed: its nearest centre and its codes, two subspaces to a byte.  The number of
lists grows with the root of the rows.  A query scans the lists of its nearest centres; how many is
calibrated on the sample, so that ``COVERED`` of true neighbours lie in the lists scanned.  A scan adds
one table entry per byte for a block of rows and many queries at once, the best of the block
(``SHORTLIST`` of all lists of a query) are scored exactly on the original vectors in double precision, and the block's best k go on to
the query's final ranking.  Queries travel to the blocks of their lists, sorted behind the block's rows,
and stream past them; only beyond ``BLOCK_QUERIES`` queries of a list is a block of rows copied, so that
neither a frequent vector nor a growing query set lands in one task.  No pair but the shortlist is made.

Vectors are compared with those of their own length, as a cosine needs; a length with up to ``SMALL``
rows is one list that is scored exactly, so no length is left out.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id.  A query leaves out its own row only: rows that repeat its id are candidates.  Repeated
rows (one id, one vector) are one query; rows with one id and different vectors are queries each, with
ranks of their own.  Components are scaled by a power of two before squares are summed, which changes no
result and keeps the largest and smallest from overflow.  Ties go to the smaller id.  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import materialize
from coterie.llm.common import small_batches

SAMPLE, SAMPLE_NUMBERS, SAMPLE_PER_LIST = 65_536, 16_000_000, 64
LISTS = 4_096
SMALL = 4_096
#: Rows of a query that are scored exactly: in all its lists together, and in one at least.
SHORTLIST, LEAST = 768, 24
COVERED = 0.97
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 65_536
#: Numbers of a block's scan held at once.
AT_ONCE = 4_000_000
#: Lists with this many entries at most are sent to all tasks.
MOST_SENT = 100_000
THRESHOLD = 0.6
SUB = 2


def valid_vectors(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``vec_id, v`` (as it came) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(~bad).where(F.exists("v", lambda x: x != 0))


class Quantiser:
    """Coarse centres and anisotropic four-bit codebooks, fitted to unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 4):
        n, self.dim = sample.shape
        rng = np.random.default_rng(seed)
        self.parts = -(-self.dim // SUB)
        self.parts += self.parts % 2
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.centres = sample[rng.permutation(n)[:lists]].copy()
        for _ in range(8 if lists > 1 else 1):
            near = self.nearest(sample)
            size = np.bincount(near, minlength=len(self.centres))
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, sample)
            self.centres[size > 0] = sums[size > 0] / size[size > 0, None]
        rest = self._padded(sample - self.centres[self.nearest(sample)])
        self.books = np.stack(
            [rest[rng.choice(n, 16, replace=n < 16), m * SUB : (m + 1) * SUB] for m in range(self.parts)]
        ) if n else np.zeros((self.parts, 16, SUB))
        for i in range(rounds):
            codes = self._codes(sample, rest, 1 if i else 0)
            self._solve(self._padded(sample), rest, codes)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * SUB - self.dim)))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 2 * x @ self.centres.T - (self.centres**2).sum(1)

    def _codes(self, x: np.ndarray, rest: np.ndarray, sweeps: int) -> np.ndarray:
        x = self._padded(x)
        cut = lambda a, m: a[:, m * SUB : (m + 1) * SUB]
        codes = np.stack(
            [((cut(rest, m)[:, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)], axis=1
        ) if len(x) else np.zeros((0, self.parts), int)
        along = ((rest - self._decoded(codes)) * x).sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                inner = cut(x, m) @ self.books[m].T
                base = along + inner[np.arange(len(x)), codes[:, m]]
                loss = ((cut(rest, m)[:, None] - self.books[m]) ** 2).sum(2) + (self.eta - 1) * (base[:, None] - inner) ** 2
                codes[:, m] = loss.argmin(1)
                along = base - inner[np.arange(len(x)), codes[:, m]]
        return codes

    def _decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.parts), codes].reshape(len(codes), -1)

    def _solve(self, x: np.ndarray, rest: np.ndarray, codes: np.ndarray) -> None:
        size = self.parts * 16 * SUB
        a, b = np.eye(size) * 1e-3, self.books.reshape(-1) * 1e-3
        lanes = (np.arange(self.parts) * 16)[None, :, None] * SUB + np.arange(SUB)
        for i in range(0, len(x), 2048):
            at = (codes[i : i + 2048, :, None] * SUB + lanes).reshape(-1, self.parts * SUB)
            rows = np.arange(len(at))[:, None]
            z = np.zeros((len(at), size))
            z[rows, at] = x[i : i + 2048]
            a += (self.eta - 1) * z.T @ z
            b += (self.eta - 1) * z.T @ (rest[i : i + 2048] * x[i : i + 2048]).sum(1)
            np.add.at(a, (at.ravel(), at.ravel()), 1.0)
            np.add.at(b, at.ravel(), rest[i : i + 2048].ravel())
        self.books = np.linalg.solve(a, b).reshape(self.parts, 16, SUB)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre and packed codes, two subspaces to a byte."""
        near = self.nearest(x)
        codes = self._codes(x, self._padded(x - self.centres[near]), 2).astype(np.uint8)
        return near, codes[:, 0::2] << 4 | codes[:, 1::2]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (less the centre's) of unit queries (rows) with packed rows (columns)."""
        q = np.pad(queries, ((0, 0), (0, self.parts * SUB - self.dim))).reshape(len(queries), self.parts, SUB)
        table = np.einsum("mkd,cmd->mkc", self.books, q).astype(np.float32)
        out = np.zeros((len(packed), len(queries)), np.float32)
        for j in range(packed.shape[1]):
            both = (table[2 * j][:, None] + table[2 * j + 1][None]).reshape(256, -1)
            out += both[packed[:, j]]
        return out.T


def best_of(approx: np.ndarray, most: int) -> np.ndarray:
    """For each row the columns of its ``most`` largest values, ascending; ties go to the first columns."""
    n = approx.shape[1]
    if n <= most:
        return np.broadcast_to(np.arange(n), approx.shape)
    bits = np.ascontiguousarray(approx).view(np.int32)
    order = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int64) << 24  # floats in order, as integers
    return np.sort(np.argpartition(-(order + (n - 1 - np.arange(n))), most - 1, axis=1)[:, :most], axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def probes_needed(q: Quantiser, sample: np.ndarray, k: int, covered: float = COVERED, queries: int = 256) -> int:
    """Lists to scan so that ``covered`` of true neighbours within the sample lie in them."""
    if len(q.centres) == 1 or len(sample) <= k:
        return len(q.centres)
    some = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)]
    sims = some @ sample.T
    top = np.argpartition(-sims, k, axis=1)[:, : k + 1]
    lists = q.nearest(sample)[top]
    rank = np.argsort(np.argsort(-q.scores(some), axis=1), axis=1)
    need = np.take_along_axis(rank, lists, axis=1).ravel() + 1
    return int(min(len(q.centres), np.quantile(need, covered) + 1))


class Block:
    """Rows of one list, in order of id."""

    def __init__(self, model: Quantiser | None, most: int, uid: np.ndarray, vec_id: np.ndarray, codes: list[bytes], v: np.ndarray):
        order = np.lexsort((uid, vec_id))
        self.model, self.most, self.uid, self.vec_id, self.v = model, most, uid[order], vec_id[order], scaled(v[order])
        self.packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(uid), -1)[order] if model else None
        self.norm = np.sqrt((self.v * self.v).sum(1))
        self.by_uid = np.argsort(self.uid)

    def search(self, uid: np.ndarray, v: np.ndarray, k: int):
        """(query's place, row's id, score) of the k nearest rows of each query."""
        n, out = len(self.uid), []
        some = min(n, self.most) if self.model else n
        step = max(1, min(AT_ONCE // n, AT_ONCE // (some * v.shape[1])))
        for i in range(0, len(uid), step):
            q = scaled(v[i : i + step])
            at = self.by_uid[np.minimum(np.searchsorted(self.uid, uid[i : i + step], sorter=self.by_uid), n - 1)]
            own = np.where(self.uid[at] == uid[i : i + step], at, -1)
            here = np.arange(len(q))
            if self.model and n > some:
                approx = self.model.scan(unit(q), self.packed)
                approx[here[own >= 0], own[own >= 0]] = -np.inf
            else:
                approx = np.zeros((len(q), n), np.float32)
            picked = best_of(approx, some)
            exact = (self.v[picked] * q[:, None]).sum(2) / (self.norm[picked] * np.sqrt((q * q).sum(1))[:, None])
            exact[picked == own[:, None]] = -np.inf
            best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(exact, best, 1)
            rows = np.take_along_axis(picked, best, 1)
            ok = score > -np.inf
            out.append((np.broadcast_to(here[:, None] + i, score.shape)[ok], self.vec_id[rows[ok]], score[ok]))
        return [np.concatenate(x) for x in zip(*out)]


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dim)


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides, its ``k`` nearest found."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = table.sparkSession
    small_batches(spark, 4096)
    valid = valid_vectors(table, id_col, vector)
    models: dict[int, tuple[Quantiser, int]] = {}
    for r in valid.groupBy(F.size("v").alias("d")).count().where(F.col("count") > SMALL).collect():  # lengths, not rows
        dim, total = r["d"], r["count"]
        lists = int(min(LISTS, np.sqrt(total) / 2, max(1, SAMPLE_NUMBERS // dim // 32)))
        most = int(min(SAMPLE, total, max(SMALL, SAMPLE_PER_LIST * lists), max(64, SAMPLE_NUMBERS // dim)))
        share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, 1.1 * most / total) * (1 << 30)) + 1
        picked = valid.where((F.size("v") == dim) & share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
        sample = unit(np.array([x["v"] for x in picked.select("v").collect()], float).reshape(-1, dim))
        sample = np.unique(sample, axis=0)  # a frequent vector would draw all centres and codes to itself
        if len(sample) > 16:
            model = Quantiser(sample, min(lists, len(sample) // 4))
            models[dim] = model, probes_needed(model, sample, k)
    held = spark.sparkContext.broadcast(models)

    def by_length(b, column):
        sizes = b.column(column).value_lengths()
        for d in pc.unique(sizes).to_pylist():
            yield d, b.filter(pc.equal(sizes, d))

    def index(batches):
        for b in batches:
            for d, part in by_length(b, 2):
                near, codes = np.zeros(part.num_rows, np.int32), [b""] * part.num_rows
                if d in held.value:
                    near, packed = held.value[d][0].encode(unit(_matrix(part.column(2), d)))
                    codes = [x.tobytes() for x in packed]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([d] * part.num_rows, pa.int32()), pa.array(near.astype(np.int32)), pa.array(codes, pa.binary()), part.column(2)],
                    names=["uid", "vec_id", "d", "list", "codes", "v"],
                )

    def ask(batches):
        for b in batches:
            for d, part in by_length(b, 2):
                lists = [[0]] * part.num_rows
                if d in held.value:
                    model, probes = held.value[d]
                    order = np.argsort(-model.scores(unit(_matrix(part.column(2), d))), axis=1, kind="stable")
                    short = (np.cumsum(sizes[d][order], axis=1) <= k).sum(1) + 1  # more lists where these hold too few rows
                    lists = [o[: max(probes, m)] for o, m in zip(order.tolist(), short.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([d] * part.num_rows, pa.int32()), part.column(2), pa.array(lists, pa.list_(pa.int32()))],
                    names=["uid", "vec_id", "d", "v", "lists"],
                )

    kind = valid.schema["v"].dataType.simpleString()
    numbered = valid.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v")
    indexed = materialize(numbered.mapInArrow(index, f"uid bigint, vec_id bigint, d int, list int, codes binary, v {kind}"))
    sizes = {d: np.zeros(len(m.centres), np.int64) for d, (m, _) in models.items()}
    for r in indexed.where("codes != X''").groupBy("d", "list").count().collect():  # the lists of fitted lengths
        sizes[r["d"]][r["list"]] = r["count"]
    queries = indexed.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.min("uid").alias("uid")).select("uid", "vec_id", "v")
    asked = materialize(queries.mapInArrow(ask, f"uid bigint, vec_id bigint, d int, v {kind}, lists array<int>"))
    asked = asked.withColumn("list", F.explode("lists")).drop("lists")
    blocks = indexed.groupBy("d", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("n_row"))
    qblocks = asked.groupBy("d", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("long").alias("n_query"))
    deal = materialize(blocks.join(qblocks, ["d", "list"]))  # one row per list
    if deal.limit(MOST_SENT + 1).count() <= MOST_SENT:
        deal = F.broadcast(deal)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ["d", "list", "rb", "qb"]
    rows = indexed.join(deal, ["d", "list"]).select("d", "list", F.pmod(F.xxhash64("uid"), "n_row").alias("rb"), upto("n_query").alias("qb"), F.lit(0).alias("ask"), "uid", "vec_id", "codes", "v")
    questions = asked.join(deal, ["d", "list"]).select("d", "list", upto("n_row").alias("rb"), F.pmod(F.xxhash64("uid"), "n_query").alias("qb"), F.lit(1).alias("ask"), "uid", "vec_id", F.lit(None).cast("binary").alias("codes"), "v")

    def search(batches):
        names = ["query", "query_id", "vec_id", "score"]
        parts: list = []
        at = block = None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(5)]) if b.num_rows else np.zeros((5, 0))
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                own, part = tuple(keys[:4, lo].tolist()), b.slice(lo, hi - lo)
                if own != at:
                    at, parts, block = own, [], None
                if keys[4, lo] == 0:
                    parts.append(part)
                    continue
                if block is None and parts:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    d = own[0]
                    model, probes = held.value.get(d, (None, 1))
                    block = Block(model, max(LEAST, SHORTLIST // probes), t.column("uid").to_numpy(), t.column("vec_id").to_numpy(), t.column("codes").to_pylist(), _matrix(t.column("v").combine_chunks(), d))
                    parts = []
                if block is None:
                    continue
                query, found, score = block.search(part.column(5).to_numpy(), _matrix(part.column(8), own[0]), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(5).take(pa.array(query)), part.column(6).take(pa.array(query)), pa.array(found.astype(np.int64)), pa.array(score)], names=names
                )

    # A block's rows come first, then the queries that its list is asked by.
    dealt = rows.unionByName(questions).repartition(*key).sortWithinPartitions(*key, "ask")
    found = dealt.mapInArrow(search, "query bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


QUERY = "op4_nearest_vectors"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"))
