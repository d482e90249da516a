"""Pack token sequences: cutting-stock column generation over the histogram of lengths.

Documents become token ids (plus an end id).  Whole multiples of the sequence length are sequences of
their own.  What remains of each document, shorter than a sequence, is a piece to place:

1. The histogram of piece lengths (fewer entries than the sequence length) goes to the driver.
2. A linear program over patterns of length classes (``CLASS`` tokens wide) minimises the number of
   sequences.  Its columns are generated: the simplex multipliers price classes, an unbounded
   knapsack by dynamic programming finds the best pattern, until none improves.
3. The fractional solution is rounded to patterns of exact lengths that fill a sequence to its last
   token, taken as often as the histogram allows.  What is left over, about one token in a hundred,
   is laid end to end and cut at sequence ends; the very last, shorter sequence is split
   into powers of two, which need no padding.  So nothing is padded and few documents are cut.
4. Documents are ranked within their length (in hash buckets, so a frequent length is dealt over many
   tasks), and a document's rank alone says in which pattern, copy and place it lies.

Edge cases: a null text is empty and gives the end id alone; repeated rows are packed each; an empty
table gives an empty result; any other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.functions.storage import materialize
from coterie.llm.common import small_batches

LENGTH = 2048
END_ID = 1
CLASS = 16
BUCKET_ROWS = 4096
VOCABULARY = "word_bpe_49k.json"

# ---------------------------------------------------------------- tokens


class WordTokenizer:
    """Ids of the given BPE file, word by word with a memory of words seen.

    The file's normaliser and pre-tokenizer never join text across ASCII white space, so a text's ids
    are its words' ids.  Words of printable ASCII and Latin-1 letters are cut by the file's own
    pattern here and merged by its model; all others go through the tokenizer as it is.
    """

    # The split pattern of the vocabulary file, for lower-cased words of these letters.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.most = most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = "<u2" if max(spec["model"]["vocab"].values()) < 1 << 16 else "<u4"
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
        outer = self

        class Memory(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = np.array(outer.word(word), outer.dtype).tobytes()
                if len(self) < outer.most:
                    self[word] = ids
                return ids

        class Parts(dict):
            def __missing__(self, part: str) -> list[int]:
                text = part if part.isascii() else "".join(outer.letters[b] for b in part.encode())
                ids = [t.id for t in outer.whole.model.tokenize(text)]
                if len(self) < outer.most:
                    self[part] = ids
                return ids

        self.words, self.parts = Memory(), Parts()

    def word(self, word: bytes) -> list[int]:
        text = word.decode()
        if "<|" in text or not self.PLAIN.fullmatch(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return [i for p in self.PARTS.findall(text.lower()) for i in self.parts[p]]

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(name: str = VOCABULARY) -> WordTokenizer:
    """One per worker process; ``name`` is a file of the installed vocabularies or a path."""
    if name not in _TOKENIZERS:
        import public_tokenizers

        _TOKENIZERS[name] = WordTokenizer(name if "/" in name else str(public_tokenizers.path(name)))
    return _TOKENIZERS[name]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col, n_tokens, ids``: little-endian ids with the end id."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        ids_of = tokenizer(vocabulary)
        end = np.array([END_ID], ids_of.dtype).tobytes()
        width = np.dtype(ids_of.dtype).itemsize
        for b in batches:
            ids = [ids_of(t or b"") + end for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                names=[id_col, "n_tokens", "width", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, width int, ids binary")


# ---------------------------------------------------------------- the linear program


def best_pattern(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of classes 1..n of total n or less with the highest price."""
    n = len(prices)
    best, pick = np.zeros(n + 1), np.zeros(n + 1, int)
    for w in range(1, n + 1):
        gain = best[w - 1 :: -1] + prices[:w] if w > 1 else best[:1] + prices[:1]
        c = int(np.argmax(gain))
        best[w], pick[w] = (gain[c], c + 1) if gain[c] > best[w - 1] else (best[w - 1], 0)
    out, w = np.zeros(n, int), n
    while w > 0:
        if pick[w]:
            out[pick[w] - 1] += 1
            w -= pick[w]
        else:
            w -= 1
    return float(best[n]), out


def column_generation(demand: np.ndarray, most: int = 4000) -> list[tuple[float, np.ndarray]]:
    """Patterns with their fractional numbers: a basic solution of min sum x, sum a x = demand."""
    n = len(demand)
    columns = np.diag(n // np.arange(1, n + 1)).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(most):
        value, a = best_pattern(inverse.sum(axis=0))
        if value <= 1 + 1e-7:
            break
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * d
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        columns[:, out] = a
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
    return sorted(((float(v), columns[:, i].astype(int)) for i, v in enumerate(x) if v > 1e-9), key=lambda p: -p[0])


def exact_patterns(counts: np.ndarray, length: int = LENGTH, width: int = CLASS) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """(copies, {piece length: uses}) of patterns that fill a sequence exactly, and the counts left over.

    ``counts[l]``: pieces of length l, 0 < l < ``length``.
    """
    left = counts.astype(np.int64).copy()
    lengths = np.arange(length)
    klass = np.clip((lengths + width // 2) // width, 1, length // width)
    demand = np.bincount(klass[1:] - 1, weights=left[1:], minlength=length // width)
    done: list[tuple[int, dict[int, int]]] = []

    def take(parts: list[int], most: int) -> int:
        uses: dict[int, int] = {}
        for p in parts:
            uses[p] = uses.get(p, 0) + 1
        m = min([most, *(int(left[p]) // u for p, u in uses.items())])
        if m > 0:
            for p, u in uses.items():
                left[p] -= m * u
            done.append((m, uses))
        return m

    def last_two(rest: int, low: int, high: int, used: list[int]) -> list[int] | None:
        a = lengths[max(low, 1) : min(high, rest - 1) + 1]
        if not len(a):
            return None
        free = left.copy()
        for u in used:
            free[u] -= 1
        score = np.minimum(free[a], np.where(rest - a < length, free[np.minimum(rest - a, length - 1)], 0))
        score = np.where(2 * a == rest, free[a] // 2, score)
        i = int(np.argmax(score))
        return [int(a[i]), int(rest - a[i])] if score[i] > 0 else None

    if left.sum():
        for x, pattern in column_generation(demand):
            classes = np.repeat(np.arange(len(pattern), 0, -1), pattern[::-1]).tolist()
            if len(classes) < 2:
                continue
            want = int(np.ceil(x))
            while want > 0:
                head: list[int] = []
                for c in classes[:-2]:
                    own = np.flatnonzero(klass == c)
                    own = own[own > 0]
                    free = left[own] - np.array([head.count(int(o)) for o in own])
                    if free.max() <= 0:
                        break
                    head.append(int(own[np.argmax(free)]))
                if len(head) < len(classes) - 2 or sum(head) >= length:
                    break
                tail = last_two(length - sum(head), (classes[-2] - 1) * width, (classes[-2] + 1) * width, head)
                got = take(head + tail, want) if tail else 0
                if not got:
                    break
                want -= got
    # What rounding left: the longest piece with one, then two, then three others that fill it up.
    for l in range(length - 1, 0, -1):
        while left[l] > 0:
            parts = [l, length - l]
            if take(parts, 1 << 62):
                continue
            tail = last_two(length - l, 1, length - l - 1, [l]) if length - l > 1 else None
            if tail and take([l, *tail], 1 << 62):
                continue
            found = 0
            for c in np.flatnonzero(left[1 : max(length - l - 1, 1)])[::-1][:24] + 1:
                tail = last_two(length - l - int(c), 1, length - l - int(c) - 1, [l, int(c)])
                if tail and (found := take([l, int(c), *tail], 1 << 62)):
                    break
            if not found:
                break
    return done, left


def placement(counts: np.ndarray, length: int = LENGTH):
    """The whole plan as small tables.

    ``slots``: (piece length, first rank, ranks, uses, first sequence, offset) of the exact patterns;
    ``stream``: (piece length, first rank, place in the stream) of the rest; ``tails``: starts of the
    parts of the stream's last, incomplete sequence; and the numbers of sequences.
    """
    done, left = exact_patterns(counts, length)
    slots, sequence = [], 0
    used = np.zeros(length, np.int64)
    for m, uses in done:
        offset = 0
        for p, u in sorted(uses.items(), reverse=True):
            slots.append((p, int(used[p]), m * u, u, sequence, offset))
            used[p] += m * u
            offset += p * u
        sequence += m
    stream, at = [], 0
    for p in range(length - 1, 0, -1):
        if left[p]:
            stream.append((p, int(used[p]), at))
            at += p * int(left[p])
    full = at // length
    tails, place = [], full * length
    for k in range(length.bit_length() - 1, -1, -1):
        if (at % length) >> k & 1:
            tails.append(place)
            place += 1 << k
    return slots, stream, tails, sequence, full, full + len(tails)


# ---------------------------------------------------------------- the operator


def _ranked(rows: DataFrame, group: list[str], buckets: int, value: str | None = None) -> DataFrame:
    """``rows`` (with ``uid``) and ``rank``: a running number (or sum of ``value`` before the row) within ``group``."""
    amount = F.col(value) if value else F.lit(1).cast("long")
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("uid"), F.lit(buckets))).withColumn("__x", amount)
    sums = rows.groupBy(*group, "__b").agg(F.sum("__x").alias("__s"))
    along = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(*group, "__b", F.coalesce(F.sum("__s").over(along), F.lit(0)).alias("__first"))
    here = Window.partitionBy(*group, "__b").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__place", F.coalesce(F.sum("__x").over(here), F.lit(0)))
    return rows.join(firsts, [*group, "__b"]).withColumn("rank", F.col("__first") + F.col("__place")).drop("__b", "__x", "__first", "__place")


def assign(spark: SparkSession, sizes: DataFrame, length: int = LENGTH) -> DataFrame:
    """``uid, n_full, full_seq, pieces`` from ``uid, n_tokens``; pieces: (start, length, sequence_id, offset) of the remainder."""
    rows = sizes.select(
        "uid", F.floor(F.col("n_tokens") / length).cast("long").alias("n_full"), F.pmod("n_tokens", F.lit(length)).cast("int").alias("rem")
    )
    counts = np.zeros(length, np.int64)
    for r in rows.groupBy("rem").count().collect():  # one row per length, fewer than ``length``
        counts[r["rem"]] = r["count"]
    total = int(counts.sum())
    counts[0] = 0
    slots, stream, tails, n_pattern, n_stream, n_rest = placement(counts, length)
    slot_rows = spark.createDataFrame(
        [(p, a, a + n, u, s, o, None) for p, a, n, u, s, o in slots] + [(p, a, 1 << 62, 1, 0, 0, at) for p, a, at in stream],
        "rem int, r0 bigint, r1 bigint, uses bigint, seq bigint, off bigint, at bigint",
    )
    ranked = _ranked(rows.where("rem > 0").select("uid", "rem"), ["rem"], max(1, -(-int(counts.max()) // BUCKET_ROWS)))
    s = slot_rows.withColumnRenamed("rem", "__l")
    # A few thousand rows, however many documents there are: one per pattern and length.
    placed = ranked.join(F.broadcast(s), (F.col("rem") == F.col("__l")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    q = F.col("rank") - F.col("r0")
    rem = F.col("rem").cast("long")
    by_pattern = F.array(F.struct(
        F.lit(0).cast("long").alias("start"), rem.alias("length"),
        (F.col("seq") + F.floor(q / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("off") + F.pmod(q, F.col("uses")) * rem).cast("long").alias("offset"),
    ))
    begin = F.col("at") + q * rem
    ends = F.array(
        F.when(F.floor(begin / length) < n_stream, (F.floor(begin / length) + 1) * length).cast("long"),
        *[F.lit(t).cast("long") for t in tails],
    )
    inner = F.array_sort(F.array_distinct(F.filter(ends, lambda x: x.isNotNull() & (x > begin) & (x < begin + rem))))
    cuts = F.concat(F.array(begin), inner)
    stops = F.concat(inner, F.array(begin + rem))
    tail_starts = F.array(*[F.lit(t).cast("long") for t in tails]) if tails else F.array().cast("array<bigint>")

    def piece(a, b):
        k = F.size(F.filter(tail_starts, lambda t: t <= a))
        in_full = a < n_stream * length
        seq = F.when(in_full, F.floor(a / length)).otherwise(F.lit(n_stream) + k - 1).cast("long") + n_pattern
        off = F.when(in_full, F.pmod(a, F.lit(length))).otherwise(a - F.coalesce(F.get(tail_starts, k - 1), F.lit(0)))
        return F.struct((a - begin).cast("long").alias("start"), (b - a).cast("long").alias("length"), seq.alias("sequence_id"), off.cast("long").alias("offset"))

    by_stream = F.zip_with(cuts, stops, piece)
    kind = "array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"
    small = placed.select("uid", F.when(F.col("at").isNull(), by_pattern).otherwise(by_stream).cast(kind).alias("pieces"))
    whole = _ranked(rows.where("n_full > 0").select("uid", "n_full"), [], max(1, -(-total // 65536)), "n_full")
    whole = whole.select("uid", (F.col("rank") + n_pattern + n_rest).alias("full_seq"))
    return rows.select("uid", "n_full").join(small, "uid", "left").join(whole, "uid", "left")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: ``id_col, start, length, ids (binary), width, doc_tokens, sequence_id, offset``."""
    import pyarrow as pa

    tokens = materialize(tokenize(docs, id_col, text, vocabulary).withColumn("uid", F.monotonically_increasing_id()))
    plan = assign(docs.sparkSession, tokens.select("uid", "n_tokens"))
    joined = tokens.join(plan, "uid").select(F.col(id_col), "n_tokens", "width", "ids", "n_full", "full_seq", "pieces")

    def run(batches):
        for b in batches:
            which, out = [], []
            for i, (n, w, ids, full, first, pieces) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 7)))):
                parts = [(LENGTH * j, LENGTH, first + j, 0) for j in range(full)]
                parts += [(LENGTH * full + p["start"], p["length"], p["sequence_id"], p["offset"]) for p in pieces or ()]
                for a, m, s, o in parts:
                    which.append(i)
                    out.append((a, m, ids[a * w : (a + m) * w], w, n, s, o))
            for i in range(0, len(out), 4096):
                cols = list(zip(*out[i : i + 4096]))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which[i : i + 4096])), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    names=[id_col, "start", "length", "ids", "width", "doc_tokens", "sequence_id", "offset"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(
        run, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, width int, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def pack_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64()), b.column(5), b.column(6), b.column(7)],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return pack(docs, id_col, text, vocabulary).mapInArrow(
        run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


QUERY = "op8_packing"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return pack_digest(table(spark, sf_dir, "documents"))
