"""Exact removal of repeated byte strings, by suffix order and longest previous factors.

A byte is removed when it is covered by a string of ``LENGTH`` bytes that also starts elsewhere, in
any text.  With ``keep="first"`` a string's first place (by document id, then offset) stays and later
ones go; with ``keep="none"`` all places go.

How a global suffix order is had without one machine that holds it:

1. Equal texts are one row (by the MD5 of their bytes), stored in buckets of that key.
2. The starts of all ``LENGTH``-byte windows of a text are cut into segments that share a minimizer,
   the smallest hash of a window's ``GRAM``-byte substrings.  Equal windows have equal minimizers, so
   the minimizer deals windows to tasks by content.  Minimizers seen once need no further look.
3. The strings of the remaining segments (window starts plus the bytes they reach) are fetched from
   the stored texts.  Equal strings are one row.  A minimizer with a single string that cannot repeat
   itself is decided by its count.
4. The others are put in suffix order, truncated at ``LENGTH``, with the common prefixes of
   neighbours.  For every window start, the nearest places before and after it in that order that
   hold smaller positions (previous and next smaller value) bound its longest previous factor: the
   larger of the two least common prefixes on the way.  A window repeats an earlier one when that
   factor reaches ``LENGTH``; a later one when the array for larger positions does.
5. A minimizer whose different strings exceed ``HOT_BYTES`` (a passage a little shorter than the
   window in very many contexts) is split further: its windows are dealt by their own MD5, and a
   window's first place is the least of its hash.  Exact too, and no group is held by one task.

Joins are sort-merge by hint: texts are far larger in memory than on disk, and their table is bucketed
by the join key, so that side is not shuffled.

Edge cases: null texts are empty; texts shorter than ``LENGTH`` bytes lose nothing; equal rows are
copies of each other; a null id counts as the last; very long texts are hashed in pieces of ``PIECE``
bytes; an empty table gives an empty result; other columns are not read (``remove_repeats`` carries
them under numbers, so names cannot clash).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.storage import bucketed, free_shuffles, materialize, release
from coterie.llm.common import small_batches

LENGTH = 200
GRAM = 64
HOT_BYTES = 300_000
#: Bytes of one text that are hashed at once, and window starts that are sorted at once.
PIECE = 2_000_000
SORTED_AT_ONCE = 60_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = 0xD6E8FEB86659FD93


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class GramHash:
    """Hashes of all ``gram``-byte substrings of a buffer, equal for equal bytes wherever they lie."""

    def __init__(self, gram: int):
        self.gram, self.up, self.down = gram, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            n = 1 << int(len(data)).bit_length()
            self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MIX)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_BASE)
        return h ^ (h >> np.uint64(32))


def sliding(op, values: np.ndarray, width: int, fill) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width`` values, in time independent of it."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, fill, values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    head = op.accumulate(grid, axis=1).ravel()
    tail = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - width + 1], head[width - 1 : n])


def segments(texts: list[bytes], hasher: GramHash, length: int = LENGTH):
    """Arrays (text index, first window start, number of windows, minimizer, may repeat itself)."""
    out = []
    pieces, total = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, PIECE):
            pieces.append((i, at, t[at : at + PIECE + length - 1]))
            total += len(pieces[-1][2])
            if total >= PIECE:
                out.append(_segments(pieces, hasher, length))
                pieces, total = [], 0
    if pieces:
        out.append(_segments(pieces, hasher, length))
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _segments(pieces, hasher: GramHash, length: int):
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    firsts = np.cumsum(sizes) - sizes
    width = length - hasher.gram + 1
    grams = hasher(data)
    low = sliding(np.minimum, grams, width, np.uint64(2**64 - 1))
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(low)]
    inside = np.arange(len(low)) <= (firsts + sizes - length)[piece]
    at = np.flatnonzero(inside)
    values = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (values[1:] != values[:-1]) | (np.diff(at) > 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    first = at[begin]
    # Places of minimizers; two neighbours with one hash may let a segment repeat itself.
    reach = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    reach[width - 1 : width - 1 + len(low)] = np.where(inside, low, np.uint64(0))
    cover = sliding(np.maximum, reach, width, np.uint64(0))
    places = np.flatnonzero((grams == cover[: len(grams)]) & (cover[: len(grams)] > 0))
    hashes = grams[places]
    twice = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
    seg = values[begin]
    p = piece[first]
    text = np.array([x[0] for x in pieces])[p]
    start = first - firsts[p] + np.array([x[1] for x in pieces])[p]
    return text, start, count, seg, np.isin(seg, twice)


def common_prefixes(ranked: np.ndarray) -> np.ndarray:
    """For rows in order: bytes that each shares with the row before it (none for the first)."""
    out = np.zeros(len(ranked), np.int64)
    for i in range(1, len(ranked), 8192):
        differ = ranked[i : i + 8192] != ranked[i - 1 : i - 1 + len(ranked[i : i + 8192])]
        out[i : i + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), ranked.shape[1])
    return out


def _to_smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the nearest row before it that has a smaller position.

    All rows look at once: a row whose candidate has a larger position goes on to that one's candidate,
    and everything it passes is larger than it, so the first smaller one is not missed.
    """
    n = len(position)
    at, low = np.arange(n) - 1, shared.copy()
    open_ = np.flatnonzero(at >= 0)
    while len(open_ := open_[position[at[open_]] > position[open_]]):
        via = at[open_]
        low[open_], at[open_] = np.minimum(low[open_], low[via]), at[via]
        open_ = open_[at[open_] >= 0]
    low[at < 0] = 0
    return low


def longest_previous_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For suffixes in order: the longest prefix each shares with one of a smaller position.

    ``shared[i]`` is the common prefix of suffixes i - 1 and i.  Previous and next smaller positions
    are enough: any other smaller one lies behind one of them.
    """
    back = np.append(shared[1:], 0)[::-1]
    return np.maximum(_to_smaller(position, shared), _to_smaller(position[::-1], np.concatenate([[0], back[1:]]))[::-1])


def repeated_windows(strings: list[bytes], first_stays: bool, length: int = LENGTH) -> list[np.ndarray]:
    """For strings in order of position, the window starts that repeat (``first_stays``: an earlier one).

    The suffix array holds the window starts only, in order of their first ``length`` bytes.
    """
    counts = np.array([len(s) - length + 1 for s in strings])
    rows = np.concatenate(
        [np.lib.stride_tricks.sliding_window_view(np.frombuffer(s, np.uint8), length) for s in strings]
    )
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")
    shared = common_prefixes(rows[order])
    repeats = np.zeros(len(order), bool)
    repeats[order] = longest_previous_factors(order, shared) >= length
    if not first_stays:
        repeats[order] |= longest_previous_factors(-order, shared) >= length
    return [np.flatnonzero(x) for x in np.split(repeats, np.cumsum(counts)[:-1])]


def runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Ascending places as half-open runs."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + 1).tolist()


def spans_of(ranges, length: int = LENGTH) -> list[tuple[int, int]]:
    """Bytes covered by windows that start in these half-open ranges, as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(data: bytes, spans) -> bytes:
    """The bytes outside the spans."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts)


def whole_characters(data: bytes, spans) -> list[tuple[int, int]]:
    """Spans shrunk so that they hold whole UTF-8 characters only."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


class RepeatedStrings:
    """The distinct texts of a table and, for each, where windows repeat.

    ``docs``: any table; ``id_col`` orders documents.  ``texts`` has k (MD5), text, n (copies), id and
    row (the other columns of the first copy); ``ranges`` has k and ranges (array of lo, hi: half-open
    ranges of window starts) for the texts that have any.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "first", carry=()):
        if keep not in ("first", "none"):
            raise ValueError("keep is 'first' or 'none'")
        self.spark, self.first = docs.sparkSession, keep == "first"
        small_batches(self.spark)
        self.id_kind = docs.schema[id_col].dataType.simpleString()
        self.texts = self._distinct(docs, id_col, text, list(carry))
        self.ranges = self._ranges()

    def _distinct(self, docs: DataFrame, id_col: str, text: str, carry: list[str]) -> DataFrame:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        t = F.coalesce(F.col(text), F.lit(""))
        row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("z"))
        keyed = docs.select(
            F.unhex(F.md5(t)).alias("k"),
            F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id")).alias("o"),
            F.struct(t.alias("text"), row.alias("row")).alias("v"),
        )
        one = keyed.groupBy("k").agg(F.min_by("v", "o").alias("v"), F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
        texts = bucketed(one.select("k", "v.text", "n", "o.late", "o.id", "v.row"), buckets, "k")
        free_shuffles(self.spark)
        return texts

    def _segments(self) -> DataFrame:
        import pyarrow as pa

        def run(batches):
            hasher = GramHash(GRAM)
            for b in batches:
                text, start, count, value, again = segments(b.column(1).cast(pa.binary()).to_pylist(), hasher)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(text)), pa.array(start << 24 | count << 1 | again), pa.array(value.view(np.int64))],
                        names=["k", "at", "value"],
                    )

        # at: window start, number of windows (below 2^23, as a piece is) and whether it may repeat itself.
        return self.texts.select("k", "text").mapInArrow(run, "k binary, at bigint, value bigint")

    def _strings(self, found: DataFrame) -> DataFrame:
        """The bytes of segments, from the stored texts: value, c (MD5), k, start, again, late, id, bytes."""
        import pyarrow as pa

        lists = found.groupBy("k").agg(F.collect_list(F.struct("at", "value")).alias("s"))

        def run(batches):
            for b in batches:
                s = b.column(4)
                flat, sizes = s.flatten(), s.value_lengths().to_numpy()
                which = np.repeat(np.arange(len(sizes)), sizes)
                texts = b.column(1).cast(pa.binary()).to_pylist()
                packed = flat.field(0).to_numpy()
                starts, wins, again = packed >> 24, packed >> 1 & (1 << 23) - 1, packed & 1 > 0
                strings = [texts[i][a : a + n + LENGTH - 1] for i, a, n in zip(which.tolist(), starts.tolist(), wins.tolist())]
                at = pa.array(which)
                step = 20_000
                for i in range(0, len(strings), step):
                    part = strings[i : i + step]
                    here = at[i : i + step]
                    yield pa.RecordBatch.from_arrays(
                        [flat.field(1)[i : i + step], pa.array([hashlib.md5(x).digest() for x in part]), b.column(0).take(here),
                         pa.array(starts[i : i + step]), pa.array(again[i : i + step]), b.column(2).take(here), b.column(3).take(here),
                         pa.array(part, pa.binary())], names=["value", "c", "k", "start", "again", "late", "id", "bytes"],
                    )

        joined = self.texts.join(lists.hint("merge"), "k").select("k", "text", "late", "id", "s")
        return joined.mapInArrow(run, f"value bigint, c binary, k binary, start bigint, again boolean, late boolean, id {self.id_kind}, bytes binary")

    def _ranges(self) -> DataFrame:
        found = materialize(self._segments())
        again = F.max(F.col("at").bitwiseAND(F.lit(1)))
        seen = found.groupBy("value").agg(F.count(F.lit(1)).alias("__n"), again.alias("__a")).where("__n > 1 or __a = 1")
        strings = materialize(self._strings(found.join(seen.select("value").hint("merge"), "value")))
        release(found)
        free_shuffles(self.spark)
        place = F.struct("late", "id", "k", "start")
        by_string = strings.groupBy("value", "c").agg(
            F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.max(F.length("bytes")).alias("size"),
            *([F.min(place).alias("first")] if self.first else []),
        )
        counted = materialize(by_string)
        by_value = counted.groupBy("value").agg(
            F.count(F.lit(1)).alias("__k"), F.sum("size").alias("__bytes"), F.max("again").alias("__a")
        ).where("__k > 1 or __a").select("value", "__bytes")
        open_ = strings.join(by_value.hint("merge"), "value").groupBy("value", "c").agg(
            F.min("bytes").alias("bytes"), F.max("__bytes").alias("__bytes"), F.min(place).alias("first")
        )
        open_ = materialize(open_)
        sorted_ = self._by_suffix_order(open_.where(F.col("__bytes") <= HOT_BYTES))
        dealt = self._by_window(open_.where(F.col("__bytes") > HOT_BYTES))
        partial = sorted_.unionByName(dealt).groupBy("value", "c").agg(F.flatten(F.collect_list("r")).alias("r"))
        marks = counted.join(partial.hint("merge"), ["value", "c"], "left").where("n > 1 or r is not null").select(
            F.col("value"), F.col("c"), "n", "r", *(["first"] if self.first else [])
        )
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.length("bytes") - LENGTH + 1).cast("bigint").alias("hi")))
        at = strings.select("value", "c", "k", "start", "late", "id", whole.alias("whole")).join(marks.hint("merge"), ["value", "c"])
        if self.first:
            is_first = (F.col("first.k") == F.col("k")) & (F.col("first.start") == F.col("start"))
            ranges = F.when(is_first, F.col("r")).otherwise(F.col("whole"))
        else:
            ranges = F.when(F.col("n") > 1, F.col("whole")).otherwise(F.col("r"))
        moved = at.select("k", "start", ranges.alias("r")).where("r is not null").select(
            "k", F.transform("r", lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), (x["hi"] + F.col("start")).alias("hi"))).alias("r")
        )
        return moved.groupBy("k").agg(F.flatten(F.collect_list("r")).alias("ranges"))

    def _by_suffix_order(self, strings: DataFrame) -> DataFrame:
        """value, c, r: runs of repeated window starts of strings whose minimizer is not too frequent."""
        import pyarrow as pa

        first_stays = self.first

        def decide(group):
            if first_stays:
                group.sort(key=lambda x: (x[3]["late"], x[3]["id"] if not x[3]["late"] else 0, x[3]["k"], x[3]["start"]))
            values, cs, rs = [], [], []
            for x, places in zip(group, repeated_windows([x[2] for x in group], first_stays)):
                if len(places):
                    values.append(x[0])
                    cs.append(x[1])
                    rs.append([{"lo": a, "hi": b} for a, b in zip(*runs(places))])
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(cs, pa.binary()), pa.array(rs, kind)], names=["value", "c", "r"])

        def run(batches):
            group, starts, last = [], 0, None
            for b in batches:
                for x in zip(*(b.column(i).to_pylist() for i in range(4))):
                    if x[0] != last and starts >= SORTED_AT_ONCE:
                        yield decide(group)
                        group, starts = [], 0
                    last = x[0]
                    group.append(x)
                    starts += len(x[2]) - LENGTH + 1
            if group:
                yield decide(group)

        dealt = strings.select("value", "c", "bytes", "first").repartition("value").sortWithinPartitions("value")
        return dealt.mapInArrow(run, "value bigint, c binary, r array<struct<lo:bigint,hi:bigint>>")

    def _by_window(self, strings: DataFrame) -> DataFrame:
        """The same for strings of very frequent minimizers: every window goes by its own hash."""
        hashes = F.transform(
            F.sequence(F.lit(0), F.length("bytes") - LENGTH),
            lambda i: F.unhex(F.md5(F.substring(F.col("bytes"), i + 1, F.lit(LENGTH)))),
        )
        w = strings.select("value", "c", "first", hashes.alias("hs")).select("value", "c", "first", F.posexplode("hs").alias("off", "h"))
        w = w.select(
            "value", "c", "h",
            F.struct("first.late", "first.id", "first.k", (F.col("first.start") + F.col("off")).alias("start")).alias("p"),
            F.col("off").cast("bigint").alias("off"),
        )
        # Written, so that the join reads both sides from shuffles, of which Spark splits a frequent hash's.
        heads = materialize(w.groupBy("h").agg(F.count(F.lit(1)).alias("__n"), F.min("p").alias("__p")).where("__n > 1"))
        again = w.join(heads.hint("merge"), "h")
        if self.first:
            again = again.where((F.col("p.k") != F.col("__p.k")) | (F.col("p.start") != F.col("__p.start")))
        return again.groupBy("value", "c").agg(F.collect_list(F.struct(F.col("off").alias("lo"), (F.col("off") + 1).alias("hi"))).alias("r"))


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document what removing all places of repeated strings leaves: sizes, runs, and a hash of the rest."""
    import pyarrow as pa

    found = RepeatedStrings(docs, id_col, text, keep="none")
    joined = found.texts.select("k", "text", "n").join(found.ranges.hint("merge"), "k", "left").select("k", "text", "n", "ranges")

    def run(batches):
        for b in batches:
            rows = []
            for data, n, ranges in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if n > 1 and len(data) >= LENGTH:
                    spans = [(0, len(data))]
                else:
                    spans = spans_of((r["lo"], r["hi"]) for r in ranges or ())
                rows.append((len(data), sum(y - x for x, y in spans), len(spans), hashlib.sha256(cut(data, spans)).hexdigest()))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    by_text = joined.mapInArrow(run, "k binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    ids = docs.select(id_col, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("__k"))
    return ids.join(by_text.hint("merge"), F.col("__k") == F.col("k")).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without later copies of repeated strings, with the columns they came with.

    Only whole characters go.  Of equal texts of ``LENGTH`` bytes or more the first stays; documents of
    which nothing is left go; shorter texts stay as they are, copies included.
    """
    import pyarrow as pa

    columns = docs.columns
    long_ = F.octet_length(F.coalesce(F.col(text), F.lit(""))) >= LENGTH
    found = RepeatedStrings(docs.where(long_), id_col, text, keep="first", carry=[c for c in columns if c != text])
    joined = found.texts.select("k", "text", "row").join(found.ranges.hint("merge"), "k", "left").select("text", "ranges", "row")
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = []
            for data, ranges in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                spans = whole_characters(data, spans_of((r["lo"], r["hi"]) for r in ranges or ()))
                texts.append(cut(data, spans).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2)], names=["text", "row"])

    cleaned = joined.mapInArrow(run, f"text string, row {kind}").where(F.length("text") > 0)
    others = [c for c in columns if c != text]
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {text: F.col("text")}
    return cleaned.select(*[back[c].alias(c) for c in columns]).unionByName(docs.where(~long_))


QUERY = "op9_suffix_dedup"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return repeat_digest(table(spark, sf_dir, "documents"))
