"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

A fingerprint has a bit set where over half of the text's shingle hashes have it.  Two fingerprints
that differ in at most ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` blocks, so
each is filed under every choice of that many blocks (10 keys of about 38 bits by default) and pairs
are sought among equal keys only.  Equal fingerprints are one row throughout.

A key shared by more than ``BUCKET`` different fingerprints is not expanded into pairs.  Its
fingerprints go another exact way: each is filed under itself and all its one-bit variants.  Two
fingerprints within two bits share a variant (the half-way point), all that share one are within two
bits of each other, and at most 65 can share one, so linking them to their smallest gives the same
components in linear work.  (That way needs radius 2 or less; a larger radius expands all keys.)

Edge cases: a null or blank text has fingerprint zero and is linked like any other; a null id is kept,
and never is the smallest of its component unless all are null; repeated rows stay repeated; texts of any
length are read whole, hashes in blocks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import bucketed, free_shuffles, materialize, release
from coterie.llm.common import small_batches
from coterie.operators.components import connected_components

RADIUS = 2
BLOCKS = 5
BUCKET = 64
SHINGLE = 3


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)]
    total = np.zeros(64, np.int64)
    h = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, __fp`` of every document, whole texts."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [text_fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "__fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, __fp bigint")


def block_masks(blocks: int, radius: int) -> list[int]:
    """The masks of every choice of ``blocks - radius`` blocks of a 64-bit number, as signed numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(reduce(int.__or__, c)) for c in combinations(parts, blocks - radius)]


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: edges between different fingerprints (column ``__fp``) whose components are those of all links."""
    masks = block_masks(blocks, radius)
    filed = distinct.select(
        "__fp", F.posexplode(F.array(*[F.col("__fp").bitwiseAND(F.lit(m)) for m in masks])).alias("__c", "__key")
    )
    sizes = filed.groupBy("__c", "__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    shared = materialize(filed.join(sizes, ["__c", "__key"]))
    few = shared if radius > 2 else shared.where(F.col("__n") <= bucket)
    a = few.select("__c", "__key", F.col("__fp").alias("u"))
    b = few.select("__c", "__key", F.col("__fp").alias("v"))
    pairs = a.join(b, ["__c", "__key"]).where((F.col("u") < F.col("v")) & (_distance("u", "v") <= radius)).select("u", "v")
    if radius > 2:
        return pairs
    hot = shared.where(F.col("__n") > bucket).select("__fp").distinct()
    flips = [0] if radius == 0 else [0, *[1 << i for i in range(63)], -(1 << 63)]
    near = hot.select("__fp", F.explode(F.array(*[F.col("__fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("__mid"))
    heads = near.groupBy("__mid").agg(F.min("__fp").alias("u"), F.count(F.lit(1)).alias("__k")).where("__k > 1")
    stars = near.join(heads, "__mid").where((F.col("__fp") != F.col("u")) & (_distance("__fp", "u") <= radius))
    return pairs.unionByName(stars.select("u", F.col("__fp").alias("v")))


def classes(fps: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``__fp, component_id``: for every different fingerprint the smallest id of its component."""
    distinct = fps.groupBy("__fp").agg(F.min(id_col).alias("__low"))
    parts = connected_components(links(distinct, radius, blocks))
    whole = distinct.join(parts, distinct["__fp"] == parts["node"], "left").select(
        "__fp", "__low", F.coalesce("component", "__fp").alias("__root")
    )
    lows = whole.groupBy("__root").agg(F.min("__low").alias("component_id"))
    return whole.join(lows, "__root").select("__fp", "component_id", "__root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``id_col, fingerprint, component_id`` of every document."""
    fps = materialize(fingerprints(docs, id_col, text, shingle))
    out = fps.join(materialize(classes(fps, id_col, radius, blocks)), "__fp")
    return out.select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similarity of 0.8 or more

SIMILARITY = 0.8
WIDE_SHINGLE = 5
#: Texts of the sample that tells common shingles; a shingle in COMMON of them is common, COMMONEST at most are kept.
SAMPLE, COMMON, COMMONEST = 8192, 4, 100_000
#: Texts of a key that are compared all with all; larger keys begin with their hub, so copies of one text make a star.
EXPANDED = 4
#: Keys of a text before one that tell whether two texts have met already.
LOOK_BACK = 32
#: Least bits of the parity signature that rules pairs out before their shingle sets are fetched; twice the set's
#: size or more, so that signatures of long texts do not fill up.
PARITY = 1024


def _shingle_set(text: str | None, shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.array(sorted({xxh64_intdigest(g, 42) for g in grams}), np.uint64).view(np.int64).tolist()


def parity(s: np.ndarray) -> bytes:
    """Bit k: whether an odd number of elements fall on k; a power of two of bits, at least twice the elements."""
    bits = max(PARITY, 1 << int(2 * len(s)).bit_length())
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def parity_differences(p: list[bytes], q: list[bytes]) -> np.ndarray:
    """Bits that differ, pair by pair; the longer signature is folded to the length of the other."""
    out = np.zeros(len(p), np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(p, q)], np.int64).reshape(-1, 2)
    for one, two in {(len(a), len(b)) for a, b in zip(p, q)}:
        at = np.flatnonzero((sizes[:, 0] == one) & (sizes[:, 1] == two))
        folded = []
        for side, size in ((p, one), (q, two)):
            x = np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), size)
            while x.shape[1] > min(one, two):
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            folded.append(x)
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64)
    return out


def prefix_length(size: int, similarity: float) -> int:
    """Two sets of that similarity or more share one of so many first elements, in any order common to both."""
    return size - int(np.ceil(similarity * size - 1e-6)) + 1 if size else 0


def _ordered(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles with the common ones last, rarer before commoner; ``common`` is sorted, ``rank`` its order."""
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    last = common[at] == s
    return np.concatenate([s[~last], s[last][np.argsort(rank[at[last]], kind="stable")]])


def _reaches(u: str, v: str, similarity: float) -> Column:
    """Whether two sets can still be similar enough if their first shared shingle is at these positions."""
    rest = F.least(F.col(f"{u}.size") - F.col(f"{u}.pos"), F.col(f"{v}.size") - F.col(f"{v}.pos"))
    return rest >= F.lit(similarity / (1 + similarity)) * (F.col(f"{u}.size") + F.col(f"{v}.size")) - 1e-6


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def _similar(pairs: DataFrame, filed: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs ``u, v`` whose shingle sets are similar enough; ``texts`` has ``__uid`` and the text.

    Pairs of one ``part`` of ``filed`` are left out: they are linked already.
    """
    import pyarrow as pa

    def possible(batches):
        for b in batches:
            if not b.num_rows:
                continue
            differ = parity_differences(b.column("p").to_pylist(), b.column("q").to_pylist())
            y = b.column("y").to_numpy()
            # Of y elements in both sets together, y (1 - similarity) / (1 + similarity) at most are in one only.
            yield b.filter(pa.array(differ <= y * ((1 - similarity) / (1 + similarity)) + 1e-6)).select(["u", "v"])

    one, two = (filed.select(F.col("uid").alias(c), F.col("size").alias(f"n{c}"), F.col("sig").alias(g), F.col("part").alias(f"{c}part")) for c, g in (("u", "p"), ("v", "q")))
    close = pairs.join(one, "u").join(two, "v").where("upart != vpart").select("u", "v", "p", "q", (F.col("nu") + F.col("nv")).alias("y"))
    close = materialize(close.mapInArrow(possible, "u bigint, v bigint"))
    needed = close.select(F.col("u").alias("__uid")).unionByName(close.select(F.col("v").alias("__uid"))).distinct()

    def sets(batches):
        for b in batches:
            s = [_shingle_set(x, shingle) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], names=["uid", "s"])

    # In buckets of the text's number: of each pair one set moves, the other is met where it lies.
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = bucketed(texts.join(needed.hint("merge"), "__uid").mapInArrow(sets, "uid bigint, s array<bigint>").repartition(n, "uid"), n, "uid")
    there = close.hint("merge").join(grams.select(F.col("uid").alias("v"), F.col("s").alias("sv")).hint("merge"), "v")
    joined = there.hint("merge").join(grams.select(F.col("uid").alias("u"), F.col("s").alias("su")).hint("merge"), "u")
    both = F.size(F.array_intersect("su", "sv"))
    edges = joined.select("u", "v", both.alias("x"), (F.size("su") + F.size("sv") - both).alias("y")).where(F.col("x") >= F.lit(similarity) * F.col("y"))
    out = materialize(edges.select("u", "v"))
    release(close)
    release(grams)
    free_shuffles(out.sparkSession)
    return out


def simhash_pairs(filed: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``u, v``: SimHash's candidates among texts ``uid, __fp``, as many as texts and links between fingerprints.

    Texts of one fingerprint meet its first text; first texts meet where pigeonhole blocks and the Hamming check
    link their fingerprints.
    """
    heads = materialize(filed.groupBy("__fp").agg(F.min("uid").alias("head")))
    same = filed.join(heads, "__fp").select(F.col("head").alias("u"), F.col("uid").alias("v"))
    one, two = (heads.select(F.col("__fp").alias(c), F.col("head").alias(f"{c}head")) for c in ("u", "v"))
    near = links(heads.select("__fp"), radius, blocks).join(one, "u").join(two, "v").select(F.col("uhead").alias("u"), F.col("vhead").alias("v"))
    return _both_ways(same.unionByName(near))


def _edges(texts: DataFrame, similarity: float, shingle: int, bucket: int) -> DataFrame:
    """``u, v``: pairs of similar texts whose components are those of all similar pairs; ``texts`` are different ones.

    SimHash comes first: its candidates are confirmed by their shingle sets, and texts so linked are compared with
    other groups only.  As texts at 0.8 may differ in more bits than blocks can find, each text is then filed under
    the first shingles of its set, common ones last, so that all similar pairs share a key.  Keys of up to ``bucket`` texts are expanded.  In a larger one all texts are first compared with its hub,
    the text with most of its shingles in such keys; then each text outside of the key's largest component with
    all of other components, at the first such key they share.
    """
    import pyarrow as pa

    spark = texts.sparkSession

    def every(batches):
        for b in batches:
            s = [_shingle_set(x, shingle) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sum(s, []), np.int64))], names=["tok"])

    share = SAMPLE / max(texts.count(), 1)
    some = texts.where(F.pmod(F.xxhash64("__uid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = some.mapInArrow(every, "tok bigint").groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    top = [r["tok"] for r in counts.orderBy(F.desc("n"), "tok").limit(COMMONEST).collect()][::-1]
    common = np.array(top, np.int64)
    rank = np.argsort(common)
    common = common[rank]
    held = spark.sparkContext.broadcast((common, rank))

    def first(batches):
        for b in batches:
            sizes, sigs, toks, fps = [], [], [], []
            for x in b.column(1).to_pylist():
                fps.append(text_fingerprint(x))
                s = np.array(_shingle_set(x, shingle), np.int64)
                sizes.append(len(s))
                sigs.append(parity(s))
                toks.append(_ordered(np.sort(s), *held.value)[: prefix_length(len(s), similarity)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(toks, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["uid", "size", "sig", "toks", "__fp"])

    filed = materialize(texts.mapInArrow(first, "uid bigint, size int, sig binary, toks array<bigint>, __fp bigint"))
    keys = filed.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(filed.select("uid", "size", F.posexplode("toks").alias("pos", "tok")).join(keys, "tok"))
    narrow = materialize(filed.select("uid", "size", "sig", "__fp", F.col("uid").alias("part")))  # without the first shingles, most of the bytes
    release(filed)
    free_shuffles(spark)
    sure = _similar(simhash_pairs(narrow), narrow, texts, similarity, shingle)
    groups = connected_components(sure, "u", "v").withColumnRenamed("component", "group")
    filed = materialize(narrow.join(groups, narrow["uid"] == groups["node"], "left").select("uid", "size", "sig", F.coalesce("group", "part").alias("part")))
    release(narrow)
    free_shuffles(spark)
    few = shared.where(F.col("n") <= bucket)
    cold = few.alias("a").join(few.alias("b"), "tok").where((F.col("a.uid") < F.col("b.uid")) & _reaches("a", "b", similarity)).select(F.col("a.uid").alias("u"), F.col("b.uid").alias("v"))
    hot = shared.where(F.col("n") > bucket)
    score = hot.groupBy("uid").agg((F.count(F.lit(1)) / F.max("size")).alias("score"))
    hubs = hot.join(score, "uid").groupBy("tok").agg(F.max(F.struct("score", "uid"))["uid"].alias("v"))
    edges = sure.unionByName(_similar(_both_ways(cold.unionByName(hot.join(hubs, "tok").select(F.col("uid").alias("u"), "v"))), filed, texts, similarity, shingle))
    parts = materialize(connected_components(edges, "u", "v"))
    placed = materialize(hot.join(parts, hot["uid"] == parts["node"], "left").select("tok", "uid", "size", "pos", F.coalesce("component", "uid").alias("part")))
    sums = placed.groupBy("tok", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("tok").agg(F.max(F.struct("m", "part"))["part"].alias("most"), F.count(F.lit(1)).alias("parts"))
    # A pair that shares many keys need meet at the first only.  Looking back over some of a text's keys tells most
    # of the later meetings; before a pair's first key the two share none, so no pair is lost.
    back = Window.partitionBy("uid").orderBy("pos").rowsBetween(-LOOK_BACK, -1)
    mixed = materialize(placed.join(sums.where("parts > 1"), "tok").drop("parts").withColumn("before", F.collect_list("tok").over(back)))
    strays = mixed.where("part != most")
    other = (F.col("a.part") != F.col("b.part")) & _reaches("a", "b", similarity) & ~F.arrays_overlap("a.before", "b.before")
    # Of two strays each would meet the other.
    once = (F.col("b.part") == F.col("b.most")) | (F.col("a.uid") < F.col("b.uid"))
    rest = strays.alias("a").join(mixed.alias("b"), "tok").where(other & once).select(F.col("a.uid").alias("u"), F.col("b.uid").alias("v"))
    release(placed)
    return edges.unionByName(_similar(_both_ways(rest), filed, texts, similarity, shingle))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                     shingle: int = WIDE_SHINGLE, bucket: int = EXPANDED) -> DataFrame:
    """The documents without near copies, with the columns they came with.

    Texts are near copies when the Jaccard similarity of their word shingles is ``similarity`` or more;
    SimHash's candidates and then a prefix filter's, which lacks none, are confirmed by the shingle sets.  Of each connected group the
    document with the smallest id stays, null ids last; of rows with that id one stays.  Texts without
    words are equal to each other.  Columns travel under numbers inside, so no name can clash.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    columns = docs.columns
    at = columns.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    t, i = f"c{at}", f"c{columns.index(id_col)}"

    def run(batches):
        import hashlib

        for b in batches:
            texts = b.column(at).to_pylist()
            keys = [hashlib.md5(b" ".join((x or "").encode().lower().split())).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "__k"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    spark = docs.sparkSession
    numbered = inner.mapInArrow(run, f"{kinds}, __k binary").withColumn("__uid", F.monotonically_increasing_id())
    # Stored in buckets of the row number: the joins on it below then leave the texts where they are.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = bucketed(numbered.repartition(n, "__uid"), n, "__uid")
    free_shuffles(spark)
    first = F.min(F.struct(F.col(i).isNull().alias("late"), F.col(i).alias("id"), F.col("__uid").alias("uid")))
    keys = materialize(base.groupBy("__k").agg(first.alias("w")))
    texts = base.select("__uid", t).join(keys.select(F.col("w.uid").alias("__uid")).hint("merge"), "__uid")
    parts = connected_components(_edges(texts, similarity, shingle, bucket), "u", "v")
    roots = keys.join(parts, keys["w.uid"] == parts["node"], "left").select(F.coalesce("component", "w.uid").alias("__root"), "w")
    stay = roots.groupBy("__root").agg(F.min("w").alias("w")).select(F.col("w.uid").alias("__uid"))
    return base.join(stay.hint("merge"), "__uid", "left_semi").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


QUERY = "op3_simhash"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
