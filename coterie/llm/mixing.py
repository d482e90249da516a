"""Mix sources to target weights by systematic sampling, in DataFrame functions only.

Every source gets a target number of words by its weight; no source may exceed a multiple of its own
size, and what is cut off is shared out again by weight (water-filling, solved exactly from one row
per source).  Within a source every document has the same expected number of copies r = target /
size.  Documents are put in one order per source, r is summed along it, one random offset is added,
and a document is emitted once for each whole number that its step crosses: floor or ceil of r times.

The order runs through hash buckets of bounded size, so the largest source is dealt over many tasks;
in even buckets sizes rise and in odd ones they fall, so neighbours are alike in size and the words
taken stay within about one document of the target.  Bucket counts are summed to give each bucket its
first place.

Edge cases: a null text has size 0; the null source comes last; sources without words get target 0
and give no copies; equal rows may swap copies among themselves; texts of any length are counted whole;
an empty table gives an empty result; further columns are not read (``mix`` carries them renamed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import materialize
from coterie.llm.common import hash32, words_of

#: Weights repeat along the sources in code-point order.
WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_TIMES = 2
#: Rows of a source that one task orders, about.
BUCKET_ROWS = 4096
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = TOTAL_PERCENT, times: int = MAX_TIMES) -> DataFrame:
    """``__source, source_size, __n, target`` from ``__source, size``: one row per source.

    Sorted by cap / weight, the sources that stop at their cap are a prefix; the level of the others is
    (total - caps of the prefix) / weights of the rest.  The windows below run over one row per source.
    """
    by = sizes.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy(F.col("__source").isNull(), "__source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    rows = by.withColumn("__w", weight).withColumn("__cap", (F.col("source_size") * times).cast("double"))
    every = Window.partitionBy(F.lit(1))
    filled = Window.orderBy((F.col("__cap") / F.col("__w")), F.col("__source").isNull(), "__source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__total", F.sum("source_size").over(every) * (percent / 100.0))
    rows = rows.withColumn("__all_w", F.sum("__w").over(every))
    rows = rows.withColumn("__caps", F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("__ws", F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    level = (F.col("__total") - F.col("__caps")) / (F.col("__all_w") - F.col("__ws"))
    fits = F.when(level * F.col("__w") <= F.col("__cap"), F.struct(F.row_number().over(filled).alias("k"), level.alias("x")))
    rows = rows.withColumn("__fits", fits)
    target = F.least(F.col("__cap"), F.coalesce(F.min("__fits").over(every)["x"] * F.col("__w"), F.col("__cap")))
    return rows.select("__source", "source_size", "__n", target.alias("target"))


def _offset() -> Column:
    """The one random number of a source, in [0, 1)."""
    return hash32(F.coalesce(F.concat(F.lit(SEED + ":"), "__source"), F.lit(SEED + "?"))) / F.lit(float(1 << 32))


def copies_plan(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` (the columns ``keep``) with ``size, __source, source_size, target, copies``."""
    sized = docs.select(
        *keep,
        F.col(source).alias("__source"),
        F.size(words_of(F.col(text))).cast("long").alias("size"),
        hash32(F.col(id_col)).alias("__h"),
        F.col(id_col).alias("__id"),
    )
    narrow = materialize(sized.select("__source", "size", "__h", "__id"))
    targets = materialize(source_targets(narrow).withColumn("__b", F.ceil(F.col("__n") / BUCKET_ROWS)))

    def dealt(df: DataFrame) -> DataFrame:
        t = targets.withColumnRenamed("__source", "__s")
        return df.join(t, df["__source"].eqNullSafe(t["__s"])).drop("__s").withColumn(
            "__bucket", F.pmod(F.floor(F.col("__h") / 7), F.col("__b"))
        )

    counts = dealt(narrow).groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    along = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        F.col("__source").alias("__s"),
        F.col("__bucket").alias("__k"),
        F.coalesce(F.sum("__rows").over(along), F.lit(0)).alias("__first"),
    )
    rows = dealt(sized if len(keep) > 1 else _narrow_as(narrow, keep, id_col))
    swing = F.when(F.col("__bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    place = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy(swing, "__h", "__id"))
    rows = rows.withColumn("__place", place)
    rows = rows.join(firsts, rows["__source"].eqNullSafe(firsts["__s"]) & (rows["__bucket"] == firsts["__k"]))
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("__first") + F.col("__place")
    crossed = F.floor(r * rank + _offset()) - F.floor(r * (rank - 1) + _offset())
    copies = F.least(crossed, F.ceil(r)).cast("int")
    return rows.select(*keep, "size", "__source", "source_size", "target", copies.alias("copies"))


def _narrow_as(narrow: DataFrame, keep: list[str], id_col: str) -> DataFrame:
    return narrow.select(F.col("__id").alias(id_col), "__source", "size", "__h", "__id")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: its size, its source's size and target, copies and words taken."""
    plan = copies_plan(docs, [id_col], id_col, text, source)
    return plan.select(id_col, "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus itself: every document as often as it is taken, with the columns it came with."""
    columns = docs.columns
    clash = {c: f"__in_{i}" for i, c in enumerate(columns)}
    inner = docs.select(*[F.col(c).alias(clash[c]) for c in columns])
    plan = copies_plan(inner, list(clash.values()), clash[id_col], clash[text], clash[source])
    out = plan.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(v).alias(k) for k, v in clash.items()])


QUERY = "op7_mix_sources"

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::DOUBLE AS w,
    (2 * source_size)::DOUBLE AS cap FROM s),
p AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws FROM w
    WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - caps) / (all_w - ws) AS level, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS k FROM p),
t AS (SELECT source, source_size, n, ceil(n / {BUCKET_ROWS}.0)::BIGINT AS b,
    least(cap, coalesce(arg_min(level, CASE WHEN level * w <= cap THEN k END) OVER () * w, cap)) AS target FROM l),
e AS (SELECT d.*, t.source_size, t.target, (d.h // 7) % t.b AS bucket FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket,
    CASE WHEN bucket % 2 = 0 THEN size ELSE -size END, h, doc_id NULLS FIRST) AS k,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS x,
    ('0x' || substr(md5(coalesce('{SEED}:' || source, '{SEED}?')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM e),
c AS (SELECT *, least(floor(x * k + u) - floor(x * (k - 1) + u), ceil(x))::INT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return mix_counts(table(spark, sf_dir, "documents"))
