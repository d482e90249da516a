"""Host-level quality rules, in DataFrame functions only.

A document fails the base rules when it has too few words or too many of its words lie in repeated
five-word windows.  Failures are counted by host, each host's failure rate is shrunk towards the
corpus by an empirical beta prior (moments over hosts), and a host whose shrunk rate is above the
limit takes all its documents with it.

Edge cases: a null or blank text has no words and fails; a null host is a host of its own; repeated
rows are judged row by row; texts of any length are read whole; an empty table gives an empty result;
further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.storage import materialize
from coterie.llm.common import let, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at these ascending places."""
    gaps = F.zip_with(
        starts,
        F.slice(starts, F.lit(2), F.size(starts)),
        lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)),
    )
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def _repeated_values(hashes: Column) -> Column:
    """The different hashes that occur more than once."""

    def pick(p: Column) -> Column:
        same = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.when(a == b, a))
        return F.array_distinct(F.filter(same, lambda x: x.isNotNull()))

    return let(F.sort_array(hashes), pick)


def _places_by_sort(hashes: Column) -> Column:
    """Ascending places of the hashes that occur more than once; n log n however many there are."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))

    def pick(p: Column) -> Column:
        n = F.size(p)
        marks = F.zip_with(
            F.arrays_zip(p.alias("p"), F.concat(none, F.slice(p, F.lit(1), n - 1)).alias("b")),
            F.concat(F.slice(p, F.lit(2), n), none),
            lambda x, a: F.when(
                F.coalesce(x["p"]["h"] == x["b"]["h"], F.lit(False)) | F.coalesce(x["p"]["h"] == a["h"], F.lit(False)),
                x["p"]["i"],
            ),
        )
        return F.sort_array(F.filter(marks, lambda x: x.isNotNull()))

    return let(pairs, pick)


def _places_by_lookup(hashes: Column, values: Column) -> Column:
    """The same where few values repeat: one look through the values for each place."""
    marks = F.transform(hashes, lambda h, i: F.when(F.array_contains(values, h), i))
    return F.filter(marks, lambda x: x.isNotNull())


def _repeated_starts(hashes: Column) -> Column:
    return let(
        _repeated_values(hashes),
        lambda v: F.when(F.size(v) <= 32, _places_by_lookup(hashes, v)).otherwise(_places_by_sort(hashes)),
    )


def repeat_words(words: Column) -> Column:
    """Number of words in windows of five words that the text holds more than once."""

    def of_words(w: Column) -> Column:
        return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])
        )
        return let(
            windows,
            lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(
                let(_repeated_starts(x), _covered)
            ),
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(words, of_words)).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measure(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: the columns ``keep``, ``__host``, the five measures and ``base_failed``."""
    words = docs.select(*keep, F.col(host).alias("__host"), F.col(text).alias("__t"), words_of(F.col(text)).alias("__w"))
    t = F.coalesce(F.col("__t"), F.lit(""))
    out = words.select(
        *keep,
        "__host",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        dup_lines(t).alias("n_dup_lines"),
        repeat_words(F.col("__w")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``__host, host_rate, host_kept``: failure rates by host, shrunk by a beta prior fitted to all hosts.

    The prior's mean m and variance v are the moments of the hosts' raw rates; its strength is
    m(1-m)/v - 1, at least 1 and at most 10,000 (hosts that all agree), so a host with few documents
    stays near the corpus.  The prior is one row.
    """
    hosts = measured.groupBy("__host").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col("base_failed").cast("long")).alias("__f")
    )
    rate = F.col("__f") / F.col("__n")
    prior = hosts.agg(F.avg(rate).alias("__m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("__v")).withColumn("__one", F.lit(1))
    spread = F.when(F.col("__v") > 0, F.col("__m") * (1 - F.col("__m")) / F.col("__v") - 1).otherwise(F.lit(10000.0))
    joined = hosts.withColumn("__one", F.lit(1)).join(F.broadcast(prior), "__one")  # one row
    strength = F.least(F.greatest(spread, F.lit(1.0)), F.lit(10000.0))
    shrunk = (F.col("__f") + F.col("__m") * strength) / (F.col("__n") + strength)
    return joined.select("__host", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdict of every document.  The narrow measures are written once, texts are read once."""
    measured = materialize(measure(docs, [id_col], text, host))
    hosts = host_verdicts(measured)
    m = measured.join(hosts, measured["__host"].eqNullSafe(hosts["__host"]), "left")
    return m.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "host_rate",
    )


#: Rejected hosts that are sent to all tasks; beyond, documents and hosts are joined by shuffle.
MOST_SENT = 100_000


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with (under numbers inside, so no name can clash).

    Measuring twice, once for the hosts' counts and once for the documents, is cheaper than storing
    texts between.  Rejected hosts are counted before they are broadcast.
    """
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    h = f"c{columns.index(host)}"
    w = inner.withColumn("w", words_of(F.col(f"c{columns.index(text)}")))
    flagged = w.select(*inner.columns, _failed(F.size("w"), repeat_words(F.col("w"))).alias("failed"))
    counts = materialize(flagged.select(F.col(h).alias("__host"), F.col("failed").alias("base_failed")))
    bad = materialize(host_verdicts(counts).where(~F.col("host_kept")).select("__host"))
    bad = F.broadcast(bad) if bad.limit(MOST_SENT + 1).count() <= MOST_SENT else bad.hint("merge")
    good = flagged.where(~F.col("failed")).drop("failed")
    return good.join(bad, good[h].eqNullSafe(bad["__host"]), "left_anti").toDF(*columns)


QUERY = "op10_quality_rules"

_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) >= 5),
h AS (SELECT rid, i, list_slice(ws, i, i + 4) AS win FROM g),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM h) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, l FROM (SELECT rid, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(dl.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dl USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
hs AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
pr AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v FROM hs),
st AS (SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000 END, 1), 10000) AS s FROM pr),
hv AS (SELECT source, (f + m * s) / (n + s) AS rate FROM hs, st)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  (NOT base_failed AND rate <= {MAX_HOST_RATE}) AS kept, round(rate, 9) AS host_rate
FROM b JOIN hv ON b.source IS NOT DISTINCT FROM hv.source
"""


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    out = judge(table(spark, sf_dir, "documents"))
    return out.withColumn("host_rate", F.round("host_rate", 9))
