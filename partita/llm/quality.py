"""Quality rules with adaptive thresholds (native: SQL expressions only).

Measures of each document are counted into logarithmic buckets per language and source.  Such
histograms merge by adding counts, in any order and with the same result, and their quantiles
have a bounded relative error.  The sketches hold the rows that pass the base rules, and fences
come from the rows where a measure is not zero: the median times the fourth power of its ratio to
the lower quartile (the upper quartile plus 1.5 interquartile ranges of a log-normal measure), so
that junk in up to half of these rows cannot raise them.  A fence may lie under the floor; it may
rise over it, by half at most, only as more than half of a group's rows have the measure.  The
floor itself stands where the quartiles show no spread.  A group's sketch is joined with its
language's, which counts as ``PRIOR_ROWS`` rows, and the language's likewise with that of all
documents, so that small groups go over to them smoothly.

Null and empty texts have no words and fail the base rules.  Null languages and sources form
groups of their own.  Repeated rows are judged one by one; extra columns are kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.blocks import checkpointed, fresh

GROWTH = 1.05
PRIOR_ROWS = 200
ROW_BYTES, BROADCAST_BYTES = 256, 8 << 20  # of a group's thresholds, and of all that may be broadcast
FLOORS = {"symbols": 0.3, "dup_lines": 0.3, "repeats": 0.3}
SPACE = r"translate(t, ' \t\n' || chr(11) || chr(12) || '\r', '')"

# lambda variables bind each intermediate array once, so that nothing is evaluated for each element;
# windows are compared by 64-bit hashes
_REPEATS = r"""
if(size(w) < 3, 0,
 transform(array(transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], get(w, i + 1), get(w, i + 2)))), g ->
  if(size(array_distinct(g)) = size(g), 0,
   transform(array(sort_array(arrays_zip(g, sequence(0, size(g) - 1)))), s ->
    transform(array(sort_array(filter(transform(s, (x, k) -> if(x.g = get(s, k - 1).g or x.g = get(s, k + 1).g, x.`1`, null)), p -> p is not null))), p ->
     aggregate(p, struct(0 as n, -3 as last), (a, i) -> struct(a.n + least(3, i - a.last) as n, i as last), a -> a.n))[0])[0]))[0])
"""


def measures(docs: DataFrame) -> DataFrame:
    """docs with ``_m``: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words (all long)."""
    words = r"filter(split(t, '[ \\x09-\\x0D]+'), x -> x <> '')"
    lines = r"filter(split(t, '\n', -1), x -> x rlike '[^ \\x09-\\x0D]')"
    body = f"""transform(array(coalesce(cast(text as string), '')), t -> transform(array({words}), w -> struct(
      cast(size(w) as bigint) as n_words,
      cast(length({SPACE}) as bigint) as word_chars,
      cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
      transform(array({lines}), l -> struct(cast(size(l) as bigint) as n_lines, cast(size(l) - size(array_distinct(l)) as bigint) as n_dup_lines))[0] as l,
      cast({_REPEATS} as bigint) as n_repeat_words))[0])[0]"""
    # a generator keeps Catalyst from repeating the expression for each field that is read
    found = docs.select("*", F.explode(F.array(F.expr(body))).alias("_m"))
    return found.withColumn("_m", F.struct("_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.l.n_lines", "_m.l.n_dup_lines", "_m.n_repeat_words"))


def failed(m: str = "_m"):
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def rates(m: str = "_m") -> dict:
    n = F.greatest(F.col(f"{m}.n_words"), F.lit(1))
    return {"symbols": F.col(f"{m}.n_symbols") / n, "dup_lines": F.col(f"{m}.n_dup_lines") / F.greatest(F.col(f"{m}.n_lines"), F.lit(1)), "repeats": F.col(f"{m}.n_repeat_words") / n}


def _joined(prior: str, rows: str) -> Column:
    """The sketch h with a prior's shares as ``PRIOR_ROWS`` rows; a prior has all buckets of h."""
    return F.expr(f"transform(array(map_from_entries(h)), m -> transform({prior}, x -> struct(x.b as b, coalesce(element_at(m, x.b), 0L) + {PRIOR_ROWS}D * x.n / {rows} as n)))[0]")


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, symbols, dup_lines, repeats): the sketches' fences."""
    bucket = lambda x: F.when(x <= 0, F.lit(-1000)).otherwise(F.floor(F.log(x) / F.log(F.lit(GROWTH))).cast("int"))
    long = measured.where(~failed()).select("lang", "source", F.explode(F.create_map(*[y for k, x in rates().items() for y in (F.lit(k), bucket(x))])).alias("name", "b"))
    counts = checkpointed(long.groupBy("lang", "source", "name", "b").agg(F.count("*").alias("n")))  # the merged sketches
    sketch = lambda *by: counts.groupBy(*by, "name", "b").agg(F.sum("n").alias("n")).groupBy(*by, "name").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("b", "n"))).alias("h"))
    everything = F.broadcast(sketch().select("name", F.col("h").alias("_a"), F.col("rows").alias("_n")))
    langs = sketch("lang").join(everything, "name").select(F.col("name").alias("_k"), F.col("lang").alias("_l"), _joined("_a", "_n").alias("_h"), (F.col("rows") + PRIOR_ROWS).alias("_r"))
    hist = sketch("lang", "source").join(langs, (F.col("name") == F.col("_k")) & F.col("lang").eqNullSafe(F.col("_l"))).withColumn("h", _joined("_h", "_r"))
    at = lambda q: f"aggregate(tail, struct(0D as seen, -1000 as b), (a, x) -> struct(a.seen + x.n, if(a.seen < {q}D * some, x.b, a.b)), a -> a.b)"
    hist = hist.withColumn("tail", F.expr("filter(h, x -> x.b > -1000)")).withColumn("some", F.expr("aggregate(tail, 0D, (a, x) -> a + x.n)"))
    hist = hist.withColumn("low", F.expr(at(0.25))).withColumn("mid", F.expr(at(0.5)))
    floor = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in FLOORS.items()])
    bound = floor * (1 + F.greatest(F.col("some") / (F.col("rows") + PRIOR_ROWS) - 0.5, F.lit(0.0)))
    most = F.when(F.col("mid") == F.col("low"), floor).otherwise(F.least(F.pow(F.lit(GROWTH), F.col("mid") + 1 + 4 * (F.col("mid") - F.col("low"))), bound))
    return hist.select("lang", "source", "name", most.alias("most")).groupBy("lang", "source").pivot("name", list(FLOORS)).agg(F.first("most"))


def judged(measured: DataFrame, m: str = "_m") -> DataFrame:
    """Measured documents with ``base_failed`` and ``kept``."""
    own = checkpointed(thresholds(measured.select("lang", "source", F.col(m).alias("_m"))))
    if own.count() * ROW_BYTES <= BROADCAST_BYTES:  # else the documents are shuffled by language and source
        own = F.broadcast(own)
    lang, source, fences = fresh(measured, "own_lang"), fresh(measured, "own_source"), fresh(measured, "own_fences")
    own = own.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*FLOORS).alias(fences))
    out = measured.join(own, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    fine = F.lit(True)
    for k, x in rates(m).items():
        fine = fine & F.coalesce(x <= F.col(f"{fences}.{k}"), F.lit(True))  # groups without a fence have no row that passes the base rules
    return out.withColumn("base_failed", failed(m)).withColumn("kept", ~failed(m) & fine).drop(lang, source, fences)


def report(docs: DataFrame) -> DataFrame:
    measured = checkpointed(measures(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(measured).select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever they are called.  Rows are
    measured once, beside what they hold packed into one column, and written before they are judged."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), F.col("lang"), F.col("source"))
    measured = checkpointed(measures(packed).drop("text"))
    return judged(measured).where("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
