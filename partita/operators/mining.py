"""Sequence mining and models: frequent patterns, byte pairs, n-grams and chains, repeats, thresholds."""

from __future__ import annotations

import random
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators import operator
from partita.operators.iterate import checkpointed

# --- contiguous patterns ------------------------------------------------------------------------


def _grams(d, n: int) -> str:
    leads = ", ".join(f"lead(pitch, {j}) over (partition by seq_id order by pos) as t{j}" for j in range(1, n))
    text = " || ' ' || ".join(["cast(pitch as string)"] + [f"cast(t{j} as string)" for j in range(1, n)])
    return f"select seq_id, pos, {text} as gram, pitch from (select seq_id, pos, pitch{', ' + leads if leads else ''} from {{notes}}) t"


@operator
def pattern_support(d, length: int = 2, least: float = 0.0005) -> str:
    """Patterns of a length with the number of sequences that hold them, where that is at least a share of all."""
    return f"select gram, count(distinct seq_id) as support from ({_grams(d, length)}) g where gram is not null group by gram having count(distinct seq_id) >= {least} * (select count(distinct seq_id) from {{notes}})"


@operator
def next_candidates(d, length: int = 2, least: float = 0.0005) -> str:
    """Candidates one longer: frequent patterns joined where one's end is the other's start."""
    f = pattern_support.text(d, length=length, least=least)
    return f"select a.gram || ' ' || {d.extract('b.gram', '([0-9]+)$', 1)} as gram from ({f}) a join ({f}) b on {d.replace('a.gram', '^[0-9]+ ', '')} = {d.replace('b.gram', ' [0-9]+$', '')}"


def frequent_patterns(sequences: DataFrame, least: float = 0.1, most: int = 64) -> DataFrame:
    """(pattern, support): the longest contiguous patterns that a share of all sequences (seq_id, tokens) holds.

    Level by level; candidates of a level are windows whose two shorter parts are frequent, by semi-joins."""
    n = sequences.count()
    base = checkpointed(sequences.select("seq_id", "tokens"))
    found, level = None, None
    for size in range(1, most + 1):
        windows = base.where(F.size("tokens") >= size).select("seq_id", F.explode(F.expr(f"array_distinct(transform(sequence(1, size(tokens) - {size} + 1), i -> slice(tokens, i, {size})))")).alias("pattern"))
        if level is not None:
            short = level.select(F.col("pattern").alias("p"))
            windows = windows.join(short, F.slice("pattern", 1, size - 1) == F.col("p"), "left_semi").join(short, F.slice("pattern", 2, size - 1) == F.col("p"), "left_semi")
        now = checkpointed(windows.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= least * n))
        if not now.limit(1).count():
            break
        found = level = now
    return found if found is not None else base.select(F.col("tokens").alias("pattern"), F.lit(0).cast("long").alias("support")).limit(0)


# --- byte pairs -----------------------------------------------------------------------------------


def merge_pair(tokens: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def best_pair(sequences: DataFrame) -> tuple[int, int, int] | None:
    """(a, b, n): the commonest neighbours, overlaps counted, the smallest on a tie."""
    pairs = sequences.where(F.size("tokens") > 1).select(F.explode(F.expr("transform(sequence(0, size(tokens) - 2), i -> struct(tokens[i] as a, tokens[i + 1] as b))")).alias("p"))
    row = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").first()
    return (row["a"], row["b"], row["n"]) if row else None


def learn_pairs(sequences: DataFrame, vocabulary: int = 4096, most: int = 64) -> tuple[list[tuple[int, int, int]], DataFrame]:
    """(codes, sequences): merges (a, b, new) in order, and the sequences after them.  It ends when no pair comes twice."""
    now = checkpointed(sequences.select("seq_id", F.col("tokens").cast("array<int>").alias("tokens")))
    top = (now.select(F.max(F.array_max("tokens"))).first()[0] or 0) + 1
    codes = []
    for k in range(min(most, max(0, vocabulary - top))):
        found = best_pair(now)
        if found is None or found[2] < 2:
            break
        codes.append((found[0], found[1], top + k))
        pair, new = (found[0], found[1]), top + k
        now = now.mapInArrow(_merging([(*pair, new)]), "seq_id long, tokens array<int>")
        if k % 8 == 7:
            now = checkpointed(now)
    return codes, now


def _merging(codes: list[tuple[int, int, int]], stable: bool = False):
    rules = {(a, b): new for a, b, new in codes}

    def encode(tokens):
        if not stable:
            for a, b, new in codes:
                tokens = merge_pair(tokens, (a, b), new)
            return tokens
        while True:
            out, i = [], 0
            while i < len(tokens):
                new = rules.get((tokens[i], tokens[i + 1])) if i + 1 < len(tokens) else None
                out.append(tokens[i] if new is None else new)
                i += 1 if new is None else 2
            if len(out) == len(tokens):
                return out
            tokens = out

    def run(batches):
        for batch in batches:
            tokens = [encode(list(t or [])) for t in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["seq_id"].cast(pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["seq_id", "tokens"])

    return run


def retokenize(sequences: DataFrame, codes: list[tuple[int, int, int]]) -> DataFrame:
    """Merges applied in rank order, one pass from left to right each."""
    return sequences.select("seq_id", "tokens").mapInArrow(_merging(codes), "seq_id long, tokens array<int>")


def encode_pairs(sequences: DataFrame, codes: list[tuple[int, int, int]]) -> DataFrame:
    """Passes from left to right that apply whichever merge fits, until none does."""
    return sequences.select("seq_id", "tokens").mapInArrow(_merging(codes, stable=True), "seq_id long, tokens array<int>")


def expansions(codes: list[tuple[int, int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for a, b, new in codes:
        out[new] = out.get(a, [a]) + out.get(b, [b])
    return out


def decode_pairs(sequences: DataFrame, codes: list[tuple[int, int, int]]) -> DataFrame:
    """Each merged token back to what it stands for, by a map literal."""
    table = expansions(codes)
    if not table:
        return sequences.select("seq_id", "tokens")
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return sequences.select("seq_id", F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(known, t), F.array(t)))).alias("tokens"))


# --- n-gram maps and chains -------------------------------------------------------------------------


@operator
def context_counts(d, memory: int = 2) -> str:
    """What follows each context of ``memory`` tokens, with counts."""
    lags = " || ' ' || ".join(f"cast(lag(pitch, {j}) over (partition by seq_id order by pos) as string)" for j in range(memory, 0, -1))
    return f"select context, pitch as next, count(*) as n from (select pitch, {lags} as context from {{notes}}) t where context is not null group by context, pitch"


@operator
def context_table(d, memory: int = 2) -> str:
    """One row a context: its followers and their counts, by follower."""
    return f"select context, {d.joined(d.alist('cast(next as string)', 'next'), ' ')} as candidates, {d.joined(d.alist('cast(n as string)', 'next'), ' ')} as counts from ({context_counts.text(d, memory=memory)}) c group by context"


@operator
def distinct_sequences(d) -> str:
    return f"select pitches, count(*) as n from (select seq_id, {d.joined(d.alist('cast(pitch as string)', 'pos'), ' ')} as pitches from {{notes}} group by seq_id) t group by pitches"


def _chain(size: int) -> str:
    """States with BEGIN before a sequence and END after it."""
    n = "(select *, max(pos) over (partition by seq_id) as length from {notes})"
    rows = f"select seq_id, pos, cast(pitch as string) as tok from {{notes}} union all select seq_id, length + 1 as pos, 'END' as tok from {n} t where pos = length"
    state = " || ' ' || ".join(f"coalesce(lag(tok, {j}) over (partition by seq_id order by pos), 'BEGIN')" for j in range(size, 0, -1))
    return f"select {state} as state, tok as next from ({rows}) r"


@operator
def chain_counts(size: int = 2) -> str:
    """The table of a Markov chain: state, next token, count."""
    return f"select state, next, count(*) as n from ({_chain(size)}) c group by state, next"


@operator
def chain_sums(size: int = 2) -> str:
    """Running sums of each state's counts, by next token."""
    return f"select state, next, sum(n) over (partition by state order by next rows between unbounded preceding and current row) as total from ({chain_counts.text(size=size)}) c"


@operator
def chain_moves(size: int = 2, draw: float = 0.5) -> str:
    """The token that a draw in [0, 1) picks in each state."""
    return f"""select state, next from (select state, next, row_number() over (partition by state order by total) as rk from (select *, max(total) over (partition by state) as whole from ({chain_sums.text(size=size)}) s) t where total > {draw} * whole) u where rk = 1"""


@operator
def combined_chains(weights: tuple = (2, 1)) -> str:
    """A weighted sum of the chains of even and odd sequences."""
    return f"""select state, next, cast(sum(n) as bigint) as n from (select state, next, {weights[0]} as n, seq_id from ({_chain(1).replace('select coalesce', 'select seq_id, coalesce', 1)}) a where seq_id % 2 = 0
 union all select state, next, {weights[1]} as n, seq_id from ({_chain(1).replace('select coalesce', 'select seq_id, coalesce', 1)}) b where seq_id % 2 = 1) u group by state, next"""


def chain_json(counts: DataFrame) -> DataFrame:
    """(state, json): a state's followers as a JSON object, a row a state."""
    return counts.groupBy("state").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("next", "n"))))).alias("json"))


def walks(sums: DataFrame, starts: DataFrame, size: int = 2, most: int = 20, seed: int = 1) -> DataFrame:
    """(walk, tokens, done): seeded random walks from BEGIN to END, all walks a step at a time by joins on the state."""
    now = starts.select("walk", F.lit(" ".join(["BEGIN"] * size)).alias("state"), F.array().cast("array<string>").alias("tokens"), F.lit(False).alias("done"))
    ranges = checkpointed(sums.select("state", "next", F.col("total"), F.lag("total", 1, 0).over(_by_state()).alias("low"), F.max("total").over(_whole()).alias("whole")))
    for step in range(most):
        draw = F.pmod(F.xxhash64("walk", F.lit(seed), F.lit(step)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        open_ = now.where(~F.col("done")).withColumn("draw", draw)
        moved = open_.join(ranges, "state").where((F.col("draw") * F.col("whole") >= F.col("low")) & (F.col("draw") * F.col("whole") < F.col("total")))
        state = F.concat_ws(" ", F.expr(f"slice(split(state, ' '), 2, {size - 1})"), "next") if size > 1 else F.col("next")
        moved = moved.select("walk", state.alias("state"), F.when(F.col("next") == "END", F.col("tokens")).otherwise(F.concat("tokens", F.array("next"))).alias("tokens"), (F.col("next") == "END").alias("done"))
        now = checkpointed(moved.unionByName(now.where("done")))
        if not now.where(~F.col("done")).limit(1).count():
            break
    return now.select("walk", "tokens", "done")


def _by_state():
    from pyspark.sql import Window

    return Window.partitionBy("state").orderBy("total")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("state")


@operator
def overlaps(d, length: int = 2) -> str:
    """Sequences none of whose windows of a length comes in a sequence with a smaller number."""
    g = f"select seq_id, gram from ({_grams(d, length)}) g where gram is not null"
    return f"select seq_id from (select distinct seq_id from ({g}) a) s where not exists (select 1 from (select seq_id, max(case when first < seq_id then 1 else 0 end) as seen from (select seq_id, gram, min(seq_id) over (partition by gram) as first from ({g}) b) t group by seq_id) u where u.seq_id = s.seq_id and u.seen = 1)"


# --- repeats and negatives ---------------------------------------------------------------------------


def repeats(tokens: list[int], least: int = 8) -> list[tuple[list[int], list[int]]]:
    """(pattern, starts): patterns met twice or more without overlap, the longest first; where one is taken its places are used up.

    Windows of one length are grouped by content; lengths go down from half the sequence."""
    n, used, out = len(tokens), [False] * len(tokens), []
    for size in range(n // 2, least - 1, -1):
        places: dict[tuple, list[int]] = {}
        for i in range(n - size + 1):
            if not used[i]:
                places.setdefault(tuple(tokens[i : i + size]), []).append(i)
        for pattern, starts in sorted(places.items(), key=lambda x: x[1][0]):
            taken, end = [], -1
            for i in starts:
                if i >= end and not any(used[i : i + size]):
                    taken.append(i)
                    end = i + size
            if len(taken) > 1:
                for i in taken:
                    used[i : i + size] = [True] * size
                out.append((list(pattern), taken))
    return out


def repeating_patterns(sequences: DataFrame, least: int = 8) -> DataFrame:
    """(seq_id, pattern, starts) of ``repeats`` for each sequence."""

    def run(batches):
        for batch in batches:
            found = [(s, p, at) for s, t in zip(batch["seq_id"].to_pylist(), batch["tokens"].to_pylist(), strict=True) for p, at in repeats(t or [], least)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.int32()))], ["seq_id", "pattern", "starts"])

    return sequences.select("seq_id", "tokens").mapInArrow(run, "seq_id long, pattern array<int>, starts array<int>")


def corrupted(sequences: DataFrame, low: float = 0.02, high: float = 0.45, aligned: bool = True) -> DataFrame:
    """One negative for each sequence: cut by a share, then kept, masked at up to three places, or with two swapped; all follow the tokens themselves."""

    def one(tokens):
        draw = random.Random(zlib.crc32(str(tokens).encode()))
        keep = max(1, int(len(tokens) * (1 - draw.uniform(low, high))))
        keep = max(3, keep - keep % 3) if aligned and len(tokens) >= 3 else keep
        out, mode = tokens[:keep], draw.choice(["cut", "mask", "swap"])
        if mode == "mask":
            for i in draw.sample(range(len(out)), min(3, len(out))):
                out[i] = -1
        elif mode == "swap" and len(out) > 1:
            i, j = draw.sample(range(len(out)), 2)
            out[i], out[j] = out[j], out[i]
        return out, mode

    def run(batches):
        for batch in batches:
            made = [one(list(t or [])) for t in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["seq_id"].cast(pa.int64()), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.string())], ["seq_id", "tokens", "mode"])

    return sequences.select("seq_id", "tokens").mapInArrow(run, "seq_id long, tokens array<int>, mode string")


@operator
def best_threshold(precision: float = 0.5) -> str:
    """Of scored labels (score, label): the threshold of largest recall with a precision of at least so much, else that of the largest F1."""
    return f"""with s as (select score, sum(label) as p, count(*) as n from {{scored}} group by score),
 c as (select score, sum(p) over (order by score desc rows between unbounded preceding and current row) as tp, sum(n) over (order by score desc rows between unbounded preceding and current row) as called, sum(p) over () as pos from s),
 r as (select score, cast(tp as double) / called as prec, cast(tp as double) / nullif(pos, 0) as recall, 2.0 * tp / (called + pos) as f1 from c),
 o as (select *, row_number() over (order by case when prec >= {precision} then 0 else 1 end, round(case when prec >= {precision} then recall else f1 end, 9) desc, score desc) as rk from r)
 select score as threshold, round(prec, 6) as precision_, round(recall, 6) as recall, round(f1, 6) as f1 from o where rk = 1"""


@operator
def accuracy(threshold: float = 0.5) -> str:
    """Confusion counts and rates of scored labels at a threshold."""
    return f"""select count(*) as n, sum(case when (score >= {threshold}) = (label = 1) then 1 else 0 end) as right_, round(avg(case when (score >= {threshold}) = (label = 1) then 1.0 else 0.0 end), 6) as accuracy,
 round(sum(case when score >= {threshold} and label = 1 then 1.0 else 0.0 end) / nullif(sum(case when score >= {threshold} then 1 else 0 end), 0), 6) as precision_, round(sum(case when score >= {threshold} and label = 1 then 1.0 else 0.0 end) / nullif(sum(label), 0), 6) as recall from {{scored}}"""


def bleu_counts(pairs: DataFrame, order: int = 4) -> DataFrame:
    """(n, matched, total, made, given) over pairs of token arrays (made, wanted): clipped n-gram matches and lengths."""
    rows = checkpointed(pairs.withColumn("row", F.monotonically_increasing_id()))
    out = None
    for n in range(1, order + 1):
        grams = lambda c: rows.where(F.size(c) >= n).select("row", F.explode(F.expr(f"transform(sequence(1, size({c}) - {n - 1}), i -> slice({c}, i, {n}))")).alias("g")).groupBy("row", "g").agg(F.count("*").alias(c))  # noqa: B023, E731
        both = grams("made").join(grams("wanted"), ["row", "g"], "left")
        part = both.agg(F.sum(F.least("made", F.coalesce("wanted", F.lit(0)))).alias("matched"), F.sum("made").alias("total")).select(F.lit(n).alias("n"), F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("total", F.lit(0)).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def classifier(features: DataFrame, columns: list[str], label: str = "label", seed: int = 1) -> tuple:
    """(model, held-out area under the curve): scaled features, boosted trees; calibration and thresholds take a split of their own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    train, held = features.randomSplit([0.8, 0.2], seed)
    steps = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x"), GBTClassifier(featuresCol="x", labelCol=label, maxIter=10, seed=seed)]
    model = Pipeline(stages=steps).fit(train)
    return model, BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(held))


def tokens_of(notes: DataFrame) -> DataFrame:
    """(seq_id, tokens): pitches in order."""
    return notes.groupBy("seq_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, pitch))), x -> cast(x.pitch as int))").alias("tokens"))


def starts(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "walk")
