"""Secret scans (native: SQL expressions only).

Base patterns give spans of kinds assign, access and hex.  The method adds kind entropy: in runs
of ``WINDOW`` or more key characters a window slides over the run; entering and leaving characters
change the counts and the sum of c*log2(c) from which the Shannon entropy follows.  A run's span
goes from the first to the end of the last window that reaches the threshold of its own character
class (hex, alphanumeric, other), so a name joined to a key by =, - or _ does not hide it; windows
of digits only or of one kind of letters keep the threshold of the run's class; runs on the allow-list (one kind of letters, digits only, UUIDs, examples) are
left out.  Null and empty texts have no spans; repeated rows are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
HEX_BITS, ALNUM_BITS, OTHER_BITS = 2.9, 3.7, 3.9
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALLOWED = r"^([a-z]+|[A-Z]+|[A-Z]?[a-z_=/+-]+|[0-9=/+_-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$|(?i:example)"


def _found(kind: str, rank: int, pattern: str, group: int = 0) -> str:
    """Matches in order, placed by the lengths of what lies between them: array<struct<start, rank, kind, end, value>>."""
    value = f"regexp_extract_all(t, r'{pattern}', {group})" if group else "m"
    return f"""if(t rlike r'{pattern}', transform(array(struct(regexp_extract_all(t, r'{pattern}', 0) as m, split(t, r'{pattern}', -1) as gaps)), x ->
      transform(array(struct(x.m as m, x.gaps as gaps)), y -> aggregate(sequence(0, size(y.m) - 1),
        struct(0L as at, cast(array() as array<struct<start: bigint, rank: int, kind: string, end: bigint, whole: string>>) as found),
        (a, i) -> struct(a.at + length(y.gaps[i]) + length(y.m[i]) as at,
          concat(a.found, array(struct(a.at + length(y.gaps[i]) as start, {rank} as rank, '{kind}' as kind, a.at + length(y.gaps[i]) + length(y.m[i]) as end, y.m[i] as whole))) as found),
        a -> a.found))[0])[0], cast(array() as array<struct<start: bigint, rank: int, kind: string, end: bigint, whole: string>>))"""


def _entropy(s: str) -> str:
    """struct<lo, hi>: the first and last index at which a window that reaches the threshold ends, or -1."""
    f = lambda c: f"if({c} <= 1, 0D, {c} * log2({c}))"
    bits = f"if({s} rlike '^[0-9a-fA-F]+$', {HEX_BITS}D, if({s} rlike '^[A-Za-z0-9]+$', {ALNUM_BITS}D, {OTHER_BITS}D))"
    # the last places of characters that tell a window's class
    last = {"nonhex": "not (e.i between 48 and 57 or e.i between 65 and 70 or e.i between 97 and 102)", "other": "not (e.i between 48 and 57 or e.i between 65 and 90 or e.i between 97 and 122)", "digit": "e.i between 48 and 57", "upper": "e.i between 65 and 90", "lower": "e.i between 97 and 122"}
    places = "struct(" + ", ".join(f"if({c}, i, a.p.{k}) as {k}" for k, c in last.items()) + ")"
    within = lambda k: f"u.p.{k} > i - {WINDOW}"
    kinds = " + ".join(f"if({within(k)}, 1, 0)" for k in ("digit", "upper", "lower"))
    most = f"if({kinds} < 2 or {within('other')}, a.most, if({within('nonhex')}, least({ALNUM_BITS}D, a.most), {HEX_BITS}D))"
    step = f"""transform(array(struct(ch[i] as i, if(i < {WINDOW}, -1, ch[greatest(i - {WINDOW}, 0)]) as o)), e -> transform(array(struct(
        if(e.i = e.o, a.total, a.total + {f('(a.n[e.i] + 1)')} - {f('a.n[e.i]')} + if(e.o < 0, 0D, {f('(a.n[greatest(e.o, 0)] - 1)')} - {f('a.n[greatest(e.o, 0)]')})) as total, {places} as p)), u ->
        transform(array(i >= {WINDOW - 1} and log2({WINDOW}D) - u.total / {WINDOW}D >= {most}), high -> struct(
        if(e.i = e.o, a.n, transform(a.n, (c, k) -> c + if(k = e.i, 1, 0) - if(k = e.o, 1, 0))) as n, u.total as total,
        if(a.lo < 0 and high, i, a.lo) as lo, if(high, i, a.hi) as hi, a.most as most, u.p as p))[0])[0])[0]"""
    none = ", ".join(f"-{WINDOW} as {k}" for k in last)
    return f"""transform(array(transform(filter(split({s}, ''), c -> c <> ''), c -> ascii(c))), ch -> aggregate(sequence(0, size(ch) - 1),
      struct(array_repeat(0, 128) as n, 0D as total, -1 as lo, -1 as hi, {bits} as most, struct({none}) as p), (a, i) -> {step}, a -> struct(a.lo as lo, a.hi as hi)))[0]"""


def scanned(docs: DataFrame) -> DataFrame:
    """docs with ``_s``: the sorted spans struct<start, rank, kind, end> of all kinds."""
    text = "coalesce(cast(text as string), '')"
    slim = lambda x: f"transform({x}, y -> struct(y.start, y.rank, y.kind, y.end))"
    long_enough = rf"filter({_found('assign', 0, ASSIGN)}, y -> length(regexp_extract(y.whole, r'{ASSIGN}', 1)) >= 6)"
    runs = rf"filter({_found('entropy', 3, RUN)}, y -> not y.whole rlike r'{ALLOWED}')"
    high = f"""transform(filter(transform({runs}, y -> struct(y.start as start, {_entropy('y.whole')} as w)), z -> z.w.lo >= 0),
      z -> struct(z.start + z.w.lo - {WINDOW - 1} as start, 3 as rank, 'entropy' as kind, z.start + z.w.hi + 1 as end))"""
    body = f"transform(array({text}), t -> sort_array(concat({slim(long_enough)}, {slim(_found('access', 1, ACCESS))}, {slim(_found('hex', 2, HEX))}, {high})))[0]"
    # a generator keeps Catalyst from repeating the expression for each column that reads it
    return docs.select("*", F.explode(F.array(F.expr(body))).alias("_s"))


def report(docs: DataFrame) -> DataFrame:
    number = lambda k: F.expr(f"cast(size(filter(_s, x -> x.rank = {k})) as bigint)")
    line = lambda x: f"array_join(transform({x}, x -> x.kind || ':' || x.start || ':' || x.end), ',')"
    return scanned(docs.select("doc_id", "text")).select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.expr(f"sha2({line('filter(_s, x -> x.rank < 3)')}, 256)").alias("base_sha256"), F.expr(line("_s")).alias("spans"))
