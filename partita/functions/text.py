"""Text functions: titles and artists, fuzzy equality, word and sentence splitting, syllables, vocabularies."""

from __future__ import annotations

import math
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.operators import operator

# What is cut from titles, and the corrections of vowel groups when syllables are counted
_JUNK = [r"\.(mid|midi|kar)$", r"^\d{1,3}[\s.\-_]+", r"[\[(]?(https?://)?(www\.)?[\w-]+\.(com|net|org|ru|de|co\.uk)[\])]?"]
_MODIFIERS = "remix remastered remaster radio\\s*edit album\\s*version single\\s*version explicit clean dirty acoustic live instrumental cover karaoke backing\\s*track demo extended short\\s*edit mix original version final v\\d+ rev\\d+ edit lyrics video audio official performance reprise interlude outro intro skit".split()
FEWER = ["cial", "tia", "cius", "cious", "giu", "ion", "iou", "sia$", ".ely$"]
MORE = ["ia", "riet", "dien", "iu", "io", "ii", "[aeiouym]bl$", "[aeiou][aeiou][aeiou]", "^mc", "ism$", "[^l]lien", "^coa[dglx].", "[^gq]ua[^auieo]", "dnt$"]
_ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "e.g", "i.e", "inc", "ltd", "co", "no", "jan", "feb", "mar", "apr", "aug", "sept", "oct", "nov", "dec", "u.s", "u.k"}


# --- titles and artists ----------------------------------------------------------------------------


def plain(text: str) -> str:
    """Letters without marks, other scripts dropped, without file endings, track numbers and addresses."""
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    for pattern in _JUNK:
        text = re.sub(pattern, "", text, flags=re.I)
    return text.strip()


def clean_title(raw: str) -> str:
    text = re.split(r"\s*[(\[{-]?\s*\b(?:feat\.?|featuring|ft\.?)\s", plain(raw), maxsplit=1, flags=re.I)[0]
    text = re.sub(rf"[(\[{{~*_-]?\s*\b(?:{'|'.join(_MODIFIERS)})\b\s*[)\]}}~*_-]?", "", text, flags=re.I)
    text = re.sub(r"[\s.\-_]+(?:v?\d+)?$", "", text, flags=re.I)
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text).strip()).replace("_", "").strip().lower()


def clean_artist(raw: str) -> str:
    """Artists parted, words and artists sorted, so that order does not matter."""
    text = re.split(r"\s+(?:feat\.?|featuring|ft\.?|pres\.?)\s", plain(raw) + " ", maxsplit=1, flags=re.I)[0]
    out = []
    for part in re.split(r"\s+(?:x|vs\.?|and)\s+|\s*[&,]\s*", text, flags=re.I):
        part = re.sub(r"^(?:the|a|an)\s+(?!the\b)", "", part.strip(), flags=re.I)
        part = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"[^\w\s]", "", part))
        if words := sorted(part.lower().split()):
            out.append(" ".join(words))
    return " ".join(sorted(out))


def split_name(name: str) -> tuple[str, str]:
    """(artist, title) of a file name."""
    parts = re.split(r"\s*[-_]\s*", plain(name.rsplit("/", 1)[-1]), maxsplit=1)
    return (parts[0], parts[1]) if len(parts) == 2 else ("", parts[0])


def alike(a: str, b: str, threshold: float) -> bool:
    """Equal, or a Ratcliff-Obershelp ratio of at least the threshold where the lengths allow it."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) / max(len(a), len(b)) > 1 - threshold:
        return False
    shared = sum(min(a.count(c), b.count(c)) for c in set(a))  # no fewer than the characters that match in order
    return 2.0 * shared / (len(a) + len(b)) >= threshold and SequenceMatcher(None, a, b).ratio() >= threshold


def same_title(a: str, b: str, threshold: float = 0.85) -> bool:
    return alike(clean_title(a), clean_title(b), threshold)


def same_artist(a: str, b: str, threshold: float = 0.88) -> bool:
    return alike(clean_artist(a), clean_artist(b), threshold)


def chord_match(a: list[tuple], b: list[tuple], field: int = 4) -> float:
    """-1 for equal chords, 100 if any pair of fields agrees, else the mean ratio of the notes as texts, in percent."""
    if a == b:
        return -1.0
    if any(x[field] == y[field] for x, y in zip(a, b, strict=False)):
        return 100.0
    found = [SequenceMatcher(None, str(x), str(y)).ratio() for x, y in zip(a, b, strict=False)]
    return 100 * sum(found) / len(found) if found else 0.0


def _over(frame: DataFrame, column: str, name: str, kind: str, function) -> DataFrame:
    """frame with a column more, made value by value in Arrow batches."""
    arrow = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "struct<artist:string,title:string>": pa.struct([("artist", pa.string()), ("title", pa.string())])}[kind]

    def run(batches):
        for batch in batches:
            made = [None if x is None else function(x) for x in batch[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{fields}, {name} {kind}")


def with_titles(frame: DataFrame, column: str = "title") -> DataFrame:
    return _over(frame, column, "clean", "string", clean_title)


def with_artists(frame: DataFrame, column: str = "artist") -> DataFrame:
    return _over(frame, column, "clean", "string", clean_artist)


def with_names(frame: DataFrame, column: str = "path") -> DataFrame:
    return _over(frame, column, "name", "struct<artist:string,title:string>", lambda x: dict(zip(("artist", "title"), split_name(x), strict=True)))


# --- texts that are alike: all pairs, without a shared gram, which short texts need not have ---------------

_SYMBOLS = np.full(256, 37, dtype=np.uint8)  # small letters, digits, space; all other characters are one symbol
_SYMBOLS[[*range(97, 123), *range(48, 58), 32]] = np.arange(37)
_PAD = 38


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, lengths): a row of symbols for each text, filled up with a mark."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.full((len(texts), int(size.max(initial=0))), _PAD, dtype=np.uint8)
    for k, t in enumerate(texts):
        codes[k, : size[k]] = _SYMBOLS[np.frombuffer(t.encode("ascii", "replace"), np.uint8)]
    return codes, size


def _counts(codes: np.ndarray, kind) -> np.ndarray:
    """(symbols, texts): how often each text holds each symbol."""
    at = np.arange(len(codes))[:, None] * (_PAD + 1) + codes
    return np.ascontiguousarray(np.bincount(at.ravel(), minlength=len(codes) * (_PAD + 1)).reshape(len(codes), -1)[:, :_PAD].T.astype(kind))


def _subsequences(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The longest common subsequence of rows a[p] and b[q]: a column of the table is the bits of a few words, and all
    pairs go along b together (Hyyro)."""
    words = (a.shape[1] + 63) // 64
    if len(p) < 16 * words:  # few pairs or long texts
        return np.array([_subsequence(a[i, : a_size[i]].tobytes(), b[j, : b_size[j]].tobytes()) for i, j in zip(p.tolist(), q.tolist(), strict=True)], dtype=np.int64)
    masks = np.zeros((len(a), _PAD + 1, words), dtype=np.uint64)
    for k in range(a.shape[1]):
        masks[np.arange(len(a)), a[:, k], k // 64] |= np.uint64(1 << k % 64)
    out = np.zeros(len(p), dtype=np.int64)
    by, room = np.argsort(-b_size[q], kind="stable"), max(1, (1 << 16) // max(1, words))
    for at in range(0, len(p), room):
        some = by[at : at + room]
        ps, qs = p[some], q[some]
        alive = np.searchsorted(-b_size[qs], -np.arange(int(b_size[qs[0]])), side="left")
        bits = np.full((words, len(some)), ~np.uint64(0))
        for step, m in enumerate(alive.tolist()):
            found, carry = masks[ps[:m], b[qs[:m], step]], None
            for w in range(words):
                was = bits[w, :m]
                hit = was & found[:, w]
                now = was + hit
                over = now < hit
                if carry is not None:
                    now += carry
                    over |= now < carry
                bits[w, :m], carry = now | (was ^ hit), over.astype(np.uint64)
        for w in range(words):
            n = np.clip(a_size[ps] - 64 * w, 0, 64)
            valid = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))
            out[some] += np.bitwise_count(~bits[w] & valid)
    return out


def _subsequence(a: bytes, b: bytes) -> int:
    """The same of one pair, a column as one long number."""
    full = (1 << len(a)) - 1
    masks = {c: int(a.translate(bytes(48 + (x == c) for x in range(256)))[::-1], 2) for c in set(a)}
    bits = full
    for c in b:
        hit = bits & masks.get(c, 0)
        bits = (bits + hit) | (bits ^ hit)
    return (~bits & full).bit_count()


def alike_places(left: list[str], right: list[str], threshold: float, same: bool) -> list[tuple[int, int]]:
    """Places of texts of two lists that are alike in either order; of one list with itself each pair once.

    What is left out cannot reach the threshold: the characters that match in order are a common subsequence, and no
    more than the characters that both texts hold in any order."""
    (a, a_size), (b, b_size) = _coded(left), _coded(right)
    kind = np.uint8 if max(a.shape[1], b.shape[1]) < 256 else np.int32
    ones, others = _counts(a, kind), _counts(b, kind)
    out = []
    for at in range(0, len(left), 256):
        some = slice(at, at + 256)
        total = a_size[some, None] + b_size[None, :]
        shared = np.zeros(total.shape, dtype=kind)
        for k in range(_PAD):
            shared += np.minimum(ones[k, some, None], others[k][None, :])
        p, q = np.nonzero(shared >= np.ceil(threshold * total / 2 - 1e-6))
        p += at
        if same:
            p, q = p[p < q], q[p < q]
        if len(p):
            able = 2 * _subsequences(a, a_size, b, b_size, p, q) >= threshold * (a_size[p] + b_size[q]) - 1e-6
            pairs = zip(p[able].tolist(), q[able].tolist(), strict=True)
            out += [(i, j) for i, j in pairs if alike(left[i], right[j], threshold) or alike(right[j], left[i], threshold)]
    return out


def _blocks(texts: DataFrame, groups: dict[int, tuple[int, int, int, int]]) -> DataFrame:
    """(block, low, high, ids, texts): texts of like length, and the range of blocks that they can be alike to."""
    spark = texts.sparkSession
    ranges = spark.createDataFrame([(g, *r) for g, r in groups.items()], "g int, first int, parts int, low int, high int")
    dealt = texts.withColumn("g", _group()).join(F.broadcast(ranges), "g")
    block = F.col("first") + F.pmod(F.xxhash64("clean"), F.col("parts")).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("id", "clean")))
    return dealt.groupBy(block.alias("block")).agg(F.first("low").alias("low"), F.first("high").alias("high"), rows.alias("r")).select("block", "low", "high", F.col("r.id").alias("ids"), F.col("r.clean").alias("texts"))


def _group():
    """Lengths in classes that grow by a twentieth."""
    return F.floor(F.log(F.greatest(F.length("clean"), F.lit(1))) / math.log(1.05)).cast("int")


def _partners(texts: DataFrame, threshold: float, rows: int, letters: int) -> dict[int, tuple[int, int, int, int]]:
    """Of each class of lengths: its first block, its number of blocks, and the first and last block whose lengths allow the ratio."""
    size = F.length("clean")
    found = sorted(texts.groupBy(_group().alias("g")).agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.min(size).alias("low"), F.max(size).alias("high")).collect())
    parts = [max(1, -(-r.n // rows), -(-r.chars // letters)) for r in found]
    first = [sum(parts[:k]) for k in range(len(parts))]
    out = {}
    for k, r in enumerate(found):
        near = [i for i, x in enumerate(found) if min(r.high, x.high) >= threshold * max(r.low, x.low) - 1e-6]
        out[r.g] = (first[k], parts[k], first[near[0]], first[near[-1]] + parts[near[-1]] - 1)
    return out


def alike_texts(texts: DataFrame, threshold: float = 0.85, rows: int = 2048, letters: int = 1 << 20) -> DataFrame:
    """(a, b, same) over texts (id, clean), the whole similarity join.  Equal texts are a class, named by its least id:
    each other member b meets its class a (same), and classes a < b whose texts are alike in either order meet once.

    Blocks of texts of like length meet in a shuffle; each pair of blocks is one tile, in which all pairs are compared."""
    from partita.operators.iterate import checkpointed

    texts = texts.where("clean is not null and id is not null").select(F.col("id").cast("long").alias("id"), "clean")
    classes = checkpointed(texts.groupBy("clean").agg(F.min("id").alias("id")))
    copies = texts.join(classes.select("clean", F.col("id").alias("a")), "clean").where("id <> a").select("a", F.col("id").alias("b"), F.lit(True).alias("same")).distinct()
    groups = _partners(classes, threshold, rows, letters)
    blocks = checkpointed(_blocks(classes, groups))
    tasks = min(1024, 1 + sum(parts * (high - first + 1) for first, parts, _, high in groups.values()) // 2)  # tiles are few bytes and much work, so they aren't joined to larger tasks
    left = blocks.select(F.col("block").alias("i"), F.explode(F.expr("sequence(block, high)")).alias("j"), F.col("ids").alias("a_ids"), F.col("texts").alias("a_texts"))
    right = blocks.select(F.explode(F.expr("sequence(low, block)")).alias("i"), F.col("block").alias("j"), F.col("ids").alias("b_ids"), F.col("texts").alias("b_texts"))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                found = alike_places(r["a_texts"], r["b_texts"], threshold, r["i"] == r["j"])
                pairs = [sorted((r["a_ids"][p], r["b_ids"][q])) for p, q in found]
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64())})

    links = left.repartition(tasks, "i", "j").join(right.repartition(tasks, "i", "j"), ["i", "j"]).mapInArrow(compare, "a long, b long").withColumn("same", F.lit(False))
    return links.unionByName(copies)


# --- pages ----------------------------------------------------------------------------------------------


def page_score(title: Column, extract: Column, artist: str, song: str) -> Column:
    """Relevance of a page for a song: words in its title count more than in its text, marks of a song page add."""
    t, x = F.lower(title), F.lower(extract)
    score = F.lit(0)
    for word, weight in ((song.lower(), 4), (artist.lower(), 2)):
        score = score + F.when(t.contains(word), weight).otherwise(0) + F.when(x.contains(word), weight / 2).otherwise(0)
    return score + F.when(t.contains("(song)"), 3).otherwise(0) - F.when(is_disambiguation(title, extract), 5).otherwise(0)


def is_disambiguation(title: Column, extract: Column) -> Column:
    return F.lower(title).contains("disambiguation") | F.lower(extract).rlike("may refer to|can refer to")


def search_queries(artist: Column, song: Column) -> Column:
    return F.array(F.concat(F.lit('"'), song, F.lit('" "'), artist, F.lit('"')), F.concat_ws(" ", song, artist, F.lit("song")), F.concat_ws(" ", artist, song), song)


# --- words and sentences ------------------------------------------------------------------------------------


class WordModel:
    """Costs of words by rank (Zipf), and the cheapest way to part a run of letters."""

    def __init__(self, words: list[str]):
        self.cost = {w: math.log((k + 1) * math.log(max(len(words), 2))) for k, w in enumerate(words)}
        self.longest = max(map(len, words), default=1)

    def part(self, text: str) -> list[str]:
        best, back = [0.0], [0]
        for i in range(1, len(text) + 1):
            tries = [(best[j] + self.cost.get(text[j:i].lower(), 9e99), i - j) for j in range(max(0, i - self.longest), i)]
            cost, size = min(tries)
            best.append(cost)
            back.append(size)
        out, i = [], len(text)
        while i:
            word = text[i - back[i] : i]
            if out and word != "'" and (out[-1] == "'s" or (word[-1].isdigit() and out[-1][0].isdigit())):
                out[-1] = word + out[-1]
            else:
                out.append(word)
            i -= back[i]
        return out[::-1]

    def split(self, text: str) -> list[str]:
        return [w for run in re.split(r"(\s+)", text) for w in ([run] if run.isspace() else self.part(run)) if w]


def split_words(frame: DataFrame, words: list[str], column: str = "text") -> DataFrame:
    """frame with ``words``; the word list is a parameter of the closure and stays under a stated size."""
    if len(words) > 500_000:
        raise ValueError("a word list of at most 500,000 words travels with the tasks")
    model = WordModel(words)
    return _over(frame, column, "words", "array<string>", model.part)


def word_costs(lines: DataFrame) -> DataFrame:
    """(word, rank, cost) of a ranked word list (rank, word) by Zipf's law."""
    n = lines.count()
    return lines.select("word", "rank", F.log((F.col("rank") + 1) * math.log(max(n, 2))).alias("cost"))


def ends_sentence(word: str) -> bool:
    if re.match(r"^[A-Za-z](\.[A-Za-z])*\.$", word):
        return False
    if word[-1] in "?!" or len(re.sub(r"[^A-Z]", "", word)) > 1:
        return True
    return word[-1] == "." and word[:-1].lower().lstrip("('\"[") not in _ABBREVIATIONS


def sentences(text: str) -> list[str]:
    """Sentences that end in a mark, may close quotes, and are followed by space and no small letter."""
    cuts = [m.start() + len(m[1]) + len(m[2]) for m in re.finditer(r"([\w.'’&\])]+[.?!])([‘’“”'\")\]]*)(\s+(?![a-z\-–—]))", text) if ends_sentence(m[1])]
    return [text[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def with_sentences(frame: DataFrame, column: str = "text") -> DataFrame:
    return _over(frame, column, "sentences", "array<string>", sentences)


# --- syllables ------------------------------------------------------------------------------------------------


def syllables(word: str) -> int:
    """Groups of vowels, corrected for endings that add or drop one; at least one."""
    n = len([p for p in re.split(r"[^aeiouy]+", word) if p])
    n -= sum(bool(re.match(p, word)) for p in FEWER)
    n += sum(bool(re.match(p, word)) for p in MORE)
    return max(1, n)


def marks_to_bits(word: str) -> str:
    """'1' at letters that begin a syllable, where a mark that is no letter stands before one; a yen sign stands between syllables and takes no place."""
    starts, letters = {0}, 0
    for i, c in enumerate(word):
        if c == "¥":
            starts.add(letters)
            continue
        if i + 1 < len(word) and not (c == " " or "a" <= c <= "z"):
            starts.add(letters + 1)
        letters += 1
    return "".join("1" if k in starts else "0" for k in range(letters))


def syllable_parts(word: str, least: int = 2) -> list[str]:
    """A word parted before the last consonant between vowels; parts under ``least`` letters join the next (the last the one before)."""
    cuts, vowels = [0], [m.span() for m in re.finditer(r"[aeiouy]+", word.lower())]
    for (_, a), (b, _) in zip(vowels, vowels[1:], strict=False):
        between = word[a:b].lower()
        onset = 2 if len(between) > 1 and between[-2:] in {"bl", "br", "ch", "cl", "cr", "dr", "fl", "fr", "gl", "gr", "ph", "pl", "pr", "sh", "sl", "sp", "st", "th", "tr", "wh"} else 1
        cuts.append(b - min(onset, len(between)))
    return merge_short([word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True) if a < b], least)


def merge_short(parts: list[str], least: int) -> list[str]:
    out, held = [], ""
    for part in parts:
        held += part
        if len(held) >= least:
            out.append(held)
            held = ""
    if held:
        out[-1:] = [(out[-1] if out else "") + held]
    return out


def even_parts(word: str, target: int) -> list[str]:
    """A word in ``target`` parts, cut at syllables where there are enough of them and evenly where not."""
    parts = syllable_parts(word, 1)
    while len(parts) > target:
        k = min(range(len(parts) - 1), key=lambda i: len(parts[i]) + len(parts[i + 1]))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    if len(parts) < target:
        n = len(word)
        parts = [word[n * i // target : n * (i + 1) // target] for i in range(target)]
    return [p for p in parts if p]


def with_syllables(frame: DataFrame, column: str = "word") -> DataFrame:
    return _over(frame, column, "parts", "array<string>", syllable_parts)


# --- SQL operators over documents ---------------------------------------------------------------------------


def _words(d) -> str:
    text = d.replace("lower(text)", "[^a-z]+", " ")
    return f"select word, n from (select word, count(*) as n from (select {d.explode}({d.split(text, ' +')}) as word from {{docs}}) t group by word) u where word <> ''"


@operator
def word_counts(d) -> str:
    return _words(d)


@operator
def zipf_costs(d, most: int = 1000) -> str:
    """The commonest words with rank and cost."""
    return f"select word, rank, round(ln((rank + 1) * ln({most})), 6) as cost from (select word, row_number() over (order by n desc, word) - 1 as rank from ({_words(d)}) w) t where rank < {most}"


@operator
def syllable_counts(d) -> str:
    """Syllables of distinct words by groups of vowels and corrections at their start."""
    groups = f"{d.size}({d.where(d.split('word', '[^aeiouy]+'), 'p', 'length(p) > 0')})"
    fix = " ".join([*(f"- case when {d.matches('word', '^(' + p + ')')} then 1 else 0 end" for p in FEWER), *(f"+ case when {d.matches('word', '^(' + p + ')')} then 1 else 0 end" for p in MORE)])
    return f"select word, greatest(1, {groups} {fix}) as n from ({_words(d)}) w"


@operator
def mark_counts(d) -> str:
    """Marks that are neither letters nor spaces, plus one, per document's first line."""
    return f"select doc_id, length({d.replace('lower(text)', '[a-z ]', '')}) + 1 as n from {{docs}} where text is not null"


@operator
def line_ids(d) -> str:
    """Distinct lines numbered in order, and how often each comes."""
    line = f"select {d.explode}({d.split('text', chr(92) + 'n')}) as line from {{docs}}"
    return f"select line, row_number() over (order by line) - 1 as id, n from (select line, count(*) as n from ({line}) l group by line) t" if d.name == "spark" else f"select line, row_number() over (order by line collate c) - 1 as id, n from (select line, count(*) as n from ({line}) l group by line) t"


@operator
def last_places(d) -> str:
    """Each word of a document with its last place, as an id."""
    return f"select doc_id, word, max(i) as id from (select doc_id, {d.numbered(d.split('text', ' '), 'i', 'word')} from {{docs}} where text is not null) t group by doc_id, word"


@operator
def code_points(d, most: int = 255) -> str:
    """Characters as numbers, those over a bound left out and counted."""
    codes = d.split("text", "") if d.name == "spark" else "string_split(text, '')"
    code = "ascii(c)" if d.name == "spark" else "unicode(c)"
    return f"select doc_id, sum(case when code <= {most} then code else 0 end) as total, sum(case when code > {most} then 1 else 0 end) as skipped from (select doc_id, {code} as code from (select doc_id, {d.explode}({codes}) as c from {{docs}}) t where length(c) > 0) u group by doc_id"


@operator
def unknown_words(d, like: int = 0) -> str:
    """Words of documents that one document does not have, counted."""
    w = f"select doc_id, {d.explode}({d.split('text', ' ')}) as word from {{docs}}"
    return f"select a.doc_id, count(*) as n_words, sum(case when b.word is null then 1 else 0 end) as n_unknown from ({w}) a left join (select distinct word from ({w}) x where doc_id = {like}) b on a.word = b.word group by a.doc_id"


@operator
def packed_notes(offset: int = 30) -> str:
    """Notes as characters: pitch and velocity over an offset."""
    return f"select seq_id, pos, chr(cast({offset} + pitch % 90 as int)) || chr(cast({offset} + velocity % 90 as int)) as packed from {{notes}}"


@operator
def contour(d) -> str:
    """A sequence's contour: a star, then up, down or repeat."""
    step = "case when prev is null then '*' when pitch > prev then 'U' when pitch < prev then 'D' else 'R' end"
    return f"select seq_id, {d.joined(d.alist('step', 'pos'), '')} as contour from (select seq_id, pos, {step} as step from (select *, lag(pitch) over (partition by seq_id order by pos) as prev from {{notes}}) t) u group by seq_id"


@operator
def contour_part(d, offset: int = 1, limit: int = 3) -> str:
    return f"select seq_id, substr(contour, {offset + 1}, {limit}) as part from ({contour.text(d)}) c where length(contour) > {offset}"


@operator
def lyric_lines(d) -> str:
    """Words joined with a 2 after each and a 3 after each line."""
    return f"select doc_id, {d.replace(d.replace('text', ' ', '2'), chr(92) + 'n', '3')} as marked from {{docs}} where text is not null"


@operator
def held_against_benchmark(d, n: int = 8) -> str:
    """Documents that share no run of n words with any benchmark item."""
    w = lambda t, k: f"select {k} as id, {d.split(d.replace('lower(text)', '[^a-z0-9]+', ' '), ' ')} as w from {t} where text is not null"
    runs = lambda q: f"select id, {d.explode}({d.map(d.range(1, f'{d.size}(w) - {n - 1}'), 'i', d.joined(d.part('w', 'i', n), ' '))}) as run from ({q}) s"
    return f"select doc_id from {{docs}} x where not exists (select 1 from (select distinct a.id from ({runs(w('{docs}', 'doc_id'))}) a join (select distinct run from ({runs(w('{items}', 'item_id'))}) c) b on a.run = b.run) h where h.id = x.doc_id)"
