"""MusicXML scores, plain or zipped (.mxl), as notes.

``parse`` reads one score; ``decoded`` reads a frame with one row per file.  A measure's cursor moves
with notes, forward and backup; chord notes begin with the note before; times are in quarters, as
exact fractions until the end.  A file that is no score has no notes and the flag ``corrupt``.
"""

from __future__ import annotations

import io
import zipfile
from fractions import Fraction
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}  # fixed values
NOTES = "path string, corrupt boolean, part string, measure int, pos int, onset double, dur double, pitch int, voice int, rest boolean, grace boolean, tie string"
MOST = 64 << 20  # bytes of a score that is unpacked


def _score(content: bytes) -> bytes:
    """The score itself; of a zip, the file that its container names."""
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        name = None
        if "META-INF/container.xml" in names:
            for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter():
                if e.tag.endswith("rootfile"):
                    name = e.get("full-path")
                    break
        name = name or next(n for n in names if n.endswith((".xml", ".musicxml")) and not n.startswith("META-INF"))
        if z.getinfo(name).file_size > MOST:
            raise ValueError("the score is too large")
        return z.read(name)


def _text(e, path: str, default: str | None = None) -> str | None:
    found = e.find(path)
    return default if found is None or found.text is None else found.text.strip()


def parse(content: bytes) -> list[tuple]:
    """(part, measure, pos, onset, dur, pitch, voice, rest, grace, tie), onsets and lengths in quarters."""
    body = _score(content)
    if b"<!ENTITY" in body:
        raise ValueError("entities are not read")
    root = ElementTree.fromstring(body)
    if not root.tag.endswith("score-partwise"):
        raise ValueError("not a partwise score")
    out = []
    for part in root.findall("part"):
        divisions, begin, pos = Fraction(1), Fraction(0), 0
        for number, measure in enumerate(part.findall("measure")):
            cursor = end = last = begin
            for e in measure:
                if e.tag == "attributes":
                    divisions = Fraction(_text(e, "divisions") or divisions)
                elif e.tag in ("backup", "forward"):
                    cursor += Fraction(_text(e, "duration", "0")) / divisions * (1 if e.tag == "forward" else -1)
                    end = max(end, cursor)
                elif e.tag == "note":
                    grace = e.find("grace") is not None
                    dur = Fraction(0) if grace else Fraction(_text(e, "duration", "0")) / divisions
                    onset = last if e.find("chord") is not None else cursor
                    step = _text(e, "pitch/step")
                    pitch = None if step is None else 12 * (int(_text(e, "pitch/octave", "4")) + 1) + STEPS[step] + int(float(_text(e, "pitch/alter", "0")))
                    tie = "+".join(sorted(t.get("type", "") for t in e.findall("tie"))) or None
                    out.append((part.get("id"), number, pos, float(onset), float(dur), pitch, int(_text(e, "voice", "1")), e.find("rest") is not None, grace, tie))
                    pos += 1
                    if e.find("chord") is None:
                        last, cursor = onset, cursor + dur
                    end = max(end, cursor)
            begin = end
    return out


def playable(notes: list[tuple], melody: bool = False) -> list[tuple[str, float, float, int]]:
    """(part, onset, stop, pitch): no rests or grace notes, tied notes as one, overlaps of one pitch cut, and, for a melody, the highest of each onset."""
    out: list[list] = []
    held: dict[tuple, list] = {}
    for part, _, _, onset, dur, pitch, _, rest, grace, tie in notes:
        if rest or grace or pitch is None or dur <= 0:
            continue
        tie = tie or ""
        if "stop" in tie and (part, pitch) in held:
            held[part, pitch][2] = onset + dur
        else:
            out.append(row := [part, onset, onset + dur, pitch])
            if "start" in tie:
                held[part, pitch] = row
        if "start" not in tie:
            held.pop((part, pitch), None)
    out.sort(key=lambda r: (r[0], r[1], -r[3]))
    if melody:
        out = [r for i, r in enumerate(out) if i == 0 or (r[0], r[1]) != (out[i - 1][0], out[i - 1][1])]
        for a, b in zip(out, out[1:], strict=False):
            if a[0] == b[0]:
                a[2] = min(a[2], b[1])
    last: dict[tuple, list] = {}
    for r in out:
        if (before := last.get((r[0], r[3]))) and before[2] > r[1]:
            before[2] = r[1]
        last[r[0], r[3]] = r
    return [tuple(r) for r in out if r[2] > r[1]]


def decoded(files: DataFrame) -> DataFrame:
    """Notes of files (path, content); a file without notes is one row with a null part."""
    kinds = [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in NOTES.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = [(path, False, *n) for n in parse(content.as_py() or b"")]
                except (ElementTree.ParseError, ValueError, KeyError, StopIteration, zipfile.BadZipFile):
                    rows = [(path, True, *[None] * 10)]
                rows = rows or [(path, False, *[None] * 10)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, NOTES)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,musicxml,mxl}").load(path)
    return decoded(files)
