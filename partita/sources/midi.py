"""Standard MIDI files as tables of events, and back.

``decode`` and ``encode`` translate one file; ``decoded`` and ``encoded`` do so for a frame with one
row per file, and ``MidiDataSource`` makes both a Spark data source (``format("midi")``).

A file that does not begin with a six-byte header chunk has no events and the flag ``corrupt``; a
track that claims more bytes than are left, or whose running status was never set, ends the file
there with the flag, keeping the tracks before it.  An end of track with a delay is kept as an empty
text event, so that the track's length survives.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The kinds of channel messages by status, of text events by meta type, and of other meta events.
CHANNEL = {0x80: "note_off", 0x90: "note_on", 0xA0: "key_after_touch", 0xB0: "control_change", 0xC0: "patch_change", 0xD0: "channel_after_touch", 0xE0: "pitch_wheel_change"}
TEXT = ["text_event", "copyright_text_event", "track_name", "instrument_name", "lyric", "marker", "cue_point"] + [f"text_event_{k:02x}" for k in range(8, 16)]
META = {0x00: "set_sequence_number", 0x2F: "end_track", 0x51: "set_tempo", 0x54: "smpte_offset", 0x58: "time_signature", 0x59: "key_signature", 0x7F: "sequencer_specific"}
STATUS, TEXT_TYPE, META_TYPE = {v: k for k, v in CHANNEL.items()}, {v: k + 1 for k, v in enumerate(TEXT)}, {v: k for k, v in META.items()}

EVENTS = "path string, ticks int, corrupt boolean, track int, idx int, dtime long, tick long, kind string, channel int, num int, value int, data binary"
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
_ARROW = pa.schema([("path", pa.string()), ("ticks", pa.int32()), ("corrupt", pa.bool_()), ("track", pa.int32()), ("idx", pa.int32()), ("dtime", pa.int64()), ("tick", pa.int64()), ("kind", pa.string()), ("channel", pa.int32()), ("num", pa.int32()), ("value", pa.int32()), ("data", pa.binary())])
BATCH = 4096  # events of a record batch

Event = tuple  # (dtime, kind, channel, num, value, data)


class _Bytes:
    """A cursor over a track."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def more(self) -> bool:
        return self.at < len(self.data)

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        value = 0
        while True:
            b = self.byte()
            value = value << 7 | b & 0x7F
            if not b & 0x80:
                return value

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def _meta(dtime: int, kind: int, body: bytes) -> Event:
    if 1 <= kind <= 15:
        return dtime, TEXT[kind - 1], None, None, None, body
    name = META.get(kind)
    if name == "set_tempo" and len(body) >= 3:
        return dtime, name, None, None, int.from_bytes(body[:3], "big"), None
    if name == "time_signature" and len(body) >= 4:
        return dtime, name, None, body[0], body[1], body[2:4]
    if name == "key_signature" and len(body) >= 2:
        return dtime, name, None, struct.unpack("b", body[:1])[0], body[1], None
    if name == "set_sequence_number":
        return dtime, name, None, None, int.from_bytes(body, "big") if len(body) == 2 else 0, None
    if name == "end_track":
        return dtime, name, None, None, None, None
    if name in ("smpte_offset", "sequencer_specific"):
        return dtime, name, None, None, None, body
    return dtime, "raw_meta_event", None, kind, None, body


def decode_track(data: bytes, exclude: frozenset[str] = frozenset(), keep_end: bool = False) -> tuple[list[Event], bool]:
    """The events of a track, and whether it broke off."""
    src, out, status = _Bytes(data), [], None
    try:
        while src.more():
            dtime, first = src.number(), src.byte()
            if first < 0xF0:
                if first & 0x80:
                    status = first
                elif status is None:
                    return [], True
                else:
                    src.at -= 1
                kind, channel = CHANNEL[status & 0xF0], status & 15
                if kind in ("patch_change", "channel_after_touch"):
                    a = src.byte()
                    event = (dtime, kind, channel, a, None, None) if kind == "patch_change" else (dtime, kind, channel, None, a, None)
                else:
                    a, b = src.byte(), src.byte()
                    event = (dtime, kind, channel, None, (b << 7 | a) - 8192, None) if kind == "pitch_wheel_change" else (dtime, kind, channel, a, b, None)
            elif first == 0xFF:
                kind = src.byte()
                event = _meta(dtime, kind, src.take(src.number()))
                if event[1] == "end_track" and not keep_end:
                    if dtime and "text_event" not in exclude:
                        out.append((dtime, "text_event", None, None, None, b""))
                    return out, False
            elif first in (0xF0, 0xF7):
                event = (dtime, f"sysex_{first:02x}", None, None, None, src.take(src.number()))
            elif first == 0xF2:
                a, b = src.byte(), src.byte()
                event = (dtime, "song_position", None, None, b << 7 | a, None)
            elif first == 0xF3:
                event = (dtime, "song_select", None, None, src.byte(), None)
            elif first == 0xF6:
                event = (dtime, "tune_request", None, None, None, None)
            else:
                event = (dtime, "raw_data", None, None, None, bytes([src.byte()]))
            if event[1] not in exclude:
                out.append(event)
    except IndexError:
        return out, True
    return out, False


def decode(content: bytes, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> tuple[int, list[list[Event]], bool]:
    """(ticks per quarter, tracks, corrupt).  ``include``, where given, names the only kinds to keep."""
    if len(content) < 14 or content[:4] != b"MThd" or struct.unpack(">I", content[4:8])[0] != 6:
        return 1000, [], True
    drop, ticks = frozenset(exclude), struct.unpack(">H", content[12:14])[0]
    tracks, at, only = [], 14, frozenset(include)
    while at + 8 <= len(content):
        size = struct.unpack(">I", content[at + 4 : at + 8])[0]  # the chunk's name is not looked at
        if at + 8 + size > len(content):
            return ticks, tracks, True
        events, broken = decode_track(content[at + 8 : at + 8 + size], drop)
        tracks.append([e for e in events if e[1] in only] if only else events)
        if broken:
            return ticks, tracks, True
        at += 8 + size
    return ticks, tracks, False


def _number(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def encode_track(events: Iterable[Event], running: bool = True) -> bytes:
    out, status = bytearray(), None
    for dtime, kind, channel, num, value, data in events:
        out += _number(max(0, int(dtime)))
        if kind in STATUS:
            now = STATUS[kind] | channel & 15
            if not running or now != status:
                out.append(now)
            status = now
            if kind == "pitch_wheel_change":
                out += bytes([value + 8192 & 0x7F, value + 8192 >> 7 & 0x7F])
            else:
                out += bytes(x & 0x7F for x in (num, value) if x is not None)
            continue
        status = None
        if kind.startswith("sysex_"):
            out += bytes([int(kind[6:], 16)]) + _number(len(data)) + data
        elif kind == "song_position":
            out += bytes([0xF2, value & 0x7F, value >> 7 & 0x7F])
        elif kind == "song_select":
            out += bytes([0xF3, value & 0x7F])
        elif kind == "tune_request":
            out.append(0xF6)
        elif kind != "raw_data":
            if kind in TEXT_TYPE:
                code, body = TEXT_TYPE[kind], data or b""
            elif kind == "set_tempo":
                code, body = META_TYPE[kind], int(value).to_bytes(3, "big")
            elif kind == "time_signature":
                code, body = META_TYPE[kind], bytes([num, value]) + (data or b"\x18\x08")
            elif kind == "key_signature":
                code, body = META_TYPE[kind], struct.pack("bB", num, value)
            elif kind == "set_sequence_number":
                code, body = META_TYPE[kind], int(value).to_bytes(2, "big")
            else:
                code, body = META_TYPE.get(kind, num), data or b""
            out += bytes([0xFF, code]) + _number(len(body)) + body
    return bytes(out)


def encode(ticks: int, tracks: list[list[Event]]) -> bytes:
    """A file; an empty text event at a track's end becomes the delay of its end mark."""
    out = b"MThd" + struct.pack(">IHHH", 6, 0 if len(tracks) == 1 else 1, len(tracks), ticks)
    for events in tracks:
        events, delay = list(events), 0
        if events and events[-1][1] == "text_event" and not events[-1][5]:
            delay = events.pop()[0]
        body = encode_track([*events, (delay, "end_track", None, None, None, None)])
        out += b"MTrk" + struct.pack(">I", len(body)) + body
    return out


# --- frames ---------------------------------------------------------------------------------


def _rows(path: str, content: bytes, exclude, include) -> Iterator[tuple]:
    ticks, tracks, corrupt = decode(content, exclude, include)
    if not any(tracks):
        yield path, ticks, corrupt, None, None, None, None, None, None, None, None, None
    for track, events in enumerate(tracks):
        tick = 0
        for idx, (dtime, *rest) in enumerate(events):
            tick += dtime
            yield path, ticks, corrupt, track, idx, dtime, tick, *rest


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


def decoded(files: DataFrame, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> DataFrame:
    """Events of files (path, content); a file without events is one row with a null track."""
    exclude, include = tuple(exclude), tuple(include)

    def run(batches):
        files = ((path, content.as_py() or b"") for batch in batches for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True))
        yield from _batches(row for path, content in files for row in _rows(path, content, exclude, include))

    return files.select("path", "content").mapInArrow(run, EVENTS)


def read_events(spark: SparkSession, path: str, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> DataFrame:
    """Events of all ``.mid`` files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mid").load(path)
    return decoded(files, exclude, include)


_CODES = {**STATUS, "set_tempo": 0xFF}  # kinds that whole batches are encoded for at once
_ENCODED = pa.schema([("path", pa.string()), ("content", pa.binary())])
_ENCODE_ROWS = 200_000  # events that are encoded at once, unless one file has more


def _encode_sorted(table: pa.Table) -> pa.RecordBatch:
    """Files of events in order of path, track and place.  A file of channel messages and tempos is a run of rows
    of a byte matrix: its head, and for each track a head, the events and an end; other files go event by event."""
    table = table.combine_chunks()
    paths = table["path"].combine_chunks().dictionary_encode() if table["path"].num_chunks != 1 else table["path"].chunk(0).dictionary_encode()
    codes = paths.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    n = len(codes)
    new_file = np.r_[True, codes[1:] != codes[:-1]]
    at = np.flatnonzero(new_file)
    name = lambda k: None if codes[k] < 0 else paths.dictionary[int(codes[k])].as_py()
    number = lambda c, none: table[c].fill_null(none).to_numpy().astype(np.int64)
    kinds = table["kind"].combine_chunks().dictionary_encode() if table["kind"].num_chunks != 1 else table["kind"].chunk(0).dictionary_encode()
    known = np.array([_CODES.get(k, 0) for k in kinds.dictionary.to_pylist()] + [0])
    kind = known[kinds.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]
    track_null = table["track"].is_null().to_numpy(zero_copy_only=False)
    bad = (kind == 0) | track_null
    wanted = {0xFF: ("value",), 0xC0: ("channel", "num"), 0xD0: ("channel", "value"), 0xE0: ("channel", "value")}
    nulls = {c: table[c].is_null().to_numpy(zero_copy_only=False) for c in ("channel", "num", "value", "dtime", "ticks")}
    bad |= nulls["dtime"] | nulls["ticks"]
    for code in set(known.tolist()) - {0}:
        here = kind == code
        for c in wanted.get(code, ("channel", "num", "value")):
            bad |= here & nulls[c]
        if code in (0xC0, 0xD0):
            bad |= here & ~nulls["value" if code == 0xC0 else "num"]
    dtime, track, value, num, channel = np.maximum(number("dtime", 0), 0), number("track", -1), number("value", 0), number("num", 0), number("channel", 0)
    bad |= (dtime >= 1 << 28) | ((kind == 0xFF) & ((value < 0) | (value >= 1 << 24)))
    file = np.cumsum(new_file) - 1
    plain = np.zeros(len(at), dtype=bool)
    np.logical_or.at(plain, file[bad], True)
    contents: list = [None] * len(at)
    stops = np.r_[at[1:], n]
    for f in np.flatnonzero(plain):
        part = table.slice(at[f], stops[f] - at[f])
        tracks: dict[int, list] = {}
        for t, *event in zip(*(part[c].to_pylist() for c in ("track", "dtime", "kind", "channel", "num", "value", "data")), strict=True):
            if t is not None:
                tracks.setdefault(t, []).append(tuple(event))
        contents[f] = encode(part["ticks"][0].as_py(), [tracks[k] for k in sorted(tracks)])
    if not plain.all():
        ticks = number("ticks", 0)
        use = ~plain[file]
        dtime, track, value, num, channel, kind, file, ticks = (x[use] for x in (dtime, track, value, num, channel, kind, file, ticks))
        m = len(file)
        first_file = np.r_[True, file[1:] != file[:-1]]
        first_track = first_file | np.r_[True, track[1:] != track[:-1]]
        status = np.where(kind == 0xFF, 0xFF, kind | channel & 15)
        told = first_track | (status != np.r_[-1, status[:-1]]) | (kind == 0xFF)
        rows, keep = np.zeros((m, 10), dtype=np.uint8), np.zeros((m, 10), dtype=bool)
        for k in range(4):  # the delay, seven bits a byte, the highest first
            rows[:, 3 - k] = (dtime >> 7 * k & 0x7F) | (0x80 if k else 0)
            keep[:, 3 - k] = True if k == 0 else (dtime >> 7 * k) > 0
        tempo, bend = kind == 0xFF, kind == 0xE0
        rows[:, 4], keep[:, 4] = status, told
        rows[:, 5] = np.where(tempo, 0x51, np.where(bend, value + 8192 & 0x7F, num & 0x7F))
        keep[:, 5] = kind != 0xD0
        rows[:, 6] = np.where(tempo, 3, np.where(bend, value + 8192 >> 7 & 0x7F, value & 0x7F))
        keep[:, 6] = kind != 0xC0
        for k in range(3):
            rows[:, 7 + k], keep[:, 7 + k] = value >> 8 * (2 - k) & 0xFF, tempo
        size = keep.sum(axis=1)
        begins = np.flatnonzero(first_track)
        track_size = np.add.reduceat(size, begins) + 4
        of_track = first_file[begins]
        head = np.flatnonzero(of_track)
        n_tracks = np.diff(np.r_[head, len(begins)])
        file_size = 14 + np.add.reduceat(track_size + 8, head)
        out = np.zeros(int(file_size.sum()), dtype=np.uint8)
        file_at = np.cumsum(file_size) - file_size
        before = np.cumsum(track_size + 8) - (track_size + 8)
        which = np.cumsum(of_track) - 1
        track_at = file_at[which] + 14 + before - before[head][which]
        put = lambda place, bytes_: [out.__setitem__(place + k, b) for k, b in enumerate(bytes_)]
        put(file_at, [*b"MThd", 0, 0, 0, 6, 0, n_tracks > 1, n_tracks >> 8 & 0xFF, n_tracks & 0xFF, ticks[begins[head]] >> 8 & 0xFF, ticks[begins[head]] & 0xFF])
        put(track_at, [*b"MTrk", *(track_size >> 8 * (3 - k) & 0xFF for k in range(4))])
        put(track_at + 8 + track_size - 4, [0, 0xFF, 0x2F, 0])
        edges = np.zeros(len(out) + 1, dtype=np.int8)
        np.add.at(edges, track_at + 8, 1)
        np.add.at(edges, track_at + 4 + track_size, -1)
        inside = np.cumsum(edges[:-1], dtype=np.int8) > 0
        out[inside] = rows[keep]
        blob = out.tobytes()
        for f, a, b in zip(file[begins[head]].tolist(), file_at.tolist(), (file_at + file_size).tolist(), strict=True):
            contents[f] = blob[a:b]
    return pa.RecordBatch.from_arrays([pa.array([name(k) for k in at], pa.string()), pa.array(contents, pa.binary())], schema=_ENCODED)


def encoded(events: DataFrame) -> DataFrame:
    """(path, content) of events (path, ticks, track, idx, dtime, kind, channel, num, value, data): rows are dealt and
    sorted by path, and a task encodes the files of many rows at once."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < _ENCODE_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = table["path"][-1].as_py()
            same = pc.is_null(table["path"]) if last is None else pc.fill_null(pc.equal(table["path"], last), False)
            cut = n - pc.sum(same).as_py()  # rows of one path stand together: the last file may go on
            if cut:
                yield _encode_sorted(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield _encode_sorted(pa.Table.from_batches(held))

    found = events.select("path", "ticks", "track", "idx", "dtime", "kind", "channel", "num", "value", "data")
    return found.repartition("path").sortWithinPartitions("path", F.col("track").asc_nulls_last(), "idx").mapInArrow(run, "path string, content binary")


def opus_of(notes: DataFrame, ticks: int = 480, tempo: int = 500_000) -> DataFrame:
    """Events of notes (path, track, onset, dur, channel, pitch, velocity) in ticks: each track begins with a
    tempo, and at one tick notes end before others begin."""
    on = notes.select("path", "track", F.col("onset").alias("tick"), F.lit(1).alias("o"), F.lit("note_on").alias("kind"), "channel", F.col("pitch").alias("num"), F.col("velocity").alias("value"))
    off = notes.select("path", "track", (F.col("onset") + F.col("dur")).alias("tick"), F.lit(0).alias("o"), F.lit("note_off").alias("kind"), "channel", F.col("pitch").alias("num"), F.lit(0).alias("value"))
    first = notes.select("path", "track").distinct().select("path", "track", F.lit(0).alias("tick"), F.lit(-1).alias("o"), F.lit("set_tempo").alias("kind"), F.lit(None).cast("int").alias("channel"), F.lit(None).cast("int").alias("num"), F.lit(tempo).alias("value"))
    order = "partition by path, track order by tick, o, channel, num, value"
    return (
        on.unionByName(off).unionByName(first)
        .select("path", F.lit(ticks).alias("ticks"), "track", F.expr(f"cast(row_number() over ({order}) - 1 as int)").alias("idx"), F.expr(f"cast(tick - lag(tick, 1, 0) over ({order}) as bigint)").alias("dtime"), "kind", F.col("channel").cast("int"), F.col("num").cast("int"), F.col("value").cast("int"), F.lit(None).cast("binary").alias("data"))
    )


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.exclude = tuple(x for x in options.get("exclude", "").split(",") if x)
        self.include = tuple(x for x in options.get("include", "").split(",") if x)

    def partitions(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".mid")]

    def read(self, partition):
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with system.open_input_file(partition.path) as f:
            yield from _batches(_rows(partition.path, f.read(), self.exclude, self.include))


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """Writes one file for each row (path, content) into the folder; names are the last parts of paths."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        system.create_dir(root, recursive=True)
        for row in iterator:
            name = row["path"].rstrip("/").rsplit("/", 1)[-1]
            with system.open_output_stream(f"{root}/{name if name.endswith('.mid') else name + '.mid'}") as f:
                f.write(bytes(row["content"]))
        return _Written()


class MidiDataSource(DataSource):
    """``spark.read.format("midi")`` gives events; ``df.write.format("midi")`` takes (path, content)."""

    @classmethod
    def name(cls):
        return "midi"

    def schema(self):
        return EVENTS

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MidiDataSource)
