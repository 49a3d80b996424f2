"""Telephony audio as columns: mu-law, A-law and IMA ADPCM in WAV files, expanded and resampled to linear PCM.

`pcm` takes a table with a binary column of WAV files and returns 16-bit PCM at another rate; `store_pcm` writes it as
Parquet. `stored` wraps any bytes as such files without loss: as 8-bit codes of mu-law or A-law, or as the data of ADPCM
blocks of 64 bytes behind a header of 4. `features` reads files back and gives their bytes and figures.

mu-law and A-law are looked up in tables of 256 entries. ADPCM blocks carry their own start, so that all blocks of many
files are decoded side by side, one numpy step for each of a block's samples. Resampling is a polyphase filter of whole
numbers, so that results are equal on every machine. Texts and files are cut into pieces of PIECE bytes with a block of
context on both sides; a task holds one piece's samples at a time, however long the file is, beside the file itself.

Null bytes are empty bytes. Files that aren't mono WAV of these three formats give null PCM and a reason in `error`. Empty
tables give empty results, and other columns pass whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm.common import Scratch, bound_batches, numbered, slices

# Format tags of WAV files, the step sizes and index moves of IMA ADPCM.
TAGS = {7: "ulaw", 6: "alaw", 17: "adpcm"}
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

#: Rate of the stored codes and of the resampled PCM; bytes of a stored block; bytes of a piece; taps of the filter on a side.
RATE, TO_RATE, UNIT, PIECE, HALF = 8000, 16000, 64, 1 << 17, 8
CODECS = ("ulaw", "alaw", "adpcm")


def _ulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


ULAW, ALAW = _ulaw(), _alaw()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, (blocks, bytes) to (blocks, 2 (bytes - 4) + 1), all blocks side by side.

    A block starts with its first sample and step index; low nibbles come before high ones. Indices beyond the table are cut.
    """
    n, width = blocks.shape
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.empty((2 * (width - 4), n), np.int32)
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = head
    for i, code in enumerate(codes):
        step = STEPS[at]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        head = np.clip(head + np.where(code & 8, -move, move), -32768, 32767)
        at = np.clip(at + MOVES[code & 7], 0, len(STEPS) - 1)
        out[i + 1] = head
    return np.ascontiguousarray(out.T)


def kernel(up: int, down: int, half: int = HALF) -> np.ndarray:
    """(up, 2 half) whole-number taps, each phase with the sum 2^15: a Hann-windowed sinc below the lower of both rates."""
    cut = min(1.0, up / down)
    t = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    taps = np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * t / half)) * (np.abs(t) < half)
    whole = np.rint(taps / taps.sum(axis=1, keepdims=True) * 32768).astype(np.int64)
    whole[np.arange(up), np.abs(whole).argmax(axis=1)] += 32768 - whole.sum(axis=1)
    return whole


def resample(x: np.ndarray, start: int, end: int, first: int, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Output samples whose places lie at start <= place < end of the input, of which x holds samples from `first` on.

    Input beyond x counts as silence. Output j lies at j * down / up; cutting the input anywhere gives the same samples.
    """
    j, j_end = -(-start * up // down), -(-end * up // down)
    half = taps.shape[1] // 2
    # Sums of 16-bit samples by these taps fit 32 bits, unless a filter has a great overshoot.
    kind = np.int32 if np.abs(taps).sum(axis=1).max() < 65000 else np.int64
    padded = np.concatenate([np.zeros(half, kind), x.astype(kind), np.zeros(half + 1, kind)])
    out = np.empty(j_end - j, np.int16)
    for one in range(j, min(j + up, j_end)):
        n = -(-(j_end - one) // up)
        total, at = np.full(n, 1 << 14, kind), one * down // up - first + 1
        for k, tap in enumerate(taps[one * down % up].tolist()):
            if tap:
                total += padded[at + k : at + k + (n - 1) * down + 1 : down] * kind(tap)
        out[one - j :: up] = np.clip(total >> 15, -32768, 32767)
    return out


@dataclass
class Wav:
    """The format of a WAV file and where its data lie."""

    codec: str
    rate: int
    align: int
    start: int
    size: int

    @property
    def samples(self) -> int:
        """Samples of one block; codes of a byte each are blocks of one."""
        return 2 * (self.align - 4) + 1 if self.codec == "adpcm" else 1

    def decode(self, data: memoryview, first: int, last: int) -> np.ndarray:
        """Samples of the blocks first <= block < last."""
        raw = np.frombuffer(data[self.start + first * self.align : self.start + last * self.align], np.uint8)
        if self.codec == "adpcm":
            return adpcm(raw.reshape(-1, self.align)).reshape(-1)
        return (ULAW if self.codec == "ulaw" else ALAW)[raw]


def read_wav(data: bytes) -> Wav:
    """The chunks of a RIFF file; ValueError if it isn't mono audio of a known format. A last half block is left out."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            if size < 16 or at + 24 > len(data):
                raise ValueError("short format")
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", data, at + 8)
            if tag not in TAGS:
                raise ValueError(f"format {tag}")
            if channels != 1:
                raise ValueError(f"{channels} channels")
            form = TAGS[tag], rate, align if TAGS[tag] == "adpcm" else 1
            if rate < 1 or form[0] == "adpcm" and align < 5:
                raise ValueError("bad format")
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            codec, rate, align = form
            size = min(size, len(data) - at - 8)
            return Wav(codec, rate, align, at + 8, size - size % align)
        at += 8 + size + size % 2
    raise ValueError("no data")


def write_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A file that holds the payload, a multiple of UNIT bytes, as codes of this codec."""
    if len(payload) % UNIT:
        raise ValueError(f"not a multiple of {UNIT} bytes")
    tag = next(t for t, name in TAGS.items() if name == codec)
    if codec == "adpcm":
        align, bits, more = UNIT + 4, 4, struct.pack("<HH", 2, 2 * UNIT + 1)
        blocks = np.zeros((len(payload) // UNIT, align), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, samples, speed = blocks.tobytes(), len(blocks) * (2 * UNIT + 1), rate * align // (2 * UNIT + 1)
    else:
        align, bits, more, data, samples, speed = 1, 8, struct.pack("<H", 0), payload, len(payload), rate
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + more
    # The length fields of a RIFF file have 32 bits; longer data keep their low bits there, and the file's end is the end.
    size = lambda n: struct.pack("<I", n & 0xFFFFFFFF)
    body = b"fmt " + size(len(form)) + form + b"fact" + size(4) + size(samples) + b"data" + size(len(data)) + data
    return b"RIFF" + size(len(body) + 4) + b"WAVE" + body


def payload_of(data: bytes, wav: Wav) -> bytes:
    """What write_wav was given."""
    raw = memoryview(data)[wav.start : wav.start + wav.size]
    if wav.codec != "adpcm":
        return bytes(raw)
    return np.frombuffer(raw, np.uint8).reshape(-1, wav.align)[:, 4:].tobytes()


def _filter(rate: int, to_rate: int) -> tuple[int, int, np.ndarray]:
    """up, down and taps; slower output needs longer filters, in input samples."""
    common = math.gcd(rate, to_rate)
    up, down = to_rate // common, rate // common
    return up, down, kernel(up, down, HALF * max(1, -(-down // up)))


def pieces(data: bytes, wav: Wav, to_rate: int = TO_RATE) -> Iterator[np.ndarray]:
    """The file's resampled PCM, piece by piece; the pieces' edges leave no trace."""
    up, down, taps = _filter(wav.rate, to_rate)
    view, blocks, n = memoryview(data), wav.size // wav.align, wav.samples
    per, context = max(1, PIECE // wav.align), -(-(taps.shape[1] // 2 + 1) // n)
    for first in range(0, blocks, per):
        last = min(blocks, first + per)
        left, right = max(0, first - context), min(blocks, last + context)
        yield resample(wav.decode(view, left, right), first * n, last * n, left * n, up, down, taps)


def _decoded(files: list[tuple[bytes, Wav]]) -> list[np.ndarray]:
    """All samples of short files; ADPCM blocks of one width are decoded together, whichever files they are of."""
    out = [wav.decode(memoryview(data), 0, wav.size) if wav.codec != "adpcm" else None for data, wav in files]
    for align in {wav.align for _, wav in files if wav.codec == "adpcm"}:
        own = [i for i, (_, wav) in enumerate(files) if wav.codec == "adpcm" and wav.align == align]
        raw = b"".join(memoryview(files[i][0])[files[i][1].start : files[i][1].start + files[i][1].size] for i in own)
        ends = np.cumsum([files[i][1].size // align for i in own])
        for i, part in zip(own, np.split(adpcm(np.frombuffer(raw, np.uint8).reshape(-1, align)), ends[:-1]), strict=True):
            out[i] = part.reshape(-1)
    return out


def sounds(files: list[tuple[bytes, Wav]], to_rate: int = TO_RATE) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the file, its next PCM). Short files of one rate lie on one time line, with silence between them."""
    for rate in sorted({wav.rate for _, wav in files}):
        up, down, taps = _filter(rate, to_rate)
        short = [i for i, (_, wav) in enumerate(files) if wav.rate == rate and wav.size <= PIECE]
        for i, (data, wav) in enumerate(files):
            if wav.rate == rate and wav.size > PIECE:
                yield from ((i, p) for p in pieces(data, wav, to_rate))
        for a, b in slices([files[i][0] for i in short], PIECE):
            parts = _decoded([files[i] for i in short[a:b]])
            # Starts are multiples of `down`, so that each file's first output lies on its first sample.
            room = np.array([-(-(len(x) + taps.shape[1]) // down) * down for x in parts])
            starts = np.r_[0, np.cumsum(room)]
            line = np.zeros(starts[-1], np.int16)
            for x, at in zip(parts, starts.tolist(), strict=False):
                line[at : at + len(x)] = x
            out = resample(line, 0, len(line), 0, up, down, taps)
            for i, x, at in zip(short[a:b], parts, (starts // down * up).tolist(), strict=False):
                yield i, out[at : at - (-len(x) * up // down)]


def pcm(rows: DataFrame, media: str = "media", to_rate: int = TO_RATE) -> DataFrame:
    """rows as column `row` with codec, rate, samples, pcm (16-bit little-endian at to_rate) and error."""
    bound_batches(rows.sparkSession)
    table = rows.select(F.struct("*").alias("row"), F.coalesce(F.col(media), F.lit(b"")).alias("__media"))
    schema = table.select("row").schema.add("codec", "string").add("rate", "integer").add("samples", "long").add("pcm", "binary").add("error", "string")
    names, types = schema.names, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, files, places = [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                try:
                    wav = read_wav(data)
                    out.append([wav.codec, wav.rate, 0, [], None])
                    files.append((data, wav))
                    places.append(i)
                except ValueError as e:
                    out.append([None, None, None, None, str(e)])
            for i, p in sounds(files, to_rate):
                out[places[i]][2] += len(p)
                out[places[i]][3].append(p.astype("<i2").tobytes())
            for x in out:
                x[3] = None if x[3] is None else b"".join(x[3])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], names=names)

    return table.mapInArrow(run, schema)


def store_pcm(rows: DataFrame, path: str, media: str = "media", to_rate: int = TO_RATE) -> DataFrame:
    """Write `pcm` as Parquet and return what was written."""
    table = pcm(rows, media, to_rate)
    table.write.parquet(path)
    return rows.sparkSession.read.schema(table.schema).parquet(path)


def codec_of(payload: bytes) -> str:
    """A codec by the bytes alone, so that equal texts have equal files."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def stored(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_key, doc_id, n_bytes, media): whole texts with zeros up to a positive multiple of UNIT, as written WAV files."""
    rows = numbered(docs, scratch).select("row_key", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("doc.text", F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            files = []
            for b in raw:
                b = b or b""
                payload = b + bytes(-len(b) % UNIT if b else UNIT)
                files.append(write_wav(payload, codec_of(payload)))
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array([len(b or b"") for b in raw], pa.int64()), pa.array(files, pa.binary())], names=["row_key", "doc_id", "n_bytes", "media"])

    return scratch.write(rows.mapInArrow(run, "row_key long, doc_id long, n_bytes long, media binary"), "media")


class Figures:
    """Samples, peak, sum of squares, changes of sign and CRC-32 of PCM that comes piece by piece."""

    def __init__(self):
        self.n = self.peak = self.energy = self.turns = self.crc = 0
        self.minus = False

    def add(self, p: np.ndarray) -> None:
        if len(p):
            wide, minus = p.astype(np.int64), p < 0
            self.n, self.energy = self.n + len(p), self.energy + int(wide @ wide)
            self.peak = max(self.peak, int(p.max()), -int(p.min()))
            self.turns += int(np.count_nonzero(minus[1:] != minus[:-1])) + (bool(minus[0]) != self.minus)
            self.minus, self.crc = bool(minus[-1]), zlib.crc32(p.astype("<i2").tobytes(), self.crc)

    def __str__(self) -> str:
        return ":".join(map(str, (self.n, self.peak, self.energy, self.turns, self.crc)))


def features(files: DataFrame, to_rate: int = TO_RATE) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; of files of `stored`.

    feature: codec, samples of the resampled PCM, their peak, sum of squares, changes of sign, and CRC-32, joined by colons.
    """
    bound_batches(files.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            files = [(x, read_wav(x)) for x in media]
            found = [Figures() for _ in files]
            for i, p in sounds(files, to_rate):
                found[i].add(p)
            rows = []
            for (data, wav), f in zip(files, found, strict=True):
                payload = payload_of(data, wav)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), f"{wav.codec}:{f}"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([x[i] for x in rows], t) for i, t in enumerate(types[2:]))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
