"""The filter audit, hard negatives and telephony audio against brute force written without the operators' code."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactgraph.llm import filter_audit, hard_negatives, queries, telephony
from impactgraph.llm.common import Scratch

# Filter audit


def failures(text, doc_id, least):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    caps = sum("A" <= c <= "Z" for c in text)
    rules = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * caps > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and least.get(text, doc_id) < doc_id)
    return {x for x, fails in zip("ABCDE", rules, strict=True) if fails}


def audited(docs, labels):
    least, marks, out = {}, {}, {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, q, x in labels:
        if d is not None:
            good, toxic = marks.get(d, (False, False))
            marks[d] = good or q == 1, toxic or x == 1
    rows = [(lang or "", failures(t or "", d, least), *(marks.get(d, (False, False)) if d is not None else (False, False))) for d, t, lang in docs]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for i, x in enumerate(order):
                before = set(order[:i])
                removed = [r for r in own if x in r[1] and not r[1] & before]
                shapley[x] += len(removed)
                kept = sum(not r[1] & (before | {x}) for r in own)
                redundant = sum(x in r[1] and bool(r[1] & before) for r in own)
                out[part, "".join(order), i + 1] = [kept, len(removed), redundant, sum(r[1] == {x} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
DOCS = "doc_id long, text string, lang string, mask int, part string, h string, n long, good boolean"


def documents():
    r = random.Random(3)
    base = [" ".join(f"w{i}" for i in range(120)), " ".join(["a", "b"] * 80), "ABC " * 130, "short # text", "é" * 40 + "AAAAA", "é" * 45 + "AAAAA", "", "\x0b\x0c", "x|" * 150]
    docs = [(d, r.choice(base) if r.random() < 0.7 else f"{r.choice(base)} {d}", r.choice(["en", "de", None, ""])) for d in range(150)]
    docs += [(None, base[0], "en"), (None, base[0], "en"), (7, base[0], "de"), (7, base[0], "de"), (900, None, None), (-1, "", "fr")]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1, None])) for d in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit(spark):
    docs, labels = documents()
    df = spark.createDataFrame([(*d, 1, "x", "h", 2, True) for d in docs], DOCS).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, marks).collect()
    assert {(x.part, x.filter_order, x.step): tuple(x[m] for m in MEASURES) for x in got} == audited(docs, labels)
    assert len(got) == 600 * 4 and all(x.filter == x.filter_order[x.step - 1] for x in got)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert filter_audit.audit(df, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).collect()[0][:] == (0, 0)


def test_audit_of_other_filters(spark):
    df = spark.createDataFrame([(1, "aa", "en"), (2, "a", None), (3, "b", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, marks, failures={"s": lambda t, w: F.length(t) < 2, "a": lambda t, w: t.contains("a")}, copy=None)
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant) for x in got.collect()} == {
        ("en", "as", 1): (1, 1, 0), ("en", "as", 2): (0, 1, 0), ("en", "sa", 1): (1, 1, 0), ("en", "sa", 2): (0, 1, 0), ("", "as", 1): (0, 1, 0), ("", "as", 2): (0, 0, 1), ("", "sa", 1): (0, 1, 0), ("", "sa", 2): (0, 0, 1)
    }
    with pytest.raises(ValueError):
        filter_audit.audit(df, marks, failures={x: lambda t, w: t.isNull() for x in "abcdefg"})


# Hard negatives


def mined(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=10):
    """rows: (key, id, label, vector of ints)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for key, i, label, v in rows:
        if not anchor(i):
            continue
        scored = sorted((-dot(v, b[3]), b[1], b[0], b[2]) for b in rows if b[0] != key)
        for rank, (p, pid, _, _) in enumerate([x for x in scored if x[3] == label][:positives], 1):
            fit = [x for x in scored if x[3] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out += [(i, rank, pid, -p, n, x[1], -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, row string, id string, v int"


def usable(rows):
    ok = [(k, i, label, v) for k, (i, v, label) in enumerate(rows) if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    return [(k, i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for k, i, label, v in ok]


def vectors(seed=1, n=700, dims=6):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [x + r.choice([0, 0, 0.1, r.gauss(0, 0.5)]) for x in r.choice(base)], r.randrange(4)) for i in range(n)]
    rows += [(1000, None, 1), (1001, base[0], None), (None, base[0], 1), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1200, [math.nan] * dims, 1), (1300, [math.inf] * dims, 1), (1400, [], 2), (1500, base[1][:3], 3), (100, base[2], 0), (1600, [0.0] * dims, 9)]
    return rows


def asked(df, **settings):
    return sorted(tuple(x) for x in hard_negatives.mine(df, F.col("id") % 100 == 0, **settings).collect())


def test_hard_negatives(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*x, "r", "i", 0) for x in rows], SCHEMA).repartition(5)
    want = mined(usable(rows))
    assert len(want) > 300 and asked(df) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 400)  # several blocks of anchors
    assert asked(df, positives=2, negatives=3) == mined(usable(rows), positives=2, negatives=3)
    assert asked(df.limit(0)) == [] and asked(df.where("vec_id % 100 = 1")) == []
    with pytest.raises(ValueError):
        hard_negatives.mine(df, F.lit(True), low=50, high=40)


def test_scores_beyond_float64_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([1, 2, 3]) * 4e5 + r.randrange(64) / 32 for _ in range(40)], r.randrange(2)) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    exact = [(k, i, label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows)]
    assert max(x[3] for x in mined(exact)) > 1 << 53
    assert asked(df) == mined(exact)


def test_best_rows_merge():
    r = np.random.default_rng(4)
    key, score, id_ = r.integers(0, 5, 400), r.integers(-3, 4, 400), r.integers(0, 50, 400)
    best = hard_negatives.Best(5, 7)
    for a in range(0, 400, 33):
        best.add(key[a : a + 33], score[a : a + 33], id_[a : a + 33], np.arange(a, min(400, a + 33)))
        if a % 66:
            best.shrink()
    got = list(zip(*(x.tolist() for x in best.shrink()), strict=True))
    rows = sorted((k, -s, i, n) for n, (k, s, i) in enumerate(zip(key.tolist(), score.tolist(), id_.tolist(), strict=True)))
    assert got == [(k, -s, i, n) for k, own in itertools.groupby(rows, lambda x: x[0]) for _, s, i, n in list(own)[:7]]


# Telephony audio


def one_sample(code, law):
    """G.711 by its definition, one code at a time."""
    if law == "ulaw":
        code = 255 - code
        size = (2 * (code % 16) + 33) * 2 ** (code // 16 % 8) - 33
        return (-4 if code >= 128 else 4) * size
    code ^= 0x55
    part, low = code // 16 % 8, code % 16
    size = 2 * low + 1 if part == 0 else (2 * low + 33) * 2 ** (part - 1)
    return (8 if code >= 128 else -8) * size


def slow_adpcm(block):
    head, at = struct.unpack_from("<hB", block)
    at, out = min(at, 88), [head]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[at])
            move = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            head = max(-32768, min(32767, head - move if code & 8 else head + move))
            at = max(0, min(88, at + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(head)
    return out


def slow_resample(x, up, down, taps):
    half, out = taps.shape[1] // 2, []
    for j in range(-(-len(x) * up // down)):
        place, phase = divmod(j * down, up)
        total = 1 << 14
        for k in range(2 * half):
            at = place + k - half + 1
            total += int(taps[phase, k]) * (x[at] if 0 <= at < len(x) else 0)
        out.append(max(-32768, min(32767, total >> 15)))
    return out


def slow_wav(payload, codec):
    if codec == "adpcm":
        data = b"".join(bytes(4) + payload[i : i + 64] for i in range(0, len(payload), 64))
        fmt = struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 68 // 129, 68, 4, 2, 129)
        n = len(payload) // 64 * 129
    else:
        data, n = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", {"ulaw": 7, "alaw": 6}[codec], 1, 8000, 8000, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def slow_sound(payload, codec):
    if codec != "adpcm":
        return [one_sample(c, codec) for c in payload]
    return [s for i in range(0, len(payload), 64) for s in slow_adpcm(bytes(4) + payload[i : i + 64])]


def test_tables_and_blocks():
    assert telephony.ULAW.tolist() == [one_sample(c, "ulaw") for c in range(256)] and telephony.ALAW.tolist() == [one_sample(c, "alaw") for c in range(256)]
    assert (telephony.ULAW.min(), telephony.ALAW.max(), telephony.ULAW[255]) == (-32124, 32256, 0)
    r = np.random.default_rng(1)
    for width in (5, 68, 256):
        blocks = r.integers(0, 256, (9, width), np.uint8)
        assert telephony.adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


def test_resampling_leaves_no_trace_of_pieces(monkeypatch):
    r = np.random.default_rng(2)
    x = r.integers(-32768, 32768, 3000).astype(np.int16)
    for rate, to_rate in ((8000, 16000), (8000, 8000), (11025, 16000), (16000, 6000)):
        up, down, taps = telephony._filter(rate, to_rate)
        assert (taps.sum(axis=1) == 32768).all()
        whole = telephony.resample(x, 0, len(x), 0, up, down, taps)
        assert whole.tolist() == slow_resample(x.tolist(), up, down, taps)
    assert telephony.resample(x, 0, 3000, 0, 2, 1, telephony.kernel(2, 1))[::2].tolist() == x.tolist()
    codes = r.integers(0, 256, 64 * 300, np.uint8).tobytes()
    for codec in telephony.CODECS:
        data = telephony.write_wav(codes, codec)
        wav = telephony.read_wav(data)
        one = b"".join(p.tobytes() for p in telephony.pieces(data, wav, 16000))
        monkeypatch.setattr(telephony, "PIECE", 1000)
        assert one == b"".join(p.tobytes() for p in telephony.pieces(data, wav, 16000)) == b"".join(p.tobytes() for _, p in telephony.sounds([(data, wav)], 16000))
        monkeypatch.undo()
        cut = data[: wav.start + (wav.align if codec == "adpcm" else 64) * 3]
        both = dict(telephony.sounds([(data, wav), (cut, telephony.read_wav(cut)), (data, wav)], 16000))
        assert both[0].tobytes() == both[2].tobytes() == one and one.startswith(both[1].tobytes()[:20])


def test_payloads_come_back(spark):
    texts = [None, "", "a", "x" * 64, "y" * 65, "é€😀" * 500, "long " * 60_000, "a", "tail\x00", "tail"] + [f"text {i} " * (i % 50) for i in range(120)]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long, media string").repartition(3)
    got = {x.doc_id: x for x in telephony.features(telephony.stored(docs, Scratch(spark, "audio"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x, raw = got[i if i != 5 else None], (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        codec = ("ulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]
        media = slow_wav(payload, codec)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])), i
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()), i
        assert x.feature.split(":")[0] == codec
        if len(raw) < 5000:
            sound = slow_resample(slow_sound(payload, codec), 2, 1, telephony.kernel(2, 1))
            turns = sum((a < 0) != (b < 0) for a, b in zip([0, *sound], sound, strict=False))
            assert x.feature == ":".join(map(str, (codec, len(sound), max(map(abs, sound)), sum(s * s for s in sound), turns, zlib.crc32(struct.pack(f"<{len(sound)}h", *sound))))), i
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[7][1:] and got[8].payload_sha256 == got[9].payload_sha256
    assert telephony.features(telephony.stored(docs.limit(0), Scratch(spark, "audio"))).count() == 0
    assert {f for x in got.values() for f in [x.feature.split(":")[0]]} == {"ulaw", "alaw", "adpcm"}


def test_pcm_of_files(spark, tmp_path):
    good = {c: telephony.write_wav(bytes(range(64)) * 3, c) for c in telephony.CODECS}
    listed = good["ulaw"][:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good["ulaw"][12:]
    stereo = bytearray(good["ulaw"])
    stereo[22] = 2
    bad = {"none": None, "empty": b"", "text": b"no file at all", "cut": good["ulaw"][:30], "stereo": bytes(stereo), "order": good["ulaw"][:12] + good["ulaw"][good["ulaw"].index(b"data") :]}
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None, "c") for k, v in (good | {"listed": listed} | bad).items()], "name string, media binary, codec string")
    table = telephony.store_pcm(rows, str(tmp_path / "pcm"), to_rate=16000)
    got = {x.row.name: x for x in table.collect()}
    for c, data in good.items():
        want = slow_resample(slow_sound(bytes(range(64)) * 3, c), 2, 1, telephony.kernel(2, 1))
        assert (got[c].codec, got[c].rate, got[c].samples, got[c].error) == (c, 8000, len(want), None) and bytes(got[c].pcm) == struct.pack(f"<{len(want)}h", *want)
    assert got["listed"].pcm == got["ulaw"].pcm and got["ulaw"].row.codec == "c"
    assert all(got[k].pcm is None and got[k].error for k in bad)
    assert telephony.pcm(rows.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"op11_filter_audit", "op12_hard_negatives", "op13_telephony"} <= set(queries.QUERIES) and {"op11_filter_audit", "op12_hard_negatives"} <= set(queries.ORACLES)
